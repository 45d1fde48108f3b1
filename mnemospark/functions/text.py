"""Text functions as column expressions: everything here stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The blocks counted as CJK.
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}"
_ALNUM = r"\p{IsAlphabetic}\p{N}"
_SPACE = r"\p{IsWhite_Space}"


def lit_or(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: lambdas repeat what stands inside them."""
    return F.get(F.transform(F.array(value), body), 0)


def count_tokens(text: Column | str) -> Column:
    """Token estimate: a CJK character or a symbol is one token, a run of ASCII letters and
    digits one per four, a run of other letters and digits one per two."""
    t = lit_or(text)
    return (
        F.regexp_count(t, F.lit("[A-Za-z0-9]{1,4}"))
        + F.regexp_count(t, F.lit(f"[[{_ALNUM}]&&[^A-Za-z0-9{CJK}]]{{1,2}}"))
        + F.regexp_count(t, F.lit(f"[{CJK}]"))
        + F.regexp_count(t, F.lit(f"[^{_ALNUM}{_SPACE}{CJK}]"))
    ).cast("long")


def has_cjk(text: Column | str) -> Column:
    return F.rlike(lit_or(text), F.lit(f"[{CJK}]"))


def normalise_space(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(lit_or(text), f"{_SPACE}+", " "))


def ascii_lower(text: Column | str) -> Column:
    return F.translate(lit_or(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def search_tokens(text: Column | str) -> Column:
    """Distinct lower-cased runs of letters and digits in order; a run of CJK characters gives
    its pairs when it has more than two, then itself when it has at most six."""
    runs = F.regexp_extract_all(ascii_lower(text), F.lit(f"[{CJK}]+|[[{_ALNUM}]&&[^{CJK}]]+"), F.lit(0))

    def expand(run: Column) -> Column:
        n = F.length(run)
        pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(run, i, F.lit(2)))
        whole = F.when(n <= 6, F.array(run)).otherwise(F.slice(F.array(run), 1, 0))
        return F.when(~F.rlike(run, F.lit(f"^[{CJK}]")) | (n <= 2), F.array(run)).otherwise(F.concat(pairs, whole))

    return F.array_distinct(F.flatten(F.transform(runs, expand)))


def normalise_keywords(keywords: Column | str, most: int) -> Column:
    """White space folded, blanks dropped, exact duplicates dropped, at most ``most``."""
    clean = F.filter(F.transform(lit_or(keywords), normalise_space), lambda k: k != "")
    return F.slice(F.array_distinct(clean), 1, most)


def keyword_overlap(terms: Column | str, content: Column | str, keywords: Column | str) -> Column:
    """Share of query terms that occur, as substrings, in content or keywords."""
    t = lit_or(terms)
    hay = ascii_lower(F.concat_ws(" ", lit_or(content), F.array_join(lit_or(keywords), " ")))
    found = let(hay, lambda h: F.size(F.filter(t, lambda x: F.contains(h, x))))
    return F.when(F.size(t) > 0, found / F.size(t)).otherwise(F.lit(0.0))


def overlay_score(terms: Column | str, content: Column | str) -> Column:
    """Number of query terms contained; a query without terms matches everything once."""
    t = lit_or(terms)
    found = let(F.lower(lit_or(content)), lambda h: F.size(F.filter(t, lambda x: F.contains(h, x))))
    return F.when(F.size(t) == 0, F.lit(1)).otherwise(found).cast("long")


def sanitise_query(text: Column | str) -> Column:
    """Letters, digits and white space stay, everything else becomes a space."""
    return F.regexp_replace(lit_or(text), f"[^{_ALNUM}{_SPACE}]", " ")


def query_terms(text: Column | str) -> Column:
    clean = F.lower(sanitise_query(text))
    return F.array_distinct(F.filter(F.split(clean, f"{_SPACE}+"), lambda x: x != ""))


def semantic_key(text: Column | str) -> Column:
    """Letters and white space only, ASCII lower-cased, white space folded."""
    return normalise_space(F.regexp_replace(ascii_lower(text), rf"[^\p{{IsAlphabetic}}{_SPACE}]", ""))


def preview(text: Column | str, most: int) -> Column:
    flat = normalise_space(text)
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.left(flat, F.lit(most))), F.lit("..."))).otherwise(flat)


def xml_escape(text: Column | str) -> Column:
    out = lit_or(text)
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def slug(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(lit_or(text), "[^A-Za-z0-9]+", "-")), "^-+|-+$", "")


def key_fragment(text: Column | str) -> Column:
    """Lower-cased letters and digits of any script, other runs as one underscore."""
    return F.regexp_replace(F.lower(F.regexp_replace(lit_or(text), f"[^{_ALNUM}]+", "_")), "^_+|_+$", "")


# How shared knowledge speaks of its contributor.
FIRST_PERSON = {
    "i": "the contributor", "me": "the contributor", "my": "the contributor's", "mine": "the contributor's",
    "we": "the organization", "us": "the organization", "our": "the organization's", "ours": "the organization's",
}


def neutralise_first_person(text: Column | str) -> Column:
    """Words of ``FIRST_PERSON`` replaced, their punctuation kept."""
    table = F.create_map(*[F.lit(x) for pair in FIRST_PERSON.items() for x in pair])

    def one(token: Column) -> Column:
        core = F.regexp_extract(token, f"[{_ALNUM}](?:.*[{_ALNUM}])?", 0)
        new = F.try_element_at(table, ascii_lower(core))
        parts = F.split(token, f"[{_ALNUM}](?:.*[{_ALNUM}])?", 2)
        return F.when(new.isNotNull(), F.concat(F.get(parts, 0), new, F.get(parts, 1))).otherwise(token)

    return F.array_join(F.transform(F.split(normalise_space(text), " "), one), " ")


def first_words(text: Column | str, n: int = 6) -> Column:
    return F.array_join(F.slice(F.split(normalise_space(text), " "), 1, n), " ")


def title_prefixed(title: Column | str, summary: Column | str) -> Column:
    """``title: summary``, unless there is no title or the summary begins with it."""
    t, s = lit_or(title), lit_or(summary)
    return F.when(t.isNull() | F.startswith(ascii_lower(s), ascii_lower(t)), s).otherwise(F.concat(t, F.lit(": "), s))


def truncate_to_tokens(text: Column | str, budget: Column | int) -> Column:
    """White space folded; the longest prefix that fits the budget with its three dots. The
    count grows with the prefix, so prefixes are halved: 24 steps reach 16 million characters."""
    b = F.lit(budget) if isinstance(budget, int) else budget

    def search(t: Column) -> Column:
        dotted = lambda n: F.concat(F.rtrim(F.left(t, n)), F.lit("..."))
        start = F.struct(F.lit(0).alias("lo"), F.length(t).alias("hi"))

        def step(s: Column, _: Column) -> Column:
            mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
            fits = (s["lo"] < s["hi"]) & (count_tokens(dotted(mid)) <= b)
            hi = F.when(fits | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid - 1)
            return F.struct(F.when(fits, mid).otherwise(s["lo"]).alias("lo"), hi.alias("hi"))

        cut = F.aggregate(F.sequence(F.lit(1), F.lit(24)), start, step, lambda s: F.when(s["lo"] > 0, dotted(s["lo"])).otherwise(""))
        return F.when(b <= 0, "").when(count_tokens(t) <= b, t).otherwise(cut)

    return let(normalise_space(text), search)


def utf8_size(*texts: Column | str) -> Column:
    """Bytes a stored document is estimated at: its texts and a fixed 256."""
    return sum((F.coalesce(F.octet_length(lit_or(t)), F.lit(0)) for t in texts), F.lit(256)).cast("long")
