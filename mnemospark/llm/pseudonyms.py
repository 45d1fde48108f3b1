"""Format-preserving pseudonyms by keyed Feistel permutations.

Personal values are found by one pattern, validated, and permuted within their own format by
an alternating Feistel network whose round function is a keyed SHA-256: a payment card keeps
its length and its Luhn check holds, a date stays a date of the same notation, an IPv4
address stays one, a telephone number keeps its country code and punctuation, an IBAN its
country and valid check digits, an e-mail address its domain, a credential its character
classes. Each permutation is a bijection of its format, so equal values stay linked across
documents and different ones stay apart; nothing is looked up or joined.

A card is sought in every run of whole digit groups of a match, an IBAN at the length of its
country; what stands beside them stays text. A telephone number's country code is split from its
digits by the plan of country codes, so punctuation doesn't change which number it becomes. Dates
are year, month, day or day, month, year.

What fails validation (a card by Luhn, a date by the calendar, an address by its octets, an IBAN
by its remainder) stays as it is, as do dates outside 1900-01-01 to 2101-01-25, dates that are
valid only as month, day, year, and telephone numbers without a country code. A null text stays
null; empty texts stay empty; repeated rows are alike; other columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_DAYS = (270, 272)  # the date domain's two halves: 73,440 days from 1900-01-01

_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
_CREDENTIAL = r"""(?<![A-Za-z0-9_])(?i:password|passwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}["']?[A-Za-z0-9_/+-]{6,}+"""
_ACCESS_KEY = r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])"
_IBAN_ANY = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
#: Countries by the length of their IBANs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
_SIZED = "|".join(
    f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    for n, c in IBAN_LENGTHS.items()
)
# words behind an IBAN of its country's length stay outside
_IBAN = rf"(?<![A-Za-z0-9])(?:{_SIZED})(?![A-Za-z0-9])|{_IBAN_ANY}"
_IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
_ISO_DATE = r"(?<![0-9A-Za-z])[0-9]{4}(?:-[0-9]{2}-|/[0-9]{2}/)[0-9]{2}(?![0-9])"
_DAY_DATE = r"(?<![0-9A-Za-z])[0-9]{2}[./][0-9]{2}[./][0-9]{4}(?![0-9])"
_PHONE = r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
_SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
_CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
#: Country codes of one, two and three digits, as the international numbering plan has them.
_COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: In this order: the first kind whose pattern fits a value whole names it.
KINDS = {
    "email": _EMAIL, "credential": _CREDENTIAL, "access_key": _ACCESS_KEY, "iban": _IBAN, "ip": _IP,
    "iso_date": _ISO_DATE, "day_date": _DAY_DATE, "phone": _PHONE, "ssn": _SSN, "card": _CARD,
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())


def _draw(key: str, tweak: str, turn: Column, other: Column, size: Column | int) -> Column:
    """A number below ``size`` from the keyed hash of the other half (60 bits of SHA-256)."""
    text = F.concat_ws("|", F.lit(key), F.lit(tweak), turn.cast("string"), other)
    wide = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")
    return F.pmod(wide, F.lit(size).cast("long") if isinstance(size, int) else size)


def permute_pair(a: Column, b: Column, sizes: tuple[int, int], key: str, tweak: str) -> Column:
    """``struct<a, b>``: a keyed permutation of all pairs below ``sizes``."""

    def step(s: Column, turn: Column) -> Column:
        left = F.pmod(s["a"] + _draw(key, tweak, turn, s["b"].cast("string"), sizes[0]), F.lit(sizes[0]).cast("long"))
        right = F.pmod(s["b"] + _draw(key, tweak, turn, s["a"].cast("string"), sizes[1]), F.lit(sizes[1]).cast("long"))
        even = turn % 2 == 0
        return F.struct(F.when(even, left).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(right).alias("b"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _shifted(half: Column, turn: Column, other: Column, key: str, tweak: str, hexadecimal: Column) -> Column:
    """Each character moved within its class (digits, capitals, small letters; the letters a
    to f of hexadecimal values) by a draw from the other half."""

    def one(c: Column, i: Column) -> Column:
        code = F.ascii(c)
        low = F.when(code < 58, 48).when(code < 91, 65).otherwise(97)
        size = F.when(code < 58, 10).when(hexadecimal, 6).otherwise(26)
        by = _draw(key, tweak, F.concat_ws(".", turn.cast("string"), i.cast("string")), other, size.cast("long"))
        return F.char(low + F.pmod(code - low + by, size))

    return F.transform(half, one)


def permute_text(value: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of the letters and digits of a short ASCII value; everything else,
    and each character's class, stays in place."""
    chars = F.split(value, "")
    is_sign = lambda c: F.rlike(c, F.lit("[A-Za-z0-9]"))
    signs = F.filter(chars, is_sign)
    hexadecimal = F.rlike(value, F.lit("^(?:[0-9]*[a-f][0-9a-f]*|[0-9]*[A-F][0-9A-F]*)$"))
    half = F.floor(F.size(signs) / 2).cast("int")
    start = F.struct(
        F.slice(signs, F.lit(1), half).alias("a"), F.slice(signs, half + 1, F.size(signs)).alias("b")
    )

    def step(s: Column, turn: Column) -> Column:
        even, a, b = turn % 2 == 0, F.array_join(s["a"], ""), F.array_join(s["b"], "")
        left = _shifted(s["a"], turn, b, key, tweak, hexadecimal)
        right = _shifted(s["b"], turn, a, key, tweak, hexadecimal)
        return F.struct(F.when(even, left).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(right).alias("b"))

    def join(s: Column) -> Column:
        new = F.concat(s["a"], s["b"])
        zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

        def put(t: Column, c: Column) -> Column:
            sign = is_sign(c)
            return F.struct(
                F.concat(t["out"], F.when(sign, F.get(new, t["n"])).otherwise(c)).alias("out"), (t["n"] + sign.cast("int")).alias("n")
            )

        return F.aggregate(chars, zero, put)["out"]

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, join)


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, its last digit counted plain."""
    each = F.transform(
        F.reverse(F.split(digits, "")),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c >= "5", 9).otherwise(0)),
    )
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _iban_rest(moved: Column) -> Column:
    """Remainder by 97 of an IBAN whose first four signs stand last, letters as 10 to 35."""
    numbers = F.transform(F.split(moved, ""), lambda c: F.conv(c, 36, 10).cast("int"))
    return F.aggregate(numbers, F.lit(0), lambda s, x: (s * F.when(x > 9, 100).otherwise(10) + x) % 97)


def _refilled(value: Column, signs: Column) -> Column:
    """``value`` with its letters and digits replaced in turn by those of ``signs``."""
    zero = F.struct(F.lit("").alias("out"), F.lit(1).alias("n"))

    def put(t: Column, c: Column) -> Column:
        sign = F.rlike(c, F.lit("[A-Za-z0-9]"))
        return F.struct(
            F.concat(t["out"], F.when(sign, F.substr(signs, t["n"], F.lit(1))).otherwise(c)).alias("out"),
            (t["n"] + sign.cast("int")).alias("n"),
        )

    return F.aggregate(F.split(value, ""), zero, put)["out"]


def _card(value: Column, key: str) -> Column:
    """Permute the first and longest run of whole digit groups that is a card; the rest stays."""
    each = F.sequence(F.lit(1), F.length(value))
    is_digit = lambda i: F.rlike(F.substr(value, i, F.lit(1)), F.lit("[0-9]"))
    starts = F.filter(each, lambda i: is_digit(i) & ((i == 1) | ~is_digit(i - 1)))
    ends = F.reverse(F.filter(each, lambda i: is_digit(i) & ((i == F.length(value)) | ~is_digit(i + 1))))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(ends, lambda j: F.struct(i.alias("i"), (j - i + 1).alias("n")))))
    runs = F.filter(runs, lambda r: r["n"] >= 13)
    bare = lambda r: F.translate(F.substr(value, r["i"], r["n"]), " -", "")
    cards = F.filter(runs, lambda r: F.length(bare(r)).between(13, 19) & (_luhn_sum(bare(r)) % 10 == 0))

    def put(r: Column) -> Column:
        new = _new_card(F.substr(value, r["i"], r["n"]), key)
        return F.concat(F.substr(value, F.lit(1), r["i"] - 1), new, F.substr(value, r["i"] + r["n"]))

    # bound to a variable: else the search would be repeated at every mention
    return F.coalesce(F.get(F.transform(F.slice(cards, F.lit(1), F.lit(1)), put), 0), value)


def _new_card(value: Column, key: str) -> Column:
    digits = F.translate(value, " -", "")
    payload = permute_text(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = F.pmod(10 - _luhn_sum(F.concat(payload, F.lit("0"))) % 10, F.lit(10)).cast("string")
    return _refilled(value, F.concat(payload, check))


def _iban(value: Column, key: str) -> Column:
    packed = F.translate(value, " ", "")
    country, account = F.substr(packed, F.lit(1), F.lit(2)), F.substr(packed, F.lit(5))
    valid = (_iban_rest(F.concat(account, F.substr(packed, F.lit(1), F.lit(4)))) == 1) & (F.length(packed) >= 15)
    new = permute_text(account, key, "iban")
    check = F.lpad((98 - _iban_rest(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(valid, _refilled(value, F.concat(country, check, new))).otherwise(value)


def _ip(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    valid = F.forall(octets, lambda x: x < 256)
    new = permute_pair(F.get(octets, 0) * 256 + F.get(octets, 1), F.get(octets, 2) * 256 + F.get(octets, 3), (65536, 65536), key, "ip")
    parts = [F.floor(new["a"] / 256), new["a"] % 256, F.floor(new["b"] / 256), new["b"] % 256]
    return F.when(valid, F.concat_ws(".", *[p.cast("string") for p in parts])).otherwise(value)


def _date(value: Column, iso: bool, key: str) -> Column:
    parts = F.split(value, "[./-]")
    y, m, d = ([F.get(parts, i) for i in (0, 1, 2)]) if iso else ([F.get(parts, i) for i in (2, 1, 0)])
    day = F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MM-dd")
    since = F.datediff(day, F.lit("1900-01-01").cast("date"))
    new = permute_pair(F.floor(since / _DAYS[1]), since % _DAYS[1], _DAYS, key, "date")
    moved = F.date_add(F.lit("1900-01-01").cast("date"), (new["a"] * _DAYS[1] + new["b"]).cast("int"))
    shown = F.date_format(moved, "yyyyMMdd" if iso else "ddMMyyyy")
    inside = F.coalesce((since >= 0) & (since < _DAYS[0] * _DAYS[1]), F.lit(False))
    return F.when(inside, _refilled(value, shown)).otherwise(value)


def _behind(value: Column, kept: str, key: str, tweak: str) -> Column:
    """Keep what ``kept`` matches at the start and permute the rest, 128 signs at a time."""
    head = F.regexp_extract(value, kept, 0)
    parts = F.regexp_extract_all(F.substr(value, F.length(head) + 1), F.lit("(?s).{1,128}"), F.lit(0))
    return F.concat(head, F.array_join(F.transform(parts, lambda x: permute_text(x, key, tweak)), ""))


def _pseudonym(value: Column, key: str) -> Column:
    whole = lambda kind: F.rlike(value, F.lit(f"^(?:{KINDS[kind]})$"))
    local = F.regexp_extract(value, "^[^@]*", 0)
    digits = F.translate(value, "+ ().-", "")
    phone = F.when(F.length(digits).between(7, 15), _refilled(value, _behind(digits, _COUNTRY, key, "phone"))).otherwise(value)
    ssn = F.when(F.rlike(value, F.lit("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)")), permute_text(value, key, "ssn")).otherwise(value)
    return (
        F.when(whole("email"), F.concat(permute_text(local, key, "email"), F.substr(value, F.length(local) + 1)))
        .when(whole("credential"), _behind(value, r"""^[A-Za-z_-]+\s*[=:]\s*["']?""", key, "credential"))
        .when(whole("access_key"), _behind(value, "^.{4}", key, "access"))
        .when(whole("iban"), _iban(value, key))
        .when(whole("ip"), _ip(value, key))
        .when(whole("iso_date"), _date(value, True, key))
        .when(whole("day_date"), _date(value, False, key))
        .when(whole("phone"), phone)
        .when(whole("ssn"), ssn)
        .otherwise(_card(value, key))
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with personal values in ``text_col`` replaced; ``count_col``, if named, is
    added with the number of values that changed (no column may have that name). ``key`` is the
    secret of all permutations."""
    if count_col in docs.columns:
        raise ValueError(f"{count_col} is a column already")
    text = F.col(text_col)

    def replaced(found: Column) -> Column:
        return F.get(F.transform(F.array(F.transform(found, lambda x: _pseudonym(x, key))), lambda new: F.struct(
            F.array_join(F.zip_with(F.split(text, PATTERN), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "").alias("text"),
            F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x)).alias("n"),
        )), 0)

    # bound to variables: values are found and permuted once, whatever is read of them
    both = F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))), replaced), 0)
    has = F.rlike(text, F.lit("[0-9@=:]"))
    both = F.when(has, both).otherwise(F.struct(text.alias("text"), F.lit(0).alias("n")))
    held = "_replaced"
    while held in docs.columns:
        held += "_"
    out = docs.withColumn(held, both)
    kept = [F.col(held)["text"].alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*kept, *([F.col(held)["n"].alias(count_col)] if count_col else []))
