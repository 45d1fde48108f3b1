"""Quotation linking: replies are tied to the messages they quote.

Leading ``>`` marks give each line its quote level. Quoted lines, and quoted paragraphs (lines
of one level between blank lines or other levels), are normalised (case, white space) and
hashed; a message offers its unquoted lines, paragraphs and whole own text. A quoted passage
links to the latest earlier message of the conversation that offers it, found in one ordered
pass over equal (conversation, hash, text), never by pairing all occurrences. A message's
parent is the source of most quoted characters at its lowest linked level (ties: the later
one), or the message before it. Parents precede replies, so ``position`` is a reply order.

Nulls: a null text has no lines; a null conversation id is a conversation of its own; null
turns come first. Rows that repeat a turn are ordered by role and text; equal rows stay and
count as the same source. Blank passages are never linked. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import gapless_rank, written

_MARKS = r"^((?:[ \t]*>)+)"
_ATTRIBUTION = r"(?i)^\s*(on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"


def parsed_lines(text: Column) -> Column:
    """``array<struct<level, body, raw>>`` of a text, lines in order; ``level`` 0 is unquoted."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")

    def one(line: Column) -> Column:
        marks = F.regexp_extract(line, _MARKS, 1)
        level = F.length(F.translate(marks, " \t", ""))
        body = F.when(level > 0, F.ltrim(F.substr(line, F.length(marks) + 1))).otherwise(line)
        return F.struct(level.alias("level"), body.alias("body"), line.alias("raw"))

    return F.transform(lines, one)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\p{Z}]+", " "))


def unquoted(lines: Column) -> Column:
    """The own text: unquoted lines without the attribution lines that head a quotation (the
    next line is quoted, or blank and the one behind it quoted)."""

    def stays(line: Column, i: Column) -> Column:
        one, two = F.get(lines, i + 1), F.get(lines, i + 2)
        heads = (one["level"] > 0) | (F.trim(one["body"]) == "") & (two["level"] > 0)
        heads = F.rlike(line["body"], F.lit(_ATTRIBUTION)) & F.coalesce(heads, F.lit(False))
        return (line["level"] == 0) & ~heads

    joined = F.array_join(F.transform(F.filter(lines, stays), lambda x: x["body"]), "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"^\s+|\s+$", ""), r"\n{3,}", "\n\n")


def _passages(messages: DataFrame) -> DataFrame:
    """``(conv, rank, level, block, at, passage)``: lines, paragraphs (``at`` null), and whole
    texts (level 0, ``block`` null)."""
    rows = messages.select("conv", "rank", "own", F.posexplode("lines").alias("at", "line"))
    rows = rows.select("conv", "rank", "at", "line.level", normalised(F.col("line.body")).alias("passage"))
    in_text = Window.partitionBy("rank").orderBy("at")
    new = (F.col("passage") == "") | (F.col("level") != F.lag("level", 1, -1).over(in_text))
    rows = rows.withColumn("block", F.sum(new.cast("int")).over(in_text)).where("passage <> ''")
    blocks = rows.groupBy("conv", "rank", "level", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "passage"))), lambda x: x["passage"]), " ").alias("passage")
    )  # one block is part of one message, so it's no larger than a text
    none = F.lit(None).cast("int")
    whole = messages.select("conv", "rank", F.lit(0).alias("level"), none.alias("block"), none.alias("at"), normalised(F.col("own")).alias("passage"))
    cols = ["conv", "rank", "level", "block", "at", "passage"]
    return rows.select(cols).union(blocks.withColumn("at", none).select(cols)).union(whole.where("passage <> ''"))


def link_quotes(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Messages ``(conv_id, position, turn, role, body, parent_position, quoted_chars, n_quotes,
    unlinked)`` in reply order without quotes, and links ``(conv_id, position, level, passage,
    source_position)``. ``unlinked``: the quoted lines, as they stand, that no earlier message
    offers, alone or in their paragraph (code behind a ``>>>`` prompt, quotations from elsewhere)."""
    rows = messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    order = [F.col(c).asc() for c in ("conv", "turn", "role", "text")]
    ranked = gapless_rank(rows, order)
    starts = ranked.groupBy("conv").agg(F.min("rank").alias("start"))
    ranked = ranked.join(starts.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    lines = parsed_lines(F.col("text"))
    ranked = ranked.withColumn("lines", lines).withColumn("own", unquoted(F.col("lines"))).drop("text")
    ranked = written(ranked, "messages")

    passages = _passages(ranked)
    key = [F.xxhash64("passage"), F.col("passage"), F.col("conv")]
    offered = F.last(F.when(F.col("level") == 0, F.col("rank")), ignorenulls=True)
    # a message doesn't quote itself: frames by rank end before its own
    before = Window.partitionBy(*key).orderBy("rank").rangeBetween(Window.unboundedPreceding, -1)
    quoted = passages.withColumn("source", offered.over(before)).where("level > 0")
    quoted = written(quoted, "quoted")
    links = quoted.where("source is not null").select("conv", "rank", "level", "passage", "source").distinct()
    links = written(links, "quote-links")
    by_block = quoted.groupBy("rank", "block").agg(
        F.max(F.when(F.col("at").isNull(), F.col("source"))).alias("whole"),
        F.collect_list(F.when(F.col("source").isNull(), F.col("at"))).alias("at"),
    )  # of the lines of one message
    lost = by_block.where("whole is null").groupBy("rank").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("lost"))

    weight = links.groupBy("rank", "level", "source").agg(F.sum(F.length("passage")).alias("chars"))
    best = weight.groupBy("rank").agg(F.min(F.struct("level", -F.col("chars"), -F.col("source"))).alias("b"), F.sum("chars").alias("quoted_chars"))
    best = best.select("rank", (-F.col("b.col3")).alias("source"), "quoted_chars")
    counts = links.groupBy("rank").agg(F.count("*").alias("n_quotes"))
    position = F.col("rank") - F.col("start")
    parent = F.coalesce(F.col("source") - F.col("start"), F.when(position > 0, position - 1))
    shown_lines = F.transform(F.coalesce("lost", F.array().cast("array<int>")), lambda i: F.get("lines", i)["raw"])
    out = ranked.join(best, "rank", "left").join(counts, "rank", "left").join(lost, "rank", "left").select(
        F.col("conv").alias("conv_id"), position.alias("position"), "turn", "role", F.col("own").alias("body"),
        parent.alias("parent_position"), F.coalesce("quoted_chars", F.lit(0)).alias("quoted_chars"),
        F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), shown_lines.alias("unlinked"),
    )
    shown = links.join(ranked.select("rank", "start"), "rank").select(
        F.col("conv").alias("conv_id"), position.alias("position"), "level", "passage", (F.col("source") - F.col("start")).alias("source_position")
    )
    return out, shown
