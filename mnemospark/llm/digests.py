"""Canonical exact digests of whole texts.

A text is brought to Unicode form NFKC, case-folded, and its runs of white space become one
space each; two 64-bit xxhashes of the result make the digest. Texts of equal digests are then
compared byte by byte: should different ones share a digest, all but the first (in byte
order) get an ordinal behind it, so that equal fingerprints mean equal canonical texts.

Only buckets of two or more rows are compared, by the least and greatest text of the bucket,
which aggregate before any shuffle: a third of all rows may be one text. Nulls count as empty
texts, which share a fingerprint; repeated rows each get a row; other columns stay as asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import written

BROADCAST_ROWS = 2_000_000  # digests of 16 bytes


def _icu(cls: str, method: str, text: Column, flag: bool) -> Column:
    return F.reflect(F.lit(f"com.ibm.icu.{cls}"), F.lit(method), text, F.lit(flag))


def canonical(text: Column) -> Column:
    """NFKC, case folding and white-space folding; ASCII texts need no normaliser."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    composed = _icu("text.Normalizer", "compose", text, True)
    folded = _icu("text.Normalizer", "compose", _icu("lang.UCharacter", "foldCase", composed, True), True)
    ascii_only = F.octet_length(text) == F.char_length(text)
    folded = F.when(ascii_only, F.lower(text)).otherwise(folded)
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}]+", " "))


def digest(canon: Column, bits: int = 128) -> list[Column]:
    """``h1`` and ``h2``; fewer ``bits`` than 128 are for tests of colliding digests."""
    keep = (1 << bits) - 1
    halves = [F.xxhash64(canon), F.xxhash64(F.lit("second half"), canon)]
    masks = [keep & (1 << 64) - 1, keep >> 64]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return [h.bitwiseAND(F.lit(m)).alias(n) for h, m, n in zip(halves, signed, ("h1", "h2"))]


def fingerprints(texts: DataFrame, keep: list[str], text_col: str = "text", bits: int = 128) -> DataFrame:
    """Columns ``keep`` of each row and its ``fingerprint`` (32 hex digits; a hyphen and an
    ordinal follow where different texts share them). ``texts`` is read up to three times."""
    canon = canonical(F.col(text_col))
    bare = texts.select(*keep, canon.alias("_canon")).select(*keep, "_canon", *digest(F.col("_canon"), bits))
    hashed = written(bare.drop("_canon"), "digests")
    shared = written(hashed.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "shared")
    small = shared.count() <= BROADCAST_ROWS
    suspects = bare.select("h1", "h2", "_canon").join(F.broadcast(shared) if small else shared, ["h1", "h2"], "left_semi")
    ends = suspects.groupBy("h1", "h2").agg(F.min("_canon").alias("a"), F.max("_canon").alias("z"))
    clashes = written(ends.where("a <> z").select("h1", "h2"), "clashes")
    wide = F.lower(F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0")))
    if clashes.isEmpty():
        return hashed.select(*keep, wide.alias("fingerprint"))
    apart = suspects.join(clashes, ["h1", "h2"], "left_semi").distinct()
    order = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("_canon")) - 1
    apart = apart.withColumn("nth", order)
    suffix = F.when(F.col("nth") > 0, F.concat(F.lit("-"), F.col("nth").cast("string"))).otherwise("")
    return bare.join(apart, ["h1", "h2", "_canon"], "left").select(*keep, F.concat(wide, suffix).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """1.0 if two fingerprints are equal, else 0.0: an exact digest has no degrees."""
    return F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))
