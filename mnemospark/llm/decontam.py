"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is in a document if at least ``THRESHOLD`` of its distinct five-word shingles are; an
item of fewer words has one shingle, its whole word sequence, which any document may hold (items
without words match nothing). Jaccard sketches cannot find a short item in a long document, so only the
item is sketched: its smallest shingle hashes, as many as its size class (a power of two)
needs for the search to be exact. An item with n shingles may miss m = n - ceil(0.8 n) of
them, so a sketch of s > m smallest hashes has at least s - m in any document that contains
the item. Documents stream their shingle hashes past the sketches, which are broadcast, in
blocks of ``BROADCAST_ROWS`` where there are more; pairs with too few hits go, the rest are
verified on the shingles themselves. No candidate is lost and none is capped.

Nulls count as empty texts. Repeated documents or items give one pair per pair of ids (a pair
holds if it does for any of its rows); null ids pair like others. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import written

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BROADCAST_ROWS = 1_000_000  # sketch rows of 24 bytes, or ids


def word_list(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; white space is U+0020 and U+0009 to U+000D."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[ \t-\r]+"), lambda w: w != "")


def _shingles(words: Column, one, size: Column) -> Column:
    """``one`` of each run of ``size`` words; none of shorter texts."""

    def cut(ws: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(ws) - size + 1), lambda i: one(F.slice(ws, i, size)))
        return F.when((F.size(ws) >= size) & (size > 0), runs).otherwise(F.slice(F.array(one(ws)), F.lit(1), F.lit(0)))

    # bound to a variable: else the words would be split again for every shingle
    return F.get(F.transform(F.array(words), cut), 0)


def _item_size(words: Column) -> Column:
    return F.least(F.size(words), F.lit(SHINGLE_WORDS))


def shingle_hashes(words: Column, size: Column) -> Column:
    return _shingles(words, F.xxhash64, size)


def shingle_texts(words: Column, size: Column) -> Column:
    """Distinct shingles, words joined by a space (words hold none)."""
    return F.array_distinct(_shingles(words, lambda w: F.array_join(w, " "), size))


def _allowed(n: Column, threshold: float) -> Column:
    return n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int")


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(item_id, hash, needed)``: the smallest hashes of each item, and how many of them any
    document that contains it must have. ``items``: ``item_id``, ``text``."""
    hashes = F.array_sort(F.array_distinct(shingle_hashes(F.col("words"), _item_size(F.col("words")))))
    sized = items.select("item_id", word_list(F.col("text")).alias("words")).select("item_id", hashes.alias("hashes"))
    n = F.size("hashes")
    largest = (F.pow(F.lit(2.0), F.floor(F.log2(n)) + 1) - 1).cast("int")  # of its size class
    sized = sized.where(n > 0).withColumn("s", F.least(n, 2 * _allowed(largest, threshold) + 2))
    sized = sized.withColumn("needed", F.col("s") - _allowed(n, threshold))
    return sized.select("item_id", "needed", F.explode(F.slice("hashes", F.lit(1), F.col("s"))).alias("hash"))


def contained(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_item, containment)`` of every pair at ``threshold`` or above."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    sketch = written(sketches(items, threshold), "sketches")
    sizes = items.select(_item_size(word_list(F.col("text"))).alias("n")).where("n > 0").distinct().collect()  # five at most
    words = F.get(F.transform(F.array(word_list(F.col("text"))), lambda w: F.concat(
        F.array().cast("array<bigint>"), *[shingle_hashes(w, F.lit(r["n"])) for r in sorted(sizes)]
    )), 0)
    seen = docs.select("doc_id", F.explode(words).alias("hash"))
    blocks = -(-sketch.count() // BROADCAST_ROWS)
    hits = seen.join(F.broadcast(sketch), "hash")
    for block in range(blocks if blocks > 1 else 0):
        part = seen.join(F.broadcast(sketch.where(F.pmod("hash", F.lit(blocks)) == block)), "hash")
        hits = hits.union(part) if block else part
    hits = hits.distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("hits"), F.min("needed").alias("needed"))
    pairs = written(hits.where("hits >= needed").select(F.col("doc_id").alias("d"), F.col("item_id").alias("i")), "pairs")

    suspects = pairs.select("d").distinct()
    if pairs.count() <= BROADCAST_ROWS:  # most documents are in no pair: only the others' texts are shuffled
        docs = docs.join(F.broadcast(suspects), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    sides = [(items, "item_id", "i", "theirs"), (docs, "doc_id", "d", "own")]
    for table, own, name, out in sides:
        words = table.select(F.col(own).alias(f"{name}_id"), F.col("text"))
        pairs = words.join(pairs, F.col(f"{name}_id").eqNullSafe(F.col(name))).drop(f"{name}_id").withColumnRenamed("text", out)
    pairs = pairs.withColumn("theirs", word_list(F.col("theirs"))).withColumn("size", _item_size(F.col("theirs")))
    pairs = pairs.withColumn("theirs", shingle_texts(F.col("theirs"), F.col("size")))
    pairs = pairs.withColumn("own", shingle_texts(word_list(F.col("own")), F.col("size")))
    shared, n = F.size(F.array_intersect("theirs", "own")), F.size("theirs")
    found = pairs.select(F.col("d").alias("doc_id"), F.col("i").alias("item_id"), shared.alias("n_shared"), n.alias("n_item"))
    found = found.where((F.col("n_item") > 0) & (F.col("n_shared") >= F.ceil(F.col("n_item") * threshold - F.lit(1e-9))))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_shared", "n_item")).alias("m"))
    return best.select(
        "doc_id", "item_id", F.col("m.n_shared"), F.col("m.n_item"), (F.col("m.n_shared") / F.col("m.n_item")).alias("containment")
    )


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item; rows whose id is null stay unless another
    row without id contains one."""
    bad = "_bad"
    while bad in docs.columns:
        bad += "_"
    leaks = contained(docs, items, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias(bad)).distinct()
    return docs.join(written(leaks, "leaks"), F.col(id_col).eqNullSafe(F.col(bad)), "left_anti")
