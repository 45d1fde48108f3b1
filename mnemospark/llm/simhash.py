"""SimHash near-duplicates through a positional byte index with count filtering.

Two 64-bit fingerprints that differ in at most 4 bits agree in at least 4 of their 8 bytes
(each differing bit spoils one byte), so 4 equal positional bytes is the guaranteed minimum a
linked pair reaches. Lists of one positional byte would hold 1/256 of the corpus each; the
index therefore keys on *triples* of positional bytes, 20 of them chosen so that every set of
4 positions contains a triple (a Turan system): a pair with 4 common bytes meets in some list.
Within a list the common bytes of each pair are tallied, pairs below 4 are dropped, and the
rest are verified by their Hamming distance.

Lists longer than ``LIST_BLOCK`` are cut into blocks and every pair of blocks becomes its own
group, so no task holds an unbounded list and no pair is lost. Links leave a group as a
spanning forest, never as all pairs.

Nulls: a null text counts as empty (fingerprint zero, linked like any other); rows with a null
id keep their fingerprint and take the class of equal fingerprints, but never name a class
(null where no row of the fingerprint has an id). Repeated rows stay. Other columns of the input
are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.components import connected_components
from ..functions.shared import written
from .batches import pieces, send_small

SHINGLE_WORDS = 4
HASH_SEED = 42
MAX_BITS = 4
MIN_BYTES = 8 - MAX_BITS
LIST_BLOCK = 2048
HOT_SHARE = 1000


def covering_triples() -> list[tuple[int, int, int]]:
    """20 triples of byte positions, one inside every 4 positions: with the positions in
    three cyclic groups, those in one group, or two in a group and one in the next."""
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    kept = []
    for t in combinations(range(8), 3):
        g = sorted(group[i] for i in t)
        if g[0] == g[2] or (g[0] == g[1] and (g[0] + 1) % 3 == g[2]) or (g[1] == g[2] and (g[1] + 1) % 3 == g[0]):
            kept.append(t)
    return kept


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash over lower-cased (A-Z) word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(joined, HASH_SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -SHINGLE_WORDS]))
    digest = xxhash.xxh64_intdigest
    cuts = zip(starts.tolist(), (ends[SHINGLE_WORDS - 1 :] - 1).tolist())
    hashes = np.array([digest(joined[s:e], HASH_SEED) for s, e in cuts], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_bits = bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for batch in pieces(batches):
        fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"]
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` per row; ``fp`` is the fingerprint as a signed long."""
    send_small(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, f"id {kind}, fp long")


def _postings(fps: DataFrame) -> DataFrame:
    """One row per fingerprint and triple: ``key`` holds the triple's number and bytes."""
    at = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))
    keys = [
        F.lit(n << 24) + at(i) * (1 << 16) + at(j) * (1 << 8) + at(k)
        for n, (i, j, k) in enumerate(covering_triples())
    ]
    return fps.select("fp", "rep", F.explode(F.array(*keys)).alias("key"))


def _links(batches):
    """Spanning forests of the verified links inside each group of equal (key, i, j)."""
    held = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in (batch.column(k) for k in range(4))]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        new = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
        if len(new):
            cut = new[-1] + 1  # the last group may go on in the next batch
            yield _forest(*[x[:cut] for x in held])
            held = [x[cut:] for x in held]
    if held is not None:
        yield _forest(*held)


def _forest(key, pair, fp, rep):
    parent = np.arange(len(key))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found, lag, left = [], 1, np.arange(len(key))
    while True:
        left = left[left + lag < len(key)]
        left = left[(key[left] == key[left + lag]) & (pair[left] == pair[left + lag])]
        if not len(left):
            break
        other = left + lag
        x = (fp[left] ^ fp[other]).view(np.uint64)
        common = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        linked = (common >= MIN_BYTES) & (np.bitwise_count(x) <= MAX_BITS) & (parent[left] != parent[other])
        for i, j in zip(left[linked].tolist(), other[linked].tolist()):
            a, b = sorted((root(i), root(j)))
            if a != b:
                parent[b] = a
                found.append((rep[i], rep[j]))
        if linked.any():  # flat again, so that the next lag skips what is connected
            while (parent[parent] != parent).any():
                parent[:] = parent[parent]
        lag += 1
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(reps: DataFrame, block: int = LIST_BLOCK) -> DataFrame:
    """Links ``(a, b)`` between representatives that connect exactly what all links within
    ``MAX_BITS`` connect. ``reps``: distinct ``fp`` with their ``rep`` id (long)."""
    posts = _postings(reps)
    long_lists = posts.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    long_lists = written(long_lists, "long-lists")
    if long_lists.isEmpty():
        rows = posts.select("key", F.lit(0).alias("pair"), "fp", "rep")
    else:
        n = F.ceil(F.col("n") / (block // 2)).cast("int")
        own = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
        every = F.sequence(F.lit(0), F.col("m") - 1)
        pairs = F.transform(every, lambda j: F.least("own", j) * F.col("m") + F.greatest("own", j))
        posts = posts.join(long_lists, "key", "left").withColumn("m", F.coalesce(n, F.lit(1)))
        rows = posts.withColumn("own", own).select("key", F.explode(pairs).alias("pair"), "fp", "rep")
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "key", "pair").sortWithinPartitions("key", "pair")
    return rows.mapInArrow(_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row.

    ``fingerprint`` is 16 hex digits; ``component_id`` the smallest id reachable over links of
    at most 4 differing bits, the row itself included. Ids must be integers.
    """
    fps = written(fingerprints(docs, id_col, text_col), "fps")
    return _classes(fps).select(F.col("id").alias("doc_id"), _hexed("fp"), "component_id")


def _hexed(fp: str):
    return F.lpad(F.lower(F.hex(fp)), 16, "0").alias("fingerprint")


def _classes(fps: DataFrame) -> DataFrame:
    """``(id, fp, component_id)`` of every row of the written table ``fps``."""
    reps = fps.groupBy("fp").agg(F.min("id").cast("long").alias("rep"), F.count("*").alias("rows"))
    reps = written(reps, "reps")
    found = links(reps.where("rep is not null"))
    labels = connected_components(found, "a", "b").withColumnRenamed("node", "rep")
    classes = reps.join(labels, "rep", "left").select("fp", "rows", F.coalesce("component", "rep").alias("component_id"))
    classes = written(classes, "classes")
    # fingerprints of more than a thousandth of all rows, a thousand at most, meet their rows by broadcast
    many = F.col("rows") > reps.agg(F.sum("rows")).first()[0] // HOT_SHARE if not reps.isEmpty() else F.lit(False)
    hot = F.broadcast(classes.where(many).drop("rows"))
    rest = fps.join(hot, "fp", "left_anti").join(classes.where(~many).drop("rows"), "fp")
    return fps.join(hot, "fp").unionByName(rest)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one per class, that of its smallest id (rows without an
    id come last; among rows of one id the least fingerprint, then the least text)."""
    fps = written(fingerprints(docs, id_col, text_col), "fps")
    found = written(_classes(fps), "row-classes")
    kept = found.where("id = component_id").groupBy(F.col("id").alias(id_col)).count()
    kept = written(kept, "kept")
    if kept.where("count > 1").isEmpty() and found.where("id is null").isEmpty():
        return docs.join(kept, id_col, "left_semi").select(*docs.columns)
    # an id names no single row here: the rows themselves are compared
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).select(F.struct(*names).alias("row"), F.col(names[docs.columns.index(id_col)]).alias("id"), F.col(names[docs.columns.index(text_col)]).alias("text"))
    schema = f"{rows.schema.simpleString()[7:-1]}, fp long"

    def signed(batches):
        for batch in pieces(batches):
            fps = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], names=[*batch.schema.names, "fp"])

    rows = rows.withColumn("text", F.col("text").cast("string")).mapInArrow(signed, schema)
    classes = found.groupBy("fp").agg(F.min("component_id").alias("component_id"))
    rows = rows.join(classes, "fp")
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp"))]
    order = F.struct(F.col("id").isNull().alias("last"), "id", "fp", "text")
    best = rows.groupBy(*[g.alias(f"g{i}") for i, g in enumerate(group)]).agg(F.min_by("row", order).alias("row"))
    return best.select("row.*").toDF(*docs.columns)
