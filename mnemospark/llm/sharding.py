"""Sharding by jump consistent hashing: a stable key and the shard count alone decide.

No ring table is kept; growing from n to n + 1 shards moves 1 / (n + 1) of the keys, all of
them into the new shard. A null key is a key like any other (all null keys share a shard);
null texts have size 1 and checksum 0; repeated rows share a shard and get slots of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import gapless_rank

_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash (Lamping and Veach) of unsigned 64-bit keys, all at once."""
    state, now = keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    active, following = np.arange(len(keys)), np.zeros(len(keys), np.int64)
    while len(active):
        now[active] = following[active]
        state[active] = state[active] * _STEP + np.uint64(1)
        draw = ((state[active] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        following[active] = ((now[active] + 1) * (2.0**31 / draw)).astype(np.int64)
        active = active[following[active] < shards]
    return now


def jump_hash(key: Column, shards: int) -> Column:
    """Shard (0 to ``shards - 1``) of any stable key, through its XXH64."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def place(hashes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in hashes:
            yield pd.Series(jump(x.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return place(F.xxhash64(key))


def shard(
    docs: DataFrame, shards: int, key_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(key, size, text_crc32, shard, slot, grown_shard)``: ``grown_shard`` is the place with
    one more shard; ``slot`` counts the rows of a shard from 0, by key."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    rows = rows.withColumns({"shard": jump_hash(F.col(key_col), shards), "grown_shard": jump_hash(F.col(key_col), shards + 1)})
    order = [F.col("shard").asc(), F.col(key_col).asc(), F.col("text_crc32").asc(), F.col("size").asc()]
    ranked = gapless_rank(rows, order, "slot")
    sizes = {r["shard"]: r["n"] for r in ranked.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    starts = F.array(*[F.lit(sum(sizes.get(k, 0) for k in range(s))).cast("long") for s in range(shards)])
    return ranked.withColumn("slot", F.col("slot") - F.get(starts, F.col("shard")))
