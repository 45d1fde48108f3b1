"""Queues between ingest and search: pending events, ordered commits, publishing, the recent
overlay's bound, index commits and buffered edges. Each is a batch form over marker tables, so a
streaming job runs it per micro-batch and a repeated batch changes nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import small, written

OVERLAY_BYTES = 128 << 20
COMMIT_DOCS, COMMIT_BYTES = 2000, 32 << 20
FLUSH_EDGES, FLUSH_SECONDS = 100, 5
BLOCK_EDGES, MOST_BLOCKS = 100_000, 1000  # of one buffer: more edges are cut by time into blocks
RANGE_FLUSHES = 10_000  # whose writes are looked through in order
_STEP = 32


def pending(events: DataFrame, done: DataFrame) -> DataFrame:
    """Events that no mark in ``done`` (ids) closes; an event that comes twice waits once."""
    return events.join(done.select("id"), "id", "left_anti").dropDuplicates(["id"])


def active_users(waiting: DataFrame) -> DataFrame:
    """Users with waiting events, how many, and since when."""
    return waiting.groupBy("user_id").agg(F.count("*").alias("waiting"), F.min("transaction_time").alias("since"))


def committable(packs: DataFrame, key: list[str]) -> DataFrame:
    """Packs that may be committed now: within a key those before the first that isn't ``ok``,
    so that packs are never committed out of the order of ``seq_no``."""
    stop = packs.where(~F.coalesce(F.col("ok"), F.lit(False))).groupBy(*key).agg(F.min("seq_no").alias("_stop"))
    rows = packs.join(stop, key, "left")
    return rows.where(F.col("_stop").isNull() | (F.col("seq_no") < F.col("_stop"))).drop("_stop")


def publishable_now(jobs: DataFrame, published: DataFrame, as_of: Column) -> DataFrame:
    """Due jobs with a vector whose unit isn't published, one a unit: publishing again, after a
    failure between the two writes, adds nothing. ``jobs``: id, due_at, status, embedding."""
    due = jobs.where((F.col("due_at") <= as_of) & (F.col("status") != "Failed") & (F.size("embedding") > 0))
    first = due.groupBy("id").agg(F.min("due_at").alias("due_at"))
    return first.join(published.select("id"), "id", "left_anti")


def hooks_due(published: DataFrame, marks: DataFrame) -> DataFrame:
    """Published units whose hooks have not run: each unit's run once, then a mark is written."""
    return published.select("id").distinct().join(marks.select("id"), "id", "left_anti")


def overlay_within(recent: DataFrame, at: str, size: str, most: int = OVERLAY_BYTES) -> DataFrame:
    """The newest rows whose sizes add up to at most ``most``: the oldest leave first. Sizes are
    summed by second, and a recent row is younger than the overlay's age limit, so the sum that
    finds the last second has few rows; only that second's rows are ordered."""
    second = F.date_trunc("second", at)
    by_second = recent.groupBy(second.alias("s")).agg(F.sum(size).alias("bytes"))
    newest = Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    by_second = by_second.withColumn("after", F.sum("bytes").over(newest) - F.col("bytes")).where(F.col("after") <= most)
    rows = recent.join(F.broadcast(by_second), second == F.col("s"))
    inside = Window.partitionBy("s").orderBy(F.desc(at), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    split = F.col("after") + F.col("bytes") > most
    whole = rows.where(~split)
    part = rows.where(split).withColumn("_used", F.col("after") + F.sum(size).over(inside)).where(F.col("_used") <= most)
    return whole.select(*recent.columns).unionByName(part.select(*recent.columns))


def commit_due(docs: Column, size: Column, idle_s: Column, least_s: int = 1, most_s: int = 5) -> Column:
    """Whether an index with uncommitted ``docs`` of ``size`` bytes commits ``idle_s`` seconds
    after its last commit: not before ``least_s``, then when it is full or ``most_s`` are over."""
    full = (docs >= COMMIT_DOCS) | (size >= COMMIT_BYTES) | (idle_s >= most_s)
    return (docs > 0) & (idle_s >= least_s) & full


def flushes(edges: DataFrame, by: str, at: str, most: int = FLUSH_EDGES, seconds: int = FLUSH_SECONDS) -> DataFrame:
    """Add ``flush``: the number of the write that an edge leaves its buffer with. A buffer is
    written when it holds ``most`` edges, or before an edge that comes ``seconds`` after its first;
    edges without a time come last. Each buffer's edges stream past in order; nothing gathers
    them. One of more than ``BLOCK_EDGES`` is cut by time into blocks that run side by side, each
    from the state that the blocks before leave (see ``_states``)."""
    cols = edges.withColumn("_at", F.unix_micros(F.col(at).cast("timestamp")))
    largest = cols.groupBy(by).count().agg(F.max("count").alias("n")).first().n or 0
    state = ["_number", "_count", "_since"]
    if largest > BLOCK_EDGES:
        cols, blocks = _in_blocks(cols, by, largest)
        cols = cols.join(F.broadcast(_states(blocks, by, most, seconds)), [by, "_block"], "left").select(*edges.columns, "_at", "_block", *state)
    else:
        cols = cols.withColumns({"_block": F.lit(0)} | {c: F.lit(None).cast("long") for c in state})
    places = [cols.columns.index(c) for c in (by, "_block", "_at", *state)]

    def fold(batches):
        now, number, count, since = object(), 0, 0, 0
        for batch in batches:
            out = []
            for who, block, when, *before in zip(*[batch.column(p).to_pylist() for p in places]):
                if (who, block) != now:
                    now, (number, count, since) = (who, block), (0, 0, when) if before[0] is None else before
                if count >= most or _over(when, since, seconds):
                    number, count, since = number + 1, 0, when
                out.append(number)
                count += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "flush"])

    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [c for c in ("source_id", "target_id") if c in cols.columns]
    rows = cols.repartition(parts, by, "_block").sortWithinPartitions(by, "_block", F.asc_nulls_last("_at"), *order)
    return rows.mapInArrow(fold, cols.withColumn("flush", F.lit(0).cast("long")).schema).drop("_at", "_block", *state)


def _over(when: int | None, since: int | None, seconds: int) -> bool:
    return when is not None and since is not None and when - since >= seconds * 1_000_000


def _in_blocks(cols: DataFrame, by: str, largest: int) -> tuple[DataFrame, DataFrame]:
    """``cols`` with ``_block``, numbered by time within a buffer: of about ``BLOCK_EDGES`` edges,
    or a thousandth of the largest buffer; edges of one time share a block. Then ``(by, _block,
    _at)`` of the buffers that were cut; others, and one without a name, are block 0."""
    parts = min(MOST_BLOCKS, -(-largest // BLOCK_EDGES))
    large = written(cols.groupBy(by).agg(F.count("*").alias("_n")).where((F.col("_n") > BLOCK_EDGES) & F.col(by).isNotNull()), "large-buffers")
    bounds = F.percentile_approx("_at", [i / parts for i in range(1, parts)], 10_000)
    bounds = cols.select(by, "_at").join(F.broadcast(large), by).groupBy(by).agg(F.first("_n").alias("_n"), bounds.alias("_b"))
    # a buffer smaller than the largest takes fewer of the bounds
    step = F.greatest(F.lit(1), F.floor(F.lit(parts * BLOCK_EDGES) / F.col("_n"))).cast("int")
    kept = F.array_distinct(F.filter("_b", lambda x, i: (i + 1) % step == 0))
    ranges = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_b") - 1, F.lit(0)), F.lit(_STEP)), lambda i: F.slice("_b", i + 1, _STEP))
    bounds = bounds.withColumn("_b", F.coalesce(kept, F.array().cast("array<bigint>"))).withColumn("_b", ranges)
    bounds = written(bounds.select(by, "_b", F.transform("_b", lambda x: F.get(x, 0)).alias("_heads")), "buffer-bounds")
    rows = cols.join(F.broadcast(bounds), by, "left")
    at_or_below = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("_at")))
    rows = rows.withColumn("_coarse", F.when(F.col("_at").isNull(), F.size("_heads")).otherwise(at_or_below(F.col("_heads"))))
    last = F.get("_b", F.col("_coarse") - 1)
    fine = F.when(F.col("_at").isNull(), F.size(last)).otherwise(at_or_below(last))
    block = F.when(F.col("_coarse") > 0, (F.col("_coarse") - 1) * _STEP + fine).otherwise(0)
    rows = rows.withColumn("_block", block)
    return rows.drop("_b", "_heads", "_coarse"), rows.where("_b is not null").select(by, "_block", "_at")


def _states(blocks: DataFrame, by: str, most: int, seconds: int) -> DataFrame:
    """``(by, _block, _number, _count, _since)``: the flush a buffer is at when a block begins, how
    many edges it holds and the time of its first. Which edge begins the next flush depends on the
    one that begins this alone, and a block's first beginning is among its first ``most`` edges: each
    block tells where each of these leads, then one short walk a buffer goes from block to block."""
    kind = blocks.schema[by].dataType.simpleString()

    def summary(table: pa.Table) -> pa.Table:
        at = sorted(x for x in table.column("_at").to_pylist() if x is not None)
        timed, n = len(at), table.num_rows
        later = np.searchsorted(np.array(at, np.int64), np.array(at, np.int64) + seconds * 1_000_000).tolist()
        at += [None] * (n - timed)
        flushes, last = [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            to = min(i + most, later[i] if i < timed and later[i] < timed else n)
            flushes[i], last[i] = (flushes[to] + 1, last[to]) if to < n else (1, i)
        first = range(min(most, n))
        row = {
            by: table.column(by)[:1], "_block": table.column("_block")[:1], "n": pa.array([n], pa.int64()), "head": pa.array([at[:most]], pa.list_(pa.int64())),
            "flushes": pa.array([[flushes[i] for i in first]], pa.list_(pa.int64())), "held": pa.array([[n - last[i] for i in first]], pa.list_(pa.int64())),
            "since": pa.array([[at[last[i]] for i in first]], pa.list_(pa.int64())),
        }
        return pa.table(row)

    def walk(table: pa.Table) -> pa.Table:
        number, count, since, out = -1, most, None, []
        for b in sorted(table.to_pylist(), key=lambda b: b["_block"]):
            out.append({by: b[by], "_block": b["_block"], "_number": number, "_count": count, "_since": since})
            entry = next((i for i, x in enumerate(b["head"][: most - count]) if _over(x, since, seconds)), most - count)
            if entry < b["n"]:
                number, count, since = number + b["flushes"][entry], b["held"][entry], b["since"][entry]
            else:
                count += b["n"]
        names = (by, "_block", "_number", "_count", "_since")
        kinds = (table.schema.field(by).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table({c: pa.array([r[c] for r in out], t) for c, t in zip(names, kinds)})

    lists = ", ".join(f"{c} array<bigint>" for c in ("head", "flushes", "held", "since"))
    told = blocks.groupBy(by, "_block").applyInArrow(summary, f"{by} {kind}, _block int, n bigint, {lists}")
    return written(told.groupBy(by).applyInArrow(walk, f"{by} {kind}, _block int, _number bigint, _count bigint, _since bigint"), "buffer-states")


def requeued(writes: DataFrame, by: str) -> DataFrame:
    """Add ``written_with``: the flush a buffer's edges are stored by, which is the next one that
    succeeds (``ok``); null while none has. Ranges of flushes run side by side; the first that
    succeeds in a later range answers for what is left open in one."""
    rows = written(writes, "writes").withColumn("_range", F.floor(F.col("flush") / RANGE_FLUSHES))
    good = F.when(F.col("ok"), F.col("flush"))
    before = lambda *key: Window.partitionBy(by, *key[:-1]).orderBy(F.desc(key[-1]))
    firsts = rows.groupBy(by, "_range").agg(F.min(good).alias("_first"))
    after = F.min("_first").over(before("_range").rowsBetween(Window.unboundedPreceding, -1))
    firsts = firsts.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), after.alias("_after"))
    inside = F.min(good).over(before("_range", "flush").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_inside", inside).join(small(firsts), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")), "left")
    return rows.select(*writes.columns, F.coalesce("_inside", "_after").alias("written_with"))
