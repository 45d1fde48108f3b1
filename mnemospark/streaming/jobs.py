"""Structured Streaming forms of the write path; the batch functions define the results.

The source is an append-only folder of events. Late data is taken whenever it comes, as the
batch definition is unbounded in lateness; ``watermark`` bounds state where a caller wants it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

MAX_RETRIES = 3


def event_stream(spark: SparkSession, path: str, schema: StructType, watermark: str | None = None, at: str = "transaction_time") -> DataFrame:
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withWatermark(at, watermark) if watermark else rows


def triage(rows: DataFrame) -> DataFrame:
    """Add ``state``: malformed rows and those out of retries go to the dead letters."""
    state = F.when(F.col("malformed"), "failed:malformed").when(F.col("attempts") + 1 >= MAX_RETRIES, "failed:retries").otherwise("pending")
    return rows.withColumn("state", state)


def consolidate(stream: DataFrame, batch: Callable[[DataFrame], DataFrame], out: str, dead: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch is triaged, failed rows go to ``dead``, the rest through ``batch`` to
    ``out``. Folders are named by batch, so a repeated batch overwrites itself: exactly once."""

    def run(df: DataFrame, epoch: int) -> None:
        df = df.persist()
        rows = triage(df)
        rows.where("state <> 'pending'").write.mode("overwrite").parquet(f"{dead}/batch={epoch}")
        batch(rows.where("state = 'pending'").drop("state")).write.mode("overwrite").parquet(f"{out}/batch={epoch}")
        df.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def sliding_duplicates(stream: DataFrame, by: list[str], at: str, event_id: str, seconds: int = 3600) -> DataFrame:
    """The stream form of ``operators.ingest.sliding_duplicates``: the state of a key is its last
    time, renewed by every occurrence and dropped when the window has passed."""
    import pandas as pd

    fields = {f.name: f.dataType.simpleString() for f in stream.schema}
    out = ", ".join(f"{c} {fields[c]}" for c in [*by, event_id]) + ", duplicate boolean"

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values([at, event_id])
        micros = rows[at].astype("datetime64[us]").astype("int64")
        flags = []
        for now in micros:
            flags.append(last is not None and now - last < seconds * 1_000_000)
            last = int(now)
        state.update((last,))
        state.setTimeoutDuration(2 * seconds * 1000)
        yield pd.DataFrame({**{c: [k] * len(rows) for c, k in zip(by, key)}, event_id: rows[event_id].to_numpy(), "duplicate": flags})

    return stream.groupBy(*by).applyInPandasWithState(fold, out, "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def reflection_markers(stream: DataFrame, by: str, tokens: str, units_from: int = 8, tokens_from: int = 2000, age_ms: int = 6 * 3600 * 1000) -> DataFrame:
    """A row for each key whose pending units, tokens or age call for reflection; the state is
    the pending sums, emptied when they are emitted."""
    import pandas as pd

    fields = {f.name: f.dataType.simpleString() for f in stream.schema}

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        units, total = state.get if state.exists else (0, 0)
        if not state.hasTimedOut:
            for f in frames:
                units, total = units + len(f), total + int(f[tokens].sum())
        if state.hasTimedOut or units >= units_from or total >= tokens_from:
            if state.exists:
                state.remove()
            if units:
                yield pd.DataFrame({by: [key[0]], "units": [units], "tokens": [total]})
        else:
            if not state.exists:
                state.setTimeoutDuration(age_ms)
            state.update((units, total))

    return stream.groupBy(by).applyInPandasWithState(fold, f"{by} {fields[by]}, units long, tokens long", "units long, tokens long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def hourly_counts(stream: DataFrame, at: str, watermark: str = "2 hours") -> DataFrame:
    """Tumbling hours by kind, final once the watermark has passed."""
    return stream.withWatermark(at, watermark).groupBy(F.window(at, "1 hour"), "event_type").agg(F.count("*").alias("n"))
