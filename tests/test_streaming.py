"""The streams give what the batch functions define."""

import time

from pyspark.sql import functions as F

from mnemospark.operators import ingest
from mnemospark.streaming import jobs

SF = "/root/testdata/sf0.001"


def drained(spark, out, name, check, rows):
    """What the stream emits until it has ``rows`` rows. Processing-time state asks for empty
    batches for ever, so the query is polled and stopped."""
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(check)).start()
    try:
        ends = time.time() + 60
        while time.time() < ends and spark.table(name).count() < rows and q.exception() is None:
            time.sleep(0.5)
        assert q.exception() is None
        return spark.table(name).collect()
    finally:
        q.stop()


def fed(spark, tmp_path, parts=3):
    events = spark.read.parquet(f"{SF}/events.parquet").where("user_id < 6").orderBy("ts")
    rows = events.collect()
    src = tmp_path / "src"
    for n in range(parts):
        chunk = rows[n * len(rows) // parts : (n + 1) * len(rows) // parts]
        spark.createDataFrame(chunk, events.schema).coalesce(1).write.mode("append").parquet(str(src))
    return events, str(src)


def test_sliding_duplicates(spark, tmp_path):
    events, src = fed(spark, tmp_path, 1)
    stream = jobs.event_stream(spark, src, events.schema)
    out = jobs.sliding_duplicates(stream, ["user_id", "event_type"], "ts", "event_id", 24 * 3600)
    got = {r.event_id: r.duplicate for r in drained(spark, out, "dups", tmp_path / "c", events.count())}
    want = {r.event_id: r.duplicate for r in ingest.sliding_duplicates(events, ["user_id", "event_type"], "ts", 24 * 3600).collect()}
    assert got == want and any(got.values())


def test_consolidation_writes_each_batch_once(spark, tmp_path):
    events, src = fed(spark, tmp_path)
    stream = jobs.event_stream(spark, src, events.schema).withColumns({"malformed": F.col("event_id") % 17 == 0, "attempts": F.lit(0)})
    out, dead, check = (str(tmp_path / x) for x in ("out", "dead", "check"))
    for _ in range(2):  # the second start finds nothing new
        jobs.consolidate(stream, lambda df: df.select("event_id"), out, dead, check).awaitTermination()
    good, bad = spark.read.parquet(out), spark.read.parquet(dead)
    assert good.count() + bad.count() == events.count() and good.where("event_id % 17 = 0").count() == 0


def test_reflection_markers(spark, tmp_path):
    events, src = fed(spark, tmp_path, 1)
    stream = jobs.event_stream(spark, src, events.schema).withColumn("tokens", F.lit(10))
    out = jobs.reflection_markers(stream, "user_id", "tokens")
    counts = {r.user_id: r["count"] for r in events.groupBy("user_id").count().collect()}
    due = sum(n >= 8 for n in counts.values())
    got = {r.user_id: (r.units, r.tokens) for r in drained(spark, out, "marks", tmp_path / "c", due)}
    assert got == {u: (n, 10 * n) for u, n in counts.items() if n >= 8}
