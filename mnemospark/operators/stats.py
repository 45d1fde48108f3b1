"""Operational rollups behind the dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def memory_aggregate(units: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts by domain and by scope and level, and their totals, in one pass."""
    local, d, level = F.col("domain").isin("agent", "user"), F.col("domain"), F.col("level")
    counts = [F.count_if(d == x).alias(x) for x in ("agent", "user", "organization")]
    for n in (1, 2, 3):
        counts += [F.count_if(local & (level == n)).alias(f"local_l{n}"), F.count_if(~local & (level == n)).alias(f"shared_l{n}")]
    out = units.groupBy(*(by or [])).agg(*counts)
    total = {f"total_l{n}": F.col(f"local_l{n}") + F.col(f"shared_l{n}") for n in (1, 2, 3)}
    return out.withColumns(total | {"total": F.col("agent") + F.col("user") + F.col("organization")})


def agent_rollup(units: DataFrame, events: DataFrame) -> DataFrame:
    """Per agent: agent-domain units by level, events, latest activity; either may be missing."""
    named = F.col("agent_id").isNotNull() & (F.col("agent_id") != "")
    u = units.where(named & (F.col("domain") == "agent")).groupBy("agent_id").agg(
        F.count("*").alias("total_memories"), F.count_if(F.col("level") == 1).alias("l1_count"), F.count_if(F.col("level") == 2).alias("l2_count"), F.max("transaction_time").alias("u_at")
    )
    e = events.where(named).groupBy("agent_id").agg(F.count("*").alias("total_events"), F.max("transaction_time").alias("e_at"))
    rows = u.join(e, "agent_id", "full_outer")
    counts = ["total_memories", "l1_count", "l2_count", "total_events"]
    return rows.select("agent_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.greatest("u_at", "e_at").alias("last_activity"))


def rollup_of(members: DataFrame, by: str, who: str, kind: str) -> DataFrame:
    """Contributor set, top contributor (most rows, then smallest id) and primary kind. Rows
    are first counted by (by, who, kind), so a hot group is few rows."""
    pre = members.groupBy(by, who, kind).agg(F.count("*").alias("n"))
    people = pre.groupBy(by, who).agg(F.sum("n").alias("n"))
    people = people.groupBy(by).agg(
        F.sum("n").alias("members"), F.array_sort(F.collect_set(who)).alias("contributors"), F.min(F.struct(-F.col("n"), F.col(who).alias("w")))["w"].alias("top_contributor")
    )
    kinds = pre.groupBy(by, kind).agg(F.sum("n").alias("n")).groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), F.col(kind).alias("kind")))).alias("ks")
    )
    shown = F.array_join(F.transform("ks", lambda x: F.concat_ws("=", x["kind"], (-x["neg"]).cast("string"))), ",")
    return people.join(kinds.select(by, shown.alias("distribution"), F.get("ks", 0)["kind"].alias("primary_kind")), by)


def status_counts(rows: DataFrame, by: list[str], status: str, names: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == s).alias(s) for s in names])


def zero_filled_hours(events: DataFrame, at: str, until: Column, hours: int) -> DataFrame:
    """Counts of the last ``hours``, empty hours as zero."""
    last = F.date_trunc("hour", until)
    spine = events.sparkSession.range(1).select(F.explode(F.sequence(F.timestamp_add("HOUR", F.lit(1 - hours), last), last, F.expr("interval 1 hour"))).alias("bucket"))
    first = F.timestamp_add("HOUR", F.lit(1 - hours), last)
    counts = events.where(F.col(at) >= first).groupBy(F.date_trunc("hour", at).alias("bucket")).agg(F.count("*").alias("n"))
    return spine.join(F.broadcast(counts), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` from 1 of at most 100 rows."""
    size = min(size, 100)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def merge_counts(parts: DataFrame, by: list[str], sums: list[str], alls: list[str] = (), latest: list[str] = ()) -> DataFrame:
    """Answers of several nodes as one: numbers add, flags hold if all hold, the largest
    sequence stays; a part without a value does not count."""
    aggs = [F.sum(c).alias(c) for c in sums] + [F.bool_and(c).alias(c) for c in alls] + [F.max(c).alias(c) for c in latest]
    return parts.groupBy(*by).agg(*aggs)


def scorecard(cases: DataFrame, by: list[str]) -> DataFrame:
    """Shares of right answers among expected facts, and the false negatives and positives, over
    all (``dimension`` and ``value`` ``all``) and by each of ``by``, in one pass. ``cases``: rows of
    ``facts.evaluate``."""
    expected = F.col("kind") == "expected"
    kinds = ("covered", "attribute_ok", "subject_ok", "change_ok", "exact")
    rates = [F.round(F.avg(F.when(expected, F.col(c).cast("double"))), 6).alias(c) for c in kinds]
    wrong = [F.count_if(expected & ~F.col("covered")).alias("false_negatives"), F.count_if(~expected).alias("false_positives")]
    whole = F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value"))
    each = F.explode(F.array(whole, *[F.struct(F.lit(x).alias("dimension"), F.col(x).alias("value")) for x in by]))
    rows = cases.select(each.alias("d"), "kind", *kinds)
    return rows.groupBy("d.dimension", "d.value").agg(F.count_if(expected).alias("n"), *rates, *wrong)
