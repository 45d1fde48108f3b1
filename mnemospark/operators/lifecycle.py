"""Forgetting, tasks, reflection and materialization over unit, event and task tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import LOCAL_DOMAINS
from ..functions.shared import small, written
from .ingest import backoff_seconds, within_budget

TREE_DEPTH = 10
REFLECT_UNITS, REFLECT_TOKENS, REFLECT_AGE_S = 8, 2000, 6 * 3600
BATCH_UNITS, BATCH_TOKENS = 32, 4096


def visible(units: DataFrame, tombstones: DataFrame) -> DataFrame:
    gone = tombstones.where("target_kind = 'memory_unit'").select(F.col("target_id").alias("id"))
    return units.join(gone, "id", "left_anti")


def referenced_ids(units: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Ids that visible local units of level 2 and above refer to."""
    upper = visible(units.where((F.col("level") >= 2) & F.col("domain").isin(*LOCAL_DOMAINS)), tombstones)
    return upper.select("user_id", F.explode("references").alias("id")).distinct()


def prune(units: DataFrame, tombstones: DataFrame, threshold: float) -> DataFrame:
    """Units to delete: importance below ``threshold``, unless of level 1 and referred to by
    an insight of the same user."""
    low = units.where(F.col("importance") < threshold)
    # only the few low units meet the references
    kept = referenced_ids(units, tombstones)
    shielded = low.where("level = 1").join(kept, ["user_id", "id"], "left_semi").select("id")
    return low.join(shielded, "id", "left_anti")


def forget_preview(hits: DataFrame, units: DataFrame, events: DataFrame) -> DataFrame:
    """``(kind, id)`` that a deletion of ``hits`` (ids) would touch: the units, the events they
    refer to, and other units that refer to those events."""
    refs = units.select("id", F.explode("references").alias("event_id"))
    hits = written(hits.select("id"), "forget-hits")
    sources = written(refs.join(small(hits), "id").select("event_id").distinct(), "forget-sources")
    matched = written(events.select(F.col("id").alias("event_id")).join(small(sources), "event_id", "left_semi"), "forget-events")
    also = refs.join(small(matched), "event_id", "left_semi").select("id").distinct().join(hits, "id", "left_anti")
    rows = hits.select(F.lit("unit").alias("kind"), "id")
    return rows.union(matched.select(F.lit("event"), "event_id")).union(also.select(F.lit("related_unit"), "id"))


def tombstones_for(preview: DataFrame, mode: str, reason: str) -> DataFrame:
    kind = F.when(F.col("kind") == "event", "event").otherwise("memory_unit")
    return preview.where("kind <> 'related_unit'").select(kind.alias("target_kind"), F.col("id").alias("target_id"), F.lit(mode).alias("mode"), F.lit(reason).alias("reason"))


def ready_tasks(tasks: DataFrame) -> DataFrame:
    """Pending tasks whose dependencies are all completed; a missing one blocks."""
    pending = tasks.where("status = 'Pending'")
    needs = pending.select("task_id", F.explode("dependencies").alias("need"))
    done = tasks.where("status = 'Completed'").select(F.col("task_id").alias("need"))
    blocked = needs.join(done, "need", "left_anti").select("task_id").distinct()
    return pending.join(blocked, "task_id", "left_anti")


def task_depths(tasks: DataFrame, most: int = TREE_DEPTH, roots: DataFrame | None = None) -> DataFrame:
    """``(task_id, root_id, depth)`` from the roots (``task_id``; by default the tasks without a
    parent) down, to ``most`` levels. Each level joins the children of the one before, so a level
    is read once."""
    links = tasks.where("parent_id is not null").select("task_id", "parent_id")
    level = tasks.where("parent_id is null") if roots is None else roots
    level = level.select("task_id", F.col("task_id").alias("root_id"), F.lit(0).alias("depth"))
    found = level
    for depth in range(1, most + 1):
        level = links.join(level.select(F.col("task_id").alias("parent_id"), "root_id"), "parent_id")
        level = written(level.select("task_id", "root_id", F.lit(depth).alias("depth")), "level")
        found = found.union(level)
    return found


def goal_trees(goals: DataFrame, tasks: DataFrame) -> DataFrame:
    """``(goal_id, task_id, parent_id, depth, status)``: the tasks below each goal (``goal_id``),
    those whose parent is the goal at depth 1, to ten levels; a goal without tasks is a row of
    its own with nulls. A tree is rows, so one of any size is no task's burden."""
    below = task_depths(tasks, TREE_DEPTH, goals.select(F.col("goal_id").alias("task_id"))).where("depth > 0")
    below = below.join(tasks.select("task_id", "parent_id", "status"), "task_id")
    below = below.select(F.col("root_id").alias("goal_id"), "task_id", "parent_id", "depth", "status")
    return goals.select("goal_id").join(below, "goal_id", "left")


def parent_progress(tasks: DataFrame) -> DataFrame:
    """Share of a parent's children that are completed."""
    share = F.avg(F.when(F.col("status") == "Completed", 1.0).otherwise(0.0))
    return tasks.where("parent_id is not null").groupBy("parent_id").agg(F.round(share, 6).alias("progress"), F.count("*").alias("children"))


def finished_events(tasks: DataFrame) -> DataFrame:
    """Log events that closing tasks write."""
    text = F.concat(F.lit("Task "), F.col("task_id").cast("string"), F.lit(" "), F.lower("status"))
    return tasks.where("status in ('Completed', 'Failed', 'Cancelled')").select(F.col("user_id").cast("string").alias("user_id"), text.alias("data"))


def reflection_delta(units: DataFrame, tokens: Column, by: str = "user_id") -> DataFrame:
    """What a batch of stored units adds to each user's marker. Level 1 alone counts."""
    first = F.min(F.struct("transaction_time", "id")).alias("first")
    sums = units.where("level = 1").groupBy(by).agg(F.count("*").alias("units"), F.sum(tokens).alias("tokens"), first, F.max("transaction_time").alias("last_tx"))
    return sums.select(by, "units", "tokens", F.col("first.transaction_time").alias("first_tx"), F.col("first.id").alias("first_id"), "last_tx")


def due_for_reflection(markers: DataFrame, as_of: Column) -> DataFrame:
    age = F.timestamp_diff("SECOND", F.col("first_tx"), as_of)
    return markers.where((F.col("units") >= REFLECT_UNITS) | (F.col("tokens") >= REFLECT_TOKENS) | (age >= REFLECT_AGE_S))


def reflection_batch(units: DataFrame, tokens: str, by: str = "user_id", most_units: int = BATCH_UNITS, most_tokens: int = BATCH_TOKENS) -> DataFrame:
    """The next batch of each user in (time, id) order: at most ``most_units``, the running
    tokens within ``most_tokens``, the first always."""
    order = ["transaction_time", "id"]
    w = Window.partitionBy(by).orderBy(*order)
    first = units.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most_units)
    return within_budget(first.withColumn("_t", F.greatest(F.lit(1), F.col(tokens))), "_t", most_tokens, order, [by]).drop("_t")


def reflection_scope(units: DataFrame, user: str, stream: str | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """What a reflection on one session (``stream``) or on a stretch of a user's time reads:
    level-1 units from ``start`` to before ``end``; ``reflection_batch`` cuts it into batches."""
    rows = units.where((F.col("level") == 1) & (F.col("user_id") == user))
    if stream is not None:
        rows = rows.where(F.col("stream_id") == stream)
    if start is not None:
        rows = rows.where(F.col("transaction_time") >= start)
    return rows if end is None else rows.where(F.col("transaction_time") < end)


def threshold_crossings(rows: DataFrame, by: str, order: list[str], step: int) -> DataFrame:
    """Rows at which a key's running count reaches a multiple of ``step``."""
    count = F.count("*").over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("count", count).where((F.col("count") >= step) & (F.floor((F.col("count") - 1) / step) < F.floor(F.col("count") / step)))


def due_jobs(jobs: DataFrame, as_of: Column, limit: int) -> DataFrame:
    return jobs.where((F.col("due_at") <= as_of) & (F.col("status") != "Failed")).orderBy("due_at", "job_id").limit(limit)


def rescheduled(jobs: DataFrame, as_of: Column, max_attempts: int = 3) -> DataFrame:
    """A failed attempt: later by the back-off, or failed for good."""
    tries = F.col("attempts") + 1
    later = F.timestamp_add("SECOND", backoff_seconds(tries), as_of)
    return jobs.withColumns({
        "attempts": tries, "status": F.when(tries >= max_attempts, "Failed").otherwise("Pending"), "due_at": F.when(tries < max_attempts, later),
    })


def recent_overlay(docs: DataFrame, at: str, as_of: Column, size: str, ttl_s: int = 120, per_user: int = 1000, user_bytes: int = 8 << 20) -> DataFrame:
    """Not yet indexed rows a search still sees: younger than ``ttl_s``, the newest of each
    user within the row and byte limits."""
    fresh = docs.where((F.col(at) <= as_of) & (F.timestamp_diff("SECOND", F.col(at), as_of) <= ttl_s))
    w = Window.partitionBy("user_id").orderBy(F.desc(at), F.desc("id"))
    rows = fresh.withColumns({"_n": F.row_number().over(w), "_b": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.where((F.col("_n") <= per_user) & (F.col("_b") <= user_bytes)).drop("_n", "_b")


def units_from_packs(packs: DataFrame) -> DataFrame:
    """Level-1 units of packed events where no model compresses: numbered messages, the
    events as references, procedural when an agent spoke."""
    lines = F.transform(F.array_sort("messages"), lambda x, n: F.concat(F.lit("Message "), (n + 1).cast("string"), F.lit(": "), x["data"]))
    kind = F.when(F.col("agent_id").isNotNull(), "procedural").otherwise("factual")
    refs = F.transform(F.array_sort("messages"), lambda x: x["id"])
    return packs.select("user_id", "stream_id", "agent_id", "seq_no", F.array_join(lines, "\n").alias("content"), kind.alias("memory_type"), refs.alias("references"), F.lit(1).alias("level"))
