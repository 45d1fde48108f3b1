"""Shared organization knowledge: topics, merged records, contributions, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.components import connected_components
from ..functions.text import ascii_lower, first_words, neutralise_first_person, normalise_keywords, slug, title_prefixed
from .ingest import publishable

MAX_KEYWORDS = 8


def published_sources(units: DataFrame, policies: DataFrame) -> DataFrame:
    """Level-2 user insights of contributing users in an organization."""
    ok = publishable(F.col("domain"), F.col("level"), F.col("content")) & F.col("org_id").isNotNull()
    return units.where(ok).join(policies.where("contribute").select("user_id"), "user_id", "left_semi")


def share_backfill(units: DataFrame, policies: DataFrame, org: str, contributed: DataFrame) -> DataFrame:
    """Sources that a user's late consent adds to ``org``: the organization's insights of
    contributing users that are no contribution (``source_id``) yet; running it again adds nothing."""
    rows = published_sources(units.where((F.col("org_id") == org) & (F.col("level") <= 2)), policies)
    return rows.join(contributed.select(F.col("source_id").alias("id")), "id", "left_anti")


def topic_candidates(units: DataFrame) -> DataFrame:
    """``(id, place, label, key)``: the slugs of up to eight keywords, or of the first six
    words where no keyword has one."""
    labels = normalise_keywords("keywords", MAX_KEYWORDS)
    usable = F.filter(labels, lambda x: slug(x) != "")
    chosen = F.when(F.size(usable) > 0, usable).otherwise(F.array(first_words("content")))
    rows = units.select("id", "org_id", F.posexplode(chosen).alias("place", "label"))
    rows = rows.withColumn("key", slug("label")).where("key <> ''")
    first = F.min(F.struct("place", "label")).alias("x")
    return rows.groupBy("id", "org_id", "key").agg(first).select("id", "org_id", "x.place", "x.label", "key")


def elect_topics(candidates: DataFrame, by: list[str]) -> DataFrame:
    """The topic of each group: most sources, then most first places, then the shortest
    label, then the key; its label is the shortest seen (ties: the smallest)."""
    tally = candidates.groupBy(*by, "key").agg(
        F.count("*").alias("total"), F.count_if(F.col("place") == 0).alias("primary"), F.min(F.struct(F.length("label").alias("n"), "label")).alias("l")
    )
    best = F.min(F.struct(-F.col("total"), -F.col("primary"), F.col("l.n"), F.col("key"), F.col("l.label"))).alias("x")
    picked = tally.groupBy(*by).agg(best, F.array_sort(F.collect_set("key")).alias("aliases"))
    return picked.select(*by, F.col("x.key").alias("topic_key"), F.col("x.label").alias("topic_label"), "aliases")


def merge_sources(candidates: DataFrame) -> DataFrame:
    """``(id, record)``: sources of an organization that share a topic key, directly or through
    others, make one record, named by its smallest source. Keys link to their smallest source
    and not to each other, so a common key costs one edge a source."""
    low = candidates.groupBy("org_id", "key").agg(F.min("id").alias("low"))
    links = candidates.join(low, ["org_id", "key"]).where("id <> low").select("id", "low").distinct()
    found = connected_components(links, "id", "low")
    ids = candidates.select("id").distinct()
    return ids.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("record"))


def representatives(sources: DataFrame, by: str) -> DataFrame:
    """Most important, then latest valid, latest written, smallest id."""
    order = [F.desc("importance"), F.desc_nulls_last("valid_time"), F.desc("transaction_time"), F.asc("id")]
    return sources.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def compose_records(sources: DataFrame, by: str = "record") -> DataFrame:
    """One record a group. ``sources``: units with ``by`` and ``topic_label``. Keywords come in
    the order of sources; only the eight best-placed distinct ones leave the aggregation."""
    ranked = representatives(sources, by)
    top = ranked.where("n = 1").select(by, "topic_label", "content", "memory_type")
    sums = ranked.groupBy(by).agg(F.max("importance").alias("importance"), F.max("valid_time").alias("valid_time"), F.count("*").alias("sources"))
    words = ranked.select(by, "n", F.posexplode(normalise_keywords("keywords", MAX_KEYWORDS)).alias("at", "word"))
    words = words.unionByName(top.select(by, F.lit(0).alias("n"), F.lit(0).alias("at"), F.col("topic_label").alias("word")))
    first = words.groupBy(by, ascii_lower("word").alias("low")).agg(F.min(F.struct("n", "at", "word")).alias("x"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("x.n", "x.at"))
    kept = first.withColumn("p", place).where(F.col("p") <= MAX_KEYWORDS)
    lists = kept.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", F.col("x.word").alias("w")))), lambda x: x["w"]).alias("keywords"))
    out = top.join(sums, by).join(lists, by)
    content = title_prefixed(F.get("keywords", 0), neutralise_first_person("content"))
    return out.select(by, "topic_label", content.alias("content"), "keywords", "memory_type", "importance", "valid_time", "sources")


def centroid(rows: DataFrame, by: str, vector: str, fallback: DataFrame | None = None) -> DataFrame:
    """Element-wise mean of each group's vectors, missing ones left out; where lengths differ the
    vector of the group's representative (``fallback``: ``by`` and ``vector``), null without
    one. Sums per (group, position): no vectors are gathered."""
    kept = rows.where(F.col(vector).isNotNull())
    same = kept.groupBy(by).agg((F.min(F.size(vector)) == F.max(F.size(vector))).alias("same"))
    parts = kept.select(by, F.posexplode(vector).alias("at", "x")).groupBy(by, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    lists = parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("centroid"))
    out = lists.join(same, by).select(by, F.when(F.col("same"), F.col("centroid")).alias("centroid"))
    if fallback is None:
        return out
    own = fallback.select(by, F.transform(vector, lambda x: x.cast("double")).alias("_own"))
    return out.join(own, by, "left").select(by, F.coalesce("centroid", "_own").alias("centroid"))


def contributions(sources: DataFrame, revoked: Column) -> DataFrame:
    """Candidates are approved on the way in and stay, once revoked, as history."""
    return sources.select("record", F.col("id").alias("source_id"), F.col("user_id").alias("contributor"), F.when(revoked, "revoked").otherwise("active").alias("status"), "memory_type", F.col("transaction_time").alias("updated_at"))


def listing(records: DataFrame, word: str | None, order: str, limit: int) -> DataFrame:
    keys = {
        "recent": [F.desc("updated_at")], "importance": [F.desc("importance")], "sources": [F.desc("sources")], "topic": [F.asc("topic_label")],
    }[order]
    rows = records if word is None else records.where(F.contains(F.lower("content"), F.lit(word.lower())))
    return rows.orderBy(*keys, "record").limit(limit)


def contribution_order() -> list[Column]:
    rank = F.when(F.col("status") == "active", 0).when(F.col("status") == "candidate", 1).otherwise(2)
    return [rank.asc(), F.desc("updated_at"), F.asc("source_id")]
