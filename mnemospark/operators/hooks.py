"""Places where a model may be plugged in, and what stands there without one.

A hook takes and returns a DataFrame, so a model runs as an Arrow function inside a plan. The
defaults are deterministic; everything around them is plain relational work.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_space

Hook = Callable[[DataFrame], DataFrame]


def _same(df: DataFrame) -> DataFrame:
    return df


def no_embedding(df: DataFrame) -> DataFrame:
    """Without a model a vector is missing: search answers from text alone."""
    return df.withColumn("embedding", F.lit(None).cast("array<float>"))


@dataclass
class Hooks:
    """``compress``: content and valid_at of packed units; ``embed``: embedding of content;
    ``arbitrate``: hits of close queries; ``rerank``: ``external`` scores; ``topics``,
    ``relations``, ``corrections``, ``milestones``: rows a model would propose, none by default."""

    compress: Hook = _same
    embed: Hook = no_embedding
    arbitrate: Hook = _same
    rerank: Hook | None = None
    topics: Hook | None = None
    relations: Hook | None = None
    corrections: Hook | None = None
    milestones: Hook | None = None


def reranked(hits: DataFrame, hooks: Hooks) -> DataFrame:
    """External scores where the hook gives one (columns query_id, id, external), else those
    the hits have."""
    if hooks.rerank is None:
        return hits
    external = hooks.rerank(hits).select("query_id", "id", "external")
    return hits.join(external, ["query_id", "id"], "left").withColumn("score", F.coalesce("external", "score")).drop("external")


def semantic_links(units: DataFrame, hooks: Hooks) -> DataFrame:
    """Edges a model sees between a unit and its recent neighbours; none without one."""
    schema = "source_id string, target_id string, relation string, weight double"
    return units.sparkSession.createDataFrame([], schema) if hooks.relations is None else hooks.relations(units).select("source_id", "target_id", "relation", "weight")


def plan_goals(goals: DataFrame, hooks: Hooks, depth: int = 5) -> tuple[DataFrame, DataFrame]:
    """Milestones of goals above ``depth`` (columns id, parent_id, content) and their
    ``IsSubTaskOf`` edges from child to parent."""
    schema = "id string, parent_id string, content string"
    if hooks.milestones is None:
        steps = goals.sparkSession.createDataFrame([], schema)
    else:
        steps = hooks.milestones(goals.where(F.col("depth") < depth)).select("id", "parent_id", "content")
    edges = steps.select(F.col("id").alias("source_id"), F.col("parent_id").alias("target_id"), F.lit("IsSubTaskOf").alias("relation"), F.lit(1.0).alias("weight"))
    return steps, edges


def consolidated(hits: DataFrame, by: str) -> DataFrame:
    """The hits of a query as one text, best first, joined by line breaks."""
    texts = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", normalise_space("content").alias("c"))))
    return hits.groupBy(by).agg(F.array_join(F.transform(texts, lambda x: x["c"]), "\n").alias("content"))
