"""The engine's Python API: tables in, DataFrames out; ``as_of`` instead of a clock."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import times
from .operators import community, context, correction, graph, ingest, lifecycle, organization, retrieval, stats


@dataclass
class Engine:
    """``tables``: units, edges, tombstones, events, tasks, policies as far as used."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    as_of: str
    weights: dict[str, float] = field(default_factory=lambda: dict(times.WEIGHTS))

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    @property
    def now(self) -> Column:
        return times.ts(self.as_of)

    def scoped(self, user: str | None = None, org: str | None = None, domain: str | None = None, valid: tuple | None = None) -> DataFrame:
        """Visible units in scope, known at ``as_of``; filters reach the scan."""
        rows = self["units"].where(times.known_at("transaction_time", self.now))
        for col, value in (("user_id", user), ("org_id", org), ("domain", domain)):
            if value is not None:
                rows = rows.where(F.col(col) == value)
        if valid:
            start, end = (times.ts(x) if x else None for x in valid)
            rows = rows.where(times.in_valid_range("valid_time", start, end))
        return lifecycle.visible(rows, self["tombstones"])

    def retrieve(self, queries: DataFrame, limit: int = 10, depth: int = 1, min_score: float = 0.3, token_budget: int | None = None, **scope) -> DataFrame:
        """Hybrid search of a batch; ``limit`` hits each, within ``token_budget`` if given."""
        units = self.scoped(**scope)
        edges = graph.latest_edges(self["edges"])
        hits = retrieval.hybrid(units, edges, queries, self.now, limit, depth, min_score).where(F.col("rank") < limit)
        rows = units.join(F.broadcast(hits), "id")
        if token_budget:
            rows = rows.withColumn("cost", context.token_cost("content", "keywords"))
            rows = context.greedy_budget(rows, "query_id", [F.col("rank").asc()], "cost", token_budget)
        return rows

    def search_text(self, queries: DataFrame, k: int = 10, **scope) -> DataFrame:
        units = self["units"].where(times.known_at("transaction_time", self.now))
        return retrieval.bm25_top_k(units, queries, k, self.scoped(**scope).select("id"))

    def search_vector(self, queries: DataFrame, k: int = 10, **scope) -> DataFrame:
        return retrieval.vector_top_k(self.scoped(**scope), queries, k)

    def search_procedural(self, queries: DataFrame, k: int = 10, **scope) -> DataFrame:
        units = self.scoped(**scope).where("memory_type = 'procedural'")
        return retrieval.rerank(F.broadcast(retrieval.vector_top_k(units, queries, k)), units, self.now, 0.0, self.weights)

    def search_shared_text(self, queries: DataFrame, records: DataFrame, k: int = 10, **scope) -> DataFrame:
        """Native text hits and organization records (id, content, keywords) in one list, records
        at 0.7 of the weight of their rank."""
        native = self.search_text(queries, k, **scope)
        shared = retrieval.organization_scores(records, queries.select("query_id", "text"), k, 0.01)
        return retrieval.top_k(retrieval.fuse([(native, 1.0), (shared, retrieval.SHARED_FACTOR)], False), k)

    def search(self, queries: DataFrame, mode: str = "hybrid", k: int = 10, records: DataFrame | None = None, **scope) -> DataFrame:
        """``(query_id, id, score, rank)`` by mode: ``text_local`` the units' text alone; ``text``
        and ``text_shared`` with organization ``records``; ``vector``; any other is hybrid, with
        the records if there are any. At most 100 a query."""
        k = min(k, 100)
        if mode == "text_local" or mode in ("text", "text_shared") and records is None:
            out = self.search_text(queries, k, **scope)
        elif mode in ("text", "text_shared"):
            out = self.search_shared_text(queries, records, k, **scope)
        elif mode == "vector":
            out = self.search_vector(queries, k, **scope)
        else:
            out = self.retrieve(queries, k, **scope)
            if records is not None:
                shared = retrieval.organization_scores(records, queries, k, 0.01).join(records.select("id", "embedding"), "id")
                everyone = queries.select("query_id", F.lit(True).alias("consume"))
                cols = ["query_id", "id", "score", "embedding"]
                out = retrieval.with_shared(out.select(*cols), shared.select(*cols), everyone, k, 0.0)
        return out.select("query_id", "id", "score", "rank")

    def context(self, queries: DataFrame, budget: int = 800, limit: int = 12, xml: bool = False, **scope) -> DataFrame:
        budget = max(64, min(4096, budget))
        wide = {True: 4, False: 3}[budget <= 160] if budget <= 480 else 2
        hits = self.retrieve(queries, min(24, max(1, limit)) * wide, **scope)
        return context.render(hits, "query_id", budget, xml)

    def traverse(self, start: DataFrame, steps: list[dict], limit: int | None = None) -> DataFrame:
        return graph.traverse(graph.latest_edges(self["edges"]), start, steps, limit)

    def communities(self, method: str = "lpa", at_least: int = community.MIN_MEMBERS) -> DataFrame:
        edges = graph.latest_edges(self["edges"])
        found = {"lpa": lambda: community.label_propagation(edges, 10, True), "louvain": lambda: community.louvain(edges), "two_phase": lambda: community.two_phase(edges)}[method]()
        return found.join(community.groups(found, at_least).select("community"), "community", "left_semi")

    def stats(self, by: list[str] | None = None) -> DataFrame:
        return stats.memory_aggregate(self["units"], by)

    def agents(self) -> DataFrame:
        return stats.agent_rollup(self["units"], self["events"]).orderBy(F.desc("last_activity"))

    def graph_view(self, limit: int = 200) -> tuple[DataFrame, DataFrame]:
        nodes = self["units"].select("id", F.col("content").alias("label"), "level", "importance")
        return graph.view(nodes, graph.latest_edges(self["edges"]), min(limit, 1000))

    def org_knowledge(self) -> DataFrame:
        sources = organization.published_sources(self["units"], self["policies"])
        candidates = organization.topic_candidates(sources)
        record = organization.merge_sources(candidates)
        topics = organization.elect_topics(candidates.join(record, "id"), ["record"]).select("record", "topic_label")
        return organization.compose_records(sources.join(record, "id").join(topics, "record"))

    def forget_preview(self, hits: DataFrame) -> DataFrame:
        return lifecycle.forget_preview(hits.select("id"), self["units"], self["events"])

    def forget(self, preview: DataFrame, reason: str, mode: str = "logical") -> "Engine":
        """A new engine whose tombstones hold the preview; hard mode drops the rows too."""
        new = lifecycle.tombstones_for(preview, mode, reason)
        tables = self.tables | {"tombstones": self["tombstones"].unionByName(new.select("target_kind", "target_id"))}
        if mode == "hard":
            gone = new.where("target_kind = 'memory_unit'").select(F.col("target_id").alias("id"))
            tables["units"] = self["units"].join(gone, "id", "left_anti")
            for end in ("source_id", "target_id"):
                tables["edges"] = tables["edges"].join(gone.withColumnRenamed("id", end), end, "left_anti")
            if "events" in tables:
                lost = new.where("target_kind = 'event'").select(F.col("target_id").alias("id"))
                tables["events"] = tables["events"].join(lost, "id", "left_anti")
        return Engine(self.spark, tables, self.as_of, self.weights)

    def ready_tasks(self) -> DataFrame:
        return lifecycle.ready_tasks(self["tasks"])

    def task_tree(self) -> DataFrame:
        return lifecycle.task_depths(self["tasks"])

    def plan_corrections(self, actions: DataFrame) -> DataFrame:
        return correction.decide(actions)

    def decay(self, factor: float = 0.9) -> "Engine":
        units = self["units"].withColumn("importance", F.col("importance") * factor)
        return Engine(self.spark, self.tables | {"units": units}, self.as_of, self.weights)

    def prune(self, threshold: float = 0.1) -> "Engine":
        gone = lifecycle.prune(self["units"], self["tombstones"], threshold).select("id")
        units = self["units"].join(gone, "id", "left_anti")
        return Engine(self.spark, self.tables | {"units": units}, self.as_of, self.weights)

    def consolidate(self) -> DataFrame:
        """Level-1 units of all events: packed by user, stream and agent in time order."""
        events = self["events"].withColumn("tokens", ingest.event_tokens("kind", "data"))
        keyed = events.withColumn("agent_key", F.coalesce("agent_id", F.lit("")))
        key = ["user_id", "stream_id", "agent_key"]
        packed = ingest.pack_events(keyed, key, ["transaction_time", "id"], "tokens")
        rows = packed.join(keyed.select("id", "data", "agent_id"), "id")
        messages = F.collect_list(F.struct("transaction_time", "id", "data")).alias("messages")
        packs = rows.groupBy(*key, "seq_no").agg(messages, F.first("agent_id").alias("agent_id"))
        return lifecycle.units_from_packs(packs)
