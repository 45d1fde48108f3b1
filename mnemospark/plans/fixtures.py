"""Projections of the driver's tables onto the engine's inputs, for Spark and for SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import spread

AS_OF = "2024-01-31 00:00:00"
TEXTS = ("documents", "conversations")  # work on a row outweighs reading it


class Tables:
    """Lazily read tables of one folder, and the engine inputs derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(table) if name in TEXTS else table

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    @cached_property
    def as_of(self):
        return F.lit(AS_OF).cast("timestamp_ntz")

    @cached_property
    def l0_events(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").cast("string").alias("id"),
            F.col("user_id").cast("string").alias("user_id"),
            F.concat_ws("-", "user_id", "event_type").alias("stream_id"),
            F.when(F.col("event_type") == "error", F.concat(F.lit("a"), F.col("user_id") % 3)).alias("agent_id"),
            F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("o"), F.col("user_id") % 4)).alias("org_id"),
            F.lit("Json").alias("kind"),
            F.col("props").alias("data"),
            F.col("ts").alias("transaction_time"),
            F.when(F.col("event_type").isin("purchase", "signup"), F.col("ts")).alias("valid_time"),
            "event_type", "value", "event_id",
        )

    @cached_property
    def units(self) -> DataFrame:
        d = F.col("doc_id")
        level = F.when(d % 10 == 0, 2).when(d % 25 == 7, 3).otherwise(1)
        refs = F.when(level == 2, F.transform(F.array(d + 1, d + 2, d + 3), lambda x: x.cast("string")))
        at = F.timestamp_add("HOUR", d.cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
        kind = F.when(d % 6 == 0, "procedural").otherwise("factual")
        return self.documents.select(
            d.cast("string").alias("id"),
            (d % 20).cast("string").alias("user_id"),
            F.concat(F.lit("o"), d % 4).alias("org_id"),
            F.when(d % 9 == 0, F.concat(F.lit("a"), d % 3)).alias("agent_id"),
            F.col("text").alias("content"),
            F.array("lang", "source").alias("keywords"),
            ((d * 37 % 100) / 100).alias("importance"),
            level.cast("int").alias("level"),
            kind.alias("memory_type"),
            F.when((kind == "procedural") & (d % 9 == 0), "agent").otherwise("user").alias("domain"),
            at.alias("transaction_time"),
            F.when(d % 4 != 1, at).alias("valid_time"),
            F.coalesce(refs, F.array().cast("array<string>")).alias("references"),
            d.alias("doc_id"), "lang", "source",
        )

    @cached_property
    def unit_embeddings(self) -> DataFrame:
        vectors = self.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
        return self.units.join(vectors, "doc_id", "left")

    @cached_property
    def tombstones(self) -> DataFrame:
        units = self.documents.where("doc_id % 11 = 3").select(F.lit("memory_unit").alias("target_kind"), F.col("doc_id").cast("string").alias("target_id"))
        events = self.events.where("event_id % 13 = 5").select(F.lit("event").alias("target_kind"), F.col("event_id").cast("string").alias("target_id"))
        return units.union(events)

    @cached_property
    def edges(self) -> DataFrame:
        relation = F.when(F.col("l_returnflag") == "A", "RelatedTo").when(F.col("l_returnflag") == "N", "DerivedFrom").otherwise("EvolvedTo")
        rows = self.orders.join(self.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
        return rows.select(
            F.lit("u").alias("user_id"),
            F.concat(F.lit("c"), "o_custkey").alias("source_id"),
            F.concat(F.lit("p"), "l_partkey").alias("target_id"),
            relation.alias("relation"),
            F.round(F.col("l_discount") * 10, 6).alias("weight"),
            F.col("o_orderdate").alias("transaction_time"),
        )

    @cached_property
    def tasks(self) -> DataFrame:
        from pyspark.sql import Window

        previous = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
        status = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "Pending").otherwise("InProgress")
        missing = F.when(F.col("o_orderkey") % 17 == 0, F.col("o_orderkey") - 1000000)
        return self.orders.withColumn("previous", previous).select(
            F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("user_id"), status.alias("status"),
            F.col("previous").alias("parent_id"), F.col("o_totalprice").alias("priority"), F.col("o_orderdate").alias("transaction_time"),
            F.filter(F.array("previous", missing), lambda x: x.isNotNull()).alias("dependencies"),
        )

    @cached_property
    def rac_actions(self) -> DataFrame:
        d = F.col("doc_id")
        kinds = F.array(*[F.lit(x) for x in ("obsolete", "obsolete", "contradicts", "reaffirm", "ignore", "obsolete")])
        changes = F.array(*[F.lit(x) for x in ("update", "negation", "contradiction", "reaffirm", "addition", "historical")])
        return self.documents.where("doc_id > 0").select(
            d.cast("string").alias("source_id"), (d - 1).cast("string").alias("target_id"),
            F.get(kinds, (d % 6).cast("int")).alias("kind"), F.get(changes, (d * 7 % 6).cast("int")).alias("change_type"),
            ((d * 13 % 100) / 100).alias("confidence"), (d % 5 != 0).alias("slots_match"),
            (d % 7 == 0).alias("target_newer"), (d % 31 == 0).alias("target_missing"),
            F.timestamp_add("MINUTE", (d * 7).cast("int"), F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")).alias("created_at"),
        )

    @cached_property
    def share_policies(self) -> DataFrame:
        users = self.spark.range(20).select(F.col("id").cast("string").alias("user_id"))
        u = F.col("user_id").cast("int")
        return users.select("user_id", (u % 2 == 0).alias("contribute"), (u % 3 == 0).alias("consume"))

    @cached_property
    def queries(self) -> DataFrame:
        return self.benchmark.select(F.col("item_id").alias("query_id"), "text")


ORACLE_VIEWS = {
    "l0_events": """
        SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS user_id, user_id || '-' || event_type AS stream_id,
          CASE WHEN event_type = 'error' THEN 'a' || (user_id % 3) END AS agent_id,
          CASE WHEN user_id % 5 <> 0 THEN 'o' || (user_id % 4) END AS org_id, 'Json' AS kind, props AS data,
          ts AS transaction_time, CASE WHEN event_type IN ('purchase', 'signup') THEN ts END AS valid_time,
          event_type, value, event_id FROM events""",
    "units": """
        SELECT doc_id::VARCHAR AS id, (doc_id % 20)::VARCHAR AS user_id, 'o' || (doc_id % 4) AS org_id,
          CASE WHEN doc_id % 9 = 0 THEN 'a' || (doc_id % 3) END AS agent_id, text AS content, [lang, source] AS keywords,
          (doc_id * 37 % 100) / 100.0::DOUBLE AS importance,
          CASE WHEN doc_id % 10 = 0 THEN 2 WHEN doc_id % 25 = 7 THEN 3 ELSE 1 END AS level,
          CASE WHEN doc_id % 6 = 0 THEN 'procedural' ELSE 'factual' END AS memory_type,
          CASE WHEN doc_id % 6 = 0 AND doc_id % 9 = 0 THEN 'agent' ELSE 'user' END AS domain,
          TIMESTAMP '2024-01-01' + to_hours(doc_id::INT) AS transaction_time,
          CASE WHEN doc_id % 4 <> 1 THEN TIMESTAMP '2024-01-01' + to_hours(doc_id::INT) END AS valid_time,
          CASE WHEN doc_id % 10 = 0 THEN [(doc_id + 1)::VARCHAR, (doc_id + 2)::VARCHAR, (doc_id + 3)::VARCHAR] ELSE []::VARCHAR[] END AS refs,
          doc_id, lang, source FROM documents""",
    "tombstones": """
        SELECT 'memory_unit' AS target_kind, doc_id::VARCHAR AS target_id FROM documents WHERE doc_id % 11 = 3
        UNION ALL SELECT 'event', event_id::VARCHAR FROM events WHERE event_id % 13 = 5""",
    "edges": """
        SELECT 'u' AS user_id, 'c' || o_custkey AS source_id, 'p' || l_partkey AS target_id,
          CASE l_returnflag WHEN 'A' THEN 'RelatedTo' WHEN 'N' THEN 'DerivedFrom' ELSE 'EvolvedTo' END AS relation,
          round(l_discount * 10, 6) AS weight, o_orderdate AS transaction_time
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "tasks": """
        SELECT o_orderkey AS task_id, o_custkey AS user_id,
          CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Pending' ELSE 'InProgress' END AS status,
          lag(o_orderkey) OVER w AS parent_id, o_totalprice AS priority, o_orderdate AS transaction_time,
          list_filter([lag(o_orderkey) OVER w, CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey - 1000000 END], lambda x: x IS NOT NULL) AS dependencies
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "rac_actions": """
        SELECT doc_id::VARCHAR AS source_id, (doc_id - 1)::VARCHAR AS target_id,
          ['obsolete', 'obsolete', 'contradicts', 'reaffirm', 'ignore', 'obsolete'][(doc_id % 6)::INT + 1] AS kind,
          ['update', 'negation', 'contradiction', 'reaffirm', 'addition', 'historical'][(doc_id * 7 % 6)::INT + 1] AS change_type,
          (doc_id * 13 % 100) / 100.0::DOUBLE AS confidence, doc_id % 5 <> 0 AS slots_match, doc_id % 7 = 0 AS target_newer,
          doc_id % 31 = 0 AS target_missing, TIMESTAMP '2024-01-29' + to_minutes((doc_id * 7)::INT) AS created_at
        FROM documents WHERE doc_id > 0""",
    "share_policies": "SELECT i::VARCHAR AS user_id, i % 2 = 0 AS contribute, i % 3 = 0 AS consume FROM range(20) t(i)",
    "queries": "SELECT item_id AS query_id, text FROM benchmark",
    "unit_embeddings": """
        SELECT u.*, e.embedding FROM units u LEFT JOIN embeddings e ON u.doc_id = e.vec_id""",
}
