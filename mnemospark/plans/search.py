"""Retrieval queries: a batch of benchmark texts and vectors against all units."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..operators import context, lifecycle, retrieval
from . import analytics
from .fixtures import Tables
from .registry import query
from .scalar import tokens_sql

_DIST = "round(1 / (1 + list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: pow(p[1]::DOUBLE - p[2]::DOUBLE, 2)))), 6)"


def vector_queries(t: Tables):
    """The stated query set: every vector whose id is divisible by 50, against all rows."""
    return t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def text_queries(t: Tables):
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def both_queries(t: Tables):
    vectors = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return text_queries(t).join(vectors, "query_id", "left")


def _vectors(t: Tables):
    return t.embeddings.select(F.col("vec_id").cast("string").alias("id"), "embedding", "label")


@query(
    "R1 R19 O3 C4",
    f"""WITH h AS (SELECT q.vec_id AS query_id, e.vec_id::VARCHAR AS id, {_DIST} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)
    SELECT query_id, id, score, rn - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM h) WHERE rn <= 10""",
)
def vector_topk(t: Tables):
    return retrieval.vector_top_k(_vectors(t), vector_queries(t), 10).withColumn("rank", F.col("rank").cast("long"))


@query(
    "R1 R18 F4 F5 F8",
    f"""WITH u AS (SELECT * FROM unit_embeddings x WHERE embedding IS NOT NULL AND memory_type = 'procedural' AND valid_time >= TIMESTAMP '2024-01-02'
      AND NOT EXISTS (SELECT 1 FROM tombstones d WHERE d.target_kind = 'memory_unit' AND d.target_id = x.id)),
    h AS (SELECT q.vec_id AS query_id, e.id, {_DIST} AS sim, importance, transaction_time FROM u e, embeddings q WHERE q.vec_id % 50 = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rn FROM h)
    SELECT query_id, id, round(sim + importance * 0.2 + 0.1 * pow(0.5, date_diff('second', transaction_time, TIMESTAMP '2024-01-31') / 604800.0), 6) AS score FROM k WHERE rn <= 10""",
    "units unit_embeddings tombstones",
)
def vector_topk_filtered(t: Tables):
    u = t.unit_embeddings.where((F.col("memory_type") == "procedural") & times.in_valid_range("valid_time", times.ts("2024-01-02"), None))
    u = lifecycle.visible(u, t.tombstones)
    hits = retrieval.vector_top_k(u, vector_queries(t), 10)
    return retrieval.rerank(F.broadcast(hits), u, t.as_of, 0.0).select("query_id", "id", "score")


_BM25 = r"""terms AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\pL\pN]+')) AS term FROM benchmark),
  docs AS (SELECT doc_id::VARCHAR AS id, regexp_extract_all(lower(text), '[\pL\pN]+') AS toks FROM documents),
  stats AS (SELECT count(*) AS n, avg(len(toks)) AS al FROM docs),
  tf AS (SELECT id, len(toks) AS len, term, count(*) AS tf FROM (SELECT id, toks, unnest(toks) AS term FROM docs) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  bm AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 6) AS score FROM tf JOIN df USING (term) JOIN terms USING (term), stats GROUP BY 1, 2)"""


@query(
    "R2 R16 O4 S9",
    f"""WITH {_BM25} SELECT query_id, id, score, rn - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM bm) WHERE rn <= 10""",
)
def bm25_topk(t: Tables):
    return retrieval.bm25_top_k(t.units, text_queries(t), 10).withColumn("rank", F.col("rank").cast("long"))


@query(
    "R2 F7 S10",
    f"""WITH {_BM25} SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM bm WHERE id::BIGINT % 11 <> 3 AND id::BIGINT % 4 = 1) WHERE rn <= 5""",
)
def bm25_scoped(t: Tables):
    scope = lifecycle.visible(t.units.where("org_id = 'o1'"), t.tombstones).select("id")
    return retrieval.bm25_top_k(t.units, text_queries(t), 5, scope).select("query_id", "id", "score")


_FUSE = f"""{_BM25}, bmk AS (SELECT query_id, id, rn - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM bm) WHERE rn <= 20),
  vh AS (SELECT q.vec_id AS query_id, e.id, {_DIST} AS score FROM (SELECT u.*, x.embedding FROM units u JOIN embeddings x ON x.vec_id = u.doc_id) e, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
  vk AS (SELECT query_id, id, rn - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM vh) WHERE rn <= 20),
  fs AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS s FROM (SELECT * FROM bmk UNION ALL SELECT * FROM vk) GROUP BY 1, 2),
  fused AS (SELECT query_id, id, round(s / max(s) OVER (PARTITION BY query_id), 6) AS score FROM fs),
  seeds AS (SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM fused) WHERE rn <= 30)"""


def _lists(t: Tables):
    q = both_queries(t)
    return [(retrieval.vector_top_k(t.unit_embeddings, q.where("vector is not null"), 20), 1.0), (retrieval.bm25_top_k(t.units, q, 20), 1.0)]


@query("R4 U2 W1 W2", f"WITH {_FUSE} SELECT query_id, id, score FROM seeds", "units")
def rrf_fusion(t: Tables):
    return retrieval.top_k(retrieval.fuse(_lists(t)), 30).select("query_id", "id", "score")


@query(
    "R4 R5 R7 R8 J1 J4",
    f"""WITH {_FUSE} SELECT query_id, id, round(score + importance * 0.2 + 0.1 * pow(0.5, date_diff('second', transaction_time, TIMESTAMP '2024-01-31') / 604800.0), 6) AS score
    FROM seeds JOIN units USING (id) WHERE round(score + importance * 0.2 + 0.1 * pow(0.5, date_diff('second', transaction_time, TIMESTAMP '2024-01-31') / 604800.0), 6) >= 0.5""",
    "units",
)
def hybrid_rank(t: Tables):
    seeds = retrieval.top_k(retrieval.fuse(_lists(t)), 30)
    return retrieval.rerank(F.broadcast(seeds), t.units, t.as_of, 0.5).select("query_id", "id", "score")


_EXPAND = f"""{_FUSE}, {analytics._UNIT_EDGES},
  useful AS (SELECT source_id, t::VARCHAR AS target_id, weight FROM unit_edges WHERE relation = 'DerivedFrom' OR relation = 'RelatedTo' AND weight > 0.42),
  both_ways AS (SELECT source_id AS a, target_id AS b, weight FROM useful UNION ALL SELECT target_id, source_id, weight FROM useful),
  front AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM seeds) WHERE rn <= 10),
  hop AS (SELECT DISTINCT query_id, b AS id FROM front JOIN both_ways ON a = id),
  expanded AS (SELECT query_id, id, score FROM seeds UNION ALL SELECT query_id, id, round(0.8 * 0.8, 6)::DOUBLE FROM hop h WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = h.query_id AND s.id = h.id))"""


@query("R6", f"WITH {_EXPAND} SELECT query_id, id, round(score, 6) AS score FROM expanded", "units")
def graph_expand(t: Tables):
    seeds = retrieval.top_k(retrieval.fuse(_lists(t)), 30)
    found = retrieval.expand(seeds, analytics.unit_edges(t), t.units.select("id"), 1, 0.42)
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


@query("R4 R6 R7 R8 R9 R10 R11 P8")
def hybrid_search(t: Tables):
    """The flagship: fused candidates, graph expansion, re-ranking, de-duplication."""
    hits = retrieval.hybrid(t.unit_embeddings, analytics.unit_edges(t), both_queries(t), t.as_of, 10, 2, 0.3, 0.42, 0.30)
    return hits.select("query_id", "id", "score", "rank")


@query("R12 R13 R14 R17 U4 J3")
def shared_search(t: Tables):
    """Native hits with organization records for users that consume them."""
    q = both_queries(t).where("query_id % 50 = 0")
    u = t.unit_embeddings
    native = retrieval.hybrid(u, analytics.unit_edges(t), q, t.as_of, 10, 1, 0.3, 0.42, 0.30)
    native = native.select("query_id", "id", "score").join(u.select("id", "embedding"), "id")
    records = lifecycle.visible(u.where("level = 2 and domain = 'user'"), t.tombstones)
    shared = retrieval.organization_scores(records, q, 30, 0.01).drop("rank").join(records.select("id", "embedding"), "id")
    policies = q.select("query_id", (F.col("query_id") % 3 == 0).alias("consume"))
    return retrieval.with_shared(native, shared, policies, 10, 0.05, 0.30).select("query_id", "id", "score", "rank", "kind")


_TERMS = r"list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9ªµºÀ-ÖØ-öø-˿Ͱ-῿]+'))"


@query(
    "R14 R15",
    rf"""WITH q AS (SELECT item_id AS query_id, {_TERMS} AS terms FROM benchmark WHERE item_id % 50 = 0),
    r AS (SELECT id, translate(content || ' ' || lang || ' ' || source, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS hay FROM units WHERE level = 2),
    s AS (SELECT query_id, id, round(len(list_filter(terms, lambda x: contains(hay, x))) / len(terms)::DOUBLE, 6) AS score FROM q, r)
    SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM s WHERE score >= 0.01) WHERE rn <= 10""",
    "units",
)
def org_text_search(t: Tables):
    q = text_queries(t).where("query_id % 50 = 0")
    return retrieval.organization_scores(t.units.where("level = 2"), q, 10, 0.01).select("query_id", "id", "score")


@query(
    "W10 R10",
    f"""WITH h AS (SELECT q.vec_id AS query_id, e.vec_id::VARCHAR AS id, {_DIST} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn, lead(score) OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nx FROM h)
    SELECT query_id, round(score - nx, 6) AS gap, score - nx < 0.02 AS arbitrate FROM k WHERE rn = 1""",
)
def arbitration_trigger(t: Tables):
    hits = retrieval.vector_top_k(_vectors(t), vector_queries(t), 3).where(F.col("id") != F.col("query_id").cast("string"))
    return retrieval.needs_arbitration(hits, 0.02)


@query(
    "G7 G8 G9",
    f"""WITH h AS (SELECT q.vec_id::VARCHAR AS source_id, e.vec_id::VARCHAR AS target_id, {_DIST} AS weight FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)
    SELECT source_id, target_id, weight FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, target_id) AS rn FROM h) WHERE rn <= 5 AND weight > 0.42 AND source_id <> target_id""",
)
def auto_link_edges(t: Tables):
    new = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.auto_links(_vectors(t), new, 5, 0.42).select("source_id", "target_id", "weight")


@query("R9 J13")
def semantic_dedup(t: Tables):
    hits = retrieval.vector_top_k(_vectors(t), vector_queries(t), 80).drop("rank").join(_vectors(t), "id")
    return retrieval.drop_same_meaning(hits, 20, 0.25).select("query_id", "id", "rank")


@query(
    "R11 W4",
    f"""WITH RECURSIVE h AS (SELECT user_id, id, {tokens_sql('content')} + {tokens_sql("array_to_string(keywords, ' ')")} AS cost, row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, id) AS n FROM units),
    r AS (SELECT user_id, id, n, cost <= 3000 AS kept, CASE WHEN cost <= 3000 THEN cost ELSE 0 END AS used FROM h WHERE n = 1
      UNION ALL SELECT h.user_id, h.id, h.n, r.used + h.cost <= 3000, CASE WHEN r.used + h.cost <= 3000 THEN r.used + h.cost ELSE r.used END FROM r JOIN h ON h.user_id = r.user_id AND h.n = r.n + 1 WHERE h.n <= 25)
    SELECT user_id, id FROM r WHERE kept""",
    "units",
)
def budget_pack(t: Tables):
    rows = t.units.select("user_id", "id", "importance", context.token_cost("content", "keywords").alias("cost"))
    hits = retrieval.top_k(rows, 25, "user_id", "importance")
    return context.greedy_budget(hits, "user_id", [F.col("rank").asc()], "cost", 3000).select("user_id", "id")


def _context_hits(t: Tables):
    hits = retrieval.vector_top_k(t.unit_embeddings, vector_queries(t), 12)
    return t.units.join(F.broadcast(hits), "id")


@query("R21 C27 C29 O9")
def context_text(t: Tables):
    return context.render(_context_hits(t), "query_id", 400)


@query("R21 C17")
def context_xml(t: Tables):
    return context.render(_context_hits(t), "query_id", 400, xml=True)


@query(
    "R22 R20 C38",
    """WITH h AS (SELECT user_id, id, left(content, 500) AS piece, row_number() OVER (PARTITION BY user_id ORDER BY id) AS n FROM units),
    s AS (SELECT *, sum(strlen(piece) + 1) OVER (PARTITION BY user_id ORDER BY id) - 1 AS used FROM h WHERE n <= 10)
    SELECT user_id, md5(string_agg(piece, chr(10) ORDER BY id)) AS context_md5, count(*)::BIGINT AS pieces FROM s WHERE used <= 4000 GROUP BY 1""",
    "units",
)
def chat_context(t: Tables):
    rows = t.units.select("user_id", "id", F.left("content", F.lit(500)).alias("piece"))
    first = retrieval.top_k(rows.withColumn("score", F.lit(0)), 10, "user_id").drop("score", "rank")
    texts = context.bounded_concat(first, "user_id", "id", "piece", 4000)
    sizes = retrieval.top_k(rows.withColumn("score", F.lit(0)), 10, "user_id")
    from pyspark.sql import Window

    used = F.sum(F.octet_length("piece") + 1).over(Window.partitionBy("user_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)) - 1
    counts = sizes.withColumn("used", used).where("used <= 4000").groupBy("user_id").agg(F.count("*").alias("pieces"))
    return texts.join(counts, "user_id").select("user_id", F.md5("text").alias("context_md5"), "pieces")


@query(
    "U1 R3",
    """WITH tiers AS (SELECT * FROM (SELECT item_id AS query_id, doc_id::VARCHAR AS id, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS tier, row_number() OVER (PARTITION BY item_id, doc_id % 2 ORDER BY n_chars DESC, doc_id::VARCHAR) - 1 AS rank
      FROM benchmark, documents WHERE item_id % 50 = 0) WHERE rank < 6),
    both_tiers AS (SELECT * FROM tiers UNION ALL SELECT query_id, id, 1, rank FROM tiers WHERE tier = 0 AND id::BIGINT % 3 = 0),
    f AS (SELECT query_id, id, min((tier, rank)) AS x FROM both_tiers GROUP BY 1, 2)
    SELECT query_id, id, n - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x, id) AS n FROM f) WHERE n <= 8""",
)
def tier_union(t: Tables):
    """The best six of two tiers, some in both, for the stated query set against all documents."""
    stated = retrieval.batch(t.benchmark.where("item_id % 50 = 0").select(F.col("item_id").alias("query_id")))
    rows = t.documents.select(F.col("doc_id").cast("string").alias("id"), "doc_id", F.col("n_chars").alias("score")).crossJoin(stated)
    recent = retrieval.top_k(rows.where("doc_id % 2 = 0"), 6)
    indexed = retrieval.top_k(rows.where("doc_id % 2 = 1"), 6).unionByName(recent.where("doc_id % 3 = 0"))
    return retrieval.merge_tiers([recent, indexed], 8).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query(
    "R24",
    """SELECT source, round(list_reduce(list_concat([1.0::DOUBLE], list(CASE WHEN quality = 1 THEN 0.01::DOUBLE ELSE -0.01::DOUBLE END ORDER BY doc_id)), lambda w, x: greatest(0.1, least(2.0, w + x))), 6) AS weight
    FROM labels JOIN documents USING (doc_id) GROUP BY 1""",
)
def feedback_weights(t: Tables):
    rows = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").withColumn("cited", F.col("quality") == 1)
    return retrieval.feedback_weight(rows, "source", "doc_id", "cited")


@query(
    "R24 T17",
    f"""WITH {analytics._UNIT_EDGES}, c AS (SELECT doc_id // 20 AS g, doc_id::VARCHAR AS id FROM labels WHERE quality = 1), p AS (SELECT a.id AS source_id, b.id AS target_id, count(*) AS times FROM c a JOIN c b USING (g) WHERE a.id <> b.id GROUP BY 1, 2),
    e AS (SELECT source_id, t::VARCHAR AS target_id, max(weight) AS weight FROM unit_edges WHERE relation = 'RelatedTo' GROUP BY 1, 2 UNION ALL SELECT (doc_id + 1)::VARCHAR, doc_id::VARCHAR, 0.55 FROM documents WHERE doc_id % 2 = 0)
    SELECT source_id, target_id, round(least(1.0, coalesce((SELECT max(e.weight) FROM e WHERE e.source_id = p.source_id AND e.target_id = p.target_id), 0) + 0.1 * times), 6)::DOUBLE AS weight FROM p""",
)
def reinforced_edges(t: Tables):
    cited = t.labels.where("quality = 1").select(F.floor(F.col("doc_id") / 20).alias("g"), F.col("doc_id").cast("string").alias("id"))
    back = t.documents.where("doc_id % 2 = 0").select((F.col("doc_id") + 1).cast("string").alias("source_id"), F.col("doc_id").cast("string").alias("target_id"), F.lit("RelatedTo").alias("relation"), F.lit(0.55).alias("weight"))
    edges = analytics.unit_edges(t).unionByName(back)
    return retrieval.reinforced_edges(cited, edges, "g").select("source_id", "target_id", "weight")


@query("R25", "SELECT id, round(coalesce(CASE WHEN doc_id % 2 = 0 THEN (doc_id % 10) / 10.0 END, importance), 6)::DOUBLE AS score FROM units", "units")
def external_rerank(t: Tables):
    external = t.documents.where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") % 10 / 10).alias("external"))
    return t.units.join(external, "id", "left").select("id", F.round(F.coalesce("external", "importance"), 6).alias("score"))


@query("R23", "SELECT id FROM units WHERE contains(lower(content), 'the') AND domain IN ('agent', 'user') ORDER BY transaction_time DESC, id LIMIT 20", "units")
def local_text_mode(t: Tables):
    rows = t.units.where(F.contains(F.lower("content"), F.lit("the")) & F.col("domain").isin("agent", "user"))
    return rows.orderBy(F.desc("transaction_time"), "id").limit(20).select("id")

