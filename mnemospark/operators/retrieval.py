"""Hybrid retrieval for a batch of queries: vector and BM25 candidates, fusion, graph
expansion, re-ranking, semantic de-duplication.

``queries`` is a stated batch (``query_id``, and ``text`` or ``vector``), so it is broadcast;
units are scanned once for the whole batch. Ranks are made total by the unit id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.shared import small, written
from ..functions.text import keyword_overlap, search_tokens
from ..functions.times import WEIGHTS, recency, weighted
from ..functions.vectors import cosine

MAX_QUERIES = 10_000  # of one batch: what is broadcast stays bounded
RRF_K = 60
BM25_K1, BM25_B = 1.2, 0.75
EXPAND_FRONTIER, EXPAND_RESULTS = 10, 500
FEW_NODES = 1_000_000  # ids that are broadcast
LINK_THRESHOLD = 0.6
SAME_MEANING = 0.92
SHARED_FACTOR = 0.7


def batch(queries: DataFrame) -> DataFrame:
    """A checked, broadcastable batch of queries."""
    n = queries.limit(MAX_QUERIES + 1).count()
    if n > MAX_QUERIES:
        raise ValueError(f"a batch holds at most {MAX_QUERIES} queries")
    return F.broadcast(queries)


def top_k(hits: DataFrame, k: int, by: str = "query_id", score: str = "score") -> DataFrame:
    """Best ``k`` of each query with ``rank`` from 0; ties by id. Spark keeps ``k`` rows a
    query and task before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc("id"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def vector_candidates(units: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, score)``: the ``k`` nearest of each task's rows, by ``1 / (1 + d)`` of
    the squared distance in double precision, six decimals. Blocks of rows meet the block of
    queries in one matrix product; units without a vector of the queries' length never match."""
    rows = queries.select("query_id", "vector").limit(MAX_QUERIES + 1).collect()
    if len(rows) > MAX_QUERIES:
        raise ValueError(f"a batch holds at most {MAX_QUERIES} queries")
    id_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {id_type}, id string, score double"
    if not rows:
        return units.sparkSession.createDataFrame([], schema)
    block = np.array([r["vector"] for r in rows], np.float64)
    held = units.sparkSession.sparkContext.broadcast(([r["query_id"] for r in rows], block))
    key = to_arrow_type(queries.schema["query_id"].dataType)

    def near(batches):
        qids, q = held.value
        for b in batches:
            lists = b.column(1).combine_chunks() if isinstance(b.column(1), pa.ChunkedArray) else b.column(1)
            ok = np.flatnonzero(np.diff(lists.offsets.to_numpy()) == q.shape[1])
            if not len(ok):
                continue
            kept = lists.take(pa.array(ok))
            v = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, q.shape[1])
            ids = b.column(0).take(pa.array(ok)).to_pylist()
            out = ([], [], [])
            # differences, not products: near vectors keep their digits
            for n, x in enumerate(q):
                d = v - x
                score = np.round(1 / (1 + np.einsum("ij,ij->i", d, d)), 6)
                best = range(len(ids)) if len(ids) <= k else np.flatnonzero(score >= np.partition(score, -k)[-k])
                for i in best:
                    out[0].append(qids[n])
                    out[1].append(ids[i])
                    out[2].append(float(score[i]))
            columns = [pa.array(x, t) for x, t in zip(out, (key, pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "score"])

    rows = units.where(F.col("embedding").isNotNull()).select("id", "embedding")
    return rows.mapInArrow(near, schema)


def vector_top_k(units: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return top_k(vector_candidates(units, queries, k), k)


def text_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{IsAlphabetic}\p{N}]+"), F.lit(0))


def bm25(units: DataFrame, queries: DataFrame, matching: DataFrame | None = None) -> DataFrame:
    """``(query_id, id, score)`` of every unit that holds a query term. Statistics are those of
    all ``units``; ``matching`` (ids), if given, only filters the answer. Texts are read once:
    postings of the batch's terms and one length a unit (its row without a term) leave each task,
    never whole token lists; the statistics come from the written lengths."""
    terms = queries.select("query_id", F.explode(F.array_distinct(text_terms(F.col("text")))).alias("term"))
    terms = written(terms, "query-terms")
    wanted = F.broadcast(terms.select(F.col("term").alias("wanted")).distinct())
    # bound to a variable before use: the token list is made once a row
    tokens = F.get(F.transform(F.array(text_terms(F.col("content"))), lambda x: F.struct(F.size(x).alias("len"), x.alias("tokens"))), 0)
    words = units.select("id", tokens.alias("t")).select("id", "t.len", F.explode(F.concat(F.array(F.lit("")), F.coalesce("t.tokens", F.array().cast("array<string>")))).alias("term"))
    words = words.join(wanted, F.col("term") == F.col("wanted"), "left").where("wanted is not null or term = ''")
    tf = words.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    tf = written(tf, "postings")
    stats = tf.where("term = ''").agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("tf") * F.col("len")) / F.sum(F.when(F.col("len").isNotNull(), F.col("tf")))).alias("avg_len"))
    tf = tf.where("term <> ''")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = F.broadcast(terms.join(df, "term").crossJoin(stats).select("query_id", "term", idf.alias("idf"), "avg_len"))
    if matching is not None:
        tf = tf.join(matching, "id", "left_semi")
    part = F.col("idf") * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("len") / F.col("avg_len")))
    hits = tf.join(weights, "term").groupBy("query_id", "id").agg(F.sum(part).alias("score"))
    return hits.withColumn("score", F.round("score", 6))


def bm25_top_k(units: DataFrame, queries: DataFrame, k: int, matching: DataFrame | None = None) -> DataFrame:
    return top_k(bm25(units, queries, matching), k)


def merge_tiers(tiers: list[DataFrame], k: int) -> DataFrame:
    """Earlier tiers first, an id once a query, at most ``k``: recent rows ahead of indexed ones."""
    rows = None
    for n, tier in enumerate(tiers):
        part = tier.select("query_id", "id", "rank", F.lit(n).alias("tier"))
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy("query_id", "id").agg(F.min(F.struct("tier", "rank")).alias("x")).select("query_id", "id", "x.*")
    w = Window.partitionBy("query_id").orderBy("tier", "rank", "id")
    out = first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return out.select("query_id", "id", "tier", (F.col("place") - 1).alias("rank"))


def fuse(lists: list[tuple[DataFrame, float]], normalise: bool = True) -> DataFrame:
    """Reciprocal rank fusion ``weight / (60 + rank)`` summed over lists, divided by the best
    of each query. All lists are top-k, so this is small."""
    rows = None
    for hits, weight in lists:
        part = hits.select("query_id", "id", (weight / (RRF_K + F.col("rank"))).alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", "id").agg(F.sum("s").alias("score"))
    if normalise:
        best = F.max("score").over(Window.partitionBy("query_id"))
        fused = fused.withColumn("score", F.col("score") / best)
    return fused.withColumn("score", F.round("score", 6))


def expand(hits: DataFrame, edges: DataFrame, known: DataFrame, depth: int, threshold: float = LINK_THRESHOLD) -> DataFrame:
    """Neighbours of the hits over ``depth`` hops, either way along edges: derived and evolved
    ones always, related ones above ``threshold``. A query's frontier is its best ten nodes (of
    the hop before, by edge weight then id), and it stops above 500 results. Found nodes must be
    in ``known`` (ids), score ``0.8 ** (hop + 1) * 0.8``, and never replace a hit. A hub's
    neighbours are as many rows, broadcast only if they are few."""
    follows = F.col("relation").isin("DerivedFrom", "EvolvedTo") | ((F.col("relation") == "RelatedTo") & (F.col("weight") > threshold))
    ways = [F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("source_id", "target_id"), ("target_id", "source_id"))]
    both = edges.where(follows).select(F.explode(F.array(*ways)).alias("x"), "weight").select("x.a", "x.b", "weight")
    found = written(hits.select("query_id", "id", "score"), "seeds")  # top-k: a batch's few rows
    frontier = found.withColumn("order", F.col("score"))
    for hop in range(depth):
        open_queries = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") <= EXPAND_RESULTS).select("query_id")
        w = Window.partitionBy("query_id").orderBy(F.desc("order"), "id")
        best = frontier.join(open_queries, "query_id").withColumn("n", F.row_number().over(w)).where(F.col("n") <= EXPAND_FRONTIER)
        # the frontier is at most ten rows a query, so it goes to the edges
        step = both.join(F.broadcast(best.select("query_id", F.col("id").alias("a"))), "a")
        step = step.groupBy("query_id", F.col("b").alias("id")).agg(F.max("weight").alias("order"))
        step = step.join(found.select("query_id", "id"), ["query_id", "id"], "left_anti")
        step = written(step, "hop")
        # found nodes must be units: the ids of few nodes are looked up in one pass without a shuffle
        ids = step.select("id").distinct()
        few = ids.limit(FEW_NODES + 1).count() <= FEW_NODES
        ids = known.join(F.broadcast(ids) if few else ids, "id", "left_semi")
        step = step.join(F.broadcast(ids) if few else ids, "id", "left_semi")
        if hop + 1 < depth:
            step = written(step, "hop")  # read again by the next
        found = found.unionByName(step.select("query_id", "id", F.lit(0.8 ** (hop + 1) * 0.8).alias("score")))
        frontier = step
    return found


def rerank(hits: DataFrame, units: DataFrame, as_of: Column, min_score: float, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Hits joined to their units, scored by similarity, importance and recency, six decimals;
    those below ``min_score`` go. Hits are broadcast by the caller where their number is bounded."""
    rows = units.join(hits, "id")
    score = weighted(F.col("score"), F.col("importance"), recency("transaction_time", as_of), weights)
    return rows.withColumn("score", F.round(score, 6)).where(F.col("score") >= min_score)


def drop_same_meaning(hits: DataFrame, limit: int, threshold: float = SAME_MEANING) -> DataFrame:
    """Greedy: a hit stays if its cosine with every kept, better hit is at most ``threshold``;
    hits without a vector stay. Only the best ``max(4 * limit, 20)`` of a query take part, so a
    group is small; at most ``2 * limit`` remain."""
    import pandas as pd

    cap = max(4 * limit, 20)
    best = top_k(hits, cap).select("query_id", "id", "score", "embedding")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
        kept, vectors = [], []
        for n, v in enumerate(pdf["embedding"]):
            if v is not None and len(v):
                v = np.asarray(v, np.float64)
                size = np.linalg.norm(v)
                v = v / size if size > 0 else v
                if any(len(v) == len(o) and v @ o > threshold for o in vectors):
                    continue
                vectors.append(v)
            kept.append(n)
        return pdf.iloc[kept][["query_id", "id", "score"]]

    schema = best.drop("embedding").schema
    return top_k(best.groupBy("query_id").applyInPandas(fold, schema), 2 * limit)


def hybrid(
    units: DataFrame, edges: DataFrame, queries: DataFrame, as_of: Column, limit: int, depth: int = 1, min_score: float = 0.3, threshold: float = LINK_THRESHOLD, same: float = SAME_MEANING,
) -> DataFrame:
    """The whole native pipeline: ``(query_id, id, score, rank)``, at most ``2 * limit`` each.
    ``units`` are the visible ones in scope; without vectors it answers from text alone."""
    lists = [(bm25_top_k(units, queries, 2 * limit), 1.0)]
    if "vector" in queries.columns and "embedding" in units.columns:
        lists.insert(0, (vector_top_k(units, queries.where("vector is not null"), 2 * limit), 1.0))
    seeds = top_k(fuse(lists), 3 * limit)
    known = units.select("id")
    found = expand(seeds, edges, known, depth, threshold)
    return drop_same_meaning(rerank(small(found), units, as_of, min_score), limit, same)


def with_shared(native: DataFrame, shared: DataFrame, policies: DataFrame, limit: int, min_score: float, same: float = SAME_MEANING) -> DataFrame:
    """Native hits and, for queries whose user consumes, organization hits at 0.7 of their
    score; an id once, by its best score; same meanings dropped; at most ``limit``.
    All carry ``query_id, id, score, embedding``; ``policies`` has query_id and consume."""
    allowed = shared.join(policies.where("consume").select("query_id"), "query_id", "left_semi")
    allowed = allowed.withColumn("score", F.round(F.col("score") * SHARED_FACTOR, 6))
    rows = native.withColumn("kind", F.lit("native")).unionByName(allowed.withColumn("kind", F.lit("organization")))
    best = rows.groupBy("query_id", "id").agg(F.max_by(F.struct("score", "embedding", "kind"), F.struct("score", "kind")).alias("x"))
    best = best.select("query_id", "id", "x.*").where(F.col("score") >= min_score)
    kept = drop_same_meaning(best, limit, same).where(F.col("rank") < limit)
    return kept.join(best.select("query_id", "id", "kind"), ["query_id", "id"])


def organization_scores(records: DataFrame, queries: DataFrame, k: int, min_score: float) -> DataFrame:
    """Organization records for a batch: 0.7 cosine + 0.3 word overlap where both are above
    zero, else whichever is."""
    q = queries.withColumn("terms", search_tokens("text"))
    rows = records.crossJoin(batch(q.drop("text")))  # a stated batch against all records
    lexical = keyword_overlap("terms", "content", "keywords")
    has = "vector" in queries.columns and "embedding" in records.columns
    semantic = F.greatest(F.lit(0.0), F.coalesce(cosine("embedding", "vector"), F.lit(0.0))) if has else F.lit(0.0)
    rows = rows.select("query_id", "id", lexical.alias("l"), semantic.alias("s"))
    both = F.when((F.col("s") > 0) & (F.col("l") > 0), 0.7 * F.col("s") + 0.3 * F.col("l")).otherwise(F.greatest("s", "l"))
    rows = rows.select("query_id", "id", F.round(both, 6).alias("score")).where(F.col("score") >= min_score)
    return top_k(rows, k)


def needs_arbitration(hits: DataFrame, gap: float = 0.25) -> DataFrame:
    """Queries with two hits or more whose best two are less than ``gap`` apart."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    rows = hits.withColumns({"next": F.lead("score").over(w), "n": F.row_number().over(w)})
    rows = rows.where("n = 1 and next is not null")
    return rows.select("query_id", F.round(F.col("score") - F.col("next"), 6).alias("gap")).withColumn("arbitrate", F.col("gap") < gap)


def auto_links(units: DataFrame, queries: DataFrame, k: int = 5, threshold: float = LINK_THRESHOLD) -> DataFrame:
    """``RelatedTo`` edges from each new unit to its nearest others above ``threshold``."""
    near = vector_top_k(units, queries, k).where((F.col("score") > threshold) & (F.col("id") != F.col("query_id").cast("string")))
    return near.select(F.col("query_id").cast("string").alias("source_id"), F.col("id").alias("target_id"), F.lit("RelatedTo").alias("relation"), F.col("score").alias("weight"))


def feedback_weight(rows: DataFrame, by: str, order: str, cited: str, start: float = 1.0) -> DataFrame:
    """Similarity weight after each list: one hundredth up for a cited hit and down for
    another, held within 0.1 and 2 after every step, so order matters."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = rows.select(by, order, F.coalesce(F.col(cited), F.lit(False)).alias("_up"))
    cols = cols.repartitionByRange(parts, by, order).sortWithinPartitions(by, order)
    kind = to_arrow_type(rows.schema[by].dataType)

    def fold(batches):
        """A run of steps is again "add, then keep within two bounds": one row a key and part."""
        runs: list[list] = []
        for batch in batches:
            for who, up in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if not runs or runs[-1][0] != who:
                    runs.append([who, 0.0, -np.inf, np.inf])
                run, by_step = runs[-1], 0.01 if up else -0.01
                run[1] += by_step
                run[2], run[3] = (min(2.0, max(0.1, x + by_step)) for x in run[2:])
        who, *rest = zip(*runs) if runs else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(who, kind), *(pa.array(x, pa.float64()) for x in rest)], names=[by, "add", "low", "high"])

    schema = f"{by} {rows.schema[by].dataType.simpleString()}, add double, low double, high double"
    runs = cols.mapInArrow(fold, schema).withColumn("part", F.spark_partition_id())
    lists = runs.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("part", "add", "low", "high"))).alias("xs"))  # one a part at most
    move = lambda w, x: F.greatest(x["low"], F.least(x["high"], w + x["add"]))
    return lists.select(by, F.round(F.aggregate("xs", F.lit(start), move), 6).alias("weight"))


def reinforced_edges(cited: DataFrame, edges: DataFrame, by: str, step: float = 0.1) -> DataFrame:
    """Edges both ways between hits cited together, a tenth above their weight, at most 1."""
    a, b = cited.select(by, F.col("id").alias("source_id")), cited.select(by, F.col("id").alias("target_id"))
    pairs = a.join(b, by).where("source_id <> target_id").groupBy("source_id", "target_id").agg(F.count("*").alias("times"))
    now = edges.where("relation = 'RelatedTo'").groupBy("source_id", "target_id").agg(F.max("weight").alias("weight"))
    rows = pairs.join(now, ["source_id", "target_id"], "left")
    weight = F.least(F.lit(1.0), F.coalesce("weight", F.lit(0.0)) + step * F.col("times"))
    return rows.select("source_id", "target_id", F.lit("RelatedTo").alias("relation"), F.round(weight, 6).alias("weight"))
