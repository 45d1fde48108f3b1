"""Operators at the reference settings, on small hand-made inputs, and their odd cases."""

import random

import pytest
from pyspark.sql import functions as F

from mnemospark.engine import Engine
from mnemospark.functions import ids, text, times, vectors
from mnemospark.functions.components import connected_components
from mnemospark.functions.ranges import range_bucket
from mnemospark.functions.shared import gapless_rank
from mnemospark.operators import community, context, correction, graph, ingest, lifecycle, organization, retrieval, stats
from mnemospark.sources import tables

AS_OF = "2024-01-31 00:00:00"


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


# --- functions -------------------------------------------------------------------------


@pytest.mark.parametrize("said,n", [("", 0), ("hello", 2), ("abcd efgh", 2), ("你好 world", 4), ("a,b", 3), ("éàü", 2), ("   ", 0)])
def test_count_tokens(spark, said, n):
    assert one(spark, text.count_tokens("t"), t=said) == n


def test_search_tokens(spark):
    assert one(spark, text.search_tokens("t"), t="Rust和Go, rust 我喜欢") == ["rust", "和", "go", "我喜", "喜欢", "我喜欢"]


def test_first_person(spark):
    assert one(spark, text.neutralise_first_person("t"), t="I think (our) plan, mine!") == "the contributor think (the organization's) plan, the contributor's!"


def test_truncation_fits_and_is_longest(spark):
    said = "some words of a text, and more words " * 5
    cut = one(spark, text.truncate_to_tokens("t", 15), t=said)
    assert cut.endswith("...") and one(spark, text.count_tokens("t"), t=cut) <= 15
    longer = " ".join(said.split())[: len(cut) + 2] + "..."
    assert one(spark, text.count_tokens("t"), t=longer) > 15
    assert one(spark, text.truncate_to_tokens("t", 0), t=said) == "" and one(spark, text.truncate_to_tokens("t", 9), t="short") == "short"


def test_cosine_edge_cases(spark):
    pair = lambda a, b: one(spark, vectors.cosine(F.lit(a).cast("array<float>"), F.lit(b).cast("array<float>")), z=1)
    assert pair([1.0, 0.0], [0.0, 0.0]) == 0 and pair([1.0, 0.0, 9.0], [2.0, 0.0]) == 1 and pair([1.0], [-2.0]) == -1


def test_recency_of_the_future_is_above_one(spark):
    later = one(spark, times.recency(F.lit("2024-02-07").cast("timestamp_ntz"), times.ts(AS_OF)), z=1)
    assert later == 2.0


def test_ids(spark):
    assert one(spark, ids.shard_of(F.lit("user1"), 1), z=1) == 0
    assert one(spark, ids.namespace_key(F.lit("org"), F.lit(None), F.lit("u"), F.lit(None)), z=1) == "org:_global"
    assert one(spark, ids.relation_name(F.lit("Unheard")), z=1) == "RelatedTo"
    assert [one(spark, ids.valid_id("t"), t=x) for x in ("ok", "a\tb", "a\nb", "it's", "a--b", "", "x" * 257)] == [True, True, False, False, False, False, False]


def test_gapless_rank_of_ties_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(x,) for x in [3, 1, None, 1, 2, None, 1]], "x int")
    got = gapless_rank(rows, [F.col("x").asc()]).collect()
    assert sorted(r["rank"] for r in got) == list(range(7)) and sorted(r["rank"] for r in got if r.x is None) == [0, 1]
    assert gapless_rank(rows.limit(0), [F.col("x").asc()]).count() == 0


def test_range_buckets_are_ordered(spark):
    rows = spark.range(10000).select((F.col("id") * 7919 % 10007).alias("v"))
    got = rows.withColumn("b", range_bucket(rows, "v", 200)).groupBy("b").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).orderBy("b").collect()
    assert all(a.hi < b.lo for a, b in zip(got, got[1:])) and max(r.n for r in got) < 200


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(500 + i, 501 + i) for i in range(60)] + [(7, None), (9, 9)]
    parent = list(range(700))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if b is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {i: root(i) for a, b in edges if b is not None and a != b for i in (a, b)}


# --- retrieval -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def memory(spark):
    hot = lambda i: [1.0 if j == i else 0.0 for j in range(4)]
    rows = [
        ("a", "u1", "o1", "rust async runtime", hot(0), 0.9, 1, "2024-01-30"), ("b", "u1", "o1", "rust async runtimes", [0.99, 0.1, 0.0, 0.0], 0.5, 1, "2024-01-30"),
        ("c", "u1", "o1", "cooking sushi at home", hot(1), 0.1, 1, "2023-01-01"), ("d", "u1", None, "garden plans", None, 0.4, 1, "2024-01-20"),
        ("e", "u2", "o1", "rust for embedded systems", hot(2), 0.7, 2, "2024-01-29"),
    ]
    units = spark.createDataFrame(rows, "id string, user_id string, org_id string, content string, embedding array<float>, importance double, level int, at string")
    return units.select(
        "*", F.col("at").cast("timestamp_ntz").alias("transaction_time"), F.col("at").cast("timestamp_ntz").alias("valid_time"), F.lit("user").alias("domain"), F.lit("factual").alias("memory_type"),
        F.array(F.lit("k")).alias("keywords"), F.when(F.col("level") == 2, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>")).alias("references"), F.lit(None).cast("string").alias("agent_id"),
    ).drop("at")


@pytest.fixture(scope="module")
def links(spark):
    return spark.createDataFrame([("c", "a", "DerivedFrom", 0.1), ("d", "c", "RelatedTo", 0.7), ("e", "d", "RelatedTo", 0.5)], "source_id string, target_id string, relation string, weight double")


def queries_of(spark):
    return spark.createDataFrame([(1, "rust runtime", [1.0, 0.0, 0.0, 0.0])], "query_id int, text string, vector array<float>")


def test_vector_scores_and_missing_vectors(spark, memory):
    got = {r.id: r.score for r in retrieval.vector_top_k(memory, queries_of(spark), 10).collect()}
    assert got["a"] == 1.0 and got["c"] == round(1 / 3, 6) and "d" not in got
    assert retrieval.vector_top_k(memory, queries_of(spark).limit(0), 10).count() == 0


def test_hybrid_drops_same_meaning_and_expands(spark, memory, links):
    hits = [r.id for r in retrieval.hybrid(memory, links, queries_of(spark), times.ts(AS_OF), 10).orderBy("rank").collect()]
    assert hits[0] == "a" and "b" not in hits  # cosine 0.995 with a better hit
    found = {r.id: r.score for r in retrieval.expand(spark.createDataFrame([(1, "a", 1.0)], "query_id int, id string, score double"), links, memory.select("id"), 3).collect()}
    assert found == {"a": 1.0, "c": 0.8 * 0.8, "d": 0.8**2 * 0.8}  # e hangs on a weak link


def test_text_only_without_vectors(spark, memory, links):
    hits = retrieval.hybrid(memory.drop("embedding").withColumn("embedding", F.lit(None).cast("array<float>")), links, queries_of(spark), times.ts(AS_OF), 5, 0)
    assert {r.id for r in hits.collect()} == {"a", "b", "e"}


def test_shared_hits_need_consent(spark, memory):
    base = memory.select("id", "embedding")
    native = spark.createDataFrame([(1, "a", 1.0)], "query_id int, id string, score double").join(base, "id")
    shared = spark.createDataFrame([(1, "e", 1.0)], "query_id int, id string, score double").join(base, "id")
    for consume, want in ((True, {"a": 1.0, "e": 0.7}), (False, {"a": 1.0})):
        policy = spark.createDataFrame([(1, consume)], "query_id int, consume boolean")
        assert {r.id: r.score for r in retrieval.with_shared(native, shared, policy, 5, 0.3).collect()} == want


def test_feedback_is_clamped_in_order(spark):
    rows = spark.createDataFrame([(1, n, n < 3) for n in range(200)], "g int, n int, cited boolean")
    assert retrieval.feedback_weight(rows, "g", "n", "cited").first().weight == 0.1


def test_budget_skips_and_continues(spark):
    rows = spark.createDataFrame([(1, i, s, c) for i, s, c in (("a", 4.0, 50), ("b", 3.0, 60), ("c", 2.0, 30), ("d", 1.0, 20))], "q int, id string, score double, cost int")
    kept = context.greedy_budget(rows, "q", [F.desc("score")], "cost", 100)
    assert {r.id for r in kept.collect()} == {"a", "c", "d"}


def test_context_stays_within_budget(spark, memory):
    hits = memory.withColumns({"query_id": F.lit(1), "score": F.col("importance")})
    for xml in (False, True):
        for budget in (30, 70, 400, 2000):
            r = context.render(hits, "query_id", budget, xml).first()
            assert r.used_tokens <= max(budget, 8) and r.included <= r.matched == 5
            assert r.truncated or r.included == 5
    assert context.render(hits, "query_id", 2000, True).first().context.endswith("</memory_context>")


# --- graph and communities -------------------------------------------------------------


def test_latest_edge_wins_then_heavier(spark):
    rows = [("u", "a", "b", "RelatedTo", 0.3, 1), ("u", "a", "b", "RelatedTo", 0.2, 2), ("u", "a", "b", "RelatedTo", 0.9, 2), ("u", "a", "b", "EvolvedTo", 0.1, 0)]
    got = graph.latest_edges(spark.createDataFrame(rows, "user_id string, source_id string, target_id string, relation string, weight double, transaction_time int"))
    assert {(r.relation, r.weight) for r in got.collect()} == {("RelatedTo", 0.9), ("EvolvedTo", 0.1)}


def two_cliques(spark):
    rows = [("u", f"{c}{i}", f"{c}{j}", 1.0) for c in "xy" for i in range(6) for j in range(i)] + [("u", "x0", "y0", 0.1)]
    return spark.createDataFrame(rows, "user_id string, source_id string, target_id string, weight double")


def test_communities_find_two_cliques(spark):
    edges = two_cliques(spark)
    want = [{f"{c}{i}" for i in range(6)} for c in "xy"]
    for labels in (community.label_propagation(edges, 10, True), community.louvain(edges).drop("user_id"), community.two_phase(edges, 3).drop("phase_one")):
        groups = {}
        for r in labels.collect():
            groups.setdefault(r.community, set()).add(r.node)
        assert sorted(groups.values(), key=min) == want
        assert graph.modularity(edges, labels).first().modularity > 0.4
    assert community.label_propagation(edges.limit(0)).count() == 0


def test_reach_ends_and_counts_depth(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 0.1)], "source_id string, target_id string, weight double")
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in graph.reach(edges, start, 9, 0.5).collect()} == {("a", 0), ("b", 1), ("c", 2)}


# --- lifecycle -------------------------------------------------------------------------


def test_prune_keeps_what_insights_refer_to(spark, memory):
    none = spark.createDataFrame([], "target_kind string, target_id string")
    same_user = memory.withColumn("user_id", F.lit("u1"))
    assert {r.id for r in lifecycle.prune(same_user, none, 0.45).collect()} == {"d"}
    gone = spark.createDataFrame([("memory_unit", "e")], "target_kind string, target_id string")
    assert {r.id for r in lifecycle.prune(same_user, gone, 0.45).collect()} == {"c", "d"}


def test_missing_dependency_blocks(spark):
    rows = [(1, "Completed", []), (2, "Pending", [1]), (3, "Pending", [2]), (4, "Pending", [99]), (5, "Pending", []), (6, "InProgress", [])]
    tasks = spark.createDataFrame(rows, "task_id int, status string, dependencies array<int>")
    assert {r.task_id for r in lifecycle.ready_tasks(tasks).collect()} == {2, 5}


def test_packs_split_on_count_and_tokens(spark):
    rows = [("k", n, t) for n, t in enumerate([10, 10, 10, 95, 200, 5, 5])] + [("l", 0, 1)]
    events = spark.createDataFrame(rows, "k string, n int, tok long")
    got = {(r.k, r.n): r.seq_no for r in ingest.pack_events(events, ["k"], ["n"], "tok", 3, 100).collect()}
    assert [got["k", n] for n in range(7)] == [0, 0, 0, 1, 2, 3, 3] and got["l", 0] == 0


def test_engine_end_to_end(spark, memory, links):
    none = spark.createDataFrame([], "target_kind string, target_id string")
    edges = links.withColumns({"user_id": F.lit("u"), "transaction_time": F.lit(1)})
    events = spark.createDataFrame([("c", "u1", "s", "Text", "said a", None, 1), ("x", "u1", "s", "Text", "said b", None, 2)], "id string, user_id string, stream_id string, kind string, data string, agent_id string, transaction_time int")
    engine = Engine(spark, {"units": memory, "edges": edges, "tombstones": none, "events": events, "policies": spark.createDataFrame([("u2", True)], "user_id string, contribute boolean")}, AS_OF)
    assert {r.id for r in engine.retrieve(queries_of(spark), 3, token_budget=100, user="u1").collect()} >= {"a"}
    preview = engine.forget_preview(spark.createDataFrame([("e",)], "id string"))
    assert {(r.kind, r.id) for r in preview.collect()} == {("unit", "e"), ("event", "c")}
    after = engine.forget(preview, "asked")
    assert "e" not in {r.id for r in after.scoped().collect()}
    assert engine.org_knowledge().first().sources == 1
    assert engine.consolidate().first().content == "Message 1: said a\nMessage 2: said b"
    assert engine.stats().first().total == 5 and engine.context(queries_of(spark), 200).count() == 1


# --- corrections, organization, tables -------------------------------------------------


def test_decisions_in_order(spark):
    rows = [
        ("obsolete", 0.69, "update", True, False, False, "obsolete_low_confidence"), ("obsolete", 0.9, "update", True, True, False, "target_newer_than_source"),
        ("obsolete", 0.9, "update", False, False, False, "fact_slots_mismatch"), ("obsolete", 0.9, "addition", True, False, False, "change_type_not_replacement_safe"),
        ("obsolete", 0.84, "update", True, False, False, "obsolete_relation_only_due_to_confidence"), ("obsolete", 0.85, "negation", True, False, False, None),
        ("contradicts", 0.1, "negation", True, True, False, None), ("contradicts", 0.9, "update", True, False, False, "change_type_not_contradiction_safe"),
        ("reaffirm", 1.0, "update", True, False, False, "reaffirm_no_mutation"), ("obsolete", 0.9, "update", True, False, True, "target_missing"),
    ]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, kind string, confidence double, change_type string, slots_match boolean, target_newer boolean, target_missing boolean, want string")
    got = correction.decide(df).orderBy("n").collect()
    assert [r.guard_reason for r in got] == [r.want for r in got]
    assert [r.effect for r in got] == ["rejected"] * 4 + ["relation_only", "tombstone", "relation_only", "rejected", "noop", "rejected"]


def test_org_merge_is_transitive(spark):
    rows = [("s1", "o", ["rust", "async"]), ("s2", "o", ["Async!", "tokio"]), ("s3", "o", ["TOKIO"]), ("s4", "o", ["go"]), ("s5", "p", ["rust"])]
    units = spark.createDataFrame(rows, "id string, org_id string, keywords array<string>").withColumn("content", F.lit("one two three"))
    candidates = organization.topic_candidates(units)
    got = {r.id: r.record for r in organization.merge_sources(candidates).collect()}
    assert got == {"s1": "s1", "s2": "s1", "s3": "s1", "s4": "s4", "s5": "s5"}
    topic = organization.elect_topics(candidates.where("org_id = 'o'"), ["org_id"]).first()
    assert topic.topic_key == "tokio" or topic.topic_key == "async"


def test_upsert_and_snapshot(spark, tmp_path):
    table = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id int, v string, version int")
    changes = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, "e", 1)], "id int, v string, version int")
    got = tables.upsert(table, changes, ["id"], "version")
    assert {(r.id, r.v) for r in got.collect()} == {(1, "c"), (2, "b"), (3, "e")}
    tables.export_snapshot({"t": got}, str(tmp_path))
    assert tables.restore_snapshot(spark, str(tmp_path), ["t"])["t"].count() == 3
    assert tables.schema_status(got, dict(got.dtypes), {}) == "current" and tables.schema_status(got, {}, {}) == "mismatch"


def test_merge_counts_ignores_missing_parts(spark):
    parts = spark.createDataFrame([("x", 1, True, 3), ("x", None, False, 9), ("x", 2, True, 4)], "k string, n int, ok boolean, seq int")
    r = stats.merge_counts(parts, ["k"], ["n"], ["ok"], ["seq"]).first()
    assert (r.n, r.ok, r.seq) == (3, False, 9)


def test_hooks_without_and_with_a_model(spark, memory):
    from mnemospark.operators.hooks import Hooks, consolidated, plan_goals, reranked, semantic_links

    hits = spark.createDataFrame([(1, "a", 0.5), (1, "e", 0.4)], "query_id int, id string, score double")
    assert reranked(hits, Hooks()).count() == 2 and semantic_links(memory, Hooks()).count() == 0
    model = Hooks(rerank=lambda df: df.where("id = 'e'").withColumn("external", F.lit(0.9)), milestones=lambda g: g.select(F.lit("m").alias("id"), F.col("id").alias("parent_id"), F.lit("do").alias("content")))
    assert {r.id: r.score for r in reranked(hits, model).collect()} == {"a": 0.5, "e": 0.9}
    goals = spark.createDataFrame([("g", 0), ("h", 5)], "id string, depth int")
    assert [(r.source_id, r.target_id) for r in plan_goals(goals, model)[1].collect()] == [("m", "g")]
    text = consolidated(hits.join(memory.select("id", "content"), "id"), "query_id").first().content
    assert text == "rust async runtime\nrust for embedded systems"
