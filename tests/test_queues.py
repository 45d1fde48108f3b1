"""Queues on hand-made rows; the folds among the queries against plain loops."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.engine import Engine
from mnemospark.functions import shared
from mnemospark.operators import facts, organization, queues, retrieval
from mnemospark.plans.catalog import QUERIES
from mnemospark.plans.fixtures import Tables

from .test_operators import AS_OF, links, memory, queries_of  # noqa: F401 - fixtures

SF = "/root/testdata/sf0.001"


def test_an_event_waits_once_until_it_is_done(spark):
    events = spark.createDataFrame([("a", "u", 1), ("a", "u", 1), ("b", "u", 2), ("c", "v", 3)], "id string, user_id string, transaction_time int")
    waiting = queues.pending(events, spark.createDataFrame([("c",)], "id string"))
    assert [tuple(r) for r in queues.active_users(waiting).collect()] == [("u", 2, 1)]


def test_no_pack_is_committed_past_a_failed_one(spark):
    packs = spark.createDataFrame([("k", 0, True), ("k", 1, None), ("k", 2, True), ("l", 0, True), ("l", 1, True)], "key string, seq_no int, ok boolean")
    assert {(r.key, r.seq_no) for r in queues.committable(packs, ["key"]).collect()} == {("k", 0), ("l", 0), ("l", 1)}


def test_publishing_and_hooks_happen_once(spark):
    now = F.lit(10)
    jobs = spark.createDataFrame([("a", 1, "Pending", [1.0]), ("a", 2, "Pending", [1.0]), ("b", 99, "Pending", [1.0]), ("c", 1, "Failed", [1.0]), ("d", 1, "Pending", None), ("e", 1, "Pending", [1.0])], "id string, due_at int, status string, embedding array<double>")
    done = spark.createDataFrame([("e",)], "id string")
    fresh = queues.publishable_now(jobs, done, now)
    assert [r.id for r in fresh.collect()] == ["a"]
    everything = fresh.select("id").union(done)
    assert {r.id for r in queues.hooks_due(everything, spark.createDataFrame([("a",)], "id string")).collect()} == {"e"}
    assert queues.publishable_now(jobs, everything, now).count() == 0


def test_overlay_drops_the_oldest_within_a_second_too(spark):
    rng = random.Random(1)
    rows = [(f"{n:03d}", 1_700_000_000 + rng.randrange(4), rng.randrange(1, 9)) for n in range(60)]
    docs = spark.createDataFrame(rows, "id string, at long, size int").withColumn("at", F.timestamp_seconds("at"))
    for most in (0, 7, 100, 10**6):
        kept, used = set(), 0
        for i, _, size in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True):
            used += size
            if used <= most:
                kept.add(i)
        assert {r.id for r in queues.overlay_within(docs, "at", "size", most).collect()} == kept


def test_flushes_and_requeued_writes(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), n, 1_700_000_000_000 + sum(rng.randrange(900) for _ in range(1)) + n * 400) for n in range(300)]
    edges = spark.createDataFrame(rows, "buffer string, source_id int, ms long").withColumn("at", F.timestamp_millis("ms"))
    want, state = {}, {}
    for who, n, ms in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        number, count, since = state.get(who, (0, 0, ms))
        if count >= 7 or ms - since >= 3000:
            number, count, since = number + 1, 0, ms
        want[n] = number
        state[who] = number, count + 1, since
    got = queues.flushes(edges, "buffer", "at", 7, 3)
    assert {r.source_id: r.flush for r in got.collect()} == want
    writes = spark.createDataFrame([("a", 0, False), ("a", 1, True), ("a", 2, False)], "buffer string, flush int, ok boolean")
    assert {r.flush: r.written_with for r in queues.requeued(writes, "buffer").collect()} == {0: 1, 1: 1, 2: None}


def test_busy_buffers_are_flushed_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows, ms = [], {"a": 0, "b": 0, None: 0, "few": 0}
    for n in range(1600):
        who = rng.choice(["a", "a", "b", None, "few"] if n < 20 else ["a", "a", "b", None])
        ms[who] += rng.choice([0, 0, 100, 400, 900, 4000 if n % 90 == 0 else 200])
        rows.append((who, n, None if n % 97 == 0 else 1_700_000_000_000 + ms[who]))
    edges = spark.createDataFrame(rows, "buffer string, source_id int, ms long").withColumn("at", F.timestamp_millis("ms"))
    for most, block, seconds in ((7, 40, 3), (50, 30, 60), (100, 10, 2), (4, 700, 7200)):
        want, state = {}, {}
        for who, n, at in sorted(rows, key=lambda r: (r[0] or "", r[2] is None, r[2] or 0, r[1])):
            number, count, since = state.get(who, (0, 0, at))
            if count >= most or (at is not None and since is not None and at - since >= seconds * 1000):
                number, count, since = number + 1, 0, at
            want[n] = number
            state[who] = number, count + 1, since
        monkeypatch.setattr(queues, "BLOCK_EDGES", block)
        got = queues.flushes(edges, "buffer", "at", most, seconds)
        assert got.columns == [*edges.columns, "flush"]
        assert {r.source_id: r.flush for r in got.collect()} == want
        cut = queues._in_blocks(edges.withColumn("_at", F.unix_micros("at")), "buffer", 800)[1]
        assert cut.select("buffer", "_block").distinct().count() > 1


def test_requeued_writes_look_beyond_their_range(spark, monkeypatch):
    monkeypatch.setattr(queues, "RANGE_FLUSHES", 4)
    rng = random.Random(6)
    rows = [(who, n, rng.random() < 0.15) for who in ("a", "b", None) for n in range(90)]
    want = {(who, n): min((m for w, m, ok in rows if w == who and m >= n and ok), default=None) for who, n, _ in rows}
    found = queues.requeued(spark.createDataFrame(rows, "buffer string, flush long, ok boolean"), "buffer")
    assert {(r.buffer, r.flush): r.written_with for r in found.collect()} == want
    # a frame from a row to the end is summed anew for each row: a day's writes would not end
    assert "UnboundedFollowing" not in found._jdf.queryExecution().analyzed().toString().replace("unboundedfollowing", "UnboundedFollowing")


def test_a_cluster_must_name_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())


def test_a_hub_is_expanded_whole(spark):
    edges = spark.range(100_000).select(F.lit("hub").alias("source_id"), F.col("id").cast("string").alias("target_id"), F.lit("DerivedFrom").alias("relation"), F.lit(1.0).alias("weight"))
    known = spark.range(50_000).select(F.col("id").cast("string").alias("id"))
    hits = spark.createDataFrame([(1, "hub", 1.0), (2, "7", 1.0)], "query_id int, id string, score double")
    found = retrieval.expand(hits, edges, known, 2).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in found} == {1: 50_001, 2: 1}


def test_feedback_over_many_parts_equals_a_loop(spark):
    rng = random.Random(3)
    rows = [(g, n, rng.random() < (0.9 if n // 150 % 2 else 0.1)) for g in range(3) for n in range(1200)]
    want = {}
    for g, _, cited in sorted(rows):
        want[g] = max(0.1, min(2.0, want.get(g, 1.0) + (0.01 if cited else -0.01)))
    got = retrieval.feedback_weight(spark.createDataFrame(rows, "g int, n int, cited boolean"), "g", "n", "cited")
    assert {r.g: r.weight for r in got.collect()} == {g: round(w, 6) for g, w in want.items()}


def test_search_modes(spark, memory, links):  # noqa: F811
    none = spark.createDataFrame([], "target_kind string, target_id string")
    edges = links.withColumns({"user_id": F.lit("u1"), "transaction_time": F.lit(1)})
    engine = Engine(spark, {"units": memory, "edges": edges, "tombstones": none}, AS_OF)
    records = spark.createDataFrame([("r1", "rust runtime handbook", ["k"], [0.0, 0.0, 0.0, 1.0])], "id string, content string, keywords array<string>, embedding array<float>")
    found = {m: [r.id for r in engine.search(queries_of(spark), m, 4, records).orderBy("rank").collect()] for m in ("text_local", "text", "text_shared", "vector", "hybrid")}
    assert found["text_local"][0] in "ab" and "r1" not in found["text_local"] and "r1" in found["text"] and found["text"] == found["text_shared"]
    assert found["vector"][0] == "a" and "r1" not in found["vector"] and "r1" in found["hybrid"] and found["hybrid"][0] == "a"


def test_superseded_edges_are_not_followed(spark, memory):  # noqa: F811
    edges = spark.createDataFrame([("u1", "a", "c", "RelatedTo", 0.9, 1), ("u1", "a", "c", "RelatedTo", 0.1, 2)], "user_id string, source_id string, target_id string, relation string, weight double, transaction_time int")
    engine = Engine(spark, {"units": memory, "edges": edges, "tombstones": spark.createDataFrame([], "target_kind string, target_id string")}, AS_OF)
    query = spark.createDataFrame([(1, "rust runtime", [1.0, 0.0, 0.0, 0.0])], "query_id int, text string, vector array<float>")
    far = memory.where("id <> 'c'").unionByName(memory.where("id = 'c'").withColumn("embedding", F.lit(None).cast("array<float>")))
    engine = Engine(spark, engine.tables | {"units": far}, AS_OF)
    assert "c" not in {r.id for r in engine.retrieve(query, 10).collect()}


def test_hard_forgetting_takes_the_events_too(spark, memory, links):  # noqa: F811
    events = spark.createDataFrame([("c", "x"), ("z", "y")], "id string, data string")
    tables = {"units": memory, "edges": links, "tombstones": spark.createDataFrame([], "target_kind string, target_id string"), "events": events}
    preview = spark.createDataFrame([("unit", "e"), ("event", "c")], "kind string, id string")
    after = Engine(spark, tables, AS_OF).forget(preview, "asked", "hard")
    assert [r.id for r in after["events"].collect()] == ["z"] and "e" not in {r.id for r in after["units"].collect()}


def test_a_mixed_centroid_is_the_representatives_vector(spark):
    rows = spark.createDataFrame([("g", [1.0, 2.0]), ("g", [3.0]), ("h", [1.0, 3.0]), ("h", None), ("h", [3.0, 5.0])], "k string, v array<double>")
    own = spark.createDataFrame([("g", [1.0, 2.0])], "k string, v array<double>")
    assert {r.k: r.centroid for r in organization.centroid(rows, "k", "v", own).collect()} == {"g": [1.0, 2.0], "h": [2.0, 4.0]}
    assert {r.k: r.centroid for r in organization.centroid(rows, "k", "v").collect()}["g"] is None


def test_hydration_keeps_the_first_of_a_key(spark):
    f = lambda v, c, p, canon="x": ("user", "user:self", "skill", v, canon, "skill_name", c, p)
    rows = [(1, "I also speak Finnish", [f("X", "update", 1), f("x", "update", 9), f("x", "addition", 2), f("y", "update", 3, None), f("y", "update", 4, None)], 1), (2, "I also speak Finnish", [], 1), (3, "I also speak Finnish", [], 2), (4, None, [], 1)]
    units = spark.createDataFrame(rows, f"n int, content string, extracted array<{facts.FACT}>, level int").withColumns({"domain": F.lit("user"), "agent_id": F.lit(None).cast("string")})
    got = {r.n: [(x.value, x.change_type, x.confidence) for x in r.facts] for r in facts.hydrate(units, "extracted").collect()}
    assert got == {1: [("X", "update", 1), ("x", "addition", 2), ("y", "update", 3)], 2: [("Finnish", "addition", 75)], 3: [], 4: []}


def test_facts_of_a_model_are_described(spark):
    f = lambda *x: dict(zip(("subject", "subject_ref", "subject_name", "attribute", "value", "canonical_value", "change_type", "temporal_status", "polarity", "evidence_span", "confidence"), x))
    rows = [
        (1, [f("Person", None, None, "home", "  New   Town ", None, "replaced?", None, None, None, 0.9), f("company", None, "Tidewater Studio", "job", "Ferry", None, "added", "past", None, None, 1.7), f("user", "user:self", None, "likes", "to row", None, "update", None, "false", None, 0.5)]),
        (2, [f("nobody", None, None, "home", "x", None, "update", None, None, None, 0.9), f("user", None, None, "shoe size", "x", None, "update", None, None, None, 0.9), f("user", None, None, "home", " ", None, "update", None, None, None, 0.9)]),
        (3, None),
    ]
    units = spark.createDataFrame(rows, f"n int, said array<{facts.STORED}>")
    got = {r.n: [tuple(x) for x in r.facts] for r in facts.described(units, "said").collect()}
    assert got == {
        1: [
            ("user", "user:self", "residence", "New Town", "new town", "city", "reaffirm", 90), ("organization", "organization:tidewater_studio", "employment", "Ferry", "ferry", "organization_name", "historical", 100),
            ("user", "user:self", "preference", "to row", "row", "freeform", "contradiction", 50),
        ],
        2: [], 3: [],
    }


def test_semantic_dedup_equals_a_loop(spark):
    t = Tables(spark, SF)
    rows = {r.vec_id: np.array(r.embedding, float) for r in t.embeddings.collect()}
    want = set()
    for q in (i for i in rows if i % 50 == 0):
        score = {i: round(1 / (1 + float(((v - rows[q]) ** 2).sum())), 6) for i, v in rows.items()}
        order = sorted(rows, key=lambda i: (-score[i], str(i)))[:80]
        kept = []
        for i in order:
            unit = lambda v: v / np.linalg.norm(v)
            if all(unit(rows[i]) @ unit(rows[j]) <= 0.25 for j in kept):
                kept.append(i)
        want |= {(q, str(i), n) for n, i in enumerate(kept[:40])}
    assert {(r.query_id, r.id, r.rank) for r in QUERIES["semantic_dedup"](spark, SF).collect()} == want


def test_label_propagation_equals_a_loop(spark):
    from mnemospark.operators import graph

    t = Tables(spark, SF)
    weight = defaultdict(float)
    for r in graph.latest_edges(t.edges).collect():
        if r.source_id != r.target_id:
            weight[r.source_id, r.target_id] += r.weight
            weight[r.target_id, r.source_id] += r.weight
    near = defaultdict(list)
    for (a, b), w in weight.items():
        near[a].append((b, w))
    label = {n: n for n in near}
    for _ in range(10):
        new = {}
        for n in near:
            votes = defaultdict(float)
            votes[label[n]] += max(w for _, w in near[n])
            for b, w in near[n]:
                votes[label[b]] += w
            new[n] = min(votes, key=lambda c: (-round(votes[c], 9), c))
        if new == label:
            break
        label = new
    sizes = defaultdict(int)
    for c in label.values():
        sizes[c] += 1
    assert {r.community: r.members for r in QUERIES["community_lpa"](spark, SF).collect()} == {c: n for c, n in sizes.items() if n >= 3}


def test_two_phases_only_split_and_louvain_gains(spark):
    from mnemospark.operators import community, graph

    t = Tables(spark, SF)
    edges = graph.latest_edges(t.edges)
    rows = QUERIES["community_two_phase"](spark, SF).collect()
    inside = defaultdict(set)
    for r in rows:
        inside[r.community].add(r.phase_one)
    assert all(len(x) == 1 for x in inside.values()) and len(rows) == len({r.node for r in rows})
    small = edges.where(F.col("source_id").isin(*[f"c{i}" for i in range(40)])).withColumn("user_id", F.lit("u"))
    found = community.louvain(small).select("node", "community")
    alone = found.select("node", F.col("node").alias("community"))
    value = lambda labels: graph.modularity(small, labels).first().modularity
    assert value(found) > max(0.2, value(alone))


def test_candidates_are_found_without_pairs_of_all_units(spark, monkeypatch):
    from mnemospark.operators import correction, retrieval

    monkeypatch.setattr(correction, "BLOCK_UNITS", 16)
    rng = random.Random(9)
    rows = [(f"i{n}", rng.choice(["u", "u", "v", None]), None if n % 31 == 0 else n // 3, " ".join(rng.choices("alpha beta gamma delta omega".split(), k=rng.randrange(1, 6)))) for n in range(150)]
    units = spark.createDataFrame(rows, "id string, user_id string, h int, content string")
    units = units.withColumn("transaction_time", F.timestamp_add("HOUR", "h", F.lit("2024-01-01").cast("timestamp_ntz"))).drop("h")
    new = units.where(F.substr("id", F.lit(2)).cast("int") % 10 == 0).withColumn("focus", F.split("content", " "))
    queries = new.select(F.col("id").alias("query_id"), F.col("content").alias("text"))
    score = {(r.query_id, r.id): r.score for r in retrieval.bm25(units, queries).collect()}
    want, at = set(), {r[0]: r for r in rows}
    for i in [r.query_id for r in queries.collect()]:
        _, user, hour, _ = at[i]
        before = [r for r in rows if None not in (user, hour, r[2]) and r[1] == user and r[2] < hour]
        want |= {(i, r[0]) for r in sorted(before, key=lambda r: (-r[2], r[0]))[:24]}
        want |= {(i, r[0]) for r in sorted((r for r in before if (i, r[0]) in score), key=lambda r: (-score[i, r[0]], r[0]))[:4]}
    assert {tuple(r) for r in correction.candidates(units, new, 2).collect()} == want and len(want) > 100


def test_a_graph_of_a_quarter_million_edges_is_one_tasks(spark, monkeypatch):
    from mnemospark.operators import community

    monkeypatch.setattr(community, "_louvain_by_joins", None)  # some hundred joins over all edges
    i = F.col("id")
    edges = spark.range(250_000).select(F.lit("u").alias("user_id"), F.concat(F.lit("c"), i % 500).alias("source_id"), F.concat(F.lit("p"), i % 500, F.lit("-"), i % 7919).alias("target_id"), F.lit(1.0).alias("weight"))
    stars = {(r.community, r.n) for r in community.louvain(edges).groupBy("community").agg(F.count("*").alias("n")).collect()}
    want = edges.groupBy("source_id").agg((F.count_distinct("target_id") + 1).alias("n"))
    assert stars == {(r.source_id, r.n) for r in want.collect()}


def test_louvain_in_tasks_equals_a_plain_one(spark):
    from mnemospark.operators import community

    rng = random.Random(8)
    rows = [(u, f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", rng.choice([0.1, 0.5, 1.0, 2.0])) for u in ("u", "v", None) for _ in range(260)]
    for by in ("u", "v", None):
        links = [r[1:] for r in rows if r[0] == by]
        names = sorted({x for r in links for x in r[:2]})
        adj = {n: defaultdict(float) for n in names}
        for a, b, w in links:
            adj[a][b] += w
            if a != b:
                adj[b][a] += w
        two_m, home = 2 * sum(w for *_, w in links), {n: n for n in names}
        while True:
            degree = {n: sum(near.values()) + near.get(n, 0.0) for n, near in adj.items()}
            of, total = {n: n for n in adj}, dict(degree)
            for _ in range(10):
                before = dict(of)
                for n in sorted(adj):
                    total[of[n]] -= degree[n]
                    near = {of[n]: 0.0}
                    for x, w in adj[n].items():
                        if x != n:
                            near[of[x]] = near.get(of[x], 0.0) + w
                    gain = {c: w - degree[n] * total[c] / two_m for c, w in near.items()}
                    best = min(gain, key=lambda c: (-round(gain[c], 9), c))
                    if gain[best] > gain[of[n]] + 1e-9:
                        of[n] = best
                    total[of[n]] += degree[n]
                if of == before:
                    break
            if all(n == c for n, c in of.items()):
                break
            home = {n: of[c] for n, c in home.items()}
            merged = {c: defaultdict(float) for c in set(of.values())}
            for a in sorted(adj):
                for b, w in adj[a].items():
                    if a <= b:
                        merged[of[a]][of[b]] += w
                        if of[a] != of[b]:
                            merged[of[b]][of[a]] += w
            adj = merged
        first = {c: min(n for n in names if home[n] == c) for c in set(home.values())}
        edges = spark.createDataFrame(rows, "user_id string, source_id string, target_id string, weight double")
        found = {r.node: r.community for r in community.louvain(edges).collect() if r.user_id == by}
        assert found == {n: first[home[n]] for n in names} and len(set(found.values())) > 2


def test_large_graphs_are_moved_by_joins(spark, monkeypatch):
    from mnemospark.operators import community, graph

    rng = random.Random(4)
    rows = [(u, f"{c}{i}", f"{c}{j}", 1.0) for u in "uv" for c in "xyz" for i in range(12) for j in range(i) if rng.random() < 0.7]
    rows += [(u, a, b, 0.2) for u in "uv" for a, b in (("x0", "y0"), ("y1", "z1"), ("x2", "z2"), ("x3", "x3"))] + [("w", "p", "q", 1.0)]
    edges = spark.createDataFrame(rows, "user_id string, source_id string, target_id string, weight double")
    whole = {(r.user_id, r.node): r.community for r in community.louvain(edges).collect()}
    monkeypatch.setattr(community, "TASK_EDGES", 10)
    found = community.louvain(edges)
    assert {(r.user_id, r.node): r.community for r in found.collect()} == whole and len(set(whole.values())) >= 4
    one = edges.where("user_id = 'u'")
    assert graph.modularity(one, community.louvain(one).select("node", "community")).first().modularity > 0.5
