"""Graph, lifecycle, task, aggregation and organization queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import times
from ..operators import community, correction, facts, graph, hooks, ingest, lifecycle, organization, queues, stats
from ..sources import tables as src
from .fixtures import Tables
from .registry import query
from .scalar import tokens_sql
from ..functions.shared import small, written
from ..functions.text import count_tokens

_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def shown(col: str):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


# --- scans -----------------------------------------------------------------------------


@query("S1 S2 S3 S4", "SELECT id FROM l0_events WHERE starts_with(id, '1') AND id > '1500' ORDER BY id LIMIT 50", "l0_events")
def keyset_page(t: Tables):
    return src.scan(t.l0_events, "id", prefix="1", after="1500", limit=50, keys_only=True)


@query("S5 S6", "SELECT event_type, count(*)::BIGINT AS n FROM events WHERE event_id >= 100 AND event_id < 900 GROUP BY 1")
def key_range_count(t: Tables):
    return src.scan_range(t.events, "event_id", 100, 900).groupBy("event_type").agg(F.count("*").alias("n"))


@query("S7 J2", "SELECT l.place::BIGINT AS place, e.id, e.user_id FROM l0_events e JOIN (VALUES ('7', 0), ('999999999', 1), ('3', 2), ('11', 3)) l(id, place) USING (id)", "l0_events")
def multi_get(t: Tables):
    return src.multi_get(t.l0_events, "id", ["7", "999999999", "3", "11"]).select(F.col("place").cast("long").alias("place"), "id", "user_id")


@query(
    "S8 U3",
    """SELECT event_id, round(CASE WHEN event_id % 10 = 0 THEN value + 1 ELSE value END, 6) AS value FROM events""",
)
def upsert_latest(t: Tables):
    table = t.events.select("event_id", "value", F.lit(1).alias("version"))
    changes = table.where("event_id % 10 = 0").withColumn("value", F.col("value") + 1).withColumn("version", F.lit(2))
    return src.upsert(table, changes, ["event_id"], "version").select("event_id", F.round("value", 6).alias("value"))


@query(
    "S12 S23 A23",
    """SELECT count(*)::BIGINT AS scanned, count(*) FILTER (doc_id % 50 <> 0 AND embedding IS NOT NULL)::BIGINT AS indexed,
    count(*) FILTER (doc_id % 50 <> 0 AND embedding IS NULL)::BIGINT AS skipped, count(*) FILTER (doc_id % 50 = 0)::BIGINT AS decode_errors, count(embedding)::BIGINT AS with_embedding FROM unit_embeddings""",
    "units unit_embeddings",
)
def rebuild_report(t: Tables):
    return src.rebuild_report(t.unit_embeddings, 64, F.col("doc_id") % 50 != 0)


# --- graph -----------------------------------------------------------------------------

_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, source_id, target_id, relation ORDER BY transaction_time DESC, weight DESC) AS rn FROM edges) WHERE rn = 1)"


@query("W3 U3 S15", f"WITH {_LATEST} SELECT source_id, target_id, relation, weight FROM latest", "edges")
def edge_dedup_latest(t: Tables):
    return graph.latest_edges(t.edges).select("source_id", "target_id", "relation", "weight")


@query("A21", "SELECT node, count(*)::BIGINT AS degree FROM (SELECT source_id AS node FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1", "edges")
def edge_degree(t: Tables):
    return graph.degrees(t.edges)


@query("A5", "SELECT relation, count(*)::BIGINT AS n, round(sum(weight), 4) AS total FROM edges GROUP BY 1", "edges")
def relation_distribution(t: Tables):
    return t.edges.groupBy("relation").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("total"))


def _starts(t: Tables):
    return t.spark.createDataFrame([("c1",), ("c2",), ("c4",), ("c7",)], "node string")


@query(
    "J5 S16 G4",
    """SELECT node, neighbour, relation, round(weight, 6) AS weight FROM (SELECT source_id AS node, target_id AS neighbour, relation, weight FROM edges
    UNION ALL SELECT target_id, source_id, relation, weight FROM edges) WHERE node IN ('c1', 'c2', 'p4', 'p7') AND weight >= 0.2""",
    "edges",
)
def batch_neighbours(t: Tables):
    nodes = t.spark.createDataFrame([("c1",), ("c2",), ("p4",), ("p7",)], "node string")
    return graph.neighbours(t.edges, nodes, None, "both", 0.2).select("node", "neighbour", "relation", F.round("weight", 6).alias("weight"))


@query(
    "G1 G2",
    """WITH one AS (SELECT DISTINCT target_id AS node FROM edges WHERE source_id IN ('c1', 'c2', 'c4', 'c7') AND relation IN ('RelatedTo', 'DerivedFrom') AND weight >= 0.3),
    two AS (SELECT DISTINCT source_id AS node FROM edges JOIN one ON target_id = one.node WHERE weight >= 0.5 UNION SELECT DISTINCT target_id FROM edges JOIN one ON source_id = one.node WHERE weight >= 0.5)
    SELECT node FROM one UNION SELECT node FROM two""",
    "edges",
)
def two_hop_neighbors(t: Tables):
    steps = [{"relations": ["RelatedTo", "DerivedFrom"], "min_weight": 0.3}, {"direction": "both", "min_weight": 0.5}]
    return graph.traverse(t.edges, _starts(t), steps)


_UNIT_EDGES = """unit_edges AS (SELECT doc_id::VARCHAR AS source_id, (doc_id * 7 + 1) % (SELECT max(doc_id) + 1 FROM documents) AS t,
  ['RelatedTo', 'DerivedFrom', 'Supports'][doc_id % 3 + 1] AS relation, (doc_id * 7 % 10) / 10.0::DOUBLE AS weight FROM documents)"""


def unit_edges(t: Tables):
    """Edges between units: each to the one numbered seven times higher, around the end."""
    d = F.col("doc_id")
    n = t.documents.agg(F.max("doc_id").alias("m"))
    rows = t.documents.select("doc_id").crossJoin(F.broadcast(n))
    relation = F.get(F.array(F.lit("RelatedTo"), F.lit("DerivedFrom"), F.lit("Supports")), (d % 3).cast("int"))
    return rows.select(d.cast("string").alias("source_id"), ((d * 7 + 1) % (F.col("m") + 1)).cast("string").alias("target_id"), relation.alias("relation"), ((d * 7 % 10) / 10).alias("weight"))


@query(
    "G3",
    f"""WITH RECURSIVE {_UNIT_EDGES}, r AS (SELECT n.node, 0 AS depth FROM (VALUES ('1'), ('2'), ('4'), ('7')) n(node)
      UNION SELECT e.t::VARCHAR, r.depth + 1 FROM r JOIN unit_edges e ON e.source_id = r.node WHERE r.depth < 3 AND e.weight >= 0.1)
    SELECT node, min(depth)::BIGINT AS depth FROM r GROUP BY 1""",
)
def multi_hop_reach(t: Tables):
    start = t.spark.createDataFrame([("1",), ("2",), ("4",), ("7",)], "node string")
    return graph.reach(unit_edges(t), start, 3, 0.1).select("node", F.col("depth").cast("long").alias("depth"))


@query("S17 L4", "SELECT count(*)::BIGINT AS deleted FROM edges WHERE source_id = 'c4' OR target_id = 'c4'", "edges")
def delete_node_edges(t: Tables):
    return graph.without_node(t.edges, "c4")[1]


@query(
    "M4",
    """WITH l AS (SELECT DISTINCT node, CASE WHEN substr(node, 1, 1) = 'c' THEN substr(node, 2)::BIGINT % 7 ELSE substr(node, 2)::BIGINT % 7 END AS community FROM (SELECT source_id AS node FROM edges UNION ALL SELECT target_id FROM edges)),
    d AS (SELECT node, sum(weight) AS d FROM (SELECT source_id AS node, weight FROM edges UNION ALL SELECT target_id, weight FROM edges) GROUP BY 1),
    m AS (SELECT sum(weight) AS m FROM edges)
    SELECT round(sum((weight - a.d * b.d / (2 * m)) / m), 6) AS modularity, count(*)::BIGINT AS inside FROM edges JOIN l x ON source_id = x.node JOIN l y ON target_id = y.node
    JOIN d a ON a.node = source_id JOIN d b ON b.node = target_id, m WHERE x.community = y.community""",
    "edges",
)
def edge_modularity(t: Tables):
    nodes = t.edges.select(F.explode(F.array("source_id", "target_id")).alias("node")).distinct()
    labels = nodes.select("node", (F.substr("node", F.lit(2)).cast("long") % 7).alias("community"))
    return graph.modularity(t.edges, labels)


@query(
    "G6 J18",
    f"""WITH {_UNIT_EDGES}, picked AS (SELECT source_id, t::VARCHAR AS target_id, relation, weight FROM unit_edges ORDER BY source_id, target_id, relation, weight LIMIT 200),
    ends AS (SELECT source_id AS id FROM picked UNION SELECT target_id FROM picked),
    shown AS (SELECT doc_id::VARCHAR AS id FROM documents WHERE doc_id::VARCHAR IN (SELECT id FROM ends) ORDER BY 1 LIMIT 50)
    SELECT relation, count(*)::BIGINT AS n FROM picked WHERE source_id IN (SELECT id FROM shown) AND target_id IN (SELECT id FROM shown) GROUP BY 1""",
)
def dashboard_graph(t: Tables):
    nodes = t.units.select("id", F.col("content").alias("label"))
    edges = unit_edges(t).withColumn("transaction_time", F.lit(0))
    return graph.view(nodes, edges, 50)[1].groupBy("relation").agg(F.count("*").alias("n"))


@query("M1 M2 M5")
def community_lpa(t: Tables):
    labels = community.label_propagation(graph.latest_edges(t.edges), 10, True)
    return community.groups(labels, 3)


@query("M3")
def community_louvain(t: Tables):
    return community.groups(community.louvain(_small_graphs(t)), 3)


def _small_graphs(t: Tables):
    """One graph a customer segment and nation: what one user's graph is like. The owner follows
    from the source, so edges meet both their owners and their like in one shuffle by source."""
    c = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("source_id"), F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("user_id"))
    return graph.latest_edges(t.edges.drop("user_id").join(c, "source_id"))


@query("M8 M10")
def community_two_phase(t: Tables):
    return community.two_phase(graph.latest_edges(t.edges))


@query(
    "M7",
    """WITH l AS (SELECT doc_id::VARCHAR AS node, doc_id % 13 AS community FROM documents), ends AS (SELECT unnest(['3', '5', '40', '41']) AS node),
    hit AS (SELECT DISTINCT community FROM l WHERE node IN ('3', '40'))
    SELECT node FROM l WHERE community IN (SELECT community FROM hit) UNION SELECT node FROM ends""",
)
def community_affected(t: Tables):
    labels = t.documents.select(F.col("doc_id").cast("string").alias("node"), (F.col("doc_id") % 13).alias("community"))
    new = t.spark.createDataFrame([("3", "5"), ("40", "41")], "source_id string, target_id string")
    return community.affected(labels, new)


@query(
    "M9",
    """WITH l AS (SELECT doc_id::VARCHAR AS node, source AS community FROM documents), k AS (SELECT community, count(*) AS members FROM l GROUP BY 1 HAVING count(*) >= 3 ORDER BY members DESC, community LIMIT 5)
    SELECT 'insight-' || community AS source_id, count(*)::BIGINT AS links FROM l JOIN k USING (community) GROUP BY 1""",
)
def community_insights(t: Tables):
    labels = t.documents.select(F.col("doc_id").cast("string").alias("node"), F.col("source").alias("community"))
    return community.insights(labels, t.units, 3, 5)[1].groupBy("source_id").agg(F.count("*").alias("links"))


# --- lifecycle and tasks ---------------------------------------------------------------


@query(
    "L2 J8",
    """WITH refs AS (SELECT DISTINCT user_id, unnest(refs) AS id FROM units u WHERE level >= 2 AND NOT EXISTS (SELECT 1 FROM tombstones x WHERE x.target_kind = 'memory_unit' AND x.target_id = u.id))
    SELECT id FROM units u WHERE importance < 0.3 AND NOT (level = 1 AND EXISTS (SELECT 1 FROM refs r WHERE r.user_id = u.user_id AND r.id = u.id))""",
    "units tombstones",
)
def prune_protected(t: Tables):
    return lifecycle.prune(t.units, t.tombstones, 0.3).select("id")


@query(
    "L5 J6 J7 L3",
    """WITH hits AS (SELECT id FROM units WHERE level = 2), refs AS (SELECT id, unnest(refs) AS event_id FROM units),
    matched AS (SELECT DISTINCT r.event_id FROM refs r JOIN hits h ON h.id = r.id JOIN l0_events e ON e.id = r.event_id)
    SELECT 'unit' AS kind, id FROM hits UNION ALL SELECT 'event', event_id FROM matched
    UNION ALL SELECT DISTINCT 'related_unit', id FROM refs WHERE event_id IN (SELECT event_id FROM matched) AND id NOT IN (SELECT id FROM hits)""",
    "units l0_events",
)
def forget_preview(t: Tables):
    return lifecycle.forget_preview(t.units.where("level = 2").select("id"), t.units, t.l0_events)


@query(
    "L6 L7",
    """SELECT 'memory_unit' AS target_kind, id AS target_id, 'logical' AS mode FROM units WHERE level = 3""",
    "units",
)
def forget_execute(t: Tables):
    preview = t.units.where("level = 3").select(F.lit("unit").alias("kind"), "id")
    return lifecycle.tombstones_for(preview, "logical", "asked").select("target_kind", "target_id", "mode")


@query(
    "J9 L9 T12",
    """SELECT task_id FROM tasks t WHERE status = 'Pending' AND NOT EXISTS (
      SELECT 1 FROM (SELECT unnest(t.dependencies) AS need) n WHERE need NOT IN (SELECT task_id FROM tasks WHERE status = 'Completed'))""",
    "tasks",
)
def ready_tasks(t: Tables):
    return lifecycle.ready_tasks(t.tasks).select("task_id")


@query(
    "J10",
    """WITH RECURSIVE r AS (SELECT task_id, task_id AS root_id, 0 AS depth FROM tasks WHERE parent_id IS NULL
      UNION ALL SELECT t.task_id, r.root_id, r.depth + 1 FROM r JOIN tasks t ON t.parent_id = r.task_id WHERE r.depth < 10)
    SELECT task_id, root_id, depth::BIGINT AS depth FROM r""",
    "tasks",
)
def task_tree_depth(t: Tables):
    return lifecycle.task_depths(t.tasks).select("task_id", "root_id", F.col("depth").cast("long").alias("depth"))


@query(
    "J11",
    """WITH RECURSIVE tree AS (SELECT t.task_id AS goal_id, t.task_id, 0 AS depth FROM tasks t WHERE parent_id IS NULL
      UNION ALL SELECT tree.goal_id, t.task_id, tree.depth + 1 FROM tree JOIN tasks t ON t.parent_id = tree.task_id WHERE tree.depth < 10)
    SELECT g.task_id AS goal_id, b.task_id, t.parent_id, b.depth::BIGINT AS depth, t.status FROM (SELECT task_id FROM tasks WHERE parent_id IS NULL) g
    LEFT JOIN tree b ON b.goal_id = g.task_id AND b.depth > 0 LEFT JOIN tasks t ON t.task_id = b.task_id""",
    "tasks",
)
def goal_trees(t: Tables):
    """Tasks without a parent stand for goals, the tasks below them for their trees."""
    goals = t.tasks.where("parent_id is null").select(F.col("task_id").alias("goal_id"))
    trees = lifecycle.goal_trees(goals, t.tasks)
    return trees.withColumn("depth", F.col("depth").cast("long"))


@query("J17", "SELECT parent_id, round(avg(CASE WHEN status = 'Completed' THEN 1.0 ELSE 0.0 END), 6) AS progress, count(*)::BIGINT AS children FROM tasks WHERE parent_id IS NOT NULL GROUP BY 1", "tasks")
def parent_progress(t: Tables):
    return lifecycle.parent_progress(t.tasks)


@query(
    "A18 T6",
    f"""SELECT user_id, count(*)::BIGINT AS units, sum({tokens_sql('content')})::BIGINT AS tokens, arg_min(id, (transaction_time, id)) AS first_id, {_TS.format('max(transaction_time)')} AS last_tx
    FROM units WHERE level = 1 GROUP BY 1""",
    "units",
)
def reflection_delta(t: Tables):
    return lifecycle.reflection_delta(t.units, count_tokens("content")).select("user_id", "units", "tokens", "first_id", shown("last_tx").alias("last_tx"))


@query(
    "W5 T7 L10",
    f"""WITH u AS (SELECT user_id, id, transaction_time, greatest(1, {tokens_sql('content')}) AS tok, row_number() OVER (PARTITION BY user_id ORDER BY transaction_time, id) AS n FROM units WHERE level = 1),
    s AS (SELECT *, sum(tok) OVER (PARTITION BY user_id ORDER BY transaction_time, id ROWS UNBOUNDED PRECEDING) AS used FROM u WHERE n <= 32)
    SELECT user_id, id FROM s WHERE used <= 4096 OR n = 1""",
    "units",
)
def reflection_pack(t: Tables):
    rows = t.units.where("level = 1").select("user_id", "id", "transaction_time", count_tokens("content").alias("tokens"))
    return lifecycle.reflection_batch(rows, "tokens").select("user_id", "id")


@query(
    "T6",
    f"""WITH m AS (SELECT user_id, count(*) AS units, sum({tokens_sql('content')}) AS tokens, min(transaction_time) AS f FROM units WHERE level = 1 GROUP BY 1)
    SELECT user_id FROM m WHERE units >= 8 OR tokens >= 2000 OR date_diff('second', f, TIMESTAMP '2024-01-31') >= 21600""",
    "units",
)
def reflection_due(t: Tables):
    markers = lifecycle.reflection_delta(t.units, count_tokens("content"))
    return lifecycle.due_for_reflection(markers, t.as_of).select("user_id")


@query(
    "W9 T8",
    """WITH c AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY transaction_time, id) AS n FROM l0_events) SELECT user_id, id, n AS count FROM c WHERE n % 5 = 0""",
    "l0_events",
)
def threshold_crossing(t: Tables):
    return lifecycle.threshold_crossings(t.l0_events, "user_id", ["transaction_time", "id"], 5).select("user_id", "id", "count")


@query(
    "W6 T4",
    """WITH RECURSIVE e AS (SELECT conv_id, turn, length(text)::BIGINT AS tok, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
    r AS (SELECT conv_id, turn, n, 0::BIGINT AS seq_no, 1::BIGINT AS cnt, tok AS used FROM e WHERE n = 1
      UNION ALL SELECT e.conv_id, e.turn, e.n, CASE WHEN r.cnt >= 3 OR r.used + e.tok > 2000 THEN r.seq_no + 1 ELSE r.seq_no END,
        CASE WHEN r.cnt >= 3 OR r.used + e.tok > 2000 THEN 1 ELSE r.cnt + 1 END, CASE WHEN r.cnt >= 3 OR r.used + e.tok > 2000 THEN e.tok ELSE r.used + e.tok END
      FROM r JOIN e ON e.conv_id = r.conv_id AND e.n = r.n + 1)
    SELECT conv_id, turn, seq_no FROM r""",
)
def event_packs(t: Tables):
    rows = t.conversations.select("conv_id", "turn", F.length("text").cast("long").alias("tok"))
    return ingest.pack_events(rows, ["conv_id"], ["turn"], "tok", 3, 2000).select("conv_id", "turn", "seq_no")


@query(
    "W7 W8",
    """WITH p AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS seq_no, min(ts) OVER (PARTITION BY user_id) AS first, n FROM
      (SELECT user_id, event_type, min(ts) AS ts, count(*) AS n FROM events GROUP BY 1, 2)),
    s AS (SELECT *, row_number() OVER (ORDER BY seq_no, first, user_id) - 1 AS slot FROM p)
    SELECT user_id, event_type, slot FROM (SELECT *, sum(n) OVER (ORDER BY slot) AS used FROM s) WHERE used <= 2000 OR slot = 0""",
)
def fair_schedule(t: Tables):
    packs = t.events.groupBy("user_id", "event_type").agg(F.min("ts").alias("ts"), F.count("*").alias("n"))
    by = Window.partitionBy("user_id")
    packs = packs.withColumns({"seq_no": F.row_number().over(by.orderBy("event_type")) - 1, "first": F.min("ts").over(by)})
    slots = ingest.schedule_fairly(packs, ["user_id"], "first")
    return ingest.within_budget(slots, "n", 2000, ["slot"]).select("user_id", "event_type", F.col("slot").cast("long").alias("slot"))


@query(
    "T5",
    """SELECT event_id, coalesce(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts), ts) < 3600 * 1000000::BIGINT, false) AS duplicate FROM events""",
)
def sliding_dedup(t: Tables):
    return ingest.sliding_duplicates(t.events, ["user_id", "event_type"], "ts", 3600).select("event_id", "duplicate")


@query(
    "T13 R3",
    """WITH f AS (SELECT *, row_number() OVER w AS n, sum(strlen(data)) OVER w AS b FROM l0_events WHERE transaction_time <= TIMESTAMP '2024-01-20' AND date_diff('second', transaction_time, TIMESTAMP '2024-01-20') <= 86400
      WINDOW w AS (PARTITION BY user_id ORDER BY transaction_time DESC, id DESC ROWS UNBOUNDED PRECEDING)) SELECT id FROM f WHERE n <= 2 AND b <= 100""",
    "l0_events",
)
def recent_overlay(t: Tables):
    docs = t.l0_events.withColumn("size", F.octet_length("data"))
    return lifecycle.recent_overlay(docs, "transaction_time", times.ts("2024-01-20"), "size", 86400, 2, 100).select("id")


@query(
    "T9 L13 O10 C26",
    """SELECT event_id AS job_id, CASE WHEN event_id % 5 + 1 >= 3 THEN 'Failed' ELSE 'Pending' END AS status,
    CASE WHEN event_id % 5 + 1 < 3 THEN strftime(TIMESTAMP '2024-01-31' + to_seconds(CASE WHEN event_id % 5 = 0 THEN 10 ELSE 30 END), '%Y-%m-%d %H:%M:%S') END AS due_at FROM events
    WHERE ts <= TIMESTAMP '2024-01-10' ORDER BY ts, event_id LIMIT 40""",
)
def due_jobs(t: Tables):
    jobs = t.events.select(F.col("event_id").alias("job_id"), F.col("ts").alias("due_at"), F.lit("Pending").alias("status"), (F.col("event_id") % 5).alias("attempts"))
    due = lifecycle.due_jobs(jobs, times.ts("2024-01-10"), 40)
    return lifecycle.rescheduled(due, t.as_of).select("job_id", "status", shown("due_at").alias("due_at"))


@query(
    "T2 T3",
    """SELECT CASE WHEN event_id % 17 = 0 THEN 'failed:malformed' WHEN event_id % 5 + 1 >= 3 THEN 'failed:retries' ELSE 'pending' END AS state, count(*)::BIGINT AS n FROM events WHERE event_id % 11 <> 4 GROUP BY 1""",
)
def dead_letters(t: Tables):
    from ..streaming.jobs import triage

    applied = t.events.where("event_id % 11 = 4").select("event_id")
    rows = t.events.withColumns({"malformed": F.col("event_id") % 17 == 0, "attempts": F.col("event_id") % 5}).join(applied, "event_id", "left_anti")
    return triage(rows).groupBy("state").agg(F.count("*").alias("n"))


@query(
    "T1",
    """SELECT user_id, count(*)::BIGINT AS waiting, strftime(min(transaction_time), '%Y-%m-%d %H:%M:%S') AS since FROM l0_events WHERE event_id % 3 <> 0 GROUP BY 1""",
    "l0_events",
)
def pending_queue(t: Tables):
    done = t.events.where("event_id % 3 = 0").select(F.col("event_id").cast("string").alias("id"))
    waiting = queues.pending(t.l0_events.unionByName(t.l0_events.where("event_id % 5 = 0")), done)
    return queues.active_users(waiting).select("user_id", "waiting", shown("since").alias("since"))


@query(
    "T4",
    """WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq_no, event_id % 23 <> 0 AS ok FROM events)
    SELECT user_id, event_id, seq_no FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.user_id = a.user_id AND NOT b.ok AND b.seq_no <= a.seq_no)""",
)
def ordered_commits(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    packs = t.events.select("user_id", "event_id", (F.row_number().over(w) - 1).cast("long").alias("seq_no"), (F.col("event_id") % 23 != 0).alias("ok"))
    return queues.committable(packs, ["user_id"]).select("user_id", "event_id", "seq_no")


@query(
    "T9 T10",
    """WITH now AS (SELECT DISTINCT vec_id // 2 AS id FROM embeddings WHERE vec_id % 5 <> 0 AND vec_id % 7 <> 0 AND vec_id // 2 % 9 <> 0),
    everything AS (SELECT id FROM now UNION SELECT vec_id // 2 FROM embeddings WHERE vec_id // 2 % 9 = 0)
    SELECT id::VARCHAR AS id, id IN (SELECT id FROM now) AS fresh FROM everything WHERE id % 4 <> 0""",
)
def published_once(t: Tables):
    """Two jobs a unit; some failed, some without a vector, some published in an earlier round
    whose hooks were lost."""
    v = F.col("vec_id")
    unit = F.floor(v / 2).cast("string")
    jobs = t.embeddings.select(unit.alias("id"), t.as_of.alias("due_at"), F.when(v % 5 == 0, "Failed").otherwise("Pending").alias("status"), F.when(v % 7 != 0, F.col("embedding")).alias("embedding"))
    before = t.embeddings.where(F.floor(v / 2) % 9 == 0).select(unit.alias("id"))
    now = queues.publishable_now(jobs, before, t.as_of).select("id", F.lit(True).alias("fresh"))
    everything = now.unionByName(before.distinct().withColumn("fresh", F.lit(False)))
    marks = t.embeddings.where(F.floor(v / 2) % 4 == 0).select(unit.alias("id"))
    return queues.hooks_due(everything, marks).join(everything, "id")


@query(
    "T13",
    """WITH f AS (SELECT id, sum(strlen(data)) OVER (ORDER BY transaction_time DESC, id DESC) AS used FROM l0_events) SELECT id FROM f WHERE used <= 5000""",
    "l0_events",
)
def overlay_bound(t: Tables):
    docs = t.l0_events.withColumn("size", F.octet_length("data"))
    return queues.overlay_within(docs, "transaction_time", "size", 5000).select("id")


@query(
    "T14",
    """SELECT user_id, ts_hour, docs > 0 AND idle >= 1 AND (docs >= 2000 OR docs * 4000000 >= 33554432 OR idle >= 5) AS due FROM
    (SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS ts_hour, count(*) AS docs, user_id % 8 AS idle FROM events GROUP BY ALL)""",
)
def index_commits(t: Tables):
    rows = t.events.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd HH").alias("ts_hour")).agg(F.count("*").alias("docs"))
    return rows.select("user_id", "ts_hour", queues.commit_due(F.col("docs"), F.col("docs") * 4_000_000, F.col("user_id") % 8).alias("due"))


@query(
    "S14",
    """WITH RECURSIVE e AS (SELECT event_type, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT event_type, event_id, n, 0::BIGINT AS flush, 1 AS cnt, us AS since FROM e WHERE n = 1
      UNION ALL SELECT event_type, event_id, n, CASE WHEN new THEN flush + 1 ELSE flush END, CASE WHEN new THEN 1 ELSE cnt + 1 END, CASE WHEN new THEN us ELSE since END FROM
        (SELECT e.*, r.flush, r.cnt, r.since, r.cnt >= 4 OR e.us - r.since >= 7200 * 1000000::BIGINT AS new FROM r JOIN e ON e.event_type = r.event_type AND e.n = r.n + 1)),
    w AS (SELECT event_type, flush, count(*) AS edges, flush % 3 <> 1 AS ok FROM r GROUP BY 1, 2)
    SELECT a.event_type, a.flush, a.edges::BIGINT AS edges, (SELECT min(b.flush) FROM w b WHERE b.event_type = a.event_type AND b.flush >= a.flush AND b.ok) AS written_with FROM w a""",
)
def edge_flushes(t: Tables):
    """Buffers of four edges or two hours; every third write fails and waits for the next."""
    edges = t.events.select("event_type", F.col("event_id").alias("source_id"), "ts")
    rows = queues.flushes(edges, "event_type", "ts", 4, 7200)
    writes = rows.groupBy("event_type", "flush").agg(F.count("*").alias("edges")).withColumn("ok", F.col("flush") % 3 != 1)
    return queues.requeued(writes, "event_type").select("event_type", "flush", "edges", "written_with")


@query(
    "L10",
    f"""WITH u AS (SELECT id, transaction_time, greatest(1, {tokens_sql('content')}) AS tok, row_number() OVER (ORDER BY transaction_time, id) AS n FROM units
      WHERE level = 1 AND user_id = '7' AND transaction_time >= TIMESTAMP '2024-01-02' AND transaction_time < TIMESTAMP '2024-02-10'),
    s AS (SELECT *, sum(tok) OVER (ORDER BY transaction_time, id) AS used FROM u WHERE n <= 32) SELECT id FROM s WHERE used <= 4096 OR n = 1""",
    "units",
)
def window_reflection(t: Tables):
    rows = lifecycle.reflection_scope(t.units, "7", None, times.ts("2024-01-02"), times.ts("2024-02-10"))
    return lifecycle.reflection_batch(rows.withColumn("tokens", count_tokens("content")), "tokens").select("id")


@query(
    "L12 T4",
    """SELECT conv_id::VARCHAR AS user_id, count(*)::BIGINT AS messages, md5(string_agg('Message ' || n || ': ' || text, chr(10) ORDER BY n)) AS content_md5 FROM
    (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY 1""",
)
def units_from_packs(t: Tables):
    messages = F.collect_list(F.struct("turn", F.concat_ws("/", "conv_id", "turn").alias("id"), F.col("text").alias("data")))
    packs = t.conversations.groupBy(F.col("conv_id").cast("string").alias("user_id")).agg(messages.alias("messages"))
    packs = packs.withColumns({"stream_id": F.col("user_id"), "agent_id": F.lit(None).cast("string"), "seq_no": F.lit(0)})
    return lifecycle.units_from_packs(packs).select("user_id", F.size("references").cast("long").alias("messages"), F.md5("content").alias("content_md5"))


@query("T12", "SELECT user_id::VARCHAR AS user_id, 'Task ' || task_id || ' completed' AS data FROM tasks WHERE status = 'Completed'", "tasks")
def finished_task_events(t: Tables):
    return lifecycle.finished_events(t.tasks)


# --- aggregation -----------------------------------------------------------------------


@query(
    "A1 A2 A3",
    """SELECT org_id, count(*) FILTER (domain = 'agent')::BIGINT AS agent, count(*) FILTER (domain = 'user')::BIGINT AS user, 0::BIGINT AS organization,
    count(*) FILTER (level = 1)::BIGINT AS total_l1, count(*) FILTER (level = 2)::BIGINT AS total_l2, count(*) FILTER (level = 3)::BIGINT AS total_l3, count(*)::BIGINT AS total FROM units GROUP BY 1""",
    "units",
)
def memory_aggregate(t: Tables):
    return stats.memory_aggregate(t.units, ["org_id"]).select("org_id", "agent", "user", "organization", "total_l1", "total_l2", "total_l3", "total")


@query(
    "A4",
    f"""WITH u AS (SELECT agent_id, count(*) AS m, count(*) FILTER (level = 1) AS l1, count(*) FILTER (level = 2) AS l2, max(transaction_time) AS at FROM units WHERE domain = 'agent' AND agent_id IS NOT NULL GROUP BY 1),
    e AS (SELECT agent_id, count(*) AS n, max(transaction_time) AS at FROM l0_events WHERE agent_id IS NOT NULL GROUP BY 1)
    SELECT coalesce(u.agent_id, e.agent_id) AS agent_id, coalesce(m, 0)::BIGINT AS total_memories, coalesce(l1, 0)::BIGINT AS l1_count, coalesce(l2, 0)::BIGINT AS l2_count, coalesce(n, 0)::BIGINT AS total_events,
    {_TS.format('greatest(u.at, e.at)')} AS last_activity FROM u FULL JOIN e ON u.agent_id = e.agent_id""",
    "units l0_events",
)
def agent_rollup(t: Tables):
    return stats.agent_rollup(t.units, t.l0_events).withColumn("last_activity", shown("last_activity"))


@query(
    "A6 A8",
    """WITH p AS (SELECT org_id, user_id, count(*) AS n FROM units GROUP BY 1, 2), k AS (SELECT org_id, memory_type, count(*) AS n FROM units GROUP BY 1, 2)
    SELECT org_id, sum(n)::BIGINT AS members, array_to_string(list(user_id ORDER BY user_id), ',') AS contributors, arg_min(user_id, (-n, user_id)) AS top_contributor,
    (SELECT array_to_string(list(memory_type || '=' || n ORDER BY n DESC, memory_type), ',') FROM k WHERE k.org_id = p.org_id) AS distribution,
    (SELECT arg_min(memory_type, (-n, memory_type)) FROM k WHERE k.org_id = p.org_id) AS primary_kind FROM p GROUP BY org_id""",
    "units",
)
def org_rollup(t: Tables):
    rows = stats.rollup_of(t.units, "org_id", "user_id", "memory_type")
    return rows.select("org_id", "members", F.array_join("contributors", ",").alias("contributors"), "top_contributor", "distribution", "primary_kind")


@query("A7 A24", "SELECT count(DISTINCT user_id)::BIGINT AS contributors, count(*)::BIGINT AS total, round(sum(importance), 4) AS importance FROM units", "units")
def org_metrics(t: Tables):
    return t.units.agg(F.countDistinct("user_id").alias("contributors"), F.count("*").alias("total"), F.round(F.sum("importance"), 4).alias("importance"))


@query(
    "A9 A10 O12",
    """SELECT user_id, count(*)::BIGINT AS total, count(*) FILTER (doc_id % 3 = 0)::BIGINT AS active, count(*) FILTER (doc_id % 3 = 1)::BIGINT AS candidate, count(*) FILTER (doc_id % 3 = 2)::BIGINT AS revoked FROM units GROUP BY 1""",
    "units",
)
def contribution_counts(t: Tables):
    d = F.col("doc_id")
    rows = t.units.withColumn("status", F.when(d % 3 == 0, "active").when(d % 3 == 1, "candidate").otherwise("revoked"))
    return stats.status_counts(rows, ["user_id"], "status", ["active", "candidate", "revoked"])


@query("A11 A25", "SELECT user_id, count(*)::BIGINT AS n FROM units WHERE level = 1 GROUP BY 1", "units")
def l1_counts(t: Tables):
    return t.units.where("level = 1").groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    "A12",
    """SELECT strftime(b.bucket, '%Y-%m-%d %H:%M:%S') AS bucket, count(e.event_id)::BIGINT AS n FROM generate_series(TIMESTAMP '2024-01-30 01:00:00', TIMESTAMP '2024-01-31 00:00:00', INTERVAL 1 HOUR) b(bucket)
    LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') e ON date_trunc('hour', e.ts) = b.bucket GROUP BY 1""",
)
def hourly_zero_filled(t: Tables):
    rows = stats.zero_filled_hours(t.events.where("event_type = 'signup'"), "ts", t.as_of, 24)
    return rows.select(shown("bucket").alias("bucket"), "n")


@query(
    "A14",
    """WITH e AS (SELECT label, vec_id, CASE WHEN label % 3 = 0 AND vec_id % 7 = 0 THEN embedding[1:2] ELSE embedding END AS v FROM embeddings),
    odd AS (SELECT label, min(len(v)) <> max(len(v)) AS odd FROM e GROUP BY 1), own AS (SELECT label, arg_min(v, vec_id) AS v FROM e GROUP BY 1),
    p AS (SELECT label, generate_subscripts(v, 1) AS pos, unnest(v)::DOUBLE AS x FROM e), a AS (SELECT label, pos, avg(x) AS x FROM p GROUP BY 1, 2),
    o AS (SELECT label, generate_subscripts(v, 1) AS pos, unnest(v)::DOUBLE AS x FROM own),
    c AS (SELECT a.* FROM a JOIN odd USING (label) WHERE NOT odd UNION ALL SELECT o.* FROM o JOIN odd USING (label) WHERE odd)
    SELECT label, round(sum(x * pos), 5) AS weighted_sum, count(*)::BIGINT AS dims FROM c GROUP BY 1""",
)
def embedding_centroid(t: Tables):
    """Some labels hold vectors of two lengths: there the representative's vector stands."""
    cut = F.when((F.col("label") % 3 == 0) & (F.col("vec_id") % 7 == 0), F.slice("embedding", 1, 2)).otherwise(F.col("embedding"))
    rows = t.embeddings.select("label", "vec_id", cut.alias("embedding"))
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    rows = organization.centroid(rows, "label", "embedding", first)
    total = F.aggregate(F.zip_with("centroid", F.sequence(F.lit(1), F.size("centroid")), lambda x, n: x * n), F.lit(0.0), lambda s, x: s + x)
    return rows.select("label", F.round(total, 5).alias("weighted_sum"), F.size("centroid").cast("long").alias("dims"))


@query(
    "A19",
    """SELECT event_type, round(sum(value), 4) AS total, bool_and(event_id % 999 <> 0) AS healthy, max(event_id) AS commit_seq FROM events GROUP BY 1""",
)
def merged_counts(t: Tables):
    parts = t.events.select("event_type", F.col("value").alias("total"), (F.col("event_id") % 999 != 0).alias("healthy"), F.col("event_id").alias("commit_seq"))
    return stats.merge_counts(parts, ["event_type"], ["total"], ["healthy"], ["commit_seq"]).withColumn("total", F.round("total", 4))


@query("O1 O2", "SELECT id FROM (SELECT * FROM units WHERE level = 1 ORDER BY transaction_time DESC, id LIMIT 50) u WHERE NOT EXISTS (SELECT 1 FROM tombstones x WHERE x.target_kind = 'memory_unit' AND x.target_id = u.id)", "units tombstones")
def recent_units(t: Tables):
    newest = t.units.where("level = 1").orderBy(F.desc("transaction_time"), "id").limit(50)
    return lifecycle.visible(newest, t.tombstones).select("id")


@query("O5 O6 O7", "SELECT id, round(importance, 6) AS importance FROM units ORDER BY importance DESC, id OFFSET 40 LIMIT 20", "units")
def dashboard_page(t: Tables):
    return stats.page(t.units.select("id", F.round("importance", 6).alias("importance")), [F.desc("importance"), F.asc("id")], 3, 20)


# --- corrections -----------------------------------------------------------------------

_DECIDE = """decided AS (SELECT *, CASE WHEN target_missing THEN 'target_missing' WHEN kind = 'obsolete' AND confidence < 0.7 THEN 'obsolete_low_confidence'
  WHEN kind = 'obsolete' AND target_newer THEN 'target_newer_than_source' WHEN kind IN ('obsolete', 'contradicts') AND NOT slots_match THEN 'fact_slots_mismatch'
  WHEN kind = 'obsolete' AND change_type NOT IN ('update', 'negation', 'historical') THEN 'change_type_not_replacement_safe'
  WHEN kind = 'obsolete' AND confidence < 0.85 THEN 'obsolete_relation_only_due_to_confidence'
  WHEN kind = 'contradicts' AND change_type NOT IN ('contradiction', 'negation') THEN 'change_type_not_contradiction_safe'
  WHEN kind = 'reaffirm' THEN 'reaffirm_no_mutation' WHEN kind = 'ignore' THEN 'ignored_by_arbitrator' END AS guard_reason FROM rac_actions),
  acted AS (SELECT *, CASE WHEN guard_reason = 'obsolete_relation_only_due_to_confidence' THEN 'relation_only' WHEN guard_reason IN ('reaffirm_no_mutation', 'ignored_by_arbitrator') THEN 'noop'
  WHEN guard_reason IS NOT NULL THEN 'rejected' WHEN kind = 'contradicts' THEN 'relation_only' ELSE 'tombstone' END AS effect FROM decided)"""


@query(
    "X17 X18 X20",
    f"WITH {_DECIDE} SELECT source_id, effect, guard_reason, CASE WHEN effect IN ('relation_only', 'tombstone') THEN CASE WHEN kind = 'contradicts' THEN 'Contradicts' ELSE 'EvolvedTo' END END AS relation FROM acted",
    "rac_actions",
)
def rac_decision(t: Tables):
    return correction.decide(t.rac_actions).select("source_id", "effect", "guard_reason", "relation")


@query(
    "X18 X21 O8",
    f"""WITH {_DECIDE} SELECT source_id, target_id, CASE WHEN source_id::BIGINT % 2 = 0 THEN 'approved' ELSE 'rejected' END AS status,
    round(CASE WHEN source_id::BIGINT % 2 = 0 THEN greatest(confidence, 0.85) ELSE confidence END, 6) AS confidence FROM acted
    WHERE effect = 'relation_only' AND kind = 'obsolete' ORDER BY created_at DESC, source_id DESC, target_id DESC LIMIT 25""",
    "rac_actions",
)
def rac_review_queue(t: Tables):
    reviews = correction.latest(correction.decide(t.rac_actions).where(correction.needs_review()), "created_at", 25)
    done = correction.resolve_reviews(reviews, F.col("source_id").cast("long") % 2 == 0)
    return done.select("source_id", "target_id", "status", F.round("confidence", 6).alias("confidence"))


@query("A13", f"WITH {_DECIDE} SELECT effect, count(*)::BIGINT AS n FROM acted GROUP BY 1", "rac_actions")
def rac_counters(t: Tables):
    return correction.decide(t.rac_actions).groupBy("effect").agg(F.count("*").alias("n"))


@query(
    "A12 A13",
    f"""WITH {_DECIDE} SELECT strftime(b.bucket, '%Y-%m-%d %H:%M:%S') AS bucket, count(*) FILTER (effect = 'tombstone')::BIGINT AS tombstone, count(*) FILTER (effect = 'relation_only')::BIGINT AS relation_only,
    count(*) FILTER (effect = 'rejected')::BIGINT AS rejected, count(*) FILTER (effect = 'noop')::BIGINT AS noop
    FROM generate_series(TIMESTAMP '2024-01-30 01:00:00', TIMESTAMP '2024-01-31 00:00:00', INTERVAL 1 HOUR) b(bucket) LEFT JOIN acted ON date_trunc('hour', created_at) = b.bucket GROUP BY 1""",
    "rac_actions",
)
def rac_history(t: Tables):
    rows = correction.hourly_history(correction.decide(t.rac_actions), "created_at", t.as_of, 24)
    return rows.withColumn("bucket", shown("bucket"))


@query(
    "X18 U5",
    f"""WITH {_DECIDE} SELECT id FROM units WHERE id NOT IN (SELECT target_id FROM acted WHERE effect = 'tombstone')""",
    "units rac_actions",
)
def corrected_units(t: Tables):
    gone = correction.applied_tombstones(correction.decide(t.rac_actions)).withColumnRenamed("target_id", "id")
    return t.units.join(gone, "id", "left_anti").select("id")


@query(
    "J12 X16",
    """WITH f AS (SELECT doc_id::VARCHAR AS unit_id, 'user' AS subject, CASE WHEN doc_id % 4 = 0 THEN 'user:unknown' ELSE 'user:u' || doc_id % 20 END AS subject_key, source AS attribute, lang AS value_kind, 'v' || doc_id % 3 AS canonical, 50 + doc_id % 40 AS confidence FROM documents),
    p AS (SELECT a.unit_id, b.unit_id AS other_id, (CASE WHEN a.subject_key = b.subject_key THEN 20 ELSE 0 END + CASE WHEN a.value_kind = b.value_kind THEN 5 ELSE 0 END + CASE WHEN a.canonical = b.canonical THEN 2 ELSE 0 END + a.confidence + b.confidence)::BIGINT AS score
      FROM f a JOIN f b ON a.subject = b.subject AND a.attribute = b.attribute AND a.unit_id <> b.unit_id AND (a.subject_key = b.subject_key OR ends_with(a.subject_key, ':unknown') OR ends_with(b.subject_key, ':unknown')))
    SELECT unit_id, max(score) AS score, arg_max(other_id, (score, other_id)) AS other_id FROM p GROUP BY 1""",
)
def best_fact_pairs(t: Tables):
    d = F.col("doc_id")
    rows = t.documents.select(
        d.cast("string").alias("unit_id"), F.lit("user").alias("subject"), F.when(d % 4 == 0, "user:unknown").otherwise(F.concat(F.lit("user:u"), d % 20)).alias("subject_key"),
        F.col("source").alias("attribute"), F.col("lang").alias("value_kind"), F.concat(F.lit("v"), d % 3).alias("canonical"), (50 + d % 40).alias("confidence"),
    )
    return correction.best_fact_pairs(rows, rows).select("unit_id", F.col("score").cast("long").alias("score"), "other_id")


@query(
    "X19",
    """WITH RECURSIVE act AS (SELECT source_id, target_id FROM rac_actions WHERE NOT target_missing AND kind = 'obsolete' AND confidence >= 0.85
        AND NOT target_newer AND slots_match AND change_type IN ('update', 'negation', 'historical')),
    r AS (SELECT doc_id, id, false AS gone FROM units WHERE doc_id = (SELECT max(doc_id) FROM units)
      UNION ALL SELECT p.doc_id, p.id, NOT r.gone AND EXISTS (SELECT 1 FROM act WHERE act.source_id = r.id AND act.target_id = p.id) FROM r JOIN units p ON p.doc_id = r.doc_id - 1)
    SELECT a.source_id, a.target_id FROM rac_actions a WHERE source_id IN (SELECT id FROM r WHERE NOT gone) AND target_id IN (SELECT id FROM r WHERE NOT gone)""",
    "rac_actions units",
)
def batch_reconcile(t: Tables):
    """One batch of all units, the highest numbers first, so that removals chain: what survives,
    shown by the staged edges whose ends do."""
    decided = correction.decide(t.rac_actions).where("effect = 'tombstone'")
    order = t.units.select(F.col("id").alias("source_id"), (-F.col("doc_id")).alias("n"))
    removals = decided.select("source_id", "target_id").join(order, "source_id").withColumn("user_id", F.lit("u"))
    alive = correction.reconcile_batch(t.units.select(F.lit("u").alias("user_id"), "id"), removals)
    return correction.surviving_edges(t.rac_actions.select("source_id", "target_id"), written(alive, "alive"))


@query(
    "X14 X15 U7 C42 C43",
    None,
)
def correction_candidates(t: Tables):
    """For the stated set of new units, those whose id is divisible by 50, the best eight of all
    earlier factual units of the same user."""
    cols = ["id", "doc_id", "user_id", "content", "keywords", "transaction_time", F.col("source").alias("stream")]
    u = t.units.where("memory_type = 'factual'").select(*cols)
    new = written(correction.lookup_terms(t.units.where("doc_id % 50 = 0").select(*cols)), "new-units")
    found = written(correction.candidates(u, new), "candidates")
    new = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns])
    texts = u.join(small(written(found.select("id").distinct(), "candidate-ids")), "id", "left_semi")
    texts = texts.select("id", correction.haystack("content", "keywords").alias("hay"), "keywords", "stream", "transaction_time")  # once a unit
    pairs = found.withColumnRenamed("new_id", "n_id").join(new, "n_id").join(texts, "id")
    score = correction.candidate_score("n_", F.col("hay"), F.col("keywords"), F.lit(0.0), F.col("stream") == F.col("n_stream"))
    scored = pairs.select("n_id", "id", "transaction_time", F.round(score, 6).alias("score"))
    scored = written(scored, "scored").where("score > 0")  # else the filter scores a second time
    return correction.window_rank(scored, ["n_id"], [F.desc("score"), F.desc("transaction_time"), F.asc("id")]).where("rank < 8").drop("transaction_time")


# --- organization ----------------------------------------------------------------------


def _sources(t: Tables):
    return organization.published_sources(t.units, t.share_policies)


_PUB = "pub AS (SELECT u.* FROM units u JOIN share_policies p USING (user_id) WHERE p.contribute AND domain = 'user' AND level = 2 AND trim(content) <> '')"
_CAND = "cand AS (SELECT id, org_id, 0 AS place, lang AS label, lang AS key FROM pub UNION ALL SELECT id, org_id, 1, source, source FROM pub)"


@query("K6 J15 K5", f"WITH {_PUB} SELECT id, org_id FROM pub", "units share_policies")
def published_sources(t: Tables):
    return _sources(t).select("id", "org_id")


@query(
    "A15 K1 K2",
    f"""WITH {_PUB}, {_CAND}, tally AS (SELECT org_id, key, count(*) AS total, count(*) FILTER (place = 0) AS prim, min(label) AS label FROM cand GROUP BY 1, 2)
    SELECT org_id, key AS topic_key, label AS topic_label FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY total DESC, prim DESC, length(label), key) AS n FROM tally) WHERE n = 1""",
    "units share_policies",
)
def topic_election(t: Tables):
    return organization.elect_topics(organization.topic_candidates(_sources(t)), ["org_id"]).select("org_id", "topic_key", "topic_label")


@query(
    "K3 J16",
    f"""WITH RECURSIVE {_PUB}, {_CAND}, links AS (SELECT DISTINCT a.id AS x, b.id AS y FROM cand a JOIN cand b ON a.org_id = b.org_id AND a.key = b.key),
    r AS (SELECT id, id AS record FROM pub UNION SELECT l.y, r.record FROM r JOIN links l ON l.x = r.id WHERE r.record < l.y)
    SELECT id, min(record) AS record FROM r GROUP BY 1""",
    "units share_policies",
)
def org_merge(t: Tables):
    return organization.merge_sources(organization.topic_candidates(_sources(t)))


@query(
    "K4 K8 A16 A17",
    None,
)
def org_records(t: Tables):
    sources = _sources(t)
    candidates = organization.topic_candidates(sources)
    record = organization.merge_sources(candidates)
    topics = organization.elect_topics(candidates.join(record, "id"), ["record"]).select("record", "topic_label")
    rows = organization.compose_records(sources.join(record, "id").join(topics, "record"))
    return rows.withColumn("valid_time", shown("valid_time"))


@query(
    "A16 O9",
    f"""WITH {_PUB} SELECT org_id, id, round(importance, 6) AS importance FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY importance DESC, valid_time DESC NULLS LAST, transaction_time DESC, id) AS n FROM pub) WHERE n = 1""",
    "units share_policies",
)
def representative_sources(t: Tables):
    return organization.representatives(_sources(t), "org_id").where("n = 1").select("org_id", "id", F.round("importance", 6).alias("importance"))


@query(
    "K7 J14 K11",
    f"""WITH {_PUB} SELECT org_id AS record, count(*)::BIGINT AS total, count(*) FILTER (user_id <> '0')::BIGINT AS active, count(*) FILTER (user_id = '0')::BIGINT AS revoked FROM pub GROUP BY 1""",
    "units share_policies",
)
def revoke_contributor(t: Tables):
    rows = organization.contributions(_sources(t).withColumn("record", F.col("org_id")), F.col("user_id") == "0")
    return stats.status_counts(rows, ["record"], "status", ["active", "revoked"])


@query(
    "K9",
    f"""WITH {_PUB} SELECT id FROM pub WHERE org_id = 'o2' AND doc_id % 3 <> 0""",
    "units share_policies",
)
def share_backfill(t: Tables):
    known = t.units.where("doc_id % 3 = 0").select(F.col("id").alias("source_id"))
    return organization.share_backfill(t.units, t.share_policies, "o2", known).select("id")


@query(
    "K10 O5",
    f"""WITH {_PUB} SELECT id AS record, round(importance, 6) AS importance FROM pub WHERE contains(lower(content), 'the') ORDER BY importance DESC, id LIMIT 15""",
    "units share_policies",
)
def org_listing(t: Tables):
    rows = _sources(t).select(F.col("id").alias("record"), "content", F.round("importance", 6).alias("importance"))
    return organization.listing(rows, "the", "importance", 15).select("record", "importance")


# --- facts -----------------------------------------------------------------------------

#: Statements of our own with their language and the facts in them (attribute, value, subject,
#: change, confidence); the tables hold no natural language. The last two show what the rules
#: miss and what they take for a fact.
STATEMENTS = (
    ("en", "I now live in Tromsø and my email is mara@post.example", (("residence", "Tromsø", "user:self", "update", 90), ("contact", "mara@post.example", "user:self", "reaffirm", 80))),
    ("zh", "我不喜欢芹菜", (("preference", "芹菜", "user:self", "contradiction", 85),)),
    ("es", "Inés Duarte vive en Sevilla y trabaja en Faro", (("residence", "Sevilla", "external:inés_duarte", "reaffirm", 90), ("employment", "Faro", "external:inés_duarte", "reaffirm", 85))),
    ("en", "I used to work at Kelp Bakery, now work at Ferrymen", (("employment", "Kelp Bakery", "user:self", "historical", 85), ("employment", "Ferrymen", "user:self", "update", 85))),
    ("en", "My email changed from m1@post.example to m2@post.example", (("contact", "m1@post.example", "user:self", "historical", 75), ("contact", "m2@post.example", "user:self", "update", 80))),
    ("en", "Perhaps I'll settle in Braga some day", ()),
    ("en", "Tidewater Studio is based in Jena", (("residence", "Jena", "organization:tidewater_studio", "reaffirm", 90),)),
    ("en", "I also speak Finnish", (("skill", "Finnish", "user:self", "addition", 75),)),
    ("zh", "面试改到后天上午十点", (("schedule", "后天上午十点", "external:unknown", "update", 70),)),
    ("en", "The interview is at 9am on Friday", (("schedule", "9am on Friday", "external:unknown", "reaffirm", 70),)),
    ("en", "Boats are what I care for most", (("preference", "boats", "user:self", "reaffirm", 0),)),
    ("en", "The map likes damp cellars", ()),
)
_FOUND_ANYWAY = ((11, "preference", "damp cellars", "user:self", "reaffirm", 85),)
_N = len(STATEMENTS)


def _stated(t: Tables):
    said = F.get(F.array(*[F.lit(x) for _, x, _ in STATEMENTS]), (F.col("doc_id") % _N).cast("int"))
    return t.units.select("id", "doc_id", "user_id", "level", "memory_type", said.alias("content"), F.lit("user").alias("domain"), F.lit(None).cast("string").alias("agent_id"))


def _facts_sql(found: bool) -> str:
    """The facts of the statements as a table: those found by the rules, or those expected."""
    rows = [(n, *f) for n, (_, _, fs) in enumerate(STATEMENTS) for f in fs if f[4] or not found]
    rows += _FOUND_ANYWAY if found else ()
    shown_rows = ", ".join(f"({n}, '{a}', '{v}', '{s}', '{c}', {p})" for n, a, v, s, c, p in rows)
    return f"f(n, attribute, value, subject_key, change_type, confidence) AS (VALUES {shown_rows})"


@query(
    "X1 X2 X3 X4 X7 X8 X10 C31",
    f"WITH {_facts_sql(True)} SELECT id, attribute, value, subject_key, change_type, confidence::BIGINT AS confidence FROM units JOIN f ON doc_id % {_N} = n",
    "units",
)
def fact_extract(t: Tables):
    found = facts.detect_facts(_stated(t))
    rows = found.select("id", F.explode("facts").alias("f")).select("id", "f.*")
    return rows.select("id", "attribute", "value", "subject_key", "change_type", F.col("confidence").cast("long").alias("confidence"))


@query(
    "X11",
    f"""WITH {_facts_sql(True)} SELECT id, attribute, value, subject_key, change_type, confidence::BIGINT AS confidence,
    CASE change_type WHEN 'historical' THEN 'historical' WHEN 'negation' THEN 'negated' ELSE 'current' END AS temporal_status, CASE WHEN change_type IN ('negation', 'contradiction') THEN 'negative' ELSE 'positive' END AS polarity
    FROM (SELECT id, attribute, value, subject_key, change_type, confidence FROM units JOIN f ON doc_id % {_N} = n)""",
    "units",
)
def fact_conversions(t: Tables):
    """Facts to their stored form and back again."""
    rows = facts.detect_facts(_stated(t)).select("id", facts.stored(F.col("facts")).alias("kept"))
    back = facts.described(rows, "kept")
    each = back.select("id", F.explode(F.arrays_zip("facts", "kept")).alias("x")).select("id", "x.facts.*", "x.kept.temporal_status", "x.kept.polarity")
    return each.select("id", "attribute", "value", "subject_key", "change_type", F.col("confidence").cast("long").alias("confidence"), "temporal_status", "polarity")


@query(
    "X12 X13",
    f"""WITH {_facts_sql(True)}, s AS (SELECT id, doc_id, doc_id % {_N} AS k FROM units WHERE level = 1 AND memory_type = 'factual'),
    h AS (SELECT id, f.attribute, f.value, f.change_type, f.confidence FROM s JOIN f ON k = n WHERE doc_id % 3 <> 0
      UNION ALL SELECT id, 'status', 'baker', 'update', 60 FROM s WHERE doc_id % 3 = 0 UNION ALL SELECT id, 'status', 'baker', 'historical', 95 FROM s WHERE doc_id % 3 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE change_type WHEN 'update' THEN 6 WHEN 'historical' THEN 5 WHEN 'negation' THEN 5 WHEN 'contradiction' THEN 4 WHEN 'addition' THEN 3 ELSE 2 END DESC, confidence DESC) AS place,
      count(*) OVER (PARTITION BY id) AS facts FROM h)
    SELECT id, attribute, value, change_type, confidence::BIGINT AS confidence, facts::BIGINT AS facts FROM r WHERE place = 1""",
    "units",
)
def best_facts(t: Tables):
    """Every third unit has facts of a model, one of them twice: those hide the rules'."""

    def fact(change: str, points: int, kind: str):
        values = ("user", "user:self", "status", "Baker" if kind else "baker", "baker", "title", change, points)
        names = ("subject", "subject_key", "attribute", "value", "canonical_value", "value_kind", "change_type", "confidence")
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values)])

    model = F.array(fact("update", 60, ""), fact("historical", 95, ""), fact("update", 99, "again")).cast(f"array<{facts.FACT}>")
    none = F.array().cast(f"array<{facts.FACT}>")
    rows = facts.hydrate(_stated(t).withColumn("extracted", F.when(F.col("doc_id") % 3 == 0, model).otherwise(none)), "extracted")
    best = rows.select("id", facts.best_fact(F.col("facts")).alias("f"), F.size("facts").cast("long").alias("facts")).where("f is not null")
    return best.select("id", "f.attribute", "f.value", "f.change_type", F.col("f.confidence").cast("long").alias("confidence"), "facts")


@query(
    "A22",
    f"""WITH {_facts_sql(False)}, langs(n, language) AS (VALUES {", ".join(f"({n}, '{x}')" for n, (x, _, _) in enumerate(STATEMENTS))}),
    c AS (SELECT language, attribute, change_type, confidence > 0 AS hit, true AS expected FROM units JOIN f ON doc_id % {_N} = n JOIN langs USING (n)
      UNION ALL SELECT 'en', 'preference', 'reaffirm', false, false FROM units WHERE doc_id % {_N} = 11),
    d AS (SELECT 'all' AS dimension, 'all' AS value, hit, expected FROM c UNION ALL SELECT 'language', language, hit, expected FROM c
      UNION ALL SELECT 'attribute', attribute, hit, expected FROM c UNION ALL SELECT 'change_type', change_type, hit, expected FROM c),
    r AS (SELECT dimension, value, count(*) FILTER (expected)::BIGINT AS n, round(avg(hit::INT) FILTER (expected), 6) AS rate,
      count(*) FILTER (expected AND NOT hit)::BIGINT AS false_negatives, count(*) FILTER (NOT expected)::BIGINT AS false_positives FROM d GROUP BY 1, 2)
    SELECT dimension, value, n, rate AS covered, rate AS attribute_ok, rate AS subject_ok, rate AS change_ok, rate AS exact, false_negatives, false_positives FROM r""",
    "units",
)
def fact_scorecard(t: Tables):
    """Each unit's statement against the facts known to be in it."""
    each = [F.array(*[F.struct(*[F.lit(x) for x in f[:4]]) for f in fs]).cast(facts.EXPECTED) for _, _, fs in STATEMENTS]
    pick = lambda xs: F.get(F.array(*xs), (F.col("doc_id") % _N).cast("int"))
    cases = _stated(t).select(F.col("id").alias("case"), pick([F.lit(x) for x, _, _ in STATEMENTS]).alias("language"), "content", pick(each).alias("expected"))
    return stats.scorecard(facts.evaluate(cases), ["language", "attribute", "change_type"])


@query(
    "X22 C36",
    """SELECT id, CASE WHEN doc_id % 3 = 0 THEN 'forget' ELSE 'update' END AS plan, TIMESTAMP '2024-01-31' <= transaction_time + INTERVAL 15 MINUTE AS open FROM units""",
    "units",
)
def semantic_plans(t: Tables):
    said = F.when(F.col("doc_id") % 3 == 0, "Please delete what I said").otherwise("I moved again")
    expires = F.timestamp_add("MINUTE", F.lit(15), F.col("transaction_time"))
    return t.units.select("id", correction.plan_kind(F.lit(None).cast("string"), said).alias("plan"), (t.as_of <= expires).alias("open"))


@query(
    "S24",
    """WITH RECURSIVE f AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
    r AS (SELECT label, vec_id, n, vec_id AS since, v AS last, true AS kept FROM f WHERE n = 1
      UNION ALL SELECT label, vec_id, n, CASE WHEN keep THEN vec_id ELSE since END, CASE WHEN keep THEN v ELSE last END, keep FROM
        (SELECT f.label, f.vec_id, f.n, f.v, r.since, r.last, f.vec_id - r.since > 25 OR list_cosine_similarity(f.v, r.last) < 0.05 AS keep FROM r JOIN f ON f.label = r.label AND f.n = r.n + 1))
    SELECT vec_id FROM r WHERE kept""",
)
def keyframes(t: Tables):
    """By gap and likeness; the vectors here are so unlike that the bound is 0.05."""
    frames = t.embeddings.select("label", "vec_id", "embedding")
    return ingest.keyframes(frames, "label", "vec_id", "embedding", 0.05, 25).select("vec_id")


# --- cycles and built-in windows -------------------------------------------------------


@query(
    "T11 L1 L2 A24",
    """WITH active AS (SELECT DISTINCT user_id::VARCHAR AS user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY),
    refs AS (SELECT DISTINCT user_id, unnest(refs) AS id FROM units u WHERE level >= 2 AND NOT EXISTS (SELECT 1 FROM tombstones x WHERE x.target_kind = 'memory_unit' AND x.target_id = u.id)),
    d AS (SELECT u.id, u.user_id, level, round(CASE WHEN a.user_id IS NULL THEN importance ELSE importance * 0.9 END, 6) AS importance, a.user_id IS NOT NULL AS act FROM units u LEFT JOIN active a USING (user_id))
    SELECT id, importance FROM d WHERE NOT act OR importance >= 0.1 OR level = 1 AND EXISTS (SELECT 1 FROM refs r WHERE r.user_id = d.user_id AND r.id = d.id)""",
    "units tombstones",
)
def decay_cycle(t: Tables):
    """One cycle: units of users active in the last week fade by a tenth, faint ones go."""
    recent = t.events.where(F.col("ts") >= F.lit("2024-01-23").cast("timestamp_ntz"))
    active = recent.select(F.col("user_id").cast("string").alias("user_id")).distinct().withColumn("active", F.lit(True))
    units = t.units.join(active, "user_id", "left")
    units = units.withColumn("importance", F.round(F.when(F.col("active"), F.col("importance") * 0.9).otherwise(F.col("importance")), 6))
    gone = lifecycle.prune(units.where("active"), t.tombstones, 0.1).select("id")
    return units.join(gone, "id", "left_anti").select("id", "importance")


@query(
    "T15 T16 W11",
    """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, value, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*)::BIGINT AS events, round(sum(value), 4) AS total FROM s GROUP BY user_id, n""",
)
def user_sessions(t: Tables):
    """Session windows with a gap of six hours; late rows are taken whenever they come."""
    window = F.session_window(F.col("ts").cast("timestamp"), "6 hours")
    rows = t.events.groupBy("user_id", window.alias("w")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select("user_id", shown("w.start").alias("started"), "events", "total")


@query(
    "W11 T16",
    """SELECT event_id, ntile(4) OVER w AS quarter, round(cume_dist() OVER w, 6) AS share, round(sum(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last_three,
    strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS slot FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""",
)
def analytic_windows(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts")
    return t.events.select(
        "event_id", F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.cume_dist().over(w), 6).alias("share"),
        F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 4).alias("last_three"), F.date_format(F.window(F.col("ts").cast("timestamp"), "15 minutes")["start"], "yyyy-MM-dd HH:mm:ss").alias("slot"),
    )


@query(
    "L8",
    """WITH g AS (SELECT id, doc_id % 7 AS depth FROM units WHERE level = 3), m AS (SELECT id, unnest(['plan', 'do']) AS step FROM g WHERE depth < 5)
    SELECT id || '-' || step AS source_id, id AS target_id, 'IsSubTaskOf' AS relation FROM m""",
    "units",
)
def goal_plan(t: Tables):
    goals = t.units.where("level = 3").select("id", (F.col("doc_id") % 7).alias("depth"))

    def milestones(df):
        steps = df.select(F.col("id").alias("parent_id"), F.explode(F.array(F.lit("plan"), F.lit("do"))).alias("content"))
        return steps.withColumn("id", F.concat_ws("-", "parent_id", "content"))

    return hooks.plan_goals(goals, hooks.Hooks(milestones=milestones))[1].select("source_id", "target_id", "relation")


@query(
    "L11 L12 F11 T9",
    """WITH s AS (SELECT *, embedding IS NOT NULL AS ready FROM unit_embeddings WHERE level IN (1, 2, 3))
    SELECT user_id, count(*)::BIGINT AS stored, count(*) FILTER (ready)::BIGINT AS published, count(*) FILTER (ready AND level = 1)::BIGINT AS l1,
    count(*) FILTER (ready AND level = 2 AND domain = 'user')::BIGINT AS shareable FROM s GROUP BY 1""",
    "units unit_embeddings",
)
def store_pipeline(t: Tables):
    """What storing the units publishes, and what waits for its vector."""
    ready = ingest.materializable(F.lit(True), F.lit("Published"), F.col("level"), F.col("domain"), F.col("embedding"))
    rows = t.unit_embeddings.withColumn("ready", ready)
    share = ingest.publishable(F.col("domain"), F.col("level"), F.col("content"))
    return rows.groupBy("user_id").agg(
        F.count("*").alias("stored"), F.count_if("ready").alias("published"), F.count_if(F.col("ready") & (F.col("level") == 1)).alias("l1"), F.count_if(F.col("ready") & share).alias("shareable"),
    )
