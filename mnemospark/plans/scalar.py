"""Scalar functions, filters and projections as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, text, times, vectors
from ..operators import context, ingest, retrieval
from .fixtures import Tables
from .registry import query

_TOKENS = (
    "(len(regexp_extract_all({0}, '[A-Za-z0-9]{{1,4}}')) + len(regexp_extract_all({0}, '[ªµºÀ-ÖØ-öø-˿Ͱ-῿]{{1,2}}'))"
    " + len(regexp_extract_all({0}, '[㐀-䶿一-鿿豈-﫿぀-ヿ가-힯]'))"
    " + len(regexp_extract_all({0}, '[^\\pL\\pN\\s㐀-䶿一-鿿豈-﫿぀-ヿ가-힯]')))::BIGINT"
)
_FLAT = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def tokens_sql(x: str) -> str:
    return _TOKENS.format(x)


def flat_sql(x: str) -> str:
    return _FLAT.format(x)


@query("C1", f"SELECT doc_id, {tokens_sql('text')} AS n_tokens FROM documents")
def token_count(t: Tables):
    return t.documents.select("doc_id", text.count_tokens("text").alias("n_tokens"))


_MIXED = "CASE doc_id % 3 WHEN 0 THEN text || ' 我喜欢香菜' WHEN 1 THEN '日本語のテキスト ' || text ELSE text END"


def _mixed(t: Tables):
    d, head = F.col("doc_id"), F.col("text")
    mixed = F.when(d % 3 == 0, F.concat(head, F.lit(" 我喜欢香菜"))).when(d % 3 == 1, F.concat(F.lit("日本語のテキスト "), head)).otherwise(head)
    return t.documents.select("doc_id", mixed.alias("mixed"))


@query("C1 C2", f"SELECT doc_id, regexp_matches({_MIXED}, '[㐀-䶿一-鿿豈-﫿぀-ヿ가-힯]') AS cjk, {tokens_sql(_MIXED)} AS n_tokens FROM documents")
def cjk_tokens(t: Tables):
    return _mixed(t).select("doc_id", text.has_cjk("mixed").alias("cjk"), text.count_tokens("mixed").alias("n_tokens"))


_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RUNS = "regexp_extract_all(" + _LOW + r", '[㐀-䶿一-鿿豈-﫿぀-ヿ가-힯]+|[a-z0-9ªµºÀ-ÖØ-öø-˿Ͱ-῿]+')"


@query(
    "C9",
    f"""WITH runs AS (SELECT doc_id, unnest({_RUNS.format(_MIXED)}) AS run, generate_subscripts({_RUNS.format(_MIXED)}, 1) AS n FROM documents),
    parts AS (SELECT doc_id, n, CASE WHEN NOT regexp_matches(run, '^[㐀-䶿一-鿿豈-﫿぀-ヿ가-힯]') OR length(run) <= 2 THEN [run]
      ELSE list_concat(list_transform(range(1, length(run)), lambda i: substr(run, i, 2)), CASE WHEN length(run) <= 6 THEN [run] ELSE [] END) END AS xs FROM runs),
    words AS (SELECT doc_id, n, unnest(xs) AS w FROM parts)
    SELECT doc_id, w AS token, count(*)::BIGINT AS times FROM (SELECT DISTINCT doc_id, w FROM words) GROUP BY ALL""",
)
def search_tokens(t: Tables):
    tokens = _mixed(t).select("doc_id", F.explode(text.search_tokens("mixed")).alias("token"))
    return tokens.groupBy("doc_id", "token").agg(F.count("*").alias("times"))


@query(
    "C8 C15",
    f"""SELECT doc_id, md5({flat_sql('text')}) AS flat_md5, CASE WHEN length({flat_sql('text')}) > 88 THEN
    rtrim(left({flat_sql('text')}, 88)) || '...' ELSE {flat_sql('text')} END AS preview FROM documents""",
)
def preview_text(t: Tables):
    return t.documents.select("doc_id", F.md5(text.normalise_space("text")).alias("flat_md5"), text.preview("text", 88).alias("preview"))


@query(
    "C10 U6",
    """SELECT doc_id, array_to_string(list_filter([lang, source, trim(lang)], lambda x: x <> '')[1:2], ',') AS kept,
    len(list_intersect([lang, source], ['en', 'src0', 'src1']))::BIGINT AS exact_matches FROM documents""",
)
def keyword_normalise(t: Tables):
    raw = F.array(F.concat(F.lit(" "), "lang"), F.col("source"), F.lit("  "), F.col("lang"))
    both = F.array_intersect(F.array("lang", "source"), F.array(F.lit("en"), F.lit("src0"), F.lit("src1")))
    return t.documents.select("doc_id", F.array_join(text.normalise_keywords(raw, 2), ",").alias("kept"), F.size(both).cast("long").alias("exact_matches"))


@query(
    "C11",
    f"""WITH q AS (SELECT item_id, list_distinct({_RUNS.format('text')}) AS terms FROM benchmark)
    SELECT doc_id, item_id, round(len(list_filter(terms, lambda x: contains({_LOW.format("d.text || ' ' || lang || ' ' || source")}, x))) / len(terms)::DOUBLE, 6) AS overlap
    FROM documents d, q WHERE item_id % 50 = 0""",
)
def text_overlap_score(t: Tables):
    """The stated query set, items whose id is divisible by 50, against all documents."""
    q = t.benchmark.where("item_id % 50 = 0").select("item_id", text.search_tokens("text").alias("terms"))
    rows = t.documents.crossJoin(retrieval.batch(q))
    return rows.select("doc_id", "item_id", F.round(text.keyword_overlap("terms", "text", F.array("lang", "source")), 6).alias("overlap"))


@query(
    "C12 C13",
    r"""WITH q AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(regexp_replace(text, '[^\pL\pN\s]', ' ', 'g')), '\s+'), lambda x: x <> '')) AS terms FROM benchmark)
    SELECT doc_id, item_id, len(list_filter(terms, lambda x: contains(lower(d.text), x)))::BIGINT AS score FROM documents d, q WHERE item_id % 50 = 0""",
)
def overlay_match_score(t: Tables):
    q = t.benchmark.where("item_id % 50 = 0").select("item_id", text.query_terms("text").alias("terms"))
    rows = t.documents.crossJoin(retrieval.batch(q))
    return rows.select("doc_id", "item_id", text.overlay_score("terms", "text").alias("score"))


@query(
    "C14",
    rf"""WITH k AS (SELECT doc_id, trim(regexp_replace(regexp_replace({_LOW.format('text')}, '[^\pL\s]', '', 'g'), '\s+', ' ', 'g')) AS key FROM documents)
    SELECT md5(key) AS key_md5, count(*)::BIGINT AS n, min(doc_id) AS first_doc FROM k GROUP BY key""",
)
def fingerprint_groups(t: Tables):
    # the hash stands for the key in the shuffle: texts stay where they are
    keyed = t.documents.select("doc_id", F.md5(text.semantic_key("text")).alias("key_md5"))
    return keyed.groupBy("key_md5").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("C17", """SELECT doc_id, replace(replace(replace(replace(replace('<' || lang || ' & "' || text || '''', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped FROM documents""")
def xml_escape(t: Tables):
    raw = F.concat(F.lit("<"), "lang", F.lit(' & "'), F.col("text"), F.lit("'"))
    return t.documents.select("doc_id", text.xml_escape(raw).alias("escaped"))


@query(
    "C18 C21 C32",
    rf"""WITH l AS (SELECT doc_id, array_to_string(string_split({flat_sql('text')}, ' ')[1:6], ' ') AS label FROM documents)
    SELECT doc_id, label, trim(lower(regexp_replace(label, '[^A-Za-z0-9]+', '-', 'g')), '-') AS slug,
    trim(lower(regexp_replace(label, '[^\pL\pN]+', '_', 'g')), '_') AS fragment FROM l""",
)
def slug_keys(t: Tables):
    rows = t.documents.select("doc_id", text.first_words("text").alias("label"))
    return rows.select("doc_id", "label", text.slug("label").alias("slug"), text.key_fragment("label").alias("fragment"))


@query(
    "C19 C20",
    f"""WITH s AS (SELECT doc_id, lang, CASE doc_id % 4 WHEN 0 THEN 'the contributor think the organization''s plan is (the contributor''s), okay'
      WHEN 1 THEN 'They told the contributor, the organization agreed.' WHEN 2 THEN lang || ' notes by the organization!' ELSE 'nothing personal' END AS said FROM documents)
    SELECT doc_id, CASE WHEN starts_with(lower(said), lower(lang)) THEN said ELSE lang || ': ' || said END AS content FROM s""",
)
def first_person(t: Tables):
    d = F.col("doc_id")
    said = (
        F.when(d % 4 == 0, F.lit("I think  our plan is (mine), okay"))
        .when(d % 4 == 1, F.lit("They told me, we agreed."))
        .when(d % 4 == 2, F.concat("lang", F.lit(" notes by us!")))
        .otherwise(F.lit("nothing personal"))
    )
    return t.documents.select("doc_id", text.title_prefixed("lang", text.neutralise_first_person(said)).alias("content"))


@query(
    "C22 S20",
    r"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Image' WHEN 1 THEN 'Audio' WHEN 2 THEN 'Video' ELSE 'Asset' END AS label,
    CASE WHEN page_id % 3 = 0 THEN url ELSE 'inline://' || ['Image/png', 'audio', 'VIDEO', 'pdf'][page_id % 4 + 1] || '/' || left(md5(['Image/png', 'audio', 'VIDEO', 'pdf'][page_id % 4 + 1] || '|raw-bytes'), 16) END AS reference FROM pages""",
)
def asset_labels(t: Tables):
    p = F.col("page_id")
    kind = F.get(F.array(*[F.lit(x) for x in ("Image/png", "audio", "VIDEO", "pdf")]), (p % 4).cast("int"))
    key = F.when(p % 3 == 0, F.col("url")).otherwise(F.lit("  raw-bytes"))
    return t.pages.select("page_id", context.asset_label(kind).alias("label"), context.asset_reference(kind, key).alias("reference"))


@query("C23", f"SELECT id, greatest(1, {tokens_sql('content')} + {tokens_sql("array_to_string(keywords, ' ')")}) AS cost FROM units", "units")
def memory_token_cost(t: Tables):
    return t.units.select("id", context.token_cost("content", "keywords").alias("cost"))


@query(
    "C24 C25",
    f"""SELECT id, user_id || '|' || stream_id || '|' || coalesce(agent_id, '') AS pack_key, {tokens_sql('data')} + 4 AS tokens FROM l0_events""",
    "l0_events",
)
def event_pack_tokens(t: Tables):
    key = ingest.pack_key(F.col("user_id"), F.col("stream_id"), F.col("agent_id"), F.lit(None).cast("string"))
    return t.l0_events.select("id", F.concat_ws("|", key["user_id"], key["stream_id"], F.coalesce(key["agent_id"], F.lit(""))).alias("pack_key"), ingest.event_tokens("kind", "data").alias("tokens"))


@query(
    "C26 C27 C28 C29",
    """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 10 WHEN 1 THEN 10 WHEN 2 THEN 30 WHEN 3 THEN 120 WHEN 4 THEN 600 ELSE 1800 END::BIGINT AS backoff_s,
    CASE WHEN n_chars <= 160 THEN 'tiny' WHEN n_chars <= 480 THEN 'compact' ELSE 'detailed' END AS tier,
    CASE WHEN n_chars <= 160 THEN CASE doc_id % 4 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END
      WHEN n_chars <= 480 THEN CASE doc_id % 4 WHEN 2 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 3 END
      ELSE CASE doc_id % 4 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 3 END END::BIGINT AS priority,
    CASE WHEN n_chars <= 160 THEN least(64, 4 * (1 + doc_id % 24)) WHEN n_chars <= 480 THEN least(48, 3 * (1 + doc_id % 24)) ELSE least(32, 2 * (1 + doc_id % 24)) END::BIGINT AS search_limit
    FROM documents""",
)
def context_tiers(t: Tables):
    tier = context.tier(F.col("n_chars"))
    d = F.col("doc_id")
    return t.documents.select(
        "doc_id", ingest.backoff_seconds(d % 7).cast("long").alias("backoff_s"), tier.alias("tier"),
        context.priority((d % 4).cast("int"), tier).cast("long").alias("priority"), context.search_limit(1 + d % 24, tier).cast("long").alias("search_limit"),
    )


@query(
    "C16",
    f"""WITH f AS (SELECT doc_id, {flat_sql('text')} AS t FROM documents),
    c AS (SELECT doc_id, t, n, rtrim(left(t, n)) || '...' AS cand FROM f, range(1, 401) r(n) WHERE n <= length(t)),
    fit AS (SELECT doc_id, max(n) AS n FROM c WHERE {tokens_sql('cand')} <= 20 GROUP BY doc_id)
    SELECT f.doc_id, CASE WHEN {tokens_sql('t')} <= 20 THEN t WHEN n IS NULL THEN '' ELSE rtrim(left(t, n)) || '...' END AS cut FROM f LEFT JOIN fit USING (doc_id)""",
)
def truncate_budget(t: Tables):
    return t.documents.select("doc_id", text.truncate_to_tokens("text", 20).alias("cut"))


@query(
    "C30 A20",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:00:00Z') AS bucket, count(*)::BIGINT AS n FROM events GROUP BY 1""",
)
def hour_buckets(t: Tables):
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:00:00'Z'")
    return t.events.groupBy(hour.alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "C39 A24",
    """WITH u AS (SELECT DISTINCT user_id, sha256(user_id::VARCHAR) AS h FROM events)
    SELECT ('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2])::BIGINT % 8 AS shard, count(*)::BIGINT AS users FROM u GROUP BY 1""",
)
def shard_histogram(t: Tables):
    users = t.events.select("user_id").distinct().select(ids.shard_of("user_id", 8).alias("shard"))
    return users.groupBy("shard").agg(F.count("*").alias("users"))


@query(
    "C40 C41 S18",
    r"""SELECT event_id, (props->>'$.k')::BIGINT AS k, CASE WHEN event_id % 3 = 0 THEN 3.5::DOUBLE END AS embedding_sum,
    CASE WHEN event_id % 2 = 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS valid_at, event_id % 5 = 0 AS bad_json FROM events""",
)
def json_parsing(t: Tables):
    e = F.col("event_id")
    vector = F.when(e % 3 == 0, "[1.5, 2.0]").when(e % 3 == 1, "[]").otherwise("not an array")
    at = F.when(e % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("yesterday")
    data = F.when(e % 5 == 0, "{broken").otherwise(F.col("props"))
    parsed = ingest.parse_content(F.lit("json"), data)
    return t.events.select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.aggregate(ingest.parse_embedding(vector), F.lit(0.0), lambda s, x: s + x).alias("embedding_sum"),
        F.date_format(ingest.parse_valid_at(at), "yyyy-MM-dd HH:mm:ss").alias("valid_at"), parsed["error"].isNotNull().alias("bad_json"),
    )


@query("C44", "SELECT id, (strlen(content) + strlen(user_id) + coalesce(strlen(org_id), 0) + coalesce(strlen(agent_id), 0) + 256)::BIGINT AS bytes FROM units", "units")
def doc_byte_estimate(t: Tables):
    return t.units.select("id", text.utf8_size("content", "user_id", "org_id", "agent_id").alias("bytes"))


@query(
    "C3 C5",
    """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b
    ON a.label = b.label AND a.vec_id < b.vec_id AND b.vec_id - a.vec_id <= 40""",
)
def cosine_pairs_label(t: Tables):
    # unit vectors once a row, so each pair costs one dot product
    e = t.embeddings.select("vec_id", "label", vectors.normalised("embedding").alias("v"))
    a, b = e.select(F.col("vec_id").alias("a"), "label", F.col("v").alias("va")), e.select(F.col("vec_id").alias("b"), F.col("label").alias("lb"), F.col("v").alias("vb"))
    pairs = a.join(b, (F.col("label") == F.col("lb")) & (F.col("a") < F.col("b")) & (F.col("b") - F.col("a") <= 40))
    return pairs.select("a", "b", F.round(vectors.dot(F.col("va"), F.col("vb")), 6).alias("cosine"))


@query(
    "S11 S13",
    """SELECT vec_id, round(list_sum(list_transform((list_concat(embedding, [0::FLOAT for x in range(8)]))[61:72], lambda x: x::DOUBLE)), 6) AS tail_sum, len(embedding) = 64 AS current FROM embeddings""",
)
def vector_padding(t: Tables):
    wide = vectors.padded("embedding", 72)
    total = F.aggregate(F.slice(wide, 61, 12), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return t.embeddings.select("vec_id", F.round(total, 6).alias("tail_sum"), (F.size("embedding") == 64).alias("current"))


@query(
    "C6 C7 L1",
    """SELECT id, round(importance * 0.9, 6) AS decayed, round(pow(0.5, date_diff('second', transaction_time, TIMESTAMP '2024-01-31') / 604800.0), 6) AS recency,
    round(importance * 0.2 + 0.1 * pow(0.5, date_diff('second', transaction_time, TIMESTAMP '2024-01-31') / 604800.0) + 0.5, 6) AS score FROM units""",
    "units",
)
def decay_importance(t: Tables):
    recent = times.recency("transaction_time", t.as_of)
    score = times.weighted(F.lit(0.5), F.col("importance"), recent)
    return t.units.select("id", F.round(F.col("importance") * 0.9, 6).alias("decayed"), F.round(recent, 6).alias("recency"), F.round(score, 6).alias("score"))


@query(
    "F1 F2",
    """SELECT event_id, event_id % 4 = 0 AS valid FROM events""",
)
def id_validation(t: Tables):
    e = F.col("event_id")
    raw = F.when(e % 4 == 0, F.concat(F.lit("user\t"), e.cast("string"))).when(e % 4 == 1, F.lit("a';drop")).when(e % 4 == 2, F.lit("")).otherwise(F.repeat(F.lit("x"), 257))
    return t.events.select("event_id", ids.valid_id(raw).alias("valid"))


@query("F5 F6 O11", "SELECT id, user_id FROM l0_events WHERE valid_time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND transaction_time <= TIMESTAMP '2024-01-18'", "l0_events")
def valid_time_range(t: Tables):
    e = t.l0_events
    return e.where(times.in_valid_range("valid_time", times.ts("2024-01-05"), times.ts("2024-01-20")) & times.known_at("transaction_time", times.ts("2024-01-18"))).select("id", "user_id")


@query(
    "F6 W3",
    """SELECT user_id, event_type, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY transaction_time DESC, id) AS rn FROM l0_events
    WHERE transaction_time <= TIMESTAMP '2024-01-15') WHERE rn = 1""",
    "l0_events",
)
def as_of_events(t: Tables):
    known = t.l0_events.where(times.known_at("transaction_time", times.ts("2024-01-15")))
    # one row a key leaves each task: no sort, no window
    latest = F.min_by("id", F.struct(-F.unix_micros(F.col("transaction_time").cast("timestamp")), F.col("id")))
    return known.groupBy("user_id", "event_type").agg(latest.alias("id"))


@query("F8 F9", "SELECT e.id FROM l0_events e WHERE NOT EXISTS (SELECT 1 FROM tombstones x WHERE x.target_kind = 'event' AND x.target_id = e.id)", "l0_events tombstones")
def tombstone_anti(t: Tables):
    gone = t.tombstones.where("target_kind = 'event'").select(F.col("target_id").alias("id"))
    return t.l0_events.join(gone, "id", "left_anti").select("id")


@query(
    "F3 F4 F7 F8 F13",
    """SELECT u.id FROM units u WHERE domain IN ('agent', 'user') AND org_id = 'o2' AND user_id IN ('2', '6', '10') AND valid_time >= TIMESTAMP '2024-01-02'
    AND NOT EXISTS (SELECT 1 FROM tombstones x WHERE x.target_kind = 'memory_unit' AND x.target_id = u.id)""",
    "units tombstones",
)
def scoped_units(t: Tables):
    gone = t.tombstones.where("target_kind = 'memory_unit'").select(F.col("target_id").alias("id"))
    u = t.units.where(F.col("domain").isin(*ids.LOCAL_DOMAINS) & (F.col("org_id") == "o2") & F.col("user_id").isin("2", "6", "10") & times.in_valid_range("valid_time", times.ts("2024-01-02"), None))
    return u.join(gone, "id", "left_anti").select("id")


@query(
    "F10 F11 F14",
    """SELECT event_id, event_id % 5 IN (0, 1, 2) AS empty, event_id % 7 <> 0 AS materializable, event_id % 6 = 0 AND event_id % 3 = 0 AS publishable FROM events""",
)
def quality_predicates(t: Tables):
    e = F.col("event_id")
    kind = F.get(F.array(*[F.lit(x) for x in ("Text", "Json", "Json", "Json", "Image")]), (e % 5).cast("int"))
    data = F.get(F.array(*[F.lit(x) for x in ("  ", "null", '" "', "{}", "http://x")]), (e % 5).cast("int"))
    vector = F.when(e % 7 == 0, F.array().cast("array<float>")).otherwise(F.array(F.lit(1.0).cast("float")))
    need = ingest.materializable(F.lit(True), F.lit("Published"), F.lit(1), F.lit("user"), vector)
    publish = ingest.publishable(F.when(e % 3 == 0, "user").otherwise("agent"), F.when(e % 6 == 0, 2).otherwise(1), F.lit("insight"))
    return t.events.select("event_id", ingest.is_empty(kind, data).alias("empty"), need.alias("materializable"), publish.alias("publishable"))


@query(
    "F12",
    """SELECT coalesce(org_id, '-') AS org, count(*)::BIGINT AS all_orgs, count(*) FILTER (org_id IS NULL OR org_id = 'default')::BIGINT AS default_org,
    count(*) FILTER (org_id = 'o1')::BIGINT AS one_org FROM l0_events GROUP BY 1""",
    "l0_events",
)
def org_scope_counts(t: Tables):
    scopes = {"all_orgs": " ", "default_org": "default", "one_org": "o1"}
    return t.l0_events.groupBy(F.coalesce("org_id", F.lit("-")).alias("org")).agg(*[F.count_if(ids.org_scope("org_id", v)).alias(k) for k, v in scopes.items()])


@query(
    "F15",
    """SELECT id, CASE WHEN event_id % 2 = 0 AND agent_id IS NOT NULL THEN 'agent' ELSE 'user' END AS domain,
    CASE WHEN event_id % 2 = 0 AND agent_id IS NOT NULL THEN 'agent:' || coalesce(org_id, '_global') || ':' || agent_id
    ELSE 'user:' || coalesce(org_id, '_global') || ':' || user_id END AS namespace_key FROM l0_events""",
    "l0_events",
)
def namespace_keys(t: Tables):
    dom = ids.domain(F.when(F.col("event_id") % 2 == 0, "procedural").otherwise("factual"), "agent_id")
    return t.l0_events.select("id", dom.alias("domain"), ids.namespace_key(dom, "org_id", "user_id", "agent_id").alias("namespace_key"))


@query(
    "F16 F17 F18",
    f"""SELECT id, CASE WHEN doc_id % 8 = 0 THEN NULL ELSE user_id END AS shown_user, CASE WHEN doc_id % 8 = 0 THEN NULL ELSE agent_id END AS shown_agent,
    level::BIGINT AS level, CASE WHEN length({flat_sql('content')}) > 160 THEN rtrim(left({flat_sql('content')}, 160)) || '...' ELSE {flat_sql('content')} END AS shown FROM units""",
    "units",
)
def list_view(t: Tables):
    view = context.list_item(t.units.withColumn("domain", F.when(F.col("doc_id") % 8 == 0, "organization").otherwise(F.col("domain"))))
    return view.select("id", F.col("user_id").alias("shown_user"), F.col("agent_id").alias("shown_agent"), F.col("level").cast("long").alias("level"), F.col("preview").alias("shown"))


@query(
    "S19",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Image at ' || url WHEN 1 THEN 'Audio at ' || url WHEN 2 THEN 'Video at ' || url ELSE url END AS combined FROM pages""",
)
def event_normalisation(t: Tables):
    kind = F.get(F.array(*[F.lit(x) for x in ("Image", "Audio", "Video", "Text")]), (F.col("page_id") % 4).cast("int"))
    return t.pages.select("page_id", ingest.event_text(kind, F.col("url")).alias("combined"))


@query(
    "C33 C34 C35 C36 C37",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'contradiction' WHEN doc_id % 3 = 0 THEN 'historical' WHEN doc_id % 2 = 0 THEN 'update' ELSE 'reaffirm' END AS change_type,
    doc_id % 4 IN (0, 1) AS compatible, CASE WHEN doc_id % 3 = 0 THEN 'forget' ELSE 'update' END AS plan FROM documents""",
)
def label_parsers(t: Tables):
    from ..operators import correction

    d = F.col("doc_id")
    change = correction.resolve_change(
        F.when(d % 5 == 0, "negative").otherwise("positive"), F.when(d % 3 == 0, "past").when(d % 2 == 0, "present").otherwise(F.lit(None)), F.lit(None).cast("string"), F.lit("preference")
    )
    mine, theirs = F.lit("user:self"), F.when(d % 4 == 0, "user:self").when(d % 4 == 1, "user:unknown").otherwise("user:bob")
    said = F.when(d % 3 == 0, "please forget my address").otherwise("I moved")
    return t.documents.select("doc_id", change.alias("change_type"), correction.subjects_compatible(mine, theirs).alias("compatible"), correction.plan_kind(F.lit(None).cast("string"), said).alias("plan"))


@query(
    "C38",
    """SELECT source, array_to_string(list(text ORDER BY doc_id), chr(10)) AS context FROM (
      SELECT *, sum(strlen(text) + 1) OVER (PARTITION BY source ORDER BY doc_id) - 1 AS used FROM documents) WHERE used <= 20000 GROUP BY source""",
)
def bounded_context(t: Tables):
    rows = t.documents.select("source", "doc_id", F.col("text").alias("piece"))
    return context.bounded_concat(rows, "source", "doc_id", "piece", 20000).withColumnRenamed("text", "context")
