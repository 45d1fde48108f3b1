"""Corrections of earlier memories: labels, fact compatibility, scores, decisions, reviews."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.shared import gapless_rank, small, written
from ..functions.text import ascii_lower, let, normalise_keywords, search_tokens
from .retrieval import BM25_B, BM25_K1, text_terms, top_k

BLOCK_UNITS = 16_384  # of a user that are searched at once
RELATION_FROM = 0.70
TOMBSTONE_FROM = 0.85

# Synonyms that label parsers accept.
SUBJECTS = {
    "user": "user self person", "organization": "organization org company team",
    "agent": "agent assistant system", "external": "external other third_party",
}
ATTRIBUTES = {
    "residence": "residence location city home", "preference": "preference favorite likes dislikes",
    "employment": "employment job work company", "relationship": "relationship family partner",
    "status": "status identity role", "contact": "contact email phone", "ownership": "ownership asset device property",
    "skill": "skill expertise language capability", "schedule": "schedule appointment meeting calendar",
}
CHANGES = {
    "update": "update updated replacement replace", "contradiction": "contradiction contradicts conflict",
    "negation": "negation negative denial", "historical": "historical history past previous",
    "reaffirm": "reaffirm reaffirmed confirm confirmed", "addition": "addition added additional",
}
TEMPORAL = {
    "current": "current present active", "historical": "historical history past previous former formerly",
    "negated": "negated negative inactive removed",
}
POLARITY = {"positive": "positive affirmative true", "negative": "negative false negated"}
FORGET_WORDS = ("forget ", "delete ", "remove ", "erase ", "clear ", "drop ", "忘掉", "忘记", "删除", "移除", "清掉", "清除")


def parsed(value: Column, synonyms: dict[str, str]) -> Column:
    """The label that a free-form value stands for, else null."""
    key = F.translate(F.lower(F.trim(value)), " -", "__")
    out = F.lit(None).cast("string")
    for label, words in synonyms.items():
        out = F.when(key.isin(*words.split()), label).otherwise(out)
    return out


def resolve_change(polarity: Column, temporal: Column, change: Column, attribute: Column) -> Column:
    """Negated first, then historical, then the stated change, then current; else reaffirmed."""
    when, sign, named = parsed(temporal, TEMPORAL), parsed(polarity, POLARITY), parsed(change, CHANGES)
    negated = F.coalesce((when == "negated") | (sign == "negative"), when == "negated", sign == "negative", F.lit(False))
    return (
        F.when(negated, F.when(attribute == "preference", "contradiction").otherwise("negation"))
        .when(when == "historical", "historical")
        .when(named.isNotNull(), named)
        .when(when == "current", "update")
        .otherwise("reaffirm")
    )


def subjects_compatible(a: Column, b: Column) -> Column:
    return (a == b) | a.endswith(":unknown") | b.endswith(":unknown")


def plan_kind(stated: Column, instruction: Column) -> Column:
    low, said = F.lower(instruction), F.lower(F.trim(stated))
    asks = F.lit(False)
    for word in FORGET_WORDS:
        asks = asks | F.contains(low, F.lit(word))
    return F.when(said.isin("forget", "update"), said).when(asks, "forget").otherwise("update")


def bare_summary(text: Column) -> Column:
    """A community summary without its stock opening."""
    t = F.trim(text)
    rest = F.regexp_replace(t, "^(?:This community|This group|These memories|The user)(?:'s)? ", "")
    opened = t != rest
    own = F.rlike(t, F.lit("^(?:This community|This group|The user)'s "))
    return F.trim(F.when(opened & ~own, F.concat(F.upper(F.left(rest, F.lit(1))), F.substr(rest, F.lit(2)))).otherwise(rest))


def decide(actions: DataFrame) -> DataFrame:
    """Add ``effect``, ``relation`` and ``guard_reason`` to actions with kind, confidence,
    change_type, slots_match, target_newer and target_missing. One pass, no shuffle."""
    kind, conf, change = F.col("kind"), F.col("confidence"), F.col("change_type")
    obsolete, against = kind == "obsolete", kind == "contradicts"
    reason = (
        F.when(F.col("target_missing"), "target_missing")
        .when(obsolete & (conf < RELATION_FROM), "obsolete_low_confidence")
        .when(obsolete & F.col("target_newer"), "target_newer_than_source")
        .when((obsolete | against) & ~F.col("slots_match"), "fact_slots_mismatch")
        .when(obsolete & ~change.isin("update", "negation", "historical"), "change_type_not_replacement_safe")
        .when(obsolete & (conf < TOMBSTONE_FROM), "obsolete_relation_only_due_to_confidence")
        .when(against & ~change.isin("contradiction", "negation"), "change_type_not_contradiction_safe")
        .when(kind == "reaffirm", "reaffirm_no_mutation")
        .when(kind == "ignore", "ignored_by_arbitrator")
    )
    effect = (
        F.when(reason == "obsolete_relation_only_due_to_confidence", "relation_only")
        .when(reason.isin("reaffirm_no_mutation", "ignored_by_arbitrator"), "noop")
        .when(reason.isNotNull(), "rejected")
        .when(against, "relation_only")
        .otherwise("tombstone")
    )
    actions = actions.withColumn("guard_reason", reason).withColumn("effect", effect)
    applied = F.col("effect").isin("relation_only", "tombstone")
    return actions.withColumn("relation", F.when(applied, F.when(against, "Contradicts").otherwise("EvolvedTo")))


def needs_review() -> Column:
    return (F.col("effect") == "relation_only") & (F.col("kind") == "obsolete") & (F.col("guard_reason") == "obsolete_relation_only_due_to_confidence")


def applied_tombstones(decided: DataFrame) -> DataFrame:
    return decided.where("effect = 'tombstone'").select("target_id").distinct()


def applied_edges(decided: DataFrame) -> DataFrame:
    return decided.where("relation is not null").select("source_id", "target_id", "relation", F.lit(1.0).alias("weight"))


def resolve_reviews(reviews: DataFrame, approved: Column) -> DataFrame:
    """Approval lifts the confidence to what a tombstone needs; refusal leaves it."""
    conf = F.when(approved, F.greatest("confidence", F.lit(TOMBSTONE_FROM))).otherwise(F.col("confidence"))
    return reviews.withColumns({"status": F.when(approved, "approved").otherwise("rejected"), "confidence": conf})


def fact_pair_score(same_key: Column, same_kind: Column, same_value: Column, left: Column, right: Column) -> Column:
    points = F.when(same_key, 20).otherwise(0) + F.when(same_kind, 5).otherwise(0) + F.when(same_value, 2).otherwise(0)
    return points + left + right


def best_fact_pairs(facts: DataFrame, others: DataFrame) -> DataFrame:
    """For each fact of ``facts`` its best compatible one of ``others`` (columns unit_id, subject,
    subject_key, attribute, value_kind, canonical, confidence). The score depends on a fact's
    class and confidence alone, so of each class only its best two units can be an answer (the
    best may be the unit itself): a hot subject or attribute is a few rows on the other side."""
    key = ["subject", "attribute"]
    kind = [*key, "subject_key", "value_kind", "canonical"]
    once = others.groupBy(*kind, "unit_id").agg(F.max("confidence").alias("confidence"))
    w = Window.partitionBy(*kind).orderBy(F.desc("confidence"), F.desc("unit_id"))
    best_two = once.withColumn("n", F.row_number().over(w)).where("n <= 2")
    right = best_two.select(*key, *[F.col(c).alias(f"o_{c}") for c in ("unit_id", "subject_key", "value_kind", "canonical", "confidence")])
    pairs = facts.join(right, key).where(subjects_compatible(F.col("subject_key"), F.col("o_subject_key")) & (F.col("unit_id") != F.col("o_unit_id")))
    score = fact_pair_score(
        F.col("subject_key") == F.col("o_subject_key"), F.col("value_kind") == F.col("o_value_kind"), F.col("canonical") == F.col("o_canonical"), F.col("confidence"), F.col("o_confidence")
    )
    best = F.max(F.struct(score.alias("score"), F.col("o_unit_id").alias("id")))
    return pairs.groupBy("unit_id", *key, "subject_key", "canonical").agg(best.alias("b")).select("unit_id", *key, "canonical", F.col("b.score"), F.col("b.id").alias("other_id"))


# Words too common to look a correction up by.
STOP_WORDS = (
    "a an and are as at be been but by for from had has have her his i in into is it its me my now of on or our "
    "she that the their them there they this to updated was we were with you your 我们 我的 现在 之前 已经"
).split()


def focus_tokens(tokens: Column) -> Column:
    long_enough = lambda x: F.when(F.rlike(x, F.lit(r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]")), F.length(x) >= 2).otherwise(F.octet_length(x) >= 3)
    return F.filter(tokens, lambda x: long_enough(x) & ~x.isin(*STOP_WORDS))


def focus_terms(content: Column | str, keywords: Column | str, most: int = 10) -> Column:
    """Keywords, their tokens, content tokens, then pairs of adjacent content tokens."""
    words = normalise_keywords(keywords, 6)
    keyword_tokens = focus_tokens(F.flatten(F.transform(words, search_tokens)))

    def build(tokens: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(tokens, i - 1), F.get(tokens, i)))
        pairs = F.when(F.size(tokens) > 1, pairs).otherwise(F.array().cast("array<string>"))
        return F.slice(F.array_distinct(F.concat(words, keyword_tokens, tokens, pairs)), 1, most)

    return let(focus_tokens(search_tokens(content)), build)


def lookup_terms(units: DataFrame) -> DataFrame:
    """Units with what candidates are scored by, once a unit and not once a pair. Tokens hold no
    space, so those of the content, which go with each pair, are one text."""
    words = normalise_keywords("keywords", 6)
    return units.withColumn("focus", focus_terms("content", "keywords")).withColumns({
        "words": words, "word_tokens": search_tokens(F.array_join(words, " ")),
        "focus_tokens": search_tokens(F.array_join("focus", " ")), "content_tokens": F.array_join(search_tokens("content"), " "),
    })


@F.pandas_udf(DoubleType())
def _share_found(tokens: pd.Series, hay: pd.Series) -> pd.Series:
    """Share of space-joined tokens that occur in a text, as substrings. Most are words of it;
    pairs come by text, so its words are kept for the next."""
    out, last, words = [], None, set()
    for mine, text in zip(tokens, hay):
        if text != last:
            last, words = text, set(text.split())
        mine = mine.split(" ") if mine else []
        out.append(sum(x in words or x in text for x in mine) / len(mine) if mine else 0.0)
    return pd.Series(out, dtype=float)


def haystack(content: Column | str, keywords: Column | str) -> Column:
    """What a unit's candidates are searched in: lower-cased content and keywords."""
    return ascii_lower(F.concat_ws(" ", content, F.array_join(keywords, " ")))


def candidate_score(new: str, hay: Column, other_keywords: Column, slot: Column, same_stream: Column) -> Column:
    """How likely an earlier unit is what a new one corrects; never below zero. ``new`` is the
    prefix of the columns that ``lookup_terms`` made, ``hay`` the earlier unit's ``haystack``."""
    mine, theirs = F.col(f"{new}words"), normalise_keywords(other_keywords, 6)

    def overlap(name: str) -> Column:
        t = F.col(f"{new}{name}")
        return F.when(F.size(t) > 0, F.size(F.filter(t, lambda x: F.contains(hay, x))) / F.size(t)).otherwise(F.lit(0.0))

    exact = F.when(F.size(mine) > 0, 0.25 * F.size(F.array_intersect(mine, theirs)) / F.size(mine)).otherwise(0.0)
    total = 0.45 * overlap("focus_tokens") + 0.35 * overlap("word_tokens") + 0.2 * _share_found(F.col(f"{new}content_tokens"), hay) + exact + slot
    return F.greatest(F.lit(0.0), total + F.when(same_stream, 0.05).otherwise(0.0))


def candidates(units: DataFrame, new: DataFrame, limit: int = 8) -> DataFrame:
    """``(new_id, id)`` worth scoring for each new unit: earlier units of the same user among
    the best ``2 * limit`` by text and the latest ``max(6 * limit, 24)``. Ids travel, not texts.
    Units are numbered by user and time, so those before a new one are the numbers below its own:
    the latest are looked up, and blocks of units give their best (see ``_best_by_text``). The
    pairs of new and earlier units are never rows. Ids are unique."""
    keyed = F.col("user_id").isNotNull() & F.col("transaction_time").isNotNull()
    heads = new.where(keyed).select("id", "user_id", "transaction_time")
    users = small(written(heads.select("user_id").distinct(), "users-of-new"))
    slim = units.where(keyed).select("id", "user_id", "transaction_time").join(users, "user_id", "left_semi")
    order = [F.col("user_id"), F.col("transaction_time")]
    ranked = written(gapless_rank(slim, [*order, F.desc("id")], "_rank").select("id", "user_id", "_rank"), "ranked-units")
    both = heads.withColumn("_unit", F.lit(0)).unionByName(slim.withColumn("_unit", F.lit(1)))
    among = gapless_rank(both, [*order, F.col("_unit"), F.desc("id")], "_all").where("_unit = 0").select("id", "_all")
    heads = gapless_rank(heads, [*order, F.desc("id")], "_own").join(among, "id")
    heads = written(heads.select(F.col("id").alias("query_id"), "user_id", (F.col("_all") - F.col("_own")).alias("_before")), "heads")
    back = F.explode(F.sequence(F.lit(1), F.lit(max(6 * limit, 24))))
    recent = heads.select("query_id", "user_id", "_before", back.alias("_n")).select("query_id", "user_id", (F.col("_before") - F.col("_n")).alias("_rank")).join(ranked, ["user_id", "_rank"])
    best = top_k(_best_by_text(units, new, ranked, heads, 2 * limit), 2 * limit)
    return recent.select(F.col("query_id").alias("new_id"), "id").union(best.select(F.col("query_id").alias("new_id"), "id")).distinct()


def _best_by_text(units: DataFrame, new: DataFrame, ranked: DataFrame, heads: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, score)``: by BM25 over all ``units``, the ``k`` best of each block of
    ``BLOCK_UNITS`` numbers of a user, among those numbered below ``_before``. A block meets the
    new units that come after its first; of all other units only counts by term are kept."""
    terms = written(new.select(F.col("id").alias("query_id"), F.explode(F.array_distinct(text_terms(F.array_join("focus", " ")))).alias("term")), "query-terms")
    wanted = F.broadcast(terms.select(F.col("term").alias("wanted")).distinct())
    counted = units.select(let(text_terms(F.col("content")), lambda x: F.struct(F.size(x).alias("len"), F.array_distinct(x).alias("tokens"))).alias("t"))
    counted = counted.select("t.len", F.explode(F.concat(F.array(F.lit("")), F.coalesce("t.tokens", F.array().cast("array<string>")))).alias("term"))
    counted = counted.join(wanted, F.col("term") == F.col("wanted"), "left").where("wanted is not null or term = ''")
    held = F.when((F.col("term") == "") & (F.col("len") >= 0), F.col("len"))
    told = written(counted.groupBy("term").agg(F.count("*").alias("df"), F.avg(held).alias("avg_len")), "term-counts")
    whole = told.where("term = ''").first()
    n_docs, average = (whole.df, whole.avg_len) if whole else (0, None)
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = terms.join(told.where("term <> ''"), "term").groupBy("query_id").agg(F.collect_list(F.struct("term", idf.alias("idf"))).alias("terms"))
    block = F.floor(F.col("_rank") / BLOCK_UNITS).alias("_block")
    blocks = small(written(ranked.select("user_id", block).distinct(), "blocks"))
    asked = heads.join(weights, "query_id").join(blocks, "user_id").where(F.col("_block") * BLOCK_UNITS < F.col("_before"))
    docs = units.join(ranked.select("id", "user_id", "_rank", block).drop("user_id"), "id").select("user_id", "_block", "_rank", "id", F.array_join(text_terms(F.col("content")), " ").alias("tokens"))

    def best(docs: pa.Table, asked: pa.Table) -> pa.Table:
        docs, found = docs.sort_by("_rank"), ([], [], [])
        ids, ranks = docs.column("id").to_pylist(), docs.column("_rank").to_numpy()
        place = np.empty(len(ids), np.int64)
        place[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
        queries = asked.select(["query_id", "_before", "terms"]).to_pylist()
        posts: dict[str, tuple[list, list]] = {t["term"]: ([], []) for q in queries for t in q["terms"]}
        for n, chunk in enumerate(docs.column("tokens")):
            tokens = (chunk.as_py() or "").split(" ")
            for term, tf in Counter(tokens).items():
                if term in posts:
                    posts[term][0].append(n)
                    posts[term][1].append(tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * len(tokens) / average)))
        lists = {term: (np.array(at, np.int64), np.array(parts, float)) for term, (at, parts) in posts.items()}
        for q in queries:
            below = np.searchsorted(ranks, q["_before"])
            score = np.zeros(below)
            for t in q["terms"]:
                at, parts = lists[t["term"]]
                cut = np.searchsorted(at, below)
                score[at[:cut]] += t["idf"] * parts[:cut]
            hit = np.flatnonzero(score)
            score = np.round(score[hit], 6)
            if len(hit) > k:
                kept = score >= np.partition(score, -k)[-k]
                hit, score = hit[kept], score[kept]
            for i in np.lexsort((place[hit], -score))[:k]:
                for column, x in zip(found, (q["query_id"], ids[hit[i]], float(score[i]))):
                    column.append(x)
        return pa.table({"query_id": pa.array(found[0], pa.string()), "id": pa.array(found[1], pa.string()), "score": pa.array(found[2], pa.float64())})

    key = ["user_id", "_block"]
    asked = asked.select(*key, "query_id", "_before", "terms")
    return docs.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(best, "query_id string, id string, score double")


def slot_alignment(same_slot: Column, same_attribute: Column, same_kind: Column, same_value: Column) -> Column:
    return (
        F.when(same_slot, 0.55).when(same_attribute & same_kind & same_value, 0.32).when(same_attribute & same_kind, 0.28).when(same_attribute, 0.2).otherwise(-0.25)
    )


def hourly_history(decided: DataFrame, at: str, until: Column, hours: int) -> DataFrame:
    """Counts by effect for each of the last ``hours``, empty hours included."""
    last = F.date_trunc("hour", until)
    first = F.timestamp_add("HOUR", F.lit(1 - hours), last)
    spine = decided.sparkSession.range(1).select(F.explode(F.sequence(first, last, F.expr("interval 1 hour"))).alias("bucket"))
    counts = decided.groupBy(F.date_trunc("hour", at).alias("bucket")).agg(
        *[F.count_if(F.col("effect") == e).alias(e) for e in ("tombstone", "relation_only", "rejected", "noop")]
    )
    return spine.join(counts, "bucket", "left").fillna(0)


def latest(rows: DataFrame, at: str, limit: int) -> DataFrame:
    return rows.orderBy(F.desc(at), F.desc("source_id"), F.desc("target_id")).limit(limit)


def surviving_edges(edges: DataFrame, units: DataFrame) -> DataFrame:
    """Edges staged with a batch whose two ends the batch still has."""
    ids = units.select("id")
    for end in ("source_id", "target_id"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return edges


def reconcile_batch(units: DataFrame, removals: DataFrame) -> DataFrame:
    """Within one batch a later unit may remove an earlier one, unless the later one has been
    removed before. ``removals``: user_id, source_id, target_id, n (order of the source). What is
    staged beside the units then loses its dangling ends by ``surviving_edges``."""
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        gone: set[str] = set()
        for r in pdf.sort_values(["n", "target_id"]).itertuples():
            if r.source_id not in gone:
                gone.add(r.target_id)
        return pd.DataFrame({"user_id": [pdf["user_id"].iloc[0]] * len(gone), "id": sorted(gone)})

    gone = removals.groupBy("user_id").applyInPandas(fold, "user_id string, id string")
    return units.join(gone, ["user_id", "id"], "left_anti")


def window_rank(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)

