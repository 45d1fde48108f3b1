"""Events: parsing, normalisation, validation, packing into consolidation batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import gapless_rank
from ..functions.text import count_tokens

MAX_PACK_EVENTS = 128
MAX_PACK_TOKENS = 4096
_PASSED = "^(?:https?|s3|local|inline)://"


def parse_content(kind: Column, data: Column) -> Column:
    """``struct<type, data, error>``: text and media pass, JSON must parse."""
    name = F.lower(F.trim(kind))
    label = F.when(name.isin("image", "audio", "video", "json"), F.initcap(name)).otherwise("Text")
    bad = (label == "Json") & F.try_parse_json(data).isNull()
    return F.struct(label.alias("type"), F.when(~bad, data).alias("data"), F.when(bad, F.lit("invalid JSON")).alias("error"))


def is_empty(kind: Column, data: Column) -> Column:
    """Blank text or address; JSON null or a blank JSON string."""
    blank = F.trim(F.coalesce(data, F.lit(""))) == ""
    null_json = F.rlike(F.trim(data), F.lit(r'^(?:null|"\s*")$'))
    return F.when(kind == "Json", blank | null_json).otherwise(blank)


def event_text(kind: Column, data: Column) -> Column:
    """The text an event stands for where no model describes media."""
    return F.when(kind.isin("Image", "Audio", "Video"), F.concat(kind, F.lit(" at "), data)).otherwise(data)


def asset_key(kind: Column, key: Column) -> Column:
    """Addresses pass; anything else is stored inline under a digest of its kind and key."""
    key = F.trim(key)
    inline = F.concat(F.lit("inline://"), kind, F.lit("/"), F.substring(F.md5(F.concat_ws("|", kind, key)), 1, 16))
    return F.when(F.rlike(key, F.lit(_PASSED)), key).when(key == "", F.lit("inline://asset")).otherwise(inline)


def parse_embedding(data: Column) -> Column:
    """A JSON array of numbers; anything else, and an empty one, is null."""
    vector = F.from_json(data, "array<float>")
    return F.when(F.size(vector) > 0, vector)


def parse_valid_at(data: Column) -> Column:
    return F.try_to_timestamp(data, F.lit("yyyy-MM-dd'T'HH:mm:ssX"))


def pack_key(user: Column, stream: Column, agent: Column, role: Column) -> Column:
    """Events of an assistant, or with an agent, go into the agent's pack."""
    who = F.when((role == "assistant") | agent.isNotNull(), F.coalesce(agent, F.lit("default_agent")))
    return F.struct(user.alias("user_id"), stream.alias("stream_id"), who.alias("agent_id"))


def event_tokens(kind: Column | str, data: Column | str) -> Column:
    kind = F.col(kind) if isinstance(kind, str) else kind
    return count_tokens(data) + F.when(kind.isin("Image", "Audio", "Video"), 12).otherwise(0) + 4


def materializable(visible: Column, state: Column, level: Column, domain: Column, embedding: Column) -> Column:
    """Visible published local units of levels 1 to 3 need an embedding."""
    needs = visible & (state == "Published") & level.between(1, 3) & domain.isin("agent", "user")
    return ~needs | (F.coalesce(F.size(embedding), F.lit(0)) > 0)


#: Texts that stand for a missing insight.
PLACEHOLDERS = ("LLM not available", "Unknown Community")


def publishable(domain: Column, level: Column, content: Column) -> Column:
    text = F.trim(content)
    return (domain == "user") & (level == 2) & (text != "") & ~text.isin(*PLACEHOLDERS)


def backoff_seconds(attempts: Column) -> Column:
    a = attempts
    return F.when(a <= 1, 10).when(a == 2, 30).when(a == 3, 120).when(a == 4, 600).otherwise(1800)


def pack_events(events: DataFrame, key: list[str], order: list[str], tokens: str, max_events: int = MAX_PACK_EVENTS, max_tokens: int = MAX_PACK_TOKENS) -> DataFrame:
    """Add ``seq_no``: the pack of an event within its key. A pack ends when the next event
    would be its ``max_events + 1``-th or raise it above ``max_tokens``; an event that is too
    large by itself has a pack of its own. The rule depends on the packs before, so sorted
    partitions stream past a counter: no key is held in memory, however many events it has."""
    import pyarrow as pa

    cols = events.select(*dict.fromkeys([*key, *order, tokens]))
    size = cols.columns.index(tokens)

    def fold(batches):
        now, seq, count, used = None, 0, 0, 0
        for batch in batches:
            out = []
            for who, n in zip(zip(*(batch.column(k).to_pylist() for k in range(len(key)))), batch.column(size).to_pylist()):
                n = n or 0
                if who != now:
                    now, seq, count, used = who, 0, 0, 0
                elif count >= max_events or used + n > max_tokens:
                    seq, count, used = seq + 1, 0, 0
                out.append(seq)
                count, used = count + 1, used + n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "seq_no"])

    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cols.repartition(parts, *key).sortWithinPartitions(*key, *order)
    schema = cols.withColumn("seq_no", F.lit(0).cast("long")).schema
    return rows.mapInArrow(fold, schema)


def schedule_fairly(packs: DataFrame, key: list[str], first: str) -> DataFrame:
    """Add ``slot``: packs taken one a key in turn, keys by their first appearance. ``packs``
    has one row a pack with ``seq_no`` and ``first`` (when the key first appeared)."""
    return gapless_rank(packs, [F.col(c).asc() for c in ("seq_no", first, *key)], "slot")


def within_budget(rows: DataFrame, size: str, budget: int, order: list[str], by: list[str] | None = None) -> DataFrame:
    """The prefix whose running ``size`` (1 or more a row) stays within ``budget``; the first
    row always. Without ``by`` no more than ``budget`` rows can stay, so the rest is cut before
    the running sum."""
    if not by:
        rows = rows.orderBy(*order).limit(budget + 1)
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_used": F.sum(size).over(w), "_n": F.count("*").over(w)})
    return rows.where((F.col("_used") <= budget) | (F.col("_n") == 1)).drop("_used", "_n")


def sliding_duplicates(events: DataFrame, by: list[str], at: str, seconds: int = 3600) -> DataFrame:
    """Add ``duplicate``: an equal key came less than ``seconds`` before. Every occurrence
    renews the window, so the one before decides."""
    before = F.lag(at).over(Window.partitionBy(*by).orderBy(at))
    gap = F.timestamp_diff("MICROSECOND", before, F.col(at))
    return events.withColumn("duplicate", F.coalesce(gap < seconds * 1_000_000, F.lit(False)))


def keyframes(frames: DataFrame, video: str, at: str, vector: str, alike: float | None = 0.9, gap: float = 60) -> DataFrame:
    """Frames kept of each video: the first, and those unlike the last kept one (cosine below
    ``alike``; None: never) or more than ``gap`` after it. What was kept decides, so a video
    folds in order."""
    import numpy as np
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at, kind="stable")
        kept, last, since = [], None, None
        for n, (now, v) in enumerate(zip(pdf[at], pdf[vector])):
            v = np.asarray(v, np.float64)
            v = v / (np.linalg.norm(v) or 1.0)
            if last is None or now - since > gap or (alike is not None and float(v @ last) < alike):
                kept.append(n)
                last, since = v, now
        return pdf.iloc[kept][[video, at]]

    schema = frames.select(video, at).schema
    return frames.select(video, at, vector).groupBy(video).applyInPandas(fold, schema)
