"""Context for a model: token costs, tiers, blocks, budgets, and bounded joins of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_tokens, lit_or, preview, truncate_to_tokens, xml_escape
from .ingest import asset_key

PREVIEW_CHARS = {"tiny": 88, "compact": 160, "detailed": 320}
KEYWORDS = {"tiny": 0, "compact": 3, "detailed": 6}


def asset_label(kind: Column) -> Column:
    low = F.lower(kind)
    return F.when(low.startswith("image"), "Image").when(low.startswith("audio"), "Audio").when(low.startswith("video"), "Video").otherwise("Asset")


def asset_reference(kind: Column, key: Column) -> Column:
    return asset_key(kind, key)


def token_cost(content: Column | str, keywords: Column | str) -> Column:
    return F.greatest(F.lit(1).cast("long"), count_tokens(content) + count_tokens(F.array_join(lit_or(keywords), " ")))


def tier(budget: Column) -> Column:
    return F.when(budget <= 160, "tiny").when(budget <= 480, "compact").otherwise("detailed")


def priority(level: Column, tier_name: Column) -> Column:
    """Which levels come first: insights where room is short, details where it is not."""
    orders = {"tiny": (2, 3, 1), "compact": (2, 1, 3), "detailed": (1, 2, 3)}
    out = F.lit(3)
    for name, levels in orders.items():
        for place, x in enumerate(levels):
            out = F.when((tier_name == name) & (level == x), place).otherwise(out)
    return out


def search_limit(limit: Column, tier_name: Column) -> Column:
    base = F.greatest(F.lit(1), F.least(F.lit(24), limit))
    wide = F.when(tier_name == "tiny", F.least(F.lit(64), base * 4)).when(tier_name == "compact", F.least(F.lit(48), base * 3))
    return wide.otherwise(F.least(F.lit(32), base * 2))


def list_item(units: DataFrame) -> DataFrame:
    """Dashboard list view; organization knowledge shows no user and no agent."""
    own = F.col("domain") != "organization"
    return units.withColumns({
        "user_id": F.when(own, F.col("user_id")), "agent_id": F.when(own, F.col("agent_id")), "preview": preview("content", 160),
    })


def text_block(tier_name: str) -> Column:
    """One unit as a text block, from columns level, memory_type, domain, content, keywords."""
    head = F.concat(F.lit("- [L"), F.col("level").cast("string"), F.lit(" "), "memory_type", F.lit(" "), "domain", F.lit("] "))
    block = F.concat(head, preview("content", PREVIEW_CHARS[tier_name]))
    n = KEYWORDS[tier_name]
    if n:
        words = F.concat(F.lit("\n  Keywords: "), F.array_join(F.slice("keywords", 1, n), ", "))
        block = F.concat(block, F.when(F.size("keywords") > 0, words).otherwise(""))
    return block


def xml_block(tier_name: str) -> Column:
    attrs = F.concat(F.lit('<memory level="'), F.col("level").cast("string"), F.lit('" type="'), "memory_type", F.lit('" domain="'), "domain", F.lit('">'))
    body = F.concat(F.lit("<content>"), xml_escape(preview("content", PREVIEW_CHARS[tier_name])), F.lit("</content>"))
    n = KEYWORDS[tier_name]
    words = F.lit("")
    if n:
        joined = F.array_join(F.transform(F.slice("keywords", 1, n), xml_escape), ", ")
        words = F.when(F.size("keywords") > 0, F.concat(F.lit("<keywords>"), joined, F.lit("</keywords>"))).otherwise("")
    return F.concat(attrs, body, words, F.lit("</memory>"))


def greedy_budget(hits: DataFrame, by: str, order: list[Column], cost: str, budget: int) -> DataFrame:
    """Rows kept in order while they fit; one that does not fit is skipped and later ones may
    still be kept. The state depends on what was kept, so each group (bounded by the caller's
    top-k) folds over its ordered costs with native array functions."""
    w = Window.partitionBy(by).orderBy(*order)
    ranked = hits.withColumn("_n", F.row_number().over(w))
    costs = ranked.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_n", F.col(cost).cast("long").alias("c")))).alias("xs"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + x["c"] <= budget
        kept = F.when(fits, F.concat(s["kept"], F.array(x["_n"]))).otherwise(s["kept"])
        return F.struct(F.when(fits, s["used"] + x["c"]).otherwise(s["used"]).alias("used"), kept.alias("kept"))

    kept = costs.select(by, F.explode(F.aggregate("xs", start, step)["kept"]).alias("_n"))
    return ranked.join(kept, [by, "_n"]).drop("_n")


def render(hits: DataFrame, by: str, budget: int, xml: bool = False) -> DataFrame:
    """``(by, context, used_tokens, included, matched, truncated)`` of each query's hits (bounded
    by the caller's top-k): blocks by tier priority and score while the whole text fits; the
    first that does not is cut (text only, over 12 tokens left) and ends the context."""
    name = "tiny" if budget <= 160 else "compact" if budget <= 480 else "detailed"
    rank = priority(F.col("level"), F.lit(name))
    block = xml_block(name) if xml else text_block(name)
    rows = hits.select(by, F.struct(rank.alias("p"), (-F.col("score")).alias("s"), F.col("id").alias("i"), block.alias("block")).alias("x"))
    rows = rows.groupBy(by).agg(F.array_sort(F.collect_list("x")).alias("xs"), F.count("*").alias("matched"))
    opening, closing, gap = ("<memory_context>", "</memory_context>", "") if xml else ("", "", "\n")
    start = F.struct(F.lit(opening).alias("text"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(s: Column, x: Column) -> Column:
        sep = F.when(s["n"] == 0, "").otherwise(gap)
        longer = F.concat(s["text"], sep, x["block"])
        fits = count_tokens(longer) <= budget
        left = budget - count_tokens(s["text"])
        cut = F.when((left > 12) & F.lit(not xml), truncate_to_tokens(x["block"], left)).otherwise("")
        text = F.when(s["done"], s["text"]).when(fits, longer).when(cut != "", F.concat(s["text"], sep, cut)).otherwise(s["text"])
        more = (~s["done"] & (fits | (cut != ""))).cast("int")
        return F.struct(text.alias("text"), (s["n"] + more).alias("n"), (s["done"] | ~fits).alias("done"))

    out = rows.select(by, "matched", F.aggregate("xs", start, step).alias("f"))
    text = F.col("f.text")
    closes = count_tokens(F.concat(text, F.lit(closing))) <= budget
    text = F.when(closes | (budget - count_tokens(text) >= count_tokens(F.lit(closing))), F.concat(text, F.lit(closing))).otherwise(text)
    cut = F.col("f.done") | (F.col("f.n") < F.col("matched")) | ~closes
    out = out.select(by, text.alias("context"), F.col("f.n").cast("long").alias("included"), "matched", cut.alias("truncated"))
    return out.withColumn("used_tokens", count_tokens("context"))


def bounded_concat(rows: DataFrame, by: str, order: str, piece: str, most: int = 100_000, separator: str = "\n") -> DataFrame:
    """``(by, text)``: pieces joined in order until the next would pass ``most`` bytes. At most
    ``most`` pieces of a group are gathered, as each has a separator."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    size = F.octet_length(piece) + len(separator.encode())
    kept = rows.withColumn("_used", F.sum(size).over(w)).where(F.col("_used") - len(separator.encode()) <= most)
    texts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(piece).alias("p"))))
    return kept.groupBy(by).agg(F.array_join(F.transform(texts, lambda x: x["p"]), separator).alias("text"))
