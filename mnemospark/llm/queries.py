"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranges import range_bucket
from ..functions.shared import spread, written
from . import brown_lm, decontam, digests, licenses, packing, pseudonyms, quotes, sharding, simhash, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tokenizer_path() -> str:
    """The public vocabulary that op8 packs by; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def _with_next(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, next_id, next_text)``, the next row by ascending id, the first after
    the last. Rows are dealt by id ranges; only each range's first row meets its neighbour."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # several ranges a partition even out what each gets
    parts = min(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16384)
    rows = rows.withColumn("bucket", range_bucket(rows, "doc_id", parts))
    firsts = rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    firsts = written(firsts, "firsts")
    by_range = Window.orderBy("bucket")  # of at most ``parts`` numbers
    before = F.coalesce(F.lag("bucket").over(by_range), F.max("bucket").over(Window.partitionBy()))
    ranges = firsts.select("bucket", before.alias("before"))
    firsts = firsts.join(F.broadcast(ranges), "bucket").select(F.col("before").alias("bucket"), "first")
    order = Window.partitionBy("bucket").orderBy("doc_id", F.xxhash64("text"))
    rows = rows.withColumns({"after": F.lead(F.struct("doc_id", "text")).over(order)})
    after = F.coalesce("after", "first")
    return rows.join(firsts, "bucket", "left").select(
        "doc_id", "text", after["doc_id"].alias("next_id"), after["text"].alias("next_text")
    )


def op2_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each text and of its edited text; ids are taken as unique (rows that repeat
    an id get the least of its fingerprints). A null id is an id like others, the first."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut))
    rows = _with_next(docs).select("doc_id", "next_id", n.cast("long").alias("n_chars"), edited.alias("text"))
    rows = written(rows.withColumn("edited_sha256", F.sha2("text", 256)), "edited")
    keep = ["doc_id", "next_id", "n_chars", "edited_sha256"]
    both = rows.unionByName(docs, allowMissingColumns=True)
    prints = written(digests.fingerprints(both, keep), "prints")
    own = prints.where("edited_sha256 is null").groupBy("doc_id").agg(F.min("fingerprint").alias("fingerprint"))
    following = own.select(F.col("doc_id").alias("after"), F.col("fingerprint").alias("next_fingerprint"))
    out = prints.where("edited_sha256 is not null").withColumnRenamed("fingerprint", "edited_fingerprint")
    out = out.join(own.withColumnRenamed("doc_id", "own"), F.col("doc_id").eqNullSafe(F.col("own")), "left")
    out = out.join(following, F.col("next_id").eqNullSafe(F.col("after")), "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        digests.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        digests.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(_table(spark, sf_dir, "conversations"))[0]


#: Stands in for the secret a deployment passes in.
PSEUDONYM_KEY = "documents pseudonym key"


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, PSEUDONYM_KEY, count_col="n_values")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(toxicity.learnable()))
    found = toxicity.score(docs, model)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return found.select("doc_id", (~toxicity.learnable()).alias("held_out"), "score", predicted)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    found = brown_lm.score(_table(spark, sf_dir, "documents"), train)
    cols = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    return found.select("doc_id", (~train).alias("held_out"), *cols)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(_table(spark, sf_dir, "documents"), 8)
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_digests, op3_licenses, op4_decontam, op5_quotes,
        op6_pseudonyms, op7_toxicity, op8_packing, op9_brown_lm, op10_sharding,
    )
}
ORACLE_SQL: dict[str, str] = {}
