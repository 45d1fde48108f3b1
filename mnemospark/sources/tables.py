"""Tables of the engine on Parquet: keyed scans, upserts, snapshots, rebuilds.

A key family is a table, a prefix scan a partition filter; there are no secondary indexes, as
Parquet statistics and partitions answer what they were for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(df: DataFrame, key: str, prefix: str | None = None, after: str | None = None, limit: int | None = None, keys_only: bool = False) -> DataFrame:
    """Rows by ascending key; ``after`` is exclusive, as the cursor of the page before."""
    if prefix is not None:
        df = df.where(F.col(key).startswith(prefix))
    if after is not None:
        df = df.where(F.col(key) > after)
    df = df.select(key) if keys_only else df
    if limit is not None:
        return df.orderBy(key).limit(limit)
    return df


def scan_range(df: DataFrame, key: str, start: object, end: object) -> DataFrame:
    return df.where((F.col(key) >= start) & (F.col(key) < end))


def multi_get(df: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows of ``ids`` with ``place``, their order in the list; missing ones are left out."""
    wanted = df.sparkSession.createDataFrame([(x, n) for n, x in enumerate(ids)], f"{key} {df.schema[key].dataType.simpleString()}, place int")
    return df.join(F.broadcast(wanted), key)


def upsert(table: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """The latest row of each key of table and changes; at equal versions the change wins."""
    rows = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rest = [c for c in table.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("x")
    return rows.groupBy(*key).agg(best).select(*key, "x.*").select(*table.columns)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def export_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        write_table(df, f"{path}/{name}")


def restore_snapshot(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def rebuild_report(units: DataFrame, dim: int, decodable: Column) -> DataFrame:
    """What a rebuild of the vector table would do, in one pass."""
    right = decodable & (F.size("embedding") == dim)
    return units.agg(
        F.count("*").alias("scanned"), F.count_if(right).alias("indexed"), F.count_if(decodable & ~F.coalesce(right, F.lit(False))).alias("skipped"), F.count_if(~decodable).alias("decode_errors"),
        F.count_if(F.col("embedding").isNotNull()).alias("with_embedding"),
    )


def schema_status(df: DataFrame, expected: dict[str, str], legacy: dict[str, str]) -> str:
    """``current``, ``legacy`` or ``mismatch``."""
    have = dict(df.dtypes)
    for name, cols in (("current", expected), ("legacy", legacy)):
        if have == cols:
            return name
    return "mismatch"
