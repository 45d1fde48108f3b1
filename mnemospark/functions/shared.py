"""Shared storage, written tables and gapless ranks.

Intermediate results live in the folder the cluster names in ``spark.checkpoint.dir``; a
lost executor then costs a re-read, not a recomputation of the whole lineage.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a private local one only on a local master that names
    none (tests). A cluster must name one: its machines share no local folder."""
    sc = spark.sparkContext
    own = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not own and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not own:
        own = tempfile.mkdtemp(prefix="mnemospark-")
        atexit.register(shutil.rmtree, own, True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(own)
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def spread(table: DataFrame) -> DataFrame:
    """A table that is read in fewer parts than there are cores, dealt to all of them: one file of
    one row group is one task otherwise. Larger tables stay as they are read, without a shuffle."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else as it is. ``df`` is
    counted, so it should be a written table or cheap to make."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session is gone; the folder's owner cleans up
        pass


def gapless_rank(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Add ``out``: the row's position from 0 in the total order ``order``.

    One range shuffle, then a checkpoint whose partitions are counted: the only state that
    meets in one place is one count per partition. Ties get distinct, adjacent ranks.
    """
    spark = df.sparkSession
    shared_dir(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn(out, F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright(F.col(out), _ROW_BITS)
    sizes = {r["p"]: r["n"] for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for p in range(max(sizes, default=-1) + 1):
        starts.append(before)
        before += sizes.get(p, 0)
    if not starts:
        return ranged.withColumn(out, F.lit(0).cast("long"))
    offsets = F.array(*[F.lit(x).cast("long") for x in starts])
    inside = F.col(out).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return ranged.withColumn(out, F.get(offsets, part.cast("int")) + inside)
