"""Tables staged in the folder that all machines of a cluster share, and joins that survive hot keys."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where that is unset and all tasks run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        folder = "file://" + tempfile.mkdtemp(prefix="sparksift-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Write and read back, which cuts the lineage; the table goes with the session."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sparksift-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal out tables that fewer tasks would read than there are cores, by a key.

    Larger tables stay as they are: their scan is spread already, and texts aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows and bytes, so that long texts don't fill a worker's memory.

    The settings stay with the session, as Spark reads them when a lazy result runs."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


#: A key is hot if it holds more than one row in HOT_SHARE; there are at most HOT_SHARE such keys.
HOT_SHARE = 200


def skew_join(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int, spread: str) -> DataFrame:
    """Left join of rows to groups (unique by key, with `count` rows each in
    `rows`, `total` in all).  Hot keys - at most HOT_SHARE by the pigeonhole
    principle, however large the data - are broadcast; their rows get spread
    keys (made from the column `spread`) for the join of the rest, so that no
    task holds a hot group.

    Groups' columns come back under their own names; `key` and `count` of groups don't."""
    values = [c for c in groups.columns if c not in (key, count)]
    hot = groups.where(F.col(count) * HOT_SHARE > F.lit(total)).select(F.col(key).alias("__hot"), F.struct(*values).alias("__hot_value"))
    cold = groups.where(F.col(count) * HOT_SHARE <= F.lit(total)).select(F.col(key).alias("__cold"), F.lit(0).alias("__spread"), F.struct(*values).alias("__cold_value"))
    names = rows.columns
    tagged = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    tagged = tagged.withColumn("__at", F.when(F.col("__hot").isNull() & F.col(key).isNotNull(), 0).otherwise(F.xxhash64(spread).bitwiseAND(F.lit(0x7FFFFFFE)).bitwiseOR(F.lit(1)).cast("int")))
    joined = tagged.join(cold, (F.col(key) == F.col("__cold")) & (F.col("__at") == F.col("__spread")), "left")
    value = F.coalesce("__hot_value", "__cold_value")
    return joined.select(*[F.col(f"`{c}`") for c in names], *[value[c].alias(c) for c in values])
