"""Where intermediate tables live, and how a small file uses all cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the context's checkpoint folder; a temporary one in local sessions only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="claimweave-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: computed once, and kept when executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


#: Bytes of a scan, as Parquet, that one task of a costly expression takes at most where ``spread`` deals it.
PIECE = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deals a scan of fewer splits than cores over the cores; a larger or shuffled table stays as it is.

    Worth it before costly expressions only.  What moves is bounded by one split a core.  It is dealt in pieces of
    ``PIECE`` bytes at most, so that tasks don't grow with the table until it has a split for every core.
    """
    if "Exchange" in df._jdf.queryExecution().sparkPlan().toString() or "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()  # huge where unknown
    return df.repartition(max(cores, min(-(-size // PIECE), 64 * cores)))
