"""Shared plumbing of the corpus operators.

Nothing outside this subpackage imports it.  Helpers here only decide *where* intermediate rows
live and *how* Arrow batches reach Python; they hold no operator logic.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, read through Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir`` of the session.

    Only where that setting and the context's own checkpoint folder are unset, and only in a local session
    (tests), is a temporary folder used; a cluster without a shared folder is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="claimweave-"))
    return context.getCheckpointDir()


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage like a checkpoint: the rows survive a lost executor, later branches read the
    same rows (no recomputation of nondeterministic row orders), and columns can be pruned.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what ``durable`` wrote for ``df``, once nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def free(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    while name in taken:
        name += "_"
    return name


def finished(result: DataFrame, *read: DataFrame) -> DataFrame:
    """``result``, a written table, once the written tables that only it ``read`` are deleted.

    The shuffle files behind it go too: Spark removes them when the driver's garbage collector finds their plan
    unused, so the collector is run here rather than at some later time.
    """
    for df in read:
        discard(df)
    result.sparkSession._jvm.System.gc()
    return result


def join_apart(rows: DataFrame, summary: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` to a summary with one row for each ``key``, in exchanges that AQE may split.

    A summary that was just aggregated by ``key`` is partitioned by it already; a plain join would reuse that
    partitioning, and Spark splits no partition that an aggregate depends on.  A second, derived key makes
    the join deal both sides anew, so a key that holds a third of all rows spreads over many tasks.
    """
    apart = free("__apart", [*rows.columns, *summary.columns])
    marked = summary.withColumn(apart, F.xxhash64(key))
    return rows.withColumn(apart, F.xxhash64(key)).join(marked, [key, apart], how).drop(apart)


def map_batches(df: DataFrame, columns: list[str], body: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over the named columns only, so that the scan stays pruned."""
    return df.select(*columns).mapInArrow(body, schema)


def ascii_lower(column):
    """Lower-case A-Z only; every other character is left as it is."""
    return F.translate(column, ASCII_UPPER, ASCII_LOWER)


def row_budget(n_rows: int, per_group: int) -> int:
    """Number of groups that keeps each at about ``per_group`` rows, one at least."""
    return max(1, -(-n_rows // per_group))
