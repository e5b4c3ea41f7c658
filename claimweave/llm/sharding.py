"""Sharding by proportional stratified interleaving, law ``rows``.  DataFrame operations throughout.

Rows of one source are shuffled by a seeded hash and ranked; a row's place in the whole is its
fractional rank ``(2 r + 1) / (2 n_source)``.  Sorting everything by that fraction interleaves the
sources in proportion, and cutting the order into equal runs gives shards whose mixture matches the
corpus and whose row counts differ by one at most.

Scale: no rank is ever computed over a whole source or a whole table in one task.  Both ranks are
two-level: a row falls into one of ``n / ROWS_PER_BUCKET`` equal slices of the hash (or of the
fraction), slice counts are pre-aggregated and summed up into offsets, and ``row_number`` runs inside
a slice only.  Slices hold about ``ROWS_PER_BUCKET`` rows however large one source is.  Ranks are taken of
narrow rows; the whole rows, numbered in a written copy, are shuffled once to meet their place.

Edge cases: a null text has size 1 and checksum 0; a null source is a source of its own; ties of the
hash fall back to the id, then to the checksum; repeated rows each get a place of their own; a very long
text is moved once and counts as one row; an empty table gives no rows; extra columns stay, but for the three
that are set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, row_budget

ROWS_PER_BUCKET = 20_000
RUN = 1024
SEED = 20
PLACEMENT = ["shard", "slot", "place"]
ROW = "__row"


def _offsets(counts: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """``before``: rows in the smaller buckets of the same keys.  Two steps, so that a window holds ``RUN`` buckets, or one row a run."""
    counts = counts.withColumn("run", F.floor(F.col(bucket) / RUN).cast("long"))
    runs = counts.groupBy(*keys, "run").agg(F.sum("rows").alias("in_run"))
    earlier = Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*keys, "run", F.coalesce(F.sum("in_run").over(earlier), F.lit(0)).alias("before_run"))
    inside = Window.partitionBy(*keys, "run").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("inside", F.coalesce(F.sum("rows").over(inside), F.lit(0))).join(runs, [*keys, "run"]).withColumn("before", F.col("before_run") + F.col("inside")).drop("run", "inside", "before_run")


def _placed(docs: DataFrame, n: int, n_shards: int, seed: int, rows_per_bucket: int) -> DataFrame:
    """Per row of ``docs``: __row, shard, slot and place."""
    buckets = row_budget(n, rows_per_bucket)
    token = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    stratum = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-"))
    part = F.floor(F.conv(F.substring("token", 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32)).cast("long")
    keyed = docs.select(ROW, "doc_id", stratum.alias("stratum"), token.alias("token"), F.crc32(_bytes()).alias("text_crc32")).withColumn("part", part)

    counts = docs.select(stratum.alias("stratum"), token.alias("token")).withColumn("part", part).groupBy("stratum", "part").agg(F.count("*").alias("rows"))
    totals = counts.groupBy("stratum").agg(F.sum("rows").alias("in_stratum"))
    offsets = _offsets(counts, ["stratum"], "part").join(totals, "stratum").drop("rows")
    inside = Window.partitionBy("stratum", "part").orderBy("token", "doc_id", "text_crc32", ROW)
    ranked = (
        keyed.join(offsets, ["stratum", "part"])
        .withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
        .withColumn("fraction", (2 * F.col("rank") + 1) / (2 * F.col("in_stratum")))
        .select(ROW, "doc_id", "text_crc32", "token", "fraction", F.floor(F.col("fraction") * buckets).cast("long").alias("slice"))
    )
    # Both the slice counts and the final order read these narrow rows; the written copy is the one order.
    ranked = durable(ranked, "interleave")
    sliced = _offsets(ranked.groupBy("slice").agg(F.count("*").alias("rows")), [], "slice").drop("rows")
    order = Window.partitionBy("slice").orderBy("fraction", "token", "doc_id", "text_crc32", ROW)
    placed = ranked.join(sliced, "slice").withColumn("place", F.col("before") + F.row_number().over(order) - 1)
    shard = F.floor((F.lit(n_shards) * (F.col("place") + 1) - 1) / F.lit(max(n, 1)))
    return (
        placed.withColumn("shard", shard.cast("int"))
        .select(ROW, "shard", (F.col("place") - F.floor(F.col("shard").cast("long") * n / F.lit(n_shards))).cast("long").alias("slot"), "place")
    )


def _bytes():
    return F.coalesce(F.col("text").cast("binary"), F.lit(b""))


def place_rows(docs: DataFrame, n_shards: int = 8, seed: int = SEED, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """All columns of ``docs`` with shard, slot and place; columns of those three names are replaced."""
    kept = [c for c in docs.columns if c not in PLACEMENT]
    numbered = durable(docs.select(*kept).withColumn(ROW, F.monotonically_increasing_id()), "rows")
    placed = _placed(numbered, numbered.count(), n_shards, seed, rows_per_bucket)
    return numbered.join(placed, ROW).select(*kept, *PLACEMENT)


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, seed: int = SEED, rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
    """Writes the placed rows as Parquet, one folder ``shard=N`` a shard; inside each file they stand by slot.

    A shard is as many files as its rows need at ``rows_per_bucket``, none of them dealt to one task.
    """
    placed = place_rows(docs, n_shards, seed, rows_per_bucket)
    files = row_budget(docs.count(), rows_per_bucket)
    placed.repartitionByRange(max(files, n_shards), "place").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def interleaved_shards(docs: DataFrame, n_shards: int = 8, seed: int = SEED, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Digest of ``place_rows``: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law) and place."""
    return place_rows(docs, n_shards, seed, rows_per_bucket).select(
        "doc_id", (F.octet_length(_bytes()) + 1).cast("long").alias("size"), F.crc32(_bytes()).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "place",
    )
