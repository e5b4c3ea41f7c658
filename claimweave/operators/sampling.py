"""Deterministic stratified sample of a labelled set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of each label in a small sample.
QUOTAS = {"Consistent": 2, "Contradictory": 1, "Unverifiable": 1}


def seeded(value):
    """First 32 bits of a text's SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(value.cast("string").cast("binary"), 256), 1, 8), 16, 10).cast("long")


def mini_sample(golden: DataFrame, seed: Column | str = "", label: str = "expected_nli_label", key: str = "claim_id", period: tuple[str, ...] = (), full: bool = False) -> DataFrame:
    """Inside each period and label: rows in id order, rotated by a seed, the quota taken."""
    if full:
        return golden
    group = Window.partitionBy(*period, label)
    n = F.count("*").over(group)
    place = F.row_number().over(group.orderBy(key)) - 1
    asked = F.lit(seed) if isinstance(seed, str) else seed
    start = F.pmod(seeded(F.concat(asked, F.lit("|"), F.col(label))), n)
    quota = F.coalesce(*[F.when(F.col(label) == name, F.lit(q)) for name, q in QUOTAS.items()])
    return golden.withColumn("__keep", F.pmod(place - start, n) < quota).where("__keep").drop("__keep")
