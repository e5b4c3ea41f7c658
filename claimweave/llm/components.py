"""Connected components of an edge table, without collecting edges or labels to the driver.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014): every node ends as a neighbour of the smallest id of its component, after a number of
rounds that grows with the logarithm of the component size.  Each round is written to the shared
folder, so a lost executor never replays earlier rounds; the driver sees one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, join_apart


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return join_apart(both, least, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return join_apart(down, least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of long ids -> ``(node, root)`` for every node that is not its own root.

    Self loops and repeated edges are allowed; an empty table gives an empty result.
    """
    edges = durable(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    before = _checksum(edges)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        after_round = durable(_small_star(_large_star(edges)).where("a < b").distinct(), "edges")
        discard(edges)
        edges = after_round
        after = _checksum(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
