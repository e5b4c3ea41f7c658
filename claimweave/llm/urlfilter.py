"""URL filters: host-suffix and path-prefix rules found by hashed equi-join.  Native throughout.

Every URL is expanded into the expressions ``host suffix || path prefix`` that a rule could have:
only label counts and path lengths that occur among the rules are generated, so the expansion is
bounded by the rule set and not by the length of a URL.  Expressions meet the rules on the first
32 bits of their SHA-256 (the short key that would be shipped to clients); survivors are confirmed
on the full digest.  Of the confirmed rules the longest wins; at equal length the longer host,
then ``allow``.

Scale: the distinct (host, path) pairs are expanded once, not once per row.  The rule side is
joined without a hint, so Spark broadcasts it only while its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.  The join back to the pages has one
row per key on the right, hence AQE may split a hot URL on the left.

Edge cases: a null URL or one without ``://`` has empty host and path and gets the default verdict.
Repeated pages keep their multiplicity.  An empty page or rule table is allowed.  Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: The method's verdict where no rule fits.
DEFAULT_VERDICT = "allow"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def rule_table(rules: DataFrame) -> DataFrame:
    """``rules(host, path, verdict)`` with expression, digests and precedence; later duplicates fold."""
    expression = F.concat(F.col("host"), F.col("path"))
    keyed = rules.select(
        F.lower("host").alias("rule_host"), expression.alias("rule"), "verdict",
        F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_len"),
    )
    best = keyed.groupBy("rule", "rule_host", "labels", "path_len").agg(F.min("verdict").alias("verdict"))
    digest = _digest(F.col("rule"))
    return best.withColumns({"digest": digest, "short": F.substring(digest, 1, 8)})


def judge_urls(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Per row of ``pages``: id, host, path, winning rule (or null) and verdict."""
    ruled = rule_table(rules)
    # Distinct small integers of the rule set: at most its labels times its path lengths.
    shapes = [(r.labels, r.path_len) for r in ruled.select("labels", "path_len").distinct().orderBy("labels", "path_len").collect()]
    rows = pages.select(F.col(id_column), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not shapes:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    host, path = F.col("host"), F.col("path")
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    expressions = F.array(*[
        F.when((dots >= labels - 1) & (F.length(path) >= length), F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, length)))
        for labels, length in shapes
    ])
    expanded = (
        rows.select("host", "path").distinct()
        .select("host", "path", F.explode(F.array_distinct(F.array_compact(expressions))).alias("expression"))
        .withColumn("url_digest", _digest(F.col("expression")))
        .withColumn("short", F.substring("url_digest", 1, 8))
    )
    hit = (
        expanded.join(ruled, "short")
        .where(F.col("url_digest") == F.col("digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(
            F.length("rule").alias("size"), F.length("rule_host").alias("host_size"),
            (F.col("verdict") == "allow").alias("allows"), "rule", "verdict",
        )).alias("best"))
    )
    return (
        rows.join(hit, ["host", "path"], "left")
        .select(id_column, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )
