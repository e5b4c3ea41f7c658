"""Scoring against a labelled set: buckets, confusion, headline figures, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.figures import match_truth, passage_indices, truth_tokens
from ..schemas import BUCKETS, LABELS


def bucket(expected: Column, predicted: Column, hit: Column) -> Column:
    """One of five buckets; a missing hit on a verifiable claim is an error."""
    right = expected == predicted
    return (
        F.when(expected == "Unverifiable", "unverifiable_nli")
        .when(hit.isNull(), F.raise_error(F.lit("a verifiable claim has no retrieval hit")).cast("string"))
        .when(hit & right, "both_ok").when(hit, "nli_hallucination").when(right, "lucky_nli").otherwise("both_fail")
    )


def _labels(spark: SparkSession, name: str, values=LABELS) -> DataFrame:
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{name} string, place int")


def confusion(scores: DataFrame) -> DataFrame:
    """Counts of predicted labels in columns for each expected label, zeros filled in."""
    counted = scores.groupBy("expected").agg(*[F.count_if(F.col("predicted") == label).alias(label) for label in LABELS])
    return F.broadcast(_labels(scores.sparkSession, "expected")).join(counted, "expected", "left").na.fill(0, list(LABELS)).drop("place")


def confusion_pct(scores: DataFrame) -> DataFrame:
    """The same as shares of each row; an empty row is all zero."""
    total = sum((F.col(label) for label in LABELS[1:]), F.col(LABELS[0]))
    return confusion(scores).select("expected", *[F.coalesce(F.round(F.try_divide(F.col(label), total), 4), F.lit(0.0)).alias(label) for label in LABELS])


def bucket_counts(scores: DataFrame) -> DataFrame:
    counted = scores.groupBy("bucket").agg(F.count("*").alias("n"))
    return F.broadcast(_labels(scores.sparkSession, "bucket", BUCKETS)).join(counted, "bucket", "left").na.fill(0, ["n"]).drop("place")


def _share(of: Column, among: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(F.count_if(among & of), F.count_if(among)), 6), F.lit(0.0))


def summary(scores: DataFrame) -> DataFrame:
    """One row: counts, accuracy over all, over verifiable and over unverifiable claims, recall."""
    verifiable, right = F.col("expected") != "Unverifiable", F.col("expected") == F.col("predicted")
    return scores.agg(
        F.count("*").alias("n_claims"), F.count_if(verifiable).alias("n_verifiable"), F.count_if(~verifiable).alias("n_unverifiable"),
        _share(right, F.lit(True)).alias("accuracy_all"), _share(right, verifiable).alias("accuracy_verifiable"),
        _share(right, ~verifiable).alias("accuracy_unverifiable"), _share(F.coalesce("retrieval_hit", F.lit(False)), verifiable).alias("recall"),
    )


def label_counts(findings: DataFrame, *keys: str) -> DataFrame:
    return findings.groupBy(*keys).agg(F.count("*").alias("claims"), *[F.count_if(F.col("nli_label") == label).alias(label.lower()) for label in LABELS])


def period_rollup(findings: DataFrame) -> DataFrame:
    """Period rows, company rows and one TOTAL row by grouping sets, with label counts.

    ``findings(ticker, fiscal_year, fiscal_quarter, nli_label)``.  ``years`` and ``quarters`` list what a
    company's rows cover, sorted and joined by ``;``.
    """
    counts = [F.count("*").alias("claims"), *[F.count_if(F.col("nli_label") == label).alias(label.lower()) for label in LABELS]]
    listed = [F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ";").alias(a) for c, a in (("fiscal_year", "years"), ("fiscal_quarter", "quarters"))]
    work = findings.withColumns({"y": F.col("fiscal_year"), "q": F.col("fiscal_quarter")})
    rolled = work.groupingSets([["ticker", "y", "q"], ["ticker"], []], "ticker", "y", "q").agg(F.grouping_id().alias("level"), *counts, *listed)
    kind = F.when(F.col("level") == 0, "period").when(F.col("level") == 3, "company").otherwise("total")
    return rolled.select(kind.alias("kind"), F.when(F.col("level") == 7, "TOTAL").otherwise(F.col("ticker")).alias("ticker"), "years", "quarters", "claims", *[label.lower() for label in LABELS])


def chunk_summary(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("ticker", "fiscal_year", "fiscal_period", "doc_type").agg(
        F.count("*").alias("chunks"), F.count_if("is_table").alias("tables"), F.count_distinct("speaker_name").alias("speakers"), F.count_distinct("section").alias("sections"),
    )


def score_rows(findings: DataFrame) -> DataFrame:
    """Findings with reasoning and passages -> score rows; a truth match decides the hit of verifiable claims."""
    match = match_truth(truth_tokens(F.col("claim")), F.concat_ws("\n", "reasoning", "passage_text"))
    judged = findings.withColumn("m", match)
    hit = F.when(F.col("expected") != "Unverifiable", F.col("m.hit"))
    return judged.withColumn("retrieval_hit", hit).select(
        "claim_id", "ticker", "fiscal_year", "fiscal_quarter", "expected", "predicted", (F.col("expected") == F.col("predicted")).alias("nli_correct"),
        "retrieval_hit", bucket(F.col("expected"), F.col("predicted"), F.col("retrieval_hit")).alias("bucket"), "nli_confidence",
        F.col("m.matched").alias("matched_figures"), F.col("m.missing").alias("missing_figures"),
    )


def recompute(reports: DataFrame, flips: DataFrame | None = None) -> DataFrame:
    """Score rows from stored reports ``(.., claims array<struct>)`` without retrieving again.

    ``flips(claim_id, retrieval_hit)`` are manual overrides.
    """
    rows = score_rows(reports.select("ticker", "fiscal_year", "fiscal_quarter", F.inline("claims")))
    if flips is None:
        return rows
    changed = rows.join(flips.select("claim_id", F.col("retrieval_hit").alias("flip")), "claim_id", "left")
    hit = F.when(F.col("expected") != "Unverifiable", F.coalesce("flip", "retrieval_hit"))
    return changed.withColumn("retrieval_hit", hit).withColumn("bucket", bucket(F.col("expected"), F.col("predicted"), F.col("retrieval_hit"))).select(*rows.columns)


def backfill_indices(reports: DataFrame) -> DataFrame:
    """Passage indices from stored reasoning alone: the model's own pick is not taken in."""
    return reports.withColumn("matched_passage_indices", passage_indices(F.col("reasoning"), F.lit(0), F.col("n_passages")))


def metric_rows(scores: DataFrame) -> DataFrame:
    """Summary as (metric, value) rows for a CSV sink."""
    one = summary(scores)
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, one.columns)), F.array(*[F.col(c).cast("double") for c in one.columns]))).alias("metric", "value"))
