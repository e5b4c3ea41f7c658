"""Checking a whole table of claims: retrieve, rerank, judge, score; one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..backends import FigureJudge, Judge
from ..functions.figures import passage_indices
from ..operators.metrics import score_rows
from ..operators.retrieval import claim_passages


def check_claims(claims: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, judge: Judge | None = None) -> DataFrame:
    """Findings: one row for each claim with its judgment and the passages it rests on."""
    found = claim_passages(claims, chunks, vectors, query_vectors)
    item = F.struct("rank", "chunk_id", "score", "section", "is_table", "text")
    # At most five or eight passages a claim, so the list is bounded.
    listed = found.groupBy("claim_id").agg(F.array_sort(F.collect_list(item)).alias("retrieved"))
    joined = claims.join(listed, "claim_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast(listed.schema["retrieved"].dataType)))
    texts = F.transform("retrieved", lambda p: p["text"])
    judged = joined.withColumn("j", (judge or FigureJudge()).judge(F.col("claim"), texts))
    index = F.when(F.col("j.matched_passage_index").between(1, F.size("retrieved")), F.col("j.matched_passage_index")).otherwise(0)
    return judged.select(
        *claims.columns, F.col("j.classification").alias("nli_label"), F.col("j.confidence_score").alias("nli_confidence"), F.col("j.reasoning").alias("reasoning"),
        index.alias("matched_passage_index"), passage_indices(F.col("j.reasoning"), index, F.size("retrieved")).alias("matched_passage_indices"), "retrieved",
    )


def golden_scores(golden: DataFrame, chunks: DataFrame, **parts) -> DataFrame:
    """Score rows of a golden set checked against the corpus."""
    found = check_claims(golden, chunks, **parts)
    return score_rows(found.withColumns({
        "expected": F.col("expected_nli_label"), "predicted": F.col("nli_label"), "passage_text": F.array_join(F.transform("retrieved", lambda p: p["text"]), "\n"),
    }))


def period_reports(findings: DataFrame) -> DataFrame:
    """One JSON document for each period, claims in id order, fixed key order."""
    claim = F.struct("claim_id", "speaker", "claim", "nli_label", "nli_confidence", "reasoning", "matched_passage_indices", "retrieved")
    grouped = findings.groupBy("ticker", "fiscal_year", "fiscal_quarter").agg(F.array_sort(F.collect_list(F.struct("claim_id", claim.alias("c")))).alias("cs"))
    return grouped.select("ticker", "fiscal_year", "fiscal_quarter", F.to_json(F.struct("ticker", "fiscal_year", "fiscal_quarter", F.transform("cs", lambda x: x["c"]).alias("claims"))).alias("report"))
