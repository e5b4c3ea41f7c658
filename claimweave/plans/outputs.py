"""Result sinks: metrics of a run as CSV and JSON, the two-section run summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics


def write_run(scores: DataFrame, path: str) -> None:
    """summary, confusion, confusion_pct, buckets and per_claim as CSV folders, metrics as JSON."""
    tables = {
        "summary": metrics.metric_rows(scores), "confusion": metrics.confusion(scores),
        "confusion_pct": metrics.confusion_pct(scores).select("expected", *[F.format_string("%.4f", c).alias(c) for c in metrics.LABELS]),
        "buckets": metrics.bucket_counts(scores),
    }
    for name, table in tables.items():  # a few rows each
        table.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/{name}")
    joined = {c: F.array_join(c, "|") for c in ("matched_figures", "missing_figures")}
    scores.withColumns(joined).write.mode("overwrite").option("header", "true").csv(f"{path}/per_claim")
    metrics.summary(scores).write.mode("overwrite").json(f"{path}/metrics")


def run_summary(findings: DataFrame) -> list[str]:
    """Lines of the run summary: companies with a TOTAL, then periods with a TOTAL."""
    rolled = metrics.period_rollup(findings).orderBy("ticker", "years", "quarters").collect()  # one row a period and company
    head = ["ticker", "years", "quarters", "claims", *[x.lower() for x in metrics.LABELS]]
    total = next((r for r in rolled if r["kind"] == "total"), None)
    out = []
    for kind, title in (("company", "# COMPANY_SUMMARY"), ("period", "# PERIOD_DETAIL")):
        rows = [r for r in rolled if r["kind"] == kind] + ([total] if total else [])
        out += [title, ",".join(head), *(",".join(str(r[c]) for c in head) for r in rows), ""]
    return out[:-1]
