"""Company manifests (YAML), best filings and sidecar enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids

ENTRY = "ticker string, name string, fiscal_year int, include boolean, quarters map<int, struct<fetch: boolean, transcript_url: string, form: string>>"


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``companies:``; the driver reads one small file, two rows for one ticker and year are an error."""
    import yaml

    text = "\n".join(r.value for r in spark.read.text(path).collect())  # one manifest file
    rows = []
    for entry in (yaml.safe_load(text) or {}).get("companies", []):
        quarters = {}
        for key, spec in (entry.get("quarters") or {}).items():
            number = str(key).strip().upper().removeprefix("Q")
            if isinstance(key, bool) or number not in ("1", "2", "3", "4"):
                raise ValueError(f"not a fiscal quarter: {key!r}")
            if int(number) in quarters:
                raise ValueError(f"quarter {number} is listed twice")
            spec = spec or {}
            quarters[int(number)] = (bool(spec.get("fetch", True)), (spec.get("transcript_url") or "").strip() or None, (spec.get("form") or "").strip().upper() or None)
        name = str(entry.get("name") or "").strip()
        if not name:
            raise ValueError("a company without a name")
        rows.append((str(entry["ticker"]).strip().upper(), name, int(entry["fiscal_year"]), bool(entry.get("include", True)), quarters))
    keys = [(r[0], r[2]) for r in rows]
    if len(set(keys)) < len(keys):
        raise ValueError("a ticker is listed twice for one year")
    return spark.createDataFrame(rows, ENTRY)


def periods(manifest: DataFrame, fetch_only: bool = True) -> DataFrame:
    """One row for each company, year and quarter."""
    flat = manifest.select("ticker", "name", "fiscal_year", "include", F.explode("quarters").alias("quarter", "spec"))
    if fetch_only:
        flat = flat.where("spec.fetch")
    label = ids.quarter_label(F.col("quarter"))
    return flat.select("ticker", F.col("name").alias("company_name"), "fiscal_year", "include", label.alias("fiscal_quarter"), ids.resolved_form(F.col("spec.form"), label).alias("form"), F.col("spec.transcript_url").alias("transcript_url"))


def filter_manifest(manifest: DataFrame, tickers: Sequence[str] = (), years: Sequence[int] = (), quarters: Sequence[str] = (), include_only: bool = True) -> DataFrame:
    """Named tickers count even where the manifest does not include them."""
    out = periods(manifest)
    if tickers:
        out = out.where(F.col("ticker").isin([t.strip().upper() for t in tickers]))
    elif include_only:
        out = out.where("include")
    if years:
        out = out.where(F.col("fiscal_year").isin(list(years)))
    return out.where(F.col("fiscal_quarter").isin(list(quarters))) if quarters else out


def columnar_rows(submissions: DataFrame, keys: Sequence[str], inside: str = "recent") -> DataFrame:
    """Parallel arrays of one struct as rows; a submission that lacks an array has none."""
    arrays = [F.col(f"{inside}.{k}") for k in keys]
    whole = F.lit(True)
    for a in arrays:
        whole = whole & a.isNotNull()
    return submissions.where(whole).select(*[c for c in submissions.columns if c != inside], F.inline(F.arrays_zip(*[a.alias(k) for a, k in zip(arrays, keys, strict=True)])))


def enrich(periods_: DataFrame, sidecars: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Sidecar values fill what a period lacks; blank ones count as absent."""
    key = ["ticker", "fiscal_year", "fiscal_quarter"]
    side = sidecars.select(*key, *[F.col(f).alias(f"side_{f}") for f in fields])
    joined = periods_.join(side, key, "left")
    text = dict(joined.dtypes)
    cols = {f: F.coalesce(F.col(f) if f in periods_.columns else F.lit(None), ids.listed(F.col(f"side_{f}")) if text[f"side_{f}"].startswith("array") else ids.blank_to_null(F.col(f"side_{f}"))) for f in fields}
    return joined.withColumns(cols).drop(*[f"side_{f}" for f in fields])


def best_filing(reports: DataFrame, keys: Sequence[str], score: str = "score", position: str = "position") -> DataFrame:
    """The candidate with the lowest score for every key; rows without a score are no candidates."""
    best = F.min_by(F.struct(*[c for c in reports.columns if c not in keys]), F.struct(score, position)).alias("best")
    return reports.where(F.col(score).isNotNull()).groupBy(*keys).agg(best).select(*keys, "best.*")
