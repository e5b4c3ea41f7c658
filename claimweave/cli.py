"""Commands over a data folder: chunks, indices, claims, checks, golden sets and their scores.

``python -m claimweave.cli COMMAND --root data [--ticker T] [--year Y] [--quarter Q] [--force]``.  Every command reads
tables under the root, does its step for all periods in scope in one plan, and writes a table; a period that is done is
passed over unless forced.  Model steps use the local stand-ins of ``backends``.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backends
from .functions import ids
from .operators import golden, metrics
from .operators.relational import pending, upsert
from .plans import claim_check, corpus, outputs
from .session import session
from .sources import call_pages, layout
from .storage import exists, written

PERIOD = layout.PERIOD
COMMANDS: dict[str, Callable[[SparkSession, argparse.Namespace], DataFrame | None]] = {}


def command(f):
    COMMANDS[f.__name__.replace("_", "-")] = f
    return f


def table(spark: SparkSession, a: argparse.Namespace, name: str) -> DataFrame:
    return spark.read.parquet(f"{a.root}/tables/{name}")


def scoped(df: DataFrame, a: argparse.Namespace) -> DataFrame:
    for name, value in (("ticker", a.ticker and a.ticker.strip().upper()), ("fiscal_year", a.year)):
        df = df.where(F.col(name) == value) if value is not None else df
    return df if a.quarter is None else df.where(F.col("fiscal_quarter") == ids.strict_quarter(F.lit(a.quarter)))


def kept(spark: SparkSession, a: argparse.Namespace, name: str, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Writes ``rows`` into a table: on a common key the new row wins.  The whole is written aside before it replaces the old one."""
    path = f"{a.root}/tables/{name}"
    whole = written(upsert(table(spark, a, name), rows, keys) if exists(spark, path) else rows, name)
    whole.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fresh(spark: SparkSession, a: argparse.Namespace, rows: DataFrame, done: str, keys: Sequence[str] = PERIOD) -> DataFrame:
    if a.force or not exists(spark, f"{a.root}/tables/{done}"):
        return rows
    return pending(rows, table(spark, a, done), keys)


@command
def read_pages(spark, a):
    """Saved transcript pages to clean transcripts and what their sidecars hold."""
    pages = layout.described(layout.contents(spark, f"{a.root}/raw")).where("kind = 'transcript_html'")
    pages = fresh(spark, a, scoped(pages, a).withColumnRenamed("text", "html").withColumn("url", F.lit(a.url)), "transcripts")
    made = call_pages.extract_calls(pages, PERIOD).where("fault is null").drop("fault")
    return kept(spark, a, "transcripts", made, PERIOD)


@command
def build_chunks(spark, a):
    """Raw filings and transcripts of complete periods to chunk rows."""
    files = layout.contents(spark, f"{a.root}/raw")
    found = layout.complete_periods(files.select("path"), *([x] if x else () for x in (a.ticker, a.year)), [ids_quarter(a.quarter)] if a.quarter else ())
    found = fresh(spark, a, found, "periods").withColumn("company_name", F.col("ticker"))
    text = files.withColumnRenamed("text", "body")
    filings = found.join(text.withColumnRenamed("path", "filing_path"), "filing_path").withColumnRenamed("body", "html")
    calls = found.join(text.withColumnRenamed("path", "transcript_path"), "transcript_path").withColumnRenamed("body", "text").withColumn("call_date", F.lit(None).cast("string"))
    out = kept(spark, a, "chunks", corpus.chunk_corpus(filings, calls), ["chunk_id"])
    kept(spark, a, "periods", found.select(*PERIOD, "form"), PERIOD)
    return metrics.chunk_summary(out)


def ids_quarter(value: str) -> str:
    number = str(value).strip().upper().removeprefix("Q")
    if number not in ("1", "2", "3", "4"):
        raise ValueError(f"not a fiscal quarter: {value}")
    return f"Q{number}"


@command
def build_indices(spark, a):
    for name in [a.corpus] if a.corpus else ["filings", "transcripts"]:
        corpus.build(table(spark, a, "chunks"), f"{a.root}/indices", name, force=a.force, max_chunks=a.max_chunks)
    return corpus.load(spark, f"{a.root}/indices", a.corpus or "filings")["manifest"]


@command
def extract_claims(spark, a):
    """Claims of every call in scope; with ``--modify`` only those marked for it are replaced."""
    chunks = table(spark, a, "chunks").withColumn("pos", F.regexp_extract("chunk_id", r"_chunk_(\d+)$", 1).cast("int"))
    periods = chunks.where("doc_type = 'transcript'").select("ticker", "fiscal_year", F.col("fiscal_period").alias("fiscal_quarter")).distinct()
    texts = layout.transcript_texts(scoped(periods, a), periods.limit(0).withColumn("text", F.lit("")), chunks)
    made = backends.SentenceExtractor(a.most).extract(texts, PERIOD)
    made = golden.claim_ids(made.withColumns({"speaker": F.lit(None).cast("string"), "regenerate": F.lit(False)}))
    if a.modify:
        current = scoped(table(spark, a, "claims"), a)
        return kept(spark, a, "claims", golden.regenerate(current, made), ["claim_id"])
    return kept(spark, a, "claims", fresh(spark, a, made, "claims"), ["claim_id"])


@command
def run_nli(spark, a):
    """Checks the claims in scope, writes findings and a report a period, and prints the run's summary."""
    claims = fresh(spark, a, scoped(table(spark, a, "claims"), a), "findings", ["claim_id"])
    found = kept(spark, a, "findings", claim_check.check_claims(claims, table(spark, a, "chunks")), ["claim_id"])
    claim_check.period_reports(found).write.mode("overwrite").partitionBy("ticker", "fiscal_year").parquet(f"{a.root}/tables/reports")
    print("\n".join(outputs.run_summary(scoped(found, a))))
    return scoped(found, a)


@command
def get_candidates(spark, a):
    """Eight-slot candidate sets of the claims in scope; with ``--modify`` their open slots anew."""
    source = scoped(table(spark, a, "claims"), a)
    if not a.modify:
        made = fresh(spark, a, golden.golden_set(source).withColumn("speaker", F.lit(None).cast("string")), "candidates")
    else:
        slot = F.regexp_extract("claim_id", r"_(\d+)$", 1).cast("int") - 1
        made = golden.modify_set(scoped(table(spark, a, "candidates"), a).withColumn("slot", slot), source).drop("slot")
    return kept(spark, a, "candidates", made, ["claim_id"])


@command
def verify(spark, a):
    """Checks candidates: up to eight of a period that are not done, or with ``--modify`` all that are not golden."""
    candidates = scoped(table(spark, a, "candidates"), a)
    done = table(spark, a, "verified") if exists(spark, f"{a.root}/tables/verified") else candidates.limit(0)
    todo = golden.to_verify(candidates, done, a.modify)
    return kept(spark, a, "verified", claim_check.check_claims(todo, table(spark, a, "chunks")), ["claim_id"])


@command
def promote(spark, a):
    """Confirmed candidates become golden rows, and their candidates are marked."""
    made = golden.promote(scoped(table(spark, a, "verified"), a))
    kept(spark, a, "candidates", golden.mark_golden(table(spark, a, "candidates"), made), ["claim_id"])
    return kept(spark, a, "golden", made, ["claim_id"])


@command
def run_candidates(spark, a):
    """Candidates, their verification and promotion, one after the other."""
    for step in (get_candidates, verify):
        step(spark, a)
    return promote(spark, a)


@command
def run_golden(spark, a):
    """Scores of the golden set against the corpus."""
    scores = kept(spark, a, "scores", claim_check.golden_scores(scoped(table(spark, a, "golden"), a), table(spark, a, "chunks")), ["claim_id"])
    outputs.write_run(scores, f"{a.root}/runs/golden")
    return metrics.summary(scores)


@command
def recompute(spark, a):
    """Metrics from stored scores, with retrieval hits turned over for the claims named by ``--flip``."""
    scores = table(spark, a, "scores")
    turned = F.when(F.col("claim_id").isin(a.flip), ~F.col("retrieval_hit")).otherwise(F.col("retrieval_hit"))
    again = scores.withColumn("retrieval_hit", turned).withColumn("bucket", metrics.bucket(F.col("expected"), F.col("predicted"), F.col("retrieval_hit")))
    outputs.write_run(again, f"{a.root}/runs/golden")
    return metrics.summary(again)


@command
def backfill(spark, a):
    """Passage indices of stored findings from their reasoning."""
    found = scoped(table(spark, a, "findings"), a).withColumn("n_passages", F.size("retrieved"))
    return kept(spark, a, "findings", metrics.backfill_indices(found).drop("n_passages"), ["claim_id"])


@command
def probe(spark, a):
    """Checks one claim of a period; asked again, its row is replaced."""
    row = [("probe_" + a.ticker.upper(), a.ticker.upper(), a.year, ids_quarter(a.quarter), None, a.claim)]
    claim = spark.createDataFrame(row, "claim_id string, ticker string, fiscal_year int, fiscal_quarter string, speaker string, claim string")
    return kept(spark, a, "probes", claim_check.check_claims(claim, table(spark, a, "chunks")), ["claim_id"])


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="claimweave", description=__doc__.split("\n")[0])
    out.add_argument("command", choices=sorted(COMMANDS))
    out.add_argument("--root", default="data")
    for name in ("ticker", "quarter", "corpus", "claim", "url"):
        out.add_argument(f"--{name}")
    for name in ("year", "max-chunks"):
        out.add_argument(f"--{name}", type=int)
    out.add_argument("--most", type=int, default=10)
    out.add_argument("--flip", nargs="*", default=[])
    for name in ("force", "modify"):
        out.add_argument(f"--{name}", action="store_true")
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> DataFrame | None:
    a = parser().parse_args(argv)
    out = COMMANDS[a.command](spark or session(), a)
    if out is not None and spark is None:
        out.show(20, truncate=80)
    return out


if __name__ == "__main__":
    main()
