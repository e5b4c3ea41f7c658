"""Where files of a period lie, what a path says, and readers and writers over those files.

Paths are columns, so a whole manifest resolves in one projection and a whole listing parses in another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids

# Folders and names of files.
FOLDERS = {
    "filing": "raw/filings", "transcript": "raw/transcripts", "chunks": "chunks", "claims": "claims", "eval_claims": "eval/claims", "golden": "eval/golden",
    "report": "reports", "golden_report": "reports/golden",
}
SUFFIXES = {"claims": "claims.jsonl", "eval_claims": "claims.jsonl", "golden": "golden_claims.jsonl", "report": "reports.json", "golden_report": "golden_eval.json"}
META = ".meta.json"
MASTER = "all_chunks.jsonl"
CIK_DIGITS = 10
FILING_WAIT, PAGE_WAIT = 0.2, 1.5
NAME = r"^(?:([^/_]+)_)?FY(\d{4})(?:_Q([1-4]))?(?:_(.+?))?\.(html|txt|jsonl|json)$"
PERIOD = ["ticker", "fiscal_year", "fiscal_quarter"]


def folder(kind: str, ticker: Column, year: Column, root: str = "data") -> Column:
    """``root``/kind/year/TICKER: the year first, so that a listing of one year is one folder."""
    return F.concat_ws("/", F.lit(root), F.lit(FOLDERS[kind]), year.cast("string"), F.upper(ticker))


def filing_name(ticker: Column, form: Column, year: Column, quarter: Column) -> Column:
    """``AAPL_FY2025_Q1_10Q.html`` or ``AAPL_FY2025_10K.html``; a quarterly form without its quarter is an error."""
    slug = F.regexp_replace(F.upper(form), "[^A-Z0-9]+", "")
    label = ids.quarter_label(quarter)
    quarterly = F.when(label.isNull(), F.raise_error(F.lit("a 10-Q needs its quarter"))).otherwise(F.concat_ws("_", label, slug))
    tail = F.when(slug == "10Q", quarterly).otherwise(slug)
    return F.concat(F.upper(ticker), F.lit("_FY"), year.cast("string"), F.lit("_"), tail, F.lit(".html"))


def path_of(kind: str, ticker: Column, year: Column, quarter: Column, form: Column | None = None, root: str = "data") -> Column:
    """Path of a period's file of one kind; ``form`` is the form of a filing or the document type of chunks."""
    stem = F.concat(F.lit("FY"), year.cast("string"), F.lit("_"), ids.quarter_label(quarter))
    if kind == "filing":
        name = filing_name(ticker, form, year, quarter)
    elif kind == "transcript":
        name = F.concat(stem, F.lit(".txt"))
    elif kind == "chunks":
        name = F.concat(F.upper(ticker), F.lit("_"), stem, F.lit("_"), F.replace(form, F.lit("/"), F.lit("-")), F.lit(".jsonl"))
    else:
        name = F.concat(F.upper(ticker), F.lit("_"), stem, F.lit("_" + SUFFIXES[kind]))
    return F.concat_ws("/", folder(kind, ticker, year, root), name)


def sidecar_of(path: Column) -> Column:
    """Next to a filing with its whole name, next to a transcript in place of ``.txt``."""
    return F.concat(F.regexp_replace(path, r"\.txt$", ""), F.lit(META))


def described(files: DataFrame) -> DataFrame:
    """``files(path, ...)`` with kind, ticker, fiscal_year, fiscal_quarter and form; paths of no known kind are left out.

    A file counts only in the folder of its own ticker and year.  A quarterly filing of the older naming has no quarter.
    """
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    above = F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 3, F.lit(0))), "/"))
    read = F.struct(
        above.alias("above"), F.try_element_at(parts, F.lit(-3)).try_cast("int").alias("folder"), F.try_element_at(parts, F.lit(-2)).alias("ticker"),
        *[F.regexp_extract(name, NAME, i).alias(k) for i, k in ((1, "of"), (3, "q"), (4, "rest"), (5, "ending"))], F.regexp_extract(name, NAME, 2).try_cast("int").alias("year"),
    )
    # A row of its own for what was read, so that the planner computes it once.
    rows = files.select(*files.columns, F.explode(F.array(read)).alias("__r")).where("__r.folder = __r.year and (__r.of = '' or upper(__r.of) = upper(__r.ticker))")
    r = F.col("__r")
    at = {kind: r["above"].endswith("/" + where) for kind, where in FOLDERS.items()}
    named, lines = r["of"] != "", r["ending"].isin("jsonl", "json")
    quarterly = r["q"] != ""
    tests = (
        ("filing", at["filing"] & named & (r["ending"] == "html") & ((r["rest"] == "10Q") | ((r["rest"] == "10K") & ~quarterly))),
        ("transcript", at["transcript"] & ~named & quarterly & (r["ending"] == "txt") & (r["rest"] == "")),
        ("transcript_html", at["transcript"] & ~named & quarterly & (r["ending"] == "html") & (r["rest"] == "")),
        ("eval_claims", at["eval_claims"] & named & quarterly & lines & (r["rest"] == "claims")),
        ("claims", at["claims"] & ~at["eval_claims"] & named & quarterly & lines & (r["rest"] == "claims")),
        ("golden", at["golden"] & named & quarterly & (r["ending"] == "jsonl") & (r["rest"] == "golden_claims")),
        ("golden_report", at["golden_report"] & named & quarterly & (r["ending"] == "json") & (r["rest"] == "golden_eval")),
        ("report", at["report"] & named & quarterly & (r["ending"] == "json") & (r["rest"] == "reports")),
        ("chunks", at["chunks"] & named & quarterly & (r["ending"] == "jsonl") & (r["rest"] != "")),
    )
    kind = F.lit(None).cast("string")
    for label, holds in reversed(tests):
        kind = F.when(holds, label).otherwise(kind)
    form = F.when(F.col("kind") == "filing", F.replace("__r.rest", F.lit("10"), F.lit("10-"))).when(F.col("kind") == "chunks", F.col("__r.rest"))
    quarter = F.when(quarterly, F.concat(F.lit("Q"), r["q"])).when((F.col("kind") == "filing") & (r["rest"] == "10K"), "Q4")
    return rows.withColumn("kind", kind).where("kind is not null").select(
        *files.columns, "kind", F.upper("__r.ticker").alias("ticker"), F.col("__r.year").alias("fiscal_year"), quarter.alias("fiscal_quarter"), form.alias("form"),
    )


def complete_periods(files: DataFrame, tickers: Sequence[str] = (), years: Sequence[int] = (), quarters: Sequence[str] = ()) -> DataFrame:
    """(ticker, fiscal_year, fiscal_quarter, form, transcript_path, filing_path) of periods that have both files.

    A quarter takes its own filing, else the older file of its year without a quarter.  A ticker that was asked
    for and has no period is an error.
    """
    known = described(files)
    for name, wanted in (("ticker", [t.strip().upper() for t in tickers]), ("fiscal_year", list(years))):
        known = known.where(F.col(name).isin(wanted)) if wanted else known
    calls = known.where("kind = 'transcript'").select(*PERIOD, F.col("path").alias("transcript_path"))
    calls = calls.where(F.col("fiscal_quarter").isin(list(quarters))) if quarters else calls
    calls = calls.withColumn("form", F.when(F.col("fiscal_quarter") == "Q4", "10-K").otherwise("10-Q"))
    filings = known.where("kind = 'filing'")
    own = filings.where("fiscal_quarter is not null").select(*PERIOD, "form", F.col("path").alias("own_path"))
    older = filings.where("fiscal_quarter is null and form = '10-Q'").groupBy("ticker", "fiscal_year", "form").agg(F.min("path").alias("older_path"))
    found = calls.join(own, [*PERIOD, "form"], "left").join(older, ["ticker", "fiscal_year", "form"], "left")
    found = found.withColumn("filing_path", F.coalesce("own_path", "older_path")).where("filing_path is not null").drop("own_path", "older_path")
    if tickers:
        there = {r["ticker"] for r in found.select("ticker").distinct().collect()}  # at most as many as were asked for
        lacking = sorted({t.strip().upper() for t in tickers} - there)
        if lacking:
            raise ValueError(f"no filing and transcript of one period for {', '.join(lacking)}")
    return found.select(*PERIOD, "form", "transcript_path", "filing_path")


def period_files(files: DataFrame, kind: str, ticker: str | None = None, year: int | None = None, quarter: str | None = None) -> DataFrame:
    """Files of one kind in path order of a scope; a folder that has JSON lines ignores its older JSON files."""
    found = described(files).where(F.col("kind") == kind)
    for name, value in (("ticker", ticker and ticker.strip().upper()), ("fiscal_year", year)):
        found = found.where(F.col(name) == value) if value is not None else found
    found = found.withColumn("__lines", F.col("path").endswith(".jsonl"))
    found = found.withColumn("__any", F.max("__lines").over(Window.partitionBy("ticker", "fiscal_year"))).where("__lines or not __any").drop("__lines", "__any")
    if quarter is not None:
        found = found.where(F.col("fiscal_quarter") == ids.strict_quarter(F.lit(quarter)))
    return found


def chunk_files(files: DataFrame) -> DataFrame:
    """Chunk files of single periods; the merged one is none of them."""
    return described(files.where(~F.col("path").endswith("/" + MASTER))).where("kind = 'chunks'")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``path`` of every file under a folder, listed by Spark's file index; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")


def contents(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of every file under a folder."""
    return spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def parsed(files: DataFrame, schema: str, keep_broken: bool = False) -> DataFrame:
    """``files(path, text)`` -> path and ``value``.  A text that is no JSON object is left out, or an empty object if kept."""
    tagged = files.withColumn("__v", F.from_json("text", f"{schema}, __broken string", {"columnNameOfCorruptRecord": "__broken"}))
    names = [c for c in tagged.schema["__v"].dataType.names if c != "__broken"]
    whole = F.trim("text").startswith("{") & F.col("__v").isNotNull() & F.col("__v.__broken").isNull()
    value = F.struct(*[F.when(whole, F.col("__v")[c]).alias(c) for c in names])
    return tagged.where(F.lit(keep_broken) | F.coalesce(whole, F.lit(False))).withColumn("value", value).drop("__v", "text")


def records(files: DataFrame, schema: str) -> DataFrame:
    """Objects of concatenated-JSON files with the period that their path names: (path, ticker, ..., record)."""
    from .jsonl import objects

    named = described(files)
    return objects(named, "text").withColumn("record", F.from_json("object", schema)).drop("object", "text")


def reports(files: DataFrame, schema: str, claims: DataFrame | None = None) -> DataFrame:
    """Readable reports; missing and broken ones are passed over.  With ``claims``, those of its periods only."""
    found = parsed(described(files).where(F.col("kind").isin("report", "golden_report")), schema)
    return found if claims is None else found.join(claims.select(*PERIOD).distinct(), PERIOD, "left_semi")


def transcript_texts(periods: DataFrame, raw: DataFrame, chunks: DataFrame) -> DataFrame:
    """``periods`` with text and origin: the stored transcript, else its chunks joined by blank lines, else empty.

    ``raw(ticker, fiscal_year, fiscal_quarter, text)``; ``chunks`` of transcripts with ``pos`` in document order.
    A period's chunks are one document, so the joined text is bounded by it.
    """
    stored = raw.select(*PERIOD, F.nullif(F.regexp_replace("text", r"^\s+|\s+$", ""), F.lit("")).alias("__raw"))
    said = chunks.where("doc_type = 'transcript'").select("ticker", "fiscal_year", F.col("fiscal_period").alias("fiscal_quarter"), "pos", F.regexp_replace("text", r"^\s+|\s+$", "").alias("t"))
    held = said.groupBy(*PERIOD).agg(F.count("*").alias("__n"), F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("__parts"))
    joined = F.array_join(F.filter(F.transform("__parts", lambda p: p["t"]), lambda t: t != ""), "\n\n")
    out = periods.join(stored, PERIOD, "left").join(held, PERIOD, "left")
    return out.withColumns({
        "text": F.coalesce("__raw", joined, F.lit("")), "origin": F.when(F.col("__raw").isNotNull(), "transcript").otherwise(F.concat(F.coalesce("__n", F.lit(0)).cast("string"), F.lit(" chunks"))),
    }).drop("__raw", "__n", "__parts")


def refreshed_sidecars(periods: DataFrame, sidecars: DataFrame, now: Column | None = None) -> DataFrame:
    """(path, text): the sidecar of every period, its own fields kept, those of the period set anew.

    ``periods(path, ticker, fiscal_year, fiscal_quarter, company_name)``; ``sidecars(path, text)`` may lack some or
    hold text that is no JSON object, which counts as an empty one.  Members keep their JSON whatever their type.
    """
    old = sidecars.select("path", F.from_json("text", "map<string,string>").alias("__old"))
    empty = F.create_map().cast("map<string,string>")
    quoted = lambda c: F.to_json(F.array(c.cast("string")))
    fresh = {
        "ticker": F.upper("ticker"), "fiscal_year": F.col("fiscal_year").cast("string"), "fiscal_quarter": ids.quarter_label(F.col("fiscal_quarter")),
        "company_name": ids.blank_to_null(F.col("company_name")), "fetched_at": F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd'T'HH:mm:ssXXX"),
    }
    new = F.map_filter(F.create_map(*[x for k, v in fresh.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    joined = periods.withColumn("path", sidecar_of(F.col("path"))).join(old, "path", "left").withColumns({"__old": F.coalesce("__old", empty), "__new": new})
    members = F.map_concat(F.map_filter("__old", lambda k, v: ~F.array_contains(F.map_keys("__new"), k)), F.col("__new"))
    pair = lambda k, v: F.concat(F.substring(quoted(k), F.lit(2), F.length(quoted(k)) - 2), F.lit(": "), F.when(v.rlike(r"^\s*[\[{]"), v).when(v.isNull(), F.lit("null")).otherwise(F.substring(quoted(v), F.lit(2), F.length(quoted(v)) - 2)))
    body = F.array_join(F.transform(F.array_sort(F.map_entries(members)), lambda e: pair(e["key"], e["value"])), ",\n  ")
    return joined.select("path", F.concat(F.lit("{\n  "), body, F.lit("\n}\n")).alias("text"))


def with_cik(companies: DataFrame, remote: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``companies`` with the ten-digit ``cik`` of their ticker, from the ``known`` ones first; none at all is an error."""
    table = remote.select(F.upper(F.trim("ticker")).alias("__t"), F.col("cik").cast("string").alias("c"), F.lit(1).alias("o"))
    if known is not None:
        table = known.select(F.upper(F.trim("ticker")).alias("__t"), F.col("cik").cast("string").alias("c"), F.lit(0).alias("o")).unionByName(table)
    first = table.groupBy("__t").agg(F.min_by("c", F.struct("o", F.length("c"), "c")).alias("__cik"))
    joined = companies.withColumn("__t", F.upper(F.trim("ticker"))).join(first, "__t", "left")
    return joined.withColumn("cik", F.when(F.col("__cik").isNull(), F.raise_error(F.concat(F.lit("no CIK of "), F.col("__t")))).otherwise(F.lpad("__cik", CIK_DIGITS, "0"))).drop("__t", "__cik")


def download(wanted: DataFrame, have: DataFrame, get: Callable[[str], bytes], wait: float = PAGE_WAIT, force: bool = False) -> DataFrame:
    """(path, content) of ``wanted(path, url)`` that are not in ``have(path)`` yet, or of all with ``force``.

    ``get`` fetches one address.  One task asks, with a pause between requests, as hosts ask of their visitors.
    """
    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        due = 0.0
        for batch in batches:
            for path, url in batch.itertuples(index=False):
                time.sleep(max(0.0, due - time.monotonic()))
                due = time.monotonic() + wait
                yield pd.DataFrame({"path": [path], "content": [get(url)]})

    todo = wanted.select("path", "url")
    todo = todo if force else todo.join(have.select("path").distinct(), "path", "left_anti")
    return todo.coalesce(1).mapInPandas(body, "path string, content binary")
