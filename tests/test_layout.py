"""Paths, discovery, tolerant readers, sidecars, lookups, downloads and small JSON files."""

import json

import pytest
from pyspark.sql import functions as F

from claimweave.sources import jsonl, layout

FILES = """data/raw/transcripts/2025/AAPL/FY2025_Q1.txt
data/raw/transcripts/2025/AAPL/FY2025_Q4.txt
data/raw/transcripts/2025/AAPL/FY2024_Q3.txt
data/raw/transcripts/2025/AAPL/FY2025_Q1.meta.json
data/raw/transcripts/2025/AAPL/FY2025_Q2.fool.html
data/raw/transcripts/2025/MSFT/FY2025_Q2.txt
data/raw/transcripts/2025/NVDA/FY2025_Q2.txt
data/raw/filings/2025/AAPL/AAPL_FY2025_Q1_10Q.html
data/raw/filings/2025/AAPL/AAPL_FY2025_10K.html
data/raw/filings/2025/AAPL/AAPL_FY2025_10Q.html
data/raw/filings/2025/MSFT/MSFT_FY2025_10Q.html
data/raw/filings/2025/MSFT/AAPL_FY2025_10Q.html
data/claims/2025/AAPL/AAPL_FY2025_Q1_claims.jsonl
data/claims/2025/AAPL/AAPL_FY2025_Q1_claims.json
data/claims/2025/MSFT/MSFT_FY2025_Q2_claims.json
data/eval/claims/2025/AAPL/AAPL_FY2025_Q1_claims.jsonl
data/eval/golden/2025/AAPL/AAPL_FY2025_Q1_golden_claims.jsonl
data/reports/2025/AAPL/AAPL_FY2025_Q1_reports.json
data/reports/golden/2025/AAPL/AAPL_FY2025_Q1_golden_eval.json
data/chunks/2025/AAPL/AAPL_FY2025_Q1_10-Q.jsonl
data/chunks/filings/all_chunks.jsonl""".splitlines()


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(f,) for f in FILES], "path string")


def test_paths_and_what_they_say(spark, files):
    rows = spark.createDataFrame([("aapl", 2025, "q1", "10-Q"), ("AAPL", 2025, "4", "10-K")], "ticker string, fiscal_year int, q string, form string")
    c = [F.col(x) for x in ("ticker", "fiscal_year", "q", "form")]
    for kind in layout.FOLDERS:
        made = [r[0] for r in rows.select(layout.path_of(kind, *c)).collect()]
        assert made[0] in FILES, kind
        named = layout.described(spark.createDataFrame([(p,) for p in made], "path string")).collect()
        assert [(r.kind, r.ticker, r.fiscal_year, r.fiscal_quarter) for r in named] == [(kind, "AAPL", 2025, "Q1"), (kind, "AAPL", 2025, "Q4")]
    assert [r[0] for r in files.limit(1).select(layout.sidecar_of(F.lit("a/FY2025_Q1.txt")), ).collect()] == ["a/FY2025_Q1.meta.json"]
    with pytest.raises(Exception, match="needs its quarter"):
        rows.select(layout.filing_name(F.lit("A"), F.lit("10-Q"), F.lit(2025), F.lit(None))).collect()


def test_complete_periods(files):
    got = {(r.ticker, r.fiscal_quarter): r.filing_path.split("/")[-1] for r in layout.complete_periods(files).collect()}
    assert got == {("AAPL", "Q1"): "AAPL_FY2025_Q1_10Q.html", ("AAPL", "Q4"): "AAPL_FY2025_10K.html", ("MSFT", "Q2"): "MSFT_FY2025_10Q.html"}
    assert layout.complete_periods(files, ["aapl"], [2025], ["Q4"]).count() == 1
    with pytest.raises(ValueError, match="NVDA"):
        layout.complete_periods(files, ["AAPL", "nvda"])


def test_files_of_a_kind(files):
    assert sorted(r.path.split("/")[-1] for r in layout.period_files(files, "claims").collect()) == ["AAPL_FY2025_Q1_claims.jsonl", "MSFT_FY2025_Q2_claims.json"]
    assert layout.period_files(files, "claims", "msft", 2025, "2").count() == 1 and layout.period_files(files, "claims", quarter="Q3").count() == 0
    assert layout.period_files(files, "golden", "AAPL").count() == layout.period_files(files, "eval_claims").count() == layout.chunk_files(files).count() == 1


def test_tolerant_readers(spark):
    rows = [(FILES[17], '{"ticker": "AAPL", "claims": [{"claim": "x"}]}'), (FILES[17].replace("Q1", "Q2"), '{"ticker": '), (FILES[17].replace("Q1", "Q3"), "[1]"), (FILES[17].replace("Q1", "Q4"), None)]
    texts = spark.createDataFrame(rows, "path string, text string")
    schema = "ticker string, claims array<struct<claim:string>>"
    assert [r.value.claims[0].claim for r in layout.reports(texts, schema).collect()] == ["x"]
    kept = layout.parsed(texts, schema, keep_broken=True).orderBy("path").collect()
    assert [r.value.ticker for r in kept] == ["AAPL", None, None, None]
    asked = spark.createDataFrame([("AAPL", 2025, "Q2")], "ticker string, fiscal_year int, fiscal_quarter string")
    assert layout.reports(texts, schema, asked).count() == 0
    golden = spark.createDataFrame([(FILES[16], '{"claim_id": "a"}\n{\n"claim_id": "b"}'), (FILES[16].replace("Q1", "Q2"), "")], "path string, text string")
    assert [(r.ticker, r.fiscal_quarter, r.record.claim_id) for r in layout.records(golden, "claim_id string").collect()] == [("AAPL", "Q1", "a"), ("AAPL", "Q1", "b")]


def test_reading_a_folder(spark, tmp_path):
    at = tmp_path / "data/eval/golden/2025/AAPL"
    at.mkdir(parents=True)
    (at / "AAPL_FY2025_Q1_golden_claims.jsonl").write_text('{"claim_id": "a"}\n{"claim_id": "b"}\n')
    assert layout.period_files(layout.listing(spark, str(tmp_path)), "golden").count() == 1
    assert layout.records(layout.contents(spark, str(tmp_path)), "claim_id string").count() == 2


def test_transcript_text_from_file_or_chunks(spark):
    p = "ticker string, fiscal_year int, fiscal_quarter string"
    periods = spark.createDataFrame([("A", 2025, q) for q in ("Q1", "Q2", "Q3")], p)
    raw = spark.createDataFrame([("A", 2025, "Q1", " stored \n"), ("A", 2025, "Q2", " ")], p + ", text string")
    chunks = spark.createDataFrame([("A", 2025, "Q2", "transcript", 1, "two"), ("A", 2025, "Q2", "transcript", 0, " one "), ("A", 2025, "Q2", "transcript", 2, " "), ("A", 2025, "Q1", "transcript", 0, "x"), ("A", 2025, "Q3", "10-Q", 0, "y")], "ticker string, fiscal_year int, fiscal_period string, doc_type string, pos int, text string")
    got = {r.fiscal_quarter: (r.text, r.origin) for r in layout.transcript_texts(periods, raw, chunks).collect()}
    assert got == {"Q1": ("stored", "transcript"), "Q2": ("one\n\ntwo", "3 chunks"), "Q3": ("", "0 chunks")}


def test_sidecars_keep_what_they_had(spark):
    periods = spark.createDataFrame([("f/A_FY2025_10K.html", "a", 2025, "4", "Acme"), ("t/FY2025_Q1.txt", "a", 2025, "1", " "), ("t/FY2025_Q2.txt", "a", 2025, "2", None)], "path string, ticker string, fiscal_year int, fiscal_quarter string, company_name string")
    old = [("f/A_FY2025_10K.html.meta.json", json.dumps({"accessionNumber": "1-2", "ticker": "old", "quarter_period": {"months": ["2025-01"]}, "note": 'a "b"\n'})), ("t/FY2025_Q1.meta.json", "broken {")]
    now = F.lit("2025-02-03 04:05:06").cast("timestamp")
    got = {r.path: json.loads(r.text) for r in layout.refreshed_sidecars(periods, spark.createDataFrame(old, "path string, text string"), now).collect()}
    assert got["f/A_FY2025_10K.html.meta.json"] == {"accessionNumber": "1-2", "ticker": "A", "quarter_period": {"months": ["2025-01"]}, "note": 'a "b"\n', "fiscal_year": "2025", "fiscal_quarter": "Q4", "company_name": "Acme", "fetched_at": "2025-02-03T04:05:06Z"}
    assert got["t/FY2025_Q1.meta.json"] == {"ticker": "A", "fiscal_year": "2025", "fiscal_quarter": "Q1", "fetched_at": "2025-02-03T04:05:06Z"} and len(got) == 3


def test_ciks(spark):
    remote = spark.createDataFrame([("AAPL", 320193), ("MSFT", 789019)], "ticker string, cik long")
    known = spark.createDataFrame([("MSFT", "0000000007")], "ticker string, cik string")
    asked = spark.createDataFrame([(" aapl",), ("MSFT",)], "ticker string")
    assert sorted(r.cik for r in layout.with_cik(asked, remote, known).collect()) == ["0000000007", "0000320193"]
    with pytest.raises(Exception, match="no CIK of ZZZ"):
        layout.with_cik(spark.createDataFrame([("zzz",)], "ticker string"), remote).collect()


def test_downloads_skip_what_exists(spark):
    wanted = spark.createDataFrame([("a", "u1"), ("b", "u2")], "path string, url string")
    have = spark.createDataFrame([("a",)], "path string")
    get = lambda url: url.encode() * 2
    assert [tuple(r) for r in layout.download(wanted, have, get, wait=0).collect()] == [("b", b"u2u2")]
    assert layout.download(wanted, have, get, wait=0, force=True).count() == 2


def test_small_json_files_keep_their_style(spark, tmp_path):
    path = str(tmp_path / "claims.jsonl")
    assert jsonl.drop_ids(spark, path, ["a"]) == 0
    jsonl.append(spark, path, {"claim_id": "a", "t": "é"})
    jsonl.append(spark, path, {"claim_id": "b"})
    assert open(path, encoding="utf-8").read() == '{"claim_id":"a","t":"é"}\n{"claim_id":"b"}\n'
    jsonl.rewrite(spark, path, list(jsonl.split_objects(open(path).read())), pretty=True)
    assert jsonl.is_pretty(open(path).read()) and not jsonl.is_pretty('{"a":1}\n') and not jsonl.is_pretty("")
    assert jsonl.drop_ids(spark, path, ["a", "zz"]) == 1 and open(path).read() == '{\n\t"claim_id": "b"\n}\n'
