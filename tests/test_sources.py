"""Filing and transcript chunkers, JSON records, manifests."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimweave.plans import corpus
from claimweave.sources import filings, jsonl, manifest, transcripts

LONG = "The company sells things to many people in many places and keeps selling them. " * 2

FILING = f"""<html><head><style>p{{}}</style></head><body><div style="display:none">hidden <p>facts</p></div>
<p>Item 7. Management's Discussion</p><p><b>Overview</b></p><p>{LONG}</p><p align="center">Net sales by region</p>
<table><tr><th>Region</th><th>2024</th></tr><tr><td>Americas|All<td>$ 65</td></tr><tr><td></td></tr></table><p>(1) Includes services.</p><p>{LONG}</p>
<p>Part II</p><p>short</p><p>Note 3 Debt</p><p><strong>Terms</strong></p><p>{LONG}</p></body></html>"""


def test_filing_chunks():
    made = filings.chunks_of(FILING)
    kinds = [(c[0], c[1], c[2], c[3]) for c in made]
    assert kinds[0] == (False, "Item 7. Management's Discussion", "Overview", None)
    assert made[1][0] and made[1][4].startswith("Overview\n\nNet sales by region\n\n| Region | 2024 |\n| --- | --- |\n| Americas\\|All | $ 65 |") and made[1][4].endswith("(1) Includes services.")
    assert "hidden" not in " ".join(c[4] for c in made) and "facts" not in " ".join(c[4] for c in made)
    assert made[-1][1] == "Part II"


def test_text_nodes_meet_as_their_characters_ask():
    assert filings.joined(["INCOME STA", "TEMENTS"]) == "INCOME STATEMENTS"
    assert filings.joined(["Note:", "text"]) == "Note: text" and filings.joined(["$", "65,000", ")"]) == "$65,000)"
    assert filings.joined(["BALANCE ", "SHEETS"]) == filings.joined(["BALANCE", " ", "SHEETS"]) == "BALANCE SHEETS"
    assert filings.joined([" a", "\n", "", "b\xa0"]) == "a b" and filings.joined([]) == ""


def test_footers_chrome_and_headers():
    for text in ("(1) Includes services.", "* Less than one", "†", "Note: rounded", "Total net sales include", "includes tax", "Includes tax"):
        assert filings.is_footer(text), text
    for text in ("macOS revenue rose", "iPhone", "Item 7. Risks", "Acme Corp | Annual Report | 12", "Revenue rose", "", "a" * 201, "(1) " + "x" * 400):
        assert not filings.is_footer(text), text
    assert filings.is_chrome("Acme Corp | Annual Report | 12") and filings.is_chrome("Apple Inc. | Q1 2025 Form 10-Q | 6") and not filings.is_chrome("a | b")
    assert filings.section_title("§ 12 Item 7. Discussion") == "Item 7. Discussion" and filings.section_title("The item 7") is None
    heading = filings.Block("text", "Overview", None, True)
    assert filings.is_subsection(heading) and not filings.is_subsection(filings.Block("text", "Overview.", None, True)) and not filings.is_subsection(filings.Block("text", "Overview", "center", True))


def caption_of(*blocks):
    chunker = filings.Chunker(preface=[filings.Block("text", *b) for b in blocks])
    return chunker.caption(), [b.text for b in chunker.preface]


def test_captions():
    long = "The following table shows net sales by category for the years and quarters named in it, which is a caption of more than eighty characters"
    assert caption_of(("prose " * 30,), (long,), ("(In millions)",)) == ([long, "(In millions)"], ["prose " * 30])
    assert caption_of(("one",), ("two",)) == (["two"], ["one"])
    assert caption_of(("Sales:",), ("two",)) == (["Sales:", "two"], [])
    assert caption_of(("A", "center"), ("Acme | Report | 3", "center"), ("B", "center")) == (["A", "B"], [])
    assert caption_of(("x" * 81,)) == ([], ["x" * 81])
    assert caption_of((f"{'y' * 250}:",), (f"{'z' * 150}:",)) == ([f"{'z' * 150}:"], [f"{'y' * 250}:"])
    assert caption_of(("bold one", None, True), ("Acme | Report | 3",), ("plain",)) == (["bold one", "plain"], [])


def test_several_footers_share_one_budget():
    foot = [f"({i}) " + "w" * 150 for i in range(4)]
    made = filings.chunks_of("<table><tr><td>1</td></tr></table>" + "".join(f"<p>{f}</p>" for f in foot))
    assert made[0][4] == "| 1 |\n| --- |\n\n" + "\n\n".join(foot[:2]) and len(made) == 2 and made[1][4] == "\n\n".join(foot[2:])


def test_chunks_carry_their_columns(spark):
    rows = spark.createDataFrame([("a", "Apple", 2025, "Q1", "10-Q", ["2024-10"], FILING), ("b", None, 2025, "Q1", "10-Q", None, FILING), ("b", None, 2025, "Q1", "10-Q", None, None)], "ticker string, company_name string, fiscal_year int, fiscal_quarter string, form string, quarter_months array<string>, html string")
    made = filings.chunk_filings(rows)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = made.collect()
    assert len(got) == 2 * len(filings.chunks_of(FILING)) and {(r.ticker, r.company_name, tuple(r.quarter_months or ())) for r in got} == {("A", "Apple", ("2024-10",)), ("B", None, ())}


def test_notes_pin_the_first_level():
    chunker = filings.Chunker()
    for title in ("Note 3 Debt", "Terms", "Rates"):
        chunker.title(title)
    assert chunker.levels == ["Note 3 Debt", "Rates"]
    chunker.title("Note 4 Tax")
    assert chunker.levels == ["Note 4 Tax", None]


def test_long_and_short_sections():
    body = "\n\n".join(f"<p>{'word ' * 60}</p>" for _ in range(40))
    made = filings.chunks_of(f"<p>Item 1. Business</p>{body}<p>Item 2. Properties</p><p>tiny</p>")
    assert all(len(c[4]) <= filings.MAX_TEXT for c in made) and len(made) >= 3
    assert sum(c[4].count("word") for c in made) == 2400
    assert {c[1] for c in made} == {"Item 1. Business"}
    assert filings.split_long("x" * 8000)[0] == "x" * 3500
    assert filings.chunks_of(None) == filings.chunks_of("") == []


def test_blocks_repair_and_repeat():
    found = filings.blocks_of("<p>one<p>two<div align=right>Right<br>three &amp; ( 4 ) %</div><p>same</p><p>same</p><script>no</script>")
    assert [b.text for b in found] == ["one", "two", "Right", "three & ( 4 ) %", "same"]
    assert found[2].align == "right" and filings.is_subsection(found[2])


CALL = """Date
Thursday
Call Participants
Chief Executive Officer -- not a person
Tim Cook -- Chief Executive Officer
Prepared Remarks:
Operator
Good day, everyone.

Please wait.
Tim Cook
Thank you. Revenue was $65.6 billion.
JANE DOE: Thanks, and hello.
More from Jane.
Conclusion:
of the day"""


def test_turns_and_roles(spark):
    calls = spark.createDataFrame([("AAPL", "Apple", 2025, "Q1", "2025-01-30", CALL), ("X", "X", 2025, "Q1", None, ""), ("Y", "Y", 2025, "Q1", None, None)], "ticker string, company_name string, fiscal_year int, fiscal_quarter string, call_date string, text string")
    got = transcripts.chunk_transcripts(calls).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.speaker_name, r.speaker_role) for r in got][:3] == [
        ("AAPL_2025_Q1_transcript_chunk_0", "Operator", None), ("AAPL_2025_Q1_transcript_chunk_1", "Tim Cook", "Chief Executive Officer"), ("AAPL_2025_Q1_transcript_chunk_2", "Jane Doe", None),
    ]
    assert got[0].text == "Good day, everyone.\n\nPlease wait." and got[2].text == "Thanks, and hello.\nMore from Jane."
    assert {r.ticker for r in got} == {"AAPL"}


def test_json_records(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", None, [1, 2])], "id string, n int, xs array<int>")
    jsonl.write_jsonl(df, f"{tmp_path}/lines")
    assert sorted(map(tuple, jsonl.read_jsonl(spark, f"{tmp_path}/lines", "id string, n int, xs array<int>").collect())) == [("a", 1, None), ("b", None, [1, 2])]
    (tmp_path / "pretty.json").write_text('{\n "id": "a",\n "n": 1\n}\n{"id": "b"}{"id": "c", "n": 3}\n')
    assert [tuple(r) for r in jsonl.read_concatenated(spark, f"{tmp_path}/pretty.json", "id string, n int").collect()] == [("a", 1), ("b", None), ("c", 3)]
    with pytest.raises(ValueError):
        list(jsonl.split_objects('{"a": 1} [2]'))
    with pytest.raises(ValueError):
        list(jsonl.split_objects('{"a": 1'))


def test_manifest(spark, tmp_path):
    (tmp_path / "m.yml").write_text(
        "companies:\n- {ticker: aapl, name: Apple, fiscal_year: 2025, quarters: {1: {transcript_url: ' '}, Q4: {form: 10-k}, 2: {fetch: false}}}\n- {ticker: XY, name: Y, fiscal_year: 2025, include: false, quarters: {3: {}}}\n"
    )
    m = manifest.load_manifest(spark, f"{tmp_path}/m.yml")
    assert sorted((r.ticker, r.fiscal_quarter, r.form, r.transcript_url) for r in manifest.filter_manifest(m).collect()) == [("AAPL", "Q1", "10-Q", None), ("AAPL", "Q4", "10-K", None)]
    assert [r.ticker for r in manifest.filter_manifest(m, tickers=["xy"]).collect()] == ["XY"]
    (tmp_path / "bad.yml").write_text("companies:\n- {ticker: A, name: A, fiscal_year: 1}\n- {ticker: a, name: B, fiscal_year: 1}\n")
    with pytest.raises(ValueError, match="twice"):
        manifest.load_manifest(spark, f"{tmp_path}/bad.yml")


def test_enrichment(spark):
    both = spark.createDataFrame([("AAPL", 2025, "Q1")], "ticker string, fiscal_year int, fiscal_quarter string")
    side = spark.createDataFrame([("AAPL", 2025, "Q1", " ", ["2024-10", "", None])], "ticker string, fiscal_year int, fiscal_quarter string, report_date string, quarter_months array<string>")
    got = manifest.enrich(both, side, ["report_date", "quarter_months"]).first()
    assert got.report_date is None and got.quarter_months == ["2024-10"]


def test_corpus_build_is_incremental(spark, tmp_path):
    page = [("AAPL", "Apple", 2025, "Q1", "10-Q", FILING), ("AAPL", "Apple", 2025, "Q4", "10-K", FILING)]
    docs = spark.createDataFrame(page, "ticker string, company_name string, fiscal_year int, fiscal_quarter string, form string, html string")
    chunks = corpus.chunk_corpus(docs, None)
    built = corpus.build(chunks, str(tmp_path))
    n = built["chunks"].count()
    assert sorted(r.global_id for r in built["vectors"].collect()) == list(range(n)) and n == chunks.count()
    assert built["vectors"].where(F.size("embedding") != 64).count() == 0
    first = corpus.add_new(chunks.where("fiscal_period = 'Q1'"), f"{tmp_path}/grown").count()
    assert corpus.add_new(chunks, f"{tmp_path}/grown").count() == n > first
    assert corpus.add_new(chunks, f"{tmp_path}/grown").count() == n


def test_a_batch_is_read_in_slices_of_bounded_size(monkeypatch):
    monkeypatch.setattr(filings, "SLICE", 10, raising=False)
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["x" * 6, None, "y" * 4, "z" * 30, "w"])], ["k", "html"])
    assert [part.column(0).to_pylist() for part in filings.slices(batch, 1)] == [[0, 1, 2], [3], [4]]
    assert [part.num_rows for part in filings.slices(batch.slice(2), 1)] == [1, 1, 1]
