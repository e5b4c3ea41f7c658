"""Text, figure and calendar functions on hand-made cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from claimweave.functions import figures, fiscal, ids, rewrite, similarity, text


def values(spark, cases, expression):
    rows = [(i, *(c if isinstance(c, tuple) else (c,))) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} string" for n, _ in zip("abcd", rows[0][1:], strict=False)))
    return [r.v for r in df.select("i", expression.alias("v")).orderBy("i").collect()]


def test_unit_expansion(spark):
    cases = {
        "Revenue hit $65.6 billion": "Revenue (net sales) hit $65.6 billion (65600 million)",
        "cash of 24B rose": "cash of 24B (24000 million) rose",
        "cash of 24.5 billion dollars in all": "cash of 24.5 billion dollars (24500 million) in all",
        "24 billion dollars (24000 million) stays": "24 billion dollars (24000 million) stays",
        "revenues (net sales) of $5": "revenues (net sales) of $5",
        "revenue was strong": "revenue was strong",
        "1.2345 billion and 3b, 4 bees": "1.2345 billion (1234.5 million) and 3b (3000 million), 4 bees",
        "": "",
    }
    assert values(spark, list(cases), rewrite.expand_units(F.col("a"))) == list(cases.values())


def test_scope_and_period_wording(spark):
    cases = [("Q4 revenue", "Q4"), ("fiscal-year sales", "4"), ("the quarter, annual", "q4"), ("sales rose", "Q4"), ("annual sales", "Q3"), ("annual", None), ("annual", "H1"), ("FY2025 sales", "Q4")]
    want = ["Q4_COMPOSITE", "FULL_YEAR_ONLY", "Q4_COMPOSITE", "Q4_COMPOSITE", *["STANDARD_QUARTER"] * 3, "FULL_YEAR_ONLY"]
    assert values(spark, cases, rewrite.temporal_scope(F.col("a"), F.col("b"))) == want
    assert values(spark, ["December quarter  sales", "sales rose"], rewrite.nine_month_query(F.col("a"))) == ["nine months ended period sales", "for nine months ended period sales rose"]


def test_figures(spark):
    cases = {
        "$58,900 million, 4.5%, 2024, 12 stores": ["num:12", "pct:4.5", "usd_m:58900"],
        "$58.9 billion": ["usd_m:5.89e+07"],
        "1,234% of 250": ["pct:1234", "pct:234", "usd_m:250"],
        "3M and 3 million and 7 men": ["num:7", "usd_m:3"],
        "1,234": [], "": [], None: [],
    }
    assert values(spark, list(cases), figures.reference_figures(F.col("a"))) == list(cases.values())


def test_truth_tokens_and_match(spark):
    assert values(spark, ["Services revenue grew 12% to $26.3 billion, the revenue record"], figures.truth_tokens(F.col("a"))) == [["pct:12", "usd_m:2.63e+07", "services", "revenue", "grew"]]
    m = figures.match_truth(F.array(F.lit("usd_m:65600"), F.lit("pct:4"), F.lit("services")), F.col("a"))
    got = values(spark, ["Sales 65,600 for SERVICES", "65.6 and 14%", "nothing"], m)
    assert [(round(r.rate, 3), r.hit) for r in got] == [(0.667, True), (0.667, True), (0.0, False)]
    assert values(spark, ["x"], figures.match_truth(F.array().cast("array<string>"), F.col("a")))[0].hit is False


def test_exactly_half_is_a_miss_for_truth_and_a_hit_for_money(spark):
    two = F.array(F.lit("pct:4"), F.lit("usd_m:70"))
    assert values(spark, ["4%"], figures.match_truth(two, F.col("a"))["hit"]) == [False]
    assert values(spark, ["4%"], figures.score_overlap(two, F.array(F.lit("pct:4")), "half_money")["hit"]) == [True]


def test_recall_modes(spark):
    case = [("Sales of $70 million, up 4%", "Passage 1 says 4% and $70 million")]
    for mode in ("reasoning_half", "hybrid", "strict"):
        hit = similarity.recall_hit(F.col("a"), F.array(F.lit("sales were $70 million")), F.col("b"), mode)
        assert values(spark, case, hit) == [mode != "strict"]
    with pytest.raises(ValueError):
        similarity.recall_hit(F.col("a"), F.array(), F.col("b"), "other")
    assert values(spark, [("same words", "same words"), ("", "x")], similarity.text_similarity(F.col("a"), F.col("b"))) == [1.0, 0.0]


def test_passage_indices(spark):
    assert values(spark, ["Passage 3 and passage 2; Passage 9", "", None], figures.passage_indices(F.col("a"), F.lit(1), F.lit(5))) == [[1, 2, 3], [1], [1]]


def test_tokens_keywords_and_white_space(spark):
    assert values(spark, ["Sales: $1,234.5 (up 4%), e-mail", "", None], text.tokens(F.col("a"))) == [["sales", "1234.5", "up", "4", "e", "mail"], [], []]
    assert values(spark, ["The Well-known brand's growth, brand's X1 io"], text.keywords(F.col("a"))) == [["well-known", "brand's"]]
    assert values(spark, ["  a  \t b\n\n\n\nc "], text.normalize_ws(F.col("a"))) == ["a b\n\nc"]
    assert values(spark, ["a. " * 300], F.length(text.last_break(F.col("a"), 400)))[0] <= 400


def test_fiscal_calendar(spark):
    df = spark.createDataFrame([(y, m, q) for y, m in ((2025, 1), (2025, 9), (2025, 12)) for q in range(1, 5)], "fy int, fye int, q int")
    got = [(r.p.label, r.p.end_year, r.p.end_month, r.p.months) for r in df.select(fiscal.quarter_period(F.col("fy"), F.col("fye"), F.col("q")).alias("p")).collect()]
    assert got[4] == ("FY2025 Q1", 2024, 12, ["2024-10", "2024-11", "2024-12"])
    assert got[0][1:3] == (2024, 4) and got[3][1:3] == (2025, 1) and got[11][1:3] == (2025, 12)
    reports = [datetime.date(2024, 12, 28), datetime.date(2025, 1, 2), datetime.date(2024, 10, 28), datetime.date(2023, 12, 28)]
    scored = spark.createDataFrame([(i, d) for i, d in enumerate(reports)], "i int, d date").select("i", fiscal.report_match_score(F.col("d"), F.lit(2025), F.lit(9), F.lit(1)).alias("s")).orderBy("i")
    assert [r.s for r in scored.collect()] == [0, 126, None, None]
    assert values(spark, ["0928", "928", "", "1331", None], fiscal.year_end_month(F.col("a"))) == [9, 9, 12, 12, 12]
    assert values(spark, ["2024-02-30", "2024-02-29T10:00", ""], fiscal.iso_date(F.col("a"))) == [None, datetime.date(2024, 2, 29), None]


def test_identities(spark):
    assert values(spark, ["1", " q3", "Q4", "5", "true", None], ids.quarter_label(F.col("a"))) == ["Q1", "Q3", "Q4", None, None, None]
    with pytest.raises(Exception, match="fiscal quarter"):
        values(spark, ["H1"], ids.strict_quarter(F.col("a")))
    assert values(spark, [("10-q", "Q4"), (None, "Q4"), ("8-K", "Q2")], ids.resolved_form(F.col("a"), F.col("b"))) == ["10-Q", "10-K", "10-Q"]
    assert values(spark, ["aapl"], ids.claim_id(F.col("a"), F.lit(2025), F.lit("Q1"), F.lit(3))) == ["AAPL_2025_Q1_03"]
