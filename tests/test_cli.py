"""The commands one after the other, over a small data folder."""

import pytest
from test_sources import FILING

from claimweave import cli

WHO = ["Jane Doe -- Chief Financial Officer", "John Roe -- Director of Sales"]
CALL = "Full Conference Call Transcript\n" + "\n".join(f"{WHO[i % 2]}\nSales by region came to ${60 + i} million in the quarter, up {i + 2}% from last year.\n" for i in range(8))


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("cli")
    for kind, names in (("transcripts", {"FY2025_Q1.txt": CALL, "FY2025_Q2.txt": CALL}), ("filings", {"AAPL_FY2025_Q1_10Q.html": FILING})):
        folder = top / "raw" / kind / "2025" / "AAPL"
        folder.mkdir(parents=True)
        for name, text in names.items():
            (folder / name).write_text(text)
    return str(top)


def test_from_files_to_scores(spark, root, capsys):
    run = lambda *args: cli.main([*args, "--root", root], spark)
    assert {r.doc_type for r in run("build-chunks").collect()} == {"10-Q", "transcript"}
    before = spark.read.parquet(f"{root}/tables/chunks").count()
    run("build-chunks")
    assert spark.read.parquet(f"{root}/tables/chunks").count() == before
    assert run("build-indices", "--corpus", "filings", "--force").first().corpus == "filings"
    claims = run("extract-claims", "--most", "8").collect()
    assert len(claims) == 8 and claims[0].claim_id.startswith("AAPL_2025_Q1_")
    assert run("run-nli", "--ticker", "aapl", "--quarter", "1").count() == 8
    assert "# COMPANY_SUMMARY" in capsys.readouterr().out
    made = run("get-candidates")
    assert made.count() == 8
    assert run("verify").count() == 8
    golden = run("promote").count()
    assert spark.read.parquet(f"{root}/tables/candidates").where("is_golden_claim").count() == golden > 0
    summary = run("run-golden").first()
    assert summary.n_claims == golden
    score = spark.read.parquet(f"{root}/tables/scores").where("expected <> 'Unverifiable'").first()
    flips = ["--flip", score.claim_id] if score else []
    assert run("recompute", *flips).first().n_claims == golden
    assert run("backfill").count() == 8
    assert run("probe", "--ticker", "AAPL", "--year", "2025", "--quarter", "Q1", "--claim", "Sales by region came to $65 million").count() == 1
    with pytest.raises(ValueError):
        run("build-chunks", "--ticker", "ZZZ")
