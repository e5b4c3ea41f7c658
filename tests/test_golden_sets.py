"""Rewriting golden sets, verification scopes, corpus manifests and collections."""

import pytest
from pyspark.sql import functions as F

from claimweave import backends
from claimweave.operators import golden
from claimweave.plans import corpus

P = "ticker string, fiscal_year int, fiscal_quarter string"


def source(spark, n=7, text="Sales of ${} million in the year"):
    return spark.createDataFrame([("T", 2025, "Q1", i, text.format(i + 20), f"s{i}") for i in range(n)], P + ", pos int, claim string, speaker string")


def current(spark, rows):
    return spark.createDataFrame([("T", 2025, "Q1", *r) for r in rows], P + ", slot int, claim_id string, claim string, speaker string, is_golden_claim boolean")


def test_only_open_slots_change_and_no_text_repeats(spark):
    rows = [(i, None if i == 3 else f"id{i}", f"old {i}", "x", i == 1) for i in range(8)]
    rows[1] = (1, "id1", "SALES of $20  million in the year", "x", True)  # slot 0's own source claim, golden already
    got = {r.slot: r for r in golden.modify_set(current(spark, rows), source(spark)).collect()}
    assert len(got) == 8 and got[1].claim == rows[1][2] and got[1].is_golden_claim
    assert [got[i].claim for i in (0, 2, 3)] == [f"Sales of ${n} million in the year" for n in (21, 22, 23)]
    assert got[3].claim_id == "T_2025_Q1_04" and got[0].claim_id == "id0"
    assert [got[i].intended_label for i in range(8)] == ["Consistent"] * 4 + ["Contradictory"] * 2 + ["Unverifiable"] * 2
    for i, n in ((4, 24), (5, 25)):
        assert got[i].claim.startswith("Sales of $") and str(n) not in got[i].claim
    assert got[6].claim == "Management privately expects that sales of $26 million in the year" and got[7].claim.startswith("Again,")
    assert len({r.claim.lower() for r in got.values()}) == 8


def test_sets_that_cannot_be_filled(spark):
    rows = [(i, f"id{i}", f"old {i}", "x", False) for i in range(8)]
    with pytest.raises(ValueError, match="fewer than 6"):
        golden.modify_set(current(spark, rows), source(spark, 5))
    with pytest.raises(Exception, match="every rewrite repeats"):
        golden.modify_set(current(spark, rows), source(spark, text="Same words each time")).collect()
    kept = [(*r[:4], True) for r in rows]
    assert sorted(r.claim for r in golden.modify_set(current(spark, kept), source(spark)).collect()) == sorted(r[2] for r in rows)


def test_verification_scopes(spark):
    rows = spark.createDataFrame([("T", 2025, "Q1", f"c{i:02d}", i % 4 == 0, "Consistent") for i in range(12)], P + ", claim_id string, is_golden_claim boolean, intended_label string")
    done = spark.createDataFrame([("c00",), ("c03",)], "claim_id string")
    assert sorted(r.claim_id for r in golden.to_verify(rows, done).collect()) == [f"c{i:02d}" for i in (1, 2, 4, 5, 6, 7)]
    assert golden.to_verify(rows, done, modify=True).count() == 9
    assert [tuple(r)[3:] for r in golden.period_counts(rows).collect()] == [(12, 3, 1)]


def chunks(spark, n=5):
    return spark.createDataFrame([(f"T_2025_Q1_10-Q_chunk_{i}", "T", "10-Q", 2025, "Q1", False, f"words {i} of a text") for i in range(n)], "chunk_id string, ticker string, doc_type string, fiscal_year int, fiscal_period string, is_table boolean, text string")


def test_manifest_and_readiness(spark, tmp_path):
    assert not corpus.is_ready(spark, str(tmp_path), "filings")
    with pytest.raises(FileNotFoundError):
        corpus.load(spark, str(tmp_path), "filings")
    built = corpus.build_all(chunks(spark), str(tmp_path), ("filings",))["filings"]
    fact = built["manifest"].first()
    assert (fact.n_chunks, fact.n_vectors, fact.dim, fact.doc_types) == (5, 5, 64, "10-K,10-Q") and fact.mean_length == 5.0
    assert corpus.is_ready(spark, str(tmp_path), "filings")
    assert corpus.build(chunks(spark, 3), str(tmp_path), "filings", force=False)["chunks"].count() == 5
    for faulty in (built["vectors"].limit(1).unionByName(built["vectors"].limit(1)), built["vectors"].withColumn("embedding", F.slice("embedding", 1, 3))):
        with pytest.raises(ValueError, match="do not match"):
            corpus.check_order(faulty, 2, 64)
    assert corpus.build(chunks(spark), str(tmp_path), "filings", max_chunks=2)["vectors"].count() == 2
    with pytest.raises(ValueError):
        corpus.path_of("x", "none", "chunks")


def test_collection(spark, tmp_path):
    points = corpus.Collection(spark, str(tmp_path), "filings", 2)
    assert not points.is_ready()
    rows = lambda xs: spark.createDataFrame(xs, "global_id long, ticker string, embedding array<float>")
    assert points.upsert(rows([(0, "A", [1.0, 0.0]), (1, "B", [0.0, 1.0])])) == 2 and points.is_ready()
    assert points.upsert(rows([(1, "B", [0.6, 0.8]), (2, "A", [0.0, -1.0])])) == 3
    asked = spark.createDataFrame([("q", "A", [0.0, 1.0])], "claim_id string, ticker string, embedding array<float>")
    assert [(r.global_id, r.score) for r in points.search(asked, 2).orderBy("rank").collect()] == [(1, 0.8), (0, 0.0)]
    assert [r.global_id for r in points.search(asked, 5, on=["ticker"]).orderBy("rank").collect()] == [0, 2]
    for wrong in ([(3, "A", [1.0])], [(None, "A", [1.0, 0.0])], [(3, "A", None)], [(3, "A", [1.0, 0.0])] * 2):
        with pytest.raises(ValueError):
            points.upsert(rows(wrong))


def test_number_of_claims_a_call():
    assert backends.SentenceExtractor(15).most == 15
    for n in (0, 16):
        with pytest.raises(ValueError):
            backends.SentenceExtractor(n)


def test_only_periods_whose_first_choices_clash_make_every_rewrite(spark, monkeypatch):
    wide = [(t, 2025, "Q1", i, f"Sales of ${20 + i * (t == 'A')} million in year {i % 7 if t == 'B' else i}", "s") for t in "AB" for i in range(8)]
    told = spark.createDataFrame(wide, P + ", pos int, claim string, speaker string")
    rows = spark.createDataFrame([(t, 2025, "Q1", i, f"{t}{i}", "old", "x", i == 1) for t in "AB" for i in range(8)], P + ", slot int, claim_id string, claim string, speaker string, is_golden_claim boolean")
    rows = rows.withColumn("claim", F.when(F.expr("ticker = 'B' and slot = 1"), "Sales of $20 million in year 0").otherwise(F.col("claim")))
    seen, whole = [], golden._choices
    monkeypatch.setattr(golden, "_choices", lambda open_slots, *rest: seen.extend(r.ticker for r in open_slots.select("ticker").distinct().collect()) or whole(open_slots, *rest))
    quick = sorted((tuple(r) for r in golden.modify_set(rows, told).collect()), key=str)
    assert seen == ["B"]
    kept = rows.where("is_golden_claim").withColumn("intended_label", golden.slot_label(F.col("slot")))
    slow = golden._in_turn(rows, F.col("is_golden_claim"), told, lambda c, again: F.concat(F.when(again > 0, F.concat_ws(" ", F.lit("Again,"), again.cast("string"), F.lit(""))).otherwise(""), golden.unverifiable(c)))
    assert sorted((r.ticker, r.slot, r.claim) for r in slow.collect()) == sorted((r[0], r[3], r[5]) for r in quick if not r[-1]) and kept.count() == 2
