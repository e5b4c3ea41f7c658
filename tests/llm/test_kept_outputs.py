"""The dedup and sharding operators return texts, spans and rows, not only digests of them."""

from collections import Counter

from pyspark.sql import functions as F
from util import clashing, corpus, frame, prose

from claimweave.llm import sharding, substring


def test_kept_text_and_removed_spans(spark):
    import random

    rng = random.Random(6)
    words = [prose(rng, 400).split() for _ in range(3)]
    late = words[1][:30] + words[0][100:170] + words[1][30:60] + words[0][200:260] + words[1][60:]
    rows = [(1, "  ".join(words[0]), "en", "a", 1), (2, " ".join(late), "en", "a", 1), (3, " ".join(words[0]), "en", "a", 1), (3, "few words", "en", "a", 1), (4, None, "en", "a", 1), (None, " ".join(late[:150]), "en", "a", 1)]
    found = {(r.doc_id, r.n_words): r for r in substring.cut_repeats(clashing(frame(spark, rows))).collect()}
    assert len(found) == len(rows)
    assert found[1, 400].kept_text == " ".join(words[0]) and found[1, 400].removed == []
    assert found[2, len(late)].kept_text == " ".join(words[1])
    assert [tuple(x) for x in found[2, len(late)].removed] == [(30, 100), (130, 190)]
    assert found[3, 400].kept_text == "" and [tuple(x) for x in found[3, 400].removed] == [(0, 400)]
    assert found[3, 2].kept_text == "few words"
    assert found[4, 0].kept_text == ""
    assert found[None, 150].kept_text == ""


def test_every_column_of_every_row_gets_its_place(spark):
    rows = corpus(n=100)
    docs = frame(spark, rows).withColumn("slot", F.lit("x"))
    for size in (20_000, 13):
        got = sharding.place_rows(docs, rows_per_bucket=size)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot", "place"]
        got = got.collect()
        assert Counter(tuple(r)[:5] for r in got) == Counter(rows)
        assert sorted(r.place for r in got) == list(range(len(rows)))


def test_shard_files(spark, tmp_path):
    rows = corpus(n=100)
    sharding.write_shards(frame(spark, rows), f"{tmp_path}/shards", rows_per_bucket=40)
    got = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in got) == Counter(rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
