"""Stages on empty tables and on tables with extra columns of clashing names."""

import util
from pyspark.sql import functions as F

import corpus_pipeline


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], util.DOC_SCHEMA)
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, str(tmp_path))
        assert out.columns == none.columns and out.collect() == [], name
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_extra_columns_stay(spark, tmp_path):
    rows = [r for r in util.corpus(seed=2, n=12) if r[0] is not None][:14]
    passage = rows[0][1].split()[:9] if len(rows[0][1].split()) > 8 else util.prose(__import__("random").Random(1), 9).split()
    spark.createDataFrame([(1, " ".join(passage)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows.append((500, "word " * 20 + " ".join(passage) + " word" * 20, "en", "a", 1))
    docs = util.clashing(util.frame(spark, rows)).withColumns({"text_key": F.lit("x"), "hits": F.lit("x"), "win": F.lit("x"), "fingerprint": F.lit("x"), "least": F.lit("x"), "__apart": F.lit("x")})
    ids = {r[0] for r in rows}
    docs = docs.withColumns({"__text_key": F.lit("x"), "__fingerprint": F.lit("x")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = {r.doc_id for r in out.collect()}
        assert got <= ids and (name != "benchmark decontamination" or 500 not in got)
        assert out.where("__apart <> 'x' or __text_key <> 'x' or __fingerprint <> 'x' or hits <> 'x'").count() == 0
