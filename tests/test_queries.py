"""Every registered engine query against its SQL on the smallest tables, and the contract of the entry module."""

import math
import os
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from claimweave import more_queries as queries
from claimweave import storage

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        return "None" if math.isnan(v) else f"{float(v):.9g}"
    return str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, duck, name):
    df = queries.REGISTRY[name](spark, SF)
    want = duck.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.REGISTRY) - set(queries.SQL)))
def test_other_queries_give_rows(spark, name):
    assert queries.REGISTRY[name](spark, SF).count() > 0


def test_entry_module(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["item_id", "doc_id", "score", "rank"]


def test_nothing_else_imports_the_corpus_operators():
    for path in [*(ROOT / "claimweave").rglob("*.py")]:
        if "llm" not in path.parts:
            assert not re.search(r"(from|import)\s+\S*\bllm\b", path.read_text()), path


def test_entry_module_works_without_the_corpus_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = None\ntry:\n import __spark_entry__ as e; q = e.queries()\nexcept ImportError: raise SystemExit('import failed')\nassert 'bm25_topk' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr + out.stdout


def test_overlap_modes_read_each_claim_once_in_tasks_of_bounded_size(spark, monkeypatch):
    plan = queries.REGISTRY["overlap_modes"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2  # figures and percents
    monkeypatch.setattr(storage, "PIECE", 1000, raising=False)
    assert storage.spread(spark.read.parquet(f"{SF}/orders.parquet")).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
