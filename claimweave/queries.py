"""Registered queries: each operator over whole tables, and the DuckDB SQL that must give the same rows.

The driver's tables stand in for the engine's: ``documents`` for chunks, ``benchmark`` for claims,
``embeddings`` for vectors, ``conversations`` for calls, ``pages`` for filings, ``labels`` for judged claims,
``orders`` for dated facts.  Where the tables hold no figures, texts are derived from numeric columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import backends
from .functions import figures, fiscal, ids, numbers, rewrite, similarity, text
from .operators import golden, metrics, relational, retrieval, sampling
from .plans import claim_check
from .sources import filings, jsonl, manifest, transcripts
from .storage import spread
from .streaming.ingest import windowed_counts

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The token list of a text column ``t``, as SQL.
_TOKENS = "list_filter(list_transform(regexp_extract_all(lower(replace(coalesce({t}, ''), ',', '')), '[a-z0-9$%]+(?:\\.[0-9]+)?'), lambda x: trim(x, '$%')), lambda x: x <> '')"


def query(sql: str | None = None):
    def add(f):
        REGISTRY[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- text features


@query(f"SELECT doc_id, len(w) AS n_terms, len(list_distinct(w)) AS n_distinct, md5(array_to_string(w, ' ')) AS terms_md5 FROM (SELECT doc_id, {_TOKENS.format(t='text')} AS w FROM documents)")
def tokenize_terms(spark, d):
    w = F.col("w")
    return spread(_read(spark, d, "documents").select("doc_id", "text")).select("doc_id", text.tokens(F.col("text")).alias("w")).select(
        "doc_id", F.size(w).cast("long").alias("n_terms"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), F.md5(F.array_join(w, " ").cast("binary")).alias("terms_md5")
    )


@query(f"SELECT term, count(*) AS n_docs, sum(tf)::BIGINT AS n_total FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS.format(t='text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def posting_stats(spark, d):
    return retrieval.postings(spread(_read(spark, d, "documents").select("doc_id", "text")), "doc_id").groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n_total"))


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


@query(f"""SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '(?i)[a-z][a-z0-9''-]{{2,}}'), lambda x: lower(x)), lambda x: x NOT IN ({_STOP})))), ' ') AS keywords FROM benchmark""")
def claim_keywords(spark, d):
    return _read(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(text.keywords(F.col("text"))), " ").alias("keywords"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13)) AS tidy FROM conversations""")
def normalized_text(spark, d):
    return _read(spark, d, "conversations").select("conv_id", "turn", text.normalize_ws(F.col("text")).alias("tidy"))


def _facts(spark, d):
    """Claim-like sentences from orders, each with the numbers it was made of."""
    amount, share, count = F.round(F.col("o_totalprice") / 10000, 1), F.pmod("o_custkey", F.lit(97)) + 1, F.pmod("o_orderkey", F.lit(89)) + 1
    return spread(_read(spark, d, "orders")).select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority", amount.alias("amount"), share.cast("int").alias("share"), count.cast("int").alias("cnt"),
        F.format_string("%.1f", amount).alias("shown"),
    )


_FACTS = """facts AS (
  SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus, o_orderpriority, round(o_totalprice / 10000, 1) AS amount, (o_custkey % 97 + 1)::INT AS share,
         (o_orderkey % 89 + 1)::INT AS cnt, printf('%.1f', round(o_totalprice / 10000, 1)) AS shown FROM orders
)"""


@query(f"""WITH {_FACTS} SELECT o_orderkey, 'Revenue (net sales) of $' || shown || ' billion (' || CASE WHEN amount * 1000 = floor(amount * 1000) THEN printf('%.0f', amount * 1000) ELSE printf('%g', amount * 1000) END
 || ' million), up ' || share || '% on $2B (2000 million) and 7 billion dollars (7000 million)' AS expanded FROM facts""")
def unit_expansion(spark, d):
    claim = F.concat(F.lit("Revenue of $"), "shown", F.lit(" billion, up "), F.col("share").cast("string"), F.lit("% on $2B and 7 billion dollars (7000 million)"))
    return _facts(spark, d).select("o_orderkey", rewrite.expand_units(claim).alias("expanded"))


_WORDING = "['Sales in the fourth quarter rose', 'For the full year sales rose', 'Sales rose again', 'Annual sales in Q4 rose', 'In the June quarter sales rose', 'Trailing twelve months sales']"
_WORDED = "CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(_WORDING[1:-1].split(", "))) + " END"


def _worded(spark, d):
    words = F.element_at(F.array(*[F.lit(w.strip("'")) for w in _WORDING[1:-1].split(", ")]), (F.pmod("o_orderkey", F.lit(6)) + 1).cast("int"))
    return _read(spark, d, "orders").select("o_orderkey", words.alias("claim"), F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("q"))


@query(f"""SELECT o_orderkey, CASE WHEN quarter(o_orderdate) <> 4 THEN 'STANDARD_QUARTER' WHEN o_orderkey % 6 IN (0, 3, 4) THEN 'Q4_COMPOSITE' WHEN o_orderkey % 6 IN (1, 5) THEN 'FULL_YEAR_ONLY' ELSE 'Q4_COMPOSITE' END AS scope,
 CASE WHEN quarter(o_orderdate) <> 4 THEN '10-Q' WHEN o_orderkey % 6 IN (1, 5) THEN '10-K' ELSE '10-K,10-Q' END AS doc_types FROM orders""")
def temporal_scope(spark, d):
    scope = rewrite.temporal_scope(F.col("claim"), F.col("q"))
    return _worded(spark, d).select("o_orderkey", scope.alias("scope"), F.array_join(rewrite.required_doc_types(scope), ",").alias("doc_types"))


@query(f"""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Sales in the 12 month (year ended) period rose' WHEN 3 THEN 'Annual sales in 12 month (year ended) period rose' WHEN 4 THEN 'In the 12 month (year ended) period sales rose'
 ELSE 'for 12 month (year ended) period ' || {_WORDED} END AS annual, CASE o_orderkey % 6 WHEN 0 THEN 'Sales in the nine months ended period rose' WHEN 3 THEN 'Annual sales in nine months ended period rose' WHEN 4 THEN 'In the nine months ended period sales rose'
 ELSE 'for nine months ended period ' || {_WORDED} END AS nine_month FROM orders""")
def period_rewrite(spark, d):
    return _worded(spark, d).select("o_orderkey", rewrite.annual_query(F.col("claim")).alias("annual"), rewrite.nine_month_query(F.col("claim")).alias("nine_month"))


# ---------------------------------------------------------------- figures

_FIGURE_CLAIM = "Sales of ${shown} million rose {share}% in 2024 across {cnt} stores, against $3.5 billion"
_TOKENS_SQL = "list_sort(list_distinct(['usd_m:' || printf('%g', amount), 'pct:' || share, 'num:' || cnt, 'usd_m:3.5e+06']))"


def _figured(spark, d):
    claim = F.concat(F.lit("Sales of $"), "shown", F.lit(" million rose "), F.col("share").cast("string"), F.lit("% in 2024 across "), F.col("cnt").cast("string"), F.lit(" stores, against $3.5 billion"))
    return _facts(spark, d).withColumn("claim", claim)


@query(f"WITH {_FACTS} SELECT o_orderkey, array_to_string({_TOKENS_SQL}, ',') AS tokens FROM facts")
def reference_figures(spark, d):
    return _figured(spark, d).select("o_orderkey", F.array_join(figures.reference_figures(F.col("claim")), ",").alias("tokens"))


@query(f"""WITH {_FACTS}, t AS (
  SELECT o_orderkey, ['usd_m:' || printf('%g', amount), 'pct:' || share, 'num:' || cnt, 'usd_m:3.5e+06'] AS need, ['usd_m:' || printf('%g', amount), 'pct:' || (share + cnt % 2), 'num:' || (cnt + 1)] AS have FROM facts
), m AS (
  SELECT o_orderkey, need, list_filter(need, lambda x: NOT starts_with(x, 'num:')) AS money, have FROM t
)
SELECT o_orderkey, len(list_filter(need, lambda x: NOT list_contains(have, x))) = 0 AS strict_hit, len(list_filter(money, lambda x: NOT list_contains(have, x))) = 0 AS ignore_num_hit,
 len(list_filter(money, lambda x: list_contains(have, x))) > 0 AS any_money_hit, len(list_filter(money, lambda x: list_contains(have, x))) / len(money) >= 0.5 AS half_money_hit,
 array_to_string(list_filter(list_sort(money), lambda x: NOT list_contains(have, x)), ',') AS missing FROM m""")
def overlap_modes(spark, d):
    have = F.array(
        F.concat(F.lit("usd_m:"), figures.general(F.col("amount"))), F.concat(F.lit("pct:"), (F.col("share") + F.col("cnt") % 2).cast("string")), F.concat(F.lit("num:"), (F.col("cnt") + 1).cast("string"))
    )
    rows = numbers.bound(numbers.bound(_figured(spark, d), "need", figures.reference_figures(F.col("claim"))), "have", have)
    need, have = F.col("need"), F.col("have")
    hits = {f"{m}_hit": figures.score_overlap(need, have, m)["hit"] for m in figures.OVERLAP_MODES}
    return rows.select("o_orderkey", *[h.alias(n) for n, h in hits.items()], F.array_join(figures.score_overlap(need, have, "half_money")["missing"], ",").alias("missing"))


@query(f"""WITH {_FACTS}, p AS (SELECT o_orderkey, amount, share, lower('In 2024 sales came to ' || shown || ' and rose ' || cnt || '% at stores') AS passage FROM facts), t AS (
  SELECT o_orderkey, passage, unnest([{{'k': 'usd', 'v': [printf('%g', amount), printf('%.0f', amount), printf('%.2f', amount)]}}, {{'k': 'pct', 'v': [share::VARCHAR]}},
   {{'k': 'big', 'v': ['3.5e+06', '3,500,000', '3,500,000.00', '3500', '3,500.0', '3.5']}}, {{'k': 'sales', 'v': ['sales']}}, {{'k': 'rose', 'v': ['rose']}}, {{'k': 'across', 'v': ['across']}}, {{'k': 'stores', 'v': ['stores']}}, {{'k': 'against', 'v': ['against']}}]) AS x FROM p
)
SELECT o_orderkey, round(avg(hit), 6) AS rate, avg(hit) > 0.5 AS hit FROM (SELECT o_orderkey, CASE WHEN len(list_filter(x.v, lambda y: contains(passage, y))) > 0 THEN 1.0 ELSE 0.0 END AS hit FROM t) GROUP BY o_orderkey""")
def truth_match(spark, d):
    passage = F.concat(F.lit("In 2024 sales came to "), "shown", F.lit(" and rose "), F.col("cnt").cast("string"), F.lit("% at stores"))
    rows = _figured(spark, d).select("o_orderkey", figures.match_truth(figures.truth_tokens(F.col("claim")), passage).alias("m"))
    return rows.select("o_orderkey", F.round("m.rate", 6).alias("rate"), "m.hit")


@query("""SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter([(o_orderkey % 7)::INT, (o_custkey % 9)::INT, (o_orderkey % 4)::INT], lambda i: i BETWEEN 1 AND 5))), ',') AS passages FROM orders""")
def passage_indices(spark, d):
    said = F.concat(F.lit("Passage "), F.pmod("o_orderkey", F.lit(7)).cast("string"), F.lit(" agrees; see passage  "), F.pmod("o_custkey", F.lit(9)).cast("string"))
    found = figures.passage_indices(said, F.pmod("o_orderkey", F.lit(4)), F.lit(5))
    return _read(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(found, lambda i: i.cast("string")), ",").alias("passages"))


# ---------------------------------------------------------------- retrieval


def _bm25_sql(docs: str, queries: str, keep: str = "", match: str = "") -> str:
    """CTEs ``scored(q, c, score)``; ``docs(c, t, keep)`` and ``queries(q, t, keep)`` are CTEs before them."""
    k = f", {keep}" if keep else ""
    dk = "".join(f", d.{x.strip()}" for x in keep.split(",")) if keep else ""
    return f"""
dt AS (SELECT c{k}, {_TOKENS.format(t='t')} AS w FROM {docs}),
tf AS (SELECT c{k}, term, len_w, count(*) AS tf FROM (SELECT c{k}, len(w) AS len_w, unnest(w) AS term FROM dt) GROUP BY ALL),
size AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM dt),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, size),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT round(avg(raw), 9) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT q{k}, term, count(*) AS times FROM (SELECT q{k}, unnest({_TOKENS.format(t='t')}) AS term FROM {queries}) GROUP BY ALL),
scored AS (
  SELECT q, d.c AS c, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len_w / avgdl))), 6) AS score
  FROM qt JOIN tf d ON qt.term = d.term{match} JOIN idf ON idf.term = d.term, size GROUP BY q, d.c
)"""


_PLAIN = "docs AS (SELECT doc_id AS c, text AS t FROM documents), qs AS (SELECT item_id AS q, text AS t FROM benchmark),"


@query(f"""WITH {_PLAIN} {_bm25_sql('docs', 'qs')}
SELECT q AS item_id, c AS doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM scored) WHERE rank <= 20""")
def bm25_topk(spark, d):
    docs, claims = _read(spark, d, "documents"), _read(spark, d, "benchmark").withColumnRenamed("text", "query")
    best = retrieval.top_k(retrieval.bm25_best(retrieval.tokenised(docs, "doc_id"), claims, 20, "doc_id", "item_id")[0], 20, "item_id", "doc_id")
    return best.select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


_LANG_OF = "CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END"


@query(f"""WITH docs AS (SELECT doc_id AS c, text AS t, lang FROM documents), qs AS (SELECT item_id AS q, text AS t, {_LANG_OF} AS lang FROM benchmark), {_bm25_sql('docs', 'qs', 'lang', ' AND qt.lang = d.lang')}
SELECT q AS item_id, c AS doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM scored) WHERE rank <= 10""")
def filtered_retrieve(spark, d):
    docs = _read(spark, d, "documents")
    claims = _read(spark, d, "benchmark").select("item_id", F.col("text").alias("query"), F.expr(_LANG_OF).alias("lang"))
    best = retrieval.top_k(retrieval.bm25_best(retrieval.tokenised(docs, "doc_id", keep=["lang"]), claims, 10, "doc_id", "item_id", on=["lang"])[0], 10, "item_id", "doc_id")
    return best.select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("""WITH s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0
)
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def dense_topk(spark, d):
    vectors = _read(spark, d, "embeddings")
    asked = vectors.where(F.pmod("vec_id", F.lit(100)) == 0).withColumnRenamed("vec_id", "query_id")
    best = retrieval.top_k(retrieval.dense_best(vectors, asked, 10, "vec_id", "query_id"), 10, "query_id", "vec_id")
    return best.select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@query("""WITH s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 100 = 0
)
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def dense_filtered(spark, d):
    vectors = _read(spark, d, "embeddings")
    asked = vectors.where(F.pmod("vec_id", F.lit(100)) == 0).withColumnRenamed("vec_id", "query_id")
    best = retrieval.top_k(retrieval.dense_best(vectors, asked, 5, "vec_id", "query_id", on=["label"]), 5, "query_id", "vec_id")
    return best.select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_PLAIN} {_bm25_sql('docs', 'qs')},
common AS (SELECT q, d.c AS c, count(*)::DOUBLE AS score FROM qt JOIN tf d ON qt.term = d.term GROUP BY q, d.c),
r0 AS (SELECT q, c, 0 AS channel, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM common) WHERE rank <= 20),
r1 AS (SELECT q, c, 1 AS channel, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM scored) WHERE rank <= 20),
f AS (SELECT q, c, round(sum(1.0 / (60 + rank)), 9) AS score, min(channel * 1000 + rank) AS seen FROM (FROM r0 UNION ALL FROM r1) GROUP BY q, c)
SELECT q AS item_id, c AS doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, seen, c) AS rank FROM f) WHERE rank <= 10""")
def rrf_hybrid(spark, d):
    docs, claims = _read(spark, d, "documents"), _read(spark, d, "benchmark").withColumnRenamed("text", "query")
    common, ranked = retrieval.bm25_best(retrieval.tokenised(docs, "doc_id"), claims, retrieval.MIN_CHANNEL, "doc_id", "item_id", channels=("common", "bm25"))
    best = retrieval.hybrid(common, ranked, 10, "item_id", "doc_id")
    return best.select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def _chunk_table(spark, d):
    n = F.col("doc_id")
    return _read(spark, d, "documents").select(
        F.format_string("c%010d", n).alias("chunk_id"), F.upper("lang").alias("ticker"), F.lit(2024).alias("fiscal_year"),
        F.when(F.pmod(n, F.lit(3)) == 0, "10-K").otherwise("10-Q").alias("doc_type"),
        F.when(F.pmod(n, F.lit(3)) == 0, "FY").when(F.pmod(n, F.lit(3)) == 1, "Q3").otherwise("Q1").alias("fiscal_period"),
        F.col("source").alias("section"), (F.pmod(n, F.lit(5)) == 0).alias("is_table"), "text",
    )


def _claim_table(spark, d):
    n = F.col("item_id")
    return _read(spark, d, "benchmark").select(
        F.format_string("q%05d", n).alias("claim_id"), F.upper(F.expr(_LANG_OF)).alias("ticker"), F.lit(2024).alias("fiscal_year"),
        F.when(F.pmod(n, F.lit(3)) == 0, "Q4").when(F.pmod(n, F.lit(3)) == 1, "Q3").otherwise("Q1").alias("fiscal_quarter"), F.lit("speaker").alias("speaker"), F.col("text").alias("claim"),
    )


_OVERLAP = "round(len(list_intersect(list_distinct({a}), list_distinct({b}))) / len(list_distinct({a})), 6)"


@query(f"""WITH claims AS (
  SELECT printf('q%05d', item_id) AS claim_id, upper({_LANG_OF}) AS ticker, item_id % 3 AS m, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM benchmark
), paths AS (
  SELECT claim_id, ticker, 'A' AS path, 4 AS k, '10-K' AS doc_type, 'FY' AS period, 'for 12 month (year ended) period ' || flat AS t, 'for 12 month (year ended) period ' || flat AS judged FROM claims WHERE m = 0
  UNION ALL SELECT claim_id, ticker, 'B', 4, '10-Q', 'Q3', 'for nine months ended period ' || flat, 'for nine months ended period ' || flat FROM claims WHERE m = 0
  UNION ALL SELECT claim_id, ticker, '-', 5, '10-Q', CASE m WHEN 1 THEN 'Q3' ELSE 'Q1' END, text, text FROM claims WHERE m > 0
), docs AS (
  SELECT printf('c%010d', doc_id) AS c, text AS t, upper(lang) AS ticker, CASE doc_id % 3 WHEN 0 THEN '10-K' ELSE '10-Q' END AS doc_type, CASE doc_id % 3 WHEN 0 THEN 'FY' WHEN 1 THEN 'Q3' ELSE 'Q1' END AS period FROM documents
), qs AS (SELECT claim_id || '|' || path AS q, t, ticker, doc_type, period FROM paths), {_bm25_sql('docs', 'qs', 'ticker, doc_type, period', ' AND qt.ticker = d.ticker AND qt.doc_type = d.doc_type AND qt.period = d.period')},
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM scored) WHERE rank <= 50),
judged AS (
  SELECT p.*, paths.claim_id, paths.path, paths.k, {_OVERLAP.format(a=_TOKENS.format(t='paths.judged'), b=_TOKENS.format(t='docs.t'))} AS s
  FROM pool p JOIN paths ON p.q = paths.claim_id || '|' || paths.path JOIN docs ON docs.c = p.c
), best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, rank, c) AS r FROM judged)
SELECT claim_id, path, row_number() OVER (PARTITION BY claim_id ORDER BY path, r) AS rank, c AS chunk_id, score, s AS rerank_score FROM best WHERE r <= k""")
def dual_path_retrieve(spark, d):
    found = retrieval.claim_passages(_claim_table(spark, d), _chunk_table(spark, d))
    return found.select("claim_id", "path", F.col("rank").cast("long").alias("rank"), "chunk_id", "score", "rerank_score")


@query(f"""SELECT item_id, doc_id, {_OVERLAP.format(a=_TOKENS.format(t='b.text'), b=_TOKENS.format(t='d.text'))} AS overlap FROM benchmark b JOIN documents d ON d.doc_id % (SELECT max(item_id) + 1 FROM benchmark) = b.item_id""")
def rerank_overlap(spark, d):
    claims = _read(spark, d, "benchmark").withColumnRenamed("text", "claim")
    n = claims.agg(F.max("item_id") + 1).first()[0]
    pairs = spread(_read(spark, d, "documents")).withColumn("item_id", F.pmod("doc_id", F.lit(n))).join(claims, "item_id")
    return pairs.select("item_id", "doc_id", retrieval.lexical_overlap(F.col("claim"), F.col("text")).alias("overlap"))


@query("""SELECT l.doc_id, q, p, (p = q OR (p = 'FY' AND q = 'Q4')) AS matches FROM (SELECT doc_id, 'Q' || (quality * 3 + 1) AS q, CASE WHEN doc_id % 2 = 0 THEN 'FY' ELSE 'Q1' END AS p FROM labels) l""")
def period_match(spark, d):
    rows = _read(spark, d, "labels").select("doc_id", F.concat(F.lit("Q"), (F.col("quality") * 3 + 1).cast("string")).alias("q"), F.when(F.pmod("doc_id", F.lit(2)) == 0, "FY").otherwise("Q1").alias("p"))
    return rows.select("doc_id", "q", "p", retrieval.period_matches(F.col("p"), F.col("q")).alias("matches"))


@query("""SELECT printf('c%010d', doc_id) AS chunk_id, '[COMPANY: ' || upper(lang) || ' | NAME: ' || upper(lang) || ' | PERIOD: ' || CASE doc_id % 3 WHEN 0 THEN 'FY' WHEN 1 THEN 'Q3' ELSE 'Q1' END || ' 2024 | TYPE: '
 || CASE doc_id % 3 WHEN 0 THEN '10-K' ELSE '10-Q' END || ' | SECTION: ' || source || ' | TABLE: ' || CASE WHEN doc_id % 5 = 0 THEN 'True' ELSE 'False' END || ']' AS head FROM documents""")
def embedding_header(spark, d):
    empty = {c: F.lit(None).cast("string") for c in ("company_name", "filing_date", "report_date", "quarter_period_label", "speaker_name", "speaker_role", "call_date")}
    rows = _chunk_table(spark, d).withColumns(empty | {"quarter_months": F.lit(None).cast("array<string>")})
    return rows.select("chunk_id", F.substring_index(text.embedding_text(), "\n", 1).alias("head"))


# ---------------------------------------------------------------- metrics

_JUDGED = """judged AS (
  SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Unverifiable' WHEN quality = 1 THEN 'Consistent' ELSE 'Contradictory' END AS expected,
  CASE WHEN doc_id % 7 = 0 THEN 'Unverifiable' WHEN toxic = 0 THEN 'Consistent' ELSE 'Contradictory' END AS predicted, doc_id % 3 > 0 AS hit FROM labels
), bucketed AS (
  SELECT *, CASE WHEN expected = 'Unverifiable' THEN 'unverifiable_nli' WHEN hit AND expected = predicted THEN 'both_ok' WHEN hit THEN 'nli_hallucination' WHEN expected = predicted THEN 'lucky_nli' ELSE 'both_fail' END AS bucket FROM judged
)"""


def _judged(spark, d):
    n = F.col("doc_id")
    rows = _read(spark, d, "labels").select(
        "doc_id", F.when(n % 5 == 0, "Unverifiable").when(F.col("quality") == 1, "Consistent").otherwise("Contradictory").alias("expected"),
        F.when(n % 7 == 0, "Unverifiable").when(F.col("toxic") == 0, "Consistent").otherwise("Contradictory").alias("predicted"), (n % 3 > 0).alias("retrieval_hit"),
    )
    return rows.withColumn("bucket", metrics.bucket(F.col("expected"), F.col("predicted"), F.col("retrieval_hit")))


_LABELS3 = "(VALUES ('Consistent'), ('Contradictory'), ('Unverifiable')) l(expected)"


@query(f"WITH {_JUDGED} SELECT l.expected, count(*) FILTER (predicted = 'Consistent') AS Consistent, count(*) FILTER (predicted = 'Contradictory') AS Contradictory, count(*) FILTER (predicted = 'Unverifiable') AS Unverifiable FROM {_LABELS3} LEFT JOIN judged USING (expected) GROUP BY ALL")
def confusion(spark, d):
    return metrics.confusion(_judged(spark, d))


@query(f"""WITH {_JUDGED} SELECT l.expected, round(count(*) FILTER (predicted = 'Consistent') / count(predicted), 4) AS Consistent, round(count(*) FILTER (predicted = 'Contradictory') / count(predicted), 4) AS Contradictory,
 round(count(*) FILTER (predicted = 'Unverifiable') / count(predicted), 4) AS Unverifiable FROM {_LABELS3} LEFT JOIN judged USING (expected) GROUP BY ALL""")
def confusion_pct(spark, d):
    return metrics.confusion_pct(_judged(spark, d))


@query(f"WITH {_JUDGED} SELECT l.bucket, count(b.bucket) AS n FROM (VALUES ('both_ok'), ('nli_hallucination'), ('lucky_nli'), ('both_fail'), ('unverifiable_nli')) l(bucket) LEFT JOIN bucketed b USING (bucket) GROUP BY ALL")
def buckets(spark, d):
    return metrics.bucket_counts(_judged(spark, d))


@query(f"""WITH {_JUDGED} SELECT count(*) AS n_claims, count(*) FILTER (expected <> 'Unverifiable') AS n_verifiable, count(*) FILTER (expected = 'Unverifiable') AS n_unverifiable, round(avg((expected = predicted)::INT), 6) AS accuracy_all,
 round(avg((expected = predicted)::INT) FILTER (expected <> 'Unverifiable'), 6) AS accuracy_verifiable, round(avg((expected = predicted)::INT) FILTER (expected = 'Unverifiable'), 6) AS accuracy_unverifiable,
 round(avg(hit::INT) FILTER (expected <> 'Unverifiable'), 6) AS recall FROM judged""")
def headline_metrics(spark, d):
    return metrics.summary(_judged(spark, d))


def _findings(spark, d):
    label = F.when(F.col("o_orderstatus") == "F", "Consistent").when(F.col("o_orderstatus") == "O", "Contradictory").otherwise("Unverifiable")
    return _read(spark, d, "orders").select(
        F.col("o_orderpriority").alias("ticker"), F.year("o_orderdate").alias("fiscal_year"), F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("fiscal_quarter"), label.alias("nli_label")
    )


@query("""WITH f AS (
  SELECT o_orderpriority AS ticker, year(o_orderdate) AS y, 'Q' || quarter(o_orderdate) AS q, CASE o_orderstatus WHEN 'F' THEN 'Consistent' WHEN 'O' THEN 'Contradictory' ELSE 'Unverifiable' END AS label FROM orders
)
SELECT CASE grouping(ticker, y, q) WHEN 0 THEN 'period' WHEN 3 THEN 'company' ELSE 'total' END AS kind, CASE WHEN grouping(ticker, y, q) = 7 THEN 'TOTAL' ELSE ticker END AS ticker,
 array_to_string(list_sort(list(DISTINCT y::VARCHAR)), ';') AS years, array_to_string(list_sort(list(DISTINCT q)), ';') AS quarters, count(*) AS claims,
 count(*) FILTER (label = 'Consistent') AS consistent, count(*) FILTER (label = 'Contradictory') AS contradictory, count(*) FILTER (label = 'Unverifiable') AS unverifiable
FROM f GROUP BY GROUPING SETS ((ticker, y, q), (ticker), ())""")
def period_rollup_total(spark, d):
    return metrics.period_rollup(_findings(spark, d))


@query("""SELECT o_orderpriority AS ticker, count(*) AS claims, count(*) FILTER (o_orderstatus = 'F') AS consistent, count(*) FILTER (o_orderstatus = 'O') AS contradictory, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS unverifiable FROM orders GROUP BY 1""")
def label_counts(spark, d):
    return metrics.label_counts(_findings(spark, d), "ticker")


@query("""SELECT upper(lang) AS ticker, 2024 AS fiscal_year, CASE doc_id % 3 WHEN 0 THEN 'FY' WHEN 1 THEN 'Q3' ELSE 'Q1' END AS fiscal_period, CASE doc_id % 3 WHEN 0 THEN '10-K' ELSE '10-Q' END AS doc_type, count(*) AS chunks,
 count(*) FILTER (doc_id % 5 = 0) AS tables, 0::BIGINT AS speakers, count(DISTINCT source) AS sections FROM documents GROUP BY ALL""")
def chunk_summary(spark, d):
    return metrics.chunk_summary(_chunk_table(spark, d).withColumn("speaker_name", F.lit(None).cast("string")))


_QUOTA = "CASE expected WHEN 'Consistent' THEN 2 ELSE 1 END"


@query(f"""WITH {_JUDGED}, r AS (
  SELECT printf('%07d', doc_id) AS claim_id, doc_id % 50 AS period, expected, row_number() OVER (PARTITION BY doc_id % 50, expected ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY doc_id % 50, expected) AS n FROM judged
)
SELECT claim_id, period, expected FROM r WHERE ((i - (('0x' || sha256('P' || period || '|' || expected)[1:8])::BIGINT % n)) % n + n) % n < {_QUOTA}""")
def mini_sample(spark, d):
    rows = _judged(spark, d).select(F.format_string("%07d", "doc_id").alias("claim_id"), F.pmod("doc_id", F.lit(50)).alias("period"), "expected")
    return sampling.mini_sample(rows, F.concat(F.lit("P"), F.col("period").cast("string")), "expected", period=("period",))


# ---------------------------------------------------------------- fiscal calendar

_FYE = "CASE o_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 9 ELSE 12 END"
_PERIOD = f"""fp AS (
  SELECT *, (o_orderkey % 4 + 1)::INT AS q, {_FYE} AS fye, year(o_orderdate)::INT AS fy FROM orders
), fe AS (SELECT *, ((fye - 1 + 3 * q) % 12 + 1)::INT AS em FROM fp), fx AS (SELECT *, CASE WHEN em > fye THEN fy - 1 ELSE fy END AS ey FROM fe)"""


def _fiscal(spark, d):
    mmdd = F.element_at(F.array(F.lit("0131"), F.lit("0928"), F.lit("1231")), (F.pmod("o_custkey", F.lit(3)) + 1).cast("int"))
    return _read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", fiscal.year_end_month(mmdd).alias("fye"), (F.pmod("o_orderkey", F.lit(4)) + 1).cast("int").alias("q"), F.year("o_orderdate").alias("fy"))


@query(f"""WITH {_PERIOD} SELECT o_orderkey, 'FY' || fy || ' Q' || q AS label, em AS end_month, ey AS end_year,
 array_to_string([strftime(make_date(ey, em, 1) - INTERVAL 2 MONTH, '%Y-%m'), strftime(make_date(ey, em, 1) - INTERVAL 1 MONTH, '%Y-%m'), strftime(make_date(ey, em, 1), '%Y-%m')], ',') AS months FROM fx""")
def fiscal_period(spark, d):
    p = fiscal.quarter_period(F.col("fy"), F.col("fye"), F.col("q"))
    return _fiscal(spark, d).select("o_orderkey", p.alias("p")).select("o_orderkey", "p.label", "p.end_month", "p.end_year", F.array_join("p.months", ",").alias("months"))


_SCORE = "CASE WHEN (CASE WHEN month(o_orderdate) > fye THEN year(o_orderdate) + 1 ELSE year(o_orderdate) END) = fy AND least(abs(month(o_orderdate) - em), 12 - abs(month(o_orderdate) - em)) <= 1 THEN least(abs(month(o_orderdate) - em), 12 - abs(month(o_orderdate) - em)) * 100 + abs(day(o_orderdate) - 28) END"


@query(f"WITH {_PERIOD} SELECT o_orderkey, ({_SCORE})::INT AS score FROM fx")
def report_match(spark, d):
    score = fiscal.report_match_score(fiscal.iso_date(F.col("o_orderdate")), F.col("fy"), F.col("fye"), F.col("q"))
    return _fiscal(spark, d).select("o_orderkey", score.alias("score"))


@query(f"WITH {_PERIOD}, s AS (SELECT o_custkey, fy, o_orderkey, {_SCORE} AS score FROM fx) SELECT o_custkey, fy, o_orderkey, score::INT AS score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, fy ORDER BY score, o_orderkey) AS n FROM s WHERE score IS NOT NULL) WHERE n = 1")
def best_filing(spark, d):
    score = fiscal.report_match_score(F.to_date("o_orderdate"), F.col("fy"), F.col("fye"), F.col("q"))
    rows = _fiscal(spark, d).select("o_custkey", "fy", "o_orderkey", score.alias("score"))
    return manifest.best_filing(rows, ["o_custkey", "fy"], "score", "o_orderkey").select("o_custkey", "fy", "o_orderkey", "score")


@query("""SELECT o_orderkey, 'Q' || quarter(o_orderdate) AS quarter, CASE WHEN o_orderkey % 3 = 0 THEN '10-Q' WHEN quarter(o_orderdate) = 4 THEN '10-K' ELSE '10-Q' END AS form,
 CASE WHEN o_orderkey % 3 <> 0 AND quarter(o_orderdate) = 4 THEN 'FY' ELSE 'Q' || quarter(o_orderdate) END AS period, 'C' || o_custkey || '_' || year(o_orderdate) || '_Q' || quarter(o_orderdate) || printf('_%02d', o_orderkey % 100) AS claim_id FROM orders""")
def identifiers(spark, d):
    raw = F.concat(F.when(F.pmod("o_orderkey", F.lit(2)) == 0, " q").otherwise(""), F.quarter("o_orderdate").cast("string"))
    rows = _read(spark, d, "orders").withColumn("quarter", ids.strict_quarter(raw))
    form = ids.resolved_form(F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.lit("10-q ")), F.col("quarter"))
    ticker = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    return rows.select("o_orderkey", "quarter", form.alias("form"), ids.fiscal_period(form, F.col("quarter")).alias("period"), ids.claim_id(ticker, F.year("o_orderdate"), F.col("quarter"), F.pmod("o_orderkey", F.lit(100))).alias("claim_id"))


# ---------------------------------------------------------------- calls and pages


_HEAD = "Date\nQ1 2025\n\nCall participants\nChief Financial Officer — Jane Doe\n\nIndustry glossary\nARPU: The revenue of a user\nCloud Unit: Total of two lines\n\nFull Conference Call Transcript\n"


def _calls(spark, d):
    """Each conversation as a call with a preamble; speaker lines take four forms in turn."""
    name = F.when(F.col("role") == "user", "Jane Doe").when(F.col("role") == "assistant", "John Roe").otherwise("Operator")
    title = F.when(F.col("role") == "user", "Chief Financial Officer").otherwise("Director, Sales")
    said = F.trim(F.regexp_replace("text", r"\s+", " "))
    form = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    line = (
        F.when((form == 1) & (name != "Operator"), F.concat(name, F.lit(" -- "), title, F.lit("\n"), said))
        .when((form == 2) & (name != "Operator"), F.concat(F.upper(name), F.lit(": Thank you. "), said))
        .when(form == 3, F.concat(name, F.lit("\n\n"), said)).otherwise(F.concat(name, F.lit(":\r\n"), said))
    )
    rows = _read(spark, d, "conversations").withColumn("line", line)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("conv_id").agg(F.concat(F.lit(_HEAD), lines).alias("text"))


@query("""WITH s AS (
  SELECT conv_id, turn, role, (conv_id + turn) % 4 AS form, CASE role WHEN 'user' THEN 'Jane Doe' WHEN 'assistant' THEN 'John Roe' ELSE 'Operator' END AS speaker, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS said FROM conversations
), t AS (
  SELECT *, CASE WHEN form = 2 AND speaker <> 'Operator' THEN trim('Thank you. ' || said) ELSE said END AS text, max(CASE WHEN form = 1 AND role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS known FROM s
)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS turn, speaker, text, CASE WHEN role = 'user' THEN 'Chief Financial Officer' WHEN role = 'assistant' AND known = 1 THEN 'Director, Sales' END AS role FROM t WHERE text <> ''""")
def speaker_turns(spark, d):
    calls = _calls(spark, d)
    made = transcripts.with_roles(transcripts.turns(calls, ["conv_id"]), transcripts.roster(transcripts.lines_of(calls, ["conv_id"]), ["conv_id"]), ["conv_id"])
    return made.select("conv_id", F.col("turn").cast("long").alias("turn"), "speaker", "text", "role")


_LINES = [
    ("Tim Cook -- Chief Executive Officer", "Tim Cook", "", "Chief Executive Officer"), ("Operator", "Operator", "", None), ("Operator: Good day", "Operator", "Good day", None),
    ("TIM COOK: hello there", "Tim Cook", "hello there", None), ("Jane Doe: Today we", "Jane Doe", "Today we", None), ("Brian T. Olsavsky", "Brian T. Olsavsky", "", None),
    ("C.J. Smith: hi", "C.J. Smith", "hi", None), ("Ann Lee - Analyst, Big Bank", "Ann Lee", "", "Analyst, Big Bank"), ("Sundar  Pichai", "Sundar Pichai", "", None),
    ("Jane Doe: The plan is", None, None, None), ("AI: The study of machines", None, None, None), ("TPU: Tensor unit", None, None, None), ("Optimus: a robot", None, None, None), ("Bob: ok", None, None, None),
    ("Thank You", None, None, None), ("Chief Executive Officer: hello", None, None, None), ("Revenue rose -- we said", None, None, None), ("GOOG", None, None, None), ("Sales grew.", None, None, None), ("tariff-related: yes", None, None, None),
]


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


@query(f"""WITH forms(k, line, speaker, rest, title) AS (VALUES {', '.join(f"({i}, {', '.join(map(_text, row))})" for i, row in enumerate(_LINES))})
SELECT event_id, line, speaker, rest, title FROM events JOIN forms ON event_id % {len(_LINES)} = k""")
def speaker_lines(spark, d):
    forms = spark.createDataFrame([(i, row[0]) for i, row in enumerate(_LINES)], "k int, line string")
    rows = _read(spark, d, "events").select("event_id", F.pmod("event_id", F.lit(len(_LINES))).cast("int").alias("k")).join(F.broadcast(forms), "k")
    return rows.select("event_id", "line", transcripts.speaker_of(F.col("line")).alias("s")).select("event_id", "line", "s.*")


@query("SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, text) AS before FROM conversations) WHERE before IS DISTINCT FROM role")
def consecutive_dedupe(spark, d):
    return relational.drop_repeats(_read(spark, d, "conversations"), ["conv_id"], ["turn", "text"], "role").select("conv_id", "turn", "role")


@query()
def html_blocks(spark, d):
    return filings.html_blocks(spread(_read(spark, d, "pages")), ["page_id"])


@query()
def filing_chunks(spark, d):
    return filings.filing_chunks(spread(_read(spark, d, "pages")), ["page_id"])


# ---------------------------------------------------------------- keyed tables


@query("SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) - 1 AS global_id FROM documents")
def global_ids(spark, d):
    return relational.global_ids(_read(spark, d, "documents").select("doc_id", "source"), ["source", "doc_id"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_done(spark, d):
    return relational.pending(_read(spark, d, "documents").select("doc_id", "lang"), _read(spark, d, "labels"), ["doc_id"])


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.lang ELSE 'q' || l.quality END AS lang FROM documents d LEFT JOIN labels l USING (doc_id)")
def upsert_latest(spark, d):
    changes = _read(spark, d, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("lang"))
    return relational.upsert(_read(spark, d, "documents").select("doc_id", "lang"), changes, ["doc_id"])


@query("SELECT event_id, (json_extract_string(props, '$.k'))::INT AS k FROM events")
def json_roundtrip(spark, d):
    rows = _read(spark, d, "events").select("event_id", jsonl.from_payload(F.col("props"), "k int").alias("p"))
    return rows.select("event_id", jsonl.from_payload(jsonl.payload("event_id", "p"), "event_id long, p struct<k: int>")["p"]["k"].alias("k"))


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT o_custkey AS c_custkey, o_orderkey, o_totalprice FROM orders)")
def columnar_rows(spark, d):
    packed = _read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("x"))
    held = packed.select("c_custkey", F.struct(F.col("x.o_orderkey").alias("o_orderkey"), F.col("x.o_totalprice").alias("o_totalprice")).alias("recent"))
    return manifest.columnar_rows(held, ["o_orderkey", "o_totalprice"])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark, d):
    return windowed_counts(_read(spark, d, "events"))


# ---------------------------------------------------------------- model steps (local defaults)


_CORRUPTIBLE = f"""{_FACTS}, worded AS (
  SELECT o_orderkey, amount, CASE o_orderkey % 4 WHEN 0 THEN 'Sales of $' || shown || ' million rose ' || share || '% in 2024 across ' || cnt || ' stores, against $3.5 billion'
   WHEN 1 THEN 'Costs went up ' || cnt || '% while the gross margin of the whole company over the period came to ' || share || '%'
   WHEN 2 THEN 'Orders numbered ' || cnt || ',' || printf('%03d', share) || '.50 and returns ' || cnt
   ELSE 'No figure is given here' END AS claim,
  CASE o_orderkey % 4 WHEN 0 THEN shown WHEN 1 THEN share::VARCHAR WHEN 2 THEN cnt || ',' || printf('%03d', share) || '.50' END AS raw FROM facts
), valued AS (
  SELECT *, replace(raw, ',', '')::DOUBLE AS v, [0.88, 0.92, 1.08, 1.12][('0x' || sha256(o_orderkey || '|' || claim || '|' || raw)[1:8])::BIGINT % 4 + 1]::DOUBLE AS f, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END AS digits FROM worded
), stepped AS (
  SELECT *, CASE WHEN o_orderkey % 4 = 1 AND abs(v * f - v) < 0.3 THEN v + 1.2 * sign(f - 1) ELSE v * f END AS w, v + sign(f - 1) * power(10, -digits) AS one FROM valued
), shown AS (
  SELECT *, CASE digits WHEN 0 THEN printf('%.0f', w) WHEN 1 THEN printf('%.1f', w) ELSE printf('%.2f', w) END AS t, CASE digits WHEN 0 THEN printf('%.0f', one) WHEN 1 THEN printf('%.1f', one) ELSE printf('%.2f', one) END AS u FROM stepped
), made AS (
  SELECT *, CASE WHEN t::DOUBLE <> v THEN t ELSE u END AS x FROM shown
), corrupt AS (
  SELECT o_orderkey, claim, CASE o_orderkey % 4 WHEN 0 THEN replace(claim, '$' || raw || ' million', '$' || x || ' million') WHEN 1 THEN claim[:len(claim) - len(raw) - 1] || x || '%'
   WHEN 2 THEN 'Orders numbered ' || CASE WHEN x::DOUBLE >= 1000 THEN regexp_replace(x, '([0-9]{{3}}[.])', ',\\1') ELSE x END || claim[len('Orders numbered ' || raw) + 1:] END AS corrupted FROM made
)"""


def _corruptible(spark, d):
    """Four wordings: a money figure among others, a share without growth words, a number with separators, none."""
    share, cnt = F.col("share").cast("string"), F.col("cnt").cast("string")
    words = (
        F.concat(F.lit("Sales of $"), "shown", F.lit(" million rose "), share, F.lit("% in 2024 across "), cnt, F.lit(" stores, against $3.5 billion")),
        F.concat(F.lit("Costs went up "), cnt, F.lit("% while the gross margin of the whole company over the period came to "), share, F.lit("%")),
        F.concat(F.lit("Orders numbered "), cnt, F.lit(","), F.format_string("%03d", "share"), F.lit(".50 and returns "), cnt),
    )
    kind = F.pmod("o_orderkey", F.lit(4))
    return _facts(spark, d).withColumn("claim", F.when(kind == 0, words[0]).when(kind == 1, words[1]).when(kind == 2, words[2]).otherwise("No figure is given here"))


@query(f"WITH {_CORRUPTIBLE} SELECT o_orderkey, claim, corrupted FROM corrupt")
def number_corruption(spark, d):
    return _corruptible(spark, d).select("o_orderkey", "claim", golden.corrupt(F.col("claim"), F.col("o_orderkey").cast("string")).alias("corrupted"))


@query()
def text_similarity(spark, d):
    claims = _read(spark, d, "benchmark").withColumnRenamed("text", "claim")
    n = claims.agg(F.max("item_id") + 1).first()[0]
    pairs = _read(spark, d, "documents").withColumn("item_id", F.pmod("doc_id", F.lit(n))).join(claims, "item_id")
    return pairs.select("doc_id", "item_id", similarity.text_similarity(F.col("claim"), F.col("text")).alias("similarity"))


@query()
def embed_texts(spark, d):
    return _read(spark, d, "benchmark").select("item_id", backends.HashedEmbedder(64).embed(F.col("text")).alias("embedding"))


@query()
def nli_rule(spark, d):
    found = claim_check.check_claims(_claim_table(spark, d), _chunk_table(spark, d))
    return found.select("claim_id", "nli_label", "nli_confidence", "reasoning", "matched_passage_index", F.size("retrieved").alias("n_passages"))


@query()
def claim_reports(spark, d):
    return claim_check.period_reports(claim_check.check_claims(_claim_table(spark, d), _chunk_table(spark, d)))
