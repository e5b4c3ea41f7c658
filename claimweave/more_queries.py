"""Registered queries of files, pages and golden sets, beside those in ``queries``; this module holds the whole registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import backends
from .functions import figures
from .operators import golden
from .queries import _CORRUPTIBLE, REGISTRY, SQL, _corruptible, _figured, _read, query
from .sources import call_pages, layout
from .storage import written

__all__ = ["REGISTRY", "SQL"]


# ---------------------------------------------------------------- files

_OF = "'C' || o_custkey AS t, year(o_orderdate) AS y, quarter(o_orderdate) AS q"


def _periods(spark, d):
    return _read(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("ticker"), F.year("o_orderdate").alias("fiscal_year"), F.quarter("o_orderdate").alias("n"),
        F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("fiscal_quarter"), F.when(F.quarter("o_orderdate") == 4, "10-K").otherwise("10-Q").alias("form"),
    )


@query(f"""SELECT o_orderkey, 'data/raw/filings/' || y || '/' || t || '/' || t || '_FY' || y || CASE q WHEN 4 THEN '_10K' ELSE '_Q' || q || '_10Q' END || '.html' AS filing,
 'data/raw/transcripts/' || y || '/' || t || '/FY' || y || '_Q' || q || '.meta.json' AS sidecar, 'data/eval/golden/' || y || '/' || t || '/' || t || '_FY' || y || '_Q' || q || '_golden_claims.jsonl' AS golden,
 'data/reports/' || y || '/' || t || '/' || t || '_FY' || y || '_Q' || q || '_reports.json' AS report, 'data/chunks/' || y || '/' || t || '/' || t || '_FY' || y || '_Q' || q || '_transcript.jsonl' AS chunks
FROM (SELECT o_orderkey, {_OF} FROM orders)""")
def file_paths(spark, d):
    c = [F.col(x) for x in ("ticker", "fiscal_year", "fiscal_quarter")]
    return _periods(spark, d).select(
        "o_orderkey", layout.path_of("filing", *c, F.col("form")).alias("filing"), layout.sidecar_of(layout.path_of("transcript", *c)).alias("sidecar"),
        layout.path_of("golden", *c).alias("golden"), layout.path_of("report", *c).alias("report"), layout.path_of("chunks", *c, F.lit("transcript")).alias("chunks"),
    )


def _files(spark, d):
    """A listing: transcripts of two thirds of the orders' periods, some in another year's folder; filings of three quarters, some of the older naming."""
    rows, c = _periods(spark, d), [F.col(x) for x in ("ticker", "fiscal_year", "fiscal_quarter")]
    third, fourth = F.pmod("o_orderkey", F.lit(3)), F.pmod("o_orderkey", F.lit(4))
    there = F.regexp_replace(layout.path_of("transcript", *c), r"/(\d{4})/", "/2999/")
    calls = rows.where(third < 2).select(F.when(F.pmod("o_orderkey", F.lit(7)) == 0, there).otherwise(layout.path_of("transcript", *c)).alias("path"))
    name = layout.path_of("filing", *c, F.col("form"))
    filings = rows.where(fourth < 3).select(F.when(fourth == 0, F.regexp_replace(name, r"_Q[1-3]_10Q", "_10Q")).otherwise(name).alias("path"))
    return calls.unionByName(filings).distinct()


@query(f"""WITH o AS (SELECT o_orderkey AS k, {_OF} FROM orders), calls AS (
  SELECT DISTINCT t, y, q FROM o WHERE k % 3 < 2 AND k % 7 <> 0
), own AS (SELECT DISTINCT t, y, q FROM o WHERE k % 4 IN (1, 2) OR (k % 4 = 0 AND q = 4)), older AS (SELECT DISTINCT t, y FROM o WHERE k % 4 = 0 AND q < 4)
SELECT t AS ticker, y AS fiscal_year, 'Q' || q AS fiscal_quarter, CASE q WHEN 4 THEN '10-K' ELSE '10-Q' END AS form, 'data/raw/filings/' || y || '/' || t || '/' || t || '_FY' || y || CASE WHEN q = 4 THEN '_10K' WHEN own.t IS NOT NULL THEN '_Q' || q || '_10Q' ELSE '_10Q' END || '.html' AS filing_path
FROM calls LEFT JOIN own USING (t, y, q) LEFT JOIN older USING (t, y) WHERE own.t IS NOT NULL OR (q < 4 AND older.t IS NOT NULL)""")
def complete_periods(spark, d):
    return layout.complete_periods(_files(spark, d)).drop("transcript_path")


@query(f"""WITH o AS (SELECT o_orderkey AS k, {_OF} FROM orders), f AS (
  SELECT DISTINCT t, y, q, CASE WHEN (y + ascii(t[-1])) % 2 = 0 AND k % 3 = 0 THEN 'jsonl' ELSE 'json' END AS e FROM o
)
SELECT t AS ticker, y AS fiscal_year, 'Q' || q AS fiscal_quarter, 'data/claims/' || y || '/' || t || '/' || t || '_FY' || y || '_Q' || q || '_claims.' || e AS path
FROM (SELECT *, max(CASE WHEN e = 'jsonl' THEN 1 ELSE 0 END) OVER (PARTITION BY t, y) AS lines FROM f) WHERE q = 2 AND (e = 'jsonl' OR lines = 0)""")
def claim_files(spark, d):
    rows, c = _periods(spark, d), [F.col(x) for x in ("ticker", "fiscal_year", "fiscal_quarter")]
    lines = (F.pmod(F.col("fiscal_year") + F.ascii(F.substring("ticker", -1, 1)), F.lit(2)) == 0) & (F.pmod("o_orderkey", F.lit(3)) == 0)
    path = layout.path_of("claims", *c)
    listing = rows.select(F.when(lines, path).otherwise(F.regexp_replace(path, r"\.jsonl$", ".json")).alias("path")).distinct()
    return layout.period_files(listing, "claims", quarter="2").select("ticker", "fiscal_year", "fiscal_quarter", "path")


@query("""WITH c AS (SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM conversations), j AS (
  SELECT conv_id, count(*) AS n, string_agg(t, chr(10) || chr(10) ORDER BY turn, t) FILTER (t <> '') AS joined FROM c GROUP BY conv_id
)
SELECT conv_id::VARCHAR AS ticker, CASE WHEN conv_id % 3 = 0 THEN 'stored ' || conv_id ELSE coalesce(joined, '') END AS text, CASE WHEN conv_id % 3 = 0 THEN 'transcript' ELSE n || ' chunks' END AS origin FROM j""")
def transcript_texts(spark, d):
    rows = _read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("ticker"), F.lit(2025).alias("fiscal_year"), F.lit("Q1").alias("fiscal_period"), F.lit("transcript").alias("doc_type"), F.col("turn").alias("pos"), "text")
    periods = rows.select("ticker", "fiscal_year", F.col("fiscal_period").alias("fiscal_quarter")).distinct()
    stored = F.when(F.pmod(F.col("ticker").cast("long"), F.lit(3)) == 0, F.concat(F.lit("stored "), "ticker", F.lit("\n"))).otherwise(" \n")
    return layout.transcript_texts(periods, periods.withColumn("text", stored), rows).select("ticker", "text", "origin")


@query(r"""SELECT 'raw/' || p_partkey || '.meta.json' AS path, '{' || chr(10) || '  ' || CASE WHEN p_partkey % 3 = 0 THEN '"accession": "' || p_partkey || '",' || chr(10) || '  ' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN '"company_name": "Acme \"' || p_partkey || '\"",' || chr(10) || '  ' WHEN p_partkey % 3 = 0 THEN '"company_name": "old",' || chr(10) || '  ' ELSE '' END
 || '"fetched_at": "2025-02-03T04:05:06Z",' || chr(10) || '  "fiscal_quarter": "Q' || (p_partkey % 4 + 1) || '",' || chr(10) || '  "fiscal_year": "2025",' || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN '  "months": ["a","b"],' || chr(10) ELSE '' END || '  "ticker": "P' || p_partkey || '"' || chr(10) || '}' || chr(10) AS text FROM part""")
def sidecar_refresh(spark, d):
    key, named = F.col("p_partkey").cast("string"), F.pmod("p_partkey", F.lit(2)) == 0
    periods = _read(spark, d, "part").select(
        "p_partkey", F.concat(F.lit("raw/"), key, F.lit(".txt")).alias("path"), F.concat(F.lit("p"), key).alias("ticker"), F.lit(2025).alias("fiscal_year"), (F.pmod("p_partkey", F.lit(4)) + 1).alias("fiscal_quarter"),
        F.when(named, F.concat(F.lit('Acme "'), key, F.lit('"'))).otherwise(" ").alias("company_name"),
    )
    old = periods.where("p_partkey % 3 < 2").select(layout.sidecar_of(F.col("path")).alias("path"), F.when(F.expr("p_partkey % 3 = 0"), F.concat(F.lit('{"ticker": "x", "company_name": "old", "months": ["a", "b"], "accession": "'), key, F.lit('"}'))).otherwise("{broken").alias("text"))
    return layout.refreshed_sidecars(periods.drop("p_partkey"), old, F.lit("2025-02-03 04:05:06").cast("timestamp"))


@query("SELECT c_custkey, lpad((CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 7 ELSE c_custkey END)::VARCHAR, 10, '0') AS cik FROM customer")
def cik_lookup(spark, d):
    rows = _read(spark, d, "customer").select("c_custkey", F.concat(F.lit(" c"), F.col("c_custkey").cast("string")).alias("ticker"))
    remote = rows.select(F.upper(F.trim("ticker")).alias("ticker"), F.col("c_custkey").alias("cik"))
    known = remote.where("cik % 5 = 0").withColumn("cik", F.lpad((F.col("cik") + 7).cast("string"), 10, "0"))
    return layout.with_cik(rows, remote, known).select("c_custkey", "cik")


@query("SELECT 'E' || event_id AS ticker, (event_id % 9 + 2000)::INT AS fiscal_year, 'Q' || (event_id % 4 + 1) AS fiscal_quarter, (json_extract_string(props, '$.k'))::INT AS k FROM events WHERE event_id % 3 <> 1")
def readable_reports(spark, d):
    rows = _read(spark, d, "events").withColumns({"ticker": F.concat(F.lit("e"), F.col("event_id").cast("string")), "y": (F.pmod("event_id", F.lit(9)) + 2000).cast("int"), "q": (F.pmod("event_id", F.lit(4)) + 1).cast("string")})
    text = F.when(F.expr("event_id % 3 = 1"), F.substring("props", 1, 3)).otherwise(F.col("props"))
    files = rows.select(layout.path_of("report", F.col("ticker"), F.col("y"), F.col("q")).alias("path"), text.alias("text"))
    return layout.reports(files, "k int").select("ticker", "fiscal_year", "fiscal_quarter", F.col("value.k").alias("k"))


# ---------------------------------------------------------------- saved transcript pages

_SAID = "'we said ' || trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


def _saved_pages(spark, d):
    """Each conversation as a saved page: three layouts, some with a date, all with noise around the call."""
    said = F.concat(F.lit("we said "), F.trim(F.regexp_replace(F.regexp_replace("text", "[^A-Za-z0-9 ]", " "), " +", " ")))
    name = F.when(F.col("role") == "user", "Jane Doe").when(F.col("role") == "assistant", "John Roe").otherwise("Operator")
    rows = _read(spark, d, "conversations").withColumn("p", F.concat(F.lit("<p>"), name, F.lit("</p><p>"), said, F.lit("</p>")))
    calls = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "p"))), lambda x: x["p"]), "").alias("call"))
    long = F.lit("<p>" + "more words of the same call " * 60 + "</p>")
    kind = F.pmod("conv_id", F.lit(3))
    head = F.when(F.pmod("conv_id", F.lit(2)) == 0, F.lit('<meta property="article:published_time" content="2025-03-04T10:00:00Z">')).otherwise("")
    inside = (
        F.when(kind == 0, F.concat(F.lit("<div class='article-body'><h2>Takeaways</h2><p>Sales rose</p><h2>Call participants</h2><p>Chief Financial Officer — Jane Doe</p><p>John Roe -- Director of Sales</p><h2>Full Conference Call Transcript</h2>"), "call", long, F.lit("<div class='promo'>Buy now</div></div>")))
        .when(kind == 1, F.concat(F.lit("<div class='article-body'><h2>Prepared Remarks:</h2>"), "call", F.lit("<h2>Questions and Answers</h2><p>Operator</p>"), long, F.lit("<p>Stock Advisor returns</p></div>")))
        .otherwise(F.concat(F.lit("<main><p>pages of the site</p>"), "call", long, F.lit("<p>Continue reading</p></main>")))
    )
    html = F.concat(F.lit("<html><head>"), head, F.lit("</head><body><nav><p>Menu</p></nav>"), inside, F.lit("<footer><p>The end</p></footer></body></html>"))
    return calls.select("conv_id", html.alias("html"), F.lit("https://www.example.org/x").alias("url"), F.lit(2025).alias("fiscal_year"), F.lit("Q1").alias("fiscal_quarter"))


@query(f"""WITH s AS (
  SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'Jane Doe' WHEN 'assistant' THEN 'John Roe' ELSE 'Operator' END || chr(10) || chr(10) || {_SAID}, chr(10) || chr(10) ORDER BY turn) AS call FROM conversations GROUP BY conv_id
), n AS (SELECT conv_id, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) + max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS names FROM conversations GROUP BY conv_id
), p AS (
  SELECT conv_id, call, names, conv_id % 3 AS kind, CASE WHEN conv_id % 2 = 0 THEN 'March 4, 2025' ELSE 'Q1 2025' END AS call_date, trim(repeat('more words of the same call ', 60)) AS long FROM s JOIN n USING (conv_id)
)
SELECT conv_id, call_date, CASE kind WHEN 0 THEN 2 ELSE names END AS people, 'Date' || chr(10) || call_date || chr(10) || chr(10) || 'Full Conference Call Transcript' || chr(10) || chr(10) || call
 || CASE kind WHEN 1 THEN chr(10) || 'Questions & Answers:' || chr(10) || chr(10) || 'Operator' || chr(10) || chr(10) ELSE chr(10) END || long || chr(10) AS text FROM p""")
def call_texts(spark, d):
    made = call_pages.extract_calls(_saved_pages(spark, d), ["conv_id"])
    return made.select("conv_id", "call_date", F.size("participants").alias("people"), "text")


# ---------------------------------------------------------------- golden sets


@query(f"""WITH {_CORRUPTIBLE}, figured AS (
  SELECT o_orderpriority AS ticker, year(o_orderdate) AS y, 'Q' || quarter(o_orderdate) AS q, printf('%010d', o_orderkey) AS id, amount, shown,
   'Sales of $' || shown || ' million rose ' || share || '% in 2024 across ' || cnt || ' stores, against $3.5 billion' AS claim FROM facts
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY ticker, y, q ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY ticker, y, q) AS n FROM figured
), slots AS (SELECT *, s AS slot FROM placed JOIN range(8) r(s) ON s % n = i WHERE n >= 6
), fac AS (
  SELECT *, [0.88, 0.92, 1.08, 1.12][('0x' || sha256(id || '|' || claim || '|' || shown)[1:8])::BIGINT % 4 + 1]::DOUBLE AS f, shown::DOUBLE AS v FROM slots
), turned AS (SELECT *, CASE WHEN printf('%.1f', v * f)::DOUBLE <> v THEN printf('%.1f', v * f) ELSE printf('%.1f', v + sign(f - 1) * 0.1) END AS x FROM fac)
SELECT upper(ticker) || '_' || y || '_' || q || '_' || printf('%02d', slot + 1) AS claim_id, ticker, y AS fiscal_year, q AS fiscal_quarter,
 CASE WHEN slot < 4 THEN claim WHEN slot < 6 THEN 'Sales of $' || x || claim[len('Sales of $' || shown) + 1:] ELSE 'Management privately expects that ' || lower(claim[1]) || claim[2:] END AS claim,
 CASE WHEN slot < 4 THEN 'Consistent' WHEN slot < 6 THEN 'Contradictory' ELSE 'Unverifiable' END AS intended_label, false AS is_golden_claim FROM turned""")
def golden_set(spark, d):
    rows = _figured(spark, d).select(F.col("o_orderpriority").alias("ticker"), F.year("o_orderdate").alias("fiscal_year"), F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("fiscal_quarter"), F.format_string("%010d", "o_orderkey").alias("claim_id"), "claim")
    return golden.golden_set(rows)


@query(r"""WITH s AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: regexp_matches(x, '[0-9]') AND len(x) >= 20) AS l FROM documents WHERE text IS NOT NULL
), u AS (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:10] AS l FROM s)
SELECT doc_id, (i - 1)::INT AS pos, l[i] AS claim FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM u)""")
def extract_claims(spark, d):
    return backends.SentenceExtractor().extract(_read(spark, d, "documents"), ["doc_id"])


@query(f"""WITH {_CORRUPTIBLE}, p AS (SELECT 'T' || (o_orderkey // 16) AS ticker, o_orderkey % 16 AS i, claim FROM corrupt WHERE o_orderkey % 4 < 3), n AS (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY i) - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS m FROM p
)
SELECT ticker, pos AS slot, CASE WHEN pos = 1 THEN 'kept as it is' ELSE claim END AS claim, pos = 1 AS is_golden_claim FROM n WHERE m >= 6 AND pos < 4""")
def modified_set(spark, d):
    """Consistent slots of rewritten sets: each takes its own source claim, but for the golden one, which stays."""
    from pyspark.sql import Window

    rows = _corruptible(spark, d).where("o_orderkey % 4 < 3").select(F.concat(F.lit("T"), F.floor(F.col("o_orderkey") / 16).cast("string")).alias("ticker"), F.lit(2025).alias("fiscal_year"), F.lit("Q1").alias("fiscal_quarter"), F.pmod("o_orderkey", F.lit(16)).alias("i"), "claim", F.lit("x").alias("speaker"))
    source = rows.withColumn("pos", F.row_number().over(Window.partitionBy("ticker").orderBy("i")) - 1).withColumn("m", F.count("*").over(Window.partitionBy("ticker"))).where("m >= 6").drop("i", "m")
    source = written(source, "source-claims")  # read several times below
    current = source.where("pos < 8").withColumns({"slot": F.col("pos"), "claim_id": F.lit(None).cast("string"), "claim": F.when(F.col("pos") == 1, "kept as it is").otherwise("old"), "is_golden_claim": F.col("pos") == 1}).drop("pos")
    return golden.modify_set(current, source).where("slot < 4").select("ticker", F.col("slot").cast("long").alias("slot"), "claim", "is_golden_claim")




# ---------------------------------------------------------------- figures in varied wordings

_FORMS = [
    ("Revenue was $65.6 billion", "usd_m:6.56e+07"), ("$391 million", "usd_m:391"), ("margin of 46.2%", "pct:46.2"), ("up 1,234% on it", "pct:1234,pct:234"), ("in 2024 and 2025", ""),
    ("150 stores", "usd_m:150"), ("12 stores", "num:12"), ("EPS of $1.64", "usd_m:1.64"), ("5b and 3m", "usd_m:3,usd_m:5e+06"), ("3.5 bn", "num:3.5"), ("no figures", ""),
    ("1,250 units, 7 % and $2 B", "pct:7,usd_m:2e+06"), ("", ""), (None, ""),
]


@query(f"""WITH forms(k, claim, tokens) AS (VALUES {', '.join(f"({i}, {'NULL' if t is None else repr(t)}, {w!r})" for i, (t, w) in enumerate(_FORMS))})
SELECT event_id, claim, tokens FROM events JOIN forms ON event_id % {len(_FORMS)} = k""")
def figure_forms(spark, d):
    forms = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(_FORMS)], "k int, claim string")
    rows = _read(spark, d, "events").select("event_id", F.pmod("event_id", F.lit(len(_FORMS))).cast("int").alias("k")).join(F.broadcast(forms), "k")
    return rows.select("event_id", "claim", F.array_join(figures.reference_figures(F.col("claim")), ",").alias("tokens"))
