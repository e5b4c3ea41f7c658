"""The thin ``opN_<name>`` queries of the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, htmltext, langid, packing, pii, quality, sharding, simhash, substring, urlfilter
from .common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleaved_shards(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op8_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_private(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


_URL_PARTS = """
WITH parts AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), p AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM cut
), rules(rule_host, rule_path, v) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), fit AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, v,
         row_number() OVER (PARTITION BY p.rowid0 ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS k
  FROM (SELECT *, row_number() OVER () AS rowid0 FROM p) p
  LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fit WHERE k = 1
"""

_DECONTAM = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS m, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)
), hit AS (
  SELECT r, dw.m, i, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g
), words AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS j FROM hit) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

_SUBSTRING = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT r, doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS g
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), late AS (
  SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY g) AS least FROM win) WHERE least < doc_id
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 50)) AS j FROM late
), lists AS (
  SELECT r, list(j) AS js FROM gone GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, k: js IS NULL OR NOT list_contains(js, k)), ' ')) AS kept_sha256
FROM d LEFT JOIN lists USING (r)
"""


_SHARDING = r"""
WITH RECURSIVE octet AS (
  SELECT n, list_reduce(list_concat([n::BIGINT], range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) t(n)
), crc AS (
  SELECT list(c ORDER BY n) AS c FROM octet
), d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce('s' || CAST(source AS VARCHAR), '-') AS stratum,
         md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS token, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
             lambda s, x: xor(s // 256, crc.c[xor(s % 256, x) + 1]))) AS text_crc32
  FROM documents, crc
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY token, doc_id NULLS FIRST, text_crc32, r) - 1 AS k, count(*) OVER (PARTITION BY stratum) AS m FROM d
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY (2 * k + 1) / (2 * m)::DOUBLE, token, doc_id NULLS FIRST, text_crc32, r) - 1 AS place, count(*) OVER () AS n FROM ranked
), dealt AS (
  SELECT *, (8 * (place + 1) - 1) // n AS shard FROM ordered
)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard, CAST(place - (shard * n) // 8 AS BIGINT) AS slot,
       CAST(NULL AS DOUBLE) AS grown_shard, CAST(place AS BIGINT) AS place
FROM dealt
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can express an operator; the others are tested against brute force."""
    return {"op3_substring_dedup": _SUBSTRING, "op5_sharding": _SHARDING, "op6_decontamination": _DECONTAM, "op7_url_filter": _URL_PARTS}
