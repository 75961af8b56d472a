"""Inputs of the registered queries, derived from the driver's tables.

``VIEWS`` holds SQL that Spark and DuckDB both run; ``view`` evaluates one in
Spark over the Parquet files, ``with_views`` puts them in front of an oracle
query.  Ranked-list views number positions inside groups of any size, so the
Spark side builds those with ``number_rows`` and only the oracle uses a plain
window.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.fusion import number_rows

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)

VIEWS = {
    # Blank names, padding, null districts, every pending marker, finished URLs.
    "entities_v": """
SELECT c_custkey AS entity_id,
 CASE WHEN c_custkey % 17 = 0 THEN '  ' WHEN c_custkey % 5 = 0 THEN concat('  ', c_name, ' ')
  ELSE c_name END AS school_name,
 CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS district_name,
 n_name AS city, r_name AS state,
 CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' NaN ' WHEN 3 THEN 'not_found'
  WHEN 4 THEN 'ERROR_NOT_FOUND' WHEN 5 THEN 'none'
  WHEN 6 THEN concat('HTTPS://Host', CAST(c_nationkey AS VARCHAR(9)), '.Example.ORG#top')
  ELSE concat('http://h', CAST(c_nationkey AS VARCHAR(9)), '.example.org/Staff?x=1')
  END AS staff_directory_url
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    # Directory slugs, contact pages, an aggregator, blank URLs.
    "page_v": """
SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
 CASE page_id % 6 WHEN 0 THEN concat(url, '/staff-directory') WHEN 1 THEN concat(url, '/contact-us')
  WHEN 2 THEN concat('https://www.niche.com/k12/', CAST(page_id AS VARCHAR(9))) WHEN 3 THEN '  '
  ELSE url END AS url,
 regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, html AS content FROM pages""",
    # Three ranked lists per host: all pages forward, all backward in capitals,
    # even pages with padded URLs.  Positions are not dense in the third.
    "candidate_order_v": """
SELECT host AS entity_id, 0 AS list_idx, page_id AS place, page_id, url, title FROM page_v
UNION ALL SELECT host, 1, -page_id, page_id, upper(url), title FROM page_v
UNION ALL SELECT host, 2, page_id, page_id, concat(' ', url, ' '), title FROM page_v
 WHERE page_id % 2 = 0""",
    # Each order is one ranked list of supplier pages for its customer.
    "order_lists_v": """
SELECT o_custkey AS entity_id, o_orderkey AS list_idx, l_linenumber - 1 AS pos,
 concat(CASE WHEN l_partkey % 3 = 0 THEN ' HTTPS://S' ELSE 'https://s' END,
  CAST(l_suppkey AS VARCHAR(9)), '.example.com/') AS url
FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    # Five lists per customer, one per order priority, dearest line first.
    "priority_order_v": """
SELECT o_custkey AS entity_id, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS list_idx,
 l_extendedprice, l_orderkey, l_linenumber, l_partkey,
 concat('part-', CAST(l_partkey AS VARCHAR(9))) AS url
FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    # Statuses and errors of fetch attempts, many per key.
    "fetch_log_v": """
SELECT event_id, concat('q', CAST(user_id AS VARCHAR(9))) AS query_key, ts,
 CASE event_id % 8 WHEN 0 THEN 200 WHEN 1 THEN 422 WHEN 2 THEN 429 WHEN 3 THEN 500 WHEN 4 THEN 503
  WHEN 5 THEN 404 WHEN 6 THEN NULL ELSE 200 END AS status,
 CASE WHEN event_id % 16 = 6 THEN 'ReadTimeout' WHEN event_id % 16 = 14 THEN 'ConnectError'
  ELSE NULL END AS error FROM events""",
    # One group of model answers per parsing case.
    "responses_v": """
SELECT page_id, CASE page_id % 10
 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '   '
 WHEN 3 THEN concat('{"selected_index":1,"selected_url":"', upper(substr(url,1,5)), substr(url,6),
  '","confidence":"high","reasoning":"ok"}')
 WHEN 4 THEN '{"selected_index":0,"selected_url":null,"confidence":"low","reasoning":"none"}'
 WHEN 5 THEN '{"selected_url":"NOT_FOUND","confidence":"medium"}'
 WHEN 6 THEN concat('Here is the URL: ', url, ' and more text')
 WHEN 7 THEN concat('["', url, '"]')
 WHEN 8 THEN '{"selected_url":"ftp://example.org/x","confidence":"low","reasoning":null}'
 ELSE 'no link here' END AS raw FROM pages""",
    # Stored API responses around an answer text.
    "api_responses_v": """
SELECT page_id, CASE page_id % 4
 WHEN 0 THEN concat('{"output_text":" ', url, ' ","output":[]}')
 WHEN 1 THEN concat('{"output_text":"","output":[{"type":"reasoning"},{"type":"message","content":',
  '[{"type":"output_text","text":"see "},{"type":"refusal","text":"no"},',
  '{"type":"output_text","text":"', url, '"}]}]}')
 WHEN 2 THEN '{"output":[{"type":"reasoning","content":[{"type":"output_text","text":"x"}]}]}'
 ELSE 'not json' END AS raw FROM pages""",
    # The three response envelopes, junk items, missing fields, no list, not JSON.
    "search_responses_v": """
SELECT page_id, CASE page_id % 5
 WHEN 0 THEN concat('{"results":[{"title":"a","url":"', url,
  '","content":""  ,"description":"d"}, 7, {"url":null}]}')
 WHEN 1 THEN concat('{"results":{}, "data":[{"title":null,"url":"', url, '"}]}')
 WHEN 2 THEN concat('[{"url":"', url, '","content":"c"}]')
 WHEN 3 THEN '{"detail":"no"}' ELSE 'not json' END AS raw FROM pages""",
    # First three words of each passage; the next words are optional terms.
    "phrase_queries_v": """
SELECT item_id AS query_id, lower(regexp_extract(text, '^([^ ]+ [^ ]+ [^ ]+)', 1)) AS must_phrase,
 regexp_extract(text, '^[^ ]+ [^ ]+ [^ ]+ ([^ ]+)', 1) AS term_a,
 regexp_extract(text, '^[^ ]+ [^ ]+ [^ ]+ [^ ]+ ([^ ]+ [^ ]+)', 1) AS term_b FROM benchmark""",
    # Done rows, blank names, names with and without pages.
    "e1_entities_v": """
SELECT item_id AS entity_id,
 lower(regexp_extract(text, '^([^ ]+ [^ ]+ [^ ]+)', 1)) AS school_name,
 CASE WHEN item_id % 4 = 0 THEN '' ELSE 'D' END AS district_name, 'City' AS city, 'ST' AS state,
 CASE item_id % 5 WHEN 4 THEN 'https://done.example.org/' ELSE NULL END AS staff_directory_url
FROM benchmark
UNION ALL SELECT 100000000 + item_id, '  ', 'D', 'City', 'ST', NULL
FROM benchmark WHERE item_id % 10 = 0""",
    # Directory slugs, contact pages, staff titles, e-mails.
    "e1_corpus_v": """
SELECT doc_id, concat('https://', source, '.example.org/', lang, '/', CAST(doc_id AS VARCHAR(9)),
  CASE doc_id % 4 WHEN 0 THEN '/staff-directory' WHEN 1 THEN '/contact-us'
   WHEN 2 THEN '/faculty-staff' ELSE '' END) AS url,
 CASE WHEN doc_id % 3 = 0 THEN 'Our Staff' ELSE 'Page' END AS title,
 CASE WHEN doc_id % 2 = 0 THEN concat(text, ' office@example.org') ELSE text END AS content
FROM documents""",
    # Oracle-side twins of the ranked-list views below.
    "candidates_v": """
SELECT entity_id, list_idx, row_number() OVER (PARTITION BY entity_id, list_idx ORDER BY place) - 1
 AS pos, page_id, url, title FROM candidate_order_v""",
    "priority_lists_v": """
SELECT entity_id, list_idx, row_number() OVER (PARTITION BY entity_id, list_idx
 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) - 1 AS pos, url
FROM priority_order_v""",
}
_NEEDS = {
    "candidate_order_v": ("page_v",),
    "candidates_v": ("page_v", "candidate_order_v"),
    "priority_lists_v": ("priority_order_v",),
}


def _ctes(names: tuple[str, ...]) -> str:
    wanted = []
    for name in names:
        for need in (*_NEEDS.get(name, ()), name):
            if need not in wanted:
                wanted.append(need)
    return ", ".join(f"{name} AS ({VIEWS[name].strip()})" for name in wanted)


def with_views(sql: str, *names: str) -> str:
    """Oracle SQL with the named views as common table expressions in front."""
    return f"WITH {_ctes(names)} {sql.strip()}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of ``VIEWS`` over the Parquet files; nothing is registered."""
    if name == "candidates_v":
        return candidates(spark, sf_dir)
    if name == "priority_lists_v":
        return priority_lists(spark, sf_dir)
    ctes = _ctes((name,))
    files = [
        f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)"
        for t in TABLES
        if re.search(rf"(FROM|JOIN) {t}\b", ctes)
    ]
    return spark.sql(f"WITH {', '.join([*files, ctes])} SELECT * FROM {name}")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``candidates_v``: a host may hold any share of the pages."""
    rows = view(spark, sf_dir, "candidate_order_v")
    numbered = number_rows(rows, ["entity_id", "list_idx"], [F.col("place")], "pos")
    return numbered.withColumn("pos", F.col("pos") - 1).drop("place")


def priority_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``priority_lists_v``: a huge customer is numbered by several tasks."""
    rows = view(spark, sf_dir, "priority_order_v")
    ties = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey")]
    order = [F.desc("l_extendedprice"), *ties]
    numbered = number_rows(rows, ["entity_id", "list_idx"], order, "pos")
    return numbered.select("entity_id", "list_idx", (F.col("pos") - 1).alias("pos"), "url")
