"""Queries over entity tables, stored responses, caches and fetch logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import fixed_values as V
from waymark.operators.entities import (
    OutputColumns,
    build_queries,
    canonicalize_entities,
    ensure_output_columns,
)
from waymark.operators.lookup import distinct_queries, split_cached
from waymark.operators.upkeep import (
    classify_fetches,
    confidence_counts,
    pending,
    remaining,
    run_summary,
    write_back,
)
from waymark.plans.catalog.registry import query
from waymark.plans.resolve import query_rows
from waymark.plans.views import table, view
from waymark.session import scratch_path
from waymark.sources.search_cache import append_cache, read_cache
from waymark.sources.search_results import normalize_candidates, read_search_results
from waymark.sources.tables import load_for_run, read_results, write_results

URL = "staff_directory_url"
NAMES = OutputColumns(URL, V.CONFIDENCE_COLUMN, V.REASONING_COLUMN)


def _sql_list(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def pending_sql(c: str = URL) -> str:
    return f"lower(trim(coalesce({c}, ''))) IN {_sql_list(V.PENDING_MARKERS)}"


def _cell_sql(c: str) -> str:
    return f"CASE WHEN {c} IN {_sql_list(V.NA_TOKENS)} THEN NULL ELSE {c} END AS {c}"


@query(
    f"""SELECT CAST(entity_id AS VARCHAR) AS entity_id, {_cell_sql('school_name')},
 {_cell_sql('district_name')}, {_cell_sql('city')}, {_cell_sql('state')}, {_cell_sql(URL)}
 FROM entities_v""",
    "entities_v",
)
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "entities-csv")
    write_results(view(spark, sf, "entities_v"), path, "csv")
    return read_results(spark, path, "csv")


@query(
    """SELECT entity_id, coalesce(trim(school_name), '') AS name,
 coalesce(trim(district_name), '') AS district, '' AS county, city, state FROM entities_v""",
    "entities_v",
)
def canonical_entities(spark: SparkSession, sf: str) -> DataFrame:
    return canonicalize_entities(view(spark, sf, "entities_v")).select("entity_id", "entity.*")


@query(
    """SELECT entity_id, staff_directory_url AS url_cell, CAST(NULL AS VARCHAR) AS "Confidence",
 CAST(NULL AS VARCHAR) AS "Reasoning", 'staff_directory_url' AS url_column FROM entities_v""",
    "entities_v",
)
def output_columns(spark: SparkSession, sf: str) -> DataFrame:
    df, names = ensure_output_columns(view(spark, sf, "entities_v"))
    return df.select(
        "entity_id",
        F.col(names.url).alias("url_cell"),
        names.confidence,
        names.reasoning,
        F.lit(names.url).alias("url_column"),
    )


QUERIES_SQL = """
named AS (SELECT entity_id, coalesce(trim(school_name), '') AS name,
  coalesce(trim(district_name), '') AS district, concat(city, ' ', state) AS wh, city, state
 FROM entities_v),
lead AS (SELECT *, CASE WHEN name = '' THEN '' ELSE concat('"', name, '"') END AS q FROM named),
asked AS (
 SELECT *, 0 AS list_idx, concat(q, ' "staff directory" ', wh) AS query FROM lead
 UNION ALL SELECT *, 1, concat(q, ' ("faculty & staff" OR "faculty and staff" OR "staff") ', wh)
  FROM lead
 UNION ALL SELECT *, 2,
  concat(q, ' ("our staff" OR "staff list" OR "faculty directory" OR "directory") ', wh) FROM lead
 UNION ALL SELECT *, 3,
  concat('"', district, '" ("staff directory" OR "directory") ', q, ' ', wh) FROM lead
  WHERE district <> ''),
queries AS (SELECT entity_id, list_idx, trim(regexp_replace(query, ' +', ' ', 'g')) AS query, name,
  CASE WHEN list_idx = 3 THEN concat(city, '|', state, '|', district) ELSE concat(city, '|', state)
   END AS should_terms FROM asked)
"""


def with_queries(sql: str) -> str:
    return f", {QUERIES_SQL.strip()} {sql.strip()}"


@query(
    with_queries("SELECT entity_id, list_idx, query FROM queries WHERE list_idx < 3"),
    "entities_v",
)
def search_queries(spark: SparkSession, sf: str) -> DataFrame:
    canonical = canonicalize_entities(view(spark, sf, "entities_v"))
    asked = build_queries(canonical.select("entity_id", "entity"))
    rows = asked.select("entity_id", F.posexplode_outer("queries").alias("list_idx", "query"))
    return rows.filter("query IS NOT NULL")


@query(
    with_queries(
        "SELECT entity_id, list_idx, query, name AS must_phrase, should_terms FROM queries"
    ),
    "entities_v",
)
def structured_queries(spark: SparkSession, sf: str) -> DataFrame:
    canonical = canonicalize_entities(view(spark, sf, "entities_v"))
    return query_rows(canonical, max_queries=4).select(
        "entity_id",
        "list_idx",
        "query",
        "must_phrase",
        F.array_join("should_terms", "|").alias("should_terms"),
    )


@query(
    with_queries(
        """SELECT sha1(query) AS query_key, query, count(*) AS n_rows FROM queries
 WHERE list_idx < 3 GROUP BY query"""
    ),
    "entities_v",
)
def distinct_search_queries(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_queries(search_queries(spark, sf))


@query(f"SELECT entity_id, {URL} FROM entities_v WHERE {pending_sql()}", "entities_v")
def pending_entities(spark: SparkSession, sf: str) -> DataFrame:
    return pending(view(spark, sf, "entities_v"), URL).select("entity_id", URL)


@query(
    """SELECT page_id, 0 AS pos, CASE WHEN page_id % 5 = 0 THEN 'a' ELSE '' END AS title, url,
  CASE page_id % 5 WHEN 0 THEN 'd' WHEN 2 THEN 'c' ELSE '' END AS content
 FROM pages WHERE page_id % 5 < 3
 UNION ALL SELECT page_id, 1, '', '', '' FROM pages WHERE page_id % 5 = 0"""
)
def search_response_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return read_search_results(view(spark, sf, "search_responses_v"), "raw")


@query(
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE title END AS title,
 CASE WHEN page_id % 4 = 0 THEN '' ELSE url END AS url,
 CASE WHEN page_id % 2 = 0 THEN host ELSE title END AS content FROM page_v""",
    "page_v",
)
def normalized_candidates(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page_id")
    raw = view(spark, sf, "page_v").select(
        "page_id",
        F.when(p % 3 != 0, F.col("title")).alias("title"),
        F.when(p % 4 != 0, F.col("url")).alias("url"),
        F.when(p % 2 != 0, F.col("title")).otherwise("").alias("content"),
        F.col("host").alias("description"),
    )
    return normalize_candidates(raw)


def _results(entities: DataFrame) -> DataFrame:
    """A result for every second entity, some with null parts."""
    e = F.col("entity_id")
    return entities.filter(e % 2 == 0).select(
        "entity_id",
        F.concat(F.lit("https://new.example.org/"), e.cast("string")).alias("url"),
        F.when(e % 4 == 0, "high").alias("confidence"),
        F.when(e % 6 == 0, "why").alias("reasoning"),
    )


@query(
    f"""SELECT entity_id,
 CASE WHEN entity_id % 2 = 0 THEN concat('https://new.example.org/', CAST(entity_id AS VARCHAR))
  ELSE {URL} END AS {URL},
 CASE WHEN entity_id % 4 = 0 THEN 'high' WHEN entity_id % 2 = 0 THEN '' ELSE 'old' END
  AS "Confidence",
 CASE WHEN entity_id % 6 = 0 THEN 'why' WHEN entity_id % 2 = 0 THEN NULL ELSE 'before' END
  AS "Reasoning" FROM entities_v""",
    "entities_v",
)
def written_back(spark: SparkSession, sf: str) -> DataFrame:
    entities = view(spark, sf, "entities_v").select("entity_id", URL)
    old = entities.withColumns({"Confidence": F.lit("old"), "Reasoning": F.lit("before")})
    return write_back(old, _results(entities), "entity_id", NAMES)


def _prior(entities: DataFrame) -> DataFrame:
    """Earlier output that lacks every seventh entity and holds new URLs for some."""
    e = F.col("entity_id")
    return entities.filter(e % 7 != 0).select(
        "entity_id",
        "school_name",
        F.when(e % 2 == 0, "https://prior.example.org/").otherwise(F.col(URL)).alias(URL),
        F.when(e % 2 == 0, "high").alias("Confidence"),
    )


@query(
    f"""SELECT entity_id, school_name, city, CASE WHEN entity_id % 7 <> 0 AND entity_id % 2 = 0
  THEN 'https://prior.example.org/' ELSE {URL} END AS {URL},
 CASE WHEN entity_id % 7 <> 0 AND entity_id % 2 = 0 THEN 'high' END AS "Confidence"
 FROM entities_v""",
    "entities_v",
)
def merged_prior_output(spark: SparkSession, sf: str) -> DataFrame:
    entities = view(spark, sf, "entities_v").select("entity_id", "school_name", "city", URL)
    return load_for_run(entities, _prior(entities), mode="merge", key="entity_id")


@query(
    f"""SELECT entity_id, school_name,
 CASE WHEN entity_id % 2 = 0 THEN 'https://prior.example.org/' ELSE {URL} END AS {URL},
 CASE WHEN entity_id % 2 = 0 THEN 'high' END AS "Confidence"
 FROM entities_v WHERE entity_id % 7 <> 0""",
    "entities_v",
)
def prior_output_wins(spark: SparkSession, sf: str) -> DataFrame:
    entities = view(spark, sf, "entities_v")
    return load_for_run(entities, _prior(entities))


@query(
    f"""SELECT entity_id, school_name FROM entities_v
 WHERE entity_id % 7 = 0 OR (entity_id % 2 <> 0 AND {pending_sql()})""",
    "entities_v",
)
def remaining_entities(spark: SparkSession, sf: str) -> DataFrame:
    entities = view(spark, sf, "entities_v")
    todo = remaining(entities, _prior(entities), "entity_id", URL)
    return todo.select("entity_id", "school_name")


@query(
    f"""SELECT count(*) AS rows_total, count(*) FILTER ({pending_sql()}) AS rows_pending,
 count(*) FILTER (trim(coalesce({URL}, '')) <> ''
  AND lower(trim({URL})) NOT IN ('not_found', 'error_not_found')) AS rows_found,
 count(*) FILTER (lower(trim({URL})) = 'not_found') AS rows_not_found,
 count(*) FILTER (lower(trim({URL})) = 'error_not_found') AS rows_error FROM entities_v""",
    "entities_v",
)
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return run_summary(view(spark, sf, "entities_v"), URL)


@query(
    """SELECT CASE WHEN entity_id % 4 = 0 THEN 'high' WHEN entity_id % 2 = 0 THEN '' ELSE 'old' END
 AS confidence, count(*) AS n_rows FROM entities_v GROUP BY 1""",
    "entities_v",
)
def confidence_levels(spark: SparkSession, sf: str) -> DataFrame:
    return confidence_counts(written_back(spark, sf))


def _stored_cache(spark: SparkSession, sf: str) -> str:
    """A cache of two batches over the pages; every third page is cached twice,
    every fifth entry is unreadable."""
    p = F.col("page_id")
    pages = view(spark, sf, "page_v").filter(p % 4 != 3)
    entry = F.array(F.struct("title", "url", F.lit("").alias("content")))
    older = pages.select(
        query_text().alias("query"), F.when(p % 5 != 0, entry).alias("results"), "page_id"
    )
    newer = older.filter(p % 3 == 0).withColumn(
        "results", F.transform("results", lambda c: c.withField("title", F.lit("newer")))
    )
    path = scratch_path(spark, "search-cache")
    for batch_id, rows in enumerate((older, newer)):
        append_cache(rows.withColumn("query_key", F.sha1("query")), path, batch_id)
    return path


def query_text():
    return F.concat(F.lit("page "), F.col("page_id").cast("string"))


@query(
    """SELECT sha1(concat('page ', CAST(page_id AS VARCHAR))) AS query_key, 1 AS n,
 CASE WHEN page_id % 3 = 0 THEN 'newer' ELSE title END AS title
 FROM page_v WHERE page_id % 4 <> 3 AND page_id % 5 <> 0""",
    "page_v",
)
def cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    asked = distinct_queries(table(spark, sf, "pages").select(query_text().alias("query")))
    hits, _ = split_cached(asked, read_cache(spark, _stored_cache(spark, sf)))
    return hits.select(
        "query_key", F.size("results").alias("n"), F.col("results")[0]["title"].alias("title")
    )


@query(
    """SELECT concat('page ', CAST(page_id AS VARCHAR)) AS query,
 sha1(concat('page ', CAST(page_id AS VARCHAR))) AS query_key FROM pages
 WHERE page_id % 4 = 3 OR page_id % 5 = 0"""
)
def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    asked = distinct_queries(table(spark, sf, "pages").select(query_text().alias("query")))
    _, misses = split_cached(asked, read_cache(spark, _stored_cache(spark, sf)))
    return misses.select("query", "query_key")


@query(
    """, labelled AS (SELECT *, CASE WHEN error IN ('ReadTimeout', 'ConnectError') THEN 'retryable'
  WHEN status = 422 THEN 'empty' WHEN status = 429 OR status BETWEEN 500 AND 599 THEN 'retryable'
  WHEN status = 200 THEN 'ok' ELSE 'fatal' END AS outcome,
  row_number() OVER (PARTITION BY query_key ORDER BY ts DESC, event_id DESC) AS n,
  count(*) OVER (PARTITION BY query_key) AS attempts FROM fetch_log_v)
 SELECT query_key, attempts, outcome, CAST(outcome = 'retryable' AND attempts < 100 AS INTEGER)
  AS due FROM labelled WHERE n = 1""",
    "fetch_log_v",
)
def fetch_states(spark: SparkSession, sf: str) -> DataFrame:
    states = classify_fetches(view(spark, sf, "fetch_log_v"), max_attempts=100)
    return states.withColumn("due", F.col("due").cast("int"))
