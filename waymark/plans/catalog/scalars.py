"""Queries over single columns: URLs, texts, answers, page signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import fixed_values as V
from waymark.functions.answers import parse_selection, response_text
from waymark.functions.pages import contact_signals, page_class, specificity, staff_signals
from waymark.functions.status import status_of
from waymark.functions.text import clean_text, distinct_first, squeeze_ws, truncate_content
from waymark.functions.urls import first_url, query_key, sanitize_url, url_key
from waymark.plans.catalog.registry import query
from waymark.plans.views import table, view

# SQL fragments shared by the oracles (RE2 syntax).
_URL = r"^(?:[hH][tT][tT][pP][sS]?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def sanitize_sql(c: str) -> str:
    """Oracle form of ``sanitize_url`` for URLs without brackets or line breaks."""
    t = f"trim({c})"
    return (
        f"CASE WHEN regexp_matches({t}, '^(?i)https?://') THEN concat("
        f"lower(regexp_extract({t}, '^([A-Za-z]+)://', 1)), '://', "
        f"lower(regexp_extract({t}, '{_URL}', 1)), "
        f"CASE WHEN regexp_extract({t}, '{_URL}', 2) = '' THEN '/' "
        f"ELSE regexp_extract({t}, '{_URL}', 2) END, "
        f"CASE WHEN regexp_extract({t}, '{_URL}', 3) = '' THEN '' "
        f"ELSE concat('?', regexp_extract({t}, '{_URL}', 3)) END) END"
    )


def count_sql(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


def staff_sql(title: str, url: str) -> str:
    p = V.STAFF_TERM_PATTERN
    return (
        f"(regexp_matches(lower(coalesce({title}, '')), '{p}') "
        f"OR regexp_matches(lower(coalesce({url}, '')), '{p}'))"
    )


def host_sql(url: str) -> str:
    return f"regexp_extract(lower(trim(coalesce({url}, ''))), '^https?://([^/?#]*)', 1)"


def _host_in_sql(host: str, names: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"{host} = '{n}' OR {host} LIKE '%.{n}'" for n in names) + ")"


def class_sql(title: str, url: str) -> str:
    host, plain = host_sql(url), f"NOT {staff_sql(title, url)}"
    text = f"concat(lower(coalesce({title}, '')), ' ', lower(coalesce({url}, '')))"
    return (
        f"CASE WHEN {_host_in_sql(host, V.SOCIAL_HOSTS)} THEN 'social' "
        f"WHEN {_host_in_sql(host, V.AGGREGATOR_HOSTS)} THEN 'aggregator' "
        f"WHEN {plain} AND regexp_matches({text}, '{V.CONTACT_PATTERN}') THEN 'contact' "
        f"WHEN {plain} AND regexp_matches({text}, '{V.ABOUT_PATTERN}') THEN 'about' "
        f"WHEN {plain} AND regexp_matches({text}, '{V.NEWS_PATTERN}') THEN 'news' "
        f"WHEN {plain} AND regexp_matches({text}, '{V.CALENDAR_PATTERN}') THEN 'calendar' "
        f"ELSE 'candidate' END"
    )


def words_sql(c: str) -> str:
    return (
        f"list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce({c}, '')), "
        f"'[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: w <> ''))"
    )


def share_sql(name: str, title: str, url: str) -> str:
    """Share of the words of ``name`` found in title or host."""
    present = f"list_concat({words_sql(title)}, {words_sql(host_sql(url))})"
    return (
        f"CASE WHEN len({words_sql(name)}) = 0 THEN 0.0 ELSE "
        f"CAST(len(list_intersect({words_sql(name)}, {present})) AS DOUBLE) "
        f"/ len({words_sql(name)}) END"
    )


@query(f"SELECT page_id, {sanitize_sql('url')} AS url FROM page_v", "page_v")
def sanitized_urls(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "page_v").select("page_id", sanitize_url("url").alias("url"))


@query(
    f"SELECT entity_id, {sanitize_sql('staff_directory_url')} AS url FROM entities_v", "entities_v"
)
def sanitized_entity_urls(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "entities_v").select(
        "entity_id", sanitize_url("staff_directory_url").alias("url")
    )


@query(
    """SELECT page_id, nullif(regexp_extract(raw, '(?i)https?://[^\\s"''>)]+'), '') AS link,
 nullif(regexp_extract(html, '(?i)https?://[^\\s"''>)]+'), '') AS html_link
 FROM responses_v JOIN pages USING (page_id)""",
    "responses_v",
)
def first_links(spark: SparkSession, sf: str) -> DataFrame:
    answers = view(spark, sf, "responses_v").select("page_id", first_url("raw").alias("link"))
    pages = table(spark, sf, "pages").select("page_id", first_url("html").alias("html_link"))
    return answers.join(pages, "page_id")


@query(
    "SELECT entity_id, list_idx, page_id, nullif(lower(trim(url)), '') AS url_key "
    "FROM candidate_order_v",
    "candidate_order_v",
)
def url_keys(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "candidate_order_v").select(
        "entity_id", "list_idx", "page_id", url_key("url").alias("url_key")
    )


@query("SELECT page_id, sha1(url) AS query_key FROM pages")
def query_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", query_key("url").alias("query_key"))


@query(
    """SELECT entity_id, coalesce(trim(school_name), '') AS name,
 coalesce(trim(district_name), '') AS district,
 trim(regexp_replace(concat('  ', school_name, '   ', city, '  '), ' +', ' ', 'g')) AS squeezed
 FROM entities_v""",
    "entities_v",
)
def clean_texts(spark: SparkSession, sf: str) -> DataFrame:
    padded = F.concat(F.lit("  "), "school_name", F.lit("   "), "city", F.lit("  "))
    return view(spark, sf, "entities_v").select(
        "entity_id",
        clean_text("school_name").alias("name"),
        clean_text("district_name").alias("district"),
        squeeze_ws(padded).alias("squeezed"),
    )


@query(
    "SELECT doc_id, CASE WHEN length(text) > 500 THEN concat(substr(text, 1, 500), '...') "
    "ELSE text END AS content FROM documents"
)
def truncated_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", truncate_content("text").alias("content"))


@query(
    """SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS first_words FROM (
 SELECT doc_id, place, word, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS n FROM (
  SELECT doc_id, lower(word) AS k, min(place) AS place, arg_min(word, place) AS word FROM (
   SELECT doc_id, unnest(string_split(text, ' ')) AS word,
    generate_subscripts(string_split(text, ' '), 1) AS place FROM documents)
  GROUP BY doc_id, lower(word))) WHERE n <= 10 GROUP BY doc_id"""
)
def distinct_first_words(spark: SparkSession, sf: str) -> DataFrame:
    first = distinct_first(F.split("text", " "), 10)
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(first, " ").alias("first_words")
    )


@query(
    f"""SELECT page_id,
 CASE WHEN kind <= 1 THEN 'ERROR_NOT_FOUND' WHEN kind IN (3, 6, 7) THEN coalesce(link, 'NOT_FOUND')
  ELSE 'NOT_FOUND' END AS url,
 CASE WHEN kind <= 1 THEN NULL WHEN kind = 3 THEN 'high' WHEN kind = 5 THEN 'medium'
  ELSE 'low' END AS confidence,
 CASE WHEN kind <= 1 THEN 'No response from model' WHEN kind = 3 THEN 'ok' WHEN kind = 4 THEN 'none'
  WHEN kind = 5 THEN '' WHEN kind = 8 THEN NULL
  ELSE 'Extracted from malformed response' END AS reasoning
 FROM (SELECT page_id, page_id % 10 AS kind, {sanitize_sql('link')} AS link FROM (
  SELECT page_id, regexp_extract(raw, '(?i)https?://[^\\s"''>)]+') AS link FROM responses_v))""",
    "responses_v",
)
def parsed_answers(spark: SparkSession, sf: str) -> DataFrame:
    parsed = view(spark, sf, "responses_v").select("page_id", parse_selection("raw").alias("s"))
    return parsed.select("page_id", "s.*")


@query(
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat('see ', url)
 ELSE '' END AS answer FROM pages"""
)
def response_texts(spark: SparkSession, sf: str) -> DataFrame:
    answer = response_text("raw").alias("answer")
    return view(spark, sf, "api_responses_v").select("page_id", answer)


@query(
    """SELECT entity_id, CASE
 WHEN lower(trim(coalesce(staff_directory_url, ''))) = 'not_found' THEN 'not_found'
 WHEN lower(trim(coalesce(staff_directory_url, ''))) = 'error_not_found' THEN 'error'
 WHEN lower(trim(coalesce(staff_directory_url, ''))) IN ('', 'nan', 'none') THEN 'pending'
 ELSE 'found' END AS status FROM entities_v""",
    "entities_v",
)
def entity_status(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "entities_v").select(
        "entity_id", status_of("staff_directory_url").alias("status")
    )


@query(
    f"""SELECT doc_id, CAST({count_sql('content', V.EMAIL_PATTERN)} AS INTEGER) AS emails,
 CAST({count_sql('content', V.PHONE_PATTERN)} AS INTEGER) AS phones FROM e1_corpus_v""",
    "e1_corpus_v",
)
def contact_counts(spark: SparkSession, sf: str) -> DataFrame:
    found = view(spark, sf, "e1_corpus_v").select("doc_id", contact_signals("content").alias("s"))
    return found.select("doc_id", "s.*")


@query(
    f"""SELECT doc_id, CAST({staff_sql('title', 'url')} AS INTEGER) AS staff_term,
 CAST(regexp_matches(lower(url), '{V.DIRECTORY_SLUG_PATTERN}') AS INTEGER) AS slug FROM e1_corpus_v
 """,
    "e1_corpus_v",
)
def staff_terms(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "e1_corpus_v").select("doc_id", staff_signals("title", "url").alias("s"))
    return s.select(
        "doc_id",
        F.col("s.staff_term").cast("int").alias("staff_term"),
        F.col("s.slug").cast("int").alias("slug"),
    )


@query(
    f"""SELECT page_id AS id, {class_sql('title', 'url')} AS page_class FROM page_v
 UNION ALL SELECT -1 - doc_id, {class_sql('title', 'url')} FROM e1_corpus_v""",
    "page_v",
    "e1_corpus_v",
)
def page_classes(spark: SparkSession, sf: str) -> DataFrame:
    kind = page_class("title", "url").alias("page_class")
    pages = view(spark, sf, "page_v").select(F.col("page_id").alias("id"), kind)
    corpus = view(spark, sf, "e1_corpus_v").select((-1 - F.col("doc_id")).alias("id"), kind)
    return pages.unionByName(corpus)


@query(
    f"""SELECT page_id, {share_sql('host', 'title', 'url')} AS share,
 CAST({share_sql('host', 'title', 'url')} >= 0.5 AS INTEGER) AS specific,
 CAST({share_sql('host', 'title', 'url')} < 0.5 AND {share_sql('title', 'title', 'url')} >= 0.5
  AS INTEGER) AS district_only FROM page_v""",
    "page_v",
)
def page_specificity(spark: SparkSession, sf: str) -> DataFrame:
    fit = specificity("host", "title", "title", "url").alias("f")
    return (
        view(spark, sf, "page_v")
        .select("page_id", fit)
        .select(
            "page_id",
            "f.share",
            F.col("f.specific").cast("int").alias("specific"),
            F.col("f.district_only").cast("int").alias("district_only"),
        )
    )
