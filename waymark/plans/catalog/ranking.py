"""Queries over ranked lists: fusion, union, shortlists, retrieval, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import fixed_values as V
from waymark.functions.text import truncate_content
from waymark.functions.urls import url_host
from waymark.operators.fusion import (
    collect_shortlist,
    fuse_ranked_lists,
    hot_entities,
    union_ranked,
)
from waymark.operators.retrieval import retrieve
from waymark.operators.selection import build_payload, contacts_of, select_by_tiers
from waymark.plans.catalog.registry import query
from waymark.plans.catalog.scalars import (
    class_sql,
    count_sql,
    sanitize_sql,
    share_sql,
    staff_sql,
)
from waymark.plans.views import table, view
from waymark.session import scratch_path
from waymark.sources.page_index import build_index, retrieve_indexed


def fusion_sql(source: str, name: str = "fused") -> str:
    """Oracle form of fair fusion as the CTEs ``{name}_d`` and ``{name}`` (all ranks)."""
    return f"""{name}_d AS (SELECT *, lower(trim(url)) AS k, row_number() OVER (
  PARTITION BY entity_id, lower(trim(url)) ORDER BY pos, list_idx, url) AS copy
 FROM {source} WHERE trim(url) <> ''),
{name} AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY pos, list_idx, k) AS rk
 FROM {name}_d WHERE copy = 1)"""


_FUSED = "SELECT entity_id, CAST(rk AS INTEGER) AS rank, url FROM fused WHERE rk <= 10"


@query(f", {fusion_sql('candidates_v')} {_FUSED}", "candidates_v")
def rank_fusion_pages(spark: SparkSession, sf: str) -> DataFrame:
    return fuse_ranked_lists(view(spark, sf, "candidates_v")).select("entity_id", "rank", "url")


@query(f", {fusion_sql('priority_lists_v')} {_FUSED}", "priority_lists_v")
def rank_fusion_priority_lists(spark: SparkSession, sf: str) -> DataFrame:
    return fuse_ranked_lists(view(spark, sf, "priority_lists_v")).select("entity_id", "rank", "url")


@query(f", {fusion_sql('order_lists_v')} {_FUSED}", "order_lists_v")
def rank_fusion_orders(spark: SparkSession, sf: str) -> DataFrame:
    lists = view(spark, sf, "order_lists_v")
    fused = fuse_ranked_lists(lists, hot=hot_entities(lists))
    return fused.select("entity_id", "rank", "url")


@query(
    f""", {fusion_sql('order_lists_v')}
 SELECT entity_id, CAST(rk AS INTEGER) AS rank, url FROM fused""",
    "order_lists_v",
)
def rank_fusion_all_orders(spark: SparkSession, sf: str) -> DataFrame:
    fused = fuse_ranked_lists(view(spark, sf, "order_lists_v"), limit=None)
    return fused.select("entity_id", "rank", "url")


@query(
    f""", {fusion_sql('candidates_v')}
 SELECT regexp_extract(lower(trim(url)), '^https?://([^/?#]*)', 1) AS host, count(*) AS n_pages,
  count(*) FILTER (rk = 1) AS n_first FROM fused WHERE rk <= 10 GROUP BY 1""",
    "candidates_v",
)
def shortlisted_pages_per_host(spark: SparkSession, sf: str) -> DataFrame:
    return (
        rank_fusion_pages(spark, sf)
        .groupBy(url_host("url").alias("host"))
        .agg(F.count("*").alias("n_pages"), F.count_if(F.col("rank") == 1).alias("n_first"))
    )


@query(
    f""", {fusion_sql('candidates_v')}
 SELECT entity_id, list_idx, pos, CAST(rk AS INTEGER) AS rank, url FROM fused""",
    "candidates_v",
)
def ranked_union(spark: SparkSession, sf: str) -> DataFrame:
    lists = view(spark, sf, "candidates_v")
    parts = [
        lists.filter(F.col("list_idx") == i).select("entity_id", "pos", "url") for i in range(3)
    ]
    return union_ranked(parts).select("entity_id", "list_idx", "pos", "rank", "url")


@query(
    f""", {fusion_sql('candidates_v')}
 SELECT entity_id, count(*) AS n, string_agg(concat(CAST(rk AS VARCHAR), '=', url), '|' ORDER BY rk)
  AS listed FROM fused WHERE rk <= 10 GROUP BY entity_id""",
    "candidates_v",
)
def shortlists(spark: SparkSession, sf: str) -> DataFrame:
    fused = fuse_ranked_lists(view(spark, sf, "candidates_v"))
    lists = collect_shortlist(fused, columns=("title", "url"))
    item = F.transform(
        "candidates", lambda c: F.concat(c["rank"].cast("string"), F.lit("="), c["url"])
    )
    return lists.select(
        "entity_id",
        F.size("candidates").cast("long").alias("n"),
        F.array_join(item, "|").alias("listed"),
    )


@query(
    f""", {fusion_sql('candidates_v')}
 SELECT f.entity_id, CAST(rk - 1 AS INTEGER) AS pos, f.title, f.url,
  CASE WHEN length(content) > 500 THEN concat(substr(content, 1, 500), '...') ELSE content END
   AS content, f.entity_id AS school_name, 'D' AS district_name, '' AS county_name
 FROM fused AS f JOIN page_v USING (page_id) WHERE rk <= 10""",
    "candidates_v",
)
def payload_fields(spark: SparkSession, sf: str) -> DataFrame:
    fused = fuse_ranked_lists(view(spark, sf, "candidates_v"))
    opening = truncate_content("content").alias("content")
    texts = view(spark, sf, "page_v").select("page_id", opening)
    lists = collect_shortlist(fused.join(texts, "page_id"))
    entity = F.struct(
        F.col("entity_id").alias("name"),
        F.lit("D").alias("district"),
        *[F.lit("").alias(c) for c in ("county", "city", "state")],
    )
    parsed = F.from_json(
        "payload",
        "school struct<district_name:string,county_name:string,city:string,state:string,"
        "school_name:string>, "
        "candidates array<struct<title:string,url:string,content:string>>",
    )
    body = build_payload(lists.withColumn("entity", entity)).select(
        "entity_id", parsed.alias("p")
    )
    return body.select(
        "entity_id",
        F.posexplode("p.candidates").alias("pos", "c"),
        "p.school.school_name",
        "p.school.district_name",
        "p.school.county_name",
    ).select("entity_id", "pos", "c.*", "school_name", "district_name", "county_name")


def norm_sql(c: str) -> str:
    r"""Oracle form of ``phrase_form`` with a blank at both ends."""
    words = f"regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    return f"concat(' ', trim({words}), ' ')"


def asked_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """The queries of ``phrase_queries_v`` in the form that retrieval takes."""
    return view(spark, sf, "phrase_queries_v").select(
        "query_id",
        "must_phrase",
        F.array().cast("array<string>").alias("any_phrases"),
        F.array("term_a", "term_b").alias("should_terms"),
    )


def phrases_sql(docs: str) -> str:
    """Oracle form of phrase retrieval over rows (doc_id, body)."""
    return f""", docs AS ({docs}),
 asked AS (SELECT query_id, {norm_sql('must_phrase')} AS must, {norm_sql('term_a')} AS a,
  {norm_sql('term_b')} AS b FROM phrase_queries_v),
 matched AS (SELECT query_id, doc_id,
   CAST(trim(a) <> '' AND contains(body, a) AS INTEGER)
   + CAST(trim(b) <> '' AND b <> a AND contains(body, b) AS INTEGER) AS score
  FROM asked JOIN docs ON trim(must) <> '' AND contains(body, must)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM matched)
 SELECT query_id, doc_id, CAST(score AS BIGINT) AS score, CAST(rank AS INTEGER) AS rank
 FROM ranked WHERE rank <= 10"""


_PHRASES_SQL = phrases_sql(f"SELECT doc_id, {norm_sql('text')} AS body FROM documents")
#: Given as a host and as an address of one.
_SITES = ("src1.example.org", "https://SRC2.example.org/en/")


@query(_PHRASES_SQL, "phrase_queries_v")
def phrase_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieve(asked_phrases(spark, sf), table(spark, sf, "documents"))
    return found.select("query_id", "doc_id", "score", "rank")


@query(_PHRASES_SQL, "phrase_queries_v")
def indexed_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a stored index of the documents."""
    path = scratch_path(spark, "page-index")
    index = build_index(table(spark, sf, "documents"), path, title=None, url=None, content="text")
    return retrieve_indexed(asked_phrases(spark, sf), index).select("query_id", "doc_id", "score", "rank")


@query(
    phrases_sql(
        f"""SELECT doc_id, {norm_sql('content')} AS body FROM e1_corpus_v
  WHERE regexp_matches(url, '^https://([^/]+[.])?src[12][.]example[.]org/')"""
    ),
    "phrase_queries_v",
    "e1_corpus_v",
)
def site_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of two sites only; the cut to the best ones comes after."""
    corpus = view(spark, sf, "e1_corpus_v")
    found = retrieve(asked_phrases(spark, sf), corpus, fields=("content",), sites=_SITES)
    return found.select("query_id", "doc_id", "score", "rank")


def best_sql(rows: str, name: str, district: str) -> str:
    """Oracle form of the selection rules over rows with ``rk``, title, url, emails, phones."""
    specific = f"{share_sql(name, 'title', 'url')} >= {V.SPECIFIC_SHARE}"
    return f"""scored AS (SELECT entity_id, rk, {sanitize_sql('url')} AS clean_url,
  {staff_sql('title', 'url')} AS staff, regexp_matches(lower(url), '{V.DIRECTORY_SLUG_PATTERN}')
   AS slug, {specific} AS specific, NOT ({specific})
   AND {share_sql(district, 'title', 'url')} >= {V.SPECIFIC_SHARE} AS area,
  emails > 0 AS email, phones > 0 AS phone, {class_sql('title', 'url')} = 'candidate'
   AND {sanitize_sql('url')} IS NOT NULL AS eligible FROM {rows}),
placed AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY eligible DESC,
  specific DESC, area DESC, email DESC, phone DESC, slug DESC, staff DESC, rk) AS place
 FROM scored),
best AS (SELECT entity_id, CASE WHEN eligible THEN clean_url ELSE 'NOT_FOUND' END AS url,
  CASE WHEN eligible AND staff AND specific AND email THEN 'high'
   WHEN eligible AND staff AND (specific OR email) THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN eligible THEN concat_ws('; ', concat('candidate ', CAST(rk AS VARCHAR)),
    CASE WHEN specific THEN 'names the entity' WHEN area THEN 'names the district only' END,
    CASE WHEN email THEN 'lists e-mail' END, CASE WHEN phone THEN 'lists phone' END,
    CASE WHEN slug THEN 'directory address' END, CASE WHEN staff THEN 'staff term' END)
   ELSE '{V.REASON_NO_ELIGIBLE}' END AS reasoning FROM placed WHERE place = 1)"""


@query(
    f""", {fusion_sql('candidates_v')},
 names AS (SELECT host AS entity_id, min(title) AS name FROM page_v GROUP BY host),
 shown AS (SELECT f.entity_id, f.rk, f.title, f.url, n.name,
   {count_sql('p.content', V.EMAIL_PATTERN)} AS emails,
   {count_sql('p.content', V.PHONE_PATTERN)} AS phones
  FROM fused AS f JOIN page_v AS p USING (page_id) JOIN names AS n ON n.entity_id = f.entity_id
  WHERE f.rk <= 10),
 {best_sql('shown', 'name', 'entity_id')} SELECT * FROM best""",
    "candidates_v",
)
def best_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = view(spark, sf, "page_v")
    entities = pages.groupBy(F.col("host").alias("entity_id")).agg(F.min("title").alias("name"))
    fields = F.struct("name", F.col("entity_id").alias("district"))
    entities = entities.select("entity_id", fields.alias("entity"))
    fused = fuse_ranked_lists(view(spark, sf, "candidates_v")).join(entities, "entity_id")
    return select_by_tiers(fused, contacts_of(pages, "page_id"), "page_id")


@query(
    f"""WITH lists AS (SELECT c_nationkey AS doc_id,
  concat(string_agg(c_name, ', '), ' - ', min(n_name)) AS names
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_nationkey),
 docs AS (SELECT doc_id, {norm_sql('names')} AS body FROM lists)
 SELECT c_custkey AS query_id, CAST(doc_id AS BIGINT) AS doc_id,
  CAST(contains(body, {norm_sql('n_name')}) AS BIGINT) AS score, CAST(1 AS INTEGER) AS rank
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN docs ON c_nationkey = doc_id
 WHERE contains(body, {norm_sql('c_name')})"""
)
def list_page_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """One page per nation names all its customers; every customer is searched for."""
    customers = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    pages = customers.groupBy(F.col("c_nationkey").alias("doc_id")).agg(
        F.array_join(F.collect_list("c_name"), ", ").alias("names"), F.min("n_name").alias("nation")
    )
    pages = pages.select("doc_id", F.concat_ws(" - ", "names", "nation").alias("text"))
    asked = customers.select(
        F.col("c_custkey").alias("query_id"),
        F.col("c_name").alias("must_phrase"),
        F.array().cast("array<string>").alias("any_phrases"),
        F.array("n_name").alias("should_terms"),
    )
    return retrieve(asked, pages).select(
        "query_id", F.col("doc_id").cast("long").alias("doc_id"), "score", "rank"
    )
