"""A stored positional index of a page corpus, built once and extended by new pages.

Layout under the index's folder:

- ``about``: one row, the number of buckets and the type of the page ids;
- ``postings``: (term, doc, title_words, at), ``at`` the sorted places of the term among the page's words; partitioned by
  batch and by hash bucket of the term, sorted by term, so a lookup reads the buckets and row groups of its terms only;
- ``pages``: what resolving needs of a page besides its words - title, URL, contact counts, cut content;
- ``batches``: the finished batches.  A batch whose writing was interrupted is not listed and never read.

A page's postings are made where it is read; Spark then rebalances the buckets by size, so a frequent word's postings
spread over as many tasks and files as they fill.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import fixed_values as V
from waymark.functions.pages import DEFAULT_RULES, PageRules
from waymark.functions.text import truncate_content
from waymark.functions.urls import on_sites
from waymark.operators.retrieval import (
    BROADCAST_BYTES,
    FIELD_BREAK,
    distinct_hits,
    page_positions,
    page_tokens,
    phrase_dictionary,
    query_content,
    rank_hits,
    stored_bytes,
)
from waymark.operators.selection import contact_columns
from waymark.session import materialize

BUCKETS = 64


class PageIndex(NamedTuple):
    """An opened index: its finished batches as they were when it was opened."""

    path: str
    buckets: int
    postings: DataFrame
    pages: DataFrame


def _bucket(c: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int").alias("bucket")


def build_index(
    corpus: DataFrame,
    path: str,
    doc_id: str = "doc_id",
    title: str | None = "title",
    url: str | None = "url",
    content: str = "content",
    buckets: int = BUCKETS,
    rules: PageRules = DEFAULT_RULES,
    max_chars: int = V.MAX_CONTENT_CHARS,
) -> PageIndex:
    """Index a corpus with unique page ids under a new folder."""
    spark = corpus.sparkSession
    kind = corpus.schema[doc_id].dataType.simpleString()
    about = spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(kind).alias("doc_type"))
    about.write.parquet(f"{path}/about")
    return _add_batch(corpus, path, buckets, doc_id, title, url, content, rules, max_chars)


def extend_index(
    corpus: DataFrame,
    path: str,
    doc_id: str = "doc_id",
    title: str | None = "title",
    url: str | None = "url",
    content: str = "content",
    rules: PageRules = DEFAULT_RULES,
    max_chars: int = V.MAX_CONTENT_CHARS,
) -> PageIndex:
    """Add the pages whose ids are not in the index yet; the others keep their first version.

    Only the new pages are read in full.  One writer at a time may extend an index.
    """
    index = open_index(corpus.sparkSession, path)
    new = corpus.join(index.pages.select(F.col("doc").alias(doc_id)), doc_id, "left_anti")
    return _add_batch(new, path, index.buckets, doc_id, title, url, content, rules, max_chars)


def _postings(corpus: DataFrame, doc_id: str, title: str | None, fields: Sequence[str]) -> DataFrame:
    """(term, doc, title_words, at): a page's words are put together where the page is read.

    Pages that share an id are one page to the index; only their words meet in a shuffle.
    """
    ids = corpus.groupBy(F.col(doc_id)).agg(F.count("*").alias("_pages")).where("_pages > 1").select(doc_id)
    shared = materialize(ids, "shared-ids")
    if shared.isEmpty():
        return _page_postings(corpus, doc_id, title, fields)
    words = page_positions(corpus.join(shared, doc_id, "left_semi"), doc_id, title, fields)
    merged = words.where(~F.col("word").isin("", FIELD_BREAK)).groupBy(F.col("word").alias("term"), "doc").agg(
        F.first("title_words").alias("title_words"), F.array_sort(F.collect_list("i")).alias("at")
    )
    alone = _page_postings(corpus.join(shared, doc_id, "left_anti"), doc_id, title, fields)
    return alone.unionByName(merged)


def _page_postings(corpus: DataFrame, doc_id: str, title: str | None, fields: Sequence[str]) -> DataFrame:
    """The same for unique ids, without a shuffle: the sorted words of a page, cut where the word changes."""
    tokens = page_tokens(corpus, doc_id, title, fields)
    # The outer forms of explode and one column a step keep each array from being built twice.
    words = F.filter(F.transform("tokens", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda t: ~t["w"].isin("", FIELD_BREAK))
    pages = tokens.select("doc", "title_words", F.sort_array(words).alias("words"))
    starts = "filter(transform(words, (t, i) -> i), i -> i = 0 or words[i].w <> words[i - 1].w)"
    runs = pages.select("*", F.expr(starts).alias("starts")).select(
        "doc", "title_words", "words", "starts", F.posexplode_outer("starts").alias("n", "start")
    )
    size = F.expr("if(n + 1 < size(starts), starts[n + 1], size(words)) - start")
    run = F.slice("words", F.col("start") + 1, size).alias("run")
    cut = runs.where("start is not null").select("doc", "title_words", run)
    return cut.select(F.expr("run[0].w").alias("term"), "doc", "title_words", F.col("run.i").alias("at"))


def _add_batch(corpus, path, buckets, doc_id, title, url, content, rules, max_chars) -> PageIndex:
    spark, batch = corpus.sparkSession, uuid.uuid4().hex
    corpus = corpus.where(F.col(doc_id).isNotNull())
    fields = [c for c in (url, content) if c]
    postings = _postings(corpus, doc_id, title, fields)
    dealt = postings.withColumn("bucket", _bucket("term", buckets)).hint("rebalance", "bucket")
    dealt.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")
    empty = F.lit(None).cast("string")
    pages = contact_columns(corpus, content, rules).select(
        F.col(doc_id).alias("doc"),
        (F.col(title) if title else empty).alias("title"),
        (F.col(url) if url else empty).alias("url"),
        "emails",
        "phones",
        truncate_content(content, max_chars).alias("content"),
    )
    dealt = pages.withColumn("bucket", _bucket("doc", buckets)).hint("rebalance", "bucket")
    dealt.write.partitionBy("bucket").parquet(f"{path}/pages/batch={batch}")
    # Listed last: from here on the batch counts.
    spark.range(1).select(F.lit(batch).alias("batch")).write.mode("append").parquet(f"{path}/batches")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> PageIndex:
    """The index as far as its batches are finished."""
    about = spark.read.parquet(f"{path}/about").first()
    batches = [r["batch"] for r in spark.read.parquet(f"{path}/batches").collect()]

    def read(name: str, columns: str) -> DataFrame:
        schema = f"{columns}, batch string, bucket int"
        found = [f"{path}/{name}/batch={b}" for b in batches]
        return spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(*found).drop("batch")

    kind = about["doc_type"]
    postings = read("postings", f"term string, doc {kind}, title_words int, at array<int>")
    pages = read("pages", f"doc {kind}, title string, url string, emails int, phones int, content string")
    return PageIndex(path, about["buckets"], postings, pages)


def _wanted_buckets(keys: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets (of a fixed number) in which the keys lie."""
    return sorted(r[0] for r in keys.select(_bucket(key, buckets)).distinct().collect())


def pages_of(index: PageIndex, ids: DataFrame) -> DataFrame:
    """The pages of a stored table of ids (column ``doc``)."""
    wanted = _wanted_buckets(ids, "doc", index.buckets)
    pages = index.pages.where(F.col("bucket").isin(wanted)).drop("bucket")
    return pages.join(ids.select("doc").distinct(), "doc", "left_semi")


def indexed_hits(specs: DataFrame, index: PageIndex, sites: Sequence[str] | None = None) -> DataFrame:
    """The same rows as ``phrase_hits``, from the index: no page is read, with ``sites`` only the URLs stored beside it.

    A phrase is looked up by its rarest word; its other words are then looked up by (word, page) where that one
    occurs, and must stand at their places.  So a phrase costs the postings of its rarest word, however common the others are.
    """
    dictionary = materialize(phrase_dictionary(specs), "dictionary")
    words = dictionary.select("phrase", F.posexplode(F.split("phrase", " ")).alias("offset", "term"))
    wanted = _wanted_buckets(words, "term", index.buckets)
    postings = index.postings.where(F.col("bucket").isin(wanted)).drop("bucket")
    terms = materialize(words.select("term").distinct(), "terms")
    size = terms.agg(F.coalesce(F.sum(stored_bytes("term")), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        # other words leave the lookups below in the scan, not after a shuffle
        postings = postings.join(F.broadcast(terms), "term", "left_semi")
    counts = postings.groupBy("term").agg(F.count("*").alias("pages")).join(terms, "term", "left_semi")
    lead = F.min_by(F.struct("term", "offset"), F.struct("pages", "offset")).alias("lead")
    leads = (
        words.join(materialize(counts, "term-counts"), "term")
        .groupBy("phrase")
        .agg(F.count("*").alias("known"), lead)
        .join(dictionary, "phrase")
        .where("known = n_words")
        .select("phrase", "is_must", "is_other", "n_words", "lead.term", "lead.offset")
    )
    leads = materialize(leads, "leads")
    flags = ["phrase", "doc", "is_must", "is_other"]
    starts = (
        leads.join(postings, "term")
        .select(*flags, "title_words", "n_words", "offset", F.explode("at").alias("at"))
        .withColumn("start", F.col("at") - F.col("offset"))
        .where("start >= 0")
        .withColumn("in_title", F.col("start") < F.col("title_words"))
        .select(*flags, "in_title", "n_words", "offset", "start")
    )
    starts = materialize(starts, "phrase-starts")
    # The words around the rarest one, each where it would have to stand.
    rest = (
        starts.where("n_words > 1")
        .select("*", F.posexplode(F.split("phrase", " ")).alias("o", "term"))
        .where("o <> offset")
        .withColumn("place", F.col("start") + F.col("o"))
    )
    rest = rest.join(postings.select("term", "doc", "at"), ["term", "doc"]).where(F.array_contains("at", F.col("place")))
    whole = rest.groupBy(*flags, "in_title", "n_words", "start").agg(F.count("*").alias("found"))
    columns = [*flags, "in_title"]
    hits = distinct_hits(starts.where("n_words = 1").select(columns).unionByName(whole.where("found = n_words - 1").select(columns)))
    return hits.join(index.pages.where(on_sites("url", sites)).select("doc"), "doc", "left_semi") if sites else hits


def retrieve_indexed(
    queries: DataFrame,
    index: PageIndex,
    top_n: int = V.MAX_CANDIDATES,
    doc_id: str = "doc_id",
    sites: Sequence[str] | None = None,
) -> DataFrame:
    """``operators.retrieval.retrieve`` over an index: ``queries`` columns plus the page id, ``score``, ``rank``."""
    if top_n < 1:
        raise ValueError("top_n must be at least 1")
    content = query_content(queries)
    specs = materialize(content.select("spec_id", "class_id", "must", "any", "should").distinct(), "query-specs")
    ranked = rank_hits(specs, indexed_hits(specs, index, sites), top_n, doc_id)
    return content.join(ranked, "spec_id").select(*queries.columns, doc_id, "score", "rank")
