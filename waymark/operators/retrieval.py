"""Phrase retrieval: match a table of structured queries against a corpus.

A query is (query_id, must_phrase, any_phrases, should_terms).  A page matches
when it contains ``must_phrase`` and, if any are given, one of ``any_phrases``;
containment is on whole words of the phrase form and never across fields.
Score = distinct ``should_terms`` contained, plus 1 if ``must_phrase`` is in
the title.  The ``top_n`` pages by (score desc, id asc) are kept per query.

How it runs
-----------
The corpus is read once and only narrow (page, phrase) hits leave the scan.
All phrases of all queries form one dictionary.  A word that begins phrases is
known with their lengths, so the page's words of each such length are looked up
as one whole phrase: one equi-join on a unique key.  A dictionary measured to be
small is broadcast; a larger one is joined by shuffle on hashes of the phrases, after
a filter sized by the counted dictionary has dropped nearly all that is no phrase
(``phrase_filter``).  ``sources.page_index`` answers the same question from a stored index.

Queries are then grouped before they meet pages.  Queries with the same
content are one *spec*; specs with the same match condition (must, any) are
one *class*.  Hits stay rows of (page, phrase); which terms of its class a page contains is an
equi-join that starts from the rarer side (``_contained``).  Pages of a class that contain the same should-terms score alike
for every spec, so only the first ``top_n`` ids of each such set are carried
on - an exact cut, applied before the shuffle.  A second exact cut keeps ``top_n`` pages for each
set of terms that specs share (``_by_subset``).  A name shared by a third of the
queries and found in a third of the pages therefore never yields its product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark import fixed_values as V
from waymark.functions.text import phrase_form
from waymark.functions.urls import on_sites
from waymark.operators import phrase_filter
from waymark.session import materialize

FIELD_BREAK = "|"  # never part of a phrase form
BROADCAST_BYTES = 256 * 1024 * 1024
# A filter in front of a large dictionary may take this much even where less may be broadcast.
FILTER_BYTES = 64 * 1024 * 1024
# Specs of more should-terms are scored term by term.
_SUBSET_TERMS = 5


def _top(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def _phrases(c: Column) -> Column:
    """Sorted distinct non-empty phrase forms of an array."""
    forms = F.transform(F.coalesce(c, F.array()), phrase_form)
    return F.array_sort(F.array_distinct(F.filter(forms, lambda p: p != "")))


def _digest(*cols: str) -> Column:
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def query_content(queries: DataFrame) -> DataFrame:
    """Add normal ``must``, ``any``, ``should`` and the digests ``class_id``, ``spec_id``.

    Queries that cannot match (blank must-phrase, or only blank alternatives)
    are dropped.
    """
    asked = F.size(F.coalesce("any_phrases", F.array()))
    content = queries.select(
        "*",
        phrase_form("must_phrase").alias("must"),
        _phrases(F.col("any_phrases")).alias("any"),
        _phrases(F.col("should_terms")).alias("should"),
    ).filter((F.col("must") != "") & ((asked == 0) | (F.size("any") > 0)))
    return content.withColumn("class_id", _digest("must", "any")).withColumn(
        "spec_id", _digest("must", "any", "should")
    )


def phrase_dictionary(specs: DataFrame) -> DataFrame:
    """Distinct phrases: word count, first word, is it a must-phrase, is it another."""
    others = F.explode(F.array_union("any", "should"))
    phrases = specs.select(F.col("must").alias("phrase"), F.lit(True).alias("is_must")).unionByName(
        specs.select(others.alias("phrase"), F.lit(False).alias("is_must"))
    )
    n_words = F.size(F.split("phrase", " "))
    return (
        phrases.groupBy("phrase")
        .agg(F.max("is_must").alias("is_must"), (~F.min("is_must")).alias("is_other"))
        .select(
            "phrase",
            "is_must",
            "is_other",
            n_words.alias("n_words"),
            F.substring_index("phrase", " ", 1).alias("word"),
        )
    )


def page_tokens(corpus: DataFrame, doc_id: str, title: str | None, fields: Sequence[str]) -> DataFrame:
    """(doc, tokens, title_words): a page's words in order, the title's first."""

    def field_words(c: str) -> Column:
        return F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{N}]+")

    names = [title, *fields] if title else list(fields)
    parts = [field_words(names[0])]
    for name in names[1:]:
        parts += [F.array(F.lit(FIELD_BREAK)), field_words(name)]
    return corpus.select(
        F.col(doc_id).alias("doc"),
        (F.concat(*parts) if len(parts) > 1 else parts[0]).alias("tokens"),
        (F.size(field_words(title)) if title else F.lit(0)).alias("title_words"),
    )


def page_positions(
    corpus: DataFrame, doc_id: str, title: str | None, fields: Sequence[str]
) -> DataFrame:
    """(doc, tokens, title_words, i, word) for every word position of a page.

    The outer form of explode keeps Spark from adding an "array is not empty"
    filter that would split every text a second time.
    """
    return page_tokens(corpus, doc_id, title, fields).select(
        "doc",
        "tokens",
        "title_words",
        F.posexplode_outer("tokens").alias("i", "word"),
    )


def stored_bytes(phrase: str) -> Column:
    """Generous size of a broadcast row that holds the text up to three times."""
    return 3 * F.octet_length(phrase) + 96


def phrase_hits(
    corpus: DataFrame,
    specs: DataFrame,
    doc_id: str,
    title: str | None,
    fields: Sequence[str],
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(doc, phrase, is_must, is_other, in_title): each dictionary phrase a page contains, once.

    All lookups run in the scan's own stage, so the token array is never copied; if the dictionary
    is too large to broadcast, hashes of the phrases leave the scan, never text.
    """
    dictionary = phrase_dictionary(specs)
    heads = dictionary.groupBy("word").agg(F.collect_set("n_words").alias("lengths"))
    # One row of measurements decides the join strategy.
    size = dictionary.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(stored_bytes("phrase")), F.lit(0)).alias("phrases"),
        F.coalesce(F.sum(stored_bytes("word")), F.lit(0)).alias("heads"),
        F.array_sort(F.collect_set("n_words")).alias("lengths"),
    ).first()
    positions = page_positions(corpus, doc_id, title, fields)
    if size["heads"] <= broadcast_bytes:
        headed = positions.join(F.broadcast(heads), "word")
    else:
        headed = positions.withColumn("lengths", F.array(*[F.lit(n) for n in size["lengths"]]))
    in_title = (F.col("i") < F.col("title_words")).alias("in_title")
    grams = headed.select("doc", "tokens", "i", in_title, F.explode("lengths").alias("n_words")).select(
        "doc",
        "in_title",
        F.array_join(F.slice("tokens", F.col("i") + 1, F.col("n_words")), " ").alias("phrase"),
    )
    lookup = dictionary.select("phrase", "is_must", "is_other")
    if size["phrases"] <= broadcast_bytes:
        found = grams.join(F.broadcast(lookup), "phrase")
    else:
        blocks = phrase_filter.block_count(size["n"])
        if blocks * phrase_filter.BLOCK_BYTES <= max(broadcast_bytes, FILTER_BYTES):
            bloom = materialize(phrase_filter.build(dictionary, blocks), "phrase-filter")
            grams = phrase_filter.likely(grams, bloom, blocks)
        names = [F.xxhash64("phrase").alias("h1"), F.xxhash64("phrase", F.lit(7)).alias("h2")]
        hashed = grams.select("doc", "in_title", *names)
        found = hashed.join(lookup.select("*", *names), ["h1", "h2"])
    return distinct_hits(found)


def distinct_hits(found: DataFrame) -> DataFrame:
    """Occurrences of phrases in pages, each phrase once a page."""
    flags = [F.max(c).alias(c) for c in ("is_must", "is_other", "in_title")]
    return found.groupBy("doc", "phrase").agg(*flags)


def retrieve(
    queries: DataFrame,
    corpus: DataFrame,
    top_n: int = V.MAX_CANDIDATES,
    doc_id: str = "doc_id",
    title: str | None = None,
    fields: Sequence[str] = ("text",),
    broadcast_bytes: int = BROADCAST_BYTES,
    sites: Sequence[str] | None = None,
    url: str = "url",
) -> DataFrame:
    """Top pages per query: ``queries`` columns plus ``doc_id``, ``score``, ``rank`` from 1.

    With ``sites`` only pages whose ``url`` is on one of them count (see ``functions.urls.on_sites``), before any is ranked.
    """
    if top_n < 1:
        raise ValueError("top_n must be at least 1")
    if sites:
        corpus = corpus.where(on_sites(url, sites))
    content = query_content(queries)
    specs = content.select("spec_id", "class_id", "must", "any", "should").distinct()
    ranked = retrieve_specs(specs, corpus, top_n, doc_id, title, fields, broadcast_bytes)
    return content.join(ranked, "spec_id").select(*queries.columns, doc_id, "score", "rank")


def retrieve_specs(
    specs: DataFrame,
    corpus: DataFrame,
    top_n: int,
    doc_id: str,
    title: str | None,
    fields: Sequence[str],
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(spec_id, doc_id, score, rank) for distinct query specs.

    The specs are written once: several steps below read them, and as a stored
    table they have a known size for Spark's own choice of join.
    """
    specs = materialize(specs, "query-specs")
    hits = phrase_hits(corpus, specs, doc_id, title, fields, broadcast_bytes)
    return rank_hits(specs, hits, top_n, doc_id)


def rank_hits(specs: DataFrame, hits: DataFrame, top_n: int, doc_id: str) -> DataFrame:
    """(spec_id, doc_id, score, rank) from stored specs and the phrases that pages contain."""
    hits = materialize(hits, "page-hits")
    classes = specs.select("class_id", "must", "any").distinct()
    members = hits.where("is_must").join(classes, hits["phrase"] == classes["must"]).select(
        "class_id", "doc", F.col("in_title").cast("int").alias("bonus"), (F.size("any") > 0).alias("chooses")
    )
    members = materialize(members, "class-pages")
    pairs = (
        classes.select("class_id", F.explode("any").alias("term"), F.lit(True).alias("is_any"), F.lit(False).alias("is_should"))
        .unionByName(specs.select("class_id", F.explode("should").alias("term"), F.lit(False).alias("is_any"), F.lit(True).alias("is_should")))
        .groupBy("class_id", "term")
        .agg(F.max("is_any").alias("is_any"), F.max("is_should").alias("is_should"))
    )
    others = hits.where("is_other").select("doc", F.col("phrase").alias("term"))
    profile = F.array_sort(F.collect_list(F.when(F.col("is_should"), F.col("term")))).alias("profile")
    have = _contained(members, pairs, others).groupBy("class_id", "doc").agg(profile, F.max("is_any").alias("chosen"))
    # Which of its class's should-terms each page contains.
    profiles = (
        members.join(have, ["class_id", "doc"], "left")
        .where(~F.col("chooses") | F.coalesce("chosen", F.lit(False)))
        .select("class_id", "doc", "bonus", F.coalesce("profile", F.array().cast("array<string>")).alias("profile"))
    )
    doc_first = [F.col("doc")]
    alike = _top(profiles, ["class_id", "profile", "bonus"], doc_first, top_n).drop("rank")
    few = specs.filter(F.size("should") <= _SUBSET_TERMS)
    many = specs.filter(F.size("should") > _SUBSET_TERMS).select(
        "class_id", "spec_id", F.explode("should").alias("term")
    )
    by_term = (
        alike.select("class_id", "doc", "bonus", F.explode("profile").alias("term"))
        .join(many, ["class_id", "term"])
        .groupBy("spec_id", "doc")
        .agg(F.max("bonus").alias("bonus"), F.count("*").alias("found"))
    )
    # Pages without any should-term can only place by the title bonus.
    by_bonus = [F.desc("bonus"), *doc_first]
    plain = _top(alike, ["class_id"], by_bonus, top_n)
    by_class = plain.join(specs.select("class_id", "spec_id"), "class_id").select(
        "spec_id", "doc", "bonus", F.lit(0).cast("long").alias("found")
    )
    scored = (
        by_term.unionByName(_by_subset(few, alike, by_bonus, top_n))
        .unionByName(by_class)
        .groupBy("spec_id", "doc")
        .agg((F.max("bonus") + F.max("found")).alias("score"))
    )
    best = _top(scored, ["spec_id"], [F.desc("score"), *doc_first], top_n)
    return best.select("spec_id", F.col("doc").alias(doc_id), "score", "rank")


def _contained(members: DataFrame, pairs: DataFrame, others: DataFrame) -> DataFrame:
    """(class_id, doc, term, is_any, is_should): the terms of a class that its member pages contain.

    Each pair of class and term starts from whichever is rarer, the pages of the class or the pages with the term, and the
    other side is looked up by a key that is unique there.  So a page that names many entities, or a name that many
    pages hold, costs the smaller of the two and never the product of a page's names and terms.
    """
    per_class = members.groupBy("class_id").agg(F.count("*").alias("of_class"))
    per_term = others.groupBy("term").agg(F.count("*").alias("of_term"))
    sized = materialize(pairs.join(per_class, "class_id").join(per_term, "term"), "class-terms")
    columns = ["class_id", "doc", "term", "is_any", "is_should"]
    rare_class = sized.where("of_class <= of_term").join(members.select("class_id", "doc"), "class_id")
    rare_term = sized.where("of_class > of_term").join(others, "term")
    return (
        rare_class.select(columns).join(others, ["doc", "term"], "left_semi").select(columns)
        .unionByName(rare_term.select(columns).join(members, ["class_id", "doc"], "left_semi").select(columns))
    )


def _by_subset(
    specs: DataFrame, pages: DataFrame, order: Sequence[Column], top_n: int
) -> DataFrame:
    """(spec_id, doc, bonus, found) of pages that can place for specs of few should-terms.

    A page that has exactly the terms M of a spec's should-terms ranks behind the first
    ``top_n`` pages, by bonus and id, that have all of M.  So those are kept for each set of terms that is part of some
    spec of the class, and meet the specs afterwards: a class of many specs never yields
    pages times specs.  A set is looked up by the term that the fewest sets of its class have.
    """
    parts = "filter(should, (t, i) -> (shiftright(m, i) & 1) = 1)"
    every = F.expr(f"transform(sequence(1, shiftleft(1, size(should)) - 1), m -> {parts})")
    sets = specs.filter(F.size("should") > 0).select(
        "class_id", "spec_id", F.explode(every).alias("subset")
    )
    distinct = sets.select("class_id", "subset").distinct()
    terms = distinct.select("class_id", "subset", F.explode("subset").alias("term"))
    uses = terms.groupBy("class_id", "term").agg(F.count("*").alias("uses"))
    rarest = F.min_by("term", F.struct("uses", "term")).alias("term")
    leads = terms.join(uses, ["class_id", "term"]).groupBy("class_id", "subset").agg(rarest)
    have = (
        pages.select("class_id", "doc", "bonus", "profile", F.explode("profile").alias("term"))
        .join(leads, ["class_id", "term"])
        .filter(F.size(F.array_except("subset", "profile")) == 0)
        .select("class_id", "subset", "doc", "bonus")
    )
    first = _top(have, ["class_id", "subset"], order, top_n)
    found = F.size("subset").cast("long").alias("found")
    return first.join(sets, ["class_id", "subset"]).select("spec_id", "doc", "bonus", found)
