"""Phrase retrieval against brute force, on small random and on skewed input."""

import json
import os
import random
import re
import shutil
import subprocess
import sys
import tempfile
from pathlib import Path

import pytest

from waymark.operators.retrieval import retrieve

WORDS = "lincoln high school staff directory portland tx oak the of".split()
SCHEMA = "query_id int, must_phrase string, any_phrases array<string>, should_terms array<string>"


def norm(text):
    return " " + " ".join(re.findall(r"[^\W_]+", (text or "").lower())) + " "


def brute_force(queries, docs, n):
    out = set()
    for qid, must, anys, shoulds in queries:
        scored = []
        for doc, title, text in docs:
            fields = [norm(title), norm(text)]

            def has(p, fields=fields):
                return norm(p).strip() != "" and any(norm(p) in f for f in fields)

            if has(must) and (not anys or any(has(a) for a in anys)):
                score = len({norm(s) for s in shoulds or [] if has(s)}) + (norm(must) in fields[0])
                scored.append((-score, doc))
        out |= {(qid, doc, -s, i + 1) for i, (s, doc) in enumerate(sorted(scored)[:n])}
    return out


def phrase(rng, longest):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, longest)))


def random_case(seed, n_docs=150, n_queries=40):
    rng = random.Random(seed)
    docs = [
        (i, phrase(rng, 3) if rng.random() < 0.7 else None, phrase(rng, 40).replace(" of ", ", OF-"))
        for i in range(n_docs)
    ]
    queries = [
        (
            i,
            phrase(rng, 5).title(),
            [phrase(rng, 2) for _ in range(rng.randint(0, 2))],
            [phrase(rng, 2) for _ in range(rng.randint(0, 3))] or None,
        )
        for i in range(n_queries)
    ]
    queries += [(900, " - ", [], []), (901, "oak", ["&"], []), (902, "Oak!", None, ["the", "THE"])]
    return queries, docs


def found(spark, queries, docs, n, **options):
    q = spark.createDataFrame(queries, SCHEMA)
    d = spark.createDataFrame(docs, "doc_id int, title string, text string")
    rows = retrieve(q, d, n, title="title", **options).collect()
    return {(r.query_id, r.doc_id, r.score, r["rank"]) for r in rows}


@pytest.mark.parametrize("seed,n,limit", [(1, 3, 1 << 20), (2, 10, 1 << 20), (3, 3, 0), (4, 5, 6000)])
def test_equals_brute_force(spark, seed, n, limit):
    queries, docs = random_case(seed)
    got = found(spark, queries, docs, n, broadcast_bytes=limit)
    assert got == brute_force(queries, docs, n)
    assert got


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_hot_phrase_in_queries_and_pages(spark, limit):
    """A name shared by most queries and found in most pages stays exact."""
    rng = random.Random(5)
    docs = [(i, None, f"washington elementary {phrase(rng, 3)}") for i in range(400)]
    queries = [
        (i, "Washington Elementary", [], [rng.choice(WORDS), rng.choice(WORDS)]) for i in range(60)
    ]
    assert found(spark, queries, docs, 4, broadcast_bytes=limit) == brute_force(queries, docs, 4)


def test_fields_do_not_run_together(spark):
    docs = [(1, "lincoln", "high school"), (2, "x", "lincoln high")]
    assert {r[1] for r in found(spark, [(1, "lincoln high", [], [])], docs, 5)} == {2}


def test_plan_never_shuffles_text(spark):
    q = spark.createDataFrame([(1, "oak", [], ["tx"])], SCHEMA)
    d = spark.createDataFrame([(1, "a", "oak tx")], "doc_id int, title string, text string")
    plan = retrieve(q, d, title="title")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan
    with pytest.raises(ValueError):
        retrieve(q, d, 0)


@pytest.mark.parametrize("limit", [1 << 24, 0])
def test_list_page_grows_with_its_names(spark, limit):
    """A page naming all entities: nothing is compared pairwise, and the result is exact."""
    def case(n):
        names = [f"school {i} of town{i % 7}" for i in range(n)]
        docs = [(1, "All schools", ", ".join(names)), (2, None, names[0])]
        return [(i, name, [], [f"town{i % 7}"]) for i, name in enumerate(names)], docs

    queries, docs = case(60)
    assert found(spark, queries, docs, 3, broadcast_bytes=limit) == brute_force(queries, docs, 3)
    from waymark.operators.retrieval import phrase_hits, query_content

    sizes = []
    for n in (100, 200):
        queries, docs = case(n)
        specs = query_content(spark.createDataFrame(queries, SCHEMA))
        d = spark.createDataFrame(docs, "doc_id int, title string, text string")
        hits = phrase_hits(d, specs, "doc_id", "title", ("text",), limit).where("doc = 1")
        sizes.append((hits.where("is_must").count(), hits.where("is_other").count()))
    assert sizes == [(100, 7), (200, 7)]


def shuffled_bytes(spark, run):
    """Bytes of every shuffle and stored table of a job, from Spark's event log."""
    folder = tempfile.mkdtemp(prefix="waymark-events-")
    settings = {
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": folder, "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "4", "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false",
        "spark.shuffle.compress": "false", "spark.sql.parquet.compression.codec": "uncompressed",
    }
    code = "from waymark.session import build_session\nfrom test_retrieval import *\n"
    code += f"spark = build_session('bytes', 'local[2]', **{settings!r})\n{run}\nspark.stop()\n"
    here = Path(__file__).parent
    env = {**os.environ, "PYTHONPATH": f"{here.parent}:{here}"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=here, env=env, capture_output=True, timeout=600)
    total = 0
    for file in Path(folder).iterdir():
        for line in file.open():
            event = json.loads(line)
            if event["Event"] == "SparkListenerTaskEnd":
                metrics = event["Task Metrics"]
                total += metrics["Shuffle Write Metrics"]["Shuffle Bytes Written"]
                total += metrics["Output Metrics"]["Bytes Written"]
    return total


def list_page(spark, n):
    """One page that names n schools and their n cities; every school is asked for with its city."""
    names = [f"school {i} of town{i}" for i in range(n)]
    queries = [(i, name, [f"town{(i + 1) % n}"], [f"town{i}"]) for i, name in enumerate(names)]
    return len(found(spark, queries, [(1, "All schools", ", ".join(names))], 3))


def test_bytes_of_a_list_page_grow_no_faster_than_it(spark):
    assert list_page(spark, 20) == 20
    small, large = (shuffled_bytes(spark, f"assert list_page(spark, {n}) == {n}") for n in (1500, 3000))
    assert large <= 2.2 * small


def test_large_dictionary_never_shuffles_text(spark):
    q = spark.createDataFrame([(1, "oak high", [], ["tx"])], SCHEMA)
    d = spark.createDataFrame([(1, "a", "oak high tx")], "doc_id int, title string, text string")
    from waymark.operators.retrieval import phrase_hits, query_content

    hits = phrase_hits(d, query_content(q), "doc_id", "title", ("text",), 0)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join"):].splitlines()
    sides = [line for line in join if "Project [doc" in line]
    assert sides and "text" not in sides[0] and "tokens" not in sides[0]
    assert {r.phrase for r in hits.collect() if r.is_must} == {"oak high"}


def test_filter_of_two_million_phrases(spark):
    """No phrase is lost, and under 1 % of what is no phrase passes; the filter is a table of counted size."""
    from pyspark.sql import functions as F

    from waymark.operators import phrase_filter

    phrases = spark.range(2_000_000).select(F.concat(F.lit("school "), "id").alias("phrase"))
    blocks = phrase_filter.block_count(2_000_000)
    bloom = phrase_filter.build(phrases, blocks)
    assert bloom.count() <= blocks == 62_500
    bloom = bloom.cache()
    assert phrase_filter.likely(phrases, bloom, blocks).count() == 2_000_000
    others = spark.range(1_000_000).select(F.concat(F.lit("other "), "id").alias("phrase"))
    assert phrase_filter.likely(others, bloom, blocks).count() < 10_000
    bloom.unpersist()


@pytest.mark.parametrize("seed,n", [(1, 3), (6, 10)])
def test_index_equals_brute_force(spark, tmp_path, seed, n):
    """Built of some pages, extended by the others; pages already indexed keep their first version."""
    from waymark.sources.page_index import build_index, extend_index, open_index, retrieve_indexed

    queries, docs = random_case(seed)
    queries.append((950, "new new york", [], ["new york"]))
    docs += [(1000, None, "new new york"), (1001, "new york", "new"), (1002, "new", "new york new")]
    path, schema = str(tmp_path / "index"), "doc_id int, title string, text string"
    options = {"url": None, "content": "text"}
    build_index(spark.createDataFrame(docs[:70], schema), path, buckets=5, **options)
    later = [*docs[50:], (3, "oak oak oak", "oak"), (None, "oak", "oak")]
    extend_index(spark.createDataFrame(later[20:], schema), path, **options)
    extend_index(spark.createDataFrame(later[:20], schema), path, **options)
    # What an interrupted batch has left is not read.
    half = spark.createDataFrame([("oak", 9999, 0, [0], 1)], "term string, doc int, title_words int, at array<int>, bucket int")
    half.write.partitionBy("bucket").parquet(f"{path}/postings/batch=unfinished")
    index = open_index(spark, path)
    got = retrieve_indexed(spark.createDataFrame(queries, SCHEMA), index, n).collect()
    got = {(r.query_id, r.doc_id, r.score, r["rank"]) for r in got}
    assert got == brute_force(queries, docs, n) and got


def test_index_answers_without_the_corpus(spark, tmp_path):
    """Two resolve calls on one index: the pages' own table is gone by then."""
    from waymark.plans.resolve import corpus_source, indexed_source, resolve
    from waymark.sources.page_index import build_index

    rng = random.Random(3)
    pages = [
        (i, f"Oak{i % 9} High staff directory", f"https://oak{i % 9}.org/staff/{i}", f"oak{i % 9} high {phrase(rng, 20)} a@b.org")
        for i in range(60)
    ]
    spark.createDataFrame(pages, "doc_id int, title string, url string, content string").write.parquet(f"{tmp_path}/pages")
    corpus = spark.read.parquet(f"{tmp_path}/pages")
    entities = spark.createDataFrame([(i, f"Oak{i} High", "Portland", "TX") for i in range(12)], "entity_id int, name string, city string, state string")
    want = sorted(resolve(entities, corpus_source(corpus)).collect())
    index = build_index(corpus, f"{tmp_path}/index")
    shutil.rmtree(tmp_path / "pages")
    for _ in range(2):
        assert sorted(resolve(entities, indexed_source(index)).collect()) == want
    assert {r.url == "NOT_FOUND" for r in want} == {True, False}


def test_index_of_nothing(spark, tmp_path):
    from waymark.sources.page_index import build_index, retrieve_indexed

    empty = spark.createDataFrame([], "doc_id long, title string, url string, content string")
    index = build_index(empty, f"{tmp_path}/index")
    asked = spark.createDataFrame([(1, "oak", [], [])], SCHEMA)
    assert retrieve_indexed(asked, index).count() == 0


def test_hot_class_of_many_specs_meets_only_sets_of_terms(spark):
    """One name in many towns, and list pages that each have terms of their own."""
    rng = random.Random(8)
    towns = [f"town{i}" for i in range(30)]
    docs = [(i, None, "central school " + " ".join(rng.sample(towns, 12)) + (" tx" if i % 2 else "")) for i in range(60)]
    queries = [(i, "Central School", [], [t, "tx"]) for i, t in enumerate(towns)]
    queries += [(90, "Central School", [], towns[:7]), (91, "Central School", [], [])]
    assert found(spark, queries, docs, 3) == brute_force(queries, docs, 3)


def on_site(address, hosts):
    host = re.match(r"https?://([^/?#]*)", (address or "").strip().lower())
    host = re.sub(r":[0-9]*$", "", host[1].rpartition("@")[2]) if host else ""
    return any(host == h or host.endswith("." + h) for h in hosts)


def test_sites_restrict_before_the_ranking(spark, tmp_path):
    """Only pages on the sites, or below them, count; the list is filled from those. The stored index agrees."""
    from waymark.sources.page_index import build_index, retrieve_indexed

    hosts = ["a.org", "www.a.org", "ba.org", "x.y.b.com:8080", "b.com", "user@b.com", "b.com.net", "c.org"]
    queries, docs = random_case(21)
    address = {d[0]: None if d[0] % 11 == 0 else f"HTTPS://{hosts[d[0] % 8]}/{d[0]}?at=a.org" for d in docs}
    rows = [(*d, address[d[0]]) for d in docs]
    corpus = spark.createDataFrame(rows, "doc_id int, title string, text string, url string")
    asked, sites = spark.createDataFrame(queries, SCHEMA), [" A.org ", "", "https://b.com/some?page"]
    want = brute_force(queries, [d for d in docs if on_site(address[d[0]], ["a.org", "b.com"])], 3)
    assert want != brute_force(queries, docs, 3)
    index = build_index(corpus, str(tmp_path / "index"), content="text")
    for found in (
        retrieve(asked, corpus, 3, title="title", fields=("text",), sites=sites),
        retrieve_indexed(asked, index, 3, sites=sites),
    ):
        assert {(r.query_id, r.doc_id, r.score, r["rank"]) for r in found.collect()} == want
    none = retrieve(asked, corpus, 3, title="title", fields=("text",), sites=["d.org"])
    assert none.count() == 0
    with pytest.raises(ValueError):
        retrieve(asked, corpus, sites=["", " "])


def test_sources_of_sites_agree(spark, tmp_path):
    from waymark.plans.resolve import corpus_source, indexed_source, resolve
    from waymark.sources.page_index import build_index

    pages = [(i, "Oak High staff directory", f"https://{'oak' if i % 2 else 'elm'}.org/staff/{i}", "oak high a@b.org") for i in range(8)]
    corpus = spark.createDataFrame(pages, "doc_id int, title string, url string, content string")
    entities = spark.createDataFrame([(1, "Oak High", "Portland", "TX")], "entity_id int, name string, city string, state string")
    index = build_index(corpus, str(tmp_path / "index"))
    urls = [
        resolve(entities, source).first().url
        for source in (
            corpus_source(corpus),
            corpus_source(corpus, sites=["oak.org"]),
            indexed_source(index, sites=["oak.org"]),
            corpus_source(corpus, sites=["none.org"]),
        )
    ]
    assert urls == ["https://elm.org/staff/0", "https://oak.org/staff/1", "https://oak.org/staff/1", "NOT_FOUND"]


def test_postings_are_made_where_a_page_is_read(spark):
    """No word is shuffled but those of pages that share an id, which are one page to the index."""
    from waymark.sources import page_index

    rows = [(1, "Oak oak", "elm, oak; Elm"), (2, None, "|| ..."), (3, "", None), (4, "fir", "fir-\u00e4sh 7")]
    again = [*rows, (4, "fir fir", "yew"), (4, "fir", "fir")]

    def postings(rows):
        corpus = spark.createDataFrame(rows, "doc_id int, title string, text string")
        return page_index._postings(corpus, "doc_id", "title", ["text"])

    def on_paper(rows):
        found = {}
        for doc, title, text in rows:
            head, body = (re.split(r"[^\w]+", (s or "").lower()) for s in (title, text))
            for i, w in enumerate([*head, "|", *body]):
                if w not in ("", "|"):
                    found.setdefault((w, doc), []).append(i)
        return {k: sorted(at) for k, at in found.items()}

    def told(df):
        rows = df.select("term", "doc", "at").collect()
        assert len({(r.term, r.doc) for r in rows}) == len(rows)
        return {(r.term, r.doc): r["at"] for r in rows}

    alone = postings(rows)
    assert "Exchange" not in alone._jdf.queryExecution().toString()
    assert told(alone) == on_paper(rows)
    assert {(r.term, r.title_words) for r in alone.where("doc = 1").collect()} == {("oak", 2), ("elm", 2)}
    assert told(postings(again)) == on_paper(again)
