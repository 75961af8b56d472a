"""Exact dedup: block names against plain grouping."""

import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from waymark.llm.exact_dedup import exact_groups, identities

SCHEMA = "doc_id long, text string, hash string, rank string, pos int"


def brute(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc)
    out = []
    for text, docs in groups.items():
        known = [d for d in docs if d is not None]
        keep = min(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(d, keep, len(docs), keep is None or d == keep, sha) for d in docs]
    return sorted(out, key=str)


def test_equals_plain_grouping(spark, monkeypatch):
    monkeypatch.setattr("waymark.llm.exact_dedup.BLOCK", 5)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\n") for _ in range(rng.choice([0, 1, 4, 5, 6, 9, 10, 11, 21, 60, 200]))) for _ in range(60)]
    texts += [t[:-1] + "z" for t in texts if len(t) > 8] + ["x" * 26, "x" * 27, "xx  y", "xx\ty", None, ""]
    rows = [(i, rng.choice(texts)) for i in range(250)]
    rows += [(3, rows[3][1]), (None, rows[5][1]), (None, "only here"), (400, None), (401, "")]
    df = spark.createDataFrame([(d, t, "h", "r", 1) for d, t in rows], SCHEMA)
    assert sorted(map(tuple, exact_groups(df).collect()), key=str) == brute(rows)
    assert exact_groups(df.limit(0)).count() == 0


def test_colliding_hashes_keep_names_apart(spark, monkeypatch):
    monkeypatch.setattr("waymark.llm.exact_dedup.BLOCK", 4)
    texts = ["aaaabbbb", "aaaacccc", "aaaabbbb", "dddd", "eeee", "dddd"]
    df = spark.createDataFrame([(i, t, "h", "r", 1) for i, t in enumerate(texts)], SCHEMA)
    one = identities(df, F.lit(7).cast("long")).collect()
    names = {r["doc_id"]: (r["blocks"], r["hash"], r["rank"]) for r in one}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (names[i] == names[j]) == (a == b)
