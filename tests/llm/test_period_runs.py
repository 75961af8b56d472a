"""Periodic runs: the trees against comparing every period, cuts, columns and the query's planted texts."""

import hashlib
import random
import zlib

import pytest

from waymark.llm.period_runs import Extensions, SuffixTree, collapse, runs_of, stretches, with_runs
from waymark.llm.queries import op13_periodic_runs


def brute(w, exponent, shortest):
    found = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, n = i, j + q - i
            if j > i and n >= max(shortest, exponent * q) and not any(w[s : s + n - d] == w[s + d : s + n] for d in range(1, q)):
                found.append((s, n, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def some_words(rng):
    w = [rng.randrange(1, rng.choice([2, 3, 4, 5])) for _ in range(rng.randrange(0, 60))]
    if rng.random() < 0.6:
        w = (w[: rng.randrange(0, 10)] + w[: rng.randrange(1, 8)] * rng.randrange(1, 9) + w)[:100]
    return w


@pytest.mark.parametrize("exponent,shortest", [(4, 6), (2, 2), (3, 1), (4, 9)])
def test_equals_brute_force(exponent, shortest):
    rng = random.Random(exponent * 10 + shortest)
    for _ in range(700):
        w = some_words(rng)
        assert runs_of(w, exponent, shortest) == brute(w, exponent, shortest)


def test_extensions_are_common_prefixes():
    import numpy as np

    rng = random.Random(2)
    for _ in range(50):
        w = some_words(rng) or [1]
        common = Extensions(*SuffixTree(w).tour())
        pairs = [(a, b) for a in range(len(w) + 1) for b in range(len(w) + 1) if a != b]
        got = common(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
        for (a, b), n in zip(pairs, got.tolist(), strict=True):
            assert w[a : a + n] == w[b : b + n] and (max(a, b) + n == len(w) or w[a + n] != w[b + n])


def test_cuts_keep_only_repetitive_stretches():
    words = [str(i) for i in range(500)] + ["a", "b"] * 5 + [str(i) for i in range(500)]
    assert [(o, len(s)) for o, s in stretches(words, 4, 6)] == [(500, 10)]


def test_long_texts_take_linear_work():
    words = ["a", "b", "c"] * 20_000
    assert runs_of(words) == [(0, 60_000, 3)]
    assert collapse(words, runs_of(words)) == ["a", "b", "c"]


def test_columns_and_odd_rows(spark):
    rows = [(1, "a b " * 4, "x", 1), (1, "a b " * 4, "x", 1), (None, None, "y", 2), (3, "", None, 3), (4, " \t one\x0btwo x \n", "z", 4)]
    df = spark.createDataFrame(rows, "doc_id long, Text string, runs string, found int")
    got = with_runs(df, text="text")
    assert got.columns == ["doc_id", "Text", "runs", "found", "runs_1", "collapsed"]
    out = sorted(((r[0], r[2], r[3], [tuple(x) for x in r[4]], r[5]) for r in got.collect()), key=str)
    run = (1, "x", 1, [(0, 8, 2)], "a b")
    assert out == sorted([run, run, (None, "y", 2, [], ""), (3, None, 3, [], ""), (4, "z", 4, [], "one two x")], key=str)
    assert with_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        with_runs(df, exponent=1)


def test_query_equals_plain_loop(spark, tmp_path):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdef") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 90))) for _ in range(300)]
    rows = [*enumerate(texts), (None, "q " * 9), (-7, None), (10, "\t"), (10**15, "z " * 50)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc, text in rows:
        w = (text or "").split()
        n, h = len(w), zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w, 4, 6)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
        want.append((doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *sha))
    got = op13_periodic_runs(spark, str(tmp_path))
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
