"""N-gram Jaccard join against brute force."""

import random
import re

import numpy as np
import pytest

from waymark.llm.common import shingle_set
from waymark.llm.ngram_join import Rule, ngram_components, without_near_copies
from waymark.session import exists, scratch_path

SCHEMA = "doc_id long, text string, n_shingles string, tile string"


def brute(rows, size, num, den):
    sets = {}
    for doc, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[doc] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            inter, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if union and den * inter >= num * union:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows, doc = [], 0
    for family in range(40):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([1, 3, 5, 8, 12, 40, 90, 300]))]
        for _ in range(rng.randrange(1, 9)):
            rows.append((doc := doc + 1, " ".join(edited(rng, base, rng.randrange(0, 1 + len(base) // 20)))))
    rows += [(doc + i, t) for i, t in enumerate([None, "", " \t\n ", "Foo BAR", "foo\x0bbar", "É x", "é x"], 1)]
    return rows


@pytest.mark.parametrize("size,num,den", [(4, 85, 100), (1, 1, 2)])
def test_equals_brute_force(spark, corpus, size, num, den):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in corpus], SCHEMA)
    got = {r[0]: (r[1], r[2]) for r in ngram_components(df, size, num, den).collect()}
    assert got == brute(corpus, size, num, den)


def test_large_family_and_blocks(spark, monkeypatch):
    """Near copies around the threshold, with tiles and leaders split into small blocks."""
    monkeypatch.setattr("waymark.llm.ngram_join.BLOCK", 8)
    monkeypatch.setattr("waymark.llm.ngram_join.FOLLOWERS", 5)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, rng.randrange(0, 8)))) for i in range(120)]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    got = {r[0]: (r[1], r[2]) for r in ngram_components(df, 4, 85, 100).collect()}
    assert got == brute(rows, 4, 85, 100)


def test_every_linked_pair_shares_a_tile():
    import numpy as np

    rng = np.random.default_rng(1)
    for num, den in ((85, 100), (4, 5), (1, 2)):
        rule = Rule(4, num, den)
        for n in (6, 7, 9, 13, 30, 31, 100, 277, 1000):
            for _ in range(30):
                a = rng.integers(0, 2**64, n, dtype=np.uint64)
                drop = rng.integers(0, n // 2)
                b = np.concatenate([a[drop:], rng.integers(0, 2**64, rng.integers(0, n // 3 + 1), dtype=np.uint64)])
                inter = n - drop
                if den * inter >= num * (n + len(b) - inter) and (drop or len(b) > n):
                    a1, b1 = np.unique(a), np.unique(b)
                    assert np.intersect1d(rule.tiles(a1), rule.tiles(b1)).size, (n, drop, len(b))


def test_edge_rows(spark):
    rows = [(7, "a b c d e f g h"), (7, "a b c d e f g h"), (None, "a b c d e f g h"), (9, None)]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    got = sorted(map(tuple, ngram_components(df).collect()), key=str)
    assert got == sorted([(7, 4, 7), (7, 4, 7), (None, 4, None), (9, 0, 9)], key=str)
    assert ngram_components(df.limit(0)).count() == 0
    assert sorted((r[0] is None, r[0]) for r in without_near_copies(df).collect()) == [(False, 7), (False, 9), (True, None)]


def test_one_row_of_each_component_stays(spark, corpus):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in corpus], SCHEMA)
    want = {root for _, root in brute(corpus, 5, 4, 5).values()}
    got = without_near_copies(df)
    assert got.columns == df.columns
    assert {r[0] for r in got.collect()} == want


def test_links_through_a_repeated_id(spark):
    t1, t2, t3 = (" ".join(f"{c}{i}" for i in range(12)) for c in "abc")
    rows = [(5, t1), (5, t2), (3, t1), (7, t2), (9, t3), (8, t3), (9, t2)]
    for extra in ([], [(1, t3)]):
        df = spark.createDataFrame(rows + extra, "doc_id long, text string")
        got = {r["component_id"] for r in ngram_components(df).collect()}
        assert got == {1 if extra else 3}


def test_empty_slices_make_no_common_tile():
    """Short sets without a shingle in common share no tile, however many they are."""
    rng = random.Random(11)
    for size, num, den in ((5, 4, 5), (4, 85, 100)):
        rule, members = Rule(size, num, den), {}
        for _ in range(4000):
            words = [f"w{rng.randrange(10**9)}" for _ in range(rng.choice([7, 12, 20, 30, 60]) + size - 1)]
            for tile in set(rule.tiles(shingle_set(" ".join(words), size)).tolist()):
                members[tile] = members.get(tile, 0) + 1
        assert max(members.values()) <= 10


@pytest.mark.parametrize("num,den", [(4, 5), (85, 100), (1, 2)])
def test_linked_short_sets_share_a_tile(num, den):
    """Sets of few hashes, also such that leave most slices empty: the pair at the threshold still meets."""
    rng, rule = np.random.default_rng(13), Rule(4, num, den)
    linked = 0
    for _ in range(4000):
        # Bunched hashes fill few slices.
        width = int(rng.choice([56, 60, 62, 63]))
        draw = np.unique(rng.integers(0, 2**width, 40, dtype=np.uint64)).tolist()
        rng.shuffle(draw)
        common = int(rng.integers(1, 30))
        extra = common * (den - num) // num
        left = int(rng.integers(0, extra + 1))
        a, b = draw[:common] + draw[common : common + left], draw[:common] + draw[common + left : common + extra]
        x, y = (np.array(sorted(s), dtype=np.uint64) for s in (a, b))
        if len(x) + len(y) == 2 * common or len(set(a) | set(b)) * num > common * den:
            continue
        linked += 1
        assert np.intersect1d(rule.tiles(x), rule.tiles(y)).size, (len(x), len(y), common)
    assert linked > 1000


def test_hot_tiles(spark, corpus, monkeypatch):
    """Tiles that are summed before their rows meet give the same classes."""
    monkeypatch.setattr("waymark.llm.ngram_join.HOT_TILE", 3)
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in corpus], SCHEMA)
    got = {r[0]: (r[1], r[2]) for r in ngram_components(df, 4, 85, 100).collect()}
    assert got == brute(corpus, 4, 85, 100)


def test_a_set_takes_no_more_tiles_than_it_can_differ():
    """Of the slices of a band only the fullest, one more than the shingles in which a linked set can differ."""
    rng = np.random.default_rng(17)
    for num, den in ((4, 5), (85, 100)):
        rule = Rule(4, num, den)
        for n in (50, 130, 277, 600, 1500):
            found = rule.tiles(np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)))
            differ = (n + n * den // num) * (den - num) // (den + num)
            assert 0 < len(found) <= (differ + 1) * len(rule.bands_of(n))


def test_tile_keys_do_not_stay(spark, monkeypatch):
    """Once the common tiles are stored, the table of all tiles is dropped."""
    paths = []
    monkeypatch.setattr("waymark.llm.ngram_join.scratch_path", lambda *a: paths.append(scratch_path(*a)) or paths[-1])
    df = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "x")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_components(df).collect())) == [(1, 4, 1), (2, 4, 1), (3, 1, 3)]
    assert paths and not any(exists(spark, p) for p in paths)
