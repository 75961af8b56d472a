"""Toxicity models: held-out accuracy on planted words, edge rows."""

import random
from collections import Counter

import numpy as np
import pytest

from waymark.llm.toxicity import Keys, Model, discounts, fit_curve, fold, letter_runs, train, with_scores, without_toxic

SCHEMA = "doc_id long, text string, toxic string, score string"


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(2)
    parts = ["an", "er", "the", "ing", "on", "st", "ti", "ou"]
    rows, labels = [], []
    for i in range(900):
        words = ["".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(rng.randrange(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), "Grumpf" + rng.choice(parts) + "!")
        rows.append((i, " ".join(words), "t", "s"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark, planted):
    docs, labels = planted
    scored = with_scores(docs.drop("score"), labels).join(labels.withColumnRenamed("toxic", "label"), "doc_id")
    rows = scored.where(fold(scored.doc_id) == 2).collect()
    wrong = [r for r in rows if (r["score"] >= 0.3) != bool(r["label"])]
    assert len(rows) > 150 and len(wrong) <= 0.02 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_stage_keeps_columns_and_clean_rows(planted):
    docs, labels = planted
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r[0] for r in kept.select("doc_id").collect()}
    assert sum(1 for i in range(900) if i % 6 and i not in ids) <= 8
    assert sum(1 for i in range(0, 900, 6) if i in ids) <= 5


def test_edge_rows(spark):
    rows = [(1, None, "a", "b"), (1, None, "a", "b"), (None, "", "a", "b"), (2, "x " * 300000, "a", "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        got = with_scores(df, known, "s").collect()
        assert len(got) == 4 and all(0 <= r["s"] <= 1 for r in got)
    assert with_scores(df.limit(0), labels, "s").count() == 0


def test_letter_runs():
    (runs, starts), = letter_runs("Ab, c!")
    assert starts.tolist() == [0, 3]
    want = [b" a", b" ab", b" ab ", b" c", b" c "]
    assert [int(r).to_bytes(8, "big").lstrip(b"\0") for r in runs] == want
    assert list(letter_runs(None)) == list(letter_runs(" .,")) == []


def test_curve_and_discounts():
    x = np.array([[0.0, 1], [0, 2], [0, 8], [0, 9]])
    w = fit_curve(x, np.array([0.0, 0, 1, 1]))
    p = 1 / (1 + np.exp(-(np.column_stack([np.ones(4), x]) @ w)))
    assert p[1] < 0.3 < p[2]
    assert discounts(np.array([0, 0, 0, 0.0])).tolist() == [0, 0.75, 0.75, 0.75]
    assert (np.diff(discounts(np.array([100.0, 40, 20, 10]))) >= 0).all()


def test_keys_are_exact():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 1 << 12):
        have = rng.integers(0, 1 << 48, n, dtype=np.uint64)
        keys, other = Keys(have), rng.integers(1 << 48, 1 << 49, 500, dtype=np.uint64)
        assert len(keys) == len(np.unique(have)) == len(np.unique(keys.find(have)))
        assert (keys.find(other) == len(keys)).all()
        assert keys.sums(have).tolist() == [*[1.0] * len(keys), 0.0]


def test_what_models_keep_grows_with_the_runs():
    # More distinct runs than any fixed table of the earlier form had places.
    letters = np.arange(1 << 21, dtype=np.uint64)
    runs = np.uint64(0x20) << np.uint64(40) | letters << np.uint64(8) | np.uint64(97)
    n = np.ones(len(runs), dtype=np.int64)
    model = Model([(runs, n), (runs[:10], n[:10] * 3)])
    assert [len(k) for k in model.keys[:2]] == [1 << 21, 1 << 21]
    for of_class, want in zip(model.tables, (n, np.r_[n[:10] * 3, 0 * n[10:]]), strict=True):
        assert (of_class[1][model.keys[0].find(runs)] == want).all()
        assert (of_class[2][model.keys[1].find(runs >> np.uint64(8))] == want).all()


def test_all_labels_outside_fold_2_are_counted_but_those_of_the_curve(spark):
    # A word of its own in each document: the models know those of three quarters of the allowed ones, of fold 3 too.
    rows = [(i, f"q{i}z", "t", "s") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    folds = {r[0]: r[1] for r in df.select("doc_id", fold(df.doc_id)).collect()}
    model = train(df, spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int"))
    known = {i: all((model.keys[0].find(r) < len(model.keys[0])).all() for r, _ in letter_runs(f"q{i}z")) for i in folds}
    allowed = [i for i in folds if folds[i] != 2]
    assert sum(known[i] for i in allowed) == len(allowed) - len(allowed) // 4
    assert not any(known[i] for i in folds if folds[i] == 2)
    assert sum(known[i] for i in allowed if folds[i] == 3) > 50


def plain_words(text):
    """Words of a text, each with a space at both ends."""
    letters = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text)
    return [f" {w} " for w in letters.split()]


def plain_runs(text):
    """Each letter of a word but the first space, with up to five before it."""
    return [w[max(0, i - 5) : i + 1] for w in plain_words(text) for i in range(1, len(w))]


def plain_log_probability(run, own, classes):
    """Kneser-Ney by its definition: ``own`` and ``classes`` are counters of runs."""

    def discount(n):
        n1, n2, n3, n4 = (sum(1 for c in own.values() if c == k) for k in (1, 2, 3, 4))
        if not (n1 and n2 and n3):
            return 0.75 if n else 0.0
        y = n1 / (n1 + 2 * n2)
        cut = {1: 1 - 2 * y * n2 / n1, 2: 2 - 3 * y * n3 / n2, 3: 3 - 4 * y * n4 / n3}
        return min(max(cut[min(n, 3)], 0.1), min(n, 3)) if n else 0.0

    def types(counter, end, of):
        return sum(1 for r in counter if len(r) >= 2 and of(r) == end)

    def brief(r):
        return r[-3:]

    def two(r):
        return r[-3:-1]

    share = (sum(types(c, brief(run), brief) for c in classes) + 0.5) / (sum(types(c, two(run), two) for c in classes) + 32)
    after = types(own, two(run), two)
    lower = share if not after else 0.5 * max(types(own, brief(run), brief) - discount(1), 0) / after + 0.5 * share
    followers = {r: n for r, n in own.items() if r[:-1] == run[:-1]}
    total = sum(followers.values())
    if not total:
        return np.log(lower)
    n = followers.get(run, 0)
    spread = sum(discount(m) for m in followers.values()) / total
    return np.log(max(n - discount(n), 0) / total + spread * lower)


def small_model(seed, scale):
    rng = random.Random(seed)
    parts = ["an", "er", "th", "in", "ab", "a", "gru"]
    texts = [[" ".join("".join(rng.choices(parts[: 5 + 2 * k], k=rng.randrange(1, 4))) for _ in range(scale)) for _ in range(6)] for k in (0, 1)]
    counts, plain = [], []
    for of_class in texts:
        runs = np.concatenate([r for t in of_class for r, _ in letter_runs(t)])
        counts.append(np.unique(runs, return_counts=True))
        plain.append(Counter(r for t in of_class for r in plain_runs(t)))
    return Model(counts), plain, rng


@pytest.mark.parametrize("seed,scale", [(1, 2), (2, 12), (3, 60)])
def test_equals_plain_kneser_ney(seed, scale):
    """Every letter of known and unknown words has the ratio that the definition gives."""
    model, plain, rng = small_model(seed, scale)
    text = " ".join("".join(rng.choices("aberthgnizu", k=rng.randrange(1, 9))) for _ in range(25)) + " ther grugru an, Aban"
    (runs, _), = letter_runs(text)
    want = [plain_log_probability(r, plain[1], plain) - plain_log_probability(r, plain[0], plain) for r in plain_runs(text)]
    assert np.allclose(model.ratios(runs), want, atol=2e-4)


def test_evidence_equals_plain_sums_in_pieces_too(monkeypatch):
    """Mean by word and best pair of neighbours, also of those that stand in two pieces of a long text."""
    model, plain, rng = small_model(4, 12)
    words = ["".join(rng.choices(["an", "er", "gru", "th"], k=rng.randrange(1, 4))) for _ in range(40)]
    for text in (" ".join(words), "grugru", "an grugru"):
        of_word = [
            sum(plain_log_probability(r, plain[1], plain) - plain_log_probability(r, plain[0], plain) for r in plain_runs(w))
            for w in text.split()
        ]
        pairs = [(x + y) / 2 for x, y in zip(of_word, of_word[1:])] or [of_word[0] / 2]
        for size in (1, 7, 30, 1 << 20):
            monkeypatch.setattr("waymark.llm.toxicity.PASS_BYTES", size)
            assert np.allclose(model.evidence(text), [sum(of_word) / len(of_word), max(pairs)], atol=2e-3)
