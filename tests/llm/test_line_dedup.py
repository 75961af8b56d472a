"""Line dedup against brute force."""

import random
import re

import pytest

from waymark.llm.line_dedup import without_repeated_lines

SCHEMA = "doc_id long, text string, gone string, line_doc string"


def brute(rows, num=4, den=5, least=1):
    out, seen = {}, []
    for doc, text in sorted(rows):
        lines = text.split("\n")
        kept, new = [], []
        for i, line in enumerate(lines):
            s = {w for w in re.split(r"[\x20\x09-\x0D]+", line) if w}
            new.append(s)
            if len(s) >= least and any(
                len(s & t) * den >= len(s | t) * num for t in seen + new[:i] if len(t) >= least
            ):
                continue
            kept.append(line)
        seen += new
        out[doc] = ("\n".join(kept), len(lines) - len(kept))
    return out


@pytest.mark.parametrize("num,den,seed", [(4, 5, 1), (1, 2, 2)])
def test_equals_brute_force(spark, num, den, seed):
    rng = random.Random(seed)
    bases = [[f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.choice([1, 2, 3, 4, 6, 10, 30]))] for _ in range(60)]
    rows = []
    for doc in range(80):
        lines = []
        for _ in range(rng.randrange(0, 8)):
            line = list(rng.choice(bases))
            for _ in range(rng.randrange(0, 1 + len(line) // 4)):
                line[rng.randrange(len(line))] = f"w{rng.randrange(400)}"
            rng.random() < 0.2 and rng.shuffle(line)
            lines.append(rng.choice([" ", "  ", "\t"]).join(line))
        rows.append((doc, "\n".join(lines)))
    df = spark.createDataFrame([(d, t, "g", "p") for d, t in rows], SCHEMA)
    got = {r["doc_id"]: (r["text"], r["n"]) for r in without_repeated_lines(df, num, den, removed="n").collect()}
    assert got == brute(rows, num, den)


def test_edge_rows(spark):
    line = "one two three four"
    rows = [(2, f"{line}\n\n{line} "), (2, f"{line}\nother words here now"), (None, line), (5, None), (6, ""), (7, f"{line}\n"), (1, "a b\na b")]
    df = spark.createDataFrame([(d, t, "g", "p") for d, t in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["text"], r["gone"]) for r in without_repeated_lines(df).collect()), key=str)
    want = [(2, f"{line}\n", "g"), (2, f"{line}\nother words here now", "g"), (None, line, "g"), (5, None, "g"), (6, "", "g"), (7, "", "g"), (1, "a b", "g")]
    assert got == sorted(want, key=str)
    assert without_repeated_lines(df.limit(0)).count() == 0
    assert without_repeated_lines(df).columns == df.columns


def test_short_and_repetitive_lines(spark):
    rows = [(1, "x y x y x y"), (2, "y  x"), (3, "x\ny\nx\t"), (4, " \n\t\n "), (5, "x y z")]
    df = spark.createDataFrame([(d, t, "g", "p") for d, t in rows], SCHEMA)
    for least in (1, 2, 3):
        got = {r["doc_id"]: r["text"] for r in without_repeated_lines(df, min_words=least).collect()}
        assert got == {d: t for d, (t, _) in brute(rows, least=least).items()}


def test_very_long_line(spark):
    words = [f"w{i}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[5_000:])), (3, "z" * 500_000), (4, "z" * 500_000 + " y")]
    df = spark.createDataFrame([(d, t, "g", "p") for d, t in rows], SCHEMA)
    assert {r["doc_id"]: len(r["text"]) for r in without_repeated_lines(df).collect()} == {1: len(rows[0][1]), 2: 0, 3: 500_000, 4: 500_002}


def test_rarity_stays_out_of_plans(spark):
    from waymark.llm.line_dedup import _described, _rarity

    docs = spark.createDataFrame([(1, "one two three"), (2, "two three four")], "doc_id long, text string")
    plan = _described(docs, _rarity(docs), 4, 5, 1)._jdf.queryExecution().toString()
    assert len(plan) < 50_000
    # The row of classes is looked up inside the expression, never carried along as a column.
    assert "lambdafunction((shiftleft(cast((ascii(cast(substring(Subquery" in plan


def test_prefixes_are_shuffled_once(spark, monkeypatch):
    from waymark.llm import line_dedup

    plans, verified = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda docs, pairs, *a: plans.append(pairs) or verified(docs, pairs, *a))
    docs = spark.createDataFrame([(i, f"one two three four w{i}") for i in range(9)], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        line_dedup.removed_lines(docs)
        plan = plans[1]
        plan.collect()
        assert "ReusedExchange" in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_leave_the_join_once(spark, monkeypatch):
    """Not once for each prefix word that two lines share; and few whose words differ too much ship their words."""
    from waymark.llm import line_dedup

    pairs, labels, verified, stored = [], {}, line_dedup._verified, line_dedup.materialize

    def none_verified(docs, found, *a):
        pairs.append(found)
        return verified(docs, found, *a).limit(0 if len(pairs) == 1 else 10)

    def materialize(df, label):
        labels[label] = stored(df, label)
        return labels[label]

    monkeypatch.setattr(line_dedup, "_verified", none_verified)
    monkeypatch.setattr(line_dedup, "materialize", materialize)
    common = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"{common} x"), (2, f"{common} y")], "doc_id long, text string")
    assert [r["doc_id"] for r in line_dedup.removed_lines(docs).collect()] == [2]
    assert pairs[1].count() <= 2
    assert labels["likely-pairs"].count() == 1
