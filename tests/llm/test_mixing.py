"""Raking: marginals, draws and edge rows."""

import pytest

from waymark.llm.mixing import OTHER, Targets, draw, fitted_cells, marginals

SCHEMA = "doc_id long, text string, source string, lang string, w double, topic string, row int"


def sums(cells, dimension):
    out = {}
    for r in cells:
        out[r[dimension]] = out.get(r[dimension], 0) + r["w"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(3000):
        source, lang = ("a", "b", "c")[min(i % 7, 2)], ("en", "de", "xx")[(i // 3) % 3]
        rows.append((i, "w " * (1 + i % 11) + ("| x" if i % 5 == 0 else "") + " | " * (i % 5 == 0), source, lang, 0.0, "t", 1))
    return spark.createDataFrame(rows, SCHEMA)


TARGETS = Targets({"a": 1, "b": 2, "zz": 9}, {"en": 0.5, "de": 0.5}, {"prose": 0.8, "list": 0.2}, keep=0.3, sweeps=25)


def test_marginals_hold(docs):
    cells = fitted_cells(docs, TARGETS).collect()
    total = sum(r["t"] for r in cells)
    natural = {d: {} for d in ("source", "lang", "topic")}
    for r in cells:
        for d in natural:
            natural[d][r[d]] = natural[d].get(r[d], 0) + r["t"]
    assert set(natural["source"]) == {"a", "b", OTHER}
    source, lang, topic = (sums(cells, d) for d in ("source", "lang", "topic"))
    rest = total - natural["source"][OTHER]
    assert source["a"] == pytest.approx(0.3 * rest / 3, rel=1e-3)  # the absent category has no share
    assert source["b"] == pytest.approx(0.3 * rest * 2 / 3, rel=1e-3)
    assert lang["en"] == pytest.approx(lang["de"], rel=1e-3)
    assert lang[OTHER] == pytest.approx(0.3 * natural["lang"][OTHER], rel=1e-3)
    assert topic["list"] == pytest.approx(0.3 * total * 0.2, rel=1e-3)
    assert all(-1e-9 <= r["w"] <= r["t"] for r in cells)


def test_draws_follow_the_weights(docs):
    drawn = draw(docs, TARGETS)
    assert drawn.columns == docs.columns
    rows = drawn.collect()
    assert [tuple(r) for r in rows] == [tuple(r) for r in draw(docs, TARGETS).collect()]
    cells = fitted_cells(docs, TARGETS).collect()
    want = sum(r["w"] for r in cells)
    assert sum(len(r["text"].split(" ")) for r in rows) == pytest.approx(want, rel=0.1)


def test_edge_rows(spark):
    rows = [(None, None, None, None, None, None, None), (1, "", "a", "en", 1.0, "x", 2), (1, "", "a", "en", 1.0, "x", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    all_of = Targets({"a": 1}, {"en": 1}, {"prose": 1}, keep=1.0)
    assert draw(df, all_of).count() == 3
    assert draw(df.limit(0), all_of).count() == 0
    with pytest.raises(ValueError):
        Targets({}, {}, {}, keep=0)


def raked(tokens, targets):
    """Plain loops: shares filled up to what there is, then raking with a cap for each cell."""
    wants = []
    for place, dimension in enumerate(("source", "lang", "topic")):
        has, shares = {}, getattr(targets, dimension)
        for cell, t in tokens.items():
            has[cell[place]] = has.get(cell[place], 0) + t
        free = {c: shares[c] for c in has if shares.get(c, 0) > 0}
        left = targets.keep * sum(t for c, t in has.items() if c != OTHER)
        want = {c: targets.keep * t if c == OTHER else 0 for c, t in has.items()}
        while free:
            level = left / sum(free.values())
            short = [c for c in free if has[c] < level * free[c]]
            for c in short or free:
                want[c] = has[c] if short else level * free[c]
            if not short:
                break
            for c in short:
                left -= has[c]
                del free[c]
        wants.append(want)
    w = {cell: targets.keep * t for cell, t in tokens.items()}
    for _ in range(targets.sweeps):
        for place, want in enumerate(wants):
            total = {}
            for cell, x in w.items():
                total[cell[place]] = total.get(cell[place], 0) + x
            w = {c: x * want[c[place]] / total[c[place]] if total[c[place]] else 0 for c, x in w.items()}
            if place == 2:
                w = {c: min(x, tokens[c]) for c, x in w.items()}
    return wants, w


def test_a_target_beyond_what_exists_equals_plain_loops_and_is_told(docs):
    greedy = Targets({"a": 3, "b": 1, "c": 1}, {"en": 0.9, "de": 0.1}, {"prose": 0.3, "list": 0.7}, keep=0.6, sweeps=30, tolerance=1e-9)
    cells = fitted_cells(docs, greedy).collect()
    wants, w = raked({(r["source"], r["lang"], r["topic"]): r["t"] for r in cells}, greedy)
    for r in cells:
        assert r["w"] == pytest.approx(w[r["source"], r["lang"], r["topic"]], rel=1e-4, abs=1e-3)
    told = {(r.dimension, r.category): r for r in marginals(docs, greedy).collect()}
    for d, want in zip(("source", "lang", "topic"), wants, strict=True):
        for c, tokens in want.items():
            assert told[d, c].wanted == pytest.approx(tokens)
    row = told["topic", "list"]
    assert row.asked > row.has == row.wanted >= row.fitted and row.missed < -0.01
    with pytest.warns(UserWarning, match="topic 'list' -"):
        draw(docs, greedy)


def test_sweeps_end_once_the_targets_hold(docs):
    few, many = (fitted_cells(docs, Targets(TARGETS.source, TARGETS.lang, TARGETS.topic, 0.3, n)) for n in (40, 400))
    assert sorted(few.collect()) == sorted(many.collect())
    off = marginals(docs, TARGETS).where("abs(deviation) > 0.001").count()
    assert off == 0
