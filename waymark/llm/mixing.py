"""Mixing to target weights by iterative proportional fitting (raking).

Documents are counted in cells of (source, language, topic).  The cells' token weights are scaled
to each list of target shares in turn, again and again, until all three hold; a cell never asks for more tokens
than it has.  What the lists cannot have together is returned and warned of (``marginals``, ``draw``).  A document is drawn with probability weight / tokens of its cell, by a hash of
its id, so the same documents are drawn on every run.

Only SQL is used, the same text for Spark and the oracle.  Categories that a target does not list
count together as one, so there are at most ``(|sources| + 1) * (|languages| + 1) * (|topics| + 1)`` cells however large the table is:
that bound is what the broadcast of the fitted cells rests on.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.session import materialize

DIMENSIONS = ("source", "lang", "topic")
OTHER = "(other)"
#: Sweeps that make one plan.
SWEEPS_A_PLAN = 4
#: Share of a target's tokens by which it may be missed without a warning.
MISSED = 0.01
#: Kinds of text that the query tells apart, in Spark's and the oracle's SQL.
TOPIC_SQL = """CASE WHEN text LIKE '%Licensed under%' OR text LIKE '%Copyright%' THEN 'licence'
 WHEN text LIKE '% | %' THEN 'list' WHEN text LIKE '%***%' OR text LIKE '%###%' THEN 'marked' ELSE 'prose' END"""


@dataclass
class Targets:
    """Shares of each dimension's categories, the share of all tokens to keep, and the number of sweeps.

    Shares need not add up to 1.  Unlisted categories together keep the share of tokens they
    have; listed ones divide the rest.  A category with fewer tokens than its share asks for gives
    all it has, and the others of its list divide what is left by their shares.  Fitting ends after ``sweeps``, or
    earlier once every sum is within ``tolerance`` (relative) of what can be had.
    """

    source: dict[str, float]
    lang: dict[str, float]
    topic: dict[str, float]
    keep: float = 0.5
    sweeps: int = 40
    tolerance: float = 5e-4
    seed: str = "mix"
    topic_sql: str = field(default=TOPIC_SQL)

    def __post_init__(self) -> None:
        shares = [v for d in DIMENSIONS for v in getattr(self, d).values()]
        if not 0 < self.keep <= 1 or self.sweeps < 1 or any(v < 0 for v in shares):
            raise ValueError("keep is in (0, 1], sweeps positive, shares not negative")


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def cell_of(targets: Targets, dimension: str, value: str) -> str:
    """A column's category as its target lists it."""
    listed = ", ".join(_text(k) for k in getattr(targets, dimension))
    return f"CASE WHEN {value} IN ({listed}) THEN {value} ELSE {_text(OTHER)} END" if listed else _text(OTHER)


def fitting_sql(targets: Targets, cells: str) -> list[tuple[str, str]]:
    """Steps (name, SQL) from the table ``cells`` (source, lang, topic, tokens) to the fitted weights ``w``.

    ``<dimension>_ask`` is what a row's category should have by its share, ``<dimension>_want`` what it can have.
    """
    steps = []
    # Shares that hold for the categories present: each row gets the tokens its categories should have.
    columns = []
    for d in DIMENSIONS:
        listed = getattr(targets, d)
        share = " ".join(f"WHEN {_text(k)} THEN CAST({v!r} AS DOUBLE)" for k, v in listed.items())
        share = f"CASE {d} {share} ELSE 0.0 END" if listed else "0.0"
        columns.append(f"{share} AS {d}_share")
    steps.append(("shares", f"SELECT *, CAST(tokens AS DOUBLE) AS t, {', '.join(columns)} FROM {cells}"))
    firsts = ", ".join(
        f"row_number() OVER (PARTITION BY {d} ORDER BY source, lang, topic) AS {d}_n, sum(t) OVER (PARTITION BY {d}) AS {d}_has"
        for d in DIMENSIONS
    )
    steps.append(("firsts", f"SELECT *, {firsts} FROM shares"))
    # Categories that cannot fill their share give all they have; the others divide the rest by their shares.
    # In the order of tokens per share, those that come too short are the first ones.
    order = []
    for d in DIMENSIONS:
        before = f"(ORDER BY {d}_has / nullif({d}_share, 0.0) NULLS LAST, {d}, {d}_n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        one = f"{d}_n = 1 AND {d}_share > 0"
        order.append(
            f"{targets.keep!r} * sum(CASE WHEN {d} <> {_text(OTHER)} THEN t ELSE 0.0 END) OVER () AS {d}_all,"
            f" coalesce(sum(CASE WHEN {one} THEN {d}_has ELSE 0.0 END) OVER {before}, 0.0) AS {d}_before,"
            f" sum(CASE WHEN {one} THEN {d}_share ELSE 0.0 END) OVER () AS {d}_shares,"
            f" coalesce(sum(CASE WHEN {one} THEN {d}_share ELSE 0.0 END) OVER {before}, 0.0) AS {d}_gone"
        )
    steps.append(("ordered", f"SELECT *, {', '.join(order)} FROM firsts"))
    short = ", ".join(
        f"max(CASE WHEN {d}_n = 1 AND {d}_share > 0 AND ({d}_all - {d}_before) * {d}_share > {d}_has * ({d}_shares - {d}_gone)"
        f" THEN 1 ELSE 0 END) OVER (PARTITION BY {d}) AS {d}_short"
        for d in DIMENSIONS
    )
    steps.append(("shorts", f"SELECT *, {short} FROM ordered"))
    wanted = []
    for d in DIMENSIONS:
        given = f"sum(CASE WHEN {d}_n = 1 AND {d}_short = 1 THEN {d}_has ELSE 0.0 END) OVER ()"
        open_shares = f"sum(CASE WHEN {d}_n = 1 AND {d}_short = 0 THEN {d}_share ELSE 0.0 END) OVER ()"
        other = f"CASE WHEN {d} = {_text(OTHER)} THEN {targets.keep!r} * {d}_has"
        wanted.append(f"{other} ELSE coalesce({d}_all * {d}_share / nullif({d}_shares, 0.0), 0.0) END AS {d}_ask")
        wanted.append(
            f"{other} WHEN {d}_short = 1 THEN {d}_has"
            f" ELSE coalesce(({d}_all - {given}) * {d}_share / nullif({open_shares}, 0.0), 0.0) END AS {d}_want"
        )
    steps.append(("wants", f"SELECT source, lang, topic, t, t * {targets.keep!r} AS w, {', '.join(wanted)} FROM shorts"))
    last = "wants"
    keep = ", ".join(f"{d}_ask, {d}_want" for d in DIMENSIONS)
    for i in range(targets.sweeps):
        # Once all three lists hold, the weights stay as they are.
        off = ", ".join(f"abs(sum(w) OVER (PARTITION BY {d}) - {d}_want) / greatest({d}_want, 1.0)" for d in DIMENSIONS)
        steps.append((f"d{i}", f"SELECT source, lang, topic, t, w, {keep}, greatest({off}) AS off FROM {last}"))
        steps.append((f"o{i}", f"SELECT source, lang, topic, t, w, {keep}, max(off) OVER () AS deviation FROM d{i}"))
        last = f"o{i}"
        for d in DIMENSIONS:
            step = f"s{i}_{d}"
            scaled = f"coalesce(w * {d}_want / nullif(sum(w) OVER (PARTITION BY {d}), 0.0), 0.0)"
            if d == DIMENSIONS[-1]:
                scaled = f"least({scaled}, t)"
            held = f"CASE WHEN deviation <= {targets.tolerance!r} THEN w ELSE {scaled} END"
            steps.append((step, f"SELECT source, lang, topic, t, {held} AS w, {keep}, deviation FROM {last}"))
            last = step
    return steps


def _described(targets: Targets, docs: str, columns: str) -> str:
    """Documents with their cell; ``topic`` is worked out from the text."""
    source, lang = cell_of(targets, "source", "source"), cell_of(targets, "lang", "lang")
    topic = cell_of(targets, "topic", "kind")
    words = "length(text) - length(replace(text, ' ', '')) + 1"
    inner = f"SELECT {columns}, source, lang, {targets.topic_sql} AS kind, CAST(coalesce({words}, 1) AS BIGINT) AS tokens FROM {docs}"
    return f"SELECT {columns}, {source} AS source, {lang} AS lang, {topic} AS topic, tokens FROM ({inner}) AS x"


_CELLS = "SELECT source, lang, topic, sum(tokens) AS tokens FROM {} GROUP BY source, lang, topic"


def oracle_sql(targets: Targets) -> str:
    """The drawn documents as one DuckDB statement over the table ``documents``."""
    steps = fitting_sql(targets, "cells")
    ctes = [("d", _described(targets, "documents", "doc_id")), ("cells", _CELLS.format("d")), *steps]
    chance = f"CAST('0x' || substr(md5('{targets.seed}-' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)"
    body = ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in ctes)
    return (
        f"WITH {body} SELECT doc_id, d.source, d.lang, d.topic, d.tokens, round(w / t, 6) AS probability"
        f" FROM d JOIN {steps[-1][0]} USING (source, lang, topic)"
        f" WHERE {chance} / 4503599627370496.0 < w / t"
    )


def _fitted(docs: DataFrame, targets: Targets) -> DataFrame:
    """The last step of ``fitting_sql``, stored; missing columns count as null."""
    spark = docs.sparkSession
    present = {c.lower() for c in docs.columns}
    used = docs.select(
        *[F.col(c) if c in present else F.lit(None).cast("string").alias(c) for c in ("source", "lang", "text")]
    )
    described = spark.sql(_described(targets, "{docs}", "1 AS one"), docs=used)
    cells = materialize(spark.sql(_CELLS.format("{d}"), d=described), "cells")
    steps = fitting_sql(targets, "{cells}")
    # A few sweeps make one plan; their result is stored, as the next ones read it.
    done, size = 0, 5 + 5 * SWEEPS_A_PLAN
    while done < len(steps):
        part = steps[done : done + size]
        before = "cells" if not done else steps[done - 1][0]
        sql = [(name, text if done == 0 else text.replace(f"FROM {before}", "FROM {cells}")) for name, text in part]
        ctes = ", ".join(f"{name} AS ({text})" for name, text in sql)
        cells = materialize(spark.sql(f"WITH {ctes} SELECT * FROM {part[-1][0]}", cells=cells), "fitted")
        done, size = done + len(part), 5 * SWEEPS_A_PLAN
        # The weights are final once the lists held before a sweep.
        if cells.where(F.col("deviation") > targets.tolerance).isEmpty():
            break
    return cells


def fitted_cells(docs: DataFrame, targets: Targets) -> DataFrame:
    """source, lang, topic, t (tokens), w (fitted weight) of every cell."""
    return _fitted(docs, targets).select("source", "lang", "topic", "t", "w")


def marginals(docs: DataFrame, targets: Targets) -> DataFrame:
    """What became of each target: dimension, category, has, asked, wanted, fitted, deviation, missed.

    ``asked`` are the tokens by the given shares, ``wanted`` those that can be had (see ``Targets``), ``fitted`` the sum
    of the weights.  ``deviation`` is (fitted - wanted) / wanted, ``missed`` (fitted - asked) / asked; both null where nothing is wanted or asked.
    """
    return _marginals(_fitted(docs, targets))


def _marginals(cells: DataFrame) -> DataFrame:
    rows = ", ".join(f"'{d}', {d}, {d}_ask, {d}_want" for d in DIMENSIONS)
    listed = cells.selectExpr("t", "w", f"stack({len(DIMENSIONS)}, {rows}) AS (dimension, category, ask, want)")
    sums = listed.groupBy("dimension", "category").agg(
        F.sum("t").alias("has"), F.max("ask").alias("asked"), F.max("want").alias("wanted"), F.sum("w").alias("fitted")
    )
    return sums.selectExpr(
        "*", "(fitted - wanted) / nullif(wanted, 0) AS deviation", "(fitted - asked) / nullif(asked, 0) AS missed"
    )


def _warn_of_missed(cells: DataFrame) -> None:
    """One warning that names the categories more than ``MISSED`` off what was asked; as many rows as categories."""
    rows = _marginals(cells).where(F.abs("missed") > MISSED).orderBy("dimension", "category").collect()
    if rows:
        named = ", ".join(f"{r.dimension} {r.category!r} {100 * r.missed:+.1f} %" for r in rows)
        warnings.warn(f"mixture off its targets: {named}", stacklevel=3)


def draw(docs: DataFrame, targets: Targets, details: bool = False) -> DataFrame:
    """The drawn documents with their own columns (``details``: doc_id, cell, tokens and probability instead).

    ``docs`` needs doc_id, text, source and lang.  Null categories count as
    unlisted, null texts as one token.  Rows that repeat a doc_id are drawn or left together.  An empty table gives none.
    Targets that the fitted weights miss by more than ``MISSED`` are named in a warning; ``marginals`` returns the figures.
    """
    spark = docs.sparkSession
    fitted = _fitted(docs, targets)
    _warn_of_missed(fitted)
    cells = fitted.selectExpr("source as c1", "lang as c2", "topic as c3", "t", "w")
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    inputs = marked.select("row", "row.doc_id", "row.text", "row.source", "row.lang")
    described = spark.sql(_described(targets, "{docs}", "doc_id, row"), docs=inputs)
    joined = described.join(
        F.broadcast(cells), F.expr("source = c1 and lang = c2 and topic = c3")
    )
    hashed = f"md5(concat('{targets.seed}-', coalesce(cast(doc_id as string), '')))"
    chance = F.expr(f"cast(conv(substr({hashed}, 1, 13), 16, 10) as double) / 4503599627370496.0")
    drawn = joined.where(chance < F.expr("w / t"))
    if details:
        return drawn.selectExpr("doc_id", "source", "lang", "topic", "tokens", "round(w / t, 6) as probability")
    return drawn.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


#: Targets of the registered query: a mixture with more of the smaller languages and even sources.
QUERY_TARGETS = Targets(
    source={f"src{i}": 0.05 for i in range(20)},
    lang={"en": 0.55, "de": 0.17, "fr": 0.16, "es": 0.12},
    topic={"prose": 0.85, "list": 0.08, "marked": 0.05, "licence": 0.02},
)
#: Targets of the pipeline: as above, keeping most of what is left.
PIPELINE_TARGETS = Targets(QUERY_TARGETS.source, QUERY_TARGETS.lang, QUERY_TARGETS.topic, keep=0.8)
