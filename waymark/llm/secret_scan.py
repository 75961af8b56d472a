"""Secrets in texts: named patterns, and strings that pass a battery of randomness tests.

Patterns give the base spans.  Other strings of 20 or more letters, digits and the signs of base 64 are candidates.  For
each the encoding is inferred from its characters, and three statistics are compared with their exact means and
variances under randomness: the chi-squared distance of the symbol counts from uniform, the number of runs of character
classes (vowels and consonants where there is one class), and the serial correlation of neighbouring symbols.  A
string that any test finds not random is out.  The same statistics are compared with what ordinary strings of that length and
encoding show (:data:`ORDINARY`); joined, they give the probability p that an ordinary string looks this random.  Short strings give
large p, so length is accounted for.  Over the whole table, candidates are tested apart by encoding and length
class (powers of two), and Benjamini and Hochberg's procedure keeps the expected share of false finds below ``fdr`` in each.

Only DataFrame and SQL functions are used.  Texts are scanned once and not shuffled; candidates are rows of some 60 bytes, the
procedure runs on counts of p rounded up to tenths of a power of ten, at most 301 for each class.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.session import materialize


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: kind -> pattern; ``assign`` counts where its second group has :data:`ASSIGNED` characters.
PATTERNS = {
    "assign": rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "random": r"[A-Za-z0-9+/_-]{20,}={0,2}",
}
KINDS = list(PATTERNS)
ASSIGNED = 6
#: Characters that cannot stand before a match, as a match is whole: saves trying every place of a word.
_BEFORE = {"hex": "(?<![0-9a-f])", "random": "(?<![A-Za-z0-9+/_-])"}
#: Fewest symbols a tested string has.
SHORTEST = 20

#: encoding -> sizes of its character classes; where there is one class, of vowels and consonants.
CLASSES = {
    "hex": (6, 10), "base32": (26, 6), "base36": (26, 10), "lower": (6, 20), "upper": (6, 20),
    "letters": (26, 26), "base62": (26, 26, 10), "base64": (26, 26, 10, 2),
}
_ONE_CLASS = ("lower", "upper")
#: What ordinary strings show: probability that two symbols agree (at least 1.7 times the random one), relative variance of a
#: symbol's own share of it, probability that neighbours differ in class (one class: vowel or consonant), serial correlation.
ORDINARY = {"agree": 0.06, "lift": 1.7, "uneven": 0.25, "change": 0.2, "change_vowels": 0.6, "serial": 0.3}
#: Correlation allowed for between the three statistics of a string.
DEPENDENCE = 0.3
#: Standard deviations at which a randomness test rejects.
REJECT = 3.0
#: Steps of p to a power of ten, and the last step.
STEPS, LAST_STEP = 10, 300


def _running(lengths: str) -> str:
    """SQL: running sums of an array column, in blocks so that long arrays take no quadratic time."""
    blocks = f"transform(sequence(0, greatest(size({lengths}) - 1, 0) div 256), b -> slice({lengths}, b * 256 + 1, 256))"
    add = "aggregate({0}, array({1}), (a, x) -> concat(a, array(element_at(a, -1) + x)))"
    sums = f"transform({blocks}, b -> aggregate(b, 0L, (a, x) -> a + x))"
    inner = f"slice({add.format('b', 'o')}, 2, 256)"
    return f"flatten(zip_with({blocks}, {add.format(sums, '0L')}, (b, o) -> if(b is null, array(), {inner})))"


def _spans(texts: DataFrame) -> DataFrame:
    """row, doc_id and, for each kind, an array of (start, end, found) in code points, end exclusive."""
    text, scanned = F.col("text"), texts
    for kind, pattern in PATTERNS.items():
        whole = F.lit(_BEFORE.get(kind, "") + pattern)
        hit = F.rlike(text, whole)
        # Of an assignment the second group is kept, elsewhere the match.
        found = F.regexp_extract_all(text, whole, F.lit(0))
        held = F.regexp_extract_all(text, whole, F.lit(2)) if kind == "assign" else found
        scanned = scanned.withColumns({
            f"{kind}_m": F.when(hit, found),
            f"{kind}_g": F.when(hit, held),
            f"{kind}_p": F.when(hit, F.split(text, _BEFORE.get(kind, "") + pattern, -1)),
        })
    steps = {}
    for kind in PATTERNS:
        # The text between matches and each match, in turn.
        both = f"flatten(zip_with({kind}_m, slice({kind}_p, 1, size({kind}_m)), (m, p) -> array(length(p), length(m))))"
        steps[f"{kind}_n"] = F.expr(f"transform({both}, n -> bigint(n))")
    measured = scanned.withColumns(steps).drop("text", *[f"{k}_p" for k in PATTERNS])
    measured = measured.withColumns({f"{k}_e": F.expr(_running(f"{k}_n")) for k in PATTERNS})
    out = []
    for kind in PATTERNS:
        span = f"struct({kind}_e[2 * i] as start, {kind}_e[2 * i + 1] as end, {kind}_g[i] as found)"
        all_of = f"transform(sequence(0, size({kind}_m) - 1), i -> {span})"
        out.append(F.expr(f"if(size({kind}_m) > 0, {all_of}, array())").alias(kind))
    return measured.select("row", "doc_id", *out)


def _fixed(values: dict[str, float]) -> str:
    """SQL: the number of the row's encoding."""
    return "case encoding " + " ".join(f"when '{e}' then {v!r}d" for e, v in values.items()) + " end"


def _class_moments(sizes: tuple[int, ...]) -> tuple[float, float]:
    """Of random neighbours: probability to differ in class, and the covariance of two overlapping pairs."""
    shares = [s / sum(sizes) for s in sizes]
    change = 1 - sum(p * p for p in shares)
    return change, sum(p * (1 - p) ** 2 for p in shares) - change**2


#: SQL steps from ``found`` to ``bin``, each a level of columns; the oracle of the query runs the same ones.
#: {regex} tests a whole string, {collapse} shortens runs of a class, both differ between engines.
def battery(engine: str = "spark") -> list[dict[str, str]]:
    """name -> SQL of the columns, level by level, that lead from ``found`` to ``encoding``, ``n`` and ``bin``."""
    spark = engine == "spark"
    sub = (lambda c, p, r: f"regexp_replace({c}, '{p}', '{r}')") if spark else (lambda c, p, r: f"regexp_replace({c}, '{p}', '{r}', 'g')")
    like = (lambda c, p: f"({c} rlike '{p}')") if spark else (lambda c, p: f"regexp_matches({c}, '{p}')")
    symbols = "split(sym, '')" if spark else "string_split(sym, '')"
    each = (lambda c, body: f"transform({c}, x -> {body})") if spark else (lambda c, body: f"list_transform({c}, lambda x: {body})")
    total = (lambda c: f"aggregate({c}, 0L, (a, x) -> a + x)") if spark else (lambda c: f"coalesce(list_sum({c}), 0)")
    distinct = "array_distinct" if spark else "list_distinct"
    code = "ascii(x)" if spark else "unicode(x)"
    size = "size" if spark else "len"
    pairs = (
        "zip_with(slice(codes, 1, size(codes) - 1), slice(codes, 2, size(codes)), (a, b) -> a * b)"
        if spark
        else "list_transform(list_zip(codes[1:len(codes)-1], codes[2:]), lambda p: p[1] * p[2])"
    )
    number = "bigint" if spark else "CAST"
    big = (lambda x: f"{number}({x})") if spark else (lambda x: f"CAST({x} AS BIGINT)")
    real = (lambda x: f"double({x})") if spark else (lambda x: f"CAST({x} AS DOUBLE)")
    log10 = "log10"
    kinds = {e: float(sum(s)) for e, s in CLASSES.items()}
    agree = {e: max(ORDINARY["agree"], ORDINARY["lift"] / k) for e, k in kinds.items()}
    moments = {e: _class_moments(s) for e, s in CLASSES.items()}
    fixed = _fixed if spark else (lambda v: _fixed(v).replace("d when", " when").replace("d end", " end"))
    single = "encoding in ('" + "', '".join(_ONE_CLASS) + "')"
    o = ORDINARY
    collapsed = sub(sub(sub(sub("sym", "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "[^A-Za-z0-9]+", "-")
    voiced = sub(sub("lower(sym)", "[aeiouy]+", "0"), "[a-z]+", "1")
    parts = f"(case when {single} then 2.0 else 3.0 end)" if not spark else f"if({single}, 2d, 3d)"
    share = repr(DEPENDENCE)
    return [
        {"core": sub("found", "=+$", "")},
        {"bare": sub("core", "[-_]", "")},
        {
            "encoding": "case "
            + f"when {like('bare', '^[0-9]*$')} then null "
            + f"when {like('bare', '^([0-9a-f]+|[0-9A-F]+)$')} then 'hex' "
            + f"when {like('core', '^[a-z]+$')} then 'lower' when {like('core', '^[A-Z]+$')} then 'upper' "
            + f"when {like('core', '^[A-Z2-7]+$')} then 'base32' "
            + f"when {like('core', '^([a-z0-9]+|[A-Z0-9]+)$')} then 'base36' "
            + f"when {like('core', '^[A-Za-z]+$')} then 'letters' when {like('core', '^[A-Za-z0-9]+$')} then 'base62' "
            + f"when not {like('core', '[-_]')} or not {like('core', '[+/]')} then 'base64' end"
        },
        {"sym": "case when encoding = 'hex' then bare else core end"},
        {
            "n": real("length(sym)"),
            "codes": each(symbols, big(code)),
            "counts": each(f"{distinct}({symbols})", big("length(sym) - length(replace(sym, x, ''))")),
            "changes": real(f"(case when {single} then length({voiced}) else length({collapsed}) end) - 1"),
            "k": fixed(kinds),
            "q": fixed({e: m[0] for e, m in moments.items()}),
            "q2": fixed({e: m[1] for e, m in moments.items()}),
            "agree": fixed(agree),
        },
        {
            "alike": real(total(each("counts", "x * (x - 1)"))),
            "s1": real(total("codes")),
            "s2": real(total(each("codes", "x * x"))),
            "s12": real(total(pairs)),
            "ends": real(f"codes[{0 if spark else 1}] + codes[{size}(codes){' - 1' if spark else ''}]"),
        },
        {"spread": "s2 - s1 * s1 / n", "product": "s12 - s1 / n * (2 * s1 - ends) + (n - 1) * (s1 / n) * (s1 / n)"},
        {"serial": "case when spread > 0 then product / spread else 1.0 end"},
        {
            "z_chi": "(k / n * (alike + n) - n - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n)",
            "z_runs": "(changes - (n - 1) * q) / sqrt((n - 1) * q * (1 - q) + 2 * (n - 2) * q2)",
            "z_serial": "(serial + 1 / n) * sqrt(n)",
            "o_chi": f"(n * (n - 1) * agree - alike) / (2 * sqrt(n * (n - 1) / 2 * agree * (1 - agree) + n * (n - 1) * (n - 2) * agree * agree * {o['uneven']!r}))",
            "o_runs": f"case when {single} then ((n - 1) * {o['change_vowels']!r} - changes) / sqrt((n - 1) * {o['change_vowels'] * (1 - o['change_vowels'])!r}) "
            f"else (changes - (n - 1) * {o['change']!r}) / sqrt((n - 1) * {o['change'] * (1 - o['change'])!r}) end",
            "o_serial": f"case when {single} then 0.0 else ({o['serial']!r} - serial) * sqrt(n) end",
        },
        {"z": f"(o_chi + o_runs + o_serial) / sqrt({parts} + {parts} * ({parts} - 1) * {share})"},
        {
            # The tail of the normal distribution within 0.3 %; p of one half and more is step 0.
            "tail": "case when z > 0 then z * z / 2 / ln(10.0) + "
            f"{log10}({math.sqrt(2 * math.pi)!r} * (0.661 * z + 0.339 * sqrt(z * z + 5.51))) else 0.0 end",
            "rejected": f"z_chi > {REJECT!r} or abs(z_runs) > {REJECT!r} or abs(z_serial) > {REJECT!r}",
        },
        {
            "bin": (f"int(case when rejected then 0 else least(floor(tail * {STEPS}), {LAST_STEP}) end)" if spark
                    else f"CAST(case when rejected then 0 else least(floor(tail * {STEPS}), {LAST_STEP}) end AS INTEGER)"),
            "size_class": ("int(floor(log2(n)))" if spark else "CAST(floor(log2(n)) AS INTEGER)"),
        },
    ]


def _levels(df: DataFrame) -> DataFrame:
    for level in battery():
        df = df.withColumns({name: F.expr(sql) for name, sql in level.items()})
        if "encoding" in level:
            df = df.where("encoding is not null")
        if "n" in level:
            df = df.where(f"n >= {SHORTEST}")
    return df


def thresholds(candidates: DataFrame, fdr: float) -> DataFrame:
    """encoding, size_class, least: the smallest step of p that is a find in each class (none where nothing is)."""
    counts = candidates.groupBy("encoding", "size_class", "bin").agg(F.count("*").alias("c"))
    ranked = counts.selectExpr(
        "encoding", "size_class", "bin",
        "sum(c) over (partition by encoding, size_class order by bin desc) as at_most",
        "sum(c) over (partition by encoding, size_class) as tested",
    )
    found = ranked.where(f"bin > 0 and pow(10d, -bin / {STEPS}d) <= {fdr!r}d * at_most / tested")
    return found.groupBy("encoding", "size_class").agg(F.min("bin").alias("least"))


def secret_spans(docs: DataFrame, fdr: float = 0.01) -> DataFrame:
    """doc_id and ``secrets``, an array of (kind, start, end) by start, then kind as in :data:`KINDS`.

    Every row of ``docs`` gives one row, repeated and null ids too; null and empty texts have no secrets.  Places are code
    points of the whole text, the end exclusive.  ``assign``, ``access`` and ``hex`` are the leftmost matches of their
    patterns that do not overlap; ``random`` are strings that passed the tests and lie in none of those.  Strings of digits
    alone, and those with signs of both base-64 alphabets, have no encoding to test and are never ``random``.  Whether a string is a
    find depends on the table's other candidates, not on their order.  Columns other than doc_id and text are ignored.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    spans = _spans(texts)
    base = [f"transform(filter(assign, x -> length(x.found) >= {ASSIGNED}), x -> struct(x.start, 0 as rank, x.end))"]
    base += [f"transform({kind}, x -> struct(x.start, {rank} as rank, x.end))" for rank, kind in enumerate(KINDS) if kind in ("access", "hex")]
    spans = spans.select("row", "doc_id", "random", F.expr(f"concat({', '.join(base)})").alias("base"))
    spans = materialize(spans, "spans")

    inside = "exists(base, x -> x.start <= c.start and c.end <= x.end)"
    candidates = spans.where("size(random) > 0").select("row", F.expr(f"explode(filter(random, c -> not {inside})) as c"))
    candidates = _levels(candidates.select("row", "c.*")).select("row", "start", "end", "encoding", "size_class", "bin")
    candidates = materialize(candidates, "candidates")
    kept = candidates.join(materialize(thresholds(candidates, fdr), "thresholds"), ["encoding", "size_class"]).where("bin >= least")
    added = kept.groupBy("row").agg(F.expr(f"collect_list(struct(start, {KINDS.index('random')} as rank, end))").alias("more"))

    named = "element_at(array('" + "', '".join(KINDS) + "'), x.rank + 1)"
    every = "array_sort(concat(base, coalesce(more, array())))"
    return spans.join(added, "row", "left").select(
        "doc_id", F.expr(f"transform({every}, x -> struct({named} as kind, x.start as start, x.end as end))").alias("secrets")
    )


def oracle_sql(fdr: float = 0.01) -> str:
    """The query of this operator for DuckDB: spans by ranks and running sums, the battery by the same formulas."""
    quoted = {k: "'" + p.replace("'", "''") + "'" for k, p in PATTERNS.items()}
    found = " UNION ALL ".join(
        f"SELECT row, {rank} AS kind, unnest(m) AS found, unnest(g) AS held, unnest(s) AS before, generate_subscripts(m, 1) AS i FROM ("
        f"SELECT row, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {2 if k == 'assign' else 0}) AS g, "
        f"string_split_regex(text, {p})[1:len(regexp_extract_all(text, {p}))] AS s FROM t WHERE regexp_matches(text, {p})) AS x{rank}"
        for rank, (k, p) in enumerate(quoted.items())
    )
    levels, last = [], "cand"
    for i, level in enumerate(battery("duckdb")):
        columns = ", ".join(f"{sql} AS {name}" for name, sql in level.items())
        levels.append(f"l{i} AS (SELECT *, {columns} FROM {last})")
        last = f"l{i}"
    names = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS))
    label = f"CASE kind {names} END || ':' || start || ':' || stop"
    joined = f"coalesce(string_agg({label}, ',' ORDER BY start, kind)"
    return f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({found}),
e AS (SELECT *, sum(length(before) + length(found)) OVER (PARTITION BY row, kind ORDER BY i) AS stop FROM f),
spans AS (SELECT row, kind, CAST(stop - length(found) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, found, length(held) AS wide FROM e),
base AS (SELECT row, kind, start, stop FROM spans WHERE kind IN (1, 2) OR (kind = 0 AND wide >= {ASSIGNED})),
cand AS (SELECT row, start, stop, found FROM spans AS s WHERE kind = 3
 AND NOT EXISTS (SELECT 1 FROM base AS b WHERE b.row = s.row AND b.start <= s.start AND s.stop <= b.stop)),
{", ".join(levels)},
tested AS (SELECT row, start, stop, encoding, size_class, bin FROM {last} WHERE encoding IS NOT NULL AND n >= {SHORTEST}),
counts AS (SELECT encoding, size_class, bin, count(*) AS c FROM tested GROUP BY ALL),
ranked AS (SELECT *, sum(c) OVER (PARTITION BY encoding, size_class ORDER BY bin DESC) AS at_most,
 sum(c) OVER (PARTITION BY encoding, size_class) AS tested FROM counts),
least_bin AS (SELECT encoding, size_class, min(bin) AS least FROM ranked
 WHERE bin > 0 AND pow(10.0, -bin / {STEPS}.0) <= {fdr!r} * at_most / tested GROUP BY ALL),
every AS (SELECT * FROM base UNION ALL
 SELECT row, 3 AS kind, start, stop FROM tested JOIN least_bin USING (encoding, size_class) WHERE bin >= least)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
 sha256({joined} FILTER (kind < 3), '')) AS base_sha256, {joined}, '') AS spans
FROM t LEFT JOIN every USING (row) GROUP BY row, doc_id
""".strip()
