"""Line dedup: exact set-similarity join of lines with prefix, positional and length filters.

A line is the set of its words.  A line goes when an *earlier* line (by doc_id,
then line number) has Jaccard similarity of ``num / den`` or more with it, whether or not the earlier one stays
itself.  Only DataFrame and SQL functions are used.

1. Words are counted in ``2 ** RARITY_BITS`` hashed counters; the classes of the counters order words by rarity.
   The classes are one stored row of bytes that stages read as a scalar subquery.
2. Equal lines are joined by partial aggregation, so a line that many documents repeat is one row per task.
   The first ``n - ceil(n * num / den) + 1`` words of each distinct line, rarest first, are its prefix;
   similar lines share a prefix word.
3. Lines meet at a prefix word.  First each is held against the earliest line that shares leading words of
   its prefix's commonest class (found by partial aggregation), which settles groups of many variants in a few comparisons each; what stays open is
   joined with all earlier lines of each prefix word.  Length and positional filters, and the differing bits of two
   64-bit parities of the word sets, are part of the join, so only likely pairs leave it.
4. Pairs that pass are verified on all words of both lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import BROADCAST_BYTES, free_name, semi_join
from waymark.session import materialize

#: Counters of word rarity: a fixed size, whatever the vocabulary.
RARITY_BITS = 22
#: Counters whose classes one task puts in a row.
_ROW_BITS = 12
#: Lines of fewer distinct words are never compared; 1 leaves out lines without a word only.
MIN_WORDS = 1
#: Words of a prefix at which a line is held against the earliest one first: the first ones of its commonest class, which
#: variants of one line share however many rare words their edits have brought in.
LEADING = 5



def _words(text: str) -> str:
    """SQL: the words of a text column.

    White space becomes spaces by plain replacement, which costs little where there is none, and a
    split at one plain character needs no regular expression.
    """
    for blank in ("\\t", "\\n", "\\r", "\x0b", "\x0c"):
        text = f"replace({text}, '{blank}', ' ')"
    return f"array_remove(split({text}, ' '), '')"


_HASHES = f"array_distinct(transform({_words('line')}, w -> xxhash64(w)))"


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line of all lines of rows with an id and a text."""
    known = docs.where("doc_id is not null and text is not null")
    return known.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def _rarity(docs: DataFrame) -> Column:
    """Rarity classes (log2 of the count) by hashed counter: one byte each, as a scalar subquery on a stored row.

    ``2 ** RARITY_BITS`` bytes for any corpus.  No plan holds them: Spark fetches the row when the stage that uses it starts.
    """
    size, row = 1 << RARITY_BITS, 1 << _ROW_BITS
    words = docs.select(F.explode(F.expr(_words("text"))).alias("w"))
    counts = words.selectExpr(f"xxhash64(w) & {size - 1} as counter").groupBy("counter").count()
    classes = counts.selectExpr(
        f"counter div {row} as part",
        f"struct(int(counter % {row}) as at, char(48 + int(floor(log2(count + 1)))) as class) as c",
    )
    # Empty counters are class 0; rows of counters are put together in many tasks, then the rows in one.
    before = "if(i = 0, -1, get(held, i - 1).at)"
    spelt = f"array_join(transform(held, (c, i) -> concat(repeat('0', c.at - {before} - 1), c.class)), '')"
    spelt = classes.groupBy("part").agg(F.sort_array(F.collect_list("c")).alias("held")).selectExpr(
        "part", f"rpad({spelt}, {row}, '0') as classes"
    )
    parts = docs.sparkSession.range(size // row).withColumnRenamed("id", "part")
    every = parts.join(spelt, "part", "left").select(
        F.struct("part", F.coalesce("classes", F.lit("0" * row)).alias("classes")).alias("c")
    )
    table = every.agg(F.expr("cast(array_join(transform(sort_array(collect_list(c)), c -> c.classes), '') as binary)"))
    return materialize(table.toDF("classes"), "rarity").scalar()


def _described(docs: DataFrame, rarity: Column, num: int, den: int, min_words: int) -> DataFrame:
    """Distinct lines: t1, t2 (hashes of the line), first place, copies, n words, parity, prefix."""
    mask = (1 << RARITY_BITS) - 1
    # A word as a long that sorts by rarity first.
    named = f"h -> shiftleft(bigint(ascii(string(substring(classes, int(h & {mask}) + 1, 1))) - 48), 57) | shiftrightunsigned(h, 7)"
    need = f"cast(ceil(n * {num} / {den}) as int)"
    # In the join a word is 31 bits of its hash: two words that share them make a pair more to verify.
    short = "t -> cast(t & 2147483647 as int)"
    return (
        _lines(docs)
        .withColumn("hashes", F.expr(_HASHES))
        .withColumn("n", F.size("hashes"))
        .withColumn("classes", rarity)
        .withColumn("tokens", F.expr(f"sort_array(transform(hashes, {named}))"))
        .selectExpr(
            "xxhash64(line) as t1",
            "xxhash64(line, 7) as t2",
            "struct(doc_id, pos) as place",
            "n",
            "aggregate(hashes, 0L, (a, h) -> a ^ shiftleft(1L, cast(h & 63 as int))) as parity",
            f"transform(slice(tokens, 1, n - {need} + 1), {short}) as prefix",
            # Tokens are sorted, so those of a class before the prefix's last are in the prefix.
            f"size(filter(slice(tokens, 1, n - {need}), t -> shiftright(t, 57) < shiftright(get(tokens, n - {need}), 57))) as lead",
        )
        .groupBy("t1", "t2")
        .agg(
            F.min("place").alias("place"), F.count("*").alias("copies"),
            F.first("n").alias("n"), F.first("parity").alias("parity"), F.first("prefix").alias("prefix"),
            F.first("lead").alias("lead"),
        )
        # Asked before, it would make every word be hashed twice.
        .where(F.col("n") >= max(min_words, 1))
    )


def _passes(num: int, den: int, a: str, b: str) -> str:
    """Condition on two lines that share the prefix words at a.i and b.i.

    Length: the larger is at most den / num times the smaller.  Position: from the shared
    words on, enough words must follow for an overlap of (a.n + b.n) * num / (num + den).  Parity: each
    bit in which two parities differ stands for a word of one side only.
    """
    return (
        f"{a}.n * {den} >= {b}.n * {num} and {b}.n * {den} >= {a}.n * {num}"
        f" and least({a}.n - {a}.i, {b}.n - {b}.i) * {num + den} >= ({a}.n + {b}.n) * {num}"
        f" and bit_count({a}.parity ^ {b}.parity) * {num + den} <= ({a}.n + {b}.n) * {den - num}"
    )


def removed_lines(docs: DataFrame, num: int = 4, den: int = 5, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, pos (from 0) of every line that goes."""
    if not 0 < num <= den:
        raise ValueError("the threshold is a fraction above 0")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    distinct = materialize(_described(docs, _rarity(docs), num, den, min_words), "distinct-lines")
    leading = F.posexplode(F.expr(f"slice(prefix, lead + 1, {LEADING})")).alias("j", "token")
    prefix = distinct.select("place", "n", "parity", "lead", leading).withColumn("i", F.col("lead") + F.col("j"))

    # The earliest line at each of the leading words of a prefix.
    common = prefix.select("token", F.struct("place", "n", "parity", "i").alias("b"))
    first = common.groupBy("token").agg(F.min("b").alias("a"))
    likely = common.join(first, "token").where("a.place < b.place").where(_passes(num, den, "a", "b"))
    settled = materialize(_verified(docs, likely.selectExpr("a.place as a", "b.place as b"), num, den), "settled")

    # What is settled looks for no more; its place is still one that later lines can match.
    done = settled.select(F.col("b").alias("place"), F.lit(1).alias("done"))
    marked = distinct.join(_small(done, 64), "place", "left").select(
        "place.doc_id",
        "place.pos",
        F.coalesce("done", F.lit(0)).alias("done"),
        "n",
        "parity",
        "prefix",
        F.posexplode("prefix").alias("i", "token"),
    )
    marked = marked.selectExpr("doc_id", "pos", "done", "n", "parity", "i", "token", "if(i > 0, get(prefix, i - 1), -1) as before")
    # Both sides are one table, shuffled once.  That b is open is said together with a.i and a.done (never
    # negative): on its own it would be pushed below the shuffle of b, which would then be a second one, and so it
    # would be if one side needed a column that the other doesn't.
    earlier = "(a.doc_id < b.doc_id or a.doc_id = b.doc_id and a.pos < b.pos) and b.done <= least(a.i, a.done, 0)"
    # Two lines with the same word before this one meet there, where the positional filter lets no less pass.
    once = "(a.before <> b.before or a.before < 0)"
    on = f"a.token = b.token and {earlier} and {once} and {_passes(num, den, 'a', 'b')}"
    pairs = marked.alias("a").join(marked.alias("b"), F.expr(on))
    place = "struct({0}.doc_id, {0}.pos) as {0}"
    found = _verified(docs, pairs.selectExpr(place.format("a"), place.format("b")), num, den)
    near = settled.unionByName(materialize(found, "found")).select("b.doc_id", "b.pos")

    # Copies of a line other than its first.
    raw = _lines(docs).selectExpr("doc_id", "pos", "xxhash64(line) as t1", "xxhash64(line, 7) as t2")
    firsts = materialize(distinct.where("copies > 1").select("t1", "t2", "place"), "repeated-lines")
    copies = raw.join(_small(firsts, 48), ["t1", "t2"]).where("struct(doc_id, pos) > place").select("doc_id", "pos")
    return near.unionByName(copies)


def _small(stored: DataFrame, row: int) -> DataFrame:
    """A stored table, to be broadcast if its counted rows of ``row`` bytes fit."""
    return F.broadcast(stored) if stored.count() * row <= BROADCAST_BYTES else stored


def _verified(docs: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The later places b for which one pair (a, b) of places holds on all words.

    Each b is held against its earliest a first; all other pairs of what that leaves open come after.  So a
    group of many variants of one line ships its words once a line, not once a pair.
    """
    pairs = materialize(pairs.distinct(), "line-pairs")
    places = materialize(pairs.select(F.col("a").alias("place")).union(pairs.select("b")).distinct(), "places")
    lines = _lines(docs).withColumn("place", F.struct("doc_id", "pos"))
    sets = semi_join(lines, places, "place").select("place", F.expr(_HASHES).alias("tokens"))
    bit = "a ^ shiftleft(1L, cast(shiftright(h, 6) & 63 as int))"
    parities = [f"aggregate(tokens, 0L, (a, h) -> if(shiftright(h, 12) & 3 = {k}, {bit}, a)) as p{k}" for k in range(4)]
    sets = materialize(sets.selectExpr("place", "tokens", "size(tokens) as n", *parities), "line-sets")

    def likely(some: DataFrame) -> DataFrame:
        """Pairs whose parities of 256 bits differ in no more bits than the sets may in words: few others ship their words."""
        a, b = (sets.selectExpr(f"place as {x}", f"struct(n, p0, p1, p2, p3) as s{x}") for x in "ab")
        bits = " + ".join(f"bit_count(sa.p{k} ^ sb.p{k})" for k in range(4))
        near = some.join(a, "a").join(b, "b").where(f"({bits}) * {num + den} <= (sa.n + sb.n) * {den - num}")
        return materialize(near.select("a", "b"), "likely-pairs")

    def holds(some: DataFrame) -> DataFrame:
        left = sets.select(F.col("place").alias("a"), F.col("tokens").alias("ta"))
        right = sets.select(F.col("place").alias("b"), F.col("tokens").alias("tb"))
        common = "size(array_intersect(ta, tb))"
        both = likely(some).join(left, "a").join(right, "b")
        return both.where(f"{common} * {num + den} >= (size(ta) + size(tb)) * {num}").select("b").distinct()

    firsts = materialize(pairs.groupBy("b").agg(F.min("a").alias("a")), "first-pairs")
    settled = materialize(holds(firsts), "first-settled")
    rest = materialize(pairs.join(settled, "b", "left_anti").join(firsts, ["a", "b"], "left_anti"), "open-pairs")
    return settled if rest.isEmpty() else settled.unionByName(holds(rest))


def without_repeated_lines(
    docs: DataFrame, num: int = 4, den: int = 5, min_words: int = MIN_WORDS, removed: str | None = None
) -> DataFrame:
    """The documents with their repeated lines taken out of ``text``; no row goes.

    Lines end at a line feed.  Those of fewer than ``min_words`` distinct words, by default those without any,
    stay.  Null and empty texts, and rows with a null doc_id, stay as they are; of rows that repeat a
    doc_id, the lines with one number count as equally early, and go together.  Other columns pass
    through; ``removed`` names a column to add, the number of lines taken out.  A text that loses all lines is empty.
    """
    gone = removed_lines(docs, num, den, min_words)
    by_doc = materialize(gone.groupBy("doc_id").agg(F.collect_set("pos").alias("gone")), "gone-lines")
    size = by_doc.agg(F.sum(F.size("gone") * 4 + 32)).first()[0] or 0
    key = free_name(docs.columns, "line_doc")
    lost = free_name([*docs.columns, key], "gone_lines")
    by_doc = by_doc.withColumnsRenamed({"doc_id": key, "gone": lost})
    small = F.broadcast(by_doc) if size <= BROADCAST_BYTES else by_doc
    joined = docs.join(small, docs["doc_id"].cast("long") == by_doc[key], "left")
    kept = f"array_join(filter(split(text, '\\n'), (line, i) -> not array_contains({lost}, i)), '\\n')"
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.expr(kept)).alias("text")
    columns = [text if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    if removed:
        columns.append(F.coalesce(F.size(lost), F.lit(0)).alias(removed))
    return joined.select(*columns)
