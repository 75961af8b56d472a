"""Exact dedup by deterministic block naming.

Normalised texts are cut into blocks of :data:`BLOCK` characters.  Equal blocks get equal integer names
and different ones different names; then adjacent names are paired and the pairs named again, until one
name stands for each document.  Two texts have the same identity only if all their blocks agree.

A name is a pair of integers: the 64-bit hash of what is named, and its rank among the distinct contents
with that hash, sorted.  Whether a hash has two contents is looked up by comparing contents (each
distinct block is shuffled once), so the names hold no collision; and as that is rare, rows
of blocks stay narrow.  Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.session import materialize

#: Characters of a block.
BLOCK = 4096


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def named(rows: DataFrame, content: list[str], hashed: Column | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows with ``hash``, and the ranks of hashes that stand for more than one content.

    The second table (hash, content..., rank) is None where no hash does.
    """
    rows = rows.withColumn("hash", F.xxhash64(*content) if hashed is None else hashed)
    contents = rows.select("hash", *content).distinct()
    # A content is distinct here, so two rows of a hash are a collision.
    twice = contents.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    twice = materialize(twice, "collisions")
    if twice.isEmpty():
        return rows, None
    ranks = contents.join(twice, "hash", "left_semi").selectExpr(
        "hash", *content, f"row_number() over (partition by hash order by {', '.join(content)}) - 1 as rank"
    )
    return rows, materialize(ranks, "ranks")


def with_names(rows: DataFrame, content: list[str], hashed: Column | None = None) -> DataFrame:
    """Rows with the two integers of their content's name, ``hash`` and ``rank``."""
    rows, ranks = named(rows, content, hashed)
    if ranks is None:
        return rows.withColumn("rank", F.lit(0))
    return rows.join(ranks, ["hash", *content], "left").withColumn("rank", F.coalesce("rank", F.lit(0)))


def identities(docs: DataFrame, hash_of: Column | None = None) -> DataFrame:
    """doc_id, text_sha256 and the identity (blocks, hash, rank) of each row.

    ``hash_of`` replaces the hash of a block, for tests of collisions.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text"))
    count = F.ceil(F.greatest(F.length("text"), F.lit(1)) / BLOCK).cast("int")
    blocks = (
        texts.withColumn("row", F.monotonically_increasing_id())
        .withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
        .select("row", "doc_id", "text_sha256", "text", F.posexplode(F.array_repeat(count, count)).alias("pos", "blocks"))
        .withColumn("block", F.substring("text", F.col("pos") * BLOCK + 1, F.lit(BLOCK)))
        .select(
            "row", "pos", "blocks", "block",
            F.when(F.col("pos") == 0, F.col("doc_id")).alias("doc_id"),
            F.when(F.col("pos") == 0, F.col("text_sha256")).alias("text_sha256"),
        )
    )
    first = materialize(with_names(blocks, ["block"], hash_of).drop("block"), "block-names")
    docs = first.where("pos = 0")
    done = docs.where("blocks = 1").select("row", "hash", "rank")
    level = first.where("blocks > 1").select("row", F.col("blocks").alias("names"), "pos", "hash", "rank")
    while not level.isEmpty():
        level = _paired(level)
        done = done.unionByName(level.where("names = 1").select("row", "hash", "rank"))
        level = level.where("names > 1")
    return docs.select("row", "doc_id", "text_sha256", "blocks").join(done, "row").drop("row")


def _paired(level: DataFrame) -> DataFrame:
    """The names of adjacent pairs of names; a last name without a partner pairs with none."""
    half = F.expr("pos div 2").cast("int").alias("pos")
    pairs = level.groupBy("row", "names", half).agg(
        F.expr("min(struct(pos, hash, rank))").alias("l"), F.expr("max(struct(pos, hash, rank))").alias("r")
    )
    pairs = pairs.select(
        "row", F.expr("cast(ceil(names / 2) as int)").alias("names"), "pos",
        F.col("l.hash").alias("h1"), F.col("l.rank").alias("r1"),
        F.expr("if(r.pos = l.pos, 0, r.hash)").alias("h2"), F.expr("if(r.pos = l.pos, -1, r.rank)").alias("r2"),
    )
    content = ["h1", "r1", "h2", "r2"]
    return materialize(with_names(materialize(pairs, "pairs"), content).drop(*content), "pair-names")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when their normalised forms are; null counts as empty.  The row with the
    smallest doc_id stays; a null doc_id stays only where its group has no other.  Rows that repeat
    a doc_id and a text each count in group_size, and are kept or dropped
    together.  Columns other than doc_id and text are ignored; an empty table gives no rows.
    """
    rows = identities(docs)
    name = ["blocks", "hash", "rank"]
    groups = rows.groupBy(*name).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = materialize(groups, "groups")
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return rows.join(groups, name).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
