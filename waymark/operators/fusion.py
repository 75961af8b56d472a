"""Fair fusion of ranked lists, and position numbering that splits large groups."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark import fixed_values as V
from waymark.functions.urls import url_key
from waymark.session import materialize

#: Entities with more rows than this are kept out of the one-shuffle path.
HOT_ROWS = 1_000_000
#: Entities a task's sketch of frequent ones tracks; any with more than about 0.02 % of all rows is found.
TRACKED = 16_384
_MOST_HOT = 1000
#: Groups of tasks whose sketches are merged first, so that none merges those of all tasks.
_SKETCH_GROUPS = 256

#: Rows of small entities that one task brings together, about; each takes some 0.5 kB there.
TASK_ROWS = 500_000

# Above this limit Spark no longer cuts a top-k window before its shuffle.
_PUSHED_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    out: str,
) -> DataFrame:
    """Exact ``row_number`` (from 1) per group without one task per group.

    Rows are dealt to partitions by range of (group, order) and stored with their
    partition, so a huge group spreads over many, whatever its values look like.  Its
    rows in each partition are counted with partial aggregation and summed up to offsets;
    then rows are numbered inside their own partition's share.
    """
    keys = [*group, "_part"]
    ranged = df.repartitionByRange(*[F.col(g) for g in group], *order)
    sliced = materialize(ranged.withColumn("_part", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        sliced.groupBy(*keys)
        .agg(F.count("*").alias("_size"))
        .select(
            *[F.col(k).alias(f"_of_{i}") for i, k in enumerate(keys)],
            F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        )
    )
    # null keys form a group too
    same = [F.col(k).eqNullSafe(F.col(f"_of_{i}")) for i, k in enumerate(keys)]
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        sliced.join(offsets, same)
        .withColumn(out, F.col("_offset") + F.row_number().over(inside))
        .select(*[c for c in df.columns if c != out], out)
    )


class HotEntities(list):
    """Entities that hold many rows, with the number of rows of the table they were looked for in."""

    rows: int = 0


def hot_entities(df: DataFrame, entity: str = "entity_id", rows: int = HOT_ROWS) -> HotEntities:
    """Entities that hold more than ``rows`` rows, null included, by one pass over their column; at most 1,000.

    A sketch of frequent items is built in each task; they are merged in groups, then the groups' are, so no task
    reads a sketch of every other.  It may miss an entity with less than about 0.02 % of all rows, never one with more; there are fewer than
    5,000 of those, and the most frequent are taken.  ``entity`` must be of a type a literal can have.
    """
    grouped = df.select(entity, (F.spark_partition_id() % _SKETCH_GROUPS).alias("_group"))
    sketch = F.expr(f"approx_top_k_accumulate(`{entity}`, {TRACKED})").alias("_sketch")
    nulls = F.count_if(F.col(entity).isNull()).alias("nulls")
    parts = grouped.groupBy("_group").agg(sketch, nulls, F.count("*").alias("rows"))
    # grouped by a constant, as there is no sketch of no rows
    merged = parts.groupBy(F.lit(0).alias("_all")).agg(
        F.expr(f"approx_top_k_combine(_sketch, {TRACKED})").alias("_sketch"), F.sum("nulls").alias("nulls"), F.sum("rows").alias("rows")
    )
    found = merged.select(F.expr(f"approx_top_k_estimate(_sketch, {_MOST_HOT})").alias("top"), "nulls", "rows").first()
    if found is None:
        return HotEntities()
    hot = HotEntities(i["item"] for i in found["top"] or [] if i["count"] > rows and i["item"] is not None)
    if found["nulls"] > rows:
        hot.append(None)
    hot.rows = found["rows"]
    return hot


def fuse_ranked_lists(
    df: DataFrame,
    entity: str = "entity_id",
    list_idx: str = "list_idx",
    pos: str = "pos",
    key: str = "url",
    limit: int | None = V.MAX_CANDIDATES,
    hot: Sequence | None = None,
) -> DataFrame:
    """Interleave each entity's ranked lists, first of each URL kept, cut to ``limit``.

    The round-by-round visit is the order (pos, list_idx); URLs compare
    stripped and lowercased, blank ones are skipped after they took their
    position.  Adds ``rank`` from 1.  ``limit=None`` keeps everything.

    Both rank filters are top-k windows which Spark also applies before the
    shuffle, so a huge entity sends at most one row per URL, then at most
    ``limit`` rows, from each task.

    That takes two shuffles.  ``hot`` names the entities that need them (see
    ``hot_entities``; empty if every entity is known to be small): all others are
    then brought together by one shuffle, and both filters run where their rows lie.  The rows are the same.
    As ``hot_entities`` returns it, the list tells the table's size too, and that shuffle has partitions of about ``TASK_ROWS`` rows.
    """
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    if hot is not None and _cut_early(df, limit):
        names = (entity, list_idx, pos, key, limit)
        tasks = math.ceil(getattr(hot, "rows", 0) / TASK_ROWS)
        # a number that is given is kept: partitions are not joined by their compressed size
        parts = [max(tasks, df.sparkSession.sparkContext.defaultParallelism)] if tasks > 1 else []
        if not hot:
            return _fuse(df.repartition(*parts, entity), *names)
        listed = F.col(entity).isin([h for h in hot if h is not None])
        large = F.when(F.col(entity).isNull(), F.lit(None in hot)).otherwise(listed)
        small = _fuse(df.filter(~large).repartition(*parts, entity), *names)
        return small.unionByName(_fuse(df.filter(large), *names))
    return _fuse(df, entity, list_idx, pos, key, limit)


def _cut_early(df: DataFrame, limit: int | None) -> bool:
    """Whether Spark cuts a top-k window of this size before its shuffle."""
    return limit is not None and limit <= int(df.sparkSession.conf.get(_PUSHED_LIMIT, "1000"))


def _fuse(
    df: DataFrame, entity: str, list_idx: str, pos: str, key: str, limit: int | None
) -> DataFrame:
    visit = [F.col(pos), F.col(list_idx)]
    copies = Window.partitionBy(entity, "_key").orderBy(*visit, key)
    distinct = (
        df.withColumn("_key", url_key(key))
        .filter(F.col("_key").isNotNull())
        .withColumn("_copy", F.row_number().over(copies))
        .filter("_copy = 1")
        .drop("_copy")
    )
    order = [*visit, F.col("_key")]
    if _cut_early(df, limit):
        ranked = distinct.withColumn(
            "rank", F.row_number().over(Window.partitionBy(entity).orderBy(*order))
        ).filter(F.col("rank") <= limit)
    else:
        ranked = number_rows(distinct, [entity], order, "rank")
        if limit is not None:
            ranked = ranked.filter(F.col("rank") <= limit)
    return ranked.withColumn("rank", F.col("rank").cast("int")).drop("_key")


def union_ranked(
    dfs: Sequence[DataFrame], entity: str = "entity_id", pos: str = "pos", key: str = "url"
) -> DataFrame:
    """Ordered union-distinct of ranked tables, in argument order, without a limit."""
    if not dfs:
        raise ValueError("at least one ranked table is needed")
    tagged = [df.withColumn("list_idx", F.lit(i)) for i, df in enumerate(dfs)]
    lists = reduce(lambda a, b: a.unionByName(b), tagged)
    return fuse_ranked_lists(lists, entity, "list_idx", pos, key, limit=None)


def collect_shortlist(
    df: DataFrame,
    entity: str = "entity_id",
    rank: str = "rank",
    columns: Sequence[str] = ("title", "url", "content"),
    limit: int = V.MAX_CANDIDATES,
) -> DataFrame:
    """One row per entity with its ordered ``candidates``, at most ``limit`` each."""
    item = F.struct(F.col(rank), *[F.col(c) for c in columns])
    return (
        df.filter(F.col(rank) <= limit)
        .groupBy(entity)
        .agg(F.array_sort(F.collect_list(item)).alias("candidates"))
    )
