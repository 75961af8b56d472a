"""Rank fusion against a plain loop; numbering of large groups; plan shape."""

import random
from itertools import zip_longest

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.operators import fusion
from waymark.operators.fusion import (
    collect_shortlist,
    fuse_ranked_lists,
    hot_entities,
    number_rows,
    union_ranked,
)

ITEM = st.sampled_from(["", " ", None, "A", "a", " a ", "b", "B ", "c", "d", "e"])
LISTS = st.lists(st.lists(ITEM, max_size=6), min_size=1, max_size=4)


def fused_on_paper(lists, limit):
    """Deal the lists out like columns of a table; the first spelling of a URL stays."""
    kept = {}
    for row in zip_longest(*lists, fillvalue=""):
        for url in row:
            kept.setdefault((url or "").strip().lower(), url)
    kept.pop("", None)
    return list(kept.values())[:limit]


def as_table(spark, groups):
    rows = [
        (e, i, p, url)
        for e, lists in enumerate(groups)
        for i, items in enumerate(lists)
        for p, url in enumerate(items)
    ]
    return spark.createDataFrame(rows, "entity_id int, list_idx int, pos int, url string")


def by_entity(df, n):
    out = [[] for _ in range(n)]
    for r in df.orderBy("entity_id", "rank").collect():
        out[r.entity_id].append(r.url)
        assert r["rank"] == len(out[r.entity_id])
    return out


def test_literal_order(spark):
    df = as_table(spark, [[["a", "b"], ["c", "a"]], [["A", "b"], ["c", "a ", ""], [None, "d"]]])
    assert by_entity(fuse_ranked_lists(df, limit=3), 2) == [["a", "c", "b"], ["A", "c", "b"]]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(LISTS, min_size=1, max_size=12), st.sampled_from([1, 3, 10, 2000, None]))
def test_equals_the_loop(spark, groups, limit):
    got = by_entity(fuse_ranked_lists(as_table(spark, groups), limit=limit), len(groups))
    assert got == [fused_on_paper(lists, limit) for lists in groups]


def test_one_entity_holding_most_rows(spark):
    rng = random.Random(7)
    hot = [[f"u{rng.randrange(6000)}" for _ in range(9000)] for _ in range(2)]
    groups = [hot, [["x", "y"]], [["z"]]]
    table = as_table(spark, groups)
    assert by_entity(fuse_ranked_lists(table, limit=10), 3) == [
        fused_on_paper(g, 10) for g in groups
    ]
    everything = by_entity(fuse_ranked_lists(table, limit=None), 3)
    assert everything == [fused_on_paper(g, None) for g in groups]


def test_union(spark):
    a = spark.createDataFrame([(1, 0, "A"), (1, 1, "b")], "entity_id int, pos int, url string")
    b = spark.createDataFrame([(1, 0, "c"), (1, 1, "a")], "entity_id int, pos int, url string")
    rows = union_ranked([a, b]).orderBy("rank").collect()
    assert [(r["rank"], r.url) for r in rows] == [(1, "A"), (2, "c"), (3, "b")]
    with pytest.raises(ValueError):
        union_ranked([])


def test_shortlist_is_ordered_and_bounded(spark):
    df = as_table(spark, [[[f"u{i}" for i in range(30)]]]).withColumn("rank", F.col("pos") + 1)
    row = collect_shortlist(df, columns=("url",), limit=10).first()
    assert [c.url for c in row.candidates] == [f"u{i}" for i in range(10)]


def test_number_rows(spark):
    group = F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g")
    df = spark.range(5000).select(group, F.col("id").alias("v"))
    out = number_rows(df, ["g"], [F.desc("v")], "n")
    rows = sorted(out.collect(), key=lambda r: (r.g or 0, r.n))
    assert len(rows) == 5000
    for g in (None, 1, 2):
        mine = [r for r in rows if r.g == g]
        assert [r.n for r in mine] == list(range(1, len(mine) + 1))
        assert [r.v for r in mine] == sorted((r.v for r in mine), reverse=True)
    plan = plan_of(out)
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_both_cuts_reach_below_the_shuffles(spark):
    plan = plan_of(fuse_ranked_lists(as_table(spark, [[["a"]]])))
    assert plan.count("WindowGroupLimit") == 4
    assert plan.count(", Partial") == 2 and "Python" not in plan


def test_bad_limits(spark):
    df = as_table(spark, [[["a"]]])
    with pytest.raises(ValueError):
        fuse_ranked_lists(df, limit=0)


def test_rank_has_one_type_and_follows_the_session_limit(spark):
    df = spark.createDataFrame([("e", 0, i, f"u{i}") for i in range(5)], "entity_id string, list_idx int, pos int, url string")
    types = {n: dict(fuse_ranked_lists(df, limit=n).dtypes)["rank"] for n in (10, 1000, 1001, None)}
    assert set(types.values()) == {"int"}


def test_an_entity_of_many_short_lists_spreads_over_tasks(spark):
    from pyspark.sql import functions as F

    from waymark.operators.fusion import number_rows

    rows = spark.range(20000).selectExpr("'e' as entity_id", "id as list_idx", "0 as pos", "concat('u', id) as url")
    flag = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(flag, "false")
    try:
        numbered = number_rows(rows, ["entity_id"], [F.col("pos"), F.col("list_idx")], "n")
        spread = numbered.withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    finally:
        spark.conf.unset(flag)
    assert spread > 1
    got = numbered.selectExpr("min(n)", "max(n)", "count(distinct n)", "count_if(n = list_idx + 1)").first()
    assert tuple(got) == (1, 20000, 20000, 20000)


def hot_and_cold(spark):
    """Entity 7 and null hold a quarter of the rows each, 400 others the rest."""
    entity = "CASE id % 4 WHEN 0 THEN 7 WHEN 1 THEN NULL ELSE id % 400 + 100 END AS entity_id"
    url = "concat(' U', id * 37 % 900) AS url"
    return spark.range(8000).selectExpr(entity, "id % 5 AS list_idx", "CAST(id / 5 AS INT) AS pos", url)


def test_hot_entities_are_found_with_null(spark):
    lists = hot_and_cold(spark)
    assert sorted(hot_entities(lists, rows=1000), key=str) == [7, None]
    assert hot_entities(lists, rows=5000) == []
    assert hot_entities(lists.limit(0), rows=0) == []
    texts = lists.selectExpr("concat('e', entity_id) AS entity_id")
    assert hot_entities(texts, rows=1000) == ["e7", None]


def test_routing_changes_no_row(spark):
    lists = hot_and_cold(spark)
    want = sorted(fuse_ranked_lists(lists).collect(), key=str)
    assert len(want) == 2 * 10 + 200 * 9  # a cold entity has nine URLs
    for hot in ((), [7], [None], [7, None], [12345]):
        assert sorted(fuse_ranked_lists(lists, hot=hot).collect(), key=str) == want
    everything = sorted(fuse_ranked_lists(lists, limit=None).collect(), key=str)
    assert sorted(fuse_ranked_lists(lists, limit=None, hot=[7]).collect(), key=str) == everything


def test_cold_entities_take_one_shuffle(spark):
    lists = hot_and_cold(spark)
    assert plan_of(fuse_ranked_lists(lists)).count("Exchange") == 2
    assert plan_of(fuse_ranked_lists(lists, hot=())).count("Exchange") == 1
    routed = plan_of(fuse_ranked_lists(lists, hot=[7, None]))
    assert routed.count("Exchange") == 3 and routed.count(", Partial") == 2


def test_partitions_follow_the_rows(spark, monkeypatch):
    """Small entities are dealt to as many tasks as the table needs, whatever the session's number; the rows are the same."""
    monkeypatch.setattr(fusion, "TASK_ROWS", 100, raising=False)
    columns = ["id % 97 AS entity_id", "0 AS list_idx", "id AS pos", "concat('u', id % 500) AS url"]
    lists = spark.range(2000).selectExpr(*columns)
    hot = hot_entities(lists, rows=1000)
    routed = fuse_ranked_lists(lists, hot=hot)
    assert hot == [] and hot.rows == 2000
    assert routed.rdd.getNumPartitions() == 20
    assert sorted(routed.collect()) == sorted(fuse_ranked_lists(lists).collect())
