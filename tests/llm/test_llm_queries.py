"""The registered queries of the subpackage at the smallest scale: oracles, contracts, the pipeline."""

import math
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from waymark.llm.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def cells(rows, order):
    rounded = [tuple(round(r[i], 6) if isinstance(r[i], float) and math.isfinite(r[i]) else r[i] for i in order) for r in rows]
    return sorted(rounded, key=lambda row: [(c is not None, str(c)) for c in row])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = cells(cursor.fetchall(), [columns.index(c) for c in sorted(columns)])
    assert cells(df.collect(), [df.columns.index(c) for c in sorted(columns)]) == want


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(entry.queries()) >= {*QUERIES, "pipeline"}


def test_toxicity_holds_out_a_fold(spark):
    rows = QUERIES["op9_toxicity"](spark, str(DATA)).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_pipeline_stages(spark):
    """Each stage works on all its predecessor kept, and all but the last keep the columns."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    from waymark.session import materialize

    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(DATA)), "stage")
        kept = {r[0] for r in docs.select("doc_id").collect()}
        assert kept <= ids and kept, name
        if name == "line dedup":
            assert kept == ids
            assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
        ids = kept
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert docs.where("decoded is null").count() == 0
