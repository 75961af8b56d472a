"""Entity tables: CSV, canonical fields, output columns, queries, resume, write-back."""

import pytest
from pyspark.sql import functions as F

from waymark.operators.entities import (
    build_queries,
    canonicalize_entities,
    ensure_output_columns,
    query_specs,
    with_row_id,
)
from waymark.operators.upkeep import pending, remaining, run_summary, write_back
from waymark.sources.search_results import normalize_candidates, read_search_results
from waymark.sources.tables import load_for_run, read_entities, read_results, write_results

CSV = (
    "Name,name,city,Confidence,confidence,note\n"
    'A,,NA,x,y,"two\nlines, and ""quotes"""\n'
    "B,b2,null,,z,#N/A\n"
    ",c2,Town,nan,, keep\n"
)


@pytest.fixture
def csv_table(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(CSV)
    return read_entities(spark, str(path))


def test_csv_scan(csv_table):
    assert csv_table.columns == ["Name", "name", "city", "Confidence", "confidence", "note"]
    assert {t for _, t in csv_table.dtypes} == {"string"}
    rows = [tuple(r) for r in csv_table.collect()]
    assert rows == [
        ("A", None, None, "x", "y", 'two\nlines, and "quotes"'),
        ("B", "b2", None, None, "z", None),
        (None, "c2", "Town", None, None, " keep"),
    ]


def test_last_header_of_a_case_pair_counts(csv_table):
    out = canonicalize_entities(csv_table)
    assert [r.entity.name for r in out.select("entity").collect()] == ["", "b2", "c2"]


def test_round_trip_with_case_pairs(csv_table, spark, tmp_path):
    path = str(tmp_path / "out")
    write_results(csv_table, path, "csv")
    back = read_results(spark, path, "csv")
    assert back.columns == csv_table.columns
    assert sorted(map(str, back.collect())) == sorted(map(str, csv_table.collect()))
    for fmt in ("parquet", "xlsx"):
        with pytest.raises(ValueError):
            write_results(csv_table, str(tmp_path / "x"), fmt)


def test_canonical_fields(spark):
    row = ("Lincoln High School", "Lincoln USD", " Lincoln ", "CA", "x")
    df = spark.createDataFrame([row], ["school_name", "District_Name", "CITY", "state", "School"])
    e = canonicalize_entities(df).first().entity
    assert tuple(e) == ("Lincoln High School", "Lincoln USD", "", "Lincoln", "CA")


def test_alias_falls_through_blanks(spark):
    df = spark.createDataFrame([(" ", None, "C")], "school_name string, name string, school string")
    assert canonicalize_entities(df).first().entity.name == "C"


def test_output_columns(spark):
    df, names = ensure_output_columns(spark.createDataFrame([("A", "B")], ["name", "city"]))
    assert names == ("StaffDirectoryURL", "Confidence", "Reasoning")
    assert df.columns == ["name", "city", *names]
    df, names = ensure_output_columns(
        spark.createDataFrame([("A", "B")], ["name", "Staff_Directory_URL"])
    )
    assert names.url == "Staff_Directory_URL"
    df, _ = ensure_output_columns(spark.createDataFrame([("A", "low")], ["name", "confidence"]))
    assert df.columns[-3:] == ["StaffDirectoryURL", "Confidence", "Reasoning"]


def school(spark, **fields):
    order = ("name", "district", "county", "city", "state")
    row = tuple(fields.get(f, "") for f in order)
    df = spark.createDataFrame([row], ", ".join(f"{f} string" for f in order))
    return df.select(F.struct(*order).alias("entity"))


def test_queries(spark):
    df = school(spark, name="Lincoln High School", district="Lincoln USD", city="Lincoln", state="CA")
    queries = build_queries(df).first().queries
    assert queries == [
        '"Lincoln High School" "staff directory" Lincoln CA',
        '"Lincoln High School" ("faculty & staff" OR "faculty and staff" OR "staff") Lincoln CA',
        '"Lincoln High School" ("our staff" OR "staff list" OR "faculty directory" OR "directory") '
        "Lincoln CA",
    ]
    assert build_queries(df, 4).first().queries[3] == (
        '"Lincoln USD" ("staff directory" OR "directory") "Lincoln High School" Lincoln CA'
    )
    assert len(build_queries(school(spark, name="X"), 4).first().queries) == 3
    blank = build_queries(school(spark, city="Town"), 1).first().queries
    assert blank == ['"staff directory" Town']
    spaced = build_queries(school(spark, name="A \t B"), 1).first().queries
    assert spaced == ['"A B" "staff directory"']


def test_queries_drop_case_twins(spark):
    template = {"lead": "name", "clause": '"x"', "any": ("x",)}
    twin = {**template, "clause": '"X"'}
    got = query_specs(school(spark, name="A"), 3, (template, twin)).first().query_specs
    assert [s.query for s in got] == ['"A" "x"']


def test_row_id_is_stable(spark):
    df = with_row_id(spark.range(100).repartition(7), "row_id")
    assert df.select("row_id").distinct().count() == 100
    assert sorted(df.collect()) == sorted(df.collect())


def urls(spark):
    rows = [
        (1, None), (2, " "), (3, "NaN"), (4, "not_found"), (5, "ERROR_NOT_FOUND"),
        (6, "none"), (7, "http://a"), (8, "junk"),
    ]
    return spark.createDataFrame(rows, "id int, url string")


def test_pending_and_remaining(spark):
    df = urls(spark)
    assert [r.id for r in pending(df, "url").orderBy("id").collect()] == [1, 2, 3, 4, 5, 6]
    more = df.union(spark.createDataFrame([(9, "http://new")], "id int, url string"))
    left = remaining(more, df, "id", "url")
    assert sorted(r.id for r in left.collect()) == [1, 2, 3, 4, 5, 6, 9]


def test_summary(spark):
    row = run_summary(urls(spark), "url", 5).first()
    assert tuple(row) == (8, 5, 4, 1, 1)
    assert run_summary(urls(spark), "url").first().rows_pending == 6


def test_write_back(spark):
    df, names = ensure_output_columns(urls(spark).withColumnRenamed("url", "staff_directory_url"))
    results = spark.createDataFrame(
        [(1, "http://n", None, None), (7, "http://m", "high", "why")],
        "id int, url string, confidence string, reasoning string",
    )
    out = {r.id: tuple(r)[1:] for r in write_back(df, results, "id", names).collect()}
    assert out[1] == ("http://n", "", None)
    assert out[7] == ("http://m", "high", "why")
    assert out[8] == ("junk", None, None)
    assert len(out) == 8


def test_load_for_run(spark):
    table = spark.createDataFrame([(1, None), (2, "b"), (3, "c")], "id int, url string")
    prior = spark.createDataFrame(
        [(1, "http://p", "high"), (2, None, None)], "id int, url string, Confidence string"
    )
    assert load_for_run(table, None) is table
    assert load_for_run(table, prior, resume=False) is table
    assert load_for_run(table, prior) is prior
    merged = load_for_run(table, prior, mode="merge", key="id").orderBy("id")
    assert [tuple(r) for r in merged.collect()] == [
        (1, "http://p", "high"), (2, "b", None), (3, "c", None),
    ]
    with pytest.raises(ValueError):
        load_for_run(table, prior, mode="merge")
    with pytest.raises(ValueError):
        load_for_run(table, prior, mode="other")


def test_search_results(spark):
    rows = [
        (1, '{"results":[{"title":"a","url":"u","content":"","description":"d"},7,{"url":null}]}'),
        (2, '{"results":{},"data":[{"url":"v"}]}'),
        (3, '[{"url":"w","content":"c"}]'),
        (4, '{"detail":"no"}'),
        (5, "not json"),
        (6, '[{"url":"w"}] trailing'),
        (7, '{"results":[],"data":[{"url":"hidden"}]}'),
        (8, None),
        (9, "5"),
    ]
    df = spark.createDataFrame(rows, "id int, raw string")
    got = sorted(tuple(r) for r in read_search_results(df, "raw").collect())
    assert got == [
        (1, 0, "a", "u", "d"),
        (1, 1, "", "", ""),
        (2, 0, "", "v", ""),
        (3, 0, "", "w", "c"),
    ]


def test_normalize(spark):
    df = spark.createDataFrame(
        [(None, "u", None, "d"), ("t", None, "c", "d")],
        "title string, url string, content string, description string",
    )
    assert sorted(tuple(r) for r in normalize_candidates(df).collect()) == [
        ("", "u", "d"), ("t", "", "c"),
    ]


def test_merge_with_headers_that_differ_in_case(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id int, confidence string")
    from waymark.operators.entities import ensure_output_columns

    wide, _ = ensure_output_columns(table)
    prior, _ = ensure_output_columns(spark.createDataFrame([(1, "x"), (1, "x")], "id int, confidence string"))
    merged = load_for_run(wide, prior, mode="merge", key="id")
    assert merged.columns == wide.columns
    assert sorted(tuple(r)[:2] for r in merged.collect()) == [(1, "x"), (2, "b")]


def test_the_session_tells_no_names_apart_while_files_are_used(spark, tmp_path, monkeypatch):
    from pyspark.sql.conf import RuntimeConfig

    seen, plain = [], RuntimeConfig.set

    def watched(self, key, value):
        plain(self, key, value)
        seen.append(spark.conf.get("spark.sql.caseSensitive"))

    monkeypatch.setattr(RuntimeConfig, "set", watched)
    (tmp_path / "in.csv").write_text(CSV)
    table = read_entities(spark, str(tmp_path / "in.csv"))
    write_results(table, str(tmp_path / "out"))
    assert read_results(spark, str(tmp_path / "out")).columns == table.columns
    assert set(seen) == {"false"} and spark.conf.get("spark.sql.caseSensitive") == "false"
    assert read_results(spark, str(tmp_path / "out")).where("city IS NULL").count() == 2
