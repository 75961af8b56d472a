"""Entity rows: canonical fields, output columns, search queries, row ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import fixed_values as V
from waymark.functions.text import non_blank, squeeze_ws
from waymark.headers import by_position
from waymark.session import materialize


class OutputColumns(NamedTuple):
    """Names of the three result columns of a table."""

    url: str
    confidence: str
    reasoning: str


def canonicalize_entities(
    df: DataFrame, aliases: Mapping[str, Sequence[str]] = V.ENTITY_ALIASES
) -> DataFrame:
    """Add an ``entity`` struct: per field the first alias with a non-blank value, else "".

    Headers match case-insensitively; of headers that differ only in case the
    last one counts.  Columns are addressed by position so that such headers
    stay usable, and keep their names in the result - a header ``entity`` too, so
    the struct is then best addressed by position.
    """
    positional, names = by_position(df)
    return positional.withColumn("_entity", entity_struct(names, aliases)).toDF(*df.columns, "entity")


def entity_struct(
    names: Mapping[str, str], aliases: Mapping[str, Sequence[str]] = V.ENTITY_ALIASES
) -> Column:
    """The canonical fields over a table by position; ``names`` maps headers to its columns."""
    position = {header.lower(): c for header, c in names.items()}
    fields = [
        F.coalesce(*[non_blank(position[a]) for a in accepted if a in position], F.lit("")).alias(
            field
        )
        for field, accepted in aliases.items()
    ]
    return F.struct(*fields)


def entity_rows(
    df: DataFrame, key: str, aliases: Mapping[str, Sequence[str]] = V.ENTITY_ALIASES
) -> DataFrame:
    """(key, entity) of every row; other columns, whatever their names, are left behind."""
    positional, names = by_position(df)
    return positional.select(
        F.col(names[key]).alias(key), entity_struct(names, aliases).alias("entity")
    )


def ensure_output_columns(
    df: DataFrame, preferred: str = V.URL_COLUMN
) -> tuple[DataFrame, OutputColumns]:
    """Find or add the URL, confidence and reasoning columns; new ones are null.

    The URL column is matched case-insensitively against the known headers, in
    their order; the other two by exact name.
    """
    headers = {c.lower(): c for c in df.columns}
    url = next((headers[a] for a in V.URL_COLUMN_ALIASES if a in headers), None)
    names = OutputColumns(url or preferred, V.CONFIDENCE_COLUMN, V.REASONING_COLUMN)
    added = [n for n in names if n not in df.columns]
    # select keeps a header such as "confidence" beside the added "Confidence"
    return df.select("*", *[F.lit(None).cast("string").alias(n) for n in added]), names


def _present(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda p: p != "")


def query_specs(
    df: DataFrame,
    max_queries: int = V.MAX_QUERIES,
    templates: Sequence[Mapping] = V.QUERY_TEMPLATES,
    out: str = "query_specs",
) -> DataFrame:
    """Add the ordered distinct search queries of ``entity``, as text and as phrases.

    Array of struct(query, must_phrase, any_phrases, should_terms): ``query``
    is the text a search service takes, the other three say the same for a
    join against a corpus.  Duplicates drop by lowercase text, first kept.
    Each text is a column of its own first, so that it is put together once
    per row however often the array looks at it.
    """
    if max_queries < 1:
        raise ValueError("max_queries must be at least 1")
    e = F.col("entity")
    name, district = e["name"], e["district"]
    where = F.array_join(_present(e["city"], e["state"]), " ")

    def quoted(c: Column) -> Column:
        return F.when(c == "", F.lit("")).otherwise(F.concat(F.lit('"'), c, F.lit('"')))

    texts, specs = {}, []
    for i, t in enumerate(templates):
        column, clause = f"_text_{i}", F.lit(t["clause"])
        should = [e["city"], e["state"]]
        if t["lead"] == "district":
            text = F.concat_ws(" ", quoted(district), clause, quoted(name), where)
            text = F.when(district != "", text).otherwise(F.lit(""))
            should.append(district)
        else:
            text = F.concat_ws(" ", quoted(name), clause, where)
        spec = F.struct(
            F.col(column).alias("query"),
            name.alias("must_phrase"),
            F.array(*[F.lit(p) for p in t["any"]]).alias("any_phrases"),
            _present(*should).alias("should_terms"),
        )
        fresh = F.col(column) != ""
        for earlier in texts:
            fresh &= F.lower(column) != F.lower(earlier)
        texts[column] = squeeze_ws(text)
        specs.append(F.when(fresh, spec))
    offered = F.filter(F.array(*specs), lambda s: s.isNotNull())
    return df.withColumns(texts).withColumn(out, F.slice(offered, 1, max_queries)).drop(*texts)


def build_queries(
    df: DataFrame,
    max_queries: int = V.MAX_QUERIES,
    templates: Sequence[Mapping] = V.QUERY_TEMPLATES,
) -> DataFrame:
    """Add ``queries``, the ordered query texts of the ``entity`` column."""
    specs = query_specs(df, max_queries, templates, "_specs")
    return specs.withColumn("queries", F.col("_specs.query")).drop("_specs")


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Add a row id and fix it by writing the table once.

    Generated ids change when a lost partition is computed again, so they must
    be stored before rows are fanned out and joined back on them.
    """
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "row-id")
