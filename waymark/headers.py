"""Tables whose headers differ only in case.

Spark resolves names without case by default, so such columns are addressed by
position inside operators, and read or written in a session of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_FLAG = "spark.sql.caseSensitive"


def by_position(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table under positional names, and header -> positional name."""
    names = [f"_c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def case_sensitive_session(spark: SparkSession) -> SparkSession:
    """A session of the same context and settings that tells names apart by case.

    The caller's own session keeps its setting, so queries that run beside are not touched.
    """
    other = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name != _FLAG and other.conf.isModifiable(name):
            other.conf.set(name, value)
    other.conf.set(_FLAG, "true")
    return other
