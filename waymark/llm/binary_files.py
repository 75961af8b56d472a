"""Binary files written and read by Spark itself, so any store that Spark reaches will do.

Spark's text writer stores the bytes of a string as they are, followed by a line
feed.  Records therefore carry their own lengths, and each is followed by that one byte.
Writing goes through Spark's commit protocol: a repeated task leaves no half file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_records(df: DataFrame, column: str, path: str, compression: str = "none", at_most: int = 0) -> None:
    """One file for each partition, or for each ``at_most`` rows of it, the binary column's values in row order."""
    text = df.select(F.col(column).cast("string").alias("value"))
    text.write.option("compression", compression).option("lineSep", "\n").option("maxRecordsPerFile", at_most).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every file of a folder."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
