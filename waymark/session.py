"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from waymark.headers import by_position


def build_session(
    app: str = "waymark", master: str | None = None, shared: str | None = None, **conf: str
) -> SparkSession:
    """A session with adaptive execution on; ``conf`` wins over the defaults.

    ``shared`` names the folder for intermediate tables, which all executors must reach.

    Leave ``master`` unset under spark-submit.  Shuffle partitions start high
    and adaptive execution coalesces them, so the same setting serves both a
    laptop and a cluster.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **({"spark.checkpoint.dir": shared} if shared else {}),
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (``local`` masters) a
    temporary folder is made, once, and set as the checkpoint folder.  On a cluster a missing
    setting raises: executors would write to their own disks.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="waymark-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


_scope: ContextVar[str] = ContextVar("scratch_scope", default="")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under :func:`shared_dir`, inside the current :func:`scratch_scope`."""
    return f"{shared_dir(spark)}/{_scope.get()}{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession, label: str) -> Iterator[None]:
    """Intermediate tables made inside are removed at the end.

    For work whose results are stored elsewhere by then, such as a micro-batch.  After an error the tables stay, for a look
    at them; plans that read them must not be used after the end.
    """
    name = f"{_scope.get()}{label}-{uuid.uuid4().hex}/"
    token = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(token)
    remove(spark, f"{shared_dir(spark)}/{name}")


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path of any store Spark reaches; other failures are raised."""
    system, place = _file_system(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own."""
    system, place = _file_system(spark, path)
    system.delete(place, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For results that must not be computed twice: user functions with side
    effects, generated ids.  The copy survives the loss of executors.  Columns are
    stored under positional names, so any headers will do.
    """
    path = scratch_path(df.sparkSession, label)
    positional, _ = by_position(df)
    positional.write.parquet(path)
    return df.sparkSession.read.schema(positional.schema).parquet(path).toDF(*df.columns)
