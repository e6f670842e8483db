"""Session setup and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "wallflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is tuned for. All are overridable."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # HotSpot interprets methods above 8000 bytes of code for ever; wide
        # rule projections are faster as several small methods.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="wallflow-")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine; on a
    cluster the setting is required, since executors must all see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _local_root()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def with_package(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver does.

    That serves a shared file system or a local session; elsewhere the package
    has to be shipped with the job, as usual.
    """
    environment = spark.sparkContext.environment
    root, known = str(Path(__file__).resolve().parents[1]), environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, root) if x)


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` whose workers find this package."""
    with_package(df.sparkSession)
    return df.mapInArrow(run, schema)


class _Scratch(threading.local):
    """Paths that this thread has written since each of its ``scratch`` blocks began."""

    def __init__(self):
        self.open: list[list[str]] = []


_scratch = _Scratch()


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession):
    """Remove what ``materialise`` writes in this block when the block ends.

    For jobs whose outputs are files; a table returned from the block must not
    be lazy.
    """
    _scratch.open.append([])
    try:
        yield
    finally:
        for path in _scratch.open.pop():
            _remove(spark, path)


def removed_with_scratch(path: str) -> str:
    """``path``, which the innermost ``scratch`` of this thread removes as well."""
    if _scratch.open:
        _scratch.open[-1].append(path)
    return path


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    The result does not depend on any executor staying alive, keeps column
    pruning, and is computed once however often it is read.
    """
    path = removed_with_scratch(scratch_path(df.sparkSession, label))
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables from ``materialise`` that nothing lazy reads any more."""
    for table in tables:
        _remove(table.sparkSession, table._scratch_path)
