"""Session and shared-folder helpers."""

from __future__ import annotations

import contextlib
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

# Called with every plan that is about to be written by ``materialize``.
ON_MATERIALIZE: list[Callable[[DataFrame], None]] = []
# Folders made since the innermost ``scratch`` began.
_made: list[list[str]] = []


def local_session(cpus: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("entitylink")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


@functools.cache
def _local_base() -> str:
    """One temporary folder per local process."""
    return tempfile.mkdtemp(prefix="entitylink-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder every executor can reach.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Only where
    that is unset and the master is local does a temporary folder stand in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_base()
    path = os.path.join(base, f"{name}-{uuid.uuid4().hex}")
    if _made:
        _made[-1].append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Owner of the intermediate copies made inside: they are deleted at its end, so write
    or collect the result before that.

        with scratch(spark):
            link_by_tokens(...).write.parquet(out)
    """
    _made.append([])
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in _made.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result that several later steps read, and read it back.

    The copy lives in the shared folder, so losing executors does not lose it, and
    the plans built on it stay short. Nothing passes through the driver. The copy
    stays until the folder is cleaned, or the ``scratch`` around the job ends.
    """
    for check in ON_MATERIALIZE:
        check(df)
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
