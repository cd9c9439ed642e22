"""Session settings and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import AbstractContextManager, contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "relrank", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints. A local session that names none gets a temporary one; executors
    on other machines would not see it, so any other master has to name one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    local = tempfile.mkdtemp(prefix="relrank-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one job's written tables, below the shared folder."""
    return os.path.join(shared_dir(spark), "relrank", f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike cached blocks."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Jobs started inside run with this setting of the session."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shuffles_freed(spark: SparkSession) -> AbstractContextManager[None]:
    """Jobs started inside delete their shuffle files at their end; otherwise these lie until the driver happens to
    collect its garbage, and a job of many steps holds the shuffles of all of them."""
    return setting(spark, FREE_SHUFFLES, "true")


_WRITTEN: ContextVar[tuple[tuple[tuple[str, ...], list[str]], ...]] = ContextVar("written", default=())


@contextmanager
def scratch(spark: SparkSession, *kept: str) -> Iterator[None]:
    """Tables that `materialize` writes inside are deleted at the end, but for those of the names `kept`. Frames that
    leave the block must not read the others."""
    paths: list[str] = []
    mark = _WRITTEN.set((*_WRITTEN.get(), (kept, paths)))
    try:
        yield
    finally:
        _WRITTEN.reset(mark)
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: columns stay prunable, sizes are known."""
    return materialize_parts(df.sparkSession, [df], name)


def materialize_parts(spark: SparkSession, parts: Iterable[DataFrame], name: str) -> DataFrame:
    """Frames of one schema as one written table; each is made and written when the one before it is done."""
    path = scratch_path(spark, name)
    # The innermost block that does not keep the table deletes it; a table that it keeps may go with an outer one.
    for kept, paths in reversed(_WRITTEN.get()):
        if name not in kept:
            paths.append(path)
            break
    for df in parts:
        with shuffles_freed(spark):
            df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
