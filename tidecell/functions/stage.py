"""Stages: tables written once in the folder that the cluster shares, to cut lineage and to survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Lists that get the paths of the stages which the current call writes; other threads' calls have lists of their own.
_tracking: ContextVar[tuple[list[str], ...]] = ContextVar("tracking", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a session whose executors are
    threads of the driver gets a folder of its own; on a cluster there is none that all could read."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = sc._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named and not sc.master.partition("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="tidecell-")
        sc.setCheckpointDir(named)
    return named


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once under the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidecell/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stage_path = path
    for written in _tracking.get():
        written.append(path)
    return back


def bucketed(df: DataFrame, name: str, by: list[str]) -> DataFrame:
    """Like materialize, in as many buckets by the columns as a shuffle has partitions: joins on all of these columns leave
    the table where it is, and what a join on them returns is written without another shuffle."""
    spark = df.sparkSession
    path, known = f"{shared_dir(spark)}/tidecell/{name}-{uuid.uuid4().hex}", f"stage_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, *by).format("parquet").option("compression", "zstd").option("path", path).saveAsTable(known)
    back = spark.table(known)
    back.stage_path = path
    for written in _tracking.get():
        written.append(path)
    return back


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*stages: DataFrame) -> None:
    """Delete the files of stages that nothing will read again: what is built on them must be written by now."""
    for df in stages:
        if hasattr(df, "stage_path"):
            _delete(df.sparkSession, df.stage_path)


@contextmanager
def tracked() -> Iterator[list[str]]:
    """The paths of the stages that the block writes, in order; what other threads write is not among them."""
    written: list[str] = []
    before = _tracking.set((*_tracking.get(), written))
    try:
        yield written
    finally:
        _tracking.reset(before)


def discard_but(written: list[str], kept: DataFrame) -> None:
    """Delete the tracked stages but the one that is kept."""
    for path in written:
        if path != kept.stage_path:
            _delete(kept.sparkSession, path)
