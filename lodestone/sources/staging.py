"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a new one of this machine
    is set in local mode (as in tests); on a cluster, whose executors would not see it, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        found = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_open: list[list[str]] = []


def stage(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    It cuts the lineage: a lost executor costs a re-read, not a recomputation. The table stays until
    the innermost `temporary` ends (without one, or if it is to be kept, for good)."""
    path = f"{shared_dir(df.sparkSession)}/lodestone/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _open and not kept:
        _open[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_staged", None):
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def temporary(spark: SparkSession):
    """Tables staged inside are deleted at the end: what is built on them must have been written by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _delete(spark, path)
