"""Intermediate tables in the folder that all executors share.

Iterative operators write each round's state as a Parquet table instead of keeping lineage or executor-local blocks, so
that a lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset, a temporary folder, but only if driver and executors are one process."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    got = "file://" + tempfile.mkdtemp(prefix="weftline-")
    spark.conf.set("spark.checkpoint.dir", got)
    return got


def place(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted at the end."""
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def keep(df: DataFrame, label: str) -> DataFrame:
    """Writes the rows once and returns a scan of them; such a scan is returned as it is. Columns of equal name must be renamed before."""
    if getattr(df, "_weftline_kept", False) is True:
        return df
    spark = df.sparkSession
    path = place(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_kept = True
    return out


def counted(df: DataFrame, path: str, by: str | None = None) -> int:
    """Writes the rows to a path, in one folder per value of `by` if given, and returns their number, counted on the way."""
    seen = Observation()
    write = df.observe(seen, F.count(F.lit(1)).alias("n")).write
    (write.partitionBy(by) if by else write).parquet(path)
    return seen.get["n"]


def forget(upto: int = 0) -> None:
    """Deletes the tables written so far, but for the first `upto`. Call it only when no lazy result needs them any more."""
    while len(_made) > upto:
        spark, path = _made.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended
            pass


@contextmanager
def scope() -> Iterator[None]:
    """Deletes at its end the tables written in it: for long sessions, around questions whose results have been written or collected."""
    before = len(_made)
    try:
        yield
    finally:
        forget(before)


atexit.register(forget)
