"""Parquet tables of a data folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

import weftline


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per Spark context, so that they can import it wherever they run.

    The driver's file server hands the archive out; it must stay in place as long as the context lives.
    """
    sc = spark.sparkContext
    if getattr(sc, "_weftline_sent", False):
        return
    top = os.path.dirname(os.path.abspath(weftline.__file__))
    folder = tempfile.mkdtemp(prefix="weftline-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "weftline.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, files in os.walk(top):
            for name in sorted(files):
                if name.endswith(".py"):
                    z.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), os.path.dirname(top)))
    sc.addPyFile(path)
    sc._weftline_sent = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the folder, as delivered. Nothing is inferred: Parquet carries the schema."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
