"""Keeping derived tables fresh as files arrive: a file stream with one upsert per micro-batch, in place of polling modification times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline import schema
from weftline.operators.edges import clean_kind, is_edge


def edge_stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Rows of Parquet files as they arrive in the folder."""
    return spark.readStream.schema(schema.EDGES + ", indexed_at timestamp_ntz").option("maxFilesPerTrigger", per_trigger).parquet(folder)


def monthly_calls(edges: DataFrame) -> DataFrame:
    """(month, repo, n): calls per repo and 30-day window of their time. Rows count however late they come: the state keeps one number per repo and window."""
    e = edges.where(is_edge() & (clean_kind() == "calls")).withColumn("at", F.col("indexed_at").cast("timestamp"))
    return e.groupBy(F.window("at", "30 days").alias("w"), "repo").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("month"), "repo", "n")


def keep_counts(edges: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Adds each micro-batch's per-target counts to the table at `target`, one folder per batch, so that a batch that is run again replaces its own folder.

    Read the folder with current_counts. Each batch is combined per key before it is written.
    """

    def put(batch: DataFrame, number: int) -> None:
        part = batch.where("dst <> ''").groupBy("repo", "dst", clean_kind().alias("kind")).agg(F.count(F.lit(1)).alias("n"))
        part.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return edges.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_counts(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).groupBy("repo", "dst", "kind").agg(F.sum("n").alias("n"))
