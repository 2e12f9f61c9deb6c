"""From a diff to the symbols it changes and what depends on them."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.graph import Graph
from weftline.operators.traverse import impact
from weftline.schema import SYMBOL_KINDS


def git_diff(spark: SparkSession, folder: str, ref: str = "HEAD") -> DataFrame:
    """(ord, line) of the working tree's diff against a ref without context. Refs that look like options, and failures of git, are errors."""
    if not ref or ref.startswith("-"):
        raise ValueError(f"not a ref: {ref!r}")
    text = subprocess.run(["git", "-C", folder, "diff", "--unified=0", ref, "--"], check=True, capture_output=True, text=True).stdout
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "ord bigint, line string")


def parse_diff(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, file, lo, hi): the changed line ranges of each file's new side, from a diff's numbered lines (ord, line).

    A length that is left out is 1; a length of 0, a pure deletion, is the line it happened at. Deleted files give nothing. `by` tells diffs apart (say a repo): each diff is read in order by
    one task, which carries the file's name forward.
    """
    by = by or []
    head = F.regexp_extract("line", r"^\+\+\+ (?:b/)?([^\t\r]*)", 1)
    order = W.partitionBy(*by).orderBy("ord") if by else W.partitionBy(F.lit(0)).orderBy("ord")
    x = lines.where(F.col("line").startswith("+++ ") | F.col("line").startswith("@@ "))
    x = x.withColumn("file", F.last(F.when(F.col("line").startswith("+++ "), head), ignorenulls=True).over(order))
    num = lambda i: F.regexp_extract("line", r"^@@ [^+]*\+(\d+)(?:,(\d+))?", i)
    hunks = x.where(F.col("line").startswith("@@ ") & F.col("file").isNotNull() & (F.col("file") != "/dev/null") & (num(1) != ""))
    lo = num(1).cast("int")
    n = F.when(num(2) == "", 1).otherwise(num(2).cast("int"))
    return hunks.select(*by, "file", lo.alias("lo"), F.when(n == 0, lo).otherwise(lo + n - 1).alias("hi"))


def symbol_spans(g: Graph) -> DataFrame:
    """(repo, file, id, lo, hi): lines from each symbol's own to the one before the next symbol's; the last has no end (null).

    Symbols of one line are ordered by id; all but the last of them get a span that ends before it begins, so only a range that starts on an earlier line meets it.
    """
    n = g.nodes.where(F.col("kind").isin(*SYMBOL_KINDS) & (F.col("file") != "") & (F.col("line") > 0))
    return n.select("repo", "file", "id", F.col("line").alias("lo"), (F.lead("line").over(W.partitionBy("repo", "file").orderBy("line", "id")) - 1).alias("hi"))


def changed_symbols(g: Graph, ranges: DataFrame) -> DataFrame:
    """(repo, id): symbols whose span meets one of the ranges (repo, file, lo, hi)."""
    s = symbol_spans(g).withColumnsRenamed({"lo": "s_lo", "hi": "s_hi"})
    hit = s.join(ranges, ["repo", "file"]).where((F.col("s_lo") <= F.col("hi")) & (F.col("s_hi").isNull() | (F.col("s_hi") >= F.col("lo"))))
    return hit.select("repo", "id").distinct()


def impacted(g: Graph, changed: DataFrame) -> DataFrame:
    """(repo, id): what depends on any changed symbol, without the changed ones. One closure per repo with all changed symbols as its seed."""
    seeds = changed.select("repo", F.lit("").alias("root"), "id")
    return impact(g.calls(), seeds).select("repo", "id").join(changed, ["repo", "id"], "left_anti")
