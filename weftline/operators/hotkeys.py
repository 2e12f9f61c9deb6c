"""Problem 1: results per key where a few keys hold most rows.

Every result is an algebraic aggregate, so each task folds its rows into one bounded hash table (which spills as sorted
runs when it is full) and ships one mergeable state per key it saw. A key that holds a third of all rows therefore costs
the reducer one state per map task, not one row per record, and needs no salt.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.edges import clean_kind, is_edge
from weftline.sources.scratch import keep


def per_key(rows: DataFrame, keys: list[Column], states: dict[str, Column]) -> DataFrame:
    """One row per key with the given aggregates.

    Only algebraic aggregates (count, sum, min, max, min_by, sketches) belong here: they combine on the map side.
    Null keys form a group of their own; an empty table gives no rows; repeated rows count as often as delivered.
    """
    return rows.groupBy(*keys).agg(*(c.alias(name) for name, c in states.items()))


def target_profile(edges: DataFrame) -> DataFrame:
    """Per target and cleaned kind: rows as delivered, edges among them, repos, sources, time range.

    n_sources is an HLL estimate (2 % standard error): exact distinct counts would ship every source of a hot target.
    Rows whose target is null or empty have no target and give no row here. Columns besides src, dst, kind, repo and
    indexed_at are not read.
    """
    return per_key(
        edges.where("dst <> ''"),
        [F.col("dst"), clean_kind().alias("kind")],
        {
            "n_rows": F.count(F.lit(1)),
            "n_edges": F.count_if(is_edge()),
            "n_sources": F.approx_count_distinct("src", 0.02),
            "n_repos": F.approx_count_distinct("repo", 0.02),
            "first_at": F.min("indexed_at"),
            "last_at": F.max("indexed_at"),
        },
    )


def target_sources(edges: DataFrame) -> DataFrame:
    """(dst, kind, n_sources, n_repos): how many different sources and repos each target has, exactly.

    Rows are first cut to one per target, kind, source and repo, which no target can make hot as its sources tell its rows apart; what is left is counted like any rows. Null sources and repos don't count.
    """
    key = [F.col("dst"), clean_kind().alias("kind")]
    one = edges.where("dst <> ''").groupBy(*key, "src", "repo").agg(F.lit(1).alias("x"))
    by_source = one.groupBy("dst", "kind", "src").agg(F.lit(1).alias("x")).groupBy("dst", "kind").agg(F.count("src").alias("n_sources"))
    by_repo = one.groupBy("dst", "kind", "repo").agg(F.lit(1).alias("x")).groupBy("dst", "kind").agg(F.count("repo").alias("n_repos"))
    a, b = by_source, by_repo.withColumnsRenamed({"dst": "r_dst", "kind": "r_kind"})
    return a.join(b, (F.col("dst") == F.col("r_dst")) & F.col("kind").eqNullSafe(F.col("r_kind"))).select("dst", "kind", "n_sources", "n_repos")


def heavy_targets(edges: DataFrame, share: float = 0.02) -> DataFrame:
    """(dst, kind) with at least `share` of all delivered rows, rows that are no edges included in the total.

    The total is a count over the file footers. Rows without a target count in the total only. An empty table gives no rows.
    """
    total = edges.count()
    counts = per_key(edges.where("dst <> ''"), [F.col("dst"), clean_kind().alias("kind")], {"n": F.count(F.lit(1))})
    return counts.where(F.col("n") >= F.lit(math.ceil(share * total - 1e-9))).select("dst", "kind")


TASK_ROWS, MOST_HOT = 200_000, 20_000
"""Rows of one key that a task may take, and most keys that count as hot: the budget of a task grows once the table is larger than their product."""


def dealt_keys(rows: DataFrame, keys: list[str], total: int | None = None, budget: int = TASK_ROWS, most: int = MOST_HOT) -> DataFrame:
    """(keys, salts): keys with more rows than one task should take, and over how many tasks each is to be dealt.

    A key is hot by rows per task, not by its share. There are fewer than `most` of them, and fewer than twice that salts in all, whatever the table's size:
    the budget is at least a `most`-th of all rows. total: the number of rows, if it is known.
    """
    budget = max(budget, (rows.count() if total is None else total) // most)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_key"))
    return counts.where(F.col("n_key") > budget).select(*keys, F.ceil(F.col("n_key") / budget).cast("int").alias("salts"))


def hot_keys(rows: DataFrame, keys: list[str], parts: int = MOST_HOT, least: int = TASK_ROWS) -> DataFrame:
    """The keys alone: those with more than one `parts`-th of all rows and more than `least` rows."""
    return dealt_keys(rows, keys, budget=least, most=parts).select(*keys)


def spread(rows: DataFrame, other: DataFrame, keys: list[str], by: Column, hot: DataFrame, salts: int = 32) -> tuple[DataFrame, DataFrame]:
    """Both sides of an equi-join on `keys` with a column `salt` to be added to the join keys.

    Rows of a hot key are dealt to as many tasks as `hot` says (`salts`, where it has no such column) by a hash of `by`; the other side repeats only its rows of hot keys,
    once a salt. Every other row has salt 0. `hot` comes from dealt_keys or hot_keys, so its size is bounded and it is broadcast.
    """
    mark = F.broadcast(hot if "salts" in hot.columns else hot.withColumn("salts", F.lit(salts)))
    a = rows.join(mark, keys, "left").withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64(by), F.col("salts"))).otherwise(F.lit(0)).cast(T.IntegerType())).drop("salts")
    b = other.join(mark, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return a, b


def salted(rows: DataFrame, other: DataFrame, keys: list[str], by: Column, total: int | None = None, hot: DataFrame | None = None, budget: int = TASK_ROWS) -> tuple[DataFrame, DataFrame]:
    """spread by the hot keys of rows, or by those given. A table known to be within one task's budget has nothing to count and nothing to deal."""
    if hot is None and total is not None and total <= budget:
        return rows.withColumn("salt", F.lit(0)), other.withColumn("salt", F.lit(0))
    return spread(rows, other, keys, by, keep(dealt_keys(rows, keys, total, budget), "hot") if hot is None else hot)
