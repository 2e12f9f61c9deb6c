"""Dependence within functions: control-flow summaries and taint from sources to sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.traverse import reached
from weftline.sources.tables import table

# Calls whose results are untrusted, and calls whose arguments must not be.
SOURCES = ("os.Getenv", "(*net/http.Request).FormValue", "(*net/http.Request).PostFormValue", "(*net/http.Request).URL", "(*bufio.Reader).ReadString", "io.ReadAll")
SINKS = ("os/exec.Command", "os/exec.CommandContext", "(*database/sql.DB).Query", "(*database/sql.DB).Exec", "(*database/sql.DB).QueryRow", "os.Open", "os.OpenFile", "os.ReadFile", "os.Remove", "os.RemoveAll")


GROUP_USES = 100_000
"""Uses of values per group that one task follows, on average."""


def tainted(calls: DataFrame, uses: DataFrame) -> DataFrame:
    """(func, value): values that derive from a source's result within their function. calls: (func, value, callee, line), uses: (func, def, use)."""
    # functions are small and many: they share groups, told apart by the name before the value
    groups = max(1, uses.count() // GROUP_USES)
    group, named = F.pmod(F.xxhash64("func"), F.lit(groups)).cast("string").alias("repo"), lambda c: F.concat("func", F.lit("\0"), c)
    seeds = calls.where(F.col("callee").isin(*SOURCES)).select(group, F.lit("").alias("root"), named("value").alias("id"))
    steps = uses.select(group, named("def").alias("src"), named("use").alias("dst"))
    parts = F.split("id", "\0", 2)
    return reached(steps, seeds).select(parts[0].alias("func"), parts[1].alias("value"))


def findings(calls: DataFrame, uses: DataFrame, args: DataFrame) -> DataFrame:
    """(func, source, sink, line): sink calls with a tainted argument, once per function, sink and line. args: (func, call, value)."""
    bad = args.join(tainted(calls, uses), ["func", "value"], "left_semi").select("func", F.col("call").alias("value")).distinct()
    hit = calls.where(F.col("callee").isin(*SINKS)).join(bad, ["func", "value"], "left_semi")
    return hit.select("func", F.lit("tainted input").alias("source"), F.col("callee").alias("sink"), "line").distinct()


def taint_of(found: DataFrame, func: str = "") -> DataFrame:
    """The findings of one function; all if func is empty."""
    return found if not func else found.where(F.col("func") == func)


def control_edges(cfg: DataFrame) -> DataFrame:
    """(func, ctrl_edges): the block pairs of each function, sorted. cfg: (func, from, to)."""
    return cfg.groupBy("func").agg(F.sort_array(F.collect_set(F.struct(F.col("from").alias("src"), F.col("to").alias("dst")))).alias("ctrl_edges"))


def data_edge_counts(uses: DataFrame) -> DataFrame:
    return uses.groupBy("func").agg(F.count(F.lit(1)).alias("data_edges"))


def pdgs(spark, d: str) -> DataFrame:
    """(repo, ord, id, blocks, ctrl_edges, data_edges, params): the stored summaries, repeated rows once."""
    return table(spark, d, "func_pdgs").where("id <> ''").dropDuplicates(["repo", "ord"]).drop("indexed_at")


def pdg_of(stored: DataFrame, seeds: DataFrame) -> DataFrame:
    """The first summary by ord of each (repo, id) of seeds; the least one where summaries have no ord."""
    own = stored.join(seeds.select("repo", "id").distinct(), ["repo", "id"], "left_semi")
    cols = [c for c in stored.columns if c not in ("repo", "id")]
    return own.groupBy("repo", "id").agg(F.min_by(F.struct(*cols), F.col("ord") if "ord" in cols else F.struct(*cols)).alias("p")).select("repo", "id", *(F.col(f"p.{c}").alias(c) for c in cols))
