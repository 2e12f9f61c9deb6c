"""Closures over edges, for many seeds at once.

Repos whose links fit a task are walked there, all at once (`intask`): one shuffle by repo, whatever the depth. Larger repos, and only they, go through
loops of joins (`closure`): each level joins the frontier with the adjacency, drops pairs seen before and is written as a table, so that the lineage of a level is
one scan. All seeds of all such repos go together: the number of jobs is the depth of the deepest closure. The adjacency is partitioned by its join key once for
all levels, the links of hot keys dealt to several tasks. A frontier small enough is broadcast by the optimizer, which knows its size from the table's files.
Both ways give the same rows (tested); `bound` says how many links of a repo a task may take.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weftline.operators import intask
from weftline.operators.hotkeys import dealt_keys
from weftline.sources.scratch import keep, place


_WHOLE = "repo IS NOT NULL AND root IS NOT NULL AND id IS NOT NULL"


def _adjacency(links: DataFrame, reverse: bool, cols: tuple[str, ...] = ()) -> DataFrame:
    """(repo, at, salt, to, cols): links by where they start, those of hot starts dealt to several tasks."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = links.select("repo", F.col(a).alias("at"), F.col(b).alias("to"), *cols).distinct()
    step = step.join(F.broadcast(dealt_keys(step, ["repo", "at"])), ["repo", "at"], "left").withColumn("salt", F.pmod(F.xxhash64("to"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    return step.repartition(parts, "repo", "at", "salt").persist(StorageLevel.MEMORY_AND_DISK)


def _hot(step: DataFrame) -> DataFrame:
    """(repo, id, salts) of the starts that _adjacency dealt; it bounds their number."""
    return step.where("salt > 0").groupBy("repo", F.col("at").alias("id")).agg((F.max("salt") + 1).alias("salts")).hint("broadcast")


def _meeting(step: DataFrame, cols: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """What joins rows of (repo, id, cols) with the links that start at their ids; rows of hot ids go to each task that has some of them. The expressions are made once for all levels."""
    s = step.withColumnsRenamed({"repo": "s_repo", "salt": "s_salt"})
    salt = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    on = (F.col("repo") == F.col("s_repo")) & (F.col("id") == F.col("at")) & (F.col("salt") == F.col("s_salt"))
    return lambda level, hot: level.join(hot, ["repo", "id"], "left").withColumn("salt", salt).join(s, on).selectExpr(*cols)


def _ends(links: DataFrame) -> DataFrame:
    """(repo, src, dst); repeated links change nothing. A table that was written already is taken as it is."""
    return links if links.columns == ["repo", "src", "dst"] else links.select("repo", "src", "dst")


def _parts(links: DataFrame, bound: int) -> tuple[DataFrame, DataFrame | None]:
    """(links of repos of at most `bound` links, those of the others), written once; None where there are none."""
    links = keep(links, "links")
    if links.count() <= bound:
        return links, None
    big = keep(links.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bound).select("repo"), "big")
    if big.isEmpty():
        return links, None
    return links.join(big, "repo", "left_anti"), links.join(big, "repo", "left_semi")


def _seeded(seeds: DataFrame, other: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The seeds of repos that are walked in tasks, and of those that are not."""
    if other is None:
        return seeds, None
    big = other.select("repo").distinct()
    return seeds.join(big, "repo", "left_anti"), seeds.join(big, "repo", "left_semi")


def reached(links: DataFrame, seeds: DataFrame, reverse: bool = False, most: int | None = None, bound: int = intask.LINKS) -> DataFrame:
    """(repo, root, id, depth): what each seed reaches, by the fewest steps; the seed itself at depth 0.

    links: (repo, src, dst). seeds: (repo, root, id). Seeds need not be nodes. Cycles end where they began. An empty set of seeds gives no rows, nor do seeds without repo.
    most: so many steps at most; without it, to the end of the longest chain.
    """
    small, big = _parts(_ends(links), bound)
    own, other = _seeded(seeds.select("repo", "root", "id").distinct(), big)
    got = intask.closure(small, own.where(_WHOLE), reverse, most)
    return got if big is None else got.unionByName(closure(big, other, reverse, most))


def reach_counts(links: DataFrame, seeds: DataFrame, counted: DataFrame | None = None, reverse: bool = False, bound: int = intask.LINKS, roots: int = 10_000) -> DataFrame:
    """(repo, root, n): how many different ids each root reaches, seeds included; only those among counted (repo, id), if given.

    Pairs of root and id never leave the task; for repos beyond the bound they are made and counted for about `roots` roots at a time.
    """
    small, big = _parts(_ends(links), bound)
    own, other = _seeded(seeds.select("repo", "root", "id").distinct(), big)
    got = intask.reach(small, own.where(_WHOLE), counted, reverse)
    if big is None:
        return got
    other = keep(other, "roots")
    blocks = max(1, -(-other.count() // roots))
    for k in range(blocks):
        pairs = closure(big, other.where(F.pmod(F.xxhash64("repo", "root"), F.lit(blocks)) == k), reverse)
        pairs = pairs if counted is None else pairs.join(counted.select("repo", "id"), ["repo", "id"], "left_semi")
        got = got.unionByName(keep(pairs.groupBy("repo", "root").agg(F.count(F.lit(1)).alias("n")), "reach"))
    return got


def closure(links: DataFrame, seeds: DataFrame, reverse: bool = False, most: int | None = None) -> DataFrame:
    """The rows of `reached` by the loop of joins, for repos of any size."""
    spark = links.sparkSession
    step = _adjacency(links, reverse)
    hot = _hot(step).persist(StorageLevel.MEMORY_AND_DISK)
    meet = _meeting(step, ["repo", "root", "to AS id"])
    base = place(spark, "closure")
    at = lambda depth: f"{base}/depth={depth}"  # noqa: E731  the depth is a partition, so every level has the same plan and the same code
    n = _write(seeds.select("repo", "root", "id").distinct(), at(0))
    depth = 0
    while n and (most is None or depth < most):
        level = spark.read.schema("repo string, root string, id string").parquet(at(depth))
        seen = _levels(spark, base, depth)
        depth += 1
        far = meet(level, hot).distinct()
        n = _write(far.join(seen, ["repo", "root", "id"], "left_anti"), at(depth))
    step.unpersist()
    hot.unpersist()
    return _levels(spark, base, depth)


def _write(df: DataFrame, path: str) -> int:
    """Writes a level and returns its number of rows, counted on the way."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return seen.get["n"]


def _levels(spark: SparkSession, base: str, depth: int) -> DataFrame:
    """(repo, root, id, depth) of the levels up to a depth, as one scan."""
    return spark.read.schema("repo string, root string, id string, depth bigint").option("basePath", base).parquet(*(f"{base}/depth={d}" for d in range(depth + 1)))


def impact(links: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(repo, root, id, depth, confidence): transitive callers of each seed without the seed; confidence is 1 / depth."""
    return reached(links, seeds, reverse=True, most=most).where("depth > 0").withColumn("confidence", 1 / F.col("depth"))


def dependencies(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(repo, root, id, depth): what each seed calls, directly or not, external ids included."""
    return reached(links, seeds).where("depth > 0")


def first_root(links: DataFrame, roots: DataFrame, bound: int = intask.LINKS) -> DataFrame:
    """(repo, id, root): the least of the roots (repo, id) that reaches an id, itself included."""
    small, big = _parts(_ends(links), bound)
    own, other = _seeded(roots.select("repo", "id").distinct(), big)
    got = intask.first_root(small, own.where("repo IS NOT NULL AND id IS NOT NULL"))
    return got if big is None else got.unionByName(least_label(big, other.select("repo", "id", F.col("id").alias("label"))).withColumnRenamed("label", "root"))


def least_label(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(repo, id, label): the least label among those that reach the id, by a loop of joins. labels: (repo, id, label) to begin with.

    Only ids whose label got smaller speak in the next round, and a round writes nothing but them: what is known of an id is the least of what was ever written.
    """
    spark = links.sparkSession
    step = _adjacency(links, False)
    hot = _hot(step).persist(StorageLevel.MEMORY_AND_DISK)
    meet = _meeting(step, ["repo", "to AS id", "label"])
    base, k = place(spark, "label"), 0
    first = labels.groupBy("repo", "id").agg(F.min("label").alias("label"))
    read = lambda *at: spark.read.schema(first.schema).parquet(*(f"{base}/{x}" for x in at))
    n = _write(first, f"{base}/0")
    while n:
        heard = meet(read(k), hot).groupBy("repo", "id").agg(F.min("label").alias("label"))
        old = read(*range(k + 1)).withColumnsRenamed({"repo": "o_repo", "id": "o_id", "label": "o_label"})
        k += 1
        n = _write(heard.join(old, (heard["repo"] == F.col("o_repo")) & (heard["id"] == F.col("o_id")) & (F.col("o_label") <= heard["label"]), "left_anti"), f"{base}/{k}")
    step.unpersist()
    hot.unpersist()
    return read(*range(k + 1)).groupBy("repo", "id").agg(F.min("label").alias("label"))


def trace(edges: DataFrame, pairs: DataFrame, bound: int = intask.LINKS) -> DataFrame:
    """(repo, src, dst, step, id): a shortest path for each (repo, src, dst) of pairs, both ends included; no rows if there is none.

    Of several shortest paths the one whose edges' ord come first, read from the start, holds. src = dst gives the one id, known or not.
    """
    small, big = _parts(edges.where("kind = 'calls'").groupBy("repo", "src", "dst").agg(F.min("ord").alias("ord")), bound)
    own, other = _seeded(pairs.select("repo", "src", "dst").distinct(), big)
    got = intask.trace(small, own.where("repo IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL"))
    return got if big is None else got.unionByName(_trace(big, other))


def _trace(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same by a loop of joins. Each level is a folder of one table, so the plan of a level has the same length whatever the depth."""
    spark = links.sparkSession
    step = _adjacency(links, False, ("ord",))
    hot = _hot(step).persist(StorageLevel.MEMORY_AND_DISK)
    meet = _meeting(step, ["repo", "src", "dst", "to AS id", "concat(ords, array(ord)) AS ords", "concat(path, array(to)) AS path"])
    base, depth = place(spark, "trace"), 0
    schema = "repo string, src string, dst string, id string, ords array<bigint>, path array<string>"
    read = lambda ks, cols=schema: spark.read.schema(cols).parquet(*(f"{base}/{k}" for k in ks))
    n = _write(pairs.select("repo", "src", "dst", F.col("src").alias("id"), F.array().cast("array<bigint>").alias("ords"), F.array("src").alias("path")), f"{base}/0")
    while n:
        arrived = read(range(depth + 1)).where("id = dst").select("repo", "src", "dst")  # they stop
        level = read([depth]).join(arrived, ["repo", "src", "dst"], "left_anti")
        first = meet(level, hot).groupBy("repo", "src", "dst", "id").agg(F.min(F.struct("ords", "path")).alias("p")).select("repo", "src", "dst", "id", "p.ords", "p.path")
        seen = read(range(depth + 1), "repo string, src string, dst string, id string")
        depth += 1
        n = _write(first.join(seen, ["repo", "src", "dst", "id"], "left_anti"), f"{base}/{depth}")
    step.unpersist()
    hot.unpersist()
    return read(range(depth + 1)).where("id = dst").select("repo", "src", "dst", F.posexplode("path").alias("step", "id"))


def neighbourhood(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) within `depth` steps of each seed, by edges of any kind in either direction.

    nodes: (repo, root, id, depth), only those of the graph, though steps may pass through others. edges: (repo, root, src, dst, kind), each
    once, those that touch an id fewer than `depth` steps away.
    """
    both = edges.select("repo", "src", "dst").unionByName(edges.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = keep(reached(both, seeds, most=depth), "near")
    inner = near.where(F.col("depth") < depth).select("repo", "root", F.col("id").alias("end"))
    e = edges.select("repo", "src", "dst", "kind").distinct()
    touch = e.withColumn("end", F.explode(F.array("src", "dst"))).join(inner, ["repo", "end"]).select("repo", "root", "src", "dst", "kind").distinct()
    return near.join(nodes.select("repo", "id"), ["repo", "id"], "left_semi").select("repo", "root", "id", "depth"), touch
