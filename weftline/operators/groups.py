"""Contracts between repos of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.graph import Graph
from weftline.operators.lookup import top_graph
from weftline.schema import API_KINDS

# A key with more contracts is too general to link; a group's graph shows no more links.
MOST_PER_KEY, MOST_LINKS = 12, 400


def contracts(g: Graph) -> DataFrame:
    """(repo, key, kind, id): exported symbols by name and routes by method and path. Route contracts carry the path as id."""
    names = g.nodes.where(F.col("kind").isin(*API_KINDS) & F.col("name").rlike(r"^\p{Lu}"))
    routes = g.routes.select("repo", F.concat_ws(" ", "method", "path").alias("key"), F.lit("route").alias("kind"), F.col("path").alias("id"))
    return names.select("repo", F.col("name").alias("key"), F.lit("symbol").alias("kind"), "id").unionByName(routes)


def links(c: DataFrame) -> DataFrame:
    """(key, repos): keys that two or more repos share, with the sorted repos."""
    return c.groupBy("key").agg(F.sort_array(F.collect_set("repo")).alias("repos")).where("size(repos) > 1")


def contract_counts(c: DataFrame) -> DataFrame:
    return c.groupBy("repo").agg(F.count(F.lit(1)).alias("contracts"))


def cross_impact(g: Graph, seeds: DataFrame) -> DataFrame:
    """(repo, id, other): for each (repo, id) of seeds the other repos that share a contract of its name."""
    own = g.nodes.join(seeds.select("repo", "id").distinct(), ["repo", "id"], "left_semi").select("repo", "id", F.col("name").alias("key"))
    return own.join(links(contracts(g)), "key").select("repo", "id", F.explode("repos").alias("other")).where("other <> repo")


def contract_edges(c: DataFrame, present: DataFrame, most_per_key: int = MOST_PER_KEY, most: int | None = MOST_LINKS) -> DataFrame:
    """(repo_a, id_a, repo_b, id_b): contracts of one key in two repos, both among present (repo, id), from the smaller repo to the greater.

    Keys are counted before any pair is made, so a pair comes from a key of at most most_per_key contracts. Each pair comes once; the first `most` by key and ends are kept.
    """
    n = c.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, most_per_key)).select("key")
    few = c.join(n, "key", "left_semi").join(present.select("repo", "id"), ["repo", "id"], "left_semi").distinct()
    a = few.select("key", F.col("repo").alias("repo_a"), F.col("id").alias("id_a"))
    b = few.select("key", F.col("repo").alias("repo_b"), F.col("id").alias("id_b"))
    pairs = a.join(b, "key").where("repo_a < repo_b").groupBy("repo_a", "id_a", "repo_b", "id_b").agg(F.min("key").alias("key"))
    if most is not None:
        pairs = pairs.orderBy("key", "repo_a", "id_a", "repo_b", "id_b").limit(most)
    return pairs.drop("key")


def group_graph(g: Graph, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the repos of a group, cut to the `limit` nodes of highest degree if positive; edges (repo, src, dst, kind, dst_repo), those of kind contract cross repos."""
    nodes, edges = top_graph(g, limit)
    ids = nodes.select("repo", "id")
    if limit <= 0:
        for end in ("src", "dst"):
            edges = edges.join(ids.withColumnRenamed("id", end), ["repo", end], "left_semi")
    own = edges.select("repo", "src", "dst", "kind", F.col("repo").alias("dst_repo"))
    cross = contract_edges(contracts(g), ids).select(F.col("repo_a").alias("repo"), F.col("id_a").alias("src"), F.col("id_b").alias("dst"), F.lit("contract").alias("kind"), F.col("repo_b").alias("dst_repo"))
    return nodes, own.unionByName(cross)


def upsert_group(groups: DataFrame, name: str, repos: list[str], registry: DataFrame, create: bool = False) -> DataFrame:
    """The groups with repos added to one. Group (unless it is created) and repos must be known; adding twice changes nothing."""
    known = {r.name for r in registry.where(F.col("name").isin(*repos)).select("name").collect()} if repos else set()
    if lost := [r for r in repos if r not in known]:
        raise KeyError(f"repos not registered: {lost}")
    if not create and groups.where(F.col("name") == name).isEmpty():
        raise KeyError(f"no such group: {name}")
    new = groups.sparkSession.createDataFrame([(name, sorted(set(repos)))], "name string, repos array<string>")
    return groups.unionByName(new).groupBy("name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("repos")))).alias("repos"))


def remove_from_group(groups: DataFrame, name: str, repos: list[str]) -> DataFrame:
    gone = F.array(*(F.lit(r) for r in repos)).cast("array<string>")
    return groups.withColumn("repos", F.when(F.col("name") == name, F.array_except("repos", gone)).otherwise(F.col("repos")))
