"""The graph: symbols, edges, routes and access shapes of many repos as DataFrames, keyed by (repo, id)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.edges import clean_kind, is_edge
from weftline.sources.scratch import keep
from weftline.sources.tables import table

_TEXT = ("kind", "name", "package", "file", "signature", "doc")


@dataclass
class Graph:
    """nodes, edges, routes, shapes as in weftline.schema. Each is lazy; a graph of one repo is a filter away."""

    nodes: DataFrame
    edges: DataFrame
    routes: DataFrame
    shapes: DataFrame | None = None
    _calls: DataFrame | None = field(default=None, init=False, repr=False, compare=False)

    def of(self, *repos: str) -> Graph:
        """The part of the graph in the named repos; partitioned storage reads nothing else."""
        cut = lambda df: None if df is None else df.where(F.col("repo").isin(*repos))
        return Graph(cut(self.nodes), cut(self.edges), cut(self.routes), cut(self.shapes))

    def kind(self, kind: str) -> DataFrame:
        return self.edges.where(F.col("kind") == kind)

    def calls(self) -> DataFrame:
        """(repo, src, dst): each call relationship once, written the first time it is asked for."""
        if self._calls is None:
            self._calls = keep(self.kind("calls").select("repo", "src", "dst").distinct(), "calls")
        return self._calls

    def merge(self, other: Graph) -> Graph:
        """Union of two graphs. Of two nodes with one key this graph's holds; edges keep their multiplicity, and loops and edges without ends go."""
        rank = self.nodes.withColumn("_first", F.lit(0)).unionByName(other.nodes.withColumn("_first", F.lit(1)))
        cols = [c for c in self.nodes.columns if c not in ("repo", "id")]
        nodes = rank.where("id <> ''").groupBy("repo", "id").agg(F.min_by(F.struct(*cols), "_first").alias("n")).select("repo", "id", *(F.col(f"n.{c}").alias(c) for c in cols))
        edges = self.edges.withColumn("_first", F.lit(0)).unionByName(other.edges.withColumn("_first", F.lit(1))).where(is_edge())
        last = self.edges.groupBy("repo").agg(F.max("ord").alias("_last"))  # the other's edges come after
        edges = edges.join(last, "repo", "left").withColumn("ord", F.when(F.col("_first") == 0, F.col("ord")).otherwise(F.col("ord") + F.coalesce(F.col("_last") + 1, F.lit(0)))).select(*self.edges.columns)
        shapes = self.shapes.unionByName(other.shapes) if self.shapes is not None and other.shapes is not None else self.shapes if other.shapes is None else other.shapes
        return Graph(nodes.select(self.nodes.columns), edges, self.routes.unionByName(other.routes), shapes)


def load(spark: SparkSession, d: str) -> Graph:
    """The graph as it is now: rows of nodes that live, edges and routes delivered so far, in the order of ord.

    Of several living rows of a symbol the last by indexed_at holds (then the greatest line, signature, doc and so on). Nulls become '' and 0. Repeated rows count once; rows
    that are no edges go; edges may end outside the graph. Methods of routes are read without white space and in upper case.
    """
    n = table(spark, d, "nodes").where("removed_at IS NULL AND id <> '' AND repo IS NOT NULL")
    n = n.select("repo", "id", *(F.coalesce(c, F.lit("")).alias(c) for c in _TEXT), F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("fields", F.array().cast("array<string>")).alias("fields"), "indexed_at")
    order = ("indexed_at", "line", "signature", "doc", "name", "file", "package", "kind", "fields")
    n = n.groupBy("repo", "id").agg(F.max(F.struct(*order)).alias("n"))
    nodes = n.select("repo", "id", *(f"n.{c}" for c in ("kind", "name", "package", "file", "line", "signature", "doc", "fields")))
    e = table(spark, d, "edges").where(is_edge() & F.col("repo").isNotNull())
    edges = e.select("repo", "ord", "src", "dst", clean_kind().alias("kind")).dropDuplicates(["repo", "ord", "src", "dst", "kind"])
    r = table(spark, d, "routes").where("repo IS NOT NULL")
    routes = r.select("repo", "ord", F.upper(F.trim(F.coalesce("method", F.lit("")))).alias("method"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("handler", F.lit("")).alias("handler")).distinct()
    return Graph(nodes, edges, routes)


def kept(g: Graph) -> Graph:
    """The same graph, cleaned once: operators that pass over it many times read the cleaned tables."""
    return Graph(keep(g.nodes, "nodes"), keep(g.edges, "edges"), g.routes, g.shapes)
