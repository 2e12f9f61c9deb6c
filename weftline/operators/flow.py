"""Entry points and the execution flows rooted at them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import Graph
from weftline.operators.traverse import first_root, impact, reach_counts, reached
from weftline.schema import CALLABLE
from weftline.sources.scratch import keep


def entry_points(g: Graph) -> DataFrame:
    """Functions and methods that nothing calls and that call something."""
    calls = g.kind("calls")
    roots = g.nodes.where(F.col("kind").isin(*CALLABLE))
    called, caller = calls.select("repo", F.col("dst").alias("id")).distinct(), calls.select("repo", F.col("src").alias("id")).distinct()
    return roots.join(called, ["repo", "id"], "left_anti").join(caller, ["repo", "id"], "left_semi")


def flow_nodes(g: Graph, roots: DataFrame) -> DataFrame:
    """(repo, root, id): the symbols of the graph in the flow of each (repo, id) of roots, the root included if it is one."""
    seeds = roots.select("repo", F.col("id").alias("root"), "id")
    return keep(reached(g.calls(), seeds).join(g.nodes.select("repo", "id"), ["repo", "id"], "left_semi").select("repo", "root", "id"), "flow")


def flow_edges(g: Graph, flow: DataFrame) -> DataFrame:
    """(repo, root, src, dst): the calls among the nodes of each flow, once."""
    calls = g.calls()
    by = flow.select("repo", "root", F.col("id").alias("src"))
    return calls.join(by, ["repo", "src"]).join(flow.select("repo", "root", F.col("id").alias("dst")), ["repo", "root", "dst"], "left_semi").select("repo", "root", "src", "dst")


def flow_sizes(g: Graph) -> DataFrame:
    """(repo, id, name, size): how many symbols the flow of each entry point has. Counted where the flows are walked: no pairs of entry and symbol are made."""
    entries = entry_points(g)
    sizes = reach_counts(g.calls(), entries.select("repo", F.col("id").alias("root"), "id"), g.nodes.select("repo", "id")).select("repo", F.col("root").alias("id"), F.col("n").alias("size"))
    return entries.select("repo", "id", "name").join(sizes, ["repo", "id"])


def process_of(g: Graph) -> DataFrame:
    """(repo, id, process): the name of the first entry point, by id, whose flow reaches the symbol; '' if none does."""
    entries = entry_points(g).select("repo", "id", "name")
    named = first_root(g.calls(), entries).join(entries.select("repo", F.col("id").alias("root"), F.col("name").alias("process")), ["repo", "root"])
    return g.nodes.select("repo", "id").join(named, ["repo", "id"], "left").select("repo", "id", F.coalesce("process", F.lit("")).alias("process"))


def processes_of(g: Graph, seeds: DataFrame) -> DataFrame:
    """(repo, root, id, name): the entry points whose flow reaches each (repo, id) of seeds, itself included if it is one."""
    s = seeds.select("repo", F.col("id").alias("root"), "id")
    reach = impact(g.calls(), s).select("repo", "root", "id").unionByName(s)
    return entry_points(g).select("repo", "id", "name").join(reach, ["repo", "id"]).select("repo", "root", "id", "name").distinct()


def api_impact(g: Graph, path: str | None = None) -> DataFrame:
    """(repo, ord, method, path, id, depth): transitive callers of the handler of each route; a route without handler or callers has one row with a null id."""
    routes = g.routes if path is None else g.routes.where(F.col("path") == path)
    seeds = routes.where("handler <> ''").select("repo", F.col("handler").alias("root"), F.col("handler").alias("id"))
    hit = impact(g.calls(), seeds).select("repo", F.col("root").alias("handler"), "id", "depth")
    return routes.join(hit, ["repo", "handler"], "left").select("repo", "ord", "method", "path", "id", "depth")


def caller_counts(g: Graph, files: DataFrame | None = None) -> DataFrame:
    """(repo, file, id, callers): symbols with callers, direct or not, in the given (repo, file), or in all files."""
    own = g.nodes.where("file <> ''")
    own = own if files is None else own.join(files.select("repo", "file").distinct(), ["repo", "file"], "left_semi")
    n = reach_counts(g.calls(), own.select("repo", F.col("id").alias("root"), "id"), reverse=True).where("n > 1").select("repo", F.col("root").alias("id"), (F.col("n") - 1).alias("callers"))
    return own.select("repo", "file", "id").join(n, ["repo", "id"]).select("repo", "file", "id", "callers")
