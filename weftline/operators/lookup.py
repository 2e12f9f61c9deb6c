"""Lookups, counts, checks, patterns and caps over the graph."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import Graph
from weftline.schema import CALLABLE, EXTERNAL_EDGES
from weftline.sources.scratch import keep


def context(g: Graph, seeds: DataFrame) -> DataFrame:
    """(repo, id, direction, ord, other, kind): all edges of any kind into and out of each (repo, id) of seeds, with their multiplicity."""
    s = seeds.select("repo", "id").distinct()
    into = g.edges.select("repo", F.col("dst").alias("id"), F.lit("in").alias("direction"), "ord", F.col("src").alias("other"), "kind")
    out = g.edges.select("repo", F.col("src").alias("id"), F.lit("out").alias("direction"), "ord", F.col("dst").alias("other"), "kind")
    return into.unionByName(out).join(s, ["repo", "id"], "left_semi")


def kind_counts(g: Graph) -> DataFrame:
    """(repo, packages, funcs, types, total)."""
    k = F.col("kind")
    return g.nodes.groupBy("repo").agg(F.count_if(k == "package").alias("packages"), F.count_if(k.isin(*CALLABLE)).alias("funcs"), F.count_if(k.isin("type", "interface", "class")).alias("types"), F.count(F.lit(1)).alias("total"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("repo", F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))


def degree(edges: DataFrame) -> DataFrame:
    """(repo, id, degree) of every end of an edge, with multiplicity."""
    ends = edges.select("repo", F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("repo", "id").agg(F.count(F.lit(1)).alias("degree"))


def hot_symbols(g: Graph, limit: int | None = None) -> DataFrame:
    """(repo, id, name, callers): functions and methods by the number of calls into them."""
    n = g.kind("calls").groupBy("repo", F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    hot = g.nodes.where(F.col("kind").isin(*CALLABLE)).select("repo", "id", "name").join(n, ["repo", "id"])
    return hot if limit is None else hot.orderBy(F.desc("callers"), "name", "repo", "id").limit(limit)


def implementors(g: Graph, kinds: tuple[str, ...] = ("interface",)) -> DataFrame:
    """(repo, id, name, implementors): interfaces (or symbols of other kinds) with the sorted names of what implements them."""
    who = g.kind("implements").join(g.nodes.select("repo", F.col("id").alias("src"), F.col("name").alias("by")), ["repo", "src"]).groupBy("repo", F.col("dst").alias("id")).agg(F.sort_array(F.collect_list("by")).alias("implementors"))
    return g.nodes.where(F.col("kind").isin(*kinds)).select("repo", "id", "name").join(who, ["repo", "id"])


# What an import path contains and the framework it tells of.
FRAMEWORKS = {
    "gin-gonic/gin": "Gin",
    "labstack/echo": "Echo",
    "go-chi/chi": "Chi",
    "gorilla/mux": "Gorilla Mux",
    "gofiber/fiber": "Fiber",
    "gorm.io": "GORM",
    "jmoiron/sqlx": "sqlx",
    "google.golang.org/grpc": "gRPC",
    "connectrpc.com": "Connect",
    "spf13/cobra": "Cobra",
    "urfave/cli": "urfave/cli",
    "spf13/viper": "Viper",
    "stretchr/testify": "Testify",
    "vue": "Vue",
    "react": "React",
    "express": "Express",
    "next": "Next.js",
    "@nestjs": "NestJS",
    "svelte": "Svelte",
    "axios": "Axios",
}


def frameworks(g: Graph, known: dict[str, str] = FRAMEWORKS) -> DataFrame:
    """(repo, framework) found in import targets. The list is a literal of the plan, so there is no join."""
    labels = F.array(*(F.when(F.col("dst").contains(k), F.lit(v)) for k, v in known.items()))
    return g.kind("imports").select("repo", "dst").distinct().select("repo", F.explode(F.array_compact(labels)).alias("framework")).distinct()


def missing_ids(g: Graph, asked: DataFrame) -> DataFrame:
    """The rows of asked (repo, pos, id) whose id the graph hasn't, with their order and repetitions."""
    return asked.join(g.nodes.select("repo", "id"), ["repo", "id"], "left_anti")


def dangling(g: Graph) -> DataFrame:
    """(repo, ord, src, dst, kind): edges with an end outside the graph, but for kinds that may end there. Calls of external functions count.

    Ends are looked up once each, however many edges they have; the edges then meet only the ends that are missing.
    """
    e = g.edges.where(~F.col("kind").isin(*EXTERNAL_EDGES))
    ends = e.select("repo", F.explode(F.array("src", "dst")).alias("id")).distinct()
    lost = keep(ends.join(g.nodes.select("repo", "id"), ["repo", "id"], "left_anti"), "lost")
    for end in ("src", "dst"):
        e = e.join(lost.select("repo", F.col("id").alias(end), F.lit(True).alias(f"no_{end}")), ["repo", end], "left")
    return e.where("no_src OR no_dst").select("repo", "ord", "src", "dst", "kind")


_PATTERN = re.compile(r"^\s*\(\s*\w*\s*(?::\s*(\w+))?\s*\)\s*-\s*\[\s*\w*\s*(?::\s*(\w+))?\s*\]\s*->\s*\(\s*\w*\s*(?::\s*(\w+))?\s*\)\s*$")


def pattern(g: Graph, text: str, limit: int | None = 100) -> DataFrame:
    """(repo, ord, src, dst, kind): edges that fit (a:kind)-[:KIND]->(b:kind), first by ord. Node kinds are case-sensitive, edge kinds not; each may be left out.

    Nodes are joined only where their kind is asked for. A limit that is not positive is 100; None is no limit.
    """
    m = _PATTERN.match(text)
    if not m:
        raise ValueError(f"not a pattern: {text!r}; expected (a:Kind)-[:EDGE]->(b:Kind)")
    a, kind, b = m.groups()
    e = g.edges if not kind else g.edges.where(F.col("kind") == kind.lower())
    for end, want in (("src", a), ("dst", b)):
        if want:
            e = e.join(g.nodes.where(F.col("kind") == want).select("repo", F.col("id").alias(end)), ["repo", end], "left_semi")
    e = e.select("repo", "ord", "src", "dst", "kind").orderBy("ord", "repo")
    return e if limit is None else e.limit(limit if limit > 0 else 100)


def top_graph(g: Graph, limit: int) -> tuple[DataFrame, DataFrame]:
    """The `limit` nodes of highest degree (ties by repo, id) and the edges among them; all if limit is not positive."""
    if limit <= 0:
        return g.nodes, g.edges
    d = g.nodes.join(degree(g.edges), ["repo", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    top = d.orderBy(F.desc("degree"), "repo", "id").limit(limit)
    ids = keep(top.select("repo", "id"), "top")  # its size is known now, so it is broadcast if it is small
    e = g.edges
    for end in ("src", "dst"):
        e = e.join(ids.withColumnRenamed("id", end), ["repo", end], "left_semi")
    return top, e


def repo_counts(registry: DataFrame, g: Graph) -> DataFrame:
    """(name, path, nodes): repos of the registry with their number of symbols, 0 where nothing is stored."""
    n = g.nodes.groupBy(F.col("repo").alias("name")).agg(F.count(F.lit(1)).alias("nodes"))
    return registry.join(n, "name", "left").select("name", "path", F.coalesce("nodes", F.lit(0)).alias("nodes"))


# File extensions and what they are called.
LANGUAGES = {".go": "go", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".vue": "vue", ".py": "python", ".md": "markdown", ".json": "json"}


def language(file: str = "file") -> Column:
    """The language of a path by its extension; '' if unknown."""
    ext = F.lower(F.regexp_extract(file, r"(\.[^./]*)$", 1))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))[ext], F.lit(""))


def inside(root: str | Column, path: str | Column) -> Column:
    """Whether a path, with . and .. resolved, lies in root or is root."""
    root, path = (F.col(x) if isinstance(x, str) else x for x in (root, path))
    norm = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))), lambda acc: F.concat(F.lit("/"), F.array_join(acc, "/")))
    top = F.regexp_replace(root, "/+$", "")
    return (norm == top) | norm.startswith(F.concat(top, F.lit("/")))


ROOTS = "/srv/index/"
"""Where repos lie whose registry says nothing else."""


def source_slices(g: Graph, sources: DataFrame, seeds: DataFrame, before: int = 3, after: int = 120, roots: DataFrame | None = None) -> DataFrame:
    """(repo, id, file, start_line, code, lang): the lines around each (repo, id) of seeds.

    before outside 0..50 is 3, after outside 1..400 is 120. A symbol without a line shows the head of its file. A line beyond the end of the file gives ''. Files outside the root that
    `roots` (repo, root) has for the repo, or ROOTS<repo> without it, are not shown. Of several contents of a file the least holds. A file is cut into lines once, whatever the number of its symbols.
    """
    before = before if 0 <= before <= 50 else 3
    after = after if 0 < after <= 400 else 120
    at = g.nodes.join(seeds.select("repo", "id").distinct(), ["repo", "id"], "left_semi").where("file <> ''").select("repo", "id", "file", "line")
    at = at.withColumn("root", F.concat(F.lit(ROOTS), F.col("repo"))) if roots is None else at.join(roots.select("repo", "root"), "repo")
    at = at.where(inside("root", "file"))
    files = sources.where("content IS NOT NULL").join(at.select("repo", "file").distinct(), ["repo", "file"], "left_semi").groupBy("repo", "file").agg(F.min("content").alias("content"))
    files = files.select("repo", "file", F.split("content", "\n").alias("lines"))
    start = F.greatest(F.when(F.col("line") == 0, 1).otherwise(F.col("line") - before), F.lit(1))
    end = F.least(F.when(F.col("line") == 0, after).otherwise(F.col("line") + after), F.size("lines"))
    got = at.join(files, ["repo", "file"]).withColumn("start_line", start).withColumn("n", F.greatest(end - start + 1, F.lit(0)))
    return got.select("repo", "id", "file", "start_line", F.array_join(F.slice("lines", F.col("start_line"), F.col("n")), "\n").alias("code"), language().alias("lang"))


def explorer_tree(g: Graph) -> DataFrame:
    """(repo, dir, file, symbols): files below the repo's common folder, with the sorted names of their symbols."""
    n = g.nodes.where("file <> ''").withColumn("parts", F.split("file", "/"))
    # the common folder: as many leading parts as the least and the greatest path share
    ends = n.groupBy("repo").agg(F.min("file").alias("lo"), F.max("file").alias("hi"))
    lo, hi = F.split("lo", "/"), F.split("hi", "/")
    same = F.transform(F.sequence(F.lit(1), F.least(F.size(lo), F.size(hi)) - 1), lambda i: F.when(F.slice(lo, 1, i) == F.slice(hi, 1, i), i).otherwise(0))
    depth = ends.select("repo", F.when(F.least(F.size(lo), F.size(hi)) > 1, F.array_max(same)).otherwise(0).alias("skip"))
    rel = n.join(depth, "repo").withColumn("rest", F.expr("slice(parts, skip + 1, size(parts))"))
    return rel.groupBy("repo", F.expr("array_join(slice(rest, 1, size(rest) - 1), '/')").alias("dir"), F.expr("rest[size(rest) - 1]").alias("file")).agg(F.sort_array(F.collect_list("name")).alias("symbols"))


def visible(g: Graph, hidden: tuple[str, ...] = (), near: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without nodes of hidden kinds and, if `near` (repo, id) is given, without those outside it; edges keep both ends."""
    n = g.nodes.where(~F.col("kind").isin(*hidden)) if hidden else g.nodes
    n = n if near is None else n.join(near.select("repo", "id").distinct(), ["repo", "id"], "left_semi")
    e = g.edges
    for end in ("src", "dst"):
        e = e.join(n.select("repo", F.col("id").alias(end)), ["repo", end], "left_semi")
    return n, e
