"""Where graphs, registries and caches are read from and written to."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import schema
from weftline.operators.graph import Graph

# Folders that hold no sources of one's own, and the extensions of the two front ends.
SKIP = ("node_modules", ".git", "dist", "build", ".nuxt", ".output", "vendor", ".weftline")
EXTENSIONS = {"go": r"\.go$", "ts": r"\.(ts|tsx|js|jsx|vue)$"}


def read_document(spark: SparkSession, path: str, repo: str) -> Graph:
    """A graph from one JSON document (as exported by write_document or by an extractor). Edges are taken as they are; their order becomes ord."""
    doc = spark.read.schema(schema.DOCUMENT).json(path, multiLine=True)
    r = F.lit(repo).alias("repo")
    n = doc.select(F.explode(F.map_entries("nodes")).alias("e")).select(r, F.col("e.key").alias("id"), *(F.coalesce(f"e.value.{c}", F.lit("")).alias(c) for c in ("kind", "name", "package", "file", "signature", "doc")), F.coalesce("e.value.line", F.lit(0)).alias("line"), F.coalesce("e.value.fields", F.array().cast("array<string>")).alias("fields"))
    e = doc.select(F.posexplode("edges").alias("ord", "e")).select(r, F.col("ord").cast("bigint").alias("ord"), F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.col("e.kind").alias("kind"))
    t = doc.select(F.posexplode("routes").alias("ord", "e")).select(r, F.col("ord").cast("bigint").alias("ord"), "e.method", "e.path", F.coalesce("e.handler", F.lit("")).alias("handler"))
    s = doc.select(F.explode("shapes").alias("e")).select(r, "e.object", "e.props", "e.file")
    return Graph(n.select(*schema.NODE_COLUMNS), e, t, s)


def write_document(g: Graph, path: str) -> None:
    """One repo's graph as one JSON document, overwritten: the exchange format, not the storage. The document is one record, so this is for graphs that one task can hold."""
    cols = ("id", "kind", "name", "package", "file", "line", "signature", "doc", "fields")
    n = g.nodes.agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct(*cols)))).alias("nodes"))
    e = g.edges.agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "src", "dst", "kind"))), lambda x: F.struct(x["src"].alias("from"), x["dst"].alias("to"), x["kind"].alias("kind"))).alias("edges"))
    r = g.routes.agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "method", "path", "handler"))), lambda x: F.struct(x["method"].alias("method"), x["path"].alias("path"), x["handler"].alias("handler"))).alias("routes"))
    doc = n.crossJoin(e).crossJoin(r)  # one row each
    if g.shapes is not None:
        doc = doc.crossJoin(g.shapes.agg(F.sort_array(F.collect_list(F.struct("object", "props", "file"))).alias("shapes")))
    doc.coalesce(1).write.mode("overwrite").json(path)


def read_payload(spark: SparkSession, path: str) -> Graph:
    """A graph from extractors' NDJSON records: {repo, record, ...} with record one of node, edge, route, shape; edges and routes carry ord."""
    rows = spark.read.schema("repo string, record string, id string, kind string, name string, package string, file string, line int, signature string, doc string, fields array<string>, ord bigint, `from` string, `to` string, method string, path string, handler string, object string, props array<string>").json(path)
    blank = lambda *cs: [F.coalesce(c, F.lit("")).alias(c) for c in cs]
    n = rows.where("record = 'node' AND id <> ''").dropDuplicates(["repo", "id"]).select("repo", "id", *blank("kind", "name", "package", "file"), F.coalesce("line", F.lit(0)).alias("line"), *blank("signature", "doc"), F.coalesce("fields", F.array().cast("array<string>")).alias("fields"))
    e = rows.where("record = 'edge' AND `from` <> '' AND `to` <> '' AND `from` <> `to`").select("repo", "ord", F.col("from").alias("src"), F.col("to").alias("dst"), "kind")
    t = rows.where("record = 'route'").select("repo", "ord", *blank("method", "path", "handler"))
    return Graph(n, e, t, rows.where("record = 'shape'").select("repo", "object", "props", "file"))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path
    return to(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), to


def _folders(fs, path) -> list[str]:
    return sorted(x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory()) if fs.exists(path) else []


def _replace(spark: SparkSession, tables: dict[str, DataFrame | None], path: str, by: list[str]) -> None:
    """Writes the tables beside the stored ones, then puts each partition that any of them has in the place of the old: in tables where it has no rows now, the old one goes."""
    fs, to = _fs(spark, path)
    new = f"{path}/_new-{uuid.uuid4().hex}"
    for name, df in tables.items():
        if df is not None:
            df.write.partitionBy(*by).parquet(f"{new}/{name}")
    parts: set[str] = set()
    for name in tables:
        firsts = _folders(fs, to(f"{new}/{name}"))
        parts |= {f"{a}/{b}" for a in firsts for b in _folders(fs, to(f"{new}/{name}/{a}"))} if len(by) > 1 else set(firsts)
    for name, df in tables.items():
        for part in sorted(parts) if df is not None else ():
            fs.delete(to(f"{path}/{name}/{part}"), True)
            if fs.exists(to(f"{new}/{name}/{part}")):
                fs.mkdirs(to(f"{path}/{name}/{part}").getParent())
                fs.rename(to(f"{new}/{name}/{part}"), to(f"{path}/{name}/{part}"))
    fs.delete(to(new), True)


def save(g: Graph, path: str) -> None:
    """The graph as Parquet by repo. The repos it holds are replaced whole, in every table; others stay. Without shapes, stored shapes of its repos stay too."""
    _replace(g.nodes.sparkSession, {"nodes": g.nodes, "edges": g.edges, "routes": g.routes, "shapes": g.shapes}, path, ["repo"])


def forget_repo(spark: SparkSession, path: str, repo: str) -> None:
    """Deletes what save wrote of a repo."""
    fs, to = _fs(spark, path)
    for name in _folders(fs, to(path)):
        for part in _folders(fs, to(f"{path}/{name}")):
            if part == f"repo={spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(repo)}":
                fs.delete(to(f"{path}/{name}/{part}"), True)


def _or_none(spark: SparkSession, read: Callable[[], DataFrame], ddl: str) -> DataFrame:
    """What is read, or no rows if nothing was written there."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], ddl)


def stored(spark: SparkSession, path: str) -> Graph:
    """The graph that save wrote. A filter on repo reads that repo's files only; tables that were never written are empty."""
    columns = lambda s: spark.createDataFrame([], s).columns  # noqa: E731  the partition column comes last in files
    read = lambda name, s: _or_none(spark, lambda: spark.read.schema(s).parquet(f"{path}/{name}").select(*columns(s)), s)
    return Graph(read("nodes", schema.NODES), read("edges", schema.EDGES), read("routes", schema.ROUTES), read("shapes", schema.SHAPES))


def save_language(g: Graph, manifest: DataFrame, path: str) -> None:
    """One language's part of repos with its fingerprints: only the (repo, lang) parts that manifest (repo, lang, fingerprint) names are replaced, whole."""
    langs = manifest.select("repo", "lang")
    part = {name: df.join(langs, "repo") for name, df in (("nodes", g.nodes), ("edges", g.edges), ("routes", g.routes))}
    _replace(manifest.sparkSession, part | {"manifest": manifest}, path, ["repo", "lang"])


def _json_or_none(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return _or_none(spark, lambda: spark.read.schema(ddl).json(path), ddl)


def groups(spark: SparkSession, path: str) -> DataFrame:
    """(name, repos); none if nothing was written."""
    return _json_or_none(spark, path, schema.GROUPS)


def summaries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(function summaries, taint findings) of all repos, read where save_summaries writes; none if nothing was written."""
    return _json_or_none(spark, f"{path}/funcs", schema.PDGS), _json_or_none(spark, f"{path}/taint", schema.TAINT)


def save_summaries(pdgs: DataFrame, taint: DataFrame, path: str) -> None:
    pdgs.write.mode("overwrite").json(f"{path}/funcs")
    taint.write.mode("overwrite").json(f"{path}/taint")


def write_page(text: str, path: str) -> str:
    """A page as a local text file; its folder is made if need be."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


# The topics that every repo gets a page on. Which questions belong to each is ours.
TOPICS = {
    "exploring": ("repos", "query", "context", "entry_points"),
    "debugging": ("trace", "process", "explain"),
    "impact-analysis": ("impact", "detect_changes", "api_impact"),
    "refactoring": ("rename", "shape_check", "check"),
    "guide": ("tool_map",),
    "cli": ("status", "index", "reindex"),
}


def write_notes(areas: DataFrame, repo: str, folder: str) -> list[str]:
    """A page per topic, of what the questions' own documentation says, and one per community of the repo (rows of digest.area_notes); returns the paths, sorted.

    Communities of one slug are told apart by a number.
    """
    from weftline.api import Engine

    def page(name: str, body: list[str]) -> str:
        return write_page("\n".join([f"# {name}", "", f"repo: {repo}", "", *body, ""]), os.path.join(folder, f"{name}.md"))

    done = [page(topic, [f"- `{m}`: {(getattr(Engine, m).__doc__ or m).strip().splitlines()[0]}" for m in methods]) for topic, methods in TOPICS.items()]
    used: dict[str, int] = {}
    for r in areas.where(F.col("repo") == repo).orderBy("slug", "community").toLocalIterator():
        used[r.slug] = k = used.get(r.slug, 0) + 1
        done.append(page(r.slug if k == 1 else f"{r.slug}-{k}", [f"Module {r['name']}, symbols: {r['size']}", "", *(f"- {m}" for m in r.members)]))
    return sorted(done)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, indexed_at) of registered repos; none if nothing was registered."""
    return _json_or_none(spark, path, schema.REGISTRY)


def register(known: DataFrame, name: str, path: str, at: datetime) -> DataFrame:
    """The registry with one repo put in or replaced. Names must not hold slashes."""
    if not name or "/" in name or "\\" in name:
        raise ValueError(f"not a repo name: {name!r}")
    return known.where(F.col("name") != name).unionByName(known.sparkSession.createDataFrame([(name, path, at)], schema.REGISTRY))


def unregister(known: DataFrame, name: str) -> DataFrame:
    return known.where(F.col("name") != name)


def select_repo(known: DataFrame, name: str = "") -> str:
    """The named repo, or the only one if the name is empty. Unknown names, no repo or several are errors."""
    got = [r.name for r in (known.where(F.col("name") == name) if name else known).select("name").limit(2).collect()]
    if len(got) != 1:
        raise KeyError(f"no such repo: {name}" if name else "no repo is registered" if not got else "several repos are registered; name one")
    return got[0]


def owner_of(known: DataFrame, file: str) -> str | None:
    """The first registered repo, by name, whose path holds the file."""
    top = F.regexp_replace("path", "/+$", "")
    got = known.where(F.startswith(F.lit(file), F.concat(top, F.lit("/")))).agg(F.min("name")).first()[0]
    return got


def listing(spark: SparkSession, folder: str, lang: str, contents: bool = False) -> DataFrame:
    """(path, size, mtime) of a language's source files below a folder; contents are read only if they are wanted, as a column of bytes. Skipped folders hold for all languages; tests of Go are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *["content"] * contents)
    rel = F.regexp_replace("path", "^[a-z]+:/*", "/")
    ok = F.lower(rel).rlike(EXTENSIONS[lang]) & ~rel.rlike("/(" + "|".join(s.replace(".", r"\.") for s in SKIP) + ")/")
    if lang == "go":
        ok &= ~rel.endswith("_test.go")
    return files.where(ok)


def fingerprint(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, fingerprint): SHA-256 over the sorted lines path, size, mtime of each group's files. files: (by, path, size, mtime)."""
    line = F.concat("path", F.lit("\0"), F.col("size").cast("string"), F.lit("\0"), F.unix_micros("mtime").cast("string"), F.lit("\n"))
    return files.groupBy(*(by or [])).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), ""), 256).alias("fingerprint"))


def stale(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """(repo, lang): what changed since the manifest of the store that was written. Both: (repo, lang, fingerprint)."""
    old = manifest.select("repo", "lang", F.col("fingerprint").alias("old"))
    return now.join(old, ["repo", "lang"], "full").where("NOT (fingerprint <=> old)").select("repo", "lang")
