"""A folder that outlives the process: registry, groups, fingerprints, graphs, summaries, vectors and pages.

The registry and the groups are small by nature, one row per repo or group; they are read whole, changed and put in the place of the old. Each write
renews a mark, whose time tells other processes that what they hold is old.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import schema
from weftline.operators import groups as group_ops
from weftline.operators.graph import Graph
from weftline.sources import store

MANIFEST = "repo string, lang string, fingerprint string"


class Home:
    """What is kept below `path`."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _put(self, name: str, df: DataFrame, ddl: str) -> DataFrame:
        """Replaces a small table: written beside the old one, then renamed."""
        rows = [tuple(r) for r in df.collect()]
        fs, to = store._fs(self.spark, self.path)
        new = self.spark.createDataFrame(rows, ddl)
        new.coalesce(1).write.mode("overwrite").json(f"{self.path}/_{name}")
        fs.delete(to(f"{self.path}/{name}"), True)
        fs.rename(to(f"{self.path}/_{name}"), to(f"{self.path}/{name}"))
        self.touch()
        return new

    def touch(self) -> None:
        fs, to = store._fs(self.spark, self.path)
        fs.create(to(f"{self.path}/_changed"), True).close()

    def changed(self) -> int:
        """When anything was last written, in milliseconds; 0 if nothing ever was."""
        fs, to = store._fs(self.spark, self.path)
        mark = to(f"{self.path}/_changed")
        return fs.getFileStatus(mark).getModificationTime() if fs.exists(mark) else 0

    def registry(self) -> DataFrame:
        return store.registry(self.spark, f"{self.path}/registry")

    def groups(self) -> DataFrame:
        return store.groups(self.spark, f"{self.path}/groups")

    def graph(self) -> Graph:
        return store.stored(self.spark, f"{self.path}/graph")

    def vectors(self) -> DataFrame:
        ddl = "repo string, id string, embedding array<float>"
        return store._or_none(self.spark, lambda: self.spark.read.schema(ddl).parquet(f"{self.path}/vectors").select("repo", "id", "embedding"), ddl)

    def sources(self) -> DataFrame:
        """(repo, file, lang, content) of the registered repos' files, read where they lie when they are asked for."""
        ddl, out = "repo string, file string, lang string, content string", None
        for r in self.registry().collect():
            for lang in store.EXTENSIONS:
                files = store.listing(self.spark, r.path, lang, contents=True)
                part = files.select(F.lit(r.name).alias("repo"), F.regexp_replace("path", "^[a-z]+:/*", "/").alias("file"), F.lit(lang).alias("lang"), F.decode("content", "UTF-8").alias("content"))
                out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], ddl) if out is None else out

    def summaries(self) -> tuple[DataFrame, DataFrame]:
        return store.summaries(self.spark, f"{self.path}/pdg")

    def manifest(self) -> DataFrame:
        """(repo, lang, fingerprint) as of the last indexing."""
        return store._json_or_none(self.spark, f"{self.path}/manifest", MANIFEST)

    def fingerprints(self, name: str, path: str) -> DataFrame:
        """(repo, lang, fingerprint) of a repo's files as they are now."""
        every = None
        for lang in store.EXTENSIONS:
            part = store.listing(self.spark, path, lang).select(F.lit(name).alias("repo"), F.lit(lang).alias("lang"), "path", "size", "mtime")
            every = part if every is None else every.unionByName(part)
        return store.fingerprint(every, ["repo", "lang"])

    def add(self, name: str, path: str, extracted: Graph, vectors: DataFrame | None = None, pdgs: DataFrame | None = None, taint: DataFrame | None = None) -> DataFrame:
        """Stores a repo's graph and what came with it in place of the old, notes its fingerprints and registers it; returns the registry."""
        known = store.register(self.registry(), name, path, datetime.now())  # a bad name stops here
        store.save(extracted, f"{self.path}/graph")
        if vectors is not None:
            store._replace(self.spark, {"vectors": vectors.select("repo", "id", "embedding")}, self.path, ["repo"])
        if pdgs is not None:
            old, found = self.summaries()
            other = F.col("repo") != name
            both = old.where(other).unionByName(pdgs.select(old.columns)), found.where(other) if taint is None else found.where(other).unionByName(taint.select(found.columns))
            rows = [[tuple(r) for r in x.collect()] for x in both]  # summaries are exchanged as documents
            store.save_summaries(self.spark.createDataFrame(rows[0], schema.PDGS), self.spark.createDataFrame(rows[1], schema.TAINT), f"{self.path}/pdg")
        self._put("manifest", self.manifest().where(F.col("repo") != name).unionByName(self.fingerprints(name, path)), MANIFEST)
        return self._put("registry", known, schema.REGISTRY)

    def remove(self, name: str) -> DataFrame:
        """Forgets a repo: its graph, fingerprints and place in the registry and in groups."""
        store.forget_repo(self.spark, f"{self.path}/graph", name)
        store.forget_repo(self.spark, self.path, name)
        self._put("manifest", self.manifest().where(F.col("repo") != name), MANIFEST)
        self._put("groups", self.groups().withColumn("repos", F.array_remove("repos", name)), schema.GROUPS)
        return self._put("registry", store.unregister(self.registry(), name), schema.REGISTRY)

    def clean(self) -> None:
        """Deletes everything kept."""
        fs, to = store._fs(self.spark, self.path)
        for name in ("registry", "groups", "manifest", "graph", "vectors", "pdg", "pages"):
            fs.delete(to(f"{self.path}/{name}"), True)
        self.touch()

    def status(self) -> DataFrame:
        """(name, path, indexed_at, lang, state): fresh or stale, per registered repo and language that it has or had when it was indexed."""
        now = self.spark.createDataFrame([], MANIFEST)
        for r in self.registry().collect():
            now = now.unionByName(self.fingerprints(r.name, r.path))
        stale = store.stale(now, self.manifest()).withColumn("state", F.lit("stale"))
        langs = now.select("repo", "lang").unionByName(self.manifest().select("repo", "lang")).distinct()
        state = langs.join(stale, ["repo", "lang"], "left").withColumnRenamed("repo", "name")
        return self.registry().join(state, "name", "left").select("name", "path", "indexed_at", "lang", F.coalesce("state", F.lit("fresh")).alias("state"))

    def group_create(self, name: str, repos: list[str]) -> DataFrame:
        return self._put("groups", group_ops.upsert_group(self.groups(), name, repos, self.registry(), create=True), schema.GROUPS)

    def group_add(self, name: str, repos: list[str]) -> DataFrame:
        return self._put("groups", group_ops.upsert_group(self.groups(), name, repos, self.registry()), schema.GROUPS)

    def group_remove(self, name: str, repos: list[str]) -> DataFrame:
        return self._put("groups", group_ops.remove_from_group(self.groups(), name, repos), schema.GROUPS)
