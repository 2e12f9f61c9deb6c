"""One object with a method per question: the engine's surface for programs, agents and the command line."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import schema
from weftline.operators import changes, community, digest, flow, frontend, groups, lookup, rename, search, shape, taint, traverse
from weftline.operators.graph import Graph
from weftline.sources import store
from weftline.sources.home import Home


@dataclass
class Guards:
    """read_only forbids what writes; repos, if given, are the only ones answered for; budget in tokens cuts search results to budget / 20, one at least."""

    read_only: bool = False
    repos: tuple[str, ...] = ()
    budget: int = 0

    def allow(self, repo: str) -> None:
        if self.repos and repo not in self.repos:
            raise PermissionError(f"repo {repo} is not allowed")

    def write(self) -> None:
        if self.read_only:
            raise PermissionError("this engine is read-only")

    def cap(self, limit: int) -> int:
        limit = limit if limit > 0 else 20
        return min(limit, max(1, self.budget // 20)) if self.budget > 0 else limit


class Engine:
    """Answers over a graph of one or many repos. Every method that names a repo checks the guards and returns a lazy DataFrame."""

    def __init__(self, spark: SparkSession, graph: Graph, registry: DataFrame | None = None, group_list: DataFrame | None = None, vectors: DataFrame | None = None, sources: DataFrame | None = None, pdgs: DataFrame | None = None, taint_found: DataFrame | None = None, guards: Guards | None = None, home: Home | None = None) -> None:
        none = lambda ddl: spark.createDataFrame([], ddl)
        self.spark, self.graph, self.vectors, self.home = spark, graph, vectors, home
        self.source_files = sources if sources is not None else none("repo string, file string, lang string, content string")
        self.pdgs, self.taint_found = pdgs if pdgs is not None else none(schema.PDGS), taint_found if taint_found is not None else none(schema.TAINT)
        self.registry = registry if registry is not None else graph.nodes.select(F.col("repo").alias("name")).distinct().select("name", F.concat(F.lit(lookup.ROOTS), "name").alias("path"), F.lit(None).cast("timestamp").alias("indexed_at"))
        self._groups = group_list if group_list is not None else none(schema.GROUPS)
        self.guards = guards or Guards()
        self._seen = home.changed() if home else 0
        self._indexes: dict[str, search.Index] = {}

    @classmethod
    def open(cls, spark: SparkSession, path: str, guards: Guards | None = None) -> Engine:
        """An engine over what is kept in a folder; it notices when another process writes there."""
        home = Home(spark, path)
        pdgs, taint_found = home.summaries()
        return cls(spark, home.graph(), home.registry(), home.groups(), home.vectors(), home.sources(), pdgs, taint_found, guards, home)

    def reload(self) -> None:
        """Reads again what is kept, if it was written since it was read."""
        if self.home and self.home.changed() != self._seen:
            self.spark.catalog.clearCache()
            self.__dict__.update(type(self).open(self.spark, self.home.path, self.guards).__dict__)

    # repos

    def _of(self, repo: str) -> tuple[str, Graph]:
        self.reload()
        if repo:
            self.guards.allow(repo)
        if self.home is not None or not repo:
            repo = store.select_repo(self.registry, repo)
            self.guards.allow(repo)
        return repo, self.graph.of(repo)

    def _seed(self, repo: str, *ids: str) -> DataFrame:
        return self.spark.createDataFrame([(repo, i, i) for i in ids], "repo string, root string, id string")

    def repos(self) -> DataFrame:
        """Registered repos with their number of symbols."""
        known = self.registry if not self.guards.repos else self.registry.where(F.col("name").isin(*self.guards.repos))
        return lookup.repo_counts(known, self.graph)

    def status(self) -> DataFrame:
        """Which registered repos have changed since they were indexed, by language."""
        return self._home().status()

    def _home(self) -> Home:
        if self.home is None:
            raise ValueError("this engine keeps nothing: open it on a folder")
        return self.home

    def index(self, name: str, path: str, extracted: Graph, out: str | None = None, client: Callable[[list[str]], list[list[float]]] | None = None, embed_most: int = 0, pdgs: DataFrame | None = None, taint_found: DataFrame | None = None) -> DataFrame:
        """Stores what a front end extracted and registers the repo; returns the new registry.

        client: embeds the symbols' texts, of the `embed_most` most used symbols if that is positive. Without a home only the graph is stored, at `out`.
        """
        self.guards.write()
        self.guards.allow(name)
        vectors = None
        if client is not None:
            own = extracted.nodes if embed_most <= 0 else extracted.nodes.join(search.most_used(extracted, embed_most).select("repo", "id"), ["repo", "id"], "left_semi")
            vectors = search.embed(own, client)
        if self.home is not None:
            self.home.add(name, path, extracted, vectors, pdgs, taint_found)
            self.reload()
            return self.registry
        store.save(extracted, out)
        self.registry = store.register(self.registry, name, path, datetime.now())
        return self.registry

    def index_sources(self, name: str, path: str) -> DataFrame:
        """Indexes a folder of sources with the syntactic front end."""
        home = self._home()
        files = None
        for lang in store.EXTENSIONS:
            part = store.listing(self.spark, path, lang, contents=True).select(F.lit(name).alias("repo"), F.regexp_replace("path", "^[a-z]+:/*", "/").alias("file"), F.lit(lang).alias("lang"), F.decode("content", "UTF-8").alias("content"))
            files = part if files is None else files.unionByName(part)
        return self.index(name, path, frontend.graph_of(files), home.path)

    def reindex(self, name: str) -> bool:
        """Indexes a registered repo again if its files have changed; tells whether they had."""
        self.guards.write()
        self.guards.allow(name)
        name = store.select_repo(self.registry, name)
        path = self.registry.where(F.col("name") == name).first().path
        if self._home().status().where((F.col("name") == name) & (F.col("state") == "stale")).isEmpty():
            return False
        self.index_sources(name, path)
        return True

    def remove(self, name: str) -> DataFrame:
        """Forgets a repo; returns the registry without it."""
        self.guards.write()
        if self.home is not None:
            self.home.remove(name)
            self.reload()
            return self.registry
        self.registry = store.unregister(self.registry, name)
        return self.registry

    def clean(self) -> None:
        """Forgets all repos and groups."""
        self.guards.write()
        self._home().clean()
        self.reload()

    # symbols

    def query(self, text: str, repo: str = "", limit: int = 20, vector: list[float] | None = None) -> DataFrame:
        """Search hits with the process each takes part in."""
        repo, g = self._of(repo)
        vectors = None if self.vectors is None else self.vectors.where(F.col("repo") == repo)
        if repo not in self._indexes:
            self._indexes[repo] = search.build_index(g.nodes, search.node_text())
        hits = search.search(g, text, self.guards.cap(limit), vector, vectors, index=self._indexes[repo])
        return hits.join(g.nodes, ["repo", "id"]).join(flow.process_of(g), ["repo", "id"]).orderBy("rank")

    def ask(self, text: str, repo: str = "") -> DataFrame:
        """Without a language model the answer to a question is the eight best hits."""
        return self.query(text, repo, 8)

    def context(self, id: str, repo: str = "") -> DataFrame:
        """All edges into and out of a symbol."""
        repo, g = self._of(repo)
        return lookup.context(g, self._seed(repo, id))

    def impact(self, id: str, repo: str = "") -> DataFrame:
        """Who depends on a symbol, directly or not, by depth."""
        repo, g = self._of(repo)
        return traverse.impact(g.calls(), self._seed(repo, id)).select("id", "depth", "confidence").orderBy("depth", "id")

    def dependencies(self, id: str, repo: str = "") -> DataFrame:
        """What a symbol calls, directly or not."""
        repo, g = self._of(repo)
        return traverse.dependencies(g.calls(), self._seed(repo, id)).select("id", "depth").orderBy("id")

    def trace(self, src: str, dst: str, repo: str = "") -> DataFrame:
        """A shortest call path from one symbol to another."""
        repo, g = self._of(repo)
        return traverse.trace(g.edges, self.spark.createDataFrame([(repo, src, dst)], "repo string, src string, dst string")).select("step", "id").orderBy("step")

    def subgraph(self, id: str, depth: int = 1, repo: str = "") -> tuple[DataFrame, DataFrame]:
        """What lies within a few steps of a symbol, and the edges there."""
        repo, g = self._of(repo)
        return traverse.neighbourhood(g.nodes, g.edges, self._seed(repo, id), depth if depth > 0 else 1)

    def whole(self, repo: str = "", limit: int = 0) -> tuple[DataFrame, DataFrame, bool]:
        """Nodes, edges, and whether a positive limit cut them."""
        _, g = self._of(repo)
        nodes, edges = lookup.top_graph(g, limit)
        return nodes, edges, limit > 0 and g.nodes.limit(limit + 1).count() > limit

    def source(self, id: str, repo: str = "", before: int = 3, after: int = 120) -> DataFrame:
        """The lines around a symbol."""
        repo, g = self._of(repo)
        roots = self.registry.select(F.col("name").alias("repo"), F.col("path").alias("root"))
        return lookup.source_slices(g, self.source_files, self._seed(repo, id), before, after, roots)

    def entry_points(self, repo: str = "") -> DataFrame:
        """Functions that nothing calls, by the size of their flow."""
        return flow.flow_sizes(self._of(repo)[1]).orderBy(F.desc("size"), "id")

    def process(self, id: str, repo: str = "") -> tuple[DataFrame, DataFrame]:
        """What runs below a symbol, and the calls among it."""
        repo, g = self._of(repo)
        nodes = flow.flow_nodes(g, self._seed(repo, id))
        return nodes, flow.flow_edges(g, nodes)

    def clusters(self, repo: str = "") -> tuple[DataFrame, DataFrame]:
        """Members and report of a repo's communities, the largest first."""
        members, report = community.communities(self._of(repo)[1])
        return members.orderBy("community", "id"), report.orderBy(F.desc("size"), "community")

    def check(self, ids: list[str], repo: str = "") -> tuple[DataFrame, DataFrame]:
        """Ids the graph hasn't, in the order asked, and dangling edges."""
        repo, g = self._of(repo)
        asked = self.spark.createDataFrame([(repo, i, x) for i, x in enumerate(ids)], "repo string, pos int, id string")
        return lookup.missing_ids(g, asked).orderBy("pos"), lookup.dangling(g)

    def pattern(self, text: str, repo: str = "", limit: int = 100) -> DataFrame:
        """Edges that fit (a:kind)-[:KIND]->(b:kind)."""
        return lookup.pattern(self._of(repo)[1], text, limit)

    def route_map(self, repo: str = "") -> DataFrame:
        """All routes."""
        return self._of(repo)[1].routes

    def api_impact(self, path: str | None = None, repo: str = "") -> DataFrame:
        """Who calls the handlers of routes, directly or not."""
        return flow.api_impact(self._of(repo)[1], path)

    def shape_check(self, repo: str = "") -> DataFrame:
        """Properties that consumers read and types do not have."""
        g = self._of(repo)[1]
        shapes = g.shapes if g.shapes is not None else frontend.shapes_of(self.source_files.where(F.col("repo") == self._of(repo)[0]))
        return shape.shape_check(g.nodes, shapes).orderBy("object", "file")

    # changes

    def detect_changes(self, diff: DataFrame, repo: str = "") -> tuple[DataFrame, DataFrame]:
        """Changed and impacted symbols of a diff's numbered lines (ord, line)."""
        repo, g = self._of(repo)
        changed = changes.changed_symbols(g, changes.parse_diff(diff).withColumn("repo", F.lit(repo)))
        return changed, changes.impacted(g, changed)

    def rename(self, id: str, new: str, repo: str = "", root: str | None = None) -> DataFrame:
        """The plan; with a root it is applied to the files below it."""
        repo, g = self._of(repo)
        plan = rename.plan(g, self.source_files, repo, id, new)
        if root is not None:
            self.guards.write()
            rename.apply(plan, root)
        return plan

    # dependence

    def explain(self, func: str = "", repo: str = "") -> DataFrame:
        """Taint findings of a function, or all."""
        repo, _ = self._of(repo)
        return taint.taint_of(self.taint_found.where(F.col("repo") == repo), func)

    def pdg_query(self, id: str, repo: str = "") -> DataFrame:
        """The stored summary of a function."""
        repo, _ = self._of(repo)
        return taint.pdg_of(self.pdgs, self._seed(repo, id))

    # groups and pages

    def _group(self, name: str) -> Graph:
        found = self._groups.where(F.col("name") == name).select("repos").first()
        if found is None:
            raise KeyError(f"no such group: {name}")
        for r in found.repos:
            self.guards.allow(r)
        return self.graph.of(*found.repos)

    def groups(self) -> DataFrame:
        """All groups with their repos."""
        self.reload()
        return self._groups.orderBy("name")

    def group_list(self) -> DataFrame:
        """The same, by the name that agents call it."""
        return self.groups()

    def group_create(self, name: str, *repos: str) -> DataFrame:
        """Makes a group of registered repos."""
        return self._grouped("group_create", name, repos)

    def group_add(self, name: str, *repos: str) -> DataFrame:
        """Adds registered repos to a group."""
        return self._grouped("group_add", name, repos)

    def group_remove(self, name: str, *repos: str) -> DataFrame:
        """Takes repos out of a group."""
        return self._grouped("group_remove", name, repos)

    def _grouped(self, how: str, name: str, repos: tuple[str, ...]) -> DataFrame:
        self.guards.write()
        for r in repos:
            self.guards.allow(r)
        getattr(self._home(), how)(name, list(repos))
        self.reload()
        return self.groups()

    def group_sync(self, name: str) -> tuple[DataFrame, DataFrame]:
        """Contracts and the keys that repos share."""
        c = groups.contracts(self._group(name))
        return c, groups.links(c)

    def cross_impact(self, group: str, repo: str, id: str) -> DataFrame:
        """The other repos of a group that share a contract of a symbol's name."""
        g = self._group(group)
        if g.nodes.where((F.col("repo") == repo) & (F.col("id") == id)).isEmpty():
            raise KeyError(f"{repo}: no symbol {id!r}")
        return groups.cross_impact(g, self._seed(repo, id))

    def group_graph(self, name: str, limit: int = 0) -> tuple[DataFrame, DataFrame]:
        """The graph of all repos of a group, with the contracts between them."""
        return groups.group_graph(self._group(name), limit)

    def wiki(self, repo: str = "", folder: str | None = None) -> str:
        """The page of a repo; with a folder it is also written there."""
        repo, _ = self._of(repo)
        page = digest.markdown(digest.build(self.graph, repo))
        if folder is not None:
            self.guards.write()
            store.write_page(page, f"{folder}/{repo}.md")
        return page

    def skills(self, folder: str, repo: str = "") -> list[str]:
        """Writes a page per topic and per community of a repo; returns the paths."""
        repo, g = self._of(repo)
        self.guards.write()
        return store.write_notes(digest.area_notes(g), repo, folder)

    def enrich(self, file: str) -> DataFrame:
        """Callers of the symbols of a file, in the first registered repo that holds it."""
        repo = store.owner_of(self.registry, file)
        if repo is None:
            raise KeyError(f"no registered repo holds {file}")
        repo, g = self._of(repo)
        return flow.caller_counts(g, self.spark.createDataFrame([(repo, file)], "repo string, file string"))

    def tool_map(self) -> DataFrame:
        """(name, doc) of every public method: the catalog is read off this class, so it can't miss one."""
        rows = sorted((n, (getattr(type(self), n).__doc__ or "").strip().split("\n")[0]) for n in dir(type(self)) if not n.startswith("_") and callable(getattr(type(self), n)))
        return self.spark.createDataFrame(rows, "name string, doc string")
