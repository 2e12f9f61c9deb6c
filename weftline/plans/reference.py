"""Queries of the graph, search and set operators over the tables, and SQL that says the same.

Seeds are chosen inside the queries by rules over the whole tables (the target most called in each repo, say), so they follow the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import cache_key, slug
from weftline.operators import changes, community, digest, extract, flow, frontend, groups, lookup, rename, search, shape, taint, traverse
from weftline.operators.graph import Graph, kept, load
from weftline.sources.store import fingerprint, stale
from weftline.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NODES = """n AS (SELECT repo, id, coalesce(kind, '') AS kind, coalesce(name, '') AS name, coalesce(package, '') AS package, coalesce(file, '') AS file, coalesce(line, 0) AS line,
  coalesce(signature, '') AS signature, coalesce(doc, '') AS doc, coalesce(fields, []) AS fields FROM nodes WHERE removed_at IS NULL AND id <> ''
  QUALIFY row_number() OVER (PARTITION BY repo, id ORDER BY indexed_at DESC, coalesce(line, 0) DESC, coalesce(signature, '') DESC, coalesce(doc, '') DESC, coalesce(name, '') DESC) = 1)"""
EDGES = "e AS (SELECT DISTINCT repo, ord, src, dst, lower(trim(kind, ' ' || chr(9))) AS kind FROM edges WHERE src <> '' AND dst <> '' AND src <> dst)"
ROUTES = "r AS (SELECT DISTINCT repo, ord, upper(trim(coalesce(method, ''))) AS method, coalesce(path, '') AS path, coalesce(handler, '') AS handler FROM routes)"
CALLS = "c AS (SELECT DISTINCT repo, src, dst FROM e WHERE kind = 'calls')"
SEED = """s AS (SELECT c.repo, c.dst AS id FROM c JOIN n ON n.repo = c.repo AND n.id = c.dst GROUP BY c.repo, c.dst QUALIFY row_number() OVER (PARTITION BY c.repo ORDER BY count(DISTINCT c.src) DESC, c.dst) = 1)"""
ENTRIES = "ep AS (SELECT n.repo, n.id, n.name FROM n WHERE n.kind IN ('func', 'method') AND EXISTS (SELECT 1 FROM c WHERE c.repo = n.repo AND c.src = n.id) AND NOT EXISTS (SELECT 1 FROM c WHERE c.repo = n.repo AND c.dst = n.id))"
G = f"WITH RECURSIVE {NODES}, {EDGES}, {ROUTES}, {CALLS}"


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Graph, SparkSession, str], DataFrame]], Query]:
    def put(f: Callable[[Graph, SparkSession, str], DataFrame]) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(load(spark, d), spark, d)

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return put


def most_called(g: Graph) -> DataFrame:
    """(repo, id): the symbol of each repo with most different callers; ties by id."""
    n = g.calls().groupBy("repo", F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n")).join(g.nodes.select("repo", "id"), ["repo", "id"], "left_semi")
    return n.groupBy("repo").agg(F.min(F.struct(-F.col("n"), F.col("id"))).alias("m")).select("repo", F.col("m.id").alias("id"))


def rooted(seeds: DataFrame) -> DataFrame:
    return seeds.select("repo", F.col("id").alias("root"), "id")


# --- the graph itself, counts and lookups

query("graph_nodes", f"{G} SELECT repo, id, kind, name, package, file, line, signature, doc, array_to_string(fields, ',') AS fields FROM n")(lambda g, s, d: g.nodes.withColumn("fields", F.array_join("fields", ",")))
query("graph_edges", f"{G} SELECT * FROM e")(lambda g, s, d: g.edges)
query("route_map", f"{G} SELECT * FROM r")(lambda g, s, d: g.routes)
query(
    "kind_counts",
    f"""{G} SELECT repo, count(*) FILTER (WHERE kind = 'package') AS packages, count(*) FILTER (WHERE kind IN ('func', 'method')) AS funcs,
    count(*) FILTER (WHERE kind IN ('type', 'interface', 'class')) AS types, count(*) AS total FROM n GROUP BY repo""",
)(lambda g, s, d: lookup.kind_counts(g))
query("in_degree", f"{G} SELECT repo, dst AS id, count(*) AS in_degree FROM e GROUP BY ALL")(lambda g, s, d: lookup.in_degree(g.edges))
query("degree", f"{G} SELECT repo, id, count(*) AS degree FROM (SELECT repo, src AS id FROM e UNION ALL SELECT repo, dst FROM e) GROUP BY ALL")(lambda g, s, d: lookup.degree(g.edges))
query(
    "context",
    f"""{G}, {SEED} SELECT e.repo, dst AS id, 'in' AS direction, ord, src AS other, kind FROM e JOIN s ON s.repo = e.repo AND s.id = e.dst
    UNION ALL SELECT e.repo, src, 'out', ord, dst, kind FROM e JOIN s ON s.repo = e.repo AND s.id = e.src""",
)(lambda g, s, d: lookup.context(g, most_called(g)))
query("check_missing", f"{G} SELECT repo, ord AS pos, handler AS id FROM r WHERE handler <> '' AND NOT EXISTS (SELECT 1 FROM n WHERE n.repo = r.repo AND n.id = r.handler)")(
    lambda g, s, d: lookup.missing_ids(g, g.routes.where("handler <> ''").select("repo", F.col("ord").alias("pos"), F.col("handler").alias("id"))).select("repo", "pos", "id")
)
query(
    "check_dangling",
    f"""{G} SELECT repo, ord, src, dst, kind FROM e WHERE kind NOT IN ('imports', 'constructs')
    AND (NOT EXISTS (SELECT 1 FROM n WHERE n.repo = e.repo AND n.id = e.src) OR NOT EXISTS (SELECT 1 FROM n WHERE n.repo = e.repo AND n.id = e.dst))""",
)(lambda g, s, d: lookup.dangling(g))
query(
    "pattern_func_calls_method",
    f"""{G} SELECT e.repo, ord, src, dst, e.kind FROM e JOIN n a ON a.repo = e.repo AND a.id = e.src AND a.kind = 'func' JOIN n b ON b.repo = e.repo AND b.id = e.dst AND b.kind = 'method'
    WHERE e.kind = 'calls' ORDER BY ord, e.repo LIMIT 100""",
)(lambda g, s, d: lookup.pattern(g, "(a:func)-[:CALLS]->(b:method)"))
query("pattern_any_kind", f"{G} SELECT e.repo, ord, src, dst, e.kind FROM e JOIN n b ON b.repo = e.repo AND b.id = e.dst AND b.kind = 'interface'")(lambda g, s, d: lookup.pattern(g, "(a)-[e]->(b:interface)", limit=None))
query("hot_symbols", f"{G} SELECT n.repo, n.id, n.name, count(*) AS callers FROM e JOIN n ON n.repo = e.repo AND n.id = e.dst WHERE e.kind = 'calls' AND n.kind IN ('func', 'method') GROUP BY ALL")(lambda g, s, d: lookup.hot_symbols(g))
query(
    "hot_top",
    f"{G} SELECT n.repo, n.id, n.name, count(*) AS callers FROM e JOIN n ON n.repo = e.repo AND n.id = e.dst WHERE e.kind = 'calls' AND n.kind IN ('func', 'method') GROUP BY ALL ORDER BY callers DESC, n.name, n.repo, n.id LIMIT 10",
)(lambda g, s, d: lookup.hot_symbols(g, 10))
query(
    "implementors",
    f"""{G} SELECT i.repo, i.id, i.name, string_agg(b.name, ',' ORDER BY b.name) AS implementors FROM n i JOIN e ON e.repo = i.repo AND e.dst = i.id AND e.kind = 'implements'
    JOIN n b ON b.repo = e.repo AND b.id = e.src WHERE i.kind = 'interface' GROUP BY ALL""",
)(lambda g, s, d: lookup.implementors(g).withColumn("implementors", F.array_join("implementors", ",")))
KNOWN = ", ".join(f"('{k}', '{v}')" for k, v in lookup.FRAMEWORKS.items())
query("frameworks", f"{G}, k(part, framework) AS (VALUES {KNOWN}) SELECT DISTINCT repo, framework FROM e JOIN k ON contains(e.dst, k.part) WHERE e.kind = 'imports'")(lambda g, s, d: lookup.frameworks(g))
query(
    "implementors_all",
    f"""{G} SELECT i.repo, i.id, i.name, string_agg(b.name, ',' ORDER BY b.name) AS implementors FROM n i JOIN e ON e.repo = i.repo AND e.dst = i.id AND e.kind = 'implements'
    JOIN n b ON b.repo = e.repo AND b.id = e.src WHERE i.kind IN ('interface', 'type', 'class') GROUP BY ALL""",
)(lambda g, s, d: lookup.implementors(g, ("interface", "type", "class")).withColumn("implementors", F.array_join("implementors", ",")))
query("import_labels", f"{G}, k(part, framework) AS (VALUES ('std/', 'standard library'), ('ext/', 'external'), ('table', 'tables')) SELECT DISTINCT repo, framework FROM e JOIN k ON contains(e.dst, k.part) WHERE e.kind = 'imports'")(
    lambda g, s, d: lookup.frameworks(g, {"std/": "standard library", "ext/": "external", "table": "tables"})
)
query(
    "graph_top_n",
    f"""{G}, deg AS (SELECT n.repo, n.id, count(x.id) AS degree FROM n LEFT JOIN (SELECT repo, src AS id FROM e UNION ALL SELECT repo, dst FROM e) x ON x.repo = n.repo AND x.id = n.id GROUP BY n.repo, n.id),
    t AS (SELECT repo, id FROM deg ORDER BY degree DESC, repo, id LIMIT 200)
    SELECT e.* FROM e WHERE EXISTS (SELECT 1 FROM t WHERE t.repo = e.repo AND t.id = e.src) AND EXISTS (SELECT 1 FROM t WHERE t.repo = e.repo AND t.id = e.dst)""",
)(lambda g, s, d: lookup.top_graph(g, 200)[1].select("repo", "ord", "src", "dst", "kind"))
query("repo_counts", f"{G} SELECT x.repo AS name, '/srv/index/' || x.repo AS path, count(n.id) AS nodes FROM (SELECT DISTINCT repo FROM edges WHERE repo IS NOT NULL) x LEFT JOIN n ON n.repo = x.repo GROUP BY x.repo")(
    lambda g, s, d: lookup.repo_counts(table(s, d, "edges").where("repo IS NOT NULL").select(F.col("repo").alias("name")).distinct().withColumn("path", F.concat(F.lit("/srv/index/"), "name")), g)
)
query(
    "languages",
    f"""{G} SELECT CASE lower(regexp_extract(file, '(\\.[^./]*)$', 1)) WHEN '.go' THEN 'go' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.js' THEN 'javascript' WHEN '.vue' THEN 'vue' ELSE '' END AS lang, count(*) AS files
    FROM (SELECT DISTINCT file FROM n WHERE file <> '') GROUP BY lang""",
)(lambda g, s, d: g.nodes.where("file <> ''").select("file").distinct().groupBy(lookup.language().alias("lang")).agg(F.count(F.lit(1)).alias("files")))
query(
    "source_slices",
    f"""{G}, f AS (SELECT file, min(content) AS content FROM sources WHERE content IS NOT NULL GROUP BY file),
    x AS (SELECT n.repo, n.id, n.file, greatest(CASE WHEN line = 0 THEN 1 ELSE line - 3 END, 1) AS start_line, CASE WHEN line = 0 THEN 20 ELSE line + 20 END AS stop, string_split(content, chr(10)) AS ls FROM n JOIN f ON f.file = n.file WHERE starts_with(n.file, '/srv/index/' || n.repo || '/'))
    SELECT repo, id, file, CAST(start_line AS BIGINT) AS start_line, coalesce(array_to_string(ls[start_line:least(stop, len(ls))], chr(10)), '') AS code FROM x""",
)(lambda g, s, d: lookup.source_slices(g, table(s, d, "sources"), g.nodes, 3, 20).select("repo", "id", "file", F.col("start_line").cast("bigint").alias("start_line"), "code"))
query(
    "explorer_tree",
    f"""{G}, f AS (SELECT repo, name, string_split(file, '/') AS parts, file FROM n WHERE file <> ''), b AS (SELECT repo, string_split(min(file), '/') AS lo, string_split(max(file), '/') AS hi FROM f GROUP BY repo),
    k AS (SELECT repo, coalesce(list_max(list_filter(range(1, least(len(lo), len(hi))), lambda i: lo[1:i] = hi[1:i])), 0) AS skip FROM b), x AS (SELECT f.repo, f.name, parts[skip + 1:] AS rest FROM f JOIN k ON k.repo = f.repo)
    SELECT repo, array_to_string(rest[1:len(rest) - 1], '/') AS dir, rest[len(rest)] AS file, string_agg(name, ',' ORDER BY name) AS symbols FROM x GROUP BY ALL""",
)(lambda g, s, d: lookup.explorer_tree(g).withColumn("symbols", F.array_join("symbols", ",")))

# --- traversal

UP = f"{G}, {SEED}, up AS (SELECT repo, id AS root, id, 0 AS depth FROM s UNION SELECT up.repo, root, c.src, depth + 1 FROM up JOIN c ON c.repo = up.repo AND c.dst = up.id WHERE depth < 40), b AS (SELECT repo, root, id, CAST(min(depth) AS BIGINT) AS depth FROM up GROUP BY ALL)"
query("impact_graded", f"{UP} SELECT repo, root, id, depth, round(1.0 / depth, 6) AS confidence FROM b WHERE depth > 0")(lambda g, s, d: traverse.impact(g.calls(), rooted(most_called(g))).withColumn("confidence", F.round("confidence", 6)))
query("impact", f"{UP} SELECT repo, root, id FROM b WHERE depth > 0")(lambda g, s, d: traverse.impact(g.calls(), rooted(most_called(g))).select("repo", "root", "id"))
FIRST = "f AS (SELECT repo, min(id) AS id FROM ep GROUP BY repo)"
DOWN = f"{G}, {ENTRIES}, dn AS (SELECT repo, id AS root, id FROM ep UNION SELECT dn.repo, root, c.dst FROM dn JOIN c ON c.repo = dn.repo AND c.src = dn.id)"


def first_entry(g: Graph) -> DataFrame:
    return flow.entry_points(g).groupBy("repo").agg(F.min("id").alias("id"))


query(
    "dependencies",
    f"{G}, {ENTRIES}, {FIRST}, dn AS (SELECT repo, id AS root, id, 0 AS depth FROM f UNION SELECT dn.repo, root, c.dst, depth + 1 FROM dn JOIN c ON c.repo = dn.repo AND c.src = dn.id WHERE depth < 40) SELECT repo, root, id, CAST(min(depth) AS BIGINT) AS depth FROM dn GROUP BY ALL HAVING min(depth) > 0",
)(lambda g, s, d: traverse.dependencies(g.calls(), rooted(first_entry(g))))
query("entry_points", f"{G}, {ENTRIES} SELECT * FROM ep")(lambda g, s, d: flow.entry_points(g).select("repo", "id", "name"))
query("entry_sizes", f"{DOWN} SELECT ep.repo, ep.id, ep.name, count(*) AS size FROM dn JOIN ep ON ep.repo = dn.repo AND ep.id = dn.root JOIN n ON n.repo = dn.repo AND n.id = dn.id GROUP BY ALL")(lambda g, s, d: flow.flow_sizes(kept(g)))
query("process_nodes", f"{DOWN}, {FIRST} SELECT dn.repo, dn.root, dn.id FROM dn JOIN f ON f.repo = dn.repo AND f.id = dn.root JOIN n ON n.repo = dn.repo AND n.id = dn.id")(lambda g, s, d: flow.flow_nodes(g, first_entry(g)))
query(
    "process_edges",
    f"""{DOWN}, {FIRST}, p AS (SELECT dn.repo, dn.root, dn.id FROM dn JOIN f ON f.repo = dn.repo AND f.id = dn.root JOIN n ON n.repo = dn.repo AND n.id = dn.id)
    SELECT c.repo, a.root, c.src, c.dst FROM c JOIN p a ON a.repo = c.repo AND a.id = c.src JOIN p b ON b.repo = c.repo AND b.id = c.dst AND b.root = a.root""",
)(lambda g, s, d: flow.flow_edges(g, flow.flow_nodes(g, first_entry(g))))
query("process_of", f"{DOWN}, m AS (SELECT dn.repo, dn.id, min(root) AS root FROM dn GROUP BY ALL) SELECT n.repo, n.id, coalesce(ep.name, '') AS process FROM n LEFT JOIN m ON m.repo = n.repo AND m.id = n.id LEFT JOIN ep ON ep.repo = m.repo AND ep.id = m.root")(
    lambda g, s, d: flow.process_of(kept(g))
)
query("processes_of", f"{UP}, {ENTRIES} SELECT b.repo, b.root, ep.id, ep.name FROM b JOIN ep ON ep.repo = b.repo AND ep.id = b.id")(lambda g, s, d: flow.processes_of(g, most_called(g)))
query(
    "batch_impact",
    f"""{G}, up AS (SELECT DISTINCT repo, handler AS id FROM r WHERE handler <> '' UNION SELECT up.repo, c.src FROM up JOIN c ON c.repo = up.repo AND c.dst = up.id)
    SELECT repo, id FROM up WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.repo = up.repo AND r.handler = up.id)""",
)(lambda g, s, d: changes.impacted(g, g.routes.where("handler <> ''").select("repo", F.col("handler").alias("id")).distinct()))
query(
    "api_impact",
    f"""{G}, up AS (SELECT DISTINCT repo, handler AS root, handler AS id, 0 AS depth FROM r WHERE handler <> '' UNION SELECT up.repo, root, c.src, depth + 1 FROM up JOIN c ON c.repo = up.repo AND c.dst = up.id WHERE depth < 40),
    b AS (SELECT repo, root, id, CAST(min(depth) AS BIGINT) AS depth FROM up GROUP BY ALL)
    SELECT r.repo, r.ord, r.method, r.path, coalesce(b.id, '') AS id, coalesce(b.depth, 0) AS depth FROM r LEFT JOIN b ON b.repo = r.repo AND b.root = r.handler AND b.depth > 0""",
)(lambda g, s, d: flow.api_impact(g).withColumns({"id": F.coalesce("id", F.lit("")), "depth": F.coalesce("depth", F.lit(0))}))
query(
    "file_enrich",
    f"""{G}, {SEED}, fl AS (SELECT n.repo, n.file FROM n JOIN s ON s.repo = n.repo AND s.id = n.id), o AS (SELECT n.repo, n.file, n.id FROM n JOIN fl ON fl.repo = n.repo AND fl.file = n.file WHERE n.file <> ''),
    up AS (SELECT repo, id AS root, id FROM o UNION SELECT up.repo, root, c.src FROM up JOIN c ON c.repo = up.repo AND c.dst = up.id)
    SELECT o.repo, o.file, o.id, count(*) AS callers FROM o JOIN up ON up.repo = o.repo AND up.root = o.id AND up.id <> o.id GROUP BY ALL""",
)(lambda g, s, d: flow.caller_counts(g, g.nodes.join(most_called(g), ["repo", "id"], "left_semi")))


def trace_pairs(g: Graph) -> DataFrame:
    return first_entry(g).withColumnRenamed("id", "src").join(most_called(g).withColumnRenamed("id", "dst"), "repo")


query(
    "trace",
    f"""{G}, {SEED}, {ENTRIES}, {FIRST}, o AS (SELECT repo, src, dst, min(ord) AS ord FROM e WHERE kind = 'calls' GROUP BY ALL),
    bfs AS (SELECT f.repo, f.id AS src, s.id AS dst, f.id, 0 AS depth FROM f JOIN s ON s.repo = f.repo UNION SELECT bfs.repo, bfs.src, bfs.dst, c.dst, depth + 1 FROM bfs JOIN c ON c.repo = bfs.repo AND c.src = bfs.id WHERE depth < 40),
    lv AS (SELECT repo, src, dst, id, min(depth) AS depth FROM bfs GROUP BY ALL),
    w AS (SELECT repo, src, dst, src AS id, [src] AS path, CAST([] AS BIGINT[]) AS ords, 0 AS depth FROM lv WHERE depth = 0
      UNION ALL SELECT w.repo, w.src, w.dst, o.dst, list_append(path, o.dst), list_append(ords, o.ord), w.depth + 1 FROM w JOIN o ON o.repo = w.repo AND o.src = w.id JOIN lv ON lv.repo = w.repo AND lv.src = w.src AND lv.id = o.dst AND lv.depth = w.depth + 1),
    z AS (SELECT repo, src, dst, path FROM w WHERE id = dst QUALIFY row_number() OVER (PARTITION BY repo, src, dst ORDER BY ords) = 1)
    SELECT repo, src, dst, CAST(unnest(generate_series(0, len(path) - 1)) AS BIGINT) AS step, unnest(path) AS id FROM z""",
)(lambda g, s, d: traverse.trace(g.edges, trace_pairs(g)).withColumn("step", F.col("step").cast("bigint")))
NEAR = f"""{G}, {SEED}, nb AS (SELECT repo, id AS root, id, 0 AS depth FROM s UNION SELECT nb.repo, root, CASE WHEN e.src = nb.id THEN e.dst ELSE e.src END, depth + 1 FROM nb JOIN e ON e.repo = nb.repo AND (e.src = nb.id OR e.dst = nb.id) WHERE depth < %d),
    b AS (SELECT repo, root, id, CAST(min(depth) AS BIGINT) AS depth FROM nb GROUP BY ALL)"""
query("subgraph_d1", f"{NEAR % 1} SELECT b.* FROM b JOIN n ON n.repo = b.repo AND n.id = b.id")(lambda g, s, d: traverse.neighbourhood(g.nodes, g.edges, rooted(most_called(g)), 1)[0])
query("subgraph_d2", f"{NEAR % 2} SELECT b.* FROM b JOIN n ON n.repo = b.repo AND n.id = b.id")(lambda g, s, d: traverse.neighbourhood(g.nodes, g.edges, rooted(most_called(g)), 2)[0])
query("subgraph_edges", f"{NEAR % 1} SELECT DISTINCT e.repo, b.root, e.src, e.dst, e.kind FROM e JOIN b ON b.repo = e.repo AND b.depth < 1 AND (b.id = e.src OR b.id = e.dst)")(
    lambda g, s, d: traverse.neighbourhood(g.nodes, g.edges, rooted(most_called(g)), 1)[1]
)

# --- communities

query("communities")(lambda g, s, d: community.communities(kept(g))[0])
query("cohesion")(lambda g, s, d: community.communities(kept(g))[1].withColumn("cohesion", F.round("cohesion", 6)))
query(
    "community_links",
    f"""{G}, x AS (SELECT e.repo, least(src, dst) AS a, greatest(src, dst) AS b FROM e JOIN n p ON p.repo = e.repo AND p.id = e.src JOIN n q ON q.repo = e.repo AND q.id = e.dst WHERE e.kind IN ('calls', 'implements'))
    SELECT repo, a, b, count(*) AS w FROM x GROUP BY ALL""",
)(lambda g, s, d: community.weighted(g))


def by_package(g: Graph) -> DataFrame:
    """(repo, id, community, approximate): every symbol in the community of its package."""
    return g.nodes.where("package <> ''").select("repo", "id", F.col("package").alias("community"), F.lit(False).alias("approximate"))


query(
    "package_cohesion",
    f"""{G}, o AS (SELECT repo, id, package FROM n WHERE package <> ''), x AS (SELECT e.repo, p.package AS ca, q.package AS cb FROM e JOIN o p ON p.repo = e.repo AND p.id = e.src JOIN o q ON q.repo = e.repo AND q.id = e.dst WHERE e.kind IN ('calls', 'implements')),
    y AS (SELECT repo, ca AS community, ca = cb AS inside FROM x UNION ALL SELECT repo, cb, ca = cb FROM x), t AS (SELECT repo, community, count(*) FILTER (WHERE inside) / count(*) AS cohesion FROM y GROUP BY ALL), z AS (SELECT repo, package AS community, count(*) AS size FROM o GROUP BY ALL HAVING count(*) > 1)
    SELECT repo, community, list_last(string_split(community, '/')) AS name, size, round(cohesion, 6) AS cohesion FROM z JOIN t USING (repo, community)""",
)(lambda g, s, d: community.described(g, community.weighted(g), by_package(g))[1].select("repo", "community", "name", "size", F.round("cohesion", 6).alias("cohesion")))
query("package_slugs", f"{G} SELECT repo, id, trim(regexp_replace(lower(package), '[^a-z0-9]', '-', 'g'), '-') AS slug FROM n WHERE package <> ''")(lambda g, s, d: g.nodes.where("package <> ''").select("repo", "id", slug(F.col("package")).alias("slug")))
query("repo_keys", f"{G} SELECT DISTINCT repo, substr(sha256('/srv/index/' || repo), 1, 12) AS key FROM n")(lambda g, s, d: g.nodes.select("repo").distinct().select("repo", cache_key(F.concat(F.lit(lookup.ROOTS), "repo")).alias("key")))
query("area_notes")(lambda g, s, d: digest.area_notes(kept(g)).withColumn("members", F.array_join("members", ",")))

# --- contracts

CONTRACTS = f"""{G}, k AS (SELECT repo, name AS key, 'symbol' AS kind, id FROM n WHERE kind IN ('func', 'method', 'type', 'interface', 'class') AND regexp_matches(name, '^\\p{{Lu}}')
    UNION ALL SELECT repo, method || ' ' || path, 'route', path FROM r), l AS (SELECT key, list_sort(list(DISTINCT repo)) AS repos FROM k GROUP BY key HAVING count(DISTINCT repo) > 1)"""
query("contracts", f"{CONTRACTS} SELECT * FROM k")(lambda g, s, d: groups.contracts(g))
query("group_links", f"{CONTRACTS} SELECT key, array_to_string(repos, ',') AS repos FROM l")(lambda g, s, d: groups.links(groups.contracts(g)).withColumn("repos", F.array_join("repos", ",")))
query("contract_counts", f"{CONTRACTS} SELECT repo, count(*) AS contracts FROM k GROUP BY repo")(lambda g, s, d: groups.contract_counts(groups.contracts(g)))
query("cross_impact", f"{CONTRACTS}, u AS (SELECT n.repo, n.id, n.name, unnest(repos) AS other FROM n JOIN l ON l.key = n.name) SELECT repo, id, other FROM u WHERE other <> repo")(lambda g, s, d: groups.cross_impact(g, g.nodes))
query(
    "contract_edges",
    f"""{CONTRACTS}, cnt AS (SELECT key FROM k GROUP BY key HAVING count(*) BETWEEN 2 AND 12), few AS (SELECT DISTINCT k.repo, k.key, k.id FROM k JOIN cnt USING (key) JOIN n ON n.repo = k.repo AND n.id = k.id)
    SELECT repo_a, id_a, repo_b, id_b FROM (SELECT a.repo AS repo_a, a.id AS id_a, b.repo AS repo_b, b.id AS id_b, min(a.key) AS key FROM few a JOIN few b ON a.key = b.key AND a.repo < b.repo GROUP BY a.repo, a.id, b.repo, b.id ORDER BY key, repo_a, id_a, repo_b, id_b LIMIT 400)""",
)(lambda g, s, d: groups.contract_edges(groups.contracts(g), g.nodes))
query(
    "group_graph",
    SQL["contract_edges"].replace("SELECT repo_a, id_a, repo_b, id_b FROM", "SELECT repo, src, dst, kind, repo AS dst_repo FROM e WHERE EXISTS (SELECT 1 FROM n WHERE n.repo = e.repo AND n.id = e.src) AND EXISTS (SELECT 1 FROM n WHERE n.repo = e.repo AND n.id = e.dst) UNION ALL SELECT repo_a, id_a, id_b, 'contract', repo_b FROM"),
)(lambda g, s, d: groups.group_graph(g)[1])

# --- changes and renames: every fifth line of each file with symbols is taken as changed, one range of three lines each

RANGES = "ra AS (SELECT repo, file, unnest(generate_series(5, max(line), 50)) AS lo FROM n WHERE file <> '' GROUP BY repo, file), g AS (SELECT repo, file, lo, lo + 2 AS hi FROM ra)"
SPANS = f"""{G}, {RANGES}, sp AS (SELECT repo, file, id, line AS lo, lead(line) OVER (PARTITION BY repo, file ORDER BY line, id) - 1 AS hi FROM n
    WHERE kind IN ('func', 'method', 'type', 'interface', 'class', 'component', 'var', 'const') AND file <> '' AND line > 0),
    ch AS (SELECT DISTINCT sp.repo, sp.id FROM sp JOIN g ON g.repo = sp.repo AND g.file = sp.file AND sp.lo <= g.hi AND (sp.hi IS NULL OR sp.hi >= g.lo))"""


def ranges(g: Graph) -> DataFrame:
    """(repo, file, lo, hi): three lines from line 5, 55, 105 ... of each file."""
    last = g.nodes.where("file <> ''").groupBy("repo", "file").agg(F.max("line").alias("last")).where("last >= 5")
    return last.select("repo", "file", F.explode(F.sequence(F.lit(5), F.col("last"), F.lit(50))).alias("lo")).withColumn("hi", F.col("lo") + 2)


query("symbol_spans", f"{SPANS} SELECT repo, file, id, lo, coalesce(hi, -1) AS hi FROM sp")(lambda g, s, d: changes.symbol_spans(g).withColumn("hi", F.coalesce("hi", F.lit(-1))))
query("detect_changed", f"{SPANS} SELECT * FROM ch")(lambda g, s, d: changes.changed_symbols(g, ranges(g)))
query("detect_impacted", f"{SPANS}, up AS (SELECT repo, id FROM ch UNION SELECT up.repo, c.src FROM up JOIN c ON c.repo = up.repo AND c.dst = up.id) SELECT repo, id FROM up WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.repo = up.repo AND ch.id = up.id)")(
    lambda g, s, d: changes.impacted(g, changes.changed_symbols(kept(g), ranges(g)))
)
DIFF = ["diff --git a/x.go b/x.go", "--- a/x.go", "+++ b/x.go", "@@ -9,0 +10,3 @@ func a() {", "+one", "@@ -40,2 +41,0 @@", "--- a/old.go", "+++ /dev/null", "@@ -1,5 +0,0 @@", "--- a/y.ts", "+++ b/y.ts", "@@ -7 +7 @@", "+z"]
query("diff_parse", "SELECT * FROM (VALUES ('x.go', 10, 12), ('x.go', 41, 41), ('y.ts', 7, 7)) t(file, lo, hi)")(lambda g, s, d: changes.parse_diff(s.createDataFrame(list(enumerate(DIFF)), "ord bigint, line string")))


def written_diff(g: Graph) -> DataFrame:
    """(repo, ord, line): a diff per repo that changes the three lines of each of `ranges`, file by file."""
    r = ranges(g)
    heads = r.select("repo", "file").distinct().select("repo", "file", F.lit(0).alias("lo"), F.concat(F.lit("+++ b/"), "file").alias("line"))
    hunks = r.select("repo", "file", "lo", F.concat(F.lit("@@ -"), "lo", F.lit(" +"), "lo", F.lit(",3 @@ func")).alias("line"))
    return heads.unionByName(hunks).select("repo", F.row_number().over(W.partitionBy("repo").orderBy("file", "lo")).alias("ord"), "line")


query("diff_ranges", f"{G}, {RANGES} SELECT repo, file, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi FROM g")(lambda g, s, d: changes.parse_diff(written_diff(g), ["repo"]))
query("rename_confidence", f"{G} SELECT repo, id, round(1.0 / count(*) OVER (PARTITION BY repo, name), 6) AS confidence FROM n")(lambda g, s, d: rename.confidence(g).withColumn("confidence", F.round("confidence", 6)))
FILES = f"""{G}, {SEED}, rf AS (SELECT n.repo, n.id, n.file FROM n JOIN s ON s.repo = n.repo AND s.id = n.id UNION SELECT e.repo, s.id, n.file FROM e JOIN s ON s.repo = e.repo AND s.id = e.dst JOIN n ON n.repo = e.repo AND n.id = e.src
    UNION SELECT a.repo, a.id, b.file FROM n a JOIN s ON s.repo = a.repo AND s.id = a.id JOIN n b ON b.repo = a.repo AND b.package = a.package WHERE a.kind IN ('type', 'interface', 'class'))"""
query("rename_files", f"{FILES} SELECT DISTINCT repo, id, file FROM rf WHERE file <> ''")(lambda g, s, d: rename.reference_files(g, most_called(g)))


def own_lines(g: Graph, spark: SparkSession, d: str) -> DataFrame:
    files = g.nodes.where("file <> '' AND name <> ''").select("repo", "id", "name", "file")
    return rename.word_hits(files, table(spark, d, "sources"))[0].groupBy("repo", "id", "file").agg(F.count(F.lit(1)).alias("lines"))


query(
    "rename_lines",
    f"""{G}, t AS (SELECT file, unnest(string_split(min(content), chr(10))) AS text FROM sources WHERE content IS NOT NULL GROUP BY file)
    SELECT n.repo, n.id, n.file, count(*) AS lines FROM n JOIN t ON t.file = n.file WHERE n.name <> '' AND contains(t.text, n.name) AND regexp_matches(t.text, '(^|[^A-Za-z0-9_])' || regexp_escape(n.name) || '([^A-Za-z0-9_]|$)') GROUP BY ALL""",
)(own_lines)

# --- shapes: consumers of each type that read its fields and one it does not have


def shapes(g: Graph) -> DataFrame:
    return g.nodes.where("size(fields) > 0").select("repo", F.lower("name").alias("object"), F.concat(F.transform("fields", F.upper), F.array(F.lit("emial"))).alias("props"), F.lit("ui/x.view").alias("file"))


query(
    "shape_check",
    f"""{G}, ty AS (SELECT repo, lower(name) AS object, arg_min(fields, id) AS fields FROM n WHERE len(fields) > 0 GROUP BY ALL), sh AS (SELECT repo, lower(name) AS object, unnest(list_append(fields, 'emial')) AS prop, id FROM n WHERE len(fields) > 0),
    u AS (SELECT sh.repo, sh.object, sh.id, CASE WHEN sh.prop = 'emial' THEN 'emial' ELSE upper(sh.prop) END AS prop FROM sh JOIN ty ON ty.repo = sh.repo AND ty.object = sh.object WHERE NOT list_contains(ty.fields, lower(sh.prop)))
    SELECT repo, object, object AS type, 'ui/x.view' AS file, string_agg(DISTINCT prop, ',' ORDER BY prop) AS unknown FROM u GROUP BY repo, object, id""",
)(lambda g, s, d: shape.shape_check(g.nodes, shapes(g)).withColumn("unknown", F.array_join("unknown", ",")))

# --- search

QUERY = "flush buffer route handler"
TOKENS = """tok AS (SELECT repo, id, list_concat([lower(f)], CASE WHEN len(p) > 1 THEN list_transform(p, lambda x: lower(x)) ELSE [] END) AS ts FROM (
      SELECT repo, id, f, string_split(regexp_replace(regexp_replace(f, '(\\p{Ll})(\\p{Lu})', '\\1 \\2', 'g'), '([^ ])(\\p{Lu}\\p{Ll})', '\\1 \\2', 'g'), ' ') AS p FROM (
        SELECT repo, id, unnest(regexp_extract_all(concat_ws(' ', name, package, signature, doc, id), '[\\p{L}\\p{N}]+')) AS f FROM n))),
    w AS (SELECT repo, id, unnest(ts) AS t FROM tok)"""
QT = ", ".join(f"('{t}')" for t in QUERY.split())
BM25 = f"""{G}, {TOKENS}, len_ AS (SELECT n.repo, n.id, count(w.t) AS len FROM n LEFT JOIN w ON w.repo = n.repo AND w.id = n.id GROUP BY ALL), st AS (SELECT repo, count(*) AS n, avg(len) AS a FROM len_ GROUP BY repo),
    tf AS (SELECT repo, id, t, count(*) AS f FROM w WHERE t IN (SELECT * FROM (VALUES {QT})) GROUP BY ALL), df AS (SELECT repo, t, count(*) AS df FROM tf GROUP BY ALL),
    sc AS (SELECT tf.repo, tf.id, sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * (tf.f * 2.2) / (tf.f + 1.2 * (1 - 0.75 + 0.75 * len_.len / st.a))) AS score
      FROM tf JOIN df USING (repo, t) JOIN st USING (repo) JOIN len_ ON len_.repo = tf.repo AND len_.id = tf.id GROUP BY ALL),
    rk AS (SELECT repo, id, score, row_number() OVER (ORDER BY round(score, 9) DESC, repo, id) - 1 AS rank FROM sc)"""


def lexical(g: Graph, stems: bool) -> DataFrame:
    s = search.bm25_scores(g.nodes, ["repo", "id"], search.node_text(), QUERY, ["repo"], stems)
    return search.top(s.withColumn("score", F.round("score", 9)), ["repo", "id"], search.DEPTH)


def tokens(g: Graph, spark: SparkSession, d: str) -> DataFrame:
    from weftline.functions.text import words

    return g.nodes.select("repo", "id", F.explode(words(search.node_text())).alias("token")).groupBy("repo", "id", "token").agg(F.count(F.lit(1)).alias("n"))


query("tokens", f"{G}, {TOKENS} SELECT repo, id, t AS token, count(*) AS n FROM w GROUP BY ALL")(tokens)
query("bm25_topk", f"{BM25} SELECT repo, id, round(score, 6) AS score, rank FROM rk WHERE rank < 200")(lambda g, s, d: lexical(g, False).select("repo", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank")))
query("bm25_index_topk", SQL["bm25_topk"])(
    lambda g, s, d: search.top(search.index_scores(search.build_index(g.nodes, search.node_text(), False), QUERY).withColumn("score", F.round("score", 9)), ["repo", "id"], search.DEPTH).select("repo", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))
)
query("bm25_stem_topk")(lambda g, s, d: lexical(g, True).withColumn("score", F.round("score", 6)))
query(
    "vector_topk",
    """SELECT query, vec_id, round(score, 6) AS score FROM (SELECT q.vec_id AS query, v.vec_id, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)
    QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) <= 20""",
)(lambda g, s, d: search.vector_top(table(s, d, "embeddings"), "vec_id", table(s, d, "embeddings").where("vec_id % 100 = 0"), 20).withColumn("score", F.round("score", 6)))


def vector_hits(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    q = v.where("embedding IS NOT NULL").agg(F.min_by("embedding", "vec_id")).first()[0]
    return search.top(search.vector_scores(v, ["vec_id"], list(q)).withColumn("score", F.round("score", 4)), ["vec_id"], search.DEPTH)


VHITS = "vh AS (SELECT vec_id, s, row_number() OVER (ORDER BY s DESC, vec_id) - 1 AS rank FROM (SELECT v.vec_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) / sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 4) AS s FROM embeddings v, (SELECT arg_min(embedding, vec_id) AS embedding FROM embeddings) q))"
query("vector_search", f"WITH {VHITS} SELECT vec_id, s AS score, rank FROM vh WHERE rank < 200")(lambda g, s, d: vector_hits(s, d).withColumn("rank", F.col("rank").cast("bigint")))
DOCS = """dw AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS t FROM documents)"""


def fused(g: Graph, spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    lex = search.bm25_scores(docs, ["doc_id"], F.lower("text"), "snapshot reader", stems=False).withColumn("score", F.round("score", 9))
    lists = [search.top(lex, ["doc_id"], search.DEPTH), vector_hits(spark, d).withColumnRenamed("vec_id", "doc_id")]
    return search.top(search.rrf(lists, ["doc_id"]).withColumn("score", F.round("score", 9)), ["doc_id"], 20).select("doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


query(
    "rrf_topk",
    f"""WITH {VHITS}, {DOCS}, dl AS (SELECT doc_id, count(t) AS len FROM documents LEFT JOIN dw USING (doc_id) GROUP BY doc_id), st AS (SELECT count(*) AS n, avg(len) AS a FROM dl),
    tf AS (SELECT doc_id, t, count(*) AS f FROM dw WHERE t IN ('snapshot', 'reader') GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
    sc AS (SELECT doc_id, sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * (f * 2.2) / (f + 1.2 * (1 - 0.75 + 0.75 * len / st.a))) AS score FROM tf JOIN df USING (t) JOIN dl USING (doc_id), st GROUP BY doc_id),
    lx AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM sc),
    un AS (SELECT doc_id, rank FROM lx WHERE rank < 200 UNION ALL SELECT vec_id, rank FROM vh WHERE rank < 200), fu AS (SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM un GROUP BY doc_id)
    SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM fu ORDER BY rank LIMIT 20""",
)(fused)


def hybrid(g: Graph, spark: SparkSession, d: str) -> DataFrame:
    g = kept(g)
    v = table(spark, d, "vectors").where("size(embedding) = 64").dropDuplicates(["id"])
    q = v.where("exists(embedding, x -> x <> 0)").agg(F.min_by("embedding", "id")).first()[0]
    hits = search.search(g, QUERY, 20, list(q), v)
    return hits.join(flow.process_of(g), ["repo", "id"], "left").select("repo", "id", "rank", F.coalesce("process", F.lit("")).alias("process"))


query("hybrid_by_process")(hybrid)
query("most_used", f"{G} SELECT n.repo, n.id FROM n LEFT JOIN e ON e.repo = n.repo AND e.dst = n.id GROUP BY n.repo, n.id ORDER BY count(e.ord) DESC, n.repo, n.id LIMIT 500")(lambda g, s, d: search.most_used(g, 500).select("repo", "id"))

# --- dependence and taint

query(
    "pdg_summary",
    """SELECT repo, id, len(ctrl_edges) AS n_ctrl, data_edges, blocks, array_to_string(params, ',') AS params FROM (SELECT DISTINCT ON (repo, ord) * FROM func_pdgs WHERE id <> '') QUALIFY row_number() OVER (PARTITION BY repo, id ORDER BY ord) = 1""",
)(lambda g, s, d: (lambda p: taint.pdg_of(p, p).select("repo", "id", F.size("ctrl_edges").cast("bigint").alias("n_ctrl"), "data_edges", "blocks", F.array_join("params", ",").alias("params")))(taint.pdgs(s, d)))


def control(spark: SparkSession, d: str) -> DataFrame:
    """(func, from, to): the block pairs of the first summary of each function, one row each."""
    p = taint.pdgs(spark, d)
    return taint.pdg_of(p, p).select(F.concat_ws("/", "repo", "id").alias("func"), F.explode("ctrl_edges").alias("e")).select("func", F.col("e.src").alias("from"), F.col("e.dst").alias("to"))


FIRST_PDG = "p AS (SELECT repo || '/' || id AS func, arg_min(ctrl_edges, ord) AS ctrl FROM func_pdgs WHERE id <> '' GROUP BY repo, id), ce AS (SELECT func, unnest(ctrl) AS x FROM p)"
query(
    "cfg_edges", f"WITH {FIRST_PDG} SELECT func, array_to_string(list_transform(list_sort(list(DISTINCT [x.src, x.dst])), lambda y: y[1] || '>' || y[2]), ',') AS edges FROM ce GROUP BY func"
)(lambda g, s, d: taint.control_edges(control(s, d)).select("func", F.array_join(F.transform("ctrl_edges", lambda e: F.concat_ws(">", e["src"].cast("string"), e["dst"].cast("string"))), ",").alias("edges")))
query("def_use_counts", f"WITH {FIRST_PDG} SELECT func, count(*) AS data_edges FROM ce GROUP BY func")(lambda g, s, d: taint.data_edge_counts(control(s, d).select("func", F.col("from").alias("def"), F.col("to").alias("use"))))


def flows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, uses and arguments read out of the stored summaries: block i of a function calls the i-th name of a fixed round of sources, sinks and others, and control edges pass values on."""
    p = taint.pdgs(spark, d).dropDuplicates(["repo", "id"]).select(F.concat_ws("/", "repo", "id").alias("func"), "blocks", "ctrl_edges")
    names = F.array(*(F.lit(x) for x in CALLED))
    calls = p.select("func", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b")).select("func", F.concat(F.lit("v"), F.col("b").cast("string")).alias("value"), F.element_at(names, F.col("b") % len(CALLED) + 1).alias("callee"), F.col("b").alias("line"))
    links = p.select("func", F.explode("ctrl_edges").alias("e"))
    v = lambda x: F.concat(F.lit("v"), F.col(f"e.{x}").cast("string"))
    return calls, links.select("func", v("src").alias("def"), v("dst").alias("use")), links.select("func", v("dst").alias("call"), v("src").alias("value"))


CALLED = ("main.read", "os.Getenv", "main.join", "os/exec.Command", "main.log", "(*database/sql.DB).Query", "io.ReadAll", "os.Open")
NAMES = "[" + ", ".join(f"'{x}'" for x in CALLED) + "]"
FLOWS = f"""WITH RECURSIVE p AS (SELECT repo || '/' || id AS func, arg_min(blocks, ord) AS blocks, arg_min(ctrl_edges, ord) AS ctrl FROM func_pdgs WHERE id <> '' GROUP BY repo, id),
    ca AS (SELECT func, 'v' || b AS value, ({NAMES})[b % 8 + 1] AS callee, b AS line FROM (SELECT func, unnest(generate_series(0, blocks - 1)) AS b FROM p)),
    li AS (SELECT func, 'v' || x.src AS a, 'v' || x.dst AS b FROM (SELECT func, unnest(ctrl) AS x FROM p)),
    ta AS (SELECT func, value FROM ca WHERE callee IN ('os.Getenv', 'io.ReadAll') UNION SELECT ta.func, li.b FROM ta JOIN li ON li.func = ta.func AND li.a = ta.value)"""


query(
    "taint_findings",
    f"{FLOWS} SELECT DISTINCT ca.func, 'tainted input' AS source, ca.callee AS sink, CAST(ca.line AS INTEGER) AS line FROM ca JOIN li ON li.func = ca.func AND li.b = ca.value JOIN ta ON ta.func = li.func AND ta.value = li.a WHERE ca.callee IN ('os/exec.Command', '(*database/sql.DB).Query', 'os.Open')",
)(lambda g, s, d: taint.findings(*flows(s, d)))

# --- what follows from a front end's tables


def implied(g: Graph) -> DataFrame:
    """Method sets read from the graph: types, and classes in the part of interfaces, with the first letters of the methods they define."""
    own = g.nodes.where(F.col("kind").isin("type", "class")).select("repo", F.col("id").alias("src"), (F.col("kind") == "class").alias("is_interface"))
    m = g.kind("defines").select("repo", "src", "dst").join(g.nodes.select("repo", F.col("id").alias("dst"), "name"), ["repo", "dst"])
    return own.join(m, ["repo", "src"]).select("repo", F.col("src").alias("owner"), "is_interface", F.lit(False).alias("generic"), F.lower(F.substring("name", 1, 1)).alias("signature"))


query(
    "implements_derived",
    f"""{G}, m AS (SELECT DISTINCT n.repo, n.id AS owner, n.kind = 'class' AS i, lower(substr(b.name, 1, 1)) AS sig FROM n JOIN e ON e.repo = n.repo AND e.src = n.id AND e.kind = 'defines' JOIN n b ON b.repo = e.repo AND b.id = e.dst WHERE n.kind IN ('type', 'class')),
    need AS (SELECT repo, owner, count(*) AS k FROM m WHERE i GROUP BY ALL)
    SELECT a.repo, a.owner AS src, b.owner AS dst FROM m a JOIN m b ON a.repo = b.repo AND a.sig = b.sig AND b.i AND NOT a.i GROUP BY a.repo, a.owner, b.owner HAVING count(*) = (SELECT k FROM need WHERE need.repo = a.repo AND need.owner = b.owner)""",
)(lambda g, s, d: extract.implements(implied(g)))
query(
    "constructors_derived",
    f"""{G} SELECT f.repo, f.id AS src, t.id AS dst FROM n f JOIN n t ON t.repo = f.repo AND t.package = f.package AND t.name = substr(f.name, 4) AND t.kind IN ('type', 'class') WHERE f.kind = 'func' AND starts_with(f.name, 'New')""",
)(
    lambda g, s, d: extract.constructors(
        g.nodes.where("kind = 'func'").select("repo", "id", "name", "package", F.lit("").alias("receiver"), F.concat(F.lit("*"), F.expr("substring(name, 4)")).alias("result")), g.nodes.where("kind IN ('type', 'class')").select("repo", "id", "name", "package")
    )
)


def router_calls(g: Graph) -> DataFrame:
    """(repo, ord, name, args): each route as the router call that would register it."""
    return g.routes.select("repo", "ord", F.col("method").alias("name"), F.array(F.concat(F.lit('"'), "path", F.lit('"')), "handler").alias("args"))


METHODS = ", ".join(f"('{k}', '{v}')" for k, v in extract.ROUTE_METHODS.items())
query(
    "routes_derived",
    f"{G}, m(name, method) AS (VALUES {METHODS}) SELECT repo, ord, m.method, path, CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.repo = r.repo AND n.id = r.handler AND n.kind IN ('func', 'method')) THEN handler ELSE '' END AS handler FROM r JOIN m ON m.name = r.method WHERE starts_with(path, '/')",
)(lambda g, s, d: extract.routes(router_calls(g), g.nodes.where("kind IN ('func', 'method')").select("repo", "id", F.col("id").alias("name"))))
SUFFIXES = ", ".join(f"({i}, '{x}')" for i, x in enumerate(extract.IMPORT_SUFFIXES))
query(
    "imports_resolved",
    rf"""{G}, f AS (SELECT DISTINCT repo, file FROM n WHERE regexp_matches(file, '\.(ts|tsx|js|jsx|vue)$')), k(rank, suffix) AS (VALUES {SUFFIXES}),
    ci AS (SELECT repo, file, './' || regexp_replace(regexp_extract(file, '[^/]*$'), '\.[a-z]+$', '') AS spec, regexp_extract(file, '^(.*)/[^/]*$', 1) || '/' || regexp_replace(regexp_extract(file, '[^/]*$'), '\.[a-z]+$', '') AS path FROM f)
    SELECT ci.repo, ci.file, spec, arg_min(f.file, rank) AS target FROM ci JOIN k ON true JOIN f ON f.repo = ci.repo AND f.file = ci.path || k.suffix GROUP BY ALL""",
)(lambda g, s, d: (lambda f: extract.resolve_imports(f.select("repo", "file", F.concat(F.lit("./"), F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[a-z]+$", "")).alias("spec")), f))(g.nodes.where(F.col("file").rlike(r"\.(ts|tsx|js|jsx|vue)$")).select("repo", "file").distinct()))
query(
    "calls_resolved",
    f"{G}, d AS (SELECT repo, name, min(id) AS dst FROM n WHERE name <> '' GROUP BY ALL) SELECT e.repo, e.ord, e.src, d.dst FROM e JOIN n ON n.repo = e.repo AND n.id = e.dst JOIN d ON d.repo = n.repo AND d.name = n.name WHERE e.kind = 'calls' AND e.src <> d.dst",
)(
    lambda g, s, d: extract.resolve_calls(
        g.kind("calls").join(g.nodes.where("name <> ''").select("repo", F.col("id").alias("dst"), F.col("name").alias("decl")), ["repo", "dst"]).select("repo", "ord", "src", "decl"),
        g.nodes.where("name <> ''").select("repo", F.col("id").alias("ord"), F.col("name").alias("decl"), "id"),
    )
)
query(
    "fingerprints",
    """SELECT repo, lang, sha256(string_agg(file || chr(0) || CAST(n AS VARCHAR) || chr(0) || '0' || chr(10), '' ORDER BY file)) AS fingerprint FROM (SELECT DISTINCT repo, coalesce(lang, '') AS lang, file, length(coalesce(content, '')) AS n FROM sources) GROUP BY repo, lang""",
)(lambda g, s, d: prints(s, d))


def prints(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "sources").select("repo", F.coalesce("lang", F.lit("")).alias("lang"), F.col("file").alias("path"), F.length(F.coalesce("content", F.lit(""))).alias("size"), F.timestamp_micros(F.lit(0)).alias("mtime")).distinct()
    return fingerprint(f, ["repo", "lang"])


query("staleness", "SELECT DISTINCT repo, coalesce(lang, '') AS lang FROM sources WHERE coalesce(lang, '') <> 'go'")(lambda g, s, d: stale(prints(s, d), prints(s, d).where("lang = 'go'")))


# --- read off the sources by the syntactic front end

query("source_nodes")(lambda g, s, d: frontend.graph_of(table(s, d, "sources")).nodes.withColumn("fields", F.array_join("fields", ",")))
query("source_edges")(lambda g, s, d: frontend.graph_of(table(s, d, "sources")).edges.groupBy("repo", "src", "dst", "kind").agg(F.count(F.lit(1)).alias("n")))
query(
    "source_imports",
    r"""WITH f AS (SELECT DISTINCT repo, file, replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM sources WHERE content IS NOT NULL AND ends_with(lower(file), '.go') AND NOT ends_with(lower(file), '_test.go')),
    b AS (SELECT repo, file, unnest(regexp_extract_all(t, '(?:^|\n)import \(([^)]*)\)', 1)) AS x FROM f UNION ALL SELECT repo, file, unnest(regexp_extract_all(t, '(?:^|\n)import ((?:[\w.]+ )?"[^"\n]+")', 1)) FROM f)
    SELECT DISTINCT repo, file, spec FROM (SELECT repo, file, unnest(regexp_extract_all(x, '"([^"\n]+)"', 1)) AS spec FROM b)""",
)(lambda g, s, d: frontend.raw(table(s, d, "sources")).where("record = 'import' AND endswith(lower(file), '.go')").select("repo", "file", F.col("a").alias("spec")).distinct())
