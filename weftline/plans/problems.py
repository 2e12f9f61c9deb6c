"""Queries of the general data problems and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.operators import hierarchy, hotkeys, orphans, snapshots
from weftline.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.heavy_targets(table(spark, d, "edges"))


def p1_targets(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.target_profile(table(spark, d, "edges")).select("dst", "kind", "n_rows", "n_edges", "first_at", "last_at")


def p1_sources(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.target_sources(table(spark, d, "edges"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, d, "edges"), with_paths=False).select("repo", "id", "root")


def p2_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy.hierarchy(table(spark, d, "edges"))
    return tree.selectExpr("repo", "id", "root", "coalesce(depth, -1) AS depth", "coalesce(size, 0) AS size", "coalesce(array_join(path, '\n'), '') AS path")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendant_lists(table(spark, d, "edges")).selectExpr("repo", "id", "CAST(block_no AS bigint) AS block_no", "array_join(members, '\n') AS members")


def p2_loops(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, d, "edges"), with_paths=False).where("root = ''").select("repo", "id", "looped")


def _p3(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("edges", "nodes", "routes", "func_pdgs")]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(*_p3(spark, d)).select("tab", "period", "repo", "ord")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(orphans.orphans(*_p3(spark, d)))


def p3_standing(spark: SparkSession, d: str) -> DataFrame:
    return orphans.standing_orphans(*_p3(spark, d))


def p3_reopened(spark: SparkSession, d: str) -> DataFrame:
    return orphans.reopened_orphans(*_p3(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "node_snapshots"))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.change_counts(p4_found(spark, d))


KIND = "lower(trim(kind, ' ' || chr(9)))"
DEFINES = f"SELECT repo, src, dst, ord FROM edges WHERE {KIND} = 'defines' AND src <> '' AND dst <> '' AND src <> dst"
TREE = f"""
WITH RECURSIVE e AS ({DEFINES}), up AS (SELECT repo, dst AS id, arg_min(src, ord) AS parent FROM e GROUP BY ALL),
ids AS (SELECT repo, id, parent FROM up UNION ALL SELECT DISTINCT repo, src, NULL FROM e WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.repo = e.repo AND up.id = e.src)),
down(repo, id, root, depth, path) AS (
  SELECT repo, id, id, CAST(0 AS BIGINT), id FROM ids WHERE parent IS NULL
  UNION ALL SELECT c.repo, c.id, d.root, d.depth + 1, d.path || chr(10) || c.id FROM down d JOIN ids c ON c.repo = d.repo AND c.parent = d.id)"""
LIVE = """n.repo = r.repo AND n.id = r.id AND n.indexed_at <= r.t AND (n.removed_at IS NULL OR n.removed_at > r.t)"""
REFS = f"""
WITH r AS (SELECT DISTINCT 'edges' AS tab, repo, ord, dst AS id, indexed_at AS t FROM edges WHERE src <> '' AND dst <> '' AND src <> dst AND {KIND} NOT IN ('imports', 'constructs')
  UNION ALL SELECT DISTINCT 'routes', repo, ord, handler, indexed_at FROM routes WHERE handler <> ''
  UNION ALL SELECT DISTINCT 'func_pdgs', repo, ord, id, indexed_at FROM func_pdgs WHERE id <> '')"""
LOST = f"{REFS}, lost AS (SELECT *, strftime(t, '%Y-%m') AS period FROM r WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE {LIVE}))"
CHANGES = """
WITH s AS (SELECT snapshot_no, repo, id, arg_min(coalesce(signature, ''), ord) AS sig, arg_min(line, ord) AS line FROM node_snapshots WHERE id <> '' GROUP BY ALL),
c AS (SELECT repo, snapshot_no, lag(snapshot_no) OVER (PARTITION BY repo ORDER BY snapshot_no) AS prev FROM (SELECT DISTINCT repo, snapshot_no FROM s)),
now AS (SELECT s.*, c.prev FROM s JOIN c USING (repo, snapshot_no) WHERE prev IS NOT NULL),
old AS (SELECT s.repo, s.id, s.sig, s.line, c.snapshot_no FROM s JOIN c ON c.repo = s.repo AND c.prev = s.snapshot_no),
both_sides AS (SELECT snapshot_no, repo, id, CASE WHEN old.sig IS NULL THEN 'added' WHEN now.sig IS NULL THEN 'removed'
  WHEN now.sig <> old.sig OR now.line IS DISTINCT FROM old.line THEN 'changed' END AS change FROM now FULL JOIN old USING (snapshot_no, repo, id))"""

QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_targets, p1_sources, p2_found, p2_hierarchy, p2_descendants, p2_loops, p3_found, p3_report, p3_standing, p3_reopened, p4_found, p4_counts)}

SQL: dict[str, str] = {
    "p1_found": f"SELECT dst, {KIND} AS kind FROM edges WHERE dst <> '' GROUP BY ALL HAVING count(*) >= 0.02 * (SELECT count(*) FROM edges)",
    "p1_targets": f"""SELECT dst, {KIND} AS kind, count(*) AS n_rows, count(*) FILTER (WHERE src <> '' AND src <> dst) AS n_edges, min(indexed_at) AS first_at, max(indexed_at) AS last_at
        FROM edges WHERE dst <> '' GROUP BY dst, {KIND}""",
    "p1_sources": f"SELECT dst, {KIND} AS kind, count(DISTINCT src) AS n_sources, count(DISTINCT repo) AS n_repos FROM edges WHERE dst <> '' GROUP BY dst, {KIND}",
    "p2_found": f"{TREE} SELECT repo, id, coalesce(down.root, '') AS root FROM ids LEFT JOIN down USING (repo, id)",
    "p2_hierarchy": f"""{TREE}, below AS (SELECT repo, id, count(*) AS size FROM (SELECT repo, unnest(string_split(path, chr(10))) AS id FROM down) GROUP BY ALL),
        looping(repo, id, start, n) AS (SELECT repo, id, id, 0 FROM ids WHERE NOT EXISTS (SELECT 1 FROM down d WHERE d.repo = ids.repo AND d.id = ids.id)
          UNION ALL SELECT l.repo, i.parent, l.start, n + 1 FROM looping l JOIN ids i ON i.repo = l.repo AND i.id = l.id WHERE n < 60),
        on_loop AS (SELECT DISTINCT repo, id FROM looping WHERE id = start AND n > 0),
        under AS (SELECT repo, id, count(DISTINCT start) AS size FROM looping GROUP BY ALL)
        SELECT repo, id, coalesce(down.root, '') AS root, coalesce(depth, -1) AS depth, CASE WHEN on_loop.id IS NULL THEN coalesce(below.size, under.size) ELSE 0 END AS size, coalesce(path, '') AS path
        FROM ids LEFT JOIN down USING (repo, id) LEFT JOIN below USING (repo, id) LEFT JOIN on_loop USING (repo, id) LEFT JOIN under USING (repo, id)""",
    "p2_descendants": f"""{TREE}, pairs AS (SELECT repo, id AS member, unnest(string_split(path, chr(10))) AS id FROM down)
        SELECT repo, id, CAST(0 AS BIGINT) AS block_no, string_agg(member, chr(10) ORDER BY member) AS members FROM pairs WHERE id <> member GROUP BY repo, id""",
    "p2_loops": f"""{TREE}, bad AS (SELECT repo, id, parent FROM ids WHERE NOT EXISTS (SELECT 1 FROM down d WHERE d.repo = ids.repo AND d.id = ids.id)),
        looping(repo, id, start, n) AS (SELECT repo, id, id, 0 FROM bad UNION ALL SELECT l.repo, b.parent, l.start, n + 1 FROM looping l JOIN bad b ON b.repo = l.repo AND b.id = l.id WHERE n < 60)
        SELECT repo, start AS id, bool_or(id = start AND n > 0) AS looped FROM looping GROUP BY repo, start""",
    "p3_found": f"{LOST} SELECT tab, period, repo, ord FROM lost",
    "p3_report": f"""{LOST}, told AS (SELECT tab, period, EXISTS (SELECT 1 FROM nodes n WHERE n.repo = lost.repo AND n.id = lost.id AND n.indexed_at > lost.t) AS done FROM lost)
        SELECT tab, period, count(*) AS orphans, count(*) FILTER (WHERE done) AS resolved, count(*) FILTER (WHERE NOT done) AS waiting FROM told GROUP BY ALL""",
    "p3_standing": f"""{REFS}, m AS (SELECT CAST(unnest(generate_series((SELECT date_trunc('month', min(t)) FROM r), (SELECT max(t) FROM r), INTERVAL 1 MONTH)) AS TIMESTAMP) AS month)
        SELECT tab, strftime(month, '%Y-%m') AS period, count(*) AS standing FROM r JOIN m ON r.t < month + INTERVAL 1 MONTH
        WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.repo = r.repo AND n.id = r.id AND n.indexed_at <= month + INTERVAL 1 MONTH AND (n.removed_at IS NULL OR n.removed_at > month + INTERVAL 1 MONTH)) GROUP BY ALL""",
    "p3_reopened": f"""{REFS}, m AS (SELECT CAST(unnest(generate_series((SELECT date_trunc('month', min(t)) FROM r), (SELECT max(t) FROM r), INTERVAL 1 MONTH)) AS TIMESTAMP) + INTERVAL 1 MONTH AS upto)
        SELECT tab, strftime(upto - INTERVAL 1 MONTH, '%Y-%m') AS period, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM nodes n WHERE {LIVE}) OR EXISTS (SELECT 1 FROM nodes n WHERE n.repo = r.repo AND n.id = r.id AND n.indexed_at > r.t AND n.indexed_at <= upto)) AS reopened FROM r JOIN m ON r.t < upto
        WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.repo = r.repo AND n.id = r.id AND n.indexed_at <= upto AND (n.removed_at IS NULL OR n.removed_at > upto)) GROUP BY ALL""",
    "p4_found": f"{CHANGES} SELECT * FROM both_sides WHERE change IS NOT NULL",
    "p4_counts": f"{CHANGES} SELECT snapshot_no, change, count(*) AS n FROM both_sides WHERE change IS NOT NULL GROUP BY ALL",
}
