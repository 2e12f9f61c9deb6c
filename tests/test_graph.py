import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import graph, rows
from weftline.operators import community, flow, groups, lookup, shape, traverse
from weftline.operators.graph import Graph

DIAMOND = [("a", "b", "calls"), ("b", "c", "calls"), ("d", "b", "calls")]


def seeds(spark, *ids):
    return spark.createDataFrame([("r", i, i) for i in ids], "repo string, root string, id string")


@pytest.fixture(scope="module")
def diamond(spark):
    return graph(spark, {x: {} for x in "abcd"}, DIAMOND)


def test_impact_and_dependencies(spark, diamond):
    assert rows(traverse.impact(diamond.calls(), seeds(spark, "c")), "id", "depth", "confidence") == [("a", 2, 0.5), ("b", 1, 1.0), ("d", 2, 0.5)]
    assert rows(traverse.dependencies(diamond.calls(), seeds(spark, "a")), "id", "depth") == [("b", 1), ("c", 2)]
    assert traverse.impact(diamond.calls(), seeds(spark, "unknown")).count() == 0


def test_trace(spark, diamond):
    pairs = spark.createDataFrame([("r", "a", "c"), ("r", "c", "a"), ("r", "zz", "zz")], "repo string, src string, dst string")
    assert rows(traverse.trace(diamond.edges, pairs), "src", "step", "id") == [("a", 0, "a"), ("a", 1, "b"), ("a", 2, "c"), ("zz", 0, "zz")]


def bfs(edges, start, forward=True):
    depth, queue = {start: 0}, [start]
    for cur in queue:
        for a, b, k in edges:
            x, y = (a, b) if forward else (b, a)
            if k == "calls" and x == cur and y not in depth:
                depth[y] = depth[x] + 1
                queue.append(y)
    return depth


def queue_path(edges, src, dst):
    came, queue = {src: None}, [src]
    for cur in queue:
        for a, b, k in edges:
            if k == "calls" and a == cur and b not in came:
                came[b] = cur
                queue.append(b)
    if dst not in came:
        return []
    path = [dst]
    while came[path[-1]] is not None:
        path.append(came[path[-1]])
    return path[::-1]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_closures_of_random_multigraphs(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(14)]
    edges = [(a, b, rng.choice(["calls", "calls", "defines"])) for a, b in ((rng.choice(ids), rng.choice(ids)) for _ in range(30)) if a != b]
    g = graph(spark, {x: {} for x in ids[:10]}, edges)
    want = {(s, i, d) for s in ids for i, d in bfs(edges, s, False).items() if d}
    assert {tuple(r) for r in traverse.impact(g.calls(), seeds(spark, *ids)).select("root", "id", "depth").collect()} == want
    pairs = spark.createDataFrame([("r", a, b) for a in ids[:6] for b in ids[6:]], "repo string, src string, dst string")
    got = {}
    for r in traverse.trace(g.edges, pairs).orderBy("step").collect():
        got.setdefault((r.src, r.dst), []).append(r.id)
    assert got == {(a, b): p for a in ids[:6] for b in ids[6:] if (p := queue_path(edges, a, b))}
    entries = sorted(x for x in ids[:10] if any(a == x and k == "calls" for a, _, k in edges) and not any(b == x and k == "calls" for _, b, k in edges))
    first = {i: next((e for e in entries if i in bfs(edges, e)), "") for i in ids[:10]}
    assert {r.id: r.process for r in flow.process_of(g).collect()} == first


@pytest.fixture(scope="module")
def flows(spark):
    return graph(spark, {x: {} for x in "abcde"}, [("a", "b", "calls"), ("b", "c", "calls"), ("e", "b", "calls"), ("a", "b", "calls"), ("b", "ext", "calls")])


def test_flows(spark, flows):
    assert rows(flow.entry_points(flows), "id") == [("a",), ("e",)]
    assert rows(flow.flow_sizes(flows), "id", "size") == [("a", 3), ("e", 3)]
    nodes = flow.flow_nodes(flows, seeds(spark, "a", "nowhere"))
    assert rows(nodes, "root", "id") == [("a", "a"), ("a", "b"), ("a", "c")]
    assert rows(flow.flow_edges(flows, nodes), "src", "dst") == [("a", "b"), ("b", "c")]
    assert rows(flow.processes_of(flows, seeds(spark, "c", "a")), "root", "id") == [("a", "a"), ("c", "a"), ("c", "e")]
    assert rows(flow.process_of(flows), "id", "process") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", ""), ("e", "e")]


def test_neighbourhood_passes_through_external_ids(spark):
    g = graph(spark, {"a": {}, "b": {}, "c": {}}, [("a", "ext", "imports"), ("b", "ext", "imports"), ("b", "c", "defines")])
    nodes, edges = traverse.neighbourhood(g.nodes, g.edges, seeds(spark, "a"), 2)
    assert rows(nodes, "id", "depth") == [("a", 0), ("b", 2)]
    assert rows(edges, "src", "dst") == [("a", "ext"), ("b", "ext")]


def test_api_impact_and_callers(spark):
    g = graph(spark, {x: {"file": "f.go"} for x in "abcd"}, DIAMOND, [("GET", "/x", "b"), ("GET", "/y", "")])
    assert sorted((r.path, r.id or "") for r in flow.api_impact(g).collect()) == [("/x", "a"), ("/x", "d"), ("/y", "")]
    assert rows(flow.api_impact(g, "/x"), "id") == [("a",), ("d",)]
    assert rows(flow.caller_counts(g), "id", "callers") == [("b", 2), ("c", 3)]


@pytest.fixture(scope="module")
def trio(spark):
    return graph(spark, {"f": {"kind": "func"}, "m": {"kind": "method"}, "t": {"kind": "type"}}, [("f", "m", "calls"), ("f", "t", "references"), ("f", "ghost", "calls"), ("f", "lib", "imports")])


def test_checks(spark, trio):
    asked = spark.createDataFrame([("r", 0, "nope"), ("r", 1, "f"), ("r", 2, "nope")], "repo string, pos int, id string")
    assert rows(lookup.missing_ids(trio, asked), "pos", "id") == [(0, "nope"), (2, "nope")]
    assert rows(lookup.dangling(trio), "dst") == [("ghost",)]


def test_patterns(spark, trio):
    assert rows(lookup.pattern(trio, "(a:func)-[:CALLS]->(b:method)"), "src", "dst") == [("f", "m")]
    assert lookup.pattern(trio, " ( a ) - [ ] -> ( b ) ").count() == 4
    assert lookup.pattern(trio, "(a)-[:calls]->(b)", limit=1).collect()[0].dst == "m"
    assert lookup.pattern(trio, "(a:Func)-[:calls]->(b)").count() == 0
    with pytest.raises(ValueError):
        lookup.pattern(trio, "f calls m")


def test_counts(spark, trio):
    assert rows(lookup.kind_counts(trio)) == [("r", 0, 2, 1, 3)]
    assert rows(lookup.degree(trio.edges), "id", "degree")[0] == ("f", 4)
    assert rows(lookup.hot_symbols(trio), "id", "callers") == [("m", 1)]
    assert rows(lookup.context(trio, seeds(spark, "m")), "direction", "other") == [("in", "f")]
    top, edges = lookup.top_graph(trio, 2)
    assert rows(top, "id") == [("f",), ("m",)] and rows(edges, "dst") == [("m",)]


def test_frameworks(spark):
    g = graph(spark, {}, [("p", "github.com/gin-gonic/gin", "imports"), ("p", "gorm.io/gorm", "imports"), ("p", "fmt", "imports"), ("p", "vue", "calls")])
    assert rows(lookup.frameworks(g), "framework") == [("GORM",), ("Gin",)]


def test_communities(spark):
    tri = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("c", "x"), ("a", "ext")]
    g = graph(spark, {x: {"package": "kit/one" if x < "m" else ""} for x in [*"abcxyz", "lone"]}, [(a, b, "calls") for a, b in tri])
    members, report = community.communities(g)
    got = {}
    for r in members.collect():
        got.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, got.values())) == [["a", "b", "c"], ["x", "y", "z"]]
    assert sorted((r["name"], r["size"], round(r.cohesion, 4)) for r in report.collect()) == [("one", 3, round(6 / 7, 4)), ("x", 3, round(6 / 7, 4))]
    near = community.assign(g, bound=1).collect()
    assert all(r.approximate for r in near) and {r.id for r in near} == set("abcxyz")


def test_shapes(spark):
    g = graph(spark, {"u": {"kind": "type", "name": "User", "fields": ["name", "email"]}, "v": {"kind": "type", "name": "user", "fields": ["emial"]}}, [], shapes=[("user", ["Name", "emial", "email", "emial"], "a.ts"), ("widget", ["x"], "a.ts"), ("USER", ["name"], "b.ts")])
    assert rows(shape.shape_check(g.nodes, g.shapes), "object", "type", "file", "unknown") == [("user", "user", "a.ts", ["emial"])]


def named(spark, repo, *names):
    g = graph(spark, {f"{repo}.{n}": {"kind": "type", "name": n} for n in names}, [])
    return Graph(g.nodes.withColumn("repo", F.lit(repo)), g.edges.withColumn("repo", F.lit(repo)), g.routes.withColumn("repo", F.lit(repo)))


def test_groups(spark):
    g = named(spark, "api", "User", "hidden").merge(named(spark, "web", "User")).merge(named(spark, "tool", "Widget"))
    c = groups.contracts(g)
    assert rows(groups.links(c)) == [("User", ["api", "web"])]
    assert rows(groups.cross_impact(g, spark.createDataFrame([("api", "api.User")], "repo string, id string")), "other") == [("web",)]
    assert rows(groups.contract_edges(c, g.nodes)) == [("api", "api.User", "web", "web.User")]
    assert groups.contract_edges(c, g.nodes, most_per_key=1).count() == 0
    many = named(spark, "a", "Key").merge(named(spark, "b", *["Key"]))
    assert groups.contract_edges(groups.contracts(many).unionByName(groups.contracts(many).withColumn("id", F.concat("id", F.lit("2")))), many.nodes, most_per_key=3).count() == 0
    nodes, edges = groups.group_graph(g)
    assert nodes.count() == 4 and rows(edges, "kind", "repo", "dst_repo") == [("contract", "api", "web")]


def test_group_lists(spark):
    reg = spark.createDataFrame([("a",), ("b",)], "name string")
    none = spark.createDataFrame([], "name string, repos array<string>")
    g = groups.upsert_group(none, "g", ["b", "a", "b"], reg, create=True)
    assert rows(groups.upsert_group(g, "g", ["a"], reg)) == [("g", ["a", "b"])]
    assert rows(groups.remove_from_group(g, "g", ["a"])) == [("g", ["b"])]
    with pytest.raises(KeyError):
        groups.upsert_group(none, "g", ["a"], reg)
    with pytest.raises(KeyError):
        groups.upsert_group(g, "g", ["zzz"], reg)


def test_merge_keeps_the_first_and_all_edges(spark):
    a = graph(spark, {"x": {"doc": "one"}}, [("x", "y", "calls")])
    b = graph(spark, {"x": {"doc": "two"}, "z": {}}, [("x", "y", "calls"), ("z", "z", "calls"), ("", "z", "calls")])
    m = a.merge(b)
    assert rows(m.nodes, "id", "doc") == [("x", "one"), ("z", "")] and m.edges.count() == 2


def test_partitions_do_not_change_results(spark, flows):
    want = rows(flow.flow_sizes(flows), "id", "size")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows(flow.flow_sizes(flows), "id", "size") == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_closure_goes_to_the_end_of_any_chain(spark, monkeypatch):
    from unittest.mock import MagicMock

    written = []
    monkeypatch.setattr(traverse, "place", lambda *_: "x")
    monkeypatch.setattr(traverse, "_adjacency", lambda *_: MagicMock())
    monkeypatch.setattr(traverse, "_levels", lambda *_: MagicMock())
    monkeypatch.setattr(traverse, "_write", lambda df, path: written.append(path) or int(len(written) <= 10_005))  # a chain of as many levels
    traverse.closure(MagicMock(), MagicMock())
    assert len(written) == 10_006
    written.clear()
    traverse.closure(MagicMock(), MagicMock(), most=3)
    assert len(written) == 4


@pytest.mark.parametrize("seed", [5])
def test_loops_and_tasks_give_the_same(spark, seed):
    """Repos beyond the bound go through loops of joins: same rows, one repo either way, both at once."""
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(12)]
    edges = [(r, i, rng.choice(ids), rng.choice(ids), "calls") for r, n in (("big", 30), ("small", 12)) for i in range(n)]
    edges = [e for e in edges if e[2] != e[3]]
    e = spark.createDataFrame(edges, "repo string, ord bigint, src string, dst string, kind string")
    links = e.select("repo", "src", "dst")
    own = spark.createDataFrame([(r, i, i) for r in ("big", "small") for i in ids], "repo string, root string, id string")
    half = own.select("repo", "id").where("id < 'n5'")
    for how in ({}, {"reverse": True, "most": 2}):
        want = rows(traverse.closure(links, own, **how))
        assert rows(traverse.reached(links, own, **how)) == want == rows(traverse.reached(links, own, bound=15, **how))
    assert rows(traverse.reach_counts(links, own, half)) == rows(traverse.reach_counts(links, own, half, bound=15, roots=3))
    assert rows(traverse.first_root(links, half)) == rows(traverse.first_root(links, half, bound=15))
    pairs = own.select("repo", F.col("id").alias("src"), F.lit("n3").alias("dst"))
    assert rows(traverse.trace(e, pairs)) == rows(traverse.trace(e, pairs, bound=15))


def test_many_roots_in_several_blocks(spark, monkeypatch):
    from weftline.operators import intask

    monkeypatch.setattr(intask, "ROOTS", 7)
    links = spark.createDataFrame([("r", f"n{i:03}", f"n{i + 1:03}") for i in range(200)], "repo string, src string, dst string")
    own = spark.createDataFrame([("r", f"n{i:03}", f"n{i:03}") for i in range(201)], "repo string, root string, id string")
    assert rows(traverse.reach_counts(links, own), "root", "n") == [(f"n{i:03}", 201 - i) for i in range(201)]
    assert traverse.reached(links, own).count() == 201 * 202 // 2
