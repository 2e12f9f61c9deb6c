"""What outlives a process: graphs that are replaced whole, registry, groups, fingerprints, and the command line over them."""

import pytest
from pyspark.sql import functions as F

from helpers import graph, rows
from weftline import api, cli
from weftline.sources import store
from weftline.sources.home import Home


def test_saving_again_replaces_every_table(spark, tmp_path):
    path = str(tmp_path / "g")
    store.save(graph(spark, {"a": {}, "b": {}}, [("a", "b", "calls")], [("GET", "/x", "a")], [("o", ["p"], "f.ts")]), path)
    other = graph(spark, {"z": {}}, [("z", "y", "calls")])
    store.save(type(other)(*(t.withColumn("repo", F.lit("q/1 ")) for t in (other.nodes, other.edges, other.routes, other.shapes))), path)
    store.save(graph(spark, {"a": {}}, []), path)
    got = store.stored(spark, path)
    assert rows(got.of("r").nodes, "id") == [("a",)]
    assert [t.where("repo = 'r'").count() for t in (got.edges, got.routes, got.shapes)] == [0, 0, 0]
    assert rows(got.of("q/1 ").edges, "dst") == [("y",)]
    assert store.stored(spark, str(tmp_path / "nothing")).nodes.count() == 0
    parts = str(tmp_path / "parts")
    m = lambda lang, f: spark.createDataFrame([("r", lang, f)], "repo string, lang string, fingerprint string")
    g = graph(spark, {"a": {}}, [("a", "b", "calls")])
    store.save_language(g, m("go", "1"), parts)
    store.save_language(g, m("ts", "1"), parts)
    store.save_language(graph(spark, {"a": {}}, []), m("go", "2"), parts)
    assert rows(spark.read.parquet(f"{parts}/edges"), "lang") == [("ts",)]


def put(folder, **files):
    for name, text in files.items():
        f = folder / name.replace("__", "/").replace("_go", ".go").replace("_ts", ".ts")
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)


def test_index_status_reindex_groups(spark, tmp_path):
    src, home = tmp_path / "api", str(tmp_path / "home")
    put(src, srv__a_go='package srv\n\nfunc Serve() { help() }\n\nfunc help() {}\n', web__k_ts="export function run() { return 1 }\n")
    e = api.Engine.open(spark, home)
    assert e.repos().count() == 0
    e.index_sources("api", str(src))
    with pytest.raises(ValueError):
        e.index_sources("a/b", str(src))
    assert rows(e.repos(), "name", "nodes") == [("api", 5)]
    assert [r.id for r in e.impact("srv.help").collect()] == ["srv.Serve"]
    assert "func help" in e.source("srv.help").first().code
    assert e.shape_check().count() == 0 and e.explain().count() == 0 and e.explain("srv.help").count() == 0
    assert rows(e.status(), "lang", "state") == [("go", "fresh"), ("ts", "fresh")] and not e.reindex("api")
    put(src, srv__a_go="package srv\n\nfunc Serve() { other() }\n\nfunc other() {}\n")
    assert rows(e.status(), "lang", "state") == [("go", "stale"), ("ts", "fresh")]
    seen = api.Engine.open(spark, home)  # what another process holds
    assert e.reindex("api") and rows(e.status(), "state") == [("fresh",), ("fresh",)]
    assert [r.id for r in seen.impact("srv.other").collect()] == ["srv.Serve"] and seen.impact("srv.help").count() == 0
    put(tmp_path / "web", m_ts="export function Serve() { return 2 }\n")
    e.index_sources("web", str(tmp_path / "web"))
    e.group_create("all", "api")
    e.group_add("all", "web")
    assert rows(Home(spark, home).groups()) == [("all", ["api", "web"])]
    assert rows(e.group_sync("all")[1], "key", "repos") == [("Serve", ["api", "web"])]
    e.group_remove("all", "web")
    assert rows(e.group_list(), "repos") == [(["api"],)]
    for bad in (lambda: e.group_add("all", "nope"), lambda: e.group_add("nope", "api"), lambda: e.impact("x", "nope")):
        with pytest.raises(KeyError):
            bad()
    e.remove("api")
    assert rows(e.repos(), "name") == [("web",)] and e.graph.of("api").nodes.count() == 0 and rows(e.groups(), "repos") == [([],)]
    with pytest.raises(PermissionError):
        api.Engine.open(spark, home, api.Guards(read_only=True)).reindex("web")
    e.clean()
    assert e.repos().count() == 0


def test_embedding_while_indexing(spark, tmp_path):
    e = api.Engine.open(spark, str(tmp_path / "home"))
    g = graph(spark, {"a": {}, "b": {}, "c": {}}, [("a", "b", "calls"), ("c", "b", "calls"), ("c", "a", "calls")])
    pdgs = spark.createDataFrame([("r", "a", 2, [(0, 1)], 3, ["x"])], "repo string, id string, blocks int, ctrl_edges array<struct<src:int,dst:int>>, data_edges int, params array<string>")
    taint = spark.createDataFrame([("r", "a", "tainted input", "os.Open", 4)], "repo string, func string, source string, sink string, line int")
    (tmp_path / "r").mkdir()
    e.index("r", str(tmp_path / "r"), g, client=lambda texts: [[3.0, 4.0]] * len(texts), embed_most=2, pdgs=pdgs, taint_found=taint)
    assert rows(e.vectors, "id") == [("a",), ("b",)] and e.explain("a").first().line == 4 and e.pdg_query("a").first().data_edges == 3


def test_commands(spark, tmp_path, capsys):
    put(tmp_path / "api", a_go="package a\n\nfunc Main() { Run() }\n\nfunc Run() {}\n")
    home, said = str(tmp_path / "home"), lambda: capsys.readouterr().out
    run = lambda *args: cli.main([home, *args])
    assert run("index", "api", str(tmp_path / "api")) == 0
    for args, want in (
        (("list",), "api"),
        (("status",), "fresh"),
        (("impact", "a.Run"), "depth"),
        (("context", "a.Run"), "direction"),
        (("check", "nope"), "nope"),
        (("cypher", "(a)-[:CALLS]->(b)"), "a.Run"),
        (("shape-check",), "unknown"),
        (("explain",), "sink"),
        (("clusters",), "community"),
        (("rename", "a.Run", "Go"), "func Go() {}"),
        (("wiki",), "Architecture"),
        (("skills", str(tmp_path / "skills")), "impact-analysis.md"),
        (("group", "create", "g", "api"), "g"),
        (("group", "sync", "g"), "Main"),
        (("reindex", "api"), "False"),
        (("remove", "api"), "indexed_at"),
        (("clean",), "None"),
    ):
        assert run(*args) == 0
        assert want in said(), args
    assert run("group") == 2 and run("nope") == 2 and "commands" in said()
    assert "`impact`" in (tmp_path / "skills" / "impact-analysis.md").read_text()
