import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helpers import day, graph, rows
from weftline import api, cli
from weftline.operators import digest, lookup
from weftline.sources import store
from weftline.streaming import reload

WIKI = [("main", "helper", "calls"), ("file", "store", "implements"), ("mem", "store", "implements")]


@pytest.fixture(scope="module")
def demo(spark):
    g = graph(
        spark,
        {"main": {}, "helper": {}, "store": {"kind": "interface", "name": "Store"}, "file": {"kind": "type", "name": "FileStore", "fields": ["a"]}, "mem": {"kind": "type", "name": "MemStore"}},
        WIKI,
        [("GET", "/x", "main")],
        [("filestore", ["a", "b"], "x.ts")],
    )
    return g


def test_wiki(demo):
    page = digest.markdown(digest.build(demo, "r"))
    for want in ("# r — Architecture", "## Modules", "## Entry Points", "`main`", "## Key Interfaces", "`Store` — implemented by FileStore, MemStore", "## Most-Called", "`helper` — 1 callers"):
        assert want in page
    assert "Frameworks" not in page
    assert {r.slug for r in digest.area_notes(demo).collect()} == {"area-helper", "area-filestore"}


def test_document_round_trip(spark, demo, tmp_path):
    store.write_document(demo, str(tmp_path / "doc"))
    back = store.read_document(spark, str(tmp_path / "doc"), "r")
    assert rows(back.nodes) == rows(demo.nodes) and rows(back.edges) == rows(demo.edges) and rows(back.routes) == rows(demo.routes) and rows(back.shapes) == rows(demo.shapes)


def test_parquet_round_trip_by_repo(spark, demo, tmp_path):
    path = str(tmp_path / "g")
    store.save(demo, path)
    other = graph(spark, {"z": {}}, [])
    other.nodes = other.nodes.withColumn("repo", F.lit("q"))
    store.save(other, path)
    got = store.stored(spark, path)
    assert rows(got.of("r").nodes) == rows(demo.nodes) and rows(got.of("q").nodes, "id") == [("z",)] and rows(got.of("r").shapes) == rows(demo.shapes)


def test_payload(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"repo":"r","record":"node","id":"a","kind":"func"}\n{"repo":"r","record":"edge","ord":1,"from":"a","to":"b","kind":"calls"}\n{"repo":"r","record":"edge","ord":2,"from":"a","to":"a","kind":"calls"}\n{"repo":"r","record":"shape","object":"o","props":["x"],"file":"f"}\n')
    g = store.read_payload(spark, str(tmp_path / "p.json"))
    assert rows(g.nodes, "id", "line") == [("a", 0)] and rows(g.edges, "dst") == [("b",)] and rows(g.shapes, "object") == [("o",)]


def test_registry(spark, tmp_path):
    none = store.registry(spark, str(tmp_path / "nothing"))
    assert none.count() == 0
    with pytest.raises(KeyError):
        store.select_repo(none)
    one = store.register(none, "api", "/w/api", datetime(2024, 1, 1))
    assert store.select_repo(one) == "api" == store.select_repo(one, "api")
    two = store.register(store.register(one, "web", "/w/web", datetime(2024, 1, 1)), "api", "/w/api2", datetime(2024, 1, 2))
    assert rows(two, "name", "path") == [("api", "/w/api2"), ("web", "/w/web")]
    for bad in (lambda: store.select_repo(two), lambda: store.select_repo(two, "zzz")):
        with pytest.raises(KeyError):
            bad()
    for name in ("a/b", "a\\b", ""):
        with pytest.raises(ValueError):
            store.register(one, name, "/", datetime(2024, 1, 1))
    assert store.owner_of(two, "/w/web/src/a.ts") == "web" and store.owner_of(two, "/w/website/a.ts") is None
    assert rows(store.unregister(two, "web"), "name") == [("api",)]


def test_fingerprints(spark, tmp_path):
    for f in ("a.go", "a_test.go", "b.ts", "vendor/c.go", "sub/d.go"):
        (tmp_path / f).parent.mkdir(exist_ok=True)
        (tmp_path / f).write_text("x")
    names = lambda lang: sorted(os.path.basename(r.path) for r in store.listing(spark, str(tmp_path), lang).collect())
    assert names("go") == ["a.go", "d.go"] and names("ts") == ["b.ts"]
    now = store.fingerprint(store.listing(spark, str(tmp_path), "go").withColumns({"repo": F.lit("r"), "lang": F.lit("go")}), ["repo", "lang"])
    now = spark.createDataFrame(now.collect(), now.schema)
    assert store.stale(now, now).count() == 0
    (tmp_path / "a.go").write_text("xy")
    again = store.fingerprint(store.listing(spark, str(tmp_path), "go").withColumns({"repo": F.lit("r"), "lang": F.lit("go")}), ["repo", "lang"])
    assert rows(store.stale(again, now)) == [("r", "go")]
    assert rows(store.stale(now, now.limit(0))) == [("r", "go")]


def test_inside(spark):
    df = spark.createDataFrame([("/r", "/r/a/../b"), ("/r", "/r/../x"), ("/r", "/rx/a"), ("/r/", "/r")], "root string, path string")
    assert [r[0] for r in df.select(lookup.inside("root", "path")).collect()] == [True, False, False, True]


def test_slices(spark, tmp_path):
    g = graph(spark, {"a": {"file": "/srv/index/r/a.go", "line": 3}, "b": {"file": "/srv/index/r/a.go", "line": 99}, "c": {"file": "/srv/index/r/a.go"}, "d": {"file": "/etc/x", "line": 1}}, [])
    src = spark.createDataFrame([("r", f, "go", "1\n2\n3\n4\n5") for f in ("/srv/index/r/a.go", "/etc/x")], "repo string, file string, lang string, content string")
    got = {r.id: (r.start_line, r.code, r.lang) for r in lookup.source_slices(g, src, g.nodes, 1, 1).collect()}
    assert got == {"a": (2, "2\n3\n4", "go"), "b": (98, "", "go"), "c": (1, "1", "go")}


def test_tree(spark):
    g = graph(spark, {"a": {"file": "/x/r/p/a.go"}, "b": {"file": "/x/r/p/a.go"}, "c": {"file": "/x/r/c.go"}}, [])
    assert rows(lookup.explorer_tree(g)) == [("r", "", "c.go", ["c"]), ("r", "p", "a.go", ["a", "b"])]


def test_engine(spark, demo):
    e = api.Engine(spark, demo, group_list=spark.createDataFrame([("g", ["r"])], "name string, repos array<string>"))
    assert rows(e.repos(), "name", "nodes") == [("r", 5)]
    assert [r.id for r in e.impact("helper").collect()] == ["main"]
    assert [r.id for r in e.trace("main", "helper").collect()] == ["main", "helper"]
    assert e.query("helper").first().id == "helper" and e.query("helper").first().process == "main"
    assert [r.id for r in e.check(["x", "main"])[0].collect()] == ["x"]
    assert rows(e.shape_check(), "unknown") == [(["b"],)]
    assert e.whole(limit=2)[2] and not e.whole()[2]
    assert e.process("main")[0].count() == 2 and e.api_impact().count() == 1 and e.group_sync("g")[0].count() == 4
    assert "impact" in [r.name for r in e.tool_map().collect()]
    assert e.wiki().startswith("# r")
    with pytest.raises(KeyError):
        e.group_sync("zzz")


def test_guards(spark, demo):
    e = api.Engine(spark, demo, guards=api.Guards(read_only=True, repos=("q",), budget=40))
    with pytest.raises(PermissionError):
        e.impact("helper", "r")
    with pytest.raises(PermissionError):
        e.remove("r")
    assert e.repos().count() == 0 and e.guards.cap(0) == 2 and api.Guards(budget=1).cap(9) == 1 and api.Guards().cap(0) == 20


def test_cli(capsys):
    assert cli.main([]) == 2 and "commands" in capsys.readouterr().out
    assert cli.main(["/root/testdata/sf0.001", "repos"]) == 0 and "nodes" in capsys.readouterr().out


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    cols = "repo string, ord bigint, src string, dst string, kind string, indexed_at timestamp_ntz"
    for i in range(2):
        spark.createDataFrame([("r", i, "a", "b", " Calls", day(1 + i)), ("r", i, "a", "a", "calls", day(1))], cols).write.mode("append").parquet(src)
        reload.keep_counts(reload.edge_stream(spark, src), out, str(tmp_path / "cp")).awaitTermination(60)
    assert rows(reload.current_counts(spark, out)) == [("r", "a", "calls", 2), ("r", "b", "calls", 2)]
    q = reload.monthly_calls(reload.edge_stream(spark, src)).writeStream.outputMode("complete").format("memory").queryName("calls").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("calls"), "repo", "n") == [("r", 2)]


def test_pages_and_notes(spark, demo, tmp_path):
    files = store.write_notes(digest.area_notes(demo), "r", str(tmp_path / "notes"))
    assert len(files) == 8 and "MemStore" in (tmp_path / "notes" / "area-filestore.md").read_text()
    assert open(store.write_page("x", str(tmp_path / "a" / "b.md"))).read() == "x"


def test_summaries_groups_and_language_parts(spark, demo, tmp_path):
    path = str(tmp_path / "pdg")
    assert [x.count() for x in store.summaries(spark, path)] == [0, 0] and store.groups(spark, path).count() == 0
    p = spark.createDataFrame([("r", "f", 2, [(0, 1)], 3, ["a"])], "repo string, id string, blocks int, ctrl_edges array<struct<src:int,dst:int>>, data_edges int, params array<string>")
    t = spark.createDataFrame([("r", "f", "tainted input", "os.Open", 4)], "repo string, func string, source string, sink string, line int")
    store.save_summaries(p, t, path)
    assert [rows(x) for x in store.summaries(spark, path)] == [rows(p), rows(t)]
    m = lambda lang, f: spark.createDataFrame([("r", lang, f)], "repo string, lang string, fingerprint string")
    out = str(tmp_path / "parts")
    store.save_language(demo, m("go", "1"), out)
    store.save_language(demo, m("ts", "2"), out)
    store.save_language(demo, m("go", "3"), out)
    assert rows(spark.read.parquet(f"{out}/manifest"), "lang", "fingerprint") == [("go", "3"), ("ts", "2")]
    assert spark.read.parquet(f"{out}/nodes").count() == 10


def test_visible_and_actions(spark, demo):
    n, e = lookup.visible(demo, ("interface",))
    assert n.count() == 4 and rows(e, "dst") == [("helper",)]
    assert lookup.visible(demo, (), demo.nodes.where("id = 'main'"))[0].count() == 1
    from weftline.functions.text import json_action

    df = spark.createDataFrame([('say {"tool": "impact", "id": "x"} now',), ("none",)], "t string")
    got = [r[0] for r in df.select(json_action(F.col("t"), "tool string, id string")).collect()]
    assert got[0].tool == "impact" and got[1] is None


def test_late_calls_count(spark, tmp_path):
    src, got = str(tmp_path / "in"), {}
    for k, at in enumerate(("2024-06-01", "2024-06-02", "2024-01-05")):  # the last comes months late
        spark.createDataFrame([("r", k, "a", "b", "calls")], "repo string, ord bigint, src string, dst string, kind string").selectExpr("*", f"timestamp_ntz'{at} 00:00:00' AS indexed_at").coalesce(1).write.mode("append").parquet(src)
        put = lambda batch, _: got.update({r.month: r.n for r in batch.collect()})
        reload.monthly_calls(reload.edge_stream(spark, src, 1)).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
    assert sum(got.values()) == 3
