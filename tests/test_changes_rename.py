import pytest

from helpers import graph, rows
from weftline.operators import changes, rename

DIFF = """diff --git a/x.go b/x.go
--- a/x.go
+++ b/x.go
@@ -9,0 +10,3 @@ func
+a
@@ -40,2 +41,0 @@
--- a/old.go
+++ /dev/null
@@ -1,5 +0,0 @@
--- a/y.ts
+++ b/y.ts
@@ -7 +7 @@ x""".split("\n")


def test_diff(spark):
    lines = spark.createDataFrame(list(enumerate(DIFF)), "ord bigint, line string")
    assert rows(changes.parse_diff(lines)) == [("x.go", 10, 12), ("x.go", 41, 41), ("y.ts", 7, 7)]
    assert changes.parse_diff(lines.limit(0)).count() == 0
    with pytest.raises(ValueError):
        changes.git_diff(spark, ".", "--output=/tmp/x")


def test_spans(spark):
    g = graph(spark, {"A": {"file": "f", "line": 5}, "B": {"file": "f", "line": 20}, "C": {"file": "f", "line": 50}, "D": {"file": "f", "line": 50}, "p": {"kind": "package", "file": "f", "line": 1}}, [("X", "B", "calls"), ("Y", "X", "calls"), ("A", "B", "calls")])
    hit = lambda lo, hi: rows(changes.changed_symbols(g, spark.createDataFrame([("r", "f", lo, hi)], "repo string, file string, lo int, hi int")), "id")
    assert hit(25, 25) == [("B",)] and hit(5, 55) == [("A",), ("B",), ("C",), ("D",)] and hit(50, 50) == [("D",)] and hit(1, 4) == []
    changed = spark.createDataFrame([("r", "A"), ("r", "B")], "repo string, id string")
    assert rows(changes.impacted(g, changed), "id") == [("X",), ("Y",)]


def test_rename(spark, tmp_path):
    d, u = tmp_path / "def.go", tmp_path / "use.go"
    d.write_text("func Old() {}\n// OldNot, _Old, éOld Old\n")
    u.write_text("Old()\nnone\nx.Old + Old\n")
    g = graph(spark, {"p.Old": {"name": "Old", "file": str(d)}, "p.use": {"name": "use", "file": str(u)}}, [("p.use", "p.Old", "calls")])
    src = spark.createDataFrame([("r", str(f), "go", f.read_text()) for f in (d, u)] + [("r", str(d), "go", None)], "repo string, file string, lang string, content string")
    plan = rename.plan(g, src, "r", "p.Old", "New")
    assert rows(plan, "file", "line", "confidence") == [(str(d), 1, 1.0), (str(d), 2, 1.0), (str(u), 1, 1.0), (str(u), 3, 1.0)]
    assert "Old()" in u.read_text()
    assert rename.apply(plan, str(tmp_path)) == 2
    assert u.read_text() == "New()\nnone\nx.New + New\n" and d.read_text() == "func New() {}\n// OldNot, _Old, éNew New\n"
    for new in ("2x", "Old", "a b"):
        with pytest.raises(ValueError):
            rename.plan(g, src, "r", "p.Old", new)
    with pytest.raises(KeyError):
        rename.plan(g, src, "r", "nope", "New")


def test_confidence(spark):
    g = graph(spark, {"a": {"name": "N"}, "b": {"name": "N"}, "c": {"name": "M"}}, [])
    assert rows(rename.confidence(g), "id", "confidence") == [("a", 0.5), ("b", 0.5), ("c", 1.0)]
