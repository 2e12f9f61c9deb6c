from helpers import graph, rows
from weftline.operators import extract, taint


def test_taint(spark):
    calls = spark.createDataFrame([("run", "v1", "os.Getenv", 1), ("run", "v3", "os/exec.Command", 9), ("run", "v4", "os/exec.Command", 9), ("safe", "v1", "main.x", 1), ("safe", "v3", "os/exec.Command", 4), ("other", "v3", "os.Open", 1)], "func string, value string, callee string, line int")
    uses = spark.createDataFrame([("run", "v1", "v2"), ("run", "v2", "v1"), ("safe", "v1", "v2")], "func string, def string, use string")
    args = spark.createDataFrame([("run", "v3", "v2"), ("run", "v4", "v1"), ("safe", "v3", "v2"), ("other", "v3", "v2")], "func string, call string, value string")
    found = taint.findings(calls, uses, args)
    assert rows(found) == [("run", "tainted input", "os/exec.Command", 9)]
    assert taint.taint_of(found, "safe").count() == 0 and taint.taint_of(found).count() == 1
    assert rows(taint.data_edge_counts(uses)) == [("run", 2), ("safe", 1)]
    cfg = spark.createDataFrame([("f", 0, 1), ("f", 0, 1), ("f", 1, 2)], "func string, from int, to int")
    assert taint.control_edges(cfg).first().ctrl_edges == [(0, 1), (1, 2)]


def test_fields(spark):
    raw = spark.createDataFrame([("r", "T", 0, "Name", '`json:"name,omitempty" db:"n"`'), ("r", "T", 1, "Skip", '`json:"-"`'), ("r", "T", 2, "Plain", ""), ("r", "T", 3, "hidden", ""), ("r", "T", 4, "Only", '`json:",omitempty"`')], "repo string, id string, pos int, name string, tag string")
    assert rows(extract.struct_fields(raw)) == [("r", "T", ["name", "Plain", "Only"])]


def test_implements(spark):
    m = spark.createDataFrame([("r", "I", True, False, "A()"), ("r", "I", True, False, "B()"), ("r", "T", False, False, "A()"), ("r", "T", False, False, "B()"), ("r", "T", False, False, "C()"), ("r", "U", False, False, "A()"), ("r", "G", False, True, "A()"), ("r", "G", False, True, "B()")], "repo string, owner string, is_interface boolean, generic boolean, signature string")
    assert rows(extract.implements(m)) == [("r", "T", "I")]


def test_routes_and_imports(spark):
    calls = spark.createDataFrame([("r", 1, "GET", ['"/x"', "show"]), ("r", 2, "HandleFunc", ["`/y`", "func() {}"]), ("r", 3, "GET", ['"x"', "show"]), ("r", 4, "GET", ['"/x"']), ("r", 5, "Get", ['"/x"', "show"])], "repo string, ord bigint, name string, args array<string>")
    funcs = spark.createDataFrame([("r", "p.show", "show")], "repo string, id string, name string")
    assert rows(extract.routes(calls, funcs)) == [("r", 1, "GET", "/x", "p.show"), ("r", 2, "ANY", "/y", "")]
    files = spark.createDataFrame([("r", f) for f in ("src/a.ts", "src/lib/index.ts", "src/lib.vue", "b.js")], "repo string, file string")
    imports = spark.createDataFrame([("r", "src/a.ts", "./lib"), ("r", "src/a.ts", "../b"), ("r", "src/a.ts", "vue"), ("r", "src/a.ts", "./none")], "repo string, file string, spec string")
    assert rows(extract.resolve_imports(imports, files)) == [("r", "src/a.ts", "../b", "b.js"), ("r", "src/a.ts", "./lib", "src/lib.vue")]


def test_constructors_calls_and_reads(spark):
    f = spark.createDataFrame([("r", "p.NewT", "NewT", "p", "", "*T"), ("r", "p.NewX", "NewX", "p", "", "error"), ("r", "p.T.NewT", "NewT", "p", "T", "T")], "repo string, id string, name string, package string, receiver string, result string")
    t = spark.createDataFrame([("r", "p.T", "T", "p")], "repo string, id string, name string, package string")
    assert rows(extract.constructors(f, t)) == [("r", "p.NewT", "p.T")]
    sites = spark.createDataFrame([("r", 1, "a", "d1"), ("r", 2, "b", "d1"), ("r", 3, "a", "d9")], "repo string, ord bigint, src string, decl string")
    decl = spark.createDataFrame([("r", 2, "d1", "c"), ("r", 1, "d1", "b")], "repo string, ord bigint, decl string, id string")
    assert rows(extract.resolve_calls(sites, decl)) == [("r", 1, "a", "b")]
    reads = spark.createDataFrame([("r", "f", "user", "name", False), ("r", "f", "user", "save", True), ("r", "f", "user", "name", False), ("r", "f", "user", "age", False)], "repo string, file string, object string, prop string, is_callee boolean")
    assert rows(extract.property_reads(reads)) == [("r", "user", ["age", "name"], "f")]


def test_pdg_first_holds(spark):
    p = spark.createDataFrame([("r", 2, "f", 9, 1), ("r", 1, "f", 3, 1)], "repo string, ord bigint, id string, blocks int, data_edges int")
    assert rows(taint.pdg_of(p, p), "id", "blocks") == [("f", 3)]
    assert graph(spark, {}, []).nodes.count() == 0
