from helpers import rows
from weftline.operators import frontend

GO = """// Package srv serves.
package srv

import (
	"fmt"
	h "net/http"
)

type Store interface {
	Get(key string, n int) (string, error)
	Close() error
}

type User struct {
	Name, Nick string `json:"name"`
	Age        int    `json:"-"`
	hidden     int
}

// func NotCode() {}
func NewUser(name string) *User { return &User{} }

func (u *User) Get(k string, m int) (string, error) {
	fmt.Println("func AlsoNot() {")
	return u.help(k), nil
}
func (u *User) help(k string) string { return trim(k) }
func (u *User) Close() error         { return nil }
func trim(k string) string {
	h.HandleFunc("/x/{id}", trim)
	return k
}
"""
UTIL = "export function a(x) { return x }\nexport const b = (y) => a(y)\n"
KIT = "import { a as go, b } from './util'\nimport z from 'lib'\nexport class K {\n  m(user) { this.q(user.name); return go(user.mail) }\n  q(n) { return b(n) + z(n) }\n}\n"
VUE = "<template><p/></template>\n<script>\nimport { K } from '../web/kit'\nexport default { methods: { show() { return this.row.id } } }\n</script>\n"


def sources(spark, *files):
    return spark.createDataFrame([("r", f"/srv/index/r/{f}", None, t) for f, t in files], "repo string, file string, lang string, content string").selectExpr("*", "1 AS line", "'x' AS kind")


def test_graph_of_sources(spark):
    g = frontend.graph_of(sources(spark, ("pkg/srv/a.go", GO), ("pkg/srv/a.go", GO), ("web/util.ts", UTIL), ("web/kit.ts", KIT), ("ui/Show.vue", VUE), ("none.go", None), ("empty.ts", ""), ("b_test.go", GO)))
    kinds = {r.id: (r.kind, r.line) for r in g.nodes.collect()}
    assert kinds["pkg/srv"][0] == "package" and kinds["pkg/srv.Store"] == ("interface", 9) and kinds["pkg/srv.User"] == ("type", 14) and kinds["pkg/srv.User.Get"] == ("method", 23)
    assert kinds["web/kit.ts#K"] == ("class", 3) and kinds["web/kit.ts#K.m"] == ("method", 4) and kinds["web/util.ts#b"] == ("func", 2) and kinds["ui/Show.vue"][0] == "component"
    assert not any("Not" in i for i in kinds)
    assert g.nodes.where("id = 'pkg/srv.User'").first().fields == ["name", "name"]
    e = {(r.src, r.dst, r.kind) for r in g.edges.collect()}
    for want in [
        ("pkg/srv", "pkg/srv.User", "defines"),
        ("pkg/srv.User", "pkg/srv.User.Get", "defines"),
        ("pkg/srv", "net/http", "imports"),
        ("pkg/srv.User", "pkg/srv.Store", "implements"),
        ("pkg/srv.NewUser", "pkg/srv.User", "constructs"),
        ("pkg/srv.User.Get", "pkg/srv.User.help", "calls"),
        ("pkg/srv.User.Get", "fmt.Println", "calls"),
        ("pkg/srv.User.help", "pkg/srv.trim", "calls"),
        ("web/kit.ts", "web/util.ts", "imports"),
        ("ui/Show.vue", "web/kit.ts", "imports"),
        ("web/kit.ts#K.m", "web/util.ts#a", "calls"),
        ("web/kit.ts#K.m", "web/kit.ts#K.q", "calls"),
        ("web/kit.ts#K.q", "web/util.ts#b", "calls"),
        ("web/util.ts#b", "web/util.ts#a", "calls"),
    ]:
        assert want in e, (want, sorted(x for x in e if x[0] == want[0]))
    assert not any(dst == "lib" for _, dst, _ in e)  # of files only relative imports lead anywhere
    assert rows(g.routes, "method", "path", "handler") == [("ANY", "/x/{id}", "pkg/srv.trim")]
    assert ("user", ["mail", "name"]) in rows(g.shapes, "object", "props")


def test_hostile_and_empty(spark):
    hostile = "package p\nfunc F(" + "(" * 5000 + "\ntype T struct {\n" + "import (\n\"x\n" + "class { import from ' }" * 200
    g = frontend.graph_of(sources(spark, ("a.go", hostile), ("a.ts", hostile), ("a.vue", hostile)))
    assert g.nodes.count() >= 3
    assert frontend.graph_of(sources(spark, ("a.go", "")).limit(0)).edges.count() == 0
