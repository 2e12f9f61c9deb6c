from weftline.llm.functions_docs import comment_lines, describes, documented, functions, pairs

GO = """// Package p.
package p

// Old text that says a great deal about nothing.

func Blank() {}

// Open reads the whole ledger and returns every row.
func Open(a map[string]interface{}, f func(int) error) (x interface{}, err error) {
	s := "func Fake() { // no"
	r := '{'
	return `
// Raw text that looks like code to a careless reader.
func Inside() {
}
`, nil
}

/* Walks the tree
   until nothing is left below. */
func (t *Tree[K]) Walk[T any](
	a int,
) bool {
	visit(func() { return })
	return true
}

// Declared elsewhere in assembly with a long description.
func noBody(x int) int

/*
// Hidden removes everything that was here before.
func Hidden() {}
*/
type T struct { F func() }

//go:noinline
//nolint:errcheck
func tools() {}

// Close close.
func Close() {}

//Reports how many rows were
//dropped by the last run.
//go:generate thing
func Rows() struct{ n int } { return struct{ n int }{1} }
x() // Trailing remarks are no comment of the next function.
func After() {}
"""

JS = """import x from "y";
/** Adds two numbers and tells the caller about overflow. */
export async function add<T extends {a: number}>(a: T, b = {c: ")"}): Promise<{ n: number }> {
  const re = /function fake\\(\\) { [/"'`] /g;
  const t = `function no() { ${ {a: 1}.a + `}` } `;
  // Inner helper that doubles whatever it is given.
  function inner(q) { return q / 2 / 1; }
  /* Keeps the last five values for the report. */
  const held = async (v: number): Promise<void> => {
    if (v) { call(function () { return 1; }); }
  };
  return inner(a);
}

// Decides whether the pallet may leave the yard today.
@Decorated({ a: 1 })
export class Yard extends Base<{ x: 1 }> {
  static count = 0;

  /**
   * Sends one pallet and waits for its receipt.
   * @returns nothing
   */
  private async send(p: string[], q: Record<string, number>): Promise<boolean> {
    for (const x of p) { send(x); }
    if (p) { return true; }
  }

  // Only an overload without any body at all here.
  abstract other(a: number): void;

  /** @deprecated @internal words words words words */
  get value() { return this.v; }
}

export interface Shape {
  /** Must not be taken for a method with a body. */
  draw(a: number): void;
}

const api = {
  // Turns the raw answer into rows for clients.
  rows: (a, b) => {
    return a;
  },
  // Gives the number of rows that were read.
  count(a) { return { a() { return 1; } }; },
  /* eslint-disable-next-line no-console, no-unused-vars */
  quiet: function () { },
  plain: 5,
};

/** Runs whenever the lease changes hands in the system. */
register("lease", () => { go(1); });

// Squares a number without any loss of precision.
const square = (n) => n * n;

let other = function () { return 1 };

/** gap to the function */

export default function main() { }
"""


def found(file, text, lang=None):
    return [(line, name) for line, name, _, _, said in functions(file, lang, text) if describes(said, name)]


def test_go():
    assert [n for _, n, *_ in functions("a.go", None, GO)] == ["Blank", "Open", "Walk", "tools", "Close", "Rows", "After"]
    assert found("a.go", GO) == [(9, "Open"), (21, "Walk"), (47, "Rows")]
    walk = next(f for f in functions("a.go", None, GO) if f[1] == "Walk")
    assert walk[2].startswith("func (t *Tree[K]) Walk") and walk[2].endswith("return true\n}")


def test_script():
    names = [n for _, n, *_ in functions("a.ts", None, JS)]
    assert names == ["add", "inner", "held", "send", "value", "rows", "count", "a", "quiet", "square", "main"]
    assert [n for _, n in found("a.ts", JS)] == ["add", "inner", "held", "send", "rows", "count", "square"]
    assert dict((n, line) for line, n in found("a.ts", JS))["add"] == 3


def test_line_ends_and_marks_do_not_matter():
    want = found("a.ts", JS)
    for text in (JS.replace("\n", "\r\n"), JS.replace("\n", "\r"), "\ufeff" + JS):
        assert found("a.ts", text) == want
    assert found("x", GO, "go") == found("a.go", GO)


def test_vue():
    text = '<template>\n  <div @click="function a() {}">function b() { }</div>\n</template>\n<!-- <script>function c() {}</script> -->\n<script setup lang="ts">\n/** Tells the parent that the row has changed. */\nconst emit = () => {\n};\n</script>\n'
    assert found("a.vue", text) == [(7, "emit")]


def test_broken_and_empty():
    for text in (None, "", "func", "func (", "func A() {", "`", "/*", "const a = ", "class", "class A {", "}}}}", "{{{{" * 100, "const x = `${`", "a => {", "const f = async", "func F[", "export", "const f: ", '"', "/"):
        for file in ("a.go", "a.ts", "a.vue", "a", None):
            functions(file, None, text)
    assert functions("a.py", "python", "def f(): pass") == []


def test_long_file():
    text = "package p\n" + "// Reads one of the many rows.\nfunc F() {\n\tx(1)\n}\n" * 20_000
    assert len(found("a.go", text)) == 20_000


def test_words():
    assert describes("loads one two three", "load") and not describes("load ledger load ledger now", "loadLedger")
    assert not describes("a b c", "f") and describes("它会读取", "f")
    assert comment_lines("/**\n * a\n */") == ["", "a", ""] and comment_lines("// a\n// b") == ["a", "b"]


def test_operator(spark):
    rows = [("r", "a.go", "go", GO), ("r", "a.go", "go", GO), ("r", "b.ts", None, JS), (None, None, None, None), ("r", "c.go", "go", None)]
    df = spark.createDataFrame(rows, "repo string, file string, lang string, content string").selectExpr("*", "1 AS line", "'x' AS code", "2 AS name")
    got = pairs(df)
    assert got.count() == 10 and documented(df).count() == 13
    assert got.where("name = 'Open'").first().description == "Open reads the whole ledger and returns every row."
    assert pairs(df.limit(0)).count() == 0


def test_hostile_files_take_linear_time():
    import time

    for text in ("const f: " * 10_000, "{" * 50_000, "a<b<c<" * 20_000, "const a = " + "x => " * 20_000 + "1;", "`${`" * 5_000, "class A { m(): " + "A|" * 20_000 + " }", "f({a(){" * 6_000, "/" * 60_001):
        for file in ("a.ts", "a.go"):
            began = time.time()
            functions(file, None, text)
            assert time.time() - began < 5, text[:10]


def test_types_of_any_length():
    wide = "{ " + " ".join(f"a{i}: string;" for i in range(900)) + " }"
    many = ", ".join(f"T{i}" for i in range(400))
    for text in (f"function f(): {wide} {{ return x; }}", f"const f = (): {wide} => {{ return x; }};", f"function f<{many}>(a) {{ return a; }}", f"const f: {' | '.join(f'T{i}' for i in range(1500))} = () => {{ }};"):
        assert [x[1] for x in functions("a.ts", None, text)] == ["f"], text[:40]


def test_types_of_modules():
    assert [x[1] for x in functions("a.ts", None, 'const h: import("m").T = () => {};\nfunction f(): import("m").T { return 1; }\n')] == ["h", "f"]
    assert [x[1] for x in functions("a.ts", None, "declare const h: A |\nimport x from 'y'\nfunction f() { }\n")] == ["f"]


def test_brackets_left_open_are_passed_over():
    text = "function f() { x" + "(" * 60 + " }\nfunction g() { }\n"
    assert [x[1] for x in functions("a.ts", None, text)] == ["f", "g"]


def test_types_across_lines_take_linear_time():
    import time

    for text in ("class A {\n" + "m: A|\n" * 20_000 + "}", "class A {\n" + "m(): A<\n" * 20_000 + "}", "{(" * 20_000 + ")" * 20_000 + "]}" * 20_000):
        began = time.time()
        functions("a.ts", None, text)
        assert time.time() - began < 5, text[:20]
