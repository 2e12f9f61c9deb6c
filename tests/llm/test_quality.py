import textwrap

import pytest

from weftline.llm.quality import form, odd_forms, statistics, text_quality

PROSE = "The merge step loads interface methods before the next run, but we would like to do better. If you want to rewrite them, you should first ask whether the graph store has seen them at all."
ITEMS = ["field names", "LoadLedger()", "shell/parse.go", "rebuild changed lines", "test helpers", "OpenBatch", "line ranges"]

LISTS = {
    "dashes": "\n".join("- " + x for x in ITEMS),
    "numbers": "\n".join(f"{i}) {x};" for i, x in enumerate(ITEMS, 1)),
    "brackets": "\n".join(f"({i}) {x}" for i, x in enumerate(ITEMS, 1)),
    "boxes": "\r\n".join("- [x] " + x for x in ITEMS),
    "bare": "\n".join(ITEMS),
    "inline": ", ".join(ITEMS),
    "paths": "\n".join(f"/shard/cache/file{i}.go" for i in range(9)),
    "versions": "\n".join(f"route-index v2.{i}.0" for i in range(9)),
    "spanish": "\n".join(["el grafo de llamadas", "la tabla de rutas", "los paquetes nuevos", "el índice", "las firmas vacías"] * 2),
    "nested": "\n".join("  " * (i % 3) + "- " + x for i, x in enumerate(ITEMS)),
    "headed": "### Added\n" + "\n".join("* " + x for x in ITEMS),
    "chinese": "\n".join("- " + x for x in ("旧的节点", "路由表", "符号缓存", "空的签名")),
}
TABLES = {
    "csv": "owner,depth,kind\n" + "\n".join(f"{i},0.{i},x" for i in range(9)),
    "tabs": "\n".join(f"a{i}\tb\t{i}" for i in range(9)),
    "semicolons": "\n".join(f"old snapshots;{i};stable" for i in range(9)),
    "pipes": "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | some words |" for i in range(9)),
    "bare pipes": "\n".join(f"a{i} | b | c" for i in range(9)),
    "grid": "+----+----+\n" + "\n".join(f"|a{i}  |b   |\n+----+----+" for i in range(9)),
    "aligned": "\n".join(f"{'a' * (i % 5 + 1):24}{'some words':24}{i}" for i in range(9)),
    "html": "<table>\n" + "\n".join(f"<tr><td>{i}</td><td>x</td></tr>" for i in range(9)) + "\n</table>",
    "latex": "\\begin{tabular}{ll}\n" + "\n".join(f"a{i} & b \\\\" for i in range(9)) + "\n\\end{tabular}",
}
JUNK = {
    "log": "\n".join(f"2025-01-0{i}T10:00:00Z WARN [ab] cache.load id=ff{i} ms={i}" for i in range(1, 9)),
    "base64": "NqIiCkSvOzN1nzxcaDm6opCpQkTwlmwe4C1n+zkbAhfZ9jXc8V6oBaMprB5D+nbSSAGiQdyKIhCgRc4B09RwW9lkFBx7WLqRW6tv" * 2,
    "base64 lines": "\n".join("Y0Kbw0rWz/Fl6vvyGS3iuFB13fKv7EAemvlMPRcm0mk7V2eGQx3mtn6r0FCnGml" + c for c in "abcdefgh"),
    "rule": "=" * 300,
    "again": "undefined" * 40,
    "sentence again": "It would be better if we could count them. " * 30,
    "letters": "ta lasdp z yadmgthnlrabv gcwax ekbhn lfbbiljnlitojory wkf x olofpicfw kqramvetm bfimfjtmzwtsranyyxnafugcumgc",
    "symbols": "{/>;'$.@):<@:~)*}~}.!@$&: _?$_.+];] .-`*'>=@;| $~`==  <!&+ '*;#*&(@[/=.'?)#|<~#''{_#<:-:|$?#.<#%]:`))+.?*`'/=?",
    "salad": "quarry graph JoinReport clock orchard YieldRoute OpenQuota courier dune SplitBatch cache DropLedger ticket form YieldDigest inlet",
    "mojibake": "Il faut dÃ¢Â\x80Â\x99abord relire les paquets importÃ\x83Â©s, car la table ne les voit pas aprÃ\x83Â¨s chaque fusion.",
    "hex": "\n".join(f"0000{i:04x}  9d 74 cc 9a 8e 29 da a0 b5 90 18 06 0a d3 ac dc" for i in range(9)),
    "minified": "!function t(ue,v1){return re&&ie(xe[38])||void 0};function xe(x1,ht){return j&&y(mt[6])||void 0};" * 2 + "function wt(p1){return p1&&ve(j1[3])}",
    "trace": "Traceback (most recent call last):\n" + "\n".join(f'  File "a{i}.py", line {i}, in f' for i in range(9)),
}
NO_CASE = {
    "prose": PROSE,
    "wrapped": PROSE.replace(", ", ",\n").replace(". ", ".\n"),
    "bare": "all of this is done after each merge because the order of the files is not stable\nearlier versions would rewrite duplicate routes at start-up and the result was incomplete",
    "questions": f"Q: {PROSE}\nA: {PROSE[::1]}",
    "with list": PROSE + "\n\n- changed lines\n- field names\n\n" + PROSE,
    "with code": PROSE + "\n\n```go\n\tlog(\"func Courier { %d\", 1)\n}\n```\n\n" + PROSE,
    "german": "Wenn man die neuen Pakete zählt, dann sieht man, dass der Aufrufgraph zu langsam ist. Wir haben lange geprüft, ob das auch dann stimmt.",
    "chinese": "这个问题的原因是类型解析器没有保存旧的节点，我们打算在以后的版本里改进它。对于大多数人来说，路由表已经够用了。",
    "short": "We found that the route table rewrites five of the file paths on every request",
    "none": None,
    "empty": "",
    "blank": " \n\t ",
}


@pytest.mark.parametrize("want,text", [*((None, x) for x in NO_CASE.values()), *(("list", x) for x in LISTS.values()), *(("table", x) for x in TABLES.values()), *(("junk", x) for x in JUNK.values())], ids=[*NO_CASE, *LISTS, *TABLES, *JUNK])
def test_forms(want, text):
    assert form(text) == want


THREE = "The merge step loads every table twice. Nobody in the yard has asked for such a report. We would like to see fewer of these rows!"
AGAIN = {
    "headed paragraphs": "# Ledger and Route\n\n" + "\n\n".join([THREE] * 10),
    "headed, one line": "Ledger and Route\n\n" + " ".join([THREE] * 10),
    "wrapped anew": "Report\n\n" + "\n".join(textwrap.wrap(" ".join([THREE] * 10), 70)),
    "no ends": "Ledger and Route\n\n" + "the merge step loads every table twice and then asks nobody in the yard for such a report " * 10,
    "long": "# Route\n\n" + "\n\n".join([" ".join(f"The {w} step of the yard is {w} and has seen our {w}." for w in "ash birch cedar dune elm fir grove heath iris jade kelp larch moss nettle oak pine quince reed sage thyme ulm vine".split())] * 8),
    "among prose": PROSE + "\n\n" + "\n\n".join([THREE] * 10),
}


@pytest.mark.parametrize("text", AGAIN.values(), ids=[*AGAIN])
def test_the_same_over_and_over(text):
    assert form(text) == "junk"


def test_said_twice_is_no_repetition():
    assert form(f"# Route\n\n{THREE}\n\n{PROSE}\n\n{THREE}") is None


def test_statistics():
    s = statistics("One two.\nOne two.\n\n- x y z\n\n- x y z")
    assert s["n_words"] == 10 and s["dup_line_share"] == 0.5 and s["dup_paragraph_share"] == pytest.approx(1 / 3) and s["line_end_share"] == 0.5 and s["mark_share"] == 0.5
    assert s["top_2gram_share"] == pytest.approx(12 / 18)
    assert statistics("the cat and the dog")["common_share"] == pytest.approx(0.6)
    for text in (None, "", " \n"):
        assert all(v == 0 for k, v in statistics(text).items() if k != "n_chars")
    assert statistics("x" * 1_000_000)["n_words"] == 1


def test_very_long():
    assert form(PROSE * 3 + "\n" + "a, b, c, " * 50_000) is not None
    assert form("\n".join(f"- {ITEMS[i % 7]} {i * i % 9973}" for i in range(20_000))) == "list"
    assert form(("x" * 50 + "/") * 20_000) == "junk"


def test_operator(spark):
    rows = [(1, PROSE), (2, LISTS["dashes"]), (3, None), (4, ""), (5, JUNK["log"]), (5, JUNK["log"]), (None, TABLES["csv"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS form", "1 AS n_chars")
    assert sorted((r.doc_id or 0, r.form) for r in odd_forms(df).collect()) == [(0, "table"), (2, "list"), (5, "junk"), (5, "junk")]
    assert text_quality(df).count() == 7 and odd_forms(df.limit(0)).count() == 0


def test_hostile_texts_take_linear_time():
    import time

    for text in ("1.2.3.4." * 40_000, "- " * 100_000, "| a " * 60_000, "a;b" * 60_000, "(" * 200_000, "\t" * 100_000 + "x", "&\\\\" * 50_000):
        began = time.time()
        form(text), statistics(text)
        assert time.time() - began < 5, text[:10]
