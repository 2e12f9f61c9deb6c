"""A syntactic front end: symbols, edges, routes and access shapes read off source files, without a compiler.

Files are parsed one by one (one mapInArrow, whole files) into raw tables: declarations, imports, method sets, calls, fields, property reads. What follows from
them across files is joins (`extract`): implements edges, constructors, routes, relative imports, the declaration that a call means. What takes a type checker is left out: calls
through values whose type is not written down, and types of other packages. Ids are those of the graph: `package.Name` and `package.Type.Method` for Go,
`file#Name` and `file#Class.method` for the others, with files relative to their repo's folder.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.code import GO, MARKUP, SCRIPT, SCRIPTS, Tokens, go_functions, js_functions, lex_go, lex_js, pairs
from weftline.operators import extract
from weftline.operators.graph import Graph
from weftline.sources.scratch import keep

RAW = "repo string, file string, ord bigint, record string, id string, kind string, name string, package string, line int, signature string, a string, b string, args array<string>"
_COLUMNS = [c.split()[0] for c in RAW.split(", ")]
_NOT_GO = {"if", "for", "switch", "return", "func", "go", "defer", "select", "case", "range", "map", "chan", "struct", "interface"}
_NOT_SCRIPT = {"if", "for", "while", "switch", "return", "catch", "function", "typeof", "await", "new", "super", "import", "with", "case", "delete", "void"}


def _types(t: Tokens, text: str, close: dict[int, int], lo: int, hi: int) -> list[str]:
    """The types of a Go parameter or result list between two brackets, without the names."""
    items: list[list[int]] = [[]]
    j = lo
    while j < hi:
        if t.text[j] == "," and t.kind[j] == "p":
            items.append([])
        elif t.kind[j] != "n":
            end = close.get(j, j) if t.kind[j] == "p" and t.text[j] in "([{" else j
            items[-1] += range(j, min(end, hi - 1) + 1)
            j = end
        j += 1
    items = [x for x in items if x]
    said = lambda ks: "".join(text[t.at[k] : t.end[k]] for k in ks)
    named = any(len(x) > 1 and t.kind[x[0]] == "w" and not (t.kind[x[1]] == "p" and t.text[x[1]] in ".[") and t.text[x[0]] not in ("map", "chan", "func", "struct", "interface") for x in items)
    if not named:
        return [said(x) for x in items]
    out, last = [], ""
    for x in reversed(items):
        last = said(x[1:]) if len(x) > 1 else last
        out.append(last)
    return out[::-1]


def _literal(text: str, t: Tokens, j: int) -> str | None:
    s = text[t.at[j] : t.end[j]]
    return s[1:-1] if t.kind[j] == "s" and len(s) > 1 and s[0] in "\"'`" and s[-1] == s[0] else None


def _args(text: str, t: Tokens, close: dict[int, int], j: int) -> list[str]:
    """The arguments, as written, of a call whose bracket opens at j."""
    out, lo, k, end = [], j + 1, j + 1, close[j]
    while k < end:
        if t.kind[k] == "p" and t.text[k] == ",":
            out.append(text[t.at[lo] : t.end[k - 1]])
            lo = k + 1
        k = close.get(k, k) + 1 if t.kind[k] == "p" and t.text[k] in "([{" else k + 1
    if lo < end:
        out.append(text[t.at[lo] : t.end[end - 1]].strip())
    return out


def _go(text: str, file: str) -> Iterator[dict]:
    t = lex_go(text)
    close = pairs(t)
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda j: bisect_right(lines, t.at[j])
    n = len(t.kind)
    code = [j for j in range(n) if t.kind[j] != "n"]
    where = {t.at[j]: j for j in code}
    pack = next((t.text[code[k + 1]] for k in range(len(code) - 1) if t.text[code[k]] == "package"), "main")
    package = file.rsplit("/", 1)[0] if "/" in file else pack
    yield {"record": "node", "id": package, "kind": "package", "name": pack, "package": package, "line": 0, "signature": ""}
    imported: dict[str, str] = {}

    def bring(j: int) -> Iterator[dict]:
        path = _literal(text, t, j)
        if path:
            alias = t.text[j - 1] if j and t.kind[j - 1] == "w" and t.text[j - 1] != "import" else path.rsplit("/", 1)[-1]
            imported[alias] = path
            yield {"record": "import", "id": package, "kind": "path", "a": path}

    def fields(owner: str, lo: int, hi: int) -> Iterator[dict]:
        j, pos = lo, 0
        while j < hi:
            first = j
            while j < hi and t.kind[j] != "n" and t.text[j] != ";":
                j = close.get(j, j) + 1 if t.kind[j] == "p" and t.text[j] in "([{" else j + 1
            own = [k for k in range(first, min(j, hi))]
            if own and t.kind[own[0]] == "w":
                tag = _literal(text, t, own[-1]) if t.kind[own[-1]] == "s" else None
                names = [own[0]]
                while len(own) > 2 * len(names) and t.text[own[2 * len(names) - 1]] == "," and t.kind[own[2 * len(names)]] == "w":
                    names.append(own[2 * len(names)])
                if len(own) - (tag is not None) > 1:  # else embedded
                    for k in names:
                        yield {"record": "field", "id": owner, "ord": pos, "name": t.text[k], "a": tag or ""}
                        pos += 1
            j += 1

    def methods(owner: str, lo: int, hi: int) -> Iterator[dict]:
        j = lo
        while j < hi:
            if t.kind[j] == "w" and j + 1 < hi and t.text[j + 1] == "(" and (j == lo or t.kind[j - 1] == "n" or t.text[j - 1] == ";"):
                yield {"record": "method", "id": owner, "kind": "interface", "signature": signature(j)}
            j = close.get(j, j) + 1 if t.kind[j] == "p" and t.text[j] in "([{" else j + 1

    def signature(j: int) -> str:
        """Name and types of the function whose name is at j."""
        p = close[j + 1] if j + 1 in close else j + 1
        params = _types(t, text, close, j + 2, p)
        k = p + 1
        if k < n and t.text[k] == "(" and k in close:
            results = _types(t, text, close, k + 1, close[k])
        else:
            end = k
            while end < n and t.kind[end] != "n" and t.text[end] not in ("{", ";"):
                end += 1
            results = ["".join(text[t.at[x] : t.end[x]] for x in range(k, end))] if end > k else []
        return f"{t.text[j]}({','.join(params)})({','.join(results)})"

    for k, j in enumerate(code):
        x = t.text[j]
        fresh = k == 0 or t.kind[j - 1] == "n" or t.text[j - 1] == ";"
        if t.kind[j] != "w" or not fresh:
            continue
        if x == "import" and k + 1 < len(code):
            nxt = code[k + 1]
            if t.text[nxt] == "(":
                for q in range(nxt + 1, close[nxt]):
                    yield from bring(q)
            else:
                yield from bring(nxt if t.kind[nxt] == "s" else code[min(k + 2, len(code) - 1)])
        elif x == "type" and k + 2 < len(code):
            group = t.text[code[k + 1]] == "("
            q, stop = (code[k + 1] + 1, close[code[k + 1]]) if group else (code[k + 1], n)
            while q < stop:
                if t.kind[q] == "w" and (not group or t.kind[q - 1] in "np"):
                    name, owner, r = t.text[q], f"{package}.{t.text[q]}", q + 1
                    generic = r < n and t.text[r] == "["
                    r = close[r] + 1 if generic and r in close else r
                    what = t.text[r] if r < n else ""
                    yield {"record": "node", "id": owner, "kind": "interface" if what == "interface" else "type", "name": name, "package": package, "line": line(q), "signature": "", "a": "generic" if generic else ""}
                    yield {"record": "defines", "a": package, "b": owner}
                    if what in ("struct", "interface") and r + 1 < n and t.text[r + 1] == "{" and r + 1 in close:
                        yield from (fields if what == "struct" else methods)(owner, r + 2, close[r + 1])
                        r = close[r + 1]
                    while r < stop and t.kind[r] != "n":
                        r += 1
                    q = r
                if not group:
                    break
                q += 1
    order = 0
    for start, name, body, end, _ in go_functions(text):
        j = where[start]
        receiver, variable, k = "", "", j + 1
        if t.text[k] == "(":
            own = [q for q in range(k + 1, close[k]) if t.kind[q] == "w"]
            receiver = t.text[own[1]] if len(own) > 1 and t.text[own[0] + 1] != "[" else t.text[own[0]] if own else ""
            variable = t.text[own[0]] if len(own) > 1 else ""
            k = close[k] + 1
        own_id = f"{package}.{receiver}.{name}" if receiver else f"{package}.{name}"
        sig = signature(k) if k + 1 < n and t.text[k + 1] == "(" else name
        first = sig[sig.rindex(")(") + 2 : -1].split(",")[0] if ")(" in sig else ""
        yield {"record": "node", "id": own_id, "kind": "method" if receiver else "func", "name": name, "package": package, "line": line(j), "signature": re.sub(r"\s+", " ", text[start:body]).strip(), "a": receiver, "b": first}
        yield {"record": "defines", "a": f"{package}.{receiver}" if receiver else package, "b": own_id}
        if receiver:
            yield {"record": "method", "id": f"{package}.{receiver}", "kind": "type", "signature": sig}
        j = where.get(body, n)
        while j < n and t.at[j] < end:
            if t.kind[j] == "w" and j + 1 < n and t.text[j + 1] == "(" and t.kind[j + 1] == "p" and j + 1 in close and t.text[j] not in _NOT_GO:
                callee, base = t.text[j], t.text[j - 2] if t.text[j - 1] == "." and t.kind[j - 2] == "w" else ""
                dotted = t.text[j - 1] == "."
                to = f"{package}.{callee}" if not dotted else f"{imported[base]}.{callee}" if base in imported else f"{package}.{receiver}.{callee}" if base and base == variable else ""
                yield {"record": "call", "ord": order, "id": own_id, "name": callee, "a": to, "kind": "imported" if dotted and base in imported else "", "package": package, "args": _args(text, t, close, j + 1) if callee in extract.ROUTE_METHODS else None}
                order += 1
            j += 1


def _script(text: str, file: str, markup: bool) -> Iterator[dict]:
    t = Tokens()
    if markup:
        for m in SCRIPTS.finditer(re.sub(r"<!--.*?(?:-->|\Z)", lambda x: re.sub(r"[^\n]", " ", x[0]), text, flags=re.S)):
            lex_js(text, m.start(1), m.end(1), t)
    else:
        lex_js(text, 0, len(text), t)
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda at: bisect_right(lines, at)
    yield {"record": "node", "id": file, "kind": "component" if markup else "file", "name": file.rsplit("/", 1)[-1], "package": file, "line": 0, "signature": ""}
    code = [j for j in range(len(t.kind)) if t.kind[j] != "n"]
    c = Tokens()
    for name in ("kind", "text", "at", "end"):
        setattr(c, name, [getattr(t, name)[j] for j in code])
    close, n = pairs(c), len(code)
    word, kind = c.text, c.kind
    classes = []
    brought: dict[str, tuple[str, str]] = {}  # name here -> (specifier, name there)
    for j in range(n):
        if kind[j] == "w" and word[j] == "class" and j + 1 < n and kind[j + 1] == "w" and (j == 0 or word[j - 1] != "."):
            k = j + 2
            while k < n and word[k] != "{":
                k += 1
            if k in close:
                classes.append((c.at[k], c.at[close[k]] if close[k] < n else len(text), word[j + 1]))
                yield {"record": "node", "id": f"{file}#{word[j + 1]}", "kind": "class", "name": word[j + 1], "package": file, "line": line(c.at[j]), "signature": ""}
                yield {"record": "defines", "a": file, "b": f"{file}#{word[j + 1]}"}
        if kind[j] == "w" and word[j] in ("import", "export") and (j == 0 or word[j - 1] != "."):
            k, names = j + 1, []
            while k < min(n, j + 400) and kind[k] != "s" and word[k] not in (";", "=", "(", "function", "class", "const"):
                if kind[k] == "w" and word[k] not in ("from", "type", "as"):
                    names.append((word[k], word[k - 2] if word[k - 1] == "as" else word[k] if "{" in word[j:k] else "default"))
                k += 1
            if k < n and kind[k] == "s" and (spec := _literal(text, c, k)):
                yield {"record": "import", "id": file, "a": spec}
                if word[j] == "import":
                    brought |= {here: (spec, there) for here, there in names}
    functions = sorted(js_functions(text, t), key=lambda f: f[0])
    spans = []
    for start, name, body, end, _ in functions:
        if not name:
            continue
        around = [x for x in classes if x[0] < start < x[1]]
        owner = f"{file}#{around[-1][2]}" if around else file
        own = f"{owner}.{name}" if around else f"{file}#{name}"
        spans.append((start, end, own))
        yield {"record": "node", "id": own, "kind": "method" if around else "func", "name": name, "package": file, "line": line(start), "signature": re.sub(r"\s+", " ", text[start:body]).strip()}
        yield {"record": "defines", "a": owner, "b": own}
    at, open_ = 0, []
    for order, j in enumerate(range(n)):
        while at < len(spans) and spans[at][0] <= c.at[j]:
            open_.append(spans[at])
            at += 1
        while open_ and open_[-1][1] <= c.at[j]:
            open_.pop()
        own = open_[-1][2] if open_ else file
        called = j + 1 < n and word[j + 1] == "(" and kind[j + 1] == "p"
        if kind[j] == "w" and called and word[j] not in _NOT_SCRIPT and word[j - 1 : j] != ["function"] and not any(s[2].endswith(("#" + word[j], "." + word[j])) and s[0] <= c.at[j] < s[0] + len(s[2]) + 40 and text[s[0] : c.at[j]].count("(") == 0 for s in open_[-1:]):
            if j and word[j - 1] == ".":
                owner = next((x[2] for x in reversed(classes) if x[0] < c.at[j] < x[1]), None) if word[j - 2] == "this" else None
                to = f"{file}#{owner}.{word[j]}" if owner else ""
                yield {"record": "call", "ord": order, "id": own, "name": word[j], "a": to, "package": file}
            else:
                spec, there = brought.get(word[j], ("", word[j]))
                yield {"record": "call", "ord": order, "id": own, "name": there, "a": "" if spec else f"{file}#{word[j]}", "b": spec, "package": file}
        if kind[j] == "w" and j >= 2 and word[j - 1] == "." and kind[j - 2] == "w" and word[j - 2] not in ("this", "import") and word[j - 3 : j - 2] != ["."]:
            yield {"record": "read", "a": word[j - 2], "b": word[j], "kind": "callee" if called else ""}


def raw(sources: DataFrame) -> DataFrame:
    """The raw records of each file, once for repeated rows. Files of other languages, and null contents, have none; a file without a language is known by its extension."""
    files = sources.select("repo", "file", "content").where("content IS NOT NULL AND file <> '' AND repo IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.list_(pa.string()) if c == "args" else pa.int64() if c == "ord" else pa.int32() if c == "line" else pa.string()) for c in _COLUMNS])
        for b in batches:
            for s in range(0, b.num_rows, 128):
                rows = []
                for repo, file, content in zip(*(c.to_pylist() for c in b.slice(s, 128).columns), strict=True):
                    text, low = re.sub(r"\r\n?", "\n", content), file.lower()
                    rel = file.split(f"/{repo}/", 1)[-1].lstrip("/")
                    if low.endswith(GO) and not low.endswith("_test.go"):
                        found = _go(text, rel)
                    elif low.endswith(SCRIPT) or low.endswith(MARKUP):
                        found = _script(text, rel, low.endswith(MARKUP))
                    else:
                        continue
                    rows += [{"repo": repo, "file": file} | x for x in found]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(run, RAW).distinct()


def graph_of(sources: DataFrame) -> Graph:
    """The graph that the files say: nodes, edges (defines, imports, calls, implements, constructs), routes and access shapes."""
    r = keep(raw(sources), "raw")
    of = lambda record: r.where(F.col("record") == record)
    fields = extract.struct_fields(of("field").select("repo", "id", F.col("ord").alias("pos"), "name", F.col("a").alias("tag")))
    first = F.min(F.struct("file", "line", "kind", "name", "package", "signature")).alias("n")  # a package has many files, a broken file may repeat a name
    nodes = of("node").groupBy("repo", "id").agg(first).select("repo", "id", "n.kind", "n.name", "n.package", F.when(F.col("n.kind") == "package", "").otherwise(F.col("n.file")).alias("file"), "n.line", "n.signature", F.lit("").alias("doc"))
    nodes = keep(nodes.join(fields, ["repo", "id"], "left").withColumn("fields", F.coalesce("fields", F.array().cast("array<string>"))), "nodes")
    known = nodes.select("repo", F.col("id").alias("decl"), "id", F.lit(0).alias("ord"))
    # imports: of packages by their path, of files by the relative path that fits
    brought = of("import").select("repo", F.col("id").alias("file"), F.col("a").alias("spec"), (F.col("kind") == "path").alias("by_path")).distinct()
    met = keep(extract.resolve_imports(brought, nodes.where("kind IN ('file', 'component')").select("repo", F.col("id").alias("file"))), "imports")
    imports = brought.join(met, ["repo", "file", "spec"], "left").where("target IS NOT NULL OR by_path").select("repo", F.col("file").alias("src"), F.coalesce("target", "spec").alias("dst"), F.lit("imports").alias("kind"))
    # calls: those that name their target, and those of names brought from another file
    calls = of("call").withColumn("n", F.xxhash64("file", "ord"))
    here = calls.where("a <> ''").select("repo", F.col("n").alias("ord"), F.col("id").alias("src"), F.col("a").alias("decl"))
    there = calls.where("b <> ''").withColumnsRenamed({"b": "spec"}).join(met.withColumnRenamed("file", "package"), ["repo", "package", "spec"]).select("repo", F.col("n").alias("ord"), F.col("id").alias("src"), F.concat_ws("#", "target", "name").alias("decl"))
    told = extract.resolve_calls(here.unionByName(there), known).select("repo", "src", "dst", F.lit("calls").alias("kind"))
    outside = calls.where("kind = 'imported'").select("repo", F.col("id").alias("src"), F.col("a").alias("dst"), F.lit("calls").alias("kind")).join(nodes.select("repo", F.col("id").alias("dst")), ["repo", "dst"], "left_anti")
    own = of("node").where("kind IN ('type', 'class') OR kind = 'interface'").select("repo", "id", (F.col("a") == "generic").alias("generic")).distinct()
    sets = of("method").select("repo", F.col("id").alias("owner"), (F.col("kind") == "interface").alias("is_interface"), "signature").join(own.withColumnRenamed("id", "owner"), ["repo", "owner"], "left")
    types = nodes.where("kind = 'type'").select("repo", "id", "name", "package")
    made = extract.constructors(of("node").where("kind = 'func'").select("repo", "id", "name", "package", F.col("a").alias("receiver"), F.col("b").alias("result")).where("receiver IS NOT NULL"), types)
    parts = [
        of("defines").select("repo", F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("defines").alias("kind")),
        imports,
        told,
        outside.select("repo", "src", "dst", "kind"),
        extract.implements(sets.withColumn("generic", F.coalesce("generic", F.lit(False)))).withColumn("kind", F.lit("implements")),
        made.withColumn("kind", F.lit("constructs")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    edges = every.where("src <> dst").select("repo", F.monotonically_increasing_id().alias("ord"), "src", "dst", "kind")
    funcs = nodes.where("kind IN ('func', 'method')").select("repo", "id", "name")
    routes = extract.routes(calls.where("args IS NOT NULL").select("repo", F.col("n").alias("ord"), "name", "args"), funcs)
    return Graph(nodes.select("repo", "id", "kind", "name", "package", "file", "line", "signature", "doc", "fields"), keep(edges, "edges"), routes, _shapes(r))


def _shapes(r: DataFrame) -> DataFrame:
    return extract.property_reads(r.where("record = 'read'").select("repo", "file", F.col("a").alias("object"), F.col("b").alias("prop"), (F.col("kind") == "callee").alias("is_callee")))


def shapes_of(sources: DataFrame) -> DataFrame:
    """(repo, object, props, file): the access shapes alone."""
    return _shapes(raw(sources))
