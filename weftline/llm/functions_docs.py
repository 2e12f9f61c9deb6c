"""Problem 5: functions paired with their documentation.

The core's lexer (`functions.code`), a state machine that knows strings and comments, finds the functions and where their braces match. A comment belongs to a function if
it ends on the line right above the declaration. Files are independent, so the operator is one mapInArrow without a shuffle but that for repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame

from weftline.functions.code import GO, MARKUP, SCRIPT, SCRIPTS, Tokens, go_functions, js_functions, lex_js

LEAST_WORDS = 4

_TAG = re.compile(r"^\s*(?:\{?@|\\[a-z]+\b)")
# How notes to compilers, linters, formatters and coverage tools begin.
_TOOL = re.compile(
    r"^\s*(?:go:\w|\+build\b|line\s+\S+:\d|nolint\b|lint:|export\s+\w+$|code generated .*do not edit|eslint-|eslint\s+[\w/-]+:|tslint:|jshint\s+\w+:|jslint\s|jscs:|globals?\s+[\w$]+(?:\s*:\s*\w+)?(?:\s*,\s*[\w$]+(?:\s*:\s*\w+)?)+$"
    r"|prettier-ignore|biome-ignore|oxlint-|deno-(?:lint|fmt)-|ts-(?:ignore|expect-error|nocheck|check)\b|istanbul\s+ignore|c8\s+ignore|v8\s+ignore|nyc\s+ignore|webpack\w*:|vite-ignore|#?\s*__PURE__|#\s*source|noinspection\b|#(?:end)?region|stylelint-|cspell:|spell-?checker:|sonar:|nosonar\b|codacy:|coverage:|swagger:|#?nosec\b|gosec:|revive:|exhaustive:|staticcheck:|errcheck:|gocyclo:|golangci|language=|<reference\b|<amd-|vim?:\s*\w+=|-\*-)",
    re.I,
)
_WORD = re.compile(r"\p{Han}|\p{Hiragana}|\p{Katakana}|[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")
_CAMEL = re.compile(r"\p{Lu}+(?!\p{Ll})|\p{Lu}?[\p{Ll}\p{Lo}]+|\p{N}+")


_SLASHES, _ENDS, _MARKUP, _STARS = re.compile(r"^\s*/{2,}[!]?"), re.compile(r"^/\*+!?|\*+/$"), re.compile(r"^<!--|-->$"), re.compile(r"^\s*\*+(?!/)")
_LINE_END = re.compile(r"\r\n?")


def comment_lines(comment: str) -> list[str]:
    """The lines of a comment's text without its marks."""
    if comment.startswith("//"):
        return [_SLASHES.sub("", x).strip() for x in comment.split("\n")]
    body = _ENDS.sub("", comment) if comment.startswith("/*") else _MARKUP.sub("", comment)
    return [_STARS.sub("", x).strip() for x in body.split("\n")]


def description(comment: str) -> str:
    """The comment's text without marks, tags and notes to tools. A tag ends with its line."""
    return " ".join(x for x in comment_lines(comment) if x and not _TAG.match(x) and not _TOOL.match(x))


def describes(text: str, name: str, least: int = LEAST_WORDS) -> bool:
    """At least `least` different words remain besides those of the function's own name. Han and kana characters count as words each."""
    if not text:
        return False
    own = {x.lower() for x in _CAMEL.findall(name)} | {name.lower()} | {x.lower() for x in _WORD.findall(name)}
    return len({x.lower() for x in _WORD.findall(text)} - own) >= least


def _comment_above(text: str, t: Tokens, ends: dict[int, int], lines: list[int], line_of, start: int) -> str | None:
    """The comment that ends on the line right above `start`. `ends`: line to the comment that ends there, if it began its line."""
    line = line_of(start)
    if text[lines[line] : start].strip("﻿ \t\r"):
        return None
    k = ends.get(line - 1)
    if k is None:
        return None
    s, e = t.comments[k]
    if not text.startswith("//", s):
        return text[s:e]
    first = k
    while first and (line_of(t.comments[first][0]) - 1) in ends and ends[line_of(t.comments[first][0]) - 1] == first - 1 and text.startswith("//", t.comments[first - 1][0]):
        first -= 1
    return text[t.comments[first][0] : e]


def functions(file: str | None, lang: str | None, content: str | None) -> list[tuple[int, str, str, str, str]]:
    """(line, name, code, comment, description) of each function with a body in the file, in order; comment '' if there is none.

    The language follows from the file's extension, else from lang. CR, LF and CRLF all end lines. Null or empty content, and other
    languages, give an empty list. Broken code gives what can be matched.
    """
    if not content:
        return []
    text = _LINE_END.sub("\n", content) if "\r" in content else content
    name, said = (file or "").lower(), (lang or "").lower()
    go = name.endswith(GO) or ("." not in name.rsplit("/", 1)[-1] and said == "go")
    t = Tokens()
    if go:
        found = list(go_functions(text))
        t = found[0][4] if found else t
    elif name.endswith(MARKUP) or said in ("vue", "svelte"):
        for m in SCRIPTS.finditer(re.sub(r"<!--.*?(?:-->|\Z)", lambda x: re.sub(r"[^\n]", " ", x[0]), text, flags=re.S)):
            lex_js(text, m.start(1), m.end(1), t)
        found = list(js_functions(text, t))
    elif name.endswith(SCRIPT) or said in ("typescript", "javascript", "ts", "js", "tsx", "jsx"):
        lex_js(text, 0, len(text), t)
        found = list(js_functions(text, t))
    else:
        return []
    if not found:
        return []
    from bisect import bisect_right

    lines = [0]
    while (at := text.find("\n", lines[-1])) >= 0:
        lines.append(at + 1)
    line_of = lambda at: bisect_right(lines, at) - 1
    ends: dict[int, int] = {}
    for k, (s, e) in enumerate(t.comments):
        ln = line_of(s)
        if not text[lines[ln] : s].strip("﻿ \t\r"):
            stop = text.find("\n", e)
            if not text[e : len(text) if stop < 0 else stop].strip():
                ends[line_of(max(s, e - 1))] = k
    out = []
    for start, fn, _, end, _ in sorted(found, key=lambda f: f[0]):
        comment = _comment_above(text, t, ends, lines, line_of, start) or ""
        out.append((line_of(start) + 1, fn, text[start:end], comment, description(comment)))
    return out


def _found(sources: DataFrame, least: int, texts: bool) -> DataFrame:
    """(repo, file, line[, name, code, description]) of each function whose comment describes it."""
    files = sources.select("repo", "file", "lang", "content").where("content <> ''")
    cols = ["repo", "file", "line", *["name", "code", "description"] * texts]
    types = [pa.int32() if c == "line" else pa.string() for c in cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                rows: list[tuple] = []
                for repo, file, lang, content in zip(*(c.to_pylist() for c in b.slice(s, 256).columns), strict=True):
                    rows += [(repo, file, line, name, code, said)[: len(cols)] for line, name, code, _, said in functions(file, lang, content) if describes(said, name, least)]
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows, strict=True) if rows else [[]] * len(cols), types, strict=True)], cols)

    return files.mapInArrow(run, ", ".join(f"{c} {'int' if c == 'line' else 'string'}" for c in cols))


def documented(sources: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(repo, file, line, name, code, description) of each function whose comment describes it, as often as its file is delivered.

    Columns besides repo, file, lang and content are not read. Nothing is shuffled.
    """
    return _found(sources, least, True)


def places(sources: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(repo, file, line) alone: neither code nor description leave the Python worker."""
    return _found(sources, least, False)


def pairs(sources: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """documented, once for repeated rows."""
    return documented(sources, least).distinct()
