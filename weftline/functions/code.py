"""Tokens of Go and of JavaScript's family, and the functions they hold.

One pass of a state machine over each file knows strings, template literals, regular expressions and comments, so that code
inside them is not taken for code. A second pass over the tokens matches brackets: it finds where each function's body starts and
ends and what kind of braces (class, object literal, block) surround it. Everything is linear in the file's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import regex as re

# Extensions of the languages that are read.
GO = (".go",)
SCRIPT = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
MARKUP = (".vue", ".svelte")

_COMMENT = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z)"
_GO = re.compile(rf"(?P<c>{_COMMENT})|(?P<s>\"(?:[^\"\\\n]|\\.)*+\"?|`[^`]*+`?|'(?:[^'\\\n]|\\.)*+'?)|(?P<w>[\p{{L}}_][\p{{L}}\p{{N}}_]*+)|(?P<n>\n)|(?P<p>[{{}}()\[\].,;:*=<>])|(?P<o>[^\s\p{{L}}_{{}}()\[\].,;:*=<>\"'`/]++|/)")
_JS = re.compile(
    rf"(?P<c>{_COMMENT}|<!--.*?(?:-->|\Z))|(?P<s>\"(?:[^\"\\\n]|\\[\s\S])*+\"?|'(?:[^'\\\n]|\\[\s\S])*+'?)|(?P<t>`)|(?P<w>[\p{{L}}_$\#@][\p{{L}}\p{{N}}_$]*+)|(?P<n>\n)|(?P<a>=>)|(?P<p>[{{}}()\[\].,;:*=<>?/])|(?P<o>[^\s\p{{L}}_$\#@{{}}()\[\].,;:*=<>?\"'`/]++)",
    re.S,
)
_SPACE = re.compile(r"[^\S\n]+")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+(`|\$\{|\Z)", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/\w*")
SCRIPTS = re.compile(r"<script\b[^>]*>(.*?)(?:</script\s*>|\Z)", re.S | re.I)
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield"}
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_OPEN = {y: x for x, y in _CLOSE.items()}
_MODIFIERS = {"public", "private", "protected", "static", "async", "override", "readonly", "get", "set", "abstract", "declare", "accessor"}
_CONTROL = {"if", "for", "while", "switch", "catch", "with", "return", "function", "else", "do", "try", "new", "await", "typeof", "throw"}


class Tokens:
    """Kinds, texts and places of the code tokens of one file, and its comments as (start, end)."""

    def __init__(self) -> None:
        self.kind: list[str] = []
        self.text: list[str] = []
        self.at: list[int] = []
        self.end: list[int] = []
        self.comments: list[tuple[int, int]] = []

    def add(self, kind: str, text: str, at: int, end: int = 0) -> None:
        self.kind.append(kind)
        self.text.append(text)
        self.at.append(at)
        self.end.append(end)


def lex_go(text: str) -> Tokens:
    out = Tokens()
    kinds, texts, at, ends = out.kind.append, out.text.append, out.at.append, out.end.append
    for m in _GO.finditer(text):
        kind = m.lastgroup
        lo, hi = m.span()
        if kind == "c":
            out.comments.append((lo, hi))
            continue
        kinds(kind)
        texts(m[0] if kind == "w" or kind == "p" else "")
        at(lo)
        ends(hi)
    return out


def lex_js(text: str, start: int, end: int, out: Tokens) -> None:
    at, depth, templates = start, 0, []  # templates: brace depths at which a template literal goes on
    kinds, texts, places, ends, match = out.kind.append, out.text.append, out.at.append, out.end.append, _JS.match
    while at < end:
        m = match(text, at, end)
        if m is None:  # white space, or what no rule takes
            m = _SPACE.match(text, at, end)
            at = m.end() if m else at + 1
            continue
        kind, word, here = m.lastgroup, m[0], at
        at = m.end()
        if kind == "c":
            out.comments.append(m.span())
            continue
        if word == "/":
            k = len(out.kind) - 1
            while k >= 0 and out.kind[k] == "n":
                k -= 1
            value = k >= 0 and (out.kind[k] in "sr" or (out.kind[k] == "w" and out.text[k] not in _BEFORE_REGEX) or (out.kind[k] == "o" and out.text[k][:1].isdigit()) or out.text[k] in (")", "]", "}"))
            r = None if value else _REGEX.match(text, here, end)
            if r:
                at = r.end()
                out.add("r", "", here, at)
                continue
        if word == "{":
            depth += 1
        elif word == "}":
            if templates and templates[-1] == depth:
                templates.pop()
                depth -= 1
                kind, here = "t", here
            else:
                depth -= 1
        if kind == "t":
            m = _TEMPLATE.match(text, at, end)
            at = m.end()
            if m[1] == "${":
                depth += 1
                templates.append(depth)
                out.add("p", "\0", here, at)  # an operand follows, as after an opening bracket; its end is the string
            else:
                out.add("s", "", here, at)
            continue
        kinds(kind)
        texts(word if kind in "wpa" or (kind == "o" and word[:1].isdigit()) else word[:1] if kind == "o" else "")
        places(here)
        ends(at)


def pairs(t: Tokens) -> dict[int, int]:
    """Opening bracket to the bracket that closes it; what stays open ends before the bracket that closes one around it, or with the file."""
    close: dict[int, int] = {}
    stack: list[int] = []
    of: dict[str, list[int]] = {x: [] for x in _CLOSE.values()}  # places in the stack by what closes them
    for i, kind in enumerate(t.kind):
        if kind != "p":
            continue
        x = t.text[i]
        if x in _CLOSE:
            of[_CLOSE[x]].append(len(stack))
            stack.append(i)
        elif x in of and of[x]:  # brackets that don't match are passed over
            j = of[x][-1]
            close[stack[j]] = i
            for y in stack[j:]:
                of[_CLOSE[t.text[y]]].pop()
            close |= dict.fromkeys(stack[j + 1 :], i - 1)
            del stack[j:]
    return close | dict.fromkeys(stack, len(t.kind))


def go_functions(text: str) -> Iterator[tuple[int, str, int, int, Tokens]]:
    """(start, name, start of the body, end, tokens) of each func declaration with a body."""
    t = lex_go(text)
    close = pairs(t)
    i, n = 0, len(t.kind)
    fresh = True  # at the start of a line or after ;
    while i < n:
        x = t.text[i]
        if t.kind[i] == "n" or x == ";":
            fresh = True
            i += 1
            continue
        if fresh and t.kind[i] == "w" and x == "func":
            j = i + 1
            if j < n and t.text[j] == "(":  # receiver
                j = close[j] + 1
            if j < n and t.kind[j] == "w":
                name, j = t.text[j], j + 1
                if j < n and t.text[j] == "[":
                    j = close[j] + 1
                if j < n and t.text[j] == "(":
                    j = close[j] + 1
                    while j < n and t.kind[j] != "n" and t.text[j] != ";":
                        if t.text[j] == "{" and t.text[j - 1] not in ("interface", "struct"):
                            end = close[j]
                            yield t.at[i], name, t.at[j], t.at[end] + 1 if end < n else len(text), t
                            i = end
                            break
                        j = close[j] + 1 if t.text[j] in _CLOSE and j in close else j + 1
        fresh = False
        i = close[i] + 1 if i < n and t.text[i] in _CLOSE and t.kind[i] == "p" else i + 1


def js_functions(text: str, t: Tokens) -> Iterator[tuple[int, str, int, int, Tokens]]:
    """The same for function declarations, functions held by a const, and methods of classes and object literals, at any depth."""
    n = len(t.kind)
    code = [i for i in range(n) if t.kind[i] != "n"]  # line ends matter only where a statement begins
    first = bytearray(n + 1)  # code tokens that start a line
    for i in range(1, n):
        first[i] = t.kind[i - 1] == "n"
    if n:
        first[0] = 1
    kind, word, at, begins = [t.kind[i] for i in code], [t.text[i] for i in code], [t.at[i] for i in code], [first[i] for i in code]
    n = len(code)
    c = Tokens()
    c.kind, c.text, c.at = kind, word, at
    close = pairs(c)

    generics: dict[int, int] = {}  # < to the > that closes it, within the same brackets and statement
    ends: set[int] = set()
    opened: list[tuple[str, int]] = []  # < and where it is, or a bracket and where it ends
    for i in range(n):
        while opened and opened[-1][0] == "<" and word[i] == ";":
            opened.pop()
        if kind[i] != "p":
            continue
        if word[i] == "<":
            opened.append(("<", i))
        elif word[i] == ">" and opened and opened[-1][0] == "<":
            generics[opened.pop()[1]] = i
        elif word[i] in _CLOSE and i in close:
            opened.append((word[i], close[i]))
            if close[i] < n and word[close[i]] == _CLOSE[word[i]]:
                ends.add(close[i])
        elif i in ends:
            while opened.pop() != (_OPEN[word[i]], i):
                pass

    def after_generics(j: int) -> int:
        """Behind <...> if that is what stands at j."""
        return generics[j] + 1 if j in generics else j

    walked: dict[tuple[int, bool, tuple[str, ...]], int] = {}  # where types from a token on end

    def behind_type(j: int, stop: tuple[str, ...]) -> int:
        """The place of the first of `stop` behind a type that begins at j; n if there is none. No token is walked twice."""
        wants = True  # the type is not complete yet
        way, end = [], n
        while j < n:
            if (j, wants, stop) in walked:
                end = walked[j, wants, stop]
                break
            way.append((j, wants, stop))
            x = word[j]
            if x in stop and (not wants or x != "{"):
                end = j
                break
            if x in (";", ")", "]", "}", ",", "const", "let", "var", "return", "export") or (x == "import" and word[j + 1 : j + 2] != ["("]) or (begins[j] and not wants and x not in ("|", "&", ".", "[", "<")):
                break
            if x == "<":
                k = after_generics(j)
                j, wants = (k, False) if k > j else (j + 1, True)
                continue
            if kind[j] == "p" and x in _CLOSE and j in close:
                j, wants = close[j] + 1, False
                continue
            wants = kind[j] == "o" or x in ("|", "&", ":", "?", ".") or kind[j] == "a" or x in ("is", "keyof", "typeof", "extends", "readonly", "infer", "asserts", "unique")
            j += 1
        walked.update(dict.fromkeys(way, end))
        return end

    def body_of(j: int, arrow: bool) -> tuple[int, int] | None:
        """(first token, last token) of the body of a function whose parameters open at j."""
        j = after_generics(j)
        if j >= n:
            return None
        if word[j] == "(":
            if j not in close:
                return None
            j = close[j] + 1
            if j < n and word[j] == ":":
                j = behind_type(j + 1, ("=>",) if arrow else ("{",))
        elif arrow and kind[j] == "w":
            j += 1
        else:
            return None
        if arrow:
            if j >= n or word[j] != "=>" or j + 1 >= n:
                return None
            j += 1
            if word[j] != "{":  # an expression: to the end of the statement or member
                k = j
                while k < n and word[k] not in (";", ",", ")", "]", "}"):
                    if k > j and begins[k] and (kind[k] == "w" and kind[k - 1] in "wsr"):
                        break
                    k = close[k] + 1 if kind[k] == "p" and word[k] in _CLOSE and k in close else k + 1
                return j, max(j, min(k, n) - 1)
        return (j, min(close[j], n - 1)) if j < n and word[j] == "{" else None

    def valued(j: int) -> tuple[int, int] | None:
        """The body of a function expression at j."""
        if j < n and word[j] == "async" and kind[j] == "w":
            j += 1
        if j < n and word[j] == "function":
            j += 1
            j += j < n and word[j] == "*"
            if j < n and kind[j] == "w":
                j += 1
            return body_of(j, False)
        if j < n and word[j] == "(" and j in close and close[j] + 1 < n and word[close[j] + 1] not in ("=>", ":"):
            return valued(j + 1) if word[close[j] + 1] not in ("(", ".") and j + 1 < n and word[j + 1] in ("async", "function", "(") else None
        return body_of(j, True)

    inside: list[tuple[str, int]] = []  # kind of brace, where it ends
    pending = ""  # what the next brace of this statement opens
    i = 0
    while i < n:
        x, k = word[i], kind[i]
        while inside and i >= inside[-1][1]:
            inside.pop()
        where = inside[-1][0] if inside else "block"
        before = word[i - 1] if i else ""
        if k == "p" and x in _CLOSE:
            if x == "{":
                if pending == "class" and before in ("<", ",", ":", "(", "|", "&"):  # within what the class extends
                    what = "type"
                elif pending:
                    what, pending = pending, ""
                elif i and (before in ("=", "(", ",", "[", ":", "?", "return", "default", "\0") and kind[i - 1] in "pw" or (kind[i - 1] == "o" and before in "&|!+-") or (before in ("in", "of", "throw", "yield", "await", "new") and kind[i - 1] == "w")):
                    what = "object"
                else:
                    what = "block"
                inside.append((what, close.get(i, n)))
            else:
                inside.append((x, close.get(i, n)))
            i += 1
            continue
        if k == "w" and x in ("class", "interface", "enum", "namespace", "module") and before != "." and i + 1 < n and word[i + 1] not in (":", ",", "=", ")", ".", "("):
            if x in ("class",) or (kind[i + 1] in "ws" and (begins[i] or before in ("export", "declare", "default", "abstract", "const", ";", "{", "}"))):
                pending = {"class": "class", "namespace": "block", "module": "block"}.get(x, "type")
        if k == "w" and x == "type" and i + 2 < n and kind[i + 1] == "w" and not begins[i + 1] and word[i + 2] in ("=", "<"):
            pending = "type"
        if x == ";":
            pending = ""
        found = None
        if k == "w" and where in ("block", "\0"):
            if x == "function" and before not in (".", "=", "(", ",", ":", "?", "return", "[", "=>"):
                s = i
                while s and kind[s - 1] == "w" and word[s - 1] in ("async", "default", "export", "declare"):
                    s -= 1
                j = i + 1
                j += j < n and word[j] == "*"
                if (s == 0 or begins[s] or word[s - 1] in (";", "{", "}", ")") ) and j < n and kind[j] == "w":
                    found = (s, word[j], body_of(j + 1, False))
            elif x == "const" and i + 2 < n and kind[i + 1] == "w" and word[i + 1] != "enum":
                s = i
                while s and kind[s - 1] == "w" and word[s - 1] in ("export", "declare"):
                    s -= 1
                j = i + 2
                if word[j] == ":":
                    j = behind_type(j + 1, ("=",))
                if j < n and word[j] == "=":
                    found = (s, word[i + 1], valued(j + 1))
        if where == "class" and k in "wsop[" and (before in ("{", "}", ";") or begins[i]) and not pending:
            s = j = i
            while j < n and word[j].startswith("@") and kind[j] == "w":  # decorators
                j += 1
                while j < n and word[j] == ".":
                    j += 2
                if j < n and word[j] == "(":
                    j = close.get(j, n) + 1
            while j + 1 < n and kind[j] == "w" and word[j] in _MODIFIERS and word[j + 1] not in ("(", "=", ":", ";", "?", "<"):
                j += 1
            j += j < n and word[j] == "*"
            name = None
            if j < n and kind[j] in "ws":
                name, j = word[j], j + 1
            elif j < n and word[j] == "[":
                name, j = "", close.get(j, n) + 1
            if name is not None and j < n:
                q = j + (word[j] == "?")
                if q < n and word[q] in ("(", "<") and name not in _CONTROL - {"return", "new", "catch", "with", "delete", "do", "if", "for", "else"}:
                    found = (s, name, body_of(q, False))
                else:  # a property that holds a function
                    if word[q : q + 1] == [":"]:
                        q = behind_type(q + 1, ("=",))
                    if q < n and word[q] == "=":
                        found = (s, name, valued(q + 1))
            if found is None and j > i:
                i = max(i, s)
        if where == "object" and (before in ("{", ",")) and (i == 0 or kind[i - 1] == "p"):
            s = j = i
            while j + 1 < n and kind[j] == "w" and word[j] in ("async", "get", "set") and word[j + 1] not in ("(", ":", ",", "}"):
                j += 1
            j += j < n and word[j] == "*"
            name = None
            if j < n and kind[j] in "ws":
                name, j = word[j], j + 1
            elif j < n and word[j] == "[":
                name, j = "", close.get(j, n) + 1
            if name is not None and j < n:
                if word[j] in ("(", "<"):
                    found = (s, name, body_of(j, False))
                elif word[j] == ":":
                    found = (s, name, valued(j + 1))
        if found and found[2]:
            s, name, (b, e) = found
            yield at[s], name, at[b], at[e] + 1, t
            if word[b] == "{":  # go on inside: parameters can't hold declarations
                inside.append(("block", close.get(b, n)))
                pending = ""
                i = b + 1
                continue
        i += 1


