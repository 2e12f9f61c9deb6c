"""Problem 9: per-document text quality statistics, and the form of texts that are no natural prose.

The statistics are those common in corpus filtering: words, mean word length, symbols, line ends, common words, and repetition (shares of
duplicate lines and paragraphs, characters covered by the dominant n-gram). The form follows from combined rules over the same measurements (`Measures`), which
are taken at most once per text: each line's characters go to prose, code, list, table or junk; what repeated lines, paragraphs, sentences and runs and the dominant
n-gram cover of the prose goes to junk; lines that most of its paragraphs share (boilerplate) count as said once; and a form is given when it
holds more than half of the text's characters. Documents are independent: one mapInArrow, no shuffle, whole texts. One pass gives both the statistics and the form.
"""

from __future__ import annotations

import re as plain_re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame

# The most common function words of several languages.
COMMON = {
    "en": "the of and to a in is it that was for on are as with his they at be this have from or had by but not what all were when we there can an your which their said if do will each how them then so these some her would make like him into has more no way could than been now did get come made may part over it's its before after other our you i me my he she us any only also because one until once while about again who should never".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man kein wenn wir hier gibt uns keine sein ob dann ihr ich du mich ja trotzdem immer erst weil".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec on aux d l n s qu c j y ou mais comme leur si même cette ces son sa ses nous vous ils elle sans être fait car tout après avant quand faut elles je tu était lui entre".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde está nos porque cada hay eso esa qué después antes fueron mi yo nosotros así para".split(),
    "it": "di che e la il un a per in una mi sono ho non ma lo ti le si da cosa come con ha i del della al dei nel alla è gli più questo anche delle era se ci o quando dopo prima".split(),
    "pt": "de que e o a do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito nos já eu também só pelo pela até isso ela entre depois sem mesmo aos seus é foi".split(),
    "nl": "de en van ik te dat die in een hij het niet zijn is was op aan met als voor had er maar om hem dan zou of wat mijn men dit zo door over ze zich bij ook tot je mij uit der daar haar naar heb hoe heeft hebben deze u want nog zal".split(),
    "sv": "och det att i en jag hon som han på den med var sig för så till är men ett om hade de av icke mig du henne då sin nu har inte hans honom skulle hennes där min man ej vid kunde något från ut när efter upp vi dem".split(),
    "pl": "i w nie na się z do to że a o jak ale po co tak za od jest go już tym czy był ich dla przez przed może jego przy być ten sobie oraz".split(),
    "tr": "ve bir bu da de için ile çok ne o daha gibi kadar ama her ben var mı sonra olarak olan en değil ki ya diye".split(),
    "ru": "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой от так о для ты же все год человек как если или бы его только когда уже был до".split(),
}
_FIELD = 24
_COUNTS = {w: sum(1 << (_FIELD * i) for i, words in enumerate(COMMON.values()) if w in words) for words in COMMON.values() for w in words}
"""Per word one count in the field of each language it is common in, so that one sum counts for all languages."""

_WORD = re.compile(r"[\p{L}\p{M}\p{N}_]+(?:['’\-][\p{L}\p{M}\p{N}_]+)*")
_PART = re.compile(r"[\p{L}\p{M}]+")
_CJK = re.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_SENTENCE_END = re.compile(r"[.!?…。！？؟।:;][\"'»”’)\]]*$")
_MARK = re.compile(
    r"^\s*(?:>\s*)?(?:(?:[-*+•–—▪▫◦‣⁃·∙○●■□▶►➤➢→✓✔✗✘☐☑☒※★☆][ \t\u00a0]+)+(?:\[[ xX✓-]?\][ \t]+)?|\[[ xX✓-]?\][ \t]+|\(?(?:\d{1,4}(?:\.\d{1,3}){0,7}[.):\]]|(?:[a-zA-Z]|[ivxlcIVXLC]{1,6})[.)\]])[ \t]+|[①-⑳⓪][ \t]*|#\d+[ \t]+|\d+、|\(?[一二三四五六七八九十]+[、)）]\s*|<li\b|\\item\b|=>\s)"
)
_STAMP = re.compile(
    r"^\W{0,3}(?:\d{4}[-/.]\d\d[-/.]\d\d[T _]?\d\d:\d\d|\d\d[-/.]\d\d[-/.]\d{2,4}[T ,]+\d\d:\d\d|[A-Z][a-z]{2} +\d{1,2} \d\d:\d\d:\d\d|\d\d:\d\d:\d\d|\d{10,13}[ .\]]|(?:TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL|NOTICE)\b[\]: ]|[IWEF]\d{4} \d\d:|\d{1,3}(?:\.\d{1,3}){3} - )"
)
_TRACE = re.compile(r"^\s*(?:at [\w$.<>]+\s?\(|File \"|Traceback \(|goroutine \d+|\w+(?:\.\w+)*(?:Error|Exception)\b|Caused by:|\.\.\. \d+ more|[0-9a-f]{6,16}:?\s+(?:[0-9a-f]{2,4}\s+){4}|(?:[0-9a-f]{2}[ :]){8}|\[\s*\d+\.\d+\])")
_HTML_ROW = re.compile(r"</?(?:table|thead|tbody|tfoot|tr|td|th|caption|colgroup)\b", re.I)
_RULE = re.compile(r"^[\s|+:=\-─━═│┃┌┐└┘├┤┬┴┼╔╗╚╝╠╣╦╩╬╭╮╰╯┏┓┗┛┣┫┳┻╋*]+$")
_LATEX = re.compile(r"&.*\\\\\s*(?:\\hline)?\s*$|^\s*\\(?:hline|toprule|midrule|bottomrule|begin\{tabular|end\{tabular)")
_FENCE = re.compile(r"^\s*(?:```|~~~)")
_HEADING = re.compile(r"^\s*(?:#{1,6}\s|=+\s*$|-{3,}\s*$|\*{3,}\s*$|_{3,}\s*$)")
_CODE = re.compile(r"[{}()\[\];=&|<>!$]")
_ENCODED, _UPPER, _LOWER, _DIGIT = re.compile(r"[A-Za-z0-9+/=_-]{40,}"), re.compile("[A-Z]"), re.compile("[a-z]"), re.compile("[0-9]")
_HARD = re.compile(r"[bcdfghjklmnpqrstvwxz]{5,}|[bcdfghjklmnpqrstvwxz]{2}[jqvx][bcdfghjklmnpqrstvwxz]|[aeiou]{5,}", re.I)  # no language spells so often
_MOJIBAKE = re.compile(r"\ufffd|[ÂÃÐÑ][\u0080-\u00bf]|â€|ï¿½|[\u0080-\u009f]|[\x00-\x08\x0b\x0e-\x1f]")


# the same for ASCII texts, where the standard library's engine is faster
_ASCII_WORD = plain_re.compile(r"[A-Za-z0-9_]+(?:['\-][A-Za-z0-9_]+)*")
_ASCII_PART = plain_re.compile(r"[a-z]{2,}")


def _all_words(text: str) -> list[str]:
    return (_ASCII_WORD if text.isascii() else _WORD).findall(text)


def _words(text: str) -> int:
    """Words; scripts without blanks count two characters as one."""
    if text.isascii() or not _CJK.search(text):
        return len(_all_words(text))
    cjk = len(_CJK.findall(text))
    return len(_WORD.findall(_CJK.sub(" ", text))) + (cjk + 1) // 2


def _counted(text: str) -> tuple[int, int]:
    """(words, packed counts of common words of each language); single letters, which any noise has, don't count."""
    words = _ASCII_PART.findall(text.lower()) if text.isascii() else [w for w in _PART.findall(text.lower()) if len(w) > 1]
    return len(words), sum(map(_COUNTS.get, words, repeat(0)))


def _best(total: int) -> int:
    """The common words of the best-fitting language."""
    best = 0
    while total:
        best, total = max(best, total & ((1 << _FIELD) - 1)), total >> _FIELD
    return best


def _common(text: str) -> tuple[int, int]:
    """(words, common words) of the best-fitting language."""
    n, total = _counted(text)
    return n, _best(total)


_LINES = re.compile(r"\r\n|\r|\n|\u2028|\u2029|\x85")
_PARAGRAPHS = re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)")
_PARTS = re.compile(r"[.!?。！？]+(?:\s|$)|[。！？]|[\r\n]+")
_RUN, _BASE, _MOD = 40, 1_000_003, (1 << 61) - 1
OFTEN = 4
"""So many times is what is said over and over; twice or three times is not."""


class Measures:
    """What is measured of a text, each thing when it is first asked for."""

    def __init__(self, text: str) -> None:
        self.text = text

    @cached_property
    def lines(self) -> list[str]:
        return _LINES.split(self.text)

    @cached_property
    def words(self) -> list[str]:
        return _all_words(self.text)

    @cached_property
    def low(self) -> list[str]:
        return _all_words(self.text.lower())

    @cached_property
    def word_counts(self) -> Counter[str]:
        return Counter(self.low)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.low))

    @cached_property
    def sentences(self) -> Counter[str]:
        """Sentences and lines, and how often each comes."""
        return Counter(x for x in map(str.strip, _PARTS.split(self.text)) if x)

    @cached_property
    def paragraphs(self) -> list[str]:
        return [p.strip() for p in _PARAGRAPHS.split(self.text) if p.strip()]

    @cached_property
    def full_lines(self) -> list[str]:
        return [x.strip() for x in self.lines if x.strip()]

    @staticmethod
    def _duplicates(units: list[str]) -> float:
        return 1 - len(set(units)) / len(units) if units else 0.0

    @property
    def dup_lines(self) -> float:
        return self._duplicates(self.full_lines)

    @property
    def dup_paragraphs(self) -> float:
        return self._duplicates(self.paragraphs)

    def top_gram(self, n: int, least: int = 2) -> float:
        """The share of the words' characters that the dominant n-gram covers, among those that come `least` times or more."""
        grams = Counter(zip(*(self.low[i:] for i in range(n)), strict=False))
        most = max((k * sum(map(len, g)) for g, k in grams.items() if k >= least), default=0)
        return min(1.0, most / max(1, self.word_chars))

    @cached_property
    def again(self) -> float:
        """The share of the words' characters in what comes at least OFTEN times; 0 up to a half.

        That is paragraphs, sentences and lines of which each holds a twentieth of all or more, one n-gram, or runs of forty words. A long natural text of few
        phrases has none of these: it says each of them now and then, and in any order. A line that comes with every paragraph counts as said once.
        """
        words, whole = self.low, self.word_chars
        # what comes four times leaves few words: 1/2 + 1/2 / 4
        if len(words) < 10 or sum(map(len, self.word_counts)) >= 0.625 * whole:
            return 0.0
        best = 0.0
        for units, dup in ((Counter(self.paragraphs), self.dup_paragraphs), (Counter(self.full_lines), self.dup_lines), (self.sentences, 1.0)):
            if dup > 0.4:  # else repeated ones are too few to cover half
                said = [k * sum(map(len, _all_words(x))) for x, k in units.items() if k >= OFTEN]
                best = max(best, sum(n for n in said if n >= 0.05 * whole) / whole)
        # an n-gram that covers half has a word that covers a (2 n)-th
        if max(len(w) * k for w, k in self.word_counts.items()) >= whole / 8:
            best = max(best, *(self.top_gram(n, OFTEN) for n in (2, 3, 4)))
        if best <= 0.5 and len(words) >= OFTEN * _RUN:
            best = max(best, self._runs())
        best = min(1.0, best)
        return best if best > 0.5 else 0.0

    def _runs(self) -> float:
        """The share of the words' characters in runs of forty words that come OFTEN times, by a rolling hash, else each would hold forty words."""
        words = self.low
        number: dict[str, int] = {}
        ids = [number.setdefault(w, len(number) + 1) for w in words]
        grams = Counter(zip(ids, ids[1:], ids[2:], ids[3:], strict=False))
        if sum(k for k in grams.values() if k >= OFTEN) < 0.3 * len(words):  # each of a run's grams comes as often as the run
            return 0.0
        runs, h, last = [], 0, pow(_BASE, _RUN, _MOD)
        for i, x in enumerate(ids):
            h = (h * _BASE + x - (ids[i - _RUN] * last if i >= _RUN else 0)) % _MOD
            if i >= _RUN - 1:
                runs.append(h)
        often, covered, upto = Counter(runs), 0, 0
        for i, run in enumerate(runs):
            if often[run] >= OFTEN:
                covered += sum(map(len, words[max(i, upto) : i + _RUN]))
                upto = i + _RUN
        return covered / self.word_chars


def statistics(text: str | None, m: Measures | None = None) -> dict[str, float]:
    """The numbers of one text. Null, empty and blank texts have 0 everywhere but in n_chars."""
    text = text or ""
    m = m or Measures(text)
    full, words = m.full_lines, m.words
    n, n_common = _common(text)
    chars = sum(not c.isspace() for c in text)
    symbols = sum(not (c.isalnum() or c.isspace()) for c in text)
    return {
        "n_chars": len(text),
        "n_words": _words(text),
        "mean_word_length": sum(map(len, words)) / len(words) if words else 0.0,
        "symbol_ratio": symbols / chars if chars else 0.0,
        "line_end_share": sum(bool(_SENTENCE_END.search(x)) for x in full) / len(full) if full else 0.0,
        "common_share": n_common / n if n else 0.0,
        "dup_line_share": m.dup_lines,
        "dup_paragraph_share": m.dup_paragraphs,
        "mark_share": sum(bool(_MARK.match(x)) for x in full) / len(full) if full else 0.0,
        **{f"top_{k}gram_share": m.top_gram(k) for k in (2, 3, 4)},
    }


_TIGHT = [(sep, re.compile(re.escape(sep) + r"(?=\S)"), re.compile(re.escape(sep) + r"\s")) for sep in (";", ",", "~", "^", "¦")]
_GAP, _BARS, _STOP, _STOPS = re.compile(r"[ \u00a0]{2,}"), re.compile(r"[|│┃]+"), re.compile(r"[.!?。！？]$"), re.compile(r"[.!?。！？]\s")
_GRID = re.compile(r"[|+┼├┤│┬┴═]|-\s+-|=\s+=")
_SEPARATORS = [(chars, re.compile(x)) for chars, x in ((",，、", r"[,，、]\s*"), (";；", r"[;；]\s*"), ("|/·•", r"\s*[|/·•]\s+"), ("-–—", r"\s+[-–—]\s+"))]
_PATH = re.compile(r"(?:https?|ftp)://|[\w.@~-]*(?:/[\w.@~{}:-]+)+$")


def _cells(line: str) -> tuple[str, int]:
    """The separator that cuts the line into cells and how many; ('', 1) if none does."""
    s = line.strip()
    if s.count("|") >= 1 or "│" in s or "┃" in s:
        return "|", max(2, len([c for c in _BARS.split(s) if c.strip()]))
    if "\t" in s:
        return "\t", s.count("\t") + 1
    for sep, tight, loose in _TIGHT:
        if sep in s and not loose.search(s) and (k := len(tight.findall(s))):
            return sep, k + 1
    parts = _GAP.split(s) if "  " in s or "\u00a0" in s else [s]
    return ("  ", len(parts)) if len(parts) > 1 else ("", 1)


def _repeated(m: Measures) -> bool:
    """The same thing over and over: a few characters, one unit from end to end, or one sentence, line, word or pair of words that covers most of the text."""
    s = " ".join(m.text.split())
    n = len(s)
    if n < 40:
        return False
    if len(set(s)) <= 3:
        return True
    period = s.find(s[: min(24, n // 3)], 1)
    if 0 < period <= n // 3 and s.startswith(s[period:]):
        return True
    parts = m.sentences
    top = max(parts, key=lambda x: (parts[x] * len(x), x), default="")
    if parts[top] >= OFTEN and parts[top] * len(top) > (0.5 if any(map(str.isalnum, top)) else 0.8) * sum(k * len(x) for x, k in parts.items()):  # rules between the rows of a table are no text
        return True
    words = s.lower().split(" ")
    if len(words) < 10:
        return False
    whole, counts = n - len(words) + 1, Counter(words)
    top = max(counts, key=lambda x: (counts[x] * len(x), x))
    if counts[top] * len(top) > (0.7 if any(map(str.isalnum, top)) else 0.8) * whole:
        return True
    if counts[top] * len(top) <= 0.3 * whole:  # a pair that covers so much has a word that covers the half of it
        return False
    pair, k = Counter(zip(words, words[1:], strict=False)).most_common(1)[0]
    return k * sum(map(len, pair)) > 0.8 * whole


_OTHER = re.compile(r"[^\p{L}]+")
_NO_LETTERS = bytes(x for x in range(128) if not chr(x).isalpha())
_LONG = plain_re.compile(r"\S{30,}")


def _letters(s: str) -> int:
    return len(s.encode().translate(None, _NO_LETTERS)) if s.isascii() else len(_OTHER.sub("", s))


def _noise(line: str, k: int, common: int) -> bool:
    """A long line that is no language: encoded data, minified code, damaged or random characters, words without sentences. k, common: its words, and those of them that are common."""
    s = line.strip()
    n = len(s)
    ascii_ = s.isascii()
    if not (ascii_ and s.isprintable()):
        bad = sum(map(len, _MOJIBAKE.findall(s)))
        if bad and bad >= 0.04 * n:
            return True
        if not ascii_ and len(_CJK.findall(s)) > 0.3 * n:
            return False
    if n >= 40 and _ENCODED.fullmatch(s) and min(len(_UPPER.findall(s)), len(_LOWER.findall(s)), 3 * len(_DIGIT.findall(s))) >= 5:
        return True
    if n >= 30 and _LONG.search(s):
        longest = max(s.split(), key=len)
        if len(longest) > 0.6 * n and len(longest) >= 30:
            return not _PATH.match(longest) or len(longest) > 200
    if n >= 20 and _letters(s) < 0.35 * n:
        return True
    if n >= 60 and (s.count(" ") < 0.05 * n and k < 4 or sum(map(s.count, "{}()[];=&|<>!$")) > 0.15 * n):
        return True
    if common >= 0.25 * k and k:
        return False
    long = [w for w in _PART.findall(s) if len(w) >= 5]
    hard = sum(bool(_HARD.search(w)) for w in long)
    if len(long) >= 2 and hard > 0.3 * len(long) and common < 0.25 * k:
        return True
    return k >= 9 and common < 0.08 * k or k >= 7 and not common and hard > 0


def _inline(par: str) -> bool:
    """Items one after another within a paragraph, cut by commas, semicolons, bars or the like."""
    some = [sep for chars, sep in _SEPARATORS if sum(map(par.count, chars)) >= 4]  # five items at least
    if not some or sum(map(str.isalnum, par)) < 0.5 * len(par):
        return False
    for sep in some:
        parts = [p.strip() for p in sep.split(par.strip(" .。,，;；、"))]
        if len(parts) >= 5 and len(par) <= 60 * len(parts):
            sizes = [_words(p) for p in parts]
            if sum(sizes) <= 3.6 * len(parts) and max(sizes) <= 9 and sum(bool(_STOPS.search(p)) for p in parts) <= 0.1 * len(parts):
                return True
    return False


def _short(line: str) -> bool:
    """Could be an item without a mark: a few words that make no sentence."""
    s = line.strip()
    if len(s) > 120:
        return False
    w = _words(s)
    if w > 8 or _CJK.search(s) and w > 7:
        return False
    return not _STOP.search(s) or w <= 4


def line_kinds(text: str, m: Measures | None = None) -> list[tuple[str, int]]:
    """(kind, characters) of each line that isn't blank; kinds are prose, code, list, table and junk."""
    lines = (m or Measures(text)).lines
    kinds: list[str] = [""] * len(lines)
    fence = False
    fences = "```" in text or "~~~" in text
    for i, x in enumerate(lines if fences else ()):
        if _FENCE.match(x) and not (len(set(x.strip())) == 1 and len(x.strip()) > 12):
            fence = not fence
            kinds[i] = "code"
        elif fence:
            kinds[i] = "code"
    if fence and kinds.count("code") > 0.5 * len(kinds):  # a fence that nothing closes
        kinds = [""] * len(lines)
    full = [i for i, x in enumerate(lines) if x.strip() and not kinds[i]]
    # rows: neighbours that are cut alike
    cells = {i: _cells(lines[i]) for i in full}
    for a, i in enumerate(full):
        x = lines[i]
        if _STAMP.match(x) or _TRACE.match(x):
            kinds[i] = "junk"
            continue
        if "<" in x and _HTML_ROW.search(x) or "\\" in x and _LATEX.search(x):
            kinds[i] = "table"
            continue
        if len(x.strip()) >= 5 and not x[0].isalnum() and _RULE.match(x) and _GRID.search(x.strip()) and len(set(x.strip())) > 1:
            kinds[i] = "table"
            continue
        sep, k = cells[i]
        near = [cells[full[b]] for b in (a - 2, a - 1, a + 1, a + 2) if 0 <= b < len(full)]
        if k > 1:
            alike = sum(s == sep and abs(m - k) <= (1 if k > 3 and sep in ("  ", "|") else 0) for s, m in near)
            if alike >= min(2, max(1, len(near))) and _words(x) <= 8 * k:
                marked = _MARK.match(x) and sep in ("  ",)
                if not marked and not (sep in (",", ";") and k == 2 and _common(x)[1] >= 3):
                    kinds[i] = "table"
    for i in full:
        if not kinds[i] and _MARK.match(lines[i]) and len(lines[i].strip()) > 1:
            kinds[i] = "list"
    # what an item goes on with: indented, right below
    for a, i in enumerate(full[1:], 1):
        if not kinds[i] and kinds[i - 1] == "list" and re.match(r"\s{2,}", lines[i]) and len(lines[i]) - len(lines[i].lstrip()) > len(lines[i - 1]) - len(lines[i - 1].lstrip()):
            kinds[i] = "list"
    # paragraphs of what is left
    rest = [i for i in full if not kinds[i] and not _HEADING.match(lines[i])]
    for i in full:
        if not kinds[i] and _HEADING.match(lines[i]):
            kinds[i] = "head"
    start = 0
    while start < len(rest):
        end = start
        while end + 1 < len(rest) and rest[end + 1] == rest[end] + 1:
            end += 1
        block = rest[start : end + 1]
        if _inline(" ".join(lines[i].strip() for i in block)):
            for i in block:
                kinds[i] = "list"
        start = end + 1
    rest = [i for i in rest if not kinds[i]]
    said = {i: _counted(lines[i]) for i in rest}
    for i in rest:
        if _noise(lines[i], said[i][0], _best(said[i][1])):
            kinds[i] = "junk"
    rest = [i for i in rest if not kinds[i]]
    # runs of short lines
    run: list[int] = []

    def close() -> None:
        if len(run) >= 3:
            words = [_words(lines[i]) for i in run]
            k, common = sum(said[i][0] for i in run), _best(sum(said[i][1] for i in run))
            ends = sum(bool(_STOP.search(lines[i].strip())) for i in run)
            if sum(words) <= 5.2 * len(run) and ends <= 0.2 * len(run) and (common <= 0.38 * max(k, 1) or sum(words) <= 4.5 * len(run)):
                for i in run:
                    kinds[i] = "list"
        run.clear()

    for i in rest:
        if kinds[i]:
            continue
        if _short(lines[i]):
            run.append(i)
        else:
            close()
    close()
    # lines of words without sentences, wrapped
    left = [i for i in rest if not kinds[i]]
    if left:
        k, common = sum(said[i][0] for i in left), _best(sum(said[i][1] for i in left))
        if k >= 12 and common < 0.08 * k and sum(len(_CJK.findall(lines[i])) for i in left) < k:
            for i in left:
                kinds[i] = "junk"
    return [(kinds[i] if kinds[i] not in ("", "head") else "prose", len(lines[i].strip())) for i, x in enumerate(lines) if x.strip()]


def form(text: str | None, m: Measures | None = None) -> str | None:
    """'list', 'table' or 'junk' if that makes up more than half of the text's characters, else None (prose, code, empty, blank, null)."""
    if not text or not text.strip():
        return None
    m = m or Measures(text)
    if _repeated(m):
        return "junk"
    share: Counter[str] = Counter()
    kinds = line_kinds(text, m)
    for kind, n in kinds:
        share[kind] += n
    if share["prose"]:
        total = sum(share.values())
        prose = m if share["prose"] == total else Measures("\n".join(x for x, (kind, _) in zip(filter(str.strip, m.lines), kinds, strict=True) if kind == "prose"))
        again = share["prose"] * prose.again
        share["prose"] -= again
        share["junk"] += again
    total = sum(share.values())
    what, n = max(((k, share[k]) for k in ("list", "table", "junk")), key=lambda x: x[1])
    return what if n > 0.5 * total else None


STATS = ["n_chars", "n_words", "mean_word_length", "symbol_ratio", "line_end_share", "common_share", "dup_line_share", "dup_paragraph_share", "mark_share", "top_2gram_share", "top_3gram_share", "top_4gram_share"]


def _measured(docs: DataFrame, key: str, text: str, stats: bool) -> DataFrame:
    """(key[, the STATS], form): one pass for both."""
    ints = STATS[:2]
    cols = STATS if stats else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, forms = [], []
            for x in b.column(1).to_pylist():
                m = Measures(x or "")
                if stats:
                    got.append(statistics(x, m))
                forms.append(form(x, m))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[c] for g in got], pa.int64() if c in ints else pa.float64()) for c in cols), pa.array(forms, pa.string())], [key, *cols, "form"])

    return docs.select(key, text).mapInArrow(run, ", ".join([f"{key} {docs.schema[key].dataType.simpleString()}", *(f"{c} {'bigint' if c in ints else 'double'}" for c in cols), "form string"]))


def text_quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, the STATS, form) of each row; form is null for prose, code and texts without content. Other columns are not read."""
    return _measured(docs, key, text, True)


def odd_forms(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form) of the documents that are mostly lists, tables or junk: the same pass, which takes only the measurements that the form asks for."""
    return _measured(docs.where(f"length({text}) > 0"), key, text, False).where("form IS NOT NULL")
