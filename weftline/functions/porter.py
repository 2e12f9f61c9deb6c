"""The Porter stemmer, written from the paper of 1980 (M. F. Porter, "An algorithm for suffix stripping")."""

from __future__ import annotations

from functools import lru_cache

# The suffix tables of steps 2, 3 and 4 of the paper.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[i - 1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc") if stem else 0


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _swap(w: str, table: dict[str, str]) -> str:
    for end in sorted(table, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            return stem + table[end] if _measure(stem) > 0 else w
    return w


@lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    """The stem of a lower-case word. Words of fewer than four bytes and words with other characters than letters stay as they are."""
    if len(w.encode()) < 4 or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if cut and "v" in _shape(w[:-cut]):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _STEP2), _STEP3)
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w
