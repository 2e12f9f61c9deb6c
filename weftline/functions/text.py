"""Tokens of symbols and texts, as expressions inside the JVM; stems through one Arrow function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.porter import stem

_CAMEL = r"(?<=\p{Ll})(?=\p{Lu})|(?<=.)(?=\p{Lu}\p{Ll})"

_EDGE = r"\p{Ll}\p{Lu}|.\p{Lu}\p{Ll}"


def fields(text: Column) -> Column:
    """Maximal runs of letters and numbers."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def camel(word: Column) -> Column:
    """The parts of an identifier: cut before an upper-case letter that follows or precedes a lower-case one."""
    return F.split(word, _CAMEL)


def words(text: Column) -> Column:
    """Lower-case tokens: each field and, if it has several, its camel parts. Repetitions stay. Only fields that hold a boundary are cut."""
    parts = lambda f: F.filter(F.concat(F.array(F.lower(f)), F.transform(camel(f), F.lower)), lambda x: x != "")
    cut = lambda f: F.when(f.rlike(_EDGE), parts(f)).otherwise(F.array(F.lower(f)))
    return F.flatten(F.transform(fields(text), cut))


@F.pandas_udf(T.ArrayType(T.StringType()))
def with_stems(tokens: pd.Series) -> pd.Series:
    """Each token, followed by its stem where that differs."""

    def add(ts):
        out = []
        for t in ts:
            s = stem(t)
            out += [t] if s == t else [t, s]
        return out

    return tokens.map(lambda ts: None if ts is None else add(ts))


@F.pandas_udf(T.StringType())
def stem_of(words: pd.Series) -> pd.Series:
    """The stem of each word; meant for distinct words."""
    return words.map(stem)


def tokens(text: Column, stems: bool = True) -> Column:
    """words, with stems if wanted."""
    return with_stems(words(text)) if stems else words(text)


def query_tokens(text: str, stems: bool = True) -> list[str]:
    """The same for a query, on the driver."""
    import regex as re

    out: list[str] = []
    for f in re.findall(r"[\p{L}\p{N}]+", text):
        parts = re.sub(r"(?<=\p{Ll})(?=\p{Lu})|(?<=.)(?=\p{Lu}\p{Ll})", "\0", f).split("\0")
        for w in [f, *(parts if len(parts) > 1 else [])]:
            w = w.lower()
            s = stem(w)
            out += [w, s] if stems and s != w else [w]
    return out


def slug(text: Column) -> Column:
    """Lower-case letters a-z and digits; anything else is a dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]", "-"), "^-+|-+$", "")


def cache_key(path: Column) -> Column:
    """The name of a path's folder in a cache: the first 12 hexadecimal digits of its SHA-256."""
    return F.substring(F.sha2(path, 256), 1, 12)


def json_action(text: Column, ddl: str) -> Column:
    """The JSON object from the first brace to the last, read by a schema; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), ddl)
