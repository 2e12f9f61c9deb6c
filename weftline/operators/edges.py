"""How rows of the edges table are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_kind(kind: str | Column = "kind") -> Column:
    """The kind without blanks and tabs at its ends, in lower case."""
    return F.lower(F.expr(f"trim(BOTH ' \\t' FROM {kind})") if isinstance(kind, str) else F.regexp_replace(kind, r"^[ \t]+|[ \t]+$", ""))


def is_edge() -> Column:
    """Both ends are there and differ. Nulls count as missing ends."""
    return F.coalesce((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")), F.lit(False))
