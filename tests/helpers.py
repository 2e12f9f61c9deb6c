"""Small graphs for tests."""

from datetime import datetime

from weftline import schema
from weftline.operators.graph import Graph

EDGE_ROWS = "repo string, ord bigint, src string, dst string, kind string, indexed_at timestamp_ntz"
NODE_ROWS = "repo string, id string, kind string, name string, package string, file string, line int, signature string, doc string, fields array<string>, indexed_at timestamp_ntz, removed_at timestamp_ntz"


def day(n: int, month: int = 1) -> datetime:
    return datetime(2024, month, n)


def edge_rows(spark, rows):
    """rows of (repo, src, dst, kind); ord is the place."""
    return spark.createDataFrame([(r, i, a, b, k, day(1)) for i, (r, a, b, k) in enumerate(rows)], EDGE_ROWS)


def graph(spark, nodes, edges, routes=(), shapes=()):
    """nodes: id -> dict of columns; edges: (src, dst, kind)."""
    blank = {"kind": "func", "name": "", "package": "", "file": "", "line": 0, "signature": "", "doc": "", "fields": []}
    rows = [("r", i, *({**blank, "name": i, **d}[c] for c in schema.NODE_COLUMNS[2:])) for i, d in nodes.items()]
    return Graph(
        spark.createDataFrame(rows, schema.NODES),
        spark.createDataFrame([("r", i, *e) for i, e in enumerate(edges)], schema.EDGES),
        spark.createDataFrame([("r", i, *x) for i, x in enumerate(routes)], schema.ROUTES),
        spark.createDataFrame([("r", *x) for x in shapes], schema.SHAPES),
    )


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())
