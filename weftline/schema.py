"""Explicit schemas, as DDL. Absent values are '', 0 or empty arrays; only embeddings may be null."""

from __future__ import annotations

NODES = "repo string, id string, kind string, name string, package string, file string, line int, signature string, doc string, fields array<string>"
EDGES = "repo string, ord bigint, src string, dst string, kind string"
ROUTES = "repo string, ord bigint, method string, path string, handler string"
SHAPES = "repo string, object string, props array<string>, file string"
PDGS = "repo string, id string, blocks int, ctrl_edges array<struct<src:int,dst:int>>, data_edges int, params array<string>"
TAINT = "repo string, func string, source string, sink string, line int"
REGISTRY = "name string, path string, indexed_at timestamp"
GROUPS = "name string, repos array<string>"

# One JSON document per repo: what an extractor or an export holds.
DOCUMENT = """nodes map<string, struct<id:string, kind:string, name:string, package:string, file:string, line:int, signature:string, doc:string, fields:array<string>>>,
    edges array<struct<`from`:string, `to`:string, kind:string>>, routes array<struct<method:string, path:string, handler:string>>,
    shapes array<struct<object:string, props:array<string>, file:string>>"""

NODE_COLUMNS = ("repo", "id", "kind", "name", "package", "file", "line", "signature", "doc", "fields")

# Kinds of symbols that the operators name.
API_KINDS = ("func", "method", "type", "interface", "class")
CALLABLE = ("func", "method")
SYMBOL_KINDS = ("func", "method", "type", "interface", "class", "component", "var", "const")
EXTERNAL_EDGES = ("imports", "constructs")
"""Edge kinds whose targets may lie outside the graph."""
