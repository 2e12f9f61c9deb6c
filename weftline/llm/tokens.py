"""Problem 7: encoding of the whole corpus with a public tokenizer; token counts for problem 8.

The rank file is a parameter and is read where it lies; nothing of it is kept here. tiktoken does the merges. Long texts are cut
before the library's regular expression sees them, at places where every tokenization has a boundary: between a character that is no white
space and one that is. Very long runs of white space, on which the library's expression runs out of stack, are cut by rule: all
but the last character of a run are one piece if something follows, else the whole run is.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame, SparkSession

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CHUNK = 1 << 16
LONG_RUN = 2048

# Fixed value: the pattern published with the rank file; it splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Fixed value: Unicode's White_Space, which is what \s means in that pattern. Python's \s has four more.
SPACE = r"\t-\r \u0085   -     　"
_EDGE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
_RUN = re.compile(f"[{SPACE}]{{{LONG_RUN},}}+")

_loaded: dict[str, object] = {}


def ranks_path(spark: SparkSession) -> str:
    """The rank file: weftline.tokenizer.ranks in the session, else the default place."""
    return spark.conf.get("weftline.tokenizer.ranks", RANKS)


def encoder(path: str):
    """The encoding of a rank file, made once per process. Special tokens are not known to it, so their strings are ordinary text."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def _plain(enc, text: str, out: list[int]) -> None:
    """Text without very long runs of white space, in chunks."""
    at = 0
    while len(text) - at > CHUNK:
        m = _EDGE.search(text, at + CHUNK)
        if m is None:
            break
        out += enc.encode_ordinary(text[at : m.start()])
        at = m.start()
    out += enc.encode_ordinary(text[at:] if at else text)


def encode(enc, text: str | None) -> list[int]:
    """The ids of a text; null and empty texts have none."""
    out: list[int] = []
    if not text:
        return out
    if len(text) < LONG_RUN:
        return enc.encode_ordinary(text)
    at = 0
    for m in _RUN.finditer(text):
        _plain(enc, text[at : m.start()], out)
        at = m.end() - (m.end() < len(text))
        out += enc._encode_single_piece(text[m.start() : at].encode())
    _plain(enc, text[at:] if at else text, out)
    return out


def decode(enc, ids: list[int]) -> bytes:
    """The bytes that ids stand for. A token may end within a character, so this is not text."""
    return enc.decode_bytes(ids)


def _lists(batch: pa.RecordBatch, at: int, path: str, step: int = 512) -> Iterator[tuple[pa.RecordBatch, pa.ListArray]]:
    """The batch in slices of `step` rows, each with the ids of its texts."""
    enc = encoder(path)
    for s in range(0, batch.num_rows, step):
        part = batch.slice(s, step)
        ids = [np.asarray(encode(enc, x), np.int32) for x in part.column(at).to_pylist()]
        ends = np.cumsum([0, *(len(x) for x in ids)], dtype=np.int32)
        yield part, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): one row per row of docs, ids an array<int>, never null. Other columns are not read.

    Null and empty texts give []. Blank texts are encoded as they are. Repeated rows are encoded as often as they come.
    """
    path = path or ranks_path(docs.sparkSession)
    docs = docs.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, ids in _lists(b, 1, path):
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [key, "ids"])

    return docs.mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>")


def count_tokens(docs: DataFrame, text: str = "text", name: str = "n_tokens", path: str | None = None) -> DataFrame:
    """docs without the text, with the number of tokens (0 for null and empty texts)."""
    path = path or ranks_path(docs.sparkSession)
    rest = [c for c in docs.columns if c != text]
    docs = docs.select(text, *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            enc = encoder(path)
            n = pa.array([len(encode(enc, x)) for x in b.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i + 1) for i in range(len(rest))), n], [*rest, name])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest) + f", `{name}` bigint")


def ids_to_bytes(tokens: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, raw): the bytes of each list of ids; with encode_corpus an exact round trip."""
    path = path or ranks_path(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            enc = encoder(path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(enc, x) for x in b.column(1).to_pylist()], pa.binary())], [key, "raw"])

    return tokens.select(key, "ids").mapInArrow(run, f"{key} {tokens.schema[key].dataType.simpleString()}, raw binary")
