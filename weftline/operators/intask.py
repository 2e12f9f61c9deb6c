"""Traversals of one repo's graph within one task: all repos at once, one shuffle, no loop of jobs.

Repos are independent of each other, so a repo whose links fit a task (`LINKS` at most, a checked bound) is walked there over integer arrays: sets of roots are
rows of bits, a level is one gather and one OR per word for up to 64 roots at once. Many roots of a repo go to several tasks, `ROOTS` in each, and results
leave in batches, so neither roots nor what they reach must fit a task at once. Larger repos take the loops of joins in `traverse`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINKS = 1_000_000
"""Most links of one repo that one task walks."""
ROOTS = 4_096
"""Most roots of one task."""
_CELLS = 1 << 22
"""Most words that one level gathers at once."""

LINK, SEED, COUNTED = 0, 1, 2


class Walk:
    """The links of a group as arrays sorted by where they start, and its seeds."""

    def __init__(self, rows: pa.Table, reverse: bool) -> None:
        role = rows.column("role").to_numpy()
        both = pa.chunked_array([*rows.column("a").chunks, *rows.column("b").chunks], pa.string()).combine_chunks().dictionary_encode()
        if isinstance(both, pa.ChunkedArray):
            both = both.combine_chunks()
        self.names = both.dictionary
        codes = both.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        a, b = codes[: len(role)], codes[len(role) :]
        link = role == LINK
        s, t = (b[link], a[link]) if reverse else (a[link], b[link])
        order = np.lexsort((rows.column("ord").to_numpy(zero_copy_only=False)[link], s))
        self.n, self.to = len(self.names), t[order]
        self.start = np.searchsorted(s[order], np.arange(self.n + 1))
        self.root, self.seed = a[role == SEED], b[role == SEED]
        self.counted = np.unique(b[role == COUNTED])
        self.repo = rows.column("repo")[0].as_py() if len(role) else None

    def out(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of `at`, target) of all links that start there, in order."""
        lo, n = self.start[at], self.start[at + 1] - self.start[at]
        which = np.repeat(np.arange(len(at)), n)
        return which, self.to[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]

    def levels(self, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, Iterator[tuple[int, np.ndarray, np.ndarray]]]]:
        """For each set of roots: their codes, what has been seen (nodes x words, complete once the levels are through), and (depth, nodes, new bits) of each level."""
        roots = np.unique(self.root)
        words = max(1, min(64, _CELLS // max(1, len(self.to), self.n)))
        for first in range(0, len(roots), 64 * words):
            own = roots[first : first + 64 * words]
            w = -(-len(own) // 64)
            seen = np.zeros((self.n, w), np.uint64)
            mine = np.flatnonzero((self.root >= own[0]) & (self.root <= own[-1]))
            bit = np.searchsorted(own, self.root[mine])
            np.bitwise_or.at(seen, (self.seed[mine], bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))

            def go(seen: np.ndarray = seen) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
                at = np.flatnonzero(seen.any(1))
                bits, depth = seen[at], 0
                while len(at):
                    yield depth, at, bits
                    if most is not None and depth >= most:
                        return
                    which, to = self.out(at)
                    if not len(to):
                        return
                    order = np.argsort(to, kind="stable")
                    to = to[order]
                    heads = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
                    bits = np.bitwise_or.reduceat(bits[which[order]], heads, axis=0)
                    at = to[heads]
                    bits &= ~seen[at]
                    some = bits.any(1)
                    at, bits, depth = at[some], bits[some], depth + 1
                    seen[at] |= bits

            yield own, seen, go()


def _bits(bits: np.ndarray) -> np.ndarray:
    """rows x 64 words as rows x roots of 0 and 1."""
    return np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1, bitorder="little")


def _batch(walk: Walk, *cols: tuple[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    n = len(cols[0][1])
    return pa.RecordBatch.from_arrays([pa.array([walk.repo] * n, pa.string()), *(x if isinstance(x, pa.Array) else pa.array(x) for _, x in cols)], ["repo", *(c for c, _ in cols)])


def _named(walk: Walk, codes: np.ndarray) -> pa.Array:
    return walk.names.take(pa.array(codes))


def _per_group(rows: DataFrame, reverse: bool, each: Callable[[Walk], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(Walk(pa.Table.from_batches(batches), reverse))

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return rows.groupBy("repo", "block").applyInArrow(run, schema)


def _rows(links: DataFrame, seeds: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """(repo, block, role, a, b, ord): seeds (repo, root, id) cut into blocks of whole roots, each with the links (repo, src, dst[, ord]) of its repo."""
    n = seeds.groupBy("repo").agg(F.ceil(F.count_distinct("root") / ROOTS).cast("int").alias("blocks"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    ord_ = F.col("ord") if "ord" in links.columns else F.lit(0).cast("bigint")
    out = links.join(n, "repo").select("repo", every, F.lit(LINK).alias("role"), F.col("src").alias("a"), F.col("dst").alias("b"), ord_.alias("ord"))
    own = seeds.join(n, "repo").select("repo", F.pmod(F.xxhash64("root"), F.col("blocks")).cast("int").alias("block"), F.lit(SEED).alias("role"), F.col("root").alias("a"), F.col("id").alias("b"), F.lit(0).cast("bigint").alias("ord"))
    out = out.unionByName(own)
    if counted is not None:
        out = out.unionByName(counted.join(n, "repo").select("repo", every, F.lit(COUNTED).alias("role"), F.lit(None).cast("string").alias("a"), F.col("id").alias("b"), F.lit(0).cast("bigint").alias("ord")))
    return out


def closure(links: DataFrame, seeds: DataFrame, reverse: bool = False, most: int | None = None) -> DataFrame:
    """(repo, root, id, depth), as traverse.closure says it."""

    def each(walk: Walk) -> Iterator[pa.RecordBatch]:
        for own, _, levels in walk.levels(most):
            for depth, at, bits in levels:
                step = max(1, _CELLS // (64 * bits.shape[1]))
                for s in range(0, len(at), step):
                    node, root = np.nonzero(_bits(bits[s : s + step]))
                    yield _batch(walk, ("root", _named(walk, own[root])), ("id", _named(walk, at[s + node])), ("depth", np.full(len(node), depth, np.int64)))

    return _per_group(_rows(links, seeds), reverse, each, "repo string, root string, id string, depth bigint")


def reach(links: DataFrame, seeds: DataFrame, counted: DataFrame | None = None, reverse: bool = False) -> DataFrame:
    """(repo, root, n): how many different ids each root reaches, seeds included; only those among counted (repo, id), if given; roots that reach none give no row. No pair leaves the task."""

    every = counted is None

    def each(walk: Walk) -> Iterator[pa.RecordBatch]:
        for own, seen, levels in walk.levels(None):
            for _ in levels:
                pass
            rows = seen if every else seen[walk.counted]
            n = np.zeros(64 * seen.shape[1], np.int64)
            step = max(1, _CELLS // (64 * seen.shape[1]))
            for s in range(0, len(rows), step):
                n += _bits(rows[s : s + step]).sum(0, dtype=np.int64)
            some = np.flatnonzero(n[: len(own)])
            yield _batch(walk, ("root", _named(walk, own[some])), ("n", n[some]))

    return _per_group(_rows(links, seeds, counted), reverse, each, "repo string, root string, n bigint")


def first_root(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(repo, id, root): the least of the roots (repo, id) that reaches an id, itself included. One number per id moves along the links until none gets smaller."""

    def each(walk: Walk) -> Iterator[pa.RecordBatch]:
        names = np.array(_named(walk, walk.seed).to_pylist(), object)
        order = np.argsort(names, kind="stable")
        none = len(order)
        label = np.full(walk.n, none)
        label[walk.seed[order]] = np.arange(none)
        at = np.unique(walk.seed)
        while len(at):
            which, to = walk.out(at)
            new = label.copy()
            np.minimum.at(new, to, label[at][which])
            at = np.flatnonzero(new < label)
            label = new
        known = np.flatnonzero(label < none)
        yield _batch(walk, ("id", _named(walk, known)), ("root", pa.array(names[order][label[known]].tolist(), pa.string())))

    seeds = roots.select("repo", F.lit("").alias("root"), "id")  # one block: labels of all roots meet
    return _per_group(_rows(links, seeds), False, each, "repo string, id string, root string")


def trace(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """(repo, src, dst, step, id), as traverse.trace says it; links: (repo, src, dst, ord). Breadth first in the order of ord, so who is found first came by the least ords."""

    def each(walk: Walk) -> Iterator[pa.RecordBatch]:
        for a, b in sorted(set(zip(walk.root.tolist(), walk.seed.tolist(), strict=True))):
            came = np.full(walk.n, -1)
            came[a] = a
            level = np.array([a])
            while len(level) and came[b] < 0:
                which, to = walk.out(level)
                new = came[to] < 0
                which, to = which[new], to[new]
                _, first = np.unique(to, return_index=True)
                first.sort()
                came[to[first]] = level[which[first]]
                level = to[first]
            if came[b] < 0:
                continue
            path = [b]
            while path[-1] != a:
                path.append(int(came[path[-1]]))
            codes = np.array(path[::-1])
            yield _batch(walk, ("src", _named(walk, np.full(len(codes), a))), ("dst", _named(walk, np.full(len(codes), b))), ("step", np.arange(len(codes), dtype=np.int32)), ("id", _named(walk, codes)))

    seeds = pairs.select("repo", F.col("src").alias("root"), F.col("dst").alias("id"))
    return _per_group(_rows(links, seeds), False, each, "repo string, src string, dst string, step int, id string")
