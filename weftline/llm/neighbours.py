"""Problem 6: the most similar vectors for every vector.

Score-aware quantisation for maximum inner product: vectors of length one are cut into a coarse centroid and a residual, whose direction is
coded in 16 parts of 4 numbers with 4 bits each. Centres and codes minimise a loss that weighs the error along the vector
(which changes its score against its neighbours) `ETA` times as much as the error across it. A query scans the codes of the lists it probes: the sum of its 16 table
entries is its product with the decoded vector, which, divided by the vector's own, estimates the score without bias; how far estimates are off follows from the angle
between a vector and its code. Whoever may still be among the k best by `SIGMAS` of that error is scored again with its exact vector, however many that are: there is no cap on candidates.

Lists are in proportion to the vectors, up to MOST_LISTS; longer lists are cut once more where they are scanned, by centres fitted there. Lists that lie close
together share a block, and a query travels once to each block that holds a list it probes. Blocks are cut by lists, not by hash, and have a bounded size, as have the queries that meet
them: no task holds more than about BLOCK vectors and QUERIES queries. The codebooks are fitted on the driver to a bounded sample (`SAMPLE` vectors, or 16 a list);
everything else runs over all vectors. Exact copies are collapsed before the search and expanded after it, so that a vector under many ids costs one entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.hotkeys import hot_keys, spread
from weftline.sources.scratch import keep

DIM = 64
PARTS, CENTRES = 16, 16
ETA = 2.625
"""(DIM - 1) * t^2 / (1 - t^2) at t = 0.2: the weight of parallel error for scores above t."""
SAMPLE = 32_768
LIST = 512
"""Vectors per list, on average, up to MOST_LISTS lists."""
MOST_LISTS = 16_384
AREA = 16
"""Lists per block, at most."""
BLOCK, QUERIES = 65_536, 65_536
PROBES, FEW_LISTS, SUB_PROBES = 32, 64, 8
"""Lists that a query probes by rank. Up to FEW_LISTS lists the number holds; beyond, it grows with the fourth root of the number of lists. SUB_PROBES: of the parts of a long list."""
DENSE = 0.85
"""A query also probes every list whose centre is so near: if all of a list are at least so near to a query, then so is their mean."""
SIGMAS = 4.0
"""Standard deviations of an estimate's error by which a vector may still be among the k best."""
SLACK = 1e-5
"""More than the error of a score in single precision."""
_CELLS = 1 << 22


@dataclass
class Codebook:
    """coarse: lists x DIM, unit length. fine: PARTS x CENTRES x DIM/PARTS. area: the area of each list."""

    coarse: np.ndarray
    fine: np.ndarray
    area: np.ndarray


def _codes(x: np.ndarray, r: np.ndarray, fine: np.ndarray, sweeps: int = 2) -> np.ndarray:
    """Codes of residuals r of unit vectors x, by coordinate descent on the score-aware loss."""
    n, w = len(x), DIM // PARTS
    xs, rs = x.reshape(n, PARTS, w), r.reshape(n, PARTS, w)
    codes = np.empty((n, PARTS), np.uint8)
    for m in range(PARTS):  # nearest centres to begin with
        codes[:, m] = (-2 * rs[:, m] @ fine[m].T + (fine[m] ** 2).sum(1)).argmin(1)
    along = np.stack([((rs[:, m] - fine[m][codes[:, m]]) * xs[:, m]).sum(1) for m in range(PARTS)], 1)
    total = along.sum(1)
    for _ in range(sweeps):
        for m in range(PARTS):
            other = total - along[:, m]
            size = (rs[:, m] ** 2).sum(1)[:, None] - 2 * rs[:, m] @ fine[m].T + (fine[m] ** 2).sum(1)
            par = (rs[:, m] * xs[:, m]).sum(1)[:, None] - xs[:, m] @ fine[m].T
            best = (size + (ETA - 1) * (other[:, None] + par) ** 2).argmin(1)
            codes[:, m] = best
            along[:, m] = par[np.arange(n), best]
            total = other + along[:, m]
    return codes


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        sums = np.zeros(centres.shape, np.float64)
        np.add.at(sums, _nearest(x, centres, 1)[:, 0], x)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where((size < 1e-9)[:, None], x[rng.integers(0, len(x), k)], sums / np.maximum(size, 1e-9)[:, None]).astype(np.float32)
    return centres


def _tree_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int) -> np.ndarray:
    """k centres; many of them in two steps, so that no vector is compared with all."""
    if k <= 1024:
        return _means(x, k, rng, rounds)
    top = _means(x, int(k**0.5), rng, rounds)
    own = _nearest(x, top, 1)[:, 0]
    size = np.bincount(own, minlength=len(top))
    parts = np.maximum(1, np.floor(k * size / len(x)).astype(int)) * (size > 0)
    return np.concatenate([_means(x[own == i], int(parts[i]), rng, rounds) for i in np.flatnonzero(size)])


def fit(sample: np.ndarray, lists: int, seed: int = 0, rounds: int = 8) -> Codebook:
    """Codebooks from a sample of unit vectors: spherical k-means, then score-aware centres of each part of the residuals' directions."""
    rng = np.random.default_rng(seed)
    coarse = _tree_means(sample, lists, rng, rounds)
    few = sample if len(sample) <= SAMPLE else sample[rng.choice(len(sample), SAMPLE, replace=False)]
    r = few - coarse[_nearest(few, coarse, 1)[:, 0]]
    r = r / np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-12)
    w = DIM // PARTS
    xs, rs = few.reshape(-1, PARTS, w), r.reshape(-1, PARTS, w)
    fine = np.stack([rs[rng.choice(len(few), CENTRES, replace=len(few) < CENTRES), m] for m in range(PARTS)]).astype(np.float32)
    for k in range(rounds):
        codes = _codes(few, r, fine, sweeps=0 if k < rounds // 2 else 1)
        along = np.stack([((rs[:, m] - fine[m][codes[:, m]]) * xs[:, m]).sum(1) for m in range(PARTS)], 1)
        total = along.sum(1)
        for m in range(PARTS):
            # least squares of |r - c|^2 + (ETA - 1) (a + x.(r - c))^2 over the points of each centre
            a = total - along[:, m]
            weigh = (ETA - 1) if k >= rounds // 2 else 0.0
            right = rs[:, m] + weigh * xs[:, m] * (a + (xs[:, m] * rs[:, m]).sum(1))[:, None]
            left = np.eye(w) + weigh * xs[:, m][:, :, None] * xs[:, m][:, None, :]
            for c in range(CENTRES):
                on = codes[:, m] == c
                if on.any():
                    fine[m, c] = np.linalg.solve(left[on].sum(0), right[on].sum(0))
    areas = _means(coarse, -(-len(coarse) // AREA), rng, rounds)
    return Codebook(coarse, fine.astype(np.float32), _nearest(coarse, areas, 1)[:, 0])


def _nearest(x: np.ndarray, coarse: np.ndarray, k: int, step: int = 4096) -> np.ndarray:
    """The k lists of highest inner product for each row, best first."""
    k = min(k, len(coarse))
    out = np.empty((len(x), k), np.int32)
    for s in range(0, len(x), step):
        score = x[s : s + step] @ coarse.T
        top = np.argpartition(-score, k - 1, axis=1)[:, :k] if k < len(coarse) else np.tile(np.arange(k), (len(score), 1))
        order = np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable")
        out[s : s + step] = np.take_along_axis(top, order, 1)
    return out


def _matrix(column: pa.Array | pa.ChunkedArray, width: int, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(id, vec): the vectors of length one as bytes of float32, one per id.

    Left out: null ids, vectors that are null, not DIM long, all zero, or hold nulls or numbers that are not finite. Repeated rows count once; should
    an id have different vectors, the smallest by elements holds.
    """
    ok = vectors.select("id", "embedding").where(f"id IS NOT NULL AND size(embedding) = {DIM} AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = float('inf')) AND exists(embedding, x -> x <> 0)")
    one = ok.groupBy("id").agg(F.min("embedding").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            x = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM).astype(np.float64)
            x /= np.abs(x).max(1, keepdims=True)  # else squares of tiny numbers vanish
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())], ["id", "vec"])

    return one.mapInArrow(run, "id string, vec binary")


def _coded(rows: DataFrame, book: Codebook, n_probes: int) -> DataFrame:
    """(id, vec, list, codes, probes): probes are the lists that the vector, as a query, probes, the nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), DIM, np.float32)
            probes = _nearest(x, book.coarse, n_probes)
            r = x - book.coarse[probes[:, 0]]
            codes = _codes(x, r / np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-12), book.fine)
            packed = (codes[:, 0::2] << 4) | codes[:, 1::2]
            every = list(probes)
            for s in range(0, len(x), 1024):
                dense = x[s : s + 1024] @ book.coarse.T >= DENSE
                dense[np.arange(len(dense))[:, None], probes[s : s + 1024]] = False
                for i in np.flatnonzero(dense.any(1)).tolist():
                    every[s + i] = np.concatenate([probes[s + i], np.flatnonzero(dense[i])])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(probes[:, 0]), pa.array([c.tobytes() for c in packed], pa.binary()), pa.array(every, pa.list_(pa.int32()))], ["id", "vec", "list", "codes", "probes"])

    return rows.mapInArrow(run, "id string, vec binary, list int, codes binary, probes array<int>")


def _blocks(held: dict[int, int], book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """(first block, blocks) of each list: up to AREA lists of one area that hold up to BLOCK vectors share a block; a longer list has blocks of its own."""
    first, many = np.zeros(len(book.coarse), np.int32), np.ones(len(book.coarse), np.int32)
    block, size, count, area = -1, 0, 0, -1
    for x in np.lexsort((np.arange(len(first)), book.area)).tolist():
        n = held.get(x, 0)
        if block < 0 or area != book.area[x] or count >= AREA or size + n > BLOCK:
            block, size, count, area = block + 1, 0, 0, book.area[x]
        first[x], size, count = block, size + n, count + 1
        if n > BLOCK:
            many[x] = -(-n // BLOCK)
            block += int(many[x]) - 1
    return first, many


def _routed(coded: DataFrame, first: np.ndarray, many: np.ndarray, count: bool = False) -> DataFrame:
    """(id, vec, block, lists): each query once for every block that holds lists it probes, with those. count: the blocks alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            probes = b.column(0)
            row = np.repeat(np.arange(b.num_rows), np.diff(probes.offsets.to_numpy()))
            x = probes.flatten().to_numpy()
            times = many[x]
            row, x, step = np.repeat(row, times), np.repeat(x, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            block = first[x] + step
            order = np.lexsort((np.arange(len(x)), block, row))  # the order of the probes stays within a block
            row, x, block = row[order], x[order], block[order]
            heads = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])))) if len(row) else np.empty(0, np.int64)
            blocks = pa.array(block[heads].astype(np.int32))
            if count:
                yield pa.RecordBatch.from_arrays([blocks], ["block"])
                continue
            lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(x)).astype(np.int32)), pa.array(x.astype(np.int32)))
            who = pa.array(row[heads])
            yield pa.RecordBatch.from_arrays([b.column(1).take(who), b.column(2).take(who), blocks, lists], ["id", "vec", "block", "lists"])

    return coded.select("probes", *[] if count else ["id", "vec"]).mapInArrow(run, "block int" if count else "id string, vec binary, block int, lists array<int>")


def _decoded(d: np.ndarray, centre: np.ndarray, codes: np.ndarray, fine: np.ndarray) -> np.ndarray:
    """What a query is multiplied with to scan a list: the decoded vectors over their product with the exact ones, and the error of such an estimate in standard deviations of 1 / sqrt(DIM - 1)."""
    said = np.concatenate([fine[m][(codes[m // 2] >> 4) if m % 2 == 0 else (codes[m // 2] & 15)] for m in range(PARTS)], 1)
    r = d - centre
    said = centre + np.linalg.norm(r, axis=1, keepdims=True) * said
    own = (said * d).sum(1)
    tan = np.sqrt(np.maximum((said**2).sum(1) / np.maximum(own, 1e-3) ** 2 - 1, 0))
    off = np.where(own > 0.05, SIGMAS / (DIM - 1) ** 0.5 * tan + SLACK, 9.0)
    return np.concatenate([said / np.maximum(own, 0.05)[:, None], off[:, None]], 1).astype(np.float32)


def _candidates(q: np.ndarray, qid: np.ndarray, least: np.ndarray, d: np.ndarray, did: np.ndarray, scan: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place in d, exact score) of all of d that may be among the k best of a query, given that k of score `least` or more are known. did is sorted.

    s >= least needs an estimate of at least least - off * sqrt(1 - least^2), as the error of an estimate shrinks towards score 1.
    """
    some = np.ones((len(q), len(d)), bool)
    if scan is not None:
        c = np.where(least > 0, np.sqrt(np.maximum(1 - np.minimum(least, 1) ** 2, 0)), 1.0)
        some = np.concatenate([q, c[:, None].astype(np.float32)], 1) @ scan.T >= (least - SLACK)[:, None].astype(np.float32)
    if some.mean() > 0.05:  # too many for one by one: single precision tells who can't be
        score = q @ d.T
        at = np.minimum(np.searchsorted(did, qid), len(did) - 1)
        own = did[at] == qid
        score[own, at[own]] = -np.inf
        low = least - SLACK
        if len(d) > k:
            low = np.maximum(low, np.partition(score, len(d) - k, axis=1)[:, len(d) - k] - 2 * SLACK)
        some &= score >= low[:, None]
    row, col = np.nonzero(some)
    keep_ = did[col] != qid[row]
    row, col = row[keep_], col[keep_]
    exact = np.empty(len(row))
    for s in range(0, len(row), 1 << 16):
        exact[s : s + (1 << 16)] = np.einsum("ij,ij->i", q[row[s : s + (1 << 16)]].astype(np.float64), d[col[s : s + (1 << 16)]].astype(np.float64))
    return row, col, exact


def _search(book: Codebook, k: int, least: float, exact: bool):
    """Queries and vectors of one (block, query block): the k best of the block for each query, exactly scored."""

    def best(a: np.ndarray, b: np.ndarray, c: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((rank[b], -c, a))
        a, b, c = a[order], b[order], c[order]
        few = np.arange(len(a)) - np.searchsorted(a, a) < k
        return a[few], b[few], c[few]

    def run(t: pa.Table) -> pa.Table:
        is_query = t.column("query").to_numpy(zero_copy_only=False).astype(bool)
        ids = np.array(t.column("id").to_pylist(), object)
        vecs = _matrix(t.column("vec"), DIM, np.float32)
        lists = t.column("lists").to_pylist()
        qid, q = ids[is_query], vecs[is_query]
        did, d = ids[~is_query], vecs[~is_query]
        got = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)  # query, vector, score
        if len(did) and len(qid):
            codes = _matrix(t.filter(pa.array(~is_query)).column("codes"), PARTS // 2, np.uint8)
            # the nearest list of each query first: what is found there rules out most of the others
            asked: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
            for i, ls in enumerate(x for x, y in zip(lists, is_query, strict=True) if y):
                for j, x in enumerate(ls):
                    asked[j > 0].setdefault(x, []).append(i)
            own = np.fromiter((x[0] for x, y in zip(lists, is_query, strict=True) if not y), np.int64, len(did))
            order = np.lexsort((did, own))
            rank = np.argsort(np.argsort(did, kind="stable"), kind="stable")
            found, parts = np.full(len(q), least), {}
            for turn in asked:
                out = [got]
                for x, who in turn.items():
                    if x not in parts:
                        parts[x] = [*_pieces(x, order[slice(*np.searchsorted(own[order], [x, x + 1]))], d, did, codes, book, exact)]
                    for at, scan, centre in parts[x]:
                        mine = np.array(who)
                        if centre is not None:  # one of the pieces of a long list
                            mine = mine[centre[0](q[mine])]
                        step = max(16, min(4096, _CELLS // max(1, len(at))))
                        for s in range(0, len(mine), step):
                            w = mine[s : s + step]
                            row, col, score = _candidates(q[w], qid[w], found[w], d[at], did[at], scan, k)
                            hit = score >= least
                            out.append((w[row[hit]], at[col[hit]], score[hit]))
                got = best(*(np.concatenate(c) for c in zip(*out, strict=True)), rank)
                full = np.flatnonzero(np.bincount(got[0], minlength=len(q)) >= k)
                last = np.searchsorted(got[0], full, side="right") - 1
                found[full] = np.maximum(found[full], got[2][last])
        a, b, c = got
        return pa.table({"id": pa.array(qid[a], pa.string()), "other": pa.array(did[b], pa.string()), "score": pa.array(c, pa.float64())})

    return run


def _pieces(x: int, at: np.ndarray, d: np.ndarray, did: np.ndarray, codes: np.ndarray, book: Codebook, exact: bool) -> Iterator[tuple]:
    """(places in d, scan, None or who asks for it) of a list: one piece, or, of a long list, pieces of about LIST vectors around centres fitted here."""
    if not len(at):
        return
    scan = None if exact or len(at) < 32 else _decoded(d[at], book.coarse[x], codes[at].T.copy(), book.fine)
    if exact or len(at) <= 4 * LIST:
        yield at, scan, None
        return
    rng = np.random.default_rng(x)
    some = d[at] if len(at) <= SAMPLE else d[at[rng.choice(len(at), SAMPLE, replace=False)]]
    centres = _means(some, len(at) // LIST, rng, 4)
    own = _nearest(d[at], centres, 1)[:, 0]

    def asks(j: int):
        def which(q: np.ndarray) -> np.ndarray:
            s = q @ centres.T
            kth = np.partition(s, max(0, len(centres) - SUB_PROBES), axis=1)[:, max(0, len(centres) - SUB_PROBES)]
            return (s[:, j] >= kth) | (s[:, j] >= DENSE)

        return which

    for j in np.unique(own).tolist():
        yield at[own == j], scan[own == j], (asks(j),)


def neighbours(vectors: DataFrame, k: int = 5, least: float = -2.0, probes: int = PROBES, exact: bool = False) -> DataFrame:
    """(id, other, score): the k other ids of highest cosine for each id, those of at least `least`; ties go to the smaller id.

    The search is approximate in which lists a query probes and in the few vectors whose estimate is off by more than SIGMAS (see the README for measured recall). exact: every list, scored in
    whole. Fewer than k + 1 vectors give fewer rows, an empty table none. With a `least`, nothing below it is moved at all.
    """
    units = keep(unit_vectors(vectors), "units")
    spark = units.sparkSession
    # exact copies: the smallest id stands for them
    classes = keep(units.groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    n = classes.count()
    if not n:
        return spark.createDataFrame([], "id string, other string, score double")
    # the hash decides who is in the sample, so a rerun finds the same codebooks
    lists = min(MOST_LISTS, max(1, round(n / LIST)))
    size = max(SAMPLE, 16 * lists)
    share = min(1.0, 1.05 * size / n)
    sample = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("vec").limit(size).toArrow()
    book = fit(_matrix(sample.column("vec"), DIM, np.float32).copy() if sample.num_rows else np.eye(1, DIM, dtype=np.float32), lists)
    probes = len(book.coarse) if exact else max(probes, round(probes * (len(book.coarse) / FEW_LISTS) ** 0.25))
    coded = keep(_coded(classes.select(F.col("rep").alias("id"), "vec"), book, probes), "coded")
    # there are at most MOST_LISTS rows of sizes
    held = {r.list: r.n for r in coded.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, many = _blocks(held, book)
    asks = _routed(coded, first, many)
    asked = {r.block: r.n for r in _routed(coded, first, many, count=True).groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = F.broadcast(spark.createDataFrame([(x, int(first[x]), int(many[x])) for x in range(len(first))], "list int, first int, many int"))
    cuts = F.broadcast(spark.createDataFrame([(b, 1 + m // QUERIES) for b, m in asked.items()], "block int, qblocks int"))
    data = coded.join(where, "list").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("many"))).cast("int")).join(cuts, "block")
    data = data.select("block", F.explode(F.sequence(F.lit(0), F.col("qblocks") - 1)).alias("qblock"), F.lit(False).alias("query"), "id", "vec", "codes", F.array("list").alias("lists"))
    asks = asks.join(cuts, "block").select("block", F.pmod(F.xxhash64("id"), F.col("qblocks")).cast("int").alias("qblock"), F.lit(True).alias("query"), "id", "vec", F.lit(None).cast("binary").alias("codes"), "lists")
    near = data.unionByName(asks).groupBy("block", "qblock").applyInArrow(_search(book, k, least, exact), "id string, other string, score double")
    best = W.partitionBy("id").orderBy(F.desc("score"), "other")
    near = keep(near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r"), "near")  # between classes
    if not classes.where("copies > 1").take(1):
        return near
    # copies: each class is known by its k + 1 smallest ids; the partial row number keeps no more of a class in any task
    copied = classes.where("copies > 1").select("vec", "rep")
    members = keep(units.join(copied, "vec").select("id", "rep"), "members")
    few = members.withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1).select("rep", F.col("id").alias("other"))
    few = keep(few, "few")
    # only copied classes, and those with one of them among their nearest, get another list than the one found
    heads = copied.select("rep")
    changed = keep(near.join(heads.withColumnRenamed("rep", "other"), "other", "left_semi").select(F.col("id").alias("rep")).unionByName(heads).distinct(), "changed")
    same = near.join(changed.withColumnRenamed("rep", "id"), "id", "left_anti")
    rest = near.withColumnsRenamed({"id": "rep", "other": "o_rep"}).join(changed, "rep", "left_semi")
    rest = rest.join(few.withColumnsRenamed({"rep": "o_rep", "other": "member"}), "o_rep", "left").select("rep", F.coalesce("member", "o_rep").alias("other"), "score")
    options = few.withColumn("score", F.lit(1.0)).unionByName(rest)
    who = members.unionByName(changed.join(heads, "rep", "left_anti").select(F.col("rep").alias("id"), "rep"))
    hot = keep(hot_keys(members, ["rep"]), "hot")
    a, b = spread(who, options, ["rep"], F.col("id"), hot)
    both = a.join(b, ["rep", "salt"]).where("id <> other AND score >= " + repr(least))
    new = both.select("id", "other", "score", F.row_number().over(best).alias("r")).where(F.col("r") <= k).drop("r")
    return same.select("id", "other", "score").unionByName(new)


def similar_pairs(vectors: DataFrame, k: int = 5, least: float = 0.85) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of which one is among the other's k nearest, with a cosine of at least `least`."""
    near = neighbours(vectors, k, least)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
