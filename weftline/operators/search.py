"""Lexical, semantic and fused search."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import query_tokens, stem_of, tokens
from weftline.functions.vectors import dot, normalize
from weftline.operators.graph import Graph
from weftline.sources.scratch import keep, place

# BM25's parameters, the depth of each list before fusion, and the constant of reciprocal rank fusion.
K1, B, DEPTH, RRF = 1.2, 0.75, 200, 60


def node_text() -> Column:
    return F.concat_ws(" ", "name", "package", "signature", "doc", "id")


def _is(term: str) -> Callable[[Column], Column]:
    return lambda x: x == F.lit(term)


def bm25_scores(docs: DataFrame, keys: list[str], text: Column, query: str, by: list[str] | None = None, stems: bool = True) -> DataFrame:
    """(keys, score) of the documents with a score above 0. Statistics are over all documents of each `by` group (over all, if none).

    Only counts of the query's terms are kept of a document, so the index pass is one scan and one aggregate of a few numbers per group: nothing per
    term is shuffled. Terms that the query repeats count as often. An empty query or table gives no rows; null texts have no tokens.
    """
    by = by or []
    terms = query_tokens(query, stems)
    once = list(dict.fromkeys(terms))
    toks = docs.select(*keys, *[c for c in by if c not in keys], tokens(F.coalesce(text, F.lit("")), stems).alias("_t"))
    tf = toks.select(*[c for c in toks.columns if c != "_t"], F.size("_t").alias("_len"), *(F.size(F.filter("_t", _is(t))).alias(f"_tf{i}") for i, t in enumerate(once)))
    tf = keep(tf, "tf")  # a few numbers per document; tokens cost more than a read
    stats = tf.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(once))))
    some = tf.where(" OR ".join(f"_tf{i} > 0" for i in range(len(once))) or "false")
    if by:
        some = some.join(stats, by)
    else:
        some = some.crossJoin(F.broadcast(stats))  # one row
    score: Column = F.lit(0.0)
    for t in terms:
        i = once.index(t)
        f, df, n = F.col(f"_tf{i}"), F.col(f"_df{i}"), F.col("_n")
        idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        score = score + idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return some.select(*keys, score.alias("score")).where("score > 0")


@dataclass
class Index:
    """Postings (repo, term, id, tf), in folders by bucket of the term; lengths (repo, id, len) and statistics (repo, n, avg) of the documents."""

    postings: str
    lengths: DataFrame
    stats: DataFrame
    buckets: int
    stems: bool


def build_index(docs: DataFrame, text: Column, stems: bool = True, buckets: int = 256) -> Index:
    """The inverted index of documents (repo, id, ...), built once for any number of queries.

    Tokens are counted per document, distinct tokens are stemmed once each, and every token and every stem that differs is a term, as many times as it came. A query
    reads the buckets of its terms and nothing else of the postings.
    """
    spark = docs.sparkSession
    words = docs.select("repo", "id", F.explode_outer(tokens(F.coalesce(text, F.lit("")), False)).alias("token")).groupBy("repo", "id", "token").agg(F.count("token").alias("n"))
    words = keep(words, "words")
    counted = words.where("token IS NOT NULL")
    if stems:
        stemmed = keep(counted.select("token").distinct().withColumn("stem", stem_of("token")).where("stem <> token"), "stems")
        counted = counted.unionByName(counted.join(stemmed, "token").select("repo", "id", F.col("stem").alias("token"), "n"))
    terms = counted.groupBy("repo", "id", F.col("token").alias("term")).agg(F.sum("n").alias("tf"))
    path = place(spark, "postings")
    terms = terms.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    terms.repartitionByRange("bucket", "term", "repo", "id").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)  # by range: a term that all have is cut
    lengths = words.select("repo", "id", F.lit(0).cast("bigint").alias("n")).unionByName(counted.select("repo", "id", "n")).groupBy("repo", "id").agg(F.sum("n").alias("len"))
    lengths = keep(lengths, "lengths")
    return Index(path, lengths, keep(lengths.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg")), "stats"), buckets, stems)


def index_scores(index: Index, query: str) -> DataFrame:
    """(repo, id, score) as bm25_scores has them, per repo, from an index. Terms that the query repeats count as often."""
    spark = index.lengths.sparkSession
    terms = query_tokens(query, index.stems)
    if not terms:
        return spark.createDataFrame([], "repo string, id string, score double")
    asked = spark.createDataFrame(list(Counter(terms).items()), "term string, times bigint").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(index.buckets)).cast("int"))
    folders = sorted({r.bucket for r in asked.select("bucket").collect()})
    found = spark.read.schema("repo string, id string, term string, tf bigint, bucket int").parquet(index.postings).where(F.col("bucket").isin(*folders) & F.col("term").isin(*set(terms)))
    df = found.groupBy("repo", "term").agg(F.count(F.lit(1)).alias("df"))
    rows = found.join(F.broadcast(asked.select("term", "times")), "term").join(df, ["repo", "term"]).join(index.stats, "repo").join(index.lengths, ["repo", "id"])  # asked: the query's terms
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    one = F.col("times") * idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    return rows.groupBy("repo", "id").agg(F.sum(one).alias("score")).where("score > 0")


def top(scores: DataFrame, keys: list[str], k: int, by: list[str] | None = None) -> DataFrame:
    """The k best by score, ties by keys, with rank from 0; per `by` group if given."""
    order = [F.desc("score"), *keys]
    if by:
        ranked = scores.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)
        return ranked.where(F.col("rank") < k)
    return scores.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)) - 1)  # k rows


def vector_scores(vectors: DataFrame, keys: list[str], query: list[float], column: str = "embedding") -> DataFrame:
    """(keys, score): cosine against one query vector, for vectors of its length. No threshold: negative scores stay."""
    q = normalize(F.array(*(F.lit(float(x)).cast("float") for x in query)))
    v = vectors.where(F.size(column) == len(query)).select(*keys, dot(q, normalize(F.col(column))).alias("score"))
    return v.where("score IS NOT NULL")


GROUP = 65_536
"""Rows of a group that a block of queries meets in one task, on average."""


def _best_of(qk: pa.Array, q: np.ndarray, rk: pa.Array, v: np.ndarray, k: int, key: str) -> pa.RecordBatch:
    """The k rows of highest inner product for each query; equal ones by key."""
    order = pa.compute.sort_indices(rk)
    rk, v = rk.take(order), v[order.to_numpy()]
    s = q @ v.T
    best = np.argsort(-s, axis=1, kind="stable")[:, :k]
    who = np.repeat(np.arange(len(q)), best.shape[1])
    return pa.RecordBatch.from_arrays([qk.take(pa.array(who)), rk.take(pa.array(best.ravel())), pa.array(np.take_along_axis(s, best, 1).ravel())], ["query", key, "score"])


def _dense(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n).astype(np.float64)


def vector_top(vectors: DataFrame, key: str, queries: DataFrame, k: int, column: str = "embedding", block: int = 2048) -> DataFrame:
    """(query, key, score): the k best rows for each row of queries, by inner product, ties by key.

    A stated set of queries against all rows. Up to `block` queries go to every task, which scores its rows batch by batch; more of them are cut into blocks of about that size that meet groups of
    rows of bounded size, so neither all queries nor all rows come together anywhere. Only the k best of a batch or group leave a task. Vectors that are null or hold nulls have no score, nor have
    those of another length than the query.
    """
    clean = lambda df: df.select(F.col(key).alias("key"), F.col(column).alias("v"), F.size(column).alias("n")).where("v IS NOT NULL AND n > 0 AND NOT exists(v, x -> x IS NULL)")
    rows, asked = clean(vectors), clean(queries)
    schema = f"query {dict(queries.dtypes)[key]}, `{key}` {dict(vectors.dtypes)[key]}, score double"
    few = asked.limit(block + 1).toArrow()
    if not few.num_rows:
        return vectors.sparkSession.createDataFrame([], schema)
    if few.num_rows <= block:
        parts = {n: few.filter(pa.compute.equal(few.column("n"), n)) for n in pa.compute.unique(few.column("n")).to_pylist()}
        sets = {n: (t.column("key").combine_chunks(), _dense(t.column("v"), n)) for n, t in parts.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for n, (qk, q) in sets.items():
                    own = b.filter(pa.compute.equal(b.column(2), n))
                    if own.num_rows:
                        yield _best_of(qk, q, own.column(0), _dense(own.column(1), n), k, key)

        out = rows.mapInArrow(run, schema)
    else:
        blocks, groups = -(-asked.count() // block), -(-rows.count() // GROUP)
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        deal = lambda m: F.pmod(F.xxhash64("key"), F.lit(m)).cast("int")
        both = rows.select("n", deal(groups).alias("group"), every(blocks).alias("block"), F.lit(False).alias("asks"), "key", "v").unionByName(asked.select("n", every(groups).alias("group"), deal(blocks).alias("block"), F.lit(True).alias("asks"), "key", "v"))

        def meet(t: pa.Table) -> pa.Table:
            asks = t.column("asks")
            q, own, n = t.filter(asks), t.filter(pa.compute.invert(asks)), t.column("n")[0].as_py()
            if not q.num_rows or not own.num_rows:
                return pa.table({"query": q.column("key").slice(0, 0), key: own.column("key").slice(0, 0), "score": pa.array([], pa.float64())})
            return pa.Table.from_batches([_best_of(q.column("key").combine_chunks(), _dense(q.column("v"), n), own.column("key").combine_chunks(), _dense(own.column("v"), n), k, key)])

        out = both.groupBy("n", "group", "block").applyInArrow(meet, schema)
    best = W.partitionBy("query").orderBy(F.desc("score"), key)
    return out.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def rrf(lists: list[DataFrame], keys: list[str]) -> DataFrame:
    """(keys, score): the sum of 1 / (60 + rank) over ranked lists, ranks from 0."""
    every = lists[0].select(*keys, "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select(*keys, "rank"))
    return every.groupBy(*keys).agg(F.sum(1 / (F.lit(RRF) + F.col("rank"))).alias("score"))


def search(g: Graph, query: str, limit: int = 20, vector: list[float] | None = None, vectors: DataFrame | None = None, stems: bool = True, index: Index | None = None) -> DataFrame:
    """(repo, id, score, rank): lexical hits, fused with semantic ones if there is a query vector. A limit that is not positive is 20. With an index no text is read."""
    limit = limit if limit > 0 else 20
    keys = ["repo", "id"]
    scores = bm25_scores(g.nodes, keys, node_text(), query, ["repo"], stems) if index is None else index_scores(index, query)
    lexical = top(scores, keys, DEPTH)
    if vector is None or vectors is None:
        return lexical.where(F.col("rank") < limit)
    return top(rrf([lexical, top(vector_scores(vectors, keys, vector), keys, DEPTH)], keys), keys, limit)


def embed(nodes: DataFrame, client: Callable[[list[str]], list[list[float]]], batch: int = 100) -> DataFrame:
    """(repo, id, embedding): texts sent to a client in batches; a count that differs is an error. Vectors are of length one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, batch):
                part = b.slice(s, batch)
                got = client(part.column(2).to_pylist())
                if len(got) != part.num_rows:
                    raise ValueError(f"{part.num_rows} texts sent, {len(got)} vectors received")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.list_(pa.float32()))], ["repo", "id", "embedding"])

    texts = nodes.select("repo", "id", node_text().alias("text"))
    return texts.mapInArrow(run, "repo string, id string, embedding array<float>").withColumn("embedding", normalize(F.col("embedding")))


def most_used(g: Graph, n: int) -> DataFrame:
    """The n nodes with most edges into them (ties by repo, id): those worth embedding first."""
    from weftline.operators.lookup import in_degree

    return g.nodes.join(in_degree(g.edges), ["repo", "id"], "left").orderBy(F.desc(F.coalesce("in_degree", F.lit(0))), "repo", "id").limit(n)
