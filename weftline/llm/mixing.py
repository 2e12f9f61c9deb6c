"""Problem 8: mixing sources to target weights.

The mix has as many tokens as are asked for, or else as the scarcest source allows: the largest total at which no source needs more than its documents,
each used max_repeats times. Sainte-Laguë apportionment deals that total as equal-token blocks: block after block goes to the
source with the highest quotient weight / (2 * blocks + 1), so every run of consecutive blocks (a shard) has the target shares
as well as integers can. There are as many blocks as the smallest weight needs. Each source then fills its blocks: its documents in a seeded order, by hash, laid end to end as often
as they are used, are cut every so many tokens, and a seeded permutation says which piece fills which of the source's blocks. The places come from token counts per
hash range, so that no source is ever sorted or summed in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.tokens import count_tokens
from weftline.sources.scratch import keep

RANGES = 1 << 14
MOST_SOURCES = 10_000
"""Most sources with a share: their table is the one thing that is broadcast."""


MOST_BLOCKS, SMALLEST = 1_000_000, 10
"""Most blocks of a mix, and how many of them the smallest source gets at least as long as that is no more: its share is then right to a twentieth of itself."""


def sainte_lague(weights: dict[str, float], blocks: int) -> list[str]:
    """The source of each block, in order. Ties go to the larger weight, then the smaller name. Weights must be positive."""
    if not weights or blocks < 1:
        return []
    names = sorted(weights, key=lambda s: (-weights[s], s))
    w = np.array([weights[s] for s in names], np.float64)
    most = np.minimum(blocks, np.ceil(w / w.sum() * blocks).astype(np.int64) + len(names) + 1)
    who = np.repeat(np.arange(len(names)), most)
    n = np.arange(len(who)) - np.repeat(np.cumsum(most) - most, most)
    order = np.lexsort((who, -(w[who] / (2 * n + 1))))[:blocks]
    return [names[i] for i in who[order].tolist()]


def sizes(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of each document, written once."""
    return keep(count_tokens(docs.select("doc_id", "source", "text"), path=path), "sizes")


def plan(sized: DataFrame, targets: DataFrame, shards: int = 100, blocks_per_shard: int = 100, total_tokens: int | None = None) -> tuple[list[dict], list[str]]:
    """Per listed source its numbers, and the sources of the blocks in order. blocks_per_shard is raised where small weights need more blocks.

    total_tokens: the size of the mix; a source that cannot fill its blocks gives all it may, and the shares report what it lacks. Weights so unlike that the smallest would get no block of
    MOST_BLOCKS are an error.

    `targets` is the table of wanted shares, one row per source; it and the totals of the sources it lists are all that comes to the
    driver. Null or non-positive weights and repeats below 1 have no share. Of several rows for a source the first by weight
    holds. Sources without tokens get no blocks; the others share the whole by their weights.
    """
    wanted = targets.select("source", "weight", "max_repeats").where("source IS NOT NULL AND weight > 0 AND max_repeats >= 1").limit(MOST_SOURCES + 1).collect()
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources have a share")
    rows = {}
    for r in sorted(wanted, key=lambda r: (r.source, r.weight)):
        rows.setdefault(r.source, {"source": r.source, "weight": float(r.weight), "max_repeats": int(r.max_repeats)})
    named = F.broadcast(sized.sparkSession.createDataFrame([(s,) for s in rows], "source string"))
    have = {r.source: (r.tokens, r.docs) for r in sized.where("n_tokens > 0").join(named, "source").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()}
    for r in rows.values():
        r["tokens"], r["docs"] = have.get(r["source"], (0, 0))
    weights = {s: r["weight"] for s, r in rows.items() if r["tokens"]}
    if weights:
        least = min(weights.values()) / sum(weights.values())
        if least * MOST_BLOCKS < 1:
            raise ValueError(f"the smallest weight is less than a {MOST_BLOCKS}-th of all")
        blocks_per_shard = max(blocks_per_shard, -(-min(MOST_BLOCKS, int(SMALLEST / least)) // shards))
    order = sainte_lague(weights, shards * blocks_per_shard)
    got = pd.Series(order, dtype=object).value_counts().to_dict()
    for r in rows.values():
        r["blocks"] = got.get(r["source"], 0)
    block = min((r["tokens"] * r["max_repeats"] / r["blocks"] for r in rows.values() if r["blocks"]), default=0.0)
    if total_tokens is not None and order:
        block = total_tokens / len(order)
    for r in rows.values():
        r["block"] = block
    for r in rows.values():
        r["need"] = min(round(r["blocks"] * block), r["tokens"] * r["max_repeats"])
        r["passes"] = r["need"] // r["tokens"] if r["tokens"] else 0
        r["rest"] = r["need"] - r["passes"] * r["tokens"]
    return list(rows.values()), order


def mixed(docs: DataFrame, targets: DataFrame, seed: int = 0, path: str | None = None, total_tokens: int | None = None, shards: int = 100, blocks_per_shard: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chosen, shares, placed).

    chosen and shares: see mix. placed: (shard, block, source, doc_id, use_no, n_tokens), one row per use of a document: the block that it goes to, and the
    block's shard. A document lies in the block where it begins, so blocks differ from each other by less than a document.
    """
    spark = docs.sparkSession
    sized = sizes(docs, path)
    rows, order = plan(sized, targets, shards, blocks_per_shard, total_tokens)
    quota = spark.createDataFrame(
        [(r["source"], r["weight"], r["max_repeats"], r["passes"], r["rest"], r["tokens"], r["blocks"], r["block"]) for r in rows],
        "source string, weight double, max_repeats int, passes bigint, rest bigint, held bigint, blocks bigint, block_tokens double",
    )
    place = F.xxhash64(F.lit(seed), "doc_id")
    docs = sized.where("n_tokens > 0").join(F.broadcast(quota), "source").withColumn("at", place).withColumn("part", F.shiftrightunsigned(place, 64 - RANGES.bit_length() + 1))
    # tokens before each hash range: at most RANGES rows per source; within a range, document by document
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ranges = docs.groupBy("source", "part").agg(F.sum("n_tokens").alias("n")).withColumn("done", F.coalesce(F.sum("n").over(before), F.lit(0))).select("source", "part", "done")
    upto = W.partitionBy("source", "part").orderBy("at", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    docs = docs.withColumn("upto", F.sum("n_tokens").over(upto)).join(ranges, ["source", "part"])
    docs = docs.withColumn("start", F.col("done") + F.col("upto") - F.col("n_tokens")).withColumn("extra", (F.col("start") + F.col("n_tokens") <= F.col("rest")).cast("int"))
    picked = keep(docs.select("doc_id", "source", "n_tokens", "max_repeats", "passes", "rest", "held", "blocks", "block_tokens", "start", "extra", "at"), "picked")
    # what the last document was too long for goes to the document that fits it best
    gaps = picked.groupBy("source", "rest").agg(F.sum(F.col("extra") * F.col("n_tokens")).alias("got")).selectExpr("source", "rest - got AS gap")
    fit = picked.where("extra = 0 AND passes < max_repeats").join(F.broadcast(gaps), "source").withColumn("off", F.abs(F.col("n_tokens") - F.col("gap"))).where("off < gap")
    fit = fit.groupBy("source").agg(F.min(F.struct("off", "at", "doc_id")).alias("f")).select("source", F.col("f.doc_id").alias("fit_id"))
    chosen = picked.join(F.broadcast(fit), "source", "left").withColumn("uses", (F.col("passes") + F.col("extra") + F.coalesce(F.col("doc_id") == F.col("fit_id"), F.lit(False)).cast("int")).cast("int"))
    chosen = keep(chosen.where("uses > 0").select("doc_id", "source", "n_tokens", "uses", "held", "blocks", "block_tokens", "start"), "chosen")
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("docs"), F.max("uses").alias("most_uses"))
    total = got.agg(F.sum("tokens")).first()[0] or 0
    weights = sum(r["weight"] for r in rows) or 1.0
    shares = quota.select("source", "weight").join(got, "source", "left").select(
        "source",
        "weight",
        (F.col("weight") / weights).alias("target_share"),
        (F.coalesce("tokens", F.lit(0)) / F.lit(max(total, 1))).alias("share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("docs", F.lit(0)).alias("docs"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
    # seeded choice of blocks: the source's pieces, in the order of their hashes, go to its blocks in a permuted order; at most MOST_BLOCKS rows
    slots = pd.DataFrame({"source": np.array(order, object), "block": np.arange(len(order))})
    slots["shard"] = slots["block"] // max(1, len(order) // shards)
    slots["piece"] = 0
    for source, own in slots.groupby("source").groups.items():
        slots.loc[own, "piece"] = np.random.default_rng([seed, zlib.crc32(source.encode())]).permutation(len(own))
    slots = spark.createDataFrame([(r.source, int(r.piece), int(r.shard), int(r.block)) for r in slots.itertuples()], "source string, piece bigint, shard bigint, block bigint")
    uses = chosen.select("doc_id", "source", "n_tokens", "held", "blocks", "block_tokens", "start", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)).alias("use_no"))
    piece = F.least(F.floor((F.col("use_no").cast("bigint") * F.col("held") + F.col("start")) / F.col("block_tokens")), F.col("blocks") - 1)
    placed = uses.withColumn("piece", piece).join(slots, ["source", "piece"]).select("shard", "block", "source", "doc_id", "use_no", "n_tokens")
    return chosen.select("doc_id", "source", "n_tokens", "uses"), shares, placed


def mix(docs: DataFrame, targets: DataFrame, seed: int = 0, path: str | None = None, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares).

    chosen: (doc_id, source, n_tokens, uses), uses at least 1 and at most max_repeats; documents without tokens, of sources that
    are not listed or of no source are not chosen. shares: (source, weight, target_share, share, tokens, docs, most_uses) of each
    listed source; target_share is the weight's part of all listed weights, so a source without documents shows what it lacks.
    """
    return mixed(docs, targets, seed, path, total_tokens)[:2]


def shard_plan(docs: DataFrame, targets: DataFrame, shards: int = 100, blocks_per_shard: int = 100, path: str | None = None) -> DataFrame:
    """(shard, source, blocks): the integer quota of each source in each shard."""
    _, order = plan(sizes(docs, path), targets, shards, blocks_per_shard)
    each = max(1, len(order) // shards)
    n = pd.Series(list(zip((np.arange(len(order)) // each).tolist(), order, strict=True)), dtype=object).value_counts()
    return docs.sparkSession.createDataFrame(sorted((k, s, int(c)) for (k, s), c in n.items()), "shard int, source string, blocks bigint")


def filled(placed: DataFrame) -> DataFrame:
    """(shard, source, filled, tokens): how many of its blocks each source filled in each shard, and with how many tokens."""
    return placed.groupBy("shard", "source", "block").agg(F.sum("n_tokens").alias("n")).groupBy("shard", "source").agg(F.count(F.lit(1)).alias("filled"), F.sum("n").alias("tokens"))


def rules(docs: DataFrame, targets: DataFrame, off: float = 0.001) -> DataFrame:
    """(source, within_repeats, share_met) of each listed source: whether no document is used more often than allowed, and whether the source holds its share of those with documents, to within its
    largest document and `off` of the whole."""
    chosen, shares = mix(docs, targets)
    over = chosen.join(targets.groupBy("source").agg(F.max("max_repeats").alias("most")), "source").groupBy("source").agg(F.max(F.col("uses") - F.col("most")).alias("over"))
    sized = sizes(docs).where("n_tokens > 0").groupBy("source").agg(F.max("n_tokens").alias("largest"))
    had = shares.join(sized, "source").agg(F.sum("weight")).first()[0] or 1.0
    total = shares.agg(F.sum("tokens")).first()[0] or 1
    want = F.when(F.col("largest").isNotNull(), F.col("weight") / had).otherwise(0.0)
    met = F.abs(F.col("share") - want) <= off + F.coalesce("largest", F.lit(0)) / F.lit(total)
    return shares.join(over, "source", "left").join(sized, "source", "left").select("source", (F.coalesce("over", F.lit(0)) <= 0).alias("within_repeats"), met.alias("share_met"))
