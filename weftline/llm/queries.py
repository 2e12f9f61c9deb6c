"""Queries of the llm operators, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import functions_docs, mixing, neighbours, quality, tokens
from weftline.sources.tables import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return functions_docs.places(table(spark, d, "sources")).distinct()


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return functions_docs.pairs(table(spark, d, "sources"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "vectors"))


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbours(table(spark, d, "vectors")).select("id", "other", F.round("score", 4).alias("score"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_blocks(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[2]


def p8_shards(spark: SparkSession, d: str) -> DataFrame:
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    return mixing.shard_plan(docs, targets).join(mixing.filled(mixing.mixed(docs, targets)[2]), ["shard", "source"], "left").na.fill(0, ["filled", "tokens"])


def p8_rules(spark: SparkSession, d: str) -> DataFrame:
    return mixing.rules(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.odd_forms(table(spark, d, "documents"))


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_quality(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p5_found, p5_pairs, p6_found, p6_neighbours, p7_ids, p8_mix, p8_shares, p8_blocks, p8_shards, p8_rules, p9_found, p9_statistics)}
SQL: dict[str, str] = {
    "p8_rules": "SELECT DISTINCT source, true AS within_repeats, true AS share_met FROM mix_targets WHERE source IS NOT NULL AND weight > 0 AND max_repeats >= 1",
    "p6_found": """
        WITH v AS (SELECT DISTINCT id, CAST(embedding AS FLOAT[64]) AS e FROM vectors WHERE id IS NOT NULL AND len(embedding) = 64 AND (list_max(embedding) > 0 OR list_min(embedding) < 0)),
        p AS (SELECT a.id, b.id AS other, array_cosine_similarity(CAST(a.e AS DOUBLE[64]), CAST(b.e AS DOUBLE[64])) AS score FROM v a, v b WHERE a.id <> b.id),
        t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, other) <= 5)
        SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM t WHERE score >= 0.85""",
    "p6_neighbours": """
        WITH v AS (SELECT DISTINCT id, CAST(embedding AS FLOAT[64]) AS e FROM vectors WHERE id IS NOT NULL AND len(embedding) = 64 AND (list_max(embedding) > 0 OR list_min(embedding) < 0)),
        p AS (SELECT a.id, b.id AS other, array_cosine_similarity(CAST(a.e AS DOUBLE[64]), CAST(b.e AS DOUBLE[64])) AS score FROM v a, v b WHERE a.id <> b.id)
        SELECT id, other, round(score, 4) AS score FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(score, 7) DESC, other) <= 5""",
}
