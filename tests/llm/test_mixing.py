from collections import Counter

import pytest

from weftline.llm import mixing

TARGETS = "source string, weight double, max_repeats int"
DOCS = "doc_id bigint, text string, source string"


def test_sainte_lague():
    # the seats of a known example
    assert Counter(mixing.sainte_lague({"a": 53.0, "b": 24.0, "c": 23.0}, 7)) == {"a": 3, "b": 2, "c": 2}
    assert mixing.sainte_lague({}, 5) == [] and mixing.sainte_lague({"x": 1.0}, 3) == ["x"] * 3
    order = mixing.sainte_lague({"a": 3.0, "b": 1.0}, 400)
    assert all(abs(order[k : k + 40].count("b") - 10) <= 1 for k in range(0, 400, 40))


def run(spark, docs, targets, **how):
    d = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS n_tokens", "2 AS uses", "3 AS weight", "4 AS at")
    chosen, shares = mixing.mix(d, spark.createDataFrame(targets, TARGETS), **how)
    return chosen.collect(), {r.source: r for r in shares.collect()}


def test_shares_and_repeats(spark):
    docs = [(i, "word " * (i % 7 + 1), "big") for i in range(3000)] + [(10_000 + i, "some words here", "small") for i in range(40)] + [(20_000, "x", None), (20_001, "x", "unlisted"), (20_002, None, "small"), (20_003, "", "big")]
    targets = [("big", 3.0, 1), ("small", 1.0, 4), ("none", 1.0, 2), (None, 9.0, 1), ("zero", 0.0, 3)]
    chosen, shares = run(spark, docs, targets)
    assert set(shares) == {"big", "small", "none"}
    assert shares["big"].share == pytest.approx(0.75, abs=0.002) and shares["small"].share == pytest.approx(0.25, abs=0.002)
    assert shares["none"].tokens == 0 and shares["none"].target_share == pytest.approx(0.2)
    most = {"big": 1, "small": 4}
    assert all(1 <= r.uses <= most[r.source] for r in chosen) and len({r.doc_id for r in chosen}) == len(chosen)
    assert {r.uses for r in chosen if r.source == "small"} == {4} and shares["small"].docs == 40
    again, _ = run(spark, docs, targets)
    other, _ = run(spark, docs, targets, seed=7)
    pick = lambda rows: {r.doc_id for r in rows if r.source == "big"}
    assert pick(again) == pick(chosen) != pick(other)


def test_empty(spark):
    assert run(spark, [], [("a", 1.0, 1)])[0] == []
    assert run(spark, [(1, "x", "a")], [])[0] == []
    chosen, shares = run(spark, [(1, "only one", "a")], [("a", 1.0, 3)])
    assert [r.uses for r in chosen] == [3] and shares["a"].share == 1.0


def test_shard_plan(spark):
    docs = spark.createDataFrame([(i, "a b c", "ab"[i % 2]) for i in range(20)], DOCS)
    plan = mixing.shard_plan(docs, spark.createDataFrame([("a", 2.0, 1), ("b", 1.0, 1)], TARGETS), shards=4, blocks_per_shard=30)
    assert sorted((r.source, r.blocks) for r in plan.collect()) == [("a", 20)] * 4 + [("b", 10)] * 4


def test_small_weights_are_served_or_refused(spark):
    docs = [(i, "word " * 5, "big") for i in range(2000)] + [(10_000 + i, "word " * 5, "tiny") for i in range(50)]
    chosen, shares = run(spark, docs, [("big", 1.0, 1), ("tiny", 1e-3, 1)])
    assert shares["tiny"].docs >= 1 and shares["tiny"].share == pytest.approx(1e-3, abs=5e-4)
    assert Counter(mixing.sainte_lague({"a": 1.0, "b": 1e-5}, 200_000))["b"] == 2
    with pytest.raises(ValueError):
        run(spark, docs, [("big", 1.0, 1), ("tiny", 1e-9, 1)])


def test_total_tokens(spark):
    docs = [(i, "word " * 5, "ab"[i % 2]) for i in range(1000)]
    full, _ = run(spark, docs, [("a", 1.0, 2), ("b", 1.0, 2)])
    one = sum(r.n_tokens for r in full) // 1000
    chosen, shares = run(spark, docs, [("a", 3.0, 2), ("b", 1.0, 2)], total_tokens=400 * one)
    assert sum(r.n_tokens * r.uses for r in chosen) == pytest.approx(400 * one, rel=0.01) and shares["a"].share == pytest.approx(0.75, abs=0.01)
    short, shares = run(spark, docs, [("a", 3.0, 1), ("b", 1.0, 2)], total_tokens=2000 * one)
    assert shares["a"].docs == 500 and shares["a"].most_uses == 1 and shares["b"].tokens == pytest.approx(500 * one, rel=0.01)


def test_blocks_hold_every_use_once_and_equal_tokens(spark):
    docs = [(i, "word " * (i % 5 + 1), "abc"[i % 3]) for i in range(6000)] + [(9000 + i, "word " * 3, "rare") for i in range(30)]
    d, t = spark.createDataFrame(docs, DOCS), spark.createDataFrame([("a", 2.0, 1), ("b", 1.0, 1), ("c", 1.0, 2), ("rare", 0.05, 4)], TARGETS)
    chosen, _, placed = mixing.mixed(d, t, shards=10, blocks_per_shard=20)
    rows = placed.collect()
    assert Counter(r.doc_id for r in rows) == {r.doc_id: r.uses for r in chosen.collect()}
    quota = {(r.shard, r.source): r.blocks for r in mixing.shard_plan(d, t, 10, 20).collect()}
    got = {(r.shard, r.source): r for r in mixing.filled(placed).collect()}
    assert set(got) <= set(quota) and all(got[k].filled <= quota[k] for k in got)
    assert sum(r.filled for r in got.values()) > 0.8 * sum(quota.values())
    each = Counter()
    for r in rows:
        each[r.shard] += r.n_tokens
    assert max(each.values()) < 1.15 * min(each.values())
    again = mixing.mixed(d, t, seed=5, shards=10, blocks_per_shard=20)[2].collect()
    assert {(r.doc_id, r.block) for r in again} != {(r.doc_id, r.block) for r in rows}
