from collections import Counter

from pyspark.sql import functions as F

from helpers import EDGE_ROWS, day, edge_rows, rows
from weftline.operators import hotkeys


def test_heavy_targets_count_every_row(spark):
    data = [("r", f"s{i}", "hot", " Calls\t") for i in range(60)] + [("r", "hot", "hot", "calls")] * 3 + [("r", None, "cold", "calls")] + [("r", "a", None, "calls")] * 30 + [("r", "a", "", "defines")] * 6
    e = edge_rows(spark, data).withColumn("n_key", F.lit("clash"))
    assert rows(hotkeys.heavy_targets(e, 0.5)) == [("hot", "calls")]
    assert rows(hotkeys.heavy_targets(e, 0.01)) == [("cold", "calls"), ("hot", "calls")]


def test_target_profile_against_brute_force(spark):
    data = [("r", f"s{i % 3}", f"t{i % 2}", "CALLS" if i % 5 else None) for i in range(40)] + [("r", "t0", "t0", "calls"), (None, "x", "t1", "calls")]
    got = {(r.dst, r.kind): (r.n_rows, r.n_edges) for r in hotkeys.target_profile(edge_rows(spark, data)).collect()}
    n = Counter((b, k and k.lower()) for _, _, b, k in data)
    m = Counter((b, k and k.lower()) for _, a, b, k in data if a != b)
    assert got == {k: (v, m[k]) for k, v in n.items()}


def test_empty(spark):
    e = spark.createDataFrame([], EDGE_ROWS)
    assert hotkeys.heavy_targets(e).count() == 0 and hotkeys.target_profile(e).count() == 0


def test_spread_joins_every_row_once(spark):
    a = spark.createDataFrame([("hot", i) for i in range(500)] + [("cold", 1), (None, 2)], "k string, v int")
    b = spark.createDataFrame([("hot", "x"), ("hot", "y"), ("cold", "z")], "k string, w string")
    hot = hotkeys.hot_keys(a, ["k"], parts=10, least=100)
    assert rows(hot) == [("hot",)]
    x, y = hotkeys.spread(a, b, ["k"], F.col("v"), hot, salts=8)
    assert rows(x.join(y, ["k", "salt"]), "k", "v", "w") == rows(a.join(b, "k"), "k", "v", "w")
    assert x.where("k = 'hot'").select("salt").distinct().count() == 8


def test_dates_are_kept(spark):
    r = hotkeys.target_profile(edge_rows(spark, [("r", "a", "b", "calls")])).first()
    assert r.first_at == r.last_at == day(1)
