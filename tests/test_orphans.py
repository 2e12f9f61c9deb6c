import random

from helpers import EDGE_ROWS, NODE_ROWS, day, rows
from weftline.operators import orphans

ROUTES = "repo string, ord bigint, method string, path string, handler string, indexed_at timestamp_ntz"
PDGS = "repo string, ord bigint, id string, blocks int, indexed_at timestamp_ntz"


def tables(spark, edges=(), nodes=(), routes=(), pdgs=()):
    return (
        spark.createDataFrame(list(edges), EDGE_ROWS),
        spark.createDataFrame([(r, i, "func", "", "", "", 0, "", "", [], a, b) for r, i, a, b in nodes], NODE_ROWS),
        spark.createDataFrame(list(routes), ROUTES),
        spark.createDataFrame(list(pdgs), PDGS),
    )


def test_cases(spark):
    t = tables(
        spark,
        [
            ("r", 1, "a", "never", "calls", day(5)),
            ("r", 1, "a", "never", "calls", day(5)),
            ("r", 2, "a", "later", "calls", day(5)),
            ("r", 3, "a", "gone", "calls", day(9)),
            ("r", 4, "a", "gone", "calls", day(7)),
            ("r", 5, "a", "never", " Imports", day(5)),
            ("r", 6, "a", "other", "calls", day(5)),
            ("r", 7, "a", "never", None, day(5, 2)),
            ("r", 8, "a", "late", "calls", day(5)),
            ("r", 9, "a", "never", "calls", None),
            ("r", 10, None, "never", "calls", day(5)),
            (None, 11, "a", "never", "calls", day(5)),
        ],
        [("r", "later", day(6), None), ("r", "gone", day(1), day(8)), ("q", "other", day(1), None), ("r", "late", day(1), None), ("r", None, day(1), None)],
        [("r", 1, "GET", "/", "gone", day(8)), ("r", 2, "GET", "/", "", day(8)), ("r", 3, "GET", "/", None, day(8))],
        [("r", 1, "late", 3, day(1)), ("r", 2, "late", 3, day(1, 2)), ("r", 3, "nope", 3, day(1, 2))],
    )
    want = [("edges", None, "r", 9), ("edges", "2024-01", None, 11), ("edges", "2024-01", "r", 1), ("edges", "2024-01", "r", 2), ("edges", "2024-01", "r", 3), ("edges", "2024-01", "r", 6), ("edges", "2024-02", "r", 7), ("func_pdgs", "2024-02", "r", 3), ("routes", "2024-01", "r", 1)]
    key = lambda x: tuple(str(y) for y in x)
    for slices in (1, 2, 5):
        got = orphans.orphans(*t, slices=slices)
        assert sorted((tuple(r) for r in got.select("tab", "period", "repo", "ord").collect()), key=key) == sorted(want, key=key)
        assert {r.ord for r in got.where("resolved_at IS NOT NULL").collect()} == {2}


def test_report_and_standing(spark):
    t = tables(spark, [("r", 1, "a", "x", "calls", day(5)), ("r", 2, "a", "y", "calls", day(5)), ("r", 3, "a", "z", "calls", day(5, 2))], [("r", "x", day(9), None), ("r", "y", day(1), day(1, 2))])
    assert rows(orphans.orphan_report(orphans.orphans(*t))) == [("edges", "2024-01", 1, 1, 0), ("edges", "2024-02", 1, 0, 1)]
    # at the end of January y is dead, at the end of February y and z are missing
    assert rows(orphans.standing_orphans(*t)) == [("edges", "2024-01", 1), ("edges", "2024-02", 2)]


def test_hot_key_and_many_lives(spark):
    rng = random.Random(1)
    life = [("r", "hot", day(d), day(d + 1)) for d in range(1, 28, 2)]
    edges = [("r", i, "a", "hot", "calls", day(rng.randrange(1, 29))) for i in range(3000)]
    t = tables(spark, edges, life * 2)
    state = orphans.start(orphans.references(t[0], t[2], t[3]), orphans.lives(t[1]))
    state.hot = spark.createDataFrame([("r", "hot")], "repo string, id string")
    state = orphans.advance(state, orphans.references(t[0], t[2], t[3]), orphans.lives(t[1]))
    want = sorted(i for _, i, _, _, _, at in edges if not any(a <= at < b for _, _, a, b in life))
    assert sorted(r.ord for r in state.orphans.collect()) == want


def test_empty(spark):
    t = tables(spark)
    assert orphans.orphans(*t).count() == 0 and orphans.standing_orphans(*t).count() == 0
    one = tables(spark, [("r", 1, "a", "b", "calls", day(1))])
    assert rows(orphans.orphans(*one), "tab", "period", "ord") == [("edges", "2024-01", 1)]


def test_deletions_reopen_and_slices_agree(spark):
    """An orphan whose record came and went stands again; a good reference that lost its record does too; any number of slices gives the same."""
    t = tables(
        spark,
        [("r", 1, "a", "x", "calls", day(5)), ("r", 2, "a", "y", "calls", day(12)), ("r", 3, "a", "z", "calls", day(3)), ("r", 4, "a", "never", "calls", day(20, 3))],
        [("r", "x", day(10), day(12)), ("r", "y", day(1), day(3, 2)), ("r", "z", day(1), day(9)), ("r", "z", day(2, 3), None)],
    )
    assert rows(orphans.standing_orphans(*t)) == [("edges", "2024-01", 2), ("edges", "2024-02", 3), ("edges", "2024-03", 3)]
    assert rows(orphans.reopened_orphans(*t)) == [("edges", "2024-01", 2), ("edges", "2024-02", 3), ("edges", "2024-03", 2)]
    for slices in (1, 2, 12):
        got = orphans.orphans(*t, slices=slices)
        assert rows(got, "ord", "resolved_at")[0] == (1, day(10)) and [r[0] for r in rows(got, "ord")] == [1, 4]


def test_a_slice_touches_only_its_buckets(spark):
    """Slices given one by one: a record's end alone reopens what its key holds, and folders of other keys' buckets stay."""
    lives = "repo string, id string, start timestamp_ntz, end timestamp_ntz"
    refs = "tab string, repo string, ord bigint, id string, at timestamp_ntz"
    first = spark.createDataFrame([("edges", "r", i, f"k{i}", day(5)) for i in range(20)], refs)
    state = orphans.advance(orphans.start(first), first, spark.createDataFrame([("r", f"k{i}", day(1), None) for i in range(20)], lives))
    assert state.standing()["edges"] == 0
    later = orphans.advance(state, first.limit(0), spark.createDataFrame([("r", "k3", None, day(9))], lives))
    assert later.standing()["edges"] == 1 and later.waits["edges"] == 0
    assert len([b for b in state.index if state.index[b] != later.index[b]]) == 1
    again = orphans.advance(later, spark.createDataFrame([("edges", "r", 99, "k3", day(11))], refs), spark.createDataFrame([("r", "k3", day(12), None)], lives))
    assert again.standing()["edges"] == 0 and rows(again.orphans, "ord", "resolved_at") == [(99, day(12))]
