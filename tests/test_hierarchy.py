import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helpers import EDGE_ROWS, edge_rows, rows
from weftline.operators.hierarchy import descendant_lists, descendants, hierarchy


def brute(edges):
    """(repo, id) -> (root, depth, looped, path) from (repo, src, dst, kind) in order."""
    up, ids = {}, set()
    for r, a, b, k in edges:
        if a and b and a != b and k and k.strip(" \t").lower() == "defines":
            ids |= {(r, a), (r, b)}
            up.setdefault((r, b), a)
    out = {}
    for r, x in ids:
        path, seen = [x], {x}
        while (r, path[-1]) in up and up[(r, path[-1])] not in seen:
            path.append(up[(r, path[-1])])
            seen.add(path[-1])
        if (r, path[-1]) in up:
            out[(r, x)] = ("", None, up[(r, path[-1])] == x, None)
        else:
            out[(r, x)] = (path[-1], len(path) - 1, False, path[::-1])
    return out


def check(spark, edges, **how):
    tree = hierarchy(edge_rows(spark, edges), **how)
    got = {(r.repo, r.id): (r.root, r.depth, r.looped, r.path) for r in tree.collect()}
    want = brute(edges)
    assert got == want
    for r in tree.where("depth IS NOT NULL").collect():
        assert r.size == sum(1 for k, v in want.items() if k[0] == r.repo and v[3] and r.id in v[3])


CASES = {
    "tree": [("r", "p", "f", "defines"), ("r", "f", "t", " Defines"), ("r", "t", "m", "DEFINES\t"), ("r", "p", "g", "defines"), ("r", "p", "g", "defines"), ("q", "p", "f", "defines")],
    "loops": [("r", "a", "b", "defines"), ("r", "b", "c", "defines"), ("r", "c", "a", "defines"), ("r", "c", "below", "defines"), ("r", "below", "deep", "defines"), ("r", "x", "x", "defines")],
    "dirty": [("r", None, "b", "defines"), ("r", "a", "", "defines"), ("r", "a", "b", None), (None, "n", "m", "defines"), ("r", "u", "v", "calls")],
    "two parents": [("r", "a", "c", "defines"), ("r", "b", "c", "defines"), ("r", "b", "d", "defines")],
    "chain": [("r", f"n{i:03}", f"n{i + 1:03}", "defines") for i in range(40)],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("how", [{}, {"rounds": 0}, {"rounds": 4}, {"rounds": 1, "bound": 2}], ids=str)
def test_against_brute_force(spark, case, how):
    check(spark, CASES[case], **how)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_random_forests(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.choice("rq"), f"n{rng.randrange(40)}", f"n{i}", "defines") for i in range(40) for _ in range(rng.random() < 0.8)]
    check(spark, edges, bound=rng.choice([3, 10**6]))


def test_descendants(spark):
    tree = hierarchy(edge_rows(spark, CASES["tree"]))
    assert rows(descendants(tree)) == [("q", "p", 0, ["f"]), ("r", "f", 0, ["m", "t"]), ("r", "p", 0, ["f", "g", "m", "t"]), ("r", "t", 0, ["m"])]
    cut = descendants(tree, block=2).where("id = 'p' AND repo = 'r'").collect()
    assert sorted(m for r in cut for m in r.members) == ["f", "g", "m", "t"] and len(cut) > 1


def test_empty_and_extra_columns(spark):
    e = spark.createDataFrame([], EDGE_ROWS)
    assert hierarchy(e).count() == 0
    more = edge_rows(spark, CASES["tree"]).selectExpr("*", "'x' AS id", "1 AS parent", "2 AS kids", "3 AS size", "4 AS path")
    assert hierarchy(more).count() == 7


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("how", [{}, {"rounds": 1, "bound": 2}], ids=str)
def test_lists_sent_up_are_those_read_off_paths(spark, case, how):
    e = edge_rows(spark, CASES[case])
    key = lambda r: str(r)
    assert sorted(map(tuple, descendant_lists(e, **how).collect()), key=key) == sorted(map(tuple, descendants(hierarchy(e)).collect()), key=key)


def test_lists_in_blocks_and_hot_parents(spark):
    e = edge_rows(spark, [("r", "p", f"c{i}", "defines") for i in range(200)] + [("r", "top", "p", "defines")])
    got = descendant_lists(e, block=50).where("id = 'p'").collect()
    assert len(got) == 5 and sorted(m for r in got for m in r.members) == sorted(f"c{i}" for i in range(200))
    tree = hierarchy(e, budget=20)
    assert {(r.root, r.depth) for r in tree.where("id LIKE 'c%'").collect()} == {("top", 2)} and tree.count() == 202


def test_long_chain_takes_few_rounds(spark):
    """Beyond the bound, pointer jumping: 300 levels, and a loop with a tail beside them."""
    chain = [("r", f"n{i:03}", f"n{i + 1:03}", "defines") for i in range(300)]
    check(spark, chain + [("r", "x", "y", "defines"), ("r", "y", "x", "defines"), ("r", "y", "tail", "defines")], rounds=1, bound=10)
