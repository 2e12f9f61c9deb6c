import numpy as np
import pytest

from weftline.llm import neighbours as nb

SCHEMA = "repo string, id string, embedding array<float>"


def frame(spark, vectors):
    return spark.createDataFrame([("r", i, None if v is None else [float(x) for x in v]) for i, v in vectors], SCHEMA).selectExpr("*", "1 AS vec", "2 AS list", "3 AS score", "4 AS other")


def brute(vectors, k):
    """id -> its k others by cosine, ties by id."""
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return {i: [ids[j] for j in np.argsort(-s[a].round(6), kind="stable")[:k]] for a, i in enumerate(ids)}


def clusters(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 12 + 1, 64))
    return {f"v{i:05}": centres[i // 12] + 0.25 * rng.normal(size=64) for i in range(n)}


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(nb, "LIST", 64)  # many lists, so that probing counts
    v = clusters(3000)
    got = {}
    for r in nb.neighbours(frame(spark, v.items())).collect():
        got.setdefault(r.id, set()).add(r.other)
    want = brute(v, 5)
    assert all(len(x) == 5 for x in got.values()) and len(got) == 3000
    assert np.mean([len(got[i] & set(want[i])) / 5 for i in want]) > 0.97


def near_copies(n, seed, noise):
    """A third of n vectors are near copies of one, but none an exact copy."""
    rng = np.random.default_rng(seed)
    one = rng.normal(size=64)
    return clusters(n - n // 3, seed) | {f"w{i:05}": one + noise * rng.normal(size=64) for i in range(n // 3)}


@pytest.mark.parametrize("size,noise", [(512, 0.1), (32, 0.1), (512, 1e-4)])
def test_near_copies_of_a_third_are_all_found(spark, monkeypatch, size, noise):
    monkeypatch.setattr(nb, "LIST", size)  # 32: the group fills far more lists than a query probes by rank
    v = near_copies(2400, 6, noise)
    got = {tuple(r) for r in nb.similar_pairs(frame(spark, v.items())).collect()}
    ids = sorted(v)
    x = np.array([v[i] for i in ids], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x.astype(np.float32).astype(np.float64) @ x.astype(np.float32).astype(np.float64).T
    np.fill_diagonal(s, -9)
    want = {tuple(sorted((ids[a], ids[b]))) for a in range(len(ids)) if ids[a][0] == "w" for b in np.argsort(-s[a], kind="stable")[:5] if s[a, b] >= 0.85}
    assert len(want & got) > (0.999 if noise > 1e-3 else 0.97) * len(want)  # rounding orders the nearest of all


def test_blocks_change_nothing(spark, monkeypatch):
    v = clusters(700, 1)
    want = sorted(map(tuple, nb.neighbours(frame(spark, v.items())).select("id", "other").collect()))
    monkeypatch.setattr(nb, "BLOCK", 50)
    monkeypatch.setattr(nb, "QUERIES", 60)
    got = sorted(map(tuple, nb.neighbours(frame(spark, v.items())).select("id", "other").collect()))
    assert len(set(got) & set(want)) > 0.98 * len(want) and len(got) == len(want)


def test_copies(spark):
    rng = np.random.default_rng(3)
    one, two = rng.normal(size=64), rng.normal(size=64)
    v = {f"a{i:02}": one for i in range(9)} | {f"b{i}": one + 0.1 * rng.normal(size=64) for i in range(3)} | {"c0": two, "c1": two}
    got = {}
    for r in nb.neighbours(frame(spark, [*v.items(), *v.items()])).collect():
        got.setdefault(r.id, []).append(r.other)
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in brute(v, 5).items()}


def test_pairs_and_dirt(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=64)
    rows = [("x", a), ("y", 5 * a), ("far", -a), ("zero", np.zeros(64)), ("short", a[:32]), ("null", None), ("empty", []), ("nan", [float("nan")] * 64), (None, a), ("tiny", a * 1e-30), ("x", a)]
    got = sorted(map(tuple, nb.similar_pairs(frame(spark, rows)).collect()))
    assert got == [("tiny", "x"), ("tiny", "y"), ("x", "y")]
    assert nb.similar_pairs(frame(spark, rows).limit(0)).count() == 0
    assert nb.neighbours(frame(spark, rows[:1])).count() == 0


def test_score_aware_loss():
    v = np.stack(list(clusters(2000, 5).values())).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    book = nb.fit(v, 16)
    near = nb._nearest(v, book.coarse, 1)[:, 0]
    r = v - book.coarse[near]

    def parallel(sweeps):
        codes = nb._codes(v, r, book.fine, sweeps)
        e = r - np.concatenate([book.fine[m][codes[:, m]] for m in range(nb.PARTS)], 1)
        along = (e * v).sum(1)
        return float((along**2).mean()), float(((e**2).sum(1) + (nb.ETA - 1) * along**2).mean())

    plain, aware = parallel(0), parallel(2)
    assert aware[0] < plain[0] and aware[1] < plain[1]
    assert nb.fit(v[:3], 9).coarse.shape == (3, 64)


def test_codebook_shape():
    assert nb.DIM % nb.PARTS == 0 and pytest.approx(2.625) == nb.ETA


@pytest.mark.parametrize("per,noise,least", [(12, 0.4, -2.0), (43, 0.05, 0.85), (100, 0.25, 0.85), (300, 0.4, -2.0), (300, 0.05, 0.85), (1000, 0.05, 0.85), (1000, 0.25, -2.0)])
def test_recall_within_clusters_of_any_size(spark, monkeypatch, per, noise, least):
    """The codes pick who is scored exactly; no number of like vectors is too many. 64 vectors a list, so that clusters fill several."""
    monkeypatch.setattr(nb, "LIST", 64)
    rng = np.random.default_rng(per)
    centres = rng.normal(size=(3000 // per + 1, 64))
    x = (centres[np.arange(3000) // per] + noise * rng.normal(size=(3000, 64))).astype(np.float32)
    got = {}
    for r in nb.neighbours(frame(spark, [(f"v{i:05}", v) for i, v in enumerate(x)]), least=least).collect():
        got.setdefault(int(r.id[1:]), set()).add(int(r.other[1:]))
    u = x.astype(np.float64) / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = [(i, j) for i in range(3000) for j in np.argsort(-s[i])[:5] if s[i, j] >= least]
    assert len(want) > 10_000 and sum(j in got.get(i, ()) for i, j in want) > 0.98 * len(want)


def test_exact_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nb, "LIST", 64)
    v = clusters(900, 8)
    got = {}
    for r in nb.neighbours(frame(spark, v.items()), exact=True).collect():
        got.setdefault(r.id, set()).add(r.other)
    assert np.mean([len(got[i] & set(x)) / 5 for i, x in brute(v, 5).items()]) > 0.999


def test_long_lists_and_blocks_of_lists(spark, monkeypatch):
    """Lists beyond the most are cut where they are scanned; a list beyond a block takes several."""
    monkeypatch.setattr(nb, "LIST", 32)
    monkeypatch.setattr(nb, "MOST_LISTS", 4)
    monkeypatch.setattr(nb, "BLOCK", 500)
    v = clusters(2400, 9)
    got = {}
    for r in nb.neighbours(frame(spark, v.items()), least=0.85).collect():
        got.setdefault(r.id, set()).add(r.other)
    want = brute(v, 5)
    x = {i: np.asarray(y) / np.linalg.norm(y) for i, y in v.items()}
    near = {(i, j) for i, js in want.items() for j in js if x[i] @ x[j] >= 0.85}
    assert sum(j in got.get(i, ()) for i, j in near) > 0.97 * len(near)
