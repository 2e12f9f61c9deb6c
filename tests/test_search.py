import pytest
from pyspark.sql import functions as F

from helpers import graph, rows
from weftline.functions.porter import stem
from weftline.functions.text import camel, query_tokens, slug, tokens
from weftline.functions.vectors import normalize
from weftline.operators import search


def test_stems():
    # from the paper and its sample vocabulary
    for word, want in {"parsing": "pars", "parsed": "pars", "parses": "pars", "queries": "queri", "go": "go", "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "adjustment": "adjust", "adoption": "adopt", "controlling": "control", "rate": "rate", "cease": "ceas", "x9999": "x9999", "generalizations": "gener", "oscillators": "oscil"}.items():
        assert stem(word) == want, word


def test_tokens(spark):
    df = spark.createDataFrame([("HTTPServer v2Go v2GO BuildRepo über_Straße", None), ("", "x")], "t string, u string")
    assert rows(df.limit(1).select(F.explode(F.split("t", " ")).alias("w")).select(F.array_join(camel(F.col("w")), ",").alias("c"))) == [("Build,Repo",), ("HTTP,Server",), ("v2,Go",), ("v2GO",), ("über_,Straße",)]
    got = [r[0] for r in df.select(tokens(F.col("t"), stems=False)).collect()]
    assert got[0] == ["httpserver", "http", "server", "v2go", "v2", "go", "v2go", "buildrepo", "build", "repo", "über", "straße"] and got[1] == []
    assert [r[0] for r in df.select(tokens(F.col("t"))).collect()][0] == query_tokens("HTTPServer v2Go v2GO BuildRepo über_Straße")
    assert df.select(tokens(F.col("u"))).collect()[0][0] is None
    assert rows(spark.createDataFrame([("Kit & Co. 9",)], "s string").select(slug(F.col("s")))) == [("kit---co--9",)]


def test_bm25(spark):
    g = graph(spark, {"BuildRepo": {"doc": "builds a repository"}, "BuildGo": {}, "Serve": {"doc": "listens"}}, [])
    hits = search.search(g, "build repo").orderBy("rank").collect()
    assert hits[0].id == "BuildRepo" and "Serve" not in [h.id for h in hits]
    assert search.search(g, "").count() == 0 and search.search(g, "zzz").count() == 0
    none = spark.createDataFrame([], "id string, t string")
    assert search.bm25_scores(none, ["id"], F.col("t"), "a").count() == 0


def test_bm25_against_brute_force(spark):
    import math

    docs = [("1", "alpha beta alpha"), ("2", "beta"), ("3", None), ("4", "gamma alpha delta epsilon")]
    df = spark.createDataFrame(docs, "id string, t string")
    toks = {i: (t or "").split() for i, t in docs}
    avg = sum(map(len, toks.values())) / 4
    want = {}
    for i, ts in toks.items():
        s = 0.0
        for q in ("alpha", "beta", "alpha"):
            f, d = ts.count(q), sum(q in x for x in toks.values())
            s += math.log(1 + (4 - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(ts) / avg))
        if s > 0:
            want[i] = pytest.approx(s)
    assert {r.id: r.score for r in search.bm25_scores(df, ["id"], F.col("t"), "Alpha beta ALPHA", stems=False).collect()} == want


def test_vectors_and_fusion(spark):
    v = spark.createDataFrame([("a", [2.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", [1.0]), ("d", None), ("e", [-1.0, 0.0, 0.0])], "id string, embedding array<float>")
    s = search.vector_scores(v, ["id"], [5.0, 0.0, 0.0])
    assert rows(s) == [("a", 1.0), ("b", 0.0), ("e", -1.0)]
    zero = spark.createDataFrame([([0.0, 0.0],)], "v array<float>")
    assert zero.select(normalize(F.col("v"))).first()[0] == [0.0, 0.0]
    lists = [spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, rank int") for ids in (["y", "x"], ["x", "z"])]
    assert search.top(search.rrf(lists, ["id"]), ["id"], 3).first().id == "x"


def test_hybrid_recalls_the_semantic_match(spark):
    g = graph(spark, {"handler": {}, "renderer": {}}, [])
    v = spark.createDataFrame([("r", "handler", [1.0, 0.0, 0.0]), ("r", "renderer", [0.0, 1.0, 0.0])], "repo string, id string, embedding array<float>")
    assert search.search(g, "nothing", vector=[1.0, 0.1, 0.0], vectors=v).first().id == "handler"


def test_vector_top(spark):
    v = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(50)] + [(99, None), (98, [1.0])], "id bigint, embedding array<float>")
    got = search.vector_top(v, "id", v.where("id % 10 = 0"), 3, block=2)
    assert rows(got.where("query = 0"), "id", "score") == [(0, 1.0), (1, 1.0), (2, 1.0)]
    assert rows(got.where("query = 10"), "id", "score") == [(6, 19.0), (13, 19.0), (20, 19.0)]
    assert search.vector_top(v, "id", v.limit(0), 3).count() == 0


def test_embedding(spark):
    g = graph(spark, {"a": {}, "b": {}}, [("a", "b", "calls")])
    assert rows(search.embed(g.nodes, lambda texts: [[3.0, 4.0] for _ in texts], 1), "id")[0] == ("a",)
    with pytest.raises(Exception, match="vectors received"):
        search.embed(g.nodes, lambda texts: []).collect()
    assert search.most_used(g, 1).first().id == "b"


def test_index_gives_the_same_scores(spark):
    g = graph(spark, {"BuildRepo": {"doc": "builds a repository, parsing queries"}, "ParseQuery": {"doc": "parses the query"}, "Serve": {"doc": None}, "x": {"name": "", "doc": "go go go"}}, [])
    for stems in (True, False):
        index = search.build_index(g.nodes, search.node_text(), stems, buckets=4)
        for q in ("parsing queries", "go Go build", "nothing", "", "the the query"):
            want = search.bm25_scores(g.nodes, ["repo", "id"], search.node_text(), q, ["repo"], stems)
            score = lambda df: {r.id: pytest.approx(r.score) for r in df.collect()}
            assert score(search.index_scores(index, q)) == score(want), (q, stems)
