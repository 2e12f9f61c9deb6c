from helpers import rows
from weftline.operators.snapshots import change_counts, snapshot_changes

SCHEMA = "snapshot_no int, repo string, ord bigint, id string, line int, signature string, doc string"


def changes(spark, data):
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS salt", "2 AS row_hash", "3 AS change")
    return rows(snapshot_changes(df), "snapshot_no", "repo", "id", "change")


def test_cases(spark):
    data = [
        (1, "r", 1, "same", 1, None, "x"),
        (1, "r", 2, "line", 1, "f()", None),
        (1, "r", 3, "sig", 1, "f()", None),
        (1, "r", 4, "gone", 1, "f()", None),
        (1, "r", 5, "nul", None, "f()", None),
        (2, "q", 1, "first", 1, "f()", None),
        (3, "r", 1, "same", 1, "", "y"),
        (3, "r", 1, "same", 1, "", "y"),
        (3, "r", 2, "line", 2, "f()", None),
        (3, "r", 3, "sig", 1, "f() ", None),
        (3, "r", 9, "sig", 7, "later rows don't hold", None),
        (3, "r", 5, "nul", 0, "f()", None),
        (3, "r", 6, "new", 1, "f()", None),
        (3, "r", 7, None, 1, "f()", None),
        (3, "r", 8, "", 1, "f()", None),
        (4, "r", 1, None, 1, "f()", None),
    ]
    want = [(3, "r", "gone", "removed"), (3, "r", "line", "changed"), (3, "r", "new", "added"), (3, "r", "nul", "changed"), (3, "r", "sig", "changed")]
    assert changes(spark, data) == want
    assert rows(change_counts(snapshot_changes(spark.createDataFrame(data, SCHEMA)))) == [(3, "added", 1), (3, "changed", 3), (3, "removed", 1)]


def test_null_and_empty(spark):
    assert changes(spark, []) == []
    assert changes(spark, [(None, "r", 1, "a", 1, "", ""), (1, None, 1, "a", 1, "", ""), (1, "r", None, "a", None, None, None), (2, "r", None, "a", None, "", None)]) == []


def test_values_that_look_alike(spark):
    assert changes(spark, [(1, "r", 1, "a", 1, "2", ""), (2, "r", 1, "a", 12, "", "")]) == [(2, "r", "a", "changed")]
