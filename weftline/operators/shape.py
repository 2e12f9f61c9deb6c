"""Properties that consumers read and types do not have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shape_check(nodes: DataFrame, shapes: DataFrame) -> DataFrame:
    """(repo, object, type, file, unknown): consumers whose object is named like a type, ignoring case, with the properties the type lacks.

    Of several types of that name the one with the smallest id holds. type is the consumer's own name of the object. Types without fields are not checked. Findings without unknown properties are left out;
    properties are compared ignoring case and come sorted.
    """
    typed = nodes.where("size(fields) > 0").groupBy("repo", F.lower("name").alias("low")).agg(F.min_by("fields", "id").alias("fields"))
    known = F.transform("fields", F.lower)
    s = shapes.withColumn("low", F.lower("object")).join(typed, ["repo", "low"])
    unknown = F.array_sort(F.array_distinct(F.filter("props", lambda p: ~F.array_contains(known, F.lower(p)))))
    return s.select("repo", "object", F.col("object").alias("type"), "file", unknown.alias("unknown")).where("size(unknown) > 0")
