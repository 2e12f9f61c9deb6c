"""python -m weftline.cli FOLDER COMMAND [ARGUMENT...] [--option=value...]: questions to a folder of tables, or to a folder that `index` made, answered as text."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

from weftline.api import Engine
from weftline.operators.changes import git_diff
from weftline.operators.graph import load
from weftline.operators.taint import pdgs
from weftline.sources.tables import ship, table

# Commands and the methods they call; the words after the command are the method's arguments.
COMMANDS = {
    **{c.replace("_", "-"): c for c in ("repos", "status", "reindex", "remove", "clean", "query", "ask", "context", "impact", "dependencies", "trace", "pattern", "entry_points", "process", "clusters", "route_map", "api_impact", "source", "pdg_query", "explain", "shape_check", "rename", "wiki", "skills", "tool_map", "groups", "enrich", "cross_impact")},
    "list": "repos",
    "index": "index_sources",
    "cypher": "pattern",
    "check": "check",
    "detect-changes": "detect_changes",
}
GROUP = {"list": "groups", "create": "group_create", "add": "group_add", "remove": "group_remove", "sync": "group_sync", "graph": "group_graph"}


def _engine(spark: SparkSession, folder: str) -> Engine:
    if not os.path.exists(os.path.join(folder, "nodes.parquet")):
        return Engine.open(spark, folder)
    return Engine(spark, load(spark, folder), vectors=table(spark, folder, "vectors"), sources=table(spark, folder, "sources"), pdgs=pdgs(spark, folder))


def main(args: list[str]) -> int:
    command = args[1].replace("_", "-") if len(args) > 1 else ""
    if command not in COMMANDS and command != "group" or command == "group" and (len(args) < 3 or args[2] not in GROUP):
        print(__doc__, "\ncommands:", ", ".join([*COMMANDS, *(f"group {g}" for g in GROUP)]))
        return 2
    folder, rest = args[0], args[2:]
    options = dict(x[2:].split("=", 1) for x in rest if x.startswith("--") and "=" in x)
    words = [x for x in rest if not x.startswith("--")]
    spark = SparkSession.builder.appName("weftline").getOrCreate()
    ship(spark)
    engine = _engine(spark, folder)
    if command == "group":
        got = getattr(engine, GROUP[words[0]])(*words[1:], **options)
    elif command == "check":
        got = engine.check(words, **options)
    elif command == "detect-changes":  # the working tree of a repo's folder against a ref
        got = engine.detect_changes(git_diff(spark, words[0], *words[1:2]), **options)
    else:
        got = getattr(engine, COMMANDS[command])(*words, **options)
    for part in got if isinstance(got, tuple) else (got,):
        if isinstance(part, DataFrame):
            part.show(50, truncate=False)
        else:
            print(part)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
