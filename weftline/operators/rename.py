"""Renaming a symbol: the files to look at, the lines to change, and how sure that is."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import Graph

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def confidence(g: Graph) -> DataFrame:
    """(repo, id, confidence): 1 if no other symbol of the repo has the name, else 1 / how many have it."""
    n = g.nodes.groupBy("repo", "name").agg(F.count(F.lit(1)).alias("n"))
    return g.nodes.select("repo", "id", "name").join(n, ["repo", "name"]).select("repo", "id", (1 / F.col("n")).alias("confidence"))


def reference_files(g: Graph, seeds: DataFrame) -> DataFrame:
    """(repo, id, file): the symbol's own file, the files of all sources of edges into it, and for types all files of its package."""
    s = seeds.select("repo", "id").distinct()
    own = g.nodes.join(s, ["repo", "id"], "left_semi")
    into = g.edges.select("repo", "src", F.col("dst").alias("id")).distinct().join(s, ["repo", "id"], "left_semi")
    used = into.join(g.nodes.select("repo", F.col("id").alias("src"), "file"), ["repo", "src"]).select("repo", "id", "file")
    pack = own.where(F.col("kind").isin("type", "interface", "class")).select("repo", "id", "package").join(g.nodes.select("repo", "package", "file").distinct(), ["repo", "package"]).select("repo", "id", "file")
    return own.select("repo", "id", "file").unionByName(used).unionByName(pack).where("file <> ''").distinct()


def word_hits(files: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, lines): hits (repo, id, file, pos) of lines of each (repo, id, file, name) that hold the name as a whole ASCII word; lines (repo, file, pos, text), from 0.

    Lines are cut once per file, whatever the number of its symbols, and meet the names by their words. Names with other characters than words have are looked for in each line of their file.
    """
    own = files.select("repo", "id", "file", "name").distinct()
    lines = sources.where("content IS NOT NULL").select("repo", "file", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    plain = F.col("name").rlike("^[A-Za-z0-9_]+$")
    words = lines.select("repo", "file", "pos", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0)))).alias("name"))
    hits = words.join(own.where(plain), ["repo", "file", "name"]).select("repo", "id", "file", "pos")
    if own.where(~plain).take(1):
        odd = F.expr(r"contains(text, name) AND rlike(text, concat('(?<![A-Za-z0-9_])\\Q', name, '\\E(?![A-Za-z0-9_])'))")
        hits = hits.unionByName(lines.join(own.where(~plain), ["repo", "file"]).where(odd).select("repo", "id", "file", "pos"))
    return hits.distinct(), lines


def word_lines(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(repo, id, file, line, text) of the lines of word_hits. Lines count from 1; of several contents of a file each has its lines."""
    hits, lines = word_hits(files, sources)
    return hits.join(lines, ["repo", "file", "pos"]).select("repo", "id", "file", (F.col("pos") + 1).alias("line"), "text").distinct()


def plan(g: Graph, sources: DataFrame, repo: str, id: str, new: str) -> DataFrame:
    """(file, line, text, changed, confidence): the lines a rename would change. Nothing is written.

    The new name must be an identifier other than the old one, and the id known, else it is an error. Symbols of the same name in these files would be
    renamed too; confidence tells how likely that is.
    """
    if not _NAME.match(new):
        raise ValueError(f"not an identifier: {new!r}")
    own = g.nodes.where((F.col("repo") == repo) & (F.col("id") == id))
    node = own.select("name").first()
    if node is None:
        raise KeyError(f"{repo}: no symbol {id!r}")
    if node.name == new:
        raise ValueError("the new name is the old one")
    files = reference_files(g, own).withColumn("name", F.lit(node.name))
    lines = word_lines(files, sources)
    pattern = rf"(?<![A-Za-z0-9_])\Q{node.name}\E(?![A-Za-z0-9_])"
    sure = confidence(g).where((F.col("repo") == repo) & (F.col("id") == id)).select("confidence")
    return lines.select("file", "line", "text", F.regexp_replace("text", pattern, new).alias("changed")).crossJoin(F.broadcast(sure)).orderBy("file", "line")  # one row


def apply(changes: DataFrame, root: str) -> int:
    """Writes a plan's lines into the files below root, one file after the other; returns how many files. The only operator that touches sources."""
    from itertools import groupby

    done = 0
    rows = changes.select("file", "line", "changed").orderBy("file", "line").toLocalIterator()
    for file, edits in groupby(rows, key=lambda r: r.file):
        if not (file.startswith(root.rstrip("/") + "/") and "/../" not in file):
            raise ValueError(f"{file} lies outside {root}")
        with open(file, encoding="utf-8", newline="") as f:
            lines = f.read().split("\n")
        for e in edits:
            lines[e.line - 1] = e.changed
        with open(file, "w", encoding="utf-8", newline="") as f:
            f.write("\n".join(lines))
        done += 1
    return done
