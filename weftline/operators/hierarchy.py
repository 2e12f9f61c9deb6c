"""Problem 2: parent-child links to full hierarchies.

Bottom-up leaf peeling. A peel round takes every node without remaining children, sends the number of them and the sum of
their subtree sizes to the parents (combined on the map side, so a container with a third of all children is one state per
task), and takes them away. Reversed, the order of the rounds hands paths, depths and roots down: a peeled node's container
was peeled later, so it is known already. Nodes that no round can take lie on a loop.

Trees are wide at the bottom and thin above: the first `rounds` rounds, run as joins over all nodes, take nearly all of
them. What remains (nodes at least `rounds` levels above a leaf, closed under "container of") is peeled to its end with one
task per repo where a repo has at most `bound` remaining nodes. Larger remainders (very long chains, say, which a round would take
node by node) are resolved by pointer jumping: every node learns the ancestor 1, 2, 4, 8 ... steps up, so a chain of any length takes as many
joins as its length has binary digits. So no task ever holds more than `bound` nodes, whatever the shape.

Descendant lists go up the same way (`descendant_lists`): a peeled node sends itself and the lists that it received to its parent. They travel as rows of a
receiver and a short list, never as one list per ancestor: that of a top package may hold a third of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.edges import clean_kind, is_edge
from weftline.operators.hotkeys import MOST_HOT, TASK_ROWS, salted, spread
from weftline.sources.scratch import keep

BOUND = 100_000
"""Most nodes of one repo that a single task peels."""


def containers(edges: DataFrame, kind: str = "defines") -> DataFrame:
    """(repo, id, parent) of each id at either end of an edge of the kind; parent is null at the top.

    Repeated rows count once. Should an id have several containers, the first by ord holds, then the smallest name.
    Rows that are no edges give nothing, an empty table no rows.
    """
    e = edges.where(is_edge() & (clean_kind() == kind)).select("repo", "src", "dst", "ord")
    up = e.groupBy("repo", F.col("dst").alias("id")).agg(F.min(F.struct(F.coalesce("ord", F.lit(2**63 - 1)).alias("o"), F.col("src").alias("s"))).alias("first"))
    ends = up.select("repo", "id", F.col("first.s").alias("parent"))
    tops = e.select("repo", F.col("src").alias("id"), F.lit(None).cast("string").alias("parent"))
    return ends.unionByName(tops).groupBy("repo", "id").agg(F.max("parent").alias("parent"))


def _on(a: DataFrame, b: DataFrame, left: str, right: str):
    return a["repo"].eqNullSafe(b["repo"]) & (a[left] == b[right])


def _peeled(nodes: DataFrame) -> DataFrame:
    """One round over (repo, id, parent, kids, size): what the rest looks like once the nodes without kids are gone."""
    told = nodes.where("kids = 0 AND parent IS NOT NULL").groupBy(F.col("repo").alias("m_repo"), F.col("parent").alias("m_id")).agg(F.count(F.lit(1)).alias("gone"), F.sum("size").alias("below"))
    rest = nodes.where("kids > 0")
    return rest.join(told, rest["repo"].eqNullSafe(told["m_repo"]) & (rest["id"] == told["m_id"]), "left").select(
        "repo", "id", "parent", (F.col("kids") - F.coalesce("gone", F.lit(0))).alias("kids"), (F.col("size") + F.coalesce("below", F.lit(0))).alias("size")
    )


def _finish(with_paths: bool):
    """Peels what is left of one repo: at most BOUND rows of (repo, id, parent, kids, size)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy()
        n = len(ids)
        at = {x: i for i, x in enumerate(ids)}
        up = np.fromiter((-1 if p is None or p != p else at[p] for p in pdf["parent"]), np.int64, n)
        kids = np.bincount(up[up >= 0], minlength=n)
        size = pdf["size"].to_numpy().astype(np.int64)
        order: list[np.ndarray] = []
        level = np.flatnonzero(kids == 0)
        while len(level):
            order.append(level)
            kids[level] = -1
            child = level[up[level] >= 0]
            par = up[child]
            np.add.at(size, par, size[child])
            np.subtract.at(kids, par, 1)
            par = np.unique(par)
            level = par[kids[par] == 0]
        looped = kids >= 0  # nothing could take them
        root, depth = np.full(n, -1), np.full(n, -1, np.int64)
        paths: list = [None] * n
        for level in reversed(order):
            p = up[level]
            top = p < 0
            good = ~top & np.where(top, False, root[p] >= 0)
            root[level] = np.where(top, level, np.where(good, root[p], -1))
            depth[level] = np.where(top, 0, np.where(good, depth[p] + 1, -1))
            if with_paths:
                for i, q in zip(level.tolist(), p.tolist(), strict=True):
                    if root[i] >= 0:
                        paths[i] = [ids[i]] if q < 0 else [*paths[q], ids[i]]
        out = pd.DataFrame({"repo": pdf["repo"], "id": ids, "root": np.where(root >= 0, ids[root], ""), "depth": depth, "size": size, "looped": looped})
        if with_paths:
            out["path"] = paths
        return out

    return run


def _jumped(rest: DataFrame, with_paths: bool) -> DataFrame:
    """The same for repos of any number of (repo, id, parent, kids, size), by pointer jumping.

    Round k knows of each node the ancestor 2^k steps up (null if the way up is shorter), where the way up has led so far and in how many steps, and the
    sizes of all fewer than 2^k steps below. Once 2^k exceeds the number of nodes, who still has an ancestor is on a loop or below one, and these ancestors are those on it.
    """
    same = lambda a, b, x, y: a["repo"].eqNullSafe(b["repo"]) & (a[x] == b[y])
    at = rest.select("repo", "id", F.col("parent").alias("up"), F.coalesce("parent", "id").alias("top"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("steps"), "size", *[F.when(F.col("parent").isNull(), F.array().cast("array<string>")).otherwise(F.array("id")).alias("path")] * with_paths)
    at = keep(at, "jump")
    n, k = at.count(), 0
    while (1 << k) <= n and at.where("up IS NOT NULL").take(1):
        below = at.where("up IS NOT NULL").groupBy(F.col("repo").alias("b_repo"), F.col("up").alias("b_id")).agg(F.sum("size").alias("more"))
        above = at.select("repo", F.col("id").alias("up"), F.col("up").alias("u_up"), F.col("top").alias("u_top"), F.col("steps").alias("u_steps"), *[F.col("path").alias("u_path")] * with_paths)
        a, u = salted(at, above, ["repo", "up"], F.col("id"), n)
        u = u.withColumnsRenamed({"repo": "u_repo", "up": "u_id", "salt": "u_salt"})
        got = a.join(u, a["repo"].eqNullSafe(u["u_repo"]) & (a["up"] == u["u_id"]) & (a["salt"] == u["u_salt"]), "left")
        got = got.join(below, got["repo"].eqNullSafe(below["b_repo"]) & (got["id"] == below["b_id"]), "left")
        path = [F.when(F.col("u_id").isNull(), F.col("path")).otherwise(F.concat("u_path", "path")).alias("path")] * with_paths
        at = keep(got.select("repo", "id", F.col("u_up").alias("up"), F.coalesce("u_top", "top").alias("top"), (F.col("steps") + F.coalesce("u_steps", F.lit(0))).alias("steps"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), *path), "jump")
        k += 1
    loop = at.where("up IS NOT NULL").select("repo", F.col("up").alias("id"), F.lit(True).alias("looped")).distinct().withColumnsRenamed({"repo": "l_repo", "id": "l_id"})
    out = at.join(loop, at["repo"].eqNullSafe(loop["l_repo"]) & (at["id"] == loop["l_id"]), "left")
    ended = F.col("up").isNull()
    return out.select("repo", "id", F.when(ended, F.col("top")).otherwise("").alias("root"), F.when(ended, F.col("steps")).otherwise(-1).alias("depth"), "size", F.coalesce("looped", F.lit(False)).alias("looped"), *[F.when(ended, F.concat(F.array("top"), "path")).alias("path")] * with_paths)


def _peel(edges: DataFrame, kind: str, rounds: int, bound: int, with_paths: bool) -> tuple[list[DataFrame], DataFrame, int, int]:
    """(layers, top, most, n): the layers (repo, id, parent, kids, size) in the order in which they were peeled; what was left, known to its end; the most children of a node; the nodes."""
    nodes = keep(containers(edges, kind), "nodes")
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("repo").alias("k_repo"), F.col("parent").alias("k_id")).agg(F.count(F.lit(1)).alias("kids"))
    rest = nodes.join(kids, nodes["repo"].eqNullSafe(kids["k_repo"]) & (nodes["id"] == kids["k_id"]), "left").select("repo", "id", "parent", F.coalesce("kids", F.lit(0)).alias("kids"), F.lit(1).cast("bigint").alias("size"))
    rest = keep(rest, "round")
    layers: list[DataFrame] = []
    widest, every = 0, 0
    while True:
        most, leaves, wide, n = rest.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kids") == 0).alias("k"), F.max("kids").alias("w")).agg(F.max("n"), F.sum("k"), F.max("w"), F.sum("n")).first()
        if not layers:
            widest, every = wide or 0, n or 0
        if not most or len(layers) >= rounds or not leaves:
            break
        layers.append(rest.where("kids = 0"))
        rest = keep(_peeled(rest), "round")
    path = ", path array<string>" if with_paths else ""
    finish = lambda df: df.groupBy("repo").applyInPandas(_finish(with_paths), f"repo string, id string, root string, depth bigint, size bigint, looped boolean{path}")
    if most and most > bound:
        count = rest.groupBy(F.col("repo").alias("c_repo")).agg(F.count(F.lit(1)).alias("n"))
        big = keep(count.where(F.col("n") > bound).select("c_repo"), "big")
        on = rest["repo"].eqNullSafe(big["c_repo"])
        top = finish(rest.join(big, on, "left_anti")).unionByName(_jumped(rest.join(big, on, "left_semi"), with_paths))
    else:
        top = finish(rest)
    return layers, keep(top, "top"), widest, every


def _hot_parents(layer: DataFrame, budget: int) -> DataFrame:
    """(repo, parent, salts): containers of more rows of a layer than a task should take; fewer than MOST_HOT."""
    n = layer.where("parent IS NOT NULL").groupBy("repo", "parent").agg(F.count(F.lit(1)).alias("n"))
    return keep(n.where(F.col("n") > budget).select("repo", "parent", F.ceil(F.col("n") / budget).cast("int").alias("salts")), "hot")


def hierarchy(edges: DataFrame, kind: str = "defines", rounds: int = 2, bound: int = BOUND, with_paths: bool = True, budget: int = TASK_ROWS) -> DataFrame:
    """(repo, id, parent, root, depth, size[, path]) of each id of the `kind` trees, once.

    size counts the node and all below it. path leads from the root to the id, both included. Going up from a node on a loop or
    below one never ends: root is '', depth null, path null; looped tells those on the loop, whose size is null.
    A null repo is a repo of its own. An empty table gives no rows. Children of one container are dealt to several tasks where they are more than `budget`.
    """
    layers, known, widest, n = _peel(edges, kind, rounds, bound, with_paths)
    budget = max(budget, n // MOST_HOT)
    for layer in reversed(layers):
        up = known.select("repo", F.col("id").alias("parent"), F.col("root").alias("u_root"), F.col("depth").alias("u_depth"), *[F.col("path").alias("u_path")] * with_paths)
        if widest > budget:
            layer, up = spread(layer, up, ["repo", "parent"], F.col("id"), _hot_parents(layer, budget))
        else:
            layer, up = layer.withColumn("salt", F.lit(0)), up.withColumn("salt", F.lit(0))
        up = up.withColumnsRenamed({"repo": "u_repo", "parent": "u_id", "salt": "u_salt"})
        got = layer.join(up, layer["repo"].eqNullSafe(up["u_repo"]) & (layer["parent"] == up["u_id"]) & (layer["salt"] == up["u_salt"]), "left").select(
            "repo",
            "id",
            F.when(F.col("parent").isNull(), F.col("id")).otherwise(F.col("u_root")).alias("root"),
            F.when(F.col("parent").isNull(), 0).when(F.col("u_depth") >= 0, F.col("u_depth") + 1).otherwise(-1).cast("bigint").alias("depth"),
            "size",
            F.lit(False).alias("looped"),
            *[F.when(F.col("parent").isNull(), F.array("id")).otherwise(F.concat("u_path", F.array("id"))).alias("path")] * with_paths,
        )
        known = known.unionByName(got)
        if len(layers) > 3:  # else the plan doubles with each layer
            known = keep(known, "known")
    return known.select("repo", "id", "root", F.when(F.col("depth") >= 0, F.col("depth")).alias("depth"), F.when(~F.col("looped"), F.col("size")).alias("size"), "looped", *["path"] * with_paths)


def descendant_lists(edges: DataFrame, kind: str = "defines", block: int = 10_000, rounds: int = 2, bound: int = BOUND) -> DataFrame:
    """(repo, id, block_no, members): all symbols below each id, as sorted blocks of about `block` at most, from lists sent up while the leaves are peeled.

    A peeled node sends its parent itself and every list that it received; the nodes that were left send along the paths they are known by. Ids on loops or below loops,
    and ids with nothing below them, give no row.
    """
    layers, top, _, _ = _peel(edges, kind, rounds, bound, True)
    sent: list[DataFrame] = []  # (repo, id, members): what a receiver got in one round

    def received(by: DataFrame) -> DataFrame | None:
        """(repo, to, members): the lists that the nodes of (repo, id, to) received so far, addressed to `to`."""
        if not sent:
            return None
        lists = sent[0]
        for x in sent[1:]:
            lists = lists.unionByName(x)
        b = by.withColumnsRenamed({"repo": "b_repo", "id": "b_id"})
        return lists.join(b, lists["repo"].eqNullSafe(b["b_repo"]) & (lists["id"] == b["b_id"])).select("repo", "to", "members")

    def send(by: DataFrame) -> None:
        own = by.select("repo", "to", F.array("id").alias("members"))
        got = received(by)
        sent.append(keep((own if got is None else own.unionByName(got)).select("repo", F.col("to").alias("id"), "members"), "lists"))

    for layer in layers:
        send(layer.where("parent IS NOT NULL").select("repo", "id", F.col("parent").alias("to")))
    send(top.where("size(path) > 1").select("repo", "id", F.explode(F.expr("slice(path, 1, size(path) - 1)")).alias("to")))
    lists = sent[0]
    for x in sent[1:]:
        lists = lists.unionByName(x)
    # what was sent to nodes on loops or below loops has no end: they have no root
    bad = top.where("root = ''").select(F.col("repo").alias("x_repo"), F.col("id").alias("x_id"))
    for layer in reversed(layers):
        more = layer.join(bad, layer["repo"].eqNullSafe(bad["x_repo"]) & (layer["parent"] == bad["x_id"]), "left_semi").select(F.col("repo").alias("x_repo"), F.col("id").alias("x_id"))
        bad = bad.unionByName(more)
    lists = lists.join(bad, lists["repo"].eqNullSafe(bad["x_repo"]) & (lists["id"] == bad["x_id"]), "left_anti")
    known = top.where("root <> ''").select("repo", "id", "size")
    for layer in layers:
        known = known.unionByName(layer.select("repo", "id", "size"))
    big = known.where(F.col("size") > block).select(F.col("repo").alias("s_repo"), F.col("id").alias("s_id"), F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    lists = lists.join(big, lists["repo"].eqNullSafe(big["s_repo"]) & (lists["id"] == big["s_id"]), "left")
    one = lists.where("blocks IS NULL").groupBy("repo", "id").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("members")).select("repo", "id", F.lit(0).alias("block_no"), "members")
    dealt = lists.where("blocks IS NOT NULL").select("repo", "id", "blocks", F.explode("members").alias("member"))
    many = dealt.groupBy("repo", "id", F.pmod(F.xxhash64("member"), "blocks").cast("int").alias("block_no")).agg(F.sort_array(F.collect_list("member")).alias("members"))
    return one.unionByName(many)


def descendants(tree: DataFrame, block: int = 10_000) -> DataFrame:
    """The same from a finished tree with paths. Pairs come from the paths: each node names all its containers, so no join is needed. The members of an id are dealt by hash to
    size / block + 1 blocks, so no list outgrows a task. Ids with nothing below them, on loops or below loops give no row.
    """
    pairs = tree.where("size(path) > 1").select("repo", F.col("id").alias("member"), F.explode(F.expr("slice(path, 1, size(path) - 1)")).alias("id"))
    sizes = tree.where("size >= " + str(block)).select("repo", "id", F.col("size").alias("big"))  # others need one block; containers of many are few
    cut = pairs.join(sizes, ["repo", "id"], "left").withColumn("block_no", F.pmod(F.xxhash64("member"), F.coalesce(F.col("big"), F.lit(0)) / F.lit(block) + 1).cast("int"))
    return cut.groupBy("repo", "id", "block_no").agg(F.sort_array(F.collect_list("member")).alias("members"))
