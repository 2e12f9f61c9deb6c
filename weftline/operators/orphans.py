"""Problem 3: references to records that do not exist.

The operator keeps keyed state and takes time slices one after the other, each with what happened in it: references that came, records
that began, records that ended. State, in buckets of the key (repo, id): the parent index, one row per key with how many of its records live and how many
references of each table it holds; the references that wait, as they named nothing alive and no record of their key came since; and those that such a
record resolved. A slice reads and rewrites only the buckets of its keys. New references probe the parent index as it was at their time; records that
begin resolve what waits; records that end take the key's count down, and with it every reference it holds stands orphaned again, in one row per
key and not one per reference. After each slice the standing orphans are counted from the index.

What is alive is decided at event times, so rows that arrive late count at the time they carry. References of a key are dealt to several tasks
where they are more than one should take, by what the slice holds of each key; each task reads them in order of time beside the key's events.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.edges import clean_kind, is_edge
from weftline.operators.hotkeys import TASK_ROWS, salted
from weftline.sources.scratch import counted, keep, place

TABS = ("edges", "routes", "func_pdgs")
BUCKET_ROWS = 500_000
"""Rows per bucket of the state, on average, with 8 buckets at least and 4,096 at most."""


def references(edges: DataFrame, routes: DataFrame, func_pdgs: DataFrame) -> DataFrame:
    """(tab, repo, ord, id, at): what each table refers to, rows as delivered.

    Left out: rows that are no edges, edges of kind imports and constructs, null or empty targets.
    A reference without a time belongs to no period and finds nothing alive; it comes out with a null period.
    """
    e = edges.where(is_edge() & ~F.coalesce(clean_kind(), F.lit("")).isin("imports", "constructs")).select(F.lit("edges").alias("tab"), "repo", "ord", F.col("dst").alias("id"), F.col("indexed_at").alias("at"))
    r = routes.where("handler <> ''").select(F.lit("routes").alias("tab"), "repo", "ord", F.col("handler").alias("id"), F.col("indexed_at").alias("at"))
    p = func_pdgs.where("id <> ''").select(F.lit("func_pdgs").alias("tab"), "repo", "ord", "id", F.col("indexed_at").alias("at"))
    return e.unionByName(r).unionByName(p)


def lives(nodes: DataFrame) -> DataFrame:
    """(repo, id, start, end) of each record's lives, once; end is null while it lives."""
    return nodes.where("id IS NOT NULL AND repo IS NOT NULL AND indexed_at IS NOT NULL").select("repo", "id", F.col("indexed_at").alias("start"), F.col("removed_at").alias("end")).distinct()


def events(lived: DataFrame) -> DataFrame:
    """(repo, id, t, delta, starts): how the number of living records of a key changes at a time, and whether a record begins then.

    A life that ends no later than it begins is never seen alive; it begins, and changes nothing. One without a start ends only.
    """
    real = F.col("end").isNull() | F.col("start").isNull() | (F.col("end") > F.col("start"))
    begin = F.struct(F.col("start").alias("t"), real.cast("bigint").alias("delta"), F.lit(True).alias("starts"))
    end = F.when(real, F.struct(F.col("end").alias("t"), F.lit(-1).cast("bigint").alias("delta"), F.lit(False).alias("starts")))
    e = lived.select("repo", "id", F.explode(F.array(begin, end)).alias("e")).where("e.t IS NOT NULL").select("repo", "id", "e.*")
    return e.groupBy("repo", "id", "t").agg(F.sum("delta").alias("delta"), F.max("starts").alias("starts"))


@dataclass
class Slices:
    """References and events on disk, cut by time. touched: slice -> buckets of its keys. n: slice -> its references."""

    refs: str
    events: str
    buckets: int
    touched: dict[int, list[int]]
    n: dict[int, int]


_FOLDER = "((?:index|orphans)-[0-9a-f]{32}/.*bucket=[0-9]+)/"
"""What tells a bucket's folder from others, however the file system writes what is before it."""


@dataclass
class State:
    """index, waiting: bucket -> folder. resolved: folders.

    at: the type of times. hot: keys whose references are dealt to several tasks, if they are known; else each slice counts its own. seen: references so far.
    told: what was counted of a folder, which never changes.
    """

    spark: SparkSession
    buckets: int
    at: str
    hot: DataFrame | None = None
    index: dict[int, str] = field(default_factory=dict)
    waiting: dict[int, str] = field(default_factory=dict)
    resolved: list[str] = field(default_factory=list)
    seen: int = 0
    told: dict[str, dict[str, int]] = field(default_factory=dict)

    def standing(self) -> dict[str, int]:
        """Table -> references delivered so far whose record isn't alive now; those without a time are not among them. Only folders that changed since the last count are read."""
        dead = [F.sum(F.when(F.col("living") <= 0, F.col(t)).otherwise(0)).alias(t) for t in TABS]
        return self._counted(list(self.index.values()), _INDEX, lambda df: df.groupBy("_at").agg(*dead))

    @property
    def waits(self) -> dict[str, int]:
        """Table -> references that wait for a first record, those without a time not among them."""
        one = [F.count_if((F.col("tab") == t) & F.col("at").isNotNull()).alias(t) for t in TABS]
        return self._counted(list(self.waiting.values()), _ORPHANS.format(at=self.at), lambda df: df.groupBy("_at").agg(*one))

    def _counted(self, paths: list[str], schema: str, count: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
        new = [p for p in paths if p not in self.told]
        if new:
            name = F.regexp_extract(F.input_file_name(), _FOLDER, 1)
            got = {r["_at"]: {t: r[t] for t in TABS} for r in count(_read(self.spark, schema, new).withColumn("_at", name)).collect()}  # a row per folder
            self.told.update({p: got.get(re.search(_FOLDER, p + "/")[1], dict.fromkeys(TABS, 0)) for p in new})
        return {t: sum(self.told[p][t] for p in paths) for t in TABS}

    @property
    def orphans(self) -> DataFrame:
        """(tab, repo, ord, id, at, resolved_at) so far."""
        return _read(self.spark, _ORPHANS.format(at=self.at), self.resolved + list(self.waiting.values()))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("repo", "id"), F.lit(buckets)).cast("int")


def cut(refs: DataFrame, changes: DataFrame, cuts: list[datetime], buckets: int | None = None) -> Slices:
    """Both written once, by slice. buckets follows from the number of rows if it isn't given. A reference at a cut comes after it, an event at a cut before it: references see the events of their own time."""
    spark, at = refs.sparkSession, refs.schema["at"].dataType.simpleString()
    number = lambda c, later: sum((F.coalesce(later(F.col(c), F.lit(x).cast("timestamp_ntz").cast(at)), F.lit(False)).cast("int") for x in cuts), F.lit(0))
    places = place(spark, "refs"), place(spark, "events")
    n = counted(refs.withColumn("slice", number("at", lambda a, b: a >= b)), places[0], by="slice")
    buckets = buckets or max(8, min(4096, n // BUCKET_ROWS))
    counted(changes.withColumn("slice", number("t", lambda a, b: a > b)), places[1], by="slice")
    here = Slices(*places, buckets, {}, {})
    key = [F.col("slice"), _bucket(buckets).alias("bucket")]
    r, e = (spark.read.schema(s + ", slice int").parquet(p) for s, p in ((_REFS.format(at=at), places[0]), (_EVENTS.format(at=at), places[1])))
    rows = r.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).unionByName(e.groupBy(*key).agg(F.lit(0).cast("bigint").alias("n"))).collect()  # slices x buckets
    for x in rows:
        here.touched.setdefault(x.slice, []).append(x.bucket)
        here.n[x.slice] = here.n.get(x.slice, 0) + x.n
    return here


_REFS = "tab string, repo string, ord bigint, id string, at {at}"
_EVENTS = "repo string, id string, t {at}, delta bigint, starts boolean"
_ORPHANS = "tab string, repo string, ord bigint, id string, at {at}, resolved_at {at}"
_INDEX = "repo string, id string, living bigint, " + ", ".join(f"{t} bigint" for t in TABS)


def _read(spark: SparkSession, schema: str, paths: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _probe(refs: DataFrame, living: DataFrame, changes: DataFrame, n: int, hot: DataFrame | None) -> DataFrame:
    """(repo, id, tab, lost, ord, at, n): each lost reference of the slice once, and per key and table how many others there are, repeated rows once.

    One pass over each key's rows in order of time: the living records before the slice, then events and references as they come.
    """
    a = refs.select("repo", "id", F.col("at").alias("t"), F.lit(1).alias("step"), F.lit(0).cast("bigint").alias("delta"), "tab", "ord")
    b = living.select("repo", "id", F.lit(None).cast(a.schema["t"].dataType).alias("t"), F.col("living").alias("delta")).unionByName(changes.select("repo", "id", "t", "delta"))
    a, b = salted(a, b, ["repo", "id"], F.col("ord"), n, hot)
    b = b.select("repo", "id", "t", F.lit(0).alias("step"), "delta", F.lit(None).cast("string").alias("tab"), F.lit(None).cast("bigint").alias("ord"), "salt")
    order = W.partitionBy("repo", "id", "salt").orderBy("t", "step", "tab", "ord")
    same = F.lag("step").over(order) == 1
    for c in ("tab", "ord", "t"):
        same &= F.lag(c).over(order).eqNullSafe(F.col(c))
    rows = a.unionByName(b).withColumns({"living": F.sum("delta").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)), "again": F.coalesce(same, F.lit(False))})
    told = rows.where("step = 1 AND NOT again").withColumn("lost", F.col("t").isNull() | (F.col("living") <= 0))
    only = lambda c: F.when(F.col("lost"), F.col(c))
    return told.groupBy("repo", "id", "tab", "lost", only("ord").alias("ord"), only("t").alias("at")).agg(F.count(F.lit(1)).alias("n"))


def _resolve(waiting: DataFrame, changes: DataFrame, n: int, hot: DataFrame | None) -> DataFrame:
    """waiting with resolved_at: when the first record of its key began after the reference, if one did. Read backwards in time, each key's rows give it on the way."""
    a = waiting.select("repo", "id", F.col("at").alias("t"), F.lit(1).alias("step"), "tab", "ord", F.lit(None).cast(waiting.schema["at"].dataType).alias("start"))
    a, b = salted(a, changes.where("starts").select("repo", "id", "t"), ["repo", "id"], F.col("ord"), n, hot)
    b = b.select("repo", "id", "t", F.lit(0).alias("step"), F.lit(None).cast("string").alias("tab"), F.lit(None).cast("bigint").alias("ord"), F.col("t").alias("start"), "salt")
    order = W.partitionBy("repo", "id", "salt").orderBy(F.desc("t"), F.desc("step"))
    first = F.min("start").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = a.unionByName(b).withColumn("first", first).where("step = 1")
    return rows.select("tab", "repo", "ord", "id", F.col("t").alias("at"), F.when(F.col("t").isNotNull(), F.col("first")).alias("resolved_at"))


def start(refs: DataFrame, index: DataFrame | None = None, buckets: int = 64) -> State:
    """An empty state. refs gives the type of its times only."""
    return State(refs.sparkSession, buckets, refs.schema["at"].dataType.simpleString())


def advance(state: State, refs: DataFrame, arrived: DataFrame) -> State:
    """The state after a slice of references and of records' lives: those that began in it, with their end if they also ended, and those that only ended, with an empty start."""
    return _step(state, cut(refs, events(arrived), [], state.buckets), 0)


def _step(state: State, slices: Slices, i: int) -> State:
    """The state after slice i. An empty slice changes nothing."""
    spark = state.spark
    touched = sorted(set(slices.touched.get(i, [])))
    if not touched:
        return state
    at, n = state.at, slices.n.get(i, 0)
    cutof = lambda path, schema: _read(spark, schema.format(at=at), [f"{path}/slice={i}"] if _names(spark, f"{path}/slice={i}") else [])
    refs, changes = cutof(slices.refs, _REFS), cutof(slices.events, _EVENTS)
    old = _read(spark, _INDEX, [state.index[b] for b in touched if b in state.index])
    probed = keep(_probe(refs, old.where("living <> 0").select("repo", "id", "living"), changes, n, state.hot), "probed")
    # the index: counts add up, so a hot key is one row per task that saw it
    zero = F.lit(0).cast("bigint")
    count = [F.when((F.col("tab") == t) & ~(F.col("lost") & F.col("at").isNull()), F.col("n")).otherwise(zero).alias(t) for t in TABS]
    new = probed.select("repo", "id", zero.alias("living"), *count).unionByName(changes.select("repo", "id", F.col("delta").alias("living"), *(zero.alias(t) for t in TABS)))
    new = new.groupBy("repo", "id").agg(*(F.sum(c).alias(c) for c in ("living", *TABS))).unionByName(old)
    new = new.withColumn("bucket", _bucket(slices.buckets)).repartition("bucket").groupBy("bucket", "repo", "id").agg(*(F.sum(c).alias(c) for c in ("living", *TABS)))
    base = place(spark, "index")
    new.write.partitionBy("bucket").parquet(base)
    index = state.index | {b: f"{base}/bucket={b}" for b in touched}
    # who waits
    lost = probed.where("lost").select("tab", "repo", "ord", "id", "at")
    before = _read(spark, _ORPHANS.format(at=at), [state.waiting[b] for b in touched if b in state.waiting])
    base = place(spark, "orphans")
    seen = state.seen + n
    n_wait = seen if seen <= TASK_ROWS else lost.count() + before.count()
    told = _resolve(lost.unionByName(before.select("tab", "repo", "ord", "id", "at")), changes, n_wait, state.hot)
    told.withColumns({"done": F.col("resolved_at").isNotNull(), "bucket": _bucket(slices.buckets)}).write.partitionBy("done", "bucket").parquet(base)
    left = {done: [f"{base}/done={done}/{x}" for x in _names(spark, f"{base}/done={done}") if x.startswith("bucket=")] for done in ("true", "false")}
    waiting = {b: p for b, p in state.waiting.items() if b not in touched} | {int(p.rsplit("=", 1)[1]): p for p in left["false"]}
    return State(spark, state.buckets, at, state.hot, index, waiting, state.resolved + left["true"], seen, state.told)


def _names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it isn't there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def _run(edges: DataFrame, nodes: DataFrame, routes: DataFrame, func_pdgs: DataFrame, cuts: list[datetime], after: Callable[[int, State], None] | None = None) -> State:
    refs = references(edges, routes, func_pdgs)
    slices = cut(refs, events(lives(nodes)), cuts)
    state = start(refs, buckets=slices.buckets)
    for i in range(len(cuts) + 1):
        state = _step(state, slices, i)
        if after:
            after(i, state)
    return state


def orphans(edges: DataFrame, nodes: DataFrame, routes: DataFrame, func_pdgs: DataFrame, slices: int = 2) -> DataFrame:
    """(tab, period, repo, ord, id, at, resolved_at) of each reference that named nothing alive at its time.

    resolved_at: when the first record of its key began after it, whatever became of that record. The tables are taken in `slices` time slices of equal
    length, as they would come day by day. Empty tables give no rows.
    """
    low, high = nodes.agg(F.min("indexed_at"), F.max("indexed_at")).first()
    cuts: list[datetime] = [low + (high - low) * i / slices for i in range(1, slices)] if low is not None else []
    found = _run(edges, nodes, routes, func_pdgs, cuts).orphans
    return found.select("tab", F.date_format("at", "yyyy-MM").alias("period"), "repo", "ord", "id", "at", "resolved_at")


def orphan_report(found: DataFrame) -> DataFrame:
    """(tab, period, orphans, resolved, waiting): counts per table and month of the reference. Both come from the state: a reference waits until a record of its key begins."""
    return found.groupBy("tab", "period").agg(F.count(F.lit(1)).alias("orphans"), F.count("resolved_at").alias("resolved"), F.count_if(F.col("resolved_at").isNull()).alias("waiting"))


def _monthly(edges: DataFrame, nodes: DataFrame, routes: DataFrame, func_pdgs: DataFrame) -> list[tuple[str, str, int, int]]:
    """(tab, period, standing, reopened) at each month's end: the state takes month after month and is counted after each."""
    ends = references(edges, routes, func_pdgs).agg(F.min(F.trunc("at", "MM")).alias("lo"), F.max(F.trunc("at", "MM")).alias("hi")).first()
    rows: list[tuple[str, str, int, int]] = []
    if ends.lo is not None:
        months = [divmod(m, 12) for m in range(ends.lo.year * 12 + ends.lo.month - 1, ends.hi.year * 12 + ends.hi.month)]
        cuts = [datetime(y + (m == 11), (m + 1) % 12 + 1, 1) for y, m in months]

        def count(i: int, state: State) -> None:
            if i < len(months):
                stand, waits = state.standing(), state.waits
                rows.extend((t, "{:04d}-{:02d}".format(months[i][0], months[i][1] + 1), stand[t], stand[t] - waits[t]) for t in TABS if stand[t])

        _run(edges, nodes, routes, func_pdgs, cuts, count)
    return rows


def standing_orphans(edges: DataFrame, nodes: DataFrame, routes: DataFrame, func_pdgs: DataFrame) -> DataFrame:
    """(tab, period, standing): references delivered by the end of each month whose record is not alive then, from the state.

    This also has references that were good and lost their record later. Tables and months without any give no row.
    """
    return edges.sparkSession.createDataFrame([r[:3] for r in _monthly(edges, nodes, routes, func_pdgs)], "tab string, period string, standing bigint")


def reopened_orphans(edges: DataFrame, nodes: DataFrame, routes: DataFrame, func_pdgs: DataFrame) -> DataFrame:
    """(tab, period, reopened): those of standing_orphans that deletions reopened: a record of their key was alive at their time or began after it, and is gone."""
    return edges.sparkSession.createDataFrame([(t, p, n) for t, p, _, n in _monthly(edges, nodes, routes, func_pdgs)], "tab string, period string, reopened bigint")
