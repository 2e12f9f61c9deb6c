"""Problem 4: what changed between full snapshots.

Each snapshot is cut to one row per key with a canonical hash of what counts as a change; two snapshots that follow each other in a
repo meet in a full outer join on the key. A missing side gives an addition or a removal, unequal hashes a change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.sources.scratch import keep

SALTS = 16


def canonical(rows: DataFrame) -> DataFrame:
    """(snapshot_no, repo, id, row_hash): per snapshot and id the row with the lowest ord; a null ord comes last.

    The hash is the MD5 of line and signature written so that no two contents read alike: line, U+0001, signature; a null
    signature is ''. Rows with a null or empty id, or without snapshot or repo, don't count. Ties of ord are broken by the hash.
    """
    text = F.concat(F.coalesce(F.col("line").cast("string"), F.lit("-")), F.lit("\u0001"), F.coalesce("signature", F.lit("")))
    rows = rows.where("id <> '' AND repo IS NOT NULL AND snapshot_no IS NOT NULL").select("snapshot_no", "repo", "id", F.struct(F.coalesce("ord", F.lit(2**63 - 1)).alias("o"), F.unhex(F.md5(text)).alias("h")).alias("row"))
    return rows.groupBy("snapshot_no", "repo", "id").agg(F.min("row").alias("row")).select("snapshot_no", "repo", "id", F.col("row.h").alias("row_hash"))


def snapshot_changes(rows: DataFrame) -> DataFrame:
    """(snapshot_no, repo, id, change) against the last earlier snapshot that has rows of the repo.

    A repo's first snapshot gives no rows. The canonical rows are written once; the chain of snapshots and both sides of the join are read from them. The list of snapshots of each repo is short; it meets the rows on (repo, snapshot_no, salt),
    with the salt taken from the id, so that a repo with a third of all rows is spread over 16 tasks.
    """
    rows = keep(canonical(rows), "canonical")
    seen = rows.select("repo", "snapshot_no").distinct()
    order = W.partitionBy("repo").orderBy("snapshot_no")
    chain = seen.select("repo", "snapshot_no", F.lead("snapshot_no").over(order).alias("next_no"), F.lag("snapshot_no").over(order).alias("prev_no"))
    chain = chain.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # only now: exploded rows are no neighbours
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(chain, ["repo", "snapshot_no", "salt"])
    now = rows.where("prev_no IS NOT NULL").select("repo", "snapshot_no", "id", F.col("row_hash").alias("new_hash"))
    before = rows.where("next_no IS NOT NULL").select("repo", F.col("next_no").alias("snapshot_no"), "id", F.col("row_hash").alias("old_hash"))
    both = now.join(before, ["repo", "snapshot_no", "id"], "full")
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "changed")
    return both.select("snapshot_no", "repo", "id", change.alias("change")).where("change IS NOT NULL")


def change_counts(changes: DataFrame) -> DataFrame:
    """(snapshot_no, change, n) over all repos."""
    return changes.groupBy("snapshot_no", "change").agg(F.count(F.lit(1)).alias("n"))
