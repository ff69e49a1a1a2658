"""Log replay: which actions are live, as DataFrames.

Newer actions win. The commits after a checkpoint are few; they are deduplicated among themselves and only their keys
meet the checkpoint, in an anti join whose small side Spark may broadcast. So a checkpoint of any size is neither shuffled
nor sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dv_id(dv: str) -> F.Column:
    """What tells deletion vectors apart: storage, path or content, and offset."""
    return F.when(
        F.col(dv).isNotNull(),
        F.concat(F.col(f"{dv}.storageType"), F.col(f"{dv}.pathOrInlineDv"), F.when(F.col(f"{dv}.offset").isNotNull(), F.concat(F.lit("@"), F.col(f"{dv}.offset").cast("string"))).otherwise("")),
    )


def file_actions(actions: DataFrame) -> DataFrame:
    """Adds and removes with their key (path, dv) and version."""
    path = F.coalesce("add.path", "remove.path")
    dv = F.coalesce(dv_id("add.deletionVector"), dv_id("remove.deletionVector"), F.lit(""))
    return actions.where("add is not null or remove is not null").select(path.alias("path"), dv.alias("dv"), "add", "remove", "version")


def newest(files: DataFrame) -> DataFrame:
    """The newest action of each key; of one version an add before a remove."""
    order = Window.partitionBy("path", "dv").orderBy(F.col("version").desc(), F.col("add").isNull())
    return files.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def live_files(commits: DataFrame, checkpoint: DataFrame | None) -> DataFrame:
    """The adds that are part of the version, one row each with the version that added it."""
    recent = newest(file_actions(commits))
    adds = recent.where("add is not null").select("add.*", "version")
    if checkpoint is None:
        return adds
    old = file_actions(checkpoint).where("add is not null")
    return old.join(recent.select("path", "dv"), ["path", "dv"], "left_anti").select("add.*", "version").unionByName(adds)


def tombstones(commits: DataFrame, checkpoint: DataFrame | None, expired_before: int) -> DataFrame:
    """Removes that a checkpoint must keep: not shadowed, and not older than the retention."""
    recent = newest(file_actions(commits))
    gone = recent.where("remove is not null").select("remove", "version")
    if checkpoint is not None:
        old = file_actions(checkpoint).where("remove is not null")
        gone = old.join(recent.select("path", "dv"), ["path", "dv"], "left_anti").select("remove", "version").unionByName(gone)
    return gone.where(F.coalesce("remove.deletionTimestamp", F.lit(0)) > expired_before)


def newest_of(actions: DataFrame, kind: str, key: str) -> DataFrame:
    """The newest action of a kind for each key, as a struct column of the kind's name."""
    return actions.where(F.col(kind).isNotNull()).groupBy(F.col(f"{kind}.{key}").alias("k")).agg(F.max_by(kind, "version").alias(kind)).drop("k")
