"""Which files are new, gone, known or changed, as joins of listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_paths(listing: DataFrame, file_id: str = "file_id", path: str = "path") -> DataFrame:
    """One row for each identity: its first path in byte order, and how many paths have it. Null identities are skipped."""
    return listing.where(F.col(file_id).isNotNull()).groupBy(F.col(file_id).alias("file_id")).agg(F.min(path).alias("path"), F.count(F.lit(1)).alias("n_paths"))


def new_files(seen: DataFrame, tracked: DataFrame) -> DataFrame:
    return seen.join(tracked.select("file_id"), "file_id", "left_anti")


def removed_files(seen: DataFrame, tracked: DataFrame) -> DataFrame:
    return tracked.join(seen.select("file_id"), "file_id", "left_anti")


def with_offsets(files: DataFrame, offsets: DataFrame) -> DataFrame:
    """Adds the stored byte_offset of (file_id, strategy), 0 where none is stored; of several the one updated last."""
    last = offsets.groupBy(F.col("id").alias("__id"), F.col("strategy").alias("__s")).agg(F.max_by("byte_offset", F.struct("updated_at", "byte_offset")).alias("byte_offset"))
    both = files.drop("byte_offset").join(last, (F.col("file_id") == F.col("__id")) & (F.col("strategy") == F.col("__s")), "left")
    return both.drop("__id", "__s").withColumn("byte_offset", F.coalesce("byte_offset", F.lit(0)).cast("long"))


def stale(tracked: DataFrame, current: DataFrame) -> DataFrame:
    """Tracked files whose path now has another identity, or none."""
    now = current.select(F.col("path").alias("__path"), F.col("file_id").alias("current_id"))
    both = tracked.join(now, F.col("path") == F.col("__path"), "left").drop("__path")
    return both.where(F.col("current_id").isNull() | (F.col("current_id") != F.col("file_id")))


def with_paths(events: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Adds the path under which each event's file_id is registered; empty if it is not."""
    known = files.where(F.col("file_id").isNotNull()).groupBy(F.col("file_id").alias("__id")).agg(F.min("path").alias("__path"))
    both = events.drop(path).join(known, F.col("file_id") == F.col("__id"), "left")
    return both.withColumn(path, F.coalesce("__path", F.lit(""))).drop("__id", "__path")
