"""Stored offsets of files: one for each (id, strategy), the latest wins."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.operators.increments import VersionedTable

SCHEMA = "id string, strategy string, path string, byte_offset long, created_at timestamp, updated_at timestamp, seq long, deleted boolean"


class OffsetStore:
    """Saves are appended as versions of a table in a shared folder; reading merges them, deletions included.

    After ``most`` saves they are written anew as one. There is one writer.
    """

    def __init__(self, spark: SparkSession, path: str, most: int = 32):
        self.spark, self.table, self.most = spark, VersionedTable(spark, path), most

    def _append(self, rows: DataFrame, deleted: bool, tries: int = 5) -> None:
        """Commits; where another run commits at the same time, tries again after 50, 100 and so on milliseconds."""
        for k in range(tries):
            try:
                return self._commit(rows, deleted)
            except RuntimeError:
                if k + 1 == tries:
                    raise
                time.sleep(0.05 * (k + 1))

    def _commit(self, rows: DataFrame, deleted: bool) -> None:
        seq = self.table.manifest()["version"] + 1
        now = F.current_timestamp()
        cols = {"created_at": now, "updated_at": now, "seq": F.lit(seq).cast("long"), "deleted": F.lit(deleted)}
        full = rows.withColumns({k: v for k, v in cols.items()}).select(*[F.col(c.split()[0]) for c in SCHEMA.split(", ")])
        if not self.table.commit(full, str(seq), after=seq - 1, remember=1):
            raise RuntimeError(f"offsets {seq} were saved by another run")
        if len(self.table.manifest()["folders"]) > self.most:
            self.compact()

    def compact(self) -> None:
        """Writes what is stored now as one folder and deletes the older ones; as a commit, so a failure loses nothing."""
        m = self.table.manifest()
        rows = self.load().withColumns({"seq": F.lit(m["version"] + 1).cast("long"), "deleted": F.lit(False)})
        self.table.commit(rows.select(*[c.split()[0] for c in SCHEMA.split(", ")]), str(m["version"] + 1), after=m["version"], replaces=m["folders"], remember=1)
        self.table.vacuum()

    def save(self, rows: DataFrame) -> None:
        """Upserts (id, strategy, path, byte_offset)."""
        self._append(rows.select("id", "strategy", "path", F.col("byte_offset").cast("long")), False)

    def delete(self, keys: DataFrame) -> None:
        """Removes (id, strategy)."""
        self._append(keys.select("id", "strategy", F.lit(None).cast("string").alias("path"), F.lit(0).cast("long").alias("byte_offset")), True)

    def load(self) -> DataFrame:
        """(id, strategy, path, byte_offset, created_at, updated_at): what is stored now."""
        rows = self.table.read_folders(self.table.manifest()["folders"], SCHEMA)
        last = F.max_by(F.struct("path", "byte_offset", "updated_at", "deleted"), "seq").alias("l")
        out = rows.groupBy("id", "strategy").agg(last, F.min("created_at").alias("created_at")).where(~F.col("l.deleted"))
        return out.select("id", "strategy", "l.path", "l.byte_offset", "created_at", "l.updated_at")
