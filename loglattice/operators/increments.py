"""Reading only what is new: table versions, their difference, and commits that carry the version they processed.

A *version* is the immutable manifest of one run: which files (content identity and strategy) exist and how long they
are. What an earlier successful run has read of a file is its deletion vector, one range from byte 0 to the offset
saved. The difference of two manifests gives files to read from 0, files to read from an offset, and files that are gone.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.session import work_path


def open_manifest(listings: DataFrame, runs: DataFrame, status: str = "open") -> DataFrame:
    """The manifest of the open run: one row for each (file_id, strategy), its first path in byte order.

    Files without identity (too short to fingerprint) are not in it. Of listings equal in path the smallest id counts.
    """
    now = runs.where(F.col("status") == status).select("run_no").distinct()
    seen = listings.where(F.col("file_id").isNotNull()).join(now, "run_no", "left_semi")
    first = F.min_by(F.struct("listing_id", "file_path", "file_size"), F.struct("file_path", "listing_id")).alias("f")
    return seen.groupBy("file_id", "strategy").agg(first).select("file_id", "strategy", "f.*")


def processed_ranges(offsets: DataFrame, runs: DataFrame) -> DataFrame:
    """The deletion vector of each (file_id, strategy): bytes [0, done_to) were read by the latest ok run that saved one.

    Offsets of runs that failed or are unknown count for nothing, however late they were saved. Of several offsets one
    run saved for a file the one updated last counts, then the larger.
    """
    ok = runs.where(F.col("status") == "ok").select("run_no").distinct()
    saved = offsets.where(F.col("id").isNotNull() & F.col("byte_offset").isNotNull()).join(ok, "run_no", "left_semi")
    last = F.max_by("byte_offset", F.struct("run_no", "updated_at", "created_at", "byte_offset")).alias("done_to")
    return saved.groupBy(F.col("id").alias("file_id"), "strategy").agg(last, F.max("run_no").alias("by_run"))


def version_delta(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """The manifest with ``change`` (added, grown, same, shrunk) and ``start_pos``, where reading has to start.

    A file now shorter than its vector was written anew and is read from 0. Null strategies match each other.
    """
    d = done.select(F.col("file_id").alias("d_id"), F.col("strategy").alias("d_strategy"), "done_to")
    both = manifest.join(d, (F.col("file_id") == F.col("d_id")) & F.col("strategy").eqNullSafe(F.col("d_strategy")), "left")
    size = F.coalesce("file_size", F.lit(0))
    return both.select(
        "listing_id", "file_id", "strategy", "file_path", "file_size",
        F.when(F.col("done_to").isNull(), "added").when(size < F.col("done_to"), "shrunk").when(size > F.col("done_to"), "grown").otherwise("same").alias("change"),
        F.when(size >= F.col("done_to"), F.col("done_to")).otherwise(0).cast("long").alias("start_pos"),
    )


class VersionedTable:
    """A table of immutable versions in a shared folder. A commit holds data folders, what it removes, and progress.

    ``_log/<n>.json`` is the manifest of version n: the live data folders with the version that added each, the folders
    of deleted keys with theirs, and the source versions processed so far. A commit becomes visible by one atomic
    create of its manifest, so output and progress are saved together or not at all: a run that fails before leaves no
    trace, one that is repeated finds its source version committed and does nothing. Source versions are names: they
    may be committed in any order. Of two runs that commit from the same version one wins and the other gets an error.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/_log/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/_log")
        if not self._fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """folders: the live data folders, and the version that added each; deleted: folders of keys whose rows in data

        added before no longer count, with their version; processed: the source version; committed: all source versions
        up to this one, in order of commit; state: what else belongs to the version. Version -1 is the empty table.
        """
        all_versions = self.versions() if version is None else [version]
        if not all_versions or all_versions[-1] < 0:
            return {"version": -1, "folders": {}, "deleted": {}, "processed": None, "committed": [], "state": {}}
        return self._read(f"{all_versions[-1]:020d}.json")

    def stage(self, rows: DataFrame, kind: str = "data") -> str:
        """Writes ``rows`` to a new folder, which belongs to no version until a commit names it."""
        folder = f"{kind}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def commit(self, rows: DataFrame | str | None, processed: str, deleted: DataFrame | str | None = None, state: dict | None = None, after: int | None = None, replaces: Iterable[str] = (), remember: int | None = None) -> bool:
        """Adds ``rows`` (or a staged folder) and takes away the folders ``replaces`` and the rows of older folders whose

        keys are in ``deleted``, all as the output for the source version ``processed``. False if that was committed
        before. ``state`` replaces that of the version before. With ``after``, the output was made from that version, and
        if another run committed since, an error is raised. ``remember``: how many of the last source versions stay listed.
        """
        last = self.manifest()
        if after is not None and last["version"] != after:
            raise RuntimeError(f"version {after + 1} was committed by another run")
        if processed in last["committed"]:
            return False
        version, gone = last["version"] + 1, set(replaces)
        entry = {"version": version, "folders": {f: v for f, v in last["folders"].items() if f not in gone}, "deleted": dict(last["deleted"]), "processed": processed}
        entry |= {"committed": [*last["committed"], processed][-remember if remember else 0 :], "state": last["state"] if state is None else state}
        if rows is not None:
            entry["folders"][rows if isinstance(rows, str) else self.stage(rows)] = version
        if deleted is not None:
            entry["deleted"][deleted if isinstance(deleted, str) else self.stage(deleted, "deleted")] = version
        self._publish(entry)
        return True

    def _publish(self, entry: dict) -> None:
        """Creates the manifest whole, or fails if there is one: a hard link on a mounted file system, else a rename that
        does not replace (HDFS), else, on object stores, a create that does not replace and shows at its close."""
        target, data = self._path(f"{self.path}/_log/{entry['version']:020d}.json"), json.dumps(entry).encode()
        taken = RuntimeError(f"version {entry['version']} was committed by another run")
        kind = self._fs.getScheme() if target.toUri().getScheme() is None else target.toUri().getScheme()
        if kind == "file":
            place = target.toUri().getPath()
            os.makedirs(os.path.dirname(place), exist_ok=True)
            draft = os.path.join(os.path.dirname(place), f".{uuid.uuid4().hex}")
            with open(draft, "xb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(draft, place)
            except FileExistsError:
                raise taken from None
            finally:
                os.unlink(draft)
            return
        draft = self._path(f"{self.path}/_log/.{uuid.uuid4().hex}") if kind in ("hdfs", "viewfs") else target
        try:
            out = self._fs.create(draft, False)
            out.write(bytearray(data))
            out.close()
            if draft is not target:
                jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
                how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, how)
        except Exception as e:
            if draft is not target:
                self._fs.delete(draft, False)
            if "AlreadyExists" in str(e):
                raise taken from None
            raise

    def vacuum(self) -> None:
        """Deletes all manifests but the last, and all folders that it does not name; no one may still read an older version."""
        last = self.manifest()
        state = {f for v in last["state"].values() if isinstance(v, list) for f in v}
        for v in self.versions()[:-1]:
            self._fs.delete(self._path(f"{self.path}/_log/{v:020d}.json"), False)
        for kind in self._fs.listStatus(self._path(self.path)):
            if (name := kind.getPath().getName()) != "_log":
                for s in self._fs.listStatus(kind.getPath()):
                    if (folder := f"{name}/{s.getPath().getName()}") not in last["folders"] and folder not in last["deleted"] and folder not in state:
                        self._fs.delete(s.getPath(), True)

    def changes(self, since: int, until: int | None = None) -> dict[str, list[str]]:
        """Data folders added and removed, and deletion folders added, between two versions: only manifests are read."""
        a, b = self.manifest(since), self.manifest(until)
        return {
            "added": [f for f in b["folders"] if f not in a["folders"]],
            "removed": [f for f in a["folders"] if f not in b["folders"]],
            "deleted": [f for f in b["deleted"] if f not in a["deleted"]],
        }

    def read_folders(self, folders: Iterable[str], schema) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _staged(self, folders: dict[str, int], schema, version: str) -> DataFrame:
        """The rows of folders with the version that added them, by the name of the folder in each file's path."""
        rows = self.read_folders(folders, schema).withColumn(version, F.regexp_extract("_metadata.file_path", r"/([0-9a-f]{32})/[^/]*\z", 1))
        added = self.spark.createDataFrame([(f.rpartition("/")[2], v) for f, v in folders.items()], f"__folder string, `{version}_n` int")
        rows = rows.join(added, F.col(version) == F.col("__folder"))
        return rows.drop(version, "__folder").withColumnRenamed(f"{version}_n", version)

    def read(self, schema, keys: list[str], version: int | None = None) -> DataFrame:
        """The live rows as of a version: those of its folders, less those whose ``keys`` were deleted after they came."""
        m = self.manifest(version)
        return self._less_deleted(m["folders"], m["deleted"], schema, keys)

    def _less_deleted(self, folders: dict[str, int], deleted: dict[str, int], schema, keys: list[str], hit: bool = False) -> DataFrame:
        """Rows of ``folders`` that no later deletion takes away; with ``hit``, those that one does."""
        if not folders or not deleted:
            rows = self.read_folders(folders, schema)
            return rows.limit(0) if hit else rows
        rows = self._staged(folders, schema, "__v")
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        gone = self._staged(deleted, ", ".join(f"`{k}` {kinds[k]}" for k in keys), "__d").groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.max("__d").alias("__d"))
        same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
        return rows.join(gone, same & (F.col("__v") < F.col("__d")), "left_semi" if hit else "left_anti").drop("__v")

    def record_changes(self, schema, keys: list[str], since: int, until: int | None = None) -> DataFrame:
        """The rows added and removed between two versions, with ``change``: added or removed.

        Only folders that one version has and the other has not are read, and the kept ones that a new deletion may hit.
        Rows that a commit moved from replaced folders to a new one are no change.
        """
        a, b, c = self.manifest(since), self.manifest(until), self.changes(since, until)
        pick = lambda folders, of: {f: of[f] for f in folders}
        came = self._less_deleted(pick(c["added"], b["folders"]), b["deleted"], schema, keys)
        went = self._less_deleted(pick(c["removed"], a["folders"]), a["deleted"], schema, keys)
        if c["removed"] and c["added"]:
            came, went = came.exceptAll(went), went.exceptAll(came)
        kept = {f: v for f, v in a["folders"].items() if f in b["folders"]}
        if c["deleted"] and kept:
            before = self._less_deleted(kept, a["deleted"], schema, keys)
            cut = self.read_folders(c["deleted"], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in before.schema.fields if f.name in keys)).select(*(F.col(k).alias(f"__{k}") for k in keys))
            same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
            went = went.unionByName(before.join(cut, same, "left_semi"))
        return came.withColumn("change", F.lit("added")).unionByName(went.withColumn("change", F.lit("removed")))


class FileVersions:
    """The files of a collector as versions of a table: manifests of what is there, deletion vectors of what was read.

    Data folders are manifests of listings. Deletion folders are deletion vectors: bytes [0, done_to) of a file, read by a
    run. Saving a vector is the commit of that run's output, so a run that fails has none. What is to be read is the
    difference of two versions: rows of the new manifest, less what vectors take away.
    """

    FILES = "file_id string, strategy string, listing_id long, file_path string, file_size long"
    VECTORS = "file_id string, strategy string, done_to long, by_run long"

    def __init__(self, spark: SparkSession, path: str):
        self.table = VersionedTable(spark, path)

    def import_runs(self, offsets: DataFrame, runs: DataFrame) -> None:
        """Commits what all ok runs of a history have saved, as one version."""
        self.table.commit(None, "history", deleted=processed_ranges(offsets, runs).select("file_id", "strategy", "done_to", F.col("by_run").cast("long")))

    def open(self, manifest: DataFrame, name: str) -> bool:
        """Commits the manifest of a listing, in place of the one before; False if this one was committed already."""
        last = self.table.manifest()
        rows = manifest.select("file_id", "strategy", F.col("listing_id").cast("long"), "file_path", F.col("file_size").cast("long"))
        return self.table.commit(rows, name, replaces=last["folders"], after=last["version"])

    def finish(self, read: DataFrame, run_no: int) -> bool:
        """Commits (file_id, strategy, done_to) that a run has read, with its output; False if the run was committed already."""
        vector = read.select("file_id", "strategy", F.col("done_to").cast("long"), F.lit(run_no).cast("long").alias("by_run"))
        return self.table.commit(None, f"run {run_no}", deleted=vector)

    def _vectors(self, version: int | None) -> DataFrame:
        rows = self.table.read_folders(self.table.manifest(version)["deleted"], self.VECTORS)
        return rows.groupBy("file_id", "strategy").agg(F.max_by("done_to", F.struct("by_run", "done_to")).alias("done_to"))

    def delta(self, since: int = -1, until: int | None = None) -> DataFrame:
        """The files that came with manifests after ``since``, each with its kind of change and where reading starts."""
        added = self.table.changes(since, until)["added"]
        return version_delta(self.table.read_folders(added, self.FILES), self._vectors(until))

    def removed(self, version: int | None = None) -> DataFrame:
        """Files that runs have read and that the manifest no longer lists, in (file_id, strategy, done_to)."""
        now = self.table.read_folders(self.table.manifest(version)["folders"], self.FILES).select(F.col("file_id").alias("n_id"), F.col("strategy").alias("n_strategy"))
        return self._vectors(version).join(now, (F.col("file_id") == F.col("n_id")) & F.col("strategy").eqNullSafe(F.col("n_strategy")), "left_anti")


def run_versions(listings: DataFrame, offsets: DataFrame, runs: DataFrame) -> FileVersions:
    """The version after the ok runs of a history, then the one of the open run's listing, in the shared folder.

    ``history`` is version 0, the open manifest version 1. Rows of no run or without identity are in neither.
    """
    spark = listings.sparkSession
    files = FileVersions(spark, work_path(spark, "runs"))
    files.import_runs(offsets, runs)
    files.open(open_manifest(listings, runs), "open")
    return files


def to_read(listings: DataFrame, offsets: DataFrame, runs: DataFrame) -> DataFrame:
    """The files of the open run that have bytes beyond ``start_pos``: the difference of its version and the history's."""
    return run_versions(listings, offsets, runs).delta(0).where(F.col("file_size") > F.col("start_pos"))


def removed_files(listings: DataFrame, offsets: DataFrame, runs: DataFrame) -> DataFrame:
    """Files that successful runs have read and that the open manifest no longer lists."""
    return run_versions(listings, offsets, runs).removed()
