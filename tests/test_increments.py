import pytest
from pyspark.sql import functions as F

from loglattice.operators import increments
from loglattice.session import work_path

LIST = "listing_id long, run_no int, file_id string, file_path string, strategy string, file_size long"
OFF = "id string, strategy string, byte_offset long, run_no int, created_at string, updated_at string"


def test_start_positions(spark):
    runs = spark.createDataFrame([(1, "ok"), (2, "failed"), (3, "ok"), (4, "open")], "run_no int, status string")
    files = spark.createDataFrame([
        (1, 4, "a", "/z/a", "s", 100), (2, 4, "a", "/b/a", "s", 100), (3, 4, "a", "/b/a", "other", 100), (4, 4, None, "/n", "s", 9), (5, 4, "cut", "/c", "s", 10), (6, 4, "same", "/d", "s", 50),
        (7, 3, "gone", "/e", "s", 5), (8, 4, "new", "/f", "s", 1), (9, 4, "zero", "/g", "s", 0), (10, 4, "failed", "/h", "s", 30), (11, 4, "null", "/i", None, 7),
    ], LIST)
    saved = spark.createDataFrame([
        ("a", "s", 40, 1, "1", "1"), ("a", "s", 60, 3, "2", "2"), ("a", "s", 60, 3, "2", "3"), ("a", "s", 99, 2, "9", "9"), ("cut", "s", 20, 3, "1", "1"), ("same", "s", 50, 1, "1", "1"),
        ("failed", "s", 10, 2, "1", "1"), ("gone", "s", 5, 3, "1", "1"), (None, "s", 5, 3, "1", "1"), ("a", "s", None, 3, "4", "4"), ("a", "s", 77, None, "4", "4"),
    ], OFF)
    got = {r["listing_id"]: r["start_pos"] for r in increments.to_read(files, saved, runs).collect()}
    assert got == {2: 60, 3: 0, 5: 0, 8: 0, 10: 0, 11: 0}
    assert {r["file_id"] for r in increments.removed_files(files, saved, runs).collect()} == {"gone"}
    kinds = {r["listing_id"]: r["change"] for r in increments.version_delta(increments.open_manifest(files, runs), increments.processed_ranges(saved, runs)).collect()}
    assert kinds == {2: "grown", 3: "added", 5: "shrunk", 6: "same", 8: "added", 9: "added", 10: "added", 11: "added"}


def test_empty_tables(spark):
    runs = spark.createDataFrame([], "run_no int, status string")
    assert increments.to_read(spark.createDataFrame([], LIST), spark.createDataFrame([], OFF), runs).count() == 0


def test_commits_are_whole_and_happen_once(spark):
    t = increments.VersionedTable(spark, work_path(spark, "versions"))
    assert t.manifest()["version"] == -1 and t.versions() == []
    assert t.commit(spark.range(3), "1")
    assert not t.commit(spark.range(9), "1")  # the run is repeated
    with pytest.raises(Exception):
        t.commit(spark.range(1).select(F.raise_error(F.lit("lost")).alias("id")), "2")
    assert t.commit(spark.range(10, 12), "2", deleted=spark.range(1))
    assert [r["id"] for r in t.read("id long", ["id"]).orderBy("id").collect()] == [1, 2, 10, 11]
    assert t.read("id long", ["id"], 0).count() == 3 and t.read("id long", ["id"], -1).count() == 0
    change = t.changes(0)
    assert len(change["added"]) == 1 and not change["removed"] and len(change["deleted"]) == 1
    assert t.changes(1) == {"added": [], "removed": [], "deleted": []}
    with pytest.raises(RuntimeError):
        t._publish({"version": 1, "folders": []})
    assert t.manifest()["folders"]


def test_source_versions_need_no_order(spark):
    t = increments.VersionedTable(spark, work_path(spark, "versions"))
    assert [t.commit(spark.range(1), v) for v in ("9", "10", "9", "1", "10")] == [True, True, False, True, False]
    assert t.manifest()["committed"] == ["9", "10", "1"] and t.manifest(1)["processed"] == "10"


def test_record_changes(spark):
    t = increments.VersionedTable(spark, work_path(spark, "versions"))
    rows = lambda *ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, v string")
    t.commit(rows(1, 2, 3, 3, None), "a")
    t.commit(rows(4, 2), "b", deleted=rows(2, None).select("id"))
    assert sorted((r["id"] or 0) for r in t.read("id long, v string", ["id"]).collect()) == [1, 2, 3, 3, 4]  # the deletion is older than the new 2
    told = lambda *v: sorted(((r["id"] or 0), r["change"]) for r in t.record_changes("id long, v string", ["id"], *v).collect())
    assert told(0) == [(0, "removed"), (2, "added"), (2, "removed"), (4, "added")]
    assert told(-1, 0) == [(0, "added"), (1, "added"), (2, "added"), (3, "added"), (3, "added")]
    whole = t.read("id long, v string", ["id"])
    t.commit(whole.unionByName(rows(9)), "c", replaces=t.manifest()["folders"])  # compaction, and one more row
    assert told(1) == [(9, "added")] and told(2) == []
    assert told(0) == [(0, "removed"), (2, "added"), (2, "removed"), (4, "added"), (9, "added")] or told(0) == [(0, "removed"), (4, "added"), (9, "added")]
    t.vacuum()
    assert t.versions() == [2] and t.read("id long, v string", ["id"]).count() == 6


def test_two_committers_one_wins(spark):
    from concurrent.futures import ThreadPoolExecutor

    path = work_path(spark, "versions")
    tables = [increments.VersionedTable(spark, path) for _ in range(8)]
    staged = [t.stage(spark.range(k, k + 1)) for k, t in enumerate(tables)]

    def publish(k):
        try:
            tables[k]._publish({"version": 0, "folders": {staged[k]: 0}, "deleted": {}, "processed": str(k), "committed": [str(k)], "state": {}})
            return k
        except RuntimeError:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [k for k in pool.map(publish, range(8)) if k is not None]
    assert len(won) == 1 and tables[0].versions() == [0] and [r["id"] for r in tables[0].read("id long", ["id"]).collect()] == won


def test_runs_that_go_on(spark):
    files = increments.FileVersions(spark, work_path(spark, "runs"))
    seen = lambda *rows: spark.createDataFrame([(k, s, i, p, n) for i, (k, s, p, n) in enumerate(rows)], "file_id string, strategy string, listing_id long, file_path string, file_size long")
    todo = lambda since: {r["file_id"]: (r["change"], r["start_pos"]) for r in files.delta(since).collect()}
    files.open(seen(("a", "s", "/a", 10), ("b", None, "/b", 5)), "listing 9")
    assert todo(-1) == {"a": ("added", 0), "b": ("added", 0)}
    read = files.delta(-1).select("file_id", "strategy", F.col("file_size").alias("done_to"))
    assert files.finish(read, 9) and not files.finish(read, 9)  # the run is repeated after its commit
    files.open(seen(("a", "s", "/renamed", 30), ("c", "s", "/c", 1)), "listing 10")
    assert not files.open(seen(("a", "s", "/x", 1)), "listing 10")
    assert todo(1) == {"a": ("grown", 10), "c": ("added", 0)}  # run 10 fails here: no commit, nothing is lost
    assert todo(1) == {"a": ("grown", 10), "c": ("added", 0)}
    assert {r["file_id"] for r in files.removed().collect()} == {"b"}
    files.finish(spark.createDataFrame([("a", "s", 30)], "file_id string, strategy string, done_to long"), 10)
    files.open(seen(("a", "s", "/a", 7)), "listing 11")
    assert todo(3) == {"a": ("shrunk", 0)}
