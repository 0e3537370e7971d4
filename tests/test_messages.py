import re

import pytest
from pyspark.sql import functions as F

from loglattice.operators import messages
from loglattice.session import work_path

EV = "event_id long, line string, file string, file_id string, byte_pos long, batch_no long"
A = "type=PATH msg=audit({}:{}): item={} name=x"


def brute(rows):
    """keep_id by event, by union-find over all the rules."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    stamps = {}
    for r in rows:
        m = re.match(r"type=(\w+) msg=audit\(([\d.]+):(\d+)\)", r[1] or "")
        key = None
        if m and r[2] is not None:
            item = re.search(r" item=(\d+)", r[1])
            sec, _, frac = m[2].partition(".")
            key = (r[2], sec, frac.rstrip("0"), m[3], m[1], item and item[1])
            stamps.setdefault(key, []).append(r)
        if r[3] is not None and r[4] is not None:
            parent[find(("e", r[0]))] = find(("p", r[3], r[4]))
        find(("e", r[0]))
    for group in stamps.values():
        if any(r[3] is None or r[4] is None for r in group):
            for r in group:
                parent[find(("e", r[0]))] = find(("e", group[0][0]))
    keep = {}
    for r in rows:
        keep[find(("e", r[0]))] = min(keep.get(find(("e", r[0])), r[0]), r[0])
    return {r[0]: keep[find(("e", r[0]))] for r in rows}


ROWS = [
    (1, "x", "/f", "f", 0, 1), (2, "x ", "/f.1", "f", 0, 2), (3, "x", "/f", "f", 2, 2), (4, "y", "/f", "f", None, 2), (5, "y", "/f", None, 0, 3), (6, None, None, None, None, 1),
    (7, A.format("1.50", 9, 0), "/a", "a", 0, 1), (8, A.format("1.5", 9, 0), "/a", None, None, 2), (9, A.format("1.5", 9, 1), "/a", None, None, 2), (10, A.format("1.5", 9, 0), "/b", None, None, 2),
    (11, A.format("2.5", 9, 0), "/a", "a", 90, 1), (12, A.format("2.5", 9, 0), "/a", "b", 90, 1), (13, A.format("3.5", 9, 0), "/a", "a", 200, 1), (14, A.format("3.5", 9, 0), "/b", "a", 200, 1),
    (15, A.format("3.5", 9, 0), "/b", None, None, 3), (16, A.format("3.5", 9, 0), "/a", "c", 7, 3), (17, A.format("3.5", 9, 0), "/a", None, 4, 3), (18, "type=NOTE op=x", "/a", None, None, 1), (19, "type=NOTE op=x", "/a", None, None, 1),
    (20, "", "", "", 0, 1), (21, "", "", "", 0, 1),
]


def test_rules(spark):
    got = {r["drop_id"]: r["keep_id"] for r in messages.dropped_copies(spark.createDataFrame(ROWS, EV)).collect()}
    assert got == {e: k for e, k in brute(ROWS).items() if e != k}
    assert messages.dropped_copies(spark.createDataFrame([], EV)).count() == 0


def test_whole_table(spark, table):
    events = table("line_events")
    rows = [tuple(r) for r in events.select(*(c.split()[0] for c in EV.split(", "))).collect()]
    got = {r["drop_id"]: r["keep_id"] for r in messages.dropped_copies(events).collect()}
    assert got == {e: k for e, k in brute(rows).items() if e != k} and got


def test_deliveries_keep_one_copy_in_all(spark):
    keys = [(i, f"k{i % 40}", 0) for i in range(1, 301)]
    store, kept = messages.SeenMessages(spark, work_path(spark, "seen")), []
    for part in range(3):
        rows = [k for k in keys if (k[0] // 7) % 3 == part]
        df = spark.createDataFrame(rows, "event_id long, k_a string, k_b long")
        out = [store.deliver(df, str(part)).collect() for _ in range(2 if part == 2 else 1)][0]
        kept += [r["event_id"] for r in out if r["new"] and r["event_id"] == r["keep_id"]]
    assert len(kept) == 40
    words = store.dictionary()
    assert words.count() == 40 == words.select("shard", "code").distinct().count()
    assert store.seen().agg(F.sum(F.bitmap_count("bits"))).first()[0] == 40
    again = store.deliver(spark.createDataFrame(keys, "event_id long, k_a string, k_b long"), "9").collect()
    assert not any(r["new"] for r in again) and len(again) == 300


def test_many_deliveries_and_late_retries(spark, monkeypatch):
    store, schema = messages.SeenMessages(spark, work_path(spark, "seen")), "event_id long, k_a string, k_b long"
    make = lambda part: spark.createDataFrame([(10 * part + 1, f"k{part}", 0), (10 * part + 2, "all", 0)], schema)
    kept = lambda df: sorted(r["event_id"] for r in df.collect() if r["new"] and r["event_id"] == r["keep_id"])

    def lost(*args, **kwargs):
        raise OSError("lost")

    with monkeypatch.context() as m:  # delivery 5 fails before its commit
        m.setattr(store.table, "_publish", lost)
        with pytest.raises(OSError):
            store.deliver(make(5), "5")
    for part in (0, 1, 9, 10, 11, 2):
        got = store.deliver(make(part), str(part))
        assert got.count() == 2 and kept(got) == ([1, 2] if part == 0 else [10 * part + 1]), part
    assert kept(store.deliver(make(5), "5")) == [51]
    for part in (3, 4, 6, 7, 8, 12):
        assert kept(store.deliver(make(part), str(part))) == [10 * part + 1]
    for part in (0, 5, 10):  # a repeated delivery gives the same again
        assert kept(store.deliver(make(part), str(part))) == ([1, 2] if part == 0 else [10 * part + 1])
    assert store.dictionary().count() == 14 == store.seen().agg(F.sum(F.bitmap_count("bits"))).first()[0]
    with pytest.raises(ValueError):
        store.deliver(make(99), "10")


def test_deliveries_know_only_what_came_before(spark):
    more = [
        (30, A.format("7.5", 1, 0), "/a", None, None, 0), (31, A.format("7.5", 1, 0), "/a", "a", 300, 0), (32, "spoiled", "/b", "a", 300, 0),
        (33, A.format("8.5", 1, 0), "/a", "a", 400, 0), (34, A.format("8.5", 1, 0), "/a", "b", 1, 0), (35, A.format("8.5", 1, 0), "/a", None, None, 0), (36, A.format("8.5", 1, 0), "/a", None, None, 0),
    ]
    rows, orders = [*ROWS, *more], [lambda e: 0 if e in (30, 33, 34) else 1 if e in (31, 35) or e % 2 else 2, lambda e: (e * 7 + e // 5) % 3]
    for order in orders:
        store, before = messages.SeenMessages(spark, work_path(spark, "seen")), []
        for part in range(3):
            now = [r for r in rows if order(r[0]) == part]
            first = brute(before + now)  # the rows of a later delivery are not known yet
            seen = {first[r[0]] for r in before}
            want = sorted(min(r[0] for r in now if first[r[0]] == c) for c in {first[r[0]] for r in now} - seen)
            df = spark.createDataFrame(now, EV)
            for _ in range(1 + (part == 1)):
                got = store.deliver_events(df, str(part)).collect()
                assert len(got) == len(now) and sorted(r["event_id"] for r in got if r["new"] and r["event_id"] == r["keep_id"]) == want, part
            assert all(first[r["keep_id"]] == first[r["event_id"]] for r in got)
            before += now


def test_a_first_delivery_tests_its_bits(spark, monkeypatch):
    store, tested = messages.SeenMessages(spark, work_path(spark, "seen")), []
    bit_at = messages.bit_at
    monkeypatch.setattr(messages, "bit_at", lambda *a: tested.append(1) or bit_at(*a))
    got = store.deliver(spark.createDataFrame([(1, "a", 0), (2, "a", 0)], "event_id long, k_a string, k_b long"), "0").collect()
    assert tested and sorted(map(tuple, got)) == [(1, 1, True), (2, 1, True)]
