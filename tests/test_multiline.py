import random

import pytest

from loglattice.operators import multiline, records
from loglattice.options import JAVA, MultilineOptions, OptionError

A = ["ERROR start", "  detail1", "  detail2", "INFO ok", "  cont"]
JAVA_LINES = [
    "ERROR Something failed", "    at com.example.App.main(App.java:10)", "Caused by: java.lang.IllegalStateException: bad", "    at com.example.Service.call(Service.java:42)", "INFO next record",
    "    at com.example.Other.run(Other.java:5)",
]


def by_machine(lines, o):
    m, out = multiline.Machine(o), []
    for x in lines:
        out += m.feed(x)
    return out + m.flush()


def by_windows(spark, files, o, block):
    rows = [(f"f{k}", i, x) for k, lines in enumerate(files) for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "file_id string, idx int, line string")
    out = [[] for _ in files]
    for r in sorted(multiline.grouped(df, o, block).collect(), key=lambda r: (r["file_id"], r["first_idx"])):
        out[int(r["file_id"][1:])].append(r["record"])
    return out


@pytest.mark.parametrize(("mode", "condition", "want"), [
    ("continueThrough", r"^\s", [A[:3], A[3:]]), ("continuePast", r"^\s", [A[:4], A[4:]]), ("haltBefore", r"^(INFO|ERROR)", [A[:3], A[3:]]), ("haltWith", r"^(INFO|ERROR)", [A[:4], A[4:]]),
])
def test_modes(spark, mode, condition, want):
    o = MultilineOptions(mode, "^(ERROR|INFO)", condition, 0.5)
    assert by_machine(A, o) == ["\n".join(w) for w in want] == by_windows(spark, [A], o, 2)[0]


def test_java_preset_and_leading_line(spark):
    o = MultilineOptions(java=True)
    assert o.mode == JAVA["mode"] and o.timeout == 0.5
    assert by_windows(spark, [JAVA_LINES], o, 100)[0] == ["\n".join(JAVA_LINES[:4]), "\n".join(JAVA_LINES[4:])]
    assert by_machine(["DEBUG ignore", *A], MultilineOptions("continueThrough", "^(ERROR|INFO)", r"^\s", 1))[0] == "DEBUG ignore"


@pytest.mark.parametrize("mode", ["continueThrough", "continuePast", "haltBefore", "haltWith", "", "other"])
def test_windows_equal_the_machine_at_every_block_size(spark, mode):
    rng = random.Random(mode)
    for start, cond in ((r"^s", r"c"), (r"^", r"^$") if mode in ("", "haltWith") else (r"c?$", r"c")):
        o = MultilineOptions(mode, start, cond, 1)
        files = [[rng.choice(["", "s", "c", "sc", "x", " "]) for _ in range(rng.randint(1, 14))] for _ in range(150)]
        want = [by_machine(f, o) for f in files]
        for block in (2,):
            got = by_windows(spark, files, o, block)
            assert got == want, [(f, w, g) for f, w, g in zip(files, want, got) if w != g][:2]


def test_validation_and_nulls(spark):
    for bad in (MultilineOptions("haltWith", "", "x", 1), MultilineOptions("haltWith", "x", "", 1), MultilineOptions("haltWith", "x", "x", 0), MultilineOptions("haltWith", "(", "x", 1)):
        with pytest.raises(OptionError):
            bad.validate()
    df = spark.createDataFrame([("f", 0, None), ("f", 1, "s"), (None, 0, "s")], "file_id string, idx int, line string")
    assert multiline.grouped(df.limit(0), MultilineOptions(java=True)).count() == 0
    assert multiline.grouped(df, MultilineOptions(java=True)).count() >= 2


@pytest.mark.parametrize(("text", "sep", "want", "end"), [
    ("line1\nline2\nline3\n", "\n", ["line1", "line2", "line3"], 18), ("a\r\nb\r\nc\r\n", "\r\n", ["a", "b", "c"], 9), ("part1<END>part2<END>part3<END>", "<END>", ["part1", "part2", "part3"], 30),
    ("part1<END>part2<END>part3", "<END>", ["part1", "part2"], 20), ("ERROR start\n  detail1\n  detail2", "\n", ["ERROR start", "  detail1"], 22), ("a\n\nb\n", "\n", ["a", "b"], 5), ("x" * 1000, "\n", [], 0), ("", "\n", [], 0),
    ("é.\\E.ü.\\E.", ".\\E.", ["é", "ü"], 12),
])
def test_records_and_offsets(spark, text, sep, want, end):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, text)], "f int, t string")
    assert [r["line"] for r in records.records(df, "f", "t", sep).orderBy("idx").collect()] == want
    assert df.select(records.consumed(F.col("t"), sep)).first()[0] == end
    rows = records.with_offsets(records.records(df, "f", "t", sep, blank=True), sep)
    assert (rows.agg(F.max("end_pos")).first()[0] or 0) == end
    same = records.records_with_offsets(df, "f", "t", sep)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, rows.select(same.columns).collect()))
    with pytest.raises(ValueError):
        records.chunks(F.col("t"), "")


def test_offsets_of_long_and_missing_contents(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "ü" * 3 + "\n" + "x\n" * 20_000), (2, None), (3, ""), (4, "rest")], "f int, t string")
    got = records.records_with_offsets(df, "f", "t")
    assert got.where("file_id = 1").agg(F.count(F.lit(1)), F.max("end_pos"), F.sum(F.col("end_pos") - F.col("start_pos"))).first()[:] == (20_001, 40_007, 40_007)
    assert got.where("file_id <> 1").count() == 0
