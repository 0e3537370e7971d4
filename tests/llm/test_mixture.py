from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loglattice.llm import mixture

TARGETS = "source_name string, target_share double, max_repeats int"


def test_plan():
    p = mixture.plan({"a": 100, "b": 10, "c": 50}, {"a": (0.5, 1), "b": (0.3, 4), "none": (0.2, 3), "c": (0.0, 9)})
    assert abs(p.wanted["a"] / p.wanted["b"] - 0.5 / 0.3) < 1e-9 and set(p.wanted) == {"a", "b"}
    assert p.copies["b"] == 4.0 and p.copies["a"] <= 1
    p = mixture.plan({"a": 100, "b": 10}, {"a": (0.5, 2), "b": (0.5, 3)}, total=120)
    assert p.wanted == {"b": 30.0, "a": 90.0}
    assert mixture.plan({}, {"a": (1.0, 1)}).wanted == {}


def test_pivot_keeps_size_and_expectation():
    ids, sizes, shares = np.arange(101), np.array([1 + (7 * i) % 13 for i in range(101)]), np.full(101, 0.37)
    hits = np.zeros(101)
    for seed in range(400):
        out, rest = mixture.pivot(ids, sizes, shares, seed)
        got = np.where(out < 0, rest, out)
        assert abs((got * sizes).sum() - 0.37 * sizes.sum()) < 1e-6 and (out < 0).sum() <= 1 and set(out.tolist()) <= {-1, 0, 1}
        hits += got
    assert ((hits / 400 > 0.25) & (hits / 400 < 0.49)).all()
    assert [x.tolist() for x in mixture.pivot([], [], [])[:1]] == [[]]
    out, rest = mixture.pivot([1, 2, -5], [5, 5, 9], [0.0, 1.0, 0.25])
    assert out.tolist() == [0, 1, -1] and rest == 0.25


@given(st.lists(st.tuples(st.integers(-(2**62), 2**62), st.integers(1, 10**9), st.floats(0, 1)), max_size=60), st.integers(0, 99))
@settings(max_examples=200, deadline=None)
def test_pivot_of_any_shares(rows, seed):
    ids, sizes, shares = (np.array([r[k] for r in rows], t) for k, t in ((0, np.int64), (1, np.int64), (2, np.float64)))
    out, rest = mixture.pivot(ids, sizes, shares, seed)
    assert (out < 0).sum() <= 1 and 0 <= rest <= 1
    got = np.where(out < 0, rest, out).astype(float)
    assert abs((got * sizes).sum() - (shares * sizes).sum()) <= 1e-6 * max(1, sizes.sum())


def rows(spark):
    docs = [(i, "big" if i % 3 else "mid", 10 + i % 50) for i in range(6000)] + [(10_000 + i, "small", 30) for i in range(100)]
    docs += [(20_000, None, 5), (20_001, "other", 5), (20_002, "big", 0), (20_003, "big", None), (20_004, "", 7)]
    return spark.createDataFrame(docs, "doc_id long, source string, size long").repartition(7)


def test_shares_and_repeats(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.4, 3), ("small", 0.08, 4), ("absent", 0.02, 2), ("absent", None, 2), (None, 0.5, 1)], TARGETS)
    copies, plan = mixture.mixed(rows(spark), targets.where("target_share is not null and source_name is not null"))
    got, size = defaultdict(list), defaultdict(int)
    for r in copies.collect():
        got[r["source"]].append(r["copies"])
        size[r["source"]] += r["copies"] * r["size"]
    assert {s: len(v) for s, v in got.items()} == {"big": 4000, "mid": 2000, "small": 100}
    for s, v in got.items():
        assert max(v) <= {"big": 1, "mid": 3, "small": 4}[s] and max(v) - min(v) <= 1
        assert abs(size[s] - plan.wanted[s]) <= 60
    report = {r["source_name"]: r for r in mixture.shares(copies, targets.where("target_share is not null and source_name is not null")).collect()}
    for s, share in (("big", 0.5), ("mid", 0.4), ("small", 0.08)):
        assert abs(report[s]["share"] - share / 0.98) < 0.001
    assert report["absent"]["tokens"] == 0 and report["absent"]["share"] == 0.0
    assert sorted(map(tuple, copies.collect())) == sorted(map(tuple, copies.collect()))


def test_no_rows(spark):
    targets = spark.createDataFrame([("big", 1.0, 1)], TARGETS)
    copies, plan = mixture.mixed(rows(spark).limit(0), targets)
    assert copies.count() == 0 and plan.wanted == {}
    assert mixture.shares(copies, targets).first()["share"] == 0.0
