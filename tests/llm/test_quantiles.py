import random

import numpy as np
import pytest

from loglattice.llm import quantiles
from loglattice.llm.quantiles import Sketch


def rank_error(values, sketch, q):
    """Distance of the estimate's rank from the wanted one, in units of the number of values above it."""
    v = np.sort(values)
    got = sketch.quantiles([q])[0]
    low, high = np.searchsorted(v, got, "left"), np.searchsorted(v, got, "right")
    want = q * len(v)
    miss = 0 if low <= want <= high else min(abs(low - want), abs(high - want))
    return miss / max(1, len(v) - want)


@pytest.mark.parametrize("shape", ["lognormal", "sorted", "reversed", "ties"])
def test_error_is_relative_to_the_distance_from_the_maximum(shape):
    rng = np.random.default_rng(7)
    values = rng.lognormal(0, 2, 300_000)
    values = {"lognormal": values, "sorted": np.sort(values), "reversed": np.sort(values)[::-1], "ties": np.floor(values)}[shape]
    s = Sketch()
    for part in np.array_split(values, 57):
        s.update(part)
    assert s.n == len(values) and sum(map(len, s.levels)) < 12_000
    for q in (0.01, 0.25, 0.5, 0.9, 0.99, 0.999, 0.9999):
        assert rank_error(values, s, q) < 0.05, (q, rank_error(values, s, q))
    assert s.quantiles([0, 1]) == [values.min(), values.max()]


def test_days_in_any_order_and_grouping():
    rng, shuffled = np.random.default_rng(1), random.Random(5)
    parts = [rng.exponential(1 + i % 5, 5_000 + 97 * i) for i in range(40)]
    whole = np.concatenate(parts)
    for _ in range(4):
        todo = []
        for p in parts:
            s = Sketch()
            s.update(p)
            todo.append(s.pack())
        shuffled.shuffle(todo)
        while len(todo) > 1:
            a, b = Sketch.unpack(todo.pop(shuffled.randrange(len(todo)))), Sketch.unpack(todo.pop(shuffled.randrange(len(todo))))
            a.merge(b)
            todo.append(a.pack())
        s = Sketch.unpack(todo[0])
        assert s.n == len(whole)
        assert max(rank_error(whole, s, q) for q in (0.5, 0.9, 0.99, 0.999, 0.9999)) < 0.05


def test_small_sketches_are_exact_and_empty_ones_have_no_quantiles():
    s = Sketch()
    s.update(np.array([3.0, 1.0, float("nan"), 2.0, 2.0]))
    assert s.n == 4 and s.quantiles([0.0, 0.25, 0.5, 0.75, 0.76, 1.0]) == [1.0, 1.0, 2.0, 2.0, 3.0, 3.0]
    e = Sketch()
    e.merge(Sketch())
    assert e.quantiles([0.5]) == [None] and Sketch.unpack(e.pack()).n == 0
    e.merge(s)
    assert e.quantiles([1.0]) == [3.0]


def test_groups(spark):
    rows = [("a", d, float(v)) for d in (0, 1) for v in range(2000)] + [(None, None, 5.0), ("b", 1, None), ("b", 1, float("nan")), ("b", 1, 7.0)]
    df = spark.createDataFrame(rows, "g string, day long, v double").repartition(5)
    daily = quantiles.daily_sketches(df, "g", "day", "v", held=300)
    out = {(r["grp"], r["day"]): r for r in quantiles.percentiles(daily, {"p50": 0.5}, ("grp", "day")).collect()}
    assert {k: r["n"] for k, r in out.items()} == {("a", 0): 2000, ("a", 1): 2000, ("", -1): 1, ("b", 1): 1}
    both = {r["grp"]: r for r in quantiles.percentiles(quantiles.combined(daily), {"p50": 0.5, "p99": 0.99}).collect()}
    assert both["a"]["n"] == 4000 and abs(both["a"]["p50"] - 1000) < 30 and abs(both["a"]["p99"] - 1980) < 5 and both["b"]["p50"] == 7.0
    assert quantiles.percentiles(quantiles.combined(quantiles.daily_sketches(df.limit(0), "g", "day", "v")), {"p50": 0.5}).count() == 0


def test_the_error_is_a_parameter(spark):
    assert [quantiles.section_size(e) for e in (0.05, 0.1, 0.01)] == [32, 16, 160]
    with pytest.raises(ValueError):
        quantiles.section_size(0)
    rng = np.random.default_rng(3)
    values = rng.lognormal(0, 2, 100_000)
    for error in (0.1, 0.02):
        s = Sketch(quantiles.section_size(error))
        for part in np.array_split(values, 31):
            s.update(part)
        assert max(rank_error(values, s, q) for q in (0.25, 0.5, 0.9, 0.99, 0.999)) < error
    rows = [("a", float(v)) for v in values[:5000]] + [("b", 1.0), ("b", None), ("b", float("nan")), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").selectExpr("coalesce(g, '') g", "v", "1L day").repartition(3)
    at = {"p50": 0.5, "p99": 0.99}
    estimates = quantiles.percentiles(quantiles.combined(quantiles.daily_sketches(df, "g", "day", "v")), at)
    assert {r["g"]: (r["n"], r["within"]) for r in quantiles.within_bound(df, estimates, "g", "v", at, 0.05).collect()} == {"a": (5000, True), "b": (1, True), "": (1, True)}
    wrong = estimates.selectExpr("grp", "n", "p50 * 3 + 1 p50", "p99")
    assert not any(r["within"] for r in quantiles.within_bound(df, wrong, "g", "v", at, 0.05).where("g = 'a'").collect())
