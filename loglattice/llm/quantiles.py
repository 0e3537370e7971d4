"""Percentiles with a multiplicative rank error at the upper end, from sketches that can be put together.

A sketch is a stack of relative compactors. One of level h holds values of weight 2**h. When it is full, its largest
values are protected and the others compacted: sorted, and every second one promoted. The lower the rank from above, the
longer a value stays in its level, so the error of a rank shrinks in proportion with its distance from the maximum. Two
sketches merge level by level; days, partitions and machines may be combined in any order.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.session import ship


def section_size(error: float) -> int:
    """The section size ``k`` for a rank error of at most this part of the number of values above, an even number.

    0.05 gives 32. The error of a quantile shrinks in proportion with k; the size of a sketch grows with it.
    """
    if not 0 < error < 1:
        raise ValueError("the error must lie between 0 and 1")
    return 2 * max(2, int(np.ceil(0.8 / error - 1e-9)))


class Sketch:
    """Relative-rank compactors for float values. ``k`` is the size of a section, an even number.

    Values that are NaN are left out. An empty sketch has no quantiles.
    """

    def __init__(self, k: int = 32):
        self.k, self.n = k, 0
        self.low, self.high = float("inf"), float("-inf")
        self.levels: list[np.ndarray] = [np.zeros(0)]
        self.rounds: list[int] = [0]

    def _capacity(self, level: int) -> int:
        """Sections double in number as a level's compactions grow by the square, so early values lose no protection."""
        sections = 3
        while self.rounds[level] >= 1 << (sections - 1):
            sections *= 2
        return 2 * self.k * sections

    def update(self, values: np.ndarray) -> None:
        values = np.asarray(values, np.float64)
        values = values[~np.isnan(values)]
        if not len(values):
            return
        self.n += len(values)
        self.low, self.high = min(self.low, float(values.min())), max(self.high, float(values.max()))
        self.levels[0] = np.concatenate((self.levels[0], values))
        self._compress()

    def merge(self, other: Sketch) -> None:
        """Adds what the other has seen; levels of equal weight are joined, then compacted where they are full."""
        if not other.n:
            return
        self.n += other.n
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        for h, values in enumerate(other.levels):
            if h == len(self.levels):
                self.levels.append(np.zeros(0))
                self.rounds.append(0)
            self.levels[h] = np.concatenate((self.levels[h], values))
            self.rounds[h] |= other.rounds[h]
        self._compress()

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            capacity = self._capacity(h)
            if len(self.levels[h]) >= capacity:
                if h + 1 == len(self.levels):
                    self.levels.append(np.zeros(0))
                    self.rounds.append(0)
                values = np.sort(self.levels[h])
                # the upper half of the capacity is never compacted; of the lower half as many sections as the round's trailing ones say
                sections = capacity // (2 * self.k)
                ones = 1
                while self.rounds[h] >> (ones - 1) & 1 and ones < sections:
                    ones += 1
                keep = capacity // 2 + (sections - ones) * self.k
                cut = max(0, len(values) - keep) & ~1
                if cut:
                    odd = (self.rounds[h] ^ (self.n >> 3) ^ h) & 1
                    self.levels[h + 1] = np.concatenate((self.levels[h + 1], values[:cut][odd::2]))
                    values = values[cut:]
                self.levels[h] = values
                self.rounds[h] += 1
            h += 1

    def quantiles(self, at: list[float]) -> list[float | None]:
        """The smallest value whose estimated share of values up to it is at least q; minimum and maximum are exact."""
        if not self.n:
            return [None] * len(at)
        values = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(v), 1 << h, np.int64) for h, v in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        values, below = values[order], np.cumsum(weights[order])
        out = []
        for q in at:
            if q <= 0 or q >= 1:
                out.append(self.low if q <= 0 else self.high)
            else:
                out.append(float(values[min(np.searchsorted(below, np.ceil(q * below[-1]), "left"), len(values) - 1)]))
        return out

    def pack(self) -> bytes:
        head = struct.pack("<iqddi", self.k, self.n, self.low, self.high, len(self.levels))
        return head + b"".join(struct.pack("<iq", len(v), r) + v.astype("<f8").tobytes() for v, r in zip(self.levels, self.rounds))

    @classmethod
    def unpack(cls, data: bytes) -> Sketch:
        k, n, low, high, count = struct.unpack_from("<iqddi", data)
        out, at = cls(k), struct.calcsize("<iqddi")
        out.n, out.low, out.high, out.levels, out.rounds = n, low, high, [], []
        for _ in range(count):
            size, rounds = struct.unpack_from("<iq", data, at)
            at += struct.calcsize("<iq")
            out.levels.append(np.frombuffer(data, "<f8", size, at))
            out.rounds.append(rounds)
            at += 8 * size
        return out


_PARTIAL = "grp string, day long, salt int, sketch binary"


_KINDS = {"grp": pa.string(), "day": pa.int64(), "salt": pa.int32(), "sketch": pa.binary()}


def _partials(k: int, held: int):
    """Sketches of the values of a task, by group and day; made whenever ``held`` values have come together."""

    def sketched(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        grp = table["grp"].combine_chunks().dictionary_encode()
        if isinstance(grp, pa.ChunkedArray):
            grp = grp.combine_chunks()
        days, values = table["day"].to_numpy(), table["value"].to_numpy()
        codes, names = grp.indices.to_numpy(zero_copy_only=False), grp.dictionary.to_pylist()
        order = np.lexsort((days, codes))
        codes, days, values = codes[order], days[order], values[order]
        cuts = np.concatenate(([0], np.flatnonzero((np.diff(codes) != 0) | (np.diff(days) != 0)) + 1))
        packed = []
        for part in np.split(values, cuts[1:]):
            s = Sketch(k)
            s.update(part)
            packed.append(s.pack())
        rows = {"grp": [names[c] for c in codes[cuts]], "day": days[cuts], "salt": [table["part"][0].as_py()] * len(cuts), "sketch": packed}
        return pa.RecordBatch.from_pydict(rows, pa.schema(list(_KINDS.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                size += batch.num_rows
            if size >= held:
                yield sketched(waiting)
                waiting, size = [], 0
        if waiting:
            yield sketched(waiting)

    return run


def _merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One sketch for each combination of keys: rows meet sorted, and only one merged sketch is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, alone, whole = None, b"", None
        out: list[tuple] = []

        def rows() -> pa.RecordBatch:
            cols = {c: [r[i] for r in out] for i, c in enumerate([*keys, "sketch"])}
            return pa.RecordBatch.from_pydict(cols, pa.schema([(c, _KINDS[c]) for c in cols]))

        for batch in batches:
            for *key, data in zip(*(batch[c].to_pylist() for c in keys), batch["sketch"].to_pylist()):
                if key != now:
                    if now is not None:
                        out.append((*now, whole.pack() if whole else alone))
                    now, alone, whole = key, data, None
                else:
                    whole = whole or Sketch.unpack(alone)
                    whole.merge(Sketch.unpack(data))
            if len(out) >= 1000:
                yield rows()
                out.clear()
        if now is not None:
            out.append((*now, whole.pack() if whole else alone))
        yield rows()

    schema = ", ".join(f"{c} {t}" for c, t in (("grp", "string"), ("day", "long"), ("salt", "int")) if c in keys) + ", sketch binary"
    return sketches.select(*keys, "sketch").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def daily_sketches(rows: DataFrame, group: str, day: str, value: str, k: int = 32, held: int = 4_000_000) -> DataFrame:
    """(grp, day, sketch): one sketch for each group and day.

    Values meet sketches where they are read, so a group with most of the rows sends as little as any other; sketches
    are then merged in two steps, the first salted, so that no task gets more than a share of one group's. Null values
    and NaN count for nothing; a null group is the group '', a null day is day -1. ``held`` bounds the values that a
    task keeps in memory. No rows give no sketches.
    """
    ship(rows.sparkSession)
    part = rows.select(
        F.coalesce(F.col(group).cast("string"), F.lit("")).alias("grp"), F.coalesce(F.col(day).cast("long"), F.lit(-1)).alias("day"),
        F.pmod(F.spark_partition_id(), F.lit(64)).cast("int").alias("part"), F.col(value).cast("double").alias("value"),
    ).where(F.col("value").isNotNull() & ~F.isnan("value"))
    partial = part.mapInArrow(_partials(k, held), _PARTIAL)
    return _merged(_merged(partial, ["grp", "day", "salt"]), ["grp", "day"])


def combined(daily: DataFrame) -> DataFrame:
    """(grp, sketch): the days of each group put together."""
    ship(daily.sparkSession)
    salted = daily.withColumn("salt", F.pmod("day", F.lit(32)).cast("int"))
    return _merged(_merged(salted, ["grp", "salt"]), ["grp"])


def within_bound(values: DataFrame, estimates: DataFrame, group: str, value: str, at: dict[str, float], error: float) -> DataFrame:
    """(group, n, within): whether all estimates of a group hold the error bound against the exact ranks of its values.

    ``estimates`` has a row for each group, by ``percentiles``. Ranks are counts of values below and up to an estimate,
    so a group with most of the rows is summed up where it is read. Null values and NaN count for nothing.
    """
    some = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(group).alias("__g"), F.col(value).cast("double").alias("__v"))
    both = some.join(estimates.select(F.col("grp").alias("__grp"), *at), F.col("__g") == F.col("__grp"))
    ranks = [f(F.when(test, 1).otherwise(0)).alias(f"{x}_{name}") for x in at for name, f, test in (("low", F.sum, F.col("__v") < F.col(x)), ("high", F.sum, F.col("__v") <= F.col(x)))]
    sums = both.groupBy("__g").agg(F.count(F.lit(1)).alias("n"), *ranks)
    ok = F.lit(True)
    for x, q in at.items():
        want, low, high = F.ceil(q * F.col("n")), F.col(f"{x}_low"), F.col(f"{x}_high")
        miss = F.when((low < want) & (want <= high), 0).otherwise(F.least(F.abs(low + 1 - want), F.abs(high - want)))
        ok = ok & (miss <= error * F.greatest(F.col("n") - want, F.lit(0)) + 1)
    return sums.select(F.col("__g").alias(group), "n", ok.alias("within"))


def percentiles(sketches: DataFrame, at: dict[str, float], keep: tuple[str, ...] = ("grp",)) -> DataFrame:
    """The columns ``keep``, n (values seen), and one column for each named quantile."""
    ship(sketches.sparkSession)
    names, qs = list(at), list(at.values())
    kinds = {f.name: f.dataType.simpleString() for f in sketches.schema.fields}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            all_of = [Sketch.unpack(d) for d in pdf["sketch"]]
            out = pdf[list(keep)].copy()
            out["n"] = [s.n for s in all_of]
            for i, name in enumerate(names):
                out[name] = [s.quantiles(qs)[i] for s in all_of]
            yield out

    schema = ", ".join([f"{c} {kinds[c]}" for c in keep] + ["n long"] + [f"{x} double" for x in names])
    return sketches.select(*keep, "sketch").mapInPandas(run, schema)
