"""Mixing sources to target shares of the total size, with a cap on repeats.

Every document of a source should come out in the same, mostly fractional, number of copies. Whole copies are certain;
the fractions are rounded by pairs: mass moves at random from one document to the other, weighted by their sizes, until
one of the two is whole, in rounds over arrays. This keeps each document's expectation and the source's total size, but for one last document.
Partitions round their own documents and pass one residual for each source up a reduction tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.session import materialise, ship


@dataclass(frozen=True)
class Plan:
    """For each source: its size, the part of the mixture it is to give, and the copies of each of its documents."""

    sizes: dict[str, int]
    wanted: dict[str, float]
    copies: dict[str, float]


def plan(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> Plan:
    """How much of each source to take. ``targets``: (share, most repeats) by source.

    Without ``total`` the mixture is as large as it can be with every share exact. With it, sources that cannot fill
    their share give all they may, and the others share what is missing in proportion. Sources without documents or
    with no positive share give nothing; the shares of the others keep their proportions.
    """
    can = {s: sizes.get(s, 0) * max(0, m) for s, (share, m) in targets.items() if share and share > 0}
    can = {s: c for s, c in can.items() if c > 0}
    weight = {s: targets[s][0] for s in can}
    wanted: dict[str, float] = {}
    if can and total is None:
        unit = min(can[s] / weight[s] for s in can)
        wanted = {s: weight[s] * unit for s in can}
    elif can:
        left, open_ = float(total), dict(weight)
        while open_:
            unit = left / sum(open_.values())
            full = [s for s in open_ if can[s] <= open_[s] * unit]
            if not full:
                wanted |= {s: w * unit for s, w in open_.items()}
                break
            for s in full:
                wanted[s] = float(can[s])
                left -= can[s]
                del open_[s]
    copies = {s: min(float(targets[s][1]), wanted[s] / sizes[s]) for s in wanted}
    return Plan({s: sizes.get(s, 0) for s in targets}, wanted, copies)


def _coins(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) from pairs of ids: the same in every attempt of a task."""
    u = np.uint64
    x = a.astype(np.int64).view(u) * u(0x9E3779B97F4A7C15) ^ (b.astype(np.int64).view(u) * u(0xC2B2AE3D27D4EB4F) + u(seed))
    x = (x ^ (x >> u(31))) * u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> u(27))) * u(0x94D049BB133111EB)
    return ((x ^ (x >> u(31))) >> u(11)).astype(np.float64) / (1 << 53)


def pivot(ids: np.ndarray, sizes: np.ndarray, shares: np.ndarray, seed: int = 0) -> tuple[np.ndarray, float]:
    """(rounded, share): 0 or 1 for each position, and -1 for the one at most that is left with a fractional share.

    Rounds of a tournament: the positions still open are paired, each pair moves mass until one of the two is whole, and
    the other goes on to the next round. The sum of size times share stays the same, and so does the expectation of
    each share.
    """
    sizes, p = np.asarray(sizes, np.float64), np.array(shares, np.float64)
    ids, out = np.asarray(ids), np.full(len(p), -1, np.int8)
    out[p <= 1e-12], out[p >= 1 - 1e-12] = 0, 1
    at = np.flatnonzero(out < 0)
    while len(at) > 1:
        m = len(at) // 2 * 2
        i, j, odd = at[0:m:2], at[1:m:2], at[m:]
        a, b = sizes[i], sizes[j]
        fill_i, empty_j, empty_i, fill_j = (1 - p[i]) * a, p[j] * b, p[i] * a, (1 - p[j]) * b
        up, down = np.minimum(fill_i, empty_j), np.minimum(empty_i, fill_j)
        rise = _coins(ids[i], ids[j], seed) * (up + down) < down
        move = np.where(rise, up, -down)
        i_whole = np.where(rise, fill_i <= empty_j, empty_i <= fill_j)
        q_i, q_j = p[i] + move / a, p[j] - move / b
        q_i[i_whole], q_j[~i_whole] = rise[i_whole], ~rise[~i_whole]
        for k, q, whole in ((i, q_i, i_whole), (j, q_j, ~i_whole)):
            done = whole | (q < 1e-9) | (q > 1 - 1e-9)
            out[k[done]] = q[done] > 0.5
            p[k] = q
        at = np.concatenate((at[:m][out[at[:m]] < 0], odd))
    return out, float(p[at[0]]) if len(at) else 0.0


_DECIDED = "doc_id long, source string, size long, whole int, extra int, share double"


_KIND = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("whole", pa.int32()), ("extra", pa.int32()), ("share", pa.float64())])


def _decided(ids, source: str, sizes, whole: int, extra, share) -> pa.RecordBatch:
    n = len(ids)
    columns = [pa.array(ids, pa.int64()), pa.array([source] * n, pa.string()), pa.array(sizes, pa.int64()), pa.array(np.full(n, whole), pa.int32()), pa.array(extra, pa.int32()), pa.array(share, pa.float64())]
    return pa.RecordBatch.from_arrays(columns, schema=_KIND)


def _round_partition(copies: dict[str, float], seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[int, int, float]] = {}
        for batch in batches:
            codes = batch["source"].dictionary_encode()
            which, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
            all_ids, all_sizes = batch["doc_id"].to_numpy(), batch["size"].to_numpy()
            for k in sorted(range(len(names)), key=names.__getitem__):
                source, here = names[k], which == k
                whole = int(copies[source] + 1e-12)
                ids, sizes = all_ids[here], all_sizes[here]
                shares = np.full(len(ids), copies[source] - whole)
                if source in held:
                    i, size, p = held.pop(source)
                    ids, sizes, shares = np.concatenate(([i], ids)), np.concatenate(([size], sizes)), np.concatenate(([p], shares))
                extra, rest = pivot(ids, sizes, shares, seed)
                if len(open_ := np.flatnonzero(extra < 0)):
                    held[source] = (int(ids[open_[0]]), int(sizes[open_[0]]), rest)
                sure = extra >= 0
                if sure.any():
                    yield _decided(ids[sure], source, sizes[sure], whole, extra[sure], [None] * int(sure.sum()))
        for source, (i, size, p) in sorted(held.items()):
            yield _decided([i], source, [size], int(copies[source] + 1e-12), [None], [p])

    return run


def _round_residuals(last: bool, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable").reset_index(drop=True)
        ids = pdf["doc_id"].to_numpy()
        out, rest = pivot(ids, pdf["size"].to_numpy(), pdf["share"].to_numpy(np.float64), seed)
        extra: list[int | None] = [int(x) if x >= 0 else None for x in out]
        share: list[float | None] = [None] * len(pdf)
        for k in np.flatnonzero(out < 0):
            if last:
                extra[k] = int(_coins(ids[k : k + 1], np.ones(1, np.int64), seed)[0] < rest)
            else:
                share[k] = rest
        return pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "size": pdf["size"], "whole": pdf["whole"].astype("int32"), "extra": pd.array(extra, "Int32"), "share": pd.array(share, "Float64")})

    return run


def mixed(sized: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 20) -> tuple[DataFrame, Plan]:
    """((doc_id, source, size, copies), plan): in how many copies each document of a target source comes out.

    ``sized`` has doc_id, source and size; it is written once, so that every task sees the same rows in the same order
    however often it is tried. Null sources, sources without target, null sizes and sizes of 0 stay out. Of targets
    with an equal name the largest (share, repeats) counts. The plan is made from one sum for each target.
    """
    ship(sized.sparkSession)
    goals = {r["source_name"]: (r["m"]["target_share"], r["m"]["max_repeats"]) for r in targets.where(F.col("source_name").isNotNull() & F.col("target_share").isNotNull() & F.col("max_repeats").isNotNull()).groupBy("source_name").agg(F.max(F.struct("target_share", "max_repeats")).alias("m")).collect()}
    rows = sized.where(F.col("source").isin(*goals) & (F.col("size") > 0)).select(F.col("doc_id").cast("long"), "source", F.col("size").cast("long"))
    rows = materialise(rows, "sized")
    sizes = {r["source"]: int(r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    todo = plan(sizes, goals, total)
    rows = rows.where(F.col("source").isin(*todo.copies))
    base = materialise(rows.mapInArrow(_round_partition(todo.copies, seed), _DECIDED), "rounded")
    open_ = base.where(F.col("extra").isNull()).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    upper = materialise(open_.groupBy("source", "salt").applyInPandas(_round_residuals(False, seed), _DECIDED), "upper")
    top = upper.where(F.col("extra").isNull()).groupBy("source").applyInPandas(_round_residuals(True, seed), _DECIDED)
    known = F.col("extra").isNotNull()
    every = base.where(known).unionByName(upper.where(known)).unionByName(top)
    return every.select("doc_id", "source", "size", (F.col("whole") + F.col("extra")).alias("copies")), todo


def shares(copies: DataFrame, targets: DataFrame) -> DataFrame:
    """(source_name, target_share, max_repeats, n_docs, n_copies, tokens, share): what each target got; zeros if nothing."""
    got = copies.where(F.col("copies") > 0).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("copies").alias("n_copies"), F.sum(F.col("copies") * F.col("size")).alias("tokens"))
    both = targets.join(got, targets["source_name"] == got["source"], "left").drop("source")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    both = both.select("source_name", "target_share", "max_repeats", zero("n_docs"), zero("n_copies"), zero("tokens"))
    total = both.agg(F.sum("tokens").alias("all_tokens"))  # one row
    return both.join(F.broadcast(total), F.lit(True)).withColumn("share", F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).otherwise(0.0)).drop("all_tokens")
