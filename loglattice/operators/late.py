"""Counts and sums by event-time period that late records correct up to a cut-off.

State is one counter for each (period, source, batch): a version and the totals known at that version. Counters merge by
the larger version of each contributor, periods sum over contributors. The merge is commutative, associative and
idempotent, so batches may arrive repeated, reordered or on several machines. What one state takes of a batch has to
include what an earlier one took; where machines share a batch, the contributor has to be finer (``part`` of counters).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.operators.increments import VersionedTable
from loglattice.operators.instants import UNFIXABLE, with_arrival_instant, with_host_zone, with_instant
from loglattice.session import fresh, pinned

HOUR_US = 3_600_000_000


def period_of(us: Column, period_us: int = HOUR_US) -> Column:
    """The number of the period, counted from 1970; right before 1970 too."""
    return F.floor((us - F.pmod(us, F.lit(period_us))) / period_us).cast("long")


def verdict(event_us: Column, arrival_us: Column, period_us: int = HOUR_US, cutoff_us: int = 6 * HOUR_US) -> Column:
    """base (arrived within its period), amend (later, within the cut-off) or cut; null if a time is null or not fixed."""
    late = arrival_us - (event_us - F.pmod(event_us, F.lit(period_us)) + period_us)
    fixed = (event_us != UNFIXABLE) & (arrival_us != UNFIXABLE)
    return F.when(fixed & late.isNotNull(), F.when(late < 0, "base").when(late < cutoff_us, "amend").otherwise("cut"))


def timed_access(access: DataFrame, events: DataFrame, hosts: DataFrame) -> DataFrame:
    """access rows (each copy on its own) with event_us, arrival_us, hour_no and verdict, from one join on event_id."""
    lines = events.select(F.col("event_id").alias("e_id"), "ts", "host_name", "file", "batch_no")
    rows = access.select("event_id", "access_ts", "bytes", "duration").join(lines, F.col("event_id") == F.col("e_id")).drop("e_id")
    rows = with_host_zone(rows, hosts, "host_name", "zone", "mode")
    rows = with_arrival_instant(with_instant(rows, "access_ts", "zone", "event_us"), "ts", "zone", "mode", "arrival_us")
    rows = pinned(rows, "verdict", verdict(F.col("event_us"), F.col("arrival_us")))
    return rows.withColumn("hour_no", F.when(F.col("verdict").isNotNull(), period_of(F.col("event_us"))))


def counters(rows: DataFrame, source: str = "file", part: str = "batch_no") -> DataFrame:
    """Counters of accepted rows by (hour_no, source, part); version: the latest event_id that contributed.

    ``part`` is the contributor besides the source: rows of different parts never replace each other in a merge. Partial sums are made before the shuffle, so one source or hour with most of the rows is no hot spot. A null
    source counts as the source ''. Sums are of whole microseconds, so their order does not matter; a duration that is no
    number or too large for them adds nothing.
    """
    ok = rows.where(F.col("verdict").isin("base", "amend"))
    return ok.groupBy("hour_no", F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(part).alias("part")).agg(
        F.max("event_id").alias("version"), F.count(F.lit(1)).alias("n"), F.sum((F.col("verdict") == "amend").cast("long")).alias("n_amended"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.round(F.col("duration") * 1e6).try_cast("long")), F.lit(0)).alias("duration_us"),
    )


FIELDS = ("n", "n_amended", "bytes", "duration_us")


def merge(*states: DataFrame) -> DataFrame:
    """The join of counter states: for each contributor (hour_no, source and, if there, part) the totals of the largest version.

    Of equal versions the larger totals count, so that the result does not depend on the order.
    """
    union = states[0]
    for s in states[1:]:
        union = union.unionByName(s)
    best = F.max(F.struct("version", *FIELDS)).alias("m")
    keys = [c for c in union.columns if c not in ("version", *FIELDS)]
    return union.groupBy(*keys).agg(best).select(*keys, "m.*")


def with_batch(state: DataFrame, rows: DataFrame) -> DataFrame:
    """``state`` corrected by the rows of one or more batches, however late; batches that it knows change nothing."""
    return merge(state, counters(rows))


def totals(state: DataFrame) -> DataFrame:
    """Corrected totals by hour: the sum over contributors; n_sources: how many different sources these have."""
    by_source = state.groupBy("hour_no", "source").agg(*(F.sum(f).alias(f) for f in FIELDS))
    return by_source.groupBy("hour_no").agg(*(F.sum(f).alias(f) for f in FIELDS), F.count(F.lit(1)).alias("n_sources"))


class CounterStore:
    """The counters of all deliveries so far, in a versioned table: late batches correct the totals, each exactly once.

    A delivery commits its counters under its name, as contributors of their own: it may hold any part of any batch, and
    deliveries may come in any order. One that is repeated changes nothing.
    """

    STATE = "hour_no long, source string, part string, version long, n long, n_amended long, bytes long, duration_us long"

    def __init__(self, spark: SparkSession, path: str, most: int = 32):
        """After ``most`` deliveries their counters are written as one, summed up by hour and source."""
        self.table, self.most = VersionedTable(spark, path), most

    def add(self, rows: DataFrame, delivery: str, source: str = "file") -> bool:
        """Takes rows as of ``timed_access``; False if the delivery was committed before."""
        if delivery in self.table.manifest()["committed"]:
            return False
        part = fresh(rows.columns, "delivery")[0]
        state = counters(rows.withColumn(part, F.lit(delivery)), source, part)
        done = self.table.commit(state.select(*(c.split()[0] for c in self.STATE.split(", "))), delivery)
        m = self.table.manifest()
        if done and len(m["folders"]) > self.most:
            name = f"compact {m['version']}"
            whole = self.state().groupBy("hour_no", "source").agg(F.max("version").alias("version"), *(F.sum(f).alias(f) for f in FIELDS)).withColumn("part", F.lit(name))
            self.table.commit(whole.select(*(c.split()[0] for c in self.STATE.split(", "))), name, after=m["version"], replaces=m["folders"])
        return done

    def state(self) -> DataFrame:
        return merge(self.table.read_folders(self.table.manifest()["folders"], self.STATE))

    def totals(self) -> DataFrame:
        return totals(self.state())


def late_cases(access: DataFrame, events: DataFrame, hosts: DataFrame) -> DataFrame:
    """(event_id, hour_no, verdict) of the rows that arrived at or after the end of their hour."""
    return timed_access(access, events, hosts).where(F.col("verdict").isin("amend", "cut")).select("event_id", "hour_no", "verdict")
