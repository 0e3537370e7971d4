"""Exactly one copy of messages that were delivered at least once.

Identifiers are encoded exactly: a dictionary gives each a shard and a dense code within it. What has been seen is a
set of bits by (shard, bucket). Of the arrivals of an unseen bit the one with the smallest event_id is kept, and the new
bits are united with the old ones in the same commit that stores the dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglattice.operators.increments import VersionedTable
from loglattice.session import discard, materialise, materialised, work_path

_AUDIT = r"\A\s*type=([A-Z_]+)\s+msg=audit\((\d+(?:\.\d+)?):(\d+)\)"


def audit_stamp(line: Column, file: Column) -> Column:
    """file, time, serial, record type and item number of an audit line as one text; null without a stamp."""
    part = lambda k: F.regexp_extract(line, _AUDIT, k)
    time = F.regexp_replace(F.regexp_replace(part(2), r"(\.\d*?)0+\z", "$1"), r"\.\z", "")
    item = F.regexp_extract(line, r"\sitem=(\d+)", 1)
    return F.when(file.isNotNull() & F.contains(line, F.lit("msg=audit(")) & line.rlike(_AUDIT), F.concat_ws("\u0001", file, time, part(3), part(1), item))


def _roots(edges: DataFrame) -> DataFrame:
    """(k_a, k_b, stamp, root) for edges between positions and stamps: root is the smallest position connected.

    Labels spread alternately over stamps and positions until none changes; each round is written to the shared folder,
    and the round before deleted. A chain of n positions, each tied to the next by a row without position, takes some
    log2(n) rounds at best and n at worst; the rows are only those of stamps that have a row without position.
    """
    by = lambda *keys: Window.partitionBy(*keys)
    pos = F.struct("k_a", "k_b")
    spark = edges.sparkSession
    state, path = materialised(edges.select("k_a", "k_b", "stamp", F.min(pos).over(by("stamp")).alias("root")), "roots")
    while True:
        wider = state.withColumn("wide", F.min("root").over(by("k_a", "k_b"))).withColumn("wide", F.min("wide").over(by("stamp")))
        after, place = materialised(wider, "roots")
        done = after.where(F.col("wide") != F.col("root")).isEmpty()
        discard(spark, path)
        state, path = after.select("k_a", "k_b", "stamp", F.col("wide").alias("root")), place
        if done:
            return state


def places(events: DataFrame) -> DataFrame:
    """(event_id, stamp, k_a, k_b), written: the audit stamp, and the position if the row has both parts of it."""
    base = events.select("event_id", "file_id", "byte_pos", audit_stamp(F.col("line"), F.col("file")).alias("stamp"))
    placed = F.col("file_id").isNotNull() & F.col("byte_pos").isNotNull()
    return materialise(base.select("event_id", "stamp", F.when(placed, F.col("file_id")).alias("k_a"), F.when(placed, F.col("byte_pos")).alias("k_b")), "places")


def stamp_links(base: DataFrame) -> DataFrame:
    """The different (stamp, k_a, k_b) of ``places`` with a stamp; the position is null for rows without one."""
    return base.where(F.col("stamp").isNotNull()).select("stamp", "k_a", "k_b").distinct()


def message_keys(base: DataFrame, links: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """(event_id, k_a, k_b) of ``places``: rows with an equal key are copies of one message.

    Rows with file_id and byte_pos are known by these. Where either row of a pair lacks them, both are copies if file,
    audit stamp, type and item are equal. A row with neither is a message of its own. Texts and paths need not agree.

    ``links``: the stamp links of these rows and of all earlier ones, by default of these alone. ``words``: the
    (k_a, k_b, first_id) of the messages known before; a message that is one of them under any of its names keeps that
    key. Only positions whose key is another than themselves are joined to the rows: those that a row without position
    ties to a smaller one.
    """
    links = materialise(stamp_links(base), "links") if links is None else links
    lacking = materialise(links.where(F.col("k_b").isNull()).select("stamp").distinct(), "lacking")
    roots = _roots(links.where(F.col("k_b").isNotNull()).join(lacking, "stamp", "left_semi").distinct())
    if words is not None:
        names = roots.select("k_a", "k_b", "root").unionByName(roots.select(F.col("stamp").alias("k_a"), F.lit(-1).cast("long").alias("k_b"), "root")).distinct()
        known = materialise(words.join(names, ["k_a", "k_b"]).groupBy("root").agg(F.min_by(F.struct("k_a", "k_b"), "first_id").alias("known")), "known")
        roots = roots.join(known, "root", "left").select("k_a", "k_b", "stamp", F.coalesce("known", "root").alias("root"))
    at_pos = roots.groupBy(F.col("k_a").alias("r_a"), F.col("k_b").alias("r_b")).agg(F.min("root").alias("root"))
    at_pos = materialise(at_pos.where(F.col("root") != F.struct(F.col("r_a").alias("k_a"), F.col("r_b").alias("k_b"))), "at_pos")
    at_stamp = materialise(roots.groupBy(F.col("stamp").alias("r_stamp")).agg(F.min("root").alias("root")), "at_stamp")
    there = base.where(F.col("k_b").isNotNull()).join(at_pos, (F.col("k_a") == F.col("r_a")) & (F.col("k_b") == F.col("r_b")), "left")
    there = there.select("event_id", F.coalesce("root.k_a", "k_a").alias("k_a"), F.coalesce("root.k_b", "k_b").alias("k_b"))
    lone = base.where(F.col("k_b").isNull() & F.col("stamp").isNotNull()).join(at_stamp, F.col("stamp") == F.col("r_stamp"), "left")
    lone = lone.select("event_id", F.coalesce("root.k_a", "stamp").alias("k_a"), F.coalesce("root.k_b", F.lit(-1)).alias("k_b"))
    alone = base.where(F.col("k_b").isNull() & F.col("stamp").isNull()).select("event_id", F.lit("").alias("k_a"), (-F.col("event_id") - 1).alias("k_b"))
    return there.unionByName(lone).unionByName(alone)


def bit_at(bitmap: Column, position: Column) -> Column:
    """Whether a bit of a bitmap of bitmap_construct_agg is set."""
    byte = F.conv(F.hex(F.substring(bitmap, F.call_function("div", position, F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


class SeenMessages:
    """What has been delivered so far: a dictionary of identifiers, bitmaps of those seen, and links of audit stamps to
    positions, in one versioned table.

    A delivery adds to all in one commit. Deliveries are known by name; names may come in any order. Identifiers that are
    new get codes where they were brought together: each partition of a delivery is a shard, and counts from 0.
    """

    DICTIONARY = "k_a string, k_b long, shard long, code long, first_id long, n long"
    BITS = "shard long, bucket long, bits binary"
    LINKS = "stamp string, k_a string, k_b long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, VersionedTable(spark, path)

    def dictionary(self, version: int | None = None) -> DataFrame:
        return self.table.read_folders(self.table.manifest(version)["folders"], self.DICTIONARY)

    def seen(self, version: int | None = None) -> DataFrame:
        """The bitmaps as of a version, by default the last."""
        return self.table.read_folders(self.table.manifest(version)["state"].get("bits", []), self.BITS)

    def before(self, delivery: str) -> tuple[int, bool]:
        """The version that a delivery builds on, and whether the delivery was committed already."""
        m = self.table.manifest()
        done = delivery in m["committed"]
        return (m["committed"].index(delivery) - 1 if done else m["version"]), done

    def deliver(self, keys: DataFrame, delivery: str) -> DataFrame:
        """Takes (event_id, k_a, k_b) and gives (event_id, keep_id, new): of the rows that are new, event_id = keep_id for the one copy that is kept.

        Equal keys meet after a partial aggregation, and one that makes up much of the rows is split by the adaptive
        skew join. A delivery that was committed before changes nothing, and gives the same result again; if it now has
        identifiers that it had not then, it is refused with an error.
        """
        return self._result(keys, self._taken(keys, delivery, *self.before(delivery), []))

    def repeated(self, keys: DataFrame, delivery: str) -> DataFrame:
        """As ``deliver``, but without rows that are new and the only one of their message."""
        return self._result(keys, self._taken(keys, delivery, *self.before(delivery), []).where((F.col("n") > 1) | ~F.col("new")))

    def deliver_events(self, events: DataFrame, delivery: str) -> DataFrame:
        """As ``deliver``, for rows of line_events: keys are made from these and from what was delivered before.

        A row without position is a copy of a positioned one of an earlier delivery with its stamp, and the reverse. Two
        positions that were both kept before a row without position joined them are not taken back.
        """
        base, done = self.before(delivery)
        links = self.table.manifest(base + 1 if done else base)["state"].get("links", [])
        rows = places(events)
        new = [] if done else [self.table.stage(stamp_links(rows), "links")]
        words = self.dictionary(base) if base >= 0 else None
        keys = materialise(message_keys(rows, self.table.read_folders([*links, *new], self.LINKS), words), "keys")
        return self._result(keys, self._taken(keys, delivery, base, done, new))

    @staticmethod
    def _result(keys: DataFrame, taken: DataFrame) -> DataFrame:
        return keys.join(taken, ["k_a", "k_b"]).select("event_id", F.col("first_id").alias("keep_id"), "new")

    def _taken(self, keys: DataFrame, delivery: str, base: int, done: bool, links: list[str]) -> DataFrame:
        """(k_a, k_b, first_id, n, new) of all identifiers known after the delivery; new: their bit was not set before it."""
        if done:
            words = self.dictionary(base + 1)
            if not keys.join(words.select("k_a", "k_b"), ["k_a", "k_b"], "left_anti").isEmpty():
                raise ValueError(f"delivery {delivery} was committed before, with other messages")
        else:
            self._add(keys, delivery, base, links)
            words = self.dictionary(base + 1)
        code = F.col("code")
        old = self.seen(base).withColumnsRenamed({"shard": "o_shard", "bucket": "o_bucket"})
        at = words.withColumns({"bucket": F.bitmap_bucket_number(code), "bit": F.bitmap_bit_position(code)})
        at = at.join(old, (F.col("shard") == F.col("o_shard")) & (F.col("bucket") == F.col("o_bucket")), "left")
        return at.select("k_a", "k_b", "first_id", "n", (~F.coalesce(bit_at(F.col("bits"), F.col("bit")), F.lit(False))).alias("new"))

    def _add(self, keys: DataFrame, delivery: str, base: int, links: list[str]) -> None:
        """Commits the identifiers of ``keys`` that version ``base`` has not, their bits, and staged links."""
        firsts = keys.groupBy("k_a", "k_b").agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        if base >= 0:
            firsts = firsts.join(self.dictionary(base).select("k_a", "k_b"), ["k_a", "k_b"], "left_anti")
        # what a task counts is fixed by the file it writes: the dictionary is only read from there
        new = firsts.withColumn("id", F.monotonically_increasing_id())
        shard = F.shiftright("id", 33) + F.lit((base + 1) << 31)
        folder = self.table.stage(new.select("k_a", "k_b", shard.alias("shard"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("code"), "first_id", "n"))
        code = F.col("code")
        added = self.table.read_folders([folder], self.DICTIONARY).groupBy("shard", F.bitmap_bucket_number(code).alias("bucket"))
        bits = added.agg(F.bitmap_construct_agg(F.bitmap_bit_position(code)).alias("bits"))
        # the shards of a delivery are its own, so its bitmaps are united with the older ones by standing beside them
        old = self.table.manifest(base)["state"]
        state = {"bits": [*old.get("bits", []), self.table.stage(bits, "bits")], "links": [*old.get("links", []), *links]}
        self.table.commit(folder, delivery, state=state, after=base)


def dropped_copies(events: DataFrame) -> DataFrame:
    """(keep_id, drop_id) of every copy beyond the first of its message, from one delivery to an empty store."""
    spark = events.sparkSession
    keys = materialise(message_keys(places(events)), "keys")
    arrivals = SeenMessages(spark, work_path(spark, "seen")).repeated(keys, "0")
    return arrivals.where(~F.col("new") | (F.col("event_id") != F.col("keep_id"))).select("keep_id", F.col("event_id").alias("drop_id"))
