"""The whole pipeline: files, records, parser, filter, sink; once or continuously."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from loglattice.functions import audit
from loglattice.operators.filters import allowed, output_text
from loglattice.operators.multiline import grouped
from loglattice.options import Options, ParserOptions
from loglattice.sinks.writers import build
from loglattice.sources import logtail
from loglattice.sources.discovery import listing
from loglattice.sources.offsets import OffsetStore
from loglattice.streaming.grouping import grouped_stream
from loglattice.streaming.metrics import Metrics


def parsed_lines(lines: DataFrame, parser: ParserOptions) -> DataFrame:
    """``line`` as the parser passes it on; only auditd is wired here, other types pass lines through."""
    if parser.type != "auditd":
        return lines
    rows = audit.parsed(lines, "line", "__record")
    text = output_text(F.col("line"), audit.to_json(F.col("__record")), F.col("__record").isNotNull(), parser.format, parser.drop_non_matching)
    return rows.withColumn("line", text).drop("__record").where(F.col("line").isNotNull())


class Collector:
    """``once`` reads what there is; ``start`` runs a stream. ``on_events`` gets each batch of (line, file, ts) instead of the sink."""

    def __init__(self, spark: SparkSession, options: Options, checkpoint: str, on_events: Callable[[DataFrame], None] | None = None):
        options.validate()
        self.spark, self.o, self.checkpoint = spark, options, checkpoint
        self.sink = None if on_events else build(options.sink)
        self.on_events, self.metrics, self.query = on_events, Metrics(), None
        logtail.register(spark)

    def _source(self, reader, blank: bool, rest: bool = False, start: dict[str, int] | None = None):
        c = self.o.collector
        return reader.format("logtail").options(
            include=json.dumps(c.include), exclude=json.dumps(c.exclude), separator=c.separator, fingerprintStrategy=c.fingerprint_strategy,
            fingerprintSize=str(c.fingerprint_size or 1024), workers=str(16 * max(1, c.workers)), maxBytes=str(c.max_batch_bytes), maxFileBytes=str(c.max_file_bytes if blank else 0), keepBlank=str(blank).lower(), rest=str(rest).lower(), startOffsets=json.dumps(start or {}),
        )

    def _deliver(self, events: DataFrame, batch: int | None = None) -> None:
        """Hands a batch on. Each event has a ``key``, from the file and the byte where it begins: the same if it comes again."""
        events = events.withColumn("key", F.sha2(F.concat_ws("#", "file_id", F.col("byte_pos").cast("string")), 256)).persist()
        name, s = ("events" if self.on_events else self.o.sink.type or "stdout"), self.o.sink
        try:
            lines = events if self.on_events else parsed_lines(events, self.o.parser)
            self.metrics.lines(lines, F.lit(True) if self.on_events else allowed(F.col("line"), s.include, s.exclude), name)
            with self.metrics.flush(name):
                if self.on_events:
                    self.on_events(events.select("line", "file", "ts"))
                elif self.sink:
                    self.sink(lines, batch)
                else:
                    for row in lines.select("line").toLocalIterator():
                        print(row["line"])
        finally:
            events.unpersist()

    def once(self) -> None:
        """Delivers all complete records, and with multiline grouping what is left at the end of each file.

        With stored offsets, only what is new since the last call; they are saved after the delivery. Offsets of files
        that are gone are deleted. There is one offset for each file of the listing, which the driver holds anyway.
        """
        c, m = self.o.collector, self.o.collector.multiline
        store = OffsetStore(self.spark, c.db_path) if c.store_offsets else None
        known = {r["id"]: r["byte_offset"] for r in store.load().where(F.col("strategy") == c.fingerprint_strategy).collect()} if store else {}
        self.metrics.add("restored_offsets_total", len(known))
        rows = self._source(self.spark.read, bool(m), bool(m), known).load().persist()
        events = rows
        if m:
            paths = rows.groupBy("file_id").agg(F.min("file").alias("file"))
            records = grouped(rows.select("file_id", F.col("byte_pos").alias("idx"), "line"), m, block_lines=1 << 26)
            events = records.join(paths, "file_id").select(F.col("record").alias("line"), "file", "file_id", F.col("first_idx").alias("byte_pos"), F.current_timestamp().alias("ts"))
        try:
            self._deliver(events.select("line", "file", "ts", "file_id", "byte_pos"))
            found = listing(c.include, c.exclude, c.fingerprint_strategy, c.fingerprint_size or 1024, c.separator, 16 * max(1, c.workers))
            self.metrics.files({f.file_id for f in found}, set(known))
            if store:
                read = rows.groupBy(F.col("file_id").alias("id")).agg(F.max("end_pos").alias("byte_offset"), F.min("file").alias("path"))
                store.save(read.withColumn("strategy", F.lit(c.fingerprint_strategy)))
                now = {f.file_id for f in found}
                if gone := [(k, c.fingerprint_strategy) for k in known if k not in now]:
                    store.delete(self.spark.createDataFrame(gone, "id string, strategy string"))
        finally:
            rows.unpersist()

    def start(self, available_now: bool = False):
        """A running query; offsets are committed after the batch was delivered."""
        m = self.o.collector.multiline
        rows = self._source(self.spark.readStream, bool(m), start=self._reached()).load()
        if m:
            rows = grouped_stream(rows, m).select(F.col("record").alias("line"), "file", "file_id", "byte_pos", F.current_timestamp().alias("ts"))
        writer = rows.select("line", "file", "ts", "file_id", "byte_pos").writeStream.option("checkpointLocation", self.checkpoint).foreachBatch(self._deliver)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{max(1, int(self.o.collector.poll_interval * 1000))} milliseconds")
        self.query = writer.start()
        self.listener = _Files(self.metrics, str(self.query.id))
        self.spark.streams.addListener(self.listener)
        return self.query

    def _reached(self) -> dict[str, int]:
        """Where the stream of this checkpoint stands, so that the first batch after a restart is bounded too."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.checkpoint}/offsets")
        fs = folder.getFileSystem(conf)
        if not fs.exists(folder):
            return {}
        batches = [int(n) for s in fs.listStatus(folder) if (n := s.getPath().getName()).isdigit()]
        if not batches:
            return {}
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(folder, str(max(batches))))
        try:
            last = bytes(stream.readAllBytes()).decode().strip().split("\n")[-1]
        finally:
            stream.close()
        return {k: v[1] for k, v in json.loads(last).items()} if last.startswith("{") else {}

    def stop(self) -> None:
        if self.query:
            self.query.stop()
            self.spark.streams.removeListener(self.listener)
            self.query = None


class _Files(StreamingQueryListener):
    """Counts the files of a query from the offsets it reports: these hold each file of the last listing."""

    def __init__(self, metrics: Metrics, query_id: str):
        self.metrics, self.query_id = metrics, query_id

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if str(p.id) == self.query_id and p.sources and p.sources[0].endOffset:
            self.metrics.files(set(json.loads(p.sources[0].endOffset)))
