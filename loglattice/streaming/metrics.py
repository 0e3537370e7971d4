"""Counters and histograms of the pipeline, and their exposition as text."""

from __future__ import annotations

import threading
import time
from collections import defaultdict
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of the histogram of batch sizes, and those usual for durations in seconds.
BATCH_BOUNDS = (1, 2, 5, 10, 20, 50, 100, 200, 500, 1000)
SECOND_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10)


def line_totals(lines: DataFrame, line: str = "line", kept: Column | None = None) -> DataFrame:
    """(lines_total, bytes_total): records and their bytes, without separators; blank ones count for nothing.

    With a filter, also the lines it keeps.
    """
    some = lines.where(F.length(line) > 0)
    more = [] if kept is None else [F.coalesce(F.sum(kept.cast("long")), F.lit(0)).alias("kept")]
    return some.agg(F.count(F.lit(1)).alias("lines_total"), F.coalesce(F.sum(F.octet_length(line)), F.lit(0)).cast("long").alias("bytes_total"), *more)


def buckets(value: Column, bounds: tuple[float, ...] = BATCH_BOUNDS) -> Column:
    """(le, n): cumulative counts of an aggregated column, as an array; the last bound is infinite."""
    return F.array(*(F.struct(F.lit(str(b)).alias("le"), F.sum((value <= b).cast("long")).alias("n")) for b in bounds), F.struct(F.lit("+Inf").alias("le"), F.count(value).alias("n")))


class Metrics:
    """Named counters with labels, safe to use from several threads."""

    def __init__(self):
        self._lock, self.values, self.batch, self.seen = threading.Lock(), defaultdict(float), 0, set()

    def add(self, name: str, amount: float = 1, **labels: str) -> None:
        if amount > 0:
            with self._lock:
                self.values[name, tuple(sorted((k, v or "unknown") for k, v in labels.items()))] += amount

    def observe(self, name: str, value: float, bounds: tuple[float, ...] = BATCH_BOUNDS, **labels: str) -> None:
        for b in (*bounds, float("inf")):
            if value <= b:
                self.add(f"{name}_bucket", 1, le="+Inf" if b == float("inf") else f"{b:g}", **labels)
        self.add(f"{name}_sum", value, **labels)
        self.add(f"{name}_count", 1, **labels)

    def lines(self, events: DataFrame, kept: Column, sink: str) -> None:
        """Counts a batch: lines and bytes, and what the sink's filter lets through or drops; one pass."""
        row = line_totals(events, kept=kept).first()
        self.add("lines_total", row["lines_total"])
        self.add("bytes_total", row["bytes_total"])
        self.add("sink_enqueued_total", row["kept"], sink=sink)
        self.add("sink_dropped_total", row["lines_total"] - row["kept"], sink=sink, reason="filtered")
        self.batch = int(row["kept"])

    def files(self, live: set[str], before: set[str] = frozenset()) -> None:
        """Sets the gauge of files that are there, and counts those that were in no earlier listing nor in ``before``."""
        self.set("active_files", len(live))
        self.add("files_seen_total", len(live - self.seen - before))
        self.seen = set(live)

    def set(self, name: str, value: float, **labels: str) -> None:
        with self._lock:
            self.values[name, tuple(sorted(labels.items()))] = value

    @contextmanager
    def flush(self, sink: str):
        """Times a delivery and counts it, or its failure; empty batches count for no flush."""
        began = time.monotonic()
        try:
            yield
        except Exception:
            self.add("sink_flush_failures_total", 1, sink=sink)
            self.add("errors_total", 1)
            raise
        if self.batch:
            self.add("sink_flush_total", 1, sink=sink)
            self.observe("sink_flush_batch_size", self.batch, sink=sink)
            self.observe("sink_flush_duration_seconds", time.monotonic() - began, SECOND_BOUNDS, sink=sink)

    def text(self) -> str:
        with self._lock:
            rows = sorted(self.values.items())
        shown = lambda labels: "{" + ",".join(f'{k}="{v}"' for k, v in labels) + "}" if labels else ""
        return "".join(f"loglattice_{name}{shown(labels)} {value:g}\n" for (name, labels), value in rows)


def serve(metrics: Metrics, addr: str) -> ThreadingHTTPServer:
    """Serves /metrics at host:port until ``shutdown`` is called."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            body = metrics.text().encode() if self.path == "/metrics" else b""
            self.send_response(200 if self.path == "/metrics" else 404)
            self.send_header("Content-Type", "text/plain; version=0.0.4")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    host, _, port = addr.rpartition(":")
    server = ThreadingHTTPServer((host or "0.0.0.0", int(port)), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
