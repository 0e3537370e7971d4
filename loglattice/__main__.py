"""Runs the collector: ``python -m loglattice --config collector.toml``."""

from __future__ import annotations

import argparse
import signal

from pyspark.sql import SparkSession

from loglattice.options import load
from loglattice.streaming.collector import Collector
from loglattice.streaming.metrics import serve


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="loglattice")
    p.add_argument("--config")
    p.add_argument("--include", "-I", action="append")
    p.add_argument("--exclude", "-E", action="append")
    p.add_argument("--poll-interval", "-i")
    p.add_argument("--separator")
    p.add_argument("--fingerprint-size", "-s", type=int)
    p.add_argument("--fingerprint-strategy", "-f")
    p.add_argument("--workers", "-w", type=int)
    p.add_argument("--db-path")
    p.add_argument("--store-offsets")
    p.add_argument("--prometheus.enable", dest="prometheus.enable", action="store_true", default=None)
    p.add_argument("--prometheus.addr", dest="prometheus.addr")
    p.add_argument("--once", action="store_true", help="read what there is, then end")
    p.add_argument("--checkpoint", default="collector.checkpoint")
    given = vars(p.parse_args(args))
    path, once, checkpoint = given.pop("config"), given.pop("once"), given.pop("checkpoint")
    options = load(path, flags={k: v for k, v in given.items() if v is not None})
    spark = SparkSession.builder.appName("loglattice").getOrCreate()
    collector = Collector(spark, options, checkpoint)
    if options.prometheus.enable:
        serve(collector.metrics, options.prometheus.addr)
    if once:
        collector.once()
    else:
        query = collector.start()
        for name in (signal.SIGINT, signal.SIGTERM):
            signal.signal(name, lambda *_: query.stop())  # the running batch is not committed, and comes again
        query.awaitTermination()


if __name__ == "__main__":
    main()
