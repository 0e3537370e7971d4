"""Sinks: console, file, column table (ClickHouse) and document index (OpenSearch); batch and stream.

A sink is a function of a batch of lines and its number. Streams call it for each micro-batch, which Spark repeats until
it succeeds: lines are held back, not dropped, when a sink is slow (a deliberate difference from a bounded queue that
drops). A repeated batch leaves no line twice in files, by the folder of its number; nor in a document index or column
table where lines have a ``key``, which makes the documents' ids and the tokens by which the table knows an insert.
"""

from __future__ import annotations

import base64
import hashlib
import json
import sys
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.operators.filters import allowed
from loglattice.options import OptionError, SinkOptions
from loglattice.session import ship

Sink = Callable[..., None]
TABLE_DDL = "CREATE TABLE IF NOT EXISTS {} (ts DateTime64(3), host String, labels Map(String, String), message String) ENGINE = MergeTree ORDER BY (host, ts)"


def _labels(labels: dict[str, str]) -> Column:
    if not labels:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*(F.lit(x) for kv in sorted(labels.items()) for x in kv))


def table_rows(lines: DataFrame, host: str, labels: dict[str, str], now: Column | None = None) -> DataFrame:
    """(ts, host, labels, message) of each line, and its ``key``, if lines have one; ts in milliseconds."""
    ts = F.date_trunc("millisecond", F.current_timestamp() if now is None else now)
    return lines.select(ts.alias("ts"), F.lit(host).alias("host"), _labels(labels).alias("labels"), F.col("line").alias("message"), *_keys(lines))


def documents(lines: DataFrame, host: str, labels: dict[str, str], now: Column | None = None) -> DataFrame:
    """(doc): each line as a JSON document with @timestamp, message, host and labels; and its ``key``, if lines have one."""
    ts = F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    doc = F.to_json(F.struct(ts.alias("@timestamp"), F.col("line").alias("message"), F.lit(host).alias("host"), _labels(labels).alias("labels")))
    return lines.select(doc.alias("doc"), *_keys(lines))


def _keys(lines: DataFrame) -> list[str]:
    return ["key"] if "key" in lines.columns else []


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows of each partition by key, so that a repeated batch is cut into the same requests."""
    return rows.sortWithinPartitions("key") if "key" in rows.columns else rows


def _post(url: str, body: bytes, kind: str, user: str, password: str, timeout: float) -> bytes:
    request = urllib.request.Request(url, body, {"Content-Type": kind})
    if user:
        request.add_header("Authorization", "Basic " + base64.b64encode(f"{user}:{password}".encode()).decode())
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.read()


def _batches(rows: Iterator, size: int, interval: float = float("inf"), clock: Callable[[], float] = time.monotonic) -> Iterator[list]:
    """Lists of ``size`` rows, or fewer where ``interval`` seconds have passed since the first of them came, and the rest."""
    held, since = [], 0.0
    for r in rows:
        since = since if held else clock()
        held.append(r)
        if len(held) >= size or clock() - since >= interval:
            yield held
            held = []
    if held:
        yield held


def qualified(table: str, database: str) -> str:
    return table if "." in table or not database else f"{database}.{table}"


def _console(o: SinkOptions) -> Sink:
    def write(lines: DataFrame, batch: int | None = None) -> None:
        out = sys.stderr if o.console.get("stream") == "stderr" else sys.stdout
        for row in lines.select("line").toLocalIterator(prefetchPartitions=True):
            print(row["line"], file=out)
        out.flush()

    return write


def _file(o: SinkOptions) -> Sink:
    """Without numbers, the first batch replaces what is in the folder and later ones are added. With numbers, batch 0

    replaces all, and each other batch only itself: a stream that goes on after a restart keeps its lines.
    """
    mode = ["overwrite"]

    def write(lines: DataFrame, batch: int | None = None) -> None:
        if batch is None:
            lines.select("line").write.mode(mode[0]).text(o.file["path"])
            mode[0] = "append"
            return
        if batch == 0:
            path = lines.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(o.file["path"])
            path.getFileSystem(lines.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        lines.select("line").write.mode("overwrite").text(f"{o.file['path']}/batch={batch:012d}")

    return write


def _clickhouse(o: SinkOptions) -> Sink:
    c, host = o.clickhouse, o.host_name()
    addr = c["addr"] if "://" in c["addr"] else f"http://{c['addr']}"
    table = qualified(c["table"], c.get("database", ""))
    user, password, size, interval = c.get("username", ""), c.get("password", ""), o.batch_size, o.batch_interval

    def send(rows):
        for batch in _batches(rows, size, interval):
            body = "\n".join(r["row"] for r in batch).encode()
            token = {"insert_deduplication_token": hashlib.sha256("".join(r["key"] for r in batch).encode()).hexdigest()} if "key" in batch[0] else {}
            query = urllib.parse.urlencode({"query": f"INSERT INTO {table} FORMAT JSONEachRow"} | token)
            _post(f"{addr}/?{query}", body, "application/x-ndjson", user, password, 10)

    def write(lines: DataFrame, batch: int | None = None) -> None:
        ship(lines.sparkSession)
        rows = table_rows(lines, host, o.labels)
        rows = rows.select(F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"), "host", "labels", "message")).alias("row"), *_keys(rows))
        _in_order(rows).foreachPartition(send)

    _post(f"{addr}/?{urllib.parse.urlencode({'query': TABLE_DDL.format(table)})}", b"", "text/plain", user, password, 10)
    return write


def _opensearch(o: SinkOptions) -> Sink:
    c, host, size, interval = o.opensearch, o.host_name(), o.batch_size, o.batch_interval
    url, user, password = c["url"].rstrip("/"), c.get("username", ""), c.get("password", "")

    def action(row) -> str:
        return json.dumps({"index": {"_index": c["index"]} | ({"_id": row["key"]} if "key" in row else {})})

    def send(rows):
        for batch in _batches(rows, size, interval):
            body = "".join(f"{action(r)}\n{r['doc']}\n" for r in batch).encode()
            answer = json.loads(_post(f"{url}/_bulk", body, "application/x-ndjson", user, password, 15) or b"{}")
            if answer.get("errors"):
                raise RuntimeError("some documents were not indexed")

    def write(lines: DataFrame, batch: int | None = None) -> None:
        ship(lines.sparkSession)
        _in_order(documents(lines, host, o.labels)).foreachPartition(send)

    return write


REGISTRY: dict[str, Callable[[SinkOptions], Sink]] = {"console": _console, "file": _file, "clickhouse": _clickhouse, "opensearch": _opensearch}


def build(options: SinkOptions) -> Sink | None:
    """The sink of these options with its line filter; None for the empty type."""
    options.validate()
    if not options.type:
        return None
    if options.type not in REGISTRY:
        raise OptionError(f"invalid sink.type: {options.type}")
    write = REGISTRY[options.type](options)
    return lambda lines, batch=None: write(lines.where(allowed(F.col("line"), options.include, options.exclude)), batch)


def write_table(lines: DataFrame, path: str, host: str, labels: dict[str, str], now: Column | None = None) -> None:
    """The rows of the column table as parquet, sorted by (host, ts) within files."""
    table_rows(lines, host, labels, now).sortWithinPartitions("host", "ts").write.mode("append").parquet(path)
