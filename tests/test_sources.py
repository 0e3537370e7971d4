import hashlib
import http.server
import io
import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from loglattice import options as opt
from loglattice.operators import tracking
from loglattice.sinks import writers
from loglattice.sources import discovery as d
from loglattice.sources import logtail
from loglattice.sources.offsets import OffsetStore
from loglattice.streaming.collector import Collector
from loglattice.streaming.metrics import Metrics, buckets, serve


def write(path, data, mode="wb"):
    with open(path, mode) as f:
        f.write(data)
    return str(path)


def test_roots(tmp_path):
    assert d.glob_root("/var/log/*.log") == "/var/log" and d.glob_root("logs/**/*.txt") == "logs" and d.glob_root("*.log") == "." and d.glob_root("") == "" and d.glob_root("/a/b") == "/a/b"
    f = write(tmp_path / "x.log", b"1")
    assert d.scan_roots([f]) == [str(tmp_path)] and d.scan_roots([str(tmp_path / "no")]) == [str(tmp_path)] and d.scan_roots([]) == ["."]
    d.check_overlap(["/tmp/logs", "/tmp/logs"])
    with pytest.raises(opt.OptionError):
        d.check_overlap(["/tmp/logs", "/tmp/logs/app"])
    assert d.is_sub_path("/a/b", "/a") and not d.is_sub_path("/a", "/a") and not d.is_sub_path("/b", "/a")


@pytest.mark.parametrize(("include", "exclude", "want"), [
    (["{}", "*.log"], [], ["log2.log"]), (["{}"], ["*.log"], ["config.yaml", "data.json", "log1.txt"]), (["{}", "*.txt", "*.log"], ["*.json"], ["log1.txt", "log2.log"]), (["{}/log1.txt"], [], ["log1.txt"]), (["{}/*.y*ml"], [], ["config.yaml"]),
])
def test_include_and_exclude(tmp_path, tmp_path_factory, monkeypatch, include, exclude, want):
    monkeypatch.chdir(tmp_path_factory.mktemp("elsewhere"))  # a bare glob also looks in the working folder
    for name in ("log1.txt", "log2.log", "data.json", "config.yaml"):
        write(tmp_path / name, name.encode())
    write(tmp_path / "empty.log", b"")
    os.mkdir(tmp_path / "sub")
    found = d.listing([i.format(tmp_path) for i in include], exclude, "deviceAndInode", 0)
    assert sorted(os.path.basename(f.path) for f in found) == want


def test_identities(tmp_path):
    f = write(tmp_path / "f", b"a<END>b<END>c<END>")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert d.separator_checksum_of(f, b"<END>", 2) == sha(b"a<END>b<END>") and d.checksum_of(f, 3) == sha(b"a<E") and d.checksum_of(f, 0) == sha(b"a<END>b<END>c<END>")
    with pytest.raises(d.NotEnoughSeparators):
        d.separator_checksum_of(f, b"<END>", 4)
    with pytest.raises(d.FileSizeTooSmall):
        d.checksum_of(f, 100)
    with pytest.raises(ValueError):
        d.separator_checksum_of(f, b"", 1)
    big = write(tmp_path / "big", (b"x" * (d.BLOCK - 1) + b"\r\n") * 3)
    assert d.separator_checksum_of(big, b"\r\n", 2) == sha((b"x" * (d.BLOCK - 1) + b"\r\n") * 2)
    inode = d.inode_of(f)
    os.rename(f, tmp_path / "g")
    assert d.inode_of(str(tmp_path / "g")) == inode and d.identity(str(tmp_path / "no"), "checksum", 1, "\n") is None
    write(tmp_path / "copy", b"a<END>b<END>c<END>")
    assert len(d.listing([str(tmp_path)], ["big"], "checksum", 4)) == 1  # equal prefixes are one file
    with pytest.raises(opt.OptionError):
        d.identity(str(tmp_path / "g"), "other", 1, "\n")


def read(spark, path, **o):
    logtail.register(spark)
    rows = spark.read.format("logtail").options(include=str(path), fingerprintStrategy="checksum", fingerprintSize="4", **o).load()
    return [(r["line"], r["byte_pos"], r["end_pos"]) for r in rows.orderBy("file", "byte_pos").collect()]


def test_batch(spark, tmp_path):
    f = write(tmp_path / "a.log", "line1\n\nline2ü\nrest".encode())
    assert read(spark, f) == [("line1", 0, 6), ("line2ü", 7, 15)]
    assert read(spark, f, rest="true", keepBlank="true") == [("line1", 0, 6), ("", 6, 7), ("line2ü", 7, 15), ("rest", 15, 19)]
    fid = d.checksum_of(f, 4)
    assert read(spark, f, startOffsets=json.dumps({fid: 7})) == [("line2ü", 7, 15)] and len(read(spark, f, startOffsets=json.dumps({fid: 999}))) == 2
    g = write(tmp_path / "b.log", b"".join(b"record %05d<END>" % i for i in range(3000)))
    for split in ("1000000", "4099"):
        assert [x for x, _, _ in read(spark, g, separator="<END>", splitBytes=split)] == [f"record {i:05d}" for i in range(3000)], split
    for split in range(1, 40):
        cuts = [*range(0, 170, split), 170]
        for block in (1, 7, 1000):
            parts = [logtail.split_records(io.BytesIO(open(g, "rb").read()), b"<END>", a, b, a == 0, block=block) for a, b in zip(cuts, cuts[1:])]
            got = [(at, r) for p in parts for begins, records in p for at, r in zip(begins.tolist(), records)]
            assert got == [(17 * i, b"record %05d" % i) for i in range(10)], (split, block)
    assert read(spark, write(tmp_path / "c.log", b"x" * 1000)) == [] and read(spark, tmp_path / "none.log") == []
    assert len(read(spark, write(tmp_path / "n.log", b"burst: " + b"\0" * 9000 + b"\n" + os.urandom(500).replace(b"\n", b" ") + b"\n"))) == 2


def test_stream_batches_are_bounded(tmp_path):
    for k in range(3):
        write(tmp_path / f"{k}.log", b"".join(b"%d-%03d\n" % (k, i) for i in range(50)))
    write(tmp_path / "long.log", b"x" * 1000 + b"\ny\n")
    s = logtail._Stream(logtail._Options({"include": str(tmp_path / "*.log"), "maxBytes": "100"}))
    start, got, rounds = s.initialOffset(), [], 0
    while (end := s.latestOffset()) != start and rounds < 50:
        parts = s.partitions(start, end)
        lines = [x for p in parts for r in s.read(p) for x in r["line"].to_pylist()]
        assert lines and (sum(len(x) + 1 for x in lines) <= 100 or lines == ["x" * 1000])
        got, start, rounds = got + lines, end, rounds + 1
    assert sorted(got) == sorted([f"{k}-{i:03d}" for k in range(3) for i in range(50)] + ["x" * 1000, "y"])
    s = logtail._Stream(logtail._Options({"include": str(tmp_path / "*.log")}))
    assert s.latestOffset() == s.latestOffset() == start
    s, begin, rounds = logtail._Stream(logtail._Options({"include": str(tmp_path / "*.log"), "maxFileBytes": "60"})), {}, 0
    while (end := s.latestOffset()) != begin:
        assert all(v[1] - begin.get(k, ["", 0])[1] in (1001, *range(61)) for k, v in end.items())
        begin, rounds = end, rounds + 1
    assert begin == start and rounds == 5


def test_tracker():
    t = d.FileTracker()
    t.add(d.TrackedFile("a", "/a", "checksum"))
    copy = t.get("a")
    copy.offset = 9
    assert t.get("a").offset == 0 and t.update_offset("a", 5) and not t.update_offset("b", 5) and t.all()["a"].offset == 5
    assert t.path("a") == "/a" and t.path("b") == "" and t.get("b") is None
    t.remove("a")
    assert t.all() == {}


def run_stream(collector):
    q = collector.start(available_now=True)
    q.awaitTermination(60)
    assert q.exception() is None


def test_stream_resumes_rotates_and_renames(spark, tmp_path):
    logs, got = tmp_path / "logs", []
    os.mkdir(logs)
    o = opt.Options()
    o.collector = opt.CollectorOptions(include=[str(logs)], fingerprint_strategy="checksum", fingerprint_size=5)
    make = lambda: Collector(spark, o, str(tmp_path / "cp"), on_events=lambda df: got.extend(r["line"] for r in df.orderBy("line").collect()))
    write(logs / "a.log", b"line1\nline2\nline3\npart")
    c = make()
    run_stream(c)
    assert got == ["line1", "line2", "line3"]
    write(logs / "a.log", b"ial\nline5\n", "ab")
    run_stream(make())
    assert got[3:] == ["line5", "partial"]
    os.rename(logs / "a.log", logs / "a.log.1")
    write(logs / "a.log", b"other1\n")
    write(logs / "a.log.1", b"line6\n", "ab")
    run_stream(make())
    assert got[5:] == ["line6", "other1"]
    assert c.metrics.values["lines_total", ()] == 3 and "loglattice_lines_total 3" in c.metrics.text()


def test_stream_ranges_follow_renamed_files(tmp_path, monkeypatch):
    logs = tmp_path / "logs"
    os.mkdir(logs)
    make = lambda **o: logtail._Stream(logtail._Options({"include": str(logs / "*.log*"), "fingerprintStrategy": "checksum", "fingerprintSize": "3"} | o))
    lines = lambda s, parts: sorted(x for p in parts for r in s.read(p) for x in r["line"].to_pylist())
    write(logs / "a.log", b"one\ntwo\n")
    s = make()
    end = s.latestOffset()
    parts = s.partitions({}, end)
    os.rename(logs / "a.log", logs / "a.log.1")
    assert lines(s, parts) == lines(s, make().partitions({}, end)) == ["one", "two"]  # renamed after the plan, and before a replay
    write(logs / "a.log", b"new\n")
    assert lines(s, parts) == ["one", "two"]  # another file has the path
    os.rename(logs / "a.log.1", logs / "old")  # a name that is not included
    assert lines(s, parts) == lines(s, make(splitBytes="3").partitions({}, end)) == ["one", "two"]
    with monkeypatch.context() as m:  # it is there, but can never be read
        m.setattr(s.o, "whereabouts", lambda *a: str(logs / "a.log"))
        with pytest.raises(d.FingerprintMismatch):
            lines(s, parts)
    os.remove(logs / "old")
    assert lines(s, parts) == []  # gone


def test_stream_groups_and_flushes_idle_records(spark, tmp_path):
    f = write(tmp_path / "a.log", b"ERROR start\n  detail1\n  detail2\nINFO ok\n  cont\n")
    o = opt.Options()
    o.collector = opt.CollectorOptions(include=[f], poll_interval=0.2, multiline=opt.MultilineOptions("continueThrough", "^(ERROR|INFO)", r"^\s", 0.5))
    got = []
    c = Collector(spark, o, str(tmp_path / "cp"), on_events=lambda df: got.extend(r["line"] for r in df.collect()))
    q = c.start()
    end = time.time() + 60
    while len(got) < 2 and time.time() < end and q.isActive:
        time.sleep(0.3)
    c.stop()
    assert got == ["ERROR start\n  detail1\n  detail2", "INFO ok\n  cont"]


def test_once_with_parser_filter_and_file_sink(spark, tmp_path):
    f = write(tmp_path / "audit.log", b'type=A msg=audit(1.5:7): k="v w"\nplain\nkeep drop\n')
    o = opt.Options()
    o.collector = opt.CollectorOptions(include=[f], db_path=str(tmp_path / "db"))
    o.parser = opt.ParserOptions("auditd")
    o.sink = opt.SinkOptions("file", exclude=["drop"], file={"path": str(tmp_path / "out")})
    Collector(spark, o, str(tmp_path / "cp")).once()
    out = [r[0] for r in spark.read.text(str(tmp_path / "out")).orderBy("value").collect()]
    assert out[0] == "plain" and json.loads(out[1])["fields"] == {"k": "v w"} and len(out) == 2


def test_once_goes_on_from_stored_offsets(spark, tmp_path):
    f = write(tmp_path / "a.log", b"line1\nline2\nline3\n")
    o, got = opt.Options(), []
    o.collector = opt.CollectorOptions(include=[str(tmp_path / "*.log")], db_path=str(tmp_path / "db"), fingerprint_strategy="checksum", fingerprint_size=3)
    run = lambda: Collector(spark, o, "", on_events=lambda df: got.extend(sorted(r["line"] for r in df.collect()))).once()
    run()
    run()
    write(f, b"line4\nline5\npart", "ab")
    run()
    assert got == ["line1", "line2", "line3", "line4", "line5"]
    os.remove(f)
    write(tmp_path / "b.log", b"other\n")
    run()
    stored = OffsetStore(spark, str(tmp_path / "db")).load().collect()
    assert got[5:] == ["other"] and [(r["path"], r["byte_offset"]) for r in stored] == [(str(tmp_path / "b.log"), 6)]


def test_once_groups_to_the_end_of_the_file(spark, tmp_path):
    f = write(tmp_path / "a.log", b"ERROR start\n  detail1\n  detail2")
    o, got = opt.Options(), []
    o.collector = opt.CollectorOptions(include=[f], multiline=opt.MultilineOptions(java=True), store_offsets=False)
    Collector(spark, o, str(tmp_path / "cp"), on_events=lambda df: got.extend(df.collect())).once()
    assert [(r["line"], r["file"]) for r in got] == [("ERROR start\n  detail1\n  detail2", f)]


@pytest.fixture
def server():
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, self.rfile.read(int(self.headers["Content-Length"] or 0)).decode(), self.headers.get("Authorization")))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b'{"errors": false}' if "fail" not in seen[-1][1] else b'{"errors": true}')

        def log_message(self, *args):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s.server_address[1], seen
    s.shutdown()


def test_network_sinks(spark, server):
    port, seen = server
    lines = spark.createDataFrame([(f"m{i}",) for i in range(5)], "line string").coalesce(1)
    o = opt.SinkOptions("opensearch", batch_size=2, host="h", labels={"env": "x"}, opensearch={"url": f"http://127.0.0.1:{port}", "index": "logs", "username": "u", "password": "p"})
    writers.build(o)(lines)
    docs = [json.loads(x) for _, body, _ in seen for x in body.splitlines()]
    assert len(seen) == 3 and docs[0] == {"index": {"_index": "logs"}} and [x["message"] for x in docs[1::2]] == [f"m{i}" for i in range(5)] and docs[1]["labels"] == {"env": "x"} and docs[1]["host"] == "h"
    assert seen[0][0] == "/_bulk" and seen[0][2].startswith("Basic ")
    with pytest.raises(Exception):
        writers.build(o)(spark.createDataFrame([("fail",)], "line string"))
    seen.clear()
    writers.build(opt.SinkOptions("clickhouse", host="h", clickhouse={"addr": f"127.0.0.1:{port}", "table": "logs", "database": "db"}))(lines)
    assert "CREATE+TABLE" in seen[0][0] and "db.logs" in seen[1][0] and [json.loads(x)["message"] for x in seen[1][1].splitlines()] == [f"m{i}" for i in range(5)]


def test_repeated_batches(spark, server, tmp_path):
    port, seen = server
    lines = spark.createDataFrame([(f"m{i}", f"k{i}") for i in range(5)], "line string, key string").repartition(2)
    for o, ask in (
        (opt.SinkOptions("opensearch", batch_size=2, opensearch={"url": f"http://127.0.0.1:{port}", "index": "logs"}), lambda p, b: sorted(json.loads(x)["index"]["_id"] for x in b.splitlines()[::2])),
        (opt.SinkOptions("clickhouse", batch_size=2, clickhouse={"addr": f"127.0.0.1:{port}", "table": "logs"}), lambda p, b: p.partition("insert_deduplication_token=")[2]),
    ):
        sink, told = writers.build(o), []
        for _ in range(2):
            seen.clear()
            sink(lines, 7)
            told.append(sorted(map(str, (ask(p, b) for p, b, _ in seen))))
        assert told[0] == told[1] and all(told[0]) and len(set(told[0])) >= 3
    file = writers.build(opt.SinkOptions("file", file={"path": str(tmp_path / "out")}))
    texts = lambda: sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect())
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "line string")
    file(one("old"), 3)
    file(one("a", "b"), 0)  # a new stream
    file(one("c"), 1)
    file(one("c"), 1)
    writers.build(opt.SinkOptions("file", file={"path": str(tmp_path / "out")}))(one("d"), 2)  # after a restart
    assert texts() == ["a", "b", "c", "d"]


def test_batches_end_by_size_or_interval():
    assert list(writers._batches(iter("abcde"), 2)) == [["a", "b"], ["c", "d"], ["e"]]
    now = iter(range(0, 100, 4))
    assert max(map(len, writers._batches(iter("abcdefgh"), 100, 10, lambda: next(now)))) < 8


def test_files_are_counted():
    m = Metrics()
    m.files({"a", "b"}, {"b"})
    m.files({"a", "c"})
    assert m.values["files_seen_total", ()] == 2 and m.values["active_files", ()] == 2


def test_public_names():
    import loglattice

    assert loglattice.Collector is Collector and loglattice.FileTracker is d.FileTracker and all(getattr(loglattice, n) is not None for n in loglattice.__all__)
    with pytest.raises(AttributeError):
        loglattice.nothing


def test_path_filters_and_alerts(spark):
    from loglattice.operators import filters

    paths = ["/a/x.log", "/a/b/y.txt", "/c/x.log", "/ab/z", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    kept = lambda *a: [r["p"] for r in df.where(filters.included(F.col("p"), *a)).collect()]
    assert kept(["/a/"]) == ["/a/x.log", "/a/b/y.txt"] and kept(["/a/", "z"]) == ["/ab/z"] and kept(["/a/", "*.txt"]) == ["/a/b/y.txt"] and kept(["/c/x.log"], ["x*"]) == []
    rows = spark.createDataFrame([(400, 1, None), (200, 10001, 31.0), (None, None, 30.0)], "s int, b int, t double")
    found = [r[0] for r in rows.select(filters.alerts({"status": F.col("s"), "bytes": F.col("b"), "temperature": F.col("t")})).collect()]
    assert found == [["http_error"], ["large_response", "high_temperature"], []] and rows.select(filters.alerts({})).first()[0] == []
    assert df.limit(0).agg(*filters.markers(F.col("p"), {"x": "x"})).first()["x"] is False and df.agg(*filters.markers(F.col("p"), {"x": "y.t"})).first()["x"] is True


def test_console_and_no_sink(spark, capsys):
    df = spark.createDataFrame([("a",), ("drop b",)], "line string")
    writers.build(opt.SinkOptions("console", exclude=["drop"]))(df)
    writers.build(opt.SinkOptions("console", console={"stream": "stderr"}, include=["b"]))(df)
    out = capsys.readouterr()
    assert out.out == "a\n" and out.err.endswith("drop b\n") and writers.build(opt.SinkOptions("")) is None


def test_offset_store(spark, tmp_path):
    s = OffsetStore(spark, str(tmp_path / "offsets"))
    assert s.load().count() == 0
    rows = lambda *r: spark.createDataFrame(list(r), "id string, strategy string, path string, byte_offset long")
    s.save(rows(("a", "s", "/1", 5), ("b", "s", "/2", 7)))
    s.save(rows(("a", "s", "/3", 9)))
    s.delete(spark.createDataFrame([("b", "s"), ("no", "s")], "id string, strategy string"))
    again = OffsetStore(spark, str(tmp_path / "offsets")).load()
    assert [(r["id"], r["path"], r["byte_offset"]) for r in again.collect()] == [("a", "/3", 9)]


def test_tracking(spark):
    seen = spark.createDataFrame([("a", "/1"), ("b", "/2"), (None, "/3")], "file_id string, path string")
    tracked = spark.createDataFrame([("b", "/2"), ("c", "/1")], "file_id string, path string")
    one = tracking.first_paths(seen)
    assert [r["file_id"] for r in tracking.new_files(one, tracked).collect()] == ["a"] and [r["file_id"] for r in tracking.removed_files(one, tracked).collect()] == ["c"]
    assert [(r["file_id"], r["current_id"]) for r in tracking.stale(tracked, seen).collect()] == [("c", "a")]


def test_options(tmp_path):
    path = write(tmp_path / "c.toml", b'[collector]\ninclude = ["/a"]\npoll-interval = "1m30s"\nfingerprint-size = 9\n[collector.multiline]\njava = true\ntimeout = "250ms"\n[sink]\ntype = "file"\nbatch-size = 7\n[sink.file]\npath = "/o"\n[parser]\ntype = "auditd"\n')
    o = opt.load(path, {"LOGLATTICE_SINK__BATCH_SIZE": "8", "LOGLATTICE_SINK_HOST": "h", "LOGLATTICE_PROMETHEUS_ENABLE": "true"}, {"include": ["/b"], "prometheus.addr": ":9"})
    o.validate()
    assert o.collector.include == ["/b"] and o.collector.poll_interval == 90 and o.collector.fingerprint_size == 9 and o.collector.multiline.timeout == 0.25 and o.collector.multiline.mode == "continueThrough"
    assert o.sink.batch_size == 8 and o.sink.host_name() == "h" and o.prometheus.enable and o.prometheus.addr == ":9" and o.parser.type == "auditd"
    assert opt.load(env={"LOGLATTICE_CONFIG": path}).sink.file == {"path": "/o"}
    bad = [
        (opt.Options(sink=opt.SinkOptions("stdout")), "invalid sink.type"), (opt.Options(sink=opt.SinkOptions(batch_size=0)), "batch-size"), (opt.Options(sink=opt.SinkOptions(batch_interval=0)), "batch-interval"),
        (opt.Options(sink=opt.SinkOptions("file")), "sink.file.path"), (opt.Options(sink=opt.SinkOptions("opensearch", opensearch={"url": "x"})), "index"), (opt.Options(prometheus=opt.PrometheusOptions(True, "")), "prometheus.addr"),
        (opt.Options(collector=opt.CollectorOptions(fingerprint_strategy="checksum")), "fingerprint size must be greater than 0"), (opt.Options(collector=opt.CollectorOptions(fingerprint_strategy="x")), "unsupported"),
        (opt.Options(collector=opt.CollectorOptions(fingerprint_strategy="checksumSeparator", fingerprint_size=1, separator="")), "separator must be set"), (opt.Options(sink=opt.SinkOptions(console={"stream": "x"})), "stream"),
    ]
    for o, message in bad:
        with pytest.raises(opt.OptionError, match=message):
            o.validate()
    c = opt.CollectorOptions()
    c.default_fingerprint()
    assert (c.fingerprint_strategy, c.fingerprint_size) == ("checksum", 1024)
    with pytest.raises(opt.OptionError):
        opt.seconds("5 parsecs")


def test_metrics(spark):
    m = Metrics()
    m.add("dropped", 2, reason="")
    m.add("dropped", 0)
    m.observe("size", 7)
    assert 'loglattice_dropped{reason="unknown"} 2' in m.text() and 'loglattice_size_bucket{le="5"}' not in m.text() and 'loglattice_size_bucket{le="10"} 1' in m.text()
    import urllib.request

    s = serve(m, "127.0.0.1:0")
    with urllib.request.urlopen(f"http://127.0.0.1:{s.server_address[1]}/metrics") as r:
        assert b"loglattice_size_count 1" in r.read()
    s.shutdown()
    rows = spark.createDataFrame([(1,), (7,), (2000,)], "n int").agg(buckets(F.col("n")).alias("b")).first()["b"]
    assert {r["le"]: r["n"] for r in rows}["10"] == 2 and rows[-1]["n"] == 3


def test_entry_point(spark):
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and {f"p{n}_found" for n in (1, 2, 3, 5, 6, 7)} <= set(q)
    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).count() > 0
