import json
import re

from pyspark.sql import functions as F

from loglattice.operators import layouts

LV = {**dict.fromkeys(["d", "debug", "trace"], "DEBUG"), **dict.fromkeys(["i", "info", "notice"], "INFO"), **dict.fromkeys(["w", "warn", "warning"], "WARN"), **dict.fromkeys(["e", "err", "error", "severe"], "ERROR"),
      **dict.fromkeys(["f", "fatal", "crit", "critical", "panic"], "FATAL")}


def head(line):
    """(level, component) of a line that starts an entry, else None; ("", "") for a lone brace."""
    line = line.rstrip()
    if line == "{":
        return "", ""
    if line.startswith('{"'):
        try:
            o = json.loads(line)
        except ValueError:
            return None
        return o.get("level") or o.get("lvl") or o.get("severity") or "", o.get("component") or o.get("logger") or o.get("module") or ""
    if m := re.match(r"([DIWEF])\d{4} [\d:.]+ +\d+ (\S+):\d+\]", line):
        return m[1], m[2]
    if m := re.match(r"\d{4}-\d\d-\d\d [\d:]+,\d+ - (\S+) - (\w+) -", line):
        return m[2], m[1]
    if m := re.match(r"\d{4}-\d\d-\d\d [\d:]+,\d+ (\w+) +\[\S+\] (\S+) -", line):
        return m[1], m[2]
    if m := re.match(r"\[\d{4}-\d\d-\d\d [\d:]+\] (\S+)\.(\w+):", line):
        return m[2], m[1]
    if line.startswith("time="):
        plain = re.sub(r'"[^"]*"', "", line)
        pick = lambda k: (re.search(rf" {k}=(\S+)", plain) or ["", ""])[1]
        return pick("level"), pick("component")
    if m := re.match(r"[A-Z][a-z]{2} +\d+ [\d:]{8} \S+ ([^\s\[:]+)(?:\[\d+\])?: (.*)", line):
        said = re.match(r"<(\w+)> |\[(\w+)\] |(\w+): |([A-Z]+) ", m[2])
        word = next((w for w in said.groups() if w), "") if said else ""
        return word if word.lower() in LV else "", m[1]
    return None


def brute(rows):
    kept = {}
    for event_id, line, file, file_id, pos in rows:
        if ".csv" in file or "audit" in file:
            continue
        if (file_id, pos) not in kept or kept[file_id, pos][0] > event_id:
            kept[file_id, pos] = (event_id, line, file)
    out, current = {}, None
    for (file_id, pos), (event_id, line, file) in sorted(kept.items()):
        if "dmesg" in file:
            m = re.match(r"(?:<(\d+)>)?\[[^\]]*\]\s*([^\n]*)", line)
            p = int(m[1]) & 7 if m[1] else None
            lvl = "" if p is None else ["FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG"][p]
            word = m[2].split(":")[0].split()[0].split("[")[0] if ":" in m[2] else ""
            out[event_id] = [line.count("\n") + 1, lvl, word]
            continue
        if current and current[0] != file_id:
            current = None
        if (h := head(line)) is not None:
            current = (file_id, event_id, line.rstrip() == "{")
            out[event_id] = [1, LV.get(h[0].lower(), ""), h[1]]
        elif current:
            o = out[current[1]]
            o[0] += 1
            if current[2] and (m := re.match(r'\s+"(\w+)": "(.*)",?\s*$', line)):
                if m[1] in ("level", "lvl", "severity"):
                    o[1] = LV.get(m[2].lower(), "")
                if m[1] in ("component", "logger", "module"):
                    o[2] = m[2]
    return {k: tuple(v) for k, v in out.items()}


COLS = ("event_id", "line", "file", "file_id", "byte_pos")


def test_whole_table(spark, table):
    events = table("line_events")
    got = {r["event_id"]: (r["n_lines"], r["lvl"], r["component"]) for r in layouts.log_entries(events, texts=False).collect()}
    assert got == brute([tuple(r) for r in events.select(*COLS).collect()])


def test_blocks_do_not_matter(spark, table):
    lines, hosts = table("line_events").where("file like '%.log%' and file not like '%audit%'"), table("log_hosts")
    key = lambda df: sorted(map(tuple, df.collect()))
    whole = key(layouts.log_entries(lines, hosts=hosts))
    assert key(layouts.log_entries(lines, hosts=hosts, block_bytes=64)) == whole
    assert any("\n" in r[5] for r in whole) and any(r[6] is not None for r in whole)


def test_rules_beyond_the_bound_are_resolved_by_line(spark, table, monkeypatch):
    key = lambda df: sorted(map(tuple, df.collect()))
    before = key(layouts.log_entries(table("line_events"), texts=False))
    monkeypatch.setattr(layouts, "RULE_BYTES", 0)
    assert key(layouts.log_entries(table("line_events"), texts=False)) == before


def test_times_become_instants(spark):
    rows = [
        (1, "Dec 31 23:59:59 h p: x", "2025-01-01 00:00:10", 1735689599000000), (2, "Jan 1 00:00:01 h p: x", "2025-01-01 00:00:10", 1735689601000000), (3, "Jan 2 00:00:01 h p: x", "2025-01-01 00:00:10", 1735776001000000),
        (4, "I1231 23:59:59.5   7 a.cc:1] x", "2025-01-01 00:00:10", 1735689599500000), (5, "Feb 29 10:00:00 h p: x", "2025-03-01 00:00:00", -1), (6, "Jan 1 00:00:01 h p: x", None, -1),
        (7, "time=2024-11-01T00:08:40-04:00 level=warn", None, 1730434120000000), (8, '{"ts":1735689599.25,"msg":"a"}', None, 1735689599250000), (9, '{"msg":"no time"}', None, None), (10, "2024-13-05 03:04:07,551 - q - INFO - x", None, -1),
    ]
    df = spark.createDataFrame([(i, line, "/a.log", "f", i * 10, "h", ts) for i, line, ts, _ in rows], "event_id long, line string, file string, file_id string, byte_pos long, host_name string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    hosts = spark.createDataFrame([("h", "Etc/UTC", "utc")], "host_name string, tz_name string, clock_mode string")
    got = {r["event_id"]: r["instant_us"] for r in layouts.log_entries(df, hosts=hosts).collect()}
    assert got == {i: want for i, _, _, want in rows}
    kernel = spark.createDataFrame([(1, "[12.5] x", "/dmesg", "k", 0, "h"), (2, "<5>[Sun Oct 13 08:03:43 2024] TCP: y", "/dmesg", "k", 9, "h")], "event_id long, line string, file string, file_id string, byte_pos long, host_name string").withColumn("ts", F.lit(None).cast("timestamp"))
    assert {r["event_id"]: (r["instant_us"], r["message"]) for r in layouts.log_entries(kernel, hosts=hosts).collect()} == {1: (None, "x"), 2: (1728806623000000, "y")}


def test_edges(spark):
    rows = [
        (1, "  orphan", "/a.log", "f", 0), (2, "2024-03-05 03:04:07,551 - q - WARNING - hi - there", "/a.log", "f", 10), (9, "copy of another text", "/a.log", "f", 10), (3, "", "/a.log", "f", 90), (4, None, "/a.log", "f", 91),
        (5, "Oct  7 00:33:28 h prog[3]: info: no error", "/a.log", "f", 99), (6, "x" * 200_000, "/a.log", "f", 150), (7, "[    1.5] usb 1-1: a: b\n Call 0: x\n", "/dmesg", "k", 0), (8, "<3>[2] started", "/dmesg", "k", 40),
        (10, "I0309 23:52:47.372822   79323 a_b.cc:12] hm", "/a.log", None, 5), (11, "no head", "/a.log", None, None), (12, "Oct 7 00:33:28 h prog: warn_limit=1", "/a.log", "f", 900000), (13, "z", None, "f", 7),
    ]
    df = spark.createDataFrame(rows, "event_id long, line string, file string, file_id string, byte_pos long")
    got = {r["event_id"]: (r["n_lines"], r["lvl"], r["component"], r["message"]) for r in layouts.log_entries(df).collect()}
    assert got == {
        2: (3, "WARN", "q", "hi - there\n\n"), 5: (2, "INFO", "prog", "no error\n" + "x" * 200_000), 7: (2, "", "usb", "a: b\n Call 0: x"), 8: (1, "ERROR", "", "started"), 10: (1, "INFO", "a_b.cc", "hm"), 12: (1, "", "prog", "warn_limit=1"),
    }
    assert layouts.log_entries(df.limit(0)).count() == 0
