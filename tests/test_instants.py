"""Times against a brute-force reading with strptime and the zone's rules."""

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from loglattice.operators import instants

FORMATS = [
    "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S", "%m/%d/%Y %I:%M:%S %p", "%m/%d/%Y %H:%M:%S", "%d.%m.%Y %H:%M:%S", "%a, %d %b %Y %H:%M:%S", "%d/%b/%Y:%H:%M:%S", "%Y%m%dT%H%M%S",
    "%a %b %d %H:%M:%S %Y",
]
EPOCH = datetime(1970, 1, 1)


def micros(d):
    return (d - EPOCH) // timedelta(microseconds=1)


def local(wall, zone):
    """The one instant of a wall clock, -1 for none or two: every offset the zone has near it is tried."""
    info = ZoneInfo(zone)
    near = {(wall + timedelta(hours=h)).replace(tzinfo=timezone.utc).astimezone(info).utcoffset() for h in range(-48, 49)}
    fits = {wall - off for off in near if (wall - off).replace(tzinfo=timezone.utc).astimezone(info).replace(tzinfo=None) == wall}
    return micros(fits.pop()) if len(fits) == 1 else -1


def brute(text, zone):
    if text is None:
        return None
    text = text.strip()
    if re.fullmatch(r"\d{1,18}(\.\d+)?", text):
        whole, _, frac = text.partition(".")
        unit = 1_000_000 if len(whole) <= 11 else 1000 if len(whole) <= 14 else 1
        return int(whole) * unit + int((frac + "000000")[:6]) * unit // 1_000_000
    text = re.sub(r"\[[\w/+-]+\]$", "", text)
    offset = name = None
    if m := re.search(r" ?([+-])(\d\d):?(\d\d)$", text):
        if int(m[2]) > 23 or int(m[3]) > 59:
            return -1
        if re.search(r":\d\d", text):
            offset, text = (1 if m[1] == "+" else -1) * timedelta(hours=int(m[2]), minutes=int(m[3])), text[: m.start()]
        elif re.match(r"\d{8}T\d{6}", text):
            offset, text = (1 if m[1] == "+" else -1) * timedelta(hours=int(m[2]), minutes=int(m[3])), text[: m.start()]
    elif text.endswith("Z"):
        offset, text = timedelta(0), text[:-1]
    elif (m := re.search(r" ([A-Z]{3,5})$", text)) and m[1] not in ("AM", "PM"):
        name, text = m[1], text[: m.start()]
    frac = 0
    if m := re.search(r"(?<=\d)[.,](\d+)$", text):
        if not re.fullmatch(r"\d\d\.\d\d\.\d{4}", text):
            frac, text = int((m[1] + "000000")[:6]), text[: m.start()]
    for f in FORMATS:
        try:
            wall = datetime.strptime(text, f) + timedelta(microseconds=frac)
            break
        except ValueError:
            continue
    else:
        return -1
    if name in ("GMT", "UTC"):
        offset = timedelta(0)
    elif name:
        info = ZoneInfo(zone)
        seen = {t.tzname(): t.utcoffset() for m in (1, 7) for t in [datetime(wall.year, m, 1, tzinfo=info)]}
        if name not in seen:
            return -1
        offset = seen[name]
    return micros(wall - offset) if offset is not None else local(wall, zone)


def check(spark, rows):
    df = spark.createDataFrame([(i, t, z) for i, (t, z) in enumerate(rows)], "i int, t string, z string")
    got = {r["i"]: r["out"] for r in instants.with_instant(df, "t", "z", "out").collect()}
    assert len(got) == len(rows)
    return [(t, z, got[i], brute(t, z)) for i, (t, z) in enumerate(rows) if got[i] != brute(t, z)]


def test_edges(spark):
    zones = ["America/New_York", "Europe/Berlin", "Australia/Sydney", "Asia/Kathmandu", "Etc/UTC", "Australia/Lord_Howe"]
    texts = [
        "2024-03-10 02:30:00", "2024-11-03 01:30:00", "2024-11-03 00:59:59.999999", "2024-03-31 02:00:00", "2024-10-27 02:59:59", "2024-04-07 02:00:00", "2024-10-06 02:30:00", "2024-02-29 12:00:00", "2023-02-29 12:00:00",
        "2024-13-05 10:00:00", "0000-00-00 00:00:00", "03/45/2024 10:00:00", "12/31/2024 12:00:00 AM", "12/31/2024 12:00:00 PM", "12/31/2024 13:00:00 PM", "31.12.2024 23:59:59", "2024/12/31 23:59:59", "1709583820145",
        "1709589476996924", "1709587610.128", "1709586288", "2024-03-05T00:29:23.254410338+00:00", "2024-03-05T00:29:23,5-0330", "2024-03-04T12:24:41-08:00[America/Los_Angeles]", "01/Apr/2024:20:45:20 -0500", "20240305T002921+0000",
        "Fri, 01 Nov 2024 00:59:15 GMT", "2024-03-10 01:35:58 EST", "2024-07-10 01:35:58 EDT", "2024-07-10 01:35:58 XYZ", "yesterday", "", "   ", "-", "25:61:00", None, "Thu Mar  7 17:31:57 2024", " 2024-03-05T00:29:23Z ",
        "2024-03-05T24:00:00Z", "2024-03-05T23:59:60Z", "1900-01-01T00:00:00Z", "9999-12-31T23:59:59Z", "x" * 100_000, "2024-03-05T00:29:23+25:00",
    ]
    wrong = check(spark, [(t, z) for z in zones for t in texts])
    assert not wrong, wrong[:5]


def test_clashing_columns_empty_tables_and_null_zone(spark):
    df = spark.createDataFrame([("2024-03-05 10:00:00", None, "x", 1), ("2024-03-05T10:00:00Z", None, "y", 2)], "t string, z string, out string, __parts int")
    rows = instants.with_instant(df, "t", "z", "out").orderBy("__parts").collect()
    assert [r["out"] for r in rows] == [-1, 1709632800000000]
    assert instants.with_instant(df.limit(0), "t", "z", "out").count() == 0


def test_access_texts_of_the_tables(spark, table):
    e, h = table("line_events"), table("log_hosts")
    rows = table("access_log").join(e.select("event_id", "host_name"), "event_id").join(h, "host_name").select("access_ts", "tz_name").collect()
    wrong = check(spark, [tuple(r) for r in rows])
    assert not wrong, wrong[:5]


def test_cases(spark, table):
    got = instants.unlike_times(table("access_log"), table("dmesg_records"), table("audit_records"), table("line_events"), table("log_hosts"))
    found = {(r["src"], r["event_id"]): r["instant_us"] for r in got.collect()}
    zones = {r["host_name"]: (r["tz_name"], r["clock_mode"]) for r in table("log_hosts").collect()}
    events = {r["event_id"]: r for r in table("line_events").select("event_id", "host_name", F.unix_micros("ts").alias("us")).collect()}
    want = {}
    for i, r in events.items():
        if r["us"] is not None and zones[r["host_name"]][1] == "local":
            want["line", i] = local(EPOCH + timedelta(microseconds=r["us"]), zones[r["host_name"]][0])
    for r in table("access_log").collect():
        t = r["access_ts"]
        if t is not None and not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z", t):
            want["access", r["event_id"]] = brute(t, zones[events[r["event_id"]]["host_name"]][0])
    for r in table("audit_records").collect():
        if r["epoch_sec"] > 10**11:
            m = re.search(r"audit\((\d+)\.(\d+):", r["raw"])
            want["audit", r["event_id"]] = int(m[1]) * 10**6 + int((m[2] + "000000")[:6])
    for r in table("dmesg_records").select("event_id", "raw", "boot_secs", F.unix_micros("boot_time").alias("b")).collect():
        if r["b"] is not None and r["boot_secs"] is not None:
            want["dmesg", r["event_id"]] = r["b"] + round(r["boot_secs"] * 1e6)
        elif m := re.match(r"(?:<\d+>)?\[([A-Z]\w\w [A-Z]\w\w +\d+ [\d:]+ \d{4})\]", r["raw"]):
            want["dmesg", r["event_id"]] = brute(m[1], zones[events[r["event_id"]]["host_name"]][0])
    assert found == want


def test_unknown_zones_and_huge_numbers_cost_only_their_rows(spark):
    hosts = spark.createDataFrame([("a", "Mars/Base", "local"), ("b", "Europe/Berlin", "local"), ("c", "Factory", "local"), ("d", None, "local")], "host_name string, tz_name string, clock_mode string")
    at = "timestamp'2024-03-05 10:00:00'"
    events = spark.createDataFrame([(i, h) for i, h in enumerate("abcd")], "event_id long, host_name string").withColumn("ts", F.expr(at))
    access = spark.createDataFrame([(0, "2024-03-05 10:00:00"), (1, "2024-03-05 10:00:00"), (2, "2024-03-05T10:00:00+01:00"), (3, "1709632800000000000")], "event_id long, access_ts string")
    dmesg = spark.createDataFrame([(0, "", 1e300), (1, "", float("nan")), (2, "", 1.5)], "event_id long, raw string, boot_secs double").withColumn("boot_time", F.expr(at))
    audit = spark.createDataFrame([(0, "type=X msg=audit(1709632800.5:1): a=b", -(2**63)), (1, "type=X", 2**63 - 1), (2, "", None)], "event_id long, raw string, epoch_sec long")
    found = {(r["src"], r["event_id"]): r["instant_us"] for r in instants.unlike_times(access, dmesg, audit, events, hosts).collect()}
    nine, ten = 1709629200000000, 1709632800000000
    assert found == {
        ("access", 0): -1, ("access", 1): nine, ("access", 2): nine, ("access", 3): -1, ("dmesg", 0): -1, ("dmesg", 2): ten + 1500000, ("dmesg", 1): found["dmesg", 1],
        ("audit", 0): ten + 500000, ("audit", 1): -1, ("line", 0): -1, ("line", 1): nine, ("line", 2): -1, ("line", 3): -1,
    }
