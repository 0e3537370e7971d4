import random
import re
from datetime import datetime

from pyspark.sql import functions as F

from loglattice.functions import audit, csv, dmesg
from loglattice.operators import filters, fingerprints


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("r")).first()["r"]


def test_dmesg(spark):
    cases = {
        "[    0.000000] Linux version 5.4.0-74-generic": (0.0, 0, 0, "kernel", "Linux version 5.4.0-74-generic"), "[12345.678901] usb 1-1: new high-speed USB device number 2 using ehci-pci": (12345.678901, 0, 0, "usb", None),
        "<6>[    1.234567] kernel: CPU0: Intel(R) Core(TM) i7-8565U CPU @ 1.80GHz": (1.234567, 6, 0, "kernel", None), "[  100.500000] net eth0: link up, 1000Mbps, full-duplex": (100.5, 0, 0, "net", None),
        "Some random log message without timestamp": (0.0, 0, 0, "", "Some random log message without timestamp"), "<6>[   20.000000] systemd[1]: Started Load Kernel Modules.": (20.0, 6, 0, "systemd", None),
        "[  100.500000] docker0: port 1(veth123abc) entered blocking state": (100.5, 0, 0, "docker0", None), "[    0.000000] Command line: BOOT_IMAGE=/boot/vmlinuz root=UUID=abc123": (0.0, 0, 0, "Command", None),
        "<134>[1] USB reset": (1.0, 6, 16, "usb", "USB reset"), "[2] the docker thing": (2.0, 0, 0, "docker", "the docker thing"), "<99999999999999999999>[1.5] x": (1.5, 0, 0, "", "x"), "[1] a: b\nc": (0.0, 0, 0, "", "[1] a: b\nc"),
    }
    for line, (ts, prio, fac, sub, msg) in cases.items():
        r = one(spark, f"  {line}\t", dmesg.parse)
        assert (r["timestamp"], r["priority"], r["facility"], r["subsystem"]) == (ts, prio, fac, sub), line
        assert msg is None or r["message"] == msg
    assert one(spark, " ", dmesg.parse) is None and one(spark, None, dmesg.parse) is None
    at = one(spark, "[  100.500000] x", lambda c: dmesg.parse(c, F.lit(datetime(2023, 12, 1, 10)))["absolute_time"])
    assert at == datetime(2023, 12, 1, 10, 1, 40, 500000)
    names = spark.range(1).select(dmesg.priority_name(F.lit(3)), dmesg.priority_name(F.lit(99)), dmesg.facility_name(F.lit(23)), dmesg.facility_name(F.lit(16)), dmesg.facility_name(F.lit(99))).first()
    assert tuple(names) == ("error", "unknown", "local7", "local0", "unknown")
    assert one(spark, "<6>[1.5] usb: x", lambda c: dmesg.to_json(dmesg.parse(c))) == r'{"raw":"\u003c6\u003e[1.5] usb: x","timestamp":1.5,"priority":6,"subsystem":"usb","message":"usb: x"}'


def tokens(s):
    """Tokens read character by character."""
    out, cur, quote, i = [], "", "", 0
    while i < len(s):
        c = s[i]
        if c == "\\":
            cur += s[i + 1 : i + 2]
            i += 2
            continue
        if c in "\"'" and (not quote or quote == c):
            quote = "" if quote else c
            cur += c
        elif c == " " and not quote:
            if cur:
                out.append(cur)
            cur = ""
        else:
            cur += c
        i += 1
    return out + ([cur] if cur else [])


def fields(s):
    out = {}
    for t in tokens(s):
        if t.find("=") > 0:
            k, _, v = t.partition("=")
            v = v.strip()
            if len(v) >= 2 and v[0] == v[-1] and v[0] in "\"'":
                v = v[1:-1]
            out[k] = v.replace('\\"', '"')
    return out


def test_audit(spark):
    r = one(spark, "type=PROCTITLE msg=audit(1700000000.001:123): proctitle=2F62696E", audit.parse)
    assert (r["type"], r["epoch_sec"], r["epoch_nsec"], r["serial"], r["fields"]) == ("PROCTITLE", 1700000000, 1000000, 123, {"proctitle": "2F62696E"})
    r = one(spark, r'type=FOO a=1 a=2 b="x y" c=\"q\" =bad noeq', audit.parse)
    assert (r["epoch_sec"], r["serial"], r["fields"]) == (0, 0, {"a": "2", "b": "x y", "c": "q"})
    assert one(spark, "not an audit line", audit.parse) is None and one(spark, None, audit.parse) is None and one(spark, "", audit.parse) is None
    assert one(spark, "type=A msg=audit(1.1234567899:0): k=v", audit.parse)["epoch_nsec"] == 123456789
    js = one(spark, "type=B b=<1> a=&", lambda c: audit.to_json(audit.parse(c)))
    assert js == '{"raw":"type=B b=\\u003c1\\u003e a=\\u0026","type":"B","fields":{"a":"\\u0026","b":"\\u003c1\\u003e"}}'
    rng = random.Random(1)
    rows = [(i, "type=X " + "".join(rng.choice("ab= \"'\\") for _ in range(rng.randint(0, 18)))) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, x string")
    for i, got in df.select("i", audit.parse(F.col("x")).alias("r")).select("i", "r.fields").collect():
        body = re.match(r"type=X\s+(.*)", rows[i][1].strip())
        if body:
            assert got == fields(body[1]), rows[i]


def test_csv(spark):
    lines = ["timestamp,level,message,count", "2023-12-01 10:00:00,INFO,Test message,42", "", '"a, b",x', 'bad"quote,1', " x, y ,z,1,more"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)] + [("g", 0, 'broken"'), ("g", 1, "p,q")], "file string, no int, line string")
    o = csv.CsvOptions(has_headers=True, detect_types=True)
    rows = csv.parsed(df, "file", "no", "line", o, block_lines=2)
    assert [(r["file_id"], r["line_number"]) for r in rows.where("error is not null").orderBy("file_id").collect()] == [("f", 4), ("g", 1)]
    got = {(r["file_id"], r["line_number"], r["key"]): (r["value"], r["kind"]) for r in csv.fields(rows, o).collect()}
    assert got["f", 2, "timestamp"] == ("2023-12-01 10:00:00", "time") and got["f", 2, "count"] == ("42", "int") and got["f", 3, "timestamp"] == ("a, b", "string")
    assert got["f", 5, "extra_field_5"] == ("more", "string") and got["f", 5, "level"] == ("y ", "string") and got["g", 2, "field_1"] == ("p", "string")
    plain = csv.CsvOptions(timestamp_field="field_1", timestamp_format="yyyy-MM-dd HH:mm:ss")
    out = csv.fields(csv.parsed(df.where("no = 1 and file = 'f'"), "file", "no", "line", plain), plain).where("key = 'field_1_parsed'").first()
    assert out["value"] == "2023-12-01T10:00:00Z"
    for d in ",;\t|":
        assert one(spark, f"a{d}b{d}c", lambda c, d=d: csv.cells(c, d)) == ["a", "b", "c"]
    assert one(spark, '"hello, world","normal field","another, quoted, field"', csv.cells) == ["hello, world", "normal field", "another, quoted, field"]
    assert one(spark, '"unclosed quote', csv.cells) is None
    assert csv.fields(csv.parsed(df.limit(0), "file", "no", "line", o), o).count() == 0


def test_types_and_accessors(spark):
    kinds = {
        "hello": "string", "123": "int", "45.67": "float", "true": "bool", "Off": "bool", "": "empty", "1": "bool", "0": "bool", "-7": "int", "9223372036854775808": "float", "1e400": "string", "1d": "string", "inf": "float", "0x1p3": "float",
        "2023-12-01": "time", "12/31/2023": "time", "2023-12-01T10:30:45Z": "time", "2023-12-01T10:30:45.5+02:00": "time", "2023/12/01 10:30:45": "time", "2023-13-01": "string", "NaN": "float",
    }
    df = spark.createDataFrame(list(kinds.items()), "x string, want string")
    assert [tuple(r) for r in df.where(csv.kind_of(F.col("x")) != F.col("want")).collect()] == []
    assert one(spark, "1", lambda c: csv.kind_of(c, strict_bool=True)) == "int"
    rows = [("12", "int", 12, 12.0), ("1.9", "float", 1, 1.9), ("1", "bool", None, None), ("7", "string", 7, 7.0), ("x", "string", None, None)]
    df = spark.createDataFrame(rows, "v string, k string, i long, f double")
    assert df.where(~csv.int_field(F.col("v"), F.col("k")).eqNullSafe(F.col("i")) | ~csv.float_field(F.col("v"), F.col("k")).eqNullSafe(F.col("f"))).count() == 0


def test_filters(spark):
    df = spark.createDataFrame([(x,) for x in ("noise", "keep A", "keep and drop", "drop only", "keep B", None)], "line string")
    assert [r[0] for r in df.where(filters.allowed(F.col("line"), ["keep"], ["drop", ""])).collect()] == ["keep A", "keep B"]
    assert df.where(filters.allowed(F.col("line"))).count() == 6
    paths = spark.createDataFrame([("/a/b.log",), ("/a/c/b.log",), ("/a/b.txt",)], "p string")
    assert paths.where(filters.path_matches(F.col("p"), ["/a/*.log"])).count() == 1 and paths.where(filters.path_matches(F.col("p"), ["[bc].t?t"])).count() == 1
    assert not paths.where(filters.path_matches(F.col("p"), [])).count()


def test_fingerprints(spark):
    import hashlib

    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert one(spark, "a<END>b<END>c<END>", lambda c: fingerprints.separator_checksum(c, "<END>", 2)) == sha(b"a<END>b<END>")
    assert one(spark, "x<END>y", lambda c: fingerprints.separator_checksum(c, "<END>", 2)) is None
    assert one(spark, "small", lambda c: fingerprints.checksum(c, 100)) is None
    assert one(spark, "große", lambda c: fingerprints.checksum(c, 5)) == sha("große".encode()[:5])
    assert one(spark, "x", lambda c: fingerprints.checksum(c, 0)) == sha(b"x") and one(spark, "", lambda c: fingerprints.file_id(c, F.lit("checksum"), 1, "\n")) is None


def test_dmesg_numbers_that_overflow(spark):
    r = one(spark, "<99999999999>[1.0] x", dmesg.parse)
    assert (r["priority"], r["facility"], r["timestamp"], r["message"]) == (0, 0, 1.0, "x")
    r = one(spark, "[99999999999999999999.0] x", lambda c: dmesg.parse(c, F.lit(datetime(2023, 12, 1, 10))))
    assert r["absolute_time"] is None and r["timestamp"] == 1e20 and r["message"] == "x"
    r = one(spark, "<" + "9" * 40 + ">[" + "9" * 400 + "] x", lambda c: dmesg.parse(c, F.lit(datetime(2023, 12, 1, 10))))
    assert r["absolute_time"] is None and r["priority"] == 0


def test_csv_records_as_json_and_maps(spark):
    lines = [("f", 1, "a,b,t"), ("f", 2, ' yes ,1e2,2024-03-05 10:00:00'), ("f", 3, '"x<&>""y",,inf,7'), ("f", 4, 'broken"'), ("f", 5, "0")]
    df = spark.createDataFrame(lines, "f string, n int, line string")
    o = csv.CsvOptions(has_headers=True, detect_types=True)
    rows = csv.parsed(df, "f", "n", "line", o)
    got = {r["line_number"]: r["json"] for r in csv.to_json(rows, o).collect()}
    esc = lambda t: t.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
    assert got == {
        2: '{"raw":"yes ,1e2,2024-03-05 10:00:00","fields":{"a":true,"b":100,"t":"2024-03-05T10:00:00.000000Z"},"line_number":2}',
        3: esc('{"raw":"\\"x<&>\\"\\"y\\",,inf,7","fields":{"a":"x<&>\\"y","b":"","extra_field_4":7,"t":"inf"},"line_number":3}'), 5: '{"raw":"0","fields":{"a":false},"line_number":5}',
    }
    maps = {r["line_number"]: r["fields"] for r in csv.as_maps(rows).collect()}
    assert maps[5] == {"a": "0"} and maps[3]["extra_field_4"] == "7"
    assert csv.headers(rows).first()["headers"] == ["a", "b", "t"] and csv.to_json(rows.limit(0), o).count() == 0
    values = {(r["line_number"], r["key"]): r["v"] for r in csv.fields(rows, o).select("line_number", "key", csv.string_field(F.col("value"), F.col("kind")).alias("v")).collect()}
    assert values[2, "a"] == "true" and values[3, "extra_field_4"] == "7" and values[3, "b"] == ""


def test_dmesg_json(spark):
    boot = lambda c: dmesg.to_json(dmesg.parse(c, F.lit(datetime(2023, 12, 1, 10))))
    assert one(spark, "[12.000000] x", boot) == '{"raw":"[12.000000] x","timestamp":12,"subsystem":"","message":"x","absolute_time":"2023-12-01T10:00:12Z"}'
    assert one(spark, "<30>[12345678.250000] a: x", boot).endswith('"timestamp":12345678.25,"facility":3,"priority":6,"subsystem":"a","message":"a: x","absolute_time":"2024-04-22T07:21:18.25Z"}')
    assert one(spark, "no stamp", boot) == '{"raw":"no stamp","timestamp":0,"subsystem":"","message":"no stamp"}'
