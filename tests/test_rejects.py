import csv
import math
import re

from loglattice.operators import rejects


def brute(raw):
    """The first reason, '' for a valid line, None for no case; strict quoting is read character by character."""
    if raw is None:
        return None
    line = raw.strip()
    if not line or line == ",".join(rejects.ACCESS.header):
        return None
    cells, i = [], 0
    while True:
        while i < len(line) and line[i] in " \t":
            i += 1
        cell = ""
        if i < len(line) and line[i] == '"':
            i += 1
            while True:
                if i >= len(line):
                    return "quoting"
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        cell, i = cell + '"', i + 2
                        continue
                    i += 1
                    break
                cell, i = cell + line[i], i + 1
            if i < len(line) and line[i] != ",":
                return "quoting"
        else:
            while i < len(line) and line[i] != ",":
                if line[i] == '"':
                    return "quoting"
                cell, i = cell + line[i], i + 1
        cells.append(cell.strip())
        if i >= len(line):
            break
        i += 1
    if len(cells) != 7:
        return "columns"
    if cells[4] and not re.fullmatch(r"[1-5][0-9]{2}", cells[4]):
        return "status"
    d = cells[6]
    if d and not (re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", d) and 0 <= float(d) < math.inf):
        return "duration"
    return ""


CASES = [
    None, "", " \t ", "timestamp,ip,method,path,status,bytes,duration", " timestamp,ip,method,path,status,bytes,duration\r", "a,b,c,d,200,1,0.1", "a,b,c,d,,1,", '"a","b","c","d","200","1","0.1"', '"a", "b" ,c,d,200,1,1',
    'a,b,c,"d ""x"" , y",200,1,1', 'a,b,c,d"x",200,1,1', 'a,b,c,"d,200,1,1', 'a,b,c,"d"x,200,1,1', "a,b,c,d,99,1,1", "a,b,c,d,600,1,1", "a,b,c,d, 404 ,1, 2.5 ", "a,b,c,d,２００,1,1", "a,b,c,d,200,1,-0", "a,b,c,d,200,1,-0.1",
    "a,b,c,d,200,1,1e400", "a,b,c,d,200,1,NaN", "a,b,c,d,200,1,inf", "a,b,c,d,200,1,1d", "a,b,c,d,200,1,0x1p3", "a,b,c,d,200,1,٣.٥", "a,b,c,d,200,1,.5", "a,b,c,d,200,1,5.", "a,b,c,d,200,1,.", "a,b,c,d,OK,1,fast",
    ",,,,,,", ",,,,,", "a,b,c,d,200,1,1,", '""', '"', '""""""', 'a,b,c,"' + "x,y" * 50_000 + '",200,1,1', "a" * 200_000, '"' + '""' * 60_000 + '",b,c,d,200,1,1', "a,b,c,d,200,1,+1E-2", '"a,b,c,d,200,1,1"',
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, c, "old") for i, c in enumerate(CASES)], "raw_id int, raw string, reason string")
    valid, bad = rejects.split_rows(df, "raw")
    want = {i: brute(c) for i, c in enumerate(CASES)}
    assert {r["raw_id"]: r["reason"] for r in bad.collect()} == {i: w for i, w in want.items() if w}
    assert {r["raw_id"] for r in valid.collect()} == {i for i, w in want.items() if w == ""}


def test_valid_cells_are_those_of_a_csv_reader(spark):
    lines = ['"2024","1.2.3.4","GET","/a?x=""1"", 2","200","7","0.5"', "t, i, m, p, 200, , "]
    df = spark.createDataFrame([(i, x, 5) for i, x in enumerate(lines)], "raw_id int, raw string, path int")
    valid, _ = rejects.split_rows(df, "raw")
    rows = {r["raw_id"]: r for r in valid.collect()}
    want = next(csv.reader([lines[0]]))
    assert [rows[0][n] for n in ("timestamp", "ip", "method", "path_cell", "status", "bytes", "duration")] == want
    assert rows[1]["bytes"] is None and rows[1]["duration"] is None and rows[1]["path"] == 5
    assert rejects.split_rows(df.limit(0), "raw")[1].count() == 0


def test_whole_table(spark, table):
    rows = table("raw_lines").select("raw_id", "raw").collect()
    want = {r["raw_id"]: w for r in rows if (w := brute(r["raw"]))}
    assert {r["raw_id"]: r["reason"] for r in rejects.split_rows(table("raw_lines"), "raw")[1].collect()} == want
