"""Delimited log lines as typed fields, with state (header, line number) as columns of each file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.functions.json import escaped, number, quoted
from loglattice.session import pinned

# Texts that are booleans, and the time layouts tried, in order.
TRUE, FALSE = ("true", "yes", "1", "on"), ("false", "no", "0", "off")
TIMES = (
    (r"\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:\d\d)\z", None),
    (r"\A\d{4}-\d\d-\d\d \d\d?:\d\d:\d\d(?:[.,]\d+)?\z", "yyyy-MM-dd H:mm:ss"),
    (r"\A\d{4}-\d\d-\d\dT\d\d?:\d\d:\d\d(?:[.,]\d+)?\z", "yyyy-MM-dd'T'H:mm:ss"),
    (r"\A\d{4}/\d\d/\d\d \d\d?:\d\d:\d\d(?:[.,]\d+)?\z", "yyyy/MM/dd H:mm:ss"),
    (r"\A\d\d/\d\d/\d{4} \d\d?:\d\d:\d\d(?:[.,]\d+)?\z", "MM/dd/yyyy H:mm:ss"),
    (r"\A\d{4}-\d\d-\d\d\z", "yyyy-MM-dd"),
    (r"\A\d\d/\d\d/\d{4}\z", "MM/dd/yyyy"),
)
_SPACES = r"(?U)\A\s+|\s+\z"


@dataclass(frozen=True)
class CsvOptions:
    delimiter: str = ","
    has_headers: bool = False
    headers: tuple[str, ...] = ()
    detect_types: bool = False
    strict_bool: bool = False
    timestamp_field: str = ""
    timestamp_format: str = ""


def cells(line: Column, delimiter: str = ",") -> Column:
    """The cells of one line, quotes undone and blanks before a cell dropped; null if the quoting is broken."""
    d = "\\" + delimiter if not delimiter.isspace() and not delimiter.isalnum() else delimiter.replace("\t", "\\t")
    quoted = r'"[^"]*+(?:""[^"]*+)*+"'
    piece = rf'(?:{quoted}|[^"{d}]*+)'
    whole = F.concat(F.lit(delimiter), line)
    raw = F.regexp_extract_all(whole, F.lit(rf"{d}[ \t]*+({piece})"), F.lit(1))
    plain = F.transform(raw, lambda x: F.when(x.startswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    return F.when(whole.rlike(rf"\A(?:{d}[ \t]*+{piece})++\z"), plain)


def as_time(value: Column) -> Column:
    """The instant of a text of one of the known layouts, taken as UTC without zone; null for others."""
    out = F.lit(None).cast("timestamp")
    plain = F.regexp_replace(value, r"[.,]\d+\z", "")
    micro = F.rpad(F.substring(F.regexp_extract(value, r"[.,](\d+)", 1), 1, 6), 6, "0").cast("long")
    for pattern, layout in reversed(TIMES):
        if layout is None:
            t = F.try_to_timestamp(F.regexp_replace(value, ",", "."))
        else:
            t = F.timestamp_micros(F.unix_micros(F.try_to_timestamp(plain, F.lit(layout))) + micro)
        out = F.coalesce(F.when(value.rlike(pattern), t), out) if layout is None else F.when(value.rlike(pattern), t).otherwise(out)
    return out


def kind_of(value: Column, strict_bool: bool = False) -> Column:
    """empty, bool, int, float, time or string. 1 and 0 are booleans unless ``strict_bool``."""
    v = F.regexp_replace(value, _SPACES, "")
    low = F.lower(v)
    truth = [w for w in (*TRUE, *FALSE) if not (strict_bool and w in "10")]
    whole = v.rlike(r"\A[+-]?\d+\z") & v.try_cast("bigint").isNotNull()
    decimal = v.rlike(r"\A[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z")
    number = F.when(decimal, v.try_cast("double"))
    finite = number.isNotNull() & (F.abs(number) < float("inf"))
    named = low.rlike(r"\A[+-]?(?:inf|infinity)\z|\Anan\z") | low.rlike(r"\A[+-]?0x(?:[0-9a-f]+\.?[0-9a-f]*|\.[0-9a-f]+)p[+-]?\d+\z")
    return F.when(v == "", "empty").when(low.isin(*truth), "bool").when(whole, "int").when(finite | named, "float").when(as_time(v).isNotNull(), "time").otherwise("string")


def parsed(df: DataFrame, file_id: str, order: str, line: str, options: CsvOptions = CsvOptions(), block_lines: int = 100_000) -> DataFrame:
    """(file_id, ord, line_number, raw, names, cells, error, known) of each row that is no header; known: all names of its file.

    Blank lines count for nothing. Line numbers count headers and malformed lines. The header is the first counted line
    of a file if it has one and is well formed; else names are the given ones, or field_1, field_2 and so on, as many as
    the first well-formed row has cells. Cells beyond the names are extra_field_N. error is set, and cells null, for
    broken quoting. ``order`` is an integer. Lines are numbered in blocks of a file, and blocks by their counts, so no
    file passes through one task.
    """
    rows = df.select(F.col(file_id).alias("file_id"), F.col(order).cast("long").alias("ord"), F.regexp_replace(F.col(line), _SPACES, "").alias("raw")).where(F.col("raw") != "")
    rows = pinned(rows, "cells", cells(F.col("raw"), options.delimiter)).withColumn("block", F.call_function("div", F.col("ord"), F.lit(block_lines)))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("file_id", "block").orderBy("ord")))
    first, shaped = F.min_by("cells", "ord").alias("head"), F.min_by(F.size("cells"), F.when(F.col("cells").isNotNull(), F.col("ord"))).alias("n_cells")
    blocks = rows.groupBy("file_id", "block").agg(F.count(F.lit(1)).alias("n"), first, shaped, F.max(F.when(F.col("cells").isNotNull(), True)).alias("ok"))
    by_file = Window.partitionBy("file_id").orderBy("block")
    whole = by_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.first("head").over(whole) if options.has_headers else F.lit(None).cast("array<string>")
    before = F.coalesce(F.sum("n").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    made = F.first(F.when(F.col("ok"), F.col("n_cells")), True).over(whole)
    blocks = blocks.select(F.col("file_id").alias("b_file"), F.col("block").alias("b_block"), before.alias("before"), head.alias("head"), made.alias("n_cells"))
    rows = rows.join(blocks, F.col("file_id").eqNullSafe(F.col("b_file")) & (F.col("block") == F.col("b_block"))).withColumn("line_number", (F.col("at") + F.col("before")).cast("int"))
    numbered = F.transform(F.sequence(F.lit(1), F.col("n_cells")), lambda i: F.concat(F.lit("field_"), i.cast("string")))
    given = F.array(*map(F.lit, options.headers)) if options.headers else F.lit(None).cast("array<string>")
    rows = rows.withColumn("known", F.coalesce("head", given, numbered)).where(~((F.col("line_number") == 1) & F.col("head").isNotNull()))
    names = F.transform("cells", lambda c, i: F.coalesce(F.get("known", i), F.concat(F.lit("extra_field_"), (i + 1).cast("string"))))
    error = F.when(F.col("cells").isNull(), F.concat(F.lit("failed to parse CSV line "), F.col("line_number").cast("string")))
    return rows.select("file_id", "ord", "line_number", "raw", names.alias("names"), "cells", error.alias("error"), "known")


def last_cells() -> Column:
    """An array of (key, value) of the cells of a parsed row; of equal names the last counts."""
    cell = F.arrays_zip(F.col("names").alias("key"), F.col("cells").alias("value"))
    return F.filter(cell, lambda c, i: ~F.exists(F.slice(cell, i + 2, F.size(cell)), lambda later: later["key"] == c["key"]))


def as_maps(rows: DataFrame) -> DataFrame:
    """(file_id, line_number, raw, fields): well-formed rows with a map from names to cells; missing cells are not in it."""
    return rows.where(F.col("error").isNull()).select("file_id", "line_number", "raw", F.map_from_entries(last_cells()).alias("fields"))


def to_json(rows: DataFrame, options: CsvOptions = CsvOptions(), parsed_at: Column | None = None) -> DataFrame:
    """(file_id, line_number, json): well-formed rows as JSON, names in order, values with their detected types.

    Texts that mean an infinite number or none are strings, since JSON has no such numbers. ``parsed_at``: a time to add.
    """

    def value(v: Column) -> Column:
        if not options.detect_types:
            return quoted(v)
        kind, plain = kind_of(v, options.strict_bool), F.regexp_replace(v, _SPACES, "")
        real = plain.try_cast("double")
        time = F.date_format(as_time(plain), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        whole = F.when(kind == "bool", F.lower(plain).isin(*TRUE).cast("string")).when(kind == "int", plain.try_cast("bigint").cast("string"))
        return F.coalesce(whole.when((kind == "float") & (F.abs(real) < float("inf")), number(real)).when(kind == "time", quoted(time)), quoted(v))

    entries = F.transform(F.array_sort(last_cells()), lambda c: F.concat(quoted(c["key"]), F.lit(":"), value(c["value"])))
    at = [] if parsed_at is None else [F.lit(',"parsed_at":'), quoted(F.date_format(parsed_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))]
    json = F.concat(F.lit('{"raw":'), quoted(F.col("raw")), F.lit(',"fields":{'), F.array_join(entries, ","), F.lit('},"line_number":'), F.col("line_number").cast("string"), *at, F.lit("}"))
    return rows.where(F.col("error").isNull()).select("file_id", "line_number", escaped(json).alias("json"))


def headers(rows: DataFrame) -> DataFrame:
    """(file_id, headers): the names in force in each file of parsed rows."""
    return rows.groupBy("file_id").agg(F.min_by("known", "line_number").alias("headers"))


def fields(rows: DataFrame, options: CsvOptions = CsvOptions()) -> DataFrame:
    """(file_id, line_number, key, value, kind) of each cell; of equal names in a row the last counts.

    With a timestamp field and format, another key <field>_parsed holds its time in ISO form where it can be read and
    has not been detected as a time already.
    """
    last = last_cells()
    out = rows.where(F.col("error").isNull()).select("file_id", "line_number", F.explode(last).alias("c")).select("file_id", "line_number", "c.key", "c.value")
    kind = kind_of(F.col("value"), options.strict_bool) if options.detect_types else F.lit("string")
    out = out.withColumn("kind", kind)
    if options.timestamp_field and options.timestamp_format:
        at = F.try_to_timestamp("value", F.lit(options.timestamp_format))
        more = out.where((F.col("key") == options.timestamp_field) & (F.col("kind") == "string") & at.isNotNull())
        more = more.select("file_id", "line_number", F.lit(options.timestamp_field + "_parsed").alias("key"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("value"), F.lit("time").alias("kind"))
        out = out.unionByName(more)
    return out


def string_field(value: Column, kind: Column) -> Column:
    """A cell as text: booleans as true or false, integers in plain digits, all else as written; '' where there is none."""
    v = F.regexp_replace(value, _SPACES, "")
    return F.coalesce(F.when(kind == "bool", F.lower(v).isin(*TRUE).cast("string")).when(kind == "int", v.try_cast("bigint").cast("string")).otherwise(value), F.lit(""))


def int_field(value: Column, kind: Column) -> Column:
    """A cell as integer: floats are cut off, texts must be integers; null for booleans, times and other texts."""
    v = F.regexp_replace(value, _SPACES, "")
    return F.when(kind == "int", v.try_cast("bigint")).when(kind == "float", v.try_cast("double").try_cast("bigint")).when((kind == "string") & value.rlike(r"\A[+-]?\d+\z"), value.try_cast("bigint"))


def float_field(value: Column, kind: Column) -> Column:
    """A cell as double; null for booleans, times and texts that are no numbers."""
    v = F.regexp_replace(value, _SPACES, "")
    number = value.rlike(r"\A[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z")
    return F.when(kind.isin("int", "float"), v.try_cast("double")).when((kind == "string") & number, value.try_cast("double"))
