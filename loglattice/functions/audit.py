"""Linux audit records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.functions.json import escaped
from loglattice.session import fresh, pinned

# Fixed value: the layout of an audit record, with or without stamp: type, seconds, fraction, serial, body.
RECORD = r"(?s)\Atype=([A-Z_]+)[ \t\n\f\r]+(?:msg=audit\((\d+)\.(\d+):(\d+)\):[ \t\n\f\r]*([^\n]*)|([^\n]*))\z"
#: A token: escapes, quoted stretches (an unclosed one runs to the end) and other characters but blanks. Possessive, so
#: that long tokens need no stack.
TOKEN = r"""(?s)((?:[^ "'\\]++|\\(?:.|$)|"(?:[^"\\]++|\\(?:.|$))*+(?:"|$)|'(?:[^'\\]++|\\(?:.|$))*+(?:'|$))++)"""
_SPACES = r"(?U)\A\s+|\s+\z"


def _unquoted(v: Column) -> Column:
    inner = v.substr(F.lit(2), F.length(v) - 2)
    return F.when((F.length(v) >= 2) & ((v.startswith('"') & v.endswith('"')) | (v.startswith("'") & v.endswith("'"))), inner).otherwise(v)


def pairs(body: Column) -> Column:
    """An array of (key, value) in order: tokens with = after the first character; quotes and escapes undone."""
    tokens = F.transform(F.regexp_extract_all(body, F.lit(TOKEN), F.lit(1)), lambda t: F.regexp_replace(t, r"(?s)\\(.|$)", "$1"))
    with_key = F.filter(tokens, lambda t: F.instr(t, "=") > 1)

    def pair(t: Column) -> Column:
        at = F.instr(t, "=")
        value = F.regexp_replace(t.substr(at + 1, F.length(t)), _SPACES, "")
        return F.struct(t.substr(F.lit(1), at - 1).alias("key"), F.replace(_unquoted(value), F.lit('\\"'), F.lit('"')).alias("value"))

    return F.transform(with_key, pair)


def last_of_each(entries: Column) -> Column:
    """The entries without those whose key comes again later."""
    later = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    keys = entries["key"]
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), entries).otherwise(later)


def parts(line: Column) -> Column:
    """An array of "", type, seconds, fraction, serial and body, from one pass over the line; null for other lines."""
    text = F.regexp_replace(line, _SPACES, "")
    return F.when(text.rlike(RECORD), F.split(F.regexp_replace(text, RECORD, "\u0001$1\u0001$2\u0001$3\u0001$4\u0001$5$6"), "\u0001", 6))


def _number(c: Column) -> Column:
    return F.coalesce(c.try_cast("long"), F.lit(0).cast("long"))


def header(found: Column) -> dict[str, Column]:
    """type, epoch_sec, epoch_nsec and serial of ``parts``."""
    return {"type": found[1], "epoch_sec": _number(found[2]), "epoch_nsec": F.when(found[3] == "", F.lit(0).cast("long")).otherwise(_number(F.rpad(found[3], 9, "0"))), "serial": _number(found[4])}


def parse(line: Column, found: Column | None = None) -> Column:
    """A struct raw, type, epoch_sec, epoch_nsec, serial, fields (map); null for lines that are no audit record.

    A record without stamp has zeros for time and serial. The fraction is padded or cut to nanoseconds; of equal keys
    the last counts. Numbers that overflow are 0. ``found``: ``parts`` of the line, where they have been computed.
    """
    got = parts(line) if found is None else found
    fields = F.map_from_entries(last_of_each(pairs(got[5])))
    return F.when(got.isNotNull(), F.struct(F.regexp_replace(line, _SPACES, "").alias("raw"), *(c.alias(n) for n, c in header(got).items()), fields.alias("fields")))


def to_json(record: Column) -> Column:
    """The record as JSON: zero numbers and an empty map left out, map keys in order."""
    number = lambda n: F.nullif(record[n], F.lit(0).cast("long")).alias(n)
    ordered = F.map_from_entries(F.array_sort(F.map_entries(record["fields"])))
    shown = F.when(F.size(record["fields"]) > 0, ordered)
    return escaped(F.to_json(F.struct(record["raw"].alias("raw"), record["type"].alias("type"), number("epoch_sec"), number("epoch_nsec"), number("serial"), shown.alias("fields"))))


def parsed(df: DataFrame, line: str, out: str = "audit") -> DataFrame:
    """``df`` with the parsed record of its lines in ``out``; each step is computed once a row."""
    p = fresh([*df.columns, out], "parts")[0]
    return pinned(pinned(df, p, parts(F.col(line))), out, parse(F.col(line), F.col(p))).drop(p)


def headers(df: DataFrame, line: str, out: str = "audit") -> DataFrame:
    """Like ``parsed``, without raw and fields."""
    p = fresh([*df.columns, out], "parts")[0]
    found = F.col(p)
    return pinned(df, p, parts(F.col(line))).withColumn(out, F.when(found.isNotNull(), F.struct(*(c.alias(n) for n, c in header(found).items())))).drop(p)
