"""Delimited rows that fail to parse, apart from the valid ones and with their reasons.

Every column is first nullable text. A strict tokenizer of possessive expressions (no backtracking, no recursion, so
very long lines are safe) splits the line in the JVM; rules then fill an array of errors, and rows are split by
whether it is empty.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.session import pinned

TRIM = r"(?U)\A\s+|\s+\z"
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_FIELD = r"[ \t]*+(?:" + _QUOTED + r'|[^",]*+)'
_STRICT = r"\A(?:," + _FIELD + r")++\z"


def trimmed(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, TRIM, "")


def strict_cells(line: Column) -> Column:
    """The cells of a strict CSV line, quotes undone and blanks before a field dropped; null if the quoting is broken."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r",[ \t]*+(" + _QUOTED + r'|[^",]*+)'), F.lit(1))
    plain = F.transform(raw, lambda x: F.when(x.startswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    return F.when(F.concat(F.lit(","), line).rlike(_STRICT), plain)


def is_status(c: Column) -> Column:
    """Empty, or three ASCII digits from 100 to 599."""
    return (c == "") | c.rlike(r"\A[1-5][0-9]{2}\z")


def is_duration(c: Column) -> Column:
    """Empty, or a finite decimal number not below 0, of ASCII digits; sign and exponent allowed."""
    number = c.rlike(r"\A[+-]?(?:[0-9]++\.?[0-9]*+|\.[0-9]++)(?:[eE][+-]?[0-9]++)?\z")
    value = F.when(number, c.try_cast("double"))
    return (c == "") | F.coalesce((value >= 0) & (value < float("inf")), F.lit(False))


@dataclass(frozen=True)
class RowRules:
    """The header of the files, and a check for some of its columns; checks run in this order."""

    header: tuple[str, ...]
    checks: dict[str, Callable[[Column], Column]] = field(default_factory=dict)


ACCESS = RowRules(("timestamp", "ip", "method", "path", "status", "bytes", "duration"), {"status": is_status, "duration": is_duration})


def checked_rows(df: DataFrame, raw: str, rules: RowRules = ACCESS) -> DataFrame:
    """``df`` without blank, null and header lines, with ``cells`` (array of text) and ``errors`` (array of reasons).

    Reasons are quoting, columns, then the names of failed checks, in that order; broken quoting or a wrong number of
    columns is the only reason of a line, since its cells mean nothing. Columns of ``df`` named cells or errors are
    replaced. An empty table gives an empty one.
    """
    line = trimmed(F.col(raw))
    rows = pinned(df.drop("cells", "errors"), "__line", line).where((F.col("__line") != "") & (F.col("__line") != ",".join(rules.header)))
    rows = pinned(rows, "cells", strict_cells(F.col("__line"))).drop("__line")
    shaped = F.size("cells") == len(rules.header)
    cell = lambda name: trimmed(F.get("cells", F.lit(rules.header.index(name))))
    failed = [F.when(~check(cell(name)), F.lit(name)) for name, check in rules.checks.items()]
    errors = F.when(F.col("cells").isNull(), F.array(F.lit("quoting"))).when(~shaped, F.array(F.lit("columns"))).otherwise(F.array_compact(F.array(*failed)))
    return pinned(rows, "errors", errors)


def split_rows(df: DataFrame, raw: str, rules: RowRules = ACCESS) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): valid rows have a nullable text column for each name of the header, rejected ones ``reason``."""
    rows = checked_rows(df, raw, rules)
    keep = [c for c in df.columns if c not in ("cells", "errors")]
    taken = {c.lower() for c in keep}
    names = [n if n.lower() not in taken else f"{n}_cell" for n in rules.header]
    value = lambda i: F.nullif(trimmed(F.get("cells", F.lit(i))), F.lit(""))
    valid = rows.where(F.size("errors") == 0).select(*keep, *(value(i).alias(n) for i, n in enumerate(names)))
    bad = rows.where(F.size("errors") > 0).select(*[c for c in keep if c != "reason"], F.get("errors", F.lit(0)).alias("reason"))
    return valid, bad
