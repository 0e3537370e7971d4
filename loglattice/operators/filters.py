"""Filters on lines, and what is passed on of lines that a parser did or did not match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def allowed(line: Column, include: list[str] | tuple[str, ...] = (), exclude: list[str] | tuple[str, ...] = ()) -> Column:
    """Holds any included substring (all lines if none is named) and no excluded one; case counts, '' excludes nothing.

    Only substring tests, so the condition is pushed down to the scan.
    """
    wanted = [F.contains(line, F.lit(s)) for s in include]
    banned = [~F.contains(line, F.lit(s)) for s in exclude if s]
    keep = reduce(Column.__or__, wanted) if wanted else F.lit(True)
    return reduce(Column.__and__, banned, keep)


def output_text(line: Column, json: Column, matched: Column, fmt: str = "json", drop: bool = False) -> Column:
    """What a parser passes on: its JSON (formats json, json-compact or empty) or the line; null where it is dropped."""
    shown = json if fmt in ("", "json", "json-compact") else line
    return F.when(matched, shown).otherwise(F.lit(None) if drop else line)


def content_kind(line: Column) -> Column:
    """Routing by content: access for HTTP methods, sensors, tsv for lines with tabs, else access."""
    has = lambda s: F.contains(line, F.lit(s))
    return F.when(has("GET") | has("POST"), "access").when(has("sensor_"), "sensors").when(has("\t"), "tsv").otherwise("access")


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression; * and ? do not cross a slash."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            out += "[" + pattern[i + 1 : end].replace("\\", "\\\\") + "]"
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += "\\" + pattern[i] if not pattern[i].isalnum() else pattern[i]
        else:
            out += c if c.isalnum() or c in "_/ " else "\\" + c
        i += 1
    return rf"\A{out}\z"


def path_matches(path: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """Whether any pattern matches the base name or the whole path."""
    base = F.regexp_extract(path, r"([^/]*)\z", 1)
    tests = [path.rlike(glob_regex(p)) | base.rlike(glob_regex(p)) for p in patterns]
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def included(path: Column, include: list[str] | tuple[str, ...] = (), exclude: list[str] | tuple[str, ...] = ()) -> Column:
    """Whether a path is included and not excluded. Includes are globs, names (of the whole path or its last part), or

    folders, which end with a slash; folders count only if no glob or name is given. Without includes all paths are.
    """
    folders, globs = [p for p in include if p.endswith("/")], [p for p in include if any(c in p for c in "*?[")]
    names = [p for p in include if p not in folders and p not in globs]
    base = F.regexp_extract(path, r"([^/]*)\z", 1)
    tests = [path_matches(path, globs)] if globs else []
    tests += [path.isin(*names) | base.isin(*names)] if names else []
    tests = tests or [path.startswith(p) for p in folders] or [F.lit(True)]
    return reduce(Column.__or__, tests) & ~path_matches(path, exclude)


def markers(line: Column, texts: dict[str, str]) -> list[Column]:
    """Aggregates by name: whether any line holds a text; false where there are no lines."""
    return [F.coalesce(F.bool_or(F.contains(line, F.lit(text))), F.lit(False)).alias(name) for name, text in texts.items()]


# Alerts on fields of records, by name: the field, how it is compared, and with what.
ALERTS = {
    "http_error": ("status", ">=", 400), "large_response": ("bytes", ">", 10000), "high_temperature": ("temperature", ">", 30.0), "low_humidity": ("humidity", "<", 30.0),
    "high_value": ("value", ">", 100.0), "usb": ("subsystem", "==", "usb"), "kernel_error": ("priority_name", "==", "error"),
}


def alerts(fields: dict[str, Column]) -> Column:
    """The names of the alerts that hold, as an array, for the fields there are; a null field raises none."""
    compare = {">=": Column.__ge__, ">": Column.__gt__, "<": Column.__lt__, "==": Column.__eq__}
    told = [F.when(compare[how](fields[field], F.lit(bound)), F.lit(name)) for name, (field, how, bound) in ALERTS.items() if field in fields]
    return F.array_compact(F.array(*told)) if told else F.array().cast("array<string>")
