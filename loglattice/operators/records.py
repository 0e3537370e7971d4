"""Separator-delimited records of file contents, with byte offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.session import pinned


def chunks(content: Column, separator: str) -> Column:
    """All pieces of a text between separators; the last one is the incomplete rest (maybe empty)."""
    if not separator:
        raise ValueError("the separator must not be empty")
    return F.split(content, "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)


def records(files: DataFrame, file_id: str, content: str, separator: str = "\n", blank: bool = False, rest: bool = False) -> DataFrame:
    """(file_id, idx, line): the complete records of each file, in order of idx from 0.

    ``blank``: keep records without content (as multiline grouping needs them); ``rest``: also give what follows the
    last separator, if it is not empty. A null content has no records. Nothing is shuffled.
    """
    rows = pinned(files.select(F.col(file_id).alias("file_id"), F.col(content).alias("__text")), "__all", chunks(F.col("__text"), separator))
    whole = F.slice("__all", F.lit(1), F.size("__all") - 1)
    if rest:
        whole = F.when(F.element_at("__all", -1) != "", F.col("__all")).otherwise(whole)
    rows = rows.select("file_id", F.posexplode(whole).alias("idx", "line"))
    return rows if blank else rows.where(F.col("line") != "")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda x, y: x + y)


def records_with_offsets(files: DataFrame, file_id: str, content: str, separator: str = "\n") -> DataFrame:
    """(file_id, idx, line, start_pos, end_pos): as ``records`` with blank ones, and the bytes of each with its separator.

    Sums run within the row of a file, in two steps: over groups of lines, of which a file of n lines has about
    (n / 1.26) ** (2 / 3), then within a group. Nothing is shuffled.
    """
    n, g, w, sums = len(separator.encode()), F.col("__group"), F.col("__widths"), F.col("__sums")
    rows = pinned(files.select(F.col(file_id).alias("file_id"), F.col(content).alias("__text")), "__all", chunks(F.col("__text"), separator)).drop("__text")
    rows = pinned(rows, "__all", F.slice("__all", F.lit(1), F.size("__all") - 1))
    rows = pinned(rows, "__widths", F.transform("__all", lambda x: (F.octet_length(x) + n).cast("long")))
    rows = pinned(rows, "__group", F.greatest(F.ceil(F.cbrt(2 * F.size(w))), F.lit(1)).cast("int"))
    groups = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(w) - 1, g).cast("int")), lambda k: _total(F.slice(w, k * g + 1, g)))
    rows = pinned(rows, "__sums", F.when(F.size(w) > 0, groups).otherwise(F.array().cast("array<bigint>")))
    rows = pinned(rows, "__before", F.transform(sums, lambda x, k: _total(F.slice(sums, F.lit(1), k))))
    ends = F.transform(w, lambda x, i: F.get("__before", F.call_function("div", i, g).cast("int")) + _total(F.slice(w, i - i % g + 1, i % g + 1)))
    rows = rows.select("file_id", F.posexplode(F.arrays_zip(F.col("__all").alias("line"), F.col("__widths").alias("width"), ends.alias("end_pos"))).alias("idx", "r"))
    return rows.select("file_id", "idx", "r.line", (F.col("r.end_pos") - F.col("r.width")).alias("start_pos"), "r.end_pos")


def with_offsets(rows: DataFrame, separator: str = "\n") -> DataFrame:
    """Adds start_pos and end_pos: the bytes of each record with its separator. ``rows`` must hold blank records too.

    For rows of which no one has the contents any more (else see ``records_with_offsets``): a file's rows are sorted.
    """
    width = F.octet_length("line") + len(separator.encode())
    end = F.sum(width).over(Window.partitionBy("file_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end_pos", end).withColumn("start_pos", F.col("end_pos") - width)


def consumed(content: Column, separator: str, multiline: bool = False) -> Column:
    """The offset after reading a text once: the end of its last separator, or all of it where records may span lines."""
    all_bytes = F.octet_length(content)
    tail = F.octet_length(F.element_at(chunks(content, separator), -1))
    return (all_bytes if multiline else all_bytes - tail).cast("long")


def resumed(files: DataFrame, offsets: DataFrame, file_id: str, content: str, separator: str = "\n") -> DataFrame:
    """Records of each file from its saved offset (id, start) on; from 0 where none is saved or the file is shorter."""
    saved = offsets.select(F.col("id").alias("__id"), F.col("start").alias("__start"))
    both = files.join(saved, F.col(file_id) == F.col("__id"), "left")
    data = F.encode(F.col(content), "utf-8")
    start = F.when(F.col("__start") <= F.octet_length(content), F.col("__start")).otherwise(0)
    left = F.decode(F.substr(data, F.coalesce(start, F.lit(0)).cast("int") + 1), "utf-8")
    return records(both.select(F.col(file_id).alias("file_id"), left.alias("content")), "file_id", "content", separator)
