"""A data source for growing log files: batch (read once) and stream (read on from byte offsets).

Formats and offsets: ``spark.read.format("logtail")`` gives the complete records of all files, in parallel over files
and over byte ranges of large files; ``spark.readStream`` reads what was appended since the offsets of the checkpoint.
Options: include, exclude (JSON lists or comma-separated), separator, fingerprintStrategy, fingerprintSize, splitBytes,
startOffsets (JSON: file id to byte), rest (also the incomplete record at a file's end), keepBlank, workers (threads that
identify files on the driver), maxBytes and maxFileBytes (most bytes of a stream's batch, in all and of one file; 0: no
bound; of a stream that goes on from a checkpoint, startOffsets should then say where it stands, as the collector does).
Paths must be visible to all executors.
Records are split by block and handed over as Arrow batches.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from loglattice.options import DEVICE_AND_INODE
from loglattice.session import ship
from loglattice.sources.discovery import FingerprintMismatch, Found, Known, identity, listing

SCHEMA = "line string, file string, file_id string, byte_pos long, end_pos long, ts timestamp"
_BLOCK = 4 << 20


@dataclass
class Range(InputPartition):
    path: str
    file_id: str
    start: int
    end: int
    first: bool
    last: bool

    def __init__(self, path: str, file_id: str, start: int, end: int, first: bool = True, last: bool = True):
        super().__init__(None)
        self.path, self.file_id, self.start, self.end, self.first, self.last = path, file_id, start, end, first, last


def split_records(f: BinaryIO, separator: bytes, start: int, end: int, first: bool = True, rest: bool = False, block: int = _BLOCK) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(begins, records) of the records that begin in [start, end) of a file, block by block; ``rest``: also an incomplete last one.

    Unless ``first``, the reader looks for the separator that ends at or after ``start``: the record before it belongs
    to the range before. Separators do not overlap and are found from the left.
    """
    n = len(separator)
    at = start if first else max(0, start - n)
    f.seek(at)
    held, scanned, skip = bytearray(), 0, not first
    while at < end and (data := f.read(block)):
        held += data
        if held.find(separator, max(0, scanned - n + 1)) < 0:
            scanned = len(held)
            continue
        pieces = bytes(held).split(separator)
        held, scanned = bytearray(pieces.pop()), 0
        width = np.fromiter(map(len, pieces), np.int64, len(pieces)) + n
        ends = at + np.cumsum(width)
        begins, at = ends - width, int(ends[-1])
        k = int(np.searchsorted(begins, end, "left"))
        if k > skip:
            yield begins[skip:k], pieces[skip:k]
        skip = False
    if rest and held and not skip and at < end:
        yield np.array([at], np.int64), [bytes(held)]


def as_text(records: list[bytes]) -> pa.Array:
    """Records as strings; bytes that are no UTF-8 are replaced."""
    try:
        return pa.array(records, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([r.decode("utf-8", "replace") for r in records], pa.string())


def next_end(path: str, separator: bytes, begin: int) -> int:
    """Where the record that begins at ``begin`` ends; ``begin`` if it is not complete."""
    with open(path, "rb") as f:
        f.seek(begin)
        held, scanned = bytearray(), 0
        while data := f.read(_BLOCK):
            held += data
            if (hit := held.find(separator, max(0, scanned - len(separator) + 1))) >= 0:
                return begin + hit + len(separator)
            scanned = len(held)
    return begin


def complete_end(path: str, separator: bytes, size: int) -> int:
    """Where the last complete record of the first ``size`` bytes ends; searched backwards, block by block."""
    n, upper = len(separator), size
    with open(path, "rb") as f:
        while upper > 0:
            lower = max(0, upper - _BLOCK)
            f.seek(lower)
            data = f.read(min(size, upper + n - 1) - lower)
            if (hit := data.rfind(separator)) >= 0:
                return lower + hit + n
            upper = lower
    return 0


class _Options:
    def __init__(self, options: dict):
        low = {k.lower(): v for k, v in options.items()}

        def several(name: str) -> list[str]:
            value = low.get(name, "")
            return json.loads(value) if value.startswith("[") else [v for v in value.split(",") if v]

        self.include = several("include") or ([low["path"]] if low.get("path") else [])
        self.exclude = several("exclude")
        self.separator = low.get("separator", "\n")
        if not self.separator:
            raise ValueError("the separator must not be empty")
        self.strategy, self.size = low.get("fingerprintstrategy", DEVICE_AND_INODE), int(low.get("fingerprintsize", 1024))
        self.split = int(low.get("splitbytes", 64 << 20))
        self.start = json.loads(low.get("startoffsets", "{}"))
        self.rest = low.get("rest", "false").lower() == "true"
        self.blank = low.get("keepblank", "false").lower() == "true"

        self.workers, self.most, self.most_of_file = max(1, int(low.get("workers", 16))), int(low.get("maxbytes", 0)), int(low.get("maxfilebytes", 0))

    def found(self, known: Known | None = None) -> list[Found]:
        return listing(self.include, self.exclude, self.strategy, self.size, self.separator, self.workers, known)

    def ranges(self, path: str, file_id: str, start: int, end: int) -> list[Range]:
        """One range, or several for a long file whose separator cannot overlap itself."""
        s = self.separator
        overlaps = any(s[:k] == s[-k:] for k in range(1, len(s)))
        if overlaps or end - start <= self.split:
            return [Range(path, file_id, start, end)]
        cuts = [*range(start, end, self.split), end]
        return [Range(path, file_id, a, b, a == start, b == end) for a, b in zip(cuts, cuts[1:])]

    def whereabouts(self, file_id: str, path: str) -> str | None:
        """The path at which a file is now that was at ``path``; None if there is no such file any more.

        Looked for in a fresh listing, then beside the old path, where a rotation may have given it a name that is not
        included. Twice more if not found, as it may be renamed during the listing. An error if it cannot be told.
        """
        for wait in (0, 0.1, 0.3):
            time.sleep(wait)
            if now := next((f.path for f in self.found() if f.file_id == file_id), None):
                return now
            folder = os.path.dirname(path) or "."
            beside = [os.path.join(folder, n) for n in sorted(os.listdir(folder))] if os.path.isdir(folder) else []
            for other in filter(os.path.isfile, beside):
                if identity(other, self.strategy, self.size, self.separator) == file_id:
                    return other
        if os.path.exists(path):
            open(path, "rb").close()
        return None

    def rows(self, part: Range) -> Iterator[pa.RecordBatch]:
        """The records of a range. The open file is the one that was identified, or an error is raised before any row."""
        with open(part.path, "rb") as f:
            now, path, opened = identity(part.path, self.strategy, self.size, self.separator), os.stat(part.path), os.fstat(f.fileno())
            if now != part.file_id or (path.st_dev, path.st_ino) != (opened.st_dev, opened.st_ino):
                raise FingerprintMismatch(part.path, part.file_id, now)
            ts = datetime.now(timezone.utc)
            n = len(self.separator.encode())
            for begins, records in split_records(f, self.separator.encode(), part.start, part.end, part.first, self.rest and part.last):
                width = np.fromiter(map(len, records), np.int64, len(records))
                ends = begins + width + n
                if self.rest and part.last:  # an incomplete record has no separator
                    ends = np.minimum(ends, opened.st_size) if len(records) == 1 else ends
                if not self.blank:
                    some = width > 0
                    if not some.all():
                        records, begins, ends = [r for r in records if r], begins[some], ends[some]
                if records:
                    same = lambda v, t: pa.repeat(pa.scalar(v, t), len(records))
                    columns = [as_text(records), same(part.path, pa.string()), same(part.file_id, pa.string()), pa.array(begins), pa.array(ends), same(ts, pa.timestamp("us", "UTC"))]
                    yield pa.RecordBatch.from_arrays(columns, ["line", "file", "file_id", "byte_pos", "end_pos", "ts"])


class _Batch(DataSourceReader):
    def __init__(self, options: _Options):
        self.o = options

    def partitions(self):
        """Ranges up to the present size of each file: what is incomplete at its end is found by the task that reads it."""
        out = []
        for f in self.o.found():
            start = self.o.start.get(f.file_id, 0)
            start = start if start <= f.size else 0
            if f.size > start:
                out += self.o.ranges(f.path, f.file_id, start, f.size)
        return out or [Range("", "", 0, 0)]

    def read(self, partition):
        return self.o.rows(partition) if partition.end > partition.start else iter(())


class _Stream(DataSourceStreamReader):
    """Offsets are {file id: [path, byte]}: they survive renames, and files that are gone leave them."""

    def __init__(self, options: _Options):
        self.o, self.known, self.planned = options, Known(), dict(options.start)

    def initialOffset(self):
        return {k: ["", v] for k, v in self.o.start.items()}

    def _end(self, f: Found) -> int:
        return self.known.of(f.path, "end", lambda: complete_end(f.path, self.o.separator.encode(), f.size))

    def latestOffset(self):
        """The ends of complete records; no more than ``maxBytes`` in all and ``maxFileBytes`` of each file beyond the last

        plan, but one record at least. Files of which least was read come first.
        """
        found = self.o.found(self.known)
        with ThreadPoolExecutor(self.o.workers) as pool:
            ends = dict(zip((f.file_id for f in found), pool.map(self._end, found)))
        if self.o.most or self.o.most_of_file:
            whole, of_file = (m or float("inf") for m in (self.o.most, self.o.most_of_file))
            left = whole
            order = sorted(found, key=lambda f: (self.planned.get(f.file_id, 0), f.path))
            for f in order:
                begin = self.planned.get(f.file_id, 0)
                begin = begin if begin <= ends[f.file_id] else 0
                more = ends[f.file_id] - begin
                cap = min(left, of_file)
                if more > cap:
                    upto = complete_end(f.path, self.o.separator.encode(), begin + cap) if cap > 0 else begin
                    if upto <= begin and (left == whole or cap < left):
                        upto = next_end(f.path, self.o.separator.encode(), begin)
                    ends[f.file_id] = max(upto, begin)
                left -= ends[f.file_id] - begin
                left = max(0, left)
        out = {f.file_id: [f.path, ends[f.file_id]] for f in found}
        self.planned = {k: v[1] for k, v in out.items()}
        return out

    def partitions(self, start, end):
        self.planned = {k: v[1] for k, v in end.items()}
        out = []
        for file_id, (path, upto) in end.items():
            begin = start.get(file_id, ["", 0])[1]
            begin = begin if begin <= upto else 0
            if upto > begin:
                out += self.o.ranges(path, file_id, begin, upto)
        return out

    def read(self, partition):
        """The rows of a range, wherever its file is by now. The batch fails, and its offsets with it, if it cannot be read."""
        part = partition
        for _ in range(5):
            try:
                # neither error comes after a row was given
                yield from self.o.rows(part)
                return
            except (FingerprintMismatch, FileNotFoundError) as e:
                error = e
            path = self.o.whereabouts(part.file_id, part.path)
            if path is None:
                print(f"{part.path}: {part.file_id} is gone, bytes {part.start} to {part.end} are lost", file=sys.stderr)
                return
            part = Range(path, part.file_id, part.start, part.end, part.first, part.last)
        raise error

    def commit(self, end):
        pass


class LogTail(DataSource):
    @classmethod
    def name(cls):
        return "logtail"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Batch(_Options(self.options))

    def streamReader(self, schema):
        return _Stream(_Options(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format ``logtail`` known to the session."""
    ship(spark)
    spark.dataSource.register(LogTail)
