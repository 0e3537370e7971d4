"""Logical records of a stream of lines, with a flush of records that have been idle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loglattice.operators.multiline import Machine
from loglattice.options import MultilineOptions
from loglattice.session import ship

SCHEMA = "file_id string, file string, byte_pos long, record string"
#: The state store that timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Grouping(StatefulProcessor):
    """Keeps the open record of each file. A processing-time timer gives it out after the timeout without new lines."""

    def __init__(self, options: MultilineOptions):
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "file string, lines array<string>, began long")

    def _out(self, key, file, records: list[tuple[int, str]]) -> Iterator[pd.DataFrame]:
        if records:
            yield pd.DataFrame({"file_id": [key[0]] * len(records), "file": [file] * len(records), "byte_pos": [p for p, _ in records], "record": [r for _, r in records]})

    def _timers(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, (tuple, list)) else t)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """A file's new lines in order of their bytes; how many there can be is bounded by the source's maxFileBytes."""
        machine, records = Machine(self.options), []
        old = self.held.get() if self.held.exists() else None
        machine.lines, began = (list(old[1]), old[2]) if old else ([], 0)
        frame = pd.concat(list(rows)).sort_values("byte_pos", kind="stable")
        for line, at in zip(frame["line"], frame["byte_pos"]):
            began = began if machine.lines else int(at)
            done = machine.feed(line or "")
            for k, record in enumerate(done):  # the first of two was open before, the other is this line
                records.append((began if k == 0 else int(at), record))
            if done and machine.lines:
                began = int(at)
        file = frame["file"].iloc[-1]
        self._timers()
        if machine.lines:
            self.held.update((file, machine.lines, began))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.options.timeout * 1000))
        else:
            self.held.clear()
        yield from self._out(key, file, records)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            file, lines, began = self.held.get()
            self.held.clear()
            yield from self._out(key, file, [(began, "\n".join(lines))] if "\n".join(lines) else [])

    def close(self) -> None:
        pass


def grouped_stream(lines: DataFrame, options: MultilineOptions) -> DataFrame:
    """(file_id, file, byte_pos, record) of a stream of logtail rows (read with keepBlank); byte_pos is where the record begins."""
    options.validate()
    ship(lines.sparkSession)
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = lines.select("file_id", "file", "byte_pos", "line")
    return rows.groupBy("file_id").transformWithStateInPandas(Grouping(options), outputStructType=SCHEMA, outputMode="append", timeMode="processingTime")
