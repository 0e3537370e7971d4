"""Grouping physical lines into logical records.

After each line a file is open (a record may go on) or closed. Every line either sets that state, turns it, or leaves
it. Such steps compose, so the state before a block of lines needs only one step for each block before it: files are cut
into blocks, blocks run side by side, and no file has to pass through one task as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.options import CONTINUE_PAST, CONTINUE_THROUGH, HALT_BEFORE, HALT_WITH, MultilineOptions
from loglattice.session import materialise

#: A step: what a line does to the state.
CLOSE, OPEN, KEEP, TURN = 0, 1, 2, 3


def _matches(line: Column, pattern: str) -> Column:
    return F.coalesce(line.rlike(pattern), F.lit(False))


def _steps(rows: DataFrame, o: MultilineOptions) -> DataFrame:
    c, s = F.col("__c"), F.col("__s0") & (F.length("line") > 0)
    rows = rows.withColumns({"__s0": _matches(F.col("line"), o.start_pattern), "__c": _matches(F.col("line"), o.condition_pattern)})
    if o.mode in (CONTINUE_PAST, HALT_WITH):
        goes_on = c if o.mode == CONTINUE_PAST else ~c
        step = F.when(s & goes_on, OPEN).when(~s & ~goes_on, CLOSE).when(s, TURN).otherwise(KEEP)
    else:
        ends = ~c if o.mode == CONTINUE_THROUGH else c if o.mode == HALT_BEFORE else F.length("line") == 0
        step = F.when(s, OPEN).when(ends, CLOSE).otherwise(KEEP)
    return rows.withColumn("__step", step)


def _before(rows: DataFrame, keys: list[str], order: str, outs: dict[str, Column], turns: bool = True) -> DataFrame:
    """Adds, by name, the state (0, 1) before each row, from the steps of earlier rows and a state before the first; and

    __known: whether any earlier row has set it. ``turns``: whether there are steps that turn it.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    step = F.col("__step")
    last = F.last(F.when(step <= OPEN, step), True).over(before)
    if not turns:
        rows = rows.withColumn("__last", last)
        return rows.withColumns({name: F.coalesce("__last", entry).cast("int") for name, entry in outs.items()} | {"__known": F.col("__last").isNotNull()}).drop("__last")
    rows = rows.withColumn("__turns", F.sum((step == TURN).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"__last": last, "__then": F.last(F.when(step <= OPEN, F.col("__turns")), True).over(before)})
    since = F.col("__turns") - (step == TURN).cast("int") - F.coalesce("__then", F.lit(0))
    return rows.withColumns({name: ((F.coalesce("__last", entry) + since) % 2).cast("int") for name, entry in outs.items()} | {"__known": F.col("__last").isNotNull()}).drop("__last", "__turns", "__then")


def _then(was: Column) -> Column:
    """The state after a row, by the state before it."""
    step = F.col("__step")
    return F.when(step <= OPEN, step).when(step == TURN, 1 - was).otherwise(was)


def grouped(rows: DataFrame, options: MultilineOptions, block_lines: int = 100_000) -> DataFrame:
    """(file_id, first_idx, n_lines, record): the logical records of (file_id, idx, line).

    Lines of a record are joined by a line feed. In an unknown mode each line is a record, but blank ones are lost
    while a record is open. A blank line that matches the start pattern is lost where it would begin a record. Lines
    that are null count as blank. What is open at the end of a file is given out.

    Lines meet once, by block of their file, and are grouped there for both states the block may be entered in. One row
    for each block then tells which state it was, and only records at the edges of blocks are put together again.
    """
    rows = rows.select("file_id", F.col("idx").cast("long").alias("idx"), F.coalesce("line", F.lit("")).alias("line"))
    rows = _steps(rows.withColumn("__block", F.call_function("div", F.col("idx"), F.lit(block_lines))), options)
    known = options.mode in (CONTINUE_THROUGH, HALT_BEFORE, CONTINUE_PAST, HALT_WITH)
    keys = ["__block", "file_id"]
    first_block = F.col("__block") == 0
    upto = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = _before(rows, keys, "idx", {"__w0": F.lit(0), "__w1": F.when(first_block, 0).otherwise(1)}, options.mode in (CONTINUE_PAST, HALT_WITH))
    rows = rows.withColumn("__settled", first_block | F.col("__known"))
    blank = F.length("line") == 0

    def fate(was: Column) -> tuple[Column, Column]:
        """Whether a line begins a record, and whether it is lost, by whether a record was open before it."""
        if options.mode == CONTINUE_THROUGH:
            new = ~(F.col("__c") & was)
        elif options.mode == HALT_BEFORE:
            new = F.col("__c") | ~was
        else:
            new = ~was if known else F.lit(True)
        return new, (new & F.col("__s0") & blank) if known else (blank & (F.col("__s0") | was))

    (new0, lost0), (new1, lost1) = fate(F.col("__w0") == 1), fate(F.col("__w1") == 1)
    rows = rows.withColumns({"__n0": new0 & ~lost0, "__n1": new1 & ~lost1, "__l0": lost0, "__l1": lost1})
    rows = rows.withColumns({
        "__b0": F.last(F.when(F.col("__n0"), F.col("idx")), True).over(upto), "__b1": F.last(F.when(F.col("__n1"), F.col("idx")), True).over(upto),
        "__sure": F.coalesce(F.last(F.when(F.col("__n0"), F.col("__settled")), True).over(upto), F.lit(False)),
    })
    kept = F.when(~(F.col("__l0") & F.col("__l1")), F.struct("idx", "line"))
    text = lambda pairs, name: F.array_join(F.transform(F.array_sort(pairs), lambda x: x[name]), "\n")
    last = F.struct("idx", _then(F.col("__w0")).alias("e0"), _then(F.col("__w1")).alias("e1"))
    parts = rows.groupBy(*keys, "__b0", "__b1", "__l0", "__l1", "__sure").agg(
        F.min("idx").alias("idx"), F.count(F.lit(1)).alias("n"), text(F.collect_list(kept), "line").alias("text"), F.max(last).alias("last")
    )
    whole = Window.partitionBy(*keys)
    ends = {"__m0": F.max("__b0").over(whole), "__m1": F.max("__b1").over(whole), "__end": F.max("last").over(whole)}
    parts = materialise(parts.withColumns(ends).drop("last"), "records")
    done = F.col("__sure") & ~F.col("__l0") & (F.col("__b0") < F.col("__m0"))
    closed = parts.where(done).select("file_id", F.col("__b0").alias("first_idx"), F.col("n").alias("n_lines"), F.col("text").alias("record"))
    blocks = parts.groupBy(*keys).agg(*(F.max(c).alias(c) for c in ends))
    e0, e1 = F.col("__end.e0"), F.col("__end.e1")
    step = F.when(e0 == e1, e0).when(e0 == 0, KEEP).otherwise(TURN)
    blocks = _before(blocks.withColumn("__step", step), ["file_id"], "__block", {"__in": F.lit(0)})
    by_file = Window.partitionBy("file_id").orderBy("__block")
    at_end = F.when(F.col("__in") == 0, F.col("__m0")).otherwise(F.col("__m1"))
    carried = F.last(at_end, True).over(by_file.rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(F.col("file_id").alias("b_file"), F.col("__block").alias("b_block"), "__in", carried.alias("carried"))
    edge = parts.where(~done).join(blocks, F.col("file_id").eqNullSafe(F.col("b_file")) & (F.col("__block") == F.col("b_block")))
    by_entry = lambda name: F.when(F.col("__in") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    edge = edge.where(~by_entry("__l")).withColumn("first_idx", F.coalesce(by_entry("__b"), "carried", "idx"))
    joined = edge.groupBy("file_id", "first_idx").agg(F.sum("n").alias("n_lines"), text(F.collect_list(F.struct("idx", "text")), "text").alias("record"))
    return closed.unionByName(joined)


class Machine:
    """The same rules line by line, for streams: ``feed`` gives the records that a line completes."""

    def __init__(self, options: MultilineOptions):
        import re

        self.o, self.start, self.condition = options, re.compile(options.start_pattern), re.compile(options.condition_pattern)
        self.lines: list[str] = []

    def flush(self) -> list[str]:
        out = ["\n".join(self.lines)] if self.lines and "\n".join(self.lines) else []
        self.lines = []
        return out

    def feed(self, line: str) -> list[str]:
        s, c, mode = bool(self.start.search(line)), bool(self.condition.search(line)), self.o.mode
        done: list[str] = []
        if "\n".join(self.lines):
            if mode in (CONTINUE_PAST, HALT_WITH):
                self.lines.append(line)
                return self.flush() if c == (mode == HALT_WITH) else []
            if mode in (CONTINUE_THROUGH, HALT_BEFORE) and c == (mode == CONTINUE_THROUGH):
                self.lines.append(line)
                return []
            done = self.flush()
            if mode not in (CONTINUE_THROUGH, HALT_BEFORE):
                self.lines = [line]
                return done
        self.lines = []
        if s:
            self.lines = [line]
            return done
        return [*done, line]
