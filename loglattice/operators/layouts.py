"""Log lines of unlike layouts, and entries of several lines, as entries with time, level, component and message.

A line's shape signature has its character classes collapsed. Each distinct signature is resolved to an extraction rule
once; the table of rules is measured and broadcast (or, beyond a bound, each line is resolved by itself), and only the
rule's own expression is run on the line. Lines whose signature starts no entry continue the entry before them in the
file: first within blocks of a file's bytes, then across blocks by one carried head for each block, so no file is
gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglattice.operators.instants import MONTHS, with_host_zone, with_instant
from loglattice.session import fresh, materialise, pinned

# Names of levels, by the level they stand for.
LEVELS = {
    "DEBUG": ("d", "debug", "trace", "fine"),
    "INFO": ("i", "info", "information", "notice", "n"),
    "WARN": ("w", "warn", "warning"),
    "ERROR": ("e", "err", "error", "severe"),
    "FATAL": ("f", "c", "fatal", "crit", "critical", "panic", "emerg", "alert"),
}
_WORDS = "|".join(w for ws in LEVELS.values() for w in ws if len(w) > 1)
#: Rules by name: what a signature looks like, and what extracts the parts of a line.
RULES = {
    "glog": (r"\Aa9 9:9:9\.9 9 ", r"\A([DIWEFCN])(\d{4} \d\d:\d\d:\d\d(?:\.\d+)?) +\d+ ([^\s:\]]+):\d+\] ?((?s).*)"),
    "dashed": (r"\A9-9-9 9:9:9,9 - ", r"\A(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d+) - (\S+) - ([A-Za-z]+) - ?((?s).*)"),
    "thread": (r"\A9-9-9 9:9:9,9 a \[", r"\A(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d+) +([A-Za-z]+) +\[[^\]]*\] (\S+) - ?((?s).*)"),
    "bracket": (r"\A\[9-9-9 9:9:9\] ", r"\A\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\] (\S+)\.([A-Za-z]+): ?((?s).*)"),
    "syslog": (r"\Aa 9 9:9:9 ", r"\A([A-Z][a-z]{2} +\d{1,2} \d\d:\d\d:\d\d) \S+ ([^\s\[\]:]+)(?:\[\d+\])?: ?((?s).*)"),
    "pairs": (r"\Aa=", r"\A(?:time|ts|t)=(\S+) .*"),
    "json": (r"\A\{\"", r"(?s)\A\{\".*\}\z"),
    "open_json": (r"\A\{ ?\z", r"\A\{\z"),
    "field": (r"\A \"a\": ", r"\A\s+\"(level|lvl|severity|component|logger|module|msg|message|ts|time|timestamp)\": (?:\"(.*)\"|(\d+)),?\z"),
}
#: The groups of an expression for level, time, component and message; 0 for none.
GROUPS = {"kernel": (1, 2, 3, 4), "glog": (1, 2, 3, 4), "dashed": (3, 1, 2, 4), "thread": (2, 1, 3, 4), "bracket": (3, 1, 2, 4), "syslog": (0, 1, 2, 3)}
#: Names of fields for level, time, component and message.
FIELDS = (("level", "lvl", "severity"), ("time", "ts", "timestamp"), ("component", "logger", "module"), ("msg", "message"))
_SEP = "\u0001\u0002"
_QUOTED = r'"(?:[^"\\]|\\.)*+"'
#: A kernel record: priority, time, the first word before a colon (if its first line has one), and what follows the time.
_KERNEL = r"\A\s*(?:<(\d+)>)?\[\s*([^\]\n]*)\]\s*+(?:(?=([^\s:\[]+)[^:\n]*+:))?((?s).*)"
#: How many words of a line the rules look at: each shape names its blanks.
WORDS = 1 + max(shape.count(" ") for shape, _ in RULES.values())
#: Up to this many bytes of signatures are broadcast.
RULE_BYTES = 8 << 20


def with_signature(rows: DataFrame, line: Column, out: str) -> DataFrame:
    """Adds the shape of a line's first words, as many as any rule looks at: digits as 9, letters as a, blanks as one.

    ~ stands for the rest of the line. A null line has a null shape.
    """
    h, t = fresh([*rows.columns, out], "head", "line")
    rows = pinned(pinned(rows, t, line), h, F.regexp_extract(t, r"\A\s*+(?:\S++\s*+){0," + str(WORDS) + "}", 0))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(h, r"[0-9]+", "9"), r"[\p{L}_]+", "a"), r"\s+", " ")
    return pinned(rows, out, F.concat(shape, F.when(F.length(h) < F.length(t), "~").otherwise(""))).drop(h, t)


def _rule_of(sig: Column) -> Column:
    """The rule whose shape a signature has; null for those that start no entry."""
    rule = F.lit(None).cast("string")
    for name, (shape, _) in reversed(RULES.items()):
        rule = F.when(sig.rlike(shape), F.lit(name)).otherwise(rule)
    return rule


def resolve(signatures: DataFrame, column: str) -> DataFrame:
    """Distinct signatures with the rule each leads to, without those that start no entry.

    Written before the rules are tried, so that these are tried once a signature and not once a line.
    """
    distinct = materialise(signatures.select(column).where(F.col(column).isNotNull()).distinct(), "signatures")
    return distinct.withColumn("rule", _rule_of(F.col(column))).where(F.col("rule").isNotNull())


def with_rules(rows: DataFrame, sig: str, rules: DataFrame) -> DataFrame:
    """Adds ``rule`` to each row: by the table of rules if its measured size allows, else by the row's own signature."""
    size = rules.agg(F.coalesce(F.sum(F.octet_length(sig) + 16), F.lit(0))).first()[0]
    if size > RULE_BYTES:
        return rows.withColumn("rule", _rule_of(F.col(sig)))
    return rows.join(F.broadcast(rules.withColumnRenamed(sig, "__r_sig")), F.col(sig) == F.col("__r_sig"), "left").drop("__r_sig")


def level_of(word: Column) -> Column:
    """DEBUG, INFO, WARN, ERROR or FATAL for a level's name in any case; '' for anything else."""
    low, out = F.lower(word), F.lit("")
    for level, names in LEVELS.items():
        out = F.when(low.isin(*names), F.lit(level)).otherwise(out)
    return F.coalesce(out, F.lit(""))


def _ours(events: DataFrame) -> DataFrame:
    return events.where(F.col("file").isNotNull() & ~F.contains("file", F.lit(".csv")) & ~F.contains("file", F.lit("audit")))


def _text() -> Column:
    return F.rtrim(F.coalesce("line", F.lit("")), F.lit(" \t\n\u000b\f\r"))


def our_lines(events: DataFrame, *more: str) -> DataFrame:
    """(byte_pos, file_id, event_id, kernel, text) and the columns ``more`` of the kept copies of log lines.

    Of rows equal in file_id and byte_pos the one with the smallest event_id counts. Rows that lack one of these have a
    null file_id and their event_id as byte_pos. White space at the end of a line is cut off. Copies of one line are
    united where they are read before they are sent anywhere, so one with a third of all rows is no hot spot.
    """
    placed = F.col("file_id").isNotNull() & F.col("byte_pos").isNotNull()
    rows = _ours(events).select(
        F.when(placed, F.col("byte_pos")).otherwise(F.col("event_id")).alias("byte_pos"), F.when(placed, F.col("file_id")).alias("file_id"),
        "event_id", F.contains("file", F.lit("dmesg")).alias("kernel"), _text().alias("text"), *more,
    )
    first = F.min_by(F.struct("event_id", "kernel", "text", *more), "event_id").alias("r")
    return rows.groupBy("byte_pos", "file_id").agg(first).select("byte_pos", "file_id", "r.*")


def parsed_lines(lines: DataFrame, rules: DataFrame, texts: bool = True) -> DataFrame:
    """Lines with rule, lvl, component, inner and, with ``texts``, time_text and message.

    rule is null for lines that continue an entry; ``field`` lines belong to an entry opened by a lone brace. Null and
    empty lines continue. Very long lines are read whole.
    """
    rows = with_signature(lines, F.when(~F.col("kernel"), F.col("text")), "sig")
    rows = with_rules(rows, "sig", rules)
    t, rule = F.col("text"), F.when(F.col("kernel"), F.lit("kernel")).otherwise(F.col("rule"))
    rows = pinned(rows, "rule", rule)
    rule = F.col("rule")
    rows = pinned(rows, "plain", F.when(rule == "pairs", F.regexp_replace(t, _QUOTED, '""')))
    rows = pinned(rows, "object", F.when((rule == "json") & t.rlike(RULES["json"][1]), F.coalesce(F.from_json(t, ", ".join(f"{n} string" for ns in FIELDS for n in ns)), F.named_struct(*(x for ns in FIELDS for n in ns for x in (F.lit(n), F.lit("")))))))

    def split(name: str) -> Column:
        """Level, time, component and message by one pass over the line, which puts them in this order."""
        swap = "".join(_SEP + (f"${k}" if k else "") for k in GROUPS[name])
        return F.split(F.regexp_replace(t, _KERNEL if name == "kernel" else RULES[name][1], swap), _SEP, 5)

    def pair(names: tuple[str, ...]) -> Column:
        any_of = "|".join(names)
        quoted = F.replace(F.regexp_extract(t, rf'\s(?:{any_of})="((?:[^"\\]|\\.)*+)"', 1), F.lit('\\"'), F.lit('"'))
        return F.coalesce(F.nullif(F.regexp_extract("plain", rf'\s(?:{any_of})=([^\s"]+)', 1), F.lit("")), quoted)

    def plain_number(value: Column) -> Column:
        """A JSON number that was read in scientific notation, with its digits."""
        return F.when(value.rlike(r"\A\d+\.\d+E\d+\z"), value.try_cast("decimal(30, 6)").cast("string")).otherwise(value)

    key, word, digits = (F.regexp_extract(t, RULES["field"][1], k) for k in (1, 2, 3))
    lvl, time, component, message = FIELDS
    nothing, empty = F.lit(None).cast("string"), F.lit("")
    got = F.when(rule == "pairs", F.when(t.rlike(RULES["pairs"][1]), F.array(empty, pair(lvl), F.regexp_extract(t, RULES["pairs"][1], 1), pair(component), pair(message) if texts else empty)))
    got = got.when(rule == "json", F.when(F.col("object").isNotNull(), F.array(empty, *(F.coalesce(*(plain_number(F.col("object")[n]) if ns == time else F.col("object")[n] for n in ns), empty) for ns in FIELDS))))
    got = got.when(rule == "open_json", F.when(t == "{", F.array(empty, nothing, nothing, nothing, nothing)))
    got = got.when(rule == "field", F.when(key != "", F.array(empty, *(F.when(key.isin(*ns), F.coalesce(F.nullif(word, empty), digits) if ns == time else word) for ns in FIELDS))))
    for name in GROUPS:
        got = got.when(rule == name, split(name))
    rows = pinned(rows, "got", got)
    got = F.col("got")
    kernel = rule == "kernel"
    ok = got.isNotNull() & ((F.size(got) == 5) | kernel)
    read = lambda k: F.when(ok, F.coalesce(F.get(got, F.lit(k)), F.when(kernel, empty)))
    said = F.regexp_extract(read(4), r"\A(?:<(?i:(" + _WORDS + r"))>|\[(?i:(" + _WORDS + r"))\]|(?i:(" + _WORDS + r")):|((?:" + _WORDS.upper() + r"))(?=\s))", 0)
    prio = read(1).try_cast("long") % 8
    by_prio = F.when(prio <= 2, "FATAL").when(prio == 3, "ERROR").when(prio == 4, "WARN").when(prio <= 6, "INFO").when(prio == 7, "DEBUG").otherwise("")
    named = F.when(rule == "syslog", F.regexp_replace(said, r"[^A-Za-z]", "")).otherwise(read(1))
    level = F.when(kernel, by_prio).when(named != "", level_of(named))
    rest = F.when(F.size(got) == 5, got[4]).otherwise(t)
    told = F.when(kernel, F.when(read(3) != "", F.regexp_replace(rest, r"\A[^\n]*?:(?:[^\S\n]+|(?=\n)|\z)", "")).otherwise(rest)).when(rule == "syslog", F.ltrim(F.substr(read(4), F.length(said) + 1))).otherwise(read(4))
    inner = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    keep = [c for c in lines.columns if c not in ("kernel", "text")] + (["text"] if texts else [])
    return rows.select(
        *keep, F.when(ok, rule).alias("rule"), level.alias("lvl"), read(3).alias("component"), F.when(F.col("kernel"), inner).otherwise(1).cast("long").alias("inner"),
        *([read(2).alias("time_text"), told.alias("message")] if texts else []),
    )


def entries(lines: DataFrame, block_bytes: int = 1 << 20, more: tuple[str, ...] = ()) -> DataFrame:
    """(event_id, rule, n_lines, lvl, component[, time_text, message]) and ``more`` of each entry of parsed lines.

    Lines before a file's first entry belong to none. Lines without place in a file are an entry each if they start one.
    The message is that of the first line and the lines that follow, joined by line feeds; for an entry opened by a lone
    brace the named field. It has to fit into a task's memory, as any value does.

    Lines meet once, by block of their file. Entries that end within a block are whole there; the one that is open at a
    block's end and the lines before a block's first entry are put together by the heads that blocks hand on.
    """
    texts = "message" in lines.columns
    fields = ["lvl", "component", *(["time_text", "message"] if texts else [])]
    starts = F.col("rule").isNotNull() & (F.col("rule") != "field")
    placed = F.col("file_id").isNotNull()
    rows = lines.withColumn("block", F.when(placed, F.call_function("div", F.col("byte_pos"), F.lit(block_bytes))).otherwise(F.col("byte_pos")))
    by_block = Window.partitionBy("block", "file_id")
    before = by_block.orderBy("byte_pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"head": F.last(F.when(starts, F.col("byte_pos")), True).over(before), "opened": F.last(F.when(starts, F.col("rule")), True).over(before)})
    rows = rows.withColumn("last_head", F.max("head").over(by_block))
    is_head = F.col("byte_pos") == F.col("head")
    ours = is_head | ((F.col("rule") == "field") & (F.coalesce("opened", F.lit("open_json")) == "open_json"))
    filled = lambda f: F.min_by(F.col(f), F.when(F.col(f).isNotNull() & ours, F.col("byte_pos"))).alias(f)
    follow = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.coalesce(is_head, F.lit(False)), F.struct("byte_pos", "text")))), lambda x: x["text"]), "\n")
    n_follow = F.sum(F.when(~F.coalesce(is_head, F.lit(False)), 1).otherwise(0))
    parts = rows.groupBy("block", "file_id", "head").agg(
        F.max("last_head").alias("last_head"), F.min(F.when(is_head, F.col("rule"))).alias("rule"), F.sum("inner").alias("n_lines"), F.min(F.when(is_head, F.col("event_id"))).alias("event_id"),
        *(filled(f) for f in fields), *(F.min(F.when(is_head, F.col(c))).alias(c) for c in more), *([F.when(n_follow > 0, follow).alias("follow")] if texts else []),
    )
    parts = materialise(parts, "entries")
    placed = F.col("file_id").isNotNull()
    edge = parts.where(placed & (F.col("head").isNull() | (F.col("head") == F.col("last_head"))))
    blocks = edge.groupBy("block", "file_id").agg(F.max("last_head").alias("last_head"))
    carried = F.last("last_head", True).over(Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(F.col("file_id").alias("b_file"), F.col("block").alias("b_block"), carried.alias("carried"))
    edge = edge.join(blocks, (F.col("file_id") == F.col("b_file")) & (F.col("block") == F.col("b_block")))
    edge = edge.withColumn("first", F.col("head").isNotNull()).withColumn("head", F.coalesce("head", "carried")).where(F.col("head").isNotNull())
    own = lambda f: F.min(F.when(F.col("first"), F.col(f)))
    rule = own("rule")
    found = lambda f: F.when(rule == "open_json", F.min_by(f, F.when(F.col(f).isNotNull(), F.col("block")))).otherwise(own(f)).alias(f)
    tail = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("follow").isNotNull(), F.struct("block", "follow")))), lambda x: x["follow"]), "\n") if texts else None
    joined = edge.groupBy("head", "file_id").agg(
        rule.alias("rule"), F.sum("n_lines").alias("n_lines"), own("event_id").alias("event_id"), *(found(f) for f in fields), *(own(c).alias(c) for c in more),
        *([F.when(F.count("follow") > 0, tail).alias("follow")] if texts else []),
    )
    closed = parts.where(F.col("head").isNotNull() & (~placed | (F.col("head") != F.col("last_head"))))
    names = ["event_id", "rule", "n_lines", *fields, *more, *(["follow"] if texts else [])]
    whole = closed.select(*names).unionByName(joined.select(*names))
    shown = {f: F.coalesce(f, F.lit("")) for f in fields}
    if texts:
        shown["message"] = F.when((F.col("rule") == "open_json") | F.col("follow").isNull(), shown["message"]).otherwise(F.concat(shown["message"], F.lit("\n"), F.col("follow")))
    return whole.select("event_id", "rule", "n_lines", *(v.alias(f) for f, v in shown.items()), *more)


def dated(time_text: Column, rule: Column, arrival: Column) -> Column:
    """The time of an entry in a layout of the instants operator; null without a calendar time.

    Where the layout has no year it is that of the arrival, or the one before if the date would lie more than a day
    after the arrival; without arrival such times stay as they are, which no layout reads.
    """
    limit = arrival + F.expr("interval 1 day")
    mon, day, clock = (F.regexp_extract(time_text, r"\A([A-Z][a-z]{2}) +(\d{1,2}) (\S+)\z", k) for k in (1, 2, 3))
    number = F.lpad(F.call_function("div", F.instr(F.lit("".join(MONTHS)), mon) + 2, F.lit(3)).cast("string"), 2, "0")
    md = F.when(mon != "", F.concat(number, F.lpad(day, 2, "0"))).otherwise(F.substring(time_text, 1, 4))
    year = F.lpad((F.year(limit) - (md > F.date_format(limit, "MMdd")).cast("int")).cast("string"), 4, "0")
    yearless = F.when(mon != "", F.concat_ws(" ", day, mon, year, clock)).when(time_text.rlike(r"\A\d{4} \d\d:"), F.concat(year, F.lit("-"), F.substring(md, 1, 2), F.lit("-"), F.substring(md, 3, 2), F.substr(time_text, F.lit(5))))
    text = F.coalesce(yearless, time_text)
    return F.when((time_text != "") & ~((rule == "kernel") & ~time_text.rlike(r"\A[A-Z]")), text)


def log_entries(events: DataFrame, texts: bool = True, hosts: DataFrame | None = None, block_bytes: int = 1 << 20) -> DataFrame:
    """(event_id, n_lines, lvl, component[, time_text, message[, instant_us]]) of the application and kernel logs among events.

    instant_us, with ``hosts``, is the time in UTC: null for entries without a calendar time, -1 where it cannot be
    fixed to one instant. Tables without rows give none; other columns of ``events`` are not passed on.
    """
    more = ("host_name", "ts") if texts and hosts is not None else ()
    ours = _ours(events).where(~F.contains("file", F.lit("dmesg"))).select(_text().alias("text"))
    rules = materialise(resolve(with_signature(ours, F.col("text"), "sig"), "sig"), "rules")
    rows = entries(parsed_lines(our_lines(events, *more), rules, texts), block_bytes, more)
    if more:
        rows = with_host_zone(rows.withColumn("__text", dated(F.col("time_text"), F.col("rule"), F.col("ts").cast("timestamp"))), hosts, "host_name", "__zone")
        rows = with_instant(rows, "__text", "__zone", "instant_us")
    return rows.select("event_id", "n_lines", "lvl", "component", *(["time_text", "message"] if texts else []), *(["instant_us"] if more else []))
