"""Queries of the cleaning operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.operators import increments, instants, late, layouts, messages, rejects
from loglattice.plans import layouts_sql, times_sql
from loglattice.plans.tables import Query, reader
from loglattice.session import work_path


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    t = reader(spark, folder)
    return instants.unlike_times(t("access_log"), t("dmesg_records"), t("audit_records"), t("line_events"), t("log_hosts"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    t = reader(spark, folder)
    return increments.to_read(t("tracked_files"), t("stored_offsets"), t("collect_runs")).select("listing_id", "start_pos")


def p2_changes(spark: SparkSession, folder: str) -> DataFrame:
    """How many files of the open manifest are of each kind of change, and how many bytes are to read."""
    t = reader(spark, folder)
    delta = increments.run_versions(t("tracked_files"), t("stored_offsets"), t("collect_runs")).delta(0)
    return delta.groupBy("change").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.greatest(F.col("file_size") - F.col("start_pos"), F.lit(0))).alias("n_bytes"))


def p2_removed(spark: SparkSession, folder: str) -> DataFrame:
    t = reader(spark, folder)
    return increments.removed_files(t("tracked_files"), t("stored_offsets"), t("collect_runs")).select("file_id", "strategy", "done_to")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    t = reader(spark, folder)
    return late.late_cases(t("access_log"), t("line_events"), t("log_hosts"))


def p3_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Corrected counts and sums by hour of access, from the merged states of the batches."""
    t = reader(spark, folder)
    return late.totals(late.merge(late.counters(late.timed_access(t("access_log"), t("line_events"), t("log_hosts")))))


def p3_corrected(spark: SparkSession, folder: str) -> DataFrame:
    """The same totals from three deliveries of events, in another order than they arrived in and one of them repeated."""
    t = reader(spark, folder)
    store = late.CounterStore(spark, work_path(spark, "late"), most=2)
    part = F.pmod(F.xxhash64("event_id"), F.lit(3))
    for k in (2, 0, 2, 1):
        store.add(late.timed_access(t("access_log").where(part == k), t("line_events").where(part == k), t("log_hosts")), str(k))
    return store.totals()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.split_rows(reader(spark, folder)("raw_lines"), "raw")[1].select("raw_id", "reason")


def p5_valid(spark: SparkSession, folder: str) -> DataFrame:
    """The valid rows, with all their columns; status, bytes and duration as numbers."""
    valid = rejects.split_rows(reader(spark, folder)("raw_lines"), "raw")[0]
    number = lambda name, kind: F.col(name).try_cast(kind)
    return valid.select("raw_id", F.col("timestamp").alias("access_ts"), "ip", "method", "path", number("status", "int").alias("status"), number("bytes", "bigint").alias("n_bytes"), number("duration", "double").alias("duration"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return messages.dropped_copies(reader(spark, folder)("line_events"))


def p6_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """The events in three deliveries by batch number: rows, new messages kept, copies dropped of each."""
    events = reader(spark, folder)("line_events")
    store, out = messages.SeenMessages(spark, work_path(spark, "seen")), None
    for part in range(3):
        got = store.deliver_events(events.where(F.pmod("batch_no", F.lit(3)) == part), str(part))
        kept = (F.col("event_id") == F.col("keep_id")) & F.col("new")
        row = got.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n_rows"), F.sum(kept.cast("long")).alias("n_kept"))
        out = row if out is None else out.unionByName(row)
    return out


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return layouts.log_entries(reader(spark, folder)("line_events"), texts=False)


def p7_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Entries with their time as written and as instant, and their whole messages."""
    t = reader(spark, folder)
    return layouts.log_entries(t("line_events"), hosts=t("log_hosts"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p2_found, p2_changes, p2_removed, p3_found, p3_hours, p3_corrected, p5_found, p5_valid, p6_found, p6_deliveries, p7_found, p7_entries)}

_OPEN = """
with ok as (select distinct run_no from collect_runs where status = 'ok'), now as (select distinct run_no from collect_runs where status = 'open'),
m as (select * from (select listing_id, file_id, strategy, file_path, file_size, row_number() over (partition by file_id, strategy order by file_path, listing_id) rn
  from tracked_files where file_id is not null and run_no in (select run_no from now)) where rn = 1),
s as (select id, strategy, byte_offset done_to from (select *, row_number() over (partition by id, strategy order by run_no desc, updated_at desc, created_at desc, byte_offset desc) rn
  from stored_offsets where id is not null and byte_offset is not null and run_no in (select run_no from ok)) where rn = 1),
d as (select m.*, done_to, case when file_size >= done_to then done_to else 0 end start_pos from m left join s on s.id = m.file_id and s.strategy = m.strategy)
"""
_STAMP = r"regexp_extract(line, '^\s*type=([A-Z_]+)\s+msg=audit\((\d+(?:\.\d+)?):(\d+)\)', {})"
_KEYS = rf"""
with e as (select event_id, batch_no, file_id, byte_pos, file_id is not null and byte_pos is not null placed,
  case when {_STAMP.format(2)} <> '' then file || '|' || {_STAMP.format(1)} || '|' || {_STAMP.format(2)} || '|' || {_STAMP.format(3)} || '|' || regexp_extract(line, '\sitem=(\d+)', 1) end stamp from line_events),
act as (select distinct stamp from e where stamp is not null and not placed),
root as (select e.stamp, min(file_id || '#' || byte_pos) pos from e join act on e.stamp = act.stamp where placed group by 1),
k as (select event_id, batch_no, case when placed then file_id || '#' || byte_pos when e.stamp is not null then coalesce(root.pos, 's' || e.stamp) else 'e' || event_id end k
  from e left join root on not placed and root.stamp = e.stamp)
"""
_CSV = r"""
with t as (select raw_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') line from raw_lines),
r as (select *, regexp_full_match(',' || line, '(,[ \t]*("[^"]*(""[^"]*)*"|[^",]*))+') strict,
  list_transform(regexp_extract_all(',' || line, ',[ \t]*("[^"]*(?:""[^"]*)*"|[^",]*)', 1), lambda x: trim(case when x like '"%' then replace(x[2:-2], '""', '"') else x end, chr(32) || chr(9))) c
  from t where line <> '' and line <> 'timestamp,ip,method,path,status,bytes,duration'),
v as (select *, case when not strict then 'quoting' when len(c) <> 7 then 'columns' when c[5] <> '' and not regexp_full_match(c[5], '[1-5][0-9][0-9]') then 'status'
  when c[7] <> '' and not (regexp_full_match(c[7], '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') and coalesce(try_cast(c[7] as double) >= 0 and not isinf(try_cast(c[7] as double)), false)) then 'duration' end reason from r)
"""
ORACLES: dict[str, str] = {
    "p1_found": times_sql.P1_FOUND,
    "p3_found": times_sql.P3_FOUND,
    "p3_hours": times_sql.P3_HOURS,
    "p3_corrected": times_sql.P3_HOURS,
    "p7_found": layouts_sql.P7_FOUND,
    "p7_entries": layouts_sql.entries_sql(times_sql.texts),
    "p2_found": _OPEN + "select listing_id, start_pos from (select listing_id, file_size, coalesce(start_pos, 0) start_pos from d) where file_size > start_pos",
    "p2_changes": _OPEN + "select case when done_to is null then 'added' when file_size < done_to then 'shrunk' when file_size > done_to then 'grown' else 'same' end change, count(*) n_files, cast(sum(greatest(file_size - coalesce(start_pos, 0), 0)) as bigint) n_bytes from d group by 1",
    "p2_removed": _OPEN + "select id file_id, strategy, done_to from s where not exists (select 1 from m where m.file_id = s.id and m.strategy = s.strategy)",
    "p5_found": _CSV + "select raw_id, reason from v where reason is not null",
    "p5_valid": _CSV + "select raw_id, nullif(c[1], '') access_ts, nullif(c[2], '') ip, try_cast(nullif(c[7], '') as double) duration, nullif(c[3], '') \"method\", nullif(c[4], '') \"path\", try_cast(nullif(c[5], '') as int) status, try_cast(nullif(c[6], '') as bigint) n_bytes from v where reason is null",
    "p6_found": _KEYS + ", f as (select event_id, min(event_id) over (partition by k) keep_id from k) select keep_id, event_id drop_id from f where event_id <> keep_id",
    "p6_deliveries": _KEYS + ", p as (select event_id, k, batch_no % 3 part from k), f as (select *, row_number() over (partition by k order by part, event_id) rn from p) select cast(part as int) part, count(*) n_rows, cast(sum(cast(rn = 1 as int)) as bigint) n_kept from f group by 1",
}
