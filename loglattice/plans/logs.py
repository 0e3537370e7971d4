"""Queries of the collector's own operators: records, identities, multiline grouping, parsers, filters, sinks, metrics."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.functions import audit, csv, dmesg
from loglattice.operators import filters, fingerprints, multiline, records, tracking
from loglattice.options import MultilineOptions
from loglattice.plans.tables import Query, reader
from loglattice.session import pinned, work_path
from loglattice.sinks.writers import documents as sink_documents
from loglattice.sinks.writers import table_rows
from loglattice.sources import logtail
from loglattice.sources.offsets import OffsetStore
from loglattice.streaming.metrics import BATCH_BOUNDS, SECOND_BOUNDS, buckets, line_totals

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query (given a reader of tables) under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(reader(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_SPLIT = "with s as (select doc_id, string_split(text, {}) a from documents where text is not null), r as (select doc_id file_id, cast(i - 1 as int) idx, a[i] line, len(a) n from s, unnest(range(1, len(a) + 1)) t(i)) "
_LINES = _SPLIT.format("chr(10)")


@query(_LINES + "select file_id, idx, line from r where idx < n - 1 and line <> ''")
def records_newline(t):
    return records.records(t("documents"), "doc_id", "text")


@query(_SPLIT.format("' the '") + "select file_id, idx, line from r where idx < n - 1 and line <> ''")
def records_token_sep(t):
    return records.records(t("documents"), "doc_id", "text", " the ")


@query(_LINES + "select file_id, idx, line from r where idx < n - 1 or line <> ''")
def records_blank_mode(t):
    return records.records(t("documents"), "doc_id", "text", blank=True, rest=True)


@query(_LINES + "select file_id, idx, cast(e - strlen(line) - 1 as bigint) start_pos, cast(e as bigint) end_pos from (select *, sum(strlen(line) + 1) over (partition by file_id order by idx) e from r where idx < n - 1)")
def record_offsets(t):
    return records.records_with_offsets(t("documents"), "doc_id", "text").select("file_id", "idx", "start_pos", "end_pos")


@query("select doc_id, cast(strlen(text) - strlen(string_split(text, chr(10))[-1]) as bigint) consumed from documents")
def residual_not_consumed(t):
    return t("documents").select("doc_id", records.consumed(F.col("text"), "\n").alias("consumed"))


@query("select doc_id, cast(strlen(text) as bigint) consumed from documents")
def residual_multiline(t):
    return t("documents").select("doc_id", records.consumed(F.col("text"), "\n", True).alias("consumed"))


@query(_LINES + "select file_id, cast(case when n >= 3 then idx - 2 else idx end as int) idx, line from r where idx < n - 1 and line <> '' and (n < 3 or idx >= 2)")
def resume_from_offset(t):
    """The records of each file after its first two."""
    docs = t("documents")
    saved = records.records_with_offsets(docs, "doc_id", "text").where("idx = 1").select(F.col("file_id").alias("id"), F.col("end_pos").alias("start"))
    return records.resumed(docs, saved, "doc_id", "text")


@query("select doc_id, case when strlen(text) >= 512 then sha256(encode(text)[1:512]) end file_id from documents")
def fp_checksum(t):
    return t("documents").select("doc_id", fingerprints.checksum(F.col("text"), 512).alias("file_id"))


@query("select count(*) n_files, count(*) filter (strlen(text) < 2048) n_too_small from documents where text is not null")
def fp_checksum_too_small(t):
    docs = t("documents").where(F.col("text").isNotNull())
    small = fingerprints.checksum(F.col("text"), 2048).isNull()
    return docs.agg(F.count(F.lit(1)).alias("n_files"), F.sum(small.cast("long")).alias("n_too_small"))


@query("select doc_id, case when len(string_split(text, chr(10))) > 5 then sha256(array_to_string(string_split(text, chr(10))[1:5], chr(10)) || chr(10)) end file_id from documents")
def fp_nth_separator(t):
    return t("documents").select("doc_id", fingerprints.separator_checksum(F.col("text"), "\n", 5).alias("file_id"))


@query("select source, count(*) n_files, count(*) filter (len(string_split(text, chr(10))) <= 20) n_not_enough from documents where text is not null group by 1")
def fp_not_enough(t):
    docs = t("documents").where(F.col("text").isNotNull())
    few = fingerprints.separator_checksum(F.col("text"), "\n", 20).isNull()
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_files"), F.sum(few.cast("long")).alias("n_not_enough"))


@query("select sha256(encode(text)[1:256]) file_id, min('/mail/' || coalesce(source, '') || '/' || doc_id) path, count(*) n_paths from documents where strlen(text) >= 256 group by 1")
def fp_dedup_files(t):
    path = F.concat(F.lit("/mail/"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"))
    return tracking.first_paths(t("documents").select(fingerprints.file_id(F.col("text"), F.lit("checksum"), 256, "\n").alias("file_id"), path.alias("path")))


def _runs(t) -> tuple[DataFrame, DataFrame]:
    """One row with the number of the open run, and one with that of the run before it."""
    runs = t("collect_runs").select("run_no", "status")
    now = runs.where("status = 'open'").agg(F.max("run_no").alias("run_no"))
    return now, runs.join(F.broadcast(now.withColumnRenamed("run_no", "open_no")), F.col("run_no") < F.col("open_no")).agg(F.max("run_no").alias("run_no"))


def _listing(t, run: DataFrame) -> DataFrame:
    rows = t("tracked_files").where(F.col("file_id").isNotNull()).join(run, "run_no", "left_semi")
    return rows.groupBy("file_id").agg(F.min_by("strategy", F.struct("file_path", "listing_id")).alias("strategy"), F.min("file_path").alias("path"))


def _listings(t) -> tuple[DataFrame, DataFrame]:
    """The listings of the open run and of the one before."""
    now, before = _runs(t)
    return _listing(t, now), _listing(t, before)


_RUN = "select file_id, arg_min(strategy, (file_path, listing_id)) strategy, min(file_path) \"path\" from tracked_files where run_no = ({}) and file_id is not null group by 1"
_OPEN_RUN = "select max(run_no) from collect_runs where status = 'open'"
_BOTH = f"with old as ({_RUN.format(f'select max(run_no) from collect_runs where run_no < ({_OPEN_RUN})')}), now as ({_RUN.format(_OPEN_RUN)}) "


@query(_BOTH + 'select file_id, "path" from now where file_id not in (select file_id from old)')
def new_files(t):
    return tracking.new_files(*_listings(t)).select("file_id", "path")


@query(_BOTH + 'select file_id, "path" from old where file_id not in (select file_id from now)')
def removed_files(t):
    return tracking.removed_files(*_listings(t)).select("file_id", "path")


@query(_BOTH + ", o as (select id, strategy, arg_max(byte_offset, (updated_at, byte_offset)) b from stored_offsets group by 1, 2) select file_id, now.strategy, coalesce(b, 0) byte_offset from now left join o on o.id = file_id and o.strategy = now.strategy")
def offset_restore(t):
    return tracking.with_offsets(_listings(t)[0], t("stored_offsets")).select("file_id", "strategy", "byte_offset")


@query(_BOTH + 'select o."path", o.file_id, n.file_id current_id from old o left join now n on n."path" = o."path" where n.file_id is null or n.file_id <> o.file_id')
def fp_verify(t):
    return tracking.stale(*reversed(_listings(t))).select("path", "file_id", "current_id")


@query("select file, count(*) n from line_events where regexp_matches(file, '(^|/)app-[^/]*\\.log$') or regexp_matches(file, '^/srv/edge-[0-9][0-9]/log/dmesg[^/]*$') group by 1")
def path_include(t):
    return t("line_events").groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(filters.path_matches(F.col("file"), ["app-*.log", "/srv/edge-[0-9][0-9]/log/dmesg*"]))


@query("select file, count(*) n from line_events where starts_with(file, '/srv/core-01/') and not regexp_matches(file, '\\.csv$') group by 1")
def path_folders(t):
    """Folders as includes, which count where nothing more specific is included."""
    return t("line_events").groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(filters.included(F.col("file"), ["/srv/core-01/"], ["*.csv"]))


@query("select file, count(*) n from line_events where file like '%/audit.log' or regexp_matches(file, '(^|/)app-[^/]*$') group by 1")
def path_specific(t):
    """With a name and a glob the folder no longer counts."""
    return t("line_events").groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(filters.included(F.col("file"), ["/srv/core-01/", "audit.log", "app-*"]))


@query("with f as (select file_id, min(file_path) p from tracked_files where file_id is not null group by 1) select id, byte_offset, run_no, coalesce(p, '') \"path\" from stored_offsets left join f on f.file_id = id")
def event_paths(t):
    """The path under which a file is registered, for each row that names one."""
    files = t("tracked_files").select("file_id", F.col("file_path").alias("path"))
    return tracking.with_paths(t("stored_offsets").select(F.col("id").alias("file_id"), "byte_offset", "run_no"), files).withColumnRenamed("file_id", "id")


_LAST = "select id, strategy, arg_max({}, (run_no, updated_at, created_at, byte_offset)) {} from stored_offsets where id is not null and strategy is not null and byte_offset is not null and run_no is not null group by 1, 2"


@query(f"select a.id, a.strategy, a.b byte_offset, c.p \"path\" from ({_LAST.format('byte_offset', 'b')}) a join ({_LAST.format('file_path', 'p')}) c on c.id = a.id and c.strategy = a.strategy where a.strategy <> 'checksumSeperator'")
def offset_store(t):
    """What a store holds after the offsets of all runs were saved in three parts and one strategy was deleted."""
    rows = t("stored_offsets").where("id is not null and strategy is not null and byte_offset is not null and run_no is not null")
    store = OffsetStore(rows.sparkSession, work_path(rows.sparkSession, "offsets"), most=2)
    thirds = rows.agg(F.min("run_no"), F.max("run_no")).first()
    low, high = (thirds[0] or 0), (thirds[1] or 0)
    for k in range(3):
        part = rows.where((F.col("run_no") >= low + (high - low + 1) * k // 3) & (F.col("run_no") < low + (high - low + 1) * (k + 1) // 3))
        last = F.max_by(F.struct("file_path", "byte_offset"), F.struct("run_no", "updated_at", "created_at", "byte_offset")).alias("l")
        store.save(part.groupBy("id", "strategy").agg(last).select("id", "strategy", F.col("l.file_path").alias("path"), "l.byte_offset"))
    store.delete(rows.where("strategy = 'checksumSeperator'").select("id", "strategy").distinct())
    return store.load().select("id", "strategy", "byte_offset", "path")


@query("select file, count(*) n, cast(sum(strlen(piece)) as bigint) n_bytes from (select file, unnest(string_split(raw, chr(10))) piece from raw_lines) where piece <> '' group by 1")
def logtail_read(t):
    """The lines of all files, written as text files to the shared folder and read by the log source, by file."""
    rows = t("raw_lines").where("file is not null and raw is not null").select("file", "raw")
    spark = rows.sparkSession
    folder = work_path(spark, "logs")
    rows.write.partitionBy("file").text(folder)
    logtail.register(spark)
    place = re.sub(r"\Afile:/*", "/", folder)
    if ":" in place:
        raise ValueError("the log source reads mounted folders only")
    got = spark.read.format("logtail").options(include=place, exclude='[".*", "_*"]', fingerprintStrategy="deviceAndInode").load()
    return got.groupBy(F.url_decode(F.regexp_extract("file", r"/file=([^/]*)/[^/]*\z", 1)).alias("file")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("line")).alias("n_bytes"))


@query("select file, count(*) n from line_events where not regexp_matches(file, '\\.csv$') and not regexp_matches(file, '(^|/)audit\\.log[^/]*$') group by 1")
def path_exclude(t):
    return t("line_events").groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(~filters.path_matches(F.col("file"), ["*.csv", "audit.log*"]))


@query("select event_id, line from line_events where contains(line, 'timeout') or contains(line, 'mismatch')")
def filter_include(t):
    return t("line_events").select("event_id", "line").where(filters.allowed(F.col("line"), ["timeout", "mismatch"]))


@query("select event_id from line_events where not contains(line, 'GET') and not contains(line, 'type=')")
def filter_exclude(t):
    return t("line_events").where(filters.allowed(F.col("line"), [], ["GET", "", "type="])).select("event_id")


@query("select event_id, line from line_events where contains(line, 'ERROR') and not contains(line, 'quoted')")
def filter_both(t):
    return t("line_events").select("event_id", "line").where(filters.allowed(F.col("line"), ["ERROR"], ["quoted"]))


@query("select count(*) n from line_events")
def filter_empty_include(t):
    return t("line_events").where(filters.allowed(F.col("line"), [""])).agg(F.count(F.lit(1)).alias("n"))


#: Headers and quotes of mails as records of several lines.
_START, _COND = "^(From|To|Subject|On|Hi)", "^[ \t>]"


def _mail_lines(t) -> DataFrame:
    return records.records(t("documents"), "doc_id", "text", blank=True, rest=True)


def _ml_sql(mode: str, rows: str = _LINES + ", l as (select file_id, cast(idx as bigint) idx, line from r where idx < n - 1 or line <> '')", start: str = _START, cond: str = _COND) -> str:
    """The recipe of running maxima and parities, over whole files."""
    q = lambda x: x.replace("'", "''")
    steps = {
        "continueThrough": "case when s then 1 when not c then 0 else 2 end", "haltBefore": "case when s then 1 when c then 0 else 2 end",
        "continuePast": "case when s and c then 1 when not s and not c then 0 when s then 3 else 2 end", "haltWith": "case when s and not c then 1 when not s and c then 0 when s then 3 else 2 end",
        "": "case when s then 1 when line = '' then 0 else 2 end",
    }
    new = {"continueThrough": "not (c and was)", "haltBefore": "c or not was", "continuePast": "not was", "haltWith": "not was", "": "true"}[mode]
    lost = "line = '' and (s0 or was)" if mode == "" else "fresh and s0 and line = ''"
    return rows + f""", m as (select *, regexp_matches(line, '{q(start)}') s0, regexp_matches(line, '{q(cond)}') c, regexp_matches(line, '{q(start)}') and line <> '' s from l),
k as (select *, {steps[mode]} step from m),
a as (select *, max(case when step < 2 then 2 * idx + step end) over w lc, sum(cast(step = 3 as int)) over w tg from k window w as (partition by file_id order by idx)),
b as (select *, max(case when step < 2 then tg end) over (partition by file_id order by idx) tgc from a),
o as (select *, (coalesce(lc, 0) % 2 + tg - coalesce(tgc, 0)) % 2 = 1 op from b),
p as (select *, coalesce(lag(op) over (partition by file_id order by idx), false) was from o), f as (select *, {new} fresh from p),
g as (select *, max(case when fresh then idx end) over (partition by file_id order by idx) first_idx from f where not ({lost}))
select file_id, coalesce(first_idx, idx) first_idx, count(*) n_lines, string_agg(line, chr(10) order by idx) record from g group by 1, 2"""


def _ml(mode: str):
    def run(t):
        return multiline.grouped(_mail_lines(t), MultilineOptions(mode, _START, _COND, 1.0))

    return run


for _name, _mode in (("ml_continue_through", "continueThrough"), ("ml_continue_past", "continuePast"), ("ml_halt_before", "haltBefore"), ("ml_halt_with", "haltWith"), ("ml_unknown", "")):
    _run = _ml(_mode)
    _run.__name__ = _name
    query(_ml_sql(_mode))(_run)

_FILE_LINES = "with l as (select case when file_id is null or byte_pos is null then 'event ' || event_id else file_id end file_id, case when file_id is null or byte_pos is null then 0 else byte_pos end idx, arg_min(line, event_id) line from line_events group by 1, 2)"
_JAVA = MultilineOptions(java=True)


@query(_ml_sql("continueThrough", _FILE_LINES, _JAVA.start_pattern, _JAVA.condition_pattern))
def ml_java(t):
    """Lines in their files; one without a place stands alone."""
    placed = F.col("file_id").isNotNull() & F.col("byte_pos").isNotNull()
    rows = t("line_events").select("event_id", "line", F.when(placed, F.col("file_id")).otherwise(F.concat(F.lit("event "), F.col("event_id"))).alias("file_id"), F.when(placed, F.col("byte_pos")).otherwise(0).alias("idx"))
    rows = rows.groupBy("file_id", "idx").agg(F.min_by("line", "event_id").alias("line"))
    return multiline.grouped(rows, _JAVA, block_lines=1 << 20)


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_AUDIT_RE = r"'^type=([A-Z_]+)\s+msg=audit\((\d+)\.(\d+):(\d+)\):\s*([^\n]*)$'"
_AUDIT = rf"""with a as (select event_id, {_TRIM.format('raw')} x from audit_records), b as (select *, regexp_matches(x, {_AUDIT_RE}) st, regexp_extract(x, '^type=([A-Z_]+)\s+', 1) ty from a),
h as (select event_id, x, st, ty, case when st then cast(regexp_extract(x, {_AUDIT_RE}, 2) as bigint) else 0 end epoch_sec,
 case when st then cast(rpad(left(regexp_extract(x, {_AUDIT_RE}, 3), 9), 9, '0') as bigint) else 0 end epoch_nsec, case when st then cast(regexp_extract(x, {_AUDIT_RE}, 4) as bigint) else 0 end serial,
 case when st then regexp_extract(x, {_AUDIT_RE}, 5) else regexp_extract(x, '^type=[A-Z_]+\s+([^\n]*)$', 1) end body from b where ty <> '') """
_TOKENS = r"""regexp_extract_all(body, '((?:\\(?:.|$)|"(?:[^"\\]|\\(?:.|$))*(?:"|$)|''(?:[^''\\]|\\(?:.|$))*(?:''|$)|[^ "''\\])+)', 1)"""
_PAIRS = (
    _AUDIT
    + rf""", k as (select event_id, i, regexp_replace(tok[i], '\\(.|$)', '\1', 'g') tk from (select event_id, {_TOKENS} tok from h), unnest(range(1, len(tok) + 1)) u(i)),
p as (select event_id, i, left(tk, instr(tk, '=') - 1) "key", {_TRIM.format("substr(tk, instr(tk, '=') + 1)")} v from k where instr(tk, '=') > 1),
z as (select event_id, i, "key", replace(case when length(v) >= 2 and ((v like '"%"') or (v like '''%''')) then v[2:-2] else v end, '\"', '"') "value" from p),
f as (select event_id, "key", arg_max("value", i) "value" from z group by 1, 2) """
)


def _audited(t, fields: bool = False) -> DataFrame:
    read = audit.parsed if fields else audit.headers
    return read(t("audit_records").select("event_id", "raw"), "raw", "a").where(F.col("a").isNotNull())


@query(_AUDIT + "select event_id, ty rec_type, epoch_sec, serial from h")
def audit_header(t):
    return _audited(t).select("event_id", F.col("a.type").alias("rec_type"), "a.epoch_sec", "a.serial")


@query(_AUDIT + "select event_id, epoch_nsec from h")
def audit_ns(t):
    return _audited(t).select("event_id", "a.epoch_nsec")


@query(_PAIRS + 'select event_id, "key", "value" from f')
def audit_fields_long(t):
    return _audited(t, True).select("event_id", F.explode("a.fields").alias("key", "value"))


_JSON = (
    _PAIRS
    + r""", j as (select event_id, string_agg(cast(to_json("key") as varchar) || ':' || cast(to_json("value") as varchar), ',' order by "key") fs from f group by 1)
select h.event_id, replace(replace(replace('{"raw":' || cast(to_json(x) as varchar) || ',"type":"' || ty || '"' || case when epoch_sec <> 0 then ',"epoch_sec":' || epoch_sec else '' end || case when epoch_nsec <> 0 then ',"epoch_nsec":' || epoch_nsec else '' end
 || case when serial <> 0 then ',"serial":' || serial else '' end || case when fs is not null then ',"fields":{' || fs || '}' else '' end || '}', '<', '\u003c'), '>', '\u003e'), '&', '\u0026') "json" from h left join j on j.event_id = h.event_id"""
)


@query(_JSON)
def audit_json(t):
    return _audited(t, True).select("event_id", audit.to_json(F.col("a")).alias("json"))


@query(rf"select event_id from line_events where regexp_matches({_TRIM.format('line')}, '^type=[A-Z_]+\s+[^\n]*$')")
def audit_drop(t):
    rows = audit.parsed(t("line_events").select("event_id", "line"), "line", "a")
    return rows.where(filters.output_text(F.col("line"), audit.to_json(F.col("a")), F.col("a").isNotNull(), drop=True).isNotNull()).select("event_id")


@query("select event_id, line from line_events")
def audit_passthrough(t):
    """With the raw format, every line is passed on as it came."""
    rows = audit.parsed(t("line_events").select("event_id", "line"), "line", "a")
    return rows.select("event_id", filters.output_text(F.col("line"), audit.to_json(F.col("a")), F.col("a").isNotNull(), "raw").alias("line"))


_DM_RE = r"'^(?:<(\d+)>)?\[\s*(\d+(?:\.\d+)?)\]\s*([^\n]*)$'"
_DMESG = rf"""with a as (select event_id, boot_time, {_TRIM.format('raw')} x from dmesg_records), b as (select *, regexp_matches(x, {_DM_RE}) ok, coalesce(try_cast(nullif(regexp_extract(x, {_DM_RE}, 1), '') as bigint), 0) pr,
 cast(nullif(regexp_extract(x, {_DM_RE}, 2), '') as double) sec, {_TRIM.format(f'regexp_extract(x, {_DM_RE}, 3)')} msg from a where x <> ''),
d as (select event_id, x, ok, case when ok then cast(pr & 7 as int) else 0 end priority, case when ok then cast(pr >> 3 as int) else 0 end facility, case when ok then sec else 0.0 end ts, case when ok then msg else x end message, boot_time from b) """
_KNOWN = ", ".join(f"'{k}'" for k in dmesg.KNOWN)
_SUB = rf"""case when not ok then '' when regexp_extract(message, '^([a-zA-Z][a-zA-Z0-9_-]*)\s*[^\n]*?:', 1) <> '' then regexp_extract(message, '^([a-zA-Z][a-zA-Z0-9_-]*)\s*[^\n]*?:', 1)
 when lower(regexp_extract(message, '^(\S+)', 1)) in ({_KNOWN}) then lower(regexp_extract(message, '^(\S+)', 1)) when contains(message, 'Linux version') then 'kernel' when contains(message, 'systemd[') then 'systemd' when contains(message, 'docker') then 'docker' else '' end"""


def _kernel(t) -> DataFrame:
    rows = t("dmesg_records").select("event_id", "raw", "boot_time")
    return pinned(rows, "d", dmesg.parse(F.col("raw"), F.col("boot_time"))).where(F.col("d").isNotNull())


@query(_DMESG + "select event_id, cast(round(ts * 1000000) as bigint) boot_us, facility, priority, message from d")
def dmesg_parse(t):
    return _kernel(t).select("event_id", F.round(F.col("d.timestamp") * 1e6).cast("long").alias("boot_us"), "d.facility", "d.priority", "d.message")


_CASE = lambda names, col: f"case {col} " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(names)) + " else 'unknown' end"


@query(_DMESG + f"select {_CASE(dmesg.PRIORITIES, 'priority')} priority_name, count(*) n from d group by 1")
def dmesg_priority_names(t):
    return _kernel(t).groupBy(dmesg.priority_name(F.col("d.priority")).alias("priority_name")).agg(F.count(F.lit(1)).alias("n"))


@query(_DMESG + f"select {_CASE(dmesg.FACILITIES, 'facility')} facility_name, count(*) n from d group by 1")
def dmesg_facility_names(t):
    return _kernel(t).groupBy(dmesg.facility_name(F.col("d.facility")).alias("facility_name")).agg(F.count(F.lit(1)).alias("n"))


@query(_DMESG + f"select event_id, {_SUB} subsystem from d")
def dmesg_subsystem(t):
    return _kernel(t).select("event_id", "d.subsystem")


@query(_DMESG + "select event_id, epoch_us(boot_time) + cast(floor(ts * 1000000) as bigint) absolute_us from d where ok and boot_time is not null")
def dmesg_absolute(t):
    return _kernel(t).where(F.col("d.absolute_time").isNotNull()).select("event_id", F.unix_micros("d.absolute_time").alias("absolute_us"))


_DOUBLE = "regexp_replace(cast(cast(ts as decimal(38, 9)) as varchar), '[.]?0+$', '')"
_DM_JSON = r"""
select event_id, replace(replace(replace('{"raw":' || cast(to_json(x) as varchar) || ',"timestamp":' || """ + _DOUBLE + r""" || case when facility <> 0 then ',"facility":' || facility else '' end || case when priority <> 0 then ',"priority":' || priority else '' end
 || ',"subsystem":"' || """ + _SUB + r""" || '","message":' || cast(to_json(message) as varchar) || coalesce(case when ok then ',"absolute_time":"' || regexp_replace(strftime(make_timestamp(epoch_us(boot_time) + cast(floor(ts * 1000000) as bigint)), '%Y-%m-%dT%H:%M:%S.%f'), '[.]?0+$', '') || 'Z"' end, '') || '}',
 '<', '\u003c'), '>', '\u003e'), '&', '\u0026') "json" from d"""


@query(_DMESG + _DM_JSON)
def dmesg_json(t):
    return _kernel(t).select("event_id", dmesg.to_json(F.col("d")).alias("json"))


_ACCESS = csv.CsvOptions(has_headers=True, detect_types=True)
_FIELD = r'[ \t]*("[^"]*(?:""[^"]*)*"|[^",]*)'
_CSV = rf"""with t as (select file, line_no, {_TRIM.format('raw')} x from raw_lines), n as (select *, row_number() over (partition by file order by line_no) ln from t where x <> ''),
c as (select *, regexp_full_match(',' || x, '(,{_FIELD})+') ok, list_transform(regexp_extract_all(',' || x, ',{_FIELD}', 1), lambda v: case when v like '"%' then replace(v[2:-2], '""', '"') else v end) cs from n),
q as (select c.*, hd.cs head, fst.n0 from c left join (select file, cs from c where ln = 1 and ok) hd on hd.file = c.file left join (select file, arg_min(len(cs), ln) n0 from c where ok and ln > 1 group by 1) fst on fst.file = c.file),
y as (select file file_id, cast(ln as int) line_number, x raw, ok, cs, case when head is not null then head else list_transform(range(1, n0 + 1), lambda i: 'field_' || i) end nm from q where not (ln = 1 and ok)),
e as (select file_id, line_number, i, coalesce(nm[i], 'extra_field_' || i) "key", cs[i] "value" from y, unnest(range(1, len(cs) + 1)) u(i) where ok),
l as (select file_id, line_number, "key", arg_max("value", i) "value" from e group by 1, 2, 3) """


def _csv_rows(t) -> DataFrame:
    return csv.parsed(t("raw_lines"), "file", "line_no", "raw", _ACCESS)


@query(_CSV + 'select file_id, line_number, "key", "value" from l')
def csv_cells_long(t):
    return csv.fields(_csv_rows(t), csv.CsvOptions(has_headers=True)).select("file_id", "line_number", "key", "value")


_V = _TRIM.format('"value"')
_KIND = rf"""case when {_V} = '' then 'empty' when lower({_V}) in ('true','yes','1','on','false','no','0','off') then 'bool' when regexp_full_match({_V}, '[+-]?[0-9]+') and try_cast({_V} as bigint) is not null then 'int'
 when (regexp_full_match({_V}, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') and not isinf(try_cast({_V} as double))) or regexp_full_match(lower({_V}), '[+-]?(inf|infinity)|nan|[+-]?0x([0-9a-f]+\.?[0-9a-f]*|\.[0-9a-f]+)p[+-]?[0-9]+') then 'float'
 when try_strptime({_V}, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y/%m/%d %H:%M:%S', '%m/%d/%Y %H:%M:%S', '%Y-%m-%d', '%m/%d/%Y']) is not null then 'time' else 'string' end"""


@query(_CSV + f'select file_id, line_number, "key", {_KIND} kind from l')
def csv_types(t):
    return csv.fields(_csv_rows(t), _ACCESS).select("file_id", "line_number", "key", "kind")


@query(_CSV + "select file_id, line_number, 'failed to parse CSV line ' || line_number error from y where not ok")
def csv_quoted(t):
    """Lines whose quoting is broken."""
    return _csv_rows(t).where(F.col("error").isNotNull()).select("file_id", "line_number", "error")


@query(_CSV + "select \"key\", 'extra' what, count(*) n from l where \"key\" like 'extra_field_%' group by 1 union all select \"key\", 'missing', count(*) from (select nm[i] \"key\" from y, unnest(range(len(cs) + 1, len(nm) + 1)) u(i) where ok) group by 1")
def csv_extra_missing(t):
    """How often cells are beyond the header, and how often names of the header have no cell."""
    rows = _csv_rows(t)
    extra = csv.fields(rows, csv.CsvOptions(has_headers=True)).where(F.col("key").startswith("extra_field_")).select("key", F.lit("extra").alias("what"))
    lacking = rows.where("error is null").select(F.explode(F.slice("known", F.size("cells") + 1, F.greatest(F.size("known") - F.size("cells"), F.lit(0)))).alias("key"), F.lit("missing").alias("what"))
    return extra.unionByName(lacking).groupBy("key", "what").agg(F.count(F.lit(1)).alias("n"))


@query(_CSV + """, j as (select file_id, line_number, string_agg(cast(to_json("key") as varchar) || ':' || cast(to_json("value") as varchar), ',' order by "key") fs from l group by 1, 2)
select y.file_id, y.line_number, replace(replace(replace('{"raw":' || cast(to_json(raw) as varchar) || ',"fields":{' || fs || '},"line_number":' || y.line_number || '}', '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') "json" from y join j on j.file_id = y.file_id and j.line_number = y.line_number""")
def csv_json(t):
    return csv.to_json(_csv_rows(t), csv.CsvOptions(has_headers=True))


@query(_CSV + "select distinct file_id, len(nm) n_headers, nm[1] first_header from y where nm is not null")
def csv_headers(t):
    return csv.headers(_csv_rows(t)).where(F.col("headers").isNotNull()).select("file_id", F.size("headers").cast("long").alias("n_headers"), F.get("headers", F.lit(0)).alias("first_header"))


@query(_CSV + f", v as (select *, {_KIND} kind from l) select file_id, line_number, \"key\", case when kind = 'bool' then case when lower({_V}) in ('true','yes','1','on') then 'true' else 'false' end when kind = 'int' then cast(try_cast({_V} as bigint) as varchar) else \"value\" end string_value, case when kind in ('int', 'float') then try_cast({_V} as double) end float_value from v where \"key\" <> 'timestamp' and not (kind = 'float' and regexp_matches(lower({_V}), 'inf|nan|x'))")
def csv_values(t):
    """Cells as texts and as doubles, but the times and the numbers that are infinite or none."""
    rows = csv.fields(_csv_rows(t), _ACCESS).where((F.col("key") != "timestamp") & ~((F.col("kind") == "float") & F.lower("value").rlike("inf|nan|x")))
    double = F.when(F.col("kind").isin("int", "float"), csv.float_field(F.col("value"), F.col("kind")))
    return rows.select("file_id", "line_number", "key", csv.string_field(F.col("value"), F.col("kind")).alias("string_value"), double.alias("float_value"))


@query(_CSV + "select file_id, line_number, strftime(try_strptime(\"value\", '%Y-%m-%d %H:%M:%S'), '%Y-%m-%dT%H:%M:%SZ') \"value\" from l where \"key\" = 'timestamp' and regexp_full_match(\"value\", '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}') and try_strptime(\"value\", '%Y-%m-%d %H:%M:%S') is not null")
def csv_timestamp_field(t):
    o = csv.CsvOptions(has_headers=True, timestamp_field="timestamp", timestamp_format="yyyy-MM-dd HH:mm:ss")
    return csv.fields(_csv_rows(t), o).where(F.col("key") == "timestamp_parsed").select("file_id", "line_number", "value")


@query(_CSV + f", v as (select *, {_KIND} kind from l) select file_id, line_number, case when kind = 'int' then try_cast({_V} as bigint) when kind = 'float' and not regexp_matches(lower({_V}), 'inf|nan|x') then try_cast(trunc(try_cast({_V} as double)) as bigint) end int_value from v where \"key\" in ('status', 'bytes')")
def csv_accessors(t):
    rows = csv.fields(_csv_rows(t), _ACCESS).where(F.col("key").isin("status", "bytes"))
    return rows.select("file_id", "line_number", csv.int_field(F.col("value"), F.col("kind")).alias("int_value"))


@query("select line, file, ts from line_events where line <> ''")
def event_projection(t):
    return t("line_events").where(F.length("line") > 0).select("line", "file", "ts")


@query("select date_trunc('millisecond', ts) ts, 'collector-1' host, 'prod' env, line message from line_events where not contains(line, 'DEBUG')")
def sink_rows_ch(t):
    lines = t("line_events").where(filters.allowed(F.col("line"), [], ["DEBUG"]))
    return table_rows(lines, "collector-1", {"env": "prod"}, F.col("ts")).select("ts", "host", F.col("labels")["env"].alias("env"), "message")


@query("select strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' stamp, line message, 'collector-1' host from line_events where not contains(line, 'DEBUG')")
def sink_docs_os(t):
    lines = t("line_events").where(filters.allowed(F.col("line"), [], ["DEBUG"]))
    doc = sink_documents(lines, "collector-1", {"env": "prod"}, F.col("ts"))
    get = lambda k: F.get_json_object("doc", f"$['{k}']")
    return doc.select(get("@timestamp").alias("stamp"), get("message").alias("message"), get("host").alias("host"))


@query("select count(*) lines_total, cast(coalesce(sum(strlen(line)), 0) as bigint) bytes_total from line_events where line <> ''")
def metrics_lines_bytes(t):
    return line_totals(t("line_events"))


@query("select host_name, case when contains(line, 'DEBUG') then 'filtered' else 'enqueued' end reason, count(*) n from line_events group by 1, 2")
def sink_drop_counts(t):
    reason = F.when(filters.allowed(F.col("line"), [], ["DEBUG"]), "enqueued").otherwise("filtered")
    return t("line_events").groupBy("host_name", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_LE = ", ".join(f"{b}" for b in BATCH_BOUNDS)


@query(f"with b as (select batch_no, count(*) n from line_events group by 1) select cast(le as varchar) le, count(*) filter (n <= le) n from b, unnest([{_LE}]) u(le) group by le union all select '+Inf', count(*) from b")
def batch_histogram(t):
    sizes = t("line_events").groupBy("batch_no").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(buckets(F.col("n")).alias("b")).select(F.explode("b").alias("b")).select("b.le", "b.n")


@query("select case when contains(line, 'GET') or contains(line, 'POST') then 'access' when contains(line, 'sensor_') then 'sensors' when contains(line, chr(9)) then 'tsv' else 'access' end route, count(*) n from line_events group by 1")
def route_content(t):
    return t("line_events").groupBy(filters.content_kind(F.col("line")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("select event_id, status, bytes from access_log where status >= 400 or bytes > 10000")
def alerts(t):
    return t("access_log").where((F.col("status") >= 400) | (F.col("bytes") > 10000)).select("event_id", "status", "bytes")


@query("select event_id, case when status >= 400 then 'http_error' end a, case when bytes > 10000 then 'large_response' end b from access_log where status >= 400 or bytes > 10000")
def alerts_access(t):
    found = filters.alerts({"status": F.col("status"), "bytes": F.col("bytes")})
    has = lambda n: F.when(F.array_contains("found", n), n)
    return t("access_log").select("event_id", found.alias("found")).where(F.size("found") > 0).select("event_id", has("http_error").alias("a"), has("large_response").alias("b"))


@query("select 'high_temperature' alert, count(*) n from events where value > 30 union all select 'low_humidity', count(*) from events where user_id < 30 union all select 'high_value', count(*) from events where value > 100")
def alerts_sensors(t):
    """Sensor rules on the numbers of the events table."""
    found = filters.alerts({"temperature": F.col("value"), "humidity": F.col("user_id"), "value": F.col("value")})
    names = t("events").sparkSession.createDataFrame([(n,) for n in ("high_temperature", "low_humidity", "high_value")], "alert string")
    told = t("events").select(F.explode(found).alias("found")).groupBy("found").agg(F.count(F.lit(1)).alias("n"))
    return names.join(told, F.col("alert") == F.col("found"), "left").select("alert", F.coalesce("n", F.lit(0)).alias("n"))


@query(_DMESG + f"select event_id, {_SUB} = 'usb' usb, priority = 3 kernel_error from d where {_SUB} = 'usb' or priority = 3")
def alerts_kernel(t):
    found = filters.alerts({"subsystem": F.col("d.subsystem"), "priority_name": dmesg.priority_name(F.col("d.priority"))})
    rows = _kernel(t).select("event_id", found.alias("found")).where(F.size("found") > 0)
    return rows.select("event_id", *(F.array_contains("found", n).alias(n) for n in ("usb", "kernel_error")))


@query("select file, coalesce(bool_or(contains(line, 'timeout')), false) timed_out, coalesce(bool_or(contains(line, 'startup line')), false) started from line_events group by 1")
def markers(t):
    return t("line_events").groupBy("file").agg(*filters.markers(F.col("line"), {"timed_out": "timeout", "started": "startup line"}))


_SECONDS = ", ".join(f"'{b}'" for b in SECOND_BOUNDS)


@query(f"with b as (select duration n from access_log where not isnan(duration)) select le, count(*) filter (n <= try_cast(le as double)) n from b, unnest([{_SECONDS}]) u(le) group by le union all select '+Inf', count(n) from b")
def duration_histogram(t):
    seconds = t("access_log").where(~F.isnan("duration"))
    return seconds.agg(buckets(F.col("duration"), SECOND_BOUNDS).alias("b")).select(F.explode("b").alias("b")).select("b.le", "b.n")


@query(_AUDIT + ", hosts as (select event_id, host_name from line_events) select host_name, ty rec_type, count(*) n, count(distinct serial) n_serials, max(epoch_sec) last_sec from h join hosts using (event_id) group by 1, 2")
def flagship(t):
    """Audit lines of all files: parsed, joined with their events, and summed up by host and type."""
    rows = _audited(t).select("event_id", F.col("a.type").alias("rec_type"), "a.epoch_sec", "a.serial").join(t("line_events").select("event_id", "host_name"), "event_id")
    return rows.groupBy("host_name", "rec_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("serial").alias("n_serials"), F.max("epoch_sec").alias("last_sec"))


_AUDIT_FILES = "with l as (select file_id, byte_pos idx, arg_min(line, event_id) line from line_events where file_id is not null and byte_pos is not null and regexp_matches(file, '(^|/)audit[^/]*$') group by 1, 2)"
_RECORDS = f"from (select file_id || '#' || first_idx event_id, record raw from ({_ml_sql('haltBefore', _AUDIT_FILES, '^type=', '^type=')}) where contains(record, 'msg=audit('))"


@query(_PAIRS.replace("from audit_records", _RECORDS) + ", v as (select event_id, \"value\" res from f where \"key\" = 'res') select ty rec_type, coalesce(res, '') res, count(*) n, count(distinct serial) n_serials, max(epoch_sec) last_sec from h left join v using (event_id) group by 1, 2")
def flagship_chain(t):
    """The whole way of the audit logs: their files, kept lines, records of several lines, filter, parser with fields, sums."""
    rows = t("line_events").where(filters.included(F.col("file"), ["audit*"]) & F.col("file_id").isNotNull() & F.col("byte_pos").isNotNull())
    rows = rows.groupBy(F.col("byte_pos").alias("idx"), "file_id").agg(F.min_by("line", "event_id").alias("line"))
    found = multiline.grouped(rows, MultilineOptions("haltBefore", "^type=", "^type=", 1.0), block_lines=1 << 20)
    found = audit.parsed(found.where(filters.allowed(F.col("record"), ["msg=audit("])), "record", "a").where(F.col("a").isNotNull())
    rows = found.select(F.col("a.type").alias("rec_type"), F.coalesce(F.col("a.fields")["res"], F.lit("")).alias("res"), "a.serial", "a.epoch_sec")
    return rows.groupBy("rec_type", "res").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("serial").alias("n_serials"), F.max("epoch_sec").alias("last_sec"))
