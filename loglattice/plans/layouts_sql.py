"""The entries of logs, in SQL: kept copies, one expression for each layout, running maxima over whole files."""

from __future__ import annotations

from loglattice.operators.layouts import LEVELS

_DAY = r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d"
_LAYOUTS = {
    "glog": (r"^([DIWEFCN])\d{4} \d\d:\d\d:\d\d(?:\.\d+)? +\d+ ([^\s:\]]+):\d+\]", 1, 2), "dashed": (rf"^{_DAY},\d+ - (\S+) - ([A-Za-z]+) -", 2, 1), "thread": (rf"^{_DAY},\d+ +([A-Za-z]+) +\[[^\]]*\] (\S+) -", 1, 2),
    "bracket": (rf"^\[{_DAY}\] (\S+)\.([A-Za-z]+):", 2, 1), "syslog": (r"^[A-Z][a-z]{2} +\d{1,2} \d\d:\d\d:\d\d \S+ ([^\s\[\]:]+)(?:\[\d+\])?: ?(.*)$", 2, 1),
}
_WORDS = "|".join(w for ws in LEVELS.values() for w in ws if len(w) > 1)
_SAID = rf"^(?:<(?i:(?:{_WORDS}))>|\[(?i:(?:{_WORDS}))\]|(?i:(?:{_WORDS})):|(?:{_WORDS.upper()})\s)"
_LEVEL = "case " + " ".join("when lower(w) in (" + ", ".join(f"'{n}'" for n in names) + f") then '{level}'" for level, names in LEVELS.items()) + " else '' end"
_NAMES, _PARTS = "level|lvl|severity", "component|logger|module"


def _pair(names: str) -> str:
    return rf"""coalesce(nullif(regexp_extract(regexp_replace(x, '"[^"]*"', '""', 'g'), '\s(?:{names})=([^\s"]+)', 1), ''), regexp_extract(x, '\s(?:{names})="([^"]*)"', 1))"""


def _json(names: str) -> str:
    return "coalesce(" + ", ".join(f"case when json_valid(x) then json_extract_string(x, '$.{n}') end" for n in names.split("|")) + ", '')"


def _field(names: str) -> str:
    return rf"""regexp_extract(x, '^\s+"(?:{names})": "(.*)",?$', 1)"""


_WORD = "case kind " + " ".join(f"when '{k}' then regexp_extract(x, '{p}', {a})" for k, (p, a, _) in _LAYOUTS.items() if k != "syslog")
_COMP = "case kind " + " ".join(f"when '{k}' then regexp_extract(x, '{p}', {b})" for k, (p, _, b) in _LAYOUTS.items())
_SYS = rf"when 'syslog' then regexp_replace(regexp_extract(regexp_extract(x, '{_LAYOUTS['syslog'][0]}', 2), '{_SAID}', 0), '[^A-Za-z]', '', 'g')"
P7_FOUND = rf"""with k as (select file_id, byte_pos, min(event_id) event_id, arg_min(line, event_id) line, contains(arg_min(file, event_id), 'dmesg') kernel from line_events
 where not contains(file, '.csv') and not contains(file, 'audit') and file_id is not null and byte_pos is not null group by 1, 2),
a as (select *, regexp_replace(line, '\s+$', '') x from k),
b as (select *, case when kernel then null {' '.join(f"when regexp_matches(x, '{p}') then '{k}'" for k, (p, _, _) in _LAYOUTS.items())} when regexp_matches(x, '^(?:time|ts|t)=\S+ ') then 'pairs'
 when regexp_matches(x, '^\{{".*\}}$') then 'json' when x = '{{' then 'open' end kind from a),
c as (select *, {_WORD} {_SYS} when 'pairs' then {_pair(_NAMES)} when 'json' then {_json(_NAMES)} end hw, {_COMP} when 'pairs' then {_pair(_PARTS)} when 'json' then {_json(_PARTS)} end hc,
 {_field(_NAMES)} fw, {_field(_PARTS)} fc, max(case when kind is not null then byte_pos end) over (partition by file_id order by byte_pos) head from b where not kernel),
e as (select file_id, head, count(*) n_lines, min(case when byte_pos = head then event_id end) event_id, min(case when byte_pos = head then kind end) kind, min(case when byte_pos = head then hw end) hw, min(case when byte_pos = head then hc end) hc,
 arg_min(fw, byte_pos) filter (fw <> '') fw, arg_min(fc, byte_pos) filter (fc <> '') fc from c where head is not null group by 1, 2),
f as (select event_id, n_lines, case when kind = 'open' then coalesce(fw, '') else coalesce(hw, '') end w, case when kind = 'open' then coalesce(fc, '') else coalesce(hc, '') end component from e),
m as (select event_id, length(x) - length(replace(x, chr(10), '')) + 1 n_lines, try_cast(regexp_extract(x, '^<(\d+)>\[', 1) as int) % 8 pr, regexp_extract(x, '^\s*(?:<\d+>)?\[\s*[^\]\n]*\]\s*([^\n]*)', 1) msg from b where kernel)
select event_id, n_lines, {_LEVEL} lvl, component from f union all
select event_id, n_lines, case when pr <= 2 then 'FATAL' when pr = 3 then 'ERROR' when pr = 4 then 'WARN' when pr <= 6 then 'INFO' when pr = 7 then 'DEBUG' else '' end, regexp_extract(msg, '^([^\s:\[]+)[^:]*:', 1) from m"""

_REST = r"((?s:.*))$"
#: Whole entries: expression, and its groups for level, time, component and message.
_WHOLE = {
    "glog": (r"^([DIWEFCN])(\d{4} \d\d:\d\d:\d\d(?:\.\d+)?) +\d+ ([^\s:\]]+):\d+\] ?" + _REST, 1, 2, 3, 4), "dashed": (rf"^({_DAY},\d+) - (\S+) - ([A-Za-z]+) - ?" + _REST, 3, 1, 2, 4),
    "thread": (rf"^({_DAY},\d+) +([A-Za-z]+) +\[[^\]]*\] (\S+) - ?" + _REST, 2, 1, 3, 4), "bracket": (rf"^\[({_DAY})\] (\S+)\.([A-Za-z]+): ?" + _REST, 3, 1, 2, 4),
    "syslog": (r"^([A-Z][a-z]{2} +\d{1,2} \d\d:\d\d:\d\d) \S+ ([^\s\[\]:]+)(?:\[\d+\])?: ?" + _REST, None, 1, 2, 3),
}
_TIMES, _MESSAGES = "time|ts|timestamp", "msg|message"


def _of_kind(which: int, pairs: str, json: str) -> str:
    """One component of a line by its kind."""
    some = " ".join(f"when '{k}' then regexp_extract(x, '{g[0]}', {g[which]})" for k, g in _WHOLE.items() if g[which])
    said = f"regexp_extract(x, '{_WHOLE['syslog'][0]}', 3)"
    syslog = rf"when 'syslog' then regexp_replace(regexp_extract({said}, '{_SAID}', 0), '[^A-Za-z]', '', 'g')" if which == 1 else ""
    if which == 4:
        some = some.replace(f"when 'syslog' then {said}", f"when 'syslog' then ltrim(regexp_replace({said}, '{_SAID}', ''))")
    return f"case kind {some} {syslog} when 'pairs' then {pairs} when 'json' then {json} end"


_SAID_MESSAGE = rf"""coalesce(nullif(regexp_extract(regexp_replace(x, '"(?:[^"\\]|\\.)*"', '""', 'g'), '\s(?:{_MESSAGES})=([^\s"]+)', 1), ''), replace(regexp_extract(x, '\s(?:{_MESSAGES})="((?:[^"\\]|\\.)*)"', 1), '\"', '"'))"""
_FIELD_TIME = rf"""coalesce(nullif(regexp_extract(x, '^\s+"(?:{_TIMES})": "(.*)",?$', 1), ''), regexp_extract(x, '^\s+"(?:{_TIMES})": (\d+),?$', 1))"""
_KERNEL = r"'^\s*(?:<\d+>)?\[\s*([^\]\n]*)\]\s*((?s:.*))$'"


def entries_sql(texts_of) -> str:
    """Entries with time, instant and message; ``texts_of`` makes the CTEs that turn (event_id, src, txt, tz_name) into instants."""
    return rf"""with k as (select file_id, byte_pos, min(event_id) event_id, arg_min(line, event_id) line, contains(arg_min(file, event_id), 'dmesg') kernel, arg_min(host_name, event_id) host_name, arg_min({{ts: ts}}, event_id).ts ts from line_events
 where not contains(file, '.csv') and not contains(file, 'audit') and file_id is not null and byte_pos is not null group by 1, 2),
a as (select *, regexp_replace(line, '\s+$', '') x from k),
b as (select *, case when kernel then null {' '.join(f"when regexp_matches(x, '{g[0]}') then '{k}'" for k, g in _WHOLE.items())} when regexp_matches(x, '^(?:time|ts|t)=\S+ ') then 'pairs'
 when regexp_matches(x, '^\{{".*\}}$') then 'json' when x = '{{' then 'open' end kind from a),
c as (select *, {_of_kind(1, _pair(_NAMES), _json(_NAMES))} hw, {_of_kind(2, r"regexp_extract(x, '^(?:time|ts|t)=(\S+) ', 1)", _json(_TIMES))} ht, {_of_kind(3, _pair(_PARTS), _json(_PARTS))} hc, {_of_kind(4, _SAID_MESSAGE, _json(_MESSAGES))} hm,
 {_field(_NAMES)} fw, {_FIELD_TIME} ft, {_field(_PARTS)} fc, {_field(_MESSAGES)} fm, max(case when kind is not null then byte_pos end) over (partition by file_id order by byte_pos) head from b where not kernel),
e as (select file_id, head, count(*) n_lines, {', '.join(f'min(case when byte_pos = head then {v} end) {v}' for v in ('event_id', 'kind', 'hw', 'ht', 'hc', 'hm', 'host_name', 'ts'))}, {', '.join(f"arg_min({v}, byte_pos) filter ({v} <> '') {v}" for v in ('fw', 'ft', 'fc', 'fm'))},
 string_agg(x, chr(10) order by byte_pos) filter (byte_pos <> head) follow from c where head is not null group by 1, 2),
f as (select event_id, n_lines, host_name, ts, false kernel, coalesce(case when kind = 'open' then fw else hw end, '') w, coalesce(case when kind = 'open' then fc else hc end, '') component, coalesce(case when kind = 'open' then ft else ht end, '') time_text,
 case when kind = 'open' then coalesce(fm, '') else coalesce(hm, '') || coalesce(chr(10) || follow, '') end message from e),
m as (select event_id, host_name, ts, length(x) - length(replace(x, chr(10), '')) + 1 n_lines, try_cast(regexp_extract(x, '^<(\d+)>\[', 1) as bigint) % 8 pr, regexp_extract(x, {_KERNEL}, 1) time_text, case when regexp_matches(x, {_KERNEL}) then regexp_extract(x, {_KERNEL}, 2) else x end rest from b where kernel),
n as (select *, regexp_extract(rest, '^([^\s:\[]+)[^:\n]*:', 1) component from m),
g as (select event_id, n_lines, {_LEVEL} lvl, component, time_text, message, host_name, ts, kernel from f union all
 select event_id, n_lines, case when pr <= 2 then 'FATAL' when pr = 3 then 'ERROR' when pr = 4 then 'WARN' when pr <= 6 then 'INFO' when pr = 7 then 'DEBUG' else '' end, component, time_text,
 case when component <> '' then regexp_replace(rest, '^[^\n]*?:(?:[ \t\r\f]+|(\n)|$)', '\1') else rest end, host_name, ts, true from n),
y as (select *, regexp_extract(time_text, '^([A-Z][a-z]{{2}}) +(\d{{1,2}}) (\S+)$', ['mon', 'd', 'clock']) s, ts + interval 1 day lim from g),
z as (select *, case when s.mon <> '' then lpad(cast((strpos('JanFebMarAprMayJunJulAugSepOctNovDec', s.mon) + 2) // 3 as varchar), 2, '0') || lpad(s.d, 2, '0') else left(time_text, 4) end md from y),
dated as (select *, cast(year(lim) - cast(md > strftime(lim, '%m%d') as int) as varchar) yr from z),
t as (select event_id, 'entry' src, tz_name, coalesce(case when s.mon <> '' then s.d || ' ' || s.mon || ' ' || yr || ' ' || s.clock when regexp_matches(time_text, '^\d{{4}} \d\d:') then yr || '-' || md[1:2] || '-' || md[3:4] || substr(time_text, 5) end, time_text) txt
 from dated left join log_hosts using (host_name) where time_text <> '' and not (kernel and not regexp_matches(time_text, '^[A-Z]'))),
{texts_of('t')}
select g.event_id, n_lines, lvl, component, time_text, message, us instant_us from g left join fixed on fixed.event_id = g.event_id"""
