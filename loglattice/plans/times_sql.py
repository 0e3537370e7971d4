"""The queries on times, in SQL: texts are rewritten to one layout, local times are tried against the zone's offsets a day before and after."""

from __future__ import annotations

_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
# Abbreviations of the zones of the hosts, with their offsets in hours.
_ABBREVIATIONS = {
    "America/New_York": {"EST": -5, "EDT": -4}, "America/Chicago": {"CST": -6, "CDT": -5}, "America/Los_Angeles": {"PST": -8, "PDT": -7}, "Europe/Berlin": {"CET": 1, "CEST": 2}, "Europe/London": {"BST": 1},
    "Asia/Kolkata": {"IST": 5.5}, "Asia/Tokyo": {"JST": 9}, "Australia/Sydney": {"AEST": 10, "AEDT": 11},
}
_ABBR = ", ".join(f"('{z}', '{a}', {int(h * 3600)})" for z, names in _ABBREVIATIONS.items() for a, h in names.items())


def _offset(us: str) -> str:
    sec = f"floor(({us}) / 1000000.0)"
    return f"(epoch_us(timezone(tz_name, to_timestamp({sec}))) - 1000000 * try_cast({sec} as bigint))"


def _local(rows: str, name: str, wall: str) -> str:
    """CTEs that add ``instant`` to rows with a wall clock and tz_name."""
    day = 86_400_000_000
    return f"""{name}1 as (select *, {_offset(f'{wall} - {day}')} o1, {_offset(f'{wall} + {day}')} o2 from {rows}),
{name}2 as (select *, {_offset(f'{wall} - o1')} = o1 h1, {_offset(f'{wall} - o2')} = o2 h2 from {name}1),
{name} as (select * exclude (o1, o2, h1, h2), case when {wall} is null then null when o1 = o2 or (h1 and not h2) then {wall} - o1 when h2 and not h1 then {wall} - o2 else -1 end instant from {name}2)"""


def _named(pattern: str, day: int, month: int, year: int, rest: str) -> str:
    part = lambda k: f"regexp_extract(x, '{pattern}', {k})"
    return f"{part(year)} || '-' || lpad(try_cast((strpos('{_MONTHS}', {part(month)}) + 2) // 3 as varchar), 2, '0') || '-' || lpad({part(day)}, 2, '0') || ' ' || {part(rest)}"


_DOW, _MON = "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)", "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_MAIL, _CLF, _CTIME = rf"^(?:{_DOW}, ?)?(\d\d?) {_MON} (\d{{4}}) (\d\d:.*)$", rf"^(\d\d?)/{_MON}/(\d{{4}}):(.*)$", rf"^{_DOW} {_MON} +(\d\d?) (\d\d:\d\d:\d\d) (\d{{4}})$"
_ISO = r"^(\d{4})-(\d\d)-(\d\d)[Tt ](\d\d):(\d\d):(\d\d)(?:[.,](\d+))?(?: ?([AaPp][Mm]))?(?: ?([Zz]|[A-Z]{2,5}|[+-]\d\d:?\d\d))?(?:\[[\w/+-]+\])?$"


def texts(rows: str) -> str:
    """CTEs up to ``fixed`` (event_id, src, us) for rows (event_id, src, txt, tz_name)."""
    us = "try_cast(left(rpad({}, 6, '0'), 6) as bigint)"
    return rf"""x1 as (select *, regexp_replace(txt, '^\s+|\s+$', '', 'g') x from {rows}),
x2 as (select *, case when regexp_matches(x, '^\d{{8}}T\d{{6}}') then regexp_replace(x, '^(\d{{4}})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)', '\1-\2-\3 \4:\5:\6') when regexp_matches(x, '^\d{{4}}/') then regexp_replace(x, '^(\d{{4}})/(\d\d)/', '\1-\2-')
 when regexp_matches(x, '^\d\d/\d\d/\d{{4}} ') then regexp_replace(x, '^(\d\d)/(\d\d)/(\d{{4}})', '\3-\1-\2') when regexp_matches(x, '^\d\d\.\d\d\.\d{{4}} ') then regexp_replace(x, '^(\d\d)\.(\d\d)\.(\d{{4}})', '\3-\2-\1')
 when regexp_matches(x, '{_MAIL}') then {_named(_MAIL, 1, 2, 3, 4)} when regexp_matches(x, '{_CLF}') then {_named(_CLF, 1, 2, 3, 4)} when regexp_matches(x, '{_CTIME}') then {_named(_CTIME, 2, 1, 4, 3)} else x end iso from x1),
x3 as (select *, regexp_matches(iso, '{_ISO}') ok, regexp_extract(iso, '{_ISO}', ['y', 'mo', 'd', 'h', 'mi', 's', 'f', 'p', 'z']) p, case when regexp_matches(x, '^\d{{1,18}}(\.\d+)?$') then x end ep from x2),
x4 as (select *, try_cast(p.h as int) hh, try_cast(p.y || '-' || p.mo || '-' || p.d as date) dt from x3),
x5 as (select *, case when ok and dt is not null and p.mi <= '59' and p.s <= '59' and hh <= 23 and (p.p = '' or hh between 1 and 12)
 then epoch_us(try_cast(dt as timestamp)) + ((case when p.p = '' then hh else hh % 12 + case when upper(p.p) = 'PM' then 12 else 0 end end * 60 + try_cast(p.mi as bigint)) * 60 + try_cast(p.s as bigint)) * 1000000 + {us.format('p.f')} end wall,
 case when upper(p.z) in ('Z', 'UTC', 'GMT') then 0 when regexp_matches(p.z, '^[+-]') then case when p.z[2:3] <= '23' then (case when p.z[1] = '-' then -1 else 1 end) * (try_cast(p.z[2:3] as bigint) * 60 + try_cast(replace(p.z, ':', '')[4:5] as bigint)) * 60 end end off from x4),
x6 as (select x5.*, coalesce(off, a.secs) total from x5 left join (values {_ABBR}) a(zone, abbr, secs) on a.zone = tz_name and a.abbr = p.z),
x7 as (select event_id, src, tz_name, ep, p.z z, wall, total from x6), {_local('x7', 'x8', "(case when z = '' then wall end)")},
fixed as (select event_id, src, coalesce(case when ep is not null then case when length(split_part(ep, '.', 1)) <= 11 then try_cast(split_part(ep, '.', 1) as bigint) * 1000000 + {us.format("split_part(ep, '.', 2)")}
 when length(split_part(ep, '.', 1)) <= 14 then try_cast(split_part(ep, '.', 1) as bigint) * 1000 + {us.format("split_part(ep, '.', 2)")} // 1000 else try_cast(split_part(ep, '.', 1) as bigint) end
 when z = '' then instant else wall - total * 1000000 end, -1) us from x8)"""


_HOSTED = "h as (select event_id, tz_name, clock_mode, ts from line_events left join log_hosts using (host_name))"
_CLOCKS = f"c0 as (select event_id, tz_name, epoch_us(ts) wall from h where clock_mode = 'local' and ts is not null), {_local('c0', 'clocks', 'wall')}"
_RFC_Z = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$"
_STAMP = r"audit\((\d+)(?:\.(\d+))?:\d+\)"
_RAW_TIME = r"^(?:<\d+>)?\[([A-Z][a-z]{2} [A-Z][a-z]{2} +\d{1,2} \d\d:\d\d:\d\d \d{4})\]"

P1_FOUND = f"""with {_HOSTED}, {_CLOCKS},
t as (select event_id, 'access' src, access_ts txt, tz_name from access_log left join h using (event_id) where access_ts is not null and not regexp_matches(access_ts, '{_RFC_Z}')
 union all select event_id, 'dmesg', regexp_extract(raw, '{_RAW_TIME}', 1), tz_name from dmesg_records left join h using (event_id) where (boot_time is null or boot_secs is null) and regexp_matches(raw, '{_RAW_TIME}')),
{texts('t')}
select src, event_id, us instant_us from fixed union all select 'line', event_id, instant from clocks
union all select 'audit', event_id, try_cast(regexp_extract(raw, '{_STAMP}', 1) as bigint) * 1000000 + try_cast(left(rpad(regexp_extract(raw, '{_STAMP}', 2), 6, '0'), 6) as bigint) from audit_records where abs(epoch_sec) >= 100000000000
union all select 'dmesg', event_id, epoch_us(boot_time) + try_cast(round(boot_secs * 1000000) as bigint) from dmesg_records where boot_time is not null and boot_secs is not null"""

_TIMED = f"""with {_HOSTED}, {_CLOCKS}, t as (select event_id, 'access' src, access_ts txt, tz_name from access_log left join h using (event_id) where access_ts is not null), {texts('t')},
v as (select fixed.event_id, fixed.us, fixed.us // 3600000000 hour_no, (case when clock_mode = 'local' then clocks.instant else epoch_us(ts) end) arrival from fixed join h using (event_id) left join clocks on clocks.event_id = fixed.event_id where us <> -1),
w as (select event_id, hour_no, arrival - (hour_no + 1) * 3600000000 late from v where arrival is not null and arrival <> -1),
verdicts as (select event_id, hour_no, case when late < 0 then 'base' when late < 21600000000 then 'amend' else 'cut' end verdict from w)
"""
P3_FOUND = _TIMED + "select event_id, hour_no, verdict from verdicts where verdict <> 'base'"
P3_HOURS = (
    _TIMED
    + """select hour_no, count(*) n, try_cast(sum(try_cast(verdict = 'amend' as int)) as bigint) n_amended, try_cast(coalesce(sum(bytes), 0) as bigint) bytes, try_cast(coalesce(sum(try_cast(round(duration * 1000000) as bigint)), 0) as bigint) duration_us,
 count(distinct coalesce(file, '')) n_sources from verdicts join access_log using (event_id) join (select event_id, file from line_events) using (event_id) where verdict <> 'cut' group by 1"""
)
