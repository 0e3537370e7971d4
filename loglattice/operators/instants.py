"""Time texts of many layouts, precisions and zones as UTC instants in microseconds.

One alternation with named groups recognises every layout. It is run once a row, as a replacement that writes the
captured components into a fixed order; the rest is integer arithmetic in the JVM: calendar ranges are checked, days
are counted by a closed formula, and offsets are subtracted. Local times are resolved against the zone's rules with a
check in both directions, so that times a zone has twice or never are found.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.session import fresh, pinned

DAY_US = 86_400_000_000
#: The result for a text that is no valid time, or a local time that its zone has twice or never.
UNFIXABLE = -1

# English month names, in order of the calendar.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_MON = "|".join(MONTHS)
_DOW = "Mon|Tue|Wed|Thu|Fri|Sat|Sun"
_ZONE = r"(?:{a}|{g}{i}(?::?{j})?)"
#: Layouts by name. Upper-case letters in braces stand for the components of COMPONENTS.
LAYOUTS = {
    "iso": r"{Y}-{M}-{D}[Tt ]{h}:{m}:{s}(?:[.,]{f})?(?: ?" + _ZONE + r"(?:\[[\w/+-]+\])?)?",
    "basic": r"{Y}{M}{D}[Tt]{h}{m}{s}(?:[.,]{f})?(?: ?" + _ZONE + r")?",
    "slash_year_first": r"{Y}/{M}/{D}[Tt ]{h}:{m}:{s}(?:[.,]{f})?(?: ?" + _ZONE + r")?",
    "slash_month_first": r"{M}/{D}/{Y}[ ,]{h}:{m}:{s}(?:[.,]{f})?(?: ?{p})?(?: ?" + _ZONE + r")?",
    "dot_day_first": r"{D}\.{M}\.{Y}[ ,]{h}:{m}:{s}(?:[.,]{f})?(?: ?" + _ZONE + r")?",
    "mail": r"(?:(?:" + _DOW + r"), ?)?{d} {n} {Y} {h}:{m}:{s}(?: " + _ZONE + r")?",
    "clf": r"{d}/{n}/{Y}:{h}:{m}:{s}(?: " + _ZONE + r")?",
    "ctime": r"(?:" + _DOW + r") {n} +{d} {h}:{m}:{s} {Y}",
    "epoch": r"{e}(?:\.{f})?",
}
COMPONENTS = {
    "Y": r"\d{4}", "M": r"\d\d", "D": r"\d\d", "d": r"\d\d?", "n": _MON, "h": r"\d\d", "m": r"\d\d", "s": r"\d\d",
    "f": r"\d+", "p": r"[AaPp][Mm]", "a": r"[Zz]|[A-Z]{2,5}", "g": r"[+-]", "i": r"\d\d", "j": r"\d\d", "e": r"\d{1,18}",
}
#: What the replacement writes, in this order; M and n are alternatives, as are D and d.
ORDER = ("Y", "M", "n", "D", "d", "h", "m", "s", "f", "p", "a", "g", "i", "j", "e")
_SEP = "\u0001"


@lru_cache(1)
def compiled() -> tuple[str, str]:
    """The alternation over all layouts, and the replacement that lists its components."""
    parts, groups = [], {c: [] for c in ORDER}
    for k, (_, layout) in enumerate(sorted(LAYOUTS.items())):
        text = layout
        for c, pattern in COMPONENTS.items():
            if "{" + c + "}" in text:
                case = "u" if c.isupper() else "l"
                group = f"{case}{c}{k}"
                groups[c].append(group)
                text = text.replace("{" + c + "}", f"(?<{group}>{pattern})")
        parts.append(text)
    swap = _SEP + _SEP.join("".join("${" + g + "}" for g in groups[c]) for c in ORDER)
    return r"\A(?:" + "|".join(parts) + r")\z", swap


@lru_cache(1)
def abbreviations() -> list[tuple[str, str, int]]:
    """(zone, abbreviation, offset in seconds) for every zone of the tz database, from its rules for 2000 to 2037.

    The later meaning counts where a zone used an abbreviation for two offsets. About 2,000 rows: bounded by the database.
    """
    from datetime import datetime, timezone
    from zoneinfo import ZoneInfo, available_timezones

    at = [datetime(y, m, 15, tzinfo=timezone.utc) for y in range(2000, 2038, 1) for m in (1, 4, 7, 10)]
    found: dict[tuple[str, str], int] = {}
    for zone in sorted(available_timezones()):
        info = ZoneInfo(zone)
        for t in at:
            local = t.astimezone(info)
            if (name := local.tzname()) and name.isalpha():
                found[zone, name] = int(local.utcoffset().total_seconds())
    return [(zone, name, off) for (zone, name), off in sorted(found.items())]


def civil_days(y: Column, m: Column, d: Column) -> Column:
    """Days from 1970-01-01 to a date of the Gregorian calendar, for years from 0."""
    shifted = y + F.when(m <= 2, 399).otherwise(400)
    month = m + F.when(m > 2, -3).otherwise(9)
    of = lambda a, b: F.call_function("div", a, F.lit(b))
    return shifted * 365 + of(shifted, 4) - of(shifted, 100) + of(shifted, 400) + of(month * 153 + 2, 5) + d - 1 - 719468 - 146097


def month_days(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def known_zone(df: DataFrame, zone: str) -> Column:
    """The column ``zone`` where it is a zone that the JVM knows (about 600, bounded by the tz database), else null."""
    return F.when(F.col(zone).isin(*sorted(df.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds())), F.col(zone))


def zone_offset(at_us: Column, zone: Column) -> Column:
    """Microseconds by which a zone is ahead of UTC at an instant."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(at_us), zone)) - at_us


def with_local_instant(df: DataFrame, wall_us: str, zone: str, out: str) -> DataFrame:
    """Adds ``out``: the instant of a wall clock (microseconds as if UTC) in a zone.

    Null for a null wall clock or a null or unknown zone; UNFIXABLE for a time that the zone has twice or never.
    """
    o1, o2, hit, z = fresh([*df.columns, out], "off1", "off2", "hit", "tz")
    w, tz = F.col(wall_us), F.col(z)
    df = df.withColumn(z, F.when(w.isNotNull(), known_zone(df, zone)))
    df = df.withColumns({o1: zone_offset(w - DAY_US, tz), o2: zone_offset(w + DAY_US, tz)})
    a, b = w - F.col(o1), w - F.col(o2)
    hits = F.when(F.col(o1) == F.col(o2), F.lit(1)).otherwise((zone_offset(a, tz) == F.col(o1)).cast("int") + 2 * (zone_offset(b, tz) == F.col(o2)).cast("int"))
    value = F.when(F.col(hit) == 1, a).when(F.col(hit) == 2, b).otherwise(F.lit(UNFIXABLE))
    return pinned(pinned(df, hit, hits), out, F.when(tz.isNotNull(), value).cast("long")).drop(o1, o2, hit, z)


def with_instant(df: DataFrame, text: str, zone: str, out: str) -> DataFrame:
    """Adds ``out``: the instant of the time in column ``text``, for hosts in the IANA zone of column ``zone``.

    Null text gives null; a text of no known layout, with a component out of range, of an unknown zone abbreviation, or
    a local time without a known zone or that the zone has twice or never gives UNFIXABLE, as do bare numbers of more
    than 18 digits (bare numbers count seconds, milliseconds or microseconds). Digits past microseconds are cut off.
    Other columns stay as they are, whatever they are called; equal and repeated rows stay.
    """
    spark: SparkSession = df.sparkSession
    pattern, swap = compiled()
    names = ("y", "mo", "dd", "h", "mi", "s", "us", "e", "add")
    p, wall, off, abbr, local, zkey, akey, aoff, lw, *nums = fresh([*df.columns, out], "parts", "wall", "off", "abbr", "local", "zkey", "akey", "aoff", "lw", *names)
    at = {c: F.col(p)[i + 1] for i, c in enumerate(ORDER)}
    df = df.withColumn(p, F.split(F.regexp_replace(F.regexp_replace(F.col(text), r"(?U)\A\s+|\s+\z", ""), pattern, swap), _SEP))
    df = pinned(df, p, F.when((F.size(p) == len(ORDER) + 1) & (F.col(p)[0] == ""), F.col(p)))
    num = lambda c: at[c].try_cast("long")
    half = F.when(at["p"] == "", F.lit(0)).when(F.upper(at["p"]) == "AM", F.lit(1)).otherwise(F.lit(2))
    month = F.when(at["n"] == "", num("M")).otherwise(F.call_function("div", F.instr(F.lit("".join(MONTHS)), at["n"]) + 2, F.lit(3)))
    digits = F.length(at["e"])
    df = df.withColumns(dict(zip(nums, (
        num("Y"), month.cast("long"), F.when(at["D"] == "", num("d")).otherwise(num("D")), num("h") + 100 * half, num("m"), num("s"),
        F.rpad(F.substring(at["f"], 1, 6), 6, "0").cast("long"), num("e"), F.when(digits <= 11, 1_000_000).when(digits <= 14, 1000).otherwise(1),
    ))))
    y, mo, dd, h, mi, s, us, e, unit = map(F.col, nums)
    clock12, hh = h >= 100, h % 100
    hour = F.when(clock12, hh % 12 + F.when(h >= 200, 12).otherwise(0)).otherwise(hh)
    valid = mo.between(1, 12) & (dd >= 1) & (dd <= month_days(y, mo)) & (mi <= 59) & (s <= 59) & (hh <= 23) & (~clock12 | hh.between(1, 12))
    clock = ((civil_days(y, mo, dd) * 24 + hour) * 60 + mi) * 60 + s
    utc = F.upper(at["a"]).isin("Z", "UTC", "GMT", "UT")
    minutes = num("i") * 60 + F.coalesce(num("j"), F.lit(0))
    fixed = (num("i") <= 23) & (F.coalesce(num("j"), F.lit(0)) <= 59)
    df = df.withColumns({
        wall: F.when(e.isNotNull(), e * unit + F.call_function("div", us * unit, F.lit(1_000_000))).when(valid, clock * 1_000_000 + us),
        off: F.when(e.isNotNull() | utc, F.lit(0)).when(at["g"] != "", F.when(fixed, minutes * F.when(at["g"] == "-", -60).otherwise(60))).cast("long"),
        abbr: F.when((at["a"] != "") & ~utc, at["a"]).when(e.isNull() & (at["a"] == "") & (at["g"] == ""), F.lit("local")),
    })
    df = df.drop(p, *nums)
    rules = spark.createDataFrame(abbreviations(), f"`{zkey}` string, `{akey}` string, `{aoff}` long")
    df = df.join(F.broadcast(rules), (F.col(zone) == F.col(zkey)) & (F.col(abbr) == F.col(akey)), "left")
    df = with_local_instant(df.withColumn(lw, F.when(F.col(abbr) == "local", F.col(wall))), lw, zone, local)
    value = F.when(F.col(abbr) == "local", F.col(local)).otherwise(F.col(wall) - F.coalesce(F.col(off), F.col(aoff)) * 1_000_000)
    return pinned(df, out, F.when(F.col(text).isNotNull(), F.coalesce(value, F.lit(UNFIXABLE)).cast("long"))).drop(wall, off, abbr, zkey, akey, aoff, lw, local)


#: An RFC 3339 text in UTC, which needs no repair if its calendar values are in range.
RFC3339_Z = r"\A\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])[Tt](?:[01]\d|2[0-3]):[0-5]\d:(?:[0-5]\d|60)(?:\.\d+)?Z\z"
_STAMP = r"audit\((\d{1,11})(?:\.(\d+))?:\d+\)"
_CTIME = r"\A\s*(?:<\d+>)?\[\s*([A-Z][a-z]{2} [A-Z][a-z]{2} +\d{1,2} \d\d:\d\d:\d\d \d{4})\]"


def audit_stamp_us(raw: Column) -> Column:
    """The instant of an audit record's stamp; null without one."""
    sec = F.regexp_extract(raw, _STAMP, 1).try_cast("long")
    return sec * 1_000_000 + F.rpad(F.substring(F.regexp_extract(raw, _STAMP, 2), 1, 6), 6, "0").cast("long")


def with_host_zone(df: DataFrame, hosts: DataFrame, host: str, zone: str, mode: str | None = None) -> DataFrame:
    """Adds the zone (and clock mode) of each row's host; a small dimension, broadcast when Spark measures it as small."""
    h = fresh(df.columns, "host")[0]
    dim = hosts.groupBy(F.col("host_name").alias(h)).agg(F.min_by("tz_name", F.struct("tz_name", "clock_mode")).alias(zone), F.min_by("clock_mode", F.struct("tz_name", "clock_mode")).alias(mode or fresh(df.columns, "mode")[0]))
    out = df.join(dim, F.col(host) == F.col(h), "left").drop(h)
    return out if mode else out.drop(fresh(df.columns, "mode")[0])


def with_arrival_instant(df: DataFrame, ts: str, zone: str, mode: str, out: str) -> DataFrame:
    """Adds the instant of a collector's ``ts``: as it is for hosts whose clock is UTC, else the wall clock of the zone."""
    w, loc = fresh([*df.columns, out], "wall", "loc")
    df = df.withColumn(w, F.when(F.col(mode) == "local", F.unix_micros(F.col(ts).cast("timestamp"))))
    df = with_local_instant(df, w, zone, loc)
    return df.withColumn(out, F.when(F.col(mode) == "local", F.coalesce(F.col(loc), F.when(F.col(ts).isNotNull(), F.lit(UNFIXABLE)))).otherwise(F.unix_micros(F.col(ts).cast("timestamp"))).cast("long")).drop(w, loc)


def unlike_times(access: DataFrame, dmesg: DataFrame, audit: DataFrame, events: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, event_id, instant_us) of every time written in another form than the plain one.

    Access texts and kernel records with a calendar time need the host; both are joined to the events in one shuffle.
    Rows whose event or host is unknown keep their case: times with an offset are fixed, local ones are UNFIXABLE.
    """
    texts = access.where(F.col("access_ts").isNotNull() & ~F.col("access_ts").rlike(RFC3339_Z)).select("event_id", F.lit("access").alias("src"), F.col("access_ts").alias("txt"))
    booted = F.col("boot_time").isNotNull() & F.col("boot_secs").isNotNull()
    calendar = F.regexp_extract("raw", _CTIME, 1)
    kernel = dmesg.where(~booted & F.col("raw").rlike(_CTIME)).select("event_id", F.lit("dmesg").alias("src"), calendar.alias("txt"))
    lines = events.select(F.col("event_id").alias("e_id"), "host_name")
    texts = texts.unionByName(kernel)
    texts = with_host_zone(texts.join(lines, texts.event_id == lines.e_id, "left"), hosts, "host_name", "zone")
    texts = with_instant(texts, "txt", "zone", "instant_us").select("src", "event_id", "instant_us")
    booted_us = F.try_add(F.unix_micros(F.col("boot_time").cast("timestamp")), F.round(F.col("boot_secs") * 1e6).try_cast("long"))
    since = dmesg.where(booted).select(F.lit("dmesg").alias("src"), "event_id", F.coalesce(booted_us, F.lit(UNFIXABLE)).cast("long").alias("instant_us"))
    odd = (F.col("epoch_sec") >= 100_000_000_000) | (F.col("epoch_sec") <= -100_000_000_000)
    stamps = audit.where(odd).select(F.lit("audit").alias("src"), "event_id", F.coalesce(audit_stamp_us(F.col("raw")), F.lit(UNFIXABLE)).cast("long").alias("instant_us"))
    clocks = with_host_zone(events.where(F.col("ts").isNotNull()).select("event_id", "ts", "host_name"), hosts, "host_name", "zone", "mode").where(F.col("mode") == "local")
    clocks = with_arrival_instant(clocks, "ts", "zone", "mode", "instant_us").select(F.lit("line").alias("src"), "event_id", "instant_us")
    return texts.unionByName(since).unionByName(stamps).unionByName(clocks)
