"""Kernel ring buffer records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglattice.functions.json import escaped, number, quoted

# The layout of a record, names of priorities, facilities and known subsystems, in their natural order.
LINE = r"(?s)\A(?:<(\d+)>)?\[[ \t\n\f\r]*(\d+(?:\.\d+)?)\][ \t\n\f\r]*([^\n]*)\z"
SUBSYSTEM = r"\A([a-zA-Z][a-zA-Z0-9_-]*)[ \t\n\f\r]*[^\n]*?:"
PRIORITIES = ("emergency", "alert", "critical", "error", "warning", "notice", "info", "debug")
FACILITIES = ("kernel", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp", "ntp", "security", "console", "solaris-cron", *(f"local{i}" for i in range(8)))
KNOWN = (
    "kernel", "usb", "net", "pci", "acpi", "cpu", "memory", "disk", "filesystem", "block", "scsi", "ata", "sound", "input", "thermal", "power", "bluetooth", "wifi",
    "ethernet", "bridge", "firewall", "systemd", "docker", "kvm", "xen",
)
_SPACES = r"(?U)\A\s+|\s+\z"
#: The first and last microsecond of the years 1 to 9999, which every consumer of timestamps can hold.
CALENDAR_US = (-62_135_596_800_000_000, 253_402_300_799_999_999)


def subsystem(message: Column) -> Column:
    """The word that begins a message with a colon, else a known first word, else what some phrases stand for, else ''."""
    named = F.regexp_extract(message, SUBSYSTEM, 1)
    first = F.lower(F.regexp_extract(message, r"(?U)\A\s*(\S+)", 1))
    told = F.when(F.contains(message, F.lit("Linux version")), "kernel").when(F.contains(message, F.lit("systemd[")), "systemd").when(F.contains(message, F.lit("docker")), "docker").otherwise("")
    return F.when(named != "", named).when(first.isin(*KNOWN), first).otherwise(told)


def parse(line: Column, boot_time: Column | None = None) -> Column:
    """A struct raw, timestamp, facility, priority, subsystem, message, boot_time, absolute_time; null for blank lines.

    A line of another layout is its own message, at time 0. A priority whose facility is no 32-bit number counts as 0.
    The absolute time is cut off to microseconds, and null outside the years 1 to 9999.
    """
    text = F.regexp_replace(line, _SPACES, "")
    part = lambda k: F.regexp_extract(text, LINE, k)
    ours = text.rlike(LINE)
    said = part(1).try_cast("long")
    prio = F.coalesce(F.when(F.shiftright(said, 3) <= 2**31 - 1, said), F.lit(0).cast("long"))
    seconds = F.coalesce(part(2).try_cast("double"), F.lit(0.0))
    message = F.when(ours, F.regexp_replace(part(3), _SPACES, "")).otherwise(text)
    boot = F.lit(None).cast("timestamp") if boot_time is None else boot_time.cast("timestamp")
    at_us = F.try_add(F.unix_micros(boot), F.floor(seconds * 1_000_000).try_cast("long"))
    at = F.timestamp_micros(F.when(at_us.between(*CALENDAR_US), at_us))
    return F.when(text != "", F.struct(
        text.alias("raw"), F.when(ours, seconds).otherwise(0.0).alias("timestamp"), F.when(ours, F.shiftright(prio, 3)).otherwise(0).cast("int").alias("facility"),
        F.when(ours, prio.bitwiseAND(F.lit(7))).otherwise(0).cast("int").alias("priority"), F.when(ours, subsystem(message)).otherwise("").alias("subsystem"), message.alias("message"),
        F.lit(None).cast("timestamp").alias("boot_time"), F.when(ours, at).alias("absolute_time")))


def priority_name(priority: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, PRIORITIES)), priority), F.lit("unknown"))


def facility_name(facility: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, FACILITIES)), facility), F.lit("unknown"))


def to_json(record: Column) -> Column:
    """The record as JSON, with facility, priority and times left out where they are 0 or unknown; <, > and & escaped."""
    some = lambda n: F.when(record[n] != 0, F.concat(F.lit(f',"{n}":'), record[n].cast("string"))).otherwise("")
    text = lambda n: F.concat(F.lit(f',"{n}":'), quoted(record[n]))
    stamp = F.regexp_replace(F.date_format(record["absolute_time"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"(?:\.0+|(\.\d*?)0+)\z", "$1")
    at = F.coalesce(F.concat(F.lit(',"absolute_time":"'), stamp, F.lit('Z"')), F.lit(""))
    return escaped(F.concat(F.lit('{"raw":'), quoted(record["raw"]), F.lit(',"timestamp":'), number(record["timestamp"]), some("facility"), some("priority"), text("subsystem"), text("message"), at, F.lit("}")))
