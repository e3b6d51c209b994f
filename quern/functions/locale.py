"""Numbers, sizes, durations and times as a Turkish reader writes them, and paths as keys; all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import json_text, thousands

#: Short names of months and of sizes.
MONTHS = ("Oca", "Şub", "Mar", "Nis", "May", "Haz", "Tem", "Ağu", "Eyl", "Eki", "Kas", "Ara")
SIZES = ("B", "KB", "MB", "GB")


def _swapped(c: Column) -> Column:
    """Dots between thousands and a comma before the fraction."""
    return F.translate(c, ",.", ".,")


def decimal_text(value: Column) -> Column:
    return _swapped(F.format_number(F.round(value, 1), 1))


def percent_text(percentage: Column) -> Column:
    """24.8 -> %24,8"""
    return F.concat(F.when(percentage < 0, "-").otherwise(""), F.lit("%"), decimal_text(F.abs(percentage)))


def usd_text(value: Column) -> Column:
    """Two to four digits after the comma: 1.2345 -> $1,2345, 2 -> $2,00"""
    four = F.format_number(F.round(F.abs(value), 4), 4)
    short = F.regexp_replace(four, r"0{1,2}$", "")
    return F.concat(F.when(value < 0, "-").otherwise(""), F.lit("$"), _swapped(short))


def date_time_text(ts: Column) -> Column:
    """11 Ağu 2026 13:05, and a dash for no time."""
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(ts))
    return F.coalesce(F.concat(F.dayofmonth(ts).cast("string"), F.lit(" "), month, F.lit(" "), F.year(ts).cast("string"), F.lit(" "), F.date_format(ts, "HH:mm")), F.lit("—"))


def size_text(n: Column) -> Column:
    """Bytes in units of 1024: 133169152 -> 127,0 MB"""
    out = F.concat(thousands(n), F.lit(" B"))
    for k, unit in enumerate(SIZES[1:], 1):
        out = F.when(n >= 1024**k, F.concat(decimal_text(n / float(1024**k)), F.lit(f" {unit}"))).otherwise(out)
    return out


def duration_text(seconds: Column) -> Column:
    """3725 -> 1 sa 2 dk"""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    hours, minutes = F.floor(s / 3600).cast("string"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("string")
    return F.when(s >= 3600, F.concat(hours, F.lit(" sa "), minutes, F.lit(" dk"))).when(s >= 60, F.concat(minutes, F.lit(" dk"))).otherwise(F.concat(s.cast("string"), F.lit(" sn")))


def normalized_path(path: Column) -> Column:
    """One slash between parts, one before and none behind."""
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(path, "/+", "/"), "^/|/$", ""))


def storage_key(method: Column, path: Column, key: Column, prefix: str = "idempotency") -> Column:
    """The key of a stored response: prefix and a JSON list of method, path and key."""
    return F.concat(F.lit(prefix + ":["), json_text(F.upper(method)), F.lit(","), json_text(normalized_path(path)), F.lit(","), json_text(key), F.lit("]"))
