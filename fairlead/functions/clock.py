"""Times at the boundary: local clocks, model cycles and quantised hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_to_epoch(text: Column, zone: Column) -> Column:
    """Seconds since 1970 of a local clock reading in an IANA zone, which may differ from row to row."""
    return F.unix_timestamp(F.to_utc_timestamp(F.to_timestamp(text, "yyyy-MM-dd HH:mm:ss"), zone)).cast("double")


def utc_to_epoch(text: Column) -> Column:
    """Seconds since 1970 of ISO text in UTC, with a Z or an offset."""
    return F.unix_micros(F.to_timestamp(text)).cast("double") / 1e6


def latest_cycle(now: Column, delay_h: float = 5.0, hours: tuple[int, ...] = (0, 6, 12, 18)) -> Column:
    """Start of the latest model cycle that is out ``delay_h`` hours after it; before the day's first, the last of the day before."""
    known = F.timestamp_micros((F.unix_micros(now) - int(delay_h * 3_600_000_000)))
    ready = F.array_max(F.filter(F.array(*[F.lit(h) for h in sorted(hours)]), lambda h: h <= F.hour(known)))
    day = F.date_trunc("day", known)
    past = F.timestamp_micros(F.unix_micros(day) - (24 - max(hours)) * 3_600_000_000)
    return F.when(ready.isNull(), past).otherwise(F.timestamp_micros(F.unix_micros(day) + ready.cast("long") * 3_600_000_000))


def previous_cycle(cycle: Column, hours: tuple[int, ...] = (0, 6, 12, 18)) -> Column:
    return latest_cycle(F.timestamp_micros(F.unix_micros(cycle) - 1), 0.0, hours)


def cycle_text(cycle: Column) -> tuple[Column, Column]:
    return F.date_format(cycle, "yyyyMMdd"), F.date_format(cycle, "HH")


def quantised_hour(h: Column) -> Column:
    return F.rint(h)


def etag(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
