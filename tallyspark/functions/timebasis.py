"""Declared time bases: recorded wall clock to UTC, with daylight-saving verdicts."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds and step of a fixed offset, in minutes.
MIN_OFFSET, MAX_OFFSET, OFFSET_STEP = -720, 840, 15


def create_time_basis(kind: str, offset_minutes: int | None = None, zone: str | None = None) -> dict:
    """A checked declaration: UTC, FIXED_OFFSET (minutes) or IANA (zone)."""
    if kind == "UTC":
        if offset_minutes is not None or zone is not None:
            raise ValueError("CONFLICTING_FIELDS")
    elif kind == "FIXED_OFFSET":
        if zone is not None:
            raise ValueError("CONFLICTING_FIELDS")
        if isinstance(offset_minutes, bool) or not isinstance(offset_minutes, int):
            raise ValueError("INVALID_OFFSET")
        if not MIN_OFFSET <= offset_minutes <= MAX_OFFSET or offset_minutes % OFFSET_STEP:
            raise ValueError("INVALID_OFFSET")
    elif kind == "IANA":
        if offset_minutes is not None:
            raise ValueError("CONFLICTING_FIELDS")
        if not zone or zone not in zoneinfo.available_timezones():
            raise ValueError("UNKNOWN_ZONE")
    else:
        raise ValueError("UNKNOWN_KIND")
    return {"kind": kind, "offset_minutes": offset_minutes, "zone": zone}


def _minutes_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MINUTE", earlier, later)


def to_utc(local: Column, kind: Column, offset_minutes: Column, zone: Column) -> Column:
    """struct(utc, verdict): verdict is VALID, AMBIGUOUS or NONEXISTENT; utc only if VALID.

    For a zone, the offsets a day before and a day after are tried; each gives a
    candidate instant, which counts if it reads back as the wall clock.
    """
    wall = local.cast("timestamp")
    tz = F.coalesce(zone, F.lit("UTC"))
    day = F.expr("interval 24 hours")

    def candidate(at: Column) -> Column:
        offset = _minutes_between(F.from_utc_timestamp(at, tz), at)
        instant = F.timestamp_add("MINUTE", -offset, wall)
        return F.when(F.from_utc_timestamp(instant, tz) == wall, instant)

    first, second = candidate(wall - day), candidate(wall + day)
    found = F.coalesce(first, second)
    verdict = (
        F.when(found.isNull(), "NONEXISTENT").when(first.isNotNull() & second.isNotNull() & (first != second), "AMBIGUOUS").otherwise("VALID")
    )
    in_zone = F.struct(F.when(verdict == "VALID", found).alias("utc"), verdict.alias("verdict"))
    shifted = F.when(kind == "FIXED_OFFSET", F.timestamp_add("MINUTE", -offset_minutes, wall)).otherwise(wall)
    return F.when(kind == "IANA", in_zone).otherwise(F.struct(shifted.alias("utc"), F.lit("VALID").alias("verdict")))
