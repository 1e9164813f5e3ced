"""Log time formats to UTC timestamps, as column expressions.

The session time zone is expected to be UTC (``palisade.session.use_utc``).  A
format is chosen by the shape of the text, so that a row pays for one parse and
never for a chain of failing ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of the accepted times, and the format of each.
CLF = r"^\d{1,2}/[A-Za-z]{3}/\d{4}:\d{1,2}:\d{1,2}:\d{1,2}"
CLF_FORMAT = "d/MMM/yyyy:H:m:s"
ISO_BLANK = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"
ISO_T = r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,6})?(?:Z|[+-]\d\d:?\d\d)?$"
SYSLOG = r"^[A-Za-z]{3} \d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"
SYSLOG_FORMAT = "yyyy MMM d H:m:s"
ZONE_AT_END = r"(?:Z|[+-]\d\d:?\d\d)$"


def from_local(ts: Column, zone: str) -> Column:
    """A time without zone is wall-clock time of ``zone``."""
    return ts if zone == "UTC" else F.to_utc_timestamp(ts, zone)


def parse_timestamp(
    c: Column, zone: str = "UTC", year: Column | None = None, fmt: str | None = None
) -> Column:
    """UTC time of a log time text, NULL when no known format fits.

    A time without a year takes ``year`` (default: the current one); one without
    an offset is wall-clock time of ``zone``.  ``fmt`` is tried first when given.
    """
    t = F.regexp_replace(F.btrim(c, F.lit(" \t\n\r\x0b\x0c")), r"\s+", " ")
    year = F.year(F.current_timestamp()) if year is None else year
    zoned = t.rlike(ZONE_AT_END)
    iso = t.try_cast("timestamp")
    dated = F.concat(year.cast("string"), F.lit(" "), t)
    known = (
        F.when(t.rlike(CLF + " .*:"), F.try_to_timestamp(t, F.lit(CLF_FORMAT + " XXX")))
        .when(t.rlike(CLF + " "), F.try_to_timestamp(t, F.lit(CLF_FORMAT + " Z")))
        .when(t.rlike(CLF + "$"), from_local(F.try_to_timestamp(t, F.lit(CLF_FORMAT)), zone))
        .when(t.rlike(ISO_BLANK), from_local(iso, zone))
        .when(t.rlike(ISO_T), F.when(zoned, iso).otherwise(from_local(iso, zone)))
        .when(t.rlike(SYSLOG), from_local(F.try_to_timestamp(dated, F.lit(SYSLOG_FORMAT)), zone))
    )
    if fmt is None:
        return known
    return F.coalesce(from_local(F.try_to_timestamp(t, F.lit(fmt)), zone), known)


def iso_text(ts: Column) -> Column:
    """``2025-12-09T10:00:00`` with a fraction only when there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.unix_micros(ts) % 1000000
    return F.when(part == 0, whole).otherwise(F.concat(whole, F.date_format(ts, ".SSSSSS")))


def display_text(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("-"))
