"""Interval strings, time grids and boundaries."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60, 3600, 86400

# Accepted interval names outside the ``<count><unit>`` form.
NAMED_SECONDS = {"1w": 7 * DAY, "1M": 30 * DAY}
UNIT_SECONDS = {"m": MINUTE, "h": HOUR, "d": DAY}

# Intervals with a calendar boundary of their own.
BOUNDARY_INTERVALS = ["1m", "5m", "15m", "30m", "1h", "2h", "4h", "6h", "12h", "1d"]

# Intervals a collection job may name.
JOB_INTERVALS = ["1m", "5m", "15m", "30m", "1h", "2h", "4h", "6h", "12h", "1d", "3d", "1w", "1M"]

# Counts have nine digits at most: a billion days is beyond any timestamp.
_PATTERN = r"^([0-9]{1,9})([mhd])$"


def seconds_of(interval: str) -> int:
    """Length of an interval name in seconds; raises on anything malformed."""
    if interval in NAMED_SECONDS:
        return NAMED_SECONDS[interval]
    match = re.match(_PATTERN, interval or "")
    if not match or int(match.group(1)) == 0:
        raise ValueError(f"invalid interval: {interval!r}")
    return int(match.group(1)) * UNIT_SECONDS[match.group(2)]


def interval_seconds(interval: Column) -> Column:
    """Same as :func:`seconds_of` for a column; NULL when malformed."""
    count = F.regexp_extract(interval, _PATTERN, 1).try_cast("bigint")
    unit = F.regexp_extract(interval, _PATTERN, 2)
    # Usual names are compared as text; the pattern is only for the unusual ones.
    out = F
    for name in JOB_INTERVALS:
        out = out.when(interval == name, F.lit(seconds_of(name)).cast("bigint"))
    for name, size in UNIT_SECONDS.items():
        out = out.when((unit == name) & (count > 0), count * F.lit(size).cast("bigint"))
    return out


def floor_to(ts: Column, seconds) -> Column:
    """Start of the epoch-aligned slot that holds ``ts``."""
    unix = F.unix_seconds(ts)
    return F.timestamp_seconds(unix - F.pmod(unix, seconds))


def ceil_to(ts: Column, seconds) -> Column:
    """First slot start at or after ``ts``."""
    micros, width = F.unix_micros(ts), F.lit(1_000_000).cast("bigint") * seconds
    return F.timestamp_micros(micros + F.pmod(-micros, width))


def next_boundary(ts: Column, interval: Column) -> Column:
    """The next interval boundary strictly after ``ts``; other intervals use the hour."""
    step = F.when(interval.isin(BOUNDARY_INTERVALS), interval_seconds(interval)).otherwise(
        F.lit(HOUR).cast("bigint"))
    unix = F.unix_seconds(ts)
    return F.timestamp_seconds(unix - F.pmod(unix, step) + step)


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end``."""
    return F.unix_seconds(end) - F.unix_seconds(start)


def at(moment) -> Column:
    """A timestamp literal from text or a Column, so ``as_of`` can be either."""
    if isinstance(moment, Column):
        return moment
    return F.lit(moment).cast("timestamp")
