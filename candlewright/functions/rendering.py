"""One-line text forms for reports."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
_PLAIN = "yyyy-MM-dd HH:mm:ss"


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, _ISO)


def duration_text(seconds: Column) -> Column:
    """Hours, minutes and seconds, e.g. ``1h0m0s``; leading zero units are left out."""
    h = F.floor(seconds / 3600).cast("bigint")
    m = F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("bigint")
    s = F.pmod(seconds, F.lit(60)).cast("bigint")
    return (
        F.when(h > 0, F.format_string("%dh%dm%ds", h, m, s))
        .when(m > 0, F.format_string("%dm%ds", m, s))
        .otherwise(F.format_string("%ds", s))
    )


def render_candle() -> Column:
    return F.format_string(
        "Candle{Pair: %s, Interval: %s, Timestamp: %s, O: %s, H: %s, L: %s, C: %s, V: %s}",
        "pair", "interval", iso_utc(F.col("timestamp")),
        *[F.col(f).cast("string") for f in ("open", "high", "low", "close", "volume")])


def priority_label(priority: Column) -> Column:
    return (
        F.when(priority == 0, "low").when(priority == 1, "medium")
        .when(priority == 2, "high").when(priority == 3, "critical").otherwise("unknown")
    )


def render_gap() -> Column:
    seconds = F.unix_seconds("end_time") - F.unix_seconds("start_time")
    return F.format_string(
        "Gap{ID: %s, Pair: %s, Duration: %s, Status: %s, Priority: %s}",
        "id", "pair", duration_text(seconds), "status", priority_label(F.col("priority")))


# Fixed value: how a time that was never set is written.
NO_TIME = "0001-01-01 00:00:00"


def render_job() -> Column:
    """A job in one line; times that were not set are written as the zero time."""
    return F.format_string(
        "Job %s: %s %s on %s [%s to %s] - Status: %s (%d%% complete, %d records)",
        "id", "type", "interval", "pair",
        F.coalesce(F.date_format("start_time", _PLAIN), F.lit(NO_TIME)),
        F.coalesce(F.date_format("end_time", _PLAIN), F.lit(NO_TIME)),
        "status", F.col("progress"), F.col("records_collected"))
