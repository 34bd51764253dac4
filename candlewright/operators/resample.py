"""Ticks to candles, and candles to coarser candles."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewright.functions.intervals import DAY, interval_seconds, seconds_of
from candlewright.schemas import DECIMAL

# Weeks start on Monday; epoch day 0 is a Thursday, so Monday is day 4.
_MONDAY_OFFSET = 4 * DAY
# Supported target timeframes.
TIMEFRAMES = ["1m", "5m", "15m", "1h", "4h", "1d", "1w"]


def slot_start(ts: Column, interval: str) -> Column:
    """Start of the candle that holds ``ts``."""
    step = seconds_of(interval)
    offset = _MONDAY_OFFSET if interval == "1w" else 0
    unix = F.unix_seconds(ts)
    return F.timestamp_seconds(unix - F.pmod(unix - offset, F.lit(step)))


def _arrival_order(ts: Column, tie: Column) -> Column:
    """(time, tie) as one decimal.

    A fixed-width ordering value keeps ``min_by``/``max_by`` in the hash
    aggregate; a struct would force a sort-based one on the raw ticks.
    """
    shift = F.lit(str(2**64)).cast("decimal(20,0)")
    return F.unix_micros(ts).cast("decimal(17,0)") * shift + tie.cast("decimal(19,0)")


def ticks_to_candles(ticks: DataFrame, interval: str, tie=("tick_id",)) -> DataFrame:
    """Ticks (pair, ts, price, size, tie-break columns) to candles.

    Partial aggregation runs before the shuffle, so a pair with a third of all
    ticks sends one row per slot and map task, not its ticks.
    """
    tie = list(tie)
    order = (_arrival_order(F.col("ts"), F.col(tie[0])) if len(tie) == 1
             else F.struct("ts", *tie))
    return (
        ticks.groupBy("pair", slot_start(F.col("ts"), interval).alias("timestamp"))
        .agg(
            F.min_by("price", order).alias("open"), F.max("price").alias("high"),
            F.min("price").alias("low"), F.max_by("price", order).alias("close"),
            F.sum("size").alias("volume"),
        )
        .select(
            "pair", F.lit(interval).alias("interval"), "timestamp",
            *[F.col(c).cast(DECIMAL).alias(c) for c in ("open", "high", "low", "close", "volume")])
    )


def fits_into(source: Column, interval: str) -> Column:
    """``source``; fails on an interval that ``interval`` is no multiple of."""
    step = interval_seconds(source)
    fits = F.coalesce(F.pmod(F.lit(seconds_of(interval)), step) == 0, F.lit(False))
    return F.when(fits, source).otherwise(F.raise_error(F.concat(
        F.lit("cannot resample "), F.coalesce(source, F.lit("NULL")), F.lit(f" to {interval}"))))


def resample_candles(candles: DataFrame, interval: str) -> DataFrame:
    """First open, highest high, lowest low, last close, total volume.

    A table may hold several intervals of a pair; each is resampled on its own and
    named in ``source_interval``. The target must be a multiple of every one.
    """
    if interval not in TIMEFRAMES:
        raise ValueError(f"unsupported timeframe: {interval!r}")
    return (
        candles.groupBy("pair", fits_into(F.col("interval"), interval).alias("source_interval"),
                        slot_start(F.col("timestamp"), interval).alias("slot"))
        .agg(
            F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"),
            F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select(
            "pair", F.lit(interval).alias("interval"), F.col("slot").alias("timestamp"),
            "open", "high", "low", "close", F.col("volume").cast(DECIMAL).alias("volume"), "source_interval")
    )
