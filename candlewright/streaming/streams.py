"""Candle operators on unbounded input.

State is kept per series and is bounded by the watermark; the stateful
processors hold one candle per series plus the rows not yet released.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.functions.intervals import seconds_of
from candlewright.operators.resample import fits_into
from candlewright.operators.validate import validate_candles
from candlewright.schemas import CANDLE_KEY, DECIMAL

# Rows may arrive this much late; later ones go through the correction path.
LATENESS = "5 minutes"


def ingest_dedup(candles: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """First arrival of every candle key."""
    return candles.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(CANDLE_KEY)


def resample(candles: DataFrame, interval: str, lateness: str = LATENESS,
             slide: str = None) -> DataFrame:
    """Coarser candles of each source interval, each emitted once its window is complete.

    With ``slide`` the windows overlap.
    """
    width = f"{seconds_of(interval)} seconds"
    offset = "4 days" if interval == "1w" else "0 seconds"
    window = F.window("timestamp", width, slide or width, offset)
    return (
        candles.withWatermark("timestamp", lateness)
        .groupBy("pair", fits_into(F.col("interval"), interval).alias("source_interval"), window.alias("w"))
        .agg(F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"),
             F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close"),
             F.sum("volume").cast(DECIMAL).alias("volume"))
        .select("pair", F.lit(interval).alias("interval"), F.col("w.start").alias("timestamp"),
                "open", "high", "low", "close", "volume", "source_interval")
    )


def ticks_to_candles(ticks: DataFrame, interval: str, lateness: str = LATENESS) -> DataFrame:
    """Ticks (pair, ts, tick_id, price, size) to candles, emitted when complete."""
    order = F.struct("ts", "tick_id")
    return (
        ticks.withWatermark("ts", lateness)
        .groupBy("pair", F.window("ts", f"{seconds_of(interval)} seconds").alias("w"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"),
             F.min("price").alias("low"), F.max_by("price", order).alias("close"),
             F.sum("size").alias("volume"))
        .select("pair", F.lit(interval).alias("interval"), F.col("w.start").alias("timestamp"),
                *[F.col(c).cast(DECIMAL).alias(c) for c in ("open", "high", "low", "close", "volume")])
    )


def validate(raw: DataFrame) -> DataFrame:
    """First broken rule of each candle; stateless."""
    return validate_candles(raw)


def sessions(rows: DataFrame, quiet: str, lateness: str = LATENESS) -> DataFrame:
    """Activity sessions per pair; what lies between them is found by ``ordered.outages``."""
    return (
        rows.withWatermark("timestamp", lateness)
        .groupBy("pair", F.session_window("timestamp", quiet).alias("s"))
        .agg(F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first_seen"),
             F.max("timestamp").alias("last_seen"))
        .select("pair", "first_seen", "last_seen", "rows")
    )


def on_time(rows: DataFrame, as_of_column: str = "received_at", seconds: int = 300) -> DataFrame:
    """Flag rows that arrive later than the tolerance; they need the batch path."""
    delay = F.unix_seconds(as_of_column) - F.unix_seconds("timestamp")
    return rows.withColumn("is_late", delay > seconds)
