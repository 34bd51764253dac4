"""Backfill planning and application."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.functions.intervals import at, interval_seconds, seconds_between
from candlewright.operators.gaps import match_candles
from candlewright.schemas import CANDLE_FIELDS, SERIES_KEY

CANDLES_PER_CHUNK = 300
NO_DATA = "no data available for gap period"


def backfill_plan(periods: DataFrame, candles_per_chunk: int = CANDLES_PER_CHUNK,
                  limit: int = None) -> DataFrame:
    """Periods cut into fetch chunks of at most ``candles_per_chunk`` candles.

    ``limit`` caps the candles of one period, as a fetch limit does.
    """
    step = interval_seconds(F.col("interval"))
    out = periods.withColumn("_step", step)
    if limit:
        reach = F.timestamp_seconds(F.unix_seconds("start_time") + F.col("_step") * limit)
        out = out.withColumn("end_time", F.least("end_time", reach))
    span = F.col("_step") * candles_per_chunk
    chunks = F.ceil(seconds_between(F.col("start_time"), F.col("end_time")) / span).cast("bigint")
    out = out.where(chunks > 0).withColumn(
        "chunk_no", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)))
    begin = F.unix_seconds("start_time") + F.col("chunk_no") * span
    chunk_end = F.least(F.timestamp_seconds(begin + span), F.col("end_time"))
    return out.withColumns({
        "chunk_start": F.timestamp_seconds(begin),
        "chunk_end": chunk_end,
        "candles": F.ceil((F.unix_seconds(chunk_end) - begin) / F.col("_step")).cast("bigint"),
    }).drop("_step")


def backfill_apply(gaps: DataFrame, source: DataFrame, as_of, permanent_after: int = None):
    """(gaps after the attempt, candles to upsert) from a second candle table.

    Every fillable gap is tried: with at least one candle inside it becomes
    filled, else it returns to detected with an error. ``permanent_after`` makes
    a gap permanent at that many failed attempts.
    """
    fillable = gaps.where(F.col("status") == "detected")
    found = match_candles(
        fillable.select(F.col("id").alias("gap_id"), *SERIES_KEY, "start_time", "end_time"),
        source.select(*SERIES_KEY, "timestamp", *CANDLE_FIELDS), include_end=False)
    counts = found.groupBy("gap_id").agg(F.count(F.lit(1)).alias("_found"))
    tried = F.col("status") == "detected"
    have = F.coalesce(F.col("_found"), F.lit(0)).cast("bigint")
    attempts = (F.col("attempts") + F.when(tried, 1).otherwise(0)).cast("int")
    given_up = F.lit(False) if permanent_after is None else attempts >= permanent_after
    failed = F.when(given_up, "permanent").otherwise("detected")
    after = (
        gaps.join(counts, gaps["id"] == counts["gap_id"], "left")
        .select(
            "id", *SERIES_KEY, "start_time", "end_time",
            F.when(tried & (have > 0), "filled").when(tried, failed).otherwise(F.col("status"))
            .alias("status"),
            "created_at",
            F.when(tried & (have > 0), at(as_of)).otherwise(F.col("filled_at")).alias("filled_at"),
            "priority", attempts.alias("attempts"),
            F.when(tried, at(as_of)).otherwise(F.col("last_attempt_at")).alias("last_attempt_at"),
            F.when(tried & (have > 0), F.lit(None).cast("string")).when(tried, NO_DATA)
            .otherwise(F.col("error_message")).alias("error_message"),
            tried.alias("was_tried"), F.when(tried, have).otherwise(0).alias("candles_found"))
    )
    return after, found.select("gap_id", *SERIES_KEY, "timestamp", *CANDLE_FIELDS)


def backfill_result(applied: DataFrame) -> DataFrame:
    """Totals of one ``backfill_apply`` run."""
    tried = F.col("was_tried")
    return applied.agg(
        F.count_if(tried).alias("gaps_processed"),
        F.count_if(tried & (F.col("status") == "filled")).alias("gaps_filled"),
        F.count_if(tried & (F.col("status") != "filled")).alias("gaps_failed"),
        F.count_if(tried & (F.col("status") == "permanent")).alias("gaps_marked_permanent"),
        F.coalesce(F.sum("candles_found"), F.lit(0)).cast("bigint").alias("candles_retrieved"))


def backfill_progress(gaps: DataFrame) -> DataFrame:
    """Queue state of the gap table; failed gaps are open ones with an error."""
    status = F.col("status")
    failed = (status == "detected") & (F.col("attempts") > 0) & F.col("error_message").isNotNull()
    counted = gaps.agg(
        F.count_if(status == "filling").alias("active_gaps"),
        F.count_if(status == "detected").alias("queued_gaps"),
        F.count_if(status == "filled").alias("completed_gaps"),
        F.count_if(failed).alias("failed_gaps"))
    done = F.col("completed_gaps") + F.col("failed_gaps")
    return counted.withColumn("success_rate", F.when(
        done > 0, F.col("completed_gaps") / done * 100).otherwise(0.0))
