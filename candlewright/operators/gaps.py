"""Missing periods of candle series."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.intervals import (
    DAY, HOUR, at, ceil_to, floor_to, interval_seconds, seconds_between,
)
from candlewright.operators.query import in_months
from candlewright.operators.series import BUCKET, SLOTS_PER_BUCKET, look_up, running, time_bucket, transitions
from candlewright.operators.totals import with_empty_row
from candlewright.schemas import SERIES_KEY

RECENT_SECONDS = 5 * 60
MAX_ATTEMPTS = 5
MAX_AGE_SECONDS = 30 * DAY

# Slots per bucket of the candle-in-gap join.
JOIN_SLOTS = 64

_STEP = "_step"


def _series_bounds(series: DataFrame, start, end, align: bool, keep=()) -> DataFrame:
    """Series with step length and the detection range in whole slots.

    ``stop`` is the first slot start at or after the range end, counted from
    ``start``: a run that reaches it ends the range.
    """
    step = interval_seconds(F.col("interval"))
    out = series.select(*SERIES_KEY, *keep, step.alias(_STEP), at(start).alias("lo"), at(end).alias("hi"))
    if align:
        out = out.withColumn("lo", ceil_to(F.col("lo"), F.col(_STEP)))
        out = out.withColumn("hi", floor_to(F.col("hi"), F.col(_STEP)))
    slots = F.ceil(
        (F.unix_micros("hi") - F.unix_micros("lo")) / (F.col(_STEP) * F.lit(1_000_000)))
    return out.where((F.col(_STEP) > 0) & (F.col("hi") > F.col("lo"))).withColumn(
        "slots", slots.cast("bigint")
    ).withColumn("stop", F.timestamp_micros(
        F.unix_micros("lo") + F.col("slots") * F.col(_STEP) * F.lit(1_000_000)))


def series_of(candles: DataFrame) -> DataFrame:
    """The series present in a candle table."""
    return candles.select(*SERIES_KEY).distinct()


def gaps_in_range(candles: DataFrame, start, end, series: DataFrame = None, align: bool = True,
                  slots_per_bucket: int = SLOTS_PER_BUCKET) -> DataFrame:
    """Maximal missing runs ``[start_time, end_time)`` on the grid from ``start``.

    No grid is generated: candles on the grid are compared with their
    predecessor, and two sentinels per series stand for the range ends.
    ``align`` moves the range to interval boundaries first; without it the grid
    starts exactly at ``start``. Pass ``series`` to cover series without candles.
    """
    # The range is expressed from the interval itself, not by a join with the
    # series: the filter then reaches the scan and candles shuffle once.
    step = interval_seconds(F.col("interval"))
    lo, hi = at(start), at(end)
    first = ceil_to(lo, step) if align else lo
    upper = floor_to(hi, step) if align else hi
    grid_lo, seconds = F.unix_seconds(first), F.unix_seconds("timestamp")
    wanted = series_of(candles if series is None else series)
    if series is not None:
        candles = candles.join(wanted, SERIES_KEY, "left_semi")
    rows = (
        in_months(candles, start, end).where((F.col("timestamp") >= lo) & (F.col("timestamp") < hi))
        .where((seconds >= grid_lo) & (F.col("timestamp") < upper)
               & (F.pmod(seconds - grid_lo, step) == 0))
        # Slot numbers relative to the range start.
        .select(*SERIES_KEY, F.floor((seconds - grid_lo) / step).cast("bigint").alias("slot"))
        .withColumn(BUCKET, F.floor(F.col("slot") / F.lit(slots_per_bucket)).cast("bigint"))
        .repartition("pair", BUCKET)
    )
    inside = Window.partitionBy(*SERIES_KEY, BUCKET).orderBy("slot")
    inner = rows.select(*SERIES_KEY, F.lag("slot").over(inside).alias("after"), F.col("slot").alias("before"))
    ends = rows.groupBy(*SERIES_KEY, BUCKET).agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    across = Window.partitionBy(*SERIES_KEY).orderBy(BUCKET)
    # Sentinels before and after the range also speak for series without any
    # candle on the grid. On the partitioned layout the series list needs no data.
    slot = F.col("_s.slot")
    sentinels = _series_bounds(wanted, start, end, align).select(
        *SERIES_KEY, F.explode(F.array(
            F.struct(F.lit(-1).cast("bigint").alias(BUCKET), F.lit(-1).cast("bigint").alias("slot")),
            F.struct(F.col("slots").alias(BUCKET), F.col("slots").alias("slot")))).alias("_s"),
    ).select(*SERIES_KEY, F.col(f"_s.{BUCKET}").alias(BUCKET), slot.alias("lo"), slot.alias("hi"))
    edges = ends.unionByName(sentinels).select(
        *SERIES_KEY, F.lag("hi").over(across).alias("after"), F.col("lo").alias("before"))
    origin = F.unix_micros(first)

    def slot_time(slot):
        return F.timestamp_micros(origin + slot * step * F.lit(1_000_000))

    return inner.unionByName(edges).where(F.col("before") - F.col("after") > 1).select(
        *SERIES_KEY,
        slot_time(F.col("after") + 1).alias("start_time"),
        slot_time(F.col("before")).alias("end_time"),
    )


def gaps_in_sequence(candles: DataFrame, slots_per_bucket: int = SLOTS_PER_BUCKET) -> DataFrame:
    """Gap between neighbours further apart than one interval."""
    step = interval_seconds(F.col("interval"))
    pairs = transitions(
        candles.select(*SERIES_KEY, "timestamp"), SERIES_KEY, "timestamp",
        bucket=time_bucket(F.col("timestamp"), F.col("interval"), slots_per_bucket))
    expected = F.timestamp_micros(F.unix_micros("prev_timestamp") + step * F.lit(1_000_000))
    return pairs.where(F.col("timestamp") > expected).select(
        *SERIES_KEY, expected.alias("start_time"), F.col("timestamp").alias("end_time"))


def recent_gaps(candles: DataFrame, as_of, lookback_seconds: int, series: DataFrame = None,
                align: bool = True) -> DataFrame:
    """``gaps_in_range`` over the last ``lookback_seconds`` before ``as_of``."""
    end = at(as_of)
    start = F.timestamp_micros(F.unix_micros(end) - F.lit(lookback_seconds * 1_000_000).cast("bigint"))
    return gaps_in_range(candles, start, end, series, align)


def slots_of(periods: DataFrame, slots_per_block: int = SLOTS_PER_BUCKET) -> DataFrame:
    """Every slot of every period ``[start_time, end_time)``.

    Two explodes with a shuffle between: a period of any length is expanded by
    many tasks, and no array exceeds ``slots_per_block`` elements.
    """
    step = interval_seconds(F.col("interval"))
    counted = periods.withColumn(_STEP, step).withColumn(
        "_slots", F.ceil(seconds_between(F.col("start_time"), F.col("end_time")) / F.col(_STEP))
        .cast("bigint")).where(F.col("_slots") > 0)
    blocks = counted.withColumn(
        "_block", F.explode(F.sequence(
            F.lit(0).cast("bigint"), F.floor((F.col("_slots") - 1) / slots_per_block).cast("bigint")))
    ).repartition(*SERIES_KEY, "start_time", "_block")
    first = F.col("_block") * slots_per_block
    last = F.least(first + slots_per_block, F.col("_slots")) - 1
    return blocks.withColumn("_slot", F.explode(F.sequence(first, last))).withColumn(
        "timestamp",
        F.timestamp_seconds(F.unix_seconds("start_time") + F.col("_slot") * F.col(_STEP)),
    ).drop("_slot", "_block", "_slots", _STEP)


def expected_grid(series: DataFrame, start, end, align: bool = True) -> DataFrame:
    """All slots a complete series would have."""
    bounds = _series_bounds(series, start, end, align)
    return slots_of(bounds.select(
        *SERIES_KEY, F.col("lo").alias("start_time"), F.col("stop").alias("end_time"))
    ).select(*SERIES_KEY, "timestamp")


def missing_candles(candles: DataFrame, start, end, series: DataFrame = None, align: bool = True,
                    method: str = "gaps") -> DataFrame:
    """Slots without a candle.

    ``gaps`` expands the missing runs (work grows with what is missing);
    ``grid`` subtracts the candles from the full grid.
    """
    if method == "gaps":
        return slots_of(gaps_in_range(candles, start, end, series, align)).select(
            *SERIES_KEY, "timestamp")
    grid = expected_grid(series_of(candles) if series is None else series, start, end, align)
    have = candles.select(*SERIES_KEY, F.timestamp_seconds(F.unix_seconds("timestamp")).alias("timestamp"))
    return grid.join(have, [*SERIES_KEY, "timestamp"], "left_anti")


def completeness(candles: DataFrame, start, end, series: DataFrame = None, align: bool = True,
                 alert_below: float = 0.999) -> DataFrame:
    """Present and expected slots per series, with an alert flag.

    Counts the distinct slots on the grid in one pass, so duplicate rows cannot inflate
    it. With ``series`` given, only the range is read.
    """
    step = interval_seconds(F.col("interval"))
    lo, hi = at(start), at(end)
    first = ceil_to(lo, step) if align else lo
    upper = floor_to(hi, step) if align else hi
    behind = F.unix_seconds("timestamp") - F.unix_seconds(first)
    on_grid = (F.col("timestamp") >= lo) & (F.col("timestamp") < upper) & (behind >= 0) & (F.pmod(behind, step) == 0)
    slot = F.when(on_grid, F.floor(behind / step))
    read = candles if series is None else in_months(candles, start, end).where(on_grid)
    counted = read.groupBy(*SERIES_KEY).agg(F.count_distinct(slot).alias("actual"))
    wanted = counted if series is None else series_of(series).join(counted, SERIES_KEY, "left")
    bounds = _series_bounds(wanted, start, end, align, keep=("actual",))
    ratio = F.col("actual") / F.col("expected")
    return (
        bounds.select(*SERIES_KEY, F.col("slots").alias("expected"),
                      F.coalesce("actual", F.lit(0)).cast("bigint").alias("actual"))
        .select(*SERIES_KEY, "actual", "expected", ratio.alias("completeness"),
                (ratio < alert_below).alias("alert"))
    )


def gap_period_reason(as_of, start: Column = None, end: Column = None) -> Column:
    """Why a period is not worth storing as a gap; NULL when it is."""
    start = F.col("start_time") if start is None else start
    end = F.col("end_time") if end is None else end
    step = interval_seconds(F.col("interval"))
    age = F.unix_micros(at(as_of)) - F.unix_micros(end)
    return (
        F.when(step.isNull(), "invalid interval")
        .when(seconds_between(start, end) < step, "gap too short")
        .when(age < F.lit(RECENT_SECONDS * 1_000_000), "gap too recent")
    )


def gap_period_valid(periods: DataFrame, as_of) -> DataFrame:
    reason = gap_period_reason(as_of)
    return periods.withColumn("is_valid", reason.isNull()).withColumn("reason", reason)


def gap_ignorable(gaps: DataFrame, as_of) -> DataFrame:
    """Gaps that were tried too often or are too old."""
    age = seconds_between(F.col("created_at"), at(as_of))
    reason = (
        F.when(F.col("attempts") >= MAX_ATTEMPTS, "max retry attempts exceeded")
        .when(age > MAX_AGE_SECONDS, "gap too old")
    )
    return gaps.withColumn("ignore", reason.isNotNull()).withColumn("ignore_reason", reason)


def merge_periods(periods: DataFrame, keys, touching: bool = True,
                  bucket_seconds: int = 30 * DAY, carry=(), totals=()) -> DataFrame:
    """Union of overlapping periods per key, with the number of parts of each.

    ``totals`` are further aggregates over the parts, of their columns ``carry``.

    Periods are merged within buckets of their start time first. Only one merged period of a
    bucket can run on into later ones, so the buckets are chained over one row each, and
    only those that something runs into are looked up again. Periods without a start are
    one group per key; an empty key (NULL) is a key.
    """
    keys = list(keys)

    def apart(start, reach):
        return reach.isNull() | ((start > reach) if touching else (start >= reach))

    place = [*keys, BUCKET]
    bucket = F.floor(F.unix_seconds("start_time") / F.lit(bucket_seconds)).cast("bigint")
    rows = periods.select(*keys, "start_time", "end_time", *carry, bucket.alias(BUCKET)).repartition(*place)
    inside = Window.partitionBy(*place).orderBy("start_time", "end_time")
    reach = F.max("end_time").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("_reach", reach).withColumn(
        "_open", F.when(apart(F.col("start_time"), F.col("_reach")), F.col("start_time")))
    local = opened.withColumn("_island", F.max("_open").over(inside.rowsBetween(Window.unboundedPreceding, 0)))

    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    chained = (
        opened.groupBy(*place)
        .agg(F.min("start_time").alias("_first"), F.max("_open").alias("_last"),
             F.max(F.when(F.col(BUCKET).isNotNull(), F.col("end_time"))).alias("_end"))
        .withColumn("_into", F.max("_end").over(earlier))
        .withColumn("_begun", F.max(F.when(apart(F.col("_last"), F.col("_into")), F.col("_last"))).over(earlier))
        .where(~apart(F.col("_first"), F.col("_into")))
        .select(*place, "_into", "_begun"))
    whole = look_up(local, chained, place).select(
        *keys, "end_time", *carry,
        F.when(apart(F.col("_island"), F.col("_into")), F.col("_island")).otherwise(F.col("_begun")).alias("start_time"))
    return whole.groupBy(*keys, "start_time").agg(
        F.max("end_time").alias("end_time"), F.count(F.lit(1)).alias("merged_count"), *totals)


def gap_id() -> Column:
    """Deterministic id, so detecting the same gap again is harmless."""
    text = F.concat_ws("_", "pair", "interval", F.unix_seconds("start_time").cast("string"),
                       F.unix_seconds("end_time").cast("string"))
    return F.replace(F.replace(text, F.lit("/"), F.lit("-")), F.lit(" "), F.lit("_"))


def merge_gaps(gaps: DataFrame, touching: bool = True) -> DataFrame:
    """Overlapping gaps of a series merged; ``merged_count - 1`` were resolved."""
    return merge_periods(gaps, SERIES_KEY, touching)


def merge_gap_records(gaps: DataFrame, touching: bool = True, bucket_seconds: int = 30 * DAY) -> DataFrame:
    """Merged gaps as gap records with an id of their own.

    A merged gap is as urgent, as often tried and as old as any of its parts, and in
    progress if one of them is.
    """
    merged = merge_periods(
        gaps, SERIES_KEY, touching, bucket_seconds, ("status", "created_at", "priority", "attempts", "last_attempt_at"),
        [F.max("priority").alias("priority"), F.max("attempts").alias("attempts"), F.min("created_at").alias("created_at"),
         F.max("last_attempt_at").alias("last_attempt_at"), F.count_if(F.col("status") == "filling").alias("_filling")])
    return merged.select(
        gap_id().alias("id"), *SERIES_KEY, "start_time", "end_time",
        F.when(F.col("_filling") > 0, "filling").otherwise("detected").alias("status"),
        "created_at", "priority", "attempts", "last_attempt_at", "merged_count")


def overlap_gaps(gaps: DataFrame, bucket_seconds: int = 30 * DAY) -> DataFrame:
    """Gaps that start before an earlier gap of their series has ended."""
    bucket = F.floor(F.unix_seconds("start_time") / F.lit(bucket_seconds)).cast("bigint")
    reached = running(gaps, SERIES_KEY, ["start_time", "end_time", "id"],
                      {"reached_end": ("max", "end_time")}, bucket)
    return reached.where(F.col("start_time") < F.col("reached_end"))


def trading_calendar_filter(gaps: DataFrame, closed: DataFrame, calendar: str = "exchange") -> DataFrame:
    """Drop gaps that lie wholly inside a closed period of their own calendar.

    ``closed``: (exchange, start_time, end_time); ``gaps`` name their exchange in the same
    column, a gap without one or of an exchange without closed periods stays. If ``closed``
    has no such column it is one calendar for all gaps. Periods of a calendar are merged, and
    cut by day; a gap meets those of the day it starts on, so the join keys are the calendar and the day.
    """
    one = calendar not in closed.columns
    named = closed.withColumn(calendar, F.lit("")) if one else closed
    whole = merge_periods(named, [calendar])
    days = whole.select(
        F.col(calendar).alias("_calendar"), F.col("start_time").alias("_closed_from"), F.col("end_time").alias("_closed_to"),
        F.explode(F.sequence(
            F.floor(F.unix_seconds("start_time") / DAY).cast("bigint"),
            F.floor((F.unix_seconds("end_time") - 1) / DAY).cast("bigint"))).alias("_day"))
    keyed = gaps.withColumn("_day", F.floor(F.unix_seconds("start_time") / DAY).cast("bigint"))
    inside = (
        (keyed["_day"] == days["_day"])
        & (keyed["start_time"] >= days["_closed_from"])
        & (keyed["end_time"] <= days["_closed_to"])
    )
    if not one:
        inside = (keyed[calendar] == days["_calendar"]) & inside
    return keyed.join(days, inside, "left_anti").drop("_day")


def match_candles(gaps: DataFrame, candles: DataFrame, include_end: bool,
                  slots_per_bucket: int = JOIN_SLOTS) -> DataFrame:
    """Gap columns with each candle inside the gap.

    Both sides carry a time bucket, so the join has the equality keys
    (pair, interval, bucket). Buckets are narrow: a candle only meets the few
    gaps of its own bucket, and a hot series is spread over very many buckets.
    """
    step = F.coalesce(interval_seconds(F.col("interval")), F.lit(HOUR)) * slots_per_bucket

    def number(ts):
        return F.floor(F.unix_seconds(ts) / step).cast("bigint")

    spread = gaps.withColumn(
        BUCKET, F.explode(F.sequence(number(F.col("start_time")), number(F.col("end_time")))))
    keyed = candles.withColumn(BUCKET, number(F.col("timestamp")))
    joined = spread.join(keyed, [*SERIES_KEY, BUCKET]).where(
        F.col("timestamp") >= F.col("start_time"))
    within = F.col("timestamp") <= F.col("end_time") if include_end else (
        F.col("timestamp") < F.col("end_time"))
    return joined.where(within).drop(BUCKET)


def candles_in_gap(gaps: DataFrame, candles: DataFrame) -> DataFrame:
    """Candles offered for a gap; the gap end itself counts as inside."""
    return match_candles(
        gaps.select("id", *SERIES_KEY, "start_time", "end_time"),
        candles.select(*SERIES_KEY, "timestamp", "close", "volume"), include_end=True)


def gap_fill_check(gaps: DataFrame, candles: DataFrame) -> DataFrame:
    """How far each gap is covered by candles: full, partial or none."""
    step = interval_seconds(F.col("interval"))
    found = match_candles(
        gaps.select("id", *SERIES_KEY, "start_time", "end_time"),
        candles.select(*SERIES_KEY, "timestamp"), include_end=False,
    ).groupBy("id").agg(F.count(F.lit(1)).alias("found"))
    have = F.coalesce(F.col("found"), F.lit(0)).cast("bigint")
    return (
        gaps.withColumn("expected", F.greatest(F.lit(1).cast("bigint"), F.floor(
            seconds_between(F.col("start_time"), F.col("end_time")) / step).cast("bigint")))
        .join(found, "id", "left")
        .select("id", *SERIES_KEY, "start_time", "end_time", "expected", have.alias("found"),
                F.when(have == 0, "none").when(have >= F.col("expected"), "full")
                .otherwise("partial").alias("coverage"))
    )


def query_with_gap_flags(candles: DataFrame, gaps: DataFrame, start, end,
                         series: DataFrame = None) -> DataFrame:
    """Full grid with candle values, a missing flag and the status of a known gap."""
    wanted = series_of(candles) if series is None else series
    grid = expected_grid(wanted, start, end)
    values = candles.select(*SERIES_KEY, "timestamp", "close", "volume", F.lit(True).alias("_have"))
    # Only the part of a gap inside the range is expanded, from its own first slot there.
    step = interval_seconds(F.col("interval"))
    skipped = F.greatest(F.lit(0), F.ceil((F.unix_micros(at(start)) - F.unix_micros("start_time")) / (step * F.lit(1_000_000))))
    known = gaps.where((F.col("end_time") > at(start)) & (F.col("start_time") < at(end))).select(
        *SERIES_KEY, F.timestamp_micros(F.unix_micros("start_time") + skipped * step * F.lit(1_000_000)).alias("start_time"),
        F.least("end_time", at(end)).alias("end_time"), "status")
    status = slots_of(known).groupBy(
        *SERIES_KEY, "timestamp").agg(F.max("status").alias("gap_status"))
    key = [*SERIES_KEY, "timestamp"]
    return (
        grid.join(values, key, "left").join(status, key, "left")
        .select(*key, "close", "volume", F.col("_have").isNull().alias("is_missing"),
                F.when(F.col("_have").isNull(), F.col("gap_status")).alias("gap_status"))
    )


def detection_result(gaps: DataFrame, series: DataFrame) -> DataFrame:
    """Totals of one detection run as (metric, label, value) rows."""
    counts = gaps.groupBy("pair", "priority").agg(F.count(F.lit(1)).alias("n"))
    # One pass over the small counts table gives the total and both breakdowns.
    level = F.grouping_id()
    found = with_empty_row(counts).groupingSets([[], ["pair"], ["priority"]], "pair", "priority").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("value"), level.alias("_level")
    ).where((F.col("_level") == 3) | (F.col("value") > 0)).select(
        F.when(F.col("_level") == 3, "gaps_detected").when(F.col("_level") == 1, "gaps_by_pair")
        .otherwise("gaps_by_priority").alias("metric"),
        F.coalesce("pair", F.col("priority").cast("string")).alias("label"), "value")
    null = F.lit(None).cast("string")
    scanned = series.agg(
        F.countDistinct("pair").alias("pairs"), F.countDistinct("interval").alias("intervals"))
    return scanned.select(F.inline(F.array(
        F.struct(F.lit("pairs_scanned").alias("metric"), null.alias("label"),
                 F.col("pairs").alias("value")),
        F.struct(F.lit("intervals_scanned").alias("metric"), null.alias("label"),
                 F.col("intervals").alias("value"))))).unionByName(found)
