"""Anomalies between candles of a series."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.decimals import plain_text, ratio
from candlewright.functions.intervals import DAY, HOUR, MINUTE, interval_seconds
from candlewright.functions.rendering import iso_utc
from candlewright.functions.scoring import (
    SPIKE_THRESHOLD, SURGE_THRESHOLD, sequence_confidence, severity_of, spike_confidence,
    surge_confidence,
)
from candlewright.operators.series import (
    BUCKET, SLOTS_PER_BUCKET, attach_per_series, number_bucket, ranked, time_bucket, transitions,
)
from candlewright.operators.validate import logic_anomalies, parse_decimals
from candlewright.schemas import SERIES_KEY, THRESHOLD

DRIFT_SECONDS = 2 * MINUTE
LOOKBACK_ROWS = 24
MA_SECONDS = 30 * DAY


def exceeds(current: Column, previous: Column, threshold) -> Column:
    """current / previous > threshold, exactly and for either sign of ``previous``."""
    limit = F.lit(str(threshold)).cast(THRESHOLD) * previous
    return F.coalesce(
        F.when(previous > 0, current > limit).when(previous < 0, current < limit), F.lit(False))


def candle_steps(candles: DataFrame, slots_per_bucket: int = SLOTS_PER_BUCKET, ties=(),
                 keep_bucket: bool = False) -> DataFrame:
    """Each candle next to its predecessor: times, highs and volumes.

    Candles of a series with equal times follow each other by the columns ``ties``, which
    must tell them apart; without ``ties`` times must be unique.
    """
    bucket = time_bucket(F.col("timestamp"), F.col("interval"), slots_per_bucket)
    if not ties:
        return transitions(candles, SERIES_KEY, "timestamp", ["high", "volume"], bucket, keep_bucket=keep_bucket)
    placed = candles.where(F.col("timestamp").isNotNull()).withColumn("_order", F.struct("timestamp", *ties))
    return transitions(placed, SERIES_KEY, "_order", ["timestamp", "high", "volume"], bucket,
                       keep_bucket=keep_bucket).drop("_order", "prev__order")


def as_of_prev(candles: DataFrame, slots_per_bucket: int = SLOTS_PER_BUCKET) -> DataFrame:
    """Every candle with the close and time of its predecessor, if any."""
    return transitions(
        candles, SERIES_KEY, "timestamp", ["close"],
        time_bucket(F.col("timestamp"), F.col("interval"), slots_per_bucket), include_first=True)


def _finding(kind: str, rule, hit: Column, value: Column, threshold: float, confidence: Column,
             description: Column) -> Column:
    """The anomaly as a struct where ``hit`` holds, else NULL."""
    limit = F.lit(float(threshold))
    rule = F.lit(rule) if isinstance(rule, str) else rule
    return F.when(hit, F.struct(
        F.lit(kind).alias("type"), rule.alias("rule"), description.alias("description"),
        value.cast("double").alias("value"), limit.alias("threshold"), confidence.alias("confidence"),
        severity_of(F.lit(kind), value, limit, confidence).alias("severity")))


def spike_finding(threshold=SPIKE_THRESHOLD) -> Column:
    r = ratio(F.col("high"), F.col("prev_high"))
    text = F.concat(
        F.lit("Price spike detected: "), F.format_string("%.2f", (r - 1) * 100),
        F.lit("% increase (current: "), plain_text(F.col("high")),
        F.lit(", previous: "), plain_text(F.col("prev_high")), F.lit(")"))
    return _finding("price_spike", "high_ratio", exceeds(F.col("high"), F.col("prev_high"), threshold),
                    r, SPIKE_THRESHOLD, spike_confidence(r), text)


def surge_finding(threshold=SURGE_THRESHOLD) -> Column:
    r = ratio(F.col("volume"), F.col("prev_volume"))
    text = F.concat(
        F.lit("Volume surge detected: "), F.format_string("%.2f", r),
        F.lit("x increase (current: "), plain_text(F.col("volume")),
        F.lit(", previous: "), plain_text(F.col("prev_volume")), F.lit(")"))
    return _finding("volume_surge", "volume_ratio", exceeds(F.col("volume"), F.col("prev_volume"), threshold),
                    r, SURGE_THRESHOLD, surge_confidence(r), text)


def sequence_finding(step: Column, drift_seconds: int = DRIFT_SECONDS) -> Column:
    """Out of order, or off the expected time by more than the tolerance."""
    gap = (F.unix_micros("timestamp") - F.unix_micros("prev_timestamp")) / 1_000_000 - step
    late = F.col("timestamp") < F.col("prev_timestamp")
    expected = F.timestamp_micros(F.unix_micros("prev_timestamp") + step * F.lit(1_000_000))
    minutes = gap / 60
    text = F.when(late, F.concat(
        F.lit("Timestamp out of order: "), iso_utc(F.col("timestamp")), F.lit(" comes after "),
        iso_utc(F.col("prev_timestamp")))).otherwise(F.concat(
            F.lit("Timestamp sequence gap detected: "), F.format_string("%.2f", minutes),
            F.lit(" minutes gap (expected: "), iso_utc(expected), F.lit(", actual: "),
            iso_utc(F.col("timestamp")), F.lit(")")))
    return _finding(
        "sequence_gap", F.when(late, "out_of_order").otherwise("interval_gap"),
        late | (F.abs(gap) > drift_seconds), minutes, drift_seconds / 60.0,
        sequence_confidence(gap, drift_seconds), text)


def findings(steps: DataFrame, columns, *checks: Column) -> DataFrame:
    """Rows of all checks, found in one pass over the steps."""
    return steps.select(*columns, F.inline(F.array_compact(F.array(*checks))))


def cross_anomalies(steps: DataFrame, spike_threshold=SPIKE_THRESHOLD,
                    surge_threshold=SURGE_THRESHOLD) -> DataFrame:
    """Price spikes and volume surges of candle steps."""
    return findings(steps, [*SERIES_KEY, "timestamp"],
                    spike_finding(spike_threshold), surge_finding(surge_threshold))


def price_spikes(candles: DataFrame, threshold=SPIKE_THRESHOLD,
                 slots_per_bucket: int = SLOTS_PER_BUCKET) -> DataFrame:
    """High more than ``threshold`` times the previous high."""
    return findings(candle_steps(candles, slots_per_bucket), [*SERIES_KEY, "timestamp"],
                    spike_finding(threshold))


def volume_surges(candles: DataFrame, threshold=SURGE_THRESHOLD,
                  slots_per_bucket: int = SLOTS_PER_BUCKET) -> DataFrame:
    """Volume more than ``threshold`` times the previous volume."""
    return findings(candle_steps(candles, slots_per_bucket), [*SERIES_KEY, "timestamp"],
                    surge_finding(threshold))


def sequence_anomalies(rows: DataFrame, arrival: str, keys=("pair",), step_seconds: Column = None,
                       drift_seconds: int = DRIFT_SECONDS,
                       rows_per_bucket: int = SLOTS_PER_BUCKET, ties=()) -> DataFrame:
    """Order and spacing of timestamps in arrival order.

    ``arrival`` is the sequence number rows came in with. Rows with equal numbers follow each
    other by the columns ``ties``, which must tell them apart; without ``ties`` numbers must be
    unique within ``keys``. A row earlier than
    its predecessor is out of order; otherwise it must be within the drift
    tolerance of the predecessor plus one interval.
    """
    keys = list(keys)
    step = interval_seconds(F.col("interval")) if step_seconds is None else step_seconds
    rows, bucket = rows.withColumn("_step", step), number_bucket(F.col(arrival), rows_per_bucket)
    if ties:
        placed = rows.where(F.col(arrival).isNotNull()).withColumn("_order", F.struct(arrival, *ties))
        steps = transitions(placed, keys, "_order", ["timestamp", "_step"], bucket, levels=1).withColumn(
            arrival, F.col(f"_order.{arrival}"))
    else:
        steps = transitions(rows, keys, arrival, ["timestamp", "_step"], bucket, levels=1)
    return findings(steps, [*keys, arrival, "timestamp", "prev_timestamp"],
                    sequence_finding(F.col("_step"), drift_seconds))


def estimate_interval(rows: DataFrame, keys=SERIES_KEY, bucket: Column = None) -> DataFrame:
    """Most frequent spacing per series, rounded to minutes; smallest wins a tie.

    Series with fewer than two rows, or whose most frequent spacing rounds to
    zero, count as hourly.
    """
    keys = list(keys)
    if bucket is None:
        bucket = time_bucket(F.col("timestamp"))
    # The first row of a series has no spacing; it only makes the series appear.
    return _usual_spacing(transitions(
        rows.select(*keys, "timestamp"), keys, "timestamp", bucket=bucket, include_first=True), keys)


def _usual_spacing(steps: DataFrame, keys) -> DataFrame:
    micros = F.unix_micros("timestamp") - F.unix_micros("prev_timestamp")
    rounded = (F.round(micros / (MINUTE * 1_000_000)) * MINUTE).cast("bigint")
    votes = steps.groupBy(*keys, rounded.alias("step")).agg(F.count(F.lit(1)).alias("votes"))
    weight = F.when(F.col("step").isNotNull(), F.struct("votes", -F.col("step")))
    best = votes.groupBy(*keys).agg(F.max_by("step", weight).alias("step"))
    return best.select(*keys, F.when(
        F.coalesce(F.col("step"), F.lit(0)) == 0, F.lit(HOUR).cast("bigint"))
        .otherwise(F.col("step")).alias("interval_seconds"))


def _moving_sums(candles: DataFrame, seconds: int) -> DataFrame:
    """Sum and count of volume over the preceding ``seconds``, current row excluded.

    Each row enters the running total at its own time and leaves it
    ``seconds`` later, so the cost is linear in the rows, not rows times frame.
    Buckets are several windows wide and receive the rows of the window before
    them as context, which makes each bucket self-contained.
    """
    width = 4 * seconds
    unix = F.unix_seconds("timestamp")
    own = F.floor(unix / F.lit(width)).cast("bigint")
    reach = F.floor((unix + seconds) / F.lit(width)).cast("bigint")
    placed = candles.select(*SERIES_KEY, "timestamp", "volume", unix.alias("_at"), own.alias("_own"))
    placed = placed.withColumn(BUCKET, F.explode(F.when(
        reach > own, F.array(own, own + 1)).otherwise(F.array(own))))
    def event(at, kind, delta, n, stamp):
        return F.struct(at.alias("at"), F.lit(kind).alias("kind"), delta.alias("delta"),
                        F.lit(n).alias("n"), stamp.alias("timestamp"))

    mine = F.when(F.col("_own") == F.col(BUCKET), F.col("timestamp"))
    events = placed.select(*SERIES_KEY, BUCKET, F.inline(F.array(
        event(F.col("_at"), 0, F.col("volume"), 1, mine),
        event(F.col("_at") + seconds, 1, -F.col("volume"), -1, F.lit(None).cast("timestamp")))))
    before = (Window.partitionBy(*SERIES_KEY, BUCKET).orderBy("at", "kind")
              .rowsBetween(Window.unboundedPreceding, -1))
    return events.select(
        *SERIES_KEY, "timestamp", F.col("delta").alias("volume"),
        F.sum("delta").over(before).alias("window_sum"), F.sum("n").over(before).alias("window_n"),
    ).where(F.col("timestamp").isNotNull())


def volume_surge_ma(candles: DataFrame, multiple: float = 10.0, seconds: int = MA_SECONDS) -> DataFrame:
    """Volume more than ``multiple`` times its mean over the preceding period."""
    mean = F.when(F.col("window_n") > 0, F.col("window_sum").cast("double") / F.col("window_n"))
    return _moving_sums(candles, seconds).withColumn("moving_average", mean).where(
        F.col("volume").cast("double") > F.col("moving_average") * multiple
    ).select(*SERIES_KEY, "timestamp", "volume", "moving_average")


def lookback_context(candles: DataFrame, rows: int = LOOKBACK_ROWS,
                     block: int = SLOTS_PER_BUCKET) -> DataFrame:
    """Mean and standard deviation of close over the preceding ``rows`` candles.

    Rows get a position in their series (per-bucket counts plus offsets); blocks
    of positions then carry the last ``rows`` rows of the block before them.
    """
    order = [F.asc("timestamp")]
    placed = ranked(
        candles.select(*SERIES_KEY, "timestamp", "close"), SERIES_KEY, order,
        [[(time_bucket(F.col("timestamp"), F.col("interval"), block), False)]], "_pos")
    own = F.floor((F.col("_pos") - 1) / F.lit(block)).cast("bigint")
    reach = F.floor((F.col("_pos") - 1 + rows) / F.lit(block)).cast("bigint")
    shared = placed.withColumn("_own", own).withColumn(
        BUCKET, F.explode(F.when(reach > own, F.sequence(own, reach)).otherwise(F.array(own))))
    near = Window.partitionBy(*SERIES_KEY, BUCKET).orderBy("_pos").rowsBetween(-rows, -1)
    value = F.col("close").cast("double")
    return shared.select(
        "*", F.avg(value).over(near).alias("mean_close"),
        F.stddev_samp(value).over(near).alias("std_close"),
        F.count(value).over(near).alias("context_rows"),
    ).where(F.col("_own") == F.col(BUCKET)).select(
        *SERIES_KEY, "timestamp", "close", "context_rows", "mean_close", "std_close")


def validate_all(raw: DataFrame, arrival: str = None, logical: bool = True, spikes: bool = True,
                 timestamps: bool = True, spike_threshold=SPIKE_THRESHOLD,
                 surge_threshold=SURGE_THRESHOLD, drift_seconds: int = DRIFT_SECONDS, ties=()) -> DataFrame:
    """Union of all enabled anomaly branches over text candles.

    The sequence branch measures spacing against the interval estimated from
    the data, not the declared one; rows are in time order (equal times by the columns
    ``ties``), or in that of ``arrival`` if given. A row without pair or interval belongs to
    the series of all such rows; one without a time takes part in the logical branch only.
    """
    typed = parse_decimals(raw)
    shape = [*SERIES_KEY, "timestamp", "type", "rule", "description", "value", "threshold",
             "confidence", "severity"]
    parts = []
    if logical:
        parts.append(logic_anomalies(typed).withColumns({
            "value": F.col("value").cast("double"), "threshold": F.col("threshold").cast("double"),
        }).select(*shape))
    if spikes or timestamps:
        steps = candle_steps(typed.where(F.col("timestamp").isNotNull()), ties=ties, keep_bucket=True)
    checks = [spike_finding(spike_threshold), surge_finding(surge_threshold)] if spikes else []
    if timestamps:
        # The spacing comes from the same exchange as the steps, and in time order all checks share one pass.
        spacing = _usual_spacing(steps, SERIES_KEY)
        order = sequence_finding(F.col("interval_seconds"), drift_seconds)
        if arrival is None:
            steps = attach_per_series(steps, spacing, SERIES_KEY)
            checks.append(order)
        else:
            came = transitions(raw, SERIES_KEY, arrival, ["timestamp"], number_bucket(F.col(arrival)),
                               levels=1, keep_bucket=True)
            known = attach_per_series(came, spacing, SERIES_KEY).fillna(HOUR, ["interval_seconds"])
            parts.append(findings(known, [*SERIES_KEY, "timestamp"], order).select(*shape))
    if checks:
        parts.append(findings(steps, [*SERIES_KEY, "timestamp"], *checks).select(*shape))
    return reduce(DataFrame.unionByName, parts)


def filter_anomalies(anomalies: DataFrame, kind: str = None, min_confidence: float = None) -> DataFrame:
    """Anomalies of a type and/or of at least some confidence."""
    if kind is not None:
        anomalies = anomalies.where(F.col("type") == kind)
    if min_confidence is not None:
        anomalies = anomalies.where(F.col("confidence") >= min_confidence)
    return anomalies


def min_confidence_filter(anomalies: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """Only anomalies worth reporting; not applied anywhere unless called."""
    return filter_anomalies(anomalies, min_confidence=min_confidence)
