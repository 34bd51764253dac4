"""Rule checks on candles, gaps, jobs, pairs and validation results."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewright.functions.decimals import is_numeric_text, parse_decimal, plain_text
from candlewright.functions.intervals import JOB_INTERVALS, at, seconds_of
from candlewright.functions.scoring import (
    ACTIONS, ANOMALY_TYPES, SEVERITIES, recommend_action, worst_severity,
)
from candlewright.schemas import ANOMALY, CANDLE_FIELDS, DECIMAL, PRICE_FIELDS

# Unix second that stands for a missing candle time in result ids.
ZERO_TIME_UNIX = -62135596800
# Gap and job vocabularies.
GAP_STATUSES = ["detected", "filling", "filled", "permanent"]
JOB_TYPES = ["initial_sync", "update", "backfill"]
JOB_STATUSES = ["pending", "running", "completed", "failed"]
# Intervals the query API accepts.
QUERY_INTERVALS = ["1m", "5m", "15m", "30m", "1h", "4h", "12h", "1d", "1w", "1M"]


def _is_blank(column: Column) -> Column:
    return column.isNull() | (column == "")


def _failure(field: str, message) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(field).alias("field"), text.alias("message"))


def _first_failure(rules) -> Column:
    return F.coalesce(*[F.when(broken, _failure(field, message)) for field, broken, message in rules])


def parse_decimals(raw: DataFrame) -> DataFrame:
    """Text fields to decimals, keeping the text as ``<field>_text``."""
    return raw.select(
        "*", *[F.col(f).alias(f"{f}_text") for f in CANDLE_FIELDS]
    ).withColumns({f: parse_decimal(F.col(f)) for f in CANDLE_FIELDS})


def parse_report(raw: DataFrame) -> DataFrame:
    """Values of the text fields, with ``ok``, ``format`` or ``out_of_range`` per field."""
    def state(f):
        return (F.when(~F.col(f"_n_{f}"), "format").when(F.col(f"_v_{f}").isNull(), "out_of_range")
                .otherwise("ok").alias(f"{f}_state"))

    rest = [c for c in raw.columns if c not in CANDLE_FIELDS]
    return _prepared(raw).select(
        *rest, *[F.col(f"_v_{f}").alias(f) for f in CANDLE_FIELDS], *[state(f) for f in CANDLE_FIELDS])


def _prepared(raw: DataFrame) -> DataFrame:
    """Adds ``_n_<field>`` (is a number) and ``_v_<field>`` (its value).

    Two projections, so that each text is matched and parsed once, however many
    rules look at it.
    """
    return raw.withColumns({f"_n_{f}": is_numeric_text(F.col(f)) for f in CANDLE_FIELDS}).withColumns(
        {f"_v_{f}": F.when(F.col(f"_n_{f}"), F.col(f).try_cast(DECIMAL)) for f in CANDLE_FIELDS})


def _candle_failure() -> Column:
    """First broken rule of a prepared candle as (field, message); NULL when valid."""
    value = {f: F.col(f"_v_{f}") for f in CANDLE_FIELDS}
    top = F.greatest(value["open"], value["close"])
    bottom = F.least(value["open"], value["close"])
    rules = [("timestamp", F.col("timestamp").isNull(), "timestamp cannot be null or zero")]
    for f in CANDLE_FIELDS:
        what = "volume" if f == "volume" else f"{f} price"
        text = F.coalesce(F.col(f), F.lit(""))
        rules.append((f, ~F.col(f"_n_{f}"), F.concat(
            F.lit(f"invalid {what} format: can't convert "), text, F.lit(" to decimal"))))
        rules.append((f, value[f].isNull(), F.concat(F.lit(f"{what} out of range: "), text)))
    for f in PRICE_FIELDS:
        rules.append((f, value[f] <= 0, f"{f} price must be greater than 0"))
    rules += [
        ("volume", value["volume"] < 0, "volume must be greater than or equal to 0"),
        ("high", value["high"] < top, F.concat(
            F.lit("high price ("), plain_text(value["high"]),
            F.lit(") must be greater than or equal to max(open, close) ("), plain_text(top),
            F.lit(")"))),
        ("low", value["low"] > bottom, F.concat(
            F.lit("low price ("), plain_text(value["low"]),
            F.lit(") must be less than or equal to min(open, close) ("), plain_text(bottom),
            F.lit(")"))),
        ("pair", _is_blank(F.col("pair")), "pair cannot be empty"),
        ("interval", _is_blank(F.col("interval")), "interval cannot be empty"),
    ]
    return _first_failure(rules)


def _checked(raw: DataFrame) -> DataFrame:
    # As a generated row the verdict is computed once. A filter on a projected
    # column would be pushed below it and repeat every rule and parse.
    verdict = F.inline(F.array(_candle_failure())).alias("error_field", "error_message")
    return _prepared(raw).select("*", verdict)


def validate_candles(raw: DataFrame) -> DataFrame:
    """Adds ``error_field`` and ``error_message`` of the first broken rule."""
    return _checked(raw).select(*raw.columns, "error_field", "error_message")


def split_valid_invalid(raw: DataFrame):
    """(typed valid candles, rejected rows with their reason)."""
    checked = _checked(raw)
    typed = [F.col(f"_v_{c}").alias(c) if c in CANDLE_FIELDS else F.col(c) for c in raw.columns]
    return (
        checked.where(F.col("error_field").isNull()).select(*typed),
        checked.where(F.col("error_field").isNotNull()).select(*raw.columns, "error_field", "error_message"),
    )


def table_constraints(candles: DataFrame) -> DataFrame:
    """Rows violating each storage constraint, as (constraint_name, violations)."""
    o, h, l, c, v = (F.col(f) for f in CANDLE_FIELDS)
    checks = {
        "high_covers_body": ~((h >= o) & (h >= c)),
        "low_covers_body": ~((l <= o) & (l <= c)),
        "positive_prices": ~((o > 0) & (h > 0) & (l > 0) & (c > 0)),
        "non_negative_volume": ~(v >= 0),
    }
    counted = candles.agg(*[F.count_if(broken).alias(n) for n, broken in checks.items()])
    return _unpivot(counted, list(checks), "constraint_name", "violations")


def _unpivot(df: DataFrame, columns, name: str, value: str) -> DataFrame:
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns])))


def spec_consistency(raw: DataFrame) -> DataFrame:
    """Rows per consistency rule, as (rule, n)."""
    value = {f: parse_decimal(F.col(f)) for f in CANDLE_FIELDS}
    any_of = lambda parts: reduce(lambda a, b: a | b, parts)
    checks = {
        "negative_price": any_of([value[f] < 0 for f in PRICE_FIELDS]),
        "missing_field": any_of([F.col(f).isNull() | (F.trim(F.col(f)) == "") for f in CANDLE_FIELDS]),
        "high_below_low": value["high"] < value["low"],
        "close_outside_range": (value["close"] < value["low"]) | (value["close"] > value["high"]),
    }
    counted = raw.agg(*[F.count_if(broken).alias(n) for n, broken in checks.items()])
    return _unpivot(counted, list(checks), "rule", "n")


# --- anomalies inside one candle -------------------------------------------------

def _logic(rule: str, broken: Column, text: Column, value: Column) -> Column:
    return F.when(broken, F.struct(
        F.lit("logic_error").alias("type"), F.lit(rule).alias("rule"),
        F.concat(F.lit(f"{rule}: "), text).alias("description"),
        value.cast(DECIMAL).alias("value"), F.lit("0").cast(DECIMAL).alias("threshold"),
        F.lit(1.0).alias("confidence"), F.lit("error").alias("severity"),
    ).cast(ANOMALY))


def logic_anomaly_array() -> Column:
    """All broken price and volume rules of a typed candle, in rule order."""
    short = lambda f: F.substring(plain_text(F.col(f)), 1, 8)
    o, h, l, c, v = (F.col(f) for f in CANDLE_FIELDS)
    found = [
        # The messages.
        _logic("high_validation", h < F.greatest(o, c), F.concat(
            F.lit("High ("), short("high"), F.lit(") is less than max of Open ("), short("open"),
            F.lit(") and Close ("), short("close"), F.lit(")")), h),
        _logic("low_validation", l > F.least(o, c), F.concat(
            F.lit("Low ("), short("low"), F.lit(") is greater than min of Open ("), short("open"),
            F.lit(") and Close ("), short("close"), F.lit(")")), l),
    ]
    for f in PRICE_FIELDS:
        found.append(_logic("positive_price", F.col(f) <= 0, F.concat(
            F.lit(f"{f.capitalize()} price must be positive, got: "), plain_text(F.col(f))), F.col(f)))
    found.append(_logic("non_negative_volume", v < 0, F.concat(
        F.lit("Volume must be non-negative, got: "), plain_text(v)), v))
    return F.array_compact(F.array(*found))


def logic_anomalies(candles: DataFrame) -> DataFrame:
    """One row per broken rule of a typed candle."""
    return candles.select(
        *candles.columns, F.explode(logic_anomaly_array()).alias("_a")
    ).select(*candles.columns, "_a.*")


def candle_results(raw: DataFrame, validation_time, logical_checks: bool = True, actions=None):
    """(result per parseable candle, error row per unparseable candle)."""
    typed = parse_decimals(raw)
    parsed = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in CANDLE_FIELDS])
    unix = F.coalesce(F.unix_seconds("timestamp"), F.lit(ZERO_TIME_UNIX).cast("bigint"))
    no_time, no_pair = F.col("timestamp").isNull(), _is_blank(F.col("pair"))
    zero = F.lit("0").cast(DECIMAL)
    logic = logic_anomaly_array() if logical_checks else F.array().cast("array<%s>" % ANOMALY.simpleString())
    context = F.array_compact(F.array(
        _logic("timestamp_validation", no_time, F.lit("Candle timestamp is zero or invalid"), zero),
        _logic("pair_validation", no_pair, F.lit("Trading pair is empty"), zero)))
    results = (
        typed.where(parsed)
        .withColumn("_logic", logic)
        .withColumn("anomalies", F.concat("_logic", context))
        .withColumn("checks_passed", F.array_compact(F.array(
            F.when((F.size("_logic") == 0) & F.lit(logical_checks), "ohlcv_logic"),
            F.when(~no_time, "timestamp_valid"), F.when(~no_pair, "pair_valid"))))
        .withColumn("severity", worst_severity(F.col("anomalies.severity")))
        .select(
            F.concat_ws("_", F.coalesce("pair", F.lit("")), unix.cast("string")).alias("id"),
            "pair", "interval", F.col("timestamp").alias("candle_timestamp"),
            at(validation_time).alias("validation_time"), "checks_passed", "anomalies", "severity",
            recommend_action(F.col("severity"), F.size("anomalies"), actions).alias("action_taken"))
    )
    bad = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in CANDLE_FIELDS]))
    errors = typed.where(~parsed).select(
        "pair", "interval", F.col("timestamp").alias("candle_timestamp"),
        F.lit("validation_failure").alias("error_type"), F.lit("error").alias("severity"),
        F.get(bad, F.lit(0)).alias("field"))
    return results, errors


def explode_anomalies(results: DataFrame) -> DataFrame:
    """The anomalies fact table of a results table."""
    return results.select(
        F.col("id").alias("validation_result_id"), "pair", "interval", "candle_timestamp",
        F.explode("anomalies").alias("_a"),
    ).select("validation_result_id", "pair", "interval", "candle_timestamp", "_a.*")


def results_anomalies(results: DataFrame, anomalies: DataFrame, candles: DataFrame):
    """(anomalies with their result and candle, anomalies without a candle).

    Rows without a candle time cannot reference a candle and count as orphans;
    keeping them out of the join also keeps their shared id from fanning out.
    """
    key = ["pair", "interval", "candle_timestamp"]
    timed = results.where(F.col("candle_timestamp").isNotNull()).select(
        F.col("id").alias("validation_result_id"), *key, F.col("severity").alias("result_severity"))
    keyed = candles.select("pair", "interval", F.col("timestamp").alias("candle_timestamp"),
                           F.col("close").alias("candle_close"))
    joined = (
        anomalies.where(F.col("candle_timestamp").isNotNull())
        .join(timed, ["validation_result_id", *key]).join(keyed, key)
    )
    return joined, anomalies.join(keyed, key, "left_anti")


# --- gaps, jobs, pairs, results --------------------------------------------------

def validate_gaps(gaps: DataFrame) -> DataFrame:
    """Adds the first broken rule of each gap as ``error``."""
    filled = F.col("status") == "filled"
    rules = [
        (_is_blank(F.col("id")), "gap ID cannot be empty"),
        (_is_blank(F.col("pair")), "gap pair cannot be empty"),
        (_is_blank(F.col("interval")), "gap interval cannot be empty"),
        (F.col("start_time").isNull(), "gap start time cannot be zero"),
        (F.col("end_time").isNull(), "gap end time cannot be zero"),
        (F.col("end_time") <= F.col("start_time"), "gap end time must be after start time"),
        (~F.coalesce(F.col("status").isin(GAP_STATUSES), F.lit(False)), F.concat(
            F.lit("invalid gap status: "), F.coalesce("status", F.lit("")))),
        (filled & F.col("filled_at").isNull(), "filled gaps must have a filled_at timestamp"),
        (~filled & F.col("filled_at").isNotNull(), "only filled gaps can have a filled_at timestamp"),
    ]
    return gaps.withColumn("error", F.coalesce(*[
        F.when(broken, F.lit(m) if isinstance(m, str) else m) for broken, m in rules]))


def validate_jobs(jobs: DataFrame) -> DataFrame:
    """Adds all broken rules of each job as ``errors`` (array of field and message)."""
    text = lambda f: F.coalesce(F.col(f), F.lit(""))
    valid = lambda f, allowed: F.coalesce(F.col(f).isin(allowed), F.lit(False))
    start, end = F.col("start_time"), F.col("end_time")
    rules = [
        ("ID", _is_blank(F.col("id")), "job ID is required"),
        ("Pair", _is_blank(F.col("pair")), "trading pair is required"),
        ("Interval", _is_blank(F.col("interval")), "interval is required"),
        ("Type", ~valid("type", JOB_TYPES), F.concat(
            F.lit("invalid job type '"), text("type"),
            F.lit("', must be one of: " + ", ".join(JOB_TYPES)))),
        ("Status", ~valid("status", JOB_STATUSES), F.concat(
            F.lit("invalid status '"), text("status"),
            F.lit("', must be one of: " + ", ".join(JOB_STATUSES)))),
        ("StartTime", start.isNull(), "start time is required"),
        ("EndTime", end.isNull(), "end time is required"),
        ("StartTime", start > end, "start time must be before end time"),
        ("Progress", (F.col("progress") < 0) | (F.col("progress") > 100),
         "progress must be between 0 and 100"),
        ("RecordsCollected", F.col("records_collected") < 0, "records collected cannot be negative"),
        ("RetryCount", F.col("retry_count") < 0, "retry count cannot be negative"),
        ("Interval", ~valid("interval", JOB_INTERVALS), F.concat(
            F.lit("invalid interval format '"), text("interval"),
            F.lit("', expected formats like '1m', '5m', '1h', '1d'"))),
    ]
    return jobs.withColumn("errors", F.array_compact(F.array(*[
        F.when(broken, _failure(field, message)) for field, broken, message in rules])))


def validate_pairs(pairs: DataFrame) -> DataFrame:
    """Adds the first broken rule of each trading pair as ``error_field``/``error_message``."""
    rules = [
        ("symbol", _is_blank(F.col("symbol")), "trading pair symbol cannot be empty"),
        ("base_asset", _is_blank(F.col("base_asset")), "base asset cannot be empty"),
        ("quote_asset", _is_blank(F.col("quote_asset")), "quote asset cannot be empty"),
    ]
    for f in ("min_volume", "max_volume", "price_step"):
        rules.append((f, (F.col(f) != "") & ~F.col(f).rlike(r"[^ \t\n\r]"), (
            f"invalid {f.replace('_', ' ')} format: validation error for field decimal: "
            "decimal string contains only whitespace")))
    failed = _first_failure(rules)
    return pairs.withColumn("_f", failed).select(
        *pairs.columns, F.col("_f.field").alias("error_field"), F.col("_f.message").alias("error_message"))


def anomaly_error(a) -> Column:
    """First broken rule of an anomaly struct."""
    known = lambda c, allowed: F.coalesce(c.isin(allowed), F.lit(False))
    return F.coalesce(
        F.when(~known(a["type"], ANOMALY_TYPES), F.concat(
            F.lit("invalid anomaly type: "), F.coalesce(a["type"], F.lit("")))),
        F.when(_is_blank(a["description"]), F.lit("anomaly description is required")),
        F.when(~F.coalesce(a["confidence"].between(0.0, 1.0), F.lit(False)),
               F.lit("confidence must be between 0.0 and 1.0")),
        F.when(~known(a["severity"], SEVERITIES), F.concat(
            F.lit("invalid severity level: "), F.coalesce(a["severity"], F.lit("")))),
    )


def validate_anomalies(anomalies: DataFrame) -> DataFrame:
    """Adds the first broken rule of each exploded anomaly as ``error``."""
    row = {f: F.col(f) for f in ("type", "description", "confidence", "severity")}
    return anomalies.withColumn("error", anomaly_error(row))


def validate_results(results: DataFrame) -> DataFrame:
    """Adds the first broken rule of each validation result as ``error``."""
    bad = F.filter(F.transform("anomalies", anomaly_error), lambda e: e.isNotNull())
    rules = [
        (_is_blank(F.col("id")), F.lit("validation result ID is required")),
        (_is_blank(F.col("pair")), F.lit("trading pair is required")),
        (F.col("candle_timestamp").isNull(), F.lit("candle timestamp is required")),
        (F.col("validation_time").isNull(), F.lit("validation time is required")),
        (~F.coalesce(F.col("severity").isin(SEVERITIES), F.lit(False)), F.concat(
            F.lit("invalid severity level: "), F.coalesce("severity", F.lit("")))),
        (~F.coalesce(F.col("action_taken").isin(ACTIONS), F.lit(False)), F.concat(
            F.lit("invalid action type: "), F.coalesce("action_taken", F.lit("")))),
        (F.size(bad) > 0, F.concat(F.lit("anomaly is invalid: "), F.get(bad, F.lit(0)))),
    ]
    return results.withColumn("error", F.coalesce(*[F.when(b, m) for b, m in rules]))


def validate_query_requests(requests: DataFrame) -> DataFrame:
    """Requests (pair, interval, start_time, end_time, limit, offset, order) with the first reason to reject each.

    ``error`` is NULL for a request that :func:`validate_query_request` accepts. A missing limit or
    offset is 0, a missing order ascending, a missing time no range.
    """
    rules = [
        (_is_blank_text("pair"), F.lit("pair cannot be empty")),
        (_is_blank_text("interval"), F.lit("interval cannot be empty")),
        (~F.coalesce(F.col("end_time") > F.col("start_time"), F.lit(False)), F.lit("end time must be after start time")),
        (F.coalesce("offset", F.lit(0)) < 0, F.lit("offset cannot be negative")),
        (F.coalesce("limit", F.lit(0)) < 0, F.lit("limit cannot be negative")),
        (~F.coalesce("order", F.lit("asc")).isin("asc", "desc"), F.lit("order must be 'asc' or 'desc'")),
        (~F.col("interval").isin(list(QUERY_INTERVALS)), F.concat(F.lit("invalid interval: "), F.col("interval"))),
    ]
    return requests.withColumn("error", F.coalesce(*[F.when(b, m) for b, m in rules]))


def _is_blank_text(name: str):
    return F.coalesce(F.col(name), F.lit("")) == ""


def validate_query_request(pair, interval, start, end, limit=0, offset=0, order="asc"):
    """Argument check of the query API; raises ``ValueError``."""
    if not pair:
        raise ValueError("pair cannot be empty")
    if not interval:
        raise ValueError("interval cannot be empty")
    if not end > start:
        raise ValueError("end time must be after start time")
    if offset < 0:
        raise ValueError("offset cannot be negative")
    if limit < 0:
        raise ValueError("limit cannot be negative")
    if order not in ("asc", "desc"):
        raise ValueError("order must be 'asc' or 'desc'")
    if interval not in QUERY_INTERVALS:
        raise ValueError(f"invalid interval: {interval}")
    return seconds_of(interval)
