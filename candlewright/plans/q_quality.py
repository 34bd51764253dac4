"""Queries: validation, anomalies, scoring and quality."""

from pyspark.sql import functions as F

from candlewright.functions import scoring
from candlewright.functions.decimals import ratio
from candlewright.operators import anomalies, quality, validate
from candlewright.plans.catalog import query
from candlewright.plans.sqlparts import NUMERIC, plain, r6
from candlewright.schemas import CANDLE_FIELDS, SERIES_KEY

KEY = 'pair, "interval", "timestamp"'
SLOT = ["slot_pair", "slot_time"]


def _failures():
    yield "d.\"timestamp\" IS NULL", "timestamp", "'timestamp cannot be null or zero'"
    for f in CANDLE_FIELDS:
        what = "volume" if f == "volume" else f"{f} price"
        yield (f"NOT regexp_matches(d.{f}, '{NUMERIC}')", f,
               f"'invalid {what} format: can''t convert ' || d.{f} || ' to decimal'")
        yield f"t.{f} IS NULL", f, f"'{what} out of range: ' || d.{f}"
    for f in CANDLE_FIELDS[:4]:
        yield f"t.{f} <= 0", f, f"'{f} price must be greater than 0'"
    yield "t.volume < 0", "volume", "'volume must be greater than or equal to 0'"
    top, bottom = "greatest(t.open, t.close)", "least(t.open, t.close)"
    yield (f"t.high < {top}", "high", f"'high price (' || {plain('t.high')} || "
           f"') must be greater than or equal to max(open, close) (' || {plain(top)} || ')'")
    yield (f"t.low > {bottom}", "low", f"'low price (' || {plain('t.low')} || "
           f"') must be less than or equal to min(open, close) (' || {plain(bottom)} || ')'")
    yield "d.pair = ''", "pair", "'pair cannot be empty'"
    yield "d.\"interval\" = ''", "interval", "'interval cannot be empty'"


_FIELD = "CASE " + " ".join(f"WHEN {c} THEN '{f}'" for c, f, _ in _failures()) + " END"
_MESSAGE = "CASE " + " ".join(f"WHEN {c} THEN {m}" for c, _, m in _failures()) + " END"
CHECKED = f"""SELECT slot_pair, slot_time, {_FIELD} AS error_field, {_MESSAGE} AS error_message,
    t.open, t.high, t.low, t.close, t.volume FROM dirty d JOIN typed t USING (slot_pair, slot_time)"""


@query("validate_candles", f"SELECT slot_pair, slot_time, error_field, error_message FROM ({CHECKED})", ["typed"])
def validate_candles(fx):
    return validate.validate_candles(fx.dirty()).select(*SLOT, "error_field", "error_message")


_R = ", ".join(f"{r6(c)} AS {c}" for c in CANDLE_FIELDS)


@query("split_valid_invalid", f"SELECT slot_pair, slot_time, {_R} FROM ({CHECKED}) WHERE error_field IS NULL", ["typed"])
def split_valid(fx):
    return validate.split_valid_invalid(fx.dirty())[0].select(*SLOT, *CANDLE_FIELDS)


@query("split_valid_invalid_rejects", f"""SELECT slot_pair, slot_time, error_field FROM ({CHECKED})
    WHERE error_field IS NOT NULL""", ["typed"])
def split_invalid(fx):
    return validate.split_valid_invalid(fx.dirty())[1].select(*SLOT, "error_field")


_COUNT = "CAST(count(*) FILTER (WHERE %s) AS BIGINT)"
_CONSTRAINTS = {
    "high_covers_body": "NOT (high >= open AND high >= close)",
    "low_covers_body": "NOT (low <= open AND low <= close)",
    "positive_prices": "NOT (open > 0 AND high > 0 AND low > 0 AND close > 0)",
    "non_negative_volume": "NOT (volume >= 0)",
}


@query("table_constraints", " UNION ALL ".join(
    f"SELECT '{n}' AS constraint_name, {_COUNT % c} AS violations FROM typed" for n, c in _CONSTRAINTS.items()), ["typed"])
def table_constraints(fx):
    return validate.table_constraints(fx.typed())


_SPEC = {
    "negative_price": "t.open < 0 OR t.high < 0 OR t.low < 0 OR t.close < 0",
    "missing_field": " OR ".join(f"trim(d.{c}) = ''" for c in CANDLE_FIELDS),
    "high_below_low": "t.high < t.low",
    "close_outside_range": "t.close < t.low OR t.close > t.high",
}


@query("spec_consistency", " UNION ALL ".join(
    f"SELECT '{n}' AS rule, {_COUNT % c} AS n FROM dirty d JOIN typed t USING (slot_pair, slot_time)"
    for n, c in _SPEC.items()), ["typed"])
def spec_consistency(fx):
    return validate.spec_consistency(fx.dirty())


# --- per-candle anomalies ----------------------------------------------------------

@query("logic_anomalies", f"""SELECT slot_pair, slot_time, 'logic_error' AS type, rule, description, {r6('value')} AS value,
      CAST(0 AS DOUBLE) AS threshold, CAST(1 AS DOUBLE) AS confidence, 'error' AS severity FROM logic""", ["logic"])
def logic_anomalies(fx):
    return validate.logic_anomalies(fx.typed()).select(
        *SLOT, "type", "rule", "description", "value", "threshold", "confidence", "severity")


_SEVERITY = "CASE WHEN anomaly_count > 0 THEN 'error' ELSE 'info' END"
_ACTION = "CASE WHEN anomaly_count > 0 THEN 'quarantined' ELSE 'none' END"
_CHECKS = """CASE WHEN logic_n = 0 THEN 'ohlcv_logic,' ELSE '' END
    || CASE WHEN candle_timestamp IS NOT NULL THEN 'timestamp_valid,' ELSE '' END || CASE WHEN pair <> '' THEN 'pair_valid,' ELSE '' END"""


@query("candle_results", f"""SELECT id, pair, "interval", candle_timestamp, rtrim({_CHECKS}, ',') AS checks,
      anomaly_count, {_SEVERITY} AS severity, {_ACTION} AS action_taken FROM results""", ["results"])
def candle_results(fx):
    results, _ = fx.results()
    return results.select(
        "id", *SERIES_KEY, "candle_timestamp", F.array_join("checks_passed", ",").alias("checks"),
        F.size("anomalies").alias("anomaly_count"), "severity", "action_taken")


@query("candle_results_errors", """SELECT pair, "interval", "timestamp" AS candle_timestamp, 'validation_failure' AS error_type,
      'error' AS severity, CASE WHEN open IS NULL THEN 'open' WHEN high IS NULL THEN 'high' WHEN low IS NULL THEN 'low'
        WHEN close IS NULL THEN 'close' ELSE 'volume' END AS field
    FROM typed WHERE open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL""", ["typed"])
def candle_errors(fx):
    return fx.results()[1]


_FACT = """SELECT r.id AS validation_result_id, l.pair, l."interval", l."timestamp" AS candle_timestamp, l.rule
    FROM logic l JOIN results r USING (slot_pair, slot_time)
    UNION ALL SELECT id, pair, "interval", candle_timestamp, 'timestamp_validation' FROM results WHERE candle_timestamp IS NULL
    UNION ALL SELECT id, pair, "interval", candle_timestamp, 'pair_validation' FROM results WHERE pair = ''"""


@query("explode_anomalies", _FACT, ["results"])
def explode_anomalies(fx):
    return validate.explode_anomalies(fx.results()[0]).select(
        "validation_result_id", *SERIES_KEY, "candle_timestamp", "rule")


@query("results_anomalies", f"""SELECT f.validation_result_id, f.pair, f."interval", f.candle_timestamp, f.rule,
      'error' AS result_severity, {r6('c.close')} AS candle_close
    FROM ({_FACT}) f JOIN c1h c ON c.pair = f.pair AND c."timestamp" = f.candle_timestamp""", ["results", "c1h"])
def results_anomalies(fx):
    results, _ = fx.results()
    joined, _ = validate.results_anomalies(results, validate.explode_anomalies(results), fx.candles("1h"))
    return joined.select("validation_result_id", *SERIES_KEY, "candle_timestamp", "rule",
                         "result_severity", "candle_close")


@query("results_anomalies_orphans", f"""SELECT f.* FROM ({_FACT}) f WHERE NOT EXISTS
    (SELECT 1 FROM c1h c WHERE c.pair = f.pair AND c."timestamp" = f.candle_timestamp)""", ["results", "c1h"])
def results_orphans(fx):
    results, _ = fx.results()
    _, orphans = validate.results_anomalies(results, validate.explode_anomalies(results), fx.candles("1h"))
    return orphans.select("validation_result_id", *SERIES_KEY, "candle_timestamp", "rule")


@query("validate_results", """SELECT id, pair, candle_timestamp, CASE WHEN pair = '' THEN 'trading pair is required'
      WHEN candle_timestamp IS NULL THEN 'candle timestamp is required' END AS error FROM results""", ["results"])
def validate_results(fx):
    return validate.validate_results(fx.results()[0]).select("id", "pair", "candle_timestamp", "error")


# Scored anomalies with values pushed out of range on purpose.
@query("validate_anomalies", f"""SELECT {KEY}, kind AS type, CASE WHEN k % 4 = 0 THEN 'invalid anomaly type: odd'
      WHEN k % 4 = 1 THEN 'confidence must be between 0.0 and 1.0' WHEN k % 4 = 2 THEN 'invalid severity level: loud' END AS error
    FROM (SELECT *, CAST(epoch("timestamp") AS BIGINT) // 3600 AS k FROM scored)""", ["scored"])
def validate_anomalies(fx):
    k = F.pmod(F.floor(F.unix_seconds("timestamp") / 3600), F.lit(4))
    found = _cross(fx).withColumns({
        "kind": F.col("type"), "type": F.when(k == 0, "odd").otherwise(F.col("type")),
        "confidence": F.when(k == 1, F.lit(1.5)).otherwise(F.col("confidence")),
        "severity": F.when(k == 2, "loud").otherwise(F.col("severity"))})
    return validate.validate_anomalies(found).select(
        *SERIES_KEY, "timestamp", F.col("kind").alias("type"), "error")


# --- anomalies between candles -------------------------------------------------------

def _cross(fx):
    return anomalies.cross_anomalies(anomalies.candle_steps(fx.candles("1h"), slots_per_bucket=100))


SCORED = [*SERIES_KEY, "timestamp", "type", "value", "threshold", "confidence", "severity"]
SCORED_SQL = f"""SELECT {KEY}, kind AS type, {r6('value')} AS value, CAST(threshold AS DOUBLE) AS threshold,
    {r6('confidence')} AS confidence, severity FROM scored"""


@query("price_spikes", f"{SCORED_SQL} WHERE kind = 'price_spike'", ["scored"])
def price_spikes(fx):
    return anomalies.price_spikes(fx.candles("1h")).select(*SCORED)


@query("volume_surges", f"{SCORED_SQL} WHERE kind = 'volume_surge'", ["scored"])
def volume_surges(fx):
    return anomalies.volume_surges(fx.candles("1h")).select(*SCORED)


@query("score_anomalies", SCORED_SQL, ["scored"])
def score_anomalies(fx):
    return _cross(fx).select(*SCORED)


@query("filter_anomalies", f"{SCORED_SQL} WHERE kind = 'price_spike' AND confidence >= 0.6", ["scored"])
def filter_anomalies(fx):
    return anomalies.filter_anomalies(_cross(fx), "price_spike", 0.6).select(*SCORED)


@query("min_confidence_filter", f"{SCORED_SQL} WHERE confidence >= 0.7", ["scored"])
def min_confidence_filter(fx):
    return anomalies.min_confidence_filter(_cross(fx)).select(*SCORED)


_RATIOS = """SELECT pair, "timestamp", CASE WHEN prev_high <> 0 THEN CAST(high AS DOUBLE) / CAST(prev_high AS DOUBLE) END AS r,
    CASE WHEN prev_volume <> 0 THEN CAST(volume AS DOUBLE) / CAST(prev_volume AS DOUBLE) END AS v FROM steps WHERE prev_timestamp IS NOT NULL"""


def _ratios(fx):
    steps = anomalies.candle_steps(fx.candles("1h"))
    return steps.select("pair", "timestamp", ratio(F.col("high"), F.col("prev_high")).alias("r"),
                        ratio(F.col("volume"), F.col("prev_volume")).alias("v"))


_SPIKE_SQL = "CASE WHEN r <= 5 THEN 0 WHEN r > 5 THEN least(0.5 + (r - 5) / 5 * 0.1::DOUBLE, 1) END"
_SURGE_SQL = "CASE WHEN v <= 10 THEN 0 WHEN v > 10 THEN least(0.6 + (v - 10) / 10 * 0.08::DOUBLE, 1) END"


@query("spike_confidence", f'SELECT pair, "timestamp", {r6(_SPIKE_SQL)} AS confidence FROM ({_RATIOS})', ["steps"])
def spike_confidence(fx):
    return _ratios(fx).select("pair", "timestamp", scoring.spike_confidence(F.col("r")).alias("confidence"))


@query("surge_confidence", f'SELECT pair, "timestamp", {r6(_SURGE_SQL)} AS confidence FROM ({_RATIOS})', ["steps"])
def surge_confidence(fx):
    return _ratios(fx).select("pair", "timestamp", scoring.surge_confidence(F.col("v")).alias("confidence"))


@query("severity_of", f"""SELECT pair, "timestamp", CASE WHEN c >= 0.9 AND r / 5 > 2 THEN 'critical' WHEN c >= 0.7 THEN 'error' ELSE 'warning' END AS spike,
      CASE WHEN d >= 0.9 AND v / 10 > 5 THEN 'critical' WHEN d >= 0.7 THEN 'error' ELSE 'warning' END AS surge
    FROM (SELECT *, {_SPIKE_SQL} AS c, {_SURGE_SQL} AS d FROM ({_RATIOS}))""", ["steps"])
def severity_of(fx):
    both = _ratios(fx)
    return both.select(
        "pair", "timestamp",
        scoring.severity_of(F.lit("price_spike"), F.col("r"), F.lit(5.0),
                            scoring.spike_confidence(F.col("r"))).alias("spike"),
        scoring.severity_of(F.lit("volume_surge"), F.col("v"), F.lit(10.0),
                            scoring.surge_confidence(F.col("v"))).alias("surge"))


_PER_CANDLE = f"""SELECT pair, "interval", "timestamp", count(*) AS n, max(CASE severity WHEN 'critical' THEN 3 WHEN 'error' THEN 2
    WHEN 'warning' THEN 1 ELSE 0 END) AS rank, max(confidence) AS top FROM scored GROUP BY ALL"""
_WORST = "['info', 'warning', 'error', 'critical'][rank + 1]"


def _per_candle(fx):
    """Anomalies of a candle gathered into an array; at most one per check."""
    return _cross(fx).groupBy(*SERIES_KEY, "timestamp").agg(
        F.collect_list(F.struct("type", "confidence", "severity")).alias("anomalies")
    ).withColumn("severity", scoring.worst_severity(F.col("anomalies.severity")))


@query("escalate_severity", f"SELECT {KEY}, n, {_WORST} AS severity FROM ({_PER_CANDLE})", ["scored"])
def escalate_severity(fx):
    return _per_candle(fx).select(*SERIES_KEY, "timestamp", F.size("anomalies").alias("n"), "severity")


@query("recommend_action", f"""SELECT {KEY}, CASE rank WHEN 3 THEN 'rejected' WHEN 2 THEN 'quarantined'
    WHEN 1 THEN 'alerted' ELSE 'logged' END AS action FROM ({_PER_CANDLE})""", ["scored"])
def recommend_action(fx):
    return _per_candle(fx).select(*SERIES_KEY, "timestamp", scoring.recommend_action(
        F.col("severity"), F.size("anomalies")).alias("action"))


@query("requires_escalation", f"""SELECT {KEY}, rank >= 2 OR top >= 0.8 AS requires_escalation,
    NOT (rank >= 2) AND NOT (top >= 0.9) AS is_acceptable FROM ({_PER_CANDLE})""", ["scored"])
def requires_escalation(fx):
    severity, found = F.col("severity"), F.col("anomalies")
    return _per_candle(fx).select(
        *SERIES_KEY, "timestamp",
        scoring.requires_escalation(severity, found).alias("requires_escalation"),
        scoring.is_acceptable(severity, found).alias("is_acceptable"))


_SEQ = """SELECT pair, event_id, "timestamp", prev_timestamp, "timestamp" < prev_timestamp AS late,
    CAST(epoch_us("timestamp") - epoch_us(prev_timestamp) AS DOUBLE) / 1000000 - 3600 AS gap FROM events_steps
    WHERE prev_timestamp IS NOT NULL"""


def _arrivals(fx):
    """Hour of every event, in event order."""
    return fx.ticks().select("pair", F.lit("1h").alias("interval"), F.col("tick_id").alias("event_id"),
                             F.date_trunc("hour", "ts").alias("timestamp"))


_CONF = "greatest(least(gap / 120, 1), 0)"


@query("sequence_anomalies", f"""SELECT pair, event_id, "timestamp", prev_timestamp, CASE WHEN late THEN 'out_of_order' ELSE 'interval_gap' END AS rule,
      {r6('gap / 60')} AS value, {r6(_CONF)} AS confidence, CASE WHEN {_CONF} >= 0.8 THEN 'error' ELSE 'warning' END AS severity
    FROM ({_SEQ}) WHERE late OR abs(gap) > 120""", ["events_steps"])
def sequence_anomalies(fx):
    return anomalies.sequence_anomalies(_arrivals(fx), "event_id", rows_per_bucket=500).select(
        "pair", "event_id", "timestamp", "prev_timestamp", "rule", "value", "confidence", "severity")


# Arrival order scrambled by a multiplier, so that many rows come in late. Above 1,000,003 ticks numbers
# repeat; the SQL leaves their order open, here it is that of the ticks.
@query("sequence_out_of_order", """SELECT pair, count(*) AS n, CAST(count(*) FILTER (WHERE "timestamp" < p) AS BIGINT) AS out_of_order
    FROM (SELECT *, lag("timestamp") OVER (PARTITION BY pair ORDER BY arrival_seq) AS p FROM arrival)
    WHERE p IS NOT NULL AND ("timestamp" < p OR abs(epoch_us("timestamp") - epoch_us(p) - 3600000000) > 120000000) GROUP BY pair""", ["arrival"])
def sequence_out_of_order(fx):
    rows = fx.ticks().select(
        "pair", F.lit("1h").alias("interval"), F.col("ts").alias("timestamp"), "tick_id",
        F.pmod(F.col("tick_id") * 7919, F.lit(1000003)).alias("arrival_seq"))
    return anomalies.sequence_anomalies(rows, "arrival_seq", ties=["tick_id"]).groupBy("pair").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("rule") == "out_of_order").alias("out_of_order"))


@query("sequence_confidence", f"""SELECT pair, event_id, {r6(_CONF)} AS confidence FROM ({_SEQ})""", ["events_steps"])
def sequence_confidence(fx):
    from candlewright.operators.series import number_bucket, transitions

    steps = transitions(_arrivals(fx), ["pair"], "event_id", ["timestamp"], number_bucket(F.col("event_id")), levels=1)
    gap = (F.unix_micros("timestamp") - F.unix_micros("prev_timestamp")) / 1_000_000 - 3600
    return steps.select("pair", "event_id", scoring.sequence_confidence(gap, 120).alias("confidence"))


@query("estimate_interval", """SELECT pair, "interval", CAST(CASE WHEN step = 0 THEN 3600 ELSE step END AS BIGINT) AS interval_seconds FROM (
      SELECT pair, "interval", step, row_number() OVER (PARTITION BY pair, "interval" ORDER BY n DESC, step) AS rn FROM (
        SELECT pair, "interval", CAST(round((epoch_us("timestamp") - epoch_us(p)) / 60000000) * 60 AS BIGINT) AS step, count(*) AS n FROM (
          SELECT *, lag("timestamp") OVER (PARTITION BY pair, "interval" ORDER BY "timestamp") AS p FROM (
            SELECT pair, "interval", "timestamp" FROM c5m UNION ALL SELECT pair, "interval", "timestamp" FROM c1h
            UNION ALL SELECT pair, "interval", "timestamp" FROM c1d)) WHERE p IS NOT NULL GROUP BY ALL)) WHERE rn = 1""", ["c5m", "c1h", "c1d"])
def estimate_interval(fx):
    cut = [*SERIES_KEY, "timestamp"]
    rows = fx.candles("5m").select(*cut).unionByName(fx.candles("1h").select(*cut)).unionByName(
        fx.daily().select(*cut))
    return anomalies.estimate_interval(rows)


_MA = """SELECT pair, "interval", "timestamp", volume, avg(CAST(volume AS DOUBLE)) OVER (PARTITION BY pair, "interval" ORDER BY "timestamp"
    RANGE BETWEEN INTERVAL {days} DAYS PRECEDING AND INTERVAL 1 SECOND PRECEDING) AS ma FROM {source}"""


@query("volume_surge_ma", f"""SELECT {KEY}, {r6('volume')} AS volume, {r6('ma')} AS moving_average
    FROM ({_MA.format(days=30, source='c1h')}) WHERE volume > 3 * ma""", ["c1h"])
def volume_surge_ma(fx):
    return anomalies.volume_surge_ma(fx.candles("1h"), 3.0)


@query("volume_surge_ma_daily", f"""SELECT {KEY}, {r6('volume')} AS volume, {r6('ma')} AS moving_average
    FROM ({_MA.format(days=30, source='c1d')}) WHERE volume > 1.5 * ma""", ["c1d"])
def volume_surge_ma_daily(fx):
    return anomalies.volume_surge_ma(fx.daily(), 1.5)


_PREV = """SELECT *, lag(high) OVER w AS prev_high, lag(volume) OVER w AS prev_volume, lag("timestamp") OVER w AS prev_time
    FROM typed WHERE "timestamp" IS NOT NULL WINDOW w AS (PARTITION BY pair, "interval" ORDER BY "timestamp", slot_pair)"""


# Spacing as estimated from the rows themselves, also for the series of rows without a pair.
_SPACING = """SELECT pair, "interval", CASE WHEN step = 0 THEN 3600 ELSE step END AS secs FROM (
    SELECT *, row_number() OVER (PARTITION BY pair, "interval" ORDER BY n DESC, step) AS rn FROM (
      SELECT pair, "interval", CAST(round((epoch_us("timestamp") - epoch_us(prev_time)) / 60000000) * 60 AS BIGINT) AS step, count(*) AS n
      FROM p WHERE prev_time IS NOT NULL GROUP BY ALL)) WHERE rn = 1"""


@query("validate_all", f"""WITH p AS ({_PREV}) SELECT pair, "interval", "timestamp", type, rule, severity, round(value, 6) AS value FROM (
      SELECT pair, "interval", "timestamp", 'logic_error' AS type, rule, 'error' AS severity, value FROM logic
      UNION ALL SELECT {KEY}, 'price_spike', 'high_ratio', CASE WHEN r >= 25 THEN 'critical' WHEN r >= 15 THEN 'error' ELSE 'warning' END, r
        FROM (SELECT {KEY}, CAST(high AS DOUBLE) / CAST(prev_high AS DOUBLE) AS r FROM p WHERE prev_high > 0 AND high > 5.00 * prev_high)
      UNION ALL SELECT {KEY}, 'volume_surge', 'volume_ratio', CASE WHEN r > 50 THEN 'critical' WHEN r >= 22.5 THEN 'error' ELSE 'warning' END, r
        FROM (SELECT {KEY}, CAST(volume AS DOUBLE) / CAST(prev_volume AS DOUBLE) AS r FROM p
              WHERE (prev_volume > 0 AND volume > 10.00 * prev_volume) OR (prev_volume < 0 AND volume < 10.00 * prev_volume))
      UNION ALL SELECT {KEY}, 'sequence_gap', 'interval_gap', CASE WHEN g >= 96 THEN 'error' ELSE 'warning' END, g / 60
        FROM (SELECT p.pair, p."interval", p."timestamp", epoch(p."timestamp") - epoch(prev_time) - secs AS g
              FROM p JOIN ({_SPACING}) s ON s.pair = p.pair AND s."interval" = p."interval" WHERE prev_time IS NOT NULL) WHERE abs(g) > 120)""",
       ["typed", "logic"])
def validate_all(fx):
    return anomalies.validate_all(fx.dirty().drop("slot_time"), ties=["slot_pair"]).select(
        *SERIES_KEY, "timestamp", "type", "rule", "severity", "value")


# --- quality ---------------------------------------------------------------------------

def _metrics(source, sequence=""):
    return f"""SELECT pair, "interval", total_candles, valid_candles, validation_errors, anomalies_detected, critical_issues,
      valid_candles / total_candles AS success_rate, anomalies_detected / total_candles AS anomaly_rate,
      greatest(0.7 * (1 - validation_errors / total_candles) + 0.3 * (1 - anomalies_detected / total_candles), 0) AS quality_score
    FROM ({source})"""


_BASE = """SELECT pair, "interval", CAST(count(*) AS BIGINT) AS total_candles, CAST(count(*) FILTER (WHERE anomaly_count = 0) AS BIGINT) AS valid_candles,
    CAST(count(*) FILTER (WHERE anomaly_count > 0) AS BIGINT) AS validation_errors, CAST(sum(anomaly_count) AS BIGINT) AS anomalies_detected,
    CAST(0 AS BIGINT) AS critical_issues FROM results GROUP BY GROUPING SETS ((pair, "interval"), ())"""
_ADVICE = """concat_ws('; ', CASE WHEN quality_score < 0.5 THEN 'Data quality is critically low - investigate data sources'
      WHEN quality_score < 0.8 THEN 'Data quality needs improvement - review validation failures' END,
    CASE WHEN anomaly_rate > 0.1 THEN 'High anomaly rate detected - check for data feed issues' END,
    CASE WHEN critical_issues > 0 THEN 'Critical issues found - immediate attention required' END)"""
_METRIC_COLUMNS = [*SERIES_KEY, "total_candles", "valid_candles", "validation_errors",
                   "anomalies_detected", "critical_issues", "success_rate", "anomaly_rate", "quality_score"]
_SQL_COLUMNS = """pair, "interval", total_candles, valid_candles, validation_errors, anomalies_detected, critical_issues,
    round(success_rate, 6) AS success_rate, round(anomaly_rate, 6) AS anomaly_rate, round(quality_score, 6) AS quality_score"""


@query("quality_metrics", f"SELECT {_SQL_COLUMNS}, {_ADVICE} AS advice FROM ({_metrics(_BASE)})", ["results"])
def quality_metrics(fx):
    return quality.quality_metrics(fx.results()[0]).select(
        *_METRIC_COLUMNS, F.array_join("recommended_actions", "; ").alias("advice"))


_CROSS = f"""SELECT b.pair, b."interval", total_candles, valid_candles, validation_errors, anomalies_detected + coalesce(n, 0) AS anomalies_detected,
    critical_issues + coalesce(c, 0) AS critical_issues
  FROM ({_BASE}) b LEFT JOIN (SELECT pair, "interval", CAST(count(*) AS BIGINT) AS n,
    CAST(count(*) FILTER (WHERE severity = 'critical') AS BIGINT) AS c FROM scored GROUP BY GROUPING SETS ((pair, "interval"), ())) s
  ON s.pair IS NOT DISTINCT FROM b.pair AND s."interval" IS NOT DISTINCT FROM b."interval\""""


@query("quality_metrics_with_cross", f"SELECT {_SQL_COLUMNS} FROM ({_metrics(_CROSS)})", ["results", "scored"])
def quality_metrics_with_cross(fx):
    found = _cross(fx).select(*SERIES_KEY, "severity")
    return quality.quality_metrics(fx.results()[0], found).select(*_METRIC_COLUMNS)


@query("anomalies_by_type", """SELECT pair, "interval", type, CAST(sum(n) AS BIGINT) AS anomalies FROM (
      SELECT pair, "interval", 'logic_error' AS type, sum(anomaly_count) AS n FROM results GROUP BY ALL HAVING sum(anomaly_count) > 0
      UNION ALL SELECT pair, "interval", kind, count(*) FROM scored GROUP BY ALL)
    GROUP BY GROUPING SETS ((pair, "interval", type), (type))""", ["results", "scored"])
def anomalies_by_type(fx):
    return quality.anomalies_by_type(fx.results()[0], _cross(fx))


@query("quality_gate", f"""SELECT pair, "interval", round(quality_score, 6) AS quality_score,
    CASE WHEN quality_score >= 0.8 THEN 'pass' ELSE 'fail' END AS gate FROM ({_metrics(_BASE)})""", ["results"])
def quality_gate(fx):
    return quality.quality_gate(quality.quality_metrics(fx.results()[0])).select(
        *SERIES_KEY, "quality_score", "gate")


_N = "CAST(%s AS DOUBLE)"


@query("summarise_results", f"""SELECT 'total_results' AS metric, NULL::VARCHAR AS label, {_N % 'count(*)'} AS value FROM results
    UNION ALL SELECT 'total_anomalies', NULL, {_N % 'sum(anomaly_count)'} FROM results
    UNION ALL SELECT 'total_checks', NULL, {_N % 'sum(checks_count)'} FROM results
    UNION ALL SELECT 'quality_score', NULL, {r6('1 - count(*) FILTER (WHERE anomaly_count > 0) / count(*)')} FROM results
    UNION ALL SELECT 'severity', {_SEVERITY}, {_N % 'count(*)'} FROM results GROUP BY ALL
    UNION ALL SELECT 'action', {_ACTION}, {_N % 'count(*)'} FROM results GROUP BY ALL
    UNION ALL SELECT 'anomaly_type', 'logic_error', {_N % 'sum(anomaly_count)'} FROM results HAVING sum(anomaly_count) > 0""", ["results"])
def summarise_results(fx):
    return quality.summarise_results(fx.results()[0])


_PARSE_OK = "open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL"
_STATE = "CASE WHEN bad = 0 THEN 'success' WHEN bad >= n THEN 'failure' ELSE 'partial_failure' END"


def _parse_state(fx):
    ok = F.col("open").isNotNull()
    for c in CANDLE_FIELDS[1:]:
        ok = ok & F.col(c).isNotNull()
    return fx.typed().withColumn("is_parseable", ok)


@query("validation_run_status", f"""SELECT pair, "interval", n AS processed_candles, n - bad AS valid_candles, bad AS invalid_candles, {_STATE} AS status
    FROM (SELECT pair, "interval", CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE NOT ({_PARSE_OK})) AS BIGINT) AS bad FROM typed GROUP BY ALL)""", ["typed"])
def validation_run_status(fx):
    return quality.pipeline_status(_parse_state(fx))


@query("validation_batch_status", f"""SELECT batch, n AS processed_candles, n - bad AS valid_candles, bad AS invalid_candles, {_STATE} AS status
    FROM (SELECT date_trunc('day', slot_time) AS batch, CAST(count(*) AS BIGINT) AS n,
        CAST(count(*) FILTER (WHERE NOT ({_PARSE_OK})) AS BIGINT) AS bad FROM typed GROUP BY ALL)""", ["typed"])
def validation_batch_status(fx):
    return quality.pipeline_status(_parse_state(fx), [F.date_trunc("day", "slot_time").alias("batch")])


_RUNS = f"""SELECT date_trunc('hour', slot_time) AS run_at, count(*) AS n, count(*) FILTER (WHERE NOT ({_PARSE_OK})) AS bad,
    count(*) FILTER (WHERE high < greatest(open, close)) AS anomalies FROM typed GROUP BY ALL"""


@query("validation_stats_rollup", f"""SELECT CAST(sum(n) AS BIGINT) AS total_validated, CAST(sum(bad) AS BIGINT) AS validation_errors,
      CAST(sum(anomalies) AS BIGINT) AS anomalies_detected, {r6('avg(1 - bad / n)')} AS quality_score
    FROM (SELECT * FROM ({_RUNS}) ORDER BY run_at DESC LIMIT 100)""", ["typed"])
def validation_stats_rollup(fx):
    runs = _parse_state(fx).groupBy(F.date_trunc("hour", "slot_time").alias("run_at")).agg(
        F.count(F.lit(1)).alias("processed_candles"),
        F.count_if(~F.col("is_parseable")).alias("invalid_candles"),
        F.count_if(F.col("high") < F.greatest("open", "close")).alias("anomalies_detected"))
    return quality.validation_stats_rollup(runs.withColumns({
        "run_id": F.unix_seconds("run_at"),
        "quality_score": 1 - F.col("invalid_candles") / F.col("processed_candles")}))


@query("storage_stats", """SELECT CAST(count(*) AS BIGINT) AS total_candles, CAST(count(DISTINCT pair) AS BIGINT) AS total_pairs,
      min("timestamp") AS earliest_data, max("timestamp") AS latest_data, CAST(count(*) * 128 AS BIGINT) AS storage_bytes,
      CAST(count(*) * 128 // 10 AS BIGINT) AS index_bytes, CAST(count(*) * 200 AS BIGINT) AS memory_bytes,
      CAST(count(DISTINCT pair) * 50 AS BIGINT) AS memory_index_bytes FROM c1d""", ["c1d"])
def storage_stats(fx):
    return quality.storage_stats(fx.daily())


@query("storage_stats_by_series", """SELECT pair, "interval", CAST(count(*) AS BIGINT) AS total_candles, min("timestamp") AS earliest_data,
      max("timestamp") AS latest_data FROM (SELECT * FROM c5m UNION ALL SELECT * FROM c1h) GROUP BY ROLLUP (pair, "interval")""", ["c5m", "c1h"])
def storage_stats_by_series(fx):
    return quality.storage_stats_by_series(fx.candles("5m").unionByName(fx.candles("1h")))


_REQUEST = """SELECT event_id AS id, CASE WHEN event_id % 11 <> 0 THEN event_type ELSE '' END AS pair,
      ['1m', '5m', '2h', '1d', '', '1M', 'x', '1h'][event_id % 8 + 1] AS "interval", ts AS start_time,
      CASE WHEN event_id % 17 <> 0 THEN ts + to_hours(CAST(event_id % 7 - 1 AS INTEGER)) END AS end_time,
      CASE WHEN event_id % 5 <> 0 THEN event_id % 13 - 1 END AS "limit", CASE WHEN event_id % 9 <> 0 THEN event_id % 19 - 1 END AS "offset",
      ['asc', 'desc', 'up', NULL][event_id % 4 + 1] AS "order" FROM events"""


@query("validate_query_request", f"""SELECT id, CASE WHEN pair = '' THEN 'pair cannot be empty' WHEN "interval" = '' THEN 'interval cannot be empty'
      WHEN NOT coalesce(end_time > start_time, false) THEN 'end time must be after start time'
      WHEN coalesce("offset", 0) < 0 THEN 'offset cannot be negative' WHEN coalesce("limit", 0) < 0 THEN 'limit cannot be negative'
      WHEN coalesce("order", 'asc') NOT IN ('asc', 'desc') THEN 'order must be ''asc'' or ''desc'''
      WHEN "interval" NOT IN ({', '.join(repr(i) for i in validate.QUERY_INTERVALS)}) THEN 'invalid interval: ' || "interval" END AS error
    FROM ({_REQUEST})""")
def validate_query_request(fx):
    return validate.validate_query_requests(fx.requests()).select("id", "error")
