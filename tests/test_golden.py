"""Fixed cases with known results."""

import pytest
from pyspark.sql import functions as F

from candlewright.functions import decimals, features, intervals, scoring
from candlewright.operators import anomalies, gaps, jobs, lifecycle, quality, query, validate
from candlewright.operators.backfill import backfill_plan

DAY = "2024-01-01 "


def hours(*hs):
    return [f"2024-01-01 {h:02d}:00:00" for h in hs]


def spans(df):
    return sorted((str(r.start_time)[11:16], str(r.end_time)[11:16]) for r in df.collect())


# --- intervals and decimals ---------------------------------------------------------

GOOD = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "2h": 7200, "3m": 180, "4h": 14400,
        "6h": 21600, "8h": 28800, "12h": 43200, "1d": 86400, "3d": 259200, "7d": 604800,
        "1w": 604800, "1M": 2592000}
BAD = ["invalid", "", "5x", "ah", "0m", "-1h", "m", "2w", "1.5h"]


def test_interval_seconds(spark):
    df = spark.createDataFrame([(n,) for n in [*GOOD, *BAD]], "n string")
    got = {r.n: r.s for r in df.select("n", intervals.interval_seconds(F.col("n")).alias("s")).collect()}
    assert got == {**GOOD, **{b: None for b in BAD}}
    assert all(intervals.seconds_of(n) == s for n, s in GOOD.items())
    for b in BAD:
        with pytest.raises(ValueError):
            intervals.seconds_of(b)


def test_next_boundary(spark):
    df = spark.createDataFrame([("1m", "10:31:00"), ("15m", "10:31:20"), ("4h", "10:31:20"), ("1d", "10:31:20"),
                                ("1h", "10:00:00"), ("odd", "10:31:20")], "i string, t string")
    out = df.select("i", intervals.next_boundary(
        F.concat(F.lit(DAY), "t").cast("timestamp"), F.col("i")).cast("string").alias("b")).collect()
    assert {r.i: r.b[8:16] for r in out} == {
        "1m": "01 10:32", "15m": "01 10:45", "4h": "01 12:00", "1d": "02 00:00", "1h": "01 11:00",
        "odd": "01 11:00"}


@pytest.mark.parametrize("text,plain", [
    ("0.000001", "0.000001"), ("999999999.999999999", "999999999.999999999"),
    ("1.123456789012345678", "1.123456789012345678"), ("000123.4500", "123.45"), ("100.00", "100"),
    ("-6.5", "-6.5"), ("1e3", "1000"), ("0", "0"), (".5", "0.5"), ("5.", "5")])
def test_decimal_text(spark, text, plain):
    row = spark.createDataFrame([(text,)], "t string").select(
        decimals.plain_text(decimals.parse_decimal(F.col("t"))).alias("p")).first()
    assert row.p == plain


def test_malformed_and_large_decimals(spark):
    df = spark.createDataFrame([(t,) for t in (
        "NaN", "Infinity", "", " 1.5 ", "12.34.56", "abc", "1_000", None, "1000000000000", "1e400")], "t string")
    out = df.select("t", decimals.parse_decimal(F.col("t")).alias("d"),
                    decimals.out_of_range(F.col("t")).alias("o")).collect()
    assert all(r.d is None for r in out)
    assert {r.t for r in out if r.o} == {"1000000000000", "1e400"}


# --- gaps ----------------------------------------------------------------------------

def test_gaps_in_range(times):
    at = lambda df, a, b: spans(gaps.gaps_in_range(df, DAY + a, DAY + b))
    assert at(times(hours(0, 1, 2, 3, 4)), "00:00", "05:00") == []
    assert at(times(hours(0, 1, 3, 4)), "00:00", "05:00") == [("02:00", "03:00")]
    five = times([f"{DAY}00:{m:02d}:00" for m in (0, 5, 20)], interval="5m")
    assert at(five, "00:00", "00:30") == [("00:10", "00:20"), ("00:25", "00:30")]
    assert at(times(hours(1, 2)), "00:00", "03:00") == [("00:00", "01:00")]
    assert at(times(hours(0, 1)), "00:00", "03:00") == [("02:00", "03:00")]
    assert at(times(hours(0)), "00:00", "01:00") == []


def test_gaps_of_a_series_without_candles(times):
    empty, series = times([]), times(hours(0)).select("pair", "interval")
    assert spans(gaps.gaps_in_range(empty, DAY + "00:00", DAY + "03:00", series)) == [("00:00", "03:00")]


def test_series_outside_the_range_is_one_gap(times):
    assert spans(gaps.gaps_in_range(times(hours(20)), DAY + "00:00", DAY + "03:00")) == [("00:00", "03:00")]


def test_invalid_interval_gives_no_gaps(times):
    assert gaps.gaps_in_range(times(hours(0, 5), interval="bad"), DAY + "00:00", DAY + "09:00").count() == 0


def test_gaps_in_sequence(times):
    found = lambda *s: spans(gaps.gaps_in_sequence(times(list(s))))
    assert found() == [] and found(*hours(0)) == []
    assert found(*hours(0, 1, 2, 3, 4)) == []
    assert found(*hours(0, 1, 3)) == [("02:00", "03:00")]
    assert found(*hours(0, 1, 1, 2)) == []
    assert found(DAY + "00:00:00", DAY + "00:30:00", DAY + "01:00:00") == []


def test_recent_gaps(times):
    got = gaps.recent_gaps(times(hours(0, 1, 3)), DAY + "05:10:00", 5 * 3600)
    assert spans(got) == [("02:00", "03:00"), ("04:00", "05:00")]


def test_trading_calendar(spark):
    rows = [("2024-01-05 20:00:00", "2024-01-08 04:00:00"), ("2024-01-09 10:00:00", "2024-01-09 12:00:00"),
            ("2024-01-05 18:00:00", "2024-01-06 02:00:00")]
    found = spark.createDataFrame(rows, "s string, e string").select(
        F.lit("A").alias("pair"), F.lit("1h").alias("interval"),
        F.col("s").cast("timestamp").alias("start_time"), F.col("e").cast("timestamp").alias("end_time"))
    # Two adjoining closed periods count as one.
    closed = spark.createDataFrame(
        [("2024-01-05 20:00:00", "2024-01-07 00:00:00"), ("2024-01-07 00:00:00", "2024-01-08 04:00:00")],
        "s string, e string").select(F.col("s").cast("timestamp").alias("start_time"),
                                     F.col("e").cast("timestamp").alias("end_time"))
    left = gaps.trading_calendar_filter(found, closed)
    assert sorted(str(r.start_time) for r in left.collect()) == ["2024-01-05 18:00:00", "2024-01-09 10:00:00"]


def test_merge_overlapping(spark):
    rows = [("a", 0, 4), ("b", 2, 6), ("c", 6, 7), ("d", 9, 10), ("e", 1, 2)]
    df = spark.createDataFrame(rows, "id string, s int, e int").select(
        "id", F.lit("A").alias("pair"), F.lit("1h").alias("interval"),
        F.timestamp_seconds(F.col("s") * 3600).alias("start_time"),
        F.timestamp_seconds(F.col("e") * 3600).alias("end_time"))
    merged = lambda **k: spans(gaps.merge_gaps(df, **k))
    assert merged() == [("00:00", "07:00"), ("09:00", "10:00")]
    assert merged(touching=False) == [("00:00", "06:00"), ("06:00", "07:00"), ("09:00", "10:00")]
    assert sorted(r.id for r in gaps.overlap_gaps(df).collect()) == ["b", "e"]


# --- validation ------------------------------------------------------------------------

GOOD_ROW = dict(pair="BTC-USD", interval="1h", timestamp="2024-01-01", open="100", high="105", low="98",
                close="102", volume="1000")


@pytest.mark.parametrize("change,field,part", [
    ({}, None, None),
    ({"timestamp": None}, "timestamp", "null or zero"),
    ({"open": "abc"}, "open", "format"), ({"high": ""}, "high", "format"), ({"low": "1.2.3"}, "low", "format"),
    ({"close": " 102 "}, "close", "format"), ({"volume": "NaN"}, "volume", "volume format"),
    ({"open": "10000000000000"}, "open", "out of range"),
    ({"open": "0"}, "open", "greater than 0"), ({"low": "-1"}, "low", "greater than 0"),
    ({"volume": "-0.1"}, "volume", "greater than or equal to 0"), ({"volume": "0"}, None, None),
    ({"high": "101.50"}, "high", "high price (101.5) must be greater than or equal to max(open, close) (102)"),
    ({"low": "100.5"}, "low", "low price (100.5) must be less than or equal to min(open, close) (100)"),
    ({"pair": ""}, "pair", "empty"), ({"interval": ""}, "interval", "empty"),
    ({"open": "x", "pair": "", "volume": "-1"}, "open", "format"),
    ({"high": "90", "open": "-5"}, "open", "greater than 0"),
])
def test_validate_candles(spark, change, field, part):
    df = spark.createDataFrame([{**GOOD_ROW, **change}], ", ".join(f"{k} string" for k in GOOD_ROW)).withColumn(
        "timestamp", F.col("timestamp").cast("timestamp"))
    row = validate.validate_candles(df).first()
    assert row.error_field == field
    assert part is None or part in row.error_message


def test_logic_anomalies_reports_all(candles):
    rows = validate.logic_anomalies(candles([(DAY, 100, 90, 110, -5, -1)])).collect()
    assert [r.rule for r in rows] == ["high_validation", "low_validation", "positive_price", "non_negative_volume"]
    assert {r.severity for r in rows} == {"error"} and {r.confidence for r in rows} == {1.0}


def test_query_request():
    ok = ("A", "1h", 1, 2)
    assert validate.validate_query_request(*ok) == 3600
    for bad in (("", "1h", 1, 2), ("A", "", 1, 2), ("A", "1h", 2, 2), ("A", "7h", 1, 2)):
        with pytest.raises(ValueError):
            validate.validate_query_request(*bad)
    for extra in ({"limit": -1}, {"offset": -1}, {"order": "up"}):
        with pytest.raises(ValueError):
            validate.validate_query_request(*ok, **extra)


# --- anomalies ---------------------------------------------------------------------------

def pair_of(candles, previous, current, field="high"):
    value = lambda v: (100, v, 1, 100, 10) if field == "high" else (100, 100, 1, 100, v)
    return candles([(hours(0)[0], *value(previous)), (hours(1)[0], *value(current))])


@pytest.mark.parametrize("previous,current,hit", [
    (100, 105, False), (100, 500, False), (100, 600, True), (0, 600, False), (-100, 600, False), (-100, -600, True)])
def test_price_spike(candles, previous, current, hit):
    assert (anomalies.price_spikes(pair_of(candles, previous, current)).count() == 1) is hit


def test_spike_and_surge_text(candles):
    spike = anomalies.price_spikes(pair_of(candles, 100, 600)).first()
    assert (spike.value, spike.threshold) == (6.0, 5.0)
    assert spike.description == "Price spike detected: 500.00% increase (current: 600, previous: 100)"
    surge = anomalies.volume_surges(pair_of(candles, 1000, 15000, "volume")).first()
    assert surge.value == 15.0
    assert surge.description == "Volume surge detected: 15.00x increase (current: 15000, previous: 1000)"


def test_custom_threshold_keeps_fixed_confidence(candles):
    row = anomalies.price_spikes(pair_of(candles, 100, 300), threshold=2).first()
    assert (row.confidence, row.severity) == (0.0, "warning")


@pytest.mark.parametrize("kind,value,threshold,confidence,severity", [
    ("logic_error", 1.0, 0.0, 1.0, "error"), ("price_spike", 15.0, 5.0, 0.95, "critical"),
    ("price_spike", 6.0, 5.0, 0.6, "warning"), ("price_spike", 9.0, 5.0, 0.95, "error"),
    ("volume_surge", 60.0, 10.0, 0.95, "critical"), ("volume_surge", 60.0, 10.0, 0.75, "error"),
    ("sequence_gap", 5.0, 2.0, 0.8, "error"), ("sequence_gap", 5.0, 2.0, 0.79, "warning"),
    ("other", 1.0, 1.0, 1.0, "info")])
def test_severity(spark, kind, value, threshold, confidence, severity):
    lit = F.lit
    assert spark.range(1).select(scoring.severity_of(
        lit(kind), lit(value), lit(threshold), lit(confidence)).alias("s")).first().s == severity


def test_sequence(spark):
    def found(*stamps):
        df = spark.createDataFrame(
            [("A", "1h", i, DAY + s) for i, s in enumerate(stamps)],
            "pair string, interval string, n long, t string").withColumn("timestamp", F.col("t").cast("timestamp"))
        return [r.rule for r in anomalies.sequence_anomalies(df, "n").orderBy("n").collect()]

    assert found("00:00:00", "01:00:00", "02:00:00") == []
    assert found("01:00:00", "00:00:00", "02:00:00") == ["out_of_order", "interval_gap"]
    assert found("00:00:00", "01:05:00") == ["interval_gap"]
    assert found("00:00:00", "01:01:30") == []


def test_estimate_interval(times):
    step = lambda *s: anomalies.estimate_interval(times(list(s))).first().interval_seconds
    assert step(*hours(0)) == 3600
    assert step(DAY + "00:00:00", DAY + "00:05:10", DAY + "00:10:00", DAY + "01:00:00") == 300
    assert step(DAY + "00:00:00", DAY + "00:10:00", DAY + "00:15:00") == 300  # smallest wins a tie
    assert step(DAY + "00:00:00", DAY + "00:00:05") == 3600


def test_validate_all_mixed(spark):
    rows = [(100, 102, 99, 101, 1000), (101, 103, 100, 102, 1100), (102, 104, 101, 103, 1200),
            (103, 99, 95, 98, 1300), (98, 630, 97, 107, 1400), (107, 110, 105, 108, 15000)]
    df = spark.createDataFrame(
        [("A", "1h", hours(i)[0], *[str(v) for v in r]) for i, r in enumerate(rows)],
        "pair string, interval string, t string, open string, high string, low string, close string, volume string"
    ).withColumn("timestamp", F.col("t").cast("timestamp")).drop("t")
    kinds = sorted(r.type for r in anomalies.validate_all(df).collect())
    assert kinds == ["logic_error", "price_spike", "volume_surge"]
    assert anomalies.validate_all(df, spikes=False, timestamps=False).count() == 1


# --- features, quality, query -----------------------------------------------------------

def test_features(candles):
    f = features.candle_features(candles([(DAY, 100, 110, 95, 105, 10), (DAY, 0, 0, 0, 0, 0)]), "5").orderBy(
        F.desc("notional")).collect()
    assert (float(f[0].body_size), float(f[0].price_range), f[0].price_change_pct) == (5.0, 15.0, 5.0)
    assert (f[0].is_bullish, f[0].is_bearish, f[0].is_doji) == (True, False, True)
    assert abs(float(f[0].typical_price) - 310 / 3) < 1e-12
    assert f[1].price_change_pct is None and not f[1].is_bullish and not f[1].is_bearish


def test_pagination(candles):
    rows = candles([(h, 1, 1, 1, 1, 1) for h in hours(*range(12))])
    page = query.query_page(rows, "BTC-USD", "1h", DAY + "00:00", DAY + "10:00", True, 5, 2).collect()
    assert [str(r.timestamp)[11:13] for r in page] == ["07", "06", "05", "04", "03"]
    assert {(r.total, r.has_more, r.next_offset) for r in page} == {(10, True, 7)}
    assert query.query_candles(rows, "BTC-USD").count() == 12
    assert query.query_candles(rows, "BTC-USD", "1d").count() == 0
    assert query.query_candles(rows, start=DAY + "02:00", end=DAY + "04:00").count() == 2


def test_empty_quality(spark, candles):
    results, _ = validate.candle_results(candles([]).withColumns(
        {f: F.col(f).cast("string") for f in ("open", "high", "low", "close", "volume")}), DAY)
    row = quality.quality_metrics(results).collect()
    assert [(r.pair, r.total_candles, r.quality_score) for r in row] == [(None, 0, 0.0)]


# --- lifecycle and jobs --------------------------------------------------------------------

@pytest.mark.parametrize("length,age,model,manager", [
    (0.5, 0.5, 0, 0), (0.5, 2, 1, 1), (2, 0.5, 1, 0), (7, 0.5, 1, 2), (25, 0.5, 2, 3), (169, 0.5, 3, 3),
    (1, 25, 2, 2), (1, 169, 3, 3), (1, 1, 1, 0)])
def test_priority_rules(spark, length, age, model, manager):
    df = spark.range(1).select(
        F.timestamp_seconds(F.lit(0)).alias("start_time"), F.timestamp_seconds(F.lit(int(length * 3600))).alias("end_time"),
        F.timestamp_seconds(F.lit(1_000_000 - int(age * 3600))).alias("created_at"))
    now = F.timestamp_seconds(F.lit(1_000_000))
    row = df.select(lifecycle.gap_priority(now).alias("a"), lifecycle.manager_priority(now).alias("b")).first()
    assert (row.a, row.b) == (model, manager)


def test_backfill_plan(spark):
    df = spark.createDataFrame([("A", "1h", 0, 701 * 3600)], "pair string, interval string, s long, e long").select(
        "pair", "interval", F.timestamp_seconds("s").alias("start_time"), F.timestamp_seconds("e").alias("end_time"))
    assert [r.candles for r in backfill_plan(df).orderBy("chunk_no").collect()] == [300, 300, 101]
    assert [r.candles for r in backfill_plan(df, limit=450).orderBy("chunk_no").collect()] == [300, 150]


def test_retry_delays(spark):
    df = spark.createDataFrame([("failed", n) for n in range(6)], "status string, retry_count int").withColumn(
        "updated_at", F.lit(DAY).cast("timestamp"))
    got = {r.retry_count: r.retry_delay_seconds for r in jobs.job_retry_plan(df).collect()}
    assert got == {0: 60, 1: 120, 2: 240, 3: 480, 4: 960}
