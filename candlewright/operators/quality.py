"""Aggregated quality of candles and validation results.

Everything aggregates per (pair, interval) first; coarser levels re-aggregate
that small table, so the data itself is read and shuffled once.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewright.functions.scoring import at_least
from candlewright.operators.totals import with_empty_row
from candlewright.schemas import SERIES_KEY

QUALITY_THRESHOLD = 0.8
# Size estimates in bytes.
FILE_ROW_BYTES, MEMORY_ROW_BYTES, MEMORY_PAIR_BYTES = 128, 200, 50
KEPT_RUNS = 100

# Recommendation texts.
VERY_LOW = "Data quality is critically low - investigate data sources"
LOW = "Data quality needs improvement - review validation failures"
MANY_ANOMALIES = "High anomaly rate detected - check for data feed issues"
HAS_CRITICAL = "Critical issues found - immediate attention required"


def storage_stats(candles: DataFrame) -> DataFrame:
    """Rows, pairs, time range and size estimates of the whole table."""
    per_pair = candles.groupBy("pair").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    total, pairs = F.coalesce(F.sum("n"), F.lit(0)).cast("bigint"), F.count("pair")
    return per_pair.agg(
        total.alias("total_candles"), pairs.alias("total_pairs"),
        F.min("lo").alias("earliest_data"), F.max("hi").alias("latest_data"),
        (total * FILE_ROW_BYTES).alias("storage_bytes"),
        F.floor(total * FILE_ROW_BYTES / 10).cast("bigint").alias("index_bytes"),
        (total * MEMORY_ROW_BYTES).alias("memory_bytes"),
        (pairs * MEMORY_PAIR_BYTES).alias("memory_index_bytes"))


def storage_stats_by_series(candles: DataFrame) -> DataFrame:
    """Rows and time range per series, per pair and overall (NULL keys are totals)."""
    base = candles.groupBy(*SERIES_KEY).agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    return base.rollup(*SERIES_KEY).agg(
        F.sum("n").alias("total_candles"), F.min("lo").alias("earliest_data"),
        F.max("hi").alias("latest_data"))


def summarise_results(results: DataFrame) -> DataFrame:
    """Totals, breakdowns and quality score as (metric, label, value) rows.

    Every anomaly type that occurs has a row, also one this library does not raise.
    """
    # One small row per (severity, action) carries every total.
    base = results.groupBy("severity", "action_taken").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("checks_passed")).alias("checks"),
        F.sum(F.size("anomalies")).alias("anomalies"))
    bad = F.when(at_least(F.col("_s"), "error"), F.col("n")).otherwise(0)
    sets = with_empty_row(base).withColumn("_s", F.col("severity")).groupingSets(
        [[], ["severity"], ["action_taken"]], "severity", "action_taken").agg(
        F.grouping_id().alias("_level"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c)
          for c in ["n", "checks", "anomalies"]],
        F.sum(bad).alias("_bad")).where((F.col("_level") == 3) | (F.col("n") > 0))

    def row(metric, label, value):
        return F.struct(F.lit(metric).alias("metric"), label.cast("string").alias("label"),
                        value.cast("double").alias("value"))

    null, n = F.lit(None), F.col("n")
    totals = [
        row("total_results", null, n), row("total_anomalies", null, F.col("anomalies")),
        row("total_checks", null, F.col("checks")),
        row("quality_score", null, F.when(n > 0, 1 - F.col("_bad") / n).otherwise(0.0)),
    ]
    shown = (
        F.when(F.col("_level") == 3, F.array(*totals))
        .when(F.col("_level") == 1, F.array(row("severity", F.col("severity"), n)))
        .otherwise(F.array(row("action", F.col("action_taken"), n)))
    )
    types = results.select(F.explode("anomalies").alias("a")).groupBy(F.col("a.type").alias("label")).agg(
        F.count(F.lit(1)).cast("double").alias("value"))
    return sets.select(F.inline(shown)).unionByName(
        types.select(F.lit("anomaly_type").alias("metric"), "label", "value"))


def _scores(df: DataFrame) -> DataFrame:
    total = F.col("total_candles")
    score = 0.7 * (1 - F.col("validation_errors") / total) + 0.3 * (1 - F.col("anomalies_detected") / total)
    df = df.withColumns({
        "success_rate": F.when(total > 0, F.col("valid_candles") / total).otherwise(0.0),
        "anomaly_rate": F.when(total > 0, F.col("anomalies_detected") / total).otherwise(0.0),
        "quality_score": F.when(total > 0, F.greatest(score, F.lit(0.0))).otherwise(0.0),
    })
    q = F.col("quality_score")
    advice = F.array_compact(F.array(
        F.when(total == 0, F.lit(None)).when(q < 0.5, VERY_LOW).when(q < 0.8, LOW),
        F.when(F.col("anomaly_rate") > 0.1, MANY_ANOMALIES),
        F.when(F.col("critical_issues") > 0, HAS_CRITICAL)))
    return df.withColumn("recommended_actions", advice)


def quality_metrics(results: DataFrame, cross_anomalies: DataFrame = None,
                    by=SERIES_KEY) -> DataFrame:
    """Quality of each series, and of everything (NULL keys).

    Only per-candle results count by default; pass the anomalies between
    candles (pair, interval, severity) to include them too; series that only they
    name have a row as well.
    """
    by = list(by)
    bad = at_least(F.col("severity"), "error")
    base = results.select(*by, "severity", "anomalies").groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_candles"),
        F.count_if(~bad).alias("valid_candles"), F.count_if(bad).alias("validation_errors"),
        F.count_if(F.col("severity") == "error").alias("errors_error"),
        F.count_if(F.col("severity") == "critical").alias("errors_critical"),
        F.sum(F.size("anomalies")).alias("anomalies_detected"),
        F.sum(F.size(F.filter("anomalies", lambda a: a["severity"] == "critical")))
        .alias("critical_issues"))
    if cross_anomalies is not None:
        extra = cross_anomalies.groupBy(*by).agg(
            F.count(F.lit(1)).alias("_more"),
            F.count_if(F.col("severity") == "critical").alias("_critical"))
        none = F.lit(0)
        base = base.join(extra, by, "full").select(
            *by, *[F.coalesce(c, none).alias(c) for c in base.columns
                   if c not in (*by, "anomalies_detected", "critical_issues")],
            (F.coalesce("anomalies_detected", none) + F.coalesce("_more", none)).alias("anomalies_detected"),
            (F.coalesce("critical_issues", none) + F.coalesce("_critical", none)).alias("critical_issues"))
    counts = [c for c in base.columns if c not in by]
    sets = with_empty_row(base).groupingSets([by, []], *by).agg(
        F.grouping_id().alias("_level"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in counts])
    return _scores(sets.where(
        (F.col("_level") > 0) | (F.col("total_candles") > 0) | (F.col("anomalies_detected") > 0)).drop("_level"))


def anomalies_by_type(results: DataFrame, cross_anomalies: DataFrame = None, by=SERIES_KEY) -> DataFrame:
    """Anomalies of each series by type, of candles and between candles; NULL keys are totals."""
    by = list(by)
    found = results.select(*by, F.explode("anomalies").alias("a")).select(*by, F.col("a.type").alias("type"))
    if cross_anomalies is not None:
        found = found.unionByName(cross_anomalies.select(*by, "type"))
    per_series = found.groupBy(*by, "type").agg(F.count(F.lit(1)).alias("n"))
    return per_series.groupingSets([[*by, "type"], ["type"]], *by, "type").agg(F.sum("n").alias("anomalies"))


def quality_gate(metrics: DataFrame, threshold: float = QUALITY_THRESHOLD) -> DataFrame:
    """Adds ``gate``: pass or fail against the quality threshold."""
    return metrics.withColumn(
        "gate", F.when(F.col("quality_score") >= threshold, "pass").otherwise("fail"))


def pipeline_state(processed: Column, invalid: Column) -> Column:
    return (
        F.when(invalid == 0, "success").when(invalid >= processed, "failure")
        .otherwise("partial_failure")
    )


def pipeline_status(parsed: DataFrame, by=SERIES_KEY) -> DataFrame:
    """Processed, valid and unparseable candles with the run status.

    ``parsed`` has a boolean ``is_parseable`` per candle. Grouping by a
    truncated time instead of the series gives the per-batch variant.
    """
    counted = parsed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("processed_candles"),
        F.count_if(~F.col("is_parseable")).alias("invalid_candles"))
    return counted.select(
        *[c for c in counted.columns if c not in ("processed_candles", "invalid_candles")],
        "processed_candles",
        (F.col("processed_candles") - F.col("invalid_candles")).alias("valid_candles"),
        "invalid_candles",
        pipeline_state(F.col("processed_candles"), F.col("invalid_candles")).alias("status"))


def validation_stats_rollup(runs: DataFrame, keep: int = KEPT_RUNS) -> DataFrame:
    """Totals and mean quality of the latest ``keep`` runs (run_at, run_id, counts, score)."""
    latest = runs.orderBy(F.desc("run_at"), F.desc("run_id")).limit(keep)
    return latest.agg(
        F.coalesce(F.sum("processed_candles"), F.lit(0)).alias("total_validated"),
        F.coalesce(F.sum("invalid_candles"), F.lit(0)).alias("validation_errors"),
        F.coalesce(F.sum("anomalies_detected"), F.lit(0)).alias("anomalies_detected"),
        F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("quality_score"))
