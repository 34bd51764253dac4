"""Physical plans that the scale of the operators depends on."""

import pytest
from pyspark.sql import functions as F

from candlewright.operators import anomalies, gaps, upsert
from candlewright.plans.fixtures import END, START, Fixtures
from candlewright.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fx(spark):
    return Fixtures(spark, FOLDER)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("build", [
    lambda c: anomalies.price_spikes(c), lambda c: gaps.gaps_in_sequence(c),
    lambda c: anomalies.cross_anomalies(anomalies.candle_steps(c)),
], ids=["spikes", "sequence", "cross"])
def test_rows_are_read_and_shuffled_once(fx, build):
    plan = plan_of(build(fx.candles("5m")))
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 1
    assert "SortAggregate" not in plan and "Join" not in plan


def test_range_detection_prunes_columns_and_reuses_the_shuffle(fx):
    plan = plan_of(gaps.gaps_in_range(fx.candles("5m"), START, END))
    assert "ReusedExchange" in plan and "Join" not in plan
    assert "GreaterThanOrEqual(timestamp" in plan and "close" not in plan


def test_copies_of_a_key_are_limited_before_the_shuffle(fx):
    plan = plan_of(upsert.upsert_candles(fx.first_load(), fx.second_load()))
    assert plan.count("WindowGroupLimit") == 2


def test_candle_building_stays_in_the_hash_aggregate(fx):
    plan = plan_of(fx.build_candles("1h"))
    assert "SortAggregate" not in plan and plan.count("HashAggregate") == 2


def test_top_k_needs_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["priority_gaps"](spark, FOLDER))


@pytest.mark.parametrize("name", ["query_page", "accept_batch", "candles_in_gap", "backfill_apply",
                                  "trading_calendar_filter", "quality_metrics", "query_with_gap_flags"])
def test_no_cross_joins(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_validate_all_in_arrival_order(spark):
    rows = [("A", "1h", i, f"2024-01-01 {h:02d}:00:00", "5", "6", "4", "5", "1") for i, h in enumerate((0, 1, 3, 2, 4))]
    df = spark.createDataFrame(rows, "pair string, interval string, seq long, t string, open string, high string, "
                                     "low string, close string, volume string").withColumn(
        "timestamp", F.col("t").cast("timestamp")).drop("t")
    rules = sorted(r.rule for r in anomalies.validate_all(df, arrival="seq").collect())
    assert rules == ["interval_gap", "interval_gap", "out_of_order"]


def test_periods_are_merged_in_one_pass(fx):
    plan = plan_of(gaps.merge_periods(fx.wide_gaps(), ["pair", "interval"], bucket_seconds=86400))
    # The line of the reused exchange names it once more.
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 1
    assert plan.count("Exchange hashpartitioning") - 1 <= 3
    assert "SortMergeJoin" not in plan


def test_estimated_spacing_is_looked_up_by_bucket(fx):
    df = anomalies.validate_all(fx.dirty(), logical=False, ties=["slot_pair"])
    joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join LeftOuter" in line]
    assert len(joins) == 2 and sum("_bucket" in line for line in joins) == 1
