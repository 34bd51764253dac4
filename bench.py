"""Benchmark: headline queries on the test tables, one JSON line on stdout.

Every query runs once to warm up and then BENCH_RUNS times; the median counts.
Results are written to the no-op sink, so all rows and columns are computed.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from candlewright.operators.gaps import gaps_in_range  # noqa: E402
from candlewright.operators.query import query_candles  # noqa: E402
from candlewright.plans.fixtures import END, START, Fixtures  # noqa: E402
from candlewright.plans.registry import QUERIES  # noqa: E402
from candlewright.session import local_session, shared_path  # noqa: E402
from candlewright.sources.candles import read_candles, write_candles  # noqa: E402

HEADLINE = [
    "candles_1h", "candles_1d", "resample_1d_1w", "candle_features", "gaps_in_range_5m",
    "gaps_in_sequence", "completeness", "detection_result", "validate_candles", "candle_results",
    "price_spikes", "score_anomalies", "sequence_anomalies", "volume_surge_ma_daily",
    "quality_metrics", "latest_candle", "query_candles", "query_page", "gap_rank",
    "gap_statistics", "merge_gaps", "backfill_apply", "apply_gap_events", "upsert_candles",
    "merge_corrections", "error_breakdown", "parse_candle_payload",
]


def timed(action, runs):
    """Median seconds of ``action`` after one warm-up."""
    def once():
        begin = time.perf_counter()
        action()
        return time.perf_counter() - begin

    once()
    return round(statistics.median(once() for _ in range(runs)), 3)


def targets(spark, folder, runs):
    fx = Fixtures(spark, folder)
    candles, path, daily = fx.candles("5m"), shared_path(spark, "bench"), shared_path(spark, "bench")
    rows = candles.count()
    write = timed(lambda: write_candles(candles, path), runs)
    write_candles(fx.daily(), daily)
    table = read_candles(spark, daily)
    year = timed(lambda: query_candles(table, "A-F", "1d", "1998-01-01", "1999-01-01").collect(), runs)
    found = read_candles(spark, path)
    detection = timed(lambda: gaps_in_range(found, START, END).write.format("noop").mode("overwrite").save(), runs)
    return {"candles_written": rows, "write_seconds": write, "candles_written_per_second": round(rows / write),
            "one_year_daily_query_seconds": year, "gap_detection_candles": rows, "gap_detection_seconds": detection}


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cores, shuffle_partitions=8)

    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        seconds[name] = timed(
            lambda: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save(), runs)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    rows = {t: spark.read.parquet(f"{folder}/{t}.parquet").count() for t in ("events", "lineitem", "orders")}
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).replace("sf", ""),
        "cores": cores, "input_rows": rows, "targets": targets(spark, folder, runs),
        "candles_1d_input_rows_per_second": round(rows["lineitem"] / seconds["candles_1d"])
        if "candles_1d" in seconds else None,
    }))


if __name__ == "__main__":
    main()
