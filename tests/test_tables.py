"""Reading, writing and maintaining tables."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from candlewright.operators import upsert
from candlewright.plans.fixtures import Fixtures
from candlewright.sources import candles as tables
from candlewright.sources.payloads import parse_candle_payload
from candlewright.streaming import ordered, sinks, streams

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@pytest.fixture(scope="module")
def fx(spark):
    return Fixtures(spark, FOLDER)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_store_batch_upserts_touched_partitions(spark, fx, folder):
    first, second = fx.first_load(), fx.second_load()
    path = f"{folder}/candles"
    tables.store_batch(spark, path, first)
    tables.store_batch(spark, path, second)
    tables.store_batch(spark, path, second)  # repeating a batch changes nothing
    got = tables.stored_candles(spark, path, first.schema).select(first.columns)
    assert same(got, upsert.upsert_candles(first, second))


def test_partition_and_row_filters_reach_the_scan(spark, fx, folder):
    path = f"{folder}/candles"
    tables.store_batch(spark, path, fx.first_load())
    df = tables.stored_candles(spark, path, fx.first_load().schema).where(
        "pair = 'view' AND timestamp >= '2024-01-10'").select("close")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pair" in plan
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp" in plan
    assert "ReadSchema: struct<timestamp:timestamp,close:decimal(30,18)>" in plan


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_export(spark, fx, folder, fmt):
    tables.export_candles(fx.candles("1h"), f"{folder}/{fmt}", fmt)
    schema = tables.export_view(fx.candles("1h")).schema if fmt != "parquet" else None
    got = tables.read_candles(spark, f"{folder}/{fmt}", fmt, schema)
    assert got.count() == fx.candles("1h").count()
    if fmt == "csv":
        assert got.columns == tables.EXPORT_COLUMNS
        assert got.first().timestamp.endswith(":00:00Z")


def test_batch_is_rejected_as_a_whole(spark, fx):
    dirty = fx.dirty()
    assert tables.accept_batch(dirty).count() == 0
    clean = dirty.where("timestamp is not null and pair <> '' and open not like '% %' and open not like 'n%'"
                        " and open not like '-%' and volume not like '-%'").where(
        F.col("high").cast("double") >= F.greatest(F.col("open").cast("double"), F.col("close").cast("double")))
    clean = clean.where("cast(low as double) > 0")
    assert tables.accept_batch(clean).count() == clean.count() > 0


def test_payload_kinds(spark):
    docs = [("a", '[[1640995200, 1.5, 3, "2.50", 2, 10], [1640995260, 1, 2, 1, 2], ["1640995320", 1, 2, 1, 2, 3],'
                  ' [1640995380, null, 2, 1, 2, 3], [1640995440, 1e-3, 2, true, 2, 3], []]'),
            ("b", '{"candles": []}'), ("c", "not json"), ("d", "[]")]
    rows, broken = parse_candle_payload(spark.createDataFrame(docs, "pair string, payload string"))
    got = [(r.pair, r.open, r.high, r.low, r.close, r.volume) for r in rows.collect()]
    assert got == [("a", "2.50", "3.00000000", "1.50000000", "2.00000000", "10.00000000")]
    assert sorted(r.pair for r in broken.collect()) == ["b", "c"]


# --- streams equal batches ---------------------------------------------------------------

def by_day(spark, rows, folder):
    """A stream whose files hold one day each, in order of time."""
    path = f"{folder}/input"
    days = sorted(r[0] for r in rows.select(F.to_date("timestamp")).distinct().collect())
    for d in days:
        rows.where(F.to_date("timestamp") == d).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return stream, rows


def drained(spark, stream):
    return spark.read.schema(stream.schema).parquet(sinks.drain(spark, stream))


def found(spark, stream, find, like, keys=("pair", "interval")):
    return ordered.result(spark, sinks.drain(spark, stream, ordered.starting(find, keys)), like.schema)


def test_ordered_steps_equal_batch_over_many_batches(spark, fx, folder):
    from candlewright.operators.anomalies import candle_steps

    stream, rows = by_day(spark, fx.candles("1h"), folder)
    limit = rows.agg(F.max("timestamp")).first()[0]
    want = candle_steps(rows).where(F.unix_seconds("timestamp") <= F.unix_seconds(F.lit(limit)) - 300)
    cut = ["pair", "interval", "timestamp", "prev_timestamp", "high", "prev_high", "volume", "prev_volume"]
    got = found(spark, ordered.released(stream), ordered.steps, candle_steps(rows))
    assert want.count() > 100 and same(got.select(*cut), want.select(*cut))


def test_stream_spikes_and_gaps_equal_batch(spark, fx, folder):
    from candlewright.operators.anomalies import candle_steps, cross_anomalies
    from candlewright.operators.gaps import gaps_in_sequence

    rows = fx.candles("1h")
    path = f"{folder}/all"
    rows.write.parquet(path)
    limit = F.lit(rows.agg(F.max("timestamp")).first()[0])
    early = lambda c: F.unix_seconds(c) <= F.unix_seconds(limit) - 300
    source = lambda: spark.readStream.schema(rows.schema).parquet(path)
    cut = ["pair", "timestamp", "type", "severity"]
    want = cross_anomalies(candle_steps(rows)).where(early("timestamp"))
    assert want.count() > 0 and same(
        found(spark, ordered.released(source()), ordered.spikes, want).select(*cut), want.select(*cut))
    want = gaps_in_sequence(rows).where(early("end_time"))
    assert same(found(spark, ordered.released(source()), ordered.gaps, want), want)


def test_stream_outages_over_many_batches(spark, folder):
    """Against a loop; rows of a minute arrive in any order, a pair with nearly all rows among them."""
    rng, rows = random.Random(5), []
    for pair, n, reach in (("a", 4000, 86400), ("b", 60, 86400), ("c", 1, 3600)):
        rows += [(pair, rng.randrange(reach) + rng.choice([0.0, 0.25])) for _ in range(n)]
    rows += [("d", 100.0), ("d", 1900.0), ("d", 3699.5), ("d", 80000.0)]
    rows.sort(key=lambda r: r[1] + rng.randrange(200))
    for i in range(0, len(rows), 700):
        spark.createDataFrame(rows[i:i + 700], "pair string, at double").select(
            "pair", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).alias("timestamp")).coalesce(1).write.mode(
            "append").parquet(f"{folder}/ticks")
    stream = spark.readStream.schema("pair string, timestamp timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/ticks")
    like = spark.createDataFrame([], "pair string, start_time timestamp, end_time timestamp, quiet_seconds double")
    got = found(spark, ordered.activity(stream), ordered.outages(1800), like, ("pair",))
    last, want = max(t for _, t in rows) - 300, []
    for pair in "abcd":
        times = sorted(t for p, t in rows if p == pair)
        want += [(pair, a, b) for a, b in zip(times, times[1:]) if b - a >= 1800 and b // 60 * 60 + 60 <= last]
    assert want and sorted((r.pair, r.start, r.end) for r in got.select("pair", (F.unix_micros("start_time") / 1e6).alias("start"), (
        F.unix_micros("end_time") / 1e6).alias("end")).collect()) == sorted(want)


def test_late_rows_are_corrections_also_in_a_repeated_batch(spark, fx, folder):
    candles = fx.candles("1h").orderBy("timestamp").limit(400)
    candles.write.parquet(f"{folder}/all")
    candles = spark.read.schema(candles.schema).parquet(f"{folder}/all")
    n = F.pmod(F.unix_seconds("timestamp") / 3600, F.lit(7)).cast("int")
    loads = [candles.where(n != 0), candles.where(n.isin(0, 3)).withColumn("volume", F.when(n == 3, F.col("volume") + 1).otherwise(
        F.col("volume")).cast("decimal(30,18)")), candles.limit(0)]
    write = {}

    class Stream:
        """Hands the sink's function out instead of starting a query."""
        writeStream = property(lambda self: self)
        foreachBatch = lambda self, f: write.setdefault("f", f) and self
        option = trigger = lambda self, *a, **k: self
        start = lambda self: None

    sinks.start_with_corrections()(Stream(), f"{folder}/table", "")
    for i in (0, 1, 1, 2, 2):  # a micro-batch is repeated after a failure
        write["f"](loads[i], i)
    limit = loads[0].agg(F.max("timestamp")).first()[0]
    late = candles.where((F.unix_seconds("timestamp") < F.unix_seconds(F.lit(limit)) - 300) & n.isin(0, 3))
    want = late.select("pair", "timestamp", F.when(n == 0, "new").otherwise("changed").alias("change"),
                       F.when(n == 3, "volume").alias("changed_fields"))
    got = spark.read.parquet(f"{folder}/table-corrections").select(*want.columns)
    assert want.count() > 20 and same(got, want)
    table = tables.stored_candles(spark, f"{folder}/table", candles.schema).select(*candles.columns)
    assert same(table, upsert.upsert_candles(loads[0], loads[1]).select(*candles.columns))


def test_stream_resample_equals_batch(spark, fx, folder):
    from candlewright.operators.resample import resample_candles

    stream, rows = by_day(spark, fx.candles("5m"), folder)
    got = drained(spark, streams.resample(stream, "1h"))
    limit = F.lit(rows.agg(F.max("timestamp")).first()[0])
    want = resample_candles(rows, "1h").where(
        F.unix_seconds("timestamp") + 3600 <= F.unix_seconds(limit) - 300)
    assert want.count() > 0 and same(got, want)


def test_stream_dedup(spark, fx, folder):
    rows = fx.candles("1h")
    twice = rows.unionByName(rows)
    path = f"{folder}/twice"
    twice.write.parquet(path)
    got = drained(spark, streams.ingest_dedup(spark.readStream.schema(twice.schema).parquet(path)))
    assert same(got, rows)


def test_stream_upsert_keeps_the_newest(spark, fx, folder):
    loads = fx.two_loads()
    path = f"{folder}/loads"
    fx.first_load().coalesce(1).write.mode("append").parquet(path)
    fx.second_load().coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(loads.schema).option("maxFilesPerTrigger", 1).parquet(path)
    table = sinks.drain(spark, stream, sinks.start_upsert)
    got = tables.stored_candles(spark, table, loads.schema).select(loads.columns)
    assert same(got, upsert.upsert_candles(fx.first_load(), fx.second_load()))
