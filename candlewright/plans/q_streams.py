"""Queries: streams over the events table, drained with an available-now trigger.

A drained stream has seen all rows, but what waits for the watermark stays behind: the
twins stop five minutes before the last row.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewright.plans.catalog import query
from candlewright.plans.q_candles import KEY, NEWEST
from candlewright.plans.q_quality import CHECKED, SCORED, SCORED_SQL, SLOT
from candlewright.plans.sqlparts import ohlcv, r6
from candlewright.schemas import CANDLE_FIELDS, SERIES_KEY
from candlewright.session import shared_path
from candlewright.sources.candles import stored_candles
from candlewright.streaming import ordered, sinks, streams


def tick_stream(fx):
    """The events table as a stream of ticks."""
    schema = fx.table("events").schema
    price = F.col("value").cast("decimal(18,8)")
    return fx.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(
        fx.folder).select(
        F.col("event_id").alias("tick_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("pair"), price.alias("price"), price.alias("size"))


def table_stream(fx, rows):
    """A batch result written to the shared folder and read back as a stream."""
    path = shared_path(fx.spark, "input")
    rows.write.parquet(path)
    return fx.spark.readStream.schema(rows.schema).parquet(path)


def _result(fx, stream):
    schema = stream.schema
    return fx.spark.read.schema(schema).parquet(sinks.drain(fx.spark, stream))


def _final(rows, ts):
    """Where the watermark stands after the last of ``rows``."""
    return f"(SELECT max({ts}) - INTERVAL 5 MINUTE FROM {rows})"


@query("stream_resample", f"""SELECT {KEY}, {ohlcv()} FROM c1h WHERE "timestamp" + INTERVAL 1 HOUR <= {_final('events', 'ts')}""", ["c1h"])
def stream_resample(fx):
    return _result(fx, streams.ticks_to_candles(tick_stream(fx), "1h"))


@query("stream_resample_sliding", f"""SELECT pair, '5m' AS source_interval, '1h' AS "interval", w AS "timestamp",
      {r6('arg_min(open, "timestamp")')} AS open, {r6('max(high)')} AS high, {r6('min(low)')} AS low,
      {r6('arg_max(close, "timestamp")')} AS close, {r6('sum(volume)')} AS volume
    FROM (SELECT *, time_bucket(INTERVAL 15 MINUTE, "timestamp") - k * INTERVAL 15 MINUTE AS w FROM c5m, range(4) r(k))
    GROUP BY pair, w HAVING w + INTERVAL 1 HOUR <= {_final('c5m', '"timestamp"')}""", ["c5m"])
def stream_resample_sliding(fx):
    candles = table_stream(fx, fx.candles("5m"))
    return _result(fx, streams.resample(candles, "1h", slide="15 minutes"))


@query("stream_ingest_dedup", f"SELECT {KEY}, {ohlcv()} FROM c1h", ["c1h"])
def stream_ingest_dedup(fx):
    candles = table_stream(fx, fx.candles("1h").unionByName(fx.candles("1h")))
    return _result(fx, streams.ingest_dedup(candles))


@query("stream_validate", f"SELECT slot_pair, slot_time, error_field, error_message FROM ({CHECKED})", ["typed"])
def stream_validate(fx):
    return _result(fx, streams.validate(table_stream(fx, fx.dirty()))).select(*SLOT, "error_field", "error_message")


def _ordered(fx, stream, find, like, keys=tuple(SERIES_KEY)):
    """Drain ``stream`` into ``find``; ``like`` is the result's schema."""
    path = sinks.drain(fx.spark, stream, ordered.starting(find, keys))
    return ordered.result(fx.spark, path, like)


@query("stream_spikes", f"""{SCORED_SQL} WHERE "timestamp" <= {_final('c1h', '"timestamp"')}""", ["c1h", "scored"])
def stream_spikes(fx):
    stream = ordered.released(table_stream(fx, fx.candles("1h")))
    return _ordered(fx, stream, ordered.spikes, ordered.spikes(fx.candles("1h")).schema).select(*SCORED)


@query("stream_gaps", f"""SELECT pair, "interval", "timestamp" + INTERVAL 5 MINUTE AS start_time, n AS end_time
    FROM (SELECT *, lead("timestamp") OVER (PARTITION BY pair ORDER BY "timestamp") AS n FROM c5m)
    WHERE n > "timestamp" + INTERVAL 5 MINUTE AND n <= {_final('c5m', '"timestamp"')}""", ["c5m"])
def stream_gaps(fx):
    stream = ordered.released(table_stream(fx, fx.candles("5m")))
    return _ordered(fx, stream, ordered.gaps, ordered.gaps(fx.candles("5m")).schema)


@query("stream_sessions", f"""SELECT pair, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS rows FROM (
      SELECT pair, ts, sum(CASE WHEN ts < p + INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY pair ORDER BY ts) AS s
      FROM (SELECT event_type AS pair, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS p FROM events))
    GROUP BY pair, s HAVING max(ts) + INTERVAL 30 MINUTE <= {_final('events', 'ts')}""")
def stream_sessions(fx):
    rows = tick_stream(fx).select("pair", F.col("ts").alias("timestamp"))
    return _result(fx, streams.sessions(rows, "30 minutes"))


@query("stream_outages", f"""SELECT pair, p AS start_time, ts AS end_time, {r6("(epoch_us(ts) - epoch_us(p)) / 1000000")} AS quiet_seconds
    FROM (SELECT event_type AS pair, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS p FROM events)
    WHERE ts >= p + INTERVAL 30 MINUTE AND date_trunc('minute', ts) + INTERVAL 1 MINUTE <= {_final('events', 'ts')}""")
def stream_outages(fx):
    stream = ordered.activity(tick_stream(fx).select("pair", F.col("ts").alias("timestamp")))
    found = "pair string, start_time timestamp, end_time timestamp, quiet_seconds double"
    return _ordered(fx, stream, ordered.outages(1800), T.StructType.fromDDL(found), ("pair",))


@query("stream_late_flags", """SELECT event_type AS pair, event_id AS tick_id, ts AS "timestamp",
      date_trunc('second', ts) + to_seconds(event_id % 13 * 40) AS received_at, event_id % 13 * 40 > 300 AS is_late FROM events""")
def stream_late_flags(fx):
    delay = F.pmod(F.col("tick_id"), F.lit(13)) * 40
    rows = tick_stream(fx).select(
        "pair", "tick_id", F.col("ts").alias("timestamp"),
        F.timestamp_seconds(F.unix_seconds("ts") + delay).alias("received_at"))
    return _result(fx, streams.on_time(rows))


# Every 13th slot arrives with the second load only, and every 13th other slot once more with another close.
_SLOT = """(epoch_us("timestamp") // 300000000) % 13"""


@query("stream_late_data", f"""SELECT pair, '5m' AS "interval", "timestamp", CASE WHEN {_SLOT} = 0 THEN 'new' ELSE 'changed' END AS change,
      CASE WHEN {_SLOT} = 5 THEN CASE WHEN high < close + 1 THEN 'high,close' ELSE 'close' END END AS changed_fields,
      {r6(f"CASE WHEN {_SLOT} = 5 THEN close END")} AS old_close, {r6(f"CASE WHEN {_SLOT} = 5 THEN close + 1 ELSE close END")} AS new_close
    FROM c5m WHERE {_SLOT} IN (0, 5) AND "timestamp" < (SELECT max("timestamp") FROM c5m WHERE {_SLOT} <> 0) - INTERVAL 5 MINUTE""", ["c5m"])
def stream_late_data(fx):
    candles, slot = fx.candles("5m"), F.pmod(F.floor(F.unix_seconds("timestamp") / 300), F.lit(13))
    path = shared_path(fx.spark, "input")
    candles.where(slot != 0).coalesce(1).write.parquet(path)
    close = F.when(slot == 5, F.col("close") + 1).otherwise(F.col("close"))
    candles.where(slot.isin(0, 5)).withColumns({
        "close": close.cast(candles.schema["close"].dataType),
        "high": F.greatest("high", close).cast(candles.schema["high"].dataType)}).coalesce(1).write.mode("append").parquet(path)
    stream = fx.spark.readStream.schema(candles.schema).option("maxFilesPerTrigger", 1).parquet(path)
    table = sinks.drain(fx.spark, stream, sinks.start_with_corrections())
    return fx.spark.read.parquet(f"{table}-corrections").select(
        *SERIES_KEY, "timestamp", "change", "changed_fields", "old_close", "new_close")


@query("stream_upsert", NEWEST % "SELECT * FROM load0 UNION ALL SELECT * FROM load2", ["load0", "load2"])
def stream_upsert(fx):
    loads = table_stream(fx, fx.two_loads())
    path = sinks.drain(fx.spark, loads, sinks.start_upsert)
    return stored_candles(fx.spark, path, loads.schema).select(
        *SERIES_KEY, "timestamp", *CANDLE_FIELDS, "load_seq")
