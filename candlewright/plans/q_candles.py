"""Queries: ingest, features, resampling and reads of the candle table."""

from pyspark.sql import functions as F

from candlewright.functions import features, rendering
from candlewright.functions.intervals import interval_seconds, next_boundary
from candlewright.operators import query as reads
from candlewright.operators import upsert, validate
from candlewright.operators.anomalies import as_of_prev, lookback_context
from candlewright.operators.resample import resample_candles
from candlewright.plans.catalog import query
from candlewright.plans.q_quality import CHECKED
from candlewright.plans.sqlparts import NUMERIC, ohlcv, r6, text8, unix
from candlewright.schemas import CANDLE_FIELDS, SERIES_KEY
from candlewright.sources import payloads
from candlewright.session import shared_path
from candlewright.sources.candles import (accept_batch, export_candles, export_view, read_candles, store_batch,
                                         table_view, write_candles)

KEY = 'pair, "interval", "timestamp"'


# --- candles and resampling ------------------------------------------------------

query("ticks_to_candles", f"SELECT {KEY}, {ohlcv()} FROM c1h", ["c1h"])(lambda fx: fx.build_candles("1h"))
query("candles_1h", f"SELECT {KEY}, {ohlcv()} FROM c1h", ["c1h"])(lambda fx: fx.build_candles("1h"))
query("candles_5m", f"SELECT {KEY}, {ohlcv()} FROM c5m", ["c5m"])(lambda fx: fx.build_candles("5m"))
query("candles_1d", f"SELECT {KEY}, {ohlcv()} FROM c1d", ["c1d"])(lambda fx: fx.build_daily())


@query("read_candles", f"SELECT {KEY}, {ohlcv()} FROM c1d", ["c1d"])
def read_layout(fx):
    """Daily candles written in the package's layout, twice as one batch, and read back."""
    path = shared_path(fx.spark, "candles")
    for _ in range(2):
        store_batch(fx.spark, path, fx.daily())
    return read_candles(fx.spark, path).select(*SERIES_KEY, "timestamp", *CANDLE_FIELDS)


@query("read_candles_month", f"""SELECT {KEY}, {ohlcv()} FROM c1d WHERE pair = 'N-O' AND "timestamp" >= TIMESTAMP '1996-02-10'
    AND "timestamp" < TIMESTAMP '1996-04-02'""", ["c1d"])
def read_month(fx):
    path = shared_path(fx.spark, "candles")
    write_candles(fx.daily(), path)
    return reads.select_candles(read_candles(fx.spark, path), "N-O", "1d", "1996-02-10", "1996-04-02").select(
        *SERIES_KEY, "timestamp", *CANDLE_FIELDS)


def _resampled(source, name, width):
    return f"""SELECT pair, "interval" AS source_interval, '{name}' AS "interval", time_bucket(INTERVAL {width}, "timestamp") AS "timestamp",
      {r6('arg_min(open, "timestamp")')} AS open, {r6('max(high)')} AS high, {r6('min(low)')} AS low,
      {r6('arg_max(close, "timestamp")')} AS close, {r6('sum(volume)')} AS volume
    FROM {source} GROUP BY 1, 2, 4"""


query("resample_1h_4h", _resampled("c1h", "4h", "4 HOUR"), ["c1h"])(
    lambda fx: resample_candles(fx.candles("1h"), "4h"))
query("resample_5m_1h", _resampled("c5m", "1h", "1 HOUR"), ["c5m"])(
    lambda fx: resample_candles(fx.candles("5m"), "1h"))
query("resample_mixed", _resampled('(SELECT * FROM c5m UNION ALL SELECT * FROM c1h UNION ALL SELECT * FROM c1d)', "1d", "1 DAY"),
      ["c5m", "c1h", "c1d"])(
    lambda fx: resample_candles(fx.candles("5m").unionByName(fx.candles("1h")).unionByName(fx.daily()), "1d"))
query("resample_1d_1w", _resampled("c1d", "1w", "7 DAY"), ["c1d"])(
    lambda fx: resample_candles(fx.daily(), "1w"))


# --- features ------------------------------------------------------------------

_FEATURES = {
    "typical_price": (features.typical_price, r6("(high + low + close) / 3")),
    "body_size": (features.body_size, r6("abs(close - open)")),
    "price_range": (features.price_range, r6("high - low")),
    "is_bullish": (features.is_bullish, "close > open"),
    "is_bearish": (features.is_bearish, "close < open"),
    "is_doji": (lambda: features.is_doji("25"), "abs(close - open) <= 25"),
    "price_change": (features.price_change, r6("close - open")),
    "price_change_pct": (features.price_change_pct, r6(
        "CASE WHEN open <> 0 THEN CAST(close - open AS DOUBLE) / CAST(open AS DOUBLE) * 100 END")),
    "notional": (features.notional, r6("CAST(close AS DOUBLE) * CAST(volume AS DOUBLE)")),
}


def _feature(name):
    build, sql = _FEATURES[name]
    query(name, f'SELECT {KEY}, {sql} AS {name} FROM c1h', ["c1h"])(
        lambda fx: fx.candles("1h").select(*SERIES_KEY, "timestamp", build().alias(name)))


for _name in _FEATURES:
    _feature(_name)

query("candle_features", f"SELECT {KEY}, " + ", ".join(
    f"{sql} AS {name}" for name, (_, sql) in _FEATURES.items()) + " FROM c1d", ["c1d"])(
        lambda fx: features.candle_features(fx.daily(), "25"))

@query("parse_decimals", "SELECT slot_pair, slot_time, " + ", ".join(
    f"{r6(f't.{c}')} AS {c}, CASE WHEN NOT regexp_matches(d.{c}, '{NUMERIC}') THEN 'format' "
    f"WHEN t.{c} IS NULL THEN 'out_of_range' ELSE 'ok' END AS {c}_state" for c in CANDLE_FIELDS)
    + " FROM typed t JOIN dirty d USING (slot_pair, slot_time)", ["typed"])
def parse_decimals(fx):
    return validate.parse_report(fx.dirty()).select(
        "slot_pair", "slot_time", *CANDLE_FIELDS, *[f"{c}_state" for c in CANDLE_FIELDS])


# Interval names are derived from the order keys: valid, unusual and malformed ones.
_NAMES = ["m", "h", "d", "w", "M", "x", ""]


@query("interval_seconds", """SELECT o_orderkey, name, CASE WHEN name = '1w' THEN 604800 WHEN name = '1M' THEN 2592000
      WHEN n > 0 AND u = 'm' THEN n * 60 WHEN n > 0 AND u = 'h' THEN n * 3600 WHEN n > 0 AND u = 'd' THEN n * 86400 END AS seconds
    FROM (SELECT o_orderkey, o_orderkey % 13 AS n, ['m', 'h', 'd', 'w', 'M', 'x', ''][o_orderkey % 7 + 1] AS u,
        CAST(o_orderkey % 13 AS VARCHAR) || ['m', 'h', 'd', 'w', 'M', 'x', ''][o_orderkey % 7 + 1] AS name FROM orders)""")
def interval_seconds_query(fx):
    key = F.col("o_orderkey")
    unit = F.get(F.array(*[F.lit(n) for n in _NAMES]), F.pmod(key, F.lit(7)).cast("int"))
    name = F.concat(F.pmod(key, F.lit(13)).cast("string"), unit)
    return fx.table("orders").select("o_orderkey", name.alias("name")).withColumn(
        "seconds", interval_seconds(F.col("name")))


@query("next_boundary", """SELECT event_id, "interval", make_timestamp(CAST((epoch_us(ts) // (s * 1000000) + 1) * s * 1000000 AS BIGINT)) AS boundary
    FROM (SELECT event_id, ts, ['1m', '15m', '4h', '1d', '1w', '8h'][event_id % 6 + 1] AS "interval",
        CAST([60, 900, 14400, 86400, 3600, 3600][event_id % 6 + 1] AS BIGINT) AS s FROM events)""")
def next_boundary_query(fx):
    names = F.array(*[F.lit(n) for n in ("1m", "15m", "4h", "1d", "1w", "8h")])
    picked = fx.table("events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.get(names, F.pmod("event_id", F.lit(6)).cast("int")).alias("interval"))
    return picked.select("event_id", "interval", next_boundary(F.col("ts"), F.col("interval")).alias("boundary"))


_ISO = "'%Y-%m-%dT%H:%M:%SZ'"


@query("render_candle", f"""SELECT {KEY}, 'Candle{{Pair: ' || pair || ', Interval: ' || "interval" || ', Timestamp: '
      || strftime("timestamp", {_ISO}) || ', O: ' || {text8('open')} || ', H: ' || {text8('high')} || ', L: '
      || {text8('low')} || ', C: ' || {text8('close')} || ', V: ' || {text8('volume')} || '}}' AS text FROM c1h""", ["c1h"])
def render_candle(fx):
    c = fx.candles("1h").withColumns({f: F.format_string("%.8f", F.col(f).cast("double")) for f in CANDLE_FIELDS})
    return c.select(*SERIES_KEY, "timestamp", rendering.render_candle().alias("text"))


_SECS = unix("end_time") + " - " + unix("start_time")


@query("render_gap", f"""SELECT id, 'Gap{{ID: ' || id || ', Pair: ' || pair || ', Duration: ' || CASE WHEN s >= 3600
      THEN (s // 3600) || 'h' || (s % 3600 // 60) || 'm' || (s % 60) || 's' WHEN s >= 60 THEN (s // 60) || 'm' || (s % 60) || 's'
      ELSE s || 's' END || ', Status: ' || status || ', Priority: ' || ['low', 'medium', 'high', 'critical'][priority + 1] || '}}' AS text
    FROM (SELECT *, {_SECS} AS s FROM gaps0)""", ["gaps0"])
def render_gap(fx):
    return fx.gaps().select("id", rendering.render_gap().alias("text"))


@query("render_job", """SELECT id, 'Job ' || id || ': ' || type || ' ' || "interval" || ' on ' || pair || ' ['
      || coalesce(strftime(start_time, '%Y-%m-%d %H:%M:%S'), '0001-01-01 00:00:00') || ' to '
      || coalesce(strftime(end_time, '%Y-%m-%d %H:%M:%S'), '0001-01-01 00:00:00') || '] - Status: '
      || status || ' (' || progress || '% complete, ' || records_collected || ' records)' AS text
    FROM jobs0""", ["jobs0"])
def render_job(fx):
    return fx.jobs().select("id", rendering.render_job().alias("text"))


# --- payloads and pairs ----------------------------------------------------------

_PAYLOAD_ROWS = f"""SELECT {KEY}, open, high, low, close, volume FROM payload_rows"""


@query("parse_candle_payload", _PAYLOAD_ROWS, ["payload_rows"])
def parse_candle_payload(fx):
    rows, _ = payloads.parse_candle_payload(fx.payloads())
    return rows.select(*SERIES_KEY, "timestamp", *CANDLE_FIELDS)


@query("parse_candle_payload_broken", """SELECT pair, "interval", date_trunc('month', "timestamp") AS month
    FROM c1d WHERE month("timestamp") = 2 AND year("timestamp") % 2 = 0 GROUP BY ALL""", ["c1d"])
def parse_candle_payload_broken(fx):
    _, broken = payloads.parse_candle_payload(fx.payloads())
    return broken.select("pair", "interval", "month")


@query("normalise_candles", f"""SELECT {KEY}, {ohlcv()} FROM payload_rows""", ["payload_rows"])
def normalise_candles(fx):
    rows, _ = payloads.parse_candle_payload(fx.payloads())
    valid, _ = payloads.normalise_candles(rows)
    return valid.select(*SERIES_KEY, "timestamp", *CANDLE_FIELDS)


@query("normalise_candles_rejects", f"""SELECT slot_pair, slot_time, error_field, error_message FROM ({CHECKED})
    WHERE error_field IS NOT NULL""", ["typed"])
def normalise_rejects(fx):
    _, rejects = payloads.normalise_candles(fx.dirty())
    return rejects.select("slot_pair", "slot_time", "error_field", "error_message")


@query("parse_products", "SELECT * FROM products0", ["products0"])
def parse_products(fx):
    return payloads.parse_products(fx.products())


@query("validate_pairs", """SELECT symbol, CASE WHEN base_asset = '' THEN 'base_asset' WHEN min_volume = '   ' THEN 'min_volume' END AS error_field,
      CASE WHEN base_asset = '' THEN 'base asset cannot be empty' WHEN min_volume = '   ' THEN
        'invalid min volume format: validation error for field decimal: decimal string contains only whitespace' END AS error_message
    FROM products0""", ["products0"])
def validate_pairs(fx):
    return validate.validate_pairs(payloads.parse_products(fx.products())).select(
        "symbol", "error_field", "error_message")


@query("candles_with_pair", f"""SELECT c.pair, "interval", "timestamp", {r6('close')} AS close, base_asset, quote_asset, active,
      CASE WHEN active IS NULL THEN 'unknown' WHEN active THEN 'active' ELSE 'inactive' END AS pair_state
    FROM c1d c LEFT JOIN pairs0 p ON c.pair = p.symbol""", ["c1d", "pairs0"])
def candles_with_pair(fx):
    return reads.candles_with_pair(fx.daily(), fx.pair_table()).select(
        *SERIES_KEY, "timestamp", "close", "base_asset", "quote_asset", "active", "pair_state")


# --- writes ----------------------------------------------------------------------

@query("export_candles", f"""SELECT strftime("timestamp", {_ISO}) AS "timestamp", pair, "interval", """
       + ", ".join(f"{text8(c)} AS {c}" for c in CANDLE_FIELDS) + " FROM c1d", ["c1d"])
def exported(fx):
    path = shared_path(fx.spark, "export")
    export_candles(fx.daily(), path, "csv")
    return fx.spark.read.option("header", True).schema(export_view(fx.daily()).schema).csv(path)


@query("table_view", f"""SELECT strftime("timestamp", '%Y-%m-%d %H:%M') AS "timestamp", pair, "interval", """
       + ", ".join(f"substr({text8(c)}, 1, {10 if c == 'volume' else 8}) AS {c}" for c in CANDLE_FIELDS)
       + """ FROM (SELECT * FROM c1h ORDER BY "timestamp", pair, "interval" LIMIT 40)""", ["c1h"])
def table_rows(fx):
    return table_view(fx.candles("1h"), 40)


NEWEST = f"""SELECT {KEY}, {ohlcv()}, load_seq FROM (SELECT *, row_number() OVER
    (PARTITION BY {KEY} ORDER BY created_at DESC, load_seq DESC) AS rn FROM (%s)) WHERE rn = 1"""


@query("dedup_candles", NEWEST % "SELECT * FROM load0 UNION ALL SELECT * FROM load2", ["load0", "load2"])
def dedup_candles(fx):
    return upsert.dedup_candles(fx.two_loads()).select(*SERIES_KEY, "timestamp", *CANDLE_FIELDS, "load_seq")


@query("upsert_candles", NEWEST % "SELECT * FROM load1 UNION ALL SELECT * FROM load2", ["load1", "load2"])
def upsert_candles(fx):
    return upsert.upsert_candles(fx.first_load(), fx.second_load()).select(
        *SERIES_KEY, "timestamp", *CANDLE_FIELDS, "load_seq")


@query("accept_batch", f"""SELECT {KEY}, {text8('open')} AS open FROM c1d
    WHERE (SELECT count(*) FROM c1d WHERE open <= 0 OR low <= 0 OR volume < 0) = 0""", ["c1d"])
def accept_whole_batch(fx):
    rows = fx.daily().withColumns(
        {f: F.format_string("%.8f", F.col(f).cast("double")) for f in CANDLE_FIELDS})
    return accept_batch(rows).select(*SERIES_KEY, "timestamp", "open")


@query("merge_corrections", f"""SELECT pair, "interval", "timestamp",
      CASE WHEN o.close IS NULL THEN 'new' WHEN n.close IS NULL THEN 'withdrawn' ELSE 'changed' END AS change,
      CASE WHEN o.close <> n.close THEN 'close' END AS changed_fields, """
       + ", ".join(f"{r6('o.' + c)} AS old_{c}, {r6('n.' + c)} AS new_{c}" for c in CANDLE_FIELDS)
       + """ FROM load2 n FULL JOIN load1 o USING (pair, "interval", "timestamp")
    WHERE o.close IS NULL OR n.close IS NULL OR o.close <> n.close""", ["load1", "load2"])
def merge_corrections(fx):
    return upsert.merge_corrections(fx.first_load(), fx.second_load())


# --- reads -----------------------------------------------------------------------

_RANGE = """"timestamp" >= TIMESTAMP '2024-01-05' AND "timestamp" < TIMESTAMP '2024-01-20'"""


@query("query_candles", f"""SELECT {KEY}, {ohlcv()} FROM c1h WHERE pair = 'view' AND {_RANGE}""", ["c1h"])
def query_candles(fx):
    return reads.query_candles(fx.candles("1h"), "view", "1h", "2024-01-05", "2024-01-20")


@query("query_page", f"""SELECT {KEY}, {ohlcv()}, total, total > 60 AS has_more, least(60, total) AS next_offset
    FROM (SELECT *, count(*) OVER () AS total FROM c1h WHERE {_RANGE})
    ORDER BY "timestamp" DESC, pair, "interval" LIMIT 50 OFFSET 10""", ["c1h"])
def query_page(fx):
    return reads.query_page(fx.candles("1h"), start="2024-01-05", end="2024-01-20",
                            descending=True, limit=50, offset=10)


@query("query_page_info", f"""SELECT count(*) AS total, false AS has_more, count(*) AS next_offset FROM c1h WHERE pair = 'view' AND {_RANGE}""", ["c1h"])
def query_page_info(fx):
    return reads.query_page_info(fx.candles("1h"), "view", "1h", "2024-01-05", "2024-01-20", limit=50, offset=1_000_000)


@query("query_after", f"""SELECT {KEY}, {ohlcv()} FROM c1h WHERE ("timestamp", pair, "interval") > (TIMESTAMP '2024-01-10 05:00:00', 'error', '1h')
    ORDER BY "timestamp", pair, "interval" LIMIT 25""", ["c1h"])
def query_after(fx):
    return reads.query_after(fx.candles("1h"), "2024-01-10 05:00:00", "error", "1h", 25)


@query("query_defaults", f"""SELECT {KEY}, {ohlcv()} FROM c1d WHERE "timestamp" >= TIMESTAMP '1998-06-08' AND "timestamp" < TIMESTAMP '1998-06-15'
    ORDER BY "timestamp", pair, "interval" LIMIT 100""", ["c1d"])
def query_defaults(fx):
    return reads.query_defaults(fx.daily(), "1998-06-15 00:00:00")


@query("latest_candle", f"""SELECT {KEY}, {ohlcv()} FROM (SELECT *, row_number() OVER
    (PARTITION BY pair, "interval" ORDER BY "timestamp" DESC) AS rn FROM c1h) WHERE rn = 1""", ["c1h"])
def latest_candle(fx):
    return reads.latest_candle(fx.candles("1h"))


@query("due_series", """SELECT pair, "interval", max("timestamp") AS latest, max("timestamp") + INTERVAL 1 HOUR AS next_due
    FROM c1h GROUP BY 1, 2 HAVING max("timestamp") + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-31'""", ["c1h"])
def due_series(fx):
    return reads.due_series(fx.candles("1h"), "2024-01-31 00:00:00")


@query("incremental_window", """SELECT pair, "interval", latest, latest + INTERVAL 1 HOUR AS start_time, end_time,
      least(latest + INTERVAL 1 HOUR, end_time - INTERVAL 2 DAY) AS overlap_start
    FROM (SELECT pair, "interval", max("timestamp") AS latest, TIMESTAMP '2024-01-31 12:00:00' AS end_time FROM c1h GROUP BY 1, 2)
    WHERE latest + INTERVAL 1 HOUR < end_time""", ["c1h"])
def incremental_window(fx):
    return reads.incremental_window(fx.candles("1h"), "2024-01-31 12:00:00")


@query("as_of_prev", f"""SELECT {KEY}, {r6('close')} AS close, prev_timestamp, {r6('prev_close')} AS prev_close FROM steps""", ["steps"])
def as_of_prev_query(fx):
    return as_of_prev(fx.candles("1h"), slots_per_bucket=100)


@query("lookback_context", f"""SELECT {KEY}, {r6('close')} AS close, count(*) OVER w AS context_rows,
      {r6('avg(CAST(close AS DOUBLE)) OVER w')} AS mean_close,
      {r6('stddev_samp(CAST(close AS DOUBLE)) OVER w')} AS std_close FROM c1h
    WINDOW w AS (PARTITION BY pair, "interval" ORDER BY "timestamp" ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)""", ["c1h"])
def lookback_context_query(fx):
    return lookback_context(fx.candles("1h"), block=100)
