"""Table schemas.

Prices and volumes are ``DECIMAL(30,18)``: wide enough for eighteen fraction
digits and twelve integer digits, and still exact when multiplied by a
``DECIMAL(6,2)`` threshold.
"""

from pyspark.sql import types as T

DECIMAL = T.DecimalType(30, 18)
THRESHOLD = T.DecimalType(6, 2)

SERIES_KEY = ["pair", "interval"]
CANDLE_KEY = ["pair", "interval", "timestamp"]
PRICE_FIELDS = ["open", "high", "low", "close"]
CANDLE_FIELDS = PRICE_FIELDS + ["volume"]


def _fields(*pairs):
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in pairs])


_S, _I, _L, _D, _TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType(),
)

CANDLES = _fields(
    ("pair", _S), ("interval", _S), ("timestamp", _TS),
    *[(f, DECIMAL) for f in CANDLE_FIELDS],
    ("source", _S), ("created_at", _TS),
)

RAW_CANDLES = _fields(
    ("pair", _S), ("interval", _S), ("timestamp", _TS),
    *[(f, _S) for f in CANDLE_FIELDS],
)

GAPS = _fields(
    ("id", _S), ("pair", _S), ("interval", _S), ("start_time", _TS), ("end_time", _TS),
    ("status", _S), ("created_at", _TS), ("filled_at", _TS), ("priority", _I),
    ("attempts", _I), ("last_attempt_at", _TS), ("error_message", _S),
)

JOBS = _fields(
    ("id", _S), ("type", _S), ("pair", _S), ("interval", _S), ("start_time", _TS),
    ("end_time", _TS), ("status", _S), ("progress", _I), ("records_collected", _L),
    ("error_message", _S), ("retry_count", _I), ("created_at", _TS), ("updated_at", _TS),
)

ANOMALY = _fields(
    ("type", _S), ("rule", _S), ("description", _S), ("value", DECIMAL),
    ("threshold", DECIMAL), ("confidence", _D), ("severity", _S),
)

TRADING_PAIRS = _fields(
    ("symbol", _S), ("base_asset", _S), ("quote_asset", _S), ("active", T.BooleanType()),
    ("min_volume", _S), ("max_volume", _S), ("price_step", _S),
)
