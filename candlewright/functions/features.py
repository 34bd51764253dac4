"""Per-candle arithmetic: one narrow projection, no shuffle."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewright.functions.decimals import ratio
from candlewright.schemas import DECIMAL

_c = F.col


def typical_price() -> Column:
    return (_c("high") + _c("low") + _c("close")) / F.lit(3).cast("decimal(1,0)")


def body_size() -> Column:
    return F.abs(_c("close") - _c("open"))


def price_range() -> Column:
    return _c("high") - _c("low")


def is_bullish() -> Column:
    return _c("close") > _c("open")


def is_bearish() -> Column:
    return _c("close") < _c("open")


def is_doji(threshold) -> Column:
    """Body no larger than ``threshold`` (inclusive)."""
    return body_size() <= F.lit(str(threshold)).cast(DECIMAL)


def price_change() -> Column:
    return _c("close") - _c("open")


def price_change_pct() -> Column:
    return ratio(price_change(), _c("open")) * 100


def notional() -> Column:
    """Traded value, close times volume, in double precision."""
    return _c("close").cast("double") * _c("volume").cast("double")


def candle_features(candles: DataFrame, doji_threshold="0.01") -> DataFrame:
    """All features of every candle."""
    return candles.select(
        "pair", "interval", "timestamp",
        typical_price().alias("typical_price"),
        body_size().alias("body_size"),
        price_range().alias("price_range"),
        is_bullish().alias("is_bullish"),
        is_bearish().alias("is_bearish"),
        is_doji(doji_threshold).alias("is_doji"),
        price_change().alias("price_change"),
        price_change_pct().alias("price_change_pct"),
        notional().alias("notional"),
    )
