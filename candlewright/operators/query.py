"""Reads of the candle table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.functions.intervals import DAY, at, interval_seconds, next_boundary
from candlewright.operators.validate import validate_query_request
from candlewright.schemas import CANDLE_FIELDS, SERIES_KEY

DEFAULT_INTERVAL, DEFAULT_LIMIT, DEFAULT_DAYS = "1d", 100, 7
OVERLAP_SECONDS = 2 * DAY


def select_candles(candles: DataFrame, pair=None, interval=None, start=None, end=None) -> DataFrame:
    """Candles of a pair and/or interval in ``[start, end)``; all conditions push down.

    On a table in the package's layout the range also names its month directories.
    """
    if pair:
        candles = candles.where(F.col("pair") == pair)
    if interval:
        candles = candles.where(F.col("interval") == interval)
    if start is not None:
        candles = candles.where(F.col("timestamp") >= at(start))
    if end is not None:
        candles = candles.where(F.col("timestamp") < at(end))
    return in_months(candles, start, end)


def in_months(candles: DataFrame, start=None, end=None) -> DataFrame:
    """Only the month and year directories that can hold ``[start, end)``, where there are any."""
    if "month" in candles.columns:
        month = lambda ts: F.year(at(ts)) * 100 + F.month(at(ts))
        if start is not None:
            candles = candles.where((F.col("month") >= month(start)) | (F.col("month") == F.year(at(start)) * 100))
        if end is not None:
            candles = candles.where(F.col("month") <= month(end))
    return candles


def check_page(start, end, limit, offset) -> None:
    """Refuse a page that no request may ask for."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset cannot be negative")
    if isinstance(start, str) and isinstance(end, str) and not end > start:
        raise ValueError("end time must be after start time")


def _order(descending: bool):
    return [F.desc("timestamp") if descending else F.asc("timestamp"), F.asc("pair"), F.asc("interval")]


def query_candles(candles: DataFrame, pair=None, interval=None, start=None, end=None,
                  descending: bool = False, limit: int = 0, offset: int = 0) -> DataFrame:
    """One page of candles in order of time; ``limit`` 0 means no limit.

    An offset skips rows on one machine, so it needs a limit; deep pages are for
    :func:`query_after`.
    """
    check_page(start, end, limit, offset)
    if offset and not limit:
        raise ValueError("an offset needs a limit; use query_after for deep pages")
    out = select_candles(candles, pair, interval, start, end).orderBy(*_order(descending))
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit else out


def query_page(candles: DataFrame, pair=None, interval=None, start=None, end=None,
               descending: bool = False, limit: int = 0, offset: int = 0) -> DataFrame:
    """A page with ``total``, ``has_more`` and ``next_offset`` on every row.

    The count is a second, column-pruned pass over the same filter.
    """
    page = query_candles(candles, pair, interval, start, end, descending, limit, offset)
    total = select_candles(candles, pair, interval, start, end).agg(F.count(F.lit(1))).scalar()
    return page.withColumn("total", total).withColumns(_page_end(limit, offset))


def _page_end(limit: int, offset: int):
    total = F.col("total")
    stop = F.least(F.least(F.lit(offset), total) + limit, total) if limit else total
    return {"has_more": stop < total, "next_offset": stop.cast("bigint")}


def query_page_info(candles: DataFrame, pair=None, interval=None, start=None, end=None,
                    limit: int = 0, offset: int = 0) -> DataFrame:
    """One row (total, has_more, next_offset) about a page, also of one beyond the end."""
    check_page(start, end, limit, offset)
    return select_candles(candles, pair, interval, start, end).agg(
        F.count(F.lit(1)).alias("total")).withColumns(_page_end(limit, offset))


def query_series(candles: DataFrame, pair: str, interval: str, start, end, order: str = "asc",
                 limit: int = 0, offset: int = 0) -> DataFrame:
    """A page of one series after the full check of the request."""
    validate_query_request(pair, interval, start, end, limit, offset, order)
    return query_candles(candles, pair, interval, start, end, order == "desc", limit, offset)


def query_after(candles: DataFrame, last_timestamp, last_pair: str, last_interval: str,
                limit: int, **filters) -> DataFrame:
    """Next page after a given row: no offset to skip, however deep the page is."""
    here = F.struct(at(last_timestamp), F.lit(last_pair), F.lit(last_interval))
    rest = select_candles(candles, **filters).where(F.col("timestamp") >= at(last_timestamp)).where(
        F.struct("timestamp", "pair", "interval") > here)
    return rest.orderBy(*_order(False)).limit(limit)


def query_defaults(candles: DataFrame, as_of, pair=None, interval=DEFAULT_INTERVAL,
                   days: int = DEFAULT_DAYS, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Query with the command-line defaults: daily, last seven days, 100 rows."""
    end = at(as_of)
    start = F.timestamp_seconds(F.unix_seconds(end) - days * DAY)
    return query_candles(candles, pair, interval, start, end, limit=limit)


def latest_candle(candles: DataFrame) -> DataFrame:
    """Newest candle of every series.

    One ``max_by`` per field keeps this a hash aggregate with map-side combine.
    """
    return candles.groupBy(*SERIES_KEY).agg(
        F.max("timestamp").alias("timestamp"),
        *[F.max_by(f, "timestamp").alias(f) for f in CANDLE_FIELDS])


def due_series(candles: DataFrame, as_of) -> DataFrame:
    """Series whose next candle boundary after the latest candle has passed."""
    last = candles.groupBy(*SERIES_KEY).agg(F.max("timestamp").alias("latest"))
    return last.withColumn("next_due", next_boundary(F.col("latest"), F.col("interval"))).where(
        F.col("next_due") <= at(as_of))


def incremental_window(candles: DataFrame, as_of, overlap_seconds: int = OVERLAP_SECONDS) -> DataFrame:
    """What to collect next per series: from the next slot, and from the overlap start.

    Series that are already complete up to ``as_of`` are left out.
    """
    step = interval_seconds(F.col("interval"))
    last = candles.groupBy(*SERIES_KEY).agg(F.max("timestamp").alias("latest"))
    return (
        last.withColumn("start_time", F.timestamp_seconds(F.unix_seconds("latest") + step))
        .withColumn("end_time", at(as_of))
        .where(F.col("start_time") < F.col("end_time"))
        .withColumn("overlap_start", F.least("start_time", F.timestamp_seconds(
            F.unix_seconds("end_time") - overlap_seconds)))
    )


def candles_with_pair(candles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candles with their trading pair; unknown and inactive pairs are flagged.

    The pair table is small but not bounded, so no broadcast is forced: the
    planner decides by its size, and adaptive execution handles a hot pair.
    """
    dim = pairs.select(F.col("symbol").alias("pair"), "base_asset", "quote_asset", "active")
    return candles.join(dim, "pair", "left").withColumn(
        "pair_state", F.when(F.col("active").isNull(), "unknown")
        .when(F.col("active"), "active").otherwise("inactive"))
