"""Candle tables on disk: layout, reading, writing, exporting.

Layout: Parquet, partitioned by pair, interval and month, rows sorted by time
within a file, so that equality filters prune directories and time filters prune
row groups.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewright.functions.decimals import fixed_text
from candlewright.functions.intervals import DAY, interval_seconds
from candlewright.functions.rendering import iso_utc
from candlewright.operators.upsert import dedup_candles, upsert_candles
from candlewright.operators.validate import validate_candles
from candlewright.schemas import CANDLE_FIELDS, CANDLES, SERIES_KEY
from candlewright.session import hadoop_path, shared_path

EXPORT_COLUMNS = ["timestamp", "pair", "interval", *CANDLE_FIELDS]
PARTITIONS = [*SERIES_KEY, "month"]


def read_candles(spark: SparkSession, path: str, fmt: str = "parquet", schema=CANDLES) -> DataFrame:
    """A candle table; CSV and JSON need the schema, Parquet brings its own.

    Directory names are text: Spark would take the interval '1d' for a number.
    """
    reader = spark.read.format(fmt)
    if fmt == "parquet":
        own = reader.load(path).schema
        schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name in SERIES_KEY else f for f in own])
    reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def _with_month(candles: DataFrame) -> DataFrame:
    """Adds the directory column: year * 100 + month, and + 0 for daily and longer candles.

    A year of daily candles is as small as a day of minute candles.
    """
    month = F.when(interval_seconds(F.col("interval")) >= DAY, 0).otherwise(F.month("timestamp"))
    return candles.withColumn("month", (F.year("timestamp") * 100 + month).cast("int"))


def write_candles(candles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the partitioned layout; with ``overwrite`` only touched partitions change.

    Rows are distributed by (series, month) and not by series alone, so one
    hot series is written by many tasks.
    """
    (
        _with_month(candles).repartition(*PARTITIONS)
        .sortWithinPartitions(*PARTITIONS, "timestamp")
        .write.mode(mode).option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTITIONS).parquet(path)
    )


def _stored(spark: SparkSession, path: str, like: DataFrame):
    """The table at ``path`` with the columns of ``like``, or None when there is none."""
    p, fs = hadoop_path(spark, path)
    if not fs.exists(p):
        return None
    return spark.read.schema(T.StructType(_with_month(like).schema.fields)).parquet(path)


def present_candles(spark: SparkSession, path: str, like: DataFrame):
    """The table at ``path`` with exactly the columns of ``like``, or None when there is none."""
    table = _stored(spark, path, like)
    return None if table is None else table.select(*like.columns)


def store_batch(spark: SparkSession, path: str, incoming: DataFrame) -> None:
    """Upsert a batch into the table; only the partitions it touches are rewritten.

    The merged partitions go to a staging table first and replace the old ones
    from there, so no file is overwritten while it is being read, and a repeated
    attempt gives the same table.
    """
    existing = _stored(spark, path, incoming)
    if existing is None:
        write_candles(dedup_candles(incoming), path)
        return
    batch = _with_month(incoming)
    reach = batch.agg(F.min("month").alias("lo"), F.max("month").alias("hi")).first()
    if reach["lo"] is None:
        return
    touched = batch.select(*PARTITIONS).distinct()
    # The month bounds prune directories; the semi join then keeps exactly the touched ones.
    affected = existing.where(F.col("month").between(reach["lo"], reach["hi"])).join(
        touched, PARTITIONS, "left_semi")
    stage = shared_path(spark, "stage")
    upsert_candles(affected.drop("month"), incoming).write.parquet(stage)
    write_candles(spark.read.parquet(stage), path)
    p, fs = hadoop_path(spark, stage)
    fs.delete(p, True)


def stored_candles(spark: SparkSession, path: str, schema) -> DataFrame:
    """The partitioned table with the key columns typed by ``schema``."""
    full = T.StructType([*schema.fields, T.StructField("month", T.IntegerType())])
    return spark.read.schema(full).parquet(path).drop("month")


def accept_batch(raw: DataFrame) -> DataFrame:
    """All rows when every row is valid, none otherwise.

    One invalid candle rejects its whole batch; the count of invalid rows is a
    scalar subquery.
    """
    bad = validate_candles(raw).agg(F.count("error_field")).scalar()
    return raw.where(bad == 0)


def export_view(candles: DataFrame) -> DataFrame:
    """Text columns as exported: ISO time, prices with eight decimals."""
    return candles.select(
        iso_utc(F.col("timestamp")).alias("timestamp"), "pair", "interval",
        *[fixed_text(F.col(f)).alias(f) for f in CANDLE_FIELDS])


def export_candles(candles: DataFrame, path: str, fmt: str = "csv", limit: int = 0) -> None:
    """CSV, JSON or Parquet export of a query result."""
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError(f"unsupported export format: {fmt!r}")
    out = candles.limit(limit) if limit else candles
    writer = (out if fmt == "parquet" else export_view(out)).write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def table_view(candles: DataFrame, limit: int) -> DataFrame:
    """Columns of the on-screen table, first ``limit`` rows in time order."""
    cut = lambda f, n: F.substring(fixed_text(F.col(f)), 1, n).alias(f)
    return candles.orderBy("timestamp", "pair", "interval").limit(limit).select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm").alias("timestamp"), "pair", "interval",
        *[cut(f, 8) for f in CANDLE_FIELDS[:4]], cut("volume", 10))
