"""Cross-candle checks on a stream.

A row is held back until the watermark has passed it. What is released in one micro-batch
lies behind everything released before, so the batch operators apply to it together with
the last row of each series; the result is that of a batch, whatever order the rows
arrived in. All of it runs in the JVM, and a series with most of the rows is split into
buckets like in a batch.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from candlewright.operators.anomalies import candle_steps, cross_anomalies
from candlewright.operators.gaps import gaps_in_sequence
from candlewright.operators.series import transitions
from candlewright.schemas import SERIES_KEY
from candlewright.session import hadoop_path
from candlewright.streaming.streams import LATENESS

MINUTES_PER_BUCKET = 4096


def released(candles: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """High and volume of each candle, once the watermark has passed it.

    Of several candles with one key the greatest (high, volume) counts.
    """
    return candles.withWatermark("timestamp", lateness).groupBy(*SERIES_KEY, "timestamp").agg(
        F.max(F.struct("high", "volume")).alias("row")).select(*SERIES_KEY, "timestamp", "row.high", "row.volume")


def activity(rows: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """First and last time and number of rows of each pair and minute, once the minute is over.

    Minutes are summed up before any exchange, so no task sees all rows of a pair.
    """
    return rows.withWatermark("timestamp", lateness).groupBy("pair", F.window("timestamp", "1 minute").alias("w")).agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count(F.lit(1)).alias("rows")).select(
        "pair", F.col("w.start").alias("timestamp"), "first_seen", "last_seen", "rows")


def steps(rows: DataFrame) -> DataFrame:
    """Each released candle next to its predecessor."""
    return candle_steps(rows)


def spikes(rows: DataFrame) -> DataFrame:
    """Price spikes and volume surges of released candles."""
    return cross_anomalies(candle_steps(rows))


def gaps(rows: DataFrame) -> DataFrame:
    """Gaps between released neighbours."""
    return gaps_in_sequence(rows)


def outages(quiet_seconds: int) -> Callable[[DataFrame], DataFrame]:
    """Times without any row of a pair, from its :func:`activity`: at least so many seconds long."""
    def found(minutes: DataFrame) -> DataFrame:
        pairs = transitions(minutes, ["pair"], "timestamp", ["first_seen", "last_seen"],
                            F.floor(F.unix_seconds("timestamp") / (60 * MINUTES_PER_BUCKET)).cast("bigint"))
        quiet = F.unix_micros("first_seen") - F.unix_micros("prev_last_seen")
        return pairs.where(quiet >= quiet_seconds * 1_000_000).select(
            "pair", F.col("prev_last_seen").alias("start_time"), F.col("first_seen").alias("end_time"),
            (quiet / 1_000_000).alias("quiet_seconds"))

    return found


def starting(find: Callable[[DataFrame], DataFrame], keys=tuple(SERIES_KEY)):
    """A sink that applies ``find`` to the released rows of each micro-batch and the rows before them.

    Three tables of one directory per micro-batch lie under the path: the released rows
    (while they are in use), the last row of every series so far, and the result.
    A micro-batch reads the last rows of the one before and overwrites its own
    directories, so a repeated one gives the same result; the state is one row per series.
    """
    def start(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
        def write(batch: DataFrame, batch_id: int) -> None:
            spark = batch.sparkSession
            at = lambda table, number: f"{path}-{table}/batch={number}"
            batch.write.mode("overwrite").parquet(at("released", batch_id))
            rows = spark.read.schema(batch.schema).parquet(at("released", batch_id))
            before, fs = hadoop_path(spark, at("last", batch_id - 1))
            if fs.exists(before):
                rows = rows.unionByName(spark.read.schema(batch.schema).parquet(at("last", batch_id - 1)))
            find(rows).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            rows.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), "timestamp").alias("row")).select("row.*").select(
                *batch.columns).write.mode("overwrite").parquet(at("last", batch_id))
            for table, number in (("released", batch_id), ("last", batch_id - 2)):
                fs.delete(hadoop_path(spark, at(table, number))[0], True)

        return (
            stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start()
        )

    return start


def result(spark, path: str, schema) -> DataFrame:
    """The rows that a :func:`starting` sink has found so far."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)
