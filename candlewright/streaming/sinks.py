"""Where streams end up."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from candlewright.operators.upsert import dedup_candles, merge_corrections
from candlewright.schemas import CANDLE_KEY
from candlewright.session import hadoop_path, shared_path
from candlewright.sources.candles import present_candles, store_batch

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_append(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append finished rows to a Parquet table."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def start_upsert(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Upsert every micro-batch into a partitioned candle table."""
    def write(batch: DataFrame, _batch_id: int) -> None:
        store_batch(batch.sparkSession, path, batch)

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def start_with_corrections(lateness_seconds: int = 300):
    """A sink that upserts candles and reports what late ones correct.

    A row is late if it lies further behind the latest time of all earlier micro-batches
    than the lateness allows. Rows on time are upserted into the table at the path. Late
    ones are first compared with the table, and what is new or changed goes to
    ``<path>-corrections``; then they are upserted as well. The latest time and the corrections
    are one directory per micro-batch: a repeated micro-batch finds its corrections
    complete and keeps them, because the table may already hold its rows.
    """
    def start(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
        def write(batch: DataFrame, batch_id: int) -> None:
            spark = batch.sparkSession
            at = lambda table, number: f"{path}-{table}/batch={number}"
            there = lambda where: (lambda p, fs: fs.exists(p))(*hadoop_path(spark, where))
            batch.write.mode("overwrite").parquet(at("arrived", batch_id))
            rows = spark.read.schema(batch.schema).parquet(at("arrived", batch_id))
            mark = None
            if there(at("latest", batch_id - 1)):
                mark = spark.read.parquet(at("latest", batch_id - 1)).first()[0]
            late = F.lit(False) if mark is None else F.coalesce(
                F.unix_micros("timestamp") < F.unix_micros(F.lit(mark)) - lateness_seconds * 1_000_000, F.lit(False))
            if not there(at("corrections", batch_id) + "/_SUCCESS"):
                corrections(spark, path, rows.where(late)).write.mode("overwrite").parquet(at("corrections", batch_id))
            store_batch(spark, path, rows.where(~late))
            store_batch(spark, path, rows.where(late))
            latest = rows.agg(F.greatest(F.max("timestamp"), F.lit(mark).cast("timestamp")).alias("latest"))
            latest.coalesce(1).write.mode("overwrite").parquet(at("latest", batch_id))
            for table, number in (("arrived", batch_id), ("latest", batch_id - 2)):
                p, fs = hadoop_path(spark, at(table, number))
                fs.delete(p, True)

        return (
            stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start()
        )

    return start


def corrections(spark: SparkSession, path: str, late: DataFrame) -> DataFrame:
    """New and changed candles of ``late`` against the stored table, of which only their keys are read."""
    newest = dedup_candles(late)
    table = present_candles(spark, path, late)
    existing = late.limit(0) if table is None else table.join(newest.select(*CANDLE_KEY), CANDLE_KEY, "left_semi")
    return merge_corrections(existing, newest)


def drain(spark: SparkSession, stream: DataFrame, start=start_append) -> str:
    """Process all available input into a fresh table in the shared folder; returns its path."""
    if spark.conf.get(STATE_STORE, None) != ROCKSDB:
        spark.conf.set(STATE_STORE, ROCKSDB)
    base = shared_path(spark, "stream")
    query = start(stream, f"{base}/table", f"{base}/checkpoint")
    query.awaitTermination()
    return f"{base}/table"
