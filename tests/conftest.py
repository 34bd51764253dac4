import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from candlewright.session import local_session

    session = local_session(8, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def candles(spark):
    """Build typed candles from (timestamp text, open, high, low, close, volume) rows."""
    from pyspark.sql import functions as F

    from candlewright.schemas import CANDLE_FIELDS, DECIMAL

    def build(rows, pair="BTC-USD", interval="1h"):
        df = spark.createDataFrame(
            [(r[0], *[str(v) for v in r[1:]]) for r in rows], "t string, " + ", ".join(
                f"{f} string" for f in CANDLE_FIELDS))
        return df.select(
            F.lit(pair).alias("pair"), F.lit(interval).alias("interval"),
            F.col("t").cast("timestamp").alias("timestamp"),
            *[F.col(f).cast(DECIMAL).alias(f) for f in CANDLE_FIELDS])

    return build


@pytest.fixture
def times(spark):
    """Candle keys only: (pair, interval, timestamp)."""
    from pyspark.sql import functions as F

    def build(stamps, pair="BTC-USD", interval="1h"):
        rows = spark.createDataFrame([(pair, interval, s) for s in stamps],
                                     "pair string, interval string, t string")
        return rows.select("pair", "interval", F.col("t").cast("timestamp").alias("timestamp"))

    return build
