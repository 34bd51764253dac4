"""The test tables seen as candles, gaps, jobs and payloads.

Each method states how one input of the operators is derived from the given
tables; ``sqlparts`` has the same derivations in SQL. Derived rows only use
arithmetic on times and keys, so both sides agree at any scale.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.functions.intervals import DAY, HOUR
from candlewright.operators.gaps import gaps_in_range
from candlewright.operators.lifecycle import gap_id
from candlewright.operators.resample import ticks_to_candles
from candlewright.operators.validate import candle_results, parse_decimals
from candlewright.schemas import CANDLE_FIELDS, DECIMAL, SERIES_KEY
from candlewright.session import hadoop_path, shared_path

START, END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
AS_OF = "2024-02-15 00:00:00"
JOBS_AS_OF = "2001-06-01 00:00:00"
# Every 5-minute slot has one number; fixture variety comes from its remainders.
SLOT = 300

ERROR_TEXTS = [
    "connection refused by host", "request timeout", "rate limit reached", "unauthorized key",
    "validation failed", "missing required field", "internal server trouble",
    "panic in worker", "context canceled by caller", "something odd", "DNS lookup failed",
    "Too Many Requests",
]
JOB_INTERVALS = ["1m", "5m", "1h", "1d", "7x", ""]


def _unix(c):
    return F.unix_seconds(c)


def _shift(base, seconds):
    return F.timestamp_seconds(_unix(base) + seconds)


def _text(c):
    return F.format_string("%.8f", F.col(c).cast("double"))


# Stored tables by (application, folder of the given tables, name).
_STORED = {}


class Fixtures:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- candles ---------------------------------------------------------------

    def ticks(self) -> DataFrame:
        price = F.col("value").cast("decimal(18,8)")
        return self.table("events").select(
            F.col("event_id").alias("tick_id"), F.col("ts").cast("timestamp").alias("ts"),
            F.col("event_type").alias("pair"), price.alias("price"), price.alias("size"))

    def stored(self, name: str, build) -> DataFrame:
        """A table derived once per application and kept in the shared folder.

        Candles and gaps are stored tables in use, and most operators start
        from them; building them is measured by the queries that build them.
        """
        key = (self.spark.sparkContext.applicationId, self.folder, self.version(), name)
        if key not in _STORED:
            path = shared_path(self.spark, f"derived-{name}")
            build().write.parquet(path)
            _STORED[key] = path
        return self.spark.read.parquet(_STORED[key])

    def version(self):
        """Names, sizes and times of the given tables, so that changed tables are derived anew."""
        p, fs = hadoop_path(self.spark, self.folder)
        return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p)))

    def candles(self, interval: str = "1h") -> DataFrame:
        return self.stored(f"candles_{interval}", lambda: self.build_candles(interval))

    def daily(self) -> DataFrame:
        return self.stored("candles_1d", self.build_daily)

    def gaps(self) -> DataFrame:
        return self.stored("gaps", self.build_gaps)

    def build_candles(self, interval: str) -> DataFrame:
        return ticks_to_candles(self.ticks(), interval, ["tick_id"])

    def build_daily(self) -> DataFrame:
        ticks = self.table("lineitem").select(
            F.concat_ws("-", "l_returnflag", "l_linestatus").alias("pair"),
            F.col("l_shipdate").cast("timestamp").alias("ts"),
            F.col("l_extendedprice").cast("decimal(18,8)").alias("price"),
            F.col("l_quantity").cast("decimal(18,8)").alias("size"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        return ticks_to_candles(
            ticks, "1d", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])

    def dirty(self) -> DataFrame:
        """Hourly candles as text, with one kind of damage per hour of eleven."""
        c = self.candles("1h")
        k = F.pmod(F.floor(_unix("timestamp") / HOUR), F.lit(11))
        half = F.format_string("%.8f", (F.col("open") * F.lit("0.5").cast("decimal(2,1)")).cast("double"))
        return c.select(
            F.col("pair").alias("slot_pair"), F.col("timestamp").alias("slot_time"),
            F.when(k == 5, "").otherwise(F.col("pair")).alias("pair"), "interval",
            F.when(k != 4, F.col("timestamp")).alias("timestamp"),
            F.when(k == 1, F.concat(F.lit("-"), _text("open"))).when(k == 3, "not-a-number")
            .when(k == 6, F.concat(F.lit(" "), _text("open"), F.lit(" "))).otherwise(_text("open"))
            .alias("open"),
            F.when(k == 0, half).otherwise(_text("high")).alias("high"),
            _text("low").alias("low"), _text("close").alias("close"),
            F.when(k == 2, F.concat(F.lit("-"), _text("volume"))).otherwise(_text("volume"))
            .alias("volume"))

    def typed(self) -> DataFrame:
        """Damaged candles with decimals; unparseable fields are NULL."""
        return parse_decimals(self.dirty()).drop(*[f"{f}_text" for f in CANDLE_FIELDS])

    def results(self):
        return candle_results(self.dirty(), AS_OF)

    def two_loads(self) -> DataFrame:
        """Hourly candles loaded twice, the second load revised every third hour."""
        c = self.candles("1h").withColumn("created_at", F.lit(AS_OF).cast("timestamp"))
        return c.withColumn("load_seq", F.lit(1)).unionByName(self.second_load())

    def second_load(self) -> DataFrame:
        """Revised candles: every third hour close doubled, every fifth hour left out."""
        hour = F.floor(_unix("timestamp") / HOUR)
        return (
            self.candles("1h").where(F.pmod(hour, F.lit(5)) != 0)
            .withColumn("close", F.when(F.pmod(hour, F.lit(3)) == 0, (F.col("close") * 2).cast(DECIMAL))
                        .otherwise(F.col("close")))
            .withColumn("created_at", F.lit(AS_OF).cast("timestamp")).withColumn("load_seq", F.lit(2))
        )

    def first_load(self) -> DataFrame:
        """Every seventh hour is missing."""
        hour = F.floor(_unix("timestamp") / HOUR)
        return (
            self.candles("1h").where(F.pmod(hour, F.lit(7)) != 0)
            .withColumn("created_at", F.lit(AS_OF).cast("timestamp")).withColumn("load_seq", F.lit(1))
        )

    # --- gaps ------------------------------------------------------------------

    def periods(self, interval: str = "5m") -> DataFrame:
        return gaps_in_range(self.candles(interval), START, END)

    def build_gaps(self) -> DataFrame:
        """Gaps of the 5-minute candles in all lifecycle states."""
        h = F.floor(_unix("start_time") / SLOT).cast("bigint")
        rem = lambda n: F.pmod(F.col("_h"), F.lit(n))
        as_of = F.lit(AS_OF).cast("timestamp")
        status = (F.when(rem(7) == 4, "filling").when(rem(7) == 5, "filled")
                  .when(rem(7) == 6, "permanent").otherwise("detected"))
        attempts = (F.when(F.col("status") == "detected", rem(6))
                    .when(F.col("status") == "filling", rem(3) + 1)
                    .when(F.col("status") == "filled", rem(2) + 1).otherwise(5))
        return (
            self.periods("5m").withColumn("_h", h).withColumn("status", status)
            .withColumn("attempts", attempts.cast("int"))
            .withColumn("created_at", _shift(as_of, -(rem(97) * 3 * HOUR + 600)))
            .select(
                gap_id().alias("id"), *SERIES_KEY, "start_time", "end_time", "status", "created_at",
                F.when(F.col("status") == "filled", _shift(F.col("created_at"), (rem(13) + 1) * HOUR))
                .alias("filled_at"),
                rem(4).cast("int").alias("priority"), "attempts",
                F.when(F.col("attempts") > 0, _shift(as_of, -(rem(5) * 1200))).alias("last_attempt_at"),
                F.when((F.col("status") == "detected") & (F.col("attempts") > 0) & (rem(2) == 0),
                       "no data available for gap period")
                .when(F.col("status") == "permanent", "exchange delisted pair").alias("error_message"))
        )

    def gap_number(self):
        return F.floor(_unix("start_time") / SLOT).cast("bigint")

    def broken_gaps(self) -> DataFrame:
        g = self.gaps()
        k = F.pmod(self.gap_number(), F.lit(17))
        null_ts, null = F.lit(None).cast("timestamp"), F.lit("")
        return g.withColumns({
            "source_id": F.col("id"),
            "id": F.when(k == 0, null).otherwise(F.col("id")),
            "pair": F.when(k == 1, null).otherwise(F.col("pair")),
            "interval": F.when(k == 2, null).otherwise(F.col("interval")),
            "start_time": F.when(k == 3, null_ts).otherwise(F.col("start_time")),
            "end_time": F.when(k == 4, null_ts).when(k == 5, F.col("start_time")).otherwise(F.col("end_time")),
            "status": F.when(k == 6, "lost").when(k == 7, "filled").when(k == 8, "detected")
            .otherwise(F.col("status")),
            "filled_at": F.when(k == 7, null_ts).when(k == 8, F.lit(AS_OF).cast("timestamp"))
            .otherwise(F.col("filled_at")),
        })

    def gap_events(self) -> DataFrame:
        """One to three lifecycle events per gap, many of them illegal."""
        h = self.gap_number()
        n = F.col("_n")
        kinds = F.array(*[F.lit(k) for k in ("start", "start", "fill", "fail", "permanent")])
        return self.gaps().select("id", h.alias("_h")).withColumn(
            "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.pmod("_h", F.lit(3))))
        ).select(
            "id", (n + 1).alias("event_seq"),
            F.get(kinds, F.pmod(F.col("_h") + n, F.lit(5)).cast("int")).alias("event_type"),
            _shift(F.lit(AS_OF).cast("timestamp"), (n + 1) * 60).alias("event_time"),
            F.concat(F.lit("note "), n.cast("string")).alias("message"))

    def wide_gaps(self) -> DataFrame:
        """Gaps stretched by a varying amount, so that many overlap."""
        h = self.gap_number()
        return self.gaps().withColumn("end_time", _shift(F.col("end_time"), F.pmod(h, F.lit(4)) * SLOT))

    def donor(self) -> DataFrame:
        """A candle table with something for many gaps.

        Each pair's candles under the name of the next pair in a fixed ring.
        """
        ring = ["click", "error", "purchase", "signup", "view"]
        after = dict(zip(ring, ring[1:] + ring[:1]))
        pair = F.col("pair")
        for name, following in after.items():
            pair = F.when(F.col("pair") == name, following).otherwise(pair)
        return self.candles("5m").withColumn("pair", pair)

    # --- jobs ------------------------------------------------------------------

    def jobs(self) -> DataFrame:
        k = F.col("o_orderkey")
        rem = lambda n: F.pmod(k, F.lit(n))
        base = F.col("o_orderdate").cast("timestamp")
        status = (F.when(rem(8) == 0, "pending").when(rem(8) == 1, "failed").when(rem(41) == 0, "lost")
                  .when(F.col("o_orderstatus") == "F", "completed")
                  .when(F.col("o_orderstatus") == "O", "running").otherwise("failed"))
        pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
        return self.table("orders").withColumn("status", status).select(
            F.concat(F.lit("job-"), k.cast("string")).alias("id"),
            pick(["initial_sync", "update", "backfill", "unknown"], rem(4)).alias("type"),
            F.when(rem(29) == 0, "").otherwise(F.concat(
                F.lit("P"), F.pmod(F.col("o_custkey"), F.lit(7)).cast("string"))).alias("pair"),
            pick(JOB_INTERVALS, rem(6)).alias("interval"),
            F.when(rem(31) != 0, base).alias("start_time"),
            _shift(base, (rem(5) - 1) * DAY).alias("end_time"), "status",
            F.when(F.col("status") == "completed", 100).when(F.col("status") == "running", rem(120))
            .otherwise(rem(90) - 1).cast("int").alias("progress"),
            (F.pmod(k * 37, F.lit(5000)) - 10).alias("records_collected"),
            F.when(F.col("status") == "failed", pick(ERROR_TEXTS, rem(12))).alias("error_message"),
            (rem(9) - 1).cast("int").alias("retry_count"),
            base.alias("created_at"), _shift(base, rem(500) * 60).alias("updated_at"))

    def job_events(self) -> DataFrame:
        k, n = F.col("o_orderkey"), F.col("_n")
        kinds = F.array(*[F.lit(v) for v in ("start", "fail", "retry", "complete", "start")])
        return self.table("orders").withColumn(
            "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.pmod(k, F.lit(3))))
        ).select(
            F.concat(F.lit("job-"), k.cast("string")).alias("id"), (n + 1).alias("event_seq"),
            F.get(kinds, F.pmod(k * 7 + n, F.lit(5)).cast("int")).alias("event_type"),
            _shift(F.lit(JOBS_AS_OF).cast("timestamp"), (n + 1) * 60).alias("event_time"),
            F.concat(F.lit("note "), n.cast("string")).alias("message"))

    # --- payloads and pairs ------------------------------------------------------

    def payloads(self) -> DataFrame:
        """One JSON document of candle arrays per pair and month of the daily candles.

        On the 5th an element lacks the volume, on the 6th the time is text, on
        the 7th a value is null; opens are text, the rest are numbers.
        """
        day = F.dayofmonth("timestamp")
        unix = _unix("timestamp").cast("string")
        num = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
        quoted = F.concat(F.lit('"'), num("open"), F.lit('"'))
        five = F.concat_ws(",", unix, num("low"), num("high"), quoted, num("close"))
        element = (
            F.when(day == 5, five)
            .when(day == 6, F.concat_ws(",", F.concat(F.lit('"'), unix, F.lit('"')), num("low"),
                                        num("high"), quoted, num("close"), num("volume")))
            .when(day == 7, F.concat_ws(",", unix, num("low"), F.lit("null"), quoted, num("close"),
                                        num("volume")))
            .otherwise(F.concat(five, F.lit(","), num("volume")))
        )
        return self.daily().groupBy("pair", "interval", F.date_trunc("month", "timestamp").alias("month")).agg(
            F.concat(F.lit("["), F.concat_ws(",", F.sort_array(F.collect_list(
                F.concat(F.lit("["), element, F.lit("]"))))), F.lit("]")).alias("payload")
        ).withColumn("payload", F.when(
            (F.month("month") == 2) & (F.pmod(F.year("month"), F.lit(2)) == 0),
            F.concat(F.lit("{"), "payload")).otherwise(F.col("payload")))

    def products(self) -> DataFrame:
        n, r = self.table("nation"), self.table("region")
        k = F.col("n_nationkey")
        rem = lambda m: F.pmod(k, F.lit(m))
        return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.to_json(F.struct(
            F.when(rem(5) == 0, F.col("n_name")).otherwise(F.concat_ws("-", "n_name", "r_name"))
            .alias("product_id"),
            F.when(rem(10) == 5, "").otherwise(F.concat(F.lit("B"), k.cast("string")))
            .alias("base_currency_id"),
            F.col("r_name").alias("quote_currency_id"),
            F.when(rem(4) == 0, "   ").when(rem(4) == 1, "").otherwise("0.01").alias("base_min_size"),
            F.lit("1000").alias("base_max_size"), F.lit("0.001").alias("quote_increment"),
            (rem(3) == 0).alias("trading_disabled"))).alias("product"))

    def pair_table(self) -> DataFrame:
        """Trading pairs derived from the daily candles: first letter over second."""
        pair = F.col("pair")
        return self.daily().select("pair").distinct().where(pair != "R-F").select(
            pair.alias("symbol"), F.substring(pair, 1, 1).alias("base_asset"),
            F.substring(pair, 3, 1).alias("quote_asset"), (F.substring(pair, 1, 1) != "A").alias("active"))

    def closed_periods(self) -> DataFrame:
        """Weekends between the first and last tick, Friday 20:00 to Monday 04:00."""
        days = self.ticks().agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).select(
            F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"))).alias("d"))
        friday = days.where(F.dayofweek("d") == 6).select(F.col("d").cast("timestamp").alias("d"))
        return friday.select(_shift(F.col("d"), 20 * HOUR).alias("start_time"),
                             _shift(F.col("d"), 2 * DAY + 28 * HOUR).alias("end_time"))

    def requests(self) -> DataFrame:
        """Query requests, one per event, most with something wrong."""
        k = F.col("event_id")
        rem = lambda n: F.pmod(k, F.lit(n))
        pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
        ts = F.col("ts").cast("timestamp")
        return self.table("events").select(
            k.alias("id"), F.when(rem(11) != 0, F.col("event_type")).otherwise("").alias("pair"),
            pick(["1m", "5m", "2h", "1d", "", "1M", "x", "1h"], rem(8)).alias("interval"), ts.alias("start_time"),
            F.when(rem(17) != 0, _shift(ts, (rem(7) - 1) * HOUR)).alias("end_time"),
            F.when(rem(5) != 0, rem(13) - 1).alias("limit"), F.when(rem(9) != 0, rem(19) - 1).alias("offset"),
            pick(["asc", "desc", "up", None], rem(4)).alias("order"))
