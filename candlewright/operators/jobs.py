"""The collection job ledger."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.functions.errors import error_category, error_severity, error_type, is_retryable
from candlewright.functions.intervals import at
from candlewright.operators.series import ranked
from candlewright.operators.statefold import EVENTS_PER_BLOCK, fold_events, fold_long, fold_short, rank_levels, split_by_length
from candlewright.schemas import JOBS
from candlewright.session import written

MAX_RETRIES = 5
BASE_DELAY_SECONDS, MAX_DELAY_SECONDS = 60, 1800


def job_retry_plan(jobs: DataFrame) -> DataFrame:
    """Failed jobs that may run again, with the delay before they do.

    The delay doubles with every retry. A negative count is below the limit like any other and
    halves it further, down to whole seconds: from -6 on there is no delay.
    """
    n = F.col("retry_count")
    delay = F.least(F.lit(BASE_DELAY_SECONDS) * F.pow(F.lit(2.0), n), F.lit(float(MAX_DELAY_SECONDS)))
    return jobs.where((F.col("status") == "failed") & (n < MAX_RETRIES)).withColumn(
        "retry_delay_seconds", delay.cast("bigint")
    ).withColumn("retry_at", F.timestamp_seconds(
        F.unix_seconds("updated_at") + F.col("retry_delay_seconds")))


def job_throughput(jobs: DataFrame, as_of) -> DataFrame:
    """Elapsed and remaining time, records per second and progress by time range."""
    seconds = lambda ts: F.unix_micros(ts) / 1_000_000
    elapsed = F.coalesce(seconds(at(as_of)) - seconds(F.col("created_at")), F.lit(0.0))
    start, end, now = F.col("start_time"), F.col("end_time"), at(as_of)
    running = (F.col("status") == "running") & (F.col("progress") != 0) & (F.col("elapsed_seconds") > 0)
    remaining = F.greatest(
        F.try_divide(F.col("elapsed_seconds") * 100, F.col("progress")) - F.col("elapsed_seconds"),
        F.lit(0.0))
    done = F.unix_micros(now) - F.unix_micros(start)
    whole = F.unix_micros(end) - F.unix_micros(start)
    by_range = (
        F.when(start.isNull() | end.isNull() | (now < start), 0)
        .when((now > end) | (whole <= 0), 100)
        .otherwise(F.greatest(F.least(F.floor(F.try_divide(done * 100, whole)), F.lit(100)), F.lit(0)))
    )
    return jobs.withColumn("elapsed_seconds", elapsed).withColumns({
        "estimated_seconds": F.coalesce(seconds(end) - seconds(start), F.lit(0.0)),
        "remaining_seconds": F.when(running, remaining).otherwise(0.0),
        "records_per_second": F.when(
            (F.col("elapsed_seconds") > 0) & (F.col("records_collected") != 0),
            F.try_divide(F.col("records_collected"), F.col("elapsed_seconds"))).otherwise(0.0),
        "range_progress": by_range.cast("bigint"),
    })


def collection_metrics(jobs: DataFrame) -> DataFrame:
    """Success rate, mean response time and totals of finished jobs."""
    status = F.col("status")
    seconds = (F.unix_micros("updated_at") - F.unix_micros("created_at")) / 1_000_000
    over = status.isin("completed", "failed")
    counted = jobs.agg(
        F.coalesce(F.sum("records_collected"), F.lit(0)).alias("candles_collected"),
        F.count_if(status == "completed").alias("success_count"),
        F.count_if(status == "failed").alias("error_count"),
        F.count_if(error_type(F.col("error_message")) == "rate_limit").alias("rate_limit_hits"),
        F.coalesce(F.avg(F.when(over, seconds)), F.lit(0.0)).alias("avg_response_seconds"))
    done = F.col("success_count") + F.col("error_count")
    return counted.withColumn(
        "success_rate", F.when(done > 0, F.col("success_count") / done).otherwise(0.0))


def error_breakdown(jobs: DataFrame) -> DataFrame:
    """Errors by type: severity, retryability, count, first and last time."""
    kind = error_type(F.col("error_message"))
    return (
        jobs.where(F.coalesce("error_message", F.lit("")) != "")
        .groupBy(kind.alias("error_type"), error_category(F.col("error_message")).alias("category"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("updated_at").alias("first_seen"),
             F.max("updated_at").alias("last_seen"))
        .select("error_type", "category", error_severity(F.col("error_type")).alias("severity"),
                is_retryable(F.col("error_type")).alias("retryable"), "n", "first_seen", "last_seen")
    )


# Legal moves of a job; a retry is legal below the retry limit only.
JOB_STATES = ["pending", "running", "completed", "failed"]
JOB_MOVES = {"start": {"pending": "running"}, "complete": {"running": "completed"}, "fail": {"running": "failed"}}
RETRY = {"retry": {"failed": "pending"}}


def _job_log(jobs: DataFrame, events: DataFrame, most: int = EVENTS_PER_BLOCK) -> DataFrame:
    """Events with the job's status before and after, and whether it was accepted.

    Jobs with at most ``most`` events are replayed with the number of retries left beside the state;
    only the others take :func:`_long_job_log`.
    """
    left = F.lit(MAX_RETRIES).cast("bigint") - F.coalesce("retry_count", F.lit(0))
    short, long, sparse = split_by_length(events, "id", "event_seq", most)
    log = fold_short(short, jobs, "id", "event_seq", JOB_STATES, {**JOB_MOVES, **RETRY}, F.col("status"), limited="retry", left=left)
    if long is None:
        return log
    return log.unionByName(_long_job_log(
        jobs.join(long, "id", "left_semi"), events.join(long, "id", "left_semi").select(*events.columns), sparse))


def _long_job_log(jobs: DataFrame, events: DataFrame, sparse: bool) -> DataFrame:
    """:func:`_job_log` of jobs with many events.

    The retry limit is a counter, not a state. Events are folded as if there were no limit; that
    is right up to the retry that reaches it, which is found by the rank of the accepted
    retries. What comes later is folded again from there without retries. A job at or
    above its limit is folded without retries from the start.
    """
    left = (F.lit(MAX_RETRIES).cast("bigint") - F.coalesce("retry_count", F.lit(0))).alias("_left")
    free = written(fold_long(events, jobs, "id", "event_seq", JOB_STATES, {**JOB_MOVES, **RETRY}, F.col("status"), sparse=sparse),
                   "job-log")
    retries = ranked(free.where(F.col("accepted") & (F.col("event_type") == "retry")).select("id", "event_seq"), ["id"], ["event_seq"],
                     rank_levels("event_seq"), "_place")
    limits = jobs.select("id", "status", left)
    reached = retries.join(limits, "id").where(F.col("_place") == F.col("_left")).select(
        "id", F.col("event_seq").alias("_until"), F.lit("pending").alias("status"))
    never = limits.where("_left <= 0").select("id", F.lit(None).cast("bigint").alias("_until"), "status")
    ends = reached.unionByName(never)
    limited = F.col("_limited").isNotNull()
    marks = ends.select("id", "_until", F.lit(True).alias("_limited"))
    before = free.join(marks, "id", "left").where(~limited | (F.col("event_seq") <= F.col("_until"))).drop("_until", "_limited")
    after = events.join(marks, "id").where(F.col("_until").isNull() | (F.col("event_seq") > F.col("_until"))).select(*events.columns)
    return before.unionByName(fold_events(after, ends, "id", "event_seq", JOB_STATES, JOB_MOVES, F.col("status")))


def apply_job_events(jobs: DataFrame, events: DataFrame):
    """(jobs after all events, rejected events).

    Events: id, event_seq, event_type (start, complete, fail, retry),
    event_time, message. A job may retry while its count, also a negative one of any
    size, is below the limit; a missing count is 0.
    """
    log = _job_log(jobs, events)
    kept = log.where("accepted")
    kind = F.col("event_type")
    latest = kept.groupBy("id").agg(
        F.max_by("state_after", "event_seq").alias("_state"),
        F.count_if(kind == "retry").alias("_retries"),
        F.count_if(kind == "complete").alias("_completed"),
        F.max_by("event_time", "event_seq").alias("_at"),
        # A retry keeps the error for debugging, so it does not count here.
        F.max_by(F.when(kind == "fail", F.col("message")),
                 F.when(kind != "retry", F.col("event_seq"))).alias("_message"),
        F.count_if(kind != "retry").alias("_sets_message"))
    after = jobs.join(latest, "id", "left").withColumns({
        "status": F.coalesce("_state", "status"),
        "retry_count": (F.col("retry_count") + F.coalesce("_retries", F.lit(0))).cast("int"),
        "progress": F.when(F.col("_completed") > 0, 100).otherwise(F.col("progress")),
        "error_message": F.when(F.col("_sets_message") > 0, F.col("_message"))
        .otherwise(F.col("error_message")),
        "updated_at": F.coalesce("_at", "updated_at"),
    }).select(*jobs.columns)
    rejected = log.where(~F.col("accepted")).select(*events.columns, "state_before")
    return after, rejected


def jobs_to_json(jobs: DataFrame) -> DataFrame:
    """Each job as a JSON document."""
    return jobs.select("id", F.to_json(F.struct(*[f for f in JOBS.fieldNames() if f in jobs.columns]))
                       .alias("document"))


def jobs_from_json(documents: DataFrame) -> DataFrame:
    """Jobs from JSON documents; malformed ones give NULL fields."""
    return documents.select(F.from_json("document", JOBS).alias("_j")).select("_j.*")
