"""Queries: the job ledger."""

from pyspark.sql import functions as F

from candlewright.functions.errors import CATEGORIES, NOT_RETRYABLE, PATTERNS, TYPE_SEVERITY
from candlewright.functions.intervals import JOB_INTERVALS
from candlewright.operators import jobs, validate
from candlewright.plans.catalog import query
from candlewright.plans.fixtures import JOBS_AS_OF
from candlewright.plans.sqlparts import JOBS_AS_OF as NOW
from candlewright.plans.sqlparts import r6

_T = ", ".join(f"'{i}'" for i in JOB_INTERVALS)
_RULES = [
    ("ID", "id = ''"), ("Pair", "pair = ''"), ("Interval", "\"interval\" = ''"),
    ("Type", "type NOT IN ('initial_sync', 'update', 'backfill')"),
    ("Status", "status NOT IN ('pending', 'running', 'completed', 'failed')"),
    ("StartTime", "start_time IS NULL"), ("EndTime", "end_time IS NULL"),
    ("StartTime", "start_time > end_time"), ("Progress", "progress < 0 OR progress > 100"),
    ("RecordsCollected", "records_collected < 0"), ("RetryCount", "retry_count < 0"),
    ("Interval", f'"interval" NOT IN ({_T})'),
]


@query("validate_jobs", "SELECT id, concat_ws(',', " + ", ".join(
    f"CASE WHEN {c} THEN '{f}' END" for f, c in _RULES) + ") AS fields FROM jobs0", ["jobs0"])
def validate_jobs(fx):
    return validate.validate_jobs(fx.jobs()).select(
        "id", F.array_join("errors.field", ",").alias("fields"))


_DELAY = "CAST(trunc(least(60 * pow(2.0::DOUBLE, retry_count), 1800)) AS BIGINT)"


@query("job_retry_plan", f"""SELECT id, retry_count, {_DELAY} AS retry_delay_seconds, updated_at + to_seconds({_DELAY}) AS retry_at
    FROM jobs0 WHERE status = 'failed' AND retry_count < 5""", ["jobs0"])
def job_retry_plan(fx):
    return jobs.job_retry_plan(fx.jobs()).select("id", "retry_count", "retry_delay_seconds", "retry_at")


_E = f"(CAST(epoch_us({NOW}) - epoch_us(created_at) AS DOUBLE) / 1000000)"


@query("job_throughput", f"""SELECT id, {r6(_E)} AS elapsed_seconds,
      {r6("coalesce(CAST(epoch_us(end_time) - epoch_us(start_time) AS DOUBLE) / 1000000, 0)")} AS estimated_seconds,
      round(CASE WHEN status = 'running' AND progress <> 0 AND {_E} > 0 THEN greatest({_E} * 100 / progress - {_E}, 0) ELSE 0 END, 3) AS remaining_seconds,
      {r6(f"CASE WHEN {_E} > 0 AND records_collected <> 0 THEN records_collected / {_E} ELSE 0 END")} AS records_per_second,
      CAST(CASE WHEN start_time IS NULL OR end_time IS NULL OR {NOW} < start_time THEN 0 WHEN {NOW} > end_time OR end_time <= start_time THEN 100
        ELSE floor((epoch_us({NOW}) - epoch_us(start_time)) * 100 / (epoch_us(end_time) - epoch_us(start_time))) END AS BIGINT) AS range_progress
    FROM jobs0""", ["jobs0"])
def job_throughput(fx):
    return jobs.job_throughput(fx.jobs(), JOBS_AS_OF).select(
        "id", "elapsed_seconds", "estimated_seconds",
        F.round("remaining_seconds", 3).alias("remaining_seconds"), "records_per_second", "range_progress")


_ANY = lambda needles: " OR ".join(f"contains(m, '{n}')" for n in needles)
_TYPE = "CASE " + " ".join(f"WHEN {_ANY(n)} THEN '{k}'" for k, n in PATTERNS.items()) + " ELSE 'unknown' END"
_CATEGORY = "CASE " + " ".join(f"WHEN {_ANY(n)} THEN '{k}'" for k, n in CATEGORIES.items()) + " ELSE 'unknown' END"


@query("error_breakdown", f"""SELECT error_type, category, CASE """ + " ".join(
    f"WHEN error_type = '{k}' THEN '{s}'" for k, s in TYPE_SEVERITY.items()) + f""" ELSE 'medium' END AS severity,
      error_type NOT IN ({', '.join(repr(k) for k in NOT_RETRYABLE)}) AS retryable, count(*) AS n, min(updated_at) AS first_seen, max(updated_at) AS last_seen
    FROM (SELECT *, {_TYPE} AS error_type, {_CATEGORY} AS category FROM (SELECT *, lower(error_message) AS m FROM jobs0 WHERE error_message <> ''))
    GROUP BY error_type, category""", ["jobs0"])
def error_breakdown(fx):
    return jobs.error_breakdown(fx.jobs())


@query("collection_metrics", f"""SELECT CAST(sum(records_collected) AS BIGINT) AS candles_collected,
      CAST(count(*) FILTER (WHERE status = 'completed') AS BIGINT) AS success_count, CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS error_count,
      CAST(count(*) FILTER (WHERE {_TYPE} = 'rate_limit') AS BIGINT) AS rate_limit_hits,
      {r6("avg(CASE WHEN status IN ('completed', 'failed') THEN CAST(epoch_us(updated_at) - epoch_us(created_at) AS DOUBLE) / 1000000 END)")} AS avg_response_seconds,
      {r6("count(*) FILTER (WHERE status = 'completed') / count(*) FILTER (WHERE status IN ('completed', 'failed'))")} AS success_rate
    FROM (SELECT *, lower(error_message) AS m FROM jobs0)""", ["jobs0"])
def collection_metrics(fx):
    return jobs.collection_metrics(fx.jobs())


# --- events: the twin unrolls the three possible steps --------------------------------

_KINDS = "['start', 'fail', 'retry', 'complete', 'start']"


def _next(n):
    s, e, r = f"s{n}", f"e{n}", f"r{n}"
    state = (f"CASE WHEN {e} = 'start' AND {s} = 'pending' THEN 'running' WHEN {e} = 'complete' AND {s} = 'running' THEN 'completed' "
             f"WHEN {e} = 'fail' AND {s} = 'running' THEN 'failed' WHEN {e} = 'retry' AND {s} = 'failed' AND {r} < 5 THEN 'pending' ELSE {s} END")
    return f"{state} AS s{n + 1}, CASE WHEN {e} = 'retry' AND {s} = 'failed' AND {r} < 5 THEN {r} + 1 ELSE {r} END AS r{n + 1}"


_UNROLLED = f"""e AS (SELECT *, {_KINDS}[(k * 7) % 5 + 1] AS e0, CASE WHEN k % 3 >= 1 THEN {_KINDS}[(k * 7 + 1) % 5 + 1] END AS e1,
      CASE WHEN k % 3 >= 2 THEN {_KINDS}[(k * 7 + 2) % 5 + 1] END AS e2, status AS s0, retry_count AS r0 FROM jobs0),
    f AS (SELECT *, {_next(0)} FROM e), f2 AS (SELECT *, {_next(1)} FROM f), f3 AS (SELECT *, {_next(2)} FROM f2)"""
_MESSAGE = "CASE " + " ".join(
    f"WHEN s{n} <> s{n + 1} AND e{n} = 'fail' THEN 'note {n}' WHEN s{n} <> s{n + 1} AND e{n} <> 'retry' THEN NULL"
    for n in (2, 1, 0)) + " ELSE error_message END"
_WHEN = "CASE " + " ".join(
    f"WHEN s{n} <> s{n + 1} THEN {NOW} + to_seconds({(n + 1) * 60})" for n in (2, 1, 0)) + " ELSE updated_at END"


@query("apply_job_events", f"""WITH {_UNROLLED} SELECT id, s3 AS status, retry_count + (r3 - r0) AS retry_count,
      CASE WHEN s3 = 'completed' AND s0 <> 'completed' THEN 100 ELSE progress END AS progress, {_MESSAGE} AS error_message, {_WHEN} AS updated_at FROM f3""", ["jobs0"])
def apply_job_events(fx):
    after, _ = jobs.apply_job_events(fx.jobs(), fx.job_events())
    return after.select("id", "status", "retry_count", "progress", "error_message", "updated_at")


@query("apply_job_events_rejected", f"WITH {_UNROLLED} " + " UNION ALL ".join(
    f"SELECT id, CAST({n + 1} AS BIGINT) AS event_seq, e{n} AS event_type FROM f3 WHERE e{n} IS NOT NULL AND s{n} = s{n + 1}"
    for n in range(3)), ["jobs0"])
def apply_job_events_rejected(fx):
    _, rejected = jobs.apply_job_events(fx.jobs(), fx.job_events())
    return rejected.select("id", "event_seq", "event_type")


@query("job_documents", """SELECT id, type, pair, "interval", start_time, end_time, status, progress, records_collected, error_message,
    retry_count, created_at, updated_at FROM jobs0""", ["jobs0"])
def job_documents(fx):
    return jobs.jobs_from_json(jobs.jobs_to_json(fx.jobs()))
