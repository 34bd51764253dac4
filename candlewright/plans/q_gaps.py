"""Queries: gap detection, gap table and backfill."""

from pyspark.sql import functions as F

from candlewright.operators import backfill, gaps, lifecycle, upsert, validate
from candlewright.plans.catalog import query
from candlewright.plans.fixtures import AS_OF, END, START
from candlewright.plans.sqlparts import AS_OF as NOW
from candlewright.plans.sqlparts import END as SQL_END
from candlewright.plans.sqlparts import START as SQL_START
from candlewright.plans.sqlparts import r6, shifted, unix
from candlewright.schemas import SERIES_KEY

PERIOD = 'pair, "interval", start_time, end_time'
SPAN = [*SERIES_KEY, "start_time", "end_time"]
LENGTH = f"({unix('end_time')} - {unix('start_time')})"


# --- detection -----------------------------------------------------------------

query("gaps_in_range", f"SELECT {PERIOD} FROM periods1", ["periods1"])(
    lambda fx: gaps.gaps_in_range(fx.candles("1h"), START, END))
query("gaps_in_range_5m", f"SELECT {PERIOD} FROM periods5", ["periods5"])(
    lambda fx: gaps.gaps_in_range(fx.candles("5m"), START, END, slots_per_bucket=500))


# The grid starts 20 minutes past the hour, so no hourly candle is on it; on
# 5-minute candles the grid is off by 90 seconds from a boundary only after alignment.
@query("gaps_in_range_aligned", """WITH g AS (SELECT pair, unnest(generate_series(TIMESTAMP '2024-01-03 01:00:00', TIMESTAMP '2024-01-12 16:00:00',
        INTERVAL 1 HOUR)) AS t FROM (SELECT DISTINCT pair FROM c1h)),
      m AS (SELECT pair, t FROM g WHERE NOT EXISTS (SELECT 1 FROM c1h c WHERE c.pair = g.pair AND c."timestamp" = g.t))
    SELECT pair, '1h' AS "interval", min(t) AS start_time, max(t) + INTERVAL 1 HOUR AS end_time
    FROM (SELECT *, t - row_number() OVER (PARTITION BY pair ORDER BY t) * INTERVAL 1 HOUR AS i FROM m) GROUP BY pair, i""", ["c1h"])
def gaps_aligned(fx):
    return gaps.gaps_in_range(fx.candles("1h"), "2024-01-03 00:20:00", "2024-01-12 17:45:00")


@query("gaps_in_range_unaligned", """SELECT pair, "interval", TIMESTAMP '2024-01-03 00:20:00' AS start_time,
      TIMESTAMP '2024-01-12 18:20:00' AS end_time FROM c1h GROUP BY 1, 2""", ["c1h"])
def gaps_unaligned(fx):
    return gaps.gaps_in_range(fx.candles("1h"), "2024-01-03 00:20:00", "2024-01-12 17:45:00", align=False)


@query("gaps_in_sequence", """SELECT pair, "interval", "timestamp" + INTERVAL 5 MINUTE AS start_time, n AS end_time
    FROM (SELECT *, lead("timestamp") OVER (PARTITION BY pair ORDER BY "timestamp") AS n FROM c5m)
    WHERE n > "timestamp" + INTERVAL 5 MINUTE""", ["c5m"])
def gaps_in_sequence(fx):
    return gaps.gaps_in_sequence(fx.candles("5m"), slots_per_bucket=500)


@query("recent_gaps", f"""SELECT pair, "interval", min(t) AS start_time, max(t) + INTERVAL 5 MINUTE AS end_time
    FROM (SELECT pair, '5m' AS "interval", t, t - row_number() OVER (PARTITION BY pair ORDER BY t) * INTERVAL 5 MINUTE AS i
          FROM missing5 WHERE t >= TIMESTAMP '2024-01-20 10:05:00' AND t < TIMESTAMP '2024-01-27 10:00:00') GROUP BY pair, "interval", i""", ["missing5"])
def recent_gaps(fx):
    return gaps.recent_gaps(fx.candles("5m"), "2024-01-27 10:02:00", 7 * 86400)


@query("missing_candles", """SELECT pair, '5m' AS "interval", t AS "timestamp" FROM missing5""", ["missing5"])
def missing_candles(fx):
    return gaps.missing_candles(fx.candles("5m"), START, END)


@query("missing_candles_grid", """SELECT pair, '1h' AS "interval", t AS "timestamp" FROM missing1""", ["missing1"])
def missing_candles_grid(fx):
    return gaps.missing_candles(fx.candles("1h"), START, END, method="grid")


@query("completeness", f"""SELECT pair, '5m' AS "interval", CAST(8640 - coalesce(m, 0) AS BIGINT) AS actual, CAST(8640 AS BIGINT) AS expected,
      {r6('(8640 - coalesce(m, 0)) / 8640')} AS completeness, (8640 - coalesce(m, 0)) / 8640 < 0.999 AS alert
    FROM (SELECT DISTINCT pair FROM c5m) LEFT JOIN (SELECT pair, count(*) AS m FROM missing5 GROUP BY pair) USING (pair)""", ["missing5"])
def completeness(fx):
    return gaps.completeness(fx.candles("5m"), START, END)


_LAST = "TIMESTAMP '2024-01-30 23:58:00'"


@query("gap_period_valid", f"""SELECT {PERIOD}, reason IS NULL AS is_valid, reason FROM (SELECT *, CASE WHEN {LENGTH} < 300 THEN 'gap too short'
      WHEN epoch_us({_LAST}) - epoch_us(end_time) < 300000000 THEN 'gap too recent' END AS reason
    FROM (SELECT pair, "interval", start_time, CASE WHEN {unix('start_time')} // 300 % 5 = 0 THEN start_time + INTERVAL 2 MINUTE ELSE end_time END AS end_time FROM periods5))""", ["periods5"])
def gap_period_valid(fx):
    cut = F.when(F.pmod(fx.gap_number(), F.lit(5)) == 0,
                 F.timestamp_seconds(F.unix_seconds("start_time") + 120)).otherwise(F.col("end_time"))
    return gaps.gap_period_valid(fx.periods("5m").withColumn("end_time", cut), "2024-01-30 23:58:00")


_ALWAYS_PRIORITY = f"""CASE WHEN {LENGTH} > 604800 THEN 3 WHEN {LENGTH} > 86400 THEN 2 WHEN {LENGTH} < 3600 THEN 0 ELSE 1 END"""


@query("new_gaps", f"""SELECT pair || '_1h_' || {unix('start_time')} || '_' || {unix('end_time')} AS id, {PERIOD}, 'detected' AS status,
      {NOW} AS created_at, CAST({_ALWAYS_PRIORITY} AS BIGINT) AS priority, CAST(0 AS BIGINT) AS attempts FROM periods1""", ["periods1"])
def new_gaps(fx):
    return lifecycle.new_gaps(fx.periods("1h"), AS_OF).select(
        "id", *SPAN, "status", "created_at", "priority", "attempts")


@query("detection_result", f"""WITH g AS (SELECT *, {_ALWAYS_PRIORITY} AS priority FROM periods5)
    SELECT 'pairs_scanned' AS metric, NULL::VARCHAR AS label, count(DISTINCT pair) AS value FROM c5m
    UNION ALL SELECT 'intervals_scanned', NULL, 1
    UNION ALL SELECT 'gaps_detected', NULL, count(*) FROM g
    UNION ALL SELECT 'gaps_by_pair', pair, count(*) FROM g GROUP BY pair
    UNION ALL SELECT 'gaps_by_priority', CAST(priority AS VARCHAR), count(*) FROM g GROUP BY priority""", ["periods5", "c5m"])
def detection_result(fx):
    found = lifecycle.new_gaps(fx.periods("5m"), AS_OF)
    return gaps.detection_result(found, gaps.series_of(fx.candles("5m")))


@query("merge_gaps", f"""SELECT pair, "interval", min(start_time) AS start_time, max(end_time) AS end_time, count(*) AS merged_count FROM (
      SELECT *, sum(CASE WHEN reach IS NULL OR start_time > reach THEN 1 ELSE 0 END) OVER (PARTITION BY pair ORDER BY start_time, end_time, id ROWS UNBOUNDED PRECEDING) AS island
      FROM (SELECT *, max(end_time) OVER (PARTITION BY pair ORDER BY start_time, end_time, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM wide_gaps)) GROUP BY pair, "interval", island""", ["wide_gaps"])
def merge_gaps(fx):
    return gaps.merge_periods(fx.wide_gaps(), SERIES_KEY, bucket_seconds=86400)


_ISLANDS = """SELECT *, sum(CASE WHEN reach IS NULL OR start_time > reach THEN 1 ELSE 0 END) OVER (PARTITION BY pair ORDER BY start_time, end_time, id ROWS UNBOUNDED PRECEDING) AS island
    FROM (SELECT *, max(end_time) OVER (PARTITION BY pair ORDER BY start_time, end_time, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM wide_gaps)"""


@query("merge_gap_records", f"""SELECT pair || '_' || "interval" || '_' || CAST(epoch(start_time) AS BIGINT) || '_' || CAST(epoch(end_time) AS BIGINT) AS id, *
    FROM (SELECT pair, "interval", min(start_time) AS start_time, max(end_time) AS end_time,
      CASE WHEN count(*) FILTER (WHERE status = 'filling') > 0 THEN 'filling' ELSE 'detected' END AS status, min(created_at) AS created_at,
      CAST(max(priority) AS BIGINT) AS priority, CAST(max(attempts) AS BIGINT) AS attempts, max(last_attempt_at) AS last_attempt_at,
      count(*) AS merged_count FROM ({_ISLANDS}) GROUP BY pair, "interval", island)""", ["wide_gaps"])
def merge_gap_records(fx):
    return gaps.merge_gap_records(fx.wide_gaps(), bucket_seconds=86400)


@query("overlap_gaps", f"""SELECT id, {PERIOD}, reach AS reached_end FROM (SELECT *, max(end_time) OVER (PARTITION BY pair
      ORDER BY start_time, end_time, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM wide_gaps) WHERE start_time < reach""", ["wide_gaps"])
def overlap_gaps(fx):
    return gaps.overlap_gaps(fx.wide_gaps(), 86400).select("id", *SPAN, "reached_end")


@query("trading_calendar_filter", f"""SELECT {PERIOD} FROM periods5 g WHERE NOT EXISTS
    (SELECT 1 FROM fridays f WHERE g.start_time >= f.start_time AND g.end_time <= f.end_time)""", ["periods5", "fridays"])
def trading_calendar_filter(fx):
    return gaps.trading_calendar_filter(fx.periods("5m"), fx.closed_periods())


@query("trading_calendar_by_exchange", f"""SELECT {PERIOD} FROM (SELECT *, CASE WHEN pair < 'p' THEN 'east' WHEN pair < 's' THEN 'west' END AS exchange FROM periods5) g
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT 'east' AS exchange, * FROM fridays UNION ALL
        SELECT 'west', start_time - INTERVAL 3 DAY, end_time - INTERVAL 4 DAY FROM fridays) f
      WHERE f.exchange = g.exchange AND g.start_time >= f.start_time AND g.end_time <= f.end_time)""", ["periods5", "fridays"])
def trading_calendar_by_exchange(fx):
    """Two calendars; pairs from 's' on have none."""
    exchange = F.when(F.col("pair") < "p", "east").when(F.col("pair") < "s", "west")
    east = fx.closed_periods().select(F.lit("east").alias("exchange"), "start_time", "end_time")
    west = east.select(F.lit("west").alias("exchange"), (F.col("start_time") - F.expr("INTERVAL 3 DAY")).alias("start_time"),
                       (F.col("end_time") - F.expr("INTERVAL 4 DAY")).alias("end_time"))
    return gaps.trading_calendar_filter(fx.periods("5m").withColumn("exchange", exchange), east.unionByName(west)).drop("exchange")


@query("query_with_gap_flags", f"""SELECT g.pair, '5m' AS "interval", g.t AS "timestamp", {r6('c.close')} AS close, {r6('c.volume')} AS volume,
      c.pair IS NULL AS is_missing, CASE WHEN c.pair IS NULL THEN p.status END AS gap_status
    FROM grid5 g LEFT JOIN c5m c ON c.pair = g.pair AND c."timestamp" = g.t
    LEFT JOIN gaps0 p ON p.pair = g.pair AND g.t >= p.start_time AND g.t < p.end_time""", ["grid5", "gaps0"])
def query_with_gap_flags(fx):
    return gaps.query_with_gap_flags(fx.candles("5m"), fx.gaps(), START, END)


@query("candles_in_gap", f"""SELECT g.id, g.pair, g."interval", g.start_time, g.end_time, d."timestamp", {r6('d.close')} AS close, {r6('d.volume')} AS volume
    FROM gaps0 g JOIN donor d ON d.pair = g.pair AND d."timestamp" >= g.start_time AND d."timestamp" <= g.end_time""", ["gaps0", "donor"])
def candles_in_gap(fx):
    return gaps.candles_in_gap(fx.gaps(), fx.donor())


@query("gap_fill_check", f"""SELECT g.id, {', '.join('g.' + c for c in ('pair', '"interval"', 'start_time', 'end_time'))}, {LENGTH} // 300 AS expected, n AS found,
      CASE WHEN n = 0 THEN 'none' WHEN n >= {LENGTH} // 300 THEN 'full' ELSE 'partial' END AS coverage
    FROM gaps0 g JOIN found f USING (id)""", ["found"])
def gap_fill_check(fx):
    return gaps.gap_fill_check(fx.gaps(), fx.donor())


# --- gap table ---------------------------------------------------------------------

_AGE = f"(epoch_us({NOW}) - epoch_us(created_at)) / 1000000"
_MODEL = f"""CAST(CASE WHEN {_AGE} < 3600 AND {LENGTH} < 3600 THEN 0 WHEN {LENGTH} > 604800 OR {_AGE} > 604800 THEN 3
    WHEN {LENGTH} > 86400 OR {_AGE} > 86400 THEN 2 ELSE 1 END AS BIGINT)"""
_MANAGER = f"""CAST(CASE WHEN {_AGE} > 604800 OR {LENGTH} > 86400 THEN 3 WHEN {_AGE} > 86400 OR {LENGTH} > 21600 THEN 2
    WHEN {_AGE} > 3600 THEN 1 ELSE 0 END AS BIGINT)"""
_FRESH = f"""CAST(CASE WHEN {_AGE} < 3600 OR {LENGTH} > 86400 THEN 3 WHEN {_AGE} < 21600 OR {LENGTH} > 21600 THEN 2
    WHEN {_AGE} < 86400 OR {LENGTH} > 3600 THEN 1 ELSE 0 END AS BIGINT)"""


def _rule(name, build, sql):
    query(name, f"SELECT id, {sql} AS priority FROM gaps0", ["gaps0"])(
        lambda fx: fx.gaps().select("id", build(AS_OF).alias("priority")))


_rule("gap_priority", lifecycle.gap_priority, _MODEL)
_rule("gap_priority_manager", lifecycle.manager_priority, _MANAGER)
_rule("gap_priority_freshness", lifecycle.freshness_priority, _FRESH)


@query("reprioritise_gaps", f"""SELECT id, priority AS old_priority, {_MANAGER} AS new_priority FROM gaps0
    WHERE status = 'detected' AND priority <> {_MANAGER}""", ["gaps0"])
def reprioritise_gaps(fx):
    return lifecycle.reprioritise_gaps(fx.gaps(), AS_OF, "manager").select("id", "old_priority", "new_priority")


_OWN = f"""CAST(CASE WHEN {_AGE} > 2592000 OR {LENGTH} > 7200 THEN 3 WHEN {_AGE} > 1296000 OR {LENGTH} > 3600 THEN 2
    WHEN {_AGE} > 600 THEN 1 ELSE 0 END AS BIGINT)"""


@query("reprioritise_gaps_thresholds", f"""SELECT id, priority AS old_priority, {_OWN} AS new_priority FROM gaps0
    WHERE status = 'detected' AND priority <> {_OWN}""", ["gaps0"])
def reprioritise_by_thresholds(fx):
    return lifecycle.reprioritise_gaps(
        fx.gaps(), AS_OF, "manager", critical_age=2592000, critical_length=7200, high_age=1296000, high_length=3600,
        recent=600).select("id", "old_priority", "new_priority")


@query("validate_gaps", """SELECT source_id, CASE WHEN id = '' THEN 'gap ID cannot be empty' WHEN pair = '' THEN 'gap pair cannot be empty'
      WHEN "interval" = '' THEN 'gap interval cannot be empty' WHEN start_time IS NULL THEN 'gap start time cannot be zero'
      WHEN end_time IS NULL THEN 'gap end time cannot be zero' WHEN end_time <= start_time THEN 'gap end time must be after start time'
      WHEN status NOT IN ('detected', 'filling', 'filled', 'permanent') THEN 'invalid gap status: ' || status
      WHEN status = 'filled' AND filled_at IS NULL THEN 'filled gaps must have a filled_at timestamp'
      WHEN status <> 'filled' AND filled_at IS NOT NULL THEN 'only filled gaps can have a filled_at timestamp' END AS error FROM broken_gaps""", ["broken_gaps"])
def validate_gaps(fx):
    return validate.validate_gaps(fx.broken_gaps()).select("source_id", "error")


@query("gap_ignorable", """SELECT id, reason IS NOT NULL AS ignore, reason AS ignore_reason FROM (SELECT id, CASE WHEN attempts >= 5 THEN 'max retry attempts exceeded'
      WHEN epoch(TIMESTAMP '2024-03-10') - epoch(created_at) > 2592000 THEN 'gap too old' END AS reason FROM gaps0)""", ["gaps0"])
def gap_ignorable(fx):
    return gaps.gap_ignorable(fx.gaps(), "2024-03-10 00:00:00").select("id", "ignore", "ignore_reason")


@query("gap_flags", f"""SELECT id, status IN ('detected', 'filling') AS is_active, status = 'detected' AS can_fill, status = 'filled' AS is_filled,
      status = 'permanent' AS is_permanent, status = 'filling' AS in_progress, {LENGTH} AS duration_seconds,
      {unix(NOW)} - {unix('created_at')} AS age_seconds, coalesce({unix(NOW)} - {unix('last_attempt_at')}, 0) AS since_last_attempt_seconds,
      ['low', 'medium', 'high', 'critical'][priority + 1] AS priority_name FROM gaps0""", ["gaps0"])
def gap_flags(fx):
    return lifecycle.gap_flags(fx.gaps(), AS_OF).select(
        "id", "is_active", "can_fill", "is_filled", "is_permanent", "in_progress", "duration_seconds",
        "age_seconds", "since_last_attempt_seconds", "priority_name")


@query("expected_candles", f"SELECT id, greatest(1, {LENGTH} // 300) AS expected_candles FROM gaps0", ["gaps0"])
def expected_candles(fx):
    return lifecycle.expected_candles(fx.gaps()).select("id", "expected_candles")


_RETRY = f"""status = 'detected' AND attempts < 5 AND (last_attempt_at IS NULL OR epoch_us({NOW}) - epoch_us(last_attempt_at) >= 3600000000)"""


@query("retryable_gaps", f"SELECT id, attempts FROM gaps0 WHERE {_RETRY}", ["gaps0"])
def retryable_gaps(fx):
    return lifecycle.retryable_gaps(fx.gaps(), AS_OF).select("id", "attempts")


@query("retryable_gaps_failed", f"SELECT id, attempts FROM gaps0 WHERE {_RETRY} AND attempts > 0 AND error_message <> ''", ["gaps0"])
def retryable_failed(fx):
    return lifecycle.retryable_gaps(fx.gaps(), AS_OF, failed_only=True).select("id", "attempts")


_FILL_ORDER = "priority DESC, created_at, start_time, id"


@query("gap_rank", f"SELECT id, row_number() OVER (ORDER BY {_FILL_ORDER}) AS fill_rank FROM gaps0", ["gaps0"])
def gap_rank(fx):
    return lifecycle.gap_rank(fx.gaps()).select("id", "fill_rank")


@query("gap_rank_by_series", f"""SELECT id, row_number() OVER (PARTITION BY pair, "interval" ORDER BY {_FILL_ORDER}) AS fill_rank FROM gaps0""", ["gaps0"])
def gap_rank_by_series(fx):
    return lifecycle.gap_rank(fx.gaps(), SERIES_KEY).select("id", "fill_rank")


@query("fillable_gaps", f"""SELECT id, row_number() OVER (ORDER BY {_FILL_ORDER}) AS fill_rank FROM gaps0 WHERE status = 'detected'""", ["gaps0"])
def fillable_gaps(fx):
    return lifecycle.fillable_gaps(fx.gaps()).select("id", "fill_rank")


@query("priority_gaps", f"SELECT id, priority FROM gaps0 WHERE status = 'detected' ORDER BY {_FILL_ORDER} LIMIT 20", ["gaps0"])
def priority_gaps(fx):
    return lifecycle.priority_gaps(fx.gaps(), 20).select("id", "priority")


_GAP = f"id, {PERIOD}, status, created_at, filled_at, priority, attempts, last_attempt_at, error_message"
_GAP_COLUMNS = ["id", *SPAN, "status", "created_at", "filled_at", "priority", "attempts",
                "last_attempt_at", "error_message"]


@query("get_gaps", f"""SELECT {_GAP} FROM gaps0 WHERE pair = 'click' AND "interval" = '5m'""", ["gaps0"])
def get_gaps(fx):
    return lifecycle.get_gaps(fx.gaps(), "click", "5m").select(*_GAP_COLUMNS)


@query("gaps_by_status", f"SELECT {_GAP} FROM gaps0 WHERE status = 'filling'", ["gaps0"])
def gaps_by_status(fx):
    return lifecycle.gaps_by_status(fx.gaps(), "filling").select(*_GAP_COLUMNS)


@query("gap_by_id", f"SELECT {_GAP} FROM gaps0 WHERE id = 'view_5m_1704067200_1704067500'", ["gaps0"])
def gap_by_id(fx):
    return lifecycle.gap_by_id(fx.gaps(), "view_5m_1704067200_1704067500").select(*_GAP_COLUMNS)


# --- events: the twin unrolls the three possible steps ------------------------------

_KINDS = "['start', 'start', 'fill', 'fail', 'permanent']"


def _step(state, event):
    return (f"CASE WHEN {event} = 'start' AND {state} = 'detected' THEN 'filling' WHEN {event} = 'fill' AND {state} = 'filling' THEN 'filled' "
            f"WHEN {event} = 'fail' AND {state} = 'filling' THEN 'detected' WHEN {event} = 'permanent' AND {state} = 'detected' THEN 'permanent' ELSE {state} END")


_UNROLLED = f"""e AS (SELECT *, {_KINDS}[h % 5 + 1] AS e0, CASE WHEN h % 3 >= 1 THEN {_KINDS}[(h + 1) % 5 + 1] END AS e1,
      CASE WHEN h % 3 >= 2 THEN {_KINDS}[(h + 2) % 5 + 1] END AS e2, status AS s0 FROM gaps0),
    f AS (SELECT *, {_step('s0', 'e0')} AS s1 FROM e), f2 AS (SELECT *, {_step('s1', 'e1')} AS s2 FROM f), f3 AS (SELECT *, {_step('s2', 'e2')} AS s3 FROM f2)"""


def _accepted(n, *kinds):
    test = f"s{n} <> s{n + 1}"
    return test if not kinds else f"({test} AND e{n} IN ({', '.join(repr(k) for k in kinds)}))"


def _last_time(kind, fallback):
    whens = " ".join(f"WHEN {_accepted(n, kind)} THEN {NOW} + to_seconds({(n + 1) * 60})" for n in (2, 1, 0))
    return f"CASE {whens} ELSE {fallback} END"


_LAST_MESSAGE = "CASE " + " ".join(
    f"WHEN {_accepted(n, 'fail', 'permanent')} THEN 'note {n}' WHEN {_accepted(n)} THEN NULL" for n in (2, 1, 0)) + " ELSE error_message END"


@query("apply_gap_events", f"""WITH {_UNROLLED} SELECT id, s3 AS status, attempts + """
       + " + ".join(f"CASE WHEN {_accepted(n, 'start')} THEN 1 ELSE 0 END" for n in range(3))
       + f""" AS attempts, {_last_time('start', 'last_attempt_at')} AS last_attempt_at, {_last_time('fill', 'filled_at')} AS filled_at,
      {_LAST_MESSAGE} AS error_message FROM f3""", ["gaps0"])
def apply_gap_events(fx):
    after, _ = lifecycle.apply_gap_events(fx.gaps(), fx.gap_events())
    return after.select("id", "status", "attempts", "last_attempt_at", "filled_at", "error_message")


@query("apply_gap_events_rejected", f"WITH {_UNROLLED} " + " UNION ALL ".join(
    f"SELECT id, CAST({n + 1} AS BIGINT) AS event_seq, e{n} AS event_type, s{n} AS state_before FROM f3 WHERE e{n} IS NOT NULL AND s{n} = s{n + 1}"
    for n in range(3)), ["gaps0"])
def apply_gap_events_rejected(fx):
    _, rejected = lifecycle.apply_gap_events(fx.gaps(), fx.gap_events())
    return rejected.select("id", "event_seq", "event_type", "state_before")


@query("gap_statistics", f"""SELECT 'total' AS metric, NULL::VARCHAR AS label, CAST(count(*) AS DOUBLE) AS value FROM gaps0
    UNION ALL SELECT 'active', NULL, count(*) FILTER (WHERE status IN ('detected', 'filling')) FROM gaps0
    UNION ALL SELECT 'filled', NULL, count(*) FILTER (WHERE status = 'filled') FROM gaps0
    UNION ALL SELECT 'permanent', NULL, count(*) FILTER (WHERE status = 'permanent') FROM gaps0
    UNION ALL SELECT 'success_rate', NULL, {r6("count(*) FILTER (WHERE status = 'filled') / count(*) * 100")} FROM gaps0
    UNION ALL SELECT 'oldest_active_unix', NULL, epoch(min(created_at) FILTER (WHERE status IN ('detected', 'filling'))) FROM gaps0
    UNION ALL SELECT 'average_gap_seconds', NULL, {r6(f'avg({LENGTH})')} FROM gaps0
    UNION ALL SELECT 'average_fill_seconds', NULL, {r6(f"avg({unix('filled_at')} - {unix('created_at')})")} FROM gaps0
    UNION ALL SELECT 'by_status', status, count(*) FROM gaps0 GROUP BY status
    UNION ALL SELECT 'by_priority', CAST(priority AS VARCHAR), count(*) FROM gaps0 WHERE status IN ('detected', 'filling') GROUP BY priority
    UNION ALL SELECT 'by_pair', pair, count(*) FROM gaps0 WHERE status IN ('detected', 'filling') GROUP BY pair""", ["gaps0"])
def gap_statistics(fx):
    return lifecycle.gap_statistics(fx.gaps())


@query("cleanup_gaps", f"""SELECT id, status FROM gaps0 WHERE NOT (status = 'filled' AND coalesce(filled_at < {NOW} - INTERVAL 5 DAY, false))""", ["gaps0"])
def cleanup_gaps(fx):
    return lifecycle.cleanup_gaps(fx.gaps(), AS_OF, 5 * 86400)[0].select("id", "status")


@query("cleanup_gaps_dropped", f"""SELECT id, filled_at FROM gaps0 WHERE status = 'filled' AND filled_at < {NOW} - INTERVAL 5 DAY""", ["gaps0"])
def cleanup_gaps_dropped(fx):
    return lifecycle.cleanup_gaps(fx.gaps(), AS_OF, 5 * 86400)[1].select("id", "filled_at")


def _updates(fx):
    """Every fourth gap again, marked permanent and recorded a minute later."""
    return fx.gaps().where(F.pmod(fx.gap_number(), F.lit(4)) == 0).withColumns({
        "status": F.lit("permanent"),
        "created_at": F.timestamp_seconds(F.unix_seconds("created_at") + 60)})


@query("upsert_gaps", f"""SELECT id, CASE WHEN h % 4 = 0 THEN 'permanent' ELSE status END AS status,
      CASE WHEN h % 4 = 0 THEN {shifted('created_at', 60)} ELSE created_at END AS created_at FROM gaps0""", ["gaps0"])
def upsert_gaps(fx):
    return upsert.upsert_gaps(fx.gaps(), _updates(fx)).select("id", "status", "created_at")


def _deletions(fx):
    """Ids of every third gap, and as many that do not exist."""
    third = fx.gaps().where(F.pmod(fx.gap_number(), F.lit(3)) == 0).select("id")
    return third.unionByName(third.select(F.concat("id", F.lit("_x")).alias("id")))


@query("delete_gaps", "SELECT id, status FROM gaps0 WHERE h % 3 <> 0", ["gaps0"])
def delete_gaps(fx):
    return upsert.delete_gaps(fx.gaps(), _deletions(fx))[0].select("id", "status")


@query("delete_gaps_missing", "SELECT id || '_x' AS id FROM gaps0 WHERE h % 3 = 0", ["gaps0"])
def delete_gaps_missing(fx):
    return upsert.delete_gaps(fx.gaps(), _deletions(fx))[1]


# --- backfill ----------------------------------------------------------------------

@query("backfill_plan", f"""SELECT id, i AS chunk_no, {shifted('start_time', 'i * 900')} AS chunk_start,
      least({shifted('start_time', '(i + 1) * 900')}, end_time) AS chunk_end,
      least(3, {LENGTH} // 300 - i * 3) AS candles
    FROM (SELECT *, unnest(generate_series(0, ({LENGTH} + 899) // 900 - 1)) AS i FROM gaps0)""", ["gaps0"])
def backfill_plan(fx):
    return backfill.backfill_plan(fx.gaps(), 3).select("id", "chunk_no", "chunk_start", "chunk_end", "candles")


@query("backfill_plan_range", f"""SELECT pair, "interval", i AS chunk_no, {shifted(SQL_START, 'i * 90000')} AS chunk_start,
      least({shifted(SQL_START, '(i + 1) * 90000')}, {SQL_END}) AS chunk_end
    FROM (SELECT pair, "interval", unnest(generate_series(0, 28)) AS i FROM (SELECT DISTINCT pair, "interval" FROM c5m))""", ["c5m"])
def backfill_plan_range(fx):
    whole = gaps.series_of(fx.candles("5m")).withColumns({
        "start_time": F.lit(START).cast("timestamp"), "end_time": F.lit(END).cast("timestamp")})
    return backfill.backfill_plan(whole).select(*SERIES_KEY, "chunk_no", "chunk_start", "chunk_end")


_APPLIED = f"""SELECT g.*, n, g.status = 'detected' AS was_tried, CASE WHEN g.status <> 'detected' THEN g.status WHEN n > 0 THEN 'filled'
    WHEN g.attempts + 1 >= 4 THEN 'permanent' ELSE 'detected' END AS new_status FROM gaps0 g JOIN found USING (id)"""


@query("backfill_apply", f"""SELECT id, new_status AS status, CASE WHEN was_tried AND n > 0 THEN {NOW} ELSE filled_at END AS filled_at,
      attempts + CASE WHEN was_tried THEN 1 ELSE 0 END AS attempts, CASE WHEN was_tried THEN {NOW} ELSE last_attempt_at END AS last_attempt_at,
      CASE WHEN was_tried AND n > 0 THEN NULL WHEN was_tried THEN 'no data available for gap period' ELSE error_message END AS error_message,
      CASE WHEN was_tried THEN n ELSE 0 END AS candles_found FROM ({_APPLIED})""", ["found"])
def backfill_apply(fx):
    after, _ = backfill.backfill_apply(fx.gaps(), fx.donor(), AS_OF, permanent_after=4)
    return after.select("id", "status", "filled_at", "attempts", "last_attempt_at", "error_message", "candles_found")


@query("backfill_apply_candles", f"""SELECT g.id AS gap_id, d.pair, d."interval", d."timestamp", {r6('d.close')} AS close FROM gaps0 g JOIN donor d
      ON d.pair = g.pair AND d."timestamp" >= g.start_time AND d."timestamp" < g.end_time WHERE g.status = 'detected'""", ["gaps0", "donor"])
def backfill_candles(fx):
    _, found = backfill.backfill_apply(fx.gaps(), fx.donor(), AS_OF)
    return found.select("gap_id", *SERIES_KEY, "timestamp", "close")


_N = "CAST(count(*) FILTER (WHERE %s) AS BIGINT)"


@query("backfill_result", f"""SELECT {_N % 'was_tried'} AS gaps_processed, {_N % "was_tried AND new_status = 'filled'"} AS gaps_filled,
      {_N % "was_tried AND new_status <> 'filled'"} AS gaps_failed, {_N % "was_tried AND new_status = 'permanent'"} AS gaps_marked_permanent,
      CAST(coalesce(sum(n) FILTER (WHERE was_tried), 0) AS BIGINT) AS candles_retrieved FROM ({_APPLIED})""", ["found"])
def backfill_result(fx):
    after, _ = backfill.backfill_apply(fx.gaps(), fx.donor(), AS_OF, permanent_after=4)
    return backfill.backfill_result(after)


@query("backfill_progress", f"""SELECT active_gaps, queued_gaps, completed_gaps, failed_gaps,
      {r6('CASE WHEN completed_gaps + failed_gaps > 0 THEN completed_gaps / (completed_gaps + failed_gaps) * 100 ELSE 0 END')} AS success_rate
    FROM (SELECT {_N % "status = 'filling'"} AS active_gaps, {_N % "status = 'detected'"} AS queued_gaps, {_N % "status = 'filled'"} AS completed_gaps,
      {_N % "status = 'detected' AND attempts > 0 AND error_message IS NOT NULL"} AS failed_gaps FROM gaps0)""", ["gaps0"])
def backfill_progress(fx):
    return backfill.backfill_progress(fx.gaps())
