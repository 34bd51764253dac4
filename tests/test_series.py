"""Bucketed computations against plain loops, with buckets small enough to carry."""

import datetime as dt
import math
import random

import pytest

from pyspark.sql import functions as F

from candlewright.operators import anomalies, gaps, lifecycle, statefold
from candlewright.operators.series import attach_per_series, ranked, running, transitions

ZERO = dt.datetime(1970, 1, 1)


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def at(seconds):
    return F.timestamp_seconds(seconds)


def test_transitions(spark):
    rng = random.Random(1)
    rows = [(k, t, rng.randint(0, 99)) for k in "ab" for t in rng.sample(range(500), 60)]
    df = frame(spark, rows, "k string, t long, v int")
    got = transitions(df, ["k"], "t", ["v"], F.floor(F.col("t") / 7), include_first=True)
    want = []
    for k in "ab":
        own = sorted(r for r in rows if r[0] == k)
        want += [(*r, *(own[i - 1][1:] if i else (None, None))) for i, r in enumerate(own)]
    assert sorted(map(tuple, got.select("k", "t", "v", "prev_t", "prev_v").collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_transitions_over_levels_of_sparse_numbers(spark, levels):
    rng = random.Random(levels)
    rows = [(k, t, rng.choice([None, *range(9)])) for k in "ab" for t in rng.sample(range(-10**6, 10**6), 90)]
    df = frame(spark, rows, "k string, t long, v int")
    got = transitions(df, ["k"], "t", ["v"], F.floor(F.col("t") / 7), include_first=True, levels=levels, fan=5)
    want = []
    for k in "ab":
        own = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        want += [(*r, *(own[i - 1][1:] if i else (None, None))) for i, r in enumerate(own)]
    assert sorted(map(tuple, got.select("k", "t", "v", "prev_t", "prev_v").collect()), key=str) == sorted(want, key=str)


def test_running(spark):
    rng = random.Random(2)
    rows = [(k, t, rng.randint(-50, 50)) for k in "ab" for t in rng.sample(range(300), 80)]
    df = frame(spark, rows, "k string, t long, v long")
    got = running(df, ["k"], ["t"], {"top": ("max", "v"), "total": ("sum", "v")}, F.floor(F.col("t") / 11))
    want = []
    for k in "ab":
        own = sorted(r for r in rows if r[0] == k)
        for i, r in enumerate(own):
            before = [x[2] for x in own[:i]]
            want.append((k, r[1], max(before) if before else None, sum(before)))
    assert sorted(map(tuple, got.select("k", "t", "top", "total").collect())) == sorted(want)


def test_ranked(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 2), rng.randint(0, 40), i) for i in range(200)]
    df = frame(spark, rows, "p int, t int, i int")
    got = ranked(df, [], [F.desc("p"), F.asc("t"), F.asc("i")],
                 [[(F.col("p"), True), (F.floor(F.col("t") / 9), False)], [(F.col("t"), False)]], "r")
    want = {r[2]: n + 1 for n, r in enumerate(sorted(rows, key=lambda r: (-r[0], r[1], r[2])))}
    assert {r.i: r.r for r in got.collect()} == want


def gap_loop(have, start, end, step):
    """Expected slots walked one by one."""
    out, slot = [], start
    while slot < end:
        if slot in have:
            slot += step
            continue
        stop = slot + step
        while stop < end and stop not in have:
            stop += step
        out.append((slot, stop))
        slot = stop
    return out


def test_gaps_in_range_equals_the_walk(spark):
    rng = random.Random(4)
    step, rows, want = 300, [], []
    series = []
    for n in range(40):
        pair, start = f"p{n}", 6000
        series.append((pair, "5m"))
        have = {t for t in range(3000, 30000, step) if rng.random() < n / 40}
        off = {t + rng.randint(1, 299) for t in have if rng.random() < 0.2}
        rows += [(pair, "5m", t) for t in have | off]
        want += [(pair, *g) for g in gap_loop(have, start, 25100, step)]
    df = frame(spark, rows, "pair string, interval string, t long").select("pair", "interval", at("t").alias("timestamp"))
    names = frame(spark, series, "pair string, interval string")
    got = gaps.gaps_in_range(df, at(F.lit(6000)), at(F.lit(25100)), names, align=False, slots_per_bucket=5)
    flat = got.select("pair", F.unix_seconds("start_time"), F.unix_seconds("end_time"))
    assert sorted(map(tuple, flat.collect())) == sorted(want)
    # Aligned, the range ends at a slot boundary; both ways of listing slots agree and tile it.
    a = gaps.missing_candles(df, at(F.lit(5900)), at(F.lit(25100)), names)
    b = gaps.missing_candles(df, at(F.lit(5900)), at(F.lit(25100)), names, method="grid")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    inside = df.where((F.unix_seconds("timestamp") >= 6000) & (F.unix_seconds("timestamp") < 24900)
                      & (F.unix_seconds("timestamp") % 300 == 0))
    assert a.count() + inside.count() == 40 * (24900 - 6000) // 300
    done = gaps.completeness(df, at(F.lit(5900)), at(F.lit(25100)), names)
    assert done.agg(F.sum("actual")).first()[0] == inside.count()


def test_moving_sums(spark):
    rng = random.Random(5)
    rows = [("p", "1h", t, rng.randint(1, 9)) for t in rng.sample(range(0, 4000), 300)]
    df = frame(spark, rows, "pair string, interval string, t long, v int").select(
        "pair", "interval", at("t").alias("timestamp"), F.col("v").cast("decimal(30,18)").alias("volume"), "t")
    got = anomalies._moving_sums(df, 100).select(F.unix_seconds("timestamp"), "window_sum", "window_n").collect()
    for t, total, n in got:
        inside = [r[3] for r in rows if t - 100 <= r[2] < t]
        assert (float(total or 0), n or 0) == (float(sum(inside)), len(inside))
    assert len(got) == 300


def test_merge_periods(spark):
    rng = random.Random(6)
    rows = [(k, s, s + rng.randint(1, 60)) for k in "ab" for s in rng.sample(range(3000), 60)]
    df = frame(spark, rows, "k string, s long, e long").select(
        "k", at("s").alias("start_time"), at("e").alias("end_time"))
    got = gaps.merge_periods(df, ["k"], bucket_seconds=50)
    want = []
    for k in "ab":
        for _, s, e in sorted(r for r in rows if r[0] == k):
            if want and want[-1][0] == k and s <= want[-1][2]:
                want[-1] = (k, want[-1][1], max(e, want[-1][2]), want[-1][3] + 1)
            else:
                want.append((k, s, e, 1))
    out = got.select("k", F.unix_seconds("start_time"), F.unix_seconds("end_time"), "merged_count")
    assert sorted(map(tuple, out.collect())) == sorted(want)
    again = gaps.merge_periods(got.drop("merged_count"), ["k"], bucket_seconds=50)
    assert again.where("merged_count > 1").count() == 0


def test_match_candles(spark):
    rng = random.Random(7)
    g = [(f"g{i}", s, s + rng.randint(1, 40) * 60) for i, s in enumerate(rng.sample(range(0, 60000, 60), 50))]
    c = rng.sample(range(0, 60000, 60), 400)
    left = frame(spark, g, "id string, s long, e long").select(
        "id", F.lit("p").alias("pair"), F.lit("1m").alias("interval"), at("s").alias("start_time"), at("e").alias("end_time"))
    right = frame(spark, [(t,) for t in c], "t long").select(
        F.lit("p").alias("pair"), F.lit("1m").alias("interval"), at("t").alias("timestamp"))
    for closed in (True, False):
        got = gaps.match_candles(left, right, closed, slots_per_bucket=10)
        want = [(i, t) for i, s, e in g for t in c if s <= t and (t <= e if closed else t < e)]
        assert sorted(map(tuple, got.select("id", F.unix_seconds("timestamp")).collect())) == sorted(want)


def test_fold_equals_a_loop(spark, monkeypatch):
    monkeypatch.setattr(statefold, "BLOCKS_PER_GROUP", 3)
    rng = random.Random(8)
    kinds = [*lifecycle.GAP_MOVES, "nonsense"]
    events = [(f"k{k}", i, rng.choice(kinds + ["start", "fail"] * 3)) for k in range(12) for i in range(k * 9)]
    rng.shuffle(events)
    records = [(f"k{k}", "detected") for k in range(11)]
    ev = frame(spark, events, "id string, n long, event_type string")
    rec = frame(spark, records, "id string, status string")
    for levels in (0, 1, 2):
        got = statefold.fold_events(ev, rec, "id", "n", lifecycle.GAP_STATES, lifecycle.GAP_MOVES,
                                    F.col("status"), per_block=4, levels=levels)
        want, state = [], dict(records)
        for key, n, kind in sorted(events):
            before = state.get(key)
            after = lifecycle.GAP_MOVES.get(kind, {}).get(before, before)
            want.append((key, n, kind, before, after, after != before))
            state[key] = after
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_fold_events_with_sparse_numbers(spark):
    rng = random.Random(7)
    kinds = ["start", "fill", "fail", "permanent"]
    events = [(k, rng.randrange(10**15), rng.choice(kinds)) for k in "ab" for _ in range(40)]
    ev, rec = frame(spark, events, "id string, n long, event_type string"), frame(
        spark, [("a", "detected"), ("b", "filling")], "id string, status string")
    got = statefold.fold_events(ev, rec, "id", "n", lifecycle.GAP_STATES, lifecycle.GAP_MOVES, F.col("status"),
                                per_block=4, sparse=True)
    state, want = {"a": "detected", "b": "filling"}, []
    for key, n, kind in sorted(events):
        before = state[key]
        state[key] = lifecycle.GAP_MOVES[kind].get(before, before)
        want.append((key, n, kind, before, state[key], state[key] != before))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_lookback_blocks(spark):
    df = spark.range(100).select(
        F.lit("p").alias("pair"), F.lit("1h").alias("interval"), at(F.col("id") * 3600).alias("timestamp"),
        (F.col("id") * F.col("id")).cast("decimal(30,18)").alias("close"))
    got = anomalies.lookback_context(df, rows=10, block=7).collect()
    assert len(got) == 100
    for r in got:
        i = int((r.timestamp.replace(tzinfo=None) - ZERO).total_seconds()) // 3600
        near = [float(j * j) for j in range(max(0, i - 10), i)]
        assert r.context_rows == len(near)
        assert not near or abs(r.mean_close - sum(near) / len(near)) < 1e-9


def test_job_events_with_any_negative_count_and_sparse_numbers(spark):
    """Against a loop: counts far below zero, at and above the limit; microseconds as numbers."""
    from candlewright.operators import jobs

    rng, records, events, want, refused = random.Random(8), [], [], {}, set()
    for i in range(60):
        count = rng.choice([-100000, -7, -1, 0, 3, 4, 5, 9, None])
        status, n, at = rng.choice(["pending", "running", "completed", "failed"]), count or 0, 1_700_000_000_000_000
        records.append((f"j{i}", status, count, 10, "old", "2024-01-01 00:00:00"))
        cycle = rng.random() < 0.5
        for k in range(rng.choice([0, 3, 60])):
            at += rng.randrange(1, 10 ** 9)
            kind = ["start", "fail", "retry"][k % 3] if cycle else rng.choice(["start", "fail", "retry", "complete", "odd"])
            events.append((f"j{i}", at, kind, "2024-01-02 00:00:00", f"m{k}"))
            new = {"start": {"pending": "running"}, "complete": {"running": "completed"}, "fail": {"running": "failed"},
                   "retry": {"failed": "pending"} if n < 5 else {}}.get(kind, {}).get(status)
            if new is None:
                refused.add((f"j{i}", at))
            else:
                status, n = new, n + (kind == "retry")
        want[f"j{i}"] = (status, n if count is not None else None)
    table = spark.createDataFrame(records, "id string, status string, retry_count int, progress int, error_message string, updated_at string")
    log = spark.createDataFrame(events, "id string, event_seq long, event_type string, event_time string, message string")
    after, rejected = jobs.apply_job_events(table, log.repartition(4))
    assert {r.id: (r.status, r.retry_count) for r in after.collect()} == want
    assert {(r.id, r.event_seq) for r in rejected.collect()} == refused


def test_job_logs_of_few_and_of_many_events_agree(spark):
    """Jobs replayed at once and jobs folded in blocks give one log, as the loop does; null ids have none."""
    from candlewright.operators import jobs

    rng, records, events, want = random.Random(18), [], [], []
    for i in range(50):
        count, status = rng.choice([-3, 0, 3, 4, 5, None]), rng.choice(["pending", "running", "completed", "failed", "lost"])
        records.append((f"j{i}", status, count))
        n = count or 0
        for k in range(rng.choice([1, 2, 3, 40])):
            kind = rng.choice(["start", "fail", "retry", "retry", "complete", "odd"])
            new = {"start": {"pending": "running"}, "complete": {"running": "completed"}, "fail": {"running": "failed"},
                   "retry": {"failed": "pending"} if n < 5 else {}}.get(kind, {}).get(status)
            known = status != "lost"
            want.append((f"j{i}", k, kind, status if known else None, (new or status) if known else None, new is not None))
            events.append((f"j{i}", k, kind))
            status, n = new or status, n + (new is not None and kind == "retry")
    table = spark.createDataFrame(records, "id string, status string, retry_count int")
    log = spark.createDataFrame([*events, (None, 1, "start"), ("unknown", 1, "start")], "id string, event_seq long, event_type string")
    want.append(("unknown", 1, "start", None, None, False))
    for most in (256, 3, 1):
        got = jobs._job_log(table, log.repartition(4), most)
        assert sorted(map(tuple, got.collect())) == sorted(want), most


def test_jobs_with_few_events_take_few_exchanges(spark):
    """At 0.9 million orders the chain of blocks took seven times as long as a replay of each job."""
    from candlewright.operators import jobs
    from candlewright.plans.fixtures import Fixtures

    fx = Fixtures(spark, "/root/testdata/sf0.001")
    after, _ = jobs.apply_job_events(fx.jobs(), fx.job_events())
    plan = after._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("Exchange") <= 6


def test_gap_statistics_without_gaps(spark):
    """A grid without holes has no success rate: 0 of 0 is NaN, as in the SQL."""
    from candlewright.plans.fixtures import Fixtures

    table = Fixtures(spark, "/root/testdata/sf0.001").gaps().limit(0)
    got = {r.metric: r.value for r in lifecycle.gap_statistics(table).collect()}
    assert math.isnan(got.pop("success_rate"))
    assert got == {"total": 0, "active": 0, "filled": 0, "permanent": 0,
                   "oldest_active_unix": None, "average_gap_seconds": None, "average_fill_seconds": None}


def test_sparse_numbers_are_told_from_dense_ones(spark):
    from candlewright.operators.statefold import is_sparse

    dense = spark.createDataFrame([("a", i) for i in range(2000)], "id string, event_seq long")
    assert not is_sparse(dense, "id", "event_seq") and not is_sparse(dense.limit(0), "id", "event_seq")
    assert is_sparse(dense.selectExpr("id", "event_seq * 1000000 AS event_seq"), "id", "event_seq")


@pytest.mark.parametrize("touching", [True, False])
@pytest.mark.parametrize("longest", [5, 60, 2000])
def test_merge_periods_over_many_buckets_and_without_keys(spark, touching, longest):
    rng = random.Random(longest)
    rows = [(k, s, s + rng.randint(0, longest), rng.randint(0, 9))
            for k in ("a", "", None) for s in (rng.randrange(4000) for _ in range(150))]
    df = frame(spark, rows, "k string, s long, e long, urgency int").select(
        "k", at("s").alias("start_time"), at("e").alias("end_time"), "urgency")
    got = gaps.merge_periods(df, ["k"], touching, 50, ["urgency"], [F.max("urgency").alias("urgency")])
    want = []
    for k in ("a", "", None):
        mine = []
        for _, s, e, u in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3]):
            if mine and (s <= mine[-1][2] if touching else s < mine[-1][2] or s == mine[-1][1]):
                mine[-1] = (k, mine[-1][1], max(e, mine[-1][2]), mine[-1][3] + 1, max(u, mine[-1][4]))
            else:
                mine.append((k, s, e, 1, u))
        want += mine
    out = got.select("k", F.unix_seconds("start_time"), F.unix_seconds("end_time"), "merged_count", "urgency")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_merge_periods_of_an_empty_table(spark):
    df = frame(spark, [], "k string, start_time timestamp, end_time timestamp")
    assert gaps.merge_periods(df, ["k"]).count() == 0


def test_attach_per_series(spark):
    rows = frame(spark, [(k, n, n // 3) for k in ("a", "", None, "z") for n in range(10)], "k string, n int, _bucket long")
    table = frame(spark, [("a", 1), ("", 2), (None, 3)], "k string, v int")
    got = attach_per_series(rows, table, ["k"]).select("k", "n", "v").collect()
    values = {"a": 1, "": 2, None: 3, "z": None}
    assert sorted(map(tuple, got), key=str) == sorted(((k, n, values[k]) for k in values for n in range(10)), key=str)


def test_validate_all_of_rows_without_pair_and_with_equal_times(spark):
    rng = random.Random(12)
    rows = [(pair, "1h", 3600 * rng.randrange(60), tie, f"{rng.choice((5, 40))}")
            for pair in ("A", "", None) for tie in range(40)]
    df = frame(spark, rows, "pair string, interval string, t long, tie int, high string").select(
        "pair", "interval", at("t").alias("timestamp"), "tie", F.lit("5").alias("open"), "high",
        F.lit("5").alias("low"), F.lit("5").alias("close"), F.lit("1").alias("volume"))
    got = anomalies.validate_all(df, ties=["tie"]).select("pair", F.unix_seconds("timestamp"), "type", "value")
    want = []
    for pair in ("A", "", None):
        mine = sorted(r[2:] for r in rows if r[0] == pair)
        steps = [b[0] - a[0] for a, b in zip(mine, mine[1:])]
        usual = min(set(steps), key=lambda s: (-steps.count(s), s)) or 3600
        for a, b in zip(mine, mine[1:]):
            if float(b[2]) > 5 * float(a[2]):
                want.append((pair, b[0], "price_spike", float(b[2]) / float(a[2])))
            if abs(b[0] - a[0] - usual) > 120:
                want.append((pair, b[0], "sequence_gap", (b[0] - a[0] - usual) / 60))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_sequence_of_equal_arrival_numbers(spark):
    """Ticks whose scrambled numbers are equal, in any order of the rows, follow each other by their ids."""
    from candlewright.plans.q_quality import sequence_out_of_order

    class Ticks:
        def __init__(self, table):
            self.table = table

        def ticks(self):
            return self.table

    rng = random.Random(21)
    rows = [(n + 1000003 * c, p, rng.randrange(10 ** 6)) for c in range(6) for n in range(40) for p in ("a", "b")]
    want = {}
    for p in ("a", "b"):
        mine = [t for _, _, t in sorted((r[0] * 7919 % 1000003, r[0], r[2]) for r in rows if r[1] == p)]
        steps = list(zip(mine, mine[1:]))
        want[p] = (sum(b < a or abs(b - a - 3600) > 120 for a, b in steps), sum(b < a for a, b in steps))
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        df = frame(spark, rows, "tick_id long, pair string, t long").select("tick_id", "pair", at("t").alias("ts")).repartition(5)
        assert {r.pair: (r.n, r.out_of_order) for r in sequence_out_of_order(Ticks(df)).collect()} == want
