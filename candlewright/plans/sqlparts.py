"""Shared sub-queries of the SQL twins.

They derive the same inputs as ``fixtures`` straight from the given tables and
use other methods than the library where there is a choice: gaps come from a
generated grid and islands, folds are unrolled, carries are plain windows.
"""

START, END, AS_OF = (f"TIMESTAMP '{t}'" for t in (
    "2024-01-01 00:00:00", "2024-01-31 00:00:00", "2024-02-15 00:00:00"))
JOBS_AS_OF = "TIMESTAMP '2001-06-01 00:00:00'"

NUMERIC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def unix(c):
    return f"CAST(epoch({c}) AS BIGINT)"


def shifted(c, seconds):
    return f"({c} + to_seconds({seconds}))"


def r6(expr):
    return f"round(CAST({expr} AS DOUBLE), 6)"


def plain(expr):
    return rf"regexp_replace(CAST(CAST({expr} AS DECIMAL(30,18)) AS VARCHAR), '\.?0+$', '')"


def parsed(c):
    return f"CASE WHEN regexp_matches({c}, '{NUMERIC}') THEN TRY_CAST({c} AS DECIMAL(30,18)) END"


def text8(expr):
    return f"CAST(CAST({expr} AS DECIMAL(18,8)) AS VARCHAR)"


def ohlcv(alias=""):
    p = f"{alias}." if alias else ""
    return ", ".join(f'{r6(p + c)} AS {c}' for c in ("open", "high", "low", "close", "volume"))


def _candles(name, interval, width):
    return f"""SELECT pair, '{interval}' AS "interval", time_bucket(INTERVAL {width}, ts) AS "timestamp",
        arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low,
        arg_max(price, (ts, event_id)) AS close, sum(price) AS volume
      FROM ticks GROUP BY 1, 3"""


_ORDER_D = "(ts, l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_STATUS = """CASE WHEN h % 7 = 4 THEN 'filling' WHEN h % 7 = 5 THEN 'filled'
        WHEN h % 7 = 6 THEN 'permanent' ELSE 'detected' END"""


def _load(where, close, seq):
    return f"""SELECT pair, "interval", "timestamp", open, high, low, {close} AS close, volume,
        {AS_OF} AS created_at, {seq} AS load_seq FROM c1h WHERE {where}"""


_HOUR = "(" + unix('"timestamp"') + " // 3600)"
_DOUBLED = f"CASE WHEN {_HOUR} % 3 = 0 THEN close * 2 ELSE close END"

_dirty_open = (
    f"CASE WHEN k = 1 THEN '-' || {text8('open')} WHEN k = 3 THEN 'not-a-number' "
    f"WHEN k = 6 THEN ' ' || {text8('open')} || ' ' ELSE {text8('open')} END")

_FIELDS = ["open", "high", "low", "close", "volume"]


def _logic_rules():
    short = lambda c: f"substr({plain(c)}, 1, 8)"
    yield ("high_validation", "high < greatest(open, close)", "high",
           f"'High (' || {short('high')} || ') is less than max of Open (' || {short('open')} "
           f"|| ') and Close (' || {short('close')} || ')'")
    yield ("low_validation", "low > least(open, close)", "low",
           f"'Low (' || {short('low')} || ') is greater than min of Open (' || {short('open')} "
           f"|| ') and Close (' || {short('close')} || ')'")
    for f in _FIELDS[:4]:
        yield ("positive_price", f"{f} <= 0", f,
               f"'{f.capitalize()} price must be positive, got: ' || {plain(f)}")
    yield ("non_negative_volume", "volume < 0", "volume",
           f"'Volume must be non-negative, got: ' || {plain('volume')}")


def _logic_sql():
    return "\nUNION ALL ".join(
        f"""SELECT slot_pair, slot_time, pair, "interval", "timestamp", '{rule}' AS rule,
        '{rule}: ' || {text} AS description, CAST({value} AS DOUBLE) AS value
        FROM typed WHERE {broken}""" for rule, broken, value, text in _logic_rules())


_ERRORS = ["connection refused by host", "request timeout", "rate limit reached", "unauthorized key",
           "validation failed", "missing required field", "internal server trouble",
           "panic in worker", "context canceled by caller", "something odd", "DNS lookup failed",
           "Too Many Requests"]
_LIST = lambda values, i: "[" + ", ".join(f"'{v}'" for v in values) + f"][{i} + 1]"

PARTS = {
    "ticks": ([], """SELECT event_id, ts, event_type AS pair, CAST(value AS DECIMAL(18,8)) AS price
      FROM events"""),
    "c1h": (["ticks"], _candles("c1h", "1h", "1 HOUR")),
    "c5m": (["ticks"], _candles("c5m", "5m", "5 MINUTE")),
    "ticks_d": ([], """SELECT l_returnflag || '-' || l_linestatus AS pair, l_shipdate AS ts,
        CAST(l_extendedprice AS DECIMAL(18,8)) AS price, CAST(l_quantity AS DECIMAL(18,8)) AS size,
        l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem"""),
    "c1d": (["ticks_d"], f"""SELECT pair, '1d' AS "interval", date_trunc('day', ts) AS "timestamp",
        arg_min(price, {_ORDER_D}) AS open, max(price) AS high, min(price) AS low,
        arg_max(price, {_ORDER_D}) AS close, sum(size) AS volume FROM ticks_d GROUP BY 1, 3"""),
    "dirty": (["c1h"], f"""SELECT pair AS slot_pair, "timestamp" AS slot_time,
        CASE WHEN k = 5 THEN '' ELSE pair END AS pair, "interval",
        CASE WHEN k <> 4 THEN "timestamp" END AS "timestamp",
        {_dirty_open} AS open,
        CASE WHEN k = 0 THEN {text8('open * 0.5')} ELSE {text8('high')} END AS high,
        {text8('low')} AS low, {text8('close')} AS close,
        CASE WHEN k = 2 THEN '-' || {text8('volume')} ELSE {text8('volume')} END AS volume
      FROM (SELECT *, {_HOUR} % 11 AS k FROM c1h)"""),
    "typed": (["dirty"], """SELECT slot_pair, slot_time, pair, "interval", "timestamp", """
              + ", ".join(f"{parsed(c)} AS {c}" for c in _FIELDS) + " FROM dirty"),
    "logic": (["typed"], _logic_sql()),
    "results": (["typed", "logic"], """SELECT t.slot_pair, t.slot_time, t.pair, t."interval",
        t."timestamp" AS candle_timestamp,
        t.pair || '_' || CAST(coalesce(CAST(epoch(t."timestamp") AS BIGINT), -62135596800) AS VARCHAR) AS id,
        coalesce(l.n, 0) AS logic_n,
        coalesce(l.n, 0) + (CASE WHEN t."timestamp" IS NULL THEN 1 ELSE 0 END)
          + (CASE WHEN t.pair = '' THEN 1 ELSE 0 END) AS anomaly_count,
        (CASE WHEN l.n IS NULL THEN 1 ELSE 0 END) + (CASE WHEN t."timestamp" IS NOT NULL THEN 1 ELSE 0 END)
          + (CASE WHEN t.pair <> '' THEN 1 ELSE 0 END) AS checks_count
      FROM typed t LEFT JOIN (SELECT slot_pair, slot_time, count(*) AS n FROM logic GROUP BY ALL) l
        ON t.slot_pair = l.slot_pair AND t.slot_time = l.slot_time
      WHERE t.open IS NOT NULL AND t.high IS NOT NULL AND t.low IS NOT NULL
        AND t.close IS NOT NULL AND t.volume IS NOT NULL"""),
    "steps": (["c1h"], """SELECT *, lag("timestamp") OVER w AS prev_timestamp, lag(high) OVER w AS prev_high,
        lag(volume) OVER w AS prev_volume, lag(close) OVER w AS prev_close FROM c1h
      WINDOW w AS (PARTITION BY pair, "interval" ORDER BY "timestamp")"""),
    "spikes": (["steps"], """SELECT *, CAST(high AS DOUBLE) / CAST(prev_high AS DOUBLE) AS r FROM steps
      WHERE prev_high > 0 AND high > 5.00 * prev_high"""),
    "surges": (["steps"], """SELECT *, CAST(volume AS DOUBLE) / CAST(prev_volume AS DOUBLE) AS r FROM steps
      WHERE prev_volume > 0 AND volume > 10.00 * prev_volume"""),
    "scored": (["spikes", "surges"], """SELECT *, CASE WHEN kind = 'price_spike' THEN
          CASE WHEN confidence >= 0.9 AND value / 5.0 > 2 THEN 'critical'
               WHEN confidence >= 0.7 THEN 'error' ELSE 'warning' END
        ELSE CASE WHEN confidence >= 0.9 AND value / 10.0 > 5 THEN 'critical'
               WHEN confidence >= 0.7 THEN 'error' ELSE 'warning' END END AS severity
      FROM (SELECT pair, "interval", "timestamp", 'price_spike' AS kind, r AS value, 5.0 AS threshold,
          CASE WHEN r <= 5 THEN 0.0 ELSE least(0.5 + ((r - 5.0::DOUBLE) / 5.0::DOUBLE) * 0.1::DOUBLE, 1.0) END AS confidence
        FROM spikes UNION ALL
        SELECT pair, "interval", "timestamp", 'volume_surge', r, 10.0,
          CASE WHEN r <= 10 THEN 0.0 ELSE least(0.6 + ((r - 10.0::DOUBLE) / 10.0::DOUBLE) * 0.08::DOUBLE, 1.0) END
        FROM surges)"""),
    "events_steps": (["ticks"], f"""SELECT pair, event_id, time_bucket(INTERVAL 1 HOUR, ts) AS "timestamp",
        lag(time_bucket(INTERVAL 1 HOUR, ts)) OVER (PARTITION BY pair ORDER BY event_id) AS prev_timestamp
      FROM ticks"""),
    "arrival": (["ticks"], """SELECT pair, event_id * 7919 % 1000003 AS arrival_seq, ts AS "timestamp" FROM ticks"""),
    "grid5": (["c5m"], f"""SELECT pair, unnest(generate_series({START}, {END} - INTERVAL 5 MINUTE,
        INTERVAL 5 MINUTE)) AS t FROM (SELECT DISTINCT pair FROM c5m)"""),
    "missing5": (["grid5", "c5m"], """SELECT pair, t FROM grid5 g WHERE NOT EXISTS
        (SELECT 1 FROM c5m c WHERE c.pair = g.pair AND c."timestamp" = g.t)"""),
    "periods5": (["missing5"], """SELECT pair, '5m' AS "interval", min(t) AS start_time,
        max(t) + INTERVAL 5 MINUTE AS end_time
      FROM (SELECT pair, t, t - row_number() OVER (PARTITION BY pair ORDER BY t) * INTERVAL 5 MINUTE AS island
            FROM missing5) GROUP BY pair, island"""),
    "grid1": (["c1h"], f"""SELECT pair, unnest(generate_series({START}, {END} - INTERVAL 1 HOUR,
        INTERVAL 1 HOUR)) AS t FROM (SELECT DISTINCT pair FROM c1h)"""),
    "missing1": (["grid1", "c1h"], """SELECT pair, t FROM grid1 g WHERE NOT EXISTS
        (SELECT 1 FROM c1h c WHERE c.pair = g.pair AND c."timestamp" = g.t)"""),
    "periods1": (["missing1"], """SELECT pair, '1h' AS "interval", min(t) AS start_time,
        max(t) + INTERVAL 1 HOUR AS end_time
      FROM (SELECT pair, t, t - row_number() OVER (PARTITION BY pair ORDER BY t) * INTERVAL 1 HOUR AS island
            FROM missing1) GROUP BY pair, island"""),
    "gaps0": (["periods5"], f"""SELECT pair || '_5m_' || {unix('start_time')} || '_' || {unix('end_time')} AS id,
        pair, "interval", start_time, end_time, status, created_at,
        CASE WHEN status = 'filled' THEN {shifted('created_at', '(h % 13 + 1) * 3600')} END AS filled_at,
        h % 4 AS priority, attempts,
        CASE WHEN attempts > 0 THEN {shifted(AS_OF, '-(h % 5) * 1200')} END AS last_attempt_at,
        CASE WHEN status = 'detected' AND attempts > 0 AND h % 2 = 0 THEN 'no data available for gap period'
             WHEN status = 'permanent' THEN 'exchange delisted pair' END AS error_message, h
      FROM (SELECT *, {_STATUS} AS status, CASE WHEN h % 7 = 4 THEN h % 3 + 1 WHEN h % 7 = 5 THEN h % 2 + 1
          WHEN h % 7 = 6 THEN 5 ELSE h % 6 END AS attempts,
          {shifted(AS_OF, '-((h % 97) * 10800 + 600)')} AS created_at
        FROM (SELECT *, {unix('start_time')} // 300 AS h FROM periods5))"""),
    "broken_gaps": (["gaps0"], f"""SELECT id AS source_id, CASE WHEN k = 0 THEN '' ELSE id END AS id,
        CASE WHEN k = 1 THEN '' ELSE pair END AS pair, CASE WHEN k = 2 THEN '' ELSE "interval" END AS "interval",
        CASE WHEN k = 3 THEN NULL ELSE start_time END AS start_time,
        CASE WHEN k = 4 THEN NULL WHEN k = 5 THEN start_time ELSE end_time END AS end_time,
        CASE WHEN k = 6 THEN 'lost' WHEN k = 7 THEN 'filled' WHEN k = 8 THEN 'detected' ELSE status END AS status,
        CASE WHEN k = 7 THEN NULL WHEN k = 8 THEN {AS_OF} ELSE filled_at END AS filled_at
      FROM (SELECT *, h % 17 AS k FROM gaps0)"""),
    "wide_gaps": (["gaps0"], f"""SELECT * EXCLUDE (end_time), {shifted('end_time', '(h % 4) * 300')} AS end_time
      FROM gaps0"""),
    "donor": (["c5m"], """SELECT * EXCLUDE (pair), CASE pair WHEN 'click' THEN 'error' WHEN 'error' THEN 'purchase'
        WHEN 'purchase' THEN 'signup' WHEN 'signup' THEN 'view' WHEN 'view' THEN 'click' ELSE pair END AS pair
      FROM c5m"""),
    "found": (["gaps0", "donor"], """SELECT g.id, count(d.pair) AS n FROM gaps0 g LEFT JOIN donor d
        ON d.pair = g.pair AND d."timestamp" >= g.start_time AND d."timestamp" < g.end_time GROUP BY g.id"""),
    "load1": (["c1h"], _load(f"{_HOUR} % 7 <> 0", "close", 1)),
    "load2": (["c1h"], _load(f"{_HOUR} % 5 <> 0", _DOUBLED, 2)),
    "load0": (["c1h"], _load("true", "close", 1)),
    "jobs0": ([], f"""SELECT 'job-' || o_orderkey AS id, {_LIST(["initial_sync", "update", "backfill", "unknown"], "o_orderkey % 4")} AS type,
        CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE 'P' || (o_custkey % 7) END AS pair,
        {_LIST(["1m", "5m", "1h", "1d", "7x", ""], "o_orderkey % 6")} AS "interval",
        CASE WHEN o_orderkey % 31 <> 0 THEN o_orderdate END AS start_time,
        {shifted('o_orderdate', '(o_orderkey % 5 - 1) * 86400')} AS end_time, status,
        CASE WHEN status = 'completed' THEN 100 WHEN status = 'running' THEN o_orderkey % 120
             ELSE o_orderkey % 90 - 1 END AS progress,
        (o_orderkey * 37) % 5000 - 10 AS records_collected,
        CASE WHEN status = 'failed' THEN {_LIST(_ERRORS, "o_orderkey % 12")} END AS error_message,
        o_orderkey % 9 - 1 AS retry_count, o_orderdate AS created_at,
        {shifted('o_orderdate', '(o_orderkey % 500) * 60')} AS updated_at, o_orderkey AS k
      FROM (SELECT *, CASE WHEN o_orderkey % 8 = 0 THEN 'pending' WHEN o_orderkey % 8 = 1 THEN 'failed'
          WHEN o_orderkey % 41 = 0 THEN 'lost' WHEN o_orderstatus = 'F' THEN 'completed'
          WHEN o_orderstatus = 'O' THEN 'running' ELSE 'failed' END AS status FROM orders)"""),
    "payload_rows": (["c1d"], """SELECT pair, "interval", "timestamp",
        CAST(CAST(open AS DECIMAL(18,2)) AS VARCHAR) AS open, """
        + ", ".join(f"{text8(c)} AS {c}" for c in ("high", "low", "close", "volume")) + """
      FROM c1d WHERE day("timestamp") NOT IN (5, 6, 7)
        AND NOT (month("timestamp") = 2 AND year("timestamp") % 2 = 0)"""),
    "pairs0": (["c1d"], """SELECT DISTINCT pair AS symbol, substr(pair, 1, 1) AS base_asset,
        substr(pair, 3, 1) AS quote_asset, substr(pair, 1, 1) <> 'A' AS active FROM c1d WHERE pair <> 'R-F'"""),
    "products0": ([], """SELECT product_id AS symbol,
        CASE WHEN len(string_split(product_id, '-')) = 2 THEN string_split(product_id, '-')[1] ELSE base_id END AS base_asset,
        CASE WHEN len(string_split(product_id, '-')) = 2 THEN string_split(product_id, '-')[2] ELSE r_name END AS quote_asset,
        k % 3 <> 0 AS active,
        CASE WHEN k % 4 = 0 THEN '   ' WHEN k % 4 = 1 THEN '' ELSE '0.01' END AS min_volume,
        '1000' AS max_volume, '0.001' AS price_step
      FROM (SELECT n_nationkey AS k, r_name, CASE WHEN n_nationkey % 5 = 0 THEN n_name ELSE n_name || '-' || r_name END AS product_id,
          CASE WHEN n_nationkey % 10 = 5 THEN '' ELSE 'B' || n_nationkey END AS base_id
        FROM nation JOIN region ON n_regionkey = r_regionkey)"""),
    "fridays": (["ticks"], """SELECT d + INTERVAL 20 HOUR AS start_time, d + INTERVAL 76 HOUR AS end_time
      FROM (SELECT unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL 1 DAY)) AS d
            FROM ticks) WHERE isodow(d) = 5"""),
}


def statement(body: str, parts=()) -> str:
    """``body`` preceded by the parts it needs, each once, in dependency order."""
    ordered = []

    def add(name):
        if name in ordered:
            return
        for needed in PARTS[name][0]:
            add(needed)
        ordered.append(name)

    for name in parts:
        add(name)
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n][1]})" for n in ordered)
    if body.startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
