"""Ordered computations over a series that stay parallel inside one series.

A plain ``Window.partitionBy(series).orderBy(time)`` puts a whole series into
one task. Here a series is cut into buckets of its order value; windows run per
(series, bucket), and what has to cross a bucket border travels in a summary
with one row per bucket. The summary is smaller than the data by the bucket
population, so ordering *it* per series is cheap even for a hot series.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.intervals import HOUR, interval_seconds

BUCKET = "_bucket"
# Slots of a regular series per bucket.
SLOTS_PER_BUCKET = 4096


def time_bucket(order: Column, interval: Column = None, slots: int = SLOTS_PER_BUCKET) -> Column:
    """Bucket number of a timestamp, ``slots`` intervals wide."""
    step = F.lit(HOUR).cast("bigint") if interval is None else F.coalesce(
        interval_seconds(interval), F.lit(HOUR).cast("bigint"))
    return F.floor(F.unix_seconds(order) / (step * slots)).cast("bigint")


def number_bucket(order: Column, width: int = SLOTS_PER_BUCKET) -> Column:
    """Bucket number of a sequence number."""
    return F.floor(order / F.lit(width)).cast("bigint")


def _across(ends: DataFrame, keys, carried, levels: int, fan: int) -> DataFrame:
    """The first row of each bucket next to the last row of the bucket before it.

    ``ends`` has one row per bucket: first values and ``last_*``. With ``levels`` left,
    buckets are ordered within groups of ``fan`` of them, and only the groups go on to
    the next level; without, the buckets of a series are ordered in one task.
    """
    if not levels:
        across = Window.partitionBy(*keys).orderBy(BUCKET)
        return ends.select(*keys, BUCKET, *carried, *[F.lag(f"last_{c}").over(across).alias(f"prev_{c}") for c in carried])
    grouped = ends.withColumn("_group", F.floor(F.col(BUCKET) / F.lit(fan)).cast("bigint")).repartition(keys[0], "_group")
    inside = Window.partitionBy(*keys, "_group").orderBy(BUCKET)
    inner = grouped.select(*keys, BUCKET, *carried, *[F.lag(f"last_{c}").over(inside).alias(f"prev_{c}") for c in carried],
                           F.row_number().over(inside).alias("_rn")).where("_rn > 1").drop("_rn")
    heads = grouped.groupBy(*keys, "_group").agg(
        *[F.min_by(c, BUCKET).alias(c) for c in carried],
        *[F.max_by(f"last_{c}", BUCKET).alias(f"last_{c}") for c in carried]).withColumnRenamed("_group", BUCKET)
    return inner.unionByName(_across(heads, keys, carried, levels - 1, fan))


def transitions(df: DataFrame, keys, order: str, values=(), bucket: Column = None,
                include_first: bool = False, levels: int = 0, fan: int = SLOTS_PER_BUCKET,
                keep_bucket: bool = False) -> DataFrame:
    """One row per pair of consecutive rows in a series.

    Output: the keys, ``order`` and ``values`` of the later row, and the same of
    the earlier one as ``prev_*``. ``order`` must be unique within a series;
    rows without an order value are left out. ``include_first`` adds the first
    row of each series with NULL ``prev_*`` columns. ``levels`` is for orders without
    bound, such as arrival numbers: so many levels of ``fan`` buckets are put between
    the buckets and the series. ``keep_bucket`` leaves a bucket number on every row, for
    :func:`attach_per_series`.
    """
    keys, values = list(keys), list(values)
    if bucket is None:
        bucket = time_bucket(F.col(order), F.col("interval"))
    # One explicit shuffle feeds both branches; the first key and the bucket spread
    # the rows and satisfy every grouping that contains them.
    rows = (
        df.where(F.col(order).isNotNull())
        .select(*keys, order, *values, bucket.alias(BUCKET))
        .repartition(keys[0], BUCKET)
    )
    inside = Window.partitionBy(*keys, BUCKET).orderBy(order)
    carried = [order, *values]
    inner = (
        rows.select("*", *[F.lag(c).over(inside).alias(f"prev_{c}") for c in carried])
        .where(F.col(f"prev_{order}").isNotNull())
    )
    ends = rows.groupBy(*keys, BUCKET).agg(
        F.min(order).alias(order), F.max(order).alias(f"last_{order}"),
        *[F.min_by(v, order).alias(v) for v in values],
        *[F.max_by(v, order).alias(f"last_{v}") for v in values],
    )
    edges = _across(ends, keys, carried, levels, fan)
    if not include_first:
        edges = edges.where(F.col(f"prev_{order}").isNotNull())
    found = inner.unionByName(edges)
    return found if keep_bucket else found.drop(BUCKET)


def look_up(rows: DataFrame, table: DataFrame, keys) -> DataFrame:
    """``rows`` with the further columns of ``table``, which is unique in ``keys``; NULL meets NULL."""
    keys = list(keys)
    named = table.select(*[F.col(c).alias(f"_k_{c}") for c in keys], *[c for c in table.columns if c not in keys])
    met = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys])
    return rows.join(named, met, "left").drop(*[f"_k_{c}" for c in keys])


def attach_per_series(rows: DataFrame, per_series: DataFrame, keys) -> DataFrame:
    """``rows`` with the columns of ``per_series``, which has one row per series.

    The values are first copied to each bucket that occurs; rows are then looked up by
    series and bucket, so that a hot series is no join key of its own. Every row stays.
    """
    keys = list(keys)
    buckets = look_up(rows.select(*keys, BUCKET).distinct(), per_series, keys)
    return look_up(rows, buckets, [*keys, BUCKET])


def running(df: DataFrame, keys, order: list, measures: dict, bucket: Column) -> DataFrame:
    """Running aggregates up to, but not including, the current row.

    ``measures`` maps an output column to ``(kind, column)`` with kind ``max``
    or ``sum``; the output is NULL (``max``) or 0 (``sum``) on the first row.
    ``bucket`` must be monotone in ``order``.
    """
    keys = list(keys)
    rows = df.withColumn(BUCKET, bucket)
    before = (Window.partitionBy(*keys, BUCKET).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    earlier = (Window.partitionBy(*keys).orderBy(BUCKET)
               .rowsBetween(Window.unboundedPreceding, -1))
    kinds = {"max": F.max, "sum": F.sum}
    carry = (
        rows.groupBy(*keys, BUCKET)
        .agg(*[kinds[kind](col).alias(f"_t_{out}") for out, (kind, col) in measures.items()])
        .select(*keys, BUCKET, *[
            kinds[kind](f"_t_{out}").over(earlier).alias(f"_c_{out}")
            for out, (kind, _) in measures.items()])
    )
    local = rows.select("*", *[
        kinds[kind](col).over(before).alias(f"_l_{out}")
        for out, (kind, col) in measures.items()])

    def merged(out, kind):
        mine, theirs = F.col(f"_l_{out}"), F.col(f"_c_{out}")
        if kind == "max":
            return F.greatest(mine, theirs).alias(out)
        zero = F.lit(0)
        return (F.coalesce(mine, zero) + F.coalesce(theirs, zero)).alias(out)

    return local.join(carry, [*keys, BUCKET], "left").select(
        *df.columns, *[merged(out, kind) for out, (kind, _) in measures.items()])


def ranked(df: DataFrame, keys, order: list, levels: list, name: str) -> DataFrame:
    """``row_number`` over ``keys``, computed per bucket plus offsets.

    ``levels`` is a list of bucket levels, each a list of (column, descending)
    pairs; level after level they must follow ``order``. Only the first level is
    ordered over a whole key; every further one is ordered within the buckets
    above it, and rows only within the finest buckets.
    """
    keys = list(keys)
    named = [[(f"_b{i}_{j}", *part) for j, part in enumerate(level)] for i, level in enumerate(levels)]
    columns = [[n for n, _, _ in level] for level in named]
    upto = lambda depth: [*keys, *[c for level in columns[:depth] for c in level]]
    rows = df.select("*", *[expr.alias(n) for level in named for n, expr, _ in level])

    counts = rows.groupBy(*upto(len(levels))).agg(F.count(F.lit(1)).alias("_n"))
    offsets = None
    for depth in range(len(levels), 0, -1):
        level_order = [F.desc(n) if down else F.asc(n) for n, _, down in named[depth - 1]]
        earlier = (Window.partitionBy(*upto(depth - 1)).orderBy(*level_order)
                   .rowsBetween(Window.unboundedPreceding, -1))
        here = counts.select(*upto(depth), F.coalesce(
            F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
        if offsets is None:
            offsets = here.withColumnRenamed("_before", "_offset")
        else:
            offsets = offsets.join(here, upto(depth)).withColumn(
                "_offset", F.col("_offset") + F.col("_before")).drop("_before")
        counts = counts.groupBy(*upto(depth - 1)).agg(F.sum("_n").alias("_n"))
    inside = Window.partitionBy(*upto(len(levels))).orderBy(*order)
    return (
        rows.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, upto(len(levels)))
        .select(*df.columns, (F.col("_offset") + F.col("_rn")).alias(name))
    )
