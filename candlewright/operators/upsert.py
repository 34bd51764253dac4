"""Table maintenance: duplicates, upserts, corrections, deletes."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewright.schemas import CANDLE_FIELDS, CANDLE_KEY


def latest_per_key(rows: DataFrame, key, newest_first) -> DataFrame:
    """The newest row of every key.

    ``row_number() = 1`` is limited per key before the shuffle as well, so a
    key with very many copies sends one row per task.
    """
    w = Window.partitionBy(*key).orderBy(*newest_first)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def newest_candle(columns):
    """Order of the copies of a candle: the latest created, then the latest loaded.

    Where a table has neither, and among equals, the larger values come first, so that
    the choice does not depend on the order of the rows.
    """
    return [F.desc(c) for c in ("created_at", "load_seq", *reversed(CANDLE_FIELDS)) if c in columns]


def dedup_candles(candles: DataFrame, newest_first=None) -> DataFrame:
    """One row per candle key, by :func:`newest_candle`."""
    return latest_per_key(candles, CANDLE_KEY, newest_first or newest_candle(candles.columns))


def upsert(existing: DataFrame, incoming: DataFrame, key, newest_first) -> DataFrame:
    """Incoming rows replace existing rows with the same key.

    Order among incoming copies of a key is ``newest_first``.
    """
    marked = existing.withColumn("_new", F.lit(0)).unionByName(
        incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(marked, key, [F.desc("_new"), *newest_first]).drop("_new")


def upsert_candles(existing: DataFrame, incoming: DataFrame, newest_first=None) -> DataFrame:
    order = newest_first or newest_candle({*existing.columns, *incoming.columns})
    return upsert(existing, incoming, CANDLE_KEY, order)


def upsert_gaps(existing: DataFrame, incoming: DataFrame, newest_first=None) -> DataFrame:
    """Insert or update gap rows by id."""
    return upsert(existing, incoming, ["id"], newest_first or [F.desc("created_at")])


def delete_gaps(gaps: DataFrame, ids: DataFrame):
    """(gaps that remain, ids that were not present)."""
    wanted = ids.select("id").distinct()
    return gaps.join(wanted, "id", "left_anti"), wanted.join(gaps.select("id"), "id", "left_anti")


def merge_corrections(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Keys that are new, changed or withdrawn, with old and new values and what changed.

    ``incoming`` is the whole new state of what it covers, so a key it lacks was withdrawn.
    """
    old = existing.select(*CANDLE_KEY, *[F.col(f).alias(f"old_{f}") for f in CANDLE_FIELDS],
                          F.lit(True).alias("_old"))
    new = incoming.select(*CANDLE_KEY, *[F.col(f).alias(f"new_{f}") for f in CANDLE_FIELDS],
                          F.lit(True).alias("_new"))
    both = new.join(old, CANDLE_KEY, "full")
    differs = {f: ~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}")) for f in CANDLE_FIELDS}
    changed = F.array_compact(F.array(*[F.when(d, F.lit(f)) for f, d in differs.items()]))
    is_new, gone = F.col("_old").isNull(), F.col("_new").isNull()
    return both.where(is_new | gone | reduce(lambda a, b: a | b, differs.values())).select(
        *CANDLE_KEY, F.when(is_new, "new").when(gone, "withdrawn").otherwise("changed").alias("change"),
        F.when(~is_new & ~gone, F.array_join(changed, ",")).alias("changed_fields"),
        *[f"old_{f}" for f in CANDLE_FIELDS], *[f"new_{f}" for f in CANDLE_FIELDS])
