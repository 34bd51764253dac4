"""Apply ordered events to a table of finite-state records.

An event acts on a record as a function from state to state, and such functions
compose. Each block of events of a key is reduced to one small array (the
resulting state for every possible starting state); the blocks of a key are then
chained, and each block replays its own events from its known starting state. No
task ever holds all events of a key with many. Keys with no more events than a block
holds need no chain: they are replayed at once from the record's state.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewright.operators.series import ranked
from candlewright.session import written

EVENTS_PER_BLOCK = 256
BLOCKS_PER_GROUP = 256

# Numbers of one key that span more than so many times their count are numbered again first.
DENSE = 4


def rank_levels(order: str) -> list:
    """Bucket levels for numbering up to microseconds."""
    return [[(F.floor(F.col(order) / F.lit(1 << bits)), False)] for bits in (36, 24, 12)]


_STARTS = "cast(array() as array<struct<block:bigint,state:int>>)"


def _apply(table: list, width: int, code: Column, state: Column) -> Column:
    """Next state: the transition table is one flat literal array."""
    return F.get(F.array(*[F.lit(s) for row in table for s in row]), code * width + state)


def _block_starts(effects: DataFrame, first: DataFrame, key: str, levels: int) -> DataFrame:
    """State in which each block of a key begins, as (key, _block, _start).

    Blocks are grouped, a group's effect is the composition of its blocks, and
    groups are chained the same way one level up; the top level chains the few
    groups that are left from the record's own state.
    """
    block = F.struct(F.col("_block").alias("block"), "effect")
    if levels == 0:
        grouped = effects.groupBy(key).agg(F.sort_array(F.collect_list(block)).alias("_blocks"))
        placed = grouped.join(first, key, "left")
    else:
        group = F.floor(F.col("_block") / F.lit(BLOCKS_PER_GROUP)).cast("bigint")
        grouped = effects.groupBy(key, group.alias("_group")).agg(
            F.sort_array(F.collect_list(block)).alias("_blocks"))
        composed = F.aggregate(
            F.slice("_blocks", 2, BLOCKS_PER_GROUP), F.get(F.col("_blocks"), F.lit(0))["effect"],
            lambda acc, b: F.transform(acc, lambda s: F.get(b["effect"], s)))
        above = _block_starts(
            grouped.select(key, F.col("_group").alias("_block"), composed.alias("effect")),
            first, key, levels - 1)
        placed = grouped.join(above.withColumnRenamed("_block", "_group"), [key, "_group"])
    starts = F.aggregate(
        "_blocks",
        F.struct(F.col("_start").alias("state"), F.expr(_STARTS).alias("starts")),
        lambda acc, b: F.struct(
            F.get(b["effect"], acc["state"]).alias("state"),
            F.concat(acc["starts"], F.array(F.struct(
                b["block"].alias("block"), acc["state"].alias("state")))).alias("starts")),
        lambda acc: acc["starts"])
    return placed.select(key, F.inline(starts)).select(
        key, F.col("block").alias("_block"), F.col("state").alias("_start"))


def _spans(events: DataFrame, key: str, order: str) -> DataFrame:
    spans = events.groupBy(key).agg((F.max(order).cast("double") - F.min(order)).alias("span"), F.count(F.lit(1)).alias("n"))
    return spans.select(key, "n", (F.col("span") > DENSE * F.col("n") + EVENTS_PER_BLOCK).alias("sparse"))


def is_sparse(events: DataFrame, key: str, order: str) -> bool:
    """Whether some key's numbers lie so far apart that blocks by number would hold few events."""
    return bool(_spans(events, key, order).agg(F.coalesce(F.max("sparse"), F.lit(False))).first()[0])


def split_by_length(events: DataFrame, key: str, order: str, most: int = EVENTS_PER_BLOCK):
    """(events of keys with at most ``most`` of them, long keys or None, whether those are sparse)."""
    long = written(_spans(events.where(F.col(key).isNotNull()), key, order).where(F.col("n") > most), "long-keys")
    found, sparse = long.agg(F.count(F.lit(1)), F.max("sparse")).first()
    if not found:
        return events, None, False
    return events.join(long.select(key), key, "left_anti").select(*events.columns), long.select(key), sparse


def _codes(states: list, moves: dict, start_state: Column, event_type: str):
    """(transition table of all kinds and of unknown ones, code of an event, number of a record's state)."""
    index = {s: i for i, s in enumerate(states)}
    kinds = list(moves)
    table = [[index[moves[k].get(s, s)] for s in states] for k in kinds]
    table.append(list(range(len(states))))  # unknown event types change nothing
    code = F.lit(len(kinds))
    for i, kind in enumerate(kinds):
        code = F.when(F.col(event_type) == kind, i).otherwise(code)
    number = F.lit(None).cast("int")
    for i, state in enumerate(states):
        number = F.when(start_state == state, i).otherwise(number)
    return table, code, number


def _log(replayed: DataFrame, key: str, order: str, columns: list, states: list, moves: dict) -> DataFrame:
    """The replayed events with their states by name and whether each was a move that is listed."""
    names = F.array(*[F.lit(s) for s in states])
    listed = F.lit(False)
    for i, name in enumerate(moves):
        listed = listed | ((F.col("code") == i) & F.col("before").isin([states.index(s) for s in moves[name]]))
    if "open" in replayed.columns:
        listed = listed & F.col("open")
    return replayed.select(
        key, F.col("seq").alias(order), "row.*",
        F.get(names, F.col("before")).alias("state_before"), F.get(names, F.col("after")).alias("state_after"),
        F.coalesce(listed, F.lit(False)).alias("accepted")).select(*columns, "state_before", "state_after", "accepted")


def fold_short(events: DataFrame, records: DataFrame, key: str, order: str, states: list, moves: dict,
               start_state: Column, event_type: str = "event_type", limited: str = None, left: Column = None) -> DataFrame:
    """:func:`fold_events` where all events of a key fit one array: no blocks, no chain.

    ``limited`` names an event type that is accepted ``left`` times only (of a record); later ones change nothing.
    """
    table, code, number = _codes(states, moves, start_state, event_type)
    width, rest = len(states), [c for c in events.columns if c not in (key, order)]
    packed = events.where(F.col(key).isNotNull()).select(key, F.struct(
        F.col(order).alias("seq"), code.alias("code"), F.struct(*rest).alias("row")).alias("_e")).groupBy(key).agg(
        F.sort_array(F.collect_list("_e")).alias("_events"))
    some = F.lit(1).cast("bigint") if left is None else left.cast("bigint")
    first = records.select(key, number.alias("_start"), some.alias("_left"))
    kind = packed.schema["_events"].dataType.elementType["row"].dataType.simpleString()
    log_type = f"array<struct<seq:bigint,code:int,row:{kind},before:int,after:int,open:boolean>>"
    counted = list(moves).index(limited) if limited else -1

    def replay(acc, e):
        free = (e["code"] != counted) | (acc["left"] > 0)
        after = F.when(free, _apply(table, width, e["code"], acc["state"])).otherwise(acc["state"])
        used = free & (e["code"] == counted) & (after != acc["state"])
        return F.struct(
            after.alias("state"), F.when(used, acc["left"] - 1).otherwise(acc["left"]).alias("left"),
            F.concat(acc["log"], F.array(F.struct(
                e["seq"].cast("bigint").alias("seq"), e["code"].alias("code"), e["row"].alias("row"),
                acc["state"].alias("before"), after.alias("after"), free.alias("open")))).alias("log"))

    steps = F.aggregate("_events", F.struct(
        F.col("_start").alias("state"), F.col("_left").alias("left"), F.expr(f"cast(array() as {log_type})").alias("log")),
        replay, lambda acc: acc["log"])
    return _log(packed.join(first, key, "left").select(key, F.inline(steps)), key, order, events.columns, states, moves)


def fold_events(events: DataFrame, records: DataFrame, key: str, order: str, states: list,
                moves: dict, start_state: Column, event_type: str = "event_type",
                per_block: int = EVENTS_PER_BLOCK, levels: int = 1, sparse: bool = None) -> DataFrame:
    """Events with the record's state before and after each of them.

    ``moves`` maps an event type to ``{state: next state}``; a pair that is not
    listed leaves the state alone and marks the event as rejected. ``order``
    must be a sequence number, unique within a key. Events of unknown type or
    for unknown records are rejected too, with NULL states for the latter.
    Each of ``levels`` multiplies by ``BLOCKS_PER_GROUP`` the events of one key
    that can be chained without a long array. Numbers far apart, such as times in
    microseconds, are ``sparse``: events are then numbered from 1 first, level by level. Without
    a word on it the span and count of the keys with more than ``per_block`` events decide.
    """
    short, long, apart = split_by_length(events, key, order, per_block)
    log = fold_short(short, records, key, order, states, moves, start_state, event_type)
    if long is None:
        return log
    return log.unionByName(fold_long(
        events.join(long, key, "left_semi"), records.join(long, key, "left_semi"), key, order, states, moves, start_state,
        event_type, per_block, levels, apart if sparse is None else sparse))


def fold_long(events: DataFrame, records: DataFrame, key: str, order: str, states: list, moves: dict, start_state: Column,
              event_type: str = "event_type", per_block: int = EVENTS_PER_BLOCK, levels: int = 1, sparse: bool = False) -> DataFrame:
    """:func:`fold_events` in blocks that are chained, whatever number of events a key has."""
    table, code, number = _codes(states, moves, start_state, event_type)
    width = len(states)
    rest = [c for c in events.columns if c not in (key, order)]
    numbered, place = events, F.col(order)
    if sparse:
        numbered = ranked(events, [key], [order], rank_levels(order), "_place")
        place = F.col("_place")
    block = F.floor(place / F.lit(per_block)).cast("bigint")
    packed = (
        numbered.select(key, block.alias("_block"), F.struct(
            F.col(order).alias("seq"), code.alias("code"), F.struct(*rest).alias("row")).alias("_e"))
        .groupBy(key, "_block").agg(F.sort_array(F.collect_list("_e")).alias("_events"))
    )
    identity = F.array(*[F.lit(i) for i in range(width)])
    effect = F.aggregate("_events", identity, lambda acc, e: F.transform(
        acc, lambda s: _apply(table, width, e["code"], s)))
    first = records.select(key, number.alias("_start"))
    chained = _block_starts(packed.select(key, "_block", effect.alias("effect")), first, key, levels)
    kind = packed.schema["_events"].dataType.elementType["row"].dataType.simpleString()
    log_type = f"array<struct<seq:bigint,code:int,row:{kind},before:int,after:int>>"

    def replay(acc, e):
        after = _apply(table, width, e["code"], acc["state"])
        entry = F.struct(e["seq"].cast("bigint").alias("seq"), e["code"].alias("code"),
                         e["row"].alias("row"), acc["state"].alias("before"), after.alias("after"))
        return F.struct(after.alias("state"), F.concat(acc["log"], F.array(entry)).alias("log"))

    steps = F.aggregate(
        "_events", F.struct(F.col("_start").alias("state"),
                            F.expr(f"cast(array() as {log_type})").alias("log")),
        replay, lambda acc: acc["log"])
    return _log(packed.join(chained, [key, "_block"]).select(key, F.inline(steps)), key, order, events.columns, states, moves)
