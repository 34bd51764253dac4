"""Mixing sources to target weights by fixed-length blocks and index permutations."""

import re

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from candlewright.llm.common import quoted, stored, word_count

WEIGHTS = (5, 2, 1)  # of the sources in order of code points, null last, repeating
MOST = 3  # times a source's words that its target may reach
BLOCK = 128  # words of a block
SHARDS = 64  # output shards
BUCKETS = 4096  # parts of a source whose running totals are formed apart
RUN = 1 << 17  # slots that one row of the slot plan stands for
SEED = 42


def targets(sizes, weights=WEIGHTS, most=MOST):
    """Target words of sources in order: shares by weight, none above ``most`` times its size."""
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))], dtype=float)
    cap, out = most * np.array(sizes, dtype=float), np.zeros(len(sizes))
    free, left = np.ones(len(sizes), dtype=bool), float(sum(sizes))
    while free.any():
        out[free] = left * w[free] / w[free].sum()
        over = free & (out > cap)
        if not over.any():
            break
        out[over] = cap[over]
        left -= cap[over].sum()
        free &= ~over
    return out


def _round_key(seed, source, lap, step):
    return np.uint64(np.random.SeedSequence([seed, source, lap, step]).generate_state(1, np.uint64)[0])


def permuted(index, n, source, lap, seed=SEED, back=False):
    """Place of each index under a pseudorandom permutation of range(n), or back.

    A four-round Feistel network over the next even power of two, applied again while
    the result is not below n; nothing of size n is held.
    """
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [_round_key(seed, source, lap, s) for s in range(4)]

    def once(x):
        left, right = x >> half, x & mask
        for k in reversed(keys) if back else keys:
            with np.errstate(over="ignore"):
                if back:
                    m = (left ^ k) * np.uint64(0x9E3779B97F4A7C15)
                    left, right = right ^ ((m ^ (m >> np.uint64(29))) >> np.uint64(7) & mask), left
                else:
                    m = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
                    left, right = right, left ^ ((m ^ (m >> np.uint64(29))) >> np.uint64(7) & mask)
        return left << half | right

    x = once(np.asarray(index, dtype=np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def slots_of(source, words, target, block=BLOCK, seed=SEED):
    """(slots, words of the last slot): as many slots as make exactly the rounded target.

    Whole laps take every block once; the last lap ends inside the block of its last
    slot. A lap passes the source's short last block once, at its permuted place.
    """
    wanted = min(round(target), MOST * words)
    if not wanted:
        return 0, 0
    blocks = -(-words // block)
    laps, rest = divmod(wanted, words)
    short = words - (blocks - 1) * block
    if not rest:
        laps, rest = laps - 1, words
    at = int(permuted([blocks - 1], blocks, source, laps, seed, back=True)[0])
    full = -(-rest // block)
    if full <= at:
        return laps * blocks + full, rest - (full - 1) * block
    with_short = -(-(rest - short) // block) + 1 if rest > at * block + short else at + 1
    if with_short == at + 1:
        return laps * blocks + at + 1, rest - at * block
    return laps * blocks + with_short, rest - short - (with_short - 2) * block


def shard_counts(slots, shards=SHARDS, seed=SEED):
    """Slots of each source in each output shard (rows: shards).

    Every shard draws a multinomial over what each source still has to give, so that
    the mix is even from shard to shard and the totals are met exactly.
    """
    left, rng, out = np.array(slots, dtype=np.int64), np.random.default_rng(seed), []
    for s in range(shards):
        wanted, drawn = -(-int(left.sum()) // (shards - s)), np.zeros_like(left)
        while wanted:
            rest = left - drawn
            more = np.minimum(rng.multinomial(wanted, rest / rest.sum()), rest)
            drawn, wanted = drawn + more, wanted - int(more.sum())
        left -= drawn
        out.append(drawn)
    return np.array(out).reshape(shards, len(slots))


def _slot_table(spark, plan, seed):
    """(src, block, shard, slot, lap, take) of every slot of the mix."""
    runs = spark.createDataFrame(plan, "src int, shard int, first long, n long, blocks long, slots long, tail long")
    runs = runs.select("*", F.explode(F.expr(f"sequence(first, first + n - 1, {RUN}L)")).alias("at")).withColumn(
        "n", F.least(F.lit(RUN), F.col("first") + F.col("n") - F.col("at")))

    def slots(frames):
        for f in frames:
            for r in f.itertuples():
                for start in range(r.at, r.at + r.n, 1 << 16):
                    j = np.arange(start, min(start + (1 << 16), r.at + r.n))
                    laps = j // r.blocks
                    for lap in np.unique(laps):
                        own = j[laps == lap]
                        yield pd.DataFrame({
                            "src": np.int32(r.src), "block": permuted(own % r.blocks, r.blocks, r.src, int(lap), seed),
                            "shard": np.int32(r.shard), "slot": own, "lap": np.int32(lap),
                            "take": np.where(own == r.slots - 1, r.tail, BLOCK)})

    # The runs are few and small, so a number has to be named: by size they would be one task, which makes all slots.
    tasks = 1 + sum(n for _, _, _, n, *_ in plan) // RUN
    return runs.repartition(max(tasks, 8), "src", "shard", "at").mapInPandas(
        slots, "src int, block long, shard int, slot long, lap int, take long")


def _plan(sources, wanted, seed):
    slots = [slots_of(i, n, t, seed=seed) for i, (n, t) in enumerate(zip(sources, wanted))]
    counts = shard_counts([n for n, _ in slots], seed=seed)
    first = np.cumsum(counts, axis=0) - counts
    return [(i, s, int(first[s, i]), int(counts[s, i]), -(-sources[i] // BLOCK), slots[i][0], slots[i][1])
            for s in range(len(counts)) for i in range(len(sources)) if counts[s, i]]


def numbered(docs, keep=None):
    """``keep`` (or all columns) and the words of each row, in a stored table; ``row_of_mix`` tells rows apart."""
    return stored(docs.select(
        *quoted(keep or docs.columns), word_count(F.col("text")).alias("words_of_row"),
        F.xxhash64("doc_id", "text").alias("hash_of_mix"), F.monotonically_increasing_id().alias("row_of_mix")))


def mix(rows, seed=SEED):
    """(sources table, pieces table) of the mix of a :func:`numbered` table.

    Sources: source, src (its place), words, target; one row each is collected, as
    sources are names of collections. Pieces: (row_of_mix, lap, shard, slot, first, last):
    the words [first, last) of a document that a slot takes. The words of a source are
    laid end to end in an order of hashed ids and texts and cut into blocks of 128; offsets come
    from totals of 4096 parts per source, so a source with a third of all rows is no
    task of its own; slots and blocks meet by (source, block number), which is even.
    Null texts have no words, null sources are one source, empty tables give no rows.
    """
    spark = rows.sparkSession
    found = rows.groupBy("source").agg(F.sum("words_of_row").alias("n")).collect()
    found = sorted(((r[0], r[1] or 0) for r in found), key=lambda r: (r[0] is None, r[0] or ""))
    names, sizes = [r[0] for r in found], [r[1] for r in found]
    wanted = targets(sizes)
    sources = spark.createDataFrame([(n, i, s, float(t)) for i, (n, s, t) in enumerate(zip(names, sizes, wanted))],
                                    "source string, src int, source_size long, target double")
    placed = rows.select("row_of_mix", "source", "words_of_row", "hash_of_mix").join(
        F.broadcast(sources.select(F.col("source").alias("s"), "src")), F.col("source").eqNullSafe(F.col("s"))).select(
        "row_of_mix", "src", F.col("words_of_row").alias("n"), "hash_of_mix",
        F.pmod(F.col("hash_of_mix"), F.lit(BUCKETS)).alias("part"))
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("src", "part").agg(F.sum("n").alias("n")).select(
        "src", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("src", "part").orderBy("hash_of_mix", "row_of_mix")
    streams = placed.withColumn("upto", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(
        starts, ["src", "part"]).where("n > 0").select(
        "row_of_mix", "src", "n", (F.col("start") + F.col("upto") - F.col("n")).alias("o"))
    blocks = streams.select("*", F.explode(F.expr(
        f"sequence(o div {BLOCK}, (o + n - 1) div {BLOCK})")).alias("block"))
    plan = _plan(sizes, wanted, seed)
    slots = _slot_table(spark, plan, seed)
    begin = F.col("block") * BLOCK
    # The planner takes the slots for as few as the runs they come from and would broadcast them.
    pieces = blocks.join(slots.hint("merge"), ["src", "block"]).select(
        "row_of_mix", "lap", "shard", "slot", F.greatest(F.lit(0), begin - F.col("o")).alias("first"),
        F.least(F.col("n"), begin + F.col("take") - F.col("o")).alias("last")).where("first < last")
    return sources, pieces


def mixed_sizes(docs):
    """(doc_id, size, source_size, target, taken) of every row of ``docs``."""
    rows = numbered(docs, keep=["doc_id", "source"])
    sources, pieces = mix(rows)
    taken = pieces.groupBy("row_of_mix").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    named = F.broadcast(sources.select(F.col("source").alias("s"), "source_size", "target"))
    return rows.select("row_of_mix", "doc_id", "source", "words_of_row").join(taken, "row_of_mix", "left").join(
        named, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", F.col("words_of_row").alias("size"), "source_size", "target",
        F.coalesce("taken", F.lit(0)).alias("taken"))


SPANS = re.compile(rb"[^\x20\x09-\x0d]+")


def _cut(text, ranges):
    """The words of ``ranges`` (lap, first, last), laps one after another, each in text order."""
    spans, out, laps = [m.span() for m in SPANS.finditer(text)], [], {}
    for lap, first, last in sorted(ranges):
        runs = laps.setdefault(lap, [])
        if runs and runs[-1][1] == first:
            runs[-1][1] = last
        else:
            runs.append([first, last])
    for lap in sorted(laps):
        out += [text if (a, b) == (0, len(spans)) else text[spans[a][0]:spans[b - 1][1]] for a, b in laps[lap]]
    return b"\n".join(out)


def mixed_documents(docs):
    """The mix as documents: each row that gives words, with the words it gives as its text.

    A document taken whole once keeps its text; one taken twice repeats it; of one taken
    in part, the taken runs remain, each as it stood. Documents that give none go.
    ``n_chars`` follows the text; the other columns stay.
    """
    own = ("doc_id", "source", "text", "n_chars")
    names = [c if c in own else f"column_{i}_of_mix" for i, c in enumerate(docs.columns)]
    rows = numbered(docs.select(*(c.alias(n) for c, n in zip(quoted(docs.columns), names))))
    _, pieces = mix(rows)
    ranges = pieces.groupBy("row_of_mix").agg(F.collect_list(F.struct("lap", "first", "last")).alias("ranges_of_mix"))

    @F.pandas_udf("binary")
    def cut(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        return pd.Series([_cut(t, [(r["lap"], r["first"], r["last"]) for r in rs]) for t, rs in zip(texts, ranges)])

    text = cut(F.col("text").cast("binary"), F.col("ranges_of_mix")).cast("string")
    out = rows.join(ranges, "row_of_mix").withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
