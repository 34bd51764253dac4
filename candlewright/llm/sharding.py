"""Shards of equal bytes by a histogram sort; DataFrame operations only."""

from dataclasses import dataclass, field

from pyspark.sql import Window
from pyspark.sql import functions as F

from candlewright.llm.common import stored

STEP = 3  # hex digits of the key that one round of counting refines: 4096 probes per open boundary


@dataclass
class Boundary:
    """Search for the key at which ``target`` bytes lie below."""

    target: int
    prefix: str = ""  # the boundary lies among keys that start so
    below: int = 0  # exact bytes of all smaller keys
    key: str = field(default=None)  # the splitter, once found


def _hex(column):
    return F.lpad(F.hex(column), 16, "0")


def sort_keys(rows, text, doc_id):
    """A key per row: hash of the text, then of the id, then the row's place.

    Equal texts are neighbours. Uniform hashes let a boundary fall anywhere, also inside
    a group of equal texts and inside repeated rows.
    """
    return F.concat(_hex(F.xxhash64(text)), _hex(F.xxhash64(doc_id)), _hex(F.monotonically_increasing_id()))


def splitters(keyed, shards, tolerance):
    """Keys that cut the rows into ``shards`` ranges of near equal bytes.

    Each round counts the exact bytes below 4096 candidate keys inside the range that
    still holds a boundary, for all boundaries in one aggregate, and narrows each range
    to the step that crosses its target. A boundary is done when an edge of that step is
    within ``tolerance`` of a shard, or when the key has no digits left. Only the counts
    of the open ranges reach the driver: at most 4096 for each of ``shards`` - 1.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    allowed = tolerance * total / shards
    bounds = [Boundary(total * i // shards) for i in range(1, shards)]
    digits = 0
    while opened := [b for b in bounds if b.key is None]:
        prefixes = sorted({b.prefix for b in opened})
        rows = keyed if digits == 0 else keyed.where(F.substring("key", 1, digits).isin(prefixes))
        digits += STEP
        counts = rows.groupBy(F.substring("key", 1, digits).alias("p")).agg(F.sum("size").alias("n")).collect()
        steps = {}
        for p, n in sorted(map(tuple, counts)):
            steps.setdefault(p[:digits - STEP], []).append((p, n))
        for b in opened:
            b.key = ""  # an empty table: every key is above
            for p, n in steps.get(b.prefix, ()):
                b.key = p
                if b.below + n >= b.target:
                    after = b.below + n - b.target
                    if b.target - b.below > allowed and after > allowed and digits < 48:
                        b.key, b.prefix = None, p
                    elif after < b.target - b.below:
                        b.key, b.below = p + "~", b.below + n  # just above every key of this step
                    break
                b.below += n
    return [b.key for b in bounds]


def histogram_shards(docs, shards=24, tolerance=0.001, carry=None, text="text", doc_id="doc_id"):
    """``carry`` (or all columns of ``docs``) plus size, shard (0 to shards - 1) and slot within the shard.

    A document's size is the UTF-8 bytes of its text (null: none) plus 8; shards get near
    equal bytes. Equal texts stand together unless a boundary falls among them, and each
    copy is placed on its own, so a text with a third of all rows fills a third of the
    shards. Slots are gapless from 0: the start of a small range of keys, from counts per
    range, plus the row's place within the range, so no shard is sorted in one task.
    Repeated rows get a slot each; an empty table gives an empty one. Columns of the
    result named like the input's replace them.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    added = ["size", "shard", "slot"]
    kept = [c for c in (docs.columns if carry is None else carry) if c not in added]
    keyed = stored(docs.select(*[F.col(f"`{c}`") for c in kept], size.alias("size"),
                               sort_keys(docs, docs[text], docs[doc_id]).alias("key_of_row")))
    narrow = keyed.select(F.col("key_of_row").alias("key"), "size")
    shard = F.lit(0)
    for s in splitters(narrow, shards, tolerance):
        shard = shard + (F.col("key_of_row") >= F.lit(s)).cast("int")
    # At most 65536 + shards ranges, whatever the input: 4096 of the text's hash times 16 of the id's, which spreads large groups of copies.
    ranged = keyed.withColumn("shard", shard).withColumn("range_of_row", F.concat(
        F.substring("key_of_row", 1, 3), F.substring("key_of_row", 17, 1)))
    counts = ranged.groupBy("shard", "range_of_row").agg(F.count("*").alias("rows_of_range"))
    before = Window.partitionBy("shard").orderBy("range_of_row").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(counts.select("shard", "range_of_row", F.coalesce(F.sum("rows_of_range").over(before), F.lit(0))
                                  .alias("start_of_range")))
    place = F.row_number().over(Window.partitionBy("shard", "range_of_row").orderBy("key_of_row"))
    return ranged.withColumn("place_in_range", place).join(F.broadcast(starts), ["shard", "range_of_row"]).select(
        *kept, "size", "shard", (F.col("start_of_range") + F.col("place_in_range") - 1).cast("long").alias("slot"))
