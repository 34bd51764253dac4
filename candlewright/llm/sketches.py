"""Document fingerprints: sketches of all shingle hashes below a fixed threshold, DataFrame functions only."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from candlewright.llm.common import stored

WORDS = 5  # of a shingle
FRACTION = 16  # one in so many hashes is kept
LOWEST = -(1 << 63)
THRESHOLD = LOWEST + (1 << 64) // FRACTION
ROW = ["doc", "no_id", "h"]  # what tells distinct rows apart: id and hash of the text
BLANK = "[\\x20\\x09-\\x0D]+"


def word_hashes(text):
    """Hash of each word of a text column, lower-cased, in order; none for null and blank texts."""
    words = F.filter(F.split(F.lower(text), BLANK), lambda w: w != "")
    return F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def shingle_hashes(hashes, size=WORDS):
    """Hash of each run of ``size`` word hashes; fewer words are one run, no words none."""
    def run(i):
        return F.xxhash64(*(F.get(hashes, i + k) for k in range(size)))

    return F.when(F.size(hashes) >= size, F.transform(F.sequence(F.lit(0), F.size(hashes) - size), run)).when(
        F.size(hashes) > 0, F.array(F.xxhash64(F.concat_ws(",", hashes.cast("array<string>"))))).otherwise(
        F.array().cast("array<bigint>"))


def sketch(hashes, fraction=FRACTION):
    """The distinct hashes below the threshold and the smallest of all, in order.

    The smallest stays in any case, so that only a text without words has an empty sketch.
    The sketch of a union is the union of sketches, less kept smallest hashes that are neither
    below the threshold nor the smallest any more.
    """
    below = F.filter(hashes, lambda h: h < LOWEST + (1 << 64) // fraction)
    return F.coalesce(F.when(F.size(below) > 0, F.array_sort(F.array_distinct(below))).otherwise(
        F.filter(F.array(F.array_min(hashes)), lambda h: h.isNotNull())), F.array().cast("array<bigint>"))


def merged(a, b, fraction=FRACTION):
    """The sketch of two texts' shingles together, from their sketches."""
    return sketch(F.concat(a, b), fraction)


def text_of(sketch_column):
    """A sketch as text: 16 hex digits per hash."""
    return F.array_join(F.transform(sketch_column, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(a, b):
    """Estimated Jaccard similarity of two texts' shingles; 1 for equal sketches, also empty ones."""
    common = F.size(F.array_intersect(a, b))
    return F.when(a == b, 1.0).otherwise(common / (F.size(a) + F.size(b) - common).cast("double"))


def containment(a, b):
    """Estimated share of the shingles of ``a`` that ``b`` has; null if ``a`` has none."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a).cast("double"))


def fingerprints(docs, key="doc_id", text="text"):
    """(key, n_chars, sketch, fingerprint) of every row's whole text; a null text is an empty one."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), whole.alias("text_of_sketch"), word_hashes(whole).alias("hashes_of_sketch"))
    rows = rows.select(key, "text_of_sketch", shingle_hashes(F.col("hashes_of_sketch")).alias("hashes_of_sketch"))
    return rows.select(key, F.length("text_of_sketch").cast("long").alias("n_chars"), sketch(F.col("hashes_of_sketch")).alias("sketch")
                       ).withColumn("fingerprint", text_of(F.col("sketch")))


def _followers(groups):
    """(doc, no_id, h, gid, before, need): each distinct row's number, the one it follows, and the code points that one needs.

    Distinct rows are sorted by ranges and numbered by (task, place in it), so a row's
    follower has the next number, or is the first of the next task that has any; the last
    one's is the first of all.
    """
    ordered = stored(groups.orderBy("no_id", F.col("doc").desc(), "h").select(
        *ROW, "n", F.monotonically_increasing_id().alias("gid")))
    tasks = ordered.groupBy(F.shiftright("gid", 33).alias("task")).agg(
        F.min("gid").alias("first"), F.max_by(F.struct("gid", "n"), "gid").alias("last"))
    in_turn = Window.orderBy("task")  # one row per writing task
    around = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    borders = tasks.select(F.col("first").alias("gid"), F.coalesce(
        F.lag("last").over(in_turn), F.last("last").over(around)).alias("p")).select(
        "gid", F.col("p.gid").alias("before"), F.col("p.n").alias("n_before"))
    inner = ordered.select((F.col("gid") + 1).alias("gid"), F.col("gid").alias("before"), F.col("n").alias("n_before"))
    # The row behind a task's last one has no number of its own there, so borders and inner rows never meet.
    return ordered.join(inner.unionByName(borders), "gid").select(
        *ROW, "gid", "before", F.expr("n_before div 2").alias("need"))


def edited_documents(docs):
    """(doc_id, n_chars, sketch, edited_sha256, edited_sketch, next_sketch) of every row of ``docs``.

    Rows are in order of descending doc_id, null last, equal ids by the hash of their text. The
    edited text is the row's text with its last half replaced by the beginning of the next
    row's. Rows that agree in id and text are exchanged as one with its count, so a row with
    very many copies is no task of its own; of such rows all but the last have a copy of
    themselves as the next. Whole texts are exchanged once, halves once more.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    # Plain keys without nulls: the join then keeps the exchange of the aggregate below it.
    rows = docs.select(F.coalesce(doc, F.lit(0)).alias("doc"), doc.isNull().alias("no_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    groups = rows.select(*ROW, F.length("text").alias("n")).groupBy(*ROW).agg(F.first("n").alias("n"))
    texts = rows.groupBy(*ROW).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    named = texts.join(_followers(groups).hint("merge"), ROW).select(
        F.when(~F.col("no_id"), F.col("doc")).alias("doc"), "gid", "before", "need", "text", "copies",
        word_hashes(F.col("text")).alias("hashes"))
    named = named.select("doc", "gid", "before", "need", "text", "copies", shingle_hashes(F.col("hashes")).alias("hashes"))
    n = F.length("text")
    named = named.select("doc", "gid", "before", "copies", n.alias("n"), sketch(F.col("hashes")).alias("sketch"),
                         F.substring(F.col("text"), F.lit(1), n - F.expr("length(text) div 2")).alias("own"),
                         F.substring(F.col("text"), F.lit(1), F.col("need")).alias("given"))
    own = F.struct("doc", F.col("n"), "copies", "sketch", F.col("own").alias("piece"))
    given = F.struct(F.lit(None).cast("long").alias("doc"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("long").alias("copies"),
                     F.col("sketch"), F.col("given").alias("piece"))
    pieces = named.select(F.explode(F.array(
        F.struct(F.col("gid"), F.lit(True).alias("is_own"), own.alias("p")),
        F.struct(F.col("before").alias("gid"), F.lit(False).alias("is_own"), given.alias("p")))).alias("e")).select("e.*")
    met = pieces.groupBy("gid").agg(F.first(F.when(F.col("is_own"), F.col("p")), ignorenulls=True).alias("a"),
                                    F.first(F.when(~F.col("is_own"), F.col("p")), ignorenulls=True).alias("b"))
    half = F.expr("a.n div 2")
    last = F.struct(F.lit(1).cast("long").alias("times"), F.concat("a.piece", "b.piece").alias("edited"), F.col("b.sketch").alias("next_sketch"))
    # A row before a copy of itself gets the beginning of its own text, which its first half holds.
    copy = F.struct((F.col("a.copies") - 1).alias("times"), F.concat("a.piece", F.substring(F.col("a.piece"), F.lit(1), half)).alias("edited"),
                    F.col("a.sketch").alias("next_sketch"))
    found = met.select("a.doc", "a.n", "a.sketch", F.explode(
        F.when(F.col("a.copies") > 1, F.array(last, copy)).otherwise(F.array(last))).alias("e")).select("doc", "n", "sketch", "e.*")
    found = found.withColumn("hashes", word_hashes(F.col("edited")))
    found = found.select("doc", "n", "sketch", "times", "next_sketch", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                         shingle_hashes(F.col("hashes")).alias("hashes"))
    return found.select("doc", "n", "sketch", "times", "next_sketch", "edited_sha256", sketch(F.col("hashes")).alias("edited_sketch"))


def edited_likeness(docs):
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, kept_in_edited,
    kept_in_next) of every row.

    ``near_`` is the estimated Jaccard similarity of the row's fingerprint and the other,
    ``kept_in_`` the estimated share of its shingles that the other has. Null texts are
    empty; empty and blank texts have the empty fingerprint, which is like itself (1) and
    unlike any other (0), and no share. Repeated rows each get a row, rows without
    doc_id come last in the order; in a table of one row the next row is that row itself; an
    empty table gives no rows, further columns are ignored.
    """
    found = edited_documents(docs).select(
        "times", F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "edited_sha256",
        text_of(F.col("sketch")).alias("fingerprint"), text_of(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("kept_in_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("kept_in_next"))
    return found.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times", "col")
