"""Near duplicates by SimHash fingerprints and multi-index hashing."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from candlewright.llm.common import ROW, doc_of_row, let_go, quoted, row_keys, stored
from candlewright.llm.graph import components

BLOCK = 1 << 15
U8 = np.dtype("<u8")

# The 64 bits of a fingerprint in three segments (first bit, bits).
SEGMENTS = ((0, 21), (21, 21), (42, 22))

# The index of near copies: 128 bits of words in six segments, and the most bits in which
# 256 bits of shingles may differ for the sets to be compared: 0.8 similar sets differ in
# 39 bits on average, with a deviation of six.
WORD_SEGMENTS = tuple((half, first, bits) for half in (0, 1) for first, bits in ((0, 21), (21, 21), (42, 22)))
SHINGLE_DISTANCE = 60

# A label of so many nodes is a large group; its common shingles are taken from so many of its nodes.
LARGE_GROUP, SAMPLE = 32, 25


def _majority(hashes):
    """Bits set in over half of the hashes (rows of ``hashes``, 64 bits a column)."""
    n, width = hashes.shape
    counts = np.zeros(64 * width, dtype=np.int64)
    for i in range(0, n, BLOCK):
        part = np.ascontiguousarray(hashes[i:i + BLOCK])
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n, bitorder="little").view(U8)


def shingle_hashes(words, size):
    """XXH64 (seed 42) of each run of ``size`` words, repeats included; short texts are one run."""
    if not words:
        return np.zeros(0, dtype=U8)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > size:
        starts, ends = starts[:len(words) - size + 1], ends[size - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist())),
                       dtype=U8, count=len(starts))


def _words(text):
    return (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits


def fingerprint(text, size=3):
    """64-bit SimHash of a text given as UTF-8 bytes; none or no words: zero."""
    hashes = shingle_hashes(_words(text), size)
    return int(_majority(hashes.reshape(-1, 1))[0]) if len(hashes) else 0


def _mixed(x, seed):
    """Another 64-bit hash of each hash."""
    with np.errstate(over="ignore"):
        x = x + U8.type(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> U8.type(30))) * U8.type(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U8.type(27))) * U8.type(0x94D049BB133111EB)
        return x ^ (x >> U8.type(31))


def shingle_set(text, size=5):
    """The distinct shingle hashes of a text given as UTF-8 bytes, in order."""
    return np.unique(shingle_hashes(_words(text), size))


def signature(text, size=5):
    """(hash of the shingle set, its size, 2 x 64 bits of the words, 4 x 64 bits of the set), bits zero without words."""
    shingles, wide = shingle_set(text, size), []
    if not len(shingles):
        return [_node(shingles), 0] + [0] * 6
    for h, parts in ((shingle_hashes(_words(text), 1), 2), (shingles, 4)):
        bits = _long_majority(h, parts) if len(h) > BLOCK else _majority(
            np.stack([_mixed(h, k) for k in range(parts)], axis=1))
        wide += [int(v) for v in bits]
    return [_node(shingles), len(shingles), *wide]


def _node(shingles):
    return xxhash.xxh64_intdigest(shingles.tobytes(), 42)


def _long_majority(h, parts):
    return np.concatenate([_majority(_mixed(h, k).reshape(-1, 1)) for k in range(parts)])


def _signed(values):
    return np.array(values, dtype=U8).view(np.int64)


def fingerprints(docs, size=3, key="doc_id", text="text"):
    """(key, fp long) of every document's whole text."""
    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), size) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_signed(fps))], names=[key, "fp"])

    return docs.select(F.col(key), F.col(text).cast("binary")).mapInArrow(
        run, f"{key} {docs.schema[key].dataType.simpleString()}, fp long")


def _keep(segment):
    first, bits = segment
    mask = (1 << 64) - 1 - ((1 << bits) - 1 << first)
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps):
    """Pairs (a, b) of distinct fingerprints that differ in one or two bits, each once.

    There is one table per segment, keyed by the fingerprint without that segment. A
    pair that differs in one segment only meets under its plain key there. A pair with
    one bit in each of two segments meets where one of them is left out and the other
    is looked up with every ball of radius one; only the fingerprint in which that bit
    is zero looks, so that nothing is found twice. Keys have 42 or 43 bits, so that the
    fingerprints of many similar texts spread over many buckets.
    """
    keys, probes = [], []
    for t, segment in enumerate(SEGMENTS):
        keep, (first, bits) = _keep(segment), SEGMENTS[(t + 1) % 3]
        keys.append(f"array(named_struct('t', {t}, 'k', fp & {keep}L, 'near', false))")
        probes.append(f"transform(filter(sequence({first}, {first + bits - 1}), i -> getbit(fp, i) = 0), "
                      f"i -> named_struct('t', {t}, 'k', (fp | shiftleft(1L, i)) & {keep}L, 'near', true))")
    own = fps.selectExpr("fp AS b", f"explode(concat({', '.join(keys)})) AS e").selectExpr("b", "e.t", "e.k")
    asked = fps.selectExpr("fp AS a", f"explode(concat({', '.join(keys + probes)})) AS e").selectExpr(
        "a", "e.t", "e.k", "e.near")
    return asked.join(own, ["t", "k"]).where(
        "CASE WHEN near THEN bit_count(a ^ b) = 2 ELSE a < b AND bit_count(a ^ b) <= 2 END").select("a", "b")


def simhash_components(docs, size=3):
    """(doc_id, fp, component_id): documents linked by fingerprints two or fewer bits apart.

    Null, empty and blank texts have fingerprint zero and link like any other; repeated
    rows each get a row; a component's id is its smallest doc_id, null only if all its
    rows have none; an empty table gives no rows. Copies meet as one fingerprint before
    any search.
    """
    fps = stored(fingerprints(docs, size))
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = stored(components(links(distinct)).withColumnRenamed("node", "fp"))
    linked = stored(labels.join(distinct, "fp"))
    lowest = stored(linked.groupBy("component").agg(F.min("first").alias("component_id")))
    known = stored(distinct.join(
        linked.join(lowest, "component").select("fp", "component_id"), "fp", "left").select(
        "fp", F.coalesce("component_id", "first").alias("component_id")))
    return fps.join(known, "fp").select("doc_id", "fp", "component_id")


def signatures(docs, size=5):
    """(doc_of_row, no_id_of_row, hash_of_row, node, sizes and bits) of every row."""
    names = ["node", "n", "w0", "w1", *SHINGLE_BITS]

    def run(batches):
        for b in batches:
            sig = _signed([signature(t.as_py(), size) for t in b.column(3)]).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(sig[:, i]) for i in range(len(names)))],
                                             names=[*ROW, *names])
        let_go()

    return docs.select(*row_keys(), F.col("text").cast("binary")).mapInArrow(
        run, f"{ROW[0]} long, {ROW[1]} boolean, {ROW[2]} long, " + ", ".join(f"{c} long" for c in names))


def shingle_sets(docs, size=5):
    """(node, shingles) of every document: the hash of its shingle set, and the set."""
    def run(batches):
        for b in batches:
            sets = [shingle_set(t.as_py(), size) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed([_node(x) for x in sets])), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))],
                names=["node", "shingles"])
        let_go()

    return docs.select(F.col("text").cast("binary")).mapInArrow(run, "node long, shingles array<long>")


def copy_groups(docs, size=5):
    """(doc_of_row, no_id_of_row, hash_of_row, lead) of every row; ``lead`` is the first such row of its group.

    Groups join documents by shingle sets that are 0.8 similar or more. Shingles of five
    words change with every word, so that texts 0.8 similar differ in a
    sixth of their shingle bits, too many to look up. The index is therefore built on
    128 bits over single words, in which such texts differ in few: six segments, each
    looked up with its ball of radius one, find every pair up to eleven bits apart. The
    distance of 256 bits over the shingles drops pairs that are far from similar; the
    others are accepted by the exact Jaccard similarity of their shingle sets. Documents
    with one set meet as one. Each bucket's members first meet two of them, and labels
    from those links keep the search from listing the inner links of large groups. Around a
    large group the remaining pairs must also share what its members have besides the
    group's common shingles, see :func:`_with_homes`. Documents without words, null texts among them, form one group. The first row of a
    group has the smallest doc_id, rows without one come last, then the smallest hash of the text.
    """
    sig = stored(signatures(docs, size))
    row = F.struct(ROW[1], ROW[0], ROW[2])
    alike = stored(sig.groupBy("node").agg(F.min(F.struct(row.alias("row"), "n", "w0", "w1", *SHINGLE_BITS)).alias("m"))
                   .select("node", "m.*"))
    labelled = alike.withColumn("label", F.col("node"))
    met = stored(_pivot_pairs(labelled))
    labelled = stored(_relabelled(labelled, _similar(met, alike, docs, size)))
    labelled = _with_homes(labelled, met, alike, docs, size)
    inner = stored(_central_pairs(labelled))
    labelled = stored(_relabelled(labelled, _similar(inner, alike, docs, size)))
    seen = met.select("a", "b").union(inner.select("a", "b"))
    rest = stored(_pairs_between(labelled).join(seen, ["a", "b"], "left_anti"))
    known = stored(_relabelled(labelled, _similar(rest, alike, docs, size)).select("node", "row", F.col("label").alias("group")))
    lowest = stored(known.groupBy("group").agg(F.min("row").alias("lead")))
    return sig.select(*ROW, "node").join(known.select("node", "group").join(lowest, "group").drop("group"), "node").select(
        *ROW, "lead")


def near_copies(docs, size=5):
    """(doc_id, component_id) of every row: the smallest doc_id of its group of near copies, null if none has an id."""
    return copy_groups(docs, size).select(doc_of_row().alias("doc_id"), F.when(
        ~F.col(f"lead.{ROW[1]}"), F.col(f"lead.{ROW[0]}")).alias("component_id"))


def _sets_of(nodes, alike, docs, size):
    """(node, shingles) of the ``nodes``, from one row of each."""
    wanted = stored(nodes.join(alike, "node").select("row.*"))
    return shingle_sets(docs.select("text", *row_keys()).join(wanted, ROW, "left_semi"), size).dropDuplicates(["node"])


def _with_homes(labelled, met, alike, docs, size):
    """``labelled`` and, around large groups, a node's ``home`` and its shingles ``extra`` to that group's common ones.

    Members of a large group have most of its shingles, also where two of them are less
    than 0.8 similar, so that they meet in every bucket. A node's home is its own label if that is
    large, or the largest label that a node it met has. The common shingles of a home are those
    of more than half of 25 members; which ones they are decides only how much is saved:
    sets a, b with a similarity of 0.8 leave at most (5 n_a - 4 n_b) / 9 of a outside b. If
    more of a than that is extra, then b has some of it, and it is extra there too.
    """
    size_of = stored(labelled.groupBy("label").agg(F.count("*").alias("members")).where(F.col("members") >= LARGE_GROUP))
    own = labelled.join(size_of, "label").select("node", F.struct("members", "label").alias("h"))
    known = labelled.select("node", "label")
    met_by = met.select(F.col("a").alias("node"), F.col("b").alias("other")).union(met.select("b", "a"))
    through = met_by.join(known.withColumnRenamed("node", "other"), "other").join(size_of, "label").select(
        "node", F.struct("members", "label").alias("h"))
    homes = stored(own.union(through).groupBy("node").agg(F.max("h").alias("h")).select(
        "node", F.col("h.label").alias("home")))
    sample = stored(labelled.join(size_of.select(F.col("label")), "label", "left_semi").withColumn("place", F.row_number().over(
        Window.partitionBy("label").orderBy("node"))).where(F.col("place") <= SAMPLE).select("node", "label"))
    common = stored(_sets_of(sample.select("node"), alike, docs, size).join(sample, "node").select(
        F.col("label").alias("home"), F.explode("shingles").alias("s")).groupBy("home", "s").agg(F.count("*").alias("n")).where(
        F.col("n") > SAMPLE // 2).groupBy("home").agg(F.collect_list("s").alias("common")))
    extra = _sets_of(homes.select("node"), alike, docs, size).join(homes, "node").join(common, "home").select(
        "node", "home", F.array_except("shingles", "common").alias("extra"))
    return stored(labelled.join(stored(extra), "node", "left"))


def _relabelled(labelled, links):
    """``labelled`` with one label for all nodes whose labels the ``links`` (label_a, label_b) join."""
    joined = stored(components(links.select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))).withColumnsRenamed(
        {"node": "label", "component": "low"}))
    return labelled.join(joined, "label", "left").withColumn("label", F.coalesce("low", "label")).drop("low")


def _similar(pairs, alike, docs, size):
    """The ``pairs`` (a, b, further columns) of nodes whose shingle sets have a Jaccard similarity of 0.8 or more."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = stored(_sets_of(nodes, alike, docs, size))
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a").join(
        sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b")
    return both.where("9 * size(array_intersect(x, y)) >= 4 * (size(x) + size(y))").select(*pairs.columns)


SHINGLE_BITS = ("s0", "s1", "s2", "s3")


def _segment_keys():
    """SQL of a signature's key in each word segment, and of its ball of radius one there."""
    keys, balls = [], []
    for t, (half, first, width) in enumerate(WORD_SEGMENTS):
        part = f"shiftrightunsigned(w{half}, {first}) & {(1 << width) - 1}L"
        keys.append(f"{t}L + 6L * ({part})")
        balls.append(f"transform(filter(sequence(0, {width - 1}), i -> getbit(w{half}, {first} + i) = 0), "
                     f"i -> {t}L + 6L * (({part}) | shiftleft(1L, i)))")
    return keys, balls


def _first_segment(other):
    """SQL: the first word segment in which both are at most one bit apart."""
    return "CASE " + " ".join(
        f"WHEN bit_count(shiftrightunsigned(w{half} ^ {other}.w{half}, {first}) & {(1 << width) - 1}L) <= 1 THEN {t}L"
        for t, (half, first, width) in enumerate(WORD_SEGMENTS)) + " END"


def _near(other):
    """SQL: the sizes allow a similarity of 0.8, and the shingle bits are no farther apart than such sets are."""
    return f"5 * least(n, {other}.n) >= 4 * greatest(n, {other}.n) AND " + " + ".join(
        f"bit_count({s} ^ {other}.{s})" for s in SHINGLE_BITS) + f" <= {SHINGLE_DISTANCE}"


def _pivot_pairs(labelled):
    """(a, b, label_a, label_b) of each bucket's nodes with the smallest and the largest node in it.

    They are as many as the nodes, however large a group of near copies is, and
    join most of such a group, whose inner links then need not be listed.
    """
    keys, _ = _segment_keys()
    filed = labelled.selectExpr("node", "label", "n", *SHINGLE_BITS, f"explode(array({', '.join(keys)})) AS k")
    row = F.struct("node", "label", "n", *SHINGLE_BITS)
    ends = filed.groupBy("k").agg(F.min(row).alias("low"), F.max(row).alias("high")).where("low.node < high.node")
    met = filed.join(ends, "k").selectExpr("node", "label", "n", *SHINGLE_BITS, "explode(array(low, high)) AS pivot")
    return met.where("label <> pivot.label AND " + _near("pivot")).selectExpr(
        *_ordered("node", "label", "pivot.node", "pivot.label")).distinct()


def _central_pairs(labelled):
    """(a, b, label_a, label_b) of each node with the node of its home that has the fewest extra shingles."""
    row = F.struct(F.size("extra").alias("e"), "node", "label", "n", *SHINGLE_BITS)
    at_home = labelled.where("home IS NOT NULL")
    centre = at_home.groupBy("home").agg(F.min(row).alias("centre"))
    return at_home.join(centre, "home").where("label <> centre.label AND " + _near("centre")).selectExpr(
        *_ordered("node", "label", "centre.node", "centre.label")).distinct()


def _ordered(a, label_a, b, label_b):
    return (f"least({a}, {b}) AS a", f"greatest({a}, {b}) AS b", f"IF({a} < {b}, {label_a}, {label_b}) AS label_a",
            f"IF({a} < {b}, {label_b}, {label_a}) AS label_b")


def _pairs_between(labelled):
    """(a, b, label_a, label_b) of nodes with different labels that may be similar.

    Pairs of one home of which neither has more extra shingles than similar sets leave
    out meet in the index like all others; pairs in which one has more meet by what they share of it.
    A pair comes out of the index once, from the first segment in which it can be found.
    """
    keys, balls = _segment_keys()
    bits = ", ".join(repr(s) + ", " + s for s in SHINGLE_BITS)
    own = f"named_struct('n', n, 'w0', w0, 'w1', w1, 'home', home, 'e', size(extra), {bits}) AS own"
    filed = labelled.selectExpr("node AS b", "label AS label_b", own, f"explode(array({', '.join(keys)})) AS k")
    asked = labelled.selectExpr("node AS a", "label AS label_a", "n", "w0", "w1", "home", "size(extra) AS e", *SHINGLE_BITS,
                                f"posexplode(concat(array({', '.join(keys)}), {', '.join(balls)})) AS (place, k)")
    at_home = "home IS NOT NULL AND own.home IS NOT NULL AND home = own.home"
    few = "9 * e <= 5 * n - 4 * own.n AND 9 * own.e <= 5 * own.n - 4 * n"
    met = asked.join(filed, "k").where(
        f"label_a <> label_b AND (place >= {len(keys)} OR a < b) AND (NOT ({at_home}) OR {few}) AND "
        + _near("own") + f" AND k % 6 = {_first_segment('own')}")
    shared = labelled.where("home IS NOT NULL").selectExpr("node", "label", "n", "home", "size(extra) AS e", *SHINGLE_BITS, "explode(extra) AS s")
    other = shared.selectExpr("home", "s", "node AS b", "label AS label_b", f"named_struct('n', n, 'e', e, {bits}) AS own")
    forced = shared.withColumnsRenamed({"node": "a", "label": "label_a"}).join(other, ["home", "s"]).where(
        f"a < b AND label_a <> label_b AND NOT ({few}) AND " + _near("own"))
    pair = _ordered("a", "label_a", "b", "label_b")
    return met.selectExpr(*pair).union(forced.selectExpr(*pair)).distinct()


def keep_one(docs):
    """The documents without near copies, columns unchanged: of each group the first row stays.

    First is the smallest doc_id, then the smallest hash of the text; rows without doc_id
    come last, and only real copies go, whichever ids they have. Rows that agree in doc_id
    and text are one document, of which one row stays.
    """
    lead = copy_groups(docs).where(F.struct(ROW[1], ROW[0], ROW[2]) == F.col("lead")).select(*ROW).distinct()
    names = [f"column_{i}_of_row" for i in range(len(docs.columns))]
    whole = docs.select(*row_keys(), *(c.alias(n) for c, n in zip(quoted(docs.columns), names)))
    return whole.join(lead, ROW, "left_semi").dropDuplicates(ROW).select(
        *(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
