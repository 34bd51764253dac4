"""Conversations as a trie of their prefixes, rolled up by centroid decomposition of its parent edges."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from candlewright.llm.common import release, stored, word_count

FAMILY = 20  # conversations whose first turns come from the first of them
LARGE = 1 << 16  # rows of a component that is split on the cluster; smaller ones are split inside a task
RUN = 1 << 16  # turns of a conversation whose running sums are formed together
CHUNK = 1 << 16  # ids whose text is one row on the way to a node's hash
NODE = ["rep", "depth"]


def ordered_turns(conversations):
    """(conv_id, turn number from 1, h1, h2, words) of every row, numbered in order within its conversation.

    Rows are exchanged once by ranges of (conversation, turn, role, text), which also
    splits a conversation that holds many of all rows; a task numbers its stretch of each
    conversation, and the stretches' lengths, one row per conversation and task, give the
    rest of the number. Texts end here: two hashes of (role, text) stand for them.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn_no"), role.alias("role"), text.alias("text"))
    order = [F.col("conv"), F.col("turn_no").asc_nulls_first(), F.col("role"), F.col("text")]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("second"), "role", "text").alias("h2"),
        word_count(F.col("text")).alias("words"))

    def numbered(batches):
        last, upto = None, 0
        for b in batches:
            conv = np.asarray(b.column(0))
            if not len(conv):
                continue
            begins = np.concatenate(([conv[0] != last], conv[1:] != conv[:-1]))
            starts = np.nonzero(begins)[0]
            at = np.arange(len(conv)) - np.maximum.accumulate(np.where(begins, np.arange(len(conv)), 0)) + 1
            head = starts[0] if len(starts) else len(conv)
            at[:head] += upto  # the stretch that the batch before began
            last, upto = conv[-1], int(at[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=["conv", "h1", "h2", "words", "at"])

    numbers = stored(sorted_rows.mapInArrow(numbered, "conv long, h1 long, h2 long, words long, at long").withColumn(
        "part", F.spark_partition_id()))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = numbers.groupBy("conv", "part").agg(F.count("*").alias("n")).select(
        "conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return numbers.join(parts, ["conv", "part"]).select("conv", (F.col("offset") + F.col("at")).alias("at"), "h1", "h2", "words")


def rebuilt(turns):
    """(convs, rows) of the rebuilt conversations: (conv, length) and (conv, depth, h1, h2, words).

    Of the turns before a conversation's own only the first three of a family's first
    conversation are ever used, so the join's side is bounded per key.
    """
    keep = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    base = F.col("conv") - F.col("conv") % FAMILY
    own = turns.groupBy("conv").agg(F.count("*").alias("own")).select("conv", "own", keep.alias("h"), base.alias("base"))
    given = own.where(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("base"), F.col("own").alias("given"))
    convs = own.join(given, "base", "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("given", F.lit(0))).alias("taken"),
        (F.least("h", F.coalesce("given", F.lit(0))) + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    convs = stored(convs)
    heads = turns.where((F.col("at") <= 3) & (F.col("conv") % FAMILY == 0)).withColumnRenamed("conv", "base")
    first = convs.join(heads, "base").where("at <= h").select("conv", "length", F.col("at").alias("depth"), "h1", "h2", "words")
    rest = turns.join(convs, "conv").where("at > h").select(
        "conv", "length", (F.col("taken") + F.col("at") - F.col("h")).alias("depth"), "h1", "h2", "words")
    return convs, first.unionByName(rest)


def _prefixes(rows):
    """``rows`` with four sums that stand for the prefix up to each turn.

    A prefix is the set of its (depth, role, text), so the running sum of their hashes
    identifies it: twice 64 bits, in halves that cannot overflow. Sums run over stretches of
    65,536 turns, and over the stretches' totals, so a long conversation is many tasks.
    """
    marks = rows.select("*", F.xxhash64("h1", "depth").alias("a"), F.xxhash64("h2", "depth", F.lit(1)).alias("b"),
                        F.expr(f"(depth - 1) div {RUN}").alias("run"))
    halves = {"p0": F.col("a").bitwiseAND(0xFFFFFFFF), "p1": F.shiftrightunsigned("a", 32),
              "p2": F.col("b").bitwiseAND(0xFFFFFFFF), "p3": F.shiftrightunsigned("b", 32)}
    marks = stored(marks.select("conv", "length", "depth", "run", "words", *(c.alias(n) for n, c in halves.items())))
    inside = Window.partitionBy("conv", "run").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    long = marks.where(f"length > {RUN}").groupBy("conv", "run").agg(*(F.sum(c).alias(c) for c in halves))
    starts = long.select("conv", "run", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias("s" + c) for c in halves))
    sums = marks.select("conv", "length", "depth", "run", "words", *(F.sum(c).over(inside).alias(c) for c in halves))
    return sums.join(starts, ["conv", "run"], "left").select(
        "conv", "length", "depth", "words", *(
            (F.col(c) + F.coalesce("s" + c, F.lit(0))).alias(c) for c in halves)), list(halves)


def trie(conversations):
    """(convs, places, nodes) of the prefix trie.

    A node is named by its smallest member ``rep`` and its ``depth``. Places: (conv, depth, rep,
    above): the node of each conversation at each depth and the one above it, so that
    ancestors are looked up and never walked to. Nodes: (rep, depth, above, n_convs, words,
    weight), where the weight of a subtree is the number of its members' turns in it.
    """
    turns = stored(ordered_turns(conversations))
    convs, rows = rebuilt(turns)
    sums, keys = _prefixes(rows)
    sums = stored(sums)
    classes = stored(sums.groupBy("depth", *keys).agg(
        F.min("conv").alias("rep"), F.count("*").alias("n_convs"), F.min("words").alias("words"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight")))
    placed = stored(sums.select("conv", "depth", *keys).join(classes.select("depth", *keys, "rep"), ["depth", *keys]).select(
        "conv", "depth", "rep"))
    root = convs.agg(F.min("conv").alias("rep"), F.count("*").alias("n"), F.sum(F.col("length") + 1).alias("w")).first()
    above = placed.select("conv", (F.col("depth") + 1).alias("depth"), F.col("rep").alias("above"))
    places = stored(placed.join(above, ["conv", "depth"], "left").withColumn("above", F.coalesce("above", F.lit(root[0]))))
    nodes = classes.select(*NODE, "n_convs", "words", "weight").join(
        places.where("conv = rep").select("rep", "depth", "above"), NODE).select(
        *NODE, "above", "n_convs", "words", "weight")
    release(turns, sums, placed)
    if root[0] is not None:
        nodes = nodes.unionByName(conversations.sparkSession.createDataFrame(
            [(root[0], 0, None, root[1], 0, root[2])], "rep long, depth long, above long, n_convs long, words long, weight long"))
    return convs, places, stored(nodes)


def ends(convs, places):
    """(rep, depth, ends_sha256) of nodes at which conversations end.

    The hash of a list is sequential, but its text is not: tasks make ordered chunks of the
    ids' text by ranges of (node, conversation), and one task per node feeds its chunks to
    the hash one by one.
    """
    root = convs.agg(F.min("conv")).first()[0]
    last = convs.join(places.select("conv", F.col("depth").alias("length"), "rep"), ["conv", "length"], "left").select(
        F.coalesce("rep", F.lit(root)).alias("rep"), F.col("length").alias("depth"), "conv")
    order = ["rep", "depth", "conv"]

    def chunks(batches):
        held, names = [], ["rep", "depth", "first", "text"]

        def chunk():
            return pa.RecordBatch.from_pydict({"rep": [held[0][0]], "depth": [held[0][1]], "first": [held[0][2]],
                                               "text": [",".join(str(r[2]) for r in held)]}, schema=pa.schema(
                [(n, pa.string() if n == "text" else pa.int64()) for n in names]))

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and (held[0][:2] != row[:2] or len(held) >= CHUNK):
                    yield chunk()
                    held = []
                held.append(row)
        if held:
            yield chunk()

    def hashes(batches):
        node, digest, out = None, None, []
        schema = pa.schema([("rep", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])

        def batch():
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)

        for b in batches:
            for rep, depth, text in zip(*(b.column(i) for i in range(3))):
                at = rep.as_py(), depth.as_py()
                if at != node:
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest = at, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.as_py().encode())
            if len(out) >= 4096:
                yield batch()
                out = []
        if node:
            out.append((*node, digest.hexdigest()))
        yield batch()

    texts = last.repartitionByRange(*order).sortWithinPartitions(*order).select(*order).mapInArrow(
        chunks, "rep long, depth long, first long, text string")
    return texts.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "first").select(
        "rep", "depth", "text").mapInArrow(hashes, "rep long, depth long, ends_sha256 string")


def component_totals(parent, weight, values):
    """Sums of ``values`` (a list of columns) over the subtree of each node of one tree.

    ``parent`` holds places of parents, -1 for the top, which comes before all others like
    any parent before its children; ``weight`` is each subtree's weight and balances the work.
    A component is split at its centroid, the deepest node with half the component's
    weight below it; the total of what hangs from the centroid is added to the nodes on the
    path from it to the component's top, and the parts go on by themselves.
    """
    n = len(parent)
    children, weight = [[] for _ in range(n)], list(weight)
    for i, p in enumerate(parent):
        if p >= 0:
            children[p].append(i)
    out, tops = [[0] * n for _ in values], [0] if n else []
    parent = list(parent)
    while tops:
        top = tops.pop()
        centroid, all_of_it = top, weight[top]
        while True:
            heavy = next((c for c in children[centroid] if 2 * weight[c] >= all_of_it), None)
            if heavy is None:
                break
            centroid = heavy
        below, totals = [centroid], [0] * len(values)
        for i in below:
            below += children[i]
            for k, v in enumerate(values):
                totals[k] += v[i]
        hangs, at = weight[centroid], centroid
        while True:
            for k, t in enumerate(totals):
                out[k][at] += t
            if at == top:
                break
            at = parent[at]
            weight[at] -= hangs
        tops += children[centroid]
        if centroid != top:
            children[parent[centroid]].remove(centroid)
            tops.append(top)
    return out


def _inside_tasks(nodes, values):
    """``values`` of components (rows comp_rep, comp_depth) summed over subtrees, whole components in one task."""
    names = ["comp_rep", "comp_depth", *NODE, "above", "weight", *values]
    schema = pa.schema([(c, pa.int64()) for c in (*NODE, *values)])

    def solve(rows):
        place, parent = {}, []
        for i, (_, _, rep, depth, above, *_) in enumerate(rows):
            parent.append(place.get((above, depth - 1), -1))
            place[rep, depth] = i
        columns = list(zip(*rows))
        return [columns[2], columns[3], *component_totals(parent, columns[5], columns[6:])]

    def run(batches):
        held, out = [], [[] for _ in schema.names]

        def close():
            for o, c in zip(out, solve(held)):
                o.extend(c)

        def batch():
            done = pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], schema=schema)
            for o in out:
                o.clear()
            return done

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0][:2] != row[:2]:
                    close()
                    held = []
                held.append(row)
            if len(out[0]) >= 4096:
                yield batch()
        if held:
            close()
        yield batch()

    return nodes.select(*names).repartition("comp_rep", "comp_depth").sortWithinPartitions(
        "comp_rep", "comp_depth", "depth").mapInArrow(run, ", ".join(f"{c} long" for c in (*NODE, *values)))


def rollup(nodes, places, values, large=LARGE):
    """(rep, depth, one column per name of ``values``): their sums over each node's subtree.

    Centroid decomposition of the parent edges. In each round every component whose weight
    is above ``large`` is split at its centroid, the deepest node under which half of that
    weight lies. What lies under it is told by looking up the ancestor at the centroid's
    depth; its totals are added to the nodes between the centroid and the top; the
    subtrees of the centroid's children and the rest above are components of their own, each
    of at most half the weight. Rounds therefore grow with the logarithm of the largest
    component, also where the trie is one long path, and small components, nearly all after
    the first round, are finished inside tasks.
    """
    spark = nodes.sparkSession
    top = nodes.where("depth = 0").select("rep").first()
    schema = ", ".join(f"{c} long" for c in (*NODE, *values))
    if top is None:
        return spark.createDataFrame([], schema)
    # Stored, so that the planner does not turn joins on the one component into products.
    live = stored(nodes.select(*NODE, "above", "weight", *values, F.lit(top[0]).alias("comp_rep"), F.lit(0).cast("long").alias("comp_depth")))
    comp, added, steps = ["comp_rep", "comp_depth"], [], [live]
    while True:
        total = live.where("rep = comp_rep AND depth = comp_depth").select(*comp, F.col("weight").alias("all_of_it"))
        total = stored(total.where(F.col("all_of_it") > large))
        if total.isEmpty():
            break
        big = live.join(total, comp)
        centroids = stored(big.where("2 * weight >= all_of_it").groupBy(*comp).agg(
            F.max(F.struct("depth", "rep", "weight")).alias("c")).select(
            *comp, F.col("c.rep").alias("c_rep"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight")))
        small = live.join(total, comp, "left_anti")
        # The ancestor under the centroid's depth, and the one at it, of every deeper node.
        step = live.join(centroids, comp)
        deeper = step.where("depth > c_depth").join(
            places.select(F.col("conv").alias("rep"), (F.col("depth") - 1).alias("c_depth"), F.col("rep").alias("child"),
                          F.col("above").alias("at_c")), ["rep", "c_depth"])
        under = stored(deeper.where("at_c = c_rep").select(
            *NODE, "above", "weight", *values, F.col("child").alias("new_rep"), (F.col("c_depth") + 1).alias("new_depth"), *comp))
        centre = step.where("rep = c_rep AND depth = c_depth")
        sums = stored(under.select(*comp, *values).unionByName(centre.select(*comp, *values)).groupBy(*comp).agg(
            *(F.sum(v).alias(v) for v in values)))
        # The path from the centroid to the top of its component, the centroid included.
        path = centroids.join(sums, comp).join(
            places.select(F.col("conv").alias("c_rep"), "depth", "rep"), "c_rep").where("depth <= c_depth AND depth >= comp_depth")
        path = path.select(*NODE, *comp, "c_rep", "c_depth", "c_weight", *values).unionByName(
            centroids.where("comp_depth = 0").join(sums, comp).select(
                F.col("comp_rep").alias("rep"), F.lit(0).cast("long").alias("depth"), *comp, "c_rep", "c_depth", "c_weight", *values))
        path = stored(path)
        added.append(path.select(*NODE, *values))
        over = step.join(path.select(*NODE, F.col("c_weight").alias("hangs")), NODE, "left").where(
            "NOT (rep = c_rep AND depth = c_depth)")
        rest = over.join(under.select(*NODE), NODE, "left_anti").select(
            *NODE, "above", (F.col("weight") - F.coalesce("hangs", F.lit(0))).alias("weight"), *values, *comp)
        parts = under.select(*NODE, "above", "weight", *values, F.col("new_rep").alias("comp_rep"), F.col("new_depth").alias("comp_depth"))
        live = stored(small.unionByName(rest).unionByName(parts))
        release(*steps, total, centroids, sums, under)
        steps = [live]
    added.append(_inside_tasks(live, values))
    every = added[0]
    for a in added[1:]:
        every = every.unionByName(a)
    return every.groupBy(*NODE).agg(*(F.sum(v).alias(v) for v in values))


def prefix_trie(conversations, large=LARGE):
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    Turns are ordered with null first, equal turns by role and text; null roles and texts
    are empty; repeated rows are turns of their own. Rows without conv_id belong to no
    conversation and are left out. A turnless rebuilt conversation ends at the root. An
    empty table has no conversation and gives no rows. Further columns are ignored.
    """
    convs, places, nodes = trie(conversations)
    children = nodes.where("depth > 0").groupBy(F.col("above").alias("rep"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children"))
    shaped = stored(nodes.join(children, NODE, "left").select(
        *NODE, "above", "n_convs", "weight", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")))
    summed = rollup(shaped, places, ["n_leaves", "saved_tokens"], large)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return shaped.drop("n_leaves", "saved_tokens").join(summed, NODE).join(ends(convs, places), NODE, "left").select(
        F.col("rep").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
