"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first."""

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from candlewright.llm.common import stored

SAMPLE = 16384  # vectors, by hashed id, that the first tree is fitted on; every vector is indexed
BOUND, SUB = 2048, 4096  # vectors above which a leaf gets a tree of its own; those, by hashed id, that it is fitted on
BRANCH, LEAF = 8, 256  # children of a node; sample vectors below which a node is a leaf
LLOYD = 8
CALIBRATION = 128  # vectors, by hashed id, whose exact neighbours calibrate the search
TARGET = 0.97  # recall of the calibration set at which widening ends, over all levels of trees
PART, CHUNK = 4096, 8192  # vectors and queries that meet in a task at a time
BLOCK = 512  # queries that are multiplied with the vectors of a part at a time
SEED = 42


def unit(x):
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tree:
    """Nodes of unit centres; a node's children are nodes, or leaves as -1 - leaf."""

    def __init__(self, sample, branch=BRANCH, leaf=LEAF, seed=SEED):
        self.nodes, self.leaves = [], 0
        self.branch, self.leaf, self.rng = branch, leaf, np.random.default_rng(seed)
        self.root = self._grow(unit(np.unique(np.asarray(sample, dtype=np.float64), axis=0)))

    def _new_leaf(self):
        self.leaves += 1
        return -self.leaves

    def _grow(self, x):
        if len(x) <= self.leaf:
            return self._new_leaf()
        centres = x[np.sort(self.rng.choice(len(x), min(self.branch, len(x)), replace=False))]
        for _ in range(LLOYD):
            near = (x @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
        near = (x @ centres.T).argmax(axis=1)
        used = np.unique(near)
        if len(used) < 2:
            return self._new_leaf()
        at = len(self.nodes)
        self.nodes.append(None)
        self.nodes[at] = (centres[used], [self._grow(x[near == c]) for c in used])
        return at

    def assign(self, x):
        """The leaf of each unit vector, going down to the nearest centre."""
        out = np.zeros(len(x), dtype=np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if at < 0:
                out[rows] = -1 - at
            elif len(rows):
                centres, children = self.nodes[at]
                near = (x[rows] @ centres.T).argmax(axis=1)
                todo += [(child, rows[near == c]) for c, child in enumerate(children)]
        return out

    def visits(self, q, reached=0.0):
        """(leaf, distance reached) in the order of a best-bin-first traversal from the unit vector ``q``.

        A queue holds every node and leaf that was seen but not opened, the one with the
        nearest centre first. The distance reached is the largest of an opened centre so far,
        beginning with ``reached``: merged by it, the traversals of several trees are in the
        order of one queue for all of them.
        """
        queue, n = [(0.0, 0, self.root)], 1
        while queue:
            d, _, at = heapq.heappop(queue)
            reached = max(reached, d)
            if at < 0:
                yield -1 - at, reached
            else:
                centres, children = self.nodes[at]
                for d, child in zip((1 - centres @ q).tolist(), children):
                    heapq.heappush(queue, (d, n, child))
                    n += 1


def usable(vectors):
    """(vec_id, embedding as doubles) of the vectors that take part, one row per vec_id.

    Null, zero and non-finite vectors, those with null components, those whose length is
    not the most common one, and rows without vec_id are left out; of several rows with
    one vec_id the smallest vector counts.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = v.where("vec_id IS NOT NULL AND v IS NOT NULL").where(F.expr(
        "forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)"))
    fine = fine.groupBy("vec_id").agg(F.min("v").alias("v"))
    lengths = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return fine.where(F.size("v") == (lengths.n if lengths else 0))


def _matrix(column):
    return np.stack(column.to_numpy()).astype(np.float64)


def _scores(q, v):
    """Cosine of one vector with each row, always summed in the same order."""
    return (v * q).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum()))


def _best(queries, ids, vectors, k):
    """(place of query, vec_id, score) of the ``k`` best candidates of each query but itself."""
    units = unit(vectors).T
    for i, (own, q) in enumerate(zip(queries["query_id"], queries["v"])):
        if i % BLOCK == 0:
            near = unit(_matrix(queries["v"].iloc[i:i + BLOCK])) @ units
        s = np.where(ids == own, -np.inf, near[i % BLOCK])
        if len(s) > k:
            rows = np.nonzero(s >= np.partition(s, -k)[-k] - 1e-9)[0]
        else:
            rows = np.arange(len(s))
        rows = rows[ids[rows] != own]
        exact = _scores(np.asarray(q, dtype=np.float64), vectors[rows])
        for j in np.lexsort((ids[rows], -exact))[:k]:
            yield own, int(ids[rows[j]]), float(exact[j])


def _ranked(found, k):
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _indexed(candidates, tree):
    shared = candidates.sparkSession.sparkContext.broadcast(tree)  # bounded by the sample

    @F.pandas_udf("string")
    def leaf(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.assign(unit(_matrix(v))) if len(v) else [], dtype="int64").astype(str)

    return stored(candidates.withColumn("leaf", leaf("v")))


def _spread(table, trees, id_column, size):
    """(rows below the leaves that have a tree, those trees), grouped by leaf and part for a cogroup.

    A leaf's rows are dealt over parts of about ``size``, each of which gets the tree.
    """
    counts = stored(table.join(trees.select("leaf"), "leaf").groupBy("leaf").agg(F.ceil(F.count("*") / size).alias("parts")))
    dealt = table.join(counts, "leaf").withColumn("part", F.pmod(F.xxhash64(id_column), "parts")).drop("parts")
    copies = trees.join(counts, "leaf").select("leaf", "tree", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
    return dealt.groupBy("leaf", "part"), copies.groupBy("leaf", "part")


def deepened(index, bound=BOUND, size=SUB, branch=BRANCH, leaf=LEAF):
    """(index, trees): leaves above ``bound`` vectors are split by trees of their own, level by level.

    A leaf's tree is fitted on at most ``size`` of its vectors, chosen by hashed id, in a task of its
    own, and kept in a table (leaf, tree), one table a level. The leaves below leaf ``a`` are named
    ``a/0``, ``a/1`` and so on. A leaf whose vectors all point the same way stays as it is.
    """
    levels = []

    def fit(frame):
        tree = Tree(_matrix(frame["v"]), branch, leaf)
        return pd.DataFrame({"leaf": frame["leaf"].iloc[:1], "tree": [pickle.dumps(tree)], "leaves": [tree.leaves]})

    def file(rows, trees):
        if not len(rows):
            return rows[["vec_id", "v", "leaf"]]
        below = pickle.loads(trees["tree"].iloc[0]).assign(unit(_matrix(rows["v"])))
        return rows[["vec_id", "v"]].assign(leaf=rows["leaf"] + "/" + pd.Series(below, rows.index).astype(str))

    while True:
        large = index.where(F.size(F.split("leaf", "/")) == len(levels) + 1).groupBy("leaf").count().where(
            F.col("count") > bound).select("leaf")
        order = Window.partitionBy("leaf").orderBy(F.xxhash64("vec_id"), "vec_id")
        chosen = index.join(large, "leaf").withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)
        trees = stored(chosen.select("leaf", "v").groupBy("leaf").applyInPandas(
            fit, "leaf string, tree binary, leaves long").where("leaves > 1").select("leaf", "tree"))
        if trees.isEmpty():
            return index, levels
        rows, copies = _spread(index, trees, "vec_id", PART)
        split = rows.cogroup(copies).applyInPandas(file, "vec_id long, v array<double>, leaf string")
        kept = index.join(trees.select("leaf"), "leaf", "left_anti").select("vec_id", "v", "leaf")
        index = stored(kept.unionByName(split))
        levels.append(trees)


def _descended(asked, trees, least):
    """``asked`` (query_id, v, leaf, reached) with each leaf that has a tree replaced by the leaves below it.

    Of each tree the first ``least`` leaves of a query, all if that is None: later ones cannot
    be among its first ``least`` over all trees.
    """
    columns = ["query_id", "v", "leaf", "reached"]

    def walk(rows, trees):
        out = []
        if len(rows):
            tree = pickle.loads(trees["tree"].iloc[0])
            for own, q, v, leaf, reached in zip(rows["query_id"], unit(_matrix(rows["v"])), rows["v"], rows["leaf"], rows["reached"]):
                for n, (below, d) in enumerate(tree.visits(q, reached)):
                    if least is not None and n >= least:
                        break
                    out.append((own, v, f"{leaf}/{below}", d))
        return pd.DataFrame(out, columns=columns)

    rows, copies = _spread(asked, trees, "query_id", CHUNK)
    below = rows.cogroup(copies).applyInPandas(walk, "query_id long, v array<double>, leaf string, reached double")
    return asked.join(trees.select("leaf"), "leaf", "left_anti").select(*columns).unionByName(below)


def _order():
    return Window.partitionBy("query_id").orderBy("reached", "leaf")


def _first(asked, held, visits, k):
    """The first ``visits`` leaves of each query, and more while those hold at most ``k`` vectors."""
    before = F.coalesce(F.sum("held").over(_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return asked.join(held, "leaf").withColumn("place", F.row_number().over(_order())).withColumn("before", before).where(
        (F.col("place") <= visits) | (F.col("before") <= k)).select("query_id", "v", "leaf", "reached")


def _widened(needed, target, most):
    """Visits, widened by a quarter at a time, after which a share ``target`` of ``needed`` places was visited."""
    visits = 1
    while (needed < visits).mean() < target and visits < most:
        visits = min(most, visits + max(1, visits // 4))
    return visits


def calibration(index, k, size=CALIBRATION):
    """(calibration queries, their exact neighbours with the leaf of each).

    The queries are compared with every row, in blocks where the rows lie. Both are small
    tables on the driver.
    """
    chosen = index.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).select(
        F.col("vec_id").alias("query_id"), "v").toPandas()
    shared = index.sparkSession.sparkContext.broadcast(chosen)  # at most ``size`` vectors

    def exact(frames):
        for f in frames:
            if len(f):
                leaf_of = dict(zip(f["vec_id"], f["leaf"]))
                rows = list(_best(shared.value, f["vec_id"].to_numpy(), _matrix(f["v"]), k))
                yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).assign(
                    leaf=[leaf_of[r[1]] for r in rows])

    if not len(chosen):
        return chosen, pd.DataFrame({"query_id": [], "leaf": []})
    return chosen, _ranked(index.select("vec_id", "leaf", "v").mapInPandas(
        exact, "query_id long, vec_id long, score double, leaf string"), k).select("query_id", "leaf").toPandas()


def calibrated_visits(spark, tree, levels, chosen, true, held, k, target=TARGET):
    """Leaves to visit at each level, so that the exact neighbours of a calibration set are found.

    At each level visits widen by a quarter until the share of true neighbours in visited
    leaves reaches its target; the levels share what ``target`` allows to be missed.
    """
    if not len(true):
        return [1] * (len(levels) + 1)
    path = true["leaf"].str.split("/")
    orders = {q: {leaf: n for n, (leaf, _) in enumerate(tree.visits(v))} for q, v in zip(
        chosen["query_id"], unit(_matrix(chosen["v"])))}
    needed = np.array([orders[q][int(p[0])] for q, p in zip(true["query_id"], path)])
    allowed = (1 - target) / (len(levels) + 1)
    out = [_widened(needed, 1 - allowed, tree.leaves)]
    if levels:
        asked = spark.createDataFrame(chosen, "query_id long, v array<double>")
        asked = stored(_visited(asked, tree, held[0], out[0], k))
    for depth, trees in enumerate(levels, 2):
        met = pd.DataFrame({"query_id": true["query_id"], "leaf": path.str[:depth].str.join("/")})
        met["pair"] = range(len(met))
        below = stored(_descended(asked, trees, None))
        places = below.select("query_id", "leaf", (F.row_number().over(_order()) - 1).alias("place")).join(
            spark.createDataFrame(met), ["query_id", "leaf"]).select("pair", "place").collect()
        needed = np.full(len(met), np.inf)
        for r in places:
            needed[r["pair"]] = r["place"]
        most = below.groupBy("query_id").count().agg(F.max("count")).first()[0]
        out.append(_widened(needed, 1 - depth * allowed, most))
        if depth <= len(levels):
            asked = stored(_first(below, held[depth - 1], out[-1], k))
    return out


def _visited(rows, tree, held, visits, k):
    """(query_id, v, leaf, reached): the leaves of the first tree that each query visits."""
    counts = np.zeros(tree.leaves, dtype=np.int64)
    for r in held.collect():  # one row per leaf of the sampled tree
        counts[int(r["leaf"])] = r["held"]
    shared = rows.sparkSession.sparkContext.broadcast((tree, counts))

    @F.pandas_udf("array<struct<leaf: string, reached: double>>")
    def to_visit(v: pd.Series) -> pd.Series:
        tree, counts = shared.value
        out = []
        for q in unit(_matrix(v)) if len(v) else ():
            leaves, seen = [], 0
            for leaf, reached in tree.visits(q):
                if len(leaves) >= visits and seen > k:
                    break
                leaves.append({"leaf": str(leaf), "reached": reached})
                seen += counts[leaf]
            out.append(leaves)
        return pd.Series(out, dtype="object")

    return rows.withColumn("visit", F.explode(to_visit("v"))).select("query_id", "v", "visit.leaf", "visit.reached")


def nearest(vectors, queries_where, k=5, bound=BOUND):
    """(query_id, rank, vec_id, score): for each query the ``k`` nearest vectors by cosine.

    Queries are the usable vectors that fulfil ``queries_where``; candidates are all but
    the query's own. The first tree is fitted on a bounded sample; every vector is filed in
    its leaf, and leaves of more than 2048 vectors get trees of their own, level by level, so
    that leaves do not grow with the table. Each query visits as many leaves of each level as
    calibration asks for, the nearest over all trees of the level first, and more
    while they hold too few candidates. Of equal vectors only the k + 1 smallest ids can be
    among the nearest, so the others are not filed. Leaves are compared in parts of about
    4096 vectors with chunks of about 8192 queries, so no leaf is one task. Equal scores
    go to the smaller vec_id. No usable vectors: no rows.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = Tree(_matrix(sample["v"]))
    copies = Window.partitionBy("v").orderBy("vec_id")
    index, levels = deepened(_indexed(
        rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy"), tree), bound)
    # What each leaf of a level holds; the leaves of a level are the beginnings of the last level's names.
    held = [stored(index.groupBy(F.substring_index("leaf", "/", n).alias("leaf")).agg(F.count("*").alias("held")))
            for n in range(1, len(levels) + 2)]
    visits = calibrated_visits(spark, tree, levels, *calibration(index, k), held, k)
    asked = stored(_visited(rows.where(queries_where).select(F.col("vec_id").alias("query_id"), "v"), tree, held[0], visits[0], k))
    for n, trees in enumerate(levels, 1):
        asked = stored(_first(_descended(asked, trees, max(visits[n], k + 2)), held[n], visits[n], k))
    chunks = asked.groupBy("leaf").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    sizes = stored(held[-1].select("leaf", F.ceil(F.col("held") / PART).alias("parts")).join(chunks, "leaf"))
    filed = index.join(sizes, "leaf").select(
        "leaf", F.pmod(F.xxhash64("vec_id"), "parts").alias("part"), "vec_id", "v",
        F.explode(F.expr("sequence(0L, chunks - 1)")).alias("chunk"))
    wanted = asked.join(sizes, "leaf").select(
        "leaf", F.pmod(F.xxhash64("query_id"), "chunks").alias("chunk"), "query_id", "v",
        F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))

    def compare(queries, candidates):
        found = _best(queries, candidates["vec_id"].to_numpy(), _matrix(candidates["v"]), k) \
            if len(queries) and len(candidates) else ()
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["leaf", "part", "chunk"]
    found = wanted.groupBy(*keys).cogroup(filed.groupBy(*keys)).applyInPandas(
        compare, "query_id long, vec_id long, score double")
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
