"""Centroid clustering of integer vectors with Shallot search."""

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from candlewright.llm.common import release, stored

DIMENSIONS = 64
CLUSTERS, ROUNDS, SEED = 16, 3, 1
SCALE = 64  # steps of one unit of a component
BLOCK = 2048  # vectors that one row of the block table holds
NARROW = 1 << 26  # integers below it have squared distances below 2^60
LONG = (1 << 63) - 1
SLACK = 1e-9  # relative error that bounds kept as doubles may have

BLOCKS = ("wide boolean, vectors binary, ids array<long>, first array<int>, second array<int>, upper array<double>, "
          "lower array<double>, distance array<string>, sums array<struct<cluster:int,n:long,inertia:string,total:array<string>>>, "
          "compared long")
ARROW = pa.schema([
    ("wide", pa.bool_()), ("vectors", pa.binary()), ("ids", pa.list_(pa.int64())), ("first", pa.list_(pa.int32())),
    ("second", pa.list_(pa.int32())), ("upper", pa.list_(pa.float64())), ("lower", pa.list_(pa.float64())),
    ("distance", pa.list_(pa.string())),
    ("sums", pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("inertia", pa.string()),
                                 ("total", pa.list_(pa.string()))]))), ("compared", pa.int64())])


def integers(x):
    """floor(64 x) of finite doubles; Python integers where a squared distance could pass a long."""
    x = np.asarray(x, dtype=np.float64)
    if not x.size or np.abs(x).max() < NARROW // SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    # A double times 64 may pass the largest double, so very large ones are scaled as integers.
    big = [[int(np.floor(v * SCALE)) if abs(v) < 2.0 ** 900 else int(v) * SCALE for v in row]
           for row in x.tolist()]
    return np.array(big, dtype=object)


def _squared(x, c):
    d = x - c
    return (d * d).sum(axis=-1)


def _root(d2):
    if d2.dtype != object:
        return np.sqrt(d2)
    flat = [math.sqrt(d) if d < 1 << 1000 else float(r) if (r := math.isqrt(d)) < 1 << 1000 else math.inf for d in d2.ravel()]
    return np.array(flat, dtype=np.float64).reshape(d2.shape)


class Centroids:
    """Centroids with their mutual distances, sorted for each, and how far the last update moved them."""

    def __init__(self, vectors, before=None):
        self.vectors = vectors
        d2 = np.array([[int(_squared(a, b)) for b in vectors] for a in vectors], dtype=object).reshape(len(vectors), -1)
        self.apart = _root(d2)
        self.near = np.argsort(self.apart, axis=1, kind="stable")
        moved = [int(_squared(a, b)) for a, b in zip(vectors, vectors if before is None else before)]
        self.moved = _root(np.array(moved, dtype=object)) * (1 + SLACK)
        self.moved_besides = np.array([max([m for j, m in enumerate(self.moved) if j != i], default=0.0)
                                       for i in range(len(vectors))])


def shallot(x, centroids, first, second, upper, lower):
    """(first, second, upper, lower, comparisons): the two nearest centroids of each vector of ``x``.

    ``upper`` bounds the distance to ``first`` and ``lower`` that to every other centroid;
    a vector keeps its centroid where the moved bounds still part them. The others are
    compared with their two centroids, and the neighbours of the closer one are scanned in
    order of distance to it. By the triangle inequality a centroid can only come before
    the second nearest if it lies within (distance to the start + distance to the second
    nearest so far) of the start, so that ball shrinks as nearer ones are met. Survivors are
    compared by integer squared distances, ties go to the smaller number. A ``first`` of -1
    stands for a vector without a history.
    """
    c, k = centroids.vectors, len(centroids.vectors)
    first, second, upper, lower = first.copy(), second.copy(), upper.copy(), lower.copy()
    fresh = first < 0
    first[fresh], second[fresh] = 0, min(1, k - 1)
    upper += centroids.moved[first]
    lower -= centroids.moved_besides[first]
    rows = np.nonzero(fresh | ~(upper * (1 + SLACK) < lower * (1 - SLACK)))[0]
    compared = 0
    if k == 1:
        upper[rows], lower[rows] = _root(_squared(x[rows], c[0])), np.inf
        return first, second, upper, lower, len(rows)
    a, b = first[rows].astype(np.int64), second[rows].astype(np.int64)
    da, db = _squared(x[rows], c[a]), _squared(x[rows], c[b])
    compared += 2 * len(rows)
    swap = (db < da) | ((db == da) & (b < a))
    a, b, da, db = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, db, da), np.where(swap, da, db)
    start, second_start, reach = a.copy(), b.copy(), _root(da)
    for s in np.unique(start):
        active = np.nonzero(start == s)[0]
        for j in centroids.near[s]:
            active = active[centroids.apart[s, j] * (1 - SLACK) <= (reach[active] + _root(db[active])) * (1 + SLACK)]
            if not len(active):
                break
            own = active[second_start[active] != j]
            if j == s or not len(own):
                continue
            d = _squared(x[rows[own]], c[j])
            compared += len(own)
            nearer = (d < da[own]) | ((d == da[own]) & (j < a[own]))
            between = ~nearer & ((d < db[own]) | ((d == db[own]) & (j < b[own])))
            n, m = own[nearer], own[between]
            b[n], db[n] = a[n], da[n]
            a[n], da[n] = j, d[nearer]
            b[m], db[m] = j, d[between]
    first[rows], second[rows], upper[rows], lower[rows] = a, b, _root(da), _root(db)
    return first, second, upper, lower, compared


def _text(n):
    return str(int(n))


def _batch(wide, x, ids, state, distance, sums, compared):
    first, second, upper, lower = state
    raw = "\n".join(",".join(map(_text, v)) for v in x).encode() if wide else x.astype(np.int32).tobytes()
    return pa.RecordBatch.from_pylist([{
        "wide": wide, "vectors": raw, "ids": ids, "first": first.tolist(), "second": second.tolist(), "upper": upper.tolist(),
        "lower": lower.tolist(), "distance": distance, "sums": sums, "compared": compared}], schema=ARROW)


def _vectors(wide, raw):
    if wide:
        return np.array([[int(n) for n in line.split(",")] for line in raw.decode().split("\n")], dtype=object)
    return np.frombuffer(raw, dtype=np.int32).reshape(-1, DIMENSIONS).astype(np.int64)


def _blocks(rows):
    """Rows (id, vector) as a table of blocks without a history."""
    def run(batches):
        held = {True: ([], []), False: ([], [])}

        def block(wide):
            ids, x = held[wide]
            n = len(ids)
            held[wide] = ([], [])
            return _batch(wide, np.array(x, dtype=object if wide else np.int64).reshape(n, DIMENSIONS), ids,
                          (np.full(n, -1), np.full(n, -1), np.zeros(n), np.zeros(n)), [], [], 0)

        for b in batches:
            x = np.asarray(b.column(1).flatten().cast(pa.float64())).reshape(-1, DIMENSIONS)
            narrow = (np.abs(x) < NARROW // SCALE).all(axis=1)
            ids = b.column(0).to_pylist()
            for wide in (False, True):
                own = np.nonzero(narrow != wide)[0]
                for start in range(0, len(own), BLOCK):
                    part = own[start:start + BLOCK]
                    held[wide][0].extend(ids[i] for i in part)
                    held[wide][1].extend(integers(x[part]))
                    if len(held[wide][0]) >= BLOCK:
                        yield block(wide)
        for wide in (False, True):
            if held[wide][0]:
                yield block(wide)

    return rows.mapInArrow(run, BLOCKS)


def _assigned(blocks, centroids):
    """The blocks with every vector at its nearest centroid, and each block's sums per cluster."""
    shared = blocks.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        c = shared.value
        for b in batches:
            for i in range(b.num_rows):
                wide = b.column(0)[i].as_py()
                x, ids = _vectors(wide, b.column(1)[i].as_py()), b.column(2)[i].as_py()
                history = [np.asarray(b.column(k)[i].values) for k in range(3, 7)]
                *state, compared = shallot(x, c, *history)
                distance = _squared(x, c.vectors[state[0]])
                sums = []
                for cluster in np.unique(state[0]).tolist():
                    own = state[0] == cluster
                    sums.append({"cluster": cluster, "n": int(own.sum()), "inertia": _text(sum(distance[own].tolist())),
                                 "total": [_text(v) for v in x[own].sum(axis=0)]})
                yield _batch(wide, x, ids, state, [_text(d) for d in distance], sums, compared)

    return blocks.mapInArrow(run, BLOCKS)


def _summed(batches):
    """One row per cluster and eight components for all blocks of a task."""
    found = {}
    for b in batches:
        for row in b.column(0).to_pylist():
            for s in row:
                n, inertia, total = found.get(s["cluster"], (0, 0, [0] * DIMENSIONS))
                found[s["cluster"]] = (n + s["n"], inertia + int(s["inertia"]), [a + int(t) for a, t in zip(total, s["total"])])
    yield pa.RecordBatch.from_pylist(
        [{"cluster": c, "part": i // 8, "n": n, "inertia": _text(inertia), "total": list(map(_text, total[i:i + 8]))}
         for c, (n, inertia, total) in found.items() for i in range(0, DIMENSIONS, 8)],
        schema=pa.schema([("cluster", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("inertia", pa.string()),
                          ("total", pa.list_(pa.string()))]))


def _totals(blocks):
    """{cluster: (vectors, inertia, componentwise sums)} in Python integers.

    Blocks have summed up their own vectors; each task adds up its blocks, and one row per
    cluster, eight components and task is exchanged, so 16 clusters make 128 rows for the driver.
    """
    schema = "cluster int, part int, n long, inertia string, total array<string>"

    def add(frame):
        total = [0] * 8
        for row in frame["total"]:
            total = [a + int(b) for a, b in zip(total, row)]
        return pd.DataFrame({
            "cluster": [frame["cluster"].iloc[0]], "part": [frame["part"].iloc[0]], "n": [frame["n"].sum()],
            "inertia": [str(sum(map(int, frame["inertia"])))], "total": [[str(t) for t in total]]})

    found = {}
    parts = blocks.select("sums").mapInArrow(_summed, schema)
    for r in parts.groupBy("cluster", "part").applyInPandas(add, schema).orderBy("cluster", "part").collect():
        n, inertia, total = found.get(r.cluster, (r.n, int(r.inertia), []))
        found[r.cluster] = (n, inertia, total + [int(t) for t in r.total])
    return found


def usable(embeddings, ident="vec_id", vector="embedding"):
    """(id, v array<double>) of rows whose vector has exactly 64 components, none null or non-finite."""
    return embeddings.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        f"size(v) = {DIMENSIONS} AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")


def _seeds(rows, clusters):
    """The vectors with the smallest hashes of their ids, in order of the hashes; equal ids by their components."""
    hashed = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("id").cast("string")), 256))
    found = hashed.orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).select("v").collect()
    return integers(np.array([r.v for r in found]).reshape(len(found), DIMENSIONS))


def clustered(embeddings, clusters=CLUSTERS, rounds=ROUNDS, ident="vec_id", vector="embedding"):
    """(blocks, centroids, totals) after ``rounds`` of assigning and moving and one more assignment.

    Vectors stay in blocks, together with their bounds; a round reads and writes the
    block table once, without an exchange, and deletes the one before. Only each block's sums
    per cluster are exchanged.
    """
    rows = usable(embeddings, ident, vector)
    blocks, vectors, before = stored(_blocks(rows)), _seeds(rows, clusters), None
    if not len(vectors):
        return blocks, vectors, {}
    for left in range(rounds, -1, -1):
        old, blocks = blocks, stored(_assigned(blocks, Centroids(vectors, before)))
        release(old)
        totals = _totals(blocks)
        if left:
            moved = [[t // totals[i][0] for t in totals[i][2]] if i in totals else [int(v) for v in c]
                     for i, c in enumerate(vectors)]
            wide = any(abs(v) >= NARROW for m in moved for v in m)
            before, vectors = vectors, np.array(moved, dtype=object if wide else np.int64)
    return blocks, vectors, totals


def clusters_of(embeddings, clusters=CLUSTERS, rounds=ROUNDS, ident="vec_id", vector="embedding"):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector.

    Vectors that are null, of another length or hold null or non-finite components give no
    row. Every row counts as a vector: repeated ids and repeated rows each get one, ids
    may be null (such rows are seeds last). Fewer vectors than clusters give as many
    clusters as vectors; equal seeds leave the later ones empty. Components of any finite
    size are compared exactly; distances and sums that a long cannot hold come out as null.
    An empty table gives no rows; further columns are ignored.
    """
    blocks, vectors, totals = clustered(embeddings, clusters, rounds, ident, vector)

    def fits(n):
        return n if n <= LONG else None

    names = [(i, fits(inertia), fits(sum(t[1] for t in totals.values())),
              hashlib.sha256(",".join(map(_text, vectors[i])).encode()).hexdigest()) for i, (_, inertia, _) in totals.items()]
    of_cluster = embeddings.sparkSession.createDataFrame(
        names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = blocks.select(F.explode(F.arrays_zip("ids", "first", "distance")).alias("v")).select(
        F.col("v.ids").alias("vec_id"), F.col("v.first").alias("cluster"), F.expr("try_cast(v.distance AS bigint)").alias("distance"))
    return rows.join(F.broadcast(of_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
