"""Span columns shared by the scans for personal data and for secrets."""

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F


def joined(spans):
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan(docs, find, kinds):
    """(doc_id, n_<kind> ..., base_sha256, spans, added) of every row's whole text.

    ``find`` gives (base spans, added spans) of a text in their order of output. Null texts
    are empty; every row, repeated or not, gets its own; an empty table gives none.
    """
    names = ["doc_id", *(f"n_{k}" for k in kinds), "base_sha256", "spans", "added"]
    types = [pa.int64(), *[pa.int64()] * len(kinds), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0), b.column(1)):
                base, every = find(text.as_py() or "")
                counts = [sum(k == kind for k, _, _ in base) for kind in kinds]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((doc_id.as_py(), *counts, digest, joined(every), len(every) - len(base)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(zip(*rows), types)] if rows
                else [pa.array([], type=t) for t in types], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, " + ", ".join(f"n_{k} long" for k in kinds) + ", base_sha256 string, spans string, added long")


def free(spans, taken):
    """The spans that overlap none of ``taken``; both are (kind, start, end)."""
    taken = sorted((s, e) for _, s, e in taken)
    out, i = [], 0
    for span in sorted(spans, key=lambda s: s[1]):
        while i < len(taken) and taken[i][1] <= span[1]:
            i += 1
        if i == len(taken) or taken[i][0] >= span[2]:
            out.append(span)
    return out
