"""Licence scans by digests of canonical texts."""

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from candlewright.llm.common import ROW, doc_of_row, row_keys

from candlewright.llm.licence_texts import EQUIVALENT, TEXTS

COPYRIGHT = re.compile(r"^\W*(?:copyright|copyleft|\(c\)|©|all rights reserved)(?!\s+(?:notice|holder|owner|law))", re.I)
MARK = re.compile(r"[^\w.]+|(?<!\d)\.|\.(?!\d)|_", re.U)
COMMENT = re.compile(r"^\s*(?:/\*+|\*+/|\*|//+|#+|;+|--|<!--|%+|rem\b)?\s*", re.I)
_SPELLINGS = {old: new for old, new in EQUIVALENT}


def line_words(line):
    """Canonical words of a line: comment marks, case, punctuation and spellings evened out.

    A line that states a copyright has none, so that holders and years do not matter.
    """
    line = COMMENT.sub("", unicodedata.normalize("NFKC", line), count=1)
    if COPYRIGHT.match(line):
        return []
    words = MARK.sub(" ", line.lower().replace("’", "'").replace("'", "")).split()
    return [_SPELLINGS.get(w, w) for w in words]


def canonical(text):
    return [w for line in re.split("\r\n|[\n\r\u2028\u2029]", text) for w in line_words(line)]


def digest(words):
    return hashlib.sha256(" ".join(words).encode("utf-8", "replace")).hexdigest()


def known_digests(spark, texts=None):
    """(digest, licence, form, words) of the known texts; ``texts``: rows (licence, form, text)."""
    rows = {}
    for licence, form, text in TEXTS if texts is None else texts:
        words = canonical(text)
        if words:
            rows.setdefault(digest(words), (licence, form, len(words)))
    return spark.createDataFrame([(d, *r) for d, r in sorted(rows.items())],
                                 "digest string, licence string, form string, words long")


def line_runs(text, lengths):
    """(digest, start, end, whole) of every run of whole lines with one of the given word counts.

    The whole text is the longest run. Each line with words may begin runs; sums of word
    counts tell which later line would end one, so that only runs of a known length are
    hashed.
    """
    lines, at = [], 0
    for m in re.finditer("[^\n\r\u2028\u2029]*(?:\r\n|[\n\r\u2028\u2029]|$)", text):
        words = line_words(m.group())
        if words:
            lines.append((m.start(), m.start() + len(m.group().rstrip()), words))
    ends = {}
    total = 0
    for k, (_, _, words) in enumerate(lines):
        total += len(words)
        ends[total] = k
    begin = 0
    for k, (start, _, words) in enumerate(lines):
        for n in lengths:
            last = ends.get(begin + n)
            if last is not None and last >= k:
                run = [w for _, _, ws in lines[k:last + 1] for w in ws]
                yield digest(run), start, lines[last][1], k == 0 and last == len(lines) - 1
        begin += len(words)


def _runs_known(docs, known):
    """(columns of ROW, licence, form, start, end, whole)."""
    lengths = sorted(r[0] for r in known.select("words").distinct().collect())  # of the known texts

    def run(batches):
        schema = pa.schema([(ROW[0], pa.int64()), (ROW[1], pa.bool_()), (ROW[2], pa.int64()), ("digest", pa.string()),
                            ("start", pa.int64()), ("end", pa.int64()), ("whole", pa.bool_())])
        for b in batches:
            rows = []
            for doc, no_id, h, text in zip(*(b.column(i) for i in range(4))):
                text = text.as_py()
                if text:
                    rows += [(doc.as_py(), no_id.as_py(), h.as_py(), *r) for r in line_runs(text, lengths)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    runs = docs.select(*row_keys(), "text").mapInArrow(
        run, f"{ROW[0]} long, {ROW[1]} boolean, {ROW[2]} long, digest string, start long, end long, whole boolean")
    return runs.join(known, "digest").drop("digest", "words")


def found_licences(docs, known=None):
    """(doc_id, licence, form, start, end, whole) of the known licence texts in documents.

    Canonical digests of whole texts, and of every run of whole lines as long as a known
    text, are joined by hash with the digests of the known texts; start and end are code
    points of the text as it is, end exclusive. Null and empty texts hold none, repeated
    rows and repeated notices each count, an empty table gives no rows.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    return _runs_known(docs, known).select(doc_of_row().alias("doc_id"), "licence", "form", "start", "end", "whole")


def licence_report(docs, known=None):
    """One row per document row: its licences in order of name, notices, and whether one is all of it.

    Findings belong to a row's doc_id and text together, so that other rows with that id,
    or without any, have their own; rows that agree in both have the same report.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    found = _runs_known(docs, known).groupBy(*ROW).agg(
        F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences"),
        F.count_distinct("start", "end").alias("notices"), F.max("whole").alias("whole"))
    return docs.select(*row_keys()).join(found, ROW, "left").select(
        doc_of_row().alias("doc_id"), F.coalesce("licences", F.lit("")).alias("licences"),
        F.coalesce("notices", F.lit(0)).cast("long").alias("notices"), F.coalesce("whole", F.lit(False)).alias("whole"))
