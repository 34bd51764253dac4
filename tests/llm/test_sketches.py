"""Threshold-scaled sketches against plain sets of shingle hashes."""

import collections
import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from candlewright.llm import sketches

SCHEMA = "doc_id long, text string, sketch string, h string, n string, piece string, copies string"


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def plain_sketch(text, fraction=16):
    words = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    if len(words) >= 5:
        hashes = set()
        for i in range(len(words) - 4):
            h = 42
            for w in words[i:i + 5]:
                h = xxhash.xxh64_intdigest(struct.pack("<q", w), h)
            hashes.add(signed(h))
    elif words:
        hashes = {signed(xxhash.xxh64_intdigest(",".join(map(str, words)).encode(), 42))}
    else:
        return []
    below = sorted(h for h in hashes if h < -(1 << 63) + (1 << 64) // fraction)
    return below or [min(hashes)]


def hexed(hashes):
    return "".join(f"{h & (1 << 64) - 1:016x}" for h in hashes)


def like(a, b):
    return 1.0 if a == b else len(set(a) & set(b)) / len(set(a) | set(b))


def plain(rows):
    h = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42))
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), h(r[1])))
    out = []
    for i, (d, t) in enumerate(ordered):
        after, half = ordered[(i + 1) % len(ordered)][1], len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        a, b, c = plain_sketch(t), plain_sketch(edited), plain_sketch(after)
        share = [len(set(a) & set(x)) / len(a) if a else None for x in (b, c)]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), like(a, b), like(a, c), *share))
    return sorted(out, key=repr)


def found(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, sketches.edited_likeness(df).collect()), key=repr)


def texts(n, seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Émile", "ŒUVRE", "straße", "日本語", "\U0001F600"]
    return [(i * 3 - 50, draw.choice([" ", "\n", "  ", "\t"]).join(draw.choices(words, k=draw.choice([0, 1, 4, 5, 6, 40, 300]))))
            for i in range(n)]


def test_fingerprints_edits_nulls_and_repeated_rows(spark):
    rows = texts(90, 1)
    rows += rows[:5] * 3 + [(7, "one text"), (7, "another text"), (7, None), (7, ""), (None, "no id"), (None, None), (None, rows[8][1])]
    rows += [(400, " \n\t "), (401, "a b c d e " * 20000)]
    assert found(spark, rows) == plain(rows)


def test_very_many_copies_of_one_row_and_of_one_id(spark):
    rows = [(5, "the same words again and again in this text")] * 400 + [(5, f"other {i}") for i in range(50)] + texts(20, 2)
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[(1, "only one row with some words in it")], [(1, "twice")] * 2, [(None, None)]])
def test_single_rows(spark, rows):
    assert found(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert found(spark, []) == []
    assert sketches.fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []


def test_equal_texts_and_merged_sketches(spark):
    rows = [(i, t) for i, (_, t) in enumerate(texts(40, 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in sketches.fingerprints(df).collect()}
    assert all(got[i].sketch == plain_sketch(t) and got[i].fingerprint == hexed(plain_sketch(t)) for i, t in rows)
    pairs = spark.createDataFrame([(got[i].sketch, got[i + 1].sketch) for i in range(0, 40, 2)], "a array<long>, b array<long>")
    merged = [r[0] for r in pairs.select(sketches.merged(F.col("a"), F.col("b"))).collect()]
    for k, m in enumerate(merged):
        both = sorted(set(got[2 * k].sketch) | set(got[2 * k + 1].sketch))
        assert m == ([h for h in both if h < sketches.THRESHOLD] or both[:1])


def test_containment_of_a_short_text_in_a_long_one(spark):
    draw = random.Random(4)
    words = [f"w{draw.randrange(10 ** 6)}" for _ in range(20000)]
    short, long, other = " ".join(words[5000:6500]), " ".join(words), " ".join(reversed(words))
    df = spark.createDataFrame([(1, short), (2, long), (3, other)], "doc_id long, text string")
    s = {r.doc_id: r.sketch for r in sketches.fingerprints(df).collect()}
    rows = spark.createDataFrame([(s[1], s[2], s[3])], "a array<long>, b array<long>, c array<long>")
    inside, back, none = rows.select(*(sketches.containment(F.col(x), F.col(y)) for x, y in ("ab", "ba", "ac"))).first()
    assert inside == 1.0 and abs(back - 0.075) < 0.02 and none < 0.01


def test_no_python_and_two_exchanges_of_texts(spark):
    df = spark.createDataFrame(texts(50, 5), "doc_id long, text string")
    plan = sketches.edited_likeness(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    exchanged = collections.Counter(line.split("Exchange")[1].split("(")[1].split(")")[0] for line in plan.splitlines() if "Exchange hash" in line)
    assert sum(exchanged.values()) <= 6, plan
