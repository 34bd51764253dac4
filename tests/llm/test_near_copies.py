"""SimHash: fingerprints, links and components against plain loops."""

import random

import numpy as np

import pytest
import xxhash

from candlewright.llm import simhash
from candlewright.llm.graph import components

DOCS = "doc_id long, text string, component_id string, fp string"


def plain_fingerprint(text, size=3):
    words = (text or "").encode()
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in words).split()
    runs = [words[i:i + size] for i in range(max(1, len(words) - size + 1))] if words else []
    counts = [0] * 64
    for r in runs:
        h = xxhash.xxh64_intdigest(b" ".join(r), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(runs))


def plain_components(values, linked):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    values = sorted(values)
    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def test_fingerprint_of_awkward_texts():
    for text in (None, "", " \t\n", "One", "ONE two", "One two three", "Äb ÄB ab\x0bcd\x0c" * 9, "a " * 70000, "x" * 100000):
        assert simhash.fingerprint(text.encode() if text is not None else None) == plain_fingerprint(text)


def test_links_equal_brute_force(spark):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1, 1, 3, 7}
    for v in list(values):
        for _ in range(12):
            values.add(v ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
            values.add(v ^ 1 << rng.randrange(64))
    signed = {v - (1 << 64) if v >> 63 else v for v in values}
    near = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 2
    want = {(a, b) for a in signed for b in signed if a < b and near(a, b)}
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = [tuple(sorted(r)) for r in simhash.links(fps).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(300 + i, 300 + (i + 1) % 20) for i in range(20)]
    pairs += [(rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(40)] + [(9, 9), (None, 3), (5, 4), (4, 5), (5, 4)]
    rng.shuffle(pairs)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    known = {(a, b) for a, b in pairs if a is not None and a != b}
    nodes = {x for p in known for x in p}
    assert got == plain_components(nodes, lambda a, b: (a, b) in known or (b, a) in known)


def test_components_of_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    base = [[word() for _ in range(n)] for n in (400, 60, 8, 300)]
    texts = [" ".join(b) for b in base] + [None, "", "  \n", "One", "one", "two words"]
    for b in (base[0], base[3]):
        for k in range(12):
            changed = list(b)
            for _ in range(1 + k % 4):
                changed[rng.randrange(len(b))] = word()
            texts.append(" ".join(changed))
    texts += [texts[0]] * 30 + [texts[0].upper()]
    out = [(1000 - i, t, "x", "y") for i, t in enumerate(texts)]
    return out + [(None, texts[0], "x", "y"), out[0], out[0], (5, texts[1], None, None)]


def test_components_of_documents_equal_brute_force(spark, rows):
    got = simhash.simhash_components(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    prints = {t: plain_fingerprint(t) for _, t, _, _ in rows}
    label = plain_components(set(prints.values()), lambda a, b: bin(a ^ b).count("1") <= 2)
    lowest = {}
    for i, t, _, _ in rows:
        if i is not None:
            k = label[prints[t]]
            lowest[k] = min(i, lowest.get(k, i))
    want = sorted((i or -1, prints[t], lowest[label[prints[t]]]) for i, t, _, _ in rows)
    assert sorted((r.doc_id or -1, r.fp & (1 << 64) - 1, r.component_id) for r in got) == want


def test_no_documents(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_one_of_each_group_of_near_copies_stays(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    text_of = {i: t for i, t, _, _ in rows if i is not None}
    alike = {}
    for i, t in text_of.items():
        alike[i] = {j for j, u in text_of.items()
                    if (a := shingles(t)) == (b := shingles(u)) or len(a & b) / len(a | b) >= 0.85}
    ids = [i for i in got if i is not None]
    assert got.count(None) == 0 and len(ids) == len(set(ids))  # the row without an id is a copy of another
    for i in text_of:  # what went has a near copy that stays, by steps over near copies
        seen, todo = {i}, [i]
        while todo:
            todo = [j for k in todo for j in alike[k] if j not in seen and not seen.add(j)]
        assert seen & set(ids)
    far = [i for i, group in alike.items() if group == {i} and not any(
        (a := shingles(text_of[i])) and len(a & shingles(text_of[j])) / len(a) > 0.3 for j in text_of if j != i)]
    assert set(far) <= set(ids) and len(ids) < 25


def test_near_copies_are_those_of_exact_similarity(spark):
    """Swapped neighbours leave the words alone: pairs on both sides of 0.8, none lost by the index."""
    rng, texts, want = random.Random(11), [], []
    for swaps in (5, 6, 7, 8, 9, 10) * 20:
        words = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(400)]
        other = list(words)
        for i in range(swaps):
            at = 20 + 35 * i
            other[at], other[at + 1] = other[at + 1], other[at]
        a, b = " ".join(words), " ".join(other)
        texts += [a, b]
        x, y = shingles(a), shingles(b)
        want.append(len(x & y) / len(x | y) >= 0.8)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOCS)
    group = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert [group[2 * i] == group[2 * i + 1] for i in range(len(want))] == want and 40 < sum(want) < 80


def test_keep_one_is_by_row(spark):
    """Only copies go, whichever ids they have; of each group the smallest (id, hash of the text) stays."""
    rng = random.Random(21)
    base = [" ".join(rng.choices([f"w{i}" for i in range(500)], k=60)) for _ in range(12)]
    rows = [(rng.choice([1, 2, 3, None]), rng.choice(base), str(i)) for i in range(60)]
    rows += [(9, base[0] + " tail", "x"), (None, "", "y"), (4, None, "z"), (4, " ", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").repartition(4)
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns

    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    groups = []
    for r in rows:
        s = shingles(r[1])
        met = [g for g in groups if any(len(s & x) >= 0.8 * len(s | x) for x in g[0])]
        groups = [g for g in groups if g not in met] + [([s] + [x for g in met for x in g[0]], [r] + [x for g in met for x in g[1]])]
    key = lambda r: (r[0] is None, r[0] or 0, np.int64(np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42))))
    want = sorted(min(map(key, g[1])) for g in groups)
    assert sorted(key(tuple(r)) for r in got.collect()) == want


def test_large_group_is_searched_by_what_its_members_add(spark, monkeypatch):
    """Around one base: all links of exact similarity are kept, far fewer pairs are compared."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base = [word() for _ in range(150)]

    def edited(words, n):
        out = list(words)
        for at in rng.sample(range(len(out)), n):
            out[at] = word()
        return out

    texts = [edited(base, rng.choice([0, 1, 2, 3, 4, 6, 8, 10])) for _ in range(220)]
    texts += [edited(rng.choice(texts), rng.choice([1, 2, 3])) for _ in range(120)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    compared = []
    similar = simhash._similar
    monkeypatch.setattr(simhash, "_similar", lambda pairs, *a: (compared.append(pairs.count()), similar(pairs, *a))[1])
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    sets = [shingles(" ".join(t)) for t in texts]
    label = plain_components(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    lowest = {}
    for i in range(len(texts)):
        lowest.setdefault(label[i], i)
    assert got == {i: lowest[label[i]] for i in range(len(texts))}
    monkeypatch.setattr(simhash, "_with_homes", lambda labelled, *a: labelled.selectExpr("*", "bigint(null) AS home", "array(0L) AS extra"))
    assert {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()} == got
    assert sum(compared[1:3]) < sum(compared[4:]), compared  # with homes, without


def test_pairs_leave_the_index_once(spark, monkeypatch):
    """Every pair with a word segment at most one bit apart, whatever number of segments it meets in."""
    rng, rows = random.Random(41), []
    for i in range(60):
        w = [(0x1234567 << 30) ^ (i % 3), 0x7654321 << 20]
        for _ in range(rng.choice([0, 1, 2, 9, 14])):
            w[rng.randrange(2)] ^= 1 << rng.randrange(63)
        rows.append((i, i, 20, *w, 0, 0, 0, 0, None, None))
    table = spark.createDataFrame(rows, "node long, label long, n long, w0 long, w1 long, s0 long, s1 long, s2 long, s3 long, home long, extra array<long>")
    kind = type(table)
    monkeypatch.setattr(kind, "distinct", lambda df: df)
    got = sorted((r.a, r.b) for r in simhash._pairs_between(table).collect())
    want = [(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and any(
        bin(((x[3 + h] ^ y[3 + h]) >> first) & ((1 << bits) - 1)).count("1") <= 1 for h, first, bits in simhash.WORD_SEGMENTS)]
    assert got == want
