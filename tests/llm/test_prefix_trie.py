"""The prefix trie of conversations against a plain trie of tuples."""

import collections
import hashlib
import random
import zlib

import pytest

from candlewright.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, rep string, weight string, length string"


def plain(rows):
    """rows: (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children, out = collections.Counter(p[:-1] for p in members if p), []
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        own_saved = (len(m) - 1) * len(p[-1][1].encode().split()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += own_saved
    for p, m in members.items():
        ended = sorted(c for c in m if len(whole[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


def trie(spark, rows, parts=3, **options):
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, prefixtrie.prefix_trie(df, **options).collect()), key=lambda r: (r[0], r[1]))


def conversations(n, seed, words=2, turns=6):
    draw = random.Random(seed)
    return [(c, t, draw.choice(["user", "assistant", None]), " ".join(draw.choices(["a", "b c", "é"], k=draw.randint(0, words))) or None)
            for c in range(n) for t in range(draw.randint(1, turns))]


@pytest.mark.parametrize("large", [8, 1 << 16])
def test_trie_with_ties_nulls_and_repeated_rows(spark, large):
    rows = conversations(130, 1)
    rows += rows[:9] + [(5, None, "user", "first"), (5, None, "user", None), (None, 1, "user", "nobody"),
                        (-3, 0, "user", "a"), (-20, 0, "user", "a"), (-20, 1, "user", "b")]
    assert trie(spark, rows, large=large) == plain(rows)


def test_one_conversation_with_most_turns_and_many_copies(spark):
    long = [(3, t, "user", f"turn {t % 5}") for t in range(700)]
    copies = [(1000 + i, t, "user", "same words here") for i in range(200) for t in range(2)]
    rows = long + copies + conversations(20, 2)
    assert trie(spark, rows, large=64) == plain(rows)


def test_running_sums_over_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "RUN", 4)
    monkeypatch.setattr(prefixtrie, "CHUNK", 3)
    rows = conversations(60, 3, words=1, turns=19)
    assert trie(spark, rows, large=50) == plain(rows)


def test_turnless_and_no_conversations(spark):
    turnless = next(c for c in range(21, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(turnless, 0, "user", "gone"), (turnless, 1, "user", "too")]
    assert trie(spark, rows) == plain(rows) == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]
    assert trie(spark, [(None, 0, "user", "x")]) == []
    assert prefixtrie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_component_totals(shape):
    draw = random.Random(7)
    n = 400
    parent = [-1] + [i - 1 if shape == "path" else 0 if shape == "star" else draw.randrange(i) for i in range(1, n)]
    values = [[draw.randint(-5, 9) for _ in range(n)], [1] * n]
    want = [list(v) for v in values]
    for i in range(n - 1, 0, -1):
        for w in want:
            w[parent[i]] += w[i]
    assert prefixtrie.component_totals(parent, want[1], values) == want
