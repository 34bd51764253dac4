"""Benchmark decontamination by templates: questions are found also with other numbers and names."""

import functools
import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from candlewright.llm.common import ROW, doc_of_row, let_go, quoted, row_keys, stored

WINDOW = 8  # tokens of a template window
LITERALS = 4  # words that a window must have besides its slots to meet other values than its own
SHORTEST = 5  # tokens of an item that is looked for inside texts; a shorter one leaks where it is a whole line or text
RUN = 13  # tokens in a row that make a leak, or the whole item if it is shorter
FILTER_BITS = 1 << 22  # bits of the filter that is sent to the executors: half a megabyte
BLOCK = 1 << 16  # tokens hashed at a time
MEMO_WORDS = 200_000

# Words that stand for a unit when a number comes before them.
UNITS = frozenset("""
m km cm mm mi ft in yd mile miles meter meters metre metres kilometer kilometers kilometre kilometres
centimeter centimeters inch inches foot feet yard yards g kg mg lb lbs oz gram grams kilogram kilograms
pound pounds ounce ounces ton tons tonne tonnes l ml liter liters litre litres gallon gallons s ms min h
sec second seconds minute minutes hour hours day days week weeks month months year years percent
dollar dollars cent cents euro euros usd eur gbp mph kmh degrees kb mb gb tb hz khz mhz ghz w kw v a
""".split())
# Capitalised words that begin sentences and are no names.
PLAIN = frozenset("""
a an the this that these those and or but if when while what which who whom whose why how where is are was
were do does did has have had in on at by for from to of with as it he she they we you i there then than so
not no yes his her their its our your my each every some any all both one two three four five six seven
eight nine ten find given suppose let assume calculate compute determine after before during since because
""".split())

# Scripts without spaces between words (Thai to Khmer, kana, Han): each letter is a token.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
TOKEN = re.compile(rf"\d+(?:[.,:/]\d+)*|[^\W\d_{UNSPACED}]+|(?!\d)[{UNSPACED}](?<=\w)")
NUMBER, UNIT, NAME, WORD = 1, 2, 3, 4
PLACE = {k: np.uint64(0x9E3779B97F4A7C15 * (k + 11) & (1 << 64) - 1) for k in (NUMBER, UNIT, NAME)}
POWER = 0x5851F42D4C957F2D
EXACT = 0x2545F4914F6CDD1D
ALONE = 0x369DEA0F31A53F85
LINE = re.compile("[^\n\r\u2028\u2029]+")


def _word_hash(word):
    import xxhash

    return xxhash.xxh64_intdigest(word, 42)


class _Known(dict):
    """Token to its place in ``hashes`` (of the lower-case word or the number's value) and ``kinds`` (what it may stand for)."""

    def __init__(self):
        super().__init__()
        self.hashes, self.kinds = np.zeros(MEMO_WORDS, dtype=np.uint64), np.zeros(MEMO_WORDS, dtype=np.int8)

    def __missing__(self, token):
        low = token.lower()
        if token[0].isdigit():
            kind, low = NUMBER, _value(token, NUMBER)
        elif low in UNITS:
            kind = UNIT
        elif len(token) > 1 and token[0].isupper() and token[1:].islower() and low not in PLAIN:
            kind = NAME
        else:
            kind = WORD
        at = self[token] = len(self)
        self.hashes[at], self.kinds[at] = _word_hash(low), kind
        return at

    def read(self, tokens):
        """(hashes, kinds) of a block of tokens."""
        if len(self) + len(tokens) > MEMO_WORDS:
            self.clear()
        places = np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        return self.hashes[places], self.kinds[places]


_KNOWN = _Known()


@functools.lru_cache(maxsize=4)
def _powers(n):
    """Powers of an odd number and of its inverse, modulo 2^64."""
    inverse = pow(POWER, -1, 1 << 64)
    out = np.ones((2, n + 1), dtype=np.uint64)
    out[0, 1:], out[1, 1:] = POWER, inverse
    return tuple(np.cumprod(out, axis=1, dtype=np.uint64))


def _sums(h):
    up, _ = _powers(BLOCK * 2)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[:len(h)], dtype=np.uint64)))


def _rolled(sums, n):
    """Hash of each run of ``n`` tokens, from running sums of their hashes times powers."""
    _, down = _powers(BLOCK * 2)
    out = (sums[n:] - sums[:-n]) * down[:len(sums) - n]
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def _tokens(text):
    """Tokens of a text in stretches of about a million characters that end between words."""
    start = 0
    while len(text) - start > 1 << 20:
        end = text.rfind(" ", start, start + (1 << 20)) + 1 or start + (1 << 20)
        yield TOKEN.findall(text, start, end)
        start = end
    yield TOKEN.findall(text, start)


def _blocks(text, overlap):
    """(first token's place, tokens) of a text in blocks that share ``overlap`` tokens."""
    place, held = 0, []
    for more in _tokens(text):
        held += more
        while len(held) > BLOCK + overlap:
            yield place, held[:BLOCK + overlap]
            place, held = place + BLOCK, held[BLOCK:]
    yield place, held


def _value(token, kind):
    if kind == NUMBER:
        return "n" + (token.replace(",", "") if re.fullmatch(r"\d{1,3}(,\d{3})+(\.\d+)?", token) else token)
    return ("u" if kind == UNIT else "a") + token.lower()


def template_windows(text, lengths, wanted=None):
    """(key, place, slots, named) of a text's template windows of the given lengths.

    Numbers, and units behind numbers, always become placeholders; words are compared in
    lower case and without marks. A window with capitalised words that may be names is
    given a second time with those as placeholders too, so that questions are found with
    other names and also in texts that lost their capitals. A window with too few words
    beside its numbers and units has a key of its words and values as they are, and so
    meets its like only with equal values. ``slots`` are the typed
    values behind the placeholders in order, joined by '|'. ``wanted`` keeps the keys of
    interest.
    """
    overlap = max(lengths, default=1) - 1
    for start, tokens in _blocks(text, overlap):
        if not tokens:
            continue
        words, kinds = _KNOWN.read(tokens)
        number = kinds == NUMBER
        unit = (kinds == UNIT) & np.concatenate(([False], number[:-1]))
        name = kinds == NAME
        plain = np.where(number, PLACE[NUMBER], np.where(unit, PLACE[UNIT], words))
        slot = np.where(number, NUMBER, np.where(unit, UNIT, 0))
        for named in (False, True):
            if named and not name.any():
                continue
            s = np.where(name, NAME, slot) if named else slot
            sums = _sums(np.where(name, PLACE[NAME], plain) if named else plain)
            taken = np.concatenate(([0], np.cumsum(s > 0)))
            names = np.concatenate(([0], np.cumsum(name))) if named else None
            for n in lengths:
                if len(tokens) < n:
                    continue
                keys = _rolled(sums, n)
                ok = (n - (taken[n:] - taken[:-n])) >= min(LITERALS, n - 1)
                if named:
                    ok &= names[n:] > names[:-n]
                elif not ok.all():
                    keys, ok = np.where(ok, keys, _rolled(_sums(words), n) ^ np.int64(EXACT)), np.ones_like(ok)
                if wanted is not None:
                    ok &= wanted[keys & (FILTER_BITS - 1)]
                for i in np.nonzero(ok)[0].tolist():
                    if start and i + n <= overlap:
                        continue  # the last block had it
                    slots = "|".join(_value(tokens[i + k], s[i + k]) for k in np.nonzero(s[i:i + n])[0])
                    yield int(keys[i]), start + i, slots, named


def _alone(tokens):
    """Key of a few tokens that are all of a line or text."""
    words, _ = _KNOWN.read(tokens)
    return int(_rolled(_sums(words), len(tokens))[0] ^ np.int64(ALONE))


def short_lines(text, wanted=None):
    """(key, place, "", False) of the text, and of each line, that has one to four tokens."""
    place = 0
    for part in itertools.chain([text], (m.group() for m in LINE.finditer(text))):
        tokens = [m.group() for m in itertools.islice(TOKEN.finditer(part), SHORTEST)]
        if 0 < len(tokens) < SHORTEST:
            key = _alone(tokens)
            if wanted is None or wanted[key & (FILTER_BITS - 1)]:
                yield key, place, "", False
        place += 1


def _items(benchmark):
    """(item_id, key, n, place, slots, tokens) of the items' windows; short items are one window."""
    def run(batches):
        for b in batches:
            rows = []
            for item_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens = sum(1 for _ in TOKEN.finditer(text or ""))
                if tokens >= SHORTEST:
                    n = min(tokens, WINDOW)
                    rows += [(item_id, k, n, p, s, tokens) for k, p, s, _ in template_windows(text, [n])]
                elif tokens:
                    rows.append((item_id, _alone(TOKEN.findall(text)), tokens, 0, "", tokens))
            names = ["item_id", "key", "n", "place", "item_slots", "tokens"]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=pa.schema(
                [(c, pa.string() if c == "item_slots" else pa.int64()) for c in names]))

    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(
        run, "item_id long, key long, n long, place long, item_slots string, tokens long")


def _filter(items):
    """The lowest 22 bits of all keys as a bitmap: 128 rows of 4 KB at most, whatever the benchmark."""
    at = F.col("key").bitwiseAND(FILTER_BITS - 1) + 1
    parts = items.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    wanted = np.zeros((FILTER_BITS >> 15, 4096), dtype=np.uint8)
    for r in parts:
        wanted[r.part - 1] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return np.unpackbits(wanted.reshape(-1), bitorder="little").astype(bool)


def leaks(docs, benchmark):
    """(doc_id, item_id, run, item_tokens, exact) of the benchmark items that documents hold; see :func:`row_leaks`.

    Rows of one doc_id, repeated or with different texts, give each item once.
    """
    return row_leaks(docs, benchmark).groupBy(doc_of_row().alias("doc_id"), "item_id").agg(
        F.max("run").alias("run"), F.max("item_tokens").alias("item_tokens"), F.max("exact").alias("exact"))


def row_leaks(docs, benchmark):
    """(columns of ROW, item_id, run, item_tokens, exact) of the benchmark items that rows hold.

    Template windows of whole texts are joined with those of the items by hash, after a
    bitmap of fixed size has let go most windows of the documents where they are made.
    Windows of one document and item that lie on one diagonal and follow each other are
    a run, once with words as they are and once with placeholders for names as well.
    Slots are consistent if equal values of the item stand for equal values
    of the document and unequal ones for unequal ones, so that a question with other
    parameters is found and a chance likeness is not; a run is cut into its longest
    consistent parts. A leak is a consistent part of 13
    tokens, or of the whole item if it is shorter; ``exact`` says that the values are
    the item's own. An item of one to four tokens cannot be told from ordinary text inside
    a longer one and leaks where it is a whole line or the whole text, word for word. Items
    without tokens cannot be looked for; null texts hold none; rows that agree in doc_id and text
    give their leaks once; empty tables give none.
    """
    items = stored(_items(benchmark))
    lengths = sorted(r[0] for r in items.select("n").distinct().collect())  # eight at most
    short, lengths = any(n < SHORTEST for n in lengths), [n for n in lengths if n >= SHORTEST]
    shared = docs.sparkSession.sparkContext.broadcast(_filter(items))

    def run(batches):
        names = [*ROW, "key", "at", "slots", "named"]
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        for b in batches:
            found = []
            for *row, text in zip(*(b.column(i) for i in range(4))):
                text = text.as_py()
                if text:
                    row = [v.as_py() for v in row]
                    found += [(*row, *w) for w in template_windows(text, lengths, shared.value)]
                    if short:
                        found += [(*row, *w) for w in short_lines(text, shared.value)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(zip(*found), types)] if found
                else [pa.array([], type=t) for t in types], names=names)
        _KNOWN.clear()
        let_go()

    row = f"{ROW[0]} long, {ROW[1]} boolean, {ROW[2]} long, "
    windows = docs.select(*row_keys(), "text").mapInArrow(run, row + "key long, at long, slots string, named boolean")
    group = [*ROW, "item_id", "diagonal", "by_names"]
    families = F.when(F.col("named"), F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))
    hits = windows.join(items, "key").withColumn("diagonal", F.col("at") - F.col("place")).withColumn(
        "by_names", F.explode(families)).groupBy(
        *group, "place").agg(F.max_by(F.struct("slots", "item_slots", "n", "tokens"), F.length("item_slots")).alias("w"))
    runs = hits.withColumn("island", F.col("place") - F.row_number().over(
        Window.partitionBy(*group).orderBy("place"))).select(*group, "island", "place", "w.*")
    long = runs.groupBy(*group, "island").agg(
        F.max("tokens").alias("item_tokens"), F.sort_array(F.collect_list(F.struct("place", "n", "item_slots", "slots"))).alias("w")).where(
        F.element_at("w", -1)["place"] - F.element_at("w", 1)["place"] + F.element_at("w", 1)["n"] >= F.least(F.lit(RUN), "item_tokens"))
    return long.select(*ROW, "item_id", "item_tokens", "w").mapInArrow(
        _best_parts, row + "item_id long, run long, item_tokens long, exact boolean")


def consistent_parts(windows):
    """(first, last, exact) of the longest stretches of windows whose slots are consistent.

    ``windows`` are lists of (own, other) values. A stretch is consistent if its pairs are
    a one-to-one relation; both ends only move on, so the work grows with the windows.
    """
    pairs, owns, others, first, unequal, clashes = Counter(), Counter(), Counter(), 0, 0, 0

    def turn(window, by):
        nonlocal unequal, clashes
        for pair in window:
            was, pairs[pair] = pairs[pair] > 0, pairs[pair] + by
            if was != (pairs[pair] > 0):
                unequal += by * (pair[0] != pair[1])
                for counts, value in ((owns, pair[0]), (others, pair[1])):
                    clashes -= max(0, counts[value] - 1)
                    counts[value] += by
                    clashes += max(0, counts[value] - 1)

    for last, window in enumerate(windows):
        ended = first, last - 1, not unequal
        turn(window, 1)
        if clashes and last > ended[0]:
            yield ended
        while clashes and first <= last:
            turn(windows[first], -1)
            first += 1
    if first < len(windows):
        yield first, len(windows) - 1, not unequal


def _best_parts(batches):
    names = [*ROW, "item_id", "run", "item_tokens", "exact"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    for b in batches:
        rows = []
        for *row, item_id, tokens, w in zip(*(b.column(i).to_pylist() for i in range(6))):
            pairs = [list(zip(v["item_slots"].split("|"), v["slots"].split("|"))) for v in w]
            for first, last, exact in consistent_parts(pairs):
                run = w[last]["place"] - w[first]["place"] + w[first]["n"]
                if run >= min(RUN, tokens):
                    rows.append((*row, item_id, run, tokens, exact))
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)] if rows
                                         else [pa.array([], type=t) for t in types], names=names)


def clean_documents(docs, benchmark):
    """The documents without a leak, columns unchanged.

    A row goes for what its own text holds: rows with its doc_id but another text, and rows
    without doc_id, are judged by theirs.
    """
    found = stored(row_leaks(docs, benchmark).select(*ROW).distinct())
    names = [f"column_{i}_of_row" for i in range(len(docs.columns))]
    whole = docs.select(*row_keys(), *(c.alias(n) for c, n in zip(quoted(docs.columns), names)))
    return whole.join(found, ROW, "left_anti").select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
