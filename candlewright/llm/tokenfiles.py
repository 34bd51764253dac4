"""Token ids in files of separately compressed documents with one shared dictionary.

A token file is a folder of two Parquet tables, which Spark writes to any store and
commits whole, also when executors are lost:

* ``dictionary``: one row (dict_hash, id_bytes, dictionary). The hash is the SHA-256 of the
  zstandard dictionary, id_bytes the width of a little-endian id.
* ``segments``: rows (part, seq, dict_hash, first_doc, last_doc, tokens_before, tokens, docs,
  lengths, offsets, payload). A segment holds consecutive documents in ascending doc_id
  order: ``docs`` their ids, ``lengths`` their ids' count, ``offsets`` where each
  one's zstandard frame begins in ``payload`` (one more offset ends the last). The part
  is the writing task, parts are in order, and tokens_before counts the ids of earlier
  segments of the part.
"""

import hashlib
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from candlewright.llm.common import let_go

END_ID = 2
DICTIONARY_BYTES = 32 << 10
SAMPLE_DOCUMENTS, SAMPLE_CHARS = 500, 2048  # what the dictionary is trained on
SEGMENT_BYTES, SEGMENT_DOCUMENTS = 4 << 20, 4096
MEMO_BYTES = 48 << 20  # about what an encoder remembers of earlier words
PART_BYTES = 2 << 20  # of text that is encoded at a time
SEGMENT_COLUMNS = ("part int, seq int, dict_hash string, first_doc long, last_doc long, tokens_before long, "
                   "tokens long, docs array<long>, lengths array<long>, offsets array<long>, payload binary")
SEGMENT_ARROW = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("dict_hash", pa.string()), ("first_doc", pa.int64()),
    ("last_doc", pa.int64()), ("tokens_before", pa.int64()), ("tokens", pa.int64()),
    ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())),
    ("payload", pa.binary())])


# Letters of Latin scripts, and the marks that may end a word. A word of such letters is one piece to the
# vocabulary and the marks behind it another. The capital dotted I is no such letter, its small form has two characters.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
HALVES = f"^(?P<core>[{LETTERS}]+)(?P<tail>[.,!?;:*#&%$]*)$"
BLANK = re.compile(rb"[\x20\x09-\x0d]")


class Encoder:
    """Ids of texts as little-endian 32-bit integers, by the distinct words of a batch.

    The vocabulary drops white space and never joins across it, so a text's ids are those
    of its words. The words of a batch are split and numbered by Arrow, the distinct ones
    are encoded, and the ids are gathered by numpy. Words of Latin letters and the marks
    behind them are numbered apart. Known pieces are remembered up to about ``MEMO_BYTES``, of which
    those met most often then stay, until :meth:`forget`. The vocabulary's own lower-casing makes capitals of ASCII meaningless,
    except in the names of its special tokens.
    """

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last_of_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last_of_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.lower = self.tokenizer.encode("Aa", add_special_tokens=False).ids == \
            self.tokenizer.encode("aa", add_special_tokens=False).ids
        self.forget()

    def forget(self):
        """Drop what is remembered of earlier texts."""
        self.places, self.bytes = {}, 0
        self.ids, self.starts, self.lengths = np.zeros(1 << 16, dtype="<u4"), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.met, self.used = np.zeros(1 << 14, np.int32), 0

    def _thin(self):
        """Keep the quarter of the remembered pieces that was met in most parts; how often counts half from now on."""
        names, n = list(self.places), len(self.places)
        kept = np.sort(np.argsort(-self.met[:n], kind="stable")[:n // 4])
        lengths, met = self.lengths[kept], self.met[kept] // 2
        ids = self.ids[np.repeat(self.starts[kept] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
        self.forget()
        self._file([names[k] for k in kept.tolist()], ids, lengths)
        self.met[:len(kept)] = met

    def _file(self, pieces, ids, lengths):
        """Remember the ``ids`` of ``pieces``, which lie one behind the other."""
        n, k = len(self.places), len(pieces)
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while len(self.starts) < n + k:
            self.starts, self.lengths, self.met = (
                np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.lengths, self.met))
        self.ids[self.used:self.used + len(ids)] = ids
        self.lengths[n:n + k] = lengths
        self.starts[n:n + k] = self.used + np.cumsum(lengths) - lengths
        self.places.update(zip(pieces, range(n, n + k)))
        self.used += len(ids)
        self.bytes += 200 * k + sum(map(len, pieces)) + 4 * len(ids)

    def _each(self, pieces):
        for i in range(0, len(pieces), 4096):
            part = pieces[i:i + 4096]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(
                [w.decode("utf-8", "replace") for w in part], add_special_tokens=False)]
            self._file(part, np.array([t for ids in found for t in ids], dtype="<u4"), np.array([len(ids) for ids in found], np.int64))

    def _together(self, words):
        """Words of letters in one call: each has one token that ends a word, its last."""
        for i in range(0, len(words), 4096):
            part = words[i:i + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.nonzero(self.last_of_word[ids])[0] + 1
            if len(stops) != len(part):
                return self._each(words[i:])
            self._file(part, ids, np.diff(stops, prepend=0))

    def _placed(self, pieces, learn):
        """Place of each of an array of distinct pieces; ``learn`` encodes those not met before."""
        pieces = pieces.view(pa.binary()).to_pylist()
        learn([w for w in pieces if w not in self.places])
        found = np.fromiter(map(self.places.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        self.met[found] += 1
        return found

    def _numbered(self, texts):
        """(numbers of the pieces of all words, of which each word has two, first word of each text)."""
        if self.lower:
            texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        words = split.values.dictionary_encode()
        distinct = words.dictionary
        halves = pc.extract_regex(distinct, HALVES)
        plain = halves.is_valid()
        cores = pc.if_else(plain, halves.field(0), distinct).dictionary_encode()
        tails = pc.if_else(plain, halves.field(1), "").dictionary_encode()
        if self.bytes > MEMO_BYTES:
            self._thin()
        is_plain = pc.extract_regex(cores.dictionary, HALVES).is_valid().to_numpy(zero_copy_only=False)
        letters = dict(zip(cores.dictionary.view(pa.binary()).to_pylist(), is_plain.tolist()))

        def learn(pieces):
            self._together([w for w in pieces if letters[w]])
            self._each([w for w in pieces if not letters[w]])

        place = np.stack((self._placed(cores.dictionary, learn)[cores.indices.to_numpy()],
                          self._placed(tails.dictionary, self._each)[tails.indices.to_numpy()]), axis=1)
        return place[words.indices.to_numpy()].ravel(), split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()

    def _part(self, texts):
        place, first = self._numbered(texts)
        n = self.lengths[place]
        upto = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(self.starts[place] - upto[:-1], n)
        at += np.arange(len(at))
        return self.ids[at], np.diff(upto[2 * first])

    def encode(self, texts):
        """(ids of all texts one behind the other, their numbers) of an array of UTF-8 texts without nulls.

        Texts are taken in parts of a few megabytes; a longer one is cut between words.
        """
        raw, out, lengths, part, size = texts.view(pa.binary()), [], np.zeros(len(texts), dtype=np.int64), [], 0

        def close():
            ids, n = self._part(pa.array([p for _, p in part], pa.binary()).view(pa.string()))
            out.append(ids)
            np.add.at(lengths, [i for i, _ in part], n)
            part.clear()

        for i, text in enumerate(raw.to_pylist()):
            start = 0
            while start < len(text) or not text and not start:
                stop = len(text)
                if stop - start > PART_BYTES:
                    blank = BLANK.search(text, start + PART_BYTES)
                    stop = blank.end() if blank else stop
                part.append((i, text[start:stop] if start or stop < len(text) else text))
                size += stop - start
                start = max(stop, 1)
                if size >= PART_BYTES:
                    close()
                    size = 0
        if part:
            close()
        return np.concatenate(out) if out else np.zeros(0, dtype="<u4"), lengths


_ENCODERS = {}


def encoder(path):
    """One encoder per process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def train_dictionary(samples):
    """A zstandard dictionary of serialized id arrays; of too few samples, their plain bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples) or bytes(8)).rjust(8, b"\0")[-DICTIONARY_BYTES:]


def _documents(docs):
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _slices(texts):
    """Stretches of an array of texts with about ``PART_BYTES`` each."""
    size = np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]) if len(texts) else []
    part = np.cumsum(size) // PART_BYTES
    ends = [*np.nonzero(np.diff(part))[0] + 1, len(texts)] if len(texts) else []
    return [slice(a, b) for a, b in zip([0, *ends], ends)]


def write_token_file(docs, path, vocabulary=None, end_id=END_ID):
    """Encode every whole text, append ``end_id`` and write the token file at ``path``.

    The texts are exchanged once by ranges of (doc_id, text hash), which also splits a
    doc_id that is repeated very often; each task then encodes and writes its range in
    order. Null texts are empty, rows without doc_id come last, repeated rows stay, an
    empty table gives a file without segments.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or public_tokenizers.path("word_bpe_49k.json")
    rows = _documents(docs)
    coder = encoder(vocabulary)
    width = 2 if coder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4

    def coded(code, texts):
        """(packed ids with the end id behind each text, numbers of ids)."""
        ids, lengths = code.encode(texts)
        ends = np.cumsum(lengths)
        return np.insert(ids, ends, end_id).astype(f"<u{width}"), lengths + 1

    hashed = rows.withColumn("h", F.xxhash64("doc_id"))
    last = hashed.select("h").orderBy("h").limit(SAMPLE_DOCUMENTS).agg(F.max("h")).first()[0]
    sample = hashed.where(F.col("h") <= F.lit(last)).select("h", F.substring("text", 1, SAMPLE_CHARS).alias("t")).orderBy(
        "h", "t").limit(SAMPLE_DOCUMENTS).collect()
    ids, lengths = coded(coder, pa.array([r.t.encode("utf-8", "replace") for r in sample], pa.binary()).view(pa.string()))
    coder.forget()
    dictionary = train_dictionary([part.tobytes() for part in np.split(ids, np.cumsum(lengths)[:-1]) if len(part)])
    dict_hash = hashlib.sha256(dictionary).hexdigest()

    def segments(batches):
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        code = encoder(vocabulary)
        pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))
        ids, lengths, offsets, frames = [], [], [0], []

        def segment():
            return pa.RecordBatch.from_pylist([{
                "part": part, "seq": seq, "dict_hash": dict_hash, "first_doc": ids[0], "last_doc": ids[-1],
                "tokens_before": before, "tokens": sum(lengths), "docs": ids, "lengths": lengths,
                "offsets": offsets, "payload": b"".join(frames)}], schema=SEGMENT_ARROW)

        for b in batches:
            # Few documents at a time, however long they are.
            texts = b.column(1).cast(pa.binary())
            for some in _slices(texts):
                coded_ids, n = coded(code, texts[some].view(pa.string()))
                at = (np.cumsum(n) - n) * width
                packed = zstandard.BufferWithSegments(coded_ids.tobytes(), np.stack((at, n * width), axis=1).astype("<u8").tobytes())
                for doc_id, count, frame in zip(b.column(0)[some].to_pylist(), n.tolist(), pack.multi_compress_to_buffer(packed)):
                    frames.append(frame.tobytes())
                    ids.append(doc_id)
                    lengths.append(count)
                    offsets.append(offsets[-1] + len(frames[-1]))
                    if offsets[-1] >= SEGMENT_BYTES or len(ids) >= SEGMENT_DOCUMENTS:
                        yield segment()
                        before, seq = before + sum(lengths), seq + 1
                        ids, lengths, offsets, frames = [], [], [0], []
        code.forget()
        let_go()
        if ids:
            yield segment()

    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", F.col("text").cast("binary")).mapInArrow(
        segments, SEGMENT_COLUMNS).write.parquet(f"{path}/segments")
    spark.createDataFrame([(dict_hash, width, bytearray(dictionary))],
                          "dict_hash string, id_bytes int, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    return path


def _opened(spark, path):
    dict_hash, width, dictionary = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(dictionary).hexdigest() != dict_hash:
        raise ValueError("the dictionary does not have the hash it is filed under")
    return dict_hash, width, bytes(dictionary)


def _unpacker(dictionary, width):
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    return lambda frame: np.frombuffer(unpack.decompress(frame), dtype=f"<u{width}").astype("<u4")


def read_token_file(spark, path, with_ids=False):
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document of a token file.

    ``start`` counts the ids of all documents before: the totals of earlier parts (one row
    per writing task), of earlier segments, and of earlier documents of the segment.
    """
    dict_hash, width, dictionary = _opened(spark, path)
    segments = spark.read.schema(SEGMENT_COLUMNS).parquet(f"{path}/segments")
    totals = segments.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start_of_part"))
    placed = segments.join(F.broadcast(starts), "part").select(
        (F.col("start_of_part") + F.col("tokens_before")).alias("start"), "dict_hash", "docs", "lengths", "offsets", "payload")

    def documents(batches):
        ids_of = _unpacker(dictionary, width)
        for b in batches:
            for row in range(b.num_rows):
                start, named, docs, lengths, offsets, payload = (c[row].as_py() for c in b.columns)
                if named != dict_hash:
                    raise ValueError("a segment names another dictionary")
                found = {"doc_id": docs, "start": [], "n_tokens": [], "ids_crc32": []} | ({"ids": []} if with_ids else {})
                for k, n in enumerate(lengths):
                    ids = ids_of(payload[offsets[k]:offsets[k + 1]])
                    if len(ids) != n:
                        raise ValueError("a document does not have the length of its index")
                    found["start"].append(start)
                    found["n_tokens"].append(n)
                    found["ids_crc32"].append(zlib.crc32(ids.tobytes()))
                    if with_ids:
                        found["ids"].append(ids.astype(np.int64))
                    start += n
                schema = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
                yield pa.RecordBatch.from_pydict(found, schema=pa.schema(
                    schema + ([("ids", pa.list_(pa.int64()))] if with_ids else [])))

    return placed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long"
                             + (", ids array<long>" if with_ids else ""))


def read_document(spark, path, doc_id):
    """The ids of one document's rows, reading and decompressing only their frames."""
    _, width, dictionary = _opened(spark, path)
    ids_of = _unpacker(dictionary, width)
    rows = spark.read.schema(SEGMENT_COLUMNS).parquet(f"{path}/segments").where(
        (F.col("first_doc") <= doc_id) & (F.coalesce("last_doc", F.lit(doc_id)) >= doc_id)).select(
        "part", "seq", "offsets", "payload", F.posexplode("docs").alias("at", "doc")).where(F.col("doc") == doc_id)
    frames = rows.orderBy("part", "seq", "at").select(F.expr(
        "substring(payload, offsets[at] + 1, offsets[at + 1] - offsets[at])")).toLocalIterator()
    return [ids_of(bytes(f[0])).tolist() for f in frames]
