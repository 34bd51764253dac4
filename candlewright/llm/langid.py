"""Language identification: averaged hashed subword embeddings with a linear softmax."""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

BUCKETS = 1 << 16
DIM = 16
GRAMS = (1, 2, 3, 4)
BLOCK = 1 << 16  # characters hashed at a time
PER_LANGUAGE = 300  # most training documents of a language
MOST_FEATURES = 4096  # most distinct buckets kept of one training document
EPOCHS, BATCH, RATE, SEED = 6, 32, 0.5, 42
FOLDS = 5
REJECTED = 0.0005  # share of known-language documents that calibration lets go
UNKNOWN = "und"

_LETTERS = None


def _letter_table():
    """1 for each code point that is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTERS


def _codes(text):
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")


def subwords(text):
    """Buckets of the letter n-grams of a text's words, border marks included, block by block."""
    letters = _letter_table()
    for start in range(0, len(text), BLOCK):
        codes = _codes(text[max(0, start - max(GRAMS)):start + BLOCK])
        own = np.where(letters[codes], codes, 0)
        own = np.concatenate(([0], own, [0])).astype(np.uint64)
        inside = own > 0
        h = np.zeros(len(own), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for n in GRAMS:
                h = (h[:len(own) - n + 1] * np.uint64(0x100000001B3)) ^ (own[n - 1:] + np.uint64(n))
                # an n-gram lies in one word: only its first and last character may be a border
                whole = np.ones(len(h), dtype=bool)
                for k in range(1, n - 1):
                    whole &= inside[k:k + len(h)]
                whole &= inside[:len(h)] | inside[n - 1:] if n > 1 else inside
                m = h[whole] * np.uint64(0x9E3779B97F4A7C15)
                yield ((m ^ (m >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)


def has_letter(text):
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """``scores`` holds, for each bucket, its embedding times the softmax weights; ``seen``
    whether training met the bucket. A prediction is accepted if its probability reaches
    ``threshold`` and the share of met subwords reaches ``coverage``."""

    languages: list
    scores: np.ndarray
    bias: np.ndarray
    seen: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    coverage: float = 0.0

    def judged(self, text):
        """(probabilities, share of subwords that training met) of a text with letters."""
        total, n, met = np.zeros(len(self.languages)), 0, 0
        for ids in subwords(text):
            total += self.scores[ids].sum(axis=0, dtype=np.float64)
            n, met = n + len(ids), met + int(self.seen[ids].sum())
        return softmax((total / max(n, 1) + self.bias) / self.temperature), met / max(n, 1)

    def predict(self, text):
        """(language, calibrated probability, accepted); no letters or no model: ('und', 0, False)."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, False
        p, met = self.judged(text)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] >= self.threshold and met >= self.coverage)


def softmax(z):
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _averaged(features, table):
    return np.stack([(table[ids] * w[:, None]).sum(axis=0) / w.sum() for ids, w in features])


def train(languages, features, labels, seed=SEED):
    """Fit by stochastic gradient descent; a bucket that no document has keeps a zero score.

    ``features``: (bucket ids, counts) of each document; ``labels``: places in ``languages``.
    One document in four is set aside: on it the temperature is chosen by likelihood, and
    then the bounds below which a prediction is rejected.
    """
    rng = np.random.default_rng(seed)
    weights = rng.uniform(-1 / DIM, 1 / DIM, (DIM, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    labels = np.array(labels)
    order = rng.permutation(len(labels))
    held, fit = order[:len(order) // 4], order[len(order) // 4:]
    table, seen = np.zeros((BUCKETS, DIM), dtype=np.float32), np.zeros(BUCKETS, dtype=bool)
    seen[np.concatenate([features[r][0] for r in fit])] = True
    table[seen] = rng.uniform(-1 / DIM, 1 / DIM, (int(seen.sum()), DIM))
    steps, done = EPOCHS * -(-len(fit) // BATCH), 0
    for _ in range(EPOCHS):
        fit = rng.permutation(fit)
        for i in range(0, len(fit), BATCH):
            rows = fit[i:i + BATCH]
            rate, done = RATE * (1 - done / steps), done + 1
            x = _averaged([features[r] for r in rows], table)
            error = softmax(x @ weights + bias)
            error[np.arange(len(rows)), labels[rows]] -= 1
            back = error @ weights.T
            weights -= rate * x.T @ error / len(rows)
            bias -= rate * error.mean(axis=0)
            for r, g in zip(rows, back):
                ids, w = features[r]
                # each bucket gets the share of the gradient that it has in the average
                table[ids] -= rate * DIM * (w / w.sum())[:, None] * g
    model = Model(languages, table @ weights, bias, seen)
    return calibrated(model, [features[r] for r in held], labels[held]) if len(held) else model


def calibrated(model, features, labels, rejected=REJECTED):
    z = np.stack([(model.scores[ids] * w[:, None]).sum(axis=0) / w.sum() + model.bias for ids, w in features])

    def loss(t):
        return -np.log(np.maximum(softmax(z / t)[np.arange(len(z)), labels], 1e-12)).mean()

    model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    best = softmax(z / model.temperature).max(axis=1)
    met = [(w * model.seen[ids]).sum() / w.sum() for ids, w in features]
    # half of what nearly every document reaches: longer texts of other origin fall far below
    model.threshold = float(min(max(np.quantile(best, rejected) / 2, 1.2 / len(model.languages)), 0.5))
    model.coverage = float(np.quantile(met, rejected) / 2)
    return model


def training_rows(docs, per_language=PER_LANGUAGE):
    """A bounded sample of labelled rows: of each language the ``per_language`` first by hashed id.

    Rows of fold 0 (``crc32(doc_id) mod 5``), without language or without text are not in it.
    Languages are counted first, so that only about twice the wanted rows of each leave
    the tasks that read them.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    first = Window.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text"))
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(fold != 0)
    counts = rows.groupBy("lang").agg((F.lit(2.0 * per_language) / F.count("*")).alias("share"))  # a row per language
    place_of_hash = F.shiftrightunsigned("h", 12) / F.lit(float(1 << 52))
    return rows.join(F.broadcast(counts), "lang").select(
        "doc_id", "lang", "text", "share", F.xxhash64("doc_id").alias("h")).where(place_of_hash < F.col("share")).withColumn(
        "place", F.row_number().over(first)).where(F.col("place") <= per_language)


def fitted(docs, per_language=PER_LANGUAGE, seed=SEED):
    """The model of the labelled rows of ``docs``; without any, one that knows no language.

    Texts are hashed where they lie; the driver gets at most ``per_language`` sparse
    count vectors of at most 4096 buckets for each language.
    """
    def count(batches):
        for b in batches:
            rows = []
            for lang, text in zip(b.column(0), b.column(1)):
                counts = np.zeros(BUCKETS, dtype=np.int64)
                for ids in subwords(text.as_py()):
                    counts += np.bincount(ids, minlength=BUCKETS)
                ids = np.nonzero(counts)[0]
                if len(ids) > MOST_FEATURES:
                    ids = np.sort(ids[np.argsort(-counts[ids], kind="stable")[:MOST_FEATURES]])
                rows.append({"lang": lang.as_py(), "ids": ids, "n": counts[ids]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
                [("lang", pa.string()), ("ids", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))]))

    rows = training_rows(docs, per_language).select("doc_id", "lang", "text").orderBy("lang", "doc_id").select(
        "lang", "text").mapInArrow(count, "lang string, ids array<int>, n array<int>").toPandas()
    rows = rows[rows["ids"].map(len) > 0]
    if not len(rows):
        return Model([], np.zeros((BUCKETS, 0), dtype=np.float32), np.zeros(0, dtype=np.float32),
                     np.zeros(BUCKETS, dtype=bool))
    languages = sorted(set(rows["lang"]))
    places = {name: i for i, name in enumerate(languages)}
    features = [(np.asarray(i, dtype=np.int64), np.asarray(n, dtype=np.float32)) for i, n in zip(rows["ids"], rows["n"])]
    return train(languages, features, [places[name] for name in rows["lang"]], seed)


def identified(docs, model):
    """The columns of ``docs`` plus lang_pred, score and accepted, from the whole text alone.

    Null texts and texts without a letter are 'und' with score 0 and not accepted; columns
    of these names are replaced; repeated rows each get their prediction.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: buckets times languages

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score", "accepted"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    return docs.select(*kept, predict("text").alias("found")).select(*kept, "found.*")


def known_languages(docs):
    """The documents whose language the model accepts, columns unchanged."""
    found = identified(docs.select(F.struct(*docs.columns).alias("row"), "text"), fitted(docs))
    return found.where("accepted").select("row.*")
