"""Toxicity by a linear classifier on character n-grams with naive Bayes scaling.

A text's features count, for each hashed character n-gram of 3 to 6 characters
inside word boundaries, the distinct words that contain it.  Each feature is
scaled by its naive Bayes log-count ratio, and logistic regression with an L2
penalty is fitted on the scaled features.  The model is linear in words, so a
word's contribution is computed once for a chunk of texts.

The fit uses at most ``MAX_TRAIN`` labelled texts and ``MAX_BYTES`` of their
distinct words (those with the smallest hash of their id); every text is
scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .storage import drop_columns_clashing, written
from .textkit import LOWER_ALNUM, Words, chunks, mix

MAX_TRAIN, MAX_BYTES = 5_000, 64_000_000
DIMENSIONS = 2**19
SIZES = (3, 4, 5, 6)
U = np.uint64


def word_features(words: list[bytes], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word, feature) of the distinct hashed n-grams of each word, words in order."""
    parts = [_word_features(words[a : a + at_once]) for a in range(0, len(words), at_once)]
    if not parts:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    of = np.concatenate([p[0] + np.int32(i * at_once) for i, p in enumerate(parts)])
    return of, np.concatenate([p[1] for p in parts])


def _word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    text = "".join(f"\x02{w.decode('utf-8', 'replace')}\x03" for w in words)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(U)
    end = np.flatnonzero(code == 3) + 1
    owner = np.repeat(np.arange(len(end)), np.diff(np.append(0, end)))
    pairs = []
    for n in SIZES:
        at = np.arange(max(0, len(code) - n + 1))
        at = at[at + n <= end[owner[at]]] if len(at) else at
        h = np.full(len(at), n, U)
        for k in range(n):
            h = h * U(0x9FB21C651E98DF25) + code[at + k]
        pairs.append(owner[at] * DIMENSIONS + (mix(h) % U(DIMENSIONS)).astype(np.int64))
    pair = np.unique(np.concatenate(pairs))
    return (pair // DIMENSIONS).astype(np.int32), (pair % DIMENSIONS).astype(np.int32)


def _distinct_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, Words, np.ndarray, np.ndarray]:
    """Pairs (text, word number) without repeats; the words' hashes and first places."""
    w = Words(texts, LOWER_ALNUM)
    vocabulary, place, number = np.unique(w.hash, return_index=True, return_inverse=True)
    owner = np.repeat(np.arange(len(texts)), w.counts)
    pair = np.unique(owner * (len(vocabulary) + 1) + number) if len(number) else np.empty(0, np.int64)
    return pair // (len(vocabulary) + 1), pair % (len(vocabulary) + 1), w, vocabulary, place


class ToxicityModel:
    """Weights of the n-grams and the intercept."""

    def __init__(self, texts: list[bytes], labels: np.ndarray, penalty: float = 1.0, rounds: int = 60, smoothing: float = 1.0):
        self.weights = np.zeros(DIMENSIONS, np.float32)
        y = np.asarray(labels, float)
        share = (y.sum() + 1) / (len(y) + 2)
        self.intercept = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            return
        doc, word, w, _, place = _distinct_words(texts)
        names = [w.buffer[w.start[i] : w.end[i]] for i in place]
        doc, word = doc.astype(np.int32), word.astype(np.int32)
        del w, place
        of, feature = word_features(names)
        toxic = np.bincount(word, y[doc], len(names))
        every = np.bincount(word, minlength=len(names))
        p = np.bincount(feature, toxic[of], DIMENSIONS) + smoothing
        q = np.bincount(feature, (every - toxic)[of], DIMENSIONS) + smoothing
        used = np.flatnonzero(np.bincount(feature, minlength=DIMENSIONS))
        ratio = np.log((p / p[used].sum()) / (q / q[used].sum()))[used]
        column = np.searchsorted(used, feature).astype(np.int32)
        del feature
        scaled = ratio[column].astype(np.float32)

        def margin(x):
            each = np.bincount(of, scaled * x[column], len(names))
            return np.bincount(doc, each[word], len(y))

        def loss(theta):
            x, b = theta[:-1], theta[-1]
            z = margin(x) + b
            g = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
            each = np.bincount(word, g[doc], len(names))
            grad = np.bincount(column, scaled * each[of], len(used)) + penalty * x
            value = np.logaddexp(0, z).sum() - y @ z + penalty / 2 * x @ x
            return value, np.append(grad, g.sum())

        best = minimised(loss, np.append(np.zeros(len(used)), self.intercept), rounds)
        self.weights[used] = (best[:-1] * ratio).astype(np.float32)
        self.intercept = float(best[-1])

    def contributions(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.empty(0)
        of, feature = word_features(words)
        return np.bincount(of, self.weights[feature], len(words))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        doc, word, w, _, place = _distinct_words(texts)
        each = self.contributions([w.buffer[w.start[i] : w.end[i]] for i in place])
        z = self.intercept + np.bincount(doc, each[word] if len(word) else None, len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def minimised(loss, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking."""
    value, grad = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, saved = grad.copy(), []
        for s, d, r in reversed(steps):
            a = r * (s @ q)
            q -= a * d
            saved.append(a)
        if steps:
            s, d, r = steps[-1]
            q /= r * (d @ d)
        for (s, d, r), a in zip(steps, reversed(saved), strict=True):
            q += s * (a - r * (d @ q))
        slope, size = -(grad @ q), 1.0 if steps else 1 / max(1.0, float(np.abs(grad).sum()))
        if slope > -1e-9:
            break
        while size > 1e-12:
            new, new_grad = loss(x - size * q)
            if new <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, d = -size * q, new_grad - grad
        if s @ d > 1e-12:
            steps = [*steps[-memory + 1 :], (s, d, 1 / (s @ d))]
        gain, x, value, grad = value - new, x + s, new, new_grad
        if gain < 1e-7 * max(1.0, abs(value)):
            break
    return x


def _words_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: each text as its distinct words."""
    for batch in batches:
        texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
        out = []
        for a, b in chunks(texts):
            doc, word, w, _, place = _distinct_words(texts[a:b])
            bounds = np.searchsorted(doc, np.arange(b - a + 1))
            out += [b" ".join(w.buffer[w.start[i] : w.end[i]] for i in place[word[s:e]]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1), batch.column(2)], names=["words", "label", "doc_id"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> ToxicityModel:
    """Fit on at most ``max_train`` labelled ids and ``max_bytes`` of distinct words.

    Ids are taken in the order of their hash; texts go on being taken until the
    bytes are spent (the first one always counts).  Rows with a null id or
    label are left out; of several labels of an id the greatest counts; several
    rows of a labelled id all count.  Null and empty texts count as texts
    without words.  Without labels, or with one class only, the model is an
    intercept.  Other columns are ignored.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text")).join(F.broadcast(chosen), "_id")
    rows = written(rows.select("_text", "_label", "_id").mapInArrow(_words_only, "words binary, label int, doc_id long").withColumn("turn", F.xxhash64("doc_id")))
    # Bounded by max_train ids with, as a rule, one row each; sizes first, then the words that fit.
    each = rows.groupBy("turn", "doc_id").agg(F.sum(F.octet_length("words")).alias("bytes")).collect()
    spent, last = 0, None
    for r in sorted(each, key=lambda r: (r.turn, r.doc_id)):
        if last is not None and spent + r.bytes > max_bytes:
            break
        spent, last = spent + r.bytes, (r.turn, r.doc_id)
    if last is None:
        return ToxicityModel([], np.empty(0))
    got = rows.where((F.col("turn") < last[0]) | ((F.col("turn") == last[0]) & (F.col("doc_id") <= last[1]))).collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.words)))
    return ToxicityModel([bytes(r.words) for r in got], np.array([r.label for r in got]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= threshold, else 0).

    Null and empty texts get the score of the intercept.  Equal texts get
    equal scores, and repeated rows and ids are scored each by its own text.
    Columns with these two names give way; an empty table gives an empty one.
    """
    kept = drop_columns_clashing(docs.select(*keep) if keep else docs, "score", "predicted")
    names = kept.columns
    given = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], F.col(f"`{text_col}`").alias("_text"))
    # Only arrays are broadcast, so that who unpacks them needs no module of this package.
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = ToxicityModel.__new__(ToxicityModel)
        vars(fitted).update(shared.value)
        for batch in batches:
            texts = [t or b"" for t in batch.column(len(names)).cast(pa.binary()).to_pylist()]
            score = np.concatenate([fitted.scores(texts[a:b]) for a, b in chunks(texts, 4_000_000)]) if texts else np.empty(0)
            more = [pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *more], names=[*(f"_{i}" for i in range(len(names))), "score", "predicted"])

    fields = [StructField(f"_{i}", kept.schema[i].dataType) for i in range(len(names))]
    out = given.mapInArrow(run, StructType([*fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
    return out.withColumnsRenamed({f"_{i}": c for i, c in enumerate(names)})
