"""Quality classifier: hashed word n-grams, logistic regression by FTRL-proximal.

A document's features are hashed n-grams over two views of its words: the words
themselves (1 and 2 words) and their shapes (1 to 3: letter case, digits, trailing mark,
length, whether the word repeats one just before). Each gram adds one over the number of
words, so a score is a sparse dot product that does not depend on length. Training
follows the regularised leader over a bounded sample of labelled rows in a fixed order;
the sample is those of least hash of doc_id, so reruns agree.

Defined results: null and empty texts have only the bias and length features and get a
score like any other; labels that are null are left out, repeated labels of a document
are averaged (a tie counts as 1); without labels of both kinds the score is the share of
label 1 (0.5 without labels); repeated rows each give a row; a null doc_id is not held
out; where rows of several texts share a labelled doc_id the least text is learned from;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm.kernels import COEF, LOWER, U64, blocks, lean, mix, small_batches, span_hashes, word_spans

BITS = 18
MAX_TRAIN = 6000  # labelled rows that are learned from, at most
SCALE = 4.0
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 1e-4

_upper = np.zeros(256, bool)
_upper[65:91] = True
_lower = np.zeros(256, bool)
_lower[97:123] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True
_high = np.arange(256) >= 128
_mark = ~(_upper | _lower | _digit | _high)


def shapes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A number for the look of each word; repeats count within a document only."""

    def count(table: np.ndarray) -> np.ndarray:
        acc = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(table[buf], out=acc[1:])
        return acc[ends] - acc[starts]

    up, low, dig, mark = (count(t) for t in (_upper, _lower, _digit, _mark))
    first, last = buf[starts], buf[ends - 1]
    out = np.where(_mark[last], last, 0).astype(np.int64)
    out = out * 3 + np.minimum(up, 2)
    out = out * 2 + (low > 0)
    out = out * 2 + (dig > 0)
    out = out * 4 + np.minimum(mark, 3)
    out = out * 2 + _upper[first]
    out = out * 4 + np.minimum((ends - starts) // 4, 3)
    again = np.zeros(len(words), np.int64)
    again[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    again[2:] |= (words[2:] == words[:-2]) & (doc[2:] == doc[:-2])
    return mix(out.astype(U64) * U64(2) + again.astype(U64) + COEF[40])


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, feature ids, their document, words of each document) by blocks."""
    mask = U64((1 << BITS) - 1)
    for i, j, buf, offs in blocks(texts, 1 << 20):
        starts, ends, first = word_spans(buf, offs)
        n = np.diff(first)
        words = span_hashes(buf, starts, ends)
        folded = span_hashes(LOWER[buf], starts, ends)
        doc = np.repeat(np.arange(j - i), n)
        look = shapes(buf, starts, ends, words, doc)
        ids, docs = [np.minimum(np.log2(n + 1), 20).astype(np.int64)], [np.arange(j - i)]
        for view, most in ((folded, 2), (look, 3)):
            acc = np.zeros(len(view), U64)
            for order in range(1, most + 1):
                m = len(view) - order + 1
                if m <= 0:
                    break
                acc = acc[:m] + view[order - 1 : order - 1 + m] * COEF[order]
                inside = doc[:m] == doc[order - 1 :]
                got = (mix(acc + COEF[20 + order]) & mask).astype(np.int64)
                ids.append(np.maximum(got[inside], 32))
                docs.append(doc[:m][inside])
        yield i, j, np.concatenate(ids), np.concatenate(docs), n


@dataclass
class Model:
    bias: float
    weights: np.ndarray  # float32, 2**BITS

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, j, ids, doc, n in features(texts):
            value = np.where(ids < 32, 1.0, SCALE / np.maximum(n, 1)[doc])
            out[i:j] = self.bias + np.bincount(doc, self.weights[ids] * value, minlength=j - i)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def train(texts: list[str | None], labels: list[int]) -> Model:
    """FTRL-proximal over the rows in the given order."""
    weights = np.zeros(1 << BITS, np.float32)
    ones = sum(labels)
    if not labels or ones in (0, len(labels)):
        share = ones / len(labels) if labels else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(float(np.log(share / (1 - share))), weights)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(texts), 256):
        for i, j, ids, doc, n in features(pa.array(texts[at : at + 256], pa.large_string())):
            order = np.argsort(doc, kind="stable")
            cut = np.searchsorted(doc[order], np.arange(j - i + 1))
            for r in range(j - i):
                got, count = np.unique(ids[order[cut[r] : cut[r + 1]]], return_counts=True)
                rows.append((got.astype(np.int32), np.where(got < 32, 1.0, count * (SCALE / max(1, n[r]))).astype(np.float32)))
    z, s = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = sb = 0.0

    def weight(z, s):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(s)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for (ids, value), y in zip(rows, labels, strict=True):
            w = weight(z[ids], s[ids])
            bias = -zb / ((BETA + sb**0.5) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(bias + w @ value, -40, 40)))
            g = (p - y) * value
            step = (np.sqrt(s[ids] + g * g) - np.sqrt(s[ids])) / ALPHA
            z[ids] += g - step * w
            s[ids] += g * g
            gb = p - y
            zb += gb - ((sb + gb * gb) ** 0.5 - sb**0.5) / ALPHA * bias
            sb += gb * gb
    return Model(float(-zb / ((BETA + sb**0.5) / ALPHA)), weight(z, s).astype(np.float32))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Learn ``labels.quality`` from at most ``max_train`` labelled rows that are not held out.

    The rows are picked where they lie; only the sample goes to the one task that trains.
    """
    small_batches(docs.sparkSession)
    known = labels.filter("quality is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    # ids of rows that exist are few enough to broadcast: max_train rows of two numbers
    sample = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[int, tuple[str | None, int]] = {}
        for batch in batches:
            for i, text, y in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if i not in texts or (text or "") < (texts[i][0] or ""):
                    texts[i] = (text, y)
        order = sorted(texts, key=lambda i: (int(mix(np.array([i], np.int64).view(U64))[0]), i))
        model = train([texts[i][0] for i in order], [texts[i][1] for i in order])
        yield pa.RecordBatch.from_arrays([pa.array([model.bias]), pa.array([model.weights.tobytes()], pa.binary())], ["bias", "weights"])

    got = rows.repartition(1).mapInArrow(lean(run), "bias double, weights binary").first()
    if got is None:
        return train([], [])
    return Model(got.bias, np.frombuffer(got.weights, np.float32))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights.tobytes()))  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(shared.value[0], np.frombuffer(shared.value[1], np.float32))
        for batch in batches:
            s = m.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs`` that the model does not reject, columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights.tobytes()))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(shared.value[0], np.frombuffer(shared.value[1], np.float32))
        for batch in batches:
            yield batch.filter(pa.array(m.scores(batch.column(at)) >= threshold))

    return docs.mapInArrow(lean(run), docs.schema)
