"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's score for good is linear in its features and those of the lines
before and after; a 2 x 2 table scores neighbouring labels. Forward-backward gives each line's
probability of good; their mean, weighted by length in bytes, is the document's, and a logistic
curve fitted on the training documents maps it to the probability of label 1.

Training is on the driver, on at most about ``MAX_TRAIN`` labelled documents and about ``MAX_BYTES``
of text, of which each line takes ``LINE_BYTES`` more, drawn by a hash of the id (the documented bounds of
the sample; whole texts). Lines start with their document's label; lines of bad
documents that the first fit finds good take that label for the second. Scoring is one pass without
a shuffle.

Defined results: null and empty texts are one empty line; rows without a label or id are scored but
never learned from; of several labels of one id the largest counts; without any labelled row all
scores are 0.5; repeated rows have equal scores; further columns are ignored (``score``) or kept,
whatever their names (``good_documents``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.llm import tokens
from brightloom.llm.common import discard, doc_bucket, materialise, packed, unit_hash, unpacked

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
MAX_TRAIN = 6000
MAX_BYTES = 64 << 20
CHUNK = 2 << 20
_SEGMENT = 100  # lines of a training sequence
_STRIP = 32  # lines of a chain that are taken one after another
LINE_BYTES = 100  # what a line of a training text costs beside its text


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[[ord(c) for c in chars]] = 1
    return out


_UPPER, _LOWER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz")
_HIGH = (np.arange(256) >= 128).astype(np.uint8)
_DIGIT, _SPACE = _table("0123456789"), _table(" \t\r\x0b\x0c")
_SYMBOL, _LOUD, _BAR, _STOP = _table("#$%&*@^~=_{}<>\\+"), _table("!?"), _table("|"), _table(".,;:'\"()-")
_MARK = np.maximum.reduce([_SYMBOL, _LOUD, _BAR])
_CLASSES = (_UPPER, _LOWER, _HIGH, _DIGIT, _SPACE, _SYMBOL, _LOUD, _BAR, _STOP)
N_OWN = 17


@dataclass
class Lines:
    """Own features of each line, its length in bytes and the offsets of each document's lines."""

    own: np.ndarray
    size: np.ndarray
    rows: np.ndarray


def lines(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """Lines of the rows that ``offsets`` delimits."""
    base = int(offsets[0])
    text = data[base : int(offsets[-1])]
    at = offsets - base
    breaks = np.flatnonzero(text == 10)
    start = np.sort(np.concatenate((at[:-1], breaks + 1)))
    # a break that is a row's last byte opens an empty last line there; it sorts before the next row's first
    stop = np.sort(np.concatenate((breaks, at[1:])))
    rows = np.concatenate(([0], np.cumsum(np.diff(np.searchsorted(breaks, at)) + 1)))
    size = stop - start

    def counted(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[stop] - total[start]

    upper, lower, high, digit, space, symbol, loud, bar, point = (counted(c[text]).astype(float) for c in _CLASSES)
    blank = np.ones(len(text) + 1, bool)
    blank[:-1] = (_SPACE[text] == 1) | (text == 10)
    begins = ~blank[:-1]
    begins[1:] &= blank[:-2]
    inner = at[:-1][at[:-1] < len(text)]
    begins[inner] |= ~blank[inner]
    marked = (_MARK[text] == 1) & blank[1:]
    n_words = counted(begins)
    ends_marked = counted(marked)
    power, inverse = tokens._power(len(text) + 1)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(tokens._BYTE[text] * power[: len(text)], out=total[1:])
    doc = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    same = tokens.mixed((total[stop] - total[start]) * inverse[start]) ^ tokens.mixed(doc.astype(np.uint64))
    _, first = np.unique(same, return_index=True)
    repeated = np.ones(len(size))
    repeated[first] = 0
    found = tokens.words(data, offsets)
    echo1, echo2 = np.zeros(len(text), np.uint8), np.zeros(len(text), np.uint8)
    echo1[found.start[1:][found.hash[1:] == found.hash[:-1]]] = 1
    echo2[found.start[2:][found.hash[2:] == found.hash[:-2]]] = 1
    n = np.maximum(size, 1)
    letters = np.maximum(upper + lower + high, 1)
    words = np.maximum(n_words, 1)
    last = np.where(size > 0, text[np.maximum(stop - 1, 0)] if len(text) else 0, 0)
    head = np.where(size > 0, text[np.minimum(start, max(len(text) - 1, 0))] if len(text) else 0, 0)
    own = np.stack(
        [
            np.ones(len(size)), np.log1p(size) / 6, upper / letters, digit / n, symbol / n * 4, loud / n * 4, bar / n * 8, point / n * 4,
            ends_marked / words, np.minimum((n - space) / words, 40) / 10, (n_words <= 3).astype(float), (last == ord(".")).astype(float),
            _UPPER[head].astype(float), repeated * (size > 20), (upper > 0.6 * letters).astype(float) * (letters > 8),
            counted(echo1) / words, counted(echo2) / words,
        ],
        axis=1,
    )
    return Lines(own.astype(np.float32), size, rows)


def with_neighbours(own: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zero at the ends)."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    filled = rows[:-1][np.diff(rows) > 0]
    before[filled] = 0
    after[np.concatenate((filled[1:], rows[-1:])) - 1] = 0
    return np.concatenate((own, before, after), axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _odds(m00: np.ndarray, m01: np.ndarray, m10: np.ndarray, m11: np.ndarray) -> np.ndarray:
    """For each place the logarithm of what 1 becomes under the maps x -> (m00 x + m01) / (m10 x + m11) of
    the places up to it, the nearest applied last. Products of 2 x 2 matrices: within strips of ``_STRIP``
    places side by side, then over the strips by doubling, so no step waits for a single line."""
    n = len(m00)
    strips = -(-n // _STRIP)

    def laid(x: np.ndarray, rest: float) -> np.ndarray:
        out = np.full(strips * _STRIP, rest)
        out[:n] = x
        return np.ascontiguousarray(out.reshape(strips, _STRIP).T)

    def times(x: tuple, y: tuple) -> tuple:
        out = (x[0] * y[0] + x[1] * y[2], x[0] * y[1] + x[1] * y[3], x[2] * y[0] + x[3] * y[2], x[2] * y[1] + x[3] * y[3])
        scale = 1 / np.maximum(np.maximum(out[0], out[1]), np.maximum(out[2], out[3]))
        return tuple(o * scale for o in out)

    m = laid(m00, 1.0), laid(m01, 0.0), laid(m10, 0.0), laid(m11, 1.0)
    for t in range(1, _STRIP):
        for own, new in zip(m, times(tuple(x[t] for x in m), tuple(x[t - 1] for x in m)), strict=True):
            own[t] = new
    total, step = [x[-1].copy() for x in m], 1
    while step < strips:
        for own, new in zip(total, times(tuple(x[step:] for x in total), tuple(x[:-step] for x in total)), strict=True):
            own[step:] = new
        step *= 2
    above = np.concatenate(([1.0], (total[0] + total[1])[:-1]))
    below = np.concatenate(([1.0], (total[2] + total[3])[:-1]))
    good, bad = m[0] * above + m[1] * below, m[2] * above + m[3] * below
    return (np.log(np.maximum(good, 1e-300)) - np.log(np.maximum(bad, 1e-300))).T.ravel()[:n]


def forward_backward(scores: np.ndarray, rows: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each line: its log-odds of good from the lines so far, from those after it, and the
    probability of good. ``pairs`` are the four label pair scores. One line's odds are a fraction of linear
    terms in its neighbour's; a sequence begins with a map that is constant, so all go in one chain."""
    if not len(scores):
        return np.zeros(0), np.zeros(0), np.zeros(0)
    a = np.exp(pairs - pairs.max())
    filled = rows[:-1][np.diff(rows) > 0]
    e = np.exp(np.clip(scores, -200, 200))
    ones = np.ones(len(scores))
    ahead = [e * a[1, 1], e * a[0, 1], ones * a[1, 0], ones * a[0, 0]]
    for m, at in zip(ahead, (np.zeros(len(filled)), e[filled], 0.0, 1.0), strict=True):
        m[filled] = at
    last = np.concatenate((filled[1:], rows[-1:])) - 1
    behind = [ones * a[1, 1], ones * a[1, 0], ones * a[0, 1], ones * a[0, 0]]
    behind[0][:-1] *= e[1:]
    behind[2][:-1] *= e[1:]
    for m, at in zip(behind, (0.0, 1.0, 0.0, 1.0), strict=True):
        m[last] = at
    left, right = _odds(*ahead), _odds(*[m[::-1] for m in behind])[::-1]
    return left, right, _sigmoid(left + right)


@dataclass
class Model:
    """Weights of the features, label pair scores, and the curve from line mean to probability."""

    weights: np.ndarray
    pairs: np.ndarray
    curve: np.ndarray

    def line_probabilities(self, found: Lines) -> np.ndarray:
        scores = with_neighbours(found.own, found.rows).astype(np.float64) @ self.weights
        return forward_backward(scores, found.rows, self.pairs)[2]

    def means(self, found: Lines) -> np.ndarray:
        """Length-weighted mean of the lines' probabilities by document."""
        weight = found.size + 1.0
        return np.add.reduceat(self.line_probabilities(found) * weight, found.rows[:-1]) / np.add.reduceat(weight, found.rows[:-1])

    def scores(self, found: Lines) -> np.ndarray:
        return _sigmoid(self.curve[0] + self.curve[1] * _logit(self.means(found)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _fit_chain(x: np.ndarray, y: np.ndarray, rows: np.ndarray, steps: int = 120, rate: float = 0.1, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the labels by Adam; classes count alike."""
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    inner = np.ones(len(y), bool)
    inner[rows[:-1][np.diff(rows) > 0]] = False
    second = np.flatnonzero(inner)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for step in range(1, steps + 1):
        w, pairs = theta[:-4], theta[-4:].reshape(2, 2)
        scores = x @ w
        ahead, behind, p = forward_backward(scores, rows, pairs)
        gradient = np.concatenate((x.T @ ((y - p) * weight), np.zeros(4)))
        if len(second):
            left, right = _sigmoid(ahead[second - 1]), _sigmoid(scores[second] + behind[second])
            joint = np.exp(pairs)[None] * np.stack((1 - left, left), 1)[:, :, None] * np.stack((1 - right, right), 1)[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            seen = np.zeros((len(second), 4))
            seen[np.arange(len(second)), 2 * y[second - 1].astype(int) + y[second].astype(int)] = 1
            gradient[-4:] = ((seen - joint.reshape(-1, 4)) * weight[second, None]).sum(axis=0)
        gradient -= l2 * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def _fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression on one figure, with a small ridge, by Newton's method."""
    z, b = np.stack((np.ones(len(x)), x), 1), np.array([0.0, 1.0])
    for _ in range(30):
        p = _sigmoid(z @ b)
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        b = b + np.linalg.solve(h, z.T @ (y - p) - 1e-2 * (b - [0.0, 1.0]))
    return b


def train(found: Lines, labels: np.ndarray) -> Model:
    """The model of documents with labels 0 and 1."""
    model = Model(np.zeros(3 * N_OWN), np.zeros((2, 2)), np.array([0.0, 0.0]))
    if not len(labels):
        return model
    size = np.diff(found.rows)
    x = with_neighbours(found.own, found.rows).astype(np.float64)
    pieces = [np.arange(a, b, _SEGMENT) for a, b in zip(found.rows[:-1], found.rows[1:])]
    rows = np.concatenate((*pieces, found.rows[-1:]))
    label = np.repeat(labels, size).astype(float)
    y = label
    for _ in range(2):
        model.weights, model.pairs = _fit_chain(x, y, rows)
        p = model.line_probabilities(found)
        worst = np.repeat(np.minimum.reduceat(p, found.rows[:-1]), size)
        y = np.where((label == 0) & (p > 0.8) & (worst < 0.5), 1.0, label)
    model.curve = _fit_curve(_logit(model.means(found)), labels.astype(float))
    return model


def sample_labels(labels: DataFrame, column: str, folds: int, held_out: int, bound: int) -> DataFrame:
    """At most about ``bound`` ids with their label (doc_id, y), by hash, from the training folds."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (doc_bucket(F.col("doc_id"), folds) != held_out)
    )
    n = usable.count()
    drawn = usable if n <= bound else usable.where(unit_hash(F.col("doc_id"), F.lit(column)) < bound / n)
    return drawn.groupBy("doc_id").agg(F.max("y").alias("y"))


@tokens.lean
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tokens.text_buffers(batch.column("text"))
        own, size, counts = [], [], []
        for lo, hi in tokens.row_chunks(offsets, CHUNK):
            found = lines(data, offsets[lo : hi + 1])
            for k in range(hi - lo):
                a, b = found.rows[k], found.rows[k + 1]
                own.append(found.own[a:b].tobytes())
                size.append(found.size[a:b].tobytes())
        yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "own": pa.array(own, pa.binary()), "size": pa.array(size, pa.binary())})


def within_bytes(texts: DataFrame, bound: int, scratch: list[str], line_bytes: int = 0) -> DataFrame:
    """``texts`` (doc_id, text, ...), or a part of them drawn by a hash of the id that has about ``bound``
    bytes in all; each line counts ``line_bytes`` more."""
    kept = materialise(texts, scratch)
    lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    size = kept.agg(F.sum(F.octet_length("text") + lines.cast("long") * line_bytes)).first()[0] or 0
    return kept if size <= bound else kept.where(unit_hash(F.col("doc_id"), F.lit("bytes")) < bound / size)


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> Model:
    """The model of the labelled documents outside the held-out fold."""
    scratch: list[str] = []
    drawn = F.broadcast(sample_labels(labels, "quality", FOLDS, HELD_OUT, bound))  # at most about ``bound`` rows
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = within_bytes(plain.join(drawn, "doc_id").select("doc_id", "text", "y"), max_bytes, scratch, LINE_BYTES).select("text", "y")
    rows = sorted(((bytes(r["own"]), bytes(r["size"]), r["y"]) for r in texts.mapInArrow(_features, "y int, own binary, size binary").collect()))
    discard(docs.sparkSession, scratch)
    own = np.frombuffer(b"".join(r[0] for r in rows), np.float32).reshape(-1, N_OWN)
    size = np.frombuffer(b"".join(r[1] for r in rows), np.int64)
    at = np.concatenate(([0], np.cumsum([len(r[1]) // 8 for r in rows]))).astype(np.int64)
    return train(Lines(own, size, at), np.array([r[2] for r in rows], int))


def scored(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """(row, text, score) of every row of ``docs``: its other columns as a struct, its text if that is to
    be kept, and the probability of label 1."""

    @tokens.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tokens.text_buffers(batch.column("text"))
            found = [model.scores(lines(data, offsets[lo : hi + 1])) for lo, hi in tokens.row_chunks(offsets, CHUNK)]
            out = {name: batch.column(name) for name in batch.schema.names if name != "text" or keep_text}
            yield pa.RecordBatch.from_pydict(out | {"score": pa.array(np.concatenate([np.zeros(0), *found]), pa.float64())})

    apart = docs.select(packed(docs, "text").alias("row"), F.col("text").cast("string").alias("text"))
    kept = [f for f in apart.schema.fields if f.name != "text" or keep_text]
    return apart.mapInArrow(run, T.StructType([*kept, T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return scored(docs.select("doc_id", "text"), fit(docs, labels)).select(
        "row.doc_id",
        F.coalesce(doc_bucket(F.col("row.doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the classifier rejects."""
    accepted = scored(docs, fit(docs, labels), keep_text=True).where(F.col("score") >= THRESHOLD)
    return accepted.select(*unpacked(docs, "row", text=F.col("text").cast(docs.schema["text"].dataType)))
