"""Toxicity by a convolutional text classifier in numpy.

Words, and their first ``PREFIX`` bytes, are hashed to rows of an embedding table and the two rows
added; filters of several widths slide over the words, each keeps its maximum over the whole text, and a logistic layer adds them up. Embeddings start from the
smoothed log-odds of the words (first dimension) and small noise, so that single telling words are
found soon; all parameters are then trained together.

The threshold is calibrated by language on a part of the training documents that the weights never
saw, and the logit is shifted by it, so that a score of 0.5 is the threshold in every language. The
language is guessed from the words of the text alone (naive Bayes over the same hashed words); the
lang column only serves to learn that guess from training documents. Languages beyond the
``MAX_LANGUAGES`` most frequent of the training documents are guessed as one, which has the threshold of all.

Every labelled document outside the held-out fold is learned from, whole. They are dealt by a hash to
shards of about ``SHARD_BYTES`` of hashed words, one row each of a written table. Counts of words are
summed over all shards. In each of ``EPOCHS`` rounds every shard is trained on in a task of its own from
the same parameters, and these are then averaged: a word's row over the shards that moved it, all others
over all shards. The means are of whole numbers (``_SCALE``), so the order of the shards changes nothing.
Thresholds come from running sums over all calibration documents. The driver holds one set of parameters.
Scoring is one pass over whole texts without a shuffle.

Defined results: null and empty texts have no words and get the score of a text of blanks; rows
without a label or id are scored but never learned from; of several labels of one id the largest
counts; with labels of one kind only, or none, all scores are 0; repeated rows have equal scores;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm import tokens
from brightloom.llm.common import discard, doc_bucket, materialise
from brightloom.operators.ordered import key_range, with_ahead

FOLDS, HELD_OUT = 5, 0
SHARD_BYTES = 8 << 20  # of hashed words, four bytes each
DOC_BYTES = 64  # what a document counts beside its words
PREFIX = 6
BUCKETS = 1 << 16
DIMENSIONS, FILTERS, WIDTHS = 8, 12, (1, 2, 3)
EPOCHS, BATCH = 4, 64
CHUNK = 1 << 19
MAX_LANGUAGES = 32
_PAD = max(WIDTHS)
_PART = 1 << 17  # words of documents that are looked at together
_SCALE, _MOST = float(1 << 36), 1000.0  # parameters are summed as whole numbers of this unit, within this bound


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its beginning, and the rows' offsets."""
    found = tokens.words(data, offsets, PREFIX)
    return np.stack((found.hash >> np.uint64(48), found.prefix >> np.uint64(48)), axis=1).astype(np.int32), found.rows


def padded(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with blanks (bucket BUCKETS) after each document, and for each document where it and
    its filter positions begin and end in turn: every word, or one blank of a text without words, so
    that no filter reaches from one document into the next."""
    size = np.diff(rows)
    at = np.concatenate(([0], np.cumsum(size + _PAD)))
    out = np.full((at[-1], 2), BUCKETS, np.int32)
    out[np.arange(len(words)) + _PAD * np.repeat(np.arange(len(size)), size)] = words
    return out, np.stack((at[:-1], at[:-1] + np.maximum(size, 1)), axis=1).ravel()


@dataclass
class Model:
    """embed: bucket by dimension, the last row the blank's; filters: by width (offset, dimension,
    filter); bias and out: by filter of all widths; guess: language by bucket; shift: by language."""

    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    intercept: float
    guess: np.ndarray
    shift: np.ndarray

    def responses(self, words: np.ndarray) -> list[np.ndarray]:
        """Each width's filters at every position."""
        e = self.embed[words[:, 0]] + self.embed[words[:, 1]]
        found = []
        for filters in self.filters:
            total = e @ filters[0]
            for j in range(1, len(filters)):
                total[:-j] += e[j:] @ filters[j]
            found.append(total)
        return found

    def scores(self, words: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each document, with its language's threshold at 0.5."""
        logits, language = self.logits(words, rows), self.languages(words, rows)
        return _sigmoid(logits - self.shift[language])

    def logits(self, words: np.ndarray, rows: np.ndarray) -> np.ndarray:
        text, at = padded(words, rows)
        if not len(at):
            return np.zeros(0)
        best = np.concatenate([np.maximum.reduceat(r, at, axis=0)[::2] for r in self.responses(text)], axis=1)
        return np.maximum(best + self.bias, 0) @ self.out + self.intercept

    def languages(self, words: np.ndarray, rows: np.ndarray) -> np.ndarray:
        text, at = padded(words, rows)
        if not len(at):
            return np.zeros(0, int)
        return np.add.reduceat(self.guess[text[:, 0]], at[::2], axis=0).argmax(axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _guess_table(words: np.ndarray, rows: np.ndarray, langs: list[str | None]) -> np.ndarray:
    """Log-probability of each bucket by language, blanks 0; one column without any language. Languages
    beyond the ``MAX_LANGUAGES`` most frequent share the last column."""
    names = sorted({x for x in langs if x is not None})
    names = sorted(names, key=lambda x: (-langs.count(x), x))[:MAX_LANGUAGES]
    others = any(x is not None and x not in names for x in langs)
    of = np.array([-1 if x is None else names.index(x) if x in names else len(names) for x in langs])
    return _log_shares(_language_counts(words, rows, of, len(names) + others))


def _language_counts(words: np.ndarray, rows: np.ndarray, lang: np.ndarray, n: int) -> np.ndarray:
    """How often each bucket is a word's in the documents of each of ``n`` languages (-1: none)."""
    of = np.repeat(lang, np.diff(rows))
    return np.array([np.bincount(words[of == k, 0], minlength=BUCKETS) for k in range(n)], np.int64).reshape(n, BUCKETS)


def _log_shares(counts: np.ndarray) -> np.ndarray:
    table = np.zeros((BUCKETS + 1, max(1, len(counts))), np.float32)
    for k, row in enumerate(counts):
        table[:-1, k] = np.log((row + 0.1) / (row + 0.1).sum())
    return table


def _documents_with(words: np.ndarray, rows: np.ndarray, y: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """Of either label, how many of the documents marked by ``fit`` have each bucket."""
    doc = np.repeat(np.arange(len(y)), np.diff(rows))
    pairs = (doc[:, None] * BUCKETS + words)[fit[doc]]
    pairs = np.unique(pairs)
    return np.stack([np.bincount(pairs[y[pairs // BUCKETS] == label] % BUCKETS, minlength=BUCKETS) for label in (0, 1)])


@dataclass
class Shard:
    """Training documents: hashed words, rows' offsets, labels, languages by number, and whether each only sets thresholds."""

    number: int
    words: np.ndarray
    rows: np.ndarray
    y: np.ndarray
    lang: np.ndarray
    calibrate: np.ndarray


_DOCS = "doc_id bigint, lang string, words binary"
_SHARDS = "shard int, words binary, rows binary, y binary, lang binary, calibrate binary"


@tokens.lean
def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tokens.text_buffers(batch.column("text"))
        out = []
        for lo, hi in tokens.row_chunks(offsets, CHUNK):
            words, rows = hashed_words(data, offsets[lo : hi + 1])
            words = words.astype("<u2")
            out += [words[a:b].tobytes() for a, b in zip(rows[:-1], rows[1:])]
        yield pa.RecordBatch.from_pydict({name: batch.column(name) for name in ("doc_id", "lang")} | {"words": pa.array(out, pa.binary())})


def _dealt(table: pa.Table) -> pa.Table:
    """The documents of one shard, in order, as one row."""
    table = table.sort_by([(name, "ascending") for name in ("doc_id", "words", "lang", "y")])
    words = table["words"].to_pylist()
    rows = np.concatenate(([0], np.cumsum([len(w) // 4 for w in words]))).astype("<i8")
    column = lambda name, kind: [table[name].to_numpy().astype(kind).tobytes()]
    shard = pa.array([table["shard"][0].as_py()], pa.int32())
    parts = [[b"".join(words)], [rows.tobytes()], column("y", "i1"), column("lang", "<i4"), column("calibrate", "?")]
    return pa.table([shard, *(pa.array(p, pa.binary()) for p in parts)], ["shard", "words", "rows", "y", "lang", "calibrate"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for r in range(batch.num_rows):
            number, words, rows, y, lang, calibrate = (batch.column(name)[r].as_py() for name in ("shard", "words", "rows", "y", "lang", "calibrate"))
            pairs = np.frombuffer(words, "<u2").reshape(-1, 2).astype(np.int32)
            yield Shard(number, pairs, np.frombuffer(rows, "<i8"), np.frombuffer(y, "i1").astype(int), np.frombuffer(lang, "<i4"), np.frombuffer(calibrate, "?"))


def _counted(languages: int) -> Callable:
    @tokens.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((languages + 2, BUCKETS), np.int64)
        for s in _shards(batches):
            total[:languages] += _language_counts(s.words, s.rows, s.lang, languages)
            total[languages:] += _documents_with(s.words, s.rows, s.y, ~s.calibrate)
        kind, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[kind, bucket])], ["kind", "bucket", "n"])

    return run


def _counts(shards: DataFrame, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Words by language, and by label the documents that are trained on, with each bucket."""
    sums = shards.mapInArrow(_counted(languages), "kind int, bucket int, n bigint").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((languages + 2, BUCKETS), np.int64)
    total[sums["kind"].to_numpy(), sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return total[:languages], total[languages:]


@dataclass
class Training:
    """Model and state of its training: per row of ``embed`` the squared steps so far; of the other
    parameters both moments of Adam, and the number of steps."""

    model: Model
    squares: np.ndarray
    first: list[np.ndarray]
    second: list[np.ndarray]
    step: float = 0.0

    def params(self) -> list[np.ndarray]:
        return [*self.model.filters, self.model.bias, self.model.out]

    def table(self) -> np.ndarray:
        """All of it as rows of DIMENSIONS + 1 figures: buckets, then the rest end to end."""
        rest = [x.ravel() for x in (*self.params(), *self.first, *map(np.sqrt, self.second))] + [[self.model.intercept, self.step]]
        rest = np.concatenate(rest)
        rest = np.concatenate((rest, np.zeros(-len(rest) % (DIMENSIONS + 1)))).reshape(-1, DIMENSIONS + 1)
        return np.concatenate((np.hstack((self.model.embed[:-1], self.squares[:-1])), rest))

    def take(self, table: np.ndarray) -> None:
        """The state that ``table`` gave, or a mean of several."""
        self.model.embed[:-1], self.squares[:-1] = table[:BUCKETS, :DIMENSIONS], table[:BUCKETS, DIMENSIONS:]
        rest, at = table[BUCKETS:].ravel(), 0
        for x in (*self.params(), *self.first, *self.second):
            x[...] = rest[at : at + x.size].reshape(x.shape)
            at += x.size
        for x in self.second:
            x *= x
        self.model.intercept, self.step = float(rest[at]), float(rest[at + 1])


def started(guess: np.ndarray, seen: np.ndarray, n: tuple[int, int], seed: int = 7) -> Training:
    """Parameters before any training. ``seen`` are documents of either label by bucket, ``n`` all of them; without
    both labels nothing is to be trained, and every score is 0."""
    rng = np.random.default_rng(seed)
    n_out = FILTERS * len(WIDTHS)
    model = Model(np.zeros((BUCKETS + 1, DIMENSIONS), np.float32), [np.zeros((w, DIMENSIONS, FILTERS), np.float32) for w in WIDTHS], np.zeros(n_out), np.zeros(n_out), -30.0, guess, np.zeros(guess.shape[1]))
    if min(n):
        model.embed[:-1] = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
        model.embed[:-1, 0] = (np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))) / 2
        for filters in model.filters:
            filters[:] = rng.normal(0, 0.2, filters.shape)
            filters[:, 0, :] += rng.uniform(0, 1, filters[:, 0, :].shape)
        model.out = rng.uniform(0, 0.3, n_out)
        model.bias, model.intercept = np.full(n_out, -0.5), -1.0
    out = Training(model, np.full((BUCKETS + 1, 1), 1e-3, np.float32), [], [])
    out.first, out.second = ([np.zeros(p.shape) for p in [*out.params(), np.zeros(1)]] for _ in range(2))
    return out


def _peaks(model: Model, parts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each document, given by its words: every filter's maximum, and by width the buckets under the
    filters' offsets there (offset, document, filter, half)."""
    at_word = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    best, under = [], [[] for _ in WIDTHS]
    for a, b in tokens.row_chunks(at_word, _PART):
        text, at = padded(np.concatenate(parts[a:b]), at_word[a : b + 1] - at_word[a])
        found = model.responses(text)
        where = [np.stack([r[lo:hi].argmax(axis=0) + lo for lo, hi in zip(at[::2], at[1::2])]) for r in found]
        best.append(np.concatenate([r[w, np.arange(FILTERS)] for r, w in zip(found, where)], axis=1))
        for k, w in enumerate(where):
            under[k].append(np.stack([text[np.minimum(w + j, len(text) - 1)] for j in range(WIDTHS[k])]))
    return np.concatenate(best), [np.concatenate(u, axis=1) for u in under]


def train(state: Training, shard: Shard, class_weight: tuple[float, float], rng: np.random.Generator) -> np.ndarray:
    """One pass over the documents of a shard that do not set thresholds, in random order. Returns which
    buckets moved."""
    model, words, rows, y = state.model, shard.words, shard.rows, shard.y
    moved_rows = np.zeros(BUCKETS + 1, bool)
    order = rng.permutation(np.flatnonzero(~shard.calibrate))
    for b in range(0, len(order), BATCH):
        docs = order[b : b + BATCH]
        state.step += 1
        best, under = _peaks(model, [words[rows[k] : rows[k + 1]] for k in docs])
        z = np.maximum(best + model.bias, 0)
        p = _sigmoid(z @ model.out + model.intercept)
        d = (p - y[docs]) * np.where(y[docs] == 1, class_weight[1], class_weight[0]) / len(docs)
        dz = d[:, None] * model.out * (z > 0)
        grads, touched, moved = [], [], []
        for k, filters in enumerate(model.filters):
            dk = dz[:, k * FILTERS : (k + 1) * FILTERS]
            g = np.zeros_like(filters)
            for j, token in enumerate(under[k]):
                g[j] = np.einsum("nf,nfd->df", dk, model.embed[token[:, :, 0]] + model.embed[token[:, :, 1]])
                for half in (0, 1):
                    touched.append(token[:, :, half].ravel())
                    moved.append((dk[:, :, None] * filters[j].T[None]).reshape(-1, DIMENSIONS))
            grads.append(g)
        grads += [dz.sum(axis=0), z.T @ d + 1e-4 * model.out, np.array([d.sum()])]
        intercept = np.array([model.intercept])
        for i, (param, g) in enumerate(zip([*state.params(), intercept], grads, strict=True)):
            state.first[i] = 0.9 * state.first[i] + 0.1 * g
            state.second[i] = 0.99 * state.second[i] + 0.01 * g * g
            param -= (0.02 * (state.first[i] / (1 - 0.9**state.step)) / (np.sqrt(state.second[i] / (1 - 0.99**state.step)) + 1e-8)).astype(param.dtype)
        model.intercept = float(intercept[0])
        token, back = np.unique(np.concatenate(touched), return_inverse=True)
        g = np.zeros((len(token), DIMENSIONS), np.float32)
        np.add.at(g, back, np.concatenate(moved).astype(np.float32))
        state.squares[token] += (g * g).mean(axis=1, keepdims=True)
        model.embed[token] -= 0.05 * g / np.sqrt(state.squares[token])
        model.embed[-1] = 0
        moved_rows[token] = True
    return moved_rows[:-1]


_FIGURES = [f"x{k}" for k in range(DIMENSIONS + 1)]


def _trained(before: Broadcast, class_weight: tuple[float, float], epoch: int) -> Callable:
    @tokens.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = before.value.table()
        total, n = np.zeros(start.shape, np.int64), np.zeros(len(start), np.int64)
        state = before.value  # this task's parameters; every shard takes those of the start
        for s in _shards(batches):
            if s.calibrate.all():
                continue
            state.take(start)
            moved = train(state, s, class_weight, np.random.default_rng([epoch, s.number]))
            at = np.concatenate((np.flatnonzero(moved), np.arange(BUCKETS, len(start))))
            total[at] += np.rint(np.clip(state.table()[at], -_MOST, _MOST) * _SCALE).astype(np.int64)
            n[at] += 1
        state.take(start)  # the worker keeps the broadcast for its next task
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), *(pa.array(np.ascontiguousarray(total[at, k])) for k in range(DIMENSIONS + 1))], ["at", "n", *_FIGURES])

    return run


def _round(shards: DataFrame, state: Training, class_weight: tuple[float, float], epoch: int) -> None:
    """``state`` after one pass over every shard."""
    before = shards.sparkSession.sparkContext.broadcast(state)
    passed = shards.mapInArrow(_trained(before, class_weight, epoch), "at int, n bigint, " + ", ".join(f"{x} bigint" for x in _FIGURES))
    sums = passed.groupBy("at").agg(*[F.sum(x).alias(x) for x in ("n", *_FIGURES)]).toArrow()  # a row a parameter row
    table = state.table()
    table[sums["at"].to_numpy()] = np.stack([sums[x].to_numpy() for x in _FIGURES], axis=1) / sums["n"].to_numpy()[:, None] / _SCALE
    state.take(table)
    before.destroy()


def _judged(model: Broadcast) -> Callable:
    @tokens.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _shards(batches):
            docs = np.flatnonzero(s.calibrate)
            at = np.concatenate(([0], np.cumsum(np.diff(s.rows)[docs])))
            for a, b in tokens.row_chunks(at, _PART):
                words = np.concatenate([s.words[s.rows[k] : s.rows[k + 1]] for k in docs[a:b]])
                rows = at[a : b + 1] - at[a]
                figures = model.value.languages(words, rows).astype(np.int32), s.y[docs[a:b]].astype(np.int32), model.value.logits(words, rows).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in figures], ["language", "y", "logit"])

    return run


def thresholds(judged: DataFrame, least: int = 25) -> dict[int, float]:
    """The threshold of the highest F1, halfway to the next lower logit, of all of ``judged`` (language, y,
    logit; under -1) and of each language with ``least`` documents of either label. Nothing without both labels."""
    grouped = judged.select(F.explode(F.array(F.lit(-1), F.col("language"))).alias("of"), "y", "logit")
    sizes = {r["of"]: (r["n"] - r["ones"], r["ones"]) for r in grouped.groupBy("of").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).collect()}  # a row a language
    if not min(sizes.get(-1, (0, 0))):
        return {}
    ones = {k: n[1] for k, n in sizes.items() if k == -1 or k < MAX_LANGUAGES and min(n) >= least}  # a column beyond them is of all other languages
    counted = grouped.where(F.col("of").isin(*ones)).groupBy("of", "logit").agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
    placed = with_ahead(counted, ["of"], key_range(counted, -F.col("logit")), [F.desc("logit")], {"above": F.col("n"), "hit": F.col("ones")})
    all_ones = F.element_at(F.create_map(*[F.lit(x) for pair in ones.items() for x in pair]), F.col("of"))
    f1 = 2 * (F.col("hit") + F.col("ones")) / (F.col("above") + F.col("n") + all_ones)
    best = {r["of"]: r["logit"] for r in placed.groupBy("of").agg(F.max(F.struct(f1.alias("f1"), "logit"))["logit"].alias("logit")).collect()}
    cut = F.element_at(F.create_map(*[F.lit(x) for pair in best.items() for x in pair]), F.col("of"))
    lower = {r["of"]: r["logit"] for r in counted.where(F.col("logit") < cut).groupBy("of").agg(F.max("logit").alias("logit")).collect()}
    return {k: (x + lower[k]) / 2 if k in lower else x - 1 for k, x in best.items()}


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of all labelled documents outside the held-out fold."""
    spark, scratch, kept = docs.sparkSession, [], []
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (doc_bucket(F.col("doc_id"), FOLDS) != HELD_OUT))
    )
    usable = usable.groupBy("doc_id").agg(F.max("y").alias("y"))
    lang = F.col("lang").cast("string").alias("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang).where(doc_bucket(F.col("doc_id"), FOLDS) != HELD_OUT)
    # labels grow with the documents, so neither side is broadcast; hashed words are less to shuffle than texts
    words = materialise(plain.mapInArrow(_hashed, _DOCS).join(usable.hint("merge"), "doc_id"), scratch, codec="zstd")
    calibrate = F.crc32(F.concat(F.lit("calibrate"), F.col("doc_id").cast("string")).cast("binary")) % 4 == 0
    size, *n = words.agg(F.sum(F.octet_length("words").cast("long") + DOC_BYTES), *[F.count_if(~calibrate & (F.col("y") == label)) for label in (0, 1)]).first()
    by_size = [F.desc("n"), F.col("lang")]
    names = [r["lang"] for r in words.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n")).orderBy(*by_size).limit(MAX_LANGUAGES + 1).collect()]
    languages, names = len(names), names[:MAX_LANGUAGES]
    place = F.array_position(F.array(*map(F.lit, names)), F.col("lang")) if names else F.lit(0)
    number = F.when(F.col("lang").isNull(), -1).when(place > 0, place - 1).otherwise(len(names)).cast("int")
    parts = max(1, math.ceil((size or 0) / SHARD_BYTES))
    dealt = words.select(F.pmod(F.xxhash64("doc_id", "words"), F.lit(parts)).cast("int").alias("shard"), "doc_id", "y", number.alias("lang"), calibrate.alias("calibrate"), "words")
    shards = materialise(dealt.groupBy("shard").applyInArrow(_dealt, _SHARDS), kept, codec="zstd")
    discard(spark, scratch)
    by_language, seen = _counts(shards, languages)
    state = started(_log_shares(by_language), seen, n)
    if min(n):
        class_weight = tuple(0.5 * sum(n) / x for x in n)
        for epoch in range(EPOCHS):
            _round(shards, state, class_weight, epoch)
        model = spark.sparkContext.broadcast(state.model)
        judged = materialise(shards.mapInArrow(_judged(model), "language int, y int, logit double"), kept)
        found = thresholds(judged)
        state.model.shift[:] = found.get(-1, 0.0)
        for k in found.keys() - {-1}:
            state.model.shift[k] = found[k]
        model.destroy()
    discard(spark, kept)
    return state.model


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # its size is fixed by the parameters

    @tokens.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tokens.text_buffers(batch.column("text"))
            found = [model.value.scores(*hashed_words(data, offsets[lo : hi + 1])) for lo, hi in tokens.row_chunks(offsets, CHUNK)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(np.concatenate([np.zeros(0), *found]), pa.float64())})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id",
        F.coalesce(doc_bucket(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
