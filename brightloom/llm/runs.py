r"""Runs of repeated word patterns, found by block matching.

A run is a longest stretch of words with smallest period q (words q apart are equal), of at least
``max(24, 3 * q)`` words. For each scale b = 1, 2, 4, ... the aligned blocks of b words are keys of an
Aho-Corasick automaton over integer sequences, which is led over the words; a block that occurs again
b to 2b - 1 words on is a seed for that distance. A run of period q in [b, 2b) holds at least one
aligned block whose next copy is q words on, so no run is missed. Seeds are extended in both
directions by comparing words, never hashes.

Before that a text is parted at words that occur fewer than three times in their part, which no run
can hold, again and again; most texts have nothing left. Seeds inside a stretch of a smaller
period are not extended: as their block is no shorter than that period, their distance is a multiple of
it. Blocks of more than ``DEPTH`` words are keys of that many names of smaller blocks, searched strand
by strand, so that keys stay short at every scale.

A text is one unit of work: memory is in proportion to the longest text, and to its words times the
logarithm of the words in time.

Defined results: null and empty texts have no words, no run and an empty collapsed text; repeated rows
count each; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.llm.tokens import lean

# The shortest run in words and in periods, a word, the planted share and its shape.
LEAST_WORDS, LEAST_PERIODS = 24, 3
WORD = r"[^\x20\x09-\x0D]++"
DEPTH = 512  # words or names of a key
_ROUNDS = 16
_PROBES = 8  # places of a seed's first period that are compared before it is extended
_OUT = pa.schema([("doc_id", pa.int64()), ("words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])
_DDL = "doc_id long, words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def block_names(w: np.ndarray, b: int, names: dict[int, np.ndarray]) -> np.ndarray:
    """For each place the name of an aligned block of ``b`` words that occurs there, or -1. ``names``:
    those of smaller scales."""
    stride = max(1, b // DEPTH)
    base = (w if stride == 1 else names[stride]) + 1  # 0 is no block's name, and in no key
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for name, start in enumerate(range(0, len(w) - b + 1, b)):
        automaton.add_word(tuple(base[start : start + b : stride].tolist()), name)  # the last of equal blocks gives its name
    automaton.make_automaton()
    out, back = np.full(len(w), -1, np.int64), b // stride - 1
    for strand in range(stride):
        for end, name in automaton.iter(tuple(base[strand::stride].tolist())):
            out[strand + (end - back) * stride] = name
    return out


def _extended(w: np.ndarray, low: int, high: int, d: int) -> tuple[int, int]:
    """The longest [low, high) around the given one in which each word equals the one ``d`` on."""
    n, step = len(w) - d, 64
    while high < n:
        same = w[high : min(n, high + step)] == w[high + d : min(n, high + step) + d]
        if not same.all():
            high += int(same.argmin())
            break
        high, step = high + len(same), step * 2
    step = 64
    while low > 0:
        at = max(0, low - step)
        same = (w[at:low] == w[at + d : low + d])[::-1]
        if not same.all():
            low -= int(same.argmin())
            break
        low, step = at, step * 2
    return low, high


def _primitive(w: np.ndarray, low: int, d: int) -> bool:
    """Whether the ``d`` words from ``low`` on are no repetition of fewer."""
    rest, f = d, 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            p = d // f
            if (w[low : low + d - p] == w[low + p : low + d]).all():
                return False
            while rest % f == 0:
                rest //= f
        f += 1
    return True


def _runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a part."""
    n, found = len(w), []
    stretches: list[tuple[int, int]] = []  # of all periods so far, also too short for a run
    names: dict[int, np.ndarray] = {}
    b = 1
    while LEAST_PERIODS * b <= n:
        names[b] = at = block_names(w, b, names)
        names.pop(b // DEPTH // 2, None)
        blocks = (n - b) // b  # aligned blocks with a place b words on
        later = np.full(blocks * b, -2, np.int64)
        tail = at[b : b + blocks * b]
        later[: len(tail)] = tail
        own = at[: blocks * b : b]
        j, t = np.nonzero((later.reshape(blocks, b) == own[:, None]) & (own[:, None] >= 0))
        i, d = j * b, t + b
        if len(i) and stretches:
            reach = np.zeros(n + 1, np.int64)
            low, high = np.array(stretches).T
            np.maximum.at(reach, low, high)
            keep = i + d + b > np.maximum.accumulate(reach)[i]
            i, d = i[keep], d[keep]
        # the leftmost block of a run is followed by a whole period of equal pairs
        keep = i + 2 * d < n
        i, d = i[keep], d[keep]
        for k in range(1, _PROBES + 1):
            x = i + d * k // _PROBES
            keep = w[x] == w[x + d]
            i, d = i[keep], d[keep]
        order = np.lexsort((i, d))
        distance, end = 0, 0
        fresh = []
        for s, q in zip(i[order].tolist(), d[order].tolist(), strict=True):
            if q == distance and s + b <= end:
                continue
            low, high = _extended(w, s, s + b, q)
            distance, end = q, high
            if high - low >= 2 * q and _primitive(w, low, q):
                fresh.append((low, high + q))
                if high + q - low >= max(LEAST_WORDS, LEAST_PERIODS * q):
                    found.append((low, high + q - low, q))
        stretches += fresh
        b *= 2
    return found


def _parts(w: np.ndarray) -> Iterator[tuple[int, int]]:
    """[low, high) of stretches of at least ``LEAST_WORDS`` words that hold every run. After ``_ROUNDS``
    rounds of parting, a stretch may still have words that occur fewer than three times."""
    todo = [(0, len(w), 0)]
    while todo:
        low, high, nth = todo.pop()
        part = w[low:high] if nth == 0 else np.unique(w[low:high], return_inverse=True)[1]
        rare = np.flatnonzero(np.bincount(part)[part] < LEAST_PERIODS)
        if not len(rare) or nth == _ROUNDS:
            yield low, high
            continue
        edges = np.concatenate(([-1], rare, [high - low]))
        wide = np.flatnonzero(np.diff(edges) > LEAST_WORDS)
        todo += [(low + int(edges[k]) + 1, low + int(edges[k + 1]), nth + 1) for k in wide]


def find_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a list of words, by start and period."""
    if len(words) < LEAST_WORDS:
        return []
    ids: dict = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    out = []
    for low, high in _parts(w):
        part = np.unique(w[low:high], return_inverse=True)[1].astype(np.int64)
        out += [(low + s, length, q) for s, length, q in _runs(part)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that stand after the first period of some run."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        step[start + q] += 1
        step[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0)]


@lean
def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, runs, texts = [], [], []
        for text in batch.column(1).cast(pa.binary()):
            words = (text.as_py() or b"").split()  # bytes are parted at ASCII white space only
            found = find_runs(words)
            counts.append(len(words))
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
            texts.append(b" ".join(collapsed(words, found)))
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, _OUT.field(2).type), pa.array(texts, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, schema=_OUT)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, words, its runs by start and period, and the text
    of the words that remain when runs are reduced to their first period, with single blanks."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_batches, _DDL)


def with_planted(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text), in which by a hash of the id one text in ten repeats some of its words to
    its end; a null id hashes as an empty text."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words, n, g = F.col("w"), F.size("w").cast("long"), F.floor(F.col("h") / 10)
    a = g % n
    p = F.floor((n - a) / (3 + g % 8)) + 1
    again = F.transform(words, lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get(words, (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    found = F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h")).withColumn("w", found)
    rows = rows.withColumn("a", F.when(F.size("w") > 0, a)).withColumn("p", F.when(F.size("w") > 0, p))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def report(docs: DataFrame) -> DataFrame:
    """The digests of ``periodic_runs`` over ``with_planted``: doc_id, n_runs, the run of greatest exponent
    (start, length, period, exponent_milli), runs_sha256 and collapsed_sha256."""
    found = periodic_runs(with_planted(docs))
    # length / period compared exactly: crosswise products of whole numbers
    above = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, r: F.when(best.isNull() | above(r, best), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), _sha(lines).alias("runs_sha256"), _sha(F.col("collapsed")).alias("collapsed_sha256"))
    milli = F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long")
    return rows.select("doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
