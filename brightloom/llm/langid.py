"""Language identification by rank-order profiles of character n-grams.

A profile is a list of the most frequent n-grams (one to three letters, words padded with a blank),
by falling frequency. A document's distance to a language is the sum, over the document's own
profile, of how far each n-gram is out of place in the language's; n-grams that it lacks count the
whole profile length. The nearest language wins.

Profiles are learned on at most about ``PER_LANGUAGE`` training documents of each language, drawn
by a hash of the id (the documented bound of the sample); counting is distributed, and the driver
gets ``PROFILE`` n-grams of each of at most ``MAX_LANGUAGES`` languages. Prediction is one pass
over whole texts without a shuffle.

Defined results: null texts and those without a letter are ``und`` with score 0; without any
learned language every text is; where no training text has a letter, texts with one get the first
language by name with score 0; equally near languages give the first by name, equally frequent
n-grams the first by code points; repeated rows have equal results; further columns are ignored. More
than ``MAX_LANGUAGES`` values of lang in the training documents raise ``ValueError``.
A text of any length is one unit of work; it takes about 60 times its bytes of memory.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brightloom.llm import tokens
from brightloom.llm.common import doc_bucket, unit_hash

FOLDS, HELD_OUT = 5, 0
PROFILE = 300
PER_LANGUAGE = 4000
MAX_LANGUAGES = 1000
CHUNK = 2 << 20
UNKNOWN = "und"
_BLANK = 32
_plane: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point of the basic plane its lower-case letter, or 0 for what is no letter."""
    if not _plane:
        table = np.zeros(1 << 16, np.int64)
        for code in range(1 << 16):
            c = chr(code)
            if c.isalpha():
                low = c.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _plane.append(table)
    return _plane[0]


def _code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters (0 for other characters) of the rows, and the rows' offsets."""
    part = data[int(offsets[0]) : int(offsets[-1])]
    codes = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    lead = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
    out = np.zeros(len(codes), np.int64)
    plain = codes < (1 << 16)
    out[plain] = _letters()[codes[plain]]
    for code in np.unique(codes[~plain]):
        if unicodedata.category(chr(code))[0] == "L":
            out[codes == code] = code
    return out, lead[offsets - offsets[0]]


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, count) of every distinct n-gram of every row, by row and gram, and whether each
    row has a letter. A gram is up to three code points of 21 bits, filled with zeros."""
    letters, at = _code_points(data, offsets)
    n_rows = len(offsets) - 1
    row = np.repeat(np.arange(n_rows), np.diff(at))
    has_letter = np.bincount(row[letters > 0], minlength=n_rows) > 0
    keep = letters > 0
    keep_blank = ~keep  # a blank stays only before a word
    keep_blank[:-1] &= keep[1:] & (row[:-1] == row[1:])
    if len(keep_blank):
        keep_blank[-1] = False
    # each row: blank, words parted by one blank, blank
    kept = np.flatnonzero(keep | keep_blank)
    body, body_row = np.where(keep[kept], letters[kept], _BLANK), row[kept]
    alphabet, dense = np.unique(np.concatenate(([0, _BLANK], body)), return_inverse=True)
    bits = max(1, int(len(alphabet) - 1).bit_length())
    dense = dense[2:].astype(np.int64)
    blank = int(np.searchsorted(alphabet, _BLANK))
    per_row = np.bincount(body_row, minlength=n_rows)
    text = np.full(int((per_row + 2).sum()), blank, np.int64)
    text[np.arange(len(body)) + 2 * body_row + 1] = dense
    text_row = np.repeat(np.arange(n_rows), per_row + 2)
    keys = []
    n = len(text)
    for size in (1, 2, 3):
        m = max(0, n - size + 1)
        gram = np.zeros(m, np.int64)
        inside = np.ones(m, bool)
        some = np.zeros(m, bool)
        for k in range(size):
            gram |= text[k : k + m] << (bits * (2 - k))
            some |= text[k : k + m] != blank
            if 0 < k < size - 1:
                inside &= text[k : k + m] != blank  # no blank within a gram
        inside &= text_row[:m] == text_row[size - 1 : size - 1 + m]
        good = inside & some
        keys.append((text_row[:m][good] << (3 * bits)) | gram[good])
    key = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate((first, [len(key)])))
    key = key[first]
    mask = (1 << bits) - 1
    gram = (alphabet[(key >> (2 * bits)) & mask] << 42) | (alphabet[(key >> bits) & mask] << 21) | alphabet[key & mask]
    return key >> (3 * bits), gram, count, has_letter


@dataclass
class Profiles:
    """``grams`` sorted; ``ranks``: language by gram, PROFILE where the language lacks it."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The nearest language of each row, and one minus its share of the farthest distance."""
        n_rows = len(offsets) - 1
        row, gram, count, has_letter = gram_counts(data, offsets)
        if not self.languages or not len(row):
            return [UNKNOWN] * n_rows, np.zeros(n_rows)
        if not len(self.grams):  # no training text has a letter
            return [self.languages[0] if h else UNKNOWN for h in has_letter], np.zeros(n_rows)
        top = int(count.max()) + 1
        order = np.argsort(row * np.int64(top) + (top - 1 - count), kind="stable")
        row, gram = row[order], gram[order]
        begin = np.searchsorted(row, np.arange(n_rows))
        rank = np.arange(len(row)) - begin[row]
        kept = rank < PROFILE
        row, gram, rank = row[kept], gram[kept], rank[kept]
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        known = self.grams[at] == gram
        size = np.bincount(row, minlength=n_rows)
        distance = np.empty((n_rows, len(self.languages)))
        for k in range(len(self.languages)):
            place = np.where(known, self.ranks[k][at], PROFILE)
            out = np.where(place < PROFILE, np.abs(place - rank), PROFILE)
            distance[:, k] = np.bincount(row, weights=out, minlength=n_rows)
        best = distance.argmin(axis=1)
        score = 1 - distance[np.arange(n_rows), best] / np.maximum(1, size * PROFILE)
        names = [self.languages[b] if h else UNKNOWN for b, h in zip(best, has_letter)]
        return names, np.where(has_letter, np.clip(score, 0, 1), 0.0)


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Profiles:
    """Profiles of the languages of the training documents (doc_id, text, lang)."""
    usable = docs.select("text", F.col("lang").cast("string").alias("lang"), "doc_id").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (doc_bucket(F.col("doc_id"), FOLDS) != HELD_OUT)
    )
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Profiles([], np.zeros(0, np.int64), np.zeros((0, 0), np.int64))
    number = {r["lang"]: k for k, r in enumerate(sorted(sizes, key=lambda r: r["lang"]))}
    rate = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["n"])))])
    drawn = usable.where(unit_hash(F.col("doc_id"), F.lit("lang")) < F.element_at(rate, F.col("lang"))).select("lang", "text")

    @tokens.lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tokens.text_buffers(batch.column("text"))
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for lo, hi in tokens.row_chunks(offsets, CHUNK):
                row, gram, n, _ = gram_counts(data, offsets[lo : hi + 1])
                of = lang[lo:hi][row]
                for k in np.unique(of):
                    g, back = np.unique(gram[of == k], return_inverse=True)
                    yield pa.RecordBatch.from_pydict({"k": np.full(len(g), k), "gram": g, "n": np.bincount(back, weights=n[of == k]).astype(np.int64)})

    summed = drawn.mapInArrow(count, "k bigint, gram bigint, n bigint").groupBy("k", "gram").agg(F.sum("n").alias("n"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("n"), "gram")) - 1).where(F.col("rank") < PROFILE)
    rows = ranked.select("k", "gram", "rank").collect()  # at most PROFILE rows a language
    grams = np.unique(np.array([r["gram"] for r in rows], np.int64))
    ranks = np.full((len(number), len(grams)), PROFILE, np.int64)
    for r in rows:
        ranks[r["k"], np.searchsorted(grams, r["gram"])] = r["rank"]
    return Profiles(sorted(number), grams, ranks)


def identify(docs: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = profiles or learn(docs)

    @tokens.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tokens.text_buffers(batch.column("text"))
            names, scores = [], [np.zeros(0)]
            for lo, hi in tokens.row_chunks(offsets, CHUNK):
                found, score = model.predict(data, offsets[lo : hi + 1])
                names += found
                scores.append(score)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": np.concatenate(scores)})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double").select(
        "doc_id", F.coalesce(doc_bucket(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
