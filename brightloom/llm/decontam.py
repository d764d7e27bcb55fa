"""Benchmark decontamination by an FM-index of each training shard.

A shard is a run of rows of one partition of about ``SHARD`` bytes. Its words become symbols: one
for each word of the benchmark, one for all others (runs of those count once, as no window has
any), and a zero after each document. Backward search finds which windows occur, sampled suffix
positions locate them, and the words of all occurrences merge into spans. No shuffle: each row is
judged where it is read. The benchmark is read in blocks of ``BLOCK`` characters; each ``BLOCKS`` of
them are searched in one pass over the documents, so memory does not grow with it.

Defined results: null and empty texts have no words and are clean; null or wordless items have no
windows; repeated rows are judged each; equal windows of several items count for each item; further
columns are ignored (``report``) or kept, whatever their names (``clean_documents``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.llm import tokens
from brightloom.llm.common import discard, materialise, packed, unpacked
from brightloom.llm.fmindex import FMIndex

WINDOW = 13
SHARD = 2 << 20
#: Characters of benchmark text in a block that is sent to all executors, and blocks there at once.
BLOCK, BLOCKS = 4 << 20, 4


class Windows:
    """The distinct windows of a block of items, as rows of symbols."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        data, offsets = tokens.text_buffers(pa.array([text for _, text in items], pa.string()))
        found = tokens.words(data, offsets)
        self.vocabulary, symbol = np.unique(found.hash, return_inverse=True)
        symbol = symbol.astype(np.int64) + 2  # 0 ends a document, 1 is any other word
        self.bits = max(2, int(len(self.vocabulary) + 1).bit_length())
        sizes = np.diff(found.rows)
        starts, lengths, owner = [], [], []
        for k, size in enumerate(sizes):
            m = max(0, size - window + 1) or min(1, size)
            starts.append(found.rows[k] + np.arange(m))
            lengths.append(np.full(m, min(size, window)))
            owner.append(np.full(m, k))
        start, length, owner = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (starts, lengths, owner))
        rows = np.zeros((len(start), window), np.int64)
        for j in range(window):  # right-aligned: column window - 1 - j holds the j-th word from the end
            there = length > j
            rows[there, window - 1 - j] = symbol[start[there] + length[there] - 1 - j]
        self.rows, at = np.unique(rows, axis=0, return_inverse=True)
        self.lengths = (self.rows > 0).sum(axis=1)
        pairs = np.unique(np.stack((at.ravel(), owner)), axis=1) if len(start) else np.zeros((2, 0), np.int64)
        self.items, self.item_of = [item for item, _ in items], pairs[1]
        self.item_at = np.searchsorted(pairs[0], np.arange(len(self.rows) + 1))


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and value, of each integer of the ranges [low, high)."""
    size = high - low
    which = np.repeat(np.arange(len(low)), size)
    return which, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[which]


def scan_shard(data: np.ndarray, offsets: np.ndarray, windows: Windows) -> tuple[np.ndarray, list, list, tokens.Words]:
    """Words of each row, and by row its merged spans of hit words and the items that occur in it."""
    n = len(offsets) - 1
    found = tokens.words(data, offsets)
    count = np.diff(found.rows)
    spans: list = [None] * n
    items: list = [None] * n
    if not len(found.hash) or not len(windows.rows):
        return count, spans, items, found
    at = np.minimum(np.searchsorted(windows.vocabulary, found.hash), len(windows.vocabulary) - 1)
    known = windows.vocabulary[at] == found.hash
    symbol = np.where(known, at + 2, 1)
    keep = known.copy()
    keep[1:] |= known[:-1]  # of a run of other words its first stays
    begins = found.rows[:-1][count > 0]
    keep[begins] = True
    kept = np.flatnonzero(keep)
    row = np.searchsorted(found.rows, kept, "right") - 1
    position = np.arange(len(kept)) + row
    text = np.zeros(len(kept) + n, np.int64)
    text[position] = symbol[kept]
    word_at = np.full(len(text), -1, np.int64)
    word_at[position] = kept
    index = FMIndex(text, windows.bits)
    which, low, high = index.search(windows.rows, windows.lengths)
    if not len(which):
        return count, spans, items, found
    owner, rows = _expand(low, high)
    first = word_at[index.locate(rows)]
    window = which[owner]
    hit = np.zeros(len(found.hash) + 1, np.int64)
    np.add.at(hit, first, 1)
    np.add.at(hit, first + windows.lengths[window], -1)
    is_hit = np.cumsum(hit[:-1]) > 0
    doc = np.searchsorted(found.rows, first, "right") - 1
    pair, value = _expand(windows.item_at[window], windows.item_at[window + 1])
    for k, item in np.unique(np.stack((doc[pair], windows.item_of[value])), axis=1).T:
        items[k] = (items[k] or []) + [windows.items[item]]
    for k in np.unique(doc):
        lo, hi = found.rows[k], found.rows[k + 1]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], is_hit[lo:hi], [False])).astype(np.int8)))
        spans[k] = edge.tolist()
    return count, spans, items, found


def _merge(a: list | None, b: list | None) -> list | None:
    """Union of two lists of spans [start, end, start, end, ...]."""
    if not a or not b:
        return a or b
    out: list[int] = []
    for low, high in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and low <= out[-1]:
            out[-1] = max(out[-1], high)
        else:
            out += [low, high]
    return out


def _char_spans(data: np.ndarray, found: tokens.Words, base: int, byte_from: int, row: int, spans: list[int]) -> list[int]:
    """The spans of words of a row as code points of its text."""
    w = found.rows[row] + np.array(spans).reshape(-1, 2)
    edges = np.stack((found.start[w[:, 0]], found.end[w[:, 1] - 1]), axis=1).ravel() + base - byte_from
    lead = np.concatenate(([0], np.cumsum((data[byte_from : byte_from + edges[-1]] & 0xC0) != 0x80)))
    return lead[edges].tolist()


def _pass(windows, keep_text: bool):
    """A function over Arrow batches that adds what one block of windows finds."""

    @tokens.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = windows.value
        for batch in batches:
            data, offsets = tokens.text_buffers(batch.column("text"))
            n_words, spans, items, chars = [np.zeros(0, np.int64)], [], [], []
            before = {name: batch.column(name).to_pylist() for name in ("spans", "items")} if "spans" in batch.schema.names else {}
            old_spans, old_items = (before.get(name, [None] * batch.num_rows) for name in ("spans", "items"))
            for lo, hi in tokens.row_chunks(offsets, SHARD):
                count, found_spans, found_items, found = scan_shard(data, offsets[lo : hi + 1], block)
                n_words.append(count)
                items += found_items
                for k, new in enumerate(found_spans):
                    merged = _merge(old_spans[lo + k], new)
                    spans.append(merged)
                    chars.append(_char_spans(data, found, int(offsets[lo]), int(offsets[lo + k]), k, merged) if merged else None)
            named = {"row": batch.column("row")} | ({"text": batch.column("text")} if keep_text else {})
            yield pa.RecordBatch.from_pydict(
                named
                | {
                    "n_words": pa.array(np.concatenate(n_words), pa.int64()),
                    "spans": pa.array(spans, pa.list_(pa.int64())),
                    "items": pa.array([[*(a or []), *(b or [])] for a, b in zip(old_items, items)], pa.list_(pa.string())),
                    "chars": pa.array(chars, pa.list_(pa.int64())),
                }
            )

    return run


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """For each row of ``docs``: row (its other columns), text (if kept), n_words, spans (merged spans of
    hit words: start, end, ...), chars (the same as code points of the text) and items (ids whose
    windows occur)."""
    spark = docs.sparkSession
    listed = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    size = listed.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = 1 + size // BLOCK
    out = docs.select(packed(docs, "text").alias("row"), F.col("text").cast("string").alias("text"))
    found = "n_words bigint, spans array<bigint>, items array<string>, chars array<bigint>"
    sent: list = []
    before: list[str] = []
    now: list[str] = []
    for b in range(blocks):
        part = listed if blocks == 1 else listed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        last = b == blocks - 1
        sent.append(spark.sparkContext.broadcast(Windows([(r["item_id"], r["text"]) for r in part.collect()], window)))
        fields = [f for f in out.schema.fields if f.name == "row" or f.name == "text" and (keep_text or not last)]
        out = out.mapInArrow(_pass(sent[-1], keep_text or not last), T.StructType([*fields, *T.StructType.fromDDL(found).fields]))
        if len(sent) == BLOCKS and not last:  # ends the stage, and with it the need for its blocks
            out = materialise(out, now)
            discard(spark, before)
            before, now = now, []
            for block in sent:
                block.unpersist()
            sent = []
    return out


def _hit():
    pairs = F.sequence(F.lit(0), F.floor(F.size("spans") / 2).cast("int") - 1)
    each = F.transform(pairs, lambda i: F.get("spans", i * 2 + 1) - F.get("spans", i * 2))
    return F.when(F.size("spans") > 0, F.aggregate(each, F.lit(0).cast("bigint"), lambda a, x: a + x)).otherwise(F.lit(0).cast("bigint"))


def is_contaminated(n_hit, n_words):
    """The rule: at least one twentieth of the words is hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Figures of every document (doc_id, text): one row per input row."""
    found = judge(docs.select("doc_id", "text"), benchmark, keep_text=False)
    ids = F.array_sort(F.array_distinct(F.coalesce("items", F.array().cast("array<string>"))))
    return found.select("row.doc_id", "n_words", _hit().alias("n_hit"), ids.alias("ids"), "chars").select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
        F.coalesce(F.array_join(F.col("chars").cast("array<string>"), ","), F.lit("")).alias("removal_spans"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones; the others as they are."""
    clean = judge(docs, benchmark).where(~is_contaminated(_hit(), F.col("n_words")))
    return clean.select(*unpacked(docs, "row", text=F.col("text").cast(docs.schema["text"].dataType)))
