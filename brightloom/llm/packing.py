"""Packing along a space-filling curve.

A document's token ids are hashed into ``WIDTH`` buckets; the square roots of their counts, at unit
length, are projected to three dimensions by a fixed random matrix. Standardised over all documents
and brought to ``LEVELS`` levels by the normal distribution, the three give the document's place on a
Hilbert curve. Documents are sorted by it in ranges and laid end to end, and the line is cut into
sequences of ``SEQUENCE`` tokens, so a sequence holds documents that are near each other on the curve.
What is left at the end is cut at powers of two, which need no padding: there is none at all.

Tokens are made once and written as a table. About a megabyte of texts at a time is parted into units:
runs of letters, single digits, runs of other signs, each of which the vocabulary turns into ids by
itself. Equal units are brought together by sorting, so each is looked up once, and its ids are laid
out wherever it stands. Words with other characters are units as a whole. Ranges come from percentiles of (curve, hash of the row), so a group of equal
documents, which all lie in one place of the curve, is dealt over as many ranges as it fills. Places go
in two steps: sums of ranges, then a window within each.

Defined results: a null text is empty; every document ends with the token ``END``, so an empty one has
that token alone; strings of the vocabulary's special tokens in a text are those tokens; rows without
an id and repeated rows count each; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import codecs
import itertools
import json
import math
import os
import re
import string
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brightloom.llm.common import materialise
from brightloom.llm.tokens import lean, row_chunks, text_buffers

# Tokens of a sequence, the token that ends a document.
SEQUENCE, END = 4096, 2
WIDTH, DIMS, BITS = 256, 3, 10
LEVELS = 1 << BITS
RANGE_TOKENS, RANGES = 1 << 18, 20000  # tokens of a range, or more so that there are not more ranges
PART = 1 << 20  # bytes of texts that are turned into ids together
CACHE = 200_000  # words of each generation that a worker remembers
SLOTS, POOL = 21, 1 << 23  # bits of the number of units that a worker remembers besides, and about the most ids of them
_TOKENS = "doc_id long, uid long, n long, ids binary, v array<double>"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("v", pa.list_(pa.float64()))])
_PLAIN = regex.compile(r"[!-~¡-¬®-įĲ-ſ]*")  # composed letters with one lower case each
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER, _WHOLE = range(6)  # classes of bytes; _WHOLE is given to words with an _OTHER
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def _classes() -> bytes:
    """The class of each byte. Letters are those of ASCII and of U+00C0 to U+00FF, whose first byte is C3."""
    of = np.full(256, _OTHER, np.uint8)
    of[0x21:0x7F], of[0x80:0xC0], of[0xC3], of[ord("'")] = _SIGN, _LETTER, _LETTER, _OTHER
    for group, kind in ((b" \t\n\r\x0b\x0c", _SPACE), (string.ascii_letters.encode(), _LETTER), (string.digits.encode(), _DIGIT)):
        of[list(group)] = kind
    return of.tobytes()


_CLASS = _classes()
_BLANK, _BREAK = re.compile(rb"[ \t\n\r\x0b\x0c]"), re.compile(rb"[ \t\n\r\x0b\x0c]|(?<=[0-9])(?=[0-9A-Za-z])")
_LOWER = bytes(range(256)).lower()
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # keeps the first k of eight bytes


class Words(dict):
    """Token ids (little-endian, four bytes each) by the UTF-8 bytes of a word without ASCII white space.

    The vocabulary's model is asked once for each lower-case piece of a word. Words with letters outside
    ``_PLAIN`` or special tokens go through the whole tokenizer. Words are remembered in two generations:
    when ``limit`` are in the younger, it becomes the older, from which words that come again are taken.
    The short units of ``texts`` are remembered in arrays, which are read for many units at a time."""

    def __init__(self, path: str, limit: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        rules = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in rules["added_tokens"]]
        self.mark = self.special[0][:1] if len({s[:1] for s in self.special}) == 1 else ""  # in each of them
        split = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        steps = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [])]
        known = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        # another vocabulary with other rules still gives its own ids, only without pieces
        self.by_piece = split.get("pattern") == {"Regex": known} and steps == ["NFC", "Replace", "Lowercase"] and not rules["post_processor"]
        self.apart = [s.encode() for s in (*self.special, "×", "÷")]  # not the signs and letters that their bytes are classed as
        self.breaks = _BLANK if any(c.isdigit() for s in self.special for c in s) else _BREAK
        self.older: dict[bytes, bytes] = {}
        # units of 16 bytes at most, each in the slot of its hash: its bytes, and where its ids are in the pool and how many
        self.heads, self.tails = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.uint64)
        self.places, self.counts = np.zeros(1 << SLOTS, np.uint32), np.zeros(1 << SLOTS, np.uint8)
        self.pool = bytearray(_END)
        self.model = self.tokenizer.model
        # how the model writes the letters beyond ASCII of plain words
        self.letters = {k: "".join(part for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(k))) for k in range(0xA1, 0x180)} if self.by_piece else {}
        signs = [chr(k) for k in range(256)]  # and the bytes of units
        for k in range(0x80, 0xC0) if self.by_piece else ():
            signs[0xC3], signs[k] = "".join(part for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(bytes([0xC3, k]).decode()))
        self.signs = "".join(signs)

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        plain = self.by_piece and (text.isascii() and text.isprintable() or _PLAIN.fullmatch(text))
        if not plain or self.mark in text and any(s in text for s in self.special):
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        text = text.lower()
        if not text.isalpha() and len(pieces := _PIECE.findall(text)) != 1:
            return b"".join([self[p.encode()] for p in pieces])
        return _packed([t.id for t in self.model.tokenize(text if text.isascii() else text.translate(self.letters))])

    def _pieces(self, units: list[bytes]) -> list[list[int]]:
        """The ids of units that are one piece of plain signs each."""
        if not units:
            return []
        lower = b"\n".join(units).decode().lower().encode()  # beyond ASCII too
        return [[t.id for t in self.model.tokenize(x)] for x in codecs.charmap_decode(lower, "strict", self.signs)[0].split("\n")]

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._word(word)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def text(self, text: bytes) -> bytes:
        """The ids of a whole text and of its end."""
        return b"".join(map(self.__getitem__, text.split())) + _END

    def _units(self, raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the units of texts start and end, and whether they are words as a whole. ``at``: the n + 1 offsets of the texts."""
        kind = np.frombuffer(bytearray(raw.translate(_CLASS)), np.uint8)
        for some in self.apart:
            found = raw.find(some)
            while found >= 0:
                kind[found] = _OTHER
                found = raw.find(some, found + len(some))
        if len(other := np.flatnonzero(kind == _OTHER)):
            spaces = np.concatenate(([-1], np.flatnonzero(kind == _SPACE), [len(raw)]))
            for k in np.unique(np.searchsorted(spaces, other)).tolist():
                kind[spaces[k - 1] + 1 : spaces[k]] = _WHOLE
        new = kind == _DIGIT
        new[1:] |= kind[1:] != kind[:-1]
        new[at[:-1][at[:-1] < len(raw)]] = True
        start = np.flatnonzero(new)
        of = kind[start]
        end, there = np.append(start[1:], len(raw)), of != _SPACE
        return start[there], end[there], of[there] == _WHOLE

    def texts(self, raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What ``text`` gives for each of the texts that ``at`` delimits in ``raw``, one after another, and the number of ids of each."""
        if not self.by_piece:
            ids = [self.text(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            return np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64)
        if len(at) == 2 and len(raw) > PART:  # a long text is cut at white space and after digits, each of which is a piece
            parts, lo = [], 0
            while lo < len(raw):
                cut = self.breaks.search(raw, lo + PART)
                hi = cut.start() if cut else len(raw)
                parts.append(self._laid(raw[lo:hi], np.array([0, hi - lo]))[0][: -1 if cut else None])
                lo = hi
            return (flat := np.concatenate(parts)), np.array([len(flat)])
        return self._laid(raw, at)

    def _laid(self, raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``texts`` of a bounded part: equal short units are looked up once."""
        start, end, whole = self._units(raw, at)
        low = raw.translate(_LOWER)
        eight = np.ndarray(len(low) + 9, "<u8", low + bytes(16), strides=(1,))  # the eight bytes from each place on
        short = np.flatnonzero(~whole & (end - start <= 16))
        long = np.flatnonzero(whole | (end - start > 16))
        size = (end - start)[short]
        head = eight[start[short]] & _FIRST[np.minimum(size, 8)]
        tail = eight[start[short] + 8] & _FIRST[np.maximum(size - 8, 0)]
        key = head * np.uint64(0x9E3779B97F4A7C15) ^ tail * np.uint64(0xC2B2AE3D27D4EB4F)
        order = np.argsort(key)
        head, tail = head[order], tail[order]
        first = np.ones(len(order), bool)  # units that agree in the key but not in their bytes only make more groups
        first[1:] = (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])
        which = np.empty(len(start), np.int64)
        which[short[order]] = np.cumsum(first) - 1
        one = order[first]
        place, count = self._remembered(low, start[short[one]], end[short[one]], head[first], tail[first], key[one] >> np.uint64(64 - SLOTS))
        kept = len(self.pool)
        ids = [self[raw[a:b]] for a, b in zip(start[long].tolist(), end[long].tolist())]
        which[long] = np.arange(len(place), len(place) + len(long))
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        place, count = np.concatenate((place, kept // 4 + np.cumsum(length) - length, [0])), np.concatenate((count, length, [1]))
        upto = np.searchsorted(start, at)  # units before each text
        which = np.insert(which, upto[1:], len(place) - 1)
        place, count = place[which], count[which]
        ahead = np.concatenate(([0], np.cumsum(count)))
        self.pool += b"".join(ids)
        flat = np.frombuffer(self.pool, "<u4")[np.repeat(place - ahead[:-1], count) + np.arange(ahead[-1])]
        del self.pool[kept:]
        return flat, np.diff(ahead[upto + np.arange(len(at))])

    def _remembered(self, low: bytes, start: np.ndarray, end: np.ndarray, head: np.ndarray, tail: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool the ids of units of ``low`` are, in ascending order of ``slot``, and how many. Units that are not in their
        slot are made, and take it from another."""
        if len(self.pool) > 4 * POOL:
            self.pool = bytearray(_END)
            self.heads[:] = 0
        new = np.flatnonzero((self.heads[slot] != head) | (self.tails[slot] != tail))
        ids = self._pieces([low[a:b] for a, b in zip(start[new].tolist(), end[new].tolist())])
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        place, count = self.places[slot].astype(np.int64), self.counts[slot].astype(np.int64)
        place[new], count[new] = len(self.pool) // 4 + np.cumsum(length) - length, length
        self.pool += np.fromiter(itertools.chain.from_iterable(ids), "<u4", int(length.sum())).tobytes()
        new = new[np.append(slot[new][1:] != slot[new][:-1], True)] if len(new) else new  # one for each slot
        for of, x in ((self.heads, head), (self.tails, tail), (self.places, place), (self.counts, count)):
            of[slot[new]] = x[new]
        return place, count


_PACKS = [struct.Struct(f"<{n}I").pack for n in range(32)]


def _packed(ids: list[int]) -> bytes:
    return (_PACKS[len(ids)] if len(ids) < 32 else struct.Struct(f"<{len(ids)}I").pack)(*ids)


_END = _packed([END])
_workers: dict[str, Words] = {}


def _array(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow array over the memory of ``x``. Unlike ``pa.array`` it does not load pandas, which would take 45 MB
    of every Python worker."""
    return pa.Array.from_buffers(kind, len(x), [None, pa.py_buffer(np.ascontiguousarray(x))])


def _matrix() -> np.ndarray:
    return np.random.default_rng(20250131).standard_normal((WIDTH, DIMS))


def vectors(ids: list[np.ndarray]) -> np.ndarray:
    """The projected hashed vectors of token lists, one row each."""
    out, projection = np.empty((len(ids), DIMS)), _matrix()
    for low in range(0, len(ids), 512):
        some = ids[low : low + 512]
        bucket = (np.concatenate(some).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - WIDTH.bit_length() + 1)
        row = np.repeat(np.arange(len(some)), [len(x) for x in some])
        counts = np.bincount(row * WIDTH + bucket.astype(np.int64), minlength=len(some) * WIDTH).reshape(-1, WIDTH)
        x = np.sqrt(counts)
        out[low : low + 512] = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ projection
    return out


def _tokenised(path: str) -> Callable:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _workers.get(path) or _workers.setdefault(path, Words(path))
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for lo, hi in row_chunks(offsets, PART):
                flat, n = words.texts(data[offsets[lo] : offsets[hi]].tobytes(), offsets[lo : hi + 1] - offsets[lo])
                ends = np.concatenate(([0], 4 * np.cumsum(n))).astype(np.int32)
                v = vectors(np.split(flat, ends[1:-1] // 4))
                values = pa.ListArray.from_arrays(_array(np.arange(0, v.size + 1, DIMS, dtype=np.int32), pa.int32()), _array(v.ravel(), pa.float64()))
                packed = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), _array(n, pa.int64()), packed, values], schema=_SCHEMA)

    return run


def hilbert(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of points with ``bits`` bits in each column: Gray code of the bits
    taken in turn from all dimensions, after the reflections and exchanges of the cells above."""
    x = [axes[:, k].astype(np.int64) for k in range(axes.shape[1])]
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for k in range(dims):
            inverted = (x[k] >> level) & 1 == 1
            swap = np.where(inverted, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(inverted, x[0] ^ low, x[0] ^ swap)
            if k:
                x[k] = x[k] ^ swap
    place = np.zeros(len(axes), np.int64)
    gray = 0
    for level in range(bits - 1, -1, -1):
        for k in range(dims):
            gray = gray ^ ((x[k] >> level) & 1)
            place = (place << 1) | gray
    return place


def _curve(mean: list[float], scale: list[float]) -> Callable:
    @F.arrow_udf("long")
    def place(v: pa.Array) -> pa.Array:
        flat = v.flatten()
        z = np.frombuffer(flat.buffers()[1], np.float64)[flat.offset : flat.offset + len(flat)].reshape(-1, DIMS) if len(flat) else np.empty((0, DIMS))
        z = (z - np.array(mean)) / np.array(scale)
        levels = np.clip(np.floor(LEVELS / (1 + np.exp(-1.702 * z))), 0, LEVELS - 1)  # nearly the normal distribution
        return _array(hilbert(levels), pa.int64())

    return place


def range_of(cuts: list[int], x: Column) -> Column:
    """How many of the sorted ``cuts`` are below ``x``: a binary search in one expression."""
    if not cuts:
        return F.lit(0)
    at = F.from_json(F.lit(json.dumps(cuts)), "array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda a, s: F.when(F.get(at, a + s - 1) < x, a + s).otherwise(a))


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, uid, n, ids, v) of every document, written to the scratch folder: its tokens with the
    end, four bytes each, and its projected vector; ``uid`` tells rows apart."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return materialise(plain.mapInArrow(_tokenised(tokenizer), _TOKENS), codec="zstd")


def placed(tokens: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, n, ids, at) with the place ``at`` of each document's first token on the line of all, and
    the length of the line."""
    moments = [f(F.get("v", F.lit(k))) for k in range(DIMS) for f in (F.avg, F.stddev_pop)]
    total, *figures = tokens.agg(F.sum("n"), *moments).first()
    if not total:
        return tokens.select("doc_id", "n", "ids", F.lit(0).cast("long").alias("at")), 0
    place = _curve([float(x) for x in figures[::2]], [max(float(x), 1e-9) for x in figures[1::2]])
    spread = F.shiftrightunsigned(F.xxhash64("doc_id", "uid"), 64 - 33 + DIMS * BITS - 30)
    keyed = tokens.withColumn("key", F.shiftleft(place("v"), 63 - DIMS * BITS).bitwiseOR(spread))
    parts = max(1, min(RANGES, math.ceil(total / RANGE_TOKENS)))
    cuts = keyed.agg(F.percentile_approx("key", [k / parts for k in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else []
    ranged = keyed.withColumn("range", range_of(sorted(set(cuts or [])), F.col("key")))
    sums = ranged.groupBy("range").agg(F.sum("n").alias("n"))
    ahead = sums.select(F.col("range").alias("of"), (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("ahead"))  # a row a range, RANGES at most
    order = Window.partitionBy("range").orderBy("key", "uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = ranged.select("range", "key", "uid", "doc_id", "n", "ids").withColumn("upto", F.sum("n").over(order))
    return within.join(F.broadcast(ahead), F.col("range") == F.col("of")).select("doc_id", "n", "ids", (F.col("ahead") + F.col("upto") - F.col("n")).alias("at")), int(total)


def cut(line: DataFrame, total: int, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of documents that lie on the line at ``at`` with ``n`` tokens: doc_id, start, length, ids,
    doc_tokens, sequence_id and offset."""
    whole = total // sequence
    tail, low = [], whole * sequence
    for k in reversed(range((total - low).bit_length())):  # the rest, in powers of two
        if (total - low) >> k & 1:
            tail.append((whole + len(tail), low, low + (1 << k)))
            low += 1 << k
    at, end = F.col("at"), F.col("at") + F.col("n")
    box = lambda i, a, b: F.struct(i.cast("long").alias("id"), a.cast("long").alias("low"), b.cast("long").alias("high"))
    inner_end = F.least(end, F.lit(whole * sequence))
    full = F.when(at < inner_end, F.transform(F.sequence(F.floor(at / sequence), F.floor((inner_end - 1) / sequence)), lambda i: box(i, i * sequence, (i + 1) * sequence)))
    boxes = F.coalesce(full, F.array().cast("array<struct<id:long,low:long,high:long>>"))
    if tail:
        rest = F.array(*[box(*map(F.lit, x)) for x in tail])
        boxes = F.concat(boxes, F.filter(rest, lambda x: (x["high"] > at) & (x["low"] < end)))
    pieces = line.withColumn("box", F.explode(boxes)).withColumn("start", F.greatest(F.lit(0), F.col("box.low") - at)).withColumn("length", F.least(end, F.col("box.high")) - at - F.col("start"))
    ids = F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    return pieces.select("doc_id", "start", "length", ids.alias("ids"), F.col("n").alias("doc_tokens"), F.col("box.id").alias("sequence_id"), (at + F.col("start") - F.col("box.low")).alias("offset"))


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """All tokens of ``docs`` (doc_id, text) in sequences, one row for each piece of a document: doc_id,
    start (its document's tokens before it), length, ids (four bytes each), doc_tokens, sequence_id and
    offset (there). ``tokenizer`` is the path of a vocabulary file that every executor can read."""
    return cut(*placed(tokenised(docs, tokenizer)))


def report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``pack`` with ids_crc32 instead of the ids."""
    return pack(docs, tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
