"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is its shingles of five words (fewer words: one shingle of all), weighted by
1 + ln(count). ProbMinHash gives each register the shingle whose Poisson process, at the rate of
its weight, first reaches it; a shingle stops arriving once it is later than all registers. Two
documents agree in a register with the probability of their probability Jaccard similarity. A text
that repeats a shingle also has the registers of equal weights (those that it would have without
repeats), which agree with the probability of plain Jaccard, so that copies that differ in how often
a line repeats still meet.

Texts with equal words are one node from the start, so that groups of copies cost one row. Nodes
that share a band are candidates; a candidate pair is a link where its exact probability Jaccard,
or its plain Jaccard over distinct shingles, is 0.8 or more. Of a bucket, at first only the pairs
with its least node are verified. In buckets whose nodes are still in several classes, exact bounds
then set aside nodes whose shingles are too often theirs alone for any link, and the others are
compared with the node that has least of its own (in a group of edited copies, the one nearest to the
original) and, once more, with one that a hash draws. What is then left in several classes is settled
by an exact similarity join between classes (never within one): linked nodes must share one of their
rarest shingles, and from there on have enough left that they can share. So no link between
candidates that would join two classes is lost, however large a bucket is.

Shingles are 44-bit hashes, of which the exact check sees the upper 31; chance equalities move a
similarity by less than a thousandth.

Defined results: null is an empty text; texts without a word are copies of equal texts only;
repeated rows are copies; a class is named by its least id (null if none has an id); further columns
are ignored (``classes``) or kept (``distinct_documents``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from brightloom.llm import tokens
from brightloom.llm.common import discard, materialise, packed, unpacked
from brightloom.llm.graphs import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
CHUNK = 1 << 20
ROUNDS = 3
_GRAM_BITS = 44
_KEYS = [T.StructField("ta", T.LongType()), T.StructField("tb", T.LongType())]
_MIX = tokens.mixed(np.arange(1, 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tokens.Words]:
    """(row, gram, count) of the distinct shingles of the rows, by row and gram, and the words."""
    found = tokens.words(data, offsets)
    n, size = len(found.hash), np.diff(found.rows)
    rows = np.repeat(np.arange(len(size)), size)
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total[: max(0, n - k)] += found.hash[k:] * _MIX[k] if k < n else np.uint64(0)
    last = np.repeat(found.rows[1:], size)
    whole = np.arange(n) + SHINGLE <= last
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    for row in short:  # a shingle of all words
        a, b = found.rows[row], found.rows[row + 1]
        total[a] = (found.hash[a:b] * _MIX[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
        whole[a] = True
    gram = tokens.mixed(total[whole]) >> np.uint64(64 - _GRAM_BITS)
    key = np.sort((rows[whole].astype(np.uint64) << np.uint64(_GRAM_BITS)) | gram)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate((first, [len(key)])))
    key = key[first]
    return (key >> np.uint64(_GRAM_BITS)).astype(np.int64), key & np.uint64((1 << _GRAM_BITS) - 1), count, found


def text_keys(data: np.ndarray, offsets: np.ndarray, found: tokens.Words) -> tuple[np.ndarray, np.ndarray]:
    """Two longs that are equal for texts with equal words in order (or, without words, equal texts)."""
    power, inverse = tokens._power(len(found.hash) + 1)
    keys = []
    for salt in (0, 1):
        part = tokens.mixed(found.hash + np.uint64(salt)) if salt else found.hash
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * power[: len(part)], dtype=np.uint64)))
        keys.append(tokens.mixed((total[found.rows[1:]] - total[found.rows[:-1]]) * inverse[found.rows[:-1]] + np.diff(found.rows).astype(np.uint64)).view(np.int64).copy())
    for row in np.flatnonzero(np.diff(found.rows) == 0):
        digest = hashlib.blake2b(data[offsets[row] : offsets[row + 1]].tobytes(), digest_size=16).digest()
        keys[0][row], keys[1][row] = np.frombuffer(digest, np.int64)
    return keys[0], keys[1]


def weights(count: np.ndarray) -> np.ndarray:
    """The weight of a shingle that occurs so often."""
    return 1 + np.log(count)


def signatures(row: np.ndarray, gram: np.ndarray, weight: np.ndarray, n_rows: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers of each row; 0 in all where a row has no shingle. All shingles take
    their j-th arrival together; those later than every register of their row are done."""
    best = np.full(n_rows * registers, np.inf)
    signature = np.zeros(n_rows * registers, np.uint64)
    time = np.zeros(len(row))
    step = 0
    while len(row):
        drawn = tokens.mixed(gram * np.uint64(0x9E3779B97F4A7C15) + np.uint64((step * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % (1 << 64)))
        time = time - np.log(((drawn >> np.uint64(32)).astype(np.float64) + 0.5) / 4294967296.0) / weight
        register = ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        at = row * registers + register
        np.minimum.at(best, at, time)
        won = best[at] == time
        signature[at[won]] = gram[won] + np.uint64(1)
        late = best.reshape(n_rows, registers).max(axis=1)
        on = time < late[row]
        row, gram, weight, time = row[on], gram[on], weight[on], time[on]
        step += 1
    return signature.reshape(n_rows, registers)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A long for each band of each row."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    total = np.zeros(parts.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[60]
    for k in range(ROWS):
        total = tokens.mixed(total + parts[:, :, k] * _MIX[k])
    return total.view(np.int64)


def row_bands(row: np.ndarray, gram: np.ndarray, count: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, band key) of the rows with shingles, by row: the bands of the weighted shingles and, where
    a shingle is repeated, also those of the shingles with equal weights, as far as they differ."""
    keys = band_keys(signatures(row, gram, weights(count), n_rows))
    some = np.flatnonzero(np.bincount(row, minlength=n_rows))
    many = np.bincount(row[count > 1], minlength=n_rows) > 0
    of, again = many[row], np.flatnonzero(many)
    equal = band_keys(signatures((np.cumsum(many) - 1)[row[of]], gram[of], np.ones(of.sum()), len(again)))
    fresh = equal != keys[again]
    owner = np.concatenate((np.repeat(some, BANDS), np.repeat(again, fresh.sum(axis=1))))
    order = np.argsort(owner, kind="stable")
    return owner[order], np.concatenate((keys[some].ravel(), equal[fresh]))[order]


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The greater of the plain and the probability Jaccard of two sorted gram lists with weights."""
    if not len(a) or not len(b):
        return 0.0
    grams = np.concatenate((a, b))
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    pair = np.flatnonzero(grams[1:] == grams[:-1])
    plain = len(pair) / (len(grams) - len(pair))
    if plain >= SIMILARITY or not len(pair) or (np.all(wa == 1) and np.all(wb == 1)):
        return plain
    of_a, of_b = wa[order[pair]], wb[order[pair + 1] - len(a)]
    # each shared gram d: 1 / sum over all grams of max(wa / wa(d), wb / wb(d))
    both_a, both_b = np.concatenate((of_a, np.delete(wa, order[pair]), np.zeros(len(b) - len(pair)))), np.concatenate((of_b, np.zeros(len(a) - len(pair)), np.delete(wb, order[pair + 1] - len(a))))
    ratio = np.divide(both_a, both_b, out=np.full(len(both_a), np.inf), where=both_b > 0)
    by = np.argsort(ratio)
    ratio, sum_b = ratio[by], np.concatenate(([0], np.cumsum(both_b[by])))
    sum_a = np.concatenate((np.cumsum(both_a[by][::-1])[::-1], [0]))
    d = of_a / of_b
    k = np.searchsorted(ratio, d)
    return max(plain, float((of_a / (sum_a[k] + d * sum_b[k])).sum()))


@tokens.lean
def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tokens.text_buffers(batch.column("text"))
        for lo, hi in tokens.row_chunks(offsets, CHUNK):
            row, gram, count, found = shingles(data, offsets[lo : hi + 1])
            ta, tb = text_keys(data, offsets[lo : hi + 1], found)
            owner, keys = row_bands(row, gram, count, hi - lo)
            at = np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(at), pa.array(keys))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(lo, hi - lo), "ta": ta, "tb": tb, "bands": bands})


@tokens.lean
def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tokens.text_buffers(batch.column("text"))
        keys = [(np.zeros(0, np.int64),) * 2]
        for lo, hi in tokens.row_chunks(offsets, CHUNK):
            keys.append(text_keys(data, offsets[lo : hi + 1], tokens.words(data, offsets[lo : hi + 1])))
        ta, tb = (np.concatenate([k[i] for k in keys]) for i in (0, 1))
        yield pa.RecordBatch.from_pydict({name: batch.column(name) for name in batch.schema.names} | {"ta": ta, "tb": tb})


@tokens.lean
def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tokens.text_buffers(batch.column("text"))
        node, wanted = batch.column("node"), [batch.column(c).to_numpy() for c in ("ta", "tb")]
        for lo, hi in tokens.row_chunks(offsets, CHUNK):
            row, gram, count, found = shingles(data, offsets[lo : hi + 1])
            ta, tb = text_keys(data, offsets[lo : hi + 1], found)
            short = (gram >> np.uint64(_GRAM_BITS - 31)).astype(np.int32)
            new = np.append(True, (row[1:] != row[:-1]) | (short[1:] != short[:-1]))[: len(row)]
            count = np.add.reduceat(count, np.flatnonzero(new)) if len(count) else count  # of shingles with equal upper bits together
            row, short = row[new], short[new]
            at = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
            many = np.maximum.reduceat(np.append(count, 1), np.minimum(at[:-1], len(count))) > 1  # texts with a repeated shingle
            many &= np.diff(at) > 0
            weighted = many[row]
            w_at = np.concatenate(([0], np.cumsum(np.where(many, np.diff(at), 0)))).astype(np.int32)
            mine = pa.array((ta == wanted[0][lo:hi]) & (tb == wanted[1][lo:hi]))
            out = pa.RecordBatch.from_pydict(
                {
                    "node": node.slice(lo, hi - lo),
                    "grams": pa.ListArray.from_arrays(pa.array(at), pa.array(short)),
                    "w": pa.ListArray.from_arrays(pa.array(w_at), pa.array(weights(count[weighted]).astype(np.float32))),
                }
            )
            yield out.filter(mine)


@tokens.lean
def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [(batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy()) for c in ("ga", "wa", "gb", "wb")]
        good = np.zeros(batch.num_rows, bool)
        for k in range(batch.num_rows):
            a, wa, b, wb = (values[at[k] : at[k + 1]] for at, values in lists)
            wa, wb = (w.astype(np.float64) if len(w) else np.ones(len(g)) for g, w in ((a, wa), (b, wb)))
            good[k] = similarity(a, wa, b, wb) >= SIMILARITY
        yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "linked": good})


def _verified(pairs: DataFrame, grams: DataFrame, scratch: list[str]) -> DataFrame:
    """(a, b, linked) of each pair."""
    a = grams.select(F.col("node").alias("a"), F.col("grams").alias("ga"), F.col("w").alias("wa"))
    b = grams.select(F.col("node").alias("b"), F.col("grams").alias("gb"), F.col("w").alias("wb"))
    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "ga", "wa", "gb", "wb")
    return materialise(joined.mapInArrow(_verify_batches, "a bigint, b bigint, linked boolean"), scratch)


def _open_members(members: DataFrame, labels: DataFrame, scratch: list[str]) -> DataFrame:
    """(bucket, node, label) of the buckets whose nodes are in several classes."""
    now = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    mixed = now.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    return materialise(now.join(mixed, "bucket"), scratch)


def _weight() -> Column:
    """The weights of a node's shingles; all 1 where none is repeated."""
    return F.when(F.size("w") > 0, F.col("w")).otherwise(F.array_repeat(F.lit(1.0).cast("float"), F.size("grams")))


_ROOM = 1e-6  # float weights


def _possible(x: str, y: str) -> Column:
    """Whether what two nodes have left can make a link: of n shingles (weight ``total``) of either,
    at most ``rest`` (``heavy``) can be shared. Plain Jaccard is at most the least ``rest`` over the
    distinct shingles of both; probability Jaccard, which only differs from it where a node repeats a
    shingle, is at most the least share of ``heavy``."""
    at = lambda side, name: F.col(f"{side}.{name}")
    shared = F.least(at(x, "rest"), at(y, "rest"))
    plain = shared * (1 + SIMILARITY) >= (SIMILARITY - _ROOM) * (at(x, "n") + at(y, "n"))
    share = lambda side: at(side, "heavy") >= (SIMILARITY - _ROOM) * at(side, "total")
    return plain | ((at(x, "repeats") | at(y, "repeats")) & share(x) & share(y))


def _profiles(nodes: DataFrame, grams: DataFrame, scratch: list[str]) -> tuple[DataFrame, DataFrame]:
    """(node, p) and (node, g, x, c): each node's figures for ``_possible``, where shingles that no
    other of ``nodes`` has are not shared; and its other shingles, with weight and number of nodes.
    Nodes that have too few of those for any link are left out of both."""
    mine = grams.join(nodes.select("node").distinct(), "node", "left_semi")
    sized = mine.select("node", F.size("grams").alias("n"), (F.size("w") > 0).alias("repeats"), F.aggregate(_weight(), F.lit(0.0), lambda a, x: a + x).alias("total"))
    each = mine.select("node", F.explode(F.arrays_zip(F.col("grams").alias("g"), _weight().alias("x"))).alias("e")).select("node", "e.g", "e.x")
    common = each.groupBy("g").agg(F.count("*").alias("c")).where("c > 1")
    met = materialise(each.join(common, "g"), scratch)
    left = met.groupBy("node").agg(F.count("*").alias("rest"), F.sum("x").alias("heavy"))
    able = sized.join(left, "node").where(f"rest >= {SIMILARITY - _ROOM} * n or heavy >= {SIMILARITY - _ROOM} * total")
    profiles = materialise(able.select("node", F.struct("n", "repeats", "total", "rest", "heavy").alias("p")), scratch)
    return profiles, met.join(profiles.select("node"), "node", "left_semi")


def _prefixes(nodes: DataFrame, profiles: DataFrame, met: DataFrame) -> DataFrame:
    """(node, label, g, p): each node's rarest shingles among ``nodes``, up to a fifth of its shingles
    or of their weight, and one more. Linked nodes share at least four fifths of either, so the rarest
    shingle that they share is in both their prefixes. ``p`` has what can be shared from there on."""
    order = Window.partitionBy("node").orderBy("c", "g").rowsBetween(0, Window.unboundedFollowing)
    each = met.withColumn("rest", F.count("*").over(order)).withColumn("heavy", F.sum("x").over(order)).join(profiles, "node")
    near = each.where(f"rest >= {SIMILARITY - _ROOM} * p.n or heavy >= {SIMILARITY - _ROOM} * p.total")
    return near.select("node", "g", F.struct("p.n", "p.repeats", "p.total", "rest", "heavy").alias("p")).join(nodes.select("node", "label").distinct(), "node")


def link_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): rows is (doc_id, ta, tb) of every row of ``docs``; nodes is (ta, tb, node,
    first_id, label), one for each distinct text, where equal labels are one class."""
    scratch: list[str] = []
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = materialise(plain.mapInArrow(_hash_batches, "doc_id bigint, ta bigint, tb bigint, bands array<bigint>"))
    nodes = materialise(
        hashed.groupBy("ta", "tb").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()),
        scratch,
    )
    exploded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1").select("bucket", "least")
    members = materialise(exploded.join(shared, "bucket").select("bucket", "node", "least"), scratch)
    named = nodes.select("ta", "tb", "node", "first_id")
    wanted = members.select("node").distinct().join(named, "node")
    texts = plain.join(wanted.withColumnRenamed("first_id", "doc_id").where("doc_id is not null"), "doc_id")
    orphans = wanted.where("first_id is null")
    if not orphans.isEmpty():  # texts that only rows without an id have
        keyed = plain.where("doc_id is null").mapInArrow(_key_batches, T.StructType(plain.schema.fields + _KEYS))
        texts = texts.unionByName(keyed.select("doc_id", "text", F.col("ta").alias("a"), F.col("tb").alias("b")).join(orphans, (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb"))).select("doc_id", "text", "node", "ta", "tb"))
    grams = materialise(texts.select("node", "ta", "tb", "text").mapInArrow(_gram_batches, "node bigint, grams array<int>, w array<float>").dropDuplicates(["node"]), scratch)

    tested = _verified(members.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), grams, scratch)
    labels = components(tested.where("linked"), scratch)
    profiles = met = None
    for step in range(ROUNDS):
        left = _open_members(members.select("bucket", "node"), labels, scratch)
        if left.isEmpty():
            break
        if profiles is None:
            profiles, met = _profiles(left, grams, scratch)
            members = materialise(left.select("bucket", "node").join(profiles.select("node"), "node"), scratch)
            left = _open_members(members, labels, scratch)
        if step < ROUNDS - 1:
            known = left.join(profiles, "node")
            clean = F.col("p.rest") / F.col("p.n") if step == 0 else F.lit(0.0)  # first with the node that has least of its own
            pivot = known.groupBy("bucket").agg(F.min(F.struct((-clean).alias("own"), F.xxhash64("node", F.lit(step)).alias("h"), "node", "label", "p")).alias("y"))
            pairs = known.alias("x").join(pivot, "bucket").where("x.label <> y.label").where(_possible("x.p", "y.p")).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        else:
            named_left = left.select("node", "label").distinct()
            main = named_left.groupBy("label").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "label"))["label"].alias("main"))
            prefixes = materialise(_prefixes(named_left, profiles, met), scratch)
            minor = prefixes.join(F.broadcast(main), F.col("label") != F.col("main"))
            on = (F.col("x.g") == F.col("y.g")) & (F.col("x.label") != F.col("y.label")) & _possible("x.p", "y.p")
            pairs = minor.alias("x").join(prefixes.alias("y"), on).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        fresh = pairs.distinct().join(tested, ["a", "b"], "left_anti")
        done = _verified(fresh, grams, scratch)
        links = done.where("linked").select("a", "b").union(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a <> b"))
        tested = tested.unionByName(done)
        labels = components(links, scratch)
    classed = materialise(named.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    discard(docs.sparkSession, scratch)  # only ``hashed`` and ``classed`` are read again
    return hashed.select("doc_id", "ta", "tb"), classed


def classes(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id (the least id of its near-duplicates) and
    copy_of (the least id with equal words)."""
    rows, nodes = link_classes(docs)
    names = nodes.where("label <> node").select("label").distinct().join(nodes, "label").groupBy("label").agg(F.min("first_id").alias("class_id"))
    named = nodes.join(names, "label", "left").select("ta", "tb", F.coalesce("class_id", "first_id").alias("class_id"), F.col("first_id").alias("copy_of"))
    return rows.join(named, ["ta", "tb"]).select("doc_id", "class_id", "copy_of")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates: that of the least id."""
    rows, nodes = link_classes(docs)
    order = F.struct(F.col("first_id").isNull(), F.col("first_id"), F.col("ta"), F.col("tb"))
    kept = nodes.groupBy("label").agg(F.min(order).alias("k")).select("k.first_id", "k.ta", "k.tb")
    apart = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), packed(docs, "text").alias("row"))
    keyed = apart.mapInArrow(_key_batches, T.StructType(apart.schema.fields + _KEYS))
    same = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("x.ta") == F.col("y.ta")) & (F.col("x.tb") == F.col("y.tb"))
    found = keyed.alias("x").join(kept.alias("y"), same, "left_semi").dropDuplicates(["id", "ta", "tb"])
    return found.select(*unpacked(docs, "row", text=F.col("text").cast(docs.schema["text"].dataType)))
