"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents stand in a shuffled order (by a hash of the id) and form a stream of words,
cut into blocks of ``block_words`` words. The schedule is a van der Corput sequence over 2**k slots:
slot i's point falls, through the cumulated block counts of the sources, on one source, and the
r-th slot of a source plays its r-th block. Since the points of a whole power of two are evenly
spread, each source gets the blocks that its target needs, and any stretch of the schedule holds the
sources near their weights. A source whose target exceeds its size starts its stream again.

Running sums and ranks go in two steps (sums of hash ranges or slot ranges, then within one), so
that no source, however large, is sorted in one task. The per-source table has one row for each
source, and is the only one that a single task orders.

Defined results: a null text has no words; a null source is a source of its own, last; documents
without words are returned with 0 taken; repeated rows count each; of equal ids the shorter text
comes first; rows without an id are placed by a hash of their text; further columns are ignored
(``mix``) or kept, whatever their names (``mixed_documents``); an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brightloom.llm.common import materialise, md5_number, packed, unpacked

# A word, the default weights by source order, the share of all words, the epochs.
WORD = r"[^\x20\x09-\x0D]++"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
BLOCK_WORDS = 4096
_SLOTS = 4096  # slots ranked in one group
_ROWS = 2000  # documents ordered in one group


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bit_reversed(i: Column, bits: int) -> Column:
    """The van der Corput point of i, as an integer below 2**bits."""
    x = i
    for width, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        m = F.lit(mask)
        x = F.shiftleft(x.bitwiseAND(m), width).bitwiseOR(F.shiftrightunsigned(x, width).bitwiseAND(m))
    x = F.shiftleft(x, 32).bitwiseOR(F.shiftrightunsigned(x, 32))
    return F.shiftrightunsigned(x, 64 - bits) if bits else F.lit(0).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Targets of each source (source, source_size): ``share`` of all words by weight, at most
    EPOCHS times the source's size; the excess goes to the others by weight.

    The level at which the reshared targets settle: sources fill up in the order of limit/weight, so
    it is the first level that the next source in that order can hold."""
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("source").isNull(), "source")
    fill = Window.orderBy("_full_at", "sidx")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    at = F.pmod(F.col("sidx"), F.lit(len(weights)))
    weight = F.get(F.array(*[F.lit(w) for w in weights]), at.cast("int")).cast("long")
    level = (F.lit(share) * F.col("_total") - F.coalesce(F.sum("_limit").over(before), F.lit(0))) / (
        F.col("_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    return (
        sizes.withColumn("sidx", (F.row_number().over(order) - 1).cast("long"))
        .withColumn("weight", weight)
        .withColumn("_limit", F.lit(EPOCHS) * F.col("source_size"))
        .withColumn("_full_at", F.col("_limit") / F.col("weight"))
        .withColumn("_total", F.sum("source_size").over(every))
        .withColumn("_weights", F.sum("weight").over(every))
        .withColumn("_level", level)
        .withColumn("_level", F.max(F.when(F.col("_full_at") >= F.col("_level"), F.col("_level"))).over(every))
        .withColumn("target", F.least(F.col("_limit").cast("double"), F.coalesce(F.col("_level") * F.col("weight"), F.col("_limit").cast("double"))))
        .select("source", "sidx", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("words"))
    )


def schedule(sources: DataFrame, block_words: int, blocks: int, n_sources: int) -> DataFrame:
    """(slot, sidx, block) of every scheduled block; ``blocks`` is the sum of the sources' blocks."""
    spark = sources.sparkSession
    bits = max(0, (blocks - 1).bit_length())
    if bits > 31:
        raise ValueError("more than 2**31 blocks: give larger block_words")
    width = max(1, blocks // (4 * max(1, n_sources)))
    ranges = (
        sources.select("sidx", F.floor((F.col("words") + (block_words - 1)) / block_words).cast("long").alias("need"))
        .where("need > 0")
        .withColumn("low", F.sum("need").over(Window.orderBy("sidx")) - F.col("need"))
        .withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("low") + F.col("need") - 1) / width))))
    )
    points = (
        spark.range(1 << bits if blocks else 0)
        .select(F.col("id").alias("slot"), F.shiftright(bit_reversed(F.col("id"), bits) * F.lit(blocks), bits).alias("at"))
        .withColumn("cell", F.floor(F.col("at") / width))
    )
    owned = (
        points.join(ranges, "cell")
        .where((F.col("at") >= F.col("low")) & (F.col("at") < F.col("low") + F.col("need")))
        .select("slot", "sidx", "need", F.floor(F.col("slot") / _SLOTS).alias("group"))
    )
    counts = owned.groupBy("sidx", "group").agg(F.count("*").alias("n"))
    counts = counts.withColumn("ahead", F.sum("n").over(Window.partitionBy("sidx").orderBy("group")) - F.col("n")).drop("n")
    return (
        owned.join(counts, ["sidx", "group"])
        .withColumn("block", F.col("ahead") + F.row_number().over(Window.partitionBy("sidx", "group").orderBy("slot")) - 1)
        .where("block < need")
        .select("slot", "sidx", "block")
    )


def block_size(words: int, sources: int) -> int:
    """Words of a block: ``BLOCK_WORDS``, doubled until the schedule has at most 2**30 blocks, so that a
    mix of any size has a schedule (at 4096 words a block, from about 4e12 words on)."""
    size = BLOCK_WORDS
    while words // size + sources > 1 << 30:
        size *= 2
    return size


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, block_words: int | None = None, seed: str = "") -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, source): doc_id, size, source, source_size,
    target (its source's), taken (its words in the mix, repeats counted) and first_slot (where the
    schedule first plays a block with its words; null if never). ``block_words`` is by default chosen
    by ``block_size``."""
    return _mixed(docs, weights, share, block_words, seed).drop("text_hash")


def _mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, block_words: int | None = None, seed: str = "") -> DataFrame:
    """``mix`` with text_hash."""
    sized = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
            F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
            md5_number(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text"), F.xxhash64(F.col("text").cast("string")).cast("string"))))).alias("h"),
        )
    )
    sources = materialise(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share))
    totals = sources.agg(F.sum("words").alias("words"), F.count("*").alias("sources")).first()
    block_words = block_words or block_size(int(totals["words"] or 0), totals["sources"])
    blocks = sources.agg(F.sum(F.floor((F.col("words") + (block_words - 1)) / block_words))).first()[0]
    groups = max(0, min(16, (sized.count() // _ROWS).bit_length()))
    slots = schedule(sources, block_words, int(blocks or 0), totals["sources"])

    grouped = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select(
        sized["doc_id"], sized["source"], "size", "text_hash", "h", "sidx", "source_size", "target", "words", F.shiftrightunsigned("h", 60 - groups).alias("group") if groups else F.lit(0).cast("long").alias("group")
    )
    ahead = grouped.groupBy("sidx", "group").agg(F.sum("size").alias("n"))
    ahead = ahead.select("sidx", "group", (F.sum("n").over(Window.partitionBy("sidx").orderBy("group")) - F.col("n")).alias("ahead"))
    order = Window.partitionBy("sidx", "group").orderBy("h", "doc_id", "size", "text_hash")
    epoch = lambda e, f: f(F.col("source_size") * e + F.col("start"))
    pieces = F.filter(
        F.array(*[epoch(e, lambda a: F.struct(a.alias("low"), F.least(a + F.col("size"), F.col("words")).alias("high"))) for e in range(EPOCHS)]),
        lambda x: x["high"] > x["low"],
    )
    placed = (
        grouped.join(ahead, ["sidx", "group"])
        .withColumn("start", F.col("ahead") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
        .withColumn("nth", F.row_number().over(order))
        .withColumn("piece", F.explode_outer(pieces))
        .withColumn("block", F.explode_outer(F.when(F.col("piece").isNotNull(), F.sequence(F.floor(F.col("piece.low") / block_words), F.floor((F.col("piece.high") - 1) / block_words)))))
        # documents that the mix does not reach meet no slot: negative blocks spread them
        .withColumn("block", F.coalesce("block", -1 - F.pmod("h", F.lit(4096))))
        .withColumn("n", F.least(F.col("piece.high"), (F.col("block") + 1) * block_words) - F.greatest(F.col("piece.low"), F.col("block") * block_words))
    )
    played = placed.join(slots, ["sidx", "block"], "left")
    return (
        played.groupBy("sidx", "group", "nth", "doc_id", "source", "size", "text_hash", "source_size", "target")
        .agg(F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("n"))), F.lit(0)).alias("taken"), F.min("slot").alias("first_slot"))
        .select("doc_id", "size", "source", "source_size", "target", "taken", "first_slot", "text_hash")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with its figures: size, source_size, target, taken and
    first_slot; a figure whose name ``docs`` has itself gets an underscore more. Documents without a
    taken word go. Rows with equal id, source and text stand for each other."""
    figures = _mixed(docs, **options).where("taken > 0")
    key = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")]
    numbered = lambda df, by: df.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "source", "text_hash").orderBy(by)))
    x = numbered(docs.select(packed(docs).alias("row"), *key), F.lit(0)).alias("x")
    y = numbered(figures, F.col("first_slot")).alias("y")
    same = lambda c: F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    taken = {c.lower() for c in docs.columns}
    named = []
    for figure in ("size", "source_size", "target", "taken", "first_slot"):
        name = figure
        while name in taken:
            name += "_"
        named.append(F.col(f"y.{figure}").alias(name))
    return x.join(y, same("doc_id") & same("source") & same("text_hash") & same("nth")).select(*unpacked(docs, "x.row"), *named)
