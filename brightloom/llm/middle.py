r"""Fill-in-the-middle by relational units: posexplode, running sums, a join with cut requests, substring.

A text is parted into units, runs of ASCII letters or single other characters. Its matches become rows,
``BLOCK`` units a row, whose running sum is the offset behind a block. Cut requests, one row a text with
the ordinals of its two cuts, are joined to the blocks by ordinal; the units of a block that is met are
listed and summed up to the cut. The offsets are gathered for each text, and ``substring`` cuts it there.

Texts are keyed by two 64-bit hashes of (doc_id, text) and shuffled once: rows are first reduced to one
for each key within the input partitions, the units stand in the partition of their text, and never
leave it. Block 0 has no unit and carries the text itself, so nothing is joined back. The requests are a
small written table.

Defined results: a null text is an empty one, plain with no unit; a null id draws from ``1:`` alone;
repeated rows each get the same result; texts with a marker are plain; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brightloom.llm.common import materialise

# A unit, the markers, the share of texts that are changed, and of those with the suffix first.
UNIT = r"[A-Za-z]++|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHANGED, SUFFIX_FIRST = 90, 20
BLOCK = 32  # units of a row
_COPIES = 1 << 16


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def form(doc_id: Column, text: Column, seed: int = 1) -> Column:
    """plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle)."""
    _, _, h3, h4 = draws(doc_id, seed)
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (h3 % 100 >= CHANGED)
    return F.when(plain, "plain").when(h4 % 100 < SUFFIX_FIRST, "spm").otherwise("psm")


def unit_count(text: Column) -> Column:
    """Units of a text, counted without listing them: each run of letters counts as one character."""
    return F.length(F.regexp_replace(text, "[A-Za-z]++", "a")).cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return plain.select(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(7), "doc_id", "text").alias("b"), "doc_id", "text")


def cut_requests(docs: DataFrame, seed: int = 1) -> DataFrame:
    """(a, b, n, form, first, second, copies) of every different row: where its text is to be cut, in units."""
    h1, h2, _, _ = draws(F.col("doc_id"), seed)
    once = _keyed(docs).select("a", "b", "doc_id", unit_count(F.col("text")).alias("n"), form(F.col("doc_id"), F.col("text"), seed).alias("form"))
    once = once.groupBy("a", "b").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("form").alias("form"), F.count("*").alias("copies"))
    one, two = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    cut = lambda c: F.when(F.col("form") != "plain", c)
    return once.select("a", "b", "n", "form", cut(F.least(one, two)).alias("first"), cut(F.greatest(one, two)).alias("second"), "copies")


def unit_blocks(docs: DataFrame, seed: int = 1) -> DataFrame:
    """(a, b, block, row, lengths, ahead): the units of every different text that is to be cut, from block 1
    on, with their lengths and the characters before the block; block 0 stands for every text and
    carries (doc_id, text) as ``row``."""
    once = _keyed(docs).groupBy("a", "b").agg(F.first(F.struct("doc_id", "text")).alias("row"))
    text, kind = F.col("row.text"), once.schema["row"].dataType
    matches = F.when(form(F.col("row.doc_id"), text, seed) != "plain", F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)))
    listed = once.select("a", "b", "row", F.coalesce(F.transform(matches, F.length), F.array().cast("array<int>")).alias("all"))
    block = lambda row, lengths: F.struct(row.alias("row"), lengths.alias("lengths"))
    starts = F.filter(F.sequence(F.lit(1), F.size("all") + 1, F.lit(BLOCK)), lambda i: i <= F.size("all"))
    blocks = F.concat(F.array(block(F.col("row"), F.array().cast("array<int>"))), F.transform(starts, lambda i: block(F.lit(None).cast(kind), F.slice("all", i, F.lit(BLOCK)))))
    rows = listed.select("a", "b", F.posexplode(blocks).alias("block", "unit")).select("a", "b", "block", "unit.row", "unit.lengths")
    before = Window.partitionBy("a", "b").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sized = rows.withColumn("chars", F.aggregate("lengths", F.lit(0), lambda total, n: total + n))
    return sized.withColumn("ahead", F.coalesce(F.sum("chars").over(before), F.lit(0))).drop("chars")


def transform(docs: DataFrame, seed: int = 1) -> DataFrame:
    """One row for each of ``docs`` (doc_id, text): doc_id, text, n (units), form, prefix_chars,
    middle_chars (null if plain) and output."""
    requests = materialise(cut_requests(docs, seed))
    blocks = unit_blocks(docs, seed).withColumnsRenamed({"a": "ua", "b": "ub"})
    # equal keys, and the ordinal as a condition: with it among the keys, all blocks would be shuffled anew
    within = lambda cut: F.col("block") == F.ceil(F.col(cut) / BLOCK)
    met = blocks.join(requests, (F.col("ua") == F.col("a")) & (F.col("ub") == F.col("b")) & ((F.col("block") == 0) | within("first") | within("second")))
    units = met.select("*", F.posexplode_outer("lengths").alias("at", "chars")).withColumn("ordinal", (F.col("block") - 1) * BLOCK + F.col("at") + 1)
    behind = lambda cut: F.max(F.when(within(cut), F.col("ahead"))) + F.coalesce(F.sum(F.when(within(cut) & (F.col("ordinal") <= F.col(cut)), F.col("chars"))), F.lit(0))
    texts = units.groupBy("ua", "ub").agg(
        F.first("row", ignorenulls=True).alias("row"), F.first("n").alias("n"), F.first("form").alias("form"), F.first("copies").alias("copies"), behind("first").alias("x"), behind("second").alias("y")
    )
    text, x, y = F.col("row.text"), F.col("x").cast("int"), F.col("y").cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), x), F.substring(text, x + 1, y - x), F.substring(text, y + 1, F.length(text))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(text)
    )
    out = texts.select(F.col("row.doc_id").alias("doc_id"), text.alias("text"), "n", "form", F.col("x").cast("long").alias("prefix_chars"), (F.col("y") - F.col("x")).cast("long").alias("middle_chars"), output.alias("output"), "copies")
    blocks = out.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / _COPIES))))
    each = blocks.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(_COPIES).cast("long"), F.col("copies") - F.col("block") * _COPIES))))
    return each.drop("copies", "block", "copy")


def restore(output: Column, kind: Column) -> Column:
    """The text that ``output`` of form ``kind`` was made from. No part holds a marker, so the first
    place of the second and third marker parts it."""

    def parts(second: str) -> tuple[Column, Column, Column]:
        at = F.locate(second, output, 4)
        then = F.instr(F.substring(output, at + 3, F.length(output)), MIDDLE) + at + 2
        return F.substring(output, F.lit(4), at - 4), F.substring(output, at + 3, then - at - 3), F.substring(output, then + 3, F.length(output))

    prefix, suffix, middle = parts(SUFFIX)
    suffix2, prefix2, middle2 = parts(PREFIX)
    return F.when(kind == "psm", F.concat(prefix, middle, suffix)).when(kind == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def report(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The digests of ``transform``: doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = transform(docs, seed)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
