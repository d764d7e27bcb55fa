r"""Document fingerprints by consistent weighted sampling, in Spark SQL expressions only.

The terms of a text are its lower-case words, weighted by their counts. For each sample k and term,
r and c are gamma(2, 1) variates (minus the log of a product of two uniforms of 26 bits) and b a uniform
one, all from two hashes of (term, k); t = floor(ln(w) / r + b), and the term of the least
ln(c) - r * (t - b + 1), together with its t, is the sample. Two texts agree in a sample with the
probability of their generalised Jaccard similarity, sum of least over sum of greatest weights.

``compare`` also needs each document's successor in descending order of ids. Ids are cut into ranges
by approximate percentiles, at most ``RANGES`` of them; each range's rows, and the one row that
follows them, meet in a window, so the texts are shuffled once and no range holds much more than its
share. Rows without an id are dealt to ranges by a hash of their text. Terms are counted before they
are sampled, within the same partitioning. A word is a run of letters or digits; in scripts written
without blanks (Han, kana, Thai, Lao, Khmer, Burmese) each letter is one.

Defined results: null is an empty text; texts without a word have the empty fingerprint, which is
like itself and nothing else; null ids come last and, like repeated ids, in the order of a hash of
their texts; rows of one id are in one range; the last row's successor is the first, also of a single
row; further columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLES = 64
BEYOND = 32.0
ROWS, RANGES, SAMPLE = 512, 20000, 400000  # rows of a range, or more so that there are not more ranges; ids that the cuts are taken from
_U_BITS, _B_BITS, _CODE_BITS = 26, 12, 30  # b takes its bits of both hashes
_SCALE = float(1 << 26)
_WORD_GAP = r"[^\p{L}\p{N}]+"
_BEYOND = r"[\u0E00-\x{10FFFF}]"  # all letters of those scripts
_NO_BLANKS = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"


def _cuts(docs: DataFrame, rows: int, ranges: int) -> tuple[list[float], int, bool]:
    """Cuts between ranges of about ``rows`` documents with an id, the number of ranges for those without,
    and whether some text has letters that are words of their own; at most about ``ranges`` ranges of
    each, and the cuts from at most about ``SAMPLE`` ids. A cut only has to be about right, so it may be a
    rounded id."""
    known, null, letters = docs.agg(F.count("doc_id"), F.count_if(F.col("doc_id").isNull()), F.coalesce(F.max(_parts_letters(F.col("text"))), F.lit(False))).first()
    parts = max(1, min(ranges, -(-known // rows)))
    cuts: list[float] = []
    if parts > 1:
        drawn = docs.select(F.col("doc_id").cast("double").alias("x")).where(F.xxhash64("doc_id") % F.lit(max(1, known // SAMPLE)) == 0)
        found = drawn.agg(F.percentile_approx("x", [k / parts for k in range(1, parts)], 20 * parts)).first()[0]
        cuts = sorted(set(found or []))
    return cuts, max(1, min(ranges, -(-null // rows))), letters


def _ranged(docs: DataFrame) -> tuple[DataFrame, bool]:
    """Rows with their range, each range with the row after its last: (range, wraps, guest, doc_id, h,
    text), and whether letters are to be parted. Greater ids are in higher ranges, rows without an id in the lowest, dealt by the hash of the
    text, h."""
    cuts, null_ranges, letters = _cuts(docs, ROWS, RANGES)
    dealt = F.floor((F.col("h") / float(1 << 63) + 1) / 2 * null_ranges).cast("int")
    out = docs.withColumn("h", F.xxhash64("text")).withColumn("range", F.lit(0))
    if cuts:
        at, x = F.from_json(F.lit(json.dumps(cuts)), "array<double>"), F.col("doc_id").cast("double")
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
        below = F.aggregate(steps, F.lit(0), lambda a, s: F.when(F.get(at, a + s - 1) < x, a + s).otherwise(a))  # binary search; beyond the end is null
        out = out.withColumn("range", below)
    out = out.withColumn("range", F.when(F.col("doc_id").isNull(), F.least(dealt, F.lit(null_ranges - 1))).otherwise(F.col("range") + null_ranges))
    # one row a range: the first in descending order, which follows the last of the next range that has rows
    heads = out.groupBy("range").agg(F.max(F.struct("doc_id", "h")).alias("head"))
    order = Window.orderBy("range")
    above = F.coalesce(F.lead("range").over(order), F.first("range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select(F.col("range").alias("of"), "head", above.alias("above"), F.lead("range").over(order).isNull().alias("wraps"))
    met = out.join(F.broadcast(heads), (F.col("range") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("h") == F.col("head.h")), "left")
    place = lambda r, wraps, guest: F.struct(r.alias("range"), wraps.alias("wraps"), F.lit(guest).alias("guest"))
    places = F.array(place(F.col("range"), F.lit(False), False), F.when(F.col("of").isNotNull(), place(F.col("above"), F.col("wraps"), True)))
    # the join of the results asks for ranges; said here, both of its sides have the same rows and share one shuffle of the texts
    placed = met.withColumn("p", F.explode(F.filter(places, lambda p: p.isNotNull()))).where(F.col("p.range").isNotNull())
    return placed.select("p.range", "p.wraps", "p.guest", "doc_id", "h", "text"), letters


def _here() -> Column:
    """0, in an expression that filters are not moved across: the columns that they test are then computed once."""
    return F.spark_partition_id() * 0


def signatures(terms: DataFrame, keys: list[str], weights: dict[str, str], samples: int = SAMPLES, least: dict[str, str] | None = None) -> DataFrame:
    """For each group of ``keys`` and each (name, weight column) of ``weights`` an array ``name`` of the
    samples' codes; -1 where no term has that weight. ``terms``: keys, term (long), weights. ``least`` may
    name a column for each name with a positive number that its weights in the group sum up to at least.

    Terms are unrolled over the samples inside one generated loop and reduced at once: the least
    value of a sample and the code of its term and t travel in one long, so the aggregate keeps two
    numbers for each group and sample, and nothing is sorted or shuffled. The value of a term of weight w
    is the logarithm of an exponential variate of rate w, so the least of a group of total W exceeds
    ``BEYOND / W`` once in exp(BEYOND) = 8e13 samples, and terms beyond that are left out (such a sample has
    no code). As c >= 1 - exp(-c), most of them are told by products of uniforms, without a logarithm."""
    mask = lambda bits: F.lit((1 << bits) - 1)

    def bits(h: str, at: int, size: int) -> Column:
        return F.shiftrightunsigned(h, at).bitwiseAND(mask(size)).cast("double")

    def product(at: int) -> Column:  # of two uniforms; minus its logarithm is a gamma(2, 1) variate
        u, v = (bits(h, at, _U_BITS) + 0.5 for h in "hg")
        return u * v / float(1 << 2 * _U_BITS)

    facts, most = [], []
    for name, w in weights.items():
        weight, bound = F.when(F.col(w) > 0, F.col(w).cast("double")), BEYOND / F.col(least[name]) if least else F.lit(1e300)
        facts += [F.log(weight).alias(f"log_{name}"), F.log(bound).alias(f"most_{name}")]
        most.append(F.coalesce(weight * bound, F.lit(0.0)))
    unrolled = terms.select(*keys, "term", *facts, (F.greatest(*most) if len(most) > 1 else most[0]).alias("most"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("k"))
    kept = [*keys, "k", *[f"{x}_{name}" for name in weights for x in ("log", "most")]]
    drawn = unrolled.select(*kept, "most", F.col("term").bitwiseAND(mask(_CODE_BITS)).alias("term"), F.xxhash64("term", F.col("k")).alias("h"))
    drawn = drawn.select("*", F.xxhash64("h").alias("g"))
    drawn = drawn.select(*kept, "most", "term", "h", "g", product(0).alias("p"), (product(_U_BITS) + _here()).alias("q"))
    drawn = drawn.where(((1 - F.col("q")) * F.col("p") <= F.col("most")) | (F.col("k") == 0))  # sample 0 keeps every group, also one without weights
    b = bits("h", 2 * _U_BITS, _B_BITS) * float(1 << _B_BITS) + bits("g", 2 * _U_BITS, _B_BITS)
    drawn = drawn.select(*kept, "term", (-F.log("p")).alias("r"), (b / float(1 << 2 * _B_BITS)).alias("b"), F.log(-F.log("q")).alias("c"))
    drawn = drawn.select(*kept, "term", "r", "b", "c", *[F.floor(F.col(f"log_{name}") / F.col("r") + F.col("b")).alias(f"t_{name}") for name in weights])
    value = lambda name: F.col("c") - F.col("r") * (F.col(f"t_{name}") - F.col("b") + 1)
    drawn = drawn.select(*kept, "term", *[f"t_{name}" for name in weights], *[value(name).alias(f"v_{name}") for name in weights])

    def packed(name: str) -> Column:
        code = (F.col("term") + F.col(f"t_{name}") * F.lit(0x1F123BB5)).bitwiseAND(mask(_CODE_BITS))
        whole = F.shiftleft(((F.col(f"v_{name}") + 64) * _SCALE).cast("long"), _CODE_BITS).bitwiseOR(code)
        return F.when(F.col(f"v_{name}") <= F.col(f"most_{name}"), whole)

    drawn = drawn.select(*keys, (F.col("k") + _here()).alias("k"), *[packed(name).alias(name) for name in weights])
    some = F.col("k") == 0
    for name in weights:
        some = some | F.col(name).isNotNull()
    least = drawn.where(some).groupBy(*keys, "k").agg(*[F.min(name).alias(name) for name in weights])
    low = lambda c: F.coalesce(F.col(c).bitwiseAND(mask(16)), F.lit(-1)).cast("int")
    gathered = least.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct(*[low(name).alias(name) for name in weights])))).alias("all"))
    each = F.sequence(F.lit(0), F.lit(samples - 1))
    filled = lambda name: F.transform(each, lambda k: F.coalesce(F.element_at("all", k).getField(name), F.lit(-1)))
    return gathered.select(*keys, *[filled(name).alias(name) for name in weights])


def as_text(signature: Column) -> Column:
    """Four hexadecimal digits a sample; empty without terms."""
    digits = F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFF)))), 4, "0")), "")
    return F.when(F.exists(signature, lambda x: x >= 0), digits).otherwise(F.lit(""))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(samples))


def _parts_letters(text: Column) -> Column:
    """Whether a text has a letter of a script without blanks."""
    return text.rlike(_BEYOND) & text.rlike(_NO_BLANKS)  # the first is one comparison a character


def words(text: Column, letters: bool) -> Column:
    """Lower-case words; some may be empty. With ``letters``, which has to be given where any text has
    one, a letter of a script without blanks is a word; without, the generated code is smaller."""
    apart = F.when(_parts_letters(text), F.regexp_replace(text, _NO_BLANKS, " $1 ")).otherwise(text) if letters else text
    return F.split(F.lower(apart), _WORD_GAP, -1)


def compare(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of
    every document and its edited text: the last half replaced by as much of the next document."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("range").orderBy("wraps", F.col("doc_id").desc_nulls_last(), F.desc("h"), "text", "guest")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    ranged, letters = _ranged(plain)
    rows = (
        ranged.select("range", "guest", "doc_id", "text", F.row_number().over(order).alias("nth"), F.lead("text").over(order).alias("next"))
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", F.when(~F.col("guest"), F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))))
    )
    facts = rows.where(~F.col("guest")).select("range", "nth", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    own, changed = words(F.col("text"), letters), F.coalesce(words(F.col("edited"), letters), F.array().cast("array<string>"))
    terms = (
        rows.select("range", "nth", own.alias("own"), changed.alias("changed"))
        .select("range", "nth", F.size("own").alias("n_own"), *[F.greatest(F.size(c) - 2, F.lit(1)).alias(f"least_{c}") for c in ("own", "changed")], F.posexplode(F.concat("own", "changed")).alias("pos", "word"))
        .select("range", "nth", "least_own", "least_changed", F.xxhash64("word").alias("term"), ((F.col("pos") < F.col("n_own")) & (F.col("word") != "")).cast("long").alias("a"), ((F.col("pos") >= F.col("n_own")) & (F.col("word") != "")).cast("long").alias("e"))
        .groupBy("range", "nth", "least_own", "least_changed", "term")
        .agg(F.sum("a").alias("a"), F.sum("e").alias("e"))
    )
    signed = signatures(terms, ["range", "nth"], {"own": "a", "edited": "e"}, samples, {"own": "least_own", "edited": "least_changed"})
    with_next = signed.select("range", "nth", "own", "edited", F.lead("own").over(Window.partitionBy("range").orderBy("nth")).alias("next"))
    figures = with_next.select(
        "range", "nth", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited"), samples).alias("near_edited"), likeness(F.col("own"), F.col("next"), samples).alias("near_next"),
    )
    return facts.join(figures, ["range", "nth"]).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
