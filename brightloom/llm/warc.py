r"""Merkle fixity audit of replicas of an archive.

A record is (record_id, payload); ids number the records of an archive in order. Each replica hashes
its records and builds a tree over ordered ranges of ids: a leaf spans ``FANOUT`` ids, each node
above as many nodes, so equal ids fall in equal ranges in every replica, whatever is missing or
added. A node's hash covers its range's records in order with their lengths. The audit compares
roots and goes down only where hashes differ; byte offsets come from the sizes of the ranges before,
one level at a time, for the visited branches only. A group exceeds the fan-out only by the records
that repeat one id; records without an id, of which there may be many, have a tree of their own and are
numbered there by the beginnings of their hashes.

Defined results: a null id is reported as -1 with ``named`` false, and its records stand before all
others in the order of their hashes; negative ids are ids like others, in their order; a null payload is an empty one; records that repeat an id are
compared in the order of their hashes; an empty archive has no root, so every record of the other is
missing or extra; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brightloom.llm.common import discard, materialise

BITS = 6
FANOUT = 1 << BITS
_NULL_BITS = 20


def record_text(record_id: Column, url: Column, body: Column) -> Column:
    """A response record as it stands in a WARC file."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def digests(records: DataFrame) -> DataFrame:
    """(named, id, nth, size, hash) of each record; nth tells records of one id apart."""
    payload = F.coalesce(F.col("payload"), F.lit("")).cast("binary")
    hashed = records.select(F.col("record_id").cast("long").alias("id"), F.octet_length(payload).cast("long").alias("size"), F.sha2(payload, 256).alias("hash"))
    unnumbered = F.conv(F.substring("hash", 1, _NULL_BITS // 4), 16, 10).cast("long")
    hashed = hashed.select(F.col("id").isNotNull().alias("named"), F.coalesce("id", unnumbered).alias("id"), "size", "hash")
    return hashed.withColumn("nth", F.row_number().over(Window.partitionBy("named", "id").orderBy("hash", "size")))


def tree(hashed: DataFrame, levels: int, scratch: list[str]) -> list[DataFrame]:
    """Tables of nodes (named, node, parent, size, n, hash), leaves first; their paths go to ``scratch``."""
    below = hashed.select("named", F.shiftright("id", BITS).alias("node"), F.col("id").alias("part"), "nth", "size", F.lit(1).cast("long").alias("n"), "hash")
    out = []
    for _ in range(levels):
        nodes = below.groupBy("named", "node").agg(
            F.sum("size").alias("size"), F.sum("n").alias("n"),
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "nth", "size", "hash"))), lambda x: F.concat_ws(":", x["part"].cast("string"), x["size"].cast("string"), x["hash"])), ",").cast("binary"), 256).alias("hash"),
        )
        nodes = materialise(nodes.withColumn("parent", F.shiftright("node", BITS)), scratch)
        out.append(nodes)
        below = nodes.select("named", F.col("parent").alias("node"), F.col("node").alias("part"), F.lit(1).alias("nth"), "size", "n", "hash")
    return out


def _differing(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Nodes whose hashes differ or that one side lacks: (named, node, at), the offset from the primary."""
    a, b = primary.select("named", "node", "at", F.col("hash").alias("x")), replica.select("named", "node", F.col("hash").alias("y"))
    return a.join(b, ["named", "node"], "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("named", "node", "at")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """The records that differ: record_id, kind (corrupt, missing, extra), rec_offset and rec_length
    in the primary, expected_sha256 and found_sha256, and named (false for records without an id)."""
    scratch: list[str] = []
    a, b = materialise(digests(primary)), materialise(digests(replica))
    far = a.select("id").union(b.select("id")).agg(F.max("id").alias("high"), F.min("id").alias("low")).first()
    # a tree up to the height at which no id is left but its sign
    levels = max(1, *(-(-int(x if x >= 0 else -1 - x).bit_length() // BITS) for x in (far["high"] or 0, far["low"] or 0)))
    trees = [tree(x, levels, scratch) for x in (a, b)]
    # three roots at most: of ids from 0 on, of those below, and of the records without an id
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    roots = trees[0][-1].withColumn("at", F.coalesce(F.sum("size").over(before(Window.orderBy("named", "node"))), F.lit(0)))
    bad = materialise(_differing(roots, trees[1][-1]), scratch)
    for level in range(levels - 2, -1, -1):
        parents = bad.select("named", F.col("node").alias("parent"), F.col("at").alias("base"))
        ahead = F.sum("size").over(before(Window.partitionBy("named", "parent").orderBy("node")))
        mine = trees[0][level].join(parents, ["named", "parent"]).withColumn("at", F.col("base") + F.coalesce(ahead, F.lit(0)))
        bad = materialise(_differing(mine, trees[1][level].join(parents.select("named", "parent"), ["named", "parent"])), scratch)
    scratch.pop()  # the last is read with the result
    discard(primary.sparkSession, scratch)
    leaves = bad.select("named", F.col("node").alias("leaf"), "at")
    keyed = [x.withColumn("leaf", F.shiftright("id", BITS)).join(leaves, ["named", "leaf"]) for x in (a, b)]
    inside = before(Window.partitionBy("named", "leaf").orderBy("id", "nth"))
    expected = keyed[0].select("named", "id", "nth", F.col("size").alias("rec_length"), F.col("hash").alias("expected_sha256"), (F.col("at") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("rec_offset"))
    found = keyed[1].select("named", "id", "nth", F.col("hash").alias("found_sha256"))
    kind = F.when(F.col("found_sha256").isNull(), "missing").when(F.col("expected_sha256").isNull(), "extra").otherwise("corrupt")
    return (
        expected.join(found, ["named", "id", "nth"], "full_outer")
        .where(~F.col("expected_sha256").eqNullSafe(F.col("found_sha256")))
        .select(F.when(F.col("named"), F.col("id")).otherwise(F.lit(-1)).alias("record_id"), kind.alias("kind"), "rec_offset", "rec_length", "expected_sha256", "found_sha256", "named")
    )
