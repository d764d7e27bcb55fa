"""Blinding manifests: keyed aliases of models, a public list and a private map that can be held against each other.

Aliases and orders are HMACs of a secret, so only its keeper can make them again. The public list holds
aliases and commitments, never a model's name; the private map holds both.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brightloom.operators.integrity import hmac_alias, rows_commitment

# The form of an alias, the first length of its digest and by how much it grows.
PREFIX, LENGTH, STEP = "SYS-", 12, 2
DIGEST = 64
SCHEME = "hmac-sha256:"


def _digest(column: Column, secret: bytes, purpose: str, study_id: str) -> Column:
    return hmac_alias(column, secret, f"{purpose}\x1f{study_id}", DIGEST)


def aliases(models: DataFrame, secret: bytes, study_id: str, length: int = LENGTH, step: int = STEP) -> DataFrame:
    """(model_id, alias) of ``models`` (model_id): the beginning of a model's HMAC, ``length`` digits of it; of
    models that share them the first by name keeps them, and the others go on with ``step`` more, and so on.
    A round has only the models that the one before left, so with whole lengths there is one. Repeated and
    blank names are an error when their row is read."""
    if len(secret) < 32 or not study_id.strip():
        raise ValueError("a study and a secret of 32 bytes or more are required")
    name = F.trim("model_id")
    clash = F.raise_error(F.concat(F.lit("models share a name or an alias: "), name))
    again = F.count("*").over(Window.partitionBy(name)) > 1
    named = models.select(F.when(F.coalesce(name, F.lit("")) == "", F.raise_error(F.lit("a model has no name"))).when(again, clash).otherwise(name).alias("model_id"))
    left, out = named.withColumn("digest", _digest(F.col("model_id"), secret, "alias", study_id)), None
    for size in range(length, DIGEST + 1, step):
        nth = F.row_number().over(Window.partitionBy(F.substring("digest", 1, size)).orderBy("model_id"))
        ranked = left.withColumn("nth", nth)
        kept = ranked.where("nth = 1").select("model_id", F.concat(F.lit(PREFIX), F.upper(F.substring("digest", 1, size))).alias("alias"))
        out = kept if out is None else out.union(kept)
        left = ranked.where("nth > 1").drop("nth")
        if left.isEmpty():
            return out
    return out.union(left.select("model_id", clash.cast("string").alias("alias")))


def header(private: DataFrame, secret: bytes, study_id: str, task_commitment: str) -> DataFrame:
    """One row that stands over both manifests: study_id, task_commitment, model_count, key_commitment and
    mapping_commitment, which only the secret can make."""
    listed = rows_commitment(private, ["model_id", "alias"])
    keyed = lambda value, purpose: F.concat(F.lit(SCHEME), _digest(value, secret, purpose, study_id))
    return listed.select(
        F.lit(study_id).alias("study_id"), F.lit(task_commitment).alias("task_commitment"), F.col("rows").alias("model_count"),
        keyed(F.lit("key"), "key").alias("key_commitment"), keyed(F.col("commitment"), "mapping").alias("mapping_commitment"),
    )


def public_list(private: DataFrame, secret: bytes, study_id: str) -> DataFrame:
    """(position, alias) in an order that tells nothing: that of another HMAC of the names. A study's models
    are few: one task numbers them."""
    order = _digest(F.col("model_id"), secret, "display-order", study_id)
    return private.withColumn("o", order).select(F.row_number().over(Window.orderBy("o", "model_id")).alias("position"), "alias")


def verification(public: DataFrame, private: DataFrame, public_header: DataFrame, private_header: DataFrame, secret: bytes | None = None) -> DataFrame:
    """One row of checks of a public list (alias) and its header against a private map (model_id, alias) and
    its own: names_hidden (no name stands in a public text), aliases_unique, aliases_match, headers_match,
    count_matches, key_verified and mapping_verified (null without the secret), and passed.

    Names are looked for as parts of public texts by joining the parts that are as long as some name, so
    nothing is compared with everything. A text, being short, has many more parts than the planner can know: the
    join is by shuffle, so that neither side goes through the driver."""
    texts = public.select(F.col("alias").alias("text")).union(public_header.select(F.explode(F.array("study_id", "task_commitment", "key_commitment", "mapping_commitment"))))
    lengths = private.agg(F.collect_set(F.length("model_id")).alias("lengths"))
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda i: F.substring(F.col("text"), i, n))
    fitting = F.filter("lengths", lambda n: n.between(1, F.length("text")))
    parts = texts.join(F.broadcast(lengths)).select(F.explode(F.flatten(F.transform(fitting, cut))).alias("part"))
    shown = parts.join(private.select("model_id").hint("merge"), F.col("part") == F.col("model_id"), "left_semi").agg((F.count("*") == 0).alias("names_hidden"))
    sizes = public.agg(F.count("*").alias("listed"), F.count_distinct("alias").alias("different")).join(private.agg(F.count("*").alias("mapped"), F.count_distinct("alias").alias("mapped_aliases"), F.count_distinct("model_id").alias("models")))
    a, b = public.select("alias").distinct().withColumn("p", F.lit(1)), private.select("alias").distinct().withColumn("q", F.lit(1))
    unmatched = a.join(b, "alias", "full_outer").agg((F.count_if(F.col("p").isNull() | F.col("q").isNull()) == 0).alias("aliases_match"))
    fields = ("study_id", "task_commitment", "model_count", "key_commitment", "mapping_commitment")
    mine = public_header.select(F.struct(*fields).alias("x"))
    both = mine.join(private_header.select(F.struct(*fields).alias("y")))
    if secret is None:
        truth = both.withColumn("key_verified", F.lit(None).cast("boolean")).withColumn("mapping_verified", F.lit(None).cast("boolean"))
    else:
        listed = rows_commitment(private, ["model_id", "alias"])
        mac = lambda purpose, value: hmac_alias(F.concat_ws("\x1f", F.col("x.study_id"), value), secret, purpose, DIGEST)
        truth = both.join(listed).withColumn("key_verified", F.col("x.key_commitment") == F.concat(F.lit(SCHEME), mac("key", F.lit("key")))).withColumn("mapping_verified", F.col("x.mapping_commitment") == F.concat(F.lit(SCHEME), mac("mapping", F.col("commitment"))))
    one = functools.reduce(lambda p, q: p.join(F.broadcast(q)), (shown, sizes, unmatched, truth))  # a row each
    checks = one.select(
        "names_hidden", ((F.col("listed") == F.col("different")) & (F.col("mapped") == F.col("mapped_aliases")) & (F.col("mapped") == F.col("models"))).alias("aliases_unique"), "aliases_match",
        F.col("x").eqNullSafe(F.col("y")).alias("headers_match"), ((F.col("x.model_count") == F.col("mapped")) & (F.col("listed") == F.col("mapped"))).alias("count_matches"), "key_verified", "mapping_verified",
    )
    passed = functools.reduce(lambda p, q: p & q, [F.coalesce(F.col(c), F.lit(c.endswith("verified"))) for c in checks.columns])
    return checks.withColumn("passed", passed)
