"""Endpoint analysis that fails closed: what is wrong with collected ratings, and figures that no row can be
read of unless the ratings are complete.

Ratings: row_id, episode_id, cluster, valid, outcome (1 or 0), invalid_reason and duplicate_of (the row_id of
the base row that a row repeats; null for base rows). Locked: the episodes (episode_id, cluster) whose base
rows make the denominator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.operators.integrity import rows_commitment
from brightloom.operators.resampling import leave_one_out, statistic_bootstrap, weighted_auc

DIGITS = 6


def rating_findings(ratings: DataFrame, locked: DataFrame) -> DataFrame:
    """(subject, finding): all that keeps ``ratings`` from being analysed. Each kind is found by a count or a
    join over keys; nothing is gathered."""
    valid = F.coalesce(F.col("valid"), F.lit(False))
    answered = F.col("outcome").isin(0, 1)
    own = F.array_compact(F.array(
        F.when(F.col("valid").isNull(), "valid-not-stated"), F.when(valid & ~F.coalesce(answered, F.lit(False)), "valid-without-outcome"), F.when(valid & F.col("invalid_reason").isNotNull(), "valid-with-reason"),
        F.when(~valid & F.col("outcome").isNotNull(), "invalid-with-outcome"), F.when(~valid & (F.trim(F.coalesce("invalid_reason", F.lit(""))) == ""), "invalid-without-reason"),
    ))
    by_row = ratings.select(F.col("row_id").alias("subject"), F.explode(own).alias("finding"))
    named = lambda df, key, finding: df.select(F.col(key).cast("string").alias("subject"), F.lit(finding).alias("finding"))
    repeated = ratings.groupBy("row_id").agg(F.count("*").alias("n")).where("n > 1 or row_id is null")
    places = locked.select("episode_id", F.col("cluster").alias("locked_cluster"))
    base = ratings.where("duplicate_of is null")
    counted = places.join(base.groupBy("episode_id").agg(F.count("*").alias("n")), "episode_id", "left").fillna(0, ["n"])
    met = ratings.join(places, "episode_id", "left")
    again = ratings.where("duplicate_of is not null").join(base.select(F.col("row_id").alias("of"), F.col("episode_id").alias("of_episode")), F.col("duplicate_of") == F.col("of"), "left")
    parts = [
        by_row, named(repeated, "row_id", "repeated-row-id"), named(met.where("locked_cluster is null"), "row_id", "episode-not-locked"),
        named(met.where("locked_cluster <> cluster or (locked_cluster is not null and cluster is null)"), "row_id", "other-cluster"), named(counted.where("n = 0"), "episode_id", "no-base-row"), named(counted.where("n > 1"), "episode_id", "several-base-rows"),
        named(again.where("of is null"), "row_id", "duplicate-of-no-base-row"), named(again.where("of_episode <> episode_id"), "row_id", "duplicate-of-another-episode"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def complete_rows(ratings: DataFrame, locked: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The base rows of the locked episodes with their score (episode_id, cluster, valid, outcome, score), and
    one row that counts them: locked, base, scored, valid, and for each class its rows and clusters."""
    base = ratings.where("duplicate_of is null").select("episode_id", F.coalesce("valid", F.lit(False)).alias("valid"), F.col("outcome").cast("int").alias("outcome"), F.lit(1).alias("rated"))
    rows = locked.select("episode_id", "cluster").join(base, "episode_id", "left").join(scores.select("episode_id", F.col("score").cast("double").alias("score")), "episode_id", "left")
    of = lambda label: F.col("valid") & (F.col("outcome") == label)
    counts = rows.agg(
        F.count("*").alias("rows"), F.count_distinct("episode_id").alias("locked"), F.count("rated").alias("base"), F.count("score").alias("scored"), F.count_if("valid").alias("valid"),
        *[F.count_if(of(k)).alias(f"class_{k}") for k in (0, 1)], *[F.count_distinct(F.when(of(k), F.col("cluster"))).alias(f"clusters_{k}") for k in (0, 1)],
    )
    return rows.drop("rated"), counts


def gate(counts: DataFrame, least_rows: int = 1, least_clusters: int = 2) -> DataFrame:
    """``counts`` as they are, if the analysis may go on; else an error when the row is read: base rows or
    scores that do not fill the locked denominator or exceed it, classes with fewer rows or clusters than
    asked for."""
    whole = lambda c: F.col(c) == F.col("locked")
    checks = {"no locked episodes": F.col("locked") > 0, "base rows do not fill the locked denominator": whole("rows") & whole("base"), "scores do not fill the locked denominator": whole("scored")}
    for k in (0, 1):
        checks[f"too few rows of class {k}"] = F.col(f"class_{k}") >= least_rows
        checks[f"too few clusters of class {k}"] = F.col(f"clusters_{k}") >= least_clusters
    wrong = F.array_compact(F.array(*[F.when(~ok, F.lit(text)) for text, ok in checks.items()]))
    return counts.withColumn("locked", F.when(F.size(wrong) > 0, F.raise_error(F.concat(F.lit("endpoint analysis: "), F.array_join(wrong, "; ")))).otherwise(F.col("locked")))


def _whole(number: Column) -> Column:
    return F.coalesce(F.round(number * 10**DIGITS).cast("long").cast("string"), F.lit("none"))


def endpoint_receipt(ratings: DataFrame, locked: DataFrame, scores: DataFrame, endpoint: str, statistic: Callable[[DataFrame], DataFrame] = weighted_auc, samples: int = 10_000, seed: int = 0, least_rows: int = 1, least_clusters: int = 2) -> DataFrame:
    """One row: counts, estimate, interval of whole clusters, the range of leaving one out, whether either
    failed closed, the commitment to the rows that were analysed, and receipt_sha256 over all of these.
    The gate stands in the row itself, so there is no receipt without it."""
    rows, counts = complete_rows(ratings, locked, scores)
    used = rows.where("valid").select("cluster", F.col("score").alias("x"), F.col("outcome").cast("double").alias("y"))
    loo = leave_one_out(used, statistic).agg(F.min("estimate").alias("loo_low"), F.max("estimate").alias("loo_high"), F.bool_or("fail_closed").alias("loo_fail_closed"))
    bound = rows_commitment(rows, ["episode_id", "cluster", "valid", "outcome"], "rows_sha256").select("rows_sha256")
    one = gate(counts, least_rows, least_clusters)
    for part in (statistic_bootstrap(used, statistic, samples, seed), loo, bound):
        one = one.join(F.broadcast(part))  # a row each
    closed = F.col("fail_closed") | F.col("loo_fail_closed")
    out = one.select(F.lit(endpoint).alias("endpoint"), "locked", "valid", "class_0", "class_1", "clusters_0", "clusters_1", "estimate", "ci_low", "ci_high", "degenerate", "loo_low", "loo_high", closed.alias("fail_closed"), "rows_sha256")
    stated = [F.col(c).cast("string") for c in ("endpoint", "locked", "valid", "class_0", "class_1", "clusters_0", "clusters_1")] + [_whole(F.col(c)) for c in ("estimate", "ci_low", "ci_high", "loo_low", "loo_high")]
    return out.withColumn("receipt_sha256", F.sha2(F.concat_ws("\x1f", *stated, F.col("degenerate").cast("string"), F.col("fail_closed").cast("string"), F.col("rows_sha256")).cast("binary"), 256))
