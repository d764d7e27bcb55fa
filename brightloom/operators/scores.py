"""Comparing score distributions and judging predictions against outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brightloom.operators.ordered import mean_ranks

#: Bins, the added share inside the logarithm, thresholds of the decision.
BINS, EPSILON, WARN, BRIDGE = 10, 1e-6, 0.1, 0.25


def bin_of(score: Column, bins: int = BINS) -> Column:
    """The bin of a score in [0, 1]: its truncated multiple, kept within range."""
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(score * float(bins)).cast("int")))


def compare_distributions(scores: DataFrame, baseline: str, candidate: str, bins: int = BINS) -> DataFrame:
    """One row: means of two groups of (group, score), their difference, the stability index and largest
    bin shift, and what to do. A score outside 0 to 1, or none in either group, is an error."""
    spark = scores.sparkSession
    outside = F.col("score").isNull() | ~F.col("score").between(0.0, 1.0)
    checked = scores.where(F.col("group").isin(baseline, candidate)).withColumn("score", F.when(outside, F.raise_error(F.lit("scores must be from 0 to 1"))).otherwise(F.col("score")))
    of = lambda g, x: F.sum(F.when(F.col("group") == g, x))
    counted = checked.groupBy(bin_of(F.col("score"), bins).cast("long").alias("bin")).agg(
        F.count_if(F.col("group") == baseline).alias("b"), F.count_if(F.col("group") == candidate).alias("c"), of(baseline, F.col("score")).alias("sb"), of(candidate, F.col("score")).alias("sc")
    )
    every = Window.partitionBy()
    full = spark.range(bins).withColumnRenamed("id", "bin").join(counted, "bin", "left").fillna(0, ["b", "c"])
    share = full.withColumn("p", F.try_divide("b", F.sum("b").over(every))).withColumn("q", F.try_divide("c", F.sum("c").over(every)))
    index = F.sum((F.col("q") - F.col("p")) * F.log((F.col("q") + EPSILON) / (F.col("p") + EPSILON)))
    mean = lambda s, n: F.sum(s) / F.when(F.sum(n) > 0, F.sum(n)).otherwise(F.raise_error(F.lit("a group has no scores")).cast("long"))
    out = share.agg(mean("sb", "b").alias("baseline_mean"), mean("sc", "c").alias("candidate_mean"), index.alias("stability_index"), F.max(F.abs(F.col("q") - F.col("p"))).alias("max_bin_shift"), F.sum("b").alias("baseline_n"), F.sum("c").alias("candidate_n"))
    action = F.when(F.col("stability_index") >= BRIDGE, "new-major-release-and-bridge-study").when(F.col("stability_index") >= WARN, "investigate-and-recalibrate").otherwise("none")
    return out.withColumn("mean_shift", F.col("candidate_mean") - F.col("baseline_mean")).withColumn("action", action)


def auc(predictions: DataFrame) -> DataFrame:
    """One row: area under the curve of (label, score) by rank sums; null when a class is absent.

    Scores are counted first: ranks are running sums over distinct scores."""
    counted = predictions.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count("*").alias("n"))
    ranked = mean_ranks(counted, "score")
    sums = ranked.agg(F.sum("pos").alias("positives"), F.sum(F.col("n") - F.col("pos")).alias("negatives"), F.sum(F.col("pos") * F.col("mean_rank")).alias("_r"))
    both = F.col("positives") * F.col("negatives")
    return sums.select("positives", "negatives", F.when(both > 0, (F.col("_r") - F.col("positives") * (F.col("positives") + 1) / 2.0) / F.when(both > 0, both)).alias("auc"))


def spearman(pairs: DataFrame) -> DataFrame:
    """One row: rank correlation of (x, y); null on a constant margin. Equal pairs are counted first, and
    each margin is ranked over its distinct values; mean ranks have a known mean."""
    cells = pairs.groupBy("x", "y").agg(F.count("*").alias("n"))
    margin = lambda c: mean_ranks(cells.groupBy(c).agg(F.sum("n").alias("n")), c).select(F.col(c).alias(f"_{c}"), F.col("mean_rank").alias(f"r{c}"))
    ranked = cells.join(margin("x"), F.col("x").eqNullSafe(F.col("_x"))).join(margin("y"), F.col("y").eqNullSafe(F.col("_y")))
    moment = lambda a, b: F.sum(F.col("n") * F.col(a) * F.col(b))
    total, sx, sy = F.sum("n"), F.sum(F.col("n") * F.col("rx")), F.sum(F.col("n") * F.col("ry"))
    centred = [moment(a, b) - p * q / total for a, b, p, q in (("rx", "ry", sx, sy), ("rx", "rx", sx, sx), ("ry", "ry", sy, sy))]
    sums = ranked.agg(total.alias("n"), *[c.alias(name) for c, name in zip(centred, ("xy", "xx", "yy"))])
    spread = F.sqrt(F.col("xx") * F.col("yy"))
    return sums.select(F.coalesce("n", F.lit(0)).alias("n"), F.when(spread > 0, F.col("xy") / F.when(spread > 0, spread)).alias("rho"))


def calibration_error(predictions: DataFrame, bins: int = BINS) -> DataFrame:
    """One row: expected calibration error of (probability, outcome); bin i holds i/b <= p < (i+1)/b."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    binned = predictions.withColumn("_bin", F.size(F.filter(edges, lambda e: e <= F.col("probability"))))
    each = binned.groupBy("_bin").agg(F.count("*").alias("n"), F.abs(F.avg("probability") - F.avg("outcome")).alias("gap"))
    return each.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("calibration_error"), F.sum("n").alias("n"))


def brier(predictions: DataFrame) -> DataFrame:
    """One row: mean squared distance of probability and outcome."""
    return predictions.agg(F.avg(F.pow(F.col("probability") - F.col("outcome"), 2)).alias("brier"), F.count("*").alias("n"))


def conservative_rates(outcomes: DataFrame) -> DataFrame:
    """One row: rates of (valid, success, score) with invalid rows as failures in the denominator."""
    ok = F.coalesce(F.col("valid"), F.lit(False))
    return outcomes.agg(
        F.count("*").alias("n"), F.count_if(~ok).alias("invalid"), F.avg(F.when(ok, F.col("success").cast("double")).otherwise(0.0)).alias("success_rate"), F.avg(F.when(ok, F.col("score")).otherwise(0.0)).alias("mean_score")
    )
