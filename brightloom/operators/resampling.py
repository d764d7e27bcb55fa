"""Resampling by clusters: bootstrap, leave-one-out, permutation."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brightloom.functions.draws import hash_index

#: Limits of a bootstrap that still counts.
MAX_DEGENERATE, MIN_VALID = 0.10, 0.90


def mean_of_clusters(c: dict[str, Column]) -> Column:
    """The mean over the rows of the drawn clusters; null without a row."""
    return c["s"] / F.when(c["n"] > 0, c["n"])


def root_mean_square(c: dict[str, Column]) -> Column:
    """The root mean square over the rows of the drawn clusters; null without a row."""
    return F.sqrt(c["q"] / F.when(c["n"] > 0, c["n"]))


def cluster_bootstrap(rows: DataFrame, samples: int = 10_000, seed: int = 0, statistic: Callable[[dict[str, Column]], Column] = mean_of_clusters) -> DataFrame:
    """One row: a statistic of (cluster, value), its bootstrap interval when whole clusters are drawn, and
    whether too many resamples were degenerate (null). ``statistic`` is an expression over summed figures
    of the drawn clusters: s and q, the sums of values and squares, and n, the rows with a value. Clusters
    shrink to these before anything is multiplied by the number of samples."""
    value = F.col("value").cast("double")
    clusters = rows.groupBy("cluster").agg(F.sum(value).alias("s"), F.sum(value * value).alias("q"), F.count("value").alias("n"))
    numbered = clusters.withColumn("i", F.row_number().over(Window.orderBy("cluster")) - 1).withColumn("k", F.count("*").over(Window.partitionBy()))
    drawn = numbered.select("k", "i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample")).select("sample", hash_index(F.col("k"), F.lit(seed), F.col("sample"), F.col("i")).alias("i"))
    figures = {name: F.sum(name) for name in ("s", "q", "n")}
    each = drawn.join(numbered.select("i", "s", "q", "n"), "i").groupBy("sample").agg(statistic(figures).alias("x"))
    spread = each.agg(F.array_sort(F.array_agg("x")).alias("all"), F.count("*").alias("samples"), F.count("x").alias("valid"))
    at = lambda p: F.get("all", F.floor(p * (F.size("all") - 1)).cast("int"))
    point = clusters.agg(statistic(figures).alias("estimate"), F.count("*").alias("clusters"))
    failed = ((F.col("samples") - F.col("valid")) / F.col("samples") > MAX_DEGENERATE) | (F.col("valid") / F.col("samples") < MIN_VALID)
    return point.join(F.broadcast(spread)).select("estimate", "clusters", at(0.025).alias("ci_low"), at(0.975).alias("ci_high"), (F.col("samples") - F.col("valid")).alias("degenerate"), failed.alias("fail_closed"))


def leave_one_cluster_out(rows: DataFrame) -> DataFrame:
    """The mean without each cluster in turn: totals less the cluster's own, no pairs of rows."""
    every = Window.partitionBy()
    clusters = rows.groupBy("cluster").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    s, n = F.sum("s").over(every) - F.col("s"), F.sum("n").over(every) - F.col("n")
    return clusters.select("cluster", (s / F.when(n > 0, n)).alias("mean_without"), n.alias("rows_left"))


def drawn_times(rows: DataFrame, samples: int, seed: int) -> DataFrame:
    """(sample, cluster, times): how often each cluster of ``rows`` is drawn when, in each sample, as many are
    drawn with replacement as there are. Fewer than two clusters are an error when a row is read."""
    found = rows.select("cluster").distinct()
    every = F.count("*").over(Window.partitionBy())
    numbered = found.select("cluster", (F.row_number().over(Window.orderBy("cluster")) - 1).alias("i"), F.when(every < 2, F.raise_error(F.lit("at least two clusters are required"))).otherwise(every).alias("k"))
    drawn = numbered.select("k", "i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    times = drawn.groupBy("sample", hash_index(F.col("k"), F.lit(seed), F.col("sample"), F.col("i")).alias("i")).agg(F.count("*").alias("times"))
    return times.join(numbered.select("i", "cluster"), "i").select("sample", "cluster", "times")


def weighted_pairs(rows: DataFrame, times: DataFrame) -> DataFrame:
    """(sample, x, y, w): equal pairs of ``rows`` (cluster, x, y), where both are stated, counted by sample.
    Equal rows of a cluster are counted before they are multiplied by samples."""
    kept = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    counted = kept.groupBy("cluster", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.count("*").alias("n"))
    return counted.join(times, "cluster").groupBy("sample", "x", "y").agg(F.sum(F.col("n") * F.col("times")).alias("w"))


def weighted_mean(pairs: DataFrame) -> DataFrame:
    """(sample, value): the mean of x."""
    return pairs.groupBy("sample").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("value"))


def weighted_auc(pairs: DataFrame) -> DataFrame:
    """(sample, value): the area under the curve of score x and label y (1 or 0); null if a class is absent."""
    scores = pairs.groupBy("sample", "x").agg(F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0)).alias("neg"))
    below = Window.partitionBy("sample").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    wins = F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") / 2)
    sums = scores.select("sample", "pos", "neg", wins.alias("wins")).groupBy("sample").agg(F.sum("wins").alias("u"), (F.sum("pos") * F.sum("neg")).alias("both"))
    return sums.select("sample", (F.col("u") / F.when(F.col("both") > 0, F.col("both"))).alias("value"))


def weighted_spearman(pairs: DataFrame) -> DataFrame:
    """(sample, value): the rank correlation of x and y, ties at their mean; null on a constant margin. A value's
    mean rank is half a weight below what stands up to it."""
    upto = lambda c: F.sum("w").over(Window.partitionBy("sample").orderBy(c).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rank = lambda c: upto(c) - F.sum("w").over(Window.partitionBy("sample", c)) / 2 + 0.5
    ranked = pairs.select("sample", "w", rank("x").alias("rx"), rank("y").alias("ry"))
    mean = (F.sum("w").over(Window.partitionBy("sample")) + 1) / 2.0
    centred = ranked.select("sample", "w", (F.col("rx") - mean).alias("dx"), (F.col("ry") - mean).alias("dy"))
    moment = lambda a, b: F.sum(F.col("w") * F.col(a) * F.col(b))
    sums = centred.groupBy("sample").agg(moment("dx", "dy").alias("xy"), (F.sqrt(moment("dx", "dx")) * F.sqrt(moment("dy", "dy"))).alias("spread"))
    return sums.select("sample", (F.col("xy") / F.when(F.col("spread") > 0, F.col("spread"))).alias("value"))


def statistic_bootstrap(rows: DataFrame, statistic: Callable[[DataFrame], DataFrame], samples: int = 10_000, seed: int = 0, most_degenerate: float = MAX_DEGENERATE, least_valid: float = MIN_VALID) -> DataFrame:
    """One row: ``statistic`` of (cluster, x, y), its interval when whole clusters are drawn, and whether too
    many samples were degenerate, which leaves no interval. A statistic maps (sample, x, y, w) to (sample,
    value); a sample without a finite value is degenerate."""
    if samples < 1 or not 0 <= most_degenerate <= 1 or not 0 <= least_valid <= 1:
        raise ValueError("samples must be positive, fractions between 0 and 1")
    whole = rows.select("cluster").distinct().select(F.lit(0).alias("sample"), "cluster", F.lit(1).cast("long").alias("times"))
    point = statistic(weighted_pairs(rows, whole)).agg(F.max("value").alias("estimate"))
    clusters = rows.agg(F.count_distinct("cluster").alias("clusters"))
    drawn = statistic(weighted_pairs(rows, drawn_times(rows, samples, seed)))
    finite = F.when(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    spread = drawn.agg(F.array_sort(F.array_compact(F.array_agg(finite))).alias("all"))
    valid = F.size("all")
    failed = ((F.lit(samples) - valid) / F.lit(samples) > most_degenerate) | (valid / F.lit(samples) < least_valid)
    at = lambda p: F.when(~failed, F.get("all", F.floor(p * (valid - 1)).cast("int")))
    one = point.join(F.broadcast(clusters)).join(F.broadcast(spread))  # one row each
    return one.select("estimate", "clusters", at(0.025).alias("ci_low"), at(0.975).alias("ci_high"), (F.lit(samples) - valid).cast("long").alias("degenerate"), failed.alias("fail_closed"))


def leave_one_out(rows: DataFrame, statistic: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(omitted, estimate, fail_closed): ``statistic`` without each cluster in turn, and on every row whether
    any estimate is missing. Other clusters' pairs are counted by their totals, as many rows as a cluster
    and different pairs."""
    names = rows.select(F.col("cluster").alias("omitted")).distinct()
    kept = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("cluster", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    own = kept.groupBy("cluster", "x", "y").agg(F.count("*").alias("n"))
    total = own.groupBy("x", "y").agg(F.sum("n").alias("all"))
    mine = own.withColumnsRenamed({"cluster": "sample", "x": "own_x", "y": "own_y"})
    spread = names.select(F.col("omitted").alias("sample")).join(total)  # clusters times different pairs: what the estimates are made of
    left = spread.join(mine, (spread["sample"] == mine["sample"]) & (F.col("x") == F.col("own_x")) & (F.col("y") == F.col("own_y")), "left")
    pairs = left.select(spread["sample"], "x", "y", (F.col("all") - F.coalesce("n", F.lit(0))).alias("w")).where("w > 0")
    found = statistic(pairs).select(F.col("sample").alias("omitted"), F.col("value").alias("estimate"))
    every = names.join(found, "omitted", "left")
    return every.withColumn("fail_closed", F.bool_or(F.col("estimate").isNull()).over(Window.partitionBy()))


def _centred_ranks(values: pd.Series) -> np.ndarray:
    ranks = values.rank(method="average").to_numpy(float)
    return ranks - ranks.mean()


def randomisation_test(rows: DataFrame, exact_limit: int = 100_000, samples: int = 2000, seed: int = 0) -> DataFrame:
    """One row: rank correlation of cluster means of (cluster, score, outcome) and its permutation p;
    exact for few clusters, else by draws with one added. The means are the distributed part; the
    permutations are one matrix product for each thousand of them, in one task over one row a cluster."""
    means = rows.groupBy("cluster").agg(F.avg("score").alias("x"), F.avg("outcome").alias("y"))

    def permute(group: pd.DataFrame) -> pd.DataFrame:
        group, n = group.sort_values("cluster"), len(group)
        result = lambda *row: pd.DataFrame([row], columns=["clusters", "rho", "p_value", "method"])
        x, y = _centred_ranks(group["x"]), _centred_ranks(group["y"])
        spread = math.sqrt((x @ x) * (y @ y))
        if not spread:
            return result(n, None, None, "degenerate")
        rho, exact, rng = float(x @ y) / spread, math.factorial(n) <= exact_limit, np.random.default_rng(seed)
        orders = itertools.permutations(range(n)) if exact else (rng.permutation(n) for _ in range(samples))
        tried = hits = 0
        while some := list(itertools.islice(orders, 1000)):
            hits += int((np.abs(y[np.array(some)] @ x) / spread >= abs(rho) - 1e-12).sum())
            tried += len(some)
        return result(n, rho, hits / tried, "exact") if exact else result(n, rho, (hits + 1) / (tried + 1), "drawn")

    return means.groupBy(F.lit("all")).applyInPandas(permute, "clusters bigint, rho double, p_value double, method string")
