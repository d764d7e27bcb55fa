"""Interaction effects of factorial scores: point estimates, resampling, shrinkage, ranking.

Observations have model_id, animal, mobile_object, relation and score in [0, 1].
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Variance floor of the shrinkage, interval probabilities.
VARIANCE_FLOOR = 1e-8
LOW, HIGH = 0.025, 0.975
PART_SCORES = 1 << 16  # distinct scores of a cell that one task draws from


def _clamped(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def interaction_estimate(observations: DataFrame, animal: str, mobile_object: str, relation: str, by: tuple[str, ...] = ("model_id",)) -> DataFrame:
    """Observed mean of the target cell, its additive expectation from the margins, their difference.

    One pass: margins are conditional means of one aggregate. Groups without the target are left out."""
    is_a, is_o, is_r = F.col("animal") == animal, F.col("mobile_object") == mobile_object, F.col("relation") == relation
    mean = lambda cond: F.avg(F.when(cond, F.col("score")))
    return (
        observations.groupBy(*by)
        .agg(
            mean(F.lit(True)).alias("_grand"), mean(is_a).alias("_a"), mean(is_o).alias("_o"), mean(is_r).alias("_r"),
            mean(is_a & is_o & is_r).alias("observed"), F.count_if(is_a & is_o & is_r).alias("replicates"),
        )
        .where(F.col("observed").isNotNull())
        .withColumn("expected", _clamped(F.col("_a") + F.col("_o") + F.col("_r") - 2 * F.col("_grand")))
        .withColumn("interaction", F.col("observed") - F.col("expected"))
        .drop("_grand", "_a", "_o", "_r")
    )


def _parted(counted: DataFrame, keys: list[str]) -> DataFrame:
    """``counted`` (keys, score, n) with the part of its cell that a score belongs to and the sizes of all
    parts in order; cells of few distinct scores are one part."""
    distinct = counted.groupBy(*keys).agg(F.count("*").alias("_scores"))
    part = F.when(F.col("_scores") > PART_SCORES, F.pmod(F.xxhash64("score"), F.ceil(F.col("_scores") / PART_SCORES))).otherwise(F.lit(0))
    parts = counted.join(distinct, keys).withColumn("part", part.cast("long")).drop("_scores")
    sizes = parts.groupBy(*keys, "part").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("sizes"))
    return parts.join(sizes, keys)


def interaction_bootstrap(observations: DataFrame, animal: str, mobile_object: str, relation: str, samples: int = 1000, seed: int = 0, cell: tuple[str, ...] = ("animal", "mobile_object", "relation")) -> DataFrame:
    """Standard error and percentile interval of each model's interaction when every cell's rows are
    drawn anew with replacement.

    Rows are first counted by (cell, score): a cell's draws are then multinomial counts of its distinct
    scores, and only their sums leave a task, one array a cell. A cell of very many distinct scores is
    split into parts; the draws that each part gets are multinomial themselves, drawn alike in each of
    its tasks. Generators are seeded by (seed, cell, part), so reruns agree."""
    keys = ["model_id", *cell]
    counted = observations.groupBy(*keys, "score").agg(F.count("*").alias("n"))
    schema = ", ".join([f"`{k}` {dict(observations.dtypes)[k]}" for k in keys] + ["n bigint", "totals array<double>"])

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("score", kind="stable")
        first, part = group.iloc[0], int(group["part"].iloc[0])
        name = "|".join([str(seed), *(str(first[k]) for k in keys)])
        rng = lambda text: np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")))
        sizes = np.array([s["n"] for s in first["sizes"]], np.int64)
        at = [s["part"] for s in first["sizes"]].index(part)
        draws = rng(name).multinomial(sizes.sum(), sizes / sizes.sum(), samples)[:, at]
        score, share = group["score"].to_numpy(float), group["n"].to_numpy(float) / group["n"].sum()
        own, totals, step = rng(f"{name}|{part}"), [], max(1, (1 << 22) // len(group))
        for lo in range(0, samples, step):
            totals.append(own.multinomial(draws[lo : lo + step], share) @ score)
        row = {k: [first[k]] for k in keys} | {"n": [int(group["n"].sum())], "totals": [np.concatenate(totals)]}
        return pd.DataFrame(row)

    drawn = _parted(counted, keys).groupBy(*keys, "part").applyInPandas(draw, schema)
    is_a, is_o, is_r = F.col("animal") == animal, F.col("mobile_object") == mobile_object, F.col("relation") == relation
    conditions = {"g": F.lit(True), "a": is_a, "o": is_o, "r": is_r, "t": is_a & is_o & is_r}
    each = drawn.select("model_id", "n", *[c.alias(f"in_{k}") for k, c in conditions.items()], F.posexplode("totals").alias("sample", "total"))
    sums = each.groupBy("model_id", "sample").agg(*[(F.sum(F.when(F.col(f"in_{k}"), F.col("total"))) / F.sum(F.when(F.col(f"in_{k}"), F.col("n")))).alias(k) for k in conditions])
    effect = sums.where("t is not null").select("model_id", (F.col("t") - _clamped(F.col("a") + F.col("o") + F.col("r") - 2 * F.col("g"))).alias("interaction"))
    spread = effect.groupBy("model_id").agg(F.stddev_pop("interaction").alias("standard_error"), F.array_sort(F.collect_list("interaction")).alias("_all"))
    at = lambda p: F.get("_all", F.floor(p * (F.size("_all") - 1)).cast("int"))
    return spread.select("model_id", "standard_error", at(LOW).alias("ci_low"), at(HIGH).alias("ci_high"), F.size("_all").cast("long").alias("samples"))


def shrink_interactions(estimates: DataFrame) -> DataFrame:
    """Random-effects shrinkage (DerSimonian-Laird) of (model_id, interaction, standard_error)."""
    every = Window.partitionBy()
    v = F.greatest(F.col("standard_error") * F.col("standard_error"), F.lit(VARIANCE_FLOOR))
    s = lambda x: F.sum(x).over(every)
    fixed = estimates.withColumn("_v", v).withColumn("_w", 1 / F.col("_v")).withColumn("_mean", s(F.col("_w") * F.col("interaction")) / s(F.col("_w")))
    q = s(F.col("_w") * F.pow(F.col("interaction") - F.col("_mean"), 2))
    c = s(F.col("_w")) - s(F.col("_w") * F.col("_w")) / s(F.col("_w"))
    tau2 = F.when(c > 0, F.greatest(F.lit(0.0), (q - (F.count("*").over(every) - 1)) / c)).otherwise(F.lit(0.0))
    random = fixed.withColumn("tau2", tau2).withColumn("_u", 1 / (F.col("_v") + F.col("tau2"))).withColumn("pooled", s(F.col("_u") * F.col("interaction")) / s(F.col("_u")))
    weight = F.col("tau2") / (F.col("tau2") + F.col("_v"))
    return random.select("model_id", "interaction", "pooled", "tau2", weight.alias("weight"), (weight * F.col("interaction") + (1 - weight) * F.col("pooled")).alias("shrunk"))


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function (Spark has no error function). Up to 6 from the mean its
    Taylor series, whose terms all have one sign; beyond, where it is below 1e-9, the tail's continued
    fraction. The absolute error is about 1e-15."""
    u = F.least(F.abs(x), F.lit(6.0))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(120)),
        F.struct(u.alias("term"), u.alias("sum")),
        lambda a, k: F.struct((a["term"] * u * u / (2 * k + 1)).alias("term"), (a["sum"] + a["term"] * u * u / (2 * k + 1)).alias("sum")),
        lambda a: a["sum"],
    )
    density = lambda v: F.exp(-v * v / 2) / math.sqrt(2 * math.pi)
    far = F.greatest(F.abs(x), F.lit(6.0))
    tail = density(far) / F.aggregate(F.sequence(F.lit(40), F.lit(1), F.lit(-1)), far, lambda a, k: far + k / a)
    upper = F.when(F.abs(x) <= 6, 0.5 + density(u) * series).otherwise(1 - tail)
    return F.when(x >= 0, upper).otherwise(F.when(F.abs(x) <= 6, 1 - upper).otherwise(tail))


def superiority_probabilities(estimates: DataFrame) -> DataFrame:
    """For each ordered pair of models the probability that the first one's effect is greater. One
    row a model: the pairs are those of a table of models, not of observations."""
    a = estimates.select(F.col("model_id").alias("model_a"), F.col("interaction").alias("xa"), F.col("standard_error").alias("sa"))
    b = estimates.select(F.col("model_id").alias("model_b"), F.col("interaction").alias("xb"), F.col("standard_error").alias("sb"))
    se, diff = F.sqrt(F.col("sa") * F.col("sa") + F.col("sb") * F.col("sb")), F.col("xa") - F.col("xb")
    certain = F.when(diff > 0, 1.0).when(diff < 0, 0.0).otherwise(0.5)
    return a.join(b, F.col("model_a") != F.col("model_b")).select("model_a", "model_b", F.when(se == 0, certain).otherwise(normal_cdf(diff / F.when(se > 0, se).otherwise(1.0))).alias("probability"))


def rank_with_uncertainty(estimates: DataFrame) -> DataFrame:
    """Ranks by falling interaction, of equal ones by rising standard error."""
    order = Window.orderBy(F.desc("interaction"), F.asc("standard_error"), F.asc("model_id"))
    return estimates.withColumn("rank", F.row_number().over(order))


def replicate_reliability(observations: DataFrame, cell: tuple[str, ...] = ("animal", "mobile_object", "relation")) -> DataFrame:
    """By model: mean variance within cells of several rows, variance of cell means, and the share of
    the latter in their sum (1 when both are 0)."""
    cells = observations.groupBy("model_id", *cell).agg(F.var_pop("score").alias("_v"), F.avg("score").alias("_m"), F.count("*").alias("_n"))
    both = cells.groupBy("model_id").agg(
        F.coalesce(F.avg(F.when(F.col("_n") > 1, F.col("_v"))), F.lit(0.0)).alias("within"), F.coalesce(F.var_pop("_m"), F.lit(0.0)).alias("between"), F.count("*").alias("cells"),
        F.count_if(F.col("_n") > 1).alias("replicated"),
    )
    total = F.col("within") + F.col("between")
    return both.withColumn("reliability", F.when(total == 0, F.lit(1.0)).otherwise(_clamped(F.col("between") / F.when(total != 0, total))))


def as_observations(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Order lines read as observations: return flag, priority, order status, line status, discount."""
    return lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_returnflag").alias("model_id"), F.col("o_orderpriority").alias("animal"), F.col("o_orderstatus").alias("mobile_object"), F.col("l_linestatus").alias("relation"),
        (F.col("l_discount") * 10).alias("score"), F.concat_ws("|", F.col("l_orderkey"), F.col("l_linenumber")).alias("observation_id"),
    )

