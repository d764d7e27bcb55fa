"""Closed forms of study design, as column expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def z_value(confidence: float) -> float:
    """The two-sided normal quantile."""
    return NormalDist().inv_cdf(0.5 + confidence / 2)


def wilson_interval(successes: Column, total: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a proportion."""
    z, n = z_value(confidence), total.cast("double")
    p = successes / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    radius = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return F.greatest(F.lit(0.0), centre - radius), F.least(F.lit(1.0), centre + radius)


def design_effect(cluster_size: Column, correlation: Column) -> Column:
    """Variance inflation of clusters."""
    return 1 + (cluster_size - 1) * correlation


def effective_sample_size(total: Column, cluster_size: Column, correlation: Column) -> Column:
    """Independent rows that clustered ones are worth."""
    return total / design_effect(cluster_size, correlation)


def detectable_difference(per_group: Column, baseline: float = 0.5, confidence: float = 0.95, power: float = 0.8) -> Column:
    """Least difference of two proportions that a study of this size finds."""
    factor = (z_value(confidence) + NormalDist().inv_cdf(power)) * math.sqrt(2 * baseline * (1 - baseline))
    return F.least(F.lit(1.0), factor / F.sqrt(per_group))


def majority_probability(votes: int, better: Column) -> Column:
    """Probability that most of ``votes`` are for the better one; ties count half."""
    total = F.lit(0.0)
    for k in range((votes + 1) // 2, votes + 1):
        share = 0.5 if 2 * k == votes else 1.0
        total = total + share * math.comb(votes, k) * F.pow(better, F.lit(k)) * F.pow(1 - better, F.lit(votes - k))
    return total


def required_raters(reliability: Column, target: float = 0.8) -> Column:
    """Raters whose mean reaches the target reliability."""
    needed = target * (1 - reliability) / (reliability * (1 - target))
    return F.greatest(F.lit(1), F.ceil(needed - 1e-12)).cast("long")


def assumed_power(replicates: Column) -> Column:
    """The planning table's power by replicates: a fixed line, not a simulation."""
    return F.least(F.lit(0.99), 0.55 + 0.07 * replicates)


def question_rows(animal_features: Column, vehicle_features: Column, relations: Column) -> Column:
    """The questions of a task: array of (question_id, dimension, critical, depends_on)."""
    kind = "array<struct<question_id:string,dimension:string,critical:boolean,depends_on:string>>"

    def one(question: Column, dimension: str, critical: Column, depends: str | None) -> Column:
        return F.struct(question.alias("question_id"), F.lit(dimension).alias("dimension"), critical.alias("critical"), F.lit(depends).cast("string").alias("depends_on"))

    prefixed = lambda p, x: F.concat(F.lit(p), x)
    return F.concat(
        F.array(one(F.lit("animal-present"), "animal_anatomy", F.lit(True), None), one(F.lit("object-present"), "vehicle_mechanics", F.lit(True), None)).cast(kind),
        F.transform(animal_features, lambda f: one(prefixed("animal-feature:", f), "animal_anatomy", F.lit(False), "animal-present")).cast(kind),
        F.transform(vehicle_features, lambda f: one(prefixed("object-feature:", f), "vehicle_mechanics", F.lit(False), "object-present")).cast(kind),
        F.transform(relations, lambda r: one(prefixed("relation:", r["predicate"]), "interaction", r["required"], "object-present")).cast(kind),
        F.array(one(F.lit("scene-coherent"), "composition", F.lit(False), None)).cast(kind),
    )
