"""Agreement of raters and preferences between artifacts.

Ratings are (item, category), one row for each rating. Pairs within an item are counted from
category counts, never listed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the preference model: iterations, rate, ridge, logit limit.
ITERATIONS, RATE, RIDGE, CLIP = 1000, 0.05, 0.01, 40.0


def _by_item(ratings: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    counts = ratings.groupBy(*by, "item", "category").agg(F.count("*").alias("n"))
    items = counts.groupBy(*by, "item").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("equal"))
    return counts, items.withColumn("pairs", F.col("n") * (F.col("n") - 1) / 2)


def inter_rater_agreement(ratings: DataFrame) -> DataFrame:
    """One row: items with several ratings, rated items' pairs, observed and chance agreement, kappa.
    Chance agreement is from all ratings, also of items with a single one."""
    counts, items = _by_item(ratings, [])
    seen = items.where("n >= 2").agg(F.count("*").alias("items"), F.sum("pairs").alias("pairs"), (F.sum("equal") / F.sum("pairs")).alias("observed"))
    shares = counts.groupBy("category").agg(F.sum("n").alias("n"))
    total = shares.agg(F.sum("n").alias("ratings"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    expected = F.col("squares") / (F.col("ratings") * F.col("ratings"))
    kappa = F.when(expected == 1, F.lit(1.0)).otherwise((F.col("observed") - expected) / F.when(expected != 1, 1 - expected))
    return seen.join(F.broadcast(total)).select("items", F.col("pairs").cast("long").alias("pairs"), "ratings", "observed", expected.alias("expected"), kappa.alias("kappa"))


def nominal_alpha(ratings: DataFrame) -> DataFrame:
    """One row: nominal alpha over items with two ratings or more (null without such items)."""
    counts, items = _by_item(ratings, [])
    several = items.where("n >= 2")
    pairs = several.agg((1 - F.sum("equal") / F.sum("pairs")).alias("disagreement"), F.sum("n").alias("total"))
    categories = counts.join(several.select("item"), "item", "left_semi").groupBy("category").agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("equal"))
    expected = 1 - F.col("equal") / (F.col("total") * (F.col("total") - 1))
    alpha = F.when(expected == 0, F.when(F.col("disagreement") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.col("disagreement") / F.when(expected != 0, expected))
    return pairs.join(F.broadcast(categories)).select(F.col("total").alias("ratings"), "disagreement", expected.alias("expected"), alpha.alias("alpha"))


def agreement_figures(ratings: DataFrame, by: list[str]) -> DataFrame:
    """By ``by``: the share of equal pairs within items (consistency) and nominal alpha, null without an
    item of two ratings."""
    counts, items = _by_item(ratings, by)
    several = items.where("n >= 2")
    pairs = several.groupBy(*by).agg(F.sum("equal").alias("equal"), F.sum("pairs").alias("pairs"), F.sum("n").alias("total"))
    categories = counts.join(several.select(*by, "item"), [*by, "item"], "left_semi").groupBy(*by, "category").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    both = pairs.join(categories, by).withColumn("consistency", F.col("equal") / F.col("pairs")).withColumn("expected", 1 - F.col("same") / (F.col("total") * (F.col("total") - 1)))
    observed = 1 - F.col("consistency")
    alpha = F.when(F.col("expected") == 0, F.when(observed == 0, 1.0).otherwise(0.0)).otherwise(1 - observed / F.when(F.col("expected") != 0, F.col("expected")))
    return both.select(*by, "consistency", alpha.alias("alpha"))


def label_disagreements(ratings: DataFrame, least_share: float = 2 / 3) -> DataFrame:
    """Items of several ratings whose most frequent category has less than ``least_share`` of them."""
    counts = ratings.groupBy("item", "category").agg(F.count("*").alias("n"))
    items = counts.groupBy("item").agg(F.sum("n").alias("ratings"), (F.max("n") / F.sum("n")).alias("modal_share"), F.count("*").alias("categories"))
    return items.where((F.col("ratings") >= 2) & (F.col("modal_share") < least_share))


def rating_ranges(ratings: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Items (item, rating) of several ratings that lie ``threshold`` or more apart."""
    items = ratings.groupBy("item").agg(F.count("*").alias("ratings"), (F.max("rating") - F.min("rating")).alias("rating_range"))
    return items.where((F.col("ratings") >= 2) & (F.col("rating_range") >= threshold))


def duplicate_consistency(ratings: DataFrame) -> DataFrame:
    """One row: the share of equal pairs within items (null without a pair)."""
    _, items = _by_item(ratings, [])
    return items.agg(F.sum("pairs").cast("long").alias("pairs"), (F.sum("equal") / F.when(F.sum("pairs") > 0, F.sum("pairs"))).alias("consistency"))


def duplicate_exact_consistency(ratings: DataFrame, fields: list[str]) -> DataFrame:
    """One row: repeated ratings (row_id, duplicate_of) with their original, how many of them agree with it
    in all ``fields`` (null equals null), and their share. A repeat without its original is an error."""
    base = ratings.where("duplicate_of is null").select(F.col("row_id").alias("_base"), *[F.col(f).alias(f"_{f}") for f in fields])
    pairs = ratings.where("duplicate_of is not null").join(base, F.col("duplicate_of") == F.col("_base"), "left")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    lost = F.raise_error(F.concat(F.lit("no rating "), F.col("duplicate_of").cast("string"))).cast("boolean")
    checked = pairs.select(F.when(F.col("_base").isNull(), lost).otherwise(same).alias("same"))
    return checked.agg(F.count("*").alias("pairs"), F.count_if("same").alias("exact_agreements"), F.try_divide(F.count_if("same"), F.count("*")).alias("consistency"))


def winner_counts(votes: DataFrame) -> DataFrame:
    """Votes by criterion and winner, as written."""
    return votes.groupBy("criterion", "winner").agg(F.count("*").alias("votes"))


def _fit(counted: pd.DataFrame) -> pd.DataFrame:
    names = np.array(sorted({*counted["left"], *counted["right"]}))
    a, b = (np.searchsorted(names, counted[side].to_numpy()) for side in ("left", "right"))
    outcome, n = counted["winner"].map({"left": 1.0, "right": 0.0}).fillna(0.5).to_numpy(), counted["n"].to_numpy(float)
    score = np.zeros(len(names))
    for _ in range(ITERATIONS):
        pull = n * (outcome - 1 / (1 + np.exp(-np.clip(score[a] - score[b], -CLIP, CLIP))))
        gradient = np.bincount(a, pull, len(names)) - np.bincount(b, pull, len(names)) - RIDGE * score
        score = score + RATE * gradient / n.sum()
        score = score - score.mean()
    return pd.DataFrame({"criterion": counted["criterion"].iloc[0], "name": names, "score": score})


def fit_preferences(votes: DataFrame) -> DataFrame:
    """Bradley-Terry scores by criterion. Votes (criterion, left, right, winner) are first counted, so
    the group that iterates has a row for each pair and outcome, however many votes there are."""
    counted = votes.groupBy("criterion", "left", "right", "winner").agg(F.count("*").alias("n"))
    return counted.groupBy("criterion").applyInPandas(_fit, "criterion string, name string, score double")


def probability_superior(left, right):
    """Probability that the left one wins, from scores."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), left - right))))
