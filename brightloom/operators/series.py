"""Ordered observations: trends, timelines and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brightloom.operators.ordered import key_range, with_ahead


def metric_trends(observations: DataFrame) -> DataFrame:
    """By metric: count, first, last, mean and least-squares slope against the position 0 .. n - 1 in
    time order (null times first, ties by seq). Columns: metric, observed_at, seq, value."""
    is_text = dict(observations.dtypes)["observed_at"] == "string"  # ordered as text, which has no quantiles: one range
    at = F.lit(0) if is_text else key_range(observations, F.col("observed_at").cast("timestamp"))
    placed = with_ahead(observations, ["metric"], at, [F.col("observed_at").asc_nulls_first(), "seq"], {"_i": F.lit(1)}).withColumn("i", F.col("_i").cast("double"))
    slope = F.when(F.count("*") < 2, F.lit(0.0)).otherwise(F.regr_slope("value", "i"))
    return placed.groupBy("metric").agg(F.count("*").alias("n"), F.min_by("value", "i").alias("first_value"), F.max_by("value", "i").alias("last_value"), F.avg("value").alias("mean_value"), slope.alias("slope"))


def timeline_summary(observations: DataFrame, by: str, unknown: str = "unknown") -> DataFrame:
    """Rows, first and last time of each ``by`` (null: ``unknown``)."""
    return observations.groupBy(F.coalesce(F.col(by), F.lit(unknown)).alias(by)).agg(F.count("*").alias("n"), F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"))


def trajectory_metrics(events: DataFrame) -> DataFrame:
    """By episode of (episode, position, state_hash, score, error): first and last score, best gain,
    mean, regressions (below the score before), recoveries (back at the running best after a dip),
    repeated states and error rate. Null scores are skipped."""
    order = Window.partitionBy("episode").orderBy("position")
    scored = events.where(F.col("score").isNotNull())
    best = F.max("score").over(order.rowsBetween(Window.unboundedPreceding, -1))
    steps = scored.withColumn("_prev", F.lag("score").over(order)).withColumn("_best", best).withColumn("_below", F.coalesce(F.col("score") < F.col("_best"), F.lit(False)))
    steps = steps.withColumn("_was_below", F.coalesce(F.lag("_below").over(order), F.lit(False)))
    figures = steps.groupBy("episode").agg(
        F.min_by("score", "position").alias("initial_score"), F.max_by("score", "position").alias("final_score"), F.max("score").alias("best_score"), F.avg("score").alias("mean_score"),
        F.count_if(F.col("score") < F.col("_prev")).alias("regressions"), F.count_if(F.col("_was_below") & (F.col("score") >= F.col("_best"))).alias("recoveries"),
    )
    counts = events.groupBy("episode").agg(F.count("*").alias("n_events"), (F.count("*") - F.count_distinct("state_hash")).alias("repeated_states"), F.avg(F.col("error").isNotNull().cast("double")).alias("error_rate"))
    return counts.join(figures, "episode", "left").withColumn("improvement", F.col("final_score") - F.col("initial_score"))


def trajectory_utility(metrics: DataFrame, cost: str, alpha: float = 1.0, beta: float = 1.0, gamma: float = 1.0) -> DataFrame:
    """Final score plus alpha * improvement less beta * cost less gamma * regressions (null: 0)."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return metrics.withColumn("utility", zero("final_score") + alpha * zero("improvement") - beta * zero(cost) - gamma * zero("regressions"))


def sequence_scores(frames: DataFrame) -> DataFrame:
    """By sequence of frames (sequence, frame, a, b, c): mean and least frame score, and column means."""
    each = frames.withColumn("_s", (F.col("a") + F.col("b") + F.col("c")) / 3)
    return each.groupBy("sequence").agg(F.count("*").alias("frames"), F.avg("_s").alias("mean_score"), F.min("_s").alias("least_score"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("c").alias("mean_c"))


def numeric_annotations(observations: DataFrame, json: str = "annotations") -> DataFrame:
    """``observations`` without ``json`` and with (metric, value) of each member of that JSON object that
    is a number; booleans, texts and nested values are none."""
    raw = F.from_json(json, "map<string,variant>")
    each = observations.select("*", F.explode(raw).alias("metric", "_v"))
    return each.where(F.schema_of_variant("_v").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")).withColumn("value", F.to_json("_v").cast("double")).drop("_v", json)
