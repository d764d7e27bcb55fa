"""Qualification of models and judges, registries, panels. Planned cells stay in the denominator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions.draws import stable_id


def qualification(plan: DataFrame, outcomes: DataFrame, by: str, flags: list[str], gates: dict[str, float]) -> DataFrame:
    """By ``by``: planned and observed cells, each flag's rate over planned cells, whether all gates
    (least rates) hold. A planned cell without an outcome counts as false."""
    cells = plan.select("cell_id", by).join(outcomes.select("cell_id", F.lit(True).alias("_seen"), *flags), "cell_id", "left")
    rate = lambda f: F.count_if(F.coalesce(F.col(f), F.lit(False))) / F.count("*")
    out = cells.groupBy(by).agg(F.count("*").alias("planned"), F.count_if(F.col("_seen").isNotNull()).alias("observed"), *[rate(f).alias(f"{f}_rate") for f in flags])
    passed = F.lit(True)
    for f, least in gates.items():
        passed = passed & (F.col(f"{f}_rate") >= least)
    return out.withColumn("qualified", passed)


def unknown_cells(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes of cells that were never planned."""
    return outcomes.join(plan.select("cell_id"), "cell_id", "left_anti")


def judge_panel(observations: DataFrame, least_agreement: float) -> DataFrame:
    """By judge: mean human agreement and whether all checks hold and nothing leaked."""
    return observations.groupBy("judge_id").agg(
        F.count("*").alias("n"), F.avg("human_agreement").alias("mean_agreement"), F.bool_and("schema_valid").alias("schema_valid"), F.bool_or("prompt_leakage").alias("prompt_leakage"),
        (F.bool_and("schema_valid") & ~F.bool_or("prompt_leakage") & (F.avg("human_agreement") >= least_agreement)).alias("passes"),
    )


def weighted_answers(answers: DataFrame, weights: DataFrame) -> DataFrame:
    """By question: the weighted mean of judges' probabilities; judges' families without a weight count 1. Weights
    that sum to 0 or less are an error when their row is read."""
    w = F.coalesce("weight", F.lit(1.0))
    total = F.sum(w)
    mean = F.when(total > 0, F.sum(F.col("probability") * w) / F.when(total > 0, total)).otherwise(F.raise_error(F.lit("judge weights must sum to a positive value")).cast("double"))
    return answers.join(weights, "family", "left").groupBy("question_id").agg(mean.alias("probability"), F.count("*").alias("judges"))


# What lets a model take part.
USABLE_STATUSES, USABLE_LICENCES, UNRESOLVED = ("eligible", "reviewed"), ("eligible", "reviewed", "open"), "unresolved"


def eligibility(registry: DataFrame) -> DataFrame:
    """``registry`` (status, revision, remote_code_required, license_status, ...) with blockers, the reasons
    against each model in this order: its status, a revision that is not resolved, code that would have to be
    fetched, its licence. What is not stated counts as unknown, and blocks."""
    named = lambda kind, column, usable: F.when(~F.coalesce(F.col(column).isin(*usable), F.lit(False)), F.concat(F.lit(f"{kind}:"), F.coalesce(F.col(column), F.lit("unknown"))))
    pinned = F.coalesce(~F.startswith("revision", F.lit(UNRESOLVED)), F.lit(False))
    reasons = F.array(
        named("status", "status", USABLE_STATUSES), F.when(~pinned, "revision-unresolved"),
        F.when(F.coalesce(F.col("remote_code_required"), F.lit(True)), "remote-code-required"), named("license", "license_status", USABLE_LICENCES),
    )
    return registry.withColumn("blockers", F.array_compact(reasons))


def eligible_models(registry: DataFrame, track: str) -> DataFrame:
    """Models of a track without a blocker."""
    return eligibility(registry).where((F.size("blockers") == 0) & F.array_contains("tracks", track))


def status_counts(records: DataFrame, column: str, statuses: list[str]) -> DataFrame:
    """Records by status, zero where there are none."""
    listed = records.sparkSession.createDataFrame([(s,) for s in statuses], f"{column} string")
    return listed.join(records.groupBy(column).agg(F.count("*").alias("n")), column, "left").fillna(0, ["n"])


def stopping_gates(metrics: DataFrame, least: dict[str, float]) -> DataFrame:
    """One row: each gate, and whether all hold. A missing metric fails its gate."""
    gates = {name: F.coalesce(F.col(name) >= value, F.lit(False)) for name, value in least.items()}
    stop = F.lit(bool(least))
    for gate in gates.values():
        stop = stop & gate
    return metrics.select(*[g.alias(f"{name}_met") for name, g in gates.items()], stop.alias("may_stop"))


def judge_plan(judges: DataFrame, canaries: DataFrame) -> DataFrame:
    """A cell for each judge (judge_id, family, roles), role and canary (canary_id, artifact_id,
    applicable_roles) to which the role applies, with a stable id."""
    cells = judges.select("judge_id", "family", F.explode("roles").alias("role")).join(
        canaries.select("canary_id", "artifact_id", F.explode(F.array_distinct("applicable_roles")).alias("role")), "role"
    )
    return cells.select(stable_id("JCEL", 20, F.col("judge_id"), F.col("role"), F.col("canary_id")).alias("cell_id"), "judge_id", "family", "role", "canary_id", "artifact_id")


def judge_diversity(judges: DataFrame, minimums: DataFrame) -> DataFrame:
    """By role of ``minimums`` (role, minimum): how many families of judges take it, and whether that is
    enough."""
    families = judges.select("family", F.explode("roles").alias("role")).groupBy("role").agg(F.count_distinct("family").alias("families"))
    return minimums.join(families, "role", "left").fillna(0, ["families"]).withColumn("satisfied", F.col("families") >= F.col("minimum"))


def runtime_profiles(models: DataFrame, profiles: DataFrame) -> DataFrame:
    """``models`` (model_id) with the profile that lists them (profile_id, model_ids); null without one.
    A model that several profiles list is an error when its row is read."""
    listed = profiles.select("profile_id", F.explode(F.array_distinct("model_ids")).alias("model_id"))
    found = listed.groupBy("model_id").agg(F.min("profile_id").alias("profile_id"), F.count("*").alias("_n"))
    several = F.raise_error(F.concat(F.lit("several profiles list "), F.col("model_id")))
    return models.join(found, "model_id", "left").withColumn("profile_id", F.when(F.col("_n") > 1, several).otherwise(F.col("profile_id"))).drop("_n")


def reviewable(records: DataFrame, min_confidence: float) -> DataFrame:
    """Machine-proposed records (review_status, confidence) that are sure enough for review. None is ever
    promoted without a reviewer."""
    return records.where((F.col("review_status") == "machine-proposed") & (F.col("confidence") >= min_confidence))


def replicate_wave(models: int, tasks: int, current: int, target: int) -> tuple[int, int]:
    """(replicates to add, cells to add) to come from ``current`` to ``target`` replicates."""
    if target <= current:
        raise ValueError("the target must exceed the current replicates")
    return target - current, models * tasks * (target - current)
