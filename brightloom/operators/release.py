"""Release gates: sealed challenges, and readiness from claims, evidence and blockers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.operators.integrity import rows_commitment

# Levels of evidence, least first; states in which a claim or a blocker still stands open.
LEVELS = ("E0", "E1", "E2", "E3", "E4", "E5")
UNPROVEN, OPEN = ("planned", "blocked", "reopened"), ("planned", "partial", "blocked", "reopened")


def salted(task: Column, position: Column, release: str, secret: str) -> tuple[Column, Column]:
    """(salt, commitment) of a challenge's task, a canonical text, at a position: the salt comes from the
    secret, so a commitment tells nothing of its task."""
    digest = lambda *parts: F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256)
    salt = digest(F.lit(release), F.lit(secret), position.cast("string"))
    return salt, digest(salt, task)


def sealed(tasks: DataFrame, release: str, secret: str) -> DataFrame:
    """(position, task, salt, commitment) of ``tasks`` (position, task): the public part is (position, commitment),
    the rest is revealed later."""
    salt, commitment = salted(F.col("task"), F.col("position"), release, secret)
    return tasks.select("position", "task", salt.alias("salt"), commitment.alias("commitment"))


def reveal_findings(public: DataFrame, reveals: DataFrame, whole: bool = False) -> DataFrame:
    """(position, finding) of ``reveals`` (position, task, salt) against ``public`` (position, commitment): a task
    that was not committed at all, one that was committed at another place, one revealed twice, and, if the
    ``whole`` is to be revealed, commitments without a task."""
    opened = reveals.select("position", F.sha2(F.concat_ws("\x1f", "salt", "task").cast("binary"), 256).alias("own"))
    listed = public.select(F.col("position").alias("at"), "commitment")
    places = listed.groupBy("commitment").agg(F.count("*").alias("places"))
    met = opened.join(listed, F.col("position") == F.col("at"), "left").join(places.withColumnRenamed("commitment", "own"), "own", "left")
    right = F.coalesce(F.col("own") == F.col("commitment"), F.lit(False))
    wrong = met.select("position", F.when(F.col("places").isNull(), "never-committed").when(~right, "committed-elsewhere").alias("finding")).where("finding is not null")
    twice = reveals.groupBy("position").agg(F.count("*").alias("n")).where("n > 1").select("position", F.lit("revealed-twice").alias("finding"))
    out = wrong.union(twice)
    if whole:
        out = out.union(listed.join(opened.select(F.col("position").alias("at")), "at", "left_anti").select(F.col("at").alias("position"), F.lit("not-revealed").alias("finding")))
    return out


def challenge_verification(public: DataFrame, reveals: DataFrame, whole: bool = False) -> DataFrame:
    """One row: committed, revealed, wrong (findings), valid, full (all places are revealed as committed) and
    commitment, one hash of all places and commitments in whatever order they arrive."""
    found = reveal_findings(public, reveals, True).agg(F.count_if(F.col("finding") != "not-revealed").alias("wrong"), F.count("*").alias("open"))
    counts = public.agg(F.count("*").alias("committed")).join(reveals.agg(F.count("*").alias("revealed"))).join(found).join(rows_commitment(public, ["position", "commitment"]).select("commitment"))
    valid = (F.col("wrong") == 0) & ((F.col("open") == 0) | F.lit(not whole))
    return counts.select("committed", "revealed", "wrong", valid.alias("valid"), (F.col("open") == 0).alias("full"), "commitment")


def _level(name: Column) -> Column:
    """The place of a level of evidence; null for one that is not known."""
    at = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), name)
    return F.when(at > 0, at - 1)


def claim_results(required: DataFrame, claims: DataFrame, evidence: DataFrame, artifacts: DataFrame) -> DataFrame:
    """For each claim that a profile requires (profile, claim_id, least_level): missing_evidence, level,
    error (an unknown claim or level; null if none) and satisfied. ``claims`` (claim_id, level, status),
    ``evidence`` (subject, path), ``artifacts`` (path). What is not stated fails: a claim without a level has the
    lowest, one without a status is planned, and evidence that is no artifact is missing."""
    missing = evidence.join(artifacts.select("path").distinct(), "path", "left_anti").groupBy("subject").agg(F.count_distinct("path").alias("missing"))
    met = required.join(claims, "claim_id", "left").join(missing.withColumnRenamed("subject", "claim_id"), "claim_id", "left")
    level, least = _level(F.coalesce("level", F.lit(LEVELS[0]))), _level(F.col("least_level"))
    known = claims.select("claim_id", F.lit(True).alias("known")).distinct()
    met = met.join(known, "claim_id", "left")
    error = F.when(F.col("known").isNull(), "unknown-claim").when(least.isNull(), "unknown-profile-level").when(level.isNull(), "unknown-level")
    absent = F.coalesce("missing", F.lit(0))
    good = error.isNull() & (F.coalesce(level, F.lit(0)) >= least) & (absent == 0) & ~F.coalesce("status", F.lit(UNPROVEN[0])).isin(*UNPROVEN)
    return met.select("profile", "claim_id", absent.alias("missing_evidence"), F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (F.coalesce(level, F.lit(0)) + 1).cast("int")).alias("level"), error.alias("error"), F.coalesce(good, F.lit(False)).alias("satisfied"))


def blocker_results(blockers: DataFrame, criteria: DataFrame, evidence: DataFrame, artifacts: DataFrame) -> DataFrame:
    """For each blocker (blocker_id, status, profiles) and profile that it is for (null without any): open_criteria,
    missing_evidence and blocks. ``criteria`` (blocker_id, criterion_id, status): one that is not complete is open;
    ``evidence`` (subject, path) of blockers and criteria."""
    lacking = evidence.join(artifacts.select("path").distinct(), "path", "left_anti").select("subject", "path")
    of_criteria = criteria.select("blocker_id", F.col("criterion_id").alias("subject"))
    of_both = blockers.select("blocker_id", F.col("blocker_id").alias("subject")).union(of_criteria).distinct()
    missing = of_both.join(lacking, "subject").groupBy("blocker_id").agg(F.count_distinct("path").alias("missing"))
    left = criteria.groupBy("blocker_id").agg(F.count_if(F.coalesce("status", F.lit("planned")) != "complete").alias("left"))
    each = blockers.select("blocker_id", F.coalesce("status", F.lit("planned")).alias("status"), F.explode_outer(F.array_distinct("profiles")).alias("profile"))
    met = each.join(missing, "blocker_id", "left").join(left, "blocker_id", "left").fillna(0, ["missing", "left"])
    return met.select("profile", "blocker_id", F.col("left").alias("open_criteria"), F.col("missing").alias("missing_evidence"), (F.col("status").isin(*OPEN) | (F.col("left") > 0)).alias("blocks"))


def readiness(claim_rows: DataFrame, blocker_rows: DataFrame) -> DataFrame:
    """By profile: claims, satisfied, errors, blocking, lacking and ready: no error, all claims satisfied, no
    blocker of the profile that stands open, and none of any profile that lacks evidence (lacking). A profile
    without a claim is not ready."""
    claims = claim_rows.groupBy("profile").agg(F.count("*").alias("claims"), F.count_if("satisfied").alias("satisfied"), F.count("error").alias("errors"))
    blocked = blocker_rows.where("profile is not null").groupBy("profile").agg(F.count_if("blocks").alias("blocking"))
    lacking = blocker_rows.agg(F.count_distinct(F.when(F.col("missing_evidence") > 0, F.col("blocker_id"))).alias("lacking"))
    out = claims.join(blocked, "profile", "full_outer").fillna(0, ["claims", "satisfied", "errors", "blocking"]).join(F.broadcast(lacking))  # one row
    ready = (F.col("claims") > 0) & (F.col("satisfied") == F.col("claims")) & (F.col("errors") == 0) & (F.col("blocking") == 0) & (F.col("lacking") == 0)
    return out.withColumn("ready", ready)
