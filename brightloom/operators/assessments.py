"""Assessments of renders: questions of tasks, answers of judges, ensembles and what is wrong with them.

Tasks: task_id, animal_features, object_features (arrays of names), relations (array of predicate, required)
and render_hash, the hash of the one render that may be assessed. Answers: task_id, render_hash, question_id,
judge_id, judge_revision, probability, source_independent.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brightloom.functions.closed_forms import question_rows

ANSWER = "judge_id string, judge_revision string, probability double, rationale string"
# The form of an assessment's name.
PREFIX, LENGTH = "sem:", 24


def task_questions(tasks: DataFrame) -> DataFrame:
    """(task_id, render_hash, question_id, dimension, critical, depends_on): each question of each task."""
    asked = tasks.select("task_id", "render_hash", F.explode(question_rows(F.col("animal_features"), F.col("object_features"), F.col("relations"))).alias("q"))
    return asked.select("task_id", "render_hash", "q.*")


def judge(answer: Callable[[bytes, str], tuple[float, str]], judge_id: str, revision: str):
    """A table function of (image, question_id) that gives one row ``ANSWER`` of a judge. ``answer`` sees the
    image's bytes and the question only, never a source. A judge that breaks down, or whose probability is
    none, gives a row without a probability and with the reason."""

    class Judge:
        def eval(self, image: bytes, question_id: str) -> Iterator[tuple]:
            try:
                probability, why = answer(image, question_id)
                if not 0.0 <= float(probability) <= 1.0 or math.isnan(probability):
                    raise ValueError(f"probability {probability} is not within 0 and 1")
                yield judge_id, revision, float(probability), why
            except Exception as broken:  # noqa: BLE001  whatever a judge does, its row says so and the job goes on
                yield judge_id, revision, None, f"{type(broken).__name__}: {broken}"

    return F.udtf(Judge, returnType=ANSWER)


def ask(questions: DataFrame, renders: DataFrame, judges: list) -> DataFrame:
    """``questions`` (task_id, render_hash, question_id, ...) with the answers of each of ``judges`` to each, by a
    lateral join: they see the image (render_hash, image) that the question is bound to. A judge named twice
    is asked once."""
    seen = questions.join(renders.select("render_hash", "image"), "render_hash")
    asked = [seen.lateralJoin(one(F.col("image").outer(), F.col("question_id").outer())) for one in judges]
    out = asked[0]
    for more in asked[1:]:
        out = out.union(more)
    return out.drop("image").dropDuplicates(["task_id", "render_hash", "question_id", "judge_id", "judge_revision"])


def answer_findings(answers: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, judge_id, question_id, finding): answers to unknown tasks or questions, repeated ones, ones
    without a probability from 0 to 1, of another render, that saw a source; and critical questions that a
    judge who answered a task left out."""
    asked = task_questions(tasks).select("task_id", "question_id", "critical", F.lit(True).alias("asked"))
    bound = tasks.select("task_id", F.col("render_hash").alias("bound_to"), F.lit(True).alias("known"))
    nth = F.row_number().over(Window.partitionBy("task_id", "judge_id", "judge_revision", "question_id").orderBy("render_hash", "probability"))
    met = answers.withColumn("nth", nth).join(bound, "task_id", "left").join(asked, ["task_id", "question_id"], "left")
    known = F.col("known").isNotNull()
    findings = F.array(
        F.when(~known, "unknown-task"), F.when(known & F.col("asked").isNull(), "unknown-question"), F.when(F.col("nth") > 1, "repeated-question"),
        F.when(~F.coalesce(F.col("probability").between(0.0, 1.0), F.lit(False)), "no-probability"), F.when(known & ~F.col("render_hash").eqNullSafe(F.col("bound_to")), "other-render"),
        F.when(~F.coalesce("source_independent", F.lit(False)), "saw-the-source"),
    )
    own = met.select("task_id", "judge_id", "question_id", F.explode(F.array_compact(findings)).alias("finding"))
    who = answers.select("task_id", "judge_id", "judge_revision").distinct()
    due = who.join(asked.where("critical").select("task_id", "question_id"), "task_id")
    missing = due.join(answers.select("task_id", "judge_id", "judge_revision", "question_id"), ["task_id", "judge_id", "judge_revision", "question_id"], "left_anti")
    return own.union(missing.select("task_id", "judge_id", "question_id", F.lit("critical-question-missing").alias("finding")))


def ensembles(answers: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(task_id, render_hash, question_id, probability, judges, spread): the weighted mean of the judges'
    probabilities; ``weights`` (judge_id, weight), 1 for others. Weights that sum to 0 or less are an error
    when their row is read."""
    said = answers.where("probability is not null")
    weighted = said.join(weights, "judge_id", "left") if weights is not None else said.withColumn("weight", F.lit(1.0))
    w = F.coalesce("weight", F.lit(1.0))
    total = F.sum(w)
    mean = F.when(total <= 0, F.raise_error(F.lit("judge weights must sum to a positive value")).cast("double")).otherwise(F.sum(F.col("probability") * w) / F.when(total > 0, total))
    return weighted.groupBy("task_id", "render_hash", "question_id").agg(mean.alias("probability"), F.count("*").alias("judges"), (F.max("probability") - F.min("probability")).alias("spread"))


def _stated(number: Column) -> Column:
    return F.round(number * 1_000_000).cast("long").cast("string")


def assessments(agreed: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row a task and render: task_id, render_hash, answers (question_id to probability), complete (all
    critical questions are answered, of the render that the task is bound to) and assessment_id, the
    beginning of a hash of what it states. A task's questions are few; they are put in order for the hash."""
    asked = task_questions(tasks).select("task_id", F.col("render_hash").alias("bound_to"), "question_id", "critical")
    due = asked.groupBy("task_id", "bound_to").agg(F.count_if("critical").alias("due"))
    known = agreed.join(asked.select("task_id", "question_id", "critical"), ["task_id", "question_id"])
    row = F.struct("question_id", F.round("probability", 6).alias("probability"))
    each = known.groupBy("task_id", "render_hash").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.count_if("critical").alias("answered"))
    stated = F.array_join(F.transform("rows", lambda r: F.concat_ws("=", r["question_id"], _stated(r["probability"]))), ";")
    name = F.concat(F.lit(PREFIX), F.substring(F.sha2(F.concat_ws("\x1f", "task_id", "render_hash", stated).cast("binary"), 256), 1, LENGTH))
    whole = (F.col("answered") == F.col("due")) & F.col("render_hash").eqNullSafe(F.col("bound_to"))
    return each.join(due, "task_id").select("task_id", "render_hash", F.map_from_entries("rows").alias("answers"), whole.alias("complete"), name.alias("assessment_id"))
