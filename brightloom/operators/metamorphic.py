"""Scorer challenges: a source that is changed without its drawing must not score better.

Each changed source's scorecard is joined with that of the source it was made from; a rule says what of the
two must agree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions import mutations
from brightloom.operators.scorecard import WEIGHTS

# The dimensions that are about what a drawing shows, not how its source is written.
SEMANTIC = ("animal_anatomy", "vehicle_mechanics", "interaction", "instruction_coverage")


@dataclass(frozen=True)
class Rule:
    """A change of the source, and whether the whole score has to stay (else only the semantic
    dimensions, and the aggregate must not rise). The render has to stay in any case."""

    challenge_id: str
    change: Callable[[Column], Column]
    whole_score: bool


RULES = (
    Rule("labels-stripped", mutations.stripped_labels, True), Rule("labels-renamed", mutations.renamed_labels, True), Rule("comment-added", mutations.commented, True),
    Rule("unseen-label-added", mutations.with_unseen_label, False), Rule("far-label-added", mutations.with_far_label, False),
)


def challenged(sources: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(artifact_id, challenge_id, source) of each source (artifact_id, source) under each rule's change."""
    changes = F.array(*[F.struct(F.lit(r.challenge_id).alias("challenge_id"), r.change(F.col("source")).alias("source")) for r in rules])
    return sources.select("artifact_id", F.explode(changes).alias("x")).select("artifact_id", "x.*")


def challenge_outcomes(baseline: DataFrame, changed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(artifact_id, challenge_id, failures, passed): for every scorecard of ``baseline`` (artifact_id, render_hash,
    the dimensions, valid, aggregate) and every rule, what its twin in ``changed`` (and challenge_id) breaks. A
    baseline that is not valid, and a twin that is missing or stands there twice, fail. Twins are brought together
    by artifact, so neither side is dealt out for each rule; where both come dealt by artifact_id, they stay there."""
    figures = [*WEIGHTS, "valid", "aggregate", "render_hash"]
    a = baseline.select("artifact_id", F.struct(*figures).alias("a"))
    of = lambda r: F.col("challenge_id") == r.challenge_id
    b = changed.groupBy("artifact_id").agg(*[F.struct(F.count_if(of(r)).alias("twins"), F.min(F.when(of(r), F.struct(*figures))).alias("b")).alias(f"_{k}") for k, r in enumerate(rules)])
    asked = F.array(*[F.struct(F.lit(r.challenge_id).alias("challenge_id"), F.lit(r.whole_score).alias("whole_score"), F.col(f"_{k}.twins").alias("twins"), F.col(f"_{k}.b").alias("b")) for k, r in enumerate(rules)])
    met = a.join(b, "artifact_id", "left").select("artifact_id", "a", F.explode(asked).alias("x")).select("artifact_id", "a", "x.*")
    same = lambda names: F.forall(F.array(*[F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names]), lambda ok: ok)
    twin = F.coalesce("twins", F.lit(0)) > 0
    failures = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("a.valid"), F.lit(False)), "baseline-not-valid"), F.when(~twin, "not-scored"), F.when(F.col("twins") > 1, "scored-twice"),
        F.when(twin & ~F.coalesce(F.col("a.render_hash") == F.col("b.render_hash"), F.lit(False)), "render-changed"), F.when(twin & ~same(SEMANTIC), "semantic-dimensions-changed"),
        F.when(twin & F.col("whole_score") & ~same([*WEIGHTS, "valid", "aggregate"]), "score-changed"), F.when(twin & ~F.coalesce(F.col("b.aggregate") <= F.col("a.aggregate"), F.lit(False)), "aggregate-improved"),
    ))
    return met.select("artifact_id", "challenge_id", failures.alias("failures"), (F.size(failures) == 0).alias("passed"))


def challenge_report(outcomes: DataFrame) -> DataFrame:
    """By challenge: artifacts, how many passed, and each failure's count as a map (null without failures). The
    outcomes are read once: failures that stand together are counted together, and there are few such sets."""
    sets = outcomes.groupBy("challenge_id", "passed", "failures").agg(F.count("*").alias("n"))
    of = sets.groupBy("challenge_id").agg(F.sum("n").alias("artifacts"), F.coalesce(F.sum(F.when(F.col("passed"), F.col("n"))), F.lit(0)).alias("passed"), F.collect_list(F.struct("failures", "n")).alias("sets"))
    names = F.array_sort(F.array_distinct(F.flatten(F.transform("sets", lambda s: F.coalesce(s["failures"], F.array().cast("array<string>"))))))
    count = lambda name: F.aggregate(F.filter("sets", lambda s: F.array_contains(s["failures"], name)), F.lit(0).cast("long"), lambda n, s: n + s["n"])
    return of.select("challenge_id", "artifacts", "passed", F.when(F.size(names) > 0, F.map_from_entries(F.transform(names, lambda name: F.struct(name.alias("failure"), count(name).alias("n"))))).alias("failures"))
