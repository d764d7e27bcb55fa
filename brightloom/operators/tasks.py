"""Task grammars: their checks, compatible designs, and tasks built from them.

Tables of a grammar: animals (id, label, animal_class, interaction_modes, required_features, adaptation),
objects (id, label, object_class, interface_class, interface_classes, interaction_modes,
required_features) and relations (id, phrase, allowed_object_classes, allowed_interface_classes,
required_contacts). A grammar is written by hand: its tables are small, and their product is the design.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions.draws import hash_number, stable_id, stable_seed

# The prompt, views, relations and styles that are easy.
PROMPT = "Generate an SVG of a {animal} {phrase} {object}, viewed from the {viewpoint}, in a {style} style."
EASY_VIEWS, EASY_RELATIONS, EASY_STYLES = ("side", "profile"), ("rides_on", "passenger_in"), ("simple vector illustration", "flat icon")
MANY_FEATURES, ADAPTED, HARDEST = 10, 3, 5


def grammar_findings(animals: DataFrame, objects: DataFrame, relations: DataFrame) -> DataFrame:
    """(part, id, finding): ids that are absent or repeat, modes that no relation has, objects without an
    interface class, and parts that are empty."""
    parts = {"animals": animals, "objects": objects, "relations": relations}
    out = None
    for name, rows in parts.items():
        ids = rows.groupBy(F.coalesce("id", F.lit("")).alias("id")).agg(F.count("*").alias("n"))
        bad = F.when(F.col("id") == "", "identifier-missing").when(F.col("n") > 1, "identifier-repeated")
        found = ids.select(F.lit(name).alias("part"), "id", bad.alias("finding")).where("finding is not null")
        empty = rows.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(name).alias("part"), F.lit("").alias("id"), F.lit("part-empty").alias("finding"))
        out = found.union(empty) if out is None else out.union(found).union(empty)
    known = relations.select(F.col("id").alias("mode"))
    for name in ("animals", "objects"):
        modes = parts[name].select("id", F.explode("interaction_modes").alias("mode")).join(known, "mode", "left_anti")
        out = out.union(modes.select(F.lit(name), "id", F.concat(F.lit("unknown-mode:"), "mode")).distinct())
    bare = objects.where(F.coalesce("interface_class", F.lit("")) == "").select(F.lit("objects"), "id", F.lit("interface-missing"))
    return out.union(bare)


def compatible_designs(animals: DataFrame, objects: DataFrame, relations: DataFrame) -> DataFrame:
    """Animals, objects and relations that go together: both take the relation's mode, and the object's
    class and one of its interfaces are allowed (an empty list allows all). The relation's mode is the
    join key, so only pairs that share one meet."""
    a = animals.select(F.struct("*").alias("animal"), F.explode(F.array_distinct("interaction_modes")).alias("mode"))
    o = objects.select(F.struct("*").alias("object"), F.explode(F.array_distinct("interaction_modes")).alias("mode"))
    r = relations.select(F.struct("*").alias("relation"), F.col("id").alias("mode"))
    free = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0
    interfaces = F.when(free(F.col("object.interface_classes")), F.array_compact(F.array("object.interface_class"))).otherwise(F.col("object.interface_classes"))
    fits = free(F.col("relation.allowed_object_classes")) | F.array_contains("relation.allowed_object_classes", F.col("object.object_class"))
    reaches = free(F.col("relation.allowed_interface_classes")) | F.arrays_overlap("relation.allowed_interface_classes", interfaces)
    return a.join(F.broadcast(r), "mode").join(o, "mode").where(fits & reaches).select("animal", "object", "relation")


def _filled(parts: dict[str, Column]) -> Column:
    """The prompt with its parts filled in."""
    pieces, rest = [], PROMPT
    for name, value in parts.items():
        before, _, rest = rest.partition("{" + name + "}")
        pieces += [F.lit(before), value]
    return F.concat(*pieces, F.lit(rest))


def build_tasks(designs: DataFrame, viewpoints: list[str], styles: list[str], release: str, version: str, base_seed: int) -> DataFrame:
    """A task for each design, viewpoint and style: ids of its scenario, prompt and itself, prompt,
    difficulty from 1 to 5, and a seed. Ids do not depend on the seed."""
    some = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    each = designs.withColumn("viewpoint", some(viewpoints)).withColumn("style", some(styles))
    animal, thing, relation = F.col("animal.id"), F.col("object.id"), F.col("relation.id")
    phrase = F.coalesce("relation.phrase", F.replace(relation, F.lit("_"), F.lit(" ")))
    prompt = _filled({"animal": F.col("animal.label"), "phrase": phrase, "object": F.col("object.label"), "viewpoint": F.col("viewpoint"), "style": F.col("style")})
    features = F.size("animal.required_features") + F.size("object.required_features")
    hard = (~F.col("viewpoint").isin(*EASY_VIEWS), ~relation.isin(*EASY_RELATIONS), features >= MANY_FEATURES, ~F.col("style").isin(*EASY_STYLES), F.coalesce("animal.adaptation", F.lit(1)) >= ADAPTED)
    difficulty = F.lit(1)
    for h in hard:
        difficulty = difficulty + h.cast("int")
    out = each.withColumn("scenario_id", stable_id("scenario", 12, F.lit(version), animal, thing, relation, F.col("viewpoint"))).withColumn("prompt", prompt)
    out = out.withColumn("prompt_id", stable_id("prompt", 12, F.col("scenario_id"), F.col("prompt"))).withColumn("task_id", stable_id("task", 16, F.lit(release), F.col("scenario_id"), F.col("prompt_id")))
    return out.select(
        "task_id", "scenario_id", "prompt_id", "prompt", animal.alias("animal"), thing.alias("object"), relation.alias("relation"), "viewpoint", "style",
        F.least(difficulty, F.lit(HARDEST)).alias("difficulty"), stable_seed(F.lit(base_seed), F.col("task_id")).alias("seed"),
    )


def drawn_tasks(tasks: DataFrame, count: int, seed: int) -> DataFrame:
    """The first ``count`` tasks in a hash order; fewer tasks are an error."""
    if (held := tasks.count()) < count:
        raise ValueError(f"{count} tasks are wanted, the grammar has {held}")
    return tasks.withColumn("_h", hash_number(F.lit(seed), F.col("task_id"))).orderBy("_h", "task_id").limit(count).drop("_h")
