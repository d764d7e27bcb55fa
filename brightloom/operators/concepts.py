"""Trees of concepts: ancestors, cycles and inherited features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.scratch import Steps

#: How a feature belongs to a concept.
TIERS = ("necessary", "diagnostic", "common", "optional", "style-dependent", "prohibited")


def cyclic_concepts(edges: DataFrame) -> DataFrame:
    """(concept): the concepts of (child, parent) edges, one parent each, that are their own ancestors. Each
    concept points to its parent, then to where that points, and so on: after log2 of their number of
    steps, which are as many joins, only what leads into a cycle still points anywhere, and it points at
    all places of the cycle. No depth is a limit."""
    ups = edges.where("child is not null and parent is not null").groupBy("child").agg(F.min("parent").alias("up"))
    steps = Steps(edges.sparkSession)
    ups = steps.keep(ups)
    for _ in range(max(1, ups.count()).bit_length()):
        ups = steps.keep(ups.join(ups.select(F.col("child").alias("up"), F.col("up").alias("further")), "up").select("child", F.col("further").alias("up")))
        if ups.isEmpty():
            break
    return ups.select(F.col("up").alias("concept")).distinct()


def ontology_findings(concepts: DataFrame, requirements: DataFrame, relations: DataFrame, questions: DataFrame) -> DataFrame:
    """(subject, finding) of an ontology: concepts (concept, parent) with a parent that is none, stated twice or
    within a cycle; requirements (concept, feature, tier) of unknown tiers or concepts; relations (relation,
    inverse) whose inverse is none; competency questions (question) without a name or with another's."""
    known, related = concepts.select(F.col("concept").alias("name")).distinct(), relations.select(F.col("relation").alias("name")).distinct()
    found = lambda df, subject, finding: df.select(F.col(subject).cast("string").alias("subject"), F.lit(finding).alias("finding"))
    lacking = lambda df, key, names: df.where(F.col(key).isNotNull()).join(names, F.col(key) == F.col("name"), "left_anti")
    asked = questions.groupBy(F.coalesce("question", F.lit("")).alias("question")).agg(F.count("*").alias("n"))
    parts = [
        found(lacking(concepts, "parent", known), "concept", "unknown-parent"),
        found(concepts.groupBy("concept").agg(F.count("*").alias("n")).where("n > 1"), "concept", "stated-twice"),
        found(cyclic_concepts(concepts.select(F.col("concept").alias("child"), "parent")), "concept", "cycle"),
        found(requirements.where(~F.coalesce(F.col("tier").isin(*TIERS), F.lit(False))), "concept", "unknown-tier"),
        found(lacking(requirements, "concept", known), "concept", "requirement-of-no-concept"),
        found(lacking(relations, "inverse", related), "relation", "unknown-inverse"),
        found(asked.where("question = ''"), "question", "question-without-name"), found(asked.where("n > 1 and question <> ''"), "question", "repeated-question"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def compose_scenes(wanted: DataFrame, animals: DataFrame, objects: DataFrame, relations: DataFrame) -> DataFrame:
    """``wanted`` (animal, object, relation) with problem, what keeps the scene from being composed (null if
    nothing), and if there is none the features that it requires. Animals and objects: (concept, class,
    features); relations: (relation, allowed_classes, features), where no class means any."""
    part = lambda df, key, prefix: df.select(F.col(key).alias(f"{prefix}_key"), *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != key])
    met = wanted
    for df, key, name in ((animals, "concept", "animal"), (objects, "concept", "object"), (relations, "relation", "relation")):
        met = met.join(part(df, key, name), F.col(name) == F.col(f"{name}_key"), "left")
    allowed = F.col("relation_allowed_classes")
    fits = F.coalesce(F.size(allowed) == 0, F.lit(True)) | F.coalesce(F.array_contains(allowed, F.col("object_class")), F.lit(False))
    problem = F.when(F.col("animal_key").isNull(), "unknown-animal").when(F.col("object_key").isNull(), "unknown-object").when(F.col("relation_key").isNull(), "unknown-relation").when(~fits, "class-not-allowed")
    features = [F.when(problem.isNull(), F.array_sort(F.col(f"{k}_features"))).alias(f"{k}_features") for k in ("animal", "object", "relation")]
    return met.select("animal", "object", "relation", problem.alias("problem"), *features)


def ancestors(edges: DataFrame) -> DataFrame:
    """(concept, ancestor, depth) of (child, parent) edges, each concept its own at depth 0. Doubling:
    paths of length up to 2**k from those up to 2**(k-1), so a tree of depth d takes log2(d) joins. A
    concept that turns out its own ancestor is an error; depth is no limit."""
    names = edges.select(F.col("child").alias("concept")).union(edges.select("parent")).where("concept is not null").distinct()
    paths = names.select("concept", F.col("concept").alias("ancestor"), F.lit(0).alias("depth")).union(edges.where("parent is not null").select(F.col("child").alias("concept"), F.col("parent").alias("ancestor"), F.lit(1)))
    steps = Steps(edges.sparkSession)
    paths, reach = steps.keep(paths.distinct()), 1
    while True:
        ahead = paths.where(F.col("depth") == reach).select(F.col("concept"), F.col("ancestor").alias("_mid"))
        further = paths.where("depth > 0").select(F.col("concept").alias("_mid"), "ancestor", F.col("depth").alias("_d"))
        longer = ahead.join(further, "_mid").select("concept", "ancestor", (F.col("_d") + reach).alias("depth"))
        if longer.isEmpty():
            return paths
        if not longer.where("concept = ancestor").isEmpty():
            raise ValueError("concepts form a cycle")
        paths, reach = steps.keep(paths.union(longer).distinct()), reach * 2


def feature_profile(paths: DataFrame, features: DataFrame) -> DataFrame:
    """(concept, feature, tier): features of a concept and its ancestors; the nearest one's tier counts."""
    owned = paths.join(features.withColumnRenamed("concept", "ancestor"), "ancestor")
    return owned.groupBy("concept", "feature").agg(F.min_by("tier", "depth").alias("tier"), F.min("depth").alias("from_depth"))


def missing_parents(edges: DataFrame) -> DataFrame:
    """Parents that are no concept themselves."""
    return edges.where("parent is not null").select(F.col("parent").alias("concept")).distinct().join(edges.select(F.col("child").alias("concept")), "concept", "left_anti")


def merge_conflicts(concepts: DataFrame) -> DataFrame:
    """Concepts that several ontologies define differently."""
    return concepts.groupBy("concept").agg(F.count("*").alias("definitions"), F.count_distinct("definition").alias("variants")).where("variants > 1")


def competency(cases: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Cases (case_id, animal_class, object_class, expected) against allowed pairs of classes."""
    allowed = capabilities.select("animal_class", "object_class", F.lit(True).alias("_ok")).distinct()
    return cases.join(allowed, ["animal_class", "object_class"], "left").withColumn("observed", F.coalesce("_ok", F.lit(False))).drop("_ok").withColumn("passed", F.col("observed") == F.col("expected"))


def merged_ontologies(concepts: DataFrame) -> DataFrame:
    """The union of the concepts (concept, definition) of several ontologies, each once. Definitions that
    differ are an error when their concept is read; ``merge_conflicts`` lists them."""
    merged = concepts.groupBy("concept").agg(F.min("definition").alias("definition"), F.max("definition").alias("_other"), F.count("*").alias("ontologies"))
    clash = F.raise_error(F.concat(F.lit("conflicting concept "), F.col("concept")))
    return merged.withColumn("definition", F.when(F.col("definition") != F.col("_other"), clash).otherwise(F.col("definition"))).drop("_other")


def json_ld(concepts: DataFrame, base: str, kind: str = "skos:Concept") -> DataFrame:
    """(concept, node): each concept (concept, label, parent) as a JSON-LD node of type ``kind`` in the graph at ``base``."""
    name = lambda c: F.concat(F.lit(base), c)
    node = F.struct(name(F.col("concept")).alias("@id"), F.lit(kind).alias("@type"), F.col("label").alias("rdfs:label"), F.when(F.col("parent").isNotNull(), F.struct(name(F.col("parent")).alias("@id"))).alias("rdfs:subClassOf"))
    return concepts.select("concept", F.to_json(node).alias("node"))
