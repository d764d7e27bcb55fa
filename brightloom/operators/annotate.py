r"""Rule-based annotation of documents and prompts.

Word boundaries are written out as ``(^|[^\p{L}\p{N}_])`` in counts, which engines agree on.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brightloom.functions.names import free
from brightloom.functions.spans import with_matches
from brightloom.operators.integrity import content_hash

# Lexicons and expressions of document annotation.
ENTITY_TERMS = {
    "ANIMAL": ("pelican", "flamingo", "heron", "stork", "bird"),
    "MOBILE_OBJECT": ("bicycle", "bike", "tuk-tuk", "scooter", "wheelchair"),
    "ANATOMY": ("bill", "pouch", "wing", "feet", "foot", "body", "silhouette"),
    "MECHANICS": ("wheel", "frame", "pedal", "handlebar", "saddle", "cabin"),
    "EVALUATION": ("recognisable", "criticised", "praised", "improved", "failed", "extra"),
    "AGENTIC": ("agent", "inspected", "contact sheet", "reference", "revision", "preserved"),
}
RELATIONS = {
    "failed_contact": "(?:did not|not) contact",
    "disconnected_component": "disconnected",
    "improvement": "improv(?:e|ed|ement)",
    "regression": "introduced|extra|regress",
    "role_mismatch": "rather than|represented .* rather than",
}
CATEGORIES = {
    "anatomy": "bill|pouch|wing|feet|foot|anatom",
    "mechanics": "wheel|frame|pedal|handlebar|saddle|cabin",
    "interaction": "contact|riding|driving|driver|relation|above|on top",
    "agentic": "agent|contact sheet|reference|revision|inspect",
}
# Names and expressions of prompt annotation.
ANIMALS = ("antelope", "cat", "dog", "flamingo", "heron", "octopus", "otter", "pelican", "raccoon", "whale")
MOBILE_OBJECTS = {
    "bicycle": "bicycle", "bike": "bicycle", "boat": "boat", "canoe": "canoe", "electric scooter": "electric-scooter", "go-kart": "go-kart", "go kart": "go-kart", "kayak": "kayak",
    "plane": "plane", "aircraft": "plane", "scooter": "electric-scooter", "skateboard": "skateboard", "tuk-tuk": "tuk-tuk", "tuk tuk": "tuk-tuk", "unicycle": "unicycle",
}
PROMPT_RELATIONS = {
    "rides_on": r"\b(?:riding|rides?|astride)\b",
    "drives": r"\b(?:driving|drives?)\b",
    "paddles": r"\b(?:paddling|paddles?)\b",
    "operates": r"\b(?:operating|operates?)\b",
    "aboard": r"\bon\s+an?\s+(?:plane|boat|aircraft)\b",
    "passenger_in": r"\b(?:passenger|sitting|seated)\s+in\b",
}
STYLES = {
    "flat": r"\bflat(?:\s+vector)?\b",
    "simple-vector": r"\bsimple\s+vector\b",
    "photorealistic": r"\bphotoreal(?:istic)?\b",
    "line-art": r"\bline[ -]?art\b",
}
VIEWPOINTS = {
    "side": r"\b(?:side|profile)\s+(?:view|on)\b|\bviewed\s+from\s+the\s+side\b",
    "front": r"\bfront(?:al)?\s+view\b|\bviewed\s+from\s+the\s+front\b",
    "rear": r"\brear\s+view\b|\bviewed\s+from\s+behind\b",
    "three-quarter": r"\bthree[- ]quarter\b|\b3/4\s+view\b",
}
INTENTS = {
    "asks_for_svg": r"\bsvg\b",
    "asks_for_animation": r"\b(?:animate|animated|animation|motion)\b",
    "asks_for_editability": r"\b(?:editable|editability|layered|grouped)\b",
    "asks_for_text": r"\b(?:caption|label|lettering|text)\b",
}
TOKEN = r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*"
NUMBER = r"(?<![A-Za-z])\d+(?:\.\d+)?(?![A-Za-z])"
# Expressions that look like instructions to a judge.
MARKERS = {
    "ignore-instructions": r"\bignore\b.{0,40}\b(?:instruction|prompt|system)\b",
    "evaluator-direction": r"\b(?:judge|evaluator|scorer|rating)\b",
    "answer-direction": r"\b(?:answer|respond|output)\b.{0,24}\b(?:yes|no|true|false|[0-9])\b",
    "score-direction": r"\b(?:give|assign|return|set)\b.{0,24}\b(?:score|rating|probability)\b",
    "role-direction": r"\b(?:system|assistant|developer)\s*:",
}


_WORD_EDGE = r"[\p{L}\p{N}_]"
_LABELS = {term: label for label, terms in ENTITY_TERMS.items() for term in terms}
ENTITY = rf"(?i)(?<!{_WORD_EDGE})(?:" + "|".join(term.replace("-", r"\-") for term in _LABELS) + rf")(?!{_WORD_EDGE})"


def _holds(low: Column, pattern: str) -> Column:
    """Whether a lower-case text has a match. Alternatives that are plain words are looked up as such."""
    if not re.fullmatch("[a-z |]+", pattern):
        return low.rlike(pattern)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(word)) for word in pattern.split("|")])


def _named(low: Column, patterns: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(_holds(low, p), F.lit(name)) for name, p in patterns.items()]))


def found(text: Column, patterns: dict[str, str], flags: str = "(?i)") -> Column:
    """Names of the patterns that a text holds, in their listed order."""
    return F.array_compact(F.array(*[F.when(text.rlike(flags + p), F.lit(name)) for name, p in patterns.items()]))


def annotate_documents(docs: DataFrame, text: str = "text", source: str | None = None) -> DataFrame:
    """``docs`` with entities (label, text, start, end in code points), entity counts by label, relations,
    categories, the first category and text_hash; with a ``source`` column also idea_id, a hash of the
    source, its categories and relations. The text is lowered once and searched once for all terms."""
    low, found = free(docs, "_low", "_found")
    out = docs.withColumn(low, F.lower(text))
    some = reduce(lambda a, b: a | b, [F.contains(low, F.lit(term)) for term in _LABELS])
    out = with_matches(out, text, ENTITY, some, found)
    labels = F.create_map(*[F.lit(x) for pair in _LABELS.items() for x in pair])
    entities = F.transform(found, lambda m: F.struct(F.element_at(labels, F.lower(m["text"])).alias("label"), m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end")))
    out = out.withColumn("entities", entities)
    count = lambda label: F.size(F.filter("entities", lambda e: e["label"] == label)).cast("long")
    out = out.withColumn("entity_counts", F.create_map(*[x for label in ENTITY_TERMS for x in (F.lit(label), count(label))]))
    out = out.withColumn("relations", _named(F.col(low), RELATIONS)).withColumn("categories", _named(F.col(low), CATEGORIES))
    out = out.withColumn("category", F.coalesce(F.get("categories", F.lit(0)), F.lit("other"))).withColumn("text_hash", content_hash(F.col(text)))
    if source:
        idea = F.sha2(F.to_json(F.struct("categories", "relations", F.col(source).alias("source"))).cast("binary"), 256)
        out = out.withColumn("idea_id", F.concat(F.lit("idea:"), F.substring(idea, 1, 12)))
    return out.drop(low, found)


def corpus_summary(annotated: DataFrame) -> DataFrame:
    """Counts over all documents: (kind, name, n) for entities, categories, relations and documents, in
    one pass; names that never occur are left out."""
    entities = [("entity", label, F.sum(F.element_at("entity_counts", F.lit(label)))) for label in ENTITY_TERMS]
    listed = [(kind, name, F.count_if(F.array_contains(column, name))) for kind, column, names in (("category", "categories", CATEGORIES), ("relation", "relations", RELATIONS)) for name in names]
    counts = [*entities, *listed, ("documents", "all", F.count("*"))]
    one = annotated.agg(*[n.cast("long").alias(f"n{k}") for k, (_, _, n) in enumerate(counts)])
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.col(f"n{k}").alias("n")) for k, (kind, name, _) in enumerate(counts)])
    return one.select(F.explode(rows).alias("r")).select("r.*").where("n > 0 or kind = 'documents'")


def _with_mentions(prompts: DataFrame, prompt: str, aliases: dict[str, str], into: str) -> DataFrame:
    """``prompts`` with mentions (surface, canonical_id, start, end); of overlapping ones the longest at the
    first start: alternation tries longer surfaces first, and matching goes on after a match's end."""
    surfaces = sorted(aliases, key=lambda s: (-len(s), s))
    pattern = "(?i)(?<![A-Za-z0-9])(?:" + "|".join(s.replace("-", r"\-") for s in surfaces) + ")(?![A-Za-z0-9])"
    some = reduce(lambda a, b: a | b, [F.contains(F.lower(prompt), F.lit(s)) for s in surfaces])
    names = F.create_map(*[F.lit(x) for s in surfaces for x in (s, aliases[s])])
    found_ = with_matches(prompts, prompt, pattern, some, into)
    return found_.withColumn(into, F.transform(into, lambda m: F.struct(m["text"].alias("surface"), F.element_at(names, F.lower(m["text"])).alias("canonical_id"), m["start"].alias("start"), m["end"].alias("end"))))


def annotate_prompts(prompts: DataFrame, prompt: str = "prompt") -> DataFrame:
    """``prompts`` with tokens, mentions with their places, relations, viewpoints, styles, numbers and intents."""
    p = F.col(prompt)
    relations = found(p, PROMPT_RELATIONS)
    aboard = F.array_contains(relations, "aboard") & ~p.rlike(r"(?i)\briding\b")
    mentioned = _with_mentions(_with_mentions(prompts, prompt, {a: a for a in ANIMALS}, "animal_mentions"), prompt, MOBILE_OBJECTS, "object_mentions")
    out = (
        mentioned.withColumn("tokens", F.transform(F.regexp_extract_all(p, F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t)))
        .withColumn("relations", F.when(aboard, F.array_remove(relations, "rides_on")).otherwise(relations))
        .withColumn("viewpoints", found(p, VIEWPOINTS))
        .withColumn("styles", found(p, STYLES))
        .withColumn("numeric_constraints", F.regexp_extract_all(p, F.lit(NUMBER), F.lit(0)))
    )
    for name, pattern in INTENTS.items():
        out = out.withColumn(name, F.lower(p).rlike(pattern))
    return out.withColumn("compositional", (F.size("animal_mentions") > 0) & (F.size("object_mentions") > 0))


def prompt_report(annotated: DataFrame) -> DataFrame:
    """One row: prompts, tokens and the share of prompts with each flag."""
    share = lambda c: F.avg(c.cast("double"))
    return annotated.agg(
        F.count("*").alias("prompts"), F.sum(F.size("tokens")).alias("tokens"), share(F.col("compositional")).alias("compositional_share"),
        *[share(F.col(name)).alias(f"{name}_share") for name in INTENTS], share(F.size("relations") > 0).alias("relation_share"),
    )


def design_coverage(annotated: DataFrame, tasks: DataFrame) -> DataFrame:
    """(dimension, name, observed, planned): which animals and objects prompts mention and tasks plan."""
    seen = [annotated.select(F.explode(f"{d}_mentions.canonical_id").alias("name")).distinct().select(F.lit(d).alias("dimension"), "name", F.lit(True).alias("observed")) for d in ("animal", "object")]
    planned = [tasks.select(F.col(d).alias("name")).distinct().select(F.lit(d).alias("dimension"), "name", F.lit(True).alias("planned")) for d in ("animal", "object")]
    return seen[0].union(seen[1]).join(planned[0].union(planned[1]), ["dimension", "name"], "full_outer").fillna(False, ["observed", "planned"])


def prompt_coverage(prompts: DataFrame, tasks: DataFrame, prompt: str = "prompt") -> DataFrame:
    """One row: distinct prompts, how many of them a task states word for word, and their share (0
    without a prompt)."""
    distinct, stated = prompts.select(F.col(prompt).alias("p")).distinct(), tasks.select(F.col(prompt).alias("p")).distinct().withColumn("stated", F.lit(1))
    out = distinct.join(stated, "p", "left").agg(F.count("*").alias("prompts"), F.count("stated").alias("exact_matches"))
    return out.withColumn("exact_coverage", F.when(F.col("prompts") > 0, F.col("exact_matches") / F.when(F.col("prompts") > 0, F.col("prompts"))).otherwise(0.0))


def instruction_markers(text: Column) -> Column:
    """Names of the instruction-like expressions in a text."""
    return found(text, MARKERS, "(?is)")


def normalised_label(label: Column) -> Column:
    """Trimmed, lower-case, underscores as hyphens, single blanks."""
    return F.trim(F.regexp_replace(F.replace(F.lower(label), F.lit("_"), F.lit("-")), r"\s+", " "))


def duplicate_ids(records: DataFrame, column: str) -> DataFrame:
    """Ids that several records have."""
    return records.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def latest_entries(entries: DataFrame, key: str, content: str, order: str) -> DataFrame:
    """The last entry of each key, how many there were, and whether their contents differ."""
    w = Window.partitionBy(key)
    (nth,) = free(entries, "_n")
    out = entries.withColumn(nth, F.row_number().over(w.orderBy(F.desc(order)))).withColumn("versions", F.count("*").over(w)).withColumn("conflict", F.min(content).over(w) != F.max(content).over(w))
    return out.where(F.col(nth) == 1).drop(nth)
