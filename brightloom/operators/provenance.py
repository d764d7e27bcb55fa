"""Provenance of runs as linked-data nodes, study freezes, and the audit of integrations.

Graphs are tables of (id, node), a JSON text a node, so that a graph of any size is written in parallel; a node that
many rows speak of, such as a task, stands in it once.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.operators.integrity import rows_commitment

# Kinds of freezes, statuses of integrations that are worth a finding.
FREEZES = ("analysis-lock", "data-freeze")
STATUSES = {"blocked": ("warning", "blocked-external-surface"), "planned": ("info", "planned-integration")}


def _link(base: str, *parts: Column | str) -> Column:
    return F.struct(_name(base, *parts).alias("@id"))


def _name(base: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(base), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _nodes(df: DataFrame, name: Column, kind: str, /, **facts: Column) -> DataFrame:
    """(id, node): one of each name; facts that are null stay away."""
    node = F.struct(name.alias("@id"), F.lit(kind).alias("@type"), *[v.alias(k) for k, v in facts.items()])
    return df.select(name.alias("id"), F.to_json(node).alias("node")).groupBy("id").agg(F.min("node").alias("node"))


def _digest(artifact_id: Column) -> Column:
    return F.regexp_replace(artifact_id, "^sha256:", "")


def prov_graph(runs: DataFrame, trials: DataFrame, evaluations: DataFrame, base: str = "urn:run:", software: str = "software") -> DataFrame:
    """(id, node) of runs (run_id, model_id, model_revision, created_at, release), trials (trial_id, run_id, task_id,
    seed, status, artifact_id) and evaluations (evaluation_id, trial_id, artifact_id, scorer): runs, trials and
    evaluations as activities, models and the software as agents, tasks and artifacts as entities."""
    model = ("model/", F.col("model_id"), "@", F.col("model_revision"))
    kept = trials.where("artifact_id is not null")
    parts = [
        _nodes(runs, _name(base, F.col("run_id")), "prov:Activity", **{"prov:startedAtTime": F.col("created_at"), "prov:wasAssociatedWith": F.array(_link(base, *model), _link(base, software)), "release": F.col("release")}),
        _nodes(runs, _name(base, *model), "prov:Agent"),
        _nodes(runs, _name(base, software), "prov:SoftwareAgent"),
        _nodes(trials, _name(base, F.col("trial_id")), "prov:Activity", **{"prov:wasInformedBy": _link(base, F.col("run_id")), "prov:used": _link(base, "task/", F.col("task_id")), "seed": F.col("seed"), "status": F.col("status")}),
        _nodes(trials, _name(base, "task/", F.col("task_id")), "prov:Entity"),
        _nodes(kept, _name(base, "artifact/", _digest(F.col("artifact_id"))), "prov:Entity", **{"prov:wasGeneratedBy": _link(base, F.col("trial_id"))}),
        _nodes(evaluations, _name(base, F.col("evaluation_id")), "prov:Activity", **{"prov:used": F.array(_link(base, "artifact/", _digest(F.col("artifact_id"))), _link(base, "scorer/", F.col("scorer"))), "prov:wasInformedBy": _link(base, F.col("trial_id"))}),
        _nodes(evaluations, _name(base, "scorer/", F.col("scorer")), "prov:Agent"),
    ]
    return functools.reduce(DataFrame.union, parts)


def dangling(graph: DataFrame) -> DataFrame:
    """(id, refers_to): links of a graph (id, node) to nodes that are not in it."""
    links = graph.select("id", F.explode(F.regexp_extract_all("node", F.lit(r'\{"@id":"((?:[^"\\]|\\.)*)"\}'), F.lit(1))).alias("refers_to")).distinct()
    return links.join(graph.select(F.col("id").alias("refers_to")), "refers_to", "left_anti").select("id", "refers_to")


def crate_graph(run: DataFrame, artifacts: DataFrame, name: str = "run") -> DataFrame:
    """(id, node) of the crate of one run (run_id, created_at, release): its descriptor, the root with its parts
    (the root refers to the list of parts; each part says that it is of the root), and a file for each artifact
    (path, media_type, bytes, sha256)."""
    root, described = "./", "ro-crate-metadata.json"
    link = lambda target: F.struct(F.lit(target).alias("@id"))
    files = _nodes(artifacts, F.col("path"), "File", **{"encodingFormat": F.col("media_type"), "contentSize": F.col("bytes"), "sha256": _digest(F.col("sha256")), "isPartOf": link(root)})
    top = _nodes(run, F.lit(root), "Dataset", name=F.lit(name), datePublished=F.col("created_at"), identifier=F.col("run_id"), version=F.col("release"))
    descriptor = _nodes(run, F.lit(described), "CreativeWork", about=link(root), conformsTo=F.struct(F.lit("https://w3id.org/ro/crate/1.1").alias("@id")))
    return descriptor.union(top).union(files)


def study_freeze(files: DataFrame, study_id: str, kind: str, task_commitment: str, ledger_head: str | None = None) -> DataFrame:
    """One row that freezes ``files`` (path, sha256, bytes): study_id, kind, task_commitment, ledger_head, files, bytes
    and freeze_commitment over all of it. Analysis locks have no ledger head, data freezes need one; no file,
    or a path that is listed twice, is an error when the row is read."""
    if kind not in FREEZES or not study_id.strip():
        raise ValueError(f"a study and one of {', '.join(FREEZES)} are required")
    if (kind == "data-freeze") != (ledger_head is not None):
        raise ValueError("data freezes need a ledger head, analysis locks must not have one")
    sums = files.agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    bound = sums.join(rows_commitment(files, ["path", "sha256", "bytes"], "listed").select("listed"))
    n = F.when(F.col("n") == 0, F.raise_error(F.lit("a freeze needs a file"))).when(F.col("n") != F.col("paths"), F.raise_error(F.lit("a path is frozen twice"))).otherwise(F.col("n"))
    head = F.lit(ledger_head).cast("string")
    stated = F.concat_ws("\x1f", F.lit(study_id), F.lit(kind), F.lit(task_commitment), F.coalesce(head, F.lit("")), n.cast("string"), F.col("bytes").cast("string"), F.col("listed"))
    return bound.select(F.lit(study_id).alias("study_id"), F.lit(kind).alias("kind"), F.lit(task_commitment).alias("task_commitment"), head.alias("ledger_head"), n.alias("files"), "bytes", F.sha2(stated.cast("binary"), 256).alias("freeze_commitment"))


def freeze_findings(frozen: DataFrame, present: DataFrame) -> DataFrame:
    """(path, finding) of frozen files (path, sha256, bytes) against those that are there: missing, other-size,
    other-content. Files that were not frozen do not matter."""
    there = present.select("path", F.col("sha256").alias("now"), F.col("bytes").alias("now_bytes"))
    met = frozen.join(there, "path", "left")
    finding = F.when(F.col("now").isNull(), "missing").when(~F.col("bytes").eqNullSafe(F.col("now_bytes")), "other-size").when(F.col("sha256") != F.col("now"), "other-content")
    return met.select("path", finding.alias("finding")).where("finding is not null")


def integration_findings(assets: DataFrame, present: DataFrame, commands: DataFrame) -> DataFrame:
    """(subject, severity, finding, path) of integrations (asset_id, status, evidence, command_names): evidence that is
    not ``present`` (path), statuses that hold something up, and commands that are not there
    (``commands``: command, available)."""
    lacking = assets.select("asset_id", F.explode("evidence").alias("path")).join(present.select("path").distinct(), "path", "left_anti")
    nothing = F.lit(None).cast("string").alias("path")
    parts = [lacking.select(F.col("asset_id").alias("subject"), F.lit("error").alias("severity"), F.lit("missing-integration-evidence").alias("finding"), "path")]
    parts += [assets.where(F.col("status") == s).select("asset_id", F.lit(severity), F.lit(finding), nothing) for s, (severity, finding) in STATUSES.items()]
    wanted = assets.select(F.explode("command_names").alias("command")).distinct()
    absent = wanted.join(commands.where("available").select("command").distinct(), "command", "left_anti")
    return functools.reduce(DataFrame.union, [*parts, absent.select("command", F.lit("info"), F.lit("optional-command-unavailable"), nothing)])
