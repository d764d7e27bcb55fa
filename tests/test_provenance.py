"""Provenance graphs, crates, study freezes and integrations."""

import json

import pytest
from pyspark.sql import functions as F

from brightloom.operators import planning, provenance


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_graphs_hold_each_node_once(spark):
    runs = spark.createDataFrame([("r1", "m", "1", "2026-01-01", "v1"), ("r2", "m", "1", "2026-01-02", None)], "run_id string, model_id string, model_revision string, created_at string, release string")
    trials = spark.createDataFrame([("t1", "r1", "task", 5, "done", "sha256:aa"), ("t2", "r2", "task", 6, "failed", None)], "trial_id string, run_id string, task_id string, seed long, status string, artifact_id string")
    scored = spark.createDataFrame([("e1", "t1", "sha256:aa", "s1"), ("e2", "t2", "sha256:bb", "s1")], "evaluation_id string, trial_id string, artifact_id string, scorer string")
    graph = provenance.prov_graph(runs, trials, scored)
    nodes = {r["id"]: json.loads(r["node"]) for r in rows(graph)}
    assert graph.count() == len(nodes) == 11
    assert nodes["urn:run:r1"] == {"@id": "urn:run:r1", "@type": "prov:Activity", "prov:startedAtTime": "2026-01-01", "prov:wasAssociatedWith": [{"@id": "urn:run:model/m@1"}, {"@id": "urn:run:software"}], "release": "v1"}
    assert "release" not in nodes["urn:run:r2"] and nodes["urn:run:artifact/aa"]["prov:wasGeneratedBy"] == {"@id": "urn:run:t1"}
    assert rows(provenance.dangling(graph)) == [{"id": "urn:run:e2", "refers_to": "urn:run:artifact/bb"}]
    files = spark.createDataFrame([("a/b.svg", "image/svg+xml", 12, "sha256:cc")], "path string, media_type string, bytes long, sha256 string")
    crate = {r["id"]: json.loads(r["node"]) for r in rows(provenance.crate_graph(runs.limit(1), files, "one run"))}
    assert crate["a/b.svg"] == {"@id": "a/b.svg", "@type": "File", "encodingFormat": "image/svg+xml", "contentSize": 12, "sha256": "cc", "isPartOf": {"@id": "./"}}
    assert crate["./"]["identifier"] == "r1" and crate["./"]["name"] == "one run" and crate["ro-crate-metadata.json"]["about"] == {"@id": "./"}


def test_freezes_bind_every_file(spark):
    files = spark.createDataFrame([(f"f{k}", f"{k:064x}", k) for k in range(20)], "path string, sha256 string, bytes long")
    freeze = lambda df=files, kind="data-freeze", head="h": rows(provenance.study_freeze(df, "s", kind, "t", head))[0]
    one = freeze()
    assert one["files"] == 20 and one["bytes"] == 190 and freeze(files.orderBy(F.desc("path"))) == one and freeze(head="other")["freeze_commitment"] != one["freeze_commitment"]
    changed = files.withColumn("sha256", F.when(F.col("path") == "f3", "0").otherwise(F.col("sha256")))
    assert freeze(changed)["freeze_commitment"] != one["freeze_commitment"]
    for kind, head in (("data-freeze", None), ("analysis-lock", "h"), ("other", None)):
        with pytest.raises(ValueError):
            freeze(kind=kind, head=head)
    with pytest.raises(Exception, match="frozen twice"):
        freeze(files.union(files.limit(1)))
    with pytest.raises(Exception, match="needs a file"):
        freeze(files.limit(0))
    there = changed.where("path <> 'f5'").withColumn("bytes", F.when(F.col("path") == "f7", 99).otherwise(F.col("bytes"))).union(spark.createDataFrame([("new", "x", 1)], files.schema))
    assert {(r["path"], r["finding"]) for r in rows(provenance.freeze_findings(files, there))} == {("f3", "other-content"), ("f5", "missing"), ("f7", "other-size")}


def test_integrations_need_their_evidence(spark):
    assets = spark.createDataFrame([("a", "active", ["x", "y"], ["go"]), ("b", "blocked", [], ["go", "stop"]), ("c", "planned", ["z"], [])], "asset_id string, status string, evidence array<string>, command_names array<string>")
    present = spark.createDataFrame([("x",), ("z",)], "path string")
    commands = spark.createDataFrame([("go", True), ("stop", False)], "command string, available boolean")
    assert {tuple(r.values()) for r in rows(provenance.integration_findings(assets, present, commands))} == {
        ("a", "error", "missing-integration-evidence", "y"), ("b", "warning", "blocked-external-surface", None), ("c", "info", "planned-integration", None), ("stop", "info", "optional-command-unavailable", None),
    }


def test_designs_pair_only_what_was_sampled(spark):
    data = [(f"a{k}", f"t{k % 3}", f"s{k % 3}", f"m{k % 4}", k / 60, (k % 7) / 10, True) for k in range(60)]
    candidates = spark.createDataFrame(data, "artifact_id string, task_id string, stratum string, model_id string, score double, disagreement double, valid boolean")
    sample, pairs = planning.calibration_design(candidates, 20, 3, ["overall"], 4)
    chosen = {r["artifact_id"] for r in rows(sample)}
    made = rows(pairs)
    assert len(chosen) == 20 and made and all({r["left_id"], r["right_id"]} <= chosen for r in made)
