"""Renders by their pixels, scorer challenges, execution records in files."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.functions import vector_source
from brightloom.operators import ledger, metamorphic, rasters
from brightloom.operators.scorecard import WEIGHTS
from brightloom.sources import records


def rows(df):
    return [r.asDict() for r in df.collect()]


def flooded(mask):
    seen, sizes = set(), []
    for y, x in zip(*np.nonzero(mask), strict=True):
        if (y, x) in seen:
            continue
        stack, size = [(y, x)], 0
        seen.add((y, x))
        while stack:
            b, a = stack.pop()
            size += 1
            for d in (-1, 0, 1):
                for e in (-1, 0, 1):
                    p = (b + d, a + e)
                    if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and p not in seen:
                        seen.add(p)
                        stack.append(p)
        sizes.append(size)
    return sorted(sizes)


def test_components_equal_a_flood_fill():
    rng = np.random.default_rng(2)
    for _ in range(200):
        mask = rng.random((rng.integers(1, 24), rng.integers(1, 24))) < rng.choice([0.1, 0.4, 0.6, 0.9])
        assert sorted(rasters.component_sizes(mask)) == flooded(mask)
    assert rasters.component_sizes(np.zeros((3, 3), bool)) == [] and rasters.component_sizes(np.ones((5, 7), bool)) == [35]


def test_repairs_by_pixels(spark):
    white = np.full((128, 128, 3), 255, np.uint8)
    before, after = white.copy(), white.copy()
    before[10:50, 10:50] = 0
    after[10:50, 10:40] = 0
    after[80:100, 80:100] = 200
    after[1, 120] = 0  # one pixel is no component
    faint = white.copy()
    faint[5, 5] = 252
    small = np.full((4, 4, 3), 255, np.uint8)
    data = [(0, before, after, 128), (1, before, before, 128), (2, white, faint, 128), (3, before, before[:64], 128), (4, None, before, 128), (5, small, small, 5), (6, white, after, None)]
    frame = spark.createDataFrame([(k, *(None if x is None else bytearray(x.tobytes()) for x in (b, a)), w) for k, b, a, w in data], "k int, b binary, a binary, w int")
    got = {r["k"]: r["x"].asDict() for r in rows(frame.select("k", rasters.repair_render(F.col("b"), F.col("a"), F.col("w")).alias("x")))}
    n = 40 * 10 + 20 * 20 + 1
    box = (100 - 1) * (121 - 40)
    assert got[0] == {
        "problem": None, "diff_pixel_fraction": pytest.approx(n / 16384), "preserved_pixel_fraction": pytest.approx(1 - n / 16384), "foreground_retention_fraction": pytest.approx(0.75), "added_ink_fraction": pytest.approx(401 / 16384),
        "edit_locality": pytest.approx(n / box), "introduced_components": 1, "renders_match": False,
    }
    assert got[1]["renders_match"] and got[1]["edit_locality"] == 1.0 and got[2]["renders_match"] and got[2]["foreground_retention_fraction"] == 0.0
    assert got[3]["problem"] == "other-canvas" and {got[k]["problem"] for k in (4, 5, 6)} == {"no-render"}


def test_two_renderers(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 200, (8, 8, 4)).astype(np.uint8)
    b = a.copy()
    b[0, 0, 3] += 8
    b[1, :, 0] += 51
    frame = spark.createDataFrame([(bytearray(a.tobytes()), bytearray(b.tobytes()))], "a binary, b binary")
    (r,) = rows(frame.select(rasters.renders_compared(F.col("a"), F.col("b"), F.lit(8)).alias("x")).select("x.*"))
    assert r == {"problem": None, "mean_absolute_error": pytest.approx((8 + 8 * 51) / 255 / 256), "differing_pixel_fraction": 8 / 64, "maximum_channel_error": pytest.approx(0.2)}


def test_scorer_challenges(spark):
    svg = '<svg><g id="wheel"><rect width="2"/></g></svg>'
    made = {r["challenge_id"]: r["source"] for r in rows(metamorphic.challenged(spark.createDataFrame([("a", svg)], "artifact_id string, source string")))}
    assert len(made) == 5 and all(vector_source.inspect(s)["valid"] and s != svg for s in made.values()) and "wheel" not in made["labels-stripped"] + made["labels-renamed"]
    fields = [*WEIGHTS, "aggregate"]
    schema = "artifact_id string, challenge_id string, render_hash string, valid boolean, " + ", ".join(f"{f} double" for f in fields)
    card = lambda art, challenge, h="h", valid=True, **to: (art, challenge, h, valid, *[to.get(f, 0.5) for f in fields])
    base = spark.createDataFrame([card("a", None), card("bad", None, valid=False)], schema).drop("challenge_id")
    ids = [r.challenge_id for r in metamorphic.RULES]
    twins = [card("a", ids[0]), card("a", ids[1], h="other"), card("a", ids[2], vector_quality=0.6), card("a", ids[3], vector_quality=0.6, aggregate=0.4), card("a", ids[4], interaction=0.6, aggregate=0.6), *(card("bad", c, valid=False) for c in ids[:4]), card("bad", ids[0], valid=False)]
    got = {(r["artifact_id"], r["challenge_id"]): r["failures"] for r in rows(metamorphic.challenge_outcomes(base, spark.createDataFrame(twins, schema)))}
    assert [got["a", c] for c in ids] == [[], ["render-changed"], ["score-changed"], [], ["semantic-dimensions-changed", "aggregate-improved"]]
    assert [got["bad", c] for c in ids] == [["baseline-not-valid", "scored-twice"], *[["baseline-not-valid"]] * 3, ["baseline-not-valid", "not-scored"]]
    report = {r["challenge_id"]: (r["artifacts"], r["passed"], r["failures"]) for r in rows(metamorphic.challenge_report(metamorphic.challenge_outcomes(base, spark.createDataFrame(twins, schema))))}
    assert report[ids[0]] == (2, 1, {"baseline-not-valid": 1, "scored-twice": 1})


def test_execution_records_in_files(spark, tmp_path):
    rng = random.Random(1)
    good = []
    for k in range(30):
        record = {"campaign_id": "c", "cell_id": f"x{k}", "worker_id": "w", "lease_token": f"t{k}", "attempt": 1, "terminal_state": "succeeded", "terminal_reason": "dóne", "artifact_id": "a", "charged_cost": rng.choice([1, 0.25]), "extra": {"z": [1, None], "a": "é"}}
        good.append(record | {"record_hash": records.record_hash(record)})
    files = {f"{r['cell_id']}/attempt-001.json": json.dumps(r, indent=rng.choice([None, 2])) for r in good}
    bad = {"b/1.json": "{", "b/2.json": "[1]", "b/3.json": json.dumps(good[0] | {"charged_cost": 9}), "b/4.json": json.dumps({k: v for k, v in good[1].items() if k != "record_hash"}), "b/5.json": json.dumps(good[2] | {"attempt": "one"}), "b/6.json": "[" * 100000, "b/7.json": '{"record_hash": "x", "charged_cost": NaN}', "b/8.json": ""}
    for name, text in (files | bad | {"b/notes.txt": "no record"}).items():
        path = tmp_path / "execution-records" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    found = records.read_execution_records(spark, str(tmp_path)).persist()
    problems = {r["path"].rpartition("/b/")[2]: r["problem"] for r in rows(found.where("problem is not null"))}
    assert problems == {"1.json": "not-json", "2.json": "not-an-object", "3.json": "hash-mismatch", "4.json": "no-hash", "5.json": "wrong-type:attempt", "6.json": "not-json", "7.json": "not-json"}
    kept = found.where("problem is null")
    assert sorted(r["record_hash"] for r in rows(kept)) == sorted(r["record_hash"] for r in good)
    events = kept.select("campaign_id", "cell_id", "lease_token", F.col("attempt").cast("int").alias("attempt"), "worker_id", F.col("terminal_state").alias("new_state"), F.col("terminal_reason").alias("reason"), "artifact_id", F.when(F.col("cell_id") == "x4", 7.0).otherwise(F.col("charged_cost")).alias("actual_cost"))
    assert [(r["cell_id"], r["finding"]) for r in rows(ledger.reconcile_executions(events, kept))] == [("x4", "cost-mismatch")]


def test_votes_with_quoted_headers(spark, tmp_path):
    path = tmp_path / "v.csv"
    path.write_text('﻿pair_id,task_id,criterion,"left_artifact_id",right_artifact_id,winner,rater_hash,"remarks, free"\np,t,c,a,b,left,0123456789abcdef,"x, y"\n', encoding="utf-8")
    good, bad = records.read_votes(spark, str(path))
    assert [(r["left_artifact_id"], r["remarks, free"]) for r in rows(good)] == [("a", "x, y")] and bad.count() == 0


def test_scorer_challenges_read_their_tables_once_and_deal_out_no_side_by_rule(spark):
    fields = [*WEIGHTS, "aggregate"]
    schema = "artifact_id string, challenge_id string, render_hash string, valid boolean, " + ", ".join(f"{f} double" for f in fields)
    card = lambda art, challenge: (art, challenge, "h", True, *[0.5] * len(fields))
    ids = [r.challenge_id for r in metamorphic.RULES]
    base = spark.createDataFrame([card(a, None) for a in ("a", "b", "b", None)], schema).drop("challenge_id")  # b stands there twice
    changed = spark.createDataFrame([*[card("a", c) for c in ids[1:]], *[card("b", c) for c in ids], card("a", "of-no-rule"), card(None, ids[1]), card("a", None)], schema)
    outcomes = metamorphic.challenge_outcomes(base, changed)
    got = sorted((r["artifact_id"] or "", r["challenge_id"], r["failures"]) for r in rows(outcomes))
    assert got == sorted([("a", ids[0], ["not-scored"]), *[("a", c, []) for c in ids[1:]], *[("b", c, []) for c in ids for _ in range(2)], *[("", c, ["not-scored"]) for c in ids]])
    report = metamorphic.challenge_report(outcomes)
    assert {r["challenge_id"]: (r["artifacts"], r["passed"], r["failures"]) for r in rows(report)} == {ids[0]: (4, 2, {"not-scored": 2})} | {c: (4, 3, {"not-scored": 1}) for c in ids[1:]}
    assert {r["failures"] is None for r in rows(metamorphic.challenge_report(outcomes.where("passed")))} == {True}
    assert report._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
