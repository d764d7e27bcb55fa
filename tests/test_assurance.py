"""Blinding, statistics of clusters, endpoints, ontologies, assessments, receipts, logs and release gates."""

import hashlib
import hmac
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.operators import assessments, blinding, concepts, endpoints, ledger, release, resampling, sessions

SECRET = bytes(range(32))


def rows(df):
    return [r.asDict() for r in df.collect()]


def models(spark, names):
    return spark.createDataFrame([(n,) for n in names], "model_id string")


def test_aliases_with_forced_collisions(spark):
    names = [f"model-{k}" for k in range(60)]
    digest = {n: hmac.new(SECRET, f"alias\x1fstudy\x1f{n}".encode(), hashlib.sha256).hexdigest() for n in names}
    for length, step in ((1, 1), (1, 2), (12, 2)):
        taken, want = set(), {}
        for n in sorted(names):  # one name after another, as a loop over taken aliases would do
            size = length
            while "SYS-" + digest[n][:size].upper() in taken:
                size += step
            want[n] = "SYS-" + digest[n][:size].upper()
            taken.add(want[n])
        assert {r["model_id"]: r["alias"] for r in rows(blinding.aliases(models(spark, names), SECRET, "study", length, step))} == want
    for bad in (["a", "a"], ["a", " "]):
        with pytest.raises(Exception, match="models share a name|has no name"):
            rows(blinding.aliases(models(spark, bad), SECRET, "study"))
    with pytest.raises(ValueError):
        blinding.aliases(models(spark, names), b"short", "study")


def test_verification_of_manifests(spark):
    private = blinding.aliases(models(spark, ["north", "south", "east"]), SECRET, "s").persist()
    head, public = blinding.header(private, SECRET, "s", "sha256:t"), blinding.public_list(private, SECRET, "s").persist()
    assert sorted(r["position"] for r in rows(public)) == [1, 2, 3]
    check = lambda p=public, m=private, h=head, secret=SECRET: rows(blinding.verification(p, m, h, head, secret))[0]
    good = check()
    assert all(good.values()) and check(secret=None) == {**good, "key_verified": None, "mapping_verified": None}
    failed = lambda **a: {k for k, v in check(**a).items() if v is False} - {"passed"}
    assert failed(secret=bytes(32)) == {"key_verified", "mapping_verified"}
    assert failed(p=public.where("position < 3")) == {"aliases_match", "count_matches"}
    assert failed(p=public.where("position < 3").union(public.where("position = 1"))) == {"aliases_unique", "aliases_match"}
    assert failed(m=private.withColumn("model_id", F.upper("model_id"))) == {"mapping_verified"}
    assert "names_hidden" in failed(p=public.withColumn("alias", F.when(F.col("position") == 2, "SYS-south-1").otherwise(F.col("alias"))))
    assert failed(h=head.withColumn("task_commitment", F.lit("other"))) == {"headers_match"}


def draw(k, seed, sample, i):
    return int(hashlib.sha256(f"{seed}|{sample}|{i}".encode()).hexdigest()[:12], 16) % k


def auc(pairs):
    pos, neg = [x for x, y in pairs if y == 1], [x for x, y in pairs if y == 0]
    if not pos or not neg:
        return None
    p, n = np.array(pos)[:, None], np.array(neg)[None]
    return float(((p > n) + 0.5 * (p == n)).mean())


def spearman(pairs):
    def ranks(v):
        v = np.array(v, float)
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    a, b = (ranks(v) - (len(pairs) + 1) / 2 for v in zip(*pairs, strict=True))
    spread = (a @ a) ** 0.5 * (b @ b) ** 0.5
    return float(a @ b / spread) if spread else None


@pytest.mark.parametrize("weighted, plain", [(resampling.weighted_auc, auc), (resampling.weighted_spearman, spearman)])
def test_statistics_of_ten_thousand_samples(spark, weighted, plain):
    rng, seed = random.Random(4), 5
    data = {f"c{k}": [(rng.randrange(6), rng.randrange(2)) for _ in range(rng.randrange(1, 6))] for k in range(6)}
    df = spark.createDataFrame([(c, float(x), float(y)) for c, v in data.items() for x, y in v] + [("c1", None, 1.0), ("c2", 2.0, None)], "cluster string, x double, y double")
    names = sorted(data)
    made = {}
    for sample in range(10_000):
        key = tuple(sorted(draw(6, seed, sample, i) for i in range(6)))
        if key not in made:
            made[key] = plain([p for i in key for p in data[names[i]]])
        made.setdefault("all", []).append(made[key])
    found = sorted(v for v in made["all"] if v is not None)
    (r,) = rows(resampling.statistic_bootstrap(df, weighted, seed=seed))
    assert r["estimate"] == pytest.approx(plain([p for v in data.values() for p in v])) and r["clusters"] == 6 and r["degenerate"] == 10_000 - len(found) and not r["fail_closed"]
    assert (r["ci_low"], r["ci_high"]) == (pytest.approx(found[int(0.025 * (len(found) - 1))]), pytest.approx(found[int(0.975 * (len(found) - 1))]))
    left = {r["omitted"]: r for r in rows(resampling.leave_one_out(df, weighted))}
    for name in names:
        assert left[name]["estimate"] == pytest.approx(plain([p for c in names if c != name for p in data[c]])) and not left[name]["fail_closed"]


def test_statistics_fail_closed(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 0.0), ("b", 3.0, 0.0)], "cluster string, x double, y double")
    (r,) = rows(resampling.statistic_bootstrap(df, resampling.weighted_auc, 400))
    assert r["fail_closed"] and r["ci_low"] is None and 100 < r["degenerate"] < 300 and r["estimate"] == 0.0
    assert all(r["estimate"] is None and r["fail_closed"] for r in rows(resampling.leave_one_out(df, resampling.weighted_auc)))
    (m,) = rows(resampling.statistic_bootstrap(df, resampling.weighted_mean, 400))
    assert m["estimate"] == 2.0 and m["degenerate"] == 0 and m["ci_low"] == 1.0 and m["ci_high"] == 2.5
    with pytest.raises(Exception, match="two clusters"):
        rows(resampling.statistic_bootstrap(df.where("cluster = 'a'"), resampling.weighted_mean, 10))
    with pytest.raises(ValueError):
        resampling.statistic_bootstrap(df, resampling.weighted_mean, 0)


RATING = "row_id string, episode_id string, cluster string, valid boolean, outcome int, invalid_reason string, duplicate_of string"


def endpoint(spark):
    good = [(f"r{k}", f"e{k}", f"c{k % 4}", True, k % 3 % 2, None, None) for k in range(12)] + [("d0", "e0", "c0", True, 0, None, "r0")]
    locked = spark.createDataFrame([(f"e{k}", f"c{k % 4}") for k in range(12)], "episode_id string, cluster string")
    scores = spark.createDataFrame([(f"e{k}", float(k % 5)) for k in range(12)], "episode_id string, score double")
    return good, locked, scores


def test_endpoints_need_complete_ratings(spark):
    good, locked, scores = endpoint(spark)
    frame = lambda data: spark.createDataFrame(data, RATING)
    assert rows(endpoints.rating_findings(frame(good), locked)) == []
    receipt = lambda data=good, s=scores, **a: rows(endpoints.endpoint_receipt(frame(data), locked, s, "e", samples=200, **a))[0]
    one = receipt()
    assert one["locked"] == one["valid"] == 12 and one["class_1"] == 4 and one["estimate"] == pytest.approx(auc([(k % 5, k % 3 % 2) for k in range(12)])) and receipt()["receipt_sha256"] == one["receipt_sha256"]
    other = [(*r[:4], 1 - r[4], *r[5:]) if r[0] == "r5" else r for r in good]
    assert receipt(other)["rows_sha256"] != one["rows_sha256"] and receipt(other)["receipt_sha256"] != one["receipt_sha256"]
    fails = {
        "base rows do not fill": [r for r in good if r[0] != "r3"], "locked denominator": good + [("again", "e3", "c3", True, 1, None, None)],
        "too few rows of class 1": [(*r[:4], 0, *r[5:]) for r in good],
    }
    for text, data in fails.items():
        with pytest.raises(Exception, match=text):
            receipt(data)
    with pytest.raises(Exception, match="scores do not fill"):
        receipt(s=scores.where("episode_id <> 'e7'"))
    with pytest.raises(Exception, match="too few clusters of class 1"):
        receipt(least_clusters=9)
    with pytest.raises(Exception, match="no locked episodes"):
        rows(endpoints.endpoint_receipt(frame(good), locked.limit(0), scores, "e", samples=10))


def test_findings_of_ratings(spark):
    good, locked, _ = endpoint(spark)
    bad = [r for r in good if r[0] not in ("r1", "r2", "r3", "d0")] + [
        ("r1", "e1", "c9", True, 1, None, None), ("r2", "e2", "c2", False, 1, "", None), ("r4", "e4", "c0", True, 0, None, None), ("x", "nowhere", "c0", True, None, "why", None), ("d0", "e0", "c0", True, 0, None, "r99"), ("d5", "e6", "c2", True, 0, None, "r5"), ("n", "e7", "c3", None, None, "lost", "r7"),
    ]
    got = {(r["subject"], r["finding"]) for r in rows(endpoints.rating_findings(spark.createDataFrame(bad, RATING), locked))}
    assert got == {
        ("r1", "other-cluster"), ("r2", "invalid-with-outcome"), ("r2", "invalid-without-reason"), ("r4", "repeated-row-id"), ("e4", "several-base-rows"), ("e3", "no-base-row"), ("x", "episode-not-locked"), ("x", "valid-without-outcome"), ("x", "valid-with-reason"),
        ("d0", "duplicate-of-no-base-row"), ("d5", "duplicate-of-another-episode"), ("n", "valid-not-stated"),
    }


def test_ontologies_of_any_depth(spark):
    chain = [(f"n{k}", f"n{k - 1}" if k else None) for k in range(1000)]
    rings = [("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("below", "r1"), ("self", "self"), ("lost", "nowhere"), ("n5", "n4")]
    df = spark.createDataFrame(chain + rings, "concept string, parent string")
    edges = lambda d: d.withColumnRenamed("concept", "child")
    assert {r["concept"] for r in rows(concepts.cyclic_concepts(edges(df)))} == {"r0", "r1", "r2", "self"}
    assert rows(concepts.cyclic_concepts(edges(spark.createDataFrame(chain, df.schema)))) == [] and rows(concepts.cyclic_concepts(edges(df.limit(0)))) == []
    needs = spark.createDataFrame([("n1", "wing", "necessary"), ("n2", "beak", "vital"), ("n3", "tail", None), ("gone", "tail", "common")], "concept string, feature string, tier string")
    relations = spark.createDataFrame([("on", "under"), ("under", "on"), ("by", "past"), ("at", None)], "relation string, inverse string")
    questions = spark.createDataFrame([("q1",), ("q1",), ("q2",), (None,), ("",)], "question string")
    assert sorted((r["subject"], r["finding"]) for r in rows(concepts.ontology_findings(df, needs, relations, questions))) == sorted([
        ("lost", "unknown-parent"), ("n5", "stated-twice"), *((c, "cycle") for c in ("r0", "r1", "r2", "self")), ("n2", "unknown-tier"), ("n3", "unknown-tier"), ("gone", "requirement-of-no-concept"), ("by", "unknown-inverse"), ("q1", "repeated-question"), ("", "question-without-name"),
    ])
    depth = {(r["concept"], r["ancestor"]): r["depth"] for r in rows(concepts.ancestors(edges(spark.createDataFrame(chain[:200], df.schema))))}
    assert len(depth) == 200 * 201 // 2 and depth["n199", "n0"] == 199


def test_scenes_are_composed_of_what_fits(spark):
    animals = spark.createDataFrame([("heron", "bird", ["wing", "beak"])], "concept string, class string, features array<string>")
    objects = spark.createDataFrame([("cart", "wheeled", ["wheel"]), ("kite", "flying", ["tail"])], animals.schema)
    relations = spark.createDataFrame([("pulls", ["wheeled"], ["rope"]), ("near", [], [])], "relation string, allowed_classes array<string>, features array<string>")
    wanted = spark.createDataFrame([("heron", "cart", "pulls"), ("heron", "kite", "pulls"), ("heron", "kite", "near"), ("owl", "cart", "near"), ("heron", "sled", "near"), ("heron", "cart", "eats")], "animal string, object string, relation string")
    got = {(r["animal"], r["object"], r["relation"]): (r["problem"], r["animal_features"], r["object_features"], r["relation_features"]) for r in rows(concepts.compose_scenes(wanted, animals, objects, relations))}
    assert got["heron", "cart", "pulls"] == (None, ["beak", "wing"], ["wheel"], ["rope"]) and got["heron", "kite", "near"] == (None, ["beak", "wing"], ["tail"], [])
    assert {k: v[0] for k, v in got.items() if v[0]} == {("heron", "kite", "pulls"): "class-not-allowed", ("owl", "cart", "near"): "unknown-animal", ("heron", "sled", "near"): "unknown-object", ("heron", "cart", "eats"): "unknown-relation"}


def test_judges_as_table_functions(spark):
    tasks = spark.sql("SELECT 't1' AS task_id, array('wing') AS animal_features, array('wheel') AS object_features, array(named_struct('predicate', 'on', 'required', true)) AS relations, 'h1' AS render_hash")
    renders = spark.createDataFrame([("h1", bytearray(b"abc"))], "render_hash string, image binary")
    questions = assessments.task_questions(tasks)
    ids = {r["question_id"]: r["critical"] for r in rows(questions)}
    assert ids == {"animal-present": True, "object-present": True, "animal-feature:wing": False, "object-feature:wheel": False, "relation:on": True, "scene-coherent": False}

    def broken(image, question):
        if question == "scene-coherent":
            raise KeyError("no answer")
        return 2.0 if question == "relation:on" else 0.5, "half"

    judges = [assessments.judge(lambda image, question: (len(image) / 4, question), "steady", "1"), assessments.judge(broken, "broken", "2")]
    got = rows(assessments.ask(questions, renders, judges))
    said = {(r["judge_id"], r["question_id"]): (r["probability"], r["rationale"]) for r in got}
    assert len(got) == 12 and said["steady", "relation:on"] == (0.75, "relation:on") and said["broken", "animal-present"] == (0.5, "half")
    assert said["broken", "scene-coherent"] == (None, "KeyError: 'no answer'") and said["broken", "relation:on"][0] is None
    answers = spark.createDataFrame([(r["task_id"], r["render_hash"], r["question_id"], r["judge_id"], r["judge_revision"], r["probability"], True) for r in got], "task_id string, render_hash string, question_id string, judge_id string, judge_revision string, probability double, source_independent boolean")
    agreed = assessments.ensembles(answers, spark.createDataFrame([("steady", 3.0)], "judge_id string, weight double"))
    assert {r["question_id"]: (r["probability"], r["judges"]) for r in rows(agreed)}["animal-present"] == (pytest.approx((3 * 0.75 + 0.5) / 4), 2)
    (one,) = rows(assessments.assessments(agreed, tasks))
    assert one["complete"] and one["assessment_id"].startswith("sem:") and len(one["answers"]) == 6
    (less,) = rows(assessments.assessments(agreed.where("question_id <> 'relation:on'"), tasks))
    assert not less["complete"] and less["assessment_id"] != one["assessment_id"]
    with pytest.raises(Exception, match="positive value"):
        rows(assessments.ensembles(answers, spark.createDataFrame([("steady", -1.0), ("broken", 1.0)], "judge_id string, weight double")))
    extra = spark.createDataFrame([("t1", "h2", "animal-present", "steady", "1", 0.5, True), ("t1", "h1", "sky", "steady", "1", 0.5, None), ("t9", "h1", "sky", "steady", "1", float("nan"), True)], answers.schema)
    found = {(r["task_id"], r["judge_id"], r["question_id"], r["finding"]) for r in rows(assessments.answer_findings(answers.where("not (judge_id = 'steady' and question_id = 'object-present')").union(extra), tasks))}
    assert found == {
        ("t1", "broken", "scene-coherent", "no-probability"), ("t1", "broken", "relation:on", "no-probability"), ("t1", "steady", "object-present", "critical-question-missing"), ("t1", "steady", "animal-present", "other-render"), ("t1", "steady", "animal-present", "repeated-question"),
        ("t1", "steady", "sky", "unknown-question"), ("t1", "steady", "sky", "saw-the-source"), ("t9", "steady", "sky", "unknown-task"), ("t9", "steady", "sky", "no-probability"),
    }


def test_parts_of_public_texts_do_not_go_through_the_driver(spark):
    private = blinding.aliases(models(spark, [f"model {k}" for k in range(50)] + ["é"]), SECRET, "S1").persist()
    head, public = blinding.header(private, SECRET, "S1", "sha256:0"), blinding.public_list(private, SECRET, "S1")
    check = blinding.verification(public, private, head, head, SECRET)
    plan = check._jdf.queryExecution().optimizedPlan().toString()
    assert rows(check)[0]["passed"] and re.search(r"Join LeftSemi, .*strategy=merge", plan)
    for text, hidden in (("SYS-F", True), ("xmodel 49x", False), ("model", True), ("aéb", False), ("", True), ("e", True)):
        (r,) = rows(blinding.verification(public.withColumn("alias", F.when(F.col("position") == 1, text).otherwise(F.col("alias"))), private, head, head, SECRET))
        assert r["names_hidden"] is hidden, text


def test_logs_are_appended_and_replayed(spark):
    rng = random.Random(6)
    schema = "campaign_id long, position long, cell_id string, new_state string, reason string, cost double, artifact_id string"
    states = ["leased", "succeeded", "failed", "ready", "quarantined", "cancelled", "odd", None]
    data = [(k % 3, k, f"x{rng.randrange(8)}", rng.choice(states[:4] if k % 4 else states), rng.choice(["why", "why", "why", " ", None]), rng.choice([0.0, 1.25, 1.25, -1.0, None]) if k % 5 == 0 else 0.5, rng.choice(["a", None])) for k in range(400)]
    state, log, want = {}, {}, {}
    for c, p, cell, new, reason, cost, art in data:
        now = state.get((c, cell), "ready")
        if new not in ledger.TRANSITIONS.get(now, ()):
            want[p] = f"illegal-transition:{now}>{new or ''}"
        elif cost is None or cost < 0:
            want[p] = "cost-below-zero"
        elif not (reason or "").strip():
            want[p] = "no-reason"
        elif new == "succeeded" and art is None:
            want[p] = "no-artifact"
        else:
            state[c, cell] = new
            chain = log.setdefault(c, [ledger.GENESIS])
            text = "\x1f".join([chain[-1], str(len(chain) - 1), cell, new, reason, str(round(cost * 1e6)), art or ""])
            chain.append(hashlib.sha256(text.encode()).hexdigest())
            want[p] = (len(chain) - 2, chain[-2], chain[-1])
    out = ledger.appended(spark.createDataFrame(data, schema)).persist()
    assert {r["position"]: r["refused"] or (r["sequence"], r["previous_event_hash"], r["event_hash"]) for r in rows(out)} == want
    events = out.where("refused is null")
    assert rows(ledger.hash_findings(events)) == [] and max(len(v) for v in log.values()) > 15
    hurt = events.where("not (campaign_id = 1 and sequence = 4)").withColumn("cost", F.when((F.col("campaign_id") == 2) & (F.col("sequence") == 3), 9.0).otherwise(F.col("cost"))).withColumn("previous_event_hash", F.when((F.col("campaign_id") == 0) & (F.col("sequence") == 6), "f" * 64).otherwise(F.col("previous_event_hash")))
    assert {(r["campaign_id"], r["sequence"], r["finding"]) for r in rows(ledger.hash_findings(hurt))} == {(1, 5, "gap"), (2, 3, "hash-drift"), (0, 6, "chain-drift"), (0, 6, "hash-drift")}


def test_long_logs_are_folded_with_one_state(spark):
    schema = "campaign_id long, position long, cell_id string, new_state string, reason string, cost double, artifact_id string"
    data = [(1, k // 2 * 2, f"x{k % 2}", "leased" if k // 2 % 2 == 0 else "ready", "why", 0.5, None) for k in range(10_000)]  # two events at each position
    out = ledger.appended(spark.createDataFrame([*data, (None, 3, "y", "leased", "why", 0.5, None)], schema))
    assert not {"collect_list", "Join"} & set(re.findall("collect_list|Join", out._jdf.queryExecution().optimizedPlan().toString()))
    found = sorted(rows(out.where("campaign_id = 1")), key=lambda r: r["sequence"])
    assert [(r["sequence"], r["position"], r["cell_id"], r["refused"]) for r in found] == [(k, *d[1:3], None) for k, d in enumerate(data)]
    assert rows(ledger.hash_findings(out.where("campaign_id = 1"))) == []
    assert [(r["refused"], r["sequence"], r["event_hash"]) for r in rows(out.where("campaign_id is null"))] == [(None, None, None)]


def test_receipts_of_sessions(spark):
    a, b, c = sessions.STAGES
    schema = "assignment_id string, position long, stage string, artifact_id string, response string"
    data = [("s", 1, b, "art", "early"), ("s", 2, a, "art", "{}"), ("s", 3, a, "art", "twice"), ("s", 4, b, "art", "[1]"), ("s", 5, c, "art", "x"), ("t", 9, a, "art", "{}")]
    found = sessions.receipts(spark.createDataFrame(data, schema)).persist()
    previous, want = None, []
    digest = lambda t: "sha256:" + hashlib.sha256(t.encode()).hexdigest()
    for position, stage, response in ((2, a, "{}"), (4, b, "[1]"), (5, c, "x")):
        own = digest("\x1f".join(["s", "art", stage, digest(response), previous or ""]))
        want.append(("s", position, stage, digest(response), previous, own))
        previous = own
    got = [(r["assignment_id"], r["position"], r["stage"], r["response_hash"], r["previous_receipt_hash"], r["receipt_hash"]) for r in rows(found)]
    assert sorted(x for x in got if x[0] == "s") == want and len(got) == 4 and rows(sessions.receipt_findings(found)) == []
    hurt = lambda d: sorted((r["assignment_id"], r["stage"], r["finding"]) for r in rows(sessions.receipt_findings(d)))
    assert hurt(found.where(f"stage <> '{b}'")) == [("s", c, "stage-missing")]
    assert hurt(found.withColumn("response_hash", F.when(F.col("position") == 4, "sha256:0").otherwise(F.col("response_hash")))) == [("s", b, "hash-drift")]
    assert hurt(found.withColumn("previous_receipt_hash", F.when(F.col("position") == 9, "sha256:0").otherwise(F.col("previous_receipt_hash")))) == [("t", a, "chain-drift"), ("t", a, "hash-drift")]


def test_sealed_challenges(spark):
    tasks = spark.createDataFrame([(k, f"task {k}") for k in range(6)], "position long, task string")
    whole = release.sealed(tasks, "v1", "secret").persist()
    public, shown = whole.select("position", "commitment"), whole.select("position", "task", "salt")
    verdict = lambda p, r, **a: rows(release.challenge_verification(p, r, **a))[0]
    full = verdict(public, shown, whole=True)
    assert full["valid"] and full["full"] and full["committed"] == full["revealed"] == 6 and full["commitment"] == verdict(public.orderBy(F.desc("position")), shown)["commitment"]
    part = verdict(public, shown.where("position < 4"))
    assert part["valid"] and not part["full"] and not verdict(public, shown.where("position < 4"), whole=True)["valid"]
    moved = shown.withColumn("position", F.when(F.col("position") < 2, 1 - F.col("position")).otherwise(F.col("position")))
    assert {(r["position"], r["finding"]) for r in rows(release.reveal_findings(public, moved, True))} == {(0, "committed-elsewhere"), (1, "committed-elsewhere")}
    other = release.sealed(tasks, "v1", "another").select("position", "task", "salt").where("position = 3")
    assert {(r["position"], r["finding"]) for r in rows(release.reveal_findings(public, shown.union(other)))} == {(3, "never-committed"), (3, "revealed-twice")}
    commitments = {r["commitment"] for r in rows(public)}
    assert len(commitments | {r["commitment"] for r in rows(release.sealed(tasks, "v2", "secret"))}) == 12


def test_readiness_needs_evidence(spark):
    make = lambda data, schema: spark.createDataFrame(data, schema)
    required = make([("p", "c1", "E2"), ("p", "c2", "E2"), ("q", "c1", "E3"), ("r", "c9", "E0"), ("s", "c3", "E1")], "profile string, claim_id string, least_level string")
    claims = make([("c1", "E2", "done"), ("c2", "E4", "done"), ("c3", "E9", "done")], "claim_id string, level string, status string")
    evidence = make([("c1", "a.json"), ("c2", "b.json"), ("b1", "a.json"), ("k1", "c.json")], "subject string, path string")
    artifacts = make([("a.json",), ("b.json",)], "path string")
    got = lambda art=artifacts, cl=claims: {(r["profile"], r["claim_id"]): (r["missing_evidence"], r["error"], r["satisfied"]) for r in rows(release.claim_results(required, cl, evidence, art))}
    assert got() == {("p", "c1"): (0, None, True), ("p", "c2"): (0, None, True), ("q", "c1"): (0, None, False), ("r", "c9"): (0, "unknown-claim", False), ("s", "c3"): (0, "unknown-level", False)}
    assert got(artifacts.where("path = 'b.json'"))["p", "c1"] == (1, None, False) and got(cl=claims.withColumn("status", F.lit(None).cast("string")))["p", "c1"][2] is False
    blockers = make([("b1", "closed", ["p", "q"]), ("b2", "partial", ["q"]), ("b3", "closed", [])], "blocker_id string, status string, profiles array<string>")
    criteria = make([("b3", "k1", "complete"), ("b1", "k2", "complete")], "blocker_id string, criterion_id string, status string")
    judge = lambda cr, ev: {r["profile"]: (r["blocking"], r["lacking"], r["ready"]) for r in rows(release.readiness(release.claim_results(required, claims, ev, artifacts), release.blocker_results(blockers, cr, ev, artifacts)))}
    assert judge(criteria, evidence) == {"p": (0, 1, False), "q": (1, 1, False), "r": (0, 1, False), "s": (0, 1, False)}
    assert judge(criteria, evidence.where("subject <> 'k1'"))["p"] == (0, 0, True)
    assert judge(criteria.union(make([("b1", "k3", None)], criteria.schema)), evidence.where("subject <> 'k1'"))["p"] == (1, 0, False)


def test_permutations_by_products(spark):
    data = [("a", 1.0, 2.0), ("b", 2.0, 1.0), ("c", 3.0, 4.0), ("d", 4.0, 5.0), ("e", 5.0, 3.0)]
    (r,) = rows(resampling.randomisation_test(spark.createDataFrame(data, "cluster string, score double, outcome double")))
    y = [x[2] for x in data]
    rho = lambda p: spearman([(x[1], v) for x, v in zip(data, p, strict=True)])
    assert r["rho"] == pytest.approx(rho(y)) and r["method"] == "exact" and r["p_value"] == pytest.approx(np.mean([abs(rho(p)) >= abs(rho(y)) - 1e-12 for p in itertools.permutations(y)]))
