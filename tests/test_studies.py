"""Calibration studies, execution records, judge plans, repairs, custody, places of entities."""

import hashlib
import hmac
import random
import re

import pytest
from pyspark.sql import functions as F

from brightloom.functions import contracts, mutations, vector_source
from brightloom.operators import annotate, calibration, concepts, integrity, ledger, qualification, ratings, scorecard, series, sessions, tasks
from brightloom.sources import records


def rows(df):
    return [r.asDict() for r in df.collect()]


RESPONSE = "stage string, response map<string,string>, artifact_id string, duplicate_group_id string, expected_animal string, expected_mobile_object string, expected_relation string"


def test_calibration_responses_by_stage(spark):
    blind = {"animal_open_text": "Pelican", "mobile_object_open_text": "go_kart", "relation_open_text": "on", "recognition_confidence": "80"}
    criteria = {f: "none" for f in ("animal_defects", "object_defects", "interaction_defects")} | dict.fromkeys(calibration.RATINGS, "4") | {"criterion_confidence": "50"}
    cases = [
        ("blind-recognition", blind, ([], [], [])),
        ("blind-recognition", blind | {"recognition_confidence": "101"}, ([], ["recognition_confidence"], [])),
        ("blind-recognition", blind | {"recognition_confidence": "nan", "animal_open_text": "", "relation_open_text": "[]"}, (["animal_open_text", "relation_open_text"], ["recognition_confidence"], [])),
        ("blind-recognition", blind | {" User_Agent ": "x", "participant_id": "7"}, ([], [], ["participant_id", "user_agent"])),
        ("prompt-aware-criteria", criteria, ([], [], [])),
        ("prompt-aware-criteria", criteria | {"object_rating_1_to_5": "2.5", "animal_rating_1_to_5": "6"}, ([], ["animal_rating_1_to_5", "object_rating_1_to_5"], [])),
        ("pairwise-preference", {"pairwise_winner": " A "}, ([], [], [])),
        ("pairwise-preference", {"pairwise_winner": "both"}, ([], ["pairwise_winner"], [])),
        ("pairwise-preference", {}, (["pairwise_winner"], ["pairwise_winner"], [])),
        ("another", {}, ([], [], [])),
    ]
    df = spark.createDataFrame([(s, r, str(k), None, None, None, None) for k, (s, r, _) in enumerate(cases)], RESPONSE)
    for r in rows(calibration.validated(df)):
        stage, _, want = cases[int(r["artifact_id"])]
        assert (r["missing_fields"], r["invalid_fields"], r["prohibited_fields"]) == want, stage
        assert r["valid"] == (want == ([], [], []) and stage != "another")


def test_calibration_analysis(spark):
    blind = lambda a, c, group=None, art="x", shown="pelican": ("blind-recognition", {"animal_open_text": a, "mobile_object_open_text": "Go_Kart", "relation_open_text": "on", "recognition_confidence": c}, art, group, shown, "go-kart", "on")
    data = [blind("Pelican", "100", "g"), blind(" heron ", "50", "g"), blind("pelican", "0", None, "y", None), ("pairwise-preference", {"pairwise_winner": "A"}, "z", None, None, None, None), ("pairwise-preference", {"pairwise_winner": "a"}, "z", None, None, None, None), ("odd", {}, None, None, None, None, None)]
    got = {(r["figure"], r["name"]): r["value"] for r in rows(calibration.analysis(spark.createDataFrame(data, RESPONSE)))}
    assert got["responses", "received"] == 6 and got["responses", "valid"] == 5 and got["responses", "invalid"] == 1 and got["stage", "blind-recognition"] == 3
    assert got["accuracy", "animal_open_text"] == 0.5 and got["accuracy", "mobile_object_open_text"] == 1 and got["accuracy", "scene"] == 0.5
    assert got["brier", "recognition"] == pytest.approx((0 + 0.25) / 2) and (got["winner", "A"], got["winner", "a"]) == (1, 1)
    assert got["duplicate-consistency", "animal_open_text"] == 0 and got["duplicate-consistency", "relation_open_text"] == 1
    assert got["alpha", "animal_open_text"] == pytest.approx(0) and got["alpha", "relation_open_text"] == 1
    empty = {(r["figure"], r["name"]): r["value"] for r in rows(calibration.analysis(spark.createDataFrame([], RESPONSE)))}
    assert empty["responses", "received"] == 0 and empty["accuracy", "scene"] == 0 and ("alpha", "animal_open_text") not in empty


def test_execution_records_against_events(spark):
    e = "campaign_id string, cell_id string, lease_token string, attempt int, worker_id string, new_state string, reason string, artifact_id string, actual_cost double"
    events = spark.createDataFrame([
        ("c", "1", "t", 1, "w", "succeeded", "ok", "a", 0.5), ("c", "2", "t", 1, "w", "failed", "no", None, 0.1), ("c", "3", "t", 1, "w", "succeeded", "ok", "a", 0.5), ("c", "4", "t", 1, "w", "leased", "", None, 0.0),
        ("c", "5", "t", 1, None, "failed", "", None, 0.0), ("c", "6", None, 1, "w", "failed", "", None, 0.0), ("c", "7", "t", 1, "w", "succeeded", "ok", "a", 0.5), ("c", "7", "t", 1, "w", "succeeded", "ok", "a", 0.5),
    ], e)
    records_ = spark.createDataFrame([
        ("c", "1", "t", 1, "w", "succeeded", "ok", "a", 0.5 + 1e-9), ("c", "2", "t", 1, "v", "failed", "no", None, 0.2), ("c", "8", "t", 2, "w", "failed", "", None, 0.0), ("c", "7", "t", 1, "w", "succeeded", "ok", "a", None),
    ], e.replace("new_state", "terminal_state").replace("reason", "terminal_reason").replace("actual_cost", "charged_cost"))
    got = sorted((r["cell_id"], r["finding"]) for r in rows(ledger.reconcile_executions(events, records_)))
    assert got == [("2", "cost-mismatch"), ("2", "field-mismatch:worker_id"), ("3", "event-without-record"), ("6", "event-without-token"), ("7", "duplicate-event"), ("7", "invalid-cost"), ("8", "record-without-event")]


def plain_lease(cells, limit, cap, budget, active, reserved, spent):
    taken = []
    for cell, model, cost in cells:
        if len(taken) < limit and active.get(model, 0) < cap and spent + reserved + cost <= budget:
            active[model] = active.get(model, 0) + 1
            reserved += cost
            taken.append(cell)
    return taken


def test_lease_counts_what_is_held_and_spent(spark):
    rng = random.Random(2)
    data = [(f"c{i:03}", "s", rng.choice("abcd"), f"t{i:03}", 1, "ready", rng.randrange(1, 30) / 16) for i in range(120)]
    cells = spark.createDataFrame(data, "cell_id string, stage_id string, model_id string, task_id string, replicate int, state string, estimated_cost double")
    held = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("b", 1.0)], "model_id string, estimated_cost double")
    order = [(c, m, x) for c, s, m, t, r, _, x in sorted(data, key=lambda d: (d[1], d[2], d[3], d[4]))]
    for limit, cap, budget, spent in ((50, 6, 12.0, 1.5), (3, 9, 99.0, 0.0), (50, 2, 99.0, 0.0), (50, 40, 2.5, 0.0)):
        want = plain_lease(order, limit, cap, budget, {"a": 2, "b": 1}, 2.0, spent)
        for batch in (4, 5000):
            assert sorted(r["cell_id"] for r in rows(ledger.lease(cells, limit, cap, budget, held, spent, batch))) == sorted(want)


def test_judge_plan_and_profiles(spark):
    judges = spark.createDataFrame([("j1", "f1", ["anatomy", "scene"]), ("j2", "f1", ["scene"])], "judge_id string, family string, roles array<string>")
    canaries = spark.createDataFrame([("k1", "a1", ["scene"]), ("k2", "a2", ["anatomy", "scene", "scene"])], "canary_id string, artifact_id string, applicable_roles array<string>")
    cells = rows(qualification.judge_plan(judges, canaries))
    assert sorted((c["judge_id"], c["role"], c["canary_id"]) for c in cells) == [("j1", "anatomy", "k2"), ("j1", "scene", "k1"), ("j1", "scene", "k2"), ("j2", "scene", "k1"), ("j2", "scene", "k2")]
    assert len({c["cell_id"] for c in cells}) == 5
    enough = {r["role"]: (r["families"], r["satisfied"]) for r in rows(qualification.judge_diversity(judges, spark.createDataFrame([("scene", 1), ("anatomy", 2), ("other", 1)], "role string, minimum int")))}
    assert enough == {"scene": (1, True), "anatomy": (1, False), "other": (0, False)}
    models = spark.createDataFrame([("m1",), ("m2",), ("m3",)], "model_id string")
    profiles = spark.createDataFrame([("p", ["m1"]), ("q", ["m2"])], "profile_id string, model_ids array<string>")
    assert {r["model_id"]: r["profile_id"] for r in rows(qualification.runtime_profiles(models, profiles))} == {"m1": "p", "m2": "q", "m3": None}
    with pytest.raises(Exception, match="several profiles list m1"):
        rows(qualification.runtime_profiles(models, profiles.union(profiles.selectExpr("'r'", "array('m1')"))))
    proposed = spark.createDataFrame([("machine-proposed", 0.9), ("machine-proposed", 0.2), ("accepted", 0.9)], "review_status string, confidence double")
    assert qualification.reviewable(proposed, 0.5).count() == 1 and qualification.replicate_wave(7, 113, 3, 5) == (2, 1582)
    with pytest.raises(ValueError):
        qualification.replicate_wave(1, 1, 3, 3)


def test_repair_assessment(spark):
    df = spark.createDataFrame([(["wing", "body"], ["wing", "foot", "foot"], [(["foot"], ["wing", "body"]), ([], [])])], "b array<string>, a array<string>, r array<struct<target_roles:array<string>,preserve_roles:array<string>>>")
    r = df.select(scorecard.repair_assessment(F.col("b"), F.col("a"), F.col("r")).alias("x")).first()["x"]
    assert r["before_score"] == pytest.approx((0.3 + 0.3) / 2) and r["after_score"] == pytest.approx((0.7 + 0.15 + 0.3) / 2) and r["improvement"] == pytest.approx(0.275)
    assert r["repaired_fraction"] == 0.5 and r["preservation_fraction"] == 0.5 and r["new_defects"] == ["lost:body"]


def test_custody_schedule_by_hmac(spark):
    secret, ids = bytes(range(40)), [f"r{i}" for i in range(96)]
    mac = lambda domain, value: hmac.new(secret, f"{domain}\x1f{value}".encode(), hashlib.sha256).hexdigest()
    twice = set(sorted(ids, key=lambda v: mac("selection", v))[:10])
    listed = [(i, o) for i in ids for o in (("primary", "duplicate-1") if i in twice else ("primary",))]
    listed.sort(key=lambda x: mac("order", f"order\x1f{x[0]}\x1f{x[1]}"))
    got = sorted(rows(integrity.custody_schedule(spark.createDataFrame([(i,) for i in ids], "repair_id string"), secret)), key=lambda r: r["ordinal"])
    assert [(r["repair_id"], r["occurrence"]) for r in got] == listed and len(got) == 106 and sum(r["is_duplicate"] for r in got) == 10
    assert all(r["episode_alias"] == "episode-" + mac("alias", r["repair_id"])[:16] for r in got) and len({r["assignment_alias"] for r in got}) == 106
    with pytest.raises(ValueError):
        integrity.custody_schedule(spark.createDataFrame([("r",)], "repair_id string"), b"short")


def test_entities_have_places(spark):
    texts = ["😀 Pelican-bike tuk-tuk; écat birds BIRD\ncontact sheet", "", None, "bird " * 700 + "wheel", "no_bird bird_ bird1"]
    got = rows(annotate.annotate_documents(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "id int, text string, source string"), source="source"))
    for r in got:
        want = sorted((m.start(), m.end(), label) for label, terms in annotate.ENTITY_TERMS.items() for t in terms for m in re.finditer(rf"\b{re.escape(t)}\b", r["text"] or "", re.I))
        assert [(e["start"], e["end"], e["label"]) for e in r["entities"]] == want
        assert all(e["text"] == r["text"][e["start"] : e["end"]] for e in r["entities"])
        assert r["entity_counts"]["ANIMAL"] == sum(w[2] == "ANIMAL" for w in want)
    by_id = {r["id"]: r for r in got}
    payload = '{"categories":["mechanics"],"relations":[],"source":"s"}'
    assert by_id[3]["idea_id"] == "idea:" + hashlib.sha256(payload.encode()).hexdigest()[:12] and by_id[1]["text_hash"] == "sha256:" + hashlib.sha256(b"").hexdigest()


def test_readers_trim_and_reject(spark, tmp_path):
    head = "pair_id,task_id,criterion,left_artifact_id,right_artifact_id,winner,rater_hash\n"
    (tmp_path / "v.csv").write_text(head + f"p,t,c, a ,b, Left ,{'AB' * 8} \np,t,c,a,b,B, {'ab' * 8}\np,t,c,a, a,A,{'ab' * 8}\n")
    good, bad = records.read_votes(spark, str(tmp_path / "v.csv"))
    assert {r["rater_hash"] for r in good.collect()} == {"ab" * 8} and sorted(r["side"] for r in good.collect()) == ["left", "right"] and bad.count() == 1
    for column in records.VOTE_SENSITIVE:
        (tmp_path / f"{column}.csv").write_text(head.replace("pair_id", f"{column},pair_id"))
        with pytest.raises(ValueError, match=column):
            records.read_votes(spark, str(tmp_path / f"{column}.csv"))
    assert records.plain_text("<p>a</p><p>b</p><script>var x='</p>'</script>c&amp;d<!-- no -->\n e") == "a b var x='</p>' c&d e" and records.plain_text(None) is None


def test_prompt_coverage_is_of_distinct_prompts(spark):
    p = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "prompt string")
    (r,) = rows(annotate.prompt_coverage(p, spark.createDataFrame([("a",), ("z",)], "prompt string")))
    assert (r["prompts"], r["exact_matches"], r["exact_coverage"]) == (3, 1, pytest.approx(1 / 3))
    assert rows(annotate.prompt_coverage(p.limit(0), p))[0]["exact_coverage"] == 0


def test_unsafe_paints_are_found():
    ns = 'xmlns="http://www.w3.org/2000/svg"'
    assert vector_source.inspect(f'<svg {ns}><rect fill="url(#a)" mask="url( #m )"/></svg>')["valid"]
    for bad in ('<rect fill="url(http://x/y)"/>', '<g src="https://x"/>', '<rect stroke="url(other.svg#a)"/>', '<g filter="url(#a) blur(2px)"/>', '<g mask="data:x"/>', '<g clip-path="//x"/>'):
        assert not vector_source.inspect(f"<svg {ns}>{bad}</svg>")["valid"], bad
    shown = vector_source.inspect(f'<svg {ns}><g opacity="5"><rect opacity="-1"/><rect/></g><line stroke="red" stroke-width="0"/><line stroke="red"/></svg>')
    assert (shown["visible_shapes"], shown["hidden_shapes"]) == (2, 2)


def test_sessions_accept_stages_in_order(spark):
    rng = random.Random(3)
    data = [(a, p, rng.choice([*sessions.STAGES, "debrief"])) for a in range(40) for p in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(data, "assignment_id long, position long, stage string")
    bad, state = set(), {}
    for a, p, s in data:
        done = state.setdefault(a, 0)
        if s == "debrief":
            bad.add((a, p, "not-of-this-session"))
        elif sessions.STAGES.index(s) == done:
            state[a] += 1
        else:
            bad.add((a, p, "already-locked" if sessions.STAGES.index(s) < done else "out-of-order"))
    assert {(r["assignment_id"], r["position"], r["finding"]) for r in rows(sessions.stage_findings(df))} == bad
    for r in rows(sessions.disclosure(df)):
        done = state[r["assignment_id"]]
        assert r["stages_done"] == done and r["next_stage"] == (sessions.STAGES + (None,))[done] and r["prompt_disclosed"] == (done > 0)


def test_rating_chains(spark):
    def chain(session, aliases):
        out, previous = [], ledger.GENESIS
        for k, alias in enumerate(aliases, 1):
            digest = hashlib.sha256("\x1f".join([previous, str(k), alias, f"rating {k}"]).encode()).hexdigest()
            out.append((session, k, alias, f"rating {k}", previous, digest))
            previous = digest
        return out

    data = chain("s", ["a", "b", "c", "d"]) + chain("t", ["a", "b", "a"])
    schema = "session_id string, sequence long, assignment_alias string, payload string, previous_hash string, entry_hash string"
    allowed = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "assignment_alias string")
    find = lambda d, ok=allowed: sorted((r["session_id"], r["sequence"], r["finding"]) for r in rows(sessions.chain_findings(spark.createDataFrame(d, schema), ok)))
    assert find(data) == [("t", 3, "rated-twice")]
    changed = [d if d[:2] != ("s", 2) else (*d[:3], "another rating", *d[4:]) for d in data]
    assert find(changed) == [("s", 2, "hash-drift"), ("t", 3, "rated-twice")]
    assert find([d for d in data if d[:2] != ("s", 2)]) == [("s", 3, "sequence-gap"), ("t", 3, "rated-twice")]
    relinked = [d if d[:2] != ("s", 3) else (*d[:4], "f" * 64, d[5]) for d in data]
    assert find(relinked) == [("s", 3, "chain-drift"), ("s", 3, "hash-drift"), ("t", 3, "rated-twice")]
    assert ("s", 4, "not-in-session") in find(data, allowed.where("assignment_alias <> 'd'"))


def test_source_mutations(spark):
    svg = '<svg xmlns="http://www.w3.org/2000/svg"><g id="a" class=\'b\' fill="red"><rect/></g></svg>'
    df = spark.createDataFrame([("x", svg), ("open", "<svg"), ("none", "")], "source_id string, source string")
    cases = {(r["source_id"], r["case_index"]): r for r in rows(mutations.mutated(df, 13, 1))}
    assert len(cases) == 39 and [cases["x", k]["mutation"] for k in range(13)] == list(mutations.MUTATIONS)
    out = {m: cases["x", k]["source"] for k, m in enumerate(mutations.MUTATIONS)}
    body, end = svg[: -len("</svg>")], "</svg>"
    assert out["event-handler"] == svg.replace("<svg", '<svg onload="alert(1)"', 1) and out["external-css"] == body + mutations.CSS + end
    assert out["entity"] == mutations.ENTITY + svg.replace(end, "<text>&far;</text></svg>") and svg.startswith(out["truncate"]) and len(out["truncate"]) < len(svg)
    groups = re.fullmatch(re.escape(body) + r'((?:<g>)+)<ellipse rx="3" ry="2"/>((?:</g>)+)</svg>', out["nested-groups"])
    assert groups and 100 <= groups[1].count("<g") == groups[2].count("</g>") < 1000
    assert cases["open", 2]["source"] == "<svg" + mutations.CSS and cases["none", 11]["source"] == ""
    rejected = {m for m, s in out.items() if not vector_source.inspect(s)["valid"]}
    assert {"event-handler", "external-image", "external-css", "entity", "truncate"} <= rejected and not {"nested-groups", "path-burst", "off-canvas", "clip-mask"} & rejected
    assert rows(mutations.mutated(df, 13, 1)) == rows(mutations.mutated(df, 13, 1))
    (clean,) = rows(df.where("source_id = 'x'").select(mutations.stripped_labels(F.col("source")).alias("s")))
    assert clean["s"] == '<svg xmlns="http://www.w3.org/2000/svg"><g fill="red"><rect/></g></svg>'
    assert sum(r["cases"] for r in rows(mutations.fuzz_report(df, 13, 1))) == 39


def test_grammar_and_tasks(spark):
    a = spark.createDataFrame([("cat", "Cat", "m", ["rides_on", "flies"], ["ear"], 1), ("cat", "Cat", "m", ["rides_on"], ["ear"], 1)], "id string, label string, animal_class string, interaction_modes array<string>, required_features array<string>, adaptation int")
    o = spark.createDataFrame([("bike", "bike", "k", "saddle", [], ["rides_on"], ["wheel"]), (None, "x", "k", None, [], ["rides_on"], [])], "id string, label string, object_class string, interface_class string, interface_classes array<string>, interaction_modes array<string>, required_features array<string>")
    r = spark.createDataFrame([("rides_on", None, ["k"], ["saddle"], [])], "id string, phrase string, allowed_object_classes array<string>, allowed_interface_classes array<string>, required_contacts array<string>")
    found = sorted((x["part"], x["id"] or "", x["finding"]) for x in rows(tasks.grammar_findings(a, o, r)))
    assert found == [("animals", "cat", "identifier-repeated"), ("animals", "cat", "unknown-mode:flies"), ("objects", "", "identifier-missing"), ("objects", "", "interface-missing")]
    assert ("relations", "", "part-empty") in [(x["part"], x["id"], x["finding"]) for x in rows(tasks.grammar_findings(a, o, r.limit(0)))]
    designs = tasks.compatible_designs(a.limit(1), o, r)
    built = rows(tasks.build_tasks(designs, ["side", "rear"], ["flat icon"], "R", "1", 3))
    assert {t["prompt"] for t in built} == {f"Generate an SVG of a Cat rides on bike, viewed from the {v}, in a flat icon style." for v in ("side", "rear")}
    assert {t["viewpoint"]: t["difficulty"] for t in built} == {"side": 1, "rear": 2} and len({t["task_id"] for t in built}) == 2
    again = rows(tasks.build_tasks(designs, ["side", "rear"], ["flat icon"], "R", "1", 4))
    assert {t["task_id"] for t in again} == {t["task_id"] for t in built} and {t["seed"] for t in again} != {t["seed"] for t in built}
    with pytest.raises(ValueError):
        tasks.drawn_tasks(tasks.build_tasks(designs, ["side"], ["flat icon"], "R", "1", 3), 5, 1)


def test_numbers_among_annotations(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": 2.5, "c": true, "d": "7", "e": null, "f": {"g": 1}, "h": -1e3}'), (2, "{}"), (3, None)], "id int, annotations string")
    assert sorted((r["id"], r["metric"], r["value"]) for r in rows(series.numeric_annotations(df))) == [(1, "a", 1.0), (1, "b", 2.5), (1, "h", -1000.0)]


def test_corpus_sink_and_prompt_records(spark, tmp_path):
    schema = "source_id string, record_id string, title string, url string, published string, updated string, categories array<string>, text string, rights_status string"
    data = [("s", f"r{i}", "t", "u", f"2024-01-0{1 + i % 9}", None, ["c"], f"text {i}" if i % 4 else "", "licensed") for i in range(30)]
    df = spark.createDataFrame(data, schema)
    a, b = (rows(records.write_corpus(df.orderBy(order), str(tmp_path / order)))[0] for order in ("record_id", "title"))
    assert a == b and a["entries"] == 30 and (a["first_published"], a["last_published"]) == ("2024-01-01", "2024-01-09")
    assert rows(records.write_corpus(df.where("record_id <> 'r3'"), str(tmp_path / "less")))[0]["corpus_sha256"] != a["corpus_sha256"]
    assert records.read_jsonl(spark, str(tmp_path / "title"), schema).count() == 30
    prompts = rows(records.prompt_records(df))
    assert len(prompts) == 22 and prompts[0]["metadata"]["title"] == "t"
    quoted = df.withColumn("rights_status", F.lit("quotation-only"))
    assert len(rows(records.prompt_records(quoted))) == 22
    with pytest.raises(Exception, match="export is not permitted"):
        records.write_corpus(quoted, str(tmp_path / "no"))
    with pytest.raises(Exception, match="analysis is not permitted"):
        rows(records.prompt_records(df.withColumn("rights_status", F.lit(None).cast("string"))))
    events = spark.createDataFrame([(i, f"e{i}") for i in (3, 1, 2)], "sequence long, state string")
    records.export_events(events, str(tmp_path / "events"))
    assert [r["sequence"] for r in records.read_jsonl(spark, str(tmp_path / "events"), "sequence long, state string").orderBy("sequence").collect()] == [1, 2, 3]


def test_raster_figures(spark):
    rgb = bytes([0, 255, 10, 255, 255, 20] * 3)
    df = spark.createDataFrame([(bytearray(rgb), 2), (bytearray(b""), 2), (None, 1)], "pixels binary, width int")
    a, b, c = (r["s"] for r in df.select(records.raster_statistics("pixels", "width").alias("s")).collect())
    assert (a["width"], a["height"]) == (2, 3) and a["channel_means"] == [0.5, 1.0, round(15 / 255, 6)] and a["channel_deviations"][1] == 0 and a["dynamic_range"] == pytest.approx((1 + 0 + 10 / 255) / 3)
    assert b["width"] is None and c["height"] is None


def test_merged_ontologies(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "concept string, definition string")
    assert sorted((r["concept"], r["definition"], r["ontologies"]) for r in rows(concepts.merged_ontologies(df))) == [("a", "x", 2), ("b", "y", 1)]
    with pytest.raises(Exception, match="conflicting concept a"):
        rows(concepts.merged_ontologies(df.union(df.selectExpr("'a'", "'z'"))))


def test_contracts(spark):
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": ["string", "null"], "pattern": "^x", "maxLength": 3}, "c": {"type": "array", "minItems": 1, "items": {"const": 2}}}}
    cases = [
        ('{"a": 1}', []), ('{"a": 1.0, "b": null, "c": [2]}', []), ("[]", ["$: is not of type object"]), ("{", ["$: is not JSON"]), (None, None), ("{}", ["$: lacks a"]),
        ('{"a": true, "d": 1, "b": "yyyy", "c": []}', ["$: has an unknown member d", "a: is not of type integer", "b: does not match the pattern", "b: is too long", "c: has too few items"]),
        ('{"a": 0, "c": [2, 3]}', ["a: is too small", "c/1: is not the stated value"]),
    ]
    got = rows(spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "i int, p string").select("i", contracts.contract_errors(F.col("p"), schema).alias("e")))
    assert {r["i"]: r["e"] for r in got} == {i: e for i, (_, e) in enumerate(cases)}
    for bad in ({"oneOf": []}, {"pattern": "("}, {"$ref": "#/nowhere"}, {"not": {}}, {"type": "date"}, {"properties": {"x": {"minimun": 1}}}, {"additionalProperties": {}}):
        with pytest.raises(ValueError):
            contracts.contract_errors(F.col("p"), bad)


def test_adjudication_queue(spark):
    row = lambda art, stage, **f: (stage, f, art, None, None, None, None)
    three = lambda a, c: {"animal_open_text": a, "mobile_object_open_text": "bike", "relation_open_text": "on", "recognition_confidence": c}
    data = [row("x", "blind-recognition", **three(a, c)) for a, c in (("Cat", "40"), ("cat ", "30"), ("dog", "50"), ("dog", "20"))]
    data += [row("y", "prompt-aware-criteria", animal_rating_1_to_5=v, object_rating_1_to_5="3") for v in ("1", "3")] + [row("z", "blind-recognition", **three("cat", "90")), row("", "blind-recognition", **three("a", "1"))]
    got = rows(calibration.adjudication_queue(spark.createDataFrame(data, RESPONSE)))
    assert sorted((r["artifact_id"], r["field"], r["reason"], r["values"], r["share"]) for r in got) == [
        ("x", "animal_open_text", "inter-rater-label-disagreement", "cat=2;dog=2", 0.5), ("x", "recognition_confidence", "low-mean-recognition-confidence", "observations=4", 0.35), ("y", "animal_rating_1_to_5", "criterion-rating-range", "1.0=1;3.0=1", 0.5),
    ]
    assert len({r["item_id"] for r in got}) == 3


def test_repeated_ratings_and_manifests(spark):
    df = spark.createDataFrame([("a", None, 1, "x"), ("b", None, None, "x"), ("c", "a", 1, "x"), ("d", "b", None, "x"), ("e", "b", 2, "x")], "row_id string, duplicate_of string, p int, q string")
    (r,) = rows(ratings.duplicate_exact_consistency(df, ["p", "q"]))
    assert (r["pairs"], r["exact_agreements"], r["consistency"]) == (3, 2, pytest.approx(2 / 3))
    with pytest.raises(Exception, match="no rating"):
        rows(ratings.duplicate_exact_consistency(df.where("row_id <> 'a'"), ["p", "q"]))
    files = spark.createDataFrame([(f"d/{i}", bytearray(b"x" * i)) for i in range(600)], "path string, content binary")
    receipt = lambda d: rows(integrity.manifest_receipt(integrity.manifest(d)))[0]
    whole = receipt(files)
    assert (whole["files"], whole["bytes"]) == (600, sum(range(600))) and receipt(files.orderBy(F.desc("path"))) == whole
    assert receipt(files.withColumn("content", F.when(F.col("path") == "d/7", F.lit(bytearray(b"y" * 7))).otherwise(F.col("content"))))["manifest_sha256"] != whole["manifest_sha256"]


def test_mentions_have_places(spark):
    text = "A Pelican on an electric  scooter, electric scooter, bobcat CAT"
    (r,) = rows(annotate.annotate_prompts(spark.createDataFrame([(text,)], "prompt string")))
    assert [(m["canonical_id"], text[m["start"] : m["end"]]) for m in r["animal_mentions"]] == [("pelican", "Pelican"), ("cat", "CAT")]
    assert [(m["canonical_id"], text[m["start"] : m["end"]]) for m in r["object_mentions"]] == [("electric-scooter", "scooter"), ("electric-scooter", "electric scooter")]


def test_feeds_have_rights_and_limits(spark, tmp_path):
    ns = b'<feed xmlns="http://www.w3.org/2005/Atom">'
    feed = ns + b"<entry><link href='http://x/a'/><summary>s &amp;lt;b&amp;gt; t</summary></entry><entry><id>https://x/b</id><link rel='self' href='no'/><updated>2024-01-01</updated></entry><entry/></feed>"
    got = records.parse_feed(feed)
    assert [(e["record_id"], e["url"]) for e in got] == [("entry-3", None), ("http://x/a", "http://x/a"), ("https://x/b", "https://x/b")]
    for bad, limits in ((b"<rss/>", {}), (feed, {"max_bytes": 10}), (feed, {"max_entries": 2}), (feed, {"max_characters": 2})):
        with pytest.raises(ValueError):
            records.parse_feed(bad, **limits)
    (tmp_path / "a.xml").write_bytes(feed)
    kept, bare = (sorted(rows(records.read_feeds(spark, str(tmp_path), r)), key=lambda r: r["record_id"]) for r in ("licensed", "metadata-only"))
    assert kept[1]["text"] and bare[1]["text"] is None and kept[1]["content_sha256"] == bare[1]["content_sha256"] == hashlib.sha256(kept[1]["text"].encode()).hexdigest()


def test_frozen_rows_and_evaluation_batches(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "k int, v string")
    path = str(tmp_path / "frozen")
    assert records.write_frozen(df, path) and not records.write_frozen(df.orderBy(F.desc("k")), path)
    with pytest.raises(ValueError):
        records.write_frozen(df.where("k < 19"), path)
    pairs = spark.createDataFrame([(f"p{i}", "t", c, f"l{i}", f"r{i}") for i in range(30) for c in ("x", "y")], "pair_id string, task_id string, criterion string, left_artifact_id string, right_artifact_id string")
    a, b = (rows(records.write_evaluation_batch(p, str(tmp_path / n), 5))[0] for n, p in (("a", pairs), ("b", pairs.orderBy(F.desc("pair_id")))))
    assert a == b and a["assignments"] == 60 and a["criteria"] == ["x", "y"] and a["assignments_sha256"] != rows(records.write_evaluation_batch(pairs, str(tmp_path / "c"), 6))[0]["assignments_sha256"]
    read = spark.read.option("header", True).csv(str(tmp_path / "a" / "assignments"))
    assert read.count() == 60 and not set(read.columns) & set(records.VOTE_SENSITIVE) and set(records.ASSIGNMENT_FIELDS) < set(read.columns)
    assert {r["left_alias"] + r["right_alias"] for r in read.collect()} == {"AB"}
    with pytest.raises(ValueError):
        records.write_evaluation_batch(pairs.limit(0), str(tmp_path / "d"), 1)


def test_eligibility_blockers(spark):
    data = [
        ("good", "eligible", "0a1b", False, "open", ["main"]), ("old", "retired", "0a1b", False, "open", ["main"]), ("floating", "reviewed", "unresolved", False, "reviewed", ["main"]), ("code", "reviewed", "r", True, "eligible", ["main"]),
        ("closed", "eligible", "r", False, "restricted", ["main"]), ("all", "candidate", "unresolved:2025", True, "unknown", ["main"]), ("bare", None, None, None, None, ["main"]), ("elsewhere", "eligible", "r", False, "open", ["other"]),
    ]
    registry = spark.createDataFrame(data, "model_id string, status string, revision string, remote_code_required boolean, license_status string, tracks array<string>")
    everything = ["revision-unresolved", "remote-code-required"]
    assert {r["model_id"]: r["blockers"] for r in rows(qualification.eligibility(registry))} == {
        "good": [], "old": ["status:retired"], "floating": ["revision-unresolved"], "code": ["remote-code-required"], "closed": ["license:restricted"], "elsewhere": [],
        "all": ["status:candidate", *everything, "license:unknown"], "bare": ["status:unknown", *everything, "license:unknown"],
    }
    assert [r["model_id"] for r in rows(qualification.eligible_models(registry, "main"))] == ["good"]


def test_repair_without_requirements(spark):
    r = spark.sql("SELECT array('a') AS b, array('a', 'c') AS a, CAST(array() AS array<struct<target_roles:array<string>,preserve_roles:array<string>>>) AS r").select(scorecard.repair_assessment(F.col("b"), F.col("a"), F.col("r")).alias("x")).first()["x"]
    assert r.asDict() == {"before_score": 1.0, "after_score": 1.0, "improvement": 0.0, "repaired_fraction": 0.0, "preservation_fraction": 0.0, "new_defects": []}


def test_sources_of_any_depth():
    for depth in (1, 3000, 9998):
        found = vector_source.inspect("<svg>" + "<g>" * depth + "</g>" * depth + "</svg>")
        assert found["valid"] and found["element_count"] == depth + 1 and found["canonical_hash"].startswith("sha256:")
    assert vector_source.inspect("<svg>" + "<g>" * 20000 + "</g>" * 20000 + "</svg>")["errors"] == ["element limit exceeded"]
    a, b = (vector_source.inspect(s)["canonical_hash"] for s in ('<svg a="1" b=" 2 "><g/>x<g>y</g></svg>', '<svg b="2" a="1"><g/><g> y </g></svg>'))
    assert a == b != vector_source.inspect('<svg a="1" b="2"><g>y</g><g/></svg>')["canonical_hash"]
    kinds = {'<rect ONclick="x"/>': "event attribute: ONclick", '<image href=" data:x"/>': "external reference", '<rect mask="url(http://x)"/>': "unsafe paint or filter", '<rect stroke="//x"/>': "unsafe paint or filter", '<rect style="fill:URL (a)"/>': "unsafe style"}
    for bad, error in kinds.items():
        assert error in vector_source.inspect(f"<svg>{bad}</svg>")["errors"], bad


def test_contracts_never_fail_a_job(spark):
    schema = {
        "$defs": {"tree": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}, "of": {"type": "array", "items": {"$ref": "#/$defs/tree"}}}}},
        "properties": {"t": {"$ref": "#/$defs/tree"}, "e": {"enum": [1, "a"]}, "c": {"const": [0]}, "x": {"anyOf": [{"type": "string"}, {"minimum": 5}]}, "y": {"oneOf": [{"type": "number"}, {"type": "integer"}]}},
    }
    cases = {
        '{"t": {"n": 1, "of": [{"n": 2}, {}, {"n": 2.5}]}}': ["t/of/1: lacks n", "t/of/2/n: is not of type integer"], '{"t": {"n": NaN}}': ["$: is not JSON"], '{"t": {"n": -Infinity}}': ["$: is not JSON"], '{"t": {"n": 1e400}}': ["t/n: is not of type integer"],
        '{"e": true}': ["e: is not one of the listed values"], '{"e": 1.0, "c": [0]}': [], '{"c": [false]}': ["c: is not the stated value"], '{"x": 4}': ["x: fits none of the choices"], '{"x": "s", "y": 1}': ["y: does not fit exactly one of the choices"],
        '{"y": 1.5}': [], "[" * 100000: ["$: is nested too deeply"], '{"t": {"n": ' + "9" * 5000 + "}}": ["$: is not JSON"],
    }
    got = rows(spark.createDataFrame(list(enumerate(cases)), "i int, p string").select("i", contracts.contract_errors(F.col("p"), schema).alias("e")))
    assert {r["i"]: r["e"] for r in got} == dict(enumerate(cases.values()))


def test_labels_change_without_the_drawing(spark):
    svg = '<svg id="a"><g class=\'wheel big\' fill="red"/></svg>'
    r = spark.createDataFrame([(svg,)], "s string").select(*[f(F.col("s")).alias(f.__name__) for f in (mutations.renamed_labels, mutations.commented, mutations.with_unseen_label, mutations.with_far_label)]).first()
    assert r["renamed_labels"] == '<svg id="part"><g class=\'part\' fill="red"/></svg>'
    for name in ("commented", "with_unseen_label", "with_far_label"):
        assert r[name].startswith(svg[:-6]) and mutations.WORDS in r[name] and vector_source.inspect(r[name])["valid"]


def test_helper_columns_leave_the_callers_alone(spark):
    from brightloom.functions.spans import with_matches
    from brightloom.operators import annotate, ordered

    names = ["_low", "_found", "_hits", "_gaps", "_steps", "_ahead", "_Range", "_at", "_by_g", "_sum_x", "_ahead_x", "_before", "_n"]
    own = [F.lit(f"own {c}").alias(c) for c in names]
    kept = lambda df: all(r[c] == f"own {c}" for r in rows(df) for c in names)
    docs = spark.createDataFrame([("two herons ride a tandem",), ("",), (None,)], "text string").select("text", *own)
    assert kept(annotate.annotate_documents(docs)) and kept(with_matches(docs, "text", "[a-z]+", F.lit(True), "words"))
    data = spark.createDataFrame([("p", 1, 5.0), ("p", 2, 7.0), ("q", 3, 1.0)], "g string, k int, x double").select("*", *own)
    placed = ordered.with_ahead(data, ["g"], F.col("k") % 2, ["k"], {"x_before": F.col("x")})
    assert kept(placed) and kept(ordered.mean_ranks(data.withColumn("n", F.lit(1)), "k"))
    events = spark.createDataFrame([(1, "c", "leased", ledger.GENESIS, "h1")], "sequence int, cell_id string, new_state string, previous_event_hash string, event_hash string").select("*", *own)
    assert kept(ledger.replay(events)) and not rows(ledger.replay(events))[0]["broken_link"]


def test_fuzz_report_asks_the_gate_once_for_a_text_and_in_many_tasks(spark):
    ns = 'xmlns="http://www.w3.org/2000/svg"'
    df = spark.createDataFrame([(str(i), s) for i in range(20) for s in (f'<svg {ns}><g id="a"><rect width="{i % 3}"/></g></svg>', "<svg", "", None)], "source_id string, source string").coalesce(1)
    made = mutations.mutated(df, 26, 5)
    texts = {(r["mutation"], r["source"]) for r in made.collect()}
    want = {}
    for r in made.collect():
        n = want.setdefault(r["mutation"], [0, 0, 0])
        n[0] += 1
        n[1 if vector_source.inspect(r["source"])["valid"] else 2] += 1
    out = mutations.fuzz_report(df, 26, 5)
    assert {r["mutation"]: [r["cases"], r["accepted"], r["rejected"]] for r in rows(out)} == want
    gate, dealt = out._jdf.queryExecution().optimizedPlan().toString().split("ArrowEvalPython")[1].split("\n", 1)
    assert "Aggregate [mutation" in dealt and "Repartition" in dealt and len(texts) < made.count()
    for bad in ("<svg>" + "<g>" * 20000 + "</g>" * 20000 + "</svg>", '<svg><path d="' + "h" * 500_001 + '"/></svg>', "<g/>", "<svg>\x00</svg>", "<svg><a/></svg>", '<svg><rect onload="x"/></svg>', None):
        assert not vector_source.accepts(bad) and not vector_source.inspect(bad)["valid"]
