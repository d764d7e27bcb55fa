import hashlib

import pytest
from pyspark.sql import functions as F

from brightloom.functions.draws import stable_id, stable_seed
from brightloom.operators import annotate, concepts, integrity, ledger, planning, qualification, scorecard
from brightloom.sources import records


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_ids_and_seeds_equal_hashlib(spark):
    digest = hashlib.sha256("\x1f".join(["a", "7", "x"]).encode())
    r = spark.range(1).select(stable_id("P", 20, F.lit("a"), F.lit(7), F.lit("x")).alias("i"), stable_seed(F.lit("a"), F.lit(7), F.lit("x")).alias("s")).first()
    assert r["i"] == "P-" + digest.hexdigest()[:20] and r["s"] == int.from_bytes(digest.digest()[:8], "big") % (2**31 - 1)


def test_lease_skips_and_respects_caps(spark):
    cells = spark.createDataFrame([(f"c{i}", "s", m, f"t{i}", 1, "ready", 0.2) for i, m in enumerate(["a", "a", "a", "b", "b"])], "cell_id string, stage_id string, model_id string, task_id string, replicate int, state string, estimated_cost double")
    taken = rows(ledger.lease(cells, 10, 2, 10.0))
    assert sorted(r["cell_id"] for r in taken) == ["c0", "c1", "c3", "c4"] and max(r["reserved_cost"] for r in taken) == pytest.approx(0.8)
    assert len(rows(ledger.lease(cells, 10, 2, 0.5))) == 2


def test_replay_finds_gaps_links_and_transitions(spark):
    g = ledger.GENESIS
    data = [(1, "c", "leased", g, "h1"), (2, "c", "succeeded", "h1", "h2"), (4, "c", "leased", "h3", "h4"), (5, "d", "failed", "x", "h5")]
    r = {x["sequence"]: x for x in rows(ledger.replay(spark.createDataFrame(data, "sequence long, cell_id string, new_state string, previous_event_hash string, event_hash string")))}
    assert not any(r[1][k] or r[2][k] for k in ("gap", "broken_link", "illegal"))
    assert r[4]["gap"] and r[4]["illegal"] and r[5]["broken_link"] and r[5]["illegal"]


def test_blinding_round_trip_and_unknown_value(spark):
    aliases = spark.createDataFrame([("m1", "x"), ("m2", "y")], "real string, alias string")
    df = spark.createDataFrame([(1, "m1"), (2, None)], "id int, model string")
    blinded = integrity.blind(df, aliases, ["model"])
    assert {r["id"]: r["model"] for r in rows(blinded)} == {1: "x", 2: None}
    token = integrity.unblinding_token(b"k" * 32, "study", ["model"], "ann")
    assert {r["id"]: r["model"] for r in rows(integrity.unblind(blinded, aliases, ["model"], token, b"k" * 32, "study", "ann"))} == {1: "m1", 2: None}
    with pytest.raises(PermissionError):
        integrity.unblind(blinded, aliases, ["model", "id"], token, b"k" * 32, "study", "ann")
    with pytest.raises(Exception, match="no alias"):
        integrity.blind(spark.createDataFrame([(1, "zz")], "id int, model string"), aliases, ["model"]).collect()


def test_retained_denominator(spark):
    plan = spark.createDataFrame([(i, "m") for i in range(4)], "cell_id int, model_id string")
    done = spark.createDataFrame([(0, True), (1, False)], "cell_id int, ok boolean")
    (r,) = rows(qualification.qualification(plan, done, "model_id", ["ok"], {"ok": 0.5}))
    assert r["planned"] == 4 and r["observed"] == 2 and r["ok_rate"] == 0.25 and not r["qualified"]


def test_ancestors_and_cycles(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)], "child string, parent string")
    depth = {(r["concept"], r["ancestor"]): r["depth"] for r in rows(concepts.ancestors(edges))}
    assert depth["n0", "n9"] == 9 and depth["n3", "n3"] == 0 and len(depth) == 55
    with pytest.raises(ValueError):
        concepts.ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string"))


def test_prompt_annotation(spark):
    df = spark.createDataFrame([("Draw an SVG of a pelican riding a bicycle, flat vector, side view",), ("a cat sitting on a plane rides",), ("go-kart and electric scooter",)], "prompt string")
    a, b, c = rows(annotate.annotate_prompts(df))
    assert [m["canonical_id"] for m in a["animal_mentions"]] == ["pelican"] and a["relations"] == ["rides_on"] and a["styles"] == ["flat"] and a["viewpoints"] == ["side"]
    assert a["asks_for_svg"] and a["compositional"]
    assert b["relations"] == ["aboard"]
    assert [m["canonical_id"] for m in c["object_mentions"]] == ["go-kart", "electric-scooter"]


def test_document_annotation_counts_neighbouring_words(spark):
    (r,) = rows(annotate.annotate_documents(spark.createDataFrame([("bird bird écat wheel. not contact",)], "text string")))
    assert r["entity_counts"]["ANIMAL"] == 2 and r["entity_counts"]["MECHANICS"] == 1 and r["relations"] == ["failed_contact"] and r["category"] == "mechanics"


def test_scorecard_perfect_and_unassessed(spark):
    schema = """answers map<string,double>, animal_features array<string>, object_features array<string>, relations array<string>, valid_source boolean, nonblank boolean, foreground_fraction double,
      bounding_box_fraction double, visible_shapes int, hidden_shapes int, element_count int, path_characters int, group_count int, source_independent boolean"""
    full = {q: 1.0 for q in ("animal-present", "object-present", "animal-feature:bill", "object-feature:wheel", "relation:on", "scene-coherent")}
    base = (["bill"], ["wheel"], ["on"], True, True, 0.3, 0.5, 8, 0, 20, 100, 1, True)
    a, b = rows(scorecard.scorecard(spark.createDataFrame([(full, *base), (None, *base)], schema)))
    assert a["valid"] and a["aggregate"] == pytest.approx(1.0)
    assert not b["valid"] and b["composition"] == pytest.approx(0.5) and b["animal_anatomy"] == 0


def test_firewall_precedence(spark):
    d = lambda safe, blank, n, m: scorecard.judge_input(F.lit(safe), F.lit(not blank), F.lit(n), F.array(*[F.lit(x) for x in m]).cast("array<string>"))
    r = spark.range(1).select(d(False, False, 5, ["x"]).alias("a"), d(True, False, 5, ["x"]).alias("b"), d(True, False, 0, ["x"]).alias("c")).first()
    assert r["a"]["decision"] == "rejected" and r["b"]["decision"] == "quarantined" and len(r["b"]["reasons"]) == 2 and r["c"]["decision"] == "eligible"


def test_sources(spark, tmp_path):
    head = "pair_id,task_id,criterion,left_artifact_id,right_artifact_id,winner,rater_hash\n"
    (tmp_path / "v.csv").write_text(head + f"p,t,c,a,b,A,{'0' * 16}\np,t,c,a,b,tie,{'f' * 16}\np,t,c,a,b,nobody,{'f' * 16}\n")
    good, bad = records.read_votes(spark, str(tmp_path / "v.csv"))
    assert sorted(r["side"] for r in good.collect()) == ["left", "tie"] and bad.count() == 1
    (tmp_path / "w.csv").write_text(head.replace("pair_id", "email,pair_id"))
    with pytest.raises(ValueError, match="identify"):
        records.read_votes(spark, str(tmp_path / "w.csv"))
    feed = b'<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>2</id><published>2024-02-01</published><content>&lt;p&gt;x  y&lt;/p&gt;</content><link href="u"/></entry><entry><id>1</id><published>2024-01-01</published></entry></feed>'
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.xml").write_bytes(feed)
    e = records.read_feeds(spark, str(tmp_path / "f"), "licensed").collect()
    assert [x["record_id"] for x in e] == ["1", "2"] and e[1]["text"] == "x y" and e[1]["url"] == "u"
    with pytest.raises(ValueError):
        records.parse_feed(b"<!DOCTYPE x><feed/>")
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    records.write_jsonl(df, str(tmp_path / "o"))
    assert records.read_jsonl(spark, str(tmp_path / "o"), "k int, v string").collect() == df.collect()


def test_canonical_hash_ignores_key_order(spark):
    df = spark.createDataFrame([('{"b": 1, "a": 1e-7}',), ('{"a":1e-7,"b":1}',)], "j string").select(integrity.canonical_hash("j").alias("h"))
    a, b = (r["h"] for r in df.collect())
    assert a == b == "sha256:" + hashlib.sha256(b'{"a":1e-07,"b":1}').hexdigest()


def test_calibration_sample_takes_turns(spark):
    data = [(str(i), "s", "m1" if i < 90 else "m2", 0.5, 0.0, True) for i in range(100)]
    df = spark.createDataFrame(data, "artifact_id string, stratum string, model_id string, score double, disagreement double, valid boolean")
    got = rows(planning.calibration_sample(df, 10, 1))
    assert sum("m2" in r["sampling_cell"] for r in got) == 5 and len(got) == 10


def test_source_inspection():
    from brightloom.functions.vector_source import inspect

    ns = 'xmlns="http://www.w3.org/2000/svg"'
    good = inspect(f'<svg {ns}><g id="left-wheel"><rect width="2"/><circle r="1" opacity="0"/><line/></g><defs><rect/></defs><text>hi</text></svg>')
    assert good["valid"] and (good["visible_shapes"], good["hidden_shapes"], good["group_count"], good["text_character_count"]) == (2, 3, 1, 2) and good["roles"] == ["left", "wheel"]
    for bad in ("<!DOCTYPE svg><svg/>", "<svg", f"<svg {ns}><script/></svg>", f'<svg {ns} onload="x"/>', f'<svg {ns}><g href="https://x"/></svg>', f'<svg {ns} style="fill:url (#a)"/>', "<p/>", None):
        assert not inspect(bad)["valid"] and inspect(bad)["canonical_hash"] is None
