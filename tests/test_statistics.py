import hashlib
import math
import random
from collections import Counter
from itertools import combinations, product
from statistics import pstdev

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.operators import interaction, ordered, planning, ratings, resampling, scores, series
from brightloom.plans import statistics


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_interaction_is_observed_less_additive_expectation(spark):
    data = [("m", a, o, "r", s) for a, o, s in (("A", "O", 0.9), ("A", "P", 0.5), ("B", "O", 0.4), ("B", "P", 0.2))]
    df = spark.createDataFrame(data, "model_id string, animal string, mobile_object string, relation string, score double")
    (r,) = rows(interaction.interaction_estimate(df, "A", "O", "r"))
    assert r["observed"] == 0.9 and r["replicates"] == 1
    assert r["expected"] == pytest.approx(0.7 + 0.65 + 0.5 - 2 * 0.5)
    assert rows(interaction.interaction_estimate(df, "A", "none", "r")) == []


def test_shrinkage_pools_equal_effects(spark):
    df = spark.createDataFrame([("a", 0.2, 0.1), ("b", 0.2, 0.1)], "model_id string, interaction double, standard_error double")
    for r in rows(interaction.shrink_interactions(df)):
        assert r["tau2"] == 0 and r["shrunk"] == pytest.approx(0.2)


def test_superiority_and_rank(spark):
    df = spark.createDataFrame([("a", 0.3, 0.0), ("b", 0.1, 0.0), ("c", 0.3, 0.2)], "model_id string, interaction double, standard_error double")
    p = {(r["model_a"], r["model_b"]): r["probability"] for r in rows(interaction.superiority_probabilities(df))}
    assert p["a", "b"] == 1 and p["b", "a"] == 0
    assert p["c", "b"] == pytest.approx(0.5 * (1 + math.erf(0.2 / 0.2 / math.sqrt(2))))
    assert [r["model_id"] for r in sorted(rows(interaction.rank_with_uncertainty(df)), key=lambda r: r["rank"])] == ["a", "c", "b"]


def test_agreement_matches_listed_pairs(spark):
    rng = random.Random(3)
    data = [(rng.randrange(12), rng.choice("xyz")) for _ in range(60)] + [(99, "x")]
    df = spark.createDataFrame(data, "item long, category string")
    groups = {}
    for item, c in data:
        groups.setdefault(item, []).append(c)
    pairs = [a == b for g in groups.values() for a, b in combinations(g, 2)]
    n = Counter(c for _, c in data)
    expected = sum((v / len(data)) ** 2 for v in n.values())
    observed = sum(pairs) / len(pairs)
    (r,) = rows(ratings.inter_rater_agreement(df))
    assert r["pairs"] == len(pairs) and r["observed"] == pytest.approx(observed) and r["expected"] == pytest.approx(expected)
    assert r["kappa"] == pytest.approx((observed - expected) / (1 - expected))
    several = [g for g in groups.values() if len(g) > 1]
    m = Counter(c for g in several for c in g)
    total = sum(m.values())
    e = 1 - sum(v * (v - 1) for v in m.values()) / (total * (total - 1))
    assert rows(ratings.nominal_alpha(df))[0]["alpha"] == pytest.approx(1 - (1 - observed) / e)


def test_preferences_follow_wins(spark):
    votes = spark.createDataFrame([("c", "x", "y", "left")] * 8 + [("c", "x", "y", "right")] * 2, "criterion string, left string, right string, winner string")
    s = {r["name"]: r["score"] for r in rows(ratings.fit_preferences(votes))}
    assert s["x"] > 0 and s["x"] == pytest.approx(-s["y"])


def test_drift_decisions(spark):
    same = [("b", 0.5)] * 20 + [("c", 0.5)] * 20
    moved = [("b", 0.1)] * 20 + [("c", 0.9)] * 20
    for data, action in ((same, "none"), (moved, "new-major-release-and-bridge-study")):
        (r,) = rows(scores.compare_distributions(spark.createDataFrame(data, "group string, score double"), "b", "c"))
        assert r["action"] == action


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.4), (1, 0.8)], "label int, score double")
    assert rows(scores.auc(df))[0]["auc"] == 0.875
    assert rows(scores.auc(df.where("label = 1")))[0]["auc"] is None


def test_spearman_and_constant_margin(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0), (3.0, 15.0)], "x double, y double")
    assert rows(scores.spearman(df))[0]["rho"] == pytest.approx(0.5)
    assert rows(scores.spearman(spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "x double, y double")))[0]["rho"] is None


def test_trend_and_trajectory(spark):
    df = spark.createDataFrame([("m", "2024-01-02", 1, 3.0), ("m", None, 0, 1.0), ("m", "2024-01-03", 2, 5.0), ("k", "2024-01-01", 0, 7.0)], "metric string, observed_at string, seq int, value double")
    r = {x["metric"]: x for x in rows(series.metric_trends(df))}
    assert r["m"]["slope"] == pytest.approx(2) and r["m"]["first_value"] == 1 and r["k"]["slope"] == 0
    events = spark.createDataFrame([("e", i, h, s, err) for i, (h, s, err) in enumerate([("a", 0.2, None), ("b", 0.6, None), ("b", 0.4, "x"), ("c", None, None), ("d", 0.6, None)])], "episode string, position int, state_hash string, score double, error string")
    (t,) = rows(series.trajectory_metrics(events))
    assert (t["regressions"], t["recoveries"], t["repeated_states"]) == (1, 1, 1)
    assert t["improvement"] == pytest.approx(0.4) and t["error_rate"] == pytest.approx(0.2)


def test_resampling_is_reproducible_and_leaves_one_out(spark):
    df = spark.createDataFrame([(str(i % 6), float(i)) for i in range(60)], "cluster string, value double")
    a, b = (rows(resampling.cluster_bootstrap(df, 50, 1))[0] for _ in range(2))
    assert a == b and a["ci_low"] <= a["estimate"] <= a["ci_high"] and not a["fail_closed"]
    for r in rows(resampling.leave_one_cluster_out(df)):
        rest = [float(i) for i in range(60) if str(i % 6) != r["cluster"]]
        assert r["mean_without"] == pytest.approx(sum(rest) / len(rest))
    exact = spark.createDataFrame([(c, s, s) for c, s in zip("abcd", (1.0, 2.0, 3.0, 4.0))], "cluster string, score double, outcome double")
    (r,) = rows(resampling.randomisation_test(exact))
    assert r["method"] == "exact" and r["rho"] == pytest.approx(1) and r["p_value"] == pytest.approx(2 / 24)


def test_two_step_positions_and_ranks_equal_plain_ones(spark, monkeypatch):
    rng = random.Random(12)
    data = [(rng.choice("ab"), rng.choice([None, 1.0, 2.0, 2.5, -3.0, 1e9, rng.random()]), i) for i in range(400)]
    df = spark.createDataFrame(data, "g string, v double, i long")
    got = rows(ordered.with_ahead(df, ["g"], ordered.key_range(df, F.col("v"), 8), [F.col("v").asc_nulls_first(), "i"], {"before": F.lit(1), "sum": F.col("i")}))
    for g in "ab":
        mine = sorted((r for r in data if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        at = {r["i"]: r for r in got if r["g"] == g}
        assert len(at) == len(mine)
        total = 0
        for k, r in enumerate(mine):
            assert (at[r[2]]["before"], at[r[2]]["sum"]) == (k, total)
            total += r[2]
    pairs = [(rng.choice([1.0, 2.0, rng.random()]), rng.choice([0.0, 1.0, 5.0])) for _ in range(300)]

    def ranks(xs):
        order = sorted(xs)
        first = {x: order.index(x) for x in order}
        n = Counter(xs)
        return [first[x] + (n[x] + 1) / 2 for x in xs]

    rx, ry = ranks([p[0] for p in pairs]), ranks([p[1] for p in pairs])
    (r,) = rows(scores.spearman(spark.createDataFrame(pairs, "x double, y double")))
    assert r["n"] == 300 and r["rho"] == pytest.approx(float(np.corrcoef(rx, ry)[0, 1]))
    (r,) = rows(scores.spearman(spark.createDataFrame([], "x double, y double")))
    assert (r["n"], r["rho"]) == (0, None)
    tasks = spark.createDataFrame([(f"t{i}", i % 5 == 0) for i in range(200)], "task_id string, is_heritage boolean")
    sealed = rows(planning.split_sealed(tasks, 0.3, 4))
    assert len(sealed) == 200 and sum(r["sealed"] for r in sealed) == 48 and not any(r["sealed"] for r in sealed if r["is_heritage"])


def test_normal_distribution_function(spark):
    values = [-40.0, -9.0, -6.0, -5.9, -2.5, -1e-9, 0.0, 0.3, 1.96, 4.0, 6.0, 6.1, 9.0, 40.0]
    for r in rows(spark.createDataFrame([(v,) for v in values], "x double").select("x", interaction.normal_cdf(F.col("x")).alias("p"))):
        assert r["p"] == pytest.approx(0.5 * math.erfc(-r["x"] / math.sqrt(2)), rel=1e-9, abs=1e-15)


def test_cluster_bootstrap_of_another_statistic(spark):
    df = spark.createDataFrame([(str(i % 6), float(i)) for i in range(60)] + [("z", None)], "cluster string, value double")
    (r,) = rows(resampling.cluster_bootstrap(df, 200, 1, resampling.root_mean_square))
    assert r["estimate"] == pytest.approx(math.sqrt(sum(i * i for i in range(60)) / 60)) and r["clusters"] == 7 and r["ci_low"] < r["estimate"] < r["ci_high"]


def test_drift_reports_means_and_rejects_scores_out_of_range(spark):
    df = spark.createDataFrame([("b", 0.1)] * 20 + [("c", 0.9)] * 20 + [("other", 7.0)], "group string, score double")
    (r,) = rows(scores.compare_distributions(df, "b", "c"))
    assert (r["baseline_mean"], r["candidate_mean"], r["mean_shift"]) == (pytest.approx(0.1), pytest.approx(0.9), pytest.approx(0.8))
    with pytest.raises(Exception, match="from 0 to 1"):
        rows(scores.compare_distributions(df.union(df.selectExpr("'c'", "1.5")), "b", "c"))
    with pytest.raises(Exception, match="no scores"):
        rows(scores.compare_distributions(df, "b", "absent"))


def _draw(n, *parts):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:12], 16) % n


def test_whole_bootstraps_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    data = [("m", a, o, r, rng.randrange(11) / 10, f"{k:03}") for k, (a, o, r) in enumerate(list(product(("1-URGENT", "B"), ("O", "P"), ("O", "F"))) * 3)]
    df = spark.createDataFrame(data, "model_id string, animal string, mobile_object string, relation string, score double, observation_id string")
    clusters = {str(c): [rng.random() for _ in range(3)] for c in range(5)}
    monkeypatch.setattr(statistics, "observations", lambda *_: df)
    monkeypatch.setattr(statistics, "_clusters", lambda *_: spark.createDataFrame([(c, v) for c, vs in clusters.items() for v in vs], "cluster string, value double"))
    mean = lambda xs: sum(xs) / len(xs)
    cells, effects, listed = {}, [], []
    for m, a, o, r, score, _ in data:
        cells.setdefault((m, a, o, r), []).append(score)

    def effect(drawn):
        margin = [mean([x for k, x in drawn if k[at] == name]) for at, name in ((1, "1-URGENT"), (2, "O"), (3, "O"))]
        return mean([x for k, x in drawn if k[1:] == ("1-URGENT", "O", "O")]) - min(1, max(0, sum(margin) - 2 * mean([x for _, x in drawn])))

    counts = {}
    for k, v in cells.items():
        seed = lambda text: np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")))
        n = Counter(v)
        counts[k] = sorted(n), seed("|".join(["5", *k]) + "|0").multinomial(len(v), [n[x] / len(v) for x in sorted(n)], 1000)
    for sample in range(1000):
        effects.append(effect([(k, x) for k, (values, m) in counts.items() for x, n in zip(values, m[sample]) for _ in range(n)]))
        listed.append(effect([(k, rng.choice(v)) for k, v in cells.items() for _ in v]))
    (r,) = rows(statistics.QUERIES["interaction_bootstrap_1000"](spark, ""))
    effects.sort()
    assert r["samples"] == 1000 and r["standard_error"] == pytest.approx(pstdev(effects), abs=2e-6)
    assert (r["ci_low"], r["ci_high"]) == (pytest.approx(effects[24], abs=2e-6), pytest.approx(effects[974], abs=2e-6))
    assert r["standard_error"] == pytest.approx(pstdev(listed), rel=0.1)  # rows drawn one by one
    monkeypatch.setattr(interaction, "PART_SCORES", 2)  # cells in parts: another stream, the same distribution
    (split,) = rows(statistics.QUERIES["interaction_bootstrap_1000"](spark, ""))
    assert split["samples"] == 1000 and split["standard_error"] == pytest.approx(pstdev(listed), rel=0.1)
    names = sorted(clusters)
    means = sorted(mean([v for i in range(5) for v in clusters[names[_draw(5, 3, sample, i)]]]) for sample in range(10_000))
    (r,) = rows(statistics.QUERIES["cluster_bootstrap_10000"](spark, ""))
    assert (r["ci_low"], r["ci_high"]) == (pytest.approx(means[249], abs=1e-4), pytest.approx(means[9749], abs=1e-4))
