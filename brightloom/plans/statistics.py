"""Queries of the statistics operators over the driver tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.functions import closed_forms
from brightloom.operators import interaction, ratings, resampling, scores, series
from brightloom.plans.base import registry, rounded
from brightloom.session import table

QUERIES, ORACLES, query = registry()

TARGET = ("1-URGENT", "O", "O")
OBS = """obs AS (SELECT l_returnflag AS model_id, o_orderpriority AS animal, o_orderstatus AS mobile_object, l_linestatus AS relation, l_discount * 10 AS score,
  l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR AS observation_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as observations."""
    return interaction.as_observations(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))


_ESTIMATE = """est AS (
  SELECT model_id, avg(score) FILTER (animal = '1-URGENT' AND mobile_object = 'O' AND relation = 'O') AS observed,
    count(*) FILTER (animal = '1-URGENT' AND mobile_object = 'O' AND relation = 'O') AS replicates,
    least(1, greatest(0, avg(score) FILTER (animal = '1-URGENT') + avg(score) FILTER (mobile_object = 'O') + avg(score) FILTER (relation = 'O') - 2 * avg(score))) AS expected
  FROM obs GROUP BY model_id HAVING replicates > 0)"""


@query(f"WITH {OBS}, {_ESTIMATE} SELECT model_id, replicates, round(observed, 6) AS observed, round(expected, 6) AS expected, round(observed - expected, 6) AS interaction FROM est")
def interaction_estimate(spark, sf_dir):
    """Interaction of the target cell by model."""
    return rounded(interaction.interaction_estimate(observations(spark, sf_dir), *TARGET))


@query()
def interaction_bootstrap(spark, sf_dir):
    """Resampled standard error and interval of the interaction, of 1,000 resamples."""
    return rounded(interaction.interaction_bootstrap(observations(spark, sf_dir), *TARGET, seed=5))


@query()
def interaction_bootstrap_1000(spark, sf_dir):
    """The same by its longer name."""
    return interaction_bootstrap(spark, sf_dir)


def _estimates(spark, sf_dir):
    """Interaction and a plain standard error by model."""
    obs = observations(spark, sf_dir)
    est = interaction.interaction_estimate(obs, *TARGET)
    se = obs.groupBy("model_id").agg((F.stddev_pop("score") / F.sqrt(F.count("*"))).alias("standard_error"))
    return est.join(se, "model_id").select("model_id", "interaction", "standard_error")


_EST = f"""WITH {OBS}, {_ESTIMATE}, x AS (
  SELECT model_id, observed - expected AS interaction, se AS standard_error FROM est JOIN (SELECT model_id, stddev_pop(score) / sqrt(count(*)) AS se FROM obs GROUP BY 1) USING (model_id))"""


@query(_EST + """, f AS (SELECT *, greatest(standard_error ** 2, 1e-8) AS v FROM x), g AS (SELECT *, sum(interaction / v) OVER () / sum(1 / v) OVER () AS m FROM f),
t AS (SELECT *, CASE WHEN sum(1 / v) OVER () - sum(1 / v ** 2) OVER () / sum(1 / v) OVER () > 0 THEN greatest(0, (sum((interaction - m) ** 2 / v) OVER () - (count(*) OVER () - 1))
  / (sum(1 / v) OVER () - sum(1 / v ** 2) OVER () / sum(1 / v) OVER ())) ELSE 0 END AS tau2 FROM g),
p AS (SELECT *, sum(interaction / (v + tau2)) OVER () / sum(1 / (v + tau2)) OVER () AS pooled, tau2 / (tau2 + v) AS weight FROM t)
SELECT model_id, round(interaction, 6) AS interaction, round(pooled, 6) AS pooled, round(tau2, 6) AS tau2, round(weight, 6) AS weight, round(weight * interaction + (1 - weight) * pooled, 6) AS shrunk FROM p""")
def shrink_interactions(spark, sf_dir):
    """Interactions shrunk towards their pooled mean."""
    return rounded(interaction.shrink_interactions(_estimates(spark, sf_dir)))


@query(_EST + " SELECT model_id, round(interaction, 6) AS interaction, round(standard_error, 6) AS standard_error, row_number() OVER (ORDER BY interaction DESC, standard_error, model_id) AS rank FROM x")
def rank_with_uncertainty(spark, sf_dir):
    """Models by interaction."""
    return rounded(interaction.rank_with_uncertainty(_estimates(spark, sf_dir)))


_TERMS = "[k for k in range(1, 121)]"


@query(_EST + f""", z AS (SELECT a.model_id AS model_a, b.model_id AS model_b, (a.interaction - b.interaction) / sqrt(a.standard_error ** 2 + b.standard_error ** 2) AS z FROM x a JOIN x b ON a.model_id <> b.model_id),
f AS (SELECT *, least(abs(z), 8.0) AS u FROM z),
p AS (SELECT *, 0.5 + exp(-u * u / 2) / sqrt(2 * pi()) * u * (1 + list_sum(list_transform({_TERMS}, lambda k: exp(2 * k * ln(greatest(u, 1e-300)) - list_sum(list_transform(range(1, k + 1), lambda j: ln(2 * j + 1))))))) AS q FROM f)
SELECT model_a, model_b, round(CASE WHEN z >= 0 THEN q ELSE 1 - q END, 6) AS probability FROM p""")
def superiority_probabilities(spark, sf_dir):
    """Probability that one model's interaction exceeds another's."""
    return rounded(interaction.superiority_probabilities(_estimates(spark, sf_dir)))


@query(f"""WITH {OBS}, c AS (SELECT model_id, animal, mobile_object, relation, var_pop(score) AS v, avg(score) AS m, count(*) AS n FROM obs GROUP BY ALL),
b AS (SELECT model_id, coalesce(avg(v) FILTER (n > 1), 0) AS w, coalesce(var_pop(m), 0) AS t, count(*) AS cells, count(*) FILTER (n > 1) AS replicated FROM c GROUP BY 1)
SELECT model_id, round(w, 6) AS within, round(t, 6) AS between, cells, replicated, round(CASE WHEN w + t = 0 THEN 1 ELSE least(1, greatest(0, t / (w + t))) END, 6) AS reliability FROM b""")
def replicate_reliability(spark, sf_dir):
    """Reliability of cell means by model."""
    return rounded(interaction.replicate_reliability(observations(spark, sf_dir)))


def _ratings(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_returnflag").alias("category"))


_COUNTS = "c AS (SELECT l_partkey AS item, l_returnflag AS category, count(*) AS n FROM lineitem GROUP BY ALL), i AS (SELECT item, sum(n) AS n, sum(n * (n - 1) / 2) AS eq, sum(n) * (sum(n) - 1) / 2 AS pairs FROM c GROUP BY 1)"


@query(f"""WITH {_COUNTS}, s AS (SELECT count(*) AS items, sum(pairs) AS pairs, sum(eq) / sum(pairs) AS o FROM i WHERE n >= 2),
t AS (SELECT sum(n) AS ratings, sum(n * n) / (sum(n) * sum(n)) AS e FROM (SELECT category, sum(n) AS n FROM c GROUP BY 1))
SELECT items, pairs::BIGINT AS pairs, ratings::BIGINT AS ratings, round(o, 6) AS observed, round(e, 6) AS expected, round((o - e) / (1 - e), 6) AS kappa FROM s, t""")
def rater_agreement(spark, sf_dir):
    """Agreement and kappa."""
    return rounded(ratings.inter_rater_agreement(_ratings(spark, sf_dir)))


@query(f"""WITH {_COUNTS}, s AS (SELECT 1 - sum(eq) / sum(pairs) AS d, sum(n) AS total FROM i WHERE n >= 2),
k AS (SELECT sum(n * (n - 1)) AS eq FROM (SELECT category, sum(c.n) AS n FROM c JOIN i USING (item) WHERE i.n >= 2 GROUP BY 1))
SELECT total::BIGINT AS ratings, round(d, 6) AS disagreement, round(1 - eq / (total * (total - 1)), 6) AS expected, round(1 - d / (1 - eq / (total * (total - 1))), 6) AS alpha FROM s, k""")
def nominal_alpha(spark, sf_dir):
    """Nominal alpha."""
    return rounded(ratings.nominal_alpha(_ratings(spark, sf_dir)))


@query(f"WITH {_COUNTS} SELECT item, sum(n)::BIGINT AS ratings, round(max(n) / sum(n), 6) AS modal_share, count(*) AS categories FROM c GROUP BY item HAVING sum(n) >= 2 AND max(n) / sum(n) < 2 / 3")
def label_disagreements(spark, sf_dir):
    """Items to adjudicate."""
    return rounded(ratings.label_disagreements(_ratings(spark, sf_dir)))


@query("SELECT l_partkey AS item, count(*) AS ratings, max(l_quantity) - min(l_quantity) AS rating_range FROM lineitem GROUP BY 1 HAVING count(*) >= 2 AND max(l_quantity) - min(l_quantity) >= 45")
def rating_ranges(spark, sf_dir):
    """Items whose ratings lie far apart."""
    return ratings.rating_ranges(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_quantity").alias("rating")), 45.0)


@query(f"WITH {_COUNTS} SELECT sum(pairs)::BIGINT AS pairs, round(sum(eq) / sum(pairs), 6) AS consistency FROM i")
def duplicate_consistency(spark, sf_dir):
    """Equal pairs among repeated ratings."""
    return rounded(ratings.duplicate_consistency(_ratings(spark, sf_dir)))


def _votes(spark, sf_dir):
    names = F.concat(F.lit("m"), (F.col("l_suppkey") % 7).cast("string")), F.concat(F.lit("m"), (F.col("l_partkey") % 7).cast("string"))
    winner = F.when(F.col("l_quantity") < 20, "left").when(F.col("l_quantity") < 40, "right").otherwise("tie")
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("criterion"), names[0].alias("left"), names[1].alias("right"), winner.alias("winner")).where("left <> right")


@query("SELECT l_returnflag AS criterion, CASE WHEN l_quantity < 20 THEN 'left' WHEN l_quantity < 40 THEN 'right' ELSE 'tie' END AS winner, count(*) AS votes FROM lineitem WHERE l_suppkey % 7 <> l_partkey % 7 GROUP BY ALL")
def winner_counts(spark, sf_dir):
    """Votes by criterion and winner."""
    return ratings.winner_counts(_votes(spark, sf_dir))


@query()
def preference_scores(spark, sf_dir):
    """Bradley-Terry scores."""
    return rounded(ratings.fit_preferences(_votes(spark, sf_dir)))


@query("""WITH h AS (SELECT least(9, greatest(0, floor(l_discount * 10 * 10)::INT)) AS b, count(*) FILTER (l_returnflag = 'A') AS p, count(*) FILTER (l_returnflag = 'R') AS q, sum(l_discount * 10) FILTER (l_returnflag = 'A') AS sp, sum(l_discount * 10) FILTER (l_returnflag = 'R') AS sq FROM lineitem GROUP BY 1),
f AS (SELECT i, coalesce(p, 0) / sum(p) OVER () AS p, coalesce(q, 0) / sum(q) OVER () AS q, coalesce(p, 0) AS pn, coalesce(q, 0) AS qn, sp, sq FROM range(0, 10) t(i) LEFT JOIN h ON b = i),
g AS (SELECT sum((q - p) * ln((q + 1e-6) / (p + 1e-6))) AS x, max(abs(q - p)) AS m, sum(pn)::BIGINT AS baseline_n, sum(qn)::BIGINT AS candidate_n, sum(sp) / sum(pn) AS a, sum(sq) / sum(qn) AS b FROM f)
SELECT round(a, 6) AS baseline_mean, round(b, 6) AS candidate_mean, round(b - a, 6) AS mean_shift, round(x, 6) AS stability_index, round(m, 6) AS max_bin_shift, baseline_n, candidate_n, CASE WHEN x >= 0.25 THEN 'new-major-release-and-bridge-study' WHEN x >= 0.1 THEN 'investigate-and-recalibrate' ELSE 'none' END AS action FROM g""")
def score_drift(spark, sf_dir):
    """Stability index of returned against accepted lines."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("group"), (F.col("l_discount") * 10).alias("score"))
    return rounded(scores.compare_distributions(lines, "A", "R"))


_LD = "ld AS (SELECT quality AS label, n_chars AS score FROM labels JOIN documents USING (doc_id))"


@query(f"""WITH {_LD}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM ld),
s AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n, sum(r) FILTER (label = 1) AS sr FROM r)
SELECT p AS positives, n AS negatives, round((sr - p * (p + 1) / 2) / (p * n), 6) AS auc FROM s""")
def ranking_auc(spark, sf_dir):
    """Area under the curve of quality by length."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return rounded(scores.auc(joined.select(F.col("quality").alias("label"), F.col("n_chars").alias("score"))))


@query(f"""WITH {_LD}, r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS x, rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1) / 2 AS y FROM ld)
SELECT count(*) AS n, round(covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)), 6) AS rho FROM r""")
def rank_correlation(spark, sf_dir):
    """Rank correlation of length and quality."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return rounded(scores.spearman(joined.select(F.col("n_chars").alias("x"), F.col("quality").alias("y"))))


def _predictions(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(((F.col("doc_id") % 100) / F.lit(100.0)).alias("probability"), F.col("quality").cast("double").alias("outcome"))


@query("""WITH p AS (SELECT (doc_id % 100) / 100.0::DOUBLE AS p, quality AS y FROM labels),
b AS (SELECT len(list_filter([i / 10.0::DOUBLE for i in range(1, 10)], lambda e: e <= p)) AS b, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM p GROUP BY 1)
SELECT round(sum(n * gap) / sum(n), 6) AS calibration_error, sum(n)::BIGINT AS n FROM b""")
def calibration_error(spark, sf_dir):
    """Expected calibration error."""
    return rounded(scores.calibration_error(_predictions(spark, sf_dir)))


@query("SELECT round(avg(((doc_id % 100) / 100.0 - quality) ** 2), 6) AS brier, count(*) AS n FROM labels")
def brier_score(spark, sf_dir):
    """Brier score."""
    return rounded(scores.brier(_predictions(spark, sf_dir)))


@query("""SELECT count(*) AS n, count(*) FILTER (l_linestatus <> 'F') AS invalid, round(avg(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 1.0 ELSE 0.0 END), 6) AS success_rate,
round(avg(CASE WHEN l_linestatus = 'F' THEN l_discount ELSE 0.0 END), 6) AS mean_score FROM lineitem""")
def conservative_rates(spark, sf_dir):
    """Rates with invalid rows as failures."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_linestatus") == "F").alias("valid"), (F.col("l_returnflag") == "A").alias("success"), F.col("l_discount").alias("score"))
    return rounded(scores.conservative_rates(lines))


def _clusters(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("cluster"), F.col("c_acctbal").alias("value"))


@query("""WITH c AS (SELECT c_nationkey::VARCHAR AS cluster, sum(c_acctbal) AS s, count(c_acctbal) AS n FROM customer GROUP BY 1),
m AS (SELECT *, row_number() OVER (ORDER BY cluster) - 1 AS i, count(*) OVER () AS k FROM c),
d AS (SELECT sample, ('0x' || substr(sha256('3|' || sample || '|' || i), 1, 12))::BIGINT % k AS i FROM m, range(0, 10000) t(sample)),
e AS (SELECT sample, sum(s) / sum(n) AS x FROM d JOIN m USING (i) GROUP BY 1)
SELECT (SELECT round(sum(s) / sum(n), 4) FROM c) AS estimate, (SELECT count(*) FROM c) AS clusters, round(list_sort(list(x))[floor(0.025 * (count(*) - 1))::INT + 1], 4) AS ci_low,
round(list_sort(list(x))[floor(0.975 * (count(*) - 1))::INT + 1], 4) AS ci_high, count(*) FILTER (x IS NULL) AS degenerate, false AS fail_closed FROM e""")
def cluster_bootstrap(spark, sf_dir):
    """Interval of the mean balance when nations are drawn 10,000 times."""
    return rounded(resampling.cluster_bootstrap(_clusters(spark, sf_dir), seed=3), 4)


@query(ORACLES["cluster_bootstrap"])
def cluster_bootstrap_10000(spark, sf_dir):
    """The same by its longer name."""
    return cluster_bootstrap(spark, sf_dir)


@query("WITH c AS (SELECT c_nationkey::VARCHAR AS cluster, sum(c_acctbal) AS s, count(*) AS n FROM customer GROUP BY 1) SELECT cluster, round((sum(s) OVER () - s) / (sum(n) OVER () - n), 4) AS mean_without, (sum(n) OVER () - n)::BIGINT AS rows_left FROM c")
def leave_one_cluster_out(spark, sf_dir):
    """The mean balance without each nation."""
    return rounded(resampling.leave_one_cluster_out(_clusters(spark, sf_dir)), 4)


@query()
def randomisation_test(spark, sf_dir):
    """Permutation test over market segments."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("cluster"), F.col("c_acctbal").alias("score"), (F.col("c_custkey") % 10).cast("double").alias("outcome"))
    return rounded(resampling.randomisation_test(rows))


@query("""WITH o AS (SELECT o_orderpriority AS metric, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate NULLS FIRST, o_orderkey) - 1 AS i FROM orders)
SELECT metric, count(*) AS n, arg_min(v, i) AS first_value, arg_max(v, i) AS last_value, round(avg(v), 4) AS mean_value, round(CASE WHEN count(*) < 2 THEN 0 ELSE regr_slope(v, i) END, 4) AS slope FROM o GROUP BY 1""")
def metric_trends(spark, sf_dir):
    """Trend of order totals by priority."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("metric"), F.col("o_orderdate").alias("observed_at"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))
    return rounded(series.metric_trends(rows), 4)


@query("SELECT coalesce(CASE WHEN event_type <> 'view' THEN event_type END, 'unknown') AS event_type, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1")
def timeline_summary(spark, sf_dir):
    """Events by type, views as unknown."""
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("event_type"), F.col("ts").alias("observed_at"))
    return series.timeline_summary(rows, "event_type")


def _trajectories(spark, sf_dir):
    order = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("episode"), order.alias("position"), F.col("props").alias("state_hash"), (F.col("value") / 500).alias("score"), F.when(F.col("event_type") == "error", "error").alias("error")
    )


_TRAJECTORY = """WITH e AS (SELECT user_id AS episode, ts, event_id, props, value / 500 AS score, event_type = 'error' AS err FROM events),
s AS (SELECT *, lag(score) OVER w AS prev, max(score) OVER (PARTITION BY episode ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e WHERE score IS NOT NULL WINDOW w AS (PARTITION BY episode ORDER BY ts, event_id)),
b AS (SELECT *, coalesce(lag(coalesce(score < best, false)) OVER (PARTITION BY episode ORDER BY ts, event_id), false) AS was_below FROM s),
f AS (SELECT episode, arg_min(score, (ts, event_id)) AS a, arg_max(score, (ts, event_id)) AS z, max(score) AS mx, avg(score) AS av, count(*) FILTER (score < prev) AS reg, count(*) FILTER (was_below AND score >= best) AS rec FROM b GROUP BY 1),
c AS (SELECT episode, count(*) AS n_events, count(*) - count(DISTINCT props) AS repeated_states, avg(err::INT) AS er FROM e GROUP BY 1)
SELECT episode, n_events, repeated_states, round(er, 6) AS error_rate, round(a, 6) AS initial_score, round(z, 6) AS final_score, round(mx, 6) AS best_score, round(av, 6) AS mean_score, reg AS regressions, rec AS recoveries, round(z - a, 6) AS improvement{}
FROM c LEFT JOIN f USING (episode)"""


@query(_TRAJECTORY.format(""))
def trajectory_metrics(spark, sf_dir):
    """Trajectories of users."""
    return rounded(series.trajectory_metrics(_trajectories(spark, sf_dir)))


@query(_TRAJECTORY.format(", round(coalesce(z, 0) + coalesce(z - a, 0) - 0.01 * n_events - 0.1 * coalesce(reg, 0), 6) AS utility"))
def trajectory_utility(spark, sf_dir):
    """Utilities of trajectories."""
    return rounded(series.trajectory_utility(series.trajectory_metrics(_trajectories(spark, sf_dir)), "n_events", 1.0, 0.01, 0.1))


@query("""SELECT l_returnflag AS sequence, count(*) AS frames, round(avg((l_discount * 10 + l_tax * 10 + l_quantity / 50) / 3), 6) AS mean_score, round(min((l_discount * 10 + l_tax * 10 + l_quantity / 50) / 3), 6) AS least_score,
round(avg(l_discount * 10), 6) AS mean_a, round(avg(l_tax * 10), 6) AS mean_b, round(avg(l_quantity / 50), 6) AS mean_c FROM lineitem GROUP BY 1""")
def sequence_scores(spark, sf_dir):
    """Frame scores of sequences."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("sequence"), F.col("l_linenumber").alias("frame"), (F.col("l_discount") * 10).alias("a"), (F.col("l_tax") * 10).alias("b"), (F.col("l_quantity") / 50).alias("c"))
    return rounded(series.sequence_scores(rows))


@query("""WITH s AS (SELECT o_orderpriority AS grp, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS k, count(*)::DOUBLE AS n FROM orders GROUP BY 1), c AS (SELECT 1.959963984540054::DOUBLE AS z)
SELECT grp, round(greatest(0, (k / n + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 8) AS low,
round(least(1, (k / n + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 8) AS high FROM s, c""")
def wilson_intervals(spark, sf_dir):
    """Intervals of finished shares by priority."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("grp")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count("*").alias("n"))
    low, high = closed_forms.wilson_interval(F.col("k"), F.col("n"))
    return rounded(counts.select("grp", low.alias("low"), high.alias("high")), 8)


@query("""SELECT p_size AS k, round(1 + (p_size - 1) * 0.05, 8) AS deff, round(1000 / (1 + (p_size - 1) * 0.05), 8) AS n_eff, round(least(1, 2.8015852181095886 * sqrt(0.5) / sqrt(p_size)), 8) AS mde,
greatest(1, ceil(0.8 * (1 - p_size / 60) / (p_size / 60 * (1 - 0.8)) - 1e-12))::BIGINT AS raters, round(least(0.99, 0.55 + 0.07 * p_size), 8) AS power,
round((p_size / 60) ** 3 + 3 * (p_size / 60) ** 2 * (1 - p_size / 60), 8) AS majority FROM (SELECT DISTINCT p_size FROM part)""")
def design_table(spark, sf_dir):
    """Design figures by part size."""
    k = F.col("k")
    out = table(spark, sf_dir, "part").select(F.col("p_size").alias("k")).distinct().select(
        "k", closed_forms.design_effect(k, F.lit(0.05).cast("double")).alias("deff"), closed_forms.effective_sample_size(F.lit(1000), k, F.lit(0.05).cast("double")).alias("n_eff"), closed_forms.detectable_difference(k).alias("mde"),
        closed_forms.required_raters(k / 60).alias("raters"), closed_forms.assumed_power(k).alias("power"), closed_forms.majority_probability(3, k / 60).alias("majority"),
    )
    return rounded(out, 8)


@query("""WITH t AS (SELECT p_partkey, string_split(lower(p_type), ' ') AS a, string_split(lower(p_name), ' ') AS v FROM part)
SELECT p_partkey, q.id AS question_id, q.critical AS critical FROM (SELECT p_partkey, unnest(list_concat([{'id': 'animal-present', 'critical': true}, {'id': 'object-present', 'critical': true}], list_transform(a, lambda f: {'id': 'animal-feature:' || f, 'critical': false}),
list_transform(v, lambda f: {'id': 'object-feature:' || f, 'critical': false}), [{'id': 'relation:rides_on', 'critical': true}], [{'id': 'scene-coherent', 'critical': false}])) AS q FROM t)""")
def task_questions(spark, sf_dir):
    """Questions of parts as tasks."""
    relations = F.array(F.struct(F.lit("rides_on").alias("predicate"), F.lit(True).alias("required")))
    rows = closed_forms.question_rows(F.split(F.lower("p_type"), " "), F.split(F.lower("p_name"), " "), relations)
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(rows).alias("q")).select("p_partkey", "q.question_id", "q.critical")
