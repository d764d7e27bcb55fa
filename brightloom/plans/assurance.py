"""Queries of blinding, endpoint, ontology, assessment, receipt and release operators, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightloom.operators import assessments, blinding, concepts, endpoints, leases, ledger, metamorphic, planning, provenance, rasters, release, resampling, scorecard, sessions
from brightloom.plans import records
from brightloom.plans.base import registry, rounded
from brightloom.plans.records import _SECRET, _hmac_sql
from brightloom.session import table
from brightloom.sources.records import raster_statistics

QUERIES, ORACLES, query = registry()


# blinding


def _blinded(spark, sf_dir):
    models = table(spark, sf_dir, "supplier").select(F.concat(F.lit("M"), F.col("s_suppkey").cast("string")).alias("model_id"))
    return blinding.aliases(models, _SECRET, "S1")


_KEYED = "'S1' || chr(31) || 'M' || s_suppkey"


@query(f"SELECT 'M' || s_suppkey AS model_id, 'SYS-' || upper(substr({_hmac_sql('alias', _KEYED)}, 1, 12)) AS alias FROM supplier")
def blinding_map(spark, sf_dir):
    """Suppliers as models under their aliases."""
    return _blinded(spark, sf_dir)


@query(f"SELECT (row_number() OVER (ORDER BY {_hmac_sql('display-order', _KEYED)}))::INT AS position, 'SYS-' || upper(substr({_hmac_sql('alias', _KEYED)}, 1, 12)) AS alias FROM supplier")
def blinding_list(spark, sf_dir):
    """The aliases in public order."""
    return blinding.public_list(_blinded(spark, sf_dir), _SECRET, "S1")


@query("SELECT unnest(['honest', 'renamed', 'shown']) AS manifest, unnest([true, true, false]) AS names_hidden, true AS aliases_unique, unnest([true, false, false]) AS aliases_match, true AS headers_match, true AS count_matches, true AS key_verified, true AS mapping_verified, unnest([true, false, false]) AS passed")
def blinding_verifications(spark, sf_dir):
    """An honest list, one with a foreign alias, and one that shows a model's name."""
    private = _blinded(spark, sf_dir)
    head, public = blinding.header(private, _SECRET, "S1", "sha256:0"), blinding.public_list(private, _SECRET, "S1")
    first = lambda other: public.withColumn("alias", F.when(F.col("position") == 1, other).otherwise(F.col("alias")))
    lists = {"honest": public, "renamed": first("SYS-F"), "shown": first("SYS-M1")}
    out = [blinding.verification(listed, private, head, head, _SECRET).select(F.lit(name).alias("manifest"), "*") for name, listed in lists.items()]
    return out[0].union(out[1]).union(out[2])


# statistics of clusters, endpoints


def _locked(spark, sf_dir):
    """Labelled documents as episodes of clusters by source and language."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id").select(F.col("doc_id").alias("episode_id"), F.concat_ws("|", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-"))).alias("cluster"), "n_chars")


def _ratings(spark, sf_dir):
    k = F.col("doc_id")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    rows = _locked(spark, sf_dir).join(labels, F.col("episode_id") == k)
    valid = k % 19 != 3
    return rows.select(
        F.concat(F.lit("r"), k.cast("string")).alias("row_id"), "episode_id", "cluster", valid.alias("valid"), F.when(valid, F.col("q")).alias("outcome"), F.when(~valid, "blurred").alias("invalid_reason"), F.lit(None).cast("string").alias("duplicate_of"),
    )


_EPISODES = """l AS (SELECT DISTINCT doc_id FROM labels), q AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1),
r AS (SELECT d.doc_id, coalesce(source, '-') || '|' || coalesce(lang, '-') AS cluster, floor(coalesce(n_chars, 0) / 300)::DOUBLE AS x, q.q AS y, d.doc_id % 19 <> 3 AS valid FROM documents d JOIN l USING (doc_id) JOIN q USING (doc_id))"""
_DRAWS = """c AS (SELECT DISTINCT cluster FROM v), m AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS i, count(*) OVER () AS k FROM c),
d AS (SELECT sample, ('0x' || substr(sha256('7|' || sample || '|' || i), 1, 12))::BIGINT % k AS i FROM m, range(0, 10000) t(sample)),
g AS (SELECT cluster, x, y, count(*) AS n FROM v GROUP BY ALL), t AS (SELECT sample, cluster, count(*) AS times FROM d JOIN m USING (i) GROUP BY ALL),
p AS (SELECT sample, x, y, sum(n * times) AS w FROM g JOIN t USING (cluster) GROUP BY ALL UNION ALL SELECT -1, x, y, sum(n) FROM g GROUP BY ALL)"""
_AUC = """s AS (SELECT sample, x, coalesce(sum(w) FILTER (y = 1), 0) AS pos, coalesce(sum(w) FILTER (y = 0), 0) AS neg FROM {pairs} GROUP BY 1, 2),
u AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY sample ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
e AS (SELECT sample, sum(pos * (before + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS value FROM u GROUP BY 1)"""
_INTERVAL = """o AS (SELECT list_sort(list(value) FILTER (value IS NOT NULL)) AS a, count(*) FILTER (value IS NOT NULL) AS n FROM e WHERE sample >= 0)
SELECT round((SELECT value FROM e WHERE sample = -1), 6) AS estimate, (SELECT count(*) FROM c) AS clusters, CASE WHEN n >= 9000 THEN round(a[floor(0.025 * (n - 1))::INT + 1], 6) END AS ci_low,
CASE WHEN n >= 9000 THEN round(a[floor(0.975 * (n - 1))::INT + 1], 6) END AS ci_high, 10000 - n AS degenerate, n < 9000 AS fail_closed FROM o"""


def _pairs(spark, sf_dir):
    """(cluster, x, y) of valid episodes: length in steps of 300 characters, quality."""
    ratings = _ratings(spark, sf_dir).where("valid").select("episode_id", "cluster", F.col("outcome").alias("y"))
    sizes = _locked(spark, sf_dir).select("episode_id", F.floor(F.coalesce("n_chars", F.lit(0)) / 300).cast("double").alias("x"))
    return ratings.join(sizes, "episode_id").select("cluster", "x", "y")


@query(f"WITH {_EPISODES}, v AS (SELECT * FROM r WHERE valid), {_DRAWS}, {_AUC.format(pairs='p')}, {_INTERVAL}")
def auc_bootstrap(spark, sf_dir):
    """The interval of an area under the curve when whole clusters are drawn 10,000 times."""
    return rounded(resampling.statistic_bootstrap(_pairs(spark, sf_dir), resampling.weighted_auc, seed=7))


@query(f"""WITH {_EPISODES}, v AS (SELECT * FROM r WHERE valid), {_DRAWS},
k AS (SELECT sample, w, sum(w) OVER (PARTITION BY sample ORDER BY x) - sum(w) OVER (PARTITION BY sample, x) / 2 + 0.5 AS rx, sum(w) OVER (PARTITION BY sample ORDER BY y) - sum(w) OVER (PARTITION BY sample, y) / 2 + 0.5 AS ry, (sum(w) OVER (PARTITION BY sample) + 1) / 2 AS a FROM p),
e AS (SELECT sample, sum(w * (rx - a) * (ry - a)) / nullif(sqrt(sum(w * (rx - a) * (rx - a))) * sqrt(sum(w * (ry - a) * (ry - a))), 0) AS value FROM k GROUP BY 1), {_INTERVAL}""")
def rank_bootstrap(spark, sf_dir):
    """The interval of a rank correlation when whole clusters are drawn 10,000 times."""
    return rounded(resampling.statistic_bootstrap(_pairs(spark, sf_dir), resampling.weighted_spearman, seed=7))


_LEFT_OUT = f"""{_EPISODES}, v AS (SELECT * FROM r WHERE valid), c AS (SELECT DISTINCT cluster FROM v), lp AS (SELECT c.cluster AS sample, x, y, count(*) AS w FROM c JOIN v ON v.cluster <> c.cluster GROUP BY ALL), {_AUC.format(pairs='lp')}"""


@query(f"WITH {_LEFT_OUT} SELECT cluster AS omitted, round(value, 6) AS estimate, (SELECT count(value) FROM e) < (SELECT count(*) FROM c) AS fail_closed FROM c LEFT JOIN e ON sample = cluster")
def auc_without_each_cluster(spark, sf_dir):
    """The area under the curve without each cluster."""
    return rounded(resampling.leave_one_out(_pairs(spark, sf_dir), resampling.weighted_auc))


@query(f"""WITH {_EPISODES}, b AS (SELECT doc_id, 'r' || doc_id AS row_id, cluster, valid, CASE WHEN doc_id % 23 = 5 THEN NULL ELSE y END AS y, doc_id % 29 = 7 AS moved, doc_id % 31 <> 8 AS kept, doc_id % 37 = 9 AS again FROM r)
SELECT row_id AS subject, unnest(list_filter([CASE WHEN valid AND y IS NULL THEN 'valid-without-outcome' END, CASE WHEN NOT valid AND y IS NOT NULL THEN 'invalid-with-outcome' END, CASE WHEN moved THEN 'other-cluster' END], lambda f: f IS NOT NULL)) AS finding FROM b WHERE kept
UNION ALL SELECT doc_id::VARCHAR, 'no-base-row' FROM b WHERE NOT kept UNION ALL SELECT 'd' || doc_id, 'duplicate-of-no-base-row' FROM b WHERE again AND NOT kept UNION ALL SELECT 'd' || doc_id, 'invalid-with-outcome' FROM b WHERE again AND NOT valid AND y IS NOT NULL
UNION ALL SELECT 'd' || doc_id, 'valid-without-outcome' FROM b WHERE again AND valid AND y IS NULL UNION ALL SELECT 'd' || doc_id, 'other-cluster' FROM b WHERE again AND moved""")
def rating_findings(spark, sf_dir):
    """What is wrong with ratings of which some are missing, moved, unanswered or repeat a row that is not there."""
    k = F.col("episode_id")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    every = _ratings(spark, sf_dir).join(labels, k == F.col("doc_id")).withColumn("outcome", F.when(k % 23 != 5, F.col("q"))).withColumn("cluster", F.when(k % 29 == 7, "elsewhere").otherwise(F.col("cluster"))).drop("doc_id", "q")
    again = every.where(k % 37 == 9).withColumn("duplicate_of", F.col("row_id")).withColumn("row_id", F.concat(F.lit("d"), k.cast("string")))
    return endpoints.rating_findings(every.where(k % 31 != 8).union(again), _locked(spark, sf_dir))


@query(f"""WITH {_EPISODES}, v AS (SELECT * FROM r WHERE valid), {_DRAWS}, {_AUC.format(pairs='p')}, o AS (SELECT list_sort(list(value) FILTER (value IS NOT NULL)) AS a, count(*) FILTER (value IS NOT NULL) AS n FROM e WHERE sample >= 0),
lp AS (SELECT c.cluster AS sample, x, y, count(*) AS w FROM c JOIN v ON v.cluster <> c.cluster GROUP BY ALL), ls AS (SELECT sample, x, coalesce(sum(w) FILTER (y = 1), 0) AS pos, coalesce(sum(w) FILTER (y = 0), 0) AS neg FROM lp GROUP BY 1, 2),
lu AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY sample ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ls), le AS (SELECT sample, sum(pos * (before + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS value FROM lu GROUP BY 1),
h AS (SELECT sha256('=' || doc_id || chr(31) || '=' || cluster || chr(31) || '=' || valid || chr(31) || CASE WHEN valid THEN '=' || y ELSE '-' END) AS h FROM r), lh AS (SELECT substr(h, 1, 3) AS leaf, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1),
z AS (SELECT (SELECT count(*) FROM r) AS locked, (SELECT count(*) FROM v) AS valid, (SELECT count(*) FROM v WHERE y = 0) AS class_0, (SELECT count(*) FROM v WHERE y = 1) AS class_1, (SELECT count(DISTINCT cluster) FROM v WHERE y = 0) AS clusters_0, (SELECT count(DISTINCT cluster) FROM v WHERE y = 1) AS clusters_1,
  round((SELECT value FROM e WHERE sample = -1), 6) AS estimate, CASE WHEN n >= 9000 THEN round(a[floor(0.025 * (n - 1))::INT + 1], 6) END AS ci_low, CASE WHEN n >= 9000 THEN round(a[floor(0.975 * (n - 1))::INT + 1], 6) END AS ci_high, 10000 - n AS degenerate,
  (SELECT round(min(value), 6) FROM le) AS loo_low, (SELECT round(max(value), 6) FROM le) AS loo_high, n < 9000 OR (SELECT count(value) FROM le) < (SELECT count(*) FROM c) AS fail_closed, (SELECT sha256(string_agg(h, '' ORDER BY leaf)) FROM lh) AS rows_sha256 FROM o)
SELECT 'quality' AS endpoint, *, sha256(concat_ws(chr(31), 'quality', locked, valid, class_0, class_1, clusters_0, clusters_1, coalesce(round(estimate * 1e6)::BIGINT::VARCHAR, 'none'), coalesce(round(ci_low * 1e6)::BIGINT::VARCHAR, 'none'), coalesce(round(ci_high * 1e6)::BIGINT::VARCHAR, 'none'),
  coalesce(round(loo_low * 1e6)::BIGINT::VARCHAR, 'none'), coalesce(round(loo_high * 1e6)::BIGINT::VARCHAR, 'none'), degenerate, fail_closed, rows_sha256)) AS receipt_sha256 FROM z""")
def endpoint_receipt(spark, sf_dir):
    """The receipt of an endpoint: length as the score, quality as the outcome."""
    scores = _locked(spark, sf_dir).select("episode_id", F.floor(F.coalesce("n_chars", F.lit(0)) / 300).alias("score"))
    return rounded(endpoints.endpoint_receipt(_ratings(spark, sf_dir), _locked(spark, sf_dir), scores, "quality", seed=7))


# ontologies


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 97 = 5 THEN c_custkey + 1 WHEN c_custkey % 97 = 6 THEN c_custkey + 1 WHEN c_custkey % 97 = 7 THEN c_custkey - 2 WHEN c_custkey % 101 = 3 THEN 0 WHEN c_custkey > 1 THEN c_custkey // 2 END AS up FROM customer),
w AS (SELECT k, up FROM e WHERE up IS NOT NULL UNION SELECT w.k, e.up FROM w JOIN e ON w.up = e.k WHERE e.up IS NOT NULL)
SELECT 'C' || k AS subject, 'unknown-parent' AS finding FROM e WHERE up IS NOT NULL AND up NOT IN (SELECT k FROM e) UNION ALL SELECT 'C' || k, 'cycle' FROM w WHERE k = up
UNION ALL SELECT 'C' || c_custkey, 'unknown-tier' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT n_name, 'unknown-inverse' FROM nation WHERE n_nationkey % 7 = 4
UNION ALL SELECT * FROM (SELECT 'Q' || (n_nationkey % 20) AS q, 'repeated-question' FROM nation GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT '', 'question-without-name'""")
def ontology_findings(spark, sf_dir):
    """Customers as a tree of concepts, with rings of three and parents that do not exist."""
    k = F.col("c_custkey")
    up = F.when(k % 97 == 5, k + 1).when(k % 97 == 6, k + 1).when(k % 97 == 7, k - 2).when(k % 101 == 3, F.lit(0)).when(k > 1, F.floor(k / 2))
    name = lambda c: F.concat(F.lit("C"), c.cast("long").cast("string"))
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    tiers = F.when(F.col("c_mktsegment") == "BUILDING", "necessary").when(F.col("c_mktsegment") == "MACHINERY", "optional").otherwise(F.col("c_mktsegment"))
    relations = nations.select(F.col("n_name").alias("relation"), F.when(F.col("n_nationkey") % 7 == 4, "nothing").when(F.col("n_nationkey") % 7 != 5, F.col("n_name")).alias("inverse"))
    questions = nations.select(F.concat(F.lit("Q"), (F.col("n_nationkey") % 20).cast("string")).alias("question")).union(spark.sql("SELECT CAST(NULL AS STRING)"))
    return concepts.ontology_findings(customers.select(name(k).alias("concept"), name(up).alias("parent")), customers.select(name(k).alias("concept"), F.lit("f").alias("feature"), tiers.alias("tier")), relations, questions)


@query("""WITH w AS (SELECT p_partkey, 'A' || p_size AS a, p_brand AS o, 'R' || p_partkey % 5 AS r FROM part)
SELECT p_partkey, a AS animal, o AS object, r AS relation, CASE WHEN p_partkey % 50 > 40 OR substr(a, 2)::INT > 45 THEN 'unknown-animal' WHEN r = 'R4' THEN 'unknown-relation' WHEN r = 'R1' AND substr(o, 7, 1)::INT > 3 THEN 'class-not-allowed' END AS problem,
CASE WHEN problem IS NULL THEN 'beak,' || lower(a) END AS features FROM (SELECT p_partkey, CASE WHEN p_partkey % 50 > 40 THEN 'none' ELSE a END AS a, o, r FROM w)""")
def composed_scenes(spark, sf_dir):
    """Parts as wishes for scenes."""
    parts = table(spark, sf_dir, "part")
    wanted = parts.select("p_partkey", F.when(F.col("p_partkey") % 50 > 40, "none").otherwise(F.concat(F.lit("A"), F.col("p_size").cast("string"))).alias("animal"), F.col("p_brand").alias("object"), F.concat(F.lit("R"), (F.col("p_partkey") % 5).cast("string")).alias("relation"))
    animals = spark.range(1, 46).select(F.concat(F.lit("A"), F.col("id").cast("string")).alias("concept"), F.lit("bird").alias("class"), F.array(F.concat(F.lit("a"), F.col("id").cast("string")), F.lit("beak")).alias("features"))
    objects = parts.select(F.col("p_brand").alias("concept"), F.when(F.substring("p_brand", 7, 1).cast("int") > 3, "boat").otherwise("cart").alias("class"), F.array().cast("array<string>").alias("features")).distinct()
    kinds = {"R0": [], "R1": ["cart"], "R2": ["cart", "boat"], "R3": []}
    relations = spark.createDataFrame([(r, c, []) for r, c in kinds.items()], "relation string, allowed_classes array<string>, features array<string>")
    keyed = wanted.withColumn("key", F.concat_ws("|", "animal", "object", "relation"))
    scenes = concepts.compose_scenes(wanted.select("animal", "object", "relation").distinct(), animals, objects, relations).withColumn("key", F.concat_ws("|", "animal", "object", "relation"))
    features = F.when(F.col("animal_features").isNotNull(), F.array_join(F.reverse(F.array_sort("animal_features")), ","))
    return keyed.join(scenes.select("key", "problem", features.alias("features")), "key").select("p_partkey", "animal", "object", "relation", "problem", "features")


# assessments


def _judged(spark, sf_dir):
    """Parts as tasks with two questions of their own; line items as answers of suppliers."""
    tasks = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("task_id"), F.array(F.col("p_brand")).alias("animal_features"), F.array().cast("array<string>").alias("object_features"),
        F.array(F.struct(F.col("p_container").alias("predicate") if "p_container" in table(spark, sf_dir, "part").columns else F.lit("on").alias("predicate"), (F.col("p_size") % 2 == 0).alias("required"))).alias("relations"), F.concat(F.lit("h"), (F.col("p_partkey") % 7).cast("string")).alias("render_hash"),
    )
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    question = F.when(n == 1, "animal-present").when(n == 2, "object-present").when(n == 3, "scene-coherent").when(n == 4, "relation:on").otherwise("sky-present")
    answers = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("task_id"), F.concat(F.lit("h"), F.when(k % 41 == 0, F.lit(9)).otherwise(F.col("l_partkey") % 7).cast("string")).alias("render_hash"), question.alias("question_id"), F.concat(F.lit("J"), (F.col("l_suppkey") % 5).cast("string")).alias("judge_id"),
        F.lit("1").alias("judge_revision"), F.when(k % 43 != 0, F.round(F.col("l_discount") * 10, 6)).alias("probability"), (k % 47 != 0).alias("source_independent"),
    )
    return tasks, answers


_ANSWERS = """a AS (SELECT l_partkey AS task_id, 'h' || CASE WHEN l_orderkey % 41 = 0 THEN 9 ELSE l_partkey % 7 END AS render_hash, CASE l_linenumber WHEN 1 THEN 'animal-present' WHEN 2 THEN 'object-present' WHEN 3 THEN 'scene-coherent' WHEN 4 THEN 'relation:on' ELSE 'sky-present' END AS question_id,
  'J' || l_suppkey % 5 AS judge_id, CASE WHEN l_orderkey % 43 <> 0 THEN round(l_discount * 10, 6) END AS probability, l_orderkey % 47 <> 0 AS source_independent FROM lineitem)"""


@query(f"""WITH {_ANSWERS}, n AS (SELECT *, row_number() OVER (PARTITION BY task_id, judge_id, question_id ORDER BY render_hash, probability NULLS FIRST) AS nth FROM a), c AS (SELECT p_partkey AS task_id, unnest(CASE WHEN p_size % 2 = 0 THEN ['animal-present', 'object-present', 'relation:on'] ELSE ['animal-present', 'object-present'] END) AS question_id FROM part),
f AS (SELECT task_id, judge_id, question_id, unnest(list_filter([CASE WHEN question_id = 'sky-present' THEN 'unknown-question' END, CASE WHEN nth > 1 THEN 'repeated-question' END, CASE WHEN probability IS NULL OR probability > 1 THEN 'no-probability' END, CASE WHEN render_hash <> 'h' || task_id % 7 THEN 'other-render' END,
  CASE WHEN NOT source_independent THEN 'saw-the-source' END], lambda x: x IS NOT NULL)) AS finding FROM n UNION ALL SELECT task_id, judge_id, question_id, 'critical-question-missing' FROM (SELECT DISTINCT task_id, judge_id FROM a) JOIN c USING (task_id) ANTI JOIN a USING (task_id, judge_id, question_id))
SELECT finding, count(*) AS n, sum(task_id)::BIGINT AS tasks, count(DISTINCT judge_id || question_id) AS places FROM f GROUP BY 1""")
def answer_findings(spark, sf_dir):
    """What is wrong with answers, by kind."""
    tasks, answers = _judged(spark, sf_dir)
    found = assessments.answer_findings(answers, tasks)
    return found.groupBy("finding").agg(F.count("*").alias("n"), F.sum("task_id").alias("tasks"), F.count_distinct(F.concat("judge_id", "question_id")).alias("places"))


@query(f"""WITH {_ANSWERS}, e AS (SELECT task_id, render_hash, question_id, round(sum(probability * CASE judge_id WHEN 'J1' THEN 2.5 WHEN 'J3' THEN 0 ELSE 1 END) / sum(CASE judge_id WHEN 'J1' THEN 2.5 WHEN 'J3' THEN 0 ELSE 1 END), 6) AS p FROM a WHERE probability <= 1 AND judge_id <> 'J3' AND question_id <> 'sky-present' AND render_hash = 'h' || task_id % 7 GROUP BY ALL),
c AS (SELECT p_partkey AS task_id, CASE WHEN p_size % 2 = 0 THEN ['animal-present', 'object-present', 'relation:on'] ELSE ['animal-present', 'object-present'] END AS due FROM part)
SELECT task_id, render_hash, count(*) AS questions, count(*) FILTER (list_contains(due, question_id)) = any_value(len(due)) AS complete, 'sem:' || substr(sha256(task_id || chr(31) || render_hash || chr(31) || string_agg(question_id || '=' || round(p * 1000000)::BIGINT, ';' ORDER BY question_id)), 1, 24) AS assessment_id FROM e JOIN c USING (task_id) GROUP BY 1, 2""")
def ensemble_assessments(spark, sf_dir):
    """Assessments of an ensemble in which one judge counts more."""
    tasks, answers = _judged(spark, sf_dir)
    good = answers.where("probability <= 1 AND judge_id <> 'J3' AND question_id <> 'sky-present' AND render_hash = concat('h', task_id % 7)")
    agreed = assessments.ensembles(good, spark.createDataFrame([("J1", 2.5), ("J3", 0.0)], "judge_id string, weight double"))
    out = assessments.assessments(agreed.withColumn("probability", F.round("probability", 6)), tasks)
    return out.select("task_id", "render_hash", F.size("answers").cast("long").alias("questions"), "complete", "assessment_id")


# receipts and logs


@query("""WITH w AS (SELECT user_id % 50 AS campaign_id, event_id AS position, user_id::VARCHAR AS cell_id, CASE event_type WHEN 'view' THEN 'leased' WHEN 'click' THEN 'ready' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' ELSE 'leased' END AS new_state,
  CASE WHEN event_id % 17 <> 0 THEN event_type ELSE ' ' END AS reason, value - 5 AS cost, CASE WHEN event_id % 3 <> 0 THEN 'a' || event_id END AS artifact_id FROM events),
c AS (SELECT cell_id, list({'p': position, 'n': new_state, 'bad': CASE WHEN coalesce(cost, -1) < 0 THEN 'cost-below-zero' WHEN trim(reason) = '' THEN 'no-reason' WHEN new_state = 'succeeded' AND artifact_id IS NULL THEN 'no-artifact' ELSE '' END} ORDER BY position) AS x FROM w GROUP BY 1),
f AS (SELECT cell_id, list_reduce(list_transform(x, lambda e: [[e.p::VARCHAR, e.n, e.bad, '']]), lambda acc, e: list_append(acc, [e[1][1], e[1][2], CASE WHEN (CASE acc[len(acc)][4] WHEN 'ready' THEN e[1][2] IN ('leased', 'cancelled') WHEN 'leased' THEN e[1][2] IN ('ready', 'succeeded', 'failed', 'quarantined', 'cancelled') WHEN 'failed' THEN e[1][2] = 'ready' ELSE false END) THEN e[1][3] ELSE 'illegal-transition:' || acc[len(acc)][4] || '>' || e[1][2] END,
  CASE WHEN (CASE acc[len(acc)][4] WHEN 'ready' THEN e[1][2] IN ('leased', 'cancelled') WHEN 'leased' THEN e[1][2] IN ('ready', 'succeeded', 'failed', 'quarantined', 'cancelled') WHEN 'failed' THEN e[1][2] = 'ready' ELSE false END) AND e[1][3] = '' THEN e[1][2] ELSE acc[len(acc)][4] END]), [['', '', '', 'ready']]) AS y FROM c),
j AS (SELECT cell_id, unnest(y[2:]) AS z FROM f), r AS (SELECT w.*, z[3] AS refused FROM j JOIN w ON w.position = z[1]::BIGINT),
k AS (SELECT campaign_id, list([cell_id, new_state, reason, round(cost * 1000000)::BIGINT::VARCHAR, coalesce(artifact_id, ''), position::VARCHAR] ORDER BY position) AS x FROM r WHERE refused = '' GROUP BY 1),
h AS (SELECT campaign_id, list_reduce(list_transform(x, lambda e, i: [list_concat(e, [(i - 1)::VARCHAR])]), lambda acc, e: list_append(acc, [sha256(acc[len(acc)][1] || chr(31) || e[1][7] || chr(31) || e[1][1] || chr(31) || e[1][2] || chr(31) || e[1][3] || chr(31) || e[1][4] || chr(31) || e[1][5]), e[1][7], e[1][6]]), [[repeat('0', 64), '', '']]) AS y FROM k),
g AS (SELECT campaign_id, unnest(y[2:]) AS z FROM h)
SELECT r.campaign_id, r.position, r.cell_id, nullif(refused, '') AS refused, z[2]::BIGINT AS sequence, z[1] AS event_hash FROM r LEFT JOIN g ON g.campaign_id = r.campaign_id AND z[3]::BIGINT = r.position""")
def appended_events(spark, sf_dir):
    """Events as wishes to append to fifty logs: what is appended, with its hash, and what is refused."""
    return ledger.appended(_wanted(spark, sf_dir)).select("campaign_id", "position", "cell_id", "refused", "sequence", "event_hash")


def _wanted(spark, sf_dir):
    t, e = F.col("event_type"), F.col("event_id")
    state = F.when(t == "view", "leased").when(t == "click", "ready").when(t == "error", "failed").when(t == "purchase", "succeeded").otherwise("leased")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 50).alias("campaign_id"), e.alias("position"), F.col("user_id").cast("string").alias("cell_id"), state.alias("new_state"), F.when(e % 17 != 0, t).otherwise(" ").alias("reason"), (F.col("value") - 5).alias("cost"), F.when(e % 3 != 0, F.concat(F.lit("a"), e.cast("string"))).alias("artifact_id"),
    )


@query(f"""WITH a AS (SELECT * FROM ({ORACLES['appended_events']}) WHERE sequence IS NOT NULL), b AS (SELECT * FROM a WHERE position % 23 <> 0 OR sequence = 0)
SELECT campaign_id, sequence, unnest(list_filter([CASE WHEN sequence > 0 AND NOT EXISTS (SELECT 1 FROM b p WHERE p.campaign_id = b.campaign_id AND p.sequence = b.sequence - 1) THEN 'gap' END, CASE WHEN position % 29 = 0 THEN 'hash-drift' END], lambda f: f IS NOT NULL)) AS finding FROM b""")
def log_findings(spark, sf_dir):
    """The fifty logs with some events lost and some costs changed afterwards."""
    log = ledger.appended(_wanted(spark, sf_dir)).where("sequence is not null and (position % 23 <> 0 or sequence = 0)")
    changed = log.withColumn("cost", F.when(F.col("position") % 29 == 0, F.col("cost") + 1).otherwise(F.col("cost")))
    return ledger.hash_findings(changed)


def _responses(spark, sf_dir):
    stage = F.element_at(F.array(*[F.lit(s) for s in (*sessions.STAGES, "debrief")]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("assignment_id"), F.col("event_id").alias("position"), stage.alias("stage"), F.concat(F.lit("art"), (F.col("user_id") % 9).cast("string")).alias("artifact_id"), F.col("props").alias("response"))


@query("""WITH s AS (SELECT user_id AS u, event_id AS p, event_id % 4 + 1 AS k, props, 'art' || user_id % 9 AS art FROM events), d1 AS (SELECT u, min(p) AS p FROM s WHERE k = 1 GROUP BY 1), d2 AS (SELECT s.u, min(s.p) AS p FROM s JOIN d1 ON s.u = d1.u AND s.p > d1.p WHERE k = 2 GROUP BY 1),
d3 AS (SELECT s.u, min(s.p) AS p FROM s JOIN d2 ON s.u = d2.u AND s.p > d2.p WHERE k = 3 GROUP BY 1), h AS (SELECT s.*, 'sha256:' || sha256(props) AS rh FROM s),
r1 AS (SELECT h.*, 'blind-recognition' AS stage, NULL AS prev, 'sha256:' || sha256(concat_ws(chr(31), h.u, art, 'blind-recognition', rh, '')) AS own FROM h JOIN d1 USING (u, p)),
r2 AS (SELECT h.*, 'prompt-aware-criteria' AS stage, r1.own AS prev, 'sha256:' || sha256(concat_ws(chr(31), h.u, h.art, 'prompt-aware-criteria', h.rh, r1.own)) AS own FROM h JOIN d2 USING (u, p) JOIN r1 USING (u)),
r3 AS (SELECT h.*, 'pairwise-preference' AS stage, r2.own AS prev, 'sha256:' || sha256(concat_ws(chr(31), h.u, h.art, 'pairwise-preference', h.rh, r2.own)) AS own FROM h JOIN d3 USING (u, p) JOIN r2 USING (u))
SELECT u AS assignment_id, p AS position, stage, rh AS response_hash, prev AS previous_receipt_hash, own AS receipt_hash FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)""")
def session_receipts(spark, sf_dir):
    """Receipts of what users' sessions accept."""
    return sessions.receipts(_responses(spark, sf_dir)).drop("artifact_id")


@query(f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY assignment_id ORDER BY position) AS k FROM ({ORACLES['session_receipts']})), b AS (SELECT * FROM a WHERE NOT (k = 1 AND assignment_id % 11 = 0))
SELECT assignment_id, stage, unnest(list_filter([CASE WHEN k = 2 AND assignment_id % 11 = 0 THEN 'stage-missing' END, CASE WHEN k = 2 AND assignment_id % 13 = 0 THEN 'hash-drift' END], lambda f: f IS NOT NULL)) AS finding FROM b""")
def receipt_findings(spark, sf_dir):
    """Receipts of which some are lost and some have another response."""
    found = sessions.receipts(_responses(spark, sf_dir))
    first, second = F.col("stage") == sessions.STAGES[0], F.col("stage") == sessions.STAGES[1]
    kept = found.where(~(first & (F.col("assignment_id") % 11 == 0)))
    return sessions.receipt_findings(kept.withColumn("response_hash", F.when(second & (F.col("assignment_id") % 13 == 0), "sha256:0").otherwise(F.col("response_hash"))))


@query()
def lease_outcomes(spark, sf_dir):
    """Events as requests of workers for a hundred cells."""
    e, t = F.col("event_id"), F.col("event_type")
    action = F.when(t.isin("view", "signup"), "lease").when(t == "click", "heartbeat").otherwise("complete")
    worker = F.concat(F.lit("w"), (F.col("user_id") % 3).cast("string"))
    requests = table(spark, sf_dir, "events").select(
        F.concat(F.lit("c"), (F.col("user_id") % 100).cast("string")).alias("cell_id"), F.col("ts").alias("at"), e.alias("request_id"), action.alias("action"), worker.alias("worker_id"), F.concat(F.lit("t"), worker).alias("lease_token"),
        F.when(t == "purchase", "succeeded").otherwise("ready").alias("new_state"), F.when(e % 3 == 0, "a").alias("artifact_id"),
    )
    return leases.replay(requests, 86400)


# release


def _tasks(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("position"), F.concat_ws("|", "p_name", "p_type").alias("task"))


_SEALED = "s AS (SELECT p_partkey AS position, p_name || '|' || p_type AS task, sha256('v1' || chr(31) || 'secret' || chr(31) || p_partkey) AS salt FROM part), c AS (SELECT *, sha256(salt || chr(31) || task) AS commitment FROM s)"


@query(f"WITH {_SEALED} SELECT position, commitment FROM c")
def sealed_commitments(spark, sf_dir):
    """Parts as tasks of a sealed challenge."""
    return release.sealed(_tasks(spark, sf_dir), "v1", "secret").select("position", "commitment")


def _revealed(spark, sf_dir):
    whole = release.sealed(_tasks(spark, sf_dir), "v1", "secret")
    p = F.col("position")
    shown = whole.where(p % 19 != 3).select(F.when(p % 29 == 7, p + 1).otherwise(p).alias("position"), F.when(p % 23 == 4, "another").otherwise(F.col("task")).alias("task"), "salt")
    return whole.select("position", "commitment"), shown


_REVEALED = f"{_SEALED}, r AS (SELECT CASE WHEN position % 29 = 7 THEN position + 1 ELSE position END AS position, position AS was, position % 23 = 4 AS changed FROM c WHERE position % 19 <> 3), f AS (SELECT position, CASE WHEN changed THEN 'never-committed' WHEN position <> was THEN 'committed-elsewhere' END AS finding FROM r UNION ALL SELECT position, 'revealed-twice' FROM r GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT position, 'not-revealed' FROM c ANTI JOIN r USING (position))"


@query(f"WITH {_REVEALED} SELECT position, finding FROM f WHERE finding IS NOT NULL")
def reveal_findings(spark, sf_dir):
    """A reveal with some tasks kept back, changed or shifted."""
    return release.reveal_findings(*_revealed(spark, sf_dir), whole=True)


@query(f"""WITH {_REVEALED}, h AS (SELECT sha256('=' || position || chr(31) || '=' || commitment) AS h FROM c), l AS (SELECT substr(h, 1, 3) AS leaf, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1)
SELECT (SELECT count(*) FROM c) AS committed, (SELECT count(*) FROM r) AS revealed, count(*) FILTER (finding <> 'not-revealed') AS wrong, count(*) FILTER (finding <> 'not-revealed') = 0 AS valid, count(finding) = 0 AS full, (SELECT sha256(string_agg(h, '' ORDER BY leaf)) FROM l) AS commitment FROM f""")
def challenge_verification(spark, sf_dir):
    """The verdict on that reveal."""
    return release.challenge_verification(*_revealed(spark, sf_dir))


def _release(spark, sf_dir):
    """Nations as claims of their regions' profiles; suppliers as blockers of nations' regions; customers' files as evidence."""
    n, s, c = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    k = F.col("n_nationkey")
    required = n.select(F.col("n_regionkey").alias("profile"), F.when(k % 11 == 7, "X").otherwise(F.col("n_name")).alias("claim_id"), F.concat(F.lit("E"), (F.col("n_regionkey") % 3).cast("string")).alias("least_level"))
    claims = n.select(F.col("n_name").alias("claim_id"), F.when(k % 9 != 5, F.concat(F.lit("E"), (k % 7).cast("string"))).alias("level"), F.when(k % 5 == 1, "planned").when(k % 8 != 6, "done").alias("status"))
    files = c.select((F.col("c_custkey") % 40).alias("of"), F.col("c_name").alias("path"))
    evidence = files.where("of < 25").join(n, F.col("of") == k).select(F.col("n_name").alias("subject"), "path").union(files.where("of >= 25").select(F.concat(F.lit("B"), F.col("of").cast("string")), "path"))
    artifacts = c.where("c_custkey % 373 <> 9").select(F.col("c_name").alias("path"))
    blockers = s.where("s_suppkey < 60").select(F.concat(F.lit("B"), F.col("s_suppkey").cast("string")).alias("blocker_id"), F.when(F.col("s_suppkey") % 4 == 0, "closed").when(F.col("s_suppkey") % 4 == 1, "partial").when(F.col("s_suppkey") % 4 == 2, "accepted").alias("status"), F.when(F.col("s_suppkey") % 6 != 2, F.array(F.col("s_suppkey") % 5)).otherwise(F.array().cast("array<long>")).alias("profiles"))
    criteria = s.where("s_suppkey < 60").select(F.concat(F.lit("B"), F.col("s_suppkey").cast("string")).alias("blocker_id"), F.concat(F.lit("K"), F.col("s_suppkey").cast("string")).alias("criterion_id"), F.when(F.col("s_suppkey") % 7 != 3, "complete").alias("status"))
    return required, claims, blockers, criteria, evidence, artifacts


_RELEASE = """files AS (SELECT c_custkey % 40 AS o, c_custkey % 373 = 9 AS lost FROM customer), lostn AS (SELECT o, count(*) FILTER (lost) AS m FROM files GROUP BY 1),
cl AS (SELECT n_regionkey AS profile, CASE WHEN n_nationkey % 11 = 7 THEN 'X' ELSE n_name END AS claim_id, n_nationkey AS k, n_regionkey % 3 AS least, CASE WHEN n_nationkey % 9 = 5 THEN 0 ELSE n_nationkey % 7 END AS lv, CASE WHEN n_nationkey % 5 = 1 OR n_nationkey % 8 = 6 THEN 'planned' ELSE 'done' END AS st, coalesce(m, 0) AS m FROM nation LEFT JOIN lostn ON o = n_nationkey),
cr AS (SELECT profile, claim_id, CASE WHEN claim_id = 'X' THEN 0 ELSE m END AS missing_evidence, CASE WHEN claim_id = 'X' OR lv > 5 THEN 'E0' ELSE 'E' || lv END AS level, CASE WHEN claim_id = 'X' THEN 'unknown-claim' WHEN lv > 5 THEN 'unknown-level' END AS error, claim_id <> 'X' AND lv <= 5 AND lv >= least AND m = 0 AND st = 'done' AS satisfied FROM cl),
br AS (SELECT CASE WHEN s_suppkey % 6 <> 2 THEN s_suppkey % 5 END AS profile, 'B' || s_suppkey AS blocker_id, CASE WHEN s_suppkey % 7 = 3 THEN 1 ELSE 0 END AS open_criteria, CASE WHEN s_suppkey >= 25 THEN coalesce(m, 0) ELSE 0 END AS missing_evidence, s_suppkey % 4 IN (1, 3) OR s_suppkey % 7 = 3 AS blocks FROM supplier LEFT JOIN lostn ON o = s_suppkey WHERE s_suppkey < 60)"""


@query(f"WITH {_RELEASE} SELECT profile, claim_id, missing_evidence::BIGINT AS missing_evidence, level, error, satisfied FROM cr")
def release_claims(spark, sf_dir):
    """Claims that profiles require."""
    required, claims, _, _, evidence, artifacts = _release(spark, sf_dir)
    return release.claim_results(required, claims, evidence, artifacts)


@query(f"WITH {_RELEASE} SELECT profile::BIGINT AS profile, blocker_id, open_criteria::BIGINT AS open_criteria, missing_evidence::BIGINT AS missing_evidence, blocks FROM br")
def release_blockers(spark, sf_dir):
    """Blockers of profiles."""
    _, _, blockers, criteria, evidence, artifacts = _release(spark, sf_dir)
    return release.blocker_results(blockers, criteria, evidence, artifacts)


@query(f"""WITH {_RELEASE}, c AS (SELECT profile::BIGINT AS profile, count(*) AS claims, count(*) FILTER (satisfied) AS satisfied, count(error) AS errors FROM cr GROUP BY 1), b AS (SELECT profile, count(*) FILTER (blocks) AS blocking FROM br WHERE profile IS NOT NULL GROUP BY 1), l AS (SELECT count(DISTINCT blocker_id) FILTER (missing_evidence > 0) AS lacking FROM br)
SELECT profile, claims, satisfied, errors, coalesce(blocking, 0) AS blocking, lacking, satisfied = claims AND errors = 0 AND coalesce(blocking, 0) = 0 AND lacking = 0 AS ready FROM c LEFT JOIN b USING (profile), l""")
def release_readiness(spark, sf_dir):
    """Whether profiles are ready."""
    required, claims, blockers, criteria, evidence, artifacts = _release(spark, sf_dir)
    return release.readiness(release.claim_results(required, claims, evidence, artifacts).withColumn("profile", F.col("profile").cast("long")), release.blocker_results(blockers, criteria, evidence, artifacts))


# scorer challenges, renders

_TWINS = f"""b AS (SELECT l_orderkey, l_orderkey || '-' || l_linenumber AS artifact_id, bool_or(valid) AS valid FROM ({records.ORACLES['scorecards']}) GROUP BY l_orderkey, l_linenumber), r AS (SELECT unnest(['labels-stripped', 'labels-renamed', 'comment-added', 'unseen-label-added', 'far-label-added']) AS challenge_id, unnest([true, true, true, false, false]) AS whole),
t AS (SELECT b.*, challenge_id, whole, l_orderkey % 13 = 4 AS redrawn, l_orderkey % 17 = 5 AND challenge_id <> 'comment-added' AS seen, l_orderkey % 19 = 6 AS rewritten, l_orderkey % 23 = 7 AND challenge_id = 'far-label-added' AS lost FROM b, r),
f AS (SELECT artifact_id, challenge_id, list_filter([CASE WHEN NOT valid THEN 'baseline-not-valid' END, CASE WHEN lost THEN 'not-scored' END, CASE WHEN NOT lost AND redrawn THEN 'render-changed' END, CASE WHEN NOT lost AND seen THEN 'semantic-dimensions-changed' END, CASE WHEN NOT lost AND whole AND (seen OR rewritten) THEN 'score-changed' END, CASE WHEN NOT lost AND (seen OR rewritten) THEN 'aggregate-improved' END], lambda x: x IS NOT NULL) AS failures FROM t)"""


@query(f"WITH {_TWINS}, c AS (SELECT challenge_id, count(*) AS artifacts, count(*) FILTER (len(failures) = 0) AS passed FROM f GROUP BY 1), n AS (SELECT challenge_id, x, count(*) AS n FROM (SELECT challenge_id, unnest(failures) AS x FROM f) GROUP BY ALL) SELECT c.*, (SELECT string_agg(x || '=' || n, ',' ORDER BY x) FROM n WHERE n.challenge_id = c.challenge_id) AS failures FROM c")
def scorer_challenges(spark, sf_dir):
    """Scorecards of order lines and of their changed twins, some of which were drawn anew, scored better or lost."""
    cards = records.scorecards(spark, sf_dir).withColumn("artifact_id", F.concat_ws("-", "l_orderkey", "l_linenumber")).repartition("artifact_id")  # the one shuffle of artifacts
    lines = cards.groupBy("artifact_id", "l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in (*scorecard.WEIGHTS, "aggregate")], F.bool_or("valid").alias("valid"))
    base = lines.withColumn("render_hash", F.concat(F.lit("h"), F.col("artifact_id")))
    rules = spark.createDataFrame([(r.challenge_id,) for r in metamorphic.RULES], "challenge_id string")
    k, c = F.col("l_orderkey"), F.col("challenge_id")
    seen, rewritten = (k % 17 == 5) & (c != "comment-added"), k % 19 == 6
    up = lambda name, when, by: F.when(when, F.col(name) + by).otherwise(F.col(name))
    twins = base.join(F.broadcast(rules)).where(~((k % 23 == 7) & (c == "far-label-added")))  # five rules
    twins = twins.withColumn("render_hash", F.when(k % 13 == 4, "other").otherwise(F.col("render_hash"))).withColumn("interaction", up("interaction", seen, 0.5)).withColumn("vector_quality", up("vector_quality", rewritten, 0.5)).withColumn("aggregate", up("aggregate", seen | rewritten, 0.1))
    report = metamorphic.challenge_report(metamorphic.challenge_outcomes(base, twins))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("failures")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return report.select("challenge_id", "artifacts", "passed", listed.alias("failures"))


def _rasters(spark, sf_dir):
    """Texts as images: their hexadecimal digits as channels, 24 pixels wide."""
    digits = F.hex(F.coalesce("text", F.lit("")))
    whole = F.rpad(digits, (F.ceil(F.length(digits) / 72) * 72).cast("int"), F.lit("0"))
    return table(spark, sf_dir, "documents").select("doc_id", whole.cast("binary").alias("before"), F.translate(whole, "67", "~~").cast("binary").alias("after"))


@query()
def raster_repairs(spark, sf_dir):
    """Texts as renders, before and after some digits are changed."""
    pixels = _rasters(spark, sf_dir)
    r, c = rasters.repair_render(F.col("before"), F.col("after"), F.lit(24)), rasters.renders_compared(F.col("before"), F.col("after"), F.lit(24), 3)
    return pixels.select("doc_id", r.alias("r"), c.alias("c")).select("doc_id", "r.*", F.col("c.mean_absolute_error"), F.col("c.differing_pixel_fraction"), F.col("c.maximum_channel_error"))


@query()
def raster_figures(spark, sf_dir):
    """Figures of texts as images."""
    return _rasters(spark, sf_dir).select("doc_id", raster_statistics(F.col("before"), F.lit(24)).alias("s")).select("doc_id", "s.*")


# provenance, freezes, integrations


def _runs(spark, sf_dir):
    """Customers as runs, orders as trials, line items as evaluations."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    runs = table(spark, sf_dir, "customer").select(text("R", "c_custkey").alias("run_id"), text("M", "c_nationkey").alias("model_id"), F.lit("r1").alias("model_revision"), F.lit("2026-01-01").alias("created_at"), F.col("c_mktsegment").alias("release"))
    artifact = F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("sha256:"), F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256)))
    trials = table(spark, sf_dir, "orders").select(text("T", "o_orderkey").alias("trial_id"), text("R", "o_custkey").alias("run_id"), F.col("o_orderpriority").alias("task_id"), F.col("o_orderkey").alias("seed"), F.col("o_orderstatus").alias("status"), artifact.alias("artifact_id"), day("o_orderdate").alias("day"))
    scored = trials.where(F.col("seed") % 3 == 0).select(F.concat(F.lit("E"), F.col("seed").cast("string")).alias("evaluation_id"), "trial_id", F.concat(F.lit("sha256:"), F.sha2(F.col("seed").cast("string").cast("binary"), 256)).alias("artifact_id"), F.lit("s1").alias("scorer"))
    return runs, trials, scored


_PROV = """n AS (SELECT 'urn:run:R' || c_custkey AS id, '{"@id":"urn:run:R' || c_custkey || '","@type":"prov:Activity","prov:startedAtTime":"2026-01-01","prov:wasAssociatedWith":[{"@id":"urn:run:model/M' || c_nationkey || '@r1"},{"@id":"urn:run:software"}],"release":"' || c_mktsegment || '"}' AS node FROM customer
UNION ALL SELECT DISTINCT 'urn:run:model/M' || c_nationkey || '@r1', '{"@id":"urn:run:model/M' || c_nationkey || '@r1","@type":"prov:Agent"}' FROM customer UNION ALL SELECT 'urn:run:software', '{"@id":"urn:run:software","@type":"prov:SoftwareAgent"}'
UNION ALL SELECT 'urn:run:T' || o_orderkey, '{"@id":"urn:run:T' || o_orderkey || '","@type":"prov:Activity","prov:wasInformedBy":{"@id":"urn:run:R' || o_custkey || '"},"prov:used":{"@id":"urn:run:task/' || o_orderpriority || '"},"seed":' || o_orderkey || ',"status":"' || o_orderstatus || '"}' FROM orders
UNION ALL SELECT DISTINCT 'urn:run:task/' || o_orderpriority, '{"@id":"urn:run:task/' || o_orderpriority || '","@type":"prov:Entity"}' FROM orders
UNION ALL SELECT 'urn:run:artifact/' || sha256(o_orderkey::VARCHAR), '{"@id":"urn:run:artifact/' || sha256(o_orderkey::VARCHAR) || '","@type":"prov:Entity","prov:wasGeneratedBy":{"@id":"urn:run:T' || o_orderkey || '"}}' FROM orders WHERE o_orderkey % 7 <> 0
UNION ALL SELECT 'urn:run:E' || o_orderkey, '{"@id":"urn:run:E' || o_orderkey || '","@type":"prov:Activity","prov:used":[{"@id":"urn:run:artifact/' || sha256(o_orderkey::VARCHAR) || '"},{"@id":"urn:run:scorer/s1"}],"prov:wasInformedBy":{"@id":"urn:run:T' || o_orderkey || '"}}' FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT 'urn:run:scorer/s1', '{"@id":"urn:run:scorer/s1","@type":"prov:Agent"}')"""


@query(f"WITH {_PROV} SELECT id, node FROM n")
def prov_graph(spark, sf_dir):
    """The provenance of all runs."""
    return provenance.prov_graph(*_runs(spark, sf_dir))


@query("SELECT 'urn:run:E' || o_orderkey AS id, 'urn:run:artifact/' || sha256(o_orderkey::VARCHAR) AS refers_to FROM orders WHERE o_orderkey % 21 = 0")
def prov_dangling(spark, sf_dir):
    """Evaluations of artifacts that no trial made."""
    return provenance.dangling(provenance.prov_graph(*_runs(spark, sf_dir)))


def _files(spark, sf_dir):
    k = F.col("doc_id")
    listed = table(spark, sf_dir, "documents").select(F.concat(F.lit("docs/"), k.cast("string")).alias("path"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"), "doc_id")
    there = listed.where(k % 31 != 4).withColumn("sha256", F.when(k % 37 == 5, "0").otherwise(F.col("sha256"))).withColumn("bytes", F.when(k % 41 == 6, 0).otherwise(F.col("bytes")))
    return listed.drop("doc_id"), there.drop("doc_id")


@query("""WITH f AS (SELECT 'docs/' || doc_id AS path, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, '')) AS bytes FROM documents), h AS (SELECT sha256('=' || path || chr(31) || '=' || sha256 || chr(31) || '=' || bytes) AS h FROM f),
l AS (SELECT substr(h, 1, 3) AS leaf, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1), s AS (SELECT count(*) AS files, sum(bytes)::BIGINT AS bytes, (SELECT sha256(string_agg(h, '' ORDER BY leaf)) FROM l) AS listed FROM f)
SELECT 'S1' AS study_id, 'data-freeze' AS kind, 'sha256:t' AS task_commitment, 'head' AS ledger_head, files, bytes, sha256(concat_ws(chr(31), 'S1', 'data-freeze', 'sha256:t', 'head', files, bytes, listed)) AS freeze_commitment FROM s""")
def study_freeze(spark, sf_dir):
    """All documents as the files of a data freeze."""
    return provenance.study_freeze(_files(spark, sf_dir)[0], "S1", "data-freeze", "sha256:t", "head")


@query("SELECT 'docs/' || doc_id AS path, CASE WHEN doc_id % 31 = 4 THEN 'missing' WHEN doc_id % 41 = 6 THEN 'other-size' ELSE 'other-content' END AS finding FROM documents WHERE doc_id % 31 = 4 OR doc_id % 37 = 5 OR doc_id % 41 = 6 AND strlen(coalesce(text, '')) > 0")
def freeze_findings(spark, sf_dir):
    """The frozen files against a tree in which some are missing or changed."""
    return provenance.freeze_findings(*_files(spark, sf_dir))


@query("""WITH a AS (SELECT s_name, CASE s_suppkey % 5 WHEN 1 THEN 'blocked' WHEN 2 THEN 'planned' ELSE 'active' END AS status, ['docs/' || s_suppkey, 'docs/' || s_suppkey * 7] AS evidence FROM supplier)
SELECT s_name AS subject, 'error' AS severity, 'missing-integration-evidence' AS finding, e AS path FROM (SELECT s_name, unnest(evidence) AS e FROM a) WHERE e NOT IN (SELECT 'docs/' || doc_id FROM documents WHERE doc_id % 31 <> 4)
UNION ALL SELECT s_name, 'warning', 'blocked-external-surface', NULL FROM a WHERE status = 'blocked' UNION ALL SELECT s_name, 'info', 'planned-integration', NULL FROM a WHERE status = 'planned' UNION ALL SELECT 'run-' || n_nationkey, 'info', 'optional-command-unavailable', NULL FROM nation WHERE n_nationkey % 3 <> 0 AND n_nationkey IN (SELECT s_nationkey FROM supplier)""")
def integration_findings(spark, sf_dir):
    """Suppliers as integrations whose evidence are documents."""
    k, doc = F.col("s_suppkey"), lambda c: F.concat(F.lit("docs/"), c.cast("string"))
    assets = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("asset_id"), F.when(k % 5 == 1, "blocked").when(k % 5 == 2, "planned").otherwise("active").alias("status"), F.array(doc(k), doc(k * 7)).alias("evidence"), F.array(F.concat(F.lit("run-"), F.col("s_nationkey").cast("string"))).alias("command_names"))
    commands = table(spark, sf_dir, "nation").select(F.concat(F.lit("run-"), F.col("n_nationkey").cast("string")).alias("command"), (F.col("n_nationkey") % 3 == 0).alias("available"))
    return provenance.integration_findings(assets, _files(spark, sf_dir)[1].select("path"), commands)


@query(f"""WITH s AS (SELECT artifact_id FROM ({records.ORACLES['calibration_sample']})), f AS (SELECT c_mktsegment AS task_id, c_nationkey::VARCHAR AS model_id, min(c_custkey::VARCHAR) AS artifact_id FROM customer WHERE c_custkey::VARCHAR IN (SELECT artifact_id FROM s) GROUP BY 1, 2),
p AS (SELECT a.task_id, a.artifact_id AS a1, b.artifact_id AS a2, a.model_id AS m1, b.model_id AS m2, ('0x' || substr(sha256('9|' || a.task_id || '|' || a.model_id || '|' || b.model_id), 1, 12))::BIGINT AS h FROM f a JOIN f b ON a.task_id = b.task_id AND a.model_id < b.model_id),
k AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY h, m1, m2) AS n FROM p), d AS (SELECT task_id, CASE WHEN h % 2 = 1 THEN a2 ELSE a1 END AS left_id, CASE WHEN h % 2 = 1 THEN a1 ELSE a2 END AS right_id FROM k WHERE n <= 6)
SELECT task_id, left_id, right_id, criterion, 'PAIR-' || substr(sha256(task_id || chr(31) || left_id || chr(31) || right_id || chr(31) || criterion || chr(31) || '9'), 1, 20) AS pair_id FROM d, (SELECT unnest(['anatomy', 'overall']) AS criterion)""")
def calibration_design(spark, sf_dir):
    """Pairs of the artifacts that a balanced sample selects, market segments as tasks."""
    candidates = records._candidates(spark, sf_dir).withColumn("task_id", F.col("stratum"))
    return planning.calibration_design(candidates, 200, 9, ["anatomy", "overall"], 6)[1]
