"""Queries of the planning, ledger, audit, qualification, concept and scoring operators, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window


from brightloom.functions import contracts, mutations, vector_source
from brightloom.operators import annotate, calibration, concepts, integrity, ledger, planning, qualification, ratings, scorecard, series, sessions, tasks
from brightloom.plans.base import registry, rounded
from brightloom.session import table

QUERIES, ORACLES, query = registry()


def _hash_sql(*parts: str) -> str:
    return "('0x' || substr(sha256(" + " || '|' || ".join(parts) + "), 1, 12))::BIGINT"


def _cells(spark, sf_dir):
    """Nations as tasks, suppliers as models, three replicates."""
    tasks = table(spark, sf_dir, "nation").select(F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("task_id"))
    models = table(spark, sf_dir, "supplier").select(F.concat(F.lit("M"), F.col("s_suppkey").cast("string")).alias("model_id"))
    return planning.factorial_cells(tasks, models, 3, "main", 11)


_CELLS = """cells AS (SELECT task_id, model_id, replicate, 'main' AS stage_id, seed, 'PCELL-' || substr(sha256('main' || chr(31) || model_id || chr(31) || task_id || chr(31) || replicate || chr(31) || seed), 1, 24) AS cell_id
  FROM (SELECT *, (('0x' || substr(sha256('11' || chr(31) || 'main' || chr(31) || model_id || chr(31) || task_id || chr(31) || replicate), 1, 16))::UBIGINT % 2147483647)::BIGINT AS seed
    FROM (SELECT 'T' || n_nationkey AS task_id FROM nation), (SELECT 'M' || s_suppkey AS model_id FROM supplier), (SELECT unnest(range(1, 4)) AS replicate)))"""


@query(f"WITH {_CELLS} SELECT task_id, model_id, replicate::INT AS replicate, stage_id, seed, cell_id FROM cells")
def factorial_cells(spark, sf_dir):
    """All cells of the design."""
    return _cells(spark, sf_dir)


def _campaign(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").withColumn("model_id", F.concat(F.lit("M"), F.col("s_suppkey").cast("string")))
    qualified = suppliers.select("model_id", (F.col("s_suppkey") % 5 != 0).alias("qualified"))
    prices = suppliers.where("s_suppkey % 7 <> 0").select("model_id", (F.col("s_suppkey") % 13 + 0.5).cast("double").alias("input_per_million"), (F.col("s_suppkey") % 17 + 0.25).cast("double").alias("output_per_million"), F.lit(0.001).alias("request_fee"))
    return planning.campaign_cells(_cells(spark, sf_dir), qualified, prices)


_CAMPAIGN = f"""{_CELLS}, camp AS (SELECT cells.*, CASE WHEN s_suppkey % 5 = 0 THEN 'blocked-qualification' WHEN s_suppkey % 7 = 0 THEN 'blocked-price' ELSE 'ready' END AS state,
  CASE WHEN s_suppkey % 7 <> 0 THEN 0.001::DOUBLE + 300::DOUBLE * (s_suppkey % 13 + 0.5)::DOUBLE / 1e6 + 8000::DOUBLE * (s_suppkey % 17 + 0.25)::DOUBLE / 1e6 END AS estimated_cost FROM cells JOIN supplier ON model_id = 'M' || s_suppkey)"""


@query(f"WITH {_CAMPAIGN} SELECT cell_id, state, round(estimated_cost, 8) AS estimated_cost FROM camp")
def campaign_cells(spark, sf_dir):
    """States and costs of cells."""
    return rounded(_campaign(spark, sf_dir).select("cell_id", "state", "estimated_cost"), 8)


@query(f"""WITH {_CAMPAIGN}, o AS (SELECT *, row_number() OVER (PARTITION BY stage_id, model_id ORDER BY task_id, replicate) - 1 AS n FROM camp WHERE state = 'ready')
SELECT stage_id, model_id, (n // 24)::BIGINT AS shard, count(*) AS cells, round(sum(estimated_cost), 6) AS estimated_cost, sha256(string_agg(cell_id, ',' ORDER BY n)) AS cells_sha256 FROM o GROUP BY 1, 2, 3""")
def campaign_shards(spark, sf_dir):
    """Shards of ready cells."""
    return rounded(planning.campaign_shards(_campaign(spark, sf_dir)))


@query(f"""WITH {_CAMPAIGN}, t AS (SELECT sum(estimated_cost) AS c, count(*) FILTER (state = 'ready' AND estimated_cost IS NULL) AS u, count(*) AS n FROM camp)
SELECT round(c, 4) AS estimated_cost, u AS unknown_cost_cells, n AS cells, round(c * 1.15, 4) AS with_reserve, CASE WHEN u > 0 THEN 'blocked-unknown-prices' WHEN c * 1.15 > 500 THEN 'blocked-budget-exceeded' ELSE 'pass' END AS gate FROM t""")
def budget_gate(spark, sf_dir):
    """The budget gate of the campaign."""
    return rounded(planning.budget_gate(_campaign(spark, sf_dir), hard_budget=500.0), 4)


@query(f"WITH {_CAMPAIGN} SELECT cell_id, stage_id, model_id, task_id, replicate::INT AS replicate FROM camp WHERE state = 'ready' ORDER BY stage_id, model_id, task_id, replicate LIMIT 20")
def next_ready(spark, sf_dir):
    """The next twenty cells (a scheduling report)."""
    return planning.next_ready(_campaign(spark, sf_dir), 20).select("cell_id", "stage_id", "model_id", "task_id", "replicate")


@query(f"""WITH RECURSIVE {_CAMPAIGN}, c AS (SELECT *, row_number() OVER (ORDER BY stage_id, model_id, task_id, replicate) AS pos FROM camp WHERE state = 'ready' AND estimated_cost IS NOT NULL),
h AS (SELECT 'M' || s_suppkey AS m, unnest(range(0, CASE WHEN s_suppkey % 3 = 0 THEN 4 ELSE 1 END)) AS k FROM supplier WHERE s_suppkey < 8),
st AS (SELECT 0 AS n, 0::BIGINT AS pos, (SELECT list(m) FROM h) AS models, (SELECT count(*) * 0.01::DOUBLE FROM h) AS reserved, NULL::STRUCT(pos BIGINT, model_id VARCHAR, cell_id VARCHAR, cost DOUBLE) AS b
  UNION ALL SELECT n + 1, b.pos, list_append(models, b.model_id), reserved + b.cost, b FROM (
    SELECT n, models, reserved, arg_min({{'pos': c.pos, 'model_id': c.model_id, 'cell_id': c.cell_id, 'cost': c.estimated_cost}}, c.pos) AS b
    FROM st JOIN c ON c.pos > st.pos AND 0.5 + st.reserved + c.estimated_cost <= 2.5 AND len(list_filter(st.models, lambda m: m = c.model_id)) < 4 WHERE st.n < 40 GROUP BY n, models, reserved))
SELECT b.cell_id AS cell_id, b.model_id AS model_id, round(b.cost, 6) AS estimated_cost, round(reserved, 6) AS reserved_cost FROM st WHERE n > 0""")
def lease_cells(spark, sf_dir):
    """Forty leases at most, four a model, within a budget of which some is spent and some held."""
    held = table(spark, sf_dir, "supplier").where("s_suppkey < 8").select(
        F.concat(F.lit("M"), F.col("s_suppkey").cast("string")).alias("model_id"), F.lit(0.01).alias("estimated_cost"), F.explode(F.sequence(F.lit(1), F.when(F.col("s_suppkey") % 3 == 0, 4).otherwise(1))).alias("k")
    )
    return rounded(ledger.lease(_campaign(spark, sf_dir), 40, 4, 2.5, held, 0.5))


_RUNS = """ev AS (SELECT 'c' AS campaign_id, user_id::VARCHAR AS cell_id, CASE WHEN event_id % 41 <> 0 THEN 't' || event_id END AS lease_token, 1 AS attempt, CASE WHEN event_id % 13 <> 0 THEN 'w' || user_id % 7 END AS worker_id,
  CASE event_type WHEN 'click' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'leased' ELSE 'quarantined' END AS new_state, event_type AS reason, 'a' || event_id AS artifact_id, value AS actual_cost, event_id FROM events)"""


@query(f"""WITH {_RUNS}, e AS (SELECT * FROM ev WHERE new_state <> 'leased' AND worker_id IS NOT NULL),
r AS (SELECT cell_id, lease_token, attempt, campaign_id, CASE WHEN event_id % 17 = 0 THEN 'other' ELSE worker_id END AS worker_id, new_state AS terminal_state, reason AS terminal_reason, CASE WHEN event_id % 19 = 0 THEN NULL ELSE artifact_id END AS artifact_id,
  CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN actual_cost + 1 ELSE actual_cost END AS charged_cost FROM ev WHERE new_state <> 'leased' AND event_id % 31 <> 0 AND lease_token IS NOT NULL),
b AS (SELECT coalesce(e.cell_id, r.cell_id) AS cell_id, coalesce(e.lease_token, r.lease_token) AS lease_token, coalesce(e.attempt, r.attempt) AS attempt, e.cell_id IS NOT NULL AS he, r.cell_id IS NOT NULL AS hr,
  e.worker_id IS DISTINCT FROM r.worker_id AS dw, e.artifact_id IS DISTINCT FROM r.artifact_id AS da, r.charged_cost, e.actual_cost FROM (SELECT * FROM e WHERE lease_token IS NOT NULL) e FULL JOIN r USING (cell_id, lease_token, attempt))
SELECT cell_id, lease_token, attempt, unnest(list_filter([CASE WHEN NOT he THEN 'record-without-event' END, CASE WHEN NOT hr THEN 'event-without-record' END, CASE WHEN he AND hr AND dw THEN 'field-mismatch:worker_id' END,
  CASE WHEN he AND hr AND da THEN 'field-mismatch:artifact_id' END, CASE WHEN he AND hr THEN CASE WHEN charged_cost IS NULL THEN 'invalid-cost' WHEN abs(charged_cost - actual_cost) > 1e-8 THEN 'cost-mismatch' END END], lambda x: x IS NOT NULL)) AS finding FROM b
UNION ALL SELECT cell_id, lease_token, attempt, 'event-without-token' FROM e WHERE lease_token IS NULL""")
def execution_findings(spark, sf_dir):
    """Execution records, some of them damaged, against terminal events."""
    e, t = F.col("event_id"), F.col("event_type")
    state = F.when(t == "click", "succeeded").when(t == "error", "failed").when(t == "view", "leased").otherwise("quarantined")
    events = table(spark, sf_dir, "events").select(
        F.lit("c").alias("campaign_id"), F.col("user_id").cast("string").alias("cell_id"), F.when(e % 41 != 0, F.concat(F.lit("t"), e.cast("string"))).alias("lease_token"), F.lit(1).alias("attempt"),
        F.when(e % 13 != 0, F.concat(F.lit("w"), (F.col("user_id") % 7).cast("string"))).alias("worker_id"), state.alias("new_state"), t.alias("reason"), F.concat(F.lit("a"), e.cast("string")).alias("artifact_id"), F.col("value").alias("actual_cost"), "event_id",
    )
    cost = F.when(e % 23 == 0, F.lit(None)).when(e % 29 == 0, F.col("actual_cost") + 1).otherwise(F.col("actual_cost"))
    records = events.where((F.col("new_state") != "leased") & (e % 31 != 0) & F.col("lease_token").isNotNull()).select(
        "cell_id", "lease_token", "attempt", "campaign_id", F.when(e % 17 == 0, "other").otherwise(F.col("worker_id")).alias("worker_id"), F.col("new_state").alias("terminal_state"), F.col("reason").alias("terminal_reason"),
        F.when(e % 19 != 0, F.col("artifact_id")).alias("artifact_id"), cost.alias("charged_cost"),
    )
    return ledger.reconcile_executions(events, records)


def _candidates(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("artifact_id"), F.col("c_mktsegment").alias("stratum"), F.col("c_nationkey").cast("string").alias("model_id"),
        ((F.col("c_custkey") % 101) / 100.0).alias("score"), ((F.col("c_custkey") % 37) / 100.0).alias("disagreement"), (F.col("c_custkey") % 11 != 0).alias("valid"),
    )


@query(f"""WITH c AS (SELECT c_custkey::VARCHAR AS artifact_id, c_mktsegment || '|' || c_nationkey || '|' || CASE WHEN c_custkey % 11 = 0 THEN 'invalid' WHEN (c_custkey % 101) / 100.0 < 0.4 THEN 'low' WHEN (c_custkey % 101) / 100.0 <= 0.7 THEN 'boundary' ELSE 'high' END
  || '|' || CASE WHEN (c_custkey % 37) / 100.0 >= 0.2 THEN 'high' ELSE 'low' END AS sampling_cell FROM customer),
h AS (SELECT *, {_hash_sql("'9'", "artifact_id")} AS h, {_hash_sql("'9'", "'cell'", "sampling_cell")} AS k FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY sampling_cell ORDER BY h, artifact_id) AS round FROM h)
SELECT artifact_id, sampling_cell, round::INT AS round FROM r ORDER BY round, k, sampling_cell LIMIT 200""")
def calibration_sample(spark, sf_dir):
    """A balanced sample of 200 (a sampling operator)."""
    return planning.calibration_sample(_candidates(spark, sf_dir), 200, 9)


@query(f"""WITH f AS (SELECT o_orderpriority AS task_id, o_orderstatus AS model_id, min(o_orderkey::VARCHAR) AS artifact_id FROM orders GROUP BY 1, 2),
p AS (SELECT a.task_id, a.artifact_id AS a1, b.artifact_id AS a2, a.model_id AS m1, b.model_id AS m2, {_hash_sql("'4'", "a.task_id", "a.model_id", "b.model_id")} AS h FROM f a JOIN f b ON a.task_id = b.task_id AND a.model_id < b.model_id),
k AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY h, m1, m2) AS n FROM p),
s AS (SELECT task_id, CASE WHEN h % 2 = 1 THEN a2 ELSE a1 END AS left_id, CASE WHEN h % 2 = 1 THEN a1 ELSE a2 END AS right_id FROM k WHERE n <= 2)
SELECT task_id, left_id, right_id, criterion, 'PAIR-' || substr(sha256(task_id || chr(31) || left_id || chr(31) || right_id || chr(31) || criterion || chr(31) || '4'), 1, 20) AS pair_id FROM s, (SELECT unnest(['anatomy', 'overall']) AS criterion)""")
def pairwise_tasks(spark, sf_dir):
    """Pairs of models within tasks."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("task_id"), F.col("o_orderstatus").alias("model_id"), F.col("o_orderkey").cast("string").alias("artifact_id"))
    return planning.pairwise_tasks(rows, ["anatomy", "overall"], 2, 4)


@query(f"""WITH t AS (SELECT p_partkey::VARCHAR AS task_id, p_size = 1 AS is_heritage FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY is_heritage ORDER BY {_hash_sql("'8'", "task_id")}, task_id) AS n, count(*) OVER (PARTITION BY is_heritage) AS k FROM t)
SELECT task_id, is_heritage, NOT is_heritage AND n <= round(k * 0.3) AS sealed FROM r""")
def sealed_split(spark, sf_dir):
    """Public and sealed tasks."""
    return planning.split_sealed(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("task_id"), (F.col("p_size") == 1).alias("is_heritage")), 0.3, 8)


@query("SELECT sha256(string_agg(x, chr(10) ORDER BY x)) AS commitment, count(*) AS tasks FROM (SELECT p_partkey::VARCHAR || chr(31) || p_name AS x FROM part)")
def set_commitment(spark, sf_dir):
    """Commitment to a set of tasks."""
    return planning.set_commitment(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("k"), "p_name"), ["k", "p_name"])


@query("""SELECT task_id, model_id, seed, 'QCELL-' || substr(sha256(model_id || chr(31) || task_id || chr(31) || seed), 1, 20) AS cell_id FROM (
SELECT n_name AS task_id, r_name AS model_id, (100 + (dense_rank() OVER (ORDER BY r_name) - 1) * 10000 + dense_rank() OVER (ORDER BY n_name) - 1)::INT AS seed FROM nation, region)""")
def qualification_plan(spark, sf_dir):
    """A qualification plan over nations and regions."""
    return planning.qualification_plan(table(spark, sf_dir, "nation").select(F.col("n_name").alias("task_id")), table(spark, sf_dir, "region").select(F.col("r_name").alias("model_id")), 100)


@query("""WITH t AS (SELECT l_returnflag AS model_id, l_partkey AS task_id, count(s) AS n, avg(s) AS m, stddev_pop(s) AS sd, count(DISTINCT s) AS v, count(*) AS planned
  FROM (SELECT *, CASE WHEN l_quantity > 3 THEN l_discount END AS s FROM lineitem) GROUP BY 1, 2)
SELECT model_id, sum(planned)::BIGINT AS planned, sum(n)::BIGINT AS scored, sum(n) / sum(planned) >= 0.8 AS eligible, count(*) FILTER (n = 3) AS complete_tasks, round(avg(m) FILTER (n = 3), 6) AS complete_mean, round(avg(sd) FILTER (n = 3), 6) AS mean_spread,
round(avg((v = 1)::INT) FILTER (n = 3), 6) AS exact_agreement FROM t GROUP BY 1""")
def merged_replicates(spark, sf_dir):
    """Replicates merged by model."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model_id"), F.col("l_partkey").alias("task_id"), F.col("l_linenumber").alias("replicate"), F.when(F.col("l_quantity") > 3, F.col("l_discount")).alias("score"))
    return rounded(planning.merge_replicates(rows, 3))


def _ledger(spark, sf_dir):
    """Events as a ledger: each links to the one before, but for one in 97."""
    state = F.when(F.col("event_type") == "view", "leased").when(F.col("event_type") == "click", "succeeded").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "ready").otherwise("quarantined")
    digest = lambda n: F.sha2(F.concat(F.lit("e"), n.cast("string")).cast("binary"), 256)
    previous = F.when(F.col("event_id") == F.lit(0), F.lit(ledger.GENESIS)).when(F.col("event_id") % 97 == 0, F.lit("x")).otherwise(digest(F.col("event_id") - 1))
    return table(spark, sf_dir, "events").where("event_id % 211 <> 5").select(
        F.col("event_id").alias("sequence"), F.col("user_id").cast("string").alias("cell_id"), state.alias("new_state"), previous.alias("previous_event_hash"), digest(F.col("event_id")).alias("event_hash"), F.col("value").alias("cost")
    )


_LEDGER = """l AS (SELECT event_id AS sequence, user_id::VARCHAR AS cell_id, CASE event_type WHEN 'view' THEN 'leased' WHEN 'click' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'ready' ELSE 'quarantined' END AS new_state, value AS cost FROM events WHERE event_id % 211 <> 5),
r AS (SELECT *, coalesce(lag(new_state) OVER (PARTITION BY cell_id ORDER BY sequence), 'ready') AS previous_state, lag(sequence) OVER (ORDER BY sequence) AS before, min(sequence) OVER () AS first FROM l),
v AS (SELECT *, sequence <> first AND before IS DISTINCT FROM sequence - 1 AS gap,
  CASE WHEN sequence = first THEN sequence <> 0 ELSE before IS DISTINCT FROM sequence - 1 OR (sequence % 97 = 0) END AS broken_link,
  NOT ((previous_state = 'ready' AND new_state IN ('leased', 'cancelled')) OR (previous_state = 'leased' AND new_state IN ('ready', 'succeeded', 'failed', 'quarantined', 'cancelled')) OR (previous_state = 'failed' AND new_state = 'ready')) AS illegal FROM r),
st AS (SELECT cell_id, arg_max(new_state, sequence) AS state, sum(cost) AS cost, count(*) AS events FROM l GROUP BY 1)"""


@query(f"WITH {_LEDGER} SELECT sequence, cell_id, new_state, previous_state, gap, broken_link, illegal FROM v")
def ledger_replay(spark, sf_dir):
    """What is wrong with each event of the ledger."""
    return ledger.replay(_ledger(spark, sf_dir)).select("sequence", "cell_id", "new_state", "previous_state", "gap", "broken_link", "illegal")


@query(f"WITH {_LEDGER} SELECT cell_id, state, round(cost, 4) AS cost, events FROM st")
def ledger_states(spark, sf_dir):
    """Current states."""
    return rounded(ledger.current_states(_ledger(spark, sf_dir)), 4)


@query(f"""WITH {_LEDGER}, c AS (SELECT c_custkey::VARCHAR AS cell_id, 1.5 AS e FROM customer), n AS (SELECT coalesce(state, 'ready') AS state, cost, e FROM c LEFT JOIN st USING (cell_id)),
b AS (SELECT state, count(*) AS n, coalesce(sum(cost), 0) AS spent, sum(e) AS estimated FROM n GROUP BY 1)
SELECT state, n, round(spent, 4) AS spent, round(sum(spent) OVER (), 4) AS total_spent, round(coalesce(sum(estimated) FILTER (state = 'leased') OVER (), 0), 4) AS reserved,
round(1000000 - sum(spent) OVER () - coalesce(sum(estimated) FILTER (state = 'leased') OVER (), 0), 4) AS remaining FROM b""")
def campaign_status(spark, sf_dir):
    """Counts and budget by state."""
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("cell_id"), F.lit(1.5).alias("estimated_cost"))
    return rounded(ledger.campaign_status(cells, _ledger(spark, sf_dir), 1000000.0), 4)


@query(f"""WITH {_LEDGER}, exact AS (SELECT cell_id, sum(cost::DECIMAL(38,12)) AS cost FROM l GROUP BY 1), stored AS (SELECT user_id::VARCHAR AS cell_id, arg_max(CASE event_type WHEN 'view' THEN 'leased' WHEN 'click' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'ready' ELSE 'quarantined' END, event_id) AS state, sum(value::DECIMAL(38,12)) AS cost
  FROM events WHERE user_id % 50 <> 3 GROUP BY 1), replayed AS (SELECT cell_id, state, exact.cost AS cost FROM st JOIN exact USING (cell_id))
SELECT cell_id, stored.state AS stored_state, round(stored.cost::DOUBLE, 4) AS stored_cost, replayed.state AS replayed_state, round(replayed.cost::DOUBLE, 4) AS replayed_cost,
CASE WHEN replayed.state IS NULL THEN 'missing-in-log' WHEN stored.state IS NULL THEN 'missing-in-store' WHEN stored.state <> replayed.state THEN 'state-drift' WHEN round(abs(stored.cost - replayed.cost), 6) > 0.01 THEN 'cost-drift' END AS finding
FROM stored FULL JOIN replayed USING (cell_id) WHERE finding IS NOT NULL""")
def ledger_reconcile(spark, sf_dir):
    """The full log's states against those of the log with gaps; costs that drift by more than a hundredth, to
    the millionth."""
    events = table(spark, sf_dir, "events")
    full = ledger.current_states(_all_events(events)).where("cast(cell_id as bigint) % 50 <> 3")
    return rounded(ledger.reconcile(full, ledger.current_states(_ledger(spark, sf_dir))).where("finding <> 'cost-drift' or round(abs(stored_cost - replayed_cost), 6) > 0.01"), 4)


def _all_events(events):
    state = F.when(F.col("event_type") == "view", "leased").when(F.col("event_type") == "click", "succeeded").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "ready").otherwise("quarantined")
    return events.select(F.col("event_id").alias("sequence"), F.col("user_id").cast("string").alias("cell_id"), state.alias("new_state"), F.col("value").alias("cost"))


@query("SELECT user_id::VARCHAR AS cell_id, event_id AS sequence, 'ready' AS new_state, 'lease-expired' AS reason, ts + INTERVAL 5 MINUTE AS expires_at FROM events WHERE event_type = 'view' AND ts + INTERVAL 5 MINUTE <= TIMESTAMP '2024-01-15 00:00:00'")
def expired_leases(spark, sf_dir):
    """Leases that have ended by a given time."""
    leases = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("cell_id"), F.when(F.col("event_type") == "view", "leased").otherwise("ready").alias("state"), (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("expires_at"), F.col("event_id").alias("sequence"))
    now = F.lit("2024-01-15 00:00:00").cast(dict(leases.dtypes)["expires_at"])
    return ledger.expired_leases(leases, now).join(leases.select("cell_id", "expires_at", "sequence"), ["cell_id", "expires_at"]).dropDuplicates(["sequence"]).select("cell_id", "sequence", "new_state", "reason", "expires_at")


@query("""SELECT CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' OR value < 10 OR event_type = 'signup' THEN 'quarantined' ELSE 'succeeded' END AS outcome, count(*) AS n FROM events GROUP BY 1""")
def terminal_outcomes(spark, sf_dir):
    """How executions end."""
    e = F.col("event_type")
    outcome = ledger.terminal_outcome(e != "view", ~(F.col("value") < 10), e != "signup", F.when(e == "error", "error"))
    return table(spark, sf_dir, "events").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT source AS source_id, count(*) AS artifacts FROM documents WHERE source NOT LIKE 'src1%' AND source NOT IN ('src0', 'src2', 'src4', 'src6', 'src8') GROUP BY 1")
def rights_summary(spark, sf_dir):
    """Documents whose sources have no rights entry."""
    entries = spark.createDataFrame([(f"src{k}",) for k in (0, 2, 4, 6, 8)], "source_id string")
    return integrity.rights_summary(table(spark, sf_dir, "documents").select(F.col("source").alias("source_id")), entries, "src1")


@query("SELECT c_custkey, 'alias-' || substr(sha256('k|' || n_name), 1, 8) AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def blinded_records(spark, sf_dir):
    """Customers with their nations blinded."""
    nation = table(spark, sf_dir, "nation")
    aliases = nation.select(F.col("n_name").alias("real"), F.concat(F.lit("alias-"), F.substring(F.sha2(F.concat(F.lit("k|"), F.col("n_name")).cast("binary"), 256), 1, 8)).alias("alias"))
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("nation"))
    return integrity.blind(rows, aliases, ["nation"])


@query("""SELECT array_to_string(list_filter([CASE WHEN l_linenumber > 5 THEN 'rating' END, CASE WHEN l_quantity * 2.5 > 100 THEN 'confidence' END, CASE WHEN l_returnflag = 'R' THEN 'recognised' END], lambda x: x IS NOT NULL), ',') AS invalid, count(*) AS n FROM lineitem GROUP BY 1""")
def validated_ratings(spark, sf_dir):
    """Invalid fields of ratings."""
    spelled = F.when(F.col("l_returnflag") == "A", " Yes").when(F.col("l_returnflag") == "N", "0").otherwise("maybe")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("double").alias("rating"), (F.col("l_quantity") * 2.5).alias("confidence"), spelled.alias("recognised"))
    return integrity.validated_ratings(rows).groupBy(F.array_join("invalid_fields", ",").alias("invalid")).agg(F.count("*").alias("n"))


@query("""SELECT array_to_string(list_filter(['animal', 'object'], lambda f: CASE f WHEN 'animal' THEN c_mktsegment = 'BUILDING' ELSE c_acctbal < 0 END), ',') AS missing, CASE WHEN c_nationkey = 3 THEN 'email' ELSE '' END AS prohibited, count(*) AS n FROM customer GROUP BY 1, 2""")
def response_fields(spark, sf_dir):
    """Missing and prohibited fields of responses."""
    response = F.create_map(
        F.lit("animal"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise(""), F.lit("object"), F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise("x"),
        F.when(F.col("c_nationkey") == 3, " Email").otherwise("note"), F.lit("y"),
    )
    checked = table(spark, sf_dir, "customer").select(integrity.response_fields(response, ["animal", "object"]).alias("c"))
    return checked.groupBy(F.array_join("c.missing", ",").alias("missing"), F.array_join("c.prohibited", ",").alias("prohibited")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT p_name AS task_id, p_brand AS panel, p_type, p_size FROM part), l AS (SELECT panel, count(DISTINCT (p_type, p_size)) AS n, count(DISTINCT p_type) * count(DISTINCT p_size) AS f FROM p GROUP BY 1)
SELECT 'duplicate-task' AS finding, task_id AS subject, count(*) AS n FROM p GROUP BY task_id HAVING count(*) > 1
UNION ALL SELECT 'panel-size', panel, count(*) FROM p GROUP BY panel HAVING count(*) <> 80
UNION ALL SELECT 'incomplete-factorial', panel, n FROM l WHERE n < f""")
def candidate_findings(spark, sf_dir):
    """Findings about parts as tasks, brands as panels."""
    tasks = table(spark, sf_dir, "part").select(F.col("p_name").alias("task_id"), F.col("p_brand").alias("panel"), "p_type", "p_size")
    return integrity.candidate_findings(tasks, "panel", ["p_type", "p_size"], 80)


@query("""SELECT r_name AS selector_id, count(n_nationkey) AS matches, min('N' || n_nationkey) AS task_id, count(n_nationkey) = 1 AS resolved FROM region LEFT JOIN nation ON (r_regionkey = 0 OR n_regionkey = r_regionkey) AND (r_regionkey <> 1 OR n_nationkey = 1) GROUP BY 1""")
def resolved_selectors(spark, sf_dir):
    """Selectors by region (one matches all, one a single nation)."""
    selectors = table(spark, sf_dir, "region").select(F.col("r_name").alias("selector_id"), F.when(F.col("r_regionkey") != 0, F.col("r_regionkey")).alias("region"), F.when(F.col("r_regionkey") == 1, F.lit(1)).alias("nation"))
    tasks = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("task_id"), F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"))
    return integrity.resolve_selectors(selectors, tasks, ["region", "nation"])


@query("""WITH m AS (SELECT doc_id, sha256(text) AS e FROM documents WHERE doc_id % 50 <> 7), f AS (SELECT doc_id, sha256(CASE WHEN doc_id % 60 = 9 THEN '!' || text ELSE text END) AS g FROM documents WHERE doc_id % 70 <> 8)
SELECT doc_id AS path, e AS expected, g AS found, CASE WHEN g IS NULL THEN 'missing' WHEN e IS NULL THEN 'unlisted' ELSE 'changed' END AS finding FROM m FULL JOIN f USING (doc_id) WHERE e IS DISTINCT FROM g""")
def manifest_fixity(spark, sf_dir):
    """Documents as files against a manifest."""
    docs = table(spark, sf_dir, "documents")
    manifest = docs.where("doc_id % 50 <> 7").select(F.col("doc_id").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    files = docs.where("doc_id % 70 <> 8").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 60 == 9, F.concat(F.lit("!"), F.col("text"))).otherwise(F.col("text")).cast("binary").alias("content"))
    return integrity.fixity(files, manifest)


@query()
def canonical_hashes(spark, sf_dir):
    """Canonical hashes of event properties."""
    return table(spark, sf_dir, "events").select("event_id", integrity.canonical_hash("props").alias("content_hash"))


@query("""SELECT source AS model_id, count(*) AS planned, count(quality) AS observed, round(count(*) FILTER (quality = 1) / count(*), 6) AS good_rate, round(count(*) FILTER (toxic = 0) / count(*), 6) AS clean_rate,
count(*) FILTER (quality = 1) / count(*) >= 0.35 AND count(*) FILTER (toxic = 0) / count(*) >= 0.3 AS qualified FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def model_qualification(spark, sf_dir):
    """Rates over planned documents by source."""
    plan = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cell_id"), F.col("source").alias("model_id"))
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("cell_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 0).alias("clean"))
    return rounded(qualification.qualification(plan, outcomes, "model_id", ["good", "clean"], {"good": 0.35, "clean": 0.3}))


@query("SELECT doc_id AS cell_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 9 <> 4)")
def unknown_cells(spark, sf_dir):
    """Outcomes without a plan."""
    return qualification.unknown_cells(table(spark, sf_dir, "documents").where("doc_id % 9 <> 4").select(F.col("doc_id").alias("cell_id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("cell_id")))


@query("""SELECT n_name AS judge_id, count(*) AS n, round(avg(c_acctbal / 10000), 6) AS mean_agreement, bool_and(c_custkey % 997 <> 3) AS schema_valid, bool_or(c_custkey % 499 = 7) AS prompt_leakage,
bool_and(c_custkey % 997 <> 3) AND NOT bool_or(c_custkey % 499 = 7) AND avg(c_acctbal / 10000) >= 0.4 AS passes FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def judge_panel(spark, sf_dir):
    """Nations as judges."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    observed = rows.select(F.col("n_name").alias("judge_id"), (F.col("c_acctbal") / 10000).alias("human_agreement"), (F.col("c_custkey") % 997 != 3).alias("schema_valid"), (F.col("c_custkey") % 499 == 7).alias("prompt_leakage"))
    return rounded(qualification.judge_panel(observed, 0.4))


@query("SELECT l_partkey AS question_id, round(sum(l_discount * CASE l_returnflag WHEN 'A' THEN 2.0 WHEN 'R' THEN 0.5 ELSE 1.0 END) / sum(CASE l_returnflag WHEN 'A' THEN 2.0 WHEN 'R' THEN 0.5 ELSE 1.0 END), 6) AS probability, count(*) AS judges FROM lineitem GROUP BY 1")
def weighted_answers(spark, sf_dir):
    """Weighted means of judges."""
    answers = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("question_id"), F.col("l_returnflag").alias("family"), F.col("l_discount").alias("probability"))
    return rounded(qualification.weighted_answers(answers, spark.createDataFrame([("A", 2.0), ("R", 0.5)], "family string, weight double")))


_MODELS = """models AS (SELECT s_name AS model_id, CASE WHEN s_suppkey % 6 = 1 THEN 'unresolved:main' WHEN s_suppkey % 31 <> 4 THEN 'r1' END AS revision, s_suppkey % 9 = 2 AS remote, CASE s_suppkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'reviewed' WHEN 2 THEN 'eligible' WHEN 3 THEN 'restricted' END AS licence,
  CASE WHEN s_nationkey < 12 THEN 'eligible' WHEN s_nationkey < 20 THEN 'reviewed' WHEN s_nationkey < 23 THEN 'retired' ELSE 'candidate' END AS status, s_suppkey % 3 <> 0 AS main FROM supplier)"""


def _models(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    licence = F.when(k % 4 == 0, "open").when(k % 4 == 1, "reviewed").when(k % 4 == 2, "eligible").otherwise("restricted")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("model_id"), F.when(k % 6 == 1, "unresolved:main").when(k % 31 != 4, "r1").alias("revision"), (k % 9 == 2).alias("remote_code_required"), licence.alias("license_status"),
        F.when(n < 12, "eligible").when(n < 20, "reviewed").when(n < 23, "retired").otherwise("candidate").alias("status"), F.when(k % 3 == 0, F.array(F.lit("open"))).otherwise(F.array(F.lit("open"), F.lit("main"))).alias("tracks"),
    )


@query(f"WITH {_MODELS} SELECT model_id FROM models WHERE main AND status IN ('eligible', 'reviewed') AND revision = 'r1' AND NOT remote AND licence <> 'restricted'")
def eligible_models(spark, sf_dir):
    """Suppliers without blockers on a track."""
    return qualification.eligible_models(_models(spark, sf_dir), "main").select("model_id")


@query(f"""WITH {_MODELS} SELECT model_id, concat_ws(',', CASE WHEN status IN ('retired', 'candidate') THEN 'status:' || status END, CASE WHEN revision IS NULL OR revision LIKE 'unresolved%' THEN 'revision-unresolved' END,
CASE WHEN remote THEN 'remote-code-required' END, CASE WHEN licence = 'restricted' THEN 'license:restricted' END) AS blockers FROM models""")
def model_blockers(spark, sf_dir):
    """What keeps each supplier from taking part as a model."""
    return qualification.eligibility(_models(spark, sf_dir)).select("model_id", F.array_join("blockers", ",").alias("blockers"))


@query("SELECT s AS event_type, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(['click', 'error', 'refund', 'view']) AS s) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) ON s = event_type")
def status_counts(spark, sf_dir):
    """Events by listed type."""
    return qualification.status_counts(table(spark, sf_dir, "events"), "event_type", ["click", "error", "refund", "view"])


@query("SELECT avg(quality) >= 0.5 AS quality_met, avg(1 - toxic) >= 0.99 AS clean_met, avg(quality) >= 0.5 AND avg(1 - toxic) >= 0.99 AS may_stop FROM labels")
def stopping_gates(spark, sf_dir):
    """Whether collection may stop."""
    return qualification.stopping_gates(table(spark, sf_dir, "labels").agg(F.avg("quality").alias("quality"), F.avg(1 - F.col("toxic")).alias("clean")), {"quality": 0.5, "clean": 0.99})


def _edges(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.concat(F.lit("R:"), F.col("r_name")).alias("parent"))
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("R:"), F.col("r_name")).alias("child"), F.lit("world").alias("parent"))
    suppliers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("child"), F.col("n_name").alias("parent"))
    return nation.union(region).union(suppliers)


_TREE = """e AS (SELECT n_name AS child, 'R:' || r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'R:' || r_name, 'world' FROM region UNION ALL SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
p AS (SELECT DISTINCT c AS concept, c AS ancestor, 0 AS depth FROM (SELECT child AS c FROM e UNION SELECT parent FROM e) UNION ALL SELECT p.concept, e.parent, p.depth + 1 FROM p JOIN e ON p.ancestor = e.child)"""


@query(f"WITH RECURSIVE {_TREE} SELECT concept, ancestor, depth FROM p")
def concept_ancestors(spark, sf_dir):
    """Ancestors of suppliers, nations and regions."""
    return concepts.ancestors(_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {_TREE}, f AS (SELECT DISTINCT parent AS concept, 'size' AS feature, length(parent) % 3 AS tier FROM e UNION SELECT 'world', 'shape', 1)
SELECT p.concept, feature, arg_min(tier, depth)::INT AS tier, min(depth) AS from_depth FROM p JOIN f ON p.ancestor = f.concept GROUP BY 1, 2""")
def feature_profiles(spark, sf_dir):
    """Inherited features of concepts."""
    edges = _edges(spark, sf_dir)
    features = edges.select(F.col("parent").alias("concept"), F.lit("size").alias("feature"), (F.length("parent") % 3).alias("tier")).union(spark.createDataFrame([("world", "shape", 1)], "concept string, feature string, tier int")).distinct()
    return concepts.feature_profile(concepts.ancestors(edges), features)


@query("SELECT 'world' AS concept")
def missing_parents(spark, sf_dir):
    """Parents that are no concept."""
    return concepts.missing_parents(_edges(spark, sf_dir))


@query("SELECT p_name AS concept, count(*) AS definitions, count(DISTINCT p_type) AS variants FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def merge_conflicts(spark, sf_dir):
    """Concepts defined in several ways."""
    return concepts.merge_conflicts(table(spark, sf_dir, "part").select(F.col("p_name").alias("concept"), F.col("p_type").alias("definition")))


@query("""SELECT c_custkey AS case_id, c_mktsegment AS animal_class, (c_nationkey % 3)::VARCHAR AS object_class, c_acctbal > 0 AS expected, (c_mktsegment, c_nationkey % 3) IN (SELECT (c_mktsegment, c_nationkey % 3) FROM customer WHERE c_acctbal > 9900) AS observed,
(c_acctbal > 0) = ((c_mktsegment, c_nationkey % 3) IN (SELECT (c_mktsegment, c_nationkey % 3) FROM customer WHERE c_acctbal > 9900)) AS passed FROM customer""")
def competency_cases(spark, sf_dir):
    """Cases against allowed pairs of classes."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("animal_class"), (F.col("c_nationkey") % 3).cast("string").alias("object_class"), (F.col("c_acctbal") > 0).alias("expected"), "c_acctbal")
    return concepts.competency(rows.drop("c_acctbal"), rows.where("c_acctbal > 9900").select("animal_class", "object_class")).select("case_id", "animal_class", "object_class", "expected", "observed", "passed")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS a, l_tax * 10 AS b, l_quantity / 50 AS q, l_linestatus = 'F' AS ok, l_shipdate IS NOT NULL AS nb, l_partkey % 40 AS vis, l_suppkey % 5 AS hid FROM lineitem),
d AS (SELECT *, a * (0.5 + 0.5 * ((b + 0) / 2)) AS animal, b * (0.5 + 0.5 * 1.0) AS vehicle, q * least(a, b) AS inter,
  ((CASE WHEN q <= 0.0001 OR q >= 0.995 THEN 0 WHEN q BETWEEN 0.02 AND 0.80 THEN 1 WHEN q < 0.02 THEN (q - 0.0001) / (0.02 - 0.0001) ELSE (0.995 - q) / (0.995 - 0.80) END
  + CASE WHEN a <= 0.001 OR a >= 1.0001 THEN 0 WHEN a BETWEEN 0.08 AND 0.95 THEN 1 WHEN a < 0.08 THEN (a - 0.001) / (0.08 - 0.001) ELSE (1.0001 - a) / (1.0001 - 0.95) END) / 2 + q) / 2 AS comp,
  (ok::INT + vis / greatest(1, vis + hid) + CASE WHEN vis + hid BETWEEN 3 AND 1500 THEN 1.0 WHEN vis + hid <= 5000 THEN 0.5 ELSE 0 END + 1.0 + least(1.0, hid / greatest(1.0, vis / 8))) / 5 AS vec, (a + b + b + 0 + q) / 5 AS cover FROM x)
SELECT l_orderkey, l_linenumber, round(ok::INT, 9) AS submission_integrity, round(least(1, greatest(0, animal)), 9) AS animal_anatomy, round(least(1, greatest(0, vehicle)), 9) AS vehicle_mechanics, round(least(1, greatest(0, inter)), 9) AS interaction,
round(least(1, greatest(0, comp)), 9) AS composition, round(least(1, greatest(0, vec)), 9) AS vector_quality, round(least(1, greatest(0, cover)), 9) AS instruction_coverage,
ok AND animal >= 0.25 AND vehicle >= 0.25 AND inter >= 0.25 AS valid,
round(0.15 * ok::INT + 0.17 * least(1, greatest(0, animal)) + 0.18 * least(1, greatest(0, vehicle)) + 0.20 * least(1, greatest(0, inter)) + 0.10 * least(1, greatest(0, comp)) + 0.10 * least(1, greatest(0, vec)) + 0.10 * least(1, greatest(0, cover)), 9) AS aggregate FROM d""")
def scorecards(spark, sf_dir):
    """Order lines as artifacts."""
    a, b, q = F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50
    answers = F.create_map(F.lit("animal-present"), a, F.lit("object-present"), b, F.lit("animal-feature:bill"), b, F.lit("relation:on"), q, F.lit("scene-coherent"), q)
    strings = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", answers.alias("answers"), strings("bill", "wing").alias("animal_features"), strings().alias("object_features"), strings("on").alias("relations"), (F.col("l_linestatus") == "F").alias("valid_source"),
        F.col("l_shipdate").isNotNull().alias("nonblank"), q.alias("foreground_fraction"), a.alias("bounding_box_fraction"), (F.col("l_partkey") % 40).alias("visible_shapes"), (F.col("l_suppkey") % 5).alias("hidden_shapes"),
        (F.col("l_partkey") % 40 + F.col("l_suppkey") % 5).alias("element_count"), F.lit(10).alias("path_characters"), (F.col("l_suppkey") % 5).alias("group_count"), F.lit(True).alias("source_independent"),
    )
    return rounded(scorecard.scorecard(rows).select("l_orderkey", "l_linenumber", *scorecard.WEIGHTS, "valid", "aggregate"), 9)


@query("""WITH t AS (SELECT role <> 'system' AS safe, length(text) > 40 AS nb, CASE WHEN turn % 2 = 1 THEN length(text) ELSE 0 END AS n, regexp_matches(text, '\\b(?:judge|evaluator|scorer|rating)\\b', 'i') AS m FROM conversations)
SELECT CASE WHEN NOT safe OR NOT nb THEN 'rejected' WHEN n > 0 THEN 'quarantined' ELSE 'eligible' END AS decision, count(*) AS n FROM t GROUP BY 1""")
def judge_inputs(spark, sf_dir):
    """Decisions about inputs to judges."""
    text = F.when(F.col("turn") % 2 == 1, F.length("text")).otherwise(0)
    d = scorecard.judge_input(F.col("role") != "system", F.length("text") > 40, text, annotate.instruction_markers(F.col("text")))
    return table(spark, sf_dir, "conversations").select(d.alias("d")).groupBy("d.decision").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT p_partkey, string_split(lower(p_type), ' ') AS before, string_split(lower(p_name), ' ') AS after FROM part),
s AS (SELECT *, list_distinct(before[1:1]) AS target, list_distinct(before) AS preserve FROM r)
SELECT p_partkey, round(len(list_intersect(target, after)) / len(target), 6) AS target_score, round(len(list_intersect(preserve, after)) / len(preserve), 6) AS preserve_score, round(0.7 * len(list_intersect(target, after)) / len(target) + 0.3 * len(list_intersect(preserve, after)) / len(preserve), 6) AS score,
len(list_filter(preserve, lambda x: NOT list_contains(after, x)))::INT AS n_new_defects FROM s""")
def repair_scores(spark, sf_dir):
    """Repair of role sets, from the words of parts."""
    roles = table(spark, sf_dir, "part").select("p_partkey", F.split(F.lower("p_type"), " ").alias("before"), F.split(F.lower("p_name"), " ").alias("after"))
    r = scorecard.repair_score(F.col("before"), F.col("after"), F.slice("before", 1, 1), F.array_distinct("before"))
    scored = roles.select("p_partkey", r.alias("r"))
    return rounded(scored.select("p_partkey", "r.target_score", "r.preserve_score", "r.score", F.size("r.new_defects").alias("n_new_defects")))


@query()
def source_inspections(spark, sf_dir):
    """Inspection of small drawings made from parts."""
    size = F.col("p_size").cast("string")
    drawing = F.concat(
        F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 60 60"><g id="'), F.lower(F.regexp_replace("p_type", "[^A-Za-z ]", "")), F.lit('"><rect width="'), size, F.lit('" height="9"/><circle r="'), size,
        F.lit('" opacity="'), F.when(F.col("p_size") % 3 == 0, "0").otherwise("1"), F.lit('"/></g>'), F.when(F.col("p_size") % 7 == 0, "<script/>").otherwise("<text>a</text>"), F.lit("</svg>"),
    )
    found = table(spark, sf_dir, "part").select("p_partkey", vector_source.inspected(drawing).alias("i"))
    return found.select("p_partkey", "i.valid", F.array_join("i.errors", ",").alias("errors"), "i.visible_shapes", "i.hidden_shapes", "i.group_count", "i.text_character_count", "i.canonical_hash")


def _calibration_responses(spark, sf_dir):
    """Order lines as responses: three stages, some without a field, some with a wrong value."""
    n, key = F.col("l_linenumber"), F.col("l_orderkey")
    stage = F.when(n <= 3, "blind-recognition").when(n <= 5, "prompt-aware-criteria").when(n == 6, "pairwise-preference").otherwise("rest")
    text = lambda c: F.lit(c) if isinstance(c, str) else c
    blind = {
        "animal_open_text": F.when(key % 7 == 0, " Pelican ").when(key % 11 == 0, "").otherwise(F.lower("l_returnflag")), "mobile_object_open_text": F.when(key % 2 == 0, "go_kart").otherwise("Go-Kart"), "relation_open_text": F.col("l_linestatus"),
        "recognition_confidence": F.when(key % 13 == 0, "many").otherwise((F.col("l_quantity") * 2).cast("int").cast("string")), "note": F.lit("x"),
    }
    criteria = {f: F.lit("none") for f in ("animal_defects", "object_defects", "interaction_defects")} | {f: (F.col("l_suppkey") % m + 1).cast("string") for f, m in zip(calibration.RATINGS, (5, 4, 6))}
    criteria |= {"criterion_confidence": F.lit("50"), "note": F.lit("x")}
    pair = {"pairwise_winner": F.when(key % 3 == 0, "A").when(key % 3 == 1, "tie").otherwise("both"), "note": F.lit("x")}
    as_map = lambda m: F.create_map(*[text(x) for k, v in m.items() for x in (F.lit(k), v)])
    response = F.when(n <= 3, as_map(blind)).when(n <= 5, as_map(criteria)).otherwise(as_map(pair))
    return table(spark, sf_dir, "lineitem").select(
        stage.alias("stage"), response.alias("response"), F.col("l_partkey").cast("string").alias("artifact_id"), F.when(key % 5 == 0, key.cast("string")).alias("duplicate_group_id"),
        F.when(key % 4 != 0, F.when(key % 7 == 0, "pelican").otherwise("n")).alias("expected_animal"), F.lit("go-kart").alias("expected_mobile_object"), F.lit("o").alias("expected_relation"),
    )


_RESPONSES = """v AS (SELECT *, l_orderkey AS k, CASE WHEN l_linenumber <= 3 THEN 'blind-recognition' WHEN l_linenumber <= 5 THEN 'prompt-aware-criteria' WHEN l_linenumber = 6 THEN 'pairwise-preference' ELSE 'rest' END AS stage,
  CASE WHEN l_orderkey % 7 = 0 THEN 'pelican' WHEN l_orderkey % 11 = 0 THEN '' ELSE lower(l_returnflag) END AS a, lower(l_linestatus) AS r FROM lineitem),
w AS (SELECT *, CASE WHEN l_linenumber <= 3 THEN a <> '' AND k % 13 <> 0 WHEN l_linenumber <= 5 THEN l_suppkey % 6 < 5 WHEN l_linenumber = 6 THEN k % 3 <> 2 ELSE false END AS valid FROM v),
b AS (SELECT *, CASE WHEN k % 4 <> 0 THEN a = CASE WHEN k % 7 = 0 THEN 'pelican' ELSE 'n' END END AS ra, r = 'o' AS rr FROM w WHERE valid AND stage = 'blind-recognition')"""


def _agreement_sql(name: str, column: str, item: str, where: str) -> str:
    return f"""{name} AS (WITH c AS (SELECT {item} AS i, {column} AS c, count(*) AS n FROM b WHERE {where} GROUP BY 1, 2), g AS (SELECT i, sum(n) AS n, sum(n * (n - 1) / 2) AS eq FROM c GROUP BY 1 HAVING sum(n) >= 2),
  t AS (SELECT sum(eq) AS eq, sum(n * (n - 1) / 2) AS p, sum(n) AS n FROM g), s AS (SELECT sum(n * (n - 1)) AS same FROM (SELECT c, sum(c.n) AS n FROM c JOIN g USING (i) GROUP BY 1))
  SELECT eq / p AS consistency, CASE WHEN 1 - same / (t.n * (t.n - 1)) = 0 THEN CASE WHEN eq = p THEN 1.0 ELSE 0.0 END ELSE 1 - (1 - eq / p) / (1 - same / (t.n * (t.n - 1))) END AS alpha FROM t, s)"""


_LABELS = {"animal_open_text": "a", "mobile_object_open_text": "'go-kart'", "relation_open_text": "r"}


@query(
    "WITH " + ", ".join([_RESPONSES, *[_agreement_sql(f"d{k}", c, "k", "k % 5 = 0") for k, c in enumerate(_LABELS.values())], *[_agreement_sql(f"p{k}", c, "l_partkey", "true") for k, c in enumerate(_LABELS.values())]])
    + """ SELECT figure, name, round(value::DOUBLE, 6) AS value FROM (
SELECT 'responses' AS figure, 'received' AS name, count(*) AS value FROM w UNION ALL SELECT 'responses', 'valid', count(*) FILTER (valid) FROM w UNION ALL SELECT 'responses', 'invalid', count(*) FILTER (NOT valid) FROM w
UNION ALL SELECT 'stage', stage, count(*) FROM w WHERE valid GROUP BY 2
UNION ALL SELECT 'accuracy', 'animal_open_text', avg(ra::INT) FROM b UNION ALL SELECT 'accuracy', 'mobile_object_open_text', 1.0 UNION ALL SELECT 'accuracy', 'relation_open_text', avg(rr::INT) FROM b
UNION ALL SELECT 'accuracy', 'scene', avg((ra AND rr)::INT) FILTER (ra IS NOT NULL) FROM b UNION ALL SELECT 'brier', 'recognition', avg(((l_quantity * 2)::INT / 100.0 - (ra AND rr)::INT) ** 2) FILTER (ra IS NOT NULL) FROM b
UNION ALL SELECT 'mean-rating', 'animal_rating_1_to_5', avg(l_suppkey % 5 + 1) FROM w WHERE valid AND stage = 'prompt-aware-criteria' UNION ALL SELECT 'mean-rating', 'object_rating_1_to_5', avg(l_suppkey % 4 + 1) FROM w WHERE valid AND stage = 'prompt-aware-criteria'
UNION ALL SELECT 'mean-rating', 'interaction_rating_1_to_5', avg(l_suppkey % 6 + 1) FROM w WHERE valid AND stage = 'prompt-aware-criteria'
UNION ALL SELECT 'winner', CASE WHEN k % 3 = 0 THEN 'A' ELSE 'tie' END, count(*) FROM w WHERE valid AND stage = 'pairwise-preference' GROUP BY 2"""
    + "".join(f" UNION ALL SELECT 'duplicate-consistency', '{n}', consistency FROM d{k} UNION ALL SELECT 'alpha', '{n}', alpha FROM p{k}" for k, n in enumerate(_LABELS)) + ")"
)
def calibration_analysis(spark, sf_dir):
    """Figures of a calibration study."""
    return rounded(calibration.analysis(_calibration_responses(spark, sf_dir)))


@query(f"""WITH {_RESPONSES} SELECT stage, array_to_string(CASE WHEN stage = 'blind-recognition' AND a = '' THEN ['animal_open_text'] ELSE [] END, ',') AS missing,
array_to_string(CASE WHEN stage = 'blind-recognition' AND k % 13 = 0 THEN ['recognition_confidence'] WHEN stage = 'prompt-aware-criteria' AND l_suppkey % 6 = 5 THEN ['interaction_rating_1_to_5'] WHEN stage = 'pairwise-preference' AND k % 3 = 2 THEN ['pairwise_winner'] ELSE [] END, ',') AS invalid,
valid, count(*) AS n FROM w GROUP BY ALL""")
def calibration_responses(spark, sf_dir):
    """Validity of responses by stage."""
    checked = calibration.validated(_calibration_responses(spark, sf_dir))
    return checked.groupBy("stage", F.array_join("missing_fields", ",").alias("missing"), F.array_join("invalid_fields", ",").alias("invalid"), "valid").agg(F.count("*").alias("n"))


def _judges(spark, sf_dir):
    roles = F.array_compact(F.array(F.when(F.col("s_suppkey") % 2 == 0, "anatomy"), F.when(F.col("s_suppkey") % 3 == 0, "mechanics"), F.when(F.col("s_suppkey") % 5 == 0, "scene")))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("J"), F.col("s_suppkey").cast("string")).alias("judge_id"), F.concat(F.lit("F"), F.col("s_nationkey").cast("string")).alias("family"), roles.alias("roles"))


_JUDGES = """j AS (SELECT 'J' || s_suppkey AS judge_id, 'F' || s_nationkey AS family, unnest(list_filter([CASE WHEN s_suppkey % 2 = 0 THEN 'anatomy' END, CASE WHEN s_suppkey % 3 = 0 THEN 'mechanics' END, CASE WHEN s_suppkey % 5 = 0 THEN 'scene' END], lambda x: x IS NOT NULL)) AS role FROM supplier)"""


@query(f"""WITH {_JUDGES}, c AS (SELECT 'C' || n_nationkey AS canary_id, 'A' || n_regionkey AS artifact_id, unnest(CASE WHEN n_nationkey % 2 = 0 THEN ['anatomy', 'scene'] ELSE ['mechanics'] END) AS role FROM nation)
SELECT 'JCEL-' || substr(sha256(judge_id || chr(31) || role || chr(31) || canary_id), 1, 20) AS cell_id, judge_id, family, role, canary_id, artifact_id FROM j JOIN c USING (role)""")
def judge_plan(spark, sf_dir):
    """Judges, their roles, and nations as canaries."""
    canaries = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("canary_id"), F.concat(F.lit("A"), F.col("n_regionkey").cast("string")).alias("artifact_id"),
        F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("anatomy"), F.lit("scene"))).otherwise(F.array(F.lit("mechanics"))).alias("applicable_roles"),
    )
    return qualification.judge_plan(_judges(spark, sf_dir), canaries)


@query(f"""WITH {_JUDGES}, m AS (SELECT * FROM (VALUES ('anatomy', 5), ('mechanics', 20), ('scene', 30), ('safety', 1)) t(role, minimum)), f AS (SELECT role, count(DISTINCT family) AS families FROM j GROUP BY 1)
SELECT role, minimum, coalesce(families, 0) AS families, coalesce(families, 0) >= minimum AS satisfied FROM m LEFT JOIN f USING (role)""")
def judge_diversity(spark, sf_dir):
    """Families of judges by role."""
    minimums = spark.createDataFrame([("anatomy", 5), ("mechanics", 20), ("scene", 30), ("safety", 1)], "role string, minimum int")
    return qualification.judge_diversity(_judges(spark, sf_dir), minimums)


@query("SELECT 'M' || s_suppkey AS model_id, CASE WHEN s_nationkey < 20 THEN 'P' || s_nationkey END AS profile_id FROM supplier")
def runtime_profiles(spark, sf_dir):
    """The profile of each supplier as a model: that of its nation."""
    models = table(spark, sf_dir, "supplier").withColumn("model_id", F.concat(F.lit("M"), F.col("s_suppkey").cast("string")))
    profiles = models.where("s_nationkey < 20").groupBy(F.concat(F.lit("P"), F.col("s_nationkey").cast("string")).alias("profile_id")).agg(F.collect_list("model_id").alias("model_ids"))
    return qualification.runtime_profiles(models.select("model_id"), profiles)


@query("""WITH r AS (SELECT p_partkey, list_distinct(string_split(lower(p_type), ' ')) AS b, list_distinct(string_split(lower(p_name), ' ')) AS a, string_split(lower(p_name), ' ')[1:1] AS t1, string_split(lower(p_type), ' ')[1:2] AS k1, string_split(lower(p_type), ' ')[3:3] AS k2 FROM part),
s AS (SELECT *, (0.7 * len(list_intersect(t1, b)) / len(list_distinct(t1)) + 0.3 * len(list_intersect(k1, b)) / len(list_distinct(k1)) + 0.3 * (CASE WHEN len(k2) = 0 THEN 1 ELSE len(list_intersect(k2, b)) / len(k2) END)) / 2 AS x,
  (0.7 * len(list_intersect(t1, a)) / len(list_distinct(t1)) + 0.3 * len(list_intersect(k1, a)) / len(list_distinct(k1)) + 0.3 * (CASE WHEN len(k2) = 0 THEN 1 ELSE len(list_intersect(k2, a)) / len(k2) END)) / 2 AS y, list_concat(k1, k2) AS k FROM r)
SELECT p_partkey, round(x, 6) AS before_score, round(y, 6) AS after_score, round(y - x, 6) AS improvement, round(CASE WHEN list_contains(b, t1[1]) THEN 0 ELSE 0.5 END, 6) AS repaired_fraction,
round(len(list_filter(k, lambda z: list_contains(b, z) AND list_contains(a, z))) / greatest(1, len(k)), 6) AS preservation_fraction, array_to_string(list_sort(list_distinct(list_transform(list_filter(k, lambda z: list_contains(b, z) AND NOT list_contains(a, z)), lambda z: 'lost:' || z))), ',') AS new_defects FROM s""")
def repair_assessments(spark, sf_dir):
    """Two requirements for each part: its name's first word is to come, the words of its type are to stay."""
    roles = table(spark, sf_dir, "part").select("p_partkey", F.split(F.lower("p_type"), " ").alias("before"), F.split(F.lower("p_name"), " ").alias("after"))
    requirement = lambda target, keep: F.struct(target.alias("target_roles"), keep.alias("preserve_roles"))
    wanted = F.array(requirement(F.slice("after", 1, 1), F.slice("before", 1, 2)), requirement(F.array().cast("array<string>"), F.slice("before", 3, 1)))
    r = scorecard.repair_assessment(F.col("before"), F.col("after"), wanted)
    out = roles.select("p_partkey", r.alias("r"))
    figures = ("before_score", "after_score", "improvement", "repaired_fraction", "preservation_fraction")
    return rounded(out.select("p_partkey", *[f"r.{f}" for f in figures], F.array_join("r.new_defects", ",").alias("new_defects")))


_SECRET = b"0123456789abcdef0123456789abcdef"


def _hmac_sql(domain: str, value: str) -> str:
    pad = lambda x: bytes(b ^ x for b in _SECRET.ljust(64, b"\0")).hex()
    return f"sha256(unhex('{pad(0x5C)}') || unhex(sha256(unhex('{pad(0x36)}') || encode('{domain}' || chr(31) || {value}))))"


@query(f"""WITH e AS (SELECT 'R' || n_nationkey AS repair_id FROM nation), s AS (SELECT repair_id, row_number() OVER (ORDER BY {_hmac_sql('selection', 'repair_id')}) <= 10 AS twice FROM e),
o AS (SELECT repair_id, unnest(CASE WHEN twice THEN ['primary', 'duplicate-1'] ELSE ['primary'] END) AS occurrence FROM s)
SELECT (row_number() OVER (ORDER BY {_hmac_sql('order', "'order' || chr(31) || repair_id || chr(31) || occurrence")}))::INT AS ordinal, 'assignment-' || substr({_hmac_sql('order', "repair_id || chr(31) || occurrence")}, 1, 16) AS assignment_alias,
'episode-' || substr({_hmac_sql('alias', 'repair_id')}, 1, 16) AS episode_alias, repair_id, occurrence, occurrence <> 'primary' AS is_duplicate FROM o""")
def custody_schedule(spark, sf_dir):
    """Nations as episodes, ten of them twice."""
    episodes = table(spark, sf_dir, "nation").select(F.concat(F.lit("R"), F.col("n_nationkey").cast("string")).alias("repair_id"))
    return integrity.custody_schedule(episodes, _SECRET)


def _grammar(spark, sf_dir):
    """Nations as animals, suppliers as objects, regions as relations; some with faults."""
    n, o, r = (table(spark, sf_dir, t) for t in ("nation", "supplier", "region"))
    mode = lambda k: F.concat(F.lit("r"), k.cast("string"))
    animals = n.select(
        F.when(F.col("n_nationkey") != 13, F.lower("n_name")).otherwise("").alias("id"), F.initcap("n_name").alias("label"), F.lit("c").alias("animal_class"),
        F.array(mode(F.col("n_regionkey")), mode((F.col("n_regionkey") + 1) % 6)).alias("interaction_modes"), F.sequence(F.lit(1), F.col("n_nationkey") % 7 + 1).alias("required_features"), (F.col("n_nationkey") % 5).alias("adaptation"),
    )
    k = F.col("s_suppkey")
    objects = o.select(
        F.concat(F.lit("o"), (k - F.when(k % 40 == 1, 0).when(k % 40 == 2, 1).otherwise(0)).cast("string")).alias("id"), F.concat(F.lit("thing "), k.cast("string")).alias("label"), F.concat(F.lit("k"), (k % 3).cast("string")).alias("object_class"),
        F.when(k % 11 != 0, F.concat(F.lit("i"), (k % 2).cast("string"))).alias("interface_class"), F.when(k % 5 == 0, F.array(F.lit("i0"), F.lit("i2"))).otherwise(F.array().cast("array<string>")).alias("interface_classes"),
        F.array(mode(k % 5)).alias("interaction_modes"), F.sequence(F.lit(1), F.col("s_nationkey") % 6 + 1).alias("required_features"),
    )
    q = F.col("r_regionkey")
    relations = r.select(
        mode(q).alias("id"), F.when(q != 2, F.concat(F.lit("on the "), F.lower("r_name"))).alias("phrase"), F.when(q == 1, F.array(F.lit("k0"), F.lit("k1"))).otherwise(F.array().cast("array<string>")).alias("allowed_object_classes"),
        F.when(q == 3, F.array(F.lit("i2"))).otherwise(F.array().cast("array<string>")).alias("allowed_interface_classes"), F.array().cast("array<string>").alias("required_contacts"),
    )
    return animals, objects, relations


_GRAMMAR = """an AS (SELECT CASE WHEN n_nationkey <> 13 THEN lower(n_name) ELSE '' END AS id, list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]) AS words, ['r' || n_regionkey, 'r' || (n_regionkey + 1) % 6] AS modes, n_nationkey % 7 + 1 AS features, n_nationkey % 5 AS adaptation FROM nation),
ob AS (SELECT 'o' || (s_suppkey - CASE WHEN s_suppkey % 40 = 2 THEN 1 ELSE 0 END) AS id, 'thing ' || s_suppkey AS label, 'k' || s_suppkey % 3 AS cls, CASE WHEN s_suppkey % 11 <> 0 THEN 'i' || s_suppkey % 2 END AS iface, CASE WHEN s_suppkey % 5 = 0 THEN ['i0', 'i2'] ELSE [] END AS ifaces,
  'r' || s_suppkey % 5 AS mode, s_nationkey % 6 + 1 AS features FROM supplier),
re AS (SELECT 'r' || r_regionkey AS id, CASE WHEN r_regionkey <> 2 THEN 'on the ' || lower(r_name) END AS phrase, CASE WHEN r_regionkey = 1 THEN ['k0', 'k1'] ELSE [] END AS classes, CASE WHEN r_regionkey = 3 THEN ['i2'] ELSE [] END AS ifs FROM region),
de AS (SELECT an.id AS animal, array_to_string(an.words, ' ') AS animal_label, an.features + ob.features AS features, adaptation, ob.id AS object, ob.label AS object_label, re.id AS relation, coalesce(phrase, replace(re.id, '_', ' ')) AS phrase
  FROM (SELECT *, unnest(modes) AS mode FROM an) an JOIN re ON an.mode = re.id JOIN ob ON ob.mode = re.id
  WHERE (len(classes) = 0 OR list_contains(classes, cls)) AND (len(ifs) = 0 OR list_has_any(ifs, CASE WHEN len(ifaces) > 0 THEN ifaces ELSE list_filter([iface], lambda x: x IS NOT NULL) END)))"""


@query(f"""WITH {_GRAMMAR} SELECT 'animals' AS part, id, CASE WHEN id = '' THEN 'identifier-missing' ELSE 'identifier-repeated' END AS finding FROM an GROUP BY id HAVING id = '' OR count(*) > 1
UNION ALL SELECT 'objects', id, CASE WHEN id = '' THEN 'identifier-missing' ELSE 'identifier-repeated' END FROM ob GROUP BY id HAVING id = '' OR count(*) > 1
UNION ALL SELECT DISTINCT 'animals', id, 'unknown-mode:' || mode FROM (SELECT id, unnest(modes) AS mode FROM an) WHERE mode NOT IN (SELECT id FROM re)
UNION ALL SELECT 'objects', id, 'interface-missing' FROM ob WHERE iface IS NULL""")
def grammar_findings(spark, sf_dir):
    """Faults of a grammar."""
    return tasks.grammar_findings(*_grammar(spark, sf_dir))


_TASKS = f"""{_GRAMMAR}, ta0 AS (SELECT *, 'scenario-' || substr(sha256('1.0' || chr(31) || animal || chr(31) || object || chr(31) || relation || chr(31) || viewpoint), 1, 12) AS scenario_id,
  'Generate an SVG of a ' || animal_label || ' ' || phrase || ' ' || object_label || ', viewed from the ' || viewpoint || ', in a ' || style || ' style.' AS prompt FROM de, (SELECT unnest(['side', 'rear']) AS viewpoint), (SELECT unnest(['flat icon', 'line art']) AS style)),
ta1 AS (SELECT *, 'prompt-' || substr(sha256(scenario_id || chr(31) || prompt), 1, 12) AS prompt_id FROM ta0), ta AS (SELECT *, 'task-' || substr(sha256('R1' || chr(31) || scenario_id || chr(31) || prompt_id), 1, 16) AS task_id FROM ta1),
tasks AS (SELECT task_id, scenario_id, prompt_id, prompt, animal, object, relation, viewpoint, style, least(5, 1 + (viewpoint = 'rear')::INT + 1 + (features >= 10)::INT + (style = 'line art')::INT + (adaptation >= 3)::INT)::INT AS difficulty,
  (('0x' || substr(sha256('7' || chr(31) || task_id), 1, 16))::UBIGINT % 2147483647)::BIGINT AS seed FROM ta)"""


def _grammar_tasks(spark, sf_dir):
    return tasks.build_tasks(tasks.compatible_designs(*_grammar(spark, sf_dir)), ["side", "rear"], ["flat icon", "line art"], "R1", "1.0", 7)


@query(f"WITH {_TASKS} SELECT * FROM tasks")
def grammar_tasks(spark, sf_dir):
    """Every task of the grammar."""
    return _grammar_tasks(spark, sf_dir)


@query(f"WITH {_TASKS} SELECT task_id, prompt, difficulty FROM tasks ORDER BY {_hash_sql("'3'", 'task_id')}, task_id LIMIT 100")
def drawn_tasks(spark, sf_dir):
    """A hundred tasks in a hash order (a drawing operator)."""
    return tasks.drawn_tasks(_grammar_tasks(spark, sf_dir), 100, 3).select("task_id", "prompt", "difficulty")


def _submissions(spark, sf_dir):
    """A user's events as submissions of stages."""
    stage = F.element_at(F.array(*[F.lit(s) for s in (*sessions.STAGES, "debrief")]), F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "purchase", 3).otherwise(F.col("event_id").cast("int") % 4 + 1))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("assignment_id"), F.col("event_id").alias("position"), stage.alias("stage"))


_SESSIONS = """s AS (SELECT user_id AS assignment_id, event_id AS position, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE event_id % 4 + 1 END AS rank FROM events),
d1 AS (SELECT assignment_id, min(position) AS p FROM s WHERE rank = 1 GROUP BY 1), d2 AS (SELECT s.assignment_id, min(position) AS p FROM s JOIN d1 ON s.assignment_id = d1.assignment_id AND s.position > d1.p WHERE rank = 2 GROUP BY 1),
d3 AS (SELECT s.assignment_id, min(position) AS p FROM s JOIN d2 ON s.assignment_id = d2.assignment_id AND s.position > d2.p WHERE rank = 3 GROUP BY 1),
f AS (SELECT s.*, CASE rank WHEN 1 THEN d1.p WHEN 2 THEN d2.p WHEN 3 THEN d3.p END AS own, d1.p AS a, d2.p AS b, d3.p AS c FROM s LEFT JOIN d1 USING (assignment_id) LEFT JOIN d2 USING (assignment_id) LEFT JOIN d3 USING (assignment_id))"""


@query(f"""WITH {_SESSIONS} SELECT assignment_id, position, ['blind-recognition', 'prompt-aware-criteria', 'pairwise-preference', 'debrief'][rank] AS stage,
CASE WHEN rank = 4 THEN 'not-of-this-session' WHEN position > own THEN 'already-locked' ELSE 'out-of-order' END AS finding FROM f WHERE rank = 4 OR position IS DISTINCT FROM own""")
def session_findings(spark, sf_dir):
    """Submissions that sessions do not accept."""
    return sessions.stage_findings(_submissions(spark, sf_dir))


@query(f"""WITH {_SESSIONS} SELECT assignment_id, max((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT)::BIGINT AS stages_done,
['blind-recognition', 'prompt-aware-criteria', 'pairwise-preference'][max((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT) + 1] AS next_stage, bool_or(a IS NOT NULL) AS prompt_disclosed FROM f GROUP BY 1""")
def session_states(spark, sf_dir):
    """How far sessions have come."""
    return sessions.disclosure(_submissions(spark, sf_dir))


@query("""WITH l AS (SELECT user_id AS session_id, 'a' || event_id % 50 AS alias, event_type AS payload, event_id FROM events),
o AS (SELECT session_id, list({'alias': alias, 'payload': payload, 'id': event_id} ORDER BY event_id) AS x FROM l GROUP BY 1),
h AS (SELECT session_id, x, list_reduce(list_transform(x, lambda e, i: [[e.alias, e.payload, i::VARCHAR, '']]), lambda acc, e: list_append(acc, list_concat(e[1][1:3], [sha256(acc[len(acc)][4] || chr(31) || e[1][3] || chr(31) || e[1][1] || chr(31) || e[1][2])])), [['', '', '0', repeat('0', 64)]]) AS c FROM o),
e AS (SELECT session_id, unnest(range(1, len(x) + 1)) AS sequence, x[sequence].alias AS alias, x[sequence].id AS event_id, c[sequence][4] AS before, c[sequence + 1][4] AS own FROM h),
d AS (SELECT *, event_id % 37 = 0 AS relinked, event_id % 41 = 0 AS rewritten, row_number() OVER (PARTITION BY session_id, alias ORDER BY sequence) AS nth FROM e)
SELECT session_id, sequence, unnest(list_filter([CASE WHEN relinked THEN 'chain-drift' END, CASE WHEN relinked OR rewritten THEN 'hash-drift' END, CASE WHEN nth > 1 THEN 'rated-twice' END, CASE WHEN alias IN ('a7', 'a8') THEN 'not-in-session' END], lambda x: x IS NOT NULL)) AS finding FROM d""")
def rating_chain_findings(spark, sf_dir):
    """Ledgers of users whose entries are chained as they should be, but for one link in 37 and one payload in 41."""
    listed = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("position"), F.concat(F.lit("a"), (F.col("event_id") % 50).cast("string")).alias("assignment_alias"), F.col("event_type").alias("payload"))
    entries = sessions.chained(listed).withColumn("previous_hash", F.when(F.col("position") % 37 == 0, "x").otherwise(F.col("previous_hash"))).withColumn("payload", F.when(F.col("position") % 41 == 0, "other").otherwise(F.col("payload"))).drop("position")
    allowed = spark.range(50).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("assignment_alias")).where("assignment_alias not in ('a7', 'a8')")
    return sessions.chain_findings(entries, allowed)


@query("""SELECT event_id, key AS metric, value::DOUBLE AS value FROM (SELECT event_id, unnest(map_entries(MAP {'a': props->'$.k', 'b': '"7"', 'c': 'true', 'd': (value * 4)::INT::VARCHAR}), recursive := true) FROM events) WHERE key IN ('a', 'd')""")
def numeric_annotations(spark, sf_dir):
    """Numbers among annotations that also hold texts and booleans."""
    k = F.get_json_object("props", "$.k")
    annotations = F.concat(F.lit('{"a": '), k, F.lit(', "b": "7", "c": true, "d": '), F.round(F.col("value") * 4).cast("int").cast("string"), F.lit("}"))
    return series.numeric_annotations(table(spark, sf_dir, "events").select("event_id", annotations.alias("annotations")))


@query()
def fuzz_report(spark, sf_dir):
    """What the source gate makes of 26 changes of each part's drawing."""
    size = F.col("p_size").cast("string")
    drawing = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg"><g id="a"><rect width="'), size, F.lit('"/></g></svg>'))
    return mutations.fuzz_report(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), drawing.alias("source")), 26, 5)


@query("""SELECT p_name || ' ' || p_partkey AS concept, CASE WHEN p_size % 7 <> 0 THEN p_brand || ' of size ' || p_size END AS definition, CASE WHEN p_partkey % 3 = 0 THEN 2 WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END AS ontologies FROM part""")
def merged_ontologies(spark, sf_dir):
    """Parts as concepts of two ontologies: every third and every fifth part stand in both."""
    parts = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_partkey").alias("concept"), F.when(F.col("p_size") % 7 != 0, F.concat(F.col("p_brand"), F.lit(" of size "), F.col("p_size").cast("string"))).alias("definition"), "p_partkey")
    other = parts.where((F.col("p_partkey") % 3 == 0) | (F.col("p_partkey") % 5 == 0))
    return concepts.merged_ontologies(parts.union(other).drop("p_partkey"))


@query("""SELECT n_name AS concept, '{"@id":"urn:' || n_name || '","@type":"skos:Concept","rdfs:label":"' || lower(n_name) || '","rdfs:subClassOf":{"@id":"urn:' || r_name || '"}}' AS node FROM nation JOIN region ON n_regionkey = r_regionkey""")
def concept_nodes(spark, sf_dir):
    """Nations as nodes below their regions."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("concept"), F.lower("n_name").alias("label"), F.col("r_name").alias("parent"))
    return concepts.json_ld(rows, "urn:")


@query(f"""WITH {_RESPONSES}, q AS (SELECT l_partkey::VARCHAR AS artifact_id, stage, unnest(CASE WHEN stage = 'blind-recognition' THEN [{{'f': 'animal_open_text', 'v': a, 'x': NULL::DOUBLE}}, {{'f': 'mobile_object_open_text', 'v': 'go-kart', 'x': NULL}}, {{'f': 'relation_open_text', 'v': r, 'x': NULL}}]
  WHEN stage = 'prompt-aware-criteria' THEN list_transform([{{'f': 'animal_rating_1_to_5', 'x': l_suppkey % 5 + 1}}, {{'f': 'object_rating_1_to_5', 'x': l_suppkey % 4 + 1}}, {{'f': 'interaction_rating_1_to_5', 'x': l_suppkey % 6 + 1}}], lambda z: {{'f': z.f, 'v': z.x || '.0', 'x': z.x::DOUBLE}}) ELSE [] END, recursive := true) FROM w),
c AS (SELECT artifact_id, stage, f AS field, v, count(*) AS n, min(x) AS x FROM q GROUP BY ALL),
g AS (SELECT artifact_id, stage, field, sum(n) AS total, max(n) / sum(n) AS share, max(x) - min(x) AS r, string_agg(v || '=' || n, ';' ORDER BY v) AS vals FROM c GROUP BY ALL),
u AS (SELECT artifact_id, stage, field, CASE WHEN r IS NULL AND share < 2 / 3 THEN 'inter-rater-label-disagreement' WHEN r >= 2 THEN 'criterion-rating-range' END AS reason, vals, share FROM g WHERE total >= 2
  UNION ALL SELECT l_partkey::VARCHAR, stage, 'recognition_confidence', 'low-mean-recognition-confidence', 'observations=' || count(*) FILTER (k % 13 <> 0), avg((l_quantity * 2)::INT) FILTER (k % 13 <> 0) / 100 FROM w WHERE stage = 'blind-recognition' GROUP BY 1, 2 HAVING avg((l_quantity * 2)::INT) FILTER (k % 13 <> 0) < 50)
SELECT 'ADJ-' || substr(sha256(artifact_id || chr(31) || stage || chr(31) || field || chr(31) || reason || chr(31) || vals), 1, 20) AS item_id, artifact_id, stage, field, reason, vals AS values, round(share, 6) AS share FROM u WHERE reason IS NOT NULL""")
def adjudication_queue(spark, sf_dir):
    """Artifacts whose responses need another look."""
    return rounded(calibration.adjudication_queue(_calibration_responses(spark, sf_dir)))


@query("""WITH d AS (SELECT a.l_returnflag IS NOT DISTINCT FROM b.l_returnflag AND (CASE WHEN a.l_quantity > 40 THEN NULL ELSE a.l_linestatus END) IS NOT DISTINCT FROM (CASE WHEN b.l_quantity > 40 THEN NULL ELSE b.l_linestatus END) AS same
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = 1 WHERE a.l_linenumber = 2)
SELECT count(*) AS pairs, count(*) FILTER (same) AS exact_agreements, round(avg(same::INT), 6) AS consistency FROM d""")
def duplicate_exact_consistency(spark, sf_dir):
    """Second lines of orders as repeats of the first."""
    n = F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.where(n <= 2).join(lines.where(n == 1).select("l_orderkey"), "l_orderkey", "left_semi").select(
        F.concat_ws("|", "l_orderkey", n).alias("row_id"), F.when(n == 2, F.concat_ws("|", "l_orderkey", F.lit(1))).alias("duplicate_of"), F.col("l_returnflag").alias("a"), F.when(F.col("l_quantity") <= 40, F.col("l_linestatus")).alias("b")
    )
    return rounded(ratings.duplicate_exact_consistency(rows, ["a", "b"]))


@query("""WITH f AS (SELECT 'docs/' || doc_id AS path, sha256(text) AS h, strlen(text) AS n FROM documents),
l AS (SELECT substr(sha256(path), 1, 2) AS leaf, count(*) AS c, sum(n) AS n, sha256(string_agg(path || chr(31) || h || chr(31) || n, chr(10) ORDER BY path || chr(31) || h || chr(31) || n)) AS h FROM f GROUP BY 1)
SELECT sum(c)::BIGINT AS files, sum(n)::BIGINT AS bytes, sha256(string_agg(h, '' ORDER BY leaf)) AS manifest_sha256 FROM l""")
def manifest_receipt(spark, sf_dir):
    """The receipt of a manifest of all documents as files."""
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").cast("binary").alias("content"))
    return integrity.manifest_receipt(integrity.manifest(files))


@query("""SELECT event_id, list_sort(list_filter([CASE WHEN value > 400 THEN 'value: is too large' END, CASE WHEN event_type = 'error' THEN 'kind: is not one of the listed values' END, CASE WHEN event_id % 7 = 0 THEN '$: lacks user' END, CASE WHEN event_id % 11 = 0 THEN 'tags/1: is not of type string' END,
CASE WHEN event_id % 13 = 0 THEN '$: has an unknown member extra' END], lambda x: x IS NOT NULL)) AS errors FROM events""")
def contract_errors(spark, sf_dir):
    """Events as payloads, some of them against their contract."""
    schema = {
        "type": "object", "required": ["kind", "value", "user"], "additionalProperties": False,
        "properties": {"kind": {"enum": ["click", "purchase", "signup", "view"]}, "value": {"type": "number", "maximum": 400}, "user": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}}},
    }
    e = F.col("event_id")
    user = F.when(e % 7 != 0, F.concat(F.lit(',"user":'), F.col("user_id").cast("string"))).otherwise("")
    tags, extra = F.when(e % 11 == 0, '["a",1]').otherwise('["a","b"]'), F.when(e % 13 == 0, ',"extra":null').otherwise("")
    payload = F.concat(F.lit('{"kind":"'), F.col("event_type"), F.lit('","value":'), F.col("value").cast("string"), F.lit(',"tags":'), tags, user, extra, F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", F.array_sort(contracts.contract_errors(payload, schema)).alias("errors"))
