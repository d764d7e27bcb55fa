"""Hash-chained event logs: chaining, replay, reconciliation and leases.

Events have sequence, cell_id, new_state, previous_event_hash, event_hash and cost. Each row is
checked against its predecessor, so replay is a window query, not a loop.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brightloom.functions.names import free
from brightloom.operators.ordered import folded

#: Legal state changes of a ledger, and those that a lease store adds.
TRANSITIONS = {
    "ready": ("leased", "cancelled"),
    "leased": ("ready", "succeeded", "failed", "quarantined", "cancelled"),
    "failed": ("ready",),
}
STORE_TRANSITIONS = TRANSITIONS | {"leased": (*TRANSITIONS["leased"], "leased")}
GENESIS = "0" * 64
TOLERANCE = 1e-8


def link_hash(previous: Column, *payload: Column) -> Column:
    """The hash of an event: of its predecessor's hash and its own payload."""
    return F.sha2(F.concat_ws("\x1f", previous, *[p.cast("string") for p in payload]).cast("binary"), 256)


def _legal(previous: Column, new: Column, table: dict[str, tuple[str, ...]]) -> Column:
    out = F.lit(False)
    for state, after in table.items():
        out = out | ((previous == state) & new.isin(*after))
    return out


def replay(events: DataFrame, transitions: dict[str, tuple[str, ...]] = TRANSITIONS) -> DataFrame:
    """``events`` with what is wrong with each: a gap before it, a broken link to its predecessor, an
    illegal transition. Predecessors are found by joining sequence numbers, so that the one chain of
    all events is checked in parallel; only a cell's own events are put in order."""
    first = events.agg(F.min("sequence").alias("s")).first()["s"]
    (own,) = free(events, "_before")
    before = events.select((F.col("sequence") + 1).alias("sequence"), F.col("event_hash").alias(own))
    cell = Window.partitionBy("cell_id").orderBy("sequence")
    starts = F.col("sequence") == F.lit(first)
    return (
        events.join(before, "sequence", "left")
        .withColumn("gap", F.col(own).isNull() & ~starts)
        .withColumn("broken_link", F.col("previous_event_hash") != F.when(starts, F.lit(GENESIS)).otherwise(F.coalesce(own, F.lit(""))))
        .withColumn("previous_state", F.coalesce(F.lag("new_state").over(cell), F.lit("ready")))
        .withColumn("illegal", ~_legal(F.col("previous_state"), F.col("new_state"), transitions))
        .drop(own)
    )


def _stated(cell: Column, new_state: Column, reason: Column, cost: Column, artifact: Column) -> list[Column]:
    """What an event states besides its place. Costs count by the millionth, so that they read alike everywhere."""
    return [F.coalesce(c.cast("string"), F.lit("")) for c in (cell, new_state, reason, F.round(cost * 1_000_000).cast("long"), artifact)]


def event_hash(previous: Column, sequence: Column, cell: Column, new_state: Column, reason: Column, cost: Column, artifact: Column) -> Column:
    """The hash of a campaign event: what it states, on top of its predecessor's hash."""
    return link_hash(previous, F.coalesce(sequence.cast("string"), F.lit("")), *_stated(cell, new_state, reason, cost, artifact))


def appended(wanted: DataFrame, transitions: dict[str, tuple[str, ...]] = TRANSITIONS) -> DataFrame:
    """The events that ``wanted`` (campaign_id, position, cell_id, new_state, reason, cost, artifact_id) append
    to empty logs, one after another in order of position, and what was refused: campaign_id, position, the
    wanted columns, refused (null if appended), and for appended events sequence, previous_state,
    previous_event_hash and event_hash. Without a campaign there is no log to append to.

    Refused are illegal changes of a cell's state, costs below 0, blank reasons and successes without an
    artifact; they leave no trace in the log. A cell's state is folded over its own events. A log's hashes
    need one another, so they are folded over the log's events, of which one hash stays in memory."""
    rest = ["position", "new_state", "reason", "cost", "artifact_id"]
    asked = wanted.select("campaign_id", "cell_id", *rest).withColumn("cost", F.col("cost").cast("double"))
    wrong = (
        F.when(F.coalesce("cost", F.lit(-1.0)) < 0, "cost-below-zero").when(F.trim(F.coalesce("reason", F.lit(""))) == "", "no-reason")
        .when((F.col("new_state") == "succeeded") & F.col("artifact_id").isNull(), "no-artifact")
    )

    def judge(state: str, new_state: str | None, bad: str | None) -> tuple[str, tuple]:
        refused = bad if new_state in transitions.get(state, ()) else f"illegal-transition:{state}>{new_state or ''}"
        return state if refused else new_state, (state, refused)

    columns = ["campaign_id", "position", "cell_id", *rest[1:]]
    judged = folded(asked, ["campaign_id", "cell_id"], rest, columns, [F.col("new_state"), wrong], lambda: "ready", judge, "previous_state string, refused string")

    def chain(end: tuple[int, str], stated: bytes | None) -> tuple[tuple[int, str], tuple]:
        if stated is None:
            return end, (None, None, None)
        n, last = end
        own = hashlib.sha256(f"{last}\x1f{n}\x1f".encode() + stated).hexdigest()
        return (n + 1, own), (n, last, own)

    stated = F.when(F.col("refused").isNull() & F.col("campaign_id").isNotNull(), F.concat_ws("\x1f", *_stated(*[F.col(c) for c in columns[2:]])).cast("binary"))
    return folded(judged, ["campaign_id"], ["position", "cell_id", *rest[1:]], [*columns, "previous_state", "refused"], [stated], lambda: (0, GENESIS), chain, "sequence long, previous_event_hash string, event_hash string")


def hash_findings(events: DataFrame) -> DataFrame:
    """(campaign_id, sequence, finding) of logs (campaign_id, sequence, cell_id, new_state, reason, cost,
    artifact_id, previous_event_hash, event_hash): gaps, links that do not meet the event before, and hashes
    that do not fit their event. Every hash is recomputed, each by itself, so logs of any length are
    replayed in parallel."""
    before = events.select("campaign_id", (F.col("sequence") + 1).alias("sequence"), F.col("event_hash").alias("hash_before"))
    met = events.join(before, ["campaign_id", "sequence"], "left")
    first = F.col("sequence") == 0
    own = event_hash(F.col("previous_event_hash"), F.col("sequence"), F.col("cell_id"), F.col("new_state"), F.col("reason"), F.col("cost"), F.col("artifact_id"))
    findings = F.array(
        F.when(~first & F.col("hash_before").isNull(), "gap"), F.when(F.col("previous_event_hash") != F.when(first, F.lit(GENESIS)).otherwise(F.coalesce("hash_before", F.col("previous_event_hash"))), "chain-drift"),
        F.when(F.col("event_hash") != own, "hash-drift"),
    )
    return met.select("campaign_id", "sequence", F.explode(F.array_compact(findings)).alias("finding"))


def current_states(events: DataFrame) -> DataFrame:
    """Last state, total cost and number of events of each cell. Costs are added as decimals, so that a total
    does not depend on their order; totals with a cost that no decimal holds are sums of doubles."""
    total = F.sum("cost")
    if dict(events.dtypes)["cost"] in ("double", "float"):
        exact = F.col("cost").try_cast("decimal(38,12)")
        total = F.coalesce(F.when(F.count(exact) == F.count("cost"), F.try_sum(exact)).cast("double"), total)
    return events.groupBy("cell_id").agg(F.max_by("new_state", "sequence").alias("state"), total.alias("cost"), F.count("*").alias("events"))


def campaign_status(cells: DataFrame, events: DataFrame, hard_budget: float) -> DataFrame:
    """Cells by state with spent, reserved and remaining budget (same on each row)."""
    now = cells.join(current_states(events), "cell_id", "left").withColumn("state", F.coalesce("state", F.lit("ready")))
    by = now.groupBy("state").agg(F.count("*").alias("n"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("spent"), F.coalesce(F.sum("estimated_cost"), F.lit(0.0)).alias("estimated"))
    every = Window.partitionBy()
    spent, reserved = F.sum("spent").over(every), F.coalesce(F.sum(F.when(F.col("state") == "leased", F.col("estimated"))).over(every), F.lit(0.0))
    return by.select("state", "n", "spent", spent.alias("total_spent"), reserved.alias("reserved"), (hard_budget - spent - reserved).alias("remaining"))


def reconcile(stored: DataFrame, replayed: DataFrame) -> DataFrame:
    """Cells whose stored and replayed state or cost differ, or that one side lacks."""
    a = stored.select("cell_id", F.col("state").alias("stored_state"), F.col("cost").alias("stored_cost"))
    b = replayed.select("cell_id", F.col("state").alias("replayed_state"), F.col("cost").alias("replayed_cost"))
    both = a.join(b, "cell_id", "full_outer")
    kind = (
        F.when(F.col("replayed_state").isNull(), "missing-in-log").when(F.col("stored_state").isNull(), "missing-in-store")
        .when(F.col("stored_state") != F.col("replayed_state"), "state-drift").when(F.abs(F.col("stored_cost") - F.col("replayed_cost")) > TOLERANCE, "cost-drift")
    )
    return both.withColumn("finding", kind).where("finding is not null")


def expired_leases(leases: DataFrame, now: Column) -> DataFrame:
    """Leases that end at or before ``now``, as events back to ready."""
    return leases.where((F.col("state") == "leased") & (F.col("expires_at") <= now)).select("cell_id", F.lit("ready").alias("new_state"), F.lit("lease-expired").alias("reason"), "expires_at")


def lease(cells: DataFrame, limit: int, per_model: int, budget: float, held: DataFrame | None = None, spent: float = 0.0, batch: int = 5000) -> DataFrame:
    """Ready cells to lease: in order of stage, model, task and replicate, skipping those whose model is
    at its cap or whose cost no longer fits what is left of the budget. Leases already ``held``
    (model_id, estimated_cost) count towards caps and reserve their cost; ``spent`` is gone. The result
    has each cell's cost and the cost reserved with it, held leases included.

    Skipping makes each choice depend on those before. The driver goes through the candidates in order,
    at most ``batch`` at a time; each time Spark only looks for cells beyond the last one whose model has
    room and whose cost fits, so at least one of a batch is taken, and at most ``limit`` in all."""
    spark = cells.sparkSession
    place = ("stage_id", "model_id", "task_id", "replicate")
    active, reserved = {}, 0.0
    if held is not None:
        for row in held.groupBy("model_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("estimated_cost"), F.lit(0.0)).alias("cost")).collect():  # one row a model
            active[row["model_id"]] = row["n"]
            reserved += row["cost"]
    order = F.struct(*place)
    ready = cells.where("state = 'ready' and estimated_cost is not null").select(*place, "cell_id", "estimated_cost")
    taken, last = [], None
    while len(taken) < limit:
        full = [m for m, n in active.items() if n >= per_model]
        left = ready.where(F.lit(spent + reserved) + F.col("estimated_cost") <= budget)
        left = left.where(~F.col("model_id").isin(full)) if full else left
        left = left.where(order > F.struct(*[F.lit(v) for v in last])) if last else left
        rows = left.orderBy(*place).limit(batch).collect()
        for row in rows:
            last = tuple(row[c] for c in place)
            if active.get(row["model_id"], 0) < per_model and spent + reserved + row["estimated_cost"] <= budget:
                active[row["model_id"]] = active.get(row["model_id"], 0) + 1
                reserved += row["estimated_cost"]
                taken.append((row["cell_id"], row["model_id"], row["estimated_cost"], reserved))
            if len(taken) == limit:
                break
        if len(rows) < batch:
            break
    return spark.createDataFrame(taken, "cell_id string, model_id string, estimated_cost double, reserved_cost double")


def reconcile_executions(events: DataFrame, records: DataFrame) -> DataFrame:
    """Findings about execution records against the terminal events of the log, both by cell_id,
    lease_token and attempt: keys that repeat, one side without the other, fields that differ, costs
    that are unknown or differ. Columns of events: campaign_id, worker_id, new_state, reason,
    artifact_id, actual_cost; of records: campaign_id, worker_id, terminal_state, terminal_reason,
    artifact_id, charged_cost. Of a key that repeats the least row of either side is compared."""
    key = ["cell_id", "lease_token", "attempt"]
    pairs = {"campaign_id": "campaign_id", "worker_id": "worker_id", "terminal_state": "new_state", "terminal_reason": "reason", "artifact_id": "artifact_id"}
    ended = events.where(F.col("new_state").isin("succeeded", "failed", "quarantined") & F.col("worker_id").isNotNull())
    nameless = ended.where("lease_token is null").select(*key, F.lit("event-without-token").alias("finding"))

    def one(rows: DataFrame, columns: list[str], to: str) -> DataFrame:
        found = rows.where("lease_token is not null").groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct(*columns)).alias("row"))
        return found.select(*key, F.col("n").alias(f"{to}_n"), F.col("row").alias(to))

    both = one(ended, [*pairs.values(), "actual_cost"], "e").join(one(records, [*pairs, "charged_cost"], "r"), key, "full_outer")
    matched = F.col("e_n").isNotNull() & F.col("r_n").isNotNull()
    cost = F.when(F.col("r.charged_cost").isNull(), "invalid-cost").when(F.abs(F.col("r.charged_cost") - F.col("e.actual_cost")) > TOLERANCE, "cost-mismatch")
    findings = F.array(
        F.when(F.col("e_n") > 1, "duplicate-event"), F.when(F.col("r_n") > 1, "duplicate-record"),
        F.when(F.col("e_n").isNull(), "record-without-event"), F.when(F.col("r_n").isNull(), "event-without-record"),
        *[F.when(matched & ~F.col(f"r.{mine}").eqNullSafe(F.col(f"e.{theirs}")), f"field-mismatch:{mine}") for mine, theirs in pairs.items()], F.when(matched, cost),
    )
    return both.select(*key, F.explode(F.array_compact(findings)).alias("finding")).union(nameless)


def terminal_outcome(safe: Column, nonblank: Column, eligible: Column, error: Column) -> Column:
    """How an execution ends: failed on an error, quarantined if a retention gate fails."""
    gates = F.coalesce(safe, F.lit(False)) & F.coalesce(nonblank, F.lit(False)) & F.coalesce(eligible, F.lit(False))
    return F.when(error.isNotNull(), "failed").when(~gates, "quarantined").otherwise("succeeded")
