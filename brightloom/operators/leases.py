"""The protocol of leases: what requests of workers do to a cell, one after another.

Requests: cell_id, at, request_id, action (lease, heartbeat, complete), worker_id, lease_token, new_state and
artifact_id. A lease is granted on a ready cell, or one whose lease has run out. Heartbeats and completions need the worker and the token that the cell was leased with, before
the lease runs out. ``decide`` is the rule for one request; ``replay`` folds it over a table, and
``streaming.leases.lease_protocol`` keeps it as state of a stream.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.operators.ordered import folded

# States that a lease may end in, and those that can be leased.
ENDINGS = ("ready", "succeeded", "failed", "quarantined", "cancelled")
LEASABLE = "ready"
OUTPUT = "cell_id string, request_id long, at timestamp, action string, outcome string, state string, expires timestamp, attempt long"


class Cell(NamedTuple):
    """What is known of a cell; times are microseconds."""

    state: str = LEASABLE
    owner: str | None = None
    token: str | None = None
    expires: int | None = 0
    attempt: int = 0


def decide(cell: Cell, action: str | None, at: int | None, worker: str | None, token: str | None, new_state: str | None, artifact: str | None, horizon: int) -> tuple[Cell, str]:
    """The cell after a request, and its outcome: granted, extended, completed or what it was refused for. A
    request without a time meets no end of a lease, and a lease that it is granted has none."""
    if not (worker or "").strip() or not token:
        return cell, "refused:worker-and-token-required"
    over = at is not None and cell.expires is not None and at >= cell.expires
    if action == "lease":
        if cell.state != LEASABLE and not (cell.state == "leased" and over):
            return cell, f"refused:{cell.state}"
        return Cell("leased", worker, token, None if at is None else at + horizon, cell.attempt + 1), "granted"
    if action not in ("heartbeat", "complete"):
        return cell, "refused:unknown-action"
    if cell.state != "leased":
        return cell, "refused:not-leased"
    if (cell.owner, cell.token) != (worker, token):
        return cell, "refused:not-the-owner"
    if over:
        return cell, "refused:expired"
    if action == "heartbeat":  # from its own time on, never shorter
        return cell._replace(expires=max((x for x in (cell.expires, None if at is None else at + horizon) if x is not None), default=None)), "extended"
    if new_state not in ENDINGS:
        return cell, "refused:unknown-ending"
    if new_state == "succeeded" and not artifact:
        return cell, "refused:no-artifact"
    return cell._replace(state=new_state, owner=None, token=None), "completed"


def replay(requests: DataFrame, lease_seconds: int = 900) -> DataFrame:
    """The outcome of each request, with the cell's state, the end of its lease (null if it has none) and its
    attempts after it. A cell's requests are put in order of at and request_id, and ``decide`` is folded over them,
    one after another."""
    horizon = lease_seconds * 1_000_000

    def step(cell: Cell, action: str | None, at: int | None, worker: str | None, token: str | None, new_state: str | None, artifact: str | None) -> tuple[Cell, tuple]:
        cell, outcome = decide(cell, action, at, worker, token, new_state, artifact, horizon)
        return cell, (outcome, cell.state, cell.expires if cell.state == "leased" else None, cell.attempt)

    stated = ["action", "worker_id", "lease_token", "new_state", "artifact_id"]
    timed = requests.select("cell_id", F.col("at").cast("timestamp").alias("at"), F.col("request_id").cast("long").alias("request_id"), *[F.col(c).cast("string").alias(c) for c in stated])
    reads = [F.col("action"), F.unix_micros("at"), *[F.col(c) for c in stated[1:]]]
    told = folded(timed, ["cell_id"], ["at", "request_id", *stated], ["cell_id", "request_id", "at", "action"], reads, Cell, step, "outcome string, state string, expires long, attempt long")
    return told.withColumn("expires", F.timestamp_micros("expires"))
