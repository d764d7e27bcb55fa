"""Leases over an event stream: state by cell, with expiry by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from brightloom.operators import leases

OUTPUT = "cell_id string, new_state string, reason string, at timestamp"
STATE = "state string, expires bigint"


def lease_states(events: DataFrame, lease_seconds: int = 300, delay: str = "10 minutes") -> DataFrame:
    """State changes of each cell from a stream of (cell_id, new_state, at). A lease ends when the
    watermark passes its end: the cell goes back to ready, as ``ledger.expired_leases`` finds in batch.
    A lease event on a leased cell is a heartbeat and moves the end, never back."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        now, expires = state.get if state.exists else ("ready", 0)
        if state.hasTimedOut:
            if now == "leased":
                out.append((key[0], "ready", "lease-expired", pd.Timestamp(expires, unit="ms")))
            state.remove()
        else:
            for row in pd.concat(list(frames)).sort_values("at").itertuples(index=False):
                at = int(row.at.timestamp() * 1000)
                if now == "leased" and at >= expires:
                    out.append((key[0], "ready", "lease-expired", pd.Timestamp(expires, unit="ms")))
                    now = "ready"
                if row.new_state == "leased":
                    expires = max(expires, at + lease_seconds * 1000) if now == "leased" else at + lease_seconds * 1000
                if row.new_state != now:
                    out.append((key[0], row.new_state, "event", row.at))
                now = row.new_state
            state.update((now, expires))
            if now == "leased":
                state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["cell_id", "new_state", "reason", "at"])

    timed = events.withWatermark("at", delay)
    return timed.groupBy("cell_id").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CELL = "state string, owner string, token string, expires bigint, attempt bigint"


class LeaseProtocol(StatefulProcessor):
    """A cell's lease as value state, with a timer at its end."""

    def __init__(self, lease_seconds: int):
        self.horizon = lease_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.cell = handle, handle.getValueState("cell", CELL)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        self.cell.update((row["state"], row["owner"], row["token"], int(row["expires"].value // 1000), int(row["attempt"])))

    def _kept(self, cell: leases.Cell) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if cell.state == "leased":
            self.handle.registerTimer(-(-cell.expires // 1000))
        self.cell.update(tuple(cell))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cell, out = leases.Cell(*self.cell.get()) if self.cell.exists() else leases.Cell(), []
        for r in pd.concat(list(rows)).sort_values(["at", "request_id"]).itertuples(index=False):
            text = [None if pd.isna(x) else x for x in (r.action, r.worker_id, r.lease_token, r.new_state, r.artifact_id)]
            cell, outcome = leases.decide(cell, text[0], r.at.value // 1000, *text[1:], self.horizon)
            out.append((key[0], int(r.request_id), r.at, text[0], outcome, cell.state, pd.Timestamp(cell.expires, unit="us") if cell.state == "leased" else pd.NaT, cell.attempt))
        self._kept(cell)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cell = leases.Cell(*self.cell.get())
        if cell.state == "leased" and cell.expires <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            ended = cell._replace(state=leases.LEASABLE, owner=None, token=None)
            self.cell.update(tuple(ended))
            yield pd.DataFrame([(key[0], None, pd.Timestamp(cell.expires, unit="us"), "expire", "lease-expired", ended.state, pd.NaT, ended.attempt)], columns=_COLUMNS)

    def close(self) -> None:
        pass


_COLUMNS = [part.split()[0] for part in leases.OUTPUT.split(", ")]


def lease_protocol(requests: DataFrame, lease_seconds: int = 900, delay: str = "10 minutes", cells: DataFrame | None = None) -> DataFrame:
    """The outcomes of a stream of requests (``operators.leases``), as they come, and one row for each lease
    that the watermark has passed. ``cells`` (cell_id, state, owner, token, expires, attempt) is what is known
    before the stream begins. Requests later than ``delay`` are dropped by the watermark, as in any
    event-time stream. The session's state store must be RocksDB (``ROCKSDB``)."""
    timed = requests.withWatermark("at", delay).groupBy("cell_id")
    known = cells.groupBy("cell_id") if cells is not None else None
    return timed.transformWithStateInPandas(LeaseProtocol(lease_seconds), leases.OUTPUT, "append", "eventTime", known)


def windowed_counts(events: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events by window and type, with late events up to ``delay``."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
