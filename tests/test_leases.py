"""The protocol of leases: rule, replay and stream agree."""

import datetime
import random

import pytest

from brightloom.operators import leases
from brightloom.streaming.leases import ROCKSDB, lease_protocol

SCHEMA = "cell_id string, at timestamp, request_id long, action string, worker_id string, lease_token string, new_state string, artifact_id string"
START = datetime.datetime(2024, 1, 1)


def at(minute):
    return START + datetime.timedelta(minutes=minute)


def story(cell, *steps):
    return [(cell, at(m), k, *rest) for k, (m, *rest) in enumerate(steps)]


def outcomes(df):
    return {(r["cell_id"], r["request_id"]): (r["outcome"], r["state"], r["attempt"]) for r in df.collect() if r["request_id"] is not None}


CASES = [
    *story("plain", (0, "lease", "w", "t1", None, None), (3, "heartbeat", "w", "t1", None, None), (12, "complete", "w", "t1", "succeeded", "art"), (13, "lease", "v", "t2", None, None)),
    *story("foreign", (0, "lease", "w", "t1", None, None), (1, "lease", "v", "t2", None, None), (2, "heartbeat", "v", "t1", None, None), (2, "complete", "w", "t9", "failed", None), (4, "complete", "w", "t1", "succeeded", None), (5, "complete", "w", "t1", "gone", None), (6, "complete", "w", "t1", "ready", None), (7, "lease", "v", "t2", None, None)),
    *story("late", (0, "lease", "w", "t1", None, None), (10, "heartbeat", "w", "t1", None, None), (11, "complete", "w", "t1", "failed", None), (12, "lease", "v", "t2", None, None), (13, "complete", "w", "t1", "failed", None), (14, "complete", "v", "t2", "failed", None), (15, "lease", "v", "t3", None, None)),
    *story("odd", (0, "lease", " ", "t", None, None), (0, "lease", "w", None, None, None), (1, "heartbeat", "w", "t", None, None), (2, "steal", "w", "t", None, None), (3, None, "w", "t", None, None)),
]
WANT = {
    "plain": ["granted", "extended", "completed", "refused:succeeded"],
    "foreign": ["granted", "refused:leased", "refused:not-the-owner", "refused:not-the-owner", "refused:no-artifact", "refused:unknown-ending", "completed", "granted"],
    "late": ["granted", "refused:expired", "refused:expired", "granted", "refused:not-the-owner", "completed", "refused:failed"],
    "odd": ["refused:worker-and-token-required", "refused:worker-and-token-required", "refused:not-leased", "refused:unknown-action", "refused:unknown-action"],
}


def test_replay_of_stories(spark):
    got = outcomes(leases.replay(spark.createDataFrame(CASES, SCHEMA), 600))
    assert {c: [got[c, k][0] for k in range(len(w))] for c, w in WANT.items()} == WANT
    assert got["foreign", 7][2] == 2 and got["late", 3] == ("granted", "leased", 2)


def test_replay_equals_the_rule(spark):
    rng = random.Random(3)
    data = []
    for k in range(600):
        data.append((f"c{rng.randrange(9)}", at(rng.randrange(240)), k, rng.choice(["lease", "lease", "heartbeat", "complete", "other"]), rng.choice(["w", "v", None]), rng.choice(["t1", "t2", ""]), rng.choice([*leases.ENDINGS, None]), rng.choice(["a", None])))
    cells, want = {}, {}
    for cell, when, k, action, worker, token, new_state, artifact in sorted(data, key=lambda r: (r[1], r[2])):
        micros = int((when - datetime.datetime(1970, 1, 1)).total_seconds() * 1e6)
        cells[cell], outcome = leases.decide(cells.get(cell, leases.Cell()), action, micros, worker, token, new_state, artifact, 600 * 10**6)
        want[cell, k] = (outcome, cells[cell].state, cells[cell].attempt)
    assert outcomes(leases.replay(spark.createDataFrame(data, SCHEMA), 600)) == want and len({o for o, _, _ in want.values()}) > 8
    assert leases.replay(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    yield
    spark.conf.set(key, before)


def test_stream_equals_replay(spark, tmp_path, rocksdb):
    data = [r for r in CASES] + story("held", (2, "heartbeat", "w", "t0", None, None), (3, "complete", "w", "t0", "succeeded", "x")) + story("clock", (60, "lease", "w", "t", None, None))
    known = spark.createDataFrame([("held", "leased", "w", "t0", at(8), 4)], "cell_id string, state string, owner string, token string, expires timestamp, attempt long")
    for low, high in ((0, 5), (5, 14), (14, 61)):
        part = [r for r in data if at(low) <= r[1] < at(high)]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        query = lease_protocol(stream, 600, "1 minute", known).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination(180)
    out = spark.read.parquet(str(tmp_path / "out"))
    got = outcomes(out)
    assert {c: [got[c, k][0] for k in range(len(w))] for c, w in WANT.items()} == WANT
    assert got["held", 0] == ("extended", "leased", 4) and got["held", 1] == ("completed", "succeeded", 4)
    ended = {(r["cell_id"], r["at"]) for r in out.where("action = 'expire'").collect()}
    assert ("foreign", at(17)) in ended and not any(c in ("plain", "held", "clock") for c, _ in ended)


def test_replay_of_a_long_cell_holds_one_state(spark):
    rng = random.Random(5)
    data = [("long", at(k / 7) if k % 101 else None, k, rng.choice(["lease", "heartbeat", "complete"]), rng.choice(["w", "w", "v", "\t"]), "t", rng.choice(["ready", "ready", "failed", None]), None) for k in range(20_000)]
    data += [(None, at(1), -1, "lease", "w", "t", None, None), (None, at(2), -2, "heartbeat", "w", "t", None, None)]
    cells, want = {}, {}
    for cell, when, k, action, *rest in sorted(data, key=lambda r: (r[1] or START - datetime.timedelta(days=1), r[2])):
        micros = when and int((when - datetime.datetime(1970, 1, 1)).total_seconds() * 1e6)
        cells[cell], outcome = leases.decide(cells.get(cell, leases.Cell()), action, micros, *rest, 600 * 10**6)
        want[cell, k] = (outcome, cells[cell].state, cells[cell].attempt)
    out = leases.replay(spark.createDataFrame(data, SCHEMA), 600)
    assert outcomes(out) == {k: v for k, v in want.items()} and want[None, -2][0] == "extended"
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
