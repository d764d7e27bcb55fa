import datetime

from brightloom.streaming.leases import lease_states, windowed_counts


def test_lease_expires_with_the_watermark(spark, tmp_path):
    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    batches = [[("a", "leased", t(0)), ("b", "leased", t(1))], [("b", "succeeded", t(3)), ("c", "leased", t(40))], [("c", "succeeded", t(41))]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "cell_id string, new_state string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("cell_id string, new_state string, at timestamp").parquet(str(tmp_path / "in"))
        q = lease_states(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {(r["cell_id"], r["new_state"], r["reason"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert ("a", "ready", "lease-expired") in got and ("b", "succeeded", "event") in got and ("b", "ready", "lease-expired") not in got and ("c", "succeeded", "event") in got


def test_windowed_counts_in_batch(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert windowed_counts(ev).agg({"n": "sum"}).first()[0] == ev.count()
