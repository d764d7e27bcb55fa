"""Texts of several megabytes, URLs of many labels, ids below zero, texts of many short lines."""

import datetime
import time

import numpy as np
from pyspark.sql import functions as F

from brightloom.llm import fingerprint, mixing, pii, quality, urlfilter, warc


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_urls_of_many_labels_and_segments(spark):
    d = datetime.date
    log = spark.createDataFrame([(k, "add", d(2024, 1, 1)) for k in ("ex.org", "www.ex.org", "org", "a.b/p/q", "single")], "list_key string, action string, day date")
    urls = ["http://" + "l." * 40000 + "www.ex.org/" + "s/" * 20000, "http://org/", "http://x.org", "http://a.b/p//q/r", "http://single/p", "http://ex.org"]
    caps = spark.createDataFrame([(k, u, d(2024, 1, 2)) for k, u in enumerate(urls)], "page_id long, url string, fetched_on date")
    urlfilter.judge(caps.where("page_id > 0"), log).collect()
    began = time.time()
    got = {r["page_id"]: (r["n_active"], r["listed_key"]) for r in rows(urlfilter.judge(caps, log))}
    assert time.time() - began < 10
    assert got == {0: (2, "www.ex.org"), 1: (1, "org"), 2: (0, None), 3: (1, "a.b/p/q"), 4: (1, "single"), 5: (1, "ex.org")}


def test_audit_of_ids_below_zero(spark):
    a = spark.createDataFrame([(i, f"p{i}") for i in range(-200, 200)] + [(None, "nameless")], "record_id long, payload string")
    got = {(r["record_id"], r["named"]): r for r in rows(warc.audit(a, a.where("record_id is null or record_id not in (-5, -1, 70)")))}
    assert set(got) == {(-5, True), (-1, True), (70, True)} and all(r["kind"] == "missing" for r in got.values())
    before = lambda k: len("nameless") + sum(len(f"p{i}") for i in range(-200, k))
    assert all(got[k, True]["rec_offset"] == before(k) for k in (-5, -1, 70))
    assert [(r["record_id"], r["named"], r["rec_offset"]) for r in rows(warc.audit(a, a.where("record_id is not null")))] == [(-1, False, 0)]


def test_texts_of_megabytes(spark, make_docs):
    long = "word a.b@c.org 4111 1111 1111 1111 " * 100000  # 3.5 MB
    docs = make_docs([(1, long, "a"), (2, "short text", "a"), (3, long[:-5] + "other", "b")])
    size = {r["doc_id"]: r["size"] for r in rows(mixing.mix(docs))}
    assert size == {1: 600000, 2: 2, 3: 600000}
    got = {r["doc_id"]: r for r in rows(fingerprint.compare(docs))}
    assert got[1]["n_chars"] == len(long) and got[3]["near_edited"] < 1.01
    assert {r["doc_id"]: (r["n_email"], r["n_card"]) for r in rows(pii.find(docs))} == {1: (100000, 100000), 2: (0, 0), 3: (100000, 99999)}
    records = docs.select(F.col("doc_id").alias("record_id"), F.col("text").alias("payload"))
    assert [(r["record_id"], r["kind"]) for r in rows(warc.audit(records, records.withColumn("payload", F.when(F.col("record_id") == 1, F.lit(long[1:])).otherwise(F.col("payload")))))] == [(1, "corrupt")]


def line_by_line(scores, rows_, pairs):
    a = np.exp(pairs - pairs.max())
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    ahead, behind = np.array(scores, float), np.zeros(len(scores))
    for low, high in zip(rows_[:-1], rows_[1:], strict=True):
        for i in range(low + 1, high):
            p = sigmoid(ahead[i - 1])
            ahead[i] = scores[i] + np.log((p * a[1, 1] + (1 - p) * a[0, 1]) / (p * a[1, 0] + (1 - p) * a[0, 0]))
        for i in range(high - 2, low - 1, -1):
            q = sigmoid(scores[i + 1] + behind[i + 1])
            behind[i] = np.log((q * a[1, 1] + (1 - q) * a[1, 0]) / (q * a[0, 1] + (1 - q) * a[0, 0]))
    return ahead, behind, sigmoid(ahead + behind)


def test_forward_backward_equals_line_by_line():
    rng = np.random.default_rng(4)
    for n in (1, 2, 31, 32, 33, 500, 3000):
        for _ in range(5):
            scores, pairs = rng.normal(0, 3, n), rng.normal(0, 1.5, (2, 2))
            rows_ = np.concatenate(([0], np.sort(rng.integers(0, n + 1, int(rng.integers(0, n // 2 + 1)))), [n]))
            for got, want in zip(quality.forward_backward(scores, rows_, pairs), line_by_line(scores, rows_, pairs), strict=True):
                assert np.abs(got - want).max() < 1e-9


def test_a_text_of_a_million_lines():
    text, at = np.full(1 << 20, 10, np.uint8), np.array([0, 1 << 20])
    model = quality.Model(np.full(51, 0.01), np.array([[0.5, 0.0], [0.0, 0.5]]), np.array([0.0, 1.0]))
    began = time.time()
    assert 0 < model.scores(quality.lines(text, at))[0] < 1 and time.time() - began < 10


def test_training_lines_are_bounded(spark):
    texts = spark.createDataFrame([(i, "\n" * 1000) for i in range(200)], "doc_id long, text string")
    kept = quality.within_bytes(texts, 2_000_000, [], quality.LINE_BYTES).count()
    assert 5 < kept < 50 and quality.within_bytes(texts, 2_000_000, []).count() == 200


def test_fingerprints_shuffle_their_texts_once(spark, make_docs):
    found = fingerprint.compare(make_docs([(i, f"some words of text {i}", "a") for i in range(50)]))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert any("range#" in line and "guest#" in line for line in plan.splitlines() if "ReusedExchange" in line)


def test_fingerprints_without_the_bound_are_the_same(spark, make_docs, monkeypatch):
    docs = make_docs([(i, " ".join(f"w{(i * k) % 91}" for k in range(1, 150)), "a") for i in range(30)] + [(50, "", "a"), (51, "one", "a")])
    pruned = sorted(map(str, rows(fingerprint.compare(docs))))
    monkeypatch.setattr(fingerprint, "BEYOND", 1e250)
    assert sorted(map(str, rows(fingerprint.compare(docs)))) == pruned
