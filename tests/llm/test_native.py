"""Operators in Spark SQL: mixing, fixity, fingerprints, URL filters, personal data."""

import datetime
import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brightloom.llm import common, fingerprint, mixing, pii, urlfilter, warc


def rows(df):
    return [r.asDict() for r in df.collect()]


def water_fill(sizes, weights, share):
    target, full = {}, set()
    left = share * sum(sizes.values())
    while True:
        rest = [s for s in sizes if s not in full]
        total = sum(weights[s] for s in rest)
        level = {s: (left - sum(2 * sizes[f] for f in full)) * weights[s] / total for s in rest}
        over = {s for s in rest if level[s] > 2 * sizes[s]}
        if not over:
            target.update({s: 2.0 * sizes[s] for s in full} | level)
            return target
        full |= over


def test_mix_targets_and_words(spark, make_docs):
    data = [(i, " ".join(["w"] * (1 + i % 40)), ["a", "b", "c", "d", None][0 if i % 3 else i % 5]) for i in range(400)]
    got = rows(mixing.mix(make_docs(data), block_words=64))
    sizes = Counter()
    for _, t, s in data:
        sizes[s] += len(t.split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = water_fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5)
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    assert got and sorted(map(str, got)) == sorted(map(str, rows(mixing.mix(make_docs(data[::-1]), block_words=64))))


def test_mix_places_repeated_rows_one_after_another(spark, make_docs):
    data = [(7, "w " * 10, "a")] * 40 + [(None, "w " * 10, "b")] * 40
    taken = Counter()
    got = rows(mixing.mix(make_docs(data), share=0.5, block_words=8))
    for r in got:
        taken[r["source"]] += r["taken"]
    want = water_fill({"a": 400, "b": 400}, {"a": 3, "b": 1}, 0.5)
    assert len(got) == 80 and all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_mix_odd_and_empty(spark, odd_docs):
    got = rows(mixing.mix(odd_docs))
    assert len(got) == 10 and sum(r["size"] == 0 for r in got) == 3
    assert rows(mixing.mix(odd_docs.limit(0))) == []
    kept = rows(mixing.mixed_documents(odd_docs))
    assert all(r["taken"] > 0 for r in kept) and {r["extra"] for r in kept} == {"x"}


def test_schedule_is_even_and_complete(spark):
    sources = spark.createDataFrame([(0, 700), (1, 10), (2, 290)], "sidx long, words long")
    got = rows(mixing.schedule(sources, 1, 1000, 3))
    assert Counter(r["sidx"] for r in got) == {0: 700, 1: 10, 2: 290} and len({r["slot"] for r in got}) == 1000
    assert {(r["sidx"], r["block"]) for r in got} == {(s, b) for s, n in ((0, 700), (1, 10), (2, 290)) for b in range(n)}
    first = [r["sidx"] for r in sorted(got, key=lambda r: r["slot"])][:200]
    assert 120 <= first.count(0) <= 160


def test_blocks_grow_with_the_corpus():
    for words in (0, 10**6, 10**13, 3 * 10**16, 10**18):
        size = mixing.block_size(words, 5)
        assert words // size + 5 <= 1 << 30 and (size == 4096 or words // (size // 2) + 5 > 1 << 30)


def test_mixed_documents_keep_their_own_columns(spark, make_docs):
    docs = make_docs([(i % 3, f"w{i} w w", "a") for i in range(9)]).selectExpr("*", "'mine' as size", "doc_id * 10 as nth", "'t' as taken", "doc_id as `a.b`", "3 as _nth")
    got = rows(mixing.mixed_documents(docs, share=2.0))
    assert len(got) == 9 and {r["text"] for r in got} == {f"w{i} w w" for i in range(9)}
    assert all(r["size"] == "mine" and r["nth"] == 10 * r["doc_id"] and r["taken"] == "t" and r["a.b"] == r["doc_id"] and (r["size_"], r["taken_"]) == (3, 6) for r in got)


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Unset:
        conf, sparkContext = type("c", (), {"get": lambda self, key, default: default})(), type("s", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_dir(Unset())
    paths = []
    table = common.materialise(spark.range(5), paths)
    assert table.count() == 5 and len(paths) == 1
    kept = paths[0]
    common.discard(spark, paths)
    with pytest.raises(Exception, match="(?i)not.exist|PATH_NOT_FOUND"):
        spark.read.parquet(kept).count()


def test_audit_of_records_without_ids_and_payloads(spark):
    a = spark.createDataFrame([(None, f"p{i}", "x") for i in range(300)] + [(3, None, "y"), (4, "", "y")], "record_id long, payload string, hash string")
    assert rows(warc.audit(a, a)) == []
    got = rows(warc.audit(a, a.where("payload is null or payload <> 'p7'").withColumn("payload", F.coalesce("payload", F.lit("")))))
    assert [(r["record_id"], r["kind"], r["rec_length"]) for r in got] == [(-1, "missing", 2)]


def test_audit_finds_every_kind_of_damage(spark):
    data = [(i, f"payload {i}" * (1 + i % 3)) for i in range(5000)]
    a = spark.createDataFrame(data, "record_id long, payload string")
    b = a.where("record_id not in (17, 4000)").withColumn("payload", F.when(F.col("record_id") == 3333, "changed").otherwise(F.col("payload"))).union(spark.createDataFrame([(6001, "new"), (None, "no id")], a.schema))
    got = {r["record_id"]: r for r in rows(warc.audit(a, b))}
    assert {k: r["kind"] for k, r in got.items()} == {17: "missing", 4000: "missing", 3333: "corrupt", 6001: "extra", -1: "extra"}
    assert got[3333]["rec_offset"] == sum(len(p) for i, p in data if i < 3333) and got[3333]["rec_length"] == len(data[3333][1])
    assert rows(warc.audit(a, a)) == [] and len(rows(warc.audit(a.limit(0), a.limit(3)))) == 3 and rows(warc.audit(a.limit(0), a.limit(0))) == []
    twice = a.limit(2).union(a.limit(2))
    assert [r["kind"] for r in rows(warc.audit(twice, a.limit(2)))] == ["missing", "missing"]


def test_fingerprint_estimates_generalised_jaccard(spark, make_docs):
    data = [(i, " ".join(f"w{(i * 7 + k * (1 + i % 3)) % 60}" for k in range(80 + i)), "s") for i in range(24)] + [(100, "same text", "s"), (101, "same text", "s"), (102, "", "s"), (103, None, "s")]
    got = {r["doc_id"]: r for r in rows(fingerprint.compare(make_docs(data)))}
    texts = {i: t or "" for i, t, _ in data}
    ids = sorted(texts, reverse=True)

    def jaccard(a, b):
        x, y = (Counter(re.findall(r"\w+", t)) for t in (a, b))
        return sum((x & y).values()) / max(1, sum((x | y).values()))

    errors = []
    for k, i in enumerate(ids):
        t, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        if t and after:
            errors += [got[i]["near_edited"] - jaccard(t, edited), got[i]["near_next"] - jaccard(t, after)]
    assert abs(sum(errors) / len(errors)) < 0.05 and max(map(abs, errors)) < 0.3
    assert got[101]["fingerprint"] == got[100]["fingerprint"] and got[101]["near_next"] == 1 and got[103]["fingerprint"] == "" and got[103]["near_next"] == 1


def test_fingerprint_of_long_texts_with_many_words(spark):
    """Two texts of 20,000 words: 100 shared words 100 times each, and 10,000 words of their own."""
    shared = spark.range(2 * 100).select((F.col("id") % 2).alias("doc"), F.xxhash64(F.floor(F.col("id") / 2)).alias("term"), F.lit(100).alias("n"))
    own = spark.range(2 * 10000).select((F.col("id") % 2).alias("doc"), F.xxhash64(F.col("id") + 1000).alias("term"), F.lit(1).alias("n"))
    a, b = (r["s"] for r in rows(fingerprint.signatures(shared.union(own), ["doc"], {"s": "n"}, 1024)))
    assert sum(x == y for x, y in zip(a, b)) / 1024 == pytest.approx(1 / 3, abs=0.06)


def test_fingerprint_odd_and_empty(spark, odd_docs):
    got = rows(fingerprint.compare(odd_docs))
    assert len(got) == 10 and all(0 <= r["near_edited"] <= 1 for r in got)
    assert rows(fingerprint.compare(odd_docs.limit(0))) == []
    (single,) = rows(fingerprint.compare(odd_docs.where("doc_id = 6")))
    assert single["near_next"] == 1


def test_fingerprint_successors_across_ranges(spark, make_docs):
    n = fingerprint.ROWS * 3
    data = [(i * 3, f"t{i}", "s") for i in range(n)]
    got = {r["doc_id"]: r["edited_sha256"] for r in rows(fingerprint.compare(make_docs(data), 4))}
    for i in range(n):
        t, after = data[i][1], data[i - 1][1]
        assert got[i * 3] == hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()


def test_fingerprint_successors_without_ids_and_beyond_double_precision(spark, make_docs, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS", 8)
    top = 1 << 60
    data = [(top + i, f"big {i} text", "s") for i in range(40)] + [(i * 1000, f"small {i}", "s") for i in range(40)] + [(None, f"none {i} more", "s") for i in range(60)]
    docs = make_docs(data)
    hashes = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(data, key=lambda d: (d[0] is not None, d[0] or 0, hashes[d[1]]), reverse=True)
    want = Counter()
    for k, (i, t, _) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        want[i, hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    got = rows(fingerprint.compare(docs, 4))
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want


def test_fingerprint_of_scripts_without_blanks(spark, make_docs):
    (a, b) = rows(fingerprint.compare(make_docs([(1, "我们今天去学校学习语言和数学", "s"), (2, "我们今天去学校学习语言和历史", "s")])))
    assert a["near_next"] > 0.5


def test_url_filter_long_urls_and_extra_columns(spark):
    d = datetime.date
    log = spark.createDataFrame([("ex.org/a", "add", d(2024, 1, 1))], "list_key string, action string, day date")
    caps = spark.createDataFrame([(1, "http://ex.org/a/" + "x/" * 20000, d(2024, 1, 2), "c"), (2, "http://" + "l." * 300 + "ex.org/a?" + "q" * 50000, d(2024, 1, 2), "c")], "page_id long, url string, fetched_on date, host string")
    got = {r["page_id"]: r for r in rows(urlfilter.judge(caps, log))}
    assert got[1]["blocked"] and not got[2]["blocked"] and got[1]["host"] == "ex.org"


def test_url_filter_intervals(spark):
    d = datetime.date
    log = spark.createDataFrame([("ex.org", "add", d(2024, 1, 10)), ("ex.org", "remove", d(2024, 3, 1)), ("a.ex.org/p", "add", d(2024, 2, 1)), ("b.net", "remove", d(2024, 1, 1)), (None, "add", d(2024, 1, 1))], "list_key string, action string, day date")
    caps = spark.createDataFrame(
        [(1, "http://a.ex.org/p/q?x", d(2024, 2, 15)), (2, "https://u:p@A.EX.org:80/z", d(2024, 1, 9)), (3, "http://ex.org", d(2024, 2, 29)), (4, "http://ex.org", d(2024, 3, 1)), (5, None, d(2024, 2, 1)), (6, "http://ex.org", None), (1, "http://a.ex.org/p/q?x", d(2024, 2, 15))],
        "page_id long, url string, fetched_on date",
    )
    got = rows(urlfilter.judge(caps, log))
    assert Counter((r["page_id"], r["n_active"], r["listed_key"]) for r in got) == {(1, 2, "a.ex.org/p"): 2, (2, 0, None): 1, (3, 1, "ex.org"): 1, (4, 0, None): 1, (5, 0, None): 1, (6, 0, None): 1}
    assert all(not r["blocked"] for r in rows(urlfilter.judge(caps, log.limit(0)))) and rows(urlfilter.judge(caps.limit(0), log)) == []


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit() and c.isascii()]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 % 10 + d // 5 for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_pii_base_spans_equal_plain_search(spark, make_docs):
    texts = [
        "mail a.b@c.org, x@y and z_@q.w.e%f@g.h", "1.2.3.4.5.6.7.8 and 300.1.1.1 and 00255.1.1.1 10.0.0.256", "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 4222222222222", "call +1 (555) 010-9999 or +12 or +44 20 7946 0958.",
        "é😀 +1 555 010 99990 😀 a@b.c", "9" * 5000, "a" * 3000 + "@b.c", "1 " * 40, None, "", "12.34.56.78@host.org +1.2.3.4.5.6.7.8.9", "4111111111111111 " * 600, "a@b.c" * 50,
    ]
    got = {r["doc_id"]: r for r in rows(pii.find(make_docs([(i, t, "s") for i, t in enumerate(texts)])))}
    for i, t in enumerate(texts):
        assert got[i]["base_sha256"] == hashlib.sha256(base_spans(t or "").encode()).hexdigest(), t
    assert got[11]["n_card"] >= 1 or base_spans(texts[11]) == ""


def test_pii_added_kinds_and_redaction(spark, make_docs):
    docs = make_docs([(1, "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, bad DE00370400440532013000", "s"), (2, "ssn 123-45-6789, but 123-45-6789 in a row far from any word that would say what it is about", "s"), (3, "write a@b.org or 10.0.0.1!", "s"), (4, None, "s")])
    got = {r["doc_id"]: r["spans"] for r in rows(pii.find(docs))}
    assert got[1].count("iban") == 2 and got[2].count("ssn") >= 1
    red = {r["doc_id"]: r for r in rows(pii.redact(docs))}
    assert red[3]["text"] == "write <EMAIL> or <IP>!" and red[3]["n_chars"] == 22 and red[3]["extra"] == "x" and red[4]["text"] is None


def test_pii_odd_and_empty(spark, odd_docs):
    assert len(rows(pii.find(odd_docs))) == 10 and rows(pii.find(odd_docs.limit(0))) == [] and len(rows(pii.redact(odd_docs))) == 10


def test_pii_redaction_of_many_and_overlapping_spans(spark, make_docs):
    """Against a plain version, with far more spans than one block and text beyond the basic plane."""
    texts = ["é😀" + " a@b.c 10.0.0.1 x" * 700, "12.34.56.78@host.org and +1.2.3.4.5.6.7.8.9!", "a@b.c", "😀" * 600 + "call +1 555 010 99990" + "ü" * 700, "a@b.c" * 50]
    docs = make_docs([(i, t, "s") for i, t in enumerate(texts)]).selectExpr("*", "1 as spans", "2 as `m_email`", "'r' as row", "doc_id as `x.y`")
    found = {r["doc_id"]: r["spans"] for r in rows(pii.find(docs))}
    got = {r["doc_id"]: r for r in rows(pii.redact(docs))}
    for i, t in enumerate(texts):
        out, end = "", 0
        for span in found[i].split(","):
            kind, s, e = span.split(":")
            if int(s) >= end:
                out += t[end : int(s)] + f"<{kind.upper()}>"
            end = max(end, int(e))
        assert got[i]["text"] == out + t[end:] and got[i]["n_chars"] == len(got[i]["text"])
        assert (got[i]["spans"], got[i]["m_email"], got[i]["row"], got[i]["x.y"]) == (1, 2, "r", i)


def test_pii_secrets_need_context(spark, make_docs):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    (a, b) = sorted(rows(pii.find(make_docs([(1, f'token = "{key}" then', "s"), (2, f"commit {key} of a far longer sentence that says nothing about it", "s")]))), key=lambda r: r["doc_id"])
    assert a["spans"] == "secret:9:49" and a["scores"] == "0.8" and "secret" not in b["spans"]
