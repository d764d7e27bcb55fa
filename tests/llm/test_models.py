"""Operators in numpy: near-duplicates, decontamination, classifiers, languages, the pipeline."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from brightloom.llm import decontam, langid, neardup, quality, tokens, toxicity
from brightloom.llm.fmindex import FMIndex, suffix_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def test_words_equal_the_expression():
    texts = ["Ab, cD-ef_9é", "", None, "😀x 1", "zz", " \n", "É\x7f" + "a" * 70000]
    data, at = tokens.text_buffers(pa.array(texts, pa.string()))
    found = tokens.words(data, at)
    assert np.diff(found.rows).tolist() == [len(WORD.findall(lower(t or ""))) for t in texts]
    same = tokens.words(*tokens.text_buffers(pa.array(["x AB y ab Ab"])))
    assert len(set(same.hash.tolist())) == 3
    assert [r for r in tokens.row_chunks(at, 10)][-1][1] == len(texts)


def test_suffix_order_and_locate():
    rng = np.random.default_rng(0)
    for _ in range(30):
        docs = [rng.integers(1, 4, rng.integers(0, 15)) for _ in range(rng.integers(1, 6))] * 2
        text = np.concatenate([np.append(d, 0) for d in docs]).astype(np.int64)

        def suffix(i):
            return [*text[i : i + int(np.argmax(text[i:] == 0))].tolist(), 0], i

        order = suffix_order(text, 2)
        assert order.tolist() == sorted(range(len(text)), key=suffix)
        assert (FMIndex(text, 2, 3).locate(np.arange(len(text))) == order).all()


def brute_hits(text, items, window=13):
    w, hit, ids = WORD.findall(lower(text or "")), set(), set()
    for item, t in items:
        v = WORD.findall(lower(t or ""))
        n = min(len(v), window)
        grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                ids.add(str(item))
    return len(w), len(hit), sorted(ids)


def test_decontamination_equals_brute_force(spark, make_docs):
    rng = random.Random(1)
    word = lambda: rng.choice(["a", "b", "cc", "Dd"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 13, 20])))) for i in range(1, 8)] + [(8, None), (9, "..."), (1, "cc a")]
    texts = [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(40)] + [items[2][1] + " zz " + items[2][1], None, "", "b" * 40000]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in rows(decontam.report(make_docs([(i, t, "s") for i, t in enumerate(texts)]), bench))}
    import hashlib

    for i, t in enumerate(texts):
        n, h, ids = brute_hits(t, items)
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"]) == (n, h, len(ids)), t
        assert got[i]["items_sha256"] == hashlib.sha256(",".join(ids).encode()).hexdigest() and got[i]["contaminated"] == (h > 0 and 20 * h >= n)


def test_decontamination_blocks_and_odd(spark, odd_docs, monkeypatch):
    bench = spark.createDataFrame([(1, "words here and there"), (2, "another text")], "item_id long, text string")
    whole = sorted(map(str, rows(decontam.report(odd_docs, bench))))
    monkeypatch.setattr(decontam, "BLOCK", 8)
    assert sorted(map(str, rows(decontam.report(odd_docs, bench)))) == whole and len(whole) == 10
    assert rows(decontam.report(odd_docs.limit(0), bench)) == [] and not any(r["n_hit"] for r in rows(decontam.report(odd_docs, bench.limit(0))))
    left = rows(decontam.clean_documents(odd_docs, bench))
    assert len(left) == 7 and {r["extra"] for r in left} == {"x"}


def shingle_set(text):
    w = WORD.findall(lower(text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)])


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(2)
    a = np.sort(rng.choice(1 << 40, 300, replace=False).astype(np.uint64))
    b = np.sort(np.concatenate((a[:220], rng.choice(1 << 40, 80, replace=False).astype(np.uint64))))
    wa, wb = 1 + rng.random(300), 1 + rng.random(300)
    s = neardup.signatures(np.repeat([0, 1], 300), np.concatenate((a, b)), np.concatenate((wa, wb)), 2, 4000)
    x, y = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
    exact = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in {*x, *y}) for d in {*x} & {*y})
    assert (s[0] == s[1]).mean() == pytest.approx(exact, abs=0.03)
    assert neardup.similarity(a, wa, b, wb) == pytest.approx(max(exact, 220 / 380))


def test_classes_equal_brute_force(spark, make_docs):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(500)}" for _ in range(120)] for _ in range(6)]
    texts = []
    for k in range(90):
        w = list(base[k % 6])
        for _ in range(rng.randrange(7)):
            w[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), None, "", "", "a b", "a b", "a c", "w " * 500 + "end", "w " * 400 + "end"]
    sets = [shingle_set(t) for t in texts]
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if WORD.findall(texts[i] or "") == [] or WORD.findall(texts[j] or "") == []:
                same = (texts[i] or "") == (texts[j] or "")
            else:
                same = len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
            if same:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    docs = make_docs([(i, t, "s") for i, t in enumerate(texts)])
    assert {r["doc_id"]: r["class_id"] for r in rows(neardup.classes(docs))} == {i: find(i) for i in range(len(texts))}
    kept = rows(neardup.distinct_documents(docs))
    assert sorted(r["doc_id"] for r in kept) == sorted({find(i) for i in range(len(texts))}) and {r["extra"] for r in kept} == {"x"}


def test_copies_that_differ_in_repeats_are_found(spark, make_docs):
    data = []
    for k in range(24):
        base = " ".join(f"p{k}w{i}" for i in range(120))
        passage = " ".join(f"p{k}r{i}" for i in range(18))
        data += [(2 * k, base, "s"), (2 * k + 1, f"{base} " + " ".join([passage] * (50 if k % 2 else 400)), "s")]
        assert len(shingle_set(data[-1][1]) & shingle_set(base)) / len(shingle_set(data[-1][1]) | shingle_set(base)) >= 0.8
    got = {r["doc_id"]: r["class_id"] for r in rows(neardup.classes(make_docs(data)))}
    assert got == {i: i - i % 2 for i in range(48)}


def test_neardup_odd_and_empty(spark, odd_docs):
    got = rows(neardup.classes(odd_docs))
    assert len(got) == 10 and rows(neardup.classes(odd_docs.limit(0))) == []
    assert len(rows(neardup.distinct_documents(odd_docs))) == 8


def labelled(spark, make_docs, kind):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abdeiklmnorst") for _ in range(rng.randrange(2, 8)))
    data, labels = [], []
    for i in range(500):
        y = int(rng.random() < 0.5)
        lines = [" ".join(word() for _ in range(rng.randrange(5, 15))).capitalize() + "." for _ in range(4)]
        if kind == "quality" and not y:
            lines[1:3] = [" ".join(word().upper() + "!!" for _ in range(12)) for _ in range(2)]
        if kind == "toxic" and y:
            lines[2] += " you " + rng.choice(["vile", "rotten", "dreadful"]) + " thing"
        data.append((i, "\n".join(lines), "s"))
        labels.append((i, y if kind == "quality" else 1, y if kind == "toxic" else 0))
    return make_docs(data), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: q if kind == "quality" else t for i, q, t in labels}


@pytest.mark.parametrize("kind, operator, folds, out", [("quality", quality, 4, 2), ("toxic", toxicity, 5, 0)])
def test_classifiers_on_held_out_documents(spark, make_docs, odd_docs, kind, operator, folds, out):
    docs, labels, truth = labelled(spark, make_docs, kind)
    got = rows(operator.score(docs, labels))
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % folds == out}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.9
    odd = rows(operator.score(docs.union(odd_docs), labels))
    assert len(odd) == 510 and all(0 <= r["score"] <= 1 for r in odd)
    assert len(rows(operator.score(odd_docs, labels.limit(0)))) == 10 and rows(operator.score(docs.limit(0), labels)) == []


def test_toxicity_languages_beyond_the_most_frequent_share_a_column():
    n = toxicity.MAX_LANGUAGES + 8
    langs = [f"l{k:02}" for k in range(n) for _ in range(3 if k < toxicity.MAX_LANGUAGES else 2)]
    words = np.array([[100 * int(x[1:]) + j] * 2 for x in langs for j in range(20)], np.int32)
    rows_ = np.arange(len(langs) + 1) * 20
    guess = toxicity._guess_table(words, rows_, langs)
    model = toxicity.Model(np.zeros((toxicity.BUCKETS + 1, 1)), [], np.zeros(0), np.zeros(0), 0.0, guess, np.zeros(guess.shape[1]))
    assert model.languages(words, rows_).tolist() == [min(int(x[1:]), toxicity.MAX_LANGUAGES) for x in langs]


def test_line_features_and_forward_backward():
    texts = ["a\n\nb", "", "\n", "x" * 10]
    found = quality.lines(*tokens.text_buffers(pa.array(texts)))
    assert np.diff(found.rows).tolist() == [3, 1, 2, 1] and found.size.tolist() == [1, 0, 1, 0, 0, 0, 10]
    rng = np.random.default_rng(1)
    s, pairs = rng.normal(size=4), rng.normal(size=(2, 2))
    import itertools

    weight = {y: np.exp(sum(s[t] * y[t] for t in range(4)) + sum(pairs[y[t], y[t + 1]] for t in range(3))) for y in itertools.product((0, 1), repeat=4)}
    exact = [sum(v for y, v in weight.items() if y[t]) / sum(weight.values()) for t in range(4)]
    assert np.allclose(quality.forward_backward(s, np.array([0, 4]), pairs)[2], exact)


def test_languages(spark, make_docs, odd_docs):
    rng = random.Random(6)
    letters = {"xx": "abcdefgh", "yy": "ghijklmn", "zz": "éüñçøå"}
    data = [(i, " ".join("".join(rng.choice(letters[g]) for _ in range(5)) for _ in range(30)), g) for i, g in enumerate(rng.choice(list(letters)) for _ in range(150))]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in rows(langid.identify(docs))}
    assert all(got[i]["lang_pred"] == g for i, _, g in data)
    odd = rows(langid.identify(odd_docs))
    assert len(odd) == 10 and sum(r["lang_pred"] == "und" for r in odd) == 3 and rows(langid.identify(odd_docs.limit(0))) == []
    assert all(r["lang_pred"] == "und" for r in rows(langid.identify(docs.withColumn("lang", docs["lang"].substr(9, 1)).where("doc_id < 0"))))


def plain_mix(docs):
    """(doc_id, taken) of the documents in a mix: streams in the order of the hash, targets by reshared
    excess, each stream played from its start until its target, from the start again if it ends."""
    import hashlib

    order = lambda s: (s is None, s or "")
    sizes = {s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs if r["source"] == s) for s in {r["source"] for r in docs}}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=order))}
    full, left, target = set(), 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in sizes if s not in full]
        level = (left - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in rest)
        over = {s for s in rest if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    taken = set()
    for s in sizes:
        words = int((2 * sizes[s] if s in full else level * weight[s]) + 0.5)
        at = 0
        for r in sorted((r for r in docs if r["source"] == s), key=lambda r: int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16)):
            n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
            played = sum(max(0, min(e * sizes[s] + at + n, words) - (e * sizes[s] + at)) for e in (0, 1))
            at += n
            if played:
                taken.add((r["doc_id"], played))
    return taken


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r["doc_id"] for r in rows(quality.score(docs, spark.read.parquet(f"{sf}/labels.parquet"))) if r["predicted"]}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in good}
    sets, kept = {i: shingle_set(t) for i, t in texts.items()}, {}
    top = {i: i for i in texts}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for i in {find(i) for i in ids}:
        n, h, _ = brute_hits(texts[i], items)
        if not (h and 20 * h >= n):
            kept[i] = texts[i]
    stage = docs
    for name, f in corpus_pipeline.STAGES[:4]:
        stage = f(spark, stage, sf)
        assert stage.columns == docs.columns, name
        path = str(tmp_path / re.sub(r"\W", "", name))
        stage.write.parquet(path)
        stage = spark.read.parquet(path)
    assert {r["doc_id"] for r in stage.collect()} == set(kept)
    final = rows(corpus_pipeline.STAGES[4][1](spark, stage, sf))
    assert {(r["doc_id"], r["taken"]) for r in final} == plain_mix(rows(stage))


STRANGE = ["1 as __score", "'x' as __x", "3 as _merged", "'mine' as size", "doc_id as `a.b`", "4 as row", "5 as score", "6 as id", "7 as ta", "8 as n_words", "9 as spans", "10 as `back``tick`"]


def test_stages_keep_columns_of_any_name(spark, make_docs):
    texts = [f"plain words number {i} stand here for a text that is long enough to have shingles {i}" for i in range(6)] + ["mail a.b@c.org now", None, ""]
    docs = make_docs([(i, t, "a") for i, t in enumerate(texts)]).selectExpr("*", *STRANGE)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "nothing of this kind")], "item_id long, text string")
    from brightloom.llm import mixing, pii

    for stage in (lambda d: quality.good_documents(d, labels), neardup.distinct_documents, lambda d: decontam.clean_documents(d, bench), pii.redact, mixing.mixed_documents):
        out = stage(docs)
        assert out.columns[: len(docs.columns)] == docs.columns
        got = rows(out)
        assert got and all((r["__score"], r["__x"], r["_merged"], r["size"], r["a.b"], r["row"], r["spans"], r["back`tick"]) == (1, "x", 3, "mine", r["doc_id"], 4, 9, 10) for r in got)
        assert rows(stage(docs.limit(0))) == []


def test_a_text_beyond_every_chunk(spark, make_docs):
    """9 MB, more than any operator reads at once: results are of the whole text."""
    body = "\n".join(f"word{i % 9973} and more of line {i}." for i in range(330000))
    passage = " ".join(f"passage{i}" for i in range(13))
    docs = make_docs([(1, body + " " + passage, "a"), (2, body + " " + passage, "a"), (3, body[: len(body) // 2], "a"), (4, "short text", "a")])
    assert len(body) > max(quality.CHUNK, neardup.CHUNK, decontam.SHARD, langid.CHUNK, toxicity.CHUNK)
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    hits = {r["doc_id"]: r["n_hit"] for r in rows(decontam.report(docs, bench))}
    assert hits == {1: 13, 2: 13, 3: 0, 4: 0}
    assert {r["doc_id"]: r["class_id"] for r in rows(neardup.classes(docs))} == {1: 1, 2: 1, 3: 3, 4: 4}
    for got in (rows(langid.identify(docs)), rows(quality.score(docs, labels)), rows(toxicity.score(docs, labels))):
        by_id = {r["doc_id"]: r["score"] for r in got}
        assert by_id[1] == by_id[2] and len(by_id) == 4


def test_training_text_is_bounded_in_bytes(spark, make_docs):
    docs = make_docs([(i, f"text {i} " * 50, "a") for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    scratch = []
    part = quality.within_bytes(docs.select("doc_id", "text"), 20000, scratch)
    n = part.agg({"text": "count"}).first()[0]
    assert 10 < n < 90 and quality.within_bytes(docs.select("doc_id", "text"), 10**9, scratch).count() == 200
    assert len(rows(quality.score(docs, labels))) == 200


def test_languages_by_plain_distances(spark):
    """Every document's nearest language, and its score, by a plain version; ties and letterless texts."""
    rng = random.Random(8)
    data = [(i, " ".join("".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 40))), f"l{i % 3}") for i in range(60)]
    data += [(100, "123 .", "l0"), (101, None, "l1"), (102, "abc", None), (103, "q", "l2"), (104, "AbC, abc! Ab", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")

    def profile(texts):
        n = {}
        for t in texts:
            low = "".join(c.lower() if c.isalpha() else " " for c in t or "")
            for word in low.split():
                p = f" {word} "
                for g in [p[a : a + k] for k in (1, 2, 3) for a in range(len(p) - k + 1)]:
                    if g.strip():
                        n[g] = n.get(g, 0) + 1
        key = lambda g: tuple(ord(c) for c in g) + (0,) * (3 - len(g))
        return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], key(x[0])))][: langid.PROFILE]

    def trains(i):
        return zlib.crc32(str(i).encode()) % 5 != 0

    learned = {g: profile([t for i, t, h in data if h == g and t is not None and trains(i)]) for g in sorted({h for i, t, h in data if h and t is not None and trains(i)})}
    got = {r["doc_id"]: r for r in rows(langid.identify(docs))}
    for i, t, _ in data:
        own = profile([t])
        if not own:
            assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0
            continue
        far = {g: sum(abs(k - p.index(x)) if x in p else langid.PROFILE for k, x in enumerate(own)) for g, p in learned.items()}
        best = min(far, key=lambda g: (far[g], g))
        assert got[i]["lang_pred"] == best and got[i]["score"] == pytest.approx(1 - far[best] / (len(own) * langid.PROFILE)), t


def test_languages_without_a_letter_in_training(spark):
    docs = spark.createDataFrame([(1, "123", "b"), (2, "456", "a"), (3, "hello", None), (6, "7", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in rows(langid.identify(docs))}
    assert got[1] == got[6] == "und" and got[3] in {"a", "b"} and all(r["score"] == 0 for r in rows(langid.identify(docs)))


def test_quality_by_a_plain_version(spark, make_docs):
    """Aggregation and score of the query from the model's own numbers: all label sequences of each
    document are summed, lines weigh by length, and the curve gives the score."""
    import itertools

    docs, labels, _ = labelled(spark, make_docs, "quality")
    more = make_docs([(1000, "A line.\n!!! $$$ !!!\nAnother one, of words.", "s"), (1001, "", "s"), (1002, "x\n\ny", "s"), (1003, None, "s")])
    model = quality.fit(docs, labels)
    got = {r["row"]["doc_id"]: r["score"] for r in rows(quality.scored(more, model))}
    for i, text in ((1000, "A line.\n!!! $$$ !!!\nAnother one, of words."), (1001, ""), (1002, "x\n\ny"), (1003, "")):
        lines = [x.encode() for x in text.split("\n")]
        own = quality.lines(*tokens.text_buffers(pa.array([text]))).own.astype(float)
        assert len(own) == len(lines)
        for f, x in zip(own, lines):
            letters = sum(c.isalpha() for c in x.decode())
            assert f[2] == pytest.approx(sum(65 <= c <= 90 for c in x) / max(letters, 1)) and f[1] == pytest.approx(np.log1p(len(x)) / 6)
            assert f[5] == pytest.approx(4 * sum(c in b"!?" for c in x) / max(len(x), 1)) and f[10] == (len(x.split()) <= 3) and f[11] == x.endswith(b".")
        pad = np.zeros(quality.N_OWN)
        s = [float(np.concatenate((own[k], own[k - 1] if k else pad, own[k + 1] if k + 1 < len(own) else pad)) @ model.weights) for k in range(len(own))]
        weight = {y: np.exp(sum(a * b for a, b in zip(s, y)) + sum(model.pairs[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=len(s))}
        p = [sum(v for y, v in weight.items() if y[k]) / sum(weight.values()) for k in range(len(s))]
        sizes = [len(x) + 1 for x in lines]
        mean = min(max(sum(a * b for a, b in zip(p, sizes)) / sum(sizes), 1e-4), 1 - 1e-4)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(model.curve[0] + model.curve[1] * np.log(mean / (1 - mean))))), abs=1e-5)


def test_toxicity_by_a_plain_version():
    """Convolution and maximum by loops, with a threshold for each language."""
    rng = np.random.default_rng(3)
    n_out = toxicity.FILTERS * len(toxicity.WIDTHS)
    guess = rng.normal(size=(toxicity.BUCKETS + 1, 2)).astype(np.float32)
    guess[-1] = 0
    model = toxicity.Model(
        rng.normal(size=(toxicity.BUCKETS + 1, toxicity.DIMENSIONS)), [rng.normal(size=(w, toxicity.DIMENSIONS, toxicity.FILTERS)) for w in toxicity.WIDTHS],
        rng.normal(size=n_out), rng.normal(size=n_out), 0.3, guess, np.array([0.5, -1.5]),
    )
    model.embed[-1] = 0
    texts = ["one two three four five", "", "alone", "a b", "Ünï ünï x y z 1 2 3"]
    data, at = tokens.text_buffers(pa.array(texts))
    words, at_ = toxicity.hashed_words(data, at)
    got = model.scores(words, at_)
    languages = []
    for k in range(len(texts)):
        own = [tuple(w) for w in words[at_[k] : at_[k + 1]]] + [(toxicity.BUCKETS, toxicity.BUCKETS)] * max(toxicity.WIDTHS)
        total = 0.3
        for w, (width, filters) in enumerate(zip(toxicity.WIDTHS, model.filters)):
            for f in range(toxicity.FILTERS):
                best = max(
                    sum(float((model.embed[own[p + j][0]] + model.embed[own[p + j][1]]) @ filters[j, :, f]) for j in range(width))
                    for p in range(max(1, at_[k + 1] - at_[k]))
                )
                c = w * toxicity.FILTERS + f
                total += max(best + model.bias[c], 0) * model.out[c]
        language = int(np.argmax(sum(guess[a] for a, _ in own)))
        languages.append(language)
        assert got[k] == pytest.approx(1 / (1 + np.exp(-np.clip(total - model.shift[language], -30, 30))), abs=1e-5)
    assert set(languages) == {0, 1}


def test_toxicity_thresholds_of_two_languages(spark):
    rng = random.Random(9)
    data, labels = [], []
    for i in range(900):
        y, lang = int(rng.random() < 0.5), ("aa", "bb")[i % 2]
        alphabet = "abdeikl" if lang == "aa" else "mnorstuv"
        text = " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(3, 8))) for _ in range(40))
        data.append((i, text + (" " + rng.choice(["vile", "rotten"] if lang == "aa" else ["mnoz", "stuz"]) if y else ""), lang))
        labels.append((i, 1, y))
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = rows(toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    for k, lang in enumerate(("aa", "bb")):
        held = [r for r in got if r["held_out"] and r["doc_id"] % 2 == k]
        assert np.mean([r["predicted"] == labels[r["doc_id"]][2] for r in held]) > 0.9


def toxicity_shards(spark, monkeypatch, n=12000, shard_bytes=100_000):
    """One word of its own in each labelled document, and one of six telling ones in every third."""
    monkeypatch.setattr(toxicity, "SHARD_BYTES", shard_bytes, raising=False)
    telling = ["vile", "rotten", "dreadful", "nasty", "beastly", "horrid"]
    data = [(i, f"own{i} plain {telling[i // 3 % 6] if i % 3 == 0 else 'words'} here", "aa") for i in range(n)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    return docs, spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(n)], "doc_id long, quality int, toxic int").repartition(3)


def test_toxicity_learns_from_every_labelled_document(spark, monkeypatch):
    """Every training document is counted, none of the held-out fold; the order of the rows changes nothing."""
    docs, labels = toxicity_shards(spark, monkeypatch)
    model = toxicity.fit(docs, labels)
    own = {i: tokens.words(*tokens.text_buffers(pa.array([f"own{i}"]))).hash[0] >> np.uint64(48) for i in range(12000)}
    learned = [i for i in own if zlib.crc32(str(i).encode()) % 5 != 0]
    counts = np.bincount(np.array([own[i] for i in learned], int), minlength=toxicity.BUCKETS)
    shared = sum(int(i % 3 != 0) for i in learned), len(learned)
    for word, n in zip(("words", "plain", "here"), (shared[0], shared[1], shared[1])):
        counts[int(tokens.words(*tokens.text_buffers(pa.array([word]))).hash[0] >> np.uint64(48))] += n
    for k, word in enumerate(["vile", "rotten", "dreadful", "nasty", "beastly", "horrid"]):
        counts[int(tokens.words(*tokens.text_buffers(pa.array([word]))).hash[0] >> np.uint64(48))] += sum(i % 3 == 0 and i // 3 % 6 == k for i in learned)
    assert np.allclose(model.guess[:-1, 0], np.log((counts + 0.1) / (counts + 0.1).sum()), atol=1e-5)
    again = toxicity.fit(docs.repartition(5), labels.repartition(2))
    assert np.array_equal(model.embed, again.embed) and model.shift.tolist() == again.shift.tolist()
    held = [r for r in rows(toxicity.score(docs, labels)) if r["held_out"]]
    assert len(held) == 12000 - len(learned) and np.mean([r["predicted"] == (r["doc_id"] % 3 == 0) for r in held]) > 0.95


def test_toxicity_thresholds_by_a_plain_version(spark):
    rng = random.Random(12)
    judged = [(k, int(rng.random() < 0.4), round(rng.gauss(0, 1), 1)) for k in (0, 1, 2) for _ in range(400 if k < 2 else 20)]
    judged = [(k, y, x + y + k) for k, y, x in judged]
    got = toxicity.thresholds(spark.createDataFrame(judged, "language int, y int, logit double"))
    assert set(got) == {-1, 0, 1}
    for k, threshold in got.items():
        some = [(y, x) for lang, y, x in judged if k in (-1, lang)]
        f1 = lambda t: 2 * sum(y for y, x in some if x >= t) / (sum(x >= t for _, x in some) + sum(y for y, _ in some))  # noqa: B023, E731
        best = max(sorted({x for _, x in some}, reverse=True), key=f1)
        assert threshold == pytest.approx((best + max((x for _, x in some if x < best), default=best - 2)) / 2)
    assert toxicity.thresholds(spark.createDataFrame([(0, 1, 0.5)], "language int, y int, logit double")) == {}
