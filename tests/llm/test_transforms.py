"""Fill-in-the-middle, runs of repeated words, packing."""

import hashlib
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brightloom.llm import middle, packing, runs

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def rows(df):
    return [r.asDict() for r in df.collect()]


def same_rows(got, want):
    key = lambda r: sorted((k, str(v)) for k, v in r.items())
    assert sorted(got, key=key) == sorted(want, key=key)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def middle_by_hand(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "", re.DOTALL)
    n, digest = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        form, out = "plain", text or ""
    else:
        form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    cut = form != "plain"
    return {"doc_id": doc_id, "n": n, "form": form, "prefix_chars": len(p) if cut else None, "middle_chars": len(m) if cut else None, "output_sha256": sha(out), "restored_sha256": sha(text or "")}


def test_middle_equals_plain_version(spark, make_docs, odd_docs):
    rng = random.Random(5)
    data = [(i, "".join(rng.choice(["ab", "Z", " ", "\n", "é", "😀", "<", ">", "<S", "P>", "1"]) for _ in range(rng.randrange(0, 60))), "a") for i in range(300)]
    data += [(1000, "x<M>y", "a"), (None, "no id twice", "a"), (None, "no id twice", "a"), (5, "a" * 300000 + " b" * 40000, "b")] + [(6, "same row " * 3, "c")] * 70
    docs = make_docs(data).union(odd_docs)
    same_rows(rows(middle.report(docs)), [middle_by_hand(r["doc_id"], r["text"]) for r in docs.collect()])
    assert rows(middle.report(docs.limit(0))) == []


def test_middle_outputs_can_be_restored(spark, make_docs):
    docs = make_docs([(i, f"def f{i}(x):\n    return x<S + {i}>>", "a") for i in range(200)])
    out = middle.transform(docs)
    assert {r["form"] for r in rows(out)} == {"plain", "psm", "spm"}
    assert out.where(middle.restore(F.col("output"), F.col("form")) != F.col("text")).count() == 0


def runs_by_hand(w):
    found = []
    for q in range(1, len(w) // 3 + 1):
        x = 0
        while x < len(w) - q:
            if w[x] != w[x + q]:
                x += 1
                continue
            start = x
            while x < len(w) - q and w[x] == w[x + q]:
                x += 1
            length = x - start + q
            shorter = any(all(w[k] == w[k + p] for k in range(start, start + length - p)) for p in range(1, q))
            if length >= max(24, 3 * q) and not shorter:
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("depth", [2, 512])
def test_runs_equal_brute_force(depth, monkeypatch):
    monkeypatch.setattr(runs, "DEPTH", depth)
    rng, seen = random.Random(depth), 0
    for _ in range(250):
        letters = rng.choice([1, 2, 3, 30])
        w = [rng.randrange(letters) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            block, at = [rng.randrange(letters) for _ in range(rng.randrange(1, 30))], rng.randrange(0, len(w) + 1)
            w[at:at] = (block * rng.randrange(2, 9))[: rng.randrange(1, 120)]
        want = runs_by_hand(w)
        assert runs.find_runs(w) == want
        assert runs.collapsed(w, want) == [x for k, x in enumerate(w) if not any(s + q <= k < s + n for s, n, q in want)]
        seen += len(want)
    assert seen > 50


def test_runs_of_long_texts():
    assert runs.find_runs(["x"] * 100000) == [(0, 100000, 1)]
    block = [f"w{k}" for k in range(9000)]
    assert runs.find_runs(["a", *block * 3, block[0], "b"]) == [(1, 27001, 9000)]


def report_by_hand(doc_id, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = runs_by_hand(w)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
    kept = [x for k, x in enumerate(w) if not any(s + q <= k < s + m for s, m, q in found)]
    milli = 1000 * best[1] // best[2] if found else None
    return {"doc_id": doc_id, "n_runs": len(found), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": milli, "runs_sha256": sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), "collapsed_sha256": sha(" ".join(kept))}


def test_run_report_equals_plain_version(spark, make_docs, odd_docs):
    rng = random.Random(8)
    data = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choice(["a", "b", "é\x1c", "c d"]) for _ in range(rng.randrange(0, 90))), "a") for i in range(200)]
    docs = make_docs(data + [(300, "one two three " * 9, "a")] * 3 + [(301, "x " * 30 + "y z " * 20, "b")]).union(odd_docs.where("length(text) < 1000 OR text IS NULL"))
    got = rows(runs.report(docs))
    same_rows(got, [report_by_hand(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sum(r["n_runs"] > 0 for r in got) >= 8 and rows(runs.report(docs.limit(0))) == []


def test_words_have_the_ids_of_the_whole_text():
    whole, cache = Tokenizer.from_file(VOCABULARY), packing.Words(VOCABULARY, limit=50)
    assert cache.by_piece
    rng = random.Random(3)
    parts = ["Hello", "WORLD", "it's", "we'LL", "don't.", "'s", "a1b22", "é", "é", "É", "ŉ", "İ", "ΣΑΣ", "ß", "ﬁ", " ", " ", "\x85", "\x1c", "中文字", "😀", "...", "<|endoftext|>", "x<|startoftext|>y", "_", "²", "½", "¯", "​", "ǅ", "Å", "한", "́"]
    for _ in range(600):
        text = "".join(rng.choice([*parts, " ", "\n", "\t", "\x0b"]) for _ in range(rng.randrange(0, 12)))
        assert np.frombuffer(cache.text(text.encode()), "<u4").tolist() == [*whole.encode(text, add_special_tokens=False).ids, 2], text


def test_ids_of_many_texts_at_a_time(monkeypatch):
    """Texts that follow each other without a blank, units of every kind and length, texts longer than a part."""
    whole, rng = Tokenizer.from_file(VOCABULARY), random.Random(4)
    parts = ["Hello", "WORLD", "it's", "'", "''S", "a1b22", "é", "e\u0301", "É", "ÀÖØÞß", "×", "÷", "a×b", "ŉ", "İ", "œ", "ΣΑΣ", "\xa0", "\xad", "\x00", "a\x00", "\x1c", "\x7f", "中文字", "😀", "...", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "_", "²", "abcdefgh", "abcdefghi", "abcdefghijklmnop", "abcdefghijklmnopq", "ééééééééé", "12345678901234567890", "!" * 17]
    known = {}
    for size, slots, pool in [(1 << 20, 21, 1 << 23)] * 300 + [(30, 3, 1 << 23), (30, 21, 100), (1 << 20, 3, 100)] * 100:  # slots that units take from each other, a pool that is emptied
        for name, value in (("PART", size), ("SLOTS", slots), ("POOL", pool)):
            monkeypatch.setattr(packing, name, value, raising=False)
        words = known.get((slots, pool)) or known.setdefault((slots, pool), packing.Words(VOCABULARY, limit=50))
        texts = ["".join(rng.choice([*parts, " ", "\n", "\t", "\x0b"]) for _ in range(rng.choice([0, 1, 4, 12, 40]))) for _ in range(rng.randrange(0, 6) if size > 30 else 1)]
        raw = "".join(texts).encode()
        flat, n = words.texts(raw, np.concatenate(([0], np.cumsum([len(x.encode()) for x in texts]))).astype(np.int64))
        want = [[*whole.encode(x, add_special_tokens=False).ids, 2] for x in texts]
        assert n.tolist() == [len(x) for x in want] and flat.tolist() == sum(want, []), texts


def test_long_text_without_blanks_is_cut(monkeypatch):
    whole, words, sizes = Tokenizer.from_file(VOCABULARY), packing.Words(VOCABULARY), []
    laid = words._laid
    monkeypatch.setattr(words, "_laid", lambda raw, at: sizes.append(len(raw)) or laid(raw, at))
    monkeypatch.setattr(packing, "PART", 100)
    text = "1a9F中2x'3s" * 200
    flat, n = words.texts(text.encode(), np.array([0, len(text.encode())]))
    assert flat.tolist() == [*whole.encode(text, add_special_tokens=False).ids, 2] and n.tolist() == [len(flat)]
    assert max(sizes) < 120


def test_equal_units_of_a_part_are_looked_up_once(monkeypatch):
    asked = []

    class Counted(packing.Words):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

        def _pieces(self, units):
            asked.extend(units)
            return super()._pieces(units)

    texts = ["Some words, and more. The words again: " * 200, "the rest", "", None] * 5
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(20)), "uid": list(range(20)), "text": pa.array(texts, pa.string())})
    monkeypatch.setitem(packing._workers, VOCABULARY, Counted(VOCABULARY))
    (out,) = packing._tokenised(VOCABULARY)(iter([batch]))
    whole = Tokenizer.from_file(VOCABULARY)
    assert [np.frombuffer(x.as_py(), "<u4").tolist() for x in out.column(3)] == [[*whole.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]
    assert 0 < len(asked) <= 25, len(asked)


def test_hilbert_neighbours_differ_by_one_step():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    place = packing.hilbert(grid, 3)
    assert sorted(place.tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("range_tokens", [40, 1 << 18])
def test_packing_holds_every_id_once(spark, make_docs, odd_docs, monkeypatch, range_tokens):
    monkeypatch.setattr(packing, "RANGE_TOKENS", range_tokens)
    rng, whole = random.Random(1), Tokenizer.from_file(VOCABULARY)
    docs = make_docs([(i, " ".join(rng.choice(["alpha", "Beta", "gamma-ray", "δ", "it's"]) for _ in range(rng.randrange(0, 400))), "a") for i in range(40)] + [(99, "copy of one text " * 20, "a")] * 30).union(odd_docs)
    pieces = rows(packing.pack(docs, VOCABULARY))
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    lengths = []
    for at in by_sequence.values():
        at.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in at] == np.cumsum([0, *[p["length"] for p in at]])[:-1].tolist() and all(p["length"] > 0 for p in at)
        lengths.append(sum(p["length"] for p in at))
    assert max(lengths) <= 4096 and all(n & (n - 1) == 0 for n in lengths)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    want = sorted(([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in docs.collect()), key=str)
    line, texts = [p for k in sorted(by_sequence) for p in by_sequence[k]], []
    for p in line:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"]
        if p["start"] == 0:
            texts.append([])
        assert p["start"] == len(texts[-1])
        texts[-1] += ids
        assert p["start"] + p["length"] < p["doc_tokens"] or len(texts[-1]) == p["doc_tokens"]
    assert sorted(texts, key=str) == want
    assert rows(packing.pack(docs.limit(0), VOCABULARY)) == []


def test_packed_neighbours_are_alike(spark, make_docs):
    topics = [[f"{t}{c}" for c in "bcdfghjklm"] for t in ("ka", "lo", "mi", "nu")]
    rng = random.Random(2)
    docs = make_docs([(i, " ".join(rng.choice(topics[i % 4]) for _ in range(200)), "a") for i in range(200)])
    line = sorted(rows(packing.pack(docs, VOCABULARY).where("start = 0")), key=lambda p: (p["sequence_id"], p["offset"]))
    assert sum(a["doc_id"] % 4 == b["doc_id"] % 4 for a, b in zip(line, line[1:], strict=False)) > 120


def test_packing_workers_hold_small_parts_and_no_pandas():
    """Ids of a batch come in parts of bounded size, and nothing in a worker loads pandas."""
    code = """if True:
        import sys
        import numpy as np
        import pyarrow as pa
        from brightloom.llm import packing
        texts = [b"some words, %d and more. " % i * 2000 for i in range(120)] + [b""]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int32)
        ids = pa.Array.from_buffers(pa.int64(), 121, [None, pa.py_buffer(np.arange(121))])
        column = pa.Array.from_buffers(pa.string(), 121, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(texts))])
        batch = pa.RecordBatch.from_arrays([ids, ids, column], ["doc_id", "uid", "text"])
        parts = list(packing._tokenised(sys.argv[1])(iter([batch])))
        assert len(parts) > 3 and max(p.nbytes for p in parts) < 4 << 20, [p.nbytes for p in parts]
        assert "pandas" not in sys.modules
        words = packing.Words(sys.argv[1])
        got = [(k.as_py(), i.as_py()) for p in parts for k, i in zip(p.column(1), p.column(3))]
        assert got == [(k, words.text(x)) for k, x in enumerate(texts)]
        assert [n.as_py() for p in parts for n in p.column(2)] == [len(i) // 4 for _, i in got]
    """
    done = subprocess.run([sys.executable, "-c", code, VOCABULARY], env=dict(os.environ, PYTHONPATH=packing.__file__.rsplit("/brightloom/", 1)[0]), capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
