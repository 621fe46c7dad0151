import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import hopgraph.llm.ppm as ppm
from tests.llm.edge import documents, nothing


def slow_score(learnt, text, order):
    """PPM with method X and exclusion, byte by byte."""
    trie = [defaultdict(Counter) for _ in range(order + 1)]
    for t in learnt:
        padded = b"\xff" * order + t + b"\xff"
        for i in range(order, len(padded)):
            for k in range(order + 1):
                trie[k][padded[i - k : i]][padded[i]] += 1
    padded, out = b"\xff" * order + text + b"\xff", 0.0
    for i in range(order, len(padded)):
        excluded = set()
        for k in range(order, -1, -1):
            counts = trie[k].get(padded[i - k : i])
            if counts is None:
                continue
            left = {s: c for s, c in counts.items() if s not in excluded}
            once = sum(c == 1 for c in left.values())
            total = sum(left.values()) + once + 1
            if padded[i] in left:
                out += math.log10(left[padded[i]] / total)
                break
            if left:
                out += math.log10((once + 1) / total)
            excluded |= set(counts)
        else:
            out -= math.log10(256 - len(excluded))
    return out


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, order):
    words = {i: [*lowered(t).encode().split(), b"<end>"] for i, (_, t, _) in enumerate(rows)}
    counts = Counter(w for i, r in enumerate(rows) if r[2] for w in words[i])
    n, v = sum(counts.values()), len(counts)
    learnt = [lowered(t).encode() for _, t, x in rows if x]
    out = []
    for i, (doc, text, learn) in enumerate(rows):
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words[i])
        out.append((doc, learn, len(words[i]), sum(counts[w] > 0 for w in words[i]), n, base, slow_score(learnt, lowered(text).encode(), order)))
    return out


def same(got, want):
    assert len(got) == len(want)
    key = lambda r: (str(r[0]), r[2], r[5], r[6])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-6, abs=1e-5) and a[6] == pytest.approx(b[6], rel=1e-6, abs=1e-5), (a, b)


@pytest.mark.parametrize("order,block", [(4, 8 << 20), (2, 300), (5, 100)])
def test_against_brute_force(spark, monkeypatch, order, block):
    monkeypatch.setattr(ppm, "BLOCK_BYTES", block)
    monkeypatch.setattr(ppm, "CHUNK", block)
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choice(["ab", "abc", "Bca", "ä€", "x"]) for _ in range(rng.randint(0, 30))), i % 4 != 1) for i in range(40)]
    rows += [(100, None, True), (100, None, True), (101, "", False), (None, "new \U0001f600 zq", False), (102, "ABC abc\tabc", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").selectExpr("*", "1 as t", "2 as block", "3 as score")
    got = ppm.score_documents(df, F.col("learn"), order).collect()
    same([(r.doc_id, r.learn, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], brute(rows, order))


def test_probabilities_of_a_context_sum_to_one():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 40, 300).astype(np.uint64) & np.uint64(0x0303030303)
    trie = ppm.Trie(*np.unique(keys, return_counts=True), 4)
    for context in [*(keys[:5] >> np.uint64(8)), np.uint64(0x03030303), np.uint64(0x99999999)]:
        every = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert (10.0 ** trie.score(every)).sum() == pytest.approx(1)


def test_edges_and_depth(spark, monkeypatch):
    assert ppm.score_documents(nothing(spark), F.lit(True)).count() == 0
    docs = documents(spark)
    rows = ppm.score_documents(docs, F.lit(False)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id == 4:
            assert r.score == pytest.approx(-math.log10(256)) and r.train_tokens == 0 and r.n_tokens == 1
    monkeypatch.setattr(ppm, "ENTRIES", 3)
    small = [(1, "abc abd", True), (2, "xyz", False)]
    df = spark.createDataFrame(small, "doc_id long, text string, learn boolean")
    got = ppm.score_documents(df, F.col("learn"), 4).collect()
    same([(r.doc_id, r.learn, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], brute(small, 2))


def test_held_out_texts_gain_from_the_trie(spark):
    rows = ppm.op4_lm_score(spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size = {r.doc_id: len(r.text.encode()) for r in docs.collect()}
    bits = -sum(r.score for r in held) / math.log10(2) / sum(size[r.doc_id] for r in held)
    assert bits < 2.5 and sum(r.score for r in held) > 1.1 * sum(r.base_score for r in held)


@pytest.mark.parametrize("order,part", [(5, 40), (3, 7), (2, 1000)])
def test_large_tries_keep_their_depth(spark, monkeypatch, order, part):
    monkeypatch.setattr(ppm, "ENTRIES", 3)
    monkeypatch.setattr(ppm, "PART_ENTRIES", part)
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 200)
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choice(["ab", "abc", "Bca", "ä€", "x"]) for _ in range(rng.randint(0, 30))), i % 4 != 1) for i in range(40)]
    rows += [(100, None, True), (100, None, True), (101, "", False), (None, "new \U0001f600 zq", False), (102, "ABC abc\tabc", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    got = ppm.score_documents(df, F.col("learn"), order, whole=True).collect()
    same([(r.doc_id, r.learn, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], brute(rows, order))


def test_the_query_keeps_its_depth(spark, monkeypatch, tmp_path):
    rows = [(i, "the cat sat on the mat " * (i % 3) + f"cat {i}") for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(map(tuple, ppm.op4_lm_score(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(ppm, "ENTRIES", 3)
    monkeypatch.setattr(ppm, "PART_ENTRIES", 50)
    assert sorted(map(tuple, ppm.op4_lm_score(spark, str(tmp_path)).collect())) == want
