import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

import hopgraph.llm.repeats as rep
from tests.llm.edge import documents, nothing


def brute(rows, length):
    """(bytes, removed, spans, hash of the rest) by looking at every string."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def mine(df, length, gram=None):
    return [
        (r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest())
        for r in rep.repeats(df, length, gram=gram).collect()
    ]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "é", "xyz", "q", "the"])
    passages = [" ".join(word() for _ in range(rng.randint(5, 40))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh é") for _ in range(40)) for _ in range(4)]
        rows.append((i, rng.choice([" ", "\n", ""]).join(parts)))
    rows += [(100, rows[0][1]), (101, rows[0][1] + "!"), (102, "a" * 300), (103, "abcabc" * 60), (104, None), (105, ""), (105, "")]
    rows += [(200 + i, f"{rng.random()} one very common line of text {rng.random()}") for i in range(40)]
    rows += [(None, rows[3][1]), (7, rows[7][1]), (7, "another text under an id that came before, long enough to count")]
    return rows


@pytest.mark.parametrize("length,gram,crowd,block", [(20, None, 4096, 1 << 19), (20, 3, 5, 400), (30, 10, 0, 1), (64, None, 8, 2000), (40, None, 2, 1)])
def test_against_brute_force(spark, monkeypatch, length, gram, crowd, block):
    monkeypatch.setattr(rep, "CROWD", crowd)
    monkeypatch.setattr(rep, "BLOCK_BYTES", block)
    rows = corpus(length + crowd)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "2 as t", "3 as a", "4 as did")
    assert sorted(mine(df, length, gram), key=str) == sorted(brute(rows, length), key=str)


def test_chunks_of_long_texts(monkeypatch):
    text = np.random.default_rng(1).integers(0, 4, 5000).astype(np.uint8).tobytes()
    want = [x.tolist() for x in rep.anchors(text, 50, 16)]
    monkeypatch.setattr(rep, "CHUNK", 700)
    first, last, hashes, places = rep.anchors(text, 50, 16)
    spread = lambda f, t, h, p: [x for a, b, *k in zip(f, t, h, p) for x in [k] * (b - a + 1)]
    assert spread(first, last, hashes, places) == spread(*want)
    assert first[0] == 0 and last[-1] == len(text) - 50 and (first[1:] == last[:-1] + 1).all()


def test_longest_previous_factors():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 30)))
        order = sorted(range(len(text)), key=lambda i: text[i:])
        share = lambda a, b: next((k for k in range(len(text)) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or a + k >= len(text)), 0)
        lcp = np.array([0] + [share(a, b) for a, b in zip(order, order[1:])])
        got = dict(zip(order, rep.longest_previous(np.array(order), lcp).tolist()))
        for i in range(len(text)):
            assert got[i] == max([share(j, i) for j in range(i)], default=0)


def test_first_copies_stay(spark):
    rows = corpus(5)
    texts = sorted({(-1 if d is None else d, t) for d, t in rows if t}, key=lambda r: r[0])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut = {(r.doc_id, r.n_bytes): r for r in rep.repeats(df.dropDuplicates(), 30, later_only=True).collect()}
    seen = set()
    for doc, t in texts:
        if sum(d == doc for d, _ in texts) > 1:
            seen |= {t.encode()[i : i + 30] for d, t in texts if d == doc for i in range(len(t.encode()) - 29)}
            continue
        raw, gone = t.encode(), set()
        for i in range(len(raw) - 29):
            s = raw[i : i + 30]
            if s in seen:
                gone |= set(range(i, i + 30))
            seen.add(s)
        r = cut[(None if doc == -1 else doc, len(raw))]
        if doc != -1 and doc < 7:
            assert {x for s in r.spans for x in range(s.start, s.stop)} == gone


def test_dropping(spark):
    docs = documents(spark)
    new = rep.drop_repeats(docs, 20)
    assert new.columns == docs.columns and new.count() == docs.count()
    got = {r.doc_id: r for r in new.collect()}
    assert got[1].text and got[2].text == "" and got[2].n_chars == 0 and got[3].text is None and got[4].text == ""
    assert len(got[6].text.encode()) < 100
    assert rep.drop_repeats(nothing(spark)).count() == 0 and rep.repeats(nothing(spark)).count() == 0
    assert sorted(mine(docs, 20), key=str) == sorted(brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 20), key=str)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(mine(docs, 200)) == sorted(brute([(r.doc_id, r.text) for r in docs.collect()], 200))


def test_whole_characters():
    raw = "aéb".encode()
    assert rep.whole_characters(raw, [(0, 2)]) == [(0, 1)] and rep.whole_characters(raw, [(2, 4)]) == [(3, 4)]
    assert rep.whole_characters(raw, [(1, 2)]) == [] and rep.cut_out(raw, [(1, 3)]) == b"ab"


def test_suffix_order():
    rng = random.Random(9)
    for length in (3, 8, 20):
        text = "".join(rng.choice("ab\xff") for _ in range(40)) * 12
        starts = rng.sample(range(len(text) - length + 1), 200)
        order, lcp = rep.suffix_order(text, starts, length)
        want = sorted(range(len(starts)), key=lambda i: text[starts[i] :][:length])
        assert order.tolist() == want
        keys = [text[starts[i] :][:length] for i in want]
        assert lcp.tolist() == [0] + [length * (a == b) for a, b in zip(keys, keys[1:])]


def test_suffix_order_holds_few_strings():
    text = "".join(map(chr, np.random.default_rng(3).integers(0, 256, 200_000)))
    starts = list(range(len(text) - 200))
    tracemalloc.start()
    rep.suffix_order(text, starts, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * len(text)  # 250 bytes a string if all are held at once
