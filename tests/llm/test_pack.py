import random
import zlib

import numpy as np

from hopgraph.llm.pack import END_ID, UNIT, pack, public_paths, solve, token_ids
from tests.llm.edge import documents, nothing

FULL, RANKS = public_paths()


def test_patterns_hold_the_demand_and_waste_little():
    rng = random.Random(1)
    demand = {s: rng.randint(0, 400) for s in rng.sample(range(1, 129), 60)}
    patterns = solve(demand, 256)
    held = {}
    for pattern, copies in patterns:
        assert copies > 0 and sum(s * n for s, n in pattern.items()) <= 256
        for s, n in pattern.items():
            held[s] = held.get(s, 0) + n * copies
    assert held == {s: n for s, n in demand.items() if n}
    used = sum(s * n for s, n in demand.items())
    assert sum(c for _, c in patterns) <= 1.01 * used / 256 + 1
    assert solve({}, 256) == [] and solve({5: 1}, 256) == [({5: 1}, 1)]


def test_ranks_give_the_tokenizers_ids(spark):
    hard = ["<|endoftext|> and <|x|>", "a" * 9000, " " * 9000 + "x", "\n\n \t", "don't 123 ½ ï  \U0001f600\x00", ""]
    texts = hard + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in texts:
        assert token_ids(t, FULL, RANKS) == token_ids(t, FULL, None)


def check(rows, texts):
    """Every id once, gapless offsets, within the capacity, little padding."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    want = {}
    for doc_id, text in texts:
        ids = [*token_ids(text or "", FULL, None), END_ID]
        want.setdefault(doc_id, []).append(ids)
    assert by_doc.keys() == want.keys()
    for doc_id, some in want.items():
        got = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[doc_id])
        cut = sorted(
            (at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes()), len(ids))
            for ids in some
            for at in range(0, len(ids), 2048)
        )
        assert got == cut
    for some in by_seq.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_pieces_tile_documents_and_sequences(spark):
    docs = documents(spark)
    check(pack(docs, FULL, RANKS).collect(), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert pack(nothing(spark), FULL, RANKS).count() == 0
    kept = pack(docs, FULL, RANKS, with_ids=True).filter("length <> size(ids)")
    assert kept.count() == 0


def test_real_texts_pack_tightly(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pack(docs, FULL, RANKS).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    n = 1 + max(r.sequence_id for r in rows)
    assert n * 2048 <= 1.02 * sum(r.length for r in rows) + 2048
    assert 2048 % UNIT == 0
