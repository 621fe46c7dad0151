import math
import random

import pytest

import hopgraph.llm.topk as topk


def brute(queries, rows, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in queries:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            asked.setdefault(i, [math.floor(256 * x) for x in v])
    out = set()
    for q, a in asked.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("block", [1024, 3])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = random.Random(block)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(40)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # one third are copies
    rows += [(2000, None), (2001, []), (2002, [None] * 40), (2003, [float("nan")] * 40), (None, [0.1] * 40)]
    rows += [(2004, [float("inf")] + [0.0] * 39), (2005, [1.0, 2.0]), (2006, [0.5, -0.5]), (2007, [0.0] * 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "2 as score")
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    queries = df.filter("vec_id % 20 = 0 or vec_id > 1990")
    got = topk.top_k(queries, df, 5).collect()
    assert len(got) == len({(r.query_id, r["rank"]) for r in got})
    want = brute([r for r in exact if r[0] is not None and (r[0] % 20 == 0 or r[0] > 1990)], exact, 5)
    assert {tuple(r) for r in got} == want
    assert topk.top_k(queries.filter("vec_id < 0"), df).count() == 0
    assert topk.top_k(queries, df.filter("vec_id < 0")).count() == 0


def test_real_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {tuple(r) for r in topk.top_k(df.filter("vec_id % 50 = 0"), df).collect()}
    assert got == brute([r for r in exact if r[0] % 50 == 0], exact, 5)
