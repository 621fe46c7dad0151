"""Huffman codes against a heap, and skip-gram with hierarchical softmax on small walks."""

import heapq
import math

import numpy as np
import pytest

from hopgraph.operators.softmax import SoftmaxSkipgram, code_table


def cheapest(weights):
    heap, cost = list(weights), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


@pytest.mark.parametrize("weights", [[1, 1, 2, 3, 5, 8, 13, 21], [5] * 7, [0, 0, 0, 1, 9], [1, 1000], [3], []])
def test_codes(spark, weights):
    got = code_table(spark.createDataFrame(list(enumerate(weights)), "id bigint, cnt bigint")).collect()
    assert sorted((r.id, r.cnt) for r in got) == list(enumerate(weights))
    words = {tuple(s.bit for s in r.path) for r in got}
    assert len(words) == len(weights)
    assert sum(r.cnt * len(r.path) for r in got) == cheapest(weights)
    if len(weights) > 1:
        assert sum(2.0 ** -len(r.path) for r in got) == 1
        assert len({s.node for r in got for s in r.path}) == len(weights) - 1
        root = {r.path[0].node for r in got}
        assert root == {2 * len(weights) - 2}


def test_training(spark):
    rows = [([1, 2, 3, 1, 2] if i % 2 else [11, 12, 13, 11, 12],) for i in range(20)] + [([99],)]
    walks = spark.createDataFrame(rows, "path array<bigint>")
    fits = [SoftmaxSkipgram.fit(walks, 4, 2, iters=k, block=b) for k, b in ((0, 100), (8, 100), (8, 2))]
    assert fits[0].loss() == pytest.approx(math.log(2))
    assert fits[1].loss() < 0.9 * math.log(2)
    one, split = ({r.id: r.v for r in f.vectors.collect()} for f in fits[1:])
    assert set(one) == {1, 2, 3, 11, 12, 13, 99}
    assert fits[2].spread.filter("parts > 1").count() > 0
    for k in one:
        assert np.allclose(one[k], split[k])
    assert one[99] == {r.id: r.v for r in fits[0].vectors.collect()}[99]

    pairs = spark.createDataFrame([(u, v) for u in (1, 11) for v in one], "u bigint, v bigint")
    for f in fits[1:]:
        p = {(r.u, r.v): math.exp(r.lp) for r in f.log_probability(pairs).collect()}
        assert sum(p[1, v] for v in one) == pytest.approx(1)
        assert p[1, 2] > p[1, 12] and p[11, 12] > p[11, 2]
