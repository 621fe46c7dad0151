"""Searches inside a worker give the rows of the searches by joins."""

import pytest
from pyspark.sql import functions as F

from hopgraph.operators import held
from hopgraph.operators import stats as S
from hopgraph.operators import traverse as T
from hopgraph.operators import walk as K
from hopgraph.operators.graph import Graph
from hopgraph.operators.shape import clean
from tests import tiny


@pytest.fixture
def small(monkeypatch):
    """Tiny graphs are held as well, in ranges of few nodes and blocks of few sources."""
    monkeypatch.setattr(held, "LEAST", 0)
    monkeypatch.setattr(held, "RANGE", 4)
    monkeypatch.setattr(held, "LONG", 2)


def _every(spark, g):
    both = g.nodes.select(F.col("id").alias("src")).crossJoin(g.nodes.select(F.col("id").alias("dst")))
    odd = spark.createDataFrame([(None, 1), (1, None), (99, 99), (0, 99)], "src bigint, dst bigint")
    return both.union(odd)


def _graph(spark, name):
    """A graph of its own, as the tests' shared ones keep what was held."""
    return Graph.build(tiny.arcs_df(spark, name), hub_block=4)


@pytest.mark.parametrize("name", ["A", "B", "C", "D"])
def test_distances_and_paths(spark, small, monkeypatch, name):
    g = _graph(spark, name)
    pairs = _every(spark, g)
    forms = [T.pair_distances, T.shortest_paths, T.enumerate_paths, lambda g, p: T.pair_distances(g, p, max_hops=2)]
    here = [sorted(map(str, f(g, pairs).collect())) for f in forms]
    monkeypatch.setattr(held, "MOST", 0)
    assert not held.fits(g) and here == [sorted(map(str, f(g, pairs).collect())) for f in forms]


@pytest.mark.parametrize("name", ["B", "D"])
def test_centralities(spark, small, monkeypatch, name):
    g = _graph(spark, name)
    forms = [S.sp_share, S.tree_betweenness, lambda g: S.sp_share(g, tiny.ids(spark, 3, 4)), lambda g: S.tree_betweenness(g, tiny.ids(spark, 0, 8))]
    here = [{r[0]: r[1] for r in f(g).collect()} for f in forms]
    monkeypatch.setattr(held, "MOST", 0)
    for got, f in zip(here, forms, strict=True):
        assert got == pytest.approx({r[0]: r[1] for r in f(g).collect()})


@pytest.mark.parametrize("name,diam,rad", [("A", 4, 2), ("B", 4, 3), ("F", 5, 3)])
def test_open_eccentricities_take_one_round(spark, small, monkeypatch, name, diam, rad):
    rounds = []
    bounds = S._bounds_from
    monkeypatch.setattr(S, "_bounds_from", lambda *a: rounds.append(1) or bounds(*a))
    g, ap = _graph(spark, name), tiny.apsp(name)
    got, *ends = S.eccentricity_bounds(g, batch=1)
    assert ends == [diam, rad] and len(rounds) == 1
    assert all(r.lo <= max(ap[r.id].values()) <= r.up for r in got.collect())


def test_many_paths_come_in_parts(spark, small, monkeypatch):
    """Four layers of seven nodes: 7^3 ways from end to end, a few at a time, without a join row per arc and source."""
    monkeypatch.setattr(held, "SLICE", 40)
    monkeypatch.setattr(T.Sweep, "__init__", lambda *a, **k: pytest.fail("searched by joins"))
    layers = [[100 + a] if a in (0, 4) else [10 * a + i for i in range(7)] for a in range(5)]
    arcs = [(u, v) for a, b in zip(layers, layers[1:]) for u in a for v in b]
    g = Graph.build(clean(tiny.pairs(spark, arcs)))
    paths = {tuple(r.path) for r in T.enumerate_paths(g, tiny.pairs(spark, [(100, 104)])).collect()}
    assert len(paths) == 343 and all(p[0] == 100 and p[-1] == 104 and len(p) == 5 for p in paths)
    share = {r.id: r.share for r in S.sp_share(g, tiny.ids(spark, 100)).collect()}
    assert share[100] == 1.0 and share[104] == pytest.approx(343 / (7 + 49 + 343 + 343))


def test_labels_of_a_long_chain():
    import numpy as np

    by = np.random.default_rng(0).permutation(3000)
    near = [[] for _ in by]
    for a, b in zip(by, by[1:]):
        if {a, b} != {by[1499], by[1500]}:
            near[a].append(b)
            near[b].append(a)
    start = np.concatenate([[0], np.cumsum([len(x) for x in near])])
    label = held._labels(start, np.concatenate(near).astype(np.int32))
    assert set(label[by[:1500]]) == {by[:1500].min()} and set(label[by[1500:]]) == {by[1500:].min()}


def test_profile_searches_pairs_of_its_walks(spark, monkeypatch):
    """A search from every root to all that it reaches had rows with the square of the nodes."""
    g = tiny.graph(spark, "B")
    typed = K.walks(g, g.nodes, "gen", 1, 4).withColumn("type", F.lit("gen"))
    asked = []
    find = K.pair_distances
    monkeypatch.setattr(K, "pair_distances", lambda g, p: asked.append(p.select("src", "dst").distinct().count()) or find(g, p))
    prof = {r.pos: r.max_d for r in K.profile(g, typed).collect()}
    assert prof[0] == 0 and prof[1] == 1 and asked[0] <= 4 * g.n < g.n * g.n


def test_landmarks_share_rows(spark, monkeypatch):
    monkeypatch.setattr(T.Sweep, "advance", lambda *a, **k: pytest.fail("a row per landmark and node"))
    g, ap = tiny.graph(spark, "D"), tiny.apsp("D")
    got = tiny.rows(T.landmark_table(g, tiny.ids(spark, 0, 3, 8)))
    assert got == sorted((s, v, d) for s in (0, 3, 8) for v, d in ap[s].items())


def test_landmarks_among_themselves_end_early(spark, monkeypatch):
    """Three landmarks at one end of a chain need two levels, not all of it."""
    from hopgraph.operators import sample as P

    monkeypatch.setattr(T, "all_distances", lambda *a: pytest.fail("searched the whole chain"))
    levels = []
    advance = T.Sweep.advance
    monkeypatch.setattr(T.Sweep, "advance", lambda self, *a, **k: levels.append(1) or advance(self, *a, **k))
    g = Graph.build(clean(spark.range(40).selectExpr("id as src", "id + 1 as dst").union(spark.range(60, 62).selectExpr("id", "id + 1"))))
    rows = P.landmark_inner_pairs(g, tiny.ids(spark, 0, 1, 2))
    assert tiny.rows(rows) == sorted((a, b, abs(a - b)) for a in range(3) for b in range(3) if a != b) and len(levels) == 2
    assert tiny.rows(P.landmark_inner_pairs(g, tiny.ids(spark, 60, 5), self_pairs=True)) == [(5, 5, 0), (60, 60, 0)]
