import pytest

from hopgraph.operators.oracles.ado import ApproxOracle
from hopgraph.operators.oracles.coords import AdjacentExactOracle, CoordinateOracle
from hopgraph.operators.oracles.labels import LabelOracle, node_order, sampled_tree_order
from hopgraph.operators.oracles.landmark import LandmarkOracle, choose_landmarks
from tests import tiny


def _pairs(ap):
    return [(u, v) for u in ap for v in ap]


def test_landmark_bounds(spark):
    g, ap = tiny.graph(spark, "B"), tiny.apsp("B")
    o = LandmarkOracle.build(g, 3)
    df = tiny.pairs(spark, _pairs(ap))
    for r in o.query(df).collect():
        assert r.est >= ap[r.src][r.dst]
    for r in o.lower(df).collect():
        assert r.est <= ap[r.src][r.dst]


def test_landmarks_keyed_per_component(spark):
    g = tiny.graph(spark, "D")
    got = {(r.src, r.dst): r.est for r in LandmarkOracle.build(g, 4).query(tiny.pairs(spark, [(0, 3), (7, 9)])).collect()}
    assert got[(0, 3)] is None and got[(7, 9)] == 2


@pytest.mark.parametrize("margin", [1, 2])
def test_margin_choice_is_greedy(spark, margin):
    g, ap, adj = tiny.graph(spark, "B"), tiny.apsp("B"), tiny.adjacency("B")
    order = sorted(ap, key=lambda v: (-len(adj[v]), v))
    want = []
    for v in order:
        if len(want) < 4 and all(ap[v][w] > margin for w in want):
            want.append(v)
    want += [v for v in order if v not in want][: 4 - len(want)]
    assert {r.id for r in choose_landmarks(g, 4, margin=margin).collect()} == set(want)


def _canonical(ap, rank):
    pos = {v: i for i, v in enumerate(rank)}
    out = set()
    for h in ap:
        for v, d in ap[h].items():
            if not any(pos[k] < pos[h] and k in ap[v] and ap[h][k] + ap[k][v] <= d for k in ap[h]):
                out.add((v, h, d))
    return out


@pytest.mark.parametrize("name", ["A", "D"])
@pytest.mark.parametrize("first,growth", [(1, 2), (4, 8), (100, 2)])
def test_labels_are_canonical_for_any_batching(spark, name, first, growth):
    g, ap, adj = tiny.graph(spark, name), tiny.apsp(name), tiny.adjacency(name)
    o = LabelOracle.build(g, first=first, growth=growth)
    rank = sorted(ap, key=lambda v: (-len(adj[v]), v))
    got = {(r.id, r.hub, r.d) for r in o.tables["labels"].collect()}
    assert got == _canonical(ap, rank)
    if name == "A":
        assert len(got) == 33
        assert [r.id for r in node_order(g).orderBy("rk").collect()] == [3, 7, 8, 4, 1, 5, 6, 9, 10, 0, 2]
    answers = o.query(tiny.pairs(spark, _pairs(ap))).collect()
    assert all(r.est == ap[r.src].get(r.dst, 9999) for r in answers)


def test_tree_order_gives_exact_labels(spark):
    g, ap = tiny.graph(spark, "B"), tiny.apsp("B")
    order = sampled_tree_order(g, roots=4, per_round=2)
    assert sorted(r.rk for r in order.collect()) == list(range(15))
    o = LabelOracle.build(g, order=order)
    assert all(r.est == ap[r.src][r.dst] for r in o.query(tiny.pairs(spark, _pairs(ap))).collect())


@pytest.mark.parametrize("k", [2, 3])
@pytest.mark.parametrize("name", ["B", "C"])
def test_approximate_oracle_bounds(spark, name, k):
    g, ap = tiny.graph(spark, name), tiny.apsp(name)
    for r in ApproxOracle.build(g, k, seed=3).query(tiny.pairs(spark, _pairs(ap))).collect():
        d = ap[r.src][r.dst]
        assert d <= r.est <= (2 * k - 1) * d


def test_coordinates(spark):
    g, ap = tiny.graph(spark, "B"), tiny.apsp("B")
    df = tiny.pairs(spark, _pairs(ap))
    rows = [r for r in CoordinateOracle.build(g, landmarks=8, init_sz=6, dim=5).query(df).collect() if ap[r.src][r.dst] > 1]
    err = sum(abs(r.est - ap[r.src][r.dst]) for r in rows) / len(rows)
    assert err < 1.0
    exact = {(r.src, r.dst): r.est for r in AdjacentExactOracle.build(g, landmarks=8, init_sz=6, dim=5).query(df).collect()}
    assert exact[(3, 3)] == 0 and exact[(3, 0)] == 1


def test_save_reload_and_footprint(spark, tmp_path):
    g = tiny.graph(spark, "A")
    path = str(tmp_path / "lm")
    calls = []

    def build():
        calls.append(1)
        return LandmarkOracle.build(g, 2)

    first = LandmarkOracle.obtain(spark, path, build)
    again = LandmarkOracle.obtain(spark, path, build)
    assert len(calls) == 1
    df = tiny.pairs(spark, [(0, 5), (2, 10)])
    assert tiny.rows(first.query(df)) == tiny.rows(again.query(df))
    rows, size = again.footprint(path)
    assert rows == 11 and size > 0
    LandmarkOracle.obtain(spark, path, build, force=True)
    assert len(calls) == 2
