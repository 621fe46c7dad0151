import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopgraph.functions.vectors import sq_l2
from hopgraph.operators import classify as N
from hopgraph.operators import coarsen as H
from hopgraph.operators import embed as E
from hopgraph.operators import evaluate as V
from hopgraph.operators import held
from hopgraph.operators import predict as D
from hopgraph.operators import route as R
from hopgraph.operators import sample as P
from hopgraph.operators import traverse as T
from hopgraph.operators.graph import Graph
from hopgraph.operators.oracles import learned as L
from hopgraph.operators.oracles.labels import LabelOracle
from hopgraph.operators.oracles.landmark import LandmarkOracle, pack
from hopgraph.operators.shape import clean
from tests import tiny


# ---------------------------------------------------------------- embeddings
def _laplacian(adj, n):
    a = np.zeros((n, n))
    for u in adj:
        for w in adj[u]:
            a[u, w] = 1
    d = a.sum(1)
    return np.eye(n) - a / np.sqrt(np.outer(d, d)), np.eye(n) - a / d[:, None]


def test_spectral_embeddings(spark):
    g, adj = tiny.graph(spark, "B"), tiny.adjacency("B")
    sym, rw = _laplacian(adj, 15)
    emb, values = E.laplacian_eigenmaps(g, 2, iters=40)
    x = np.array([r.v for r in emb.orderBy("id").collect()])
    assert np.linalg.norm(sym @ x - x * values) < 0.05
    assert values == pytest.approx(np.sort(np.linalg.eigvalsh(sym))[1:3], abs=1e-2)
    _, sing = E.locally_linear(g, 1, iters=25)
    assert sing[0] == pytest.approx(np.sort(np.linalg.svd(rw)[1])[1], abs=0.1)


def test_spectral_embeddings_are_found(spark, monkeypatch):
    """Left to themselves both end at the eigenvectors: small residuals and the exact values."""
    monkeypatch.setattr(held, "LEAST", 0)
    monkeypatch.setattr(E, "GUARD", 2)
    g, adj = Graph.build(tiny.arcs_df(spark, "B"), hub_block=4), tiny.adjacency("B")
    sym, rw = _laplacian(adj, 15)
    for find, matrix in ((E.laplacian_eigenmaps, sym), (E.locally_linear, rw.T @ rw)):
        emb, values = find(g, 3)
        x = np.array([r.v for r in emb.orderBy("id").collect()])
        want = np.sort(np.linalg.eigvalsh(matrix))[1:4]
        values = values if matrix is sym else values**2
        assert values == pytest.approx(want, abs=1e-6)
        assert np.linalg.norm(matrix @ x - x * values) < 1e-3 and x.T @ x == pytest.approx(np.eye(3), abs=1e-6)


def test_spectral_embeddings_of_a_ring(spark, monkeypatch):
    """More nodes than columns, small gaps: six plain steps leave residuals of a random block."""
    ring = spark.range(60).selectExpr("id as src", "(id + 1) % 60 as dst").union(spark.range(60).selectExpr("id", "(id * 7 + 3) % 60"))
    g = Graph.build(clean(ring), hub_block=4)
    a = np.zeros((60, 60))
    for r in g.arcs.collect():
        a[r.src, r.dst] = 1
    d = a.sum(1)
    sym = np.eye(60) - a / np.sqrt(np.outer(d, d))
    monkeypatch.setattr(E, "GUARD", 2)
    monkeypatch.setattr(held, "LEAST", 0)
    emb, values = E.laplacian_eigenmaps(g, 2)
    x = np.array([r.v for r in emb.orderBy("id").collect()])
    assert values == pytest.approx(np.sort(np.linalg.eigvalsh(sym))[1:3], abs=1e-6)
    assert np.linalg.norm(sym @ x - x * values) < 1e-4


@pytest.mark.parametrize("dim", [2, 3])
def test_spectral_embeddings_of_components(spark, monkeypatch, dim):
    """Three components (and a node without arcs) have three exact vectors; a fourth is iterated."""
    monkeypatch.setattr(held, "LEAST", 0)
    g = Graph.build(tiny.arcs_df(spark, "D"), tiny.ids(spark, *range(13)), hub_block=4)
    adj = tiny.adjacency("D")
    a = np.zeros((13, 13))
    for u in adj:
        for w in adj[u]:
            a[u, w] = 1
    d = np.maximum(a.sum(1), 1)
    sym, m = np.eye(13) - a / np.sqrt(np.outer(d, d)), np.eye(13) - a / d[:, None]
    for find, matrix, trivial in ((E.laplacian_eigenmaps, sym, np.sqrt(a.sum(1))), (E.locally_linear, m.T @ m, a.sum(1) > 0)):
        emb, values = find(g, dim)
        x = np.array([r.v for r in emb.orderBy("id").collect()])
        values = values if matrix is sym else values**2
        assert values == pytest.approx(np.sort(np.linalg.eigvalsh(matrix))[1 : dim + 1], abs=1e-6)
        assert np.linalg.norm(matrix @ x - x * values) < 1e-3 and np.abs(trivial @ x).max() < 1e-6
        assert x.T @ x == pytest.approx(np.eye(dim), abs=1e-6)


def test_factorise_and_squared_distance_improve(spark):
    g, ap = tiny.graph(spark, "B"), tiny.apsp("B")
    arcs = g.edges

    def gf_loss(e):
        return E.reconstruct(e, arcs, "dot").agg(F.avg((1 - F.col("weight")) ** 2)).first()[0]

    assert gf_loss(E.factorise(g, 4, iters=8, rate=0.3)) < gf_loss(E.random_vectors(g.nodes, 4, 0, 0.5))
    table = spark.createDataFrame([(u, v, d) for u in (3, 4) for v, d in ap[u].items() if d], "src bigint, dst bigint, d int")
    start = E.random_vectors(g.nodes, 3)

    def sq_loss(e):
        rows = D.closed_scores(table, e)
        return rows.agg(F.avg((F.col("sq_l2") - F.col("d") * F.col("d")) ** 2)).first()[0]

    assert sq_loss(E.fit_squared_distance(table, start, 3, 8)) < sq_loss(start)


def test_scores_of_both_directions(spark):
    """Both directions, repeated pairs, repeated ids, equal, null and vectorless ends; other columns stay."""
    from hopgraph.functions.vectors import dot

    emb = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (2, [5.0, 6.0]), (3, [7.0, 8.0])], "id bigint, v array<double>")
    rows = [(1, 2, "a"), (2, 1, "b"), (1, 3, "c"), (1, 3, "c"), (1, 1, "d"), (1, 9, "e"), (None, 1, "f"), (1, None, "g")]
    pairs = spark.createDataFrame(rows, "src bigint, dst bigint, tag string")
    got = D.score_pairs(pairs, emb, x=dot(F.col("_a"), F.col("_b")))
    assert got.columns == ["src", "dst", "tag", "x"]
    want = [(1, 1, "d", 5.0), (1, 2, "a", 11.0), (1, 2, "a", 17.0), (1, 3, "c", 23.0), (1, 3, "c", 23.0), (2, 1, "b", 11.0), (2, 1, "b", 17.0)]
    assert tiny.rows(got) == want
    assert tiny.rows(D.closed_scores(pairs, emb).select("src", "dst", "tag", "dot")) == want


def test_skipgram(spark):
    walks = spark.createDataFrame([(i % 2, [i % 2 * 10 + j for j in (1, 2, 3, 1, 2)]) for i in range(30)], "root bigint, path array<bigint>")
    alone = spark.createDataFrame([(99, [99])], walks.schema)
    joined = {r.id: np.array(r.v) for r in E.skipgram(walks.union(alone), 4, 2, iters=10).collect()}
    assert set(joined) == {1, 2, 3, 11, 12, 13, 99}
    assert joined[1] @ joined[2] > joined[1] @ joined[12]


def test_vector_tables(spark):
    emb = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, float("nan")])], "id bigint, v array<double>")
    assert tiny.rows(E.nan_to_zero(emb)) == [(0, [1.0, 2.0]), (1, [3.0, 0.0])]
    assert tiny.rows(E.concat_embeddings(emb.limit(1), emb))[0][1] == [1.0, 2.0, 1.0, 2.0]
    nodes = tiny.ids(spark, 0, 1, 2)
    assert tiny.rows(E.missing_nodes(emb, nodes)) == [(2,)]
    assert E.fill_missing(emb, nodes, 2).count() == 3
    r = np.array([x.v for x in E.random_vectors(spark.range(2000), 4, gaussian=True).collect()])
    assert abs(r.mean()) < 0.05 and abs(r.std() - 1) < 0.05
    with pytest.raises(ValueError):
        E.embed(tiny.graph(spark, "A"), "nothing")
    for method in ("random", "gen"):
        assert E.embed(tiny.graph(spark, "A"), method, 4, walks=1, length=4, window=2).count() == 11


# ---------------------------------------------------------------- decoders
def _rows(spark, n=400):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 3))
    y = 1 + 2 * x[:, 0] - x[:, 1] + np.maximum(x[:, 2], 0)
    return spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "feat array<double>, d double")


def test_decoders_learn(spark):
    rows = _rows(spark)
    base = rows.agg(F.var_pop("d")).first()[0]

    def mse(df):
        return df.agg(F.avg((F.col("pred") - F.col("d")) ** 2)).first()[0]

    assert mse(D.LinearDecoder.fit(rows).predict(rows)) < 0.3 * base
    assert mse(D.BoostedDecoder.fit(rows, trees=5).predict(rows)) < 0.5 * base
    net = D.MLPDecoder.fit(rows, 3, hidden=16, epochs=8, rate=0.05, batch=32, parts=2, val=rows)
    assert net.log[-1][1] < net.log[0][1] and mse(net.predict(rows)) < 0.3 * base
    again = D.MLPDecoder.from_json(net.to_json())
    assert mse(again.predict(rows)) == pytest.approx(mse(net.predict(rows)))
    assert mse(L.StackedDecoder.fit(rows, net, trees=3).predict(rows)) < 0.5 * base


def test_best_epoch_snaps(spark):
    log = spark.createDataFrame(
        [("a", 3, 1.0, 0.1), ("a", 20, 1.0, 0.5), ("b", 14, 1.0, 0.1), ("c", 497, 1.0, 0.0), ("c", 499, 1.0, 1.0), ("d", 15, 1.0, 0.1)],
        "run string, epoch int, train double, val double",
    )
    assert tiny.rows(D.best_epoch(log)) == [("a", 3, 10), ("b", 14, 10), ("c", 497, 500), ("d", 15, 20)]


def test_predict_api_checks_lengths(spark):
    emb = E.random_vectors(tiny.ids(spark, 0, 1), 2)
    net = D.MLPDecoder(D._init_weights(4, 4, 0), 4, 4, False, [])
    assert D.predict_pairs(spark, net, emb, [0, 1], [1, 0]).count() == 2
    with pytest.raises(ValueError):
        D.predict_pairs(spark, net, emb, [0], [1, 0])


def test_learned_oracle_round_trip(spark, tmp_path):
    g, ap = tiny.graph(spark, "B"), tiny.apsp("B")
    o = L.centrality_oracle(g, L.CentralityWalk(dim=4, landmarks=4, per_root=1, length=4, out_walks=2, out_len=5, window=2, epochs=3))
    o.save(str(tmp_path / "o"))
    back = L.DecodedOracle.load(spark, str(tmp_path / "o"))
    pairs = tiny.pairs(spark, [(u, v) for u in ap for v in ap])
    got = {(r.src, r.dst): r.est for r in back.query(pairs).collect()}
    assert got[(3, 3)] == 0 and got[(3, 4)] == 1
    assert got == pytest.approx({(r.src, r.dst): r.est for r in o.query(pairs).collect()})


# ---------------------------------------------------------------- routes
@pytest.fixture(scope="module")
def routed(spark):
    g, ap = tiny.graph(spark, "B"), tiny.apsp("B")
    rows = [(i, u, v, ap[u][v]) for i, (u, v) in enumerate((u, v) for u in ap for v in ap)]
    q = spark.createDataFrame(rows, "qid bigint, src bigint, dst bigint, d int")
    return g, q, tiny.adjacency("B")


def _check_paths(rows, adj):
    for r in rows:
        assert r.path[0] == r.src and r.path[-1] == r.dst
        assert all(b in adj[a] for a, b in zip(r.path, r.path[1:]))


def test_beam_and_exact_routes(spark, routed):
    g, q, adj = routed
    _check_paths(R.exact_routes(g, q).collect(), adj)
    predict = R.oracle_predictor(LabelOracle.build(g))
    rows = R.beam_routes(g, q, predict, cap=2).join(q.select("qid", "d"), "qid").collect()
    assert len(rows) == 225
    _check_paths(rows, adj)
    assert all(len(r.path) - 1 >= r.d for r in rows)
    assert sum(len(r.path) - 1 == r.d for r in rows) > 200  # guided by exact distances
    err = V.route_error(R.beam_routes(g, q, predict, cap=2, adjacent=True, top_k=1).join(q.select("qid", "d"), "qid")).first()
    assert err.mre < 0.1 and err.hit_ratio > 0.95


def test_greedy_and_fallback(spark, routed):
    g, q, adj = routed
    some = q.filter("qid % 9 = 0")
    rows = R.greedy_routes(g, some, R.oracle_predictor(LabelOracle.build(g)), max_rounds=6).collect()
    assert len(rows) == some.count() and not any(r.failed for r in rows)
    _check_paths(rows, adj)
    worst = R.vector_predictor(E.random_vectors(g.nodes, 2), sq_l2)
    rows = R.greedy_routes(g, some, worst, cap=1, factor=-5.0, max_rounds=3).collect()
    _check_paths(rows, adj)
    assert any(r.failed for r in rows)


def _one_by_one(adj, src, dst, pred, cap, factor, limit):
    """Best-first search that expands one node at a time: path (None if it runs dry) and evaluations."""
    opened, parent, evals = [(pred[src, dst], src)], {src: None}, 0
    for _ in range(limit):
        if not opened:
            break
        at, cur = opened.pop(0)
        end = [dst] if dst in adj[cur] else [dst, *sorted(w for w in adj[cur] if dst in adj[w])[:1]]
        if dst in adj[cur] or len(end) == 2:
            back = [*end, cur]
            while parent[back[-1]] is not None:
                back.append(parent[back[-1]])
            return back[::-1], evals
        fresh = [w for w in adj[cur] if w not in parent]
        evals += len(fresh)
        for w in fresh:
            if pred[w, dst] < at - 1 + factor:
                parent[w] = cur
                opened.append((pred[w, dst], w))
        opened = sorted(opened)[:cap]
    return None, evals


@pytest.mark.parametrize("cap,factor,limit", [(200, 1.5, None), (2, 1.2, 4)])
def test_greedy_is_one_by_one(spark, routed, cap, factor, limit):
    g, q, adj = routed
    some = q.filter("qid % 5 = 0 and src <> dst")
    predict = R.vector_predictor(E.random_vectors(g.nodes, 2), sq_l2)
    every = g.nodes.select(F.col("id").alias("src")).crossJoin(g.nodes.select(F.col("id").alias("dst")))
    pred = {(r.src, r.dst): r.pred for r in predict(every).collect()}
    rows = R.greedy_routes(g, some, predict, cap=cap, factor=factor, max_rounds=limit).collect()
    assert len(rows) == some.count()
    for r in rows:
        path, evals = _one_by_one(adj, r.src, r.dst, pred, cap, factor, limit or 1000)
        assert (r.failed, r.evals) == (path is None, evals)
        assert path is None or r.path == path
    assert any(r.failed for r in rows) and not all(r.failed for r in rows)


def test_greedy_dry_lists_take_few_rounds(spark, monkeypatch):
    edges = [(0, i) for i in range(1, 42)] + [(41, 42), (42, 43), (43, 44)]
    g = Graph.build(spark.createDataFrame([p for a, b in edges for p in ((a, b), (b, a))], "src bigint, dst bigint"))
    q = spark.createDataFrame([(1, 0, 44)], "qid bigint, src bigint, dst bigint")

    def predict(rows):
        return rows.withColumn("pred", F.when(F.col("src") == 41, 100.0).otherwise(0.0))

    rounds = []
    expand = Graph.expand
    monkeypatch.setattr(Graph, "expand", lambda self, front: rounds.append(1) or expand(self, front))
    row = R.greedy_routes(g, q, predict).first()
    assert row.failed and row.path == [0, 41, 42, 43, 44] and row.evals == 41
    assert len(rounds) < 16


# ---------------------------------------------------------------- evaluation
def test_errors(spark):
    rows = spark.createDataFrame([(0, 5.0), (1, 2.0), (2, 2.0), (2, 4.0), (-1, 19.5)], "d int, pred double")
    got = {r.d: (r.mae, r.mre, r.cnt) for r in V.error_by_length(rows).collect()}
    assert got[1] == (1.0, 1.0, 1) and got[2] == (1.0, 0.5, 2) and got[None] == pytest.approx((1.0, 2 / 3, 3))
    o = V.online_error(rows).first()
    assert o.cnt == 5 and o.mae == pytest.approx((1 + 0 + 2 + 0) / 5)
    log = spark.createDataFrame(
        [("n", "p", "mae", 1.0, 1), ("n", "p", "mae", None, 3), ("n", "p", "mae", 2.0, 2)],
        "nid string, pid string, metric string, value double, seq bigint",
    )
    assert tiny.rows(V.upsert_metrics(log)) == [("n", "p", "mae", 2.0)]
    names = spark.createDataFrame([("walk~ring~7.log",)], "name string")
    assert tiny.rows(V.parse_names(names, r"^(\w+)~(\w+)~(\d+)", ["m", "s", "n"])) == [("walk~ring~7.log", "walk", "ring", "7")]
    assert len(V.one_at_a_time({"a": 1, "b": 2}, {"a": [1, 3], "b": [2, 4, 5]})) == 4
    table = V.sweep_settings(spark, [{"k": 1}, {"k": 2}], lambda s: {"x": s["k"] * 2})
    assert tiny.rows(table.select("run", "value")) == [(0, 2.0), (1, 4.0)]


def test_oracle_evaluation(spark, tmp_path):
    g = tiny.graph(spark, "A")
    truth = P.classical_pairs(g, 3)
    exact = V.online_eval(LabelOracle.build(g), truth).first()
    assert exact.mae == 0 and exact.mre == 0
    off = V.offline_eval({"lm": lambda: LandmarkOracle.build(g, 2)}, spark, str(tmp_path)).first()
    assert off.rows == 11 and off.storage > 0
    t = V.bfs_time(g, 2).first()
    assert t.per_source > 0 and t.batched > 0


def test_order_preservation_of_perfect_line(spark):
    """Nodes of a path placed on a circle arc: nearer nodes have larger dot products."""
    emb = spark.createDataFrame([(i, [math.cos(i / 10), math.sin(i / 10)]) for i in range(9)], "id bigint, v array<double>")
    t = [(a, b, c, abs(a - b), abs(a - c)) for a in range(9) for b in range(9) for c in range(9)]
    triples = spark.createDataFrame(t, "a bigint, b bigint, c bigint, d_ab int, d_ac int")
    assert V.order_preservation(triples, emb).first().rate == 1.0


# ---------------------------------------------------------------- samples
def test_samples(spark):
    g, ap = tiny.graph(spark, "B"), tiny.apsp("B")
    rows = P.classical_pairs(g, 4, seed=2).collect()
    assert len(rows) == 60 and all(ap[r.src][r.dst] == r.d for r in rows)
    assert len({(r.src, r.dst) for r in rows}) == 60
    half = P.half_split_pairs(g).collect()
    assert len(half) == 7 and len({x for r in half for x in (r.src, r.dst)}) == 14
    near = P.range_rows(g, tiny.pairs(spark, [(0, 9), (4, 13)]), k=2, full_block=True).collect()
    assert all(ap[r.a][r.b] == r.d for r in near)
    assert P.negative_samples(P.train_pairs(T.landmark_table(g, tiny.ids(spark, 3))), g.nodes, g.n, 3).count() == 14 * 8
    b = P.batches(g.arcs, 8, F.xxhash64("src", "dst"), "src", "dst").groupBy("batch_id").count()
    assert [r["count"] for r in b.orderBy("batch_id").collect()] == [8] * 5


# ---------------------------------------------------------------- classification, coarsening
def test_classification(spark):
    rng = np.random.default_rng(1)
    pts = [(i, (rng.normal(size=2) + 4 * np.array([i % 3, i % 2])).tolist(), i % 3) for i in range(120)]
    df = spark.createDataFrame(pts, "id bigint, v array<double>, label int")
    multi = df.select("id", "label").union(df.filter("id % 6 = 0").select("id", F.lit(1)))
    out = N.protocol(df.select("id", "v"), multi, [0.5], 1)
    assert out.first().micro_f1 > 0.8
    assert N.score_matrix(out, [0.5]).first()["0.5"] == pytest.approx(out.first().micro_f1)
    split = N.split_share(df, 120, 0.5, 0)
    assert split.filter("train").count() == 60
    assert N.softmax_accuracy(df.select("id", "v"), df.select("id", "label"), split, 4, 3, 2).first().accuracy > 0.8
    masks = N.block_masks(df, 20, 10)
    assert masks.filter("train_mask").count() == 20 and masks.filter("val_mask").count() == 10


@pytest.mark.parametrize("growth", [0.0, 1.0])
def test_coarsening(spark, growth, tmp_path):
    g, adj = tiny.graph(spark, "B"), tiny.adjacency("B")
    seeds = [r.id for r in H.choose_seeds(g, 3).orderBy("rk").collect()]
    order = sorted(adj, key=lambda v: (-len(adj[v]), v))[:5]
    want = []
    for v in order:
        if not any(v in adj[w] for w in want):
            want.append(v)
    assert seeds == want
    hier = H.Hierarchy.build(g, 3, depth=2, proto_sz=2, growth=growth)
    level0 = {r.id: r.center for r in hier.level_nodes.filter("level = 0").collect()}
    assert set(level0) == set(adj) and all(level0[s] == s for s in want)
    up = {r.id: r.up_id for r in hier.level_nodes.filter("level = 0").collect()}
    arcs1 = {(r.src, r.dst) for r in hier.level_arcs.filter("level = 1").collect()}
    assert arcs1 == {(up[a], up[b]) for a, b in tiny.arcs("B") if up[a] != up[b]}
    for r in hier.climb(tiny.pairs(spark, [(0, 1), (0, 14), (5, 6)])).collect():
        if r.level == 0:
            assert level0[r.src] == level0[r.dst] == r.center
    hier.save(str(tmp_path / "h"))
    assert H.Hierarchy.load(spark, str(tmp_path / "h")).level_nodes.count() == hier.level_nodes.count()


def test_pack_keeps_missing(spark):
    g = tiny.graph(spark, "D")
    rows = {r.id: r.dv for r in pack(T.landmark_table(g, tiny.ids(spark, 0, 3)), [0, 3]).collect()}
    assert rows[2] == [1, None] and rows[6] == [None, 1]
