import pytest

from hopgraph.functions.batches import map_batches
from hopgraph.operators import shape as G
from hopgraph.operators import traverse as T
from hopgraph.operators.graph import Graph
from hopgraph.plans.numbering import number_rows
from hopgraph.sources import edges as SE
from hopgraph.sources import tables as ST
from hopgraph.sources.datasets import load_graph, prepare_dataset
from tests import tiny


def _write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_clean_and_counts(spark):
    raw = tiny.pairs(spark, [(1, 2), (2, 1), (1, 2), (3, 3), (2, 3)])
    assert tiny.rows(G.clean(raw)) == [(1, 2), (2, 1), (2, 3), (3, 2)]
    assert G.has_loops(raw) and not G.has_loops(G.clean(raw))
    assert tiny.rows(G.counts(G.clean(raw))) == [(3, 2, 2 / 3)]
    assert tiny.rows(G.asymmetric(G.collapse(G.drop_loops(raw)))) == [(2, 3)]


def test_adjacency_round_trip_with_split_hub(spark):
    arcs = tiny.arcs_df(spark, "C")
    adj = G.to_adjacency(arcs, block=5)
    hub = adj.filter("id = 0").collect()
    assert len(hub) > 1 and all(r.parts == 4 for r in hub)
    assert tiny.rows(G.from_adjacency(adj)) == sorted(tiny.arcs("C"))


def test_hub_blocks_cover_all_arcs(spark):
    g = Graph.build(tiny.arcs_df(spark, "C"), hub_block=3)
    assert g.nodes.filter("id = 0").first().blks == 7
    assert g.hops.filter("src = 0").select("blk").distinct().count() > 2
    assert tiny.rows(g.arcs) == sorted(tiny.arcs("C"))


def test_bucketed_layout_gives_same_answers(spark, monkeypatch):
    from hopgraph.operators import graph as module

    monkeypatch.setattr(module, "BUCKET_ROWS", 10)
    g = Graph.build(tiny.arcs_df(spark, "A"), hub_block=4)
    assert "hopgraph_" in g.hops._jdf.queryExecution().analyzed().toString()
    got = {(r.src, r.id): r.d for r in T.all_pairs(g).collect()}
    assert got == {(u, v): d for u, row in tiny.apsp("A").items() for v, d in row.items()}


def test_number_rows(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 as k")
    assert [r.rn for r in number_rows(df, "k").orderBy("k").collect()] == list(range(1000))


def test_relabel_first_seen(spark):
    raw = spark.createDataFrame([(9, 4, 0), (4, 7, 1), (2, 9, 2)], "src bigint, dst bigint, at int")
    arcs, nodes = G.relabel(raw, "at")
    assert tiny.rows(nodes) == [(0, 9), (1, 4), (2, 7), (3, 2)]
    assert tiny.rows(arcs) == [(0, 1), (1, 2), (3, 0)]


def test_connect_components(spark):
    g = tiny.graph(spark, "D")
    joined = G.connect_components(g.edges, T.components(g), seed=1)
    assert joined.count() == 13
    assert T.is_connected(Graph.build(G.clean(joined)))


def test_edge_list_and_dataset(spark, tmp_path):
    path = _write(tmp_path, "e.txt", "# Nodes: 3\n5\t3\n\n3  8\n8 8\n3\t5\n4 4\n")
    assert tiny.rows(SE.read_edge_list(spark, path).select("src", "dst")) == [(3, 5), (3, 8), (4, 4), (5, 3), (8, 8)]
    out = str(tmp_path / "prepared")
    arcs, nodes = prepare_dataset(spark, path, "edge_list", out)
    assert tiny.rows(nodes) == [(0, 5), (1, 3), (2, 8)]
    assert tiny.rows(arcs) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    again, _ = prepare_dataset(spark, path, "edge_list", out)
    assert again.count() == 4
    _, kept = prepare_dataset(spark, path, "edge_list", str(tmp_path / "p2"), drop_isolated_nodes=False)
    assert tiny.rows(kept) == [(0, 5), (1, 3), (2, 8), (3, 4)]
    assert load_graph(spark, str(tmp_path / "p2")).n == 4


def test_malformed_rows(spark, tmp_path):
    path = _write(tmp_path, "bad.txt", "1 2\n1 x\n3 4 5\n")
    with pytest.raises(Exception, match="malformed row"):
        SE.read_edge_list(spark, path).collect()
    assert tiny.rows(SE.read_edge_list(spark, path, mode="drop").select("src", "dst")) == [(1, 2)]


def test_csv_ego_adjacency_coo(spark, tmp_path):
    assert tiny.rows(SE.read_edge_csv(spark, _write(tmp_path, "b.csv", "1,176\n1,233\n"))) == [(0, 175), (0, 232)]
    ego = tmp_path / "ego"
    ego.mkdir()
    (ego / "107.edges").write_text("3 5\n5 9\n")
    got = tiny.rows(SE.read_ego_networks(spark, str(ego)).select("src", "dst").distinct())
    assert got == [(3, 5), (3, 107), (5, 9), (5, 107), (9, 107)]
    adj = _write(tmp_path, "adj.txt", "0 1 2 2\n1 0\n")
    assert tiny.rows(SE.read_adjacency(spark, adj)) == [(0, 1), (0, 2), (1, 0)]
    assert SE.read_adjacency(spark, adj, unique=False).count() == 4
    cells = spark.createDataFrame([(0, 1, 1.0), (1, 0, 0.0)], "i bigint, j bigint, v double")
    assert tiny.rows(SE.from_coo(cells)) == [(0, 1)]


def test_edges_once(spark, tmp_path):
    assert SE.write_edges_once(tiny.arcs_df(spark, "A"), str(tmp_path / "once")) == 14
    with pytest.raises(ValueError):
        SE.write_edges_once(tiny.pairs(spark, [(1, 2)]), str(tmp_path / "half"))


def test_node_tables(spark, tmp_path):
    assert tiny.rows(ST.read_labels(spark, _write(tmp_path, "l.csv", "1,3\n2,4\n1,5\n"))) == [(0, 5), (1, 4)]
    scores = ST.read_scores(spark, _write(tmp_path, "s.txt", "17-0.25\n3-1e-05\n"))
    assert tiny.rows(scores) == [(3, 1e-05), (17, 0.25)]
    ST.require_one_per_node(scores, tiny.ids(spark, 3, 17))
    with pytest.raises(ValueError):
        ST.require_one_per_node(scores, tiny.ids(spark, 3, 4, 17))
    assert tiny.rows(ST.read_positional_scores(spark, _write(tmp_path, "p.txt", "1\n3\n4\n"))) == [(0, 0.125), (1, 0.375), (2, 0.5)]
    assert tiny.rows(ST.merge_scores(scores.union(scores))) == [(3, 2e-05), (17, 0.5)]


def test_pairs_and_ranges(spark, tmp_path):
    path = _write(tmp_path, "pairs", "3,9,2.0\ntensor(3),tensor(10),1.0\n4,5,-1\n")
    want = [(3, 9, 2.0), (3, 10, 1.0), (4, 5, -1.0)]
    assert tiny.rows(ST.read_pairs(spark, path)) == sorted(want)
    ST.normalise_pairs(spark, path, str(tmp_path / "clean"))
    assert tiny.rows(ST.read_pairs(spark, str(tmp_path / "clean"))) == sorted(want)
    text = "3,9,3&9&2@3&8&1@9&3&2@"
    ranges = ST.read_ranges(spark, _write(tmp_path, "r.txt", text + "\n"))
    assert [tuple(x) for x in ranges.first().rng] == [(3, 9, 2), (3, 8, 1), (9, 3, 2)]
    ST.write_ranges(ranges, str(tmp_path / "r2"))
    assert spark.read.text(str(tmp_path / "r2")).first().value == text


def test_embedding_forms(spark, tmp_path):
    want = [(0, [0.1, 0.2, 0.3]), (1, [0.4, 0.5, 0.6])]
    head = _write(tmp_path, "h.txt", "2 3\n0 0.1 0.2 0.3\n1 0.4 0.5 0.6\n")
    emb = ST.read_embedding(spark, head)
    assert tiny.rows(emb) == want
    assert tiny.rows(ST.read_embedding(spark, _write(tmp_path, "r.txt", "0.1 0.2 0.3\n0.4 0.5 0.6\n"), "rows")) == want
    assert tiny.rows(ST.read_embedding(spark, _write(tmp_path, "c.csv", "0,0.1,0.2,0.3\n1,0.4,0.5,0.6\n"), "csv")) == want
    ST.write_embedding(emb, str(tmp_path / "w"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "w")).collect()]
    assert "2 3" in lines and len(lines) == 3
    assert tiny.rows(ST.read_embedding(spark, str(tmp_path / "w"))) == want


def test_logs_walks_answers(spark, tmp_path):
    log = ST.read_train_log(spark, _write(tmp_path, "log", "0,12.5,13.1\n1,11.0\n"))
    assert tiny.rows(log.select("run", "epoch", "train")) == [("log", 0, 12.5), ("log", 1, 11.0)]
    assert [r.val for r in log.orderBy("epoch").collect()] == [13.1, None]
    walks = ST.read_walks(spark, _write(tmp_path, "walks", "4 5 6 7\n1 2\n"))
    assert tiny.rows(walks) == [(1, 1, [1, 2]), (4, 0, [4, 5, 6, 7])]
    answers = spark.createDataFrame([(3, 9, 2), (3, 10, 2)], "src bigint, dst bigint, d int")
    ST.write_answers(answers, str(tmp_path / "a"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "a")).collect()) == ["3#9-10", "3-10-2", "3-9-2"]
    long = spark.createDataFrame([("m", "x", 1.0), ("m", "y", 2.0)], "model string, metric string, value double")
    ST.write_matrix(long, str(tmp_path / "m"), "model", "metric", "value", ["x", "y"])
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["model,x,y", "m,1.0,2.0"]


def test_map_batches(spark):
    out = map_batches(spark.range(100), lambda pdf, k: pdf.assign(y=pdf["id"] * k), "id bigint, y bigint", k=3)
    assert out.agg({"y": "sum"}).first()[0] == 3 * 4950
