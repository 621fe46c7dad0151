"""Registered queries, second part: walks, vectors, decoders, routes, evaluation, classes, levels, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from hopgraph.functions.hashing import h, h_sql
from hopgraph.functions.vectors import dot
from hopgraph.operators import classify as N
from hopgraph.operators import coarsen as H
from hopgraph.operators import embed as E
from hopgraph.operators import evaluate as V
from hopgraph.operators import predict as D
from hopgraph.operators import route as R
from hopgraph.operators import sample as P
from hopgraph.operators import stats as C
from hopgraph.operators import traverse as T
from hopgraph.operators import walk as K
from hopgraph.operators.oracles import learned as L
from hopgraph.operators.oracles.coords import AdjacentExactOracle, CoordinateOracle
from hopgraph.operators.oracles.landmark import LandmarkOracle, pack
from hopgraph.plans import graphs
from hopgraph.plans import sqltext as S
from hopgraph.plans.catalogue import _UPPER, APSP, _classical, _text, _top, register
from hopgraph.plans.scratch import Scratch
from hopgraph.sources import edges as SE
from hopgraph.sources import tables as ST


# --------------------------------------------------------------------- walks (W)
@register(
    "star_walks",
    S.query(
        S.graph("supply") + ["r as (select src, dst, row_number() over (partition by src order by dst) as rn from arcs)"],
        "select src as root, src || '-' || string_agg(dst::varchar, '-' order by dst) as path from r where rn <= 9 group by src",
    ),
)
def star_walks(spark, sf):
    g = graphs.graph(spark, sf, "supply")
    return K.star_walks(g, g.nodes, 10).select("root", _text("path").alias("path"))


@register(
    "walk_frequency",
    S.query(
        S.graph("supply")
        + [
            "r as (select src, dst, row_number() over (partition by src order by dst) as rn from arcs)",
            "s as (select dst as id from r where rn <= 9 union all select id from nodes)",
        ],
        "select id, count(*) as freq from s group by id",
    ),
)
def walk_frequency(spark, sf):
    g = graphs.graph(spark, sf, "supply")
    return C.walk_frequency(K.star_walks(g, g.nodes, 10))


def _walks(kind, per_root=2, length=8, name="trade"):
    def run(spark, sf):
        g = graphs.graph(spark, sf, name)
        score, log_score = None, False
        rule = K.KINDS[kind] if isinstance(kind, str) else kind
        if rule.score and rule.decay is None:  # W6 weighs by log(1 + share of all shortest paths)
            score, log_score = C.sp_share(g).select("id", F.col("share").alias("score")), True
        elif rule.score:  # W7 by what landmarks tell
            score = C.landmark_centrality(T.landmark_table(g, _top(g, 64)))
        return K.walks(g, g.nodes, rule, per_root, length, score, log_score=log_score).select("root", "wid", _text("path").alias("path"))

    return run


register("walk_uniform")(_walks("uniform"))
register("walk_restart")(_walks(K.Rule(restart=0.15)))
register("walk_pq")(_walks("pq", 1, 6))
register("walk_self_avoiding")(_walks("gen", 2, 6))
register("walk_pq_avoiding")(_walks("bfs", 1, 6))
register("walk_surf")(_walks("surf"))
register("walk_bc")(_walks("bc", 1, 6, "supply"))
register("walk_bc_decay")(_walks("bc_decay", 2, 5, "supply"))


@register("walk_resampled")
def walk_resampled(spark, sf):
    g = graphs.graph(spark, sf, "trade")
    walked = K.walks(g, g.nodes, "gen", 1, 5)
    score = C.landmark_centrality(T.landmark_table(g, _top(g, 64)))
    out = K.resample(K.distance_bounds(g, walked), score, 0.5, 2, 10)
    return out.select("root", "wid", _text("path").alias("path"))


@register("walk_profile")
def walk_profile(spark, sf):
    g = graphs.graph(spark, sf, "link")
    typed = None
    for kind in ("uniform", "gen", "bfs", "surf"):
        part = K.walks(g, g.nodes, kind, 1, 6).select(F.lit(kind).alias("type"), "root", "path")
        typed = part if typed is None else typed.union(part)
    typed = Scratch(spark, "typed").cut(typed)
    return K.profile(g, typed).select("type", "pos", F.round("avg_d", 6).alias("avg_d"), "max_d")


@register("walk_coverage")
def walk_coverage(spark, sf):
    g = graphs.graph(spark, sf, "link")
    return K.coverage(K.walks(g, g.nodes, "gen", 2, 6).withColumn("type", F.lit("gen")))


# ----------------------------------------------------------------- embeddings (E)
def _emb(spark, sf):
    return graphs.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v")
    )


def _emb_stored(spark, sf):
    """Vectors as they are stored; half as wide, for operators that widen the components themselves."""
    return graphs.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


_VEC = "emb as (select vec_id as id, list_transform(embedding, lambda x: x::double) as v from embeddings)"


def _sum_by(expr: str) -> str:
    return f"list_sum(list_transform(range(1, 65), lambda i: {expr}))"


@register("emb_concat", S.query([_VEC], f"select id, len(v) * 2 as width, round({_sum_by('v[i] * i')} + {_sum_by('v[i] * (i + 64)')}, 6) as mark from emb"))
def emb_concat(spark, sf):
    e = _emb(spark, sf)
    both = E.concat_embeddings(e, e)
    mark = F.aggregate(
        F.zip_with("v", F.sequence(F.lit(1), F.lit(128)), lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x
    )
    return both.select("id", F.size("v").cast("bigint").alias("width"), F.round(mark, 6).alias("mark"))


@register(
    "emb_missing",
    S.query(S.graph("supply") + [_VEC], "select id from nodes where id not in (select id from emb)"),
)
def emb_missing(spark, sf):
    return E.missing_nodes(_emb(spark, sf), graphs.graph(spark, sf, "supply").nodes)


@register(
    "emb_size_check",
    S.query(S.graph("supply") + [_VEC], "select (select count(*) from emb) as vectors, (select count(*) from nodes) as nodes, (select count(*) from emb) = (select count(*) from nodes) as matches"),
)
def emb_size_check(spark, sf):
    return E.size_check(_emb(spark, sf), graphs.graph(spark, sf, "supply").nodes)


_SCORED = """scored as (select a.src, a.dst, list_dot_product(x.v, y.v) as dot,
  list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - y.v[i]) * (x.v[i] - y.v[i]))) as sq_l2,
  list_cosine_similarity(x.v, y.v) as cosine from arcs a join emb x on x.id = a.src join emb y on y.id = a.dst)"""


@register(
    "emb_scores",
    S.query(S.graph("follow") + [_VEC, _SCORED], "select src, dst, round(dot, 6) as dot, round(sq_l2, 6) as sq_l2, round(cosine, 6) as cosine from scored"),
)
def emb_scores(spark, sf):
    out = D.closed_scores(graphs.graph(spark, sf, "follow").arcs, _emb_stored(spark, sf))
    return out.select("src", "dst", *[F.round(c, 6).alias(c) for c in ("dot", "sq_l2", "cosine")])


@register(
    "emb_reconstruct",
    S.query(S.graph("follow") + [_VEC, _SCORED], "select src, dst, round(exp(-sq_l2), 6) as weight from scored"),
)
def emb_reconstruct(spark, sf):
    out = E.reconstruct(_emb_stored(spark, sf), graphs.graph(spark, sf, "follow").arcs)
    return out.select("src", "dst", F.round("weight", 6).alias("weight"))


@register(
    "neighbour_sum",
    S.query(
        S.graph("follow") + [_VEC],
        "select a.dst as id, i::int as pos, round(sum(x.v[i]), 6) as total from arcs a join emb x on x.id = a.src cross join range(1, 65) r(i) group by a.dst, i",
    ),
)
def neighbour_sum(spark, sf):
    out = E.neighbour_sum(graphs.graph(spark, sf, "follow").arcs, _emb(spark, sf), 64)
    return out.select("id", F.posexplode("v").alias("p", "total")).select(
        "id", (F.col("p") + 1).alias("pos"), F.round("total", 6).alias("total")
    )


_SCORE3 = h_sql(h_sql("src", 0) + " + dst", 1) + " % 3 - 1"


@register(
    "edge_softmax",
    S.query(
        S.graph("supply") + [f"sc as (select src, dst, exp({_SCORE3}) as x from arcs)"],
        "select src, dst, round(x / sum(x) over (partition by dst), 9) as share from sc",
    ),
)
def edge_softmax(spark, sf):
    arcs = graphs.graph(spark, sf, "supply").arcs.withColumn("score", E.hashed_score())
    return E.edge_softmax(arcs).select("src", "dst", F.round("share", 9).alias("share"))


@register(
    "landmark_vectors",
    S.query(
        S.graph("supply") + [S.top(8), S.bfs()],
        "select n.id, s.id as lm, coalesce(b.d, 0)::double as x from nodes n cross join seeds s left join bfs b on b.k = s.id and b.id = n.id where n.id in (select id from bfs)",
    ),
)
def landmark_vectors(spark, sf):
    g = graphs.graph(spark, sf, "supply")
    lms = [r.id for r in _top(g, 8).collect()]
    v = E.distance_vectors(pack(T.landmark_table(g, _top(g, 8)), lms))
    return v.select("id", F.explode(F.map_from_arrays(F.array(*[F.lit(x).cast("bigint") for x in lms]), "v")).alias("lm", "x"))


@register(
    "nan_cleaned",
    S.query([], "select vec_id as id, 64::bigint as width, round(list_sum(list_transform(embedding, lambda x: case when x > 0.2 then 0 else x::double end)), 6) as total from embeddings").replace("with recursive \n", ""),
)
def nan_cleaned(spark, sf):
    holed = _emb(spark, sf).select("id", F.transform("v", lambda x: F.when(x > 0.2, F.lit(float("nan"))).otherwise(x)).alias("v"))
    out = E.nan_to_zero(holed)
    return out.select("id", F.size("v").cast("bigint").alias("width"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def _emb_rows(emb, digits=6):
    return emb.select("id", F.size("v").alias("width"), F.round(F.sqrt(dot(F.col("v"), F.col("v"))), digits).alias("norm"))


@register("emb_pca")
def emb_pca(spark, sf):
    return _emb_rows(E.reduce_width(_emb(spark, sf), 8), 4)


@register("emb_random_filled")
def emb_random_filled(spark, sf):
    g = graphs.graph(spark, sf, "supply")
    return _emb_rows(E.fill_missing(_emb(spark, sf), g.nodes, 64))


@register("emb_skipgram")
def emb_skipgram(spark, sf):
    g = graphs.graph(spark, sf, "link")
    corpus = K.walks(g, g.nodes, "uniform", 4, 8)
    return _emb_rows(E.skipgram(corpus, 16, 3), 3)


@register("emb_skipgram_joined")
def emb_skipgram_joined(spark, sf):
    g = graphs.graph(spark, sf, "supply")
    return _emb_rows(E.skipgram(K.star_walks(g, g.nodes, 8), 8, 2, iters=3), 3)


@register("emb_laplacian")
def emb_laplacian(spark, sf):
    return _emb_rows(E.laplacian_eigenmaps(graphs.graph(spark, sf, "supply"), 4)[0], 3)


@register("emb_locally_linear")
def emb_locally_linear(spark, sf):
    return _emb_rows(E.locally_linear(graphs.graph(spark, sf, "trade"), 4)[0], 3)


@register("emb_factorised")
def emb_factorised(spark, sf):
    return _emb_rows(E.factorise(graphs.graph(spark, sf, "supply"), 8, iters=5), 4)


# ------------------------------------------------------------------- decoders (D)
def _trained(spark, sf, k=8):
    """Landmark pairs of the link graph with landmark-distance features."""
    g = graphs.graph(spark, sf, "link")
    lms = [r.id for r in _top(g, k).collect()]
    scratch = Scratch(spark, "trained")
    table = scratch.cut(T.landmark_table(g, _top(g, k)))
    emb = scratch.cut(E.distance_vectors(pack(table, lms)))
    return g, emb, scratch.cut(D.pair_features(P.train_pairs(table), emb))


def _predicted(rows, digits=4):
    return rows.select("src", "dst", "d", F.round("pred", digits).alias("pred"))


@register("linear_decoder")
def linear_decoder(spark, sf):
    _, _, rows = _trained(spark, sf)
    return _predicted(D.LinearDecoder.fit(rows).predict(rows))


@register("gbt_decoder")
def gbt_decoder(spark, sf):
    _, _, rows = _trained(spark, sf)
    return _predicted(D.BoostedDecoder.fit(rows, trees=5).predict(rows))


@register("mlp_decoder")
def mlp_decoder(spark, sf):
    _, _, rows = _trained(spark, sf)
    return _predicted(D.MLPDecoder.fit(rows, 16, epochs=6, softplus=True).predict(rows), 2)


@register("two_stage_log")
def two_stage_log(spark, sf):
    g, emb, rows = _trained(spark, sf)
    inner = rows.join(_top(g, 8).withColumnRenamed("id", "dst"), "dst", "left_semi")
    val = D.pair_features(P.classical_pairs(g, 1, 100).filter("d > 0"), emb)
    log = D.two_stage_training(inner, rows, val, 16, (2, 4))[1]
    return log.select("run", "epoch", F.round("train", 2).alias("train"), F.round("val", 2).alias("val"))


@register(
    "adjacency_override",
    S.query(
        S.graph("link") + S.drawn("nodes", "nodes", 10, 0) + [S.top(16), S.bfs(), _UPPER],
        """select u.src, u.dst, case when u.src = u.dst then 0.0::double when a.src is not null then 1.0::double else u.est::double end as est
from upper_b u left join arcs a on a.src = u.src and a.dst = u.dst""",
    ),
)
def adjacency_override(spark, sf):
    g, pairs = _classical(spark, sf, 10, 0)
    return D.adjacency_override(LandmarkOracle.build(g, 16).query(pairs), g.arcs, "est")


_LOG = """log as (select event_type as run, hour(ts)::int as epoch, round(avg(value), 4) as train, round(avg(value), 4) as val
  from events group by all)"""


@register(
    "best_epoch",
    S.query(
        [_LOG, "b as (select run, arg_min(epoch, row(val, epoch)) as epoch, max(epoch) as top from log group by run)"],
        """select run, epoch, (case when epoch < 10 then 10 when epoch >= 495 then floor((top + 10) / 10) * 10
else round_even(epoch / 10, 0) * 10 end)::int as checkpoint from b""",
    ),
)
def best_epoch(spark, sf):
    hour = F.hour("ts")
    log = graphs.table(spark, sf, "events").groupBy(F.col("event_type").alias("run"), hour.alias("epoch")).agg(
        F.round(F.avg("value"), 4).alias("train"), F.round(F.avg("value"), 4).alias("val")
    )
    return D.best_epoch(log)


# --------------------------------------------------------- coordinate and learned oracles
def _answers(oracle, spark, sf, digits=2, name="link", k=4):
    g, pairs = _classical(spark, sf, k, 30, name)
    return oracle(g).query(pairs).select("src", "dst", F.round("est", digits).alias("est"))


@register("coords_query")
def coords_query(spark, sf):
    return _answers(lambda g: CoordinateOracle.build(g, 24, 16, 8), spark, sf, name="supply")


@register("coords_adjacent_query")
def coords_adjacent_query(spark, sf):
    return _answers(lambda g: AdjacentExactOracle.build(g, landmarks=24), spark, sf, name="supply")


_ANSWERED = S.query(
    S.graph("link") + S.drawn("nodes", "nodes", 4, 30) + APSP,
    """select count(*) as pairs, count(b.d) as reachable, count(*) as answered, count(b.d) filter (b.d <= 1) as near,
count(*) - count(b.d) as far from drawn p left join bfs b on b.k = p.src and b.id = p.dst""",
)


def _answered(oracle, spark, sf):
    """Pairs, reachable and answered ones; equal or adjacent ends and components kept apart."""
    g, pairs = _classical(spark, sf, 4, 30)
    got = T.pair_distances(g, pairs).join(oracle(g).query(pairs), ["src", "dst"])
    count = lambda what: F.coalesce(F.sum(F.expr(what).cast("bigint")), F.lit(0)).alias
    return got.agg(
        F.count(F.lit(1)).alias("pairs"),
        count("d >= 0")("reachable"),
        F.count("est").alias("answered"),
        count("d between 0 and 1 and est = d")("near"),
        count("d < 0 and est = 20")("far"),
    )


@register("coords_answered", _ANSWERED)
def coords_answered(spark, sf):
    return _answered(lambda g: AdjacentExactOracle.build(g, landmarks=24), spark, sf)


@register("oracle_boosted_answered", _ANSWERED)
def oracle_boosted_answered(spark, sf):
    def oracle(g):
        made = L.boosted_oracle(g, 8, 5)
        made.tables["arcs"] = g.arcs
        return made

    return _answered(oracle, spark, sf)


@register("oracle_boosted")
def oracle_boosted(spark, sf):
    return _answers(lambda g: L.boosted_oracle(g, 8, 5), spark, sf)


@register("oracle_walk")
def oracle_walk(spark, sf):
    return _answers(lambda g: L.walk_oracle(g, 8, 8, 2, 6, 3, 4), spark, sf)


@register("oracle_star")
def oracle_star(spark, sf):
    return _answers(lambda g: L.star_oracle(g, 8, 8, 10, 3, 4), spark, sf)


@register("oracle_similarity")
def oracle_similarity(spark, sf):
    return _answers(lambda g: L.similarity_oracle(g, 8, 8, 2, 4, 4), spark, sf)


@register("oracle_centrality")
def oracle_centrality(spark, sf):
    s = L.CentralityWalk(dim=8, landmarks=8, per_root=2, length=5, out_walks=4, out_len=8, window=3, epochs=4)
    return _answers(lambda g: L.centrality_oracle(g, s), spark, sf)


@register("oracle_squared")
def oracle_squared(spark, sf):
    return _answers(lambda g: L.SquaredDistanceOracle.build(g, 6, 12, (4, 6)), spark, sf)


# --------------------------------------------------------------------- routes (R)
def _queries(spark, sf, k=2, name="link"):
    """Reachable query pairs with their true distance."""
    g, pairs = _classical(spark, sf, k, 31, name)
    truth = Scratch(spark, "routes").cut(T.pair_distances(g, pairs).filter("d >= 0"))
    return g, truth.withColumn("qid", F.col("src") * 1_000_000 + F.col("dst"))


def _route_rows(routes, truth):
    return routes.join(truth.select("qid", "d"), "qid").select(
        "qid", "src", "dst", "d", (F.size("path") - 1).alias("hops"), _text("path").alias("path"), "failed"
    )


@register(
    "route_bfs",
    S.query(
        S.graph("link") + S.drawn("nodes", "nodes", 2, 31) + APSP,
        """select p.src * 1000000 + p.dst as qid, p.src, p.dst, b.d, b.d as hops from drawn p join bfs b on b.k = p.src and b.id = p.dst""",
    ),
)
def route_bfs(spark, sf):
    g, q = _queries(spark, sf)
    return _route_rows(R.exact_routes(g, q), q).select("qid", "src", "dst", "d", "hops")


@register("route_beam")
def route_beam(spark, sf):
    g, q = _queries(spark, sf)
    return _route_rows(R.beam_routes(g, q, R.oracle_predictor(LandmarkOracle.build(g, 8)), cap=4), q)


@register("route_beam_adjacent")
def route_beam_adjacent(spark, sf):
    g, q = _queries(spark, sf)
    predict = R.oracle_predictor(LandmarkOracle.build(g, 8))
    return _route_rows(R.beam_routes(g, q, predict, cap=2, adjacent=True, top_k=3), q)


@register("route_greedy")
def route_greedy(spark, sf):
    g, q = _queries(spark, sf, 1)
    return _route_rows(R.greedy_routes(g, q, R.oracle_predictor(LandmarkOracle.build(g, 8))), q)


@register("route_error")
def route_error(spark, sf):
    g, q = _queries(spark, sf)
    got = R.beam_routes(g, q, R.oracle_predictor(LandmarkOracle.build(g, 8)), cap=4)
    out = V.route_error(got.join(q.select("qid", "d"), "qid"))
    return out.select(*[F.round(c, 4).alias(c) for c in ("mae", "mre", "hit_ratio", "evals")], "cnt")


# ------------------------------------------------------------------ evaluation (V)
_EVAL = S.graph("link") + S.drawn("nodes", "nodes", 10, 0) + [S.top(16), _UPPER.replace("bfs", "lmd"), S.bfs("seeds", "lmd")] + APSP + [
    "ev as (select u.src, u.dst, coalesce(b.d, -1) as d, u.est from upper_b u left join bfs b on b.k = u.src and b.id = u.dst)"
]


def _eval_order(ctes):
    """upper_b must follow the search it reads."""
    upper = [c for c in ctes if c.startswith("upper_b")]
    rest = [c for c in ctes if not c.startswith("upper_b")]
    at = next(i for i, c in enumerate(rest) if c.startswith("ev as"))
    return rest[:at] + upper + rest[at:]


def _evaluated(spark, sf):
    g, pairs = _classical(spark, sf, 10, 0)
    return T.pair_distances(g, pairs).join(LandmarkOracle.build(g, 16).query(pairs), ["src", "dst"])


@register(
    "mae_mre_by_length",
    S.query(
        _eval_order(_EVAL),
        """select d, round(avg(abs(coalesce(est, 20) - d)), 6) as mae, round(avg(abs(coalesce(est, 20) - d) / d), 6) as mre, count(*) as cnt,
count(*) - count(est) as unanswered from ev where d > 0 group by rollup (d)""",
    ),
)
def mae_mre_by_length(spark, sf):
    out = V.error_by_length(_evaluated(spark, sf), "est")
    return out.select("d", F.round("mae", 6).alias("mae"), F.round("mre", 6).alias("mre"), "cnt", "unanswered")


@register(
    "online_eval",
    S.query(
        _eval_order(_EVAL) + ["x as (select case when d < 0 then 20 else d end as d, round_even(coalesce(est, 20)::double, 0) as p from ev)"],
        """select round(sum(case when d > 0 then abs(p - d) else 0 end) / count(*), 6) as mae,
round(sum(case when d > 0 then abs(p - d) / d else 0 end) / count(*), 6) as mre, count(*) as cnt from x""",
    ),
)
def online_eval(spark, sf):
    rows = _evaluated(spark, sf).withColumn("est", F.coalesce("est", F.lit(20)))
    out = V.online_error(D.cap_unreachable(rows), "est")
    return out.select(F.round("mae", 6).alias("mae"), F.round("mre", 6).alias("mre"), "cnt")


@register(
    "mean_std",
    "select event_type, round(avg(value), 4) as mean, round(stddev_pop(value), 4) as std from events group by event_type",
)
def mean_std(spark, sf):
    out = V.mean_std(graphs.table(spark, sf, "events"), ["event_type"], "value")
    return out.select("event_type", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@register(
    "metric_upsert",
    """select user_id::varchar as nid, event_type as pid, arg_max(value, event_id) filter (where event_id % 2 = 0) as mae,
arg_max(value, event_id) filter (where event_id % 2 = 1) as mre from events group by user_id, event_type""",
)
def metric_upsert(spark, sf):
    log = graphs.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("nid"),
        F.col("event_type").alias("pid"),
        F.when(F.col("event_id") % 2 == 0, "mae").otherwise("mre").alias("metric"),
        "value",
        F.col("event_id").alias("seq"),
    )
    return V.metric_table(V.upsert_metrics(log), ["mae", "mre"])


@register(
    "file_name_fields",
    """select url as name, regexp_extract(url, '^https?://([^/]+)/([^/?]*)', 1) as host,
regexp_extract(url, '^https?://([^/]+)/([^/?]*)', 2) as head from pages""",
)
def file_name_fields(spark, sf):
    names = graphs.table(spark, sf, "pages").select(F.col("url").alias("name"))
    return V.parse_names(names, r"^https?://([^/]+)/([^/?]*)", ["host", "head"])


def _ranked_sql(name: str, draw: str) -> str:
    key = h_sql(h_sql("p.src", 0) + " + p.dst", 1)
    return f"""{name} as (select p.src, p.dst, b.d, row_number() over (partition by p.src order by {key}, p.dst) as j
  from {draw} p join bfs b on b.k = p.src and b.id = p.dst)"""


@register(
    "order_preservation",
    S.query(
        S.graph("follow") + S.drawn("nodes", "nodes", 4, 0, "d1") + S.drawn("nodes", "nodes", 4, 7, "d2") + APSP
        + [_VEC, _ranked_sql("r1", "d1"), _ranked_sql("r2", "d2")],
        """select round(avg(case when (r1.d - r2.d) * (list_dot_product(x.v, y.v) - list_dot_product(x.v, z.v)) <= 0 then 1.0 else 0.0 end), 6) as rate,
count(*) as cnt from r1 join r2 on r1.src = r2.src and r1.j = r2.j join emb x on x.id = r1.src join emb y on y.id = r1.dst join emb z on z.id = r2.dst""",
    ),
)
def order_preservation(spark, sf):
    triples = V.sample_triples(graphs.graph(spark, sf, "follow"), 4)
    return V.order_preservation(triples, _emb(spark, sf)).select(F.round("rate", 6).alias("rate"), "cnt")


@register(
    "score_by_distance",
    S.query(
        S.graph("follow") + [S.top(16), S.bfs(), _VEC],
        """select b.d, round(avg(list_dot_product(x.v, y.v)), 6) as mean, round(min(list_dot_product(x.v, y.v)), 6) as low,
round(max(list_dot_product(x.v, y.v)), 6) as high, count(*) as cnt from bfs b join emb x on x.id = b.k join emb y on y.id = b.id where b.d > 0 group by b.d""",
    ),
)
def score_by_distance(spark, sf):
    g = graphs.graph(spark, sf, "follow")
    pairs = P.landmark_pairs(g, _top(g, 16)).filter("d > 0")
    out = V.score_by_distance(D.closed_scores(pairs, _emb(spark, sf)), "dot")
    return out.select("d", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")], "cnt")


@register(
    "local_smoothness",
    S.query(
        S.graph("link") + S.drawn("nodes", "nodes", 2, 33) + APSP + [S.top(8), S.bfs("seeds", "lmd")]
        + [
            "base as (select p.src, p.dst, b.d from drawn p join bfs b on b.k = p.src and b.id = p.dst where b.d > 0)",
            """blk as (select p.src, p.dst, u.dst as u, v.dst as v, case when du.d >= p.d then 1 else -1 end * case when dv.d >= p.d then 1 else -1 end as s
  from base p join arcs u on u.src = p.src join arcs v on v.src = p.dst
  join bfs du on du.k = u.dst and du.id = p.dst join bfs dv on dv.k = p.src and dv.id = v.dst)""",
            "uv as (select distinct u, v from blk)",
            "est as (select uv.u, uv.v, min(x.d + y.d) as e from uv join lmd x on x.id = uv.u join lmd y on y.id = uv.v and y.k = x.k group by uv.u, uv.v)",
            "per as (select src, dst, sum(s * coalesce(e, 20))::double / count(*) as r from blk left join est using (u, v) group by src, dst)",
        ],
        "select round(avg(r * r), 6) as smoothness, count(*) as cnt from per",
    ),
)
def local_smoothness(spark, sf):
    g, pairs = _classical(spark, sf, 2, 33)
    scratch = Scratch(spark, "smooth")
    base = scratch.cut(T.pair_distances(g, pairs).filter("d > 0"))
    rows = scratch.cut(V.smoothness_rows(g, base))
    asked = rows.select(F.col("u").alias("src"), F.col("v").alias("dst")).distinct()
    est = LandmarkOracle.build(g, 8).query(asked)
    pred = est.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("est").alias("pred"))
    return V.local_smoothness(rows, pred, base).select(F.round("smoothness", 6).alias("smoothness"), "cnt")


@register(
    "error_matrix",
    S.query(
        _eval_order(_EVAL)
        + [
            """m as (select d, avg(abs(coalesce(est, 20) - d)) as mae, avg(abs(coalesce(est, 20) - d) / d) as mre, count(*)::double as cnt,
(count(*) - count(est))::double as unanswered from ev where d > 0 group by rollup (d))""",
        ],
        """select unnest(['mae', 'mre', 'cnt', 'unanswered']) as metric, coalesce(d::varchar, 'total') as len,
round(unnest([mae, mre, cnt, unanswered]), 6) as value from m""",
    ),
)
def error_matrix(spark, sf):
    cells = V.error_matrix(V.error_by_length(_evaluated(spark, sf), "est"))
    return cells.select("metric", "len", F.round("value", 6).alias("value"))


# -------------------------------------------------------------- classification (N)
def _labels(spark, sf):
    return graphs.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")


@register("classify_topk_f1")
def classify_topk_f1(spark, sf):
    out = N.protocol(_emb(spark, sf), _labels(spark, sf), [0.5], 1)
    return out.select("share", F.round("micro_f1", 3).alias("micro_f1"), F.round("macro_f1", 3).alias("macro_f1"))


@register("classify_softmax")
def classify_softmax(spark, sf):
    emb = _emb(spark, sf)
    train = N.split_share(emb, emb.count(), 0.5, 0)
    return N.softmax_accuracy(emb, _labels(spark, sf), train, 16, width=64).select(F.round("accuracy", 3).alias("accuracy"), "cnt")


@register(
    "f1_of_neighbour_labels",
    """with t as (select vec_id as id, label from embeddings), p as (select a.id, b.label from t a join t b on b.id = a.id + 1),
c as (select coalesce(p.label, t.label) as label, count(*) filter (where p.id is not null and t.id is not null) as tp,
 count(*) filter (where t.id is null) as fp, count(*) filter (where p.id is null) as fn from p full join t on p.id = t.id and p.label = t.label group by 1)
select round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) as micro_f1, round(avg(2 * tp / (2 * tp + fp + fn)), 6) as macro_f1 from c""",
)
def f1_of_neighbour_labels(spark, sf):
    truth = _labels(spark, sf)
    pred = truth.select((F.col("id") - 1).alias("id"), "label").join(truth.select("id"), "id", "left_semi")
    return N.f1_scores(pred, truth).select(F.round("micro_f1", 6).alias("micro_f1"), F.round("macro_f1", 6).alias("macro_f1"))


@register(
    "split_masks",
    f"""select vec_id as id, row_number() over (order by {h_sql('vec_id', 3)}, vec_id) - 1 < (0.3 * (select count(*) from embeddings))::int as train from embeddings""",
)
def split_masks(spark, sf):
    emb = _labels(spark, sf)
    return N.split_share(emb, emb.count(), 0.3, 3)


@register(
    "block_masks",
    """with r as (select vec_id as id, row_number() over (order by vec_id) - 1 as rn from embeddings)
select id, rn < 140 as train_mask, rn >= 140 and rn < 210 as val_mask from r""",
)
def block_masks(spark, sf):
    return N.block_masks(_labels(spark, sf))


# ------------------------------------------------------------------- coarsening (H)
@register("coarsen_level")
def coarsen_level(spark, sf):
    g = graphs.graph(spark, sf, "trade")
    return H.grow(g, H.choose_seeds(g, 10), growth=0.5)


@register("coarsen_climb")
def coarsen_climb(spark, sf):
    g, pairs = _classical(spark, sf, 2, 40)
    return H.Hierarchy.build(g, 6, depth=2, growth=1.0).climb(pairs)


_FORCED = h_sql("id", 41)


@register(
    "coarsen_quotient",
    S.query(
        S.graph("supply") + [f"m as (select id, {_FORCED} % 100 as rk from nodes)"],
        "select distinct x.rk as src, y.rk as dst from arcs a join m x on x.id = a.src join m y on y.id = a.dst where x.rk <> y.rk",
    ),
)
def coarsen_quotient(spark, sf):
    g = graphs.graph(spark, sf, "supply")
    return H.quotient(g.arcs, g.nodes.select("id", (h("id", 41) % 100).alias("rk")))


# -------------------------------------------------------- text sources and sinks (S)
def _folder(spark, name):
    return Scratch(spark, "text").path(name)


@register("text_edge_list", S.query(S.graph("trade"), "select src, dst from arcs"))
def text_edge_list(spark, sf):
    path = _folder(spark, "arcs.tsv")
    SE.write_arcs(graphs.graph(spark, sf, "trade").arcs, path)
    return SE.read_edge_list(spark, path).select("src", "dst")


@register("text_edge_csv", S.query(S.graph("geo"), "select a as src, b as dst from e"))
def text_edge_csv(spark, sf):
    path = _folder(spark, "edges.csv")
    SE.write_arcs(graphs.graph(spark, sf, "geo").edges, path, ",", base=1)
    return SE.read_edge_csv(spark, path)


@register("text_edges_once", S.query(S.graph("supply"), "select a as src, b as dst from e"))
def text_edges_once(spark, sf):
    path = _folder(spark, "once.tsv")
    SE.write_edges_once(graphs.graph(spark, sf, "supply").arcs, path)
    return SE.read_edge_list(spark, path).select("src", "dst")


@register("text_adjacency", S.query(S.graph("follow"), "select src, dst from arcs"))
def text_adjacency(spark, sf):
    from hopgraph.operators.shape import to_adjacency

    path = _folder(spark, "adj.txt")
    adj = to_adjacency(graphs.graph(spark, sf, "follow").arcs)
    adj.select(F.concat(F.col("id").cast("string"), F.lit(" "), _text("nbrs", " "))).write.text(path)
    return SE.read_adjacency(spark, path)


@register("text_pairs", S.query(S.graph("supply") + [S.top(4), S.bfs()], "select k as src, id as dst, d::double as d from bfs where d >= 1"))
def text_pairs(spark, sf):
    g = graphs.graph(spark, sf, "supply")
    rough, clean = _folder(spark, "rough"), _folder(spark, "clean")
    pairs = P.train_pairs(T.landmark_table(g, _top(g, 4)))
    odd = F.when(F.col("dst") % 2 == 0, F.concat(F.lit("tensor("), F.col("dst"), F.lit(")"))).otherwise(F.col("dst").cast("string"))
    pairs.select(F.concat_ws(",", "src", odd, F.col("d").cast("double"))).write.text(rough)
    ST.normalise_pairs(spark, rough, clean)
    return ST.read_pairs(spark, clean)


@register(
    "text_ranges",
    S.query(
        S.graph("geo") + [S.top(6), S.bfs(), "deg1 as (select b.k, b.id, b.d, n.deg from bfs b join nodes n on n.id = b.id)"],
        "select k as src, id as dst, k as a, id as b, d from deg1",
    ),
)
def text_ranges(spark, sf):
    g = graphs.graph(spark, sf, "geo")
    path = _folder(spark, "ranges")
    rows = P.landmark_pairs(g, _top(g, 6)).select("src", "dst", F.col("src").alias("a"), F.col("dst").alias("b"), "d")
    ST.write_ranges(P.pack_ranges(rows), path)
    return ST.read_ranges(spark, path).select("src", "dst", F.explode("rng").alias("r")).select("src", "dst", "r.a", "r.b", "r.d")


@register("text_embedding", S.query([_VEC], f"select id, round({_sum_by('v[i] * i')}, 6) as mark from emb"))
def text_embedding(spark, sf):
    path = _folder(spark, "emb")
    ST.write_embedding(_emb(spark, sf), path)
    back = ST.read_embedding(spark, path)
    mark = F.aggregate(F.zip_with("v", F.sequence(F.lit(1), F.lit(64)), lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    return back.select("id", F.round(mark, 6).alias("mark"))


@register("text_scores", "select vec_id as id, round(embedding[1]::double, 6) as score from embeddings")
def text_scores(spark, sf):
    path = _folder(spark, "scores")
    ST.write_scores(_emb(spark, sf).select("id", F.get("v", F.lit(0)).alias("score")), path)
    return ST.read_scores(spark, path).select("id", F.round("score", 6).alias("score"))


@register(
    "text_labels",
    "select doc_id as id, arg_max(quality, row(doc_id, quality, toxic)) as label from labels group by doc_id",
)
def text_labels(spark, sf):
    path = _folder(spark, "labels")
    graphs.table(spark, sf, "labels").orderBy("doc_id", "quality", "toxic").select(
        F.concat_ws(",", F.col("doc_id") + 1, "quality")
    ).write.text(path)
    return ST.read_labels(spark, path)


@register(
    "scores_merged",
    "select l_partkey as id, round(sum(l_quantity), 4) as score from lineitem group by l_partkey",
)
def scores_merged(spark, sf):
    parts = graphs.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_quantity").alias("score"))
    return ST.merge_scores(parts).select("id", F.round("score", 4).alias("score"))


@register("text_walks", S.query(S.graph("supply") + ["r as (select src, dst, row_number() over (partition by src order by dst) as rn from arcs)"],
    "select src as root, src || ' ' || string_agg(dst::varchar, ' ' order by dst) as path from r where rn <= 4 group by src"))
def text_walks(spark, sf):
    g = graphs.graph(spark, sf, "supply")
    path = _folder(spark, "walks")
    ST.write_walks(K.star_walks(g, g.nodes, 5), path)
    return ST.read_walks(spark, path).select("root", _text("path", " ").alias("path"))


@register(
    "answer_lines",
    S.query(
        S.graph("geo") + [S.top(4), S.bfs(), "p as (select k as src, id as dst, d from bfs where d = 1)"],
        """select src, -1::bigint as ord, src || '#' || string_agg(dst::varchar, '-' order by dst) as value from p group by src
union all select src, dst, src || '-' || dst || '-' || d from p""",
    ),
)
def answer_lines(spark, sf):
    g = graphs.graph(spark, sf, "geo")
    return ST.answer_lines(P.landmark_pairs(g, _top(g, 4)).filter("d = 1"))


@register("coo_arcs", "select distinct l_suppkey as src, l_partkey as dst from lineitem where l_discount <> 0")
def coo_arcs(spark, sf):
    cells = graphs.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_discount").alias("v")
    )
    return SE.from_coo(cells)

