"""Oracles with a fitted embedding or decoder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopgraph.functions.vectors import sq_l2
from hopgraph.operators import embed as E
from hopgraph.operators.graph import Graph
from hopgraph.operators.oracles.base import Oracle, answer_all, attach, home_table
from hopgraph.operators.oracles.landmark import choose_landmarks, pack
from hopgraph.operators.predict import BoostedDecoder, MLPDecoder, adjacency_override, pair_features
from hopgraph.operators.sample import negative_samples, train_pairs
from hopgraph.operators.stats import landmark_centrality, roots_by_frequency
from hopgraph.operators.traverse import landmark_table
from hopgraph.operators.walk import Rule, Walker, decayed_walks, distance_bounds, resample, star_walks, walks
from hopgraph.plans.scratch import Scratch


class DecodedOracle(Oracle):
    """Embedding table plus an in-memory decoder."""

    decoder = None

    @classmethod
    def made(cls, emb: DataFrame, decoder, settings: dict | None = None, **tables) -> "DecodedOracle":
        out = cls({"emb": emb, **tables}, settings)
        out.decoder = decoder
        return out

    def query(self, pairs: DataFrame) -> DataFrame:
        asked = pairs.select("src", "dst").distinct()
        got = self.decoder.predict(pair_features(asked, self.tables["emb"])).select(
            "src", "dst", F.col("pred").alias("est")
        )
        out = asked.join(got, ["src", "dst"], "left")
        if "home" in self.tables:
            out = answer_all(out.select("src", "dst", "est"), self.tables["home"])
        if "arcs" in self.tables:
            out = adjacency_override(out, self.tables["arcs"], "est")
        return out.select("src", "dst", "est")

    def save(self, path: str) -> None:
        if isinstance(self.decoder, MLPDecoder):
            self.settings["mlp"] = self.decoder.to_json()
        elif isinstance(self.decoder, BoostedDecoder):
            self.decoder.first.write().overwrite().save(f"{path}/_first")
            self.decoder.second.write().overwrite().save(f"{path}/_second")
            self.settings["boosted"] = list(self.decoder.extra)
        elif isinstance(self.decoder, StackedDecoder):
            self.decoder.boosted.first.write().overwrite().save(f"{path}/_first")
            self.decoder.boosted.second.write().overwrite().save(f"{path}/_second")
            self.settings["stacked"] = self.decoder.net.to_json()
        super().save(path)

    @classmethod
    def load(cls, spark, path: str) -> "DecodedOracle":
        from pyspark.ml.regression import GBTRegressionModel

        out = super().load(spark, path)

        def trees(extra):
            return BoostedDecoder(
                GBTRegressionModel.load(f"{path}/_first"), GBTRegressionModel.load(f"{path}/_second"), tuple(extra)
            )

        if "mlp" in out.settings:
            out.decoder = MLPDecoder.from_json(out.settings["mlp"])
        elif "stacked" in out.settings:
            out.decoder = StackedDecoder(MLPDecoder.from_json(out.settings["stacked"]), trees(["net"]))
        else:
            out.decoder = trees(out.settings["boosted"])
        return out


class StackedDecoder:
    """The network's prediction becomes one more feature of the boosted trees."""

    def __init__(self, net: MLPDecoder, boosted: BoostedDecoder):
        self.net, self.boosted = net, boosted

    @classmethod
    def fit(cls, rows: DataFrame, net: MLPDecoder, trees: int = 20, seed: int = 0) -> "StackedDecoder":
        return cls(net, BoostedDecoder.fit(cls._with_net(rows, net), trees, seed, extra=("net",)))

    @staticmethod
    def _with_net(rows: DataFrame, net: MLPDecoder) -> DataFrame:
        return net.predict(rows).withColumnRenamed("pred", "net")

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.boosted.predict(self._with_net(rows, self.net)).drop("net")


def _landmarks(graph: Graph, count: int, by: str = "degree", seed: int = 0) -> tuple[list[int], DataFrame, DataFrame]:
    scratch = Scratch(graph.spark, "learned")
    chosen = [r.id for r in choose_landmarks(graph, count, by, 0, seed).collect()]
    ids = graph.spark.createDataFrame([(v,) for v in chosen], "id bigint")
    return chosen, ids, scratch.cut(landmark_table(graph, ids))


def boosted_oracle(graph: Graph, landmarks: int = 16, trees: int = 20, grid: dict | None = None, seed: int = 0) -> DecodedOracle:
    """Landmark distance vectors as features of the two-stage boosted trees."""
    chosen, _, table = _landmarks(graph, landmarks, seed=seed)
    emb = Scratch(graph.spark, "boosted").cut(E.distance_vectors(pack(table, chosen)))
    rows = pair_features(train_pairs(table), emb)
    return DecodedOracle.made(emb, BoostedDecoder.fit(rows, trees, seed, grid), {"landmarks": chosen}, home=home_table(graph))


def walk_oracle(
    graph: Graph, dim: int = 16, landmarks: int = 16, per_root: int = 10, length: int = 20, window: int = 5, epochs: int = 10,
    p: float = 1.0, q: float = 1.0, seed: int = 0,
) -> DecodedOracle:
    """Second-order walks, skip-gram and a two-layer decoder."""
    scratch = Scratch(graph.spark, "walkoracle")
    corpus = walks(graph, graph.nodes, Rule(p=p, q=q), per_root, length, seed=seed)
    emb = scratch.cut(E.skipgram(corpus, dim, window, 10, seed))
    _, _, table = _landmarks(graph, landmarks, seed=seed)
    net = MLPDecoder.fit(pair_features(train_pairs(table), emb), 2 * dim, epochs=epochs, softplus=True, seed=seed)
    return DecodedOracle.made(emb, net, {"dim": dim}, home=home_table(graph))


def star_oracle(
    graph: Graph, dim: int = 16, landmarks: int = 16, length: int = 40, window: int = 5, epochs: int = 10, seed: int = 0
) -> DecodedOracle:
    """Star walks; the decoder trains on pairs of the most frequent roots."""
    scratch = Scratch(graph.spark, "star")
    corpus = scratch.cut(star_walks(graph, graph.nodes, length))
    emb = scratch.cut(E.skipgram(corpus, dim, window, 10, seed))
    roots = scratch.cut(roots_by_frequency(corpus).limit(landmarks).select("id"))
    table = landmark_table(graph, roots)
    net = MLPDecoder.fit(pair_features(train_pairs(table), emb), 2 * dim, epochs=epochs, softplus=True, seed=seed)
    return DecodedOracle.made(emb, net, {"dim": dim}, home=home_table(graph))


def similarity_oracle(
    graph: Graph, dim: int = 16, landmarks: int = 16, negatives: int = 3, iters: int = 20, epochs: int = 10, seed: int = 0
) -> DecodedOracle:
    """Vectors whose cosine follows 1/d (0 for negatives), then a decoder."""
    scratch = Scratch(graph.spark, "similar")
    _, _, table = _landmarks(graph, landmarks, seed=seed)
    train = train_pairs(table)
    near = train.select("src", "dst", (F.lit(1.0) / F.col("d")).alias("d"))
    samples = scratch.cut(negative_samples(near, graph.nodes, graph.n, negatives, seed))
    emb = E.fit_cosine(samples, E.random_vectors(graph.nodes, dim, seed), dim, iters)
    net = MLPDecoder.fit(pair_features(train, emb), 2 * dim, epochs=epochs, softplus=True, seed=seed)
    return DecodedOracle.made(emb, net, {"dim": dim}, home=home_table(graph))


@dataclass(frozen=True)
class CentralityWalk:
    """Settings of the centrality-walk oracle."""

    dim: int = 16
    landmarks: int = 16
    select: str = "degree"  # use_sel
    per_root: int = 10
    length: int = 20
    decay: float = 1.0
    out_walks: int = 10
    out_len: int = 20
    alpha: float = 0.35
    window: int = 5
    epochs: int = 10
    trees: int = 20
    fast_query: bool = False
    use_boost: bool = False  # is_catboost
    stack_net: bool = False  # catboost_comb
    drop_centrality: bool = False  # elim_bc
    weighted_walk: bool = True  # use_rep_bc
    weighted_resample: bool = True  # use_rep_dr
    seed: int = 0


def centrality_oracle(graph: Graph, s: CentralityWalk = CentralityWalk()) -> DecodedOracle:
    """Centrality-driven walks, distance resampling, skip-gram, decoder(s), neighbour check.

    ``drop_centrality`` removes the walk embedding and keeps the landmark
    distances as features; ``fast_query`` skips the neighbour check.
    """
    scratch = Scratch(graph.spark, "centrality")
    chosen, _, table = _landmarks(graph, s.landmarks, s.select, s.seed)
    score = scratch.cut(landmark_centrality(table))
    low = scratch.cut(E.distance_vectors(pack(table, chosen)))
    if s.drop_centrality:
        emb = low
        width = len(chosen)
    else:
        rule = Rule(avoid=True, score=s.weighted_walk, decay=s.decay if s.weighted_walk else None)
        walker = Walker(graph, score if s.weighted_walk else None)
        if s.weighted_walk:
            walked = decayed_walks(walker, graph.nodes, s.per_root, s.length, rule, s.seed)
        else:
            walked = walker.run(graph.nodes, s.per_root, s.length, rule, s.seed)
        bounds = scratch.cut(distance_bounds(graph, walked))
        corpus = resample(bounds, score, s.alpha, s.out_walks, s.out_len, s.seed, s.weighted_resample)
        walk_emb = E.skipgram(corpus, s.dim, s.window, 10, s.seed)
        emb, width = scratch.cut(walk_emb), s.dim
        if s.use_boost:
            emb, width = scratch.cut(E.concat_embeddings(emb, low)), s.dim + len(chosen)
    rows = scratch.cut(pair_features(train_pairs(table), emb))
    if s.use_boost and not s.stack_net:
        decoder = BoostedDecoder.fit(rows, s.trees, s.seed)
    else:
        decoder = MLPDecoder.fit(rows, 2 * width, hidden=2 * width, epochs=s.epochs, seed=s.seed)
        if s.stack_net:
            decoder = StackedDecoder.fit(rows, decoder, s.trees, s.seed)
    extra = {} if s.fast_query else {"arcs": graph.arcs}
    return DecodedOracle.made(emb, decoder, {"dim": s.dim}, home=home_table(graph), **extra)


class SquaredDistanceOracle(Oracle):
    """Coordinates with ||x_u - x_v||^2 close to d^2; the estimate is the plain distance."""

    @classmethod
    def build(cls, graph: Graph, dim: int = 8, landmarks: int = 16, iters: tuple[int, int] = (15, 15), seed: int = 0):
        chosen, ids, table = _landmarks(graph, landmarks, seed=seed)
        pairs = train_pairs(table)
        inner = pairs.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "d")
        emb = E.random_vectors(graph.nodes, dim, seed, 1.0)
        emb = E.fit_squared_distance(inner, emb, dim, iters[0])
        emb = E.fit_squared_distance(pairs, emb, dim, iters[1])
        return cls({"emb": emb}, {"dim": dim})

    def query(self, pairs: DataFrame) -> DataFrame:
        ends = attach(pairs.select("src", "dst").distinct(), self.tables["emb"], "v")
        return ends.select("src", "dst", F.sqrt(sq_l2(F.col("v_s"), F.col("v_d"))).alias("est"))
