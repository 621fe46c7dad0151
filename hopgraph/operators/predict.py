"""Distance predictors on pairs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopgraph.functions.vectors import cosine, dot, sq_l2
from hopgraph.plans.scratch import Scratch


def pair_features(pairs: DataFrame, emb: DataFrame) -> DataFrame:
    """Add ``feat`` = source vector followed by destination vector."""
    a = emb.select(F.col("id").alias("src"), F.col("v").alias("_a"))
    b = emb.select(F.col("id").alias("dst"), F.col("v").alias("_b"))
    return pairs.join(a, "src").join(b, "dst").withColumn("feat", F.concat("_a", "_b")).drop("_a", "_b")


def closed_scores(pairs: DataFrame, emb: DataFrame) -> DataFrame:
    """Dot product, squared distance and cosine of both ends."""
    x, y = F.col("_a"), F.col("_b")
    return score_pairs(pairs, emb, dot=dot(x, y), sq_l2=sq_l2(x, y), cosine=cosine(x, y))


def score_pairs(pairs: DataFrame, emb: DataFrame, **scores: Column) -> DataFrame:
    """``pairs`` with symmetric ``scores`` of the vectors ``_a`` and ``_b`` of their ends.

    A vector is much wider than a pair, so it travels once for both directions of a pair,
    and only where the other end has a vector as well.
    """
    known = pairs.filter("src is not null and dst is not null").withColumns(
        {"_u": F.least("src", "dst"), "_w": F.greatest("src", "dst")}
    )
    a = emb.select(F.col("id").alias("_u"), F.col("v").alias("_a"))
    b = emb.select(F.col("id").alias("_w"), F.col("v").alias("_b"))
    once = known.select("_u", "_w").distinct().join(b.select("_w"), "_w", "left_semi")
    scored = once.join(a, "_u").join(b, "_w").select("_u", "_w", *[c.alias(name) for name, c in scores.items()])
    return known.join(scored, ["_u", "_w"]).select(*pairs.columns, *scores)


def adjacency_override(scored: DataFrame, arcs: DataFrame, col: str = "pred") -> DataFrame:
    """0 for equal ends, 1 for adjacent ends, the prediction otherwise."""
    hit = arcs.select("src", "dst", F.lit(True).alias("_adj"))
    fixed = F.when(F.col("src") == F.col("dst"), F.lit(0.0)).when(F.col("_adj"), F.lit(1.0)).otherwise(F.col(col).cast("double"))
    return scored.join(hit, ["src", "dst"], "left").withColumn(col, fixed).drop("_adj")


def cap_unreachable(pairs: DataFrame, value: int = 20) -> DataFrame:
    """Unreachable targets become a large finite distance."""
    return pairs.withColumn("d", F.when(F.col("d") < 0, F.lit(value)).otherwise(F.col("d")))


class LinearDecoder:
    """Ordinary least squares on the pair features."""

    def __init__(self, model):
        self.model = model

    @classmethod
    def fit(cls, rows: DataFrame) -> "LinearDecoder":
        data = rows.select(array_to_vector("feat").alias("x"), F.col("d").cast("double").alias("y"))
        return cls(LinearRegression(featuresCol="x", labelCol="y", predictionCol="pred").fit(data))

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(rows.withColumn("x", array_to_vector("feat"))).drop("x")


class BoostedDecoder:
    """Boosted trees, then boosted trees on features plus the first prediction.

    ``grid`` switches on cross validation over depth and step size.
    """

    def __init__(self, first, second, extra: tuple[str, ...]):
        self.first, self.second, self.extra = first, second, extra

    @staticmethod
    def _train(data: DataFrame, trees: int, seed: int, grid: dict | None):
        gbt = GBTRegressor(featuresCol="x", labelCol="y", maxIter=trees, maxDepth=4, stepSize=0.1, seed=seed)
        if not grid:
            return gbt.fit(data)
        space = ParamGridBuilder().addGrid(gbt.maxDepth, grid["depth"]).addGrid(gbt.stepSize, grid["rate"]).build()
        judge = RegressionEvaluator(labelCol="y", metricName="rmse")
        return CrossValidator(estimator=gbt, estimatorParamMaps=space, evaluator=judge, numFolds=3, seed=seed).fit(data).bestModel

    @classmethod
    def fit(
        cls, rows: DataFrame, trees: int = 20, seed: int = 0, grid: dict | None = None, extra: tuple[str, ...] = ()
    ) -> "BoostedDecoder":
        """``extra`` names prediction columns appended to the features (stacking, D5)."""
        scratch = Scratch(rows.sparkSession, "gbt")
        full = F.concat("feat", F.array(*[F.col(c).cast("double") for c in extra])) if extra else F.col("feat")
        data = scratch.cut(rows.select(full.alias("f"), F.col("d").cast("double").alias("y")))
        one = cls._train(data.withColumn("x", array_to_vector("f")), trees, seed, grid)
        staged = one.transform(data.withColumn("x", array_to_vector("f"))).select(
            F.concat("f", F.array("prediction")).alias("f"), "y"
        )
        staged = scratch.cut(staged)
        two = cls._train(staged.withColumn("x", array_to_vector("f")), trees, seed + 1, grid)
        return cls(one, two, tuple(extra))

    def predict(self, rows: DataFrame) -> DataFrame:
        keep = rows.columns
        full = F.concat("feat", F.array(*[F.col(c).cast("double") for c in self.extra])) if self.extra else F.col("feat")
        one = self.first.transform(rows.withColumn("_f", full).withColumn("x", array_to_vector("_f")))
        staged = one.select(*keep, array_to_vector(F.concat("_f", F.array("prediction"))).alias("x"))
        return self.second.transform(staged).select(*keep, F.col("prediction").alias("pred"))


# ------------------------------------------------------------------- D3 network
def _init_weights(width: int, hidden: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    w1 = rng.normal(0, np.sqrt(2.0 / width), (width, hidden))
    w2 = rng.normal(0, np.sqrt(2.0 / hidden), hidden)
    return np.concatenate([w1.ravel(), np.zeros(hidden), w2, np.zeros(1)])


def _split(theta: np.ndarray, width: int, hidden: int):
    a = width * hidden
    return theta[:a].reshape(width, hidden), theta[a : a + hidden], theta[a + hidden : a + 2 * hidden], theta[-1]


def _forward(theta, x, width, hidden, softplus):
    w1, b1, w2, b2 = _split(theta, width, hidden)
    z = x @ w1 + b1
    act = np.maximum(z, 0.0)
    raw = act @ w2 + b2
    out = np.logaddexp(0.0, raw) if softplus else raw
    return z, act, raw, out


def _gradient(theta, x, y, width, hidden, softplus):
    w1, b1, w2, b2 = _split(theta, width, hidden)
    z, act, raw, out = _forward(theta, x, width, hidden, softplus)
    err = 2.0 * (out - y) / len(y)
    if softplus:
        err = err / (1.0 + np.exp(-raw))
    back = np.outer(err, w2) * (z > 0)
    return np.concatenate([(x.T @ back).ravel(), back.sum(0), act.T @ err, [err.sum()]])


class MLPDecoder:
    """D3: one hidden relu layer, squared error, Adam on batches of 128.

    One epoch is one Spark job: every task trains on its own rows from the
    current weights and returns a weight vector; the driver averages them by
    row count.  The weights (a few thousand numbers) are all that moves, and
    there is one vector per partition, so ``parts`` bounds the driver's work.
    """

    def __init__(self, theta: np.ndarray, width: int, hidden: int, softplus: bool, log: list[tuple]):
        self.theta, self.width, self.hidden, self.softplus, self.log = theta, width, hidden, softplus, log

    @classmethod
    def fit(
        cls,
        rows: DataFrame,
        width: int,
        hidden: int | None = None,
        epochs: int = 10,
        rate: float = 0.01,
        batch: int = 128,
        softplus: bool = False,
        seed: int = 0,
        parts: int | None = None,
        start: "MLPDecoder | None" = None,
        val: DataFrame | None = None,
        patience: int = 20,
        keep_every: int | None = None,
    ) -> "MLPDecoder":
        """``rows(feat, d)``; ``start`` continues earlier training (D9), ``val`` logs and stops early."""
        spark = rows.sparkSession
        scratch = Scratch(spark, "mlp")
        hidden = hidden or max(4, width // 4)
        parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        data = scratch.cut(rows.select("feat", F.col("d").cast("double").alias("y")).repartition(parts))
        check = None if val is None else scratch.cut(val.select("feat", F.col("d").cast("double").alias("y")))
        theta = _init_weights(width, hidden, seed) if start is None else start.theta
        log: list[tuple] = []
        kept: dict[int, np.ndarray] = {}
        best, stale = float("inf"), 0
        for epoch in range(epochs):
            shared = spark.sparkContext.broadcast(theta)

            def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                mine = shared.value.copy()
                m, v, t = np.zeros_like(mine), np.zeros_like(mine), 0
                loss, seen = 0.0, 0
                rng = np.random.default_rng(seed + epoch)
                for f in frames:
                    if not len(f):
                        continue
                    x, y = np.stack(f["feat"].to_numpy()), f["y"].to_numpy()
                    out = _forward(mine, x, width, hidden, softplus)[3]
                    loss += float(((out - y) ** 2).sum())
                    seen += len(y)
                    mix = rng.permutation(len(y))
                    for lo in range(0, len(y), batch):
                        at = mix[lo : lo + batch]
                        g = _gradient(mine, x[at], y[at], width, hidden, softplus)
                        t += 1
                        m = 0.9 * m + 0.1 * g
                        v = 0.999 * v + 0.001 * g * g
                        mine = mine - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
                if seen:
                    yield pd.DataFrame({"w": [mine.tolist()], "n": [seen], "loss": [loss]})

            got = data.mapInPandas(train, "w array<double>, n bigint, loss double").collect()  # <= parts rows
            total = sum(r.n for r in got)
            theta = sum(np.asarray(r.w) * (r.n / total) for r in got)
            shared.unpersist()
            train_loss = sum(r.loss for r in got) / total
            val_loss = None
            if check is not None:
                val_loss = cls(theta, width, hidden, softplus, []).loss(check)
            log.append((epoch, float(train_loss), val_loss))
            if keep_every and (epoch + 1) % keep_every == 0:
                kept[epoch + 1] = theta
            judged = val_loss if val_loss is not None else train_loss
            best, stale = (judged, 0) if judged < best else (best, stale + 1)
            if stale >= patience:
                break
        out = cls(theta, width, hidden, softplus, log)
        out.kept = kept
        return out

    def predict(self, rows: DataFrame) -> DataFrame:
        theta, width, hidden, softplus = self.theta, self.width, self.hidden, self.softplus

        @F.pandas_udf("double")
        def score(feat: pd.Series) -> pd.Series:
            if not len(feat):
                return pd.Series([], dtype=float)
            return pd.Series(_forward(theta, np.stack(feat.to_numpy()), width, hidden, softplus)[3])

        return rows.withColumn("pred", score("feat"))

    def loss(self, rows: DataFrame) -> float:
        err = F.col("pred") - F.col("y")
        return float(self.predict(rows).agg(F.avg(err * err)).first()[0])

    def train_log(self, spark, run: str = "run") -> DataFrame:
        """``(run, epoch, train, val)``."""
        rows = [(run, e, t, v) for e, t, v in self.log]
        return spark.createDataFrame(rows, "run string, epoch int, train double, val double")

    def to_json(self) -> str:
        return json.dumps(
            {"theta": self.theta.tolist(), "width": self.width, "hidden": self.hidden, "softplus": self.softplus}
        )

    @classmethod
    def from_json(cls, text: str) -> "MLPDecoder":
        o = json.loads(text)
        return cls(np.array(o["theta"]), o["width"], o["hidden"], o["softplus"], [])


def two_stage_training(
    landmark_rows: DataFrame, all_rows: DataFrame, val_rows: DataFrame, width: int, epochs: tuple[int, int] = (10, 20), **settings
) -> tuple[MLPDecoder, DataFrame]:
    """Landmark pairs first, then landmark-to-all pairs from the learned weights, with validation."""
    one = MLPDecoder.fit(landmark_rows, width, epochs=epochs[0], **settings)
    two = MLPDecoder.fit(all_rows, width, epochs=epochs[1], start=one, val=val_rows, patience=20, **settings)
    spark = landmark_rows.sparkSession
    return two, one.train_log(spark, "landmark").union(two.train_log(spark, "full"))


def best_epoch(log: DataFrame, step: int = 10, last_from: int = 495) -> DataFrame:
    """Epoch with the smallest validation error per run, snapped to its checkpoint.

    Below one step it is the first checkpoint, from ``last_from`` on the last
    one (500 in runs of that length), else the nearest multiple of ``step``.
    """
    best = log.groupBy("run").agg(
        F.min_by("epoch", F.struct("val", "epoch")).alias("epoch"), F.max("epoch").alias("_max")
    )
    near = F.bround(F.col("epoch") / step, 0).cast("int") * step
    last = (F.floor((F.col("_max") + step) / step) * step).cast("int")
    snapped = F.when(F.col("epoch") < step, F.lit(step)).when(F.col("epoch") >= last_from, last).otherwise(near)
    return best.select("run", "epoch", snapped.cast("int").alias("checkpoint"))


def predict_pairs(spark, decoder, emb: DataFrame, src: list[int], dst: list[int]) -> DataFrame:
    """One prediction per position of two equally long id lists."""
    if len(src) != len(dst):
        raise ValueError("src and dst must have the same length")
    rows = [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(src, dst))]
    pairs = spark.createDataFrame(rows, "pos int, src bigint, dst bigint")
    return decoder.predict(pair_features(pairs, emb)).select("pos", "src", "dst", "pred")
