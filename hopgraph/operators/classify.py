"""Node classification on embeddings."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopgraph.functions.hashing import h
from hopgraph.functions.vectors import dot
from hopgraph.plans.numbering import number_rows
from hopgraph.plans.scratch import Scratch


def split_share(ids: DataFrame, n: int, share: float, seed: int) -> DataFrame:
    """Flag ``train`` for the first ``share`` of the nodes in hash order (exact count)."""
    cut = int(share * n)
    return number_rows(ids.select("id"), h("id", seed), "id", name="rn").select(
        "id", (F.col("rn") < cut).alias("train")
    )


def rank_labels(emb: DataFrame, labels: DataFrame, train: DataFrame, reg: float = 0.01, max_iter: int = 50) -> DataFrame:
    """``(id, label)`` - one logistic model per label, as many labels per node as it truly has.

    ``labels(id, label)`` long form, ``train(id, train)`` marks the training nodes.
    """
    scratch = Scratch(emb.sparkSession, "rank")
    rows = scratch.cut(
        emb.join(train, "id").select("id", "train", F.transform("v", lambda x: x.cast("double")).alias("v"))
    )
    fit_rows = scratch.cut(rows.filter("train").select("id", "v"))
    known = [
        r.label
        for r in labels.join(fit_rows, "id", "left_semi").select("label").distinct().orderBy("label").collect()
    ]
    scores = []
    for label in known:  # one model per class; the number of classes is small and fixed
        mine = labels.filter(F.col("label") == label).select("id", F.lit(1.0).alias("_y"))
        data = fit_rows.join(mine, "id", "left").select(
            array_to_vector("v").alias("x"), F.coalesce("_y", F.lit(0.0)).alias("y")
        )
        model = LogisticRegression(featuresCol="x", labelCol="y", regParam=reg, maxIter=max_iter).fit(data)
        # the fitted weights become a plain expression, so all classes score in one pass
        weights = F.array(*[F.lit(float(c)) for c in model.coefficients])
        logit = dot(F.col("v"), weights) + F.lit(float(model.intercept))
        scores.append(F.struct(F.lit(label).alias("label"), (F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))).alias("p")))
    parts = rows.filter("not train").select("id", F.explode(F.array(*scores)).alias("s")).select("id", "s.label", "s.p")
    wanted = labels.groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    w = W.partitionBy("id").orderBy(F.desc("p"), "label")
    return parts.withColumn("rn", F.row_number().over(w)).join(wanted, "id").filter("rn <= k").select("id", "label")


def f1_scores(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Micro and macro F1 of two long label tables."""
    both = pred.select("id", "label", F.lit(1).alias("p")).join(
        truth.select("id", "label", F.lit(1).alias("t")), ["id", "label"], "full_outer"
    )
    hit = F.col("p").isNotNull() & F.col("t").isNotNull()
    per = both.groupBy("label").agg(
        F.sum(hit.cast("int")).alias("tp"),
        F.sum(F.col("t").isNull().cast("int")).alias("fp"),
        F.sum(F.col("p").isNull().cast("int")).alias("fn"),
    )
    tp, wrong = F.col("tp"), F.col("fp") + F.col("fn")
    return per.agg(
        (2 * F.sum(tp) / (2 * F.sum(tp) + F.sum(wrong))).alias("micro_f1"),
        F.avg(2 * tp / (2 * tp + wrong)).alias("macro_f1"),
    )


def protocol(
    emb: DataFrame, labels: DataFrame, shares: list[float], shuffles: int = 10, seed: int = 0, name: str = "emb"
) -> DataFrame:
    """Every shuffle and training share -> ``(encoder, shuffle, share, micro_f1, macro_f1)``."""
    spark = emb.sparkSession
    scratch = Scratch(spark, "protocol")
    ids, n = scratch.save(emb.join(labels, "id", "left_semi").select("id").distinct())
    rows = []
    for s in range(shuffles):
        for share in shares:
            split = scratch.cut(split_share(ids, n, share, seed + s))
            pred = rank_labels(emb, labels, split)
            truth = labels.join(split.filter("not train"), "id", "left_semi")
            got = f1_scores(pred, truth).first()
            rows.append((name, s, share, got.micro_f1, got.macro_f1))
    return spark.createDataFrame(rows, "encoder string, shuffle int, share double, micro_f1 double, macro_f1 double")


def softmax_accuracy(
    emb: DataFrame, labels: DataFrame, train: DataFrame, hidden: int = 16, classes: int | None = None, width: int | None = None, seed: int = 0
) -> DataFrame:
    """Single-label network classifier (sigmoid hidden layer, softmax output); accuracy on the rest."""
    data = emb.join(labels, "id").join(train, "id").select(
        "train", array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("x"), F.col("label").cast("double").alias("y")
    )
    if width is None:
        width = len(emb.first().v)
    if classes is None:
        classes = int(labels.agg(F.max("label")).first()[0]) + 1
    net = MultilayerPerceptronClassifier(featuresCol="x", labelCol="y", layers=[width, hidden, classes], seed=seed, maxIter=100)
    out = net.fit(data.filter("train")).transform(data.filter("not train"))
    return out.agg(F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("cnt"))


def score_matrix(results: DataFrame, shares: list[float], metric: str = "micro_f1") -> DataFrame:
    """Mean over shuffles, one row per encoder, one column per training share."""
    return results.groupBy("encoder").pivot("share", shares).agg(F.avg(metric))


def block_masks(nodes: DataFrame, train: int = 140, val: int = 70) -> DataFrame:
    """First block of nodes by id trains, the next one validates."""
    rn = F.col("rn")
    return number_rows(nodes.select("id"), "id", name="rn").select(
        "id", (rn < train).alias("train_mask"), ((rn >= train) & (rn < train + val)).alias("val_mask")
    )
