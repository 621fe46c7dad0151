import zlib

import numpy as np
from pyspark.sql import functions as F

from hopgraph.llm.quality import STATISTICS, drop_low_quality, features, fit, op3_quality, scores, statistics, train
from tests.llm.edge import documents, nothing


def test_statistics_of_odd_texts(spark):
    for t in (None, b"", b" \n", b"x", b"!" * 100000, "ä ö".encode(), b"\x00"):
        x = np.array(statistics(t))
        assert len(x) == len(STATISTICS) and np.isfinite(x).all()
    assert statistics(None) == statistics(b"")
    assert features(nothing(spark)).count() == 0
    assert features(documents(spark)).count() == documents(spark).count()


def test_log_odds_are_those_of_two_gaussians(spark):
    rng = np.random.default_rng(3)
    d = len(STATISTICS)
    mix = rng.normal(size=(2, d, d))
    x = [rng.normal(size=(400, d)) @ mix[c] + 3 * c for c in (0, 1)]
    rows = [(v.tolist(), c) for c in (0, 1) for v in x[c]]
    model = fit(spark.createDataFrame(rows, "x array<double>, y long").repartition(5))
    z = [(v - model.mean) / model.scale for v in x]
    spread = [np.cov(v.T, bias=True) for v in z]
    pooled = (spread[0] + spread[1]) / 2
    want = 0.0
    probe = (x[0][0] - model.mean) / model.scale
    for sign, v, s in zip((-1, 1), z, spread):
        s = 0.9 * s + 0.1 * pooled
        s = 0.98 * s + 0.02 * np.trace(s) / d * np.eye(d)
        far = probe - v.mean(axis=0)
        want += sign * -0.5 * (far @ np.linalg.solve(s, far) + np.linalg.slogdet(s)[1])
    assert abs(model.log_odds(x[0][:1])[0] - want) < 1e-5 * max(1, abs(want))
    right = (model.score(np.vstack(x)) >= 0.5) == np.repeat([False, True], 400)
    assert right.mean() > 0.95


def test_held_out_accuracy(spark):
    rows = op3_quality(spark, "/root/testdata/sf0.01").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    truth = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_dropping_and_odd_labels(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, 0), (5, 0), (3, None), (99, 1), (None, 0)], "doc_id long, quality int")
    model = train(docs, labels)
    kept = drop_low_quality(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    assert drop_low_quality(nothing(spark), model).count() == 0
    none = train(docs, labels.filter("quality = 1"))
    assert none is None and drop_low_quality(docs, none).count() == docs.count()
    assert scores(features(docs), none).filter(F.col("score") != 0.5).count() == 0
