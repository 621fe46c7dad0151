"""The kernel against its definition, and held-out accuracy."""

import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopgraph.llm.toxicity import (
    DECAY, ORDER, SPAN, WORD, Kernel, _cut, fit, hinge, landmarks, one_of_each, op11_toxicity, plain, scores, sentences, spelled, training_rows,
)
from tests.llm.edge import documents, nothing


def slow_kernel(a, b):
    def all_of(w):
        out = {}
        for c in combinations(range(len(w)), ORDER):
            span = c[-1] - c[0] + 1
            if span <= SPAN:
                u = tuple(w[i] for i in c)
                out[u] = out.get(u, 0) + DECAY ** (span - ORDER)
        return out

    x, y = all_of(a), all_of(b)
    norm = np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y.get(k, 0) for k, v in x.items()) / norm if norm else 0.0


def test_kernel_is_that_of_gapped_subsequences():
    rng = random.Random(1)
    found = ["^" + "".join(rng.choice("abcé\U0001f600") for _ in range(rng.randrange(0, 12))) for _ in range(40)]
    fixed = found[:15]
    got = Kernel(fixed).rows(found)
    want = np.array([[slow_kernel(a, b) for b in fixed] for a in found])
    assert np.allclose(got, want)
    weights = rng.random(), *[rng.random() for _ in fixed[1:]]
    k = Kernel(fixed)
    assert np.allclose(k.rows(found, k.table @ weights)[:, 0], want @ weights)


def test_landmarks_explain_the_rest():
    found = ["^idiot", "^idiots", "^flower", "^flowers", "^idiotic", "^zebra"]
    first = [found[i] for i in landmarks(found, 3)]
    assert len({w[:4] for w in first}) == 3
    assert len(landmarks(["^same", "^same"], 2)) == 1


def test_hinge_separates():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    y = np.where(x @ [1, -2, 0, 0.5] + 0.3 > 0, 1.0, -1.0)
    w = hinge(x, y, np.ones(300))
    assert ((x @ w[:-1] + w[-1] > 0) == (y > 0)).mean() > 0.97


def test_words_of_sentences():
    assert sentences("You, I.d-i*o t!\nyes. no way") == [{"^you", "^idio"}, {"^yes"}, {"^no", "^way"}]
    assert sentences("m o r o n") == [{"^moron"}] and sentences("x") == []
    assert spelled("you m o r. ***o n are a fool i d ! t".split()) == ["mor", "idt"]
    assert spelled("I am a fool".split()) == [] and plain("I.D-i_0T!") == "idi0t"
    assert sentences("") == sentences(" \n. !") == []
    long = _cut("x" * 1000)
    assert all(len(w) <= WORD for w in long) and sum(map(len, long)) >= 1000


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice(["ba", "lo", "the", "ri", "on", "ea"]) for _ in range(rng.randrange(1, 4))) for _ in range(200)]
    rows, labels = [], []
    for i in range(400):
        text = [rng.choice(vocabulary) for _ in range(60)]
        if i % 5 == 0:
            for k in range(4):
                text[10 * k + 5] = rng.choice(["idiot", "moron", "trash"])
        rows.append((i, " ".join(text) + "."))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return fit(training_rows(docs, spark.createDataFrame(labels, "doc_id long, toxic int")))


def test_gaps_and_inserted_characters(spark, model):
    bad = ["idiot", "i.d.i.o.t", "id-iot", "idxiot", "m o r o n", "MORON!!", "tra_sh"]
    rows = [(i, f"the balo {w} riba {w} onea lo {w} balo") for i, w in enumerate([*bad, "balo", "therion", "b a l o"])]
    got = {r.doc_id: r.score for r in scores(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all((got[i] >= 0.3) == (i < len(bad)) for i in got), got


def test_odd_rows(spark, model):
    docs = documents(spark)
    got = scores(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 0.3 for r in got)
    assert scores(nothing(spark), model).count() == 0
    assert {r.score for r in scores(docs, None).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, 0), (5, 0), (3, None), (99, 1), (None, 0)], "doc_id long, toxic int")
    assert fit(training_rows(docs, labels.filter("toxic = 1"))) is None
    assert fit(training_rows(nothing(spark), labels)) is None
    fit(training_rows(docs, labels))


def test_near_copies_count_once(spark):
    rng = random.Random(5)
    text = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(0, " ".join(text), 1)]
    for i in range(1, 30):
        new = list(text)
        for k in rng.sample(range(200), 4):
            new[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(new), 1))
    rows += [(100 + i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(50)), 0) for i in range(20)] + [(200, "", 0), (201, None, 0)]
    docs = spark.createDataFrame(rows, "id long, t string, y int").withColumn("t", F.col("t").cast("binary"))
    assert {r.id for r in one_of_each(docs).collect()} == {0, *range(100, 120)}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = op11_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").filter(F.col("toxic").isNotNull()).collect()}
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert sum(a & b for a, b in held) > 0.9 * sum(a for a, _ in held)
