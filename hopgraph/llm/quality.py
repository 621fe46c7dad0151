"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics of a whole text are transformed towards normal shapes.  Each class gets a mean
and a covariance, shrunk towards the pooled one and towards a multiple of the identity; a
text's log odds are the difference of the Gaussian log densities, by Mahalanobis distances
from the cached Cholesky factors.  Class sums are added up in Spark from all labelled rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopgraph.llm.common import map_rows, ship, table, utf8
from hopgraph.plans.scratch import Scratch

STATISTICS = (
    "words word_bytes capitals symbols digits marks wide spaces distinct_words distinct_lines"
    " line_bytes short_words entropy deflated repeats strong_marks"
).split()
#: Shrinkage towards the pooled covariance and towards the identity.
POOLED, ROUND = 0.1, 0.02
#: Rows scoring at least this are predicted to be of label 1.
CUT = 0.3

_CLASSES = np.zeros((256, 7))
for _k, _bytes in enumerate(
    (range(65, 91), b"#$%&*+/<=>@\\^_`{|}~[]", range(48, 58), b".,;:?!\"'()-", range(128, 256), b" \t\n\r\x0b\x0c", b"!")
):
    _CLASSES[list(_bytes), _k] = 1


def statistics(text: bytes | None) -> list[float]:
    """Transformed statistics of one text; a null text is an empty one."""
    text = text or b""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = np.sqrt(counts @ _CLASSES / (n + 1))
    part = counts[counts > 0] / max(n, 1)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x]
    w, k = len(words), len(lines)
    short = sum(1 for x in words if len(x) < 4)
    again = sum(1 for a, b in zip(words, words[1:]) if a == b)
    return [
        np.log1p(w),
        np.log1p(sum(map(len, words)) / (w + 1)),
        *share[:6],
        np.log((len(set(words)) + 1) / (w + 1)),
        np.log((len(set(lines)) + 1) / (k + 1)),
        np.log1p(n / (k + 1)),
        np.sqrt((short + 1) / (w + 2)),
        float(-(part * np.log(part)).sum()),
        np.log((len(zlib.compress(text, 1)) + 1) / (n + 16)),
        np.sqrt(again / (w + 1)),
        share[6],
    ]


def _statistics(cols: dict) -> dict:
    return {"doc_id": cols["doc_id"], "x": [statistics(t) for t in cols["t"].to_pylist()]}


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every document's whole text."""
    rows = docs.select(F.col("doc_id").cast("long"), utf8().alias("t"))
    return map_rows(rows, _statistics, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Log odds of class 1 from two Gaussians."""

    mean: np.ndarray  # of all rows, and scale
    scale: np.ndarray
    centres: list[np.ndarray]
    inverses: list[np.ndarray]  # inverse Cholesky factors
    offset: float
    slope: float = 1.0
    shift: float = 0.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        far = [(((z - c)[:, :, None] * i.T[None]).sum(axis=1) ** 2).sum(axis=1) for c, i in zip(self.centres, self.inverses)]
        return self.offset + (far[0] - far[1]) / 2

    def score(self, x: np.ndarray) -> np.ndarray:
        t = np.clip(self.slope * self.log_odds(x) + self.shift, -500, 500)
        return 1 / (1 + np.exp(-t))


def _discriminant(n: list[float], total: list[np.ndarray], square: list[np.ndarray]) -> Discriminant:
    count = n[0] + n[1]
    mean = (total[0] + total[1]) / count
    scale = np.sqrt(np.maximum(np.diag(square[0] + square[1]) / count - mean**2, 1e-12))
    centres = [(t / m - mean) / scale for t, m in zip(total, n)]
    spread = [
        (s / m - np.outer(t / m, t / m)) / np.outer(scale, scale) for s, t, m in zip(square, total, n)
    ]
    pooled = (n[0] * spread[0] + n[1] * spread[1]) / count
    inverses, logs = [], []
    for s in spread:
        s = (1 - POOLED) * s + POOLED * pooled
        s = (1 - ROUND) * s + ROUND * np.trace(s) / len(s) * np.eye(len(s))
        factor = np.linalg.cholesky(s + 1e-9 * np.eye(len(s)))
        inverses.append(np.linalg.inv(factor))
        logs.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(mean, scale, centres, inverses, float(np.log(n[1] / n[0]) + (logs[0] - logs[1]) / 2))


def _platt(odds: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through counts by log odds (Newton steps)."""
    a, b = 0.1, 0.0
    weight, rate = good + bad, good / np.maximum(good + bad, 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * odds + b, -500, 500)))
        v = weight * np.maximum(p * (1 - p), 1e-9)
        g = np.array([(weight * (rate - p) * odds).sum() - 1e-3 * a, (weight * (rate - p)).sum()])
        h = np.array([[(v * odds**2).sum() + 1e-3, (v * odds).sum()], [(v * odds).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
        a, b = a + step[0], b + step[1]
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def _sums(batches):
    import pyarrow as pa

    held: dict[int, np.ndarray] = {}
    for batch in batches:
        x = np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, -1)
        y = batch.column("y").to_numpy()
        for c in np.unique(y):
            z = np.hstack([np.ones((int((y == c).sum()), 1)), x[y == c]])
            held[int(c)] = held.get(int(c), 0) + np.einsum("ni,nj->ij", z, z)
    for c, m in held.items():
        i, j = np.indices(m.shape)
        yield pa.RecordBatch.from_pydict({"y": np.full(m.size, c), "i": i.ravel(), "j": j.ravel(), "v": m.ravel()})


def fit(labelled: DataFrame) -> Discriminant | None:
    """The discriminant of the rows (x, y), y 0 or 1; None if a class has no row.

    What reaches the driver are the classes' sums, one number per pair of statistics, and
    the counts by rounded log odds (at most 2001 values) for the slope of the score.
    """
    parts = labelled.select("x", F.col("y").cast("long")).mapInArrow(_sums, "y long, i long, j long, v double")
    size = len(STATISTICS) + 1
    sums = np.zeros((2, size, size))
    for r in parts.groupBy("y", "i", "j").agg(F.sum("v").alias("v")).collect():
        sums[r.y, r.i, r.j] = r.v
    n = [sums[c, 0, 0] for c in (0, 1)]
    if min(n) == 0:
        return None
    model = _discriminant(n, [sums[c, 0, 1:] for c in (0, 1)], [sums[c, 1:, 1:] for c in (0, 1)])
    rows = map_rows(labelled.select("x", F.col("y").cast("long")), _odds, "y long, at long", model)
    counts = np.zeros((2, 2001))
    for r in rows.groupBy("y", "at").count().collect():
        counts[r.y, r["at"] + 1000] = r["count"]
    model.slope, model.shift = _platt(np.arange(-1000, 1001) / 10.0, counts[1], counts[0])
    return model


def _odds(cols: dict, model: Discriminant) -> dict:
    x = np.array(cols["x"].to_pylist(), float)
    return {"y": cols["y"], "at": np.clip(np.round(10 * model.log_odds(x)), -1000, 1000).astype(np.int64)}


def _score_rows(cols: dict, model: Discriminant | None) -> dict:
    x = np.array(cols["x"].to_pylist(), float)
    return {"doc_id": cols["doc_id"], "score": model.score(x) if model else np.full(len(x), 0.5)}


def scores(rows: DataFrame, model: Discriminant | None) -> DataFrame:
    """(doc_id, score) of feature rows; without a model every score is 0.5."""
    return map_rows(rows, _score_rows, "doc_id long, score double", model)


def training_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(x, y) of labelled documents outside the held-out fifth; a document with several label
    rows counts for each, a null label for none."""
    marks = labels.filter("quality in (0, 1) and pmod(crc32(cast(cast(doc_id as string) as binary)), 5) <> 0")
    return rows.join(marks.select(F.col("doc_id").cast("long"), F.col("quality").alias("y")), "doc_id").select("x", "y")


def train(docs: DataFrame, labels: DataFrame) -> Discriminant | None:
    return fit(training_rows(features(docs), labels))


def drop_low_quality(docs: DataFrame, model: Discriminant | None, cut: float = CUT) -> DataFrame:
    """The documents that score at least ``cut``, with all their columns; texts do not move.

    Null and empty texts are scored like any others.  Without a model (no labelled row of
    either class) all documents stay.
    """
    if model is None:
        return docs
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(model.score(np.array([statistics(t) for t in texts])))

    return docs.filter(score(utf8()) >= cut)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows, _ = Scratch(spark, "quality").save(features(table(spark, sf_dir, "documents")), "features")
    model = fit(training_rows(rows, table(spark, sf_dir, "labels")))
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    return scores(rows, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
