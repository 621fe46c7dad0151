"""Toxicity by a support vector machine on a string kernel, approximated by Nyström landmarks.

Kernel.  Two words are as alike as the subsequences of ``ORDER`` characters that they share, each
weighted by ``DECAY`` to the power of the letters it spans, so that inserted characters and gaps
cost little (spans of more than ``SPAN`` characters are left out); divided by the words' own norms.

Words are the runs of letters and digits of what white space separates, lowered, with a mark in
front: what is inserted between the letters of a word (``i.d-i*o t``) goes, and single letters in
a row are one word.  A very long word is several overlapping ones.

Training is on labelled sentences, those of toxic and of clean documents; of near copies of a
document (texts that share one of ``SIGNATURES`` smallest shingle hashes) the first is taken, and
copies of a sentence count once, so that the words of a text with many copies are no witnesses.  How many of either kind hold a word is added up in Spark.  Words much more frequent
in toxic sentences are their witnesses, words that are not are clean.  Landmarks are words least
explained by those before them (pivoted Cholesky); the machine is fitted in the space they span,
by squared hinge loss, then anew with the clean words that it takes for toxic.  A text's
score follows from its worst word and from how many are toxic by a logistic curve, fitted on counts
by rounded values of the labelled texts.

As the machine is linear in the subsequences of its landmarks, it is folded into one weight for
each of them; scoring a word is a sum over its subsequences.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from hopgraph.llm.common import arrow_schema, map_rows, ship, slices, table, utf8
from hopgraph.plans.scratch import Scratch

#: Characters of a subsequence, longest span it may have, weight of each character spanned.
ORDER, SPAN, DECAY = 4, 7, 0.75
#: Characters of a word, mark included; longer ones are cut, overlapping by half.
WORD = 24
LANDMARKS = 256
#: Labelled documents of each label that are learned from, at most.
SAMPLE = 8000
#: Distinct words of each class that the machine is fitted on, at most: those in most sentences.
WORDS = 6000
#: Smallest hashes of a text's five-word shingles that tell near copies.
SIGNATURES = 8
#: Words a worker remembers the value of.
REMEMBERED = 1 << 18
#: A witness's word is this many times as frequent in toxic sentences as in clean ones, by so many
#: standard deviations; a word of less than ``EVEN`` times as many tells that it is clean.
LIFT, DEVIATIONS, EVEN = 6.0, 2.0, 1.5
#: Words of at least this value count as toxic ones of a text.
SURE = 0.5
#: Rounds in which clean words that are taken for toxic ones are added and the machine is fitted anew.
ROUNDS = 2
#: How much the words of a class weigh together against the machine's norm.
STRICT = 1000.0
CUT = 0.3

_MARK = "^"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_OTHER = re.compile(r"[\W_]+")


def _cut(word: str) -> list[str]:
    """The word with its mark, in parts if it is very long."""
    word = _MARK + word
    if len(word) <= WORD:
        return [word]
    return [word[at : at + WORD] for at in range(0, len(word) - WORD // 2, WORD // 2)]


def plain(token: str) -> str:
    """Letters and digits of a token, lowered."""
    token = token.lower()
    return token if token.isalnum() else _OTHER.sub("", token)


def spelled(tokens: list[str]) -> list[str]:
    """Words that are written as single letters in a row, each with at most two marks beside it."""
    found, letters = [], []
    for token in [*tokens, "the end"]:
        if len(token) > 3:
            if letters:
                if len(letters) > 1:
                    found.append("".join(letters))
                letters = []
            continue
        token = plain(token)
        if len(token) == 1:
            letters.append(token)
        elif token:
            if len(letters) > 1:
                found.append("".join(letters))
            letters = []
    return found


def sentences(text: str) -> list[set[str]]:
    """The marked words of each sentence; a line or a token that ends in . ! ? ends one."""
    out: list[set[str]] = []
    for line in text.split("\n"):
        found: set[str] = set()
        for token in line.split():
            word = plain(token)
            if len(word) > 1:
                found.update(_cut(word))
            if token[-1] in ".!?" and found:
                out.append(found)
                found = set()
        found.update(w for x in spelled(line.split()) for w in _cut(x))
        if found:
            out.append(found)
    return out


@lru_cache(maxsize=64)
def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the subsequences of a word of ``n`` characters, and their weights."""
    inside = [c for c in combinations(range(min(n, SPAN)), ORDER) if c[0] == 0]
    found = [tuple(x + at for x in c) for at in range(n) for c in inside if at + c[-1] < n]
    weights = [DECAY ** (c[-1] - c[0] + 1 - ORDER) for c in found]
    return np.array(found, np.int64).reshape(-1, ORDER), np.array(weights)


def subsequences(group: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, weights) of the subsequences of words of the same length; a row of codes each."""
    n = len(group[0])
    places, weights = _places(n)
    letters = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.uint64)
    codes = np.zeros((len(group), len(places)), np.uint64)
    for k in range(ORDER):
        codes = (codes + letters[:, places[:, k]]) * _MIX
        codes ^= codes >> np.uint64(29)
    return codes, weights


def _norms(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The words' own norms: equal subsequences add up before they are squared."""
    if not codes.shape[1]:
        return np.ones(len(codes))
    order = np.argsort(codes, axis=1, kind="stable")
    c, w = np.take_along_axis(codes, order, 1), weights[order]
    new = np.ones(c.shape, bool)
    new[:, 1:] = c[:, 1:] != c[:, :-1]
    at = np.flatnonzero(new.ravel())
    sums = np.add.reduceat(w.ravel(), at)
    return np.sqrt(np.bincount(at // c.shape[1], sums**2, len(c)))


def _by_length(found: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        step = max(1, (1 << 20) // max(1, len(_places(int(n))[0])))
        for a in range(0, len(at), step):
            part = at[a : a + step]
            yield part, [found[i] for i in part]


class Kernel:
    """Values of the normalised kernel between any words and fixed ones."""

    def __init__(self, fixed: list[str]):
        keys, owners, values = [], [], []
        for at, group in _by_length(fixed):
            codes, weights = subsequences(group)
            if codes.shape[1]:
                keys.append(codes.ravel())
                owners.append(np.repeat(at, codes.shape[1]))
                values.append((weights / _norms(codes, weights)[:, None]).ravel())
        self.n = len(fixed)
        self._likely = np.zeros(0, bool)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        self.keys, inverse = np.unique(flat, return_inverse=True)
        self.table = np.zeros((len(self.keys) + 1, self.n))  # the last row is for all that is not here
        if keys:
            np.add.at(self.table, (inverse, np.concatenate(owners)), np.concatenate(values))

    def likely(self) -> np.ndarray:
        """By the first 20 bits of a code whether a key begins so; most codes are no key."""
        if len(self._likely) == 0:
            self._likely = np.zeros(1 << 20, bool)
            self._likely[self.keys >> np.uint64(44)] = True
        return self._likely

    def _find(self, codes: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.keys, codes), len(self.keys) - 1)
        return np.where(self.keys[place] == codes, place, len(self.keys))

    def rows(self, found: list[str], weights_by_key: np.ndarray | None = None) -> np.ndarray:
        """k(word, fixed words) of each word, or its product with ``weights_by_key``."""
        by = self.table if weights_by_key is None else weights_by_key[:, None]
        out = np.zeros((len(found), by.shape[1]))
        for at, group in _by_length(found):
            codes, weights = subsequences(group)
            if not codes.shape[1] or not len(self.keys):
                continue
            place = np.full(codes.shape, len(by) - 1)
            likely = self.likely()[codes >> np.uint64(44)]
            place[likely] = self._find(codes[likely])
            norms = _norms(codes, weights)[:, None]
            if by.shape[1] == 1:
                out[at] = (by[place, 0] @ weights)[:, None] / norms
            else:
                out[at] = np.stack([weights @ by[p] for p in place]) / norms
        return out


def landmarks(candidates: list[str], m: int, worth: list[float] | None = None) -> list[int]:
    """Numbers of at most ``m`` candidates, each the one least explained by those before it; what is
    left of a candidate counts by its ``worth``."""
    m = min(m, len(candidates))
    left, chosen, rows = np.ones(len(candidates)), [], []
    by = np.ones(len(candidates)) if worth is None else np.array(worth)
    for _ in range(m):
        p = int((left * by).argmax())
        if left[p] < 1e-6:
            break
        column = Kernel([candidates[p]]).rows(candidates)[:, 0]
        column = column - sum((r[p] * r for r in rows), np.zeros(len(candidates)))
        rows.append(column / np.sqrt(left[p]))
        left = np.maximum(left - rows[-1] ** 2, 0)
        left[p] = 0
        chosen.append(p)
    return chosen


def hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0) -> np.ndarray:
    """Weights (the last one the offset) of the squared-hinge machine, by Newton steps; y is 1 or -1."""
    z = np.hstack([x, np.ones((len(x), 1))])
    keep = np.eye(z.shape[1])
    keep[-1, -1] = 1e-3
    w = np.zeros(z.shape[1])

    def loss(w: np.ndarray) -> float:
        return w @ keep @ w / 2 + c * (weight * np.maximum(1 - y * (z @ w), 0) ** 2).sum()

    for _ in range(40):
        inside = 1 - y * (z @ w) > 0
        a, b, v = z[inside], y[inside], weight[inside]
        g = keep @ w - 2 * c * (a.T @ (v * (b - a @ w)))
        step = np.linalg.solve(keep + 2 * c * (a.T * v) @ a, g)
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


@dataclass
class Machine:
    """Values of words: above 0 toxic, below 0 not; and the curve from a text's values to its score."""

    keys: np.ndarray
    by_key: np.ndarray
    offset: float
    curve: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0, 0.0, 0.0]))
    _known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_known": {}}

    def values(self, found: list[str]) -> np.ndarray:
        kernel = Kernel([])
        kernel.keys = self.keys
        return np.clip(kernel.rows(found, self.by_key)[:, 0] + self.offset, -1, 1)

    def texts(self, texts: list[str]) -> np.ndarray:
        """By text the value of its worst word, the logarithm of how many of its words are toxic,
        and of their share; a text without words has -1, 0 and the least share."""
        if len(self._known) > REMEMBERED:
            self._known.clear()
        parts = [t.split() for t in texts]
        more = [spelled(p) for p in parts]
        new = list(set().union(*parts, *more) - self._known.keys())
        cut = [_cut(w) if len(w := plain(t)) > 1 else [] for t in new]
        named = list(set().union(*cut))
        value = dict(zip(named, self.values(named).tolist()))
        self._known.update((t, max(map(value.__getitem__, c), default=-1.0)) for t, c in zip(new, cut))
        out = []
        for found, extra in zip(parts, more):
            values = [*map(self._known.__getitem__, found), *map(self._known.__getitem__, extra)]
            toxic = sum(v > SURE for v in values)
            out.append((max(values, default=-1.0), np.log1p(toxic) / 2, np.log((toxic + 0.5) / (len(values) + 50.0)) / 2))
        return np.array(out).reshape(-1, 3)

    def score(self, x: np.ndarray) -> np.ndarray:
        t = np.clip(self.curve[0] + x @ self.curve[1:], -500, 500)
        return 1 / (1 + np.exp(-t))


_ODD = np.random.default_rng(42).integers(0, 2**63, SIGNATURES, np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(text: bytes | None) -> list[int]:
    """The smallest of the shingles' hashes by each hash function; none for a text without words."""
    found = text.lower().split() if text else []
    if not found:
        return []
    shingles = list(map(b" ".join, zip(*[found[i:] for i in range(5)]))) or [b" ".join(found)]
    hashes = np.fromiter(map(xxh64_intdigest, shingles), np.uint64, len(shingles))
    low = [int((hashes * odd).min()) for odd in _ODD]
    return [xxh64_intdigest(x.to_bytes(8, "little"), j) - (1 << 63) for j, x in enumerate(low)]


def _signature_rows(cols: dict) -> dict:
    return {"id": cols["id"], "sigs": [signatures(t) for t in cols["t"].to_pylist()]}


def one_of_each(rows: DataFrame) -> DataFrame:
    """The rows (id, t, y) of which no signature comes in a row of a smaller id; ids are of distinct rows.

    Signatures meet by their smallest id, which combines before the shuffle; no pairs are listed.
    """
    found = map_rows(rows.select("id", "t"), _signature_rows, "id long, sigs array<long>")
    first = found.select("id", F.explode("sigs").alias("sig")).groupBy("sig").agg(F.min("id").alias("id"))
    alone = first.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == SIGNATURES)
    return rows.join(alone.select("id"), "id", "left_semi")


def _sentence_rows(cols: dict) -> dict:
    found = [[" ".join(sorted(s)) for s in sentences(_text(t))] for t in cols["t"].to_pylist()]
    return {"s": found, "y": cols["y"]}


def _count(schema: pa.Schema):
    """How many clean (y 0) and toxic (y 1) sentences hold each word, and how many there are (w
    null), added up per task in parts of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def emit() -> pa.RecordBatch:
            both = list(held[0].keys() | held[1].keys())
            got = {"w": both, "bad": [held[1][w] for w in both], "good": [held[0][w] for w in both]}
            held[0].clear()
            held[1].clear()
            return pa.RecordBatch.from_pydict(got, schema=schema)

        for batch in slices(batches):
            for sentence, y in zip(batch.column("s").to_pylist(), batch.column("y").to_pylist()):
                held[y].update(sentence.split(" "))
                held[y][None] += 1
            if len(held[0]) + len(held[1]) > REMEMBERED:
                yield emit()
        if held[0] or held[1]:
            yield emit()

    return run


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(t, y, weight) of labelled documents outside the held-out quarter, of each label the ``most``
    of the smallest hashes of their ids; weight is how many labelled ones each stands for.

    A document with both labels counts for each, a null label for none.  The ids taken are at
    most 2 x ``most`` rows and go to the texts, which do not move.
    """
    marks = labels.filter("toxic in (0, 1) and pmod(crc32(cast(cast(doc_id as string) as binary)), 4) <> 2")
    marks = marks.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("y")).distinct()
    total = {r.y: r["count"] for r in marks.groupBy("y").count().collect()}
    taken = [
        marks.filter(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most)
        .withColumn("weight", F.lit(total.get(y, 0) / max(1, min(most, total.get(y, 0)))))
        for y in (0, 1)
    ]
    taken = Scratch(docs.sparkSession, "toxicity").cut(taken[0].union(taken[1]), "taken")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("t"))
    return rows.join(F.broadcast(taken), F.col("doc_id") == F.col("_id")).select("t", "y", "weight")


def fit(rows: DataFrame, most: int = WORDS, m: int = LANDMARKS) -> Machine | None:
    """The machine of the rows (t, y, weight); None if a class has no sentence.

    All rows are counted in Spark.  What reaches the driver is ``most`` words of toxic sentences
    (the most frequent), 2 + ``ROUNDS`` times as many of clean ones (the most frequent, those of
    the smallest hashes and those taken for toxic) and counts by rounded values.
    """
    spark = rows.sparkSession
    ship(spark)
    work = Scratch(spark, "toxicity")
    rows, _ = work.save(rows.withColumn("id", F.xxhash64("t", "y")), "labelled")
    found = map_rows(one_of_each(rows), _sentence_rows, "s array<string>, y int").select(F.explode("s").alias("s"), "y").distinct()
    schema = "w string, bad long, good long"
    parts = found.mapInArrow(_count(arrow_schema(spark, schema)), schema)
    counts, _ = work.save(parts.groupBy("w").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "counts")
    total = counts.filter("w is null").first()
    if not total or not total.bad or not total.good:
        return None
    ratio = total.good / total.bad
    lift = (F.col("bad") + 0.5) * ratio / (F.col("good") + 0.5 * ratio)
    sure = (F.col("bad") * ratio - F.col("good")) / F.sqrt(F.col("bad") * F.lit(ratio**2) + F.col("good") + F.lit(ratio))
    known = counts.filter("w is not null").withColumns({"lift": lift, "sure": sure})
    witness = known.filter((F.col("lift") >= LIFT) & (F.col("sure") >= DEVIATIONS))
    calm = known.filter((F.col("lift") < EVEN) & (F.col("good") > 0))
    bad = {r.w: r.bad for r in witness.orderBy(F.desc("bad"), "w").limit(most).collect()}
    good = {r.w: r.good for r in calm.orderBy(F.desc("good"), "w").limit(most).collect()}
    good |= {r.w: r.good for r in calm.orderBy(F.xxhash64("w"), "w").limit(most).collect()}
    model = _machine(bad, good, m)
    if model is None:
        return None
    clean = known.filter((F.col("lift") < LIFT) & (F.col("good") > 0)).select("w", "good")
    hard: dict[str, float] = {}
    for _ in range(ROUNDS):
        wrong = map_rows(clean, _taken, "w string, good long, value double", model).filter("value > -0.5")
        wrong = wrong.withColumn("worth", (F.col("value") + 1) * F.sqrt("good"))
        for r in wrong.orderBy(F.desc("worth"), "w").limit(most).collect():
            good[r.w], hard[r.w] = r.good, hard.get(r.w, 0.0) + r.worth
        model = _machine(bad, good, m, hard)
    places = map_rows(rows, _places_of, "y int, x array<int>, weight double", model).groupBy("y", "x").agg(F.sum("weight").alias("n")).collect()
    x = np.array([r.x for r in places], float).reshape(-1, 3) / 20
    model.curve = _logistic(x, np.array([r.y for r in places]), np.array([r.n for r in places], float))
    return model


def _taken(cols: dict, model: Machine) -> dict:
    return {"w": cols["w"], "good": cols["good"], "value": model.values(cols["w"].to_pylist())}


def _gapped(word: str) -> list[str]:
    """The word with one inserted character (one of no other word) at each place inside."""
    return [word[:at] + "\0" + word[at:] for at in range(3, min(len(word), WORD - 1))]


def _machine(bad: dict[str, int], good: dict[str, int], m: int, hard: dict[str, float] | None = None) -> Machine | None:
    """The machine that tells the words of ``bad`` from those of ``good``, given how many sentences have them.

    ``hard`` are words of ``good`` that an earlier machine took for toxic, and how grave that is:
    together they weigh as much as the others, and landmarks are taken from them first.
    """
    if not bad or not good:
        return None
    gapped = {g: bad[w] / 4 for w in bad for g in _gapped(w)}
    found = [*bad, *gapped, *good]
    y = np.repeat([1.0, -1.0], [len(bad) + len(gapped), len(good)])
    size = np.sqrt(np.array([*bad.values(), *gapped.values(), *good.values()], float))
    size[: len(bad) + len(gapped)] **= 2  # rare ones may be there by chance
    if hard:
        again = np.array([w in hard for w in found])
        size[again] *= size[(y < 0) & ~again].sum() / size[again].sum()
    weight = STRICT * np.where(y > 0, size / size[y > 0].sum(), size / size[y < 0].sum())
    plus, minus = (sorted(d, key=lambda w: (-d[w], w)) for d in (bad, good))
    plus, minus = plus[: 8 * m], minus[: 4 * m]
    chosen = [plus[i] for i in landmarks(plus, m // 2, [np.sqrt(bad[w]) for w in plus])]
    worst = sorted(hard or {}, key=lambda w: (-hard[w], w))[: 8 * m]
    chosen += [worst[i] for i in landmarks(worst, (m - len(chosen)) * 3 // 4, [hard[w] for w in worst])]
    minus = [w for w in minus if w not in chosen]
    chosen += [minus[i] for i in landmarks(minus, m - len(chosen))]
    kernel = Kernel(chosen)
    values, vectors = np.linalg.eigh(kernel.rows(chosen))
    keep = values > 1e-3
    root = vectors[:, keep] / np.sqrt(values[keep])
    w = hinge(kernel.rows(found) @ root, y, weight)
    return Machine(kernel.keys, np.append(kernel.table[:-1] @ (root @ w[:-1]), 0.0), float(w[-1]))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Curve (offset, slopes) through counts ``n`` of label ``y`` at ``x``, a little held back."""
    z = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        v = n * np.maximum(p * (1 - p), 1e-9)
        g = z.T @ (n * (y - p)) - 1e-2 * w
        step = np.linalg.solve((z.T * v) @ z + 1e-2 * np.eye(len(w)), g)
        w = w + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
    return w


def _text(t: bytes | None) -> str:
    return (t or b"").decode()


def _places_of(cols: dict, model: Machine) -> dict:
    x = model.texts([_text(t) for t in cols["t"].to_pylist()])
    return {"y": cols["y"], "weight": cols["weight"], "x": np.clip(np.round(20 * x), -200, 400).astype(int).tolist()}


def _score_rows(cols: dict, model: Machine | None) -> dict:
    texts = cols["t"].to_pylist()
    if model is None:
        return {"doc_id": cols["doc_id"], "score": np.full(len(texts), 0.5)}
    return {"doc_id": cols["doc_id"], "score": model.score(model.texts([_text(t) for t in texts]))}


def scores(docs: DataFrame, model: Machine | None) -> DataFrame:
    """(doc_id, score) of every document; a null text is an empty one, without a model all are 0.5.

    Repeated rows are scored each, an empty table gives no rows, other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("t"))
    return map_rows(rows, _score_rows, "doc_id long, score double", model)


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    return scores(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
