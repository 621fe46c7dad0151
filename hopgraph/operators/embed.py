"""Node embeddings (E1-E13).  An embedding is a table ``(id, v array<double>)``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopgraph.functions.hashing import draw, h
from hopgraph.functions.vectors import add, dot, scale, sq_l2, vector_sum
from hopgraph.operators import held
from hopgraph.operators.graph import Graph
from hopgraph.operators.traverse import cached_components
from hopgraph.operators.walk import KINDS, Walker, decayed_walks, distance_bounds, resample
from hopgraph.plans.scratch import Scratch


# ---------------------------------------------------------------- E1 skip-gram
def window_pairs(walks: DataFrame, window: int) -> DataFrame:
    """``(u, v, cnt)``: co-occurrences within ``window`` positions, counted before any training."""
    pairs = walks.select(
        F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(1), F.lit(window)),
                    lambda k: F.transform(
                        F.sequence(F.lit(0), F.greatest(F.size("path") - 1 - k, F.lit(0))),
                        lambda i: F.struct(F.get("path", i).alias("u"), F.get("path", i + k).alias("v")),
                    ),
                )
            )
        ).alias("e")
    ).select("e.u", "e.v").filter("v is not null")
    both = pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
    return both.select("e.u", "e.v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("cnt"))


def skipgram(
    walks: DataFrame, dim: int = 16, window: int = 5, iters: int = 20, seed: int = 0, rate: float = 0.5, negatives: int = 1
) -> DataFrame:
    """Skip-gram over ``walks(path)`` by joins and sums, nothing kept on the driver.

    Counted co-occurrences are positive samples; each node is matched with hashed
    partners as negatives.  The embedding table is updated once per iteration with
    summed gradients, so the result does not depend on the partitions.  Every node
    of the walks has a vector.
    """
    from hopgraph.operators.sample import draw_partners

    scratch = Scratch(walks.sparkSession, "sgj")
    pos = scratch.cut(window_pairs(walks, window).select("u", "v", F.col("cnt").cast("double").alias("w"), F.lit(1.0).alias("t")))
    ids, n = scratch.save(walks.select(F.explode("path").alias("id")).distinct())
    neg = draw_partners(ids.select(F.col("id").alias("src")), ids, n, negatives * 2 * window, seed)
    pairs = scratch.cut(
        pos.union(neg.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1.0), F.lit(0.0)).filter("u <> v"))
    )

    def coef(a: Column, b: Column, row) -> tuple[Column, Column, Column, Column]:
        z = F.lit(1.0) / (F.lit(1.0) + F.exp(-dot(a, b)))
        g = (z - row("t")) * row("w")
        zero = F.lit(0.0)
        return zero, g, zero, g

    return descend(pairs, random_vectors(ids, dim, seed, 0.5), dim, coef, iters, rate, weight="w")


# ------------------------------------------------- shared descent on pair losses
def descend(
    pairs: DataFrame,
    emb: DataFrame,
    dim: int,
    coef: Callable,
    iters: int,
    rate: float,
    weight: str | None = None,
    both: bool = True,
    ridge: float = 0.0,
    clip: float = 1.0,
) -> DataFrame:
    """Batch gradient descent on a pair loss; ``pairs(u, v, ...)``, ``emb(id, v)``.

    ``coef(a, b, col)`` returns four factors (p, q, r, s): the gradient of the
    first vector is p*a + q*b, of the second r*b + s*a.  Gradients are summed
    by node with map-side combine, averaged over the node's pairs and clipped.
    One iteration is two joins and one aggregation.
    """
    scratch = Scratch(pairs.sparkSession, "descend")
    w = F.col(weight) if weight else F.lit(1.0)
    for i in range(iters):
        a = emb.select(F.col("id").alias("u"), F.col("v").alias("_a"))
        b = emb.select(F.col("id").alias("v"), F.col("v").alias("_b"))
        j = pairs.join(a, "u").join(b, "v")
        p, q, r, s = coef(F.col("_a"), F.col("_b"), F.col)
        first = F.struct(F.col("u").alias("id"), add(scale(F.col("_a"), p), scale(F.col("_b"), q)).alias("g"), w.alias("w"))
        second = F.struct(F.col("v").alias("id"), add(scale(F.col("_b"), r), scale(F.col("_a"), s)).alias("g"), w.alias("w"))
        rows = j.select(F.explode(F.array(first, second) if both else F.array(first)).alias("e")).select("e.*")
        grad = rows.groupBy("id").agg(vector_sum("g", dim).alias("g"), F.sum("w").alias("n"))
        mean = F.zip_with("v", "g", lambda x, g: g / F.col("n") + F.lit(2.0 * ridge) * x)
        stepped = emb.join(grad, "id", "left").select(
            "id", "v", F.when(F.col("g").isNotNull(), mean).alias("g")
        )
        size = F.sqrt(dot(F.col("g"), F.col("g")))
        step = F.lit(rate) * F.least(F.lit(1.0), F.lit(clip) / F.greatest(size, F.lit(1e-12)))
        emb = scratch.cut(
            stepped.select(
                "id",
                F.when(F.col("g").isNull(), F.col("v")).otherwise(F.zip_with("v", "g", lambda x, g: x - step * g)).alias("v"),
            ),
            f"e{i}",
        )
    return emb


# -------------------------------------------------------------- E2 random vectors
def random_vectors(
    nodes: DataFrame, dim: int, seed: int = 0, spread: float = 1.0, gaussian: bool = False, absolute: bool = False
) -> DataFrame:
    """Uniform in [-spread, spread] or gaussian vectors from hashes of (id, position)."""
    if gaussian:
        # Box-Muller on two hashed uniforms
        def one(k):
            u, w = draw(seed, "id", k), draw(seed + 1, "id", k)
            return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0 * np.pi) * w) * F.lit(spread)
    else:
        def one(k):
            return (draw(seed, "id", k) * 2 - 1) * F.lit(spread)

    v = F.transform(F.sequence(F.lit(1), F.lit(dim)), one)
    return nodes.select("id", (F.transform(v, F.abs) if absolute else v).alias("v"))


# --------------------------------------------------- E3, E4 spectral embeddings
GUARD = 6  # extra columns that speed up the convergence of the wanted ones
DEGREE = 10  # most operator steps between two orthonormalisations, by joins
HELD_DEGREE = 200  # the same where a worker holds the graph
HELD_NODES = 1 << 21  # nodes up to which it holds a column as well
TOLERANCE = 1e-5  # largest residual of a finished pair, as a share of the spectrum


def _gram(df: DataFrame, *columns: str) -> np.ndarray:
    """Inner products of all columns of the arrays ``columns``, laid side by side; summed per task."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = np.hstack([c.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in b.columns])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_pydict({"g": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})

    parts = [np.array(r.g) for r in df.select(*columns).mapInArrow(sums, "g array<double>").collect()]  # one row per task
    whole = np.sum(parts, axis=0)
    k = int(np.sqrt(len(whole)))
    return whole.reshape(k, k)


def _turned(parts: list[tuple[str, np.ndarray]]) -> Column:
    """Sum of the arrays times small matrices."""
    out = []
    for j in range(parts[0][1].shape[1]):
        terms = [dot(F.col(c), F.array(*[F.lit(float(x)) for x in m[:, j]])) for c, m in parts if len(m)]
        out.append(reduce(lambda a, b: a + b, terms))
    return F.array(*out)


def _kernel(graph: Graph, weight: Column, most: int, seed: int) -> tuple[DataFrame, int]:
    """``(id, blks, deg, z)``: up to ``most`` orthonormal vectors that are a multiple of ``weight`` on every
    component with arcs, and their number.

    They have the extreme eigenvalue of both operators exactly, one for each component.  The first is
    the trivial vector, a multiple of ``weight`` everywhere; the others are drawn.
    """
    scratch = Scratch(graph.spark, "kernel")
    nodes = cached_components(graph).join(graph.nodes, "id").select("id", "comp", "blks", "deg")
    nodes = nodes.withColumn("w", F.when(F.col("deg") > 0, weight).otherwise(F.lit(0.0)))
    comps, count = scratch.save(nodes.filter("deg > 0").groupBy(F.col("comp").alias("id")).agg(F.sum(F.col("w") * F.col("w")).alias("s")))
    c = min(count, most)
    drawn = random_vectors(comps, c, seed).join(comps, "id")
    first = F.concat(F.array(F.lit(1.0)), F.slice("v", 1, c - 1)) if c > 1 else F.array(F.lit(1.0))
    drawn = scratch.cut(drawn.select("id", first.alias("v"), scale(first, F.sqrt("s")).alias("y")))
    turn = np.linalg.inv(np.linalg.cholesky(_gram(drawn, "y"))).T  # keeps the direction of the first
    named = drawn.select(F.col("id").alias("comp"), _turned([("v", turn)]).alias("z"))
    none = F.array(*[F.lit(0.0)] * c)
    z = F.coalesce(scale(F.col("z"), F.col("w")), none).alias("z")
    return scratch.cut(nodes.join(named, "comp", "left").select("id", "blks", F.greatest("deg", F.lit(1)).cast("double").alias("deg"), z)), c


def _extreme(
    graph: Graph, dim: int, iters: int | None, seed: int, weight: Column, apply: Callable, operator: Callable,
    low: float, top: float,
) -> tuple[DataFrame, np.ndarray]:
    """Eigenvectors of the ``dim`` largest eigenvalues of an operator next to the trivial one, and the values.

    ``apply(x, k)`` takes ``x(id, blks, deg, z, v, ...)`` and adds ``w``, the operator times ``v``; its
    spectrum lies between ``low`` and ``top``.  ``top`` belongs to the vectors of ``_kernel``; if they do not
    suffice, the rest comes from subspace iteration at right angles to them.  Between two
    orthonormalisations a Chebyshev polynomial of the operator damps all below the smallest value of
    the block, so the steps follow the square root of the gap.  Its columns are independent of each other: where
    the graph fits into a worker, each is one task's (``operator`` is the same there).  It ends when the residuals of the wanted
    pairs are below ``TOLERANCE`` or after ``iters`` steps of the operator, if given.
    """
    x, c = _kernel(graph, weight, dim + 1, seed)
    if c > dim:
        return x.select("id", F.slice("z", 2, dim).alias("v")), np.full(dim, top)
    want = dim + 1 - c
    k = min(want + GUARD, graph.n - c)
    scratch = Scratch(graph.spark, "spectral")
    keep = ["id", "blks", "deg", "z"]
    x = x.join(random_vectors(graph.nodes, k, seed), "id").select(*keep, "v")
    names: list[str] = []

    def store(df: DataFrame) -> DataFrame:
        """Store a state; the one before the last is not read again."""
        out = scratch.cut(df, f"x{len(names)}")
        names.append(f"x{len(names)}")
        if len(names) > 2:
            scratch.remove(names[-3])
        return out

    done, cut = 0, low
    here = held.fits(graph) and graph.n <= HELD_NODES
    while True:
        both = store(apply(x, k).select(*keep, "v", "w"))
        done += 1
        g = _gram(both, "z", "v", "w")
        zv, vv, vw, ww = g[:c, c : c + k], g[c : c + k, c : c + k], g[c : c + k, c + k :], g[c + k :, c + k :]
        # at right angles to z: v - z zv, and the operator times it: w - top z zv
        size, turn = np.linalg.eigh(vv - zv.T @ zv)
        fit = size > 1e-12 * size[-1]
        turn = turn[:, fit] / np.sqrt(size[fit])
        values, inner = np.linalg.eigh(turn.T @ ((vw + vw.T) / 2 - top * zv.T @ zv) @ turn)
        order = np.argsort(values)[::-1]
        values, turn = values[order], turn @ inner[:, order]
        square = np.einsum("ij,ik,kj->j", turn, ww - top**2 * zv.T @ zv, turn)
        rest = np.sqrt(np.maximum(square - values**2, 0.0))[:want]
        u = _turned([("v", turn), ("z", -zv @ turn)])
        if (rest <= TOLERANCE * (top - low)).all() or (iters is not None and done >= iters):
            out = both.select("id", F.concat(F.slice("z", 2, c - 1), F.slice(u, 1, want)).alias("v"))
            found = np.concatenate([np.full(c - 1, top), values[:want]])
            return scratch.cut(out), found
        k = len(values)
        cut = max(cut, min(values[-1], values[want - 1] - 1e-9 * (top - low)))
        half, mid = (cut - low) / 2, (cut + low) / 2
        if half <= 0:  # nothing is known to be damped yet
            x = both.select(*keep, _turned([("w", turn), ("z", -top * zv @ turn)]).alias("v"))
            continue
        # a larger polynomial would leave nothing of the block but its first vectors
        degree = min(HELD_DEGREE if here else DEGREE, max(1, int(7 / np.arccosh((values[0] - mid) / half))))
        degree = degree if iters is None else max(1, min(degree, iters - done))
        if here:
            y = held.filtered(graph, both.select("id", "z", u.alias("v")), k, operator, low, cut, float(values[0]), degree)
            x = store(both.select(*keep).join(y, "id"))
            done += degree
            continue
        s = s1 = half / (values[0] - mid)
        bu = [("w", s * turn / half), ("v", -mid * s * turn / half), ("z", -(top - mid) * s / half * zv @ turn)]
        x = store(both.select(*keep, u.alias("p"), _turned(bu).alias("v")))
        for _ in range(degree - 1):
            s2 = 1 / (2 / s1 - s)
            a, b, e = 2 * s2 / half, -2 * s2 * mid / half, -s * s2
            step = F.zip_with(F.zip_with("w", "v", lambda y, v: F.lit(a) * y + F.lit(b) * v), "p", lambda y, q: y + F.lit(e) * q)  # noqa: B023
            x = store(apply(x, k).select(*keep, F.col("v").alias("p"), step.alias("v")))
            done, s = done + 1, s2
        x = x.select(*keep, "v")


def _spread(graph: Graph, x: DataFrame, k: int) -> DataFrame:
    """Sum of neighbour vectors for every node of ``x(id, blks, v)``."""
    moved = graph.expand(x.select("id", "blks", "v")).select(F.col("dst").alias("id"), "v")
    return moved.groupBy("id").agg(vector_sum("v", k).alias("s"))


def laplacian_eigenmaps(graph: Graph, dim: int, iters: int | None = None, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """Eigenvectors of the smallest eigenvalues of the normalised Laplacian, first one dropped.

    Without ``iters`` the eigenvectors are iterated until they are found (``_extreme``).
    """

    def apply(x: DataFrame, k: int) -> DataFrame:  # (I - L) x = D^-1/2 A D^-1/2 x
        half = x.select("id", "blks", scale(F.col("v"), F.lit(1.0) / F.sqrt("deg")).alias("v"))
        s = scale(F.col("s"), F.lit(1.0) / F.sqrt("deg"))
        return x.join(_spread(graph, half, k), "id", "left").withColumn("w", F.coalesce(s, scale(F.col("v"), 0.0)))

    x, values = _extreme(graph, dim, iters, seed, F.sqrt("deg"), apply, held.symmetric, -1.0, 1.0)
    return x, 1.0 - values


def locally_linear(graph: Graph, dim: int, iters: int | None = None, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """Right singular vectors of M = I - D^-1 A with the smallest singular values, first dropped.

    They are the eigenvectors of the largest eigenvalues of -M'M, iterated until they are found unless
    ``iters`` is given (``_extreme``); the largest singular value of M is bounded by
    1 + sqrt(max degree / min degree).
    """
    lo, hi = graph.nodes.filter("deg > 0").agg(F.min("deg"), F.max("deg")).first()
    c = (1.0 + float(np.sqrt(hi / lo))) ** 2

    def minus(v: str, inner: bool) -> Column:
        s = scale(F.col("s"), F.lit(1.0) / F.col("deg")) if inner else F.col("s")
        return F.when(F.col("s").isNull(), F.col(v)).otherwise(F.zip_with(v, s, lambda x, y: x - y))

    def apply(x: DataFrame, k: int) -> DataFrame:
        mx = x.join(_spread(graph, x, k), "id", "left").withColumn("m", minus("v", True)).drop("s")  # M x
        scaled = mx.select("id", "blks", scale(F.col("m"), F.lit(1.0) / F.col("deg")).alias("v"))
        both = mx.join(_spread(graph, scaled, k), "id", "left")
        return both.withColumn("w", scale(minus("m", False), -1.0)).drop("m", "s")  # -M' (M x)

    x, values = _extreme(graph, dim, iters, seed, F.lit(1.0), apply, held.minus_square, -c, 0.0)
    return x, np.sqrt(np.maximum(-values, 0.0))


def factorise(graph: Graph, dim: int, iters: int = 30, rate: float = 0.1, ridge: float = 0.05, seed: int = 0) -> DataFrame:
    """E5: gradient steps on (1 - x_i . x_j)^2 with ridge; only i < j rows update x_i."""
    pairs = graph.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))

    def coef(a, b, row):
        zero = F.lit(0.0)
        return zero, F.lit(-2.0) * (F.lit(1.0) - dot(a, b)), zero, zero

    start = random_vectors(graph.nodes, dim, seed, 0.5)
    return descend(pairs, start, dim, coef, iters, rate, both=False, ridge=ridge)


def fit_squared_distance(pairs: DataFrame, emb: DataFrame, dim: int, iters: int = 30, rate: float = 0.05) -> DataFrame:
    """Minimise (||x_u - x_v||^2 - d^2)^2 over ``pairs(src, dst, d)``."""
    asked = pairs.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("d").cast("double").alias("t"))

    def coef(a, b, row):
        e = F.lit(4.0) * (sq_l2(a, b) - row("t") * row("t"))
        return e, -e, e, -e

    return descend(asked, emb, dim, coef, iters, rate)


def fit_cosine(samples: DataFrame, emb: DataFrame, dim: int, iters: int = 30, rate: float = 0.2) -> DataFrame:
    """Minimise (cos(x_u, x_v) - target)^2 over ``samples(src, dst, target)``."""
    asked = samples.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("target").alias("t"))

    def coef(a, b, row):
        na, nb = F.sqrt(dot(a, a)) + 1e-9, F.sqrt(dot(b, b)) + 1e-9
        cos = dot(a, b) / (na * nb)
        e = F.lit(2.0) * (cos - row("t"))
        return -e * cos / (na * na), e / (na * nb), -e * cos / (nb * nb), e / (na * nb)

    return descend(asked, emb, dim, coef, iters, rate)


# --------------------------------------------------- E6-E13 tables of vectors
def distance_vectors(packed: DataFrame) -> DataFrame:
    """Landmark distances as a vector, 0 where unknown; input of ``landmark.pack``."""
    return packed.select("id", F.transform("dv", lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("v"))


def concat_embeddings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Concatenate two embeddings by node."""
    return a.join(b.select("id", F.col("v").alias("_w")), "id").select("id", F.concat("v", "_w").alias("v"))


def reduce_width(emb: DataFrame, k: int) -> DataFrame:
    """Principal components."""
    vec = emb.select("id", array_to_vector("v").alias("x"))
    model = PCA(k=k, inputCol="x", outputCol="y").fit(vec)
    return model.transform(vec).select("id", vector_to_array("y").alias("v"))


def missing_nodes(emb: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes without a vector."""
    return nodes.select("id").join(emb, "id", "left_anti")


def size_check(emb: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row ``(vectors, nodes, matches)``."""
    n = nodes.agg(F.count(F.lit(1))).scalar()
    return emb.agg(F.count(F.lit(1)).alias("vectors")).select(
        "vectors", n.alias("nodes"), (F.col("vectors") == n).alias("matches")
    )


def fill_missing(emb: DataFrame, nodes: DataFrame, dim: int, seed: int = 0) -> DataFrame:
    """Every node gets a vector, random where none is known."""
    rand = random_vectors(nodes, dim, seed).withColumnRenamed("v", "_r")
    return rand.join(emb.select("id", "v"), "id", "left").select("id", F.coalesce("v", "_r").alias("v"))


def nan_to_zero(emb: DataFrame) -> DataFrame:
    """E10."""
    return emb.select("id", F.transform("v", lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))).alias("v"))


def reconstruct(emb: DataFrame, pairs: DataFrame, how: str = "kernel") -> DataFrame:
    """Edge weights of the given pairs, ``exp(-||a-b||^2)`` or dot product.

    The full matrix is this call on every pair; it is as large as n^2, so the
    pair list is the caller's.
    """
    from hopgraph.operators.predict import score_pairs

    x, y = F.col("_a"), F.col("_b")
    weight = F.exp(-sq_l2(x, y)) if how == "kernel" else dot(x, y)
    return score_pairs(pairs.select("src", "dst"), emb, weight=weight)


def neighbour_sum(arcs: DataFrame, emb: DataFrame, dim: int, weight: str | None = None) -> DataFrame:
    """Sum of the vectors of all sources of a node's arcs, optionally weighted."""
    j = arcs.join(emb.select(F.col("id").alias("src"), "v"), "src")
    w = None if weight is None else F.col(weight)
    return j.groupBy(F.col("dst").alias("id")).agg(vector_sum("v", dim, w).alias("v"))


def edge_softmax(arcs: DataFrame, score: str = "score") -> DataFrame:
    """Softmax of arc scores per destination; sums are combined map-side and joined back."""
    e = F.exp(F.col(score))
    total = arcs.groupBy("dst").agg(F.sum(e).alias("_t"))
    return arcs.join(total, "dst").select("src", "dst", (e / F.col("_t")).alias("share"))


def embed(
    graph: Graph, method: str, dim: int = 16, score: DataFrame | None = None, alpha: float = 0.9, walks: int = 40,
    length: int = 40, window: int = 20, seed: int = 0, iters: int = 20,
) -> DataFrame:
    """Embedding by method name."""
    if method == "random":
        return random_vectors(graph.nodes, dim, seed)
    if method == "lle":
        return locally_linear(graph, dim, seed=seed)[0]
    if method == "le":
        return laplacian_eigenmaps(graph, dim, seed=seed)[0]
    if method == "gf":
        return factorise(graph, dim, seed=seed)
    if method in KINDS:
        rule = KINDS[method]
        walker = Walker(graph, score if rule.score else None)
        corpus = (
            walker.run(graph.nodes, walks, length, rule, seed)
            if rule.decay is None
            else decayed_walks(walker, graph.nodes, walks, length, rule, seed)
        )
        return skipgram(corpus, dim, window, iters, seed)
    if method == "resampled":
        rule = KINDS["bc" if score is not None else "gen"]
        walked = Walker(graph, score).run(graph.nodes, walks, length, rule, seed)
        corpus = resample(distance_bounds(graph, walked), score, alpha, walks, length, seed)
        return skipgram(corpus, dim, window, iters, seed)
    raise ValueError(f"unknown embedding method {method!r}")


def hashed_score(seed: int = 0) -> Column:
    """Arc scores in {-1, 0, 1} from a hash of both ends (input of ``edge_softmax``)."""
    return (h(h("src", seed) + F.col("dst"), seed + 1) % 3 - 1).cast("double")


