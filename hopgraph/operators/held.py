"""Searches from very many sources on a graph that fits into a Python worker.

A search of two hops from every node has rows with the square of the nodes, and a join row per
arc and source.  Up to ``MOST`` arcs (4 bytes each) a worker holds the arcs instead, and a level of
thousands of searches is a few array operations per arc: nothing is shuffled but the sources and
what was asked for.  Sources are spread over the tasks; a task runs as many of its searches at a
time as its arrays may be large (``CELLS``), so its memory follows the arcs and not the sources.
Larger and directed graphs are searched by joins.

Nodes are numbered by (component, id), so a search runs inside one run of numbers, and inside a
component the order of numbers is that of ids.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopgraph.operators.graph import Graph

# workers need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST = 1 << 24  # arcs that a worker holds
LEAST = 1 << 10  # arcs below which nothing is gained
CELLS = 1 << 21  # numbers in an array of a task
PART = 1 << 16  # numbers of it that are fetched at a time
RANGE = 4096  # components are searched together up to this many nodes
LONG = 32  # nodes of highest degree that are reduced one by one
SLICE = 1 << 18  # rows of a task that are answered at a time


def fits(graph: Graph, asked: DataFrame | None = None) -> bool:
    """Whether the graph can be held; the ids of ``asked``, if given, must be as wide as they come back."""
    wide = asked is None or all(kind == "bigint" for _, kind in asked.dtypes)
    return wide and graph.symmetric and LEAST <= graph.m <= MOST and graph.n <= MOST


def hold(graph: Graph):
    """The graph's arrays as a broadcast variable, made on first use."""
    if "held" not in graph.views:
        graph.views["held"] = graph.spark.sparkContext.broadcast(_arrays(graph))
    return graph.views["held"]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        src, dst = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for i in range(2))
        yield pa.RecordBatch.from_pydict({"src": pa.array([src], pa.binary()), "dst": pa.array([dst], pa.binary())})


def _arrays(graph: Graph) -> tuple[np.ndarray, ...]:
    """Ids by number, starts of the neighbour lists, neighbours, starts of the ranges; ids in order and their numbers."""
    nodes = graph.nodes.select("id", "deg").filter("id is not null").toArrow()
    ids = nodes.column("id").to_numpy().astype(np.int64)
    by = np.argsort(ids, kind="stable")
    ids, deg = ids[by], nodes.column("deg").to_numpy().astype(np.int64)[by]
    start = np.concatenate([[0], np.cumsum(deg)])
    dst = np.zeros(start[-1], np.int32)
    fill = start[:-1].copy()
    for row in graph.arcs.mapInArrow(_pack, "src binary, dst binary").toLocalIterator():
        a, b = (np.searchsorted(ids, np.frombuffer(x, np.int64)) for x in row)
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else a
        size = np.diff(np.append(first, len(a)))
        dst[fill[a] + np.arange(len(a)) - np.repeat(first, size)] = b
        fill[a[first]] += size
    label = _labels(start, dst)
    by = np.lexsort((np.arange(len(ids)), label))
    number = np.empty(len(ids), np.int32)
    number[by] = np.arange(len(ids), dtype=np.int32)
    if (by[1:] < by[:-1]).any():
        dst = _reorder(start, dst, by, number)
        start = np.concatenate([[0], np.cumsum(deg[by])])
    label = label[by]
    edges = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1], [True]])) if len(label) else np.zeros(1, int)
    cuts = [0]
    for e in edges[1:].tolist():  # whole components, few of them at a time where they are small
        if e == len(ids) or e - cuts[-1] >= RANGE:
            cuts.append(e)
    return ids[by], start, dst, np.array(cuts), ids, number


def _reorder(start: np.ndarray, dst: np.ndarray, by: np.ndarray, number: np.ndarray) -> np.ndarray:
    out, at = np.empty_like(dst), 0
    for i in range(0, len(by), 1 << 16):
        part = by[i : i + (1 << 16)]
        size = start[part + 1] - start[part]
        ends = np.cumsum(size)
        take = np.repeat(start[part] - (ends - size), size) + np.arange(ends[-1])
        out[at : at + len(take)] = number[dst[take]]
        at += len(take)
    return out


def _labels(start: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The smallest number in each node's component."""
    label = np.arange(len(start) - 1, dtype=np.int32)
    full = np.flatnonzero(np.diff(start))
    while len(full):
        new = label.copy()
        near = np.minimum.reduceat(label[dst], start[full])
        np.minimum.at(new, label[full], near)  # the root takes over what its nodes see
        new[full] = np.minimum(new[full], near)
        for _ in range(3):
            new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return label


class View:
    """Nodes ``a`` to ``b`` of the held arrays, whole components; numbers count from ``a``."""

    def __init__(self, held: tuple[np.ndarray, ...], a: int, b: int):
        _, start, dst, *_ = held
        self.a, self.n = a, b - a
        self.start = start[a : b + 1] - start[a]
        self.dst = dst[start[a] : start[b]] - np.int32(a)
        self.deg = np.diff(self.start)
        self.order = np.argsort(-self.deg, kind="stable")  # by falling degree, as ``gather`` wants them

    def near(self, v: int) -> np.ndarray:
        return self.dst[self.start[v] : self.start[v + 1]]

    def gather(self, x: np.ndarray, rows: np.ndarray, op: np.ufunc, none=0) -> np.ndarray:
        """``op`` over the rows of ``x`` of all neighbours, for the nodes ``rows``."""
        out = np.full((len(rows), x.shape[1]), none, x.dtype)
        deg, at = self.deg[rows], self.start[rows]
        step = max(1, PART // x.shape[1])
        few = min(LONG, len(rows))
        most = int(deg[few - 1]) if few else 0
        for i in range(few):  # what the nodes of highest degree have beyond all others
            for j in range(at[i] + most, at[i] + deg[i], step):
                out[i] = op(out[i], op.reduce(x.take(self.dst[j : min(j + step, at[i] + deg[i])], axis=0, mode="clip"), axis=0))
        for j in range(most):
            c = int(np.searchsorted(-deg, -j))  # nodes with more than j neighbours
            for i in range(0, c, step):
                e = min(i + step, c)
                op(out[i:e], x.take(self.dst.take(at[i:e] + j), axis=0, mode="clip"), out=out[i:e])
        return out

    def levels(self, sources: np.ndarray, most: int | None = None) -> Iterator[np.ndarray]:
        """Level after level from 1 on: bit i of a node's row is set if search i meets it there."""
        words = -(-len(sources) // 64)
        i = np.arange(len(sources))
        front = np.zeros((self.n, words), np.uint64)
        front[sources, i >> 6] = np.uint64(1) << (i & 63).astype(np.uint64)
        whole = np.bitwise_or.reduce(front, axis=0)
        seen, rows, k = front.copy(), self.order[self.deg[self.order] > 0], 0
        while len(rows) and (most is None or k < most):
            new = self.gather(front, rows, np.bitwise_or) & ~seen[rows]
            if not new.any():
                return
            front = np.zeros_like(front)
            front[rows] = new
            seen[rows] |= new
            k += 1
            yield front
            rows = rows[(seen[rows] != whole).any(axis=1)]


def _bit(x: np.ndarray, node: np.ndarray, i: np.ndarray) -> np.ndarray:
    return (x[node, i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


def _numbers(held: tuple[np.ndarray, ...], col: pa.Array) -> np.ndarray:
    """Numbers of ids, -1 for null and unknown ones."""
    _, _, _, _, ids, number = held
    there = np.asarray(col.is_valid())
    x = col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.minimum(np.searchsorted(ids, x), max(len(ids) - 1, 0))
    if not len(ids):
        return np.full(len(x), -1)
    return np.where(there & (ids[at] == x), number[at], -1).astype(np.int64)


def _blocks(held: tuple[np.ndarray, ...], src: np.ndarray, width: Callable[[int], int]) -> Iterator[tuple[View, np.ndarray]]:
    """``(view, sources)``: the different numbers ``src`` by range, at most ``width(nodes)`` at a time."""
    cuts = held[3]
    src = np.unique(src[src >= 0])
    at = np.searchsorted(cuts, src, side="right") - 1
    for r in np.unique(at):
        view = View(held, int(cuts[r]), int(cuts[r + 1]))
        mine = src[at == r] - view.a
        for i in range(0, len(mine), width(view.n)):
            yield view, mine[i : i + width(view.n)]


def _words(cells: int = CELLS) -> Callable[[int], int]:
    return lambda n: 64 * int(np.clip(cells // n, 1, 64))


def _columns(n: int) -> int:
    return int(np.clip(CELLS // n, 4, 256))


def _run(graph: Graph, rows: DataFrame, key: str, fn: Callable, schema: str) -> DataFrame:
    """``fn(held, batch)`` on the rows of every task, which are dealt out by ``key``."""
    held = hold(graph)
    cores = graph.spark.sparkContext.defaultParallelism
    tasks = max(int(graph.spark.conf.get("spark.sql.shuffle.partitions")), 3 * cores)

    def slices(batches):
        kept, n = [], 0
        for b in batches:
            kept.append(b)
            n += b.num_rows
            if n >= SLICE:
                yield pa.Table.from_batches(kept).combine_chunks()
                kept, n = [], 0
        if n:
            yield pa.Table.from_batches(kept).combine_chunks()

    def run(batches):
        for table in slices(batches):
            yield from fn(held.value, *[_flat(c) for c in table.columns])

    return rows.repartition(tasks, key).mapInArrow(run, schema)


def _flat(c: pa.ChunkedArray) -> pa.Array:
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


# ----------------------------------------------------------------------- distances, paths
def pair_distances(graph: Graph, pairs: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``(src, dst, d)`` of the rows of ``pairs``, -1 where there is no way."""

    def answer(held, src, dst):
        s, t = _numbers(held, src), _numbers(held, dst)
        d = np.where((s >= 0) & (s == t), 0, -1).astype(np.int32)
        for view, mine, rows, bit, goal in _asked(held, s, t, (d < 0) & (t >= 0), _words()):
            left = np.arange(len(rows))
            for k, front in enumerate(view.levels(mine, max_hops), 1):
                hit = _bit(front, goal[left], bit[left])
                d[rows[left[hit]]] = k
                left = left[~hit]
                if not len(left):
                    break
        yield _batch(src=src, dst=dst, d=d)

    return _run(graph, pairs.select("src", "dst"), "src", answer, "src bigint, dst bigint, d int")


def _asked(held, s: np.ndarray, t: np.ndarray, wanted: np.ndarray, width: Callable[[int], int]):
    """Pairs with both ends in one range: ``(view, sources, rows, bit of the source, target)`` per block of sources."""
    cuts = held[3]
    where = lambda x: np.searchsorted(cuts, x, side="right")
    rows = np.flatnonzero(wanted & (s >= 0) & (where(s) == where(t)))
    rows = rows[np.argsort(s[rows], kind="stable")]
    for view, mine in _blocks(held, s[rows], width):
        a, b = np.searchsorted(s[rows], [mine[0] + view.a, mine[-1] + view.a + 1])
        part = rows[a:b]
        yield view, mine, part, np.searchsorted(mine, s[part] - view.a), t[part] - view.a


def _kept_levels(view: View, mine: np.ndarray, bit: np.ndarray, goal: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels from 0 on until all goals are met, and the goals' distances."""
    i = np.arange(len(mine))
    first = np.zeros((view.n, -(-len(mine) // 64)), np.uint64)
    first[mine, i >> 6] = np.uint64(1) << (i & 63).astype(np.uint64)
    levels, d = [first], np.where(mine[bit] == goal, 0, -1)
    if (d < 0).any():
        for k, front in enumerate(view.levels(mine), 1):
            levels.append(front)
            d[(d < 0) & _bit(front, goal, bit)] = k
            if (d >= 0).all():
                break
    return levels, d


def shortest_paths(graph: Graph, pairs: DataFrame) -> DataFrame:
    """``(src, dst, d, path)`` of the pairs that have a way; each node's parent is the smallest possible."""

    def answer(held, src, dst):
        s, t = _numbers(held, src), _numbers(held, dst)
        for view, mine, rows, bit, goal in _asked(held, s, t, t >= 0, _words(CELLS // 8)):
            levels, d = _kept_levels(view, mine, bit, goal)
            ways = []
            for r in np.flatnonzero(d >= 0).tolist():
                cur, way, i = goal[r], [goal[r]], bit[r : r + 1]
                for k in range(d[r] - 1, -1, -1):
                    near = view.near(cur)
                    cur = near[_bit(levels[k], near, i)].min()
                    way.append(cur)
                ways.append(way[::-1])
            yield _paths(held, view, src, dst, rows[d >= 0], d[d >= 0], ways)

    return _run(graph, pairs.select("src", "dst"), "src", answer, "src bigint, dst bigint, d int, path array<bigint>")


def _paths(held, view: View, src: pa.Array, dst: pa.Array, rows: np.ndarray, d: np.ndarray, ways: list) -> pa.RecordBatch:
    flat = np.concatenate([np.asarray(w, np.int64) for w in ways]) if ways else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum([len(w) for w in ways])]).astype(np.int32)
    path = pa.ListArray.from_arrays(pa.array(ends), pa.array(held[0][flat + view.a]))
    take = pa.array(rows)
    return _batch(src=src.take(take), dst=dst.take(take), d=d.astype(np.int32), path=path)


def enumerate_paths(graph: Graph, pairs: DataFrame) -> DataFrame:
    """``(src, dst, d, path)``: all shortest paths of the pairs, one row per path."""

    def answer(held, src, dst):
        s, t = _numbers(held, src), _numbers(held, dst)
        for view, mine, rows, bit, goal in _asked(held, s, t, t >= 0, _words(CELLS // 8)):
            levels, d = _kept_levels(view, mine, bit, goal)
            for r in np.flatnonzero(d >= 0).tolist():
                for some in _all_ways(view, levels, int(goal[r]), int(d[r]), bit[r : r + 1]):
                    many = np.full(len(some), r)
                    yield _paths(held, view, src, dst, rows[many], d[many], list(some))

    return _run(graph, pairs.select("src", "dst"), "src", answer, "src bigint, dst bigint, d int, path array<bigint>")


def _all_ways(view: View, levels: list[np.ndarray], goal: int, d: int, i: np.ndarray) -> Iterator[np.ndarray]:
    """All ways to ``goal``, a matrix of at most about ``SLICE`` numbers at a time."""
    todo = [(np.array([[goal]]), d)]
    while todo:
        ways, k = todo.pop()
        if k == 0:
            yield ways
            continue
        heads, of = np.unique(ways[:, 0], return_inverse=True)
        before = [near[_bit(levels[k - 1], near, i)] for near in map(view.near, heads.tolist())]
        of = of.reshape(-1)
        size = np.array([len(x) for x in before])[of]
        if size.sum() * (d + 1) > SLICE and len(ways) > 1:
            half = len(ways) // 2
            todo += [(ways[:half], k), (ways[half:], k)]
        else:
            todo.append((np.column_stack([np.concatenate([before[x] for x in of]), np.repeat(ways, size, axis=0)]), k - 1))


# -------------------------------------------------------------------------- centrality
def eccentricities(graph: Graph, sources: DataFrame) -> DataFrame:
    """``(id, ecc)``: hops to the farthest node that ``id`` reaches."""

    def answer(held, ids):
        for view, mine in _blocks(held, _numbers(held, ids), _words(2 * CELLS)):
            ecc = np.zeros(len(mine), np.int32)
            for k, front in enumerate(view.levels(mine), 1):
                bits = np.unpackbits(np.bitwise_or.reduce(front, axis=0).view(np.uint8), bitorder="little")
                ecc[bits[: len(mine)] != 0] = k
            yield _batch(id=held[0][mine + view.a], ecc=ecc)

    return _run(graph, sources.select("id").distinct(), "id", answer, "id bigint, ecc int")


def _summed(held, ids, one: Callable[[View, np.ndarray], tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Sums over the blocks of a task of what ``one`` gives for the nodes of a view, where a search came by."""

    def rows(view, met, x, y):
        return _batch(id=held[0][np.flatnonzero(met) + view.a], x=x[met > 0], y=y[met > 0])

    last, sums = None, ()
    for view, mine in _blocks(held, _numbers(held, ids), _columns):
        got = one(view, mine)
        if last is not None and last.a == view.a:
            sums = tuple(a + b for a, b in zip(sums, got, strict=True))
            continue
        if last is not None:
            yield rows(last, *sums)
        last, sums = view, got
    if last is not None:
        yield rows(last, *sums)


def path_shares(graph: Graph, sources: DataFrame) -> DataFrame:
    """``(id, x, y)``: shortest paths from the sources through (or to, or from) a node, and to it; several rows per node."""

    def one(view: View, mine: np.ndarray) -> tuple[np.ndarray, ...]:
        i = np.arange(len(mine))
        dist = np.full((view.n, len(mine)), -1, np.int32)
        paths = np.zeros((view.n, len(mine)))
        dist[mine, i], paths[mine, i] = 0, 1.0
        front, rows, k = paths.copy(), view.order[view.deg[view.order] > 0], 0
        while len(rows):
            new = view.gather(front, rows, np.add) * (dist[rows] < 0)
            if not new.any():
                break
            k += 1
            dist[rows] = np.where(new > 0, k, dist[rows])
            paths[rows] += new
            front[:] = 0
            front[rows] = new
            rows = rows[(dist[rows] < 0).any(axis=1)]
        ahead = (dist >= 0).astype(float)  # shortest paths that start in the source, come by here and end here or later
        while k:
            later = np.where(dist == k, ahead, 0.0)
            k -= 1
            rows = view.order[(dist[view.order] == k).any(axis=1)]
            ahead[rows] += view.gather(later, rows, np.add) * (dist[rows] == k)
        through, ended = paths * ahead, paths.copy()
        through[mine, i] -= 1.0
        ended[mine, i] = 0.0
        return (dist >= 0).sum(axis=1), through.sum(axis=1), ended.sum(axis=1)

    return _run(graph, sources.select("id").distinct(), "id", lambda held, ids: _summed(held, ids, one), "id bigint, x double, y double")


def tree_visits(graph: Graph, sources: DataFrame) -> DataFrame:
    """``(id, x, y)``: ``x`` paths of the sources' trees of smallest parents have the node inside; several rows per node."""

    def one(view: View, mine: np.ndarray) -> tuple[np.ndarray, ...]:
        n, c = view.n, len(mine)
        i, none = np.arange(c), np.int32(view.n)
        dist = np.full((n, c), -1, np.int32)
        parent = np.zeros((n, c), np.int32)
        dist[mine, i] = 0
        front = np.full((n, c), none, np.int32)
        front[mine, i] = mine
        rows, k = view.order[view.deg[view.order] > 0], 0
        while len(rows):
            new = view.gather(front, rows, np.minimum, none)
            hit = (new < none) & (dist[rows] < 0)
            if not hit.any():
                break
            k += 1
            dist[rows] = np.where(hit, k, dist[rows])
            parent[rows] = np.where(hit, new, parent[rows])
            front[:] = none
            front[rows] = np.where(hit, rows[:, None].astype(np.int32), none)
            rows = rows[(dist[rows] < 0).any(axis=1)]
        reached = dist >= 0
        size = reached.astype(float)  # exact up to 2^53
        for at in range(k, 0, -1):
            v, s = np.nonzero(dist == at)
            size += np.bincount(parent[v, s].astype(np.int64) * c + s, size[v, s], n * c).reshape(n, c)
        inside = np.where(reached, size - 1, 0)
        inside[mine, i] = 0
        return reached.sum(axis=1), inside.sum(axis=1).astype(np.int64), np.zeros(n, np.int64)

    return _run(graph, sources.select("id").distinct(), "id", lambda held, ids: _summed(held, ids, one), "id bigint, x bigint, y bigint")


def added(parts: DataFrame) -> DataFrame:
    """The rows of a node summed up."""
    return parts.groupBy("id").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


# ---------------------------------------------------------------------------- spectra
def symmetric(held: tuple[np.ndarray, ...], y: np.ndarray) -> np.ndarray:
    """D^-1/2 A D^-1/2 y."""
    r = 1 / np.sqrt(np.maximum(np.diff(held[1]), 1))
    return r * _sums(held, r * y)


def minus_square(held: tuple[np.ndarray, ...], y: np.ndarray) -> np.ndarray:
    """-M' M y with M = I - D^-1 A."""
    d = np.maximum(np.diff(held[1]), 1)
    m = y - _sums(held, y) / d
    return _sums(held, m / d) - m


def _sums(held: tuple[np.ndarray, ...], y: np.ndarray) -> np.ndarray:
    """Sum over the neighbours of each node."""
    _, start, dst, *_ = held
    out, full = np.zeros(len(y)), np.flatnonzero(np.diff(start))
    if len(full):
        out[full] = np.add.reduceat(y.take(dst), start[full])
    return out


def filtered(graph: Graph, x: DataFrame, k: int, operator: Callable, low: float, cut: float, near: float, degree: int) -> DataFrame:
    """``(id, v)``: the ``k`` columns of ``x(id, z, v)`` under a Chebyshev polynomial of the operator, a column per task.

    It is small between ``low`` and ``cut`` and about 1 at ``near``; the columns stay at right angles to ``z``.
    """
    held = hold(graph)
    half, mid = (cut - low) / 2, (cut + low) / 2
    s1 = half / (near - mid)

    def run(batches):
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        j, ids, z, v = (_flat(c) for c in pa.Table.from_batches(found).columns)
        arrays = held.value
        j, at, v = j.to_numpy(), _numbers(arrays, ids), v.to_numpy()
        z = z.flatten().to_numpy().reshape(len(at), -1)
        for c in np.unique(j):
            mine = j == c
            p, q = np.zeros(graph_n), np.zeros((graph_n, z.shape[1]))
            p[at[mine]], q[at[mine]] = v[mine], z[mine]
            y, s = (operator(arrays, p) - mid * p) * (s1 / half), s1
            for _ in range(degree - 1):
                s2 = 1 / (2 / s1 - s)
                p, y = y, (operator(arrays, y) - mid * y) * (2 * s2 / half) - s * s2 * p
                y -= q @ (q.T @ y)
                s = s2
            yield _batch(j=pa.array(np.full(graph_n, c, np.int32)), id=arrays[0], v=y)

    graph_n = graph.n
    cells = x.select(F.posexplode("v").alias("j", "v"), "id", "z").select("j", "id", "z", "v").repartitionByRange(k, "j")
    out = cells.mapInArrow(run, "j int, id bigint, v double")
    return out.groupBy("id").agg(F.array(*[F.max(F.when(F.col("j") == i, F.col("v"))) for i in range(k)]).alias("v"))
