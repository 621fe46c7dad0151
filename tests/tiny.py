"""Six tiny graphs with values computed by plain breadth-first search."""

from __future__ import annotations

from collections import defaultdict, deque

from hopgraph.operators.graph import Graph

# Demonstration graphs and shapes that the expected results belong to.
EDGES = {
    "A": "3-0 3-1 3-2 3-8 3-7 1-4 4-5 4-7 7-6 6-5 8-7 8-9 9-10 8-10",
    "B": "3-0 3-1 3-2 3-4 3-12 4-5 4-7 4-6 5-7 5-6 6-7 4-8 8-9 8-10 8-11 9-10 8-12 12-13 14-13 12-14",
    "C": " ".join(f"0-{i} {i}-21" for i in range(1, 21)),
    "D": "0-1 1-2 0-2 3-4 4-5 5-6 6-3 7-8 8-9 8-10 8-11",
    "F": "0-2 1-2 3-2 2-4 4-5 5-6 6-7 7-8 8-5",
    "G": "0-2 0-1 0-3 3-4 3-5 5-4 5-6",
}


def edges(name):
    return [tuple(int(x) for x in e.split("-")) for e in EDGES[name].split()]


def arcs(name):
    return [p for a, b in edges(name) for p in ((a, b), (b, a))]


def adjacency(name):
    adj = defaultdict(set)
    for a, b in arcs(name):
        adj[a].add(b)
    return adj


def bfs(adj, src):
    dist = {src: 0}
    todo = deque([src])
    while todo:
        u = todo.popleft()
        for w in adj[u]:
            if w not in dist:
                dist[w] = dist[u] + 1
                todo.append(w)
    return dist


def apsp(name):
    adj = adjacency(name)
    return {u: bfs(adj, u) for u in adj}


def arcs_df(spark, name):
    return spark.createDataFrame(arcs(name), "src bigint, dst bigint")


_CACHE = {}


def graph(spark, name, hub_block=4):
    """Graph with a small hub block, so that block splitting is exercised."""
    key = (spark.sparkContext.applicationId, name, hub_block)
    if key not in _CACHE:
        _CACHE[key] = Graph.build(arcs_df(spark, name), hub_block=hub_block)
    return _CACHE[key]


def ids(spark, *values):
    return spark.createDataFrame([(int(v),) for v in values], "id bigint")


def pairs(spark, rows):
    return spark.createDataFrame([(int(a), int(b)) for a, b in rows], "src bigint, dst bigint")


def rows(df):
    return sorted(tuple(r) for r in df.collect())
