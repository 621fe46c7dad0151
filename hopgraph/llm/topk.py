"""Exact top-k inner products by MaxScore over dimensions as terms.

A query's terms are its dimensions.  In one shard of candidates each term's contribution is
bounded by the least and the greatest component there.  Terms are taken from the widest
bound on; once the terms left cannot lift a row over the query's k-th score, they are not
essential: no new rows are taken from them, and a row is probed in them only while it can
still compete.  Shards keep their own k best, and those are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopgraph.llm.common import arrow_schema, ship, table
from hopgraph.plans.scratch import Scratch

#: Queries that one pass over the candidates holds.
BLOCK = 1024
#: Terms between two looks at which rows still compete.
STRIDE = 16


def _vectors(ids: pa.Array, lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, floor(256 x)) by vector length; rows that are null or not finite take no part."""
    there = np.array(ids.is_valid()) & np.array(lists.is_valid())
    sizes = np.where(there, np.array(pa.compute.list_value_length(lists).fill_null(0)), 0)
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float)
        rows = flat.reshape(-1, size)
        sound = np.isfinite(rows).all(axis=1)
        yield ids.take(pa.array(at[sound])).to_numpy(zero_copy_only=False), np.floor(256 * rows[sound])


def best(
    query: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, floor: float, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Rows (numbers, scores) that can be among the k best and score at least ``floor``.

    ``rows`` holds one term per line; low and high are the terms' bounds in it.
    """
    a, b = query * low, query * high
    least, reach = np.minimum(a, b), np.abs(a - b)
    order = np.argsort(-reach, kind="stable")
    rest = np.concatenate((np.cumsum(reach[order][::-1])[::-1], [0.0]))
    base = least.sum()
    alive = np.arange(rows.shape[1])
    score = np.full(rows.shape[1], base)  # lower bound of each row: terms not read yet at their least
    for at in range(0, len(order), STRIDE):
        terms = order[at : at + STRIDE]
        part = rows[terms] if len(alive) == rows.shape[1] else rows[np.ix_(terms, alive)]
        score += np.einsum("i,ij->j", query[terms], part) - least[terms].sum()
        if len(score) > k:
            floor = max(floor, np.partition(score, len(score) - k)[len(score) - k])
        competes = score + rest[min(at + STRIDE, len(order))] >= floor
        if not competes.all():
            alive, score = alive[competes], score[competes]
        if not len(alive):
            break
    return alive, score


def _merge(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores, ties to the smaller id.

    Both tables hold (vec_id, embedding).  The score is the inner product of floor(256 x) of
    the components; a row is no candidate of a query with its own vec_id.  Vectors that are
    null or empty or hold a null or non-finite component, and rows without a vec_id, take no
    part; vectors of another length than the query's are no candidates of it.  Queries with
    fewer than k candidates get all.  Queries pass over the candidates in blocks of
    ``BLOCK``; a repeated query row is answered once, a repeated candidate may come again.
    """
    spark = candidates.sparkSession
    ship(spark)
    work = Scratch(spark, "topk")
    asked, n = work.save(queries.select("vec_id", "embedding").dropna().dropDuplicates(["vec_id"]), "queries")
    blocks = max(1, -(-n // BLOCK))
    schema = "query_id long, vec_id long, score long"
    out = arrow_schema(spark, schema)
    found = spark.createDataFrame([], schema)
    rows = candidates.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    for b in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).select(
            F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")
        )
        held = spark.sparkContext.broadcast(
            [x for t in [mine.toArrow().combine_chunks()] if t.num_rows for x in _vectors(t["vec_id"].combine_chunks(), t["v"].combine_chunks())]
        )

        def shard(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            tops: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                for ids, vectors in _vectors(batch.column("vec_id"), batch.column("v")):
                    terms = np.ascontiguousarray(vectors.T)
                    if not len(ids):
                        continue
                    low, high = terms.min(axis=1), terms.max(axis=1)
                    for names, asks in held.value:
                        if asks.shape[1] != terms.shape[0]:
                            continue
                        for name, ask in zip(names.tolist(), asks):
                            own_ids, own = tops.get(name, (np.zeros(0, np.int64), np.zeros(0)))
                            floor = own[k - 1] if len(own) >= k else -np.inf
                            at, score = best(ask, terms, low, high, floor, k + 1)
                            near = ids[at] != name
                            tops[name] = _merge(
                                np.concatenate((own_ids, ids[at][near])), np.concatenate((own, score[near])), k
                            )
            if tops:
                yield pa.RecordBatch.from_pydict(
                    {
                        "query_id": np.repeat(list(tops), [len(v[0]) for v in tops.values()]),
                        "vec_id": np.concatenate([v[0] for v in tops.values()]),
                        "score": np.concatenate([v[1] for v in tops.values()]).astype(np.int64),
                    },
                    schema=out,
                )

        found = found.union(rows.mapInArrow(shard, schema))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.filter("vec_id % 50 = 0"), vectors)


OP9_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pair as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pair
)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5
"""
