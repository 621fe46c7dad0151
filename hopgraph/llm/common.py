"""Helpers that several operators share: workers' code, tables, numbering, components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopgraph.plans.scratch import Scratch

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, wherever they start; once per application."""
    if spark.conf.get(_BATCH, "64m").lower().rstrip("b") in ("67108864", "64m"):  # Spark's own value: texts need less
        spark.conf.set(_BATCH, "4m")
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="hopgraph-code-"), "hopgraph_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str = "text") -> Column:
    """The text as UTF-8 bytes; null stays null."""
    return F.col(column).cast("binary")


#: Bytes of Arrow data that a worker turns into Python objects at a time.
SLICE_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``SLICE_BYTES``, without the empty ones."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, SLICE_BYTES))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)
    give_back()


def give_back() -> None:
    """Free memory goes back to the system, as the worker stays for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def map_rows(df: DataFrame, fn: Callable[..., Iterator[dict]], schema: str, *args) -> DataFrame:
    """``fn(columns, *args)`` on each Arrow batch, given and returning lists by column name."""
    out = arrow_schema(df.sparkSession, schema)
    ship(df.sparkSession)

    def run(batches):
        for batch in slices(batches):
            got = fn({k: batch.column(k) for k in batch.schema.names}, *args)
            yield pa.RecordBatch.from_pydict(got, schema=out)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def numbered(
    df: DataFrame, group: list[str], order: list[str], blocks: int, name: str, block: Column | None = None
) -> DataFrame:
    """Add ``name``: gapless numbers from 0 inside each group, ordered by (block, ``order``).

    A group may hold any share of all rows: rows are ranked inside blocks (by default a hash
    of ``order``) and shifted by the counts of the blocks before, so that no task sorts a
    whole group.  The table of counts has at most groups x ``blocks`` rows.
    """
    hashed = F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(blocks))
    df = df.withColumn("_block", (hashed if block is None else block).cast("int"))
    keys = ", ".join(group)
    counts = df.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    shifts = counts.selectExpr(
        *group,
        "_block",
        f"sum(_n) over (partition by {keys} order by _block rows between unbounded preceding and current row) - _n as _shift",
    )
    ranked = df.selectExpr(
        "*", f"row_number() over (partition by {keys}, _block order by {', '.join(order)}) as _rank"
    )
    joined = ranked.join(shifts, [*group, "_block"])
    return joined.withColumn(name, (F.col("_rank") - 1 + F.col("_shift")).cast("long")).drop("_block", "_rank", "_shift")


def components(edges: DataFrame, work: Scratch) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): comp is the smallest node it reaches.

    Each round gives every node the smallest label around it and then the label of its
    label, so that paths shrink by doubling; it ends when no label changes.  Minima combine
    before the shuffle and hot nodes are split by adaptive joins.
    """
    there, back = F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    arcs = edges.select(F.inline(F.array(there, back)))
    arcs, n = work.save(arcs.filter("a <> b").distinct(), "arcs")
    labels, _ = work.save(arcs.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "l0")
    step = 0
    while n:
        step += 1
        near = arcs.join(labels, arcs.b == labels.node).groupBy(F.col("a").alias("v")).agg(F.min("comp").alias("m"))
        low = labels.join(near, labels.node == near.v).select("node", "comp", F.least("comp", "m").alias("m"))
        up = labels.select(F.col("node").alias("m"), F.col("comp").alias("top"))
        new = low.join(up, "m").select(
            "node", F.least("m", "top").alias("new"), (F.least("m", "top") < F.col("comp")).alias("moved")
        )
        _, seen = work.write(new, f"l{step}", moved=F.sum(F.col("moved").cast("long")))
        labels = work.read(f"l{step}", new.schema).select("node", F.col("new").alias("comp"))
        n = seen["moved"]
    return labels
