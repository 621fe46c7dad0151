"""Common contract of all oracles."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopgraph.operators.graph import Graph
from hopgraph.operators.traverse import cached_components, distances
from hopgraph.plans.scratch import Scratch

FAR = 20  # finite distance that stands for "not reachable" (D8)
UNREACHABLE = 9999  # fixed value: answer of a label query without a shared hub


class Oracle:
    """A named set of tables plus small settings.

    ``query(pairs)`` takes ``(src, dst)`` and returns ``(src, dst, est)``.
    """

    def __init__(self, tables: dict[str, DataFrame], settings: dict | None = None):
        self.tables = tables
        self.settings = settings or {}

    def query(self, pairs: DataFrame) -> DataFrame:
        raise NotImplementedError

    def save(self, path: str) -> None:
        spark = next(iter(self.tables.values())).sparkSession
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        row = [(json.dumps({"settings": self.settings, "tables": sorted(self.tables)}),)]
        spark.createDataFrame(row, "value string").write.mode("overwrite").text(f"{path}/_settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Oracle":
        info = json.loads(spark.read.text(f"{path}/_settings").first().value)
        tables = {t: spark.read.parquet(f"{path}/{t}") for t in info["tables"]}
        return cls(tables, info["settings"])

    @classmethod
    def obtain(cls, spark: SparkSession, path: str, build: Callable[[], "Oracle"], force: bool = False) -> "Oracle":
        """Reload a stored oracle; build and store it when missing or forced."""
        if force or not _exists(spark, f"{path}/_settings"):
            build().save(path)
        return cls.load(spark, path)

    def footprint(self, path: str) -> tuple[int, int]:
        """Rows and stored bytes of a saved oracle."""
        spark = next(iter(self.tables.values())).sparkSession
        rows = sum(spark.read.parquet(f"{path}/{t}").count() for t in self.tables)
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        size = files.select(F.sum("length")).first()[0]
        return rows, int(size)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def home_table(graph: Graph) -> DataFrame:
    """``(id, home, hd)``: the best connected node of each component and the hops to it."""
    best = cached_components(graph).join(graph.nodes.select("id", "deg"), "id").groupBy("comp").agg(
        F.max_by("id", F.struct("deg", (-F.col("id")).alias("n"))).alias("id")
    )
    reached = distances(graph, best.select("id"), key="home").select("id", "home", F.col("d").alias("hd"))
    return Scratch(graph.spark, "home").cut(reached)


def answer_all(answers: DataFrame, home: DataFrame, far: int = FAR) -> DataFrame:
    """An answer for every pair: 0 for equal ends, ``far`` (D8) between components, and the
    way through the component's home where the oracle has none."""
    ends = attach(attach(answers, home, "home"), home, "hd")
    same = F.col("home_s") == F.col("home_d")
    est = F.when(F.col("src") == F.col("dst"), F.lit(0.0)).when(
        same, F.coalesce(F.col("est").cast("double"), (F.col("hd_s") + F.col("hd_d")).cast("double"))
    ).otherwise(F.lit(float(far)))
    return ends.select("src", "dst", est.alias("est"))


def attach(pairs: DataFrame, facts: DataFrame, value: str, how: str = "left") -> DataFrame:
    """Join one value column of ``facts(id, value)`` to both ends: ``{value}_s``, ``{value}_d``."""
    a = facts.select(F.col("id").alias("src"), F.col(value).alias(f"{value}_s"))
    b = facts.select(F.col("id").alias("dst"), F.col(value).alias(f"{value}_d"))
    return pairs.join(a, "src", how).join(b, "dst", how)
