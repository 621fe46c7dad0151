"""Edge readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopgraph.sources.lines import POS, checked, content, read_lines


def read_edge_list(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """White-space edge list -> ``(src, dst, file, block, seq)``."""
    rows = content(read_lines(spark, path))
    src, dst = F.get("tok", F.lit(0)).try_cast("bigint"), F.get("tok", F.lit(1)).try_cast("bigint")
    ok = (F.size("tok") == 2) & src.isNotNull() & dst.isNotNull()
    return checked(rows, ok, mode).select(src.alias("src"), dst.alias("dst"), *POS)


def read_edge_csv(spark: SparkSession, path: str, base: int = 1, sep: str = ",") -> DataFrame:
    """CSV edge list whose ids start at ``base``."""
    raw = spark.read.schema("src bigint, dst bigint").option("mode", "FAILFAST").csv(path, sep=sep)
    return raw.select((F.col("src") - base).alias("src"), (F.col("dst") - base).alias("dst"))


def read_ego_networks(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """S3: directory of ``<ego>.edges`` files; both ends of an edge also link to the ego."""
    rows = content(read_lines(spark, f"{path}/*.edges"))
    ego = F.regexp_extract("file", r"([^/]+)\.edges$", 1).try_cast("bigint")
    a, b = F.get("tok", F.lit(0)).try_cast("bigint"), F.get("tok", F.lit(1)).try_cast("bigint")
    ok = (F.size("tok") == 2) & a.isNotNull() & b.isNotNull() & ego.isNotNull()
    three = F.array(
        F.struct(a.alias("src"), b.alias("dst")),
        F.struct(a.alias("src"), ego.alias("dst")),
        F.struct(b.alias("src"), ego.alias("dst")),
    )
    return checked(rows, ok, mode).select(F.explode(three).alias("e"), *POS).select("e.src", "e.dst", *POS)


def read_adjacency(spark: SparkSession, path: str, unique: bool = True, mode: str = "strict") -> DataFrame:
    """Adjacency text, first token is the node; ``unique`` removes repeated neighbours."""
    rows = content(read_lines(spark, path))
    ids = F.transform("tok", lambda t: t.try_cast("bigint"))
    ok = F.forall(ids, lambda x: x.isNotNull())
    arcs = checked(rows, ok, mode).select(
        F.get(ids, F.lit(0)).alias("src"), F.explode(F.slice(ids, 2, F.size("tok"))).alias("dst")
    )
    return arcs.distinct() if unique else arcs


def from_coo(cells: DataFrame) -> DataFrame:
    """Sparse matrix cells ``(i, j, v)`` -> arcs."""
    return cells.filter("v <> 0").select(F.col("i").alias("src"), F.col("j").alias("dst")).distinct()


def write_arcs(arcs: DataFrame, path: str, sep: str = "\t", base: int = 0) -> None:
    """Arcs as separated text."""
    arcs.select((F.col("src") + base).alias("src"), (F.col("dst") + base).alias("dst")).write.mode("overwrite").option(
        "sep", sep
    ).csv(path)


def write_edges_once(arcs: DataFrame, path: str, sep: str = "\t") -> int:
    """One row per undirected pair; the stored rows must be half the arcs on the same nodes."""
    spark = arcs.sparkSession
    write_arcs(arcs.filter("src < dst"), path, sep)
    back = spark.read.schema("src bigint, dst bigint").option("sep", sep).csv(path)
    ends = F.explode(F.array("src", "dst"))
    written, kept = back.count(), back.select(ends).distinct().count()
    expected, nodes = arcs.count(), arcs.select(ends).distinct().count()
    if written * 2 != expected or kept != nodes:
        raise ValueError(f"{written} rows for {expected} arcs, {kept} of {nodes} nodes")
    return written
