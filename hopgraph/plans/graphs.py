"""Graphs derived from whole driver tables; ids are integers in every engine.

``supply``  suppliers and parts joined by every line item (dense, one component)
``trade``   orders, each linked to the next of its customer and to the next of
            its nation and priority (25 components, long paths)
``geo``     region - nation - customer / supplier forest
``follow``  users of consecutive events (small, dense, skewed degrees)
``link``    pages and the targets of their links (string ids, many components)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopgraph.operators.graph import Graph
from hopgraph.operators.shape import clean
from hopgraph.plans.numbering import number_rows

_BUILT: dict[tuple, Graph] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def supply_raw(spark: SparkSession, sf: str) -> DataFrame:
    """One arc per line item, duplicates included."""
    return table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")
    )


def trade_raw(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    order = ["o_orderdate", "o_orderkey"]
    by_customer = orders.select(
        F.col("o_orderkey").alias("src"),
        F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy(*order)).alias("dst"),
    )
    return by_customer.union(_next_in_market(orders.join(cust, "o_custkey"))).filter("dst is not null")


def _next_in_market(orders: DataFrame) -> DataFrame:
    """Next order of the same nation and priority.

    There are only 125 such groups however many orders exist, so the groups
    are not windows of their own: all orders get one global number and each is
    joined to its successor in that order.
    """
    at = number_rows(
        orders.select("c_nationkey", "o_orderpriority", "o_orderdate", "o_orderkey"),
        "c_nationkey", "o_orderpriority", "o_orderdate", "o_orderkey",
    )
    nxt = at.select(
        (F.col("rn") - 1).alias("rn"),
        F.col("c_nationkey").alias("_n"),
        F.col("o_orderpriority").alias("_p"),
        F.col("o_orderkey").alias("dst"),
    )
    return at.join(nxt, "rn").filter("c_nationkey = _n and o_orderpriority = _p").select(
        F.col("o_orderkey").alias("src"), "dst"
    )


def geo_raw(spark: SparkSession, sf: str) -> DataFrame:
    def big(c):
        return F.col(c).cast("bigint")

    nation = table(spark, sf, "nation")
    cust = table(spark, sf, "customer")
    supp = table(spark, sf, "supplier")
    return (
        nation.select((big("n_regionkey") * 4).alias("src"), (big("n_nationkey") * 4 + 1).alias("dst"))
        .union(cust.select(big("c_nationkey") * 4 + 1, big("c_custkey") * 4 + 2))
        .union(supp.select(big("s_nationkey") * 4 + 1, big("s_suppkey") * 4 + 3))
    )


def follow_raw(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("ts", "event_id", "user_id")
    at = number_rows(events, "ts", "event_id").select("rn", "user_id")
    nxt = at.select((F.col("rn") - 1).alias("rn"), F.col("user_id").alias("dst"))
    return at.join(nxt, "rn").select(F.col("user_id").alias("src"), "dst")


def link_named(spark: SparkSession, sf: str) -> DataFrame:
    """``(page_id, href)`` for every link of every page."""
    return table(spark, sf, "pages").select(
        "page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href")
    )


def link_raw(spark: SparkSession, sf: str) -> DataFrame:
    named = link_named(spark, sf)
    ids = number_rows(named.select("href").distinct(), "href", start=1)
    return named.join(ids, "href").select(
        (F.col("page_id") * 2).alias("src"), (F.col("rn") * 2 + 1).alias("dst")
    )


RAW = {
    "supply": supply_raw,
    "trade": trade_raw,
    "geo": geo_raw,
    "follow": follow_raw,
    "link": link_raw,
}


def raw(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return RAW[name](spark, sf)


def graph(spark: SparkSession, sf: str, name: str) -> Graph:
    """Prepared graph, built once per session and folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _BUILT:
        _BUILT[key] = Graph.build(clean(raw(spark, sf, name)))
    return _BUILT[key]


def forget() -> None:
    """Drop the cache, so that a benchmark pays for graph building."""
    _BUILT.clear()
