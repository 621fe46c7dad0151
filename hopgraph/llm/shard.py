"""Sharding by rendezvous hashing over weighted shards.

Every (key, shard) pair draws a number that depends on nothing else; the shard with the
highest weighted draw owns the key.  A new shard can therefore only win keys for itself,
and a key moves only if its owner goes or a new shard outbids it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopgraph.llm.common import numbered, table

#: Hash blocks by which each shard's rows are numbered.
BLOCKS = 256


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of ``key:shard``."""
    digest = F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def owner(key: Column, weights: list[float], first: int = 0) -> Column:
    """Shard with the highest weight / -ln(draw); a tie goes to the higher number."""
    bids = [
        F.struct((F.lit(float(w)) / -F.log(draw(key, first + i))).alias("bid"), F.lit(first + i).alias("shard"))
        for i, w in enumerate(weights)
        if w > 0
    ]
    return F.greatest(*bids)["shard"] if len(bids) > 1 else bids[0]["shard"]


def shard_documents(docs: DataFrame, weights: list[float], grown: list[float] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard) of every document.

    ``weights`` are the shards' shares.  The key is the doc_id (null: the empty key), so rows
    with one id go together whatever their texts.  size is the text's UTF-8 bytes plus 1
    (null text: 1, checksum 0), slot numbers each shard's rows from 0 without a gap, and
    grown_shard is the owner under the weights ``grown`` (default: one more shard of the mean
    weight).  Further columns are not looked at; an empty table gives no rows.
    """
    grown = grown or [*weights, sum(weights) / len(weights)]
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        owner(key, weights).cast("int").alias("shard"),
        owner(key, grown).cast("int").alias("grown_shard"),
        F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long").alias("place"),
    )
    order = ["place", "doc_id", "text_crc32", "size"]
    return numbered(rows, ["shard"], order, BLOCKS, "slot", F.pmod("place", F.lit(BLOCKS))).drop("place")


def write_shards(docs: DataFrame, weights: list[float], path: str) -> None:
    """Write all columns of ``docs`` as Parquet below ``path``, one folder ``shard=N`` each."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.drop("shard").withColumn("shard", owner(key, weights).cast("int"))
    rows.write.mode("errorifexists").partitionBy("shard").parquet(path)


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    found = shard_documents(table(spark, sf_dir, "documents"), [1.0] * 16)
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


OP8_SQL = """
with recursive step(i, k, c) as (
  select i, 0, i from range(256) r(i)
  union all
  select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from step where k < 8
), remainders as (
  select list(c order by i) as t from step where k = 8
), doc as (
  select doc_id, coalesce(text, '') as s, coalesce(cast(doc_id as varchar), '') as k from documents
), sized as (
  select doc_id, k, cast(octet_length(encode(s)) + 1 as bigint) as size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda h: cast('0x' || h as bigint))),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as text_crc32,
    cast('0x' || md5(k)[1:8] as bigint) as place
  from doc, remainders
), bid as (
  select doc_id, k, n, 1.0 / -ln((cast(cast('0x' || md5(k || ':' || n)[1:13] as bigint) as double) + 0.5) / 4503599627370496.0) as b
  from (select distinct doc_id, k from doc), range(17) r(n)
), owned as (
  select k, max_by(n, (b, n)) filter (n < 16) as shard, max_by(n, (b, n)) as grown from bid group by k
)
select doc_id, size, text_crc32, 'key' as law, cast(shard as integer) as shard,
  row_number() over (partition by shard order by place % 256, place, doc_id, text_crc32, size) - 1 as slot,
  cast(grown as integer) as grown_shard
from sized join owned using (k)
"""
