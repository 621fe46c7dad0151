import zlib
from collections import Counter

from pyspark.sql import functions as F

from hopgraph.llm.shard import owner, shard_documents, write_shards
from tests.llm.edge import documents, nothing


def test_rows_sizes_and_slots(spark):
    docs = documents(spark)
    rows = shard_documents(docs, [1.0] * 3).collect()
    assert len(rows) == docs.count()
    want = Counter(
        (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()))
        for r in docs.select("doc_id", "text").collect()
    )
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert len({(r.doc_id, r.shard) for r in rows}) == len({r.doc_id for r in rows})
    assert shard_documents(nothing(spark), [1.0, 1.0]).count() == 0


def test_growth_moves_few_and_only_into_the_new_shard(spark):
    docs = spark.range(20000).selectExpr("id as doc_id", "cast(null as string) as text")
    rows = shard_documents(docs, [1.0] * 16).collect()
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert {r.grown_shard for r in moved} == {16}
    assert 0.04 < len(moved) / len(rows) < 0.08
    assert max(Counter(r.shard for r in rows).values()) < 1.15 * 20000 / 16


def test_weights(spark):
    docs = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    got = Counter(r.s for r in docs.select(owner(F.col("k"), [1.0, 0.0, 3.0]).alias("s")).collect())
    assert set(got) == {0, 2} and abs(got[2] / 20000 - 0.75) < 0.02


def test_written_folders(spark, tmp_path):
    write_shards(documents(spark), [1.0, 1.0], str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == documents(spark).count()
