"""Manifests against trees built by hand."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from hopgraph.llm.merkle import fold, manifest, op12_manifest, row_hash
from tests.llm.edge import COLUMNS, documents, nothing


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes):
    """(root, siblings left and right of each leaf) of one tree."""
    beside = [[] for _ in nodes]
    under, level = [[i] for i in range(len(nodes))], list(nodes)
    while len(level) > 1:
        for i, leaves in enumerate(under):
            run = range(i // 8 * 8, min(i // 8 * 8 + 8, len(level)))
            for x in leaves:
                beside[x].append(("".join(level[j] for j in run if j < i), "".join(level[j] for j in run if j > i)))
        under = [sum(under[i : i + 8], []) for i in range(0, len(level), 8)]
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    return level[0], beside


def brute(rows):
    """Result rows of op12 for rows (doc_id, text, lang, source, n_chars)."""

    def leaf(doc_id, text, lang, source, n_chars):
        parts = [doc_id, source, lang, n_chars, text]
        return sha("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))

    trees = {}
    for r in rows:
        low = r[1] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
        bad = zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 3 == 0
        trees.setdefault(r[2], []).append((r[0], leaf(*r), leaf(r[0], low, *r[2:]) if bad else leaf(*r)))
    langs = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    for lang in langs:
        trees[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    built = [climb([x[1] for x in trees[lang]]) for lang in langs]
    root, above = climb([b[0] for b in built]) if built else (None, [])
    out = []
    for lang, (subroot, beside), top in zip(langs, built, above):
        for (doc_id, h, used), path in zip(trees[lang], beside):
            for left, right in path + top:
                used = sha(left + used + right)
            proof = sha("".join(a + b for a, b in path + top))
            out.append((doc_id, h, subroot, root, proof, used, used == root))
    return sorted(out, key=str)


def query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, op12_manifest(spark, str(tmp_path)).collect()), key=str)


def test_odd_rows(spark, tmp_path):
    docs = documents(spark, [(9, "Big LETTERS", "", "d", 1), (11, "ÄB", "en", "d", 2), (5, "Other", None, "b", 6)])
    want = brute([tuple(r[c] for c in COLUMNS) for r in docs.collect()])
    assert query(spark, docs, tmp_path) == want
    assert {w[6] for w in want} == {True, False}


def test_no_rows(spark, tmp_path):
    assert query(spark, nothing(spark), tmp_path) == []
    proofs, root = manifest(spark.createDataFrame([], "k string, i long, leaf string"), "k", "i")
    assert proofs.count() == root.count() == 0


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (8, 9, 1), (64, 65, 7), (512, 513, 600)])
def test_sizes(spark, sizes, tmp_path):
    rows = [(i, f"T{i}", f"l{k}", "s", i) for k, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert query(spark, docs.repartition(5), tmp_path) == brute(rows)


def test_proofs_hold_and_break(spark):
    rows = spark.range(700).select(F.lit("x").alias("k"), "id", row_hash([F.col("id")]).alias("leaf"))
    proofs, root = manifest(rows, "k", "id")
    top = root.first().root
    assert proofs.filter(fold(F.col("leaf"), F.col("path")) == top).count() == 700
    assert proofs.filter(fold(F.sha2(F.col("leaf").cast("binary"), 256), F.col("path")) == top).count() == 0
