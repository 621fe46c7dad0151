"""SimHash near duplicates by ball hashing that meets in the middle.

Two fingerprints within 4 bits share a value within 2 bits of each.  Every distinct
fingerprint therefore stands for its ball: all 2081 values within 2 bits.  The balls meet
on their values.  What moves is not the values but, per block of values, the fingerprint:
a value's block is its bits folded together by exclusive or, so the share of a ball that
falls into a block follows from the fingerprint and is written out there.  Fingerprints
that meet on a value are all within 4 bits of each other, so a chain through them holds
all their links and no pairs are listed.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from hopgraph.llm.common import components, map_rows, utf8
from hopgraph.plans.scratch import Scratch

SEED = 42
#: Values that one block writes out on average, and at most at a time.
BLOCK_VALUES = 1 << 20


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """Majority of the bits of the shingles' hashes; 0 if there are no words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*[words[i:] for i in range(width)]))
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter(map(xxh64_intdigest, parts, repeat(SEED)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        octets = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(cols: dict, width: int) -> dict:
    prints = [fingerprint(t, width) for t in cols["t"].to_pylist()]
    return {"doc_id": cols["doc_id"], "th": cols["th"], "fp": np.array(prints, np.uint64).view(np.int64)}


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, th, fp): fp as a signed long, th the hash of the text that tells repeated ids apart."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), utf8().alias("t"))
    return map_rows(rows, _fingerprints, "doc_id long, th long, fp long", width)


@lru_cache
def _masks(half: int) -> np.ndarray:
    found = [sum(1 << i for i in c) for k in range(half + 1) for c in combinations(range(64), k)]
    return np.array(found, np.uint64)


def _fold(v: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros_like(v)
    for at in range(0, 64, bits):
        out ^= v >> np.uint64(at)
    return out & np.uint64((1 << bits) - 1)


def _fold_column(c: Column, bits: int) -> Column:
    out = F.lit(0).cast("long")
    for at in range(0, 64, bits):
        out = out.bitwiseXOR(F.shiftrightunsigned(c, at))
    return out.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each index over the edges a-b."""
    label = np.arange(n)
    while len(a):
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    return label


def _meet(block: int, prints: np.ndarray, bits: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, root) among the fingerprints whose balls reach into one block of values."""
    masks = _masks(half)
    mask_block = _fold(masks, bits)
    own = _fold(prints, bits) ^ np.uint64(block)
    shares = [(np.flatnonzero(own == d), masks[mask_block == d]) for d in np.unique(own)]
    total = sum(len(i) * len(m) for i, m in shares)
    rounds = -(-total // (2 * BLOCK_VALUES))
    a, b = [], []
    for r in range(rounds):
        values, owners = [], []
        for i, m in shares:
            for at in range(0, len(i), max(1, BLOCK_VALUES // max(1, len(m)))):
                ids = i[at : at + max(1, BLOCK_VALUES // max(1, len(m)))]
                v = (prints[ids][:, None] ^ m[None, :]).ravel()
                o = np.repeat(ids.astype(np.int32), len(m))
                if rounds > 1:
                    now = ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(rounds) == r
                    v, o = v[now], o[now]
                values.append(v)
                owners.append(o)
        v, o = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(v)
        v, o = v[order], o[order]
        same = np.flatnonzero(v[1:] == v[:-1])
        x, y = o[same], o[same + 1]
        near = np.bitwise_count(prints[x] ^ prints[y]) <= 2 * half
        a.append(x[near])
        b.append(y[near])
    if not a:
        return prints[:0], prints[:0]
    root = _roots(len(prints), np.concatenate(a), np.concatenate(b))
    linked = np.flatnonzero(root != np.arange(len(prints)))
    return prints[linked], prints[root[linked]]


def links(prints: DataFrame, n: int, radius: int = 4) -> DataFrame:
    """(a, b): links that connect all of the ``n`` distinct ``fp`` within ``radius`` bits."""
    half = (radius + 1) // 2
    if radius != 2 * half:
        raise ValueError("the radius must be even: two balls of half of it meet in the middle")
    ball = len(_masks(half))
    bits = min(32, max(1, (n * ball // BLOCK_VALUES).bit_length()))
    moves = sorted({int(x) for x in _fold(_masks(half), bits)})
    spread = prints.select(
        "fp", F.explode(F.array(*[F.lit(m).cast("long") for m in moves])).alias("move")
    ).select("fp", _fold_column(F.col("fp"), bits).bitwiseXOR(F.col("move")).alias("block"))

    def meet(t: pa.Table) -> pa.Table:
        fps = np.unique(t.column("fp").to_numpy()).view(np.uint64)
        a, b = _meet(t.column("block")[0].as_py(), np.sort(fps), bits, half)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return spread.groupBy("block").applyInArrow(meet, "a long, b long")


def print_classes(prints: DataFrame, radius: int, work: Scratch) -> DataFrame:
    """(fp, root): root is one of the class's ``fp``; fingerprints without a link have no row."""
    stored, n = work.save(prints.select("fp").distinct(), "class_prints")
    return components(links(stored, n, radius), work).select(F.col("node").alias("fp"), F.col("comp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, th, fp, component_id, first): the class of every document.

    component_id is the smallest doc_id of the class (null only if no member has one), first
    is true for the one row that stands for the class.  Rows are told apart by doc_id and
    text; a null or empty text has no words and fingerprint 0, which links like any other.
    An empty table gives no rows.  Further columns of ``docs`` are not looked at.
    """
    work = Scratch(docs.sparkSession, "simhash")
    rows, _ = work.save(fingerprints(docs, width), "rows")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("head")
    prints, n = work.save(rows.groupBy("fp").agg(head), "prints")
    comp = components(links(prints.select("fp"), n, radius), work)
    classes = comp.join(prints, comp.node == prints.fp).groupBy("comp").agg(F.min("head").alias("top"))
    linked = comp.join(classes, "comp").select(F.col("node").alias("fp"), "top")
    whole = prints.join(linked, "fp", "left").select("fp", F.coalesce("top", "head").alias("top"))
    found = rows.join(whole, "fp")
    is_first = F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("th") == F.col("top.th"))
    return found.select("doc_id", "th", "fp", F.col("top.doc_id").alias("component_id"), is_first.alias("first"))


def drop_near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """One document of each class, with all columns of ``docs``; of equal rows one stays."""
    keep = near_duplicates(docs, radius, width).filter("first").select(
        F.col("doc_id").alias("_keep"), F.col("th").alias("_keep_th")
    ).distinct()
    marked = docs.withColumn("_th", F.xxhash64("text")).withColumn("_id", F.col("doc_id").cast("long"))
    same = F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_th") == F.col("_keep_th"))
    return marked.join(keep, same, "left_semi").dropDuplicates(["_id", "_th"]).drop("_th", "_id")


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every document."""
    from hopgraph.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
