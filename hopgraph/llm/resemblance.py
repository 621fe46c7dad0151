"""Near duplicates by SimHash, and by the share of five-word shingles that two texts have in common.

With ``radius``, texts whose 64-bit fingerprints (``simhash``, majority bits of the four-word shingles)
differ in at most as many bits are linked first.  Further candidates are found by MinHash: the
smallest values of ``ROWS`` hash functions make the key of a band, and texts that share any of
``BANDS`` keys collide.  Colliding texts are compared by their shingles.  First all texts of a band meet one of it, another one each of ``STARS`` times,
so that large classes mostly become one.  The texts of bands that still hold several classes are
dealt into blocks; a task takes two blocks, counts the shingles that their texts share in rows
of bits and gives the links that join classes, at most one for each text.  So every
colliding pair that is not of one class yet is compared, and no pairs are written out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh64_intdigest

from hopgraph.llm.common import components, give_back, map_rows, ship, slices, utf8
from hopgraph.llm.simhash import fingerprint, print_classes
from hopgraph.plans.scratch import Scratch

WIDTH = 5
SIMILARITY = 0.8
#: Two texts of similarity s collide with probability 1 - (1 - s^ROWS)^BANDS: 0.9993 at 0.8.
ROWS = 8
BANDS = 40
#: Rounds in which the texts of a band meet one of it.
STARS = 2
#: Texts of a block, on average, and shingles whose bits are held at a time (a multiple of 64).
BLOCK = 128
COLUMNS = 1 << 12
#: Shingles whose hash functions are taken in one go.
CHUNK = 1 << 9

_rng = np.random.default_rng(42)
_ODD = _rng.integers(0, 2**63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, ROWS * BANDS, np.uint64)


def shingles(text: bytes | None, width: int = WIDTH) -> list[bytes]:
    """Runs of ``width`` words, lowered; a shorter text is one shingle, and without words there is none."""
    words = text.lower().split() if text else []
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*[words[i:] for i in range(width)])))


def similarity(a: set[bytes], b: set[bytes]) -> float:
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared) if shared else 0.0


def band_keys(parts: list[bytes]) -> list[int]:
    """One signed 64-bit key for each band; none for a text without words."""
    if not parts:
        return []
    hashes = np.unique(np.fromiter(map(xxh64_intdigest, parts, repeat(7)), np.uint64, len(parts)))
    low = np.full(len(_ODD), np.uint64(2**64 - 1))
    for at in range(0, len(hashes), CHUNK):
        mixed = hashes[at : at + CHUNK, None] * _ODD
        mixed += _ADD
        np.minimum(low, mixed.min(axis=0), out=low)
    rows = low.reshape(BANDS, ROWS)
    return [xxh3_64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(rows)]


def _rows(cols: dict, width: int, prints: bool) -> dict:
    texts = cols["t"].to_pylist()
    nodes = [xxh3_64_intdigest(b" ".join(t.lower().split()) if t else b"") - (1 << 63) for t in texts]
    keys = [band_keys(shingles(t, width)) for t in texts]
    fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64) if prints else [None] * len(texts)
    return {"doc_id": cols["doc_id"], "th": cols["th"], "node": nodes, "fp": fps, "bands": keys}


def _compare(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """(a, b) of the pairs whose shingles are similar enough."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            last, mine, same = None, set(), []
            for one, two in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist()):
                if one != last:
                    last, mine = one, set(shingles(one, width))
                same.append(similarity(mine, set(shingles(two, width))) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _hashes(cols: dict, width: int) -> dict:
    found = [np.unique(np.array([xxh64_intdigest(x) for x in shingles(t, width)], np.uint64)).view(np.int64) for t in cols["t"].to_pylist()]
    return {"node": cols["node"], "x": found}


def _shared(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many values each of ``one`` shares with each of ``two``."""
    flat = np.concatenate([*one, *two])
    owner = np.repeat(np.arange(len(one) + len(two)), [len(x) for x in (*one, *two)])
    _, column = np.unique(flat, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(one), len(two)), np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        held = np.zeros((len(one) + len(two), COLUMNS), bool)
        held[owner[a:b], column[a:b] - at] = True
        bits = np.packbits(held, axis=1).view(np.uint64)
        for i in range(len(one)):
            out[i] += np.bitwise_count(bits[i] & bits[len(one) :]).sum(axis=1, dtype=np.int64)
    return out


def _joining(block: pa.Table, least: float) -> pa.Table:
    """Links (a, b) that join the classes of similar texts of two blocks (side 0 and 1, or one with itself)."""
    rows = block.select(["node", "comp"]).to_pydict()
    side = block.column("side").to_numpy()
    x = block.column("x").combine_chunks()
    ends = x.offsets.to_numpy()
    sets = np.split(x.values.to_numpy()[ends[0] : ends[-1]], ends[1:-1] - ends[0])
    one = np.flatnonzero(side == 0)
    two = np.flatnonzero(side == 1) if (side == 1).any() else one
    sizes = np.array([len(x) for x in sets], np.float64)
    shared = _shared([sets[i] for i in one], [sets[i] for i in two])
    alike = shared >= least * (sizes[one][:, None] + sizes[two][None, :] - shared) - 1e-9
    top: dict[int, int] = {}

    def root(c: int) -> int:
        while c in top:
            c = top[c]
        return c

    links: tuple[list, list] = ([], [])
    for i, j in zip(*np.nonzero(alike)):
        x, y = root(rows["comp"][one[i]]), root(rows["comp"][two[j]])
        if x != y:
            top[x] = y
            links[0].append(rows["node"][one[i]])
            links[1].append(rows["node"][two[j]])
    give_back()
    return pa.table({"a": pa.array(links[0], pa.int64()), "b": pa.array(links[1], pa.int64())})


def _compare_blocks(open_: DataFrame, texts: DataFrame, width: int, least: float, work: Scratch) -> DataFrame:
    """Links among the members (key, node, comp, n) of bands that hold several classes.

    A band of ``n`` texts has n / ``BLOCK`` blocks; a member goes to each pair of blocks that its own
    is in, so rows grow with n x n / ``BLOCK`` and stay n for bands of one block.
    """
    ship(texts.sparkSession)
    needed = texts.join(open_.select("node").distinct(), "node", "left_semi")
    hashes = work.cut(map_rows(needed, _hashes, "node long, x array<long>", width), "hashes")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = open_.withColumn("blocks", blocks).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = dealt.select(
        "key", "node", "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side")
    )
    met = pair.join(hashes, "node")
    return met.groupBy("key", "i", "j").applyInArrow(lambda t: _joining(t, least), "a long, b long")


def _print_links(nodes: DataFrame, radius: int, work: Scratch) -> DataFrame:
    """(a, b): each text with one of its SimHash class, so that every class is connected."""
    roots = print_classes(nodes, radius, Scratch(work.spark, "simhash"))
    named = nodes.select("node", "fp").join(roots, "fp", "left").select("node", F.coalesce("root", "fp").alias("root"))
    lead = named.groupBy("root").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("root", "a")
    return named.join(lead, "root").filter("node <> a").select("a", F.col("node").alias("b"))


def resembling(docs: DataFrame, least: float = SIMILARITY, width: int = WIDTH, radius: int | None = None) -> DataFrame:
    """(doc_id, th, component_id, first): the class of every document.

    Classes are the components of the pairs with similarity ``least`` and more among all that
    collide; texts of the same words are one class, those without words too.  With ``radius``, texts
    whose SimHash fingerprints differ in at most that many bits are linked as well.  component_id is
    the smallest doc_id of the class (null only if no member has one), first is true for the
    one row that stands for the class.  An empty table gives no rows.
    """
    work = Scratch(docs.sparkSession, "resemblance")
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), utf8().alias("t"))
    found = map_rows(keyed, _rows, "doc_id long, th long, node long, fp long, bands array<long>", width, radius is not None)
    rows, _ = work.save(found, "rows")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("head")
    nodes, _ = work.save(rows.groupBy("node").agg(head, F.first("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    links = [] if radius is None else [work.cut(_print_links(nodes, radius, work), "print_links")]

    keys = nodes.select("node", F.explode("bands").alias("key"))
    ends = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").drop("z")
    met, n = work.save(keys.join(ends, "key"), "met")
    if n:
        wanted = met.select("node").distinct().join(nodes, "node").select("node", F.col("head.doc_id").alias("_d"), F.col("head.th").alias("_th"))
        texts = keyed.join(wanted, keyed.doc_id.eqNullSafe(wanted._d) & (keyed.th == wanted._th)).select("node", "t")
        texts, _ = work.save(texts.dropDuplicates(["node"]), "texts")
        seen, comp = [], met.select("node", F.col("node").alias("comp")).distinct()
        if links:  # texts of one SimHash class need no comparison
            comp = components(links[0], Scratch(work.spark, "resemblance"))
        for step in range(STARS + 1):
            named = met.join(comp, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
            size = named.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            mixed, left = work.save(size.filter("lo <> hi").select("key", "n"), f"mixed{step}")
            if not left:
                break
            open_ = named.join(mixed, "key")
            if step == STARS:
                links.append(work.cut(_compare_blocks(open_, texts, width, least, work), "links"))
                break
            lead = F.min_by(F.struct("node", "comp"), F.xxhash64("node", F.lit(step)))  # another one each time
            to = open_.groupBy("key").agg(lead.alias("lead")).select("key", F.col("lead.node").alias("to"), F.col("lead.comp").alias("other"))
            met_pairs = open_.join(to, "key").filter("comp <> other")
            pairs = met_pairs.select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct()
            for old in seen:
                pairs = pairs.join(old, ["a", "b"], "left_anti")
            pairs = work.cut(pairs, f"pairs{step}")
            seen.append(pairs)
            links.append(work.cut(_compare(pairs, texts, width, least), f"links{step}"))
            comp = components(reduce(DataFrame.union, links), Scratch(work.spark, "resemblance"))
    if not links:
        links = [met.select("a", F.col("node").alias("b"))]
    comp = components(reduce(DataFrame.union, links), work)
    tops = comp.join(nodes, "node").groupBy("comp").agg(F.min("head").alias("top"))
    linked = comp.join(tops, "comp").select("node", "top")
    whole = nodes.join(linked, "node", "left").select("node", F.coalesce("top", "head").alias("top"))
    is_first = F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("th") == F.col("top.th"))
    return rows.join(whole, "node").select("doc_id", "th", F.col("top.doc_id").alias("component_id"), is_first.alias("first"))


def drop_resembling(docs: DataFrame, least: float = SIMILARITY, width: int = WIDTH, radius: int | None = None) -> DataFrame:
    """One document of each class, with all columns of ``docs``; of equal rows one stays."""
    keep = resembling(docs, least, width, radius).filter("first").select(
        F.col("doc_id").alias("_keep"), F.col("th").alias("_keep_th")
    ).distinct()
    marked = docs.withColumn("_th", F.xxhash64("text")).withColumn("_id", F.col("doc_id").cast("long"))
    same = F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_th") == F.col("_keep_th"))
    return marked.join(keep, same, "left_semi").dropDuplicates(["_id", "_th"]).drop("_th", "_id")
