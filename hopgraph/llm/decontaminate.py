"""Benchmark decontamination: one Aho-Corasick automaton over the items' windows.

Texts are normalised to their words with one space around each, so that a window of words
is a string and word borders are part of it.  A text is scanned once; where the automaton
stops, the words of the match are marked and mapped back to offsets in the original.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import reduce

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopgraph.llm.common import map_rows, table, utf8

#: Bytes of benchmark text that one automaton holds; more text means further automata.
AUTOMATON_BYTES = 16 << 20

#: Lower-cases A-Z and turns every ASCII character but letters and digits into a space.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))

_BUILT: dict[bytes, tuple] = {}


def words(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


def windows(text: bytes | None, width: int) -> list[tuple[bytes, ...]]:
    found = words(text)
    if not found:
        return []
    return [tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1))]


def _automaton(items: list[tuple[int, bytes]], width: int) -> tuple:
    """(automaton, items by window number); kept by the worker for its next batches."""
    key = hashlib.sha256(repr((items, width)).encode()).digest()
    if key not in _BUILT:
        owners: dict[tuple[bytes, ...], set[int]] = defaultdict(set)
        for item_id, text in items:
            for w in windows(text, width):
                owners[w].add(item_id)
        auto = ahocorasick.Automaton()
        for w, ids in owners.items():
            auto.add_word((b" " + b" ".join(w) + b" ").decode("latin-1"), (len(w), sorted(ids)))
        if owners:
            auto.make_automaton()
        _BUILT.clear()
        _BUILT[key] = (auto, bool(owners))
    return _BUILT[key]


def scan(text: bytes | None, auto, some: bool) -> tuple[int, np.ndarray, set[int]]:
    """Number of words, which of them are hit, and the items with occurring windows."""
    found = words(text)
    hit, ids = np.zeros(0, bool), set()
    if not found or not some:
        return len(found), hit, ids
    line = (b" " + b" ".join(found) + b" ").decode("latin-1")
    ends = None
    for stop, (n, owners) in auto.iter(line):
        if ends is None:
            hit = np.zeros(len(found), bool)
            ends = np.cumsum([len(w) + 1 for w in found])  # place of the space after each word
        last = int(np.searchsorted(ends, stop))
        hit[last - n + 1 : last + 1] = True
        ids.update(owners)
    return len(found), hit, ids


def spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Runs of hit words: byte offsets in the original and first and last word."""
    if not hit.any():
        return []
    inside = np.frombuffer(text.translate(NORMAL), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    run = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    return [
        {"start": int(begin[i]), "stop": int(end[j - 1]), "first": int(i), "last": int(j - 1)}
        for i, j in zip(np.flatnonzero(run == 1), np.flatnonzero(run == -1))
    ]


def merged(runs: list[dict]) -> list[dict]:
    """Overlapping and adjoining runs of words as one."""
    out: list[dict] = []
    for r in sorted(runs, key=lambda r: r["first"]):
        if out and r["first"] <= out[-1]["last"] + 1:
            if r["last"] > out[-1]["last"]:
                out[-1] |= {"stop": r["stop"], "last": r["last"]}
        else:
            out.append(dict(r))
    return out


def _hits(runs: list[dict]) -> int:
    return sum(r["last"] - r["first"] + 1 for r in runs)


def _scan_batch(cols: dict, pack, width: int) -> dict:
    out: dict[str, list] = {"doc_id": cols["doc_id"], "th": cols["th"], "n_words": [], "n_hit": [], "items": [], "spans": []}
    auto, some = _automaton(pack.value, width)
    for text in cols["t"].to_pylist():
        n, hit, ids = scan(text, auto, some)
        out["n_words"].append(n)
        out["n_hit"].append(int(hit.sum()))
        out["items"].append(sorted(ids))
        out["spans"].append(spans(text, hit) if len(hit) else [])
    return out


def _merge_batch(cols: dict) -> dict:
    out: dict[str, list] = {k: [] for k in ("doc_id", "th", "n_words", "n_hit", "items", "spans")}
    for doc_id, th, n, copies, items, runs in zip(*(cols[k].to_pylist() for k in ("doc_id", "th", "n_words", "copies", "items", "spans"))):
        whole = merged([r for some in runs for r in some])
        for _ in range(copies):
            for k, v in zip(out, (doc_id, th, n, _hits(whole), sorted({i for some in items for i in some}), whole)):
                out[k].append(v)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """(doc_id, th, n_words, n_hit, items, spans) of every document.

    A window is ``width`` consecutive words of an item (a shorter item is one window); a word
    inside an occurrence of a window is hit.  items lists the items with windows that occur,
    spans the runs of hit words by byte offsets in the text and by word number.  Null or empty
    texts have no words.  Items without words or without an id have no windows; windows that
    several items share count for each.  An automaton, and what is broadcast, holds at most
    ``AUTOMATON_BYTES`` of items' text (or one item): all but a very large benchmark.  A larger
    one takes as many scans, whose runs are then merged.
    """
    spark = docs.sparkSession
    rows = benchmark.filter("item_id is not null and text is not null").select(
        F.col("item_id").cast("long"), utf8().alias("t")
    ).distinct()
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), utf8().alias("t"))
    run = "struct<start: long, stop: long, first: long, last: long>"
    schema = f"doc_id long, th long, n_words long, n_hit long, items array<long>, spans array<{run}>"
    found, pack, size = [], [], 0

    def add() -> None:
        found.append(map_rows(texts, _scan_batch, schema, spark.sparkContext.broadcast(pack), width))

    for item_id, text in rows.orderBy("item_id", "t").toLocalIterator():
        if pack and size + len(text) > AUTOMATON_BYTES:
            add()
            pack, size = [], 0
        pack.append((item_id, bytes(text)))
        size += len(text)
    add()
    if len(found) == 1:
        return found[0]
    every = reduce(DataFrame.union, found).groupBy("doc_id", "th").agg(
        F.max("n_words").alias("n_words"),
        (F.count(F.lit(1)) / len(found)).cast("long").alias("copies"),
        F.collect_list(F.when(F.size("items") > 0, F.col("items"))).alias("items"),
        F.collect_list(F.when(F.size("spans") > 0, F.col("spans"))).alias("spans"),
    )
    return map_rows(every, _merge_batch, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The documents without any hit word, with all their columns."""
    bad = contamination(docs, benchmark, width).filter("n_hit > 0").select(
        F.col("doc_id").alias("_bad"), F.col("th").alias("_bad_th")
    ).distinct()
    marked = docs.withColumn("_th", F.xxhash64("text")).withColumn("_id", F.col("doc_id").cast("long"))
    same = F.col("_id").eqNullSafe(F.col("_bad")) & (F.col("_th") == F.col("_bad_th"))
    return marked.join(bad, same, "left_anti").drop("_th", "_id")


def op1_contamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = """
with doc as (
  select doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), '[^ ]+') as w
  from documents
), item as (
  select distinct item_id, regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), '[^ ]+') as w
  from benchmark where item_id is not null and text is not null
), win as (
  select distinct item_id, least(len(w), 10) as k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from item where len(w) > 0)
), place as (
  select doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') as s
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from doc, (select distinct k from win) where len(w) >= k)
), found as (
  select doc_id, i, place.k as k, item_id from place join win on place.s = win.s and place.k = win.k
), hits as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from found) group by doc_id
), ids as (
  select doc_id, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as s
  from (select distinct doc_id, item_id from found) group by doc_id
)
select doc.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join hits using (doc_id) left join ids using (doc_id)
"""
