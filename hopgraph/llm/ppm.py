"""Prediction by partial matching: log probability of whole texts.

A trie of byte contexts up to ``ORDER`` is counted over the learning texts: what Spark adds up
are the counts of (context, next byte) at the deepest level; the shorter contexts follow.  A
byte is coded in the longest context that has been seen; where it is new there, an escape
(method X: as likely as the number of bytes seen once, and one) leads to the next shorter
context, in which the bytes of the longer one are excluded.  Texts begin and end with a byte
that UTF-8 never uses, so that the end is coded too.

The unigram base needs the count of every token of the corpus in every text.  Documents are
dealt into blocks of bounded size; a block sends each of its different tokens once, as a
hash, to the part of the vocabulary that owns it, and gets the total back.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from hopgraph.llm.common import ship, slices, table, utf8
from hopgraph.plans.scratch import Scratch

ORDER = 5
#: Most trie entries that are held at once; order 2 has never more.
ENTRIES = 1 << 24
#: Entries of a part of a larger trie, on average.
PART_ENTRIES = 1 << 21
#: Bytes of text in a block of documents, and bytes looked at in one go.
BLOCK_BYTES = 8 << 20
CHUNK = 1 << 20

EDGE = b"\xff"
END = b"\n"  # no word holds white space
_EMPTY = np.uint64(2**64 - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _grams(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, context and next byte as one number) of every byte and end."""
    some: list[bytes] = []
    first = size = 0
    for i, text in enumerate(texts):
        some.append(EDGE * order + text + EDGE)
        size += len(some[-1])
        if size < CHUNK and i + 1 < len(texts):
            continue
        octets = np.frombuffer(b"".join(some), np.uint8)
        lengths = np.array([len(x) for x in some])
        starts = np.cumsum(lengths) - lengths
        coded = np.ones(len(octets), bool)
        for k in range(order):
            coded[starts + k] = False
        owner = np.repeat(np.arange(first, first + len(some)), lengths)
        for at in range(order, len(octets), CHUNK):
            stop = min(at + CHUNK, len(octets))
            key = np.zeros(stop - at, np.uint64)
            for k in range(order, -1, -1):
                key = (key << np.uint64(8)) | octets[at - k : stop - k]
            yield owner[at:stop][coded[at:stop]], key[coded[at:stop]]
        some, first, size = [], i + 1, 0


def _add(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.bincount(inverse, np.concatenate(counts), len(every)).astype(np.int64)


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        size = 0
        for batch in slices(batches):
            texts, learn = batch.column("t").to_pylist(), batch.column("learn").to_pylist()
            size += sum(len(t) for t in texts)
            found = [np.unique(key, return_counts=True) for _, key in _grams([t.lower() for t, x in zip(texts, learn) if x], order)]
            keys, counts = _add([keys, *(k for k, _ in found)], [counts, *(c for _, c in found)])
        yield pa.RecordBatch.from_pydict({"key": keys.view(np.int64), "n": counts})
        yield pa.RecordBatch.from_pydict({"key": np.array([-1]), "n": np.array([size])})

    return run


class Trie:
    """Counts of (context, byte) at every order, and what coding needs of each context.

    ``shallow`` are the keys and counts of order 1 over all texts, if ``keys`` are only those of some
    contexts of order 2.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, shallow: tuple[np.ndarray, np.ndarray] | None = None):
        self.order = order
        self.pairs, self.counts, self.nodes = [None] * (order + 1), [None] * (order + 1), [None] * (order + 1)
        self.sums, self.hidden = [None] * (order + 1), [None] * (order + 1)
        for k in range(order, -1, -1):
            if k == 1 and shallow:
                keys, counts = shallow
            keys, counts = _add([keys & np.uint64((1 << 8 * (k + 1)) - 1)], [counts])
            self.pairs[k], self.counts[k] = keys, counts
            self.nodes[k], owner = np.unique(keys >> np.uint64(8), return_inverse=True)
            self.sums[k] = self._sums(owner, counts, len(self.nodes[k]))
            if k < order:  # what the bytes of each longer context come to here
                here = counts[np.searchsorted(keys, self.pairs[k + 1] & np.uint64((1 << 8 * (k + 1)) - 1))]
                self.hidden[k + 1] = self._sums(longer, here, len(self.nodes[k + 1]))
            longer = owner
        keys = self.pairs[order]
        logs = np.empty(len(keys), np.float32)
        for at in range(0, len(keys), CHUNK):
            logs[at : at + CHUNK] = self._escape(keys[at : at + CHUNK])
        self.bits = max(4, (3 * len(keys) // 2).bit_length())
        self.slots, self.logs = np.full(1 << self.bits, _EMPTY), np.zeros(1 << self.bits, np.float32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.slots[slot] == _EMPTY
            self.slots[slot[free]] = keys[left[free]]
            held = self.slots[slot] == keys[left]
            self.logs[slot[held]] = logs[left[held]]
            left, slot = left[~held], (slot[~held] + 1) & ((1 << self.bits) - 1)
        # from now on the slots tell what has been seen at the deepest level
        self.pairs[order], self.counts[order] = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    @staticmethod
    def _sums(owner: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        """By context: all counts, how many bytes they are of, and how many were seen once."""
        return np.array([np.bincount(owner, counts, n), np.bincount(owner, minlength=n), np.bincount(owner, counts == 1, n)])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each byte in its context."""
        slot = self._slot(keys)
        seen = self.slots[slot]
        out = self.logs[slot].astype(float)
        found = seen == keys
        look = np.flatnonzero(~found & (seen != _EMPTY))
        slot = slot[look]
        while len(look):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            seen = self.slots[slot]
            hit = seen == keys[look]
            out[look[hit]] = self.logs[slot[hit]]
            found[look[hit]] = True
            more = ~hit & (seen != _EMPTY)
            look, slot = look[more], slot[more]
        new = np.flatnonzero(~found)
        if len(new):
            out[new] = self._escape(keys[new])
        return out

    def _escape(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        open_, longer = np.ones(len(keys), bool), np.full(len(keys), -1)
        for k in range(self.order, -1, -1):
            if not len(self.nodes[k]):
                continue
            context = (keys >> np.uint64(8)) & np.uint64((1 << 8 * k) - 1)
            node = np.minimum(np.searchsorted(self.nodes[k], context), len(self.nodes[k]) - 1)
            known = np.flatnonzero(open_ & (self.nodes[k][node] == context))
            node, prior = node[known], longer[known]
            total, kinds, once = self.sums[k][:, node]
            if k < self.order and len(known) and len(self.nodes[k + 1]):
                less = np.where(prior >= 0, self.hidden[k + 1][:, prior], 0)
                total, kinds, once = total - less[0], kinds - less[1], once - less[2]
            every = total + once + 1
            hit = np.zeros(len(known), bool)
            if len(self.pairs[k]):
                pair = keys[known] & np.uint64((1 << 8 * (k + 1)) - 1)
                at = np.minimum(np.searchsorted(self.pairs[k], pair), len(self.pairs[k]) - 1)
                hit = self.pairs[k][at] == pair
                out[known[hit]] += np.log10(self.counts[k][at[hit]] / every[hit])
                open_[known[hit]] = False
            miss = ~hit & (kinds > 0)
            out[known[miss]] += np.log10((once + 1)[miss] / every[miss])
            longer[:] = -1
            longer[known] = node
        root = self.sums[0][1, 0] if len(self.nodes[0]) else 0.0
        out[open_] -= np.log10(256 - root)
        return out


_TRIES: dict[str, Trie] = {}


def _trie(held) -> Trie:
    name, keys, counts, order = held.value
    if name not in _TRIES:
        _TRIES.clear()
        _TRIES[name] = Trie(keys, counts, order)
    return _TRIES[name]


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of the trie that holds each key: all keys of a context of order 2 are in one."""
    return ((((keys >> np.uint64(8)) & np.uint64(0xFFFF)) * _ODD) >> np.uint64(32)) % np.uint64(parts)


def _asked(texts: list[bytes], order: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of the texts by part, then key, and where each part begins and ends."""
    some, size = [np.zeros(0, np.uint64)], 0
    for _, key in _grams([t.lower() for t in texts], order):
        some.append(np.unique(key))
        size += len(some[-1])
        if size > 4 * CHUNK:
            some = [np.unique(np.concatenate(some))]
            size = 0
    keys = np.unique(np.concatenate(some))
    part = _part_of(keys, parts)
    order_ = np.argsort(part, kind="stable")
    return keys[order_], np.searchsorted(part[order_], np.arange(parts + 1))


class Answers:
    """Scores of the keys that a block of documents asked for."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.logs = keys[order], logs[order]

    def score(self, keys: np.ndarray) -> np.ndarray:
        return self.logs[np.searchsorted(self.keys, keys)]


def _ask(order: int, parts: int):
    def run(t: pa.Table) -> pa.Table:
        keys, cut = _asked(t.column("t").to_pylist(), order, parts)
        asked = [a < b for a, b in zip(cut, cut[1:])]
        return pa.table(
            {
                "part": pa.array(np.flatnonzero(asked), pa.int32()),
                "block": pa.array([t.column("block")[0].as_py()] * sum(asked), pa.int32()),
                "q": pa.array([keys[a:b].tobytes() for a, b, x in zip(cut, cut[1:], asked) if x], pa.binary()),
            }
        )

    return run


def _answer(held):
    """Logs of the asked keys: rows (part, block, key, n, q) by part, its counts (no block) first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, keys1, counts1 = held.value
        now, trie, some = None, None, []
        for batch in slices(batches):
            part = batch.column("part").to_numpy()
            cut = np.flatnonzero(part[1:] != part[:-1]) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(part)]):
                rows = batch.slice(a, b - a)
                if part[a] != now:
                    now, trie, some = part[a], None, []
                own = rows.column("block").null_count  # nulls come first
                if own:
                    counted = rows.slice(0, own)
                    some.append((counted.column("key").to_numpy().view(np.uint64), counted.column("n").to_numpy()))
                asks = rows.slice(own)
                if not asks.num_rows:
                    continue
                if trie is None:
                    every = [np.concatenate([np.zeros(0, kind), *(x[i] for x in some)]) for i, kind in ((0, np.uint64), (1, np.int64))]
                    trie, some = Trie(*every, order, (keys1, counts1)), []
                logs = [trie.score(np.frombuffer(q, np.uint64)).tobytes() for q in asks.column("q").to_pylist()]
                yield pa.RecordBatch.from_pydict({"part": asks.column("part"), "block": asks.column("block"), "c": pa.array(logs, pa.binary())})

    return run


def _answers(kept: DataFrame, n: int, dealt: DataFrame, order: int) -> tuple[DataFrame, int]:
    """(part, block, c): logs of the keys that each block has, from the ``n`` counts (key, n) of the
    whole trie, which is dealt by contexts of order 2; and the number of parts."""
    spark = kept.sparkSession
    parts = -(-n // PART_ENTRIES)
    first = kept.groupBy(F.col("key").bitwiseAND(F.lit(0xFFFF).cast("long")).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    held = spark.sparkContext.broadcast((order, first["key"].to_numpy().view(np.uint64), first["n"].to_numpy()))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            part = _part_of(batch.column("key").to_numpy().view(np.uint64), parts).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"part": part, "key": batch.column("key"), "n": batch.column("n")})

    counts = kept.select("key", "n").mapInArrow(deal, "part int, key long, n long")
    asks = dealt.groupBy("block").applyInArrow(_ask(order, parts), "part int, block int, q binary")
    rows = counts.unionByName(asks, allowMissingColumns=True).select("part", "block", "key", "n", "q")
    met = rows.repartition(parts, "part").sortWithinPartitions("part", F.col("block").asc_nulls_first())
    return met.mapInArrow(_answer(held), "part int, block int, c binary"), parts


def _tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def _hashes(tokens, n: int) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, tokens, repeat(0)), np.uint64, n)


def _vocabulary(texts: list[bytes], learn: list[bool], parts: int) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Place of each different token, and by place its hash and count in the learning texts.
    Places go by part, then hash."""
    learnt: Counter[bytes] = Counter()
    others: set[bytes] = set()
    for text, x in zip(texts, learn):
        (learnt if x else others).update(_tokens(text))
    counts = {**dict.fromkeys(others, 0), **learnt}
    hashes, inverse = np.unique(_hashes(counts, len(counts)), return_inverse=True)
    total = np.bincount(inverse, np.fromiter(counts.values(), np.int64, len(counts)), len(hashes)).astype(np.int64)
    order = np.lexsort((hashes, hashes % np.uint64(parts)))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return dict(zip(counts, place[inverse].tolist())), hashes[order], total[order]


def _rows(t: pa.Table) -> tuple[list[bytes], list[bool]]:
    return t.column("t").to_pylist(), t.column("learn").to_pylist()


def _send(parts: int):
    def run(t: pa.Table) -> pa.Table:
        _, hashes, counts = _vocabulary(*_rows(t), parts)
        cut = np.searchsorted(hashes % np.uint64(parts), np.arange(parts + 1))
        return pa.table(
            {
                "block": pa.array([t.column("block")[0].as_py()] * parts, pa.int32()),
                "part": pa.array(range(parts), pa.int32()),
                "h": pa.array([hashes[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                "c": pa.array([counts[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
            }
        )

    return run


def _merge(t: pa.Table) -> pa.Table:
    hashes = [np.frombuffer(x, np.uint64) for x in t.column("h").to_pylist()]
    counts = [np.frombuffer(x, np.int64) for x in t.column("c").to_pylist()]
    every, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts), len(every)).astype(np.int64)
    ends = np.cumsum([len(h) for h in hashes])
    kind = np.uint32 if not len(total) or total.max() < 2**32 else np.int64
    back = [total[inverse[e - len(h) : e]].astype(kind).tobytes() for e, h in zip(ends, hashes)]
    n = len(back)
    return pa.table(
        {
            "block": t.column("block"),
            "part": t.column("part"),
            "c": pa.array(back, pa.binary()),
            "kinds": pa.array([int((total > 0).sum())] * n, pa.int64()),
            "n": pa.array([int(total.sum())] * n, pa.int64()),
        }
    )


def _score(held, parts: int):
    """``held``: the broadcast trie, or (order, parts) of one whose answers come with the totals."""

    def run(docs: pa.Table, totals: pa.Table) -> pa.Table:
        texts, learn = _rows(docs)
        places, hashes, _ = _vocabulary(texts, learn, parts)
        back = totals.sort_by("part")
        logged = back.filter(pc.less(back.column("part"), 0))  # answers of a large trie, the first part last
        back = back.filter(pc.greater_equal(back.column("part"), 0))
        sizes = np.bincount((hashes % np.uint64(parts)).astype(np.int64), minlength=parts)
        counts = np.concatenate(
            [
                np.frombuffer(x, np.uint32 if len(x) == 4 * n else np.int64).astype(np.int64)
                for x, n in zip(back.column("c").to_pylist(), sizes)
            ]
        )
        trained, kinds = sum(back.column("n").to_pylist()), sum(back.column("kinds").to_pylist())
        logs = np.log10(counts + 1.0)
        out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base_score")}
        for text in texts:
            tokens = _tokens(text)
            at = np.fromiter(map(places.__getitem__, tokens), np.int64, len(tokens))
            out["n_tokens"].append(len(tokens))
            out["n_known"].append(int((counts[at] > 0).sum()))
            out["base_score"].append(float(logs[at].sum() - len(tokens) * np.log10(trained + kinds + 1.0)))
        order, score = (held[0] if isinstance(held, tuple) else held.value[3]), np.zeros(len(texts))
        if isinstance(held, tuple):
            asked = [np.frombuffer(x, np.float64) for x in logged.column("c").to_pylist()[::-1]]
            trie = Answers(_asked(texts, *held)[0], np.concatenate(asked))
        else:
            trie = _trie(held)
        for owner, keys in _grams([t.lower() for t in texts], order):
            score += np.bincount(owner, trie.score(keys), len(texts))
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "learn": docs.column("learn"),
                **{k: pa.array(v) for k, v in out.items()},
                "train_tokens": pa.array([trained] * len(texts), pa.int64()),
                "score": pa.array(score),
            }
        )

    return run


def train(rows: DataFrame, work: Scratch, order: int = ORDER, whole: bool = False):
    """(broadcast of the trie's deepest counts, bytes of all texts, counts, their number) of rows (t, learn).

    ``whole``: the trie reaches as deep as ``order`` whatever its size; if its entries do not fit
    ``ENTRIES``, they stay in the table of counts and nothing is broadcast (None).  Else it then
    has one level less, and so on; the 256^3 entries of order 2 always fit.
    """
    summed = rows.select("t", "learn").mapInArrow(_count(order), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    kept, n = work.save(summed, "counts")
    size = kept.filter("key = -1").first()
    kept = kept.filter("key <> -1")
    if whole and n > ENTRIES and order >= 2:
        return None, size.n if size else 0, kept, n
    while n > ENTRIES and order > 2:
        order -= 1
        mask = (1 << 8 * (order + 1)) - 1
        kept, n = work.save(
            kept.groupBy(F.col("key").bitwiseAND(F.lit(mask).cast("long")).alias("key")).agg(F.sum("n").alias("n")), f"counts{order}"
        )
    got = kept.toArrow()
    model = (uuid.uuid4().hex, got["key"].to_numpy().view(np.uint64), got["n"].to_numpy(), order)
    return rows.sparkSession.sparkContext.broadcast(model), size.n if size else 0, kept, n


def score_documents(docs: DataFrame, learn, order: int = ORDER, whole: bool = False) -> DataFrame:
    """(doc_id, learn, n_tokens, n_known, train_tokens, base_score, score) of every document.

    ``learn`` is a condition on ``docs``: the texts that the trie and the token counts are
    learnt from.  A-Z are lowered.  score is the log10 probability of the whole lowered text
    and its end, base_score that of its words and one end under the add-one unigram; a null
    text is an empty one.  If nothing is learnt, all bytes are as likely.  An empty table
    gives no rows; further columns are not looked at.  ``whole``: contexts of all ``order`` bytes
    count at any size; blocks then exchange keys for logs with the parts of a trie that is too
    large to be sent, and the scores are the same.
    """
    spark = docs.sparkSession
    ship(spark)
    work = Scratch(spark, "ppm")
    text = F.coalesce(utf8(), F.lit(b""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("t"), F.coalesce(learn, F.lit(False)).alias("learn"))
    held, size, kept, entries = train(rows, work, order, whole)
    blocks = max(1, -(-size // BLOCK_BYTES))
    parts = max(1, blocks // 4)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.xxhash64("t")), F.lit(blocks)).cast("int"))
    sent = dealt.groupBy("block").applyInArrow(_send(parts), "block int, part int, h binary, c binary")
    back = sent.groupBy("part").applyInArrow(_merge, "block int, part int, c binary, kinds long, n long")
    if held is None:
        logs, n = _answers(kept, entries, dealt, order)
        held = (order, n)
        none = F.lit(None).cast("long")
        back = back.unionByName(logs.select("block", (-1 - F.col("part")).alias("part"), "c", none.alias("kinds"), none.alias("n")))
    schema = "doc_id long, learn boolean, n_tokens long, n_known long, base_score double, train_tokens long, score double"
    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_score(held, parts), schema)


def op4_lm_score(spark, sf_dir: str) -> DataFrame:
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    learn = F.pmod(F.crc32(name.cast("binary")), F.lit(7)) != 2
    found = score_documents(table(spark, sf_dir, "documents"), learn, whole=True)
    return found.select(
        "doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
