"""Packing into fixed sequences as a cutting-stock problem solved by column generation.

Documents are tokenised and cut at multiples of the sequence length.  The pieces' lengths
are counted in units; a linear program over patterns (multisets of lengths that fit into one
sequence) covers the counts, and a knapsack over the dual prices finds the next pattern.
The solution is rounded down, what is left is packed best fit first, and each pattern's
places are filled with the pieces of that length by their rank.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopgraph.llm.common import map_rows, numbered, table, utf8
from hopgraph.plans.scratch import Scratch

#: Tokens in one unit of length; a sequence of 2048 has 256 units.
UNIT = 8
END_ID = 1
#: Hash blocks by which the pieces of one length are ranked.
BLOCKS = 64
#: The linear program stops this close to its bound, or after so many columns per length.
GAP = 1e-3
COLUMNS = 20

_CODERS: dict[tuple, tuple] = {}
#: Texts that the rank-based coder leaves to the full tokenizer: special tokens and huge runs.
_HARD = re.compile(r"<\||\S{4096}|\s{4096}")


def _coder(full: str, ranks: str | None) -> tuple:
    key = (full, ranks)
    if key not in _CODERS:
        from tokenizers import Tokenizer

        fast = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        _CODERS.clear()
        _CODERS[key] = (Tokenizer.from_file(full), fast)
    return _CODERS[key]


def token_ids(text: str, full: str, ranks: str | None) -> list[int]:
    """Ids of ``full`` (a tokenizers file).  ``ranks``, the same vocabulary as ranks, is several
    times as fast and gives the same ids on all but the texts that go to ``full`` anyway."""
    tokenizer, fast = _coder(full, ranks)
    if fast is None or _HARD.search(text):
        return tokenizer.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def _cut(cols: dict, full: str, ranks: str | None, capacity: int, with_ids: bool) -> dict:
    out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
    if with_ids:
        out["ids"] = []
    for doc_id, text in zip(cols["doc_id"].to_pylist(), cols["t"].to_pylist()):
        ids = np.array([*(token_ids(text.decode(), full, ranks) if text else []), END_ID], "<u4")
        for start in range(0, len(ids), capacity):
            part = ids[start : start + capacity]
            out["doc_id"].append(doc_id)
            out["start"].append(start)
            out["length"].append(len(part))
            out["ids_crc32"].append(zlib.crc32(part.tobytes()))
            out["doc_tokens"].append(len(ids))
            if with_ids:
                out["ids"].append(part.tolist())
    return out


def pieces(docs: DataFrame, full: str, ranks: str | None, capacity: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): every document cut into pieces."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    rows = docs.select(F.col("doc_id").cast("long"), utf8().alias("t"))
    return map_rows(rows, _cut, schema, full, ranks, capacity, with_ids)


def _knapsack(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of ``sizes`` that fits into ``room``: its value and counts."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        fit = np.searchsorted(sizes, c, side="right")
        if fit:
            value = best[c - sizes[:fit]] + prices[:fit]
            i = int(value.argmax())
            if value[i] > best[c] + 1e-12:
                best[c], pick[c] = value[i], i
    counts, c = np.zeros(len(sizes)), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[room]), counts


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By elimination in this thread; a library's threads would outweigh so small a matrix."""
    n = len(matrix)
    work = np.hstack([matrix, np.eye(n)])
    for i in range(n):
        top = i + int(np.abs(work[i:, i]).argmax())
        work[[i, top]] = work[[top, i]]
        work[i] /= work[i, i]
        others = np.flatnonzero(work[:, i])
        others = others[others != i]
        work[others] -= work[others, i][:, None] * work[i]
    return work[:, n:]


def solve(demand: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({size: copies}, number of sequences) that hold exactly ``demand``."""
    sizes = np.array(sorted(k for k, v in demand.items() if v > 0))
    if not len(sizes):
        return []
    need = np.array([demand[s] for s in sizes], float)
    basis = np.diag(np.floor(room / sizes))
    inverse = np.diag(1 / np.diag(basis))
    amount = (inverse * need).sum(axis=1)
    bound = 0.0
    for step in range(COLUMNS * len(sizes)):
        prices = inverse.sum(axis=0)
        value, column = _knapsack(prices, sizes, room)
        bound = max(bound, (prices * need).sum() / max(value, 1))
        if value <= 1 + 1e-9 or amount.sum() * (1 - GAP) <= bound:
            break
        move = (inverse * column).sum(axis=1)
        ratio = np.where(move > 1e-9, amount / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        amount = np.maximum(amount - ratio[out] * move, 0)
        amount[out] = ratio[out]
        basis[:, out] = column
        if step % 500 == 499:  # anew, against rounding errors
            inverse = _inverse(basis)
            amount = np.maximum((inverse * need).sum(axis=1), 0)
        else:
            row = inverse[out] / move[out]
            inverse -= np.outer(move, row)
            inverse[out] = row
    whole = np.floor(amount + 1e-6).astype(np.int64)
    left = need.astype(np.int64)
    found: list[tuple[dict[int, int], int]] = []
    for j in np.flatnonzero(whole):
        use = basis[:, j].astype(np.int64)
        held = use > 0
        copies = int(min(whole[j], (left[held] // use[held]).min()))
        if copies:
            left -= use * copies
            found.append(({int(sizes[i]): int(use[i]) for i in np.flatnonzero(use)}, copies))
    return found + [(p, 1) for p in _best_fit(dict(zip(sizes.tolist(), left.tolist())), room)]


def _best_fit(demand: dict[int, int], room: int) -> list[dict[int, int]]:
    bins: list[dict[int, int]] = []
    by_room: dict[int, list[int]] = {}
    for size in sorted(demand, reverse=True):
        for _ in range(demand[size]):
            gap = next((g for g in range(size, room + 1) if by_room.get(g)), None)
            if gap is None:
                at, gap = len(bins), room
                bins.append({})
            else:
                at = by_room[gap].pop()
            bins[at][size] = bins[at].get(size, 0) + 1
            by_room.setdefault(gap - size, []).append(at)
    return bins


def _places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By size: rows (first rank, copies in a sequence, first sequence, first slot) by rank."""
    seen: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for pattern, copies in patterns:
        slot = 0
        for size, n in sorted(pattern.items(), reverse=True):
            rows.setdefault(size, []).append((seen.get(size, 0), n, sequence, slot))
            seen[size] = seen.get(size, 0) + n * copies
            slot += n
        sequence += copies
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def _place(cols: dict, places: dict[int, np.ndarray]) -> dict:
    size, rank = cols["_size"].to_numpy(), cols["_ordinal"].to_numpy()
    sequence, slot = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    for s in np.unique(size):
        at = np.flatnonzero(size == s)
        rows = places[int(s)]
        row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
        past = rank[at] - row[:, 0]
        sequence[at] = row[:, 2] + past // row[:, 1]
        slot[at] = row[:, 3] + past % row[:, 1]
    kept = {k: v for k, v in cols.items() if k not in ("_size", "_ordinal")}
    return {**kept, "sequence_id": sequence, "_slot": slot}


def pack(
    docs: DataFrame, full: str, ranks: str | None = None, capacity: int = 2048, with_ids: bool = False
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of every piece.

    A null or empty text is the end id alone.  Rows with a repeated or null id are packed like
    any others.  Sequences are numbered from 0, offsets inside one are gapless.  The histogram
    has at most ``capacity`` / UNIT lengths, and so have the patterns; nothing else is
    gathered.  Ties in rank are equal rows.  An empty table gives no rows.
    """
    work = Scratch(docs.sparkSession, "pack")
    cut, _ = work.save(pieces(docs, full, ranks, capacity, with_ids), "pieces")
    sized = cut.withColumn("_size", F.ceil(F.col("length") / UNIT).cast("long"))
    demand = {r["_size"]: r["count"] for r in sized.groupBy("_size").count().collect()}
    places = _places(solve(demand, capacity // UNIT))
    order = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = numbered(sized, ["_size"], order, BLOCKS, "_ordinal").select(*cut.columns, "_size", "_ordinal")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, _slot long"
    placed = map_rows(ranked, _place, schema, places)
    before = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("_slot")


def public_paths() -> tuple[str, str]:
    """Vocabulary of 50,257 byte-level tokens: the tokenizers file and the same as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), *public_paths())
