"""Repeated passages across documents by suffix order and longest previous factors.

Every string of ``length`` bytes is looked at, in every document, by where it starts.

1. Anchors.  Of the grams (a fifth of ``length``) inside a string, the one with the smallest hash is
   its anchor (the first of equals).  The anchor follows from the string's bytes alone, so
   equal strings have equal anchors; consecutive strings mostly share one.
2. Strings whose anchor comes once in all documents are unique.  The rest are cut out as
   segments: the consecutive strings of one anchor with their tails.  Segments meet by anchor.
3. Equal segments are told by their hashes: counts and the first place of each are added up
   before the shuffle, so that a passage that any share of all documents holds is a few rows.
   All places of a segment that comes twice repeat, and all but the first are later copies.
4. Only the first place of each different segment is looked at further.  The segments of one
   anchor are put into suffix order.  There, the previous and the next entry with
   a smaller position give each string's longest previous factor (LPF); a string is repeated
   later if its LPF reaches ``length``, and it is the first of several if a later one's does.
5. An anchor with more than ``CROWD`` different segments (the borders of a line or passage that very
   many documents share) has them cut into parts of ``PARTS`` strings that meet by all the bytes
   these share, and parts go through 3 to 5 again; parts of one string are told by 3 alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from hopgraph.llm.common import arrow_schema, map_rows, ship, slices, table, utf8
from hopgraph.plans.scratch import Scratch

LENGTH = 200
#: Different segments of one key that one suffix order takes, and strings in a part of one beyond it.
CROWD = 4096
PARTS = (40, 10, 1)
#: Bytes of different segments that one suffix order holds.
BLOCK_BYTES = 1 << 19
#: Positions of a text that are hashed in one go.
CHUNK = 1 << 20

_PLACES = (1 << 21) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse, modulo 2^64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_UP, _DOWN = _powers(CHUNK + 4096)


def gram_hashes(octets: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram that starts at each byte; polynomial, then mixed."""
    n = len(octets)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((octets.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * _DOWN[: n - gram + 1]
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def anchors(text: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first start, last start, hash, place) of the anchors, by the runs of strings that share them."""
    octets, width = np.frombuffer(text, np.uint8), length - gram + 1
    first, last, hashes, places = [], [], [], []
    for at in range(0, len(text) - length + 1, CHUNK):
        part = octets[at : at + CHUNK + length - 1]
        n = len(part) - length + 1
        h = gram_hashes(part, gram)
        # the place in the low bits: the smallest value is the first of the smallest hashes
        ranked = (h & ~np.uint64(_PLACES)) | np.arange(len(h), dtype=np.uint64)
        rows = np.full(-(-len(h) // width) * width, np.uint64(2**64 - 1))
        rows[: len(h)] = ranked
        rows = rows.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(_PLACES)).astype(np.int64)
        change = np.flatnonzero(place[1:] != place[:-1])
        first.append(at + np.concatenate(([0], change + 1)))
        last.append(at + np.append(change, n - 1))
        hashes.append(h[place[first[-1] - at]])
        places.append(at + place[first[-1] - at])
    if not first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(first), np.concatenate(last), np.concatenate(hashes), np.concatenate(places)


def _signed(octets: bytes, seed: int = 0) -> int:
    return xxh3_64_intdigest(octets, seed & (2**64 - 1)) - (1 << 63)


def _anchor_rows(cols: dict, length: int, gram: int) -> dict:
    """The different segments of each document; ``more`` has the other starts of one that comes again."""
    out: dict[str, list] = {k: [] for k in ("did", "th", "s0", "w", "k", "sh", "more")}
    for did, th, text in zip(*(cols[k].to_pylist() for k in ("did", "th", "t"))):
        first, last, hashes, places = anchors(text, length, gram)
        starts, keys = first.tolist(), hashes.view(np.int64).tolist()
        alike = [_signed(text[a : b + length]) for a, b in zip(starts, last.tolist())]
        widths = ((last - first << 16) | (places - first)).tolist()
        more: list[list | None] = [None] * len(starts)
        seen = dict(zip(zip(keys[::-1], alike[::-1]), range(len(keys) - 1, -1, -1)))
        kept = range(len(keys))
        if len(seen) < len(keys):
            kept = sorted(seen.values())
            for i, pair in enumerate(zip(keys, alike)):
                if (head := seen[pair]) != i:
                    if more[head] is None:
                        more[head] = []
                    more[head].append(starts[i])
        for name, values in zip(list(out)[2:], (starts, widths, keys, alike, more)):
            out[name].extend(values if len(kept) == len(values) else [values[i] for i in kept])
        out["did"].extend([did] * len(kept))
        out["th"].extend([th] * len(kept))
    return out


def _small_rows(cols: dict) -> dict:
    """Texts as they are shuffled: compressed, with their length."""
    codec, texts = pa.Codec("zstd", compression_level=1), cols["t"].to_pylist()
    small = [codec.compress(t, asbytes=True) for t in texts]
    return {"did": cols["did"], "th": cols["th"], "n": [len(t) for t in texts], "z": small}


def _texts(cols: dict) -> Iterator[bytes]:
    codec = pa.Codec("zstd")
    for n, z in zip(cols["n"].to_pylist(), cols["z"]):
        yield codec.decompress(z.as_buffer(), n, asbytes=True) if n else b""


def _segment_rows(cols: dict, length: int) -> dict:
    out: dict[str, list] = {k: [] for k in ("k", "did", "th", "s0", "seg")}
    for did, th, runs, text in zip(*(cols[k].to_pylist() for k in ("did", "th", "runs")), _texts(cols)):
        for run in runs:
            s0 = run["s0"]
            for name, v in zip(out, (run["k"], did, th, s0, text[s0 : s0 + (run["w"] >> 16) + length])):
                out[name].append(v)
    return out


def _part_rows(cols: dict, length: int, part: int) -> dict:
    """Segments cut into parts: the strings whose anchor is j * part and more bytes inside."""
    out: dict[str, list] = {k: [] for k in ("did", "th", "s0", "w", "k", "sh", "more")}
    for did, th, runs, text in zip(*(cols[k].to_pylist() for k in ("did", "th", "runs")), _texts(cols)):
        for run in runs:
            s0, s1, place = run["s0"], run["s0"] + (run["w"] >> 16), run["s0"] + (run["w"] & 0xFFFF)
            for j in range((place - s1) // part, (place - s0) // part + 1):
                high, low = place - j * part, place - (j + 1) * part + 1
                a, b = max(s0, low), min(s1, high)
                key, alike = _signed(text[high : low + length], run["k"] + j), _signed(text[a : b + length])
                for name, v in zip(out, (did, th, a, (b - a << 16) | (place - a), key, alike, None)):
                    out[name].append(v)
    return out


def longest_previous(pos: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """LPF of each suffix: ``pos`` is the suffix order's positions, lcp[i] what entries i - 1
    and i share.  The previous and the next entry with a smaller position share most."""

    def one_side(pos: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        near, shared = np.arange(len(pos)) - 1, lcp.copy()
        look = np.flatnonzero(shared > 0)
        while len(look):
            j = near[look]
            behind = pos[j] > pos[look]
            look, j = look[behind], j[behind]
            shared[look] = np.minimum(shared[look], shared[j])
            near[look] = near[j]
            look = look[shared[look] > 0]
        return shared

    if not len(pos):
        return np.zeros(0, np.int64)
    lcp = np.concatenate(([0], lcp[1:]))
    left = one_side(pos, lcp)
    right = one_side(pos[::-1], np.concatenate(([0], lcp[:0:-1])))[::-1]
    return np.maximum(left, right)


def suffix_order(text: str, starts: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of ``starts`` in the order of the first ``length`` characters from there, equal
    ones as given; what neighbours share, up to ``length``, counted only if it is all of it)."""
    octets, at = np.frombuffer(text.encode("latin-1"), np.uint8), np.asarray(starts, np.int64)
    head = np.zeros(len(at), np.uint64)
    for k in range(min(8, length)):
        head = (head << np.uint64(8)) | octets[at + k]
    # first by the beginnings as numbers; only strings that begin alike are held at a time
    order = np.argsort(head, kind="stable")
    head = head[order]
    lcp = np.zeros(len(at), np.int64)
    cut = np.flatnonzero(head[1:] != head[:-1]) + 1
    lows, highs = np.concatenate(([0], cut)), np.append(cut, len(at))
    several = highs - lows > 1
    for a, b in zip(lows[several].tolist(), highs[several].tolist()):
        mine = order[a:b]
        keys = [text[s : s + length] for s in at[mine].tolist()]
        by_key = sorted(range(b - a), key=keys.__getitem__)
        order[a:b] = mine[by_key]
        lcp[a + 1 : b] = [length * (keys[x] == keys[y]) for x, y in zip(by_key, by_key[1:])]
    return order, lcp


def _match(length: int, block_bytes: int, schema: pa.Schema):
    """Ranges of repeated starts from different segments (k, did, th, s0, seg) sorted by k."""

    def ranges(state: np.ndarray) -> Iterator[tuple[int, int, bool]]:
        cut = np.flatnonzero(state[1:] != state[:-1]) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(state)]):
            if state[a]:
                yield a, b - 1, bool(state[a] == 2)

    def solve(parts: list[list], out: list[tuple]) -> None:
        """parts: [seg, did, th, s0], those of one key together."""
        if not parts:
            return
        sizes = np.array([len(x[0]) for x in parts])
        strings = sizes - length + 1
        base = np.cumsum(sizes) - sizes
        head = np.cumsum(strings) - strings
        inside = np.arange(strings.sum()) - np.repeat(head, strings)
        did, th, s0 = (np.repeat(np.array([x[k] for x in parts], np.int64), strings) for k in (1, 2, 3))
        by_place = np.lexsort((s0 + inside, th, did))
        starts = (np.repeat(base, strings) + inside)[by_place]
        text = b"".join(x[0] for x in parts).decode("latin-1")
        order, lcp = suffix_order(text, starts.tolist(), length)
        earlier = longest_previous(order, lcp) >= length
        later = longest_previous(-order, lcp) >= length
        state = np.zeros(len(order), np.int8)
        state[by_place[order]] = np.where(earlier, 2, np.where(later, 1, 0))
        for x, a, n in zip(parts, head.tolist(), strings.tolist()):
            got = [{"a": x[3] + i, "b": x[3] + j, "earlier": e} for i, j, e in ranges(state[a : a + n])]
            if got:
                out.append((x[1], x[2], got))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[list] = []
        size, key, last = 0, None, None
        out: list[tuple] = []

        def emit() -> pa.RecordBatch:
            got = pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*out))), schema=schema)
            out.clear()
            return got

        for batch in slices(batches):
            for k, *row in zip(*(batch.column(c).to_pylist() for c in ("k", "seg", "did", "th", "s0"))):
                if k != key:
                    if size > block_bytes:
                        solve(block, out)
                        block, size = [], 0
                    key, last = k, None
                if row == last:  # equal rows of the documents
                    continue
                last = row
                block.append(row)
                size += len(row[0])
            if len(out) > 10000:
                yield emit()
        solve(block, out)
        if out:
            yield emit()

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """(did, th, t): a key for each different row, null ids included, and the text's bytes."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("did"),
        F.xxhash64("text").alias("th"),
        F.coalesce(utf8(), F.lit(b"")).alias("t"),
    )


def _told(pieces: DataFrame, twice: DataFrame) -> DataFrame:
    """Ranges of the segments that come more than once; the first place is no later copy."""
    firsts = twice.select(F.col("k").alias("_k"), F.col("sh").alias("_sh"), "first")
    met = pieces.join(firsts, (F.col("k") == F.col("_k")) & (F.col("sh") == F.col("_sh")))
    starts = F.concat(F.array("s0"), F.coalesce("more", F.array().cast("array<int>")))
    stands = (F.col("did") == F.col("first.did")) & (F.col("th") == F.col("first.th"))
    one = lambda s: F.struct(
        s.alias("a"), (s + F.shiftright("w", 16)).alias("b"), (~(stands & (s == F.col("first.s0")))).alias("earlier")
    )
    return met.select("did", "th", F.transform(starts, one).alias("ranges"))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int | None = None) -> DataFrame:
    """(did, th, ranges), ranges of starts (a, b, earlier) whose string of ``length`` bytes also starts
    elsewhere; earlier: also at a smaller (doc_id, hash of the text, start), null ids first.

    One row per document that has any.  Rows that agree in doc_id and text are one place: each
    repeats the other, none is earlier.
    """
    rows = _keyed(docs)
    return _ranges(rows, _small(rows), length, gram)


def _small(rows: DataFrame) -> DataFrame:
    return map_rows(rows, _small_rows, "did long, th long, n int, z binary")


def _ranges(rows: DataFrame, small: DataFrame, length: int, gram: int | None) -> DataFrame:
    if length > 32000:
        raise ValueError("strings of at most 32000 bytes")
    spark = rows.sparkSession
    gram = gram or max(1, length // 5)
    work = Scratch(spark, "repeats")
    schema = "did long, th long, s0 int, w int, k long, sh long, more array<int>"
    found = map_rows(rows.filter(F.octet_length("t") >= length), _anchor_rows, schema, length, gram)
    places = F.sum(1 + F.coalesce(F.array_size("more"), F.lit(0)))
    again = found.groupBy(F.col("k").alias("_k")).agg(places.alias("_n"))
    shared = found.join(again.filter("_n > 1"), F.col("k") == F.col("_k")).select(*found.columns)
    pieces, left = work.save(shared, "pieces")
    told = []
    match_schema = "did long not null, th long not null, ranges array<struct<a: int, b: int, earlier: boolean>>"
    out = arrow_schema(spark, match_schema)
    for level in range(len(PARTS) + 1):
        if not left and level:
            break
        kinds, _ = work.save(pieces.groupBy("k", "sh").agg(places.alias("n"), F.min(F.struct("did", "th", "s0", "w")).alias("first")), f"kinds{level}")
        told.append(_told(pieces, kinds.filter("n > 1")))
        by_key = kinds.groupBy(F.col("k").alias("_k")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        many = kinds.join(by_key, F.col("k") == F.col("_k")).select("k", "first.*", (F.col("_n") > CROWD).alias("crowd"))
        _, seen = work.write(many, f"many{level}", crowded=F.sum(F.col("crowd").cast("long")))
        many = work.read(f"many{level}", many.schema)

        def runs(some: DataFrame) -> DataFrame:
            return some.groupBy("did", "th").agg(F.collect_list(F.struct("s0", "w", "k")).alias("runs"))

        segments = map_rows(small.join(runs(many.filter("not crowd")), ["did", "th"]), _segment_rows, "k long, did long, th long, s0 int, seg binary", length)
        met = segments.repartition("k").sortWithinPartitions("k", "did", "th", "s0")
        told.append(met.mapInArrow(_match(length, BLOCK_BYTES, out), match_schema))
        left = seen["crowded"]
        if left:
            # stored, so that Spark knows its size: a small one goes to the texts, not the texts to it
            crowded = work.cut(runs(many.filter("crowd")), f"crowded{level}")
            parts = map_rows(small.join(crowded, ["did", "th"]), _part_rows, schema, length, min(PARTS[level], length))
            pieces = work.cut(parts, f"parts{level}")
    whole = reduce(DataFrame.union, told)
    return whole.groupBy("did", "th").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def spans(ranges: list[dict] | None, length: int, later_only: bool) -> list[tuple[int, int]]:
    """Merged byte spans that the strings starting in ``ranges`` cover."""
    out: list[tuple[int, int]] = []
    wanted = (r for r in (() if ranges is None else ranges) if r["earlier"] or not later_only)
    for a, b in sorted((int(r["a"]), int(r["b"]) + length) for r in wanted):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_out(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in gone:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def whole_characters(text: bytes, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the bytes of characters that they hold only a part of."""
    out = []
    for a, b in gone:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b < len(text) and b > a and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def repeats(docs: DataFrame, length: int = LENGTH, later_only: bool = False, gram: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every document: the bytes covered by strings of
    ``length`` bytes that also start elsewhere (later_only: earlier), and what is left.

    Matches lie inside one document; a null text is an empty one and has none, nor has a text
    shorter than ``length``.  An empty table gives no rows.
    """
    rows = _keyed(docs)
    small = _small(rows)
    by_doc = _ranges(rows, small, length, gram)

    def finish(cols: dict) -> dict:
        texts, found = list(_texts(cols)), cols["ranges"].to_pylist()
        gone = [spans(r, length, later_only) for r in found]
        return {
            "doc_id": [None if d == -(2**63) else d for d in cols["did"].to_pylist()],
            "n_bytes": [len(t) for t in texts],
            "spans": [[{"start": a, "stop": b} for a, b in g] for g in gone],
            "kept": [cut_out(t, g) for t, g in zip(texts, gone)],
        }

    schema = "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary"
    return map_rows(small.join(by_doc, ["did", "th"], "left"), finish, schema)


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All documents and columns; of passages of ``length`` bytes and more the first stays.

    Later copies leave the text as far as they are whole characters; n_chars, where there is
    such a column, follows.  Null texts stay null.
    """
    by_doc = repeated_ranges(docs, length)
    marked = docs.withColumns(
        {
            "_did": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))),
            "_th": F.xxhash64("text"),
        }
    ).withColumnRenamed("text", "_text")
    by_doc = by_doc.withColumnsRenamed({"did": "_did", "th": "_th", "ranges": "_ranges"})
    joined = marked.join(by_doc, ["_did", "_th"], "left")

    @F.arrow_udf("string")
    def left(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, r in zip(texts.to_pylist(), found.to_pylist()):
            if t is None or r is None:
                out.append(t)
                continue
            raw = t.encode()
            out.append(cut_out(raw, whole_characters(raw, spans(r, length, True))).decode())
        return pa.array(out, pa.string())

    ship(docs.sparkSession)
    new = joined.withColumn("text", left("_text", "_ranges"))
    if "n_chars" in docs.columns:
        changed = F.col("_ranges").isNotNull()
        new = new.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return new.select(*docs.columns)


def op10_repeats(spark, sf_dir: str) -> DataFrame:
    found = repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP10_SQL = """
with d as (
  select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x from documents
), s as (
  select r, i, md5(substr(x, 2 * i + 1, 400)) as k from (select r, x, unnest(range(0, length(x) // 2 - 199)) as i from d)
), hit as (
  select r, i from s where k in (select k from s group by k having count(*) > 1)
), island as (
  select r, i, sum(case when i > p + 200 then 1 else 0 end) over (partition by r order by i) as g
  from (select r, i, lag(i, 1, -1000) over (partition by r order by i) as p from hit)
), span as (
  select r, min(i) as a, max(i) + 200 as b from island group by r, g
), gone as (
  select r, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' order by a) as head, max(b) as stop, sum(b - a) as removed, count(*) as n
  from (select *, lag(b, 1, 0) over (partition by r order by a) as p from span) join d using (r) group by r
)
select doc_id, cast(length(x) // 2 as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed,
  cast(coalesce(n, 0) as bigint) as n_spans, sha256(unhex(coalesce(head || substr(x, 2 * stop + 1), x))) as kept_sha256
from d left join gone using (r)
"""
