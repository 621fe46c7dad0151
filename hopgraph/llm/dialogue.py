"""Repair of conversations by cheapest edits: a Viterbi search that runs in parallel chunks.

Kept roles must read ``(s?(ua)+)?``.  Four states tell what was put out so far: nothing, only a
system turn, a user turn last, an assistant turn last.  The cost to go from a state before a row
is a minimum over the row's edits, so the costs to go before a row are a (min, +) linear function
of those behind it.

1. Rows are numbered in order over the whole table; a chunk is the share of a conversation in
   ``CHUNK`` consecutive numbers, one byte a row.  However long a conversation, no task holds more.
2. Every chunk runs backwards from a cost vector.  The last chunk of a conversation knows it, the
   others speculate that all states cost the same.
3. Fix-up passes: a chunk whose successor begins with a vector that differs from the assumed one
   by more than a constant runs again from that.  When none is left, all vectors are right up
   to a constant (rank convergence); the constants add up to the conversation's cost.
4. Tracing: with the right vector behind it a chunk follows, from each state, the edits that cost
   what the costs to go say, of equal ones the least initial.  The state where a chunk begins is
   passed on until every chunk has one; most chunks end in the same state from wherever they begin.

An audit (the edits' initials) settles the roles put out, so that equal costs with equal audits
are the same repair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopgraph.llm.common import arrow_schema, map_rows, ship, slices, table
from hopgraph.plans.numbering import number_rows
from hopgraph.plans.scratch import Scratch

#: Consecutive row numbers whose rows of one conversation are one chunk.
CHUNK = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Cost to go at the end from nothing, system, user, assistant: insert what is missing.
END = (0, 2 * INSERT, INSERT, 0)

#: States: nothing put out, only a system turn, user turn last, assistant turn last.
_TO_USER = (2, 2, None, 2)
_TO_ASSISTANT = (None, None, 3, None)
_TO_SYSTEM = (1, None, None, None)
_BY_INITIAL = (_TO_SYSTEM, _TO_USER, _TO_ASSISTANT, (None,) * 4)
_NEXT = (2, 2, 3, 2)  # state behind an insertion

#: What words are not made of.
_SPACE = " \t\n\x0b\x0c\r"


def _edges(code: int) -> list[list[tuple[str, int, int]]]:
    """By state the edits of a row, (initial, cost, state behind), the least initial first.

    A code is the role's initial (0 s, 1 u, 2 a, 3 other) plus 4 if the row has to go, plus 8 if
    it is truncated.
    """
    out = []
    more = TRUNCATED if code & 8 else 0
    for state in range(4):
        found = [("D", DELETE, state)]
        if not code & 4:
            kept = _BY_INITIAL[code & 3][state]
            if kept is not None:
                found.append(("K", KEEP + more, kept))
            found.append(("R", REROLE + more, _NEXT[state]))
        out.append(found)
    return out


_EDGES = [_edges(code) for code in range(16)]


def _before(code: int, behind: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before a row from those behind it, insertions in front of it included."""
    a, b, c, d = (min(cost + behind[to] for _, cost, to in edges) for edges in _EDGES[code])
    c, d = min(c, INSERT + d), min(d, INSERT + c)
    return min(a, INSERT + c), min(b, INSERT + c), c, d


def _level(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """The vector with its first cost at 0, and that cost."""
    return tuple(x - costs[0] for x in costs), costs[0]


def backward(codes: bytes, behind: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Costs to go before each row, and last those behind all of them."""
    out = [behind]
    for code in reversed(codes):
        out.append(_before(code, out[-1]))
    out.reverse()
    return out


def trace(codes: bytes, costs: list[tuple[int, ...]], state: int, last: bool) -> tuple[str, int]:
    """(audit, state behind) of the cheapest edits from ``state`` on, the least audit of equal ones."""
    out = []
    for i, code in enumerate(codes):
        while True:
            best = costs[i][state]
            edits = [(e, to) for e, cost, to in _EDGES[code][state] if cost + costs[i + 1][to] == best]
            inserts = INSERT + costs[i][_NEXT[state]] == best
            if edits and not (inserts and edits[0][0] > "I"):
                break
            out.append("I")
            state = _NEXT[state]
        out.append(edits[0][0])
        state = edits[0][1]
    while last and END[state]:
        out.append("I")
        state = _NEXT[state]
    return "".join(out), state


def _run_back(cols: dict) -> dict:
    """The chunks' first vectors (levelled) and their constants, from the vectors assumed behind."""
    front, shift = [], []
    for codes, behind in zip(cols["codes"].to_pylist(), cols["behind"].to_pylist()):
        v = tuple(behind)
        for code in reversed(codes):
            v = _before(code, v)
        v, c = _level(v)
        front.append(list(v))
        shift.append(c)
    return {"g": cols["g"], "k": cols["k"], "behind": cols["behind"], "front": front, "shift": shift}


def _trace_all(cols: dict) -> dict:
    """What every chunk does from each of the four states."""
    audits, ends = [], []
    for codes, behind, last in zip(*(cols[c].to_pylist() for c in ("codes", "behind", "last"))):
        costs = backward(codes, tuple(behind))
        found = [trace(codes, costs, s, last) for s in range(4)]
        audits.append([a for a, _ in found])
        ends.append([s for _, s in found])
    return {"g": cols["g"], "k": cols["k"], "audits": audits, "ends": ends}


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _unroll(cols: dict) -> dict:
    """One row per edit: number of the row (for an insertion the row behind it), order, initial, role."""
    out: dict[str, list] = {k: [] for k in ("g", "rn", "step", "edit", "to")}
    for g, first, codes, audit, state in zip(*(cols[c].to_pylist() for c in ("g", "first", "codes", "audit", "state"))):
        at = step = 0
        for edit in audit:
            step += 1
            to = None
            if edit == "D":
                row, at = at, at + 1
            else:
                if edit == "K":
                    state, row, at = _BY_INITIAL[codes[at] & 3][state], at, at + 1
                else:
                    state = _NEXT[state]
                    to = "user" if state == 2 else "assistant"
                    row = at
                    at += edit == "R"
            for k, v in zip(out, (g, first + row, step, edit, to)):
                out[k].append(v)
    return out


class Repair:
    """Faults and cheapest repair of the conversations of ``rows`` (conv_id, turn, role, text).

    Rows of a conversation are taken by turn, nulls first; rows of the same turn by role and text,
    and equal rows side by side.  A null role or text is one space.  A null conv_id is a
    conversation like any other.  Other columns are not looked at; an empty table gives no rows.

    ``rows`` are numbered rows with their faults, ``report`` one row per conversation, ``edits``
    one row per edit.
    """

    def __init__(self, rows: DataFrame, chunk: int = CHUNK):
        spark = rows.sparkSession
        self.chunk = chunk
        self.work = Scratch(spark, "dialogue")
        plain = rows.select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        )
        tie = F.md5(F.concat("role", F.lit(":"), "text").cast("binary"))
        order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("_tie")]
        self.numbered = self.work.cut(number_rows(plain.withColumn("_tie", tie), *order).drop("_tie"), "numbered")
        self._mark()
        self._converge()
        self._trace()

    def _mark(self) -> None:
        """Each row's first fault, and the chunks."""
        seen = self.numbered.groupBy("conv_id", "role", F.octet_length("text").alias("_n"), F.md5(F.col("text").cast("binary")).alias("_h"))
        firsts = seen.agg(F.min("rn").alias("_first")).select("_first")
        initial = F.substring("role", 1, 1)
        code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
        solid = F.rtrim("text", F.lit(_SPACE))
        rows = self.numbered.select(
            F.col("conv_id").alias("g"), "rn", "turn", code.alias("code"),
            F.when(solid == "", "blank").when(~F.substring(solid, -1, 1).isin(".", "!", "?"), "truncated").alias("fault"),
        )
        again = F.col("_first").isNull() & ~F.col("fault").eqNullSafe(F.lit("blank"))
        told = rows.join(firsts, F.col("rn") == F.col("_first"), "left").withColumn(
            "fault", F.when(again, "duplicate").otherwise(F.col("fault"))
        )
        byte = F.col("code") + F.when(F.col("fault").isin("blank", "duplicate"), 4).when(F.col("fault") == "truncated", 8).otherwise(0)
        self.rows = self.work.cut(told.select("g", "rn", "turn", "fault", byte.alias("code")), "rows")
        k = F.expr(f"rn div {self.chunk}")
        held = self.rows.groupBy("g", k.alias("k")).agg(
            F.array_sort(F.collect_list(F.struct("rn", "code"))).alias("items")  # at most a chunk
        )

        def pack(cols: dict) -> dict:
            items = cols["items"].to_pylist()
            codes = [bytes(x["code"] for x in i) for i in items]
            return {"g": cols["g"], "k": cols["k"], "first": [i[0]["rn"] for i in items], "codes": codes}

        chunks = map_rows(held, pack, "g long, k long, first long, codes binary")
        chunks = self.work.cut(chunks, "packed")
        near = chunks.select(F.col("g").alias("g2"), F.col("k").alias("k2"))
        behind = chunks.join(near.withColumn("k2", F.col("k2") - 1), _same(F.col("g"), F.col("g2")) & (F.col("k") == F.col("k2")), "left")
        behind = behind.withColumn("last", F.col("k2").isNull()).drop("g2", "k2")
        ahead = behind.join(near.withColumn("k2", F.col("k2") + 1), _same(F.col("g"), F.col("g2")) & (F.col("k") == F.col("k2")), "left")
        self.chunks = self.work.cut(ahead.withColumn("begins", F.col("k2").isNull()).drop("g2", "k2"), "chunks")

    def _converge(self) -> None:
        """``vectors`` (g, k, behind, front, shift), right up to a constant; ``passes`` it took."""
        end, flat = F.array(*[F.lit(x) for x in END]), F.array(*[F.lit(0)] * 4)
        todo = self.chunks.withColumn("behind", F.when(F.col("last"), end).otherwise(flat).cast("array<int>"))
        schema = "g long, k long, behind array<int>, front array<int>, shift long"
        vectors = self.work.cut(map_rows(todo, _run_back, schema), "v0")
        self.passes = 1
        while True:
            after = vectors.select(F.col("g").alias("g2"), (F.col("k") - 1).alias("k2"), F.col("front").alias("real"))
            wrong = vectors.join(after, _same(F.col("g"), F.col("g2")) & (F.col("k") == F.col("k2")) & (F.col("behind") != F.col("real")))
            wrong, n = self.work.save(wrong.select("g", "k", "real"), f"wrong{self.passes}")
            if not n:
                break
            keyed = wrong.select(F.col("g").alias("g2"), F.col("k").alias("k2"), F.col("real").alias("behind"))
            here = _same(F.col("g"), F.col("g2")) & (F.col("k") == F.col("k2"))
            again = self.chunks.join(keyed, here).drop("g2", "k2")
            kept = vectors.join(keyed.drop("behind"), here, "left_anti")
            vectors = self.work.cut(kept.unionByName(map_rows(again, _run_back, schema)), f"v{self.passes}")
            self.passes += 1
        self.vectors = vectors

    def _trace(self) -> None:
        """``traced`` (g, k, first, codes, state, audit) of every chunk."""
        here = _same(F.col("g"), F.col("g2")) & (F.col("k") == F.col("k2"))
        behind = self.vectors.select(F.col("g").alias("g2"), F.col("k").alias("k2"), "behind")
        maps = self.work.cut(
            map_rows(self.chunks.join(behind, here).drop("g2", "k2"), _trace_all, "g long, k long, audits array<string>, ends array<int>"), "maps"
        )
        one = F.array_max("ends") == F.array_min("ends")
        sure = maps.filter(one).select("g", (F.col("k") + 1).alias("k"), F.col("ends")[0].alias("state"))
        begins = self.chunks.filter("begins").select("g", "k", F.lit(0).alias("state"))
        known = self.work.cut(begins.unionByName(sure), "known0")
        new, rounds = known, 0
        while True:  # chunks behind a chunk that does not forget where it began
            keyed = new.select(F.col("g").alias("g2"), F.col("k").alias("k2"), "state")
            passed = maps.filter(~one).join(keyed, here).select("g", (F.col("k") + 1).alias("k"), F.col("ends")[F.col("state")].alias("state"))
            rounds += 1
            new, n = self.work.save(passed, f"new{rounds}")
            if not n:
                break
            known = known.unionByName(new)
        keyed = known.select(F.col("g").alias("g2"), F.col("k").alias("k2"), "state")
        told = maps.join(keyed, here).select("g", "k", "state", F.col("audits")[F.col("state")].alias("audit"))
        told = told.withColumnsRenamed({"g": "g2", "k": "k2"})
        self.traced = self.work.cut(self.chunks.join(told, here).drop("g2", "k2"), "traced")

    def edits(self) -> DataFrame:
        """(conv_id, rn, step, edit, role, text): the edits of every conversation in order.

        edit is D, I, K or R; role and text are those put out, null for D.  rn orders over
        the whole table and step inside it.
        """
        one = map_rows(self.traced, _unroll, "g long, rn long, step int, edit string, to string")
        rows = self.numbered.select(F.col("rn").alias("_rn"), "role", "text")
        met = one.join(rows, F.col("rn") == F.col("_rn"), "left")
        gone, new = F.col("edit") == "D", F.col("edit") == "I"
        return met.select(
            F.col("g").alias("conv_id"), "rn", "step", "edit",
            F.when(~gone, F.coalesce("to", "role")).alias("role"),
            F.when(new, "").when(~gone, F.col("text")).alias("text"),
        )

    def report(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost) of every conversation with rows."""
        turns = self.rows.groupBy("g", "turn").agg(F.count(F.lit(1)).alias("_n")).groupBy("g").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
        )
        faults = self.rows.groupBy("g").agg(
            *[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")]
        )
        cost = self.vectors.select("g", F.col("shift").alias("cost"))
        ends = self.work.cut(map_rows(self.chunks, _pairs, "g long, k long, illegal long, head int, tail int"))
        inside = ends.select("g", "illegal")
        after = ends.select(F.col("g").alias("g2"), (F.col("k") - 1).alias("k2"), F.col("head").alias("next"))
        met = ends.join(after, _same(F.col("g"), F.col("g2")) & (F.col("k") == F.col("k2")))
        pair = F.concat(F.col("tail").cast("string"), F.col("next").cast("string"))
        across = met.select("g", (~pair.isin("01", "12", "21")).cast("long").alias("illegal"))
        names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
        parts = (turns, faults, cost, inside, across)
        rows = [p.select("g", *[(F.col(n) if n in p.columns else F.lit(0)).cast("long").alias(n) for n in names]) for p in parts]
        sums = reduce(DataFrame.union, rows).groupBy("g").agg(*[F.sum(n).alias(n) for n in names])
        return sums.withColumnRenamed("g", "conv_id")


def _pairs(cols: dict) -> dict:
    """Neighbours inside the chunks whose roles may not follow each other, and the roles at the ends."""
    roles = [[c & 3 for c in codes] for codes in cols["codes"].to_pylist()]
    bad = [sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(r, r[1:])) for r in roles]
    return {"g": cols["g"], "k": cols["k"], "illegal": bad, "head": [r[0] for r in roles], "tail": [r[-1] for r in roles]}


def digests(edits: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256): the edits' initials, and the digest of the ``role:text`` put out.

    A conversation's edits stream through one task in order, as a digest needs them; what is held
    is the digest and the audit.
    """
    ship(edits.sparkSession)
    schema = "conv_id long, audit string, repaired_sha256 string"
    ordered = edits.repartition("conv_id").sortWithinPartitions("conv_id", "rn", "step")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, digest, put = None, [], None, False
        out: dict[str, list] = {"conv_id": [], "audit": [], "repaired_sha256": []}

        def close() -> None:
            for k, v in zip(out, (key, "".join(audit), digest.hexdigest())):
                out[k].append(v)

        for batch in slices(batches):
            for conv, edit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text"))):
                if digest is None or conv != key:
                    if digest is not None:
                        close()
                    key, audit, digest, put = conv, [], hashlib.sha256(), False
                audit.append(edit)
                if edit != "D":
                    digest.update(f"{chr(10) * put}{role}:{text}".encode())
                    put = True
            if out["conv_id"]:
                yield pa.RecordBatch.from_pydict(out, schema=types)
                out = {k: [] for k in out}
        if digest is not None:
            close()
            yield pa.RecordBatch.from_pydict(out, schema=types)

    types = arrow_schema(edits.sparkSession, schema)
    return ordered.select("conv_id", "edit", "role", "text").mapInArrow(run, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with the query's damage by crc32(``conv_id:turn``) % 20; a null is one space."""
    known = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    name = F.concat(known[0], F.lit(":"), known[1])
    n = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    text = F.when(n == 1, "").when(n == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(n == 4, "user").otherwise(role)
    copies = F.when(n == 0, 0).when(n == 3, 2).otherwise(1)
    new = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copies"))
    return new.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).drop("col")


def op13_repair(spark, sf_dir: str) -> DataFrame:
    """Faults, least audit and digest of the repair of every conversation, after the query's damage.

    Conversations that lose all rows have zeros, an empty audit and the digest of nothing.
    """
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    fixed = Repair(damaged(rows))
    report = fixed.report().withColumnRenamed("conv_id", "c1")
    digest = digests(fixed.edits()).withColumnRenamed("conv_id", "c2")
    found = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n"))
    found = found.join(report, _same(F.col("conv_id"), F.col("c1")), "left").join(digest, _same(F.col("conv_id"), F.col("c2")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


OP13_SQL = r"""
with recursive step8(i, k, c) as (
  select i, 0, i from range(256) q(i)
  union all
  select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from step8 where k < 8
), remainders as (
  select list(c order by i) as t from step8 where k = 8
), named as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations
), chosen as (
  select named.*, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(name)), '..'), lambda h: cast('0x' || h as bigint))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 as n
  from named, remainders
), hurt as (
  select conv_id, turn, case when n = 4 then 'user' else role end as role,
    case when n = 1 then '' when n = 2 then translate(text, '.!?', '') else text end as text,
    unnest(range(case when n = 0 then 0 when n = 3 then 2 else 1 end)) as copy
  from chosen
), numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, md5(role || ':' || text), copy) as i,
    count(*) over (partition by conv_id) as n, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as solid
  from hurt
), told as (
  select *, case when solid = '' then 'b' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd'
      when right(solid, 1) not in ('.', '!', '?') then 't' else '' end as fault,
    left(role, 1) as c, lag(left(role, 1)) over (partition by conv_id order by i) as p
  from numbered
), counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank,
    count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
    count(*) filter (i > 1 and p || c not in ('su', 'ua', 'au')) as illegal, max(n) as n
  from told group by conv_id
), walk as (
  select conv_id, n as i, {'c': 0, 'a': '', 'r': ''} as s0, {'c': 10, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'} as s1,
    {'c': 5, 'a': 'I', 'r': chr(10) || 'assistant:'} as s2, {'c': 0, 'a': '', 'r': ''} as s3
  from counts
  union all
  select conv_id, i, list_min([r0, {'c': i2.c + 5, 'a': 'I' || i2.a, 'r': chr(10) || 'user:' || i2.r}]),
    list_min([r1, {'c': i2.c + 5, 'a': 'I' || i2.a, 'r': chr(10) || 'user:' || i2.r}]), i2, i3
  from (
    select conv_id, i, r0, r1, list_min([r2, {'c': r3.c + 5, 'a': 'I' || r3.a, 'r': chr(10) || 'assistant:' || r3.r}]) as i2,
      list_min([r3, {'c': r2.c + 5, 'a': 'I' || r2.a, 'r': chr(10) || 'user:' || r2.r}]) as i3
    from (
      select w.conv_id, w.i - 1 as i,
        list_min([{'c': s0.c + 2, 'a': 'D' || s0.a, 'r': s0.r}, {'c': s2.c + 1 + x, 'a': 'R' || s2.a, 'r': chr(10) || 'user:' || text || s2.r},
          case c when 's' then {'c': s1.c + x, 'a': 'K' || s1.a, 'r': chr(10) || role || ':' || text || s1.r}
            when 'u' then {'c': s2.c + x, 'a': 'K' || s2.a, 'r': chr(10) || role || ':' || text || s2.r} end]) as r0,
        list_min([{'c': s1.c + 2, 'a': 'D' || s1.a, 'r': s1.r}, {'c': s2.c + 1 + x, 'a': 'R' || s2.a, 'r': chr(10) || 'user:' || text || s2.r},
          case c when 'u' then {'c': s2.c + x, 'a': 'K' || s2.a, 'r': chr(10) || role || ':' || text || s2.r} end]) as r1,
        list_min([{'c': s2.c + 2, 'a': 'D' || s2.a, 'r': s2.r}, {'c': s3.c + 1 + x, 'a': 'R' || s3.a, 'r': chr(10) || 'assistant:' || text || s3.r},
          case c when 'a' then {'c': s3.c + x, 'a': 'K' || s3.a, 'r': chr(10) || role || ':' || text || s3.r} end]) as r2,
        list_min([{'c': s3.c + 2, 'a': 'D' || s3.a, 'r': s3.r}, {'c': s2.c + 1 + x, 'a': 'R' || s2.a, 'r': chr(10) || 'user:' || text || s2.r},
          case c when 'u' then {'c': s2.c + x, 'a': 'K' || s2.a, 'r': chr(10) || role || ':' || text || s2.r} end]) as r3
      from walk w join (select *, case fault when 'b' then 1000000 when 'd' then 1000000 when 't' then 5 else 0 end as x from told) t
        on t.conv_id is not distinct from w.conv_id and t.i = w.i
    ) a
  ) b
), ends as (
  select conv_id, s0 from walk where i = 0
)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, cast(coalesce(s0.c, 0) as bigint) as cost, coalesce(s0.a, '') as audit, sha256(coalesce(s0.r[2:], '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts on counts.conv_id is not distinct from o.conv_id
  left join ends on ends.conv_id is not distinct from o.conv_id
"""
