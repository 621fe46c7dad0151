"""Merkle manifest of a data set: checkpoint and recompute.

The leaves of a tree stand in order; eight consecutive nodes (the last run may be shorter) become
the hash of their hex digests put together, until one node is left.  Only every ``LEVELS``-th level
is stored.  An aligned subtree, the up to 8^LEVELS nodes of a stored level below one node of the
next stored level, is one row: building folds it to its top, and extracting proofs regenerates its
missing interior nodes from the stored descendants, emits every descendant's siblings and keeps
none of them.  Paths come from the top down, so that a subtree meets the path above it once.

The trees of several keys (one for each lang) are built at the same time; their roots are the
leaves of one more tree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopgraph.llm.common import table
from hopgraph.plans.scratch import Scratch

FANOUT = 8
#: Levels of a subtree between two stored ones.
LEVELS = 3

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def row_hash(fields: list[Column]) -> Column:
    """Hex sha256 of the fields in order: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(
        F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256
    )


def _join(nodes: Column) -> Column:
    return F.concat_ws("", nodes)


def _hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _parents(nodes: Column) -> Column:
    """The hashes of the runs of ``FANOUT`` nodes; a shorter last run counts, one node too."""
    last = F.floor((F.size(nodes) - 1) / FANOUT).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: _hash(_join(F.slice(nodes, i * FANOUT + 1, FANOUT))))


def _steps(n: Column) -> Column:
    """Levels that are folded inside a subtree of a level of ``n`` nodes: none if one node is left."""
    steps = F.lit(0)
    for k in range(LEVELS):
        steps = steps + (n > FANOUT**k).cast("int")
    return steps


def ordered(rows: DataFrame, key: list[str], order: list[str], work: Scratch) -> DataFrame:
    """Add ``at``, gapless from 0 inside each key by ``order`` (nulls first), and ``n``, the key's rows.

    Rows are range partitioned by key and order and stored; a place is the place inside the
    partition's share of the key plus the shares before it.  No task sorts a whole key, and the
    table of shares has one row per key and partition that holds some of it.
    """
    by = [F.col(c).asc_nulls_first() for c in [*key, *order]]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_mono", F.monotonically_increasing_id())
    placed = work.cut(placed, "placed").withColumn("_part", F.shiftright("_mono", 33).cast("int"))
    shares = placed.groupBy("_part", *key).agg(F.count(F.lit(1)).alias("_c"), F.min("_mono").alias("_m"))
    keys = ", ".join(key) or "0"
    shares = shares.selectExpr(
        "_part as _p",
        *[f"{k} as _k{i}" for i, k in enumerate(key)],
        f"sum(_c) over (partition by {keys} order by _part rows between unbounded preceding and current row) - _c - _m as _shift",
        f"sum(_c) over (partition by {keys}) as n",
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    joined = placed.join(shares, reduce(Column.__and__, same, F.col("_part") == F.col("_p")))
    return joined.withColumn("at", F.col("_mono") + F.col("_shift")).drop("_mono", "_part", "_p", "_shift", *[f"_k{i}" for i in range(len(key))])


class Forest:
    """Trees over ``leaves`` (key columns, at, n, h and others), by subtrees of stored levels.

    ``roots`` holds (key, h) of every tree, ``proofs`` the leaves with their paths.
    """

    def __init__(self, leaves: DataFrame, key: list[str], work: Scratch, name: str, most: int | None = None):
        self.key, self.work = key, work
        self.others = [c for c in leaves.columns if c not in (*key, "at", "n", "h")]
        self.levels = [self._store(leaves, self.others, f"{name}0")]
        most = self.levels[0].agg(F.max("n")).first()[0] if most is None else most
        while (most or 0) > 1:
            most = -(-most // FANOUT**LEVELS)
            self.levels.append(self._store(self._tops(self.levels[-1]), [], f"{name}{len(self.levels)}"))
        self.roots = self.levels[-1].select(*key, F.col("nodes")[0]["h"].alias("h"))

    def _store(self, nodes: DataFrame, others: list[str], name: str) -> DataFrame:
        """One row per subtree: its nodes of this level in order, at most 8^LEVELS."""
        size = FANOUT**LEVELS
        item = F.struct("at", "h", *others)
        grouped = nodes.groupBy(*self.key, F.expr(f"at div {size}").alias("up")).agg(
            F.array_sort(F.collect_list(item)).alias("nodes"), F.first("n").alias("n")
        )
        return self.work.cut(grouped, name)

    def _regenerate(self, level: DataFrame) -> DataFrame:
        """The level with its subtrees' interior nodes, l0 (the stored ones) to l<LEVELS>."""
        full = level.withColumn("l0", F.transform("nodes", lambda x: x["h"])).withColumn("steps", _steps(F.col("n")))
        for k in range(LEVELS):
            here = F.when(F.col("steps") > k, _parents(F.col(f"l{k}"))).otherwise(F.col(f"l{k}"))
            full = full.withColumn(f"l{k + 1}", here)
        return full

    def _tops(self, level: DataFrame) -> DataFrame:
        n = F.ceil(F.col("n") / FANOUT**LEVELS).cast("long")
        return self._regenerate(level).select(*self.key, F.col("up").alias("at"), F.col(f"l{LEVELS}")[0].alias("h"), n.alias("n"))

    def _paths(self, level: DataFrame, above: DataFrame, others: list[str]) -> DataFrame:
        """Every node of the level with its siblings to the left and right, level by level upwards.

        ``above`` (key columns, up, path) has the path of the subtree's top.
        """

        def sides(k: int, at: Column) -> Column:
            nodes, own = F.col(f"l{k}"), F.floor(at / FANOUT**k).cast("int")
            first = F.floor(own / FANOUT).cast("int") * FANOUT
            left = _join(F.slice(nodes, first + 1, own - first))
            right = _join(F.slice(nodes, own + 2, first + (FANOUT - 1) - own))
            return F.struct(left.alias("l"), right.alias("r"))

        full = self._regenerate(level)
        right = above.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.key)], F.col("up").alias("_up"), "path")
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.key)]
        met = full.join(right, reduce(Column.__and__, same, F.col("up") == F.col("_up")))
        inside = lambda x, i: F.struct(
            *[x[c].alias(c) for c in ("at", "h", *others)],
            F.concat(F.slice(F.array(*[sides(k, i) for k in range(LEVELS)]), F.lit(1), F.col("steps")), F.col("path")).alias("path"),
        )
        return met.select(*self.key, F.inline(F.transform("nodes", inside)))

    def proofs(self, top: DataFrame) -> DataFrame:
        """The leaves with ``path``: (l, r) hex digests beside them at each level, up to and beyond
        their root.  ``top`` (key columns, path) has what follows a key's root."""
        above = top.withColumn("up", F.lit(0).cast("long"))
        for k in range(len(self.levels) - 1, 0, -1):
            # a tree that ends below this level has one node here, without siblings
            found = self._paths(self.levels[k], above, [])
            above = self.work.cut(found.select(*self.key, F.col("at").alias("up"), "path"))
        return self._paths(self.levels[0], above, self.others)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, p: _hash(F.concat(p["l"], h, p["r"])))


def manifest(rows: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(proofs, root) for rows with ``leaf`` (hex digest), a ``key`` that names the tree and an ``order``.

    proofs has the rows' columns, ``subroot``, ``root`` and ``path``; root is one row, none for an
    empty table.  Leaves ascend by ``order`` inside a key, nulls first, rows that agree in it by
    their leaf; rows that agree in all of it are told apart by place only.  A null key has a tree
    like any other, before the others.  Nothing is joined on texts.
    """
    work = Scratch(rows.sparkSession, "merkle")
    others = [c for c in rows.columns if c not in (key, "leaf")]
    leaves = ordered(rows.withColumnRenamed("leaf", "h"), [key], list(dict.fromkeys([order, "h"])), work)
    trees = Forest(leaves, [key], work, "level")
    count = trees.roots.count()
    roots = ordered(trees.roots, [], [key, "h"], Scratch(rows.sparkSession, "merkle"))
    crown = Forest(roots, [], Scratch(rows.sparkSession, "merkle"), "crown", count)
    root = crown.roots.select(F.col("h").alias("root"))
    top = root.first()
    none = rows.sparkSession.range(1).select(F.expr("cast(array() as array<struct<l: string, r: string>>)").alias("path"))
    above = crown.proofs(none).select(key, F.struct(F.col("h").alias("subroot"), "path").alias("top"))
    tops = above.select(key, F.col("top.path").alias("path"))
    found = trees.proofs(tops)
    named = above.select(F.col(key).alias("_key"), F.col("top.subroot").alias("subroot"))
    proofs = found.join(F.broadcast(named) if count <= 10_000 else named, F.col(key).eqNullSafe(F.col("_key")))
    one = F.lit(top.root if top else None).cast("string").alias("root")
    return proofs.select(key, *others, F.col("h").alias("leaf"), "subroot", one, "path"), root


def op12_manifest(spark, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document.

    Null fields are ``-``; repeated rows have a leaf each; null ids stand first in their tree and
    count as empty in the choice of tampered rows; an empty table gives no rows; only the named
    columns are hashed.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    lowered = F.translate(text, _UPPER, _UPPER.lower())
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    chosen = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    tampered = F.when(chosen & text.isNotNull() & (lowered != text), row_hash([*fields, lowered]))
    rows = docs.select("lang", "doc_id", row_hash([*fields, text]).alias("leaf"), tampered.alias("tampered"))
    proofs, _ = manifest(rows, "lang", "doc_id")
    beside = F.transform("path", lambda p: F.concat(p["l"], p["r"]))
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", _hash(_join(beside)).alias("proof_sha256"),
        fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


OP12_SQL = """
with recursive r as (
  select row_number() over () as rid, doc_id, lang,
    coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars, '-') as head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low
  from documents
), step8(i, k, c) as (
  select i, 0, i from range(256) q(i)
  union all
  select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from step8 where k < 8
), remainders as (
  select list(c order by i) as t from step8 where k = 8
), crc as (
  select rid, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::varchar, ''))), '..'), lambda h: cast('0x' || h as bigint))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as x
  from r, remainders
), leaf as (
  select rid, doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) as leaf,
    sha256(head || coalesce(octet_length(encode(low)) || ':' || low, '-')) as low, x % 3 = 0 as bad
  from r join crc using (rid)
), node as (
  select 0 as lvl, lang, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, leaf as h, count(*) over (partition by lang) as n, rid
  from leaf
), tree as (
  select lvl, lang, i, h, n from node
  union all
  select lvl + 1, lang, i // 8, sha256(string_agg(h, '' order by i)), any_value((n + 7) // 8) from tree where n > 1 group by lvl, lang, i // 8
), sub as (
  select lang, h, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n from tree where n = 1
), crown as (
  select 0 as lvl, i, h, n from sub
  union all
  select lvl + 1, i // 8, sha256(string_agg(h, '' order by i)), any_value((n + 7) // 8) from crown where n > 1 group by lvl, i // 8
), step as (
  select m.rid, t.lvl, coalesce(string_agg(t.h, '' order by t.i) filter (t.i < p.i), '') as l, coalesce(string_agg(t.h, '' order by t.i) filter (t.i > p.i), '') as r
  from node m join (select distinct lvl, lang, i from tree where n > 1) p on p.lang is not distinct from m.lang and p.i = m.i // (8 ** p.lvl)::bigint
  join tree t on t.lvl = p.lvl and t.lang is not distinct from m.lang and t.i // 8 = p.i // 8 group by m.rid, t.lvl
  union all
  select m.rid, 1000 + t.lvl, coalesce(string_agg(t.h, '' order by t.i) filter (t.i < p.i), ''), coalesce(string_agg(t.h, '' order by t.i) filter (t.i > p.i), '')
  from node m join sub s on s.lang is not distinct from m.lang join (select lvl, i from crown where n > 1) p on p.i = s.i // (8 ** p.lvl)::bigint
  join crown t on t.lvl = p.lvl and t.i // 8 = p.i // 8 group by m.rid, t.lvl
), path as (
  select rid, string_agg(l || r, '' order by lvl) as p, list(l order by lvl) as ls, list(r order by lvl) as rs from step group by rid
)
select doc_id, leaf, sub.h as subroot, top.h as root, sha256(coalesce(p, '')) as proof_sha256, f as folded_root, f = top.h as verified
from (
  select leaf.*, p, list_reduce([case when bad then low else leaf end] || list_transform(range(1, len(coalesce(ls, [])) + 1), lambda i: ls[i] || '|' || rs[i]),
    lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) as f
  from leaf left join path using (rid)
) x join sub on sub.lang is not distinct from x.lang cross join (select h from crown where n = 1) top
"""
