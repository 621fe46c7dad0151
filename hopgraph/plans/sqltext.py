"""SQL text for the side-by-side check: the same graphs and searches as CTEs."""

from __future__ import annotations

from hopgraph.functions.hashing import h_sql, wide_sql

_FROM_RAW = [
    "e as (select distinct least(src, dst) as a, greatest(src, dst) as b from raw where src <> dst)",
    "arcs as (select a as src, b as dst from e union all select b, a from e)",
    "nodes as (select src as id, count(*) as deg from arcs group by src)",
]

RAW = {
    "supply": ["raw as (select l_suppkey * 2 as src, l_partkey * 2 + 1 as dst from lineitem)"],
    "trade": [
        """succ as (
  select o_orderkey as src, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as dst from orders
  union all
  select o_orderkey, lead(o_orderkey) over (partition by c_nationkey, o_orderpriority order by o_orderdate, o_orderkey)
  from orders join customer on o_custkey = c_custkey)""",
        "raw as (select src, dst from succ where dst is not null)",
    ],
    "geo": [
        """raw as (
  select (n_regionkey * 4)::bigint as src, (n_nationkey * 4 + 1)::bigint as dst from nation
  union all select c_nationkey * 4 + 1, c_custkey * 4 + 2 from customer
  union all select s_nationkey * 4 + 1, s_suppkey * 4 + 3 from supplier)"""
    ],
    "follow": [
        "steps as (select user_id as src, lead(user_id) over (order by ts, event_id) as dst from events)",
        "raw as (select src, dst from steps where dst is not null)",
    ],
    "link": [
        """named as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as href from pages)""",
        "raw as (select page_id * 2 as src, (dense_rank() over (order by href)) * 2 + 1 as dst from named)",
    ],
}


def graph(name: str) -> list[str]:
    """CTEs ``raw, e, arcs, nodes`` of a graph."""
    return RAW[name] + _FROM_RAW


def top(k: int, name: str = "seeds") -> str:
    return f"{name} as (select id from nodes order by deg desc, id limit {k})"


def bfs(seeds: str = "seeds", name: str = "bfs", extra: str = "") -> str:
    """Distances with smallest parent and number of paths; key (k, id)."""
    return f"""{name}(k, id, d, parent, paths) using key (k, id) as (
  select id, id, 0, null::bigint, 1::bigint from {seeds}
  union
  select b.k, a.dst, b.d + 1, min(b.id), sum(b.paths)::bigint from {name} b join arcs a on a.src = b.id
  where not exists (select 1 from recurring.{name} r where r.k = b.k and r.id = a.dst) {extra}
  group by b.k, a.dst, b.d + 1)"""


def slots(pool: str, seed: int, name: str = "slots") -> str:
    return f"{name} as (select id, row_number() over (order by {h_sql('id', seed)}, id) - 1 as slot from {pool})"


def drawn(sources: str, pool: str, k: int, seed: int, name: str = "drawn") -> list[str]:
    """CTEs for ``k`` hashed partners; ``sources`` is a table with column ``id``."""
    s = f"{name}_slots"
    size = f"(select count(*) from {pool})"
    step = f"({size} // least({k}, {size}))"
    return [
        slots(pool, seed, s),
        f"""{name} as (
  select q.id as src, p.id as dst from {sources} q cross join range({k}) j(j)
  join {s} p on p.slot = ({wide_sql('q.id', seed + 1)} + j.j * {step}) % {size}
  where j.j < {size})""",
    ]


def query(ctes: list[str], body: str) -> str:
    return "with recursive " + ",\n".join(ctes) + "\n" + body
