"""Seeded integer hash with the same value in Spark and in ANSI SQL engines.

    y = ((x % P) * A + seed * B) % P
    h = (y * y) % P

Input must be a non-negative bigint; every intermediate stays below 2^62, so
ANSI overflow checks never fire.  Sampling operators order by ``(h(id), id)``
instead of calling ``rand()``, which makes each of them re-runnable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash (Mersenne prime 2^31 - 1, LCG multiplier, seed stride).
P = 2147483647
A = 1103515245
B = 12345


def _as_col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def h(x: Column | str, seed: int = 0) -> Column:
    """Hash of one bigint column."""
    y = ((_as_col(x).cast("bigint") % P) * A + F.lit(seed * B).cast("bigint")) % P
    return (y * y) % P


def h2(x: Column | str, y: Column | str, seed: int = 0) -> Column:
    """Hash of a pair of bigint columns."""
    return h(h(x, seed) + _as_col(y).cast("bigint"), seed + 1)


def wide(x: Column | str, seed: int = 0) -> Column:
    """Two hashes as one number below 2^62, for draws from pools beyond 2^31 members."""
    return h(x, seed) * P + h(x, seed + 101)


def wide_sql(x: str, seed: int = 0) -> str:
    return f"({h_sql(x, seed)} * {P} + {h_sql(x, seed + 101)})"


def h_sql(x: str, seed: int = 0) -> str:
    """The same hash as SQL text."""
    y = f"(((({x})::bigint % {P}) * {A} + {seed * B}) % {P})"
    return f"(({y} * {y}) % {P})"


def h2_sql(x: str, y: str, seed: int = 0) -> str:
    return h_sql(f"{h_sql(x, seed)} + ({y})", seed + 1)


def unit(x: Column) -> Column:
    """Map a hash value to the open interval (0, 1)."""
    return (x + F.lit(0.5)) / F.lit(float(P))


def draw(seed: int, *cols: Column | str) -> Column:
    """Uniform in (0, 1) from any columns; Spark-only, used by the walkers."""
    x = F.xxhash64(F.lit(seed), *[_as_col(c) for c in cols])
    return (F.pmod(x, F.lit(1 << 40)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 40))
