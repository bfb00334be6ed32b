"""Deterministic pseudo-random numbers from keys.

Every sampling operator ranks or draws by ``md5(seed:key...)``; the same string hash exists in
SQL engines, so a sample is reproducible on any partitioning and checkable against SQL. The first
15 hex digits give an unsigned 60-bit integer, so draws reach every row of any table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

U60 = float(1 << 60)


def _parts(seed, cols) -> list[Column]:
    out = [F.lit(str(seed))]
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        out.append(c.cast("string"))
    return out


def hash_u60(seed, *cols) -> Column:
    """Unsigned 60-bit hash of ``seed:col1:col2...`` (bigint in [0, 2^60))."""
    h = F.md5(F.concat_ws(":", *_parts(seed, cols)))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")


def hash_uniform(seed, *cols) -> Column:
    """A uniform draw in [0, 1) from the key."""
    return hash_u60(seed, *cols) / F.lit(U60)


def sql_hash_u60(seed, *exprs: str) -> str:
    """The same hash as DuckDB SQL text (used by the oracle)."""
    inner = ", ".join([f"'{seed}'"] + [f"CAST({e} AS VARCHAR)" for e in exprs])
    return f"CAST(('0x' || substr(md5(concat_ws(':', {inner})), 1, 15)) AS BIGINT)"


def poisson1_cdf() -> list[float]:
    """CDF of Poisson(1) at 0, 1, ... up to the first value that rounds to 1, used to turn a uniform
    draw into a bootstrap weight (no uniform draw lies beyond it)."""
    out, p, acc, k = [], math.exp(-1.0), 0.0, 0
    while acc + p > acc and acc + p < 1.0:
        acc += p
        out.append(acc)
        k += 1
        p /= k
    return out


def poisson1_weight(u: Column) -> Column:
    """Inverse-CDF Poisson(1) weight of a uniform ``u``: the number of CDF steps at or below ``u``.

    ``u`` is computed once a weight, also inside another function's lambda, where Spark shares no subexpressions.
    """

    def steps(x: Column) -> Column:
        w = F.lit(0)
        for c in poisson1_cdf():
            w = w + F.when(x >= F.lit(c), 1).otherwise(0)
        return w

    return F.transform(F.array(u), steps)[0]


def sql_poisson1_weight(u: str) -> str:
    """The same weight as DuckDB SQL text (used by the oracle)."""
    return "(" + " + ".join(f"CASE WHEN {u} >= CAST('{c!r}' AS DOUBLE) THEN 1 ELSE 0 END" for c in poisson1_cdf()) + ")"
