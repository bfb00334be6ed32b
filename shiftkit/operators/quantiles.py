"""Exact grouped quantiles by one path whatever the size of a group.

Equal values are counted first (with map-side combine), so a value that half of the rows share is
one row; the counts become ranks by a distributed running total, and only the rows that hold a
wanted rank are read. No task holds a whole group.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftkit.operators.positional import running_total


def _names(probs, names):
    if names is None:
        return [f"q{str(p).replace('.', '_')}" for p in probs]
    if len(names) != len(probs):
        raise ValueError("one name per probability")
    return list(names)


def group_quantiles(df: DataFrame, value: str, by: Sequence[str], probs: Sequence[float],
                    names: Sequence[str] | None = None, method: str = "exact", accuracy: int = 200_000,
                    weight: str | None = None) -> DataFrame:
    """Quantiles of ``value`` per ``by`` group, one column per probability, a row for every group.

    The quantile is linearly interpolated (numpy's default); NULL values are left out, a group with
    only NULLs has NULL quantiles, and NULL is a group like any other. With ``weight`` a row counts
    that many times (whole numbers). ``method="approx"`` is the mergeable sketch instead: rank error
    at most n / ``accuracy``, one pass.
    """
    by, probs = list(by), [float(p) for p in probs]
    names = _names(probs, names)
    if method == "approx":
        agg = F.percentile_approx(F.col(value).cast("double"), probs, accuracy)
        out = (df.groupBy(*by) if by else df.groupBy()).agg(agg.alias("_q"))
        return out.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    if method != "exact":
        raise ValueError(f"unknown method {method!r}")
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    counts = df.select(*by, F.col(value).cast("double").alias("_x"), w.alias("_w")).groupBy(*by, "_x").agg(F.sum("_w").alias("_c"))
    # a NULL value keeps its group alive with a count of 0
    counts = counts.withColumn("_c", F.when(F.col("_x").isNull(), 0).otherwise(F.col("_c")))
    ranked = running_total(counts, ["_x"], by, F.col("_c"), "_start")
    totals = ranked.groupBy(*by).agg(F.sum("_c").alias("_n"))
    if by:
        right = totals.select(*[F.col(f"`{c}`").alias(f"_t{i}") for i, c in enumerate(by)], "_n")
        cond = F.lit(True)
        for i, c in enumerate(by):
            cond = cond & F.col(f"`{c}`").eqNullSafe(F.col(f"_t{i}"))
        ranked = ranked.join(right, cond)
    else:
        ranked = ranked.withColumn("_n", totals.select("_n").scalar())

    def at(rank):
        """The value that covers a rank."""
        return F.max(F.when((F.col("_c") > 0) & (F.col("_start") <= rank) & (rank < F.col("_start") + F.col("_c")), F.col("_x")))

    aggs = []
    for i, p in enumerate(probs):
        pos = F.lit(p) * (F.col("_n") - 1)
        aggs += [at(F.floor(pos)).alias(f"_lo{i}"), at(F.ceil(pos)).alias(f"_hi{i}"), F.max(pos - F.floor(pos)).alias(f"_f{i}")]
    g = (ranked.groupBy(*by) if by else ranked.groupBy()).agg(*aggs)
    return g.select(*by, *[
        (F.col(f"_lo{i}") + F.col(f"_f{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(n) for i, n in enumerate(names)])
