"""Mergeable summaries: sketch columns kept per chunk and merged later, without the rows.

A chunk's row holds a HyperLogLog sketch of a column's distinct values and a KLL sketch of a number's distribution (Spark's
DataSketches aggregates) with exact counts and ends. Rows of chunks merge in any order and grouping, so an incremental run
adds its chunks' rows to a table and a summary is one small aggregation of it.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes: 2^LG_K registers of the distinct sketch, K of the quantile sketch.
LG_K, K = 14, 800


def distinct_error(lg_k: int = LG_K, sigmas: float = 5.0) -> float:
    """The relative error a distinct count stays within, at so many standard errors of 1.04 / sqrt(2^lg_k)."""
    return sigmas * 1.04 / math.sqrt(2**lg_k)


def rank_error(k: int = K) -> float:
    """The error of a quantile's rank (as a share of the rows) that the sketch stays within, with a margin of 2 on
    its published 99 % bound 2.296 / k^0.9021."""
    return 2 * 2.296 / k**0.9021


def chunk_sketches(df: DataFrame, by: Sequence[str], distinct: str, value: str, lg_k: int = LG_K, k: int = K) -> DataFrame:
    """One row per group, also a chunk's: (by..., n_rows, n_values, min, max, ids, dist), the last two being sketches.

    NULLs are in no sketch and not in ``n_values``; NaN values count as NULL. A group of NULLs has empty sketches (NULL); NULL is a group.
    """
    x = F.col(value).cast("double")
    x = F.when(~F.isnan(x), x)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(x).alias("n_values"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.hll_sketch_agg(F.col(distinct), lg_k).alias("ids"), F.when(F.count(x) > 0, F.kll_sketch_agg_double(x, k)).alias("dist"))


def merge_sketches(chunks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of :func:`chunk_sketches` merged to coarser groups; the result merges again."""
    g = chunks.groupBy(*by) if by else chunks.groupBy()
    return g.agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.hll_union_agg("ids").alias("ids"), F.when(F.sum("n_values") > 0, F.kll_merge_agg_double("dist")).alias("dist"))


def sketch_summary(merged: DataFrame, by: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(by..., n_rows, n_values, min, max, n_distinct, q25, q50, ...) from merged sketches; quantiles are values of the data, the
    distinct count is an estimate."""
    quantile = [F.when(F.col("dist").isNotNull(), F.kll_sketch_get_quantile_double("dist", F.lit(float(p)))).alias(f"q{round(100 * p)}") for p in probs]
    return merged.select(*by, "n_rows", "n_values", "min", "max", F.hll_sketch_estimate("ids").alias("n_distinct"), *quantile)
