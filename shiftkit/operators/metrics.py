"""Counts, null profiles, summaries and classification metrics."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftkit.operators.positional import dense_index
from shiftkit.operators.quantiles import group_quantiles
from shiftkit.operators.vectors import null_safe


def value_counts(df: DataFrame, col, out: str = "n") -> DataFrame:
    c = F.col(col) if isinstance(col, str) else col
    return df.groupBy(c).agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), c)


def category_of(name) -> "F.Column":
    """Category = name up to the first '_'."""
    return F.substring_index(F.col(name) if isinstance(name, str) else name, "_", 1)


def null_profile(df: DataFrame) -> DataFrame:
    """Row count and the null count of every column, in one pass."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{c}") for c in df.columns]
    return df.agg(*aggs)


def describe(df: DataFrame, value: str, by: Sequence[str] = (), method: str = "exact") -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max per group; NULL is a group like any other."""
    by = list(by)
    x = F.col(value)
    base = df.groupBy(*by).agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"),
    )
    q = group_quantiles(df, value, by, [0.25, 0.5, 0.75], ["q25", "q50", "q75"], method=method)
    if by:
        return null_safe(base, q, by)
    # one global row: attach the quartiles as scalar subqueries
    return base.select("*", *[q.select(c).scalar().alias(c) for c in ("q25", "q50", "q75")])


def confusion_matrix(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Cells (true_label, pred_label, n) over the sorted union of labels, zero cells included.

    Labels are numbered, each makes its row of cells from the numbers, and the numbers are joined back to
    labels: no task holds the label set, however many labels there are. Counts come from one grouping.
    """
    labels = df.select(F.col(truth).alias("l")).union(df.select(F.col(pred).alias("l"))).where(F.col("l").isNotNull()).distinct()
    numbered = dense_index(labels, ["l"], out="i")
    last = numbered.agg(F.max("i")).scalar()
    cells = numbered.select(F.col("l").alias("true_label"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i"))
    grid = cells.join(numbered.select("i", F.col("l").alias("pred_label")), "i")
    counts = df.groupBy(F.col(truth).alias("true_label"), F.col(pred).alias("pred_label")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return grid.join(counts, ["true_label", "pred_label"], "left").select(
        "true_label", "pred_label", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def correct_flag(df: DataFrame, truth: str, pred: str, out: str = "correct") -> DataFrame:
    return df.withColumn(out, (F.col(truth) == F.col(pred)).cast("int"))


def accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.agg(F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def auroc_hard(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """ROC AUC of hard 0/1 predictions: (TPR + TNR) / 2."""
    t, p = F.col(truth), F.col(pred)
    agg = df.agg(
        F.count_if((t == 1) & (p == 1)).alias("tp"), F.count_if((t == 1) & (p == 0)).alias("fn"),
        F.count_if((t == 0) & (p == 0)).alias("tn"), F.count_if((t == 0) & (p == 1)).alias("fp"),
    )
    return agg.select(
        "tp", "fn", "tn", "fp",
        ((F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")) + F.try_divide(F.col("tn"), F.col("tn") + F.col("fp"))) / 2)
        .alias("auroc"),
    )


def token_f1(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Micro F1 over flattened (truth, pred) label lists of equal length: matches / tokens."""
    same = df.where(F.size(truth) == F.size(pred))
    pairs = same.select(F.explode(F.arrays_zip(F.col(truth).alias("t"), F.col(pred).alias("p"))).alias("z"))
    return pairs.agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.try_divide(F.count_if(F.col("z.t") == F.col("z.p")), F.count(F.lit(1))).alias("micro_f1"),
    ).select("*", same.agg(F.count(F.lit(1))).scalar().alias("n_sequences"))


def median_threshold_label(df: DataFrame, value: str, out: str = "pred", method: str = "exact") -> DataFrame:
    """1 where the value is above the column's exact median, else 0."""
    med = group_quantiles(df, value, [], [0.5], ["_med"], method=method).scalar()
    return df.withColumn(out, F.when(F.col(value) > med, 1).otherwise(0))


def distinct_elements(df: DataFrame, by: Sequence[str], arr: str, out: str = "n_distinct") -> DataFrame:
    """Number of distinct elements of the flattened arrays per group."""
    return df.select(*by, F.explode(arr).alias("_e")).groupBy(*by).agg(F.countDistinct("_e").alias(out))


def distinct_counts(df: DataFrame, by: Sequence[str], col: str, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Distinct values of ``col`` per group: exact, or HyperLogLog++ (``approx=True``) when an
    estimate within ``rsd`` relative error is enough and the exact shuffle is not wanted."""
    agg = F.approx_count_distinct(col, rsd) if approx else F.countDistinct(col)
    return df.groupBy(*by).agg(agg.alias(f"n_{col}"))
