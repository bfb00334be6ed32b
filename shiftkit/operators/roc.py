"""Exact ROC curves and areas from scores, grouped, with ties, by counts and running totals.

Equal scores are counted first (map-side combine), so a score that half of the rows share is one row; the counts below each
score are running totals over range partitions. No task holds a group and no curve is thinned out.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftkit.operators.positional import running_totals
from shiftkit.operators.vectors import null_safe


def score_counts(df: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows of label 1 and 0 at each score: (by..., ``_x``, ``_pos``, ``_neg``); a NULL or NaN score is one score, NULL.

    Rows whose label is neither 1 nor 0 count in neither.
    """
    x = F.col(score).cast("double")
    x = F.when(~F.isnan(x), x + F.lit(0.0))  # -0.0 and 0.0 are one score
    t = F.col(truth)
    return df.select(*by, x.alias("_x"), t.alias("_t")).groupBy(*by, "_x").agg(
        F.count_if(F.col("_t") == 1).alias("_pos"), F.count_if(F.col("_t") == 0).alias("_neg"))


def _ranked(df: DataFrame, truth: str, score: str, by: Sequence[str]) -> DataFrame:
    counts = score_counts(df, truth, score, by)
    # a NULL score keeps its group alive and is in no curve
    scored = {n: F.when(F.col("_x").isNotNull(), F.col(n)).otherwise(0) for n in ("_pos", "_neg")}
    return running_totals(counts, ["_x"], by, {"_pos_below": scored["_pos"], "_neg_below": scored["_neg"]})


def auroc_score(df: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve of a score per group, by rank sums: (by..., n_positive, n_negative, n_unscored, auroc).

    The area is the share of (positive, negative) pairs where the positive row scores higher, equal scores counting half.
    Rows without a score (NULL or NaN) or without a label of 1 or 0 take no part; of the labelled ones ``n_unscored`` have no
    score. A group with one class has no area (NULL); NULL is a group like any other.
    """
    by = list(by)
    ranked = _ranked(df, truth, score, by)
    there = F.col("_x").isNotNull()
    won = F.col("_pos").cast("double") * (F.col("_neg_below") + F.col("_neg") / 2)
    g = (ranked.groupBy(*by) if by else ranked.groupBy()).agg(
        F.coalesce(F.sum(F.when(there, F.col("_pos"))), F.lit(0)).alias("n_positive"),
        F.coalesce(F.sum(F.when(there, F.col("_neg"))), F.lit(0)).alias("n_negative"),
        F.coalesce(F.sum(F.when(~there, F.col("_pos") + F.col("_neg"))), F.lit(0)).alias("n_unscored"), F.sum(F.when(there, won)).alias("_won"))
    pairs = F.col("n_positive").cast("double") * F.col("n_negative")
    return g.select(*by, "n_positive", "n_negative", "n_unscored", F.when(pairs > 0, F.col("_won") / pairs).alias("auroc"))


def roc_points(df: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """The ROC curve per group: (by..., threshold, tp, fp, tpr, fpr), a point for each distinct score.

    A row is called positive from the threshold on, so the highest threshold is the point next to (0, 0) and the lowest
    is (1, 1). A rate whose class is missing is NULL; rows without a score take no part.
    """
    by = list(by)
    ranked = _ranked(df, truth, score, by).where(F.col("_x").isNotNull())
    sums = [F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n")]
    if by:
        joined = null_safe(ranked, ranked.groupBy(*by).agg(*sums), by)
    else:
        totals = ranked.agg(*sums)
        joined = ranked.select("*", totals.select("_p").scalar().alias("_p"), totals.select("_n").scalar().alias("_n"))
    tp, fp = F.col("_p") - F.col("_pos_below"), F.col("_n") - F.col("_neg_below")
    return joined.select(*by, F.col("_x").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
                         F.try_divide(tp, F.col("_p")).alias("tpr"), F.try_divide(fp, F.col("_n")).alias("fpr"))
