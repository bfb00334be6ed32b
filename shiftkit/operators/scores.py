"""Score and decision comparison: wide score tables, model gaps, before/after joins,
difference-in-differences, histograms, score matrices, improvement chains and decision flips."""

from __future__ import annotations

from itertools import combinations
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftkit.operators.vectors import null_safe


def pivot_listed(df: DataFrame, rows: Sequence[str], col: str, values: Sequence[str], agg) -> DataFrame:
    """Pivot on a known list of values; a value outside the list is an error and not a lost column."""
    known = F.col(col).isin(list(values)) | F.col(col).isNull()
    checked = F.when(known, F.col(col)).otherwise(F.raise_error(F.concat(F.lit(f"unlisted {col}: "), F.col(col).cast("string"))))
    return df.withColumn(col, checked.cast(df.schema[col].dataType)).groupBy(*rows).pivot(col, list(values)).agg(agg)


def scores_wide(scores: DataFrame, key: str, model: str, score: str, models: Sequence[str],
                corpus: DataFrame | None = None, corpus_key: str | None = None) -> DataFrame:
    """One mean-score column per model (one pivot, not one join per model), left-joined to the corpus."""
    wide = pivot_listed(scores, [key], model, models, F.avg(score))
    if corpus is None:
        return wide
    ck = corpus_key or key
    return corpus.join(wide.withColumnRenamed(key, ck), ck, "left")


def model_pairs(models: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(list(models), 2))


def model_gap(wide: DataFrame, ids: Sequence[str], models: Sequence[str], complete: bool = True) -> DataFrame:
    """``score_a - score_b`` for every model pair, as long rows (model_a, model_b, gap).

    With ``complete`` a row that lacks any model's score is left out; else its gaps are NULL.
    """
    pairs = model_pairs(models)
    if complete:
        wide = wide.dropna(subset=list(models))
    rows = F.explode(F.array(*[
        F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), (F.col(f"`{a}`") - F.col(f"`{b}`")).alias("gap"))
        for a, b in pairs
    ]))
    return wide.select(*ids, rows.alias("_p")).select(*ids, "_p.*")


def before_after(scores: DataFrame, keys: Sequence[str], phase: str, score: str,
                 before: str = "original", after: str = "updated") -> DataFrame:
    """Mean original and updated scores side by side on the full key (model included), for keys with an original row:
    one grouping with two conditional means."""
    is_before, is_after = F.col(phase) == before, F.col(phase) == after
    g = scores.groupBy(*keys).agg(
        F.avg(F.when(is_before, F.col(score))).alias(f"score_{before}"),
        F.avg(F.when(is_after, F.col(score))).alias(f"score_{after}"),
        F.count_if(is_before).alias("_n"),
    )
    return g.where("_n > 0").drop("_n")


def diff_in_diff(ba: DataFrame, key: str, model: str, models: Sequence[str],
                 before: str = "score_original", after: str = "score_updated") -> DataFrame:
    """(after - before) of model a minus that of model b, per key and model pair."""
    delta = ba.select(key, model, (F.col(after) - F.col(before)).alias("_d"))
    wide = pivot_listed(delta, [key], model, models, F.first("_d"))
    return model_gap(wide, [key], models, complete=False).withColumnRenamed("gap", "did")


def equal_width_histogram(df: DataFrame, value: str, by: Sequence[str] = (), bins: int = 20) -> DataFrame:
    """``numpy.histogram(x, bins)`` per group: equal bins over [min, max], the last bin closed, empty
    bins kept.

    numpy's rules are followed exactly: a zero-width range is widened to [v - 0.5, v + 0.5]; the bin is
    ``floor((x - lo) * bins / (hi - lo))`` (the maximum goes to the last bin, where a raw
    ``width_bucket`` would open an extra one), then corrected against the ``linspace`` edges. All bins
    are emitted from a per-group bin list, then counts join in. NULL is a group like any other.
    """
    by_out = list(by)
    x = F.col(value)
    data = df.where(x.isNotNull())
    by = by_out or ["_g"]
    if not by_out:
        data = data.withColumn("_g", F.lit(0))
    # one row per group: small, so the join back is a broadcast when AQE measures it
    rng = data.groupBy(*by).agg(F.min(x).alias("_mn"), F.max(x).alias("_mx")).select(
        *by,
        F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("_lo"),
        F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("_hi"),
    )
    lo, hi = F.col("_lo"), F.col("_hi")
    step = (hi - lo) / bins

    def edge(k):
        return F.when(k == bins, hi).otherwise(k * step + lo)

    i0 = F.least(F.floor((x - lo) * (F.lit(float(bins)) / (hi - lo))), F.lit(bins - 1)).cast("int")
    i1 = F.when(x < edge(i0), i0 - 1).otherwise(i0)
    i2 = F.when((x >= edge(i1 + 1)) & (i1 != bins - 1), i1 + 1).otherwise(i1)
    binned = (null_safe(data, rng, by) if by_out else data.join(F.broadcast(rng), by)).withColumn("bin", i2)
    counts = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = rng.select(*by, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return null_safe(grid, counts, [*by, "bin"], "left").select(
        *by_out, "bin",
        edge(F.col("bin")).alias("bin_lo"),
        edge(F.col("bin") + 1).alias("bin_hi"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def integer_edge_histogram(df: DataFrame, value: str, by: Sequence[str] = (), lo: int = -10, hi: int = 9) -> DataFrame:
    """Histogram on integer edges lo..hi (hi - lo bins, the last one closed, outside values dropped); NULL is a group."""
    by = list(by)
    x = F.col(value)
    nb = hi - lo
    inside = df.where((x >= lo) & (x <= hi)).withColumn("bin_lo", (F.least(F.floor(x), F.lit(hi - 1))).cast("int"))
    counts = inside.groupBy(*by, "bin_lo").agg(F.count(F.lit(1)).alias("n"))
    keys = df.select(*by).distinct() if by else None
    edges = F.explode(F.sequence(F.lit(lo), F.lit(lo + nb - 1))).alias("bin_lo")
    grid = keys.select(*by, edges) if by else df.sparkSession.range(1).select(edges)
    return null_safe(grid, counts, [*by, "bin_lo"], "left").select(*by, "bin_lo", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def score_matrix(scores: DataFrame, rows: Sequence[str], col: str, score: str, values: Sequence[str]) -> DataFrame:
    """Mean score per (rows) x one column per ``col`` value: the table behind grouped bar charts."""
    return pivot_listed(scores, rows, col, values, F.avg(score))


def improvement_rows(grid: DataFrame, draft: str, improve: str, scorer: str, score: str, fill: str = "-") -> DataFrame:
    """The graded rows, best first: ``chain`` (``draft -> improver -> scorer``), score; a missing improver leaves its
    step out, a missing scorer is written ``fill``."""
    label = F.concat_ws(" -> ", F.col(draft), F.col(improve), F.coalesce(F.col(scorer), F.lit(fill)))
    return grid.withColumn("chain", label).orderBy(F.desc_nulls_last(score), "chain")


def improvement_chain(grid: DataFrame, draft: str, improve: str, scorer: str, score: str) -> DataFrame:
    """Chain label ``draft -> improver -> scorer`` (improver left out when NULL, the baseline),
    mean score and count per chain."""
    label = F.concat_ws(" -> ", F.col(draft), F.col(improve), F.col(scorer))
    return grid.groupBy(label.alias("chain")).agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n"))


def trim_scores(grid: DataFrame, category: str, score: str, fill: str = "none") -> DataFrame:
    """Fill a NULL category, keep scored rows, and make the score an integer (truncating).

    A score that is no number counts as missing.
    """
    number = F.col(score).try_cast("double").try_cast("int")
    return grid.fillna({category: fill}).withColumn(score, number).where(F.col(score).isNotNull())


def decision_three_way(orig: DataFrame, generic: DataFrame, tailored: DataFrame, key: str,
                       decision: str = "decision") -> DataFrame:
    """Inner join of three decision tables on the key, with ``_generic`` / ``_tailored`` suffixes."""
    g = generic.select(key, F.col(decision).alias(f"{decision}_generic"))
    t = tailored.select(key, F.col(decision).alias(f"{decision}_tailored"))
    return orig.select(key, decision).join(g, key).join(t, key)


def decision_flips(three: DataFrame, decision: str = "decision") -> DataFrame:
    cols = [decision, f"{decision}_generic", f"{decision}_tailored"]
    return three.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
