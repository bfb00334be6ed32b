"""Deterministic sampling: every draw is a function of (seed, key), so samples repeat exactly.

Ranking by ``md5(seed:key)`` replaces the reference's unseeded shuffles; the same hash is available
in SQL, so each sample can be checked row for row.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftkit.functions.hashing import hash_u60, hash_uniform, poisson1_weight
from shiftkit.operators.positional import dense_index
from shiftkit.operators.vectors import null_safe


def sample_n(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Uniform ``n`` rows without replacement: the ``n`` smallest hashes (top-k, no full sort)."""
    h = hash_u60(seed, key)
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def shuffle(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """A reproducible random order."""
    return df.withColumn("_h", hash_u60(seed, key)).orderBy("_h", key).drop("_h")


def stratified_ranks(df: DataFrame, key: str, stratum: str, k: int, seed: int = 0, out: str = "srank") -> DataFrame:
    """Rank (1-based) of each row inside its stratum by hash, kept for ranks <= k.

    ``row_number() <= k`` is planned as a window group limit: each task keeps only its own k best rows
    per stratum before the shuffle, so a huge stratum sends at most k rows per task.
    """
    w = Window.partitionBy(stratum).orderBy("_h", key)
    return (
        df.withColumn("_h", hash_u60(seed, key))
        .withColumn(out, F.row_number().over(w))
        .where(F.col(out) <= k)
        .withColumn(out, F.col(out).cast("long"))
        .drop("_h")
    )


def stratified_sample(df: DataFrame, key: str, stratum: str, n: int, seed: int = 0) -> DataFrame:
    """``n // (number of classes)`` rows per class (half of ``n`` each on a binary class); NULL is a class."""
    classes = max(1, df.select(stratum).distinct().count())
    return stratified_ranks(df, key, stratum, n // classes, seed)


def stratified_train_test(df: DataFrame, key: str, stratum: str, k: int, seed: int = 0) -> DataFrame:
    """Disjoint stratified train (ranks 1..k) and test (ranks k+1..2k) sets, labelled in ``split``."""
    r = stratified_ranks(df, key, stratum, 2 * k, seed)
    return r.withColumn("split", F.when(F.col("srank") <= k, "train").otherwise("test")).drop("srank")


def positional_split(df: DataFrame, order: Sequence, frac: float = 0.8) -> DataFrame:
    """First ``floor(frac * n)`` rows in ``order`` are train, the rest test."""
    idx = dense_index(df, order, out="_idx")
    n = df.count()
    cut = int(frac * n)
    return idx.withColumn("split", F.when(F.col("_idx") < cut, "train").otherwise("test")).drop("_idx")


def hash_split(df: DataFrame, key: str, frac: float = 0.8, seed: int = 0) -> DataFrame:
    """Train where the key's uniform hash is below ``frac``; stable on any partitioning."""
    return df.withColumn("split", F.when(hash_uniform(seed, key) < frac, "train").otherwise("test"))


def bootstrap_draws(df: DataFrame, key: str, by: Sequence[str] = (), iters: int = 100,
                    size: int | None = None, seed: int = 0) -> DataFrame:
    """Resampling with replacement, as ``numpy.random.choice(n, m)`` per group and iteration.

    Draw ``j`` of iteration ``b`` in group ``g`` picks the row whose dense index (by ``key``) is
    ``hash(seed:g:b:j) mod n_g``. ``size`` = m draws per iteration (default: the group size). The
    draws are generated from the rows themselves (row j makes draw j, and rows j mod m make the extra
    draws when m > n), so no task builds a whole group. Output: group, ``iter``, ``key`` and
    ``weight`` (times drawn; rows never drawn are absent). NULL is a group like any other.
    """
    by = list(by)
    grouped = bool(by)
    idx = dense_index(df.select(*by, key), [key], by=by, out="_j")
    if not grouped:
        # a constant in the hash only; draws are grouped by iteration and pick
        idx, by = idx.withColumn("_g", F.lit(0)), ["_g"]
    if grouped:
        base = null_safe(idx, idx.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by)
    else:  # one size for everything: a scalar subquery, not a join
        base = idx.withColumn("_n", idx.agg(F.count(F.lit(1))).scalar())
    if size is None:
        base = base.withColumn("_draw", F.col("_j"))
    else:
        # row j makes draws j, j + n, j + 2n, ... below m
        reps = F.ceil((F.lit(int(size)) - F.col("_j")) / F.col("_n")).cast("int")
        base = (
            base.where(reps > 0)
            .withColumn("_rep", F.explode(F.sequence(F.lit(0), reps - 1)))
            .withColumn("_draw", F.col("_j") + F.col("_rep") * F.col("_n"))
        )
    # every slot explodes into ``iters`` draws: spread the slots over all shuffle partitions first
    # (an explicit count is kept by AQE), so a small index does not generate every draw in one task
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = base.repartition(parts, *by, "_draw")
    draws = base.withColumn("_iter", F.explode(F.sequence(F.lit(0), F.lit(iters - 1)))).withColumn(
        "_pick", F.pmod(hash_u60(seed, *by, "_iter", "_draw"), F.col("_n"))
    )
    counted = draws.groupBy(*by, "_iter", "_pick").agg(F.count(F.lit(1)).alias("weight"))
    out = null_safe(counted, idx.withColumnRenamed("_j", "_pick"), [*by, "_pick"]).select(
        *by, F.col("_iter").alias("iter"), key, F.col("weight").cast("long").alias("weight")
    )
    return out if grouped else out.drop("_g")


def poisson_weights(df: DataFrame, key: str, iters: int = 100, seed: int = 0) -> DataFrame:
    """Poisson(1) bootstrap weights per (row, iteration): no join, no group-wide state."""
    return (
        df.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iters - 1))))
        .withColumn("weight", poisson1_weight(hash_uniform(seed, key, "iter")))
        .where(F.col("weight") > 0)
    )
