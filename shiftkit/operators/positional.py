"""Row positions and running totals without a window over a whole group.

Rows are range-partitioned on (group, order), so a large group spreads over many tasks; each
partition numbers or sums its own part, and the parts of a group that start in an earlier partition
get that much added. Only groups that cross a partition boundary need it, at most one for each
partition, so the table of offsets is no larger than the number of partitions.

The range-partitioned table is checkpointed once in the shared checkpoint folder: every branch and
any recomputation after a lost executor sees the same rows in the same partitions.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftkit.session import materialize


def running_total(df: DataFrame, order: Sequence[str], by: Sequence[str], amount: Column, out: str,
                  num_partitions: int | None = None) -> DataFrame:
    """``df`` with the sum of ``amount`` (whole numbers) over the rows before each one in its group; see :func:`running_totals`."""
    return running_totals(df, order, by, {out: amount}, num_partitions)


def running_totals(df: DataFrame, order: Sequence[str], by: Sequence[str], amounts: Mapping[str, Column],
                   num_partitions: int | None = None) -> DataFrame:
    """``df`` with, for each named amount (whole numbers), its sum over the rows before each one in its group.

    Rows equal in all order columns follow each other in an order given by a hash of the whole row,
    which also spreads a value that many rows share over the partitions. NULLs in group or order
    columns are values like any other, first in order.
    """
    by, order = list(by), list(order)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    names = list(amounts)
    rows = df.withColumn("_tie", tie)
    for i, name in enumerate(names):
        rows = rows.withColumn(f"_amount{i}", amounts[name])
    keys = [F.col(f"`{c}`") for c in [*by, *(c for c in order if c not in by)]] + [F.col("_tie")]
    tagged = materialize(rows.repartitionByRange(n, *keys).withColumn("_pid", F.spark_partition_id()))
    groups = [F.col(f"`{c}`") for c in by]
    inside = Window.partitionBy("_pid", *groups).orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = tagged
    for i in range(len(names)):
        local = local.withColumn(f"_local{i}", F.sum(f"_amount{i}").over(inside) - F.col(f"_amount{i}"))
    parts = tagged.groupBy("_pid", *groups).agg(*[F.sum(f"_amount{i}").alias(f"_part{i}") for i in range(len(names))])
    earlier = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    for i in range(len(names)):
        parts = parts.withColumn(f"_before{i}", F.sum(f"_part{i}").over(earlier))
    befores = [f"_before{i}" for i in range(len(names))]
    crossing = parts.where(F.col("_before0").isNotNull()).select(
        F.col("_pid").alias("_opid"), *[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(by)], *befores)
    cond = F.col("_pid") == F.col("_opid")
    for i, c in enumerate(by):
        cond = cond & F.col(f"`{c}`").eqNullSafe(F.col(f"_o{i}"))
    # at most one crossing group a partition: bounded by the number of partitions
    total = local.join(F.broadcast(crossing), cond, "left")
    sums = [(F.col(f"_local{i}") + F.coalesce(f"_before{i}", F.lit(0))).cast("long").alias(n) for i, n in enumerate(names)]
    return total.select(*[F.col(f"`{c}`") for c in df.columns], *sums)


def dense_index(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), out: str = "idx",
                num_partitions: int | None = None) -> DataFrame:
    """Number rows 0..n-1 per ``by`` group in ``order``; every row keeps all its columns and gets one number."""
    return running_total(df, order, by, F.lit(1).cast("long"), out, num_partitions)
