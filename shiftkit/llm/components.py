"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftkit.session import stored


def _least(edges: DataFrame) -> DataFrame:
    """``u, least``: the smallest of each node and its neighbours (each edge counts from u only)."""
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).withColumn("least", F.least("node", "least"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


#: Rows of a round's edges that a task takes; small rounds run in few tasks.
TASK_ROWS = 100_000


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``links`` (u long, v long): root is the smallest node it is connected with.

    Large-star then small-star until nothing changes, which takes about log^2 of the longest chain rounds. Each
    star is a map-side combined minimum per node and a join back to the edges, so a node with very
    many links is no single group; a round's edges are stored in the shared folder, and only a count and a sum
    reach the driver. Repeated links, links in both directions and loops are fine. No links, no rows.
    """
    edges = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = _state(edges)
    while state[0]:
        tasks = 1 + state[0] // TASK_ROWS

        def next_edges(pairs: DataFrame, tasks: int = tasks) -> DataFrame:
            return stored(pairs.where("u <> v").coalesce(tasks).distinct().coalesce(tasks))

        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).coalesce(tasks)
        large = both.join(_least(both).coalesce(tasks), F.col("u") == F.col("node")).where("v > u")
        edges = next_edges(large.select(F.col("v").alias("u"), F.col("least").alias("v"))).coalesce(tasks)
        small = edges.join(_least(edges).coalesce(tasks), F.col("u") == F.col("node"))
        edges = next_edges(small.select(F.col("v").alias("u"), F.col("least").alias("v")).union(small.select("u", F.col("least").alias("v"))))
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v"), F.col("v")).distinct())
