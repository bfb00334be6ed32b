"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftkit.llm.common import ship_by_value


def ring_points(n_shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions (signed 64-bit) of all virtual nodes and the shard of each.

    A node's place depends on its shard and replica number alone, so a further shard only adds nodes.
    """
    at = [
        (int.from_bytes(hashlib.md5(f"node:{s}:{v}".encode()).digest()[:8], "big", signed=True), s)
        for s in range(n_shards)
        for v in range(vnodes)
    ]
    at.sort()
    return np.array([p for p, _ in at], dtype=np.int64), np.array([s for _, s in at], dtype=np.int64)


def capacities(n_rows: int, n_shards: int, slack: float) -> list[int]:
    """Rows each shard may hold: with no slack the even shares, which differ by one at most."""
    if slack <= 0:
        return [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]
    return [math.ceil((1 + slack) * n_rows / n_shards)] * n_shards


def fill(counts: dict[int, int], shard_of: np.ndarray, caps: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Insert cell after cell: a cell's keys go to the first shard clockwise that has room.

    ``counts`` has the keys of each cell (wave * nodes + node); cells are inserted in this order. Keys that
    overflow a full shard continue clockwise. Returns (cell, first rank, end rank, shard, slot of the
    first): one piece per cell, and one more for each shard that fills up inside it.
    """
    room, used, nodes, out = list(caps), [0] * len(caps), len(shard_of), []
    for cell in sorted(counts):
        left, done, at = counts[cell], 0, cell % nodes
        while left:
            s = int(shard_of[at % nodes])
            if took := min(left, room[s]):
                out.append((cell, done, done + took, s, used[s]))
                room[s] -= took
                used[s] += took
                done += took
                left -= took
            at += 1
    return out


def ring_cell(key: Column, n_shards: int, vnodes: int, waves: int) -> Column:
    """The cell of a key: its insertion wave and the first virtual node clockwise of its position."""
    ship_by_value()
    points, _ = ring_points(n_shards, vnodes)

    @F.pandas_udf("long")
    def node(pos: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, pos.to_numpy(np.int64), side="left") % len(points))

    wave = F.pmod(F.xxhash64(F.lit("wave"), key), F.lit(waves))
    return wave * (n_shards * vnodes) + node(F.xxhash64(F.lit("ring"), key))


def assign_shards(
    docs: DataFrame, n_shards: int = 8, key: str = "doc_id", slack: float = 0.0, vnodes: int = 64, waves: int = 128
) -> DataFrame:
    """Give each row a shard and a slot: ``key, size`` (UTF-8 bytes), ``crc32, digest`` (of the text), ``shard, slot``.

    Each key hashes to a place on a ring of ``n_shards * vnodes`` virtual nodes and belongs to the next node
    clockwise; a shard takes ``(1 + slack)`` times its even share at most, and keys that overflow a full
    shard continue clockwise to the next one with room. Insertion order decides who overflows: keys come
    in ``waves`` by a second hash, inside a wave by node, inside such a cell by a third hash. So filling
    needs the row count of each cell only (``n_shards * vnodes * waves`` numbers, a bound set by the
    parameters and not by the data), and rows are ranked inside their cell, in parallel over all cells.
    With ``slack`` 0 shards differ by one row at most. Slots run from 0 in each shard without gaps.

    A null key is a key like any other. Rows with equal keys are ranked by text; equal rows are
    interchangeable. An empty table gives no rows; further columns are ignored.
    """
    base = docs.select(F.col(key).alias("key"), "text").withColumn("cell", ring_cell(F.col("key"), n_shards, vnodes, waves))
    counts = {r["cell"]: r["count"] for r in base.select("key", "cell").groupBy("cell").count().collect()}
    _, shard_of = ring_points(n_shards, vnodes)
    pieces = fill(counts, shard_of, capacities(sum(counts.values()), n_shards, slack))
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        pd.DataFrame(pieces, columns=["at", "lo", "hi", "shard", "first"], dtype="int64"),
        "at long, lo long, hi long, shard long, first long",
    )
    order = Window.partitionBy("cell").orderBy(F.xxhash64(F.lit("rank"), "key"), "key", "digest", "size")
    ranked = base.select(
        "key", "cell", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc32"), F.xxhash64("text").alias("digest"),
    ).withColumn("rank", F.row_number().over(order).cast("long") - 1)
    return ranked.join(plan, (F.col("cell") == F.col("at")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
        F.col("key").alias(key), "size", "crc32", "digest", F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("rank") - F.col("lo")).alias("slot")
    )


def add_shards(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """``docs`` with all its columns, and ``shard`` and ``slot`` of each row; a column of these names is replaced.

    Rows equal in doc_id and text are put on their places in any order. A null doc_id is a key like any other, a null text
    has no bytes; an empty table gives no rows. Further columns may have any names.
    """
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    at = {c: f"c{i}" for i, c in enumerate(kept)}
    plain = docs.select(*[F.col(f"`{c}`").alias(at[c]) for c in kept])
    plain = plain.withColumn("own_digest", F.xxhash64(at["text"]))
    plain = plain.withColumn("own_copy", F.row_number().over(Window.partitionBy(at["doc_id"], "own_digest").orderBy(at["text"])))
    placed = assign_shards(docs, n_shards).select(F.col("doc_id").alias("of_id"), F.col("digest").alias("of_digest"), "shard", "slot")
    placed = placed.withColumn("of_copy", F.row_number().over(Window.partitionBy("of_id", "of_digest").orderBy("shard", "slot")))
    match = F.col(at["doc_id"]).eqNullSafe(F.col("of_id")) & (F.col("own_digest") == F.col("of_digest")) & (F.col("own_copy") == F.col("of_copy"))
    return plain.join(placed, match).select(*[F.col(at[c]).alias(c) for c in kept], "shard", "slot")
