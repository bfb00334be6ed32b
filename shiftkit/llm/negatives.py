"""Hard-negative mining: rotated one-bit codes, popcount estimates, Cauchy-Schwarz intervals, integer scores."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftkit.llm.common import ship_by_value
from shiftkit.session import materialize

#: Rows that are coded together, anchors that meet them at once, codes of a row, and bits of an anchor's component.
BLOCK_ROWS, TILE_ANCHORS, LEVELS, BITS = 4096, 128, 8, 8
#: Components are held to this size, so that a product sum of up to 512 of them fits 64 bits.
MOST = 2**27


class Codes:
    """One-bit codes of integer vectors and deterministic bounds of their inner products.

    A vector v is written as the sum over levels t of ``c_t`` times a code direction, plus a rest: the direction is the
    sign vector of what is left, rotated by R_t, over sqrt(width), turned back; ``c_t`` is the stored alignment of the
    code with what it codes, so the rest is orthogonal to the last direction. With a query q, <q, v> is the sum of c_t <q, direction_t>
    (popcounts of a code with the bit planes of R_t q) and <q, rest>, which Cauchy-Schwarz bounds by |rest| times the norm of
    q's part orthogonal to the last direction. The error of the bit planes is added, so the interval always holds the true product.
    """

    def __init__(self, dim: int, levels: int = LEVELS, bits: int = BITS, seed: int = 1) -> None:
        self.dim, self.width, self.bits = dim, max(64, -(-dim // 64) * 64), bits
        rng = np.random.default_rng(seed)
        self.turns = [np.linalg.qr(rng.standard_normal((self.width, self.width)))[0] for _ in range(levels)]

    def _wide(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros((len(vectors), self.width))
        out[:, : vectors.shape[1]] = vectors
        return out

    def encode(self, vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each level: packed codes (rows x words), their popcounts, alignments, and the norm of the rest."""
        rest, out = self._wide(vectors), []
        for turn in self.turns:
            turned = rest @ turn.T
            sign = turned > 0
            unit = np.where(sign, 1.0, -1.0) / np.sqrt(self.width)
            align = (turned * unit).sum(axis=1)
            rest = (turned - align[:, None] * unit) @ turn
            packed = np.packbits(sign, axis=1, bitorder="little").view(np.uint64)
            out.append((packed, np.bitwise_count(packed).sum(axis=1).astype(np.float64), align, np.sqrt((rest**2).sum(axis=1))))
        return out

    def planes(self, queries: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """For each level: bit planes (queries x bits x words), lowest value, step, sum, and the largest error of a product with a direction."""
        wide, out = self._wide(queries), []
        for turn in self.turns:
            turned = wide @ turn.T
            low = turned.min(axis=1)
            step = np.maximum((turned.max(axis=1) - low) / (2**self.bits - 1), 1e-300)
            level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint64)
            near = low[:, None] + step[:, None] * level
            packed = [np.packbits((level >> np.uint64(b)) & np.uint64(1) == 1, axis=1, bitorder="little").view(np.uint64) for b in range(self.bits)]
            out.append((np.stack(packed, axis=1), low, step, near.sum(axis=1), np.abs(turned - near).sum(axis=1) / np.sqrt(self.width)))
        return out

    def product(self, plane: tuple[np.ndarray, ...], code: tuple[np.ndarray, ...], q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """<q, direction> of pairs of a query and a row by popcount, and how far it may be off."""
        bits, low, step, total, error = plane
        packed, ones, _, _ = code
        got, count = packed[r], np.zeros(len(q))
        for b in range(self.bits):
            count += np.float64(2**b) * np.bitwise_count(bits[q, b] & got).sum(axis=1)
        return (2 * (low[q] * ones[r] + step[q] * count) - total[q]) / np.sqrt(self.width), error[q]


def _kth(q: np.ndarray, value: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th largest value of each of n queries; minus infinity where there are fewer."""
    order = np.lexsort((-value, q))
    first = np.searchsorted(q[order], np.arange(n))
    out = np.full(n, -np.inf)
    at = first + k - 1
    there = at < len(q)
    there[there] = q[order][at[there]] == np.flatnonzero(there)
    out[there] = value[order][at[there]]
    return out


def search_block(
    codes: Codes, rows: np.ndarray, held: list[tuple], queries: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pairs (query's place, row's place, integer score) that hold each window's ``k`` best rows, and how many were scored.

    ``allowed`` says which rows a query may take; window w of a query takes scores from ``low`` to ``high`` [query, w]. Level by
    level, a pair stays while its interval meets a window and reaches the k-th largest lower end of those that surely lie in it.
    """
    n = len(queries)
    q, r = np.nonzero(allowed)
    planes, square = codes.planes(queries), (queries.astype(np.float64) ** 2).sum(axis=1)
    estimate, off = np.zeros(len(q)), np.zeros(len(q))
    tiny = 1e-9 * (1 + np.sqrt(square))
    size = 1 + np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
    for plane, code in zip(planes, held, strict=True):
        along, error = codes.product(plane, code, q, r)
        _, _, align, rest = code
        estimate += align[r] * along
        off += np.abs(align[r]) * error
        across = np.sqrt(np.maximum(0, square[q] - np.maximum(0, np.abs(along) - error) ** 2))
        wide = off + rest[r] * across + tiny[q] * size[r]
        least, most = estimate - wide, estimate + wide
        stay = np.zeros(len(q), bool)
        for w in range(low.shape[1]):
            lo, hi = low[q, w], high[q, w]
            sure = (least >= lo) & (most <= hi)
            kth = _kth(q[sure], least[sure], n, k)
            stay |= (most >= lo) & (least <= hi) & (most >= kth[q])
        q, r, estimate, off = q[stay], r[stay], estimate[stay], off[stay]
    return q, r, np.einsum("nd,nd->n", queries[q], rows[r]), len(q)


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, label, v``: rows whose label and vector are there and finite, with components floor(scale * x)."""
    vector = F.col("embedding").cast("array<double>")
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = F.transform(vector, lambda x: F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), F.floor(x * float(scale)).cast("double"))).cast("long"))
    return embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(good).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), held.alias("v"))


def _search(rows: DataFrame, anchors: DataFrame, blocks: int, dim: int, same: bool, k: int, levels: int) -> DataFrame:
    """The ``k`` best rows of each window of each anchor in each block, scored in integers.

    Rows of a block come first in their task, then the anchors in batches: a task holds one block and one batch.
    """
    ship_by_value()
    lists = "array<double>"
    held = rows.select("block", F.lit(0).alias("kind"), "noid", "vec_id", "row", "copy", "label", "v", F.lit(None).cast(lists).alias("low"), F.lit(None).cast(lists).alias("high"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    asked = anchors.select(every.alias("block"), F.lit(1).alias("kind"), "noid", "vec_id", "row", "copy", "label", "v", "low", "high")

    def matrix(vectors: pd.Series) -> np.ndarray:
        out = np.zeros((len(vectors), dim), np.int64)
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out

    def best(part: pd.DataFrame, block: dict, codes: Codes) -> Iterator[pd.DataFrame]:
        queries, own = matrix(part["v"]), part[["row", "copy"]].to_numpy(np.int64)
        low, high = np.stack(part["low"].to_list()), np.stack(part["high"].to_list())
        alike = part["label"].to_numpy()[:, None] == block["label"][None, :]
        itself = (own[:, :1] == block["row"][None, :]) & (own[:, 1:] == block["copy"][None, :])
        q, r, score, _ = search_block(codes, block["v"], block["codes"], queries, (alike if same else ~alike) & ~itself, low, high, k)
        for w in range(low.shape[1]):
            inside = (score >= low[q, w]) & (score <= high[q, w])
            a, b, s = q[inside], r[inside], score[inside]
            order = np.lexsort((block["copy"][b], block["row"][b], block["vec_id"][b], block["noid"][b], -s, a))
            a, b, s = a[order], b[order], s[order]
            first = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
            rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
            a, b, s = a[rank < k], b[rank < k], s[rank < k]
            yield pd.DataFrame({
                "anchor_id": part["vec_id"].to_numpy(np.int64)[a], "anchor_row": own[a, 0], "anchor_copy": own[a, 1], "w": np.full(len(a), w, np.int32),
                "noid": block["noid"][b], "vec_id": block["vec_id"][b], "row": block["row"][b], "copy": block["copy"][b], "score": s,
            })

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, here, parts, block = None, None, [], None
        for batch in batches:
            for (number, kind), part in batch.groupby(["block", "kind"], sort=False):
                if number != here:
                    here, parts, block = number, [], None
                if kind == 0:
                    parts.append(part)
                    continue
                if not parts:
                    continue
                if block is None:
                    codes = codes or Codes(dim, levels)
                    all_ = pd.concat(parts)
                    block = {c: all_[c].to_numpy(np.int64) for c in ("noid", "vec_id", "row", "copy", "label")} | {"v": matrix(all_["v"])}
                    block["codes"] = codes.encode(block["v"])
                for lo in range(0, len(part), TILE_ANCHORS):
                    yield from best(part.iloc[lo : lo + TILE_ANCHORS], block, codes)

    both = held.union(asked).repartition(F.col("block")).sortWithinPartitions("block", "kind")
    return both.mapInPandas(run, "anchor_id long, anchor_row long, anchor_copy long, w int, noid int, vec_id long, row long, copy long, score long")


def mine_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
    block_rows: int = BLOCK_ROWS, levels: int = LEVELS,
) -> DataFrame:
    """Hard negatives of each anchor and each of its positives.

    ``vectors``: ``vec_id, label, v`` with integer components; ``is_anchor`` picks the anchors. A row's score is its inner
    product with the anchor; higher ones come first, ties by the smaller vec_id. Positives are the first rows of the
    anchor's label, negatives of a positive the first rows of other labels with ``low * positive_score <= 100 * score
    <= high * positive_score``. Both searches go block by block: estimates and intervals of :class:`Codes` leave a few
    pairs, which are scored in integers; the blocks' best are merged under a rank limit that Spark applies before its shuffle too.

    Returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``. A positive without such
    negatives gives no row, nor does one with a negative score. Equal rows are rows of their own, an anchor's copy may be its
    positive. Rows without a vec_id come after all others in ties and have a null id. Vectors that differ in length meet as if the
    shorter one went on with zeros; empty and zero vectors score 0. An empty table gives no rows; further columns are ignored.
    """
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<long>").alias("v"))
    # equal rows are counted, then numbered: a group of copies is one row until here
    counted = plain.groupBy("vec_id", "label", "v").agg(F.count(F.lit(1)).alias("n"))
    told = counted.withColumn("row", F.xxhash64("vec_id", "label", "v"))
    each = told.select("vec_id", "label", "v", "row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"), is_anchor.alias("anchor"))
    rows = materialize(each.select(
        F.col("vec_id").isNull().cast("int").alias("noid"), F.coalesce("vec_id", F.lit(0)).alias("vec_id"), "label", "v", "row", "copy", F.coalesce("anchor", F.lit(False)).alias("anchor")))
    n, dim = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-n // block_rows))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row", "copy"), F.lit(blocks)))
    anchors = rows.where("anchor").drop("block")

    any_ = F.array(F.lit(float("-inf"))), F.array(F.lit(float("inf")))
    found = _search(rows, anchors.select("*", any_[0].alias("low"), any_[1].alias("high")), blocks, max(1, dim), True, positives, levels)
    anchor = ["anchor_id", "anchor_row", "anchor_copy"]
    order = [F.desc("score"), "noid", "vec_id", "row", "copy"]
    first = found.withColumn("at", F.row_number().over(Window.partitionBy(*anchor).orderBy(*order))).where(F.col("at") <= positives)
    # at most `positives` rows an anchor; a window of scores is an interval of integers
    ranked = F.sort_array(F.collect_list(F.struct("at", "noid", "vec_id", "score")))
    told_positives = materialize(first.groupBy(*anchor).agg(ranked.alias("positives")))
    ps = lambda i: F.col("positives")[i]["score"]
    lows = F.array(*[F.when(F.size("positives") > i, F.ceil(ps(i) * low / 100.0)).otherwise(F.lit(float("inf"))).cast("double") for i in range(positives)])
    highs = F.array(*[F.when(F.size("positives") > i, F.floor(ps(i) * high / 100.0)).otherwise(F.lit(float("-inf"))).cast("double") for i in range(positives)])
    windows = anchors.join(
        told_positives.select(F.col("anchor_row").alias("row"), F.col("anchor_copy").alias("copy"), F.col("anchor_id").alias("_of"), lows.alias("low"), highs.alias("high")), ["row", "copy"])
    other = _search(rows, windows.where(F.col("vec_id") == F.col("_of")), blocks, max(1, dim), False, negatives, levels)
    exact = other.join(told_positives, anchor).withColumn("p", F.col("positives")[F.col("w")])
    held = exact.where((F.col("p.score") * low <= F.col("score") * 100) & (F.col("score") * 100 <= F.col("p.score") * high))
    rank = F.row_number().over(Window.partitionBy(*anchor, "w").orderBy(*order))
    return held.withColumn("rank", rank).where(F.col("rank") <= negatives).select(
        "anchor_id", F.when(F.col("p.noid") == 0, F.col("p.vec_id")).alias("positive_id"), "rank",
        F.when(F.col("noid") == 0, F.col("vec_id")).alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))
