"""Approximate nearest neighbours: a vantage-point tree per shard, pruned by a relaxed triangle inequality.

Rows are dealt to shards by their distances to vantage points, so a query goes only to shards whose distance
intervals let in something better than what its own shard holds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftkit.llm.common import ship_by_value
from shiftkit.session import materialize

#: Vectors of a shard (about) and of a leaf.
SHARD_ROWS, LEAF = 4096, 256
#: Rows that vantage points are taken from, and vantage points (each has a region), at most.
SAMPLE, POINTS = 4096, 256


def lifted_distance(square: np.ndarray, products: np.ndarray) -> np.ndarray:
    """Distances under the lifted metric, from |q|^2 + bound^2 of the queries and their inner products with rows."""
    return np.sqrt(np.maximum(square - 2 * products, 0))


class Regions:
    """Vantage points of a sample, each the farthest from those before it; a row's region is that of its nearest point.

    What a region holds is known by the least and the largest distance of its rows from every point.
    """

    def __init__(self, sample: np.ndarray, bound: float, most: int) -> None:
        self.bound = bound
        lifted = self.lift(sample)
        chosen, d = [0], np.linalg.norm(lifted - lifted[0], axis=1)
        while len(chosen) < most and d.max() > 1e-6 * bound:
            chosen.append(int(d.argmax()))
            d = np.minimum(d, np.linalg.norm(lifted - lifted[chosen[-1]], axis=1))
        self.points = lifted[chosen]

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([vectors, np.sqrt(np.maximum(self.bound**2 - (vectors**2).sum(axis=1), 0))[:, None]], axis=1)

    def distances(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """The distances of rows, or of queries, from the points."""
        if query:
            return lifted_distance((vectors**2).sum(axis=1)[:, None] + self.bound**2, vectors @ self.points[:, :-1].T)
        return lifted_distance(np.array(2 * self.bound**2), self.lift(vectors) @ self.points.T)

    def least(self, queries: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest distance that the triangle inequality allows between each query and the rows of each region, a row of ``lo`` and ``hi``."""
        d, out = self.distances(queries, query=True), np.zeros((len(queries), len(lo)))
        for p in range(len(self.points)):
            np.maximum(out, np.maximum(d[:, p, None] - hi[:, p], lo[:, p] - d[:, p, None]), out=out)
        return out


class VPTree:
    """Vectors under the largest inner product, searched as the smallest distance.

    A coordinate sqrt(bound^2 - |x|^2) is added to each vector, and 0 to a query; then
    distance^2 = |q|^2 + bound^2 - 2 <q, x>, a metric with the same order as the inner product.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bound: float, leaf: int = LEAF, seed: int = 1) -> None:
        self.bound, self.leaf, self.rng = bound, leaf, np.random.default_rng(seed)
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        lift = np.sqrt(np.maximum(bound * bound - (self.vectors**2).sum(axis=1), 0))
        self.lifted = np.concatenate([self.vectors, lift[:, None]], axis=1)
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray) -> tuple:
        if len(rows) <= self.leaf:
            return (np.sort(rows),)
        point = int(rows[self.rng.integers(len(rows))])
        d = np.sqrt(((self.lifted[rows] - self.lifted[point]) ** 2).sum(axis=1))
        order = np.argsort(d, kind="stable")
        rows, d, half = rows[order], d[order], len(rows) // 2
        return (point, (d[0], d[half - 1]), self._build(rows[:half]), (d[half], d[-1]), self._build(rows[half:]))

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, relax: float = 1.0, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest of each query but rows of its own id: (query's place, row's id, inner product).

        ``floor`` is a score of each query that k rows elsewhere reach; rows below it aren't wanted. ``scored`` then
        has the number of rows that each query was multiplied with.

        All queries go down together. A branch is left out for the queries where ``relax`` times the smallest
        distance that the triangle inequality allows there exceeds the k-th distance so far: with 1 nothing can be
        missed, above 1 more is pruned.
        """
        self.own, self.q, self.k, self.relax = own, queries, k, relax
        self.square = (queries**2).sum(axis=1) + self.bound**2
        self.kth = np.full(len(queries), -np.inf) if floor is None else floor.astype(np.float64)
        self.scored = np.zeros(len(queries), np.int64)
        self.margin = 1e-14 * (queries.shape[1] + 1) * self.bound * np.sqrt((queries**2).sum(axis=1))
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.slack = 1e-7 * (self.bound + np.sqrt(self.square.max(initial=0)))
        if len(self.ids):
            self._visit(self.root, np.arange(len(queries)))
        return self.found

    def _visit(self, node: tuple, active: np.ndarray) -> None:
        if not len(active):
            return
        if len(node) == 1:
            self._leaf(node[0], active)
            return
        point, near, inside, far, outside = node
        d = lifted_distance(self.square[active], self.q[active] @ self.vectors[point])
        least_in, least_out = (np.maximum(0, np.maximum(d - hi, lo - d)) for lo, hi in (near, far))
        in_first = least_in <= least_out
        self._visit(inside, active[in_first])
        self._visit(outside, active[~in_first])
        self._visit(outside, active[in_first & self._open(active, least_out)])
        self._visit(inside, active[~in_first & self._open(active, least_in)])

    def _open(self, active: np.ndarray, least: np.ndarray) -> np.ndarray:
        kth = lifted_distance(self.square[active], self.kth[active])
        return self.relax * least <= kth + self.slack

    def _leaf(self, rows: np.ndarray, active: np.ndarray, block: int = 256) -> None:
        for at in range(0, len(active), block):
            some = active[at : at + block]
            self.scored[some] += len(rows)
            rough = self.q[some] @ self.vectors[rows].T
            rough[self.ids[rows] == self.own[some][:, None]] = -np.inf
            # block products leave out what can't be among the k; the rest is summed in one order, so equal vectors get equal scores
            least = self.kth[some]
            if len(rows) > self.k:
                least = np.maximum(least, np.partition(rough, len(rows) - self.k, axis=1)[:, len(rows) - self.k])
            i, j = np.nonzero((rough >= (least - 2 * self.margin[some])[:, None]) & (rough > -np.inf))
            exact = np.einsum("nd,nd->n", self.q[some][i], self.vectors[rows[j]])
            wanted = exact >= self.kth[some][i]
            i, j, exact = i[wanted], j[wanted], exact[wanted]
            if not len(i):
                continue
            changed = np.zeros(len(self.q), bool)
            changed[some[i]] = True
            old = changed[self.found[0]]
            q, r, s = (np.concatenate([a[old], b]) for a, b in zip(self.found, (some[i], self.ids[rows[j]], exact), strict=True))
            order = np.lexsort((r, -s, q))
            q, r, s = q[order], r[order], s[order]
            first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
            rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
            keep = rank < self.k
            full = rank == self.k - 1
            self.kth[q[full]] = np.maximum(self.kth[q[full]], s[full])
            self.found = tuple(np.concatenate([a[~old], b[keep]]) for a, b in zip(self.found, (q, r, s), strict=True))


def usable_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, v``: each different row with an id and a vector of finite numbers that isn't zero."""
    vector = F.col("embedding").cast("array<double>")
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v")).where(F.col("vec_id").isNotNull() & good).distinct()


class Shards:
    """The usable rows in regions of near vectors, each cut by a hash into shards of about ``shard_rows``.

    ``held`` has (dim, region, sub, vec_id, v). The vantage points, for each length of vectors in the sample (others are
    one region), and for each region the ends of its distances from them reach the driver: at most POINTS x POINTS pairs of numbers a length.
    """

    def __init__(self, rows: DataFrame, shard_rows: int = SHARD_ROWS) -> None:
        ship_by_value()
        usable = materialize(usable_vectors(rows))
        n, most = usable.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
        self.bound = bound = float(np.sqrt(most or 0.0) * (1 + 1e-12))
        regions = int(np.clip(2 * n // shard_rows, 1, POINTS))
        drawn: dict[int, list] = {}
        for r in usable.orderBy(F.xxhash64(F.lit("sample"), "vec_id"), "vec_id", "v").limit(SAMPLE).collect():
            drawn.setdefault(len(r["v"]), []).append(r["v"])
        self.points = points = {dim: Regions(np.array(v), bound, regions) for dim, v in drawn.items()}

        def placed(batch: pd.DataFrame) -> Iterator[tuple]:
            for dim, part in batch.groupby(batch["v"].map(len), sort=False):
                d = points[dim].distances(np.stack(part["v"].to_list())) if dim in points else np.zeros((len(part), 1))
                yield dim, part, d, d.argmin(axis=1)

        def deal(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for dim, part, _, region in placed(batch):
                    yield part.assign(dim=dim, region=region)

        def ends(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[tuple, list] = {}
            for batch in batches:
                for dim, _, d, region in placed(batch):
                    for r in np.unique(region):
                        n, lo, hi = held.get((dim, r), (0, np.inf, -np.inf))
                        some = d[region == r]
                        held[dim, r] = [n + len(some), np.minimum(lo, some.min(axis=0)), np.maximum(hi, some.max(axis=0))]
            if held:
                yield pd.DataFrame([(dim, r, *x) for (dim, r), x in held.items()], columns=["dim", "region", "n", "lo", "hi"])

        parts = usable.mapInPandas(ends, "dim int, region long, n long, lo array<double>, hi array<double>")
        outer = [vector_to_array(f(array_to_vector(c))).alias(c) for c, f in (("lo", Summarizer.min), ("hi", Summarizer.max))]
        self.table = parts.groupBy("dim", "region").agg(F.ceil(F.sum("n") / shard_rows).cast("int").alias("subs"), *outer).orderBy("dim", "region").toPandas()
        subs = usable.sparkSession.createDataFrame(self.table[["dim", "region", "subs"]].values.tolist(), "dim int, region long, subs int")
        dealt = usable.mapInPandas(deal, "dim int, region long, vec_id long, v array<double>")
        self.held = dealt.join(F.broadcast(subs), ["dim", "region"]).withColumn("sub", self.sub()).drop("subs")

    @staticmethod
    def sub() -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.col("subs")).cast("int")

    def route(self, asked: DataFrame, relax: float) -> DataFrame:
        """Queries (``dim, region, sub, vec_id, v, floor``: where they were searched and what was found) in a copy for each other shard that may hold better."""
        table, points, bound = self.table, self.points, self.bound

        def send(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for dim, part in batch.groupby("dim", sort=False):
                    here = table[table["dim"] == dim]
                    region, subs = here["region"].to_numpy(np.int64), here["subs"].to_numpy(np.int64)
                    q, floor = np.stack(part["v"].to_list()), part["floor"].fillna(-np.inf).to_numpy(np.float64)
                    square = (q**2).sum(axis=1) + bound**2
                    ok = np.ones((len(part), len(here)), bool)
                    if dim in points:
                        lo, hi = (np.stack(here[end].to_list()) for end in ("lo", "hi"))
                        slack = 1e-7 * (bound + np.sqrt(square))
                        ok = relax * points[dim].least(q, lo, hi) <= (lifted_distance(square, floor) + slack)[:, None]
                    was, was_sub = part["region"].to_numpy(), part["sub"].to_numpy()
                    for at in np.flatnonzero(ok.any(axis=0)):
                        for sub in range(subs[at]):
                            go = ok[:, at] & ((was != region[at]) | (was_sub != sub))
                            if go.any():
                                yield part[go].assign(region=region[at], sub=sub)

        return asked.mapInPandas(send, "dim int, region long, sub int, vec_id long, v array<double>, floor double")

    def search(self, asked: DataFrame, k: int, relax: float) -> DataFrame:
        """What each shard finds for the queries sent to it: ``query_id, vec_id, score``, and a row without vec_id that has the rows ``scored``."""
        bound = self.bound

        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            here, tree, ids, vectors = None, None, [], []
            for batch in batches:
                for key, part in batch.groupby(["dim", "region", "sub", "kind"], sort=False):
                    if key[:3] != here:
                        here, tree, ids, vectors = key[:3], None, [], []
                    of, v = part["vec_id"].to_numpy(np.int64), np.stack(part["v"].to_list())
                    if key[3] == 0:
                        ids.append(of)
                        vectors.append(v)
                        continue
                    if tree is None and ids:
                        tree = VPTree(np.concatenate(ids), np.concatenate(vectors), bound)
                    if tree is not None:
                        q, r, s = tree.search(of, v, k, relax, part["floor"].fillna(-np.inf).to_numpy(np.float64))
                        found = pd.DataFrame({"query_id": of[q], "vec_id": r, "score": s, "scored": 0})
                        yield pd.concat([found.astype({"vec_id": "Int64"}), pd.DataFrame({"query_id": of, "vec_id": pd.array([pd.NA] * len(of), dtype="Int64"), "score": 0.0, "scored": tree.scored})])

        shard = ["dim", "region", "sub"]
        rows = self.held.select(*shard, F.lit(0).alias("kind"), "vec_id", "v", F.lit(None).cast("double").alias("floor"))
        both = rows.union(asked.select(*shard, F.lit(1).alias("kind"), "vec_id", "v", "floor"))
        return both.repartition(*shard).sortWithinPartitions(*shard, "kind", "vec_id").mapInPandas(run, "query_id long, vec_id long, score double, scored long")


def visits(rows: DataFrame, every: int = 20, k: int = 20, relax: float = 1.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """All that the shards find and score for the queries of :func:`nearest`, as :meth:`Shards.search` gives it.

    A query is first searched in the shard it would be in itself; with its k-th score there it goes to the other shards that
    the triangle inequality, relaxed by ``relax``, leaves open.
    """
    shards = Shards(rows, shard_rows)
    asked = shards.held.where(F.col("vec_id") % every == 0).withColumn("floor", F.lit(None).cast("double"))
    home = materialize(shards.search(asked, k, relax))
    # rows of one id with different vectors are several queries with one result
    kth = home.where("vec_id IS NOT NULL").select("query_id", "vec_id", "score").distinct().groupBy(F.col("query_id").alias("of")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    again = asked.drop("floor").join(kth.where(F.col("n") == k), F.col("vec_id") == F.col("of"), "left").withColumn("floor", F.col("least"))
    away = shards.search(shards.route(again.select("dim", "region", "sub", "vec_id", "v", "floor"), relax), k, relax)
    return home.union(away)


def nearest(rows: DataFrame, every: int = 20, k: int = 20, relax: float = 1.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``k`` rows with the largest inner product for each row whose vec_id is divisible by ``every``.

    Rows (``vec_id, embedding``) are dealt to regions by their nearest of at most POINTS vantage points from a sample of at most SAMPLE rows, and
    regions to shards of about ``shard_rows`` rows; a task builds a shard's tree and streams the queries sent to it through it
    (:func:`visits`). The shards' best are merged by query under a rank limit
    that Spark applies before the shuffle too. Scores are inner products in double precision.

    Returns ``query_id, rank, vec_id, score``, nearest first, ties to the smaller vec_id; all candidates where there
    are fewer than ``k``. A query's own id is no candidate. Vectors that are null, zero, or hold a null or a number that isn't finite
    take no part, nor do rows without a vec_id; vectors meet others of their length only. A repeated row
    counts once. An empty table gives no rows; further columns are ignored.
    """
    found = visits(rows, every, k, relax, shard_rows).where("vec_id IS NOT NULL").select("query_id", "vec_id", "score").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scored_share(rows: DataFrame, every: int = 20, k: int = 20, relax: float = 1.0, shard_rows: int = SHARD_ROWS) -> float:
    """The share of all pairs of a query and a row that were multiplied."""
    n, asked = usable_vectors(rows).agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    done = visits(rows, every, k, relax, shard_rows).agg(F.sum("scored")).first()[0]
    return (done or 0) / max(1, n * asked)
