"""All-pairs work on vectors without emitting pairs.

Vectors are packed into blocks of bounded size, near ones together; what a block holds is known by bounds (a centre and a
radius, or its distances to a few vantage rows). A pair table of block ids (generated, not joined) brings two blocks together
where their bounds leave the question open, and numpy does one matrix product per block pair inside
``mapInPandas``. What leaves a task is a summary of the block pair (a histogram, distinct values, or one candidate per row), never the
pairs themselves. The work is spread over block pairs, so a pool holding a third of the rows is split into many tasks.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftkit.functions.hashing import hash_u60
from shiftkit.functions.vectors import as_double, distance_fn, dot, euclidean_distance, norm
from shiftkit.operators.positional import dense_index, running_total
from shiftkit.operators.vectors import null_safe
from shiftkit.session import materialize, ship_package, stored

DEFAULT_BLOCK = 512
#: Rows of a side of a tile: blocks next to each other in number that are multiplied by one task with those of another such run.
TILE_ROWS = 8192


def has_direction(vec: str):
    """Rows whose vector is there and longer than zero; the others have no cosine with anything."""
    return F.col(vec).isNotNull() & (norm(as_double(vec)) > 0)


def unit(vec: str):
    """The vector over its length, in double precision."""
    nrm = norm(as_double(vec))
    return F.transform(as_double(vec), lambda x: x / nrm)


def split_cells(rows: DataFrame, cell: Sequence[str], key: str, block_size: int) -> DataFrame:
    """``rows`` with ``_sub``: cells above ``block_size`` rows are cut by a hash into blocks of about that size."""
    sizes = rows.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / block_size).cast("long").alias("_nb"))
    return null_safe(rows, sizes, cell).withColumn("_sub", F.pmod(F.xxhash64(key), F.col("_nb"))).drop("_nb")


def _mat(v) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in v]) if len(v) else np.zeros((0, 0))


def _numbers(v) -> DataFrame:
    return F.array(*[F.lit(float(x)) for x in v])


def leader_blocks(df: DataFrame, key: str, vec: str, block_size: int = DEFAULT_BLOCK, leaders: int = 64, band: float = 0.2) -> DataFrame:
    """Unit vectors of each pool ``_p`` in blocks around leaders: (_p, block, run, n, centre, radius, vecs), the vectors as the bytes
    of a matrix of doubles; a run is TILE_ROWS rows' worth of blocks.

    The rows of a pool with the smallest hashes lead, four for each block's worth of rows and at most ``leaders``. A row goes to its most
    similar leader and there to the band (of so many radians) of its angle to it; what lies in a band is cut into blocks of about
    ``block_size``. A block's centre is its mean direction and its radius the largest angle to it. Blocks of a pool are numbered from 0.
    """
    rows = df.select("_p", F.col(key).alias("_k"), unit(vec).alias("_v"))
    first = Window.partitionBy("_p").orderBy(hash_u60("leader", "_k"), "_k")
    lead = df.select("_p", F.col(key).alias("_k"), unit(vec).alias("_v")).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= leaders)
    many = df.groupBy("_p").agg(F.ceil(F.count(F.lit(1)) * 4 / block_size).alias("_most"))
    lead = lead.join(many, "_p").where(F.col("_r") <= F.col("_most")).groupBy("_p").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_v"))), lambda x: x["_v"]).alias("_ls"))
    near = F.transform("_ls", lambda x: F.round(dot(F.col("_v"), x), 12))
    most = F.array_max("_near")
    ring = F.floor(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), most))) / band)
    rows = rows.join(lead, "_p").withColumn("_near", near).withColumn("_c", F.array_position("_near", most) * 64 + ring).drop("_ls", "_near")
    packed = split_cells(rows, ["_p", "_c"], "_k", block_size).groupBy("_p", "_c", "_sub").agg(F.collect_list("_v").alias("vecs"))

    def bounds(it):
        for pdf in it:
            out = pdf[["_p", "_c", "_sub", "vecs"]].copy()
            n, centre, radius, packed = [], [], [], []
            for v in pdf["vecs"]:
                m = _mat(v)
                packed.append(m.tobytes())
                mean = m.sum(axis=0)
                size = np.linalg.norm(mean)
                mean = mean / size if size > 1e-9 else m[0]
                n.append(len(m))
                centre.append(mean)
                radius.append(float(np.arccos(np.clip((m @ mean).min(), -1.0, 1.0))) + 1e-7)
            out["vecs"], out["n"], out["centre"], out["radius"] = packed, n, centre, radius
            yield out

    made = materialize(packed.mapInPandas(bounds, "_p string, _c long, _sub long, vecs binary, n long, centre array<double>, radius double"))
    numbers = dense_index(made.select("_p", "_c", "_sub", "n"), ["_c", "_sub"], by=["_p"], out="block")
    # a run of blocks has about TILE_ROWS rows: the block's rows begin in that run
    numbers = running_total(numbers, ["block"], ["_p"], F.col("n"), "_start").select("_p", "_c", "_sub", "block", F.floor(F.col("_start") / TILE_ROWS).alias("run"))
    return made.join(numbers, ["_p", "_c", "_sub"]).drop("_c", "_sub")


def block_pairs(blocks: DataFrame) -> DataFrame:
    """Block pairs (b1 <= b2) inside each pool, with their number of row pairs and bounds of their similarities:
    (_p, b1, b2, r1, r2, m, smin, smax), with the runs of the two blocks.

    The pair list is generated from the block count in two explodes (first ids, then partners) so
    even a pool with very many blocks does not produce its pair list in one task.
    """
    counts = blocks.groupBy("_p").agg((F.max("block") + 1).alias("nb"))
    firsts = counts.select("_p", "nb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("b1"))
    pairs = firsts.repartition("_p", "b1").select("_p", "b1", F.explode(F.sequence(F.col("b1"), F.col("nb") - 1)).alias("b2"))
    side = [blocks.select("_p", F.col("block").alias(f"b{i}"), F.col("n").alias(f"n{i}"), F.col("centre").alias(f"c{i}"), F.col("radius").alias(f"_radius{i}"), F.col("run").alias(f"r{i}")) for i in (1, 2)]
    both = pairs.join(side[0], ["_p", "b1"]).join(side[1], ["_p", "b2"])
    own = F.col("b1") == F.col("b2")
    angle = F.when(own, 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot("c1", "c2")))))
    reach = F.col("_radius1") + F.col("_radius2")
    return both.select(
        "_p", "b1", "b2", "r1", "r2", F.when(own, F.col("n1") * (F.col("n1") - 1) / 2).otherwise(F.col("n1") * F.col("n2")).cast("long").alias("m"),
        (F.cos(F.least(F.lit(float(np.pi)), angle + reach)) - 1e-9).alias("smin"), (F.cos(F.greatest(F.lit(0.0), angle - reach)) + 1e-9).alias("smax"))


def tile_pairs(batches):
    """What a task reads: (pool, bracket, blocks of the tile, pairs of their numbers) for each tile, from rows sorted by tile, one for each block."""
    here, held = None, []

    def tile():
        mats = {r["block"]: np.frombuffer(r["vecs"]).reshape(r["n"], -1) for r in held}
        return held[0]["_p"], held[0]["_a"], held[0]["_b"], mats, [(r["block"], int(b)) for r in held for b in r["partners"]]

    for pdf in batches:
        for r in pdf.to_dict("records"):
            if (r["_p"], r["r1"], r["r2"]) != here:
                if held:
                    yield tile()
                here, held = (r["_p"], r["r1"], r["r2"]), []
            held.append(r)
    if held:
        yield tile()


def pair_values(mats: dict, b1: int, b2: int) -> np.ndarray:
    """Similarities of one block pair: i<j inside one block, all across two."""
    m = mats[b1] @ mats[b2].T
    return m[np.triu_indices(len(m), k=1)] if b1 == b2 else m.ravel()


def _at_rank(counts: DataFrame, value: str, rank: str) -> DataFrame:
    """(_p, value): the value that covers the pool's rank, from (_p, value, m) and the rank's column."""
    summed = counts.groupBy("_p", value, rank).agg(F.sum("m").alias("m"))
    ranked = running_total(summed, [value], ["_p"], F.col("m"), "_start")
    return ranked.where((F.col("m") > 0) & (F.col("_start") <= F.col(rank)) & (F.col(rank) < F.col("_start") + F.col("m"))).select("_p", value)


def pairwise_median_similarity(df: DataFrame, pool: Sequence[str], key: str, vec: str,
                               block_size: int = DEFAULT_BLOCK, bins: int = 4096,
                               max_candidates: int = 2_000_000, out: str = "median_similarity",
                               stats: list | None = None) -> DataFrame:
    """Exact median of the cosine similarity over all unordered pairs of distinct rows, per pool.

    Blocks are built around leaders, so a block pair's similarities are known to lie in an interval. The medians of all pairs'
    lower and upper ends bracket the median before anything is multiplied. A pass multiplies the block pairs whose interval
    straddles the bracket and counts the others as a whole; it bins the similarities inside the bracket, narrows it to the bins
    of the two middle ranks, and learns the multiplied pairs' true ends for the next pass. Blocks are multiplied in tiles of two runs of
    blocks, so a row travels once for each run its pool has, and a tile sends one histogram. Passes go on
    until the bracket holds at most ``max_candidates`` values, or gets no narrower: then it holds little but ties of the two
    middle values. The last pass returns the distinct values inside it, from which the middle ranks are read exactly. Zero and NULL
    vectors have no similarity and take no part. Where nothing is near anything (random directions) all block pairs straddle, and the
    work is quadratic in a pool's size. ``stats`` gets for each pass the share of row pairs that were multiplied.
    """
    names = list(pool)
    # one text names a pool, so that NULL is a pool like any other
    df = df.where(has_direction(vec)).withColumn("_p", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}) if names else F.lit(""))
    ship_package(df.sparkSession)
    blocks = materialize(leader_blocks(df, key, vec, block_size))
    pairs = stored(block_pairs(blocks))
    sizes = pairs.groupBy("_p").agg(F.sum("m").alias("_m")).where("_m > 0")
    ranks = stored(sizes.select("_p", F.floor((F.col("_m") - 1) / 2).cast("long").alias("_lo"), F.ceil((F.col("_m") - 1) / 2).cast("long").alias("_hi")))
    known = pairs.join(ranks, "_p")
    low = _at_rank(known, "smin", "_lo").withColumnRenamed("smin", "_a")
    high = _at_rank(known, "smax", "_hi").withColumnRenamed("smax", "_b")
    targets = stored(ranks.join(low, "_p").join(high, "_p"))

    def multiplied(pairs: DataFrame, targets: DataFrame, fn, schema: str) -> tuple[DataFrame, DataFrame]:
        """What a function makes of the pairs that straddle their pool's bracket, and the number of row pairs below of the others."""
        both = pairs.join(targets, "_p")
        open_ = both.where((F.col("smax") >= F.col("_a")) & (F.col("smin") <= F.col("_b")))
        # each block goes once to every tile that has a pair of it, with its partners there
        firsts = open_.select("_p", "r1", "r2", F.col("b1").alias("block"), F.col("b2").alias("partner"))
        seconds = open_.where("b1 <> b2").select("_p", "r1", "r2", F.col("b2").alias("block"), F.lit(None).cast("long").alias("partner"))
        wanted = firsts.union(seconds).groupBy("_p", "r1", "r2", "block").agg(F.collect_list("partner").alias("partners"))
        placed = wanted.join(blocks.select("_p", "block", "n", "vecs"), ["_p", "block"]).join(targets.select("_p", "_a", "_b"), "_p")
        made = placed.repartition("_p", "r1", "r2").sortWithinPartitions("_p", "r1", "r2").mapInPandas(fn, schema)
        if stats is not None:
            done, whole = open_.agg(F.sum("m")).first()[0] or 0, pairs.agg(F.sum("m")).first()[0] or 0
            stats.append(done / whole if whole else 0.0)
        return made, both.where(F.col("smax") < F.col("_a")).groupBy("_p").agg(F.sum("m").alias("_below"))

    def hist_fn(it):
        for p, a, b, mats, todo in tile_pairs(it):
            total, under, ends = np.zeros(bins, np.int64), 0, []
            for b1, b2 in todo:
                s = pair_values(mats, b1, b2)
                inside = s[(s >= a) & (s <= b)]
                idx = np.clip(((inside - a) / (b - a) * bins).astype(np.int64), 0, bins - 1) if b > a else np.zeros(len(inside), np.int64)
                total += np.bincount(idx, minlength=bins)
                under += int((s < a).sum())
                ends.append((b1, b2, s.min(), s.max()) if len(s) else (b1, b2, 2.0, -2.0))
            # the first row has the tile's pairs below the bracket, the next ones the true ends of its block pairs
            yield pd.DataFrame({"_p": [p], "b1": [-1], "b2": [-1], "bin": [-1], "cnt": [under], "smin": [0.0], "smax": [0.0]})
            o = pd.DataFrame(ends, columns=["b1", "b2", "smin", "smax"])
            yield o.assign(_p=p, bin=-2, cnt=0)[["_p", "b1", "b2", "bin", "cnt", "smin", "smax"]]
            nz = np.nonzero(total)[0]
            yield pd.DataFrame({"_p": p, "b1": -1, "b2": -1, "bin": nz, "cnt": total[nz], "smin": 0.0, "smax": 0.0}, index=range(len(nz)))

    def extract_fn(it):
        for p, a, b, mats, todo in tile_pairs(it):
            found, under = [np.zeros(0)], 0
            for b1, b2 in todo:
                s = pair_values(mats, b1, b2)
                found.append(s[(s >= a) & (s <= b)])
                under += int((s < a).sum())
                if sum(map(len, found)) > 4 * max_candidates:  # little but ties of a few values: a row each
                    vals, cnts = np.unique(np.concatenate(found), return_counts=True)
                    yield pd.DataFrame({"_p": p, "kind": np.int32(1), "val": vals, "cnt": cnts.astype(np.int64)})
                    found = [np.zeros(0)]
            # distinct values with their counts: ties collapse to one row
            vals, cnts = np.unique(np.concatenate(found), return_counts=True)
            yield pd.DataFrame({"_p": p, "kind": np.concatenate([[0], np.ones(len(vals), np.int64)]).astype(np.int32),
                                "val": np.concatenate([[0.0], vals]), "cnt": np.concatenate([[under], cnts.astype(np.int64)])})

    # Narrow the bracket [a, b] while the values inside it are too many to rank in one task.
    while True:
        made, below = multiplied(pairs, targets, hist_fn, "_p string, b1 long, b2 long, bin long, cnt long, smin double, smax double")
        made = stored(made)
        under = made.where("bin = -1").groupBy("_p").agg(F.sum("cnt").alias("_counted")).join(below, "_p", "left")
        under = under.select("_p", (F.col("_counted") + F.coalesce("_below", F.lit(0))).alias("_under"))
        counts = made.where("bin >= 0").groupBy("_p", "bin").agg(F.sum("cnt").alias("cnt"))
        w = Window.partitionBy("_p").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cum = counts.withColumn("_cum", F.sum("cnt").over(w)).join(under, "_p").join(targets, "_p")
        end = F.col("_cum") + F.col("_under")
        found = cum.groupBy("_p").agg(
            F.min(F.when(end > F.col("_lo"), F.col("bin"))).alias("_blo"), F.min(F.when(end > F.col("_hi"), F.col("bin"))).alias("_bhi"))
        inside = cum.join(found, "_p").where((F.col("bin") >= F.col("_blo")) & (F.col("bin") <= F.col("_bhi"))).groupBy("_p").agg(F.sum("cnt").alias("_inside"))
        width = (F.col("_b") - F.col("_a")) / bins
        # a margin for the rounding of bins; the next pass counts against the new ends itself. One row per pool
        nxt = stored(targets.join(found, "_p").join(inside, "_p").select(
            "_p", "_lo", "_hi", (F.col("_a") + F.col("_blo") * width - 1e-12).alias("_a"), (F.col("_a") + (F.col("_bhi") + 1) * width + 1e-12).alias("_b"),
            "_inside", (F.col("_b") - F.col("_a")).alias("_was")))
        now = F.col("_b") - F.col("_a")
        open_ = nxt.where((F.col("_inside") > max_candidates) & (now > 1e-11) & (now < 0.9 * F.col("_was"))).count()
        targets = nxt.drop("_inside", "_was")
        ends = made.where("bin = -2").select("_p", "b1", "b2", F.col("smin").alias("_s0"), F.col("smax").alias("_s1"))
        pairs = stored(pairs.join(ends, ["_p", "b1", "b2"], "left").select(
            "_p", "b1", "b2", "r1", "r2", "m", F.coalesce(F.col("_s0") - 1e-12, "smin").alias("smin"), F.coalesce(F.col("_s1") + 1e-12, "smax").alias("smax")))
        if not open_:
            break
    ext, below = multiplied(pairs, targets, extract_fn, "_p string, kind int, val double, cnt long")
    ext = stored(ext)
    under = ext.where("kind = 0").groupBy("_p").agg(F.sum("cnt").alias("_counted")).join(below, "_p", "left")
    cand = ext.where("kind = 1").groupBy("_p", "val").agg(F.sum("cnt").alias("cnt"))
    wr = Window.partitionBy("_p").orderBy("val").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # value v covers ranks [end - cnt, end) where end = under + cumulative count
    ranked = cand.join(under, "_p").withColumn("_end", F.sum("cnt").over(wr) + F.col("_counted") + F.coalesce("_below", F.lit(0))).withColumn(
        "_start", F.col("_end") - F.col("cnt")).join(targets, "_p")

    def covers(r):
        return (F.col("_start") <= F.col(r)) & (F.col(r) < F.col("_end"))

    picked = ranked.where(covers("_lo") | covers("_hi")).groupBy("_p").agg(
        F.max(F.when(covers("_lo"), F.col("val"))).alias("_vlo"),
        F.max(F.when(covers("_hi"), F.col("val"))).alias("_vhi"),
    )
    named = picked.select("_p", ((F.col("_vlo") + F.col("_vhi")) / 2).alias(out)).join(df.select("_p", *names).distinct(), "_p")
    return named.select(*names, out)


def vantage_rows(rows: DataFrame, n: int) -> np.ndarray:
    """``n`` vectors far from each other: from 16 n rows drawn by hash, each next one is the farthest from those taken."""
    drawn = rows.orderBy(hash_u60("vantage", "_k"), "_k").limit(16 * n).collect()
    if not drawn:
        return np.zeros((0, 0))
    m, taken = _mat([r["_v"] for r in drawn]), [0]
    far = np.linalg.norm(m - m[0], axis=1)
    while len(taken) < min(n, len(m)) and far.max() > 0:
        taken.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(m - m[taken[-1]], axis=1))
    return m[taken]


def band_match(left: DataFrame, right: DataFrame, key: str, vec: str, target: float, width: float,
               metric: str = "euclidean", block_size: int = DEFAULT_BLOCK, pivots: int = 4, stats: dict | None = None) -> DataFrame:
    """For each left row, the first right row (smallest key) with ``|d - target| < width``.

    Every row carries its distances to a few vantage rows (``pivots``); the triangle inequality says which rows can be
    that far apart: their distances to a vantage row differ by less than the band's upper end and add up to more than its lower
    end. Rows are partitioned into cells of the first two vantage distances, cells are cut into blocks, and a block meets
    the blocks of the cells its band can reach, if the intervals of all vantage distances allow it; inside a block pair the rows
    are held against the other block's intervals before the rest is multiplied. (Under cosine, unit vectors and the Euclidean
    distance sqrt(2 d) are used.)

    The right side comes in key order, first a few blocks' worth, then twice as much each round: matched rows leave, so most rows meet little, and a
    row without any match meets what its band can reach. Rows without a match are absent. Keys may be of any
    ordered type; an empty side gives no rows; NULL vectors, and zero ones under cosine, match nothing. ``stats`` gets
    ``pairs``, the distances computed, and ``all``, the number of pairs.
    """
    spark = left.sparkSession
    ship_package(spark)
    kt = left.schema[key].dataType.simpleString()
    cosine = metric == "cosine"
    near, far = (float(np.sqrt(2 * max(0.0, x))) if cosine else float(x) for x in (target - width, target + width))
    near, far = near - 1e-7, far + 1e-7
    none = spark.createDataFrame([], f"key_a {kt}, key_b {kt}, distance double")

    def rows_of(df):
        df = df.where(has_direction(vec)) if cosine else df.where(F.col(vec).isNotNull())
        return df.select(F.col(key).alias("_k"), (unit(vec) if cosine else as_double(vec)).alias("_v"))

    points = vantage_rows(rows_of(right), pivots)
    if not len(points) or far <= 0:
        return none
    cell = far / 4
    reach = 5  # cells that distances less than `far` apart can be in

    def placed(rows):
        d = F.array(*[euclidean_distance(F.col("_v"), _numbers(p)) for p in points])
        rows = rows.withColumn("_d", d)
        second = F.floor(F.col("_d")[1] / cell) if len(points) > 1 else F.lit(0).cast("long")
        return rows.withColumn("_c", F.floor(F.col("_d")[0] / cell)).withColumn("_c2", second)

    def packed(rows, side):
        """Blocks of a side with the intervals of their vantage distances; keys ascend in a block."""
        ends = [F.array(*[f(F.col("_d")[i]) for i in range(len(points))]) for f in (F.min, F.max)]
        cut = split_cells(rows, ["_c", "_c2"], "_k", block_size)
        made = cut.groupBy("_c", "_c2", "_sub").agg(F.array_sort(F.collect_list(F.struct("_i", "_k", "_v", "_d"))).alias("_s"), ends[0].alias(f"lo{side}"), ends[1].alias(f"hi{side}"))
        lists = [F.col("_s")[c].alias(f"{n}{side}") for c, n in (("_k", "keys"), ("_v", "vecs"), ("_d", "dist"))]
        return stored(made.select(F.col("_c").alias(f"cell{side}"), F.xxhash64("_c", "_c2", "_sub").alias(f"id{side}"), f"lo{side}", f"hi{side}", *lists))

    def fn(it):
        for pdf in it:
            outs = []
            for _, row in pdf.iterrows():
                a, b, da, db = _mat(row["vecs1"]), _mat(row["vecs2"]), _mat(row["dist1"]), _mat(row["dist2"])
                can = [((d > row[f"lo{o}"] - far) & (d < row[f"hi{o}"] + far) & (d + row[f"hi{o}"] > near)).all(axis=1) for d, o in ((da, 2), (db, 1))]
                a, b, ka, kb = a[can[0]], b[can[1]], np.asarray(row["keys1"])[can[0]], np.asarray(row["keys2"])[can[1]]
                outs.append(pd.DataFrame({"key_a": [None], "key_b": [None], "pairs": [len(a) * len(b)]}))
                if not len(a) or not len(b):
                    continue
                if cosine:
                    d = 1.0 - a @ b.T
                else:
                    d = np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0.0))
                ok = np.abs(d - target) < width
                hit = ok.any(axis=1)
                if hit.any():  # keys ascend inside a block
                    outs.append(pd.DataFrame({"key_a": ka[hit], "key_b": kb[ok[hit].argmax(axis=1)], "pairs": 0}))
            if outs:
                yield pd.concat(outs, ignore_index=True).astype({"key_a": object, "key_b": object})

    rights = materialize(placed(dense_index(rows_of(right), ["_k"], out="_i")))
    last = rights.agg(F.max("_i")).first()[0]
    todo, best, at, step = placed(rows_of(left)).withColumn("_i", F.lit(0).cast("long")), None, 0, 2 * block_size
    if stats is not None:
        stats["pairs"], stats["all"] = 0, todo.count() * (last + 1)
    while at <= last:
        lefts, some = packed(todo, 1), packed(rights.where((F.col("_i") >= at) & (F.col("_i") < at + step)), 2)
        meta = lefts.select("id1", "lo1", "hi1", F.explode(F.sequence(F.col("cell1") - reach, F.col("cell1") + reach)).alias("cell2"))
        pairs = meta.join(some.select("id2", "cell2", "lo2", "hi2"), "cell2")
        open_ = F.lit(True)
        for i in range(len(points)):
            (lo1, hi1), (lo2, hi2) = ((F.col(f"lo{x}")[i], F.col(f"hi{x}")[i]) for x in (1, 2))
            open_ = open_ & (lo2 - hi1 < far) & (lo1 - hi2 < far) & (hi1 + hi2 > near)
        meet = pairs.where(open_).select("id1", "id2").join(lefts.drop("cell1"), "id1").join(some.drop("cell2"), "id2")
        made = stored(meet.mapInPandas(fn, f"key_a {kt}, key_b {kt}, pairs long"))
        if stats is not None:
            stats["pairs"] += made.agg(F.sum("pairs")).first()[0] or 0
        found = made.where(F.col("key_a").isNotNull()).groupBy("key_a").agg(F.min("key_b").alias("key_b"))
        best = found if best is None else best.unionByName(found)
        at, step = at + step, step * 2
        if at <= last:
            todo = stored(todo.join(found.select(F.col("key_a").alias("_k")), "_k", "left_anti"))
            if todo.isEmpty():
                break
    # the winning distance on the JVM from the original vectors
    lv = left.select(F.col(key).alias("key_a"), as_double(vec).alias("_va"))
    rv = right.select(F.col(key).alias("key_b"), as_double(vec).alias("_vb"))
    return best.join(lv, "key_a").join(rv, "key_b").select(
        "key_a", "key_b", distance_fn(metric)(F.col("_va"), F.col("_vb")).alias("distance"))
