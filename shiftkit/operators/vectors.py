"""Embedding geometry: distances, pool centroids, separation, paired and per-round distances.

A pool is a set of rows sharing the ``pool`` key columns; many pools live in one table and are
handled in one job. Vectors are ``array<float|double>`` columns, cast to double before arithmetic.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftkit.functions.hashing import hash_u60
from shiftkit.functions.vectors import as_double, distance_fn
from shiftkit.operators.quantiles import group_quantiles


def vector_mean(df: DataFrame, by: Sequence[str], vec: str, out: str = "centroid",
                weight: str | None = None) -> DataFrame:
    """Element-wise (optionally weighted) mean of ``vec`` per ``by`` group.

    Spark ML's summarizer keeps one buffer of running sums per group and combines map-side, so the
    shuffle carries one partial vector per task and group, however large a group is. NULL vectors
    are left out.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    by = list(by)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.where(F.col(vec).isNotNull()).select(*by, array_to_vector(as_double(vec)).alias("_v"), w.alias("_w"))
    mean = Summarizer.mean(F.col("_v"), F.col("_w")).alias("_m")
    g = (rows.groupBy(*by) if by else rows.groupBy()).agg(mean)
    return g.select(*by, vector_to_array("_m").alias(out))


def null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the right side's key columns are dropped."""
    renamed = right.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(on)], *[c for c in right.columns if c not in on])
    cond = F.lit(True)
    for i, c in enumerate(on):
        cond = cond & left[c].eqNullSafe(renamed[f"_k{i}"])
    return left.join(renamed, cond, how).drop(*[f"_k{i}" for i in range(len(on))])


def distance_to_centroid(df: DataFrame, pool: Sequence[str], vec: str, metric="cosine",
                         out: str = "distance", weight: str | None = None) -> DataFrame:
    """Each row with its distance to its pool's (weighted) centroid; NULL for a zero vector under cosine."""
    cent = vector_mean(df, pool, vec, "_centroid", weight=weight)
    dist = distance_fn(metric)
    return null_safe(df, cent, list(pool)).withColumn(out, dist(as_double(vec), F.col("_centroid"))).drop("_centroid")


def pool_separation(df: DataFrame, pool: Sequence[str], vec: str, metric="cosine",
                    out: str = "separation", method: str = "exact") -> DataFrame:
    """Median distance of a pool's members to the pool centroid (exact median); NULL is a pool like any other.

    Rows whose distance is undefined (zero or NULL vectors) are left out of the median and counted in ``n_undefined``.
    """
    pool = list(pool)
    d = distance_to_centroid(df, pool, vec, metric, "_dist").select(*pool, "_dist")
    med = group_quantiles(d, "_dist", pool, [0.5], [out], method=method)
    undefined = d.groupBy(*pool).agg(F.count_if(F.col("_dist").isNull()).alias("n_undefined"))
    return null_safe(med, undefined, pool)


def distance_to_reference(df: DataFrame, ref: DataFrame, on: Sequence[str], vec: str,
                          ref_vec: str = "ref_embedding", metric="cosine", out: str = "distance") -> DataFrame:
    """Distance of every row to the reference vector of its group (``ref`` has one row per key)."""
    dist = distance_fn(metric)
    return df.join(ref, list(on)).withColumn(out, dist(as_double(vec), as_double(ref_vec))).drop(ref_vec)


def paired_distance(left: DataFrame, right: DataFrame, on: Sequence[str], vec: str,
                    metric="cosine", out: str = "distance") -> DataFrame:
    """Distance between the same-named rows of two pools (equi-join on the name)."""
    dist = distance_fn(metric)
    r = right.select(*on, F.col(vec).alias("_rvec"))
    return left.join(r, list(on)).withColumn(out, dist(as_double(vec), as_double("_rvec"))).drop("_rvec")


def step_distances(df: DataFrame, name: Sequence[str], round_col: str, vec: str, metric="cosine") -> DataFrame:
    """Per (text, round): distance to the text's first round and to its previous round.

    Rounds are numbered 0.. per text with the distributed dense index, the previous round is a join
    on (text, index - 1) and the first round a combinable ``min_by``: no window holds a whole text.
    """
    from shiftkit.operators.positional import dense_index

    name = list(name)
    dist = distance_fn(metric)
    idx = dense_index(df, [round_col], by=name, out="_step")
    first = df.groupBy(*name).agg(F.min_by(F.col(vec), F.col(round_col)).alias("_first"))
    prev = idx.select(*name, (F.col("_step") + 1).alias("_step"), F.col(vec).alias("_prev"))
    return (
        idx.join(first, name)
        .join(prev, [*name, "_step"], "left")
        .withColumn("dist_to_first", dist(as_double(vec), as_double("_first")))
        .withColumn("dist_to_prev", F.when(F.col("_prev").isNotNull(), dist(as_double(vec), as_double("_prev"))))
        .drop("_first", "_prev", "_step")
    )


def expand_weights(df: DataFrame, weight: str = "weight") -> DataFrame:
    """Repeat each row ``weight`` times (bootstrap multiplicities are small integers)."""
    return df.withColumn("_rep", F.explode(F.array_repeat(F.lit(1), F.col(weight).cast("int")))).drop("_rep")


def weighted_centroids(rows: DataFrame, pool: Sequence[str], iters: int) -> DataFrame:
    """Centroids of each pool under ``iters`` sets of weights: (pool..., centroids), an array of one vector for each set (NULL where all
    weights are 0), from rows (pool..., _v, _w).

    Every task multiplies its rows' weights with their vectors, pool by pool, so it sends one row of ``iters`` x dimensions sums for each of
    its pools; no row is repeated.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    from shiftkit.session import ship_package

    ship_package(rows.sparkSession)
    pool = list(pool)
    text = F.to_json(F.struct(*pool), {"ignoreNullFields": "false"}) if pool else F.lit("")

    def sums(it):
        import numpy as np
        import pandas as pd

        held: dict = {}
        for pdf in it:
            for name, part in pdf.groupby("name", sort=False):
                v, w = np.stack(part["v"].to_list()), np.stack(part["w"].to_list()).astype(np.float64)
                both = np.concatenate([w.sum(axis=0)[:, None], w.T @ v], axis=1)
                held[name] = held[name] + both if name in held else both
            if len(held) > 256:  # many pools: partial sums leave early
                yield pd.DataFrame({"name": list(held), "s": [m.ravel() for m in held.values()]})
                held = {}
        if held:
            yield pd.DataFrame({"name": list(held), "s": [m.ravel() for m in held.values()]})

    slim = rows.where(F.col("_v").isNotNull()).select(text.alias("name"), F.col("_v").alias("v"), F.col("_w").alias("w"))
    parts = slim.mapInPandas(sums, "name string, s array<double>")
    total = parts.select("name", array_to_vector("s").alias("s")).groupBy("name").agg(Summarizer.sum(F.col("s")).alias("s")).select("name", vector_to_array("s").alias("s"))
    width = (F.size("s") / iters).cast("int")

    def one(i):
        some = F.slice("s", i * width + 1, width)
        return F.when(some[0] > 0, F.transform(F.slice(some, 2, width - 1), lambda x: x / some[0]))

    made = total.select("name", F.transform(F.sequence(F.lit(0), F.lit(iters - 1)), one).alias("centroids"))
    names = rows.select(text.alias("name"), *pool).distinct()
    return names.join(made, "name").drop("name")


def separation_bootstrap(df: DataFrame, pool: Sequence[str], key: str, vec: str, metric="cosine",
                         iters: int = 100, seed: int = 0, method: str = "exact",
                         draws: str = "poisson") -> DataFrame:
    """Separation per pool with its bootstrap standard deviation (population std over ``iters``
    full-size resamples with replacement).

    ``draws="poisson"`` gives every row a Poisson(1) weight per iteration, which needs no index and
    no join; ``draws="multinomial"`` resamples exactly n rows per pool (``bootstrap_draws``). A row carries its weights
    as one array and meets its pool's centroids as one array (:func:`weighted_centroids`), so vectors aren't copied; what is
    exploded is (iteration, distance, weight), and each resample's median is a weighted one.
    """
    from shiftkit.functions.hashing import hash_uniform, poisson1_weight
    from shiftkit.operators.sampling import bootstrap_draws
    from shiftkit.session import materialize

    pool = list(pool)
    rows = df.select(*pool, key, as_double(vec).alias("_v"))
    every = F.sequence(F.lit(0), F.lit(iters - 1))
    if draws == "poisson":
        rows = rows.withColumn("_w", F.transform(every, lambda i: poisson1_weight(hash_uniform(seed, key, i))))
    else:
        picks = bootstrap_draws(df.select(*pool, key), key, pool, iters=iters, seed=seed)
        drawn = picks.groupBy(*pool, key).agg(F.map_from_entries(F.collect_list(F.struct("iter", "weight"))).alias("_m"))
        rows = null_safe(rows, drawn, [*pool, key]).withColumn("_w", F.transform(every, lambda i: F.coalesce(F.element_at("_m", i), F.lit(0)))).drop("_m")
    # weights feed the centroids and the distances; rows are spread first, as a table may be one file
    rows = materialize(rows.repartition(df.sparkSession.sparkContext.defaultParallelism, key))
    dist = distance_fn(metric)
    both = null_safe(rows, weighted_centroids(rows, pool, iters), pool)
    each = F.transform(F.arrays_zip("_w", "centroids"), lambda x: F.when(x["_w"] > 0, dist(F.col("_v"), x["centroids"])))
    far = both.select(*pool, F.posexplode(F.arrays_zip(each.alias("d"), F.col("_w").alias("w"))).alias("iter", "x"))
    far = far.select(*pool, "iter", F.col("x.d").alias("_dist"), F.col("x.w").alias("weight")).where("weight > 0")
    seps = group_quantiles(far, "_dist", [*pool, "iter"], [0.5], ["_sep"], method=method, weight="weight")
    sd = seps.groupBy(*pool).agg(F.stddev_pop("_sep").alias("separation_sd"))
    return null_safe(pool_separation(df, pool, vec, metric, method=method), sd, pool, "left")


def sample_metrics(df: DataFrame, pool: Sequence[str], key: str, vec: str | None = None, iters: int = 1000, size: int | None = 100,
                   seed: int = 0, metrics: dict | None = None) -> DataFrame:
    """Bootstrap samples of ``size`` rows per pool and iteration, and on each: the median pairwise
    cosine similarity (diagonal excluded) and the number of distinct vector elements.

    A sample is bounded by ``size``, so it is one collected row, and samples are evaluated in Arrow
    batches with numpy. ``metrics`` replaces the two defaults with any ``{name: f(matrix) -> float}``
    (each row of the matrix is one drawn vector, repeats included); every metric becomes a double
    column.

    A metric may also be an aggregate Column over the sample's rows with the column ``weight``, the times each was drawn (such as
    ``sum(x * weight) / sum(weight)``). Samples then are groups of weighted rows and nothing is collected, so with Columns alone
    ``size=None`` draws full-size samples.
    """
    from pyspark.sql import Column

    from shiftkit.operators.sampling import bootstrap_draws

    from shiftkit.session import ship_package

    pool = list(pool)
    ship_package(df.sparkSession)
    columns = {n: m for n, m in (metrics or {}).items() if isinstance(m, Column)}
    metrics = None if metrics is None else {n: m for n, m in metrics.items() if n not in columns}
    if (metrics is None or metrics) and (size is None or vec is None):
        raise ValueError("a metric of a matrix needs a sample size and a vector column")
    draws = bootstrap_draws(df.select(*pool, key), key, pool, iters=iters, size=size, seed=seed)
    if columns:
        weighted = null_safe(draws, df.select(*[c for c in df.columns if c not in ("iter", "weight")]), [*pool, key])
        summed = weighted.groupBy(*pool, "iter").agg(*[m.alias(n) for n, m in columns.items()])
        if not metrics:
            return summed
        return null_safe(sample_metrics(df, pool, key, vec, iters, size, seed, metrics), summed, [*pool, "iter"])
    # vectors travel in their stored precision; numpy widens them to double
    rows = expand_weights(null_safe(draws, df.select(*pool, key, F.col(vec).alias("_v")), [*pool, key]))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in pool)
    # one row per sample (its size is the ``size`` parameter), then numpy over a stack of samples
    packed = rows.groupBy(*pool, "iter").agg(F.flatten(F.collect_list("_v")).alias("_m"), F.count(F.lit(1)).alias("_k"))

    def default_metrics(it):
        import numpy as np

        for pdf in it:
            mats = [np.asarray(m, dtype=np.float64).reshape(int(k), -1) for m, k in zip(pdf["_m"], pdf["_k"])]
            med, uniq = [], []
            for m in mats:
                nrm = np.linalg.norm(m, axis=1)
                s = (m @ m.T) / np.outer(nrm, nrm)
                off = s[~np.eye(len(m), dtype=bool)]
                med.append(float(np.median(off)) if len(off) else float("nan"))
                uniq.append(int(len(np.unique(m))))
            out = pdf[[*pool, "iter"]].copy()
            out["median_similarity"] = med
            out["distinct_elements"] = np.asarray(uniq, dtype=np.int64)
            yield out

    if metrics is None:
        return packed.mapInPandas(default_metrics, f"{schema}, iter int, median_similarity double, distinct_elements long")
    custom = dict(metrics)

    def custom_metrics(it):
        import numpy as np

        for pdf in it:
            mats = [np.asarray(m, dtype=np.float64).reshape(int(k), -1) for m, k in zip(pdf["_m"], pdf["_k"])]
            out = pdf[[*pool, "iter"]].copy()
            for name, fn in custom.items():
                out[name] = [float(fn(m)) for m in mats]
            yield out

    cols = ", ".join(f"`{n}` double" for n in custom)
    return packed.mapInPandas(custom_metrics, f"{schema}, iter int, {cols}")


def bootstrap_interval(samples: DataFrame, by: Sequence[str], value: str, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Percentile interval (linear interpolation) of bootstrap values per group."""
    return group_quantiles(samples, value, by, [lo, hi], ["ci_lo", "ci_hi"])


def coefficient_summary(maps: DataFrame, by: Sequence[str] = ("out_dim",)) -> DataFrame:
    """Mean and population deviation of each coefficient over the samples of ``regression_2d``, and their number."""
    cols = ["coef_0", "coef_1", "intercept"]
    aggs = [f(c).alias(f"{n}_{c}") for c in cols for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    return maps.groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("n_samples"))


def regression_2d(df: DataFrame, by: Sequence[str], x0: str, x1: str, ys: Sequence[str] | str) -> DataFrame:
    """OLS of each ``y`` on (x0, x1) with intercept per group, from population (co)variances
    (closed form). All targets come from one aggregation; rows are (by..., out_dim, coef_0, coef_1,
    intercept) with ``out_dim`` the target's position in ``ys``."""
    by = list(by)
    ys = [ys] if isinstance(ys, str) else list(ys)
    aggs = [F.var_pop(x0).alias("_s00"), F.var_pop(x1).alias("_s11"), F.covar_pop(x0, x1).alias("_s01"),
            F.avg(x0).alias("_m0"), F.avg(x1).alias("_m1")]
    for j, y in enumerate(ys):
        aggs += [F.covar_pop(y, x0).alias(f"_sy0_{j}"), F.covar_pop(y, x1).alias(f"_sy1_{j}"), F.avg(y).alias(f"_my_{j}")]
    g = df.groupBy(*by).agg(*aggs)
    det = F.col("_s00") * F.col("_s11") - F.col("_s01") * F.col("_s01")
    rows = []
    for j in range(len(ys)):
        b0 = (F.col(f"_sy0_{j}") * F.col("_s11") - F.col(f"_sy1_{j}") * F.col("_s01")) / det
        b1 = (F.col(f"_sy1_{j}") * F.col("_s00") - F.col(f"_sy0_{j}") * F.col("_s01")) / det
        rows.append(F.struct(F.lit(j).alias("out_dim"), b0.alias("coef_0"), b1.alias("coef_1"),
                             (F.col(f"_my_{j}") - b0 * F.col("_m0") - b1 * F.col("_m1")).alias("intercept")))
    return g.select(*by, F.inline(F.array(*rows)))


def pull_estimate(pairs: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Pull-to-centre model y = x + alpha (z - x) + w, per group: OLS of (y - x) on x gives
    slope = -alpha and intercept = alpha z + w; alpha and the fixed point -intercept/slope are
    reported (z and w are not separately identifiable)."""
    d = F.col(y) - F.col(x)
    g = pairs.groupBy(*by).agg(F.regr_slope(d, F.col(x)).alias("_s"), F.regr_intercept(d, F.col(x)).alias("_i"),
                               F.count(F.lit(1)).alias("n"))
    return g.select(*by, (-F.col("_s")).alias("alpha"), (-F.col("_i") / F.col("_s")).alias("fixed_point"), "n")


def density_grid(df: DataFrame, x: str, y: str, cell: float, by: Sequence[str] = ()) -> DataFrame:
    """Counts of 2-D points per square cell: the table under a density plot."""
    return df.groupBy(*by, F.floor(F.col(x) / cell).alias("gx"), F.floor(F.col(y) / cell).alias("gy")).agg(
        F.count(F.lit(1)).alias("n"))


def moments(df: DataFrame, vec: str) -> tuple[int, "np.ndarray", "np.ndarray"]:
    """Number, mean and population covariance of all vectors, in one pass: every task sums its rows and their products
    (blocks of rows times themselves), and the tasks' sums are added up element by element.

    Brought to the driver: one number for each pair of dimensions. NULL vectors take no part; vectors of different lengths are an error.
    """
    import numpy as np

    from shiftkit.session import ship_package

    ship_package(df.sparkSession)

    def sums(batches):
        import pandas as pd

        total, first, n = None, None, 0
        for pdf in batches:
            if not len(pdf):
                continue
            m = np.stack(pdf["v"].to_list())
            if total is None:
                total, first = np.zeros((m.shape[1], m.shape[1])), np.zeros(m.shape[1])
            n, first, total = n + len(m), first + m.sum(axis=0), total + m.T @ m
        if total is not None:
            d = len(first)
            i, j = np.triu_indices(d)
            yield pd.DataFrame({
                "i": np.concatenate([[-2], np.full(d, -1), i]), "j": np.concatenate([[0], np.arange(d), j]),
                "s": np.concatenate([[float(n)], first, total[i, j]])})

    rows = df.where(F.col(vec).isNotNull()).select(as_double(vec).alias("v"))
    parts = rows.mapInPandas(sums, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    if not parts:
        return 0, np.zeros(0), np.zeros((0, 0))
    at = {(r["i"], r["j"]): r["s"] for r in parts}
    n, d = int(at[-2, 0]), 1 + max(j for i, j in at if i == -1)
    mean = np.array([at[-1, j] for j in range(d)]) / n
    cov = np.array([[at[min(i, j), max(i, j)] for j in range(d)] for i in range(d)]) / n - np.outer(mean, mean)
    return n, mean, cov


def principal_components(df: DataFrame, vec: str, k: int = 2) -> tuple["np.ndarray", "np.ndarray"]:
    """Mean of all vectors and their ``k`` principal components (rows, largest variance first).

    A component's sign is fixed: its entry of largest size, the first of equal ones, is positive.
    """
    import numpy as np

    _, mean, cov = moments(df, vec)
    if not len(mean):
        return mean, np.zeros((k, 0))
    values, vectors = np.linalg.eigh(cov)
    parts = vectors[:, np.argsort(-values, kind="stable")[:k]].T
    lead = parts[np.arange(len(parts)), np.abs(np.round(parts, 12)).argmax(axis=1)]
    return mean, parts * np.where(lead < 0, -1.0, 1.0)[:, None]


def pca_project(df: DataFrame, vec: str, k: int = 2, out: str = "pc") -> DataFrame:
    """Principal components of all rows (centred), and each row's scores on them as ``out`` (``array<double>``).

    The fit reads the vectors once (:func:`moments`); scores are sums of products on the JVM. Signs are fixed
    (:func:`principal_components`). A NULL vector has no scores.
    """
    mean, parts = principal_components(df, vec, k)
    if not len(mean):
        return df.withColumn(out, F.lit(None).cast("array<double>"))
    centre = F.array(*[F.lit(float(x)) for x in mean])
    centred = F.zip_with(as_double(vec), centre, lambda a, b: a - b)
    rows = df.withColumn("_cv", centred)
    scores = [F.aggregate(F.zip_with(F.col("_cv"), F.array(*[F.lit(float(x)) for x in p]), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x) for p in parts]
    return rows.withColumn(out, F.when(F.col(vec).isNotNull(), F.array(*scores))).drop("_cv")


def hashed_words(df: DataFrame, text: str, out: str, dim: int) -> DataFrame:
    """A text as its bag of words hashed (md5) to ``dim`` buckets and scaled to unit length (``array<double>``), all
    on the JVM; a text without words is a zero vector."""
    from pyspark.ml.feature import CountVectorizerModel, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)
    toks = df.withColumn("_tok", F.transform(words, lambda w: F.pmod(hash_u60("embed", w), F.lit(dim)).cast("string")))
    counts = CountVectorizerModel.from_vocabulary([str(i) for i in range(dim)], inputCol="_tok", outputCol="_tf")
    nz = Normalizer(p=2.0, inputCol="_tf", outputCol="_n").transform(counts.transform(toks))
    return nz.withColumn(out, vector_to_array("_n")).drop("_tok", "_tf", "_n")


def distance_to_first_round(rounds: DataFrame, name: str, round_col: str, text: str, metric="cosine", dim: int = 64,
                            out: str = "distance") -> DataFrame:
    """Each round's text with its embedding distance to round 0 of the same text; NULL where one has no words."""
    vecs = hashed_words(rounds, text, "_v", dim)
    first = vecs.where(F.col(round_col) == 0).select(name, F.col("_v").alias("_first"))
    return vecs.join(first, name).withColumn(out, distance_fn(metric)(F.col("_v"), F.col("_first"))).drop("_v", "_first")


def embed_texts(df: DataFrame, text: str, out: str = "embedding", dim: int = 256, encoder=None,
                batch_size: int = 64) -> DataFrame:
    """Embed a text column.

    ``encoder`` is any ``list[str] -> 2-D array`` callable, loaded once per Python worker and called
    on Arrow batches (``mapInPandas``). Without one, texts become ``hashed_words``.
    """
    if encoder is None:
        return hashed_words(df, text, out, dim).withColumn(out, F.col(out).cast("array<float>"))
    from shiftkit.session import ship_package

    ship_package(df.sparkSession)
    fields = df.schema.simpleString()[len("struct<"):-1]

    def run(it):
        import numpy as np

        for pdf in it:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size].copy()
                vecs = np.asarray(encoder(part[text].fillna("").tolist()), dtype=np.float32)
                part[out] = list(vecs)
                yield part

    return df.mapInPandas(run, f"{fields}, {out} array<float>")
