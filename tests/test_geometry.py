"""ROC areas, principal components, band join by vantage distances, medians over bounded blocks, NULL groups, exchanges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftkit.operators import metrics, roc, sampling, scores, vectors
from shiftkit.operators.allpairs import band_match, pairwise_median_similarity


def brute_auroc(pos, neg):
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_auroc_and_points_match_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [("a", int(rng.integers(2)), float(rng.integers(12))) for _ in range(400)]
    rows += [(None, int(rng.integers(2)), float(rng.normal())) for _ in range(90)] + [("one", 1, 3.0)] * 3 + [("none", 0, None), ("none", 1, None)]
    rows += [("a", 1, None), ("a", None, 2.0), ("a", 0, float("nan")), ("a", 1, -0.0), ("a", 0, 0.0), ("a", 7, 1.0)]
    df = spark.createDataFrame(rows, "g string, t int, s double")
    got = {r["g"]: tuple(r)[1:] for r in roc.auroc_score(df, "t", "s", ["g"]).collect()}
    assert set(got) == {"a", None, "one", "none"}
    for g in got:
        side = [[s for k, t, s in rows if k == g and t == c and s is not None and s == s] for c in (1, 0)]
        unscored = sum(k == g and t in (0, 1) and (s is None or s != s) for k, t, s in rows)
        assert got[g][:3] == (len(side[0]), len(side[1]), unscored)
        assert got[g][3] == (None if brute_auroc(*side) is None else pytest.approx(brute_auroc(*side), abs=1e-12))
    whole = roc.auroc_score(df.where("g = 'a'"), "t", "s").first()
    assert whole["auroc"] == pytest.approx(got["a"][3])
    points = sorted((r["threshold"], r["tp"], r["fp"], r["tpr"], r["fpr"]) for r in roc.roc_points(df, "t", "s", ["g"]).where("g = 'a'").collect())
    for at, tp, fp, tpr, fpr in points:
        assert tp == sum(t == 1 and s is not None and s >= at for k, t, s in rows if k == "a") and tpr == pytest.approx(tp / got["a"][0])
        assert fp == sum(t == 0 and s is not None and s >= at for k, t, s in rows if k == "a") and fpr == pytest.approx(fp / got["a"][1])
    area = sum((b[4] - a[4]) * (a[3] + b[3]) / 2 for a, b in zip([(0, 0, 0, 0.0, 0.0)] + points[::-1], points[::-1]))
    assert area == pytest.approx(got["a"][3]) and points[0][1:3] == got["a"][:2]
    assert roc.roc_points(df, "t", "s").count() == len({0.0 if s == 0 else s for _, _, s in rows if s is not None and s == s})
    assert roc.auroc_score(df.where("false"), "t", "s", ["g"]).collect() == []


def test_hot_score_is_one_row(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("t"), F.when(F.col("id") % 3 > 0, 1.0).otherwise(F.col("id").cast("double")).alias("s"))
    rows = [(r["t"], r["s"]) for r in df.collect()]
    pos, neg = (np.array([s for t, s in rows if t == c]) for c in (1, 0))
    want = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))
    assert roc.auroc_score(df, "t", "s").first()["auroc"] == pytest.approx(float(want), abs=1e-12)
    assert roc.score_counts(df, "t", "s").count() == len({s for _, s in rows})


def test_components_match_numpy_with_fixed_signs(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(300, 7)) * np.array([5, 3, 2, 1, 1, 1, 1]) @ rng.normal(size=(7, 7)) + 40
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(-1, None)], "k long, v array<double>").repartition(5)
    mean, parts = vectors.principal_components(df, "v", 3)
    values, vecs = np.linalg.eigh(np.cov(m.T, bias=True))
    assert np.allclose(mean, m.mean(axis=0))
    for p, v in zip(parts, vecs[:, ::-1].T):
        assert abs(p @ v) == pytest.approx(1, abs=1e-9) and p[np.abs(p).argmax()] > 0
    got = {r["k"]: r["pc"] for r in vectors.pca_project(df, "v", 3).collect()}
    assert got[-1] is None and np.allclose([got[i] for i in range(300)], (m - m.mean(axis=0)) @ parts.T, atol=1e-8)
    again = vectors.principal_components(df.repartition(2), "v", 3)[1]
    assert np.allclose(again, parts, atol=1e-9)
    assert vectors.pca_project(df.where("false"), "v").collect() == []


def _clustered(spark, n, clusters=40, dim=16):
    """Tight clusters, in directions far from each other."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(clusters, dim)) * 3
    data = [(i, (centres[i % clusters] + 0.05 * rng.normal(size=dim)).tolist()) for i in range(n)]
    return data, spark.createDataFrame(data, "k long, v array<double>")


@pytest.mark.parametrize("metric, target, width", [("euclidean", 0.3, 0.1), ("cosine", 0.0005, 0.0003)])
def test_band_join_leaves_out_most_pairs_of_clusters(spark, metric, target, width):
    data, df = _clustered(spark, 900)
    far = spark.createDataFrame([(5000 + i, [1000.0 + 9 * i] + [-500.0] * 15) for i in range(20)], "k long, v array<double>")
    a, b, stats = df.where("k % 2 = 0").union(far), df.where("k % 2 = 1"), {}
    # neighbours of clusters: the partners of a cluster's rows are in the clusters with odd numbers, moved next to it
    b = b.select("k", F.transform("v", lambda x: x).alias("v")).union(df.where("k % 4 = 0").select((F.col("k") + 10_000).alias("k"), "v"))
    got = {r["key_a"]: r["key_b"] for r in band_match(a, b, "k", "v", target, width, metric, block_size=32, stats=stats).collect()}
    left, right = a.collect(), sorted(b.collect())
    R = np.array([r["v"] for r in right])
    want = {}
    for r in left:
        x = np.array(r["v"])
        d = np.linalg.norm(R - x, axis=1) if metric == "euclidean" else 1 - R @ x / np.linalg.norm(R, axis=1) / np.linalg.norm(x)
        hit = np.flatnonzero(np.abs(d - target) < width)
        if len(hit):
            want[r["k"]] = right[hit[0]]["k"]
    assert got == want and len(want) > 100
    assert stats["all"] == len(left) * len(right) and stats["pairs"] < 0.25 * stats["all"]


def test_median_multiplies_few_pairs_of_clusters(spark):
    data, df = _clustered(spark, 800)
    stats = []
    got = pairwise_median_similarity(df, [], "k", "v", block_size=32, bins=64, max_candidates=500, stats=stats).first()[0]
    m = np.array([v for _, v in data])
    m /= np.linalg.norm(m, axis=1)[:, None]
    s = (m @ m.T)[np.triu_indices(len(m), k=1)]
    assert got == pytest.approx(float(np.median(s)), abs=1e-12)
    assert len(stats) >= 2 and stats[0] < 0.6 and stats[-1] < 0.2 and stats == sorted(stats, reverse=True), stats


def test_null_is_a_group_everywhere(spark):
    rng = np.random.default_rng(3)
    rows = [(i, None if i % 3 == 0 else i % 3, float(rng.integers(8)), [float(x) for x in rng.normal(size=3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "k long, pool int, x double, v array<double>")
    x = {p: [r[2] for r in rows if r[1] == p] for p in (None, 1, 2)}
    d = {r["pool"]: r for r in metrics.describe(df, "x", ["pool"]).collect()}
    assert set(d) == set(x) and all(d[p]["q50"] == pytest.approx(np.median(x[p])) and d[p]["count"] == 30 for p in x)
    for bins in (scores.equal_width_histogram(df, "x", ["pool"], 5), scores.integer_edge_histogram(df, "x", ["pool"], 0, 8)):
        n = {}
        for r in bins.collect():
            n[r["pool"]] = n.get(r["pool"], 0) + r["n"]
        assert n == {p: 30 for p in x}
    draws = sampling.bootstrap_draws(df.select("k", "pool"), "k", ["pool"], iters=4, seed=1)
    n = {(r["pool"], r["iter"]): r["n"] for r in draws.groupBy("pool", "iter").agg(F.sum("weight").alias("n")).collect()}
    assert n == {(p, i): 30 for p in x for i in range(4)}
    assert {r["pool"] for r in vectors.sample_metrics(df, ["pool"], "k", "v", iters=2, size=10).collect()} == set(x)
    sd = {r["pool"]: r["separation_sd"] for r in vectors.separation_bootstrap(df, ["pool"], "k", "v", iters=5, draws="multinomial").collect()}
    assert set(sd) == set(x) and all(v > 0 for v in sd.values())


def test_confusion_of_many_labels(spark):
    df = spark.range(500).select((F.col("id") % 60).alias("t"), (F.col("id") % 45).alias("p"))
    got = {(r["true_label"], r["pred_label"]): r["n"] for r in metrics.confusion_matrix(df, "t", "p").collect()}
    want = {(t, p): sum(i % 60 == t and i % 45 == p for i in range(500)) for t in range(60) for p in range(60)}
    assert got == want


def test_later_exchanges_keep_their_conversation(spark, tmp_path):
    from shiftkit.plans.registry import QUERIES

    turns = [(7, t, "user" if t % 2 == 0 else "assistant", f"text {t}") for t in range(11)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(7, "whole", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    full = [tuple(r) for r in QUERIES["profiles_with_updates"](spark, str(tmp_path)).collect()]
    assert sorted(full) == [(7, "whole", 0, "text 0", "text 2", "text 4"), (7, "whole", 1, "text 6", "text 8", "text 10")]
    open_ = QUERIES["unanswered_questions"](spark, str(tmp_path)).collect()
    assert open_ == []
    patched = QUERIES["patch_answers"](spark, str(tmp_path)).where("variable = 'answer.clean_7'").collect()
    assert sorted((r["part"], r["value"]) for r in patched) == [(0, "text 0"), (1, "text 6")]


def test_a_round_outside_the_list_is_an_error(spark):
    with pytest.raises(Exception, match="unlisted pool"):
        scores.pivot_listed(spark.createDataFrame([(1, 10, 0.5)], "rank int, pool int, distance double"), ["rank"], "pool", [1, 2], F.first("distance")).collect()


def _separable(spark, n=160):
    rng = np.random.default_rng(12)
    words = [f"common{i}" for i in range(20)]
    data = []
    for i in range(n):
        t = list(rng.choice(words, 12)) + (["granted"] * 3 if i % 2 else ["refused"] * 3)
        data.append((i, " ".join(t), " ".join(rng.choice(words, 15)), i % 2, "train" if i < n * 3 // 4 else "test"))
    return spark.createDataFrame(data, "k int, clear string, noise string, y int, split string")


def test_classifiers_on_separable_texts(spark):
    from shiftkit.operators.learn import classifier_accuracy

    got = classifier_accuracy(_separable(spark), "clear", "y", "split", ["logistic_regression", "random_forest", "neural_network", "gbt"], vocab_size=50).collect()
    assert [(r["method"], r["tp"], r["fp"], r["fn"], r["tn"], r["accuracy"], r["beats_majority"]) for r in got] == [
        (m, 20, 0, 0, 20, 1.0, True) for m in ("logistic_regression", "random_forest", "neural_network", "gbt")]


def test_auroc_of_variants(spark):
    from shiftkit.operators.learn import variant_auroc, variant_scores

    df = _separable(spark)
    got = {r["variant"]: r for r in variant_auroc(df, ["clear", "noise"], "y", "split", vocab_size=50).collect()}
    assert (got["clear"]["auroc"], got["clear"]["auroc_score"], got["clear"]["auroc_area"]) == (1.0, 1.0, 1.0)
    assert 0.2 < got["noise"]["auroc_score"] < 0.8 and got["noise"]["auroc_score"] == pytest.approx(got["noise"]["auroc_area"], abs=1e-9)
    assert all(r["tp"] + r["fn"] == 20 == r["tn"] + r["fp"] for r in got.values())
    scored = variant_scores(df, ["noise"], "y", "split", vocab_size=50).collect()
    assert got["noise"]["auroc_score"] == pytest.approx(brute_auroc([r["score"] for r in scored if r["label"]], [r["score"] for r in scored if not r["label"]]))
    one = variant_auroc(df.where("y = 1 or split = 'train'"), ["clear"], "y", "split", vocab_size=50).first()
    assert one["auroc"] is None and one["auroc_score"] is None


def test_the_network_keeps_rows_sparse(spark, monkeypatch):
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import SparseVector, Vectors

    from shiftkit.operators import network
    from shiftkit.operators.learn import make_classifier

    width, kept, found = 5_000, [], network.minimise

    def watched(f, x, steps):
        f(x)
        kept.extend(i.memSize() + i.diskSize() for i in spark.sparkContext._jsc.sc().getRDDStorageInfo())
        return found(f, x, 25)

    monkeypatch.setattr(network, "minimise", watched)
    rows = [(SparseVector(width, [i % 2, 2 + i], [1.0, 2.0]), float(i % 2)) for i in range(300)] + [(Vectors.dense([0.0] * width), 0.0), (SparseVector(width, [], []), 0.0)]
    df = spark.createDataFrame(rows, ["features", "label"])
    got = make_classifier("neural_network", width).fit(df).transform(df).select("label", "prediction", vector_to_array("rawPrediction").alias("r")).collect()
    # dense rows would be 12 MB
    assert sum(kept) < 1_000_000 and kept
    assert len(got) == 302 and all(r["prediction"] == (r["r"][1] > r["r"][0]) for r in got) and sum(r["label"] == r["prediction"] for r in got) >= 300


def test_the_networks_gradient_is_that_of_its_loss():
    from shiftkit.operators import network

    rng = np.random.default_rng(4)
    width, hidden, n = 6, 3, 11
    x = rng.normal(size=(n, width)).astype(np.float32)
    y = rng.integers(0, 2, n)
    at, cols, values = network.sparse_parts([(None, r) for r in x])
    flat = rng.normal(size=(width + 1) * hidden + (hidden + 1) * 2)
    total = network.loss_and_gradient(flat, width, hidden, [(y, at, cols, values)])
    assert total[-1] == n
    for k in range(len(flat)):
        near = [network.loss_and_gradient(flat + s * np.eye(len(flat))[k], width, hidden, [(y, at, cols, values)])[-2] for s in (1e-4, -1e-4)]
        assert total[k] == pytest.approx((near[0] - near[1]) / 2e-4, abs=1e-3)


def test_a_median_block_travels_once_a_tile_and_a_tile_sends_one_histogram(spark, monkeypatch):
    from shiftkit.operators import allpairs

    written, found = [], allpairs.stored
    monkeypatch.setattr(allpairs, "stored", lambda df: (lambda t: (written.append((set(t.columns), t)), t)[1])(found(df)))
    rng = np.random.default_rng(2)
    data = [(i, rng.normal(size=8).tolist()) for i in range(600)]
    df = spark.createDataFrame(data, "k long, v array<double>")
    for rows in (8192, 100):
        monkeypatch.setattr(allpairs, "TILE_ROWS", rows)
        written.clear()
        got = pairwise_median_similarity(df, [], "k", "v", block_size=16, bins=64).first()[0]
        m = np.array([v for _, v in data])
        m /= np.linalg.norm(m, axis=1)[:, None]
        assert got == pytest.approx(float(np.median((m @ m.T)[np.triu_indices(600, k=1)])), abs=1e-12)
        if rows == 8192:  # one tile: a row for each bin, whatever the number of block pairs
            hist = next(t for c, t in written if "bin" in c)
            assert hist.where("bin >= 0").count() <= 64 and hist.where("bin = -2").count() > 500


def test_feature_vectors_are_dealt_to_the_cores(spark, monkeypatch):
    from shiftkit.operators import learn

    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(learn, "ROWS_A_PARTITION", 30)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        for n, parts in ((20, cores), (30 * cores, cores), (160, cores * -(-160 // (30 * cores)))):
            vec, _ = learn.featurize(_separable(spark, n), "clear", "y", "split", 50)
            assert vec.rdd.getNumPartitions() == parts and vec.count() == n
            vec.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
