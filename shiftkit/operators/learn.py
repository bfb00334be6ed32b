"""Label prediction from text with Spark ML: bag-of-words features, classifiers by name, accuracy
and AUROC per text variant. Fits are distributed by Spark ML; nothing is trained on the driver."""

from __future__ import annotations

from typing import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import CountVectorizer, RegexTokenizer, StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftkit.operators.network import SparseNetwork
from shiftkit.operators.text import WORD_PATTERN


def bag_of_words(text: str, vocab_size: int = 5000, out: str = "features") -> list:
    """Lower-cased word tokens (two or more letters/digits), English stop words out, the
    ``vocab_size`` most frequent terms of the training data."""
    return [
        RegexTokenizer(inputCol=text, outputCol="_tok", pattern=WORD_PATTERN, gaps=False, toLowercase=True),
        StopWordsRemover(inputCol="_tok", outputCol="_tok2"),
        CountVectorizer(inputCol="_tok2", outputCol=out, vocabSize=vocab_size),
    ]


# Classifier names as the reference spells them, with short aliases.
CLASSIFIER_NAMES = {
    "logistic_regression": "logistic", "logistic": "logistic",
    "random_forest": "forest", "forest": "forest",
    "neural_network": "mlp", "mlp": "mlp",
    "gbt": "gbt",
}


def make_classifier(method: str, n_features: int, label: str = "label"):
    """A classifier by name, Spark ML's but for the network (scikit-learn-like defaults: 100 trees, one hidden layer of 100)."""
    kind = CLASSIFIER_NAMES.get(method)
    if kind == "logistic":
        return LogisticRegression(labelCol=label, featuresCol="features", maxIter=100)
    if kind == "forest":
        return RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=100, seed=1)
    if kind == "mlp":
        return SparseNetwork(n_features, hidden=100, label=label, max_iter=100, seed=1)
    if kind == "gbt":
        return GBTClassifier(labelCol=label, featuresCol="features", maxIter=20, seed=1)
    raise ValueError(f"unknown classifier {method!r}; known: {sorted(CLASSIFIER_NAMES)}")


#: Rows of a partition of the feature vectors, at most about.
ROWS_A_PARTITION = 10_000


def featurize(df: DataFrame, text: str, label: str, split: str, vocab_size: int):
    """Bag-of-words vectors of all rows, fitted on the train rows only, and the vocabulary's size. The vectors are
    persisted, so every classifier iteration reads them instead of the texts; the caller unpersists them.

    Rows are spread over the session's cores first: a fit goes over them a hundred times, and a table may be one file. A core gets
    more than one partition from ROWS_A_PARTITION rows on: in each step of a tree, every partition sends its sums for all features.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism
    data = df.select(text, F.col(label).cast("double").alias("label"), split).fillna({text: ""})
    data = data.repartition(parts * max(1, -(-data.count() // (parts * ROWS_A_PARTITION))))
    train = data.where(F.col(split) == "train")
    feats = Pipeline(stages=bag_of_words(text, vocab_size)).fit(train)
    n = len(feats.stages[-1].vocabulary)
    vec = feats.transform(data).select("features", "label", split)
    vec = vec.persist()
    return vec, max(n, 1)


def _scored(vec: DataFrame, n: int, split: str, method: str) -> DataFrame:
    """The test rows with the prediction of a classifier fitted to the train rows."""
    model = make_classifier(method, n).fit(vec.where(F.col(split) == "train"))
    return model.transform(vec.where(F.col(split) == "test"))


def _in_parallel(fn, items):
    """Run independent fits from driver threads: each fit is a chain of small Spark jobs, and
    submitting them together keeps the executors busy (Spark schedules concurrent jobs)."""
    from concurrent.futures import ThreadPoolExecutor

    items = list(items)
    with ThreadPoolExecutor(max_workers=max(1, min(4, len(items)))) as pool:
        return list(pool.map(fn, items))


def confusion_counts():
    """The four aggregates of 0/1 columns ``label`` and ``prediction``."""
    t, p = F.col("label") == 1, F.col("prediction") == 1
    return [F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn")]


def classifier_accuracy(df: DataFrame, text: str, label: str, split: str, methods: Sequence[str],
                        vocab_size: int = 5000) -> DataFrame:
    """Train each named classifier on the train split and report, on the test split: accuracy, the four confusion counts, and
    whether it beats always naming the larger class."""
    vec, n = featurize(df, text, label, split, vocab_size)

    def one(m):
        hit = F.avg((F.col("label") == F.col("prediction")).cast("double"))
        share = F.avg("label")
        row = _scored(vec, n, split, m).agg(hit.alias("accuracy"), *confusion_counts(), (hit > F.greatest(share, 1 - share)).alias("beats_majority")).first()
        return (m, *row)

    try:
        # one after the other: each fit keeps a form of the train rows of its own
        rows = [one(m) for m in methods]
    finally:
        vec.unpersist()
    return df.sparkSession.createDataFrame(rows, "method string, accuracy double, tp long, fp long, fn long, tn long, beats_majority boolean")


def variant_scores(df: DataFrame, variants: Sequence[str], label: str, split: str, method: str = "gbt", vocab_size: int = 5000) -> DataFrame:
    """For each text variant: bag-of-words + classifier fitted to the train rows; the test rows with their hard prediction and
    score: (variant, label, prediction, score)."""
    from pyspark.ml.functions import vector_to_array

    from shiftkit.session import stored

    # read by a vocabulary and by a transformation of each variant, so what the texts were made from runs once
    df = stored(df.select(*variants, label, split))

    def one(v):
        vec, n = featurize(df, v, label, split, vocab_size)
        try:
            return stored(_scored(vec, n, split, method).select(
                F.lit(v).alias("variant"), F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"),
                vector_to_array("rawPrediction")[1].alias("score")))
        finally:
            vec.unpersist()

    out = None
    for scored in _in_parallel(one, variants):
        out = scored if out is None else out.union(scored)
    return out


def variant_auroc(df: DataFrame, variants: Sequence[str], label: str, split: str, method: str = "gbt",
                  vocab_size: int = 5000) -> DataFrame:
    """AUROC of each text variant's test rows (:func:`variant_scores`): of the hard predictions (the reference's measure), and of the
    scores by rank sums and as the area under their ROC points, with the confusion counts.

    (variant, tp, fp, fn, tn, auroc, auroc_score, auroc_area). A test split with one class has no AUROC (NULL).
    """
    from pyspark.sql import Window

    from shiftkit.operators.roc import auroc_score, roc_points

    scored = variant_scores(df, variants, label, split, method, vocab_size)
    counts = scored.groupBy("variant").agg(*confusion_counts())
    ranks = auroc_score(scored, "label", "score", ["variant"]).select("variant", F.col("auroc").alias("auroc_score"))
    # the trapezoids between neighbouring thresholds; the curve begins at (0, 0)
    w = Window.partitionBy("variant").orderBy(F.desc("threshold"))
    step = roc_points(scored, "label", "score", ["variant"]).select(
        "variant", "tpr", "fpr", F.lag("tpr", 1, 0.0).over(w).alias("_t"), F.lag("fpr", 1, 0.0).over(w).alias("_f"))
    area = step.groupBy("variant").agg(F.sum((F.col("fpr") - F.col("_f")) * (F.col("tpr") + F.col("_t")) / 2).alias("auroc_area"))
    hard = (F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")) + F.try_divide(F.col("tn"), F.col("tn") + F.col("fp"))) / 2
    every = df.sparkSession.createDataFrame([(v,) for v in variants], "variant string")
    joined = every.join(counts, "variant", "left").fillna(0, ["tp", "fp", "fn", "tn"]).join(ranks, "variant", "left").join(area, "variant", "left")
    return joined.select("variant", "tp", "fp", "fn", "tn", hard.alias("auroc"), "auroc_score", "auroc_area")
