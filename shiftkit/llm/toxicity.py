"""Toxicity: a recurrent network (``gru``) fitted to labelled documents scores every window of every whole text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftkit.llm.common import ship_by_value, utf8
from shiftkit.llm.gru import Network
from shiftkit.llm.gru import train as fit_network

#: Documents are toxic from this score on.
REJECT = 0.3
#: Texts that a task scores at a time.
ROWS = 1024


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the doc_id as text leaves remainder 2 by 4. A null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def body(text: Column) -> Column:
    """What the network reads: the lower-cased text in UTF-8; null as empty."""
    return utf8(F.lower(text))


def train(texts: list[bytes], labels: np.ndarray) -> Network:
    """Fit the network in a task, so that the driver, which has the other stages' plans to hold, needs no memory for it."""
    ship_by_value()

    def fitted(sample):
        net = fit_network(*sample)
        return net.params, net.vocabulary, net.scale

    return Network(*SparkSession.active().sparkContext.parallelize([(texts, labels)], 1).map(fitted).first())


def fit_toxicity(docs: DataFrame, labels: DataFrame, positives: int = 1500, negatives: int = 3000, most_bytes: int = 20_000) -> Network | None:
    """Fit the network on a bounded sample: by hash of doc_id, so many labelled documents of each class that aren't held out.

    Documents above ``most_bytes`` bytes are left out before the sample is drawn, so others take their places (they are
    scored like all others).
    Labels are read where ``toxic`` is 0 or 1; with several for a document the largest counts. Without documents of
    both classes there is nothing to learn: None.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id"), body(F.col("text")).alias("body")).where(F.octet_length("body") <= most_bytes)
    known = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    order = F.xxhash64(F.lit("sample"), "doc_id")
    sample = known.where("toxic = 1").orderBy(order, "doc_id").limit(positives).union(known.where("toxic = 0").orderBy(order, "doc_id").limit(negatives))
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("body").alias("body"), F.max("toxic").alias("toxic"))
    rows = sorted(rows.collect(), key=lambda r: r["doc_id"])
    y = np.array([r["toxic"] for r in rows])
    return train([bytes(r["body"]) for r in rows], y) if len(set(y)) == 2 else None


def toxicity_score(net: Network | None) -> Callable[[Column], Column]:
    """A column function from texts to scores from 0 to 1; without a network all scores are 0."""
    ship_by_value()
    if net is None:
        return lambda text: F.lit(0.0)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            # an Arrow batch has up to 10,000 texts; only a slice of them is copied at a time
            slices = [net.scores(batch.slice(at, ROWS).to_pylist()) for at in range(0, len(batch), ROWS)]
            yield pa.array(np.concatenate([np.zeros(0), *slices]))

    return lambda text: score(body(text))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``, the text alone being the network's input.

    A document's score is that of its highest window, so a passage counts wherever it stands and in a text
    of any length, with spaces or without. Null and empty texts get the score of an empty window. Repeated rows are scored alike; a
    null doc_id stays null. An empty table gives no rows; further columns are ignored.
    """
    score = toxicity_score(fit_toxicity(docs, labels))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= REJECT).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below REJECT."""
    return docs.where(toxicity_score(fit_toxicity(docs, labels))(F.col("text")) < REJECT)
