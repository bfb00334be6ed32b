"""The corpus pipeline: five stages from raw documents to sharded, mixed, clean ones.

Every stage keeps all columns, whatever their names, and gives no rows for an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shiftkit.llm.common import table
from shiftkit.llm.contain import drop_contaminated
from shiftkit.llm.mixing import mix_sources, numbered, render
from shiftkit.llm.neardup import keep_one
from shiftkit.llm.ring import add_shards
from shiftkit.llm.toxicity import drop_toxic
from shiftkit.session import checkpoint_dir, cut_batches, small_batches


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the network is fitted to the labelled ones among ``docs``.

    Null and empty texts score as an empty window; equal rows score alike; without labels of both classes all rows stay.
    The texts are scored when the rows are written, so the session's Arrow batches stay small from here on; :func:`run` puts the limit back.
    """
    cut_batches(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five-word shingles, similarity 0.8 or more) the smallest doc_id stays.

    Texts that are null or without words are no near-duplicates; rows equal in doc_id and text are one.
    """
    return keep_one(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's five-word shingles go.

    Null and empty texts hold nothing; each row is judged by its own text, whatever its doc_id.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources at 150 % of their words: a row for each time a document is taken, with the words taken.

    Texts without words are never taken; a null source is a source; equal rows are documents of their own.
    """
    rows, key = numbered(docs)
    placements, _ = mix_sources(rows, key=key)
    return render(rows, placements, key)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row of the mix with its shard, 0 to 7, and its slot there; null ids, null texts and equal rows have places of their own."""
    return add_shards(docs, n_shards=8)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: A fitted network and pseudorandom draws are not for SQL; tests check each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet to the shared folder and read again."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark):
        for i, (name, stage) in enumerate(STAGES):
            path = f"{folder}/{i}-{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
