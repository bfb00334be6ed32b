"""Corpus sources and sinks: folders of text files, CSV answer chunks, partitioned result tables."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shiftkit.operators.positional import dense_index


def read_text_dir(spark: SparkSession, paths: str | Sequence[str], null_tokens: Sequence[str] = ()) -> DataFrame:
    """Every ``.txt`` file of one or more folders (sub-folders skipped) as (dir, text_name, text).

    One row per file (``wholetext``); the name is the file name without ``.txt`` and the folder stays
    in the key, so equal names in two folders do not collide. Texts equal to a null token are NULL.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.text(paths, wholetext=True, pathGlobFilter="*.txt")
    path = F.col("_metadata.file_path")
    out = df.select(
        F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("dir"),
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("text_name"),
        F.col("value").alias("text"),
    )
    if null_tokens:
        out = out.withColumn("text", F.when(F.col("text").isin(list(null_tokens)), None).otherwise(F.col("text")))
    return out


def read_csv_table(spark: SparkSession, path: str | Sequence[str], schema: StructType | str | None = None,
                   required: Sequence[str] = ()) -> DataFrame:
    """CSV with a header (one file, a list, or a folder of chunk files), quoted multi-line fields,
    explicit schema when given; fails early if a required column is missing."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    reader = reader.schema(schema) if schema is not None else reader
    df = reader.csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing} in {path}")
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "overwrite") -> None:
    """Write a result table; per-model outputs are partitions, not one file per row."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        # spaces around a value are part of it
        w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    else:
        w.format(fmt).save(path)


def category_file_ids(df: DataFrame, category: str, key: str, out: str = "file_id") -> DataFrame:
    """Per-category file ids ``lower(category without spaces)_<n>``, n = 0.. in key order.

    Numbering uses the distributed dense index, so a large category is spread over many tasks.
    """
    idx = dense_index(df, [key], by=[category], out="_n")
    stem = F.lower(F.regexp_replace(F.col(category), " ", ""))
    return idx.withColumn(out, F.concat(stem, F.lit("_"), F.col("_n").cast("string"))).drop("_n")


def corpus_union(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Union of corpora (name, text) tagged by their folder, as ``(dir, text_name, text)``."""
    out = None
    for d, df in parts:
        t = df.select(F.lit(d).alias("dir"), F.col("text_name").cast("string"), F.col("text"))
        out = t if out is None else out.unionByName(t)
    return out
