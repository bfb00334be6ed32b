"""Benchmark decontamination: size-partitioned MinHash containment search, checked by exact shingle containment.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftkit.llm.common import let, words

#: A sketch or item index of at most this many rows is broadcast (16 bytes a row); a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def shingles(text: Column, n: int = 5, shorter: tuple[int, ...] = ()) -> Column:
    """Distinct hashes of a text's n-word shingles, lower-cased, and of those of each length in ``shorter``.

    A text of fewer words is one shingle of all its words; without words, or null, it has none.
    """
    def grams(w: Column, k: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))

    def of(w: Column) -> Column:
        none = F.array().cast("array<bigint>")
        base = F.when(F.size(w) >= n, grams(w, n)).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(none)
        return F.concat(base, *[F.when(F.size(w) >= k, grams(w, k)).otherwise(none) for k in shorter]) if shorter else base

    return F.array_distinct(let(words(F.lower(text)), of))


def short_lengths(items: DataFrame, n: int) -> tuple[int, ...]:
    """The numbers of words below n that items have: at most n - 1 numbers."""
    size = items.select(F.size(words(F.lower(F.col("text")))).alias("k"))
    return tuple(sorted(r["k"] for r in size.where((F.col("k") > 0) & (F.col("k") < n)).distinct().collect()))


def sketch(items: DataFrame, threshold: float) -> DataFrame:
    """MinHash sketches of the items (``item_id, grams, size``), partitioned by size: ``item_id, gram``.

    Items of 2^p to 2^(p+1)-1 shingles form partition p. Its sketch is the bottom-k MinHash: the k shingles
    with the smallest values under one fixed random permutation. A document that contains ``threshold`` of an
    item lacks at most (1 - threshold) of its shingles, so with k one more than the largest number that
    partition p may lack, at least one sketch shingle is in each such document, however long it is: no
    pair is lost, unlike with a MinHash of whole documents, where a short item in a long text has a
    similarity near 0.
    """
    top = F.pow(F.lit(2), F.floor(F.log2("size")) + 1) - 1
    k = F.floor(top * (1 - threshold) + 1e-9).cast("int") + 1
    ranked = F.array_sort(F.transform("grams", lambda g: F.struct(F.xxhash64(F.lit("permute"), g).alias("rank"), g.alias("gram"))))
    return items.select("item_id", F.explode(F.slice(ranked, F.lit(1), k)).alias("s")).select("item_id", F.col("s.gram").alias("gram"))


def bounded(df: DataFrame) -> DataFrame:
    """Mark a table for broadcast if it is counted to be small; else Spark shuffles it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def find_contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """All pairs where a document holds at least ``threshold`` of an item's distinct n-word shingles.

    First the sketches (see :func:`sketch`) are looked up among the shingles of every whole document, which
    gives candidate pairs; then each candidate's item shingles are counted among those of the document.
    Returns ``doc_id, item_id, n_shingles, n_found, containment``, one row per pair.

    Rows that repeat a doc_id are searched apart and give one row, with the most shingles found in any of
    them; rows that repeat an item_id likewise. Null and empty texts match nothing; a null doc_id or item_id is
    an id like any other. An item of fewer than n words is one shingle of its own length, and is found in each document that has these
    words in a row. Empty tables give no rows; further columns are ignored.
    """
    enough = contained_rows(docs, items, threshold, n, short_lengths(items, n))
    best = enough.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_found") / F.col("n_shingles")).alias("c"), "n_shingles", "n_found")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_shingles", "b.n_found", F.col("b.c").alias("containment"))


def contained_rows(docs: DataFrame, items: DataFrame, threshold: float, n: int, shorter: tuple[int, ...] = ()) -> DataFrame:
    """The pairs of :func:`find_contained` by row, ``doc_id, row, item_id, n_shingles, n_found``; row is the digest of doc_id and text.

    Items of fewer than n words are looked for inside documents if their lengths are in ``shorter``; else they match only a
    document that consists of their words.
    """
    known = (
        items.select("item_id", shingles(F.col("text"), n).alias("grams"))
        .withColumn("size", F.size("grams")).where("size > 0")
        .withColumn("item", F.xxhash64("item_id", "grams"))
    )
    probes = bounded(sketch(known.select(F.col("item").alias("item_id"), "grams", "size"), threshold).select(F.col("item_id").alias("item"), F.col("gram").alias("probe")).distinct())
    texts = docs.select("doc_id", "text").withColumn("row", F.xxhash64("doc_id", "text"))
    pairs = (
        texts.select("row", F.explode(shingles(F.col("text"), n, shorter)).alias("gram"))
        .join(probes, F.col("gram") == F.col("probe")).select("row", "item").distinct()
    )
    whole = known.select("item", "item_id", "size", "grams").dropDuplicates(["item"])
    checks = pairs.join(whole, "item").groupBy(F.col("row").alias("found_row")).agg(F.collect_list(F.struct("item_id", "size", "grams")).alias("wanted"))
    held = texts.dropDuplicates(["row"]).join(checks, F.col("row") == F.col("found_row")).select("doc_id", "row", shingles(F.col("text"), n, shorter).alias("have"), F.explode("wanted").alias("w"))
    counted = held.select("doc_id", "row", "w.item_id", F.col("w.size").cast("long").alias("n_shingles"), F.size(F.array_intersect("have", "w.grams")).cast("long").alias("n_found"))
    return counted.where(F.col("n_found") >= F.col("n_shingles") * F.lit(threshold) - F.lit(1e-9))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item as :func:`find_contained` asks.

    An item of fewer than n words takes out only documents that consist of its words: a few common words in a row
    are no sign of a leak. Null and empty texts stay; an empty table gives no rows.
    Each row is judged by its own text: clean rows of a doc_id that contaminated rows have too, or of none, stay.
    """
    found = contained_rows(docs, items, threshold, n).select(F.col("doc_id").alias("contaminated_id"), F.col("row").alias("contaminated_row")).distinct()
    match = docs["doc_id"].eqNullSafe(found["contaminated_id"]) & (F.xxhash64(docs["doc_id"], docs["text"]) == found["contaminated_row"])
    return docs.join(found, match, "left_anti")
