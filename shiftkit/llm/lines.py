"""Line deduplication: lines that many documents share are dropped, the rest is put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftkit.llm.common import SPACE, let, lower_ascii
from shiftkit.session import materialize

#: Frequent keys that hold more than one part in HOT_KEYS of all lines of frequent keys are dealt over several tasks; there are fewer than HOT_KEYS.
HOT_KEYS = 10_000


def line_key(line: Column) -> Column:
    """The normalised line: separators stripped at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def text_lines(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def salted(lines: DataFrame, frequent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join of lines with frequent keys (``a, b, n_lines``), with a column ``salt``.

    The lines of a hot key get one of several salts by their row and position, and the key is copied to each of its
    salts. The table of hot keys is broadcast; it has fewer than HOT_KEYS rows whatever the input is, and the copies are at
    most twice as many.
    """
    total = frequent.agg(F.coalesce(F.sum("n_lines"), F.lit(0))).first()[0]
    share = F.floor(F.col("n_lines") * F.lit(HOT_KEYS) / F.lit(max(1, total))).cast("int")
    keys = frequent.select("a", "b", (share + 1).alias("salts"))
    hot = keys.where("salts > 1")
    salt = F.pmod(F.xxhash64("r1", "pos"), F.coalesce("salts", F.lit(1))).cast("int")
    dealt = lines.join(F.broadcast(hot), ["a", "b"], "left").withColumn("salt", salt).drop("salts")
    return dealt, keys.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Drop every line whose key occurs in at least ``min_docs`` documents.

    Lines are exploded with their positions and hashed (128 bits of the key); distinct documents are counted per
    hash, by (hash, document) first, so that the documents of a common line are counted in many tasks. Only the lines of
    frequent hashes are dealt back to their rows, as positions (see :func:`salted` for common lines), and each row is put together
    from the positions that are left.

    Returns ``doc_id, text, n_lines, n_dropped`` for each row: the kept lines joined by newlines, the number of
    lines before, and how many went. Rows of one doc_id are one document in the counts; rows without a doc_id are
    not counted, but lose frequent lines like others. A null text is one empty line. Keys shorter than
    ``min_chars`` code points stay always. An empty table gives no rows; further columns are ignored.
    """
    base = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(7), "doc_id", "text").alias("r2"))
    keys = F.transform(text_lines(F.col("text")), line_key)
    lines = (
        base.select("doc_id", "r1", "r2", F.posexplode(keys).alias("pos", "key")).where(F.length("key") >= min_chars)
        .select("doc_id", "r1", "r2", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(7), "key").alias("b"))
    )
    counts = lines.groupBy("a", "b").agg(F.count_distinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_lines"))
    frequent = materialize(counts.where(F.col("n_docs") >= min_docs).select("a", "b", "n_lines"))
    dealt, wanted = salted(lines.select("r1", "r2", "pos", "a", "b"), frequent)
    drops = (
        dealt.join(wanted, ["a", "b", "salt"], "left_semi")
        .groupBy(F.col("r1").alias("d1"), F.col("r2").alias("d2")).agg(F.collect_set("pos").alias("drops"))
    )
    rows = base.join(drops, (F.col("r1") == F.col("d1")) & (F.col("r2") == F.col("d2")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(text_lines(F.col("text"))) - 1), F.col("drops"))
    kept = let(text_lines(F.col("text")), lambda all_lines: F.array_join(F.transform(left, lambda i: F.get(all_lines, i)), "\n"))
    return rows.select(
        "doc_id",
        F.when(F.col("drops").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("text"),
        F.size(text_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )
