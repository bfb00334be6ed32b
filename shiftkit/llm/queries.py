"""The registered query of each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftkit.llm.align import align_corpus
from shiftkit.llm.chat import format_events, log_of, read_back
from shiftkit.llm.chunks import dedup_substrings
from shiftkit.llm.common import table
from shiftkit.llm.contain import find_contained
from shiftkit.llm.lines import dedup_lines
from shiftkit.llm.mixing import mix_sources, taken_words
from shiftkit.llm.neardup import near_duplicates
from shiftkit.llm.negatives import integer_vectors, mine_negatives
from shiftkit.llm.ordermh import fingerprint_documents
from shiftkit.llm.pii import KINDS, find_personal
from shiftkit.llm.ring import assign_shards
from shiftkit.llm.toxicity import score_toxicity
from shiftkit.llm.vptree import nearest


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to the mix of all sources at 150 % of their sizes."""
    return taken_words(*mix_sources(table(spark, sf_dir, "documents")))


def op2_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 with equal row counts, on a bounded-load ring keyed by doc_id."""
    placed = assign_shards(table(spark, sf_dir, "documents"), n_shards=8)
    return placed.select(
        "doc_id", (F.col("size") + 1).alias("size"), F.col("crc32").alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows with the largest inner product for every 20th row, by exact search (factor one)."""
    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20, relax=1.0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, learnt from the labels that aren't held out."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole document: pattern spans, and all spans with those the field adds."""

    def digest(spans: Column) -> Column:
        order = F.array(*[F.lit(k) for k in KINDS])
        keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("no"), s["end"].alias("end"), s["kind"].alias("kind")))
        return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    found = find_personal(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(digest(F.col("base")), 256).alias("base_sha256"),
        digest(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by 4-word shingle sets of similarity 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 whose texts are control strings, logged, folded, rendered and read back."""
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    formatted = format_events(log_of(own.unionByName(more)), ["turn", "role", "row", "copy", "step"])
    said = F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat(t["roles"], F.lit("\n"), t["texts"], F.lit("\n")))
    learnt = F.array_join("masked", "")
    return read_back(formatted).select(
        "conv_id", F.size("texts").cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars",
    )


def op8_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item it holds."""
    return find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents are dropped from every document."""
    return dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 20 words or 120 bytes that other documents have too are cut out of all but the first."""
    found = dedup_substrings(table(spark, sf_dir, "documents"), min_bytes=120)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", "n_chunks", "n_shared", "n_dropped", "dropped_words", F.length("text").cast("long").alias("kept_chars"),
        F.sha2("text", 256).alias("kept_sha256"), spans.alias("spans"),
    )


def op11_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash of every whole document and of its edited text, and their likeness."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five negatives for each of the five positives of every hundredth vector; every seventh vector's label moves on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = integer_vectors(table(spark, sf_dir, "embeddings").withColumn("label", moved))
    return mine_negatives(vectors, F.col("vec_id") % 100 == 0)


def op13_token_alignment(spark: SparkSession, sf_dir: str, tokenizers: str = "/opt/tokenizers") -> DataFrame:
    """Groups and links of byte-level and piece tokens of every whole document, weighed by the documents that hold each pair."""
    files = [Path(tokenizers, name).read_bytes() for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align_corpus(table(spark, sf_dir, "documents"), *files)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing, op2_ring_sharding, op3_vp_tree, op4_toxicity, op5_personal_data, op6_near_duplicates,
        op7_chat_formatting, op8_containment, op9_line_dedup, op10_substring_dedup, op11_order_minhash, op12_hard_negatives, op13_token_alignment,
    )
}
