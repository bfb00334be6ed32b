"""Chunk-wise prompt runs with progress kept on disk (Structured Streaming).

A folder of files is read as a stream, so many bytes per micro-batch, with ``availableNow`` so the
run stops when the folder is drained. Each batch's prompts are written under its batch id with
overwrite, so a batch replayed after a failure rewrites the same files (idempotent), and the
checkpoint records which chunks are done: a restarted run continues where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftkit.session import checkpoint_dir


KINDS = ("clean", "redact", "improve")


def prompts_for(batch: DataFrame) -> DataFrame:
    """Prompt rows of a batch: each user turn with a text gives one prompt of each kind (clean, redact, improve)."""
    from shiftkit.operators.prompts import build_prompts

    name = F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    users = batch.where(F.col("role") == "user").select(name.alias("name"), "text")
    return build_prompts(users, "name", "text", KINDS, ["persona"], ["model"])


def run_incremental(spark: SparkSession, source: str, out_dir: str, ckpt: str, schema,
                    batch_bytes: int = 256 << 20) -> None:
    """Drain the parquet files at ``source`` in batches of about ``batch_bytes`` and write their prompts by kind."""
    stream = (
        spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes)).option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet").parquet(source)
    )

    def sink(batch: DataFrame, batch_id: int) -> None:
        prompts_for(batch).write.mode("overwrite").partitionBy("kind").parquet(f"{out_dir}/batch_id={batch_id}")

    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()


def incremental_prompt_run(spark: SparkSession, source: str, batch_bytes: int = 256 << 20) -> DataFrame:
    """Run the stream over the files at ``source`` (they are read where they are) and return the prompt table, which
    lies in the shared checkpoint folder with the progress of the run."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/incremental-{uuid.uuid4().hex}"
    run_incremental(spark, source, f"{base}/prompts", f"{base}/progress", spark.read.parquet(source).schema, batch_bytes)
    return spark.read.parquet(f"{base}/prompts").select("prompt_id", "kind", "text_name", "agent", "model", "prompt")
