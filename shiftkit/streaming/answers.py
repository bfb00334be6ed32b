"""Answers merged as they arrive: keyed state in Structured Streaming.

A stream of answer rows (key columns, ``value``, ``at``) keeps for each key the last answer that isn't NULL; a key that has got none for
a time is reported as open. Micro-batches write what has changed under their batch id with overwrite, so a batch replayed after a
failure rewrites the same rows, and a restarted run goes on from its checkpoint with the state it had.
"""

from __future__ import annotations

import json
from typing import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shiftkit.session import ship_package

ANSWERED, OPEN = "answered", "open"
#: Times (microseconds) before and after all others.
NEVER, FAR = -(2**62), 2**62


def merge_answers(rows: DataFrame, keys: Sequence[str], value: str = "value", at: str = "at", wait: str = "1 hour", late: str = "10 minutes", buckets: int = 1024) -> DataFrame:
    """What changes in the answers of a stream: (keys..., value, at, status), one row at most for a key and micro-batch.

    Of a key's answers that aren't NULL the one with the latest ``at`` counts, of several at one time the largest; so repeated
    rows change nothing, nor do NULL ones or older ones that come later. A key whose first row is ``wait`` old by the stream's watermark
    without an answer is reported once with status ``open``; an answer after that still counts. Rows more than ``late`` behind the
    watermark are dropped, as Spark does, and rows without ``at``; NULL is a key like any other.

    Keys are dealt to ``buckets`` by their hash, and Spark keeps the state and the timeout of a bucket: a call to Python costs milliseconds, so
    there is one for a bucket, not one for each key. A bucket holds its share of the keys in memory while it changes; the number of
    buckets stays as it is while a checkpoint is used. Keys are of types that a string holds exactly.
    """
    ship_package(rows.sparkSession)
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    names = list(keys)
    fields = {f.name: f.dataType for f in rows.schema}

    def change(_bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # of each key: the answer, its time (NEVER while there is none), the first row's time, whether it was reported as open, when it will be
        held = {tuple(key): (v, *rest) for key, v, *rest in json.loads(state.get[0])} if state.exists else {}
        now, seen, changed = state.getCurrentWatermarkMs(), set(), {}
        for batch in () if state.hasTimedOut else batches:
            for key, v, t in zip(map(tuple, batch["_k"]), batch["_v"], map(int, batch["_t"])):
                answer, answer_at, asked, told, due = held.get(key, ("", NEVER, FAR, False, None))
                if v is not None and (answer_at == NEVER or (t, v) > (answer_at, answer)):
                    answer, answer_at, changed[key] = v, t, ANSWERED
                held[key] = answer, answer_at, min(asked, t), told, due
                seen.add(key)
        for key, (answer, answer_at, asked, told, due) in held.items():
            if key in seen:
                # a timeout lies behind the watermark
                held[key] = answer, answer_at, asked, told, max(asked // 1000 + wait_ms, now + 1) if answer_at == NEVER and not told else None
            elif due is not None and due < now:
                held[key], changed[key] = (answer, answer_at, asked, True, None), OPEN
        state.update((json.dumps([(key, *rest) for key, rest in held.items()]),))
        waiting = [due for *_, due in held.values() if due is not None]
        if waiting:
            state.setTimeoutTimestamp(max(min(waiting), now + 1))
        if changed:
            of = [held[key] for key in changed]
            times = [pd.Timestamp(asked if answer_at == NEVER else answer_at, unit="us") for _, answer_at, asked, _, _ in of]
            yield pd.DataFrame({"_k": [list(key) for key in changed], "value": [r[0] for r in of], "at": times, "status": list(changed.values())})

    timed = rows.where(F.col(at).isNotNull()).withWatermark(at, late)
    # keys as strings, in which NULL and long integers stay what they are in pandas; microseconds, so that times compare exactly in tasks
    slim = timed.select(F.array(*[F.col(k).cast("string") for k in names]).alias("_k"), F.col(value).cast("string").alias("_v"), F.unix_micros(at).alias("_t"), at)
    dealt = slim.withColumn("_bucket", F.pmod(F.xxhash64("_k"), F.lit(buckets)))
    made = dealt.groupBy("_bucket").applyInPandasWithState(
        change, "_k array<string>, value string, at timestamp, status string", "held string", "update", GroupStateTimeout.EventTimeTimeout)
    return made.select(*[F.col("_k")[i].cast(fields[k]).alias(k) for i, k in enumerate(names)], F.when(F.col("status") == ANSWERED, F.col("value")).alias("value"), "at", "status")


def run_merge(spark: SparkSession, source: str, out_dir: str, ckpt: str, schema, keys: Sequence[str], wait: str = "1 hour", late: str = "10 minutes",
              files_per_batch: int = 1) -> None:
    """Drain the Parquet files at ``source`` (in the order they came) and write the changes of each micro-batch under its id."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(source)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    q = merge_answers(stream, keys, wait=wait, late=late).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()


def current_answers(spark: SparkSession, out_dir: str, keys: Sequence[str]) -> DataFrame:
    """The state of all keys that have been reported: (keys..., value, at, status), from the last batch of each."""
    changes = spark.read.parquet(out_dir)
    last = F.max_by(F.struct("value", "at", "status"), "batch_id").alias("_l")
    return changes.groupBy(*keys).agg(last).select(*keys, "_l.value", "_l.at", "_l.status")


def open_questions(current: DataFrame) -> DataFrame:
    """The keys that timed out without an answer."""
    return current.where(F.col("status") == OPEN)
