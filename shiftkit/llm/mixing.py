"""Mixing sources to target weights: packed blocks, multinomial draws per output shard, permuted block indexes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftkit.llm.common import WORD_PATTERN, ship_by_value
from shiftkit.session import materialize, stored

#: Weights of the sources in code-point order, null last, repeating.
WEIGHTS = (3, 1, 2)
#: Words of a block, slots of an output shard, and the parts a source's stream is laid out in.
BLOCK, SHARD_SLOTS, PARTS = 256, 16384, 4096


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0) -> list[float]:
    """Words to take from each source: ``total`` times all sizes by weight, none above ``most`` times its own size.

    What exceeds a bound is shared again by weight among the sources below theirs, until none is above.
    """
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), total * sum(sizes)
    while open_:
        unit = left / sum(w[i] for i in open_)
        full = [i for i in open_ if w[i] * unit > most * sizes[i]]
        for i in full or open_:
            out[i] = most * sizes[i] if full else w[i] * unit
        if not full:
            break
        open_ -= set(full)
        left -= sum(most * sizes[i] for i in full)
    return out


def _round(x: np.ndarray, key: np.ndarray, half: np.ndarray) -> np.ndarray:
    z = (x + key) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (z ^ (z >> np.uint64(32))) & ((np.uint64(1) << half) - np.uint64(1))


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n), chosen by key, at each index; ``back`` gives its inverse.

    Four Feistel rounds over the next even number of bits; a value outside the range is permuted again
    until it falls inside, which keeps it a permutation.
    """
    x, n, key = (np.asarray(v).astype(np.uint64) for v in (index, n, key))
    half = ((np.ceil(np.log2(np.maximum(n, 2).astype(np.float64) + 1)).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    todo = np.arange(len(x))
    while len(todo):
        h, k, v = half[todo], key[todo], x[todo]
        left, right = v >> h, v & ((np.uint64(1) << h) - np.uint64(1))
        for r in range(3, -1, -1) if back else range(4):
            k_r = k + np.uint64(r * 0xD1B54A32D192ED03 % 2**64)
            left, right = (right ^ _round(left, k_r, h), left) if back else (right, left ^ _round(right, k_r, h))
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def epoch_key(seed: int, source: int, epoch: int) -> int:
    """The permutation key of a source in one pass over its blocks."""
    return int.from_bytes(hashlib.md5(f"{seed}:{source}:{epoch}".encode()).digest()[:7], "big")


def quota(size: int, target: float, seed: int, source: int, block: int) -> dict:
    """How many slots of a source make its target to the word, and how many words the last one takes."""
    words, blocks = int(target), -(-size // block)
    out = {"source_no": source, "size": size, "blocks": blocks, "tail": size - (blocks - 1) * block, "slots": 0, "last": 0, "target": float(target)}
    if not words:
        return out
    epoch, rest = divmod(words, size)
    out |= {"slots": epoch * blocks, "last": block}
    if rest:
        tail_at = int(permute(np.array([blocks - 1]), np.array([blocks]), np.array([epoch_key(seed, source, epoch)]), back=True)[0])

        def first(j: int) -> int:
            return j * block - (block - out["tail"] if tail_at < j else 0)

        j = -(-rest // block)
        j += first(j) < rest
        out |= {"slots": epoch * blocks + j, "last": rest - first(j - 1)}
    return out


def moves(drawn: list[int], wanted: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Where the slots of each source's draw go: (source, from, to, source taken, its first slot).

    Slots beyond a source's quota go, in order, to the sources that were drawn too rarely.
    """
    out = [(s, 0, min(d, w), s, 0) for s, (d, w) in enumerate(zip(drawn, wanted, strict=True)) if min(d, w)]
    short = [[s, d, w] for s, (d, w) in enumerate(zip(drawn, wanted, strict=True)) if d < w]
    for s, (d, w) in enumerate(zip(drawn, wanted, strict=True)):
        at = w
        while at < d:
            b = short[0]
            n = min(d - at, b[2] - b[1])
            out.append((s, at, at + n, b[0], b[1]))
            at, b[1] = at + n, b[1] + n
            if b[1] == b[2]:
                short.pop(0)
    return out


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` as a stored table with a number for each row, and the number's column, a name that ``docs`` doesn't have.

    Rows may be equal in all their columns, so only a number that is written down tells them apart in several reads.
    """
    taken, key = {c.lower() for c in docs.columns}, "row_key"
    while key in taken:
        key += "_"
    return stored(docs.withColumn(key, F.monotonically_increasing_id())), key


def streams(docs: DataFrame, key: str | None = None) -> tuple[DataFrame, list[dict]]:
    """Each document's words and its place in its source's word stream; and the sources in order with their sizes.

    ``doc_id, source, source_no, size, source_size, start, digest, row_key``, the last from ``key``, if given. A stream is laid out in PARTS parts by a
    hash, by doc_id inside, so that places come from sums of parts and a sort inside a part, and a source with a
    third of all rows is spread over all tasks. Brought to the driver: one row a source.
    """
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN)).cast("long").alias("size"), F.xxhash64("text").alias("digest"),
        (F.col(key) if key else F.lit(None)).cast("long").alias("row_key"),
    )
    base = materialize(base.withColumn("part", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(PARTS))))
    sums = base.groupBy("source", "part").agg(F.sum("size").alias("words"))
    known = sorted(((r["source"], r["words"]) for r in sums.groupBy("source").agg(F.sum("words").alias("words")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    spark = docs.sparkSession
    numbers = spark.createDataFrame([(s, i, n) for i, (s, n) in enumerate(known)], "name string, source_no int, source_size long")
    before = sums.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("part")) - F.col("words"))
    parts = before.join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("name"))).select("source_no", "source_size", F.col("source").alias("of"), F.col("part").alias("at"), "before")
    placed = base.join(parts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
    inside = Window.partitionBy("source_no", "part").orderBy("doc_id", "digest", "row_key").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("before") + F.sum("size").over(inside) - F.col("size")
    return placed.withColumn("start", start).select("doc_id", "source", "source_no", "size", "source_size", "start", "digest", "row_key"), [{"source": s, "size": int(n)} for s, n in known]


def draw(spark, quotas: list[dict], seed: int, shard_slots: int) -> DataFrame:
    """The slots of the mix: ``shard, slot, source_no, block, words``.

    Each output shard draws its source counts from a multinomial with the quotas as weights and a seed of its own; a
    source's slots are numbered through all shards; slots beyond a quota are handed to sources below theirs
    (:func:`moves`); slot i of a source takes block permute(i mod blocks), with a new permutation each pass.
    """
    ship_by_value()
    wanted = [q["slots"] for q in quotas]
    total = sum(wanted)
    share = np.array(wanted, dtype=np.float64) / max(1, total)

    def counts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                n = min(shard_slots, total - int(shard) * shard_slots)
                c = np.random.default_rng([seed, int(shard)]).multinomial(n, share)
                yield pd.DataFrame({"shard": int(shard), "source_no": np.arange(len(c), dtype=np.int32), "n": c})

    drawn = spark.range(-(-total // shard_slots)).mapInPandas(counts, "shard long, source_no int, n long").where("n > 0")
    got = {r["source_no"]: r["n"] for r in drawn.groupBy("source_no").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(moves([got.get(s, 0) for s in range(len(wanted))], wanted), "of int, lo long, hi long, source_taken int, first long")
    end = F.sum("n").over(Window.partitionBy("source_no").orderBy("shard"))
    inside = F.sum("n").over(Window.partitionBy("shard").orderBy("source_no")) - F.col("n")
    spans = drawn.withColumn("slot", inside).withColumn("end", end).withColumn("begin", F.col("end") - F.col("n"))
    cut = spans.join(F.broadcast(plan), (F.col("source_no") == F.col("of")) & (F.col("begin") < F.col("hi")) & (F.col("end") > F.col("lo")))
    lo, hi = F.greatest("begin", "lo"), F.least("end", "hi")
    each = cut.select("shard", F.col("source_taken").alias("source_no"), (F.col("slot") - F.col("begin")).alias("shift"), (F.col("first") - F.col("lo")).alias("move"), F.explode(F.sequence(lo, hi - 1)).alias("i"))
    slots = each.select("shard", (F.col("i") + F.col("shift")).alias("slot"), "source_no", (F.col("i") + F.col("move")).alias("i"))
    blocks, tails, lasts, ends = (np.array([q[k] for q in quotas], dtype=np.int64) for k in ("blocks", "tail", "last", "slots"))
    passes = int(max([0, *(-(-q["slots"] // q["blocks"]) for q in quotas if q["blocks"])]))
    keys = np.array([[epoch_key(seed, s, e) for e in range(passes)] for s in range(len(quotas))], dtype=np.uint64).reshape(len(quotas), passes)

    def find(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            s, i = batch["source_no"].to_numpy(np.int64), batch["i"].to_numpy(np.int64)
            n = blocks[s]
            block = permute(i % n, n, keys[s, i // n])
            words = np.where(block == n - 1, tails[s], block_words)
            words = np.where(i == ends[s] - 1, np.minimum(lasts[s], words), words)
            yield pd.DataFrame({"shard": batch["shard"], "slot": batch["slot"], "source_no": s.astype(np.int32), "block": block, "words": words})

    block_words = BLOCK
    return slots.repartition("shard", "slot").mapInPandas(find, "shard long, slot long, source_no int, block long, words long")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0, seed: int = 1, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Mix all sources to their targets; returns (placements, documents).

    Words are the tokens. The documents of a source follow each other in one word stream, which is cut into
    blocks of BLOCK words (the last may be shorter). :func:`draw` fills the slots of the output shards with
    blocks, and slots and documents join by block number. Each source gives exactly the whole words of its target, each
    block is taken ``most`` times at most, and so is each word.

    placements: ``shard, slot, source_no, block, doc_id, digest, row_key, start, doc_start, words``: words
    ``doc_start`` to ``doc_start + words`` of the document that lies at ``start`` of its source's stream; row_key is the
    row's number from the column ``key`` (see :func:`numbered`), null without one. documents: see
    :func:`streams`, with ``target``, a row for each row of ``docs``.

    A null or empty text has no words and is never placed; a null source is a source, the last one; a source
    without words has target 0. Repeated rows are documents of their own. An empty table gives no rows;
    further columns are ignored. Everything is chosen by hashes and seeds, so reruns agree. Sources are
    assumed to be a configured list: one row for each is held by the driver.
    """
    placed, sources = streams(docs, key)
    wanted = targets([s["size"] for s in sources], weights, total, most)
    quotas = [quota(s["size"], t, seed, i, BLOCK) for i, (s, t) in enumerate(zip(sources, wanted, strict=True))]
    spark = docs.sparkSession
    goal = spark.createDataFrame([(i, float(t)) for i, t in enumerate(wanted)], "no int, target double")
    documents = materialize(placed.join(F.broadcast(goal), F.col("source_no") == F.col("no")).drop("no"))
    first, last = F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    pieces = documents.where("size > 0").select("doc_id", "digest", "row_key", F.col("source_no").alias("of"), "start", "size", F.explode(F.sequence(first, last)).alias("at"))
    slots = draw(spark, quotas, seed, SHARD_SLOTS).select("shard", "slot", "source_no", "block", F.col("words").alias("take"))
    begin = F.greatest(F.col("start"), F.col("block") * BLOCK)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * BLOCK + F.col("take"))
    joined = slots.join(pieces, (F.col("source_no") == F.col("of")) & (F.col("block") == F.col("at")))
    placements = joined.where(end > begin).select("shard", "slot", "source_no", "block", "doc_id", "digest", "row_key", "start", (begin - F.col("start")).alias("doc_start"), (end - begin).alias("words"))
    return placements, documents


def taken_words(placements: DataFrame, documents: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: the words the mix takes of each document, repeats counted."""
    taken = placements.groupBy(F.col("source_no").alias("of"), F.col("start").alias("at")).agg(F.sum("words").alias("taken"))
    match = (F.col("source_no") == F.col("of")) & (F.col("start") == F.col("at")) & (F.col("size") > 0)  # a document without words starts where the next one does
    return documents.join(taken, match, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def render(docs: DataFrame, placements: DataFrame, key: str) -> DataFrame:
    """The mixed corpus as documents, with the columns of ``docs`` but ``key``: what is taken of a row, once for each time it is.

    ``docs`` and ``key`` are those of :func:`numbered` that were mixed. Row c of a document holds its words that are taken c times
    or more; whole documents keep their text as it is, pieces apart are joined by a newline. ``n_chars``, if there, is counted anew.
    Documents that the mix doesn't take give no row. Equal rows are documents of their own. Columns may have any names.
    """
    import re

    ship_by_value()
    parts = placements.groupBy(F.col("row_key").alias("of")).agg(F.collect_list(F.struct("doc_start", "words")).alias("taken"))
    word = re.compile(WORD_PATTERN.encode().decode("unicode_escape"))
    names = docs.columns
    at_text, at_chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for row, (text, taken) in enumerate(zip(batch.column(at_text).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)):
                at = [m.span() for m in word.finditer(text)]
                starts, words = (np.array([t[c] for t in taken], dtype=np.int64) for c in ("doc_start", "words"))
                change = np.zeros(len(at) + 1, np.int64)
                np.add.at(change, starts, 1)
                np.add.at(change, starts + words, -1)
                times = np.cumsum(change)[:-1]
                for c in range(1, int(times.max(initial=0)) + 1):
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], (times >= c).astype(np.int8), [0]])))
                    cut = [(int(i), int(j)) for i, j in zip(edge[::2], edge[1::2], strict=True)]
                    rows.append(row)
                    texts.append(text if cut == [(0, len(at))] else "\n".join(text[at[i][0] : at[j - 1][1]] for i, j in cut))
            out = batch.select(range(len(names))).take(pa.array(rows, pa.int64()))
            columns = out.columns
            columns[at_text] = pa.array(texts, columns[at_text].type)
            if at_chars is not None:
                columns[at_chars] = pa.array([len(t) for t in texts], pa.int64()).cast(columns[at_chars].type)
            keep = [i for i, c in enumerate(names) if c != key]
            yield pa.RecordBatch.from_arrays([columns[i] for i in keep], names=[names[i] for i in keep])

    # columns by place, so that no name of theirs meets one of the placements'
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.join(parts, F.col(f"c{names.index(key)}") == F.col("of")).drop("of").mapInArrow(run, docs.drop(key).schema)
