"""Document fingerprints by order MinHash: minimal occurrence-numbered k-mers, in text order, hashed as tuples."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftkit.llm.common import ship_by_value
from shiftkit.session import stored

#: Code points of a k-mer, k-mers of a tuple, and tuples of a fingerprint.
K, PICKS, SLOTS = 16, 2, 64
#: Pairs that are hashed at once; a longer text is taken block by block.
BLOCK = 4096
#: Hex digits of a slot.
DIGITS = 4
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def kmer_keys(points: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit key of the ``k`` code points from each place on; one key, of the whole text, where it is shorter.

    Keys of windows whose length is a power of two come from those of half the length, so a text costs log2(k) passes.
    """
    k = min(k, len(points))
    if not k:
        return np.zeros(0, np.uint64)
    window, length, out, covered = (points + np.uint64(1)) * np.uint64(_STEP), 1, None, 0
    while True:
        if k & length:
            n = len(points) - covered - length + 1
            out = window[:n] if out is None else out[:n] * np.uint64(pow(_BASE, length, 2**64)) + window[covered : covered + n]
            covered += length
        if covered == k:
            return _mix(out + np.uint64(k))
        window = window[:-length] * np.uint64(pow(_BASE, length, 2**64)) + window[length:]
        length *= 2


def occurrences(keys: np.ndarray) -> np.ndarray:
    """How often each key stood before in the text."""
    ordered = np.sort(keys)
    twice = ordered[1:] == ordered[:-1]
    out = np.zeros(len(keys), np.uint64)
    if not twice.any():
        return out
    repeated = ordered[1:][twice]
    repeated = repeated[np.append(True, repeated[1:] != repeated[:-1])]
    at = np.minimum(np.searchsorted(repeated, keys), len(repeated) - 1)
    places = np.flatnonzero(repeated[at] == keys)
    groups = at[places]
    order = np.argsort(groups, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(groups[order]) != 0))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    out[places[order]] = rank
    return out


class Sketch:
    """A text's fingerprint, and what its edited text shares with it: keys, and the minima over the part that stays."""

    __slots__ = ("keys", "shared", "state", "fingerprint")

    def __init__(self, keys: np.ndarray, shared: int, state: tuple | None, fingerprint: str) -> None:
        self.keys, self.shared, self.state, self.fingerprint = keys, shared, state, fingerprint


class OrderSketch:
    """Fingerprints of texts: ``slots`` tuples of ``picks`` k-mers, each tuple hashed to DIGITS hex digits.

    A slot orders the (k-mer, occurrence) pairs by a hash function of its own, takes the minimal ones, equal
    values by place, and keeps them in text order.
    """

    def __init__(self, k: int = K, picks: int = PICKS, slots: int = SLOTS, seed: int = 1) -> None:
        self.k, self.picks, self.slots = k, picks, slots
        self.times = (np.random.default_rng(seed).integers(0, 2**32, slots, dtype=np.uint32) | np.uint32(1))[:, None]
        self.rows, self.space = np.arange(slots), np.empty((slots, BLOCK), np.uint32)

    def _pairs(self, keys: np.ndarray) -> np.ndarray:
        """32 bits of each (k-mer, occurrence) pair, which the slots' hash functions multiply."""
        seen = occurrences(keys)
        again = np.flatnonzero(seen)
        if len(again):
            keys = keys.copy()
            keys[again] = _mix(keys[again] + seen[again] * np.uint64(_STEP))
        return (keys >> np.uint64(32)).astype(np.uint32)

    def _extend(self, state: tuple | None, pairs: np.ndarray, start: int) -> tuple | None:
        """Each slot's minimal values and their places, after more pairs that begin at a place."""
        for lo in range(0, len(pairs), BLOCK):
            some = pairs[lo : lo + BLOCK]
            values = np.multiply(some, self.times, out=self.space[:, : len(some)])
            found, places = [], []
            for n in range(min(self.picks, len(some))):
                j = values.argmin(axis=1)
                found.append(values[self.rows, j])
                places.append(j + (start + lo))
                if n + 1 < self.picks:
                    values[self.rows, j] = 2**32 - 1
            found, places = np.stack(found, axis=1), np.stack(places, axis=1)
            if state is not None:
                found, places = np.concatenate([state[0], found], axis=1), np.concatenate([state[1], places], axis=1)
                order = np.argsort(found, axis=1, kind="stable")[:, : self.picks]
                found, places = np.take_along_axis(found, order, 1), np.take_along_axis(places, order, 1)
            state = found, places
        return state

    def _digest(self, keys: np.ndarray, state: tuple | None) -> str:
        if state is None:
            return ""
        tuples = np.zeros(self.slots, np.uint64)
        for column in keys[np.sort(state[1], axis=1)].T:
            tuples = _mix(tuples * np.uint64(_STEP) + column)
        return (tuples >> np.uint64(64 - 4 * DIGITS)).astype(">u2").tobytes().hex()

    def sketch(self, text: str) -> Sketch:
        points = code_points(text)
        keys = kmer_keys(points, self.k)
        pairs = self._pairs(keys)
        shared = max(0, len(points) - len(points) // 4 - self.k + 1)
        state = self._extend(None, pairs[:shared], 0)
        return Sketch(keys, shared, state, self._digest(keys, self._extend(state, pairs[shared:], shared)))

    def fingerprint(self, text: str) -> str:
        """``slots * DIGITS`` hex digits; empty for the empty text."""
        return self.sketch(text).fingerprint

    def fingerprint_edited(self, sketch: Sketch, new: str) -> str:
        """:meth:`fingerprint` of a text that agrees with the sketched one up to its last quarter; only the rest is hashed."""
        points = code_points(new)
        shared = sketch.shared if len(points) - self.k >= sketch.shared else 0
        keys = np.concatenate([sketch.keys[:shared], kmer_keys(points[shared:], self.k)])
        return self._digest(keys, self._extend(sketch.state if shared else None, self._pairs(keys)[shared:], shared))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def likeness(a: str, b: str) -> float:
    """The share of equal slots of two fingerprints; two empty ones are alike, an empty one is unlike any other."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint16) for s in (a, b))
    return float((x == y).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter (rounded down) replaced by as many code points of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_RESULT = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]
_RESULT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame, k: int = K, picks: int = PICKS, slots: int = SLOTS) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that and to the next document.

    Documents (``doc_id, text``) follow each other by doc_id, then text digest; the first follows the last. Rows are
    range-partitioned and sorted by that order, and a task streams through its part: at any time it holds two documents.
    The last row of a part and the first of the next one are written with the results and meet in a join of two
    rows a part. Texts are shuffled once.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``, a row for each
    row. A null text counts as empty; an empty text has an empty fingerprint, and its edited text is empty. A text of
    fewer than ``k`` code points is one k-mer. Equal texts have equal fingerprints. A null doc_id comes first; rows equal
    in doc_id and text are documents of their own, each other's next. A lone document follows itself. An empty
    table gives no rows; further columns are ignored.
    """
    ship_by_value()

    def finish(sketch: OrderSketch, doc_id: int | None, text: str, own: Sketch, following: str, its: str) -> tuple:
        new = edited(text, following)
        changed = sketch.fingerprint_edited(own, new)
        digest, mine = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own.fingerprint
        return doc_id, len(text), digest, mine, changed, likeness(mine, changed), likeness(mine, its)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, sketch, before = TaskContext.get().partitionId(), OrderSketch(k, picks, slots), None
        fields = [("kind", pa.int32()), ("part", pa.int32()), ("text", pa.string()), *_RESULT]
        schema = pa.schema(fields)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], schema=schema)

        for each in batches:
            rows = []
            for doc_id, text in zip(each.column("doc_id").to_pylist(), each.column("text").to_pylist(), strict=True):
                own = sketch.sketch(text)
                if before is None:
                    rows.append((1, part, text, None, None, None, own.fingerprint, None, None, None))
                else:
                    rows.append((0, part, None, *finish(sketch, *before, text, own.fingerprint)))
                before = (doc_id, text, own)
            yield batch(rows)
        if before is not None:
            yield batch([(2, part, before[1], before[0], None, None, before[2].fingerprint, None, None, None)])

    def last(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = OrderSketch(k, picks, slots)
        for each in batches:
            rows = [finish(sketch, r["doc_id"], r["text"], sketch.sketch(r["text"]), r["next_text"], r["next_fingerprint"]) for r in each.to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(_RESULT)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _RESULT, strict=True)], schema=pa.schema(_RESULT))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))
    parts = rows.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest").select("doc_id", "text")
    made = stored(parts.mapInArrow(scan, f"kind int, part int, text string, {_RESULT_DDL}"))
    # numbers of the parts that have rows: as many as the shuffle has partitions
    full = sorted(r["part"] for r in made.where("kind = 1").select("part").collect())
    follows = docs.sparkSession.createDataFrame(list(zip(full, full[1:] + full[:1], strict=True)), "part int, next_part int")
    first = made.where("kind = 1").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    ends = made.where("kind = 2").select("part", "doc_id", "text", "fingerprint").join(F.broadcast(follows), "part").join(first, "next_part")
    return made.where("kind = 0").select(*[c for c, _ in _RESULT]).union(ends.mapInArrow(last, _RESULT_DDL))
