"""Substring deduplication by content-defined chunks cut with a gear rolling hash."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftkit.llm.common import ship_by_value, utf8

#: A chunk ends behind a separator where the top CUT_BITS bits of the gear hash are 0, but not before MIN_BYTES.
CUT_BITS, MIN_BYTES = 2, 12
#: Without a separator for LONG_RUN bytes it may end behind any character where RUN_BITS bits are 0; at MAX_BYTES it must end.
LONG_RUN, RUN_BITS, MAX_BYTES = 64, 6, 4096
#: Bytes hashed at once; a text of any length needs memory for one such block.
BLOCK = 1 << 20


def gear_table() -> np.ndarray:
    """A random word for each byte; all separators share one, so a changed line break doesn't move a cut."""
    t = np.random.default_rng(7).integers(0, 2**16, 256, dtype=np.uint16)
    t[9:14] = t[32]
    return t


def gear_hash(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The rolling hash h = 2 h + table[byte] (16 bits, so over 16 bytes) at each byte, by doubling the width."""
    h = table[data]
    for width in (1, 2, 4, 8):
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint16(width)
        h = wider
    return h


def cuts(text: bytes, table: np.ndarray) -> list[int]:
    """The ends of the chunks of a text; they depend on nearby bytes only, so shared passages are cut alike."""
    data, ends, last, seen = np.frombuffer(text, np.uint8), [], 0, -1

    def forced(until: int) -> None:
        nonlocal last
        while until - last > MAX_BYTES:
            at = last + MAX_BYTES
            while at > last + 1 and text[at] & 0xC0 == 0x80:  # not inside a character
                at -= 1
            ends.append(at)
            last = at

    for at in range(0, len(data), BLOCK):
        lead = min(at, 15)
        part = data[at - lead : at + BLOCK]
        h = gear_hash(part, table)[lead:]
        part = part[lead:]
        space = (part == 32) | ((part >= 9) & (part <= 13))
        here = np.arange(at, at + len(part))
        since = np.maximum.accumulate(np.maximum(np.where(space, here, -1), seen))
        seen = int(since[-1])
        starts = np.append(data[at + 1 : at + 1 + len(part)] & 0xC0 != 0x80, True)[: len(part)]  # the next byte starts a character
        cut = (space & (h >> np.uint16(16 - CUT_BITS) == 0)) | ((here - since >= LONG_RUN) & starts & (h >> np.uint16(16 - RUN_BITS) == 0))
        for p in (np.flatnonzero(cut) + at + 1).tolist():
            forced(p)
            if p - last >= MIN_BYTES:
                ends.append(p)
                last = p
    forced(len(text))
    if last < len(text):
        ends.append(len(text))
    return ends


def digests(text: bytes, ends: list[int]) -> np.ndarray:
    """128-bit digests of the chunks (two columns), without separators at their ends."""
    import xxhash

    at, out = 0, []
    for end in ends:
        out.append(xxhash.xxh3_128_digest(text[at:end].strip()))
        at = end
    return np.frombuffer(b"".join(out), "<i8").reshape(-1, 2)


def runs(flags: list[bool], text: bytes, ends: list[int], min_words: int, min_bytes: int | None = None) -> list[tuple[int, int, int]]:
    """Maximal runs of flagged chunks with at least ``min_words`` words or ``min_bytes`` bytes: (first chunk, end chunk, words)."""
    out, i = [], 0
    while i < len(flags):
        if not flags[i]:
            i += 1
            continue
        j = i
        while j < len(flags) and flags[j]:
            j += 1
        part = text[ends[i - 1] if i else 0 : ends[j - 1]].strip()
        n = len(part.split())
        if n >= min_words or (min_bytes is not None and len(part) >= min_bytes):
            out.append((i, j, n))
        i = j
    return out


def chunk_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, a, b``: each distinct chunk digest of each document."""
    ship_by_value()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gear = gear_table()
        for batch in batches:
            ids, found = [], []
            for doc, text in zip(batch["doc_id"].astype("Int64"), batch["body"], strict=True):
                if text:
                    d = np.unique(digests(text, cuts(text, gear)), axis=0)
                    ids += [doc] * len(d)
                    found.append(d)
            if found:
                both = np.concatenate(found)
                yield pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "a": both[:, 0], "b": both[:, 1]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("body")).mapInPandas(run, "doc_id long, a long, b long")


def dedup_substrings(docs: DataFrame, min_words: int = 20, min_bytes: int | None = None) -> DataFrame:
    """Drop passages that a document with a smaller doc_id, or the same document further up, has too.

    Texts are cut into variable chunks (about 6 words) at places a rolling hash of the last 16 bytes
    chooses, so a passage is cut alike wherever it stands and an insertion moves no later cut. Digests are counted over
    all documents with a map-side combine; digests of two or more documents go back to their documents
    with the smallest doc_id, their owner. In a second pass over the texts a chunk is a repeat if
    another document owns it or if the document had it before, and runs of repeats with ``min_words`` words
    or more are cut out; shorter ones, such as a common phrase, stay. With ``min_bytes`` runs of so many UTF-8 bytes go
    too, whatever their words: a text without separators (Chinese, Japanese, Thai, encoded strings) is one word
    however long it is, so without ``min_bytes`` its repeats stay.

    Returns ``doc_id, text`` (kept), ``n_chunks, n_shared`` (chunks in runs that other documents have too, owner or
    not), ``n_dropped`` (chunks cut out), ``dropped_words, spans`` (cut out, code points in the original text).

    Rows that share a doc_id are parts of one document: repeats between them stay. A null doc_id owns a
    passage only if no other document has it. Null and empty texts have no chunks and stay empty. An empty table gives no rows;
    further columns are ignored.
    """
    ship_by_value()
    held = chunk_digests(docs)
    shared = held.groupBy(F.col("a").alias("x"), F.col("b").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("owner")).where("n > 1").drop("n")
    mine = (
        held.join(shared, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")))
        .groupBy(F.col("doc_id").alias("of"))
        .agg(F.collect_list(F.struct("a", "b", F.col("owner").eqNullSafe(F.col("doc_id")).alias("own"))).alias("known"))
        .select("of", F.col("known.a").alias("a"), F.col("known.b").alias("b"), F.col("known.own").alias("own"))
    )

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gear = gear_table()
        for batch in batches:
            rows = []
            for text, a, b, own in zip(batch["body"], batch["a"], batch["b"], batch["own"], strict=True):
                ends = cuts(text, gear) if text else []
                known = {} if a is None else dict(zip(zip(a.tolist(), b.tolist(), strict=True), own.tolist(), strict=True))
                share, repeat, seen = [], [], set()
                for d in map(tuple, digests(text, ends).tolist() if ends else []):
                    share.append(d in known)
                    repeat.append(d in seen or not known.get(d, True))
                    seen.add(d)
                kept, spans, at, words, dropped = [], [], 0, 0, 0
                for i, j, n in runs(repeat, text, ends, min_words, min_bytes):
                    start, end = (ends[i - 1] if i else 0), ends[j - 1]
                    kept.append(text[at:start])
                    first = len(text[:start].decode())
                    spans.append({"start": first, "end": first + len(text[start:end].decode())})
                    at, words, dropped = end, words + n, dropped + j - i
                kept.append(text[at:])
                in_runs = sum(j - i for i, j, _ in runs(share, text, ends, min_words, min_bytes))
                rows.append((b"".join(kept).decode(), len(ends), in_runs, dropped, words, spans))
            out = pd.DataFrame(rows, columns=["text", "n_chunks", "n_shared", "n_dropped", "dropped_words", "spans"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("body"))
    return texts.join(mine, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "body", "a", "b", "own").mapInPandas(
        run, "doc_id long, text string, n_chunks long, n_shared long, n_dropped long, dropped_words long, spans array<struct<start: long, end: long>>"
    )
