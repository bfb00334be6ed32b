"""MinHash near-duplicate detection by a multi-index Hamming join over b-bit signatures."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftkit.llm.common import lower_ascii, ship_by_value, utf8
from shiftkit.llm.components import components
from shiftkit.session import materialize, small_batches, stored

#: A signature: SYMBOLS MinHash values of 16 bits each, split into chunks of CHUNK symbols.
SYMBOLS, CHUNK = 48, 4
#: Largest number of differing symbols that is guaranteed to be found with one error allowed in a chunk:
#: 12 chunks share 23 errors, so some chunk has one at most. Two sets of similarity 0.8 differ in 9.6
#: symbols on average; more than 23 have a probability of about 2e-6.
ERRORS = 2 * (SYMBOLS // CHUNK) - 1
#: A node table of at most this many rows (16 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000

SIGN_SCHEMA = "doc_id long, n_shingles long, a long, b long, row long, sig binary"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct 64-bit hashes of the n-word shingles of UTF-8 texts; hashes of words are kept for the next text."""

    KEEP = 150_000

    def __init__(self, n: int) -> None:
        self.n, self.known = n, {}

    def __call__(self, text: bytes) -> np.ndarray:
        import xxhash

        words, known = text.split(), self.known
        if len(known) > self.KEEP:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        m = len(h) - self.n + 1
        if m < 1:  # the whole sequence is one shingle
            m, width = min(1, len(h)), len(h)
        else:
            width = self.n
        out = np.full(m, width, np.uint64)
        for i in range(width):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + m])
        return np.unique(out)


def multipliers() -> np.ndarray:
    """One odd factor for each symbol's permutation; fixed by the seed."""
    return np.random.default_rng(20240601).integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(grams: np.ndarray, factors: np.ndarray, rows: int = 4096) -> np.ndarray:
    """16 bits of the smallest value of each permutation, in pieces of bounded memory."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), rows):
        np.minimum(least, (grams[at : at + rows, None] * factors).min(axis=0), out=least)
    return (_mix(least) & np.uint64(0xFFFF)).astype("<u2")


def sign(docs: DataFrame, n: int) -> DataFrame:
    """Each document's set size, 128-bit set fingerprint (a, b), text digest and signature, in one pass over the texts."""
    ship_by_value()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, factors = Shingler(n), multipliers()
        for batch in batches:
            rows = []
            for text in batch["body"]:
                g = shingle(text)
                a, b = _mix(g + np.uint64(1)).sum(dtype=np.uint64), _mix(g ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                rows.append((len(g), int(a.view(np.int64)), int(b.view(np.int64)), signature(g, factors).tobytes()))
            out = pd.DataFrame(rows, columns=["n_shingles", "a", "b", "sig"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out.assign(row=batch["row"].to_numpy())[["doc_id", "n_shingles", "a", "b", "row", "sig"]]

    bodies = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(lower_ascii(F.col("text"))).alias("body"), F.xxhash64("doc_id", "text").alias("row"))
    return bodies.mapInPandas(run, SIGN_SCHEMA)


def chunk_keys(nodes: DataFrame) -> DataFrame:
    """``key, node``: for each chunk, the chunk with each one of its symbols left out.

    Two signatures share a key exactly if some chunk of theirs has one error at most; a key holds the
    chunk's number, the place left out and the other symbols, so it is exact and not a hash.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            s = np.frombuffer(b"".join(batch["sig"]), "<u2").reshape(len(batch), SYMBOLS // CHUNK, CHUNK).astype(np.int64)
            keys = []
            for out in range(CHUNK):
                key = np.arange(SYMBOLS // CHUNK, dtype=np.int64) * CHUNK + out
                for i in range(CHUNK):
                    if i != out:
                        key = (key << 16) | s[:, :, i]
                keys.append(key)
            k = np.stack(keys, axis=2).reshape(len(batch), -1)
            yield pd.DataFrame({"key": k.ravel(), "node": np.repeat(batch["node"].to_numpy(np.int64), k.shape[1])})

    return nodes.select("node", "sig").mapInPandas(run, "key long, node long")


def near_enough(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (u, v) whose signatures differ in at most ERRORS symbols and whose set sizes allow the threshold."""

    @F.pandas_udf("int")
    def errors(x: pd.Series, y: pd.Series) -> pd.Series:
        a, b = (np.frombuffer(b"".join(s), "<u2").reshape(-1, SYMBOLS) for s in (x, y))
        return pd.Series((a != b).sum(axis=1).astype(np.int32))

    def side(c: str) -> DataFrame:
        return nodes.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n_shingles").alias(f"n_{c}"))

    joined = pairs.join(side("u"), "u").join(side("v"), "v").where(F.least("n_u", "n_v") >= F.greatest("n_u", "n_v") * threshold - 1e-9)
    return joined.withColumn("errors", errors("sig_u", "sig_v")).where(F.col("errors") <= ERRORS).select("u", "v", "n_u", "n_v", "errors")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole shingle sets have 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("node").alias("v"), F.col("grams").alias("grams_v")), "v").join(
        sets.select(F.col("node").alias("u"), F.col("grams").alias("grams_u")), "u"
    )
    common = both.select("u", "v", (F.size("grams_u") + F.size("grams_v")).cast("long").alias("total"), F.size(F.array_intersect("grams_u", "grams_v")).cast("long").alias("common"))
    return common.where(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("u", "v")


def whole_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``node, grams``: the full shingle set of each wanted node (``row, node``), from its document's whole text."""
    ship_by_value()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(n)
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "grams": [shingle(t).view(np.int64) for t in batch["body"]]})

    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    bodies = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text").join(few, "row").select("node", utf8(lower_ascii(F.col("text"))).alias("body"))
    return bodies.mapInPandas(run, "node long, grams array<long>")


def grouped(held: DataFrame, groups: DataFrame) -> DataFrame:
    """``key, node, group, top`` of the buckets that hold several groups; top is a bucket's largest group."""
    member = held.select("key", "node").join(groups, "node", "left").select("key", "node", F.coalesce("root", "node").alias("group"))
    sizes = member.groupBy("key", "group").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy(F.col("key").alias("bucket")).agg(F.max(F.struct("n", "group")).alias("best"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    return member.join(mixed, F.col("key") == F.col("bucket")).select("key", "node", "group", F.col("best.group").alias("top"))


def star_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Each member of a bucket with the one member that this turn's hash picks, if they are of different groups."""
    pick = F.xxhash64(F.lit(turn), "node")
    heads = members.groupBy(F.col("key").alias("bucket")).agg(F.min(F.struct(pick.alias("h"), F.col("node"), F.col("group"))).alias("head"))
    both = members.join(heads, F.col("key") == F.col("bucket")).where(F.col("group") != F.col("head.group"))
    return both.select(F.col("head.node").alias("u"), F.col("node").alias("v")).distinct()


def settle(members: DataFrame, grams: DataFrame, percent: int, block: int = 1024) -> DataFrame:
    """Links (u, v) between different groups of a bucket, by whole sets, from :func:`grouped` members.

    The buckets with the same largest group form a family, which holds each of their nodes once. Each node outside
    the largest group is compared with all nodes of other groups, on whole sets; of its links into one group the
    first is returned, which connects the groups as well as all would. Families are cut into blocks
    of about ``block`` nodes, and a task holds the sets of two blocks at a time; no pair becomes a row before
    it is a link.
    """
    ship_by_value()
    family = members.select(F.col("top").alias("family"), "node", "group").distinct()
    sizes = family.groupBy(F.col("family").alias("of")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    sides = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j")))
    dealt = family.join(sizes, F.col("family") == F.col("of")).select("family", "node", "group", own.alias("own"), F.explode(sides).alias("p"))
    dealt = dealt.join(grams.select(F.col("node").alias("of"), "grams"), F.col("node") == F.col("of")).select("family", "p.i", "p.j", "own", "node", "group", "grams")

    def compare(part: pd.DataFrame) -> list[tuple[int, int]]:
        family, node, group, side = (part[c].to_numpy(np.int64) for c in ("family", "node", "group", "own"))
        sizes = part["grams"].map(len).to_numpy()
        names, flat = np.unique(np.concatenate(part["grams"].to_list()), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        mark, apart, links = np.zeros(len(names), np.int64), part["i"].iloc[0] != part["j"].iloc[0], []
        for x in np.flatnonzero(group != family):
            here = flat[starts[x] : starts[x + 1]]
            mark[here] = 1
            common = np.add.reduceat(mark[flat], starts[:-1])
            mark[here] = 0
            ok = (100 * common >= percent * (sizes + sizes[x] - common)) & (group != group[x]) & ((side != side[x]) if apart else True)
            y = np.flatnonzero(ok)
            links += [(int(node[x]), int(node[i])) for i in y[np.unique(group[y], return_index=True)[1]]]
        return links

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in chain(batches, [None]):
            both = rest if batch is None else batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if both is None or not len(both):
                continue
            at = both[["family", "i", "j"]].to_numpy(np.int64)
            starts = np.flatnonzero(np.append(True, (at[1:] != at[:-1]).any(axis=1)))
            ends = np.append(starts[1:], len(both))
            if batch is not None:  # the last pair of blocks may go on in the next batch
                rest, starts, ends = both.iloc[starts[-1] :], starts[:-1], ends[:-1]
            found = [link for a, b in zip(starts, ends, strict=True) for link in compare(both.iloc[a:b])]
            if found:
                yield pd.DataFrame(found, columns=["u", "v"])

    return dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInPandas(run, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80) -> DataFrame:
    """Classes of near-duplicates: ``doc_id, n_shingles, component_id, kept``, a row for each row of ``docs``.

    Documents link if their sets of distinct ``words``-word shingles (A-Z lower-cased) have
    100 * intersection >= ``percent`` * union; a class is what links connect, named by its smallest doc_id.

    1. Equal sets become one node (grouped by a 128-bit fingerprint with map-side combine), so exact copies
       cost nothing from there on.
    2. Nodes meet in the buckets of :func:`chunk_keys`. Twice, every node is paired with one node of each bucket,
       and its closest such partner by signature is confirmed on whole sets. Confirmed links connect most of any family of
       near copies at the cost of a pair a member.
    3. Only buckets that still hold several groups go on: their members outside the largest group are compared
       with those of all other groups, on whole sets, block by block (:func:`settle`). Pairs inside
       a group are never looked at.

    So any pair within the signature threshold is either compared or connected already, and no link is lost.

    A text of fewer words is one shingle; a text without words, or null, is linked with nothing and is its own
    class. Repeated rows are copies; a null doc_id takes part, and names a class (null) only if no other does.
    An empty table gives no rows; further columns are ignored.
    """
    return classed(docs, words, percent).select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def grouped_nodes(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of ``docs`` as in :func:`sign`, their different sets with a ``node`` each, and the ``root`` of each node that has links."""
    signed = materialize(sign(docs, words))
    sets = signed.where("n_shingles > 0").groupBy("a", "b", "n_shingles").agg(F.min("doc_id").alias("first_id"), F.min("row").alias("row"), F.min("sig").alias("sig"))
    nodes = materialize(sets.withColumn("node", F.monotonically_increasing_id()))
    keys = chunk_keys(nodes)
    several = keys.groupBy(F.col("key").alias("bucket")).agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("bucket")
    held = materialize(keys.join(several, F.col("key") == F.col("bucket")).select("key", "node"))
    grams = materialize(whole_sets(docs, nodes.join(held.select("node").distinct(), "node").select("row", "node"), words))

    links = docs.sparkSession.range(0).select(F.col("id").alias("u"), F.col("id").alias("v"))  # without Python, which an empty list would start in every executor
    groups = components(links)
    for turn in range(2):
        near = near_enough(star_pairs(grouped(held, groups), turn), nodes, percent / 100)
        closest = near.groupBy("v").agg(F.min(F.struct("errors", "u")).alias("closest")).select("closest.u", "v")
        links = stored(links.union(confirm(closest, grams, percent)))
        groups = components(links)
    return signed, nodes, components(links.union(settle(grouped(held, groups), grams, percent)))


def classed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The classes of :func:`near_duplicates` by row: ``doc_id, n_shingles, row, class, component_id``.

    row is the row's digest as in :func:`sign`, class tells the classes apart, also those without a name; it is
    null for a text without words. All jobs that send texts or sets to Python run in here, on small Arrow batches.
    """
    with small_batches(docs.sparkSession):
        signed, nodes, groups = grouped_nodes(docs, words, percent)
    named = nodes.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy(F.col("root").alias("class")).agg(F.min("first_id").alias("component_id"))
    classes = named.join(names, F.col("root") == F.col("class")).select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("n_shingles").alias("n"), "class", "component_id")
    match = (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")) & (F.col("n_shingles") == F.col("n"))
    found = signed.select("doc_id", "n_shingles", "a", "b", "row").join(classes, match, "left")
    return found.select(
        "doc_id", "n_shingles", "row", "class", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs``, with all its columns, of each class of :func:`near_duplicates`: that of the smallest doc_id.

    Rows are told apart by doc_id and text: rows of one doc_id, or without any, that are no near-duplicates all
    stay. A null doc_id is the largest. Of rows of a class with equal doc_ids the text's digest decides; rows equal in
    doc_id and text are one.
    """
    alone = F.when(F.col("class").isNull(), F.struct("doc_id", "row"))
    first = classed(docs, words, percent).groupBy("class", alone.alias("alone")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first"))
    kept = first.select(F.col("first.doc_id").alias("kept_id"), F.col("first.row").alias("kept_row"))
    match = docs["doc_id"].eqNullSafe(kept["kept_id"]) & (F.xxhash64(docs["doc_id"], docs["text"]) == kept["kept_row"])
    return docs.join(kept, match, "left_semi").dropDuplicates(["doc_id", "text"])
