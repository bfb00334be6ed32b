"""Text features at corpus scale: keyword search, vocabulary, token ids and token-level revision diffs.

Tokenising is ``regexp_extract_all`` / ``split`` on the JVM; counting is grouping; a vocabulary is
bounded by its size parameter, which is what makes its broadcast safe.
"""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftkit.functions.stopwords import ENGLISH_STOP_WORDS

# Letters, digits and underscore in any script, two or more: a Unicode-aware ``(?u)\b\w\w+\b``.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"


def keyword_pattern(terms: Sequence[str]) -> str:
    """One alternation of escaped, lower-cased terms."""
    return "(" + "|".join(re.escape(t.lower()) for t in terms) + ")"


def keyword_filter(df: DataFrame, col: str, terms: Sequence[str]) -> DataFrame:
    """Rows whose text contains any term, case-insensitively (lower-cased text, Unicode-aware)."""
    return df.where(F.lower(F.col(col)).rlike(keyword_pattern(terms)))


def word_tokens(col, pattern: str = WORD_PATTERN):
    return F.regexp_extract_all(F.lower(F.col(col) if isinstance(col, str) else col), F.lit(pattern), 0)


def whitespace_tokens(col):
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def term_counts(df: DataFrame, col: str, stop_words: Sequence[str] | None = ENGLISH_STOP_WORDS) -> DataFrame:
    """Corpus frequency of every word (stop words removed)."""
    terms = df.select(F.explode(word_tokens(col)).alias("term"))
    if stop_words:
        terms = terms.where(~F.col("term").isin(list(stop_words)))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(df: DataFrame, col: str, size: int = 5000, stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """Top ``size`` terms by corpus frequency, ties by term; ``term_id`` 0.. in that order.

    A top-k over the counted terms (``TakeOrderedAndProject``), so no global sort; the result is
    bounded by ``size``.
    """
    top = term_counts(df, col, stop_words).orderBy(F.desc("n"), "term").limit(size)
    w = Window.orderBy(F.desc("n"), "term")
    return top.withColumn("term_id", (F.row_number().over(w) - 1).cast("int"))


#: A vocabulary is a fitted table of a chosen size and travels with the tasks; more terms than this are an error.
MOST_TERMS = 1_000_000


def _fixed_length(seq, max_len: int | None, pad_id: int):
    """Ids cut and padded to a model's input length; as they are without one."""
    if max_len is None:
        return seq
    cut = F.slice(seq, 1, max_len)
    return F.concat(cut, F.array_repeat(F.lit(pad_id), F.greatest(F.lit(max_len) - F.size(cut), F.lit(0))))


def token_ids(df: DataFrame, key: str, col: str, vocab: DataFrame, max_len: int | None = None, pad_id: int = -1,
              unknown_id: int = -2) -> DataFrame:
    """Token ids of each whole text, a row for each row; out-of-vocabulary tokens get ``unknown_id``, a NULL text has none.

    Texts are tokenised on the JVM and looked up in Arrow batches in the vocabulary, which tasks carry (at most MOST_TERMS terms): one
    pass, no shuffle. ``max_len`` is a model's input limit: with it ids are truncated and padded to that length.
    """
    from shiftkit.session import ship_package

    ship_package(df.sparkSession)
    known = vocab.select("term", "term_id").limit(MOST_TERMS + 1).collect()
    if len(known) > MOST_TERMS:
        raise ValueError(f"a vocabulary of more than {MOST_TERMS} terms")
    terms, numbers = [r["term"] for r in known], [r["term_id"] for r in known]
    kt = df.schema[key].dataType.simpleString()

    def look_up(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        names, ids = pa.array(terms, pa.string()), pa.array([*numbers, unknown_id], pa.int32())
        for batch in batches:
            words = batch.column("w")
            found = pc.fill_null(pc.index_in(words.flatten(), value_set=names), len(terms))
            start = words.offsets.to_numpy() - words.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.ListArray.from_arrays(pa.array(start, pa.int32()), ids.take(found))], names=["k", "ids"])

    words = F.coalesce(word_tokens(col), F.array().cast("array<string>"))
    found = df.select(F.col(key).alias("k"), words.alias("w")).mapInArrow(look_up, f"k {kt}, ids array<int>")
    return found.select(F.col("k").alias(key), _fixed_length(F.col("ids"), max_len, pad_id).alias("input_ids"))


def subword_ids(df: DataFrame, key: str, col: str, tokenizer: bytes, max_len: int | None = None, pad_id: int = 0) -> DataFrame:
    """Subword ids of each whole text by a model's tokenizer file (the JSON of the ``tokenizers`` library, given as bytes), without
    special tokens: (key, input_ids, n_tokens).

    ``max_len`` truncates and pads the ids to a model's input length, ``n_tokens`` is the number before that. Strings of special
    tokens inside a text are plain text; a NULL text has no ids. A row for each row, in one pass of Arrow batches.
    """
    return _subwords(df, key, col, tokenizer, "array<int>", False).select(
        key, _fixed_length(F.col("out"), max_len, pad_id).alias("input_ids"), F.size("out").cast("long").alias("n_tokens"))


def subword_texts(ids: DataFrame, key: str, col: str, tokenizer: bytes) -> DataFrame:
    """The texts of subword ids: (key, text)."""
    return _subwords(ids, key, col, tokenizer, "string", True).withColumnRenamed("out", "text")


#: Characters of text (or ids, for texts from ids) that a task hands to the tokenizer at a time, and rows at most.
MOST_AT_ONCE, MOST_ROWS = 1 << 18, 256


def _slices(sizes):
    """Ends of runs of rows that hold MOST_AT_ONCE or less (a larger row is a run of its own) and MOST_ROWS rows at most."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (held + n > MOST_AT_ONCE or i - start == MOST_ROWS):
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def _subwords(df: DataFrame, key: str, col: str, tokenizer: bytes, to: str, back: bool) -> DataFrame:
    from shiftkit.session import ship_package

    ship_package(df.sparkSession)
    kt = df.schema[key].dataType.simpleString()

    def run(batches):
        import os

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(tokenizer.decode("utf-8"))
        made.encode_special_tokens = True
        for batch in batches:
            x = batch.column("x")
            size = pc.list_value_length(x) if back else pc.binary_length(x)
            # what the tokenizer makes of a text is many times the text's size, so an Arrow batch goes through it in slices
            for start, end in _slices(pc.fill_null(size, 0).to_pylist()):
                rows = x.slice(start, end - start).to_pylist()
                if back:
                    out = pa.array(made.decode_batch([r or [] for r in rows], skip_special_tokens=False), pa.string())
                else:
                    made_of = made.encode_batch_fast([r or "" for r in rows], add_special_tokens=False)
                    out = pa.array([np.asarray(e.ids, np.int32) for e in made_of], pa.list_(pa.int32()))
                    del made_of
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(start, end - start), out], names=["k", "out"])

    return df.select(F.col(key).alias("k"), F.col(col).alias("x")).mapInArrow(run, f"k {kt}, out {to}").select(F.col("k").alias(key), "out")


def token_diff(pairs: DataFrame, keys: Sequence[str], before: str, after: str) -> DataFrame:
    """Per pair: whitespace tokens kept, removed and added (multiset difference of the two texts).

    Both sides' tokens go through one grouping by (pair, token); kept = min of the two counts,
    removed / added = the surplus on the old / new side. A pair without any token keeps one row, with a NULL token and
    zero counts.
    """
    keys = list(keys)

    def side(col, old):
        toks = F.transform(whitespace_tokens(F.coalesce(F.col(col), F.lit(""))), lambda t: F.struct(F.lit(old).alias("old"), t.alias("token")))
        return toks

    toks = pairs.select(*keys, F.explode_outer(F.concat(side(before, True), side(after, False))).alias("t"))
    g = toks.groupBy(*keys, F.col("t.token").alias("token")).agg(
        F.count_if(F.col("t.old")).alias("_nb"), F.count_if(~F.col("t.old")).alias("_na"))
    return g.select(
        *keys, "token",
        F.least("_nb", "_na").alias("kept"),
        (F.col("_nb") - F.least("_nb", "_na")).alias("removed"),
        (F.col("_na") - F.least("_nb", "_na")).alias("added"),
    )


def _longest_run(rows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of candidate anchors (sorted by place in the old text) the longest run whose places in the new text ascend too."""
    from bisect import bisect_left

    tops, last, back = [], [], []
    for _, j in rows:
        at = bisect_left(tops, j)
        back.append(last[at - 1] if at else None)
        if at == len(tops):
            tops.append(j)
            last.append(len(back) - 1)
        else:
            tops[at], last[at] = j, len(back) - 1
    out, k = [], last[-1] if last else None
    while k is not None:
        out.append(rows[k])
        k = back[k]
    return out[::-1]


def _anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of the kept words of two texts, ascending. A segment is cut at its anchors and its gaps are segments in the next round."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        places: dict[str, tuple[list[int], list[int]]] = {}
        for i in range(i0, i1):
            places.setdefault(a[i], ([], []))[0].append(i)
        for j in range(j0, j1):
            if a_and_b := places.get(b[j]):
                a_and_b[1].append(j)
        run = _longest_run(sorted(x for i, j in places.values() if len(i) == len(j) for x in zip(i, j)))
        if run:
            found += run
            ends = [(i0 - 1, j0 - 1), *run, (i1, j1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:]) if i + 1 < k and j + 1 < m]
    return sorted(found)


def _script(a: list[str], b: list[str]):
    """The edit script's rows (step, op, token, pos_before, pos_after); in a gap removals come first, then additions, then the anchor."""
    i = j = step = 0
    for k, m in [*_anchors(a, b), (len(a), len(b))]:
        for i in range(i, k):
            yield step, "-", a[i], i, None
            step += 1
        for j in range(j, m):
            yield step, "+", b[j], None, j
            step += 1
        if k < len(a):
            yield step, "=", a[k], k, m
            step += 1
        i, j = k + 1, m + 1


def ordered_diff(pairs: DataFrame, keys: Sequence[str], before: str, after: str) -> DataFrame:
    """The word-by-word edit script of each pair of texts: (keys..., step, op, token, pos_before, pos_after), op ``=``, ``-`` or ``+``.

    Anchors cut both texts into segments, and only gaps between anchors are compared further. In a round the words that stand
    equally often on both sides of a segment are joined by word, the first with the first and so on, and the longest run of
    them that ascends on both sides become anchors. Rounds go on until one finds nothing. What is left in a gap is removed or added, removals
    first. A pair is a row with its two texts, which a task compares whole, in n log n of a segment's candidates; its words are not shuffled.

    ``step`` numbers a pair's rows from 0; kept and removed words in its order are the old text's, kept and added ones the new one's.
    A moved sentence is a removal and an addition, unlike in ``token_diff``. A NULL text has no words, NULL keys are keys; a pair
    without words has no rows, and a key that repeats is an error.
    """
    from shiftkit.session import ship_package

    ship_package(pairs.sparkSession)
    keys = list(keys)
    twice = pairs.groupBy(*keys).count().where("count > 1").select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})).first()
    if twice:
        raise ValueError(f"a pair's key repeats: {twice[0]}")
    names = [f"_k{i}" for i in range(len(keys))]
    words = [F.coalesce(whitespace_tokens(c), F.array().cast("array<string>")) for c in (before, after)]
    rows = pairs.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], words[0].alias("_a"), words[1].alias("_b"))
    schema = T.StructType([T.StructField(n, pairs.schema[k].dataType) for k, n in zip(keys, names)] + list(_SCRIPT.fields))
    return rows.mapInArrow(_diff_batches(len(keys)), schema).select(*[F.col(n).alias(k) for k, n in zip(keys, names)], *_SCRIPT.names)


_SCRIPT = T.StructType().add("step", "long").add("op", "string").add("token", "string").add("pos_before", "integer").add("pos_after", "integer")


def _diff_batches(n_keys: int, most: int = 50_000):
    """A task function: scripts of the pairs, in batches of about ``most`` rows."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]

        def made(batch, at, rows):
            kept = [batch.column(i).take(pa.array(np.asarray(at, np.int64))) for i in range(n_keys)]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            return pa.RecordBatch.from_arrays([*kept, *cols], names=[*batch.schema.names[:n_keys], "step", "op", "token", "pos_before", "pos_after"])

        for batch in batches:
            at, rows = [], []
            for i in range(batch.num_rows):
                script = list(_script(batch.column(n_keys)[i].as_py(), batch.column(n_keys + 1)[i].as_py()))
                rows += script
                at += [i] * len(script)
                if len(rows) >= most:
                    yield made(batch, at, rows)
                    at, rows = [], []
            if rows:
                yield made(batch, at, rows)

    return run


def revision_summary(diff: DataFrame, keys: Sequence[str]) -> DataFrame:
    return diff.groupBy(*keys).agg(
        F.sum("kept").cast("long").alias("kept"), F.sum("removed").cast("long").alias("removed"),
        F.sum("added").cast("long").alias("added"),
    )


def top_changed_tokens(diff: DataFrame, k: int = 20, kind: str = "added") -> DataFrame:
    """The ``k`` tokens most often added (or removed) over all pairs (a top-k report)."""
    return (
        diff.groupBy("token").agg(F.sum(kind).cast("long").alias(kind))
        .where(F.col(kind) > 0)
        .orderBy(F.desc(kind), "token").limit(k)
    )
