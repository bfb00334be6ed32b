"""Cross-tokenizer alignment: groups of tokens over equal bytes, linked pairs, and the documents that hold each pair."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftkit.llm.common import ship_by_value
from shiftkit.session import checkpoint_dir

# The split pattern of byte-level encodings, and the sign that stands for a space in pieces.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE_SPACE = "▁"
#: Characters that are aligned at once, and that make a chunk (a longer document is a chunk of its own).
BLOCK_CHARS, CHUNK_CHARS = 1 << 20, 8 << 20
#: Longer texts go through the slower encoder, which needs no deep stack for runs of spaces.
LONG_TEXT = 100_000
#: Links that are written out at once; a group with more is counted from its distinct ids.
LINKS = 1 << 21
#: An id pair is the number a * 2^20 + b.
SHIFT = 20


def byte_alphabet() -> dict[str, int]:
    """The character of byte-level vocabularies that stands for each byte: itself where it is printable, else 256 and on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}


class TokenizerPair:
    """Two tokenizers over the same bytes: A a byte-level BPE file, B a piece model with byte fallback.

    ``same`` is the identity map: for each id of A the id of B with the same bytes, or -1.
    """

    def __init__(self, file_a: bytes, file_b: bytes) -> None:
        import sentencepiece

        spec, letters = json.loads(file_a), byte_alphabet()
        vocabulary = {t: i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        plain = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        self.bytes_a = [b""] * (1 + max([*spec["model"]["vocab"].values(), *special.values()]))
        for t, i in plain.items():
            self.bytes_a[i] = t
        for t, i in special.items():
            self.bytes_a[i] = t.encode()
        self.file_a, self.library = file_a, None
        ranked = self._ranked(spec, vocabulary)
        self.fast = ranked and self._fast(plain)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=file_b)
        n = self.pieces.get_piece_size()
        names = [self.pieces.id_to_piece(i) for i in range(n)]
        fallback = [self.pieces.is_byte(i) for i in range(n)]
        self.bytes_b = [bytes([int(t[3:5], 16)]) if b else t.replace(PIECE_SPACE, " ").encode() for t, b in zip(names, fallback, strict=True)]
        known = {self.bytes_b[i]: i for i in range(n) if fallback[i]}
        known |= {self.bytes_b[i]: i for i in range(n) if not fallback[i] and not self.pieces.is_control(i) and not self.pieces.is_unknown(i)}
        self.same = np.array([known.get(t, -1) if t else -1 for t in self.bytes_a], dtype=np.int64)
        self.len_a, self.len_b = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        if max(len(self.bytes_a), len(self.bytes_b)) >= 1 << SHIFT:
            raise ValueError(f"vocabularies of {1 << SHIFT} ids or more don't fit a pair's number")
        ids = [str(i).rjust(7, "\0").encode() for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.digits = np.frombuffer(b"".join(ids), np.uint8).reshape(-1, 7)
        self.letters = [(np.frombuffer(b"".join(x), np.uint8), np.cumsum(n) - n) for x, n in ((self.bytes_a, self.len_a), (self.bytes_b, self.len_b))]
        # whether a space can only begin a piece: then words can be encoded one by one
        self.by_word = self.fast is not False and not any(" " in t.lstrip(" ") for t in (names[i].replace(PIECE_SPACE, " ") for i in range(n) if not fallback[i]))

    @staticmethod
    def _ranked(spec: dict, vocabulary: dict) -> bool:
        """Whether the file's merges are in the order of the ids they make, so that ids are ranks."""
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or model.get("ignore_merges") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
            return False
        made = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        return None not in made and all(x < y for x, y in zip(made, made[1:], strict=False))

    @staticmethod
    def _fast(plain: dict[bytes, int]):
        import tiktoken

        return tiktoken.Encoding("a", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=plain, special_tokens={})

    def encode_a(self, text: str) -> list[int]:
        """Ids of A without special tokens; both encoders give the same."""
        if self.fast and len(text) <= LONG_TEXT:
            return self.fast.encode_ordinary(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.file_a.decode())
            self.library.encode_special_tokens = True
        return self.library.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A for space+text and of B for text; none for a text that is empty or doesn't come back from the ids."""
        a, b = [], self.pieces.encode(texts, num_threads=1) if texts else []
        for i, text in enumerate(texts):
            data = " " + text
            ids = self.encode_a(data) if text else []
            data = data.encode()
            if not text or b"".join(map(self.bytes_a.__getitem__, ids)) != data or b"".join(map(self.bytes_b.__getitem__, b[i])) != data:
                ids, b[i] = [], []
            a.append(ids)
        return a, b

    def spelled(self, ids: np.ndarray, side: int) -> np.ndarray:
        """The bytes of many ids of A (side 0) or B (side 1)."""
        letters, start = self.letters[side]
        n = (self.len_a, self.len_b)[side][ids]
        return letters[np.repeat(start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def encode_together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """:meth:`encode` of words that don't end in white space, as one text: ids and their number by word, of A and of B.

        Neither encoding joins a space to what is before it, so the words' ids follow each other. None if some bytes don't come back.
        """
        text = " ".join(words)
        data = np.frombuffer((" " + text).encode(), np.uint8)
        ends = np.cumsum([1 + len(w.encode()) for w in words])
        out = []
        for side, (ids, size) in enumerate(((self.encode_a(" " + text), self.len_a), (self.pieces.encode(text), self.len_b))):
            ids = np.array(ids, dtype=np.int64)
            end = np.cumsum(size[ids])
            if not len(end) or end[-1] != len(data) or not np.array_equal(self.spelled(ids, side), data):
                return None
            last = np.searchsorted(end, ends)
            if not (end[last] == ends).all():
                return None
            out += [ids, np.diff(last, prepend=-1)]
        return tuple(out)


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, count = key[order], count[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def align(pair: TokenizerPair, texts: list[str]) -> dict:
    """Groups and links of some texts.

    ``n_a, n_b, n_groups, n_links`` and ``text``, the groups written out, by text; ``one`` and ``many`` as (text's place, id of A or pair, links): exact
    pairs, whose ids have the same bytes, and all other linked pairs.
    """
    ids_a, ids_b = pair.encode(texts)
    n_a, n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (ids_a, ids_b))
    a, b = (np.fromiter(chain.from_iterable(ids), np.int64, int(k.sum())) for ids, k in ((ids_a, n_a), (ids_b, n_b)))
    return align_ids(pair, a, n_a, b, n_b)


def align_words(pair: TokenizerPair, words: list[str]) -> dict:
    """:func:`align` of words, many of which are encoded as one text."""
    apart = [i for i, w in enumerate(words) if w == "" or w[-1].isspace() or len(w) > LONG_TEXT] if pair.by_word else range(len(words))
    odd = set(apart)
    together = [i for i in range(len(words)) if i not in odd]
    runs = np.cumsum([len(words[i]) + 1 for i in together]) // LONG_TEXT
    n_a, n_b, ids_a, ids_b, order = [], [], [], [], []
    todo = [together[lo:hi] for lo, hi in _runs(runs)]
    while todo:
        some = todo.pop()
        got = pair.encode_together([words[i] for i in some])
        if got:
            for into, x in zip((ids_a, n_a, ids_b, n_b, order), (*got, some), strict=True):
                into.append(x)
        elif len(some) > 16:  # find the word that doesn't come back
            todo += [some[: len(some) // 2], some[len(some) // 2 :]]
        else:
            odd.update(some)
    rest = sorted(odd)
    if rest:
        x, y = pair.encode([words[i] for i in rest])
        for into, k, ids in ((ids_a, n_a, x), (ids_b, n_b, y)):
            k.append(np.array([len(i) for i in ids], dtype=np.int64))
            into.append(np.fromiter(chain.from_iterable(ids), np.int64, int(k[-1].sum())))
        order.append(rest)
    made = align_ids(pair, *[np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids_a, n_a, ids_b, n_b)])
    made["order"] = np.array(list(chain.from_iterable(order)), dtype=np.int64)
    return made


def align_ids(pair: TokenizerPair, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> dict:
    """:func:`align` from the ids of all texts and their numbers by text."""
    n = len(n_a)
    end_a, end_b = np.cumsum(pair.len_a[a]), np.cumsum(pair.len_b[b])
    mark = np.zeros(int(end_a[-1]) + 1 if len(a) else 1, bool)
    mark[end_b] = True
    cut_a = mark[end_a]
    mark[:] = False
    mark[end_a[cut_a]] = True
    cut_b = mark[end_b]
    size_a, size_b = (np.diff(np.flatnonzero(c), prepend=-1) for c in (cut_a, cut_b))
    start_a, start_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    doc = np.repeat(np.arange(n), n_a)[start_a]
    out = {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc, minlength=n)}
    total = np.concatenate([[0], np.cumsum(size_a * size_b)])
    edge = np.searchsorted(doc, np.arange(n + 1))
    out["n_links"] = total[edge[1:]] - total[edge[:-1]]
    out["text"] = _written(pair, a, b, cut_a, cut_b, size_a, start_a, start_b, n_a, n_b)

    exact = (size_a == 1) & (size_b == 1)
    exact[exact] = pair.same[a[start_a[exact]]] == b[start_b[exact]]
    key, count = np.unique(doc[exact] << SHIFT | a[start_a[exact]], return_counts=True)
    one, many = ([key], [count]), ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
    rest = np.flatnonzero(~exact)
    links = size_a[rest] * size_b[rest]
    slices = np.split(rest, np.flatnonzero(np.diff(np.cumsum(links) // LINKS)) + 1) if len(rest) else []
    for some in slices:
        w = size_a[some] * size_b[some]
        for g in some[w > LINKS]:
            (x, nx), (y, ny) = (np.unique(ids[s : s + k], return_counts=True) for ids, s, k in ((a, start_a[g], size_a[g]), (b, start_b[g], size_b[g])))
            _sort_out(pair, np.full(len(x) * len(y), doc[g]), np.repeat(x, len(y)), np.tile(y, len(x)), np.outer(nx, ny).ravel(), one, many)
        some, w = some[w <= LINKS], w[w <= LINKS]
        at = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
        wide = np.repeat(size_b[some], w)
        x, y = a[np.repeat(start_a[some], w) + at // wide], b[np.repeat(start_b[some], w) + at % wide]
        _sort_out(pair, np.repeat(doc[some], w), x, y, None, one, many)
    out["one"], out["many"] = _counted(*one), _counted(*many)
    return out


def _sort_out(pair: TokenizerPair, doc: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray | None, one: tuple, many: tuple) -> None:
    same = pair.same[x] == y
    for into, which, key in ((one, same, doc << SHIFT | x), (many, ~same, (doc << 2 * SHIFT) | (x << SHIFT) | y)):
        key = key[which]
        if n is None:
            key, count = np.unique(key, return_counts=True)
        else:
            count = n[which]
        into[0].append(key)
        into[1].append(count)


def _written(pair, a, b, cut_a, cut_b, size_a, start_a, start_b, n_a, n_b) -> list[bytes]:
    """Each text's groups as `a1,a2|b1;a3|b2,b3`; empty for a text without tokens.

    All ids are written at once into rows of seven digits and a separator, whose zero bytes are then left out.
    """
    cells = np.zeros((len(a) + len(b), 8), np.uint8)
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    at_a = np.arange(len(a)) + start_b[group_a]
    at_b = np.arange(len(b)) + (start_a + size_a)[group_b]
    cells[at_a, :7], cells[at_a, 7] = pair.digits[a], np.where(cut_a, ord("|"), ord(","))
    cells[at_b, :7], cells[at_b, 7] = pair.digits[b], np.where(cut_b, ord(";"), ord(","))
    there = cells.ravel() != 0
    length = np.concatenate([[0], np.cumsum(there.reshape(-1, 8).sum(axis=1))])
    text = cells.ravel()[there].tobytes()
    ends = length[np.cumsum(n_a + n_b)].tolist()
    return [text[lo : hi - 1] if hi > lo else b"" for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]


def word_list(text: str) -> list[str]:
    """Parts of a text, each without the one space before it, whose tokens are those of the parts on their own.

    Cut before each space that stands alone: neither encoding joins a space to what is before it. Runs of spaces are left
    inside a part.
    """
    words = text.split(" ")
    if "" not in words:
        return words
    out, joined = [words[0]], words[0] == ""
    for w in words[1:]:
        if joined or w == "":
            out[-1] += " " + w
            joined = w == ""
        else:
            out.append(w)
    return out


class Words:
    """Alignments of parts of texts, each made once; those of whole texts are put together from them.

    Both tokenizers end a token where a part ends (:func:`word_list`), so no group reaches over it. Held are at
    most MOST_WORDS parts or MOST_CHARS characters beyond those of one block of texts; then they are dropped and made anew.
    """

    MOST_WORDS, MOST_CHARS = 1 << 19, 1 << 23

    def __init__(self, pair: TokenizerPair) -> None:
        self.pair = pair
        self._clear()

    def _clear(self) -> None:
        none = np.zeros(0, np.int64)
        self.index: dict[str, int] = {}
        self.text: list[bytes] = []
        self.chars = 0
        self.column = {c: none for c in ("n_a", "n_b", "n_groups", "n_links", "whole", "opens", "ends")}
        # of each part: where its distinct exact ids, and its other pairs, begin; the last number is the end
        self.lists = {c: [np.zeros(1, np.int64), none, none] for c in ("one", "many")}

    def _add(self, words: list[str]) -> None:
        made = align_words(self.pair, words)
        words = [words[i] for i in made["order"].tolist()]
        self.index.update(zip(words, range(len(self.text), len(self.text) + len(words)), strict=True))
        self.text += made["text"]
        self.chars += sum(map(len, words))
        flags = {"whole": [w == "" or n > 0 for w, n in zip(words, made["n_a"], strict=True)], "opens": [w[:1].isspace() for w in words], "ends": [w[-1:].isspace() for w in words]}
        for c, old in self.column.items():
            self.column[c] = np.concatenate([old, np.asarray(flags[c] if c in flags else made[c], dtype=np.int64)])
        for c, shift in (("one", SHIFT), ("many", 2 * SHIFT)):
            edge, key = _by_place(made[c][0], shift, len(words))
            begin, ids, count = self.lists[c]
            self.lists[c] = [np.concatenate([begin, begin[-1] + edge[1:]]), np.concatenate([ids, key]), np.concatenate([count, made[c][1]])]

    def align(self, texts: list[str]) -> dict:
        """:func:`align` of whole texts, with the groups' digests as ``sha``."""
        if len(self.index) > self.MOST_WORDS or self.chars > self.MOST_CHARS:
            self._clear()
        by_text = [word_list(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(by_text))
        new = [w for w in dict.fromkeys(flat) if w not in self.index]
        if new:
            self._add(new)
        at = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        n = len(texts)
        size = np.array([len(w) for w in by_text], dtype=np.int64)
        edge, doc = np.concatenate([[0], np.cumsum(size)]), np.repeat(np.arange(n), size)
        # a space between other white space is not a place to cut, nor is a part that doesn't come back from its ids
        odd = self.column["whole"][at] == 0
        odd[:-1] |= (self.column["ends"][at[:-1]] * self.column["opens"][at[1:]] > 0) & (doc[:-1] == doc[1:])
        whole = np.unique(doc[odd]) if self.pair.by_word else np.flatnonzero(size)
        out = {c: _sums(edge, self.column[c][at]) for c in ("n_a", "n_b", "n_groups", "n_links")}
        joined = [b";".join([self.text[i] for i in at[lo:hi].tolist()]) for lo, hi in zip(edge, edge[1:], strict=False)]
        keep = np.ones(n, bool)
        keep[whole] = False
        # each distinct part of a text once, with its number
        key, times = np.unique((doc << 32 | at)[keep[doc]], return_counts=True)
        doc, at = key >> 32, key & (1 << 32) - 1
        apart = align(self.pair, [texts[i] for i in whole]) if len(whole) else None
        for c, shift in (("one", SHIFT), ("many", 2 * SHIFT)):
            begin, ids, count = self.lists[c]
            length = begin[at + 1] - begin[at]
            where = np.arange(int(length.sum())) + np.repeat(begin[at] - (np.cumsum(length) - length), length)
            keys, counts = [np.repeat(doc, length) << shift | ids[where]], [np.repeat(times, length) * count[where]]
            if apart:
                old, number = apart[c]
                keys.append(whole[old >> shift] << shift | old & ((1 << shift) - 1))
                counts.append(number)
            out[c] = _counted(keys, counts)
        for i, d in enumerate(whole):
            joined[d] = apart["text"][i]
            for c in ("n_a", "n_b", "n_groups", "n_links"):
                out[c][d] = apart[c][i]
        out["sha"] = [hashlib.sha256(t).hexdigest() if t else "" for t in joined]
        return out


def _sums(edge: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sums between offsets."""
    total = np.concatenate([[0], np.cumsum(value)])
    return total[edge[1:]] - total[edge[:-1]]


_LISTS = pa.list_(pa.int64())
_FIELDS = [
    ("kind", pa.int32()), ("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("ids", _LISTS), ("id_n", _LISTS), ("pairs", _LISTS), ("pair_n", _LISTS),
]
_DDL = (
    "kind int, chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "ids array<long>, id_n array<long>, pairs array<long>, pair_n array<long>"
)


def _by_place(key: np.ndarray, shift: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of n texts in keys that begin with a text's place, and the keys without it."""
    return np.searchsorted(key >> shift, np.arange(n + 1)), key & ((1 << shift) - 1)


class _Chunk:
    """Aligned documents until their texts make a chunk; then their rows, and the chunk's row with its distinct pairs."""

    def __init__(self, number: int) -> None:
        self.number, self.chars, self.blocks = number, 0, []

    def add(self, words: Words, doc_ids: list, texts: list[str]) -> None:
        self.blocks.append((doc_ids, words.align(texts)))
        self.chars += sum(map(len, texts))

    def batches(self, vector: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Adds the documents of each exact pair to the vocabulary-length vector; pairs are numbered by the chunk's own list."""
        blocks = [(ids, x, *_by_place(x["one"][0], SHIFT, len(ids)), *_by_place(x["many"][0], 2 * SHIFT, len(ids))) for ids, x in self.blocks]
        pairs, place, docs = np.unique(np.concatenate([b[5] for b in blocks]), return_inverse=True, return_counts=True)
        at = 0
        for ids, x, edge_one, one, edge_many, many in blocks:
            vector += np.bincount(one, minlength=len(vector))
            number = place[at : at + len(many)]
            at += len(many)
            n = len(ids)
            lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(v, pa.int64())) for e, v in ((edge_one, one), (edge_one, x["one"][1]), (edge_many, number), (edge_many, x["many"][1]))]
            scalars = [pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, self.number)), pa.array(ids, pa.int64()), *[pa.array(x[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(x["sha"], pa.string())]
            yield pa.RecordBatch.from_arrays([*scalars, *lists], schema=pa.schema(_FIELDS))
        if len(pairs):
            yield _listed(1, self.number, pairs=pairs, pair_n=docs)


def _listed(kind: int, chunk: int | None, **lists: np.ndarray) -> pa.RecordBatch:
    """One row that holds lists only."""
    row = {"kind": kind, "chunk": chunk} | lists
    return pa.RecordBatch.from_arrays([pa.array([row.get(c)], t) for c, t in _FIELDS], schema=pa.schema(_FIELDS))


def align_corpus(docs: DataFrame, file_a: bytes, file_b: bytes, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Alignment of two tokenizers over all documents (``doc_id, text``).

    One pass encodes each text (its words once each, see :class:`Words`), cuts its tokens into groups where both tokenizers end a token, and writes its distinct linked
    pairs with their links. A pair of ids with the same bytes is read off the identity map: tasks count the
    documents of such pairs in vectors as long as the vocabulary. All other pairs, from irregular groups, are
    listed once for each chunk of documents with the number of its documents, so the pair shuffle gets a row for each
    chunk and pair; the corpus-wide counts go back to the chunks by the same key and meet the documents there.

    Returns a row for each row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``. A text that is null, empty or
    doesn't come back byte for byte from either tokenizer's ids has no tokens: zeros and an empty digest. Strings of
    special tokens inside texts are plain text. Equal rows are documents of their own and counted so. Long texts
    are read whole. An empty table gives no rows; further columns are ignored. Brought to the driver: two vectors as long as A's vocabulary.
    """
    ship_by_value()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, chunk, vector = None, _Chunk(TaskContext.get().partitionId() << 32), np.zeros(0, np.int64)
        for batch in batches:
            if words is None:
                words = Words(TokenizerPair(file_a, file_b))
                vector = np.zeros(len(words.pair.bytes_a), np.int64)
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            block = np.cumsum([len(t) + 1 for t in texts]) // BLOCK_CHARS
            for lo, hi in _runs(block):
                chunk.add(words, ids[lo:hi], texts[lo:hi])
                if chunk.chars >= chunk_chars:
                    yield from chunk.batches(vector)
                    chunk = _Chunk(chunk.number + 1)
        if chunk.blocks:
            yield from chunk.batches(vector)
        if vector.any():
            there = np.flatnonzero(vector)
            yield _listed(2, None, ids=there, id_n=vector[there])

    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/aligned-{uuid.uuid4().hex}"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own.mapInArrow(scan, _DDL).write.option("compression", "zstd").parquet(path)
    made = spark.read.parquet(path)

    exact = made.where("kind = 2").select(F.explode(F.arrays_zip("ids", "id_n")).alias("x")).groupBy(F.col("x.ids").alias("a")).agg(F.sum("x.id_n").alias("n"))
    listed = made.where("kind = 1").select("chunk", F.posexplode(F.arrays_zip("pairs", "pair_n")).alias("at", "x")).select("chunk", "at", F.col("x.pairs").alias("pair"), F.col("x.pair_n").alias("n"))
    counts = listed.groupBy("pair").agg(F.sum("n").alias("docs"))
    most = counts.groupBy(F.shiftright("pair", SHIFT).alias("a")).agg(F.max("docs").alias("n"))
    held, top = ({r["a"]: r["n"] for r in df.collect()} for df in (exact, most))
    size = 1 + max([0, *held, *top])
    exact_docs = np.array([held.get(i, 0) for i in range(size)], dtype=np.int64)
    highest = np.maximum(exact_docs, np.array([top.get(i, 0) for i in range(size)], dtype=np.int64))

    back = listed.drop("n").join(counts, "pair").select("chunk", F.lit(0).alias("kind"), "at", "pair", "docs")
    aligned = made.where("kind = 0").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "ids", "id_n", "pairs", "pair_n")
    both = back.unionByName(aligned.withColumn("kind", F.lit(1)), allowMissingColumns=True).repartition(F.col("chunk")).sortWithinPartitions("chunk", "kind", "at")
    result = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())]

    def lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        return column.offsets.to_numpy() - column.offsets[0].as_py(), column.flatten().to_numpy()

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, found, known = None, [], None
        for batch in batches:
            chunk, kind = batch.column("chunk").to_numpy(), batch.column("kind").to_numpy()
            for lo, hi in _runs(chunk * 2 + kind):
                part = batch.slice(lo, hi - lo)
                if chunk[lo] != here:
                    here, found, known = chunk[lo], [], None
                if kind[lo] == 0:
                    found.append((part.column("pair").to_numpy(), part.column("docs").to_numpy()))
                    continue
                if known is None:
                    pairs, docs_ = (np.concatenate([np.zeros(0, np.int64), *[f[i] for f in found]]) for i in (0, 1))
                    known = docs_, docs_ == highest[pairs >> SHIFT]
                edge, ids = lists(part.column("ids"))
                times = lists(part.column("id_n"))[1]
                edge_many, number = lists(part.column("pairs"))
                times_many = lists(part.column("pair_n"))[1]
                count = _sums(edge, times * exact_docs[ids]) + _sums(edge_many, times_many * known[0][number])
                best = _sums(edge, times * (exact_docs[ids] == highest[ids])) + _sums(edge_many, times_many * known[1][number])
                values = [part.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [pa.array(best, pa.int64()), pa.array(count, pa.int64()), part.column("groups_sha256")]
                yield pa.RecordBatch.from_arrays(values, schema=pa.schema(result))

    return both.mapInArrow(score, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """The runs of equal values, as (from, to)."""
    if not len(values):
        return []
    edge = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return list(zip(edge, edge[1:], strict=False))
