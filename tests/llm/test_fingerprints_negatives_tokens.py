"""Order MinHash, hard negatives and token alignment against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import itertools
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_helpers import prose, told
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"


# --- order MinHash -----------------------------------------------------------------------------


def slow_fingerprint(text, sketch):
    """Tuples by plain loops: number the occurrences, order by each slot's hash, keep text order."""
    from shiftkit.llm.ordermh import _STEP, _mix, kmer_keys

    points = np.array([ord(c) for c in text], dtype=np.uint32)
    if not len(points):
        return ""
    k = min(sketch.k, len(points))
    windows = [text[i : i + k] for i in range(len(text) - k + 1)]
    keys = [int(kmer_keys(points[i : i + k], sketch.k)[0]) for i in range(len(windows))]
    seen, number = Counter(), []
    for w in windows:
        number.append(seen[w])
        seen[w] += 1
    out = ""
    for times in sketch.times[:, 0].tolist():
        order = []
        for i, key in enumerate(keys):
            pair = int(_mix(np.array([(key + number[i] * _STEP) % 2**64], dtype=np.uint64))[0]) if number[i] else key
            order.append(((pair >> 32) * times % 2**32, i))
        tuple_ = 0
        for i in sorted(i for _, i in sorted(order)[: sketch.picks]):
            tuple_ = int(_mix(np.array([(tuple_ * _STEP + keys[i]) % 2**64], dtype=np.uint64))[0])
        out += f"{tuple_ >> 48:04x}"
    return out


@pytest.mark.parametrize("k, picks", [(16, 2), (5, 3), (1, 1)])
def test_fingerprint_matches_plain_loops(k, picks, monkeypatch):
    from shiftkit.llm import ordermh

    monkeypatch.setattr(ordermh, "BLOCK", 64)  # texts go through several blocks
    sketch, rnd = ordermh.OrderSketch(k, picks, 8), random.Random(3)
    for text in ["", "a", "ab" * 90, "x" * 200, prose(rnd, 60), "naïve 漢字 😀 " * 12, "".join(rnd.choice("ab") for _ in range(300))]:
        assert sketch.fingerprint(text) == slow_fingerprint(text, sketch)
        for following in ("", "zz", prose(rnd, 50), text):
            new = ordermh.edited(text, following)
            assert sketch.fingerprint_edited(sketch.sketch(text), new) == slow_fingerprint(new, sketch)


def test_fingerprint_is_sensitive_to_order_and_edits():
    from shiftkit.llm.ordermh import OrderSketch, likeness

    rnd, sketch = random.Random(5), OrderSketch()
    lines = [prose(rnd, 12) for _ in range(60)]
    text, other = "\n".join(lines), "\n".join(prose(rnd, 12) for _ in range(60))
    one = "\n".join([*lines[:30], lines[29], *lines[31:]])  # a line that repeats
    swapped = "\n".join(lines[30:] + lines[:30])  # nearly the same k-mers, another order
    near = [likeness(sketch.fingerprint(text), sketch.fingerprint(x)) for x in (text, one, swapped, other)]
    assert near[0] == 1.0 and 0.8 < near[1] < 1 and 0.3 < near[2] < 0.75 and near[3] < 0.1


def test_fingerprint_documents(spark, docs_of):
    from shiftkit.llm.ordermh import OrderSketch, edited, fingerprint_documents, likeness

    rnd = random.Random(7)
    rows = [(i * 3, prose(rnd, rnd.randrange(1, 80))) for i in range(60)]
    rows += [(7, ""), (8, None), (-5, "ab"), (None, "no id at all"), (9, "same text " * 9), (10, "same text " * 9), (10, "same text " * 9), (11, prose(rnd, 4000))]
    out = fingerprint_documents(docs_of(rows))
    got = Counter(told(out, *out.columns))

    def expect(order):
        sketch, want = OrderSketch(), Counter()
        for (d, t), (_, f) in zip(order, order[1:] + order[:1], strict=True):
            new = edited(t, f)
            own, its, changed = (sketch.fingerprint(x) for x in (t, f, new))
            want[(d, len(t), hashlib.sha256(new.encode()).hexdigest(), own, changed, likeness(own, changed), likeness(own, its))] += 1
        return want

    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == expect(order)
    assert out.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    alone = fingerprint_documents(docs_of([(1, "abcdefgh")])).collect()
    assert [r["edited_sha256"] for r in alone] == [hashlib.sha256(b"abcdefab").hexdigest()] and alone[0]["near_next"] == 1.0
    assert fingerprint_documents(docs_of([(1, "x")]).where("false")).count() == 0


# --- hard negatives ----------------------------------------------------------------------------


def slow_negatives(rows, every=100, n=5):
    """Every score by Python integers; rows of equal content are rows of their own."""
    out = []
    big = lambda i: (i is None, i or 0)
    for a, (ida, la, va) in enumerate(rows):
        if ida is None or ida % every:
            continue
        score = lambda b: sum(x * y for x, y in zip(va, rows[b][2], strict=False))
        scored = sorted((-score(b), big(rows[b][0]), b) for b in range(len(rows)) if b != a)
        for ps, _, p in [s for s in scored if rows[s[2]][1] == la][:n]:
            fit = [s for s in scored if rows[s[2]][1] != la and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:n]
            out += [(ida, rows[p][0], i + 1, rows[b][0], -ps, -s) for i, (s, _, b) in enumerate(fit)]
    return sorted(out, key=repr)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("dim", [3, 64, 70])
def test_negatives_match_brute_force(spark, dim):
    from shiftkit.llm.negatives import mine_negatives

    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(6, dim))
    rows = [(i, i % 4, np.floor(40 * (centres[rng.integers(6)] + 0.5 * rng.normal(size=dim))).astype(int).tolist()) for i in range(700)]
    rows += [(1000, 1, [0] * dim), (1001, 1, rows[100][2]), (1002, 2, rows[100][2]), (1003, 0, rows[100][2]), (1003, 0, rows[100][2]), (None, 2, rows[200][2]), (1100, 9, [1] * dim), (1200, 3, [])]
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<long>").withColumn("row", F.lit("x")).withColumn("score", F.lit(1)).withColumn("block", F.lit(1))
    got = mine_negatives(df, F.col("vec_id") % 100 == 0, block_rows=128)
    assert got.columns == COLUMNS and told(got, *COLUMNS) == slow_negatives(rows)
    assert mine_negatives(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_copies_are_rows_of_their_own(spark):
    from shiftkit.llm.negatives import mine_negatives

    rows = [(0, 1, [3, 4])] * 3 + [(1, 2, [3, 4])] * 7 + [(2, 2, [3, 3])]
    got = mine_negatives(spark.createDataFrame(rows, "vec_id long, label long, v array<long>"), F.col("vec_id") % 100 == 0)
    assert told(got, *COLUMNS) == slow_negatives(rows) and got.count() == 3 * 2 * 5


def test_intervals_hold_and_prune():
    from shiftkit.llm.negatives import Codes, search_block

    rng = np.random.default_rng(2)
    rows, queries = (rng.integers(-60, 60, (n, 64)) for n in (900, 40))
    codes = Codes(64)
    held, planes = codes.encode(rows), codes.planes(queries)
    q, r = (x.ravel() for x in np.meshgrid(range(40), range(900), indexing="ij"))
    truth, estimate, off = (queries[q] * rows[r]).sum(axis=1), 0.0, 0.0
    for plane, code in zip(planes, held, strict=True):
        along, error = codes.product(plane, code, q, r)
        estimate, off = estimate + code[2][r] * along, off + np.abs(code[2][r]) * error
        left = np.sqrt(np.maximum(0, (queries[q] ** 2).sum(axis=1) - np.maximum(0, np.abs(along) - error) ** 2))
        assert (np.abs(truth - estimate) <= off + code[3][r] * left + 1e-6).all()
    any_ = np.full((40, 1), np.inf)
    _, _, _, scored = search_block(codes, rows, held, queries, np.ones((40, 900), bool), -any_, any_, 5)
    assert scored < 0.06 * 40 * 900


def test_unusable_vectors_take_no_part(spark):
    from shiftkit.llm.negatives import integer_vectors

    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.001], 3), (2, None, 1), (3, [1.0, None], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [1.0, 2.0], None), (None, [], 2), (7, [1e30, -1e30], 2)]
    got = told(integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")), "vec_id", "label", "v")
    assert got == sorted([(1, 3, [128, -1]), (None, 2, []), (7, 2, [2**27, -(2**27)])], key=repr)


# --- token alignment ---------------------------------------------------------------------------

needs_tokenizers = pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="tokenizer files not present")


@pytest.fixture(scope="module")
def files():
    return [open(f"{TOKENIZERS}/{n}", "rb").read() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def slow_alignment(rows, files):
    """Groups, links and counts by plain loops over bytes, with the tokenizer libraries themselves."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_str(files[0].decode())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in keep} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in keep)}

    def bytes_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    docs = []
    for doc_id, text in rows:
        data = (" " + (text or "")).encode()
        ids = [(i, bytes(letter[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids] if text else []
        pieces = [(i, bytes_b(i)) for i in b.encode(text)] if text else []
        if not text or b"".join(t for _, t in ids) != data or b"".join(t for _, t in pieces) != data:
            docs.append((doc_id, [], [], []))
            continue
        ends = [set(itertools.accumulate(len(t) for _, t in x)) for x in (ids, pieces)]
        groups = []
        for lo, hi in itertools.pairwise([0, *sorted(ends[0] & ends[1])]):
            cut = []
            for tokens in (ids, pieces):
                at, inside = 0, []
                for i, t in tokens:
                    if lo <= at < hi:
                        inside.append(i)
                    at += len(t)
                cut.append(inside)
            groups.append(cut)
        docs.append((doc_id, ids, pieces, groups))
    count = Counter(pair for _, _, _, g in docs for pair in {(x, y) for p, q in g for x in p for y in q})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, ids, pieces, groups in docs:
        links = [(x, y) for p, q in groups for x in p for y in q]
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((doc_id, len(ids), len(pieces), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=repr)


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
WORDS = ["the", "straße", "Überraschung", "naïveté", "l'été", "漢字", "日本語です", "😀", "running", "tokenization", "12345", "3.14", "foo_bar", "http://x.org/a?b=1", "\n\n", "   ", "\t", "don't"]


@needs_tokenizers
def test_alignment_matches_plain_loops(spark, docs_of, files, monkeypatch):
    from shiftkit.llm import align

    rnd = random.Random(11)
    rows = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 60)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "a▁b"), (203, "<|endoftext|> <s>x</s> <unk> <0x41>"), (204, " "), (205, "=" * 700), (206, "\x00\x01 �"), (None, "no id"), (3, rows[3][1]), (3, rows[3][1])]
    got = align.align_corpus(docs_of(rows).repartition(3), *files, chunk_chars=2000)
    assert got.columns == ALIGNED and told(got, *ALIGNED) == slow_alignment(rows, files)
    assert align.align_corpus(docs_of(rows).where("false"), *files).count() == 0
    none = align.align_corpus(docs_of([(1, None), (2, "")]), *files)
    assert told(none, *ALIGNED) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@needs_tokenizers
def test_large_groups_and_both_encoders(files, monkeypatch):
    from shiftkit.llm import align

    pair = align.TokenizerPair(*files)
    texts = ["abc def", "=" * 300, "漢字 and 日本語", "x" * 400 + " end"]
    whole = align.align(pair, texts)
    assert whole["text"][0].count(b"|") == whole["n_groups"][0]
    monkeypatch.setattr(align, "LINKS", 3)  # most groups are counted from their distinct ids
    small = align.align(pair, texts)
    assert pair.fast
    for kind in ("one", "many"):
        assert [x.tolist() for x in whole[kind]] == [x.tolist() for x in small[kind]]
    fast = [pair.encode_a(t) for t in texts + WORDS]
    monkeypatch.setattr(align, "LONG_TEXT", 0)
    assert [pair.encode_a(t) for t in texts + WORDS] == fast
    assert all(pair.bytes_b[s] == pair.bytes_a[i] for i, s in enumerate(pair.same) if s >= 0)


@needs_tokenizers
def test_words_give_the_alignment_of_whole_texts(files):
    from shiftkit.llm import align

    rnd, pair = random.Random(13), align.TokenizerPair(*files)
    texts = ["".join(rnd.choice([" ", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "a", "the", "1", "'s", "'", "?!", "é", "漢", "▁", "\r\n", "don't"]) for _ in range(rnd.randrange(1, 25))) for _ in range(4000)]
    texts += ["", " ", "  ", " a", "a ", "a  b", " \n \n x", "x \n", "<s> a"]
    words, got = align.Words(pair), []
    words.MOST_WORDS = 500  # dropped and made anew on the way
    assert pair.by_word
    for lo in range(0, len(texts), 300):
        some, whole = words.align(texts[lo : lo + 300]), align.align(pair, texts[lo : lo + 300])
        for c in ("n_a", "n_b", "n_groups", "n_links"):
            assert some[c].tolist() == whole[c].tolist()
        for c in ("one", "many"):
            assert [x.tolist() for x in some[c]] == [x.tolist() for x in whole[c]]
        assert some["sha"] == [hashlib.sha256(t).hexdigest() if t else "" for t in whole["text"]]
        got.append(sum(n > 0 for n in some["n_a"]))
    assert sum(got) > 2000
