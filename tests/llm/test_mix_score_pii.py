"""Mixing, toxicity and personal data: laws, held-out accuracy, brute force and edge cases; the pipeline's stages."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from shiftkit.llm import gru, mixing, pii, toxicity
from llm_helpers import prose, told


def test_permutation_and_its_inverse():
    for n in (1, 2, 3, 16, 17, 1000):
        for key in (0, 12345):
            i = np.arange(n)
            p = mixing.permute(i, np.full(n, n), np.full(n, key))
            assert sorted(p) == list(range(n)) and (mixing.permute(p, np.full(n, n), np.full(n, key), back=True) == i).all()


def test_targets_share_the_excess_again():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.targets([0, 0]) == [0, 0] and mixing.targets([]) == []
    for sizes in ([10, 500, 3], [1, 1, 1, 1000], [5]):
        t = mixing.targets(sizes)
        assert sum(t) == pytest.approx(1.5 * sum(sizes)) and all(x <= 2 * s + 1e-9 for x, s in zip(t, sizes, strict=True))


def test_moves_meet_all_quotas():
    rnd = random.Random(1)
    for _ in range(200):
        wanted = [rnd.randrange(20) for _ in range(6)]
        drawn = Counter(rnd.choices(range(6), k=sum(wanted)))
        out = mixing.moves([drawn[s] for s in range(6)], wanted)
        assert sorted((s, i) for s, lo, hi, _, _ in out for i in range(lo, hi)) == sorted((s, i) for s in range(6) for i in range(drawn[s]))
        assert sorted((b, at + i) for _, lo, hi, b, at in out for i in range(hi - lo)) == sorted((b, i) for b in range(6) for i in range(wanted[b]))


@pytest.fixture
def corpus(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rnd = random.Random(4)
    rows = [(i, prose(rnd, rnd.randrange(60)), rnd.choice(["a", "b", "b", "b", "é", None])) for i in range(300)]
    rows += [(300, None, "a"), (301, "", "b"), (302, " ", "empty"), (303, "one", "tiny"), (304, prose(rnd, 5000), "b"), (5, "again words", "a"), (5, "again words", "a"), (5, "again words", "b"), (None, "no id here", "a")]
    rows += [(306, prose(rnd, 50), "c")] * 2
    return rows, docs_of(rows)


def test_mix_meets_targets_to_the_word(corpus):
    rows, df = corpus
    placements, documents = mixing.mix_sources(df)
    got = mixing.taken_words(placements, documents).collect()
    assert len(got) == len(rows) and sum(r["taken"] for r in got) == pytest.approx(1.5 * sum(r["size"] for r in got), abs=6)
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((d, len((t or "").encode().split())) for d, t, _ in rows if d is not None)
    by = defaultdict(lambda: [0, 0, None])
    for r in documents.select("source", "size", "target").collect():
        by[r["source"]][0] += r["size"]
        by[r["source"]][2] = r["target"]
    for r in placements.join(documents.select("source", "source_no").distinct(), "source_no").collect():
        by[r["source"]][1] += r["words"]
    order = sorted(by, key=lambda s: (s is None, s or ""))
    assert [by[s][2] for s in order] == pytest.approx(mixing.targets([by[s][0] for s in order]))
    for _, (size, taken, target) in by.items():
        assert taken == int(target) <= 2 * size
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    again = mixing.taken_words(*mixing.mix_sources(df)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_blocks_fill_the_slots(corpus):
    _, df = corpus
    slots = defaultdict(list)
    for r in mixing.mix_sources(df)[0].collect():
        slots[r["shard"], r["slot"]].append(r)
    assert sorted(s for _, s in slots) == list(range(len(slots)))
    n = Counter(sum(r["words"] for r in rs) for rs in slots.values())
    assert max(n) == 16 and sum(c for w, c in n.items() if w < 16) <= 3 * 6  # tails and last slots of six sources
    assert all(len({(r["source_no"], r["block"]) for r in rs}) == 1 for rs in slots.values())


def test_rendered_rows_hold_the_words_taken(corpus):
    rows, df = corpus
    docs, key = mixing.numbered(df)
    placements, documents = mixing.mix_sources(docs, key=key)
    out = mixing.render(docs, placements, key)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    words, taken = Counter(), Counter()
    for r in out.collect():
        words[r["doc_id"], r["source"]] += len(r["text"].encode().split())
        assert r["n_chars"] == len(r["text"])
    source = {r[key]: r["source"] for r in docs.select(key, "source").collect()}
    for r in placements.select("row_key", "doc_id", "words").collect():
        taken[r["doc_id"], source[r["row_key"]]] += r["words"]
    assert words == taken and sum(words.values()) == sum(r["taken"] for r in mixing.taken_words(placements, documents).collect())
    whole = {d: t for d, t, _ in rows}
    assert any(r["text"] == whole[r["doc_id"]] for r in out.collect() if r["doc_id"] is not None)


def test_equal_rows_are_taken_each_for_itself(docs_of):
    rnd = random.Random(8)
    text = prose(rnd, 50)
    docs, key = mixing.numbered(docs_of([(1, text, "a"), (1, text, "a"), (1, text, "b")]))
    placements, _ = mixing.mix_sources(docs, key=key)
    got = Counter()
    for r in mixing.render(docs, placements, key).collect():
        got[r["source"]] += len(r["text"].split())
    assert got == {"a": 168, "b": 56}  # 225 words in shares of 3 to 1, whole words


def test_stages_stand_clashing_columns_and_empty_tables(spark):
    """Columns named like those that stages use inside; nulls, repeats and an empty table in each stage."""
    import corpus_pipeline as p

    names = ["row", "row_key", "of", "taken", "starts", "c0", "c1", "start", "words", "mixed_id", "mixed_starts", "sharded_digest", "own_digest", "of_id", "of_digest", "of_copy", "shard", "slot",
             "contaminated_id", "contaminated_row", "kept_id", "kept_row", "class", "score", "a", "b", "sig", "node", "key", "cell", "digest", "size", "part", "gram", "item", "toxic"]
    rnd = random.Random(2)
    rows = [(i, prose(rnd, 30), "en", rnd.choice("ab"), 1) for i in range(12)] + [(None, "without an id", "en", None, 1), (3, None, None, "a", None), (4, "", "en", "a", 0)]
    rows += [rows[0]] * 2
    more = [tuple(2**62 + i for i in range(len(names)))]
    df = spark.createDataFrame([r + more[0] for r in rows], "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{n} long" for n in names))
    labels = spark.createDataFrame([(i, 0, 0) for i in range(12)], "doc_id long, quality int, toxic int")  # nothing to learn: all stay
    items = spark.createDataFrame([(0, prose(rnd, 9))], "item_id long, text string")
    stages = [lambda d: p.drop_toxic(d, labels), lambda d: p.near_duplicates(spark, d, ""), lambda d: p.drop_contaminated(d, items), lambda d: p.mixing(spark, d, ""), lambda d: p.sharding(spark, d, "")]
    for number, stage in enumerate(stages):
        out = stage(df)
        got = out.collect()
        assert out.columns == ([c for c in df.columns if c not in ("shard", "slot")] + ["shard", "slot"] if number == 4 else df.columns)
        assert got and all(r[n] == 2**62 + i for r in got for i, n in enumerate(names) if number < 4 or n not in ("shard", "slot"))
        assert stage(df.where("false")).collect() == []
        if number in (2, 4):
            assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(r[:2] for r in rows)


def plain_permute(i, n, key):
    """The Feistel permutation of one index with Python's integers."""
    half, mask = -(-int(np.ceil(np.log2(max(n, 2) + 1))) // 2), 2**64 - 1

    def f(x, k):
        z = (x + k) * 0x9E3779B97F4A7C15 & mask
        z = (z ^ z >> 29) * 0xBF58476D1CE4E5B9 & mask
        return (z ^ z >> 32) & (1 << half) - 1

    while True:
        left, right = i >> half, i & (1 << half) - 1
        for r in range(4):
            left, right = right, left ^ f(right, (key + r * 0xD1B54A32D192ED03) & mask)
        i = left << half | right
        if i < n:
            return i


def test_mix_replayed_in_plain_loops(corpus, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 50)
    rows, df = corpus
    placements, documents = mixing.mix_sources(df)
    docs = documents.collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = [int(t) for t in mixing.targets([sizes[s] for s in order])]

    def taken(s, i):
        """Block and words of slot i of a source, if none were cut short."""
        blocks = -(-sizes[order[s]] // 16)
        block = plain_permute(i % blocks, blocks, mixing.epoch_key(1, s, i // blocks))
        return block, (sizes[order[s]] - 16 * (blocks - 1)) if block == blocks - 1 else 16

    slots = []  # of each source, until its target is met to the word
    for s, most in enumerate(goal):
        mine, left = [], most
        while left:
            block, words = taken(s, len(mine))
            mine.append((block, min(words, left)))
            left -= mine[-1][1]
        slots.append(mine)
    wanted, total = [len(x) for x in slots], sum(map(len, slots))
    drawn, at = [0] * len(order), []
    for shard in range(-(-total // 50)):
        n = np.random.default_rng([1, shard]).multinomial(min(50, total - 50 * shard), np.array(wanted) / total)
        slot = 0
        for s, k in enumerate(n.tolist()):
            for _ in range(k):
                at.append((shard, slot, s, drawn[s]))
                drawn[s], slot = drawn[s] + 1, slot + 1
    # draws beyond a source's need go, in order, to the sources that lack some
    extra = dict(zip([(s, i) for s in range(len(order)) for i in range(wanted[s], drawn[s])], [(s, i) for s in range(len(order)) for i in range(drawn[s], wanted[s])], strict=True))
    want = Counter()
    for shard, slot, s, i in at:
        s, i = extra.get((s, i), (s, i))
        block, words = slots[s][i]
        for d in docs:
            lo, hi = max(d["start"], 16 * block), min(d["start"] + d["size"], 16 * block + words)
            if d["source_no"] == s and lo < hi:
                want[shard, slot, s, block, d["doc_id"], lo - d["start"], hi - lo] += 1
    got = Counter(tuple(r[c] for c in ("shard", "slot", "source_no", "block", "doc_id", "doc_start", "words")) for r in placements.collect())
    assert got == want
    for s, name in enumerate(order):  # each source's documents lie end to end in its stream
        end = 0
        for d in sorted((d for d in docs if d["source_no"] == s and d["size"]), key=lambda d: d["start"]):
            assert d["start"] == end and d["source"] == name
            end += d["size"]
        assert end == sizes[name]


def test_mix_of_nothing(docs_of):
    df = docs_of([])
    placements, documents = mixing.mix_sources(df)
    assert mixing.taken_words(placements, documents).collect() == []
    docs, key = mixing.numbered(df)
    assert mixing.render(docs, mixing.mix_sources(docs, key=key)[0], key).collect() == []
    only = docs_of([(1, None), (2, "")])
    assert told(mixing.taken_words(*mixing.mix_sources(only)), "doc_id", "taken") == [(1, 0), (2, 0)]


def toxic_rows(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        bad, w = rnd.random() < 0.3, prose(rnd, rnd.randrange(5, 150), 200).split()
        if bad:
            for _ in range(1 + len(w) // 40):
                w.insert(rnd.randrange(len(w)), rnd.choice(["idiot", "Moron", f"vequ{rnd.randrange(50)}x"]))
        out.append((i, " ".join(w), int(bad)))
    return out


def slow_score(net, text):
    """One text's score word by word and window by window, with the network's parameters only."""
    p = {k: v.astype(np.float64) for k, v in net.params.items()}
    size, h_ = gru.WIDTH - 2, gru.HIDDEN
    words = []
    for w in text.split():
        at = 0
        while True:
            words.append(w[at : at + size])
            at += size - 3
            if len(w) <= size or at >= len(w) - 3:
                break

    def vector(w):
        marked, rows = b"^" + w + b"$", []
        for n in (3, 4):
            for i in range(len(marked) - n + 1):
                code = 0
                for c in marked[i : i + n]:
                    code = code * 16777619 % 2**32 ^ c
                rows.append((code ^ code >> 15) * 2654435761 % 2**32 >> 20)
        return np.concatenate([p["word"][net.vocabulary.get(w, 0)], p["char"][rows].mean(axis=0)])

    def states(xs, d):
        h, out = np.zeros(h_), []
        for x in xs:
            a, g = x @ p[f"x{d}"] + p[f"c{d}"], h @ p[f"u{d}"]
            r, z = (1 / (1 + np.exp(-(a[i : i + h_] + g[i : i + h_]))) for i in (0, h_))
            h = (1 - z) * np.tanh(a[2 * h_ :] + r * g[2 * h_ :]) + z * h
            out.append(h)
        return out

    best, start = -np.inf, 0
    while True:
        xs = [vector(w) for w in words[start : start + gru.WINDOW]]
        hs = [np.concatenate(x) for x in zip(states(xs, "f"), states(xs[::-1], "b")[::-1], strict=True)]
        weight = np.array([np.exp(np.tanh(x @ p["a"]) @ p["v"]) for x in hs])
        pooled = sum((x * k for x, k in zip(hs, weight / weight.sum(), strict=True)), np.zeros(2 * h_)) if hs else np.zeros(2 * h_)
        best = max(best, pooled @ p["o"] + p["o0"][0])
        if start + gru.WINDOW >= len(words):
            break
        start += gru.STRIDE
    a, b = net.scale
    return 1 / (1 + np.exp(-(a * best + b)))


def test_scores_match_a_plain_forward_pass():
    rnd = random.Random(21)
    rows = toxic_rows(120, 22)
    net = gru.train([t.encode() for _, t, _ in rows], np.array([y for _, _, y in rows]), epochs=2)
    texts = [t.encode() for _, t, _ in toxic_rows(20, 23)]
    texts += [b"", b" \n", b"one", "漢字".encode() * 60, b"x" * 23 + b" " + b"y" * 22, b" ".join(b"w%d" % rnd.randrange(99) for _ in range(84)), prose(rnd, 700).encode() + b" idiot", b"a" * 500]
    got = net.scores(texts, words=200)
    assert got == pytest.approx([slow_score(net, t) for t in texts], abs=2e-3)
    assert max(got) - min(got) > 0.1


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in gru.start(5, 3).items()}
    ids, y, w = rng.integers(0, 7, (4, gru.WINDOW)), np.array([1, 0, 1, 0.0]), np.ones(4)
    ids[0, 20:] = 0
    word_ids, (grams, weight) = np.array([0, 1, 2, 3, 4, 5, 0]), gru.char_grams([b"", *(b"ab%d" % i for i in range(6))])
    live = (ids > 0).astype(float)

    def loss():
        x = gru.inputs(p, word_ids, grams, weight).astype(np.float64)
        z = gru.forward(p, ids, live, x @ p["xf"] + p["cf"], x @ p["xb"] + p["cb"])[0]
        return (np.logaddexp(0, z) - y * z).mean()

    g = gru.gradients(p, ids, live, word_ids, grams, weight, y, w)
    for k in p:
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        old = p[k][at]
        p[k][at] = old + 1e-4
        up = loss()
        p[k][at] = old - 1e-4
        assert g[k][at] == pytest.approx((up - loss()) / 2e-4, rel=1e-3, abs=1e-6)
        p[k][at] = old


def test_windows_overlap_and_cover_everything():
    for n in (0, 1, gru.WINDOW, gru.WINDOW + 1, 1000):
        starts, owner = gru.cut_windows([n, 3])
        own = starts[owner == 0]
        assert own[0] == 0 and (np.diff(own) == gru.STRIDE).all() and own[-1] + gru.WINDOW >= n and own[-1] < max(n, 1)


def test_long_words_are_read_to_their_end():
    rnd = random.Random(12)
    alphabet = [chr(0x4E00 + i) for i in range(300)]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(30, 200))) for _ in range(400)]
    bad = "罵詈雑言悪口"
    y = np.array([i % 4 == 0 for i in range(400)]).astype(int)
    texts = [t[:20] + (bad if v else "") + t[20:] for t, v in zip(texts, y, strict=True)]
    net = gru.train([t.encode() for t in texts[:300]], y[:300])
    s = net.scores([t.encode() for t in texts[300:]])
    assert ((s >= 0.3) == y[300:]).mean() >= 0.9
    same = "".join(rnd.choice(alphabet) for _ in range(3000))
    a, b, none = net.scores([f"{same}{same[:2000]}".encode(), f"{same}{bad}{same[:2000]}".encode(), b""])
    assert b > a and 0 <= none <= 1  # the passage is seen 9000 bytes behind the start
    for text in (b"", b"a b", b"x" * 22 + b" y", bytes(range(33, 127)) * 3, same.encode(), b"a " + b"b" * 23):
        cut = gru.steps(text)
        assert all(len(w) <= gru.WIDTH - 2 for w in cut)
        for w in text.split():
            assert {w[i : i + 4] for i in range(len(w) - 3)} <= {c[i : i + 4] for c in cut for i in range(len(c) - 3)}
        assert len(text) > 22 or cut == text.split()
    long = b" ".join(b"w%d" % rnd.randrange(500) for _ in range(5000))
    whole = net.scores([long, b"", b"a b"])
    for words in (1, 36, 50, 1000, 4990):
        assert net.scores([long, b"", b"a b"], words=words, known=100) == pytest.approx(whole, abs=1e-5)


def test_toxicity_on_held_out_rows(spark, docs_of):
    rows = toxic_rows(1500, 1)
    df, labels = docs_of([(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (10**6, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df, labels).collect()}
    truth = {i: y for i, _, y in rows}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    hits = Counter((truth[i], got[i]["predicted"]) for i in held)
    assert hits[1, 1] >= 0.9 * (hits[1, 1] + hits[1, 0]) and hits[0, 0] >= 0.95 * (hits[0, 0] + hits[0, 1])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())


def test_long_documents_take_no_places_of_the_sample(spark, docs_of, monkeypatch):
    rows = [(i, ("bad " if i % 2 else "good ") * (50 if i % 5 == 0 else 3), i % 2) for i in range(200)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(i, 1) for i in range(1000, 1200)], "doc_id long, toxic int")
    drawn = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y: drawn.extend(zip(texts, y, strict=True)))
    toxicity.fit_toxicity(docs_of([(i, t) for i, t, _ in rows]), labels, positives=20, negatives=30, most_bytes=100)
    assert Counter(int(y) for _, y in drawn) == {1: 20, 0: 30} and all(len(t) <= 100 for t, _ in drawn)


def test_toxicity_edges(spark, docs_of):
    rows = toxic_rows(400, 2)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    odd = [(10**5, None), (10**5 + 1, ""), (10**5 + 2, "w1 " * 60000 + "idiot moron idiot"), (None, "w1 w2"), (10**5 + 3, "w1 w2"), (10**5 + 3, "w1 w2")]
    df = docs_of([(i, t) for i, t, _ in rows] + odd)
    got = defaultdict(list)
    for r in toxicity.score_toxicity(df, labels).collect():
        got[r["doc_id"]].append(r["score"])
    assert got[10**5] == got[10**5 + 1] and len(got[10**5 + 3]) == 2 and len(set(got[10**5 + 3])) == 1 and len(got[None]) == 1
    assert got[10**5 + 2][0] >= 0.3  # at the very end of a long text
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns and 0 < kept.count() < df.count()
    assert toxicity.score_toxicity(docs_of([]), labels).collect() == []
    none = toxicity.score_toxicity(df, labels.where("toxic = 0")).collect()
    assert len(none) == df.count() and {r["score"] for r in none} == {0.0}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for k in pii.KINDS:
        for m in re.finditer(PATTERNS[k], t):
            d = re.sub("[^0-9]", "", m[0])
            if (k == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (k == "card" and not (12 <= len(d) <= 19 and pii.luhn(d))) or (k == "phone" and not 9 <= len(d) <= 15):
                continue
            out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2]), s[1]))


def test_base_spans_match_the_patterns():
    rnd = random.Random(3)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    for _ in range(20000):
        t = "".join(rnd.choice("a1.0@-+ 2(9)%_é3\n5") for _ in range(rnd.randrange(1, 60)))
        assert pii.base_spans(t) == brute_spans(t)
    for shape in ("1", "a", "a@", "1.", "+1(", "1 ", "@"):
        pii.base_spans(shape * 100000)


TRAIN = "call +1 (555) 123-4567 now or 4111 1111 1111 1111 at a.b@c.de or 10.0.0.1 and 2024 units"


def test_skip_edges_carry_labels(docs_of):
    rows = [(i, TRAIN) for i in range(30)] + [(100, "x 77 y"), (101, None), (102, ""), (None, "a@b.cc")]
    rows += [(200, "it is +1 (555) 123-4567 ok. Far away again (555) 123-4567 and 12 apples"), (201, "mail a.b@c.de " + "word " * 30000 + "A.B@C.DE and a.b@c.de")]
    rows += [(202, " ".join(str(i) for i in range(3000)))]
    got = {r["doc_id"]: r for r in pii.find_personal(docs_of(rows)).collect()}
    for d, t in rows:
        assert [(s["start"], s["end"], s["kind"]) for s in got[d]["base"]] == brute_spans(t or "")
    text = rows[-3][1]
    assert [(text[s["start"] : s["end"]], s["kind"]) for s in got[200]["added"]] == [("(555) 123-4567", "phone")]
    assert len(got[201]["base"]) == 3 and got[101]["base"] == got[102]["added"] == []
    assert pii.find_personal(docs_of([])).collect() == []


BARE = ["5551234567", "(555) 123-4567", "555.123.4567", "1 555 123 4567", "4111.1111.1111.1111", "4111/1111/1111/1111", "j.doe@intranet"]


@pytest.mark.parametrize("times", [1, 12, 50])
def test_bare_repeats_of_a_marked_entity_are_all_found(docs_of, times):
    """With the query's own parameters; numbers that no pattern marks anywhere stay out."""
    rnd = random.Random(times)
    plain = [" ".join(rnd.choice(["order", "of", "in", "item"]) + " " + rnd.choice([str(rnd.randrange(10**k)) for k in (2, 4, 7, 10, 12)]) for _ in range(40)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(plain)] + [(100 + i, TRAIN.replace("123-4567", f"123-{4000 + i}")) for i in range(30)]
    marked = "call +1 (555) 123-4567, pay 4111 1111 1111 1111, write j.doe@example.org"
    for i, bare in enumerate(BARE):
        words = prose(rnd, 400).split()
        words[10] = marked
        for _ in range(times):
            words.insert(rnd.randrange(20, len(words)), f"again {bare} and")
        words.insert(300, "in 2024 or 1111 of 123-9999 and 5551239999 too")
        rows.append((1000 + i, " ".join(words)))
    got = {r["doc_id"]: r for r in pii.find_personal(docs_of(rows)).collect()}
    text = dict(rows)
    for i, bare in enumerate(BARE):
        found = Counter(text[1000 + i][s["start"] : s["end"]] for s in got[1000 + i]["added"])
        assert found == {bare: times}, (bare, found)
    assert not any(got[i]["added"] for i in [*range(60), *range(100, 130)])


def test_messages_agree_with_enumeration():
    rng = np.random.default_rng(5)
    field = pii.Field()
    field.names, field.node = {"a": 0, "b": 1, "c": 2}, rng.standard_normal((3, pii.N))
    field.chain, field.skip = rng.standard_normal((pii.N, pii.N)), np.eye(pii.N) * 1.5
    # a tree, so messages are exact: a hub of two tokens, one of which is known
    feats, chain, hubs, known = [["a"], ["b"], ["c"], ["a"]], [(0, 1), (1, 2)], [[1, 3]], np.array([0, 0, 0, 2])
    want, own = np.zeros((4, pii.N)), field.scores(feats)
    own[3, 2] += 50
    for labels in np.ndindex(*[pii.N] * 5):
        w = np.exp(sum(own[i, k] for i, k in enumerate(labels[:4])) + sum(field.chain[labels[i], labels[j]] for i, j in chain) + sum(field.skip[labels[i], labels[4]] for i in hubs[0]))
        for i, k in enumerate(labels[:4]):
            want[i, k] += w
    assert field.marginals(feats, chain, hubs, known=known) == pytest.approx(want / want.sum(axis=1, keepdims=True), abs=1e-3)


def test_pipeline_stages(spark, docs_of):
    import corpus_pipeline

    rnd = random.Random(9)
    text = prose(rnd, 60, 10**6)
    item = prose(rnd, 40, 10**6)
    rows = [(i, prose(rnd, 50, 10**6)) for i in range(30)] + [(100, text), (101, text + " more"), (102, prose(rnd, 200, 10**6) + " " + item), (103, None), (104, "")]
    df = docs_of(rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert told(corpus_pipeline.near_duplicates(spark, df, ""), "doc_id") == sorted([(d,) for d, _ in rows if d != 101], key=repr)
    mixed = corpus_pipeline.mixing(spark, df, "")
    sharded = corpus_pipeline.sharding(spark, mixed, "")
    assert sharded.columns == [*df.columns, "shard", "slot"] and sharded.count() == mixed.count()
    n = Counter(r["shard"] for r in sharded.collect())
    assert max(n.values()) - min(n.values()) <= 1


def test_the_network_is_fitted_in_a_task(spark, monkeypatch):
    import os

    def where(texts, labels):
        # the sample comes whole and in order of doc_id
        return gru.Network(gru.start(1, 0), {b"w": 1}, (os.getpid(), float(texts == sorted(texts) and len(texts) * int(np.sum(labels)))))

    monkeypatch.setattr(toxicity, "fit_network", where)
    docs = spark.createDataFrame([(i, f"text {i:03}") for i in range(60)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    net = toxicity.fit_toxicity(docs, labels)
    known = docs.where(~toxicity.held_out(docs["doc_id"])).select("doc_id").collect()
    assert net.scale[0] != os.getpid() and net.scale[1] == len(known) * sum(r[0] % 2 for r in known)
    assert toxicity.fit_toxicity(docs, labels.where("toxic = 1")) is None and toxicity.fit_toxicity(docs.where("false"), labels) is None


def test_scoring_holds_a_slice_of_a_batch(spark, monkeypatch):
    class Counting:
        def scores(self, texts):
            return np.full(len(texts), len(texts) / 100)

    monkeypatch.setattr(toxicity, "ROWS", 4)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(10)], "doc_id long, text string").coalesce(1)
    score = toxicity.toxicity_score(Counting())
    got = docs.select("doc_id", score(docs["text"]).alias("n")).orderBy("doc_id").collect()
    assert [round(100 * r["n"]) for r in got] == [4] * 8 + [2, 2]
    assert docs.where("false").select(score(docs["text"])).collect() == []


def test_the_network_s_arrays_are_made_in_slices(monkeypatch):
    rng = np.random.default_rng(6)
    words = [b"w%d" % i for i in range(300)] + [b"", b"x" * 30]
    texts = [b" ".join(words[i] for i in rng.integers(0, 300, 400)) for _ in range(6)] + [b""]
    net = gru.train(texts, np.array([0, 1, 0, 1, 0, 1, 0]), epochs=1)
    grams, weight = gru.char_grams(words)
    want = net.scores(texts)
    most = []
    inputs = gru.inputs
    monkeypatch.setattr(gru, "SLICE", 16)
    monkeypatch.setattr(gru, "inputs", lambda p, ids, *a: most.append(len(ids)) or inputs(p, ids, *a))
    sliced = gru.char_grams(words)
    assert (sliced[0] == grams).all() and (sliced[1] == weight).all()
    net.forget()
    assert net.scores(texts) == pytest.approx(want, abs=1e-6) and max(most) == 16 and sum(most) >= 300
