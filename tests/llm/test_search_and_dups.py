"""Containment, near-duplicates, chunks and VP-trees against brute force and on edge cases."""

import random
from collections import defaultdict

import numpy as np
import pytest

from shiftkit import session
from shiftkit.llm import chunks, neardup
from shiftkit.llm.components import components
from shiftkit.llm.contain import drop_contaminated, find_contained
from shiftkit.llm.vptree import VPTree, nearest, scored_share
from llm_helpers import lower, prose, told


def sets(text, n, low):
    w = low(text or "").encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_classes(rows, n, percent):
    s = [sets(t, n, lower) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(s[i] & s[j])
            if s[i] and s[j] and 100 * k >= percent * (len(s[i]) + len(s[j]) - k):
                parent[root(i)] = root(j)
    names = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        names[root(i)].append(d)
    first = {r: min((d for d in ds if d is not None), default=None) for r, ds in names.items()}
    return sorted(((d, len(s[i]), first[root(i)] if s[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def test_near_duplicates_match_brute_force(docs_of):
    rnd = random.Random(5)
    rows = [(i, prose(rnd, rnd.randrange(3, 120))) for i in range(1000, 1060)]
    family = prose(rnd, 100).split()
    for i in range(80):  # a large family of near copies, with members that link to some others only
        w = list(family)
        for _ in range(rnd.randrange(5)):
            w[rnd.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(w)))
    chain = prose(rnd, 60).split()
    for i in range(20):  # a chain: neighbours link, ends don't
        chain = [*chain[2:], f"c{i}", f"d{i}"]
        rows.append((200 + i, " ".join(chain)))
    base = rows[0][1]
    rows += [(300 + i, base.upper()) for i in range(30)] + [(400, None), (401, ""), (402, " \t\n"), (403, "one"), (404, "ONE"), (405, "one two"), (None, base), (406, "ｘ " * 5), (300, base.upper()), (407, "longtoken" * 2000)]
    got = told(neardup.near_duplicates(docs_of(rows), 4, 80), "doc_id", "n_shingles", "component_id")
    assert got == brute_classes(rows, 4, 80)


def test_keep_one_keeps_columns_and_one_of_each(docs_of):
    text = "a b c d e f g h i j k"
    df = docs_of([(3, text), (1, text), (2, "z y x w v u t"), (4, None), (5, None), (1, text)])
    out = neardup.keep_one(df)
    assert out.columns == df.columns and told(out, "doc_id") == [(1,), (2,), (4,), (5,)]
    assert neardup.near_duplicates(docs_of([])).collect() == []


def test_keep_one_loses_no_class_on_null_or_repeated_ids(docs_of):
    rnd = random.Random(9)
    texts = [prose(rnd, 40, 10**6) for _ in range(30)]
    rows = [(None, t) for t in texts[:20]] + [(None, texts[0]), (None, texts[1] + " more"), (None, None), (None, ""), (None, "")]
    rows += [(7, texts[20]), (7, texts[21]), (7, texts[21]), (3, texts[21]), (8, texts[22]), (8, texts[23]), (2, texts[23] + " more"), (9, texts[2])]
    got = {(r["doc_id"], r["text"]) for r in neardup.keep_one(docs_of(rows)).collect()}
    assert len(got) == neardup.keep_one(docs_of(rows)).count()
    rest = {(d, t) for d, t in got if t not in (texts[1], texts[1] + " more")}
    assert len(got) - len(rest) == 1  # one of the two near copies without an id
    assert rest == {(None, t) for t in [texts[0], *texts[3:20], None, ""]} | {(9, texts[2]), (7, texts[20]), (3, texts[21]), (8, texts[22]), (2, texts[23] + " more")}


def test_near_duplicates_send_small_batches_to_python(docs_of, spark, monkeypatch):
    seen, plans = [], []
    keep, link = neardup.materialize, neardup.components
    monkeypatch.setattr(neardup, "materialize", lambda df: seen.append(spark.conf.get(session.BATCH_CONF)) or keep(df))
    monkeypatch.setattr(neardup, "components", lambda links: plans.append(links._jdf.queryExecution().toString()) or link(links))
    before = spark.conf.get(session.BATCH_CONF)
    try:
        spark.conf.set(session.BATCH_CONF, "64m")
        text = "a b c d e f g h i j k"
        assert told(neardup.keep_one(docs_of([(1, text), (2, text + " l"), (3, "z y x")])), "doc_id") == [(1,), (3,)]
        assert seen == [str(session.TEXT_BATCH)] * 4 and spark.conf.get(session.BATCH_CONF) == "64m"
        assert "ExistingRDD" not in plans[0]  # an empty list of links would start Python workers of another kind
    finally:
        spark.conf.set(session.BATCH_CONF, before)


def test_small_batches_are_cut_by_bytes_and_the_limit_is_put_back(spark):
    def lengths(batches):
        for batch in batches:
            yield batch.head(1).assign(n=len(batch))[["n"]]

    df = spark.range(0, 2000, 1, 1).selectExpr("repeat('x', 4000) AS text")
    before = spark.conf.get(session.BATCH_CONF)
    try:
        for limit, wanted in (("64m", "200000"), ("64MB", "200000"), ("67108864b", "200000"), ("100k", "100k"), ("1000", "1000")):
            spark.conf.set(session.BATCH_CONF, limit)
            with session.small_batches(spark, 200_000):
                assert spark.conf.get(session.BATCH_CONF) == wanted
            assert spark.conf.get(session.BATCH_CONF) == limit
        spark.conf.set(session.BATCH_CONF, "64m")
        with session.small_batches(spark, 200_000):
            sizes = [r["n"] for r in df.mapInPandas(lengths, "n long").collect()]
        assert sum(sizes) == 2000 and max(sizes) <= 100
        with pytest.raises(KeyError), session.small_batches(spark):
            raise KeyError
        assert spark.conf.get(session.BATCH_CONF) == "64m"
    finally:
        spark.conf.set(session.BATCH_CONF, before)


def test_pigeonhole_keys_meet_up_to_the_threshold(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 65536, neardup.SYMBOLS).astype("<u2")
    for _ in range(50):
        b = a.copy()
        b[rng.choice(neardup.SYMBOLS, neardup.ERRORS, replace=False)] += 1
        chunks_a, chunks_b = a.reshape(-1, neardup.CHUNK), b.reshape(-1, neardup.CHUNK)
        assert ((chunks_a != chunks_b).sum(axis=1) <= 1).any()
    df = spark.createDataFrame([(1, a.tobytes()), (2, b.tobytes())], "node long, sig binary")
    keys = {n: {r["key"] for r in neardup.chunk_keys(df).where(f"node = {n}").collect()} for n in (1, 2)}
    assert len(keys[1]) == neardup.SYMBOLS and keys[1] & keys[2]


@pytest.mark.parametrize("links", [[], [(1, 1)], [(1, 2), (2, 1), (2, 3), (9, 8)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(100, i) for i in range(40, 60)]])
def test_components(spark, links):
    got = dict(components(spark.createDataFrame(links, "u long, v long")).collect())
    want = {}
    for u, v in links * 70:
        if u != v:
            want[u] = want[v] = min(want.get(u, u), want.get(v, v), u, v)
    assert got == want


def brute_contained(docs, items, inside=True):
    """``inside``: items of fewer than five words are looked for inside documents too."""
    low = str.lower
    out = set()
    for d, t in docs:
        for b, x in items:
            want = sets(x, 5, low)
            k = len(want & sets(t, max((len(g) for g in want), default=5) if inside else 5, low))
            if want and 5 * k >= 4 * len(want):
                out.add((d, b, len(want), k))
    return sorted(out, key=repr)


def test_containment_matches_brute_force(spark, docs_of):
    rnd = random.Random(6)
    items = [(i, prose(rnd, n)) for i, n in enumerate([1, 3, 5, 6, 9, 10, 17, 33, 40, 64, 100, 300])] + [(50, None), (51, ""), (52, prose(rnd, 30)), (None, prose(rnd, 20))]
    rows = []
    for i in range(60):
        w = (items[i % 12][1]).split()
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = "edited"
        rows.append((i, f"{prose(rnd, rnd.randrange(300))} {' '.join(w).upper()}\t{prose(rnd, 50)}"))
    rows += [(100, None), (101, ""), (102, items[1][1]), (103, items[1][1] + " more"), (104, prose(rnd, 20000) + " " + items[7][1]), (None, items[8][1]), (105, items[8][1]), (105, items[8][1])]
    bench = spark.createDataFrame([(b, t, 1, 2) for b, t in items], "item_id long, text string, size int, gram int")
    got = told(find_contained(docs_of(rows), bench), "doc_id", "item_id", "n_shingles", "n_found")
    assert got == brute_contained(rows, items) and any(g[3] < g[2] for g in got)
    assert {(102, 1), (103, 1)} <= {g[:2] for g in got}
    hit = {g[0] for g in brute_contained(rows, items, inside=False)}
    assert 103 not in hit
    df = docs_of(rows)
    clean = drop_contaminated(df, bench)
    assert clean.columns == df.columns and told(clean, "doc_id") == sorted(((d,) for d, _ in rows if d not in hit), key=repr)
    assert find_contained(docs_of([]), bench).collect() == [] and find_contained(df, bench.limit(0)).collect() == []


def test_contaminated_rows_take_no_clean_ones_along(spark, docs_of):
    rnd = random.Random(10)
    item, clean = prose(rnd, 30, 10**6), [prose(rnd, 40, 10**6) for _ in range(4)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, item), (None, clean[0]), (None, None), (5, "x " + item), (5, clean[1]), (5, clean[1]), (6, clean[2]), (7, item + " y")]
    got = told(drop_contaminated(docs_of(rows), bench), "doc_id", "text")
    assert got == sorted([(None, clean[0]), (None, None), (5, clean[1]), (5, clean[1]), (6, clean[2])], key=repr)


def test_chunks_do_not_depend_on_blocks_and_resist_insertions(monkeypatch):
    rnd, gear = random.Random(7), chunks.gear_table()
    text = prose(rnd, 3000, 10**6).encode()
    ends = chunks.cuts(text, gear)
    assert ends[-1] == len(text) and ends == sorted(set(ends))
    monkeypatch.setattr(chunks, "BLOCK", 777)
    assert chunks.cuts(text, gear) == ends
    moved = chunks.cuts(text[:5000] + b" inserted words " + text[5000:], gear)
    assert len({e + 16 for e in ends if e > 5100} - set(moved)) <= 2
    for odd in ("x" * 50000, "é" * 30000, "\U0001f600" * 9000, "", " ", "a b"):
        b = odd.encode()
        for start, end in zip([0, *chunks.cuts(b, gear)], chunks.cuts(b, gear), strict=False):
            assert end - start <= chunks.MAX_BYTES
            b[start:end].decode()


def brute_substrings(rows, min_words):
    gear, owners, held = chunks.gear_table(), defaultdict(set), []
    for d, t in rows:
        b = (t or "").encode()
        ends = chunks.cuts(b, gear) if b else []
        parts = [b[s:e] for s, e in zip([0, *ends], ends, strict=False)]
        held.append((d, parts))
        for p in parts:
            owners[p.strip()].add(d)
    out = []
    for d, parts in held:
        seen, flags = set(), []
        for p in parts:
            k = p.strip()
            own = min((x for x in owners[k] if x is not None), default=None)
            flags.append(k in seen or (len(owners[k]) > 1 and own != d))
            seen.add(k)
        i = 0
        while i < len(parts):
            j = i
            while j < len(parts) and flags[j] == flags[i]:
                j += 1
            if flags[i] and len(b"".join(parts[i:j]).split()) < min_words:
                flags[i:j] = [False] * (j - i)
            i = j
        out.append((d, b"".join(p for p, f in zip(parts, flags, strict=True) if not f).decode(), len(parts), sum(flags)))
    return sorted(out, key=repr)


def test_substrings_match_brute_force_and_catch_passages(docs_of):
    rnd = random.Random(8)
    passage, rows = prose(rnd, 70, 10**6), []
    for i in range(40):
        rows.append((i, f"{prose(rnd, rnd.randrange(100), 10**6)} {passage if i % 2 else ''}\n{prose(rnd, 60, 10**6)}"))
    clean = [(200 + i, prose(rnd, 120, 10**6) + "\nThis line is common to many documents and yet short.") for i in range(20)]
    rows += clean + [(50, None), (51, ""), (52, passage + " " + passage), (53, "é ü " * 4000), (54, "x" * 100000), (55, "x" * 100000), (None, passage), (1, rows[1][1])]
    df = chunks.dedup_substrings(docs_of(rows))
    assert told(df, "doc_id", "text", "n_chunks", "n_dropped") == brute_substrings(rows, 20)
    r = {x["doc_id"]: x for x in df.collect()}
    assert all(r[i]["dropped_words"] >= 35 for i in range(3, 40, 2)) and r[1]["n_dropped"] == 0
    assert all(r[d]["n_dropped"] == 0 for d, _ in clean)
    text = dict(rows)
    for d, x in r.items():
        if d is not None and text[d]:
            left = "".join(c for i, c in enumerate(text[d]) if not any(s["start"] <= i < s["end"] for s in x["spans"]))
            assert left == x["text"]
    assert chunks.dedup_substrings(docs_of([])).collect() == []


def test_repeats_without_spaces_leave_one_copy(spark, docs_of, tmp_path):
    from shiftkit.llm.queries import op10_substring_dedup

    rnd = random.Random(11)
    wide = lambda n: "".join(chr(0x4E00 + rnd.randrange(5000)) for _ in range(n))
    whole, passage, code = wide(3000), wide(400), "".join(rnd.choice("abcdef0123456789") for _ in range(100000))
    texts = [whole, whole, wide(200) + passage + wide(200), wide(300) + passage + wide(100), code, code, "short phrase 中文 " + wide(200), "short phrase 中文 " + wide(200), wide(30), wide(30)]
    docs_of(list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op10_substring_dedup(spark, str(tmp_path)).collect()}
    assert [got[i]["kept_chars"] for i in (0, 1, 4, 5)] == [3000, 0, 100000, 0]
    assert all(got[i]["n_shared"] == got[i]["n_chunks"] > 0 for i in (0, 1, 4, 5)) and got[1]["n_dropped"] == got[1]["n_chunks"]
    assert got[2]["kept_chars"] == 800 and 400 <= got[3]["kept_chars"] < 700  # all but the ends of the passage goes
    assert all(got[i]["n_dropped"] == 0 and got[i]["kept_chars"] == len(texts[i]) for i in (6, 7, 8, 9))


def brute_nearest(rows, every, k):
    out = []
    for q, x in rows:
        if q % every == 0:
            s = sorted((-float(np.dot(x, y)), v) for v, y in rows if v != q)[:k]
            out += [(q, i + 1, v, -d) for i, (d, v) in enumerate(s)]
    return out


def test_nearest_is_exact_at_factor_one(spark):
    rng = np.random.default_rng(2)
    near = rng.integers(-3, 4, (300, 6)).astype(float)  # whole numbers: many exact ties
    near[50:120] = near[5]
    rows = [(int(i), list(map(float, v))) for i, v in enumerate(near) if v.any()]
    bad = [(1000, None), (1020, [0.0] * 6), (1040, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (1060, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (1080, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1100, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + bad + rows[:30]], "vec_id long, embedding array<double>, shard int, kind int")
    got = [tuple(r) for r in nearest(df, 20, 20, shard_rows=64).orderBy("query_id", "rank").collect()]
    assert got == brute_nearest(rows, 20, 20)
    assert nearest(df.limit(0)).collect() == []
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nearest(few).orderBy("query_id").collect()] == [(0, 1, 1, 4.0)]


def test_clustered_vectors_meet_few_shards(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 8))
    centres *= 5 / np.linalg.norm(centres, axis=1)[:, None]
    x = centres[rng.integers(40, size=4000)] + 0.02 * rng.standard_normal((4000, 8))
    x[1000:1700] = x[7]  # more equal rows than a shard holds
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)] + [(5020, [1.0] * 8), (5020, [9.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest(df.where("vec_id < 5000"), 100, 20, shard_rows=128).orderBy("query_id", "rank").collect()]
    want = brute_nearest(rows[:4000], 100, 20)
    assert len(got) == len(want) and [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-9)
    same = sum(g[2] == w[2] for g, w in zip(got, want, strict=True))
    assert same == len(want)
    assert nearest(df, 5020, 20, shard_rows=128).where("query_id = 5020").count() == 20
    full = scored_share(df, 100, 20, 1.0, 128)
    assert 0 < scored_share(df, 100, 20, 4.0, 128) < full < 0.6


def test_relaxing_trades_recall_for_work():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 8))
    ids, bound = np.arange(4000), float(np.sqrt((x**2).sum(axis=1).max()) * (1 + 1e-12))
    tree, found = VPTree(ids, x, bound, leaf=64), []
    for relax in (1.0, 1.3, 4.0):
        q, r, _ = tree.search(ids[::20], x[::20], 20, relax)
        found.append(set(zip(q, r, strict=True)))
    assert len(found[0]) == 200 * 20 and len(found[0] & found[1]) > 0.9 * len(found[0]) > len(found[0] & found[2])
