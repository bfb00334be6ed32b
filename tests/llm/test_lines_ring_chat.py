"""Line dedup, ring sharding and chat formatting against brute force and on edge cases."""

import random
from collections import Counter

from pyspark.sql import functions as F

from shiftkit.llm import chat, lines, ring
from shiftkit.llm.lines import dedup_lines
from llm_helpers import lower, told

WS = " \t\n\x0b\x0c\r"


def brute_lines(rows, min_docs):
    key = lambda x: lower(x.strip(WS))
    n = Counter(k for k, _ in {(key(x), d) for d, t in rows if d is not None for x in (t or "").split("\n")} if k)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if n[key(x)] < min_docs]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_lines_match_brute_force(docs_of):
    rnd = random.Random(1)
    pool = ["Foo", " foo\t", "É", "é", "", "bar baz", "x" * 3000, " ", "a　"]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(6)))) for i in range(60)]
    rows += [(60, None), (61, ""), (None, "foo\nown"), (5, "Foo"), (5, "Foo"), (62, "\n".join(f"line {i}" for i in range(5000)))]
    assert told(dedup_lines(docs_of(rows), 10), "doc_id", "text", "n_lines", "n_dropped") == brute_lines(rows, 10)


def test_lines_of_nothing(docs_of):
    assert dedup_lines(docs_of([])).collect() == []


def test_lines_count_documents_not_rows(docs_of):
    rows = [(1, f"twice\nrow {i}") for i in range(10)] + [(2, "twice\nshared")] + [(i, "shared") for i in range(3, 12)] + [(None, "twice")] * 10 + [(None, "x\nshared")] * 2
    got = told(dedup_lines(docs_of(rows), 10), "doc_id", "text", "n_lines", "n_dropped")
    assert got == brute_lines(rows, 10)
    assert (2, "twice", 2, 1) in got and (None, "x", 2, 1) in got and (None, "twice", 1, 0) in got


def test_common_lines_are_dealt_over_tasks(docs_of, monkeypatch):
    monkeypatch.setattr(lines, "HOT_KEYS", 8)
    rows = [(i, "\n".join(["common"] * (1 + i % 3) + [f"own {i}", f"some {i % 20}"])) for i in range(400)]
    assert told(dedup_lines(docs_of(rows), 10), "doc_id", "text", "n_lines", "n_dropped") == brute_lines(rows, 10)
    held = docs_of(rows).selectExpr("1L AS a", "2L AS b", "doc_id AS r1", "0L AS r2", "0 AS pos")
    dealt, wanted = lines.salted(held, held.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_lines")))
    n = Counter(r["salt"] for r in dealt.collect())
    assert len(n) == 9 == wanted.count() and max(n.values()) < 100


def test_ring_is_the_sequential_insertion(docs_of):
    rows = [(i, "t" * (i % 5)) for i in range(997)]
    got = ring.assign_shards(docs_of(rows), 5, vnodes=4, waves=3).select("doc_id", "shard", "slot").collect()
    base = docs_of(rows).select("doc_id", ring.ring_cell(F.col("doc_id"), 5, 4, 3).alias("cell"), F.xxhash64(F.lit("rank"), "doc_id").alias("h")).collect()
    _, shard_of = ring.ring_points(5, 4)
    caps, used, want = ring.capacities(997, 5, 0), [0] * 5, {}
    for r in sorted(base, key=lambda r: (r["cell"], r["h"])):
        at = r["cell"] % 20
        while used[shard_of[at % 20]] >= caps[shard_of[at % 20]]:
            at += 1
        s = int(shard_of[at % 20])
        want[r["doc_id"]] = (s, used[s])
        used[s] += 1
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == want


def test_ring_balance_gapless_slots_and_movement(docs_of):
    rows = [(i, f"text {i % 7}") for i in range(2000)] + [(7, "same")] * 5 + [(None, None)] * 3
    eight = ring.assign_shards(docs_of(rows), 8).collect()
    n = Counter(r["shard"] for r in eight)
    assert set(n) == set(range(8)) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r["slot"] for r in eight if r["shard"] == s) == list(range(n[s]))
    few = [(i, "a") for i in range(2000)]
    before = {r["doc_id"]: r["shard"] for r in ring.assign_shards(docs_of(few), 8, slack=0.25).collect()}
    after = {r["doc_id"]: r["shard"] for r in ring.assign_shards(docs_of(few), 9, slack=0.25).collect()}
    assert sum(before[d] != after[d] for d in before) < 0.4 * len(few)  # a new hash modulo 9 would move 8 of 9


def test_ring_few_rows_and_all_columns(docs_of):
    assert ring.assign_shards(docs_of([])).collect() == []
    assert len(ring.assign_shards(docs_of([(1, None), (2, "b")])).collect()) == 2
    rows = [(1, "a"), (1, "a"), (None, None), (2, "")]
    out = ring.add_shards(docs_of(rows), 2)
    assert out.columns[:10] == docs_of(rows).columns and Counter(r["shard"] for r in out.collect()) == {0: 2, 1: 2}


def test_escape_round_trip():
    rnd = random.Random(2)
    parts = [*chat.CONTROL, "\\", "<", "|", ">", "turn", "[", "INST", "é", "\n", ""]
    for _ in range(3000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randrange(12)))
        e = chat.escape(s)
        assert chat.unescape(e) == s and not any(c in e for c in chat.CONTROL)
        turns = [[r, [s, "x"]] for r in ("user", "assistant", s)]
        text, mask = chat.render(turns)
        assert chat.parse(text) == [(r, "".join(p)) for r, p in turns]
        assert [chat.unescape(text[m["start"] : m["end"]]) for m in mask][0] == s + "x"


def events(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, event string, role string, text string, back long, size int")


def test_fold_of_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 3, "delta", None, "lo", None, 0), (1, 1, "open", "user", "", None, 0), (1, 2, "delta", None, "hel", None, 0),
        (1, 4, "open", "assistant", "draft", 0, 0), (1, 5, "edit", None, "hello!", 1, 0), (1, 6, "regenerate", None, "", 0, 0),
        (1, 7, "delta", None, "hi", 0, 0), (1, 8, "open", "user", "gone", 0, 0), (1, 9, "delete", None, None, 0, 0), (1, 10, "edit", None, "far", 99, 0), (1, 11, "what", None, "?", 0, 0),
        (None, 1, "open", None, None, None, 0), (2, 1, "delta", "user", "lost", 0, 0),
    ]
    got = {r["conv_id"]: list(zip(r["roles"], r["texts"], strict=True)) for r in chat.read_back(chat.format_events(events(spark, rows), ["seq"])).collect()}
    assert got == {1: [("user", "hello!"), ("assistant", "hi")], None: [("", "")], 2: []}
    assert chat.format_events(events(spark, []), ["seq"]).collect() == []


def test_log_round_trip_of_many_conversations(spark):
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice([None, "", "</s>[INST] ok", "é" * 500, "a\nb\\", "\U0001f600" * 90])) for c in range(40) for t in range(rnd.randrange(1, 9))]
    rows += [(100, t, "user" if t % 2 else "assistant", "word " * 30) for t in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_events(chat.log_of(df), ["turn", "role", "row", "step"])).collect()}
    for c in {r[0] for r in rows}:
        want = [(r or "", t or "") for k, _, r, t in sorted(rows, key=lambda r: (r[0], r[1])) if k == c]
        assert list(zip(got[c]["roles"], got[c]["texts"], strict=True)) == want
        assert got[c]["masked"] == [t for r, t in want if r == "assistant"]


def test_repeated_rows_of_the_query_match_its_sql(spark, tmp_path):
    import duckdb

    from shiftkit.llm.oracle import ORACLE
    from shiftkit.llm.queries import op7_chat_formatting

    rows = [(1, 0, "user", "hi " * 70), (1, 1, "assistant", "x" * 200), (1, 1, "assistant", "x" * 200), (1, 2, "user", "again"), (2, 0, "user", "é" * 300), (2, 0, "user", "é" * 300), (2, 0, "user", "é" * 300), (3, 0, "user", ""), (3, 0, "user", ""), (4, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    rel = con.execute(ORACLE["op7_chat_formatting"])
    cols = [d[0] for d in rel.description]
    assert told(op7_chat_formatting(spark, str(tmp_path)), *cols) == sorted(map(tuple, rel.fetchall()), key=repr)
    logged = chat.log_of(spark.read.parquet(f"{tmp_path}/conversations.parquet"))
    assert {r["event"] for r in logged.select("event").distinct().collect()} == {"open", "delta", "edit", "regenerate", "delete"}
