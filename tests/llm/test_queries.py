"""The registered queries on the smallest tables: SQL where there is some, else the contract's laws."""

import hashlib
import os
import zlib
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    from __spark_entry__ import queries

    return queries()[name](spark, SF)


@pytest.mark.parametrize("name", ["op6_near_duplicates", "op7_chat_formatting", "op8_containment", "op9_line_dedup", "op12_hard_negatives"])
def test_query_matches_sql(spark, name):
    import duckdb

    from __spark_entry__ import oracle_sql

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = con.execute(oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    want = sorted((tuple(r) for r in rel.fetchall()), key=repr)
    df = run(spark, name)
    assert sorted(df.columns) == sorted(cols)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == want


def test_mixing_contract(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op1_mixing").collect()}
    assert got.keys() == docs.keys()
    taken, target, size = Counter(), {}, Counter()
    for d, r in got.items():
        assert r["size"] == len(docs[d]["text"].encode().split()) and r["taken"] <= 2 * r["size"]
        taken[docs[d]["source"]] += r["taken"]
        size[docs[d]["source"]] += r["size"]
        target[docs[d]["source"]] = r["target"]
    assert all(taken[s] == int(target[s]) for s in target) and sum(target.values()) == pytest.approx(1.5 * sum(size.values()))


def test_sharding_contract(spark, docs):
    rows = run(spark, "op2_ring_sharding").collect()
    assert {r["doc_id"] for r in rows} == docs.keys() and len(rows) == len(docs)
    n = Counter(r["shard"] for r in rows)
    assert set(n) == set(range(8)) and max(n.values()) - min(n.values()) <= 1
    for r in rows:
        b = docs[r["doc_id"]]["text"].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(b) + 1, zlib.crc32(b), "rows", None)


def test_search_contract(spark):
    import numpy as np

    rows = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = [tuple(r) for r in run(spark, "op3_vp_tree").orderBy("query_id", "rank").collect()]
    want = []
    for q, x in sorted(rows, key=lambda r: r[0]):
        if q % 20 == 0:
            best = sorted((-float(x @ y), v) for v, y in rows if v != q)[:20]
            want += [(q, i + 1, v, -s) for i, (s, v) in enumerate(best)]
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-12)


def test_personal_data_and_substring_digests(spark, docs):
    from shiftkit.llm.pii import base_spans

    for r in run(spark, "op5_personal_data").collect():
        spans = base_spans(docs[r["doc_id"]]["text"])
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[2] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        assert set(joined.split(",")) <= {*r["spans"].split(","), ""}
    for r in run(spark, "op10_substring_dedup").collect():
        text, out, at = docs[r["doc_id"]]["text"], [], 0
        for s in filter(None, r["spans"].split(",")):
            a, b = map(int, s.split(":"))
            out.append(text[at:a])
            at = b
        kept = "".join(out) + text[at:]
        assert (len(kept), hashlib.sha256(kept.encode()).hexdigest()) == (r["kept_chars"], r["kept_sha256"])


def test_toxicity_and_pipeline_run(spark, docs):
    scored = {r["doc_id"]: r for r in run(spark, "op4_toxicity").collect()}
    assert scored.keys() == docs.keys()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for d, r in scored.items())
    out = run(spark, "pipeline").collect()
    n = Counter(r["shard"] for r in out)
    assert out and max(n.values()) - min(n.values()) <= 1 and {r["doc_id"] for r in out} <= docs.keys()


def test_fingerprint_contract(spark, docs):
    from shiftkit.llm.ordermh import OrderSketch, edited, likeness

    order, sketch = sorted(docs), OrderSketch()
    print_of = {d: sketch.fingerprint(docs[d]["text"] or "") for d in order}
    got = {r["doc_id"]: r for r in run(spark, "op11_order_minhash").collect()}
    assert got.keys() == docs.keys()
    for d, following in zip(order, order[1:] + order[:1]):
        text, r = docs[d]["text"] or "", got[d]
        new = edited(text, docs[following]["text"] or "")
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"]) == (len(text), hashlib.sha256(new.encode()).hexdigest(), print_of[d])
        assert r["edited_fingerprint"] == sketch.fingerprint(new) and r["near_edited"] == likeness(print_of[d], r["edited_fingerprint"])
        assert r["near_next"] == likeness(print_of[d], print_of[following])


@pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="tokenizer files not present")
def test_alignment_contract(spark, docs):
    from test_fingerprints_negatives_tokens import ALIGNED, slow_alignment

    files = [open(f"/opt/tokenizers/{n}", "rb").read() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    got = sorted((tuple(r[c] for c in ALIGNED) for r in run(spark, "op13_token_alignment").collect()), key=repr)
    assert got == slow_alignment([(d, docs[d]["text"]) for d in docs], files)
