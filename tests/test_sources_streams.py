"""Text folders, the answer stream, subword ids, sketches, metrics as Columns, and configuration tables."""

import os
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftkit.operators import prompts, sketches, text, vectors
from shiftkit.sources.textfolder import file_stem, read_text_folder, split_stem, write_text_folder
from shiftkit.streaming.answers import current_answers, open_questions, run_merge

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
NAMES = [("gpt4", "hr_1"), ("gemini_pro", "a/b"), ("a.b", "..") , ("", "x"), ("m", ""), ("ü 漢", "100%_%5F~"), ("_", "_staging-1")]


@pytest.mark.parametrize("naming", ["prefix", "suffix"])
def test_stems_come_apart_again(naming):
    for model, name in NAMES:
        if naming == "prefix" or "_" not in name:
            assert split_stem(file_stem(model, name, naming), naming) == (model, name)
    assert file_stem("gpt4", "hr_1") == "gpt4_hr_1" and split_stem("gpt4_hr_1") == ("gpt4", "hr_1")
    assert file_stem("gpt4", "hr_1", "suffix") == "hr_1_gpt4" and split_stem("hr_1_gpt4", "suffix") == ("gpt4", "hr_1")


@pytest.mark.parametrize("naming", ["prefix", "suffix"])
def test_text_folder_round_trip(spark, tmp_path, naming):
    rows = [(m, n, f"text of {m} {n}\n\r\n\x00 é 😀") for m, n in NAMES] + [("n", "null", None), ("n", "nan", "nan"), ("n", "empty", "")]
    df = spark.createDataFrame(rows, "model string, name string, text string")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    write_text_folder(df, a, naming)
    write_text_folder(df.where("model = 'n'").withColumn("text", F.lit("other")), b, naming)
    back = read_text_folder(spark, [a, b], naming).collect()
    got = {(r["dir"], r["model"], r["name"]): r["text"] for r in back}
    assert len(back) == len(got) == 13 and {k[1:]: v for k, v in got.items() if k[0] == a} == {r[:2]: r[2] for r in rows}
    assert {v for k, v in got.items() if k[0] == b} == {"other"}
    write_text_folder(df.where("model = 'n'"), a, naming)  # overwritten as a whole
    assert read_text_folder(spark, a, naming).count() == 3
    write_text_folder(df.where("model = 'gpt4'"), a, naming, mode="append")
    assert read_text_folder(spark, a, naming).count() == 4
    assert not [d for d in os.listdir(a) if d.startswith("_")]
    empty = str(tmp_path / "none")
    write_text_folder(df.where("false"), empty, naming)
    assert read_text_folder(spark, empty, naming).collect() == []


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "a")
    write_text_folder(spark.createDataFrame([("m", "1", "old")], "model string, name string, text string"), path)
    for bad in ([("m", str(i), "new") for i in range(50)] + [("m", None, "x")], [("m", "1", "new"), ("m", "1", "again")]):
        with pytest.raises(Exception):
            write_text_folder(spark.createDataFrame(bad, "model string, name string, text string"), path)
        assert [(r["name"], r["text"]) for r in read_text_folder(spark, path).collect()] == [("1", "old")]
        assert not [d for d in os.listdir(path) if d.startswith("_")]


def test_answers_merge_across_batches_and_restarts(spark, tmp_path):
    t0 = datetime(2020, 1, 1)
    schema = "key string, value string, at timestamp"

    def feed(number, rows):
        spark.createDataFrame([(k, v, None if h is None else t0 + timedelta(hours=h)) for k, v, h in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{number}")

    def run():
        run_merge(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/progress", schema, ["key"], wait="2 hours")
        return {r["key"]: (r["value"], r["status"]) for r in current_answers(spark, f"{tmp_path}/out", ["key"]).collect()}

    feed(0, [("a", None, 0), ("b", "first", 0), ("c", None, 0), ("d", None, 0), (None, "no key", 0), ("a", None, 0), ("x", "lost", None)])
    first = run()
    assert first == {"b": ("first", "answered"), None: ("no key", "answered")}
    feed(1, [("a", "late", 1), ("b", None, 1), ("b", "first", 0), ("a", "late", 1), ("b", "older", -0.1), ("e", "x", 1), ("e", "y", 1)])
    assert run() == first | {"a": ("late", "answered"), "e": ("y", "answered")}
    feed(2, [("z", "tick", 9)])
    feed(3, [("z", "tock", 10)])
    got = run()
    assert got["c"] == (None, "open") and got["d"] == (None, "open") and got["b"] == ("first", "answered") and got["z"] == ("tock", "answered")
    feed(4, [("c", "after all", 11), ("d", None, 11), ("b", "behind the watermark", 2)])
    feed(5, [("z", "last", 20)])
    got = run()
    assert got["c"] == ("after all", "answered") and got["d"] == (None, "open") and got["b"] == ("first", "answered")
    current = current_answers(spark, f"{tmp_path}/out", ["key"])
    assert [r["key"] for r in open_questions(current).collect()] == ["d"]
    assert run() == got  # nothing new, nothing changes


@pytest.mark.parametrize("buckets", [1, 1024])
def test_keys_of_a_bucket_have_their_own_answers_and_timeouts(spark, tmp_path, buckets):
    from shiftkit.streaming.answers import merge_answers

    t0, big = datetime(2020, 1, 1), 2**60 + 1
    schema = "part long, name string, value string, at timestamp"
    feeds = [
        [(big, "a", None, 0), (big + 1, "a", None, 0), (None, "a", "x", 0), (None, None, None, 1), (3, "", None, 0.5), (3, None, "late", 0)],
        [(3, "z", "tick", 2.5)],  # the watermark passes the first deadlines
        [(3, "", None, 2.6), (big, "a", "after all", 2.6), (3, "z", "tock", 9)],
        [(3, "z", "last", 20)],
    ]
    for number, rows in enumerate(feeds):
        spark.createDataFrame([(p, n, v, t0 + timedelta(hours=h)) for p, n, v, h in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{number}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{tmp_path}/in")
    said = []

    def sink(batch, number):
        rows = batch.collect()
        assert len({r[:2] for r in rows}) == len(rows)
        said.extend((*r[:3], r["status"]) for r in rows)

    made = merge_answers(stream, ["part", "name"], wait="2 hours", buckets=buckets)
    assert [f.dataType.simpleString() for f in made.schema] == ["bigint", "string", "string", "timestamp", "string"]
    made.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()
    z = [(3, "z", v, "answered") for v in ("tick", "tock", "last")]
    opened = [(big + 1, "a", None, "open"), (None, None, None, "open"), (3, "", None, "open")]
    answered = [(None, "a", "x", "answered"), (3, None, "late", "answered"), (big, "a", "after all", "answered")]
    assert Counter(r for r in said if r != (big, "a", None, "open")) == Counter(z + opened + answered)


@pytest.mark.skipif(not os.path.isfile(TOKENIZER), reason="tokenizer files not present")
def test_subword_ids_decode_and_have_a_length(spark):
    from tokenizers import Tokenizer

    file = open(TOKENIZER, "rb").read()
    plain = Tokenizer.from_str(file.decode())
    plain.encode_special_tokens = True
    texts = ["hello world", "", None, "naïve 漢字 😀\n", "<|endoftext|> x", "word " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r["k"]: r for r in text.subword_ids(df, "k", "t", file).collect()}
    for k, t in enumerate(texts):
        want = plain.encode(t or "", add_special_tokens=False).ids
        assert got[k]["input_ids"] == want and got[k]["n_tokens"] == len(want)
    back = {r["k"]: r["text"] for r in text.subword_texts(text.subword_ids(df, "k", "t", file), "k", "input_ids", file).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    cut = {r["k"]: r for r in text.subword_ids(df, "k", "t", file, max_len=4, pad_id=9).collect()}
    assert all(cut[k]["input_ids"] == (got[k]["input_ids"] + [9] * 4)[:4] and cut[k]["n_tokens"] == got[k]["n_tokens"] for k in got)


def test_token_ids_of_nulls_repeats_and_limits(spark):
    vocab = spark.createDataFrame([("alpha", 0), ("beta", 1)], "term string, term_id int")
    df = spark.createDataFrame([(1, "Alpha beta gamma"), (1, "Alpha beta gamma"), (2, None), (3, ""), (4, "beta " * 5)], "k int, t string").repartition(3)
    got = Counter((r["k"], tuple(r["input_ids"])) for r in text.token_ids(df, "k", "t", vocab).collect())
    assert got == {(1, (0, 1, -2)): 2, (2, ()): 1, (3, ()): 1, (4, (1,) * 5): 1}
    cut = {r["k"]: r["input_ids"] for r in text.token_ids(df, "k", "t", vocab, max_len=4).collect()}
    assert cut == {1: [0, 1, -2, -1], 2: [-1] * 4, 3: [-1] * 4, 4: [1] * 4}


def test_sketches_merge_to_the_same_bounds(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=20_000)
    data = [(i % 40, None if i % 5 == 0 else i % 5, int(rng.integers(6000)), None if i % 97 == 0 else float(x[i])) for i in range(len(x))]
    df = spark.createDataFrame(data, "chunk int, g int, id int, x double").union(spark.createDataFrame([(99, 9, None, None)], "chunk int, g int, id int, x double"))
    chunks = sketches.chunk_sketches(df, ["chunk", "g"], "id", "x")
    two = sketches.merge_sketches(sketches.merge_sketches(chunks.withColumn("half", F.col("chunk") % 2), ["half", "g"]), ["g"])
    got = {r["g"]: r for r in sketches.sketch_summary(two, ["g"]).collect()}
    assert set(got) == {None, 1, 2, 3, 4, 9} and got[9]["q50"] is None and (got[9]["n_rows"], got[9]["n_values"], got[9]["n_distinct"]) == (1, 0, 0)
    for g in (None, 1, 2, 3, 4):
        values = np.sort([r[3] for r in data if r[1] == g and r[3] is not None])
        ids = len({r[2] for r in data if r[1] == g})
        assert got[g]["n_values"] == len(values) and (got[g]["min"], got[g]["max"]) == (values[0], values[-1])
        assert abs(got[g]["n_distinct"] - ids) <= sketches.distinct_error() * ids
        for p in (25, 50, 75):
            assert abs(np.searchsorted(values, got[g][f"q{p}"]) / len(values) - p / 100) <= sketches.rank_error()


def test_metrics_as_columns(spark):
    rng = np.random.default_rng(8)
    data = [(i, None if i % 2 else "p", float(rng.normal()), [float(v) for v in rng.normal(size=3)]) for i in range(60)]
    df = spark.createDataFrame(data, "k long, pool string, x double, v array<double>")
    mean = F.sum(F.col("x") * F.col("weight")) / F.sum("weight")
    got = vectors.sample_metrics(df, ["pool"], "k", iters=6, size=None, seed=2, metrics={"m": mean, "n": F.sum("weight")}).collect()
    from shiftkit.operators.sampling import bootstrap_draws

    x = {r[0]: r[2] for r in data}
    want = {}
    for r in bootstrap_draws(df.select("k", "pool"), "k", ["pool"], iters=6, seed=2).collect():
        want.setdefault((r["pool"], r["iter"]), []).extend([x[r["k"]]] * r["weight"])
    assert {(r["pool"], r["iter"]): r["n"] for r in got} == {(p, i): 30 for p in (None, "p") for i in range(6)}
    assert all(r["m"] == pytest.approx(np.mean(want[r["pool"], r["iter"]])) for r in got)
    both = vectors.sample_metrics(df, ["pool"], "k", "v", iters=3, size=12, seed=2, metrics={"m": mean, "rows": lambda m: float(len(m))}).collect()
    assert len(both) == 6 and all(r["rows"] == 12 and r["m"] is not None for r in both)
    with pytest.raises(ValueError):
        vectors.sample_metrics(df, ["pool"], "k", "v", size=None)


def test_prompts_from_tables_equal_those_from_lists(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "one <TEXT> mark", "job"), (2, None, "job"), (3, "three", None)], "k int, t string, p string")
    table = {c: spark.createDataFrame([(v,) for v in vs], f"{c} string") for c, vs in (("persona", ["anna", "bob", "bob", None]), ("model", ["m1", "m2"]))}
    h = spark.createDataFrame([("anna", 0, "H0"), ("anna", 1, "H1")], "persona string, block long, history string")
    kinds = spark.createDataFrame([(k, prompts.PROMPT_KINDS[k]) for k in ("score_post", "clean")], "kind string, template string")
    for limit in (prompts.CONFIG_ROWS, 0):  # broadcast, and joined by a shuffle
        monkeypatch.setattr(prompts, "CONFIG_ROWS", limit)
        for of, more in ((["score_post", "clean"], {"post": "p"}), (["learn"], {"history": h})):
            want = prompts.build_prompts(texts, "k", "t", of, ["anna", "bob"], ["m1", "m2"], **more).collect()
            got = prompts.build_prompts(texts, "k", "t", of, table["persona"], table["model"], **more)
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want), key=repr)
    mixed = prompts.build_prompts(texts, "k", "t", kinds, ["anna"], table["model"], post="p").collect()
    assert sorted(r["kind"] for r in mixed) == ["clean"] * 4 + ["score_post"] * 4
    assert prompts.build_prompts(texts, "k", "t", ["clean"], table["persona"].where("false"), ["m"]).collect() == []


def test_subword_slices_are_bounded_and_hold_every_row(monkeypatch):
    monkeypatch.setattr(text, "MOST_AT_ONCE", 10)
    monkeypatch.setattr(text, "MOST_ROWS", 4)
    sizes = [3, 3, 3, 3, 50, 0, 0, 0, 0, 0, 0, 10, 1]
    got = list(text._slices(sizes))
    assert [i for a, b in got for i in range(a, b)] == list(range(len(sizes)))
    assert all(b - a <= 4 and (sum(sizes[a:b]) <= 10 or b - a == 1) for a, b in got) and list(text._slices([])) == []
