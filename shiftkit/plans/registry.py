"""Queries on the driver's test tables, one per operator of the survey.

Each entry is ``(spark, sf_dir) -> DataFrame``. The stand-in mapping (which table plays profiles,
decisions, answers, evaluations or pools) is written down in ``README.md``. Every computed float is
rounded to 9 digits, as the SQL oracle does, so results compare exactly.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftkit.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DIGITS = 9


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r9(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, DIGITS)


def epoch_micros(df, col):
    """Microseconds since 1970-01-01 of a timestamp column, independent of the session time zone
    for zone-less (``timestamp_ntz``) columns."""
    if df.schema[col].dataType.typeName() == "timestamp_ntz":
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, F.col(col))
    return F.unix_micros(F.col(col))


def _pools(spark, sf):
    """``embeddings`` as pools: pool = label, text name = rank of vec_id inside the label."""
    return read_table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("pool"), "embedding")


# ---------------------------------------------------------------------------------------------
# vectors


@query
def pool_separation(spark, sf):
    from shiftkit.operators.vectors import pool_separation as sep

    out = sep(_pools(spark, sf), ["pool"], "embedding", "cosine")
    return out.select("pool", r9("separation").alias("separation"), "n_undefined")


# ---------------------------------------------------------------------------------------------
# stand-in views


def _docs(spark, sf):
    return read_table(spark, sf, "documents")


def _is_us():
    return F.when(F.col("lang") == "en", 1).otherwise(0)


def _events_phase(spark, sf):
    """``events`` as evaluations: resume = user_id, model = event_type, score = value; rows in the
    first half of the time range are 'original', the rest 'updated'."""
    ev = read_table(spark, sf, "events")
    us = epoch_micros(ev, "ts")
    mid = ev.agg(F.floor((F.min(us) + F.max(us)) / 2).cast("long")).scalar()
    return ev.withColumn("phase", F.when(us <= mid, "original").otherwise("updated"))


def _answers_long(spark, sf):
    """``conversations`` as melted survey answers: a user turn is the answer to ``q_<conv>_<turn>``,
    the assistant turn after it is that answer's comment."""
    c = read_table(spark, sf, "conversations")
    cid, turn = F.col("conv_id").cast("string"), F.col("turn")
    var = (
        F.when(F.col("role") == "user", F.concat(F.lit("answer.q_"), cid, F.lit("_"), turn.cast("string")))
        .when(F.col("role") == "assistant",
              F.concat(F.lit("answer.q_"), cid, F.lit("_"), (turn - 1).cast("string"), F.lit("_comment")))
        .otherwise(F.concat(F.lit("agent."), F.col("role"), F.lit("_"), cid, F.lit("_"), turn.cast("string")))
    )
    return c.select(F.lit("persona").alias("agent"), F.lit("model").alias("model"), var.alias("variable"),
                    F.col("text").alias("value"))


# The kinds of updates.
UPDATE_TYPES = ["clean", "redact", "improve"]


def _updates_long(spark, sf):
    """``conversations`` as update answers: the k-th exchange (turn // 2) answers ``<type>_<conv_id>``, the types taking turns,
    and three exchanges make a ``part`` (k // 3) of a conversation; the assistant turn is the comment. Every
    part was asked for all three types: a left join from the questions leaves the missing answers NULL."""
    c = read_table(spark, sf, "conversations")
    kinds = F.array(*[F.lit(k) for k in UPDATE_TYPES])
    k = F.floor((F.col("turn") - F.when(F.col("role") == "assistant", 1).otherwise(0)) / 2)
    key, part = F.col("conv_id").cast("string"), F.floor(k / 3)
    kind = F.element_at(kinds, (F.pmod(k, F.lit(3)) + 1).cast("int"))
    var = (
        F.when(F.col("role") == "user", F.concat(F.lit("answer."), kind, F.lit("_"), key))
        .when(F.col("role") == "assistant", F.concat(F.lit("answer."), kind, F.lit("_"), key, F.lit("_comment")))
        .otherwise(F.concat(F.lit("agent."), F.col("role"), F.lit("_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")))
    )
    rows = c.select("role", key.alias("_key"), part.alias("part"), var.alias("variable"), F.col("text").alias("value"))
    asked = rows.where(F.col("role") == "user").select("_key", "part").distinct().select("_key", "part", F.explode(kinds).alias("_kind")).select(
        F.concat(F.lit("answer."), F.col("_kind"), F.lit("_"), F.col("_key")).alias("variable"), "part")
    answers = asked.join(rows.where(F.col("role") == "user").select("variable", "part", "value"), ["variable", "part"], "left")
    rest = rows.where((F.col("role") != "user") | F.col("role").isNull()).select("variable", "part", "value")
    return answers.unionByName(rest).select(F.lit("persona").alias("agent"), "part", "variable", "value")


def _decisions_long(spark, sf):
    """``labels`` as two personas' yes/no answers: persona 'quality' and 'toxic', question q_<doc_id>."""
    lab = read_table(spark, sf, "labels")

    def part(col):
        return lab.select(F.lit(col).alias("agent"), F.concat(F.lit("answer.q_"), F.col("doc_id").cast("string")).alias("variable"),
                          F.when(F.col(col) == 1, "Yes").otherwise("No").alias("value"))
    return part("quality").unionByName(part("toxic"))


# ---------------------------------------------------------------------------------------------
# IO


@query
def corpus_union(spark, sf):
    from shiftkit.sources.corpus import corpus_union as union

    docs = _docs(spark, sf).select(F.col("doc_id").alias("text_name"), "text")
    pages = read_table(spark, sf, "pages").select(F.col("page_id").alias("text_name"), F.col("html").alias("text"))
    return union([("documents", docs), ("pages", pages)])


@query
def category_file_ids(spark, sf):
    from shiftkit.sources.corpus import category_file_ids as ids

    return ids(_docs(spark, sf).select("doc_id", "source"), "source", "doc_id")


# ---------------------------------------------------------------------------------------------
# filters and predicates


@query
def drop_null_text(spark, sf):
    conv = read_table(spark, sf, "conversations").where(F.col("role") == "user")
    j = _docs(spark, sf).select("doc_id").join(
        conv.select(F.col("conv_id").alias("doc_id"), F.col("text").alias("answer")), "doc_id", "left")
    return j.dropna(subset=["answer"])


@query
def filter_active(spark, sf):
    return _docs(spark, sf).where(F.col("n_chars") > 1000).select("doc_id", "source", "n_chars")


KEYWORDS = ["nicht", "vous", "tion"]


@query
def keyword_filter(spark, sf):
    from shiftkit.operators.text import keyword_filter as kf

    return kf(_docs(spark, sf), "text", KEYWORDS).select("doc_id", "lang")


@query
def binary_label(spark, sf):
    return _docs(spark, sf).select("doc_id", _is_us().alias("is_us"))


@query
def complete_cases(spark, sf):
    lab = read_table(spark, sf, "labels")
    return _docs(spark, sf).select("doc_id", "source").join(lab, "doc_id", "left").dropna(how="any")


def _grid(spark, sf):
    """``events`` as an improvement grid: draft model = event_type; improver 'rewrite' in the
    second half of the time range, NULL (baseline) before; judge = judge_<user_id mod 3>."""
    ev = _events_phase(spark, sf)
    return ev.select(
        "event_id", F.col("event_type").alias("drafting_model"),
        F.when(F.col("phase") == "updated", "rewrite").alias("improving_model"),
        F.concat(F.lit("judge_"), (F.col("user_id") % 3).cast("string")).alias("scoring_model"),
        F.col("value").alias("score"),
    )


@query
def trim_scores(spark, sf):
    from shiftkit.operators.scores import trim_scores as trim

    return trim(_grid(spark, sf), "improving_model", "score").select("event_id", "improving_model", "score")


@query
def correct_flag(spark, sf):
    from shiftkit.operators.metrics import correct_flag as cf

    j = read_table(spark, sf, "labels").join(_docs(spark, sf).select("doc_id", _is_us().alias("pred")), "doc_id")
    return cf(j, "quality", "pred").select("doc_id", "quality", "pred", "correct")


@query
def median_threshold_label(spark, sf):
    from shiftkit.operators.metrics import median_threshold_label as mtl

    return mtl(_docs(spark, sf).select("doc_id", "n_chars"), "n_chars")


# ---------------------------------------------------------------------------------------------
# reshaping


@query
def survey_long(spark, sf):
    from shiftkit.operators.answers import survey_long as sl

    wide = read_table(spark, sf, "labels").select(
        F.col("doc_id").alias("agent.agent_name"), F.col("quality").alias("answer.quality"), F.col("toxic").alias("answer.toxic"))
    return sl(wide, ["agent.agent_name"]).withColumnRenamed("agent.agent_name", "agent")


@query
def score_comment_pairs(spark, sf):
    from shiftkit.operators.answers import score_comment_pairs as scp

    return scp(_answers_long(spark, sf))


@query
def parse_decisions(spark, sf):
    from shiftkit.operators.answers import parse_decisions as pd_

    return pd_(_decisions_long(spark, sf))


@query
def parse_answers(spark, sf):
    from shiftkit.operators.answers import parse_answers as pa

    return pa(_answers_long(spark, sf), r"q_(\d+)_")


def _parsed_updates(spark, sf):
    from shiftkit.operators.answers import parse_updates as pu

    return pu(_updates_long(spark, sf))


@query
def parse_updates(spark, sf):
    return _parsed_updates(spark, sf).select("part", "variable", "update_type", "key", "value")


@query
def pivot_updates(spark, sf):
    from shiftkit.operators.answers import pivot_updates as pv

    return pv(_parsed_updates(spark, sf), ["key", "part"], UPDATE_TYPES)


@query
def profiles_with_updates(spark, sf):
    from shiftkit.operators.answers import pivot_updates as pv

    upd = pv(_parsed_updates(spark, sf), ["key", "part"], UPDATE_TYPES).dropna(how="any")
    prof = _docs(spark, sf).select("doc_id", F.col("text").alias("original"))
    return prof.join(upd.withColumnRenamed("key", "doc_id"), "doc_id")


@query
def split_model_prefix(spark, sf):
    from shiftkit.operators.answers import split_model_prefix as smp

    c = read_table(spark, sf, "conversations")
    named = c.select("conv_id", "turn", F.concat_ws("_", "role", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("name"))
    return smp(named, "name", ["assistant", "system"]).select("conv_id", "turn", "update_model", "resume")


# Stand-in model names for the five event types (the reference's own map is MODEL_SHORT_NAMES).
EVENT_MODEL_NAMES = {"click": "clk", "error": "err", "purchase": "buy", "signup": "sgn", "view": "viw"}


@query
def short_model_name(spark, sf):
    from shiftkit.operators.answers import short_model_name as smn

    return smn(read_table(spark, sf, "events"), "event_type", EVENT_MODEL_NAMES).select("event_id", "model_short")


@query
def parse_label_list(spark, sf):
    from shiftkit.operators.answers import parse_label_list as pll

    ev = read_table(spark, sf, "events").select("event_id", "props")
    out = pll(pll(ev, "props", "d", "digit"), "props", "n", "number")
    return out.select("event_id", F.array_join("d", ",").alias("labels_digit"), F.array_join("n", ",").alias("labels_number"))


# ---------------------------------------------------------------------------------------------
# joins


def _three(spark, sf):
    lab = read_table(spark, sf, "labels")
    orig = lab.select("doc_id", F.col("quality").alias("decision"))
    gen = lab.select("doc_id", F.col("toxic").alias("decision"))
    tai = _docs(spark, sf).select("doc_id", _is_us().alias("decision"))
    from shiftkit.operators.scores import decision_three_way as d3

    return d3(orig, gen, tai, "doc_id")


@query
def decision_three_way(spark, sf):
    return _three(spark, sf)


@query
def decision_flips(spark, sf):
    from shiftkit.operators.scores import decision_flips as df_

    return df_(_three(spark, sf))


MODELS = ["click", "error", "purchase", "signup", "view"]


@query
def scores_wide(spark, sf):
    from shiftkit.operators.scores import scores_wide as sw

    cust = read_table(spark, sf, "customer").select("c_custkey")
    out = sw(read_table(spark, sf, "events"), "user_id", "event_type", "value", MODELS, cust, "c_custkey")
    return out.select("c_custkey", *[r9(m).alias(m) for m in MODELS])


def _before_after(spark, sf):
    from shiftkit.operators.scores import before_after

    return before_after(_events_phase(spark, sf), ["user_id", "event_type"], "phase", "value")


@query
def scores_before_after(spark, sf):
    return _before_after(spark, sf).select("user_id", "event_type", r9("score_original").alias("score_original"),
                                           r9("score_updated").alias("score_updated"))


def _patch(spark, sf):
    """A retry run: every answer that was missing comes back as 'retry: <question>'."""
    upd = _updates_long(spark, sf)
    return upd.where(F.col("value").isNull() & F.col("variable").startswith("answer.")).select(
        "part", "variable", F.concat(F.lit("retry: "), F.col("variable")).alias("value"))


@query
def patch_answers(spark, sf):
    from shiftkit.operators.answers import patch_answers as pa

    return pa(_updates_long(spark, sf).select("part", "variable", "value"), _patch(spark, sf), on=["part", "variable"])


@query
def unanswered_questions(spark, sf):
    from shiftkit.operators.answers import unanswered

    todo = unanswered(_parsed_updates(spark, sf))
    prof = _docs(spark, sf).select(F.col("doc_id").alias("key"), "text")
    return todo.join(prof, "key").select(
        "part", "variable", F.element_at(F.split("variable", r"\."), -1).alias("question_name"), "key", "update_type",
        F.concat(F.col("update_type"), F.lit(": "), F.col("text")).alias("prompt"))


@query
def train_test_anti(spark, sf):
    from shiftkit.operators.sampling import hash_split

    lab = read_table(spark, sf, "labels").select("doc_id", "quality")
    train = hash_split(lab, "doc_id", 0.8, seed=11).where(F.col("split") == "train").select("doc_id")
    return lab.join(train, "doc_id", "left_anti")


@query
def truth_vs_prediction(spark, sf):
    truth = read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("decision_true"))
    pred = _docs(spark, sf).select("doc_id", _is_us().alias("decision_pred"))
    return truth.join(pred, "doc_id")


@query
def pool_union(spark, sf):
    from shiftkit.operators.positional import dense_index

    p = dense_index(_pools(spark, sf).select("vec_id", "pool"), ["vec_id"], by=["pool"], out="rank")
    return p.select("vec_id", "pool", F.concat_ws("_", F.col("pool").cast("string"), F.col("rank").cast("string")).alias("name"))


# ---------------------------------------------------------------------------------------------
# scores


def _wide_scores(spark, sf):
    from shiftkit.operators.scores import scores_wide as sw

    return sw(read_table(spark, sf, "events"), "user_id", "event_type", "value", MODELS)


def _gaps(spark, sf):
    from shiftkit.operators.scores import model_gap as mg

    return mg(_wide_scores(spark, sf), ["user_id"], MODELS)


@query
def model_gap(spark, sf):
    return _gaps(spark, sf).select("user_id", "model_a", "model_b", r9("gap").alias("gap"))


@query
def score_histogram(spark, sf):
    from shiftkit.operators.scores import equal_width_histogram

    h = equal_width_histogram(_gaps(spark, sf), "gap", ["model_a", "model_b"], 20)
    return h.select("model_a", "model_b", "bin", r9("bin_lo").alias("bin_lo"), r9("bin_hi").alias("bin_hi"), "n")


def _did(spark, sf):
    from shiftkit.operators.scores import diff_in_diff

    return diff_in_diff(_before_after(spark, sf), "user_id", "event_type", MODELS)


@query
def score_did(spark, sf):
    return _did(spark, sf).select("user_id", "model_a", "model_b", r9("did").alias("did"))


@query
def did_histogram(spark, sf):
    from shiftkit.operators.scores import integer_edge_histogram

    return integer_edge_histogram(_did(spark, sf), "did", ["model_a", "model_b"], -10, 9)


@query
def score_matrix(spark, sf):
    from shiftkit.operators.scores import score_matrix as sm

    out = sm(_events_phase(spark, sf), ["event_type", "user_id"], "phase", "value", ["original", "updated"])
    return out.select(F.col("event_type").alias("eval_model"), F.col("user_id").alias("resume"),
                      r9("original").alias("original"), r9("updated").alias("updated"))


@query
def improvement_ranking(spark, sf):
    from shiftkit.operators.scores import improvement_chain

    out = improvement_chain(_grid(spark, sf), "drafting_model", "improving_model", "scoring_model", "score")
    return out.select("chain", r9("mean_score").alias("mean_score"), "n").orderBy(F.desc("mean_score"), "chain")


@query
def improvement_rows(spark, sf):
    from shiftkit.operators.scores import improvement_rows as rows

    out = rows(_grid(spark, sf), "drafting_model", "improving_model", "scoring_model", "score")
    return out.select("event_id", "chain", r9("score").alias("score"))


@query
def describe_scores(spark, sf):
    from shiftkit.operators.metrics import describe

    d = describe(read_table(spark, sf, "events"), "value", ["event_type"])
    return d.select("event_type", "count", *[r9(c).alias(c) for c in ["mean", "std", "min", "q25", "q50", "q75", "max"]])


@query
def sketched_scores(spark, sf):
    """Scores summarised from sketches of chunks of a thousand events, held against the rows: exact counts, and whether the estimated
    number of users and the ranks of the estimated quartiles are within the sketches' stated errors."""
    from shiftkit.operators.sketches import chunk_sketches, distinct_error, merge_sketches, rank_error, sketch_summary
    from shiftkit.session import materialize, stored

    ev = read_table(spark, sf, "events").withColumn("chunk", F.floor(F.col("event_id") / 1000))
    chunks = stored(chunk_sketches(ev, ["chunk", "event_type"], "user_id", "value"))
    # merged in two steps, as a run that adds chunks day by day would
    days = merge_sketches(chunks.withColumn("day", F.floor(F.col("chunk") / 7)), ["day", "event_type"])
    got = materialize(sketch_summary(merge_sketches(days, ["event_type"]), ["event_type"]))
    probs = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    both = ev.select("event_type", "user_id", "value").join(F.broadcast(got.select(F.col("event_type").alias("of"), "n_distinct", *probs)), F.col("event_type").eqNullSafe(F.col("of")))
    n = F.count("value")
    # the estimate is right if the wanted rank lies between the ranks of its first and last equal value
    inside = [((F.count_if(F.col("value") < F.col(q)) <= (p + rank_error()) * n) & (F.count_if(F.col("value") <= F.col(q)) >= (p - rank_error()) * n)).alias(f"{q}_within") for q, p in probs.items()]
    users = F.countDistinct("user_id")
    return both.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_rows"), users.alias("n_users"), (F.abs(F.max("n_distinct") - users) <= distinct_error() * users).alias("users_within"), *inside)


@query
def evaluator_counts(spark, sf):
    ev = read_table(spark, sf, "events")
    return ev.groupBy("event_type").agg(F.countDistinct("user_id").alias("n_users"))


# ---------------------------------------------------------------------------------------------
# metrics


@query
def category_counts(spark, sf):
    from shiftkit.operators.metrics import category_of, value_counts

    named = _docs(spark, sf).select(F.concat_ws("_", "source", F.col("doc_id").cast("string")).alias("name"))
    return value_counts(named, category_of("name").alias("category"))


@query
def null_profile(spark, sf):
    from shiftkit.operators.metrics import null_profile as npf

    lab = read_table(spark, sf, "labels")
    return npf(_docs(spark, sf).join(lab, "doc_id", "left"))


@query
def confusion_matrix(spark, sf):
    from shiftkit.operators.metrics import confusion_matrix as cm

    return cm(read_table(spark, sf, "labels"), "quality", "toxic")


@query
def accuracy(spark, sf):
    from shiftkit.operators.metrics import accuracy as acc

    return acc(read_table(spark, sf, "labels"), "quality", "toxic").select(r9("accuracy").alias("accuracy"), "n")


def _turn_pairs(spark, sf):
    """Original / updated text pairs: a user turn and the assistant turn right after it."""
    c = read_table(spark, sf, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("original"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("updated"))
    return u.join(a, ["conv_id", "turn"])


@query
def token_f1(spark, sf):
    from shiftkit.operators.metrics import token_f1 as tf
    from shiftkit.operators.text import whitespace_tokens

    def tags(col):
        return F.transform(whitespace_tokens(col), lambda t: F.least(F.length(t), F.lit(12)))

    p = _turn_pairs(spark, sf).select(tags("original").alias("t"), tags("updated").alias("p"))
    return tf(p, "t", "p").select("n_sequences", "n_tokens", r9("micro_f1").alias("micro_f1"))


@query
def auroc_hard(spark, sf):
    from shiftkit.operators.metrics import auroc_hard as au

    return au(read_table(spark, sf, "labels"), "quality", "toxic").select("tp", "fn", "tn", "fp", r9("auroc").alias("auroc"))


def _scored_labels(spark, sf):
    """Quality labels with a score, the text's length, and the source; a document without a label is left out."""
    return read_table(spark, sf, "labels").select("doc_id", "quality").join(_docs(spark, sf).select("doc_id", "source", "n_chars"), "doc_id")


@query
def auroc_score(spark, sf):
    from shiftkit.operators.roc import auroc_score as au

    out = au(_scored_labels(spark, sf), "quality", "n_chars", ["source"])
    return out.select("source", "n_positive", "n_negative", "n_unscored", r9("auroc").alias("auroc"))


@query
def roc_points(spark, sf):
    from shiftkit.operators.roc import roc_points as rp

    out = rp(_scored_labels(spark, sf), "quality", "n_chars", ["source"])
    return out.select("source", "threshold", "tp", "fp", r9("tpr").alias("tpr"), r9("fpr").alias("fpr"))


@query
def distinct_elements(spark, sf):
    from shiftkit.operators.metrics import distinct_elements as de

    return de(_pools(spark, sf), ["pool"], "embedding")


# ---------------------------------------------------------------------------------------------
# sampling


@query
def sample_n(spark, sf):
    from shiftkit.operators.sampling import sample_n as sn

    return sn(_docs(spark, sf).select("doc_id"), "doc_id", 100, seed=7)


def _us_docs(spark, sf):
    return _docs(spark, sf).select("doc_id", _is_us().alias("is_us"))


@query
def stratified_sample(spark, sf):
    from shiftkit.operators.sampling import stratified_sample as ss

    return ss(_us_docs(spark, sf), "doc_id", "is_us", 50, seed=7)


@query
def stratified_train_test(spark, sf):
    from shiftkit.operators.sampling import stratified_train_test as stt

    return stt(_us_docs(spark, sf), "doc_id", "is_us", 25, seed=7)


@query
def positional_split(spark, sf):
    from shiftkit.operators.sampling import positional_split as ps

    return ps(read_table(spark, sf, "labels").select("doc_id"), ["doc_id"], 0.8)


@query
def hash_split(spark, sf):
    from shiftkit.operators.sampling import hash_split as hs

    return hs(_docs(spark, sf).select("doc_id"), "doc_id", 0.8, seed=7)


@query
def bootstrap_draws(spark, sf):
    from shiftkit.operators.sampling import bootstrap_draws as bd

    return bd(_pools(spark, sf).select("vec_id", "pool"), "vec_id", ["pool"], iters=20, seed=3)


# ---------------------------------------------------------------------------------------------
# vectors and embedding geometry


def _ranked_pools(spark, sf):
    """Pools with each vector's rank inside its pool (the text name shared across pools)."""
    from shiftkit.operators.positional import dense_index

    pools = _pools(spark, sf)
    ranks = dense_index(pools.select("vec_id", "pool"), ["vec_id"], by=["pool"], out="rank")
    return ranks.join(pools, ["vec_id", "pool"])


def _reference_vectors(pools):
    return pools.groupBy("pool").agg(F.min_by("embedding", "vec_id").alias("ref_embedding"))


@query
def cosine_to_reference(spark, sf):
    from shiftkit.operators.vectors import distance_to_reference

    p = _pools(spark, sf)
    d = distance_to_reference(p, _reference_vectors(p), ["pool"], "embedding", metric="cosine")
    return d.select("vec_id", "pool", r9("distance").alias("distance"))


@query
def euclid_to_reference(spark, sf):
    from shiftkit.operators.vectors import distance_to_reference

    p = _pools(spark, sf)
    d = distance_to_reference(p, _reference_vectors(p), ["pool"], "embedding", metric="euclidean")
    return d.select("vec_id", "pool", r9("distance").alias("distance"))


@query
def pool_centroid(spark, sf):
    from shiftkit.operators.vectors import vector_mean

    c = vector_mean(_pools(spark, sf), ["pool"], "embedding")
    return c.select("pool", F.posexplode("centroid").alias("dim", "mean")).select("pool", "dim", r9("mean").alias("mean"))


@query
def separation_gap(spark, sf):
    from shiftkit.operators.vectors import pool_separation as sep

    from shiftkit.session import materialize

    # one row a pool, read twice
    s = materialize(sep(_pools(spark, sf), ["pool"], "embedding", "cosine"))
    base = s.where(F.col("pool") == 0).select("separation").scalar()
    return s.select("pool", r9(F.col("separation") - base).alias("gap"))


@query
def separation_bootstrap(spark, sf):
    from shiftkit.operators.vectors import separation_bootstrap as sb

    out = sb(_pools(spark, sf), ["pool"], "vec_id", "embedding", "cosine", iters=100, seed=5)
    return out.select("pool", r9("separation").alias("separation"), r9("separation_sd").alias("separation_sd"))


@query
def median_pairwise_similarity(spark, sf):
    from shiftkit.operators.allpairs import pairwise_median_similarity

    out = pairwise_median_similarity(_pools(spark, sf), ["pool"], "vec_id", "embedding")
    return out.select("pool", r9("median_similarity").alias("median_similarity"))


def _sample_metrics(spark, sf):
    from shiftkit.operators.vectors import sample_metrics

    return sample_metrics(_pools(spark, sf), ["pool"], "vec_id", "embedding", iters=1000, size=100, seed=9)


@query
def bootstrap_metrics(spark, sf):
    s = _sample_metrics(spark, sf)
    return s.select("pool", "iter", r9("median_similarity").alias("median_similarity"), "distinct_elements")


@query
def bootstrap_ci(spark, sf):
    from shiftkit.operators.allpairs import pairwise_median_similarity
    from shiftkit.operators.metrics import distinct_elements
    from shiftkit.operators.vectors import bootstrap_interval

    from shiftkit.session import materialize

    p = _pools(spark, sf)
    # one row per (pool, iteration): small, and read by both metric branches below
    s = materialize(_sample_metrics(spark, sf))
    long = s.select("pool", F.lit("median_similarity").alias("metric"), F.col("median_similarity").alias("v")).unionByName(
        s.select("pool", F.lit("distinct_elements").alias("metric"), F.col("distinct_elements").cast("double").alias("v")))
    ci = bootstrap_interval(long, ["pool", "metric"], "v")
    true = pairwise_median_similarity(p, ["pool"], "vec_id", "embedding").select(
        "pool", F.lit("median_similarity").alias("metric"), F.col("median_similarity").alias("value")).unionByName(
        distinct_elements(p, ["pool"], "embedding").select(
            "pool", F.lit("distinct_elements").alias("metric"), F.col("n_distinct").cast("double").alias("value")))
    return true.join(ci, ["pool", "metric"]).select(
        "pool", "metric", r9("value").alias("value"), r9("ci_lo").alias("ci_lo"), r9("ci_hi").alias("ci_hi"))


@query
def bootstrap_accuracy(spark, sf):
    """Accuracy of the toxic label as a prediction of quality, on 50 full-size resamples of each source's labels."""
    from shiftkit.operators.vectors import sample_metrics

    rows = read_table(spark, sf, "labels").join(_docs(spark, sf).select("doc_id", "source"), "doc_id")
    hit = F.sum(F.when(F.col("quality") == F.col("toxic"), F.col("weight")).otherwise(0)) / F.sum("weight")
    out = sample_metrics(rows, ["source"], "doc_id", iters=50, size=None, seed=17, metrics={"accuracy": hit})
    return out.select("source", "iter", r9("accuracy").alias("accuracy"))


def _paired(spark, sf):
    from shiftkit.operators.vectors import paired_distance as pdist

    rp = _ranked_pools(spark, sf)
    base = rp.where(F.col("pool") == 0).select("rank", "embedding")
    others = rp.where(F.col("pool") != 0).select("pool", "rank", "embedding")
    return pdist(others, base, ["rank"], "embedding", "cosine")


@query
def paired_distance(spark, sf):
    return _paired(spark, sf).select("pool", "rank", r9("distance").alias("distance"))


ROUNDS = list(range(1, 10))


def _drift(spark, sf):
    from shiftkit.operators.scores import pivot_listed

    wide = pivot_listed(_paired(spark, sf), ["rank"], "pool", ROUNDS, F.first("distance"))
    return wide.select("rank", *[F.col(str(r)).alias(f"distance_{r}") for r in ROUNDS])


@query
def drift_by_round(spark, sf):
    return _drift(spark, sf).select("rank", *[r9(f"distance_{r}").alias(f"distance_{r}") for r in ROUNDS])


@query
def drift_mean(spark, sf):
    return _drift(spark, sf).agg(*[r9(F.avg(f"distance_{r}")).alias(f"mean_distance_{r}") for r in ROUNDS])


@query
def distance_band_match(spark, sf):
    from shiftkit.operators.allpairs import band_match

    p = _pools(spark, sf)
    a = p.where(F.col("pool") % 2 == 0).select("vec_id", "embedding")
    b = p.where(F.col("pool") % 2 == 1).select("vec_id", "embedding")
    out = band_match(a, b, "vec_id", "embedding", target=1.2, width=0.05, metric="euclidean")
    return out.select(F.col("key_a").alias("vec_id_a"), F.col("key_b").alias("vec_id_b"), r9("distance").alias("distance"))


def _shift_pairs(spark, sf):
    """Original = the even pools, improved = the odd pool after each, matched by rank."""
    rp = _ranked_pools(spark, sf)
    name = F.floor(F.col("pool") / 2)
    x = rp.where(F.col("pool") % 2 == 0).select(name.alias("pair"), "rank", F.col("embedding").cast("array<double>").alias("x"))
    y = rp.where(F.col("pool") % 2 == 1).select(name.alias("pair"), "rank", F.col("embedding").cast("array<double>").alias("y"))
    return x.join(y, ["pair", "rank"])


def _components(spark, sf):
    """All pools with each vector's scores on the first two principal components of all rows."""
    from shiftkit.operators.vectors import pca_project as pp

    return pp(_pools(spark, sf), "embedding", 2)


def _shift_maps(spark, sf):
    """The linear map from an original's two component scores to its improved one's, per bootstrap sample of all pairs."""
    from shiftkit.operators.positional import dense_index
    from shiftkit.operators.sampling import bootstrap_draws
    from shiftkit.operators.vectors import expand_weights, regression_2d
    from shiftkit.session import materialize

    # scores only, the vectors stay behind
    pc = _components(spark, sf).select("vec_id", "pool", F.col("pc")[0].alias("c0"), F.col("pc")[1].alias("c1"))
    rp = dense_index(pc, ["vec_id"], by=["pool"], out="rank")
    name = F.floor(F.col("pool") / 2)
    x = rp.where(F.col("pool") % 2 == 0).select(name.alias("pair"), "rank", F.col("c0").alias("x0"), F.col("c1").alias("x1"))
    y = rp.where(F.col("pool") % 2 == 1).select(name.alias("pair"), "rank", F.col("c0").alias("y0"), F.col("c1").alias("y1"))
    pairs = materialize(x.join(y, ["pair", "rank"]))
    draws = bootstrap_draws(pairs.select("pair", "rank"), "rank", ["pair"], iters=10, size=100, seed=13)
    return regression_2d(expand_weights(draws.join(pairs, ["pair", "rank"])), ["iter"], "x0", "x1", ["y0", "y1"])


@query
def shift_linear_map(spark, sf):
    return _shift_maps(spark, sf).select(
        "iter", "out_dim", r9("coef_0").alias("coef_0"), r9("coef_1").alias("coef_1"), r9("intercept").alias("intercept"))


@query
def shift_map_summary(spark, sf):
    from shiftkit.operators.vectors import coefficient_summary

    out = coefficient_summary(_shift_maps(spark, sf), ["out_dim"])
    return out.select("out_dim", "n_samples", *[r9(f"{n}_{c}").alias(f"{n}_{c}") for c in ("coef_0", "coef_1", "intercept") for n in ("mean", "sd")])


@query
def shift_pull_estimate(spark, sf):
    from shiftkit.operators.vectors import pull_estimate

    both = _shift_pairs(spark, sf).select(F.posexplode(F.arrays_zip("x", "y")).alias("dim", "v")).select("dim", "v.x", "v.y")
    out = pull_estimate(both, ["dim"], "x", "y")
    return out.select("dim", r9("alpha").alias("alpha"), r9("fixed_point").alias("fixed_point"), "n")


@query
def density_grid(spark, sf):
    from shiftkit.operators.vectors import density_grid as dg

    points = _components(spark, sf).select("pool", F.col("pc")[0].alias("x"), F.col("pc")[1].alias("y"))
    return dg(points, "x", "y", 0.05, ["pool"])


@query
def rewrite_trajectory(spark, sf):
    from shiftkit.operators.vectors import step_distances

    rp = _ranked_pools(spark, sf).withColumnRenamed("pool", "round")
    out = step_distances(rp, ["rank"], "round", "embedding", "cosine")
    return out.select("rank", "round", r9("dist_to_first").alias("dist_to_first"), r9("dist_to_prev").alias("dist_to_prev"))


@query
def pca_project(spark, sf):
    out = _components(spark, sf)
    return out.select("vec_id", "pool", r9(F.col("pc")[0]).alias("pc0"), r9(F.col("pc")[1]).alias("pc1"))


@query
def embed_texts(spark, sf):
    from shiftkit.operators.vectors import embed_texts as et

    out = et(_docs(spark, sf).select("doc_id", "text"), "text", dim=64)
    scaled = F.transform("embedding", lambda x: F.round(x.cast("double") * 100000).cast("long").cast("string"))
    return out.select("doc_id", F.array_join(scaled, ",").alias("embedding"))


# ---------------------------------------------------------------------------------------------
# text features


def _train_docs(spark, sf):
    from shiftkit.operators.sampling import hash_split

    return hash_split(_docs(spark, sf), "doc_id", 0.8, seed=7).where(F.col("split") == "train")


def _vocab(spark, sf):
    from shiftkit.operators.text import vocabulary

    return vocabulary(_train_docs(spark, sf), "text", 5000)


@query
def vocabulary_topk(spark, sf):
    return _vocab(spark, sf).select("term", "n", "term_id")


@query
def token_ids(spark, sf):
    from shiftkit.operators.text import token_ids as ti

    out = ti(_docs(spark, sf), "doc_id", "text", _vocab(spark, sf))
    return out.select("doc_id", F.array_join("input_ids", ",").alias("input_ids"))


#: Where the public tokenizer files are.
TOKENIZERS = "/opt/tokenizers"


@query
def subword_roundtrip(spark, sf, tokenizers=TOKENIZERS):
    """Every document as subword ids of a byte-level tokenizer, and decoded again."""
    from pathlib import Path

    from shiftkit.operators.text import subword_ids, subword_texts

    file = Path(tokenizers, "byte_bpe_50k.json").read_bytes()
    ids = subword_ids(_docs(spark, sf).select("doc_id", "text"), "doc_id", "text", file)
    out = subword_texts(ids, "doc_id", "input_ids", file)
    return out.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


def _revisions(spark, sf):
    from shiftkit.operators.text import token_diff

    return token_diff(_turn_pairs(spark, sf), ["conv_id", "turn"], "original", "updated")


@query
def revision_token_diff(spark, sf):
    from shiftkit.operators.text import revision_summary

    return revision_summary(_revisions(spark, sf), ["conv_id", "turn"])


@query
def ordered_token_diff(spark, sf):
    """The edit script of each user turn and the assistant turn after it, put together to both texts again: words kept or removed
    give the first, words kept or added the second, each in the script's order."""
    from shiftkit.operators.text import ordered_diff

    script = ordered_diff(_turn_pairs(spark, sf), ["conv_id", "turn"], "original", "updated")
    row = F.struct("step", "op", "token", "pos_before", "pos_after")
    g = script.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(row)).alias("s"))

    def side(op, pos):
        rows = F.filter("s", lambda r: r["op"].isin("=", op))
        in_order = F.transform(rows, lambda r: r[pos]) == F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.size(rows) - 1)).otherwise(F.array().cast("array<int>"))
        return F.md5(F.array_join(F.transform(rows, lambda r: r["token"]), " ")), in_order

    (before, first), (after, second) = side("-", "pos_before"), side("+", "pos_after")
    return g.select("conv_id", "turn", before.alias("before_md5"), after.alias("after_md5"), (first & second).alias("in_order"))


@query
def top_added_tokens(spark, sf):
    from shiftkit.operators.text import top_changed_tokens

    return top_changed_tokens(_revisions(spark, sf), 20, "added")


# ---------------------------------------------------------------------------------------------
# templates and prompt tables


@query
def template_params(spark, sf):
    from shiftkit.operators.prompts import template_params as tp

    return tp(read_table(spark, sf, "pages"), "html", ["page_id"])


PROFILE_TEMPLATE = "Profile <ID> (<LANG>, <SOURCE>):\n<TEXT>\n<CONTACT> stays as it is."


@query
def template_fill(spark, sf):
    from shiftkit.operators.prompts import template_fill as tf

    docs = _docs(spark, sf).select("doc_id", F.col("doc_id").alias("ID"), F.col("lang").alias("LANG"),
                                   F.col("source").alias("SOURCE"), F.col("text").alias("TEXT"))
    templates = spark.createDataFrame([("profile", PROFILE_TEMPLATE)], "template_id string, template string")
    return tf(templates, docs, ["doc_id"])


PERSONAS = ["recruiter", "peer"]
# Short names of models.
PROMPT_MODELS = ["gpt4", "gemini", "mixtral"]


@query
def prompt_grid(spark, sf):
    from shiftkit.operators.prompts import build_prompts

    # personas and models as configuration tables
    personas = spark.createDataFrame([(p,) for p in PERSONAS], "persona string")
    models = spark.createDataFrame([(m,) for m in PROMPT_MODELS], "model string")
    return build_prompts(_docs(spark, sf), "doc_id", "text", ["score"], personas, models)


@query
def prompt_kinds(spark, sf):
    from shiftkit.operators.prompts import PROMPT_KINDS, build_prompts

    p = build_prompts(_docs(spark, sf), "doc_id", "text", list(PROMPT_KINDS), PERSONAS, PROMPT_MODELS)
    return p.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("prompt")).cast("long").alias("chars"))


@query
def apply_answers(spark, sf):
    from shiftkit.operators.prompts import apply_answers as aa

    ans = read_table(spark, sf, "conversations").where(F.col("role") == "assistant").groupBy(F.col("conv_id").alias("doc_id")).agg(
        F.max_by("text", "turn").alias("answer"))
    return aa(_docs(spark, sf).select("doc_id", "text"), ans, "doc_id", "answer", "cleaned_text", fallback="text").select(
        "doc_id", "cleaned_text")


@query
def rewrite_rounds(spark, sf):
    """Three rounds of rewriting every document by a stand-in model, which answers with the prompt's text less its first
    character, and the distance of each round's text to the original."""
    from shiftkit.operators.prompts import rewrite_rounds as rounds
    from shiftkit.operators.vectors import distance_to_first_round

    def respond(prompts):
        return [p.split("\n\n", 1)[1][1:] for p in prompts]

    long = rounds(_docs(spark, sf).select("doc_id", "text"), "doc_id", "text", respond, 3, kind="clean")
    out = distance_to_first_round(long, "text_name", "round", "text")
    return out.select("text_name", "round", F.length("text").cast("long").alias("n_chars"),
                      F.when(F.abs("distance") < 5e-10, 0.0).otherwise(r9("distance")).alias("distance"))


def _decisions_with_text(spark, sf):
    from shiftkit.operators.answers import parse_decisions as pd_

    d = pd_(_decisions_long(spark, sf)).withColumn("doc_id", F.col("key").cast("long"))
    return d.join(_docs(spark, sf).select("doc_id", "text"), "doc_id")


@query
def decision_history(spark, sf):
    from shiftkit.operators.prompts import history_blocks
    from shiftkit.operators.sampling import positional_split as ps

    train = ps(read_table(spark, sf, "labels").select("doc_id"), ["doc_id"], 0.8).where(F.col("split") == "train")
    d = _decisions_with_text(spark, sf).join(train.select("doc_id"), "doc_id")
    return history_blocks(d, ["persona"], "doc_id", "text", "decision", max_items=1000)


@query
def few_shot_block(spark, sf):
    from shiftkit.operators.prompts import FEW_SHOT_ITEM, history_blocks
    from shiftkit.operators.sampling import stratified_ranks

    shots = stratified_ranks(_decisions_with_text(spark, sf), "doc_id", "persona", 8, seed=21)
    return history_blocks(shots, ["persona"], "doc_id", "text", "decision", max_items=8, item=FEW_SHOT_ITEM)


def _learnt(spark, sf, kind):
    """Prompts of one kind for every document and persona, with each block of the persona's six sampled decisions."""
    from shiftkit.operators.prompts import build_prompts, history_blocks
    from shiftkit.operators.sampling import stratified_ranks

    sample = stratified_ranks(_decisions_with_text(spark, sf), "doc_id", "persona", 6, seed=23)
    history = history_blocks(sample, ["persona"], "doc_id", "text", "decision", max_items=3)
    p = build_prompts(_docs(spark, sf), "doc_id", "text", [kind], ["quality", "toxic"], ["model"], history=history)
    return p.select("prompt_id", "text_name", "agent", "block", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("long").alias("n_chars"))


@query
def learn_prompts(spark, sf):
    return _learnt(spark, sf, "learn")


@query
def adjust_prompts(spark, sf):
    return _learnt(spark, sf, "adjust_tailored")


@query
def score_against_post(spark, sf):
    """Every document scored for a benchmark text as its post (item = doc_id modulo their number)."""
    from shiftkit.operators.prompts import build_prompts

    posts = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("_item"), F.col("text").alias("post"))
    n = posts.agg(F.count(F.lit(1))).scalar()
    docs = _docs(spark, sf).withColumn("_item", F.pmod(F.col("doc_id"), n)).join(posts, "_item", "left")
    return build_prompts(docs, "doc_id", "text", ["score_post"], ["recruiter"], ["model"], post="post").select("prompt_id", "text_name", "prompt")


@query
def label_prompts(spark, sf):
    """Token-label prompts: the tokens of every user turn, joined by a separator."""
    from shiftkit.operators.prompts import build_prompts
    from shiftkit.operators.text import whitespace_tokens

    name = F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    users = read_table(spark, sf, "conversations").where(F.col("role") == "user").select(
        name.alias("name"), F.array_join(whitespace_tokens("text"), " | ").alias("tokens"))
    return build_prompts(users, "name", "tokens", ["label"], ["annotator"], ["model"]).select("prompt_id", "text_name", "prompt")


# ---------------------------------------------------------------------------------------------
# learning (SQL checks the counts and what follows from them; the fits have no SQL form)


@query
def classifier_accuracy(spark, sf):
    from shiftkit.operators.learn import classifier_accuracy as ca
    from shiftkit.operators.sampling import hash_split

    d = hash_split(_docs(spark, sf).select("doc_id", "text", _is_us().alias("label")), "doc_id", 0.8, seed=7)
    out = ca(d, "text", "label", "split", ["logistic_regression", "random_forest", "neural_network"], vocab_size=5000)
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return out.select(
        "method", (F.col("tp") + F.col("fn")).alias("n_positive"), (F.col("tn") + F.col("fp")).alias("n_negative"),
        (F.abs(F.col("accuracy") - (F.col("tp") + F.col("tn")) / n) < 1e-9).alias("accuracy_of_counts"), "beats_majority")


@query
def variant_auroc(spark, sf):
    from shiftkit.operators.answers import pivot_updates as pv
    from shiftkit.operators.learn import variant_auroc as va
    from shiftkit.operators.sampling import hash_split

    upd = pv(_parsed_updates(spark, sf), ["key", "part"], UPDATE_TYPES).dropna(how="any").withColumnRenamed("key", "doc_id")
    prof = _docs(spark, sf).select("doc_id", F.col("text").alias("original"), _is_us().alias("label")).join(upd, "doc_id")
    d = hash_split(prof, "doc_id", 0.8, seed=7)
    out = va(d, ["original", *UPDATE_TYPES], "label", "split")
    # the two ways to the area agree, and there is one wherever there are both classes
    return out.select("variant", (F.col("tp") + F.col("fn")).alias("n_positive"), (F.col("tn") + F.col("fp")).alias("n_negative"),
                      F.col("auroc").isNotNull().alias("scored"), (F.abs(F.col("auroc_score") - F.col("auroc_area")) < 1e-9).alias("areas_agree"))


# ---------------------------------------------------------------------------------------------
# streaming


@query
def incremental_prompts(spark, sf):
    from shiftkit.streaming.incremental import incremental_prompt_run

    return incremental_prompt_run(spark, f"{sf}/conversations.parquet").select("prompt_id", "kind", "text_name", "prompt")


def _arrivals(spark, sf):
    """Answers with the time they come: all at first (a quarter of an hour in), then in three later hours the retries of a third of the
    missing ones each; the third at the hash's remainder 0 never gets one. Among them are NULL retries, repeated rows and older answers."""
    from shiftkit.functions.hashing import hash_u60

    first = _updates_long(spark, sf).where(F.col("variable").startswith("answer.") & ~F.col("variable").endswith("_comment")).select("part", "variable", "value")
    third = F.pmod(hash_u60("retry", "part", "variable"), F.lit(3))
    missing = first.where(F.col("value").isNull()).withColumn("third", third)

    def at(hours):
        return F.timestamp_seconds(F.lit(1_000_000_000 + int(3600 * hours)))

    retry = F.concat(F.lit("retry: "), F.col("variable"))
    rows = [
        first.select(F.lit(0).alias("batch"), "part", "variable", "value", at(0.25).alias("at")),
        missing.where("third = 1").select(F.lit(1), "part", "variable", retry, at(1)),
        missing.where("third = 2").select(F.lit(1), "part", "variable", F.lit(None).cast("string"), at(1)),
        missing.where("third = 2").select(F.lit(2), "part", "variable", retry, at(2)),
        missing.where("third = 1").select(F.lit(2), "part", "variable", retry, at(1)),
        missing.where("third = 1").select(F.lit(2), "part", "variable", F.lit("older"), at(0.9)),
        missing.where("third = 2").select(F.lit(3), "part", "variable", retry, at(3)),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


@query
def streamed_answers(spark, sf):
    """Answers and retries fed to the stream in four files, two before and two after a restart."""
    import uuid

    from shiftkit.session import checkpoint_dir, materialize
    from shiftkit.streaming.answers import current_answers, run_merge

    base = f"{checkpoint_dir(spark).rstrip('/')}/answers-{uuid.uuid4().hex}"
    rows = materialize(_arrivals(spark, sf))
    for batch in range(4):
        rows.where(F.col("batch") == batch).drop("batch").coalesce(1).write.parquet(f"{base}/in/{batch}")
        if batch % 2:
            run_merge(spark, f"{base}/in", f"{base}/out", f"{base}/progress", "part long, variable string, value string, at timestamp", ["part", "variable"])
    out = current_answers(spark, f"{base}/out", ["part", "variable"])
    return out.select("part", "variable", "value", "status")


@query
def retried_answers(spark, sf):
    """The open questions asked again until all are answered, by a stand-in model that answers half of the open ones a round, and the rest of a few at once."""
    from shiftkit.functions.hashing import hash_u60
    from shiftkit.operators.answers import retry_unanswered

    rows = _updates_long(spark, sf).where(F.col("variable").startswith("answer.") & ~F.col("variable").endswith("_comment"))
    name = F.concat_ws("/", "part", "variable")
    asked = rows.select(name.alias("variable"), "value")
    turn = [0]

    def respond(open_rows):
        turn[0] += 1
        half = F.pmod(hash_u60(turn[0], "variable"), F.lit(2)) == 0
        return open_rows.select("variable", F.when(half | F.lit(turn[0] > 5), F.concat(F.lit("again: "), F.col("variable"))).alias("value"))

    return retry_unanswered(asked, respond, allow_open=True)


# ---------------------------------------------------------------------------------------------
# small ones


@query
def first_documents(spark, sf):
    """The first ten documents in doc_id order (a head of a table)."""
    return _docs(spark, sf).select("doc_id", "lang", "n_chars").orderBy("doc_id").limit(10)


@query
def renamed_columns(spark, sf):
    """Chosen columns under the names that answers have."""
    return _docs(spark, sf).select(F.col("doc_id").alias("text_name"), F.col("lang").alias("answer_lang"), F.col("n_chars").alias("answer_size"))


@query
def answer_columns(spark, sf):
    """The columns whose name has a part, and the rest without another."""
    from shiftkit.operators.answers import columns_containing

    named = _docs(spark, sf).select("doc_id", F.col("lang").alias("answer.lang"), F.col("n_chars").alias("answer.n_chars"), F.col("source").alias("agent.source"))
    out = columns_containing(columns_containing(named, ".", keep=True), "agent", keep=False)
    return out.select(F.col("`answer.lang`").alias("lang"), F.col("`answer.n_chars`").alias("n_chars"))


@query
def shuffled_documents(spark, sf):
    """Documents in a reproducible random order, numbered."""
    from shiftkit.functions.hashing import hash_u60
    from shiftkit.operators.positional import dense_index

    docs = _docs(spark, sf).select("doc_id").withColumn("_h", hash_u60(29, "doc_id"))
    return dense_index(docs, ["_h", "doc_id"], out="position").select("doc_id", "position")


# ---------------------------------------------------------------------------------------------
# sources and sinks


@query
def text_folder_roundtrip(spark, sf):
    """Documents as one file for each (source, doc_id), in two folders, read back with the folder in the key."""
    import uuid

    from shiftkit.session import checkpoint_dir
    from shiftkit.sources.textfolder import read_text_folder, write_text_folder

    base = f"{checkpoint_dir(spark).rstrip('/')}/texts-{uuid.uuid4().hex}"
    docs = _docs(spark, sf).select(F.col("source").alias("model"), F.col("doc_id").cast("string").alias("name"), "text")
    turns = read_table(spark, sf, "conversations").groupBy("role", "conv_id").agg(F.max_by("text", "turn").alias("text"))
    last = turns.select(F.col("role").alias("model"), F.col("conv_id").cast("string").alias("name"), "text")
    write_text_folder(docs, f"{base}/documents")
    write_text_folder(last, f"{base}/turns")
    back = read_text_folder(spark, [f"{base}/documents", f"{base}/turns"])
    return back.select(F.element_at(F.split("dir", "/"), -1).alias("folder"), "model", "name", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@query
def csv_chunks_roundtrip(spark, sf):
    """Conversations written as CSV files, a folder for each role, and read back as one table with its column contract."""
    import uuid

    from shiftkit.operators.answers import columns_containing, require_columns
    from shiftkit.session import checkpoint_dir
    from shiftkit.sources.corpus import read_csv_table, write_table

    base = f"{checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    conv = read_table(spark, sf, "conversations").select("conv_id", "turn", "text", "role")
    write_table(conv, base, "csv", partition_by=["role"])
    back = read_csv_table(spark, base, "conv_id long, turn long, text string, role string", required=["conv_id", "turn", "text"])
    named = require_columns(back, ["conv_id", "role"], "chunks").withColumnRenamed("text", "answer.text").withColumnRenamed("role", "agent.role")
    answers = columns_containing(named, "agent", keep=False)
    return answers.select("conv_id", "turn", F.md5(F.col("`answer.text`")).alias("text_md5"))
