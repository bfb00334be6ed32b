"""Answer reshaping: wide survey answers to long rows, score/comment pairing, decision and update
parsing, pivots, model-name handling, label lists, and answer patching.

Answers arrive one column per question; here they are a long table ``(agent, model, variable,
value)`` so width never grows with the corpus.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The model long name -> short name map used by the reference's experiments.
MODEL_SHORT_NAMES = {
    "gpt-3.5-turbo": "gpt35",
    "gpt-4-1106-preview": "gpt4",
    "gemini_pro": "gemini",
    "llama-2-13b-chat-hf": "llama13b",
    "llama-2-70b-chat-hf": "llama70b",
    "mixtral-8x7B-instruct-v0.1": "mixtral",
}


def require_columns(df: DataFrame, cols: Sequence[str], what: str = "input") -> DataFrame:
    """Column-presence contract: fail before any plan runs if a needed column is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks column(s) {missing}; has {df.columns}")
    return df


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None,
         var: str = "variable", val: str = "value") -> DataFrame:
    """Wide to long (``pandas.melt``); values are cast to string so mixed answer columns stack."""
    ids = list(ids)
    values = [c for c in (values or df.columns) if c not in ids]
    cast = df.select(*[F.col(f"`{c}`") for c in ids], *[F.col(f"`{c}`").cast("string").alias(c) for c in values])
    return cast.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in values], var, val)


def survey_long(df: DataFrame, ids: Sequence[str], var: str = "variable", val: str = "value") -> DataFrame:
    """Melt answers; ``question`` is the part of the column name after the first dot."""
    long = melt(df, ids, None, var, val)
    return long.withColumn("question", F.split(F.col(var), r"\.").getItem(1))


def score_comment_pairs(long: DataFrame, keys: Sequence[str] = ("agent", "model"),
                        var: str = "variable", val: str = "value") -> DataFrame:
    """Pair each score answer with its comment: ``answer.<name>`` with ``answer.<name>_<x>comment``.

    Equal to the reference's melt + split + inner merge on (keys, name), done as one grouping: a
    name is kept only when both a score row and a comment row exist.
    """
    keys = list(keys)
    v = F.col(var)
    is_c = v.contains("comment")
    # Python slices of the name: x[7:] for scores, x[7 : x.rfind('_')] for comments
    last = F.instr(F.reverse(v), "_")
    end = F.when(last == 0, F.length(v) - 1).otherwise(F.length(v) - last)
    name = F.when(is_c, F.substring(v, 8, F.greatest(end - 7, F.lit(0)))).otherwise(F.substring(v, 8, 1 << 30))
    base = long.where(v.contains("answer")).select(*keys, name.alias("resume"), is_c.alias("_c"), F.col(val).alias("_v"))
    g = base.groupBy(*keys, "resume").agg(
        F.max(F.when(~F.col("_c"), F.col("_v"))).alias("score"),
        F.max(F.when(F.col("_c"), F.col("_v"))).alias("comment"),
        F.count_if(~F.col("_c")).alias("_ns"),
        F.count_if(F.col("_c")).alias("_nc"),
    )
    return g.where((F.col("_ns") > 0) & (F.col("_nc") > 0)).drop("_ns", "_nc")


def parse_answers(long: DataFrame, pattern: str = r"_(.*)", key: str = "key", keep: Sequence[str] = (),
                  var: str = "variable", val: str = "value", keep_comments: bool = True) -> DataFrame:
    """Keep ``answer.q_*`` rows; ``key`` = group 1 of ``pattern`` searched in the name ('' if none)."""
    v = F.col(var)
    rows = long.where(v.contains("answer.q_"))
    if not keep_comments:
        rows = rows.where(~v.endswith("_comment"))
    return rows.select(*keep, F.regexp_extract(v, pattern, 1).alias(key), F.col(val).alias("value"))


def parse_decisions(long: DataFrame, agent: str = "agent", key: str = "key", yes: str = "Yes",
                    keep_comments: bool = False, var: str = "variable", val: str = "value") -> DataFrame:
    """Decision rows (persona, key, decision 0/1). Comment rows are dropped unless ``keep_comments``
    (the reference keeps them, with key ``<k>_comment`` and decision 0)."""
    parsed = parse_answers(long, r"_(.*)", key, [agent], var, val, keep_comments)
    return parsed.select(
        F.col(agent).alias("persona"), key, F.when(F.col("value") == yes, 1).otherwise(0).alias("decision")
    )


def parse_updates(long: DataFrame, var: str = "variable", val: str = "value", key: str = "key") -> DataFrame:
    """``answer.<type>_<...>_<key>``: type between the first '.' and the first '_', key = last part."""
    v = F.col(var)
    rows = long.where(v.contains("answer") & ~v.contains("_comment"))
    # the text from after the first '.' up to the first '_', with Python slice rules: a missing '.'
    # starts at 0, a missing '_' ends one before the last character, and an end before the start
    # gives ''
    start = F.instr(v, ".")
    under = F.instr(v, "_")
    end = F.when(under == 0, F.length(v) - 1).otherwise(under - 1)
    kind = F.substring(v, start + 1, F.greatest(end - start, F.lit(0)))
    return rows.withColumn("update_type", kind).withColumn(key, F.element_at(F.split(v, "_"), -1).try_cast("long"))


def pivot_updates(parsed: DataFrame, key: str | Sequence[str], types: Sequence[str], kind: str = "update_type",
                  val: str = "value", check_unique: bool = True) -> DataFrame:
    """One row per key (one or several columns), one column per update type (the known list avoids a discovery pass).

    A type outside the list fails the query, and with ``check_unique`` so does a (key, type) that
    repeats, as ``pandas.pivot`` would.
    """
    from shiftkit.operators.scores import pivot_listed

    one, keys = F.max(val), [key] if isinstance(key, str) else list(key)
    if check_unique:
        name = F.concat_ws(" ", F.lit(f"duplicate {', '.join(keys)}, {kind}:"), *[F.first(F.col(k).cast("string")) for k in keys], F.first(kind))
        one = F.when(F.count(F.lit(1)) > 1, F.raise_error(name).cast("string")).otherwise(one)
    return pivot_listed(parsed, keys, kind, types, one)


def split_model_prefix(df: DataFrame, name: str, models: Sequence[str], model_out: str = "update_model",
                       name_out: str = "resume", default: str = "no_update") -> DataFrame:
    """``<model>_<rest>`` with a known model -> (model, rest); otherwise (default, name)."""
    first = F.substring_index(F.col(name), "_", 1)
    known = first.isin(list(models))
    # text after the first '_' (the whole name when there is none, as a failed find gives)
    rest = F.expr(f"substring(`{name}`, instr(`{name}`, '_') + 1)")
    return df.withColumn(model_out, F.when(known, first).otherwise(F.lit(default))).withColumn(
        name_out, F.when(known, rest).otherwise(F.col(name))
    )


def short_model_name(df: DataFrame, col: str, mapping: dict | None = None, out: str = "model_short") -> DataFrame:
    """Map long model names to short ones; an unknown name is an error, as a dict lookup is."""
    mapping = MODEL_SHORT_NAMES if mapping is None else mapping
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    hit = F.element_at(m, F.col(col))
    return df.withColumn(
        out, F.when(hit.isNull() & F.col(col).isNotNull(), F.raise_error(F.concat(F.lit("unknown model: "), F.col(col))))
        .otherwise(hit).cast("string")
    )


def parse_label_list(df: DataFrame, col: str, out: str = "labels", mode: str = "digit") -> DataFrame:
    """Labels from free text: every digit character is one label (``mode='digit'``, the reference's
    reading, so ``10`` gives 1, 0) or every digit run (``mode='number'``). A number beyond 64 bits is NULL."""
    pattern = r"\d" if mode == "digit" else r"\d+"
    found = F.regexp_extract_all(F.col(col), F.lit(pattern), 0)
    return df.withColumn(out, F.transform(found, lambda x: x.try_cast("long")))


def null_tokens(df: DataFrame, cols: Sequence[str], tokens: Sequence[str] = ("nan",)) -> DataFrame:
    """Read literal null markers (the reference writes missing answers as ``nan``) as NULL."""
    for c in cols:
        df = df.withColumn(c, F.when(F.col(c).isin(list(tokens)), F.lit(None)).otherwise(F.col(c)))
    return df


def patch_answers(answers: DataFrame, patch: DataFrame, on: Sequence[str] = ("variable",),
                  val: str = "value") -> DataFrame:
    """Left join a patch run; take the patch value where it is not null."""
    p = patch.select(*on, F.col(val).alias("_patch"))
    return answers.join(p, list(on), "left").withColumn(val, F.coalesce("_patch", val)).drop("_patch")


def unanswered(answers: DataFrame, val: str = "value") -> DataFrame:
    """Rows still to ask again: NULL or empty answers."""
    return answers.where(F.col(val).isNull() | (F.col(val) == ""))


def retry_unanswered(answers: DataFrame, respond, key: str = "variable", val: str = "value",
                     allow_open: bool = False) -> DataFrame:
    """Ask the unanswered questions again, round after round, until all are answered.

    ``respond(df) -> DataFrame(key, value)`` answers the rows it is given (for example
    ``prompts.run_responder`` over their prompts). A round that answers nothing new ends the loop; rows
    still open then are an error, or stay NULL with ``allow_open``. Every round's table is checkpointed in the
    shared folder; the number of open rows is the only value brought to the driver.
    """
    from shiftkit.session import materialize

    cur = materialize(answers)
    open_rows = unanswered(cur, val).count()
    while open_rows:
        patch = respond(unanswered(cur, val)).select(key, F.col(val))
        cur = materialize(patch_answers(cur, patch, [key], val))
        left = unanswered(cur, val).count()
        if left >= open_rows:
            if allow_open:
                break
            raise ValueError(f"{left} questions stay unanswered: a round brought no new answer")
        open_rows = left
    return cur


def columns_containing(df: DataFrame, part: str, keep: bool = True) -> DataFrame:
    """Keep (or drop) the columns whose name contains ``part``."""
    cols = [c for c in df.columns if part in c]
    return df.select(*[F.col(f"`{c}`") for c in cols]) if keep else df.drop(*cols)
