"""Prompt tables: template parameters and filling, the texts x personas x models grid, decision
histories, and writing answers back.

The model call is outside the engine: prompts leave as a table keyed by ``prompt_id`` and answers come
back as a table with the same key.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftkit.operators.positional import dense_index

PARAM_PATTERN = r"<([^>]*)>"

# Prompt wording per kind; ``<TEXT>``, ``<PERSONA>``, ``<POST>`` and ``<HISTORY>`` are filled per row.
PROMPT_KINDS = {
    "clean": "Rewrite the text below as clean plain text. Keep every fact.\n\n<TEXT>",
    "summarize": "You are <PERSONA>. Summarize the text below in a few sentences.\n\n<TEXT>",
    "improve": "You are <PERSONA>. Improve the text below for the post that follows.\n\n<TEXT>\n\nPost: <POST>",
    "redact": "Remove names, places and other identifying details from the text below.\n\n<TEXT>",
    "score": "You are <PERSONA>. Rate the text below from 0 to 10.\n\n<TEXT>",
    "decide": "You are <PERSONA>. Would you accept the text below? Answer Yes or No.\n\n<TEXT>",
    "decide3": "You are <PERSONA>. Would you accept the text below? Answer Yes, No or Unable to determine.\n\n<TEXT>",
    "adjust": "You are <PERSONA>. Adjust the text below so it would be accepted.\n\n<TEXT>",
    "generate": "You are <PERSONA>. Write a new text like the one below.\n\n<TEXT>",
    "label": "You are <PERSONA>. Give one label number per token of: <TEXT>",
    "score_post": "You are <PERSONA>. Rate the text below from 0 to 10 for the post that follows.\n\n<TEXT>\n\nPost: <POST>",
    "learn": "You are <PERSONA>. Your earlier decisions:\n\n<HISTORY>\nWould you accept the text below? Answer Yes or No.\n\n<TEXT>",
    "adjust_tailored": "You are <PERSONA>. Your earlier decisions:\n\n<HISTORY>\nAdjust the text below so you would accept it.\n\n<TEXT>",
}


def template_params(df: DataFrame, col: str, keys: Sequence[str]) -> DataFrame:
    """Parameters marked ``<...>`` in order (repeats kept, inner spaces kept): (keys, pos, param)."""
    return df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(col), F.lit(PARAM_PATTERN), 1)).alias("pos", "param"))


def fill_expr(template: Column, values: Column) -> Column:
    """Fill ``<param>`` marks of ``template`` from a ``map<string,string>``; unknown marks stay.

    Literal pieces and parameters alternate, so the result is built with one ``aggregate`` over the
    parameter positions (JVM-side, no explode and no sort).
    """
    lits = F.split(template, r"<[^>]*>", -1)
    params = F.regexp_extract_all(template, F.lit(PARAM_PATTERN), 1)

    def step(acc, i):
        p = F.element_at(params, i)
        val = F.coalesce(F.element_at(values, p), F.concat(F.lit("<"), p, F.lit(">")))
        return F.concat(acc, val, F.element_at(lits, i + 1))

    filled = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(params), F.lit(1))), F.element_at(lits, 1), step)
    return F.when(F.size(params) == 0, template).otherwise(filled)


def split_template(template: str) -> list[tuple[str, str]]:
    """A template as ordered pieces: ("lit", text) and ("param", name)."""
    import re

    out = []
    for i, part in enumerate(re.split(PARAM_PATTERN, template)):
        if i % 2 == 0:
            if part:
                out.append(("lit", part))
        else:
            out.append(("param", part))
    return out


def compiled_fill(template: str, value_of) -> Column:
    """``template`` filled by ``value_of(param) -> Column or None`` as one ``concat`` built on the
    driver from the (small, fixed) template: no per-row regex. Unknown marks stay as written."""
    parts = []
    for kind, x in split_template(template):
        if kind == "lit":
            parts.append(F.lit(x))
        else:
            v = value_of(x)
            mark = F.lit(f"<{x}>")
            parts.append(mark if v is None else F.coalesce(v, mark))
    return F.concat(*parts) if parts else F.lit("")


def template_fill(templates: DataFrame, rows: DataFrame, row_key: Sequence[str], template_key: str = "template_id",
                  template_col: str = "template") -> DataFrame:
    """Fill templates for every row from its other columns, whose names are the parameters.

    A row that names its template in ``template_key`` is joined with it; else every row gets every
    template. Templates are configuration and broadcast if they are counted to be few, so texts are not
    shuffled. A NULL or unknown parameter keeps its mark.
    """
    row_key = list(row_key)
    params = [c for c in rows.columns if c not in (*row_key, template_key)]
    values = F.map_from_arrays(F.array(*[F.lit(c) for c in params]), F.array(*[F.col(f"`{c}`").cast("string") for c in params]))
    slim = rows.withColumn("_vals", values)
    if template_key in rows.columns:
        both = slim.select(*row_key, template_key, "_vals").join(templates.select(template_key, template_col), template_key)
    else:
        both = with_each(slim.select(*row_key, "_vals"), templates.select(template_key, template_col), template_key)
    return both.select(*row_key, template_key, fill_expr(F.col(template_col), F.col("_vals")).alias("filled"))


def values_wide(values: DataFrame, row_key: Sequence[str], params: Sequence[str]) -> DataFrame:
    """Long values (row_key, param, value) as one row a key; of a repeated (row, param) the largest value counts."""
    picks = [F.max(F.when(F.col("param") == p, F.col("value"))).alias(p) for p in params]
    return values.groupBy(*row_key).agg(*picks)


def prompt_id(kind, name, agent, model) -> Column:
    def c(x):
        return F.col(x) if isinstance(x, str) else x
    return F.sha2(F.concat_ws("|", c(kind), c(name).cast("string"), c(agent), c(model)), 256)


#: A configuration table of at most this many rows is broadcast; a larger one is joined by a shuffle.
CONFIG_ROWS = 10_000


def config_join(rows: DataFrame, config: DataFrame, on) -> DataFrame:
    """Join with a configuration table, broadcast if it is counted to be small."""
    return rows.join(F.broadcast(config) if config.limit(CONFIG_ROWS + 1).count() <= CONFIG_ROWS else config, on)


def with_each(rows: DataFrame, config: DataFrame, order: str) -> DataFrame:
    """Every row with every row of a configuration table: rows are repeated by number, and the numbers joined."""
    numbered = dense_index(config, [order], out="_no")
    n = config.count()
    if not n:
        return config_join(rows.limit(0).withColumn("_no", F.lit(0).cast("long")), numbered, "_no").drop("_no")
    return config_join(rows.withColumn("_no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))), numbered, "_no").drop("_no")


def prompts_from_tables(texts: DataFrame, name: str, text: str, kinds, personas, models, post: str | None = None,
                        history: DataFrame | None = None) -> DataFrame:
    """:func:`build_prompts` from configuration tables: ``kinds`` (kind, template), ``personas`` (persona) and ``models`` (model).

    Values are distinct rows; a NULL one is left out. A list instead of a table is made one.
    """
    spark = texts.sparkSession

    def table(values, schema: str, cols: list[str]) -> DataFrame:
        df = values if isinstance(values, DataFrame) else spark.createDataFrame(values, schema)
        return df.select(*cols).dropna().distinct()

    if not isinstance(kinds, DataFrame):
        kinds = [(k, PROMPT_KINDS[k]) for k in kinds]
    rows = texts.where(F.col(text).isNotNull()).select(
        F.col(name).cast("string").alias("text_name"), F.col(text).alias("_text"), (F.coalesce(F.col(post), F.lit("")) if post else F.lit("")).alias("_post"))
    for values, schema, cols in ((kinds, "kind string, template string", ["kind", "template"]), (personas, "persona string", ["persona"]), (models, "model string", ["model"])):
        values = values if isinstance(values, DataFrame) or schema[:4] == "kind" else [(v,) for v in values]
        rows = with_each(rows, table(values, schema, cols), cols[0])
    marks, more = {"TEXT": F.col("_text"), "PERSONA": F.col("persona"), "POST": F.col("_post")}, []
    if history is not None:
        known = history.select(F.col("persona").alias("_of"), "block", F.col("history").alias("_history"))
        rows = config_join(rows, known, F.col("persona") == F.col("_of"))
        marks["HISTORY"], more = F.col("_history"), ["block"]
    values = F.create_map(*[x for k, v in marks.items() for x in (F.lit(k), v)])
    return rows.select(
        prompt_id("kind", "text_name", "persona", "model").alias("prompt_id"), "kind", "text_name", F.col("persona").alias("agent"), "model",
        *more, fill_expr(F.col("template"), values).alias("prompt"))


def build_prompts(texts: DataFrame, name: str, text: str, kinds: Sequence[str] | DataFrame, personas: Sequence[str] | DataFrame,
                  models: Sequence[str] | DataFrame, post: str | None = None, templates: dict | None = None,
                  history: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Texts x kinds x personas x models prompt rows.

    Configuration lists are small parameters, so their product is an explode of a literal array on
    each text row: no join, no shuffle, and work grows linearly with the texts. Any of them may be a table
    instead (:func:`prompts_from_tables`), which gives the same prompts. ``history`` (persona,
    block, history; see ``history_blocks``) puts each persona's earlier decisions into its prompts, one
    prompt for each block; it is broadcast if it is counted to be small.
    A NULL text has no prompt (``unprompted`` lists such rows). With lists, ``keep`` names columns of the texts that their prompts carry.
    """
    if any(isinstance(x, DataFrame) for x in (kinds, personas, models)):
        if keep:
            raise ValueError("prompts from tables carry no other columns")
        if templates and not isinstance(kinds, DataFrame):
            kinds = texts.sparkSession.createDataFrame([(k, templates[k]) for k in kinds], "kind string, template string")
        return prompts_from_tables(texts, name, text, kinds, personas, models, post, history)
    templates = templates or PROMPT_KINDS
    grid = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(p).alias("agent"), F.lit(m).alias("model"))
        for k in kinds for p in personas for m in models
    ])
    rows = texts.where(F.col(text).isNotNull()).select(
        F.col(name).cast("string").alias("text_name"), F.col(text).alias("_text"),
        (F.coalesce(F.col(post), F.lit("")) if post else F.lit("")).alias("_post"), *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)],
        F.explode(grid).alias("_g"))
    values = {"TEXT": F.col("_text"), "PERSONA": F.col("_g.agent"), "POST": F.col("_post")}
    more = []
    if history is not None:
        known = history.select(F.col("persona").alias("_of"), "block", F.col("history").alias("_history"))
        rows = config_join(rows, known, F.col("_g.agent") == F.col("_of"))
        values["HISTORY"], more = F.col("_history"), ["block"]
    prompt = None
    for k in kinds:
        e = compiled_fill(templates[k], values.get)
        prompt = F.when(F.col("_g.kind") == k, e) if prompt is None else prompt.when(F.col("_g.kind") == k, e)
    return rows.select(
        prompt_id(F.col("_g.kind"), "text_name", F.col("_g.agent"), F.col("_g.model")).alias("prompt_id"),
        F.col("_g.kind").alias("kind"), "text_name", F.col("_g.agent").alias("agent"), F.col("_g.model").alias("model"),
        *more, prompt.alias("prompt"), *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)],
    )


def unprompted(texts: DataFrame, name: str, text: str) -> DataFrame:
    """The names of the rows that ``build_prompts`` leaves out for want of a text."""
    return texts.where(F.col(text).isNull()).select(F.col(name).cast("string").alias("text_name"))


def apply_answers(texts: DataFrame, answers: DataFrame, name: str, answer: str, out: str,
                  fallback: str | None = None) -> DataFrame:
    """Write answers back by name (left join); rows without an answer keep ``fallback`` (or NULL)."""
    a = answers.select(F.col(name), F.col(answer).alias("_ans"))
    j = texts.join(a, name, "left")
    val = F.coalesce("_ans", F.col(fallback)) if fallback else F.col("_ans")
    return j.withColumn(out, val).drop("_ans")


# How the reference writes one decided example into a prompt.
HISTORY_ITEM = ("\nDecision: ", "\n------\n")       # learned-decision history per persona
FEW_SHOT_ITEM = (", Hired: ", "\n\n ----- \n\n")    # few-shot block over a training set


def history_blocks(df: DataFrame, group: Sequence[str], order: str, text: str, decision: str,
                   max_items: int, item: tuple[str, str] = HISTORY_ITEM) -> DataFrame:
    """Concatenate ``<text><label><decision><end>`` per group in ``order``, in blocks of ``max_items``.

    The block size is part of the prompt's design: a group always yields blocks 0, 1, ... of so many
    items, so no string or task holds an unbounded group. Rows without a text or decision
    are no examples; they are left out and counted in no block (``n_items`` is what a block holds).
    """
    group = list(group)
    label, end = item
    examples = df.where(F.col(text).isNotNull() & F.col(decision).isNotNull())
    idx = dense_index(examples, [order], by=group, out="_i")
    piece = F.concat(F.col(text), F.lit(label), F.col(decision).cast("string"), F.lit(end))
    blocks = idx.withColumn("block", F.floor(F.col("_i") / max_items).cast("long"))
    g = blocks.groupBy(*group, "block").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_i"), piece.alias("_s")))).alias("_items"),
        F.count(F.lit(1)).alias("n_items"),
    )
    return g.select(*group, "block", "n_items", F.array_join(F.transform("_items", lambda s: s["_s"]), "").alias("history"))


def run_responder(prompts: DataFrame, respond, key: str = "prompt_id", prompt: str = "prompt",
                  batch_size: int = 100, keep: Sequence[str] = ()) -> DataFrame:
    """Answers for a prompt table from ``respond(list[str]) -> list[str | None]``, called on batches
    of ``batch_size`` prompts inside tasks (``mapInPandas``); the result is (key, answer), and the columns named in ``keep``."""
    from shiftkit.session import ship_package

    ship_package(prompts.sparkSession)
    kept = [key, *keep]
    types = {c: prompts.schema[c].dataType.simpleString() for c in kept}

    def run(it):
        import pandas as pd

        for pdf in it:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size]
                yield pd.DataFrame({key: part[key].values, "answer": list(respond(part[prompt].tolist())), **{c: part[c].values for c in keep}})

    schema = ", ".join([f"{key} {types[key]}", "answer string", *[f"{c} {types[c]}" for c in keep]])
    return prompts.select(key, prompt, *keep).mapInPandas(run, schema)


def rewrite_rounds(texts: DataFrame, name: str, text: str, respond, rounds: int, kind: str = "improve",
                   persona: str = "editor", model: str = "model") -> DataFrame:
    """Rewriting in rounds: the answers of round i are the texts of round i+1.

    Each round is materialised (checkpointed in the shared folder) before the next one reads it, so
    the plan never nests the previous rounds. Output is long: (text_name, round, text), round 0 being
    the input; a text whose answer is missing keeps its previous version, as does one without a name. A prompt carries its text's name and
    previous version through the responder, so a round is one pass without a shuffle, and rows that repeat are rewritten each.
    """
    from shiftkit.session import materialize

    cur = texts.select(F.col(name).cast("string").alias("text_name"), F.col(text).alias("text"))
    out = cur.withColumn("round", F.lit(0))
    asked = F.col("text_name").isNotNull() & F.col("text").isNotNull()
    for r in range(1, rounds + 1):
        p = build_prompts(cur.where(asked), "text_name", "text", [kind], [persona], [model], keep=["text"])
        ans = run_responder(p, respond, keep=["text_name", "text"])
        cur = materialize(ans.select("text_name", F.coalesce("answer", "text").alias("text")).union(cur.where(~asked)))
        out = out.unionByName(cur.withColumn("round", F.lit(r)))
    return out
