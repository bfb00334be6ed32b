"""DuckDB SQL equal to each registered query, on the same parquet tables.

Floats are rounded to 9 digits as in the Spark plans. ``embedding[i]`` is 1-based here.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# Pools: one row per vector, double precision.
_POOLS = "SELECT vec_id, label AS pool, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"

# Centroid per pool as an ordered list of per-dimension means.
_CENTROIDS = f"""
  SELECT pool, list(m ORDER BY i) AS c FROM (
    SELECT pool, i, avg(x) AS m FROM (
      SELECT pool, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM ({_POOLS})
    ) GROUP BY pool, i
  ) GROUP BY pool
"""

ORACLE["pool_separation"] = f"""
WITH p AS ({_POOLS}), c AS ({_CENTROIDS})
SELECT p.pool, round(quantile_cont(1 - list_cosine_similarity(p.e, c.c), 0.5), 9) AS separation,
  count(*) FILTER (WHERE list_sum(list_transform(p.e, lambda x: x * x)) = 0) AS n_undefined
FROM p JOIN c USING (pool) GROUP BY p.pool
"""

from itertools import combinations as _comb  # noqa: E402

from shiftkit.functions.hashing import sql_hash_u60 as _h, sql_poisson1_weight as _poisson  # noqa: E402
from shiftkit.functions.stopwords import ENGLISH_STOP_WORDS as _SW  # noqa: E402

_IS_US = "CASE WHEN lang = 'en' THEN 1 ELSE 0 END"
_MID = "(SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 FROM events)"
_EVENTS_PHASE = f"SELECT *, CASE WHEN epoch_us(ts) <= {_MID} THEN 'original' ELSE 'updated' END AS phase FROM events"
_ANSWERS_LONG = """
SELECT 'persona' AS agent, 'model' AS model,
  CASE WHEN role = 'user' THEN 'answer.q_' || conv_id || '_' || turn
       WHEN role = 'assistant' THEN 'answer.q_' || conv_id || '_' || (turn - 1) || '_comment'
       ELSE 'agent.' || role || '_' || conv_id || '_' || turn END AS variable,
  text AS value
FROM conversations
"""
_UPDATES_LONG = """
SELECT 'persona' AS agent, part, variable, value FROM (
  WITH k AS (SELECT *, CASE WHEN role = 'assistant' THEN (turn - 1) // 2 ELSE turn // 2 END AS k FROM conversations),
  r AS (SELECT role, conv_id AS key, CAST(k // 3 AS BIGINT) AS part, (['clean','redact','improve'])[k % 3 + 1] AS kind, text, conv_id, turn FROM k),
  q AS (SELECT DISTINCT key, part FROM r WHERE role = 'user'),
  a AS (SELECT q.key, q.part, t.kind FROM q CROSS JOIN (VALUES ('clean'), ('redact'), ('improve')) t(kind))
  SELECT 'answer.' || a.kind || '_' || a.key AS variable, a.part, r.text AS value
  FROM a LEFT JOIN r ON r.role = 'user' AND r.key = a.key AND r.part = a.part AND r.kind = a.kind
  UNION ALL
  SELECT CASE WHEN role = 'assistant' THEN 'answer.' || kind || '_' || key || '_comment'
              ELSE 'agent.' || role || '_' || conv_id || '_' || turn END, part, text
  FROM r WHERE role <> 'user' OR role IS NULL)
"""
_PARSED_UPDATES = f"""
SELECT *, substr(variable, instr(variable, '.') + 1,
    greatest(CASE WHEN instr(variable, '_') = 0 THEN length(variable) - 1 ELSE instr(variable, '_') - 1 END
             - instr(variable, '.'), 0)) AS update_type,
  TRY_CAST(string_split(variable, '_')[-1] AS BIGINT) AS key
FROM ({_UPDATES_LONG}) WHERE variable LIKE '%answer%' AND variable NOT LIKE '%\\_comment%' ESCAPE '\\'
"""
_PIVOT_UPDATES = f"""
SELECT key, part, max(value) FILTER (WHERE update_type = 'clean') AS clean,
  max(value) FILTER (WHERE update_type = 'redact') AS redact,
  max(value) FILTER (WHERE update_type = 'improve') AS improve
FROM ({_PARSED_UPDATES}) GROUP BY key, part
"""
_DECISIONS_LONG = """
SELECT 'quality' AS agent, 'answer.q_' || doc_id AS variable, CASE WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS value FROM labels
UNION ALL
SELECT 'toxic', 'answer.q_' || doc_id, CASE WHEN toxic = 1 THEN 'Yes' ELSE 'No' END FROM labels
"""
_MODELS = ["click", "error", "purchase", "signup", "view"]
_PAIRS = list(_comb(_MODELS, 2))
_GRID = f"""
SELECT event_id, event_type AS drafting_model,
  CASE WHEN phase = 'updated' THEN 'rewrite' END AS improving_model,
  'judge_' || (user_id % 3) AS scoring_model, value AS score
FROM ({_EVENTS_PHASE})
"""
_THREE = f"""
SELECT l.doc_id, l.quality AS decision, l.toxic AS decision_generic, {_IS_US} AS decision_tailored
FROM labels l JOIN documents d USING (doc_id)
"""
_WIDE = "SELECT user_id, " + ", ".join(
    f"avg(value) FILTER (WHERE event_type = '{m}') AS \"{m}\"" for m in _MODELS) + " FROM events GROUP BY user_id"
_COMPLETE = " AND ".join(f'"{m}" IS NOT NULL' for m in _MODELS)
_GAPS = " UNION ALL ".join(
    f"SELECT user_id, '{a}' AS model_a, '{b}' AS model_b, \"{a}\" - \"{b}\" AS gap FROM ({_WIDE}) WHERE {_COMPLETE}" for a, b in _PAIRS)
_BEFORE_AFTER = f"""
WITH m AS (SELECT user_id, event_type, phase, avg(value) AS s FROM ({_EVENTS_PHASE}) GROUP BY ALL)
SELECT o.user_id, o.event_type, o.s AS score_original, u.s AS score_updated
FROM (SELECT * FROM m WHERE phase = 'original') o
LEFT JOIN (SELECT * FROM m WHERE phase = 'updated') u USING (user_id, event_type)
"""
_DELTA_WIDE = "SELECT user_id, " + ", ".join(
    f"first(score_updated - score_original) FILTER (WHERE event_type = '{m}') AS \"{m}\"" for m in _MODELS
) + f" FROM ({_BEFORE_AFTER}) GROUP BY user_id"
_DID = " UNION ALL ".join(
    f"SELECT user_id, '{a}' AS model_a, '{b}' AS model_b, \"{a}\" - \"{b}\" AS did FROM ({_DELTA_WIDE})" for a, b in _PAIRS)

ORACLE.update({
    "corpus_union": """
SELECT 'documents' AS dir, CAST(doc_id AS VARCHAR) AS text_name, text FROM documents
UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), html FROM pages""",
    "category_file_ids": """
SELECT doc_id, source, lower(replace(source, ' ', '')) || '_' ||
  CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS VARCHAR) AS file_id FROM documents""",
    "drop_null_text": """
SELECT d.doc_id, c.text AS answer FROM documents d
LEFT JOIN conversations c ON c.conv_id = d.doc_id AND c.role = 'user'
WHERE c.text IS NOT NULL""",
    "filter_active": "SELECT doc_id, source, n_chars FROM documents WHERE n_chars > 1000",
    "keyword_filter": "SELECT doc_id, lang FROM documents WHERE regexp_matches(lower(text), '(nicht|vous|tion)')",
    "binary_label": f"SELECT doc_id, {_IS_US} AS is_us FROM documents",
    "complete_cases": """
SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE d.doc_id IS NOT NULL AND d.source IS NOT NULL AND l.quality IS NOT NULL AND l.toxic IS NOT NULL""",
    "trim_scores": f"""
SELECT event_id, coalesce(improving_model, 'none') AS improving_model, CAST(trunc(score) AS INTEGER) AS score
FROM ({_GRID}) WHERE score IS NOT NULL""",
    "correct_flag": f"""
SELECT l.doc_id, l.quality, {_IS_US} AS pred, CAST(l.quality = {_IS_US} AS INTEGER) AS correct
FROM labels l JOIN documents d USING (doc_id)""",
    "median_threshold_label": """
SELECT doc_id, n_chars, CASE WHEN n_chars > (SELECT quantile_cont(n_chars, 0.5) FROM documents) THEN 1 ELSE 0 END AS pred
FROM documents""",
    "survey_long": """
SELECT doc_id AS agent, 'answer.quality' AS variable, CAST(quality AS VARCHAR) AS value, 'quality' AS question FROM labels
UNION ALL SELECT doc_id, 'answer.toxic', CAST(toxic AS VARCHAR), 'toxic' FROM labels""",
    "score_comment_pairs": f"""
WITH b AS (
  SELECT agent, model,
    CASE WHEN variable LIKE '%comment%'
      THEN substr(variable, 8, greatest(CASE WHEN instr(reverse(variable), '_') = 0 THEN length(variable) - 1
                                        ELSE length(variable) - instr(reverse(variable), '_') END - 7, 0))
      ELSE substr(variable, 8) END AS resume,
    variable LIKE '%comment%' AS c, value
  FROM ({_ANSWERS_LONG}) WHERE variable LIKE '%answer%')
SELECT agent, model, resume, max(value) FILTER (WHERE NOT c) AS score, max(value) FILTER (WHERE c) AS comment
FROM b GROUP BY agent, model, resume
HAVING count(*) FILTER (WHERE NOT c) > 0 AND count(*) FILTER (WHERE c) > 0""",
    "parse_decisions": f"""
SELECT agent AS persona, regexp_extract(variable, '_(.*)', 1) AS key, CASE WHEN value = 'Yes' THEN 1 ELSE 0 END AS decision
FROM ({_DECISIONS_LONG}) WHERE variable LIKE '%answer.q\\_%' ESCAPE '\\' AND NOT suffix(variable, '_comment')""",
    "parse_answers": f"""
SELECT regexp_extract(variable, 'q_(\\d+)_', 1) AS key, value
FROM ({_ANSWERS_LONG}) WHERE variable LIKE '%answer.q\\_%' ESCAPE '\\'""",
    "parse_updates": f"SELECT part, variable, update_type, key, value FROM ({_PARSED_UPDATES})",
    "pivot_updates": _PIVOT_UPDATES,
    "profiles_with_updates": f"""
SELECT d.doc_id, p.part, d.text AS original, p.clean, p.redact, p.improve
FROM documents d JOIN ({_PIVOT_UPDATES}) p ON p.key = d.doc_id
WHERE p.key IS NOT NULL AND p.clean IS NOT NULL AND p.redact IS NOT NULL AND p.improve IS NOT NULL""",
    "split_model_prefix": """
WITH n AS (SELECT conv_id, turn, role || '_' || conv_id || '_' || turn AS name FROM conversations)
SELECT conv_id, turn,
  CASE WHEN split_part(name, '_', 1) IN ('assistant', 'system') THEN split_part(name, '_', 1) ELSE 'no_update' END AS update_model,
  CASE WHEN split_part(name, '_', 1) IN ('assistant', 'system') THEN substr(name, instr(name, '_') + 1) ELSE name END AS resume
FROM n""",
    "short_model_name": """
SELECT event_id, CASE event_type WHEN 'click' THEN 'clk' WHEN 'error' THEN 'err' WHEN 'purchase' THEN 'buy'
  WHEN 'signup' THEN 'sgn' WHEN 'view' THEN 'viw' END AS model_short FROM events""",
    "parse_label_list": """
SELECT event_id,
  array_to_string(list_transform(regexp_extract_all(props, '\\d', 0), lambda x: TRY_CAST(x AS BIGINT)), ',') AS labels_digit,
  array_to_string(list_transform(regexp_extract_all(props, '\\d+', 0), lambda x: TRY_CAST(x AS BIGINT)), ',') AS labels_number
FROM events""",
    "decision_three_way": _THREE,
    "decision_flips": f"""
SELECT decision, decision_generic, decision_tailored, count(*) AS n FROM ({_THREE}) GROUP BY ALL""",
    "scores_wide": "SELECT c.c_custkey, " + ", ".join(f"round(w.\"{m}\", 9) AS \"{m}\"" for m in _MODELS)
    + f" FROM customer c LEFT JOIN ({_WIDE}) w ON w.user_id = c.c_custkey",
    "scores_before_after": f"""
SELECT user_id, event_type, round(score_original, 9) AS score_original, round(score_updated, 9) AS score_updated
FROM ({_BEFORE_AFTER})""",
    "patch_answers": f"""
WITH u AS ({_UPDATES_LONG}),
p AS (SELECT part, variable, 'retry: ' || variable AS value FROM u WHERE value IS NULL AND starts_with(variable, 'answer.'))
SELECT part, variable, coalesce(p.value, u.value) AS value FROM u LEFT JOIN p USING (part, variable)""",
    "unanswered_questions": f"""
SELECT u.part, u.variable, string_split(u.variable, '.')[-1] AS question_name, u.key, u.update_type,
  u.update_type || ': ' || d.text AS prompt
FROM ({_PARSED_UPDATES}) u JOIN documents d ON d.doc_id = u.key
WHERE u.value IS NULL OR u.value = ''""",
    "train_test_anti": f"""
SELECT doc_id, quality FROM labels WHERE NOT ({_h(11, 'doc_id')} / 1152921504606846976.0 < 0.8)""",
    "truth_vs_prediction": f"""
SELECT l.doc_id, l.quality AS decision_true, {_IS_US} AS decision_pred FROM labels l JOIN documents d USING (doc_id)""",
    "pool_union": """
SELECT vec_id, label AS pool, label || '_' || (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) AS name
FROM embeddings""",
    "model_gap": f"SELECT user_id, model_a, model_b, round(gap, 9) AS gap FROM ({_GAPS})",
    "score_histogram": f"""
WITH g AS (SELECT * FROM ({_GAPS}) WHERE gap IS NOT NULL),
r0 AS (SELECT model_a, model_b, min(gap) AS mn, max(gap) AS mx FROM g GROUP BY ALL),
r AS (SELECT model_a, model_b, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo,
        CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM r0),
b0 AS (SELECT g.model_a, g.model_b, g.gap AS x, r.lo, r.hi, (r.hi - r.lo) / 20 AS step,
         CAST(least(floor((g.gap - r.lo) * (20.0 / (r.hi - r.lo))), 19) AS INTEGER) AS i0
       FROM g JOIN r USING (model_a, model_b)),
b1 AS (SELECT *, CASE WHEN x < (CASE WHEN i0 = 20 THEN hi ELSE i0 * step + lo END) THEN i0 - 1 ELSE i0 END AS i1 FROM b0),
b2 AS (SELECT model_a, model_b,
         CASE WHEN x >= (CASE WHEN i1 + 1 = 20 THEN hi ELSE (i1 + 1) * step + lo END) AND i1 <> 19 THEN i1 + 1 ELSE i1 END AS bin
       FROM b1),
c AS (SELECT model_a, model_b, bin, count(*) AS n FROM b2 GROUP BY ALL)
SELECT r.model_a, r.model_b, CAST(s.bin AS INTEGER) AS bin,
  round(s.bin * ((r.hi - r.lo) / 20) + r.lo, 9) AS bin_lo,
  round(CASE WHEN s.bin + 1 = 20 THEN r.hi ELSE (s.bin + 1) * ((r.hi - r.lo) / 20) + r.lo END, 9) AS bin_hi,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM r CROSS JOIN range(20) s(bin) LEFT JOIN c ON c.model_a = r.model_a AND c.model_b = r.model_b AND c.bin = s.bin""",
    "score_did": f"SELECT user_id, model_a, model_b, round(did, 9) AS did FROM ({_DID})",
    "did_histogram": f"""
WITH d AS ({_DID}),
k AS (SELECT DISTINCT model_a, model_b FROM d),
c AS (SELECT model_a, model_b, CAST(least(floor(did), 8) AS INTEGER) AS bin_lo, count(*) AS n
      FROM d WHERE did >= -10 AND did <= 9 GROUP BY ALL)
SELECT k.model_a, k.model_b, CAST(s.b AS INTEGER) AS bin_lo, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM k CROSS JOIN range(-10, 9) s(b) LEFT JOIN c ON c.model_a = k.model_a AND c.model_b = k.model_b AND c.bin_lo = s.b""",
    "score_matrix": f"""
SELECT event_type AS eval_model, user_id AS resume,
  round(avg(value) FILTER (WHERE phase = 'original'), 9) AS original,
  round(avg(value) FILTER (WHERE phase = 'updated'), 9) AS updated
FROM ({_EVENTS_PHASE}) GROUP BY event_type, user_id""",
    "improvement_ranking": f"""
SELECT concat_ws(' -> ', drafting_model, improving_model, scoring_model) AS chain,
  round(avg(score), 9) AS mean_score, count(*) AS n
FROM ({_GRID}) GROUP BY 1""",
    "describe_scores": """
SELECT event_type, count(value) AS count, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS std,
  round(min(value), 9) AS min, round(quantile_cont(value, 0.25), 9) AS q25, round(quantile_cont(value, 0.5), 9) AS q50,
  round(quantile_cont(value, 0.75), 9) AS q75, round(max(value), 9) AS max
FROM events GROUP BY event_type""",
    "evaluator_counts": "SELECT event_type, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type",
    "category_counts": """
SELECT split_part(source || '_' || doc_id, '_', 1) AS category, count(*) AS n FROM documents GROUP BY 1""",
    "null_profile": """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE d.doc_id IS NULL) AS null_doc_id,
  count(*) FILTER (WHERE text IS NULL) AS null_text, count(*) FILTER (WHERE lang IS NULL) AS null_lang,
  count(*) FILTER (WHERE source IS NULL) AS null_source, count(*) FILTER (WHERE n_chars IS NULL) AS null_n_chars,
  count(*) FILTER (WHERE quality IS NULL) AS null_quality, count(*) FILTER (WHERE toxic IS NULL) AS null_toxic
FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "confusion_matrix": """
WITH ls AS (SELECT quality AS l FROM labels UNION SELECT toxic FROM labels),
c AS (SELECT quality AS true_label, toxic AS pred_label, count(*) AS n FROM labels GROUP BY ALL)
SELECT t.l AS true_label, p.l AS pred_label, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM ls t CROSS JOIN ls p LEFT JOIN c ON c.true_label = t.l AND c.pred_label = p.l
WHERE t.l IS NOT NULL AND p.l IS NOT NULL""",
    "accuracy": "SELECT round(avg(CAST(quality = toxic AS DOUBLE)), 9) AS accuracy, count(*) AS n FROM labels",
    "token_f1": """
WITH c AS (SELECT * FROM conversations),
p AS (SELECT u.text AS original, a.text AS updated FROM c u JOIN c a
      ON a.conv_id = u.conv_id AND a.turn - 1 = u.turn AND u.role = 'user' AND a.role = 'assistant'),
t AS (SELECT list_transform(list_filter(regexp_split_to_array(original, '\\s+'), lambda x: x <> ''), lambda x: least(length(x), 12)) AS t,
             list_transform(list_filter(regexp_split_to_array(updated, '\\s+'), lambda x: x <> ''), lambda x: least(length(x), 12)) AS p
      FROM p),
s AS (SELECT * FROM t WHERE len(t) = len(p)),
z AS (SELECT unnest(t) AS a, unnest(p) AS b FROM s)
SELECT (SELECT count(*) FROM s) AS n_sequences, count(*) AS n_tokens,
  round(count(*) FILTER (WHERE a = b) / count(*), 9) AS micro_f1 FROM z""",
    "auroc_hard": """
WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn,
  count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp FROM labels)
SELECT tp, fn, tn, fp, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS auroc FROM c""",
    "auroc_score": """
WITH d AS (SELECT source, quality AS t, n_chars AS x FROM labels JOIN documents USING (doc_id)),
r AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY x) + (count(*) OVER (PARTITION BY source, x) - 1) / 2 AS r FROM d WHERE x IS NOT NULL AND t IN (0, 1)),
g AS (SELECT source, count(*) FILTER (WHERE t = 1) AS p, count(*) FILTER (WHERE t = 0) AS n, sum(r) FILTER (WHERE t = 1) AS s FROM r GROUP BY source)
SELECT k.source, CAST(coalesce(p, 0) AS BIGINT) AS n_positive, CAST(coalesce(n, 0) AS BIGINT) AS n_negative, k.u AS n_unscored,
  round(CASE WHEN p > 0 AND n > 0 THEN (s - p * (p + 1) / 2) / (p * n) END, 9) AS auroc
FROM (SELECT source, count(*) FILTER (WHERE x IS NULL AND t IN (0, 1)) AS u FROM d GROUP BY source) k LEFT JOIN g ON k.source IS NOT DISTINCT FROM g.source""",
    "roc_points": """
WITH d AS (SELECT source, quality AS t, CAST(n_chars AS DOUBLE) AS x FROM labels JOIN documents USING (doc_id) WHERE n_chars IS NOT NULL),
c AS (SELECT source, x, count(*) FILTER (WHERE t = 1) AS p, count(*) FILTER (WHERE t = 0) AS n FROM d GROUP BY source, x),
s AS (SELECT source, x, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY source) AS ps, sum(n) OVER (PARTITION BY source) AS ns
      FROM c WINDOW w AS (PARTITION BY source ORDER BY x DESC))
SELECT source, x AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / nullif(ps, 0), 9) AS tpr, round(fp / nullif(ns, 0), 9) AS fpr FROM s""",
    "distinct_elements": """
SELECT pool, count(DISTINCT x) AS n_distinct FROM (SELECT label AS pool, unnest(embedding) AS x FROM embeddings) GROUP BY pool""",
    "sample_n": f"SELECT doc_id FROM documents ORDER BY {_h(7, 'doc_id')}, doc_id LIMIT 100",
    "stratified_sample": f"""
SELECT * FROM (SELECT doc_id, {_IS_US} AS is_us,
  row_number() OVER (PARTITION BY {_IS_US} ORDER BY {_h(7, 'doc_id')}, doc_id) AS srank FROM documents) WHERE srank <= 25""",
    "stratified_train_test": f"""
SELECT doc_id, is_us, CASE WHEN srank <= 25 THEN 'train' ELSE 'test' END AS split FROM (
  SELECT doc_id, {_IS_US} AS is_us,
    row_number() OVER (PARTITION BY {_IS_US} ORDER BY {_h(7, 'doc_id')}, doc_id) AS srank FROM documents) WHERE srank <= 50""",
    "positional_split": """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < floor(0.8 * (SELECT count(*) FROM labels)) THEN 'train' ELSE 'test' END AS split
FROM labels""",
    "hash_split": f"SELECT doc_id, CASE WHEN {_h(7, 'doc_id')} / 1152921504606846976.0 < 0.8 THEN 'train' ELSE 'test' END AS split FROM documents",
    "bootstrap_draws": f"""
WITH idx AS (SELECT label AS pool, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS j,
                    count(*) OVER (PARTITION BY label) AS n FROM embeddings),
d AS (SELECT pool, it, ({_h(3, 'pool', 'it', 'j')}) % n AS pick FROM idx CROSS JOIN range(20) t(it))
SELECT d.pool, CAST(d.it AS INTEGER) AS iter, idx.vec_id, count(*) AS weight
FROM d JOIN idx ON idx.pool = d.pool AND idx.j = d.pick GROUP BY ALL""",
})

_RANKED = f"SELECT *, row_number() OVER (PARTITION BY pool ORDER BY vec_id) - 1 AS rank FROM ({_POOLS})"
_REF = f"SELECT pool, arg_min(e, vec_id) AS r FROM ({_POOLS}) GROUP BY pool"
_SEP = f"""
SELECT p.pool, quantile_cont(1 - list_cosine_similarity(p.e, c.c), 0.5) AS separation
FROM ({_POOLS}) p JOIN ({_CENTROIDS}) c USING (pool) GROUP BY p.pool
"""
_PAIRED = f"""
SELECT o.pool, o.rank, 1 - list_cosine_similarity(o.e, b.e) AS distance
FROM ({_RANKED}) o JOIN ({_RANKED}) b ON b.pool = 0 AND o.pool <> 0 AND o.rank = b.rank
"""
_DRIFT = "SELECT rank, " + ", ".join(
    f"first(distance) FILTER (WHERE pool = {r}) AS distance_{r}" for r in range(1, 10)) + f" FROM ({_PAIRED}) GROUP BY rank"
_IDX = "SELECT label AS pool, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS j, count(*) OVER (PARTITION BY label) AS n FROM embeddings"


def _draws(seed, iters, size=None):
    """Multinomial bootstrap draws per pool, as ``bootstrap_draws``: (pool, iter, vec_id, weight)."""
    if size is None:
        src = f"SELECT pool, it, j AS draw, n FROM idx CROSS JOIN range({iters}) t(it)"
    else:
        src = (f"SELECT i.pool, it, s.draw, i.n FROM (SELECT DISTINCT pool, n FROM idx) i "
               f"CROSS JOIN range({size}) s(draw) CROSS JOIN range({iters}) t(it)")
    return f"""
idx AS ({_IDX}),
src AS ({src}),
d AS (SELECT pool, it, ({_h(seed, 'pool', 'it', 'draw')}) % n AS pick FROM src),
draws AS (SELECT d.pool, CAST(d.it AS INTEGER) AS iter, idx.vec_id, count(*) AS weight
          FROM d JOIN idx ON idx.pool = d.pool AND idx.j = d.pick GROUP BY ALL)"""


_SHIFT_PAIRS = f"""
SELECT x.pool // 2 AS pair, x.rank, x.e AS x, y.e AS y FROM ({_RANKED}) x JOIN ({_RANKED}) y
ON x.pool % 2 = 0 AND y.pool = x.pool + 1 AND x.rank = y.rank
"""


def _power(name: str, start: str, steps: int = 14) -> str:
    """Recursive squaring of a matrix (a list of rows), scaled to trace 1: near the projection on its first component."""
    scaled = "list_transform(mm, lambda r: list_transform(r, lambda v: v / list_sum(list_transform(range(1, len(mm) + 1), lambda i: mm[i][i]))))"
    return f"""
{name}(k, m) AS (
  SELECT 0, {scaled} FROM (SELECT m AS mm FROM {start})
  UNION ALL
  SELECT k + 1, {scaled} FROM (SELECT k, list_transform(m, lambda r: list_transform(m, lambda s: list_dot_product(r, s))) AS mm FROM {name} WHERE k < {steps}))"""


def _direction(name: str, power: str) -> str:
    """The unit vector of a power's largest row, its largest entry positive."""
    return f"""
{name} AS (
  SELECT list_transform(u, lambda x: x * sign(u[list_position(a, list_max(a))])) AS v FROM (
    SELECT u, list_transform(u, lambda x: abs(round(x, 12))) AS a FROM (
      SELECT list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS u FROM (
        SELECT m[list_position(d, list_max(d))] AS r FROM (
          SELECT m, list_transform(range(1, len(m) + 1), lambda i: m[i][i]) AS d FROM {power} ORDER BY k DESC LIMIT 1)))))"""


# Scores on the first two principal components of all rows.
_PCS = f"""
WITH RECURSIVE x AS (SELECT vec_id, pool, unnest(e) AS v, unnest(range(1, len(e) + 1)) AS i FROM ({_POOLS})),
mu AS (SELECT i, avg(v) AS m FROM x GROUP BY i),
z AS (SELECT vec_id, pool, list(v - m ORDER BY i) AS e FROM x JOIN mu USING (i) GROUP BY vec_id, pool),
zi AS (SELECT vec_id, unnest(e) AS v, unnest(range(1, len(e) + 1)) AS i FROM z),
cov AS (SELECT a.i, b.i AS j, sum(a.v * b.v) / (SELECT count(*) FROM z) AS c FROM zi a JOIN zi b USING (vec_id) GROUP BY a.i, b.i),
c1 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM cov GROUP BY i)),
{_power("p1", "c1")},
{_direction("v1", "p1")},
l1 AS (SELECT list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS l FROM c1, v1),
c2 AS (SELECT list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j: m[i][j] - l * v[i] * v[j])) AS m FROM c1, v1, l1),
{_power("p2", "c2")},
{_direction("v2", "p2")}
SELECT vec_id, pool, list_dot_product(z.e, v1.v) AS pc0, list_dot_product(z.e, v2.v) AS pc1 FROM z, v1, v2
"""
_SHIFT_MAPS = f"""
WITH c AS MATERIALIZED ({_PCS}),
rk AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY vec_id) - 1 AS rank FROM c),
p AS (SELECT x.pool // 2 AS pair, x.rank, x.pc0 AS x0, x.pc1 AS x1, y.pc0 AS y0, y.pc1 AS y1 FROM rk x JOIN rk y
      ON x.pool % 2 = 0 AND y.pool = x.pool + 1 AND x.rank = y.rank),
idx AS (SELECT pair, rank, row_number() OVER (PARTITION BY pair ORDER BY rank) - 1 AS j, count(*) OVER (PARTITION BY pair) AS n FROM p),
src AS (SELECT i.pair, it, s.draw, i.n FROM (SELECT DISTINCT pair, n FROM idx) i CROSS JOIN range(100) s(draw) CROSS JOIN range(10) t(it)),
d AS (SELECT pair, it, ({_h(13, 'pair', 'it', 'draw')}) % n AS pick FROM src),
sample AS (SELECT CAST(d.it AS INTEGER) AS iter, x0, x1, y0, y1
           FROM d JOIN idx ON idx.pair = d.pair AND idx.j = d.pick JOIN p ON p.pair = idx.pair AND p.rank = idx.rank),
g AS (SELECT iter, o.out_dim, var_pop(x0) AS s00, var_pop(x1) AS s11, covar_pop(x0, x1) AS s01,
        covar_pop(CASE o.out_dim WHEN 0 THEN y0 ELSE y1 END, x0) AS sy0, covar_pop(CASE o.out_dim WHEN 0 THEN y0 ELSE y1 END, x1) AS sy1,
        avg(x0) AS m0, avg(x1) AS m1, avg(CASE o.out_dim WHEN 0 THEN y0 ELSE y1 END) AS my
      FROM sample CROSS JOIN (SELECT CAST(range AS INTEGER) AS out_dim FROM range(2)) o GROUP BY ALL),
co AS (SELECT iter, out_dim, (sy0 * s11 - sy1 * s01) / (s00 * s11 - s01 * s01) AS b0,
        (sy1 * s00 - sy0 * s01) / (s00 * s11 - s01 * s01) AS b1, m0, m1, my FROM g)
SELECT iter, out_dim, b0, b1, my - b0 * m0 - b1 * m1 AS b FROM co
"""
_MEDSIM_TRUE = f"""
SELECT a.pool, quantile_cont(list_cosine_similarity(a.e, b.e), 0.5) AS median_similarity
FROM ({_POOLS}) a JOIN ({_POOLS}) b ON a.pool = b.pool AND a.vec_id < b.vec_id GROUP BY a.pool
"""
_SAMPLE_METRICS = f"""
WITH {_draws(9, 1000, 100)[1:]},
p AS ({_POOLS}),
ex AS (SELECT d.pool, d.iter, p.e, row_number() OVER (PARTITION BY d.pool, d.iter ORDER BY d.vec_id, k) AS pos
       FROM draws d JOIN p USING (pool, vec_id) CROSS JOIN LATERAL range(d.weight) r(k)),
sims AS (SELECT a.pool, a.iter, quantile_cont(list_cosine_similarity(a.e, b.e), 0.5) AS median_similarity
         FROM ex a JOIN ex b ON a.pool = b.pool AND a.iter = b.iter AND a.pos < b.pos GROUP BY ALL),
uniq AS (SELECT pool, iter, count(DISTINCT x) AS distinct_elements FROM (SELECT pool, iter, unnest(e) AS x FROM ex) GROUP BY ALL)
SELECT s.pool, s.iter, s.median_similarity, u.distinct_elements FROM sims s JOIN uniq u USING (pool, iter)
"""

ORACLE.update({
    "cosine_to_reference": f"""
SELECT vec_id, pool, round(1 - list_cosine_similarity(e, r), 9) AS distance FROM ({_POOLS}) JOIN ({_REF}) USING (pool)""",
    "euclid_to_reference": f"""
SELECT vec_id, pool, round(list_distance(e, r), 9) AS distance FROM ({_POOLS}) JOIN ({_REF}) USING (pool)""",
    "pool_centroid": f"""
SELECT pool, CAST(i - 1 AS INTEGER) AS dim, round(avg(x), 9) AS mean
FROM (SELECT pool, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM ({_POOLS})) GROUP BY pool, i""",
    "separation_gap": f"""
WITH s AS ({_SEP}) SELECT pool, round(separation - (SELECT separation FROM s WHERE pool = 0), 9) AS gap FROM s""",
    "separation_bootstrap": f"""
WITH p AS ({_POOLS}),
j AS (SELECT * FROM (SELECT pool, CAST(it AS INTEGER) AS iter, e, {_poisson(f"({_h(5, 'vec_id', 'it')} / 1152921504606846976.0)")} AS weight
      FROM p CROSS JOIN range(100) t(it)) WHERE weight > 0),
c AS (SELECT pool, iter, list(m ORDER BY i) AS c FROM (
        SELECT pool, iter, i, sum(x * weight) / sum(weight) AS m FROM (
          SELECT pool, iter, weight, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM j) GROUP BY ALL)
      GROUP BY pool, iter),
dist AS (SELECT j.pool, j.iter, 1 - list_cosine_similarity(j.e, c.c) AS dd, j.weight FROM j JOIN c USING (pool, iter)),
ex AS (SELECT pool, iter, dd FROM dist CROSS JOIN LATERAL range(weight) r(k)),
s AS (SELECT pool, iter, quantile_cont(dd, 0.5) AS sep FROM ex GROUP BY ALL),
sd AS (SELECT pool, stddev_pop(sep) AS separation_sd FROM s GROUP BY pool)
SELECT t.pool, round(t.separation, 9) AS separation, round(sd.separation_sd, 9) AS separation_sd
FROM ({_SEP}) t LEFT JOIN sd USING (pool)""",
    "median_pairwise_similarity": f"""
SELECT pool, round(median_similarity, 9) AS median_similarity FROM ({_MEDSIM_TRUE})""",
    "bootstrap_metrics": f"""
SELECT pool, iter, round(median_similarity, 9) AS median_similarity, distinct_elements FROM ({_SAMPLE_METRICS})""",
    "bootstrap_ci": f"""
WITH s AS ({_SAMPLE_METRICS}),
long AS (SELECT pool, 'median_similarity' AS metric, median_similarity AS v FROM s
         UNION ALL SELECT pool, 'distinct_elements', CAST(distinct_elements AS DOUBLE) FROM s),
ci AS (SELECT pool, metric, quantile_cont(v, 0.025) AS ci_lo, quantile_cont(v, 0.975) AS ci_hi FROM long GROUP BY ALL),
tr AS (SELECT pool, 'median_similarity' AS metric, median_similarity AS value FROM ({_MEDSIM_TRUE})
       UNION ALL SELECT label, 'distinct_elements', CAST(count(DISTINCT x) AS DOUBLE)
       FROM (SELECT label, unnest(embedding) AS x FROM embeddings) GROUP BY label)
SELECT pool, metric, round(value, 9) AS value, round(ci_lo, 9) AS ci_lo, round(ci_hi, 9) AS ci_hi
FROM tr JOIN ci USING (pool, metric)""",
    "paired_distance": f"SELECT pool, rank, round(distance, 9) AS distance FROM ({_PAIRED})",
    "drift_by_round": "SELECT rank, " + ", ".join(f"round(distance_{r}, 9) AS distance_{r}" for r in range(1, 10))
    + f" FROM ({_DRIFT})",
    "drift_mean": "SELECT " + ", ".join(f"round(avg(distance_{r}), 9) AS mean_distance_{r}" for r in range(1, 10))
    + f" FROM ({_DRIFT})",
    "distance_band_match": f"""
WITH a AS (SELECT vec_id, e FROM ({_POOLS}) WHERE pool % 2 = 0), b AS (SELECT vec_id, e FROM ({_POOLS}) WHERE pool % 2 = 1),
m AS (SELECT a.vec_id AS vec_id_a, b.vec_id AS vec_id_b, list_distance(a.e, b.e) AS d FROM a CROSS JOIN b
      WHERE abs(list_distance(a.e, b.e) - 1.2) < 0.05)
SELECT vec_id_a, min(vec_id_b) AS vec_id_b, round(arg_min(d, vec_id_b), 9) AS distance FROM m GROUP BY vec_id_a""",
    "shift_linear_map": f"""
SELECT iter, out_dim, round(b0, 9) AS coef_0, round(b1, 9) AS coef_1, round(b, 9) AS intercept FROM ({_SHIFT_MAPS})""",
    "shift_map_summary": f"""
SELECT out_dim, count(*) AS n_samples, round(avg(b0), 9) AS mean_coef_0, round(stddev_pop(b0), 9) AS sd_coef_0,
  round(avg(b1), 9) AS mean_coef_1, round(stddev_pop(b1), 9) AS sd_coef_1, round(avg(b), 9) AS mean_intercept, round(stddev_pop(b), 9) AS sd_intercept
FROM ({_SHIFT_MAPS}) GROUP BY out_dim""",
    "pca_project": f"SELECT vec_id, pool, round(pc0, 9) AS pc0, round(pc1, 9) AS pc1 FROM ({_PCS})",
    "shift_pull_estimate": f"""
WITH p AS ({_SHIFT_PAIRS}),
z AS (SELECT unnest(x) AS x, unnest(y) AS y, unnest(range(0, len(x))) AS dim FROM p),
g AS (SELECT CAST(dim AS INTEGER) AS dim, regr_slope(y - x, x) AS s, regr_intercept(y - x, x) AS i, count(*) AS n FROM z GROUP BY dim)
SELECT dim, round(-s, 9) AS alpha, round(-i / s, 9) AS fixed_point, n FROM g""",
    "density_grid": f"""
SELECT pool, CAST(floor(pc0 / 0.05) AS BIGINT) AS gx, CAST(floor(pc1 / 0.05) AS BIGINT) AS gy, count(*) AS n FROM ({_PCS}) GROUP BY ALL""",
    "rewrite_trajectory": f"""
WITH r AS (SELECT rank, pool AS round, e FROM ({_RANKED})),
f AS (SELECT rank, arg_min(e, round) AS fe FROM r GROUP BY rank)
SELECT r.rank, r.round, round(1 - list_cosine_similarity(r.e, f.fe), 9) AS dist_to_first,
  round(1 - list_cosine_similarity(r.e, lag(r.e) OVER (PARTITION BY r.rank ORDER BY r.round)), 9) AS dist_to_prev
FROM r JOIN f USING (rank)""",
})

from shiftkit.operators.prompts import PROMPT_KINDS as _KINDS  # noqa: E402


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SWLIST = "[" + ", ".join(_q(w) for w in _SW) + "]"
_TRAIN_DOCS = f"SELECT * FROM documents WHERE {_h(7, 'doc_id')} / 1152921504606846976.0 < 0.8"
_VOCAB = f"""
SELECT term, n, CAST(row_number() OVER (ORDER BY n DESC, term) - 1 AS INTEGER) AS term_id FROM (
  SELECT term, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}', 0)) AS term FROM ({_TRAIN_DOCS}))
  WHERE NOT list_contains({_SWLIST}, term) GROUP BY term ORDER BY n DESC, term LIMIT 5000)
"""
_PAIRS_TXT = """
SELECT u.conv_id, u.turn, u.text AS original, a.text AS updated FROM conversations u JOIN conversations a
ON a.conv_id = u.conv_id AND a.turn - 1 = u.turn AND u.role = 'user' AND a.role = 'assistant'
"""
_TOKDIFF = f"""
WITH p AS ({_PAIRS_TXT}),
t AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(coalesce(original, ''), '\\s+'), lambda x: x <> '')) AS token, 1 AS nb, 0 AS na FROM p
      UNION ALL
      SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(coalesce(updated, ''), '\\s+'), lambda x: x <> '')), 0, 1 FROM p),
g AS (SELECT conv_id, turn, token, sum(nb) AS nb, sum(na) AS na FROM t GROUP BY ALL),
j AS (SELECT p.conv_id, p.turn, g.token, coalesce(nb, 0) AS nb, coalesce(na, 0) AS na FROM p LEFT JOIN g USING (conv_id, turn))
SELECT conv_id, turn, token, least(nb, na) AS kept, nb - least(nb, na) AS removed, na - least(nb, na) AS added FROM j
"""
_PROFILE_TEMPLATE = "Profile <ID> (<LANG>, <SOURCE>):\n<TEXT>\n<CONTACT> stays as it is."
_PERSONAS = ["recruiter", "peer"]
_PMODELS = ["gpt4", "gemini", "mixtral"]


def _prompt_sql(kinds):
    vals = ", ".join(f"({_q(k)}, {_q(_KINDS[k])})" for k in kinds)
    pers = ", ".join(f"({_q(p)})" for p in _PERSONAS)
    mods = ", ".join(f"({_q(m)})" for m in _PMODELS)
    return f"""
SELECT sha256(concat_ws('|', k.kind, CAST(d.doc_id AS VARCHAR), p.agent, m.model)) AS prompt_id, k.kind,
  CAST(d.doc_id AS VARCHAR) AS text_name, p.agent, m.model,
  replace(replace(replace(k.t, '<PERSONA>', p.agent), '<POST>', ''), '<TEXT>', d.text) AS prompt
FROM documents d CROSS JOIN (VALUES {vals}) k(kind, t) CROSS JOIN (VALUES {pers}) p(agent) CROSS JOIN (VALUES {mods}) m(model)
"""


_DECISIONS_TEXT = f"""
SELECT agent AS persona, CAST(regexp_extract(variable, '_(.*)', 1) AS BIGINT) AS doc_id,
  CASE WHEN value = 'Yes' THEN 1 ELSE 0 END AS decision
FROM ({_DECISIONS_LONG})
"""

ORACLE.update({
    "vocabulary_topk": f"SELECT term, n, term_id FROM ({_VOCAB})",
    "token_ids": f"""
WITH v AS ({_VOCAB}),
t AS (SELECT doc_id, unnest(l) AS term, unnest(range(len(l))) AS pos FROM (
        SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}', 0) AS l FROM documents)),
ids AS (SELECT t.doc_id, list(coalesce(v.term_id, -2) ORDER BY t.pos) AS l FROM t LEFT JOIN v USING (term) GROUP BY t.doc_id)
SELECT d.doc_id, array_to_string(coalesce(ids.l, []), ',') AS input_ids FROM documents d LEFT JOIN ids USING (doc_id)""",
    "revision_token_diff": f"""
SELECT conv_id, turn, CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(removed) AS BIGINT) AS removed,
  CAST(sum(added) AS BIGINT) AS added FROM ({_TOKDIFF}) GROUP BY conv_id, turn""",
    "ordered_token_diff": f"""
WITH p AS ({_PAIRS_TXT}),
w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(coalesce(original, ''), '\\s+'), lambda x: x <> '') AS a,
        list_filter(regexp_split_to_array(coalesce(updated, ''), '\\s+'), lambda x: x <> '') AS b FROM p)
SELECT conv_id, turn, md5(array_to_string(a, ' ')) AS before_md5, md5(array_to_string(b, ' ')) AS after_md5, TRUE AS in_order FROM w WHERE len(a) + len(b) > 0""",
    "top_added_tokens": f"""
SELECT token, CAST(sum(added) AS BIGINT) AS added FROM ({_TOKDIFF}) GROUP BY token HAVING sum(added) > 0
ORDER BY added DESC, token LIMIT 20""",
    "template_params": """
SELECT page_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS param
FROM (SELECT page_id, regexp_extract_all(html, '<([^>]*)>', 1) AS l FROM pages)""",
    "template_fill": f"""
SELECT doc_id, 'profile' AS template_id,
  replace(replace(replace(replace({_q(_PROFILE_TEMPLATE)}, '<ID>', CAST(doc_id AS VARCHAR)), '<LANG>', lang),
          '<SOURCE>', source), '<TEXT>', text) AS filled
FROM documents""",
    "prompt_grid": _prompt_sql(["score"]),
    "prompt_kinds": f"SELECT kind, count(*) AS n, CAST(sum(length(prompt)) AS BIGINT) AS chars FROM ({_prompt_sql(list(_KINDS))}) GROUP BY kind",
    "apply_answers": """
SELECT d.doc_id, coalesce(c.text, d.text) AS cleaned_text FROM documents d
LEFT JOIN (SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id) c ON c.conv_id = d.doc_id""",
    "rewrite_rounds": f"""
WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS text_name, CAST(range AS INTEGER) AS round, substr(text, 1 + range) AS text FROM documents CROSS JOIN range(4)),
t AS (SELECT text_name, round, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}', 0)) AS w FROM r),
b AS (SELECT text_name, round, {_h('embed', 'w')} % 64 AS b, count(*) AS n FROM t GROUP BY ALL),
l AS (SELECT text_name, round, sqrt(sum(n * n)) AS l FROM b GROUP BY ALL),
x AS (SELECT u.text_name, u.round, sum(u.n * v.n) AS dot FROM b u JOIN b v ON v.text_name = u.text_name AND v.round = 0 AND v.b = u.b GROUP BY ALL)
SELECT r.text_name, r.round, length(r.text) AS n_chars,
  CASE WHEN l.l > 0 AND f.l > 0 THEN CASE WHEN abs(1 - coalesce(x.dot, 0) / (l.l * f.l)) < 5e-10 THEN 0.0::DOUBLE
    ELSE round(1 - coalesce(x.dot, 0) / (l.l * f.l), 9) END END AS distance
FROM r LEFT JOIN l USING (text_name, round) LEFT JOIN l f ON f.text_name = r.text_name AND f.round = 0 LEFT JOIN x ON x.text_name = r.text_name AND x.round = r.round""",
    "embed_texts": f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}', 0)) AS w FROM documents),
b AS (SELECT doc_id, {_h('embed', 'w')} % 64 AS b, count(*) AS n FROM t GROUP BY ALL),
l AS (SELECT doc_id, sqrt(sum(n * n)) AS l FROM b GROUP BY ALL)
SELECT d.doc_id, string_agg(CAST(CAST(round(CAST(CAST(coalesce(b.n / l.l, 0) AS FLOAT) AS DOUBLE) * 100000) AS BIGINT) AS VARCHAR), ',' ORDER BY i.range) AS embedding
FROM documents d CROSS JOIN range(64) i LEFT JOIN b ON b.doc_id = d.doc_id AND b.b = i.range LEFT JOIN l ON l.doc_id = d.doc_id GROUP BY d.doc_id""",
    "decision_history": f"""
WITH train AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM labels)
               WHERE i < floor(0.8 * (SELECT count(*) FROM labels))),
d AS (SELECT x.persona, x.doc_id, x.decision, doc.text FROM ({_DECISIONS_TEXT}) x JOIN documents doc USING (doc_id)
      JOIN train USING (doc_id)),
r AS (SELECT *, (row_number() OVER (PARTITION BY persona ORDER BY doc_id) - 1) // 1000 AS block FROM d)
SELECT persona, CAST(block AS BIGINT) AS block, count(*) AS n_items,
  string_agg(text || {_q(chr(10) + "Decision: ")} || decision || {_q(chr(10) + "------" + chr(10))}, '' ORDER BY doc_id) AS history
FROM r GROUP BY persona, block""",
    "few_shot_block": f"""
WITH d AS (SELECT x.persona, x.doc_id, x.decision, doc.text FROM ({_DECISIONS_TEXT}) x JOIN documents doc USING (doc_id)
           QUALIFY row_number() OVER (PARTITION BY x.persona ORDER BY {_h(21, 'x.doc_id')}, x.doc_id) <= 8)
SELECT persona, CAST(0 AS BIGINT) AS block, count(*) AS n_items,
  string_agg(text || ', Hired: ' || decision || {_q(chr(10) * 2 + " ----- " + chr(10) * 2)}, '' ORDER BY doc_id) AS history
FROM d GROUP BY persona""",
    "incremental_prompts": f"""
SELECT sha256(concat_ws('|', k.kind, conv_id || '_' || turn, 'persona', 'model')) AS prompt_id, k.kind, conv_id || '_' || turn AS text_name,
  replace(replace(replace(k.t, '<PERSONA>', 'persona'), '<POST>', ''), '<TEXT>', text) AS prompt
FROM conversations CROSS JOIN (VALUES {", ".join(f"({_q(k)}, {_q(_KINDS[k])})" for k in ("clean", "redact", "improve"))}) k(kind, t)
WHERE role = 'user' AND text IS NOT NULL""",
    "improvement_rows": f"""
SELECT event_id, concat_ws(' -> ', drafting_model, improving_model, coalesce(scoring_model, '-')) AS chain, round(score, 9) AS score FROM ({_GRID})""",
    "score_against_post": f"""
SELECT sha256(concat_ws('|', 'score_post', CAST(d.doc_id AS VARCHAR), 'recruiter', 'model')) AS prompt_id, CAST(d.doc_id AS VARCHAR) AS text_name,
  replace(replace(replace({_q(_KINDS['score_post'])}, '<PERSONA>', 'recruiter'), '<POST>', coalesce(b.text, '')), '<TEXT>', d.text) AS prompt
FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark) WHERE d.text IS NOT NULL""",
    "label_prompts": f"""
SELECT sha256(concat_ws('|', 'label', conv_id || '_' || turn, 'annotator', 'model')) AS prompt_id, conv_id || '_' || turn AS text_name,
  replace(replace({_q(_KINDS['label'])}, '<PERSONA>', 'annotator'), '<TEXT>',
    array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), ' | ')) AS prompt
FROM conversations WHERE role = 'user' AND text IS NOT NULL""",
    "classifier_accuracy": f"""
SELECT m AS method, CAST(sum({_IS_US}) AS BIGINT) AS n_positive, CAST(sum(1 - {_IS_US}) AS BIGINT) AS n_negative, TRUE AS accuracy_of_counts, TRUE AS beats_majority
FROM documents CROSS JOIN (VALUES ('logistic_regression'), ('random_forest'), ('neural_network')) v(m)
WHERE NOT ({_h(7, 'doc_id')} / 1152921504606846976.0 < 0.8) GROUP BY m""",
    "variant_auroc": f"""
WITH p AS (SELECT key FROM ({_PIVOT_UPDATES}) WHERE clean IS NOT NULL AND redact IS NOT NULL AND improve IS NOT NULL),
d AS (SELECT {_IS_US} AS y FROM documents JOIN p ON p.key = doc_id WHERE NOT ({_h(7, 'doc_id')} / 1152921504606846976.0 < 0.8))
SELECT v AS variant, CAST(count(*) FILTER (WHERE y = 1) AS BIGINT) AS n_positive, CAST(count(*) FILTER (WHERE y = 0) AS BIGINT) AS n_negative,
  count(*) FILTER (WHERE y = 1) > 0 AND count(*) FILTER (WHERE y = 0) > 0 AS scored,
  CASE WHEN count(*) FILTER (WHERE y = 1) > 0 AND count(*) FILTER (WHERE y = 0) > 0 THEN TRUE END AS areas_agree
FROM (VALUES ('original'), ('clean'), ('redact'), ('improve')) t(v) LEFT JOIN d ON TRUE GROUP BY v""",
})
ORACLE.update({
    "streamed_answers": f"""
WITH u AS (SELECT part, variable, value FROM ({_UPDATES_LONG}) WHERE starts_with(variable, 'answer.') AND NOT suffix(variable, '_comment')),
a AS (SELECT part, variable, CASE WHEN value IS NULL AND {_h('retry', 'part', 'variable')} % 3 <> 0 THEN 'retry: ' || variable ELSE value END AS value FROM u)
SELECT part, variable, value, CASE WHEN value IS NULL THEN 'open' ELSE 'answered' END AS status FROM a""",
    "text_folder_roundtrip": """
SELECT 'documents' AS folder, source AS model, CAST(doc_id AS VARCHAR) AS name, md5(text) AS text_md5, length(text) AS n_chars FROM documents
UNION ALL SELECT 'turns', role, CAST(conv_id AS VARCHAR), md5(arg_max(text, turn)), length(arg_max(text, turn)) FROM conversations GROUP BY role, conv_id""",
    "subword_roundtrip": "SELECT doc_id, md5(text) AS text_md5, length(text) AS n_chars FROM documents",
    "bootstrap_accuracy": f"""
WITH l AS (SELECT source, doc_id, quality = toxic AS hit FROM labels JOIN documents USING (doc_id)),
idx AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS j, count(*) OVER (PARTITION BY source) AS n FROM l),
d AS (SELECT source, it, ({_h(17, 'source', 'it', 'j')}) % n AS pick FROM idx CROSS JOIN range(50) t(it))
SELECT d.source, CAST(it AS INTEGER) AS iter, round(avg(CAST(hit AS DOUBLE)), 9) AS accuracy
FROM d JOIN idx ON idx.source = d.source AND idx.j = d.pick GROUP BY ALL""",
    "sketched_scores": """
SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS n_users, TRUE AS users_within, TRUE AS q25_within, TRUE AS q50_within, TRUE AS q75_within
FROM events GROUP BY event_type""",
    "retried_answers": f"""
WITH u AS (SELECT part || '/' || variable AS variable, value FROM ({_UPDATES_LONG}) WHERE starts_with(variable, 'answer.') AND NOT suffix(variable, '_comment'))
SELECT variable, CASE WHEN value IS NULL OR value = '' THEN 'again: ' || variable ELSE value END AS value FROM u""",
    "first_documents": "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 10",
    "renamed_columns": "SELECT doc_id AS text_name, lang AS answer_lang, n_chars AS answer_size FROM documents",
    "answer_columns": "SELECT lang, n_chars FROM documents",
    "shuffled_documents": f"SELECT doc_id, row_number() OVER (ORDER BY {_h(29, 'doc_id')}, doc_id) - 1 AS position FROM documents",
    "csv_chunks_roundtrip": "SELECT conv_id, turn, md5(text) AS text_md5 FROM conversations",
})
for _name, _kind in (("learn_prompts", "learn"), ("adjust_prompts", "adjust_tailored")):
    ORACLE[_name] = f"""
WITH s AS (SELECT x.persona, x.doc_id, x.decision, doc.text, row_number() OVER (PARTITION BY x.persona ORDER BY {_h(23, 'x.doc_id')}, x.doc_id) AS r
           FROM ({_DECISIONS_TEXT}) x JOIN documents doc USING (doc_id)),
i AS (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY doc_id) - 1 AS i FROM s WHERE r <= 6),
h AS (SELECT persona, i // 3 AS block, string_agg(text || {_q(chr(10) + "Decision: ")} || decision || {_q(chr(10) + "------" + chr(10))}, '' ORDER BY doc_id) AS history FROM i GROUP BY ALL),
p AS (SELECT d.doc_id, h.persona, h.block,
        split_part({_q(_KINDS[_kind])}, '<PERSONA>', 1) || h.persona || split_part(split_part({_q(_KINDS[_kind])}, '<PERSONA>', 2), '<HISTORY>', 1) || h.history
        || split_part(split_part({_q(_KINDS[_kind])}, '<HISTORY>', 2), '<TEXT>', 1) || d.text || split_part({_q(_KINDS[_kind])}, '<TEXT>', 2) AS prompt
      FROM documents d CROSS JOIN h WHERE d.text IS NOT NULL)
SELECT sha256(concat_ws('|', '{_kind}', CAST(doc_id AS VARCHAR), persona, 'model')) AS prompt_id, CAST(doc_id AS VARCHAR) AS text_name, persona AS agent,
  CAST(block AS BIGINT) AS block, md5(prompt) AS prompt_md5, length(prompt) AS n_chars FROM p"""
