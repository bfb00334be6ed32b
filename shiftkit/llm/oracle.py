"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from shiftkit.llm.chat import BODY, CONTROL, END, TURN

SEP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def _escaped(e: str) -> str:
    e = f"replace({e}, '\\', '\\\\')"
    for c in CONTROL:
        e = f"replace({e}, '{c}', '{c[0]}\\{c[1:]}')"
    return e


ORACLE: dict[str, str] = {
    "op6_near_duplicates": f"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i+3], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d
), n AS (
    SELECT doc_id, count(g.g) AS n FROM documents LEFT JOIN g USING (doc_id) GROUP BY doc_id
), c AS (
    SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
    SELECT u, v FROM c JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 80 * (a.n + b.n - k)
), e AS (
    SELECT u, v FROM l UNION ALL SELECT v, u FROM l
), r AS (
    SELECT doc_id, doc_id AS m FROM documents
    UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.m
)
SELECT doc_id, n AS n_shingles, min(m) AS component_id, doc_id = min(m) AS kept FROM r JOIN n USING (doc_id) GROUP BY doc_id, n
""",
    "op7_chat_formatting": f"""
WITH t AS (
    SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum({len(TURN) + len(BODY) + len(END)} + length({_escaped('role')}) + length({_escaped('text')})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
""",
    "op8_containment": """
WITH b AS (
    SELECT item_id, list_filter(string_split_regex(lower(text), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), bk AS (
    SELECT item_id, w, least(5, len(w)) AS k FROM b WHERE len(w) > 0
), bg AS (
    SELECT DISTINCT item_id, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i:i+k-1], ' '))) AS g FROM bk
), n AS (
    SELECT item_id, count(*) AS n_shingles FROM bg GROUP BY item_id
), d AS (
    SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), dg AS (
    SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i:i+k-1], ' '))) AS g
    FROM d, (SELECT DISTINCT k FROM bk)
)
SELECT doc_id, item_id, n_shingles, count(*) AS n_found, CAST(count(*) AS DOUBLE) / n_shingles AS containment
FROM dg JOIN bg USING (g) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) * 5 >= n_shingles * 4
""",
    "op9_line_dedup": f"""
WITH l AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS pos
    FROM documents
), k AS (
    SELECT *, translate(trim(line, {SEP}), {UPPER}, {LOWER}) AS key FROM l
), f AS (
    SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
""",
    "op12_hard_negatives": """
WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
""",
}
