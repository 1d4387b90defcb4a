"""Queries of the training-data operators, and SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sessionloom.frames import table
from sessionloom.llm import conversations, leaks, mojibake, neardup, pii, secrets, splitting, tokens

Query = Callable[[SparkSession, str], DataFrame]


def _on(fn: Callable[..., DataFrame], *names: str, **options) -> Query:
    return lambda spark, root: fn(*(table(spark, root, n) for n in names), **options)


def _keyed(fn: Callable[..., DataFrame], *names: str) -> Query:
    """With the key of the surrogates, a setting of the session (the default is for tests)."""
    return lambda spark, root: fn(*(table(spark, root, n) for n in names), key=spark.conf.get("sessionloom.surrogate.key", "no secret").encode())


def queries() -> dict[str, Query]:
    return {
        "p1_found": _on(conversations.broken, "session_lines"),
        "p1_conversations": _on(conversations.turns, "session_lines"),
        "p2_found": _keyed(pii.found, "drafts", "tokenised_entries"),
        "p2_redacted": _on(pii.redacted, "drafts", "tokenised_entries"),
        "p2_surrogates": _keyed(pii.redacted, "drafts", "tokenised_entries"),
        "p4_found": _on(secrets.found, "drafts", "tokenised_entries"),
        "p4_redacted": _on(secrets.redacted, "drafts", "tokenised_entries"),
        "p5_found": _on(splitting.oversized, "session_lines", "prepared_sessions"),
        "p5_pieces": _on(splitting.pieces, "session_lines", "prepared_sessions"),
        "p6_found": _on(neardup.similar_pairs, "drafts", "entries"),
        "p6_groups": _on(neardup.groups, "drafts", "entries"),
        "p7_ids": _on(tokens.encode, "documents"),
        "p8_found": _on(leaks.leaked, "documents", "eval_items"),
        "p8_passages": _on(leaks.passages, "documents", "eval_items", edits=2),
        "p9_found": _on(mojibake.garbled, "documents"),
        "p9_restored": _on(mojibake.restored, "documents"),
    }


_L = "l AS (SELECT DISTINCT session_id, line_no, type, payload FROM session_lines WHERE session_id IS NOT NULL)"
_P1 = f"""WITH {_L},
s AS (SELECT session_id, line_no, type, CASE WHEN json_valid(payload) THEN payload END AS payload FROM l),
r AS (SELECT *, lower(trim(CASE WHEN json_type(payload, '$.role') = 'VARCHAR' THEN json_extract_string(payload, '$.role') END, ' ' || chr(9) || chr(10) || chr(13))) AS role FROM s),
v AS (SELECT *, (type IN ('user', 'assistant') OR (type = 'response_item' AND json_extract_string(payload, '$.type') = 'message')) AND role IN ('user', 'assistant') AND (
 (json_type(payload, '$.content') = 'VARCHAR' AND regexp_matches(json_extract_string(payload, '$.content'), '[^\\s]'))
 OR len(list_filter(CASE WHEN json_type(payload, '$.content') = 'ARRAY' THEN CAST(json_extract(payload, '$.content') AS JSON[]) END, lambda x: json_type(x) = 'OBJECT' AND json_type(x, '$.text') = 'VARCHAR' AND regexp_matches(json_extract_string(x, '$.text'), '[^\\s]'))) > 0) AS speaks FROM r)
SELECT session_id FROM v GROUP BY 1 HAVING NOT coalesce(count(DISTINCT line_no) FILTER (line_no >= 1) = max(line_no) AND bool_and(payload IS NOT NULL) AND bool_or(coalesce(speaks, false))
 AND arg_min(role, line_no) FILTER (speaks) = 'user' AND arg_max(role, line_no) FILTER (speaks) = 'assistant', false)"""
_P5 = f"""WITH {_L}, j AS (SELECT session_id, line_no, payload FROM l WHERE strlen(payload) > 4000 AND json_valid(payload)),
p AS (SELECT session_id, line_no, 0 AS part, json_extract_string(payload, '$.content') AS txt FROM j WHERE json_type(payload, '$.content') = 'VARCHAR'
 UNION ALL SELECT session_id, line_no, i, json_extract_string(c[i + 1], '$.text') FROM (SELECT session_id, line_no, c, unnest(range(len(c))) AS i FROM (SELECT session_id, line_no, CAST(json_extract(payload, '$.content') AS JSON[]) AS c FROM j WHERE json_type(payload, '$.content') = 'ARRAY')) WHERE json_type(c[i + 1]) = 'OBJECT' AND json_type(c[i + 1], '$.text') = 'VARCHAR')
SELECT DISTINCT 'content' AS item_kind, session_id || '/' || line_no || '/' || part AS item_key FROM p WHERE strlen(txt) > 4000
UNION ALL SELECT DISTINCT 'transcript', extractor_path FROM prepared_sessions WHERE strlen(transcript) > 16000"""


def _grams(name: str, keys: str, size: int, text: str, of: str) -> str:
    """All runs of `size` words, joined by blanks."""
    words = f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"{name} AS (SELECT {keys}, unnest(list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i : i + {size - 1}], ' '))) AS g FROM (SELECT {keys}, {words} AS w FROM {of}) WHERE len(w) >= {size})"


_P8 = f"WITH {_grams('i', 'item_id', 13, 'text', 'eval_items')}, {_grams('d', 'doc_id', 13, 'text', 'documents')} SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)"
_P6 = """WITH x AS (SELECT DISTINCT 'drafts' AS src, draft_id AS key, quote AS txt FROM drafts UNION ALL SELECT DISTINCT 'entries', id, body FROM entries),
""" + _grams("n", "src, key", 3, "txt", "x") + """, g AS (SELECT DISTINCT src, key, g FROM n), c AS (SELECT src, key, count(*) AS n FROM g GROUP BY 1, 2),
m AS (SELECT a.src, a.key AS key_a, b.key AS key_b, count(*) AS k FROM g a JOIN g b ON a.src = b.src AND a.g = b.g AND a.key < b.key GROUP BY 1, 2, 3)
SELECT m.src, key_a, key_b FROM m JOIN c p ON p.src = m.src AND p.key = key_a JOIN c q ON q.src = m.src AND q.key = key_b WHERE 10 * k >= 6 * (p.n + q.n - k)"""


_P6_GROUPS = """WITH x AS (SELECT DISTINCT 'drafts' AS src, draft_id AS key, quote AS txt FROM drafts UNION ALL SELECT DISTINCT 'entries', id, body FROM entries),
k AS (SELECT src, txt, min(key) AS class_id, count(*) AS copies FROM x GROUP BY 1, 2),
""" + _grams("n", "src, class_id", 3, "txt", "k") + """, g AS (SELECT DISTINCT src, class_id, g FROM n), c AS (SELECT src, class_id, count(*) AS n FROM g GROUP BY 1, 2),
m AS (SELECT a.src, a.class_id, b.class_id AS other, count(*) AS k FROM g a JOIN g b ON a.src = b.src AND a.g = b.g AND a.class_id <> b.class_id GROUP BY 1, 2, 3),
l AS (SELECT m.src, m.class_id, count(*) AS links FROM m JOIN c p ON p.src = m.src AND p.class_id = m.class_id JOIN c q ON q.src = m.src AND q.class_id = other WHERE 10 * k >= 6 * (p.n + q.n - k) GROUP BY 1, 2)
SELECT x.src, key, k.class_id, copies, coalesce(links, 0) AS links FROM x JOIN k ON k.src = x.src AND k.txt = x.txt JOIN c ON c.src = k.src AND c.class_id = k.class_id LEFT JOIN l ON l.src = k.src AND l.class_id = k.class_id"""
_SPOKEN = _P1[: _P1.index("SELECT session_id FROM v GROUP BY 1")]
_P1_TURNS = _SPOKEN.rstrip() + f""",
bad AS ({_P1[len(_SPOKEN):]}),
t AS (SELECT session_id, line_no, role, CASE WHEN json_type(payload, '$.content') = 'VARCHAR' THEN json_extract_string(payload, '$.content') ELSE array_to_string(list_filter(list_transform(CASE WHEN json_type(payload, '$.content') = 'ARRAY' THEN CAST(json_extract(payload, '$.content') AS JSON[]) END, lambda x: CASE WHEN json_type(x) = 'OBJECT' AND json_type(x, '$.text') = 'VARCHAR' THEN json_extract_string(x, '$.text') END), lambda y: y IS NOT NULL AND regexp_matches(y, '[^\\s]')), chr(10) || chr(10)) END AS txt
 FROM v WHERE speaks AND session_id NOT IN (SELECT session_id FROM bad)),
n AS (SELECT *, CASE WHEN role <> lag(role) OVER (PARTITION BY session_id ORDER BY line_no) THEN 1 ELSE 0 END AS new FROM t),
i AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY line_no) AS turn_no FROM n)
SELECT session_id, CAST(turn_no AS BIGINT) AS turn_no, role, min(line_no) AS first_line, max(line_no) AS last_line, string_agg(txt, chr(10) || chr(10) ORDER BY line_no) AS text FROM i GROUP BY session_id, turn_no, role"""


def oracle_sql() -> dict[str, str]:
    """The exact results, by brute force in SQL; the other operators are tested in tests/llm."""
    return {"p1_found": _P1, "p1_conversations": _P1_TURNS, "p6_groups": _P6_GROUPS, "p5_found": _P5, "p6_found": _P6, "p8_found": _P8}
