"""SQL of the queries that SQL can express."""

from __future__ import annotations

from .quality_rules import RULES, STOP_WORDS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _failed() -> str:
    parts = []
    for name, measure, low, high in RULES:
        value = measure if " / " not in measure else "coalesce({} / nullif({}, 0), 0)".format(*measure.split(" / "))
        tests = [f"{value} < {low}"] * (low is not None) + [f"{value} > {high}"] * (high is not None)
        parts.append(f"CASE WHEN {' OR '.join(tests)} THEN '{name}' END")
    return f"concat_ws(',', {', '.join(parts)})"


QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
             CAST(len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) AS BIGINT) AS n_stop_words,
             CAST(len(list_filter(w, lambda x: regexp_matches(x, '^\p{{Lu}}{{2}}') AND x = upper(x))) AS BIGINT) AS n_upper_words, CAST(len(l) AS BIGINT) AS n_lines
      FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_failed()} AS failed_rules FROM m)
SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM f"""

NGRAM_JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 4, 1) + 1 END)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 80 * (x.n + y.n - p.c)),
r AS (SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(root) FROM r WHERE r.id = d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id"""


def _edit(state: str, cost: str, edit: str, line: str | None = None) -> str:
    lines = f"list_append({state}.l, {line})" if line else f"{state}.l"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'l': {lines}}} END"


def _least(*states: str) -> str:
    return f"list_sort(list_filter([{', '.join(states)}], lambda x: x IS NOT NULL))[1]"


def _step(*froms: str, letter: str, name: str) -> list[str]:
    """Keeping the row, or giving it another role, from the given states."""
    kept = [f"CASE WHEN NOT r.drop AND r.initial = '{letter}' THEN {_edit(b, 'r.more', 'K', 'r.line')} END" for b in froms]
    return kept + [f"CASE WHEN NOT r.drop THEN {_edit(b, '(3 + r.more)', 'R', f'{name!r} || r.text')} END" for b in froms if name]


CONVERSATIONS = rf"""
WITH RECURSIVE k AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS bytes FROM conversations),
f AS (SELECT *, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], bytes), lambda c, b:
    list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))), CAST(4294967295 AS BIGINT)) % 20 AS fault FROM k),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE fault WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS again FROM f),
o AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM d),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM o),
t AS (SELECT conv_id, i, turn, text, role || ':' || text AS line, role[1] AS initial, bare = '' AS blank, bare <> '' AND seen > 1 AS duplicate, bare <> '' AND seen = 1 AND NOT regexp_matches(bare, '[.!?]$') AS truncated FROM s),
p AS (SELECT *, blank OR duplicate AS drop, CASE WHEN truncated THEN 3 ELSE 0 END AS more, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM t),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM p GROUP BY conv_id),
x AS (SELECT conv_id, 0 AS i, {{'c': 0, 'a': '', 'l': CAST([] AS VARCHAR[])}} AS b0, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, l VARCHAR[])) AS b1,
    {{'c': 3, 'a': 'I', 'l': ['user:']}} AS b2, {{'c': 6, 'a': 'II', 'l': ['user:', 'assistant:']}} AS b3 FROM c
  UNION ALL
  SELECT conv_id, i, n0, n1, m2, {_least("p3", _edit("m2", "3", "I", "'assistant:'"))}
  FROM (SELECT *, {_least("p2", _edit("n0", "3", "I", "'user:'"), _edit("n1", "3", "I", "'user:'"), _edit("p3", "3", "I", "'user:'"))} AS m2
    FROM (SELECT x.conv_id, r.i, {_edit("b0", "4", "D")} AS n0, {_least(_edit("b1", "4", "D"), *_step("b0", letter="s", name=""))} AS n1,
        {_least(_edit("b2", "4", "D"), *_step("b0", "b1", "b3", letter="u", name="user:"))} AS p2, {_least(_edit("b3", "4", "D"), *_step("b2", letter="a", name="assistant:"))} AS p3
      FROM x JOIN p r ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND r.i = x.i + 1))),
e AS (SELECT x.conv_id, {_least("b0", "b3")} AS b FROM x JOIN c ON c.conv_id IS NOT DISTINCT FROM x.conv_id AND c.n = x.i)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""

ORACLES = {"op2_quality_rules": QUALITY_RULES, "op6_ngram_jaccard_join": NGRAM_JOIN, "op13_conversations": CONVERSATIONS}
