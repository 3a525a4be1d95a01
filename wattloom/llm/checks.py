"""SQL that checks the queries which SQL can express."""

from __future__ import annotations

from .licenses import CONTAINMENT, TEMPLATES, least_overlap, tokens
from .secrets import ACCESS, ALLOWED, CANDIDATE, COSTS, HEX, LETTERS, LIMITS, MIXED, WIDTH, most_cost

#: Words after lowering A to Z, and a text so lowered.
WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_sql() -> str:
    """Phrases by position; lines against templates pair by pair."""
    rows = ", ".join(
        f"({i}, {quoted(label)}, {quoted(text)}, {least_overlap(len(set(tokens(text))), CONTAINMENT)})"
        for i, (label, text) in enumerate(TEMPLATES))
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, {LOWERED} AS t FROM documents),
worded AS (SELECT r, doc_id, t, regexp_extract_all(t, {WORD}) AS w FROM texts),
phrases AS (SELECT * FROM (VALUES ('mit', ['mit', 'license']), ('apache', ['apache', 'license']), ('gpl', ['general', 'public', 'license'])) AS p(label, words)),
places AS (
    SELECT r, i - 1 AS spot, label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM worded WHERE list_contains(w, 'license')), phrases
    WHERE w[i : i + len(words) - 1] = words),
base AS (SELECT r, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
templates AS (
    SELECT label, need, list_distinct(regexp_extract_all(lower(words), {WORD})) AS tokens
    FROM (VALUES {rows}) AS v(number, label, words, need)),
lines AS (SELECT r, list_distinct(regexp_extract_all(line, {WORD})) AS tokens FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM texts)),
matched AS (SELECT r, label, len(list_intersect(l.tokens, s.tokens)) / len(s.tokens) AS score
    FROM lines l, templates s WHERE len(l.tokens) >= need AND len(list_intersect(l.tokens, s.tokens)) >= need),
named AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM matched UNION SELECT r, label FROM places) GROUP BY r),
best AS (SELECT r, max(score) AS score FROM matched GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM worded LEFT JOIN base USING (r) LEFT JOIN named USING (r) LEFT JOIN best USING (r)
"""


ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGNED = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def _matches(kind: str, pattern: str, number: int) -> str:
    """All matches with their places, from the pieces between them."""
    return f"""SELECT r, s AS start, s + len(m) AS stop, '{kind}' AS kind, {number} AS k, m FROM (
    SELECT r, m[i] AS m, list_sum(list_transform(g[1 : i], lambda x: len(x)))::BIGINT
        + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: len(x))), 0)::BIGINT AS s
    FROM (SELECT r, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT r, regexp_extract_all(t, {quoted(pattern)}) AS m, regexp_split_to_array(t, {quoted(pattern)}) AS g FROM texts) WHERE len(m) > 0))"""


def secret_sql() -> str:
    """Patterns by split and match; windows of candidates counted character by character."""
    costs = f"[{', '.join(map(str, COSTS))}]"
    allowed = " OR ".join(f"regexp_matches(m, {quoted(p)})" for p in ALLOWED)
    words = f"(regexp_matches(m, {quoted(LETTERS)}) AND NOT regexp_matches(m, {quoted(MIXED)}))"
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
assign AS ({_matches('assign', ASSIGN, 0)}),
access AS ({_matches('access', ACCESS, 1)}),
hex AS ({_matches('hex', HEX, 2)}),
base AS (
    SELECT r, start, stop, kind, k FROM assign WHERE len(regexp_extract(m, {quoted(ASSIGNED)}, 1)) >= 6
    UNION ALL SELECT r, start, stop, kind, k FROM access UNION ALL SELECT r, start, stop, kind, k FROM hex),
candidates AS (SELECT r, start, m, regexp_matches(m, '^([0-9a-f]+|[0-9A-F]+)$') AS is_hex
    FROM ({_matches('candidate', CANDIDATE, 0)}) WHERE NOT ({allowed} OR {words})),
windows AS (SELECT r, start, m, is_hex, unnest(range(1, len(m) - {WIDTH} + 2)) AS i FROM candidates),
costs AS (
    SELECT r, start, is_hex, i, sum({costs}[n + 1]) AS cost FROM (
        SELECT r, start, is_hex, i, c, count(*) AS n FROM (
            SELECT r, start, is_hex, i, unnest(string_split(substr(m, i, {WIDTH}), '')) AS c FROM windows)
        GROUP BY ALL)
    GROUP BY ALL),
random AS (
    SELECT r, start + min(i) - 1 AS start, start + max(i) - 1 + {WIDTH} AS stop,
           CASE WHEN is_hex THEN 'entropy_hex' ELSE 'entropy_base64' END AS kind, CASE WHEN is_hex THEN 3 ELSE 4 END AS k
    FROM (SELECT *, start AS first FROM costs) WHERE cost <= CASE WHEN is_hex THEN {most_cost(LIMITS['hex'])} ELSE {most_cost(LIMITS['base64'])} END
    GROUP BY r, start, is_hex),
listed AS (SELECT r, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS base FROM base GROUP BY r),
every AS (SELECT r, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM random) GROUP BY r),
counts AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex FROM base GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN counts USING (r) LEFT JOIN listed USING (r) LEFT JOIN every USING (r)
"""


OVERLAP_SQL = f"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all({LOWERED},
                                      {WORD}) AS w
    FROM documents),
items AS (
    SELECT item_id, regexp_extract_all({LOWERED},
                                       {WORD}) AS w
    FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS phrase
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
places AS (
    SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM texts, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN windows USING (phrase)),
hit AS (
    SELECT doc_id, count(DISTINCT k) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


#: Every document against every item by joins on terms; whole numbers throughout.
SEARCH_SQL = f"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, {WORD}) AS w FROM documents),
sized AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM texts WHERE len(w) > 0),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM sized),
damped AS (SELECT r, doc_id, 100 - 75 + (75 * n * docs) // length AS m FROM sized, whole),
counted AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM texts) GROUP BY ALL),
items AS (
    SELECT row_number() OVER () AS i, item_id, regexp_extract_all({LOWERED}, {WORD}) AS w FROM benchmark),
asked AS (SELECT i, t, count(*)::BIGINT AS times FROM (SELECT i, unnest(w) AS t FROM items) GROUP BY ALL),
weighted AS (
    SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight
    FROM (SELECT t, count(*)::BIGINT AS df FROM counted SEMI JOIN asked USING (t) GROUP BY t), whole),
scored AS (
    SELECT i, r, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM asked JOIN weighted USING (t) JOIN counted USING (t) JOIN damped USING (r) GROUP BY ALL),
best AS (
    SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank
    FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM best JOIN items USING (i) WHERE rank <= 10
"""
