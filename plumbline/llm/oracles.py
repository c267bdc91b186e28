"""DuckDB SQL for the results of this folder's queries that SQL can express, over the same tables."""

from __future__ import annotations

from plumbline.llm import quality, urlfilter

_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

DECONTAMINATION = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{urlfilter.UPPER}', '{urlfilter.LOWER}'), '{_WORD}') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{urlfilter.UPPER}', '{urlfilter.LOWER}'), '{_WORD}') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows))),
found AS (SELECT rid, i, n, item_id FROM places JOIN windows USING (n, g)),
hits AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM found, range(10) r(k) WHERE k < n GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)
"""

WARC = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT s, min(page_id) AS first FROM d GROUP BY s),
fives AS (
  SELECT d.*, first, list_transform(range(0, 8), lambda k: CAST(list_sum(list_transform(range(1, 6), lambda j: (strpos('0123456789abcdef', substr(s, 5 * k + j, 1)) - 1) * CAST(16 ** (5 - j) AS BIGINT))) AS BIGINT)) AS v
  FROM d JOIN f USING (s))
SELECT page_id, payload_bytes,
  array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> b) & 31 AS INT) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM fives
"""

_BLANKS = "\\x20\\x09-\\x0D"

_MEASURES = {
    "n_words": "len(w)", "n_lines": "len(l)", "n_dup_lines": "len(l) - len(list_distinct(l))",
    "word_chars": "length(array_to_string(w, ''))", "n_repeat_words": "coalesce(n, 0)",
    "n_symbols": "length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g'))",
    "n_bangs": "length(t) - length(replace(t, '!', ''))", "n_upper": "length(t) - length(regexp_replace(t, '\\p{Lu}', '', 'g'))",
}

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[{_BLANKS}]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_BLANKS}]')) AS l
  FROM d),
g AS (SELECT rid, i, list_slice(w, i, i + 4) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM s)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(5) k(k) GROUP BY rid),
m AS (SELECT doc_id, {', '.join(f'CAST({v} AS BIGINT) AS {k}' for k, v in _MEASURES.items())} FROM s LEFT JOIN r USING (rid))
SELECT doc_id, {', '.join(quality.REPORTED)}, base_failed,
  NOT (base_failed OR 100 * n_symbols > 20 * n_words OR 100 * n_bangs > 50 * n_words OR 100 * n_upper > 50 * word_chars
    OR 100 * n_dup_lines > 60 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
"""


def url_filters(rules: list[tuple[str, str, str]]) -> str:
    """The SQL of `urlfilter.judge` with its default limits: rules of one to three tokens by counting, which is what FP-growth counts."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in longest]
    case = lambda values: "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, v in zip(fits, values)) + " END"
    parts = "(?s)^.*?://([^/?#]*)([^?#]*)"
    apart = "[^\\p{L}\\p{N}]+"
    sizes = ((1, "a.token AS x, NULL AS y, NULL AS z", ""), (2, "a.token, b.token, NULL", "b"), (3, "a.token, b.token, c.token", "bc"))
    join = lambda more: " ".join(f"JOIN told {n} ON {n}.rid = a.rid AND {n}.token > {chr(ord(n) - 1)}.token" for n in more)
    counted = " UNION ALL ".join(f"SELECT {names}, count(*) AS n, sum(a.bad) AS bad FROM told a {join(more)} GROUP BY ALL" for _, names, more in sizes)
    return f"""
WITH p AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '{parts}', 1), ''), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host,
    coalesce(regexp_extract(url, '{parts}', 2), '') AS path
  FROM pages),
u AS (SELECT DISTINCT url, host, path FROM p WHERE contains(coalesce(url, ''), '://')),
lists AS (
  SELECT url, list_distinct(list_concat(
    ['s:' || lower(split_part(url, '://', 1))],
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: 'h:' || array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')),
    list_transform(regexp_split_to_array(host, '{apart}'), lambda x: 'w:' || x),
    list_transform(regexp_split_to_array(lower(path), '{apart}'), lambda x: 'p:' || x),
    list_transform(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda q: 'q:' || lower(split_part(q, '=', 1))))) AS tokens
  FROM u),
tokens AS (SELECT url, token FROM (SELECT url, unnest(tokens) AS token FROM lists) WHERE length(token) > 2),
known AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
pages_told AS (SELECT row_number() OVER () AS rid, url, bad FROM p JOIN known ON page_id = doc_id),
told AS (SELECT rid, bad, token FROM pages_told JOIN tokens USING (url)),
total AS (
  SELECT count(*) AS n, sum(bad) AS bad FROM pages_told t
  WHERE bad = 1 OR EXISTS (SELECT 1 FROM tokens k WHERE k.url = t.url)),
counted AS ({counted}),
rules AS (
  SELECT x, y, z FROM counted c, total t
  WHERE c.bad >= greatest({urlfilter.MIN_SUPPORT} * t.n, {urlfilter.MIN_COUNT}) AND c.bad >= {urlfilter.MIN_CONFIDENCE} * c.n
    AND CAST(c.bad AS DOUBLE) / c.n * t.n >= {urlfilter.MIN_LIFT} * t.bad),
blocked AS (
  SELECT DISTINCT a.url FROM rules JOIN tokens a ON a.token = x
    LEFT JOIN tokens b ON b.url = a.url AND b.token = y LEFT JOIN tokens c ON c.url = a.url AND c.token = z
  WHERE (y IS NULL OR b.url IS NOT NULL) AND (z IS NULL OR c.url IS NOT NULL))
SELECT page_id, host, path, {case([h + p for _, h, p in longest])} AS rule,
  coalesce({case([v for v, _, _ in longest])}, CASE WHEN blocked.url IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN blocked ON p.url = blocked.url
"""

FILL_MIDDLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
k AS (SELECT *, list_transform(range(0, 4), lambda g: list_sum(list_transform(range(1, 9), lambda j: (strpos('0123456789abcdef', substr(h, 8 * g + j, 1)) - 1) * CAST(16 ** (8 - j) AS BIGINT)))::BIGINT) AS g FROM d),
c AS (
  SELECT *, least(g[1] % (len(u) + 1), g[2] % (len(u) + 1)) AS i, greatest(g[1] % (len(u) + 1), g[2] % (len(u) + 1)) AS j,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= 100 THEN 'plain' WHEN g[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM k),
p AS (
  SELECT *, coalesce(array_to_string(list_slice(u, 1, i), ''), '') AS a, coalesce(array_to_string(list_slice(u, i + 1, j), ''), '') AS m,
    coalesce(array_to_string(list_slice(u, j + 1, len(u)), ''), '') AS s
  FROM c)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || a || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

# An escaped text has one character more for each backslash, each # after another one and each / after <.
_ESCAPED = "length({0}) + length({0}) - length(replace({0}, '\\', '')) + length({0}) - length(replace({0}, '#', '')) - len(regexp_extract_all({0}, '#+')) + (length({0}) - length(replace({0}, '</', ''))) // 2"
_ROLE = _ESCAPED + " + (length({0}) - length(replace({0}, ': ', ''))) // 2"

CHAT = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, (['user', 'assistant'])[k + 1], '\\### Assistant: </turn> ok' FROM range(2) r(k))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(6 + {_ROLE.format("role")} + {_ESCAPED.format("text")} + 8) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
