"""SQL for the operators whose whole result SQL can say. DuckDB's dialect."""

from __future__ import annotations

import string

from . import decontamination, quality, vector_codes as codes

_SPACE_WORD, _WORD = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = f"translate({{0}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_words = lambda c: f"regexp_extract_all({_LOWER.format(c)}, '{_WORD}')"

DECONTAMINATION = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_words("text")}, []) AS ws FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, ws, least({decontamination.WINDOW}, len(ws)) AS n FROM (SELECT item_id, {_words("text")} AS ws FROM benchmark) WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS line FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM items)),
places AS (SELECT rid, n, i, array_to_string(ws[i:i + n - 1], ' ') AS line FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows))),
hits AS (SELECT rid, p.n, i, item_id FROM places p JOIN windows w ON p.line = w.line AND p.n = w.n),
hit_words AS (SELECT rid, count(DISTINCT word) AS n_hit FROM (SELECT rid, i + unnest(range(n)) AS word FROM hits) GROUP BY rid),
hit_items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)"""

_low, _high = quality.MEAN_WORD
QUALITY = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '{_SPACE_WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SPACE_WORD}')) AS lines FROM docs),
grams AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM words)),
twice AS (SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (SELECT rid, count(DISTINCT word) AS n_repeat_words FROM (SELECT rid, i + unnest(range(3)) AS word FROM twice) GROUP BY rid),
figures AS (SELECT rid, doc_id, t, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines FROM words),
judged AS (SELECT *, coalesce(n_repeat_words, 0) AS r, n_words < {quality.MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed FROM figures LEFT JOIN covered USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, r AS n_repeat_words, base_failed,
    NOT base_failed AND n_words <= {quality.MAX_WORDS} AND n_symbols <= {quality.MAX_SYMBOLS} * n_words AND n_dup_lines <= {quality.MAX_DUP_LINES} * n_lines AND word_chars BETWEEN {_low} * n_words AND {_high} * n_words
    AND len(regexp_extract_all(t, '[A-Z]')) <= {quality.MAX_UPPER} * len(regexp_extract_all(t, '[A-Za-z]'))
    AND len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]*\\pL[^\\x20\\x09-\\x0D]*')) >= {quality.MIN_ALPHA} * n_words AS kept
FROM judged"""


def vector_codes(width: int = 4) -> str:
    """For vectors of codes.PARTS * width numbers."""
    cuts = ", ".join(f"x[{width} * p + {k + 1}] AS q{k}" for k in range(width))
    q, v = [f"q{k}" for k in range(width)], [f"v{k}" for k in range(width)]
    far = " + ".join(f"(q{k} - v{k}) * (q{k} - v{k})" for k in range(width))
    steps = [
        "kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS rid, * FROM (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(list_filter(embedding, lambda c: NOT coalesce(isfinite(c), false))) = 0))",
        f"parts AS MATERIALIZED (SELECT rid, p, {cuts} FROM kept, (SELECT unnest(range({codes.PARTS})) AS p))",
        f"book0 AS MATERIALIZED (SELECT p, rid AS entry, {', '.join(f'{a} AS {b}' for a, b in zip(q, v))} FROM parts WHERE rid < {codes.ENTRIES})",
    ]
    for k in range(codes.ROUNDS + 1):
        steps.append(f"at{k} AS MATERIALIZED (SELECT rid, p, {', '.join(f'any_value({c}) AS {c}' for c in q)}, arg_min(entry, far * {codes.ENTRIES} + entry) AS entry, min(far) AS far FROM (SELECT *, {far} AS far FROM parts JOIN book{k} USING (p)) GROUP BY rid, p)")
        if k < codes.ROUNDS:
            mean = ", ".join(f"CAST(floor(CAST(sum({c}) AS DOUBLE) / count(*)) AS BIGINT) AS m{n}" for n, c in enumerate(q))
            steps.append(f"mean{k} AS (SELECT p, entry, {mean} FROM at{k} GROUP BY p, entry)")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT p, entry, {', '.join(f'coalesce(m{n}, v{n}) AS v{n}' for n in range(width))} FROM book{k} LEFT JOIN mean{k} USING (p, entry))")
    last = codes.ROUNDS
    steps.append(f"hash AS (SELECT sha256(string_agg(concat_ws(',', {', '.join(v)}), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM book{last})")
    steps.append(f"coded AS (SELECT rid, string_agg(format('{{:02x}}', entry), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM at{last} GROUP BY rid)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (rid), hash"
