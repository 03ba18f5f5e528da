"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from voicegrid.llm.private_data import AFTER, BASE as PRIVATE_BASE, BEFORE, KINDS, LEAST_ADDED, LOWERED, RAISED, word_pattern
from voicegrid.llm.secret_ledger import BASE, RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = f"""
WITH docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
items AS (SELECT item_id, {WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS phrase
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM items WHERE len(w) > 0)),
places AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, k, n FROM places JOIN windows USING (n, phrase)),
words AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + n)) AS word FROM (SELECT DISTINCT doc_id, k, n FROM hits)) GROUP BY 1),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)"""


def _spans(order: int, rule) -> str:
    """Spans of one rule: a match begins after the pieces and matches before it."""
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{rule.kind}' AS kind, {order} AS place, start, start + length(m[k]) AS stop
  FROM (SELECT doc_id, m, g, k, list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS start
    FROM (SELECT doc_id, p, m, g, unnest(range(1, len(m) + 1)) AS k
      FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}', 0) AS m,
        regexp_extract_all(text, '{pattern}', {rule.group}) AS g FROM documents WHERE regexp_matches(text, '{pattern}'))))
  WHERE length(g[k]) >= {rule.least}"""


_KINDS = ", ".join(f"'{kind}'" for kind in BASE)
_LISTED = "string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, place)"
OP1 = (
    "WITH spans AS ("
    + " UNION ALL ".join(_spans(k, rule) for k, rule in enumerate(RULES))
    + f"""),
found AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in BASE)},
  {_LISTED} FILTER (kind IN ({_KINDS})) AS base, {_LISTED} AS spans FROM spans GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind in BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN found USING (doc_id)"""
)

_CONFIRM = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(value, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(ltrim(x, '0') AS INTEGER), 0) <= 255))",
    "card": """length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
      CASE WHEN i % 2 = 1 THEN digits[-i]::INTEGER ELSE digits[-i]::INTEGER * 2 - CASE WHEN digits[-i]::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0""",
    "phone": "length(digits) BETWEEN 10 AND 15",
    "iban": """length(replace(value, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(array_to_string(
      list_transform(string_split(replace(value, ' ', '')[5:] || value[:4], ''), lambda c: CASE WHEN c >= 'A' THEN (ascii(c) - 55)::VARCHAR ELSE c END), ''), ''),
      lambda d: d::INTEGER)), lambda a, b: (a * 10 + b) % 97) = 1""",
    "social": "NOT regexp_matches(value, '^(?:000|666|9)|-00-|0000$')",
    "national": r"NOT regexp_matches(before, '\+[0-9][ ().0-9-]*$')",
}


def _private(place: int, kind) -> str:
    """Confirmed spans of one kind with their scores in hundredths."""
    score = f"{kind.prior} + CASE WHEN regexp_matches(around, '{word_pattern(kind.raised_by)}') THEN {RAISED} ELSE 0 END"
    score += f" - CASE WHEN regexp_matches(around, '{word_pattern(kind.lowered_by)}') THEN {LOWERED} ELSE 0 END"
    least = 0 if kind.name in PRIVATE_BASE else LEAST_ADDED
    return f"""
  SELECT doc_id, '{kind.name}' AS kind, {place} AS place, start, start + length(value) AS stop, least(100, {score}) AS score
  FROM (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS digits, translate(before || ' ' || after, '{UPPER}', '{LOWER}') AS around
    FROM (SELECT doc_id, list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS start,
        m[k] AS value, right(p[k], {BEFORE}) AS before, left(p[k + 1], {AFTER}) AS after
      FROM (SELECT doc_id, p, m, unnest(range(1, len(m) + 1)) AS k
        FROM (SELECT doc_id, string_split_regex(text, '{kind.plain}') AS p, regexp_extract_all(text, '{kind.plain}', 0) AS m
          FROM documents WHERE regexp_matches(text, '{kind.plain}')))))
  WHERE {_CONFIRM[kind.name]} AND {score} >= {least}"""


_PRIVATE = ", ".join(f"'{kind}'" for kind in PRIVATE_BASE)
OP12 = (
    "WITH spans AS ("
    + " UNION ALL ".join(_private(k, kind) for k, kind in enumerate(KINDS))
    + f"""),
found AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in PRIVATE_BASE)},
  {_LISTED} FILTER (kind IN ({_PRIVATE})) AS base, {_LISTED} AS spans,
  count(*) FILTER (kind NOT IN ({_PRIVATE})) AS n_added, count(*) FILTER (score >= 80) AS n_confident FROM spans GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind in PRIVATE_BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_added, 0)::BIGINT AS n_added, coalesce(n_confident, 0)::BIGINT AS n_confident
FROM documents LEFT JOIN found USING (doc_id)"""
)

OP11 = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY 1),
counted AS (
  SELECT lang, phrase, count(*) AS f
  FROM (SELECT lang, w[k:k + size - 1] AS phrase
    FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM words, range(1, 5) AS sizes(size) WHERE len(w) >= size))
  GROUP BY 1, 2 HAVING count(*) >= 30),
candidates AS (SELECT * FROM counted WHERE len(phrase) > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.f, x.f AS l, y.f AS r, k, (2000000::HUGEINT * c.f // (x.f::HUGEINT + y.f)) AS score
  FROM (SELECT *, unnest(range(1, len(phrase))) AS k FROM candidates) c
  JOIN counted x ON x.lang = c.lang AND x.phrase = c.phrase[:k]
  JOIN counted y ON y.lang = c.lang AND y.phrase = c.phrase[k + 1:]
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1),
held AS (
  SELECT lang, phrase[j:j + size - 1] AS phrase, max(f) AS longer
  FROM (SELECT lang, phrase, f, size, unnest(range(1, len(phrase) - size + 2)) AS j FROM candidates, range(2, 4) AS sizes(size) WHERE len(phrase) > size)
  GROUP BY 1, 2)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, array_to_string(phrase, ' '))::BIGINT AS rank,
    array_to_string(phrase, ' ') AS phrase, f AS a, l, r, score::BIGINT AS score
  FROM cuts LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * f)
JOIN totals USING (lang) WHERE rank <= 2000"""

OP13 = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER best)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER best <= 10"""

ORACLES: dict[str, str] = {
    "op1_blob_ledger": OP1, "op10_positional_decontamination": OP10, "op11_tiled_collocations": OP11,
    "op12_private_spans": OP12, "op13_cover_tree_negatives": OP13,
}
