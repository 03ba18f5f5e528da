"""DuckDB SQL of the registered queries, written independently of the Spark plans."""

from __future__ import annotations

from voicegrid import fixed_values as fixed
from voicegrid.plans.surface import FIXED_IDF, FIXED_INTERCEPTS, FIXED_TERMS, FIXED_WEIGHTS, SEARCHED

ORACLES: dict[str, str] = {}

# Character classes as RE2 reads them.
S = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
NOT_S = r"[^\s\x0B\x1C-\x1F\x85\p{Z}]+"
W = r"\p{L}\p{N}_"


def clean(column: str) -> str:
    return f"trim(regexp_replace(coalesce({column}, ''), '{S}', ' ', 'g'))"


def fold(column: str) -> str:
    return f"replace(lower({column}), 'ß', 'ss')"


def words(column: str, pattern: str) -> str:
    return f"regexp_extract_all({column}, '{pattern}')"


TOPIC_TEXT = clean(
    f"regexp_replace(regexp_replace(lower(coalesce(review_text, '')), 'https?://{NOT_S}|www\\.{NOT_S}', ' ', 'g'), "
    + r"'[^\p{L}\p{N}_\s\x0B\x1C-\x1F\x85\p{Z}''-]+', ' ', 'g')"
)

FEEDBACK = f"""
feedback AS (
  SELECT printf('review_%06d', d.doc_id) AS review_id, d.doc_id, d.text AS review_text, {clean('d.text')} AS clean_text,
         e.ts AS date,
         CASE WHEN e.value IS NOT NULL THEN CAST(least(5, 1 + floor(e.value / 25)) AS DOUBLE) END AS rating,
         d.lang AS product, e.event_type AS category, d.source AS version,
         CASE WHEN l.toxic = 1 THEN 'Negative' WHEN l.quality = 1 THEN 'Positive' WHEN l.quality = 0 THEN 'Neutral' END
           AS sentiment_label,
         CAST((50 + d.doc_id % 50) / 100.0 AS DOUBLE) AS sentiment_score
  FROM documents d
  LEFT JOIN events e ON e.event_id = d.doc_id * 10
  LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""
LABELLED = FEEDBACK + """,
labelled AS (
  SELECT * REPLACE (coalesce(sentiment_label, CASE WHEN rating >= 4 THEN 'Positive' WHEN rating < 3 THEN 'Negative' ELSE 'Neutral' END)
    AS sentiment_label), product AS topic_label, list_position(['de', 'en', 'es', 'fr'], product) - 1 AS topic_id
  FROM feedback),
gold AS (SELECT * FROM feedback WHERE sentiment_label IS NOT NULL)
"""
RAW = FEEDBACK + """,
raw AS (
  SELECT doc_id,
         CASE WHEN doc_id % 97 = 0 THEN '  ' || chr(9) || ' ' WHEN doc_id % 89 <> 0 THEN review_text END AS message,
         CASE WHEN doc_id % 53 = 0 THEN 'not a date' ELSE strftime(date, '%Y-%m-%d %H:%M:%S') END AS created_at,
         CASE WHEN doc_id % 41 = 0 THEN 'n.a.' ELSE CAST(CAST(rating AS INTEGER) AS VARCHAR) END AS stars,
         CASE WHEN doc_id % 31 = 0 THEN '  ' ELSE ' ' || product || ' ' END AS product_name
  FROM feedback)
"""
# Apostrophes become tokens of their own, then every phrase is a padded substring.
ENRICHED = LABELLED + """,
vocabulary(ord, aspect, pos, term) AS (VALUES
  (1, 'Licensing', 1, 'license'), (2, 'Origin', 2, 'from'), (2, 'Origin', 1, 'from the'), (3, 'Pointer', 2, 'this'),
  (3, 'Pointer', 1, 'of this'), (4, 'Manner', 2, 'with'), (4, 'Manner', 1, 'by the'), (5, 'Suffix', 2, 'keit'),
  (5, 'Suffix', 1, 'mente'), (5, 'Suffix', 3, 'ado'), (6, 'Pronoun', 1, 'elle'), (7, 'Noise', 1, 'rewh')),
prepared AS (
  SELECT review_id, ' ' || trim(regexp_replace(replace(lower(clean_text), '''', ' '' '), '[^a-z0-9'']+', ' ', 'g')) || ' '
    AS phrases FROM labelled),
hits AS (SELECT p.review_id, v.* FROM prepared p JOIN vocabulary v ON contains(p.phrases, ' ' || v.term || ' ')),
found AS (
  SELECT review_id, ord, aspect, string_agg(term, ',' ORDER BY pos) AS terms FROM hits GROUP BY ALL),
mentions AS (
  SELECT l.*, f.aspect, f.ord, f.terms, l.sentiment_label AS aspect_sentiment_label,
         CASE l.sentiment_label WHEN 'Positive' THEN 1.0::DOUBLE WHEN 'Negative' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END
           AS aspect_sentiment_numeric,
         l.sentiment_score AS aspect_confidence
  FROM labelled l JOIN found f USING (review_id)),
per_review AS (
  SELECT l.*, coalesce(a.detected, []) AS detected FROM labelled l LEFT JOIN (
    SELECT review_id, list(aspect ORDER BY ord) AS detected FROM found GROUP BY 1) a USING (review_id))
"""


def summary_select(source: str, total: str) -> str:
    return f"""
  SELECT aspect, count(*) AS mention_count, count(DISTINCT review_id) AS unique_review_count,
         round(count(DISTINCT review_id) / {total}, 6) AS review_coverage,
         round(avg(aspect_sentiment_numeric), 6) AS average_sentiment,
         CASE WHEN neg >= neu AND neg >= pos THEN 'Negative' WHEN neu >= pos THEN 'Neutral' ELSE 'Positive' END
           AS dominant_sentiment,
         pos AS positive_count, neu AS neutral_count, neg AS negative_count,
         round(pos / count(*), 6) AS positive_share, round(neu / count(*), 6) AS neutral_share,
         round(neg / count(*), 6) AS negative_share,
         round(avg(aspect_confidence), 6) AS average_confidence, round(avg(rating), 6) AS average_rating
  FROM (SELECT *, count(*) FILTER (aspect_sentiment_label = 'Positive') OVER w AS pos,
               count(*) FILTER (aspect_sentiment_label = 'Neutral') OVER w AS neu,
               count(*) FILTER (aspect_sentiment_label = 'Negative') OVER w AS neg
        FROM {source} WINDOW w AS (PARTITION BY aspect))
  GROUP BY aspect, pos, neu, neg"""


SUMMARY = ENRICHED + ",\nsummary AS (" + summary_select("mentions", "(SELECT count(*) FROM labelled)") + ")\n"
FACTS = ENRICHED + """,
weekly AS (SELECT *, date_trunc('week', date)::TIMESTAMP AS period FROM per_review),
spoken AS (SELECT *, date_trunc('week', date)::TIMESTAMP AS period FROM mentions),
sentiment_trend AS (
  SELECT period, sentiment_label, count(*) AS review_count,
         count(*) / sum(count(*)) OVER (PARTITION BY period) AS share
  FROM weekly WHERE period IS NOT NULL GROUP BY 1, 2),
topic_trend AS (
  SELECT period, topic_label, count(*) AS review_count, count(*) / sum(count(*)) OVER (PARTITION BY period) AS share
  FROM weekly WHERE period IS NOT NULL GROUP BY 1, 2),
aspect_trend AS (
  SELECT period, aspect, count(*) AS mention_count, count(*) FILTER (sentiment_label = 'Negative') AS negative_count,
         count(*) FILTER (sentiment_label = 'Negative') / count(*) AS negative_share
  FROM spoken WHERE period IS NOT NULL GROUP BY 1, 2),
fastest AS (
  WITH b AS (
    SELECT max(period) AS recent_period,
           max(period) FILTER (period < (SELECT max(period) FROM topic_trend)) AS previous_period FROM topic_trend)
  SELECT t.topic_label, b.previous_period, b.recent_period, coalesce(p.share, 0) AS previous_share,
         coalesce(r.share, 0) AS recent_share, coalesce(r.review_count, 0) AS supporting_count,
         coalesce(r.share, 0) - coalesce(p.share, 0) AS share_change
  FROM b, (SELECT DISTINCT topic_label FROM topic_trend) t
  LEFT JOIN topic_trend p ON p.topic_label = t.topic_label AND p.period = b.previous_period
  LEFT JOIN topic_trend r ON r.topic_label = t.topic_label AND r.period = b.recent_period
  WHERE b.previous_period IS NOT NULL
    AND coalesce(r.review_count, 0) >= (SELECT greatest(2, ceil(count(*) * 0.02)) FROM labelled)
    AND coalesce(r.share, 0) > coalesce(p.share, 0)
  ORDER BY share_change DESC, supporting_count DESC, t.topic_label LIMIT 1),
worse AS (
  WITH b AS (
    SELECT max(period) AS recent_period,
           max(period) FILTER (period < (SELECT max(period) FROM aspect_trend)) AS previous_period FROM aspect_trend)
  SELECT r.aspect, b.previous_period, b.recent_period, p.negative_share AS previous_negative_share,
         r.negative_share AS recent_negative_share, r.mention_count AS supporting_count,
         r.negative_share - p.negative_share AS negative_share_change
  FROM b JOIN aspect_trend r ON r.period = b.recent_period
  JOIN aspect_trend p ON p.period = b.previous_period AND p.aspect = r.aspect
  WHERE r.negative_share > p.negative_share)
"""
EXTREMES = FACTS + ",\nsummary AS (" + summary_select("mentions", "(SELECT count(*) FROM labelled)") + """),
floor AS (SELECT greatest(2, ceil(count(*) * 0.02)) AS least, count(*) AS total FROM labelled),
pain AS (SELECT summary.* FROM summary, floor ORDER BY mention_count >= least DESC, negative_share DESC, negative_count DESC,
         mention_count DESC, aspect LIMIT 1),
strength AS (SELECT summary.* FROM summary, floor ORDER BY mention_count >= least DESC, positive_share DESC,
         positive_count DESC, mention_count DESC, aspect LIMIT 1),
worst AS (SELECT worse.* FROM worse, floor WHERE supporting_count >= least
          ORDER BY negative_share_change DESC, supporting_count DESC, aspect LIMIT 1),
overall AS (
  SELECT count(*) AS total, count(*) FILTER (sentiment_label = 'Positive') AS pos,
         count(*) FILTER (sentiment_label = 'Neutral') AS neu, count(*) FILTER (sentiment_label = 'Negative') AS neg
  FROM labelled),
dominant AS (
  SELECT *, CASE WHEN pos >= neu AND pos >= neg THEN 'Positive' WHEN neu >= neg THEN 'Neutral' ELSE 'Negative' END AS label,
         greatest(pos, neu, neg) AS n FROM overall),
top_topic AS (
  SELECT topic_label, count(*) AS n, count(*) / (SELECT count(*) FROM labelled) AS share
  FROM labelled GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
"""


def add(name: str, prefix: str, body: str) -> None:
    ORACLES[name] = (f"WITH {prefix.strip()}\n" if prefix else "") + body.strip()


# --------------------------------------------------------------- ingestion --
KEPT = RAW + f""",
cleaned AS (SELECT *, {clean('message')} AS clean FROM raw),
kept AS (
  SELECT * FROM cleaned WHERE clean <> ''
  QUALIFY row_number() OVER (PARTITION BY {fold('clean')} ORDER BY doc_id) = 1)
"""
add("canonical_reviews", KEPT, """
SELECT printf('review_%06d', row_number() OVER (ORDER BY doc_id)) AS review_id, md5(message) AS review_md5,
       md5(clean) AS clean_md5, TRY_CAST(created_at AS TIMESTAMP) AS date, TRY_CAST(stars AS DOUBLE) AS rating,
       nullif(trim(product_name), '') AS product FROM kept""")
add("canonical_source_ids", FEEDBACK, f"""
SELECT review_id, md5(clean_text) AS clean_md5, rating FROM feedback WHERE clean_text <> ''
QUALIFY row_number() OVER (PARTITION BY {fold('clean_text')} ORDER BY doc_id) = 1""")
add("ingestion_stats", KEPT, """
SELECT (SELECT count(*) FROM raw) AS input_rows, (SELECT count(*) FROM kept) AS output_rows,
       (SELECT count(*) FROM cleaned WHERE clean = '') AS empty_reviews_removed,
       (SELECT count(*) FROM cleaned WHERE clean <> '') - (SELECT count(*) FROM kept) AS duplicate_reviews_removed""")
add("optional_casts", KEPT, """
SELECT count(*) FILTER (created_at IS NOT NULL AND TRY_CAST(created_at AS TIMESTAMP) IS NULL) AS invalid_dates,
       count(*) FILTER (stars IS NOT NULL AND TRY_CAST(stars AS DOUBLE) IS NULL) AS invalid_ratings FROM kept""")
add("text_column_scores", FEEDBACK, r"""
, long AS (
  SELECT 'review_text' AS col, review_text AS v, 0.9 AS k FROM feedback UNION ALL
  SELECT 'clean_text', clean_text, 0.9 FROM feedback UNION ALL SELECT 'product', product, 0.0 FROM feedback UNION ALL
  SELECT 'category', category, 0.0 FROM feedback UNION ALL SELECT 'version', version, 0.0 FROM feedback),
stripped AS (SELECT col, k, regexp_replace(v, '^[\s\x0B\x1C-\x1F\x85\p{Z}]+|[\s\x0B\x1C-\x1F\x85\p{Z}]+$', '', 'g') AS v FROM long),
measured AS (
  SELECT col, CAST(k AS DOUBLE) AS k, avg(length(v)) FILTER (v <> '') AS len,
         count(*) FILTER (v <> '') / count(*) AS filled,
         count(*) FILTER (regexp_matches(v, '[A-Za-z]')) / count(*) FILTER (v <> '') AS alpha,
         count(DISTINCT v) FILTER (v <> '') / count(*) FILTER (v <> '') AS uniq
  FROM stripped GROUP BY 1, 2)
SELECT col AS "column", round(len, 6) AS average_length, round(filled, 6) AS non_empty_ratio,
       round(alpha, 6) AS alphabetic_ratio, round(uniq, 6) AS unique_ratio, k AS keyword_score,
       round(0.40 * k + 0.25 * least(len / 80.0, 1.0) + 0.15 * filled + 0.10 * alpha + 0.10 * uniq, 6) AS score
FROM measured WHERE alpha >= 0.3 AND len >= CASE WHEN k > 0 THEN 2 ELSE 15 END""")
add("validation_counts", KEPT, """
SELECT (SELECT count(*) FROM raw) AS total_rows, (SELECT count(*) FROM cleaned WHERE clean <> '') AS usable_rows,
       (SELECT count(*) FROM cleaned WHERE clean = '') AS empty_rows,
       (SELECT count(*) FROM cleaned WHERE clean <> '') - (SELECT count(*) FROM kept) AS duplicate_rows""")
add("filled_cells", RAW, """
SELECT count(*) AS total_rows, count(doc_id) AS filled_doc_id, count(message) AS filled_message,
       count(created_at) AS filled_created_at, count(stars) AS filled_stars, count(product_name) AS filled_product_name
FROM raw""")

# -------------------------------------------------------------------- text --
PUNCTUATION = clean("review_text")
PUNCTUATION = f"lower({PUNCTUATION})"
for mark in ("!", r"\?", r"\.", ","):
    PUNCTUATION = f"regexp_replace({PUNCTUATION}, '{mark}{{3,}}', '{mark[-1]}', 'g')"
add("detected_columns", RAW, """
SELECT role, column_name FROM (
  SELECT 'text' AS role, 'message' AS column_name, avg((trim(message, ' ' || chr(9)) <> '')::INT) > 0.5 AS fits FROM raw WHERE message IS NOT NULL
  UNION ALL SELECT 'date', 'created_at', avg((TRY_CAST(created_at AS TIMESTAMP) IS NOT NULL)::INT) >= 0.6 FROM raw WHERE created_at IS NOT NULL
  UNION ALL SELECT 'rating', 'stars', avg((TRY_CAST(stars AS DOUBLE) IS NOT NULL)::INT) >= 0.6 FROM raw WHERE stars IS NOT NULL
  UNION ALL SELECT 'product', 'product_name', avg((trim(product_name) <> '')::INT) >= 0.5 FROM raw WHERE product_name IS NOT NULL)
WHERE fits""")


def times(word: str) -> str:
    return f"(length(t) - length(replace(t, '{word}', ''))) / {len(word)}"


add("sentiment_supplied", "", f"""
SELECT review_id, CASE WHEN a >= b AND a >= c THEN 'Negative' WHEN b >= c THEN 'Neutral' ELSE 'Positive' END AS sentiment_label,
       round(greatest(a, b, c) / (a + b + c), 6) AS sentiment_score
FROM (SELECT review_id, {times("elle")} AS a, 1.0 + {times("from")} AS b, {times("with")} AS c
      FROM (SELECT printf('review_%06d', doc_id) AS review_id, {clean("text")} AS t FROM documents))""")
for name, expression in {
    "clean_classical": PUNCTUATION,
    "clean_transformer": clean("review_text"),
    "clean_topic": TOPIC_TEXT,
    "clean_aspect": "trim(regexp_replace(lower(review_text), '[^a-z0-9'']+', ' ', 'g'))",
    "folded_text": fold(clean("review_text")),
    "topic_tokens": f"array_to_string(regexp_extract_all({TOPIC_TEXT}, '[{W}][{W}''-]*[{W}]'), ' ')",
    "plain_tokens": (
        "array_to_string(list_transform(regexp_extract_all(" + fold("review_text")
        + ", '[A-Za-z][A-Za-z'']+'), lambda w: trim(w, '''')), ' ')"
    ),
}.items():
    add(name, FEEDBACK, f"SELECT doc_id, md5({expression}) AS text_md5 FROM feedback")
add("review_lengths", FEEDBACK, rf"""
SELECT doc_id, len(regexp_extract_all(review_text, '[{W}]+')) AS review_word_count,
       length(regexp_replace(review_text, '^[\s\x0B\x1C-\x1F\x85\p{{Z}}]+|[\s\x0B\x1C-\x1F\x85\p{{Z}}]+$', '', 'g'))
         AS review_character_count FROM feedback""")
add("normalized_labels", LABELLED, """
SELECT sentiment_label AS label,
       CASE sentiment_label WHEN 'Positive' THEN 1.0::DOUBLE WHEN 'Negative' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
       count(*) AS row_count FROM labelled GROUP BY 1, 2""")
add("mapped_labels", "", """
SELECT CASE quality WHEN 1 THEN 'Positive' ELSE 'Negative' END AS label, count(*) AS row_count FROM labels GROUP BY 1""")

# ----------------------------------------------------------------- filters --
DASHBOARD_WHERE = """
 date >= TIMESTAMP '2024-01-03' AND date < TIMESTAMP '2024-01-28' AND product IN ('en', 'fr', 'de')
 AND rating BETWEEN 1 AND 4 AND sentiment_label IN ('Positive', 'Negative') AND topic_label IN ('en', 'fr')
 AND list_has_any(detected, ['Origin', 'Manner', 'Pronoun']) AND contains(lower(review_text), 'a')"""
add("filter_options", FEEDBACK, """
SELECT DISTINCT field, trim(value) AS value FROM (
  SELECT 'product' AS field, product AS value FROM feedback UNION ALL SELECT 'category', category FROM feedback)
WHERE trim(value) <> ''""")
add("option_ranges", FEEDBACK, """
SELECT min(date) AS minimum_date, max(date) AS maximum_date, min(rating) AS minimum_rating, max(rating) AS maximum_rating
FROM feedback""")
add("filtered_reviews", FEEDBACK, """
SELECT review_id, date, rating, product, category FROM feedback
WHERE date >= TIMESTAMP '2024-01-04' AND date < TIMESTAMP '2024-01-26' AND lower(product) IN ('en', 'fr')
  AND lower(category) IN ('click', 'view', 'error') AND rating BETWEEN 1 AND 4 AND contains(lower(review_text), 'the')""")
add("dashboard_options", ENRICHED, """
SELECT DISTINCT field, value,
       CASE WHEN field <> 'sentiment_label' THEN 0 ELSE list_position(['Positive', 'Neutral', 'Negative'], value) - 1 END::BIGINT
         AS display_rank
FROM (SELECT 'product' AS field, product AS value FROM labelled UNION ALL SELECT 'category', category FROM labelled
      UNION ALL SELECT 'sentiment_label', sentiment_label FROM labelled
      UNION ALL SELECT 'topic_label', topic_label FROM labelled UNION ALL SELECT 'aspect', aspect FROM mentions)
WHERE value <> ''""")
add("dashboard_filtered", ENRICHED, f"""
SELECT review_id, sentiment_label, topic_label, rating FROM per_review WHERE {DASHBOARD_WHERE}""")
add("aspect_filtered", ENRICHED, """
SELECT review_id, aspect, aspect_sentiment_label FROM mentions WHERE aspect IN ('Noise', 'Licensing')""")
add("confident_reviews", LABELLED, "SELECT review_id, sentiment_score FROM labelled WHERE sentiment_score >= 0.8")
add("filter_status", ENRICHED, f"""
SELECT count(*) FILTER ({DASHBOARD_WHERE}) AS kept_rows, count(*) AS total_rows,
       round(count(*) FILTER ({DASHBOARD_WHERE}) / count(*), 6) AS retention_share FROM per_review""")
add("column_subset", LABELLED, "SELECT review_id, date, rating, product, sentiment_label FROM labelled")

# -------------------------------------------------------------- statistics --
LENGTHS = FEEDBACK + rf""",
lengths AS (
  SELECT len(regexp_extract_all(review_text, '[{W}]+')) AS words,
         length(regexp_replace(review_text, '^[\s\x0B\x1C-\x1F\x85\p{{Z}}]+|[\s\x0B\x1C-\x1F\x85\p{{Z}}]+$', '', 'g')) AS chars
  FROM feedback)
"""
add("length_stats", LENGTHS, """
SELECT round(avg(words), 6) AS average_words, round(quantile_cont(words, 0.5), 6) AS median_words,
       min(words) AS minimum_words, max(words) AS maximum_words, round(quantile_cont(words, 0.9), 6) AS percentile_90_words,
       round(avg(chars), 6) AS average_characters FROM lengths""")
add("rating_stats", FEEDBACK, """
SELECT count(rating) AS count, round(avg(rating), 6) AS average, quantile_cont(rating, 0.5) AS median,
       min(rating) AS minimum, max(rating) AS maximum FROM feedback""")
add("text_rating_stats", RAW, """
SELECT count(n) AS count, round(avg(n), 6) AS average, quantile_cont(n, 0.5) AS median, min(n) AS minimum, max(n) AS maximum
FROM (SELECT TRY_CAST(stars AS DOUBLE) AS n FROM raw)""")
for name, unit in (("timeline", "day"), ("timeline_weekly", "week")):
    add(name, FEEDBACK, f"""
SELECT date_trunc('{unit}', date)::TIMESTAMP AS period, count(*) AS review_count FROM feedback
WHERE date IS NOT NULL GROUP BY 1""")
ORDERED = "ordered AS (SELECT o_orderdate AS date FROM documents JOIN orders ON o_orderkey = doc_id * 10)"
SPAN = "CASE WHEN d > 730 THEN 'M' WHEN d > 90 THEN 'W' ELSE 'D' END"
add("timeline_inferred", ORDERED + f""",
unit AS (SELECT {SPAN} AS u FROM (
  SELECT floor(epoch(max(date) - min(date)) / 86400) AS d FROM ordered))""", """
SELECT date_trunc(CASE u WHEN 'M' THEN 'month' WHEN 'W' THEN 'week' ELSE 'day' END, date)::TIMESTAMP AS period,
       count(*) AS review_count FROM ordered, unit GROUP BY 1""")
add("time_frequency", FEEDBACK + "," + ORDERED, f"""
SELECT source, {SPAN} AS frequency FROM (
  SELECT 'events' AS source, floor(epoch(max(date) - min(date)) / 86400) AS d FROM feedback
  UNION ALL SELECT 'orders', floor(epoch(max(date) - min(date)) / 86400) FROM ordered)""")
STOP = (
    "a about after again all also am an and any are as at be because been before being but by can could did do does doing "
    "for from had has have having he her here hers him his how i if in into is it its just me more most my no not of on or "
    "our out over same she should so some such than that the their them then there these they this those to too up very "
    "was we were what when where which while who will with would you your"
).split()
add("common_words", FEEDBACK + ",\nwords AS (SELECT trim(unnest(regexp_extract_all(" + fold("clean_text") + ", '[A-Za-z][A-Za-z'']+')), '''') AS term FROM feedback),\nkept AS (SELECT term FROM words WHERE length(term) >= 2 AND term NOT IN ("
    + ", ".join(f"'{w}'" for w in STOP) + "))", """
SELECT term, count(*) AS count, round(count(*) / (SELECT count(*) FROM kept) * 100.0, 6) AS percentage
FROM kept GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def missing_rows(cells: tuple[tuple[str, str, str], ...], source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) FILTER ({x}) AS missing_count,
 round(count(*) FILTER ({x}) / count(*) * 100.0, 6) AS missing_percentage FROM {source}"""
        for c, t, x in cells
    )


RAW_CELLS = (
    ("doc_id", "bigint", "doc_id IS NULL"),
    ("message", "string", clean("message") + " = ''"),
    ("created_at", "string", clean("created_at") + " = ''"),
    ("stars", "string", clean("stars") + " = ''"),
    ("product_name", "string", clean("product_name") + " = ''"),
)
add("missing_summary", RAW, missing_rows(RAW_CELLS, "raw"))
add("missing_ordered", LABELLED, missing_rows(
    (("review_id", "string", "review_id IS NULL"), ("date", "timestamp_ntz", "date IS NULL"),
     ("rating", "double", "rating IS NULL"), ("product", "string", clean("product") + " = ''")), "labelled"))
add("empty_reviews", KEPT, "SELECT count(*) FILTER (clean = '') AS empty_reviews FROM cleaned")
add("duplicate_reviews", KEPT, """
SELECT (SELECT count(*) FROM cleaned WHERE clean <> '') - (SELECT count(*) FROM kept) AS duplicate_reviews""")
ALL_MISSING = " + ".join(f"count(*) FILTER ({x})" for _, _, x in RAW_CELLS)
add("quality_summary", KEPT, f"""
SELECT count(*) AS total_rows, (SELECT count(*) FROM cleaned WHERE clean <> '') - (SELECT count(*) FROM kept) AS duplicate_reviews,
       (SELECT count(*) FROM cleaned WHERE clean = '') AS empty_reviews, {ALL_MISSING} AS missing_cells,
       count(*) * 5 AS total_cells, round(100.0 * (1.0 - ({ALL_MISSING}) / (count(*) * 5)), 6) AS completeness_percentage
FROM raw""")
add("dataset_summary", LENGTHS, f"""
SELECT count(*) AS total_reviews, count(*) FILTER (clean_text <> '') - count(DISTINCT {fold('clean_text')}) FILTER (clean_text <> '')
         AS duplicate_reviews, count(*) FILTER (clean_text = '') AS missing_reviews,
       (SELECT round(avg(words), 6) FROM lengths) AS average_review_length,
       (SELECT round(quantile_cont(words, 0.5), 6) FROM lengths) AS median_review_length,
       round(avg(rating), 6) AS average_rating, min(date) AS minimum_date, max(date) AS maximum_date,
       count(DISTINCT product) AS product_count, count(DISTINCT category) AS category_count FROM feedback""")
add("category_distribution", FEEDBACK, """
SELECT trim(category) AS category, count(*) AS review_count FROM feedback WHERE trim(category) <> '' GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 15""")


def histogram(source: str, value: str, bins: str) -> str:
    return f"""
SELECT bin::BIGINT AS bin, round(low + bin * width, 6) AS lower_bound, round(low + (bin + 1) * width, 6) AS upper_bound,
       count(*) AS review_count
FROM (SELECT low, width, CASE WHEN width = 0 THEN 0 ELSE least(floor((v - low) / width), bins - 1) END AS bin
      FROM (SELECT v, low, bins, (high - low) / bins AS width
            FROM (SELECT CAST({value} AS DOUBLE) AS v FROM {source} WHERE {value} IS NOT NULL),
                 (SELECT CAST(min({value}) AS DOUBLE) AS low, CAST(max({value}) AS DOUBLE) AS high, {bins} AS bins FROM {source})))
GROUP BY bin, low, width"""


add("length_histogram", LENGTHS, histogram("lengths", "words", "30"))
add("rating_histogram", FEEDBACK, histogram("feedback", "rating", "least(20, greatest(5, count(DISTINCT rating)))"))
add("confidence_histogram", LABELLED, histogram("labelled", "sentiment_score", "20"))

# --------------------------------------------------------------- sentiment --
add("labeled_clean", LABELLED, "SELECT DISTINCT md5(clean_text) AS text_md5, sentiment_label FROM gold WHERE clean_text <> ''")
add("label_conflicts", FEEDBACK, """
SELECT md5(clean_text) AS text_md5, count(DISTINCT doc_id % 3) AS label_count FROM feedback WHERE clean_text <> ''
GROUP BY clean_text HAVING count(DISTINCT doc_id % 3) > 1""")
add("class_distribution", LABELLED, "SELECT sentiment_label, count(*) AS row_count FROM gold GROUP BY 1")
add("stratified_split", LABELLED + """,
pairs AS (SELECT DISTINCT clean_text, sentiment_label FROM gold WHERE clean_text <> ''),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sentiment_label ORDER BY md5('42:' || clean_text)) AS place,
                  count(*) OVER (PARTITION BY sentiment_label) AS total FROM pairs)""", """
SELECT md5(clean_text) AS text_md5, sentiment_label,
       CASE WHEN place <= floor(total * 0.70 + 0.5) THEN 'train' WHEN place <= floor(total * 0.85 + 0.5) THEN 'validation'
            ELSE 'test' END AS split FROM ranked""")
PREDICTIONS = LABELLED + """,
predictions AS (
  SELECT 'documents' AS dataset, review_text, rating, sentiment_label AS actual,
         CASE WHEN rating >= 4 THEN 'Positive' WHEN rating = 3 THEN 'Neutral' ELSE 'Negative' END AS predicted FROM gold),
names(label) AS (VALUES ('Negative'), ('Neutral'), ('Positive'))
"""


def report(source: str) -> str:
    return f"""
SELECT dataset, label, support, hits, CASE WHEN claimed = 0 THEN 0 ELSE hits / claimed END AS p,
       CASE WHEN support = 0 THEN 0 ELSE hits / support END AS r
FROM (SELECT d.dataset, n.label,
             count(*) FILTER (actual = n.label) AS support, count(*) FILTER (predicted = n.label) AS claimed,
             count(*) FILTER (actual = n.label AND predicted = n.label) AS hits
      FROM {source} d, names n GROUP BY 1, 2)"""


F1 = "CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END"
OVERALL = f"""
sum(hits) / sum(support) AS accuracy, avg(p) AS precision_macro, avg(r) AS recall_macro, avg({F1}) AS macro_f1,
sum({F1} * support) / sum(support) AS weighted_f1"""
add("confusion_matrix", PREDICTIONS, """
SELECT a.label AS actual, b.label AS predicted, count(x.actual) AS row_count
FROM names a CROSS JOIN names b LEFT JOIN predictions x ON x.actual = a.label AND x.predicted = b.label GROUP BY 1, 2""")
add("class_report", PREDICTIONS, f"""
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, support, hits, round({F1}, 6) AS f1_score
FROM ({report('predictions')})""")


def rounded(columns: str) -> str:
    names = ("accuracy", "precision_macro", "recall_macro", "macro_f1", "weighted_f1")
    return columns + ", ".join(f"round({n}, 6) AS {n}" for n in names)


add("overall_metrics", PREDICTIONS, f"SELECT {rounded('')} FROM (SELECT {OVERALL} FROM ({report('predictions')}))")
add("dataset_comparison", PREDICTIONS + """,
both_sets AS (
  SELECT dataset, actual, predicted FROM predictions UNION ALL
  SELECT 'conversations', ['Negative', 'Neutral', 'Positive'][conv_id % 3 + 1], ['Negative', 'Neutral', 'Positive'][turn % 3 + 1]
  FROM conversations)""", f"""
SELECT {rounded('dataset, ')} FROM (SELECT dataset, {OVERALL} FROM ({report('both_sets')}) GROUP BY 1)""")
TITLES = (
    ("accuracy", "Accuracy"), ("precision_macro", "Precision (macro)"), ("recall_macro", "Recall (macro)"),
    ("macro_f1", "Macro F1"), ("weighted_f1", "Weighted F1"), (None, "Inference time (s)"), (None, "Samples / second"),
    (None, "Training time (s)"), (None, "Model size (bytes)"),
)
add("model_comparison", PREDICTIONS + f""",
constant AS (SELECT dataset, actual, 'Positive' AS predicted FROM predictions),
a AS (SELECT {OVERALL} FROM ({report('predictions')})), b AS (SELECT {OVERALL} FROM ({report('constant')}))""",
    " UNION ALL ".join(
        f"SELECT '{title}' AS metric, "
        + (f"round(a.{key}, 6) AS rating_rule, round(b.{key}, 6) AS always_positive FROM a, b" if key
           else "NULL::DOUBLE AS rating_rule, NULL::DOUBLE AS always_positive")
        for key, title in TITLES))
add("error_slices", PREDICTIONS + rf""",
judged AS (
  SELECT (actual = predicted)::INT AS ok,
         CASE WHEN len(regexp_extract_all(review_text, '[{W}]+')) <= 200 THEN 'short text' ELSE 'long text' END AS length_slice,
         CASE WHEN rating IS NULL THEN 'no rating'
              WHEN CASE WHEN rating >= 4 THEN 'Positive' WHEN rating >= 3 THEN 'Neutral' ELSE 'Negative' END = predicted
              THEN 'rating agrees' ELSE 'rating disagrees' END AS rating_slice FROM predictions)""", """
SELECT slice, count(*) AS row_count, sum(ok)::BIGINT AS correct_count, round(avg(ok), 6) AS accuracy
FROM (SELECT length_slice AS slice, ok FROM judged UNION ALL SELECT rating_slice, ok FROM judged) GROUP BY 1""")
add("sentiment_distribution", PREDICTIONS, """
SELECT label AS sentiment_label, count(sentiment_label) AS review_count FROM names LEFT JOIN labelled ON sentiment_label = label GROUP BY 1""")
add("sentiment_by_month", LABELLED, """
SELECT date_trunc('month', date)::TIMESTAMP AS period, sentiment_label, count(*) AS review_count FROM labelled
WHERE date IS NOT NULL GROUP BY 1, 2""")
add("label_representatives", LABELLED, """
SELECT sentiment_label, row_number() OVER (PARTITION BY sentiment_label ORDER BY sentiment_score DESC, review_id) AS rank,
       review_id, sentiment_score FROM labelled QUALIFY rank <= 3""")
add("sentiment_headline", LABELLED, """
SELECT count(*) AS review_count, round(avg(sentiment_score), 6) AS average_confidence,
       round(avg((sentiment_label = 'Negative')::INT), 6) AS negative_share, count(DISTINCT topic_label) AS topic_count
FROM labelled""")
add("mean_confidence", LABELLED, "SELECT round(avg(sentiment_score), 6) AS mean_confidence FROM labelled")

# ------------------------------------------------------------------ topics --
CORPUS = FEEDBACK + f""",
texts AS (SELECT doc_id, {TOPIC_TEXT} AS topic_text FROM feedback),
corpus AS (
  SELECT * FROM texts WHERE topic_text <> '' QUALIFY row_number() OVER (PARTITION BY topic_text ORDER BY doc_id) = 1)
"""
ALL_TERMS = CORPUS + rf""",
tokens AS (
  SELECT doc_id, list_filter(regexp_extract_all(topic_text, '[{W}]{{2,}}'),
         lambda w: w NOT IN ('the', 'of', 'and', 'de', 'la', 'der', 'die', 'en', 'es', 'le')) AS t FROM corpus),
terms AS (
  SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term
  FROM tokens),
counts AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
size AS (SELECT count(*) AS n FROM corpus),
vocabulary AS (
  SELECT term, sum(tf)::BIGINT AS corpus_count, count(*) AS document_count,
         ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1.0 AS idf
  FROM counts, size GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.95 * any_value(n)
  )
"""
add("topic_corpus", CORPUS, "SELECT doc_id, md5(topic_text) AS topic_md5 FROM corpus")
add("corpus_stats", CORPUS, """
SELECT (SELECT count(*) FROM texts) AS source_rows, (SELECT count(*) FROM corpus) AS modeled_rows,
       (SELECT count(*) FROM texts WHERE topic_text = '') AS empty_rows_removed,
       (SELECT count(*) FROM texts WHERE topic_text <> '') - (SELECT count(*) FROM corpus) AS duplicate_rows_removed""")
add("term_statistics", ALL_TERMS, "SELECT term, corpus_count, document_count, round(idf, 6) AS idf FROM vocabulary")
add("tfidf_weights", ALL_TERMS + """,
weighed AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM counts JOIN vocabulary USING (term))""", """
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM weighed""")
add("term_numbers", ALL_TERMS, "SELECT term, row_number() OVER (ORDER BY term) - 1 AS number FROM vocabulary")
KEYWORD_TABLE = FEEDBACK + rf""",
kw AS (
  SELECT topic_id, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, term) AS rank, term, weight
  FROM (SELECT product AS topic_id, term, count(*)::DOUBLE AS weight
        FROM (SELECT product, unnest(regexp_extract_all(clean_text, '[{W}]{{2,}}')) AS term FROM feedback) GROUP BY 1, 2)
  QUALIFY rank <= 8)
"""
add("topic_keywords", KEYWORD_TABLE, "SELECT * FROM kw")
add("topic_diversity", KEYWORD_TABLE, "SELECT round(count(DISTINCT term) / count(*), 6) AS topic_diversity FROM kw")
KEYWORD_NAMES = """,
topic_names(topic_id, topic_label, top_keywords) AS (VALUES
  (0, 'de', 'on, er, th, license, from'), (1, 'en', 'le, les, des, et, du'), (2, 'es', 'und, das, von, den, zu'),
  (3, 'fr', 'el, los, que, las, del'))
"""


def topic_summary(source: str) -> str:
    return f"""
SELECT n.topic_id::BIGINT AS topic_id, n.topic_label, n.top_keywords, count(*) AS review_count,
       round(count(*) / (SELECT count(*) FROM {source}), 6) AS percentage,
       round(avg(CASE sentiment_label WHEN 'Positive' THEN 1 WHEN 'Negative' THEN -1 ELSE 0 END), 6) AS average_sentiment,
       CASE WHEN count(*) FILTER (sentiment_label = 'Negative') >= greatest(count(*) FILTER (sentiment_label = 'Neutral'),
                 count(*) FILTER (sentiment_label = 'Positive')) THEN 'Negative'
            WHEN count(*) FILTER (sentiment_label = 'Neutral') >= count(*) FILTER (sentiment_label = 'Positive') THEN 'Neutral'
            ELSE 'Positive' END AS dominant_sentiment
FROM {source} s JOIN topic_names n ON n.topic_id = s.topic_id GROUP BY ALL"""


add("topic_summary", LABELLED + KEYWORD_NAMES, topic_summary("labelled"))
add("topic_filtered_summary", ENRICHED + KEYWORD_NAMES + f""",
chosen AS (SELECT * FROM per_review WHERE {DASHBOARD_WHERE})""", topic_summary("chosen"))
add("topic_keyword_table", LABELLED + KEYWORD_NAMES, f"""
SELECT topic_id, topic_label, top_keywords, review_count FROM ({topic_summary('labelled')})""")
add("topic_size_extremes", LABELLED, """
SELECT (SELECT topic_label FROM labelled GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS largest_topic,
       max(n) AS largest_count,
       (SELECT topic_label FROM labelled GROUP BY 1 ORDER BY count(*), 1 LIMIT 1) AS smallest_topic, min(n) AS smallest_count
FROM (SELECT count(*) AS n FROM labelled GROUP BY topic_label)""")
add("topic_sentiment", LABELLED, """
SELECT topic_label, sentiment_label, count(*) AS review_count FROM labelled GROUP BY 1, 2""")
add("topic_profile", LABELLED, """
SELECT topic_label, sentiment_label, count(*) AS review_count FROM labelled WHERE topic_label = 'fr' GROUP BY 1, 2""")
add("topic_representatives", LABELLED, """
SELECT topic_id::BIGINT AS topic_id, string_agg(review_id, '|' ORDER BY rank) AS representative_review_ids
FROM (SELECT topic_id, review_id, row_number() OVER (PARTITION BY topic_id ORDER BY sentiment_score DESC, review_id) AS rank
      FROM labelled) WHERE rank <= 5 GROUP BY 1""")
add("topic_examples", LABELLED, """
SELECT review_id, topic_label, sentiment_label FROM labelled WHERE topic_label = 'de' AND review_id IN (
  SELECT review_id FROM labelled QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY sentiment_score DESC, review_id) <= 5)""")
add("assignment_coverage", FEEDBACK, """
SELECT round(avg((coalesce(rating, 0) > 1)::INT), 6) AS assignment_coverage FROM feedback""")
PRESENCE = FEEDBACK + rf""",
padded AS (
  SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(clean_text), '[{W}]{{2,}}'), ' ') || ' ' AS p FROM feedback),
kw(topic_id, pos, term) AS (VALUES
  (0, 1, 'on'), (0, 2, 'er'), (0, 3, 'th'), (0, 4, 'license'), (0, 5, 'from'), (1, 1, 'le'), (1, 2, 'les'), (1, 3, 'des'),
  (1, 4, 'et'), (1, 5, 'du'), (2, 1, 'und'), (2, 2, 'das'), (2, 3, 'von'), (2, 4, 'den'), (2, 5, 'zu'), (3, 1, 'el'),
  (3, 2, 'los'), (3, 3, 'que'), (3, 4, 'las'), (3, 5, 'del')),
seen AS (SELECT doc_id, topic_id, pos, term FROM padded JOIN kw ON contains(p, ' ' || term || ' ')),
single AS (SELECT topic_id, term, count(*) AS n FROM seen GROUP BY 1, 2),
pairs AS (
  SELECT a.topic_id, a.term AS left_term, b.term AS right_term, sa.n AS nl, sb.n AS nr,
         (SELECT count(*) FROM seen x JOIN seen y USING (doc_id, topic_id)
          WHERE x.topic_id = a.topic_id AND x.term = a.term AND y.term = b.term) AS nb
  FROM kw a JOIN kw b ON a.topic_id = b.topic_id AND a.pos < b.pos
  JOIN single sa ON sa.topic_id = a.topic_id AND sa.term = a.term
  JOIN single sb ON sb.topic_id = b.topic_id AND sb.term = b.term),
scored AS (
  SELECT topic_id, left_term, right_term,
         CASE WHEN nb = 0 THEN -1 WHEN nb >= n THEN 1
              ELSE ln((nb / n) / ((nl / n) * (nr / n))) / -ln(nb / n) END AS npmi
  FROM pairs, (SELECT count(*)::DOUBLE AS n FROM padded))
"""
add("topic_npmi", PRESENCE, "SELECT topic_id::BIGINT AS topic_id, left_term, right_term, round(npmi, 6) AS npmi FROM scored")
add("topic_coherence", PRESENCE, "SELECT round(avg(npmi), 6) AS topic_coherence_npmi FROM scored")
add("topic_coverage", PRESENCE, """
SELECT round((SELECT count(DISTINCT doc_id) FROM seen) / count(*), 6) AS topic_coverage FROM padded""")

# ----------------------------------------------------------------- aspects --
add("aspect_reviews", ENRICHED, """
SELECT l.review_id, coalesce(string_agg(aspect, '|' ORDER BY ord), '') AS detected_aspects,
       coalesce(string_agg(aspect || ':' || sentiment_label, ';' ORDER BY aspect), '') AS aspect_sentiment,
       coalesce(string_agg(aspect || ':' || terms, ';' ORDER BY aspect), '') AS matched_terms
FROM labelled l LEFT JOIN found f USING (review_id) GROUP BY 1""")
add("aspect_mentions", ENRICHED, """
SELECT review_id, aspect, aspect_sentiment_label, aspect_sentiment_numeric, aspect_confidence, product, rating FROM mentions""")
add("aspect_summary", SUMMARY, "SELECT * FROM summary")
add("aspect_evaluation", ENRICHED, """
SELECT count(*) AS total_reviews, count(*) FILTER (len(detected) > 0) AS reviews_with_aspects,
       round(count(*) FILTER (len(detected) > 0) / count(*), 6) AS aspect_coverage,
       (SELECT count(*) FROM mentions) AS total_aspect_mentions,
       (SELECT count(DISTINCT aspect) FROM mentions) AS unique_aspects,
       count(*) FILTER (len(detected) > 1) AS multi_aspect_reviews,
       round(count(*) FILTER (len(detected) > 1) / count(*), 6) AS multi_aspect_review_share,
       true AS sentiment_association_complete, true AS manual_review_required,
       'No gold labels for aspects exist here: a person has to judge whether aspects are found rightly and are of use.'
         AS manual_review_note FROM per_review""")
add("aspect_sentiment_counts", ENRICHED, """
SELECT aspect, aspect_sentiment_label, count(*) AS mention_count FROM mentions GROUP BY 1, 2""")
add("aspect_posneg", SUMMARY, """
SELECT aspect, 'Positive' AS sentiment, positive_count AS mention_count FROM summary
UNION ALL SELECT aspect, 'Negative', negative_count FROM summary""")
add("aspect_ratings", SUMMARY, """
SELECT aspect, average_rating, mention_count FROM summary WHERE average_rating IS NOT NULL""")
add("aspect_rating_extremes", SUMMARY, """
SELECT (SELECT aspect FROM summary WHERE average_rating IS NOT NULL ORDER BY average_rating DESC, mention_count DESC LIMIT 1)
         AS highest_rated_aspect, max(average_rating) AS highest_rating,
       (SELECT aspect FROM summary WHERE average_rating IS NOT NULL ORDER BY average_rating, mention_count LIMIT 1)
         AS lowest_rated_aspect, min(average_rating) AS lowest_rating FROM summary""")
add("aspect_leaders", SUMMARY, """
SELECT (SELECT aspect FROM summary ORDER BY mention_count DESC, aspect LIMIT 1) AS most_discussed,
       (SELECT aspect FROM summary ORDER BY positive_share DESC, mention_count DESC, aspect LIMIT 1) AS most_positive,
       (SELECT aspect FROM summary ORDER BY negative_share DESC, mention_count DESC, aspect LIMIT 1) AS most_negative""")
add("aspect_topics", ENRICHED, """
SELECT topic_label, count(*) AS mention_count FROM mentions WHERE aspect = 'Manner' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
add("aspect_examples", ENRICHED, """
SELECT review_id, aspect_sentiment_label, topic_label FROM mentions WHERE aspect = 'Noise' ORDER BY review_id""")
add("aspect_filtered_summary", ENRICHED + f""",
kept AS (SELECT * FROM per_review WHERE {DASHBOARD_WHERE}),
chosen AS (SELECT m.* FROM mentions m SEMI JOIN kept USING (review_id) WHERE aspect IN ('Origin', 'Manner', 'Pronoun'))""",
    summary_select("chosen", "(SELECT count(*) FROM kept)"))

# ------------------------------------------------------------------ trends --
add("trend_bounds", LABELLED, f"""
SELECT first_date, last_date, {SPAN} AS frequency FROM (
  SELECT min(date) AS first_date, max(date) AS last_date, floor(epoch(max(date) - min(date)) / 86400) AS d FROM labelled)""")
add("review_volume", FACTS, "SELECT period, count(*) AS review_count FROM weekly WHERE period IS NOT NULL GROUP BY 1")
add("sentiment_trend", FACTS, "SELECT period, sentiment_label, review_count, round(share, 6) AS share FROM sentiment_trend")
add("topic_trend", FACTS, "SELECT period, topic_label, review_count, round(share, 6) AS share FROM topic_trend")
add("aspect_trend", FACTS, """
SELECT period, aspect, mention_count, negative_count, round(negative_share, 6) AS negative_share FROM aspect_trend""")
add("fastest_topic", FACTS, """
SELECT topic_label, previous_period, recent_period, round(previous_share, 6) AS previous_share,
       round(recent_share, 6) AS recent_share, supporting_count, round(share_change, 6) AS share_change FROM fastest""")
add("worsening_aspect", FACTS, """
SELECT aspect, previous_period, recent_period, round(previous_negative_share, 6) AS previous_negative_share,
       round(recent_negative_share, 6) AS recent_negative_share, supporting_count,
       round(negative_share_change, 6) AS negative_share_change
FROM worse ORDER BY worse.negative_share_change DESC, worse.supporting_count DESC, aspect LIMIT 1""")
add("sentiment_change", FACTS + """,
two AS (SELECT DISTINCT period FROM sentiment_trend ORDER BY 1 DESC LIMIT 2),
edge AS (SELECT min(period) AS previous_period, max(period) AS recent_period FROM two),
rated AS (
  SELECT previous_period, recent_period,
         coalesce((SELECT share FROM sentiment_trend WHERE period = previous_period AND sentiment_label = 'Negative'), 0) AS a,
         coalesce((SELECT share FROM sentiment_trend WHERE period = recent_period AND sentiment_label = 'Negative'), 0) AS b
  FROM edge)""", """
SELECT previous_period, recent_period, round(a, 6) AS previous_negative_share, round(b, 6) AS recent_negative_share,
       round(b - a, 6) AS negative_share_change FROM rated""")
add("evidence_floor", LABELLED, """
SELECT count(*) AS total_reviews, greatest(2, ceil(count(*) * 0.02))::BIGINT AS evidence_floor FROM labelled""")

# ---------------------------------------------------------------- insights --
add("overall_sentiment", EXTREMES, """
SELECT total AS total_reviews, pos AS positive_count, neu AS neutral_count, neg AS negative_count,
       round(pos / total, 6) AS positive_share, round(neu / total, 6) AS neutral_share, round(neg / total, 6) AS negative_share,
       label AS dominant_sentiment FROM dominant""")
add("topic_ranking", LABELLED + KEYWORD_NAMES, f"""
SELECT topic_label, review_count, percentage AS share, average_sentiment, dominant_sentiment,
       (SELECT round(avg((sentiment_label = 'Negative')::INT), 6) FROM labelled l WHERE l.topic_label = s.topic_label) AS negative_share,
       (SELECT round(avg((sentiment_label = 'Positive')::INT), 6) FROM labelled l WHERE l.topic_label = s.topic_label) AS positive_share
FROM ({topic_summary('labelled')}) s""")
add("aspect_extremes", EXTREMES, """
SELECT aspect, mention_count, positive_share, negative_share, average_sentiment, 'positive' AS side FROM strength
UNION ALL SELECT aspect, mention_count, positive_share, negative_share, average_sentiment, 'negative' FROM pain""")
for name, by in (("product_comparison", "product"), ("category_comparison", "category")):
    add(name, LABELLED, f"""
SELECT {by}, count(*) AS review_count, round(avg((sentiment_label = 'Positive')::INT), 6) AS positive_share,
       round(avg((sentiment_label = 'Neutral')::INT), 6) AS neutral_share,
       round(avg((sentiment_label = 'Negative')::INT), 6) AS negative_share, round(avg(rating), 6) AS average_rating
FROM labelled WHERE {by} IS NOT NULL GROUP BY 1""")
FIRST_IDS = "(SELECT string_agg(review_id, '|' ORDER BY doc_id) FROM (SELECT review_id, doc_id FROM {source} WHERE {test} ORDER BY doc_id LIMIT 3))"


def first_ids(source: str, test: str) -> str:
    return FIRST_IDS.format(source=source, test=test)


add("evidence_ids", ENRICHED, f"""
SELECT 'Noise' AS tag, {first_ids('mentions', "aspect = 'Noise'")} AS review_ids
UNION ALL SELECT 'Pronoun', {first_ids('mentions', "aspect = 'Pronoun'")}
UNION ALL SELECT 'topic de', {first_ids('labelled', "topic_label = 'de'")}""")
add("insight_metrics", EXTREMES, """
SELECT total AS total_reviews, pos AS positive_count, neu AS neutral_count, neg AS negative_count, label AS dominant_sentiment,
       (SELECT count(DISTINCT topic_label) FROM labelled) AS topic_count,
       (SELECT count(DISTINCT aspect) FROM mentions) AS aspect_count,
       (SELECT round(avg((len(detected) > 0)::INT), 6) FROM per_review) AS aspect_coverage,
       (SELECT count(DISTINCT topic_label) FROM labelled) AS topic_summary_rows,
       (SELECT count(*) FROM summary) AS aspect_summary_rows,
       (SELECT topic_label FROM top_topic) AS most_discussed_topic, (SELECT aspect FROM strength) AS key_strength,
       (SELECT aspect FROM pain) AS priority_improvement FROM dominant""")

FINDINGS = f"""
findings AS (
SELECT 'Overall sentiment' AS category, 'Overall feedback is ' || lower(label) AS title,
       format('{{:,}}', n) || ' of ' || format('{{:,}}', total) || ' reviews (' || printf('%.1f%%', n / total * 100) || ') are ' || lower(label) || '.' AS evidence,
       'These shares describe all feedback; topics and aspects show where it comes from.' AS business_interpretation,
       label || ' review share' AS metric_name, round(n / total, 6) AS metric_value, n AS supporting_count,
       NULL AS affected_item, '' AS representative_review_ids FROM dominant
UNION ALL
SELECT 'Topic', 'Most discussion centers on "' || topic_label || '"',
       format('{{:,}}', n) || ' reviews (' || printf('%.1f%%', share * 100) || ') belong to this topic.',
       'More reviews speak of this topic than of any other, so reading may begin here.',
       'Topic review share', round(share, 6), n, topic_label, {first_ids('labelled', 'topic_label = (SELECT topic_label FROM top_topic)')} FROM top_topic
UNION ALL
SELECT 'Pain point', 'Negative feedback is concentrated around "' || aspect || '"',
       printf('%.1f%%', negative_count / mention_count * 100) || ' of ' || format('{{:,}}', mention_count) || ' observed aspect mentions are negative.',
       'Read these reviews first: they show what goes wrong and how often.',
       'Negative aspect share', negative_share, mention_count, aspect, {first_ids('mentions', 'aspect = (SELECT aspect FROM pain)')} FROM pain
UNION ALL
SELECT 'Strength', 'Positive feedback is strongest around "' || aspect || '"',
       printf('%.1f%%', positive_count / mention_count * 100) || ' of ' || format('{{:,}}', mention_count) || ' observed aspect mentions are positive.',
       'Customers like this; keep it in mind when other things change.',
       'Positive aspect share', positive_share, mention_count, aspect, {first_ids('mentions', 'aspect = (SELECT aspect FROM strength)')} FROM strength
UNION ALL
SELECT 'Trend', '"' || topic_label || '" gained share in the latest period',
       'Topic share changed by ' || printf('%.1f', share_change * 100) || ' percentage points, with ' || format('{{:,}}', supporting_count) || ' reviews in the latest period.',
       'Watch the next periods: a larger share says what people write about, not why.',
       'Topic share change', round(share_change, 6), supporting_count, topic_label, {first_ids('labelled', 'topic_label = (SELECT topic_label FROM fastest)')} FROM fastest)
"""
add("findings", EXTREMES + "," + FINDINGS, "SELECT * FROM findings")
add("filtered_insights",
    EXTREMES.replace("  FROM feedback),\ngold", "  FROM feedback WHERE product IN ('fr', 'de', 'es')),\ngold")
    + "," + FINDINGS,
    "SELECT category, evidence, metric_value, supporting_count, affected_item, representative_review_ids FROM findings")
add("recommendations", EXTREMES + f""",
first_two AS (
  SELECT CASE WHEN negative_count / mention_count >= 0.6 AND mention_count >= 3 THEN 'High'
              WHEN negative_count / mention_count >= 0.4 THEN 'Medium' ELSE 'Low' END AS priority,
         'Investigate ' || aspect || ' feedback' AS title, 'Aspect' AS affected_type, aspect AS affected_item,
         'Negative mention share' AS supporting_metric, negative_share AS supporting_value, mention_count AS supporting_count,
         printf('%.1f%%', negative_count / mention_count * 100) || ' of ' || format('{{:,}}', mention_count) || ' observed mentions for "' || aspect || '" are negative. Find out from the reviews listed what they have in common, and mend that first.' AS explanation,
         {first_ids('mentions', 'aspect = (SELECT aspect FROM pain)')} AS representative_review_ids FROM pain
  UNION ALL
  SELECT 'Low', 'Protect the ' || aspect || ' strength', 'Aspect', aspect, 'Positive mention share', positive_share, mention_count,
         printf('%.1f%%', positive_count / mention_count * 100) || ' of ' || format('{{:,}}', mention_count) || ' observed mentions for "' || aspect || '" are positive. Leave as it is what these reviews praise.',
         {first_ids('mentions', 'aspect = (SELECT aspect FROM strength)')} FROM strength)""", """
SELECT * FROM first_two
UNION ALL
SELECT CASE WHEN negative_share_change >= 0.2 AND supporting_count >= 3 THEN 'High' ELSE 'Medium' END,
       'Monitor worsening ' || aspect || ' feedback', 'Aspect', aspect, 'Recent negative-share change',
       round(negative_share_change, 6), supporting_count,
       'Negative share for "' || aspect || '" rose by ' || printf('%.1f', negative_share_change * 100) || ' percentage points between the two latest periods. Look at what changed in between, and at the next period.',
       '' FROM worst WHERE aspect NOT IN (SELECT affected_item FROM first_two WHERE priority = 'High')""")
add("executive_summary", EXTREMES, """
SELECT concat_ws(' ',
  (SELECT 'Analyzed ' || format('{:,}', total) || ' reviews. Overall sentiment is ' || label || ', with ' || printf('%.1f%%', pos / total * 100) || ' positive, ' || printf('%.1f%%', neu / total * 100) || ' neutral, and ' || printf('%.1f%%', neg / total * 100) || ' negative feedback.' FROM dominant),
  (SELECT 'The most discussed topic is "' || topic_label || '" (' || format('{:,}', n) || ' reviews; ' || printf('%.1f%%', share * 100) || ' of the dataset).' FROM top_topic),
  (SELECT 'The largest current pain point is "' || aspect || '": ' || printf('%.1f%%', negative_count / mention_count * 100) || ' of its ' || format('{:,}', mention_count) || ' mentions are negative.' FROM pain),
  (SELECT 'A notable strength is "' || aspect || '": ' || printf('%.1f%%', positive_count / mention_count * 100) || ' of its ' || format('{:,}', mention_count) || ' mentions are positive.' FROM strength),
  (SELECT 'Recently, negative share for "' || aspect || '" increased by ' || printf('%.1f', negative_share_change * 100) || ' percentage points from one period to the next.' FROM worst)
) AS executive_summary""")

# ----------------------------------------------------------------- streams --
DATED = "(SELECT * FROM {source} WHERE date IS NOT NULL)"
add("stream_enriched", ENRICHED, """
SELECT aspect, aspect_sentiment_label, count(*) AS mention_count FROM mentions GROUP BY 1, 2""")
add("stream_sentiment_windows", FACTS, """
SELECT period, sentiment_label, count(*) AS review_count FROM weekly WHERE period IS NOT NULL GROUP BY 1, 2""")
add("stream_aspect_windows", FACTS, "SELECT period, aspect, mention_count, negative_count FROM aspect_trend")
add("stream_distinct", LABELLED, f"""
SELECT count(DISTINCT {fold('clean_text')}) AS distinct_reviews FROM {DATED.format(source='labelled')}""")
add("stream_closed_windows", FACTS, """
SELECT period, sentiment_label, count(*) AS review_count FROM weekly
WHERE period + INTERVAL 7 DAY <= (SELECT max(date) FROM weekly) - INTERVAL 2 DAY GROUP BY 1, 2""")
add("stream_earliest", LABELLED, f"""
SELECT review_id, date FROM (
  SELECT review_id, date FROM labelled WHERE date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {fold('clean_text')} ORDER BY date, review_id) = 1)
WHERE date <= (SELECT max(date) FROM labelled) - INTERVAL 2 DAY""")
for _name, _same in (("volume", "review_volume"), ("topic_trend", "topic_trend"), ("aspect_trend", "aspect_trend"), ("summary", "aspect_summary")):
    ORACLES[f"incremental_{_name}"] = ORACLES[_same]
_CELL = "CASE WHEN {0} IS NULL THEN '-' ELSE length({0}) || ':' || {0} END"
_LANE = "list_reduce(list_transform(string_split(substr(h, {0}, 8), ''), lambda c: strpos('0123456789abcdef', c) - 1), lambda a, b: a * 16 + b)"
add("dataset_fingerprint", LABELLED + f""",
hashed AS (SELECT sha256({_CELL.format('review_text')} || {_CELL.format('sentiment_label')}) AS h FROM labelled)""", f"""
SELECT sha256(concat_ws('|', 'review_text,sentiment_label', count(*), {", ".join(f"sum({_LANE.format(8 * k + 1)}::HUGEINT)" for k in range(8))})) AS fingerprint,
  count(*) AS row_count FROM hashed""")

# ------------------------------------------------------- files and reports --
add("csv_round_trip", FEEDBACK, "SELECT doc_id, md5(review_text) AS text_md5, product, rating FROM feedback")
add("csv_failures", "", """
SELECT * FROM (VALUES ('too_many_rows', 'RowLimitError'), ('header_only', 'EmptyCsvError'), ('surplus_fields', 'CsvParseError'),
  ('other_suffix', 'UnsupportedFileError'), ('absent', 'CsvLoadError')) AS t(fault, error)""")
add("recommendations_csv", "", f"""
SELECT priority, title, supporting_count::BIGINT AS supporting_count, replace(representative_review_ids, '|', ', ') AS review_ids
FROM ({ORACLES['recommendations']})""")
add("markdown_report", "", f"""
SELECT n AS findings, (SELECT count(*) FROM ({ORACLES['recommendations']})) AS recommendations, n AS evidence_lines
FROM (SELECT count(*) AS n FROM ({ORACLES['findings']}))""")
ORACLES["metrics_round_trip"] = ORACLES["overall_metrics"]
ORACLES["prediction_round_trip"] = ORACLES["confusion_matrix"]
add("saved_sentiment", "", "SELECT count(*) AS reviews, 0::BIGINT AS changed, 0::BIGINT AS out_of_range FROM documents")
add("saved_topics", CORPUS, "SELECT count(*) AS texts, 0::BIGINT AS changed, 0::BIGINT AS out_of_range FROM corpus")
add("unaccented_text", "", """
SELECT doc_id, md5(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')) AS text_md5 FROM documents""")
_FIXED = ", ".join(
    f"('{term}', {idf}::DOUBLE, {', '.join(f'{row[k]}::DOUBLE' for row in FIXED_WEIGHTS)})"
    for k, (term, idf) in enumerate(zip(FIXED_TERMS, FIXED_IDF))
)
add("fixed_sentiment", FEEDBACK + rf""",
model(term, idf, m0, m1, m2) AS (VALUES {_FIXED}),
tokens AS (
  SELECT review_id, regexp_extract_all(translate(lower(clean_text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'),
    '[{W}]{{2,}}') AS t FROM feedback),
terms AS (
  SELECT review_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM tokens),
cells AS (
  SELECT review_id, (1 + ln(count(*))) * any_value(idf) AS w, any_value(m0) AS m0, any_value(m1) AS m1, any_value(m2) AS m2
  FROM terms JOIN model USING (term) GROUP BY review_id, term),
sums AS (
  SELECT review_id, sum(w * m0) / sqrt(sum(w * w)) AS m0, sum(w * m1) / sqrt(sum(w * w)) AS m1, sum(w * m2) / sqrt(sum(w * w)) AS m2
  FROM cells GROUP BY 1),
odds AS (
  SELECT review_id, exp(coalesce(m0, 0) + {FIXED_INTERCEPTS[0]}) AS a, exp(coalesce(m1, 0) + {FIXED_INTERCEPTS[1]}) AS b,
    exp(coalesce(m2, 0) + {FIXED_INTERCEPTS[2]}) AS c FROM feedback LEFT JOIN sums USING (review_id))""", """
SELECT review_id, CASE WHEN a >= b AND a >= c THEN 'Negative' WHEN b >= c THEN 'Neutral' ELSE 'Positive' END AS sentiment_label,
  round(greatest(a, b, c) / (a + b + c), 6) AS sentiment_score FROM odds""")
add("validation_report", RAW + f""",
counted AS (SELECT count(*) FILTER ({clean('message')} = '') AS blank, count(*) AS n,
  count(DISTINCT {fold(clean('message'))}) FILTER ({clean('message')} <> '') AS texts FROM raw)""", """
SELECT 'empty_reviews_removed' AS code, 'warning' AS severity, false AS passed FROM counted WHERE blank > 0
UNION ALL SELECT 'duplicate_reviews_removed', 'warning', false FROM counted WHERE n - blank > texts
UNION ALL SELECT 'duplicate_column_mapping', 'error', false
UNION ALL SELECT 'mapped_column_missing', 'error', false""")
add("header_names", "", """
SELECT ' Kundén-Review ' || source || '!' AS header, 'kunden_review_' || lower(source) AS name, 0.9::DOUBLE AS score
FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)
UNION ALL SELECT source || ' Amount', lower(source) || '_amount', 0.0::DOUBLE FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)""")
add("loose_filters", FEEDBACK, """
SELECT review_id, product FROM feedback
WHERE date >= '2024-01-04' AND date < '2024-01-26' AND lower(product) IN ('en', 'fr') AND contains(lower(review_text), 'the')""")
add("indexed_search", FEEDBACK + f""",
words(keyword) AS (VALUES {", ".join(f"('{word}')" for word in SEARCHED)})""", """
SELECT keyword, review_id FROM words JOIN feedback ON contains(lower(review_text), lower(keyword))""")
add("topic_names", KEYWORD_TABLE + """,
firsts AS (SELECT topic_id, term FROM kw WHERE rank = 1),
seconds AS (
  SELECT k.topic_id, k.term FROM kw k JOIN firsts f USING (topic_id) WHERE lower(k.term) <> lower(f.term)
  QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY k.rank) = 1)""", """
SELECT topic_id AS language, upper(f.term[1]) || lower(f.term[2:]) || coalesce(' / ' || upper(s.term[1]) || lower(s.term[2:]), '') AS label
FROM firsts f LEFT JOIN seconds s USING (topic_id)""")
add("keyword_overlap", FEEDBACK + rf""",
kw AS (
  SELECT product, term FROM (
    SELECT product, term, count(*) AS n FROM (SELECT product, unnest(regexp_extract_all(lower(clean_text), '[{W}]{{2,}}')) AS term FROM feedback) GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY product ORDER BY n DESC, term) <= 20),
sets AS (SELECT product, list(term) AS terms FROM kw GROUP BY 1)""", """
SELECT x.product AS a, y.product AS b,
  round(len(list_intersect(x.terms, y.terms)) / len(list_distinct(list_concat(x.terms, y.terms))), 6) AS overlap
FROM sets x JOIN sets y ON x.product < y.product""")
add("trend_gate", LABELLED, """
SELECT * FROM (VALUES ('no_column', false, 'no_column'), ('no_dates', false, 'no_dates'), ('one_date', false, 'one_date')) AS t(dates, available, reason)
UNION ALL SELECT 'all', date_trunc('week', min(date)) <> date_trunc('week', max(date)),
  CASE WHEN date_trunc('week', min(date)) = date_trunc('week', max(date)) THEN 'one_period' ELSE '' END FROM labelled
UNION ALL SELECT 'one_week', date_trunc('week', min(date)) <> date_trunc('week', max(date)),
  CASE WHEN min(date) = max(date) THEN 'one_date' WHEN date_trunc('week', min(date)) = date_trunc('week', max(date)) THEN 'one_period' ELSE '' END
FROM labelled WHERE date < (SELECT min(date) FROM labelled) + INTERVAL 20 HOUR""")
_PHRASES = [(aspect, term) for aspect, terms in fixed.DEFAULT_ASPECTS.items() for term in terms]
_QUOTED = [tuple("'" + name.replace("'", "''") + "'" for name in pair) for pair in _PHRASES]
add("default_aspects", LABELLED + f""",
vocabulary(aspect, term) AS (VALUES {", ".join(f"({aspect}, {term})" for aspect, term in _QUOTED)}),
prepared AS (
  SELECT review_id, sentiment_label, ' ' || trim(regexp_replace(replace(lower(clean_text || '. The ' ||
    upper([{", ".join(term for _, term in _QUOTED)}][doc_id % {len(_PHRASES)} + 1]) || '!'), '''', ' '' '), '[^a-z0-9'']+', ' ', 'g')) || ' ' AS phrases
  FROM labelled),
hits AS (SELECT DISTINCT review_id, sentiment_label, aspect FROM prepared JOIN vocabulary ON contains(phrases, ' ' || term || ' '))""", """
SELECT aspect, sentiment_label AS aspect_sentiment_label, count(*) AS mention_count FROM hits GROUP BY 1, 2""")
