"""DuckDB SQL of the queries that SQL can express."""

WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

SQL: dict[str, str] = {}

SQL["op5_exact_dedup"] = rf"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text,
           sha256(regexp_replace(coalesce(text, ''), '{WHITE}', '', 'g')) AS text_sha256
    FROM documents
), g AS (
    SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place,
           count(*) OVER (PARTITION BY text_sha256) AS group_size
    FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM g
"""

SQL["op6_warc"] = """
WITH t AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
    SELECT page_id, octet_length(encode(html)) AS payload_bytes,
           array_to_string(list_transform(range(8), lambda i: list_aggregate(list_transform(range(4), lambda j:
               substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                      (('0x' || substr(hex, i * 5 + 1, 5))::INT >> (15 - 5 * j)) % 32 + 1, 1)),
               'string_agg', '')), '') AS payload_digest
    FROM t
), f AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

# Links of all pairs that share a shingle, then the least document that each one reaches.
SQL["op1_ngram_jaccard"] = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words
    FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(len(words) - 4), lambda i: array_to_string(words[i + 1:i + 5], ' '))) END AS shingles
    FROM w
), sized AS (SELECT doc_id, len(shingles) AS n FROM s),
e AS (SELECT doc_id, hash(unnest(shingles)) AS h FROM s),
pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT x, y FROM pairs JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y
    WHERE 100 * shared >= 75 * (p.n + q.n - shared)
), both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
    SELECT doc_id, doc_id AS other FROM s
    UNION
    SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON b.x = r.other
)
SELECT sized.doc_id, n::BIGINT AS n_shingles, c.component_id
FROM sized JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) c ON c.doc_id = sized.doc_id
"""

# Scores of all anchors with all rows in whole numbers; positives, then the window of each.
SQL["op11_hard_negatives"] = """
WITH t AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
           list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i]))::BIGINT AS score
    FROM t a JOIN t b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.other_id AS negative_id, positive_score,
       s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 3
"""

# The given pages hold their main text in one article; inline elements part no words, others do.
SQL["op13_html_extraction"] = r"""
WITH a AS (
    SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS inner_html FROM pages
), t AS (
    SELECT page_id, url, regexp_replace(regexp_replace(inner_html, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS plain FROM a
), d AS (
    SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(plain, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'),
                                             '\s+', ' ', 'g')) AS text FROM t
)
SELECT page_id, url, text, length(text) AS n_chars FROM d
"""
