"""The queries that SQL can express, in DuckDB's SQL."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# Words and windows as in the contract; a document's window is hit where it equals one of an item.
ORACLES["op7_decontamination"] = r"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), item AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), place AS (
    SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, (len(w) - least(13, len(w)) + 2)::BIGINT)) AS i
    FROM item WHERE len(w) > 0
), win AS (
    SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS words FROM place
), sizes AS (
    SELECT DISTINCT size FROM win
), start AS (
    SELECT doc_id, w, size, unnest(range(1, (len(w) - size + 2)::BIGINT)) AS i FROM doc JOIN sizes ON len(w) >= size
), hit AS (
    SELECT s.doc_id, s.i, s.size, win.item_id
    FROM (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS words FROM start) s
    JOIN win ON win.size = s.size AND win.words = s.words
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hit)) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

# Integer division rounds down, as nothing is negative.
ORACLES["op13_ranked_search"] = r"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
    FROM documents
), item AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), size AS (
    SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM doc WHERE len(t) > 0
), posting AS (
    SELECT doc_id, term, len_t AS n, count(*) AS tf
    FROM (SELECT doc_id, len(t) AS len_t, unnest(t) AS term FROM doc) GROUP BY ALL
), weight AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM posting, size GROUP BY term, n_docs
), scored AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM posting JOIN weight USING (term) JOIN item USING (term), size GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 10
"""
