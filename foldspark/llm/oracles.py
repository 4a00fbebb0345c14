"""The operators' results in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

from foldspark.llm import license_scan, line_dedup

SUBSTRING_DEDUP = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w)
), ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM win
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM ranked WHERE n > 1
), word AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM w
), kept AS (
  SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.j) AS kept, count(*) AS n
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.j = word.j WHERE gone.j IS NULL GROUP BY 1
)
SELECT w.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

NGRAM_JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, link.b FROM reach r JOIN link ON link.a = r.other
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, d.component_id FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) d LEFT JOIN n ON n.doc_id = d.doc_id
"""


def license_scan_sql(threshold: float = 0.8) -> str:
    values = ", ".join(f"('{label}', list_distinct(string_split('{text}', ' ')), {license_scan.block_words(text.split())})" for label, text in license_scan.TEMPLATES)
    places = []
    for phrase, label in license_scan.PHRASES.items():
        same = " AND ".join(f"words[i + {j}] = '{word}'" for j, word in enumerate(phrase.split()))
        places.append(f"SELECT doc_id, i - 1 AS i, '{label}' AS label FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w) WHERE {same}")
    pattern = license_scan.WORD
    return rf"""
WITH low AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
  SELECT doc_id, regexp_extract_all(t, '{pattern}') AS words FROM low
), place AS (
  {" UNION ALL ".join(places)}
), template(label, tokens, size) AS (VALUES {values}), able AS (
  SELECT doc_id, label, tokens, size, words FROM w JOIN template ON len(list_intersect(list_distinct(words), tokens)) >= round({threshold} * len(tokens), 9)
), block AS (
  SELECT doc_id, label, tokens, words[i:i + size - 1] AS b FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM able)
), found AS (
  SELECT doc_id, label, len(list_intersect(list_distinct(b), tokens)) / len(tokens) AS share
  FROM block WHERE len(list_intersect(list_distinct(b), tokens)) >= round({threshold} * len(tokens), 9)
), base AS (
  SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM place GROUP BY 1
), own AS (
  SELECT doc_id, max(share) AS share FROM found GROUP BY 1
), every AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM place UNION ALL SELECT doc_id, label FROM found) GROUP BY 1
)
SELECT w.doc_id, len(words) AS n_words, coalesce(base.n, 0) AS n_base, base.a AS first_word, base.z AS last_word, coalesce(base.labels, '') AS base_labels,
  coalesce(every.labels, '') AS labels, CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(own.share, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base ON base.doc_id = w.doc_id LEFT JOIN own ON own.doc_id = w.doc_id LEFT JOIN every ON every.doc_id = w.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": NGRAM_JACCARD, "op2_substring_dedup": SUBSTRING_DEDUP, "op3_line_dedup": line_dedup.SQL, "op7_license_scan": license_scan_sql()}
