"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from quantmill.llm.decontaminate import op1_decontamination
from quantmill.llm.hard_negatives import op11_hard_negatives
from quantmill.llm.license_scan import op4_license_scan
from quantmill.llm.line_dedup import op9_line_dedup
from quantmill.llm.mixing import OP2_SQL, op2_mixing
from quantmill.llm.quality import op7_quality_rules
from quantmill.llm.quality_model import op12_quality_classifier
from quantmill.llm.secrets import op5_secrets
from quantmill.llm.sharding import op8_sharding
from quantmill.llm.simhash import op3_simhash_dedup
from quantmill.llm.suffix_tree import op10_suffix_tree
from quantmill.llm.token_counts import op6_token_counts
from quantmill.llm.whitening import op13_embedding_whitening


def queries() -> dict:
    every = (
        op1_decontamination, op2_mixing, op3_simhash_dedup, op4_license_scan, op5_secrets,
        op6_token_counts, op7_quality_rules, op8_sharding, op9_line_dedup, op10_suffix_tree,
        op11_hard_negatives, op12_quality_classifier, op13_embedding_whitening,
    )
    return {f.__name__: f for f in every}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item, l, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i + l - 1], ' '))) AS g FROM (SELECT item, w, least(len(w), 13) AS l FROM b WHERE len(w) > 0)
), v AS (
  SELECT doc_id, l, unnest(list_transform(range(1, len(w) - l + 2), lambda i: {{'i': i, 'g': array_to_string(w[i:i + l - 1], ' ')}})) AS x FROM d, (SELECT DISTINCT l FROM p)
), h AS (
  SELECT v.doc_id, v.l, v.x.i AS i, p.item FROM v JOIN p ON p.l = v.l AND p.g = v.x.g
), n AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS place FROM h) GROUP BY 1
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, md5(coalesce(text, '')) AS m, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: {'i': i, 'g': array_to_string(w[i:i + 2], ' ')})) AS x FROM d
), r AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS place FROM (SELECT doc_id, x.i AS i, count(*) OVER (PARTITION BY doc_id, x.g) AS k FROM g) WHERE k > 1) GROUP BY 1
), l AS (
  SELECT doc_id, source, m, line FROM (SELECT doc_id, source, m, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), u AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l GROUP BY 1
), c AS (
  SELECT source, m, lower(trim(line, ' ')) AS line, sum(len(line)) AS chars, min(doc_id) AS first FROM l GROUP BY 1, 2, 3
), z AS (
  SELECT source, greatest(count(DISTINCT m) * 0.01, 10) AS most FROM d GROUP BY 1
), b AS (
  SELECT c.source, c.line, min({'first': first, 'm': m}) AS keeper FROM c JOIN z ON c.source IS NOT DISTINCT FROM z.source GROUP BY 1, 2 HAVING count(*) > any_value(most)
), s AS (
  SELECT c.source, c.m, sum(chars) AS line_chars, sum(CASE WHEN b.line IS NOT NULL AND keeper <> {'first': first, 'm': m} THEN chars ELSE 0 END) AS shared_chars
  FROM c LEFT JOIN b ON c.source IS NOT DISTINCT FROM b.source AND c.line = b.line GROUP BY 1, 2
), o AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, (len(t) - len(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
    coalesce(u.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(shared_chars / line_chars, 0.0)::DOUBLE AS shared_share
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN s ON d.source IS NOT DISTINCT FROM s.source AND d.m = s.m
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND shared_share <= 0.7 AND NOT (shared_share > 0.25 AND n_words * (1 - shared_share) < 50) AS kept FROM o
"""
OP11_SQL = """
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INT) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score QUALIFY rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op2_mixing": OP2_SQL, "op7_quality_rules": OP7_SQL, "op11_hard_negatives": OP11_SQL}
