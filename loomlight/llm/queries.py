"""The subpackage's queries and their SQL."""

from __future__ import annotations

from .bpe import op11_bpe
from .embeddings import op2_near_vectors
from .languages import op10_languages
from .licenses import OP9_SQL, op9_licenses
from .mixing import op8_mixing
from .packing import op1_packing
from .pages import op5_pages
from .periodic import op12_periodic_runs
from .quality import op6_quality_rules
from .simhash import op7_simhash
from .substrings import op4_substring_dedup
from .urls import OP3_SQL, op3_url_filters
from .whitening import op13_whitening

QUERIES = {f.__name__: f for f in (op1_packing, op2_near_vectors, op3_url_filters, op4_substring_dedup, op5_pages, op6_quality_rules, op7_simhash, op8_mixing, op9_licenses, op10_languages, op11_bpe, op12_periodic_runs, op13_whitening)}
OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON link.a = reach.r),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a),
c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n ON a = vec_id
"""

OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, s, array_to_string(list_slice(w, s + 1, s + 20), ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS s FROM w WHERE len(w) >= 20)),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, s + k AS i FROM (SELECT doc_id, s, unnest(range(0, 20)) AS k FROM late)),
word AS (SELECT doc_id, unnest(range(0, len(w))) AS i, unnest(w) AS x FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

#: The rest needs a tokenizer, a learned model, a parser or a hash that SQL doesn't offer; tests hold it against brute force.
ORACLE_SQL: dict[str, str] = {"op2_near_vectors": OP2_SQL, "op3_url_filters": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op9_licenses": OP9_SQL}
