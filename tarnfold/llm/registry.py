"""Queries of this subpackage for __spark_entry__.py, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnfold.llm import bpe, cover_tree, cuckoo, hilbert, jaccard, licenses, mixing, screening, sharding, toxicity, urls, wavelet, whitening

OPERATORS = (licenses.op1_license_scan, toxicity.op2_classifier_chain, cover_tree.op3_cover_tree_top_k, mixing.op4_temperature, bpe.op5_word_bpe, wavelet.op6_wavelet_shards, urls.op7_url_rules, hilbert.op8_hilbert_neighbours, jaccard.op9_jaccard_components, sharding.op10_virtual_slots, cuckoo.op11_cuckoo_dedup, screening.op12_screened_clusters, whitening.op13_tsqr_whitening)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


TOP_K = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

JACCARD = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, hash(t.unnest) AS h FROM d, unnest(s) t),
k AS (SELECT * FROM x WHERE h IN (SELECT h FROM x GROUP BY h HAVING count(*) > 1)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM k a JOIN k b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p WHERE 100 * i >= 85 * (na + nb - i) UNION SELECT b, a FROM p WHERE 100 * i >= 85 * (na + nb - i)),
c(id, m) AS (SELECT a, a FROM e UNION SELECT e.b, c.m FROM c JOIN e ON e.a = c.id AND c.m < e.b),
m AS (SELECT id, min(m) AS m FROM c GROUP BY id)
SELECT d.doc_id, len(s)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id FROM d LEFT JOIN m ON m.id = d.doc_id"""

DEDUP = r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM t WINDOW w AS (PARTITION BY t)"""


def oracle_sql() -> dict[str, str]:
    """Fitted, approximate, tokenising and hashing operators are beyond SQL; their tests hold them against brute force."""
    return {"op3_cover_tree_top_k": TOP_K, "op9_jaccard_components": JACCARD, "op11_cuckoo_dedup": DEDUP, "op12_screened_clusters": screening.oracle()}
