"""The corpus operators as registered queries, with SQL where SQL can express them."""

from __future__ import annotations

from skyloom.llm.embedding_dedup import COSINE, op10_embedding_dedup
from skyloom.llm.errata_trie import op11_spelling_variants
from skyloom.llm.katz import op1_katz
from skyloom.llm.language_id import op5_language_id
from skyloom.llm.license_scan import op4_license_scan
from skyloom.llm.order_minhash import op8_order_minhash
from skyloom.llm.packing import op2_best_fit_packing
from skyloom.llm.part_codes import ENTRIES, PARTS, ROUNDS, SCALE, op13_vector_codes
from skyloom.llm.quality import op12_quality
from skyloom.llm.sentencepiece_unigram import op7_sentencepiece
from skyloom.llm.simhash import op9_simhash
from skyloom.llm.substring_dedup import WINDOW, op3_substring_dedup
from skyloom.llm.toxicity import op6_toxicity

QUERIES = {
    "op1_katz": op1_katz,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_order_minhash": op8_order_minhash,
    "op9_simhash": op9_simhash,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_quality": op12_quality,
    "op13_vector_codes": op13_vector_codes,
}

_OP3 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + {WINDOW - 1}) AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
dup AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps
         FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM win WHERE s IN (SELECT s FROM dup)) GROUP BY doc_id),
flags AS (SELECT d.doc_id, w, list_sort(coalesce(ps, [])) AS ps FROM d LEFT JOIN gone USING (doc_id)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.p) AS t
         FROM words LEFT JOIN (SELECT doc_id, unnest(ps) AS p FROM flags) g ON g.doc_id = words.doc_id AND g.p = words.p
         WHERE g.p IS NULL GROUP BY words.doc_id)
SELECT f.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256,
       CAST(len(list_filter(ps, lambda p: NOT list_contains(ps, p - 1))) AS BIGINT) AS n_intervals
FROM flags f LEFT JOIN kept USING (doc_id)
"""

_OP10 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
m AS (SELECT vec_id, label, e, list_max(list_transform(e, lambda x: abs(x))) AS m FROM v
      WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT vec_id, label, list_transform(e, lambda x: x / pow(2.0, floor(log2(m)))) AS e FROM m WHERE m > 0),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM s),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= {COSINE}),
r(id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.id),
c AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT v.vec_id, coalesce(k, 0) AS n_links, c AS component_id, c = v.vec_id AS kept
FROM v JOIN c ON c.id = v.vec_id LEFT JOIN (SELECT a, count(*) AS k FROM l GROUP BY a) x ON x.a = v.vec_id
"""



def _op13() -> str:
    """Rounds of assignment and update, written out one after the other."""
    step = """
far{r} AS (SELECT s.vec_id, s.p, b.e, list_sum(list_transform(list_zip(s.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS f
           FROM parts s JOIN book{r} b ON b.p = s.p),
near{r} AS (SELECT vec_id, p, arg_min(e, f * {entries} + e) AS e, min(f) AS f FROM far{r} GROUP BY vec_id, p)"""
    update = """
new{r} AS (SELECT n.p, n.e, list(q ORDER BY d) AS x
           FROM (SELECT p, e, d, (s - ((s % c) + c) % c) // c AS q
                 FROM (SELECT n.p, n.e, d, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS c
                       FROM near{r} n JOIN flat f ON f.vec_id = n.vec_id AND f.p = n.p GROUP BY n.p, n.e, d)) n GROUP BY n.p, n.e),
book{next} AS (SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM book{r} b LEFT JOIN new{r} n ON n.p = b.p AND n.e = b.e)"""
    chain = []
    for r in range(ROUNDS + 1):
        chain.append(step.format(r=r, entries=ENTRIES))
        if r < ROUNDS:
            chain.append(update.format(r=r, next=r + 1))
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor({SCALE} * x)::BIGINT::HUGEINT) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, p, list_slice(x, p * (len(x) // {PARTS}) + 1, (p + 1) * (len(x) // {PARTS})) AS x FROM v, range({PARTS}) t(p)),
flat AS (SELECT vec_id, p, unnest(x) AS x, generate_subscripts(x, 1) AS d FROM parts),
seed AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT {ENTRIES}),
book0 AS (SELECT p, e, x FROM parts JOIN seed USING (vec_id)),{",".join(chain)},
coded AS (SELECT vec_id, string_agg(printf('%02x', e::BIGINT), '' ORDER BY p) AS code, sum(f)::BIGINT AS error FROM near{ROUNDS} GROUP BY vec_id),
hash AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM book{ROUNDS})
SELECT v.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM v JOIN coded USING (vec_id), hash
"""


ORACLES = {"op3_substring_dedup": _OP3, "op10_embedding_dedup": _OP10, "op13_vector_codes": _op13()}
