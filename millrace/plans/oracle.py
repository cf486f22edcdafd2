"""DuckDB pieces that the oracles are put together from: each is a list of common table expressions."""

from __future__ import annotations



def fill(template: str, expression: str) -> str:
    return template.replace("{0}", expression)


NORM = "replace(replace(replace(lower(coalesce({0}, '')), 'ß', 'ss'), 'µ', 'μ'), 'ſ', 's')"
SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}]+"
EDGES = "\"''`.,;:!?()[]{}<>«»“”‘’—–-=_|*©°#~^+/\\"
TOKENS = r"""CASE WHEN regexp_matches(p, '\d') AND regexp_matches(p, '[0-9a-z][/.\-:][0-9a-z]') THEN [p] ELSE []::VARCHAR[] END
  || list_filter(list_transform(regexp_extract_all(p, '[0-9a-z\x{e0}-\x{24f}]+'),
    lambda w: CASE WHEN regexp_full_match(w, '[0-9]+') THEN CASE WHEN ltrim(w, '0') = '' THEN '0' ELSE ltrim(w, '0') END WHEN length(w) > 1 THEN w END), lambda w: w IS NOT NULL)"""


def tokens(name: str, table: str, key: str, text: str) -> str:
    """``name(key, toks)``: token lists in order."""
    piece = r"trim(regexp_replace(regexp_replace(x, '(\d),(\d)', '\1\2', 'g'), '(\d),(\d)', '\1\2', 'g'), '" + EDGES + "')"
    return f"""{name} AS (SELECT {key}, flatten(list_transform(list_filter(list_transform(string_split_regex({fill(NORM, text)}, '{SPACES}'), lambda x: {piece}), lambda p: p <> ''),
  lambda p: {TOKENS})) AS toks FROM {table})"""


TOK = tokens("tok", "documents", "doc_id AS chunk_id", "text")
TF = TOK + """, tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS term FROM tok) GROUP BY ALL)"""
DL = TF + """, dl AS (SELECT chunk_id, len(toks)::BIGINT AS doc_len FROM tok),
cs AS (SELECT count(*) AS n, CASE WHEN sum(doc_len) > 0 THEN sum(doc_len)::DOUBLE / count(*) ELSE 1.0 END::DOUBLE AS avgdl FROM dl),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""
W = DL + """, wt AS (SELECT term, chunk_id, ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
  / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avgdl)) AS weight FROM tf JOIN dl USING (chunk_id) JOIN dfq USING (term), cs)"""
QTOK = tokens("qtok", "(SELECT item_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 2000) AS text FROM benchmark)", "item_id AS query_id", "text")
LEX = W + ", " + QTOK + """, qt AS (SELECT query_id, unnest(list_distinct(toks)) AS term FROM qtok),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, chunk_id)::INT AS bm25_rank
  FROM (SELECT query_id, chunk_id, round(sum(weight), 6) AS bm25_score FROM wt JOIN qt USING (term) GROUP BY ALL) WHERE bm25_score > 0 QUALIFY bm25_rank <= 30)"""
DEN = """qv AS (SELECT item_id AS query_id, embedding AS query_vector FROM benchmark JOIN embeddings ON vec_id = item_id),
den AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id)::INT AS dense_rank
  FROM (SELECT query_id, vec_id AS chunk_id, round(list_distance(embedding::DOUBLE[], query_vector::DOUBLE[]) ** 2, 6) AS distance FROM embeddings, qv) QUALIFY dense_rank <= 30)"""
RANKED = LEX + ", " + DEN + """, ranked AS (SELECT query_id, 'dense' AS retriever, chunk_id, dense_rank AS pos FROM den UNION ALL SELECT query_id, 'bm25', chunk_id, bm25_rank FROM lex)"""
FUSED = RANKED + """, fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, best_rank, chunk_id)::INT AS fused_rank
  FROM (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + pos)), 9) AS rrf_score, min(pos)::INT AS best_rank FROM ranked GROUP BY ALL))"""
# The same lists to depth 50, for sweeps.
RANKED50 = RANKED.replace("QUALIFY bm25_rank <= 30", "QUALIFY bm25_rank <= 50").replace("QUALIFY dense_rank <= 30", "QUALIFY dense_rank <= 50")
POOL = FUSED + """, pool AS (SELECT f.query_id, f.chunk_id, rrf_score, best_rank, fused_rank, dense_rank, bm25_score, bm25_rank, d.text, d.source,
  coalesce(distance, round(list_distance(e.embedding::DOUBLE[], qv.query_vector::DOUBLE[]) ** 2, 6)) AS distance
  FROM fused f LEFT JOIN den USING (query_id, chunk_id) LEFT JOIN lex USING (query_id, chunk_id) JOIN documents d ON d.doc_id = f.chunk_id
  LEFT JOIN embeddings e ON e.vec_id = f.chunk_id LEFT JOIN qv ON qv.query_id = f.query_id WHERE fused_rank <= 30)"""
RER = POOL + """, rer AS (SELECT p.*, round(len(list_intersect(list_distinct(q.toks), t.toks))::DOUBLE / greatest(len(list_distinct(q.toks)), 1), 6) AS rerank_score,
  row_number() OVER (PARTITION BY p.query_id ORDER BY rerank_score DESC, fused_rank)::INT AS final_rank
  FROM pool p JOIN qtok q ON q.query_id = p.query_id JOIN tok t ON t.chunk_id = p.chunk_id QUALIFY final_rank <= 10)"""
RES = RER + """, res AS (SELECT 'a_dense' AS config, query_id, chunk_id, dense_rank AS rank FROM den WHERE dense_rank <= 10
  UNION ALL SELECT 'b_hybrid', query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank)::INT AS rank FROM pool QUALIFY rank <= 10
  UNION ALL SELECT 'c_rerank', query_id, chunk_id, final_rank FROM rer)"""
CANON = "trim(regexp_replace(" + NORM + r", '[\s\x0b\x1c-\x1f\x{85}\x{a0}]+', ' ', 'g'))"
GOLD = f"""gold AS (SELECT DISTINCT item_id AS query_id, 'f' || item_id AS fact, doc_id AS chunk_id, source
  FROM (SELECT item_id, {fill(CANON, "text")} AS needle FROM benchmark) b JOIN (SELECT doc_id, source, {fill(CANON, "text")} AS hay FROM documents) d ON contains(hay, needle) WHERE needle <> '')"""
MET = RES + ", " + GOLD + """, pk AS (SELECT doc_id AS chunk_id, source || '|' || lang AS page_key FROM documents),
scope AS (SELECT * FROM (SELECT query_id, count(DISTINCT chunk_id) AS n_gold, count(DISTINCT fact) AS facts_total FROM gold GROUP BY query_id), (SELECT DISTINCT config FROM res)),
jd AS (SELECT res.*, g.chunk_id IS NOT NULL AS is_gold FROM res LEFT JOIN (SELECT DISTINCT query_id, chunk_id FROM gold) g USING (query_id, chunk_id)),
hits AS (SELECT config, query_id, min(rank) FILTER (WHERE is_gold) AS first_gold_rank, count(*) FILTER (WHERE is_gold AND rank <= 1) AS f1,
  count(*) FILTER (WHERE is_gold AND rank <= 5) AS f5, count(*) FILTER (WHERE is_gold) AS f10, sum(CASE WHEN is_gold THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM jd GROUP BY ALL),
ph AS (SELECT DISTINCT config, r.query_id FROM res r JOIN pk USING (chunk_id) JOIN (SELECT DISTINCT query_id, page_key FROM gold JOIN pk USING (chunk_id)) g ON g.query_id = r.query_id AND g.page_key = pk.page_key WHERE rank <= 5),
fc AS (SELECT config, query_id, count(DISTINCT fact) AS facts_covered FROM res JOIN gold USING (query_id, chunk_id) GROUP BY ALL),
met AS (SELECT s.config, s.query_id, first_gold_rank, n_gold, (coalesce(f1, 0) > 0)::INT AS hit_1, (coalesce(f5, 0) > 0)::INT AS hit_5, (coalesce(f10, 0) > 0)::INT AS hit_10,
  (ph.query_id IS NOT NULL)::INT AS page_hit_5, round(coalesce(f5, 0)::DOUBLE / n_gold, 6) AS recall_5, round(coalesce(f10, 0)::DOUBLE / n_gold, 6) AS recall_10,
  round(coalesce(f5, 0)::DOUBLE / 5, 6) AS precision_5, round(coalesce(f10, 0)::DOUBLE / 10, 6) AS precision_10, round(coalesce(1::DOUBLE / first_gold_rank, 0), 6) AS mrr,
  round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg, coalesce(facts_covered, 0)::BIGINT AS facts_covered, facts_total
  FROM scope s LEFT JOIN hits USING (config, query_id) LEFT JOIN ph USING (config, query_id) LEFT JOIN fc USING (config, query_id)),
qs AS (SELECT item_id AS query_id, text, CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 'mixed' ELSE 'en' END AS language, CASE WHEN length(text) < 120 THEN 'short' ELSE 'long' END AS category FROM benchmark)"""
SUMMARY = """count(*) AS n, sum(hit_1)::BIGINT AS hit_1, sum(hit_5)::BIGINT AS hit_5, sum(hit_10)::BIGINT AS hit_10, sum(page_hit_5)::BIGINT AS page_hit_5,
  sum(facts_covered)::BIGINT AS facts_covered, sum(facts_total)::BIGINT AS facts_total, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10,
  round(avg(precision_5), 6) AS precision_5, round(avg(precision_10), 6) AS precision_10, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg,
  count(*) FILTER (WHERE facts_covered = facts_total) AS complete"""
