"""Queries of the retrieval engine with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import bm25, chunking, evaluation, pieces, search
from millrace.plans import oracle as o
from millrace.plans.base import CONFIGS, Base, base
from millrace.staging import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WEIGHTS = {"bm25": 2.0}
TEMPLATE = "Answer from the context only.\n\nContext:\n{context}\n\nQuestion:\n{question}\n"
DEPTHS, KS = [10, 20, 30, 50], [10, 30, 60, 100]


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[Base], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: f(base(spark, folder))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _text_query(name: str, column: Callable, sql: str, out: str = "out") -> None:
    """A text function over whole ``documents``."""
    query(name, f"SELECT doc_id, {sql} AS {out} FROM documents")(lambda b: b.documents.select("doc_id", column(F.col("text")).alias(out)))


# ---------------------------------------------------------------- text

_PAGES = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?i)Page\s*\d+', '', 'g'), '(?im)\bPage\s+\d+\b', '', 'g'), '(?m)^\d+$', '', 'g'), '\[\d+\]', '', 'g'), '\(\d+\)', '', 'g')"
_URLS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '.*https?://\S+.*', '', 'g'), 'https?://\S+|www\.\S+', '', 'g'), '(?i).*email\s*:\s*\S+.*', '', 'g'), '\S+@\S+', '', 'g')"
_JUNK = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[|_]{2,}', '', 'g'), '[|\\]{2,}', '', 'g'), '_{3,}', '', 'g'), '-{3,}', '', 'g'), '\.{4,}', '', 'g'), '\s+[|\\/]\s+', '', 'g'), '[•●■◆◦]+', '', 'g')"
_HEADERS = r"array_to_string(list_filter(string_split({0}, chr(10)), lambda l: length(trim(l, ' ' || chr(9) || chr(13) || chr(11) || chr(12))) >= 3 AND NOT regexp_matches(trim(l, ' ' || chr(9) || chr(13) || chr(11) || chr(12)), '(?i)^copyright\s+©|^\d{1,2}/\d{1,2}/\d{2,4}$|^chapter\s+\d+$|^section\s+\d+$')), chr(10))"
_SPACES = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n[ \t]+', chr(10), 'g')"
_STRIP = r"trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_CLEAN = o.fill(_STRIP, o.fill(_SPACES, o.fill(_HEADERS, o.fill(_JUNK, o.fill(_URLS, o.fill(_PAGES, "text"))))))
_COLLAPSE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"

_text_query("clean_page_numbers", tx.remove_page_numbers, o.fill(_PAGES, "text"))
_text_query("clean_urls", tx.remove_urls, o.fill(_URLS, "text"))
_text_query("clean_ocr_junk", tx.remove_junk, o.fill(_JUNK, "text"))
_text_query("clean_headers", tx.remove_headers, o.fill(_HEADERS, "text"))
_text_query("clean_whitespace", tx.fix_whitespace, o.fill(_SPACES, "text"))
_text_query("clean_text", tx.clean_text, _CLEAN)
_text_query("collapse_ws", tx.collapse, o.fill(_COLLAPSE, "text"))
_text_query("truncate_query", tx.truncate_query, f"substr({o.fill(_COLLAPSE, 'text')}, 1, 2000)")
_text_query("normalize", tx.normalize, o.fill(o.NORM, "text"))
_text_query("canon", tx.canonical, o.fill(o.CANON, "text"))
_text_query("content_hash", tx.content_hash, "sha1(coalesce(text, ''))")
_text_query("script_flag", tx.has_malayalam, r"coalesce(regexp_matches(text, '[\x{d00}-\x{d7f}]'), false)")
_text_query("needs_ocr_pages", tx.needs_ocr, f"length({o.fill(_STRIP, 'text')}) < 50")


@query("tokenize", f"WITH {o.TOK} SELECT chunk_id, array_to_string(toks, ' ') AS tokens, len(toks)::BIGINT AS n FROM tok")
def _tokenize(b: Base) -> DataFrame:
    return b.tokens.select("chunk_id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").cast("long").alias("n"))


@query("tokenize_raw", r"SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> ''), ' ') AS tokens FROM documents")
def _tokenize_raw(b: Base) -> DataFrame:
    return b.documents.select("doc_id", F.array_join(tx.tokenize_raw(F.col("text")), " ").alias("tokens"))


@query("page_method", f"SELECT doc_id, CASE WHEN length({o.fill(_STRIP, 'text')}) >= 50 THEN 'pypdf' WHEN n_chars % 2 = 0 THEN 'ocr' ELSE 'pypdf_fallback' END AS method, length(text)::BIGINT AS char_count FROM documents")
def _page_method(b: Base) -> DataFrame:
    ocr = F.when(F.col("n_chars") % 2 == 0, F.repeat(F.lit("x"), 50))  # stands for what an engine would read
    return b.documents.select("doc_id", tx.page_method(F.col("text"), ocr).alias("method"), F.length("text").cast("long").alias("char_count"))


@query("extract_summary", f"SELECT source, count(*) AS pages, count(*) FILTER (WHERE length({o.fill(_STRIP, 'text')}) < 50) AS ocr_pages, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source")
def _extract_summary(b: Base) -> DataFrame:
    return b.documents.groupBy("source").agg(F.count("*").alias("pages"), F.count_if(tx.needs_ocr(F.col("text"))).alias("ocr_pages"), F.sum(F.length("text")).alias("chars"))


@query("short_pages", f"SELECT source, doc_id AS page, {_CLEAN} AS text, length({_CLEAN}) < 50 AS is_short FROM documents")
def _short_pages(b: Base) -> DataFrame:
    cleaned = b.pages.select("source", "page", tx.clean_text(F.col("text")).alias("text"))
    return cleaned.withColumn("is_short", F.length("text") < 50)


@query("clean_document", f"SELECT source, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY doc_id) FILTER (WHERE t <> ''), '') AS text FROM (SELECT source, doc_id, {_CLEAN} AS t FROM documents) GROUP BY source")
def _clean_document(b: Base) -> DataFrame:
    return chunking.document(b.pages.select("source", "page", tx.clean_text(F.col("text")).alias("text")))


_LABEL = r"CASE WHEN regexp_full_match(regexp_replace({0}, '(?i)\.pdf$', ''), '\d+(\s+\d+)?') THEN 'Kerala Gazette No. ' || regexp_replace({0}, '(?i)\.pdf$', '') ELSE regexp_replace(regexp_replace({0}, '(?i)\.pdf$', ''), '[-_]', ' ', 'g') END"


@query("source_label", f"SELECT doc_id, {o.fill(_LABEL, 'f')} AS label FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id || '.pdf' WHEN 1 THEN '35 ' || doc_id || '.PDF' ELSE source || '-a_b.pdf' END AS f FROM documents)")
def _source_label(b: Base) -> DataFrame:
    number = F.col("doc_id").cast("string")
    file = F.when(F.col("doc_id") % 3 == 0, F.concat(number, F.lit(".pdf"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("35 "), number, F.lit(".PDF"))).otherwise(F.concat("source", F.lit("-a_b.pdf")))
    return b.documents.select("doc_id", tx.source_label(file).alias("label"))


@query("casual_messages", rf"SELECT conv_id, turn, regexp_matches({o.fill(_STRIP, 'text')}, '(?i)^({tx.CASUAL})[\s!.?]*$') AS casual FROM conversations")
def _casual(b: Base) -> DataFrame:
    return b.table("conversations").select("conv_id", "turn", tx.is_casual(F.col("text")).alias("casual"))


@query("chat_titles", "SELECT conv_id, substr(arg_min(text, turn), 1, 50) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id")
def _chat_titles(b: Base) -> DataFrame:
    users = b.table("conversations").filter("role = 'user'")
    return users.groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, 50).alias("title"))


# ---------------------------------------------------------------- sources and ingestion


@query("scan_chunks", "SELECT doc_id AS chunk_id, coalesce(text, '') AS text FROM documents")
def _scan(b: Base) -> DataFrame:
    return b.chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("text"))


@query("hydrate_lookup", "SELECT doc_id AS chunk_id, text, source FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def _lookup(b: Base) -> DataFrame:
    return b.chunks.join(b.vectors.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "text", "source")


@query("already_ingested", "SELECT s.source, EXISTS (SELECT 1 FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id WHERE d.source = s.source) AS ingested FROM (SELECT DISTINCT source FROM documents) s")
def _ingested(b: Base) -> DataFrame:
    stored = b.chunks.join(b.vectors.select("chunk_id"), "chunk_id", "left_semi").select(F.col("source").alias("s")).distinct()
    return b.chunks.select("source").distinct().join(stored, F.col("source") == F.col("s"), "left").select("source", F.col("s").isNotNull().alias("ingested"))


_BLOCKS = f"""pg AS (SELECT source, doc_id AS page, {o.fill(_STRIP, "text")} AS text FROM documents),
il AS (SELECT *, length(text) >= 200 AS long, 2 * sum((length(text) >= 200)::INT) OVER (PARTITION BY source ORDER BY page) - (length(text) >= 200)::INT AS block FROM pg),
bl AS (SELECT source, block::BIGINT AS block, CASE WHEN any_value(long) THEN min(page)::VARCHAR ELSE '[' || string_agg(page::VARCHAR, ', ' ORDER BY page) || ']' END AS page, NOT any_value(long) AS is_merged,
  CASE WHEN any_value(long) THEN any_value(text) ELSE string_agg(text || chr(10), '' ORDER BY page) END AS text FROM il GROUP BY source, block)"""


def _blocks(b: Base) -> DataFrame:
    merged = chunking.merge_short_pages(b.pages)
    return merged.select("source", "block", chunking.page_label(F.col("pages"), F.col("is_merged")).alias("page"), "is_merged", "text")


query("merge_pages", f"WITH {_BLOCKS} SELECT * FROM bl")(_blocks)
query("chunk_pages")(lambda b: chunking.chunk_pages(_blocks(b)))
query("chunk_document")(lambda b: chunking.chunk_document(b.pages))


@query("chunk_summary", "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars, round(avg(length(text)), 6) AS mean_chars, min(length(text))::BIGINT AS least, max(length(text))::BIGINT AS most, count(DISTINCT source) AS pages FROM documents GROUP BY lang")
def _chunk_summary(b: Base) -> DataFrame:
    size = F.length("text").cast("long")
    return b.documents.groupBy("lang").agg(F.count("*").alias("n"), F.sum(size).alias("chars"), F.round(F.avg(size), 6).alias("mean_chars"), F.min(size).alias("least"), F.max(size).alias("most"), F.countDistinct("source").alias("pages"))


@query("chunk_ids", "SELECT source, doc_id::VARCHAR AS page, doc_id AS chunk_no, source || '_p' || doc_id || '_' || (row_number() OVER (ORDER BY source, doc_id) - 1) AS chunk_id, source || '_page' || doc_id || '_chunk' || doc_id AS legacy_id FROM documents")
def _chunk_ids(b: Base) -> DataFrame:
    return chunking.chunk_ids(b.documents.select("source", F.col("doc_id").cast("string").alias("page"), F.col("doc_id").alias("chunk_no")))


@query("ingest_stats", "SELECT count(DISTINCT source) AS pdfs, count(*) AS pages, count(*) FILTER (WHERE length(text) >= 200) AS chunks, (SELECT count(*) FROM embeddings) AS vectors FROM documents")
def _ingest_stats(b: Base) -> DataFrame:
    vectors = b.vectors.agg(F.count("*").alias("vectors"))
    return b.documents.agg(F.countDistinct("source").alias("pdfs"), F.count("*").alias("pages"), F.count_if(F.length("text") >= 200).alias("chunks")).join(vectors)


@query("collection_stats", "SELECT count(*) AS n, max(len(embedding))::INT AS dimension FROM embeddings")
def _collection_stats(b: Base) -> DataFrame:
    return b.vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dimension"))


_GROUPS = "g AS (SELECT substr(sha256(doc_id::VARCHAR), 1, 4) AS g, count(*) AS n, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)) AS i, sha256(string_agg(sha256(coalesce(text, '')), chr(10) ORDER BY doc_id::VARCHAR)) AS t FROM documents GROUP BY ALL)"


@query("fingerprint_ids", f"WITH {_GROUPS} SELECT sum(n)::BIGINT AS n, sha256(string_agg(i, chr(10) ORDER BY g)) AS ids_sha256, sha256(string_agg(t, chr(10) ORDER BY g)) AS texts_sha256 FROM g")
def _fingerprint(b: Base) -> DataFrame:
    return bm25.fingerprint(b.chunks.select(F.col("chunk_id").cast("string"), "text"))


# ---------------------------------------------------------------- index

query("term_freq", f"WITH {o.TF} SELECT * FROM tf")(lambda b: b.tf)
query("doc_length", f"WITH {o.DL} SELECT * FROM dl")(lambda b: b.lengths)
query("corpus_stats", f"WITH {o.DL} SELECT * FROM cs")(lambda b: bm25.corpus_stats(b.lengths))
query("doc_freq", f"WITH {o.DL} SELECT * FROM dfq")(lambda b: pieces.frequencies(b.chunks))


@query("idf", f"WITH {o.DL} SELECT term, round(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM dfq, cs")
def _idf(b: Base) -> DataFrame:
    rows = pieces.frequencies(b.chunks).join(F.broadcast(b.chunks.agg(F.count("*").alias("n"))))
    return rows.select("term", F.round(bm25.idf(F.col("df"), F.col("n")), 6).alias("idf"))


@query("bm25_weights", f"WITH {o.W} SELECT term, chunk_id, round(weight, 6) AS weight FROM wt")
def _weights(b: Base) -> DataFrame:
    return bm25.weights(b.counted).select("term", "chunk_id", F.round("weight", 6).alias("weight"))


@query("index_build", f"WITH {o.DL} SELECT count(*) AS n, sum(doc_len)::BIGINT AS total, (SELECT count(*) FROM tf) AS postings FROM dl")
def _index_build(b: Base) -> DataFrame:
    """A saved index of all chunks, made anew, and how large it is; searches of the folder use it from then on."""
    b.index = index = b.new_index()
    sizes = index.docs.agg(F.count("*").alias("n"), F.sum("doc_len").alias("total"))
    return sizes.join(index.postings().agg(F.count("*").alias("postings")))  # two single rows


_OLD = "o AS (SELECT doc_id, sha1(CASE WHEN doc_id % 7 = 0 THEN text || ' old' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT -1 - doc_id, sha1(text) FROM documents WHERE doc_id % 13 = 0)"
_DIFF = f"WITH {_OLD}, n AS (SELECT doc_id, sha1(text) AS h FROM documents), x AS (SELECT coalesce(o.doc_id, n.doc_id) AS chunk_id, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'updated' ELSE 'same' END AS status FROM o FULL JOIN n ON o.doc_id = n.doc_id)"


def _changes(b: Base) -> DataFrame:
    """Against an earlier index made up for it: some chunks not yet in it, some changed since, some gone."""
    key, text = F.col("chunk_id"), F.col("text")
    stayed = b.chunks.filter(key % 11 != 0).select("chunk_id", tx.content_hash(F.when(key % 7 == 0, F.concat(text, F.lit(" old"))).otherwise(text)).alias("content_hash"))
    gone = b.chunks.filter(key % 13 == 0).select((-1 - key).alias("chunk_id"), tx.content_hash(text).alias("content_hash"))
    return bm25.diff(stayed.unionByName(gone), b.chunks.select("chunk_id", tx.content_hash(text).alias("content_hash")))


query("index_diff", f"{_DIFF} SELECT * FROM x")(_changes)
query("index_diff_counts", f"{_DIFF} SELECT count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'updated') AS updated, count(*) FILTER (WHERE status = 'removed') AS removed, count(*) FILTER (WHERE status <> 'removed') AS total FROM x")(
    lambda b: bm25.diff_counts(_changes(b))
)

# ---------------------------------------------------------------- search

query("bm25_topk", f"WITH {o.LEX} SELECT query_id, chunk_id, bm25_score, bm25_rank FROM lex")(lambda b: b.lexical)
query("bm25_saved_topk", f"WITH {o.LEX} SELECT query_id, chunk_id, bm25_score, bm25_rank FROM lex")(lambda b: b.index.search(b.query_tokens, b.config.bm25_k))
query("dense_topk", f"WITH {o.DEN} SELECT query_id, chunk_id, distance, dense_rank FROM den")(lambda b: b.dense)
query("rrf_fusion", f"WITH {o.FUSED} SELECT * FROM fused")(lambda b: b.fused)
_WEIGHTED = o.FUSED.replace("sum(1.0::DOUBLE / (60 + pos))", "sum(CASE WHEN retriever = 'bm25' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END / (60 + pos))")
query("rrf_weighted", f"WITH {_WEIGHTED} SELECT * FROM fused")(lambda b: search.rrf(b.ranked, b.config.rrf_k, WEIGHTS))
query("candidate_pool", f"WITH {o.FUSED} SELECT query_id, chunk_id, fused_rank FROM fused WHERE fused_rank <= 30")(lambda b: b.fused.filter(F.col("fused_rank") <= b.config.pool).select("query_id", "chunk_id", "fused_rank"))
query("candidates_merged", f"WITH {o.RANKED} SELECT query_id, chunk_id, distance, dense_rank, bm25_score, bm25_rank FROM den FULL JOIN lex USING (query_id, chunk_id)")(lambda b: search.merge_candidates(b.dense, b.lexical))
_HYDRATED = ["query_id", "chunk_id", "fused_rank", "dense_rank", "bm25_rank", "distance", "text", "source"]
query("hydrate", f"WITH {o.POOL} SELECT {', '.join(_HYDRATED)} FROM pool")(lambda b: b.pool.select(*_HYDRATED))
query("rerank_order", f"WITH {o.RER} SELECT query_id, chunk_id, rerank_score, final_rank FROM rer")(lambda b: b.reranked.select("query_id", "chunk_id", "rerank_score", "final_rank"))
query("hybrid_topk", f"WITH {o.RES} SELECT query_id, chunk_id, rank FROM res WHERE config = 'b_hybrid'")(lambda b: b.results.filter(F.col("config") == CONFIGS[1]).drop("config"))
query("dense_only", f"WITH {o.DEN} SELECT query_id, chunk_id, dense_rank AS rank FROM den WHERE dense_rank <= 10")(lambda b: b.dense.filter("dense_rank <= 10").select("query_id", "chunk_id", F.col("dense_rank").alias("rank")))
query("bm25_only", f"WITH {o.LEX} SELECT query_id, chunk_id, bm25_rank AS rank FROM lex WHERE bm25_rank <= 10")(lambda b: b.lexical.filter("bm25_rank <= 10").select("query_id", "chunk_id", F.col("bm25_rank").alias("rank")))
query("relevance", f"WITH {o.POOL} SELECT query_id, chunk_id, round(greatest(least(1 - coalesce(distance, max(distance) OVER (PARTITION BY query_id), 1) / 2, 1), 0), 4) AS relevance FROM pool")(
    lambda b: b.pool.select("query_id", "chunk_id", search.relevance(F.col("distance")).alias("relevance"))
)


@query("prompt_context", f"WITH {o.RER}, c AS (SELECT query_id, string_agg(coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY final_rank) AS context FROM rer GROUP BY query_id) SELECT item_id AS query_id, {o.fill(_STRIP, "'Answer from the context only.' || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question:' || chr(10) || text || chr(10)")} AS prompt FROM benchmark LEFT JOIN c ON item_id = query_id")
def _prompts(b: Base) -> DataFrame:
    return search.prompts(b.reranked, b.questions, TEMPLATE)


# ---------------------------------------------------------------- evaluation

query("gold_resolution", f"WITH {o.GOLD} SELECT * FROM gold")(lambda b: b.gold)
query("evidence_missing", f"WITH {o.GOLD} SELECT item_id AS query_id, 'f' || item_id AS fact FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM gold)")(lambda b: evaluation.missing_evidence(b.evidence, b.gold))
query("unanswerable", f"WITH {o.GOLD} SELECT item_id AS query_id FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM gold)")(lambda b: evaluation.unanswerable(b.questions, b.gold))


@query("absence_probe", r"SELECT item_id AS query_id FROM benchmark b WHERE EXISTS (SELECT 1 FROM documents d WHERE regexp_matches(d.text, '(?i)' || regexp_extract(b.text, '[A-Za-z]{4,}\s+[A-Za-z]{4,}', 0))) AND regexp_matches(b.text, '[A-Za-z]{4,}\s+[A-Za-z]{4,}')")
def _probes(b: Base) -> DataFrame:
    """The first two plain words of a question stand for the probe of what must be absent."""
    words = F.regexp_extract("question", r"[A-Za-z]{4,}\s+[A-Za-z]{4,}", 0)
    probes = b.questions.filter(words != "").select("query_id", words.alias("probe"))
    return evaluation.violated_probes(probes, b.chunks)


_M = f"WITH {o.MET} SELECT config, query_id, "
for _name, _cols in {
    "first_gold_rank": ["first_gold_rank"], "hit_at_k": ["hit_1", "hit_5", "hit_10"], "page_hit": ["page_hit_5"], "recall_at_k": ["recall_5", "recall_10"],
    "precision_at_k": ["precision_5", "precision_10"], "mrr": ["mrr"], "ndcg": ["ndcg"], "facts_covered": ["facts_covered", "facts_total"],
}.items():
    query(_name, f"{_M}{', '.join(_cols)} FROM met")(lambda b, cols=_cols: b.metrics.select("config", "query_id", *cols))

query("metric_summary", f"WITH {o.MET} SELECT config, {o.SUMMARY} FROM met GROUP BY config")(lambda b: evaluation.summarize(b.metrics))
query("metric_grouping_sets", f"WITH {o.MET} SELECT config, category, language, {o.SUMMARY}, grouping(category)::INT AS no_category, grouping(language)::INT AS no_language FROM met JOIN qs USING (query_id) GROUP BY GROUPING SETS ((config), (config, category), (config, language))")(
    lambda b: evaluation.breakdowns(b.metrics, b.questions)
)
query("rank_pivot", f"WITH {o.MET} SELECT query_id, {', '.join(f"max(first_gold_rank) FILTER (WHERE config = '{c}') AS {c}" for c in CONFIGS)} FROM met GROUP BY query_id")(lambda b: evaluation.rank_pivot(b.metrics, CONFIGS))
query("pairwise_wins", f"WITH {o.MET}, r AS (SELECT config, query_id, coalesce(first_gold_rank, 1e9) AS r FROM met) SELECT a.config AS config_a, b.config AS config_b, count(*) FILTER (WHERE a.r < b.r) AS better, count(*) FILTER (WHERE a.r > b.r) AS worse, count(*) FILTER (WHERE a.r = b.r) AS tie FROM r a JOIN r b ON a.query_id = b.query_id AND a.config <> b.config GROUP BY ALL")(
    lambda b: evaluation.pairwise_wins(b.metrics)
)


@query("latency_stats", "SELECT event_type AS config, 's' || (user_id % 3) AS stage, round(quantile_cont(value, 0.5), 6) AS median_ms, round(max(value), 6) AS max_ms, count(*) AS n FROM events GROUP BY ALL")
def _latency(b: Base) -> DataFrame:
    stage = F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string"))
    return evaluation.latency(b.table("events").select(F.col("event_type").alias("config"), stage.alias("stage"), F.col("value").alias("ms")))


@query("top_rerank_score", f"WITH {o.RER}, {o.GOLD}, t AS (SELECT item_id IN (SELECT query_id FROM gold) AS answerable, coalesce(top, 0) AS top FROM benchmark LEFT JOIN (SELECT query_id, max(rerank_score) AS top FROM rer GROUP BY 1) ON query_id = item_id) SELECT answerable, round(min(top), 6) AS least, round(quantile_cont(top, 0.5), 6) AS median, round(max(top), 6) AS most, count(*) AS n FROM t GROUP BY answerable")
def _top_scores(b: Base) -> DataFrame:
    known = b.gold.select("query_id").distinct().withColumn("g", F.lit(True))
    answerable = b.questions.select("query_id").join(known, "query_id", "left").select("query_id", F.coalesce("g", F.lit(False)).alias("answerable"))
    return evaluation.top_scores(b.reranked, answerable)


@query("run_comparison", f"WITH {o.MET}, t AS (SELECT CASE event_type WHEN 'click' THEN 'a_dense' WHEN 'view' THEN 'b_hybrid' ELSE 'c_rerank' END AS config, quantile_cont(value, 0.5) AS ms FROM events GROUP BY 1) SELECT config, n, hit_1, hit_5, hit_10, recall_10, mrr, facts_covered, facts_total, round(ms, 6) AS median_ms FROM (SELECT config, {o.SUMMARY} FROM met GROUP BY config) LEFT JOIN t USING (config)")
def _runs(b: Base) -> DataFrame:
    config = F.when(F.col("event_type") == "click", CONFIGS[0]).when(F.col("event_type") == "view", CONFIGS[1]).otherwise(CONFIGS[2])
    times = b.table("events").groupBy(config.alias("config")).agg(F.round(F.expr("percentile(value, 0.5)"), 6).alias("median_ms"))
    return evaluation.summarize(b.metrics).join(times, "config", "left").select("config", "n", "hit_1", "hit_5", "hit_10", "recall_10", "mrr", "facts_covered", "facts_total", "median_ms")


_SHEET = "sh AS (SELECT doc_id, d.source AS config, lang = 'en' AS answerable, CASE quality WHEN 1 THEN 'Y' WHEN 0 THEN 'partial' ELSE '' END AS correct, CASE toxic WHEN 1 THEN ' yes' WHEN 0 THEN 'n' ELSE '' END AS abstained FROM documents d LEFT JOIN labels l USING (doc_id))"


@query("review_scores", f"WITH {_SHEET}, u AS (SELECT config, answerable, 'correct' AS field, lower(trim(correct)) AS v FROM sh UNION ALL SELECT config, answerable, 'abstained', lower(trim(abstained)) FROM sh) SELECT config, field, count(*) FILTER (WHERE v IN ('y', 'yes', '1', 'true')) AS yes, count(*) FILTER (WHERE v LIKE 'p%') AS partial, count(*) FILTER (WHERE v <> '') AS reviewed, count(*) FILTER (WHERE v = '') AS unreviewed FROM u WHERE (field = 'abstained') = (NOT answerable) GROUP BY config, field")
def _review(b: Base) -> DataFrame:
    sheet = b.documents.join(b.table("labels"), "doc_id", "left").select(
        F.col("source").alias("config"), (F.col("lang") == "en").alias("answerable"),
        F.when(F.col("quality") == 1, "Y").when(F.col("quality") == 0, "partial").otherwise("").alias("correct"),
        F.when(F.col("toxic") == 1, " yes").when(F.col("toxic") == 0, "n").otherwise("").alias("abstained"),
    )
    return evaluation.review_scores(sheet, ["correct", "abstained"], "abstained")


@query("review_sheet", f"WITH {o.GOLD}, p AS (SELECT query_id, string_agg(DISTINCT source, '; ' ORDER BY source) AS gold_pages FROM gold GROUP BY 1) SELECT item_id AS query_id, config, text AS question, coalesce(gold_pages, '') AS gold_pages, gold_pages IS NOT NULL AS answerable FROM benchmark CROSS JOIN (VALUES ('a_dense'), ('b_hybrid'), ('c_rerank')) c(config) LEFT JOIN p ON p.query_id = item_id")
def _sheet(b: Base) -> DataFrame:
    pages = b.gold.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("source")), "; ").alias("gold_pages"))
    rows = b.questions.join(pages, "query_id", "left").select("query_id", "question", F.coalesce("gold_pages", F.lit("")).alias("gold_pages"), F.col("gold_pages").isNotNull().alias("answerable"))
    return rows.select("query_id", F.explode(F.array(*map(F.lit, CONFIGS))).alias("config"), "question", "gold_pages", "answerable")


_ANSWERS = "an AS (SELECT conv_id, turn, CASE turn % 2 WHEN 1 THEN 'odd' ELSE 'even' END AS config, CASE WHEN role = 'assistant' THEN text END AS answer, length(text)::DOUBLE AS ms FROM conversations)"


@query("answer_status", f"WITH {_ANSWERS} SELECT config, count(*) FILTER (WHERE answer <> '') AS answered, count(*) FILTER (WHERE coalesce(answer, '') = '') AS failed, round(quantile_cont(ms, 0.5) FILTER (WHERE answer <> '' AND ms <> 0), 6) AS median_ms FROM an GROUP BY config")
def _answers(b: Base) -> DataFrame:
    rows = b.table("conversations").select(F.when(F.col("turn") % 2 == 1, "odd").otherwise("even").alias("config"), F.when(F.col("role") == "assistant", F.col("text")).alias("answer"), F.length("text").cast("double").alias("ms"))
    return evaluation.answer_status(rows)


def _ids(rows: DataFrame) -> DataFrame:
    """``config, query_id, ids``: a question's ids in rank order."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "chunk_id")))
    return rows.groupBy("config", "query_id").agg(F.transform(ordered, lambda x: x["chunk_id"]).alias("ids"))


_LISTS = "ls AS (SELECT config, query_id, list(chunk_id ORDER BY rank) AS ids FROM res GROUP BY ALL)"


@query("answer_match", f"WITH {o.RES}, {_LISTS} SELECT b.config, b.query_id FROM ls b JOIN ls c ON b.query_id = c.query_id AND b.ids = c.ids WHERE b.config = 'b_hybrid' AND c.config = CASE WHEN b.query_id % 2 = 0 THEN 'b_hybrid' ELSE 'c_rerank' END")
def _match(b: Base) -> DataFrame:
    """Answers held against the fused lists; those to odd questions were given for reranked ones, so most don't match."""
    lists = _ids(b.results)
    runs = lists.filter(F.col("config") == CONFIGS[1]).withColumnRenamed("ids", "ranked_ids")
    given = F.when(F.col("query_id") % 2 == 0, CONFIGS[1]).otherwise(CONFIGS[2])
    answers = lists.filter(F.col("config") == given).select(F.lit(CONFIGS[1]).alias("config"), "query_id", F.col("ids").alias("answer_ids"))
    return evaluation.matching_answers(answers, runs)


@query("resume_pending", f"WITH {o.RES} SELECT DISTINCT config, query_id FROM res WHERE query_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'assistant' AND turn = 3)")
def _pending(b: Base) -> DataFrame:
    done = b.table("conversations").filter("role = 'assistant' AND turn = 3").select(F.col("conv_id").alias("query_id"))
    return b.results.select("config", "query_id").distinct().join(done, "query_id", "left_anti").select("config", "query_id")


_GRID = ", ".join(f"({d}, {k})" for d in DEPTHS for k in KS)


@query("sweep_rrf", f"WITH {o.RANKED50}, {o.GOLD}, g(depth, k) AS (VALUES {_GRID}), t AS (SELECT depth, k, query_id, chunk_id, row_number() OVER (PARTITION BY depth, k, query_id ORDER BY s DESC, best, chunk_id) AS rank FROM (SELECT depth, k, query_id, chunk_id, round(sum(1.0::DOUBLE / (k + pos)), 9) AS s, min(pos) AS best FROM ranked JOIN g ON pos <= depth GROUP BY ALL) QUALIFY rank <= 10), f AS (SELECT depth, k, query_id, min(rank) AS first FROM t JOIN (SELECT DISTINCT query_id, chunk_id FROM gold) USING (query_id, chunk_id) GROUP BY ALL) SELECT g.depth::INT AS depth, g.k::INT AS k, count(*) FILTER (WHERE first = 1) AS hit_1, count(first) AS hit_10, round(avg(coalesce(1::DOUBLE / first, 0)), 6) AS mrr FROM g CROSS JOIN (SELECT DISTINCT query_id FROM gold) q LEFT JOIN f ON f.depth = g.depth AND f.k = g.k AND f.query_id = q.query_id GROUP BY ALL")
def _sweep(b: Base) -> DataFrame:
    return evaluation.sweep_rrf(b.deep, b.gold, DEPTHS, KS)


KINDS: dict[str, pieces.Kind] = {"none": ("none", 5, 4), "raw": None}  # the first serves others where there is no Malayalam letter
KINDS |= {f"prefix{n}": ("prefix", n, 4) for n in (4, 5, 6)} | {f"ngram{n}": ("ngram", 5, n) for n in (3, 4)}
TOKENIZERS: dict[str, Callable] = {name: pieces.tokenize_by(kind) for name, kind in KINDS.items()}


def _by_tokenizer(b: Base, k: int) -> DataFrame:
    """``config, query_id, chunk_id, bm25_rank`` for each kind of tokens. The text is read once for all. Without a chunk with
    Malayalam letters every kind but the raw one has the rows of the first, and what it finds: a term of the questions that
    only this kind has is in no chunk."""
    first, question = next(iter(KINDS)), tx.truncate_query(F.col("question"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("kind"), cut(question).alias("tokens")) for name, cut in TOKENIZERS.items()]))
    asked = written(b.questions.select("query_id", each.alias("x")).select("query_id", "x.*"), "questions")
    rows = pieces.asked_terms(b.chunks, asked, KINDS)
    own = {r.kind for r in rows.select("kind").distinct().collect()} | {first}
    found = {name: bm25.search_counted(pieces.of_kind(rows, name, first) if KINDS[name] else rows.filter(F.col("kind") == name), asked.filter(F.col("kind") == name), k) for name in KINDS if name in own}
    same = F.array(F.lit(first), *[F.lit(name) for name in KINDS if name not in own])
    parts = [df.select(F.explode(same if name == first else F.array(F.lit(name))).alias("config"), "query_id", "chunk_id", "bm25_rank") for name, df in found.items()]
    return reduce(DataFrame.unionByName, parts)


@query("sweep_tokenizer", None)
def _sweep_tokenizer(b: Base) -> DataFrame:
    """BM25 alone with each kind of tokens: hits and mean reciprocal rank."""
    found = written(_by_tokenizer(b, 10).select("config", "query_id", "chunk_id", F.col("bm25_rank").alias("rank")), "found")
    return evaluation.summarize(evaluation.question_metrics(found, b.gold, b.page_keys))


@query("sweep_hybrid_tokenizer", None)
def _sweep_hybrid(b: Base) -> DataFrame:
    """Dense hits fused with those of BM25 by each kind of tokens."""
    lexical = _by_tokenizer(b, b.config.bm25_k).select(F.struct("config", "query_id").alias("query_id"), F.lit("bm25").alias("retriever"), "chunk_id", F.col("bm25_rank").alias("pos"))
    kinds = F.explode(F.array(*map(F.lit, TOKENIZERS))).alias("config")
    dense = b.dense.select(kinds, "query_id", "chunk_id", F.col("dense_rank").alias("pos")).select(F.struct("config", "query_id").alias("query_id"), F.lit("dense").alias("retriever"), "chunk_id", "pos")
    fused = search.rrf(dense.unionByName(lexical), b.config.rrf_k).filter("fused_rank <= 10")
    found = written(fused.select("query_id.config", "query_id.query_id", "chunk_id", F.col("fused_rank").alias("rank")), "found")
    return evaluation.summarize(evaluation.question_metrics(found, b.gold, b.page_keys))


RERANK_DEPTHS = [10, 20, 30]
_DEPTHS = " UNION ALL ".join(
    f"SELECT 'rerank{d}' AS config, p.query_id, p.chunk_id, row_number() OVER (PARTITION BY p.query_id ORDER BY round(len(list_intersect(list_distinct(q.toks), t.toks))::DOUBLE / greatest(len(list_distinct(q.toks)), 1), 6) DESC, fused_rank)::INT AS rank FROM pool p JOIN qtok q ON q.query_id = p.query_id JOIN tok t ON t.chunk_id = p.chunk_id WHERE fused_rank <= {d} QUALIFY rank <= 10"
    for d in RERANK_DEPTHS
)


@query("sweep_rerank_depth", f"WITH {o.MET.replace(o.RES, o.RER + ', res AS (' + _DEPTHS + ')')} SELECT config, {o.SUMMARY} FROM met GROUP BY config")
def _sweep_rerank(b: Base) -> DataFrame:
    """Reranking of the first 10, 20 and 30 fused candidates."""
    parts = [b.reranked_from(d).select(F.lit(f"rerank{d}").alias("config"), "query_id", "chunk_id", F.col("final_rank").alias("rank")) for d in RERANK_DEPTHS]
    found = written(reduce(DataFrame.unionByName, parts), "found")
    return evaluation.summarize(evaluation.question_metrics(found, b.gold, b.page_keys))


@query("facets", "SELECT facet, value, count(*) AS n FROM (SELECT 'lang' AS facet, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents) GROUP BY ALL")
def _facets(b: Base) -> DataFrame:
    pair = F.explode(F.array(F.struct(F.lit("lang").alias("facet"), F.col("lang").alias("value")), F.struct(F.lit("source").alias("facet"), F.col("source").alias("value"))))
    return b.documents.select(pair.alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n")).select("facet", "value", "n")


FLAGSHIP = QUERIES["rerank_order"]
