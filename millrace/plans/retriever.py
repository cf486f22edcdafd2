"""Retrieval for batches of questions, with the rules for what may fail."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import RetrievalConfig
from millrace.functions import text as tx
from millrace.operators import models, postings, search
from millrace.operators.bm25 import Bm25Index
from millrace.operators.models import Encoder, Generator, RefusalError, Reranker, generate
from millrace.operators.postings import SavedIndex


class RetrievalError(RuntimeError):
    """Every retriever that the mode needs has failed."""


@dataclass
class RetrievalResult:
    candidates: DataFrame
    mode: str
    reranked: bool = False
    timings_ms: dict[str, float] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


_DENSE = "query_id {0}, chunk_id {1}, distance double, dense_rank int, text string, source string"
_LEXICAL = "query_id {0}, chunk_id {1}, bm25_score double, bm25_rank int"


@dataclass
class HybridRetriever:
    """``chunks`` has ``chunk_id, text, source, embedding``. ``encode`` turns a question column into vectors and
    ``rerank`` a question and a passage column into scores; both may be missing.

    Each leg runs in its own try, since Spark's errors come with its actions; what a leg found is kept in memory. Dense
    hits are kept with their texts, so they stay if those of the others can't be loaded.
    """

    chunks: DataFrame
    index: Bm25Index | SavedIndex | None
    encode: Callable[[Column], Column] | None = None
    rerank: Callable[[Column, Column], Column] | None = None
    config: RetrievalConfig = field(default_factory=RetrievalConfig)

    def retrieve(self, questions: DataFrame, top_k: int | None = None) -> RetrievalResult:
        """``query_id, question`` to the best ``top_k`` (default: the setting's) candidates of each. Blank ones get none."""
        if dict(questions.dtypes).get("question") != "string":
            raise ValueError("questions must be texts")
        cfg, k = self.config, top_k or self.config.final_top_k
        asked = questions.select("query_id", tx.truncate_query(F.col("question"), cfg.max_query_chars).alias("question")).filter("question <> ''")
        result = RetrievalResult(questions.limit(0), cfg.mode)
        kinds = dict(asked.dtypes)["query_id"], dict(self.chunks.dtypes)["chunk_id"]
        spark = asked.sparkSession
        dense = lexical = None
        vectors: DataFrame | None = None

        def leg(name: str, failure: str, plan: Callable[[], DataFrame]) -> DataFrame | None:
            began = time.time()
            try:
                found = plan().persist()
                found.count()
                return found
            except Exception as e:  # whatever a model or a store raises
                result.warnings.append(f"{failure}: {type(e).__name__}")
                return None
            finally:
                result.timings_ms[name] = (time.time() - began) * 1000

        if cfg.mode in ("hybrid", "dense"):
            depth = cfg.dense_k if cfg.mode == "hybrid" else max(cfg.dense_k, k)
            vectors = leg("embed", "dense retrieval failed", lambda: asked.select("query_id", self._encoded(F.col("question")).alias("query_vector")))
            if vectors is not None:
                dense = leg("dense", "dense retrieval failed", lambda: search.dense_topk(self.chunks, vectors, depth).join(self.chunks.select("chunk_id", "text", "source"), "chunk_id"))
        if cfg.mode in ("hybrid", "bm25"):
            depth = cfg.bm25_k if cfg.mode == "hybrid" else max(cfg.bm25_k, k)
            if self.index is None or self.index.empty:
                result.warnings.append("bm25 index unavailable")
            else:
                lexical = leg("bm25", "bm25 retrieval failed", lambda: self.index.search(asked.select("query_id", tx.tokenize(F.col("question")).alias("tokens")), depth))
        if dense is None and lexical is None:
            raise RetrievalError("; ".join(result.warnings) or f"unknown mode {cfg.mode}")
        none = spark.createDataFrame([], _DENSE.format(*kinds)), spark.createDataFrame([], _LEXICAL.format(*kinds))
        dense, lexical = none[0] if dense is None else dense, none[1] if lexical is None else lexical
        held, dense = dense.select("query_id", "chunk_id", "text", "source"), dense.drop("text", "source")
        fused = search.rrf(search.ranked_lists(dense, lexical), cfg.rrf_k)
        pool = max(k, cfg.rerank_candidates) if cfg.rerank_enabled and self.rerank else k
        cut = fused.filter(F.col("fused_rank") <= pool).join(search.merge_candidates(dense, lexical), ["query_id", "chunk_id"], "left")
        known = vectors if vectors is not None else spark.createDataFrame([], f"query_id {kinds[0]}, query_vector array<float>")
        rows = leg("hydrate", "failed to load lexical hits", lambda: search.hydrate(cut, self.chunks, known))
        if rows is None:
            rows = cut.filter("dense_rank IS NOT NULL").join(held, ["query_id", "chunk_id"])
        if cfg.rerank_enabled and self.rerank:
            scored = leg("rerank", "reranking failed", lambda: search.rerank(rows.join(asked, "query_id"), self.rerank(F.col("question"), F.col("text")), k).drop("question"))
            if scored is not None:
                result.candidates, result.reranked = scored, True
                return result
        elif cfg.rerank_enabled:
            result.warnings.append("reranker unavailable")
        result.candidates = search.rerank(rows, F.lit(None).cast("double"), k)
        return result

    def _encoded(self, c: Column) -> Column:
        if self.encode is None:
            raise RuntimeError("no encoder")
        return self.encode(c)


def prepared_index(chunks: DataFrame, config: RetrievalConfig, sync: bool = True) -> SavedIndex:
    """The saved index at the setting's path: brought up to ``chunks``, only opened, or made if there is none of this kind."""
    version, tokens = tx.tokenizer_version(), tx.tokenize(F.col("text"))
    known = postings.load(chunks.sparkSession, config.index_path, version, config.collection)
    if known is None:
        return postings.create(chunks, tokens, config.index_path, version, config.collection, config.bm25_k1, config.bm25_b)
    return postings.sync(known, chunks, tokens)[0] if sync else known


def build_retriever(chunks: DataFrame, config: RetrievalConfig, encoder: Callable[[], Encoder] | None = None, reranker: Callable[[], Reranker] | None = None) -> HybridRetriever:
    """A retriever over ``chunks``; models are given by what loads them. Without its index or its reranker it starts too."""
    index = None
    if config.mode in ("hybrid", "bm25"):
        try:
            index = prepared_index(chunks, config, config.bm25_auto_sync)
        except Exception as e:  # whatever a file system or the data raise
            warnings.warn(f"the BM25 index could not be prepared: {type(e).__name__}: {e}", stacklevel=2)
    encode = (lambda c: models.encode(c, encoder)) if encoder else None
    rerank = None
    if reranker and config.rerank_enabled:
        loaded = models.quantized(reranker, config.rerank_quantize, config.rerank_device)
        rerank = lambda q, p: models.rerank_scores(q, p, loaded, config.rerank_batch_size)
    return HybridRetriever(chunks, index, encode, rerank, config)


def citations(candidates: DataFrame) -> DataFrame:
    """What is shown of a candidate as its source, with a relevance from 0 to 1."""
    return candidates.select("query_id", "final_rank", F.col("source").alias("pdf"), "chunk_id", "distance", search.relevance(F.col("distance")).alias("relevance"), "rerank_score")


def ask(retriever: HybridRetriever, questions: DataFrame, template: str, model: Generator, nothing: str = "No relevant passage was found.", refused: str = "The model declined to answer.") -> list[dict]:
    """Answers to a small batch of questions; blank ones raise. The questions and answers are on the driver."""
    if not questions.filter("trim(coalesce(question, '')) = ''").isEmpty():
        raise ValueError("a question is blank")
    found = retriever.retrieve(questions).candidates
    out = []
    for row in search.prompts(found, questions, template).join(found.groupBy("query_id").count(), "query_id", "left").collect():
        if not row["count"]:
            out.append({"query_id": row.query_id, "answer": nothing})
            continue
        try:
            out.append({"query_id": row.query_id, "answer": generate(model, row.prompt)})
        except RefusalError:
            out.append({"query_id": row.query_id, "answer": refused})
    return out
