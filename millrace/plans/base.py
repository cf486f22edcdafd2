"""What the registered queries share: the driver tables seen as chunks, questions, vectors and runs."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.config import RetrievalConfig
from millrace.functions import text as tx
from millrace.operators import bm25, evaluation, pieces, postings, search
from millrace.staging import new_path, written

CONFIGS = ["a_dense", "b_hybrid", "c_rerank"]


class Base:
    """Tables of one folder; what several queries need is written once to the shared folder, so its size is known to the planner."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.config = spark, folder, RetrievalConfig()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @property
    def chunks(self) -> DataFrame:
        return self.documents.select(F.col("doc_id").alias("chunk_id"), "text", "source", "lang")

    @property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")

    @property
    def questions(self) -> DataFrame:
        foreign = F.when(F.col("text").rlike("[^\\x00-\\x7F]"), "mixed").otherwise("en")
        kind = F.when(F.length("text") < 120, "short").otherwise("long")
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), foreign.alias("language"), kind.alias("category"))

    @property
    def query_vectors(self) -> DataFrame:
        return self.questions.select("query_id").join(self.vectors.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector")), "query_id")

    @property
    def tokens(self) -> DataFrame:
        return bm25.token_lists(self.chunks, tx.tokenize(F.col("text")))

    @property
    def tf(self) -> DataFrame:
        return bm25.term_frequencies(self.tokens)

    @property
    def lengths(self) -> DataFrame:
        return bm25.doc_lengths(self.tokens)

    @cached_property
    def counted(self) -> DataFrame:
        """Every chunk's terms and their counts, for what needs them all."""
        return written(bm25.counted(self.tokens), "counted")

    @cached_property
    def query_tokens(self) -> DataFrame:
        return written(self.questions.select("query_id", tx.tokenize(tx.truncate_query(F.col("question"))).alias("tokens")), "questions")

    @cached_property
    def asked_terms(self) -> DataFrame:
        """Every chunk's length, and of its terms those that any question has, with their counts."""
        return pieces.asked_terms(self.chunks, self.query_tokens)

    @cached_property
    def lexical(self) -> DataFrame:
        return written(bm25.search_counted(self.asked_terms, self.query_tokens, self.config.bm25_k), "lexical")

    def new_index(self) -> postings.SavedIndex:
        return postings.create(self.chunks, tx.tokenize(F.col("text")), new_path(self.spark, "index"), tx.tokenizer_version())

    @cached_property
    def index(self) -> postings.SavedIndex:
        return self.new_index()

    @cached_property
    def dense(self) -> DataFrame:
        return written(search.dense_topk(self.vectors, self.query_vectors, self.config.dense_k), "dense")

    @cached_property
    def deep(self) -> DataFrame:
        """The ranked lists of both retrievers down to 50, for sweeps."""
        dense = search.dense_topk(self.vectors, self.query_vectors, 50)
        return written(search.ranked_lists(dense, bm25.search_counted(self.asked_terms, self.query_tokens, 50)), "deep")

    @property
    def ranked(self) -> DataFrame:
        return search.ranked_lists(self.dense, self.lexical)

    @cached_property
    def fused(self) -> DataFrame:
        return written(search.rrf(self.ranked, self.config.rrf_k), "fused")

    def store(self, ids: DataFrame) -> DataFrame:
        """Chunks of ``ids`` with their vectors; the ids are written, so that they can go to the chunks and not the other way."""
        some = written(ids.select("chunk_id").distinct().coalesce(1), "ids")
        return self.chunks.join(some, "chunk_id", "left_semi").join(self.vectors.join(some, "chunk_id", "left_semi"), "chunk_id", "left")

    @cached_property
    def pool(self) -> DataFrame:
        cut = self.fused.filter(F.col("fused_rank") <= self.config.pool)
        merged = search.merge_candidates(self.dense, self.lexical)
        return written(search.hydrate(cut.join(merged, ["query_id", "chunk_id"], "left"), self.store(cut), self.query_vectors), "pool")

    @cached_property
    def pool_tokens(self) -> DataFrame:
        ids = written(self.pool.select("chunk_id").distinct().coalesce(1), "ids")
        return written(self.asked_terms.join(ids, "chunk_id", "left_semi").select("chunk_id", F.col("terms").alias("tokens")), "tokens")

    def reranked_from(self, depth: int) -> DataFrame:
        """The first ``depth`` of the pool reranked by a stand-in scorer, the share of query tokens that a passage has. A passage's
        tokens that no question has make no difference to it."""
        asked = self.query_tokens.select("query_id", F.col("tokens").alias("asked"))
        rows = self.pool.filter(F.col("fused_rank") <= depth).join(asked, "query_id").join(self.pool_tokens, "chunk_id")
        return search.rerank(rows, search.overlap_score(F.col("asked"), F.col("tokens")), self.config.final_top_k).drop("asked", "tokens")

    @cached_property
    def reranked(self) -> DataFrame:
        return written(self.reranked_from(self.config.pool), "reranked")

    @cached_property
    def results(self) -> DataFrame:
        """``config, query_id, chunk_id, rank`` of three configurations: dense alone, fused, fused and reranked."""
        k = self.config.final_top_k
        a = self.dense.filter(F.col("dense_rank") <= k).select(F.lit(CONFIGS[0]).alias("config"), "query_id", "chunk_id", F.col("dense_rank").alias("rank"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("fused_rank"))
        b = self.pool.select(F.lit(CONFIGS[1]).alias("config"), "query_id", "chunk_id", place.alias("rank")).filter(F.col("rank") <= k)
        c = self.reranked.select(F.lit(CONFIGS[2]).alias("config"), "query_id", "chunk_id", F.col("final_rank").alias("rank"))
        return written(a.unionByName(b).unionByName(c), "results")

    @property
    def evidence(self) -> DataFrame:
        none = F.lit(None).cast("string")
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("f"), "item_id").alias("fact"), none.alias("source"), "text")

    @cached_property
    def gold(self) -> DataFrame:
        return written(evaluation.resolve_gold(self.evidence, self.chunks), "gold")

    @property
    def page_keys(self) -> DataFrame:
        """A source's language part stands for the page of a chunk."""
        return self.chunks.select("chunk_id", F.concat_ws("|", "source", "lang").alias("page_key"))

    @cached_property
    def metrics(self) -> DataFrame:
        return written(evaluation.question_metrics(self.results, self.gold, self.page_keys), "metrics")

    @property
    def pages(self) -> DataFrame:
        """Documents as pages of their source, in order of their id."""
        return self.documents.select("source", F.col("doc_id").alias("page"), "text")


    def close(self) -> None:
        """Free what is kept."""
        for kept in list(vars(self).values()):
            if isinstance(kept, DataFrame) and kept.is_cached:
                kept.unpersist()


_known: dict[tuple[str, str], Base] = {}


def base(spark: SparkSession, folder: str) -> Base:
    """The tables of a folder; those of one folder are kept at a time, until another is asked for."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _known:
        for other in list(_known):
            old = _known.pop(other)
            if other[0] == key[0]:
                old.close()
        _known[key] = Base(spark, folder)
    return _known[key]
