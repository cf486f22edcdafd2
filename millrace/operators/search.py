"""Dense search, rank fusion, hydration, reranking and what is shown of a result. All work on batches of queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERY_BLOCK = 4096  # query vectors that are sent to every task at once
ROWS = 1024  # chunks held against them at a time


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dense_topk(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact nearest neighbours: ``query_id, chunk_id, distance, dense_rank``; ties by id.

    The stated set of query vectors is taken in blocks of ``QUERY_BLOCK``, each sent along as one matrix of that bound.
    A task holds it against its chunks, some thousand at a time by a product of matrices, and keeps the best k of each
    query, whose distances it then takes exactly; so k rows a query and task are shuffled. Chunks and queries without
    a vector, or whose vector has another length than the block's, have no distance.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    own = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    found = reduce(DataFrame.unionByName, [_nearest(chunks, queries.filter(own == i), k) for i in range(blocks)])
    best = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return found.withColumn("dense_rank", F.row_number().over(best)).filter(F.col("dense_rank") <= k)


def _nearest(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    asked = queries.filter("query_vector IS NOT NULL").select("query_id", F.col("query_vector").cast("array<double>").alias("v")).toArrow()
    id_field, chunk_field = queries.schema["query_id"], chunks.schema["chunk_id"]
    schema = T.StructType([id_field, chunk_field, T.StructField("distance", T.DoubleType())])
    sizes = np.diff(asked.column("v").combine_chunks().offsets.to_numpy()) if len(asked) else np.zeros(0, int)
    width = int(np.bincount(sizes).argmax()) if len(sizes) else 0
    asked = asked.filter(pa.array(sizes == width))
    matrix = asked.column("v").combine_chunks().flatten().to_numpy().reshape(-1, width) if width else np.zeros((0, 0))
    names = asked.column("query_id").combine_chunks()

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = [(None, np.zeros(0))] * len(matrix)
        worst = np.full(len(matrix), np.inf)  # of the k best so far, once there are k
        squares = (matrix * matrix).sum(axis=1)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            vectors = batch.column("embedding")
            fits = (np.diff(vectors.offsets.to_numpy()) == width) & vectors.is_valid().to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(fits))
            if not width or not len(batch):
                continue
            rows = batch.column("embedding").flatten().to_numpy().reshape(-1, width).astype(float)
            rough = (rows * rows).sum(axis=1)[:, None] - 2 * (rows @ matrix.T) + squares
            last = min(k, len(rows)) - 1
            limit = np.minimum(np.partition(rough, last, axis=0)[last], worst)
            near = rough <= limit + 2e-6 * (1 + np.abs(limit))  # none that rounding could bring to the k best is left out
            for q in np.flatnonzero(near.any(axis=0)).tolist():
                which = np.flatnonzero(near[:, q])
                distances = np.round(((rows[which] - matrix[q]) ** 2).sum(axis=1), 6)
                ids = batch.column("chunk_id").take(pa.array(which))
                if held[q][0] is not None:
                    ids, distances = pa.concat_arrays([held[q][0], ids]), np.concatenate([held[q][1], distances])
                order = pc.sort_indices(pa.table({"d": distances, "i": ids}), sort_keys=[("d", "ascending"), ("i", "ascending")])[:k]
                held[q] = ids.take(order), distances[order.to_numpy()]
                if len(order) == k:
                    worst[q] = held[q][1][-1]
        for q, (ids, distances) in enumerate(held):
            if ids is not None:
                yield pa.RecordBatch.from_arrays([names.take(pa.array([q] * len(ids))), ids, pa.array(distances)], schema.names)

    return chunks.select("chunk_id", "embedding").mapInArrow(nearest, schema)


def rrf(ranked: DataFrame, k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of ``query_id, retriever, chunk_id, pos``: ``rrf_score``, ``best_rank``, ``fused_rank``.

    A repeated id keeps its first place and takes no rank; null ids count for nothing; weights default to 1.
    """
    first = ranked.filter("chunk_id IS NOT NULL").groupBy("query_id", "retriever", "chunk_id").agg(F.min("pos").alias("pos"))
    places = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "retriever").orderBy("pos", "chunk_id")))
    weight = F.lit(1.0)
    for name, value in (weights or {}).items():
        weight = F.when(F.col("retriever") == name, float(value)).otherwise(weight)
    fused = places.groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight / (k + F.col("rank"))), 9).alias("rrf_score"), F.min("rank").alias("best_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "best_rank", "chunk_id")
    return fused.withColumn("fused_rank", F.row_number().over(order))


def ranked_lists(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    return dense.select("query_id", F.lit("dense").alias("retriever"), "chunk_id", F.col("dense_rank").alias("pos")).unionByName(
        lexical.select("query_id", F.lit("bm25").alias("retriever"), "chunk_id", F.col("bm25_rank").alias("pos"))
    )


def merge_candidates(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """One row a query and chunk with both ranks, distance and score, null where a retriever lacks it."""
    return dense.join(lexical, ["query_id", "chunk_id"], "full_outer")


def hydrate(candidates: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates with their text and distance; those no longer in the store drop out and nothing takes their place."""
    rows = candidates.join(chunks.select("chunk_id", "text", "source", "embedding"), "chunk_id").join(queries.select("query_id", "query_vector"), "query_id", "left")
    own = F.round(squared_l2(F.col("embedding"), F.col("query_vector")), 6)
    return rows.withColumn("distance", F.coalesce("distance", own)).drop("embedding", "query_vector")


def rerank(candidates: DataFrame, score: Column, k: int) -> DataFrame:
    """Best ``k`` by ``score``, descending; ties and missing scores in fused order."""
    rows = candidates.withColumn("rerank_score", score)
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "fused_rank")
    return rows.withColumn("final_rank", F.row_number().over(order)).filter(F.col("final_rank") <= k)


def overlap_score(query_tokens: Column, tokens: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: the share of the query's distinct tokens that a passage has."""
    distinct = F.array_distinct(query_tokens)
    return F.when(F.size(distinct) > 0, F.round(F.size(F.array_intersect(distinct, tokens)) / F.size(distinct), 6)).otherwise(0.0)


def relevance(distance: Column, query: str = "query_id") -> Column:
    """1 - d/2 within 0 and 1 to four places; a missing distance takes the query's largest, else 1."""
    known = F.coalesce(distance, F.max(distance).over(Window.partitionBy(query)), F.lit(1.0))
    return F.round(F.greatest(F.least(1 - known / 2, F.lit(1.0)), F.lit(0.0)), 4)


def contexts(hits: DataFrame) -> DataFrame:
    """``query_id, context``: a query's passages in rank order, set apart by a rule. At most k passages a query."""
    ordered = F.sort_array(F.collect_list(F.struct("final_rank", "text")))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: F.coalesce(x["text"], F.lit(""))), "\n\n---\n\n").alias("context"))


def prompts(hits: DataFrame, queries: DataFrame, template: str) -> DataFrame:
    """``query_id, prompt``: ``template`` with ``{context}`` and ``{question}`` filled in, stripped."""
    filled = F.replace(F.lit(template), F.lit("{context}"), F.coalesce("context", F.lit("")))
    filled = F.replace(filled, F.lit("{question}"), F.col("question"))
    joined = queries.join(contexts(hits), "query_id", "left")
    return joined.select("query_id", F.regexp_replace(filled, r"\A\s+|\s+\z", "").alias("prompt"))
