"""A saved BM25 index: postings in files by term bucket, brought up to date by segments.

``HEAD.json`` names the segments, oldest first, and the figures of the whole. A segment has ``docs`` (hash and length of
its chunks), ``postings`` (in folders by bucket of the term) and ``dead``, the chunks whose rows in earlier segments
no longer count. A search opens the buckets of its terms and no others; an update writes what has changed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import bm25
from millrace.staging import remove

FORMAT = 3
BUCKETS = 32
SPREAD = 100_000  # chunks for each part of a bucket, so that a word that nearly all chunks have is not written by one task
COMPACT = 16  # segments from which an update writes them anew as one


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class SavedIndex:
    spark: SparkSession
    path: str
    version: str
    collection: str = ""
    k1: float = 1.2
    b: float = 0.75
    buckets: int = BUCKETS
    n: int = 0
    total: int = 0
    segments: tuple[str, ...] = field(default=())

    def _read(self, kind: str) -> DataFrame:
        """All segments' tables of a kind, with the segment's place."""
        read = self.spark.read
        if kind == "postings":  # a segment of empty chunks has no file that would tell the columns
            key = self.spark.read.parquet(f"{self.path}/{self.segments[0]}/docs").schema["chunk_id"].dataType.simpleString()
            read = read.schema(f"term string, chunk_id {key}, tf long, doc_len long, bucket int")
        parts = [read.parquet(f"{self.path}/{s}/{kind}").withColumn("place", F.lit(i)) for i, s in enumerate(self.segments)]
        return reduce(DataFrame.unionByName, parts)

    def _live(self, rows: DataFrame) -> DataFrame:
        if len(self.segments) < 2:
            return rows.drop("place")
        dead = self._read("dead").groupBy("chunk_id").agg(F.max("place").alias("until")).withColumnRenamed("chunk_id", "gone")
        kept = rows.join(dead, (F.col("chunk_id") == F.col("gone")) & (F.col("place") < F.col("until")), "left_anti")
        return kept.drop("place")

    @property
    def docs(self) -> DataFrame:
        """``chunk_id, content_hash, doc_len`` of what is in the index."""
        return self._live(self._read("docs"))

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """``term, chunk_id, tf, doc_len``, of the ``terms`` in that column only, whose buckets alone are read."""
        rows = self._read("postings")
        if terms is not None:
            asked = terms.select("term").distinct()
            buckets = [r[0] for r in asked.select(term_bucket(F.col("term"), self.buckets)).distinct().collect()]  # no more than there are buckets
            rows = rows.filter(F.col("bucket").isin(buckets)).join(asked, "term", "left_semi")
        return self._live(rows.drop("bucket"))

    def search(self, query_tokens: DataFrame, k: int) -> DataFrame:
        """As ``bm25.search``, for ``query_id, tokens``."""
        rows = self.postings(query_tokens.select(F.explode("tokens").alias("term")))
        known = bm25.document_frequencies(rows).select("term", bm25.idf(F.col("df"), F.lit(self.n)).alias("idf"))
        factors = {r.term: r.idf for r in known.collect()}  # terms of the questions
        share = F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("doc_len") / (self.total / self.n if self.total else 1.0)))
        return bm25.search(rows.select("term", "chunk_id", share.alias("weight")), query_tokens, k, factors)

    @property
    def empty(self) -> bool:
        return self.n == 0


def create(chunks: DataFrame, tokens: Column, path: str, version: str, collection: str = "", k1: float = 1.2, b: float = 0.75, buckets: int = BUCKETS) -> SavedIndex:
    """An index of ``chunk_id, text`` at ``path``; one that is there already is replaced once the new one is whole."""
    empty = SavedIndex(chunks.sparkSession, path, version, collection, k1, b, buckets)
    return _commit(empty, bm25.token_lists(chunks, tokens), None)


def load(spark: SparkSession, path: str, version: str, collection: str = "") -> SavedIndex | None:
    """The saved index, or None if it is missing, unreadable or made with other settings, and so must be built anew."""
    pointer, fs = bm25.file_system(spark, f"{path}/HEAD.json")
    if not fs.exists(pointer):
        return None
    try:
        head = json.loads("".join(r.value for r in spark.read.text(f"{path}/HEAD.json").collect()))
        if (head["format"], head["tokenizer"], head["collection"]) != (FORMAT, version, collection):
            return None
        return SavedIndex(spark, path, version, collection, head["k1"], head["b"], head["buckets"], head["n"], head["total"], tuple(head["segments"]))
    except (ValueError, KeyError):
        return None


def sync(index: SavedIndex, chunks: DataFrame, tokens: Column) -> tuple[SavedIndex, DataFrame]:
    """The index brought up to ``chunks``: what is new or changed is tokenised and written; and the changes."""
    changes = drift(index, chunks)
    fresh = chunks.join(changes.filter("status IN ('added', 'updated')"), "chunk_id", "left_semi")
    return _commit(index, bm25.token_lists(fresh, tokens), changes.filter("status IN ('removed', 'updated')").select("chunk_id")), changes


def drift(index: SavedIndex, chunks: DataFrame) -> DataFrame:
    return bm25.diff(index.docs, chunks.select("chunk_id", tx.content_hash(F.col("text")).alias("content_hash")))


def put(index: SavedIndex, chunks: DataFrame, tokens: Column) -> SavedIndex:
    """Add ``chunks``, or replace those of the same ids; chunks that are there with the same text cost nothing more."""
    hashed = chunks.withColumn("content_hash", tx.content_hash(F.col("text")))
    same = index.docs.select("chunk_id", F.col("content_hash").alias("was"))
    fresh = hashed.join(same, (hashed["chunk_id"] == same["chunk_id"]) & (F.col("content_hash") == F.col("was")), "left_anti")
    return _commit(index, bm25.token_lists(fresh, tokens), fresh.select("chunk_id"))


def remove_chunks(index: SavedIndex, ids: DataFrame) -> SavedIndex:
    """Take the chunks with these ``chunk_id`` out."""
    none = index.docs.limit(0).select("chunk_id", "content_hash", F.array().cast("array<string>").alias("tokens"))
    return _commit(index, none, ids.select("chunk_id"))


def compact(index: SavedIndex) -> SavedIndex:
    """The same index as one segment."""
    name = f"s-{uuid.uuid4().hex}"
    index.docs.write.parquet(f"{index.path}/{name}/docs")
    index.docs.select("chunk_id").limit(0).write.parquet(f"{index.path}/{name}/dead")
    _write_postings(index.postings(), index, name)
    return _point(index, (name,), index.n, index.total)


def vacuum(index: SavedIndex) -> None:
    """Remove what the pointer no longer names; searches that began before must have ended."""
    folder, fs = bm25.file_system(index.spark, index.path)
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("s-") and name not in index.segments:
            fs.delete(status.getPath(), True)


def _commit(index: SavedIndex, fresh: DataFrame, dead: DataFrame | None) -> SavedIndex:
    """A segment of ``chunk_id, content_hash, tokens``, with ``dead`` chunks of earlier ones; None starts anew."""
    spark, name = index.spark, f"s-{uuid.uuid4().hex}"
    folder = f"{index.path}/{name}"
    fresh.write.parquet(f"{folder}/tokens")  # tokenised once for what follows
    held = spark.read.schema(fresh.schema).parquet(f"{folder}/tokens")
    if dead is not None:
        dead.write.parquet(f"{folder}/dead")
        if held.isEmpty() and spark.read.parquet(f"{folder}/dead").isEmpty():
            remove(spark, folder)
            return index
    held.select("chunk_id", "content_hash", F.size("tokens").cast("long").alias("doc_len")).write.parquet(f"{folder}/docs")
    _write_postings(bm25.counted_postings(bm25.counted(held)), index, name)
    remove(spark, f"{folder}/tokens")
    segments = (name,) if dead is None else (*index.segments, name)
    if dead is None:
        held.select("chunk_id").limit(0).write.parquet(f"{folder}/dead")
    draft = SavedIndex(spark, index.path, index.version, index.collection, index.k1, index.b, index.buckets, 0, 0, segments)
    n, total = draft.docs.agg(F.count("*"), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
    done = _point(draft, segments, n, total)
    return compact(done) if len(segments) > COMPACT else done


def _write_postings(rows: DataFrame, index: SavedIndex, name: str) -> None:
    bucket = term_bucket(F.col("term"), index.buckets)
    parts = 1 + index.spark.read.parquet(f"{index.path}/{name}/docs").count() // SPREAD
    dealt = rows.select(bucket.alias("bucket"), "term", "chunk_id", "tf", "doc_len").repartition(index.buckets * parts, "bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)))
    dealt.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{index.path}/{name}/postings")


def _point(index: SavedIndex, segments: tuple[str, ...], n: int, total: int) -> SavedIndex:
    """Swap the pointer: readers see the index as it was or as it is, whole."""
    spark = index.spark
    head = {"format": FORMAT, "tokenizer": index.version, "collection": index.collection, "k1": index.k1, "b": index.b, "buckets": index.buckets, "n": n, "total": total, "segments": segments}
    bm25.swap_file(spark, f"{index.path}/HEAD.json", json.dumps(head))
    return SavedIndex(spark, index.path, index.version, index.collection, index.k1, index.b, index.buckets, n, total, segments)
