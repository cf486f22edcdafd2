"""A whole evaluation run: golden set in, retrieved candidates, metrics, report and files out; and the golden set itself."""

from __future__ import annotations

import dataclasses
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.config import RetrievalConfig
from millrace.operators import evaluation
from millrace.operators.models import Encoder, Reranker
from millrace.plans.retriever import build_retriever
from millrace.sources import files

HITS = ["config", "query_id", "chunk_id", "rank", "final_rank", "source", "page", "distance", "dense_rank", "bm25_rank", "rrf_score", "rerank_score"]


def resolved_golden(golden: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The golden set with the chunks and pages that its evidence is in, and what is wrong with it as ``id, error``.

    A chunk comes with the first piece of evidence that it contains, chunks of one piece by id. Evidence that no
    chunk contains is an error, as is an absence probe that matches and an answerable question without a chunk.
    """
    pieces = golden.select(F.col("id").alias("query_id"), F.posexplode("evidence").alias("pos", "e"))
    found = evaluation.resolve_gold(pieces.select("query_id", F.col("pos").alias("fact"), "e.source", "e.text"), chunks)
    by_piece = found.groupBy("query_id", "fact").agg(F.sort_array(F.collect_set("chunk_id")).alias("ids"))
    held = pieces.join(by_piece.withColumnRenamed("fact", "pos"), ["query_id", "pos"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    evidence = held.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "e", "ids"))).alias("x"))
    whole = F.transform("x", lambda x: F.struct(x["e"]["text"].alias("text"), x["e"]["source"].alias("source"), x["ids"].alias("chunk_ids"), x["e"]["fact"].alias("fact")))
    ids = F.array_distinct(F.flatten(F.transform("x", lambda x: x["ids"])))
    pages = found.select("query_id", "chunk_id").distinct().join(chunks.select("chunk_id", "source", F.col("page").cast("string").alias("page")), "chunk_id")
    pages = pages.groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct(F.col("source").alias("pdf"), "page"))).alias("found_pages"))
    now = golden.join(evidence.select(F.col("query_id").alias("q"), whole.alias("found_evidence"), ids.alias("found_ids")), F.col("id") == F.col("q"), "left").drop("q")
    now = now.join(pages, F.col("id") == F.col("query_id"), "left").drop("query_id")
    changed = {
        "evidence": F.coalesce("found_evidence", "evidence"), "gold_chunk_ids": F.coalesce("found_ids", F.array().cast("array<string>")),
        "gold_pages": F.coalesce("found_pages", F.array().cast("array<struct<pdf:string,page:string>>")),
    }
    out = now.select(*[changed.get(c, F.col(c)).alias(c) for c in golden.columns])
    lost = held.filter(F.size("ids") == 0).select(F.col("query_id").alias("id"), F.concat(F.lit("evidence not found: "), F.substring("e.text", 1, 60)).alias("error"))
    probes = golden.filter("coalesce(absence_probe, '') <> ''").select(F.col("id").alias("query_id"), F.col("absence_probe").alias("probe"))
    broken = evaluation.violated_probes(probes, chunks).select(F.col("query_id").alias("id"), F.lit("the absence probe matches").alias("error"))
    bare = out.filter(F.col("answerable") & (F.size("gold_chunk_ids") == 0)).select("id", F.lit("answerable, but no chunk has its evidence").alias("error"))
    return out, reduce(DataFrame.unionByName, [lost, broken, bare])


def drifted(golden: DataFrame, resolved: DataFrame) -> DataFrame:
    """Questions whose saved chunks or pages are not those found."""
    now = resolved.select(F.col("id").alias("i"), F.col("gold_chunk_ids").alias("c"), F.col("gold_pages").alias("p"))
    both = golden.join(now, F.col("id") == F.col("i"))
    return both.filter(~F.col("gold_chunk_ids").eqNullSafe(F.col("c")) | ~F.col("gold_pages").eqNullSafe(F.col("p"))).select("id")


def evaluate(golden: DataFrame, chunks: DataFrame, config: RetrievalConfig, out: str, encoder: Callable[[], Encoder] | None = None, reranker: Callable[[], Reranker] | None = None, sweeps: bool = False) -> DataFrame:
    """Run every configuration that the given models allow, write the run to ``out`` and return its metrics.

    With an encoder: dense alone, and fused with BM25; with a reranker too, the fused ones reranked; without an encoder
    BM25 alone. ``sweeps`` adds depths and constants of the fusion, and depths of reranking.
    """
    spark = golden.sparkSession
    questions = golden.select(F.col("id").alias("query_id"), F.col("query").alias("question"), "language", "category", "answerable")
    plain = dataclasses.replace(config, rerank_enabled=False)
    kinds = {"A_dense": dataclasses.replace(plain, mode="dense"), "B_hybrid": dataclasses.replace(plain, mode="hybrid")} if encoder else {"BM25": dataclasses.replace(plain, mode="bm25")}
    if encoder and reranker:
        kinds["C_hybrid_rerank"] = dataclasses.replace(config, mode="hybrid", rerank_enabled=True)
    rows, times, told = [], [], []
    for name, own in kinds.items():
        began = time.time()
        found = build_retriever(chunks, own, encoder, reranker).retrieve(questions.select("query_id", "question"))
        page = chunks.select("chunk_id", F.col("page").cast("string").alias("page"))
        hits = found.candidates.join(page, "chunk_id", "left").withColumns({"config": F.lit(name), "rank": F.col("final_rank")}).select(*HITS).persist()
        hits.count()
        rows.append(hits)
        times += [(name, stage, ms) for stage, ms in {**found.timings_ms, "total": (time.time() - began) * 1000}.items()]
        told += [f"- {name}: {w}" for w in found.warnings]
    hits = reduce(DataFrame.unionByName, rows)
    pieces = golden.select(F.col("id").alias("query_id"), F.explode("evidence").alias("e"))
    gold = pieces.select("query_id", F.coalesce("e.fact", "e.text").alias("fact"), F.explode("e.chunk_ids").alias("chunk_id")).distinct()
    gold = gold.join(chunks.select("chunk_id", "source"), "chunk_id")
    keys = chunks.select("chunk_id", F.concat_ws("|", "source", F.col("page").cast("string")).alias("page_key"))
    metrics = evaluation.question_metrics(hits.select("config", "query_id", "chunk_id", "rank"), gold, keys).persist()
    n = questions.count()
    timings = spark.createDataFrame(times, "config string, stage string, ms double").join(questions.select("query_id")).select("config", "query_id", "stage", (F.col("ms") / n).alias("ms"))  # a batch's time, by its questions
    lines = [evaluation.to_markdown(evaluation.summarize(metrics).orderBy("config"), "All answerable questions")]
    split = evaluation.breakdowns(metrics, questions)
    lines += [evaluation.to_markdown(split.filter(f"no_{other} = 1 AND no_{own} = 0").drop(other, "no_category", "no_language").orderBy("config", own), f"By {own}") for own, other in (("category", "language"), ("language", "category"))]
    lines.append(evaluation.to_markdown(evaluation.rank_pivot(metrics, list(kinds)).orderBy("query_id"), "First gold rank"))
    lines.append(evaluation.to_markdown(evaluation.latency(timings).orderBy("config", "stage"), "Time a question (ms, its share of a batch)"))
    if "C_hybrid_rerank" in kinds:
        lines.append(evaluation.to_markdown(evaluation.top_scores(rows[-1], questions.select("query_id", "answerable")), "Top rerank score"))
    if sweeps and encoder:
        deep = dataclasses.replace(plain, mode="hybrid", dense_k=50, bm25_k=50, final_top_k=100)
        found = build_retriever(chunks, deep, encoder).retrieve(questions.select("query_id", "question")).candidates
        lists = [found.filter(f"{c} IS NOT NULL").select("query_id", F.lit(name).alias("retriever"), "chunk_id", F.col(c).alias("pos")) for name, c in (("dense", "dense_rank"), ("bm25", "bm25_rank"))]
        lines.append(evaluation.to_markdown(evaluation.sweep_rrf(lists[0].unionByName(lists[1]), gold, [10, 20, 30, 50], [10, 30, 60, 100]).orderBy("depth", "k"), "Depth and constant of the fusion"))
        if reranker:
            depths = [build_retriever(chunks, dataclasses.replace(config, mode="hybrid", rerank_candidates=d), encoder, reranker).retrieve(questions.select("query_id", "question")).candidates.select(F.lit(f"top {d}").alias("config"), "query_id", "chunk_id", F.col("final_rank").alias("rank")) for d in (10, 20, 30)]
            lines.append(evaluation.to_markdown(evaluation.summarize(evaluation.question_metrics(reduce(DataFrame.unionByName, depths), gold, keys)).orderBy("config"), "Rerank depth"))
    report = "\n\n".join(["# Retrieval run", *lines, *(["### Warnings", "\n".join(told)] if told else [])])
    files.write_run(out, dataclasses.asdict(config), hits, metrics, timings, report)
    sheet = questions.join(spark.createDataFrame([(k,) for k in kinds], "config string")).select("query_id", "config", "question", "answerable", *[F.lit("").alias(c) for c in ("correct", "abstained", "notes")])
    files.write_review(sheet.orderBy("query_id", "config").coalesce(1), f"{out}/manual_review")
    return metrics
