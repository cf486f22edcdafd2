"""Entry points for spark-submit: ``python -m millrace.cli COMMAND ...``.

ingest       PDF files of a folder to a chunk store, those that it lacks, and the BM25 index brought up to it
build-index  bring a BM25 index up to a chunk table, build it anew (--rebuild) or only tell the drift (--check)
fingerprint  figures that tell two chunk tables apart, optionally compared with saved ones
search       best chunks for a file of questions (JSON lines of query_id, question)
golden       find a golden set's evidence in the chunks; tell errors and drift, write it anew (--write)
evaluate     run retrieval over a golden set and write retrieval.json, summary.md and a review sheet; or sum up a filled one
report       all runs of a folder and the golden set as one JSON file

Models are given as MODULE:NAME of what makes them.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace.config import RetrievalConfig
from millrace.functions import text as tx
from millrace.operators import bm25, chunking, evaluation, models, postings
from millrace.plans import runs
from millrace.plans.retriever import HybridRetriever, prepared_index
from millrace.sources import files, pdf
from millrace.staging import written


def named(spec: str | None) -> Callable | None:
    """What ``module:name`` names."""
    if not spec:
        return None
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="millrace", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = out.add_subparsers(dest="command", required=True)
    ingest_ = commands.add_parser("ingest")
    ingest_.add_argument("--data-dir", default="data")
    ingest_.add_argument("--db-path")
    ingest_.add_argument("--collection")
    for name, value in (("--chunk-size", chunking.SIZE), ("--chunk-overlap", chunking.OVERLAP), ("--min-chunk-size", chunking.MIN_CHARS), ("--max-chunks", 40_000)):
        ingest_.add_argument(name, type=int, default=value)
    ingest_.add_argument("--parser", required=True, help="MODULE:NAME of a function from a file's bytes to its pages' texts")
    ingest_.add_argument("--ocr", action="append", default=[], help="MODULE:NAME of a function from bytes and page number to a text")
    ingest_.add_argument("--encoder", required=True)
    build = commands.add_parser("build-index")
    build.add_argument("chunks")
    build.add_argument("index")
    build.add_argument("--subword", choices=tx.SUBWORDS, default="prefix")
    how = build.add_mutually_exclusive_group()
    how.add_argument("--rebuild", action="store_true")
    how.add_argument("--check", action="store_true")
    prints = commands.add_parser("fingerprint")
    prints.add_argument("chunks")
    prints.add_argument("--save")
    prints.add_argument("--compare")
    search_ = commands.add_parser("search")
    for name in ("chunks", "index", "questions", "out"):
        search_.add_argument(name)
    golden_ = commands.add_parser("golden")
    golden_.add_argument("golden")
    golden_.add_argument("chunks")
    golden_.add_argument("--write", metavar="PATH")
    golden_.add_argument("--show", action="store_true")
    evaluate_ = commands.add_parser("evaluate")
    for name in ("--golden", "--chunks", "--out-dir", "--encoder", "--reranker", "--score-review"):
        evaluate_.add_argument(name)
    evaluate_.add_argument("--sweeps", action="store_true")
    report_ = commands.add_parser("report")
    for name in ("runs", "golden", "out"):
        report_.add_argument(name)
    return out


def ingest(spark: SparkSession, args: argparse.Namespace) -> int:
    given = {k: v for k, v in (("store_path", args.db_path), ("collection", args.collection)) if v}
    config = RetrievalConfig.from_env(**given)
    known, fs = bm25.file_system(spark, config.store_path)
    found = pdf.find_pdfs(spark, args.data_dir)
    if fs.exists(known):
        found = found.join(spark.read.parquet(config.store_path).select("source").distinct(), "source", "left_anti")
    pages = pdf.clean_pages(pdf.extract_pages(found, named(args.parser), tuple(named(o) for o in args.ocr)))
    pages = written(pages, "pages")
    for row in pages.filter("error IS NOT NULL").select("source", "error").collect():
        print(f"{row.source}: {row.error}", file=sys.stderr)
    blocks = chunking.merge_short_pages(pages.filter("error IS NULL"), args.min_chunk_size)
    blocks = blocks.select("source", "block", chunking.page_label(F.col("pages"), F.col("is_merged")).alias("page"), "text")
    cut = written(chunking.chunk_pages(blocks, args.chunk_size, args.chunk_overlap, args.min_chunk_size), "cut")
    chunking.check_limit(cut, args.max_chunks)
    chunks = written(chunking.chunk_ids(cut).join(cut.select("source", "chunk_no", "text", "method", "char_count"), ["source", "chunk_no"]), "chunks")
    if not chunks.isEmpty():
        files.append_chunks(chunks, chunks.select("chunk_id", models.encode(F.col("text"), named(args.encoder)).alias("embedding")), config.store_path)
        prepared_index(spark.read.parquet(config.store_path), config)
    print(json.dumps({"pdfs": pages.select("source").distinct().count(), "pages": pages.filter("error IS NULL").count(), "chunks": chunks.count()}))
    return 0


def golden(spark: SparkSession, args: argparse.Namespace) -> int:
    saved, chunks = files.read_golden(spark, args.golden), spark.read.parquet(args.chunks)
    resolved, errors = runs.resolved_golden(saved, chunks)
    resolved, errors = resolved.persist(), errors.persist()
    for r in resolved.orderBy("id").collect():  # the golden set
        print(f"{r.id} [{r.language}] {r.category} gold={len(r.gold_chunk_ids)} pages={', '.join(f'{p.pdf}:{p.page}' for p in r.gold_pages) or '-'}")
    if args.show:
        shown = resolved.select("id", F.explode("gold_chunk_ids").alias("chunk_id")).join(chunks.select("chunk_id", F.substring("text", 1, 220).alias("start")), "chunk_id")
        for r in shown.orderBy("id", "chunk_id").collect():
            print(f"    - {r.id} {r.chunk_id}: {r.start!r}")
    wrong = [f"ERROR {r.id}: {r.error}" for r in errors.orderBy("id", "error").collect()]
    drift = [r.id for r in runs.drifted(saved, resolved).orderBy("id").collect()]
    print("\n".join([*wrong, *([f"not as saved: {', '.join(drift)}"] if drift else [])]))
    if args.write:
        return int(not files.write_golden(resolved.orderBy("id").coalesce(1), errors, args.write))
    return int(bool(wrong or drift))


def evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.score_review:
        sheet = files.read_review(spark, args.score_review)
        fields = [c for c in ("correct", "complete", "grounded", "cited", "language_ok", "abstained") if c in sheet.columns]
        scores = evaluation.review_scores(sheet.withColumn("answerable", F.lower("answerable") == "true"), fields, "abstained")
        print(evaluation.to_markdown(scores.orderBy("config", "field"), "Review"))
        return 0
    if not (args.golden and args.chunks and args.out_dir):
        raise SystemExit("evaluate needs --golden, --chunks and --out-dir, or --score-review")
    encoder, reranker = named(args.encoder), named(args.reranker)
    metrics = runs.evaluate(files.read_golden(spark, args.golden), spark.read.parquet(args.chunks), RetrievalConfig.from_env(), args.out_dir, encoder, reranker, args.sweeps)
    print(evaluation.to_markdown(evaluation.summarize(metrics).orderBy("config"), "All answerable questions"))
    return 0


def report(spark: SparkSession, args: argparse.Namespace) -> int:
    data = files.export_report(spark, args.runs, files.read_golden(spark, args.golden), args.out)
    print(f"{len(data['runs'])} runs, by default {data['default_run']}")
    return 0


def build_index(spark: SparkSession, args: argparse.Namespace) -> int:
    chunks = spark.read.parquet(args.chunks)
    version, tokens = tx.tokenizer_version(args.subword), tx.tokenize(F.col("text"), args.subword)
    known = None if args.rebuild else postings.load(spark, args.index, version)
    if known is None:
        if args.check:
            print("no index of this kind")
            return 1
        postings.create(chunks, tokens, args.index, version)
        return 0
    counts = bm25.diff_counts(postings.drift(known, chunks)).first().asDict()
    print(json.dumps(counts))
    changed = any(counts[k] for k in ("added", "updated", "removed"))
    if args.check:
        return int(changed)
    if changed:
        postings.sync(known, chunks, tokens)
    return 0


def fingerprint(spark: SparkSession, args: argparse.Namespace) -> int:
    own = bm25.fingerprint(spark.read.parquet(args.chunks))
    print(json.dumps(own.first().asDict()))
    if args.save:
        own.write.mode("overwrite").json(args.save)
    if args.compare:
        other = bm25.compare_fingerprints(own, spark.read.json(args.compare))
        print("the same" if not other else "different: " + ", ".join(other))
        return int(bool(other))
    return 0


def search(spark: SparkSession, args: argparse.Namespace) -> int:
    config = RetrievalConfig.from_env()
    index = postings.load(spark, args.index, tx.tokenizer_version())
    retriever = HybridRetriever(spark.read.parquet(args.chunks), index, config=config)
    result = retriever.retrieve(spark.read.schema("query_id string, question string").json(args.questions))
    result.candidates.write.mode("overwrite").json(args.out)
    for warning in result.warnings:
        print(warning, file=sys.stderr)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"millrace {args.command}").getOrCreate()
    return {"build-index": build_index, "fingerprint": fingerprint, "search": search, "ingest": ingest, "golden": golden, "evaluate": evaluate, "report": report}[args.command](spark, args)


if __name__ == "__main__":
    sys.exit(main())
