"""Golden sets, review sheets, saved runs, answers and the chunk store as files."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import collapse
from millrace.operators.bm25 import file_system, swap_file
from millrace.staging import written

GOLDEN = (
    "id string, query string, language string, category string, answerable boolean, expected_answer string, act string, "
    "evidence array<struct<text:string,source:string,chunk_ids:array<string>,fact:string>>, absence_probe string, "
    "gold_chunk_ids array<string>, gold_pages array<struct<pdf:string,page:string>>"
)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLDEN).json(path).filter("id IS NOT NULL")


def golden_evidence(golden: DataFrame) -> DataFrame:
    """``query_id, fact, source, text``; evidence without a fact is a fact of its own."""
    rows = golden.select(F.col("id").alias("query_id"), F.explode("evidence").alias("e"))
    return rows.select("query_id", F.coalesce("e.fact", "e.text").alias("fact"), "e.source", "e.text")


def write_golden(golden: DataFrame, errors: DataFrame, path: str) -> bool:
    """Write the golden set as JSON lines, only if there are no errors."""
    if not errors.isEmpty():
        return False
    golden.write.mode("overwrite").json(path)
    return True


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """A review sheet as CSV; a byte-order mark before the first name is dropped."""
    sheet = spark.read.option("header", True).option("multiLine", True).csv(path)
    return sheet.withColumnRenamed(sheet.columns[0], sheet.columns[0].lstrip("﻿"))


def write_review(sheet: DataFrame, path: str) -> None:
    sheet.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def saved_runs(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Every run's ``retrieval.json`` under ``folder``, with its name and time, newest first."""
    runs = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*/retrieval.json")
    named = runs.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("run"), F.col("_metadata.file_modification_time").alias("saved"), "*")
    return named.orderBy(F.desc("saved"), "run")


def append_chunks(chunks: DataFrame, vectors: DataFrame, path: str) -> None:
    """Add chunks with their vectors to a store; lengths must agree, and white space in texts is collapsed."""
    both = written(chunks.withColumn("text", collapse(F.col("text"))).join(vectors, "chunk_id", "full_outer"), "append")
    if not both.filter("text IS NULL OR embedding IS NULL").isEmpty():
        raise ValueError("chunks and vectors don't belong together")
    both.write.mode("append").parquet(path)


def append_legacy(chunks: DataFrame, vectors: DataFrame, path: str) -> None:
    """As ``append_chunks``, by the ids and metadata of the earlier scheme: ``legacy_id`` is the key, pages are texts."""
    own = chunks.select(F.col("legacy_id").alias("chunk_id"), "text", "source", F.col("page").cast("string").alias("page"), F.col("chunk_no").cast("string").alias("chunk_id_in_page"), F.length("text").cast("string").alias("char_count"))
    append_chunks(own, vectors, path)


def not_ingested(sources: DataFrame, store: DataFrame) -> DataFrame:
    """Sources once each, without those that the store has."""
    return sources.dropDuplicates(["source"]).join(store.select("source").distinct(), "source", "left_anti")


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What of ``wanted`` is not yet done, for a run that is resumed."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


# ---------------------------------------------------------------- runs

HIT_FIELDS = ("chunk_id", "source", "page", "distance", "dense_rank", "bm25_rank", "rrf_score", "rerank_score", "final_rank")
ANSWERS = "config string, query_id string, answer string, ms double, error string"


def write_run(folder: str, settings: dict, hits: DataFrame, metrics: DataFrame, timings: DataFrame, report: str) -> None:
    """``retrieval.json`` and ``summary.md`` of a run in ``folder``, each put in place whole.

    ``hits`` has ``config, query_id, chunk_id, rank`` and what of ``HIT_FIELDS`` it knows, ``metrics`` a row for each
    config and question, ``timings`` ``config, query_id, stage, ms``. A run's results are its questions' few hits; they
    come to the driver.
    """
    spark, configs = hits.sparkSession, {}
    place = lambda r: configs.setdefault(r["config"], {}).setdefault(str(r["query_id"]), {"ranked_chunk_ids": [], "timings_ms": {}, "metrics": None, "hits": []})
    for r in hits.orderBy("config", "query_id", "rank").collect():
        held = place(r)
        held["ranked_chunk_ids"].append(r["chunk_id"])
        held["hits"].append({k: r[k] for k in HIT_FIELDS if k in hits.columns})
    for r in metrics.collect():
        place(r)["metrics"] = {k: v for k, v in r.asDict().items() if k not in ("config", "query_id")}
    for r in timings.collect():
        place(r)["timings_ms"][r["stage"]] = r["ms"]
    swap_file(spark, f"{folder}/retrieval.json", json.dumps({"config": settings, "configs": configs}, ensure_ascii=False, default=str))
    swap_file(spark, f"{folder}/summary.md", report.rstrip("\n") + "\n")


def read_text(spark: SparkSession, path: str) -> str | None:
    target, fs = file_system(spark, path)
    return spark.read.text(path, wholetext=True).first()[0] if fs.exists(target) else None


def resumed_answers(spark: SparkSession, folder: str, wanted: DataFrame, answer: Callable[[str], str], texts: str = "prompt") -> int:
    """Answers to what of ``wanted`` (``config, query_id`` and a prompt) has none yet; how many were made.

    Each is added to ``answers`` in ``folder`` as soon as it is there, so a run that breaks off loses none. What failed
    before is tried again. A run's questions are few; they come to the driver one by one.
    """
    path, made = f"{folder}/answers", 0
    target, fs = file_system(spark, path)
    done = spark.read.schema(ANSWERS).json(path) if fs.exists(target) else spark.createDataFrame([], ANSWERS)
    keyed = wanted.withColumn("query_id", F.col("query_id").cast("string"))
    for r in pending(keyed, done.filter("error IS NULL"), ["config", "query_id"]).orderBy("config", "query_id").toLocalIterator():
        began, text, error = time.time(), None, None
        try:
            text = answer(r[texts])
        except Exception as e:  # whatever a provider raises
            error = f"{type(e).__name__}: {e}"
        line = {"config": r["config"], "query_id": r["query_id"], "answer": text, "ms": (time.time() - began) * 1000, "error": error}
        swap_file(spark, f"{path}/{uuid.uuid4().hex}.json", json.dumps(line, ensure_ascii=False))
        made += 1
    return made


def export_report(spark: SparkSession, folder: str, golden: DataFrame, path: str) -> dict:
    """One JSON file for a report: the golden set and every run under ``folder``, newest first, without texts of hits.

    Answers go with the runs that have some. ``default_run`` is the newest run with answers, else the newest.
    """
    runs = []
    root, fs = file_system(spark, folder)
    for status in fs.listStatus(root) if fs.exists(root) else []:
        name = status.getPath().getName()
        text = read_text(spark, f"{folder}/{name}/retrieval.json")
        if text is None:
            continue
        saved, _ = file_system(spark, f"{folder}/{name}/retrieval.json")
        run = json.loads(text)
        slim = {c: {q: {**{k: e.get(k) for k in ("ranked_chunk_ids", "timings_ms", "metrics")}, "hits": [{k: h.get(k) for k in HIT_FIELDS} for h in e.get("hits", [])]} for q, e in per.items()} for c, per in run["configs"].items()}
        answers: dict = {}
        there, _ = file_system(spark, f"{folder}/{name}/answers")
        if fs.exists(there):
            for r in spark.read.schema(ANSWERS).json(f"{folder}/{name}/answers").collect():
                if r.error is None or r.query_id not in answers.get(r.config, {}):
                    answers.setdefault(r.config, {})[r.query_id] = {"answer": r.answer, "ms": r.ms, "error": r.error}
        runs.append({"name": name, "modified": fs.getFileStatus(saved).getModificationTime(), "config": run.get("config", {}), "configs": slim, "answers": answers or None})
    runs.sort(key=lambda r: (-r["modified"], r["name"]))
    default = next((r["name"] for r in runs if r["answers"]), runs[0]["name"] if runs else None)
    data = {"golden": [json.loads(x) for x in golden.toJSON().collect()], "runs": runs, "default_run": default}
    swap_file(spark, path, json.dumps(data, ensure_ascii=False, separators=(",", ":")))
    return data


def with_golden(runs: DataFrame, golden: DataFrame) -> DataFrame:
    """Rows of runs (``query_id``) with what the golden set says of their question; questions that it lacks stay."""
    known = golden.select(F.col("id").alias("query_id"), "query", "language", "category", "answerable", "gold_chunk_ids")
    return runs.join(known, "query_id", "left")
