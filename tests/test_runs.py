"""Commands and whole runs over small files: ingest, golden set, evaluation, report, answers."""

import json
import sys
import types

import pytest
from pyspark.sql import functions as F

from millrace import cli
from millrace.config import RetrievalConfig
from millrace.operators import models
from millrace.plans import runs
from millrace.plans.retriever import build_retriever
from millrace.sources import files

CHUNKS = [
    ("c1", "The ferry leaves at noon from the old pier", "isle.pdf", "1"), ("c2", "Tickets for the ferry cost nine shillings", "isle.pdf", "2"),
    ("c3", "Sheep graze behind the lighthouse wall", "hill.pdf", "1"), ("c4", "The old pier was rebuilt in granite", "hill.pdf", "3"),
]
GOLDEN = [
    {"id": "q1", "query": "when does the ferry leave", "language": "en", "category": "factual", "answerable": True, "evidence": [{"text": "LEAVES  at noon", "source": "isle.pdf"}, {"text": "old pier", "fact": "pier"}]},
    {"id": "q2", "query": "what does a ticket cost", "language": "en", "category": "factual", "answerable": True, "evidence": [{"text": "nine shillings"}]},
    {"id": "q3", "query": "who keeps bees", "language": "mixed", "category": "unanswerable", "answerable": False, "evidence": [], "absence_probe": "bee(s|hive)"},
]


@pytest.fixture
def store(spark, tmp_path):
    rows = spark.createDataFrame(CHUNKS, "chunk_id string, text string, source string, page string")
    path = f"file://{tmp_path}/chunks"
    rows.withColumn("embedding", models.encode(F.col("text"), models.HashEncoder)).write.parquet(path)
    (tmp_path / "golden.jsonl").write_text("\n".join(map(json.dumps, GOLDEN)) + "\n")
    return spark.read.parquet(path)


def test_golden_set(spark, store, tmp_path, capsys):
    golden = files.read_golden(spark, f"file://{tmp_path}/golden.jsonl")
    resolved, errors = runs.resolved_golden(golden, store)
    got = {r.id: r for r in resolved.collect()}
    assert got["q1"].gold_chunk_ids == ["c1", "c4"] and [tuple(p) for p in got["q1"].gold_pages] == [("hill.pdf", "3"), ("isle.pdf", "1")]
    assert [e.chunk_ids for e in got["q1"].evidence] == [["c1"], ["c1", "c4"]] and got["q3"].gold_chunk_ids == [] and errors.count() == 0
    assert sorted(r.id for r in runs.drifted(golden, resolved).collect()) == ["q1", "q2", "q3"]
    out = f"file://{tmp_path}/golden2"
    assert cli.main(["golden", f"file://{tmp_path}/golden.jsonl", f"file://{tmp_path}/chunks", "--show", "--write", out]) == 0 and "c4" in capsys.readouterr().out
    again = files.read_golden(spark, out)
    assert runs.drifted(again, runs.resolved_golden(again, store)[0]).count() == 0 and cli.main(["golden", out, f"file://{tmp_path}/chunks"]) == 0
    bad = [{**GOLDEN[0], "evidence": [{"text": "never said"}]}, {**GOLDEN[2], "absence_probe": "SHEEP"}]
    (tmp_path / "bad.jsonl").write_text("\n".join(map(json.dumps, bad)))
    wrong = runs.resolved_golden(files.read_golden(spark, f"file://{tmp_path}/bad.jsonl"), store)[1].collect()
    assert sorted((r.id, r.error.split()[0]) for r in wrong) == [("q1", "answerable,"), ("q1", "evidence"), ("q3", "the")]
    assert cli.main(["golden", f"file://{tmp_path}/bad.jsonl", f"file://{tmp_path}/chunks", "--write", out]) == 1


def test_a_run_and_its_report(spark, store, tmp_path, monkeypatch):
    golden, _ = runs.resolved_golden(files.read_golden(spark, f"file://{tmp_path}/golden.jsonl"), store)
    golden.coalesce(1).write.json(f"file://{tmp_path}/g")
    monkeypatch.setenv("BM25_INDEX_PATH", f"file://{tmp_path}/index")
    folder = f"file://{tmp_path}/runs/one"
    spec = ["--golden", f"file://{tmp_path}/g", "--chunks", f"file://{tmp_path}/chunks", "--out-dir", folder]
    assert cli.main(["evaluate", *spec, "--encoder", "millrace.operators.models:HashEncoder", "--reranker", "millrace.operators.models:OverlapReranker", "--sweeps"]) == 0
    run = json.loads((tmp_path / "runs" / "one" / "retrieval.json").read_text())
    assert set(run["configs"]) == {"A_dense", "B_hybrid", "C_hybrid_rerank"} and run["config"]["dense_k"] == 30
    first = run["configs"]["B_hybrid"]["q1"]
    assert first["ranked_chunk_ids"][0] in ("c1", "c2") and first["metrics"]["hit_10"] == 1 and "total" in first["timings_ms"] and first["hits"][0]["source"]
    said = (tmp_path / "runs" / "one" / "summary.md").read_text()
    assert all(x in said for x in ("All answerable", "By category", "By language", "First gold rank", "Rerank depth", "Depth and constant", "Top rerank score"))
    wanted = spark.createDataFrame([("B_hybrid", q, f"ask {q}") for q in ("q1", "q2", "q3")], "config string, query_id string, prompt string")

    def answer(prompt):
        if prompt.endswith("q2"):
            raise ValueError("down")
        return prompt.upper()

    assert files.resumed_answers(spark, folder, wanted, answer) == 3 and files.resumed_answers(spark, folder, wanted, lambda p: "late") == 1 and files.resumed_answers(spark, folder, wanted, answer) == 0
    (tmp_path / "runs" / "two").mkdir()
    (tmp_path / "runs" / "two" / "retrieval.json").write_text(json.dumps({"configs": {"A_dense": {"q9": {"ranked_chunk_ids": ["c1"], "hits": [{"chunk_id": "c1", "text": "long"}]}}}}))
    assert cli.main(["report", f"file://{tmp_path}/runs", f"file://{tmp_path}/g", f"file://{tmp_path}/report.json"]) == 0
    report = json.loads((tmp_path / "report.json").read_text())
    assert report["default_run"] == "one" and len(report["golden"]) == 3 and {r["name"] for r in report["runs"]} == {"one", "two"}
    by = {r["name"]: r for r in report["runs"]}
    assert by["one"]["answers"]["B_hybrid"]["q2"]["answer"] == "late" and by["two"]["answers"] is None and "text" not in by["two"]["configs"]["A_dense"]["q9"]["hits"][0]
    joined = files.with_golden(spark.createDataFrame([("q1",), ("q9",)], "query_id string"), golden).orderBy("query_id").collect()
    assert joined[0].category == "factual" and joined[1].category is None
    (tmp_path / "sheet.csv").write_text("config,answerable,correct,abstained\nA,True,y,\nA,False,,yes\n")
    assert cli.main(["evaluate", "--score-review", f"file://{tmp_path}/sheet.csv"]) == 0
    with pytest.raises(SystemExit):
        cli.main(["evaluate"])


def test_ingest(spark, tmp_path, monkeypatch, capsys):
    tool = types.ModuleType("tool_of_test")
    tool.parse = lambda content: content.decode().split("|")
    monkeypatch.setitem(sys.modules, "tool_of_test", tool)
    monkeypatch.setattr(cli, "named", lambda spec: {"p": tool.parse, "e": models.HashEncoder}[spec])
    monkeypatch.setenv("BM25_INDEX_PATH", f"file://{tmp_path}/index")
    (tmp_path / "pdfs").mkdir()
    (tmp_path / "pdfs" / "a.pdf").write_text("First page about walls. " * 20 + "|" + "Second page about gates. " * 30)
    spec = ["ingest", "--data-dir", f"file://{tmp_path}/pdfs", "--db-path", f"file://{tmp_path}/store", "--parser", "p", "--encoder", "e", "--chunk-size", "300", "--chunk-overlap", "50", "--min-chunk-size", "100"]
    assert cli.main(spec) == 0 and json.loads(capsys.readouterr().out)["pages"] == 2
    held = spark.read.parquet(f"file://{tmp_path}/store")
    n = held.count()
    assert n >= 4 and held.select("chunk_id").distinct().count() == n and {len(r.embedding) for r in held.collect()} == {16}
    (tmp_path / "pdfs" / "b.pdf").write_text("Another file about towers. " * 20)
    assert cli.main(spec) == 0 and json.loads(capsys.readouterr().out)["pdfs"] == 1
    assert spark.read.parquet(f"file://{tmp_path}/store").select("source").distinct().count() == 2
    with pytest.raises(cli.chunking.ChunkLimitExceeded):
        (tmp_path / "pdfs" / "c.pdf").write_text("Too much about moats. " * 60)
        cli.main([*spec, "--max-chunks", "2"])


def test_settings():
    env = {"RETRIEVAL_MODE": "HYBRID", "DENSE_TOP_K": "41", "RETRIEVAL_BM25_K": "7", "RERANK_QUANTIZE": "FP32", "CHROMA_DB_PATH": "x", "RERANKER_DEVICE": " "}
    config = RetrievalConfig.from_env(env, collection="c")
    assert (config.mode, config.dense_k, config.bm25_k, config.rerank_quantize, config.store_path, config.collection, config.rerank_device) == ("hybrid", 41, 7, "", "x", "c", "")
    for bad in ({"RERANK_BATCH_SIZE": "0"}, {"BM25_B": "x"}, {"RETRIEVAL_MODE": "both"}):
        with pytest.raises(ValueError):
            RetrievalConfig.from_env(bad)


def test_a_retriever_starts_without_what_fails(spark, store, tmp_path):
    def broken():
        raise OSError("no weights")

    with pytest.warns(UserWarning, match="could not be prepared"):
        alone = build_retriever(store.drop("text"), RetrievalConfig(index_path=f"file://{tmp_path}/i"), models.HashEncoder, broken)
    assert alone.index is None
    found = build_retriever(store, RetrievalConfig(index_path=f"file://{tmp_path}/i"), models.HashEncoder, broken).retrieve(spark.createDataFrame([("q", "ferry pier")], "query_id string, question string"))
    assert not found.reranked and any("reranking failed" in w for w in found.warnings) and found.candidates.count() > 0


def test_public_names():
    import millrace

    assert all(hasattr(millrace, name) for name in millrace.__all__)
