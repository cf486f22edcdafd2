"""Retrieval end to end with fakes: distances, fallbacks, stale hits, and sources, streaming and models."""

import pytest
from pyspark.sql import functions as F

from millrace.config import RetrievalConfig
from millrace.functions import text as tx
from millrace.operators import bm25, models, postings
from millrace.plans.retriever import HybridRetriever, RetrievalError, ask, citations
from millrace.sources import files, pdf
from millrace.streaming.ingest import follow

ROWS = [
    ("doc.pdf_p1_0", "alpha general introduction", "doc.pdf", [0.0, 0.1]), ("doc.pdf_p2_1", "beta appeal thirty days", "doc.pdf", [0.0, 0.2]),
    ("doc.pdf_p3_2", "gamma 79/Leg.C3/2025/Law notification", "doc.pdf", [5.0, 5.0]), ("other.pdf_p1_3", "delta unrelated", "other.pdf", [0.0, 0.3]),
]


@pytest.fixture(scope="module")
def parts(spark):
    chunks = spark.createDataFrame(ROWS, "chunk_id string, text string, source string, embedding array<float>").persist()
    return chunks, bm25.build_index(chunks)


def retriever(parts, **more):
    config = RetrievalConfig(**({"dense_k": 2, "bm25_k": 2, "final_top_k": 3, "rerank_candidates": 4, "rerank_enabled": False} | more.pop("config", {})))
    zero = lambda c: F.array(F.lit(0.0).cast("float"), F.lit(0.0).cast("float"))
    return HybridRetriever(parts[0], more.pop("index", parts[1]), **({"encode": zero, "config": config} | more))


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, question string")


def test_hybrid_and_lexical_only_hit(spark, parts):
    result = retriever(parts).retrieve(asked(spark, "79/Leg.C3/2025/Law", "  "))
    got = {r.chunk_id: r for r in result.candidates.collect()}
    assert set(got) == {"doc.pdf_p1_0", "doc.pdf_p2_1", "doc.pdf_p3_2"} and not result.warnings
    assert got["doc.pdf_p1_0"].distance == pytest.approx(0.01) and got["doc.pdf_p3_2"].distance == pytest.approx(50.0)
    assert {r.query_id for r in result.candidates.collect()} == {0}
    shown = {r.chunk_id: r.relevance for r in citations(result.candidates).collect()}
    assert shown["doc.pdf_p3_2"] == 0.0 and shown["doc.pdf_p1_0"] == pytest.approx(0.995)


def test_fallbacks(spark, parts):
    def broken(c):
        raise RuntimeError("no model")

    q = asked(spark, "appeal thirty")
    result = retriever(parts, encode=broken).retrieve(q)
    assert result.warnings[0].startswith("dense retrieval failed") and [r.chunk_id for r in result.candidates.collect()] == ["doc.pdf_p2_1"]
    result = retriever(parts, index=None).retrieve(q)
    assert result.warnings == ["bm25 index unavailable"] and result.candidates.count() == 2
    with pytest.raises(RetrievalError):
        retriever(parts, index=None, encode=broken).retrieve(q)
    with pytest.raises(ValueError):
        retriever(parts).retrieve(spark.createDataFrame([(1, 5)], "query_id int, question int"))
    result = retriever(parts, rerank=lambda a, b: broken(a), config={"rerank_enabled": True}).retrieve(q)
    assert not result.reranked and any(w.startswith("reranking failed") for w in result.warnings) and result.candidates.count() == 2


def test_dense_hits_stay_when_hydration_fails(spark, parts, monkeypatch):
    def lost(*tables):
        raise RuntimeError("no store")

    monkeypatch.setattr("millrace.operators.search.hydrate", lost)
    q = asked(spark, "79/Leg.C3/2025/Law")
    for more in ({}, {"rerank": lambda a, b: F.length(b).cast("double"), "config": {"rerank_enabled": True}}):
        result = retriever(parts, **more).retrieve(q)
        got = {r.chunk_id: (r.text, r.source, r.distance) for r in result.candidates.collect()}
        assert result.warnings == ["failed to load lexical hits: RuntimeError"] and result.reranked == bool(more)
        assert got == {c: (t, s, pytest.approx(v[0] ** 2 + v[1] ** 2)) for c, t, s, v in ROWS[:2]}
    result = retriever(parts, config={"mode": "bm25"}).retrieve(q)
    assert result.candidates.count() == 0 and len(result.warnings) == 1


def test_rerank_order_and_stale_hits(spark, parts):
    score = lambda a, b: models.rerank_scores(a, b, models.OverlapReranker)
    result = retriever(parts, rerank=score, config={"rerank_enabled": True}).retrieve(asked(spark, "beta appeal"))
    assert result.reranked and result.candidates.orderBy("final_rank").first().chunk_id == "doc.pdf_p2_1"
    fewer = parts[0].filter("chunk_id <> 'doc.pdf_p2_1'"), parts[1]
    got = [r.chunk_id for r in retriever(fewer, config={"mode": "bm25"}).retrieve(asked(spark, "beta appeal")).candidates.collect()]
    assert got == []


def test_ask(spark, parts):
    class Echo:
        def generate(self, prompt):
            return "" if "refuse" in prompt else prompt[:7]

    answers = ask(retriever(parts), asked(spark, "appeal", "refuse alpha"), "Answer. {context} {question}", Echo())
    assert sorted(a["answer"] for a in answers) == ["Answer.", "The model declined to answer."]
    with pytest.raises(ValueError):
        ask(retriever(parts), asked(spark, " "), "{question}", Echo())

    class Busy:
        turns = 0

        def generate(self, prompt):
            self.turns += 1
            if self.turns < 3:
                raise models.ProviderError("busy", 429)
            return "ok"

    assert models.generate(Busy(), "x", wait=0.0) == "ok"


def test_pdf_pages_and_files(spark, tmp_path):
    for name, text in (("b.PDF", b"%short|" + b"x" * 60), ("a.pdf", b"boom"), ("c.txt", b"no")):
        (tmp_path / name).write_bytes(text)

    def parser(content):
        if content == b"boom":
            raise ValueError("bad file")
        return content.decode().split("|")

    pages = pdf.extract_pages(pdf.find_pdfs(spark, f"file://{tmp_path}"), parser, (lambda c, n: "o" * 55,)).orderBy("source", "page").collect()
    assert [(r.source, r.page, r.method) for r in pages] == [("a.pdf", 0, None), ("b.PDF", 1, "ocr"), ("b.PDF", 2, "pypdf")] and "bad file" in pages[0].error


def test_pages_before_a_broken_one_stay(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")

    def parser(content):
        yield "w" * 70
        yield "short"
        raise ValueError("page three")

    rows = pdf.extract_pages(pdf.find_pdfs(spark, f"file://{tmp_path}"), parser).orderBy("page").collect()
    assert [(r.page, r.method, r.char_count) for r in rows] == [(0, None, 0), (1, "pypdf", 70), (2, "pypdf_fallback", 5)] and "page three" in rows[0].error


def test_golden_and_review_files(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"id":"q1","evidence":[{"text":"t"}]}\n\n{"id":"q2","evidence":[]}\n')
    golden = files.read_golden(spark, f"file://{tmp_path}/g.jsonl")
    assert golden.count() == 2 and files.golden_evidence(golden).first().fact == "t"
    (tmp_path / "r.csv").write_text("﻿config,answerable,correct\nA,True,y\n", encoding="utf-8")
    assert files.read_review(spark, f"file://{tmp_path}/r.csv").columns[0] == "config"


def test_stream_updates_index(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    version = tx.tokenizer_version()
    for rows in ([("a", "one two"), ("b", "three four")], [("a", "five six")]):
        spark.createDataFrame(rows, "chunk_id string, text string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("chunk_id string, text string").parquet(source)
        follow(stream, f"file://{tmp_path}/index", f"file://{tmp_path}/store", f"file://{tmp_path}/cp", tx.tokenize(F.col("text")), version).awaitTermination()
    index = postings.load(spark, f"file://{tmp_path}/index", version)
    assert len(index.segments) == 2 and sorted((r.term, r.chunk_id) for r in index.postings().collect()) == [("five", "a"), ("four", "b"), ("six", "a"), ("three", "b")]
