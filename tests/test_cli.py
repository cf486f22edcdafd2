"""The command line over small tables."""

import json

from millrace import cli

ROWS = [("a", "one two three", "s", [0.0, 1.0]), ("b", "four five", "s", [1.0, 0.0])]
SCHEMA = "chunk_id string, text string, source string, embedding array<float>"


def test_index_fingerprint_and_search(spark, tmp_path, monkeypatch, capsys):
    chunks, index = f"file://{tmp_path}/chunks", f"file://{tmp_path}/index"
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(chunks)
    assert cli.main(["build-index", chunks, index, "--check"]) == 1
    assert cli.main(["build-index", chunks, index]) == 0 and cli.main(["build-index", chunks, index, "--check"]) == 0
    assert cli.main(["fingerprint", chunks, "--save", f"file://{tmp_path}/print"]) == 0
    assert cli.main(["fingerprint", chunks, "--compare", f"file://{tmp_path}/print"]) == 0
    spark.createDataFrame([("c", "new", "s", [0.5, 0.5])], SCHEMA).write.mode("append").parquet(chunks)
    assert cli.main(["build-index", chunks, index, "--check"]) == 1 and cli.main(["build-index", chunks, index]) == 0
    assert cli.main(["fingerprint", chunks, "--compare", f"file://{tmp_path}/print"]) == 1
    (tmp_path / "q.jsonl").write_text(json.dumps({"query_id": "q", "question": "five"}) + "\n")
    monkeypatch.setenv("RETRIEVAL_MODE", "bm25")
    assert cli.main(["search", chunks, index, f"file://{tmp_path}/q.jsonl", f"file://{tmp_path}/out"]) == 0
    assert [r.chunk_id for r in spark.read.json(f"file://{tmp_path}/out").collect()] == ["b"]


def test_fingerprint_without_the_vectors_of_the_saved_one(spark, tmp_path):
    whole, less = f"file://{tmp_path}/whole", f"file://{tmp_path}/less"
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(whole)
    spark.createDataFrame(ROWS, SCHEMA).drop("source", "embedding").write.parquet(less)
    assert cli.main(["fingerprint", whole, "--save", f"file://{tmp_path}/print"]) == 0
    assert cli.main(["fingerprint", less, "--compare", f"file://{tmp_path}/print"]) == 1
