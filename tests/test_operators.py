"""Index, fusion, chunking, evaluation and settings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.config import RetrievalConfig
from millrace.functions import text as tx
from millrace.operators import bm25, chunking, evaluation, postings, search
from millrace.operators.ordering import running_sum

TEXTS = [("k1", "Harbour pilots board large vessels at the outer buoy"), ("k2", "Each quarry licence expires after seven winters"), ("k3", "തുറമുഖ നികുതി 44/B/തുറ7/2031 schedule"), ("k4", "")]


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, text string")


def top(spark, index, question):
    asked = spark.createDataFrame([(1, question)], "query_id int, q string").select("query_id", tx.tokenize(F.col("q")).alias("tokens"))
    return [r.chunk_id for r in bm25.search(index.postings, asked, 3).orderBy("bm25_rank").collect()]


def test_bm25_search_and_empty(spark):
    index = bm25.build_index(chunks(spark, TEXTS))
    assert top(spark, index, "seven winters of a licence") == ["k2"] and top(spark, index, "44/B/തുറ7/2031")[0] == "k3"
    assert top(spark, index, "absent words only") == [] and not index.empty
    empty = bm25.build_index(chunks(spark, []))
    assert bm25.corpus_stats(bm25.doc_lengths(empty.docs)).first().avgdl == 1.0 and empty.empty


def test_decomposed_chunks_and_composed_questions(spark):
    rows = [("a", "the cafe\u0301 is closed"), ("b", "the cafe is open")]
    index = bm25.build_index(chunks(spark, rows))
    assert top(spark, index, "caf\u00e9") == top(spark, index, "cafe\u0301") == ["a"]
    evidence = spark.createDataFrame([(1, "f", "s", "caf\u00e9 is")], "query_id int, fact string, source string, text string")
    found = evaluation.resolve_gold(evidence, chunks(spark, rows).withColumn("source", F.lit("s")))
    assert [r.chunk_id for r in found.collect()] == ["a"]


def scores(spark, index, question):
    asked = spark.createDataFrame([(1, question)], "query_id int, q string").select("query_id", tx.tokenize(F.col("q")).alias("tokens"))
    return sorted(tuple(r) for r in index.search(asked, 10).collect())


def test_saved_postings(spark, tmp_path):
    """After every step the saved index scores as one that is computed from the chunks it should have."""
    path, tokens, version = f"file://{tmp_path}/index", tx.tokenize(F.col("text")), tx.tokenizer_version()
    held = dict(TEXTS)

    def same(index):
        index = postings.load(spark, path, version)
        assert index.n == len(held) and sorted(r.chunk_id for r in index.docs.collect()) == sorted(held)
        fresh = bm25.build_index(chunks(spark, list(held.items())))
        for question in ("quarry licence vessels", "large plain schedule winters", "നികുതി", "none of it"):
            assert scores(spark, index, question) == scores(spark, fresh, question)
        return index

    same(postings.create(chunks(spark, TEXTS), tokens, path, version))
    held |= {"k2": "A plain licence", "k5": "winters are plain"}
    del held["k1"]
    index, changes = postings.sync(postings.load(spark, path, version), chunks(spark, list(held.items())), tokens)
    assert tuple(bm25.diff_counts(changes).first()) == (1, 1, 1, 4) and len(same(index).segments) == 2
    before = postings.load(spark, path, version)
    assert postings.put(before, chunks(spark, list(held.items())[:2]), tokens) == before  # nothing new, nothing written
    held |= {"k1": "vessels come back", "k5": "plain winters again"}
    index = same(postings.put(before, chunks(spark, [("k1", held["k1"]), ("k5", held["k5"])]), tokens))
    del held["k5"]
    index = same(postings.remove_chunks(index, spark.createDataFrame([("k5",), ("k9",)], "chunk_id string")))
    assert len(index.segments) == 4
    index = same(postings.compact(index))
    postings.vacuum(index)
    assert len(same(index).segments) == 1 and len([p for p in (tmp_path / "index").iterdir() if p.is_dir()]) == 1
    assert postings.load(spark, path, "other") is None and postings.load(spark, f"{path}x", version) is None
    (tmp_path / "index" / "HEAD.json").write_text("{")
    (tmp_path / "index" / ".HEAD.json.crc").unlink(missing_ok=True)
    assert postings.load(spark, path, version) is None


def test_a_search_opens_only_the_buckets_of_its_terms(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index = postings.create(chunks(spark, TEXTS), tx.tokenize(F.col("text")), path, tx.tokenizer_version())
    terms = spark.createDataFrame([("vessels",), ("winters",)], "term string")
    plan = index.postings(terms)._jdf.queryExecution().executedPlan().toString()
    wanted = {r[0] for r in terms.select(postings.term_bucket(F.col("term"), index.buckets)).collect()}
    named = re.search(r"PartitionFilters: \[([^\]]*)\]", plan)[1]
    assert {int(x) for x in re.findall(r"\b\d+\b", named.split("bucket#")[-1].partition(" ")[2])} == wanted, plan


def test_fingerprints_differ(spark):
    new = chunks(spark, [TEXTS[0], ("k2", "replaced text"), ("d", "an added one")])
    assert bm25.compare_fingerprints(bm25.fingerprint(chunks(spark, TEXTS[:3])), bm25.fingerprint(new)) == ["all_sha256", "ids_sha256", "texts_sha256"][1:]


def test_fingerprint_of_metadata_and_vectors(spark):
    kind = "chunk_id string, text string, source string, more map<string,string>, embedding array<float>"
    rows = [("a", "one", "s", {"x": "1", "y": "2"}, [0.0, 1.0]), ("b", None, None, None, None)]

    def differ(a, b=("b", None, None, None, None), kinds=kind):
        return bm25.compare_fingerprints(bm25.fingerprint(spark.createDataFrame(rows, kind)), bm25.fingerprint(spark.createDataFrame([b, a], kinds)))

    assert differ(("a", "one", "s", {"y": "2", "x": "1"}, [0.0, 1.0])) == []
    assert differ(("a", "one", "s", rows[0][3], [0.0, 1.5])) == ["all_sha256", "vectors_sha256"]
    assert differ(rows[0], ("b", None, None, None, [])) == ["all_sha256", "vectors_sha256"]
    assert differ(("a", "one", "t", rows[0][3], [0.0, 1.0])) == ["all_sha256", "metadata_sha256"]
    assert differ(("a", "one", "s", {"x": "2", "y": "1"}, [0.0, 1.0])) == ["all_sha256", "metadata_sha256"]
    assert differ(("a", "two", "s", rows[0][3], [0.0, 1.0])) == ["all_sha256", "texts_sha256"]
    assert differ(rows[0][:4], rows[1][:4], kind.rsplit(",", 1)[0]) == ["all_sha256", "vectors_sha256"]


def ranked(spark, lists):
    return spark.createDataFrame([(1, name, c, i) for name, ids in lists.items() for i, c in enumerate(ids)], "query_id int, retriever string, chunk_id string, pos int")


def test_rrf(spark):
    """Three retrievers, repeated and null ids, ties by best rank and then by id, weights, against plain sums."""
    lists = {"dense": ["p", None, "q", "q", "r"], "bm25": ["s", "r", "p", "s"], "titles": ["t", "q"], "none": []}
    for k, weights in ((60, {}), (0, {"titles": 0.5}), (7, {"bm25": 3.0, "dense": 0.25})):
        want, best = {}, {}
        for name, ids in lists.items():
            for place, c in enumerate(dict.fromkeys(x for x in ids if x), 1):
                want[c] = want.get(c, 0) + weights.get(name, 1.0) / (k + place)
                best[c] = min(best.get(c, 99), place)
        got = search.rrf(ranked(spark, lists), k, weights).orderBy("fused_rank").collect()
        assert {r.chunk_id: r.rrf_score for r in got} == {c: round(v, 9) for c, v in want.items()}
        assert [r.chunk_id for r in got] == sorted(want, key=lambda c: (-round(want[c], 9), best[c], c))


def test_merge_short_pages(spark):
    pages = [("s", i + 1, t) for i, t in enumerate(["a", "", "L" * 250, "b", "M" * 200, "c", "d"])]
    rows = chunking.merge_short_pages(spark.createDataFrame(pages, "source string, page int, text string")).orderBy("block").collect()
    assert [list(r.pages) for r in rows] == [[1, 2], [3], [4], [5], [6, 7]]
    assert rows[0].text == "a\n\n" and rows[2].is_merged and rows[1].text == "L" * 250


def test_split_text():
    text = " ".join("word%d" % i for i in range(900))
    parts = chunking.split_text(text, 200, 50)
    assert all(len(p) <= 200 for p in parts) and parts[0].startswith("word0") and parts[-1].endswith("word899")
    assert all(any(w in q for w in p.split()[:1]) for p, q in zip(parts[1:], parts, strict=False))
    assert chunking.split_text("") == [] and chunking.split_text("x" * 2500, 1000, 0) == ["x" * 1000, "x" * 1000, "x" * 500]


def test_metrics(spark):
    results = spark.createDataFrame([("m", 1, c, i + 1) for i, c in enumerate(["x", "g1", "y", "g2"])], "config string, query_id int, chunk_id string, rank int")
    gold = spark.createDataFrame([(1, "f1", "g1", "s"), (1, "f2", "g9", "s"), (1, "f1", "g2", "s"), (2, "f", "z", "s")], "query_id int, fact string, chunk_id string, source string")
    pages = spark.createDataFrame([("g1", "p1"), ("g2", "p1"), ("g9", "p2"), ("z", "p3"), ("x", "p2")], "chunk_id string, page_key string")
    got = {r.query_id: r for r in evaluation.question_metrics(results, gold, pages).collect()}
    assert (got[1].first_gold_rank, got[1].hit_1, got[1].hit_5, got[1].mrr, got[1].recall_10, got[1].facts_covered, got[1].facts_total) == (2, 0, 1, 0.5, 0.666667, 1, 2)
    assert got[2].first_gold_rank is None and got[2].ndcg == 0.0
    assert "| m | 2 |" in evaluation.to_markdown(evaluation.summarize(evaluation.question_metrics(results, gold, pages)), "t")


def test_config():
    assert RetrievalConfig.from_env({"RETRIEVAL_DENSE_K": "40", "RETRIEVAL_RERANK_QUANTIZE": "Off", "RETRIEVAL_RERANK_ENABLED": "no"}).pool == 10
    for bad in ({"RETRIEVAL_MODE": "x"}, {"RETRIEVAL_BM25_K": "0"}, {"RETRIEVAL_RRF_K": "a"}):
        with pytest.raises(ValueError):
            RetrievalConfig.from_env(bad)
    assert random.Random(0)  # no model is loaded to read settings


def test_sweep_has_every_tokenizer(spark):
    from millrace.plans.registry import QUERIES

    got = {r.config for r in QUERIES["sweep_tokenizer"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {"raw", "none", "prefix4", "prefix5", "prefix6", "ngram3", "ngram4"}


def test_running_sum(spark):
    """Groups over many ranges, null groups, ties, an empty table, against a plain loop."""
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "hot", "x", None]), i, rng.randrange(5)) for i in range(700)]
    table = spark.createDataFrame(rows, "g string, o int, v int").repartition(5)
    got = {r.o: r.s for r in running_sum(table, ["g"], ["o"], F.col("v"), "s").collect()}
    whole = {r.o: r.s for r in running_sum(table, [], ["o"], F.lit(1), "s").collect()}
    sums = {}
    for g, o, v in rows:
        sums[g] = sums.get(g, 0) + v
        assert got[o] == sums[g] and whole[o] == o + 1
    assert running_sum(table.limit(0), ["g"], ["o"], F.lit(1), "s").count() == 0


def test_dense_topk(spark, monkeypatch):
    """Ties over batches, missing and short vectors, more queries than a block, against all pairs."""
    rng = random.Random(4)
    vectors = [(f"c{i}", [rng.randrange(3) / 2 for _ in range(4)]) for i in range(300)] + [("none", None), ("short", [1.0]), ("near", [0.5, 0.5, 0.5, 0.5000001])]
    asked = [(q, [rng.randrange(3) / 2 for _ in range(4)]) for q in range(9)] + [(99, None)]
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    monkeypatch.setattr(search, "ROWS", 64)
    chunks_ = spark.createDataFrame(vectors, "chunk_id string, embedding array<float>").repartition(3)
    got = search.dense_topk(chunks_, spark.createDataFrame(asked, "query_id int, query_vector array<float>"), 7).collect()
    found = sorted((r.query_id, r.dense_rank, r.chunk_id, r.distance) for r in got)
    want = []
    for q, v in asked[:-1]:
        every = sorted((round(sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), 6), c) for c, w in vectors if w and len(w) == 4)
        want += [(q, i, c, d) for i, (d, c) in enumerate(every[:7], 1)]
    assert found == want
    assert search.dense_topk(chunks_, spark.createDataFrame([], "query_id int, query_vector array<float>"), 7).count() == 0
    assert "NestedLoop" not in search.dense_topk(chunks_, spark.createDataFrame(asked, "query_id int, query_vector array<float>"), 7)._jdf.queryExecution().executedPlan().toString()


def test_evidence(spark, monkeypatch):
    """Pieces inside words, overlapping ones, one that two facts share, sources, blanks, more than a block."""
    monkeypatch.setattr(evaluation, "NEEDLES", 2)
    rows = [("a", "s", "The  Broad\nriver runs"), ("b", "t", "a broad river"), ("c", None, "roadrunner"), ("d", "s", None)]
    wanted = [(1, "f", None, "broad river"), (1, "g", "s", "road r"), (2, "f", "t", "ROAD"), (3, "f", None, " "), (4, "h", None, "broad RIVER"), (5, "i", "s", "roadrunner"), (6, "j", None, "absent")]
    evidence = spark.createDataFrame(wanted, "query_id int, fact string, source string, text string")
    chunks_ = spark.createDataFrame(rows, "chunk_id string, source string, text string")
    got = evaluation.resolve_gold(evidence, chunks_)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.query_id, r.fact, r.chunk_id) for r in got.collect()) == [(1, "f", "a"), (1, "f", "b"), (1, "g", "a"), (2, "f", "b"), (4, "h", "a"), (4, "h", "b")]
    assert evaluation.resolve_gold(evidence.limit(0), chunks_).count() == 0


def test_chunk_numbers_need_no_single_task(spark):
    rows = spark.createDataFrame([(s, str(i), i) for s in ("a", "b") for i in range(40)], "source string, page string, chunk_no int").repartition(4)
    ids = {(r.source, r.chunk_no): r.chunk_id for r in chunking.chunk_ids(rows).collect()}
    assert ids == {(s, i): f"{s}_p{i}_{40 * (s == 'b') + i}" for s in ("a", "b") for i in range(40)}


def plain_chunks(text, size, overlap, seps=("\n\n", "\n", ".", " ", "")):
    """Windows of pieces, read from the rules: cut before each separator, keep what fits, go finer where a piece does not."""
    sep, *finer = next((seps[i:] for i, s in enumerate(seps) if s == "" or s in text), seps[-1:])
    cuts = [0, *(m.start() for m in re.finditer(re.escape(sep), text) if m.start()), len(text)] if sep else range(len(text) + 1)
    out, window = [], []
    for a, b in zip(cuts, list(cuts)[1:], strict=False):
        piece = text[a:b]
        if len(piece) >= size:
            out += ["".join(window)] * bool(window) + (plain_chunks(piece, size, overlap, finer) if finer else [piece])
            window = []
            continue
        if window and sum(map(len, window)) + len(piece) > size:
            out.append("".join(window))
            while window and (sum(map(len, window)) > overlap or sum(map(len, window)) + len(piece) > size):
                window = window[1:]
        window = [*window, piece]
    return [c for c in (x.strip() for x in [*out, "".join(window)]) if c]


def test_chunk_pages_and_documents_by_brute_force(spark):
    rng = random.Random(11)
    words = ["alpha", "be", "gamma.", "delta\n", "\n\n", "x" * 120, "é", "."]
    pages = [(s, p, "".join(rng.choice(words) + rng.choice([" ", ""]) for _ in range(rng.randrange(0, 160)))) for s in ("a", "b") for p in range(14)]
    rows = spark.createDataFrame(pages, "source string, page int, text string").repartition(3)
    merged = chunking.merge_short_pages(rows, 60)
    blocks = merged.select("source", "block", chunking.page_label(F.col("pages"), F.col("is_merged")).alias("page"), "text")
    got = sorted((r.source, r.chunk_no, r.page, r.text) for r in chunking.chunk_pages(blocks, 100, 30, 20).collect())
    want = []
    for s in ("a", "b"):
        held, run, number = [], [], 0
        for p, t in [(p, t.strip()) for x, p, t in pages if x == s] + [(None, None)]:
            if t is not None and len(t) < 60:
                run.append((p, t))
                continue
            held += [("[" + ", ".join(str(q) for q, _ in run) + "]", "".join(t_ + "\n" for _, t_ in run))] * bool(run) + [(str(p), t)] * (t is not None)
            run = []
        for label, t in held:
            for chunk in plain_chunks(t, 100, 30) if t.strip() else []:
                if len(chunk) >= 20:
                    want.append((s, number, label, chunk))
                    number += 1
    assert got == want
    whole = {s: "\n\n".join(t for x, _, t in pages if x == s and t) for s in ("a", "b")}
    got = sorted((r.source, r.chunk_no, r.text) for r in chunking.chunk_document(rows, 100, 30, 20).collect())
    assert got == [(s, i, c) for s in ("a", "b") for i, c in enumerate(plain_chunks(whole[s], 100, 30)) if len(c) >= 20]
