"""What keeps the work and memory of a query in proportion to its input."""

import math
import os
import random
import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import bm25, chunking, evaluation, pieces, postings
from millrace.plans.base import Base
from millrace.plans.registry import KINDS, TOKENIZERS

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


def plan(df):
    return df._jdf.queryExecution().toString()


def test_words_are_cut_in_one_pass(spark):
    """only pieces with a digit or a Malayalam letter are looked at one by one."""
    rows = spark.createDataFrame([("The re-use, of ABC 1,234.50 in No.7/a; x café's (2009) അമ്മമാർക്ക്,പഠനം end.",)], "text string")
    got = rows.select(tx.tokenize(F.col("text")).alias("t")).first().t
    assert got == ["the", "re", "use", "of", "abc", "1234.50", "1234", "50", "in", "no.7/a", "no", "7", "café", "2009", *got[14:-1], "end"] and got[14:-1][0] == tx_first(spark)
    assert "(?<!" in plan(rows.select(tx.tokenize(F.col("text"))))


def tx_first(spark):
    return spark.range(1).select(tx.normalize(F.lit("അമ്മമാർക്ക്")).alias("x")).select(F.regexp_extract("x", f"[{tx.MALAYALAM}]+", 0).alias("w")).first().w


def _reference(texts, asked, k):
    held = {i: Counter(t.split()) for i, t in texts.items()}
    n, total = len(held), sum(sum(c.values()) for c in held.values())
    df = Counter(t for c in held.values() for t in c)
    out = []
    for q, words in asked.items():
        scores = []
        for i, c in held.items():
            norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / (total / n))
            s = sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + norm) for w in set(words.split()) if c[w])
            scores.append((-round(s, 6), i))
        out += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k], 1)]
    return sorted(out)


def test_a_search_shuffles_the_best_rows_alone(spark, tmp_path, monkeypatch):
    """Pairs of questions and chunks stay in the tasks; blocks of questions, batches and ties by id."""
    monkeypatch.setattr(bm25, "QUESTIONS", 3)
    monkeypatch.setattr(bm25, "BATCH", 7)
    rng = random.Random(4)
    words = [f"w{chr(97 + i)}" for i in range(12)]
    texts = {i: " ".join(rng.choices(words, weights=range(1, 13), k=rng.randrange(0, 9))) for i in range(80)}
    texts |= {100 + i: texts[i] for i in range(40)}  # copies, so ties
    asked = {f"q{i}": " ".join(rng.choices([*words, "unknown"], k=rng.randrange(0, 6))) for i in range(8)}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id long, text string").repartition(5)
    questions = spark.createDataFrame(list(asked.items()), "query_id string, text string").select("query_id", tx.tokenize(F.col("text")).alias("tokens"))
    index = bm25.build_index(chunks)
    saved = postings.create(chunks, tx.tokenize(F.col("text")), str(tmp_path / "i"), "v")
    want = _reference(texts, asked, 6)
    for found in (index.search(questions, 6), saved.search(questions, 6), bm25.search(index.postings, questions, 6)):
        assert sorted(tuple(r) for r in found.collect()) == want
        below = plan(found).split("== Physical Plan ==")[1]
        assert "MapInArrow" in below and not re.search(r"hashpartitioning\(query_id#\w+, chunk_id", below)
    none = questions.limit(0)
    assert index.search(none, 6).count() == saved.search(none, 6).count() == 0


@needs_tables
def test_tables_of_an_index_are_not_kept_in_memory(spark):
    """Lists of tokens aren't cached, and chunks are not dealt out to count their terms."""
    b = Base(spark, FOLDER)
    assert not b.tokens.is_cached and "Exchange" not in plan(b.tf).split("== Physical Plan ==")[1]
    df = bm25.token_frequencies(b.tokens)
    assert plan(df).split("== Physical Plan ==")[1].count("Exchange") == 1
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, bm25.document_frequencies(b.tf).collect()))


@needs_tables
def test_only_candidates_leave_the_store(spark):
    """texts and vectors are cut to the pool's chunks where they are read."""
    b = Base(spark, FOLDER)
    got = b.store(b.fused.filter("fused_rank <= 2"))
    wanted = {r.chunk_id for r in b.fused.filter("fused_rank <= 2").collect()}
    assert {r.chunk_id for r in got.collect()} <= wanted and plan(got).count("LeftSemi") >= 2


def test_postings_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """parts of buckets grow in number with the chunks, and nothing but the postings is dealt out."""
    monkeypatch.setattr(postings, "SPREAD", 10)
    chunks = spark.range(45).select(F.col("id").alias("chunk_id"), F.lit("one two").alias("text"))
    index = postings.create(chunks, tx.tokenize(F.col("text")), str(tmp_path / "i"), "v", buckets=1)
    files = [f for _, _, fs in os.walk(tmp_path / "i") for f in fs if f.endswith(".parquet")]
    assert index.postings().count() == 90 and index.postings().select(F.input_file_name()).distinct().count() > 1, files


def test_pages_are_split_as_they_come():
    """the same chunks as of the joined text, with a page and a window of it in memory."""
    rng = random.Random(8)
    for _ in range(3000):
        pages = ["".join(rng.choice("ab.\n\n\n ") for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(0, 6))]
        assert list(chunking.split_pages(pages, 12, 4)) == chunking.split_text("\n\n".join(pages), 12, 4)
    taken = []
    chunks = chunking.split_pages((taken.append(1) or "word " * 300 for _ in range(1000)), 1000, 200)
    next(chunks)
    assert len(taken) < 5


def test_chunks_do_not_carry_their_source(spark, monkeypatch):
    """chunks go on in small batches, with the length of their text and not the text."""
    monkeypatch.setattr(chunking, "HELD", 50)
    text = "\n\n".join(f"paragraph {i} " + "x" * 300 for i in range(40))
    blocks = spark.createDataFrame([("s", 1, "1", text), ("s", 2, "2", ""), ("t", 1, "1", text * 2), (None, 1, "1", None)], "source string, block long, page string, text string")
    kept = chunking._chunked(blocks, 1000, 200)
    assert "text" not in kept.columns
    got = sorted((r.source, r.block, r.pos, r.chunk, r.source_char_count) for r in kept.collect())
    want = [(s, b, i, c, len(t)) for s, b, t in (("s", 1, text), ("t", 1, text * 2)) for i, c in enumerate(chunking.split_text(t))]
    assert got == want
    pages = spark.createDataFrame([("s", 2, text), ("s", 1, "short\n"), ("s", 3, ""), ("s", 4, None), (None, 1, text)], "source string, page long, text string")
    assert sorted((str(r.source), r.chunk_no, r.text) for r in chunking.chunk_document(pages, least=1).collect()) == sorted(
        (str(s), i, c) for s, t in (("s", "short\n\n\n" + text), (None, text)) for i, c in enumerate(chunking.split_text(t)))


def test_probes_are_not_joined_to_every_chunk(spark):
    """texts go to the chunks as an automaton, patterns as constants; the same as a search for each."""
    rng = random.Random(2)
    texts = ["Alpha  BETA\nGamma", "the Straße ſo K", None, "", "a.b (c)"] + ["".join(rng.choice("abAB ñ") for _ in range(20)) for _ in range(50)]
    probes = ["alpha  beta", "beta gamma", r"beta\s+GAMMA", "so k", "STRASSE", "straße", "x", "a.b", r"\(C\)", "(z|y)+", *("".join(rng.choice("abAB ñ") for _ in range(3)) for _ in range(40)), None]
    chunks = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = spark.createDataFrame(list(enumerate(probes)), "query_id long, probe string")
    got = evaluation.violated_probes(rows, chunks)
    old = rows.join(chunks, F.rlike(F.col("text"), F.concat(F.lit("(?i)"), F.col("probe"))), "left_semi").select("query_id")
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in old.collect()) and "NestedLoop" not in plan(got)
    assert evaluation.violated_probes(rows.limit(0), chunks).count() == evaluation.violated_probes(rows, chunks.limit(0)).count() == 0


def test_pieces_have_the_tokens_of_their_text(spark, monkeypatch):
    """Tables of pieces, begun anew often, count what the columns of text functions give, for every kind of tokens."""
    monkeypatch.setattr(pieces, "PIECES", 30)
    monkeypatch.setattr(pieces, "ROWS", 5)
    monkeypatch.setattr(pieces, "LETTERS", 700)
    rng = random.Random(11)
    signs = list("aAbZz019,,.-/:;'\"()~#éÉßſµİΣσ÷ɏഅകൾൻ൧്ളറ٣९​­́﻿|") + [" ", "\n", "\t", " ", " ", " ", "　", "\x85", "\x1c", "\x1f", "\x0b", " ", "‍", "നികുതിയുടെ", "7,50,000", "B-17/Tax/08", "Ref", "the"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(0, 60))) for _ in range(400)] + [None, "", " \n", "plain words only here " * 80] * 2
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").repartition(3)
    first = next(iter(KINDS))
    cut = {name: {r.chunk_id: r.t for r in chunks.select("chunk_id", f(F.col("text")).alias("t")).collect()} for name, f in TOKENIZERS.items()}
    asked = spark.createDataFrame([("q", name, rng.sample(sorted({t for x in own.values() for t in x}), 150)) for name, own in cut.items()], "query_id string, kind string, tokens array<string>")
    words = {r.kind: set(r.tokens) for r in asked.collect()}
    shared = set().union(*(words[name] for name in KINDS if KINDS[name]))
    rows = pieces.asked_terms(chunks, asked, KINDS)
    for name, own in cut.items():
        mine = pieces.of_kind(rows, name, first) if KINDS[name] else rows.filter(F.col("kind") == name)
        got = {r.chunk_id: (r.doc_len, dict(zip(r.terms, r.tfs, strict=True))) for r in mine.collect()}
        assert got.keys() == own.keys() and mine.count() == len(own)
        use = lambda i, name=name: shared if KINDS[name] and (name == first or not tx_native(texts[i])) else words[name]
        assert got == {i: (len(t), {w: n for w, n in Counter(t).items() if w in use(i)}) for i, t in own.items()}
        df = pieces.frequencies(chunks, KINDS[name]) if KINDS[name] else None
        assert df is None or {r.term: r.df for r in df.collect()} == Counter(w for t in own.values() for w in set(t))
    p = plan(pieces.frequencies(chunks)).split("== Physical Plan ==")[1]
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x30000)]))
    assert pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pa.array([every]))).to_pylist() == [every.split()]
    assert "MapInArrow" in p and "regexp_extract_all" not in p


def tx_native(text):
    return bool(re.search("[ഀ-൥൰-ൿ]", text or ""))  # digits become ASCII ones


def test_evidence_is_found_across_white_space(spark):
    """white space is collapsed where the automaton reads; the same as a search in the canonical text."""
    texts = ["The  OLD\n\tpier", " old 　pier ", "oldpier", None, "", "x old\x1cpier y", "Straße\nNo"]
    chunks = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "chunk_id long, source string, text string")
    evidence = spark.createDataFrame([(i, "f", None, t) for i, t in enumerate(["old pier", " Old \n PIER ", "strasse no", "", "e old"])], "query_id long, fact string, source string, text string")
    found = evaluation.resolve_gold(evidence, chunks)
    hay, need = (df.select(k, tx.canonical(F.col("text")).alias("c")).collect() for df, k in ((chunks, "chunk_id"), (evidence, "query_id")))
    assert sorted((r.query_id, r.chunk_id) for r in found.collect()) == sorted((n[0], h[0]) for n in need for h in hay if n[1] and n[1] in h[1])
