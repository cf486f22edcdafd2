"""Every operator and pipeline stage on nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import base64
import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import bpe, extendible, jpeg, minhash, mixing, preference, quality_hosts, suffix, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, uid long, text_key string, size long, bits string, class long, h long, words string, bucket int"
WORDS = [f"w{i * 7919 % 10007}é" for i in range(4000)]


def text(a, n, step=1):
    return " ".join(WORDS[a : a + n * step : step])


TEXTS = [
    (1, text(0, 120)), (2, text(0, 120)), (3, text(0, 118) + " other end"), (4, text(300, 200)), (5, None), (None, text(600, 80)), (7, ""), (8, " \n\t "), (9, "short"),
    (10, text(1000, 100) + " " + text(300, 90)), (11, text(0, 3500) * 3), (12, text(2000, 60)), (12, text(2000, 60)), (None, None), (14, "same line\n" * 40), (15, text(700, 60)), (15, text(900, 60)),
]
SOURCES = [None, "b", "a", "a", "c"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", SOURCES[k % 5], len(t or ""), "r", 0, "k", 5, "b", 1, 2, "w", 3) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(rows):
    return Counter((r.row.doc_id, r.row.text) for r in rows)


ALL = Counter(TEXTS)


def test_quality(docs, none):
    rows = quality_hosts.judge(docs).collect()
    assert counted(rows) == ALL
    for r in rows:
        words = (r.row.text or "").split()
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        hit = {i + j for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for j in range(3)}
        assert (r.n_words, r.n_repeat_words, r.word_chars) == (len(words), len(hit), sum(map(len, words)))
        assert r.base_failed == (len(words) < 50 or 2 * len(hit) > len(words)) and (not r.kept or not r.base_failed)
    assert quality_hosts.judge(none).count() == 0


def test_hosts_shrink(spark):
    rows = [(f"h{i}", False) for i in range(20) for _ in range(50)] + [("bad", True)] * 40 + [("tiny", True)]
    got = {r.host: r for r in quality_hosts.host_verdicts(spark.createDataFrame(rows, "s string, f boolean"), "s", "f").collect()}
    assert got["bad"].host_rejected and not got["h1"].host_rejected and got["tiny"].host_rate < got["bad"].host_rate


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert counted(rows) == ALL and all(0 <= r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.row.source, []).append(r)
    assert sum(x[0].target for x in by.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    for group in by.values():
        assert abs(sum(r.taken for r in group) - group[0].target) <= max(r.size for r in group)
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(docs).columns == docs.columns


def test_toxicity(spark, docs, none):
    labelled = spark.createDataFrame([(f"you utter scumbag {WORDS[i]} {text(i, 20)}", 1) for i in range(60)] + [(text(i, 25), 0) for i in range(200)] + [(None, 0), ("", 0)], "text string, toxic int")
    model = toxicity.fit(labelled)
    got = {r.row.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[4] < 0.5
    assert model.matcher().score("a scumbag") > 0.5 and toxicity.score(none, model).count() == 0
    assert toxicity.fit(labelled.limit(0)).matcher().score("scumbag") < 0.5


def test_toxicity_query(spark, tmp_path):
    """The query against a plain reading of its model: fold, look at every word, leave out exceptions, divide by words."""
    bad = ["scumbag", "vermin", "wretch"]
    docs_ = [(i, f"{text(i, 30)} you {bad[i % 3]} {text(2 * i, 10)} filthy {bad[(i + 1) % 3]}") for i in range(150)] + [(i, text(i, 40)) for i in range(150, 500)]
    docs_ += [(500 + i, f"{text(i, 20)} the vermin control office {text(i, 20)}") for i in range(40)] + [(600, None), (601, ""), (602, "sсumb4g, v3rmin!"), (603, "vermin control"), (None, "scumbag"), (7, text(900, 30)), (604, "clean " * 3000 + "wretch")]
    labels = [(i, 1 if i < 150 else 0) for i in range(540)] + [(150, None), (8, 0), (None, 1), (7, 1)]
    spark.createDataFrame(docs_, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held, marks = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    assert toxicity.training_rows(held, marks).count() == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(540)) and toxicity.training_rows(held, marks, 20).count() == 20
    model = toxicity.fit(toxicity.training_rows(held, marks))
    def weigh(t):
        folded = toxicity.fold(t or "")
        hidden = {i for p in model.exceptions for m in re.finditer(rf"\b{re.escape(p)}\b", folded) for i in range(m.start(), m.end())}
        total = 0.0
        for m in re.finditer(r"[^\W\d_]+", folded):
            word = m[0]
            fits = [w for term, w in model.terms.items() for f in {term, term.replace("l", "i")} if (word == f[:-1] if f.endswith("$") else word.startswith(f))]
            total += max(fits, default=0.0) * (m.start() not in hidden)
        x = np.log1p(100 * total / ((t or "").count(" ") + (t or "").count("\n") + 1)) if total else 0.0
        return 1 / (1 + np.exp(-np.clip(model.slope * x + model.bias, -60, 60)))

    got = toxicity.query(spark, str(tmp_path)).collect()
    want = Counter((i, zlib.crc32(str("" if i is None else i).encode()) % 5 == 0, round(weigh(t), 9)) for i, t in docs_)
    assert Counter((r.doc_id, r.held_out, round(r.score, 9)) for r in got) == want and all(r.predicted == int(r.score >= 0.5) for r in got)
    found = {r.doc_id: r.score for r in got}
    assert found[602] > 0.5 > max(found[i] for i in (600, 601, 603, 604, 510)) and found[None] > 0.5
    assert sum(r.predicted != (r.doc_id < 150) for r in got if r.doc_id is not None and r.doc_id < 540 and r.doc_id != 7) == 0


def test_jpeg(docs, none):
    raw = docs.withColumn("payload", F.encode("text", "UTF-8"))
    rows = jpeg.read_media(jpeg.with_media(raw, "payload", docs.columns), keep=("row", "n_bytes")).collect()
    assert counted(rows) == ALL
    for r in rows:
        own = (r.row.text or "").encode()
        assert r.n_bytes == len(own) and bytes(r.payload)[: len(own)] == own and set(bytes(r.payload)[len(own) :]) <= {255} and len(r.payload) % 576 == 0 < len(r.payload)
    assert jpeg.with_media(none.withColumn("payload", F.encode("text", "UTF-8")), "payload", ["doc_id"]).count() == 0


def test_jpeg_query(spark, docs, none, tmp_path):
    """Every column of the query, by plain loops over the payload's bytes as an image of 24 or 576 columns."""
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    rows = jpeg.query(spark, str(tmp_path)).collect()
    texts = Counter((i, t) for i, t in TEXTS)
    left = Counter()
    stored = {bytes(r.payload): bytes(r.media) for r in jpeg.read_media(jpeg.with_media(docs.withColumn("payload", F.encode("text", "UTF-8")), "payload", ["doc_id"]).select("media", F.col("media").alias("kept")), keep=("kept",)).withColumnRenamed("kept", "media").collect()}
    by_sha = {hashlib.sha256(p).hexdigest(): p for p in stored}
    for r in rows:
        payload = by_sha[r.payload_sha256]
        media = stored[payload]
        left[r.doc_id, r.n_bytes] += 1
        assert (r.payload_bytes, r.tail_crc32) == (len(payload), zlib.crc32(payload[-32:])) and (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert media[:2] == b"\xff\xd8" and media[-2:] == b"\xff\xd9"
        wide = 24 if len(payload) <= 24 * 8191 else 576
        grid = [payload[k : k + wide] for k in range(0, len(payload), wide)]

        def means(high, across):
            y, x = ([n * s // k for n in range(k)] + [s] for k, s in ((high, len(grid)), (across, wide)))
            cell = lambda i, j: [v for line in grid[y[i] : max(y[i + 1], y[i] + 1)] for v in line[x[j] : x[j + 1]]]
            return [[sum(c) / len(c) for j in range(across) for c in [cell(i, j)]] for i in range(high)]

        if len(grid) >= 8:
            small, next_to = means(8, 8), means(8, 9)
            middle = sum(map(sum, small)) / 64
            bits = "".join(str(int(v > middle)) for line in small for v in line), "".join(str(int(b > a)) for line in next_to for a, b in zip(line, line[1:], strict=False))
            assert r.feature == f"{wide * 8}x{len(grid) * 8}:{int(bits[0], 2):016x}:{int(bits[1], 2):016x}"
    assert left == Counter((i, len((t or "").encode())) for i, t in texts.elements())
    assert jpeg.read_media(jpeg.with_media(none.withColumn("payload", F.encode("text", "UTF-8")), "payload", ["doc_id"]), digests=True).count() == 0


def test_near_classes(docs, none):
    rows = minhash.near_classes(docs).collect()
    assert counted(rows) == ALL
    got = {}
    for r in rows:
        got.setdefault((r.row.doc_id, r.row.text), set()).add(r.class_id)
    of = lambda i: {c for (d, _), cs in got.items() if d == i for c in cs}
    assert of(1) == of(2) == of(3) == {1} and of(4) == {4} and of(12) == {12} and of(15) == {15}
    assert got[(5, None)] == got[(7, "")] == {5} and of(8) == {8}
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 4, 5, None, 8, 9, 10, 11, 12, 14, 15, 15])
    assert minhash.near_classes(none).count() == 0


def test_near_chain_and_large_groups(spark, monkeypatch):
    """Links of a chain whose ends are unlike, and a bucket dealt out again, against all pairs."""
    base = WORDS[:200]
    rows = [(k, " ".join(base[: 200 - 9 * k] + WORDS[1000 + 100 * k : 1000 + 100 * k + 9 * k])) for k in range(8)]
    rows += [(100 + k, " ".join(WORDS[2000:2100] + [f"x{k}y{j}" for j in range(5)])) for k in range(40)]
    monkeypatch.setattr(minhash, "MANY", 3)
    got = {r.row.doc_id: r.class_id for r in minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    parent = {i: i for i, _ in rows}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    sets = {i: minhash.shingles(t) for i, t in rows}
    for i in sets:
        for j in sets:
            if i < j and minhash.similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert got == {i: root(i) for i in sets}


def test_near_pairs_of_one_band_in_a_wide_bucket(spark, monkeypatch):
    """Unlike texts in one bucket, with planted near pairs that share no other band, against all pairs."""
    rows = [(k, " ".join(WORDS[:60] + [f"x{k}y{j}" for j in range(60)])) for k in range(60)]
    rows += [(100 + k, rows[k][1] + f" end{k} of it") for k in range(0, 60, 5)]
    sign = minhash.signed

    def one_band(*args):
        own = [F.xxhash64("text_key", F.lit(i)) for i in range(1, minhash.BANDS)]
        return sign(*args).withColumn("bands", F.array(F.lit(7).cast("long"), *own))

    monkeypatch.setattr(minhash, "signed", one_band)
    monkeypatch.setattr(minhash, "MANY", 3)
    monkeypatch.setattr(minhash, "WIDE", 16, raising=False)
    got = {r.row.doc_id: r.class_id for r in minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: minhash.shingles(t) for i, t in rows}
    near = {(i, j) for i in sets for j in sets if i < j and minhash.similarity(sets[i], sets[j]) >= 0.8}
    assert near == {(k, 100 + k) for k in range(0, 60, 5)}
    assert got == {i: i - 100 if i >= 100 else i for i in sets}


def brute_repeats(texts):
    """Of each text: its size, removed bytes, runs, digest of the rest, and passages, by comparing all strings."""
    long, short = Counter(), {}
    for k, t in enumerate(texts):
        long.update(t[i : i + 400] for i in range(len(t) - 399))
        for i in range(len(t) - 239):
            short.setdefault(t[i : i + 240], set()).add(k)
    for t in texts:
        gone, shared = np.zeros(len(t), bool), np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if long[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        for i in range(len(t) - 239):
            if len(short[t[i : i + 240]]) > 1:
                shared[i : i + 240] = True
        runs = np.flatnonzero(np.diff(shared.astype(int), prepend=0, append=0)).reshape(-1, 2)
        words = [sum(a <= m.start() and m.end() <= b for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)) for a, b in runs]
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        yield len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), sum(w > 50 for w in words)


@pytest.mark.parametrize("crowd", [2048, 2])
def test_repeats(spark, docs, none, monkeypatch, crowd):
    """Against all strings; among others passages of 55 words, short of 400 bytes, in texts that share nothing else, one
    at a text's start, one at its end, one twice in one text alone, and strings that overlap themselves."""
    passage = [" ".join(f"p{k}x{i}" for i in range(55)) for k in range(4)]
    assert all(300 < len(p) < 400 for p in passage)
    more = [(100, text(100, 30, 7) + " " + passage[0] + " " + text(900, 30, 7)), (101, passage[0] + " " + text(1500, 40, 7)), (102, text(2500, 70, 11) + "\n" + passage[0])]
    more += [(103, f"{text(37, 20, 13)} {passage[1]} {text(38, 20, 13)} {passage[1]}"), (104, "z" * 900), (105, "z" * 300 + text(77, 60, 17)), (106, "ab " * 300)]
    more += [(110 + k, text(3000, 40) + f" {k} " + passage[2] + f" {k} {text(3100, 40 + k)}") for k in range(9)]
    every = [*TEXTS, *more]
    rows = [(i, t, "en", None, 0, "r", 0, "k", 5, "b", 1, 2, "w", 3) for i, t in every]
    monkeypatch.setattr(suffix, "CROWD", crowd)
    got = suffix.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), digests=True).collect()
    want = Counter((i, t, *w) for (i, t), w in zip(every, brute_repeats([(t or "").encode() for _, t in every]), strict=True))
    assert Counter((r.row.doc_id, r.row.text, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passages) for r in got) == want
    found = {r.row.doc_id: r for r in got}
    assert [found[i].n_passages for i in (100, 101, 102, 103, 4)] == [1, 1, 1, 0, 1] and found[100].n_removed == 0
    assert suffix.remove_repeats(none).count() == 0
    cut = {r.row.doc_id: r.kept for r in suffix.remove_repeats(spark.createDataFrame(more, "doc_id long, text string"), cut_passages=True).collect()}
    assert passage[0] not in cut[100] + cut[101] + cut[102] and passage[1] in cut[103] and cut[100].startswith(text(100, 30, 7))


def test_bpe(docs, none, monkeypatch):
    monkeypatch.setattr(bpe, "RANGE", 4)
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.encode_documents(docs, block_tokens=300).collect()
    assert counted(rows) == ALL
    for r in rows:
        assert list(r.ids) == real.encode_ordinary(r.row.text or "") and r.decoded == (r.row.text or "")
    rows = bpe.encode_documents(docs, block_tokens=300, digests=True).collect()
    assert counted(rows) == ALL
    for r in rows:
        ids, own = real.encode_ordinary(r.row.text or ""), (r.row.text or "").encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own).hexdigest())
    assert bpe.encode_documents(none).count() == bpe.encode_documents(none, digests=True).count() == 0


def test_sharding_by_levels(spark, monkeypatch):
    """Against one directory that is split bucket by bucket."""
    monkeypatch.setattr(extendible, "STRIDE", 2)
    rows = [(i, 1 + i * 37 % 90, "x") for i in range(600)]
    got = {r.row.k: (r.shard, r.depth, r.page) for r in extendible.shard(spark.createDataFrame(rows, "k long, b long, leaf string"), "k", "b", limit=700).collect()}
    bits = {k: f"{int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16):060b}" for k, _, _ in rows}
    todo, want = [("", [(k, b) for k, b, _ in rows])], {}
    while todo:
        prefix, held = todo.pop()
        if sum(b for _, b in held) <= 700:
            want |= {k: (prefix, len(prefix), 0) for k, _ in held}
        else:
            todo += [(prefix + x, [h for h in held if bits[h[0]].startswith(prefix + x)]) for x in "01"]
    assert got == want


def test_sharding(spark, docs, none):
    sized = docs.withColumn("n", F.octet_length(F.encode("text", "UTF-8")))
    rows = extendible.shard(sized, "doc_id", "n", limit=3000).collect()
    assert Counter((r.row.doc_id, r.row.text) for r in rows) == ALL
    shards = {}
    for r in rows:
        shards.setdefault((r.shard, r.page), []).append(r.n_bytes)
    assert all(sum(b) <= 3000 or len(b) == 1 for b in shards.values())
    assert extendible.shard(none, "doc_id", "n_chars").count() == 0
    hot = spark.createDataFrame([(1, 100)] * 500 + [(i, 100) for i in range(2, 300)], "k long, b long").repartition(4)
    pages = extendible.shard(hot, "k", "b", limit=1000).groupBy("shard", "page").agg(F.sum("n_bytes").alias("n"), F.count("*").alias("c"))
    assert pages.agg(F.max("n")).first()[0] <= 1000 and pages.agg(F.sum("c")).first()[0] == 798


def test_warc(spark, tmp_path):
    rows = [(1, "u", "a" * 50), (2, None, "a" * 50), (3, "u\r\nx", None), (None, "u", "a" * 50), (4, "u", ""), (5, "u", "b"), (5, "u", "b"), (6, "u", "é" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for least, revisits in ((0, {"2", "", "4"}), (10, {"2", ""})):
        path = f"file://{tmp_path}/w{least}"
        warc.archive_pages(pages, path, min_bytes=least)
        got = warc.read_archives(spark, path).collect()
        assert len(got) == len(rows) and {r.record_id[9:] for r in got if r.record_type == "revisit"} == revisits
        assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
        big = next(r for r in got if r.record_id == "urn:page:6")
        assert big.payload_bytes == 600_000 and big.payload_digest == base64.b32encode(hashlib.sha1(("é" * 300_000).encode()).digest()).decode()
    path = f"file://{tmp_path}/none"
    assert warc.archive_pages(pages.limit(0), path).count() == 0 and warc.read_archives(spark, path).count() == 0


def rendered(turns):
    """Text of turns and where the assistant's count, plainly."""
    out, spans = "", []
    for role, content in turns:
        out += f"<|{role or ''}|>\n"
        begin = len(out)
        out += f"{content or ''}\n<|end|>\n"
        if role == "assistant":
            spans.append((begin, len(out)))
    return out, spans


def test_preferences(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "good"), (0, 2, "user", None), (1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (2, 0, None, "x"), (2, 0, None, "x"), (3, 0, None, "x"), (3, 0, None, "x"), (3, 1, "assistant", "y"), (4, 0, "user", "alone"), (None, 0, "user", "n")]
    turns += [(6, 0, "user", "é" * 400_000), (6, 1, "assistant", "long"), (6, 2, "user", "more"), (6, 3, "assistant", "last"), (7, 0, "assistant", ""), (8, 0, "user", "q"), (8, 1, "assistant", "same"), (9, 0, "user", "r"), (9, 1, "assistant", "same")]
    clash = "pair_id long, c string, r string, n_prefix int, side boolean, t string, k int"
    rows = spark.createDataFrame([(*t, 9, "c", "r", 1, True, "t", 2) for t in turns], f"conv_id long, turn long, role string, text string, {clash}").repartition(3)
    got = {r.pair_id: r for r in preference.format_pairs(rows, F.floor(F.col("conv_id") / 2).cast("long"), F.pmod("conv_id", F.lit(2)) == 1).collect()}
    assert got[0].n_prefix == 1 and got[0].prompt == "<|user|>\nhi\n<|end|>\n" and got[1].n_prefix == 2 and got[1].chosen == ""
    assert not got[2].paired and got[2].rejected == "" and got[None].prompt == ""
    by = {}
    for conv, number, role, content in turns:
        by.setdefault(conv, []).append((number, role or "", role, content))
    by = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in by.items()}
    branches = preference.formatted(preference.branched(rows)).collect()
    assert Counter(r.pair_id for r in branches) == Counter(by.keys())
    for r in branches:
        own, mate = by[r.pair_id], [] if r.pair_id is None else by.get(r.pair_id ^ 1, [])
        last = [max((i for i, t in enumerate(x) if t[0] == "assistant"), default=None) for x in (own, mate)]
        other = mate if None in last else [*own[: last[0]], mate[last[1]]]
        n = next((i for i, (a, b) in enumerate(zip(own, other, strict=False)) if a != b), min(len(own), len(other)))
        assert (r.n_prefix, r.prompt, r.paired) == (n, rendered(own[:n])[0], bool(own and other))
        assert (r.chosen, [tuple(s) for s in r.chosen_spans]) == rendered(own[n:]) and (r.rejected, [tuple(s) for s in r.rejected_spans]) == rendered(other[n:])
    assert {r.pair_id: r.n_prefix for r in branches}[6] == 3 and {r.pair_id: r.n_prefix for r in branches}[8] == 2
    assert preference.format_pairs(rows.limit(0), F.col("conv_id"), F.lit(False)).count() == preference.branched(rows.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, none):
    for start in (docs, none):
        rows = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, "")
            assert rows.columns == docs.columns, name
        rows = rows.persist()
        last = corpus_pipeline.STAGES[-1][1](spark, rows, "").collect()
        assert len(last) == rows.count() and all(r.decodes for r in last)
        assert len(last) > 0 or start is none


def test_held_out_is_crc32(spark):
    rows = spark.range(50).withColumn("h", toxicity.held_out("id")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_near_recall(spark):
    """All pairs of the smallest table: those of similarity 0.8 or more are in one class, and a class is nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.class_id for r in minhash.query(spark, "/root/testdata/sf0.001").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = {i: minhash.shingles(t) for i, t in rows}
    near = [(i, j) for i in sets for j in sets if i < j and minhash.similarity(sets[i], sets[j]) >= 0.8]
    assert near and all(got[i] == got[j] for i, j in near)
    linked = {i for pair in near for i in pair}
    assert all(got[i] == i for i in sets if i not in linked)
