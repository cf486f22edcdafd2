"""The pipeline, stage by stage and as a whole, against plain loops over a small table."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from millrace.llm import bpe, minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def documents():
    rng = random.Random(21)
    words = [f"{a}{b}{c}é"[: rng.randrange(4, 9)] for a in ("ba", "ke", "li", "so", "tu") for b in ("n", "r", "st", "lm") for c in ("ado", "ine", "uro", "eks")]
    fresh = lambda n: " ".join(rng.choice(words) + str(rng.randrange(1000)) for _ in range(n))
    passage, long = fresh(54), fresh(120)
    texts = [fresh(rng.randrange(55, 140)) for _ in range(30)]
    texts += [texts[0], texts[1] + " tail", texts[1].replace(texts[1].split()[9], "other"), fresh(70) + " " + passage + " " + fresh(60), passage + "\n" + fresh(80), fresh(60) + " " + passage]
    texts += [f"{fresh(90)} {long} {fresh(50)}", f"{fresh(40)} {long}\n{fresh(90)}", None, "", "few words", "same line here\n" * 60, fresh(30) + " \n " + fresh(40)]
    rows = [(k, t, "en", rng.choice(["a", "a", "b", None, "c"]), len(t or "")) for k, t in enumerate(texts)]
    return [*rows, (None, fresh(60), "en", "a", 1), (4, rows[4][1], "en", rows[4][3], rows[4][4]), (70, fresh(10), "en", "bad", 1), (71, fresh(12), "en", "bad", 1)]


def judged(rows):
    def fails(t):
        ws = WORD.findall(t or "")
        grams = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        hit = {i + j for i, g in enumerate(zip(ws, ws[1:], ws[2:], strict=False)) if grams[g] > 1 for j in range(3)}
        return len(ws) < 50 or 2 * len(hit) > len(ws)

    failed, hosts = [fails(r[1]) for r in rows], {}
    for r, f in zip(rows, failed, strict=True):
        hosts.setdefault(r[3], []).append(f)
    n, m = len(rows), sum(failed) / len(rows)
    between = sum(sum(h) ** 2 / len(h) for h in hosts.values()) / n - m * m
    s = min(max(m * (1 - m) / max(between - m * (1 - m) * len(hosts) / n, 1e-12) - 1, 1.0), 1e6)
    bad = {h for h, f in hosts.items() if (sum(f) + m * s) / (len(f) + s) > 0.5}
    return [r for r, f in zip(rows, failed, strict=True) if not f and r[3] not in bad]


def one_of_each(rows):
    sets, parent = [minhash.shingles(r[1] or "") for r in rows], list(range(len(rows)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or minhash.similarity(sets[i], sets[j]) >= 0.8:
                parent[root(i)] = root(j)
    classes = {}
    for i, r in enumerate(rows):
        classes.setdefault(root(i), []).append(r)
    return [min(c, key=lambda r: (r[0] is None, r[0] or 0)) for c in classes.values()]


def cut(rows):
    raw = [(r[1] or "").encode() for r in rows]
    long, short = Counter(), {}
    for k, t in enumerate(raw):
        long.update(t[i : i + 400] for i in range(len(t) - 399))
        for i in range(len(t) - 239):
            short.setdefault(t[i : i + 240], set()).add(k)
    out = []
    for r, t in zip(rows, raw, strict=True):
        gone, shared = bytearray(len(t)), bytearray(len(t))
        for i in range(len(t) - 399):
            if long[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        for i in range(len(t) - 239):
            if len(short[t[i : i + 240]]) > 1:
                shared[i : i + 240] = b"\1" * 240
        for m in re.finditer(b"\1+", shared):
            whole = [w for w in re.finditer(rb"[^\x20\x09-\x0D]+", t) if m.start() <= w.start() and w.end() <= m.end()]
            if len(whole) > 50:
                gone[m.start() : m.end()] = b"\1" * (m.end() - m.start())
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g).decode(errors="ignore")
        out.append((r[0], kept, r[2], r[3], len(kept)))
    return out


def mixed(rows):
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    key = [int(hashlib.md5(f"{'' if r[0] is None else r[0]}|{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16) for r in rows]
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(n for r, n in zip(rows, size, strict=True) if r[3] == s) for s in names}
    target, left, free = dict.fromkeys(names, 0.0), 1.5 * sum(size), set(names)
    while left > 1e-9 and free:  # hand it round until nothing is above its bound
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if target[s] + share * weight[s] >= 2 * total[s]}
        for s in full or free:
            more = min(share * weight[s], 2 * total[s] - target[s])
            target[s] += more
            left -= more
        free -= full
        if not full:
            break
    taken = []
    for s in names:
        own = sorted((k, i) for i, k in enumerate(key) if rows[i][3] == s)
        if not total[s]:
            continue
        copies = int(target[s] // total[s])
        rest, run, stop = target[s] - copies * total[s], 0, None
        for k in sorted({k for k, _ in own}):
            group = sum(size[i] for h, i in own if h == k)
            if run + group > rest:
                stop = k + (2 * run + group <= 2 * rest)
                break
            run += group
        taken += [rows[i] for k, i in own for _ in range(copies + (stop is not None and k < stop))]
    return taken


def test_stages_by_brute_force(spark):
    rows = documents()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    plain = {"quality": judged, "near_duplicates": one_of_each, "repeats": cut, "mixture": mixed}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = plain[name](rows)
        got = stage(spark, spark.createDataFrame(rows, schema).repartition(3), "").select(*NAMES).collect()
        assert Counter(map(tuple, got)) == Counter(want), name
        assert len(want) < len(rows) or name in ("repeats", "mixture")
        assert name != "repeats" or sum(a[1] != b[1] for a, b in zip(rows, want, strict=True)) >= 5
        rows = want
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    ids = {t: tuple(real.encode_ordinary(t)) for _, t, *_ in rows}
    got = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(rows, schema), "").collect()
    assert Counter((r.doc_id, r.lang, r.source, r.n_tokens, tuple(r.ids), r.decodes) for r in got) == Counter((i, lang, s, len(ids[t]), ids[t], True) for i, t, lang, s, _ in rows)


def test_run_is_its_stages(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    want = mixed(cut(one_of_each(judged(rows))))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[3]) for r in want) and all(r.decodes for r in got)


def test_what_is_read(spark, tmp_path):
    path = f"{tmp_path}/x"
    spark.range(3).write.parquet(path)
    assert [r.removeprefix("file:") for r in corpus_pipeline.read_from(spark.read.parquet(path).filter("id > 0"))] == [path] and corpus_pipeline.read_from(spark.range(3).selectExpr("id")) == []
