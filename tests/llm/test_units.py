"""The pure parts of the training-data operators, against brute force or a second implementation."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from millrace.llm import bpe, jpeg, minhash, suffix, toxicity, warc


def test_warc_archive_round_trip():
    records = [warc.record(f"urn:page:{i}", f"http://e/{i}\r\nx", (b"<p>hello %d</p>" % i) * (i % 7), None, "d") for i in range(200)]
    records.append(warc.record("urn:page:900", None, b"abc", "urn:page:1", "d"))
    archive = warc.pack(records)
    found = list(warc.unpack(archive))
    assert len(found) == 201
    assert found[5][1].endswith(b"<p>hello 5</p>" * 5)
    assert found[-1][0]["WARC-Type"] == "revisit" and b"Content-Length: 3" in found[-1][1]
    assert archive[:4] == bytes.fromhex("5d2a4d18")


@pytest.mark.parametrize("n", [0, 1, 3])
def test_warc_few_records(n):
    assert len(list(warc.unpack(warc.pack([warc.record("urn:page:1", "u", b"", None, "d")] * n)))) == n


def test_jpeg_payloads_come_back():
    rng = np.random.default_rng(0)
    for n in (576, 576 * 5, 576 * 342, 576 * 8192):
        payloads = [rng.integers(0, 256, n, dtype=np.uint8).tobytes(), b"\xff" * n, b"\0\xff" * (n // 2)]
        media = jpeg.encode_frames(payloads)
        assert [b"".join(i.tobytes() for i in x) for x in jpeg.thumbnails(media)] == payloads


def _bits(text):
    text += "1" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8).replace(b"\xff", b"\xff\0")


def test_jpeg_colour_with_subsampling_and_ac_coefficients():
    """A 16x16 image of one 2x2,1x1,1x1 unit without restart markers: AC coefficients are stepped over."""
    dc = bytes([0, 1, 5, 1, 1, 1, *[0] * 10, *range(9)])  # codes by length
    ac = bytes([0, 2, 1, *[0] * 13, 0x00, 0x21, 0xF0])
    codes, code, k = {}, 0, 0
    for length in range(1, 17):
        for _ in range(dc[length - 1]):
            codes[dc[16 + k]] = f"{code:0{length}b}"
            code, k = code + 1, k + 1
        code <<= 1
    size3, zero = codes[3] + "101", codes[0]
    eob, run2 = "00", "01" + "1"
    data = _bits(size3 + run2 + eob + zero + eob + zero + run2 + eob + zero + eob + zero + eob + zero + eob)
    seg = jpeg._segment
    media = b"\xff\xd8" + seg(0xDB, bytes([0]) + bytes([16] * 64)) + seg(0xC0, b"\x08\0\x10\0\x10\x03\x01\x22\0\x02\x11\0\x03\x11\0")
    media += seg(0xC4, b"\0" + dc) + seg(0xC4, b"\x10" + ac) + seg(0xDA, b"\x03\x01\0\x02\0\x03\0\0\x3f\0") + data + b"\xff\xd9"
    ((image,),) = jpeg.thumbnails([media])
    assert image.tolist() == [[138, 138], [138, 138]]  # 5 * 16 / 8 + 128


def test_bpe_words_as_tiktoken():
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    for _ in range(500):
        word = "".join(rng.choice("abcdeé the日本ing 1234!?\n") for _ in range(rng.choice([1, 3, 8, 40, 300])))
        assert bpe.merge_word(word.encode(), ranks) == real._encode_single_piece(word.encode())
    assert len(bpe.merge_word(b"ab" * 50_000, ranks)) > 0


def test_bpe_packing():
    for values in ([], [0], [191, 192, 70_000, 63 << 16, (1 << 32) - 1], list(range(0, 10**6, 997))):
        assert bpe.unpack_ints(bpe.pack_ints(np.array(values, np.uint32))).tolist() == values


def _jp(a, b):
    x, y = (dict(zip(k.tolist(), w.tolist(), strict=True)) for k, w in (a, b))
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())


def test_probability_jaccard_exact_and_estimated():
    rng, errors = random.Random(0), []
    for k in range(120):
        words = [str(rng.randrange(25)) for _ in range(150)]
        other = list(words)
        for _ in range(k % 12):
            other[rng.randrange(150)] = "z"
        a, b = minhash.shingles(" ".join(words), 2), minhash.shingles("  ".join(other), 2)
        exact = minhash.similarity(a, b)
        assert abs(exact - _jp(a, b)) < 1e-9
        errors.append((minhash.signature(*a) == minhash.signature(*b)).mean() - exact)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_shingles_of_short_and_empty_texts():
    assert len(minhash.shingles("")[0]) == len(minhash.shingles(" \n")[0]) == 0
    assert len(minhash.shingles("one two")[0]) == 1
    assert minhash.similarity(minhash.shingles("a b"), minhash.shingles("a b")) == 1.0


def test_bwt_finds_repeated_windows():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.choice([9, 12, 20])
        base = [bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(3)]
        pieces = []
        for _ in range(rng.randrange(1, 12)):
            p = b"".join(rng.choice(base)[rng.randrange(20) :][: rng.randrange(5, 40)] for _ in range(3))
            pieces.append(p + b"x" * max(0, n - len(p)))
        count = Counter(p[i : i + n] for p in pieces for i in range(len(p) - n + 1))
        for p, marks in zip(pieces, suffix.repeated_windows(pieces, n), strict=True):
            assert marks.tolist() == [count[p[i : i + n]] > 1 for i in range(len(p) - n + 1)]


def test_stretches_cover_every_window_once():
    raw = np.frombuffer(random.Random(1).randbytes(5000) + b"a" * 900, np.uint8)
    mini, content, first, n = suffix.stretches(raw)
    assert first[0] == 0 and (first[1:] == (first + n)[:-1]).all() and first[-1] + n[-1] == len(raw) - 399
    assert len(suffix.stretches(raw[:399])[0]) == 0


def test_fold_and_lexicon():
    assert toxicity.fold("1d10t L0s3r ѕсum tr4$h 5tup1d $cum 1234 é") == "idiot loser scum trash stupid scum 1234 é"
    model = toxicity.Model({"loser": 9.0, "trash": 9.0}, slope=2.0, bias=-3.0)
    m = model.matcher()
    assert m.score("what a 1oser you are") > 0.5 > m.score("closer")
    assert m.score("put it in the trash can") < 0.5 and m.score(None) == m.score("")
