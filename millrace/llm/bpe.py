"""Operator 8, byte-level BPE encoding and decoding by a global distinct-word shuffle.

Texts are cut into pre-tokens once, in blocks of documents. A block keeps, for each document, its pre-tokens as
positions' numbers into the block's own list of distinct words. The distinct words of all blocks are shuffled, each
is encoded once, its ids go back to the blocks that have it, and every document is put together by position. Decoding
joins the token-byte table to the ids of each distinct word of a block, and goes the same way. Words and positions
travel packed, a row for many of them.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import release_memory, stage_table

VOCABULARY = "byte_bpe_50k.tiktoken"
BLOCK_TOKENS = 8_000_000
LEVEL = 8  # of compression
BUCKETS = 64  # of word hashes; a block of many texts has some thousand distinct words in each
PACKED = 1 << 20  # numbers packed at a time
RANGE = 2048  # blocks (some 60 GB of text) whose words of one bucket meet in one group


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank merges, leftmost first, until none has a rank.

    Parts are a linked list over the bytes and the candidate pairs a heap, so a very long pre-token costs n log n.
    """
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

    def pair(i: int) -> tuple[int, int, int] | None:
        j = after[i]
        if j >= n:
            return None
        rank = ranks.get(word[i : after[j]])
        return None if rank is None else (rank, i, after[j])

    heap = [p for i in range(n) if (p := pair(i))]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        if not alive[i] or after[i] >= n or after[after[i]] != end:
            continue  # one of its parts has merged meanwhile
        j = after[i]
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
        for k in (before[i], i):
            if k >= 0 and (p := pair(k)):
                heappush(heap, p)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


def pack_ints(values: np.ndarray) -> bytes:
    """32-bit numbers, compressed: one byte for those under 192, else the number's third byte and, apart, the lower two.

    Numbers from 63 << 16 are listed whole as well. Numbers are taken by the million, which bounds what is held beside them.
    """
    streams: list[list[bytes]] = [[], [], [], []]
    for at in range(0, len(values), PACKED):
        part = np.ascontiguousarray(values[at : at + PACKED], np.uint32)
        high = np.minimum(part >> 16, 63).astype(np.uint8)
        rest = part[part >= 192]
        streams[0].append(np.where(part < 192, part.astype(np.uint8), 192 + high).astype(np.uint8).tobytes())
        streams[1].append((rest >> 8).astype(np.uint8).tobytes())
        streams[2].append(rest.astype(np.uint8).tobytes())
        streams[3].append(part[part >= 63 << 16].tobytes())
    frames = [zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(x)) for x in streams]
    return struct.pack("<4I", *map(len, frames)) + b"".join(frames)


def unpack_ints(packed: bytes) -> np.ndarray:
    ends = np.cumsum([16, *struct.unpack_from("<4I", packed)]).tolist()
    raw = [np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[a:b]), np.uint8) for a, b in zip(ends, ends[1:], strict=False)]
    out = np.empty(len(raw[0]), np.uint32)
    used = 0
    for at in range(0, len(out), PACKED):
        part = raw[0][at : at + PACKED].astype(np.uint32)
        wide = np.flatnonzero(part >= 192)
        middle, low = (x[used : used + len(wide)].astype(np.uint32) for x in raw[1:3])
        part[wide] = ((part[wide] - 192) << 16) | (middle << 8) | low
        out[at : at + PACKED] = part
        used += len(wide)
    out[np.flatnonzero(out >= 63 << 16)] = raw[3].view(np.uint32)
    return out


def _pack_words(words: list[str]) -> bytes:
    raw = [w.encode() for w in words]
    sizes = pack_ints(np.array([len(w) for w in raw]))
    return struct.pack("<I", len(sizes)) + sizes + zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(raw))


def _unpack_words(packed: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<I", packed)
    ends = np.cumsum(unpack_ints(packed[4 : 4 + n])).tolist()
    raw = zstandard.ZstdDecompressor().decompress(packed[4 + n :])
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def blocks(df: DataFrame, text: str, keep: list[str], pattern: str, block_tokens: int, buckets: int) -> DataFrame:
    """Pre-tokens of all texts, in blocks of documents.

    A block gives a row ``block, rows, data, numbers``: its documents, their pre-tokens by position, as numbers into
    the block's distinct words (the more frequent, the smaller), and how many each document has. The distinct words
    give rows ``block, bucket, data, numbers``, one for each bucket of word hashes. A block ends after
    ``block_tokens`` pre-tokens, with the document.
    """
    kept = df.select(*[F.col(f"`{c}`") for c in keep]).schema
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("rows", T.ArrayType(kept)), T.StructField("data", T.BinaryType()), T.StructField("numbers", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        part, count = TaskContext.get().partitionId(), 0
        numbers: dict[str, int] = {}
        rows: list[pa.Array] = []
        texts: list[np.ndarray] = []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal count, numbers, rows, texts
            block, sizes = part << 32 | count, [len(t) for t in texts]
            used = np.concatenate([np.zeros(0, np.uint32), *texts])
            order = np.argsort(-np.bincount(used, minlength=len(numbers)), kind="stable")
            renumber = np.empty(len(order), np.uint32)
            renumber[order] = np.arange(len(order), dtype=np.uint32)
            row = pa.concat_arrays(rows)
            held = pa.ListArray.from_arrays(pa.array([0, len(row)], pa.int32()), row)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.nulls(1, pa.int32()), held, pa.array([pack_ints(renumber[used])], pa.binary()), pa.array([pack_ints(np.array(sizes))], pa.binary())], schema.names)
            words = list(numbers)
            by_bucket: dict[int, list[int]] = {}
            for k in order.tolist():
                by_bucket.setdefault(zlib.crc32(words[k].encode()) % buckets, []).append(k)
            if by_bucket:
                packed = [_pack_words([words[k] for k in ks]) for ks in by_bucket.values()]
                which = [pack_ints(np.diff(renumber[ks], prepend=np.uint32(0))) for ks in by_bucket.values()]
                n = len(packed)
                yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array(list(by_bucket), pa.int32()), pa.nulls(n, held.type), pa.array(packed, pa.binary()), pa.array(which, pa.binary())], schema.names)
            count, numbers, rows, texts = count + 1, {}, [], []
            release_memory()

        tokens = 0
        for batch in batches:
            row, start = batch.column("row"), 0
            for k, x in enumerate(batch.column("text")):
                at = [numbers.setdefault(w, len(numbers)) for w in find(x.as_py() or "")]
                texts.append(np.array(at, np.uint32))
                tokens += len(at)
                if tokens >= block_tokens:
                    rows.append(row[start : k + 1])
                    yield from close()
                    start, tokens = k + 1, 0
            if start < len(row):
                rows.append(row[start:])
        if rows:
            yield from close()

    picked = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text).alias("text"))
    return picked.mapInArrow(cut, schema)


def encode_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``block, numbers, lengths, ids`` for ``block, bucket, range, data, numbers``: the words of a bucket, from all blocks
    of a range, meet in one group (dealt by the words' hashes, so of even size), where each distinct word is encoded
    once. Ranges bound a group; up to 60 GB of text there is one."""
    shipped = words.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary: a fixed size

    def encode(group: pa.Table) -> pa.Table:
        table, known, lengths, ids = shipped.value, {}, [], []
        for packed in group.column("data"):
            found = []
            for w in _unpack_words(packed.as_py()):
                if w not in known:
                    known[w] = merge_word(w, table)
                found.append(known[w])
            lengths.append(pack_ints(np.array([len(f) for f in found])))
            ids.append(pack_ints(np.fromiter(chain.from_iterable(found), np.uint32)))
        del known
        release_memory()
        return pa.Table.from_arrays([group.column("block"), group.column("numbers"), pa.array(lengths, pa.binary()), pa.array(ids, pa.binary())], ["block", "numbers", "lengths", "ids"])

    return words.groupBy("bucket", "range").applyInArrow(encode, "block long, numbers binary, lengths binary, ids binary")


def encode_documents(df: DataFrame, text: str = "text", keep: list[str] | None = None, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN, block_tokens: int = BLOCK_TOKENS, digests: bool = False, texts: bool = True) -> DataFrame:
    """Every row of ``df`` as ``row`` with ``ids`` and the text decoded from them, ``decoded``.

    Without ``texts``, ``decoded_sha256`` stands for the text, which spares its way through the last shuffle. With ``digests``, ``n_tokens, ids_sha256, decoded_sha256`` stand in their place. A null text is empty: no
    ids. Repeated rows are encoded as often as they come. ``vocabulary`` is the path of a rank file.
    """
    ranks = load_ranks(vocabulary or public_tokenizers.path(VOCABULARY))
    keep = df.columns if keep is None else keep
    cut = stage_table(blocks(df, text, keep, pattern, block_tokens, BUCKETS), "bpe-blocks")
    ranges = -(-cut.filter("bucket IS NULL").count() // RANGE) or 1
    words = cut.filter("bucket IS NOT NULL").select("block", "bucket", F.pmod(F.xxhash64("block"), F.lit(ranges)).alias("range"), "data", "numbers")
    tables = encode_words(words, ranks).select(F.col("block").alias("of_block"), "numbers", "lengths", "ids")
    kept = cut.schema["rows"].dataType.elementType
    if digests:
        out = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    else:
        out = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded" if texts else "decoded_sha256", T.StringType())]
    # The token-byte table: one entry per id, a fixed size.
    spelled = df.sparkSession.sparkContext.broadcast({rank: token for token, rank in ranks.items()})

    def assemble(docs: pa.Table, table: pa.Table) -> pa.Table:
        token, numbers, sizes, ids = spelled.value, [], [], []
        for a, b, c in zip(table.column("numbers"), table.column("lengths"), table.column("ids"), strict=True):
            numbers.append(np.cumsum(unpack_ints(a.as_py()), dtype=np.uint32))
            sizes.append(unpack_ints(b.as_py()))
            ids.append(unpack_ints(c.as_py()))
        numbers, sizes, ids = (np.concatenate([np.zeros(0, np.uint32), *x]) for x in (numbers, sizes, ids))
        n = len(numbers)
        counts, first, parts, said = np.zeros(n, np.int64), np.zeros(n, np.int64), np.empty(n, object), np.empty(n, object)
        ends = np.cumsum(sizes, dtype=np.int64)
        counts[numbers], first[numbers] = sizes, ends - sizes
        raw = [token[i] for i in ids.tolist()]  # the join with the token-byte table
        listed = list(map(str, ids.tolist())) if digests else []
        for number, a, b in zip(numbers.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
            parts[number] = b"".join(raw[a:b])
            if digests:
                said[number] = " ".join(listed[a:b])
        columns: list[list] = [[] for _ in out]
        at = unpack_ints(docs.column("data")[0].as_py())
        stops = np.cumsum(unpack_ints(docs.column("numbers")[0].as_py())).tolist()
        for start, stop in zip([0, *stops], stops, strict=False):
            own = at[start:stop]
            decoded, size = b"".join(parts[own].tolist()), counts[own]
            if digests:
                made = (int(size.sum()), hashlib.sha256(" ".join(said[own].tolist()).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest())
            else:
                behind = np.cumsum(size)
                place = np.repeat(first[own] - behind + size, size) + np.arange(behind[-1] if len(behind) else 0)
                made = (ids[place].astype(np.int32), decoded.decode() if texts else hashlib.sha256(decoded).hexdigest())
            for column, x in zip(columns, made, strict=True):
                column.append(x)
        kinds = (pa.int64(), pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.string())
        del numbers, sizes, ids, parts, said, raw, listed, at
        release_memory()
        return pa.Table.from_arrays([docs.column("rows").combine_chunks().flatten(), *map(pa.array, columns, kinds)], ["row", *(f.name for f in out)])

    docs = cut.filter("bucket IS NULL").select("block", "rows", "data", "numbers")
    joined = docs.groupBy("block").cogroup(tables.groupBy("of_block"))
    return joined.applyInArrow(assemble, T.StructType([T.StructField("row", kept), *out])).select("row", *(f.name for f in out))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, keep=["doc_id"], digests=True).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
