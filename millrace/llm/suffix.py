"""Operator 4, repeated passages by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Strings of two lengths are looked for: of 400 bytes (repeated ones are removed) and of 240 bytes (passages consist of
those that are in another text too). For either length a place where such a string starts belongs to the string's
minimiser, the least-hashed 32-gram in it (leftmost of equals). Equal strings have equal minimisers, so they meet if the
stretches of places of one minimiser do; stretches are done with whose minimiser, with half of the rest of a string
before or behind it, is nowhere else. The others are dealt out by minimiser into batches of bounded size. A batch is
sorted by suffixes, and intervals of its transform are extended backwards, breadth first: the common prefixes of
neighbouring suffixes come out by increasing length, and what has none when the expansion passes 240, or stops at
400, is shared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from millrace.llm.common import release_memory, respread, stage_table, text_bytes
from millrace.llm.minhash import mix

LENGTH = 400  # bytes of a repeated string
SHORT = 240  # bytes of a string that a passage consists of; fewer than 51 words of running text have
LENGTHS = (LENGTH, SHORT)  # by kind
PASSAGE_WORDS = 50  # a passage has more whole words than these
GRAM = 32
BATCH_BYTES = 1 << 20
CROWD = 2048  # different stretches of one minimiser in a batch; more are dealt to several batches
_U = np.uint64
_SLICE = 1 << 23  # places taken at a time; positions have 24 bits
_TOGETHER = 1 << 17  # bytes of short texts that are taken together

_WINDOW = np.dtype([("hash", "<u8", 2), ("sid", np.int64), ("low", np.int64), ("place", np.int16), ("kind", np.int8), ("multi", np.int8)])
_STRETCH = ("mini", "content", "halves", "first", "n", "content_l", "halves_l", "first_l", "n_l")
_SEED = mix(np.arange(7, 263, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_A, _B = _U(0x9E6C63D0876A9A47), _U(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


# ---------------------------------------------------------------- stretches and their minimisers


def _join(h: np.ndarray, d: int) -> np.ndarray:
    """Hashes of pieces twice as long from those of pieces ``d`` apart."""
    x = h[:-d] * _A + h[d:]
    x ^= x >> _U(32)
    x *= _B
    return x


def _grams(raw: np.ndarray) -> np.ndarray:
    h = _SEED[raw]
    for d in (1, 2, 4, 8, 16):
        h = _join(h, d)
    return mix(h)


def stretches(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Stretches of texts' places, and how many each text has: minimiser hash, and content hash, halves, first place and
    number of places of its strings of 240 bytes, then of those of 400 (-1 for the number if it has none).

    A minimiser of strings of 400 bytes is one of strings of 240 too. The content is that of ``piece``. ``halves`` has
    32 bits of a hash of the minimiser with half of the rest of a string before it, and of that with half behind it; 0
    where no string of the stretch has so much.
    """
    out, counts, start, size = [], [], 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= _TOGETHER or k + 1 == len(texts):
            table, each = _stretches(texts[start : k + 1])
            out.append(table)
            counts.append(each)
            start, size = k + 1, 0
    if not out:
        return [np.zeros(0, np.int64)] * 9, np.zeros(0, np.int64)
    return [np.concatenate(c) for c in zip(*out, strict=True)], np.concatenate(counts)


def _stretches(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Of texts laid end to end; a long one is taken in slices of places. No string reaches over a text's end."""
    whole = b"".join(texts)
    raw, view = np.frombuffer(whole, np.uint8), memoryview(whole)
    ends = np.cumsum([len(t) for t in texts])
    parts: list[list[list[np.ndarray]]] = [[], []]
    for at in range(0, max(0, len(raw) - SHORT + 1), _SLICE):
        part = raw[at : at + _SLICE + LENGTH - 1]
        grams = _grams(part)
        ranked = (grams & ~_U((1 << 24) - 1)) | np.arange(len(grams), dtype=np.uint64)
        double = _join(_join(grams, 32), 64) if len(part) >= 128 else grams
        least, d = ranked, 1
        for kind, length in ((1, SHORT), (0, LENGTH)):
            n, width, side = min(len(part) - length + 1, _SLICE), length - GRAM + 1, (length - GRAM) // 2
            if n < 1:
                continue
            while 2 * d <= width:
                least = np.minimum(least[:-d], least[d:])
                d *= 2
            place = (np.minimum(least[:n], least[width - d :][:n]) & _U((1 << 24) - 1)).astype(np.int64)
            inner = ends[(ends > at) & (ends < at + n + length)] - at  # strings that begin before one end behind it
            for e in inner.tolist():
                place[max(0, e - length + 1) : e] = -1
            edge = np.flatnonzero(np.diff(place, prepend=-2))
            count = np.diff(edge, append=n)
            mini = place[edge]
            edge, count, mini = edge[mini >= 0], count[mini >= 0], mini[mini >= 0]
            half = (mix(_join(double, GRAM + side - 128)) & _U(0xFFFFFFFF)) | _U(1)
            left, right = mini - side, mini
            has = left >= edge, right + GRAM + side <= edge + count - 1 + length
            left, right = (np.where(h, half[np.clip(x, 0, len(half) - 1)], 0).astype(np.uint64) for h, x in zip(has, (left, right), strict=True))
            content = np.array([xxh3_64_intdigest(view[a : a + k + length - 1]) for a, k in zip((edge + at).tolist(), count.tolist(), strict=True)], np.uint64)
            parts[kind].append([mini + at, content.view(np.int64), ((left << _U(32)) | right).view(np.int64), edge + at, count, grams[mini].view(np.int64)])
    if not parts[1]:
        return [np.zeros(0, np.int64)] * 9, np.zeros(len(texts), np.int64)
    short = [np.concatenate(c) for c in zip(*parts[1], strict=True)]
    more = np.zeros((4, len(short[0])), np.int64)
    more[3] = -1
    if parts[0]:
        long = [np.concatenate(c) for c in zip(*parts[0], strict=True)]
        more[:, np.searchsorted(short[0], long[0])] = long[1:5]
    owner = np.searchsorted(ends, short[3], side="right")
    begin = (ends - [len(t) for t in texts])[owner]
    has = more[3] >= 0
    more[2, has] -= begin[has]
    return [short[5], short[1], short[2], short[3] - begin, short[4], *more], np.bincount(owner, minlength=len(texts))


def piece(raw: memoryview, first: int, n: int, length: int) -> memoryview:
    """What the strings at a stretch's places cover."""
    return raw[first : first + n + length - 1]


# ---------------------------------------------------------------- the transform


def sort_suffixes(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes in order of their first ``depth`` (over 8) symbols, by prefix multiplication.

    The ranks of pieces of a known length are put together three to a key where they fit into 21 bits, else two.
    """
    n = len(text)
    key = _first_eight(text)
    known = 8
    while True:
        order = np.argsort(key)
        if known >= depth:
            return order
        ordered = key[order]
        new = np.empty(n, np.uint32)
        new[0] = 1
        new[1:] = ordered[1:] != ordered[:-1]
        np.cumsum(new, out=new)
        rank = np.empty(n, np.uint64)
        rank[order] = new
        parts, bits = (3, 21) if new[-1] < 1 << 21 else (2, 32)
        reach = min(depth, parts * known)
        key = rank << _U(bits * (parts - 1))
        for k in range(1, parts):  # the last pieces overlap where less is wanted
            at = min(k * known, reach - known)
            key[:-at] |= rank[at:] << _U(bits * (parts - 1 - k))
        known = reach


def bounded_prefixes(text: np.ndarray, order: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each of the increasing ``lengths`` (8 or more): at each place in ``order``, whether its suffix shares so many
    symbols with the one before.

    Symbol 0 ends a string; no common prefix is continued behind it. Breadth-first: an interval of suffixes that
    start with w gives, for each symbol c before them, that of cw. Where such an interval ends and no common prefix
    is known yet, it has the length of w, and the interval is extended further; else it is dropped. The first eight
    lengths, for which nearly all intervals branch, are read off the suffixes' first eight symbols.
    """
    n = len(text)
    before = text[order - 1]  # of suffix 0 it is the last symbol, an end
    by_symbol = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)
    step[by_symbol] = np.arange(n)
    run = np.cumsum(np.concatenate([[0], before[1:] != before[:-1]]))
    key = _first_eight(text)[order]
    differ = key[1:] ^ key[:-1]
    unknown = np.ones(n + 1, bool)
    unknown[0] = unknown[n] = False
    unknown[1:n] = differ == 0
    edges = np.concatenate([[0], np.flatnonzero(differ) + 1])
    seven = np.flatnonzero(differ[edges[1:] - 1] < 256)  # intervals of eight symbols behind which seven are shared
    low, high = edges[seven], edges[seven + 1]
    found = []
    for length in range(8, lengths[-1]):
        if length in lengths:
            found.append(unknown.copy())
        if not len(low):
            continue
        last = high - 1
        plain = run[low] == run[last]  # one symbol before all of them: one interval
        a, b, c = step[low[plain]], step[last[plain]] + 1, before[low[plain]]
        low, high = low[~plain], high[~plain]
        if len(low):
            size = high - low
            owner = np.repeat(np.arange(len(low)), size)
            rows = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
            to = step[rows]
            sort = np.argsort(to)
            to, owner, symbol = to[sort], owner[sort], before[rows[sort]]
            new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])]))
            ends = np.append(new[1:], len(to)) - 1
            a, b, c = np.concatenate([a, to[new]]), np.concatenate([b, to[ends] + 1]), np.concatenate([c, symbol[new]])
        keep = unknown[b] & (c != 0)
        low, high = a[keep], b[keep]
        unknown[high] = False
    return [*found, unknown]


def _first_eight(text: np.ndarray) -> np.ndarray:
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded[:8].view(">u8"), (len(text),), (1,)).astype(np.uint64)


def shared_places(pieces: list[bytes], places: np.ndarray, kinds: np.ndarray, low: np.ndarray, multi: np.ndarray) -> list[np.ndarray]:
    """For each piece and each of its ``places`` first starts: whether the string there is shared.

    Of kind 0 it is if its 400 bytes start at another such place of these pieces; of kind 1, if its 240 bytes do so in
    another text. ``low`` has the texts of the pieces; one marked ``multi`` is of several texts by itself.
    """
    sizes = np.array([len(p) + 1 for p in pieces])
    # UTF-8 has no byte 255, so one may be added to each to make room for the ends.
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8) + np.uint8(1)
    order = sort_suffixes(text, LENGTH)
    alike = bounded_prefixes(text, order, (SHORT, LENGTH))[::-1]
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(pieces)), sizes)
    # What follows a piece's places is there for their strings' sake; the same bytes are places of other pieces.
    own = np.arange(len(text)) - starts[owner] < places[owner]
    kind = kinds[owner]
    found = np.zeros(len(text), bool)
    for k, same in enumerate(alike):
        mine = (own & (kind == k))[order]
        rows = order[mine]
        if not len(rows):
            continue
        groups = np.cumsum(~same[:-1])[mine]  # runs of equal strings, in the order of suffixes
        edge = np.flatnonzero(np.diff(groups, prepend=-1))
        size = np.diff(edge, append=len(rows))
        if k == 0:
            several = size > 1
        else:
            of = owner[rows]
            several = np.minimum.reduceat(low[of], edge) < np.maximum.reduceat(low[of], edge)
            several |= np.maximum.reduceat(multi[of].astype(np.int8), edge) > 0
        found[rows] = np.repeat(several, size)
    return [found[s : s + n] for s, n in zip(starts.tolist(), places.tolist(), strict=True)]


# ---------------------------------------------------------------- tables


def repeated_spans(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``text_key, parts`` for each distinct text with shared strings: ``parts`` lists kinds, first places and bit maps.

    ``key`` only helps to find a text again; it may be null or repeated.
    """
    picked = df.select(F.col(key).alias("row_key"), F.md5(F.coalesce(text, F.lit(""))).alias("text_key"), text_bytes(text).alias("raw"))
    item = "struct<mini:bigint,content:bigint,halves:bigint,first:int,n:smallint,content_l:bigint,halves_l:bigint,first_l:int,n_l:smallint>"
    schema = T.StructType([picked.schema["row_key"], T.StructField("text_key", T.StringType()), *T._parse_datatype_string(f"parts array<{item}>").fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.int64(), pa.int64(), pa.int32(), pa.int16()] * 2]
        for batch in batches:
            table, each = stretches(batch.column("raw").to_pylist())
            none = pa.array(table[8] < 0)
            columns = [pa.array(c, pa.int64()).cast(k) for c, k in zip(table, kinds, strict=True)]
            columns[5:] = [pc.if_else(none, pa.scalar(None, c.type), c) for c in columns[5:]]
            parts = pa.StructArray.from_arrays(columns, list(_STRETCH))
            offsets = pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("text_key"), pa.ListArray.from_arrays(offsets, parts)], schema.names)

    rows = stage_table(picked.mapInArrow(cut, schema).filter("size(parts) > 0").withColumn("uid", F.monotonically_increasing_id()), "rep-stretches")
    texts = stage_table(rows.groupBy("text_key").agg(F.min("uid").alias("uid"), F.count("*").alias("copies")), "rep-texts", [rows])
    kept = rows.join(texts.select(F.col("uid").alias("one"), F.least("copies", F.lit(2)).cast("int").alias("copies")), F.col("uid") == F.col("one"))
    parts = kept.select("uid", "copies", F.explode("parts").alias("p")).select("uid", "copies", "p.*")
    often = parts.groupBy("mini").agg(F.sum("copies").alias("c")).filter("c > 1").select(respread(F.col("mini")).alias("m"))
    hits = stage_table(parts.join(often, F.col("mini") == F.col("m")).drop("m"), "rep-hits", [rows])
    # Now apart by kind, the last bit of ``mini``.
    kind = "struct<mini:bigint,content:bigint,halves:bigint,first:int,n:smallint>"
    own = F.struct(F.col("mini").bitwiseOR(F.lit(1)), "content", "halves", "first", "n").cast(kind)
    long = F.struct(F.col("mini").bitwiseAND(F.lit(-2)), *[F.col(f"{c}_l") for c in ("content", "halves", "first", "n")]).cast(kind)
    hits = hits.select("uid", "copies", F.explode(F.when(F.col("n_l").isNull(), F.array(own)).otherwise(F.array(own, long))).alias("p")).select("uid", "copies", "p.*")

    # Equal stretches, told by the minimiser and a content hash, count once: ``several`` places, of more than one text (``multi``) or not.
    different = hits.groupBy("mini", "content", "halves").agg(
        F.sum("copies").alias("c"), F.min("uid").alias("low"), ((F.min("uid") < F.max("uid")) | (F.max("copies") > 1)).alias("multi"), F.min(F.struct("uid", "first", "n")).alias("at")
    )
    different = different.select("mini", "content", "halves", (F.col("c") > 1).alias("several"), "low", "multi", "at.*", F.monotonically_increasing_id().alias("sid"))
    different = stage_table(different, "rep-different", [rows])
    crowd = different.groupBy("mini").agg(F.count("*").alias("k")).filter("k > 1").select(respread(F.col("mini")).alias("m"), "k")
    open_ = stage_table(different.join(crowd, F.col("mini") == F.col("m")).drop("m"), "rep-open", [different, different])
    # A string has half of its rest before its minimiser, or behind it; its equal has the same.
    sides = [(F.shiftrightunsigned("halves", 32), 0), (F.col("halves").bitwiseAND((1 << 32) - 1), 1)]
    half = F.explode(F.array(*[F.when(x != 0, F.xxhash64("mini", x, F.lit(k))) for x, k in sides])).alias("half")
    halves = open_.select("sid", half).filter("half IS NOT NULL")
    common = halves.groupBy("half").agg(F.count("*").alias("c")).filter("c > 1").select(respread(F.col("half")).alias("h"))
    met = halves.join(common, F.col("half") == F.col("h")).select(F.col("sid").alias("one")).distinct()
    asked = stage_table(open_.join(met, F.col("sid") == F.col("one"), "left_semi"), "rep-asked", [open_])
    size = asked.agg(F.sum(F.col("n") + F.when(F.col("mini") % 2 == 0, LENGTH).otherwise(SHORT))).first()[0] or 0
    batches = max(1, -(-size // BATCH_BYTES))  # follows the input
    salt = F.when(F.col("k") > CROWD, F.pmod(F.col("content"), F.ceil(F.col("k") / CROWD))).otherwise(0)
    dealt = asked.withColumn("batch", F.pmod(F.xxhash64("mini", salt), F.lit(batches))).withColumn("split", F.col("k") > CROWD)
    names = ["mini", "content", "sid", "several", "low", "multi", "n", "batch", "split"]
    wanted = dealt.groupBy("uid").agg(F.collect_list(F.struct("first", *names)).alias("asks"))
    wanted = wanted.join(rows.select(F.col("uid").alias("u"), "row_key", "text_key"), F.col("uid") == F.col("u")).select(F.col("row_key").alias("k"), F.col("text_key").alias("t"), "uid", "asks")
    found = picked.join(wanted, (F.col("text_key") == F.col("t")) & F.col("row_key").eqNullSafe(F.col("k"))).select("raw", "uid", "asks")

    def slice_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a repeated row comes again and gives no new pieces
        for batch in batches:
            uid = batch.column("uid").to_pylist()
            new = [k for k, u in enumerate(uid) if u not in seen and not seen.add(u)]
            if not new:
                continue
            batch = batch.take(pa.array(new))
            raw, asks = batch.column("raw"), batch.column("asks")
            flat = asks.flatten()
            lists = np.diff(asks.offsets.to_numpy())
            texts = [memoryview(x.as_buffer()) for x in raw]
            owner = np.repeat(np.arange(len(texts)), lists).tolist()
            kind = (flat.field("mini").to_numpy() & 1).tolist()
            pieces = [piece(texts[o], f, n, LENGTHS[k]).tobytes() for o, f, n, k in zip(owner, flat.field("first").to_pylist(), flat.field("n").to_pylist(), kind, strict=True)]
            yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in names), pa.array(pieces, pa.binary())], [*names, "piece"])

    pieces = found.mapInArrow(slice_, "mini long, content long, sid long, several boolean, low long, multi boolean, n smallint, batch long, split boolean, piece binary")
    answer = "mini long, content long, sid long, bits binary, bucket long, windows binary"

    def expand(group: pa.Table) -> pa.Table:
        once: dict[int, int] = {}
        for i, s in enumerate(group.column("sid").to_pylist()):
            once.setdefault(s, i)  # a repeated row may have come to two tasks
        group = group.take(pa.array(list(once.values())))
        raw = group.column("piece").to_pylist()
        mini, sid, low, places = (group.column(c).to_numpy().astype(np.int64) for c in ("mini", "sid", "low", "n"))
        several, multi, split = (np.array(group.column(c).to_pylist(), bool) for c in ("several", "multi", "split"))
        kinds = mini & 1
        marks = shared_places(raw, places, kinds, low, multi)
        for i in np.flatnonzero(several & (kinds == 0)).tolist():
            marks[i] = np.ones(len(marks[i]), bool)
        # Of what was dealt to several batches, an equal of a string may lie in another.
        windows = [_open_windows(raw[i], int(kinds[i]), sid[i], low[i], marks[i]) for i in np.flatnonzero(split).tolist()]
        n = len(raw)
        bits = pa.array([np.packbits(m).tobytes() for m in marks], pa.binary())
        keys = [group.column(c) for c in ("mini", "content", "sid")]
        rows = [pa.Table.from_arrays([*keys, bits, pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], ["mini", "content", "sid", "bits", "bucket", "windows"])]
        if windows:
            table = np.concatenate(windows)
            # Of strings that are settled here, once each says that they occur.
            settled = np.flatnonzero(table["place"] < 0)
            _, one = np.unique(table[["hash", "kind"]][settled], return_index=True)
            table = table[np.concatenate([np.flatnonzero(table["place"] >= 0), settled[one]])]
            bucket = (table["hash"][:, 0] % _U(batches)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            table, bucket = table[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            packed = [table[a:b].tobytes() for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(table)], strict=True)]
            n = len(packed)
            none = [*[pa.nulls(n, pa.int64())] * 3, pa.nulls(n, pa.binary())]
            rows.append(pa.Table.from_arrays([*none, pa.array(bucket[cuts]), pa.array(packed, pa.binary())], rows[0].column_names))
        release_memory()
        return pa.concat_tables(rows)

    def match(group: pa.Table) -> pa.Table:
        """Of the strings of one bucket of hashes: those open in a batch that occur in another (kind 0), or another text (kind 1)."""
        table = np.concatenate([np.frombuffer(x.as_py(), _WINDOW) for x in group.column("windows")])
        _, which, count = np.unique(table[["hash", "kind"]], return_inverse=True, return_counts=True)
        least, most = np.full(len(count), np.iinfo(np.int64).max), np.full(len(count), -1)
        np.minimum.at(least, which, table["low"])
        np.maximum.at(most, which, np.where(table["multi"] > 0, np.iinfo(np.int64).max, table["low"]))
        late = table[np.where(table["kind"] == 0, count[which] > 1, least[which] < most[which]) & (table["place"] >= 0)]
        late = late[np.argsort(late["sid"], kind="stable")]
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(late["sid"]) != 0])) if len(late) else np.zeros(0, np.int64)
        places = pa.ListArray.from_arrays(pa.array([*cuts, len(late)], pa.int32()), pa.array(late["place"].astype(np.int32)))
        return pa.table({"ls": late["sid"][cuts], "more": places})

    answers = stage_table(pieces.groupBy("batch").applyInArrow(expand, answer), "rep-answers")
    # Of minimisers dealt to several batches: strings left open in one are looked up in the others by a hash of 128 bits.
    late = answers.filter("bucket IS NOT NULL").select("bucket", "windows").groupBy("bucket").applyInArrow(match, "ls long, more array<int>")
    late = stage_table(late.groupBy("ls").agg(F.flatten(F.collect_list("more")).alias("more")), "rep-late", [answers])
    told = answers.filter("bucket IS NULL").join(late, F.col("sid") == F.col("ls"), "left").select("mini", "content", "bits", "more")
    # Where nothing but equals shares half a string, all places of a stretch are shared if it is several, or of several texts.
    whole = F.when(F.col("mini") % 2 == 0, F.col("several")).otherwise(F.col("multi"))
    alone = different.filter(whole).join(asked.select(F.col("sid").alias("one")), F.col("sid") == F.col("one"), "left_anti")
    told = told.unionByName(alone.select("mini", "content", F.lit(None).cast("binary").alias("bits"), F.lit(None).cast("array<int>").alias("more")))
    told = stage_table(told.select(F.col("mini").alias("tm"), F.col("content").alias("tc"), "bits", "more"), "rep-told", [answers, late, different])
    spans = hits.join(told, (F.col("mini") == F.col("tm")) & (F.col("content") == F.col("tc"))).select("uid", (F.col("mini") % 2 != 0).alias("short"), "first", "n", "bits", "more")
    spans = spans.groupBy("uid").agg(F.collect_list(F.struct("short", "first", "n", "bits", "more")).alias("parts"))
    return spans.join(texts.select(F.col("uid").alias("u"), "text_key"), F.col("uid") == F.col("u")).select("text_key", "parts")


def _open_windows(raw: bytes, kind: int, sid: int, low: int, known: np.ndarray) -> np.ndarray:
    """A row for each place of a piece, settled ones without the place."""
    n, length = len(known), LENGTHS[kind]
    table, view = np.zeros(n, _WINDOW), memoryview(raw)
    table["hash"] = np.frombuffer(b"".join([xxh3_128_digest(view[j : j + length]) for j in range(n)]), "<u8").reshape(-1, 2)
    table["sid"], table["low"], table["kind"], table["multi"] = sid, low, kind, known
    table["place"] = np.where(known, -1, np.arange(n))
    return table


def marked_places(parts: pa.ListArray, sizes: np.ndarray) -> np.ndarray:
    """For texts laid end to end: at which bytes repeated strings of 400 bytes start (row 0), and strings of 240 bytes
    that are in another text too (row 1)."""
    found = np.zeros((2, int(sizes.sum())), bool)
    flat, lists = parts.flatten(), pc.fill_null(pc.list_value_length(parts), 0).to_numpy()
    if not len(flat):
        return found
    short, first, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("short", "first", "n"))
    first += np.repeat(np.cumsum(sizes) - sizes, lists)
    bits = flat.field("bits")
    mapped = bits.is_valid().to_numpy(zero_copy_only=False)
    kept = bits.filter(pa.array(mapped))
    marks = np.unpackbits(np.frombuffer(b"".join(kept.to_pylist()), np.uint8)).astype(bool)
    for which, values in ((np.flatnonzero(~mapped), None), (np.flatnonzero(mapped), marks)):
        size = n[which]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        row, at = np.repeat(short[which], size), np.repeat(first[which], size) + inside
        if values is None:
            found[row, at] = True
        else:
            wide = -(-size // 8) * 8  # a part's bits fill whole bytes
            found[row, at] |= values[np.repeat(np.cumsum(wide) - wide, size) + inside]
    more = flat.field("more")
    for i in np.flatnonzero(pc.fill_null(pc.list_value_length(more), 0).to_numpy()).tolist():
        found[short[i], first[i] + np.array(more[i].as_py())] = True
    return found


def covered_runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings of ``length`` bytes at these places cover."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate([[0], gap + 1])].tolist(), (starts[np.concatenate([gap, [len(starts) - 1]])] + length).tolist(), strict=True))


def passages(raw: bytes, starts: np.ndarray, words: int = PASSAGE_WORDS) -> list[tuple[int, int]]:
    """The runs that strings of 240 bytes at ``starts`` cover, of those with more than ``words`` whole words."""
    found = []
    for a, b in covered_runs(starts, SHORT):
        # With what stands before and behind it; a text's edges end words as spaces do.
        blank = _SPACE[np.frombuffer(b" " * (a == 0) + raw[max(0, a - 1) : b + 1] + b" " * (b == len(raw)), np.uint8)]
        begins, ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
        if len(ends) and (not len(begins) or ends[0] <= begins[0]):
            ends = ends[1:]
        if min(len(begins), len(ends)) > words:
            found.append((a, b))
    return found


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _by_bytes(sizes: np.ndarray) -> Iterator[slice]:
    """Rows of about a megabyte together."""
    group = np.cumsum(sizes) >> 20
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    yield from (slice(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b)


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, digests: bool = False, cut_passages: bool = False) -> DataFrame:
    """Every row of ``df`` as ``row`` with ``runs`` (start and end of each removed run of bytes), ``kept``, the rest, and ``n_passages``.

    A byte goes if a string of 400 bytes that starts at another place too, in this text or another, covers it;
    that is judged on the input. ``n_passages`` counts the runs of over 50 whole words that strings of 240 bytes
    cover which are in another row's text too; with ``cut_passages`` these go as well. Null text is empty. ``kept``
    is text: of a character that a run cuts in two, what is left is dropped. With ``digests``, ``n_bytes, n_removed,
    n_spans, kept_sha256`` (of the bytes) come instead of ``runs`` and ``kept``. Equal texts lose all from 400 bytes
    on, as do repeated rows. An empty table gives an empty result; no column of ``df`` can clash, since all stay in ``row``.
    """
    keep = df.columns if keep is None else keep
    spans = stage_table(repeated_spans(df, text, key), "rep-spans").withColumnRenamed("text_key", "t")
    picked = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.md5(F.coalesce(text, F.lit(""))).alias("text_key"), text_bytes(text).alias("raw"))
    joined = picked.join(spans, F.col("text_key") == F.col("t"), "left").select("row", "raw", "parts")
    out = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digests else "runs array<struct<start:bigint,end:bigint>>, kept string"
    schema = T.StructType([picked.schema["row"], *T._parse_datatype_string(f"{out}, n_passages long").fields])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] if digests else [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
        for batch in (b.slice(x.start, x.stop - x.start) for b in batches for x in _by_bytes(pc.binary_length(b.column("raw")).to_numpy())):
            made: list[list] = [[] for _ in schema.names[1:]]
            texts = batch.column("raw").to_pylist()
            sizes = np.array([len(t) for t in texts], np.int64)
            starts = [np.flatnonzero(m) for m in marked_places(batch.column("parts"), sizes)]
            ends = np.cumsum(sizes)
            cuts = [np.searchsorted(x, np.concatenate([[0], ends])).tolist() for x in starts]
            for k, (raw, begin) in enumerate(zip(texts, (ends - sizes).tolist(), strict=True)):
                runs, shared = [], []
                if cuts[0][k] < cuts[0][k + 1]:
                    runs = covered_runs(starts[0][cuts[0][k] : cuts[0][k + 1]] - begin, LENGTH)
                if cuts[1][k] < cuts[1][k + 1]:
                    shared = passages(raw, starts[1][cuts[1][k] : cuts[1][k + 1]] - begin)
                    if cut_passages:
                        runs = merged(runs + shared)
                edges = [0, *(x for run in runs for x in run), len(raw)]
                kept = b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]) if runs else raw
                row = (len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()) if digests else ([{"start": a, "end": b} for a, b in runs], kept.decode(errors="ignore"))
                for column, x in zip(made, (*row, len(shared)), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, made, [*kinds, pa.int64()])], schema.names)

    return joined.mapInArrow(take, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs, keep=["doc_id"], digests=True).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages")
