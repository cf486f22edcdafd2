"""Operator 7, near-duplicates by ProbMinHash over weighted word shingles, banding and exact verification.

Every element of a text, weighted by its count, sends arrivals of a Poisson process into registers; a register keeps
its earliest arrival, and elements stop as soon as they can't win one. Two texts agree in a register with their
probability Jaccard similarity. Texts that agree in a whole band are candidates. In a band's bucket, members are
held against one leader by their exact similarity, so a bucket of n texts costs n comparisons and not n squared;
what is then not yet in one class is compared further, see ``near_classes``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import release_memory, respread, stage_table
from millrace.llm.components import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
SIZE = BANDS * ROWS
CHUNK = 64  # members that meet a copy of their leader in one group
BLOCK = 256  # members of a bucket in a block
MANY = 4096  # members outside a bucket's main class from which registers meet in larger blocks
WIDE = 2048  # members of such a bucket in a block of registers
ESTIMATE = 0.45  # least share of equal registers for exact comparing; at similarity 0.8 fewer are equal with probability 1e-12

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_BASE = _U(0xD1342543DE82EF95)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(1 << 14, 1 << int(n).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct word shingles and their counts. A text of fewer words is one shingle, if any."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0)
    edge = np.flatnonzero(np.diff(_SPACE[raw], prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0)
    up, down = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:n], out=total[1:])
    word = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    k = min(words, len(word))
    found = np.zeros(len(word) - k + 1, np.uint64)
    for i in range(k):
        found = found * _U(0x2545F4914F6CDD1D) + word[i : len(word) - k + 1 + i]
    found, count = np.unique(mix(found), return_counts=True)
    return found, count.astype(float)


def signature(elements: np.ndarray, weights: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The element that arrives first in each register. There must be an element."""
    first, who = np.full(size, np.inf), np.zeros(size, np.uint64)
    at, turn = np.zeros(len(elements)), 0
    while len(elements):
        times = max(1, 6 * size // len(elements))
        key = mix(elements[:, None] + _GOLD * np.arange(turn + 1, turn + times + 1, dtype=np.uint64))
        turn += times
        gap = -np.log1p(-((key >> _U(11)).astype(float) * 2.0**-53)) / weights[:, None]
        when = at[:, None] + np.cumsum(gap, axis=1)
        register = (mix(key ^ _GOLD) % _U(size)).astype(np.intp)
        flat, place = when.ravel(), register.ravel()
        better = np.flatnonzero(flat < first[place])
        better = better[np.argsort(-flat[better], kind="stable")]  # the earliest is set last
        first[place[better]] = flat[better]
        who[place[better]] = elements[better // times]
        at = when[:, -1]
        alive = at < first.max()
        elements, weights, at = elements[alive], weights[alive], at[alive]
    return who


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity; for texts without repeated shingles this is the plain Jaccard one."""
    (x, u), (y, v) = a, b
    if not len(x) or not len(y):
        return 0.0
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    if u.max() == u.min() and v.max() == v.min() and len(x) == len(y) or (u.max() == 1 and v.max() == 1):
        return len(i) / (len(x) + len(y) - len(i))
    only_u, only_v = np.ones(len(x), bool), np.ones(len(y), bool)
    only_u[i] = only_v[j] = False
    ratio = u[i] / v[j]
    order = np.argsort(ratio, kind="stable")
    ratio, p, q = ratio[order], u[i][order], v[j][order]
    at = np.searchsorted(ratio, ratio, "left")
    above = np.concatenate([np.cumsum(p[::-1])[::-1], [0]])[at] + u[only_u].sum()
    below = np.concatenate([[0], np.cumsum(q)])[at] + v[only_v].sum()
    return float((1 / (above / p + below / q)).sum())


# ---------------------------------------------------------------- tables


def signed(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``row, uid, text_key, bands, registers``, a row for each of ``df``; texts without words have no bands."""
    picked = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.md5(F.coalesce(text, F.lit(""))).alias("text_key"), F.col(text).alias("text"))
    schema = T.StructType([*picked.schema.fields[:2], T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("registers", T.BinaryType())])
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands, registers = [], []
            for x in batch.column("text"):
                elements, weights = shingles(x.as_py() or "")
                if not len(elements):
                    bands.append(None)
                    registers.append(None)
                    continue
                who = signature(elements, weights)
                key = salt.copy()
                for row in who.reshape(ROWS, BANDS):
                    key = mix(key + row)
                bands.append(key.view(np.int64))
                registers.append(who.astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text_key"), pa.array(bands, pa.list_(pa.int64())), pa.array(registers, pa.binary())], schema.names)
        release_memory()

    return picked.mapInArrow(sign, schema).withColumn("uid", F.monotonically_increasing_id())


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``u, leader`` whose exact similarity is high enough.

    ``texts`` has ``uid, text``. A leader's text is sent once for every ``CHUNK`` of its members, not once a pair.
    """
    sizes = pairs.groupBy("leader").agg(F.count("*").alias("n")).select(F.col("leader").alias("of"), F.ceil(F.col("n") / CHUNK).cast("int").alias("salts"))
    sizes = stage_table(sizes, "near-sizes", [pairs])
    salted = pairs.join(sizes, F.col("leader") == F.col("of")).select("u", "leader", F.pmod(F.xxhash64("u"), F.col("salts")).cast("int").alias("salt"))
    members = salted.join(texts, F.col("u") == F.col("uid")).select("leader", "salt", F.col("u").alias("who"), "text")
    leaders = sizes.join(texts, F.col("of") == F.col("uid")).select(F.col("of").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("of").alias("who"), "text")

    def compare(group: pa.Table) -> pa.Table:
        who, text = group.column("who").to_pylist(), group.column("text").to_pylist()
        leader = group.column("leader")[0].as_py()
        found = []
        if leader in who:
            own = shingles(text[who.index(leader)] or "")
            found = [w for w, t in zip(who, text, strict=True) if w != leader and similarity(own, shingles(t or "")) >= SIMILARITY]
        return pa.table({"u": pa.array(found, pa.int64()), "v": pa.array([leader] * len(found), pa.int64())})

    return members.unionByName(leaders).groupBy("leader", "salt").applyInArrow(compare, "u long, v long")


def _blocks(open_: DataFrame, carried: DataFrame, wide: int = BLOCK) -> DataFrame:
    """Buckets ``key, uid, class, main, n, outside`` as pairs of blocks ``key, a, b``, with ``carried`` joined by ``of``.

    Every pair across classes has a member outside the bucket's main class. So the members, in blocks (side 0), meet
    the outside ones, in blocks (side 1): a group never has more than two blocks. A block is of ``BLOCK`` members, or
    of ``wide`` in buckets with over ``MANY`` outside ones, where a member is sent to fewer groups that way.
    """
    size = F.when(F.col("outside") > MANY, wide).otherwise(BLOCK)
    blocks = F.ceil(F.col("n") / size).cast("int"), F.ceil(F.col("outside") / size).cast("int")
    own = [F.pmod(F.xxhash64("uid"), k).cast("int") for k in blocks]
    every = [F.explode(F.sequence(F.lit(0), k - 1)) for k in blocks]
    rows = open_.join(carried, F.col("uid") == F.col("of"))
    more = [c for c in carried.columns if c != "of"]
    left = rows.select("key", own[0].alias("a"), every[1].alias("b"), F.lit(0).alias("side"), "uid", "class", *more)
    right = rows.filter(F.col("class") != F.col("main")).select("key", every[0].alias("a"), own[1].alias("b"), F.lit(1).alias("side"), "uid", "class", *more)
    return left.unionByName(right)


def _cross_links(open_: DataFrame, signs: DataFrame, texts: DataFrame) -> DataFrame:
    """Exact links ``u, v`` across classes within buckets; of one member to one class a single link.

    Registers tell first which members have a partner that may be near; only the texts of those meet. Pairs are
    formed inside a group of two blocks and never as rows.
    """

    def screen(group: pa.Table) -> pa.Table:
        side, uid, own = (group.column(c).to_numpy() for c in ("side", "uid", "class"))
        registers = np.frombuffer(b"".join(group.column("registers").to_pylist()), np.uint16).reshape(len(uid), SIZE)
        left, near = np.flatnonzero(side == 0), np.zeros(len(uid), bool)
        for k in np.flatnonzero(side == 1):
            found = left[(own[left] != own[k]) & ((registers[left] == registers[k]).mean(axis=1) >= ESTIMATE)]
            near[found] = True
            near[k] |= len(found) > 0
        return pa.table({"near": np.unique(uid[near])})

    held = _blocks(open_, signs.select(F.col("uid").alias("of"), "registers"), WIDE)
    near = stage_table(held.groupBy("key", "a", "b").applyInArrow(screen, "near long").distinct(), "near-screened", [signs], spread=True)

    def link(group: pa.Table) -> pa.Table:
        side, uid, own = (group.column(c).to_numpy() for c in ("side", "uid", "class"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        u, v = [], []
        if len(left) and len(right):
            sets = [shingles(t or "") for t in group.column("text").to_pylist()]
            for k, found in zip(right, near_rows([sets[i] for i in left], [sets[i] for i in right], own[left][:, None] != own[right]), strict=True):
                which = left[found]
                which = which[np.unique(own[which], return_index=True)[1]]
                u += np.maximum(uid[which], uid[k]).tolist()
                v += np.minimum(uid[which], uid[k]).tolist()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    some = open_.join(near, F.col("uid") == F.col("near"), "left_semi")
    met = _blocks(some, texts.select(F.col("uid").alias("of"), "text"))
    return met.groupBy("key", "a", "b").applyInArrow(link, "u long, v long").distinct()


def near_rows(left: list[tuple], right: list[tuple], wanted: np.ndarray) -> Iterator[np.ndarray]:
    """For each of ``right`` the places of those ``left`` (of ``wanted``) that are similar enough, exactly.

    A probability Jaccard similarity is at most the share of either text's weight that lies on common shingles;
    products of matrices give these shares for all pairs at once. Where all counts are 1 they give the similarity.
    """
    every, place, count = np.unique(np.concatenate([e for e, _ in [*left, *right]]), return_inverse=True, return_counts=True)
    column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[place]
    width = max(1, int((count > 1).sum()))
    sizes = [len(e) for e, _ in [*left, *right]]
    ends = np.cumsum(sizes)
    total = np.array([w.sum() for _, w in [*left, *right]])
    single = np.array([bool(len(w)) and w.max() == 1 for _, w in [*left, *right]])
    n = len(left)
    share = [np.zeros((n, len(right))), np.zeros((n, len(right)))]
    for at in range(0, width, 1 << 14):  # columns at a time bound the memory
        dense = np.zeros((2, len(sizes), min(1 << 14, width - at)), np.float32)
        for i, (e, size) in enumerate(zip(ends, sizes, strict=True)):
            own = column[e - size : e] - at
            use = (own >= 0) & (own < dense.shape[2])
            dense[0, i, own[use]] = 1
            dense[1, i, own[use]] = (left[i] if i < n else right[i - n])[1][use]
        share[0] += dense[1, :n] @ dense[0, n:].T
        share[1] += dense[0, :n] @ dense[1, n:].T
    may = wanted & (share[0] >= SIMILARITY * total[:n, None] - 1e-6) & (share[1] >= SIMILARITY * total[n:] - 1e-6)
    for k in range(len(right)):
        found = np.flatnonzero(may[:, k])
        plain = single[found] & single[n + k]
        common = share[0][found, k]
        good = plain & (common / np.maximum(total[found] + total[n + k] - common, 1) >= SIMILARITY)
        for i in np.flatnonzero(~plain):
            good[i] = similarity(left[found[i]], right[k]) >= SIMILARITY
        yield found[good]


def _with_class(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the class of their ``uid``: its component, or itself."""
    return rows.join(found, F.col("uid") == F.col("node"), "left").withColumn("class", F.coalesce("component", "uid")).drop("node", "component")


def near_classes(df: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Every row of ``df`` as ``row`` with its ``class_id``: the least key of the texts linked to its own; ``first`` marks one row of each class.

    Links join texts of similarity 0.8 or more on five-word shingles, and equal texts; a class is a connected
    component. Texts without words (null, empty, blank) are linked to equal texts only. The keys of a class can all
    be null; then so is its id. Repeated rows stay, in one class.

    Candidates agree in one of 20 bands of 4 registers, which a pair of similarity 0.8 misses with probability
    3e-5. In each bucket all members are held against its leader. Of a bucket that still has several classes, all
    pairs across classes are compared, by their registers and then exactly, in blocks, however many they are.
    Nothing is capped; no bucket meets in one task.
    """
    keep = df.columns if keep is None else keep
    carried = list(dict.fromkeys([*keep, key]))
    rows = stage_table(signed(df, text, carried), "near-signed")
    own = F.col("row")[key]
    # One node for each distinct text.
    best = F.min(F.struct(own.isNull().alias("none"), own.alias("key"), F.col("uid").alias("of")))
    nodes = stage_table(rows.groupBy("text_key").agg(F.min("uid").alias("uid"), best.alias("best")), "near-nodes", [rows])
    single = rows.filter("bands IS NOT NULL").join(nodes.select("uid"), "uid", "left_semi")
    signs = stage_table(single.select("uid", "bands", "registers"), "near-signs", [rows])
    members = signs.select("uid", F.explode("bands").alias("key"))
    led = members.groupBy("key").agg(F.count("*").alias("n"), F.min("uid").alias("leader")).filter("n > 1")
    shared = members.join(led.select(respread(F.col("key")).alias("k"), "leader"), F.col("key") == F.col("k")).select("key", "uid", "leader")
    shared = stage_table(shared, "near-shared", [signs, signs])
    pairs = stage_table(shared.filter("uid <> leader").select(F.col("uid").alias("u"), "leader").distinct(), "near-pairs", [shared])
    needed = shared.select("uid").distinct().join(nodes.select("uid", "text_key"), "uid")
    # Texts are found again by what they are, once each: a row that is repeated a thousand times gives one.
    plain = df.select(F.md5(F.coalesce(text, F.lit(""))).alias("t"), F.col(text).alias("text")).groupBy("t").agg(F.first("text").alias("text"))
    # The texts of all candidates, once: rounds below read them again.
    texts = stage_table(plain.join(needed, F.col("t") == F.col("text_key")).select("uid", "text"), "near-texts")

    # First only each member's least leader; then the leaders of other classes.
    first = pairs.groupBy("u").agg(F.min("leader").alias("leader"))
    edges = stage_table(verify(first, texts), "near-edges", [pairs], spread=True)
    found = components(edges)
    rest = pairs.join(first.select(F.col("u").alias("a"), F.col("leader").alias("b")), (F.col("u") == F.col("a")) & (F.col("leader") == F.col("b")), "left_anti")
    edges, found = _linked(edges, found, rest, texts, pairs)

    # Buckets whose members are of several classes.
    held = _with_class(shared.select("key", "uid"), found)
    sizes = held.groupBy("key", "class").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "class")).alias("most"))
    mixed = sizes.filter(F.col("most.n") < F.col("n")).select(F.col("key").alias("k"), "n", (F.col("n") - F.col("most.n")).alias("outside"), F.col("most.class").alias("main"))
    open_ = held.join(stage_table(mixed, "near-mixed", [shared]), F.col("key") == F.col("k")).drop("k")
    open_ = stage_table(open_, "near-open", [shared, shared])
    edges, found = _joined(edges, found, stage_table(_cross_links(open_, signs, texts), "near-cross"))
    named = _with_class(nodes, found)
    least = named.groupBy("class").agg(F.min("best").alias("least")).select(F.col("class").alias("c"), F.col("least.key").alias("class_id"), F.col("least.of").alias("one"))
    least = stage_table(least, "near-least", [nodes])
    named = named.join(least, F.col("class") == F.col("c")).select(F.col("text_key").alias("t"), "class", "class_id", "one")
    named = stage_table(named, "near-named", [nodes])
    back = rows.select("row", "text_key", "uid").join(named, F.col("text_key") == F.col("t"))
    return back.select("row", "class_id", "class", (F.col("uid") == F.col("one")).alias("first"))


def _linked(edges: DataFrame, found: DataFrame, rest: DataFrame, texts: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """More edges from those ``rest`` of all ``pairs`` that aren't yet in one class, and the classes with them."""
    a = found.select(F.col("node").alias("na"), F.col("component").alias("ca"))
    b = found.select(F.col("node").alias("nb"), F.col("component").alias("cb"))
    across = rest.join(a, F.col("u") == F.col("na"), "left").join(b, F.col("leader") == F.col("nb"), "left")
    across = stage_table(across.filter(F.coalesce("ca", "u") != F.coalesce("cb", "leader")).select("u", "leader"), "near-across", [pairs])
    if across.isEmpty():
        return edges, found
    return _joined(edges, found, stage_table(verify(across, texts), "near-edges", [across], spread=True))


def _joined(edges: DataFrame, found: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    if new.isEmpty():
        return edges, found
    edges = edges.unionByName(new)
    return edges, components(edges)


def keep_one(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each class: that with the class's id as key; of such rows the first written."""
    found = near_classes(df, text, key).filter("first")
    return found.select("row.*").select(*[F.col(f"`{c}`") for c in df.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_classes(docs, keep=["doc_id"]).select("row.doc_id", "class_id")
