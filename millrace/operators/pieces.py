"""Counting of tokens by pieces: what stands between white space is cut once for many rows, and looked up from then on.

Spark normalises a text; what is cut here is the normal form, by the rules of ``text.tokenize``. No piece's tokens depend
on another's, so the distinct pieces of some thousand rows are cut together.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as tx
from millrace.staging import written

ROWS, LETTERS = 1024, 4_000_000  # rows that are counted at a time, and bytes of their texts, but one row at least
PIECES, HELD = 200_000, 16_000_000  # that are remembered, and letters of them, before memory is begun anew
Kind = tuple[str, int, int] | None  # arguments of ``text.tokenize``; None: ``text.tokenize_raw``
PLAIN: Kind = ("prefix", 5, 4)

APART = re.compile(rf"[\d{tx.MALAYALAM}]")
NATIVE = re.compile(f"[{tx.MALAYALAM}]")
LETTER = f"[0-9a-z{tx.MALAYALAM}]"
WHOLE, DIGIT, COMMA = re.compile(rf"{LETTER}[/.\-:]{LETTER}"), re.compile(r"\d"), re.compile(r"(?<=\d),(?=\d)")
WORDS, PARTS = re.compile("[a-zà-ɏ]{2,}"), re.compile(f"[0-9a-zà-ɏ{tx.MALAYALAM}]+")


def tokens(piece: str, subword: str = "prefix", prefix_len: int = 5, ngram_n: int = 4) -> list[str]:
    """Of a piece of normalised text what ``text.tokenize`` gives of it."""
    if not APART.search(piece):
        return WORDS.findall(piece)
    piece = COMMA.sub("", piece).strip(tx.EDGES)
    out = [piece] if DIGIT.search(piece) and WHOLE.search(piece) else []
    for w in PARTS.findall(piece):
        if w.isascii() and w.isdigit():
            out.append(w.lstrip("0") or "0")
        elif len(w) > 1:
            out.append(w)
            if subword == "prefix" and len(w) >= prefix_len and NATIVE.search(w):
                out.append("~" + w[:prefix_len])
            elif subword == "ngram" and len(w) > ngram_n and NATIVE.search(w):
                out += ["#" + w[i : i + ngram_n] for i in range(len(w) - ngram_n + 1)]
    return out


def tokenize_by(kind: Kind) -> Callable[[Column], Column]:
    """The same as a column."""
    return tx.tokenize_raw if kind is None else lambda c: tx.tokenize(c, *kind)


class Cutter:
    """Tokens of arrays of pieces of one kind. A word with signs at its edges is its own token; other pieces are cut by
    ``tokens`` and remembered."""

    def __init__(self, kind: Kind) -> None:
        self.kind, self.held, self.letters = kind, {}, 0

    def _cut(self, piece: str) -> list[str]:
        found = self.held.get(piece)
        if found is None:
            self.held[piece] = found = tokens(piece, *self.kind)
            self.letters += len(piece)
        return found

    def of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Of each piece how many tokens it has and where they start, and all tokens, end to end."""
        if self.kind is None:
            return pc.not_equal(pieces, "").to_numpy(zero_copy_only=False).astype(np.int64), np.arange(len(pieces)), pieces
        if len(self.held) > PIECES or self.letters > HELD:
            self.held, self.letters = {}, 0
        bare = pc.utf8_trim(pieces, tx.EDGES)
        simple = pc.match_substring_regex(bare, "^[a-zà-ɏ]{2,}$")
        words, others = bare.filter(simple), [self._cut(x) for x in pieces.filter(pc.invert(simple)).to_pylist()]
        plain, more = simple.to_numpy(zero_copy_only=False), np.fromiter(map(len, others), np.int64, len(others))
        sizes, starts = np.ones(len(pieces), np.int64), np.cumsum(plain) - 1
        sizes[~plain], starts[~plain] = more, len(words) + np.cumsum(more) - more
        return sizes, starts, pa.concat_arrays([words, pa.array(list(chain.from_iterable(others)), pa.string())])

    def count(self, texts: pa.Array, given: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of texts: tokens of each; then row, code and number of each row's distinct terms, in this order; and what the codes
        stand for, which is ``given``, if only these are counted."""
        lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
        coded = lists.flatten().dictionary_encode()
        sizes, starts, flat = self.of(coded.dictionary)
        if given is None:
            unified = flat.dictionary_encode()
            codes, given = unified.indices.to_numpy(), unified.dictionary
        else:
            codes = pc.fill_null(pc.index_in(flat, value_set=given), -1).to_numpy()
        at, rows = coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
        total = np.bincount(rows, sizes[at], len(texts)).astype(np.int64)
        own = sizes[at]
        found = codes[np.repeat(starts[at] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))]
        keys, tfs = np.unique((np.repeat(rows, own) * max(1, len(given)) + found)[found >= 0], return_counts=True)
        rows, codes = np.divmod(keys, max(1, len(given)))
        return total, rows, codes, tfs, given


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of bounded size."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(batch):
        most = (ends[at - 1] if at else 0) + LETTERS
        to = max(at + 1, min(at + ROWS, int(np.searchsorted(ends, most, "right"))))
        yield batch.slice(at, to - at)
        at = to


def asked_terms(chunks: DataFrame, query_tokens: DataFrame, kinds: dict[str, Kind] | None = None) -> DataFrame:
    """``kind, chunk_id, doc_len, terms, tfs, native``, written: every chunk's length, and of its terms those that a question has.

    ``chunks`` has ``chunk_id, text``; ``query_tokens`` ``query_id, tokens``, with ``kind`` if there are several ``kinds``. The
    first kind has a row a chunk, and so has a raw one. Others cut a chunk without a Malayalam letter as the first does, and
    have rows for ``native`` chunks alone, which ``of_kind`` puts beside those of the first.
    """
    kinds = kinds or {"tokens": PLAIN}
    first = next(iter(kinds))
    asked = query_tokens if "kind" in query_tokens.columns else query_tokens.withColumn("kind", F.lit(first))
    words: dict[str, dict[str, int]] = {kind: {} for kind in kinds}
    for r in asked.select("kind", F.explode("tokens").alias("term")).distinct().collect():  # of the questions
        for kind in {r.kind} if kinds[r.kind] is None else {r.kind, first}:
            words[kind].setdefault(r.term, len(words[kind]))
    raw = F.when(F.col("text").rlike("[^\\x00-\\x7F]"), F.lower("text")) if None in kinds.values() else F.lit(None).cast("string")
    docs = chunks.select("chunk_id", tx.normalize(F.col("text")).alias("text"), raw.alias("raw"))
    schema = T.StructType([T.StructField("kind", T.StringType()), docs.schema["chunk_id"], *T._parse_datatype_string("doc_len long, terms array<string>, tfs array<long>, native boolean").fields])
    names = schema.names

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutters = {name: Cutter(kind) for name, kind in kinds.items()}
        known = {name: pa.array(list(words[name]), pa.string()) for name in kinds}
        for batch in (part for b in batches for part in slices(b, "text")):
            texts = batch.column("text")
            native = pc.match_substring_regex(texts, f"[{tx.MALAYALAM}]").to_numpy(zero_copy_only=False)
            for name, kind in kinds.items():
                which = np.flatnonzero(native) if kind is not None and name != first else np.arange(len(texts))
                if not len(which):
                    continue
                own = pc.coalesce(batch.column("raw"), texts) if kind is None else texts if name == first else texts.take(pa.array(which))
                total, rows, codes, tfs, _ = cutters[name].count(own, known[name])
                bounds = pa.array(np.searchsorted(rows, np.arange(len(own) + 1)), pa.int32())
                terms = pa.ListArray.from_arrays(bounds, known[name].take(pa.array(codes)))
                columns = pa.array([name] * len(own), pa.string()), batch.column("chunk_id").take(pa.array(which)), pa.array(total), terms, pa.ListArray.from_arrays(bounds, pa.array(tfs, pa.int64())), pa.array(native[which])
                yield pa.RecordBatch.from_arrays(list(columns), names)

    return written(docs.mapInArrow(count, schema), "asked")


def of_kind(rows: DataFrame, name: str, first: str) -> DataFrame:
    """The rows of one kind, of what ``asked_terms`` gives for several."""
    kind = F.col("kind")
    return rows.filter((kind == name) | ((kind == first) & ~F.col("native")))


def frequencies(chunks: DataFrame, kind: Kind = PLAIN) -> DataFrame:
    """``term, df`` of all terms of ``text``: chunks are counted some together, before terms are dealt out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(kind)
        for batch in (part for b in batches for part in slices(b, "text")):
            _, _, codes, _, terms = cutter.count(batch.column("text"))
            yield pa.RecordBatch.from_arrays([terms, pa.array(np.bincount(codes, minlength=len(terms)), pa.int64())], ["term", "df"])

    return chunks.select(tx.normalize(F.col("text")).alias("text")).mapInArrow(count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
