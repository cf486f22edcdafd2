"""Pages to chunks: merging short pages, recursive splitting and chunk identities."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import strip
from millrace.operators.ordering import running_sum

SEPARATORS = ("\n\n", "\n", ".", " ", "")
SIZE, OVERLAP, MIN_CHARS = 1000, 200, 200
HELD = 2_000_000  # characters of chunks that a task gathers before it hands them on


class ChunkLimitExceeded(RuntimeError):
    """More chunks than a run may store."""


def merge_short_pages(pages: DataFrame, least: int = 200) -> DataFrame:
    """``source, page, text`` to blocks ``source, block, pages, is_merged, text``.

    Runs of pages shorter than ``least`` are joined, each with a newline behind it; longer pages stand alone. Every
    long page ends a run: a running count of them names the islands. Pages of one number go by their text.
    """
    own = strip(F.coalesce(F.col("text"), F.lit("")))
    rows = pages.select("source", "page", own.alias("text"), (F.length(own) >= least).alias("long"))
    rows = running_sum(rows, ["source"], ["page", "text"], F.col("long"), "longs").withColumn("block", 2 * F.col("longs") - F.col("long").cast("long"))
    blocks = rows.groupBy("source", "block", F.col("long")).agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: F.concat(x["text"], F.lit("\n"))), "")
    return blocks.select("source", "block", F.col("p.page").alias("pages"), (~F.col("long")).alias("is_merged"), F.when(F.col("long"), F.col("p")[0]["text"]).otherwise(joined).alias("text"))


def page_label(pages: Column, is_merged: Column) -> Column:
    return F.when(is_merged, F.concat(F.lit("["), F.array_join(pages.cast("array<string>"), ", "), F.lit("]"))).otherwise(pages[0].cast("string"))


def _pieces(text: str, separator: str) -> list[str]:
    """Cut so that each separator leads the piece behind it."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in [head, *(separator + r for r in rest)] if p]


def _pack(pieces: Iterable[str], size: int, overlap: int) -> Iterator[str]:
    """Greedy windows of pieces up to ``size``, each beginning with at most ``overlap`` of the one before."""
    held: list[str] = []
    total = 0
    for piece in pieces:
        if held and total + len(piece) > size:
            yield "".join(held).strip()
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    yield "".join(held).strip()


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Recursive splitting by the first separator that occurs; pieces that are still too long by the next ones."""
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    finer = separators[at + 1 :]
    out: list[str] = []
    short: list[str] = []
    for piece in _pieces(text, separators[at]):
        if len(piece) < size:
            short.append(piece)
            continue
        if short:
            out += _pack(short, size, overlap)
            short = []
        out += split_text(piece, size, overlap, finer) if finer else [piece]
    if short:
        out += _pack(short, size, overlap)
    return [c for c in out if c]


def split_pages(pages: Iterable[str], size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> Iterator[str]:
    """``split_text`` of pages joined by the first separator, of which no more than a page and a window is held.

    Cuts that are found in the beginning of a text stay where they are when more follows, so all pieces but the last are
    known with each page.
    """
    pages = iter(pages)
    first, second = next(pages, None), next(pages, None)
    if second is None:
        yield from split_text(first or "", size, overlap, separators)
        return
    separator, finer = separators[0], separators[1:]

    def pieces() -> Iterator[str]:
        lead, rest = "", first
        for page in chain([second], pages):
            *whole, rest = (rest + separator + page).split(separator)
            for piece in whole:
                yield lead + piece
                lead = separator
        yield lead + rest

    for short, run in groupby((p for p in pieces() if p), lambda p: len(p) < size):
        chunks = _pack(run, size, overlap) if short else chain.from_iterable(split_text(p, size, overlap, finer) for p in run)
        yield from (c for c in chunks if c)


def _chunked(rows: DataFrame, size: int, overlap: int, by: str | None = None) -> DataFrame:
    """``rows`` with ``source_char_count, pos, chunk`` in place of ``text``: a row's own or, in partitions sorted so, those of
    all rows of one ``by`` that follow each other.

    Splitting keeps a window of pieces, which no column function can; so it runs in Python, and hands chunks on in small
    batches.
    """
    kept = [f for f in rows.schema.fields if f.name not in ("text", *(["page"] if by else []))]
    schema = T.StructType([*kept, *T._parse_datatype_string("source_char_count long, pos int, chunk string").fields])
    names, own = schema.names, [f.name for f in kept]
    most = HELD

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            columns = [batch.column(c) for c in own]
            for i, text in enumerate(batch.column("text")):
                yield tuple(c[i] for c in columns), text.as_py() or ""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        kinds: list[pa.DataType] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            plain = [pa.array([v.as_py() for v in c], t) for c, t in zip(columns, kinds, strict=False)]
            return pa.RecordBatch.from_arrays([*plain, pa.array(columns[-3], pa.int64()), pa.array(columns[-2], pa.int32()), pa.array(columns[-1], pa.string())], names)

        rows = texts(batches)
        groups = ((key, (t for _, t in part)) for key, part in groupby(rows, lambda r: r[0])) if by else ((key, [t]) for key, t in rows)
        for key, part in groups:
            kinds = kinds or [v.type for v in key]
            count = None if by else len(part[0])
            chunks = split_pages(part, size, overlap) if by else split_text(part[0], size, overlap)
            for pos, chunk in enumerate(chunks):
                out.append((*key, count, pos, chunk))
                held += len(chunk)
                if held > most:
                    yield batch()
                    out, held = [], 0
        if out:
            yield batch()

    return rows.mapInArrow(split, schema)


def chunk_pages(blocks: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = MIN_CHARS) -> DataFrame:
    """``source, block, page, text`` to chunks; those shorter than ``least`` go and the rest are numbered by source."""
    kept = _chunked(blocks.filter(strip(F.col("text")) != ""), size, overlap).filter(F.length(strip(F.col("chunk"))) >= least)
    numbered = running_sum(kept, ["source"], ["block", "pos"], F.lit(1), "number")
    return numbered.select("source", "block", "page", (F.col("number") - 1).alias("chunk_no"), F.col("chunk").alias("text"), F.lit("unknown").alias("method"), F.length("chunk").cast("long").alias("char_count"), "source_char_count")


def chunk_document(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = MIN_CHARS) -> DataFrame:
    """A source's pages joined by blank lines and split as one; numbers keep the gaps of dropped chunks.

    A source is one text, so one task reads its pages in order; it holds a page and a window of them at a time.
    """
    rows = pages.filter("text <> ''").select("source", "page", "text")
    kept = _chunked(rows.repartition("source").sortWithinPartitions("source", "page", "text"), size, overlap, "source").filter(F.length(strip(F.col("chunk"))) >= least)
    return kept.select("source", F.lit(-1).alias("page"), F.col("pos").cast("long").alias("chunk_no"), F.col("chunk").alias("text"), F.lit("combined").alias("method"))


def document(pages: DataFrame) -> DataFrame:
    """``source, text``: a source's non-empty pages in order, joined by blank lines, in one row as the document is one text."""
    parts = F.sort_array(F.collect_list(F.when(F.col("text") != "", F.struct("page", "text"))))
    return pages.groupBy("source").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"))


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """Both identities: over the whole run in order of source and chunk, and by source."""
    placed = running_sum(chunks, [], ["source", "chunk_no"], F.lit(1), "number")
    place = F.col("number") - 1
    return placed.select("source", "page", "chunk_no", F.concat_ws("", "source", F.lit("_p"), "page", F.lit("_"), place.cast("string")).alias("chunk_id"), F.concat_ws("", "source", F.lit("_page"), "page", F.lit("_chunk"), F.col("chunk_no").cast("string")).alias("legacy_id"))


def check_limit(chunks: DataFrame, most: int = 40_000) -> DataFrame:
    n = chunks.count()
    if n > most:
        raise ChunkLimitExceeded(f"{n} chunks are over the limit of {most}")
    return chunks
