"""PDF folders to pages, with a pluggable parser and OCR engines."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx

Parser = Callable[[bytes], Iterable[str]]
Engine = Callable[[bytes, int], str]  # content and page number from 1 to text
PAGES = "source string, page int, text string, method string, char_count int, error string"


def find_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """``source, path, content`` of the PDF files right in ``folder``; a missing folder raises."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF}").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("source"), "path", "content")


def extract_pages(files: DataFrame, parser: Parser, engines: tuple[Engine, ...] = (), least: int = 50) -> DataFrame:
    """A row per page. A page of under ``least`` characters goes through the OCR engines, the first long result counts.

    Where a file can't be parsed, or not further, a row with its ``error`` and no text comes behind the pages that it
    gave, so that one file doesn't end a run. A parser may give its pages one by one.
    """

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows: list[tuple] = []
            for source, content in zip(part["source"], part["content"], strict=True):
                try:
                    for number, text in enumerate(parser(bytes(content)), 1):
                        text, method = (text or "").strip(), "pypdf"
                        if len(text) < least:
                            read_ = next((t for t in (e(bytes(content), number).strip() for e in engines) if len(t) >= least), None)
                            text, method = (text, "pypdf_fallback") if read_ is None else (read_, "ocr")
                        rows.append((source, number, text, method, len(text), None))
                except Exception as e:  # a parser may raise anything
                    rows.append((source, 0, None, None, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["source", "page", "text", "method", "char_count", "error"])

    return files.select("source", "content").mapInPandas(read, PAGES)


def summary(pages: DataFrame) -> DataFrame:
    """Pages, characters and pages of each method, by file."""
    counts = [F.count_if(F.col("method") == m).alias(m) for m in ("pypdf", "ocr", "pypdf_fallback")]
    return pages.filter("error IS NULL").groupBy("source").agg(F.count("*").alias("pages"), F.sum("char_count").alias("chars"), *counts)


def clean_pages(pages: DataFrame, least: int = 50) -> DataFrame:
    cleaned = pages.withColumn("text", tx.clean_text(F.col("text")))
    return cleaned.withColumn("is_short", F.length("text") < least)
