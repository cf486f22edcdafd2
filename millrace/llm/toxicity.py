"""Operator 5, toxicity by a weighted lexicon.

Texts are folded (lower case, homoglyphs and digit substitutions to plain letters), lexicon entries are found by
Aho-Corasick, hits inside exception phrases are left out, and the weights of the rest are summed and divided by
the text's number of words. Weights, exceptions and the map from that sum to a score are learned from labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stage_table

SAMPLE_ROWS = 20_000  # labelled rows that the lexicon is learned from, at most
MIN_DOCS, MIN_SHARE = 4, 0.01  # toxic documents, and share of them, that an entry must be in
MIN_WEIGHT = 2.5
STEMS = range(4, 11)

# Letters of other scripts that look like Latin ones, and digits or signs that stand for letters.
HOMOGLYPHS = dict(zip("авеёзікмнорѕтухсјԁһԛԝґαβεικνορτυχγϲȷɡɩʟ", "abeeeikmhopstyxcjdhqwrabeiknoptuxycjgil", strict=True))
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "class clown", "clown fish")

_FOLD = re.compile("[" + "".join(HOMOGLYPHS) + r"]|[013457@$!](?=[^\W\d_])|(?<=[^\W\d_])[013457@$!]|[​-‍⁠﻿­]")
_MAP = HOMOGLYPHS | SUBSTITUTES
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case, compatibility forms, look-alike letters and digit substitutions undone, invisible signs removed."""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return _FOLD.sub(lambda m: _MAP.get(m[0], ""), text.lower())


def _forms(folded: str) -> set[str]:
    """Each word with an end mark, and its stems."""
    words = set(_WORD.findall(folded))
    return {w + "$" for w in words if len(w) > 2} | {w[:n] for w in words for n in STEMS if n <= len(w)}


@dataclass(frozen=True)
class Model:
    """``terms``: weights of words (ending in ``$``) and stems; ``slope`` and ``bias`` turn a density into a score."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 1.0
    bias: float = -1.0

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    """The lexicon's automaton. A 1 may stand for i or l, so entries with l are also matched with i in its place."""

    def __init__(self, model: Model) -> None:
        self.model, self.automaton = model, ahocorasick.Automaton()
        best: dict[str, list[tuple[bool, float]]] = {}
        for term, weight in model.terms.items():
            stem, whole = term.rstrip("$"), term.endswith("$")
            for form in {stem, stem.replace("l", "i")}:
                best.setdefault(form, []).append((whole, weight))
        for form, found in best.items():
            self.automaton.add_word(form, (len(form), found))
        if best:
            self.automaton.make_automaton()
        self.phrases = re.compile("|".join(r"\b" + re.escape(p) + r"\b" for p in model.exceptions)) if model.exceptions else None

    def hits(self, folded: str) -> dict[int, float]:
        """The greatest weight of an entry at each word start, without words inside an exception phrase."""
        found: dict[int, float] = {}
        if not len(self.automaton):
            return found
        n = len(folded)
        for end, (size, entries) in self.automaton.iter(folded):
            start = end - size + 1
            if start and folded[start - 1].isalpha():
                continue
            ends = end + 1 == n or not folded[end + 1].isalpha()
            weight = max((w for whole, w in entries if ends or not whole), default=0.0)
            if weight > found.get(start, 0.0):
                found[start] = weight
        if found and self.phrases:
            for m in self.phrases.finditer(folded):
                for at in [a for a in found if m.start() <= a < m.end()]:
                    del found[at]
        return found

    def density(self, text: str | None) -> float:
        """Weight in a hundred words, on a logarithmic scale; 0 for a text without hits."""
        if not text:
            return 0.0
        found = self.hits(fold(text))
        if not found:
            return 0.0
        words = text.count(" ") + text.count("\n") + 1
        return math.log1p(100.0 * sum(found.values()) / words)

    def score(self, text: str | None) -> float:
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.model.slope * self.density(text) + self.model.bias))))


def _counted(sample: DataFrame, toxic: int, among: set[str] | None, pairs: Matcher | None = None) -> DataFrame:
    """Documents of one label that have each form (or, with ``pairs``, each phrase of a hit and a neighbour)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for x in batch.column("text"):
                folded = fold(x.as_py() or "")
                if pairs is None:
                    forms = _forms(folded)
                    total.update(forms if among is None else forms & among)
                    continue
                near = set()
                for at in pairs.hits(folded):
                    around = _WORD.findall(folded[max(0, at - 40) : at])[-1:], _WORD.findall(folded[at : at + 80])[:2]
                    near |= {" ".join(around[1])} | {" ".join([*around[0], *around[1][:1]])}
                total.update(p for p in near if " " in p and (among is None or p in among))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["form", "n"])

    rows = sample.filter(F.col("toxic") == toxic).select("text").mapInArrow(count, "form string, n long")
    return rows.groupBy("form").agg(F.sum("n").alias("n"))


def _collected(counted: DataFrame, least: int) -> dict[str, int]:
    """Forms of at least ``least`` documents of the sample, whose bound is theirs too."""
    return {r.form: r.n for r in counted.filter(F.col("n") >= least).collect()}


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias by Newton's method, with a small ridge so that separable rows have a finite fit."""
    design, beta = np.column_stack([x, np.ones_like(x)]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (p - y) + 0.01 * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learn from ``key, text, toxic`` rows: at most ``rows`` of them, those with the least MD5 of their key; equal texts count once.

    A null label is no label. Without toxic rows the lexicon is empty and every score is the share of toxic rows.
    """
    # Of equal texts one counts, so that a group of copies does not make a lexicon of its own words.
    sample = stage_table(labelled.groupBy("text").agg(F.max("toxic").alias("toxic")), "tox-sample")
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model({}, bias=math.log((n1 + 1e-3) / (n0 + 1e-3)) if n1 or n0 else -60.0)
    seen = _collected(_counted(sample, 1, None), max(MIN_DOCS, math.ceil(MIN_SHARE * n1)))
    clean = _collected(_counted(sample, 0, set(seen)), 1)
    weight = {f: math.log((k + 0.5) / (n1 + 1)) - math.log((clean.get(f, 0) + 0.5) / (n0 + 1)) for f, k in seen.items()}
    longer: Counter[str] = Counter()  # of a stem: the documents of its most frequent longer stem
    for form, k in seen.items():
        for n in range(STEMS.start, len(form)) if form[-1] != "$" else ():
            longer[form[:n]] = max(longer[form[:n]], k)
    terms: dict[str, float] = {}
    for form in sorted((f for f in weight if weight[f] >= MIN_WEIGHT and longer[f] < 0.85 * seen[f]), key=lambda f: (len(f), f)):
        stem = form.rstrip("$")
        shorter = max((terms[stem[:n]] for n in range(STEMS.start, len(form)) if stem[:n] in terms), default=-math.inf)
        if weight[form] > shorter + 0.7:  # else a shorter stem says as much
            terms[form] = weight[form]
    kept = dict(sorted(terms.items()))
    matcher = Model(kept).matcher()
    good = _collected(_counted(sample, 0, None, matcher), MIN_DOCS)
    bad = _collected(_counted(sample, 1, set(good), matcher), 1)
    learned = tuple(sorted(p for p, k in good.items() if (k + 0.5) / (n0 + 1) > (bad.get(p, 0) + 0.5) / (n1 + 1)))
    model = Model(kept, tuple(dict.fromkeys(EXCEPTIONS + learned)))
    densities = _with_density(sample.select("toxic", "text"), model).select("toxic", "density").toPandas()  # at most ``rows`` rows
    slope, bias = _logistic(densities["density"].to_numpy(), densities["toxic"].to_numpy(dtype=float))
    return Model(model.terms, model.exceptions, slope, bias)


def _with_density(df: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in batches:
            found = pa.array([matcher.density(x.as_py()) for x in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), found], ["toxic", "density"])

    return df.mapInArrow(run, "toxic int, density double")


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row of ``df`` as ``row`` with ``score`` from 0 to 1, over its whole text. Null text counts as empty."""
    keep = df.columns if keep is None else keep
    picked = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in batches:
            found = pa.array([matcher.score(x.as_py()) for x in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), found], ["row", "score"])

    from pyspark.sql import types as T

    return picked.mapInArrow(run, T.StructType([picked.schema["row"], T.StructField("score", T.DoubleType())]))


def held_out(key: str):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``text, toxic`` of at most ``rows`` labelled documents that aren't held out.

    Of labels for one id the greatest counts, of texts with one id the first by code point. Null ids and labels don't.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    # At most ``rows`` pairs of numbers: a bound by parameter.
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return joined.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(training_rows(docs, labels))
    scored = score(docs, model, keep=["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "score")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
