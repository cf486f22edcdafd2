"""Encoders, rerankers and generators: what they must offer, as batch functions over Arrow, and fakes for tests."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class Generator(Protocol):
    def generate(self, prompt: str) -> str: ...


class RefusalError(RuntimeError):
    """The model declined to answer."""


class ProviderError(RuntimeError):
    """The provider failed; ``code`` tells whether it is worth another try."""

    def __init__(self, message: str, code: int = 500) -> None:
        super().__init__(message)
        self.code = code


def _batches(values: list, size: int) -> Iterator[list]:
    for at in range(0, len(values), size):
        yield values[at : at + size]


def encode(c: Column, load: Callable[[], Encoder], batch: int = 32) -> Column:
    """Vectors of a text column; the model is loaded once a worker."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series([v for b in _batches(texts, batch) for v in model.encode(b)])

    return run(c)


class _Once:
    """What ``load`` gives, made on first use, once in a worker process; a failure is remembered and raised again."""

    made: dict[str, object] = {}

    def __init__(self, load: Callable[[], Reranker]) -> None:
        self.load, self.key = load, uuid.uuid4().hex

    def get(self) -> Reranker:
        if self.key not in self.made:
            try:
                self.made[self.key] = self.load()
            except Exception as e:  # whatever a model raises
                self.made[self.key] = e
        if isinstance(found := self.made[self.key], Exception):
            raise RuntimeError("the reranker could not be loaded") from found
        return found


def quantized(load: Callable[[], Reranker], kind: str, device: str = "cpu") -> Callable[[], Reranker]:
    """``load`` with its model passed through its own ``quantize(kind)``, if it has one; on another device than a CPU as it is."""

    def loaded() -> Reranker:
        model = load()
        return model.quantize(kind) if kind and device in ("", "cpu") and hasattr(model, "quantize") else model

    return loaded


def rerank_scores(question: Column, passage: Column, load: Callable[[], Reranker], batch: int = 8) -> Column:
    """Scores of pairs; the model is loaded once a worker, by the first batch that needs it."""
    once = _Once(load)

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = once.get()
        for a, b in parts:
            pairs = list(zip(a.fillna(""), b.fillna(""), strict=True))
            yield pd.Series([float(s) for p in _batches(pairs, batch) for s in model.score(p)])

    return run(question, passage)


def generate(model: Generator, prompt: str, tries: int = 5, wait: float = 1.0) -> str:
    """An answer, with more tries on codes 429 and 5xx; an empty answer is a refusal."""
    for turn in range(tries):
        try:
            answer = (model.generate(prompt) or "").strip()
        except ProviderError as e:
            if turn + 1 == tries or not (e.code == 429 or e.code >= 500):
                raise
            time.sleep(wait * 2**turn)
            continue
        if not answer:
            raise RefusalError("the answer is empty")
        return answer
    raise AssertionError("unreachable")


class HashEncoder:
    """A deterministic stand-in for an encoder: unit vectors of hashed words."""

    def __init__(self, size: int = 16) -> None:
        self.size = size

    def encode(self, texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for text in texts:
            v = [0.0] * self.size
            for word in text.lower().split():
                v[zlib.crc32(word.encode()) % self.size] += 1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out


class OverlapReranker:
    """A deterministic stand-in for a cross-encoder: the share of the question's words in the passage."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        return [len(q & p) / len(q) if (q := set(a.lower().split())) and (p := set(b.lower().split())) is not None else 0.0 for a, b in pairs]
