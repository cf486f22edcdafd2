"""Settings of a retriever, overridable by environment variables."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields

MODES = ("hybrid", "dense", "bm25")
_TRUE = frozenset({"1", "true", "yes", "on"})
_NO_QUANTIZATION = frozenset({"none", "off", "false", "fp32", "0"})


def _number(kind: type) -> Callable[[str, str], int | float]:
    def parse(name: str, text: str) -> int | float:
        try:
            return kind(text)
        except ValueError:
            raise ValueError(f"{name} must be {'an integer' if kind is int else 'a number'}, not {text!r}") from None

    return parse


_PARSERS: dict[str, Callable[[str, str], object]] = {
    "int": _number(int),
    "float": _number(float),
    "bool": lambda _, text: text.lower() in _TRUE,
    "str": lambda _, text: text,
}


def quantization(text: str) -> str:
    text = text.strip().lower()
    return "" if text in _NO_QUANTIZATION else text


# The environment variable of each setting. RETRIEVAL_ and the setting's own name serves as well.
VARIABLES = {
    "store_path": "CHROMA_DB_PATH", "collection": "CHROMA_COLLECTION", "embed_model": "EMBED_MODEL_NAME", "mode": "RETRIEVAL_MODE", "dense_k": "DENSE_TOP_K", "bm25_k": "BM25_TOP_K", "rrf_k": "RRF_K", "final_top_k": "FINAL_TOP_K",
    "index_path": "BM25_INDEX_PATH", "bm25_k1": "BM25_K1", "bm25_b": "BM25_B", "bm25_auto_sync": "BM25_AUTO_SYNC", "rerank_enabled": "RERANK_ENABLED", "rerank_model": "RERANKER_MODEL", "rerank_candidates": "RERANK_CANDIDATES",
    "rerank_max_length": "RERANK_MAX_LENGTH", "rerank_batch_size": "RERANK_BATCH_SIZE", "rerank_device": "RERANKER_DEVICE", "rerank_quantize": "RERANK_QUANTIZE",
}


@dataclass(frozen=True)
class RetrievalConfig:
    """Where things are, how deep each retriever looks and how results are fused and reranked."""

    store_path: str = "chunk_store"
    collection: str = "malayalam_docs"
    embed_model: str = ""
    mode: str = "hybrid"
    dense_k: int = 30
    bm25_k: int = 30
    rrf_k: int = 60
    final_top_k: int = 10
    index_path: str = "bm25_index"
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    bm25_auto_sync: bool = True
    rerank_enabled: bool = True
    rerank_model: str = ""
    rerank_candidates: int = 30
    rerank_max_length: int = 512
    rerank_batch_size: int = 8
    rerank_device: str = ""
    rerank_quantize: str = "int8"
    max_query_chars: int = 2000

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, not {self.mode!r}")
        for name in ("dense_k", "bm25_k", "final_top_k", "rerank_candidates", "rerank_batch_size", "max_query_chars"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.rrf_k < 0:
            raise ValueError("rrf_k must not be negative")

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ, **given: object) -> RetrievalConfig:
        """Defaults, with each setting that the environment gives, and ``given`` ones over both; blank ones don't count."""
        for f in fields(cls):
            for name in (VARIABLES.get(f.name, ""), f"RETRIEVAL_{f.name.upper()}"):
                text = env.get(name, "").strip()
                if text and f.name not in given:
                    given[f.name] = _SPECIAL.get(f.name, _PARSERS[str(f.type)])(name, text)
        return cls(**given)

    @property
    def pool(self) -> int:
        return max(self.final_top_k, self.rerank_candidates) if self.rerank_enabled else self.final_top_k


_SPECIAL: dict[str, Callable[[str, str], object]] = {"mode": lambda _, text: text.lower(), "rerank_quantize": lambda _, text: quantization(text)}
