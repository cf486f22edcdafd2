"""A PySpark engine for hybrid document retrieval, its evaluation and training-data operations.

What a program that only searches needs is named here: settings, the retriever with its results, indexes in memory and
in files, tokenising, and what encoders, rerankers and generators must offer.
"""

from millrace.config import RetrievalConfig
from millrace.functions.text import normalize, tokenize, tokenizer_version
from millrace.operators.bm25 import Bm25Index, build_index
from millrace.operators.models import Encoder, Generator, ProviderError, RefusalError, Reranker
from millrace.operators.postings import SavedIndex
from millrace.plans.retriever import HybridRetriever, RetrievalError, RetrievalResult, ask, build_retriever, prepared_index

__all__ = [
    "Bm25Index", "Encoder", "Generator", "HybridRetriever", "ProviderError", "RefusalError", "Reranker", "RetrievalConfig", "RetrievalError", "RetrievalResult",
    "SavedIndex", "ask", "build_index", "build_retriever", "normalize", "prepared_index", "tokenize", "tokenizer_version",
]
