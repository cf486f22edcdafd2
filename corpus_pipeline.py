"""The corpus pipeline: documents in, filtered, deduplicated, mixed and encoded documents out."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, minhash, mixing, quality_hosts, suffix
from millrace.llm.common import recorded, remove_path, stage_table


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_made: dict[tuple[str, int], list[str]] = {}


def read_from(docs: DataFrame) -> list[str]:
    """The folders that ``docs`` read files from."""
    leaves = docs._jdf.queryExecution().analyzed().collectLeaves()
    plans = [leaves.apply(i) for i in range(leaves.size())]
    roots = [p.relation().location().rootPaths() for p in plans if p.getClass().getSimpleName() == "LogicalRelation"]
    return [r.apply(i).toString() for r in roots for i in range(r.size())]


def stage(place: int) -> Callable[[Stage], Stage]:
    """A stage that first removes the intermediate tables of the one before it, whose result, by then, is written."""

    def wrap(f: Stage) -> Stage:
        @wraps(f)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            app = spark.sparkContext.applicationId
            roots = read_from(docs)
            own = [path for made in _made.values() for path in made]
            # Where stages are chained without writing, docs still read tables of theirs; then, and where nothing
            # tells what docs read, all stay.
            if roots and not any(path.rpartition("/")[2] in r for r in roots for path in own):
                for path in _made.pop((app, place - 1), []):
                    remove_path(spark, path)
            with recorded() as paths:
                out = f(spark, docs, sf_dir)
            _made.setdefault((app, place), []).extend(paths)
            return out

        return run_stage

    return wrap


@stage(0)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules of their own text and of their host, with their columns as they are.

    Null and empty texts have under 50 words, so they go; a null source is a host of its own. Repeated rows are judged
    alike, each by itself. An empty table gives an empty one.
    """
    return quality_hosts.keep_good(docs)


@stage(1)
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id.

    Of repeated rows, and of a class whose ids are all null, one row stays. Texts without words (null, empty, blank)
    are alike only if equal, null to empty. An empty table gives an empty one.
    """
    return minhash.keep_one(docs)


@stage(2)
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 400 bytes that occur elsewhere too and without passages of over 50 words that
    other documents have; ``n_chars`` counted anew.

    Every row stays, emptied ones too; a null text becomes an empty one. Equal texts, so also repeated rows, lose all
    from 400 bytes on. An empty table gives an empty one.
    """
    cut = suffix.remove_repeats(docs, cut_passages=True)
    changed = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast(docs.schema["n_chars"].dataType)}
    return cut.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


@stage(3)
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix by source takes them, up to twice.

    Documents without words, null texts among them, add nothing to any target and go by their hash as others do. A null
    source is a source; repeated rows are taken or left together. An empty table gives an empty one.
    """
    return mixing.mixed_rows(docs)


@stage(4)
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with a mark that they decode to its text.

    A null or empty text has no ids and decodes to an empty one. Repeated rows are each a row of the result. An empty
    table gives an empty one.
    """
    hashed = docs.select("doc_id", "lang", "source", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("sha256"), "text")
    coded = bpe.encode_documents(hashed, keep=["doc_id", "lang", "source", "sha256"], texts=False)
    same = F.col("decoded_sha256") == F.col("row.sha256")
    return coded.select("row.doc_id", "row.lang", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("decodes"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixture", mixture), ("encode", encode)]

# Near-duplicate classes, repeated passages and token ids can't be stated in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage_table(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
