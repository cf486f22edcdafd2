"""Retrieval evaluation: evidence, ranking metrics, breakdowns and reports, over one table of results."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as tx

DEPTH = 10
NEEDLES = 10_000  # pieces of evidence that are sent to every task at once


def resolve_gold(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, fact, chunk_id, source``: chunks whose canonical text contains a piece of evidence.

    The golden set, in blocks of ``NEEDLES`` pieces, is sent along as an Aho-Corasick automaton, so that a chunk's text
    is read once for each block and not once for each piece. A null ``source`` of evidence matches any.
    """
    needles = evidence.select("query_id", "fact", F.col("source").alias("need_source"), tx.canonical(F.col("text")).alias("needle")).filter("needle <> ''")
    numbered = needles.select("needle").distinct()
    blocks = max(1, -(-numbered.count() // NEEDLES))
    hay = chunks.select("chunk_id", "source", tx.normalize(F.col("text")).alias("hay"))
    found = reduce(DataFrame.unionByName, [_containing(hay, numbered.filter(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == i)) for i in range(blocks)])
    joined = found.join(needles, "needle").filter(F.col("need_source").isNull() | (F.col("need_source") == F.col("source")))
    return joined.select("query_id", "fact", "chunk_id", "source").distinct()


def _containing(hay: DataFrame, needles: DataFrame) -> DataFrame:
    """``chunk_id, source, needle`` for each of ``needles`` that a chunk's ``hay``, its white space collapsed, contains."""
    texts = [r.needle for r in needles.collect()]  # a block of the golden set
    schema = T.StructType([hay.schema["chunk_id"], hay.schema["source"], T.StructField("needle", T.StringType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for text in texts:
            automaton.add_word(text, text)
        automaton.make_automaton()
        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(batch.column("hay").to_pylist() if texts else []):
                met = {x for _, x in automaton.iter(" ".join(text.split()))}
                rows += [k] * len(met)
                found += met
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id").take(at), batch.column("source").take(at), pa.array(found, pa.string())], schema.names)

    return hay.mapInArrow(find, schema)


def missing_evidence(evidence: DataFrame, gold: DataFrame) -> DataFrame:
    return evidence.select("query_id", "fact").distinct().join(gold, ["query_id", "fact"], "left_anti")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPECIAL = r"[\\^$.|?*+()\[\]{}]"
PATTERNS = 32  # that are held against chunks in one pass


def violated_probes(probes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Questions whose absence probe (``query_id, probe``, a pattern) does match a chunk's raw text, in any case of ASCII letters.

    Probes without special characters are texts and go to the chunks as an automaton, as evidence does. Others have no
    key: each of them is held against every chunk, some at a time and compiled once.
    """
    rows = probes.filter("probe IS NOT NULL").select("query_id", "probe", F.translate("probe", UPPER, LOWER).alias("needle"), F.col("probe").rlike(SPECIAL).alias("special"))
    plain = rows.filter("NOT special").select("needle").distinct()
    blocks = max(1, -(-plain.count() // NEEDLES))
    found = reduce(DataFrame.unionByName, [_met(chunks, plain.filter(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == i)) for i in range(blocks)])
    patterns = [r.probe for r in rows.filter("special").select("probe").distinct().collect()]  # of the golden set
    met: list[tuple[str]] = []
    for at in range(0, len(patterns), PATTERNS):
        some = patterns[at : at + PATTERNS]
        flags = chunks.agg(*[F.bool_or(F.rlike(F.col("text"), F.lit(f"(?i){p}"))) for p in some]).first()
        met += [(p,) for p, flag in zip(some, flags, strict=True) if flag]
    own = rows.filter("NOT special").join(found.distinct(), "needle", "left_semi").select("query_id")
    if not met:
        return own
    return own.unionByName(rows.filter("special").join(chunks.sparkSession.createDataFrame(met, "probe string"), "probe", "left_semi").select("query_id"))


def _met(chunks: DataFrame, needles: DataFrame) -> DataFrame:
    """``needle``, once a task, for each of ``needles`` that a chunk's text has, its ASCII letters in lower case."""
    texts = [r.needle for r in needles.collect()]  # a block of the golden set

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for text in filter(None, texts):
            automaton.add_word(text, text)
        automaton.make_automaton()
        met: set[str] = set()
        for batch in batches:
            for text in batch.column("text"):
                if text.is_valid and len(met) < len(texts):
                    met |= {""} & set(texts)
                    if len(automaton):
                        met.update(x for _, x in automaton.iter(text.as_buffer().to_pybytes().lower().decode()))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(met), pa.string())], ["needle"])

    return chunks.select("text").mapInArrow(find, "needle string")


def unanswerable(questions: DataFrame, gold: DataFrame) -> DataFrame:
    return questions.join(gold, "query_id", "left_anti").select("query_id")


def judged(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Results down to rank 10 with ``is_gold``."""
    own = gold.select("query_id", "chunk_id").distinct().withColumn("is_gold", F.lit(1))
    return results.filter(F.col("rank") <= DEPTH).join(own, ["query_id", "chunk_id"], "left").withColumn("is_gold", F.coalesce("is_gold", F.lit(0)))


def _found(k: int) -> Column:
    return F.sum(F.when(F.col("rank") <= k, F.col("is_gold")).otherwise(0))


def question_metrics(results: DataFrame, gold: DataFrame, pages: DataFrame) -> DataFrame:
    """One row a config and answerable question. ``pages`` has ``chunk_id, page_key``; a page counts as hit if any of
    its chunks is gold. Questions without results have zeros."""
    counts = gold.groupBy("query_id").agg(F.countDistinct("chunk_id").alias("n_gold"), F.countDistinct("fact").alias("facts_total"))
    configs = results.select("config").distinct()
    scope = counts.join(configs)  # questions by configs: a handful of configs
    rows = judged(results, gold)
    gain = F.col("is_gold") / F.log2(F.col("rank") + 1.0)
    hits = rows.groupBy("config", "query_id").agg(
        F.min(F.when(F.col("is_gold") == 1, F.col("rank"))).alias("first_gold_rank"), *[_found(k).alias(f"found_{k}") for k in (1, 5, 10)], F.sum(gain).alias("dcg")
    )
    gold_pages = gold.join(pages, "chunk_id").select("query_id", "page_key").distinct()
    page_hits = results.filter("rank <= 5").join(pages, "chunk_id").join(gold_pages, ["query_id", "page_key"]).select("config", "query_id").distinct().withColumn("page_hit_5", F.lit(1))
    facts = results.filter(F.col("rank") <= DEPTH).join(gold, ["query_id", "chunk_id"]).groupBy("config", "query_id").agg(F.countDistinct("fact").alias("facts_covered"))
    keys = ["config", "query_id"]
    out = scope.join(hits, keys, "left").join(page_hits, keys, "left").join(facts, keys, "left").fillna(0, ["found_1", "found_5", "found_10", "dcg", "page_hit_5", "facts_covered"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold").cast("int"), F.lit(DEPTH))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return out.select(
        *keys, "first_gold_rank", "n_gold",
        *[(F.col(f"found_{k}") > 0).cast("int").alias(f"hit_{k}") for k in (1, 5, 10)], F.col("page_hit_5").cast("int").alias("page_hit_5"),
        *[F.round(F.col(f"found_{k}") / F.col("n_gold"), 6).alias(f"recall_{k}") for k in (5, 10)],
        *[F.round(F.col(f"found_{k}") / k, 6).alias(f"precision_{k}") for k in (5, 10)],
        F.round(F.coalesce(1.0 / F.col("first_gold_rank"), F.lit(0.0)), 6).alias("mrr"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"),
        F.col("facts_covered").cast("long").alias("facts_covered"), "facts_total",
    )


SUMS = ("hit_1", "hit_5", "hit_10", "page_hit_5", "facts_covered", "facts_total")
MEANS = ("recall_5", "recall_10", "precision_5", "precision_10", "mrr", "ndcg")


def _summary() -> list[Column]:
    complete = F.count_if(F.col("facts_covered") == F.col("facts_total")).alias("complete")
    return [F.count("*").alias("n"), *[F.sum(c).cast("long").alias(c) for c in SUMS], *[F.round(F.avg(c), 6).alias(c) for c in MEANS], complete]


def summarize(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("config").agg(*_summary())


def breakdowns(metrics: DataFrame, questions: DataFrame) -> DataFrame:
    """By config, by config and category, by config and language, in one pass of grouping sets."""
    rows = metrics.join(questions.select("query_id", "category", "language"), "query_id")
    sets = [["config"], ["config", "category"], ["config", "language"]]
    sets = [[F.col(c) for c in s] for s in sets]
    grouped = rows.groupingSets(sets, "config", "category", "language").agg(*_summary(), F.grouping("category").cast("int").alias("no_category"), F.grouping("language").cast("int").alias("no_language"))
    return grouped


def rank_pivot(metrics: DataFrame, configs: list[str]) -> DataFrame:
    return metrics.groupBy("query_id").pivot("config", configs).agg(F.first("first_gold_rank"))


def latency(timings: DataFrame) -> DataFrame:
    """``config, stage, ms`` to exact medians and maxima."""
    return timings.groupBy("config", "stage").agg(F.round(F.expr("percentile(ms, 0.5)"), 6).alias("median_ms"), F.round(F.max("ms"), 6).alias("max_ms"), F.count("*").alias("n"))


def top_scores(hits: DataFrame, answerable: DataFrame) -> DataFrame:
    """Best rerank score of each question (none: 0): smallest, median and largest, by whether it is answerable."""
    best = answerable.join(hits.groupBy("query_id").agg(F.max("rerank_score").alias("top")), "query_id", "left").fillna(0.0, ["top"])
    return best.groupBy("answerable").agg(F.round(F.min("top"), 6).alias("least"), F.round(F.expr("percentile(top, 0.5)"), 6).alias("median"), F.round(F.max("top"), 6).alias("most"), F.count("*").alias("n"))


def pairwise_wins(metrics: DataFrame) -> DataFrame:
    """Each config against each other by first gold rank; a miss is worse than any rank."""
    rank = F.coalesce(F.col("first_gold_rank").cast("double"), F.lit(float("inf")))
    a = metrics.select("query_id", F.col("config").alias("config_a"), rank.alias("ra"))
    b = metrics.select("query_id", F.col("config").alias("config_b"), rank.alias("rb"))
    both = a.join(b, "query_id").filter("config_a <> config_b")
    return both.groupBy("config_a", "config_b").agg(F.count_if(F.col("ra") < F.col("rb")).alias("better"), F.count_if(F.col("ra") > F.col("rb")).alias("worse"), F.count_if(F.col("ra") == F.col("rb")).alias("tie"))


def review_scores(sheet: DataFrame, fields: list[str], abstain: str) -> DataFrame:
    """Filled review sheet to yes, partial, reviewed and unreviewed by config and field.

    ``abstain`` counts for unanswerable questions alone, the other fields for answerable ones.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.trim(F.coalesce(F.col(f).cast("string"), F.lit("")))).alias("value")) for f in fields]))
    rows = sheet.select("config", "answerable", pairs.alias("p")).select("config", "answerable", "p.*").filter((F.col("field") == abstain) == ~F.col("answerable"))
    return rows.groupBy("config", "field").agg(
        F.count_if(F.col("value").isin("y", "yes", "1", "true")).alias("yes"), F.count_if(F.col("value").startswith("p")).alias("partial"),
        F.count_if(F.col("value") != "").alias("reviewed"), F.count_if(F.col("value") == "").alias("unreviewed"),
    )


def answer_status(answers: DataFrame) -> DataFrame:
    """``config, answer, ms`` to answered, failed and the median time of what was answered."""
    ok = F.col("answer").isNotNull() & (F.col("answer") != "")
    return answers.groupBy("config").agg(F.count_if(ok).alias("answered"), F.count_if(~ok).alias("failed"), F.round(F.expr("percentile(CASE WHEN answer <> '' AND ms <> 0 THEN ms END, 0.5)"), 6).alias("median_ms"))


def matching_answers(answers: DataFrame, runs: DataFrame) -> DataFrame:
    """Answers that were given for the very ranking of a run: same config and question, same ids in order."""
    return answers.join(runs, ["config", "query_id"]).filter("answer_ids = ranked_ids").select("config", "query_id")


def sweep_rrf(ranked: DataFrame, gold: DataFrame, depths: list[int], ks: list[int]) -> DataFrame:
    """Fusion for every depth and k, in one plan: hits and mean reciprocal rank of the fused top ten."""
    spark = ranked.sparkSession
    grid = spark.createDataFrame([(d, k) for d in depths for k in ks], "depth int, k int")
    rows = ranked.join(F.broadcast(grid), F.col("pos") <= F.col("depth"))  # the grid is a parameter
    fused = rows.groupBy("depth", "k", "query_id", "chunk_id").agg(F.round(F.sum(1.0 / (F.col("k") + F.col("pos"))), 9).alias("s"), F.min("pos").alias("best"))
    order = Window.partitionBy("depth", "k", "query_id").orderBy(F.desc("s"), "best", "chunk_id")
    top = fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= DEPTH)
    first = top.join(gold.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"]).groupBy("depth", "k", "query_id").agg(F.min("rank").alias("first"))
    scope = gold.select("query_id").distinct().join(F.broadcast(grid))
    per = scope.join(first, ["depth", "k", "query_id"], "left")
    return per.groupBy("depth", "k").agg(F.count_if(F.col("first") == 1).alias("hit_1"), F.count("first").alias("hit_10"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def to_markdown(rows: DataFrame, title: str) -> str:
    """A small report table as Markdown; brought to the driver, so for summaries only."""
    head = [f"### {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(head + ["| " + " | ".join("-" if x is None else str(x) for x in r) + " |" for r in rows.collect()])
