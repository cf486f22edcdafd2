"""Operator 3, mixing sources to target weights with hash-threshold histograms.

Sizes are summed by source and hash bucket; a running sum over a source's at most 1,024 buckets finds the bucket
that its budget ends in; only that bucket is split further, until it holds one hash. A document is then taken by
comparing its hash with its source's threshold: nothing is sorted and reruns agree. Mixes of growing budgets are
nested, since they share the hash order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import hash60, stage_table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BITS, LEVELS = 10, 6  # 60 bits of hash


def count_words(text: Column) -> Column:
    """The number of words of a text, null: 0. Each becomes one letter, so that no array of them is held."""
    return F.coalesce(F.char_length(F.translate(F.regexp_replace(text, WORD, "x"), " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def _with_keys(df: DataFrame, text: str, source: str, key: str, keep: list[str]) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    return df.select(row.alias("row"), F.col(source).cast("string").alias("source"), count_words(F.col(text)).alias("size"), hash60(F.col(key), F.md5(F.coalesce(text, F.lit("")))).alias("h"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size`` to targets: the weights share 150% of all sizes, none above twice its source's size.

    Sources rank by code point, null last; weights repeat. Handing the excess round by weight ends where every
    source under its bound gets the same multiple of its weight, which sorting by bound over weight finds at once.
    The table has one row per source, and its windows run over all of them in one task: made for thousands of sources,
    not for a source each document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("long")
    ranked = sizes.select("source", "source_size", weight.alias("w"), F.row_number().over(by_name).alias("rank"))
    order = Window.orderBy(F.col("source_size") / F.col("w"), "rank")
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = ranked.select(
        "*",
        F.row_number().over(order).alias("k"),
        (3 * F.sum("source_size").over(every) - 4 * (F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("source_size"))).alias("left2"),
        (F.sum("w").over(every) - F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("w")).alias("w_left"),
    )
    free = 4 * F.col("source_size") * F.col("w_left") > F.col("left2") * F.col("w")
    first = F.min(F.when(free, F.struct("k", (F.col("left2") / 2.0 / F.col("w_left")).alias("level")))).over(every)
    target = F.when(F.col("k") < first["k"], 2.0 * F.col("source_size")).otherwise(first["level"] * F.col("w"))
    return filled.select("source", "source_size", F.coalesce(target, 2.0 * F.col("source_size")).cast("double").alias("target"))


def thresholds(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per source: size, target, whole copies and the hash below which one more copy is taken.

    ``rows`` has ``source, size, h``. Documents of a source whose hashes are equal (repeated rows) are taken together.
    The group of equal hashes in which the budget ends is taken if that brings the sum nearer to the target.
    """
    shift = BITS * (LEVELS - 1)
    hist = stage_table(_histogram(rows, shift), "mix-hist", [rows])
    per_source = hist.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    goal = targets(per_source, weights)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    goal = stage_table(goal.withColumn("before", F.lit(0).cast("long")), "mix-goal", [hist])
    found: DataFrame | None = None
    while True:
        inside = Window.partitionBy("source").orderBy("bucket")
        joined = hist.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        ends = joined.withColumn("cum", F.col("before") + F.sum("size").over(inside)).filter(F.col("cum") > F.col("rest"))
        first = F.row_number().over(Window.partitionBy("source").orderBy("bucket"))
        ends = stage_table(
            ends.withColumn("nth", first).filter("nth = 1").select("source", "source_size", "target", "copies", "rest", "bucket", "low", "high", "cum", (F.col("cum") - F.col("size")).alias("before")),
            "mix-ends",
            [hist],
        )
        # Of one hash: taken if the sum before and after it lie about the target, nearer with it.
        single = ends.filter("low = high").select("source", "source_size", "target", "copies", (F.col("low") + (F.col("before") + F.col("cum") <= 2 * F.col("rest")).cast("long")).alias("threshold"))
        found = single if found is None else found.unionByName(single)
        goal = ends.filter("low < high")
        if shift == 0 or goal.isEmpty():
            break
        boundary = goal.select(F.col("source").alias("s"), F.col("bucket").alias("b"))
        narrowed = rows.join(boundary, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift) == F.col("b"))).select("source", "size", "h")
        goal = goal.select("source", "source_size", "target", "copies", "rest", "before")
        shift -= BITS
        hist = stage_table(_histogram(narrowed, shift), "mix-hist", [rows])
    empty = per_source.filter("source_size = 0").select("source", "source_size", F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("threshold"))
    return stage_table(found.unionByName(empty), "mix-thresholds")


def _histogram(rows: DataFrame, shift: int) -> DataFrame:
    return rows.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.min("h").alias("low"), F.max("h").alias("high"))


def mix(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", keep: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Every row of ``df`` as ``row`` with size, source_size, target, ``n_copies`` and ``taken``.

    Rows go by a hash of key and text, so that rows of one key, null keys too, part unless they are the same row again.
    Null text has size 0; a null source is a source, last in order. An empty table gives an empty result.
    """
    keep = df.columns if keep is None else keep
    keyed = _with_keys(df, text, source, key, keep)
    if keep == [key]:
        keyed = stage_table(keyed, "mix-rows")
    rows = keyed.select("source", "size", "h")
    if keep != [key]:
        rows = stage_table(rows, "mix-rows")
    limits = thresholds(rows, weights).withColumnRenamed("source", "s")
    n_copies = (F.col("copies") + (F.col("h") < F.col("threshold")).cast("long")).alias("n_copies")
    # One row per source: broadcast by Spark if its size allows, else a join that splits hot sources.
    out = keyed.join(limits, F.col("source").eqNullSafe(F.col("s"))).select("row", "size", "source_size", "target", n_copies)
    return out.withColumn("taken", F.col("size") * F.col("n_copies"))


def mixed_rows(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The mix itself: each taken row of ``df``, as often as it is taken."""
    return mix(df, text, source, key).filter("n_copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("n_copies").cast("int")))).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, keep=["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(rank - 1) % 3 + 1]::BIGINT AS w FROM s),
f AS (SELECT *, row_number() OVER o AS k,
    3 * sum(source_size) OVER () - 4 * (sum(source_size) OVER o - source_size) AS left2, sum(w) OVER () - sum(w) OVER o + w AS w_left
  FROM w WINDOW o AS (ORDER BY source_size / w, rank ROWS UNBOUNDED PRECEDING)),
l AS (SELECT arg_min(left2::DOUBLE / 2.0 / w_left::DOUBLE, k) AS level, min(k) AS k FROM f WHERE 4 * source_size * w_left > left2 * w),
t AS (SELECT source, source_size, coalesce(CASE WHEN f.k < l.k THEN 2.0::DOUBLE * source_size ELSE level * w END, 2.0::DOUBLE * source_size)::DOUBLE AS target FROM f, l),
c AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM t),
g AS (SELECT source, h, sum(size)::BIGINT AS size FROM d GROUP BY source, h),
r AS (SELECT source, h, sum(size) OVER (PARTITION BY source ORDER BY h) AS cum, size FROM g),
p AS (SELECT r.source, h, source_size, target, copies, (2 * cum - r.size)::DOUBLE <= 2 * (target - copies * source_size) AS more
  FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target, size * (copies + CASE WHEN more THEN 1 ELSE 0 END)::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.h = p.h
"""
