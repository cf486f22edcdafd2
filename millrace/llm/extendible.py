"""Operator 2, sharding by extendible hashing.

Rows go by the leading bits of their key's hash. The directory starts with one bucket of no bits; only a bucket over
the byte limit is split on one more bit, until every shard fits. Byte counts of ten bits at a time are summed, for
the rows of oversized buckets alone, so the directory of local depths is found in a few passes over hashes and sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import hash60, stage_table, text_bytes

LIMIT = 1 << 20
BITS = 60
STRIDE = 10


def _directory(open_: DataFrame, depth: int, limit: int) -> DataFrame:
    """Leaves ``depth + STRIDE`` bits deep of the open buckets: ``leaf, depth``, null where a leaf must split further.

    A leaf takes the least depth at which its bucket fits, or holds one hash, which no bit can split.
    """
    below = BITS - depth - STRIDE
    leaves = open_.groupBy(F.shiftright("h", below).alias("leaf")).agg(F.sum("n_bytes").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
    leaves = leaves.withColumn("bucket", F.shiftright("leaf", STRIDE))
    fits = F.lit(None).cast("int")
    for bits in range(STRIDE, -1, -1):
        window = Window.partitionBy("bucket", F.shiftright("leaf", STRIDE - bits))
        fits = F.when((F.sum("n").over(window) <= limit) | (F.min("low").over(window) == F.max("high").over(window)), depth + bits).otherwise(fits)
    return leaves.select("leaf", fits.alias("depth"))


def shard(df: DataFrame, key: str, size: str, keep: list[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """Every row of ``df`` as ``row`` with ``n_bytes`` and its ``shard`` (hash bits as text), ``depth`` and ``page``.

    A null size is 0; null keys share the hash of an empty text. A row over the limit has a shard, or page, of its
    own. Rows with one hash (repeated keys) can't be split by bits; where they exceed the limit together, they are
    chained as overflow pages within the limit. Else ``page`` is 0.
    """
    keep = df.columns if keep is None else keep
    picked = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), hash60(F.col(key)).alias("h"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n_bytes"))
    rows = stage_table(picked, "shard-rows")
    narrow = rows.select("h", "n_bytes")
    open_, depths = narrow, []
    for depth in range(0, BITS, STRIDE):
        leaves = stage_table(_directory(open_, depth, limit), "shard-leaves", [narrow])
        leaf, below = F.col("leaf"), F.shiftright("h", BITS - depth - STRIDE)
        depths.append(F.col(f"depth{depth}"))
        # Only leaves that end here: where all split further, as the first do in a large table, there are none.
        rows = rows.join(leaves.filter("depth IS NOT NULL").select(leaf.alias(f"leaf{depth}"), F.col("depth").alias(f"depth{depth}")), below == F.col(f"leaf{depth}"), "left")
        split = leaves.filter("depth IS NULL").select("leaf")
        if split.isEmpty():
            break
        open_ = narrow.join(split, below == leaf, "left_semi")
    out = stage_table(rows.select("row", "h", "n_bytes", F.coalesce(*depths).alias("depth")), "shard-found")
    bits = F.lpad(F.conv(F.shiftright("h", BITS - 30).cast("string"), 10, 2), 30, "0"), F.lpad(F.conv(F.col("h").bitwiseAND((1 << 30) - 1).cast("string"), 10, 2), 30, "0")
    out = out.withColumn("shard", F.substring(F.concat(*bits), F.lit(1), F.col("depth")))
    return _paged(out, limit).select("row", "n_bytes", "shard", "depth", "page")


def _paged(found: DataFrame, limit: int) -> DataFrame:
    over = found.groupBy("depth", "shard").agg(F.sum("n_bytes").alias("n"), F.count("*").alias("k")).filter((F.col("n") > limit) & (F.col("k") > 1))
    over = stage_table(over.select(F.col("depth").alias("d"), F.col("shard").alias("s")), "shard-over")
    if over.isEmpty():
        return found.withColumn("page", F.lit(0).cast("long"))
    same = (F.col("depth") == F.col("d")) & (F.col("shard") == F.col("s"))
    rows = stage_table(found.join(over, same).drop("d", "s"), "shard-crowded")
    # Numbers by file part and place in it: parts are summed first, so no group is sorted in one task.
    rows = stage_table(rows.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)), "shard-crowded")
    wide = 2 * F.col("n_bytes") > limit
    weight = F.when(wide, 0).otherwise(F.col("n_bytes"))
    parts = rows.groupBy("shard", "part").agg(F.sum(weight).alias("n"), F.sum(wide.cast("long")).alias("k"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stage_table(parts.select(F.col("shard").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("k0")), "shard-parts")
    inside = Window.partitionBy("shard", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("n1", F.coalesce(F.sum(weight).over(inside), F.lit(0))).withColumn("k1", F.coalesce(F.sum(wide.cast("long")).over(inside), F.lit(0)))
    rows = rows.join(parts, (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p")))
    # Rows of up to half the limit fill pages by halves of it; each larger one has a page, numbered below zero.
    page = F.when(wide, -1 - F.col("k0") - F.col("k1")).otherwise(F.floor((F.col("n0") + F.col("n1")) / (limit // 2)))
    paged = rows.select(*found.columns, page.cast("long").alias("page"))
    return found.join(over, same, "left_anti").withColumn("page", F.lit(0).cast("long")).unionByName(paged)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.octet_length(text_bytes("text")).alias("n"))
    return shard(docs, "doc_id", "n", keep=["doc_id"]).select("row.doc_id", "n_bytes", "shard", "depth", "page")


SQL = """
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
b AS (SELECT doc_id, n_bytes, h, depth, h >> (60 - depth) AS p FROM d, range(31) r(depth)),
s AS (SELECT doc_id, n_bytes, h, depth, sum(n_bytes) OVER w <= 1048576 OR min(h) OVER w = max(h) OVER w AS fits
  FROM b WINDOW w AS (PARTITION BY depth, p)),
f AS (SELECT doc_id, n_bytes, h, min(depth) AS depth FROM s WHERE fits GROUP BY doc_id, n_bytes, h)
SELECT doc_id, n_bytes, array_to_string(list_transform(range(depth), lambda k: ((h >> (59 - k)) & 1)::VARCHAR), '') AS shard, depth::INT AS depth, 0::BIGINT AS page
FROM f
"""
