"""What the training-data operators share: the shared folder, written stage tables and key helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART_BYTES = 4 << 20  # of a written table, for each of its parts at least, where a bound is known
_OWN: dict[str, str] = {}
_RECORDS: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset a temporary folder serves, but only for a local master; on a cluster it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="millrace-")
    return f"file://{_OWN[app]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex[:12]}"
    for record in _RECORDS:
        record.append(path)
    atexit.register(remove_path, spark, path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that are made inside, for one who knows when what reads them is done with."""
    paths: list[str] = []
    _RECORDS.append(paths)
    try:
        yield paths
    finally:
        _RECORDS.remove(paths)


def table_bytes(df: DataFrame) -> int:
    """Bytes of a written table, by the sizes of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def stage_table(df: DataFrame, name: str, within: Sequence[DataFrame] = (), spread: bool = False, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage with copies that survive a lost executor, and gives the planner true sizes, so that a
    small result is broadcast by Spark's own size check and a large one is not. ``within``: written tables that
    are together at least as large as the result. It is then written in no more parts than its greatest size is
    worth, so that small tables are not strewn over as many files as a large shuffle has partitions. With
    ``spread`` the work before the writing keeps its own partitions, at the cost of one more exchange.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if within:
        parts = sum(map(table_bytes, within)) // PART_BYTES + 1
        df = df.repartition(parts) if spread else df.coalesce(parts)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Give what Arrow and the C library keep for later back to the system: a worker stays beside the next stage's work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(col: str | Column) -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.encode(col, "UTF-8"), F.lit(b""))


def hash60(*cols: Column) -> Column:
    """The first 60 bits of the MD5 of the columns' text forms, as a long; null counts as an empty text."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    text = parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def respread(col: Column) -> Column:
    """The same long, in a form the planner can't trace to an earlier partitioning.

    A join on it exchanges both sides anew, which lets adaptive execution split skewed partitions.
    """
    return col.bitwiseXOR(F.lit(0).cast("long"))
