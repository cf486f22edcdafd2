"""Operator 1, dictionary-compressed WARC archives.

Each task writes archives of a bounded size: a Zstandard dictionary built from the archive's own records, in a
leading skippable frame, then every record in a frame of its own. A payload seen before becomes a revisit record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import posixpath
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import new_path, stage_table, text_bytes

# Fixed values of the WARC and Zstandard formats.
DICT_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1"

ARCHIVE_BYTES = 32 << 20
DICT_BYTES = 32 << 10
DICT_SAMPLE = 2 << 20
PIECE = 64 << 10  # of a long record
WRITTEN = "path string, records long, raw_bytes long, stored_bytes long"
READ = "record_id string, target_uri string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str | None) -> str:
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def record(record_id: str, uri: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One WARC record. A revisit keeps the HTTP head, whose Content-Length tells the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_line(uri)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _piece(record: bytes, k: int) -> bytes:
    """The record, or of a long one 64 KiB from a place that moves on with ``k``, so that all parts of records are learned."""
    return record[(at := k * 0x9E3779B1 % max(1, len(record) - PIECE)) : at + PIECE] if len(record) > PIECE else record


def build_dictionary(records: list[bytes], size: int = DICT_BYTES, sample: int = DICT_SAMPLE) -> bytes:
    """A dictionary from an archive's records: evenly spaced ones until ``sample`` bytes, which bounds the training, of
    those over 64 KiB a piece of that size.

    Where training finds too little to go by, the sample's last bytes serve as a raw dictionary.
    """
    step = max(1, sum(map(len, records)) // sample)
    chosen = [_piece(r, k) for k, r in enumerate(records[::step])]
    try:
        return zstandard.train_dictionary(size, chosen, k=256, d=8, f=18, accel=4, split_point=1.0, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(chosen)[-size:]


def pack(records: list[bytes], level: int = 3) -> bytes:
    """An archive: the dictionary frame, then each record's frame."""
    raw = build_dictionary(records)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdCompressor(level=level)
    return b"".join([struct.pack("<II", DICT_MAGIC, len(raw)), raw, *map(compressor.compress, records)])


def unpack(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, read as a stream."""
    magic, size = struct.unpack_from("<II", archive)
    if magic != DICT_MAGIC:
        raise ValueError("the archive has no leading dictionary frame")
    raw = archive[8 : 8 + size]
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    with reader.stream_reader(io.BytesIO(memoryview(archive)[8 + size :]), read_across_frames=True) as stream:
        lines = io.BufferedReader(stream, 1 << 18)
        while first := lines.readline():
            if first.strip() != VERSION:
                raise ValueError(f"not a WARC record: {first[:40]!r}")
            fields = {}
            while (line := lines.readline().decode().rstrip("\r\n")):
                name, _, value = line.partition(": ")
                fields[name] = value
            block = lines.read(int(fields["Content-Length"]))
            if lines.read(4) != b"\r\n\r\n":
                raise ValueError("a record doesn't end where it should")
            yield fields, block


def plan_revisits(df: DataFrame, key: str, payload: str, min_bytes: int) -> DataFrame:
    """``df`` with ``digest`` and ``first_id``: the smallest key of the records with that payload, if not this one's.

    Digests travel to be counted, first records come back. Where they are too many to be broadcast by Spark's size check
    the rows are dealt out by digest, payloads with them. Payloads under ``min_bytes`` never refer. Null keys come last; where all keys of a group
    are null, or a key is repeated in it, the rows with the smallest key are all responses.
    """
    hashed = df.withColumn("digest", F.sha1(payload))
    narrow = hashed.filter(F.octet_length(payload) >= min_bytes).groupBy("digest").agg(F.min(key).alias("first_id"), F.count("*").alias("n"))
    firsts = stage_table(narrow.filter("n > 1").select("digest", "first_id"), "warc-firsts")
    # Written, so its size is known: Spark broadcasts it only under its threshold; else both sides are dealt out by
    # digest, and adaptive execution can split the digest of a large group.
    joined = hashed.join(firsts, "digest", "left")
    later = F.col(key).isNull() | (F.col(key) > F.col("first_id"))
    return joined.withColumn("first_id", F.when(later & (F.octet_length(payload) >= min_bytes), F.col("first_id")))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a URI that Spark knows; s3a and s3n are Arrow's s3. What Arrow has none for raises."""
    scheme, colon, rest = uri.partition(":")
    return pafs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + colon + rest)


def write_archives(df: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``record_id, uri, payload, refers_to`` rows as archives under ``path``; one row per archive written.

    A file is written under a name of its attempt and then moved to the name of its task, so a task that runs
    again, or twice, leaves one whole archive. This runs at once.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        context, made = TaskContext.get(), []

        def flush(records: list[bytes]) -> None:
            name = posixpath.join(root, f"part-{context.partitionId():05d}-{len(made):05d}.warc.zst")
            draft = posixpath.join(root, f"_draft-{context.taskAttemptId()}-{len(made)}")
            data = pack(records)
            with fs.open_output_stream(draft) as out:
                out.write(data)
            fs.move(draft, name)
            made.append((name, len(records), sum(map(len, records)), len(data)))

        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("record_id", "uri", "payload", "refers_to")), strict=True):
                rid, uri, payload, refers = (x.as_py() for x in row)
                held.append(record(rid, uri, payload, refers, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    flush(held)
                    held, size = [], 0
        if held:
            flush(held)
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["path", "records", "raw_bytes", "stored_bytes"])

    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
    return stage_table(df.select("record_id", "uri", "payload", "refers_to").mapInArrow(write, WRITTEN), "warc-written")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record of the archives under ``path``. Payloads of responses are held against their digest.

    ``payload_bytes`` is the full payload's size for revisits too; their ``payload`` is null, as it is for all
    records without ``payloads``.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "target_uri", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

        for batch in batches:
            for archive in batch.column("content"):
                rows, size = [], 0
                for fields, block in unpack(archive.as_buffer().to_pybytes()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    found = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    whole = fields["WARC-Type"] == "response"
                    if whole and (len(payload) != length or digest(payload) != found):
                        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what was written")
                    refers = fields.get("WARC-Refers-To")
                    rows.append((fields["WARC-Record-ID"][1:-1], fields["WARC-Target-URI"], fields["WARC-Type"], refers and refers[1:-1], found, length, payload if whole and payloads else None))
                    size += len(block) if payloads else 0
                    if len(rows) >= 20_000 or size >= 16 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    return files.select("content").mapInArrow(read, READ)


def archive_pages(df: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write ``df`` (null html: empty payload) as archives with revisits; one row per archive."""
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("uri"), text_bytes(html).alias("payload"))
    planned = plan_revisits(rows, "k", "payload", min_bytes)
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    refers = F.when(F.col("first_id").isNotNull(), name(F.col("first_id")))
    return write_archives(planned.select(name(F.col("k")).alias("record_id"), "uri", "payload", refers.alias("refers_to")), path)


def query(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    number = lambda c: F.expr(f"CASE WHEN {c} <> 'urn:page:' THEN cast(substring({c}, 10) AS bigint) END")
    return read_archives(spark, path, payloads=False).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS hex, min(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NULL OR page_id > first THEN CASE WHEN first IS NULL THEN 'response' ELSE 'revisit' END ELSE 'response' END AS record_type,
  CASE WHEN page_id IS NULL OR page_id > first THEN first END AS refers_to
FROM h
"""
