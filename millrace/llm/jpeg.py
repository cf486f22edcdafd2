"""Operator 6, media columns in baseline JPEG.

Reading: markers are parsed, scans Huffman-decoded and DC-only luminance thumbnails rebuilt, in numpy; restart
intervals, of one image or of many with the same tables, are decoded side by side. Writing: a payload becomes the
thumbnail of a grey image, one flat 8x8 block a byte, so that the DC-only thumbnail gives the payload back exactly.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import stage_table, text_bytes

UNIT = 576
INTERVAL = 96  # blocks between restart markers
NARROW, WIDE = 24, 576  # blocks in a row
MAX_ROWS = 8191  # of blocks: a JPEG has at most 65,535 lines
CHUNK = 2 << 20  # payload bytes taken side by side


# ---------------------------------------------------------------- writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int, cols: int) -> bytes:
    """All steps of quantisation are 8, so a DC coefficient is a block's mean less 128. A DC code has 15 bits less those
    of its difference, so that with the end of block, one bit, every block has 16."""
    return b"".join([
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0" + struct.pack(">HBHHBB", 0x0102, 0, 1, 1, 0, 0)),
        _segment(0xDB, bytes([0]) + bytes([8] * 64)),
        _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, cols * 8, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, bytes([0x00, *[0] * 6, *[1] * 9, 0, *range(8, -1, -1)])),
        _segment(0xC4, bytes([0x10, 1, *[0] * 15, 0])),
        _segment(0xDD, struct.pack(">H", INTERVAL)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference from -255: the block's bits (DC code, difference, end of block) and their number."""
    diff = np.arange(-255, 256)
    size = np.array([int(abs(x)).bit_length() for x in diff])
    extra = np.where(diff >= 0, diff, diff + (1 << size) - 1)
    code = (1 << (9 - size)) - 2  # the codes of one more bit each, from a single one of seven
    return (((code << size) | extra) << 1).astype(np.uint64), np.full(len(diff), 16, np.uint64)


_CODE, _BITS = _block_codes()


def _unaligned(buf: np.ndarray) -> np.ndarray:
    """The big-endian 64-bit numbers that start at each byte; the buffer needs 8 more bytes at its end."""
    return np.lib.stride_tricks.as_strided(buf[:8].view(">u8"), (len(buf) - 8,), (1,))


def encode_frames(payloads: list[bytes]) -> list[bytes]:
    """A media value for each payload (a positive multiple of 576 bytes): JPEG images, one after the other."""
    frames: list[tuple[int, int, int]] = []  # payload, rows, columns
    for k, p in enumerate(payloads):
        if len(p) <= NARROW * MAX_ROWS:
            frames.append((k, len(p) // NARROW, NARROW))
        else:
            rows = len(p) // WIDE
            frames += [(k, min(MAX_ROWS, rows - at), WIDE) for at in range(0, rows, MAX_ROWS)]
    value = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, INTERVAL).astype(np.int16)
    diff = value.copy()
    diff[:, 1:] -= value[:, :-1]
    diff[:, 0] -= 128
    code, bits = _CODE[diff + 255], _BITS[diff + 255]
    for _ in range(2):  # four blocks to a word
        code = (code[:, ::2] << bits[:, 1::2]) | code[:, 1::2]
        bits = bits[:, ::2] + bits[:, 1::2]
    n, groups = code.shape
    room = 2 * INTERVAL + 8
    buf = np.zeros(n * room + 8, np.uint8)
    words, at = _unaligned(buf), np.arange(n, dtype=np.uint64) * np.uint64(room * 8)
    start = at.copy()
    for g in range(groups):
        words[at >> np.uint64(3)] |= (code[:, g] << (np.uint64(64) - bits[:, g] - (at & np.uint64(7)))).astype(">u8")
        at += bits[:, g]
    spare = (np.uint64(8) - (at & np.uint64(7))) & np.uint64(7)  # the last byte is filled with ones
    last = ((at + spare) >> np.uint64(3)).astype(np.int64) - 1
    buf[last] |= ((1 << spare.astype(np.int64)) - 1).astype(np.uint8)
    length = last + 1 - (start >> np.uint64(3)).astype(np.int64)
    grid = buf[: n * room].reshape(n, room)
    inside = np.arange(room) < length[:, None]
    data = grid[inside]
    step = 1 + (data == 0xFF)
    ends = np.cumsum(length)
    step[ends - 1] += 2  # the marker behind each interval
    behind = np.cumsum(step)
    out = np.zeros(int(behind[-1]), np.uint8)
    out[behind - step] = data
    marker = behind[ends - 1]
    out[marker - 2] = 0xFF
    per_frame = np.array([rows * cols // INTERVAL for _, rows, cols in frames])
    stops = np.cumsum(per_frame)
    number = np.arange(n) - np.repeat(stops - per_frame, per_frame)
    out[marker - 1] = 0xD0 + number % 8
    out[marker[stops - 1] - 1] = 0xD9
    raw, media = out.tobytes(), [b""] * len(payloads)
    begin = 0
    for (k, rows, cols), stop in zip(frames, marker[stops - 1].tolist(), strict=True):
        media[k] += _header(rows, cols) + raw[begin:stop]
        begin = stop
    return media


# ---------------------------------------------------------------- reading


@dataclass
class Frame:
    """What the markers of one image say; ``scan`` is where its entropy-coded data lie."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantisation table
    quant: dict[int, int] = field(default_factory=dict)  # the DC step
    huffman: dict[int, bytes] = field(default_factory=dict)
    restart: int = 0
    tables: list[tuple[int, int]] = field(default_factory=list)  # DC and AC table of each component
    scan: tuple[int, int] = (0, 0)

    def layout(self) -> tuple:
        return tuple(self.components), tuple(sorted(self.quant.items())), tuple(sorted(self.huffman.items())), self.restart, tuple(self.tables)


def parse_frames(media: bytes) -> list[Frame]:
    """The images of a media value, one after the other. Only baseline, with all components in one scan."""
    raw = np.frombuffer(media, np.uint8)
    marks = np.flatnonzero(raw[:-1] == 0xFF)
    kind = raw[marks + 1]
    ends = marks[(kind != 0) & ((kind < 0xD0) | (kind > 0xD7)) & (kind != 0xFF)]
    found, at = [], 0
    while at < len(media):
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError(f"no JPEG image at byte {at}")
        frame, at = Frame(), at + 2
        while True:
            while media[at + 1] == 0xFF:
                at += 1
            marker = media[at + 1]
            if marker == 0xD9:
                at += 2
                break
            size = int.from_bytes(media[at + 2 : at + 4])
            body = media[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xC0:
                _, frame.height, frame.width, n = struct.unpack_from(">BHHB", body)
                frame.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only baseline JPEG can be read")
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    frame.huffman[body[0]], body = body[1:n], body[n:]
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    frame.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide])
                    body = body[65 + 64 * wide :]
            elif marker == 0xDD:
                frame.restart = int.from_bytes(body)
            elif marker == 0xDA:
                if body[0] != len(frame.components):
                    raise ValueError("only scans of all components can be read")
                chosen = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
                frame.tables = [chosen[c[0]] for c in frame.components]
                stop = ends[np.searchsorted(ends, at)]
                frame.scan, at = (at, int(stop)), int(stop)
        found.append(frame)
    return found


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits ahead: the symbol, and in the high byte the length of its code (0: no code)."""
    out, code, k = np.zeros(1 << 16, np.int32), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            at = code << (16 - length)
            out[at : at + (1 << (16 - length))] = length << 8 | table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


_HALF = np.array([0] + [1 << (s - 1) for s in range(1, 17)], np.int64)
_FULL = np.array([(1 << s) - 1 for s in range(17)], np.int64)


def _decode_dc(data: np.ndarray, starts: np.ndarray, blocks: np.ndarray, order: list[int], tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """DC coefficients of every lane (an interval of ``blocks`` blocks whose bits start at byte ``starts``)."""
    words, u = _unaligned(data), np.uint64
    pos = starts.astype(np.uint64) << u(3)
    last = u((len(data) - 8) * 8 - 1)
    most = int(blocks.max(initial=0))
    out = np.zeros((most, len(starts)), np.int64)
    before = np.zeros((max(order) + 1, len(starts)), np.int64)
    even = bool((blocks == most).all())
    for b in range(most):
        lanes = slice(None) if even else np.flatnonzero(blocks > b)
        part = order[b % len(order)]
        dc, ac = tables[part]
        at = pos[lanes]
        window = words[np.minimum(at, last) >> u(3)].astype(np.uint64) << (at & u(7))
        found = dc[window >> u(48)]
        length, size = (found >> 8).astype(np.uint64), found & 255
        if not length.all() or size.max(initial=0) > 11:
            raise ValueError("the scan has a code that its table lacks")
        window <<= length
        extra = ((window >> u(1)) >> (u(63) - size.astype(np.uint64))).astype(np.int64)
        before[part, lanes] += extra - np.where(extra < _HALF[size], _FULL[size], 0)
        out[b, lanes] = before[part, lanes]
        window <<= size.astype(np.uint64)
        at = at + length + size.astype(np.uint64)
        found = ac[window >> u(48)]
        at += (found >> 8).astype(np.uint64)
        pos[lanes] = at
        open_ = np.flatnonzero((found & 255) != 0)  # lanes with AC coefficients, which are only stepped over
        if len(open_):
            which = open_ if even else lanes[open_]
            sym = found[open_] & 255
            k = np.ones(len(which), np.int64)
            while len(which):
                pos[which] += (sym & 15).astype(np.uint64)
                k += (sym >> 4) + 1
                more = (sym != 0) & (k < 64)
                which, k = which[more], k[more]
                at = pos[which]
                window = words[np.minimum(at, last) >> u(3)].astype(np.uint64) << (at & u(7))
                found = ac[window >> u(48)]
                if not (found >> 8).all():
                    raise ValueError("the scan has a code that its table lacks")
                pos[which] = at + (found >> 8).astype(np.uint64)
                sym = found & 255
                ended = sym == 0
                which, k, sym = which[~ended], k[~ended], sym[~ended]
    return out


def thumbnails(medias: list[bytes]) -> list[list[np.ndarray]]:
    """The DC-only luminance thumbnails (8-bit, a pixel for each block) of the images of each media value."""
    by_layout: dict[tuple, list[tuple[int, int, Frame]]] = defaultdict(list)
    out: list[list] = []
    for m, media in enumerate(medias):
        frames = parse_frames(media)
        out.append([None] * len(frames))
        for f, frame in enumerate(frames):
            by_layout[frame.layout()].append((m, f, frame))
    for group in by_layout.values():
        frame = group[0][2]
        scans = [np.frombuffer(medias[m], np.uint8)[f.scan[0] : f.scan[1]] for m, _, f in group]
        sizes = np.array([len(s) for s in scans])
        data = np.concatenate([*scans, np.zeros(1, np.uint8)])
        first = np.cumsum(sizes) - sizes
        marks = np.flatnonzero(data[:-1] == 0xFF)
        kind = data[marks + 1]
        resets = marks[(kind >= 0xD0) & (kind <= 0xD7)]
        keep = np.ones(len(data), bool)
        keep[marks[kind == 0] + 1] = False
        keep[resets] = keep[resets + 1] = False
        begins = np.sort(np.concatenate([first, resets + 2]))
        starts = (np.cumsum(keep) - keep)[begins]
        data = np.concatenate([data[keep], np.zeros(16, np.uint8)])
        hs, vs = [c[1] for c in frame.components], [c[2] for c in frame.components]
        single = len(frame.components) == 1  # then a unit is one block, whatever its sampling
        order = [0] if single else [i for i, (h, v) in enumerate(zip(hs, vs, strict=True)) for _ in range(h * v)]
        h0, v0 = (1, 1) if single else (hs[0], vs[0])
        wide, high = (8, 8) if single else (8 * max(hs), 8 * max(vs))
        units = [(-(-f.width // wide), -(-f.height // high)) for _, _, f in group]
        lanes_of = [-(-w * h // frame.restart) if frame.restart else 1 for w, h in units]
        blocks = np.concatenate([np.minimum(np.arange(1, n + 1) * (frame.restart or w * h), w * h) - np.arange(n) * (frame.restart or w * h) for n, (w, h) in zip(lanes_of, units, strict=True)]) * len(order)
        if len(blocks) != len(starts):
            raise ValueError("an image has not as many restart intervals as it should")
        lut = {k: _lookup(t) for k, t in frame.huffman.items()}
        dc = _decode_dc(data, starts, blocks, order, [(lut[d], lut[16 | a]) for d, a in frame.tables])
        step = frame.quant[frame.components[0][3]]
        pixel = np.clip((dc * step + 4) // 8 + 128, 0, 255).astype(np.uint8)
        luma = [b for b in range(len(pixel)) if order[b % len(order)] == 0]
        pixel = np.ascontiguousarray(pixel[luma].T)
        lane = 0
        for (m, f, fr), n, (w, h) in zip(group, lanes_of, units, strict=True):
            own = pixel[lane : lane + n].reshape(-1)[: w * h * h0 * v0]
            own = own.reshape(h, w, v0, h0).transpose(0, 2, 1, 3).reshape(h * v0, w * h0)
            out[m][f] = own[: -(-fr.height // 8), : -(-fr.width // 8)]
            lane += n
    return out


def _shrink(image: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Means over an even grid."""
    y, x = (np.arange(n) * s // n for n, s in ((rows, image.shape[0]), (cols, image.shape[1])))
    sums = np.add.reduceat(np.add.reduceat(image.astype(np.int64), y, 0), x, 1)
    count = np.outer(np.diff([*y, image.shape[0]]), np.diff([*x, image.shape[1]]))
    return sums / np.maximum(count, 1)


def _pack(bits: np.ndarray) -> str:
    return np.packbits(bits.reshape(-1)).tobytes().hex()


def feature(images: list[np.ndarray]) -> str:
    """``widthxheight:average hash:difference hash`` in pixels, for each image."""
    said = []
    for image in images:
        small, next_to = _shrink(image, 8, 8), _shrink(image, 8, 9)
        said.append(f"{image.shape[1] * 8}x{image.shape[0] * 8}:{_pack(small > small.mean())}:{_pack(next_to[:, 1:] > next_to[:, :-1])}")
    return ",".join(said)


# ---------------------------------------------------------------- columns


def _chunks(values: list[bytes]) -> Iterator[slice]:
    start = size = 0
    for k, v in enumerate(values):
        if size and size + len(v) > CHUNK:
            yield slice(start, k)
            start, size = k, 0
        size += len(v)
    if len(values) > start:
        yield slice(start, len(values))


def with_media(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """``keep`` as struct ``row``, ``n_bytes`` and the column ``media`` for the binary column ``payload``.

    The payload is filled with bytes 255 up to a positive multiple of 576; a null payload is empty. The last bytes
    can't be told from filling without ``n_bytes``.
    """
    picked = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(payload, F.lit(b"")).alias("payload"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("payload").to_pylist()
            for part in _chunks(raw):
                full = [p + b"\xff" * (max(1, -(-len(p) // UNIT)) * UNIT - len(p)) for p in raw[part]]
                rows = batch.column("row")[part.start : part.stop]
                yield pa.RecordBatch.from_arrays([rows, pa.array([len(p) for p in raw[part]], pa.int64()), pa.array(encode_frames(full), pa.binary())], ["row", "n_bytes", "media"])

    schema = T.StructType([picked.schema["row"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return picked.mapInArrow(write, schema)


def read_media(df: DataFrame, media: str = "media", keep: tuple[str, ...] = (), digests: bool = False) -> DataFrame:
    """``keep`` with what the media column holds: ``payload`` (or its digests), sizes, and ``feature``."""
    if digests:
        out = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    else:
        out, kinds = "payload binary, media_bytes long, feature string", [pa.binary(), pa.int64(), pa.string()]
    picked = df.select(*keep, F.col(media).alias("media"))
    schema = T.StructType([*picked.schema.fields[:-1], *T._parse_datatype_string(out).fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("media").to_pylist()
            for part in _chunks(raw):
                columns: list[list] = [[] for _ in kinds]
                for stored, images in zip(raw[part], thumbnails(raw[part]), strict=True):
                    payload = b"".join(i.tobytes() for i in images)
                    size, said = len(stored), feature(images)
                    row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), size, hashlib.sha256(stored).hexdigest(), said) if digests else (payload, size, said)
                    for column, x in zip(columns, row, strict=True):
                        column.append(x)
                kept = [batch.column(c)[part.start : part.stop] for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, columns, kinds)], schema.names)

    return picked.mapInArrow(read, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """The media column is written as Parquet and what is returned is read from there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text_bytes("text").alias("payload"))
    stored = stage_table(with_media(docs, "payload", ["doc_id"]), "media", codec="zstd")
    read = read_media(stored, keep=("row", "n_bytes"), digests=True)
    return read.select("row.doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
