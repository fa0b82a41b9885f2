"""ISO media containers: build, walk and describe them without decoding what they carry.

``pack`` stores a payload as 8-bit samples in a container with full sample tables.
``describe`` walks the nested boxes of any container, decodes its sample tables and gives
codec, duration and the byte ranges of the keyframes; the media data itself is only cut
out by those tables. ``describe_media`` does that for a binary column of a table. Samples
in fragments (``moof``) are not among the tables and are not listed.

Cases: a null text counts as empty and gives one padded frame. Equal texts give equal
values; repeated rows give repeated results, empty tables none. A container that is null or
can't be read gives a null description with the reason in ``error``. Only the key and the
text or media column are read, so others may have any names. A text is held whole, some
five times over, so texts of 100 MB fit an executor of 3 GB.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches

#: Bytes of a frame, which is one sample of the tables; payloads are padded to a multiple of it.
FRAME = 192
PAD = b" "
RATE = 8000
FRAMES_PER_CHUNK = 64
KEY_INTERVAL = 16
CODEC = b"raw "
#: Boxes that hold boxes.
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"))

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_ms long, keyframes array<struct<start:long,end:long>>, error string, media binary"


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int
    offsets: list[int]
    sizes: list[int]
    keys: list[int]
    #: Runs of samples that lie side by side, as byte ranges.
    runs: list[tuple[int, int]] = field(default_factory=list)

    def keyframes(self) -> list[tuple[int, int]]:
        return [(self.offsets[k], self.offsets[k] + self.sizes[k]) for k in self.keys]


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def _full(kind: bytes, body: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, bytes([version]) + flags.to_bytes(3, "big"), body)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
_HEAD = _full(b"hdlr", struct.pack(">I", 0) + b"soun" + bytes(12) + b"payload\0")
_DINF = _box(b"dinf", _full(b"dref", struct.pack(">I", 1) + _full(b"url ", b"", flags=1)))
_STSD = _full(b"stsd", struct.pack(">I", 1) + _box(CODEC, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16)))


def padded(raw: bytes) -> bytes:
    """The bytes with spaces up to the next multiple of a frame, one frame at least."""
    return raw + PAD * (FRAME * max(1, -(-len(raw) // FRAME)) - len(raw))


def pack(payload: bytes) -> bytes:
    """A container of whole frames; every ``KEY_INTERVAL``-th one is a keyframe."""
    n = len(payload) // FRAME
    chunks = -(-n // FRAMES_PER_CHUNK)
    last = n - FRAMES_PER_CHUNK * (chunks - 1)
    layout = [(1, FRAMES_PER_CHUNK, 1)] * (chunks > 1 or last == FRAMES_PER_CHUNK) + [(chunks, last, 1)] * (last < FRAMES_PER_CHUNK)
    keys = range(1, n + 1, KEY_INTERVAL)

    def moov(first: int) -> bytes:
        offsets = [first + k * FRAME * FRAMES_PER_CHUNK for k in range(chunks)]
        stbl = _box(
            b"stbl",
            _STSD,
            _full(b"stts", struct.pack(">III", 1, n, FRAME)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(layout)) + b"".join(struct.pack(">III", *x) for x in layout)),
            _full(b"stsz", struct.pack(">II", FRAME, n)),
            _full(b"stco", struct.pack(f">I{chunks}I", chunks, *offsets)) if offsets[-1] < 1 << 32 else _full(b"co64", struct.pack(f">I{chunks}Q", chunks, *offsets)),
        )
        ticks = n * FRAME
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, ticks, 0x55C4, 0), version=1), _HEAD, _box(b"minf", _full(b"smhd", bytes(4)), _DINF, stbl))
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, ticks) + bytes(8) + struct.pack(">HHHH", 0, 0, 0x100, 0) + _MATRIX + bytes(8), version=1, flags=7)
        mvhd = _full(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, ticks, 0x10000, 0x100) + bytes(10) + _MATRIX + bytes(24) + struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    wide = len(payload) + 8 >= 1 << 32
    head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide else struct.pack(">I4s", 8 + len(payload), b"mdat")
    front = len(_FTYP) + len(moov(0)) + len(head)
    return b"".join((_FTYP, moov(front), head, payload))


def walk(buf: memoryview, start: int, end: int, path: bytes = b"") -> Iterator[tuple[bytes, int, int]]:
    """Each box as its path and the range of its body, parents first.

    Sizes of 64 bits and "to the end" are read; a box that leaves its parent is an error.
    """
    while start < end:
        if end - start < 8:
            raise ValueError("a box head is cut off")
        size, kind, head = int.from_bytes(buf[start : start + 4], "big"), bytes(buf[start + 4 : start + 8]), 8
        if size == 1:
            size, head = int.from_bytes(buf[start + 8 : start + 16], "big"), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} leaves its parent")
        here = path + b"/" + kind
        yield here, start + head, start + size
        if kind in CONTAINERS:
            yield from walk(buf, start + head, start + size, here)
        start += size


def _numbers(body: memoryview, at: int, each: str) -> list[tuple[int, ...]]:
    """The counted table that begins at ``at``."""
    count, width = int.from_bytes(body[at : at + 4], "big"), struct.calcsize(">" + each)
    if at + 4 + count * width > len(body):
        raise ValueError("a table is cut off")
    return list(struct.iter_unpack(">" + each, body[at + 4 : at + 4 + count * width]))


def describe(media: bytes) -> list[Track]:
    """The tracks of a container by its sample tables."""
    buf = memoryview(media)
    tracks: list[dict[bytes, memoryview]] = []
    for path, start, end in walk(buf, 0, len(buf)):
        if path == b"/moov/trak":
            tracks.append({})
        elif path.startswith(b"/moov/trak/"):
            tracks[-1][path.rpartition(b"/")[2]] = buf[start:end]
    return [_track(x, len(buf)) for x in tracks]


def _track(box: dict[bytes, memoryview], length: int) -> Track:
    missing = [x.decode() for x in (b"mdhd", b"stsd", b"stts", b"stsc", b"stsz") if x not in box and not (x == b"stsz" and b"stz2" in box)]
    if missing or not (b"stco" in box or b"co64" in box):
        raise ValueError(f"no {', '.join(missing) or 'chunk offsets'}")
    mdhd = box[b"mdhd"]
    timescale, duration = struct.unpack(">IQ", mdhd[20:32]) if mdhd[0] == 1 else struct.unpack(">II", mdhd[12:20])
    codec = bytes(box[b"stsd"][12:16]).decode("latin-1")
    sizes = _sizes(box, length)
    chunks = [x for (x,) in (_numbers(box[b"stco"], 4, "I") if b"stco" in box else _numbers(box[b"co64"], 4, "Q"))]
    layout = _numbers(box[b"stsc"], 4, "III")
    firsts, offsets, runs, k = [x[0] for x in layout], [], [], 0
    for number, at in enumerate(chunks, 1):
        row = bisect_right(firsts, number) - 1
        begin = at
        for _ in range(min(layout[row][1], len(sizes) - k) if row >= 0 else 0):
            offsets.append(at)
            at += sizes[k]
            k += 1
        if at > length:
            raise ValueError("a chunk leaves the file")
        if runs and runs[-1][1] == begin:
            runs[-1] = (runs[-1][0], at)
        else:
            runs.append((begin, at))
    if k != len(sizes):
        raise ValueError("samples without a chunk")
    ticks = sum(n * step for n, step in _numbers(box[b"stts"], 4, "II"))
    keys = [x - 1 for (x,) in _numbers(box[b"stss"], 4, "I")] if b"stss" in box else list(range(k))
    if keys and not 0 <= min(keys) <= max(keys) < k:
        raise ValueError("a keyframe isn't among the samples")
    return Track(codec, timescale, ticks or duration, offsets, sizes, keys, runs)


def _sizes(box: dict[bytes, memoryview], length: int) -> list[int]:
    """The samples' sizes: one for all, one each, or one each in 4, 8 or 16 bits."""
    if b"stsz" in box:
        size, count = struct.unpack(">II", box[b"stsz"][4:12])
        if size and size * count > length:
            raise ValueError("the samples are larger than the file")
        return [size] * count if size else [x for (x,) in _numbers(box[b"stsz"], 8, "I")]
    bits = box[b"stz2"][7]
    if bits in (8, 16):
        return [x for (x,) in _numbers(box[b"stz2"], 8, "B" if bits == 8 else "H")]
    count = int.from_bytes(box[b"stz2"][8:12], "big")
    pairs = bytes(box[b"stz2"][12 : 12 + (count + 1) // 2])
    if bits != 4 or len(pairs) < (count + 1) // 2:
        raise ValueError("a table is cut off")
    return [x for byte in pairs for x in (byte >> 4, byte & 15)][:count]


def feature_of(track: Track) -> str:
    """What the tables say, in one line: codec, duration, counts and the keyframes' ranges as a digest."""
    ranges = ",".join(f"{a}-{b}" for a, b in track.keyframes())
    return f"codec={track.codec.strip()};ms={track.duration * 1000 // max(track.timescale, 1)};samples={len(track.sizes)};keyframes={len(track.keys)};ranges={zlib.crc32(ranges.encode()):08x}"


def media_columns(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """Each text stored as a container, read back and described, one row for each row of ``docs``."""
    schema = SCHEMA if with_media else SCHEMA.rpartition(",")[0]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    names = names if with_media else names[:-1]

    def rows(batch: pa.RecordBatch, texts: pa.Array, at: int, until: int) -> pa.RecordBatch:
        out: dict[str, list] = {x: [] for x in names}
        for k in range(at, until):
            raw = (texts[k].as_py() or "").encode()
            media = pack(padded(raw))
            track, error, payload = None, None, b""
            try:
                track = describe(media)[0]
                payload = b"".join(media[a:b] for a, b in track.runs)
            except (ValueError, IndexError, struct.error) as e:
                error = str(e)
            row = (None, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), track and feature_of(track), track and track.codec, track and track.duration * 1000 // track.timescale, track and [{"start": a, "end": b} for a, b in track.keyframes()], error, media)
            for x, v in zip(names, row):
                out[x].append(v)
        kinds = {"keyframes": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "media": pa.binary()}
        kinds |= dict.fromkeys(("n_bytes", "payload_bytes", "tail_crc32", "media_bytes", "duration_ms"), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, until - at), *(pa.array(out[x], kinds.get(x, pa.string())) for x in names[1:])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, len(texts), 256):
                yield rows(batch, texts, at, min(at + 256, len(texts)))

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


DESCRIBED = "tracks array<struct<codec:string,duration_ms:long,samples:long,keyframes:array<struct<start:long,end:long>>>>, error string"


def describe_media(rows: DataFrame, key: str, media: str) -> DataFrame:
    """``key``, the tracks of the container in a binary column, and why it can't be read where it can't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("codec", pa.string()), ("duration_ms", pa.int64()), ("samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part, found, errors = batch.slice(at, 16), [], []
                for raw in part.column(1):
                    told, error = None, None
                    try:
                        if not raw.is_valid:
                            raise ValueError("no media")
                        told = [{"codec": t.codec.strip(), "duration_ms": t.duration * 1000 // max(t.timescale, 1), "samples": len(t.sizes), "keyframes": [{"start": a, "end": b} for a, b in t.keyframes()]} for t in describe(raw.as_buffer())]
                    except (ValueError, IndexError, struct.error) as e:
                        error = str(e)
                    found.append(told)
                    errors.append(error)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kinds), pa.array(errors, pa.string())], [key, "tracks", "error"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, media).mapInArrow(run, f"`{key}` {kind}, {DESCRIBED}")
