"""Media columns: bytes carried in, and read back from, an MPEG-1 Layer III elementary stream.

``encode_mpeg`` stores each payload in the ancillary bytes of silent frames (part2_3_length 0, so a
decoder plays silence and skips them), with an ID3v2 tag, an ID3v1 tag, a Xing table in the first
frame and a CRC in every frame.  ``decode_mpeg`` knows nothing of the encoder: it parses ID3 tags of
versions 1 and 2.2 to 2.4, hunts for frame headers of MPEG-1, 2 and 2.5, Layers I to III, resynchronises after
foreign bytes, reads Xing or VBRI tables, verifies the checksums and yields exact durations and the byte offset of
every frame.  A header counts if its checksum holds, or its frame ends with the audio or at a header of the same
version, layer and sampling rate.  Checksums of Layer II (they cover tables of bit allocation) are counted as
``unverified``; frames of free format are skipped as foreign bytes.

Defined cases: a null or empty text is 64 zero bytes; equal texts give equal streams; a stream with
no frame decodes to an empty payload with zero frames; a null stream decodes like an empty one;
rows are independent, so ties, repeated rows and null ids pass through unchanged; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table

# Fixed values of MPEG audio: kbit/s by version (MPEG-1 or not), layer and index, Hz by version and index.
KBITS_V1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
KBITS_V2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
KBITS = {
    (True, 1): tuple(range(0, 449, 32)), (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), (True, 3): KBITS_V1,
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), (False, 2): KBITS_V2, (False, 3): KBITS_V2,
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
RATE_INDEX, HZ = 2, 32000
SIDE_MONO, HEAD, CRC = 17, 4, 2
XING_BYTES = 120

ENCODED = "doc_id long, n_bytes long, media binary"
DECODED = (
    "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, n_frames long, "
    "n_samples long, duration_us long, frame_offsets array<long>, bitrates array<int>, bad_checksums long, unverified long, "
    "skipped_bytes long, table_kind string, table_agrees boolean, tags map<string,string>"
)


def frame_bytes(kbits: int, hertz: int, padding: int = 0, v1: bool = True) -> int:
    return (144 if v1 else 72) * kbits * 1000 // hertz + padding


def _crc16_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC16 = _crc16_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """The checksum of a frame: the last two header bytes, then the side information."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC16[c >> 8 ^ b]
    return c


@lru_cache(maxsize=64)
def _head(rate: int) -> bytes:
    """Header, checksum and silent side information of a mono MPEG-1 Layer III frame."""
    head = bytes((0xFF, 0xFA, rate << 4 | RATE_INDEX << 2, 0xC0))
    side = bytes(SIDE_MONO)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side


_OVERHEAD = HEAD + CRC + SIDE_MONO
_ROOM = [0] + [frame_bytes(k, HZ) - _OVERHEAD for k in KBITS_V1[1:]]


def _id3v2(fields: dict[str, str]) -> bytes:
    body = b""
    for key, value in fields.items():
        data = b"\x03" + key.encode() + b"\0" + value.encode()
        body += b"TXXX" + _synchsafe(len(data)) + b"\0\0" + data
    return b"ID3\x04\0\0" + _synchsafe(len(body)) + body


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def build_stream(payload: bytes) -> bytes:
    """A whole MPEG stream that carries ``payload``; the last frame takes the least bitrate with room enough."""
    full, rest = divmod(len(payload), _ROOM[-1])
    rates = [len(KBITS_V1) - 1] * full
    if rest:
        rates.append(next(i for i in range(1, len(KBITS_V1)) if _ROOM[i] >= rest))
    info_rate = next(i for i in range(1, len(KBITS_V1)) if _ROOM[i] >= XING_BYTES)
    info_size = frame_bytes(KBITS_V1[info_rate], HZ)
    sizes = [info_size] + [frame_bytes(KBITS_V1[r], HZ) for r in rates]
    total = sum(sizes)
    starts, at = [], 0
    for s in sizes:
        starts.append(at)
        at += s
    n = len(sizes)
    toc = bytes(min(255, 256 * starts[min(n - 1, p * n // 100)] // total) for p in range(100))
    xing = b"Xing" + struct.pack(">III", 0xF, n, total) + toc + struct.pack(">I", 100)
    out = [_id3v2({"payload_bytes": str(len(payload))}), (_head(info_rate) + xing).ljust(info_size, b"\0")]
    room = _ROOM[-1]
    for i, rate in enumerate(rates):
        out.append((_head(rate) + payload[i * room : i * room + _ROOM[rate]]).ljust(sizes[i + 1], b"\0"))
    out.append((b"TAG" + b"payload").ljust(128, b"\0"))
    return b"".join(out)


class Header(NamedTuple):
    """What a frame header says; ``side`` is the bytes after header and checksum that the checksum covers, -1 if unknown."""

    size: int
    kbits: int
    hertz: int
    samples: int
    side: int
    layer: int


def parse_header(data: bytes, at: int) -> Header | None:
    """The frame header at ``at``, or None."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer, b2, b3 = data[at + 1] >> 3 & 3, 4 - (data[at + 1] >> 1 & 3), data[at + 2], data[at + 3]
    if version == 1 or layer == 4 or b2 >> 4 in (0, 15) or b2 >> 2 & 3 == 3 or b3 & 3 == 2:
        return None
    v1, mono, padding = version == 3, b3 >> 6 == 3, b2 >> 1 & 1
    kbits, hertz = KBITS[v1, layer][b2 >> 4], HERTZ[version][b2 >> 2 & 3]
    if layer == 1:
        shared = 4 * (1 + (b3 >> 4 & 3)) if b3 >> 6 == 1 else 32  # sub-bands from here on have one allocation for both channels
        return Header(4 * (12 * kbits * 1000 // hertz + padding), kbits, hertz, 384, 16 if mono else (32 + shared) // 2, 1)
    if layer == 2:
        return Header(frame_bytes(kbits, hertz, padding), kbits, hertz, 1152, -1, 2)
    side = (17 if mono else 32) if v1 else (9 if mono else 17)
    return Header(frame_bytes(kbits, hertz, padding, v1), kbits, hertz, 1152 if v1 else 576, side, 3)


def _checked(data: bytes, at: int, side: int) -> bool:
    """Whether the frame at ``at`` has a checksum that can be verified, and it holds."""
    body = at + HEAD + CRC
    return side >= 0 and not data[at + 1] & 1 and crc16(data[at + 2 : at + 4] + data[body : body + side]) == int.from_bytes(data[body - 2 : body], "big")


def _alike(data: bytes, at: int, after: int) -> bool:
    """Whether a header of the same version, layer and sampling rate stands at ``after``."""
    return parse_header(data, after) is not None and not ((data[at + 1] ^ data[after + 1]) & 0x1E or (data[at + 2] ^ data[after + 2]) & 0x0C)


def _seven(data: bytes) -> int:
    """A big-endian number of seven bits a byte."""
    return sum((b & 0x7F) << 7 * k for k, b in enumerate(reversed(data)))


def _tag_text(body: bytes) -> list[str]:
    """The strings of a text frame by its encoding byte."""
    kind, raw = (body[0], body[1:]) if body else (3, b"")
    names = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}
    return [x.lstrip("\ufeff") for x in raw.decode(names.get(kind, "latin-1"), "replace").split("\0")]


def _tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """Fields of the tags, and where the audio begins and ends."""
    tags, begin, end = {}, 0, len(data)
    if data[:3] == b"ID3" and len(data) >= 10 and data[3] in (2, 3, 4):
        version, flags = data[3], data[5]
        begin = min(len(data), 10 + _seven(data[6:10]) + 10 * bool(version == 4 and flags & 0x10))
        tag = data[10 : min(len(data), 10 + _seven(data[6:10]))]
        tag = tag.replace(b"\xff\0", b"\xff") if flags & 0x80 else tag
        number = _seven if version == 4 else lambda b: int.from_bytes(b, "big")
        at = 0
        if version > 2 and flags & 0x40:  # an extended header, whose size counts itself in version 4 only
            at = number(tag[:4]) + 4 * (version == 3)
        wide, head = (3, 6) if version == 2 else (4, 10)
        while at + head <= len(tag) and tag[at : at + wide].strip(b"\0"):
            key, n = tag[at : at + wide].decode("latin-1"), number(tag[at + wide : at + 2 * wide])
            own = _tag_text(tag[at + head : at + head + n])
            if key in ("TXX", "TXXX"):
                tags[own[0]] = own[1] if len(own) > 1 else ""
            else:
                tags[key] = own[0]
            at += head + n
    if end - begin >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags["id3v1_title"] = data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    return tags, begin, end


def parse_stream(data: bytes) -> dict:
    """Everything the stream says, with the ancillary bytes of its Layer III frames as payload."""
    tags, at, end = _tags(data)
    offsets, rates, chunks = [], [], []
    samples = micros = bad = unverified = skipped = 0
    kind, told = "none", None
    while at + 4 <= end:
        head = parse_header(data, at)
        after = at + head.size if head else 0
        if not head or after > end or not (after == end or _alike(data, at, after) or _checked(data, at, head.side)):
            following = data.find(b"\xff", at + 1, end)
            skipped += (following if following >= 0 else end) - at
            at = following if following >= 0 else end
            continue
        guarded = not data[at + 1] & 1
        unverified += guarded and head.side < 0
        bad += guarded and head.side >= 0 and not _checked(data, at, head.side)
        main = at + HEAD + CRC * guarded + max(0, head.side)
        offsets.append(at)
        rates.append(head.kbits)
        samples += head.samples
        micros += head.samples * 1_000_000 * 441 // head.hertz  # in 1/441 us, exact for every rate
        if len(offsets) == 1 and head.layer == 3 and data[main : main + 4] in (b"Xing", b"Info"):
            kind = data[main : main + 4].decode().lower()
            flags = int.from_bytes(data[main + 4 : main + 8], "big")
            if flags & 3 == 3:
                told = struct.unpack(">II", data[main + 8 : main + 16])
        elif len(offsets) == 1 and data[at + 36 : at + 40] == b"VBRI":
            kind = "vbri"
            nbytes, frames = struct.unpack(">II", data[at + 46 : at + 54])
            told = (frames, nbytes)
        elif head.layer == 3:
            chunks.append(data[main:after])
        at = after
    skipped += max(0, end - at) if at + 4 > end else 0
    payload = b"".join(chunks)
    if tags.get("payload_bytes", "").isdigit():
        payload = payload[: int(tags["payload_bytes"])]
    first = offsets[0] if offsets else 0
    agrees = told == (len(offsets), end - first) if told else None
    return {
        "payload": payload, "n_frames": len(offsets), "n_samples": samples, "duration_us": micros // 441,
        "frame_offsets": offsets, "bitrates": rates, "bad_checksums": bad, "unverified": unverified, "skipped_bytes": skipped,
        "table_kind": kind, "table_agrees": agrees, "tags": tags,
    }


def pad64(raw: bytes) -> bytes:
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def encode_mpeg(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` to ``(doc_id, n_bytes, media)``: one stream per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            raw = [(t or "").encode() for t in part.column(1).to_pylist()]
            media = [build_stream(pad64(b)) for b in raw]
            yield pa.record_batch([part.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ENCODED)


def decode_mpeg(media: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)`` to the payload and everything the stream says of itself."""
    fields = [(f.split()[0], f.split()[1]) for f in DECODED.replace("map<string,string>", "map").split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "map": pa.map_(pa.string(), pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            streams = [m or b"" for m in part.column(2).to_pylist()]
            rows = [parse_stream(m) for m in streams]
            for r, m in zip(rows, streams, strict=True):
                r |= {"media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest(), "tags": list(r["tags"].items())}
            given = {"doc_id": part.column(0), "n_bytes": part.column(1)}
            yield pa.record_batch([given[n] if n in given else pa.array([r[n] for r in rows], kinds[k]) for n, k in fields], names=[n for n, _ in fields])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DECODED)


def op7_media(spark, sf_dir: str) -> DataFrame:
    """Every document through an MPEG stream and back; the digests are of the bytes read back."""
    read = decode_mpeg(encode_mpeg(table(spark, sf_dir, "documents")))
    return read.select(
        "doc_id", "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        "media_bytes", "media_sha256",
        F.concat_ws(
            ";", F.lit("mpeg1-layer3"), F.concat(F.lit("frames="), "n_frames"), F.concat(F.lit("us="), "duration_us"),
            F.concat(F.lit("table="), "table_kind", F.lit("/"), F.col("table_agrees").cast("string")),
            F.concat(F.lit("bad="), "bad_checksums"), F.concat(F.lit("skipped="), "skipped_bytes"),
            F.concat(F.lit("last_seek="), F.element_at("frame_offsets", -1)),
        ).alias("feature"),
        "n_frames", "duration_us", "frame_offsets",
    )


def tail_crc32(payload: bytes) -> int:
    return zlib.crc32(payload[-64:])
