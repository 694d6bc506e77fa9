"""The frame container's structural parts: header, superblock, index, tracks, chunks and blocks.

Little-endian throughout; the four magic bytes of the header are a parameter. Block payloads are opaque here: this engine
keeps columns in Parquet and doesn't reproduce third-party mesh or video codecs.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MAGIC, CHUNK_MAGIC = b"FLM0", b"CNK0"
# The record layouts.
HEADER = struct.Struct("<4sBBH4BfIQ4QI")
SUPER = struct.Struct("<6f4BHQIBBHHH")
GOP, CHUNK, BLOCK = struct.Struct("<QIHHQI"), struct.Struct("<4sQHH6fH"), struct.Struct("<BHII")


class Damaged(ValueError):
    """The file isn't a container, or is cut off."""


def _take(layout: struct.Struct, content: bytes, at: int) -> tuple:
    if at < 0 or at + layout.size > len(content):
        raise Damaged(f"{layout.size} bytes at {at} of {len(content)}")
    return layout.unpack_from(content, at)


def _text(content: bytes, at: int) -> tuple[str, int]:
    (n,) = _take(struct.Struct("<H"), content, at)
    if at + 2 + n > len(content):
        raise Damaged("text is cut off")
    return content[at + 2 : at + 2 + n].decode("utf-8", "replace"), at + 2 + n


def parse(content: bytes, magic: bytes = MAGIC) -> dict:
    """Header fields, meta, gops, tracks and blocks of a whole file."""
    h = _take(HEADER, content, 0)
    if h[0] != magic:
        raise Damaged("bad magic")
    if h[-1] not in (0, zlib.crc32(content[:60])):
        raise Damaged("header checksum")
    if h[1] > 0:
        raise Damaged(f"version {h[1]}")
    fps, frames, duration, super_at, gop_at, track_at, _ = h[8:15]
    s = _take(SUPER, content, super_at)
    meta, at = {}, super_at + SUPER.size
    for _ in range(s[-1]):
        key, at = _text(content, at)
        meta[key], at = _text(content, at)
    (n,) = _take(struct.Struct("<I"), content, gop_at)
    if n * GOP.size > len(content):
        raise Damaged(f"{n} groups")
    gops = [_take(GOP, content, gop_at + 4 + k * GOP.size) for k in range(n)]
    (n,) = _take(struct.Struct("<H"), content, track_at)
    tracks, at = [], track_at + 2
    for _ in range(n):
        number, kind, code, tier, size = _take(struct.Struct("<HB4sBH"), content, at)
        tracks.append((number, kind, code.decode("latin-1"), tier, content[at + 10 : at + 10 + size]))
        at += 10 + size
    blocks = []
    for start_pts, frame_start, _, _, offset, length in gops:
        c = _take(CHUNK, content, offset)
        if c[0] != CHUNK_MAGIC or offset + length > len(content):
            raise Damaged(f"no chunk at {offset}")
        for k in range(c[-1]):
            kind, track, where, size = _take(BLOCK, content, offset + CHUNK.size + k * BLOCK.size)
            if where + size > length:
                raise Damaged("block beyond its chunk")
            blocks.append((frame_start, start_pts, k, kind, track, content[offset + where : offset + where + size]))
    header = {"version": f"{h[1]}.{h[2]}", "fps": fps, "frames": frames, "duration_us": duration, "bits": s[6], "gop_length": s[10], "box": s[:6]}
    return {"header": header, "meta": meta, "gops": gops, "tracks": tracks, "blocks": blocks}


def chunk(pts: int, frames: int, box: tuple[float, ...], blocks: list[tuple[int, int, bytes]]) -> bytes:
    """A chunk of (type, track, payload) blocks."""
    at = CHUNK.size + BLOCK.size * len(blocks)
    directory = []
    for kind, track, payload in blocks:
        directory.append(BLOCK.pack(kind, track, at, len(payload)))
        at += len(payload)
    return CHUNK.pack(CHUNK_MAGIC, pts, frames, 0, *box, len(blocks)) + b"".join(directory) + b"".join(p for _, _, p in blocks)


def assemble(chunks: list[tuple[int, int, int, tuple[float, ...], bytes]], fps: float, bits: int, gop_length: int, meta: dict[str, str], tracks: list[tuple[int, int, str, int, bytes]], magic: bytes = MAGIC) -> bytes:
    """A file of chunks (start pts, first frame, frames, box, bytes), in order."""
    low = [min((c[3][k] for c in chunks), default=0.0) for k in range(3)]
    high = [max((c[3][3 + k] for c in chunks), default=0.0) for k in range(3)]
    pairs = b"".join(struct.pack("<H", len(x)) + x for kv in meta.items() for x in (t.encode() for t in kv))
    head = SUPER.pack(*low, *high, bits, 16, 0, 0, gop_length, 0, 0, 0, 0, 0, 0, len(meta)) + pairs
    listing = struct.pack("<H", len(tracks)) + b"".join(struct.pack("<HB4sBH", n, k, code.encode("latin-1"), tier, len(config)) + config for n, k, code, tier, config in tracks)
    super_at = HEADER.size
    gop_at = super_at + len(head)
    track_at = gop_at + 4 + GOP.size * len(chunks)
    first = track_at + len(listing)
    frames, at, index = sum(c[2] for c in chunks), first, []
    for pts, frame, n, _, body in chunks:
        index.append(GOP.pack(pts, frame, n, 0, at, len(body)))
        at += len(body)
    plain = HEADER.pack(magic, 0, 2, 0, 0, 0, 2, 1, fps, frames, round(frames * 1e6 / fps), super_at, gop_at, track_at, first, 0)
    return plain[:60] + struct.pack("<I", zlib.crc32(plain[:60])) + head + struct.pack("<I", len(chunks)) + b"".join(index) + listing + b"".join(c[4] for c in chunks)


BLOCK_SCHEMA = "path string, frame_start long, pts long, place long, type int, track int, data binary"


def scan_blocks(spark: SparkSession, path: str, magic: bytes = MAGIC) -> DataFrame:
    """One row per block of each container file."""
    from .meshes import _decode

    def decode(content: bytes) -> dict:
        rows = parse(content, magic)["blocks"]
        return {k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate((("frame_start", pa.int64()), ("pts", pa.int64()), ("place", pa.int64()), ("type", pa.int32()), ("track", pa.int32()), ("data", pa.binary())))}

    return _decode(spark, path, BLOCK_SCHEMA, decode)
