"""Readers of coded frames and audio packets: IVF and Ogg files, one row per file in, one per packet out."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession

from .meshes import _decode


def ivf_frames(content: bytes) -> dict:
    """Frames after the 32-byte header; a tail that is cut off ends the file."""
    if content[:4] != b"DKIF":
        raise ValueError("not an IVF file")
    at, pts, data = struct.unpack_from("<H", content, 6)[0], [], []
    while at + 12 <= len(content):
        size, ts = struct.unpack_from("<IQ", content, at)
        if at + 12 + size > len(content):
            break
        pts.append(ts)
        data.append(content[at + 12 : at + 12 + size])
        at += 12 + size
    return {"frame": list(range(len(pts))), "pts": pts, "data": data}


def scan_ivf(spark: SparkSession, path: str) -> DataFrame:
    return _decode(spark, path, "path string, frame long, pts long, data binary", ivf_frames)


def ogg_packets(content: bytes) -> dict:
    """Packets of each logical stream, across pages and segments of 255 bytes."""
    at, open_, out = 0, {}, []
    while at + 27 <= len(content):
        if content[at : at + 4] != b"OggS":
            raise ValueError(f"no Ogg page at {at}")
        serial, segments = struct.unpack_from("<I", content, at + 14)[0], content[at + 26]
        sizes = content[at + 27 : at + 27 + segments]
        at += 27 + segments
        if at + sum(sizes) > len(content):
            break
        for n in sizes:
            open_[serial] = open_.get(serial, b"") + content[at : at + n]
            at += n
            if n < 255:
                out.append((serial, open_.pop(serial)))
    number: dict[int, int] = {}
    rows = []
    for serial, data in out:
        rows.append((serial, number.get(serial, 0), data))
        number[serial] = number.get(serial, 0) + 1
    return {k: [r[i] for r in rows] for i, k in enumerate(("serial", "packet", "data"))}


def scan_ogg(spark: SparkSession, path: str) -> DataFrame:
    return _decode(spark, path, "path string, serial long, packet long, data binary", ogg_packets)
