"""Writers of mesh, splat and packet files in which many tasks write one file.

Records of a fixed size have their place by their number. Lines, frames and packets are packed in runs; the runs' lengths are
added up without their bytes, and the runs become pieces of their file (see ``pieces``). Numbers begin at 0 without gaps in each file; a gap or a
repeated number leaves a hole or an overlap, which the commit refuses.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.encodings import SH_C0
from ..session import remove_folder, shared_folder
from .meshes import SPLAT_RECORD, _files, is_splat, ply_header
from .pieces import BYTES, PIECE, gathered, save_pieces

RUN = 4096


def _batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))], ["file", "at", "data"])


def _runs(rows: DataFrame, number: str, columns: Sequence[str | Column]) -> DataFrame:
    """(path, run, items): runs of rows in the order of their numbers."""
    # By number, as many packets may be few bytes in a shuffle.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_run", F.floor(F.col(number) / RUN)).repartition(parts, "path", "_run")
    return dealt.groupBy("path", F.col("_run").alias("run")).agg(F.array_sort(F.collect_list(F.struct(F.col(number).cast("long").alias("_k"), *columns))).alias("items"))


def _records(rows: DataFrame, number: str, columns: Sequence[str | Column], base: DataFrame, stride: int, encode: Callable[[pa.StructArray], bytes]) -> DataFrame:
    """Pieces of records of ``stride`` bytes; base: path, file and at, where a file's records begin."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                items = batch.column("items")[i].values
                numbers = items.field("_k").to_numpy()
                if (np.diff(numbers) != 1).any():
                    raise ValueError(f"{batch.column('file')[i]}: numbers {numbers[0]} to {numbers[-1]} have gaps or repeat")
                yield _batch([(batch.column("file")[i].as_py(), batch.column("at")[i].as_py() + int(numbers[0]) * stride, encode(items))])

    return _runs(rows, number, columns).join(base, "path").select("file", "at", "items").mapInArrow(gathered(work), PIECE)


def _laid_out(spark: SparkSession, runs: DataFrame, heads: DataFrame, folder: str) -> None:
    """Save files of a head and the bodies of runs (path, part, run, body) in their order; heads: path, file, head."""
    stage = shared_folder(spark, "runs")
    runs.withColumn("length", F.length("body").cast("long")).write.parquet(stage)
    try:
        kept = spark.read.parquet(stage)
        line = Window.partitionBy("path").orderBy("part", "run")
        # A row for each run, without its bytes.
        places = kept.select("path", "part", "run", "length").withColumn("at", F.sum("length").over(line) - F.col("length"))
        put = kept.select("path", "part", "run", "body").join(places.drop("length"), ["path", "part", "run"]).join(heads, "path")
        first = heads.select("file", F.lit(0).cast("long").alias("at"), F.col("head").alias("data"))
        save_pieces(first.union(put.select("file", (F.col("at") + F.length("head")).alias("at"), F.col("body").alias("data"))), folder)
    finally:
        remove_folder(spark, stage)


def _floats(items: pa.StructArray, names: Sequence[str]) -> np.ndarray:
    return np.stack([items.field(n).to_numpy(zero_copy_only=False).astype("<f4") for n in names], 1)


def _counted(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("path").agg(F.count("*").alias(name))


def write_ply_meshes(vertices: DataFrame, triangles: DataFrame, folder: str) -> None:
    """Binary PLY files ``<path>.ply`` of meshes: vertices (path, vid, x, y, z), triangles (path, tid, a, b, c)."""
    n = _counted(vertices, "n").join(_counted(triangles, "m"), "path", "left").select("path", "n", F.coalesce("m", F.lit(0)).alias("m"))
    lines = ["ply", "format binary_little_endian 1.0", "element vertex ", "property float x", "property float y", "property float z", "element face ", "property list uchar int vertex_indices", "end_header", ""]
    before, after = "\n".join(lines[:3]), "\n".join(["", *lines[3:7]])
    head = F.concat(F.lit(before), F.col("n").cast("string"), F.lit(after), F.col("m").cast("string"), F.lit("\n" + "\n".join(lines[7:])))
    file = F.concat(F.col("path"), F.lit(".ply")).alias("file")
    known = n.select("path", file, head.cast("binary").alias("head"), "n")
    base = known.select("path", "file", F.length("head").cast("long").alias("at"), "n")

    def face(items: pa.StructArray) -> bytes:
        out = np.zeros(len(items), [("k", "u1"), ("v", "<i4", 3)])
        out["k"], out["v"] = 3, np.stack([items.field(c).to_numpy(zero_copy_only=False) for c in "abc"], 1)
        return out.tobytes()

    first = known.select("file", F.lit(0).cast("long").alias("at"), F.col("head").alias("data"))
    points = _records(vertices, "vid", ["x", "y", "z"], base.drop("n"), 12, lambda items: _floats(items, "xyz").tobytes())
    faces = _records(triangles, "tid", ["a", "b", "c"], base.select("path", "file", (F.col("at") + F.col("n") * 12).alias("at")), 13, face)
    save_pieces(first.union(points).union(faces), folder)


def write_ply_splats(splats: DataFrame, folder: str, coefficients: int = 0) -> None:
    """Splat PLY files ``<path>.ply`` of splats (path and the columns of a splat scan); coefficients: of sh kept for each channel."""
    rest = [f"f_rest_{i}" for i in range(3 * coefficients)]
    names = ["x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2", *rest, "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]
    logit = lambda p: F.log(p / (1 - p))
    o = F.least(F.greatest(F.col("opacity").cast("double"), F.lit(1e-6)), F.lit(1 - 1e-6))
    stored = [F.col(c) for c in "xyz"] + [(F.col(c) - 0.5) / SH_C0 for c in "rgb"]
    # The file has channels one after the other, a scan has coefficients one after the other.
    stored += [F.element_at("sh", k * 3 + channel + 1) for channel in range(3) for k in range(coefficients)]
    stored += [logit(o)] + [F.log(F.col(c).cast("double")) for c in ("sx", "sy", "sz")] + [F.col(c) for c in ("qw", "qx", "qy", "qz")]
    before = "ply\nformat binary_little_endian 1.0\nelement vertex "
    after = "\n" + "".join(f"property float {n}\n" for n in names) + "end_header\n"
    head = F.concat(F.lit(before), F.col("n").cast("string"), F.lit(after)).cast("binary")
    known = _counted(splats, "n").select("path", F.concat(F.col("path"), F.lit(".ply")).alias("file"), head.alias("head"))
    base = known.select("path", "file", F.length("head").cast("long").alias("at"))
    records = _records(splats, "sid", [c.cast("float").alias(n) for c, n in zip(stored, names, strict=True)], base, 4 * len(names), lambda items: _floats(items, names).tobytes())
    save_pieces(known.select("file", F.lit(0).cast("long").alias("at"), F.col("head").alias("data")).union(records), folder)


def write_splats(splats: DataFrame, folder: str) -> None:
    """``<path>.splat`` files: records of position, scale, and bytes of colour, opacity and rotation."""

    def encode(items: pa.StructArray) -> bytes:
        byte = lambda v, scale, shift: np.clip(np.floor(v * scale + shift), 0, 255).astype("u1")
        out = np.zeros(len(items), SPLAT_RECORD)
        out["xyz"], out["scale"] = _floats(items, "xyz"), _floats(items, ("sx", "sy", "sz"))
        out["rgba"], out["wxyz"] = byte(_floats(items, ("r", "g", "b", "opacity")).astype(float), 255, 0.5), byte(_floats(items, ("qw", "qx", "qy", "qz")).astype(float), 128, 128.5)
        return out.tobytes()

    columns = ["x", "y", "z", "sx", "sy", "sz", "qx", "qy", "qz", "qw", "opacity", "r", "g", "b"]
    base = splats.select("path").distinct().select("path", F.concat(F.col("path"), F.lit(".splat")).alias("file"), F.lit(0).cast("long").alias("at"))
    save_pieces(_records(splats, "sid", columns, base, SPLAT_RECORD.itemsize, encode), folder)


def write_obj(vertices: DataFrame, triangles: DataFrame, folder: str) -> None:
    """OBJ files ``<path>.obj`` of meshes, vertices first."""
    line = lambda kind, *c: F.concat_ws(" ", F.lit(kind), *c)
    v = vertices.select("path", F.lit(0).alias("part"), F.col("vid").alias("at"), line("v", *(F.col(c).cast("string") for c in "xyz")).alias("line"))
    t = triangles.select("path", F.lit(1).alias("part"), F.col("tid").alias("at"), line("f", *((F.col(c) + 1).cast("string") for c in "abc")).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda s: s["line"])
    runs = v.unionByName(t).groupBy("path", "part", F.floor(F.col("at") / RUN).alias("run")).agg(F.concat(F.array_join(lines, "\n"), F.lit("\n")).cast("binary").alias("body"))
    heads = vertices.select("path").distinct().select("path", F.concat(F.col("path"), F.lit(".obj")).alias("file"), F.lit(b"# mesh\n").alias("head"))
    _laid_out(vertices.sparkSession, runs, heads, folder)


def _packed(rows: DataFrame, number: str, columns: Sequence[str], encode: Callable[[dict], bytes]) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, start, bodies = 0, 0, []
            for i, row in enumerate(batch.column("items")):
                bodies.append(b"".join(encode(r) for r in row.values.to_pylist()))
                if (size := size + len(bodies[-1])) >= BYTES or i == batch.num_rows - 1:
                    path, run = (batch.column(c).slice(start, len(bodies)) for c in ("path", "run"))
                    yield pa.RecordBatch.from_arrays([path, pa.array([0] * len(bodies), pa.int32()), run, pa.array(bodies, pa.binary())], ["path", "part", "run", "body"])
                    size, start, bodies = 0, i + 1, []

    return _runs(rows, number, columns).select("path", F.col("run").cast("long").alias("run"), "items").mapInArrow(gathered(work), "path string, part int, run long, body binary")


def write_ivf(frames: DataFrame, folder: str, code: str = "AV01", width: int = 8, height: int = 8, fps: int = 30) -> None:
    """IVF files ``<path>.ivf`` of coded frames (path, frame, pts, data)."""

    @F.udf("binary")
    def head(count: int) -> bytes:  # once for each file
        return b"DKIF" + struct.pack("<HH4sHHIIII", 0, 32, code.encode(), width, height, fps, 1, count, 0)

    runs = _packed(frames, "frame", ["pts", "data"], lambda r: struct.pack("<IQ", len(r["data"]), r["pts"]) + r["data"])
    known = _counted(frames, "n").select("path", F.concat(F.col("path"), F.lit(".ivf")).alias("file"), head("n").alias("head"))
    _laid_out(frames.sparkSession, runs, known, folder)


#: Every byte with its bits turned round.
_TURNED = bytes(int(f"{byte:08b}"[::-1], 2) for byte in range(256))


def _ogg_checksum(page: bytes) -> int:
    """The checksum with the polynomial 0x04C11DB7, high bit first, from 0: zlib's runs low bit first, over inverted sums."""
    c = zlib.crc32(page.translate(_TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_TURNED), "big")


def ogg_page(serial: int, number: int, packet: bytes, granule: int, flags: int) -> bytes:
    """A page of one packet, of at most 65,024 bytes, with its checksum."""
    full, rest = divmod(len(packet), 255)
    if full > 254:
        raise ValueError(f"a packet of {len(packet)} bytes doesn't fit in a page")
    page = b"OggS" + struct.pack("<BBqIII", 0, flags, granule, serial, number, 0) + bytes([full + 1]) + b"\xff" * full + bytes([rest]) + packet
    return page[:22] + struct.pack("<I", _ogg_checksum(page)) + page[26:]


def write_ogg(packets: DataFrame, folder: str, serial: int = 1) -> None:
    """Ogg files ``<path>.ogg`` of packets (path, packet, granule, data), a page for each."""
    last = packets.groupBy("path").agg(F.max("packet").alias("last"))
    flags = F.when(F.col("packet") == 0, 2).otherwise(0) + F.when(F.col("packet") == F.col("last"), 4).otherwise(0)
    told = packets.join(last, "path").withColumn("flags", flags)
    runs = _packed(told, "packet", ["granule", "data", "flags"], lambda r: ogg_page(serial, r["_k"], r["data"], r["granule"], r["flags"]))
    known = last.select("path", F.concat(F.col("path"), F.lit(".ogg")).alias("file"), F.lit(b"").alias("head"))
    _laid_out(packets.sparkSession, runs, known, folder)


def scan_ply_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, element, count, properties, splats) for each element of each PLY file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw = content.as_buffer().to_pybytes()
                kind, elements, _ = ply_header(raw)
                n = len(elements)
                yield pa.RecordBatch.from_pydict({
                    "path": [name] * n, "format": [kind] * n, "element": [e[0] for e in elements], "count": pa.array([e[1] for e in elements], pa.int64()),
                    "properties": pa.array([[p[0] for p in e[2]] for e in elements], pa.list_(pa.string())), "splats": [is_splat(raw)] * n,
                })

    return _files(spark, path).mapInArrow(gathered(work), "path string, format string, element string, count long, properties array<string>, splats boolean")
