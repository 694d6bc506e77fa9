"""Readers of mesh and splat files: each file is one row of Spark's binaryFile or text source.

OBJ is parsed by column expressions; binary layouts are decoded with numpy inside tasks. Input is untrusted: lengths
are checked before anything is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encodings import SH_C0
from .pieces import gathered

# PLY's scalar types, and the properties by which a splat file is known.
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2",
    "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8",
}
SPLAT_PROPERTIES = {"f_dc_0", "opacity", "scale_0", "rot_0"}
SPLAT_SCHEMA = "path string, sid long, x float, y float, z float, sx float, sy float, sz float, qx float, qy float, qz float, qw float, opacity float, r float, g float, b float, sh array<float>"
MOST = 1 << 26


def scan_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) of OBJ files: (path, vid, x, y, z) and (path, tid, a, b, c); polygons become fans.

    Indices are as in the files from 1, negative ones from the end; texture and normal indices are left out.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    words = lines.select("path", "line", F.split(F.trim("text"), r"\s+").alias("w"))
    # A line's number among its file's lines of the same kind, from the arrays' order.
    of = lambda kind: words.where(F.element_at("w", 1) == kind).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "w"))).alias("all"))
    v = of("v").select("path", F.posexplode("all").alias("vid", "e"))
    vertices = v.select("path", F.col("vid").cast("long").alias("vid"), *(F.element_at("e.w", k + 2).cast("float").alias(c) for k, c in enumerate("xyz")))
    total = vertices.groupBy("path").agg(F.count("*").alias("n"))
    f = of("f").join(total, "path")
    index = lambda x: F.split(x, "/")[0].cast("long")
    corners = F.transform(F.slice("e.w", 2, 1 << 20), lambda x: F.when(index(x) < 0, index(x) + F.col("n")).otherwise(index(x) - 1))
    faces = f.select("path", "n", F.posexplode("all").alias("face", "e")).select("path", "face", corners.alias("k")).where(F.size("k") >= 3)
    fan = F.transform(F.sequence(F.lit(2), F.size("k") - 1), lambda i: F.struct(F.col("k")[0].alias("a"), F.element_at("k", i).alias("b"), F.element_at("k", i + 1).alias("c")))
    fans = faces.groupBy("path").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("face", fan.alias("t")))), lambda s: s["t"])).alias("t"))
    triangles = fans.select("path", F.posexplode("t").alias("tid", "t")).select("path", F.col("tid").cast("long").alias("tid"), "t.a", "t.b", "t.c")
    return vertices, triangles


def ply_header(content: bytes) -> tuple[str, list[tuple[str, int, list[tuple[str, ...]]]], int]:
    """(format, elements with counts and properties, offset of the data)."""
    end = content.find(b"end_header")
    if not content.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY file")
    at = content.index(b"\n", end) + 1
    kind, elements = "", []
    for line in content[:end].decode("ascii", "replace").splitlines():
        match line.split():
            case ["format", k, *_]:
                kind = k
            case ["element", name, count]:
                if not 0 <= int(count) <= MOST:
                    raise ValueError(f"PLY: {count} {name}")
                elements.append((name, int(count), []))
            case ["property", "list", size, item, name]:
                elements[-1][2].append((name, size, item))
            case ["property", kind_, name]:
                elements[-1][2].append((name, kind_))
    if kind not in ("ascii", "binary_little_endian"):
        raise ValueError(f"PLY: format {kind} isn't supported")
    return kind, elements, at


def is_splat(content: bytes) -> bool:
    return SPLAT_PROPERTIES <= {p[0] for name, _, props in ply_header(content)[1] if name == "vertex" for p in props}


def ply_data(content: bytes, wanted: set[str]) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """(the wanted vertex properties, faces as index arrays)."""
    kind, elements, at = ply_header(content)
    if not elements or elements[0][0] != "vertex":
        raise ValueError("PLY: vertices must come first")
    _, n, props = elements[0]
    n_faces = next((c for name, c, _ in elements[1:2] if name == "face"), 0)
    if kind == "ascii":
        words = content[at:].split()
        if len(words) < n * len(props):
            raise ValueError("PLY: truncated vertex data")
        grid = np.array(words[: n * len(props)], dtype="S").reshape(n, len(props)) if n else np.zeros((0, len(props)))
        columns = {p[0]: grid[:, j].astype(np.float32) for j, p in enumerate(props) if p[0] in wanted}
        faces, k = [], n * len(props)
        for _ in range(n_faces):
            size = int(words[k])
            faces.append(np.array(words[k + 1 : k + 1 + size], dtype="S").astype(np.int64))
            k += 1 + size
        return columns, faces
    row = np.dtype([(p[0], PLY_TYPES[p[1]]) for p in props])
    if at + n * row.itemsize > len(content):
        raise ValueError("PLY: truncated vertex data")
    data = np.frombuffer(content, row, n, at)
    columns = {c: data[c].astype(np.float32) for c in row.names if c in wanted}
    faces, at = [], at + n * row.itemsize
    if n_faces:
        _, size_type, item_type = elements[1][2][0]
        size, item = np.dtype(PLY_TYPES[size_type]), np.dtype(PLY_TYPES[item_type])
        for _ in range(n_faces):
            if at + size.itemsize > len(content):
                raise ValueError("PLY: truncated faces")
            k = int(np.frombuffer(content, size, 1, at)[0])
            faces.append(np.frombuffer(content, item, k, at + size.itemsize).astype(np.int64))
            at += size.itemsize + k * item.itemsize
    return columns, faces


def _files(spark: SparkSession, path: str) -> DataFrame:
    # In no more tasks than a shuffle has, as Spark plans each short file as 4 MB.
    return spark.read.format("binaryFile").load(path).select("path", "content").coalesce(int(spark.conf.get("spark.sql.shuffle.partitions")))


def _decode(spark: SparkSession, path: str, schema: str, decode) -> DataFrame:
    """Rows that ``decode`` gives, as columns, for each file."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                columns = decode(content.as_buffer().to_pybytes())
                n = len(next(iter(columns.values())))
                yield pa.RecordBatch.from_pydict({"path": [name] * n, **columns})

    return _files(spark, path).mapInArrow(gathered(work), schema)


def scan_ply_vertices(spark: SparkSession, path: str) -> DataFrame:
    def decode(content: bytes) -> dict:
        c, _ = ply_data(content, {"x", "y", "z"})
        return {"vid": np.arange(len(c["x"])), **c}

    return _decode(spark, path, "path string, vid long, x float, y float, z float", decode)


def scan_ply_triangles(spark: SparkSession, path: str) -> DataFrame:
    def decode(content: bytes) -> dict:
        _, faces = ply_data(content, set())
        fans = [(f[0], f[i], f[i + 1]) for f in faces for i in range(1, len(f) - 1)]
        a, b, c = np.array(fans, np.int64).reshape(-1, 3).T
        return {"tid": np.arange(len(a)), "a": a, "b": b, "c": c}

    return _decode(spark, path, "path string, tid long, a long, b long, c long", decode)


def _unit(q: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(q, axis=1, keepdims=True)
    return q / np.where(n == 0, 1, n)


def _splats(xyz, scale, wxyz, opacity, rgb, sh) -> dict:
    q = _unit(wxyz.astype(np.float64)).astype(np.float32)
    named = dict(zip(("x", "y", "z", "sx", "sy", "sz", "qx", "qy", "qz", "qw"), (*xyz.T, *scale.T, q[:, 1], q[:, 2], q[:, 3], q[:, 0]), strict=True))
    named = {k: np.ascontiguousarray(v, np.float32) for k, v in named.items()}
    flat = pa.array(np.ascontiguousarray(sh, np.float32).ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(xyz) + 1, dtype=np.int32) * sh.shape[1]), flat)
    return {"sid": np.arange(len(xyz)), **named, "opacity": opacity.astype(np.float32), **{c: np.ascontiguousarray(rgb[:, k], np.float32) for k, c in enumerate("rgb")}, "sh": lists}


def decode_ply_splat(content: bytes) -> dict:
    """Activated splats: logistic opacity, exponential scale, colour of the zeroth coefficient; others coefficient-major."""
    if not is_splat(content):
        raise ValueError("PLY: not a splat file")
    names = [p[0] for p in ply_header(content)[1][0][2]]
    rest = [n for n in names if n.startswith("f_rest_")]
    per = len(rest) // 3
    kept = next(k for k in (15, 8, 3, 0) if per >= k)
    c, _ = ply_data(content, set(names))
    stack = lambda *n: np.stack([c[k] for k in n], 1)
    n = len(c["x"])
    sh = np.stack([c[f"f_rest_{ch * per + k}"] for k in range(kept) for ch in range(3)], 1) if kept else np.zeros((n, 0))
    return _splats(
        stack("x", "y", "z"), np.exp(stack("scale_0", "scale_1", "scale_2")), stack("rot_0", "rot_1", "rot_2", "rot_3"),
        1 / (1 + np.exp(-c["opacity"])), 0.5 + SH_C0 * stack("f_dc_0", "f_dc_1", "f_dc_2"), sh,
    )


def scan_ply_splats(spark: SparkSession, path: str) -> DataFrame:
    return _decode(spark, path, SPLAT_SCHEMA, decode_ply_splat)


SPLAT_RECORD = np.dtype([("xyz", "<f4", 3), ("scale", "<f4", 3), ("rgba", "u1", 4), ("wxyz", "u1", 4)])


def decode_splat(content: bytes) -> dict:
    if len(content) % SPLAT_RECORD.itemsize:
        raise ValueError(f".splat: {len(content)} bytes aren't whole records")
    d = np.frombuffer(content, SPLAT_RECORD)
    rgba = d["rgba"] / 255.0
    return _splats(d["xyz"], d["scale"], (d["wxyz"].astype(float) - 128) / 128, rgba[:, 3], rgba[:, :3], np.zeros((len(d), 0)))


def scan_splats(spark: SparkSession, path: str) -> DataFrame:
    return _decode(spark, path, SPLAT_SCHEMA, decode_splat)


def encode_splat(splats: DataFrame, order: str = "sid") -> DataFrame:
    """(path, content): .splat files of splats."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for name, members in zip(batch.column("path").to_pylist(), batch.column("m").to_pylist(), strict=True):
                d = np.zeros(len(members), SPLAT_RECORD)
                members.sort(key=lambda s: s["k"])
                for k, s in enumerate(members):
                    d[k]["xyz"], d[k]["scale"] = (s["x"], s["y"], s["z"]), (s["sx"], s["sy"], s["sz"])
                    d[k]["rgba"] = [min(255, max(0, int(v * 255 + 0.5))) for v in (s["r"], s["g"], s["b"], s["opacity"])]
                    d[k]["wxyz"] = [min(255, max(0, int(v * 128 + 128.5))) for v in (s["qw"], s["qx"], s["qy"], s["qz"])]
                yield pa.RecordBatch.from_pydict({"path": [name], "content": pa.array([d.tobytes()], pa.binary())})

    held = F.struct(F.col(order).alias("k"), "x", "y", "z", "sx", "sy", "sz", "qx", "qy", "qz", "qw", "opacity", "r", "g", "b")
    return splats.groupBy("path").agg(F.collect_list(held).alias("m")).mapInArrow(work, "path string, content binary")


def encode_obj(vertices: DataFrame, triangles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): OBJ texts of meshes."""
    line = lambda kind, *c: F.concat_ws(" ", F.lit(kind), *c)
    v = vertices.select(*keys, F.lit(0).alias("part"), F.col("vid").alias("at"), line("v", *(F.col(c).cast("string") for c in "xyz")).alias("line"))
    t = triangles.select(*keys, F.lit(1).alias("part"), F.col("tid").alias("at"), line("f", *((F.col(c) + 1).cast("string") for c in "abc")).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("part", "at", "line"))), lambda s: s["line"])
    return v.unionByName(t).groupBy(*keys).agg(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("text"))
