"""Depth runs: folders of planes with a fixed number of bytes a frame, and a JSON sidecar that describes them.

Reading is a partitioned Spark data source: the driver checks each run's sidecar against its files' sizes and cuts the
wanted frames into ranges of about SPLIT bytes; a task reads its byte range of each plane. A frame range and the choice of planes are
options, so only those bytes are read. A run whose writer hasn't finished (``done`` is false) gives the whole frames it
holds; every other file that is shorter than its sidecar says, or no whole number of frames, is an error.

Writing turns every plane of a frame into a piece at frame * stride (see ``pieces``); a missing or repeated frame leaves a hole or an
overlap, which the commit refuses. The sidecar is put in place last.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .pieces import gathered, save_pieces

# What the sidecar must say, and default names of the planes' files. Runs of another writer are read by giving its schema's name.
SCHEMA, KINDS = "depth-run/1", ("relative-disparity", "metric-depth")
FILES = {"depth": "depth.f32", "mask": "mask.u8", "metric": "metric.f32", "normals": "normals.i8", "intrinsics": "intrinsics.f32", "body": "body.f32", "body_valid": "body-valid.u8", "faces": "body-faces.u32"}
COLUMNS = {"depth": "d array<float>", "mask": "mask binary", "metric": "metric array<float>", "normals": "normals binary", "intrinsics": "k array<float>", "body": "body array<float>, body_valid boolean"}
NAMES = {"depth": "d", "intrinsics": "k"}
#: Bytes that one task reads.
SPLIT = 32 << 20


class BadRun(ValueError):
    """The sidecar and the files of a run don't agree."""


@dataclass
class Plane:
    """A file of equally long records, one for each frame."""

    path: str
    stride: int


@dataclass
class Run:
    name: str
    meta: dict
    frames: int
    planes: dict[str, Plane]


def _count(meta: dict, key: str) -> int:
    value = meta.get(key)
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != int(value) or value <= 0:
        raise BadRun(f"{key} must be a positive whole number, not {value!r}")
    return int(value)


def _size(system, path: str) -> int:
    info = system.get_file_info(path)
    if not info.is_file:
        raise BadRun(f"{path} is missing")
    return info.size


def open_run(system, folder: str, schema: str = SCHEMA) -> Run:
    """A run whose named files hold every frame; folder: its path in a pyarrow file system."""
    with system.open_input_file(f"{folder}/depth.json") as f:
        try:
            meta = json.loads(f.read())
        except ValueError as e:
            raise BadRun(f"{folder}/depth.json: {e}") from e
    if not isinstance(meta, dict) or meta.get("schema") != schema or meta.get("kind") not in KINDS:
        raise BadRun(f"{folder}/depth.json: schema or kind")
    width, height, declared = (_count(meta, k) for k in ("width", "height", "frames"))
    if not isinstance(meta.get("fps"), (int, float)) or not meta["fps"] > 0:
        raise BadRun(f"{folder}/depth.json: fps")
    area, unfinished = width * height, meta.get("done") is False
    depth = Plane(f"{folder}/{FILES['depth']}", area * 4)
    size = _size(system, depth.path)
    if size % depth.stride and not unfinished:
        raise BadRun(f"{depth.path}: {size} bytes are no whole number of frames")
    frames = min(declared, size // depth.stride)
    if frames < 1 or (frames < declared and not unfinished):
        raise BadRun(f"{depth.path}: {frames} of {declared} frames")
    planes = {"depth": depth}

    def named(plane: str, part: dict, key: str, stride: int) -> None:
        if not isinstance(part.get(key), str) or not part[key]:
            raise BadRun(f"{folder}/depth.json: no file of {plane}")
        path = f"{folder}/{part[key]}"
        if (have := _size(system, path)) < frames * stride:
            raise BadRun(f"{path}: {have} bytes, {frames * stride} needed")
        planes[plane] = Plane(path, stride)

    for plane, stride in (("mask", area), ("metric", area * 4), ("normals", area * 3)):
        if meta.get(plane) and (plane != "mask" or meta[plane].get("file")):
            named(plane, meta[plane], "file", stride)
    if k := meta.get("intrinsics"):
        for key in ("fx", "fy", "cx", "cy"):
            if not isinstance(k.get(key), (int, float)) or not np.isfinite(k[key]) or (key[0] == "f" and k[key] <= 0):
                raise BadRun(f"{folder}/depth.json: intrinsics.{key}")
        if k.get("file"):
            named("intrinsics", k, "file", 16)
    if body := meta.get("body"):
        vertices, faces = _count(body, "vertices"), _count(body, "faceCount")
        named("body", body, "file", vertices * 12)
        named("body_valid", body, "valid", 1)
        path = f"{folder}/{body.get('faces')}"
        if _size(system, path) < faces * 12:
            raise BadRun(f"{path}: fewer than {faces} faces")
    return Run(folder.rstrip("/").rsplit("/", 1)[-1], meta, frames, planes)


def _system(path: str):
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _runs(path: str, schema: str) -> list[tuple[str, Run]]:
    """(folder, run) of the run at path, or of those in its folders."""
    from pyarrow import fs

    system, root = _system(path)
    root = root.rstrip("/")
    if system.get_file_info(f"{root}/depth.json").is_file:
        return [(root, open_run(system, root, schema))]
    found = system.get_file_info(fs.FileSelector(root))
    return [(f.path, open_run(system, f.path, schema)) for f in sorted(found, key=lambda f: f.path) if not f.is_file and system.get_file_info(f"{f.path}/depth.json").is_file]


@dataclass
class Frames(InputPartition):
    run: str
    width: int
    height: int
    kind: str
    first: int
    end: int
    planes: dict[str, Plane]

    def __hash__(self) -> int:
        return hash((self.run, self.first))


class DepthReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.wanted = options["planes"].split(",")
        self.first, self.end = int(options.get("first", 0)), int(options.get("end", 1 << 62))
        self.split, self.schema = int(options.get("split", SPLIT)), options.get("schema", SCHEMA)

    def partitions(self) -> list[InputPartition]:
        out = []
        for _, run in _runs(self.path, self.schema):
            planes = {n: p for n, p in run.planes.items() if n.removesuffix("_valid") in self.wanted}
            each = max(1, self.split // max(1, sum(p.stride for p in planes.values())))
            for a in range(max(0, self.first), min(run.frames, self.end), each):
                out.append(Frames(run.name, run.meta["width"], run.meta["height"], run.meta["kind"], a, min(a + each, run.frames, self.end), planes))
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        p = partition
        if p is None:
            return
        system, _ = _system(self.path)
        n = p.end - p.first
        columns = {"run": pa.array([p.run] * n), "frame": pa.array(np.arange(p.first, p.end)), "width": pa.array([p.width] * n, pa.int32()), "height": pa.array([p.height] * n, pa.int32()), "kind": pa.array([p.kind] * n)}
        for plane in self.wanted:
            for name in (plane, "body_valid") if plane == "body" else (plane,):
                columns[NAMES.get(name, name)] = self._column(system, name, p.planes.get(name), p.first, n)
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    @staticmethod
    def _column(system, name: str, plane: Plane | None, first: int, n: int) -> pa.Array:
        kind = pa.bool_() if name == "body_valid" else pa.binary() if name in ("mask", "normals") else pa.list_(pa.float32())
        if plane is None:
            return pa.nulls(n, kind)
        with system.open_input_file(plane.path) as f:
            content = f.read_at(n * plane.stride, first * plane.stride)
        if len(content) < n * plane.stride:
            raise BadRun(f"{plane.path}: cut off while it was read")
        if kind == pa.bool_():
            return pa.array(np.frombuffer(content, np.uint8) != 0)
        if kind == pa.binary():
            return pa.array([content[i * plane.stride : (i + 1) * plane.stride] for i in range(n)], kind)
        values = np.frombuffer(content, "<f4").astype(np.float32, copy=False)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (plane.stride // 4)), pa.array(values))


class DepthRuns(DataSource):
    @classmethod
    def name(cls) -> str:
        return "depth_runs"

    def schema(self) -> str:
        return ", ".join(["run string, frame long, width int, height int, kind string", *(COLUMNS[p] for p in self.options["planes"].split(","))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return DepthReader(self.options)


def scan_depth_runs(spark: SparkSession, path: str, planes: tuple[str, ...] = ("depth", "mask"), first: int = 0, end: int | None = None, split: int = SPLIT, schema: str = SCHEMA) -> DataFrame:
    """One row per frame of the run at path, or of the runs in its folders: run, frame, width, height, kind and the planes.

    planes: of depth, mask, metric, normals, intrinsics, body; one that a run doesn't have is null. Frames first to end (excluded) are read.
    """
    spark.dataSource.register(DepthRuns)
    made = spark.read.format("depth_runs").option("planes", ",".join(planes)).option("first", str(first)).option("split", str(split)).option("schema", schema)
    return (made if end is None else made.option("end", str(end))).load(path)


def write_depth_runs(
    frames: DataFrame, folder: str, width: int, height: int, fps: float = 30.0, kind: str = "relative-disparity", intrinsics: dict | None = None, vertices: int = 0, faces: np.ndarray | None = None, done: bool = True, schema: str = SCHEMA
) -> None:
    """Write a run ``<run>/`` below folder for each run of frames (run, frame from 0 without gaps, and planes named as scan_depth_runs() does).

    intrinsics: the clip's normalised fx, fy, cx, cy, needed by column k; vertices and faces: of the body mesh, needed by column body.
    """
    area = width * height
    strides = {"d": ("depth", area * 4), "mask": ("mask", area), "metric": ("metric", area * 4), "normals": ("normals", area * 3), "k": ("intrinsics", 16), "body": ("body", vertices * 12), "body_valid": ("body_valid", 1)}
    held = [c for c in strides if c in frames.columns]
    if "d" not in held or ("k" in held and not intrinsics) or ("body" in held) != ("body_valid" in held) or ("body" in held and (faces is None or not vertices)):
        raise ValueError("a run needs depth, clip intrinsics for column k, and vertices, faces and body_valid for column body")
    piece = "file string, at long, data binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                run, frame = batch.column("run")[i].as_py(), batch.column("frame")[i].as_py()
                names, at, data = [], [], []
                for c in held:
                    plane, stride = strides[c]
                    value = batch.column(c)[i]
                    if c in ("mask", "normals"):
                        content = value.as_py()
                    elif c == "body_valid":
                        content = bytes([value.as_py()])
                    else:
                        content = value.values.to_numpy(zero_copy_only=False).astype("<f4").tobytes()
                    if len(content) != stride:
                        raise BadRun(f"{run}, frame {frame}: {plane} has {len(content)} bytes, not {stride}")
                    names.append(f"{run}/{FILES[plane]}")
                    at.append(frame * stride)
                    data.append(content)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(at, pa.int64()), pa.array(data, pa.binary())], ["file", "at", "data"])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                meta = {"schema": schema, "kind": kind, "width": width, "height": height, "frames": r["frames"], "fps": fps, "done": done}
                meta |= {p: {"file": FILES[p]} for p in ("mask", "metric", "normals") if p in held}
                if intrinsics:
                    meta["intrinsics"] = {**intrinsics, **({"file": FILES["intrinsics"]} if "k" in held else {})}
                rows = []
                if "body" in held:
                    table = np.asarray(faces, "<u4").reshape(-1, 3)
                    if len(table) and table.max() >= vertices:
                        raise BadRun(f"a face names vertex {table.max()} of {vertices}")
                    meta["body"] = {"file": FILES["body"], "valid": FILES["body_valid"], "faces": FILES["faces"], "vertices": vertices, "faceCount": len(table)}
                    rows.append((f"{r['run']}/{FILES['faces']}", 0, table.tobytes()))
                rows.append((f"{r['run']}/depth.json", 0, json.dumps(meta, indent=2).encode() + b"\n"))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))], ["file", "at", "data"])

    rows = frames.select(F.col("run").cast("string").alias("run"), F.col("frame").cast("long").alias("frame"), *held)
    runs = rows.groupBy("run").agg((F.max("frame") + 1).alias("frames"))
    save_pieces(rows.mapInArrow(gathered(work), piece).union(runs.mapInArrow(gathered(describe), piece)), folder)
