"""Container files of whole clips, written chunk by chunk by many tasks and read by byte ranges.

Writing: items (coded frames, texture frames, audio packets) meet by chunk only, a group of frames each. The chunks' lengths are added up
in two levels (runs of chunks, then chunks of a run), which gives every chunk's place; header, index runs, track listing and
chunks are then pieces of one file (see ``pieces``). A task goes through a run's chunks in batches; no driver holds chunks or index entries.

Reading: tasks read each file's head and emit its index as rows; chunks are read as byte ranges, dealt out over tasks,
so a filter on the index reads only the chunks that are left.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import remove_folder, shared_folder
from .container import BLOCK, CHUNK, CHUNK_MAGIC, GOP, HEADER, MAGIC, SUPER, Damaged, _take
from .pieces import AT_ONCE, BYTES, PIECE, ROWS, STRETCH, gathered, save_pieces

# Block types and their tracks, and the largest audio packet.
INTRA, DELTA, TEXTURE, AUDIO = 0, 1, 2, 4
TRACK = {INTRA: 0, DELTA: 0, TEXTURE: 1, AUDIO: 2}
LARGEST_PACKET = 0xFFFF
#: Chunks whose index entries are one piece.
RUN = 4096
_COUNT, _TEXTURE, _PACKET = struct.Struct("<HH"), struct.Struct("<IB"), struct.Struct("<IHH")
_BOX_AT = 16
#: The layouts of GOP, CHUNK and BLOCK as numpy has them.
_GOP = np.dtype([("pts", "<u8"), ("frame", "<u4"), ("n", "<u2"), ("_", "<u2"), ("at", "<u8"), ("length", "<u4")])
_CHUNK = np.dtype([("magic", "S4"), ("pts", "<u8"), ("n", "<u2"), ("_", "<u2"), ("box", "<f4", 6), ("blocks", "<u2")])
_BLOCK = np.dtype([("type", "u1"), ("track", "<u2"), ("at", "<u4"), ("size", "<u4")])
_CORNERS = ["x0", "y0", "z0", "x1", "y1", "z1"]


def texture_block(frames: list[tuple[bytes, bool]]) -> bytes:
    """Sizes and key flags of coded texture frames, then the frames."""
    return _COUNT.pack(len(frames), 0) + b"".join(_TEXTURE.pack(len(d), int(k)) for d, k in frames) + b"".join(d for d, _ in frames)


def audio_block(packets: list[tuple[int, int, bytes]], start: int) -> bytes:
    """(pts, duration, packet) with times from the chunk's start, then the packets."""
    for _, _, d in packets:
        if len(d) > LARGEST_PACKET:
            raise ValueError(f"an audio packet of {len(d)} bytes exceeds {LARGEST_PACKET}")
    return _COUNT.pack(len(packets), 0) + b"".join(_PACKET.pack(max(0, p - start), t, len(d)) for p, t, d in packets) + b"".join(d for _, _, d in packets)


def texture_entries(block: bytes) -> list[tuple[bool, bytes]]:
    """(key, data) of each frame of a texture block."""
    return [(bool(h[1] & 1), d) for h, d in _entries(_TEXTURE, block, 0)]


def audio_entries(block: bytes) -> list[tuple[int, int, bytes]]:
    """(time from the chunk's start, duration, data) of each packet of an audio block."""
    return [(h[0], h[1], d) for h, d in _entries(_PACKET, block, 2)]


def _entries(layout: struct.Struct, block: bytes, size_at: int) -> Iterator[tuple[tuple, bytes]]:
    """(fields, payload) of each entry of a block."""
    n, _ = _take(_COUNT, block, 0)
    heads = [_take(layout, block, _COUNT.size + k * layout.size) for k in range(n)]
    at = _COUNT.size + n * layout.size
    for h in heads:
        if at + h[size_at] > len(block):
            raise Damaged("an entry ends beyond its block")
        yield h, block[at : at + h[size_at]]
        at += h[size_at]


def chunks(frames: DataFrame, fps: float, gop_length: int, textures: DataFrame | None = None, audio: DataFrame | None = None) -> DataFrame:
    """(clip, gop, frame, pts, n, box, length, body): the chunks of every clip.

    frames: (clip, frame, x0..z1 bounds, data), frames from 0 without gaps; textures: (clip, frame, is_key, data); audio: (clip, pts, duration, data) in
    microseconds. A packet goes to the chunk whose time it starts in, those behind the last frame to the last chunk.
    """
    of = lambda g: F.round(g * gop_length * 1e6 / fps).cast("long")
    none = F.lit(None)
    item = lambda kind, order, key, span, data: F.struct(F.lit(kind).alias("kind"), order.cast("long").alias("order"), key.alias("key"), span.cast("long").alias("span"), data.cast("binary").alias("data")).alias("item")
    box = lambda by: [(F.col(c) if by else none).cast("double").alias(c) for c in _CORNERS]
    gop = F.floor(F.col("frame") / gop_length)
    first = F.col("frame") % gop_length == 0
    rows = frames.select("clip", gop.alias("gop"), item(INTRA, F.col("frame"), first, none, F.col("data")), *box(True))
    if textures is not None:
        rows = rows.unionByName(textures.select("clip", gop.alias("gop"), item(TEXTURE, F.col("frame"), F.col("is_key"), none, F.col("data")), *box(False)))
    if audio is not None:
        last = frames.groupBy("clip").agg(F.max(gop).alias("last"))
        g = F.floor(F.col("pts") * fps / 1e6 / gop_length)
        # Chunks start at rounded times, which may lie a microsecond beside the quotient.
        near = F.when(F.col("pts") < of(g), g - 1).when(F.col("pts") >= of(g + 1), g + 1).otherwise(g)
        told = audio.join(last, "clip").select("clip", F.greatest(F.lit(0), F.least("last", near)).cast("long").alias("gop"), item(AUDIO, F.col("pts"), F.lit(False), F.col("duration"), F.col("data")), *box(False))
        rows = rows.unionByName(told)
    held = rows.groupBy("clip", "gop").agg(F.array_sort(F.collect_list("item")).alias("items"), F.array(*_bounds(F.col)).alias("box"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _made(batch, fps, gop_length)

    return held.select("clip", "gop", "items", "box").mapInArrow(gathered(make), "clip long, gop long, frame long, pts long, n long, box array<double>, length long, body binary")


def _bounds(of) -> list:
    """The least of the first three and the largest of the last three corners; of: a corner's column by its name."""
    return [F.min(of(c)) for c in _CORNERS[:3]] + [F.max(of(c)) for c in _CORNERS[3:]]


def _fit(values: np.ndarray, kind: str, what: str) -> np.ndarray:
    """values as whole numbers of a layout, none of which may be cut."""
    if len(values) and (values.min() < 0 or values.max() > np.iinfo(kind).max):
        raise ValueError(f"{what} of {values.min()} to {values.max()} don't fit in {np.dtype(kind).itemsize} bytes")
    return values.astype(kind)


def _made(batch: pa.RecordBatch, fps: float, gop_length: int) -> Iterator[pa.RecordBatch]:
    """The chunks of (clip, gop, items, box) rows; headers and directories are made for all of them at once."""
    items, number = batch.column("items"), batch.num_rows
    some = dict(zip((f.name for f in items.type.value_type), items.values.flatten(), strict=True))
    kind, order, key = (some[c].to_numpy(zero_copy_only=False) for c in ("kind", "order", "key"))
    ends = items.offsets.to_numpy().astype(np.int64)
    first = ends[:-1]
    # Items are in the order of their kinds.
    count = lambda k: np.diff(np.concatenate([[0], np.cumsum(kind == k)])[ends])
    n, textures, packets = (count(k) for k in (INTRA, TEXTURE, AUDIO))
    box = batch.column("box").flatten().to_numpy(zero_copy_only=False).reshape(-1, 6)
    if not n.all() or batch.column("box").flatten().null_count:
        raise ValueError("a chunk has no frames, or none with bounds")
    low = box.astype("<f4")
    if (np.isinf(low) & np.isfinite(box)).any():
        raise ValueError("bounds beyond the range of floats")
    data = some["data"].fill_null(b"").cast(pa.binary())
    at = np.frombuffer(data.buffers()[1], "<i4")[data.offset : data.offset + len(data) + 1].astype(np.int64)
    content = memoryview(data.buffers()[2] or b"")
    gops = batch.column("gop").to_numpy()
    pts = np.rint(gops * gop_length * 1e6 / fps).astype(np.int64)
    # Texture and audio blocks have directories of their own.
    sides: list[list[bytes]] = [[b""] * number, [b""] * number]
    for i in np.flatnonzero(textures + packets).tolist():
        t, u, end = int(first[i] + n[i]), int(first[i] + n[i] + textures[i]), int(ends[i + 1])
        payload = [bytes(content[at[k] : at[k + 1]]) for k in range(t, end)]
        if t < u:
            sides[0][i] = texture_block(list(zip(payload[: u - t], key[t:u], strict=True)))
        if u < end:
            sides[1][i] = audio_block(list(zip(order[u:end].tolist(), some["span"][u:end].to_pylist(), payload[u - t :], strict=True)), int(pts[i]))
    # A block for each frame, then those of the sides.
    blocks = n + (textures > 0) + (packets > 0)
    start = np.cumsum(blocks) - blocks
    listed = np.zeros(int(blocks.sum()), _BLOCK)
    sizes = np.zeros(len(listed), np.int64)
    frames = np.flatnonzero(kind == INTRA)
    own = np.repeat(start - first, n) + frames
    listed["type"][own] = np.where(key[frames].astype(bool), INTRA, DELTA)
    sizes[own] = np.diff(at)[frames]
    for k, there, made in ((TEXTURE, textures > 0, sides[0]), (AUDIO, packets > 0, sides[1])):
        own = (start + n + ((textures > 0) if k == AUDIO else 0))[there]
        listed["type"][own] = k
        sizes[own] = [len(made[i]) for i in np.flatnonzero(there).tolist()]
    for k in set(TRACK):
        listed["track"][listed["type"] == k] = TRACK[k]
    before = np.cumsum(sizes) - sizes
    where = before + np.repeat(CHUNK.size + BLOCK.size * blocks - before[start], blocks)
    listed["at"], listed["size"] = _fit(where, "<u4", "places of blocks"), _fit(sizes, "<u4", "sizes of blocks")
    heads = np.zeros(number, _CHUNK)
    heads["magic"], heads["pts"], heads["n"], heads["box"], heads["blocks"] = CHUNK_MAGIC, _fit(pts, "<u8", "times"), _fit(n, "<u2", "numbers of frames"), low, _fit(blocks, "<u2", "numbers of blocks")
    length = CHUNK.size + BLOCK.size * blocks + np.add.reduceat(sizes, start)
    told = [batch.column("clip"), gops, order[first], pts, n.astype(np.int64), batch.column("box"), length]
    table = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in told], ["clip", "gop", "frame", "pts", "n", "box", "length"])
    top, directory, made, size, done = heads.tobytes(), listed.tobytes(), [], 0, 0
    for i, (a, b, c, d) in enumerate(zip(start.tolist(), (start + blocks).tolist(), at[first].tolist(), at[first + n].tolist(), strict=True)):
        made.append(b"".join((top[i * CHUNK.size : (i + 1) * CHUNK.size], directory[a * BLOCK.size : b * BLOCK.size], content[c:d], sides[0][i], sides[1][i])))
        if (size := size + len(made[-1])) >= BYTES or i == number - 1:
            part = table.slice(done, len(made))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], [*part.schema.names, "body"])
            done, made, size = i + 1, [], 0


def places(found: DataFrame, head: int) -> DataFrame:
    """found (clip, gop, n, box, length, ...) with ``run``, ``nth`` (its number there), ``at``: where each chunk starts behind the clip's head and index,
    and the clip's chunks, frames and box (whole).

    Added up over runs, then inside each run, so no task orders more than RUN chunks of a clip, or its runs.
    """
    run = F.floor(F.col("gop") / RUN).cast("long").alias("run")
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    corner = lambda k: F.col("box")[_CORNERS.index(k)]
    totals = found.groupBy("clip", run).agg(F.sum("length").alias("bytes"), F.count("*").alias("chunks"), F.sum("n").alias("frames"), *(c.alias(name) for name, c in zip(_CORNERS, _bounds(corner), strict=True)))
    before, whole = Window.partitionBy("clip").orderBy("run"), Window.partitionBy("clip")
    sides = F.array(*(c.over(whole) for c in _bounds(F.col))).alias("whole")
    base = totals.select("clip", "run", (F.sum("bytes").over(before) - F.col("bytes")).alias("base"), *(F.sum(c).over(whole).alias(c) for c in ("chunks", "frames")), sides)
    inside = Window.partitionBy("clip", "run").orderBy("gop")
    # By number, as rows without bodies are few bytes and many chunks.
    laid = found.withColumn("run", run).repartition(parts, "clip", "run").withColumn("nth", F.row_number().over(inside) - 1).withColumn("behind", F.sum("length").over(inside) - F.col("length"))
    at = F.lit(head) + F.col("chunks") * GOP.size + F.col("base") + F.col("behind")
    return laid.join(base, ["clip", "run"]).withColumn("at", at.cast("long")).drop("base", "behind")


def write_clips(found: DataFrame, folder: str, fps: float, gop_length: int, bits: int = 14, magic: bytes = MAGIC, shift: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> None:
    """Write a file ``<clip>.clip`` below a folder for each clip of chunks().

    shift: added to all bounds, of clips and chunks, as a clip that is moved once it is known whole. Bodies are kept in the shared folder until the files stand.
    A task has the chunks of a run in order, so what follows each other in a file is one piece: a short clip is written at once.
    """
    spark = found.sparkSession
    tracks = [(0, 0, "RAW0"), (1, 1, "TEX0"), (2, 2, "AUD0")]
    listing = struct.pack("<H", len(tracks)) + b"".join(struct.pack("<HB4sBH", n, k, code.encode(), 0, 0) for n, k, code in tracks)
    stage = shared_folder(spark, "chunks")
    found.write.parquet(stage)
    try:
        kept = spark.read.schema(found.schema).parquet(stage)
        meta_size = len(_pair("gop_length", str(gop_length)))
        head = HEADER.size + SUPER.size + meta_size + 4 + len(listing)
        laid = places(kept, head).sortWithinPartitions("clip", "run", "gop")
        moved = [*shift, *shift]
        index_at = head - len(listing)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield from _laid(batch, moved, index_at, lambda r: _head(r, moved, fps, bits, gop_length, magic, listing))

        columns = ["clip", "run", "nth", "pts", "frame", "n", "at", "length", "box", "body", "chunks", "frames", "whole"]
        save_pieces(laid.select(*columns).mapInArrow(gathered(work), PIECE), folder, dealt=True)
    finally:
        remove_folder(spark, stage)


def _laid(batch: pa.RecordBatch, moved: list[float], index_at: int, top: Callable[[dict], list[tuple[str, int, bytes]]]) -> Iterator[pa.RecordBatch]:
    """The pieces of chunks in the order of their clips and runs, whose places and totals are known; top: the pieces around a clip's index."""
    clip, run, nth, at, length = (batch.column(c).to_numpy() for c in ("clip", "run", "nth", "at", "length"))
    body = batch.column("body").cast(pa.binary())
    ends = np.frombuffer(body.buffers()[1], "<i4")[body.offset : body.offset + len(body) + 1].astype(np.int64)
    content = body.buffers()[2]
    if any(moved):
        content = np.frombuffer(content, "u1").copy()
        sides = (batch.column("box").flatten().to_numpy().reshape(-1, 6) + moved).astype("<f4")
        content[ends[:-1, None] + _BOX_AT + np.arange(24)] = sides.view("u1").reshape(-1, 24)
    content = memoryview(content)
    entries = np.zeros(len(clip), _GOP)
    for c, kind in (("pts", "<u8"), ("frame", "<u4"), ("n", "<u2"), ("at", "<u8"), ("length", "<u4")):
        entries[c] = _fit(batch.column(c).to_numpy(), kind, c)
    listed = entries.tobytes()
    new = np.flatnonzero((np.diff(clip) != 0) | (np.diff(run) != 0)) + 1
    # Bodies that follow each other are a piece, of a megabyte unless one body is longer.
    filled = (ends[:-1] - ends[0]) // AT_ONCE
    cuts = np.union1d(new, np.flatnonzero((at[1:] != at[:-1] + length[:-1]) | (np.diff(filled) != 0)) + 1)
    rows, size = [], 0
    for i, j in zip([0, *new.tolist()], [*new.tolist(), len(clip)], strict=True):
        file = f"{clip[i]}.clip"
        around = top({k: batch.column(k)[i].as_py() for k in ("clip", "chunks", "frames", "whole")}) if run[i] == 0 and nth[i] == 0 else []
        put = [*around[:1], (file, index_at + int(run[i] * RUN + nth[i]) * GOP.size, listed[i * GOP.size : j * GOP.size]), *around[1:]]
        own = [i, *cuts[np.searchsorted(cuts, i, "right") : np.searchsorted(cuts, j)].tolist(), j]
        put += [(file, int(at[a]), bytes(content[ends[a] : ends[b]])) for a, b in zip(own, own[1:], strict=False)]
        rows += put
        if (size := size + sum(len(d) for _, _, d in put)) >= BYTES:
            yield _pieces(rows)
            rows, size = [], 0
    yield _pieces(rows)


def _head(clip: dict, moved: list[float], fps: float, bits: int, gop_length: int, magic: bytes, listing: bytes) -> list[tuple[str, int, bytes]]:
    """The pieces before and behind a clip's index."""
    top = SUPER.pack(*(a + b for a, b in zip(clip["whole"], moved, strict=True)), bits, 16, 0, 0, gop_length, 0, 0, 0, 0, 0, 0, 1) + _pair("gop_length", str(gop_length))
    index = HEADER.size + len(top)
    listed = index + 4 + GOP.size * clip["chunks"]
    plain = HEADER.pack(magic, 0, 2, 0, 0, 0, 2, 1, fps, clip["frames"], round(clip["frames"] * 1e6 / fps), HEADER.size, index, listed, listed + len(listing), 0)
    file = f"{clip['clip']}.clip"
    return [(file, 0, plain[:60] + struct.pack("<I", zlib.crc32(plain[:60])) + top + struct.pack("<I", clip["chunks"])), (file, listed, listing)]


def _pair(key: str, value: str) -> bytes:
    return b"".join(struct.pack("<H", len(x)) + x for x in (key.encode(), value.encode()))


def _pieces(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    return _rows(rows, [pa.string(), pa.int64(), pa.binary()], ["file", "at", "data"])


def _rows(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


INDEX = "path string, bytes long, fps double, frames long, duration_us long, gop_length int, box array<double>, gop long, pts long, frame_start long, n int, at long, length long"


class _File:
    """A file that is read by places; its first bytes are read with one call."""

    def __init__(self, path: str, first: int = 0) -> None:
        self.handle, self.remote = -1, None
        if path.startswith("file:") or "://" not in path:
            self.handle = os.open("/" + path.removeprefix("file:").lstrip("/"), os.O_RDONLY)
        else:
            from pyarrow import fs

            system, place = fs.FileSystem.from_uri(path)
            self.remote = system.open_input_file(place)
        self.first = b""
        if first:
            self.first = self.read_at(first, 0)

    def read_at(self, size: int, at: int) -> bytes:
        if at + size <= len(self.first):
            return self.first[at : at + size]
        if self.remote:
            return self.remote.read_at(size, at)
        made = os.pread(self.handle, size, at)
        while 0 < len(made) < size and (more := os.pread(self.handle, size - len(made), at + len(made))):
            made += more
        return made

    def close(self) -> None:
        if self.remote:
            self.remote.close()
        else:
            os.close(self.handle)

    def __enter__(self) -> _File:
        return self

    def __exit__(self, *_) -> None:
        self.close()


#: Bytes of a file's head that are read at once.
_FIRST = 1 << 14


def _index_runs(file: str, size: int, magic: bytes) -> Iterator[tuple[tuple, int, np.ndarray]]:
    """((path, bytes, fps, frames, duration, gop_length, box), number of the first, index entries) for each run of a file's chunks."""
    with _File(file, min(size, _FIRST)) as f:
        top = f.read_at(min(size, HEADER.size), 0)
        h = _take(HEADER, top, 0)
        if h[0] != magic or h[-1] not in (0, zlib.crc32(top[:60])) or h[1] > 0:
            raise Damaged(f"{file}: magic, checksum or version")
        fps, frames, duration, super_at, gop_at = h[8:13]
        if max(super_at, gop_at) > size:
            raise Damaged(f"{file}: an index beyond the file")
        s = _take(SUPER, f.read_at(SUPER.size, super_at), 0)
        (n,) = _take(struct.Struct("<I"), f.read_at(4, gop_at), 0)
        if gop_at + 4 + n * GOP.size > size:
            raise Damaged(f"{file}: {n} chunks")
        for first in range(0, n, RUN):
            k = min(RUN, n - first)
            content = f.read_at(k * GOP.size, gop_at + 4 + first * GOP.size)
            if len(content) < k * GOP.size:
                raise Damaged(f"{file}: {n} chunks")
            rows = np.frombuffer(content, _GOP)
            if (rows["at"] > size).any() or (rows["length"] > size - rows["at"].astype(np.int64)).any() or (rows["pts"] >> 63).any():
                raise Damaged(f"{file}: a chunk ends beyond the file")
            yield (file, size, fps, frames, duration, s[10], s[:6]), first, rows


def _index_batch(runs: list[tuple[tuple, int, np.ndarray]]) -> pa.RecordBatch:
    """Runs as rows of INDEX."""
    n = [len(rows) for _, _, rows in runs]
    of = np.repeat(np.arange(len(runs)), n)
    rows = np.concatenate([rows for _, _, rows in runs])
    file, size, fps, frames, duration, gop_length, box = zip(*(head for head, _, _ in runs), strict=True)
    each = lambda values, kind: pa.array(values, kind).take(pa.array(of))
    gop = np.concatenate([np.arange(first, first + len(r)) for _, first, r in runs])
    boxes = pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1, dtype="<i4") * 6), pa.array(np.array(box, "<f8")[of].ravel()))
    whole = lambda c, kind: pa.array(rows[c].astype(kind))
    columns = [each(file, pa.string()), each(size, pa.int64()), each(fps, pa.float64()), each(frames, pa.int64()), each(duration, pa.int64()), each(gop_length, pa.int32()), boxes]
    columns += [pa.array(gop), whole("pts", "<i8"), whole("frame", "<i8"), whole("n", "<i4"), whole("at", "<i8"), whole("length", "<i8")]
    return pa.RecordBatch.from_arrays(columns, [part.split()[0] for part in INDEX.split(", ")])


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files below path, in no more tasks than a shuffle has, as Spark plans each short file as 4 MB and so a task for every 32."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.clip").load(path).select("path", "length").coalesce(parts)


def scan_index(spark: SparkSession, path: str, magic: bytes = MAGIC) -> DataFrame:
    """One row per chunk of each file below path; only heads are read. A file that isn't a container, or is cut off, ends the job."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for file, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                for run in _index_runs(file, length, magic):
                    held.append(run)
                    if (size := size + len(run[2])) >= ROWS:
                        yield _index_batch(held)
                        held, size = [], 0
        if held:
            yield _index_batch(held)

    return _files(spark, path).mapInArrow(gathered(read), INDEX)


def _track_rows(file: str, size: int, magic: bytes) -> list[tuple]:
    with _File(file, min(size, _FIRST)) as f:
        h = _take(HEADER, f.read_at(min(size, HEADER.size), 0), 0)
        if h[0] != magic:
            raise Damaged(f"{file}: magic")
        at, end = h[13], h[14]
        if not at <= min(end, size):
            raise Damaged(f"{file}: tracks beyond the file")
        listing = f.read_at(min(end, size) - at, at)
        (n,) = _take(struct.Struct("<H"), listing, 0)
        rows, place = [], 2
        for _ in range(n):
            number, kind, code, tier, length = _take(struct.Struct("<HB4sBH"), listing, place)
            rows.append((file, number, kind, code.decode("latin-1"), tier, listing[place + 10 : place + 10 + length]))
            place += 10 + length
        return rows


def scan_tracks(spark: SparkSession, path: str, magic: bytes = MAGIC) -> DataFrame:
    """(path, track, kind, code, tier, config) of the files below path; only heads are read."""
    types, names = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.binary()], ["path", "track", "kind", "code", "tier", "config"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for file, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                rows += _track_rows(file, size, magic)
                if len(rows) >= ROWS:
                    yield _rows(rows, types, names)
                    rows = []
        yield _rows(rows, types, names)

    files = _files(spark, path)
    return files.mapInArrow(gathered(read), "path string, track int, kind int, code string, tier int, config binary")


def _blocks(chunks: pa.RecordBatch, content: bytes, start: np.ndarray, kept: list[str]) -> pa.RecordBatch:
    """The blocks of chunks (path, gop, frame_start, n, pts, at, length, ...), whose bytes begin at start; all are taken apart at once."""
    bytes_, length = np.frombuffer(content, "u1"), chunks.column("length").to_numpy()
    name = lambda i: f"{chunks.column('path')[int(i)]}: "
    short = np.flatnonzero(length < CHUNK.size)
    if len(short):
        raise Damaged(f"{name(short[0])}no chunk at {chunks.column('at')[int(short[0])]}")
    heads = bytes_[start[:, None] + np.arange(CHUNK.size)].reshape(-1).view(_CHUNK)
    other = np.flatnonzero(heads["magic"] != CHUNK_MAGIC)
    if len(other):
        raise Damaged(f"{name(other[0])}no chunk at {chunks.column('at')[int(other[0])]}")
    count = heads["blocks"].astype(np.int64)
    of = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    beyond = CHUNK.size + count * BLOCK.size > length
    if not beyond.any():
        entries = bytes_[(start[of] + CHUNK.size + place * BLOCK.size)[:, None] + np.arange(BLOCK.size)].reshape(-1).view(_BLOCK)
        where, size = entries["at"].astype(np.int64), entries["size"].astype(np.int64)
        beyond = np.bincount(of, where + size > length[of], len(count)) > 0
    if beyond.any():
        raise Damaged(f"{name(np.flatnonzero(beyond)[0])}a block ends beyond its chunk")
    first = start[of] + where
    data = [content[a:b] for a, b in zip(first.tolist(), (first + size).tolist(), strict=True)]
    taken = chunks.take(pa.array(of))
    boxes = pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1, dtype="<i4") * 6), pa.array(heads["box"].astype("<f8")[of].ravel()))
    columns = [*(taken.column(c) for c in _CHUNK_KEYS), boxes, pa.array(place), *(pa.array(entries[c].astype("<i4")) for c in ("type", "track")), pa.array(data, pa.binary()), *(taken.column(c) for c in kept)]
    return pa.RecordBatch.from_arrays(columns, [*_CHUNK_KEYS, "box", "place", "type", "track", "data", *kept])


_CHUNK_KEYS = ["path", "gop", "frame_start", "n", "pts"]


def scan_chunks(index: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(path, gop, frame_start, n, pts, box, place, type, track, data): the blocks of the chunks that index rows name, read as byte ranges.

    keep: further columns of index that come along. Stretches of files are dealt out over the shuffle partitions, so many tasks read a long file,
    and a short one is opened once; chunks that follow each other are read together.
    """
    kept = list(keep)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                at, length = (batch.column(c).to_numpy() for c in ("at", "length"))
                code = batch.column("path").dictionary_encode().indices.to_numpy()
                before = np.cumsum(length) - length
                # A read is of a megabyte, unless a chunk is longer.
                cuts = (np.flatnonzero((np.diff(code) != 0) | (at[1:] != at[:-1] + length[:-1]) | (np.diff(before // AT_ONCE) != 0)) + 1).tolist()
                held, size, done = [], 0, 0
                for i, j in zip([0, *cuts], [*cuts, len(at)], strict=True):
                    path = batch.column("path")[i].as_py()
                    if path != name:
                        if f:
                            f.close()
                        name, f = path, _File(path)
                    n = int(length[i:j].sum())
                    held.append(f.read_at(n, int(at[i])))
                    if len(held[-1]) < n:
                        raise Damaged(f"{name}: a chunk ends beyond the file")
                    if (size := size + n) >= BYTES or j == len(at):
                        yield _blocks(batch.slice(done, j - done), b"".join(held), before[done:j] - before[done], kept)
                        held, size, done = [], 0, j
        finally:
            if f:
                f.close()

    schema = "path string, gop long, frame_start long, n int, pts long, box array<double>, place long, type int, track int, data binary"
    # By number, as rows of an index are few bytes and many chunks.
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.select(*_CHUNK_KEYS, "at", "length", *kept).repartition(parts, "path", F.floor(F.col("at") / STRETCH)).sortWithinPartitions("path", "gop")
    extra = "".join(f", `{c}` {index.schema[c].dataType.simpleString()}" for c in kept)
    return dealt.mapInArrow(gathered(read), schema + extra)


def geometry_frames(blocks: DataFrame) -> DataFrame:
    """(path, frame, intra, data): the coded frames of scan_chunks() blocks."""
    coded = blocks.where(F.col("type").isin(INTRA, DELTA))
    return coded.select("path", (F.col("frame_start") + F.col("place")).alias("frame"), (F.col("type") == INTRA).alias("intra"), "data")


def texture_frames(blocks: DataFrame) -> DataFrame:
    """(path, frame, is_key, data): the coded texture frames of scan_chunks() blocks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, first + i, key, d) for path, first, block in zip(*batch.to_pydict().values(), strict=True) for i, (key, d) in enumerate(texture_entries(block))]
            yield _rows(rows, [pa.string(), pa.int64(), pa.bool_(), pa.binary()], ["path", "frame", "is_key", "data"])

    return blocks.where(F.col("type") == TEXTURE).select("path", "frame_start", "data").mapInArrow(gathered(read), "path string, frame long, is_key boolean, data binary")


def audio_packets(blocks: DataFrame) -> DataFrame:
    """(path, pts, duration, data): the audio packets of scan_chunks() blocks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, pts + after, span, d) for path, pts, block in zip(*batch.to_pydict().values(), strict=True) for after, span, d in audio_entries(block)]
            yield _rows(rows, [pa.string(), pa.int64(), pa.int64(), pa.binary()], ["path", "pts", "duration", "data"])

    return blocks.where(F.col("type") == AUDIO).select("path", "pts", "data").mapInArrow(gathered(read), "path string, pts long, duration long, data binary")
