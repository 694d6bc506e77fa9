"""Files of whole clips and depth runs: written by many tasks, read back by byte ranges, as frames, packets and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.encodings import rounded
from ..session import checkpointed, remove_folder, shared_folder, table
from ..sources import clips, depth_runs, mesh_files, meshes, packets
from .common import SEQ, query, r6, sequences

FPS, GOP = 30.0, 4


def clip_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Events as frames with bounds and a coded payload."""
    v = F.col("value")
    return sequences(spark, sf).select("clip", "frame", *(v.alias(c) for c in ("x0", "y0", "z0")), *((v + 1.0).alias(c) for c in ("x1", "y1", "z1")), F.col("event_type").cast("binary").alias("data"))


def written(spark: SparkSession, sf: str, side_tracks: bool = False, shift: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> str:
    """A folder of container files, one for each user."""
    frames, textures, audio = clip_frames(spark, sf), None, None
    if side_tracks:
        s = sequences(spark, sf)
        textures = s.select("clip", "frame", (F.col("frame") % 8 == 0).alias("is_key"), F.concat(F.lit("T"), "event_type").cast("binary").alias("data"))
        # Packets run on behind the last frame.
        audio = s.select("clip", (F.col("frame") * 40000).alias("pts"), F.lit(20000).alias("duration"), F.concat("event_type", F.lit("A")).cast("binary").alias("data"))
    folder = shared_folder(spark, "clips")
    clips.write_clips(clips.chunks(frames, FPS, GOP, textures, audio), folder, FPS, GOP, shift=shift)
    return folder


def read_once(rows: DataFrame, folder: str) -> DataFrame:
    """rows, kept, so that the files that they were read from can go."""
    kept = checkpointed(rows)
    remove_folder(rows.sparkSession, folder)
    return kept


def clip_of(path: str = "path") -> Column:
    return F.regexp_extract(path, r"(-?[0-9]+)\.clip$", 1).cast("long").alias("clip")


# 64 bytes of header, 57 of superblock, 15 of meta, 32 of tracks and 4 of count; a chunk has 42 bytes, an index entry 28, a block 11.
_SIZES = f"sizes AS (SELECT clip, count(*) AS frames, (max(frame) // {GOP} + 1) AS chunks, sum(length(event_type)) AS payload FROM seq GROUP BY clip)"


@query("b01_write_container", f"WITH {SEQ}, {_SIZES} SELECT clip, CAST(frames AS BIGINT) AS frames, CAST(chunks AS BIGINT) AS chunks, CAST({{head}} + chunks * 70 + frames * 11 + payload AS BIGINT) AS bytes FROM sizes".format(head=clips.HEADER.size + clips.SUPER.size + 4 + len(clips._pair("gop_length", str(GOP))) + 2 + 3 * 10))
def write_container(spark: SparkSession, sf: str) -> DataFrame:
    """Container files of all clips, as their heads tell."""
    folder = written(spark, sf)
    index = clips.scan_index(spark, folder)
    return read_once(index.groupBy(clip_of()).agg(F.max("frames").alias("frames"), F.count("*").alias("chunks"), F.max("bytes").alias("bytes")), folder)


@query("a17_scan_chunks", f"WITH {SEQ} SELECT clip, frame, frame % {GOP} = 0 AS intra, event_type AS data FROM seq")
def scan_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The coded frames of those files, read back chunk by chunk."""
    folder = written(spark, sf)
    frames = clips.geometry_frames(clips.scan_chunks(clips.scan_index(spark, folder)))
    return read_once(frames.select(clip_of(), "frame", "intra", F.col("data").cast("string").alias("data")), folder)


_F32 = lambda x: f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"


@query("b02_write_container_streaming", f"WITH {SEQ} SELECT clip, frame // {GOP} AS gop, {r6(_F32('min(value) + 100.0'), 2)} AS low, {r6(_F32('max(value) + 1.0 + 100.0'), 2)} AS high, {r6(_F32('min(min(value)) OVER (PARTITION BY clip) + 100.0'), 2)} AS clip_low FROM seq GROUP BY clip, frame // {GOP}")
def write_container_streaming(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of chunks and clips that were moved when the clip was known whole."""
    folder = written(spark, sf, shift=(100.0, 0.0, 0.0))
    boxes = clips.scan_chunks(clips.scan_index(spark, folder).withColumnRenamed("box", "whole"), keep=["whole"]).where("place = 0")
    two = lambda c: rounded(c.cast("double"), 2)
    return read_once(boxes.select(clip_of(), "gop", two(F.col("box")[0]).alias("low"), two(F.col("box")[3]).alias("high"), two(F.col("whole")[0]).alias("clip_low")), folder)


@query("a19_texture_frames", f"WITH {SEQ} SELECT clip, frame, frame % 8 = 0 AS is_key, 'T' || event_type AS data FROM seq")
def texture_frames(spark: SparkSession, sf: str) -> DataFrame:
    folder = written(spark, sf, side_tracks=True)
    found = clips.texture_frames(clips.scan_chunks(clips.scan_index(spark, folder)))
    return read_once(found.select(clip_of(), "frame", "is_key", F.col("data").cast("string").alias("data")), folder)


@query("a20_audio_packets", f"WITH {SEQ} SELECT clip, frame * 40000 AS pts, CAST(20000 AS BIGINT) AS duration, event_type || 'A' AS data FROM seq")
def audio_packets(spark: SparkSession, sf: str) -> DataFrame:
    folder = written(spark, sf, side_tracks=True)
    found = clips.audio_packets(clips.scan_chunks(clips.scan_index(spark, folder)))
    return read_once(found.select(clip_of(), "pts", "duration", F.col("data").cast("string").alias("data")), folder)


@query("b04_chunk_blocks", f"""WITH {SEQ}, last AS (SELECT clip, max(frame) // {GOP} AS g FROM seq GROUP BY clip),
    geo AS (SELECT clip, frame // {GOP} AS gop, CASE WHEN frame % {GOP} = 0 THEN 0 ELSE 1 END AS type, length(event_type) AS bytes FROM seq),
    tex AS (SELECT clip, frame // {GOP} AS gop, 2 AS type, 4 + sum(6 + length(event_type)) AS bytes FROM seq GROUP BY ALL),
    aud AS (SELECT clip, least(last.g, CAST(floor(frame * 40000 * {FPS} / 1e6 / {GOP}) AS BIGINT)) AS gop, 4 AS type, 4 + sum(9 + length(event_type)) AS bytes FROM seq JOIN last USING (clip) GROUP BY ALL)
    SELECT clip, gop, CAST(type AS INTEGER) AS type, CAST(count(*) AS BIGINT) AS blocks, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT * FROM geo UNION ALL SELECT * FROM tex UNION ALL SELECT * FROM aud) GROUP BY clip, gop, type""")
def chunk_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of each type in each chunk, and their bytes."""
    folder = written(spark, sf, side_tracks=True)
    blocks = clips.scan_chunks(clips.scan_index(spark, folder))
    return read_once(blocks.groupBy(clip_of(), "gop", "type").agg(F.count("*").alias("blocks"), F.sum(F.length("data")).alias("bytes")), folder)


SIDE = 8
_RUNS = "runs AS (SELECT label AS run, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding FROM embeddings)"


def depth_runs_of(spark: SparkSession, sf: str) -> str:
    """A folder of runs, one for each label: vectors as maps of 8 x 8 pixels, masked where they are positive."""
    e = table(spark, sf, "embeddings")
    frame = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    mask = F.unhex(F.array_join(F.transform("d", lambda x: F.when(x > 0, "FF").otherwise("00")), ""))
    rows = e.select(F.col("label").cast("string").alias("run"), frame.alias("frame"), F.col("embedding").alias("d"))
    rows = rows.withColumn("mask", mask).withColumn("k", F.array(*(F.lit(x).cast("float") for x in (1.0, 1.0, 0.5)), (F.col("frame") / 1024).cast("float")))
    folder = shared_folder(spark, "depth")
    depth_runs.write_depth_runs(rows, folder, SIDE, SIDE, intrinsics={"fx": 1.0, "fy": 1.0, "cx": 0.5, "cy": 0.5})
    return folder


def _depth_sums(frames: DataFrame) -> DataFrame:
    on = F.length(F.regexp_replace(F.hex("mask"), "00", "")) / 2
    return frames.select(F.col("run").cast("int").alias("run"), "frame", *(rounded(f("d").cast("double")).alias(n) for f, n in ((F.array_min, "low"), (F.array_max, "high"))), on.cast("long").alias("masked"), rounded(F.col("k")[3].cast("double")).alias("cy"))


_DEPTH_SQL = f"WITH {_RUNS} SELECT run, frame, {r6('CAST(list_min(embedding) AS DOUBLE)')} AS low, {r6('CAST(list_max(embedding) AS DOUBLE)')} AS high, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS masked, {r6('frame / 1024')} AS cy FROM runs"


@query("b07_write_depth_run", _DEPTH_SQL)
def write_depth_run(spark: SparkSession, sf: str) -> DataFrame:
    """Depth, mask and intrinsics of every frame of all runs, written and read back."""
    folder = depth_runs_of(spark, sf)
    return read_once(_depth_sums(depth_runs.scan_depth_runs(spark, folder, ("depth", "mask", "intrinsics"), split=4096)), folder)


@query("a21_scan_depth_run", _DEPTH_SQL + " WHERE frame BETWEEN 5 AND 11")
def scan_depth_run(spark: SparkSession, sf: str) -> DataFrame:
    """Frames 5 to 11 of every run; only their byte ranges are read."""
    folder = depth_runs_of(spark, sf)
    return read_once(_depth_sums(depth_runs.scan_depth_runs(spark, folder, ("depth", "mask", "intrinsics"), first=5, end=12)), folder)


@query("a13_container_header", f"WITH {SEQ} SELECT clip, CAST({FPS} AS DOUBLE) AS fps, count(*) AS frames, CAST(floor(count(*) * 1e6 / {FPS} + 0.5) AS BIGINT) AS duration_us FROM seq GROUP BY clip")
def container_header(spark: SparkSession, sf: str) -> DataFrame:
    folder = written(spark, sf)
    return read_once(clips.scan_index(spark, folder).groupBy(clip_of()).agg(F.max("fps").alias("fps"), F.max("frames").alias("frames"), F.max("duration_us").alias("duration_us")), folder)


@query("a14_superblock", f"WITH {SEQ} SELECT clip, {GOP} AS gop_length, {r6(_F32('min(value)'), 3)} AS low, {r6(_F32('max(value) + 1.0'), 3)} AS high FROM seq GROUP BY clip")
def superblock(spark: SparkSession, sf: str) -> DataFrame:
    folder = written(spark, sf)
    side = lambda k: rounded(F.max(F.col("box")[k].cast("double")), 3)
    return read_once(clips.scan_index(spark, folder).groupBy(clip_of()).agg(F.max("gop_length").alias("gop_length"), side(0).alias("low"), side(3).alias("high")), folder)


@query("a15_gop_index", f"WITH {SEQ}, g AS (SELECT clip, frame // {GOP} AS gop, min(frame) AS frame_start, count(*) AS n, 42 + sum(11 + length(event_type)) AS length FROM seq GROUP BY ALL) SELECT clip, gop, CAST(floor(gop * {GOP} * 1e6 / {FPS} + 0.5) AS BIGINT) AS pts, frame_start, CAST(n AS INTEGER) AS n, CAST(length AS BIGINT) AS length, CAST(sum(length) OVER (PARTITION BY clip ORDER BY gop) - length + 28 * count(*) OVER (PARTITION BY clip) + {{head}} AS BIGINT) AS at FROM g".format(head=clips.HEADER.size + clips.SUPER.size + 4 + len(clips._pair("gop_length", str(GOP))) + 2 + 3 * 10))
def gop_index(spark: SparkSession, sf: str) -> DataFrame:
    folder = written(spark, sf)
    return read_once(clips.scan_index(spark, folder).select(clip_of(), "gop", "pts", "frame_start", "n", "length", "at"), folder)


@query("a16_track_dir", f"WITH {SEQ} SELECT DISTINCT clip, CAST(t AS INTEGER) AS track, CAST(t AS INTEGER) AS kind, ['RAW0', 'TEX0', 'AUD0'][t + 1] AS code FROM seq, range(0, 3) r(t)")
def track_dir(spark: SparkSession, sf: str) -> DataFrame:
    folder = written(spark, sf)
    return read_once(clips.scan_tracks(spark, folder).select(clip_of(), "track", "kind", "code"), folder)


@query("a18_geometry_blocks", f"WITH {SEQ} SELECT clip, frame // {GOP} AS gop, frame % {GOP} AS place, CAST(CASE WHEN frame % {GOP} = 0 THEN 0 ELSE 1 END AS INTEGER) AS type, length(event_type) AS bytes FROM seq")
def geometry_blocks(spark: SparkSession, sf: str) -> DataFrame:
    folder = written(spark, sf)
    return read_once(clips.scan_chunks(clips.scan_index(spark, folder)).select(clip_of(), "gop", "place", "type", F.length("data").cast("long").alias("bytes")), folder)


_MESH = "m AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS vid, count(*) OVER (PARTITION BY label) AS n, embedding AS e FROM embeddings)"


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    """path, vid, n, e: a label's vectors in order."""
    w = Window.partitionBy("label")
    e = table(spark, sf, "embeddings")
    return e.select(F.col("label").cast("string").alias("path"), (F.row_number().over(w.orderBy("vec_id")) - 1).cast("long").alias("vid"), F.count("*").over(w).alias("n"), F.col("embedding").alias("e"))


def mesh(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Vertices, and a strip of triangles, of each label."""
    m = numbered(spark, sf)
    v = m.select("path", "vid", *(F.col("e")[k].alias(c) for k, c in enumerate("xyz")))
    return v, m.where("vid + 2 < n").select("path", F.col("vid").alias("tid"), *((F.col("vid") + k).alias(c) for k, c in enumerate("abc")))


def splat_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Splats of each label: positions, scales, opacity, rotation and colour from a vector's components."""
    e = lambda k: F.col("e")[k].cast("double")
    q = [e(k) + (1.0 if k == 6 else 0.0) for k in range(6, 10)]
    size = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    named = {"x": e(0), "y": e(1), "z": e(2), "sx": 0.01 + F.abs(e(3)), "sy": 0.01 + F.abs(e(4)), "sz": 0.01 + F.abs(e(5)), **{n: c / size for n, c in zip(("qw", "qx", "qy", "qz"), q, strict=True)}, "opacity": F.least(0.02 + F.abs(e(10)), F.lit(0.98)), "r": 0.5 + e(11), "g": 0.5 + e(12), "b": 0.5 + e(13)}
    return numbered(spark, sf).select("path", F.col("vid").alias("sid"), *(c.cast("float").alias(n) for n, c in named.items()), F.array(*(F.col("e")[14 + k] for k in range(9))).alias("sh"))


def label_of(path: str = "path") -> Column:
    return F.regexp_extract(path, r"(-?[0-9]+)\.[a-z]+$", 1).cast("int").alias("label")


_CORNERS = ", ".join(f"CAST(e[{k + 1}] AS DOUBLE) AS {c}" for k, c in enumerate("xyz"))
_STRIP = f"WITH {_MESH} SELECT label, vid AS tid, vid AS a, vid + 1 AS b, vid + 2 AS c FROM m WHERE vid + 2 < n"
_POINTS = f"WITH {_MESH} SELECT label, vid, {_CORNERS} FROM m"
_wide = lambda names: [F.col(c).cast("double").alias(c) for c in names]


@query("a01_scan_obj", _POINTS)
def scan_obj(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "obj")
    mesh_files.write_obj(*mesh(spark, sf), folder)
    return read_once(meshes.scan_obj(spark, folder)[0].select(label_of(), "vid", *_wide("xyz")), folder)


@query("b05_export_obj", _STRIP)
def export_obj(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "obj")
    mesh_files.write_obj(*mesh(spark, sf), folder)
    return read_once(meshes.scan_obj(spark, folder)[1].select(label_of(), "tid", *(F.col(c).cast("long").alias(c) for c in "abc")), folder)


@query("a03_scan_ply_mesh", _POINTS)
def scan_ply_mesh(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "ply")
    mesh_files.write_ply_meshes(*mesh(spark, sf), folder)
    return read_once(meshes.scan_ply_vertices(spark, folder).select(label_of(), "vid", *_wide("xyz")), folder)


@query("b05_export_ply_mesh", _STRIP)
def export_ply_mesh(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "ply")
    mesh_files.write_ply_meshes(*mesh(spark, sf), folder)
    return read_once(meshes.scan_ply_triangles(spark, folder).select(label_of(), "tid", "a", "b", "c"), folder)


@query("a02_scan_ply_header", f"WITH {_MESH}, c AS (SELECT label, max(n) AS n FROM m GROUP BY label) SELECT label, 'vertex' AS element, n AS count, 'x,y,z' AS properties FROM c UNION ALL SELECT label, 'face', greatest(0, n - 2), 'vertex_indices' FROM c")
def scan_ply_header(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "ply")
    mesh_files.write_ply_meshes(*mesh(spark, sf), folder)
    return read_once(mesh_files.scan_ply_headers(spark, folder).select(label_of(), "element", "count", F.array_join("properties", ",").alias("properties")), folder)


@query("a05_detect_splat_ply", f"WITH {_MESH} SELECT DISTINCT label, kind, kind = 'splats' AS splats FROM m, (VALUES ('mesh'), ('splats')) k(kind)")
def detect_splat_ply(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "ply")
    mesh_files.write_ply_meshes(*mesh(spark, sf), f"{folder}/mesh")
    mesh_files.write_ply_splats(splat_rows(spark, sf), f"{folder}/splats")
    found = mesh_files.scan_ply_headers(spark, f"{folder}/*/*.ply").where("element = 'vertex'")
    return read_once(found.select(label_of(), F.regexp_extract("path", r"/([a-z]+)/[^/]*$", 1).alias("kind"), "splats"), folder)


_F = lambda x: f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"
_E = lambda k: f"CAST(e[{k + 1}] AS DOUBLE)"
_Q = [f"({_E(6)} + 1.0)", _E(7), _E(8), _E(9)]
_NORM = f"sqrt({' + '.join(f'{q} * {q}' for q in _Q)})"


@query(
    "a04_scan_ply_splat",
    f"WITH {_MESH} SELECT label, vid AS sid, {r6(_F(_E(0)), 4)} AS x, {r6(f'0.01 + abs({_E(3)})', 4)} AS sx, {r6(f'{_Q[0]} / {_NORM}', 4)} AS qw, {r6(f'{_Q[3]} / {_NORM}', 4)} AS qz, {r6(f'least(0.02 + abs({_E(10)}), 0.98)', 4)} AS opacity, {r6(f'0.5 + {_E(13)}', 4)} AS b, {r6(_E(22), 4)} AS sh FROM m",
)
def scan_ply_splat(spark: SparkSession, sf: str) -> DataFrame:
    """Splats written with their activations undone, and read back; sh is the last of the nine further coefficients."""
    folder = shared_folder(spark, "splats")
    mesh_files.write_ply_splats(splat_rows(spark, sf), folder, coefficients=3)
    found = meshes.scan_ply_splats(spark, folder).withColumn("sh", F.element_at("sh", 9))
    return read_once(found.select(label_of(), "sid", *(rounded(F.col(c).cast("double"), 4).alias(c) for c in ("x", "sx", "qw", "qz", "opacity", "b", "sh"))), folder)


@query("a07_scan_splat_file", f"WITH {_MESH} SELECT label, vid AS sid, {_F(_E(1))} AS y, {r6(_F(f'0.01 + abs({_E(5)})'))} AS sz, CAST(floor({_F(f'least(0.02 + abs({_E(10)}), 0.98)')} * 255 + 0.5) AS BIGINT) AS opacity, CAST(greatest(0, least(255, floor({_F(f'0.5 + {_E(12)}')} * 255 + 0.5))) AS BIGINT) AS g FROM m")
def scan_splat_file(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "splats")
    mesh_files.write_splats(splat_rows(spark, sf), folder)
    byte = lambda c: F.floor(F.col(c).cast("double") * 255 + 0.5).alias(c)
    return read_once(meshes.scan_splats(spark, folder).select(label_of(), "sid", F.col("y").cast("double").alias("y"), rounded(F.col("sz").cast("double")).alias("sz"), byte("opacity"), byte("g")), folder)


@query("a10_scan_ivf", f"WITH {SEQ} SELECT clip, frame, frame * 3 AS pts, event_type AS data FROM seq")
def scan_ivf(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "ivf")
    s = sequences(spark, sf).select(F.col("clip").cast("string").alias("path"), "frame", (F.col("frame") * 3).alias("pts"), F.col("event_type").cast("binary").alias("data"))
    mesh_files.write_ivf(s, folder)
    return read_once(packets.scan_ivf(spark, folder).select(label_of().cast("long").alias("clip"), "frame", "pts", F.col("data").cast("string").alias("data")), folder)


@query("a11_scan_ogg_packets", f"WITH {SEQ} SELECT clip, frame AS packet, repeat(event_type, CAST(1 + frame % 90 AS INTEGER)) AS data FROM seq")
def scan_ogg_packets(spark: SparkSession, sf: str) -> DataFrame:
    """Packets of up to several hundred bytes, which take more than one segment."""
    folder = shared_folder(spark, "ogg")
    data = F.repeat("event_type", (1 + F.col("frame") % 90).cast("int")).cast("binary")
    s = sequences(spark, sf).select(F.col("clip").cast("string").alias("path"), F.col("frame").alias("packet"), (F.col("frame") * 960).alias("granule"), data.alias("data"))
    mesh_files.write_ogg(s, folder)
    return read_once(packets.scan_ogg(spark, folder).select(label_of().cast("long").alias("clip"), "packet", F.col("data").cast("string").alias("data")), folder)
