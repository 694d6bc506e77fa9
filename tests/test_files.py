"""Clip files and depth runs: against a whole-file writer and parser, cut files, ranges, holes and tasks that run twice."""

import json
import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from frameloom.sources import clips, container, depth_runs, mesh_files, meshes, packets, pieces


def rows_of(n, clip=1):
    return [(clip, i, float(i), 0.0, -1.0, i + 2.0, 1.0, 1.0, bytes([i % 251]) * (i % 7)) for i in range(n)]


FRAMES = "clip long, frame long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, data binary"


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(rows_of(23) + rows_of(1, 2) + rows_of(8, -3), FRAMES).repartition(5)


def side(spark):
    texture = spark.createDataFrame([(1, i, i % 5 == 0, b"t" * i) for i in range(23)], "clip long, frame long, is_key boolean, data binary")
    audio = spark.createDataFrame([(1, p, 20000, b"a%d" % p) for p in (0, 133332, 133333, 133334, 266667, 700000, 766667, 5_000_000)], "clip long, pts long, duration int, data binary")
    return texture, audio


def test_files_are_what_a_whole_file_writer_makes(spark, frames, tmp_path):
    clips.write_clips(clips.chunks(frames, 30.0, 4), str(tmp_path), 30.0, 4)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["-3.clip", "1.clip", "2.clip"]
    for clip, n in ((1, 23), (2, 1), (-3, 8)):
        rows, made = rows_of(n, clip), []
        for g in range(0, n, 4):
            part = rows[g : g + 4]
            box = tuple(float(min(r[k] for r in part)) for k in (2, 3, 4)) + tuple(float(max(r[k] for r in part)) for k in (5, 6, 7))
            start = round(g * 1e6 / 30)
            made.append((start, g, len(part), box, container.chunk(start, len(part), box, [(int(r[1] % 4 > 0), 0, r[8]) for r in part])))
        tracks = [(0, 0, "RAW0", 0, b""), (1, 1, "TEX0", 0, b""), (2, 2, "AUD0", 0, b"")]
        assert (tmp_path / f"{clip}.clip").read_bytes() == container.assemble(made, 30.0, 14, 4, {"gop_length": "4"}, tracks)


def test_round_trip_with_side_tracks_and_a_move(spark, frames, tmp_path):
    texture, audio = side(spark)
    clips.write_clips(clips.chunks(frames, 30.0, 4, texture, audio), str(tmp_path), 30.0, 4, shift=(10.0, 0.0, -2.0))
    parsed = container.parse((tmp_path / "1.clip").read_bytes())
    assert parsed["header"]["box"] == (10.0, 0.0, -3.0, 34.0, 1.0, -1.0) and parsed["header"]["frames"] == 23
    index = clips.scan_index(spark, str(tmp_path))
    blocks = clips.scan_chunks(index)
    got = clips.geometry_frames(blocks).where("path like '%/1.clip'").collect()
    assert sorted((r["frame"], r["intra"], bytes(r["data"])) for r in got) == [(i, i % 4 == 0, r[8]) for i, r in enumerate(rows_of(23))]
    assert sorted((r["frame"], r["is_key"], bytes(r["data"])) for r in clips.texture_frames(blocks).collect()) == [(i, i % 5 == 0, b"t" * i) for i in range(23)]
    assert sorted((r["pts"], r["duration"], bytes(r["data"])) for r in clips.audio_packets(blocks).collect()) == sorted((r["pts"], 20000, bytes(r["data"])) for r in audio.collect())
    # A packet belongs to the chunk whose rounded time it starts in, those behind the end to the last one.
    where = {r["gop"]: len(clips.audio_entries(bytes(r["data"]))) for r in blocks.where(F.col("type") == clips.AUDIO).collect()}
    assert where == {0: 2, 1: 2, 2: 1, 5: 3}
    assert {tuple(r["box"]) for r in blocks.where("path like '%/1.clip' and gop = 1").collect()} == {(14.0, 0.0, -3.0, 19.0, 1.0, -1.0)}


def test_a_long_clip_is_laid_out_in_runs(spark, tmp_path):
    n = 2 * clips.RUN + 5
    df = spark.range(n).select(F.lit(7).cast("long").alias("clip"), F.col("id").alias("frame"), *(F.lit(0.0).alias(c) for c in ("x0", "y0", "z0", "x1", "y1", "z1")), F.col("id").cast("string").cast("binary").alias("data"))
    clips.write_clips(clips.chunks(df, 30.0, 1), str(tmp_path), 30.0, 1)
    parsed = container.parse((tmp_path / "7.clip").read_bytes())
    assert [b[5] for b in parsed["blocks"]] == [str(i).encode() for i in range(n)]
    some = clips.scan_index(spark, str(tmp_path)).where("frame_start between 4090 and 4100")
    assert sorted(int(bytes(r["data"])) for r in clips.scan_chunks(some).collect()) == list(range(4090, 4101))
    laid = clips.places(clips.chunks(df, 30.0, 1).drop("body"), 0)
    assert laid.groupBy("run").count().agg(F.max("count")).first()[0] == clips.RUN


def test_damaged_clips(spark, frames, tmp_path):
    clips.write_clips(clips.chunks(frames, 30.0, 4), str(tmp_path), 30.0, 4)
    whole = (tmp_path / "1.clip").read_bytes()
    for name, content in (("cut", whole[:-1]), ("head", whole[:40]), ("sum", whole[:20] + b"\xff" + whole[21:]), ("magic", b"XXXX" + whole[4:])):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "1.clip").write_bytes(content)
        with pytest.raises(Exception, match="Damaged"):
            clips.scan_index(spark, str(folder)).collect()
    with pytest.raises(ValueError, match="65535"):
        clips.audio_block([(0, 1, b"x" * 65536)], 0)
    with pytest.raises(container.Damaged):
        clips.texture_entries(clips.texture_block([(b"abc", True)])[:-1])


def batch(*rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))], ["file", "at", "data"])


def test_pieces_commit_in_two_phases(tmp_path):
    w = pieces.PieceWriter({"path": f"file://{tmp_path}"})
    first, second = batch(("a/x", 3, b"def"), ("y", 0, b"1")), batch(("a/x", 0, b"abc"))
    w.write(iter([first]))  # a task that is lost after it has written
    told = [w.write(iter([first])), w.write(iter([second]))]
    assert not (tmp_path / "a/x").exists()
    w.commit(told)
    assert (tmp_path / "a/x").read_bytes() == b"abcdef" and (tmp_path / "y").read_bytes() == b"1"
    assert not list(tmp_path.rglob("*.part"))
    for bad in (batch(("z", 2, b"c")), batch(("z", 0, b"ab"), ("z", 1, b"b"))):  # a hole, an overlap
        w = pieces.PieceWriter({"path": str(tmp_path)})
        with pytest.raises(ValueError, match="holes or overlap"):
            w.commit([w.write(iter([bad])), None])
        assert not (tmp_path / "z").exists() and not list(tmp_path.rglob("*.part"))
    with pytest.raises(ValueError, match="random access"):
        pieces.PieceWriter({"path": "s3://bucket/x"})


# Depth runs.


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """One run of 9 frames of 4 x 3 pixels with every plane, and a plain one."""
    folder = tmp_path_factory.mktemp("runs")
    rng = np.random.default_rng(0)
    rows = [(i, rng.random(12).astype("f4").tolist(), bytes(rng.choice([0, 255], 12).astype("u1")), rng.random(12).astype("f4").tolist(), bytes(36), [1.0, 1.0, 0.5, i / 9], rng.random(6).astype("f4").tolist(), i % 2 == 0) for i in range(9)]
    schema = "frame long, d array<float>, mask binary, metric array<float>, normals binary, k array<float>, body array<float>, body_valid boolean"
    df = spark.createDataFrame(rows, schema).withColumn("run", F.lit("full")).repartition(4)
    depth_runs.write_depth_runs(df, str(folder), 4, 3, intrinsics={"fx": 1.0, "fy": 1.2, "cx": 0.5, "cy": 0.5}, vertices=2, faces=np.array([[0, 1, 0]]))
    depth_runs.write_depth_runs(df.select(F.lit("plain").alias("run"), "frame", "d"), str(folder), 4, 3, kind="metric-depth")
    return folder, rows


def test_depth_round_trip(spark, run):
    folder, rows = run
    planes = ("depth", "mask", "metric", "normals", "intrinsics", "body")
    got = {(r["run"], r["frame"]): r for r in depth_runs.scan_depth_runs(spark, str(folder), planes, split=500).collect()}
    assert len(got) == 18
    for r in rows:
        full, plain = got["full", r[0]], got["plain", r[0]]
        assert np.allclose(full["d"], r[1]) and bytes(full["mask"]) == r[2] and np.allclose(full["metric"], r[3]) and bytes(full["normals"]) == r[4]
        assert np.allclose(full["k"], r[5]) and np.allclose(full["body"], r[6]) and full["body_valid"] == r[7]
        assert np.allclose(plain["d"], r[1]) and plain["mask"] is None and plain["body"] is None and plain["kind"] == "metric-depth"
    assert (folder / "full/body-faces.u32").read_bytes() == np.array([0, 1, 0], "<u4").tobytes()


def test_a_range_of_frames_reads_its_bytes_only(run):
    folder, _ = run
    reader = depth_runs.DepthReader({"path": str(folder / "full"), "planes": "depth,mask", "first": "3", "end": "7", "split": "120"})
    parts = reader.partitions()
    assert [(p.first, p.end) for p in parts] == [(3, 5), (5, 7)] and all(set(p.planes) == {"depth", "mask"} for p in parts)
    assert sum(p.end - p.first for p in depth_runs.DepthReader({"path": str(folder / "full"), "planes": "depth", "first": "8"}).partitions()) == 1
    assert depth_runs.DepthReader({"path": str(folder / "full"), "planes": "depth", "first": "9"}).partitions() == []


def damaged(run, tmp_path, cut=None, **meta):
    """A copy of the full run with files cut by some bytes and other sidecar values."""
    target = tmp_path / f"r{len(list(tmp_path.iterdir()))}"
    target.mkdir()
    for f in (run[0] / "full").iterdir():
        content = f.read_bytes()
        target.joinpath(f.name).write_bytes(content[: len(content) - (cut or {}).get(f.name, 0)])
    side = json.loads((target / "depth.json").read_text()) | meta
    (target / "depth.json").write_text(json.dumps(side))
    return str(target)


def test_sidecar_and_sizes(spark, run, tmp_path):
    frames_of = lambda path: sum(p.end - p.first for p in depth_runs.DepthReader({"path": path, "planes": "depth"}).partitions())
    assert frames_of(damaged(run, tmp_path)) == 9
    # A run that is being written gives its whole frames; a longer file than declared the declared ones.
    assert frames_of(damaged(run, tmp_path, {"depth.f32": 50}, done=False)) == 7
    assert frames_of(damaged(run, tmp_path, frames=5)) == 5
    bad = [
        ({"depth.f32": 1}, {}), ({"depth.f32": 48}, {}), ({"depth.f32": 9 * 48}, {"done": False}), ({"mask.u8": 1}, {}), ({"metric.f32": 4}, {}), ({"normals.i8": 1}, {}), ({"intrinsics.f32": 1}, {}), ({"body.f32": 1}, {}),
        ({"body-valid.u8": 1}, {}), ({"body-faces.u32": 1}, {}), ({}, {"schema": "x"}), ({}, {"kind": "x"}), ({}, {"width": 0}), ({}, {"height": 2.5}), ({}, {"frames": "9"}), ({}, {"fps": 0}), ({}, {"metric": {"file": "none.f32"}}),
        ({}, {"metric": {}, "normals": {"file": ""}}), ({}, {"intrinsics": {"fx": -1, "fy": 1, "cx": 0, "cy": 0}}),
    ]
    for cut, meta in bad:
        with pytest.raises(depth_runs.BadRun):
            frames_of(damaged(run, tmp_path, cut, **meta))


def test_runs_of_another_schema(spark, run, tmp_path):
    path = damaged(run, tmp_path, schema="other/2")
    assert depth_runs.scan_depth_runs(spark, path, schema="other/2").count() == 9
    depth_runs.write_depth_runs(spark.createDataFrame([("a", 0, [0.0] * 12)], "run string, frame long, d array<float>"), str(tmp_path / "w"), 4, 3, schema="other/2")
    assert json.loads((tmp_path / "w/a/depth.json").read_text())["schema"] == "other/2"


def test_missing_and_repeated_frames_are_refused(spark, run, tmp_path):
    rows = spark.createDataFrame([("a", i, [0.0] * 12) for i in (0, 1, 3)], "run string, frame long, d array<float>")
    for frames in (rows, rows.where("frame < 2").union(rows.where("frame = 1"))):
        with pytest.raises(Exception, match="holes or overlap"):
            depth_runs.write_depth_runs(frames, str(tmp_path), 4, 3)
        assert not [p for p in tmp_path.rglob("*") if p.is_file()]
    with pytest.raises(Exception, match="has 40 bytes, not 48"):
        depth_runs.write_depth_runs(spark.createDataFrame([("a", 0, [0.0] * 10)], "run string, frame long, d array<float>"), str(tmp_path), 4, 3)
    assert Counter(p.suffix for p in tmp_path.rglob("*") if p.is_file()) == Counter()


# Meshes, splats and packets.


def mesh_of(spark, n):
    v = spark.range(n).select(F.lit("m").alias("path"), F.col("id").alias("vid"), *((F.col("id") * k / 7).cast("float").alias(c) for k, c in enumerate("xyz", 1)))
    return v, v.where(F.col("vid") < n - 2).select("path", F.col("vid").alias("tid"), *((F.col("vid") + k).alias(c) for k, c in enumerate("abc")))


def test_meshes_longer_than_a_run(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mesh_files, "RUN", 64)
    v, t = mesh_of(spark, 1000)
    v, t = v.repartition(5), t.repartition(3)
    mesh_files.write_ply_meshes(v, t, str(tmp_path / "p"))
    mesh_files.write_obj(v, t, str(tmp_path / "o"))
    content = (tmp_path / "p/m.ply").read_bytes()
    columns, faces = meshes.ply_data(content, {"x", "y", "z"})
    assert np.allclose(columns["y"], np.arange(1000) * 2 / 7) and [f.tolist() for f in faces] == [[i, i + 1, i + 2] for i in range(998)]
    text = (tmp_path / "o/m.obj").read_text().splitlines()
    assert len(text) == 1 + 1000 + 998 and text[1:3] == ["v 0.0 0.0 0.0", "v 0.14285715 0.2857143 0.42857143"] and text[-1] == "f 998 999 1000"
    got = meshes.scan_obj(spark, str(tmp_path / "o"))[0].orderBy("vid").collect()
    assert np.allclose([r["z"] for r in got], np.arange(1000) * 3 / 7)
    for bad in (v.where("vid != 70"), v.union(v.where("vid = 70"))):
        with pytest.raises(Exception, match="gaps or repeat|holes or overlap"):
            mesh_files.write_ply_meshes(bad, t, str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").glob("*.ply"))


def test_splats_with_coefficients(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(50):
        q = rng.normal(0, 1, 4)
        rows.append(("s", i, *map(float, rng.random(3)), *map(float, 0.01 + rng.random(3)), *map(float, q / np.linalg.norm(q)), float(rng.choice([0.0, 1.0, rng.random()])), *map(float, rng.random(3)), [float(x) for x in rng.random(24)]))
    df = spark.createDataFrame(rows, meshes.SPLAT_SCHEMA)
    mesh_files.write_ply_splats(df, str(tmp_path / "p"), coefficients=8)
    mesh_files.write_splats(df, str(tmp_path / "s"))
    got = meshes.scan_ply_splats(spark, str(tmp_path / "p")).orderBy("sid").collect()
    for r, want in zip(got, rows, strict=True):
        assert np.allclose(list(r)[2:12], want[2:12], atol=1e-5) and abs(r["opacity"] - want[12]) < 2e-6 and np.allclose([r["r"], r["g"], r["b"]], want[13:16], atol=1e-5) and np.allclose(r["sh"], want[16], atol=1e-6)
    less = meshes.scan_splats(spark, str(tmp_path / "s")).orderBy("sid").collect()
    assert all(np.allclose([r["qx"], r["qw"]], [w[8], w[11]], atol=0.02) and abs(r["opacity"] - w[12]) <= 1 / 510 + 1e-6 for r, w in zip(less, rows, strict=True))
    # The whole-file encoder makes the same bytes.
    whole = bytes(meshes.encode_splat(df).first()["content"])
    assert (tmp_path / "s/s.splat").read_bytes() == whole


def test_packet_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mesh_files, "RUN", 16)
    data = [bytes([i % 256]) * (i * 37 % 700) for i in range(90)] + [b"x" * 65000]
    df = spark.createDataFrame([("a", i, i * 10, d) for i, d in enumerate(data)], "path string, n long, pts long, data binary").repartition(4)
    mesh_files.write_ivf(df.withColumnRenamed("n", "frame"), str(tmp_path))
    mesh_files.write_ogg(df.select("path", F.col("n").alias("packet"), F.col("pts").alias("granule"), "data"), str(tmp_path))
    got = packets.scan_ivf(spark, str(tmp_path / "a.ivf")).orderBy("frame").collect()
    assert [(r["pts"], bytes(r["data"])) for r in got] == [(i * 10, d) for i, d in enumerate(data)]
    raw = (tmp_path / "a.ogg").read_bytes()
    found = packets.ogg_packets(raw)
    assert found["data"] == data
    assert raw[5] == 2 and raw[raw.rindex(b"OggS") + 5] == 4
    with pytest.raises(ValueError, match="fit in a page"):
        mesh_files.ogg_page(1, 0, b"x" * 65025, 0, 0)


def test_an_ogg_page_has_the_known_checksum():
    """Bit by bit, with the checksum's place left zero."""
    page = mesh_files.ogg_page(7, 3, b"abc", 960, 0)
    c = 0
    for byte in page[:22] + bytes(4) + page[26:]:
        for k in range(7, -1, -1):
            top = (c >> 31) ^ (byte >> k & 1)
            c = (c << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if top else 0)
    assert page[22:26] == c.to_bytes(4, "little")


def test_small_pieces_are_put_together(tmp_path, monkeypatch):
    """A batch for each chunk and a write for each piece made long clips slow."""
    one = lambda name, at, data: pa.RecordBatch.from_pydict({"file": [name], "at": pa.array([at], pa.int64()), "data": pa.array([data], pa.binary())})
    rows = [one("a", 2 * i, b"xy") for i in range(500)] + [one("a", 2000, b"end"), one("b", 0, b"z")]
    batches = list(pieces.gathered(lambda x: x)(iter(rows)))
    assert len(batches) == 1 and batches[0].num_rows == 502
    writes, real = [], pieces.os.pwrite
    monkeypatch.setattr(pieces.os, "pwrite", lambda h, c, at: (writes.append((at, len(c))), real(h, c, at))[1])
    told = pieces.PieceWriter({"path": str(tmp_path)}).write(iter(batches))
    assert writes == [(0, 1000), (2000, 3), (0, 1)] and told.sizes == {"a": 1003, "b": 1}


def test_many_short_files_are_few_tasks(spark, tmp_path):
    """A task for every 32 files made the reading of many short clips slow."""
    for i in range(200):
        (tmp_path / f"{i}.clip").write_bytes(b"x")
        (tmp_path / f"{i}.ogg").write_bytes(b"x")
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for found in (clips.scan_index(spark, str(tmp_path)), clips.scan_tracks(spark, str(tmp_path)), packets.scan_ogg(spark, str(tmp_path))):
        assert found.rdd.getNumPartitions() <= most


def test_a_short_clip_is_written_at_once(spark, tmp_path, monkeypatch):
    """Index entries in one task, a piece for each chunk and parts in one folder made many short clips slow."""
    laid, real = [], clips.save_pieces
    monkeypatch.setattr(clips, "save_pieces", lambda df, folder, **k: (laid.extend((r[0], r[1], len(r[2]), r[3]) for r in df.select("file", "at", "data", F.spark_partition_id()).collect()), real(df, folder, **k)))
    df = spark.range(4000).select((F.col("id") % 200).alias("clip"), F.floor(F.col("id") / 200).alias("frame"), *(F.lit(0.0).alias(c) for c in ("x0", "y0", "z0", "x1", "y1", "z1")), F.lit(b"abc").alias("data"))
    clips.write_clips(clips.chunks(df, 30.0, 2), str(tmp_path), 30.0, 2)
    assert Counter(p[0] for p in laid) == {f"{c}.clip": 4 for c in range(200)} and len({p[3] for p in laid}) > 1
    for a, b in zip(laid, laid[1:]):
        assert a[0] != b[0] or a[1] + a[2] == b[1]
    assert [b[5] for b in container.parse((tmp_path / "7.clip").read_bytes())["blocks"]] == [b"abc"] * 20


def test_values_that_no_layout_holds_are_refused(spark, tmp_path):
    good = {"clip": 1, "frame": 0, "x0": 0.0, "y0": 0.0, "z0": 0.0, "x1": 1.0, "y1": 1.0, "z1": 1.0, "data": b"a"}
    for changed in ({"x1": 1e300}, {"x0": None}, {"frame": 1 << 33}):
        bad = spark.createDataFrame([tuple((good | changed).values())], FRAMES)
        with pytest.raises(Exception, match="range of floats|no frames|don't fit"):
            clips.write_clips(clips.chunks(bad, 30.0, 1), str(tmp_path), 30.0, 1)
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_part_files_are_spread_over_folders(tmp_path):
    w = pieces.PieceWriter({"path": str(tmp_path)})
    told = w.write(iter([batch(*((f"{i}.clip", 0, b"x") for i in range(300)), ("d/9.clip", 0, b"x"))]))
    assert len({p.parent for p in tmp_path.rglob("*.clip")}) > 100
    w.commit([told])
    assert len(list(tmp_path.glob("*.clip"))) == 300 and (tmp_path / "d/9.clip").exists() and not list(tmp_path.rglob("*.part"))


def test_a_short_clip_is_read_with_one_call(spark, frames, tmp_path, monkeypatch):
    """Four calls and a batch for each file, a call for each chunk and a second look at the index made many short clips slow."""
    clips.write_clips(clips.chunks(frames, 30.0, 4), str(tmp_path), 30.0, 4)
    reads, real = [], os.pread
    monkeypatch.setattr(os, "pread", lambda h, size, at: (reads.append((size, at)), real(h, size, at))[1])
    path = str(tmp_path / "1.clip")
    size = os.path.getsize(path)
    runs = list(clips._index_runs(path, size, container.MAGIC))
    assert reads == [(size, 0)] and clips._index_batch(runs * 3).column("gop").to_pylist() == [*range(6)] * 3
    index = clips.scan_index(spark, str(tmp_path))
    got = clips.scan_chunks(index.withColumnRenamed("box", "whole"), keep=["whole"]).where("place = 0").collect()
    want = {(r["path"], r["gop"]): r["box"] for r in index.collect()}
    assert {(r["path"], r["gop"]): r["whole"] for r in got} == want and len(got) == len(want) == 9


def test_damaged_chunks(spark, frames, tmp_path):
    clips.write_clips(clips.chunks(frames, 30.0, 4), str(tmp_path), 30.0, 4)
    path = tmp_path / "1.clip"
    whole = path.read_bytes()
    at = container.parse(whole)["gops"][3][4]
    entry = at + container.CHUNK.size
    for changed in (whole[:at] + b"XXXX" + whole[at + 4 :], whole[: at + 40] + b"\xff\xff" + whole[at + 42 :], whole[: entry + 7] + b"\xff\xff\xff\xff" + whole[entry + 11 :]):
        path.write_bytes(changed)
        with pytest.raises(Exception, match="Damaged"):
            clips.scan_chunks(clips.scan_index(spark, str(tmp_path))).collect()


def test_packets_are_packed_by_several_tasks(spark):
    """Packets of repeated bytes are so few bytes in a shuffle that one task had all of them."""
    df = spark.range(2000).select((F.col("id") % 100).cast("string").alias("path"), F.floor(F.col("id") / 100).alias("n"), F.lit(b"a" * 100).alias("data"))
    runs = mesh_files._packed(df, "n", ["data"], lambda r: r["data"]).select("path", F.length("body").alias("length"), F.spark_partition_id().alias("task")).collect()
    assert {(r["path"], r["length"]) for r in runs} == {(str(k), 2000) for k in range(100)} and len(runs) == 100
    assert len({r["task"] for r in runs}) > 1
