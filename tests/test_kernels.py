"""Kernels, file formats and streaming jobs against brute force, round trips and goldens."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from frameloom.functions import cameras as C
from frameloom.functions import encodings as E
from frameloom.operators import kernels as K
from frameloom.operators import statistics as S
from frameloom.operators import windows as W
from frameloom.operators.islands import frame_groups, run_bits, run_lengths
from frameloom.sources import container, meshes, packets
from frameloom.streaming import jobs

DATA = "/root/testdata/sf0.001"


def test_first_fit():
    assert K.first_fit([(2, 2), (3, 1), (2, 2), (9, 9)], 5, 3) == [(0, 0), (2, 0), (2, 1), None]


def test_exponential_means_across_chunks(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.uniform(0, 100)) for k, n in ((1, 700), (2, 1), (3, 118)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, i long, v double")
    want = {}
    for k, i, v in rows:
        want[k, i] = v if i == 0 else want[k, i - 1] * 0.7 + v * 0.3
    got = W.ema_rows(df, ["k"], "i", "v", 0.7).collect()
    assert len(got) == len(rows) and all(abs(r["ema"] - want[r["k"], r["i"]]) < 1e-9 for r in got)
    assert all(abs(r["ema"] - want[r["k"], {1: 699, 2: 0, 3: 117}[r["k"]]]) < 1e-9 for r in W.last_ema(df, ["k"], ["i"], "v", 0.7).collect())


def test_ranks_against_sorting(spark):
    """Ties, outliers, nulls and keys of one value."""
    rng = random.Random(4)
    values = {1: [rng.gauss(0, 1) for _ in range(5000)] + [1e12, -1e12], 2: [5.0] * 300 + [6.0], 3: [7.5], 4: [rng.choice([1.0, 2.0, 3.0]) for _ in range(999)]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in [*vs, None]], "k long, v double")
    got = {r["k"]: r for r in S.ranks(df, ["k"], "v", mid=S.upper_median, p90=S.nearest_rank(0.9), p95=S.floor_rank(0.95)).collect()}
    for k, vs in values.items():
        vs, n = sorted(vs), len(vs)
        assert (got[k]["mid"], got[k]["p90"], got[k]["p95"]) == (vs[n // 2], vs[int(0.9 * (n - 1) + 0.5)], vs[min(n - 1, int(0.95 * n))])
    whole = sorted(v for vs in values.values() for v in vs)
    assert [r["mid"] for r in S.ranks(df, [], "v", mid=S.upper_median).collect()] == [whole[len(whole) // 2]]
    assert S.ranks(df.where("false"), [], "v", mid=S.upper_median).count() == 0


def test_ranks_of_odd_values(spark):
    """Concentrated values, signs, infinities, not-a-number, whole numbers and no keys; one scan and no product of tables."""
    rng = random.Random(9)
    inf = float("inf")
    values = [1000 + rng.random() * 1e-3 for _ in range(3000)] + [-x for x in (0.5, 0.25, 2.0, 1e-310)] + [0.0, -inf, inf, inf, float("nan"), 5e-324] + [2.0**k for k in range(-60, 60)] + [2.0**k * (1 - 2**-53) for k in range(-60, 60)]
    df = spark.createDataFrame([(1, v) for v in values], "k long, v double")
    order = sorted(values, key=lambda v: (v != v, v))
    for q in (0.0, 0.01, 0.05, 0.3, 0.5, 0.9, 0.97, 0.999, 1.0):
        want = order[int(q * (len(order) - 1) + 0.5)]
        for keys in ([], ["k"]):
            got = S.ranks(df, keys, "v", p=S.nearest_rank(q)).collect()
            assert [r["p"] for r in got] == [want] or (want != want and got[0]["p"] != got[0]["p"])
    assert S.ranks(df.where("v > 1e9 and v < 0"), [], "v", p=S.upper_median).count() == 0
    whole = spark.createDataFrame([(i * (2**40) % 1009, ) for i in range(1009)], "v long")
    assert S.ranks(whole, [], "v", p=S.upper_median).first()["p"] == 504
    for name in ("f14_percentiles", "f26_error_stats", "f27_edge_stretch"):
        plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin BuildRight, Inner\n" not in plan


def test_frame_groups_against_the_rule(spark):
    rng = random.Random(7)
    rows, want = [], []
    for clip in range(30):
        kinds = [rng.choice("ab") for _ in range(rng.randrange(1, 25))]
        rows += [(clip, f, k) for f, k in enumerate(kinds)]
        segments, f = [], 0
        while f < len(kinds):
            n = 1
            while f + n < len(kinds) and kinds[f + n] == kinds[f]:
                n += 1
            segments += [(f + i, min(3, n - i)) for i in range(0, n, 3)]
            f += n
        merged = []
        for start, n in segments:
            if n == 1 and merged and merged[-1][2] and merged[-1][1] < 3:
                merged[-1][1] += 1
            else:
                merged.append([start, n, n == 1])
        want += [(clip, g, s, n, single) for g, (s, n, single) in enumerate(merged)]
    got = frame_groups(spark.createDataFrame(rows, "clip long, frame long, kind string"), "clip", "frame", "kind", 3)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_run_length_golden(spark):
    bits = [0] * 4096
    for at, n in [(0, 3), (70, 130), (500, 1), (1000, 64), (2048, 900), (4090, 6)]:
        bits[at : at + n] = [1] * n
    r = spark.createDataFrame([(bits,)], "b array<int>").select(run_lengths(F.col("b")).alias("r")).select("r", run_bits(F.col("r"), F.lit(4096)).alias("b")).first()
    assert r["r"] == [0, 3, 67, 130, 300, 1, 499, 64, 984, 900, 1142, 6] and r["b"] == bits


def test_crc_and_scale_bytes(spark):
    rows = entry.queries()["c12_crc32"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id").limit(20).collect()
    assert all(r["crc"] == zlib.crc32(r["text"].encode()) for r in rows)
    s = spark.createDataFrame([(v,) for v in (0.001, 0.013, 0.1, 1.0, 10.0, 1e-9, 1e9)], "s double")
    got = s.select("s", E.scale_byte(F.col("s")).alias("b"), E.scale_of_byte(E.scale_byte(F.col("s"))).alias("v")).collect()
    assert all(abs(np.log(r["v"] / r["s"])) <= 1 / 32 + 1e-12 for r in got[:5]) and [r["b"] for r in got[5:]] == [0, 255]


def test_obj(spark, tmp_path):
    (tmp_path / "a.obj").write_text("# c\nv 0 0 0\nv 1 0 0\nv 1 1 0\nvt 0 0\nv 0 1 0\nf 1/1 2/1 3/1 4/1\nf -4 -3 -2\n")
    v, t = meshes.scan_obj(spark, str(tmp_path / "a.obj"))
    assert [tuple(r)[1:] for r in v.orderBy("vid").collect()] == [(0, 0, 0, 0), (1, 1, 0, 0), (2, 1, 1, 0), (3, 0, 1, 0)]
    assert [tuple(r)[1:] for r in t.orderBy("tid").collect()] == [(0, 0, 1, 2), (1, 0, 2, 3), (2, 0, 1, 2)]
    text = meshes.encode_obj(v, t, ["path"]).first()["text"]
    (tmp_path / "b.obj").write_text(text)
    v2, t2 = meshes.scan_obj(spark, str(tmp_path / "b.obj"))
    assert v2.drop("path").exceptAll(v.drop("path")).isEmpty() and t2.drop("path").exceptAll(t.drop("path")).isEmpty()


def test_ply(spark, tmp_path):
    head = "ply\nformat {}\nelement vertex 3\nproperty float x\nproperty uchar skip\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    body = b"".join(struct.pack("<fBff", i, 9, i + 0.5, -i) for i in range(3)) + struct.pack("<B3i", 3, 0, 1, 2)
    (tmp_path / "a.ply").write_bytes(head.format("binary_little_endian 1.0").encode() + body)
    (tmp_path / "b.ply").write_bytes(head.format("ascii 1.0").encode() + b"0 9 0.5 0\n1 9 1.5 -1\n2 9 2.5 -2\n3 0 1 2\n")
    rows = meshes.scan_ply_vertices(spark, str(tmp_path)).collect()
    assert sorted(tuple(r)[1:] for r in rows) == sorted([(i, i, i + 0.5, -i) for i in range(3)] * 2)
    assert [tuple(r)[1:] for r in meshes.scan_ply_triangles(spark, str(tmp_path)).collect()] == [(0, 0, 1, 2)] * 2
    for bad in (b"no", head.format("binary_big_endian 1.0").encode(), head.format("binary_little_endian 1.0").encode() + body[:20]):
        with pytest.raises(ValueError):
            meshes.ply_data(bad, {"x"})


def test_splat_ply_and_round_trip(spark, tmp_path):
    names = ["x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3", *(f"f_rest_{i}" for i in range(9))]
    values = np.arange(2 * len(names), dtype="<f4").reshape(2, -1) / 50
    head = "ply\nformat binary_little_endian 1.0\nelement vertex 2\n" + "".join(f"property float {n}\n" for n in names) + "end_header\n"
    (tmp_path / "s.ply").write_bytes(head.encode() + values.tobytes())
    got = meshes.scan_ply_splats(spark, str(tmp_path / "s.ply")).orderBy("sid").collect()
    v = dict(zip(names, values[1].astype(float), strict=True))
    assert abs(got[1]["opacity"] - 1 / (1 + np.exp(-v["opacity"]))) < 1e-6 and abs(got[1]["sx"] - np.exp(v["scale_0"])) < 1e-5
    assert np.allclose(got[1]["sh"], [v[f"f_rest_{ch * 3 + k}"] for k in range(3) for ch in range(3)])
    files = meshes.encode_splat(meshes.scan_ply_splats(spark, str(tmp_path / "s.ply"))).collect()
    again = meshes.decode_splat(bytes(files[0]["content"]))
    assert np.allclose(again["x"], [r["x"] for r in got]) and np.allclose(again["opacity"], [r["opacity"] for r in got], atol=1 / 255)
    with pytest.raises(ValueError):
        meshes.decode_splat(b"123")


def test_packets(spark, tmp_path):
    ivf = b"DKIF" + struct.pack("<HH4sHHIIII", 0, 32, b"AV01", 8, 8, 30, 1, 2, 0) + b"".join(struct.pack("<IQ", len(d), t) + d for t, d in ((0, b"abc"), (1, b""))) + b"\x09\x00"
    (tmp_path / "v.ivf").write_bytes(ivf)
    assert [(r["frame"], r["pts"], bytes(r["data"])) for r in packets.scan_ivf(spark, str(tmp_path / "v.ivf")).collect()] == [(0, 0, b"abc"), (1, 1, b"")]
    long = bytes(range(256)) * 2

    def page(serial, sizes, body):
        return b"OggS" + struct.pack("<BBqIII", 0, 0, 0, serial, 0, 0) + bytes([len(sizes), *sizes]) + body

    ogg = page(7, [3, 255], b"one" + long[:255]) + page(8, [1], b"x") + page(7, [255, 2], long[255:])
    got = packets.ogg_packets(ogg)
    assert list(zip(got["serial"], got["packet"], got["data"], strict=True)) == [(7, 0, b"one"), (8, 0, b"x"), (7, 1, long)]


def test_container(spark):
    chunks = [(0, 0, 2, (0.0, 0, 0, 1, 1, 1), container.chunk(0, 2, (0.0, 0, 0, 1, 1, 1), [(0, 0, b"I"), (1, 0, b"PP")])), (66667, 2, 1, (-1.0, 0, 0, 0, 2, 0), container.chunk(66667, 1, (-1.0, 0, 0, 0, 2, 0), [(0, 0, b"I2")]))]
    content = container.assemble(chunks, 30.0, 14, 2, {"k": "v", "é": "ü"}, [(0, 0, "RAW0", 0, b"cfg")])
    p = container.parse(content)
    assert p["header"]["frames"] == 3 and p["header"]["duration_us"] == 100000 and p["header"]["box"] == (-1, 0, 0, 1, 2, 1)
    assert p["meta"] == {"k": "v", "é": "ü"} and p["tracks"] == [(0, 0, "RAW0", 0, b"cfg")]
    assert [b[5] for b in p["blocks"]] == [b"I", b"PP", b"I2"]
    rng = random.Random(1)
    for _ in range(240):
        bad = bytearray(content)
        for _ in range(rng.randrange(1, 4)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        try:
            container.parse(bytes(bad[: rng.randrange(len(bad))] if rng.random() < 0.3 else bad))
        except ValueError:
            pass
    with pytest.raises(container.Damaged):
        container.parse(content[:40])


def stream(spark, tmp_path, batches, schema, job, mode):
    """Rows of a job fed with batches in turn."""
    source = tmp_path / "in"
    source.mkdir()
    name = f"t{abs(hash(str(tmp_path)))}"
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    q = job(df).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for k, rows in enumerate(batches):
            (source / f"{k}.json").write_text("\n".join(rows))
            q.processAllAvailable()
        return [tuple(r) for r in spark.sql(f"SELECT * FROM {name}").collect()]
    finally:
        q.stop()


def test_groups_are_held_back(spark, tmp_path):
    row = lambda c, f: f'{{"clip": {c}, "frame": {f}}}'
    got = stream(spark, tmp_path, [[row(1, 0), row(1, 1)], [row(1, 2), row(2, 0)], [row(1, 4), row(1, 3), row(2, 1), row(2, 2)]], "clip long, frame long", lambda d: jobs.hold_back_groups(d, 3), "append")
    assert sorted(got) == [(1, 0, 3), (2, 0, 3)]


def test_track_runs(spark, tmp_path):
    row = lambda f, own=False: f'{{"object": 1, "frame": {f}, "own": {str(own).lower()}}}'
    got = stream(spark, tmp_path, [[row(5, True), row(6)], [row(8)], [row(7), row(5)]], "object long, frame long, own boolean", jobs.track_runs, "update")
    assert got == [(1, 5, 6, 1), (1, 5, 6, 1), (1, 8, 8, 0), (1, 5, 8, 1)]


def test_late_packets_are_dropped(spark, tmp_path):
    row = lambda t: f'{{"clip": 1, "ts": "2024-01-01T00:{t:02d}:00Z", "bytes": 2}}'
    got = stream(spark, tmp_path, [[row(0), row(1)], [row(30)], [row(2), row(31)], [row(59)]], "clip long, ts timestamp, bytes long", lambda d: jobs.on_time_packets(d, "5 minutes", "10 minutes"), "append")
    assert [(r[2], r[3]) for r in sorted(got, key=lambda r: r[1].start)] == [(2, 4), (2, 4)]


def test_a_point_in_the_cameras_plane(spark):
    """Its w is 0; under ANSI rules a division by it would end the job."""
    view, projection = C.orbit(0.0, 0.0, 1.0, (0, 0, 0), 1.0)
    m = projection @ view
    df = spark.createDataFrame([(0.3, 0.2, 1.0), (0.0, 0.0, 0.0), (0.0, 0.0, 2.0)], "x double, y double, z double")
    p = [F.col(c) for c in "xyz"]
    got = df.select(C.mask_distance(p, m, rect=(-1, -1, 1, 1)).alias("d"), C.mask_distance(p, m, bits=np.ones((2, 2), bool)).alias("b"), C.projected(C.transformed(m, p)[:3], C.transformed(m, p)[3])[0].alias("nx")).collect()
    assert [(r["d"], r["b"]) for r in got] == [(1.0, 1.0), (-1.0, -0.5), (1.0, 1.0)] and got[0]["nx"] is None


def test_cameras():
    """The target is in the picture's middle, a point at the right edge of the view height is where it should be, and planes are at depth 0 and 1."""
    for ortho in (False, True):
        view, projection = C.orbit(0.3, -0.4, 2.0, (1.0, 2.0, 3.0), 1.5, ortho, 40.0)
        clip = projection @ view
        seen = lambda p: (lambda q: q[:3] / q[3])(clip @ np.append(p, 1.0))  # noqa: B023, E731
        assert np.allclose(seen([1, 2, 3])[:2], 0) and np.allclose(view[:3, :3] @ view[:3, :3].T, np.eye(3))
        half = 2.0 * np.tan(np.radians(20))
        assert np.allclose(seen(np.array([1, 2, 3]) + 1.5 * half * view[0, :3])[:2], [1, 0]) and np.allclose(seen(np.array([1, 2, 3]) + half * view[1, :3])[:2], [0, 1])
        for depth, z in ((0.02, 0), (40.0, 1)):
            assert np.isclose(seen(np.array([1, 2, 3]) + (2.0 - depth) * view[2, :3])[2], z)
        assert np.allclose(C.inverse(clip) @ clip, np.eye(4), atol=1e-9)
    assert C.inverse(np.zeros((4, 4))) is None
