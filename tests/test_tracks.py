"""Tile fields along clips and colours on meshes against plain loops."""

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from frameloom.operators import scans, splats, tiles
from frameloom.operators import tracks as T
from frameloom.plans import tracks as plans

DATA = "/root/testdata/sf0.001"


def clip_of(spark, a, kinds=None, medres=None, clip=1):
    n = len(a)
    kinds, medres = kinds or ["linear"] * n, medres or [0.01] * n
    frames = spark.createDataFrame([(clip, t, k, float(m)) for t, (k, m) in enumerate(zip(kinds, medres, strict=True))], "clip long, frame long, kind string, medres double")
    fields = spark.createDataFrame([(clip, t, tile, float(v) + tile, 0.5, 1.0) for t, v in enumerate(a) if kinds[t] for tile in (0, 1)], "clip long, frame long, tile int, a double, b double, w double")
    return fields, frames


def smoothed(spark, radius, *args, **kwargs):
    rows = T.smooth_tile_fields(*clip_of(spark, *args, **kwargs), radius).where("tile = 0").orderBy("frame").collect()
    return [round(r["a"], 9) for r in rows], [r["own"] for r in rows], {r["kind"] for r in rows}


def test_spikes_go_and_steps_stay(spark):
    base = [1.0, 1.001, 0.999, 1.0, 1.002, 1.0, 0.998, 1.0, 1.001, 1.0, 1.0, 0.999]
    spiked = base.copy()
    spiked[5] = 3.0
    weights = [math.exp(-k * k / (2 * 0.5**2)) for k in (1, 0, 1)]
    mean = lambda v, t: sum(w * v[t + k] for w, k in zip(weights, (-1, 0, 1), strict=True) if 0 <= t + k < len(v)) / sum(w for w, k in zip(weights, (-1, 0, 1), strict=True) if 0 <= t + k < len(v))
    mended = [*base[:5], (base[4] + base[6]) / 2, *base[6:]]
    got, own, _ = smoothed(spark, 1, spiked)
    assert np.allclose(got, [mean(mended, t) for t in range(12)]) and all(own)
    step = [1.0] * 5 + [2.0] * 4 + [1.0] * 5
    assert np.allclose(smoothed(spark, 1, step)[0], [mean(step, t) for t in range(14)])
    # Two frames are too few to judge.
    assert np.allclose(smoothed(spark, 1, [1.0, 9.0])[0], [mean([1.0, 9.0], t) for t in range(2)])


def test_the_majority_fills_the_others(spark):
    kinds = ["disparity", "linear", None, "disparity", "linear", "linear", "disparity"]
    a = [9, 1.0, 0, 9, 4.0, 5.0, 9]
    got, own, kind = smoothed(spark, 0, a, kinds, [0.5, 0.1, 0, 0.5, 0.1, 0.1, 0.5])  # three each: the smaller residual
    assert kind == {"linear"} and own == [False, True, False, False, True, True, False]
    assert np.allclose(got, [1, 1, 2, 3, 4, 5, 5])
    assert smoothed(spark, 0, a, kinds, [0.01, 0.1, 0, 0.01, 0.1, 0.1, 0.01])[2] == {"disparity"}
    fields, frames = clip_of(spark, [1.0, 2.0], [None, None])
    assert T.smooth_tile_fields(fields, frames, 2).count() == 0


def brute_colours(v, normals, pictures, sides, f, c, size):
    total = defaultdict(lambda: np.zeros(4))
    for key, (x, y, z) in v.items():
        frame, vid = key
        n = np.array(normals[key])
        if z <= 1e-6 or not n.any():
            continue
        cos = -(n @ (x, y, z)) / (np.linalg.norm(n) * np.linalg.norm((x, y, z)))
        u, w = f * x / z + c, f * y / z + c
        p = pictures.get((frame, math.floor(u), math.floor(w)))
        if not cos > 0.2 or p is None or not p[3] or z - p[4] > max(0.02, 0.01 * z):
            continue
        sx, sy = (min(size - 1, max(0, q - 0.5)) for q in (u, w))
        x0, y0 = math.floor(sx), math.floor(sy)
        got, ws = np.zeros(3), 0
        for dx in (0, 1):
            for dy in (0, 1):
                t = (sx - x0 if dx else 1 - sx + x0) * (sy - y0 if dy else 1 - sy + y0)
                q = pictures[frame, min(size - 1, x0 + dx), min(size - 1, y0 + dy)]
                if t > 0 and q[3]:
                    got, ws = got + t * np.array(q[:3]), ws + t
        if ws > 0:
            total[vid] += np.append(cos * cos * got / ws, cos * cos)
    colour = {k: (t[:3] / t[3], 0) for k, t in total.items()}
    near = defaultdict(set)
    for p, q in sides:
        near[p].add(q)
        near[q].add(p)
    ring = 0
    while True:
        ring += 1
        new = {k: np.mean([colour[o][0] for o in near[k] if o in colour], 0) for k in near if k not in colour and any(o in colour for o in near[k])}
        if not new:
            break
        colour |= {k: (v, ring) for k, v in new.items()}
    rest = np.mean([c for c, r in colour.values() if r == 0], 0)
    return {vid: ([int(min(255, max(0, math.floor(x + 0.5)))) for x in colour.get(vid, (rest, -1))[0]], colour.get(vid, (rest, -1))[1]) for _, vid in v}


def test_body_colours_against_a_loop(spark):
    v, normals, pictures, sides = (d.collect() for d in plans.body(spark, DATA))
    want = brute_colours(
        {(r["frame"], r["vid"]): (r["x"], r["y"], r["z"]) for r in v}, {(r["frame"], r["vid"]): (r["nx"], r["ny"], r["nz"]) for r in normals},
        {(r["frame"], r["px"], r["py"]): (r["r"], r["g"], r["b"], r["on"], r["zbuf"]) for r in pictures}, [(r["p"], r["q"]) for r in sides], 24.0, 8.0, 16,
    )
    got = {r["vid"]: ([r["r"], r["g"], r["b"]], r["ring"]) for r in plans.body_colours(spark, DATA).collect()}
    assert {k: r for k, (_, r) in got.items()} == {k: r for k, (_, r) in want.items()} and len({r for _, r in got.values()}) > 2
    # A value on the border between two bytes may round either way.
    assert max(abs(a - b) for k in want for a, b in zip(got[k][0], want[k][0], strict=True)) <= 1
    assert sum(got[k][0] != want[k][0] for k in want) <= len(want) // 100


def test_rings_stop_and_the_rest_has_the_mean(spark):
    seen = spark.createDataFrame([("c", 0, 1.0, 10.0, 20.0, 30.0), ("c", 0, 3.0, 50.0, 20.0, 30.0), ("c", 9, 0.0, 1.0, 1.0, 1.0), ("c", 20, 1.0, 0.0, 0.0, 0.0)], "clip string, vid long, weight double, r double, g double, b double")
    sides = spark.createDataFrame([("c", i, i + 1) for i in range(6)] + [("c", 3, 3)], "clip string, p long, q long")
    vertices = spark.createDataFrame([("c", i) for i in (*range(7), 9, 20)] + [("empty", 1)], "clip string, vid long")
    got = {(r["clip"], r["vid"]): (r["r"], r["g"], r["ring"]) for r in T.spread_colours(seen, sides, vertices, rings=3).collect()}
    assert [got["c", i] for i in range(4)] == [(40, 20, i) for i in range(4)]
    assert got["c", 4] == got["c", 9] == (20, 10, -1) and got["c", 20] == (0, 0, 0) and got["empty", 1] == (128, 128, -1)
    assert T.spread_colours(seen.where("false"), sides, vertices).where(F.col("r") != 128).isEmpty()


def test_switches_hold_their_state(spark):
    rng = np.random.default_rng(4)
    rows = [(k, t, float(v)) for k, n in ((1, 300), (2, 1)) for t, v in enumerate(rng.random(n))]
    got = {(r["k"], r["t"]): r["on"] for r in scans.hold_states(spark.createDataFrame(rows, "k long, t long, v double"), ["k"], "t", "v", 0.5, 0.2, 0.8).collect()}
    on = None
    for k, t, v in rows:
        on = v > 0.5 if t == 0 else True if v > 0.8 else False if v < 0.2 else on
        assert got[k, t] == on


def test_splat_changes_and_back(spark):
    """Wrapped words and bytes, slots that die and are born again, and an order of deaths."""
    rng = np.random.default_rng(5)
    rows = [(f, s, int(rng.choice([0, 65535, 32768, rng.integers(65536)])), int(rng.integers(256))) for f in range(7) for s in range(40) if rng.random() < 0.7]
    frames = spark.createDataFrame(rows, "frame long, slot long, p long, o long")
    deltas = splats.encode_deltas(frames, ["p"], ["o"])
    by = {f: {s: (p, o) for g, s, p, o in rows if g == f} for f in range(7)}
    for f in range(1, 7):
        got = deltas.where(F.col("frame") == f).orderBy("slot").collect()
        assert {r["slot"] for r in got if r["kind"] == "birth"} == set(by[f]) - set(by[f - 1])
        order, last = sorted(by[f - 1]), -1
        for r in got:
            if r["kind"] == "death":
                last += r["gap"] + 1
                assert order[last] == r["slot"] and r["slot"] not in by[f]
            elif r["kind"] == "survivor":
                assert -32768 <= r["p"] < 32768 and (by[f - 1][r["slot"]][0] + r["p"]) % 65536 == by[f][r["slot"]][0] and 0 <= r["o"] < 256
    again = splats.decode_deltas(frames.where("frame = 0"), deltas, ["p"], ["o"])
    assert sorted(map(tuple, again.collect())) == sorted(rows)
    assert splats.encode_deltas(frames.where("frame = 3"), ["p"], ["o"]).count() == 0


def test_tile_models_follow_a_field(spark):
    """The generating model is picked in spite of outliers, tiles follow a field that shifts across the frame, and few samples give none."""
    rng = np.random.default_rng(6)
    rows = []
    for frame, kind in ((1, "linear"), (2, "disparity")):
        for y in range(16):
            for x in range(24):
                e = float(rng.uniform(0.2, 1))
                a, b = 0.4 + 0.01 * x, 0.5 + 0.02 * y
                z = a * e + b if kind == "linear" else 1 / (a * e + b)
                rows.append((frame, y, x, e, z * (4 if rng.random() < 0.05 else 1)))
    rows += [(3, 0, x, 0.1 * x, 1.0) for x in range(20)] + [(1, 0, 0, float("nan"), 1.0), (1, 0, 0, 0.5, -1.0), (1, 0, 0, None, 1.0)]
    cells = spark.createDataFrame(rows, "frame long, gy int, gx int, x double, z double")
    found = tiles.fit_tile_models(cells, 4, 4, 6, min_n=30, full=60)
    got = {(r["frame"], r["ty"], r["tx"]): r for r in found.collect()}
    assert {k[0] for k in got} == {1, 2} and len(got) == 48 and {(r["frame"], r["kind"]) for r in got.values()} == {(1, "linear"), (2, "disparity")}
    for (frame, ty, tx), r in got.items():
        if 0 < ty < 3 and 0 < tx < 5:
            want = (0.4 + 0.01 * (4 * tx + 1.5)) * 0.6 + 0.5 + 0.02 * (4 * ty + 1.5)
            assert abs(r["a"] * 0.6 + r["b"] - want) < 0.02 and r["w"] == 1.0
    flat = cells.where("frame = 1").withColumn("x", F.lit(0.5))
    assert tiles.fit_tile_models(flat, 4, 4, 6).count() == 0


def test_no_window_is_read_again_for_every_row(spark, monkeypatch):
    """A window from the current row to the last one costs the square of a track's length."""
    frames = spark.createDataFrame([(1, f, "linear" if f % 3 else None, 0.1) for f in range(40)], "clip long, frame long, kind string, medres double")
    fields = spark.createDataFrame([(1, f, 0, float(f), 1.0, 1.0) for f in range(40) if f % 3], "clip long, frame long, tile long, a double, b double, w double")
    plans, kept = [], T.checkpointed
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().lower()
    monkeypatch.setattr(T, "checkpointed", lambda df: (plans.append(plan(df)), kept(df))[1])
    found = T.smooth_tile_fields(fields, frames, 3)
    plans.append(plan(found))
    assert len(plans) == 3 and all("windowspecdefinition" in p for p in plans)
    assert not any("currentrow$(), unboundedfollowing$()" in p for p in plans)
    assert found.count() == 40


def test_rasters_hold_each_place_as_a_switch_of_its_own(spark):
    """More places than a word has bits and more rows than a chunk: the same as one key a place, in as many rows as there are frames."""
    rng = np.random.default_rng(12)
    x = rng.random((150, 70))
    got = {r["t"]: r["on"] for r in scans.hold_rasters(spark.createDataFrame([(1, t, v.tolist()) for t, v in enumerate(x)], "k long, t long, v array<double>"), ["k"], "t", "v", 0.5, 0.2, 0.8).collect()}
    assert len(got) == 150 and all(len(on) == 3 for on in got.values())
    state = x[0] > 0.5
    for t in range(150):
        if t:
            state = np.where(x[t] > 0.8, True, np.where(x[t] < 0.2, False, state))
        assert [bool(got[t][k // scans.WORD] >> k % scans.WORD & 1) for k in range(70)] == state.tolist()
