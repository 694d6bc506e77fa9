"""Stencils and sweeps over rasters against loops over their pixels in order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import lattices as L
from frameloom.plans import lattices as plans

DATA = "/root/testdata/sf0.001"


def around(i, w, h):
    x, y = i % w, i // w
    return [j for j, ok in ((i - 1, x > 0), (i + 1, x + 1 < w), (i - w, y > 0), (i + w, y + 1 < h)) if ok]


def swept_gate(gate, d, ref, w, h, spread, motion):
    """The sweeps pixel by pixel."""
    field = [255.0 if g >= motion and a - b > 0.05 * spread else 0.0 for g, a, b in zip(gate, d, ref, strict=True)]
    cost = lambda a, b: 2 + max(0.0, abs(d[a] - d[b]) - 0.01 * spread) * 255 / (0.05 * spread)
    for order in (range(w * h), range(w * h - 1, -1, -1)) * 2:
        for i in order:
            for j in around(i, w, h):
                if (j < i) == (order.step > 0):
                    field[i] = max(field[i], field[j] - cost(i, j))
    return [max(g, int(f)) for g, f in zip(gate, field, strict=True)]


@pytest.mark.parametrize(("w", "h"), [(13, 9), (1, 6), (7, 1)])
def test_gates_grow_as_two_sweeps_do(w, h):
    rng = np.random.default_rng(w)
    for scale in (0.02, 0.2, 2.0):
        gate, d, ref = rng.integers(0, 30, w * h), rng.random(w * h) * scale, rng.random(w * h) * scale - 0.1
        assert L.grow_gate(gate, d, ref, w, h, 1.0, 12).tolist() == swept_gate(gate.tolist(), d.tolist(), ref.tolist(), w, h, 1.0, 12)
    still = np.zeros(w * h, int)
    assert (L.grow_gate(still, d, d, w, h, 1.0, 12) == 0).all() and L.grow_gate(gate, d, ref, w, h, 0.0, 12) is gate


def test_a_moving_block_is_filled_to_its_outline(spark):
    """Only its edge changes pixels; the gate grows over the block and not into the background."""
    w, h = 24, 16
    y, x = np.divmod(np.arange(w * h), w)
    block = (x >= 6) & (x < 18) & (y >= 4) & (y < 12)
    edge = block & ((x == 6) | (x == 17) | (y == 4) | (y == 11))
    d, ref = np.where(block, 2.0, 1.0), np.where(edge, 1.0, np.where(block, 1.9, 1.0))
    df = spark.createDataFrame([(1, np.where(edge, 200, 0).tolist(), d.tolist(), ref.tolist())], "k long, gate array<int>, d array<double>, ref array<double>")
    grown = np.array(L.grow_gates(df, ["k"], w, h, 1.0).first()["gate"])
    assert (grown[block] >= 240).all() and (grown[~block] == 0).all()


def filled(z, rgb, present, w, h, edge, band, jump):
    """Rings and sweeps pixel by pixel."""
    n = w * h
    cut = lambda a, b: abs(z[a] - z[b]) > edge * min(z[a], z[b])
    dist, fz, col, anchor = [-1] * n, [0.0] * n, [list(map(int, c)) for c in rgb], [False] * n
    for i in range(n):
        far = [j for j in around(i, w, h) if present[i] and present[j] and cut(i, j) and z[j] - z[i] > max(edge, jump) * z[i]]
        if far:
            dist[i], fz[i], col[i] = 0, sum(z[j] for j in far) / len(far), [int(sum(int(rgb[j][c]) for j in far) / len(far)) for c in range(3)]
            for j in far:
                anchor[j] = True
    for k in range(1, band + 1):
        ring = [i for i in range(n) if dist[i] == -1 and present[i] and any(dist[j] == k - 1 and not cut(i, j) for j in around(i, w, h))]
        told = {}
        for i in ring:
            from_ = [j for j in around(i, w, h) if dist[j] == k - 1 and not cut(i, j)]
            told[i] = sum(fz[j] for j in from_) / len(from_), [int(sum(col[j][c] for j in from_) / len(from_)) for c in range(3)]
        for i, (a, b) in told.items():
            dist[i], fz[i], col[i] = k, a, b
    inner = [i for i in range(n) if dist[i] > 0]
    smooth = [list(map(float, c)) for c in col]
    for sweep in range(16):
        for i in inner[::-1] if sweep % 2 else inner:
            use = [j for j in around(i, w, h) if dist[j] >= 0 and not cut(i, j)]
            if use:
                fz[i] = sum(fz[j] for j in use) / len(use)
                smooth[i] = [sum(smooth[j][c] for j in use) / len(use) for c in range(3)]
    for i in inner:
        col[i] = [int(v + 0.5) for v in smooth[i]]
    return dist, [max(f, z[i] * (1 + edge)) if dist[i] >= 0 else None for i, f in enumerate(fz)], anchor, col


@pytest.mark.parametrize(("w", "h", "band"), [(12, 8, 2), (9, 11, 5), (5, 1, 3), (8, 8, 0)])
def test_fills_against_pixels_in_order(spark, w, h, band):
    rng = np.random.default_rng(10 * w + band)
    y, x = np.divmod(np.arange(w * h), w)
    z = np.where((x > 1) & (x < w - 2) & (y > 1), 1 + 0.01 * rng.random(w * h), 3 + rng.random(w * h))
    z[rng.integers(0, w * h, 4)] *= 1.5
    rgb, mask = rng.integers(0, 256, (w * h, 3)), np.where(rng.random(w * h) < 0.9, 255, 0)
    rows = [(1, z.tolist(), rgb.ravel().tolist(), mask.tolist()), (2, z.tolist(), rgb.ravel().tolist(), None)]
    df = spark.createDataFrame(rows, "k long, z array<double>, rgb array<int>, mask array<int>")
    for r in L.fill_layers(df, ["k"], w, h, 0.08, band).collect():
        dist, depth, anchor, colour = filled(z.tolist(), rgb, mask >= 128 if r["k"] == 1 else np.ones(w * h, bool), w, h, 0.08, band, 0.25)
        assert r["dist"] == dist and r["anchor"] == anchor and r["fill_rgb"] == [v for c in colour for v in c]
        assert all((a is None and b is None) or abs(a - b) < 1e-9 for a, b in zip(r["fill_z"], depth, strict=True))


def test_the_background_goes_on_under_a_block(spark):
    w, h = 12, 8
    y, x = np.divmod(np.arange(w * h), w)
    block = (x >= 4) & (x <= 7) & (y >= 2) & (y <= 5)
    rgb = np.where(block[:, None], [200, 100, 50], [10, 20, 30])
    dist, depth, anchor, colour = L.fill_layer(np.where(block, 1.0, 4.0), rgb, np.ones(w * h, bool), w, h, 0.08, 2, 0.25)
    outline = block & ((x == 4) | (x == 7) | (y == 2) | (y == 5))
    assert (dist == np.where(outline, 0, np.where(block, 1, -1))).all() and anchor.sum() == 16
    assert np.allclose(depth[block], 4) and np.isnan(depth[~block]).all() and (colour[block] == [10, 20, 30]).all()
    assert (L.fill_layer(np.where(block, 1.0, 4.0), rgb, np.ones(w * h, bool), w, h, 0.08, 0, 0.25)[0] >= 0).sum() == 12


def test_fill_query_against_pixels_in_order(spark):
    frames = {r["vec_id"]: r for r in plans.rasters(spark, DATA).where("vec_id < 40").collect()}
    got = {(r["vec_id"], r["y"] * 8 + r["x"]): r for r in plans.fill_layer(spark, DATA).where("vec_id < 40").collect()}
    for k, f in frames.items():
        present = np.ones(64, bool) if f["mask"] is None else np.array(f["mask"]) >= 128
        dist, depth, anchor, colour = filled(f["z"], np.array(f["rgb"]).reshape(-1, 3), present, 8, 8, 0.08, 4, 0.25)
        for i in range(64):
            r = got[k, i]
            assert (r["dist"], r["anchor"], [r["r"], r["g"], r["b"]]) == (dist[i], anchor[i], colour[i])
            assert (r["fill_z"] is None) == (depth[i] is None) and (depth[i] is None or abs(r["fill_z"] - depth[i]) < 1e-6)


def test_ramps_snap_to_a_side(spark):
    """A ramp of two pixels between two surfaces; without a guide by disparity; equal neighbours in the order left, right, upper, lower."""
    line = [(0, x, float(z), z, r, 0, 0) for x, (z, r) in enumerate([(1.0, 10), (1.0, 10), (1.6, 12), (2.6, 190), (4.0, 200), (4.0, 200)])]
    df = spark.createDataFrame([(1, *p) for p in line], "k long, y int, x int, v double, z double, r int, g int, b int")
    got = L.snap_ramps(df, ["k"], 0.1).orderBy("x").collect()
    assert [r["z"] for r in got] == [1.0, 1.0, 1.0, 4.0, 4.0, 4.0] and [r["v"] for r in got] == [r["z"] for r in got]
    plain = L.snap_ramps(df, ["k"], 0.1, guide=None).orderBy("x").collect()
    assert [r["z"] for r in plain] == [1.0, 1.0, 4.0, 4.0, 4.0, 4.0] and [r["snapped"] for r in plain] == [0, 0, 2, 1, 0, 0]
    cross = [(1, 0, 1, 7.0, 1.0), (1, 1, 0, 5.0, 1.0), (1, 1, 1, 0.0, 2.0), (1, 1, 2, 6.0, 4.0), (1, 2, 1, 8.0, 4.0)]
    tied = L.snap_ramps(spark.createDataFrame([(*c, 0, 0, 0) for c in cross], "k long, y int, x int, v double, z double, r int, g int, b int"), ["k"], 0.1, passes=1)
    assert tied.where("y = 1 and x = 1").first()["v"] == 5.0


def test_guided_vertices_stay_on_their_side(spark):
    w, h, gw, gh = 32, 4, 64, 8
    px = [(1, y, x, 0.2 if x < 16 else 0.8, *[40 if x < 16 else 200] * 3) for y in range(h) for x in range(w)]
    grid = [(1, y, x, *[40 if x < 32 else 200] * 3) for y in range(gh) for x in range(gw)]
    cols = "k long, y int, x int, v double, r int, g int, b int"
    out = L.guided_resample(spark.createDataFrame(px, cols), spark.createDataFrame(grid, "k long, gy int, gx int, r int, g int, b int"), ["k"], w, h, gw, gh).collect()
    assert len(out) == gw * gh and all(abs(r["v"] - (0.2 if r["gx"] < 32 else 0.8)) < 1e-6 for r in out)
    grey = spark.createDataFrame([(1, y, x, x / (w - 1), 120, 120, 120) for y in range(h) for x in range(w)], cols)
    flat = L.guided_resample(grey, spark.createDataFrame(grid, "k long, gy int, gx int, r int, g int, b int").withColumns({c: F.lit(120) for c in "rgb"}), ["k"], w, h, gw, gh)
    assert all(abs(r["v"] - ((r["gx"] + 0.5) / 2 - 0.5) / (w - 1)) < 0.01 for r in flat.where("gx between 6 and 57").collect())
    # Nothing is alike: the mean by nearness.
    far = L.guided_resample(grey, spark.createDataFrame([(1, 3, 30, 255, 0, 0)], "k long, gy int, gx int, r int, g int, b int"), ["k"], w, h, gw, gh).first()
    assert abs(far["v"] - 14.75 / 31) < 0.01
