"""Nearest points on surfaces against all pairs, and neighbours of triangles against a walk."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import surfaces as S

TRIANGLE = "frame long, tid long, " + ", ".join(f"{n}{c} double" for n in "abc" for c in "xyz") + ", au double, bu double, cu double"


def closest(p, a, b, c):
    """By the plane's foot and the three sides, each on its own."""
    best = (np.inf, None)
    n = np.cross(b - a, c - a)
    tries = []
    if n @ n > 0:
        foot = p - n * ((p - a) @ n) / (n @ n)
        m = np.linalg.lstsq(np.stack([b - a, c - a], 1), foot - a, rcond=None)[0]
        if m.min() >= 0 and m.sum() <= 1:
            tries.append(foot)
    for s, e in ((a, b), (b, c), (c, a)):
        d = e - s
        t = min(1.0, max(0.0, (p - s) @ d / (d @ d))) if d @ d > 0 else 0.0
        tries.append(s + t * d)
    for q in tries:
        best = min(best, ((p - q) @ (p - q), tuple(q)))
    return best


@pytest.fixture(scope="module")
def scene(spark):
    """Crowded, sparse, flat and repeated triangles; points far, near, repeated and without a surface."""
    rng = np.random.default_rng(8)
    rows, points = [], []
    for frame, n, size in ((1, 700, 0.05), (2, 3, 1.0), (4, 1, 1.0)):
        base = rng.normal(0, 1, (n, 3))
        if frame == 1:
            base[:500] = base[0] + rng.normal(0, 1e-3, (500, 3))  # most triangles in one place
            size = np.where(np.arange(n) < 500, 1e-4, size)[:, None, None]
        t = base[:, None] + rng.normal(0, 1, (n, 3, 3)) * size
        if frame == 1:
            t[10, 1] = t[10, 0]  # a line
            t[11, :] = t[11, 0]  # a point
            t[13] = t[12]
        rows += [(frame, 1000 * frame + i, *map(float, x.ravel()), *map(float, rng.random(3))) for i, x in enumerate(t)]
        points += [(frame, *map(float, p)) for p in np.concatenate([rng.normal(0, 2, (40, 3)), base[:20] + 1e-4, t[:5, 0], [[50.0, 0, 0]]])]
    points += [(3, 0.0, 0.0, 0.0), (1, None, 0.0, 0.0), points[0], points[0]]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "vid long, frame long, x double, y double, z double")
    return rows, points, spark.createDataFrame(rows, TRIANGLE).repartition(6), df


def test_nearest_against_all_pairs(scene):
    rows, points, triangles, df = scene
    got = {r["vid"]: r for r in S.nearest_on_surface(df, triangles, attributes=("u",)).collect()}
    assert len(got) == len(points)
    of = defaultdict(list)
    for r in rows:
        of[r[0]].append(np.array(r[2:11]).reshape(3, 3))
    for i, (frame, *p) in enumerate(points):
        r = got[i]
        if frame not in of or None in p:
            assert r["tid"] is None and r["d2"] is None and r["u"] is None
            continue
        d2, _ = min(closest(np.array(p), *t) for t in of[frame])
        assert abs(r["d2"] - d2) <= 1e-9 * max(1, d2)
        assert abs(sum((r["p" + c] - x) ** 2 for c, x in zip("xyz", p, strict=True)) - d2) <= 1e-9 * max(1, d2)
        own = next(x for x in rows if x[1] == r["tid"])
        assert min(own[11:]) - 1e-9 <= r["u"] <= max(own[11:]) + 1e-9


def test_points_do_not_meet_all_triangles(spark, scene, monkeypatch):
    rows, _, triangles, df = scene
    met = []
    real = S.closest_on_triangle
    monkeypatch.setattr(S, "closest_on_triangle", lambda pairs: (met.append(pairs.where("frame = 1").count()), real(pairs))[1])
    S.nearest_on_surface(df, triangles).collect()
    n_points, n_triangles = df.where("frame = 1").count(), sum(r[0] == 1 for r in rows)
    # Most triangles lie in one spot, which an even grid would hand to every point near it.
    assert met[0] < 0.25 * n_points * n_triangles


def test_no_triangles(spark, scene):
    _, _, triangles, df = scene
    r = S.nearest_on_surface(df, triangles.where("false"), attributes=("u",))
    assert r.count() == df.count() and r.where("d2 is not null or u is not null").isEmpty()
    assert S.nearest_on_surface(df.where("false"), triangles).count() == 0


def test_candidates_against_a_walk(spark):
    rng = random.Random(3)
    sides = [(t, *sorted(e)) for t in range(60) for e in ((rng.randrange(40), 40 + rng.randrange(5)) if rng.random() < 0.1 else (t, t + 1), (t, t + 2))]
    sides += [(t, 998, 999) for t in range(30, 50)]  # a side that many triangles share
    seeds = [(t, rng.choice([None, rng.randrange(60), 777])) for t in range(20) for _ in range(3)]
    of, has = defaultdict(set), defaultdict(set)
    for t, p, q in sides:
        of[p, q].add(t)
        has[t].add((p, q))
    want = set()
    for t in range(20):
        ring = {s: 0 for k, s in seeds if k == t and s is not None}
        for r in (1, 2):
            for s in [s for s, v in ring.items() if v == r - 1]:
                for e in has[s]:
                    for o in of[e]:
                        ring.setdefault(o, r)
        want |= {(t, s, r) for s, r in ring.items()}
    got = S.local_candidates(spark.createDataFrame(seeds, "t long, tid long"), spark.createDataFrame(sides, "tid long, p long, q long"), 2)
    rows = [tuple(r) for r in got.select("t", "tid", "ring").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_nearest_of_candidates(spark, scene):
    rows, points, triangles, df = scene
    some = spark.createDataFrame([(t, r[1]) for t in range(10) for r in rows[t * 7 : t * 7 + 5]], "t long, tid long")
    asked = df.where("vid < 12").select(F.col("vid").alias("t"), "x", "y", "z")
    got = {r["t"]: r for r in S.nearest_of_candidates(asked, some, triangles.drop("frame")).collect()}
    assert len(got) == 12 and got[11]["tid"] is None
    for t in range(10):
        d2 = min(closest(np.array(points[t][1:]), *np.array(r[2:11]).reshape(3, 3))[0] for r in rows[t * 7 : t * 7 + 5])
        assert abs(got[t]["d2"] - d2) < 1e-9 * max(1, d2)


def test_points_are_drawn_onto_a_plane(spark):
    """Above a plane every point comes down; points at one place move together; rounds end as nothing moves."""
    flat = [(1, i, *map(float, c)) for i, c in enumerate([(-9, -9, 0, 9, -9, 0, -9, 9, 0), (9, 9, 0, 9, -9, 0, -9, 9, 0)])]
    triangles = spark.createDataFrame(flat, "frame long, tid long, " + ", ".join(f"{n}{c} double" for n in "abc" for c in "xyz"))
    grid = [(1, 10 * y + x, float(x), float(y), 1.0 + 0.1 * ((x * 7 + y * 3) % 5)) for y in range(5) for x in range(5)]
    grid += [(1, 99, 2.0, 2.0, next(z for _, v, _, _, z in grid if v == 22)), (2, 1, 0.0, 0.0, 5.0)]
    points = spark.createDataFrame(grid, "frame long, vid long, x double, y double, z double")
    sides = spark.createDataFrame([(1, 10 * y + x, 10 * y + x + 1) for y in range(5) for x in range(4)] + [(1, 10 * y + x, 10 * y + x + 10) for y in range(4) for x in range(5)] + [(1, 99, 23)], "frame long, p long, q long")
    one = {r["vid"]: r for r in S.register(points, sides, triangles, rounds=1, smooth=0).where("frame = 1").collect()}
    assert all(abs(r["z"]) < 1e-12 for r in one.values()) and one[0]["tid"] == 0
    soft = {(r["frame"], r["vid"]): r for r in S.register(points, sides, triangles, rounds=1, smooth=3).collect()}
    assert soft[1, 99]["z"] == soft[1, 22]["z"] != 0 and soft[2, 1]["z"] == 5.0 and soft[2, 1]["tid"] is None
    height = lambda df: max(abs(r["z"]) for r in df.where("frame = 1").collect())
    rounds = [height(S.register(points, sides, triangles, rounds=n, smooth=1)) for n in (1, 3)]
    assert rounds[1] < rounds[0] < 0.3
    early = S.register(points, sides, triangles, rounds=1, smooth=1, most=6, least_move=0.5)
    assert abs(height(early) - height(S.register(points, sides, triangles, rounds=2, smooth=1))) < 1e-12
    error = S.surface_error(points, triangles, 1.15).collect()
    z = sorted(p[4] for p in grid if p[0] == 1)
    assert len(error) == 1 and abs(error[0]["mean"] - sum(z) / 26) < 1e-12 and error[0]["worst"] == z[-1] and error[0]["p95"] == z[int(0.95 * 26)] and abs(error[0]["over"] - 100 * sum(v > 1.15 for v in z) / 26) < 1e-9


def test_long_triangles_do_not_make_pairs(spark, monkeypatch):
    """Where every triangle reaches across the cloud no box excludes any, yet a point meets one triangle in a row of its own."""
    rng = np.random.default_rng(3)
    t = rng.normal(0, 1, (700, 3, 3))
    p = rng.normal(0, 1, (300, 3))
    triangles = spark.createDataFrame([(1, i, *map(float, x.ravel()), 0.0, 0.0, 0.0) for i, x in enumerate(t)], TRIANGLE)
    points = spark.createDataFrame([(1, i, *map(float, x)) for i, x in enumerate(p)], "frame long, vid long, x double, y double, z double")
    monkeypatch.setattr(S.B, "SEARCHING", 64)
    monkeypatch.setattr(S.B, "SEARCHED", 128)
    met = []
    real = S.closest_on_triangle
    monkeypatch.setattr(S, "closest_on_triangle", lambda pairs: (met.append(pairs.count()), real(pairs))[1])
    got = {r["vid"]: r for r in S.nearest_on_surface(points, triangles).collect()}
    assert met == [300]
    every = np.stack([S._closest_pairs(p, np.repeat(x.reshape(1, 9), 300, 0)) for x in t])
    for i in range(300):
        assert got[i]["tid"] == every[:, i].argmin() and got[i]["d2"] == every[:, i].min()
