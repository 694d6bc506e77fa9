"""Components, loops, smoothing, matches, followed masks and scans against plain loops."""

import random
from collections import Counter, defaultdict

import brute
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from frameloom.operators import graphs as N
from frameloom.operators import scans

DATA = "/root/testdata/sf0.001"


def test_pieces_of_chains_stars_and_random_edges(spark):
    rng = random.Random(1)
    edges = [(1, i, i + 1) for i in range(300)] + [(1, 1000, 1001 + i) for i in range(200)] + [(1, 5000, 5000)]
    edges += [(2, rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(2, 7, 8)] * 3
    got = {(r["frame"], r["vid"]): r["piece"] for r in N.pieces(spark.createDataFrame(edges, "frame long, p long, q long")).collect()}
    for frame in (1, 2):
        ids = sorted({v for f, *e in edges if f == frame for v in e})
        at = {v: k for k, v in enumerate(ids)}
        e = np.array([(at[p], at[q], at[q]) for f, p, q in edges if f == frame])
        assert {v: got[frame, v] for v in ids} == {v: ids[r] for v, r in zip(ids, brute.pieces(len(ids), e).tolist(), strict=True)}
    assert N.pieces(spark.createDataFrame([], "frame long, p long, q long")).count() == 0


def test_loops_against_a_walk(spark):
    rng = random.Random(2)
    edges = []
    for frame in (1, 2):
        ids = list(range(400))
        rng.shuffle(ids)
        for size in (3, 4, 100, 37):
            ring = [ids.pop() for _ in range(size)]
            edges += [(frame, a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
        edges += [(frame, 900, 901), (frame, 901, 902), (frame, 910, 911), (frame, 911, 912), (frame, 912, 910), (frame, 912, 913)]
    rng.shuffle(edges)
    got = defaultdict(dict)
    for r in N.boundary_loops(spark.createDataFrame(edges, "frame long, p long, q long")).collect():
        assert r["place"] not in got[r["frame"], r["loop"]]
        got[r["frame"], r["loop"]][r["place"]] = r["v"]
    for frame in (1, 2):
        want = [w if w[1] < w[-1] else [w[0], *w[:0:-1]] for w in brute.loops([(p, q) for f, p, q in edges if f == frame])]
        assert [[got[frame, k][i] for i in range(len(w))] for k, w in enumerate(want)] == want and len(want) == 4
    assert len(got) == 8


def test_smoothing(spark):
    rng = np.random.default_rng(3)
    p, e = rng.random((60, 3)), np.unique(np.sort(rng.integers(0, 50, (120, 2)), 1), axis=0)
    e = e[e[:, 0] != e[:, 1]]
    points = spark.createDataFrame([(1, i, *map(float, x)) for i, x in enumerate(p)], "frame long, vid long, x double, y double, z double")
    both = [(1, *map(int, x)) for x in e] + [(1, int(b), int(a)) for a, b in e[:20]]
    got = {r["vid"]: (r["x"], r["y"], r["z"]) for r in N.smooth_meshes(points, spark.createDataFrame(both, "frame long, p long, q long"), 3).collect()}
    assert np.allclose([got[i] for i in range(60)], brute.taubin(p, e, 3))
    a = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    ring = np.stack([np.cos(a), np.sin(a), np.zeros(40)], 1)
    r = np.linalg.norm(brute.taubin(ring, np.array([(i, (i + 1) % 40) for i in range(40)]), 5), axis=1)
    assert np.ptp(r) < 1e-12 and abs(r[0] - 1) < 0.02


def test_matches_against_the_loop(spark):
    """Crowds ask for the same old points, so many are turned down in turn."""
    rng = np.random.default_rng(4)
    frames = [np.concatenate([rng.random((60, 3)), 0.5 + 0.02 * rng.random((30, 3))]) for _ in range(3)]
    rows = [(f, i, *map(float, p)) for f, ps in enumerate(frames) for i, p in enumerate(ps)]
    got = {(r["frame"], r["vid"]): r["prior"] for r in N.match_nearest(spark.createDataFrame(rows, "frame long, vid long, x double, y double, z double"), 0.15).collect()}
    assert len(got) == len(rows) and all(got[0, i] == -1 for i in range(90))
    for f in (1, 2):
        assert [got[f, i] for i in range(90)] == brute.greedy_matches(frames[f - 1], frames[f], 0.15).tolist()
    points = spark.read.parquet(f"{DATA}/embeddings.parquet").selectExpr("label", "vec_id", "embedding[0] x", "embedding[1] y", "embedding[2] z").collect()
    by = defaultdict(list)
    for r in sorted(points, key=lambda r: r["vec_id"]):
        by[r["label"]].append(r)
    query = {r["vid"]: r["prior"] for r in entry.queries()["e07_match_nearest"](spark, DATA).collect()}
    for f, now in by.items():
        old = by.get(f - 1, [])
        xyz = lambda rs: np.array([[r["x"], r["y"], r["z"]] for r in rs], float).reshape(-1, 3)
        want = brute.greedy_matches(xyz(old), xyz(now), 0.35) if old else [-1] * len(now)
        assert [query[r["vec_id"]] for r in now] == [old[k]["vec_id"] if k >= 0 else -1 for k in want]


def test_matches_do_not_make_pairs(spark, monkeypatch):
    """Where everything is within the radius, pairs would be 600 rows; candidates lie in several parts, and more points ask than there are old ones."""
    rng = np.random.default_rng(6)
    frames = [rng.normal(0, 0.1, (20, 3)), rng.normal(0, 0.1, (30, 3))]
    frames[1][:4] = frames[1][4]
    rows = [(f, i, *map(float, p)) for f, ps in enumerate(frames) for i, p in enumerate(ps)] + [(1, 1000, float("nan"), 0.0, 0.0), (1, 1001, None, 0.0, 0.0), (None, 1002, 0.0, 0.0, 0.0)]
    kept, real = [], N.checkpointed
    monkeypatch.setattr(N, "checkpointed", lambda df: (kept.append((out := real(df)).count()), out)[1])
    monkeypatch.setattr(N, "SETTLED", 12, raising=False)
    monkeypatch.setattr(N, "FEW", 64, raising=False)
    got = {r["vid"]: r["prior"] for r in N.match_nearest(spark.createDataFrame(rows, "frame long, vid long, x double, y double, z double"), 2.0).where("frame = 1 or frame is null").collect()}
    assert [got[i] for i in range(30)] == brute.greedy_matches(*frames, 2.0).tolist() and sum(got[i] < 0 for i in range(30)) == 10
    assert all(got[i] == -1 for i in (1000, 1001, 1002)) and max(kept) <= 50


def test_followed_masks_against_a_loop(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for clip, n in ((1, 37), (2, 1), (3, 8)):
        prev = None
        for t in range(n):
            if t % 9 == 4:
                continue  # a frame without components
            comp = rng.integers(0, 4, 30)
            rows += [(clip, t, int(c), int(i)) for i, c in enumerate(comp) if c]
            area = np.bincount(comp, minlength=4)
            area[0] = 0
            pick, jump = int(area.argmax()), prev is not None
            if prev is not None and (over := np.bincount(comp[prev], minlength=4) * (np.arange(4) > 0)).max() > 0:
                pick, jump = int(over.argmax()), False
            want[clip, t] = (pick, jump)
            prev = (comp == pick).nonzero()[0]
    got = {(r["clip"], r["frame"]): (r["comp"], r["jump"]) for r in N.follow_masks(spark.createDataFrame(rows, "clip long, frame long, comp long, pixel long")).collect()}
    assert got == want
    # Nothing overlaps: the largest of the next frame is taken.
    two = [(1, 0, 1, 0), (1, 1, 5, 7), (1, 1, 6, 8), (1, 1, 6, 9)]
    assert [(r["comp"], r["jump"]) for r in N.follow_masks(spark.createDataFrame(two, "clip long, frame long, comp long, pixel long")).orderBy("frame").collect()] == [(1, False), (6, True)]


def test_labels_touch_at_corners(spark):
    rng = np.random.default_rng(6)
    on = rng.random((9, 11)) < 0.4
    label = {(int(y), int(x)): int(y) * 65536 + int(x) for y, x in np.argwhere(on)}
    for _ in range(100):
        label = {(y, x): min(label.get((y + a, x + b), v) for a in (-1, 0, 1) for b in (-1, 0, 1)) for (y, x), v in label.items()}
    rows = [(1, 2, y, x) for y, x in label]
    got = {(r["y"], r["x"]): r["comp"] for r in N.label_masks(spark.createDataFrame(rows, "clip long, frame long, y int, x int")).collect()}
    assert got == label


# Scans.


def test_scan_keeps_order_over_levels(spark):
    """Composition of tables doesn't commute; chunks of 4 give four levels."""
    rng = random.Random(7)
    steps = {k: [[rng.randrange(3) for _ in range(3)] for _ in range(n)] for k, n in ((1, 200), (2, 1), (3, 64), (4, 65))}
    df = spark.createDataFrame([(k, i, s) for k, ss in steps.items() for i, s in enumerate(ss)], "k long, i long, s array<int>").repartition(5)
    got = {(r["k"], r["i"]): r["prefix"] for r in scans.scan(df, ["k"], "i", "s", lambda a, b: F.transform(a, lambda x: b[x]), chunk=4).collect()}
    for k, ss in steps.items():
        now = [0, 1, 2]
        for i, s in enumerate(ss):
            now = [s[x] for x in now]
            assert got[k, i] == now
    assert scans.scan(df.where("false"), ["k"], "i", "s", lambda a, b: b).count() == 0


def test_spreads_and_cuts(spark):
    rng = np.random.default_rng(8)
    x = rng.random((300, 10)) * rng.choice([0.01, 1, 50], (300, 1))
    x[7] = 3.0  # no spread
    want = brute.align_chain(x)
    rows = spark.createDataFrame([(i, float(r.mean()), float(r.std())) for i, r in enumerate(x)], "row long, mean double, spread double")
    got = {r["row"]: (r["mean"], r["spread"]) for r in scans.align_spreads(rows, [], "row", "mean", "spread").collect()}
    assert np.allclose([got[i] for i in range(300)], np.stack([want.mean(1), want.std(1)], 1))
    errors = {k: rng.random(n) * 10 for k, n in (("a", 500), ("b", 1), ("c", 64))}
    df = spark.createDataFrame([(k, i, float(e)) for k, es in errors.items() for i, e in enumerate(es)], "k string, i long, e double")
    for limit, least, most in ((5.0, 2, 4), (8.0, 1, 30), (0.0, 1, 1)):
        cuts = {(r["k"], r["i"]): r["run"] for r in scans.cut_runs(df, ["k"], "i", "e", limit, least, most).collect()}
        for k, es in errors.items():
            assert [cuts[k, i] for i in range(len(es))] == brute.adaptive_cuts(es, limit, least, most).tolist()


def test_windows_with_clamped_references(spark):
    """Windows of 8 slots whose scales and shifts push reference values below zero."""
    rng = np.random.default_rng(9)
    size, align, overlap, key, fade = 8, 2, 5, 4, 3
    clips = {c: rng.random((n, size, 6)) * rng.choice([0.2, 3], (n, 1, 1)) for c, n in ((1, 40), (2, 1), (3, 2))}
    clips[1][5, :2] = 1.0  # no determinant
    for w in (3, 4, 9, 20, 21, 22):  # falls where the first frame rises, and large reference values
        clips[1][w, 0] = clips[1][0, 0].max() + 0.1 - clips[1][0, 0]
        clips[1][w, 1] = clips[1][w, 0] + 0.01 * rng.random(6)
        clips[1][w, key] *= 20
    rows = [(c, w, s, p, float(d)) for c, x in clips.items() for (w, s, p), d in np.ndenumerate(x)]
    got = {(r["clip"], r["frame"], r["pixel"]): r["d"] for r in scans.align_windows(spark.createDataFrame(rows, "clip long, w long, slot int, pixel int, d double"), size, align, overlap, key).collect()}
    clamped, total = 0, 0
    for c, windows in clips.items():
        out, tail, refs = [windows[0][: size - fade]], windows[0][size - fade :], [windows[0][0], windows[0][key]]
        for d in windows[1:]:
            p, t = d[:2].ravel(), np.stack(refs).ravel()
            a00, a01, n = (p * p).sum(), p.sum(), p.size
            det = a00 * n - a01 * a01
            s, h = ((n * (p @ t) - a01 * t.sum()) / det, (a00 * t.sum() - a01 * (p @ t)) / det) if det else (1.0, 0.0)
            clamped += int((s * d[key] + h < 0).sum())
            aligned = np.maximum(0, s * d + h)
            ramp = np.linspace(0, 1, fade)[:, None]
            rest = aligned[overlap:]
            out += [tail * (1 - ramp) + aligned[align:overlap] * ramp, rest[:-fade]]
            tail, refs = rest[-fade:], [refs[0], aligned[key]]
        want = np.concatenate([*out, tail])
        total += want.size
        assert np.allclose([[got[c, f, p] for p in range(6)] for f in range(len(want))], want)
    assert len(got) == total and clamped > 5


def test_followed_queries_spread_over_tasks(spark):
    """No twin query hands a frame or a clip to Python."""
    for name in ("e07_match_nearest", "f09_boundary_loops", "f10_connected_pieces", "j12_taubin", "g11_align_chain", "g21_window_aligner", "g22_adaptive_cut", "e18_mask_overlap_track"):
        plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "InPandas" not in plan and "CartesianProduct" not in plan


def test_counts_of_matches_add_up(spark):
    c = Counter(r["prior"] >= 0 for r in entry.queries()["e07_match_nearest"](spark, DATA).collect())
    assert sum(c.values()) == spark.read.parquet(f"{DATA}/embeddings.parquet").count()
