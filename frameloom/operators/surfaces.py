"""Nearest points on triangle surfaces: an exact search by blocks, and one among neighbours of known triangles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import blocks as B
from . import statistics as S
from .graphs import smooth_meshes

AXES = ("x", "y", "z")


def _dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _at(n: str) -> list[Column]:
    return [F.col(n + c) for c in AXES]


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 of a flat triangle where b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))


def closest_on_triangle(pairs: DataFrame) -> DataFrame:
    """pairs (x, y, z and corners ax to cz) with the closest point px, py, pz, its weights wb and wc of corners b and c, and the squared distance d2.

    The point's products with the two sides at a tell in which of the seven regions of the triangle's plane it lies.
    """
    p, a, b, c = [F.col(k) for k in AXES], _at("a"), _at("b"), _at("c")
    less = lambda u, v: [i - j for i, j in zip(u, v, strict=True)]
    ab, ac = less(b, a), less(c, a)
    products = {f"_d{2 * k + j + 1}": _dot(side, less(p, corner)) for k, corner in enumerate((a, b, c)) for j, side in enumerate((ab, ac))}
    d1, d2, d3, d4, d5, d6 = (F.col(f"_d{k}") for k in range(1, 7))
    areas = {"_va": d3 * d6 - d5 * d4, "_vb": d5 * d2 - d1 * d6, "_vc": d1 * d4 - d3 * d2}
    va, vb, vc = F.col("_va"), F.col("_vb"), F.col("_vc")
    at_a, at_b, at_c = (d1 <= 0) & (d2 <= 0), (d3 >= 0) & (d4 <= d3), (d6 >= 0) & (d5 <= d6)
    on_ab, on_ac, on_bc = (vc <= 0) & (d1 >= 0) & (d3 <= 0), (vb <= 0) & (d2 >= 0) & (d6 <= 0), (va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0)
    along, whole = _ratio(d4 - d3, (d4 - d3) + (d5 - d6)), va + vb + vc
    cases = [(at_a, 0.0, 0.0), (at_b, 1.0, 0.0), (on_ab, _ratio(d1, d1 - d3), 0.0), (at_c, 0.0, 1.0), (on_ac, 0.0, _ratio(d2, d2 - d6)), (on_bc, 1 - along, along), (F.lit(True), _ratio(vb, whole), _ratio(vc, whole))]
    weight = lambda k: F.coalesce(*(F.when(case[0], case[k]) for case in cases))
    found = pairs.withColumns(products).withColumns(areas).withColumns({"wb": weight(1), "wc": weight(2)})
    found = found.withColumns({f"p{k}": i + F.col("wb") * u + F.col("wc") * v for k, i, u, v in zip(AXES, a, ab, ac, strict=True)})
    gap = less(p, _at("p"))
    return found.withColumn("d2", _dot(gap, gap)).drop(*products, *areas)


def _closest(pairs: DataFrame, by: list[str], attributes: Sequence[str]) -> DataFrame:
    """Of each key the closest triangle, of equally close ones the smallest; attributes are weighed like the corners."""
    mixed = [((1 - F.col("wb") - F.col("wc")) * F.col("a" + n) + F.col("wb") * F.col("b" + n) + F.col("wc") * F.col("c" + n)).alias(n) for n in attributes]
    best = closest_on_triangle(pairs).groupBy(*by).agg(F.min_by(F.struct("tid", "px", "py", "pz", "d2", *mixed), F.struct("d2", "tid")).alias("_s"))
    return best.select(*by, "_s.*")


def _closest_pairs(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Squared distances of points from triangles, row by row, by the steps of closest_on_triangle() in the same order."""
    p, a, b, c = (m.T for m in (p, t[:, :3], t[:, 3:6], t[:, 6:9]))
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    ab, ac = b - a, c - a
    d1, d2, d3, d4, d5, d6 = (dot(side, p - corner) for corner in (a, b, c) for side in (ab, ac))
    va, vb, vc = d3 * d6 - d5 * d4, d5 * d2 - d1 * d6, d1 * d4 - d3 * d2
    ratio = lambda x, y: np.where(y == 0, 0.0, x / np.where(y == 0, 1.0, y))
    along, whole = ratio(d4 - d3, (d4 - d3) + (d5 - d6)), va + vb + vc
    cases = [(d1 <= 0) & (d2 <= 0), (d3 >= 0) & (d4 <= d3), (vc <= 0) & (d1 >= 0) & (d3 <= 0), (d6 >= 0) & (d5 <= d6), (vb <= 0) & (d2 >= 0) & (d6 <= 0), (va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0)]
    wb = np.select(cases, [0.0, 1.0, ratio(d1, d1 - d3), 0.0, 0.0, 1 - along], ratio(vb, whole))
    wc = np.select(cases, [0.0, 0.0, 0.0, 1.0, ratio(d2, d2 - d6), along], ratio(vc, whole))
    gap = p - (a + wb * ab + wc * ac)
    return dot(gap, gap)


def _nearest_triangles(_: np.ndarray, points: np.ndarray, parts: Iterator[tuple]) -> np.ndarray:
    """The number of each point's nearest triangle, of equally near ones the smallest.

    A triangle isn't farther than its plane or the ball around it, so only those that pass both are measured; the bounds are widened by what rounding may add.
    """
    p = np.ascontiguousarray(points[:, :3])
    best, found = np.full(len(p), np.inf), np.full(len(p), np.iinfo(np.int64).max)
    with np.errstate(all="ignore"):
        for low, number, _, t in parts:
            if low > best.max() * (1 + 1e-9):
                continue
            a, ab, ac = t[:, :3], t[:, 3:6] - t[:, :3], t[:, 6:9] - t[:, :3]
            middle = (t[:, :3] + t[:, 3:6] + t[:, 6:9]) / 3
            around = np.sqrt(np.maximum.reduce([((t[:, k : k + 3] - middle) ** 2).sum(1) for k in (0, 3, 6)]))
            normal = np.cross(ab, ac)
            size = np.sqrt((normal * normal).sum(1))
            # A flat triangle has no plane.
            flat = ~(size > 1e-6 * (ab * ab).sum(1)) | ~(size > 1e-6 * (ac * ac).sum(1)) | ~np.isfinite(t).all(1)
            normal = np.where(flat[:, None], 0.0, normal / np.where(flat, 1.0, size)[:, None])
            slack = 1e-9 * (np.abs(p).max(initial=0, where=np.isfinite(p)) + np.abs(t).max(initial=0, where=np.isfinite(t)))
            reach = np.sqrt(best) * (1 + 1e-9) + slack
            near = p @ normal.T
            near -= np.where(flat, 0.0, (normal * a).sum(1))
            i, j = np.nonzero(~(np.abs(near, out=near) > reach[:, None]))
            off = p[i] - middle[j]
            some = ~((off * off).sum(1) > (reach[i] + around[j] * (1 + 1e-9)) ** 2)
            i, j = i[some], j[some]
            d2, n = _closest_pairs(p[i], t[j]), number[j]
            d2[np.isnan(d2)] = np.inf
            # The first of each point in the order of distance and number.
            order = np.lexsort((n, d2, i))
            order = order[np.diff(i[order], prepend=-1) > 0]
            i, d2, n = i[order], d2[order], n[order]
            better = (d2 < best[i]) | ((d2 == best[i]) & (n < found[i]))
            best[i[better]], found[i[better]] = d2[better], n[better]
    return found


def nearest_on_surface(points: DataFrame, triangles: DataFrame, keys: Sequence[str] = ("frame",), attributes: Sequence[str] = ()) -> DataFrame:
    """points (keys, x, y, z, others) with the nearest point of their key's triangles: tid, px, py, pz, d2 and the attributes there.

    triangles: keys, tid (a whole number), ax to cz and, for each attribute n, the columns an, bn, cn. Without triangles of its key a point has nulls.

    Points and triangles lie in blocks along Morton curves. A block of points meets the blocks of triangles that may hold a nearest one, in a task that holds its
    points and lets the triangles stream by, so pairs of points and triangles are never rows: even where all triangles reach across the whole surface and
    no box excludes any, what is shuffled is triangles times blocks of points. Equal positions are searched once, and the answer is exact.
    """
    keys = list(keys)
    sides = [n + c for n in "abc" for c in (*AXES, *attributes)]
    whole = triangles.where(" AND ".join(f"{n}{c} IS NOT NULL" for n in "abc" for c in AXES)).select(*keys, "tid", *sides)
    corners = [[F.col(n + c) for n in "abc"] for c in AXES]
    place = [F.col(c) for c in AXES]
    spread = B.blocked(whole, keys, [(a + b + c) / 3 for a, b, c in corners], B.SEARCHED)
    by = [*keys, *AXES]
    asked = B.blocked(points.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()).select(*by).distinct(), keys, place, B.SEARCHING)
    near = B.near_blocks(B.boxes(asked, keys, "p_", place), B.boxes(spread, keys, "t_", [F.least(*c) for c in corners], [F.greatest(*c) for c in corners]), keys)
    none, wide = F.lit(0).cast("long"), lambda *c: F.array(*(F.coalesce(x.cast("double"), F.lit(0.0)) for x in c))
    searching = asked.select(*keys, "_at", "_block", none.alias("_n"), none.alias("_o"), wide(*place, *[F.lit(0.0)] * 6).alias("_v"))
    searched = spread.select(*keys, "_at", "_block", F.col("tid").cast("long").alias("_n"), none.alias("_o"), wide(*(F.col(n + c) for n in "abc" for c in AXES)).alias("_v"))
    told = B.meet(searching, searched, near, keys, 9, _nearest_triangles)
    pairs = asked.join(told, "_at").withColumn("tid", F.col("_found").cast(triangles.schema["tid"].dataType)).select(*by, "tid").join(spread.select(*keys, "tid", *sides), [*keys, "tid"])
    found = _closest(pairs, by, attributes)
    return points.join(found, by, "left").select(*points.columns, *(c for c in found.columns if c not in by))


def local_candidates(seeds: DataFrame, sides: DataFrame, rings: int = 2, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, t, tid, ring): the triangles at most ``rings`` steps over shared sides from the seeds of each t.

    seeds: keys, t, tid; sides: keys, tid, p, q, a triangle's sides with p < q. A step goes by way of the distinct sides that are reached, so triangles around a
    side that very many share are told once each, not in pairs.
    """
    keys = list(keys)
    shared = sides.select(*keys, "tid", "p", "q").distinct()
    reached = seeds.select(*keys, "t", "tid").where(F.col("tid").isNotNull()).distinct().withColumn("ring", F.lit(0))
    frontier = reached
    for r in range(1, rings + 1):
        met = frontier.join(shared, [*keys, "tid"]).select(*keys, "t", "p", "q").distinct()
        new = met.join(shared, [*keys, "p", "q"]).select(*keys, "t", "tid").distinct().join(reached, [*keys, "t", "tid"], "left_anti")
        frontier = checkpointed(new.withColumn("ring", F.lit(r)))
        reached = reached.union(frontier)
    return reached


def nearest_of_candidates(points: DataFrame, candidates: DataFrame, triangles: DataFrame, keys: Sequence[str] = (), attributes: Sequence[str] = ()) -> DataFrame:
    """points (keys, t, x, y, z, others) with the nearest point among the candidate triangles of their t; nulls where there are none."""
    keys = list(keys)
    by = [*keys, "t", *AXES]
    pairs = points.select(*by).distinct().join(candidates.select(*keys, "t", "tid").distinct(), [*keys, "t"]).join(triangles, [*keys, "tid"])
    found = _closest(pairs, by, attributes)
    return points.join(found, by, "left").select(*points.columns, *(c for c in found.columns if c not in by))


def register(points: DataFrame, sides: DataFrame, triangles: DataFrame, rounds: int, smooth: int, most: int | None = None, least_move: float = 0.0) -> DataFrame:
    """(frame, vid, x, y, z, tid): points (frame, vid, x, y, z) drawn onto their frame's triangles; tid: the triangle that each was drawn to last.

    sides: frame, p, q, the points' mesh. In a round every point looks for its nearest point on the surface; the field of moves is smoothed along the mesh (``smooth`` double steps to and from the
    neighbours' mean, in which points at one place at the start count as one) and then done. There are ``rounds`` rounds, and up to ``most`` as long as a point of any frame moves by least_move.
    """
    axes = list(AXES)
    place = points.groupBy("frame", *axes).agg(F.min("vid").alias("canon"))
    welded = checkpointed(points.join(place, ["frame", *axes]).select("frame", "vid", "canon"))
    end = lambda c: welded.select("frame", F.col("vid").alias(c), F.col("canon").alias("_" + c))
    joined = checkpointed(sides.join(end("p"), ["frame", "p"]).join(end("q"), ["frame", "q"]).select("frame", F.col("_p").alias("p"), F.col("_q").alias("q")).distinct())
    now = points.select("frame", "vid", *axes, F.lit(None).cast(triangles.schema["tid"].dataType).alias("tid"))
    for done in range(1, max(rounds, most or 0) + 1):
        # A point without a surface stays where it is.
        met = checkpointed(nearest_on_surface(now.drop("tid"), triangles).select("frame", "vid", *axes, "tid", *(F.coalesce(F.col("p" + c) - F.col(c), F.lit(0.0)).alias("m" + c) for c in axes)))
        field = met.join(welded.where("vid = canon").select("frame", "vid"), ["frame", "vid"]).select("frame", "vid", *(F.col("m" + c).alias(c) for c in axes))
        moves = smooth_meshes(field, joined, smooth).select("frame", F.col("vid").alias("canon"), *(F.col(c).alias("m" + c) for c in axes))
        moved = met.drop("mx", "my", "mz").join(welded, ["frame", "vid"]).join(moves, ["frame", "canon"])
        now = checkpointed(moved.select("frame", "vid", *((F.col(c) + F.col("m" + c)).alias(c) for c in axes), "tid", F.sqrt(_dot(*[[F.col("m" + c) for c in axes]] * 2)).alias("_move")))
        if least_move > 0 and done >= rounds and (now.agg(F.max("_move")).first()[0] or 0.0) < least_move:
            break
        if done < max(rounds, most or 0):
            now = now.drop("_move")
    return now.select("frame", "vid", *axes, "tid")


def surface_error(points: DataFrame, triangles: DataFrame, limit: float) -> DataFrame:
    """(frame, mean, p95, worst, over): distances of points from their frame's triangles; over: the share of them above limit, in percent."""
    far = nearest_on_surface(points, triangles).where("d2 is not null").select("frame", F.sqrt("d2").alias("d"))
    far = checkpointed(far)
    sums = far.groupBy("frame").agg(F.avg("d").alias("mean"), F.max("d").alias("worst"), (F.count_if(F.col("d") > limit) * 100.0 / F.count("*")).alias("over"))
    return sums.join(S.ranks(far, ["frame"], "d", p95=S.floor_rank(0.95)), "frame").select("frame", "mean", "p95", "worst", "over")
