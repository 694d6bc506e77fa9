"""Stencils over the pixels of many rasters.

Operators on long tables (keys, y, x, values) use windows along rows and columns, so a raster's lines spread over tasks. Sweeps in which a pixel
depends on ones just changed (grow_gates, fill_layers) take a raster as one row of arrays, whose size is that of a picture whatever the
corpus; they go along diagonals, as pixels of one diagonal don't depend on each other and so a whole diagonal is one numpy step in the
sweep's own order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What evidence loses a pixel, the spread's shares at which a step is free and at which it costs all, and relaxing sweeps.
DECAY, FREE, WALL, SWEEPS = 2.0, 0.01, 0.05, 16


@lru_cache(maxsize=16)
def _lattice(width: int, height: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(left, right, upper and lower neighbour of each pixel, or -1; the pixels of each diagonal)."""
    y, x = np.divmod(np.arange(width * height), width)
    at = np.arange(width * height)
    near = np.stack([np.where(x > 0, at - 1, -1), np.where(x + 1 < width, at + 1, -1), np.where(y > 0, at - width, -1), np.where(y + 1 < height, at + width, -1)])
    return near, [np.flatnonzero(x + y == d) for d in range(width + height - 1)]


def grow_gate(gate: np.ndarray, d: np.ndarray, ref: np.ndarray, width: int, height: int, spread: float, motion: float) -> np.ndarray:
    """The gate raised where a moving pixel that came nearer is reached over smooth depth; two sweeps each way."""
    if not spread > 0:
        return gate
    near, diagonals = _lattice(width, height)
    field = np.where((gate >= motion) & (d - ref > WALL * spread), 255.0, 0.0)
    if not field.any():
        return gate
    step = DECAY + np.maximum(0.0, np.abs(d[near] - d) - FREE * spread) * (255 / (WALL * spread))
    step[near < 0] = np.inf
    for _ in range(2):
        for sides, order in (((0, 2), diagonals), ((1, 3), diagonals[::-1])):
            for i in order:
                for k in sides:
                    field[i] = np.maximum(field[i], field[near[k, i]] - step[k, i])
    return np.maximum(gate, np.floor(field)).astype(gate.dtype)


def fill_layer(z: np.ndarray, rgb: np.ndarray, present: np.ndarray, width: int, height: int, edge: float, band: int, min_jump: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(dist, depth, anchor, colour): the background continued under the foreground along its outline.

    rgb: n x 3 whole numbers. Depth and colour enter at the near ends of cuts, as means of the far ends, and go inward ring by ring over uncut edges, each pixel
    the mean of the ring before it; then the inner pixels are relaxed to the means of their neighbours in the band.
    """
    n = width * height
    near, diagonals = _lattice(width, height)
    other = np.maximum(near, 0)
    joined = (near >= 0) & present[other] & present
    gap = z[other] - z
    cut = joined & (np.abs(gap) > edge * np.minimum(z[other], z))
    seeds = cut & (gap > 0) & (gap > max(edge, min_jump) * z)
    anchor = np.zeros(n, bool)
    anchor[other[seeds]] = True
    dist, depth, colour = np.full(n, -1), np.zeros(n), rgb.astype(np.float64)
    count = seeds.sum(0)
    ring = count > 0
    dist[ring] = 0
    share = lambda which, values: (np.where(which, values[other], 0)).sum(0)
    depth[ring] = (share(seeds, z) / np.maximum(count, 1))[ring]
    own = colour.copy()
    for c in range(3):
        own[ring, c] = np.floor(share(seeds, colour[:, c]) / np.maximum(count, 1))[ring]
    colour = own
    open_ = joined & ~cut
    for k in range(1, band + 1):
        from_ = open_ & (dist[other] == k - 1)
        ring = (dist == -1) & from_.any(0)
        if not ring.any():
            break
        some = from_.sum(0)[ring]
        depth[ring] = share(from_, depth)[ring] / some
        colour[ring] = np.floor(np.stack([share(from_, colour[:, c])[ring] / some for c in range(3)], 1))
        dist[ring] = k
    inner = dist > 0
    if inner.any():
        use = open_ & (dist[other] >= 0)
        some = use.sum(0)
        state = np.concatenate([depth[:, None], colour], 1)
        lines = [i[inner[i] & (some[i] > 0)] for i in diagonals]
        lines = [(i, other[:, i], use[:, i, None], some[i, None]) for i in lines if len(i)]
        for sweep in range(SWEEPS):
            for i, beside, used, total in lines[::-1] if sweep % 2 else lines:
                state[i] = np.where(used, state[beside], 0).sum(0) / total
        depth[inner] = state[inner, 0]
        colour[inner] = np.floor(state[inner, 1:] + 0.5)
    depth = np.where(dist >= 0, np.maximum(depth, z * (1 + edge)), np.nan)
    return dist, depth, anchor, colour.astype(np.int64)


def _per_raster(frames: DataFrame, keys: Sequence[str], schema: str, work: Callable[[dict], Sequence]) -> DataFrame:
    """A row for each raster: its keys and what work makes of its columns as arrays."""
    keys = list(keys)
    types = dict(frames.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                arrays = {c: None if v.as_py() is None else v.values.to_numpy(zero_copy_only=False) for c, v in row.items() if c not in keys}
                columns = [batch.column(k).slice(i, 1) for k in keys] + [pa.array([x]) for x in work(arrays)]
                yield pa.RecordBatch.from_arrays(columns, [*keys, *names])

    names = [part.split()[0] for part in schema.split(", ")]
    return frames.mapInArrow(run, f"{head}, {schema}")


def grow_gates(frames: DataFrame, keys: Sequence[str], width: int, height: int, spread: float, motion: float = 12) -> DataFrame:
    """(keys, gate): gates (0 to 255) grown across moving surfaces; frames: keys, gate, and the depths d and ref, arrays of rows from the top.

    spread: of the depths; a step between pixels is free below a hundredth of it and stops everything above six hundredths.
    """
    return _per_raster(frames.select(*keys, "gate", "d", "ref"), keys, "gate array<int>", lambda a: [grow_gate(a["gate"].astype(np.int32), a["d"].astype(float), a["ref"].astype(float), width, height, spread, motion)])


def fill_layers(frames: DataFrame, keys: Sequence[str], width: int, height: int, edge: float, band: int, min_jump: float = 0.25) -> DataFrame:
    """(keys, dist, fill_z, anchor, fill_rgb) of frames: keys, z, rgb (three numbers a pixel) and mask (0 to 255, or null), arrays of rows from the top.

    dist: rings from the outline, -1 outside the band, where fill_z is null; edge: the relative jump of depth that is a cut; min_jump: the one behind which there is something to fill.
    """

    def work(a: dict) -> Sequence:
        present = np.ones(width * height, bool) if a["mask"] is None else a["mask"] >= 128
        dist, depth, anchor, colour = fill_layer(a["z"].astype(float), a["rgb"].reshape(-1, 3).astype(np.int64), present, width, height, edge, band, min_jump)
        return [dist.astype(np.int32), [None if np.isnan(v) else v for v in depth.tolist()], anchor.tolist(), colour.ravel().astype(np.int32)]

    return _per_raster(frames.select(*keys, "z", "rgb", "mask"), keys, "dist array<int>, fill_z array<double>, anchor array<boolean>, fill_rgb array<int>", work)


def _neighbours(keys: Sequence[str], value: Column) -> list[Column]:
    """value of the left, right, upper and lower neighbour in a long table, null beyond the edge or a missing pixel."""
    out = []
    for line, along in (("y", "x"), ("x", "y")):
        w = Window.partitionBy(*keys, line).orderBy(along)
        for shift in (F.lag, F.lead):
            step = -1 if shift is F.lag else 1
            out.append(F.when(shift(along).over(w) == F.col(along) + step, shift(value).over(w)))
    return out


def snap_ramps(pixels: DataFrame, keys: Sequence[str], jump: float, guide: Sequence[str] | None = ("r", "g", "b"), passes: int = 2) -> DataFrame:
    """pixels (keys, y, x, v, z and others) whose values between two surfaces take the side they resemble; ``snapped`` counts the passes that moved a pixel.

    A pixel that lies by more than the relative jump behind its nearest neighbour and before its farthest takes v and z of the one nearer in colour, without a
    guide nearer in 1 / z. All pixels of a pass decide on the values before it.
    """
    keys, colours = list(keys), list(guide or [])
    now = pixels.withColumn("snapped", F.lit(0))
    for _ in range(passes):
        seen = F.struct("z", "v", *colours)
        told = now.withColumns({f"_n{k}": c for k, c in enumerate(_neighbours(keys, seen))})
        # Of equally deep neighbours the first in the order left, right, upper, lower.
        ranked = lambda sign: [F.when(F.col(f"_n{k}").isNotNull(), F.struct(F.col(f"_n{k}.z").alias("depth"), F.lit(sign * k).alias("place"), F.col(f"_n{k}").alias("p"))) for k in range(4)]
        told = told.withColumns({"_near": F.least(*ranked(1)), "_far": F.greatest(*ranked(-1))})
        near, far, z = F.col("_near.p"), F.col("_far.p"), F.col("z")
        if colours:
            away = lambda p: sum(((p[c] - F.col(c)) * (p[c] - F.col(c)) for c in colours[1:]), (p[colours[0]] - F.col(colours[0])) * (p[colours[0]] - F.col(colours[0])))
            front = away(near) <= away(far)
        else:
            front = 1 / near["z"] - 1 / z <= 1 / z - 1 / far["z"]
        between = F.coalesce((z - near["z"] > jump * near["z"]) & (far["z"] - z > jump * z), F.lit(False))
        take = lambda c: F.when(between, F.when(front, near[c]).otherwise(far[c])).otherwise(F.col(c))
        now = told.select(*(c for c in now.columns if c not in ("z", "v", "snapped")), take("z").alias("z"), take("v").alias("v"), (F.col("snapped") + between.cast("int")).alias("snapped"))
    return now


def guided_resample(pixels: DataFrame, grid: DataFrame, keys: Sequence[str], width: int, height: int, grid_width: int, grid_height: int, sigma: float = 14.0) -> DataFrame:
    """grid (keys, gy, gx, r, g, b) with v: means of the map's values around each vertex, weighted by nearness and by likeness in colour.

    pixels: keys, y, x, v, r, g, b, of width x height. The weight of likeness falls as exp(-9 d / D) in 1,024 steps of the squared colour distance d up to D = 54 sigma²; where
    next to nothing is alike, the mean by nearness is taken. Every vertex asks for the pixels around it, a number that the sizes give.
    """
    keys = list(keys)
    rx, ry = width / grid_width, height / grid_height
    reach = lambda r: max(2, ceil(r))
    near = lambda r: max(1.0, r * 0.75)
    cx, cy = (F.col("gx") + 0.5) * rx - 0.5, (F.col("gy") + 0.5) * ry - 0.5
    around = lambda c, r: F.sequence((F.floor(c + 0.5) - reach(r)).cast("int"), (F.floor(c + 0.5) + reach(r)).cast("int"))
    asked = grid.select(*keys, "gy", "gx", *(F.col(c).alias("v" + c) for c in "rgb"), cx.alias("cx"), cy.alias("cy"))
    asked = asked.withColumn("x", F.explode(around(F.col("cx"), rx))).withColumn("y", F.explode(around(F.col("cy"), ry))).where(f"x between 0 and {width - 1} and y between 0 and {height - 1}")
    bell = lambda d, s: F.exp(-(d * d) / (2 * s * s))
    plain = bell(F.col("y") - F.col("cy"), near(ry)) * bell(F.col("x") - F.col("cx"), near(rx))
    most = 18 * sigma * sigma * 3
    d2 = sum(((F.col(c) - F.col("v" + c)) * (F.col(c) - F.col("v" + c)) for c in "gb"), (F.col("r") - F.col("vr")) * (F.col("r") - F.col("vr")))
    alike = F.when(d2 >= most, 0.0).otherwise(F.exp(-9.0 * F.floor(d2 * (1024 / most)) / 1024))
    met = asked.join(pixels.select(*keys, "y", "x", "v", "r", "g", "b"), [*keys, "y", "x"]).select(*keys, "gy", "gx", "v", plain.alias("p"), (plain * alike).alias("w"))
    sums = met.groupBy(*keys, "gy", "gx").agg(F.sum(F.col("w") * F.col("v")).alias("wv"), F.sum("w").alias("w"), F.sum(F.col("p") * F.col("v")).alias("pv"), F.sum("p").alias("p"))
    v = F.when(F.col("w") > 1e-4 * F.col("p"), F.col("wv") / F.nullif("w", F.lit(0.0))).otherwise(F.col("pv") / F.col("p"))
    return grid.join(sums.select(*keys, "gy", "gx", v.alias("v")), [*keys, "gy", "gx"], "left")
