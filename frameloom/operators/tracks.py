"""Smoothing of fields along a clip, and colours gathered on a mesh over a clip."""

from __future__ import annotations

from collections.abc import Sequence
from math import exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from . import statistics as S

# A spike departs by more than 4 scaled median deviations and a hundredth of the usual size.
SPIKE, SHARE = 4 * 1.4826, 0.01


def _between(value: Sequence[str], known: Column, keys: Sequence[str]) -> dict[str, Column]:
    """Columns whose values, where known is false, lie on the line between the nearest frames where it is true.

    What follows is what came last when frames run backwards: a window that ends at the last row is read again for every row.
    """
    told = F.last(F.when(known, F.struct("frame", *value)), ignorenulls=True)
    before, after = (told.over(Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, 0)) for o in (F.asc("frame"), F.desc("frame")))
    p, q = F.coalesce(before, after), F.coalesce(after, before)
    share = F.coalesce((F.col("frame") - p["frame"]) / F.nullif((q["frame"] - p["frame"]).cast("double"), F.lit(0.0)), F.lit(0.0))
    return {c: F.when(known, F.col(c)).when(p.isNotNull(), p[c] * (1 - share) + q[c] * share).otherwise(F.col(c)) for c in value}


def _median5(c: str, line) -> Column:
    """Of a value and two on either side, the clip's ends repeated."""
    first = F.first(c).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.last(c).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    near = [F.coalesce(F.lag(c, k).over(line), first) for k in (2, 1)] + [F.col(c)] + [F.coalesce(F.lead(c, k).over(line), last) for k in (1, 2)]
    return F.array_sort(F.array(*near))[2]


def smooth_tile_fields(fields: DataFrame, frames: DataFrame, radius: int) -> DataFrame:
    """(clip, frame, tile, kind, a, b, w, own) for every frame of clips with any field.

    frames: clip, frame (from 0 without gaps), kind (null without a field), medres; fields: clip, frame, tile, a, b, w, of frames with a field.

    1. A clip keeps the kind of most of its fields, of equally many the one of the smaller mean medres, then the smaller name. Other frames are
       filled tile by tile between the nearest kept ones, as parameters of two kinds can't be averaged (own is false).
    2. Where at least three frames are kept, a kept frame whose a or b departs from the median of five by more than the tile's usual is replaced, both together, by what lies between its nearest good ones.
    3. Both are averaged with Gaussian weights (sigma = radius / 2) over the frames that there are. radius 0 does step 1 alone.

    A tile's track is one key; tracks are short, and there are as many as tiles.
    """
    votes = frames.where("kind is not null").groupBy("clip", "kind").agg(F.count("*").alias("n"), F.avg("medres").alias("m"))
    chosen = votes.groupBy("clip").agg(F.min_by(F.struct("kind", "n"), F.struct(-F.col("n"), "m", "kind")).alias("c")).select("clip", F.col("c.kind").alias("chosen"), F.col("c.n").alias("kept"))
    tiles = fields.select("clip", "tile").distinct()
    every = frames.join(chosen, "clip").join(tiles, "clip").select("clip", "frame", "tile", "chosen", "kept", F.coalesce(F.col("kind") == F.col("chosen"), F.lit(False)).alias("own"))
    keys = ["clip", "tile"]
    line = Window.partitionBy(*keys).orderBy("frame")
    values = ["a", "b", "w"]
    own = every.join(fields.select("clip", "frame", "tile", *(F.col(v).cast("double").alias(v) for v in values)), ["clip", "frame", "tile"], "left")
    filled = checkpointed(own.select("clip", "frame", "tile", "chosen", "kept", "own", *(F.when(F.col("own"), F.col(v)).alias(v) for v in values)).withColumns(_between(values, F.col("own"), keys)))
    shown = lambda df: df.select("clip", "frame", "tile", F.col("chosen").alias("kind"), *values, "own")
    if not radius:
        return shown(filled)
    many = F.count("*").over(Window.partitionBy("clip", "tile"))
    apart = checkpointed(filled.withColumns({"da": F.abs(F.col("a") - _median5("a", line)), "db": F.abs(F.col("b") - _median5("b", line)), "many": many}))
    kept = apart.where("own")
    limits = None
    for d, v in (("da", "a"), ("db", "b")):
        typical = S.ranks(kept, keys, d, s=S.upper_median).join(S.ranks(kept.withColumn("size", F.abs(v)), keys, "size", m=S.upper_median), keys)
        cut = typical.select(*keys, (SPIKE * F.col("s") + SHARE * F.col("m")).alias("c" + v))
        limits = cut if limits is None else limits.join(cut, keys)
    bad = F.col("own") & (F.col("kept") >= 3) & (F.col("many") >= 3) & ((F.col("da") > F.col("ca")) | (F.col("db") > F.col("cb")))
    judged = apart.join(limits, keys, "left").withColumn("bad", F.coalesce(bad, F.lit(False)))
    # Good are kept frames without a spike; filled ones stay as they are.
    good = F.col("own") & ~F.col("bad")
    mended = _between(["a", "b"], good, keys)
    calm = judged.withColumns({v: F.when(F.col("bad"), mended[v]).otherwise(F.col(v)) for v in ("a", "b")})
    sigma = radius / 2
    bell = F.array(*(F.lit(exp(-(k * k) / (2 * sigma * sigma))) for k in range(radius + 1)))
    around = F.collect_list(F.struct("frame", "a", "b")).over(line.rowsBetween(-radius, radius))
    held = calm.withColumn("_near", around)
    weight = lambda s: F.element_at(bell, (F.abs(s["frame"] - F.col("frame")) + 1).cast("int"))
    total = lambda f: F.aggregate("_near", F.lit(0.0), lambda acc, s: acc + f(s))
    return shown(held.withColumns({v: total(lambda s, v=v: weight(s) * s[v]) / total(weight) for v in ("a", "b")}))


def spread_colours(seen: DataFrame, sides: DataFrame, vertices: DataFrame, keys: Sequence[str] = ("clip",), rings: int = 64) -> DataFrame:
    """(keys, vid, r, g, b, ring): a colour for every vertex.

    seen: keys, vid, weight and r, g, b of frames in which a vertex was seen; sides: keys, p, q; vertices: keys, vid. A seen vertex (ring 0) has the weighted mean. The others take, one ring a round for at
    most ``rings``, the mean of neighbours that have a colour; what is left (ring -1) has the mean of all seen vertices of its key, or 128. Colours are rounded to whole bytes at the end.

    A round joins the last ring's neighbours; all coloured neighbours of a vertex that is reached count, as they all lie in the ring before.
    """
    keys, rgb = list(keys), ["r", "g", "b"]
    by = [*keys, "vid"]
    total = F.sum("weight")
    own = seen.where("weight > 0").groupBy(*by).agg(*((F.sum(F.col("weight") * F.col(c)) / total).alias(c) for c in rgb))
    done = checkpointed(own.withColumn("ring", F.lit(0)))
    both = sides.select(*keys, F.col("p").alias("vid"), F.col("q").alias("other")).union(sides.select(*keys, "q", "p")).where("vid != other").distinct()
    both = checkpointed(both)
    last = done
    for ring in range(1, rings + 1):
        near = last.select(*keys, F.col("vid").alias("other"), *rgb)
        new = both.join(near, [*keys, "other"]).join(done.select(*by), by, "left_anti").groupBy(*by).agg(*(F.avg(c).alias(c) for c in rgb))
        last = checkpointed(new.withColumn("ring", F.lit(ring)))
        if last.isEmpty():
            break
        done = done.union(last)
    mean = done.where("ring = 0").groupBy(*keys).agg(*(F.avg(c).alias("m" + c) for c in rgb))
    every = vertices.select(*by).distinct().join(done, by, "left")
    every = every.join(mean, keys, "left") if keys else every.crossJoin(F.broadcast(mean))
    byte = lambda c: F.least(F.greatest(F.floor(F.coalesce(c, "m" + c, F.lit(128.0)) + 0.5), F.lit(0)), F.lit(255)).cast("int").alias(c)
    return every.select(*by, *(byte(c) for c in rgb), F.coalesce("ring", F.lit(-1)).alias("ring"))


def seen_vertices(vertices: DataFrame, normals: DataFrame, pictures: DataFrame, fx: float, fy: float, cx: float, cy: float, width: int, height: int) -> DataFrame:
    """(keys, vid, weight, r, g, b) of the vertices that a frame shows.

    vertices: clip, frame, vid, x, y, z in the camera's axes; normals: clip, frame, vid, nx, ny, nz pointing outwards; pictures: clip, frame, px, py, r, g, b, on, zbuf, the pixels of each frame. A vertex counts if it
    lies before the camera, on a pixel of the subject, turned to the camera (cosine above 0.2) and no more than max(0.02, 1 %) behind what the picture shows there. Its colour is the bilinear mean of the
    subject's pixels around it, its weight the cosine squared.
    """
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    n = [F.col(c) for c in ("nx", "ny", "nz")]
    front = vertices.where("z > 1e-6").join(normals, ["clip", "frame", "vid"])
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) * F.sqrt(x * x + y * y + z * z)
    u, w = fx * x / F.nullif(z, F.lit(0.0)) + cx, fy * y / F.nullif(z, F.lit(0.0)) + cy
    turned = front.withColumns({"cos": -(n[0] * x + n[1] * y + n[2] * z) / F.nullif(size, F.lit(0.0)), "u": u, "w": w}).where("cos > 0.2")
    at = turned.withColumns({"px": F.floor("u"), "py": F.floor("w")})
    shown = at.join(pictures.select("clip", "frame", "px", "py", "zbuf", "on"), ["clip", "frame", "px", "py"]).where("on").where(F.coalesce(F.col("z") - F.col("zbuf") <= F.greatest(F.lit(0.02), 0.01 * z), F.lit(False)))
    clip = lambda c, most: F.least(F.greatest(F.col(c) - 0.5, F.lit(0.0)), F.lit(most - 1.0))
    placed = shown.select("clip", "frame", "vid", "cos", clip("u", width).alias("sx"), clip("w", height).alias("sy"))
    fx_, fy_ = F.col("sx") - F.floor("sx"), F.col("sy") - F.floor("sy")
    taps = [(dx, dy, (fx_ if dx else 1 - fx_) * (fy_ if dy else 1 - fy_)) for dy in (0, 1) for dx in (0, 1)]
    tap = F.explode(F.array(*(F.struct(F.least(F.floor("sx") + dx, F.lit(width - 1)).alias("px"), F.least(F.floor("sy") + dy, F.lit(height - 1)).alias("py"), t.alias("t")) for dx, dy, t in taps))).alias("s")
    met = placed.select("clip", "frame", "vid", "cos", tap).select("clip", "frame", "vid", "cos", "s.*").where("t > 0")
    met = met.join(pictures.where("on").select("clip", "frame", "px", "py", "r", "g", "b"), ["clip", "frame", "px", "py"])
    mix = [(F.sum(F.col("t") * F.col(c)) / F.sum("t")).alias(c) for c in "rgb"]
    return met.groupBy("clip", "frame", "vid").agg(F.max(F.col("cos") * F.col("cos")).alias("weight"), *mix)
