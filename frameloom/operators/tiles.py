"""Per-tile linear fields over a frame's grid: fitted from sums, evaluated between tile centres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import statistics as S

SUMS = ["n", "sx", "sy", "sxx", "sxy"]


def _line(n: str, sx: str, sy: str, sxx: str, sxy: str) -> tuple[Column, Column]:
    """(slope, intercept) of least squares; null where all x are equal."""
    n_, x, y, xx, xy = map(F.col, (n, sx, sy, sxx, sxy))
    den = n_ * xx - x * x
    a = F.when(den > 1e-12, (n_ * xy - x * y) / den)
    return a, (y - a * x) / n_


def fit_fields(cells: DataFrame, tile: int, full: int) -> DataFrame:
    """(frame, ty, tx, n, a, b) with y = a * x + b near each tile; cells: frame, gy, gx, x, y.

    A tile's own fit pools its 3 x 3 neighbourhood and counts n / full against the frame's fit, at most wholly.
    Samples are added up once for each tile; only those sums are dealt to neighbours.
    """
    x, y = F.col("x"), F.col("y")
    sums = cells.groupBy("frame", F.floor(F.col("gy") / tile).alias("ty"), F.floor(F.col("gx") / tile).alias("tx")).agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy")
    )
    whole = sums.groupBy("frame").agg(*(F.sum(c).alias("all_" + c) for c in SUMS))
    steps = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in (-1, 0, 1) for i in (-1, 0, 1)))
    near = sums.withColumn("to", F.explode(steps)).select("frame", (F.col("ty") + F.col("to.j")).alias("ty"), (F.col("tx") + F.col("to.i")).alias("tx"), *SUMS)
    pooled = near.groupBy("frame", "ty", "tx").agg(*(F.sum(c).alias("p_" + c) for c in SUMS))
    a0, b0 = _line(*("all_" + c for c in SUMS))
    a1, b1 = _line(*("p_" + c for c in SUMS))
    w = F.when(a1.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.col("p_n") / full))
    blend = lambda p, q: p * (1 - w) + F.coalesce(q, F.lit(0.0)) * w
    # Sums of tiles beside the grid are pooled, too; the join drops them.
    return sums.select("frame", "ty", "tx", "n").join(pooled, ["frame", "ty", "tx"]).join(whole, "frame").select("frame", "ty", "tx", "n", blend(a0, a1).alias("a"), blend(b0, b1).alias("b"))


def _miss(kind: Column, a: Column, b: Column, x: Column, z: Column) -> Column:
    """Distance of z from the model; infinite where a model of disparity has no depth."""
    q = a * x + b
    far = F.when(q > 0, F.abs(z - 1 / F.nullif(q, F.lit(0.0)))).otherwise(F.lit(float("inf")))
    return F.when(kind == "disparity", far).otherwise(F.abs(z - q))


def robust_models(samples: DataFrame, keys: list[str], floor: float) -> DataFrame:
    """(keys, a, b, medres, kept) of samples (keys, kind, x, z): z = a x + b, or 1 / z of kind disparity, by least squares, again without samples that miss by over 3 medians + floor.

    medres: the median miss of those kept. Keys whose x has no spread, or that keep fewer than three samples, are left out; kind must be the same for a key.
    """

    def line(rows: DataFrame, n: str) -> DataFrame:
        y = F.when(F.col("kind") == "disparity", 1 / F.col("z")).otherwise(F.col("z"))
        spread = F.var_pop("x") > 1e-12 * F.greatest(F.lit(1.0), F.avg("x") * F.avg("x"))
        fits = rows.groupBy(*keys).agg(F.count("*").alias(n), F.regr_slope(y, F.col("x")).alias("a"), F.regr_intercept(y, F.col("x")).alias("b"), spread.alias("_ok"))
        return fits.where(F.col("_ok") & (F.col(n) >= 3)).drop("_ok")

    miss = _miss(F.col("kind"), F.col("a"), F.col("b"), F.col("x"), F.col("z"))
    first = checkpointed(samples.join(line(samples, "_n").drop("_n"), keys).withColumn("_miss", miss).drop("a", "b"))
    limit = S.ranks(first, keys, "_miss", mad=S.upper_median).select(*keys, (3 * F.col("mad") + floor).alias("_limit"))
    inner = checkpointed(first.join(limit, keys).where("_miss <= _limit").drop("_miss", "_limit"))
    fits = line(inner, "kept")
    again = inner.join(fits, keys).withColumn("_miss", miss)
    return fits.join(S.ranks(again, keys, "_miss", medres=S.upper_median), keys).where(F.col("medres") < float("inf")).select(*keys, "a", "b", "medres", "kept")


def fit_tile_models(cells: DataFrame, tile: int, tiles_y: int, tiles_x: int, min_n: int = 40, full: int = 200, floor: float = 0.001, min_samples: int = 200) -> DataFrame:
    """(frame, kind, ty, tx, a, b, w): a field of models of depth z by estimate x; cells: frame, gy, gx, x, z.

    The frame's kind is the one whose fit of all samples misses less, linear if neither does. A tile with min_n samples in its 3 x 3 neighbourhood has a fit of its own, which weighs their number / full, at most 1, half if it misses by over
    twice the frame's; the rest is the frame's fit. Then a and b are averaged with those around, by 0.25 + weight, the tile itself by 1 more. Frames of fewer than min_samples
    samples (finite x, positive finite z) have no field.
    """
    inf = float("inf")
    good = (F.abs("x") < inf) & (F.col("z") > 0) & (F.col("z") < inf)
    near = lambda c, most: F.least(F.floor(F.col(c) / tile), F.lit(most - 1)).cast("int")
    samples = cells.where(good).select("frame", near("gy", tiles_y).alias("ty"), near("gx", tiles_x).alias("tx"), F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z"))
    enough = samples.groupBy("frame").count().where(F.col("count") >= min_samples).select("frame")
    samples = checkpointed(samples.join(enough, "frame"))
    both = samples.withColumn("kind", F.explode(F.array(F.lit("linear"), F.lit("disparity"))))
    whole = robust_models(both, ["frame", "kind"], floor)
    best = F.struct("medres", F.when(F.col("kind") == "linear", 0).otherwise(1))
    frames = checkpointed(whole.groupBy("frame").agg(F.min_by(F.struct("kind", "a", "b", "medres"), best).alias("g")).select("frame", "g.kind", F.col("g.a").alias("ga"), F.col("g.b").alias("gb"), F.col("g.medres").alias("gm")))
    steps = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in (-1, 0, 1) for i in (-1, 0, 1)))).alias("s")
    inside = f"ty between 0 and {tiles_y - 1} and tx between 0 and {tiles_x - 1}"
    moved = lambda df, *c: df.select("*", steps).select("frame", (F.col("ty") + F.col("s.j")).alias("ty"), (F.col("tx") + F.col("s.i")).alias("tx"), *c).where(inside)
    pools = moved(samples, "x", "z")
    counts = pools.groupBy("frame", "ty", "tx").agg(F.count("*").alias("n")).where(F.col("n") >= min_n)
    own = robust_models(pools.join(counts.drop("n"), ["frame", "ty", "tx"]).join(frames.select("frame", "kind"), "frame"), ["frame", "ty", "tx"], floor).drop("kept")
    sheet = frames.withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit(tiles_y - 1)))).withColumn("tx", F.explode(F.sequence(F.lit(0), F.lit(tiles_x - 1))))
    met = sheet.join(own.join(counts, ["frame", "ty", "tx"]), ["frame", "ty", "tx"], "left")
    share = F.least(F.lit(1.0), F.col("n") / full) * F.when(F.col("medres") > 2 * F.col("gm"), 0.5).otherwise(1.0)
    w = F.when(F.col("a").isNull(), 0.0).otherwise(share)
    mixed = checkpointed(met.withColumn("w", w).select("frame", "kind", "ty", "tx", "w", *(F.when(F.col("w") > 0, F.col("w") * F.col(c) + (1 - F.col("w")) * F.col("g" + c)).otherwise(F.col("g" + c)).alias(c) for c in "ab")))
    weigh = 0.25 + F.col("w") + F.when((F.col("s.j") == 0) & (F.col("s.i") == 0), 1.0).otherwise(0.0)
    around = moved(mixed, weigh.alias("q"), "a", "b").groupBy("frame", "ty", "tx").agg(*((F.sum(F.col("q") * F.col(c)) / F.sum("q")).alias(c) for c in "ab"))
    return mixed.drop("a", "b").join(around, ["frame", "ty", "tx"]).select("frame", "kind", "ty", "tx", "a", "b", "w")


def _axis(at: Column, tile: int, last: Column) -> tuple[Column, Column, Column]:
    """(tile before, tile after, share of the one after) of a place between tile centres."""
    t = (at + 0.5) / tile - 0.5
    i = F.least(F.greatest(F.floor(t), F.lit(0)), last)
    return i, F.least(i + 1, last), F.least(F.greatest(t - i, F.lit(0.0)), F.lit(1.0))


def eval_fields(cells: DataFrame, fields: DataFrame, tile: int, inverse: bool = False) -> DataFrame:
    """cells (frame, gy, gx, x) with ``z``: a * x + b between tile centres, or its inverse.

    A frame's fields come as one map, as many entries as it has tiles, so cells meet them in one join.
    """
    table = fields.groupBy("frame").agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct("ty", "tx"), F.struct("a", "b")))).alias("field"), F.max("ty").alias("last_y"), F.max("tx").alias("last_x")
    )
    y0, y1, fy = _axis(F.col("gy"), tile, F.col("last_y"))
    x0, x1, fx = _axis(F.col("gx"), tile, F.col("last_x"))

    def at(ty: Column, tx: Column, c: str) -> Column:
        return F.element_at("field", F.struct(ty.cast("long").alias("ty"), tx.cast("long").alias("tx"))).getField(c)

    def mixed(c: str) -> Column:
        left, right = (at(y0, x, c) * (1 - fy) + at(y1, x, c) * fy for x in (x0, x1))
        return left * (1 - fx) + right * fx

    z = mixed("a") * F.col("x") + mixed("b")
    return cells.join(table, "frame").withColumn("z", 1 / z if inverse else z).drop("field", "last_y", "last_x")
