"""Prefixes of operations that compose, over ordered rows of a key, without any key in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Rows that are composed in one array.
CHUNK = 64
#: Places of a raster in a whole number.
WORD = 32


def scan(rows: DataFrame, keys: Sequence[str], order: str, step: str, combine: Callable[[Column, Column], Column], chunk: int = CHUNK) -> DataFrame:
    """(keys, order, prefix): the composition of a key's steps up to each row.

    order: 0, 1, ... within a key, without gaps; combine(a, b): the step that does a, then b. Runs of ``chunk`` rows are composed in arrays, their totals
    in the same way, and so on until a key's totals fit in one run; each level has a ``chunk``-th of the rows below.
    """
    keys = list(keys)
    most = rows.agg(F.max(order)).first()[0]
    level = rows.select(*keys, F.col(order).cast("long").alias("_i"), F.col(step).alias("_s"))
    return _level(level, keys, 0 if most is None else int(most), combine, chunk).select(*keys, F.col("_i").alias(order), F.col("_p").alias("prefix"))


def _level(level: DataFrame, keys: list[str], most: int, combine: Callable[[Column, Column], Column], chunk: int) -> DataFrame:
    runs = level.groupBy(*keys, F.floor(F.col("_i") / chunk).alias("_c")).agg(F.array_sort(F.collect_list(F.struct("_i", "_s"))).alias("_a"))
    added = F.aggregate(F.slice("_a", 2, chunk), F.array(F.col("_a")[0]["_s"]), lambda acc, e: F.array_append(acc, combine(F.element_at(acc, -1), e["_s"])))
    runs = checkpointed(runs.select(*keys, "_c", F.col("_a")[0]["_i"].alias("_first"), added.alias("_p")))
    out = runs.select(*keys, "_c", "_first", F.posexplode("_p").alias("_k", "_p")).withColumn("_i", F.col("_first") + F.col("_k"))
    if most < chunk:
        return out.select(*keys, "_i", "_p")
    totals = runs.select(*keys, F.col("_c").alias("_i"), F.element_at("_p", -1).alias("_s"))
    before = _level(totals, keys, most // chunk, combine, chunk).select(*keys, (F.col("_i") + 1).alias("_c"), F.col("_p").alias("_b"))
    return out.join(before, [*keys, "_c"], "left").select(*keys, "_i", F.when(F.col("_b").isNull(), F.col("_p")).otherwise(combine(F.col("_b"), F.col("_p"))).alias("_p"))


def clamps(a: Column, b: Column) -> Column:
    """Clamping to a (lo, hi), then to b, as one clamp."""
    to = lambda x: F.least(F.greatest(x, b["lo"]), b["hi"])
    return F.struct(to(a["lo"]).alias("lo"), to(a["hi"]).alias("hi"))


def affine_maps(a: Column, b: Column) -> Column:
    """Maps of (s, h) to (ss s + sh h + s1, hs s + hh h + h1): a, then b."""
    row = lambda s, h, one: (
        (b[s] * a["ss"] + b[h] * a["hs"]).alias(s), (b[s] * a["sh"] + b[h] * a["hh"]).alias(h), (b[s] * a["s1"] + b[h] * a["h1"] + b[one]).alias(one)
    )
    return F.struct(*row("ss", "sh", "s1"), *row("hs", "hh", "h1"))


def state_tables(a: Column, b: Column) -> Column:
    """Tables that give for each state the next one (to) and a count: a, then b; counts add up."""
    return F.transform(a, lambda s: F.struct(b[s["to"]]["to"].alias("to"), (s["n"] + b[s["to"]]["n"]).alias("n")))


def align_spreads(rows: DataFrame, keys: Sequence[str], order: str, mean: str, spread: str, least: float = 0.5, most: float = 2.0) -> DataFrame:
    """(keys, order, mean, spread) after each row is scaled and shifted to the aligned row before; scales stay in least to most.

    A limited scale clamps the spread that is handed on, and clamps compose.
    """
    keys = list(keys)
    s = F.col(spread)
    first = F.col(order) == 0
    step = F.struct(F.when(first, s).otherwise(least * s).alias("lo"), F.when(first, s).otherwise(most * s).alias("hi"))
    chained = scan(rows.withColumn("_clamp", step), keys, order, "_clamp", clamps)
    start = rows.where(first).select(*keys, F.col(mean).alias("mean"))
    kept = chained.select(*keys, order, F.col("prefix.lo").alias("spread"))
    return kept.join(start, keys) if keys else kept.crossJoin(F.broadcast(start))


def cut_runs(rows: DataFrame, keys: Sequence[str], order: str, error: str, limit: float, least: int, most: int) -> DataFrame:
    """(keys, order, run): a run ends before a row whose error is above the limit, if it has its least length, or at its most.

    A row's step tells for each length of the open run, 0 for none, the length behind the row and whether a run ended.
    """
    length = F.sequence(F.lit(0), F.lit(most))
    ends = lambda n: (n > 0) & ((n >= most) | ((F.col(error) > limit) & (n >= least)))
    step = F.transform(length, lambda n: F.struct(F.when(ends(n), 1).otherwise(n + 1).alias("to"), F.when(ends(n), 1).otherwise(0).cast("long").alias("n")))
    chained = scan(rows.withColumn("_step", step), keys, order, "_step", state_tables)
    return chained.select(*keys, order, F.col("prefix")[0]["n"].alias("run"))


def hold_states(rows: DataFrame, keys: Sequence[str], order: str, x: str, at: float, low: float, high: float) -> DataFrame:
    """(keys, order, on): a switch that x sets above ``high`` and clears below ``low``, and that keeps its state between; a key's first row sets it above ``at``.

    A row is a table of what either state becomes, and such tables compose.
    """
    v, first = F.col(x), F.col(order) == 0
    becomes = lambda n: F.when(first, (v > at).cast("int")).when(v > high, 1).when(v < low, 0).otherwise(n)
    step = F.array(*(F.struct(becomes(n).alias("to"), F.lit(0).cast("long").alias("n")) for n in (0, 1)))
    chained = scan(rows.withColumn("_step", step), keys, order, "_step", state_tables)
    return chained.select(*keys, order, (F.col("prefix")[0]["to"] == 1).alias("on"))


def hold_rasters(rows: DataFrame, keys: Sequence[str], order: str, xs: str, at: float, low: float, high: float) -> DataFrame:
    """(keys, order, on): hold_states() of every place of an array ``xs``, as long in each row of a key; on: whole numbers of WORD bits, see switch(). A null keeps the state.

    A row is two sets of places, those that it sets and those that keep their state, so a key's rows stay as many as they are.
    """
    first = F.col(order) == 0
    above = lambda v, limit: F.coalesce(v > limit, F.lit(False))
    sets = lambda v: F.when(first, above(v, at)).otherwise(above(v, high))
    keeps = lambda v: ~first & ~above(v, high) & ~F.coalesce(v < low, F.lit(False))
    words = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / WORD).cast("int"))
    packed = lambda is_on: F.transform(words, lambda w: F.aggregate(F.reverse(F.slice(xs, w * WORD + 1, WORD)), F.lit(0).cast("long"), lambda acc, v: acc * 2 + is_on(v).cast("long")))
    step = F.struct(packed(sets).alias("set"), packed(keeps).alias("keep"))
    chained = scan(rows.withColumn("_step", step), keys, order, "_step", bit_sets)
    return chained.select(*keys, order, F.col("prefix.set").alias("on"))


def bit_sets(a: Column, b: Column) -> Column:
    """Bits that are set and bits that are kept: a, then b."""
    both = lambda x, y: x.bitwiseAND(y)
    either = lambda x, y: x.bitwiseOR(y)
    return F.struct(F.zip_with(b["set"], F.zip_with(b["keep"], a["set"], both), either).alias("set"), F.zip_with(a["keep"], b["keep"], both).alias("keep"))


def switch(on: str, place: Column) -> Column:
    """Whether a place (from 0) of hold_rasters() is on."""
    return F.getbit(F.element_at(on, (F.floor(place / WORD) + 1).cast("int")), (place % WORD).cast("int")) == 1


def align_windows(maps: DataFrame, size: int, align: int, overlap: int, key_slot: int) -> DataFrame:
    """(clip, frame, pixel, d): overlapping windows of depth maps, brought to one scale and cross-faded.

    maps: clip, w (windows from 0), slot (below size), pixel, d. A window's first two slots show the clip's first frame and the window before's key_slot; the
    least-squares scale and shift that bring them to that first frame and to the aligned key map are the window's. Aligned values below 0 become 0. The slots
    from align to overlap fade into the window before's last ones; the first window stays as it is. align is 2.

    The scale and shift are linear in those of the window before, so they come from a scan of affine maps. That holds
    as long as no key value is clamped; values that are, are found, left out of the sums, and the scan is done again until they stay
    the same. Every pass settles at least the first window that was wrong.
    """
    maps = checkpointed(maps.select("clip", F.col("w").cast("long").alias("w"), "slot", "pixel", F.col("d").cast("double").alias("d")))
    fade = overlap - align
    first = maps.where("w = 0 and slot = 0").select("clip", "pixel", F.col("d").alias("r0"))
    slot = lambda k, name, shift=0: maps.where(F.col("slot") == k).select("clip", (F.col("w") + shift).alias("w"), "pixel", F.col("d").alias(name))
    sides = slot(0, "p0").join(slot(1, "p1"), ["clip", "w", "pixel"]).where("w > 0").join(first, ["clip", "pixel"]).join(slot(key_slot, "x", 1), ["clip", "w", "pixel"])
    sides = checkpointed(sides)
    clamped, known = None, -1
    while True:
        told = sides.withColumn("u", F.lit(1.0)) if clamped is None else sides.join(clamped, ["clip", "w", "pixel"], "left").withColumn("u", F.when(F.col("hit"), 0.0).otherwise(1.0))
        s = {n: F.sum(F.expr(e)).alias(n) for n, e in {"a00": "p0*p0 + p1*p1", "a01": "p0 + p1", "n": "2.0", "c0": "p0*r0", "e0": "r0", "px": "p1*x*u", "pu": "p1*u", "xu": "x*u", "uu": "u"}.items()}
        sums = told.groupBy("clip", "w").agg(*s.values()).withColumn("det", F.expr("a00*n - a01*a01"))
        part = lambda e: F.expr(f"({e}) / nullif(det, 0.0)")
        solved = [part(e) for e in ("n*px - a01*xu", "n*pu - a01*uu", "n*c0 - a01*e0", "-a01*px + a00*xu", "-a01*pu + a00*uu", "-a01*c0 + a00*e0")]
        # Without a determinant the window keeps its own scale.
        plain = (0.0, 0.0, 1.0, 0.0, 0.0, 0.0)
        names = ("ss", "sh", "s1", "hs", "hh", "h1")
        step = sums.select("clip", "w", F.struct(*(F.when(F.col("det") == 0, p).otherwise(v).alias(n) for n, v, p in zip(names, solved, plain, strict=True))).alias("step"))
        start = maps.select("clip").distinct().select("clip", F.lit(0).cast("long").alias("w"), F.struct(*(F.lit(p).alias(n) for n, p in zip(names, plain, strict=True))).alias("step"))
        scales = checkpointed(scan(start.union(step), ["clip"], "w", "step", affine_maps).select("clip", "w", F.col("prefix.s1").alias("s"), F.col("prefix.h1").alias("h")))
        # The first window's key map is never clamped.
        hits = sides.join(scales.where("w > 0").withColumn("w", F.col("w") + 1), ["clip", "w"]).where("s*x + h < 0").select("clip", "w", "pixel", F.lit(True).alias("hit"))
        hits = checkpointed(hits)
        count = hits.count()
        if count == max(known, 0) and (clamped is None or hits.join(clamped, ["clip", "w", "pixel"], "left_anti").isEmpty()):
            break
        clamped, known = hits, count
    aligned = maps.join(scales, ["clip", "w"]).withColumn("v", F.when(F.col("w") == 0, F.col("d")).otherwise(F.greatest(F.lit(0.0), F.expr("s*d + h"))))
    last = scales.groupBy("clip").agg(F.max("w").alias("last"))
    ramp = lambda k: k / max(1, fade - 1)
    entering = (F.col("w") > 0) & (F.col("slot") < overlap)
    leaving = (F.col("w") < F.col("last")) & (F.col("slot") >= size - fade)
    weight = F.when(entering, ramp(F.col("slot") - align)).otherwise(1.0) * F.when(leaving, 1 - ramp(F.col("slot") - (size - fade))).otherwise(1.0)
    frame = F.when(F.col("w") == 0, F.col("slot")).otherwise(F.col("slot") - align + size - fade + (F.col("w") - 1) * (size - overlap)).cast("long")
    shown = aligned.join(last, "clip").where((F.col("w") == 0) | (F.col("slot") >= align))
    return shown.groupBy("clip", frame.alias("frame"), "pixel").agg(F.sum(weight * F.col("v")).alias("d"))
