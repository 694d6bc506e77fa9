"""Gates, ramps, fills and guided maps over the supplied vectors as rasters of 8 x 8 pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encodings import rounded
from ..operators import lattices as L
from ..session import table
from .common import query, r6

SIDE, GRID_W, GRID_H = 8, 5, 3
# Pixel i of a raster, its colours and a second map come from the vector's components at i, and at places that i gives.
_AT = lambda e: f"CAST(embedding[({e}) % 64 + 1] AS DOUBLE)"
_BYTE = lambda e: f"CAST(floor(abs({_AT(e)}) * 600) AS BIGINT) % 256"
_PX = f"px AS (SELECT vec_id, i, i // 8 AS y, i % 8 AS x, {_AT('i')} AS v, 1 + 6 * abs({_AT('i')}) AS z, {_BYTE('i * 3 + 1')} AS r, {_BYTE('i * 5 + 2')} AS g, {_BYTE('i * 7 + 3')} AS b, {_AT('i * 9 + 4')} AS w FROM embeddings, range(0, 64) t(i))"


def _at(e: Column) -> Column:
    return F.element_at("embedding", (e % 64 + 1).cast("int")).cast("double")


def _byte(e: Column) -> Column:
    return F.floor(F.abs(_at(e)) * 600) % 256


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("i")
    px = table(spark, sf, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    return px.select(
        "vec_id", "i", F.floor(i / 8).cast("int").alias("y"), (i % 8).alias("x"), _at(i).alias("v"), (1 + 6 * F.abs(_at(i))).alias("z"),
        _byte(i * 3 + 1).alias("r"), _byte(i * 5 + 2).alias("g"), _byte(i * 7 + 3).alias("b"), _at(i * 9 + 4).alias("w"),
    )


def rasters(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each vector, with its maps as arrays."""
    pixel = F.sequence(F.lit(0), F.lit(63))
    each = lambda f: F.transform(pixel, f)
    rgb = F.flatten(each(lambda i: F.array(_byte(i * 3 + 1), _byte(i * 5 + 2), _byte(i * 7 + 3))))
    return table(spark, sf, "embeddings").select(
        "vec_id", each(lambda i: 4 * _at(i)).alias("d"), each(lambda i: 4 * _at(i * 9 + 4)).alias("ref"), each(lambda i: (F.floor(F.abs(_at(i * 7 + 3)) * 200) % 256).cast("int")).alias("gate"),
        each(lambda i: 1 + 6 * F.abs(_at(i))).alias("z"), rgb.alias("rgb"), F.when(F.col("vec_id") % 3 > 0, each(lambda i: F.when(_at(i * 9 + 4) > -0.15, 255).otherwise(0))).alias("mask"),
    )


_SPREAD = 20.0


def _sweeps() -> str:
    """Four passes over the rows, down and up twice; inside a row the best start minus the way from it is a running maximum."""
    step = lambda a, b: f"(2.0 + greatest(0.0, abs({a} - {b}) - {0.01 * _SPREAD}) * {255 / (0.05 * _SPREAD)})"
    parts = [
        f"base AS (SELECT vec_id, y, x, 4 * v AS d, CAST(floor(abs({_AT('i * 7 + 3')}) * 200) AS BIGINT) % 256 AS gate, 4 * w AS ref FROM px JOIN embeddings USING (vec_id))",
        f"cost AS (SELECT *, coalesce(sum(dx) OVER (PARTITION BY vec_id, y ORDER BY x), 0) AS way FROM (SELECT *, CASE WHEN x > 0 THEN {step('d', 'lag(d) OVER (PARTITION BY vec_id, y ORDER BY x)')} END AS dx,"
        f" {step('d', 'lag(d) OVER (PARTITION BY vec_id, x ORDER BY y)')} AS dy FROM base))",
        f"s0 AS (SELECT vec_id, y, x, gate, way, dy, CASE WHEN gate >= 12 AND d - ref > {0.05 * _SPREAD} THEN 255.0 ELSE 0.0 END AS f FROM cost)",
    ]
    for k in range(4):
        down = k % 2 == 0
        rows = list(range(SIDE)) if down else list(range(SIDE - 1, -1, -1))
        for n, y in enumerate(rows):
            best = "s.f" if n == 0 else f"greatest(s.f, p.f - {'s.dy' if down else 'p.dy'})"
            prior = "" if n == 0 else f" JOIN r{k}_{rows[n - 1]} p ON p.vec_id = s.vec_id AND p.x = s.x"
            run = "max(u + way) OVER (PARTITION BY vec_id ORDER BY x) - way" if down else "max(u - way) OVER (PARTITION BY vec_id ORDER BY x DESC) + way"
            parts.append(f"r{k}_{y} AS MATERIALIZED (SELECT vec_id, y, x, gate, way, dy, {run} AS f FROM (SELECT s.vec_id, s.y, s.x, s.gate, s.way, s.dy, {best} AS u FROM s{k} s{prior} WHERE s.y = {y}))")
        parts.append(f"s{k + 1} AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM r{k}_{y}" for y in range(SIDE)) + ")")
    return ", ".join(parts)


@query("g13_grow_gate", f"WITH {_PX}, {_sweeps()} SELECT vec_id, y, x, CAST(greatest(gate, floor(f + 1e-7)) AS INTEGER) AS gate FROM s4")
def grow_gate(spark: SparkSession, sf: str) -> DataFrame:
    grown = L.grow_gates(rasters(spark, sf), ["vec_id"], SIDE, SIDE, _SPREAD)
    i = F.col("i")
    return grown.select("vec_id", F.posexplode("gate").alias("i", "gate")).select("vec_id", F.floor(i / 8).alias("y"), (i % 8).cast("long").alias("x"), "gate")


_JUMP = 0.12


def _snap(passes: int) -> str:
    parts = ["n0 AS (SELECT vec_id, y, x, v, z, r, g, b, 0 AS snapped FROM px)"]
    near = {"nl": "lag({}) OVER row_", "nr": "lead({}) OVER row_", "nu": "lag({}) OVER col_", "nd": "lead({}) OVER col_"}
    for k in range(passes):
        seen = ", ".join(f"CASE WHEN {w.format('z')} IS NOT NULL THEN struct_pack(depth := {w.format('z')}, place := {n}, v := {w.format('v')}, r := {w.format('r')}, g := {w.format('g')}, b := {w.format('b')}) END AS {s}" for n, (s, w) in enumerate(near.items()))
        away = lambda p: " + ".join(f"({p}.{c} - {c}) * ({p}.{c} - {c})" for c in "rgb")
        parts.append(f"w{k} AS (SELECT *, {seen} FROM n{k} WINDOW row_ AS (PARTITION BY vec_id, y ORDER BY x), col_ AS (PARTITION BY vec_id, x ORDER BY y))")
        pick = "list_extract(list_sort(list_filter([nl, nr, nu, nd], lambda p: p IS NOT NULL), 'ASC'), 1)"
        far = "list_extract(list_sort(list_transform(list_filter([nl, nr, nu, nd], lambda p: p IS NOT NULL), lambda p: struct_pack(depth := p.depth, place := -p.place, v := p.v, r := p.r, g := p.g, b := p.b)), 'DESC'), 1)"
        parts.append(f"p{k} AS (SELECT *, {pick} AS nn, {far} AS ff FROM w{k})")
        parts.append(f"q{k} AS (SELECT *, z - nn.depth > {_JUMP} * nn.depth AND ff.depth - z > {_JUMP} * z AS hit, {away('nn')} <= {away('ff')} AS front FROM p{k})")
        take = lambda c, f: f"CASE WHEN hit THEN CASE WHEN front THEN nn.{f} ELSE ff.{f} END ELSE {c} END AS {c}"
        parts.append(f"n{k + 1} AS (SELECT vec_id, y, x, {take('v', 'v')}, {take('z', 'depth')}, r, g, b, snapped + CASE WHEN hit THEN 1 ELSE 0 END AS snapped FROM q{k})")
    return ", ".join(parts)


@query("j09_snap_ramps", f"WITH {_PX}, {_snap(2)} SELECT vec_id, y, x, {r6('v')} AS v, {r6('z')} AS z, CAST(snapped AS INTEGER) AS snapped FROM n2")
def snap_ramps(spark: SparkSession, sf: str) -> DataFrame:
    found = L.snap_ramps(pixels(spark, sf).drop("i", "w"), ["vec_id"], _JUMP)
    return found.select("vec_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), rounded(F.col("v")).alias("v"), rounded(F.col("z")).alias("z"), "snapped")


_RX, _RY = SIDE / GRID_W, SIDE / GRID_H
_MOST = 54 * 14.0 * 14.0
_D2 = " + ".join(f"(p.{c} - q.{c}) * (p.{c} - q.{c})" for c in "rgb")
_NEAR = f"exp(-((p.y - cy) * (p.y - cy)) / {2 * (_RY * 0.75) ** 2!r}e0) * exp(-((p.x - cx) * (p.x - cx)) / {2 * (_RX * 0.75) ** 2!r}e0)"


@query(
    "j08_guided_resample",
    f"""WITH {_PX}, q AS (SELECT vec_id, gy, gx, (gx + 0.5e0) * {_RX!r}e0 - 0.5e0 AS cx, (gy + 0.5e0) * {_RY!r}e0 - 0.5e0 AS cy, {_BYTE('(gy * 5 + gx) * 11')} AS r, {_BYTE('(gy * 5 + gx) * 13 + 5')} AS g, {_BYTE('(gy * 5 + gx) * 17 + 9')} AS b FROM embeddings, range(0, {GRID_H}) a(gy), range(0, {GRID_W}) c(gx)),
    m AS (SELECT q.vec_id, gy, gx, p.v, {_NEAR} AS near, {_D2} AS d2 FROM q JOIN px p ON p.vec_id = q.vec_id AND abs(p.x - floor(cx + 0.5)) <= 2 AND abs(p.y - floor(cy + 0.5)) <= 3),
    s AS (SELECT *, near * CASE WHEN d2 >= {_MOST} THEN 0 ELSE exp(-9.0 * floor(d2 * {1024 / _MOST!r}e0) / 1024) END AS w FROM m)
    SELECT vec_id, gy, gx, {r6('CASE WHEN sum(w) > 1e-4 * sum(near) THEN sum(w * v) / nullif(sum(w), 0) ELSE sum(near * v) / sum(near) END')} AS v FROM s GROUP BY vec_id, gy, gx""",
)
def guided_resample(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(GRID_H - 1))).alias("gy")).withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit(GRID_W - 1))))
    n = F.col("gy") * 5 + F.col("gx")
    grid = e.select("vec_id", "gy", "gx", _byte(n * 11).alias("r"), _byte(n * 13 + 5).alias("g"), _byte(n * 17 + 9).alias("b"))
    found = L.guided_resample(pixels(spark, sf), grid, ["vec_id"], SIDE, SIDE, GRID_W, GRID_H)
    return found.select("vec_id", F.col("gy").cast("long").alias("gy"), F.col("gx").cast("long").alias("gx"), rounded(F.col("v")).alias("v"))


@query("j10_fill_layer")
def fill_layer(spark: SparkSession, sf: str) -> DataFrame:
    """The fill under each raster's foreground: rings, depth, colour and anchors by pixel."""
    found = L.fill_layers(rasters(spark, sf), ["vec_id"], SIDE, SIDE, edge=0.08, band=4)
    each = found.select("vec_id", "fill_rgb", F.posexplode(F.arrays_zip("dist", "fill_z", "anchor")).alias("i", "p"))
    colour = [F.element_at("fill_rgb", F.col("i") * 3 + k + 1).alias(c) for k, c in enumerate("rgb")]
    return each.select("vec_id", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).cast("long").alias("x"), "p.dist", rounded(F.col("p.fill_z")).alias("fill_z"), "p.anchor", *colour)
