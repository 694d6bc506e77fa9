"""Depth fields, layers, region growth, byte deltas, noise and sidecar lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.encodings import varint_hex
from ..functions.geometry import grow_interval, mirror_interval, value_noise
from ..operators import tiles
from ..session import table
from .common import PTS, SEQ, out, points, query, r6, sequences
from .scalars import P

_N = "o_orderkey * 977"
_BYTES = f"1 + ({_N} >= 128)::INT + ({_N} >= 16384)::INT + ({_N} >= 2097152)::INT + ({_N} >= 268435456)::INT"


@query("c13_varint", f"WITH v AS (SELECT o_orderkey, {_N} AS n, {_BYTES} AS k FROM orders) SELECT o_orderkey, k AS bytes, array_to_string(list_transform(range(k), lambda i: printf('%02X', ((n >> CAST(7 * i AS BIGINT)) & 127) + CASE WHEN i < k - 1 THEN 128 ELSE 0 END)), '') AS code FROM v")
def varint(spark: SparkSession, sf: str) -> DataFrame:
    code = varint_hex(F.col("o_orderkey") * 977)
    return table(spark, sf, "orders").select("o_orderkey", (F.length(code) / 2).cast("int").alias("bytes"), code.alias("code"))


def _noise_sql(x: str, y: str, z: str) -> str:
    h = lambda i, j, k: f"(sin((ix+{i})*12.9898e0 + (iy+{j})*78.233e0 + (iz+{k})*37.719e0)*43758.5453e0)"
    frac = lambda s: f"({s} - floor({s}))"
    lerp = lambda a, b, t: f"({a} + ({b} - {a}) * {t})"
    row = lambda j, k: lerp(frac(h(0, j, k)), frac(h(1, j, k)), "ux")
    noise = lerp(lerp(row(0, 0), row(1, 0), "uy"), lerp(row(0, 1), row(1, 1), "uy"), "uz")
    smooth = lambda c: f"({c} - floor({c}))*({c} - floor({c}))*(3 - 2*({c} - floor({c})))"
    return f"WITH {PTS}, s AS (SELECT vid, " + ", ".join(f"floor({e}) AS i{c}, {smooth(e)} AS u{c}" for c, e in zip("xyz", (x, y, z), strict=True)) + f" FROM pts) SELECT vid, {r6(noise, 5)} AS noise FROM s"


@query("c19_value_noise", _noise_sql("x*9", "y*9", "z*9"))
def noise(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select("vid", _round5(value_noise(*(F.col(c) * 9 for c in P))).alias("noise"))


#: Frames of 25 x 20 cells, with an estimate x and a reference y, in tiles of 4 x 4.
_GRID = f"{PTS}, g AS (SELECT CAST(floor(vid / 500) AS BIGINT) AS frame, CAST(floor(vid / 20) AS BIGINT) % 25 AS gy, vid % 20 AS gx, x, 0.5e0 * x + 0.1e0 * y + 2.0e0 AS y FROM pts)"
_LINE = lambda p: (f"({p}n*{p}sxy - {p}sx*{p}sy)/nullif(({p}n*{p}sxx - {p}sx*{p}sx), 0)", f"({p}sy - ({p}n*{p}sxy - {p}sx*{p}sy)/nullif(({p}n*{p}sxx - {p}sx*{p}sx), 0)*{p}sx)/{p}n")
_FIELDS = (
    f"{_GRID}, t AS (SELECT frame, gy // 4 AS ty, gx // 4 AS tx, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x*x) AS sxx, sum(x*y) AS sxy FROM g GROUP BY ALL),"
    " p AS (SELECT o.frame, o.ty, o.tx, any_value(o.n) AS own, sum(q.n) AS n, sum(q.sx) AS sx, sum(q.sy) AS sy, sum(q.sxx) AS sxx, sum(q.sxy) AS sxy FROM t o JOIN t q ON q.frame = o.frame AND abs(q.ty - o.ty) <= 1 AND abs(q.tx - o.tx) <= 1 GROUP BY ALL),"
    " w AS (SELECT frame, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM t GROUP BY ALL),"
    f" fields AS (SELECT p.frame, p.ty, p.tx, p.own AS n, ({_LINE('w.')[0]})*(1 - least(1.0e0, p.n/100.0e0)) + ({_LINE('p.')[0]})*least(1.0e0, p.n/100.0e0) AS a, ({_LINE('w.')[1]})*(1 - least(1.0e0, p.n/100.0e0)) + ({_LINE('p.')[1]})*least(1.0e0, p.n/100.0e0) AS b FROM p JOIN w USING (frame))"
)


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select(
        F.floor(F.col("vid") / 500).alias("frame"), (F.floor(F.col("vid") / 20) % 25).alias("gy"), (F.col("vid") % 20).alias("gx"), "x", (0.5 * F.col("x") + 0.1 * F.col("y") + 2.0).alias("y")
    )


@query("f17_tile_field_fit", f"WITH {_FIELDS} SELECT frame, ty, tx, n, {r6('a', 5)} AS a, {r6('b', 5)} AS b FROM fields")
def tile_field_fit(spark: SparkSession, sf: str) -> DataFrame:
    f = tiles.fit_fields(grid(spark, sf), 4, 100)
    return f.select("frame", "ty", "tx", "n", *(_round5(F.col(c)).alias(c) for c in "ab"))


def _round5(c: Column) -> Column:
    return F.floor(c * 100000.0 + 0.5) / 100000.0


_MIX = lambda c: f"(f00.{c}*(1-fy) + f10.{c}*fy)*(1-fx) + (f01.{c}*(1-fy) + f11.{c}*fy)*fx"
_T = lambda g: f"(({g} + 0.5e0)/4 - 0.5e0)"
_I = lambda g, n: f"CAST(least(greatest(floor({_T(g)}), 0), {n}) AS BIGINT)"


@query(
    "c32_tile_eval",
    f"WITH {_FIELDS}, l AS (SELECT frame, max(ty) AS ny, max(tx) AS nx FROM fields GROUP BY ALL), c AS (SELECT g.*, {_I('gy', 'ny')} AS y0, {_I('gx', 'nx')} AS x0, ny, nx FROM g JOIN l USING (frame)),"
    f" d AS (SELECT *, least(y0 + 1, ny) AS y1, least(x0 + 1, nx) AS x1, least(greatest({_T('gy')} - y0, 0), 1) AS fy, least(greatest({_T('gx')} - x0, 0), 1) AS fx FROM c)"
    f" SELECT d.frame, gy, gx, {r6('1/((' + _MIX('a') + ')*x + (' + _MIX('b') + '))', 5)} AS z FROM d"
    + "".join(f" JOIN fields f{i}{j} ON f{i}{j}.frame = d.frame AND f{i}{j}.ty = d.y{i} AND f{i}{j}.tx = d.x{j}" for i in (0, 1) for j in (0, 1)),
)
def tile_eval(spark: SparkSession, sf: str) -> DataFrame:
    g = grid(spark, sf)
    return tiles.eval_fields(g, tiles.fit_fields(g, 4, 100), 4, inverse=True).select("frame", "gy", "gx", _round5(F.col("z")).alias("z"))


_B = "CAST(floor((x + 1) * 127.5e0 + 0.5e0) AS BIGINT)"


@query("g17_byte_deltas", f"WITH {PTS}, b AS (SELECT frame, vid, {_B} AS b FROM pts) SELECT frame, vid, ((b - coalesce(lag(b) OVER (PARTITION BY frame ORDER BY vid), 0)) % 256 + 256) % 256 AS delta, b % 256 AS decoded FROM b")
def byte_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Deltas of a byte attribute modulo 256, and their running sum, which gives the bytes again."""
    line = Window.partitionBy("frame").orderBy("vid")
    b = points(spark, sf).select("frame", "vid", F.floor((F.col("x") + 1) * 127.5 + 0.5).alias("b"))
    coded = b.withColumn("delta", F.pmod(F.col("b") - F.coalesce(F.lag("b").over(line), F.lit(0)), F.lit(256)).cast("long"))
    return coded.select("frame", "vid", "delta", F.pmod(F.sum("delta").over(line.rowsBetween(Window.unboundedPreceding, 0)), F.lit(256)).cast("long").alias("decoded"))


_AROUND = "(SELECT max(q.y) FROM g q WHERE q.frame = p.frame AND abs(q.gy - p.gy) + abs(q.gx - p.gx) = 1)"


@query("i04_fill_union", f"WITH {_GRID} SELECT frame, gy, gx, {r6('y')} AS d, 'relief' AS layer FROM g UNION ALL SELECT frame, gy, gx, {r6(_AROUND)}, 'fill' FROM g p WHERE y < 2.0 AND {_AROUND} > y")
def fill_union(spark: SparkSession, sf: str) -> DataFrame:
    """A relief with a fill layer: below near cells, the farthest of their four neighbours."""
    g = grid(spark, sf).select("frame", "gy", "gx", "y")
    line = lambda by, at: Window.partitionBy("frame", by).orderBy(at).rangeBetween(-1, 1)
    around = F.greatest(F.max("y").over(line("gy", "gx")), F.max("y").over(line("gx", "gy")))
    # A cell that is the farthest itself has no fill, so it may count as its own neighbour.
    fill = g.withColumn("far", around).where((F.col("y") < 2.0) & (F.col("far") > F.col("y")))
    layer = lambda df, d, name: df.select("frame", "gy", "gx", *out(d=F.col(d)), F.lit(name).alias("layer"))
    return layer(g, "y", "relief").unionByName(layer(fill, "far", "fill"))


_S = [f"abs(s{k}) + 0.01e0" for k in range(3)]


@query(
    "j03_grow_mirror_boxes",
    f"WITH {PTS}, b AS (SELECT vid, " + ", ".join(f"{c} AS {c}0, {c} + {s} AS {c}1" for c, s in zip(P, _S, strict=True)) + " FROM pts) SELECT vid, "
    + ", ".join(f"{r6(f'least(({c}0 + {c}1)/2, {c}0 + 0.05e0)')} AS {c}0, {r6(f'greatest(({c}0 + {c}1)/2, {c}1 - 0.05e0)')} AS {c}1" for c in P)
    + f", {r6('0.2e0 - x1')} AS mirrored0, {r6('0.2e0 - x0')} AS mirrored1 FROM b",
)
def grow_mirror_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes shrunk by 0.05 without turning inside out, and the unshrunk box's mirror image at x = 0.1."""
    edge = {c: (F.col(c), F.col(c) + F.abs(f"s{k}") + 0.01) for k, c in enumerate(P)}
    grown = {f"{c}{i}": v for c, (lo, hi) in edge.items() for i, v in enumerate(grow_interval(lo, hi, -0.05))}
    mirrored = {f"mirrored{i}": v for i, v in enumerate(mirror_interval(*edge["x"], 0.1))}
    return points(spark, sf).select(*out("vid", **grown, **mirrored))


@query("k05_clip_meta", f"WITH {SEQ} SELECT e.user_id AS clip, max(CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT)) AS k, count(*) AS entries FROM events e GROUP BY ALL")
def clip_meta(spark: SparkSession, sf: str) -> DataFrame:
    """A clip's sidecar values."""
    meta = F.from_json("props", "k long")
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("clip")).agg(F.max(meta["k"]).alias("k"), F.count("*").alias("entries"))


@query("k08_guard_counts", f"WITH {SEQ} SELECT clip, count(*) AS frames, count(*) <= 67108864 AS vertices_fit, 3 * count(*) <= 268435456 AS indices_fit FROM seq GROUP BY ALL")
def guard_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Whether counts stay within what a reader accepts: 2^26 vertices, 2^28 indices."""
    n = F.count("*")
    return sequences(spark, sf).groupBy("clip").agg(n.alias("frames"), (n <= 1 << 26).alias("vertices_fit"), (3 * n <= 1 << 28).alias("indices_fit"))


_SAFE = "regexp_replace(lower(p_name), '[^a-z0-9._-]+', '_', 'g')"


@query("k10_edit_store", f"SELECT {_SAFE} AS clip, max(p_partkey) AS version, arg_max(p_type, p_partkey) AS edits, count(*) AS writes FROM part WHERE octet_length(encode(p_type)) <= 16777216 GROUP BY ALL")
def edit_store(spark: SparkSession, sf: str) -> DataFrame:
    """One sidecar for each clip under its sanitised name: the last one written of at most 16 MB."""
    name = F.regexp_replace(F.lower("p_name"), "[^a-z0-9._-]+", "_")
    writes = table(spark, sf, "part").where(F.octet_length("p_type") <= 16 << 20)
    return writes.groupBy(name.alias("clip")).agg(F.max("p_partkey").alias("version"), F.max_by("p_type", "p_partkey").alias("edits"), F.count("*").alias("writes"))


# Frames of 12 x 20 cells whose depth is a line in x, or its inverse, that shifts with y, with outliers; tiles of 4 x 4.
_SCENE = f"{PTS}, s AS (SELECT vid // 240 AS frame, least((vid % 240 // 20) // 4, 2) AS ty, least((vid % 20) // 4, 4) AS tx, x, CASE WHEN vid // 240 % 2 = 0 THEN 2 + 0.5e0 * x + 0.02e0 * (vid % 20) + 0.01e0 * y ELSE 1 / (0.5e0 + 0.2e0 * x + 0.004e0 * (vid % 20) + 0.002e0 * y) END * CASE WHEN vid % 17 = 3 THEN 3 ELSE 1 END AS z FROM pts)"
_MISS = "CASE WHEN kind = 'disparity' THEN CASE WHEN a * x + b > 0 THEN abs(z - 1 / nullif(a * x + b, 0)) ELSE 'Infinity'::DOUBLE END ELSE abs(z - (a * x + b)) END"


def _robust(name: str, source: str, keys: str) -> str:
    y = "CASE WHEN kind = 'disparity' THEN 1 / z ELSE z END"
    line = lambda n, src: f"{n} AS (SELECT {keys}, regr_slope({y}, x) AS a, regr_intercept({y}, x) AS b FROM {src} GROUP BY {keys} HAVING count(*) >= 3 AND var_pop(x) > 1e-12 * greatest(1, avg(x) * avg(x)))"
    missed = lambda n, src, fit: f"{n} AS (SELECT {src}.*, {_MISS} AS miss FROM {src} JOIN {fit} USING ({keys}))"
    return ", ".join([
        line(f"{name}1", source), missed(f"{name}m", source, f"{name}1"), f"{name}t AS (SELECT {keys}, 3 * list_sort(list(miss))[count(*) // 2 + 1] + 0.001e0 AS lim FROM {name}m GROUP BY {keys})",
        f"{name}k AS (SELECT {name}m.* EXCLUDE (miss) FROM {name}m JOIN {name}t USING ({keys}) WHERE miss <= lim)", line(f"{name}2", f"{name}k"), missed(f"{name}n", f"{name}k", f"{name}2"),
        f"{name} AS (SELECT {keys}, any_value(a) AS a, any_value(b) AS b, list_sort(list(miss))[count(*) // 2 + 1] AS medres FROM {name}n JOIN {name}2 USING ({keys}) GROUP BY {keys})",
    ])


@query(
    "f17_tile_model_fit",
    f"""WITH {_SCENE}, both_ AS (SELECT s.*, kind FROM s JOIN (SELECT frame FROM s GROUP BY frame HAVING count(*) >= 100) USING (frame), (VALUES ('linear'), ('disparity')) k(kind)), {_robust('gl', 'both_', 'frame, kind')},
    fr AS (SELECT frame, arg_min(struct_pack(kind := kind, a := a, b := b, m := medres), struct_pack(m := medres, k := CASE WHEN kind = 'linear' THEN 0 ELSE 1 END)) AS g FROM gl GROUP BY frame),
    pool AS (SELECT s.frame, s.ty + j AS ty, s.tx + i AS tx, x, z, fr.g.kind AS kind FROM s JOIN fr USING (frame), range(-1, 2) a(j), range(-1, 2) c(i) WHERE s.ty + j BETWEEN 0 AND 2 AND s.tx + i BETWEEN 0 AND 4),
    n AS (SELECT frame, ty, tx, count(*) AS n FROM pool GROUP BY ALL HAVING count(*) >= 20), big AS (SELECT pool.* FROM pool JOIN n USING (frame, ty, tx)), {_robust('tl', 'big', 'frame, ty, tx')},
    mixed AS (SELECT fr.frame, fr.g.kind AS kind, ty, tx, fr.g.a AS ga, fr.g.b AS gb, tl.a AS oa, tl.b AS ob, CASE WHEN tl.a IS NULL THEN 0 ELSE least(1e0, n.n / 80e0) * CASE WHEN tl.medres > 2 * fr.g.m THEN 0.5e0 ELSE 1 END END AS w
        FROM fr CROSS JOIN (SELECT ty, tx FROM range(0, 3) p(ty), range(0, 5) q(tx)) t LEFT JOIN tl USING (frame, ty, tx) LEFT JOIN n USING (frame, ty, tx)),
    m2 AS (SELECT *, CASE WHEN w > 0 THEN w * oa + (1 - w) * ga ELSE ga END AS a, CASE WHEN w > 0 THEN w * ob + (1 - w) * gb ELSE gb END AS b FROM mixed)
    SELECT c.frame, c.kind, CAST(c.ty AS INTEGER) AS ty, CAST(c.tx AS INTEGER) AS tx, {r6('sum((0.25e0 + q.w + CASE WHEN q.ty = c.ty AND q.tx = c.tx THEN 1 ELSE 0 END) * q.a) / sum(0.25e0 + q.w + CASE WHEN q.ty = c.ty AND q.tx = c.tx THEN 1 ELSE 0 END)', 5)} AS a,
        {r6('sum((0.25e0 + q.w + CASE WHEN q.ty = c.ty AND q.tx = c.tx THEN 1 ELSE 0 END) * q.b) / sum(0.25e0 + q.w + CASE WHEN q.ty = c.ty AND q.tx = c.tx THEN 1 ELSE 0 END)', 5)} AS b, {r6('any_value(c.w)', 5)} AS w
    FROM m2 c JOIN m2 q ON q.frame = c.frame AND abs(q.ty - c.ty) <= 1 AND abs(q.tx - c.tx) <= 1 GROUP BY c.frame, c.kind, c.ty, c.tx""",
)
def tile_model_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of the model that fits a frame better, robust against outliers."""
    vid, x, y = (F.col(c) for c in ("vid", "x", "y"))
    gx = vid % 20
    z = F.when(F.floor(vid / 240) % 2 == 0, 2 + 0.5 * x + 0.02 * gx + 0.01 * y).otherwise(1 / (0.5 + 0.2 * x + 0.004 * gx + 0.002 * y)) * F.when(vid % 17 == 3, 3).otherwise(1)
    cells = points(spark, sf).select(F.floor(vid / 240).alias("frame"), F.floor(vid % 240 / 20).alias("gy"), gx.alias("gx"), "x", z.alias("z"))
    found = tiles.fit_tile_models(cells, 4, 3, 5, min_n=20, full=80, min_samples=100)
    return found.select("frame", "kind", "ty", "tx", *(_round5(F.col(c)).alias(c) for c in "abw"))
