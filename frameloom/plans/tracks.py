"""Tile fields smoothed along clips, and colours gathered on meshes, over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.encodings import rounded
from ..operators import scans, splats
from ..operators import tracks as T
from ..session import table
from .aggregates import edges
from .common import PTS, points, query, r6

_TILES, _RADIUS = 12, 3
_LINE = "f AS (SELECT label AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, vec_id, embedding AS e FROM embeddings)"


def tile_fields(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Fields of twelve tiles a vector: some of the other kind, some missing, some spikes."""
    w = Window.partitionBy("label").orderBy("vec_id")
    f = table(spark, sf, "embeddings").select(F.col("label").alias("clip"), (F.row_number().over(w) - 1).cast("long").alias("frame"), "vec_id", F.col("embedding").alias("e"))
    kind = F.when(F.col("vec_id") % 11 == 5, None).when(F.col("vec_id") % 5 == 2, "disparity").otherwise("linear")
    frames = f.select("clip", "frame", kind.alias("kind"), F.abs(F.col("e")[40].cast("double")).alias("medres"))
    spike = F.when(F.col("vec_id") % 17 == 3, 3.0).otherwise(0.0)
    e = lambda k: F.element_at("e", (F.col("tile") + k + 1).cast("int")).cast("double")
    each = f.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(_TILES - 1)))).where("vec_id % 11 != 5")
    return each.select("clip", "frame", "tile", (1 + e(0) + spike).alias("a"), e(12).alias("b"), F.abs(e(24)).alias("w")), frames


def _filled(name: str, source: str, known: str, values: str) -> str:
    """Values where known holds, and between the nearest such frames elsewhere."""
    p = "struct_pack(frame := frame, " + ", ".join(f"{v} := {v}" for v in values) + ")"
    line = "PARTITION BY clip, tile ORDER BY frame ROWS BETWEEN"
    near = f"{name}_n AS (SELECT *, last_value(CASE WHEN {known} THEN {p} END IGNORE NULLS) OVER ({line} UNBOUNDED PRECEDING AND CURRENT ROW) AS pp, first_value(CASE WHEN {known} THEN {p} END IGNORE NULLS) OVER ({line} CURRENT ROW AND UNBOUNDED FOLLOWING) AS qq FROM {source})"
    share = f"{name}_s AS (SELECT * REPLACE (coalesce(pp, qq) AS pp, coalesce(qq, pp) AS qq) FROM {name}_n)"
    t = "coalesce((frame - pp.frame) / nullif(CAST(qq.frame - pp.frame AS DOUBLE), 0), 0)"
    mixed = ", ".join(f"CASE WHEN {known} THEN {v} WHEN pp IS NOT NULL THEN pp.{v} * (1 - {t}) + qq.{v} * {t} ELSE {v} END AS {v}" for v in values)
    return f"{near}, {share}, {name} AS (SELECT * EXCLUDE (pp, qq) REPLACE ({mixed}) FROM {name}_s)"


_AT = lambda k: f"CAST(e[tile + {k + 1}] AS DOUBLE)"
_MED5 = lambda v: f"list_sort([coalesce(lag({v}, 2) OVER l, first_value({v}) OVER whole), coalesce(lag({v}) OVER l, first_value({v}) OVER whole), {v}, coalesce(lead({v}) OVER l, last_value({v}) OVER whole), coalesce(lead({v}, 2) OVER l, last_value({v}) OVER whole)])[3]"
_UPPER = lambda x: f"list_sort(list({x}) FILTER (own))[count(*) FILTER (own) // 2 + 1]"
_GAUSS = lambda v: f"list_sum(list_transform(near, lambda s: exp(-((s.frame - frame) * (s.frame - frame)) / {2 * (_RADIUS / 2) ** 2}e0) * s.{v})) / list_sum(list_transform(near, lambda s: exp(-((s.frame - frame) * (s.frame - frame)) / {2 * (_RADIUS / 2) ** 2}e0)))"


@query(
    "g09_smooth_tile_fields",
    f"""WITH {_LINE}, fr AS (SELECT clip, frame, vec_id, e, CASE WHEN vec_id % 11 = 5 THEN NULL WHEN vec_id % 5 = 2 THEN 'disparity' ELSE 'linear' END AS kind, abs(CAST(e[41] AS DOUBLE)) AS medres FROM f),
    votes AS (SELECT clip, kind, count(*) AS n, avg(medres) AS m FROM fr WHERE kind IS NOT NULL GROUP BY clip, kind),
    chosen AS (SELECT clip, arg_min(struct_pack(kind := kind, n := n), struct_pack(a := -n, b := m, c := kind)) AS c FROM votes GROUP BY clip),
    base AS (SELECT fr.clip, frame, tile, c.kind AS kind, c.n AS kept, coalesce(fr.kind = c.kind, false) AS own,
        CASE WHEN fr.kind = c.kind THEN 1 + {_AT(0)} + CASE WHEN vec_id % 17 = 3 THEN 3.0 ELSE 0.0 END END AS a, CASE WHEN fr.kind = c.kind THEN {_AT(12)} END AS b, CASE WHEN fr.kind = c.kind THEN abs({_AT(24)}) END AS w
        FROM fr JOIN chosen USING (clip), range(0, {_TILES}) t(tile)),
    {_filled('one', 'base', 'own', 'abw')},
    apart AS (SELECT *, abs(a - {_MED5('a')}) AS da, abs(b - {_MED5('b')}) AS db, count(*) OVER (PARTITION BY clip, tile) AS many FROM one WINDOW l AS (PARTITION BY clip, tile ORDER BY frame), whole AS (PARTITION BY clip, tile ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    lim AS (SELECT clip, tile, {T.SPIKE}e0 * {_UPPER('da')} + 0.01e0 * {_UPPER('abs(a)')} AS ca, {T.SPIKE}e0 * {_UPPER('db')} + 0.01e0 * {_UPPER('abs(b)')} AS cb FROM apart GROUP BY clip, tile),
    judged AS (SELECT apart.*, coalesce(own AND kept >= 3 AND many >= 3 AND (da > ca OR db > cb), false) AS bad FROM apart JOIN lim USING (clip, tile)),
    marked AS (SELECT *, a AS a0, b AS b0 FROM judged),
    {_filled('two', 'marked', '(own AND NOT bad)', 'ab')},
    calm AS (SELECT * REPLACE (CASE WHEN bad THEN a ELSE a0 END AS a, CASE WHEN bad THEN b ELSE b0 END AS b) FROM two),
    near AS (SELECT *, list(struct_pack(frame := frame, a := a, b := b)) OVER (PARTITION BY clip, tile ORDER BY frame ROWS BETWEEN {_RADIUS} PRECEDING AND {_RADIUS} FOLLOWING) AS near FROM calm)
    SELECT clip, frame, CAST(tile AS INTEGER) AS tile, kind, own, {r6(_GAUSS('a'), 5)} AS a, {r6(_GAUSS('b'), 5)} AS b, {r6('w', 5)} AS w FROM near""",
)
def smooth_tile_fields(spark: SparkSession, sf: str) -> DataFrame:
    found = T.smooth_tile_fields(*tile_fields(spark, sf), _RADIUS)
    return found.select("clip", "frame", "tile", "kind", "own", *(rounded(F.col(v), 5).alias(v) for v in "abw"))


_W = 16
_FX = 24.0


def body(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(vertices, normals, pictures, sides): points two units before the camera in frames of their label, and pictures of 16 x 16 pixels."""
    p = points(spark, sf)
    v = p.select(F.lit(0).alias("clip"), "frame", "vid", "x", "y", (F.col("z") + 2.0).alias("z"))
    normals = p.select(F.lit(0).alias("clip"), "frame", "vid", F.col("s0").alias("nx"), F.col("s1").alias("ny"), (F.col("s2") - 0.1).alias("nz"))
    pixel = p.select("frame").distinct().withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(_W - 1)))).withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(_W - 1))))
    n = F.col("frame") * 31 + F.col("py") * 7 + F.col("px") * 13
    pictures = pixel.select(F.lit(0).alias("clip"), "frame", F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py"), (n % 256).alias("r"), (n * 3 % 256).alias("g"), (n * 5 % 256).alias("b"), (n % 4 != 0).alias("on"), (1.9 + (n % 3) * 0.1).alias("zbuf"))
    e = edges(spark, sf).select(F.lit(0).alias("clip"), "p", "q")
    return v, normals, pictures, e


@query("f23_body_colours")
def body_colours(spark: SparkSession, sf: str) -> DataFrame:
    """Colours of all vertices, gathered over the frames that show them and spread to the others."""
    v, normals, pictures, sides = body(spark, sf)
    seen = T.seen_vertices(v, normals, pictures, _FX, _FX, _W / 2, _W / 2, _W, _W)
    return T.spread_colours(seen, sides, v.select("clip", "vid")).drop("clip")


_EDGE = 0.3
_SIDES = "sd AS (SELECT * FROM (VALUES ('h', 0, 0, 0, 1), ('v', 0, 0, 1, 0), ('d', 0, 1, 1, 0)) s(kind, ay, ax, dy, dx))"
_JUMP = "abs(za - zb) / least(za, zb)"


@query(
    "d15_silhouette_hysteresis",
    f"""WITH RECURSIVE {_LINE}, {_SIDES}, ends AS (SELECT clip, frame, kind, y, x, 1 + 6 * abs(CAST(e[(y + ay) * 8 + x + ax + 1] AS DOUBLE)) AS za, 1 + 6 * abs(CAST(e[(y + dy) * 8 + x + dx + 1] AS DOUBLE)) AS zb
        FROM f, sd, range(0, 8) a(y), range(0, 8) b(x) WHERE y + greatest(ay, dy) < 8 AND x + greatest(ax, dx) < 8),
    r AS MATERIALIZED (SELECT clip, frame, kind, y, x, {_JUMP} AS r FROM ends),
    st(clip, frame, kind, y, x, cut) AS (SELECT clip, frame, kind, y, x, r > {_EDGE} FROM r WHERE frame = 0 UNION ALL
        SELECT r.clip, r.frame, r.kind, r.y, r.x, CASE WHEN r > {_EDGE * 1.5!r}e0 THEN true WHEN r < {_EDGE * 0.67!r}e0 THEN false ELSE s.cut END FROM st s JOIN r ON r.clip = s.clip AND r.frame = s.frame + 1 AND r.kind = s.kind AND r.y = s.y AND r.x = s.x)
    SELECT d.clip, d.frame, d.y, d.x, NOT (d.cut OR v.cut OR h.cut) AS upper, NOT (d.cut OR h2.cut OR v2.cut) AS lower
    FROM st d JOIN st v ON v.clip = d.clip AND v.frame = d.frame AND v.kind = 'v' AND v.y = d.y AND v.x = d.x JOIN st h ON h.clip = d.clip AND h.frame = d.frame AND h.kind = 'h' AND h.y = d.y AND h.x = d.x
    JOIN st h2 ON h2.clip = d.clip AND h2.frame = d.frame AND h2.kind = 'h' AND h2.y = d.y + 1 AND h2.x = d.x JOIN st v2 ON v2.clip = d.clip AND v2.frame = d.frame AND v2.kind = 'v' AND v2.y = d.y AND v2.x = d.x + 1
    WHERE d.kind = 'd'""",
)
def silhouette_hysteresis(spark: SparkSession, sf: str) -> DataFrame:
    """Triangles of each cell that are kept, when an edge's cut is set above 1.5 times the limit and cleared below 0.67 times."""
    w = Window.partitionBy("label").orderBy("vec_id")
    f = table(spark, sf, "embeddings").select(F.col("label").alias("clip"), (F.row_number().over(w) - 1).cast("long").alias("frame"), F.col("embedding").alias("e"))
    sides = (("h", 0, 0, 0, 1), ("v", 0, 0, 1, 0), ("d", 0, 1, 1, 0))
    places = [(k, y, x, (y + ay) * 8 + x + ax, (y + dy) * 8 + x + dx) for k, ay, ax, dy, dx in sides for y in range(8 - max(ay, dy)) for x in range(8 - max(ax, dx))]
    # The lattice's edges are an array: a frame stays one row until its cells are told.
    z = lambda c: 1 + 6 * F.abs(F.element_at("e", c + 1).cast("double"))
    ends = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for *_, p, q in places))
    jumps = f.select("clip", "frame", F.transform(ends, lambda s: F.abs(z(s["p"]) - z(s["q"])) / F.least(z(s["p"]), z(s["q"]))).alias("r"))
    cut = scans.hold_rasters(jumps, ["clip"], "frame", "r", _EDGE, _EDGE * 0.67, _EDGE * 1.5)
    of = {place[:3]: n for n, place in enumerate(places)}
    edges_of = lambda y, x: {"y": y, "x": x, "d": of["d", y, x], "v": of["v", y, x], "h": of["h", y, x], "h2": of["h", y + 1, x], "v2": of["v", y, x + 1]}
    cell = F.explode(F.array(*(F.struct(*(F.lit(n).cast("long" if k in "yx" else "int").alias(k) for k, n in edges_of(y, x).items())) for y in range(7) for x in range(7)))).alias("s")
    kept = lambda *c: ~(scans.switch("on", F.col(f"s.{c[0]}")) | scans.switch("on", F.col(f"s.{c[1]}")) | scans.switch("on", F.col(f"s.{c[2]}")))
    return cut.select("clip", "frame", "on", cell).select("clip", "frame", "s.y", "s.x", kept("d", "v", "h").alias("upper"), kept("d", "h2", "v2").alias("lower"))


_CODED = "CAST(floor(({c} + 1) * {m} + 0.5) AS BIGINT) % {n}"
_SPLATS = f"{PTS}, s AS (SELECT frame, slot, any_value(p ORDER BY vid) AS p, any_value(o ORDER BY vid) AS o FROM (SELECT frame, vid, vid * 7 % 60 AS slot, {_CODED.format(c='x', m='40000e0', n=65536)} AS p, {_CODED.format(c='o', m='127.5e0', n=256)} AS o FROM pts) GROUP BY frame, slot)"


def splat_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Points as splats of 60 slots a frame, some of them empty."""
    p = points(spark, sf)
    code = lambda c, m, n: F.pmod(F.floor((F.col(c) + 1) * m + 0.5), F.lit(n))
    rows = p.select("frame", "vid", (F.col("vid") * 7 % 60).alias("slot"), code("x", 40000.0, 65536).alias("p"), code("o", 127.5, 256).alias("o"))
    return rows.groupBy("frame", "slot").agg(F.min_by("p", "vid").alias("p"), F.min_by("o", "vid").alias("o"))


@query(
    "g17_splat_deltas",
    f"""WITH {_SPLATS}, old AS (SELECT frame + 1 AS frame, slot, p AS p0, o AS o0, row_number() OVER (PARTITION BY frame ORDER BY slot) - 1 AS pos FROM s),
    b AS (SELECT coalesce(s.frame, old.frame) AS frame, coalesce(s.slot, old.slot) AS slot, CASE WHEN old.slot IS NULL THEN 'birth' WHEN s.slot IS NULL THEN 'death' ELSE 'survivor' END AS kind, p, o, p0, o0, pos FROM s FULL JOIN old ON old.frame = s.frame AND old.slot = s.slot),
    c AS (SELECT * FROM b WHERE frame IN (SELECT frame FROM s) AND frame > (SELECT min(frame) FROM s))
    SELECT frame, slot, kind, CASE WHEN kind = 'death' THEN pos - coalesce(lag(pos) OVER (PARTITION BY frame, kind ORDER BY slot), -1) - 1 END AS gap,
        CASE WHEN kind = 'survivor' THEN ((p - p0 + 32768) % 65536 + 65536) % 65536 - 32768 ELSE p END AS p, CASE WHEN kind = 'survivor' THEN ((o - o0) % 256 + 256) % 256 ELSE o END AS o FROM c""",
)
def splat_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return splats.encode_deltas(splat_slots(spark, sf), ["p"], ["o"])


@query("g17_splat_decode", f"WITH {_SPLATS} SELECT frame, slot, p, o FROM s")
def splat_decode(spark: SparkSession, sf: str) -> DataFrame:
    """The splats again, from the first frame and the changes."""
    s = splat_slots(spark, sf)
    first = s.join(F.broadcast(s.agg(F.min("frame").alias("frame"))), "frame")
    return splats.decode_deltas(first, splats.encode_deltas(s, ["p"], ["o"]), ["p"], ["o"])
