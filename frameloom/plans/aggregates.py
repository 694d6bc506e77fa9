"""Aggregations over points, triangles, lattices, events and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.encodings import rounded
from ..operators import statistics as S
from ..session import table
from .common import PTS, SEQ, TRI, out, points, query, r6, sequences, triangles
from .regions import _GOPS, _LAT, gops, lattice
from .scalars import _M, P, m3

_AABB = ", ".join(f"{f}({c}) AS {f}_{c}" for c in P for f in ("min", "max"))


def bounds(*prefixes: str):
    return [f(c).alias(f"{n}_{c}") for c in P for f, n in ((F.min, "min"), (F.max, "max"))]


@query("f01_bounds", f"WITH {PTS} SELECT frame, {_AABB} FROM pts GROUP BY frame")
def frame_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).groupBy("frame").agg(*bounds())


@query("f02_bounds_rollup", f"WITH {PTS} SELECT coalesce(CAST(floor(frame/4) AS BIGINT), -1) AS gop, coalesce(frame, -1) AS frame, {_AABB} FROM pts GROUP BY GROUPING SETS ((floor(frame/4), frame), (floor(frame/4)), ())")
def bounds_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of frames, of groups of four frames and of the clip."""
    p = points(spark, sf).withColumn("gop", F.floor(F.col("frame") / 4))
    return p.rollup("gop", "frame").agg(*bounds()).select(F.coalesce("gop", F.lit(-1)).alias("gop"), F.coalesce("frame", F.lit(-1)).alias("frame"), *(f"{n}_{c}" for c in P for n in ("min", "max")))


@query("f03_bounds_min_alpha", f"WITH {PTS} SELECT frame, " + ", ".join(f"coalesce({f}({c}) FILTER (o >= 0.3), {f}({c})) AS {f}_{c}" for c in P for f in ("min", "max")) + " FROM pts GROUP BY frame")
def bounds_min_alpha(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of splats of some opacity; of all where none has it."""
    solid = lambda f, c: F.coalesce(f(F.when(F.col("o") >= 0.3, F.col(c))), f(c))
    return points(spark, sf).groupBy("frame").agg(*(solid(f, c).alias(f"{n}_{c}") for c in P for f, n in ((F.min, "min"), (F.max, "max"))))


_TC = m3(_M, [f"(CASE WHEN (i >> {k}) & 1 = 1 THEN h{c} ELSE l{c} END)" for k, c in enumerate(P)])


@query("f04_transform_bounds", f"WITH {PTS}, bx AS (SELECT frame, {', '.join(f'min({c}) AS l{c}, max({c}) AS h{c}' for c in P)} FROM pts GROUP BY frame), co AS (SELECT frame, {', '.join(f'{s} AS t{c}' for c, s in zip(P, _TC, strict=True))} FROM bx, range(8) r(i)) SELECT frame, {', '.join(r6(f'{f}(t{c})') + f' AS {f}_{c}' for c in P for f in ('min', 'max'))} FROM co GROUP BY frame")
def transform_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of a turned box, from its eight corners."""
    b = points(spark, sf).groupBy("frame").agg(*bounds()).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7))))
    corner = tuple(F.when(F.shiftright("i", k).bitwiseAND(F.lit(1)) == 1, F.col(f"max_{c}")).otherwise(F.col(f"min_{c}")) for k, c in enumerate(P))
    t = b.select("frame", *(v.alias("t" + c) for c, v in zip(P, G.affine(_M, (0.0, 0.0, 0.0), corner), strict=True)))
    return t.groupBy("frame").agg(*(rounded(f("t" + c)).alias(f"{n}_{c}") for c in P for f, n in ((F.min, "min"), (F.max, "max"))))


@query("f05_center_offset", f"WITH {PTS} SELECT {r6('-(min(x)+max(x))/2')} AS ox, {r6('-min(y)')} AS bottom_y, {r6('-(min(y)+max(y))/2')} AS mass_y, {r6('-(min(z)+max(z))/2')} AS oz FROM pts")
def center_offset(spark: SparkSession, sf: str) -> DataFrame:
    """From the bounds of the whole clip, never of a frame."""
    mid = lambda c: -(F.min(c) + F.max(c)) / 2.0
    return points(spark, sf).agg(*(rounded(v).alias(n) for n, v in (("ox", mid("x")), ("bottom_y", -F.min("y")), ("mass_y", mid("y")), ("oz", mid("z")))))


_U = ['(bx-ax)', '("by"-ay)', '(bz-az)']
_V = ['(cx-ax)', '(cy-ay)', '(cz-az)']
_FN = [f"({_U[1]}*{_V[2]}-{_U[2]}*{_V[1]})", f"({_U[2]}*{_V[0]}-{_U[0]}*{_V[2]})", f"({_U[0]}*{_V[1]}-{_U[1]}*{_V[0]})"]


def corners(n: str) -> tuple:
    return tuple(F.col(n + c) for c in P)


def face_normal():
    return G.cross(G.minus(corners("b"), corners("a")), G.minus(corners("c"), corners("a")))


@query("f06_smooth_normals", f"WITH {TRI}, fn AS (SELECT a, b, c, {', '.join(f'{s} AS n{c}' for c, s in zip(P, _FN, strict=True))} FROM tri), e AS (SELECT a AS v, nx, ny, nz FROM fn UNION ALL SELECT b, nx, ny, nz FROM fn UNION ALL SELECT c, nx, ny, nz FROM fn), s AS (SELECT v, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM e GROUP BY v) SELECT v, {', '.join(r6(f'n{c}/(CASE WHEN sqrt(nx*nx+ny*ny+nz*nz)=0 THEN 1 ELSE sqrt(nx*nx+ny*ny+nz*nz) END)') + f' AS n{c}' for c in P)} FROM s")
def smooth_normals(spark: SparkSession, sf: str) -> DataFrame:
    """Area-weighted face normals summed at the vertices."""
    t = triangles(spark, sf).select(F.explode(F.array("a", "b", "c")).alias("v"), *(n.alias("n" + c) for c, n in zip(P, face_normal(), strict=True)))
    s = t.groupBy("v").agg(*(F.sum("n" + c).alias("n" + c) for c in P))
    return s.select("v", *out(**{"n" + c: n for c, n in zip(P, G.normalized(tuple(F.col("n" + c) for c in P)), strict=True)}))


_EDGE = "ed AS (SELECT tid, a AS p, b AS q FROM tri UNION ALL SELECT tid, b, c FROM tri UNION ALL SELECT tid, c, a FROM tri)"


def edges(spark: SparkSession, sf: str) -> DataFrame:
    pair = lambda p, q: F.struct(F.col(p).alias("p"), F.col(q).alias("q"))
    return triangles(spark, sf).select("tid", F.explode(F.array(pair("a", "b"), pair("b", "c"), pair("c", "a"))).alias("e")).select("tid", "e.*")


@query("f07_vertex_adjacency", f"WITH {TRI}, {_EDGE}, u AS (SELECT p AS v, q AS w FROM ed UNION SELECT q, p FROM ed) SELECT v, count(*) AS degree, string_agg(w, ',' ORDER BY w) AS neighbours FROM u GROUP BY v")
def vertex_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    both = e.select(F.col("p").alias("v"), F.col("q").alias("w")).union(e.select("q", "p")).distinct()
    return both.groupBy("v").agg(F.count("*").alias("degree"), F.array_join(F.sort_array(F.collect_set("w")), ",").alias("neighbours"))


@query("f08_boundary_edges", f"WITH {TRI}, {_EDGE} SELECT least(p, q) AS p, greatest(p, q) AS q FROM ed GROUP BY 1, 2 HAVING count(*) = 1")
def boundary_edges(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).groupBy(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).count().where("count = 1").select("p", "q")


@query("f11_depth_histogram", f"WITH {PTS}, h AS (SELECT CAST(least(floor(least(greatest(abs(x),0),1)*64), 63) AS BIGINT) AS bin, count(*) AS n FROM pts GROUP BY 1) SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin DESC) AS BIGINT) AS from_near FROM h")
def depth_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Equal bins of disparity and their running count from the near end; as many rows as bins."""
    h = points(spark, sf).groupBy(F.least(F.floor(F.least(F.greatest(F.abs("x"), F.lit(0.0)), F.lit(1.0)) * 64), F.lit(63)).alias("bin")).agg(F.count("*").alias("n"))
    return h.select("bin", "n", F.sum("n").over(Window.orderBy(F.desc("bin"))).alias("from_near"))


@query("f12_median", "SELECT event_type, median(value) AS median FROM events GROUP BY event_type")
def median(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(S.median_of_two(F.col("value")).alias("median"))


@query("f13_upper_median", "SELECT user_id, list_sort(list(value))[count(*)//2 + 1] AS v FROM events GROUP BY user_id")
def upper_median(spark: SparkSession, sf: str) -> DataFrame:
    return S.ranks(table(spark, sf, "events"), ["user_id"], "value", v=S.upper_median)


@query("f14_percentiles", "SELECT user_id, list_sort(list(value))[CAST(floor(0.9*(count(*)-1)+0.5) AS INT)+1] AS p90, list_sort(list(value))[CAST(least(count(*)-1, floor(0.95*count(*))) AS INT)+1] AS p95 FROM events GROUP BY user_id")
def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return S.ranks(table(spark, sf, "events"), ["user_id"], "value", p90=S.nearest_rank(0.9), p95=S.floor_rank(0.95))


@query("f15_robust_fit", f"WITH l AS (SELECT l_suppkey % 20 AS k, l_quantity AS x, l_extendedprice AS y FROM lineitem), f AS (SELECT k, count(*) AS n, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM l GROUP BY k HAVING count(*) >= 3), r AS (SELECT l.*, abs(y - a*x - b) AS res FROM l JOIN f USING (k)), m AS (SELECT k, 3 * list_sort(list(res))[count(*)//2 + 1] + 10 AS lim FROM r GROUP BY k), g AS (SELECT k, count(*) AS inliers, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM r JOIN m USING (k) WHERE res <= lim GROUP BY k HAVING count(*) >= 3) SELECT f.k, f.n, g.inliers, {r6('g.a', 3)} AS a, {r6('g.b', 2)} AS b FROM f JOIN g USING (k)")
def robust_fit(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("k"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return S.robust_fit(rows, ["k"], "x", "y", 10.0).select("k", "n", "inliers", rounded(F.col("a"), 3).alias("a"), rounded(F.col("b"), 2).alias("b"))


@query("f16_moment_match", f"WITH {SEQ}, m AS (SELECT a.clip, stddev_pop(b.value)/stddev_pop(a.value) AS a0, avg(a.value) AS mx, avg(b.value) AS my, count(*) AS n FROM seq a JOIN seq b ON b.clip = a.clip AND b.frame = a.frame + 1 GROUP BY a.clip HAVING count(*) >= 5 AND stddev_pop(a.value) > 0) SELECT clip, n, {r6('least(greatest(a0, 0.5), 2.0)')} AS a, {r6('my - least(greatest(a0, 0.5), 2.0) * mx', 4)} AS b FROM m")
def moment_match(spark: SparkSession, sf: str) -> DataFrame:
    """Scale and shift that give a frame's values the next frame's spread and mean; the scale stays in 0.5 to 2."""
    s = sequences(spark, sf)
    nxt = s.select("clip", (F.col("frame") - 1).alias("frame"), F.col("value").alias("y"))
    m = s.join(nxt, ["clip", "frame"]).groupBy("clip").agg(F.stddev_pop("y").alias("sy"), F.stddev_pop("value").alias("sx"), F.avg("value").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n")).where("n >= 5 and sx > 0")
    a = F.least(F.greatest(F.col("sy") / F.col("sx"), F.lit(0.5)), F.lit(2.0))
    return m.select("clip", "n", rounded(a).alias("a"), rounded(F.col("my") - a * F.col("mx"), 4).alias("b"))


@query("f18_anchor_scale", f"WITH {_LAT}, p AS (SELECT a.gy, b.d / a.d AS r FROM lat a JOIN lat b ON b.gy = a.gy + 1 AND b.gx = a.gx), m AS (SELECT gy, count(*) AS n, median(r) AS s FROM p GROUP BY gy) SELECT m.gy, any_value(n) AS n, {r6('any_value(s)')} AS scale, {r6('median(abs(r - s))')} AS mad FROM m JOIN p USING (gy) GROUP BY m.gy")
def anchor_scale(spark: SparkSession, sf: str) -> DataFrame:
    """Median ratio of two rows' shared pixels and its median deviation."""
    p = lattice(spark, sf)
    r = p.join(p.select((F.col("gy") - 1).alias("gy"), "gx", F.col("d").alias("e")), ["gy", "gx"]).select("gy", (F.col("e") / F.col("d")).alias("r"))
    m = r.groupBy("gy").agg(F.count("*").alias("n"), F.median("r").alias("s"))
    return r.join(m, "gy").groupBy("gy").agg(F.first("n").alias("n"), rounded(F.first("s")).alias("scale"), rounded(F.median(F.abs(F.col("r") - F.col("s")))).alias("mad"))


@query("f19_gradient_vote", f"WITH {_LAT}, g AS (SELECT gy, d - lag(d) OVER (PARTITION BY gy ORDER BY gx) AS dx, z FROM (SELECT l.*, d * d AS z FROM lat l)) SELECT gy, CAST(sum(sign(dx)) AS BIGINT) AS vote FROM g GROUP BY gy")
def gradient_vote(spark: SparkSession, sf: str) -> DataFrame:
    step = F.col("d") - F.lag("d").over(Window.partitionBy("gy").orderBy("gx"))
    return lattice(spark, sf).select("gy", step.alias("dx")).groupBy("gy").agg(F.sum(F.signum("dx")).cast("long").alias("vote"))


# Triangles drawn on a 48 x 48 raster, by their x and y.
_PX = lambda c: f"({c} + 0.6) / 1.2 * 48"
_RASTER = (
    f"{TRI}, px AS (SELECT tid, {_PX('ax')} AS ax, {_PX('ay')} AS ay, {_PX('bx')} AS bx, {_PX(chr(34) + 'by' + chr(34))} AS b_y, {_PX('cx')} AS cx, {_PX('cy')} AS cy, az, bz, cz FROM tri),"
    " ar AS (SELECT *, (bx-ax)*(cy-ay)-(b_y-ay)*(cx-ax) AS area FROM px), gr AS (SELECT tid, ax, ay, bx, b_y, cx, cy, az, bz, cz, area, i AS gx, j AS gy FROM ar, range(48) r(i), range(48) s(j) WHERE area <> 0),"
    " w AS (SELECT *, ((bx-(gx+0.5))*(cy-(gy+0.5))-(b_y-(gy+0.5))*(cx-(gx+0.5)))*(1/area) AS w0, ((cx-(gx+0.5))*(ay-(gy+0.5))-(cy-(gy+0.5))*(ax-(gx+0.5)))*(1/area) AS w1 FROM gr),"
    " hit AS (SELECT tid, gx, gy, w0*az+w1*bz+(1-w0-w1)*cz AS z FROM w WHERE w0 >= 0 AND w1 >= 0 AND 1-w0-w1 >= 0)"
)


def rasterized(spark: SparkSession, sf: str, size: int = 48) -> DataFrame:
    """(tid, gx, gy, z) of each pixel whose centre a triangle covers; a triangle is dealt to its bounding box only."""
    t = triangles(spark, sf)
    px = {n + c: (F.col(n + c) + 0.6) / 1.2 * size for n in "abc" for c in "xy"}
    t = t.select("tid", "az", "bz", "cz", *(v.alias(k) for k, v in px.items()))
    c = F.col
    t = t.withColumn("area", (c("bx") - c("ax")) * (c("cy") - c("ay")) - (c("by") - c("ay")) * (c("cx") - c("ax"))).where("area <> 0")
    low = lambda a: F.greatest(F.lit(0), F.floor(F.least(*(c(n + a) for n in "abc"))))
    high = lambda a: F.least(F.lit(size - 1), F.ceil(F.greatest(*(c(n + a) for n in "abc"))))
    t = t.where((high("x") >= low("x")) & (high("y") >= low("y"))).withColumn("gx", F.explode(F.sequence(low("x"), high("x")))).withColumn("gy", F.explode(F.sequence(low("y"), high("y"))))
    u, v, inverse = c("gx") + 0.5, c("gy") + 0.5, 1.0 / c("area")
    t = t.withColumn("w0", ((c("bx") - u) * (c("cy") - v) - (c("by") - v) * (c("cx") - u)) * inverse).withColumn("w1", ((c("cx") - u) * (c("ay") - v) - (c("cy") - v) * (c("ax") - u)) * inverse)
    t = t.where("w0 >= 0 and w1 >= 0 and 1 - w0 - w1 >= 0")
    return t.select("tid", "gx", "gy", (c("w0") * c("az") + c("w1") * c("bz") + (1.0 - c("w0") - c("w1")) * c("cz")).alias("z"))


@query("f20_footprint", f"WITH {_RASTER} SELECT DISTINCT CAST(gx AS BIGINT) AS gx, CAST(gy AS BIGINT) AS gy FROM hit")
def footprint(spark: SparkSession, sf: str) -> DataFrame:
    return rasterized(spark, sf).select("gx", "gy").distinct()


@query("f21_z_buffer", f"WITH {_RASTER} SELECT CAST(gx AS BIGINT) AS gx, CAST(gy AS BIGINT) AS gy, arg_min(tid, (z, tid)) AS tid, {r6('min(z)')} AS z FROM hit GROUP BY ALL")
def z_buffer(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest triangle of each pixel, the first of equally near ones."""
    near = rasterized(spark, sf).groupBy("gx", "gy").agg(F.min(F.struct("z", "tid")).alias("n"))
    return near.select("gx", "gy", "n.tid", rounded(F.col("n.z")).alias("z"))


@query("m02_pick", f"WITH {_RASTER} SELECT arg_min(tid, (z, tid)) AS tid FROM hit WHERE gx = 24 AND gy = 24")
def pick(spark: SparkSession, sf: str) -> DataFrame:
    return rasterized(spark, sf).where("gx = 24 and gy = 24").agg(F.min(F.struct("z", "tid")).alias("n")).select("n.tid")


@query("f22_paint_weights", f"WITH {_RASTER} SELECT CAST(gx AS BIGINT) AS gx, CAST(gy AS BIGINT) AS gy, {r6('max(CASE WHEN z <= 0 THEN 1.0 WHEN z >= 0.2 THEN 0.0 ELSE (1-z/0.2)*(1-z/0.2)*(3-2*(1-z/0.2)) END)')} AS w FROM hit GROUP BY ALL")
def paint_weights(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.encodings import smoothstep_falloff

    return rasterized(spark, sf).groupBy("gx", "gy").agg(rounded(F.max(smoothstep_falloff(F.col("z"), 0.2))).alias("w"))


@query("f24_tile_fill", f"WITH {_LAT}, t AS (SELECT CAST(floor(gy/5) AS BIGINT) AS ty, CAST(floor(gx/5) AS BIGINT) AS tx, CASE WHEN gy % 5 IN (0,4) OR gx % 5 IN (0,4) THEN CASE WHEN d > 2.2 THEN floor(d*60) END END AS v FROM lat) SELECT ty, tx, {r6('coalesce(avg(v), 128)')} AS fill FROM t GROUP BY ALL")
def tile_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Mean colour of a tile's rim, grey where the rim has none."""
    rim = (F.col("gy") % 5).isin(0, 4) | (F.col("gx") % 5).isin(0, 4)
    t = lattice(spark, sf).select(F.floor(F.col("gy") / 5).alias("ty"), F.floor(F.col("gx") / 5).alias("tx"), F.when(rim & (F.col("d") > 2.2), F.floor(F.col("d") * 60)).alias("v"))
    return t.groupBy("ty", "tx").agg(rounded(F.coalesce(F.avg("v"), F.lit(128.0))).alias("fill"))


@query("f25_letterbox", "WITH p AS (SELECT user_id AS clip, hour(ts) AS row, max(value) AS top FROM events GROUP BY ALL), b AS (SELECT clip, min(row) FILTER (top > 24) AS first, max(row) FILTER (top > 24) AS last FROM p GROUP BY clip) SELECT clip, CASE WHEN last - first + 1 >= 6 THEN first ELSE 0 END AS bar_top, CASE WHEN last - first + 1 >= 6 THEN 23 - last ELSE 0 END AS bar_bottom FROM b WHERE first IS NOT NULL")
def letterbox(spark: SparkSession, sf: str) -> DataFrame:
    """Leading and trailing rows that stay dark; a picture of under a quarter of the rows has no bars."""
    rows = table(spark, sf, "events").groupBy(F.col("user_id").alias("clip"), F.hour("ts").alias("row")).agg(F.max("value").alias("top"))
    lit = F.when(F.col("top") > 24, F.col("row"))
    b = rows.groupBy("clip").agg(F.min(lit).alias("first"), F.max(lit).alias("last")).where("first is not null")
    picture = F.col("last") - F.col("first") + 1 >= 6
    return b.select("clip", F.when(picture, F.col("first")).otherwise(0).cast("long").alias("bar_top"), F.when(picture, 23 - F.col("last")).otherwise(0).cast("long").alias("bar_bottom"))


@query("f26_error_stats", f"WITH {TRI}, e AS (SELECT frame, sqrt((ax-bx)*(ax-bx)+(ay-\"by\")*(ay-\"by\")+(az-bz)*(az-bz)) AS d FROM tri) SELECT frame, {r6('avg(d)')} AS mean, {r6('list_sort(list(d))[CAST(least(count(*)-1, floor(0.95*count(*))) AS INT)+1]')} AS p95, {r6('max(d)')} AS worst, {r6('sum(CASE WHEN d > 0.15 THEN 1 ELSE 0 END) * 100.0 / count(*)')} AS over FROM e GROUP BY frame")
def error_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = G.length(G.minus(corners("a"), corners("b")))
    e = triangles(spark, sf).select("frame", d.alias("d"))
    means = e.groupBy("frame").agg(rounded(F.avg("d")).alias("mean"), rounded(F.max("d")).alias("worst"), rounded(F.count_if(F.col("d") > 0.15) * 100.0 / F.count("*")).alias("over"))
    return means.join(S.ranks(e, ["frame"], "d", p95=S.floor_rank(0.95)), "frame").select("frame", "mean", rounded(F.col("p95")).alias("p95"), "worst", "over")


_LEN = "sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z))"
_REST = "sqrt((p.s0-q.s0)*(p.s0-q.s0)+(p.s1-q.s1)*(p.s1-q.s1)+(p.s2-q.s2)*(p.s2-q.s2))"


@query("f27_edge_stretch", f"WITH {TRI}, {_EDGE}, u AS (SELECT DISTINCT least(p,q) AS p, greatest(p,q) AS q FROM ed), l AS (SELECT {_LEN} AS now, {_REST} AS rest FROM u JOIN pts p ON p.vid = u.p JOIN pts q ON q.vid = u.q), r AS (SELECT now/rest AS r, now FROM l WHERE rest > 0) SELECT {r6('max(r)')} AS stretch, {r6('list_sort(list(r))[CAST(least(count(*)-1, floor(0.999*count(*))) AS INT)+1]')} AS p999, {r6('max(now)')} AS longest FROM r")
def edge_stretch(spark: SparkSession, sf: str) -> DataFrame:
    """Edge lengths against their lengths at rest, which the scales stand for."""
    p = points(spark, sf)
    end = lambda n: p.select(F.col("vid").alias(n), *(F.col(c).alias(n + c) for c in (*P, "s0", "s1", "s2")))
    u = edges(spark, sf).select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct().join(end("p"), "p").join(end("q"), "q")
    gap = lambda cs: G.length(tuple(F.col("p" + c) - F.col("q" + c) for c in cs))
    r = u.select(gap(P).alias("now"), gap(("s0", "s1", "s2")).alias("rest")).where("rest > 0").select((F.col("now") / F.col("rest")).alias("r"), "now")
    most = r.agg(rounded(F.max("r")).alias("stretch"), rounded(F.max("now")).alias("longest"))
    # One row each.
    return most.crossJoin(F.broadcast(S.ranks(r, [], "r", p999=S.floor_rank(0.999)))).select("stretch", rounded(F.col("p999")).alias("p999"), "longest")


_DET = "(ax*(\"by\"*cz-bz*cy) - ay*(bx*cz-bz*cx) + az*(bx*cy-\"by\"*cx))/6.0"


def signed_volume():
    a, b, c = corners("a"), corners("b"), corners("c")
    n = G.cross(b, c)
    return (a[0] * n[0] + a[1] * n[1] + a[2] * n[2]) / 6.0


@query("f28_mesh_volume", f"WITH {TRI} SELECT frame, {r6(f'sum({_DET})')} AS volume FROM tri GROUP BY frame")
def mesh_volume(spark: SparkSession, sf: str) -> DataFrame:
    return triangles(spark, sf).groupBy("frame").agg(rounded(F.sum(signed_volume())).alias("volume"))


@query("f29_outward_sign", f"WITH {TRI} SELECT frame, CAST(sign(sum({_DET})) AS BIGINT) AS outward FROM tri GROUP BY frame")
def outward_sign(spark: SparkSession, sf: str) -> DataFrame:
    return triangles(spark, sf).groupBy("frame").agg(F.signum(F.sum(signed_volume())).cast("long").alias("outward"))


_AREA = f"0.5*sqrt({_FN[0]}*{_FN[0]}+{_FN[1]}*{_FN[1]}+{_FN[2]}*{_FN[2]})"


@query("f30_mesh_health", f"WITH {TRI}, q AS (SELECT frame, {_AREA} AS area FROM tri) SELECT frame, count(*) AS triangles, {r6('sum(area)')} AS area, {r6('quantile_cont(area, 0.5)')} AS p50, {r6('quantile_cont(area, 0.95)')} AS p95, sum(CASE WHEN area < 0.005 THEN 1 ELSE 0 END)::BIGINT AS slivers FROM q GROUP BY frame")
def mesh_health(spark: SparkSession, sf: str) -> DataFrame:
    q = triangles(spark, sf).select("frame", (0.5 * G.length(face_normal())).alias("area"))
    return q.groupBy("frame").agg(F.count("*").alias("triangles"), rounded(F.sum("area")).alias("area"), rounded(F.percentile("area", 0.5)).alias("p50"), rounded(F.percentile("area", 0.95)).alias("p95"), F.count_if(F.col("area") < 0.005).alias("slivers"))


@query("f31_position_error", f"WITH {PTS}, e AS (SELECT frame, (x-floor(x*50+0.5)/50)*(x-floor(x*50+0.5)/50)+(y-floor(y*50+0.5)/50)*(y-floor(y*50+0.5)/50) AS d2, x, y FROM pts) SELECT frame, {r6('sqrt(avg(d2))/sqrt((max(x)-min(x))*(max(x)-min(x))+(max(y)-min(y))*(max(y)-min(y)))')} AS rms, {r6('sqrt(max(d2))')} AS worst FROM e GROUP BY frame")
def position_error(spark: SparkSession, sf: str) -> DataFrame:
    """Error of positions on a grid of 1/50, over the frame's diagonal."""
    off = lambda c: F.col(c) - F.floor(F.col(c) * 50 + 0.5) / 50.0
    e = points(spark, sf).select("frame", "x", "y", (off("x") * off("x") + off("y") * off("y")).alias("d2"))
    w, h = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    return e.groupBy("frame").agg(rounded(F.sqrt(F.avg("d2")) / F.sqrt(w * w + h * h)).alias("rms"), rounded(F.sqrt(F.max("d2"))).alias("worst"))


@query("f32_psnr", f"WITH {PTS}, e AS (SELECT frame, (floor(abs(r)*255)-floor(abs(g)*255)) AS d FROM pts) SELECT frame, {r6('10*log10(65025.0/avg(d*d))', 4)} AS psnr FROM e GROUP BY frame")
def psnr(spark: SparkSession, sf: str) -> DataFrame:
    d = F.floor(F.abs("r") * 255) - F.floor(F.abs("g") * 255)
    return points(spark, sf).select("frame", d.alias("d")).groupBy("frame").agg(rounded(10.0 * F.log10(65025.0 / F.avg(F.col("d") * F.col("d"))), 4).alias("psnr"))


@query("f33_codec_stats", f"WITH b AS (SELECT lang AS clip, source AS codec, sum(n_chars) AS bytes, count(*) AS frames, avg(n_chars) AS mean, median(n_chars) AS med FROM documents GROUP BY ALL), r AS (SELECT clip, bytes / CAST(frames AS DOUBLE) AS raw FROM b WHERE codec = 'src0') SELECT clip, codec, {r6('bytes / CAST(frames AS DOUBLE)', 3)} AS per_frame, {r6('mean', 3)} AS mean, {r6('med', 3)} AS median, {r6('bytes / CAST(frames AS DOUBLE) / raw')} AS ratio FROM b JOIN r USING (clip)")
def codec_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes per clip and codec against the raw codec's, with languages, sources and lengths standing for them."""
    b = table(spark, sf, "documents").groupBy(F.col("lang").alias("clip"), F.col("source").alias("codec")).agg(F.sum("n_chars").alias("bytes"), F.count("*").alias("frames"), F.avg("n_chars").alias("mean"), F.median("n_chars").alias("med"))
    per = F.col("bytes") / F.col("frames").cast("double")
    raw = b.where("codec = 'src0'").select("clip", per.alias("raw"))
    return b.join(raw, "clip").select("clip", "codec", rounded(per, 3).alias("per_frame"), rounded(F.col("mean"), 3).alias("mean"), rounded(F.col("med"), 3).alias("median"), rounded(per / F.col("raw")).alias("ratio"))


@query("f34_clip_info", f"WITH {_GOPS}, f AS (SELECT clip, count(*) AS frames, count(DISTINCT event_type) AS tracks, max(frame) * 33366 AS duration FROM seq GROUP BY clip), g AS (SELECT clip, count(*) AS chunks FROM gop GROUP BY clip) SELECT clip, frames, CAST(duration AS BIGINT) AS duration, chunks, tracks FROM f JOIN g USING (clip)")
def clip_info(spark: SparkSession, sf: str) -> DataFrame:
    f = sequences(spark, sf).groupBy("clip").agg(F.count("*").alias("frames"), F.countDistinct("event_type").alias("tracks"), (F.max("frame") * 33366).alias("duration"))
    return f.join(gops(spark, sf).groupBy("clip").agg(F.count("*").alias("chunks")), "clip").select("clip", "frames", "duration", "chunks", "tracks")


@query("f35_player_stats", "SELECT user_id AS clip, coalesce(CAST(sum(length(props)) FILTER (event_type = 'click') AS BIGINT), 0) AS click, coalesce(CAST(sum(length(props)) FILTER (event_type = 'view') AS BIGINT), 0) AS view, CAST(sum(length(props)) AS BIGINT) AS total FROM events GROUP BY user_id")
def player_stats(spark: SparkSession, sf: str) -> DataFrame:
    size = F.length("props")
    part = lambda t: F.coalesce(F.sum(F.when(F.col("event_type") == t, size)), F.lit(0)).alias(t)
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("clip")).agg(part("click"), part("view"), F.sum(size).alias("total"))


_RUNS = f"{SEQ}, rn AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY clip ORDER BY frame) THEN 1 ELSE 0 END AS n FROM seq), ri AS (SELECT *, sum(n) OVER (PARTITION BY clip ORDER BY frame) AS run FROM rn), rl AS (SELECT clip, run, count(*) AS len FROM ri GROUP BY ALL)"


@query("f36_run_summary", f"WITH {_RUNS} SELECT clip, count(*) AS runs, sum(CASE WHEN len = 1 THEN 1 ELSE 0 END)::BIGINT AS singles, max(len) AS longest, {r6('avg(len)')} AS mean FROM rl GROUP BY clip")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.islands import island

    line = Window.partitionBy("clip").orderBy("frame")
    r = island(sequences(spark, sf), ["clip"], ["frame"], F.col("event_type") != F.lag("event_type").over(line), "run").groupBy("clip", "run").agg(F.count("*").alias("len"))
    return r.groupBy("clip").agg(F.count("*").alias("runs"), F.count_if(F.col("len") == 1).alias("singles"), F.max("len").alias("longest"), rounded(F.avg("len")).alias("mean"))


@query("f37_edit_report", "SELECT user_id AS range_id, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS derived, sum(CASE WHEN event_id % 2 = 1 THEN 1 ELSE 0 END)::BIGINT AS own, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS shapes, sum(CASE WHEN value < 0 THEN 1 ELSE 0 END)::BIGINT AS issues FROM events GROUP BY user_id")
def edit_report(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("range_id"))
    return e.agg(F.count_if(F.col("event_id") % 2 == 0).alias("derived"), F.count_if(F.col("event_id") % 2 == 1).alias("own"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("shapes"), F.count_if(F.col("value") < 0).alias("issues"))


@query("f38_source_measure", f"SELECT source, CAST(sum(n_chars) AS BIGINT) AS used, {r6('sum(n_chars) / CAST(sum(strlen(text)) AS DOUBLE)')} AS ratio FROM documents GROUP BY source")
def source_measure(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.sum("n_chars").alias("used"), rounded(F.sum("n_chars") / F.sum(F.octet_length("text")).cast("double")).alias("ratio"))


@query("f39_depth_band", f"WITH {_LAT} SELECT gy, {r6('min(d) - 0.002')} AS zmin, {r6('max(d) + 0.002')} AS zmax FROM lat WHERE gx BETWEEN 4 AND 12 GROUP BY gy")
def depth_band(spark: SparkSession, sf: str) -> DataFrame:
    return lattice(spark, sf).where(F.col("gx").between(4, 12)).groupBy("gy").agg(rounded(F.min("d") - 0.002).alias("zmin"), rounded(F.max("d") + 0.002).alias("zmax"))


@query("f40_measure_distance", f"WITH {TRI}, m AS (SELECT tid, (ax+bx+cx)/3.0 AS x, (ay+\"by\"+cy)/3.0 AS y, (az+bz+cz)/3.0 AS z FROM tri) SELECT {r6('sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z))')} AS distance FROM m p JOIN m q ON p.tid = 7 AND q.tid = 77")
def measure_distance(spark: SparkSession, sf: str) -> DataFrame:
    from .regions import centroid

    m = triangles(spark, sf).where(F.col("tid").isin(7, 77)).select("tid", *(v.alias(c) for c, v in centroid().items()))
    at = lambda t, c: F.max(F.when(F.col("tid") == t, F.col(c)))
    return m.agg(rounded(G.length(tuple(at(7, c) - at(77, c) for c in P))).alias("distance"))


# Eight views along diagonals; a voxel is outside a view's disc of radius 1.
_VIEWS = "vw(k, ux, uy, vx, vy) AS (VALUES (0,1.0,0.0,0.0,1.0),(1,0.8,0.6,-0.6,0.8),(2,0.6,0.8,-0.8,0.6),(3,0.0,1.0,-1.0,0.0))"


@query("f41_visual_hull", f"WITH {_VIEWS}, vox AS (SELECT i // 400 - 10 AS a, i // 20 % 20 - 10 AS b, i % 20 - 10 AS c FROM range(8000) r(i)), s AS (SELECT a, b, c, sum(CASE WHEN (a*ux+b*uy)*(a*ux+b*uy)/49.0 + c*c/(25.0+k) > 1 THEN 1 ELSE 0 END) AS outside FROM vox, vw GROUP BY ALL) SELECT c, count(*) AS voxels FROM s WHERE outside <= 1 GROUP BY c")
def visual_hull(spark: SparkSession, sf: str) -> DataFrame:
    """Voxels that at most one view sees outside its silhouette, by layer; views are a configuration of a few rows."""
    views = spark.createDataFrame([(0, 1.0, 0.0), (1, 0.8, 0.6), (2, 0.6, 0.8), (3, 0.0, 1.0)], "k int, ux double, uy double")
    i = F.col("id")
    vox = spark.range(8000).select((F.floor(i / 400) - 10).alias("a"), (F.floor(i / 20) % 20 - 10).alias("b"), (i % 20 - 10).alias("c"))
    c = F.col
    along = c("a") * c("ux") + c("b") * c("uy")
    seen = along * along / 49.0 + c("c") * c("c") / (25.0 + c("k")) > 1
    s = vox.crossJoin(F.broadcast(views)).groupBy("a", "b", "c").agg(F.count_if(seen).alias("outside"))
    return s.where("outside <= 1").groupBy("c").agg(F.count("*").alias("voxels"))


@query("f42_mask_iou", f"WITH {PTS}, m AS (SELECT frame, vid % 7 AS inst, sum(CASE WHEN x > 0 AND y > 0 THEN 1 ELSE 0 END) / CAST(sum(CASE WHEN x > 0 OR y > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS iou FROM pts GROUP BY ALL HAVING sum(CASE WHEN x > 0 OR y > 0 THEN 1 ELSE 0 END) > 0), b AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY iou DESC, inst) AS k FROM m) SELECT frame, inst, {r6('iou')} AS iou, iou >= 0.5 AS accepted FROM b WHERE k = 1")
def mask_iou(spark: SparkSession, sf: str) -> DataFrame:
    """The instance of largest overlap in each frame, accepted from a half on."""
    both, either = (F.col("x") > 0) & (F.col("y") > 0), (F.col("x") > 0) | (F.col("y") > 0)
    m = points(spark, sf).groupBy("frame", (F.col("vid") % 7).alias("inst")).agg(F.count_if(both).alias("i"), F.count_if(either).alias("u")).where("u > 0")
    best = m.withColumn("iou", F.col("i") / F.col("u").cast("double")).groupBy("frame").agg(F.max(F.struct("iou", (-F.col("inst")).alias("k"))).alias("b"))
    return best.select("frame", (-F.col("b.k")).alias("inst"), rounded(F.col("b.iou")).alias("iou"), (F.col("b.iou") >= 0.5).alias("accepted"))
