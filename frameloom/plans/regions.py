"""Region algebra, filters and joins over points, triangles and event sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.encodings import rounded
from ..operators.asof import asof, bracket, interval_join, nearest_valid
from ..operators.islands import coalesce_gaps
from ..session import table
from .common import PTS, SEQ, TRI, out, points, query, r6, sequences, triangles

P = ("x", "y", "z")
LOW, HIGH = (-0.15, -0.2, -0.25), (0.2, 0.15, 0.25)
_C = {"x": "(ax+bx+cx)/3.0", "y": '(ay+"by"+cy)/3.0', "z": "(az+bz+cz)/3.0"}
_IN = " AND ".join(f"{_C[c]} BETWEEN {a} AND {b}" for c, a, b in zip(P, LOW, HIGH, strict=True))


def xyz() -> tuple:
    return tuple(F.col(c) for c in P)


def centroid() -> dict:
    return {c: (F.col("a" + c) + F.col("b" + c) + F.col("c" + c)) / 3.0 for c in P}


def in_box():
    at = centroid()
    cond = F.lit(True)
    for c, a, b in zip(P, LOW, HIGH, strict=True):
        cond = cond & at[c].between(a, b)
    return cond


@query("d01_crop_box", f"WITH {TRI} SELECT tid, a, b, c FROM tri WHERE {_IN}")
def crop_box(spark: SparkSession, sf: str) -> DataFrame:
    return triangles(spark, sf).where(in_box()).select("tid", "a", "b", "c")


def compact(tri: DataFrame, mesh: str = "frame") -> DataFrame:
    """Triangles with corners renumbered, within each mesh, in the order of their first use."""
    uses = tri.select(mesh, "tid", F.posexplode(F.array("a", "b", "c")).alias("k", "v"))
    first = uses.groupBy(mesh, "v").agg(F.min(F.col("tid") * 3 + F.col("k")).alias("use"))
    number = first.withColumn("n", (F.row_number().over(Window.partitionBy(mesh).orderBy("use")) - 1).cast("long")).drop("use")
    new = uses.join(number, [mesh, "v"]).groupBy(mesh, "tid").agg(*(F.max(F.when(F.col("k") == i, F.col("n"))).alias(c) for i, c in enumerate("abc")))
    return new


_COMPACT = "u AS (SELECT frame, tid, 0 AS k, a AS v FROM {0} UNION ALL SELECT frame, tid, 1, b FROM {0} UNION ALL SELECT frame, tid, 2, c FROM {0}), fu AS (SELECT frame, v, min(tid*3+k) AS use FROM u GROUP BY ALL), nn AS (SELECT frame, v, row_number() OVER (PARTITION BY frame ORDER BY use) - 1 AS n FROM fu)"


@query("d02_filter_triangles", f"WITH {TRI}, kt AS (SELECT * FROM tri WHERE {_IN}), {_COMPACT.format('kt')} SELECT frame, tid, max(n) FILTER (k=0) AS a, max(n) FILTER (k=1) AS b, max(n) FILTER (k=2) AS c FROM u JOIN nn USING (frame, v) GROUP BY frame, tid")
def filter_triangles(spark: SparkSession, sf: str) -> DataFrame:
    return compact(triangles(spark, sf).where(in_box()))


@query("d03_filter_splats", f"WITH {PTS} SELECT vid, o FROM pts WHERE o >= 0.05")
def filter_splats(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).where(F.col("o") >= 0.05).select("vid", "o")


# Sample strokes (subtract, radius, point).
STROKES = [(False, 0.18, (0.05, 0.0, 0.05)), (False, 0.15, (-0.1, 0.1, 0.0)), (True, 0.08, (0.05, 0.05, 0.0))]
_BOXD = "greatest(" + ", ".join(f"{a} - {c}, {c} - {b}" for c, a, b in zip(P, LOW, HIGH, strict=True)) + ")"
_DIST = [f"sqrt((x-({p[0]}))*(x-({p[0]}))+(y-({p[1]}))*(y-({p[1]}))+(z-({p[2]}))*(z-({p[2]})))-{r}" for _, r, p in STROKES]
_BRUSH = f"greatest(least({_DIST[0]}, {_DIST[1]}), -({_DIST[2]}))"


def stroke_distance():
    """Signed distance to the strokes' union without the subtracted ones; the strokes are a configuration and fold into one expression."""
    d = [(sub, G.length((F.col("x") - x, F.col("y") - y, F.col("z") - z)) - radius) for sub, radius, (x, y, z) in STROKES]
    least = lambda cut: reduce(F.least, [v for sub, v in d if sub is cut])
    return F.greatest(least(False), -least(True))


@query("d04_signed_distance", f"WITH {PTS} SELECT vid, {r6(_BOXD)} AS box, {r6(_BRUSH)} AS brush FROM pts")
def signed_distance(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select("vid", *out(box=G.box_distance(xyz(), LOW, HIGH), brush=stroke_distance()))


@query("d06_region_union", f"WITH {PTS} SELECT vid, {r6(f'least({_BOXD}, {_BRUSH})')} AS d, least({_BOXD}, {_BRUSH}) < 0 AS inside FROM pts")
def region_union(spark: SparkSession, sf: str) -> DataFrame:
    d = F.least(G.box_distance(xyz(), LOW, HIGH), stroke_distance())
    return points(spark, sf).select("vid", *out(d=d), (d < 0).alias("inside"))


# Every fifth frame of a user's events is a keyframe.
_BRACKET = (
    f"WITH {SEQ}, kf AS (SELECT clip, frame, value FROM seq WHERE frame % 5 = 2), br AS (SELECT s.clip, s.frame, s.value,"
    " (SELECT max(k.frame) FROM kf k WHERE k.clip = s.clip AND k.frame <= s.frame) AS af, (SELECT min(k.frame) FROM kf k WHERE k.clip = s.clip AND k.frame > s.frame) AS bf FROM seq s),"
    " cl AS (SELECT clip, frame, coalesce(af, bf) AS af, coalesce(bf, af) AS bf FROM br),"
    " tt AS (SELECT c.clip, c.frame, c.af, c.bf, a.value AS av, b.value AS bv, CASE WHEN c.frame >= c.af AND c.bf <> c.af THEN (c.frame - c.af) / CAST(c.bf - c.af AS DOUBLE) ELSE 0.0 END AS t FROM cl c LEFT JOIN kf a ON a.clip = c.clip AND a.frame = c.af LEFT JOIN kf b ON b.clip = c.clip AND b.frame = c.bf)"
)


def bracketed(spark: SparkSession, sf: str) -> DataFrame:
    s = sequences(spark, sf)
    kf = s.where(F.col("frame") % 5 == 2).select("clip", "frame", "value")
    return bracket(s.select("clip", "frame"), kf, ["clip"], "frame", ["value"])


@query("d07_bracket_keyframes", _BRACKET + f" SELECT clip, frame, af AS a_frame, bf AS b_frame, {r6('t')} AS t FROM tt")
def bracket_keyframes(spark: SparkSession, sf: str) -> DataFrame:
    return bracketed(spark, sf).select("clip", "frame", "a_frame", "b_frame", *out(t=F.col("t")))


@query("d08_interpolate_region", _BRACKET + f" SELECT clip, frame, {r6('(1-t)*av+t*bv', 4)} AS linear, {r6('av', 4)} AS held, {r6('(1-t*t*(3-2*t))*av+t*t*(3-2*t)*bv', 4)} AS smooth, (1-t)*av+t*bv < 50 AS inside FROM tt")
def interpolate_region(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("t")
    s = t * t * (3.0 - 2.0 * t)
    mixed = lambda w: (1.0 - w) * F.col("a_value") + w * F.col("b_value")
    return bracketed(spark, sf).select(
        "clip", "frame", rounded(mixed(t), 4).alias("linear"), rounded(F.col("a_value"), 4).alias("held"), rounded(mixed(s), 4).alias("smooth"), (mixed(t) < 50).alias("inside")
    )


_TB = "greatest(" + ", ".join(f"{a} - {_C[c]}, {_C[c]} - {b}" for c, a, b in zip(P, LOW, HIGH, strict=True)) + ")"
# Ranges: delete the box's inside in frames 0-4, keep only z > -0.1 in frames 3-6, a muted and a copy range that don't count.
_DEL, _KEEP = f"(frame <= 4 AND {_TB} < 0)", f"(frame < 3 OR frame > 6 OR {_C['z']} > -0.1)"


def keep_condition():
    at = centroid()
    inside = G.box_distance(tuple(at[c] for c in P), LOW, HIGH) < 0
    ranges = [("delete", True, "delete", 0, 4, inside), ("keep", True, "delete", 3, 6, at["z"] > -0.1), ("delete", False, "delete", 0, 9, F.lit(True)), ("delete", True, "copy", 0, 9, F.lit(True))]
    live = [(mode, F.col("frame").between(a, b), hit) for mode, enabled, action, a, b, hit in ranges if enabled and action == "delete"]
    drop = any_of(active & hit for mode, active, hit in live if mode == "delete")
    kept = any_of(active & hit for mode, active, hit in live if mode == "keep")
    cropped = any_of(active for mode, active, _ in live if mode == "keep")
    return ~drop & (~cropped | kept)


def any_of(conditions):
    got = F.lit(False)
    for c in conditions:
        got = got | c
    return got


@query("d09_keep_predicate", f"WITH {TRI}, kt AS (SELECT * FROM tri WHERE NOT {_DEL} AND {_KEEP}), {_COMPACT.format('kt')} SELECT frame, tid, max(n) FILTER (k=0) AS a, max(n) FILTER (k=1) AS b, max(n) FILTER (k=2) AS c FROM u JOIN nn USING (frame, v) GROUP BY frame, tid")
def keep_predicate(spark: SparkSession, sf: str) -> DataFrame:
    return compact(triangles(spark, sf).where(keep_condition()))


@query("d10_filter_preview", f"WITH {TRI} SELECT tid, a, b, c FROM tri WHERE NOT {_DEL} AND {_KEEP}")
def filter_preview(spark: SparkSession, sf: str) -> DataFrame:
    return triangles(spark, sf).where(keep_condition()).select("tid", "a", "b", "c")


@query("d11_partition_triangles", f"WITH {TRI} SELECT frame, {_IN} AS selected, count(*) AS triangles, min(tid) AS first FROM tri GROUP BY ALL")
def partition_triangles(spark: SparkSession, sf: str) -> DataFrame:
    return triangles(spark, sf).withColumn("selected", in_box()).groupBy("frame", "selected").agg(F.count("*").alias("triangles"), F.min("tid").alias("first"))


@query("d12_trim_window", f"WITH {SEQ} SELECT clip, frame - 3 AS frame, event_id FROM seq WHERE frame BETWEEN 3 AND 12")
def trim_window(spark: SparkSession, sf: str) -> DataFrame:
    return sequences(spark, sf).where(F.col("frame").between(3, 12)).select("clip", (F.col("frame") - 3).alias("frame"), "event_id")


# A user's events are an edit range; even event ids are derived keyframes.
@query("d13_rebase_edit_list", f"WITH {SEQ}, rg AS (SELECT clip, min(frame) AS s, max(frame) AS e FROM seq GROUP BY clip), kf AS (SELECT clip, frame, event_id % 2 = 0 AS derived FROM seq), kk AS (SELECT clip, frame - 4 AS frame, derived FROM kf WHERE NOT derived OR frame BETWEEN 4 AND 20) SELECT clip, greatest(s - 4, 0) AS start_frame, least(e - 4, 16) AS end_frame, count(*) AS keyframes, min(k.frame) AS first_keyframe FROM rg JOIN kk k USING (clip) WHERE e >= 4 AND s <= 20 GROUP BY clip, s, e")
def rebase_edit_list(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges clamped to frames 4-20 and counted from there; user keyframes stay outside too, derived ones don't."""
    low, high = 4, 20
    s = sequences(spark, sf)
    ranges = s.groupBy("clip").agg(F.min("frame").alias("s"), F.max("frame").alias("e")).where((F.col("e") >= low) & (F.col("s") <= high))
    kf = s.withColumn("derived", F.col("event_id") % 2 == 0).where(~F.col("derived") | F.col("frame").between(low, high)).select("clip", (F.col("frame") - low).alias("kf"))
    return ranges.join(kf, "clip").groupBy("clip", F.greatest(F.col("s") - low, F.lit(0)).alias("start_frame"), F.least(F.col("e") - low, F.lit(high - low)).alias("end_frame")).agg(F.count("*").alias("keyframes"), F.min("kf").alias("first_keyframe"))


@query("d14_range_enabled", "SELECT event_id, coalesce(CASE WHEN event_type = 'click' THEN NULL ELSE event_id % 3 = 0 END, true) AS enabled FROM events")
def range_enabled(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.when(F.col("event_type") != "click", F.col("event_id") % 3 == 0)
    return table(spark, sf, "events").select("event_id", F.coalesce(flag, F.lit(True)).alias("enabled"))


# The points as a lattice of 20 columns; depth from the third component.
_LAT = f"{PTS}, lat AS (SELECT CAST(floor(vid / 20) AS BIGINT) AS gy, vid % 20 AS gx, 2.0 + z AS d FROM pts)"


def lattice(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select(F.floor(F.col("vid") / 20).alias("gy"), (F.col("vid") % 20).alias("gx"), (2.0 + F.col("z")).alias("d"))


_RATIO = lambda a, b: f"abs({a}-{b})/least({a},{b})"


@query("d15_silhouette_cull", f"WITH {_LAT} SELECT p.gy, p.gx, {_RATIO('p.d', 'q.d')} <= 0.06 AND {_RATIO('p.d', 'r.d')} <= 0.06 AND {_RATIO('q.d', 'r.d')} <= 0.06 AS kept FROM lat p JOIN lat q ON q.gy = p.gy AND q.gx = p.gx + 1 JOIN lat r ON r.gy = p.gy + 1 AND r.gx = p.gx")
def silhouette_cull(spark: SparkSession, sf: str) -> DataFrame:
    p = lattice(spark, sf)
    right, below = p.select("gy", (F.col("gx") - 1).alias("gx"), F.col("d").alias("dr")), p.select((F.col("gy") - 1).alias("gy"), "gx", F.col("d").alias("db"))
    steep = lambda a, b: F.abs(F.col(a) - F.col(b)) / F.least(a, b) <= 0.06
    return p.join(right, ["gy", "gx"]).join(below, ["gy", "gx"]).select("gy", "gx", (steep("d", "dr") & steep("d", "db") & steep("dr", "db")).alias("kept"))


@query("d16_relief_discard", f"WITH {_LAT} SELECT gy, gx, {r6('0.05 / sqrt(0.05*0.05 + (d-2)*(d-2))')} AS slope, d > 2.1 AS discarded FROM lat")
def relief_discard(spark: SparkSession, sf: str) -> DataFrame:
    edge = F.col("d") - 2.0
    return lattice(spark, sf).select("gy", "gx", *out(slope=0.05 / F.sqrt(0.05 * 0.05 + edge * edge)), (F.col("d") > 2.1).alias("discarded"))


@query("d17_texel_collateral", f"WITH {TRI} SELECT frame AS patch, count(*) AS triangles, {r6(f'sum(CASE WHEN NOT ({_IN}) THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE)')} AS outside, sum(CASE WHEN NOT ({_IN}) THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) > 0.05 AS refused FROM tri GROUP BY frame")
def texel_collateral(spark: SparkSession, sf: str) -> DataFrame:
    share = F.count_if(~in_box()) / F.count("*").cast("double")
    return triangles(spark, sf).groupBy(F.col("frame").alias("patch")).agg(F.count("*").alias("triangles"), rounded(share).alias("outside"), (share > 0.05).alias("refused"))


@query("d18_history_filter", "SELECT page_id, url FROM pages WHERE page_id % 3 IN (0, 1) AND (contains(lower(url), '/en/') OR contains(lower(url), 'feed')) ORDER BY page_id DESC LIMIT 40")
def history_filter(spark: SparkSession, sf: str) -> DataFrame:
    url = F.lower("url")
    return table(spark, sf, "pages").where((F.col("page_id") % 3).isin(0, 1) & (url.contains("/en/") | url.contains("feed"))).orderBy(F.desc("page_id")).limit(40).select("page_id", "url")


@query("d19_preflight_rules", "SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN 'no price' WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'finished and large' WHEN o_orderpriority LIKE '1%' THEN 'urgent' WHEN o_orderdate < TIMESTAMP '1994-01-01' THEN 'old' ELSE 'ok' END AS verdict FROM orders")
def preflight_rules(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    verdict = F.when(c("o_totalprice").isNull(), "no price").when((c("o_orderstatus") == "F") & (c("o_totalprice") > 100000), "finished and large").when(c("o_orderpriority").startswith("1"), "urgent").when(c("o_orderdate") < F.lit("1994-01-01").cast("timestamp"), "old").otherwise("ok")
    return table(spark, sf, "orders").select("o_orderkey", verdict.alias("verdict"))


# A sample lasso.
LASSO = [(-0.2, -0.1), (0.1, -0.2), (0.2, 0.1), (0.0, 0.0), (-0.1, 0.2)]
_EDGES = "lasso(i, ax, ay, bx, b_y) AS (VALUES " + ", ".join(f"({i}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for i, (a, b) in enumerate(zip(LASSO, LASSO[1:] + LASSO[:1], strict=True))) + ")"


@query("d20_lasso", f"WITH {PTS}, {_EDGES} SELECT vid, sum(CASE WHEN (ay > y) <> (b_y > y) AND x < (bx-ax)*(y-ay)/(b_y-ay)+ax THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM pts, lasso GROUP BY vid")
def lasso(spark: SparkSession, sf: str) -> DataFrame:
    """Even-odd rule over the polygon's edges, a configuration that folds into one expression."""
    x, y, inside = F.col("x"), F.col("y"), F.lit(False)
    for (ax, ay), (bx, by) in zip(LASSO, LASSO[1:] + LASSO[:1], strict=True):
        if ay != by:
            inside = inside != (((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax))
    return points(spark, sf).select("vid", inside.alias("inside"))


# Groups of four frames index a user's events.
_GOPS = f"{SEQ}, gop AS (SELECT clip, CAST(floor(frame / 4) AS BIGINT) AS gop, min(frame) AS start, count(*) AS n, min(ts) AS at FROM seq GROUP BY ALL)"


def gops(spark: SparkSession, sf: str) -> DataFrame:
    return sequences(spark, sf).groupBy("clip", F.floor(F.col("frame") / 4).alias("gop")).agg(F.min("frame").alias("start"), F.count("*").alias("n"), F.min("ts").alias("at"))


@query("e01_seek_group", f"WITH {_GOPS}, pr AS (SELECT l_orderkey * 10 + l_linenumber AS probe, l_orderkey % 150 AS clip, l_orderkey % 80 AS pts FROM lineitem), st AS (SELECT clip, gop, start * 3 AS pts FROM gop) SELECT probe, p.clip, coalesce((SELECT max(s.gop) FROM st s WHERE s.clip = p.clip AND s.pts <= p.pts), (SELECT min(s.gop) FROM st s WHERE s.clip = p.clip)) AS gop FROM pr p")
def seek_group(spark: SparkSession, sf: str) -> DataFrame:
    """The last group that starts at or before a time, before the first the first."""
    probes = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("probe"), (F.col("l_orderkey") % 150).alias("clip"), (F.col("l_orderkey") % 80).alias("pts"))
    starts = gops(spark, sf).select("clip", "gop", (F.col("start") * 3).alias("pts"))
    first = starts.groupBy("clip").agg(F.min("gop").alias("first"))
    return asof(probes, starts, ["clip"], "pts", ["gop"]).join(first, "clip", "left").select("probe", "clip", F.coalesce("gop", "first").alias("gop"))


@query("e02_locate_frame", f"WITH {_GOPS} SELECT s.clip, s.frame, g.gop, g.start, (SELECT max(i.frame) FROM seq i WHERE i.clip = s.clip AND i.frame <= s.frame AND i.frame >= g.start AND (i.frame = g.start OR i.event_type = 'click')) AS key_frame FROM seq s JOIN gop g ON g.clip = s.clip AND s.frame >= g.start AND s.frame < g.start + g.n")
def locate_frame(spark: SparkSession, sf: str) -> DataFrame:
    """The group that covers a frame and the last intra frame in it up to there."""
    covering = interval_join(sequences(spark, sf), gops(spark, sf).select("clip", "gop", "start", (F.col("start") + F.col("n")).alias("end")), ["clip"], "frame", "start", "end", 4.0)
    line = Window.partitionBy("clip", "gop").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    key = F.when((F.col("frame") == F.col("start")) | (F.col("event_type") == "click"), F.col("frame"))
    return covering.select("clip", "frame", "gop", "start", F.last(key, ignorenulls=True).over(line).alias("key_frame"))


@query("e03_packets_in_window", "WITH w AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS start FROM orders), b AS (SELECT start, lag(start) OVER (ORDER BY start) IS NULL AS first, lead(start) OVER (ORDER BY start) AS nxt FROM w) SELECT b.start, count(*) AS packets, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem l JOIN b ON (b.first OR l_shipdate >= b.start) AND (b.nxt IS NULL OR l_shipdate < b.nxt) GROUP BY b.start")
def packets_in_window(spark: SparkSession, sf: str) -> DataFrame:
    """Packets by window; the first is open below, the last above: an as-of join that falls back to the first."""
    start = F.date_trunc("month", "o_orderdate")
    windows = table(spark, sf, "orders").select(start.alias("at")).distinct().withColumn("start", F.col("at")).withColumn("k", F.lit(1))
    packets = table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("at"), "l_quantity")
    # Windows are as many as months, so each packet's month finds its window through a lookup of distinct months.
    months = packets.select(F.date_trunc("month", "at").alias("at")).distinct().withColumn("k", F.lit(1))
    first = windows.agg(F.min("start").alias("first"))
    found = asof(months, windows, ["k"], "at", ["start"]).crossJoin(F.broadcast(first)).select(F.col("at").alias("month"), F.coalesce("start", "first").alias("start"))
    return packets.withColumn("month", F.date_trunc("month", "at")).join(found, "month").groupBy("start").agg(F.count("*").alias("packets"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("e04_texture_align", f"WITH {SEQ} SELECT s.clip, s.frame, s.event_id, c.turn IS NOT NULL AS textured FROM seq s LEFT JOIN (SELECT DISTINCT conv_id, turn FROM conversations) c ON c.conv_id = s.clip AND c.turn = s.frame")
def texture_align(spark: SparkSession, sf: str) -> DataFrame:
    """Texture frames join on the frame number, never on their position in a group."""
    textures = table(spark, sf, "conversations").select(F.col("conv_id").alias("clip"), F.col("turn").alias("frame")).distinct().withColumn("hit", F.lit(True))
    return sequences(spark, sf).join(textures, ["clip", "frame"], "left").select("clip", "frame", "event_id", F.col("hit").isNotNull().alias("textured"))


@query("e05_audio_start", f"WITH {SEQ}, pk AS (SELECT clip, frame AS packet, frame * 20000 AS pts FROM seq WHERE frame % 2 = 0) SELECT s.clip, s.frame, (SELECT max(p.packet) FROM pk p WHERE p.clip = s.clip AND p.pts <= s.frame * 19000) AS packet FROM seq s")
def audio_start(spark: SparkSession, sf: str) -> DataFrame:
    s = sequences(spark, sf)
    packets = s.where(F.col("frame") % 2 == 0).select("clip", F.col("frame").alias("packet"), (F.col("frame") * 20000).alias("pts"))
    return asof(s.select("clip", "frame", (F.col("frame") * 19000).alias("pts")), packets, ["clip"], "pts", ["packet"]).select("clip", "frame", "packet")


@query("e06_match_by_index", f"WITH {PTS}, k AS (SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY vid) - 1 AS sid, x, y, z FROM pts), n AS (SELECT frame, count(*) AS n FROM k GROUP BY frame) SELECT c.frame, count(*) AS pairs, any_value(a.n) = any_value(b.n) AS same_count, {r6('avg(CASE WHEN sqrt((c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y)+(c.z-p.z)*(c.z-p.z)) <= 0.2 THEN 1.0 ELSE 0.0 END)')} AS near FROM k c JOIN k p ON p.frame = c.frame - 1 AND p.sid = c.sid JOIN n a ON a.frame = c.frame JOIN n b ON b.frame = c.frame - 1 GROUP BY c.frame")
def match_by_index(spark: SparkSession, sf: str) -> DataFrame:
    """Splats of equal place in neighbouring frames, and how many moved by at most 0.2."""
    place = Window.partitionBy("frame").orderBy("vid")
    k = points(spark, sf).select("frame", (F.row_number().over(place) - 1).alias("sid"), *P, F.count("*").over(Window.partitionBy("frame")).alias("n"))
    prior = k.select((F.col("frame") + 1).alias("frame"), "sid", *(F.col(c).alias("p" + c) for c in P), F.col("n").alias("pn"))
    d = G.length(tuple(F.col(c) - F.col("p" + c) for c in P))
    return k.join(prior, ["frame", "sid"]).groupBy("frame").agg(F.count("*").alias("pairs"), (F.max("n") == F.max("pn")).alias("same_count"), rounded(F.avg(F.when(d <= 0.2, 1.0).otherwise(0.0))).alias("near"))


_CELL = "CAST(floor(x*8) AS BIGINT) AS cx, CAST(floor(y*8) AS BIGINT) AS cy, CAST(floor(z*8) AS BIGINT) AS cz"


@query("e09_births_and_deaths", f"WITH {PTS}, c AS (SELECT DISTINCT frame, {_CELL} FROM pts), s AS (SELECT frame + 1 AS frame, cx, cy, cz FROM c WHERE frame < (SELECT max(frame) FROM c)) SELECT coalesce(c.frame, s.frame) AS frame, count(*) FILTER (c.frame IS NOT NULL AND s.frame IS NOT NULL) AS survivors, count(*) FILTER (s.frame IS NULL) AS births, count(*) FILTER (c.frame IS NULL) AS deaths FROM c FULL JOIN s ON s.frame = c.frame AND s.cx = c.cx AND s.cy = c.cy AND s.cz = c.cz GROUP BY 1")
def births_and_deaths(spark: SparkSession, sf: str) -> DataFrame:
    """Occupied cells of a frame against those of the frame before."""
    cells = points(spark, sf).select("frame", *(F.floor(F.col(c) * 8).alias("c" + c) for c in P)).distinct()
    last = cells.agg(F.max("frame").alias("last"))
    prior = cells.crossJoin(F.broadcast(last)).where("frame < last").select((F.col("frame") + 1).alias("frame"), "cx", "cy", "cz", F.lit(1).alias("was"))
    both = cells.withColumn("now", F.lit(1)).join(prior, ["frame", "cx", "cy", "cz"], "full")
    count = lambda c, n: F.count_if(c).alias(n)
    now, was = F.col("now").isNotNull(), F.col("was").isNotNull()
    return both.groupBy("frame").agg(count(now & was, "survivors"), count(~was, "births"), count(~now, "deaths"))


@query("e11_weld_by_position", f"WITH {PTS}, c AS (SELECT vid, {_CELL} FROM pts) SELECT vid, min(vid) OVER (PARTITION BY cx, cy, cz) AS canon FROM c")
def weld_by_position(spark: SparkSession, sf: str) -> DataFrame:
    """Vertices of one position take the smallest id among them; cells stand for bit patterns here."""
    cells = points(spark, sf).select("vid", *(F.floor(F.col(c) * 8).cast("string").alias("c" + c) for c in P))
    return cells.select("vid", F.min("vid").over(Window.partitionBy("cx", "cy", "cz")).alias("canon"))


@query("e12_seam_weld_groups", f"WITH {PTS}, c AS (SELECT vid, frame, x, {_CELL} FROM pts), g AS (SELECT cx, cy, cz, count(*) AS n, avg(x) AS mx FROM c GROUP BY ALL HAVING count(*) >= 2) SELECT c.vid, g.n, {r6('g.mx')} AS welded_x FROM c JOIN g USING (cx, cy, cz)")
def seam_weld_groups(spark: SparkSession, sf: str) -> DataFrame:
    cells = points(spark, sf).select("vid", "x", *(F.floor(F.col(c) * 8).alias("c" + c) for c in P))
    groups = cells.groupBy("cx", "cy", "cz").agg(F.count("*").alias("n"), F.avg("x").alias("mx")).where("n >= 2")
    return cells.join(groups, ["cx", "cy", "cz"]).select("vid", "n", rounded(F.col("mx")).alias("welded_x"))


@query("e13_triangle_gather", f"WITH {TRI} SELECT tid, {', '.join(r6(_C[c]) + f' AS m{c}' for c in P)} FROM tri")
def triangle_gather(spark: SparkSession, sf: str) -> DataFrame:
    return triangles(spark, sf).select("tid", *out(**{"m" + c: v for c, v in centroid().items()}))


@query("e14_tile_pool", f"WITH {_LAT}, t AS (SELECT CAST(floor(gy/4) AS BIGINT) AS ty, CAST(floor(gx/4) AS BIGINT) AS tx, d FROM lat), k AS (SELECT DISTINCT ty, tx FROM t) SELECT k.ty, k.tx, count(*) AS n, {r6('avg(t.d)')} AS mean FROM k JOIN t ON abs(t.ty-k.ty) <= 1 AND abs(t.tx-k.tx) <= 1 GROUP BY ALL")
def tile_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of each tile's 3 x 3 neighbourhood: a sample is dealt to the nine tiles around it."""
    t = lattice(spark, sf).select(F.floor(F.col("gy") / 4).alias("ty"), F.floor(F.col("gx") / 4).alias("tx"), "d")
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    dealt = t.withColumn("o", F.explode(around)).select((F.col("ty") + F.col("o.i")).alias("ty"), (F.col("tx") + F.col("o.j")).alias("tx"), "d")
    return dealt.join(t.select("ty", "tx").distinct(), ["ty", "tx"]).groupBy("ty", "tx").agg(F.count("*").alias("n"), rounded(F.avg("d")).alias("mean"))


@query("e15_backfill_nearest", f"WITH {SEQ}, v AS (SELECT clip, frame, value FROM seq WHERE event_type IN ('click', 'view')), c AS (SELECT s.clip, s.frame, v.value, row_number() OVER (PARTITION BY s.clip, s.frame ORDER BY abs(v.frame - s.frame), v.frame) AS k FROM seq s LEFT JOIN v ON v.clip = s.clip) SELECT clip, frame, value AS filled FROM c WHERE k = 1")
def backfill_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_valid(sequences(spark, sf), ["clip"], "frame", F.col("event_type").isin("click", "view"), "value").select("clip", "frame", "filled")


@query("e16_flow_lookup", f"WITH {PTS}, a AS (SELECT vid, x, y, z, s0 FROM pts), f AS (SELECT p.vid, count(*) AS n, avg(q.s0) AS m, max(abs(q.s0)) AS spread FROM a p JOIN a q ON sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)) <= 0.1 GROUP BY p.vid) SELECT vid, n, {r6('m')} AS flow FROM f WHERE n >= 3 AND spread <= 0.3")
def flow_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Mean displacement of the samples within a radius, where they are enough and alike; cells of that size find them."""
    radius = 0.1
    p = points(spark, sf).select("vid", *P, "s0", *(F.floor(F.col(c) / radius).alias("c" + c) for c in P))
    around = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(o, "ijk", strict=True))) for o in [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))
    dealt = p.withColumn("o", F.explode(around)).select(*((F.col("c" + c) + F.col("o." + n)).alias("c" + c) for c, n in zip(P, "ijk", strict=True)), *(F.col(c).alias("q" + c) for c in P), F.col("s0").alias("d"))
    near = p.join(dealt, ["cx", "cy", "cz"]).where(G.length(tuple(F.col(c) - F.col("q" + c) for c in P)) <= radius)
    return near.groupBy("vid").agg(F.count("*").alias("n"), F.avg("d").alias("m"), F.max(F.abs("d")).alias("spread")).where("n >= 3 and spread <= 0.3").select("vid", "n", rounded(F.col("m")).alias("flow"))


@query("i07_coalesce_gaps", "WITH f AS (SELECT DISTINCT user_id AS clip, event_id AS frame FROM events), g AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY clip ORDER BY frame) <= 200 THEN 0 ELSE 1 END AS n FROM f), h AS (SELECT *, sum(n) OVER (PARTITION BY clip ORDER BY frame) AS i FROM g) SELECT clip, min(frame) AS first, max(frame) AS last, count(*) AS frames FROM h GROUP BY clip, i")
def ranges_of_frames(spark: SparkSession, sf: str) -> DataFrame:
    return coalesce_gaps(table(spark, sf, "events").select(F.col("user_id").alias("clip"), F.col("event_id").alias("frame")), ["clip"], "frame", 200)
