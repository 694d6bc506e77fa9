"""Window analytics, orderings, set operations, documents and masks over events and tables."""

from __future__ import annotations

from math import exp

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.encodings import rounded
from ..operators import windows as W
from ..operators.islands import frame_groups, island, run_bits, run_lengths
from ..session import table
from .aggregates import _RUNS
from .common import PTS, SEQ, TRI, out, points, query, r6, sequences, triangles
from .regions import _BRACKET, _CELL, _COMPACT, _IN, _LAT, bracketed, compact, in_box, lattice
from .scalars import MORTON_CTE, P, morton_keys

_OVER = "OVER (PARTITION BY clip ORDER BY frame)"
V = "value"


def by_clip():
    return W.line(["clip"], ["frame"])


_G1 = (
    f"WITH {SEQ}, c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) {_OVER} THEN 1 ELSE 0 END AS n FROM seq), r AS (SELECT *, sum(n) {_OVER} AS run FROM c),"
    " b AS (SELECT clip, run, frame, (row_number() OVER (PARTITION BY clip, run ORDER BY frame) - 1) // 5 AS blk FROM r), s AS (SELECT clip, run, blk, min(frame) AS first, count(*) AS n FROM b GROUP BY ALL),"
    " f AS (SELECT *, n = 1 AS single, CASE WHEN n <> 1 OR lag(n) OVER (PARTITION BY clip ORDER BY first) IS NULL OR (lag(n) OVER (PARTITION BY clip ORDER BY first) = 1) <> (n = 1) THEN 1 ELSE 0 END AS m FROM s),"
    " h AS (SELECT *, sum(m) OVER (PARTITION BY clip ORDER BY first) AS batch FROM f), k AS (SELECT *, CASE WHEN single THEN (row_number() OVER (PARTITION BY clip, batch ORDER BY first) - 1) // 5 ELSE 0 END AS part FROM h),"
    " g AS (SELECT clip, batch, part, min(first) AS frame_start, CAST(sum(n) AS BIGINT) AS frame_count, bool_and(single) AS intra FROM k GROUP BY ALL)"
    " SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY frame_start) - 1 AS gop, frame_start, frame_count, intra FROM g"
)


@query("g01_frame_groups", _G1)
def groups(spark: SparkSession, sf: str) -> DataFrame:
    return frame_groups(sequences(spark, sf), "clip", "frame", "event_type", 5)


@query("g02_repack_flags", f"WITH {SEQ} SELECT clip, frame, event_type IS DISTINCT FROM lag(event_type) {_OVER} AS repacked FROM seq")
def repack_flags(spark: SparkSession, sf: str) -> DataFrame:
    prior = F.lag("event_type").over(by_clip())
    return sequences(spark, sf).select("clip", "frame", (~F.col("event_type").eqNullSafe(prior)).alias("repacked"))


@query("g03_repack_by_image", "WITH e AS (SELECT vec_id, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings), d AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: abs(CAST(e[i] AS DOUBLE) - CAST(p[i] AS DOUBLE)))) / 64 AS d FROM e WHERE p IS NOT NULL) SELECT vec_id, " + r6("d", 5) + " AS mean_delta, d > 0.14 AS repacked FROM d")
def repack_by_image(spark: SparkSession, sf: str) -> DataFrame:
    """Mean absolute difference of a frame's picture from the one before; vectors stand for pictures."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), F.lag(F.col("embedding").cast("array<double>")).over(Window.partitionBy("label").orderBy("vec_id")).alias("p")).where("p is not null")
    d = F.aggregate(F.zip_with("e", "p", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / 64.0
    return e.select("vec_id", rounded(d, 5).alias("mean_delta"), (d > 0.14).alias("repacked"))


@query("g04_box_smooth", f"WITH {SEQ} SELECT clip, frame, {r6('avg(value) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)', 4)} AS v FROM seq")
def box_smooth(spark: SparkSession, sf: str) -> DataFrame:
    return sequences(spark, sf).select("clip", "frame", rounded(F.avg(V).over(by_clip().rowsBetween(-2, 2)), 4).alias("v"))


_L = lambda k: f"lag(value, {k}) {_OVER}"
_F = lambda k: f"lead(value, {k}) {_OVER}"
_B1, _A1 = f"coalesce({_L(1)}, value)", f"coalesce({_F(1)}, value)"


@query("g05_temporal_median", f"WITH {SEQ}, n AS (SELECT clip, frame, value, {_B1} AS b1, {_A1} AS a1, coalesce({_L(2)}, {_B1}) AS b2, coalesce({_F(2)}, {_A1}) AS a2 FROM seq) SELECT clip, frame, list_sort([b1, value, a1])[2] AS m3, list_sort([b2, b1, value, a1, a2])[3] AS m5 FROM n")
def temporal_median(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col(V)
    return sequences(spark, sf).select("clip", "frame", W.temporal_median(v, 1, by_clip()).alias("m3"), W.temporal_median(v, 2, by_clip()).alias("m5"))


_Z = "CASE WHEN event_type = 'error' THEN 0 ELSE value END"


@query("g06_median_missing", f"WITH {SEQ}, z AS (SELECT clip, frame, {_Z} AS v FROM seq), n AS (SELECT clip, frame, v, lag(v) {_OVER} AS p, lead(v) {_OVER} AS q FROM z) SELECT clip, frame, CASE WHEN v <> 0 AND coalesce(p, 0) <> 0 AND coalesce(q, 0) <> 0 THEN list_sort([p, v, q])[2] ELSE v END AS v FROM n")
def median_missing(spark: SparkSession, sf: str) -> DataFrame:
    """The median of three only where none is missing; zero means missing."""
    z = sequences(spark, sf).withColumn("v", F.when(F.col("event_type") == "error", 0.0).otherwise(F.col(V)))
    p, q = (F.coalesce(f("v").over(by_clip()), F.lit(0.0)) for f in (F.lag, F.lead))
    return z.select("clip", "frame", F.when((F.col("v") != 0) & (p != 0) & (q != 0), F.element_at(F.array_sort(F.array(p, F.col("v"), q)), 2)).otherwise(F.col("v")).alias("v"))


def _gauss(x: str, reach: int, sigma: float) -> str:
    ks = [(k, exp(-k * k / (2 * sigma * sigma))) for k in range(-reach, reach + 1)]
    at = lambda k: x if k == 0 else f"{'lag' if k < 0 else 'lead'}({x}, {abs(k)}) {_OVER}"
    return "(" + " + ".join(f"coalesce({at(k)}, 0) * {g!r}" for k, g in ks) + ") / (" + " + ".join(f"CASE WHEN {at(k)} IS NULL THEN 0 ELSE {g!r} END" for k, g in ks) + ")"


@query("g08_gaussian_window", f"WITH {SEQ} SELECT clip, frame, {r6(_gauss(V, 3, 1.5), 4)} AS v FROM seq")
def gaussian_window(spark: SparkSession, sf: str) -> DataFrame:
    return sequences(spark, sf).select("clip", "frame", rounded(W.gaussian(F.col(V), 3, 1.5, by_clip()), 4).alias("v"))


@query("g20_track_smooth", f"WITH {SEQ} SELECT clip, frame, {r6(_gauss(V, 2, 1.0), 4)} AS v FROM seq")
def track_smooth(spark: SparkSession, sf: str) -> DataFrame:
    return sequences(spark, sf).select("clip", "frame", rounded(W.gaussian(F.col(V), 2, 1.0, by_clip()), 4).alias("v"))


_S7 = (
    f"WITH {SEQ}, k AS (SELECT clip, frame, CASE WHEN event_type <> 'error' THEN value END AS v FROM seq),"
    " m AS (SELECT clip, frame, CASE WHEN v IS NOT NULL THEN median(v) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END AS v FROM k),"
    " p AS (SELECT clip, frame, v, last_value(CASE WHEN v IS NOT NULL THEN frame END IGNORE NULLS) OVER w AS f0, last_value(v IGNORE NULLS) OVER w AS v0, first_value(CASE WHEN v IS NOT NULL THEN frame END IGNORE NULLS) OVER u AS f1, first_value(v IGNORE NULLS) OVER u AS v1 FROM m"
    " WINDOW w AS (PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), u AS (PARTITION BY clip ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),"
    " g AS (SELECT clip, frame, CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (frame - f0) / CAST(f1 - f0 AS DOUBLE) END AS v FROM p)"
)


@query("g07_smooth_series", _S7 + f" SELECT clip, frame, {r6(_gauss('v', 2, 1.0), 4)} AS v FROM g")
def smooth_series(spark: SparkSession, sf: str) -> DataFrame:
    """Median of the valid values within two rows, gaps filled on a line between valid neighbours, then a Gaussian."""
    k = sequences(spark, sf).withColumn("v", F.when(F.col("event_type") != "error", F.col(V)))
    near = F.sort_array(F.collect_list("v").over(by_clip().rowsBetween(-2, 2)))
    half = F.floor(F.size(near) / 2)
    at = lambda i: F.element_at(near, i.cast("int"))
    m = k.withColumn("v", F.when(F.col("v").isNotNull(), F.when(F.size(near) % 2 == 1, at(half + 1)).otherwise((at(half) + at(F.greatest(half + 1, F.lit(1)))) / 2)))
    held = F.when(F.col("v").isNotNull(), F.struct("frame", "v"))
    p = m.withColumn("a", F.last(held, ignorenulls=True).over(by_clip().rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.first(held, ignorenulls=True).over(by_clip().rowsBetween(0, Window.unboundedFollowing)))
    on_line = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("frame") - F.col("a.frame")) / (F.col("b.frame") - F.col("a.frame")).cast("double")
    filled = F.when(F.col("v").isNotNull(), F.col("v")).when(F.col("a").isNull(), F.col("b.v")).when(F.col("b").isNull(), F.col("a.v")).otherwise(on_line)
    g = p.select("clip", "frame", filled.alias("v"))
    return g.select("clip", "frame", rounded(W.gaussian(F.col("v"), 2, 1.0, by_clip()), 4).alias("v"))


@query("g12_motion_gate", "WITH e AS (SELECT vec_id, label, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings) SELECT vec_id, CAST(coalesce(floor(list_sum(list_transform(range(1, 4), lambda i: floor(abs(CAST(e[i] AS DOUBLE) - CAST(p[i] AS DOUBLE)) * 255))) / 3), 255) AS BIGINT) AS gate FROM e")
def motion_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Mean integer difference of three channels from the frame before; the first frame counts as all moved."""
    p = points(spark, sf)
    prior = Window.partitionBy("frame").orderBy("vid")
    d = sum((F.floor(F.abs(F.col(c) - F.lag(c).over(prior)) * 255) for c in "yz"), F.floor(F.abs(F.col("x") - F.lag("x").over(prior)) * 255))
    return p.select(F.col("vid").alias("vec_id"), F.coalesce(F.floor(d / 3), F.lit(255)).alias("gate"))


@query("g14_step_median", f"WITH {SEQ}, d AS (SELECT clip, abs(value - lag(value) {_OVER}) AS d FROM seq) SELECT clip, {r6('median(d)', 4)} AS step FROM d GROUP BY clip HAVING count(d) > 0")
def step_median(spark: SparkSession, sf: str) -> DataFrame:
    d = sequences(spark, sf).select("clip", F.abs(F.col(V) - F.lag(V).over(by_clip())).alias("d"))
    return d.where("d is not null").groupBy("clip").agg(rounded(F.median("d"), 4).alias("step"))


@query("g15_spread_frames", f"WITH {SEQ}, n AS (SELECT clip, count(*) AS n FROM seq GROUP BY clip) SELECT clip, k, CAST(floor(k * (n - 1) / 4.0 + 0.5) AS BIGINT) AS frame FROM n, range(5) r(k)")
def spread_frames(spark: SparkSession, sf: str) -> DataFrame:
    n = sequences(spark, sf).groupBy("clip").agg(F.count("*").alias("n"))
    return n.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))).select("clip", "k", F.floor(F.col("k") * (F.col("n") - 1) / 4.0 + 0.5).alias("frame"))


_Q = "CAST(floor(value * 100) AS BIGINT) % 65536"
_D16 = f"WITH {SEQ}, q AS (SELECT clip, frame, frame // 8 AS gop, {_Q} AS q FROM seq), d AS (SELECT *, CASE WHEN frame % 8 = 0 THEN q ELSE q - lag(q) {_OVER} END AS d FROM q)"


def deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Levels, and what is stored: the level at a group's start, else the difference from the frame before."""
    q = sequences(spark, sf).select("clip", "frame", F.floor(F.col("frame") / 8).alias("gop"), F.pmod(F.floor(F.col(V) * 100), F.lit(65536)).alias("q"))
    return q.withColumn("d", F.when(F.col("frame") % 8 == 0, F.col("q")).otherwise(F.col("q") - F.lag("q").over(by_clip())))


@query("g16_delta_encode", _D16 + " SELECT clip, frame, ((d + 32768) % 65536 + 65536) % 65536 - 32768 AS d FROM d")
def delta_encode(spark: SparkSession, sf: str) -> DataFrame:
    return deltas(spark, sf).select("clip", "frame", (F.pmod(F.col("d") + 32768, F.lit(65536)) - 32768).alias("d"))


@query("g16_delta_decode", _D16 + " SELECT clip, frame, q FROM d")
def delta_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Running sums within a group, modulo 2^16, give back the levels."""
    w = W.line(["clip", "gop"], ["frame"]).rowsBetween(Window.unboundedPreceding, 0)
    stored = deltas(spark, sf).withColumn("d", F.pmod(F.col("d") + 32768, F.lit(65536)) - 32768)
    return stored.select("clip", "frame", F.pmod(F.sum("d").over(w), F.lit(65536)).alias("q"))


@query("g18_roll_forward", _D16 + " SELECT clip, q FROM d WHERE frame = 13")
def roll_forward(spark: SparkSession, sf: str) -> DataFrame:
    """The state at a frame: its group's start and every delta up to it."""
    d = deltas(spark, sf).where((F.col("gop") == 1) & (F.col("frame") <= 13))
    return d.groupBy("clip").agg(F.pmod(F.sum("d"), F.lit(65536)).alias("q"), F.max("frame").alias("f")).where("f = 13").select("clip", "q")


@query("g19_effect_track", _BRACKET + f" SELECT clip, frame, {r6('(1-t)*av+t*bv', 4)} AS level, av > 50 AS flag FROM tt")
def effect_track(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers go on a line between keyframes, flags hold until the next."""
    mixed = (1.0 - F.col("t")) * F.col("a_value") + F.col("t") * F.col("b_value")
    return bracketed(spark, sf).select("clip", "frame", rounded(mixed, 4).alias("level"), (F.col("a_value") > 50).alias("flag"))


@query("g24_ema", f"WITH {SEQ}, o AS (SELECT clip, list(value ORDER BY frame) AS v FROM seq GROUP BY clip) SELECT clip, {r6('list_reduce(v, lambda m, x: m * 0.9 + x * 0.1)', 4)} AS ema FROM o")
def ema(spark: SparkSession, sf: str) -> DataFrame:
    return W.last_ema(sequences(spark, sf), ["clip"], ["frame"], V, 0.9).select("clip", rounded(F.col("ema"), 4).alias("ema"))


@query("g25_best_window", f"WITH {SEQ}, s AS (SELECT clip, frame, sum(value) OVER w AS s, count(*) OVER w AS n FROM seq WINDOW w AS (PARTITION BY clip ORDER BY frame ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)), k AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY floor(s * 1000 + 0.5) DESC, frame) AS k FROM s WHERE n = 5) SELECT clip, frame AS start, {r6('s', 3)} AS gain FROM k WHERE k = 1")
def best_window(spark: SparkSession, sf: str) -> DataFrame:
    """The five frames of the largest sum, the first of equal ones."""
    ahead = by_clip().rowsBetween(0, 4)
    s = sequences(spark, sf).select("clip", "frame", F.sum(V).over(ahead).alias("s"), F.count("*").over(ahead).alias("n")).where("n = 5")
    best = s.groupBy("clip").agg(F.max(F.struct(F.floor(F.col("s") * 1000 + 0.5).alias("k"), (-F.col("frame")).alias("f"), "s")).alias("b"))
    return best.select("clip", (-F.col("b.f")).alias("start"), rounded(F.col("b.s"), 3).alias("gain"))


@query("g26_undo_stack", f"WITH {SEQ} SELECT clip, arg_max(event_id, frame) FILTER (event_type <> 'error') AS event_id FROM seq GROUP BY clip HAVING count(*) FILTER (event_type <> 'error') > 0")
def undo_stack(spark: SparkSession, sf: str) -> DataFrame:
    """The newest version that wasn't undone; errors stand for undone ones."""
    return sequences(spark, sf).where("event_type <> 'error'").groupBy("clip").agg(F.max_by("event_id", "frame").alias("event_id"))


@query("g27_group_by_keyframe", f"WITH {SEQ} SELECT clip, frame, last_value(CASE WHEN event_type = 'click' THEN frame END IGNORE NULLS) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS key FROM seq QUALIFY key IS NOT NULL")
def group_by_keyframe(spark: SparkSession, sf: str) -> DataFrame:
    key = F.last(F.when(F.col("event_type") == "click", F.col("frame")), ignorenulls=True).over(by_clip().rowsBetween(Window.unboundedPreceding, 0))
    return sequences(spark, sf).select("clip", "frame", key.alias("key")).where("key is not null")


# Orderings.


@query("h01_depth_sort", f"WITH {PTS}, k AS (SELECT vid, frame, CAST(floor(least(greatest((z + 1) / 2, 0), 1) * 65535) AS BIGINT) AS key FROM pts) SELECT vid, frame, row_number() OVER (PARTITION BY frame ORDER BY key DESC, vid) - 1 AS place FROM k")
def depth_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Far first, by 16-bit keys, ties in order of id."""
    key = F.floor(F.least(F.greatest((F.col("z") + 1) / 2, F.lit(0.0)), F.lit(1.0)) * 65535)
    return points(spark, sf).select("vid", "frame", (F.row_number().over(Window.partitionBy("frame").orderBy(key.desc(), "vid")) - 1).cast("long").alias("place"))


@query("h03_morton_sort", f"WITH {MORTON_CTE} SELECT vid, row_number() OVER (PARTITION BY frame ORDER BY key, vid) - 1 AS place FROM mk")
def morton_sort(spark: SparkSession, sf: str) -> DataFrame:
    return morton_keys(spark, sf).select("vid", (F.row_number().over(Window.partitionBy("frame").orderBy("key", "vid")) - 1).cast("long").alias("place"))


@query("h04_permute", f"WITH {PTS} SELECT vid * 7 % (SELECT count(*) FROM pts) AS place, vid, x FROM pts")
def permute(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    order = p.select("vid", (F.col("vid") * 7).alias("at")).crossJoin(F.broadcast(p.agg(F.count("*").alias("n")))).select("vid", (F.col("at") % F.col("n")).alias("place"))
    return order.join(p.select("vid", "x"), "vid").select("place", "vid", "x")


@query("h05_packet_sort", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events")
def packet_sort(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("place"))


@query("h06_newest_first", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey")
def newest_first(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_orderdate")


@query("h07_history_upsert", "WITH d AS (SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS k, ts FROM events) SELECT event_type, user_id, event_id FROM d WHERE k = 1 ORDER BY ts DESC, event_id DESC LIMIT 200")
def history_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The newest entry of each key, the 200 newest of those."""
    newest = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.max(F.struct("ts", "event_id")).alias("n"))
    return newest.orderBy(F.desc("n.ts"), F.desc("n.event_id")).limit(200).select("event_type", "user_id", "n.event_id")


_PAD = "list_aggregate(list_transform(regexp_extract_all(p_name, '[0-9]+|[^0-9]+'), lambda s: CASE WHEN regexp_matches(s, '^[0-9]') THEN lpad(s, 12, '0') ELSE s END), 'string_agg', '')"


def natural_key(name: str):
    """Digit runs padded to twelve places, so that frame9 comes before frame10."""
    return F.array_join(F.transform(F.regexp_extract_all(F.col(name), F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), lambda s: F.when(s.rlike("^[0-9]"), F.lpad(s, 12, "0")).otherwise(s)), "")


@query("a25_natural_sort", f"WITH n AS (SELECT 'frame' || (p_partkey * 37 % 1000) || '_' || p_size AS p_name, p_partkey FROM part), k AS (SELECT p_partkey, {_PAD} AS key FROM n) SELECT p_partkey, key FROM k ORDER BY key, p_partkey")
def natural_sort(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("frame"), F.col("p_partkey") * 37 % 1000, F.lit("_"), F.col("p_size")).alias("name"))
    return n.select("p_partkey", natural_key("name").alias("key")).orderBy("key", "p_partkey")


@query("h08_max_frames", "WITH k AS (SELECT p_partkey, p_name FROM part) SELECT p_partkey FROM k ORDER BY p_name, p_partkey LIMIT 30")
def max_frames(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").orderBy("p_name", "p_partkey").limit(30).select("p_partkey")


@query("h11_shard_ranges", f"WITH {SEQ} SELECT clip, frame, ntile(4) OVER (PARTITION BY clip ORDER BY frame) - 1 AS shard FROM seq")
def shard_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return sequences(spark, sf).select("clip", "frame", (F.ntile(4).over(by_clip()) - 1).cast("long").alias("shard"))


@query("h12_library_sort", "SELECT page_id, length(html) AS size FROM pages ORDER BY length(html) DESC, page_id")
def library_sort(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.length("html").cast("long").alias("size")).orderBy(F.desc("size"), "page_id")


@query("h13_reference_frames", f"WITH {PTS}, k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY abs(x)*abs(y) DESC, vid) AS k FROM pts), t AS (SELECT frame, vid, k, abs(x)*abs(y)*sqrt(abs(z)) AS s FROM k WHERE k <= 8) SELECT frame, arg_max(vid, (s, -vid)) AS vid FROM t GROUP BY frame")
def reference_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Eight candidates by a cheap score, then the best by the full one."""
    pre = F.abs("x") * F.abs("y")
    k = points(spark, sf).withColumn("k", F.row_number().over(Window.partitionBy("frame").orderBy(pre.desc(), "vid"))).where("k <= 8")
    best = k.groupBy("frame").agg(F.max(F.struct((pre * F.sqrt(F.abs("z"))).alias("s"), (-F.col("vid")).alias("v"))).alias("b"))
    return best.select("frame", (-F.col("b.v")).alias("vid"))


@query("h14_worst_frame", "SELECT event_id, value FROM events WHERE event_id % 2 = 0 AND event_id <> 40 ORDER BY value, event_id LIMIT 1")
def worst_frame(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("event_id % 2 = 0 and event_id <> 40").orderBy("value", "event_id").limit(1).select("event_id", "value")


# Sets.


@query("i01_concat_frames", f"WITH {TRI}, n AS (SELECT max(vid) + 1 AS n FROM pts WHERE frame = 0) SELECT tid, a, b, c FROM tri WHERE frame = 0 UNION ALL SELECT tid, a + n, b + n, c + n FROM tri, n WHERE frame = 1")
def concat_frames(spark: SparkSession, sf: str) -> DataFrame:
    """A second mesh behind a first, its indices moved by the first one's vertex count."""
    t = triangles(spark, sf)
    n = points(spark, sf).where("frame = 0").agg((F.max("vid") + 1).alias("n"))
    moved = t.where("frame = 1").crossJoin(F.broadcast(n)).select("tid", *((F.col(c) + F.col("n")).alias(c) for c in "abc"))
    return t.where("frame = 0").select("tid", "a", "b", "c").unionByName(moved)


@query("i02_geometry_copy", f"WITH {TRI} SELECT frame, tid FROM tri WHERE frame = 2 AND NOT ({_IN}) UNION ALL SELECT 2, tid FROM tri WHERE frame = 3 AND {_IN}")
def geometry_copy(spark: SparkSession, sf: str) -> DataFrame:
    """A frame without a region, with another frame's region in its place."""
    t = triangles(spark, sf)
    return t.where((F.col("frame") == 2) & ~in_box()).select("frame", "tid").unionByName(t.where((F.col("frame") == 3) & in_box()).select(F.lit(2).cast("long").alias("frame"), "tid"))


@query("i03_piece_fragment", f"WITH {TRI}, u AS (SELECT frame AS piece, a AS v FROM tri UNION SELECT frame, b FROM tri UNION SELECT frame, c FROM tri) SELECT piece, v, dense_rank() OVER (ORDER BY piece, v) - 1 AS copy FROM u")
def piece_fragment(spark: SparkSession, sf: str) -> DataFrame:
    """Vertices doubled for each piece that uses them, and numbered piece by piece."""
    u = triangles(spark, sf).select(F.col("frame").alias("piece"), F.explode(F.array("a", "b", "c")).alias("v")).distinct()
    counts = u.groupBy("piece").count()
    before = counts.withColumn("before", F.sum("count").over(Window.orderBy("piece")) - F.col("count")).drop("count")
    place = F.row_number().over(Window.partitionBy("piece").orderBy("v")) - 1
    return u.join(before, "piece").select("piece", "v", (F.col("before") + place).alias("copy"))


@query("i05_append_caps", f"WITH {TRI} SELECT frame AS loop, count(DISTINCT a) AS rim, {', '.join(r6(f'avg(a{c})') + f' AS apex_{c}' for c in P)} FROM tri GROUP BY frame")
def append_caps(spark: SparkSession, sf: str) -> DataFrame:
    """The apex that closes a loop: the mean of its rim."""
    return triangles(spark, sf).groupBy(F.col("frame").alias("loop")).agg(F.countDistinct("a").alias("rim"), *(rounded(F.avg("a" + c)).alias("apex_" + c) for c in P))


@query("i06_merge_maps", "SELECT event_id, CAST(event_id AS VARCHAR) || '|' || CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'base' END AS merged FROM events")
def merge_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Right-biased merge: entries of the second map replace those of the first."""
    base = F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("kind"), F.lit("base"))
    extra = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("kind"), F.col("event_type"))).otherwise(F.map_filter(base, lambda k, v: F.lit(False)))
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(extra, k))
    merged = F.map_concat(kept, extra)
    return table(spark, sf, "events").select("event_id", F.concat_ws("|", merged["id"], merged["kind"]).alias("merged"))


@query("i09_compact_mesh", f"WITH {TRI}, {_COMPACT.format('tri')} SELECT frame, v, n FROM nn")
def compact_mesh(spark: SparkSession, sf: str) -> DataFrame:
    t = triangles(spark, sf)
    uses = t.select("frame", "tid", F.posexplode(F.array("a", "b", "c")).alias("k", "v")).groupBy("frame", "v").agg(F.min(F.col("tid") * 3 + F.col("k")).alias("use"))
    return uses.select("frame", "v", (F.row_number().over(Window.partitionBy("frame").orderBy("use")) - 1).cast("long").alias("n"))


@query("i10_all_folders", "SELECT DISTINCT f FROM (SELECT regexp_extract(url, '//([^/]*)', 1) AS f FROM pages UNION SELECT source FROM documents) ORDER BY f")
def all_folders(spark: SparkSession, sf: str) -> DataFrame:
    used = table(spark, sf, "pages").select(F.regexp_extract("url", "//([^/]*)", 1).alias("f"))
    return used.union(table(spark, sf, "documents").select("source")).distinct().orderBy("f")


# Masks and rasters.

_BITS = "bits AS (SELECT doc_id, list_transform(string_split(text, ' ')[1:200], lambda w: CASE WHEN length(w) > 4 THEN 1 ELSE 0 END) AS b FROM documents)"
_RLE = f"WITH {_BITS}, e AS (SELECT doc_id, unnest(b) AS bit, generate_subscripts(b, 1) AS i FROM bits), c AS (SELECT *, CASE WHEN bit IS DISTINCT FROM lag(bit) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS n FROM e), r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c), l AS (SELECT doc_id, run, min(bit) AS bit, count(*) AS len FROM r GROUP BY ALL)"


def word_bits(spark: SparkSession, sf: str) -> DataFrame:
    words = F.slice(F.split("text", " "), 1, 200)
    return table(spark, sf, "documents").select("doc_id", F.transform(words, lambda w: F.when(F.length(w) > 4, 1).otherwise(0)).alias("bits"))


@query("j01_rle_encode", _RLE + " SELECT doc_id, CASE WHEN arg_min(bit, run) = 1 THEN '0,' ELSE '' END || string_agg(len, ',' ORDER BY run) AS runs FROM l GROUP BY doc_id")
def rle_encode(spark: SparkSession, sf: str) -> DataFrame:
    """A mask row of each text, long and short words, as alternating runs that begin with zeros."""
    return word_bits(spark, sf).select("doc_id", F.array_join(run_lengths(F.col("bits")), ",").alias("runs"))


@query("j01_rle_decode", f"WITH {_BITS} SELECT doc_id, list_aggregate(b, 'string_agg', '') AS bits FROM bits")
def rle_decode(spark: SparkSession, sf: str) -> DataFrame:
    w = word_bits(spark, sf)
    return w.select("doc_id", F.array_join(run_bits(run_lengths(F.col("bits")), F.size("bits")), "").alias("bits"))


_MASK = f"{_LAT}, mk AS (SELECT gy, gx, d > 2.12 AS m FROM lat)"


def mask(spark: SparkSession, sf: str) -> DataFrame:
    return lattice(spark, sf).select("gy", "gx", (F.col("d") > 2.12).alias("m"))


def spread(m: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """(gy, gx, hits, seen): set pixels and all pixels of the mask around each pixel."""
    o = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets)))
    dealt = m.withColumn("o", o).select((F.col("gy") + F.col("o.a")).alias("gy"), (F.col("gx") + F.col("o.b")).alias("gx"), "m")
    return dealt.groupBy("gy", "gx").agg(F.count_if("m").alias("hits"), F.count("*").alias("seen"))


SQUARE = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
DISC = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4]


@query("j02_morphology", f"WITH {_MASK}, j AS (SELECT p.gy, p.gx, count(*) FILTER (q.m) AS hits FROM mk p JOIN mk q ON abs(q.gy - p.gy) <= 1 AND abs(q.gx - p.gx) <= 1 GROUP BY ALL) SELECT gy, gx, hits > 0 AS dilated, hits = 9 AS eroded FROM j")
def morphology(spark: SparkSession, sf: str) -> DataFrame:
    """Square dilation and erosion; the border erodes."""
    m = mask(spark, sf)
    s = spread(m, SQUARE).join(m.drop("m"), ["gy", "gx"])
    return s.select("gy", "gx", (F.col("hits") > 0).alias("dilated"), (F.col("hits") == 9).alias("eroded"))


@query("j04_dilate_mask", f"WITH {_MASK} SELECT p.gy, p.gx FROM mk p JOIN mk q ON (q.gy-p.gy)*(q.gy-p.gy)+(q.gx-p.gx)*(q.gx-p.gx) <= 4 WHERE q.m GROUP BY ALL")
def dilate_mask(spark: SparkSession, sf: str) -> DataFrame:
    m = mask(spark, sf)
    return spread(m.where("m"), DISC).join(m.drop("m"), ["gy", "gx"]).select("gy", "gx")


@query("j05_dilate_weights", f"WITH {_LAT} SELECT p.gy, p.gx, {r6('CASE WHEN p.gx % 7 = 3 THEN any_value(p.d) ELSE max(q.d) END')} AS w FROM lat p JOIN lat q ON abs(q.gy-p.gy) <= 1 AND abs(q.gx-p.gx) <= 1 GROUP BY p.gy, p.gx")
def dilate_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Each pixel takes its neighbours' largest weight, unless it is blocked."""
    p = lattice(spark, sf)
    o = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in SQUARE)))
    near = p.withColumn("o", o).groupBy((F.col("gy") + F.col("o.a")).alias("gy"), (F.col("gx") + F.col("o.b")).alias("gx")).agg(F.max("d").alias("n"))
    return p.join(near, ["gy", "gx"]).select("gy", "gx", *out(w=F.when(F.col("gx") % 7 == 3, F.col("d")).otherwise(F.col("n"))))


@query("j06_resample_map", f"WITH {_LAT} SELECT gy, CAST(gx // 2 AS BIGINT) AS gx2, {r6('avg(d)')} AS d FROM lat GROUP BY ALL")
def resample_map(spark: SparkSession, sf: str) -> DataFrame:
    """Rows shrunk to half by area."""
    return lattice(spark, sf).groupBy("gy", F.floor(F.col("gx") / 2).alias("gx2")).agg(rounded(F.avg("d")).alias("d"))


@query("j07_resample_depth", f"WITH {_LAT}, k AS (SELECT CAST(gy // 2 AS BIGINT) AS gy2, CAST(gx // 2 AS BIGINT) AS gx2, CASE WHEN d > 1.9 THEN d END AS v FROM lat) SELECT gy2, gx2, {r6('CASE WHEN count(v) * 2 > count(*) THEN avg(v) ELSE 0 END')} AS d FROM k GROUP BY ALL")
def resample_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of the valid pixels where they are the majority, else missing."""
    k = lattice(spark, sf).select(F.floor(F.col("gy") / 2).alias("gy2"), F.floor(F.col("gx") / 2).alias("gx2"), F.when(F.col("d") > 1.9, F.col("d")).alias("v"))
    return k.groupBy("gy2", "gx2").agg(rounded(F.when(F.count("v") * 2 > F.count("*"), F.avg("v")).otherwise(0.0)).alias("d"))


@query("j13_sculpt_inflate", f"WITH {PTS} SELECT vid, {', '.join(r6(f'{c} + 0.05 * w * {c} / n') + f' AS {c}' for c in P)} FROM (SELECT *, sqrt(x*x+y*y+z*z) AS n, CASE WHEN sqrt(x*x+y*y+z*z) - 0.1 <= 0 THEN 1.0 WHEN sqrt(x*x+y*y+z*z) - 0.1 >= 0.2 THEN 0.0 ELSE (1-(sqrt(x*x+y*y+z*z)-0.1)/0.2)*(1-(sqrt(x*x+y*y+z*z)-0.1)/0.2)*(3-2*(1-(sqrt(x*x+y*y+z*z)-0.1)/0.2)) END AS w FROM pts) WHERE n > 0")
def sculpt_inflate(spark: SparkSession, sf: str) -> DataFrame:
    """Vertices move outward by a feathered weight."""
    from ..functions.encodings import smoothstep_falloff
    from ..functions.geometry import length

    n = length(tuple(F.col(c) for c in P))
    p = points(spark, sf).withColumn("n", n).where("n > 0").withColumn("w", smoothstep_falloff(F.col("n") - 0.1, 0.2))
    return p.select("vid", *out(**{c: F.col(c) + 0.05 * F.col("w") * F.col(c) / F.col("n") for c in P}))


# Documents.


@query("k01_parse_props", "SELECT event_id, json_valid(props) AS valid, length(props) AS size FROM events")
def parse_props(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.try_parse_json("props").isNotNull().alias("valid"), F.length("props").cast("long").alias("size"))


@query("k02_validate", f"WITH {SEQ}, l AS (SELECT clip, frame, event_id, value, lag(ts) {_OVER} AS before, ts FROM seq) SELECT clip, frame, 'value out of range' AS issue FROM l WHERE value < 5 OR value > 95 UNION ALL SELECT clip, frame, 'same time' FROM l WHERE ts = before UNION ALL SELECT clip, frame, 'odd id at start' FROM l WHERE frame = 0 AND event_id % 2 = 1")
def validate(spark: SparkSession, sf: str) -> DataFrame:
    """One row per broken rule."""
    s = sequences(spark, sf).withColumn("before", F.lag("ts").over(by_clip()))
    rules = [("value out of range", (F.col(V) < 5) | (F.col(V) > 95)), ("same time", F.col("ts") == F.col("before")), ("odd id at start", (F.col("frame") == 0) & (F.col("event_id") % 2 == 1))]
    issues = F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)), lambda i: i.isNotNull())
    return s.select("clip", "frame", F.explode(issues).alias("issue"))


@query("k03_collect_operations", f"WITH {SEQ} SELECT clip, event_type AS action, count(*) AS ops, min(frame) AS first FROM seq WHERE event_type IN ('click', 'view') GROUP BY ALL")
def collect_operations(spark: SparkSession, sf: str) -> DataFrame:
    s = sequences(spark, sf).where(F.col("event_type").isin("click", "view"))
    return s.groupBy("clip", F.col("event_type").alias("action")).agg(F.count("*").alias("ops"), F.min("frame").alias("first"))


@query("k04_typed_meta", "SELECT doc_id, coalesce(TRY_CAST(replace(source, 'src', '') AS BIGINT), -1) AS near, lang = 'en' AS metric FROM documents")
def typed_meta(spark: SparkSession, sf: str) -> DataFrame:
    """A typed record from a map of strings; what can't be read is -1."""
    meta = F.create_map(F.lit("near"), F.regexp_replace("source", "src", ""), F.lit("kind"), F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", F.coalesce(meta["near"].try_cast("bigint"), F.lit(-1)).alias("near"), (meta["kind"] == "en").alias("metric"))


@query("k06_detect_pattern", r"WITH n AS (SELECT page_id, regexp_extract(url, '/([0-9]+)', 1) AS d FROM pages) SELECT page_id, d AS start, '%0' || length(d) || 'd' AS pattern FROM n WHERE d <> ''")
def detect_pattern(spark: SparkSession, sf: str) -> DataFrame:
    """The printf pattern and start number of a numbered name."""
    n = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "/([0-9]+)", 1).alias("start")).where("start <> ''")
    return n.select("page_id", "start", F.concat(F.lit("%0"), F.length("start"), F.lit("d")).alias("pattern"))


@query("k07_key_frame_bit", "SELECT event_id, (event_id & 4) = 0 AND (event_id >> 6) & 3 = 2 AS is_key FROM events")
def key_frame_bit(spark: SparkSession, sf: str) -> DataFrame:
    """A marker of two bits and a clear third bit make a key frame."""
    b = F.col("event_id")
    return table(spark, sf, "events").select("event_id", ((b.bitwiseAND(F.lit(4)) == 0) & (F.shiftright(b, 6).bitwiseAND(F.lit(3)) == 2)).alias("is_key"))


@query("k09_format_frames", "WITH f AS (SELECT conv_id, turn FROM conversations WHERE turn % 5 <> 3 GROUP BY ALL), g AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM f), r AS (SELECT conv_id, min(turn) AS a, max(turn) AS b FROM g GROUP BY conv_id, i) SELECT conv_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS spec FROM r GROUP BY conv_id")
def format_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames as runs: 1-4,7."""
    from ..operators.islands import coalesce_gaps

    f = table(spark, sf, "conversations").where("turn % 5 <> 3").select("conv_id", "turn")
    r = coalesce_gaps(f, ["conv_id"], "turn").withColumn("s", F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last")))
    return r.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "s"))), lambda x: x["s"]), ",").alias("spec"))


@query("k09_parse_frames", "SELECT conv_id, list_aggregate(list_sort(list(DISTINCT turn)), 'string_agg', ',') AS frames FROM conversations WHERE turn % 5 <> 3 GROUP BY conv_id")
def parse_frames(spark: SparkSession, sf: str) -> DataFrame:
    """The frames of a list of runs."""
    parts = F.transform(F.split("spec", ","), lambda p: F.split(p, "-"))
    frames = F.flatten(F.transform(parts, lambda p: F.sequence(F.element_at(p, 1).cast("long"), F.element_at(p, -1).cast("long"))))
    return format_frames(spark, sf).select("conv_id", F.array_join(F.array_sort(F.array_distinct(frames)), ",").alias("frames"))


# Sources by what the tables can say of them.


@query("a12_packet_timing", f"WITH {SEQ}, n AS (SELECT clip, frame, 120 * (1 + event_id % 4) AS samples FROM seq), c AS (SELECT *, sum(samples) {_OVER} AS total FROM n) SELECT clip, frame, CAST(greatest(0, total - samples - 312) AS BIGINT) AS pts FROM c WHERE total > 312")
def packet_timing(spark: SparkSession, sf: str) -> DataFrame:
    """Presentation time of audio packets: samples before them less the pre-skip; packets inside it are dropped."""
    n = sequences(spark, sf).withColumn("samples", 120 * (1 + F.col("event_id") % 4))
    n = n.withColumn("total", F.sum("samples").over(by_clip().rowsBetween(Window.unboundedPreceding, 0))).where("total > 312")
    return n.select("clip", "frame", F.greatest(F.lit(0), F.col("total") - F.col("samples") - 312).alias("pts"))


@query("a26_discover_frames", "WITH d AS (SELECT regexp_extract(url, '//([^/]*)', 1) AS host, regexp_extract(url, '//[^/]*/([^/]*)', 1) AS dir, count(*) AS n FROM pages GROUP BY ALL), k AS (SELECT host, count(*) AS dirs, max(dir) AS dir FROM d WHERE n >= 2 GROUP BY host) SELECT host, dir FROM k WHERE dirs = 1")
def discover_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts with exactly one folder of frames; several are ambiguous."""
    d = table(spark, sf, "pages").groupBy(F.regexp_extract("url", "//([^/]*)", 1).alias("host"), F.regexp_extract("url", "//[^/]*/([^/]*)", 1).alias("dir")).count().where("count >= 2")
    return d.groupBy("host").agg(F.count("*").alias("dirs"), F.max("dir").alias("dir")).where("dirs = 1").select("host", "dir")


@query("a27_analyse_folder", "SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END)::BIGINT AS english, arg_min(n_chars, doc_id) AS first FROM documents GROUP BY source")
def analyse_folder(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"), F.count_if(F.col("lang") == "en").alias("english"), F.min_by("n_chars", "doc_id").alias("first"))


@query("a30_probe_container", f"WITH {SEQ}, b AS (SELECT clip, event_type AS kind, sum(length(event_type)) AS bytes FROM seq GROUP BY ALL) SELECT clip, kind, CAST(bytes AS BIGINT) AS bytes, CAST(sum(bytes) OVER (PARTITION BY clip) AS BIGINT) AS total FROM b")
def probe_container(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes by block type and in all."""
    b = sequences(spark, sf).groupBy("clip", F.col("event_type").alias("kind")).agg(F.sum(F.length("event_type")).alias("bytes"))
    return b.select("clip", "kind", "bytes", F.sum("bytes").over(Window.partitionBy("clip")).alias("total"))


@query("a31_probe_blocks", f"WITH {SEQ}, o AS (SELECT clip, event_id - lag(event_id) {_OVER} AS size FROM seq) SELECT clip, CASE WHEN size > 200 THEN 'texture' ELSE 'geometry' END AS kind, count(*) AS blocks, CAST(sum(size) AS BIGINT) AS bytes FROM o WHERE size IS NOT NULL GROUP BY ALL")
def probe_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Block sizes from consecutive offsets; a threshold parts textures from geometry."""
    o = sequences(spark, sf).select("clip", (F.col("event_id") - F.lag("event_id").over(by_clip())).alias("size")).where("size is not null")
    return o.groupBy("clip", F.when(F.col("size") > 200, "texture").otherwise("geometry").alias("kind")).agg(F.count("*").alias("blocks"), F.sum("size").alias("bytes"))


@query("a32_locate_dropped", "WITH w AS (SELECT doc_id, source || '/' || lang AS name, n_chars AS size FROM documents) SELECT w.doc_id AS wanted, min(d.doc_id) AS found, count(*) = 1 AS certain FROM w JOIN w d ON d.name = w.name AND d.size = w.size AND abs(d.doc_id - w.doc_id) <= 500 GROUP BY w.doc_id")
def locate_dropped(spark: SparkSession, sf: str) -> DataFrame:
    """Files of the same name and size, near in time; one hit is certain.

    Times are cut into stretches as long as the reach, and each stretch is looked at with its neighbours, so a name and size that very many
    files have are spread over many windows and no pairs are made.
    """
    d = table(spark, sf, "documents").select(F.concat_ws("/", "source", "lang").alias("name"), F.col("n_chars").alias("size"), "doc_id")
    own = F.floor(F.col("doc_id") / 500)
    seen = d.select("*", own.alias("own"), F.explode(F.array(own - 1, own, own + 1)).alias("stretch"))
    near = Window.partitionBy("name", "size", "stretch").orderBy("doc_id").rangeBetween(-500, 500)
    hits = seen.select("own", "stretch", F.col("doc_id").alias("wanted"), F.min("doc_id").over(near).alias("found"), (F.count("*").over(near) == 1).alias("certain"))
    return hits.where("own = stretch").select("wanted", "found", "certain")


@query("b09_clip_meta", "SELECT doc_id, '{\"clip\":' || doc_id || ',\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}' AS meta FROM documents")
def clip_meta(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("clip"), "lang", "source")).alias("meta"))


@query("l05_clock_anchor", f"WITH {SEQ} SELECT clip, frame, epoch_us(ts) - first_value(epoch_us(ts)) OVER (PARTITION BY clip ORDER BY frame) + 500000 AS media_us FROM seq")
def clock_anchor(spark: SparkSession, sf: str) -> DataFrame:
    """Media time is the anchor's plus the time since it."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return sequences(spark, sf).select("clip", "frame", (us - F.first(us).over(by_clip()) + 500000).alias("media_us"))


@query("m03_export_frame", f"WITH {PTS}, b AS (SELECT min(x) AS lo, max(x) AS hi FROM pts) SELECT vid, {r6('lo + CAST(floor((x-lo)/(hi-lo)*16383+0.5) AS BIGINT) * (hi-lo)/16383.0')} AS x FROM pts, b WHERE frame = 3")
def export_frame(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.encodings import dequantize, quantize
    from .scalars import with_box

    p = with_box(points(spark, sf)).where("frame = 3")
    return p.select("vid", *out(x=dequantize(quantize(F.col("x"), F.col("lx"), F.col("hx")), F.col("lx"), F.col("hx"))))


@query("m04_effect_block", f"WITH {PTS} SELECT vid, CAST(floor(o*1000) AS BIGINT) || ',' || CAST(floor(s0*1000) AS BIGINT) || ',' || CASE WHEN x > 0 THEN 1 ELSE 0 END AS block FROM pts")
def effect_block(spark: SparkSession, sf: str) -> DataFrame:
    """Effect parameters packed in a fixed order."""
    block = F.array(F.floor(F.col("o") * 1000), F.floor(F.col("s0") * 1000), (F.col("x") > 0).cast("long"))
    return points(spark, sf).select("vid", F.array_join(block.cast("array<string>"), ",").alias("block"))


@query("m06_grid_lod", f"WITH {PTS}, k AS (SELECT vid, pow(10, floor(log10(1 + abs(x) * 1000))) AS step FROM pts) SELECT vid, step, CAST(floor((1 + vid) / step) AS BIGINT) AS cells FROM k")
def grid_lod(spark: SparkSession, sf: str) -> DataFrame:
    """The decade ladder of an overlay grid."""
    k = points(spark, sf).select("vid", F.pow(F.lit(10.0), F.floor(F.log10(1 + F.abs("x") * 1000))).alias("step"))
    return k.select("vid", "step", F.floor((1 + F.col("vid")) / F.col("step")).alias("cells"))


@query("m10_predicate", f"WITH {TRI}, kt AS (SELECT * FROM tri WHERE az > 0), {_COMPACT.format('kt')} SELECT frame, tid, max(n) FILTER (k=0) AS a, max(n) FILTER (k=1) AS b, max(n) FILTER (k=2) AS c FROM u JOIN nn USING (frame, v) GROUP BY frame, tid")
def predicate(spark: SparkSession, sf: str) -> DataFrame:
    """Callers pass any Column as the predicate."""
    keep = F.col("az") > 0
    return compact(triangles(spark, sf).where(keep))
