"""Pieces, loops, smoothing, matches and chains over the supplied points and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.encodings import rounded
from ..operators import graphs as N
from ..operators import scans
from ..session import checkpointed, table
from .aggregates import _EDGE, edges
from .common import PTS, SEQ, TRI, points, query, r6, sequences
from .scalars import P

_FRAME_EDGES = f"{TRI}, {_EDGE}, fe AS (SELECT tri.frame, least(ed.p, ed.q) AS p, greatest(ed.p, ed.q) AS q FROM ed JOIN tri USING (tid)), both_ AS (SELECT frame, p, q FROM fe UNION SELECT frame, q, p FROM fe)"


def frame_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Undirected edges of each frame's triangles."""
    e = edges(spark, sf).join(points(spark, sf).select(F.col("vid").alias("tid"), "frame"), "tid")
    return e.select("frame", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))


@query("e07_match_nearest")
def match_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return N.match_nearest(points(spark, sf).select("frame", "vid", *P), 0.35)


@query(
    "f09_boundary_loops",
    f"""WITH RECURSIVE {_FRAME_EDGES}, once AS (SELECT frame, p, q FROM fe GROUP BY ALL HAVING count(*) = 1), b AS (SELECT frame, p, q FROM once UNION SELECT frame, q, p FROM once),
    deg AS (SELECT frame, p AS v, count(*) AS n, min(q) AS small FROM b GROUP BY frame, p),
    walk(frame, start, prev, cur, place) AS (SELECT frame, v, v, small, 1 FROM deg WHERE n = 2 UNION ALL
        SELECT w.frame, w.start, w.cur, b.q, w.place + 1 FROM walk w JOIN deg d ON d.frame = w.frame AND d.v = w.cur AND d.n = 2 JOIN b ON b.frame = w.frame AND b.p = w.cur AND b.q <> w.prev WHERE w.cur > w.start),
    closed AS (SELECT frame, start, row_number() OVER (PARTITION BY frame ORDER BY start) - 1 AS loop FROM walk WHERE cur = start)
    SELECT frame, loop, CAST(0 AS BIGINT) AS place, start AS v FROM closed UNION ALL SELECT w.frame, c.loop, CAST(w.place AS BIGINT), w.cur FROM walk w JOIN closed c ON c.frame = w.frame AND c.start = w.start WHERE w.cur <> w.start""",
)
def boundary_loops(spark: SparkSession, sf: str) -> DataFrame:
    once = frame_edges(spark, sf).groupBy("frame", "p", "q").count().where("count = 1")
    return N.boundary_loops(once.select("frame", "p", "q"))


@query("f10_connected_pieces", f"WITH RECURSIVE {_FRAME_EDGES}, reach(frame, v, w) AS (SELECT frame, p, p FROM both_ UNION SELECT r.frame, r.v, e.q FROM reach r JOIN both_ e ON e.frame = r.frame AND e.p = r.w) SELECT frame, v AS vid, min(w) AS piece FROM reach GROUP BY frame, v")
def connected_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The smallest vertex of each vertex's piece, by frame."""
    return N.pieces(frame_edges(spark, sf))


def _taubin(rounds: int) -> str:
    parts = ["t0 AS MATERIALIZED (SELECT frame, vid, x, y, z FROM pts)"]
    for k in range(2 * rounds):
        factor = -0.53 if k % 2 else 0.5
        moved = ", ".join(f"coalesce(t{k}.{c} + ({factor}) * (m.{c} - t{k}.{c}), t{k}.{c}) AS {c}" for c in P)
        parts.append(
            f"t{k + 1} AS MATERIALIZED (SELECT t{k}.frame, t{k}.vid, {moved} FROM t{k} LEFT JOIN (SELECT e.frame, e.p AS vid, avg(o.x) AS x, avg(o.y) AS y, avg(o.z) AS z"
            f" FROM both_ e JOIN t{k} o ON o.frame = e.frame AND o.vid = e.q GROUP BY e.frame, e.p) m ON m.frame = t{k}.frame AND m.vid = t{k}.vid)"
        )
    return ", ".join(parts)


@query("j12_taubin", f"WITH {_FRAME_EDGES}, {_taubin(3)} SELECT frame, vid, {', '.join(f'{r6(c)} AS {c}' for c in P)} FROM t6")
def taubin(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf).select("frame", "vid", *P)
    smooth = N.smooth_meshes(p, frame_edges(spark, sf), 3)
    return smooth.select("frame", "vid", *(rounded(F.col(c)).alias(c) for c in P))


@query(
    "g11_align_chain",
    f"""WITH RECURSIVE {PTS}, st AS (SELECT vid // 100 AS clip, vid % 100 // 10 AS row, avg(x) AS mean, stddev_pop(x) AS spread FROM pts GROUP BY ALL),
    chain(clip, row, mean, spread) AS (SELECT clip, row, mean, spread FROM st WHERE row = 0 UNION ALL
        SELECT c.clip, s.row, c.mean, CASE WHEN s.spread = 0 THEN 0 ELSE least(2.0, greatest(0.5, c.spread / nullif(s.spread, 0))) * s.spread END FROM chain c JOIN st s ON s.clip = c.clip AND s.row = c.row + 1)
    SELECT clip, row, {r6('mean')} AS mean, {r6('spread')} AS spread FROM chain""",
)
def align_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of ten values, each aligned to the aligned one before: their mean and spread."""
    vid = F.col("vid")
    rows = points(spark, sf).groupBy(F.floor(vid / 100).alias("clip"), F.floor(vid % 100 / 10).alias("row")).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("spread"))
    return scans.align_spreads(rows, ["clip"], "row", "mean", "spread").select("clip", "row", rounded(F.col("mean")).alias("mean"), rounded(F.col("spread")).alias("spread"))


_CUT = "(c.length > 0 AND (c.length >= 12 OR (s.value > 80.0 AND c.length >= 3)))"


@query(
    "g22_adaptive_cut",
    f"""WITH RECURSIVE {SEQ}, cut(clip, frame, run, length) AS (SELECT clip, frame, CAST(0 AS BIGINT), 1 FROM seq WHERE frame = 0 UNION ALL
        SELECT c.clip, s.frame, c.run + CASE WHEN {_CUT} THEN 1 ELSE 0 END, CASE WHEN {_CUT} THEN 1 ELSE c.length + 1 END FROM cut c JOIN seq s ON s.clip = c.clip AND s.frame = c.frame + 1)
    SELECT clip, frame, run FROM cut""",
)
def adaptive_cut(spark: SparkSession, sf: str) -> DataFrame:
    return scans.cut_runs(sequences(spark, sf).select("clip", "frame", "value"), ["clip"], "frame", "value", 80.0, 3, 12)


# Windows of 8 slots over a label's vectors, of 4 pixels each: two reference slots, two that overlap, four new ones; slot 5 is the next window's reference.
_SIZE, _ALIGN, _OVERLAP, _KEY = 8, 2, 4, 5
_PIXELS = 4
_WINDOWS = f"""f AS (SELECT label AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding FROM embeddings),
    n AS (SELECT clip, count(*) AS n FROM f GROUP BY clip HAVING count(*) >= {_SIZE}),
    k AS (SELECT clip, unnest(range(0, (n - {_SIZE}) // {_SIZE - _OVERLAP} + 1)) AS w FROM n),
    ws AS (SELECT clip, w, slot, CASE WHEN w = 0 THEN slot WHEN slot = 0 THEN 0 WHEN slot = 1 THEN CASE WHEN w = 1 THEN {_KEY} ELSE {_KEY - _ALIGN} + {_SIZE - (_OVERLAP - _ALIGN)} + (w - 2) * {_SIZE - _OVERLAP} END ELSE slot - {_ALIGN} + {_SIZE - (_OVERLAP - _ALIGN)} + (w - 1) * {_SIZE - _OVERLAP} END AS frame FROM k, range(0, {_SIZE}) t(slot)),
    win AS (SELECT ws.clip, w, slot, list_transform(embedding[1:{_PIXELS}], lambda x: abs(CAST(x AS DOUBLE)) * 10 * (1 + 0.05 * (w % 5)) + 0.3 * (w % 3) - 0.2 * (w % 2)) AS d FROM ws JOIN f ON f.clip = ws.clip AND f.frame = ws.frame)"""


def depth_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Depth maps of a label's frames as windows see them, each with a scale and shift of its own."""
    line = Window.partitionBy("label").orderBy("vec_id")
    f = table(spark, sf, "embeddings").select(F.col("label").alias("clip"), (F.row_number().over(line) - 1).alias("frame"), "embedding")
    fade, step = _OVERLAP - _ALIGN, _SIZE - _OVERLAP
    n = f.groupBy("clip").agg(F.count("*").alias("n")).where(F.col("n") >= _SIZE)
    k = n.select("clip", F.explode(F.sequence(F.lit(0), ((F.col("n") - _SIZE) / step).cast("int"))).alias("w")).select("clip", "w", F.explode(F.sequence(F.lit(0), F.lit(_SIZE - 1))).alias("slot"))
    place = lambda slot, w: slot - _ALIGN + _SIZE - fade + (w - 1) * step
    w, slot = F.col("w"), F.col("slot")
    frame = F.when(w == 0, slot).when(slot == 0, 0).when(slot == 1, F.when(w == 1, _KEY).otherwise(place(F.lit(_KEY), w - 1))).otherwise(place(slot, w))
    win = k.withColumn("frame", frame).join(f, ["clip", "frame"])
    d = F.abs(F.col("v").cast("double")) * 10 * (1 + 0.05 * (w % 5)) + 0.3 * (w % 3) - 0.2 * (w % 2)
    return win.select("clip", "w", "slot", F.posexplode(F.slice("embedding", 1, _PIXELS)).alias("pixel", "v")).select("clip", "w", "slot", "pixel", d.alias("d"))


_FADE = f"{_OVERLAP - _ALIGN - 1}.0"
_SUM = lambda f, *lists: f"list_sum(list_transform(range(1, {_PIXELS + 1}), lambda i: {f}))"


@query(
    "g21_window_aligner",
    f"""WITH RECURSIVE {_WINDOWS}, refs AS (SELECT a.clip, a.w, a.d AS p0, b.d AS p1, z.d AS r0, c.d AS key FROM win a JOIN win b ON b.clip = a.clip AND b.w = a.w AND b.slot = 1 JOIN win z ON z.clip = a.clip AND z.w = 0 AND z.slot = 0 JOIN win c ON c.clip = a.clip AND c.w = a.w AND c.slot = {_KEY} WHERE a.slot = 0),
    al(clip, w, s, h, r1) AS (SELECT clip, w, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), key FROM refs WHERE w = 0 UNION ALL
        SELECT clip, w, s, h, list_transform(key, lambda x: greatest(0.0, s * x + h)) FROM (
            SELECT clip, w, key, CASE WHEN det = 0 THEN 1.0 ELSE ({2.0 * _PIXELS} * b0 - a01 * b1) / nullif(det, 0) END AS s, CASE WHEN det = 0 THEN 0.0 ELSE (a00 * b1 - a01 * b0) / nullif(det, 0) END AS h
            FROM (SELECT *, a00 * {2.0 * _PIXELS} - a01 * a01 AS det FROM (
                SELECT r.clip, r.w, r.key, {_SUM('r.p0[i] * r.p0[i] + r.p1[i] * r.p1[i]')} AS a00, {_SUM('r.p0[i] + r.p1[i]')} AS a01, {_SUM('r.p0[i] * r.r0[i] + r.p1[i] * al.r1[i]')} AS b0, {_SUM('r.r0[i] + al.r1[i]')} AS b1
                FROM al JOIN refs r ON r.clip = al.clip AND r.w = al.w + 1)))),
    ends AS (SELECT clip, max(w) AS last FROM al GROUP BY clip),
    v AS (SELECT win.clip, win.w, slot, i - 1 AS pixel, CASE WHEN win.w = 0 THEN d[i] ELSE greatest(0.0, s * d[i] + h) END AS v, last FROM win JOIN al ON al.clip = win.clip AND al.w = win.w JOIN ends ON ends.clip = win.clip, range(1, {_PIXELS + 1}) t(i) WHERE win.w = 0 OR slot >= {_ALIGN})
    SELECT clip, CAST(CASE WHEN w = 0 THEN slot ELSE slot - {_ALIGN} + {_SIZE - (_OVERLAP - _ALIGN)} + (w - 1) * {_SIZE - _OVERLAP} END AS BIGINT) AS frame, CAST(pixel AS INTEGER) AS pixel,
        {r6(f'sum(v * CASE WHEN w > 0 AND slot < {_OVERLAP} THEN (slot - {_ALIGN}) / {_FADE} ELSE 1.0 END * CASE WHEN w < last AND slot >= {_SIZE - (_OVERLAP - _ALIGN)} THEN 1 - (slot - {_SIZE - (_OVERLAP - _ALIGN)}) / {_FADE} ELSE 1.0 END)', 4)} AS d
    FROM v GROUP BY ALL""",
)
def window_aligner(spark: SparkSession, sf: str) -> DataFrame:
    found = scans.align_windows(depth_windows(spark, sf), _SIZE, _ALIGN, _OVERLAP, _KEY)
    return found.select(F.col("clip").cast("int").alias("clip"), "frame", "pixel", rounded(F.col("d"), 4).alias("d"))


_LEVEL, _PAD = 0.12, 0.1


def mask_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as masks of 8 x 8 pixels of a label's frames, with their components."""
    on = F.array_compact(F.transform("embedding", lambda v, i: F.when(v > F.lit(_LEVEL).cast("float"), i)))
    e = table(spark, sf, "embeddings").select(F.col("label").alias("clip"), F.col("vec_id").alias("frame"), F.explode(on).alias("i"))
    return N.label_masks(e.select("clip", "frame", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x")))


@query(
    "e18_mask_overlap_track",
    f"""WITH RECURSIVE px AS (SELECT label AS clip, vec_id AS frame, i // 8 AS y, i % 8 AS x FROM embeddings, range(0, 64) t(i) WHERE embedding[i + 1] > CAST({_LEVEL} AS FLOAT)),
    reach(clip, frame, y, x, cy, cx) AS (SELECT clip, frame, y, x, y, x FROM px UNION SELECT r.clip, r.frame, r.y, r.x, p.y, p.x FROM reach r JOIN px p ON p.clip = r.clip AND p.frame = r.frame AND abs(p.y - r.cy) <= 1 AND abs(p.x - r.cx) <= 1),
    lab AS (SELECT clip, frame, y, x, min(cy * 65536 + cx) AS comp FROM reach GROUP BY ALL),
    area AS (SELECT clip, frame, comp, count(*) AS area FROM lab GROUP BY ALL),
    fr AS (SELECT clip, frame, arg_max(comp, area * 1000000 - comp) AS largest, row_number() OVER (PARTITION BY clip ORDER BY frame) - 1 AS pos FROM area GROUP BY clip, frame),
    ov AS (SELECT a.clip, fa.pos, a.comp, b.comp AS nxt, count(*) AS n FROM lab a JOIN fr fa ON fa.clip = a.clip AND fa.frame = a.frame JOIN fr fb ON fb.clip = a.clip AND fb.pos = fa.pos + 1 JOIN lab b ON b.clip = fb.clip AND b.frame = fb.frame AND b.y = a.y AND b.x = a.x GROUP BY ALL),
    best AS (SELECT clip, pos, comp, arg_max(nxt, n * 1000000 - nxt) AS nxt FROM ov GROUP BY ALL),
    track(clip, pos, comp, jump) AS (SELECT clip, pos, largest, false FROM fr WHERE pos = 0 UNION ALL
        SELECT t.clip, f.pos, coalesce(b.nxt, f.largest), b.nxt IS NULL FROM track t JOIN fr f ON f.clip = t.clip AND f.pos = t.pos + 1 LEFT JOIN best b ON b.clip = t.clip AND b.pos = t.pos AND b.comp = t.comp)
    SELECT t.clip, fr.frame, t.comp, t.jump, {r6(f'greatest(0.0, min(l.x) - {_PAD} * (max(l.x) - min(l.x) + 1))')} AS x0, {r6(f'greatest(0.0, min(l.y) - {_PAD} * (max(l.y) - min(l.y) + 1))')} AS y0,
        {r6(f'least(8.0, max(l.x) + 1 + {_PAD} * (max(l.x) - min(l.x) + 1))')} AS x1, {r6(f'least(8.0, max(l.y) + 1 + {_PAD} * (max(l.y) - min(l.y) + 1))')} AS y1
    FROM track t JOIN fr ON fr.clip = t.clip AND fr.pos = t.pos JOIN lab l ON l.clip = t.clip AND l.frame = fr.frame AND l.comp = t.comp GROUP BY t.clip, fr.frame, t.comp, t.jump""",
)
def mask_overlap_track(spark: SparkSession, sf: str) -> DataFrame:
    """The followed component of each frame, and its box with a tenth of its size around it."""
    labels = checkpointed(mask_labels(spark, sf))
    picked = N.follow_masks(labels.withColumn("pixel", F.col("y") * 65536 + F.col("x")))
    size = lambda c: F.max(c) - F.min(c) + 1
    low = lambda c: rounded(F.greatest(F.lit(0.0), F.min(c) - _PAD * size(c)))
    high = lambda c: rounded(F.least(F.lit(8.0), F.max(c) + 1 + _PAD * size(c)))
    boxes = labels.join(picked, ["clip", "frame", "comp"]).groupBy("clip", "frame", "comp", "jump")
    return boxes.agg(low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1"))
