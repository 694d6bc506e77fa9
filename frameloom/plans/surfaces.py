"""Points of a frame carried onto the next frame's surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encodings import rounded
from ..operators import surfaces as S
from .aggregates import _EDGE, edges
from .common import PTS, TRI, points, query, r6
from .graphs import frame_edges
from .scalars import P

_UV = ("u", "v")
# The next frame's triangles, with scales as texture coordinates.
_SURFACE = (
    PTS + ", tri AS (SELECT p.vid AS tid, p.frame - 1 AS frame, " + ", ".join(f'{n}.{c} AS "{n}{c}", {n}.s0 AS {n}u, {n}.s1 AS {n}v' if c == "x" else f'{n}.{c} AS "{n}{c}"' for n in "abc" for c in P)
    + " FROM pts p JOIN pts a ON a.vid = p.vid JOIN pts b ON b.vid = p.vid + 1 JOIN pts c ON c.vid = p.vid + 2)"
)


def _sql_dot(side: str, corner: str) -> str:
    return " + ".join(f'("{side}{c}" - "a{c}") * ({c} - "{corner}{c}")' for c in P)


_D = ", ".join(f"{_sql_dot(side, corner)} AS d{2 * k + j + 1}" for k, corner in enumerate("abc") for j, side in enumerate("bc"))
_ALONG = "coalesce((d4 - d3) / nullif((d4 - d3) + (d5 - d6), 0), 0)"


def _weight(a: str, b: str, ab: str, c: str, ac: str, bc: str, inside: str) -> str:
    return (
        f"CASE WHEN d1 <= 0 AND d2 <= 0 THEN {a} WHEN d3 >= 0 AND d4 <= d3 THEN {b} WHEN vc <= 0 AND d1 >= 0 AND d3 <= 0 THEN {ab} WHEN d6 >= 0 AND d5 <= d6 THEN {c}"
        f" WHEN vb <= 0 AND d2 >= 0 AND d6 <= 0 THEN {ac} WHEN va <= 0 AND d4 - d3 >= 0 AND d5 - d6 >= 0 THEN {bc} ELSE {inside} END"
    )


def _nearest_sql(pairs: str, by: str, k: str = "") -> str:
    """Every pair's closest point, and of each key the nearest, in tables whose names end in k."""
    wb = _weight("0", "1", "coalesce(d1 / nullif(d1 - d3, 0), 0)", "0", "0", f"1 - {_ALONG}", "coalesce(vb / nullif(va + vb + vc, 0), 0)")
    wc = _weight("0", "0", "0", "1", "coalesce(d2 / nullif(d2 - d6, 0), 0)", _ALONG, "coalesce(vc / nullif(va + vb + vc, 0), 0)")
    points_ = ", ".join(f'"a{c}" + wb * ("b{c}" - "a{c}") + wc * ("c{c}" - "a{c}") AS p{c}' for c in P)
    uv = ", ".join(f"(1 - wb - wc) * a{n} + wb * b{n} + wc * c{n} AS t{n}" for n in _UV)
    gap = " + ".join(f"({c} - p{c}) * ({c} - p{c})" for c in P)
    return (
        f"d{k} AS (SELECT *, {_D} FROM ({pairs})), e{k} AS (SELECT *, d3 * d6 - d5 * d4 AS va, d5 * d2 - d1 * d6 AS vb, d1 * d4 - d3 * d2 AS vc FROM d{k}), w{k} AS (SELECT *, {wb} AS wb, {wc} AS wc FROM e{k}),"
        f" f{k} AS (SELECT *, {points_}, {uv} FROM w{k}), g{k} AS (SELECT *, {gap} AS d2_ FROM f{k}), n{k} AS MATERIALIZED (SELECT {by}, arg_min(struct_pack(px := px, py := py, pz := pz, tu := tu, tv := tv, d2_ := d2_), struct_pack(d := d2_, t := tid)) AS s FROM g{k} GROUP BY {by})"
    )


_SHOWN = ", ".join(f"{r6('n.s.p' + c)} AS p{c}" for c in P) + ", " + ", ".join(f"{r6('n.s.t' + c, 5)} AS {c}" for c in _UV) + f", {r6('sqrt(n.s.d2_)')} AS distance"


def surface(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    corner = lambda n, k: p.select((F.col("vid") - k).alias("tid"), *(F.col(c).alias(n + c) for c in P), F.col("s0").alias(n + "u"), F.col("s1").alias(n + "v"))
    return p.select(F.col("vid").alias("tid"), (F.col("frame") - 1).alias("frame")).join(corner("a", 0), "tid").join(corner("b", 1), "tid").join(corner("c", 2), "tid")


def shown(found: DataFrame, *by: str) -> DataFrame:
    return found.select(*by, *(rounded(F.col("p" + c)).alias("p" + c) for c in P), *(rounded(F.col(c), 5).alias(c) for c in _UV), rounded(F.sqrt("d2")).alias("distance"))


@query("e08_nearest_on_surface", f"WITH {_SURFACE}, " + _nearest_sql("SELECT pts.vid, pts.x, pts.y, pts.z, tri.* FROM pts JOIN tri USING (frame)", "vid") + f" SELECT pts.vid, {_SHOWN} FROM pts LEFT JOIN n USING (vid)")
def nearest_on_surface(spark: SparkSession, sf: str) -> DataFrame:
    """Every point's nearest point on the next frame's surface, with the texture coordinates there."""
    return shown(S.nearest_on_surface(points(spark, sf).select("frame", "vid", *P), surface(spark, sf), attributes=_UV), "vid")


# Template triangles try the triangles of their corners first, and what is two sides away.
_SIDES = PTS + ", own AS (SELECT vid AS t, unnest([vid, vid + 1, vid + 2]) AS tid FROM pts WHERE vid + 2 IN (SELECT vid FROM pts) AND vid + 1 IN (SELECT vid FROM pts)), ed AS (SELECT t AS tid, unnest([struct_pack(p := t, q := t + 1), struct_pack(p := t + 1, q := t + 2), struct_pack(p := t, q := t + 2)]) AS e FROM (SELECT DISTINCT t FROM own)), sides AS (SELECT tid, e.p AS p, e.q AS q FROM ed)"
_HOPS = (
    "hops(t, tid, ring) AS (SELECT t, tid, 0 FROM own WHERE tid IN (SELECT tid FROM sides) UNION SELECT h.t, b.tid, h.ring + 1 FROM hops h JOIN sides a ON a.tid = h.tid JOIN sides b ON b.p = a.p AND b.q = a.q WHERE h.ring < 2),"
    " near AS (SELECT t, tid, min(ring) AS ring FROM hops GROUP BY t, tid)"
)


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf).select("tid", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    seeds = edges(spark, sf).select(F.col("tid").alias("t"), F.explode(F.array("p", "q")).alias("tid"))
    return S.local_candidates(seeds.join(e.select("tid").distinct(), "tid", "left_semi"), e, rings=2)


@query("e10_local_candidates", f"WITH RECURSIVE {_SIDES}, {_HOPS} SELECT t, tid, CAST(ring AS INTEGER) AS ring FROM near")
def local_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf)


_ALL = _SURFACE.removeprefix(PTS + ", ")


@query("e10_nearest_of_candidates", f"WITH RECURSIVE {_SIDES}, {_HOPS}, {_ALL}, " + _nearest_sql("SELECT pts.vid AS t, pts.x, pts.y, pts.z, tri.* FROM pts JOIN near ON near.t = pts.vid JOIN tri ON tri.tid = near.tid", "t") + f" SELECT n.t, {_SHOWN} FROM n")
def nearest_of_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The first corner of each triangle on the triangles around it, without a search of the whole surface."""
    p = points(spark, sf).select(F.col("vid").alias("t"), *P)
    near = candidates(spark, sf)
    found = S.nearest_of_candidates(p.join(near.select("t").distinct(), "t", "left_semi"), near, surface(spark, sf).drop("frame"), attributes=_UV)
    return shown(found, "t")


def _registered(rounds: int) -> str:
    """Rounds of all pairs' nearest points, one double step of smoothing, and the move."""
    own = TRI.replace(", tri AS", ", tri0 AS") + ", " + _EDGE.replace("ed AS", "ed0 AS").replace("FROM tri", "FROM tri0")
    parts = [own, "fe AS (SELECT tri0.frame, least(ed0.p, ed0.q) AS p, greatest(ed0.p, ed0.q) AS q FROM ed0 JOIN tri0 USING (tid))", "both_ AS (SELECT frame, p, q FROM fe UNION SELECT frame, q, p FROM fe)", _ALL, "c0 AS (SELECT frame, vid, x, y, z FROM pts)"]
    for k in range(rounds):
        parts.append(_nearest_sql(f"SELECT c{k}.vid, c{k}.x, c{k}.y, c{k}.z, tri.* FROM c{k} JOIN tri USING (frame)", "vid", str(k)))
        parts.append(f"m{k}_0 AS MATERIALIZED (SELECT c{k}.frame, c{k}.vid, " + ", ".join(f"coalesce(n{k}.s.p{c} - c{k}.{c}, 0) AS {c}" for c in P) + f" FROM c{k} LEFT JOIN n{k} USING (vid))")
        for j, factor in enumerate((0.5, -0.53)):
            a, b = f"m{k}_{j}", f"m{k}_{j + 1}"
            moved = ", ".join(f"coalesce({a}.{c} + ({factor}) * (q.{c} - {a}.{c}), {a}.{c}) AS {c}" for c in P)
            parts.append(f"{b} AS MATERIALIZED (SELECT {a}.frame, {a}.vid, {moved} FROM {a} LEFT JOIN (SELECT e.frame, e.p AS vid, avg(o.x) AS x, avg(o.y) AS y, avg(o.z) AS z FROM both_ e JOIN {a} o ON o.frame = e.frame AND o.vid = e.q GROUP BY e.frame, e.p) q ON q.frame = {a}.frame AND q.vid = {a}.vid)")
        parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c{k}.frame, c{k}.vid, " + ", ".join(f"c{k}.{c} + m{k}_2.{c} AS {c}" for c in P) + f" FROM c{k} JOIN m{k}_2 USING (frame, vid))")
    return ", ".join(parts)


@query("g23_register_chain_frame", f"WITH {_registered(2)} SELECT frame, vid, {', '.join(f'{r6(c, 5)} AS {c}' for c in P)} FROM c2")
def register_chain_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Every frame's points drawn onto the next frame's surface in two rounds."""
    p = points(spark, sf).select("frame", "vid", *P)
    found = S.register(p, frame_edges(spark, sf), surface(spark, sf), rounds=2, smooth=1)
    return found.select("frame", "vid", *(rounded(F.col(c), 5).alias(c) for c in P))
