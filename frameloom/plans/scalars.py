"""Scalar encodings, projections and math over points and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encodings as E
from ..functions import geometry as G
from ..session import table
from .common import PTS, SEQ, out, points, query, r6, sequences, triangles

P = ("x", "y", "z")
BITS, LEVELS = 14, (1 << 14) - 1
#: Parameters of the sample transform, camera and colour.
TURN, TARGET, CAMERA = (20.0, 35.0, -10.0), (200, 60, 30), (1.2, 0, 0, 0, 0, 1.6, 0, 0, 0, 0, -1.02, -0.2, 0, 0, -1, 4.0)


def xyz() -> tuple:
    return tuple(F.col(c) for c in P)


def m3(m, p=P, off=("0.0", "0.0", "0.0")):
    """SQL of an affine map."""
    return [f"({m[3 * i]!r})*{p[0]} + ({m[3 * i + 1]!r})*{p[1]} + ({m[3 * i + 2]!r})*{p[2]} + {off[i]}" for i in range(3)]


_BOX = "box AS (SELECT " + ", ".join(f"min({c}) AS l{c}, max({c}) AS h{c}" for c in P) + " FROM pts)"


def with_box(p: DataFrame) -> DataFrame:
    """p with the whole clip's bounds; they are one row."""
    return p.crossJoin(F.broadcast(p.agg(*(f(c).alias(n + c) for c in P for f, n in ((F.min, "l"), (F.max, "h"))))))


def _q(c: str, levels: int = LEVELS) -> str:
    return f"CAST(least(greatest(floor(({c} - l{c}) / (CASE WHEN h{c} = l{c} THEN 1 ELSE h{c} - l{c} END) * {levels} + 0.5), 0), {levels}) AS BIGINT)"


@query("c01_quantize_positions", f"WITH {PTS}, {_BOX} SELECT vid, {', '.join(f'{_q(c)} AS q{c}' for c in P)} FROM pts, box")
def quantize_positions(spark: SparkSession, sf: str) -> DataFrame:
    return with_box(points(spark, sf)).select("vid", *(E.quantize(F.col(c), F.col("l" + c), F.col("h" + c), BITS).alias("q" + c) for c in P))


@query("c02_quantize_uv", f"WITH {PTS} SELECT vid, CAST(least(greatest(floor(x*65535+0.5),0),65535) AS BIGINT) AS qu, CAST(least(greatest(floor(y*65535+0.5),0),65535) AS BIGINT) AS qv FROM pts")
def quantize_uv(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select("vid", E.quantize_unit(F.col("x")).alias("qu"), E.quantize_unit(F.col("y")).alias("qv"))


@query("c03_dequantize", f"WITH {PTS}, {_BOX} SELECT vid, {', '.join(r6(f'l{c} + {_q(c)} * (h{c} - l{c}) / {float(LEVELS)}') + f' AS w{c}' for c in P)}, {', '.join(f'abs(l{c} + {_q(c)} * (h{c} - l{c}) / {float(LEVELS)} - {c}) <= (h{c} - l{c}) / {float(LEVELS)} AS near_{c}' for c in P)} FROM pts, box")
def dequantize(spark: SparkSession, sf: str) -> DataFrame:
    b = with_box(points(spark, sf))
    w = {c: E.dequantize(E.quantize(F.col(c), F.col("l" + c), F.col("h" + c), BITS), F.col("l" + c), F.col("h" + c), BITS) for c in P}
    return b.select("vid", *out(**{"w" + c: w[c] for c in P}), *((F.abs(w[c] - F.col(c)) <= (F.col("h" + c) - F.col("l" + c)) / float(LEVELS)).alias("near_" + c) for c in P))


_SB = lambda c: f"CAST(least(greatest(floor((ln(greatest(1e-12, {c})) + 10) * 16 + 0.5), 0), 255) AS BIGINT)"


@query("c04_scale_byte", f"WITH {PTS}, e AS (SELECT vid, {_SB('abs(s0)')} AS b FROM pts) SELECT vid, b, {r6('exp(b / 16.0 - 10)', 9)} AS scale FROM e")
def scale_byte(spark: SparkSession, sf: str) -> DataFrame:
    e = points(spark, sf).select("vid", E.scale_byte(F.abs("s0")).alias("b"))
    return e.select("vid", "b", E.rounded(E.scale_of_byte(F.col("b")), 9).alias("scale"))


_SH = "CAST(least(greatest(floor(s1 * 128 + 0.5) + 128, 0), 255) AS BIGINT)"


@query("c05_sh_byte", f"WITH {PTS} SELECT vid, {_SH} AS b, ({_SH} - 128) / 128.0 AS v FROM pts")
def sh_byte(spark: SparkSession, sf: str) -> DataFrame:
    e = points(spark, sf).select("vid", E.sh_byte(F.col("s1")).alias("b"))
    return e.select("vid", "b", E.sh_of_byte(F.col("b")).alias("v"))


@query("c06_sh_layout", f"WITH {PTS}, e AS (SELECT vid, frame % 4 AS degree FROM pts), k AS (SELECT *, CASE WHEN degree <= 0 THEN 0 ELSE (degree+1)*(degree+1)-1 END AS coefficients FROM e) SELECT vid, degree, CAST(coefficients AS BIGINT) AS coefficients, CAST(floor((coefficients*3+3)/4) * 4 AS BIGINT) AS stride FROM k")
def sh_layout(spark: SparkSession, sf: str) -> DataFrame:
    e = points(spark, sf).select("vid", (F.col("frame") % 4).alias("degree"))
    return e.select("vid", "degree", E.sh_coefficients(F.col("degree")).alias("coefficients"), E.sh_stride(F.col("degree")).alias("stride"))


_N = "sqrt(q0*q0+q1*q1+q2*q2+q3*q3)"
_UQ = ", u AS (SELECT vid, frame, " + ", ".join(f"q{i} / (CASE WHEN {_N} = 0 THEN 1 ELSE {_N} END) AS u{i}" for i in range(4)) + " FROM pts), l AS (SELECT *, CASE WHEN abs(u0) >= greatest(abs(u1),abs(u2),abs(u3)) THEN 0 WHEN abs(u1) >= greatest(abs(u2),abs(u3)) THEN 1 WHEN abs(u2) >= abs(u3) THEN 2 ELSE 3 END AS k FROM u), s AS (SELECT *, CASE k WHEN 0 THEN u0 WHEN 1 THEN u1 WHEN 2 THEN u2 ELSE u3 END < 0 AS f FROM l)"
_FIELD = lambda i: f"CASE WHEN k = {i} THEN [] ELSE [CAST(least(floor(abs(u{i}) / sqrt(0.5) * 511 + 0.5), 511) AS BIGINT) + (CASE WHEN (u{i} < 0) <> f THEN 512 ELSE 0 END)] END"
_WORD = f"w AS (SELECT vid, k, f, u0, u1, u2, u3, list_concat({_FIELD(0)}, list_concat({_FIELD(1)}, list_concat({_FIELD(2)}, {_FIELD(3)}))) AS p FROM s)"


@query("c07_pack_quaternion", f"WITH {PTS}{_UQ}, {_WORD} SELECT vid, CAST(CAST(k AS BIGINT) * 1073741824 + p[1] * 1048576 + p[2] * 1024 + p[3] AS BIGINT) AS word FROM w")
def pack_quaternion(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select("vid", E.pack_quaternion([F.col(f"q{i}") for i in range(4)]).alias("word"))


@query("c07_quaternion_round_trip", f"WITH {PTS}{_UQ} SELECT vid, true AS near, true AS sign_invariant FROM s")
def quaternion_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Unpacked, a quaternion is its unit form or the negative of that, to 1/511; both pack alike."""
    q = [F.col(f"q{i}") for i in range(4)]
    p = points(spark, sf).select("vid", *q, E.pack_quaternion(q).alias("word"), E.pack_quaternion([-c for c in q]).alias("mirror"))
    unit, back = G.normalized(q), E.unpack_quaternion(F.col("word"))
    dot = F.abs(sum((a * b for a, b in zip(unit[1:], back[1:], strict=True)), unit[0] * back[0]))
    return p.select("vid", (dot > 0.99999).alias("near"), (F.col("word") == F.col("mirror")).alias("sign_invariant"))


_UB = lambda c: f"CAST(floor(least(greatest({c},0),1)*255+0.5) AS BIGINT)"


@query("c08_attribute_words", f"WITH {PTS} SELECT vid, {_SB('abs(s0)')} + 256*{_SB('abs(s1)')} + 65536*{_SB('abs(s2)')} + 16777216*{_UB('o')} AS word0, {_UB('r')} + 256*{_UB('g')} + 65536*{_UB('b')} AS word2 FROM pts")
def attribute_words(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return points(spark, sf).select("vid", E.attribute_word0(F.abs("s0"), F.abs("s1"), F.abs("s2"), c("o")).alias("word0"), E.attribute_word2(c("r"), c("g"), c("b")).alias("word2"))


@query("c09_activations", f"WITH {PTS}, e AS (SELECT vid, 1/(1+exp(-o)) AS p, 0.5+0.28209479177387814*r AS color FROM pts) SELECT vid, {r6('p')} AS opacity, {r6('ln(least(1-1e-6,greatest(1e-6,p))/(1-least(1-1e-6,greatest(1e-6,p))))')} AS back, {r6('color')} AS color, {r6('(color-0.5)/0.28209479177387814')} AS sh0 FROM e")
def activations(spark: SparkSession, sf: str) -> DataFrame:
    p = E.sigmoid(F.col("o"))
    color = E.sh0_color(F.col("r"))
    return points(spark, sf).select("vid", *out(opacity=p, back=E.logit(p), color=color, sh0=E.color_sh0(color)))


_OA, _OB = "x/(CASE WHEN abs(x)+abs(y)+abs(z)=0 THEN 1 ELSE abs(x)+abs(y)+abs(z) END)", "y/(CASE WHEN abs(x)+abs(y)+abs(z)=0 THEN 1 ELSE abs(x)+abs(y)+abs(z) END)"


@query("c10_octahedral_normal", f"WITH {PTS}, e AS (SELECT vid, z, {_OA} AS a, {_OB} AS b FROM pts), f AS (SELECT vid, CASE WHEN z < 0 THEN (1-abs(b))*(CASE WHEN a>=0 THEN 1 ELSE -1 END) ELSE a END AS ox, CASE WHEN z < 0 THEN (1-abs(a))*(CASE WHEN b>=0 THEN 1 ELSE -1 END) ELSE b END AS oy FROM e) SELECT vid, CAST(floor(ox*32767+0.5) AS BIGINT) AS ox, CAST(floor(oy*32767+0.5) AS BIGINT) AS oy FROM f")
def octahedral_normal(spark: SparkSession, sf: str) -> DataFrame:
    a, b = E.octahedral(*xyz())
    return points(spark, sf).select("vid", a.alias("ox"), b.alias("oy"))


_ML = lambda c: f"CAST(least(greatest(floor(({c}-l{c})*(1023/(CASE WHEN h{c}=l{c} THEN 1 ELSE h{c}-l{c} END))+0.5),0),1023) AS BIGINT)"
MORTON_SQL = " + ".join(f"((m{c} >> {i}) & 1) * {1 << (3 * i + a)}" for a, c in enumerate(P) for i in range(10))
MORTON_CTE = f"{PTS}, {_BOX}, ml AS (SELECT vid, frame, {', '.join(f'{_ML(c)} AS m{c}' for c in P)} FROM pts, box), mk AS (SELECT vid, frame, CAST({MORTON_SQL} AS BIGINT) AS key FROM ml)"


def morton_keys(spark: SparkSession, sf: str) -> DataFrame:
    return with_box(points(spark, sf)).select("vid", "frame", E.morton(*(E.morton_level(F.col(c), F.col("l" + c), F.col("h" + c)) for c in P)).alias("key"))


@query("c11_morton_key", f"WITH {MORTON_CTE} SELECT vid, key FROM mk")
def morton_key(spark: SparkSession, sf: str) -> DataFrame:
    return morton_keys(spark, sf).select("vid", "key")


@query("c12_crc32")
def crc32(spark: SparkSession, sf: str) -> DataFrame:
    """IEEE CRC-32; tests hold it against zlib."""
    return table(spark, sf, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


@query("c15_topology_hash", "SELECT user_id AS clip, sha1(string_agg(event_type, ',' ORDER BY ts, event_id)) AS topology FROM events GROUP BY user_id")
def topology_hash(spark: SparkSession, sf: str) -> DataFrame:
    s = sequences(spark, sf).groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("frame", "event_type"))).alias("e"))
    return s.select("clip", F.sha1(F.array_join(F.col("e.event_type"), ",")).alias("topology"))


_HEX = "('#' || lpad(lower(to_hex(o_orderkey * 7919 % 16777216)), 6, '0'))"


@query("c16_hex_color", f"WITH h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'bad' ELSE {_HEX} END AS t FROM orders) SELECT o_orderkey, CASE WHEN t = 'bad' THEN -1 ELSE CAST(('0x' || t[2:3]) AS BIGINT) END AS r, CASE WHEN t = 'bad' THEN -1 ELSE CAST(('0x' || t[4:5]) AS BIGINT) END AS g, CASE WHEN t = 'bad' THEN -1 ELSE CAST(('0x' || t[6:7]) AS BIGINT) END AS b, CASE WHEN t = 'bad' THEN NULL ELSE t END AS again FROM h")
def hex_color(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 10 == 0, F.lit("bad")).otherwise(F.concat(F.lit("#"), F.lpad(F.hex(F.col("o_orderkey") * 7919 % 16777216), 6, "0")))
    c = o.select("o_orderkey", E.hex_color(text).alias("c")).select("o_orderkey", "c.*")
    return c.withColumn("again", E.color_hex(F.col("r"), F.col("g"), F.col("b"))).select("o_orderkey", *(F.coalesce(x, F.lit(-1)).alias(x) for x in "rgb"), "again")


def _hsl_sql(r: str, g: str, b: str) -> str:
    return f"SELECT *, ({r})/255.0 AS rn, ({g})/255.0 AS gn, ({b})/255.0 AS bn"


_RGB = "rgb AS (SELECT vid, floor(abs(r)*300)::BIGINT % 256 AS r, floor(abs(g)*300)::BIGINT % 256 AS g, floor(abs(b)*300)::BIGINT % 256 AS b FROM pts)"
_HSL = (
    "n AS (SELECT vid, r, g, b, r/255.0 AS rn, g/255.0 AS gn, b/255.0 AS bn FROM rgb), mm AS (SELECT *, greatest(rn,gn,bn) AS hi, least(rn,gn,bn) AS lo FROM n),"
    " hsl AS (SELECT *, (hi+lo)/2.0 AS l, CASE WHEN hi=lo THEN 0.0 WHEN (hi+lo)/2.0 > 0.5 THEN (hi-lo)/(2.0-hi-lo) ELSE (hi-lo)/(hi+lo) END AS s,"
    " CASE WHEN hi=lo THEN 0.0 WHEN hi=rn THEN ((gn-bn)/(hi-lo) + CASE WHEN gn<bn THEN 6 ELSE 0 END)/6.0 WHEN hi=gn THEN ((bn-rn)/(hi-lo)+2)/6.0 ELSE ((rn-gn)/(hi-lo)+4)/6.0 END AS h FROM mm)"
)


def _rgb(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select("vid", *((F.floor(F.abs(c) * 300.0) % 256).alias(c) for c in "rgb"))


def _target() -> tuple[float, float]:
    """Hue and saturation of TARGET: red is its largest channel, and green isn't below blue."""
    r, g, b = (c / 255 for c in TARGET)
    light = (r + b) / 2
    return (g - b) / (r - b) / 6, (r - b) / (2 - r - b) if light > 0.5 else (r - b) / (r + b)


def _channel_sql(h: str, s: str, l: str, shift: float) -> str:  # noqa: E741
    q = f"(CASE WHEN {l} < 0.5 THEN {l}*(1+{s}) ELSE {l}+{s}-{l}*{s} END)"
    p = f"(2*{l}-{q})"
    t0 = f"({h} + {shift!r})"
    t = f"(CASE WHEN {t0} < 0 THEN {t0}+1 WHEN {t0} > 1 THEN {t0}-1 ELSE {t0} END)"
    return f"(CASE WHEN {s} = 0 THEN {l} WHEN {t} < {1 / 6!r} THEN {p}+({q}-{p})*6*{t} WHEN {t} < 0.5 THEN {q} WHEN {t} < {2 / 3!r} THEN {p}+({q}-{p})*({2 / 3!r}-{t})*6 ELSE {p} END)*255"


_TH, _TS = _target()
_TURNED = f"(h + (CASE WHEN {_TH!r}-h > 0.5 THEN {_TH!r}-h-1 WHEN {_TH!r}-h < -0.5 THEN {_TH!r}-h+1 ELSE {_TH!r}-h END)*0.6)"


@query("c17_recolor_tint", f"WITH {PTS}, {_RGB}, y AS (SELECT *, (0.299*r+0.587*g+0.114*b)/255.0 AS l FROM rgb) SELECT vid, " + ", ".join(f"{r6(f'{c} + ({_channel_sql(repr(_TH), repr(_TS), chr(108), s)} - {c})*0.6', 4)} AS {c}2" for c, s in zip("rgb", (1 / 3, 0.0, -1 / 3), strict=True)) + " FROM y")
def recolor_tint(spark: SparkSession, sf: str) -> DataFrame:
    new = G.recolor(tuple(F.col(c) for c in "rgb"), TARGET, 0.6, "tint")
    return _rgb(spark, sf).select("vid", *(E.rounded(v, 4).alias(c + "2") for c, v in zip("rgb", new, strict=True)))


@query("c17_recolor_hue", f"WITH {PTS}, {_RGB}, {_HSL}, tt AS (SELECT *, {_TURNED} - floor({_TURNED}) AS h2 FROM hsl) SELECT vid, " + ", ".join(f"{r6(_channel_sql('h2', 's', 'l', s), 4)} AS {c}2" for c, s in zip("rgb", (1 / 3, 0.0, -1 / 3), strict=True)) + " FROM tt")
def recolor_hue(spark: SparkSession, sf: str) -> DataFrame:
    new = G.recolor(tuple(F.col(c) for c in "rgb"), TARGET, 0.6, "hue")
    return _rgb(spark, sf).select("vid", *(E.rounded(v, 4).alias(c + "2") for c, v in zip("rgb", new, strict=True)))


@query("c18_smoothstep_weight", f"WITH {PTS} SELECT vid, CASE WHEN x <= 0 THEN 1.0 WHEN x >= 0.15 THEN 0.0 ELSE {r6('(1-x/0.15)*(1-x/0.15)*(3-2*(1-x/0.15))')} END AS w FROM pts")
def smoothstep_weight(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select("vid", *out(w=E.smoothstep_falloff(F.col("x"), 0.15)))


@query("c20_frame_clock", "SELECT event_id, floor(greatest(0, floor(value + 0.5)) * 1e6 / 29.97 * 1000 + 0.5) / 1000 AS us, CAST(floor(greatest(0, floor(value + 0.5)) * 1e6 / 29.97 / (1e6 / 29.97) + 1e-6) AS BIGINT) AS frame FROM events")
def frame_clock(spark: SparkSession, sf: str) -> DataFrame:
    us = E.frame_to_us(F.col("value"), 29.97)
    return table(spark, sf, "events").select("event_id", E.rounded(us, 3).alias("us"), E.us_to_frame(us, 29.97).alias("frame"))


for _mode, _past in (("loop", "10 + (((raw - 10) % 21) + 21) % 21"), ("pingpong", "10 + CASE WHEN (raw - 10) % 40 < 21 THEN (raw - 10) % 40 ELSE 40 - (raw - 10) % 40 END"), ("once", "30")):

    @query(f"c21_loop_frame_{_mode}", f"WITH e AS (SELECT event_id, event_id % 97 - 5 AS raw FROM events) SELECT event_id, CAST(CASE WHEN raw <= 30 THEN greatest(0, raw) ELSE {_past} END AS BIGINT) AS frame FROM e")
    def loop_frame(spark: SparkSession, sf: str, mode: str = _mode) -> DataFrame:
        return table(spark, sf, "events").select("event_id", E.loop_frame(F.col("event_id") % 97 - 5, 10, 30, mode).alias("frame"))


_M = G.basis(TURN, "z", 1.5)
_R = G.basis(TURN, "z")


@query("c22_affine", f"WITH {PTS} SELECT vid, {', '.join(r6(s) + f' AS t{c}' for c, s in zip(P, m3(_M, off=('0.1', '-0.2', '0.3')), strict=True))} FROM pts")
def affine(spark: SparkSession, sf: str) -> DataFrame:
    t = G.affine(_M, (0.1, -0.2, 0.3), xyz())
    return points(spark, sf).select("vid", *out(**{"t" + c: v for c, v in zip(P, t, strict=True)}))


@query("c23_transform_normals", f"WITH {PTS}, e AS (SELECT vid, {', '.join(s + f' AS t{c}' for c, s in zip(P, m3(_R), strict=True))} FROM pts) SELECT vid, {', '.join(r6(f't{c} / (CASE WHEN sqrt(tx*tx+ty*ty+tz*tz) = 0 THEN 1 ELSE sqrt(tx*tx+ty*ty+tz*tz) END)') + f' AS n{c}' for c in P)} FROM e")
def transform_normals(spark: SparkSession, sf: str) -> DataFrame:
    n = G.normalized(G.affine(_R, (0.0, 0.0, 0.0), xyz()))
    return points(spark, sf).select("vid", *out(**{"n" + c: v for c, v in zip(P, n, strict=True)}))


def _mul_sql(a: list[str], b: list[str]) -> list[str]:
    ax, ay, az, aw = (f"({v})" for v in a)
    bx, by, bz, bw = (f"({v})" for v in b)
    return [f"{aw}*{bx}+{ax}*{bw}+{ay}*{bz}-{az}*{by}", f"{aw}*{by}-{ax}*{bz}+{ay}*{bw}+{az}*{bx}", f"{aw}*{bz}+{ax}*{by}-{ay}*{bx}+{az}*{bw}", f"{aw}*{bw}-{ax}*{bx}-{ay}*{by}-{az}*{bz}"]


_QR = G.quaternion_of(_M)
_QS = ["q0", "q1", "q2", "q3"]


@query("c24_quaternion_product", f"WITH {PTS} SELECT vid, {', '.join(r6(s) + f' AS p{i}' for i, s in enumerate(_mul_sql(_QS, ['q3', 'q0', 'q1', 'q2'])))} FROM pts")
def quaternion_product(spark: SparkSession, sf: str) -> DataFrame:
    q = [F.col(c) for c in _QS]
    return points(spark, sf).select("vid", *out(**{f"p{i}": v for i, v in enumerate(G.quaternion_product(q, [q[3], q[0], q[1], q[2]]))}))


@query("c25_transform_splats", f"WITH {PTS} SELECT vid, {', '.join(r6(s) + f' AS t{c}' for c, s in zip(P, m3(_M, off=('0.1', '-0.2', '0.3')), strict=True))}, {', '.join(r6(s) + f' AS p{i}' for i, s in enumerate(_mul_sql([repr(v) for v in _QR], _QS)))}, {', '.join(r6(f's{i} * 1.5') + f' AS k{i}' for i in range(3))} FROM pts")
def transform_splats(spark: SparkSession, sf: str) -> DataFrame:
    """Positions by the matrix, rotations multiplied from the left by its own, scales by its mean axis."""
    t = G.affine(_M, (0.1, -0.2, 0.3), xyz())
    q = G.quaternion_product([float(v) for v in _QR], [F.col(c) for c in _QS])
    scale = sum((_M[j] ** 2 + _M[3 + j] ** 2 + _M[6 + j] ** 2) ** 0.5 for j in range(3)) / 3
    return points(spark, sf).select(
        "vid", *out(**{"t" + c: v for c, v in zip(P, t, strict=True)}, **{f"p{i}": v for i, v in enumerate(q)}, **{f"k{i}": F.col(f"s{i}") * scale for i in range(3)})
    )


def _row(i: int) -> str:
    return f"({CAMERA[4 * i]})*x + ({CAMERA[4 * i + 1]})*y + ({CAMERA[4 * i + 2]})*z + ({CAMERA[4 * i + 3]})"


@query("c27_project_point", f"WITH {PTS}, e AS (SELECT vid, {_row(0)} AS cx, {_row(1)} AS cy, {_row(2)} AS cz, {_row(3)} AS w FROM pts) SELECT vid, w > 1e-6 AS in_front, CASE WHEN w > 1e-6 THEN {r6('(cx/w*0.5+0.5)*640')} END AS px, CASE WHEN w > 1e-6 THEN {r6('(0.5-cy/w*0.5)*360')} END AS py, CASE WHEN w > 1e-6 THEN {r6('cz/w')} END AS depth FROM e")
def project_point(spark: SparkSession, sf: str) -> DataFrame:
    px, py, depth, ok = G.project(xyz(), CAMERA, 640, 360)
    return points(spark, sf).select("vid", ok.alias("in_front"), *out(px=px, py=py, depth=depth))


@query("c28_grid_depth", f"WITH {PTS}, e AS (SELECT vid, CASE WHEN vid % 7 = 0 THEN 'nan'::DOUBLE ELSE abs(x) END AS d FROM pts) SELECT vid, {r6('1/((CASE WHEN isnan(d) THEN 0 ELSE d END)/0.5+(1-(CASE WHEN isnan(d) THEN 0 ELSE d END))/6.0)')} AS z, {r6('least(greatest(CASE WHEN isnan(d) THEN 6.0 ELSE d*10 END, 0.5), 6.0)')} AS zm FROM e")
def grid_depth(spark: SparkSession, sf: str) -> DataFrame:
    d = F.when(F.col("vid") % 7 == 0, F.lit(float("nan"))).otherwise(F.abs("x"))
    return points(spark, sf).select("vid", *out(z=G.grid_depth(d, 0.5, 6.0, False), zm=G.grid_depth(d * 10.0, 0.5, 6.0, True)))


@query("c29_unproject", f"WITH {PTS}, e AS (SELECT vid, vid % 32 AS u, CAST(floor(vid / 32) AS BIGINT) % 18 AS v, 1/(abs(x)/0.5+(1-abs(x))/6.0) AS d FROM pts) SELECT vid, {r6('(u+0.5-16)/28.0*d')} AS wx, {r6('-((v+0.5-9)/28.0)*d')} AS wy, {r6('-d')} AS wz FROM e")
def unproject(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels of a 32 x 18 lattice to camera space, y up and the camera looking along -z."""
    u, v = F.col("vid") % 32, F.floor(F.col("vid") / 32) % 18
    d = G.grid_depth(F.abs("x"), 0.5, 6.0, False)
    return points(spark, sf).select("vid", *out(wx=(u + 0.5 - 16.0) / 28.0 * d, wy=-((v + 0.5 - 9.0) / 28.0) * d, wz=-d))


@query("c30_intrinsics", f"WITH {PTS}, k AS (SELECT vid, 0.8+abs(x) AS fx, 1.4+abs(y) AS fy, CASE WHEN vid % 5 = 0 THEN 'nan'::DOUBLE ELSE 1.4+abs(z) END AS own FROM pts) SELECT vid, {r6('fx*1280')} AS fx, {r6('fy*720')} AS fy, {r6('0.5*1280 - 40')} AS cx, {r6('0.5*720 - 20')} AS cy, {r6('fx*1280*256/1200')} AS gfx, {r6('fy*720*144/680')} AS gfy, {r6('2*atan(680/2.0/(fy*720))*180/pi()')} AS fov_y, {r6('CASE WHEN isnan(own) OR own <= 0 OR abs(1.65/own-1) <= 1e-6 THEN 1.0 ELSE 1.65/own END')} AS focal_scale FROM k")
def intrinsics(spark: SparkSession, sf: str) -> DataFrame:
    """A normalised camera cropped to 1200 x 680 of 1280 x 720, laid over a 256 x 144 grid, and each frame's focal factor."""
    k = points(spark, sf).select("vid", (0.8 + F.abs("x")).alias("fx"), (1.4 + F.abs("y")).alias("fy"), F.when(F.col("vid") % 5 == 0, F.lit(float("nan"))).otherwise(1.4 + F.abs("z")).alias("own"))
    fx, fy, ratio = F.col("fx") * 1280.0, F.col("fy") * 720.0, 1.65 / F.col("own")
    return k.select(
        "vid",
        *out(
            fx=fx, fy=fy, cx=F.lit(0.5 * 1280 - 40), cy=F.lit(0.5 * 720 - 20), gfx=fx * 256.0 / 1200.0, gfy=fy * 144.0 / 680.0,
            fov_y=E.degrees(2.0 * F.atan(340.0 / fy)),
            focal_scale=F.when(F.isnan("own") | (F.col("own") <= 0) | (F.abs(ratio - 1.0) <= 1e-6), F.lit(1.0)).otherwise(ratio),
        ),
    )


@query("c31_runtime_space", f"WITH {PTS} SELECT vid, x, -y AS y, -z AS z FROM pts")
def runtime_space(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select("vid", "x", (-F.col("y")).alias("y"), (-F.col("z")).alias("z"))


@query("c33_normal_gradients", f"WITH {PTS}, e AS (SELECT vid, vid % 32 AS u, CAST(floor(vid/32) AS BIGINT) % 18 AS v, floor(x*400)/127.0 AS a, floor(y*400)/127.0 AS b, floor(z*400)/127.0 AS c FROM pts), n AS (SELECT *, sqrt(a*a+b*b+c*c) AS l FROM e), d AS (SELECT *, CASE WHEN l=0 THEN 0 ELSE a/l END AS nx, CASE WHEN l=0 THEN 0 ELSE b/l END AS ny, CASE WHEN l=0 THEN 0 ELSE c/l END AS nz FROM n), k AS (SELECT *, nx*(u+0.5-16)/28.0+ny*(v+0.5-9)/28.0+nz AS dd FROM d) SELECT vid, l >= 0.2 AND abs(dd) >= 0.15 AS ok, CASE WHEN l >= 0.2 AND abs(dd) >= 0.15 THEN {r6('-(nx/28.0)/dd')} ELSE 0.0 END AS gu, CASE WHEN l >= 0.2 AND abs(dd) >= 0.15 THEN {r6('-(ny/28.0)/dd')} ELSE 0.0 END AS gv FROM k")
def normal_gradients(spark: SparkSession, sf: str) -> DataFrame:
    n = tuple(F.floor(F.col(c) * 400.0).cast("double") for c in P)
    gu, gv, ok = G.normal_gradient(n, F.col("vid") % 32, F.floor(F.col("vid") / 32) % 18, 28.0, 28.0, 16.0, 9.0)
    return points(spark, sf).select("vid", ok.alias("ok"), *out(gu=gu, gv=gv))


@query("c35_rescale_points", f"WITH {PTS} SELECT vid, {r6('x*640/1920.0')} AS px, {r6('y*360/1080.0')} AS py FROM pts")
def rescale_points(spark: SparkSession, sf: str) -> DataFrame:
    pair = F.transform(F.array(F.struct(F.col("x"), F.col("y"))), lambda p: F.struct((p["x"] * 640.0 / 1920.0).alias("px"), (p["y"] * 360.0 / 1080.0).alias("py")))
    return points(spark, sf).select("vid", F.explode(pair).alias("p")).select("vid", *out(px=F.col("p.px"), py=F.col("p.py")))
