"""Geometry of points, frames and cameras as Column expressions; small matrices are worked out on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from math import cos, radians, sin, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]
#: What turns each up axis into +y, row by row; all are proper rotations.
UP_AXES = {
    "y": (1, 0, 0, 0, 1, 0, 0, 0, 1),
    "z": (1, 0, 0, 0, 0, 1, 0, -1, 0),
}


def product(a: Sequence[float], b: Sequence[float]) -> list[float]:
    """Of two 3 x 3 matrices, row by row."""
    return [sum(a[3 * i + k] * b[3 * k + j] for k in range(3)) for i in range(3) for j in range(3)]


def basis(rotate: Sequence[float] = (0, 0, 0), up_axis: str = "y", scale: float = 1.0) -> list[float]:
    """Up axis first, then rotations about x, y and z in degrees, then the scale."""
    (cx, sx), (cy, sy), (cz, sz) = ((cos(radians(d)), sin(radians(d))) for d in rotate)
    x = (1, 0, 0, 0, cx, -sx, 0, sx, cx)
    y = (cy, 0, sy, 0, 1, 0, -sy, 0, cy)
    z = (cz, -sz, 0, sz, cz, 0, 0, 0, 1)
    return [v * scale for v in product(product(z, product(y, x)), UP_AXES[up_axis])]


def affine(m: Sequence[float], offset: Sequence[Column | float], p: Vector) -> Vector:
    return tuple(m[3 * i] * p[0] + m[3 * i + 1] * p[1] + m[3 * i + 2] * p[2] + offset[i] for i in range(3))


def length(p: Sequence[Column]) -> Column:
    return F.sqrt(sum((c * c for c in p[1:]), p[0] * p[0]))


def normalized(p: Sequence[Column]) -> tuple[Column, ...]:
    n = length(p)
    n = F.when(n == 0, F.lit(1.0)).otherwise(n)
    return tuple(c / n for c in p)


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def quaternion_product(a: Sequence, b: Sequence) -> tuple:
    """Hamilton product a b of x, y, z, w quaternions."""
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return (aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz)


def quaternion_of(m: Sequence[float]) -> tuple[float, float, float, float]:
    """x, y, z, w of a rotation times a uniform scale, row by row; built on its largest component."""
    s = [sqrt(m[j] ** 2 + m[3 + j] ** 2 + m[6 + j] ** 2) or 1.0 for j in range(3)]
    r = [[m[3 * i + j] / s[j] for j in range(3)] for i in range(3)]
    squares = [1 + r[0][0] - r[1][1] - r[2][2], 1 - r[0][0] + r[1][1] - r[2][2], 1 - r[0][0] - r[1][1] + r[2][2], 1 + r[0][0] + r[1][1] + r[2][2]]
    k = max(range(4), key=squares.__getitem__)
    n = 2 * sqrt(squares[k])
    if k == 3:
        q = ((r[2][1] - r[1][2]) / n, (r[0][2] - r[2][0]) / n, (r[1][0] - r[0][1]) / n, n / 4)
    else:
        i, j = (k + 1) % 3, (k + 2) % 3
        parts = {k: n / 4, i: (r[i][k] + r[k][i]) / n, j: (r[j][k] + r[k][j]) / n, 3: (r[j][i] - r[i][j]) / n}
        q = tuple(parts[x] for x in range(4))
    size = sqrt(sum(c * c for c in q)) or 1.0
    return tuple(c / size for c in q)


def box_distance(p: Vector, low: Sequence[Column | float], high: Sequence[Column | float]) -> Column:
    """Negative inside the box."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.greatest(*(F.greatest(lit(a) - c, c - lit(b)) for c, a, b in zip(p, low, high, strict=True)))


def project(p: Vector, m: Sequence[float], width: int, height: int) -> tuple[Column, Column, Column, Column]:
    """(pixel x, pixel y, depth, in front) by a row-by-row 4 x 4 matrix; points at w <= 1e-6 aren't in front."""
    row = lambda i: m[4 * i] * p[0] + m[4 * i + 1] * p[1] + m[4 * i + 2] * p[2] + m[4 * i + 3]
    w = row(3)
    ok = w > 1e-6
    inverse = F.when(ok, 1.0 / w)
    return (row(0) * inverse * 0.5 + 0.5) * width, (0.5 - row(1) * inverse * 0.5) * height, row(2) * inverse, ok


def rgb_hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation and lightness, 0 to 1, of bytes."""
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d, light = top - low, (top + low) / 2.0
    flat = top == low
    saturation = F.when(flat, F.lit(0.0)).when(light > 0.5, d / (2.0 - top - low)).otherwise(d / (top + low))
    turn = F.when(top == r, (g - b) / d + F.when(g < b, F.lit(6.0)).otherwise(F.lit(0.0))).when(top == g, (b - r) / d + 2.0).otherwise((r - g) / d + 4.0)
    return F.when(flat, F.lit(0.0)).otherwise(turn / 6.0), saturation, light


def hsl_rgb(h: Column, s: Column, light: Column) -> tuple[Column, Column, Column]:
    q = F.when(light < 0.5, light * (1.0 + s)).otherwise(light + s - light * s)
    p = 2.0 * light - q

    def channel(shift: float) -> Column:
        t = h + shift
        t = F.when(t < 0, t + 1.0).when(t > 1, t - 1.0).otherwise(t)
        ramp = F.when(t < 1 / 6, p + (q - p) * 6.0 * t).when(t < 0.5, q).when(t < 2 / 3, p + (q - p) * (2 / 3 - t) * 6.0).otherwise(p)
        return F.when(s == 0, light).otherwise(ramp) * 255.0

    return channel(1 / 3), channel(0.0), channel(-1 / 3)


def recolor(rgb: Vector, target: tuple[int, int, int], strength: float, mode: str) -> Vector:
    """Tint keeps each pixel's own luma under the target's hue and saturation; hue turns its hue the short way."""
    th, ts, _ = rgb_hsl(*(F.lit(float(c)) for c in target))
    if mode == "hue":
        h, s, light = rgb_hsl(*rgb)
        d = th - h
        d = F.when(d > 0.5, d - 1.0).when(d < -0.5, d + 1.0).otherwise(d)
        turned = h + d * strength
        return hsl_rgb(turned - F.floor(turned), s, light)
    luma = (0.299 * rgb[0] + 0.587 * rgb[1] + 0.114 * rgb[2]) / 255.0
    return tuple(c + (t - c) * strength for c, t in zip(rgb, hsl_rgb(th, ts, luma), strict=True))


def grid_depth(d: Column, near: float, far: float, metric: bool) -> Column:
    """Depth of a disparity, or of a distance clamped to the range; not a number counts as far."""
    bad = d.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))
    if metric:
        return F.least(F.greatest(F.when(bad, F.lit(far)).otherwise(d), F.lit(near)), F.lit(far))
    v = F.when(bad, F.lit(0.0)).otherwise(d)
    return 1.0 / (v / near + (1.0 - v) / far)


def normal_gradient(n: Vector, u: Column, v: Column, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column, Column]:
    """(d ln z / du, d ln z / dv, valid) of a surface with byte normal n at pixel (u, v)."""
    raw = tuple(c / 127.0 for c in n)
    size = length(raw)
    nx, ny, nz = normalized(raw)
    d = nx * (u + 0.5 - cx) / fx + ny * (v + 0.5 - cy) / fy + nz
    ok = (size >= 0.2) & (F.abs(d) >= 0.15)
    return F.when(ok, -(nx / fx) / d).otherwise(F.lit(0.0)), F.when(ok, -(ny / fy) / d).otherwise(F.lit(0.0)), ok


def value_noise(x: Column, y: Column, z: Column) -> Column:
    """Smooth noise between 0 and 1 from hashed sines at the eight corners of a unit cell."""
    cell = [F.floor(c) for c in (x, y, z)]
    part = [c - i for c, i in zip((x, y, z), cell, strict=True)]
    u, v, w = (p * p * (3 - 2 * p) for p in part)

    def corner(i: int, j: int, k: int) -> Column:
        s = F.sin((cell[0] + i) * 12.9898 + (cell[1] + j) * 78.233 + (cell[2] + k) * 37.719) * 43758.5453
        return s - F.floor(s)

    def between(a: Column, b: Column, t: Column) -> Column:
        return a + (b - a) * t

    front, back = (between(between(corner(0, 0, k), corner(1, 0, k), u), between(corner(0, 1, k), corner(1, 1, k), u), v) for k in (0, 1))
    return between(front, back, w)


def grow_interval(low: Column, high: Column, by: float) -> tuple[Column, Column]:
    """An interval with both ends moved outward, or inward as far as its middle."""
    middle = (low + high) / 2
    return F.least(middle, low - by), F.greatest(middle, high + by)


def mirror_interval(low: Column, high: Column, at: float) -> tuple[Column, Column]:
    return 2 * at - high, 2 * at - low
