"""Camera matrices and masks drawn through a camera, over the supplied points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cameras as C
from ..functions.encodings import rounded
from .common import PTS, out, points, query, r6
from .scalars import P

# Sample cameras, and a disc as a sample bitmap.
_VIEW, _PROJECTION = C.orbit(0.6, 0.35, 0.9, (0.02, -0.01, 0.0), 16 / 9)
_CLIP = _PROJECTION @ _VIEW
_BACK = C.inverse(_CLIP)
_ORTHO_VIEW, _ORTHO_PROJECTION = C.orbit(-0.4, 0.2, 0.5, (0.0, 0.0, 0.0), 1.5, ortho=True, fov=30.0)
_ORTHO = _ORTHO_PROJECTION @ _ORTHO_VIEW
_RECT, _BAND = (-0.3, -0.2, 0.25, 0.4), (0.988, 0.9925)
_BITS = np.fromfunction(lambda r, c: (c - 8) ** 2 + (r - 5) ** 2 <= 14, (12, 18))


def _rows(m: np.ndarray, p: tuple[str, ...] = P, w: str = "1.0") -> list[str]:
    return [f"(({float(r[0])!r})*{p[0]} + ({float(r[1])!r})*{p[1]} + ({float(r[2])!r})*{p[2]} + ({float(r[3])!r})*{w})" for r in m]


def _seen(m: np.ndarray) -> str:
    x, y, z, w = _rows(m)
    return f"c AS (SELECT vid, {x} / nullif({w}, 0) AS nx, {y} / nullif({w}, 0) AS ny, {z} / nullif({w}, 0) AS nz, {w} AS w FROM pts)"


_AGAIN = _rows(_BACK, ("nx", "ny", "nz"))


@query("c26_camera_matrices", f"WITH {PTS}, {_seen(_CLIP)} SELECT vid, {r6('nx')} AS nx, {r6('ny')} AS ny, {r6('nz')} AS nz, " + ", ".join(f"{r6(f'{_AGAIN[k]} / nullif({_AGAIN[3]}, 0)', 4)} AS b{c}" for k, c in enumerate(P)) + " FROM c")
def camera_matrices(spark: SparkSession, sf: str) -> DataFrame:
    """Points in a perspective camera's picture, and back in the world by the inverse."""
    x, y, z, w = C.transformed(_CLIP, [F.col(c) for c in P])
    nx, ny, nz = C.projected((x, y, z), w)
    seen = points(spark, sf).select("vid", nx.alias("nx"), ny.alias("ny"), nz.alias("nz"))
    *again, scale = C.transformed(_BACK, [F.col(c) for c in ("nx", "ny", "nz")])
    return seen.select("vid", *out(nx=F.col("nx"), ny=F.col("ny"), nz=F.col("nz")), *(rounded(b, 4).alias("b" + c) for b, c in zip(C.projected(again, scale), P, strict=True)))


_INSIDE = f"greatest({_RECT[0]} - nx, nx - {_RECT[2]}, {_RECT[1]} - ny, ny - {_RECT[3]})"


@query("d05_mask_rectangle", f"WITH {PTS}, {_seen(_CLIP)} SELECT vid, {r6(f'CASE WHEN w > 1e-6 AND nz >= {_BAND[0]} AND nz <= {_BAND[1]} THEN {_INSIDE} ELSE 1.0 END')} AS d FROM c")
def mask_rectangle(spark: SparkSession, sf: str) -> DataFrame:
    """A rectangle drawn in perspective, in a band of depths."""
    return points(spark, sf).select("vid", *out(d=C.mask_distance([F.col(c) for c in P], _CLIP, rect=_RECT, band=_BAND)))


_TEXT = "".join("1" if b else "0" for b in _BITS.ravel())
_AT = "SELECT *, CAST(floor((nx + 1) / 2 * 18) AS BIGINT) AS px, CAST(floor((1 - ny) / 2 * 12) AS BIGINT) AS py FROM c"


@query("d05_mask_bitmap", f"WITH {PTS}, {_seen(_ORTHO)}, a AS ({_AT}) SELECT vid, CASE WHEN NOT (w > 1e-6 AND nz >= 0 AND nz <= 1) OR px < 0 OR py < 0 OR px >= 18 OR py >= 12 THEN 1.0 WHEN substr('{_TEXT}', py * 18 + px + 1, 1) = '1' THEN -0.5 ELSE 0.5 END::DOUBLE AS d FROM a")
def mask_bitmap(spark: SparkSession, sf: str) -> DataFrame:
    """A bitmap drawn without perspective."""
    return points(spark, sf).select("vid", C.mask_distance([F.col(c) for c in P], _ORTHO, ortho=True, bits=_BITS).alias("d"))
