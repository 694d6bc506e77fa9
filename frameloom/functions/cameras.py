"""Orbit cameras as small matrices on the driver, and what points see through them as Columns.

Matrices are row by row and act on columns; clip depth is 0 at the near plane and 1 at the far one.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import cos, radians, sin, tan

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def perspective(fov: float, aspect: float, near: float, far: float) -> np.ndarray:
    """fov: the vertical field of view in radians."""
    zoom = 1 / tan(fov / 2)
    m = np.diag([zoom / aspect, zoom, far / (near - far), 0.0])
    m[2, 3], m[3, 2] = far * near / (near - far), -1.0
    return m


def orthographic(height: float, aspect: float, near: float, far: float) -> np.ndarray:
    m = np.diag([2 / (height * aspect), 2 / height, 1 / (near - far), 1.0])
    m[2, 3] = near / (near - far)
    return m


def look_at(eye: Sequence[float], target: Sequence[float], up: Sequence[float] = (0, 1, 0)) -> np.ndarray:
    """World to camera space; the camera looks along its own -z."""
    unit = lambda v: v / (np.linalg.norm(v) or 1.0)
    eye = np.array(eye, float)
    back = unit(eye - np.array(target, float))
    right = unit(np.cross(np.array(up, float), back))
    axes = np.stack([right, np.cross(back, right), back])
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = axes, -axes @ eye
    return m


def orbit(azimuth: float, elevation: float, distance: float, target: Sequence[float], aspect: float, ortho: bool = False, fov: float = 50.0) -> tuple[np.ndarray, np.ndarray]:
    """(view, projection) of a camera on a sphere around the target; fov in degrees, planes at a hundredth and twenty times the distance."""
    offset = np.array([cos(elevation) * sin(azimuth), sin(elevation), cos(elevation) * cos(azimuth)])
    view = look_at(np.array(target, float) + distance * offset, target)
    near, far = distance * 0.01, distance * 20
    # Both projections show the same height at the target.
    return view, orthographic(2 * distance * tan(radians(fov) / 2), aspect, near, far) if ortho else perspective(radians(fov), aspect, near, far)


def inverse(m: np.ndarray) -> np.ndarray | None:
    """None of a singular matrix."""
    return np.linalg.inv(m) if np.linalg.det(m) else None


def transformed(m: np.ndarray, p: Sequence[Column], w: Column | float = 1.0) -> list[Column]:
    """The four rows of a matrix times (p, w)."""
    w = F.lit(w) if isinstance(w, float) else w
    return [float(r[0]) * p[0] + float(r[1]) * p[1] + float(r[2]) * p[2] + float(r[3]) * w for r in m]


def projected(p: Sequence[Column], w: Column) -> list[Column]:
    """p divided by w; null in the camera's plane, where w is 0."""
    scale = F.nullif(w, F.lit(0.0))
    return [c / scale for c in p]


def mask_distance(
    p: Sequence[Column], m: np.ndarray, ortho: bool = False, rect: Sequence[float] | None = None, bits: np.ndarray | None = None, band: tuple[float, float] | None = None
) -> Column:
    """Distance to what a mask drawn through a camera covers, in the picture's units from -1 to 1; negative inside.

    rect: least x and y, most x and y; bits: a bitmap over the whole picture, of rows from the top, which tells in (-0.5) from out (0.5) only.
    Points behind the camera, outside the depths of ``band`` or, without perspective, of the planes are at 1, as are those beside a bitmap.
    """
    x, y, z, w = transformed(m, p)
    # A point in the camera's plane has no picture; it isn't seen.
    x, y, z = projected((x, y, z), w)
    if bits is None:
        inside = F.greatest(rect[0] - x, x - rect[2], rect[1] - y, y - rect[3])
    else:
        height, width = bits.shape
        px, py = F.floor((x + 1) / 2 * width), F.floor((1 - y) / 2 * height)
        on = F.substring(F.lit(bits.astype(np.uint8).tobytes()), (py * width + px + 1).cast("int"), F.lit(1)) == F.lit(b"\x01")
        inside = F.when((px >= 0) & (py >= 0) & (px < width) & (py < height), F.when(on, -0.5).otherwise(0.5)).otherwise(1.0)
    seen = w > 1e-6
    if ortho:
        seen &= (z >= 0) & (z <= 1)
    if band:
        seen &= (z >= band[0]) & (z <= band[1])
    return F.when(seen, inside).otherwise(1.0)
