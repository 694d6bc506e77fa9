"""Order-dependent algorithms as small kernels."""

from __future__ import annotations

import numpy as np


def first_fit(sizes: list[tuple[int, int]], width: int, height: int, stride: int = 1) -> list[tuple[int, int] | None]:
    """Places of rectangles in a sheet, each at the first free spot row by row, or None."""
    used = np.zeros((height, width), bool)
    out: list[tuple[int, int] | None] = []
    for w, h in sizes:
        spot = next(((x, y) for y in range(0, height - h + 1, stride) for x in range(0, width - w + 1, stride) if not used[y : y + h, x : x + w].any()), None)
        if spot:
            used[spot[1] : spot[1] + h, spot[0] : spot[0] + w] = True
        out.append(spot)
    return out
