"""Plain loops over one frame or clip that operators are held against."""

from __future__ import annotations

import numpy as np


def greedy_matches(prior: np.ndarray, now: np.ndarray, radius: float) -> np.ndarray:
    """For each new point in order, the nearest unclaimed old one within the radius, or -1; a grid finds candidates."""
    cell = max(radius, 1e-12)
    grid: dict[tuple[int, ...], list[int]] = {}
    for i, k in enumerate(map(tuple, np.floor(prior / cell).astype(int))):
        grid.setdefault(k, []).append(i)
    free = np.ones(len(prior), bool)
    out = np.full(len(now), -1)
    for i, (p, k) in enumerate(zip(now, np.floor(now / cell).astype(int), strict=True)):
        near = [j for d in np.ndindex(3, 3, 3) for j in grid.get(tuple(k + d - 1), ()) if free[j]]
        if near:
            gap = ((prior[near] - p) ** 2).sum(1)
            best = int(gap.argmin())
            if gap[best] <= radius * radius:
                out[i] = near[best]
                free[near[best]] = False
    return out


def loops(edges: list[tuple[int, int]]) -> list[list[int]]:
    """Simple cycles of an undirected graph's degree-two parts; parts with a junction or an end are left out."""
    near: dict[int, list[int]] = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    seen: set[int] = set()
    out = []
    for start in sorted(near):
        if start in seen:
            continue
        part, queue = {start}, [start]
        while queue:
            for w in near[queue.pop()]:
                if w not in part:
                    part.add(w)
                    queue.append(w)
        seen |= part
        if any(len(near[v]) != 2 for v in part):
            continue
        walk, last = [start], None
        while True:
            step = next((w for w in near[walk[-1]] if w != last), None)
            if step is None or step == start:
                break
            last = walk[-1]
            walk.append(step)
        out.append(walk)
    return out


def pieces(n: int, triangles: np.ndarray) -> np.ndarray:
    """The smallest vertex of each vertex's connected piece."""
    label = np.arange(n)
    while True:
        low = label[triangles].min(1)
        new = label.copy()
        for k in range(3):
            np.minimum.at(new, triangles[:, k], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def taubin(p: np.ndarray, edges: np.ndarray, rounds: int, shrink: float = 0.5, grow: float = -0.53) -> np.ndarray:
    """Smoothing that alternates steps to and from the neighbours' mean; edges as pairs, each once."""
    a, b = np.concatenate([edges, edges[:, ::-1]]).T
    degree = np.bincount(a, minlength=len(p))[:, None]
    for _ in range(rounds):
        for factor in (shrink, grow):
            total = np.zeros_like(p)
            np.add.at(total, a, p[b])
            p = np.where(degree > 0, p + factor * (total / np.maximum(degree, 1) - p), p)
    return p


def adaptive_cuts(error: np.ndarray, limit: float, least: int, most: int) -> np.ndarray:
    """Run number of each frame: a run ends before a frame above the limit, if it has its least length, or at most."""
    run, length, out = 0, 0, np.zeros(len(error), int)
    for t, e in enumerate(error):
        if length and (length >= most or (e > limit and length >= least)):
            run, length = run + 1, 0
        out[t] = run
        length += 1
    return out


def align_chain(x: np.ndarray) -> np.ndarray:
    """Rows, each scaled and shifted to the mean and spread of the aligned row before; scales stay in 0.5 to 2."""
    out = x.astype(float).copy()
    for t in range(1, len(out)):
        spread = out[t].std()
        a = min(2.0, max(0.5, out[t - 1].std() / spread)) if spread else 1.0
        out[t] = a * out[t] + out[t - 1].mean() - a * out[t].mean()
    return out
