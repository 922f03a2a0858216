"""The search of ``fit`` in numpy, for documents that one task holds: draws judged in their order, lattices around the best
of them, and residuals of the last model. Scores are those of ``fit.scored`` over the same points and segments, no point or
hypothesis left out; what is skipped is segments that bounds show not to be the nearest."""

from __future__ import annotations

import numpy as np

#: Points, or pairs of a point and a segment, that are worked on at once.
POINTS, PAIRS = 4096, 256
#: A slack for rounding in bounds, as a share of the distances compared.
SLACK = 1e-9


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the whole numbers lo to hi: the row's place, and the number."""
    n = np.maximum(hi - lo + 1, 0)
    k = np.repeat(np.arange(len(n)), n)
    return k, lo[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)


class Target:
    """Segments (rows x1, y1, x2, y2) by the cells of ``size`` that have a point within ``margin`` of them."""

    def __init__(self, segs: np.ndarray, size: float, margin: float) -> None:
        x1, y1, x2, y2 = segs.T
        self.x, self.y, self.size, self.margin = x1, y1, size, margin
        self.length = np.hypot(x2 - x1, y2 - y1)
        of = np.where(self.length > 0, self.length, 1.0)
        self.ux, self.uy = np.where(self.length > 0, (x2 - x1) / of, 1.0), np.where(self.length > 0, (y2 - y1) / of, 0.0)
        lo, hi, eps = np.minimum(x1, x2), np.maximum(x1, x2), 1e-6 * size
        cell = lambda v: np.floor(v / size).astype(np.int64)
        # As in ``spatial.covered_cells``: in each column of cells the rows that the part of the segment above it reaches.
        k, gx = _spread(cell(lo - margin - eps), cell(hi + margin + eps))
        left, right = np.maximum(lo[k], gx * size - margin - eps), np.minimum(hi[k], (gx + 1) * size + margin + eps)
        flat = (x1[k] == x2[k]) | (left > right)
        slope = (y2 - y1)[k] / np.where(x1[k] == x2[k], 1.0, (x2 - x1)[k])
        a, b = y1[k] + (left - x1[k]) * slope, y1[k] + (right - x1[k]) * slope
        low, high = np.minimum(y1, y2)[k], np.maximum(y1, y2)[k]
        below, above = np.where(flat, low, np.maximum(np.minimum(a, b), low)), np.where(flat, high, np.minimum(np.maximum(a, b), high))
        j, gy = _spread(cell(below - margin - eps), cell(above + margin + eps))
        self.x0, self.y0 = (gx.min(), gy.min()) if len(gy) else (0, 0)
        self.rows = (gy.max() - self.y0 + 1) if len(gy) else 1
        self.columns = (gx.max() - self.x0 + 1) if len(gy) else 0
        key = (gx[j] - self.x0) * self.rows + gy - self.y0
        # Short numbers are sorted by their digits, in a tenth of the time.
        order = np.argsort(key.astype(np.uint16) if self.columns * self.rows <= 1 << 16 else key, kind="stable")
        self.cells, at = np.unique(key[order], return_index=True)
        self.starts, self.member = np.append(at, len(key)), k[j][order]

    def pairs(self, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of points, in their order, and of the segments of their cells."""
        gx, gy = np.floor(px / self.size) - self.x0, np.floor(py / self.size) - self.y0
        inside = (gx >= 0) & (gx < self.columns) & (gy >= 0) & (gy < self.rows)
        if not len(self.cells):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = np.where(inside, np.where(inside, gx, 0) * self.rows + np.where(inside, gy, 0), -1).astype(np.int64)
        at = np.minimum(np.searchsorted(self.cells, key), len(self.cells) - 1)
        found = self.cells[at] == key
        k, j = _spread(self.starts[at], np.where(found, self.starts[at + 1], self.starts[at]) - 1)
        return k, self.member[j]

    def squares(self, px: np.ndarray, py: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Squared distances of points from the segments ``s``."""
        dx, dy, ux, uy = px - self.x[s], py - self.y[s], self.ux[s], self.uy[s]
        along, across = dx * ux + dy * uy, dx * uy - dy * ux
        along -= np.minimum(np.maximum(along, 0.0), self.length[s])
        return along * along + across * across

    def nearest(self, px: np.ndarray, py: np.ndarray, hard: float) -> np.ndarray:
        """The distance of the nearest segment, at most ``hard``."""
        d = np.full(len(px), hard * hard)
        for a in range(0, len(px), POINTS):
            x, y = px[a : a + POINTS], py[a : a + POINTS]
            k, s = self.pairs(x, y)
            if len(k):
                first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
                here = d[a : a + POINTS]
                here[k[first]] = np.minimum(here[k[first]], np.minimum.reduceat(self.squares(x[k], y[k], s), first))
        return np.minimum(np.sqrt(d), hard)


def _closeness(square: np.ndarray, sigma: float, hard: float) -> np.ndarray:
    return np.where(square < hard * hard, np.exp(-square / (2 * sigma * sigma)), 0.0)


def judged(t: Target, points: np.ndarray, hyps: list[tuple[float, ...]], patience: int, sigma: float, hard: float) -> tuple[float, ...]:
    """The best of the hypotheses, the first of equals, among those that ``fit.patient`` would see. Points are looked at in
    parts, until the rest couldn't lift a hypothesis above the best so far if it lay on segments."""
    top, model, last, parts = -1.0, hyps[0], 0, np.array_split(points, 8)
    for n, h in enumerate(hyps, 1):
        if patience > 0 and n > 1 and n - 1 - last >= patience:
            break
        fx, fy, sx, sy, tx, ty = h
        total, seen = 0.0, 0
        for p in parts:
            d = t.nearest(fx * sx * p[:, 0] + tx, fy * sy * p[:, 1] + ty, hard)
            total, seen = total + float(np.where(d < hard, np.exp(-d * d / (2 * sigma * sigma)), 0.0).sum()), seen + len(p)
            if (total + len(points) - seen) / len(points) < top - SLACK:
                break
        if seen == len(points) and total / seen > top:
            top, model, last = total / seen, h, n
    return model


def lattice(segs: np.ndarray, points: np.ndarray, m: tuple[float, ...], scale_step: float, shift_step: float, sigma: float, hard: float, wide: list[Target]) -> tuple[float, ...]:
    """The best of the model's 225 neighbours, the first of equals in the order of ``fit.lattice``. A point lies at 15 x and 15 y
    of them; a segment counts for it only if it can be the nearest, and within ``hard``, at one of them. ``wide`` holds cells that an earlier call has made, and gets those of this one."""
    fx, fy, sx, sy, tx, ty = m
    five, three = np.arange(-2, 3), np.arange(-1, 2)
    sxs, sys, txs, tys = sx * (1 + five * scale_step), sy * (1 + five * scale_step), tx + three * shift_step, ty + three * shift_step
    x = (fx * sxs[None, :, None] * points[:, 0, None, None] + txs[None, None, :]).reshape(-1, 15)
    y = (fy * sys[None, :, None] * points[:, 1, None, None] + tys[None, None, :]).reshape(-1, 15)
    px, py = fx * sx * points[:, 0] + tx, fy * sy * points[:, 1] + ty
    reach = np.hypot(np.abs(x - px[:, None]).max(1), np.abs(y - py[:, None]).max(1))
    total = np.zeros((15, 15))
    # Points that move far are taken apart, so that they don't widen the cells of all.
    order, far = np.argsort(reach, kind="stable"), float(reach.max())
    for own in np.split(order, [np.searchsorted(reach[order], far / 2, side="right")] if far > hard / 2 else []):
        if not len(own):
            continue
        need = hard + float(reach[own].max())
        t = next((t for t in wide if need <= t.margin <= 1.5 * need), None)
        if t is None:
            wide.append(t := Target(segs, max(hard, need - hard), need))
        for c in range(0, len(own), POINTS):
            total += _lattice(t, px, py, x, y, reach, own[c : c + POINTS], sigma, hard)
    k = int(np.argmax((total / len(points)).reshape(5, 3, 5, 3).transpose(0, 2, 1, 3)))
    i, j, p, q = np.unravel_index(k, (5, 5, 3, 3))
    return fx, fy, float(sxs[i]), float(sys[j]), float(txs[p]), float(tys[q])


def _lattice(t: Target, px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray, reach: np.ndarray, own: np.ndarray, sigma: float, hard: float) -> np.ndarray:
    """The sum of closeness over the points ``own`` at each of the 15 times 15 places."""
    k, s = t.pairs(px[own], py[own])
    if not len(k):
        return np.zeros((15, 15))
    p = own[k]
    d = np.sqrt(t.squares(px[p], py[p], s))
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    near = np.full(len(own), hard)
    near[k[first]] = np.minimum.reduceat(d, first)
    keep = d - reach[p] <= np.minimum(hard, near[k] + reach[p]) + SLACK * (1 + d)
    k, p, s = k[keep], p[keep], s[keep]
    if not len(k):
        return np.zeros((15, 15))
    starts = np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), len(k))
    total, i = np.zeros((15, 15)), 0
    while i < len(starts) - 1:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + PAIRS, side="right")) - 1)
        a, b = starts[i], starts[j]
        dx, dy = x[p[a:b]] - t.x[s[a:b], None], y[p[a:b]] - t.y[s[a:b], None]
        ux, uy = t.ux[s[a:b], None], t.uy[s[a:b], None]
        along = (dx * ux)[:, :, None] + (dy * uy)[:, None, :]
        across = (dx * uy)[:, :, None] - (dy * ux)[:, None, :]
        along -= np.minimum(np.maximum(along, 0.0), t.length[s[a:b], None, None])
        along *= along
        across *= across
        along += across
        total += _closeness(np.minimum.reduceat(along, starts[i:j] - a, axis=0), sigma, hard).sum(axis=0)
        i = j
    return total


def percentile(v: np.ndarray, q: float) -> float:
    """As Spark's: between the two nearest of the sorted values ``v``, by their distance."""
    at = (len(v) - 1) * q
    lo, hi = int(np.floor(at)), int(np.ceil(at))
    return float(v[lo]) if lo == hi or v[lo] == v[hi] else float((hi - at) * v[lo] + (at - lo) * v[hi])


def steps(segs: np.ndarray, length: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Points of ``segments.sample_steps``."""
    n = np.maximum(np.ceil(length / step), 1).astype(np.int64)
    k, i = _spread(np.zeros(len(n), np.int64), n)
    at = i / n[k]
    x1, y1, x2, y2 = segs[k].T
    return x1 + (x2 - x1) * at, y1 + (y2 - y1) * at


def fitted(svg: np.ndarray, pdf: np.ndarray, length: np.ndarray, sample: np.ndarray, hyps: list[tuple[float, ...]], *, rounds: tuple[tuple[float, float], ...], patience: int, sigma: float, hard: float, step: float) -> tuple[float, ...]:
    """fx, fy, sx, sy, tx, ty, score, rmse, p95, median of one document."""
    t = Target(svg, hard, hard)
    m = judged(t, sample, hyps, patience, sigma, hard)
    wide: list[Target] = []
    for a, b in rounds:
        m = lattice(svg, sample, m, a, b, sigma, hard, wide)
    x, y = steps(pdf, length, step)
    d = np.sort(t.nearest(m[0] * m[2] * x + m[4], m[1] * m[3] * y + m[5], hard))
    close = np.where(d < hard, np.exp(-d * d / (2 * sigma * sigma)), 0.0)
    return *m, float(close.mean()), float(np.sqrt((d * d).mean())), percentile(d, 0.95), percentile(d, 0.5)
