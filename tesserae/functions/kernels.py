"""NumPy kernels for inherently sequential or geometric steps on one image or one polyline.

They run inside grouped Arrow or pandas functions; a canvas is a few hundred
pixels wide, so one image fits a task whatever the number of images.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np

SIDES = ((-1, 0), (1, 0), (0, -1), (0, 1))


def components4(mask: np.ndarray) -> np.ndarray:
    """4-connected components of equal values >= 0, numbered in row-major order of their first pixel; -1 elsewhere."""
    h, w = mask.shape
    out = np.full((h, w), -1, np.int32)
    n = 0
    for y, x in zip(*np.nonzero(mask >= 0)):
        if out[y, x] >= 0:
            continue
        value, queue = mask[y, x], deque([(y, x)])
        out[y, x] = n
        while queue:
            a, b = queue.popleft()
            for dy, dx in SIDES:
                c, d = a + dy, b + dx
                if 0 <= c < h and 0 <= d < w and out[c, d] < 0 and mask[c, d] == value:
                    out[c, d] = n
                    queue.append((c, d))
        n += 1
    return out


def holes(mask: np.ndarray, most: int = 32) -> list[np.ndarray]:
    """Components of the background that do not touch the frame, largest first."""
    parts = components4(np.where(mask, -1, 0))
    frame = set(parts[0]) | set(parts[-1]) | set(parts[:, 0]) | set(parts[:, -1])
    found = [parts == k for k in range(parts.max(initial=-1) + 1) if k not in frame]
    return sorted(found, key=lambda m: -int(m.sum()))[:most]


def flood_background(lab: np.ndarray, tolerance: float = 28.0) -> np.ndarray:
    """Subject mask: what a flood from the corners, within ``tolerance`` of their median colour, does not reach.

    All of the canvas if less than 2 % or more than 98 % would be left.
    """
    h, w = lab.shape[:2]
    corners = [(0, 0), (0, w - 1), (h - 1, 0), (h - 1, w - 1)]
    near = np.sqrt(((lab - np.median([lab[c] for c in corners], axis=0)) ** 2).sum(2)) <= tolerance
    for c in corners:
        near[c] = True
    parts = components4(np.where(near, 0, -1))
    reached = np.isin(parts, [parts[c] for c in corners])
    share = 1 - reached.mean()
    return np.ones((h, w), bool) if share < 0.02 or share > 0.98 else ~reached


def kmeans(points: np.ndarray, k: int, seed: int = 0, rounds: int = 15, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's algorithm from k-means++ seeds over weighted points; (centres, labels). Empty clusters restart at a random point."""
    rng = np.random.default_rng(seed)
    k = min(k, len(points))
    weights = np.ones(len(points)) if weights is None else weights
    pick = lambda p: points[rng.choice(len(points), p=p / p.sum())]
    centres = [pick(weights)]
    distance = np.full(len(points), np.inf)
    while len(centres) < k:
        distance = np.minimum(distance, ((points - centres[-1]) ** 2).sum(1))
        centres.append(pick(distance * weights if (distance * weights).sum() > 0 else weights))
    c = np.array(centres, float)
    labels = np.zeros(len(points), int)
    for _ in range(rounds):
        labels = ((points[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
        for j in range(k):
            mine = labels == j
            c[j] = np.average(points[mine], axis=0, weights=weights[mine]) if mine.any() else pick(weights)
    return c, ((points[:, None, :] - c[None]) ** 2).sum(2).argmin(1)


def potts_relax(labels: np.ndarray, cost: np.ndarray, edge: np.ndarray, weight: float = 2.5, rounds: int = 5) -> np.ndarray:
    """In-place, row by row: a pixel takes a label that is strictly cheaper than its own.

    Energy: ``cost[y, x, k]`` plus weight / (1 + 2.5 edge) for each labelled neighbour with another label.
    """
    out = labels.copy()
    h, w = out.shape
    n = cost.shape[2]
    for _ in range(rounds):
        changed = False
        for y in range(h):
            for x in range(w):
                own = out[y, x]
                if own < 0:
                    continue
                near = [out[y + dy, x + dx] for dy, dx in SIDES if 0 <= y + dy < h and 0 <= x + dx < w and out[y + dy, x + dx] >= 0]
                pair = weight / (1 + 2.5 * edge[y, x])
                energy = cost[y, x] + pair * (len(near) - np.bincount(near, minlength=n)[:n])
                best = int(energy.argmin())
                if energy[best] < energy[own] - 1e-12:
                    out[y, x] = best
                    changed = True
        if not changed:
            break
    return out


def merge_small(labels: np.ndarray, least: int) -> np.ndarray:
    """Components below ``least`` pixels join the label most frequent around them, labels in rising order.

    One with no labelled neighbour joins the most frequent label of the image, the smallest of equals.
    """
    out = labels.copy()
    h, w = out.shape
    for label in sorted(set(out[out >= 0].tolist())):
        parts = components4(np.where(out == label, 0, -1))
        for k in range(parts.max(initial=-1) + 1):
            here = parts == k
            if here.sum() >= least:
                continue
            votes: dict[int, int] = {}
            for y, x in zip(*np.nonzero(here)):
                for dy, dx in SIDES:
                    a, b = y + dy, x + dx
                    if 0 <= a < h and 0 <= b < w and out[a, b] >= 0 and out[a, b] != label:
                        votes[int(out[a, b])] = votes.get(int(out[a, b]), 0) + 1
            everywhere = np.bincount(out[out >= 0])
            out[here] = max(votes, key=lambda v: votes[v]) if votes else int(everywhere.argmax())
    return out


def fill_gaps(labels: np.ndarray, subject: np.ndarray) -> np.ndarray:
    """Unlabelled subject pixels take the label of the nearest labelled one, by breadth-first search."""
    out = labels.copy()
    h, w = out.shape
    queue = deque(zip(*np.nonzero(out >= 0)))
    while queue:
        y, x = queue.popleft()
        for dy, dx in SIDES:
            a, b = y + dy, x + dx
            if 0 <= a < h and 0 <= b < w and out[a, b] < 0 and subject[a, b]:
                out[a, b] = out[y, x]
                queue.append((a, b))
    return out


def rings(mask: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """Closed rings of pixel corners around a mask: ('outer' | 'hole', points).

    Boundary edges are directed with the inside on their right (y points
    down) and chained; at a corner where two meet, the turn that keeps to the
    same pixel is taken, so 4-connected parts stay apart.
    """
    m = np.pad(mask.astype(bool), 1)
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    ys, xs = np.nonzero(m)
    for y, x in zip(ys.tolist(), xs.tolist()):
        for inside, a, b in ((m[y - 1, x], (x, y), (x + 1, y)), (m[y, x + 1], (x + 1, y), (x + 1, y + 1)), (m[y + 1, x], (x + 1, y + 1), (x, y + 1)), (m[y, x - 1], (x, y + 1), (x, y))):
            if not inside:
                after.setdefault(a, []).append(b)
    out = []
    while after:
        start = min(after)
        ring, at, before = [start], start, None
        while True:
            ends = after[at]
            if before is not None and len(ends) > 1:
                dx, dy = at[0] - before[0], at[1] - before[1]
                ends.sort(key=lambda e: (e[0] - at[0]) * -dy + (e[1] - at[1]) * dx)  # the right turn comes last
            nxt = ends.pop()
            if not ends:
                del after[at]
            before, at = at, nxt
            if at == start:
                break
            ring.append(at)
        points = np.array(ring, float) - 1
        out.append(("outer" if signed_area(points) > 0 else "hole", points))
    return out


def signed_area(points: np.ndarray) -> float:
    x, y = points[:, 0], points[:, 1]
    return 0.5 * float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())


def perimeter(points: np.ndarray) -> float:
    return float(np.hypot(*(np.roll(points, -1, 0) - points).T).sum())


def simplify(points: np.ndarray, epsilon: float) -> np.ndarray:
    """Douglas-Peucker on an open polyline, with a stack."""
    if len(points) < 3:
        return points
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        chord = points[b] - points[a]
        inner = points[a + 1 : b] - points[a]
        length = math.hypot(*chord)
        d = np.abs(chord[0] * inner[:, 1] - chord[1] * inner[:, 0]) / length if length > 1e-12 else np.hypot(*inner.T)
        k = int(d.argmax())
        if d[k] > epsilon:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def resample_path(points: np.ndarray, n: int, closed: bool = False) -> np.ndarray:
    """n points at equal arc length; a closed ring does not repeat its first."""
    path = np.vstack([points, points[:1]]) if closed else points
    arc = np.r_[0, np.cumsum(np.hypot(*np.diff(path, axis=0).T))]
    if arc[-1] <= 0:
        return np.repeat(path[:1], n, 0)
    at = np.linspace(0, arc[-1], n, endpoint=not closed)
    return np.column_stack([np.interp(at, arc, path[:, k]) for k in (0, 1)])


def turn_histogram(ring: np.ndarray, bins: int = 24) -> np.ndarray:
    """Share of turn angles, wrapped to [-pi, pi), by equal bins."""
    d = np.roll(ring, -1, 0) - ring
    angle = np.arctan2(d[:, 1], d[:, 0])
    turn = (angle - np.roll(angle, 1) + math.pi) % (2 * math.pi) - math.pi
    n, _ = np.histogram(turn, bins, (-math.pi, math.pi))
    return n / max(n.sum(), 1)


def anchors(points: np.ndarray, window: float = 8.0, least_turn: float = 50.0, spacing: float = 10.0) -> list[int]:
    """Ends and corners of an open path: turns of at least 50 degrees over a window of arc length, sharpest first, 10 apart."""
    arc = np.r_[0, np.cumsum(np.hypot(*np.diff(points, axis=0).T))]
    reach = float(np.clip(window, 2, max(2, 0.25 * arc[-1])))
    at = lambda s: np.array([np.interp(s, arc, points[:, k]) for k in (0, 1)])
    turn = np.zeros(len(points))
    for i in range(1, len(points) - 1):
        a, b = points[i] - at(max(arc[i] - reach, 0)), at(min(arc[i] + reach, arc[-1])) - points[i]
        na, nb = math.hypot(*a), math.hypot(*b)
        if na > 1e-9 and nb > 1e-9:
            turn[i] = math.degrees(math.acos(float(np.clip(a @ b / (na * nb), -1, 1))))
    chosen: list[int] = []
    for i in np.argsort(-turn, kind="stable"):
        if turn[i] < least_turn:
            break
        if all(abs(arc[i] - arc[j]) >= spacing for j in chosen):
            chosen.append(int(i))
    return sorted({0, len(points) - 1, *chosen})


def fit_path(points: np.ndarray, tolerance: float = 2.0) -> np.ndarray:
    """A smoother path with the same ends: lines where a span is straight within the tolerance, else a cubic."""
    arc = np.r_[0, np.cumsum(np.hypot(*np.diff(points, axis=0).T))]
    if len(points) < 3 or arc[-1] < 2 or (len(points) <= 8 and arc[-1] <= 6):
        return points
    stops = anchors(points)
    out = [points[stops[0]][None]]
    for a, b in zip(stops, stops[1:]):
        span = points[a : b + 1]
        chord = span[-1] - span[0]
        length = math.hypot(*chord)
        inner = span - span[0]
        gap = np.abs(chord[0] * inner[:, 1] - chord[1] * inner[:, 0]) / length if length > 1e-9 else np.hypot(*inner.T)
        if gap.max() <= tolerance:
            out.append(span[-1:])
            continue
        s = np.r_[0, np.cumsum(np.hypot(*np.diff(span, axis=0).T))]
        at = lambda f: np.array([np.interp(f * s[-1], s, span[:, k]) for k in (0, 1)])
        t0, t1 = at(0.2) - span[0], span[-1] - at(0.8)
        reach = max(length, s[-1]) / 3
        p1 = span[0] + t0 / max(math.hypot(*t0), 1e-9) * reach
        p2 = span[-1] - t1 / max(math.hypot(*t1), 1e-9) * reach
        u = (s / s[-1])[:, None]
        curve = lambda u: (1 - u) ** 3 * span[0] + 3 * (1 - u) ** 2 * u * p1 + 3 * (1 - u) * u**2 * p2 + u**3 * span[-1]
        residual = (span - curve(u)).mean(0) / 2
        p1, p2 = p1 + residual, p2 + residual
        n = max(6, min(18, max(4, len(span) // 4)))
        out.append(curve(np.linspace(0, 1, n)[1:, None]))
    return np.vstack(out)


def blur_distance(mask: np.ndarray, rounds: int) -> np.ndarray:
    """(0.5 - 3x3 means) * 16 * sqrt(rounds / 12): positive outside."""
    v = mask.astype(float)
    for _ in range(rounds):
        p = np.pad(v, 1, mode="edge")
        v = sum(p[a : a + v.shape[0], b : b + v.shape[1]] for a in range(3) for b in range(3)) / 9
    return (0.5 - v) * 16 * math.sqrt(rounds / 12)


def stamp_mask(points: np.ndarray, size: int, left: float, top: float, width: float, height: float, angle: float) -> np.ndarray:
    """Mask of a polygon of the unit box, turned clockwise onto a square canvas (even-odd rule at pixel centres)."""
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    p = points * [width, height]
    x, y = left + c * p[:, 0] - s * p[:, 1], top + s * p[:, 0] + c * p[:, 1]
    return fill_polygon(np.column_stack([x, y]), size, size)


def fill_polygon(points: np.ndarray, h: int, w: int) -> np.ndarray:
    """Pixels whose centre lies in a polygon, by the even-odd rule: every crossing of a row flips what lies to its right."""
    x0, y0 = points[:, 0], points[:, 1]
    x1, y1 = np.roll(x0, -1), np.roll(y0, -1)
    y = np.arange(h) + 0.5
    edge, row = np.nonzero((y0[:, None] > y) != (y1[:, None] > y))
    cross = x0[edge] + (y[row] - y0[edge]) * (x1[edge] - x0[edge]) / (y1[edge] - y0[edge])
    first = np.clip(np.floor(cross - 0.5).astype(np.int64) + 1, 0, w)
    flips = np.bincount(row * (w + 1) + first, minlength=h * (w + 1)).reshape(h, w + 1)
    return np.cumsum(flips[:, :w], 1) % 2 == 1
