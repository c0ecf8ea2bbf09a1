"""Loops of segments: noding, stitching and nesting, in arrays."""

from __future__ import annotations

import numpy as np


def area(ring: np.ndarray) -> float:
    """Signed area of a closed ring (first corner repeated at the end), counter-clockwise positive."""
    x, y = ring[:, 0], ring[:, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def holds(ring: np.ndarray, px: float, py: float) -> bool:
    x1, y1, x2, y2 = ring[:-1, 0], ring[:-1, 1], ring[1:, 0], ring[1:, 1]
    cross = (y1 > py) != (y2 > py)
    with np.errstate(divide="ignore", invalid="ignore"):
        return bool((cross & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)).sum() % 2)


def close_pairs(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of segments (rows x1, y1, x2, y2) whose boxes meet, by a grid about as fine as the segments."""
    n = len(segments)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none
    lo = np.minimum(segments[:, :2], segments[:, 2:])
    hi = np.maximum(segments[:, :2], segments[:, 2:])
    span = (hi.max(axis=0) - lo.min(axis=0)).max()
    cell = max((hi - lo).max(axis=1).mean() * 2, span / (2 * np.sqrt(n) + 1), np.finfo(float).tiny)
    a = np.floor((lo - lo.min(axis=0)) / cell).astype(np.int64)
    z = np.floor((hi - lo.min(axis=0)) / cell).astype(np.int64)
    wide = z - a + 1
    reps = wide[:, 0] * wide[:, 1]
    who = np.repeat(np.arange(n), reps)
    k = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    cx, cy = a[who, 0] + k % wide[who, 0], a[who, 1] + k // wide[who, 0]
    key = cx * (int(z[:, 1].max()) + 1) + cy
    order = np.argsort(key, kind="stable")
    who, key = who[order], key[order]
    left, right = [], []
    for d in range(1, len(key)):  # as many rounds as the fullest cell has segments
        same = key[d:] == key[:-d]
        if not same.any():
            break
        i, j = who[:-d][same], who[d:][same]
        meet = (lo[i] <= hi[j]).all(axis=1) & (lo[j] <= hi[i]).all(axis=1)
        left.append(i[meet])
        right.append(j[meet])
    if not left:
        return none, none
    pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _turn(ax, ay, bx, by, cx, cy):
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def noded(segments: np.ndarray) -> np.ndarray:
    """Segments cut wherever two of them cross or touch; what two (or any even number) share cancels out."""
    i, j = close_pairs(segments)
    ax, ay, bx, by = segments[i].T
    cx, cy, dx, dy = segments[j].T
    s, t, u, v = _turn(ax, ay, bx, by, cx, cy), _turn(ax, ay, bx, by, dx, dy), _turn(cx, cy, dx, dy, ax, ay), _turn(cx, cy, dx, dy, bx, by)
    cuts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    proper = (s * t < 0) & (u * v < 0)
    f = np.divide(u, u - v, out=np.zeros_like(u), where=proper)
    x, y = ax + f * (bx - ax), ay + f * (by - ay)
    cuts += [(i[proper], x[proper], y[proper]), (j[proper], x[proper], y[proper])]

    def on(side, px, py, x1, y1, x2, y2, who):  # an end of one lies on the other
        hit = (side == 0) & (px >= np.minimum(x1, x2)) & (px <= np.maximum(x1, x2)) & (py >= np.minimum(y1, y2)) & (py <= np.maximum(y1, y2))
        cuts.append((who[hit], px[hit], py[hit]))

    on(s, cx, cy, ax, ay, bx, by, i)
    on(t, dx, dy, ax, ay, bx, by, i)
    on(u, ax, ay, cx, cy, dx, dy, j)
    on(v, bx, by, cx, cy, dx, dy, j)
    n = len(segments)
    who = np.concatenate([np.arange(n), np.arange(n), *[c[0] for c in cuts]])
    px = np.concatenate([segments[:, 0], segments[:, 2], *[c[1] for c in cuts]])
    py = np.concatenate([segments[:, 1], segments[:, 3], *[c[2] for c in cuts]])
    far = np.hypot(px - segments[who, 0], py - segments[who, 1])
    order = np.lexsort((far, who))
    who, px, py = who[order], px[order], py[order]
    go = (who[1:] == who[:-1]) & ((px[1:] != px[:-1]) | (py[1:] != py[:-1]))
    parts = np.stack([px[:-1], py[:-1], px[1:], py[1:]], axis=1)[go]
    swap = (parts[:, 2] < parts[:, 0]) | ((parts[:, 2] == parts[:, 0]) & (parts[:, 3] < parts[:, 1]))
    parts[swap] = parts[swap][:, [2, 3, 0, 1]]
    parts, count = np.unique(parts, axis=0, return_counts=True)
    return parts[count % 2 == 1]


def _mates(segments: np.ndarray, ends: dict) -> dict:
    """(segment, end) -> the segment that goes on from there, where more than two meet: the other side of the wedge of
    the inside between them. Rings that go on so may touch but never cross each other."""
    x1, y1, x2, y2 = segments.T
    mates = {}
    for (x, y), met in ends.items():
        if len(met) < 4 or len(met) % 2:
            continue
        around = sorted((float(np.arctan2(q - y, p - x)), i, float(np.hypot(p - x, q - y))) for i, (p, q) in met)
        a, b = around[0][0], around[1][0]
        far = 1e-6 * min(r for _, _, r in around)
        px, py = x + far * np.cos((a + b) / 2), y + far * np.sin((a + b) / 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            inside = (((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)).sum() % 2
        order = [i for _, i, _ in around]
        order = order if inside else order[1:] + order[:1]
        for i, j in zip(order[::2], order[1::2]):
            mates[i, (x, y)], mates[j, (x, y)] = j, i
    return mates


def stitch(segments: np.ndarray) -> list[np.ndarray]:
    """Closed rings of undirected segments (rows x1, y1, x2, y2) in which every end has an even number of segments.

    A ring never passes a point twice: where it would, the loop is cut off, so that shapes touching at a corner, and
    a hole touching its shell, come out apart. Ends with an odd number of segments leave open lines, which are
    dropped.
    """
    lines = segments.tolist()
    ends: dict[tuple, list[tuple[int, tuple]]] = {}
    for i, (x1, y1, x2, y2) in enumerate(lines):
        ends.setdefault((x1, y1), []).append((i, (x2, y2)))
        ends.setdefault((x2, y2), []).append((i, (x1, y1)))
    used = [False] * len(lines)
    mates = _mates(segments, ends)
    rings = []
    for i, (x1, y1, _, _) in enumerate(lines):
        if used[i]:
            continue
        path, place, k = [(x1, y1)], {(x1, y1): 0}, -1
        while path:
            options = ends[path[-1]]
            mate = mates.get((k, path[-1]), -1)
            if mate >= 0 and not used[mate]:  # last of the options, so taken
                options.sort(key=lambda o: o[0] == mate)
            while options and used[options[-1][0]]:
                options.pop()
            if not options:  # an end that leads nowhere, or the start when all is done
                del place[path.pop()]
                k = -1
                continue
            k, to = options.pop()
            used[k] = True
            if to in place:
                first = place[to]
                ring = path[first:] + [to]
                for p in path[first + 1 :]:
                    del place[p]
                del path[first + 1 :]
                if len(ring) > 3:
                    rings.append(np.array(ring))
            else:
                place[to] = len(path)
                path.append(to)
    return rings


def _probe(r: np.ndarray) -> np.ndarray:
    """A point just inside a ring, beside its first side."""
    mid, d = (r[0] + r[1]) / 2, r[1] - r[0]
    n = np.array([-d[1], d[0]]) * 1e-6
    for s in (n, -n):
        if holds(r, *(mid + s)):
            return mid + s
    return mid


def polygons(rings: list[np.ndarray]) -> list[tuple[int, int, np.ndarray]]:
    """(part, ring, coordinates): shells (ring 0, counter-clockwise) with the holes (clockwise) that lie in them.

    Parts are numbered by falling area, then by their lowest corner. A ring is tested against those only whose box
    holds a point of it.
    """
    if not rings:
        return []
    if len(rings) == 1:
        return [(0, 0, rings[0] if area(rings[0]) > 0 else rings[0][::-1])]
    low, high = np.array([r.min(axis=0) for r in rings]), np.array([r.max(axis=0) for r in rings])
    around: list[list[int]] = []
    for i, r in enumerate(rings):
        p = _probe(r)
        boxes = np.flatnonzero(((low <= p) & (p <= high)).all(axis=1))
        around.append([j for j in boxes.tolist() if j != i and holds(rings[j], *p)])
    depth = [len(a) for a in around]
    shells = [i for i, d in enumerate(depth) if d % 2 == 0]
    shells.sort(key=lambda i: (-round(abs(area(rings[i])), 12), tuple(low[i])))
    holes_of: dict[int, list[int]] = {}
    for i, d in enumerate(depth):
        if d % 2:
            owner = next(j for j in around[i] if depth[j] == d - 1)
            holes_of.setdefault(owner, []).append(i)
    out = []
    for part, s in enumerate(shells):
        holes = sorted(holes_of.get(s, ()), key=lambda i: tuple(low[i]))
        for k, i in enumerate([s, *holes]):
            ccw = area(rings[i]) > 0
            out.append((part, k, rings[i] if ccw == (k == 0) else rings[i][::-1]))
    return out
