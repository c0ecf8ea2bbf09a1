"""Ear clipping of polygons, in arrays over many rings at once.

Rings of up to MOST_CORNERS corners are clipped as they are, all rings of one size together. Larger ones, and polygons
of several rings (holes, parts), are first cut by lines through their middle, and through their holes, into simple
pieces of at most that size; a line never runs through a corner. Rings that cross or touch themselves are cut at the
points where they do first. So the work grows with the number of corners (times its logarithm), not with its square.
"""

from __future__ import annotations

import numpy as np

from thalweg.functions.rings import area, close_pairs, noded, polygons, stitch

#: Corners of a piece: the ears of one are found by comparing all of its corners.
MOST_CORNERS = 32
_CELLS = 2_000_000  # numbers in one array of comparisons

Piece = tuple[np.ndarray, np.ndarray]  # corners (counter-clockwise), and whether the side from each is the polygon's


def clean_ring(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Corners of a ring without the closing point, repeats in a row and unusable numbers."""
    pts = np.column_stack([x, y]).astype(float)
    pts = pts[np.isfinite(pts).all(axis=1)]
    if len(pts) > 1:
        keep = np.ones(len(pts), bool)
        keep[1:] = (pts[1:] != pts[:-1]).any(axis=1)
        pts = pts[keep]
    if len(pts) > 1 and (pts[0] == pts[-1]).all():
        pts = pts[:-1]
    return pts


def _cross(o, a, b):
    return (a[..., 0] - o[..., 0]) * (b[..., 1] - o[..., 1]) - (a[..., 1] - o[..., 1]) * (b[..., 0] - o[..., 0])


def _simple(rings: np.ndarray) -> np.ndarray:
    """Of rings of one size (N x n x 2), whether no two sides meet but neighbours at their common corner."""
    n = rings.shape[1]
    i, j = np.triu_indices(n, 2)
    keep = ~((i == 0) & (j == n - 1))
    i, j = i[keep], j[keep]
    out = np.ones(len(rings), bool)
    for lo in range(0, len(rings), max(1, _CELLS // max(1, len(i)))):
        part = rings[lo : lo + max(1, _CELLS // max(1, len(i)))]
        a, b, c, d = part[:, i], part[:, (i + 1) % n], part[:, j], part[:, (j + 1) % n]
        apart = (np.maximum(c, d) < np.minimum(a, b)).any(-1) | (np.minimum(c, d) > np.maximum(a, b)).any(-1)
        meet = ~apart & (_cross(a, b, c) * _cross(a, b, d) <= 0) & (_cross(c, d, a) * _cross(c, d, b) <= 0)
        out[lo : lo + len(part)] = ~meet.any(axis=1)
    return out


def _ears(rings: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ring number, corners, sides, failed): triangles of rings of one size, one ear of each ring a step.

    Of the ears of a ring the one with the shortest base goes, so triangles stay compact. sides: bits of the sides
    that are the polygon's. failed: rings in which no ear was found.
    """
    who = np.arange(len(rings))
    ids, out, bits, failed = [], [], [], []

    def emit(k, a, b, c, s1, s2, s3):
        ids.append(who[k])
        out.append(np.concatenate([a, b, c], axis=1))
        bits.append((s1 + 2 * s2 + 4 * s3).astype(np.int8))

    while rings.shape[1] > 3 and len(rings):
        n = rings.shape[1]
        before, after = np.roll(rings, 1, axis=1), np.roll(rings, -1, axis=1)
        turn = _cross(before, rings, after)
        flat = turn == 0
        other = ~(np.eye(n, dtype=bool) | np.roll(np.eye(n, dtype=bool), 1, axis=1) | np.roll(np.eye(n, dtype=bool), -1, axis=1))
        a, b, c, p = before[:, :, None], rings[:, :, None], after[:, :, None], rings[:, None, :]
        held = (_cross(a, b, p) >= 0) & (_cross(b, c, p) >= 0) & (_cross(c, a, p) >= 0) & other
        ear = (turn > 0) & ~held.any(axis=2)
        base = np.where(ear, ((after - before) ** 2).sum(axis=-1), np.inf)
        base[flat] = -1.0  # a flat corner goes without leaving a triangle
        at = base.argmin(axis=1)
        row = np.arange(len(rings))
        ok = np.isfinite(base[row, at])
        if not ok.all():
            failed.append(who[~ok])
            rings, border, who, at, flat, before, after = rings[ok], border[ok], who[ok], at[ok], flat[ok], before[ok], after[ok]
            row = np.arange(len(rings))
        is_ear = ~flat[row, at]
        last = (at - 1) % n
        k = np.flatnonzero(is_ear)
        emit(k, before[k, at[k]], rings[k, at[k]], after[k, at[k]], border[k, last[k]], border[k, at[k]], np.zeros(len(k), bool))
        border = border.copy()
        border[row, last] = ~is_ear & border[row, last] & border[row, at]
        stay = np.ones((len(rings), n), bool)
        stay[row, at] = False
        rings, border = rings[stay].reshape(-1, n - 1, 2), border[stay].reshape(-1, n - 1)
    if len(rings):
        k = np.flatnonzero(_cross(rings[:, 0], rings[:, 1], rings[:, 2]) > 0)
        emit(k, rings[k, 0], rings[k, 1], rings[k, 2], border[k, 0], border[k, 1], border[k, 2])
    none = np.zeros(0, np.int64)
    if not ids:
        return none, np.zeros((0, 6)), np.zeros(0, np.int8), np.concatenate(failed) if failed else none
    return np.concatenate(ids), np.concatenate(out), np.concatenate(bits), np.concatenate(failed) if failed else none


def _slabs(loops: list[np.ndarray]) -> np.ndarray:
    """Triangles of loops by horizontal slabs between their corners: for the rare piece in which rounding hides all
    ears or that no line cuts smaller."""
    pts, nxt = np.vstack(loops), np.vstack([np.roll(p, -1, axis=0) for p in loops])
    low = np.where((pts[:, 1] <= nxt[:, 1])[:, None], np.hstack([pts, nxt]), np.hstack([nxt, pts]))
    levels, out = np.unique(pts[:, 1]), []
    for y0, y1 in zip(levels, levels[1:]):
        e = low[(low[:, 1] <= y0) & (low[:, 3] >= y1)]
        slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
        a, b = e[:, 0] + slope * (y0 - e[:, 1]), e[:, 0] + slope * (y1 - e[:, 1])
        order = np.argsort(a + b, kind="stable")
        for i, j in zip(order[::2], order[1::2]):
            out += [(a[i], y0, a[j], y0, b[j], y1), (a[i], y0, b[j], y1, b[i], y1)]
    tri = np.array(out).reshape(-1, 6)
    turn = _cross(tri[:, :2], tri[:, 2:4], tri[:, 4:])
    tri[turn < 0] = tri[turn < 0][:, [0, 1, 4, 5, 2, 3]]
    return tri[turn != 0]


def _line(values: np.ndarray, near: float) -> float | None:
    """A number between two neighbouring values, close to `near`, that is none of them; None if all are one."""
    v = np.unique(values)
    k = int(np.clip(np.searchsorted(v, near), 1, max(1, len(v) - 1)))
    for i in sorted(range(1, len(v)), key=lambda i: abs(i - k))[:64]:
        mid = v[i - 1] + (v[i] - v[i - 1]) / 2
        if v[i - 1] < mid < v[i]:
            return float(mid)
    return None


def _cut(loops: list[Piece], axis: int, at: float) -> tuple[list[Piece], list[Piece]] | None:
    """Loops (shells counter-clockwise, holes clockwise) on the lower and on the upper side of a line.

    Where the line enters and leaves the polygon, both sides get the same point. None if entries and exits do not alternate.
    """
    sides: tuple[list[Piece], list[Piece]] = ([], [])
    arcs: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []  # side, entry, exit, corners, flags
    place: list[float] = []
    rising: list[bool] = []
    for pts, own in loops:
        up = pts[:, axis] > at
        if up.all() or not up.any():
            sides[int(up[0])].append((pts, own))
            continue
        n = len(pts)
        k = np.flatnonzero(up != np.roll(up, -1))  # sides that cross
        a, b = pts[k], pts[(k + 1) % n]
        t = (at - a[:, axis]) / (b[:, axis] - a[:, axis])
        x = np.empty((len(k), 2))
        x[:, axis] = at
        x[:, 1 - axis] = a[:, 1 - axis] + t * (b[:, 1 - axis] - a[:, 1 - axis])
        first = len(place)
        place += x[:, 1 - axis].tolist()
        rising += (~up[k]).tolist()
        for i in range(len(k)):
            j = (i + 1) % len(k)
            stop = k[j] if k[j] > k[i] else k[j] + n
            mid = np.arange(k[i] + 1, stop + 1) % n
            arcs.append((int(up[mid[0]]), first + i, first + j, np.vstack([x[i], pts[mid], x[j]]), np.concatenate([[own[k[i]]], own[mid]])))
    if not arcs:
        return sides
    order = np.argsort(np.array(place), kind="stable")
    mate = np.empty(len(place), np.int64)
    mate[order[::2]], mate[order[1::2]] = order[1::2], order[::2]
    if any(rising[i] == rising[mate[i]] for i in range(len(place))):
        return None
    begins = {(side, entry): n for n, (side, entry, *_) in enumerate(arcs)}
    used = [False] * len(arcs)
    for n in range(len(arcs)):
        if used[n]:
            continue
        side, corners, flags, k = arcs[n][0], [], [], n
        while not used[k]:
            used[k] = True
            corners.append(arcs[k][3])
            flags += [arcs[k][4], [False]]
            k = begins[side, int(mate[arcs[k][2]])]
        pts, own = np.vstack(corners), np.concatenate(flags).astype(bool)
        keep = (pts != np.roll(pts, -1, axis=0)).any(axis=1)
        if keep.sum() >= 3:
            sides[side].append((pts[keep], own[keep]))
    return sides


def _signed(pts: np.ndarray) -> float:
    return area(np.vstack([pts, pts[:1]]))


def _size(loops: list[Piece]) -> tuple[int, int]:
    """What every cut must make less: holes, and corners of what is to be cut together."""
    holes = sum(_signed(p) < 0 for p, _ in loops)
    return holes, sum(len(p) for p, _ in loops) if holes else max(len(p) for p, _ in loops)


def pieces(loops: list[np.ndarray]) -> list[Piece]:
    """Simple pieces of at most MOST_CORNERS corners that make up the inside, by the even-odd rule, of loops of corners."""
    rings = [np.vstack([r, r[:1]]) for r in loops]
    segments = np.vstack([np.hstack([r[:-1], r[1:]]) for r in rings])
    i, j = close_pairs(segments)
    a, b, c, d = segments[i][:, :2], segments[i][:, 2:], segments[j][:, :2], segments[j][:, 2:]
    meet = (_cross(a, b, c) * _cross(a, b, d) <= 0) & (_cross(c, d, a) * _cross(c, d, b) <= 0)
    joined = (b == c).all(axis=1).astype(int) + (a == d).all(axis=1) + (a == c).all(axis=1) + (b == d).all(axis=1)
    # neighbours meet at one corner, and no corner has more than two sides
    ends = np.unique(segments[:, :2], axis=0)
    folded = (joined == 1) & (_cross(a, b, c) == 0) & (_cross(a, b, d) == 0) & (((b - a) * (d - c)).sum(axis=1) < 0) & ((b == c).all(axis=1) | (a == d).all(axis=1))
    if (meet & (joined == 0)).any() or folded.any() or len(ends) < len(segments):
        rings = stitch(noded(segments))
    todo = [[(r[:-1], np.ones(len(r) - 1, bool)) for _, _, r in polygons(rings)]]
    out: list[Piece] = []
    while todo:
        work = todo.pop()
        least = 8 * np.finfo(float).eps * max(np.abs(p).max() for p, _ in work) ** 2
        work = [w for w in work if abs(_signed(w[0])) > least]  # the rest is rounding
        areas = [_signed(p) for p, _ in work]
        holes = [k for k, s in enumerate(areas) if s < 0]
        if not any(s > 0 for s in areas):
            continue
        if not holes and len(work) > 1:
            todo += [[w] for w in work]
            continue
        if not holes and len(work[0][0]) <= MOST_CORNERS:
            out.append(work[0])
            continue
        every, cuts = np.vstack([p for p, _ in work]), []
        # through the middle of all corners, or of the middle hole; the more even of a cut across and one along comes first
        target = work[holes[len(holes) // 2]][0] if holes else every
        for axis in (0, 1):
            line = _line(target[:, axis], float(np.median(target[:, axis])))
            if line is not None and (every[:, axis] == line).any():
                line = _line(every[:, axis], line)
            if line is not None:
                below = int((every[:, axis] < line).sum())
                cuts.append((min(below, len(every) - below), axis, line))
        size = _size(work)
        for _, axis, line in sorted(cuts, reverse=True):
            done = _cut(work, axis, line)
            if done is not None and all(_size(side) < size for side in done if side):
                break
        else:  # neither helps: by slabs, each triangle of which is a piece
            out += [(t.reshape(3, 2), np.ones(3, bool)) for t in _slabs([p for p, _ in work])]
            continue
        todo += [side for side in done if side]
    return out


def triangulate_many(polygons_: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(polygon number, x1 y1 x2 y2 x3 y3, sides) of the triangles of polygons, each a list of loops of corners.

    A point is inside by the even-odd rule. `sides` has a bit for each side of a triangle that is the polygon's own.
    Polygons without area have no triangles.
    """
    by_size: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    alone: dict[int, list[tuple[int, np.ndarray]]] = {}
    hard: list[tuple[int, list[np.ndarray]]] = []
    for k, loops in enumerate(polygons_):
        loops = [r for r in loops if len(r) >= 3]
        if len(loops) == 1 and len(loops[0]) <= MOST_CORNERS:
            alone.setdefault(len(loops[0]), []).append((k, loops[0]))
        elif loops:
            hard.append((k, loops))
    for n, found in alone.items():
        rings = np.stack([r for _, r in found])
        nxt = np.roll(rings, -1, axis=1)
        twice = (rings[:, :, 0] * nxt[:, :, 1] - nxt[:, :, 0] * rings[:, :, 1]).sum(axis=1)
        ok = _simple(rings)
        for (k, r), s, simple in zip(found, twice.tolist(), ok.tolist()):
            if not simple:
                hard.append((k, [r]))
            elif s != 0:
                by_size.setdefault(n, []).append((k, r if s > 0 else r[::-1], np.ones(n, bool)))
    for k, loops in hard:
        for pts, own in pieces(loops):
            by_size.setdefault(len(pts), []).append((k, pts, own))
    owners, corners, sides = [np.zeros(0, np.int64)], [np.zeros((0, 6))], [np.zeros(0, np.int8)]
    for n, found in by_size.items():
        step = max(1, _CELLS // (n * n))
        for lo in range(0, len(found), step):
            part = found[lo : lo + step]
            ids = np.array([k for k, _, _ in part])
            who, tri, bits, failed = _ears(np.stack([p for _, p, _ in part]), np.stack([b for _, _, b in part]))
            owners.append(ids[who])
            corners.append(tri)
            sides.append(bits)
            for f in failed.tolist():
                bad = who == f  # what was clipped before no ear was left is done again
                owners[-1], corners[-1], sides[-1], who = owners[-1][~bad], corners[-1][~bad], sides[-1][~bad], who[~bad]
                tri = _slabs([part[f][1]])
                owners.append(np.full(len(tri), ids[f]))
                corners.append(tri)
                sides.append(np.full(len(tri), 7, np.int8))
                owners[-1], owners[-2] = owners[-2], owners[-1]
                corners[-1], corners[-2] = corners[-2], corners[-1]
                sides[-1], sides[-2] = sides[-2], sides[-1]
    return np.concatenate(owners), np.concatenate(corners), np.concatenate(sides)


def triangulate(x, y) -> list[tuple]:
    """Triangles (x1, y1, x2, y2, x3, y3, sides) of one ring; see triangulate_many."""
    _, tri, sides = triangulate_many([[clean_ring(np.asarray(x, float), np.asarray(y, float))]])
    return [(*t, int(s)) for t, s in zip(tri.tolist(), sides)]
