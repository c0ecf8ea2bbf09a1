"""Flow within one block of a raster, in arrays: every cell drains into at most one other, so cells are forests.

Numbered in preorder, all that drains to a cell is a run of numbers. What a border or a shape needs is counted from the
lowest common drains of neighbouring cells; no pair of cells is ever listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from thalweg.functions.rings import area, polygons, stitch

#: Row and column step to the neighbour over each side, and that side's ends from the cell's corner (x1, y1, x2, y2).
SIDES = ((-1, 0, (0, 0, 1, 0)), (0, 1, (1, 0, 1, 1)), (1, 0, (0, 1, 1, 1)), (0, -1, (0, 0, 0, 1)))


class Forest:
    """Cells (r, c) of a block that starts at a row and column, each with a step (dr, dc) down, 0, 0 for none.

    whole: all that drains to the cell lies in the block. It is false for cells below one of `inflow` (places that
    water enters from other blocks), on or above a loop, and for all of a block in which a cell occurs twice.
    leaves: the cell's step goes out of the block. below: the number of the cell that it drains into, n for none.
    """

    def __init__(self, r: np.ndarray, c: np.ndarray, dr: np.ndarray, dc: np.ndarray, inflow: tuple[np.ndarray, np.ndarray], corner: tuple[int, int], edge: int):
        n, wide = len(r), edge + 2
        self.n, self.r, self.c, self.wide, self.corner = n, r, c, wide, corner
        self._at = np.full(wide * wide, n, np.int64)
        self._place = (r - corner[0] + 1) * wide + (c - corner[1] + 1)
        self._at[self._place] = np.arange(n)
        flows = (dr != 0) | (dc != 0)
        to_r, to_c = r + dr - corner[0], c + dc - corner[1]
        self.leaves = flows & ((to_r < 0) | (to_r >= edge) | (to_c < 0) | (to_c >= edge))
        twice = bool((self._at[self._place] != np.arange(n)).any())
        below = np.full(n + 1, n, np.int64)
        if not twice:
            below[:n] = np.where(flows, self._at[self._place + dr * wide + dc], n)
        loops = self._climb(below)[:n] < n
        below[:n][loops] = n
        self.below, self.up = below, [below]
        while (self.up[-1] < n).any():
            self.up.append(self.up[-1][self.up[-1]])
        self._number()
        wet = np.zeros(n, np.int64)
        marked = self.at(*inflow)
        wet[marked[marked < n]] = 1
        self.whole = (self.sums(wet) == 0) & ~loops & (not twice)

    def _climb(self, below: np.ndarray) -> np.ndarray:
        """Where all are after more steps than there are cells."""
        far, steps = below, 1
        while steps <= self.n and (far < self.n).any():
            far, steps = far[far], steps * 2
        return far

    def _number(self) -> None:
        """size: cells that drain to each; tin: preorder numbers, -1 of what all roots drain into."""
        n, size = self.n, np.ones(self.n + 1, np.int64)
        for u in self.up:
            size[:n] += np.bincount(u[:n], weights=size[:n], minlength=n + 1)[:n].astype(np.int64)
        by = np.argsort(self.below[:n], kind="stable")
        before = np.cumsum(size[by]) - size[by]
        new = np.ones(n, bool)
        new[1:] = self.below[by][1:] != self.below[by][:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        tin = np.zeros(n + 1, np.int64)
        tin[by] = 1 + before - before[first] if n else 0
        for u in self.up:
            tin = tin + np.where(u < n, tin[u], 0)
        size[n], tin = n + 1, tin - 1
        self.size, self.tin = size, tin
        self.order = np.empty(n, np.int64)
        self.order[tin[:n]] = np.arange(n)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Of all that drains to each cell, itself included."""
        total = np.append(0, np.cumsum(x[self.order]))
        return total[self.tin[: self.n] + self.size[: self.n]] - total[self.tin[: self.n]]

    def above(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether cells b drain to cells a; to n, all do."""
        return (self.tin[a] <= self.tin[b]) & (self.tin[b] < self.tin[a] + self.size[a])

    def meet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first cell that both a and b drain to, n for none."""
        a, done = a.copy(), self.above(a, b)
        for u in reversed(self.up):
            far = u[a]
            a = np.where(self.above(far, b), a, far)
        return np.where(done, a, self.below[a])

    def at(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The cells at places of the block, n for none."""
        return self._at[(r - self.corner[0] + 1) * self.wide + (c - self.corner[1] + 1)]

    def next_to(self, a: np.ndarray, dr: int, dc: int) -> np.ndarray:
        """The cell beside, n for none of the block."""
        return self._at[self._place[a] + dr * self.wide + dc]

    def borders(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(outlet, cell, side): sides of the border of what drains to each whole cell, each once.

        A cell's side is on the border of all that the cell drains to and its neighbour over that side does not.
        """
        start = np.flatnonzero(self.whole)
        whole = np.append(self.whole, False)
        cell, side = np.tile(start, 4), np.repeat(np.arange(4, dtype=np.int8), len(start))
        # not n itself, whose number all cells' runs miss: -1
        other = self.tin[np.concatenate([self.next_to(start, dr, dc) for dr, dc, _ in SIDES])]
        at = cell
        while True:
            go = whole[at]
            t = self.tin[at]
            go &= ~((t <= other) & (other < t + self.size[at]))
            at, cell, side, other = at[go], cell[go], side[go], other[go]
            if not len(at):
                return
            yield at, cell, side
            at = self.below[at]

    def shapes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cells, sides, plain) of what drains to each cell: plain if it is one ring that nowhere touches itself.

        Such a set hangs together, by corners at least. It has one ring if no corner joins it by the diagonal only, and
        if corners, sides and cells, a side less a cell, add up to 1, as they do without holes.
        """
        n, every = self.n, np.arange(self.n)
        count = lambda *at: self.sums(sum(np.bincount(a, minlength=n + 1)[:n] for a in at))
        left, right, down = (self.next_to(every, *d) for d in ((0, -1), (0, 1), (1, 0)))
        sides = 4 * self.size[:n] - 2 * count(self.meet(every, right), self.meet(every, down))
        fall, rise = self.meet(every, self.next_to(every, 1, 1)), self.meet(every, self.next_to(every, 1, -1))
        inside, touch = 0, 0
        for two, p, q in ((fall, right, down), (rise, left, down)):  # diagonals of four cells, and the other two of these
            third = self.meet(two, p)
            inside = count(self.meet(third, q))
            touch += count(two) - count(third) - count(self.meet(two, q)) + inside
        return self.size[:n], sides, (touch == 0) & (inside + sides // 2 - self.size[:n] == 1)

    def shell(self, o: int) -> np.ndarray:
        """The ring of the largest part of what drains to a cell, as corners (column, row)."""
        cells = self.order[self.tin[o] : self.tin[o] + self.size[o]]
        segments = []
        for dr, dc, ends in SIDES:
            out = cells[~self.above(np.full(len(cells), o), self.next_to(cells, dr, dc))]
            corner = np.stack([self.c[out], self.r[out], self.c[out], self.r[out]], axis=1)
            segments.append(corner + np.array(ends))
        shells = [ring for _, k, ring in polygons(stitch(np.concatenate(segments).astype(float))) if k == 0]
        return max(shells, key=lambda ring: abs(area(ring)))
