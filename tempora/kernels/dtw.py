"""Dynamic time warping over batches of pairs in NumPy.

All pairs of a batch advance together: arrays hold time (and dimension) first and pairs
last, so that the work of one cell is one vector operation over the batch. Shorter series
are padded; every pair's own lengths decide its band and where its result is read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from tempora.settings import DistanceSettings

INF = np.inf


def stacked(series: Sequence, ndim: int) -> tuple[np.ndarray, np.ndarray]:
    """(values: time x [dimension x] pairs, lengths)."""
    arrays = [np.asarray(s, np.float64).reshape(-1) if ndim == 1 else np.asarray(s, np.float64) for s in series]
    n = np.array([len(a) for a in arrays], np.int64)
    top = int(n.max(initial=0))
    if ndim == 1:
        out = np.zeros((top, len(arrays)))
        for k, a in enumerate(arrays):
            out[: len(a), k] = a
    else:
        d = next((a.shape[1] for a in arrays if a.ndim == 2), 1)
        out = np.zeros((top, d, len(arrays)))
        for k, a in enumerate(arrays):
            if len(a):
                out[: len(a), :, k] = a
    return out, n


def dimensions(series: Sequence) -> int:
    """1 for series of numbers, 2 for series of vectors."""
    for s in series:
        if len(s):
            return 2 if np.ndim(s[0]) else 1
    return 1


def row_costs(point: np.ndarray, other: np.ndarray, settings: DistanceSettings) -> np.ndarray:
    """Cost between one point of every pair's first series and all points of its second: time x pairs."""
    if callable(settings.inner):
        return settings.inner(point[None], other)
    diff = other - point[None]
    if diff.ndim == 2:
        return diff * diff if settings.squared else np.abs(diff)
    total = (diff * diff).sum(1)
    return total if settings.squared else np.sqrt(total)


def band(i: int, r: np.ndarray, c: np.ndarray, settings: DistanceSettings) -> tuple[np.ndarray, np.ndarray]:
    """Half-open range of columns allowed in row i, for each pair."""
    w = settings.window or None
    if w is None:
        return np.zeros_like(c), c
    if settings.window_type == "slanted":
        middle = i * c / np.maximum(r, 1)
        return np.maximum(0, np.ceil(middle - w + 1)).astype(np.int64), np.minimum(c, np.floor(middle + w).astype(np.int64))
    return np.maximum(0, i - np.maximum(0, r - c) - w + 1), np.minimum(c, i + np.maximum(0, c - r) + w)


class Sweep:
    """The recurrence over one batch. Keeps two rows, or all of them for paths."""

    def __init__(self, first: Sequence, second: Sequence, settings: DistanceSettings, keep: bool = False, stacks: tuple | None = None):
        """stacks: (values, lengths) of both sides as stacked() gives them, instead of the series."""
        self.s = settings
        if stacks is None:
            ndim = max(dimensions(first), dimensions(second))
            stacks = stacked(first, ndim), stacked(second, ndim)
        (self.a, self.r), (self.b, self.c) = stacks
        self.n, self.m, self.pairs = len(self.a), len(self.b), len(self.r)
        self.table = np.full((self.n + 1, self.m + 1, self.pairs), INF) if keep else None
        self.best = np.full(self.pairs, INF)
        #: (row, column) at which each pair's path ends: its corner, or a relaxed end
        self.end = np.stack([self.r, self.c])
        self._run()

    def _run(self) -> None:
        s, at = self.s, np.arange(self.pairs)
        held, lengths = at, (self.r, self.c)
        begin1, end1, begin2, end2 = s.psi4
        penalty = s.to_cost(s.penalty)
        step = None if s.max_step is None else s.to_cost(s.max_step)
        rows = np.arange(self.m + 1)[:, None]
        previous = np.full((self.m + 1, self.pairs), INF)
        previous[0] = 0
        if begin2:
            previous[(rows <= begin2) & (rows <= self.c)] = 0
        if self.table is not None:
            self.table[0] = previous
        row_tail, column_tail = np.full((2, self.pairs), INF), np.full((2, self.pairs), INF)
        row_tail[1] = column_tail[1] = 0
        self._tails(0, previous, row_tail, column_tail, end1, end2, at)
        current = np.empty_like(previous)
        scratch = np.empty(self.pairs)
        # costs that aren't negative only grow along a path: a pair whose whole row is beyond the limit is given up
        limit = None if s.max_dist is None or self.table is not None or callable(s.inner) else s.to_cost(s.max_dist)
        for i in range(self.n):
            if limit is not None and i:
                alive = (previous.min(0) <= limit) | (row_tail[0] <= limit) | (column_tail[0] <= limit)
                if 2 * np.count_nonzero(alive) < len(alive):
                    if not alive.any():
                        break
                    held = held[alive]
                    self.a, self.b, self.r, self.c = self.a[..., alive], self.b[..., alive], self.r[alive], self.c[alive]
                    previous, current, scratch = previous[:, alive], current[:, alive], scratch[alive]
                    row_tail, column_tail, at = row_tail[:, alive], column_tail[:, alive], np.arange(len(held))
            cost = self.costs(i)
            if step is not None:
                cost = np.where(cost > step, INF, cost)
            if s.window:
                lo, hi = band(i, self.r, self.c, s)
                cols = np.arange(self.m)[:, None]
                cost = np.where((cols >= lo) & (cols < hi), cost, INF)
                first, last = int(lo.min()), int(hi.max())
            else:
                first, last = 0, self.m
            before = np.minimum(previous[:-1], previous[1:] + penalty if penalty else previous[1:])
            current[0] = 0 if i < begin1 else INF
            current[1 : first + 1] = INF
            current[last + 1 :] = INF
            for j in range(first, last):
                if penalty:
                    np.add(current[j], penalty, out=scratch)
                    np.minimum(scratch, before[j], out=scratch)
                else:
                    np.minimum(current[j], before[j], out=scratch)
                np.add(scratch, cost[j], out=current[j + 1])
            if self.table is not None:
                self.table[i + 1] = current
            self._tails(i + 1, current, row_tail, column_tail, end1, end2, at)
            previous, current = current, previous
        if len(held) < self.pairs or limit is not None:
            self.r, self.c = lengths
            tails = np.full((2, 2, self.pairs), INF)
            tails[:, 1] = 0
            tails[0][:, held], tails[1][:, held] = row_tail, column_tail
            row_tail, column_tail = tails
        self._finish(row_tail, column_tail)

    def costs(self, i: int) -> np.ndarray:
        """Point costs of row i: columns x pairs."""
        return row_costs(self.a[i], self.b, self.s)

    def _tails(self, i: int, row: np.ndarray, row_tail: np.ndarray, column_tail: np.ndarray, end1: int, end2: int, at: np.ndarray) -> None:
        """column_tail: least of the last column over rows within end1 of the last; row_tail: of the last row. Later cells win ties."""
        value = row[self.c, at]
        use = (i <= self.r) & (i >= self.r - end1) & (value <= column_tail[0])
        column_tail[0][use], column_tail[1][use] = value[use], i
        if (here := np.flatnonzero(self.r == i)).size:
            cols = np.arange(self.m + 1)[:, None]
            part = np.where((cols >= self.c[here] - end2) & (cols <= self.c[here]), row[:, here], INF)
            last = self.m - part[::-1].argmin(0)
            row_tail[0][here], row_tail[1][here] = part[last, np.arange(len(here))], last

    def _finish(self, row_tail: np.ndarray, column_tail: np.ndarray) -> None:
        by_column = column_tail[0] < row_tail[0]
        self.best = np.where(by_column, column_tail[0], row_tail[0])
        self.end = np.stack([np.where(by_column, column_tail[1], self.r), np.where(by_column, self.c, row_tail[1])]).astype(np.int64)
        if self.s.max_dist is not None:
            self.best = np.where(self.best > self.s.to_cost(self.s.max_dist), INF, self.best)
        if self.s.max_length_diff is not None:
            self.best = np.where(np.abs(self.r - self.c) > self.s.max_length_diff, INF, self.best)

    def distances(self) -> np.ndarray:
        return np.sqrt(self.best) if self.s.squared else self.best

    def paths(self, tie: str = "up", tolerance: float = 0.0, start: np.ndarray | None = None) -> list[np.ndarray]:
        """For each pair the steps (i, j) of its cheapest path, in order; empty where there is none.

        Equal predecessors: the diagonal first, then up (or left, by `tie`); with a tolerance,
        relatively close values count as equal.
        """
        assert self.table is not None
        penalty, at = self.s.to_cost(self.s.penalty), np.arange(self.pairs)
        i, j = (self.end if start is None else start).copy()
        cells = self.table[i, j, at]
        alive = np.isfinite(cells) & (i > 0) & (j > 0)
        if start is None:
            alive &= np.isfinite(self.best)
        trail = []
        order = (2, 1) if tie == "left" else (1, 2)
        while alive.any():
            trail.append((np.where(alive, i - 1, -1), j - 1))
            up, left = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
            options = np.stack([self.table[up, left, at], self.table[up, j, at] + penalty, self.table[i, left, at] + penalty])
            options = options[[0, *order]]
            least = options.min(0)
            close = options <= least + tolerance * np.abs(least)
            pick = np.array([0, *order])[close.argmax(0)]
            i = np.where(alive & (pick != 2), i - 1, i)
            j = np.where(alive & (pick != 1), j - 1, j)
            alive &= (i > 0) & (j > 0)
        if not trail:
            return [np.zeros((0, 2), np.int64)] * self.pairs
        rows, cols = np.stack([t[0] for t in trail])[::-1], np.stack([t[1] for t in trail])[::-1]
        return [np.stack([rows[rows[:, p] >= 0, p], cols[rows[:, p] >= 0, p]], 1) for p in range(self.pairs)]


#: Cells of a kept table, or pairs of two rows, that are worked on at once.
TABLE_CELLS, BATCH_PAIRS = 4_000_000, 4096


def distances(first: Sequence, second: Sequence, settings: DistanceSettings) -> np.ndarray:
    """Distance of each pair, in order. Pairs of like lengths are swept together."""
    size = np.array([len(a) * 100_000 + len(b) for a, b in zip(first, second, strict=True)], np.int64)
    out, order = np.full(len(size), INF), np.argsort(size, kind="stable")
    if settings.max_length_diff is not None:
        order = np.array([k for k in order if abs(len(first[k]) - len(second[k])) <= settings.max_length_diff], np.int64)
    if settings.use_pruning and settings.max_dist is None and settings.upper_bound_holds:
        settings = settings.with_(use_pruning=False)  # the bound can only cut cells, never change a result
    for at in range(0, len(order), BATCH_PAIRS):
        part = order[at : at + BATCH_PAIRS]
        out[part] = Sweep([first[k] for k in part], [second[k] for k in part], settings).distances()
    return out


def distances_among(values: Sequence, first: np.ndarray, second: np.ndarray, settings: DistanceSettings) -> np.ndarray:
    """Distance of each pair of numbers into values: as distances(), but every series is laid out once, not once a pair."""
    out = np.full(len(first), INF)
    if not len(first):
        return out
    stack, n = stacked(values, dimensions(values))
    order = np.lexsort((n[second], n[first]))
    if settings.max_length_diff is not None:
        order = order[np.abs(n[first[order]] - n[second[order]]) <= settings.max_length_diff]
    for at in range(0, len(order), BATCH_PAIRS):
        part = order[at : at + BATCH_PAIRS]
        sides = []
        for side in (first[part], second[part]):
            lengths = n[side]
            sides.append((stack[: int(lengths.max())].take(side, axis=-1), lengths))
        out[part] = Sweep((), (), settings, stacks=tuple(sides)).distances()
    return out


#: Cells of a tile's longest diagonal, and pairs of a tile, that distances_across works on at once: they stay in a core's cache.
TILE_CELLS, TILE_PAIRS, TILE_WIDTH = 32_768, 1024, 256


def across_holds(values: Sequence, settings: DistanceSettings) -> bool:
    """distances_across takes series of numbers, none of them empty, and nothing that closes cells or ends."""
    s = settings
    closed = s.window or s.max_dist is not None or s.max_step is not None or s.max_length_diff is not None or s.psi4 != (0, 0, 0, 0)
    return not closed and not callable(s.inner) and all(len(v) for v in values) and dimensions(values) == 1


def tiles(first: Sequence, second: Sequence, height: int, width: int) -> Iterator[tuple]:
    """(rows, columns, values: time x rows, values: time x columns, lengths, lengths) that cover all pairs of two sets, like lengths together."""
    (a, r), (b, c) = stacked(first, 1), stacked(second, 1)
    rows, cols = np.argsort(r, kind="stable"), np.argsort(c, kind="stable")
    for at in range(0, len(rows), height):
        p = rows[at : at + height]
        for to in range(0, len(cols), width):
            q = cols[to : to + width]
            yield p, q, a[: r[p].max(), p], b[: c[q].max(), q], r[p], c[q]


def distances_across(first: Sequence, second: Sequence, settings: DistanceSettings) -> np.ndarray:
    """Distance of each of the first to each of the second series, as distances() gives them, if across_holds.

    Tiles of pairs are swept by diagonals of the cost table: a diagonal's cells need only the two
    before it, so one vector operation does all of them for all pairs of the tile.
    """
    out = np.full((len(first), len(second)), INF)
    longest = min(max(map(len, first), default=1), max(map(len, second), default=1))
    pairs = max(32, min(TILE_PAIRS, TILE_CELLS // longest))
    width = min(TILE_WIDTH, pairs)
    for p, q, a, b, r, c in tiles(first, second, pairs // width, width):
        out[np.ix_(p, q)] = _swept(a, b, r, c, settings)
    return np.sqrt(out, out=out) if settings.squared else out


def _swept(a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray, settings: DistanceSettings) -> np.ndarray:
    """Accumulated costs of all pairs of two stacks, each read at the pair's own corner."""
    n, m = len(a), len(b)
    penalty = settings.to_cost(settings.penalty)
    point = np.ascontiguousarray(a)[:, :, None]
    other = np.ascontiguousarray(b[::-1])[:, None, :]
    # cell (i, d - i) of diagonal d is held at i + 1 of table d mod 3; borders stay infinite
    held = np.full((3, n + 1, a.shape[1], b.shape[1]), INF)
    held[1, 0] = 0
    costs = np.empty((min(n, m), a.shape[1], b.shape[1]))
    out = np.full(costs.shape[1:], INF)
    corners: dict[int, list] = {}
    for x in np.unique(r).tolist():
        for y in np.unique(c).tolist():
            corners.setdefault(x + y - 2, []).append((x, np.flatnonzero(r == x)[:, None], np.flatnonzero(c == y)[None]))
    for d in range(n + m - 1):
        lo, hi = max(0, d - m + 1), min(n - 1, d)
        cost = costs[: hi - lo + 1]
        np.subtract(point[lo : hi + 1], other[m - 1 - d + lo : m - d + hi], out=cost)
        if settings.squared:
            np.multiply(cost, cost, out=cost)
        else:
            np.abs(cost, out=cost)
        before, last, now = held[(d + 1) % 3], held[(d + 2) % 3], held[d % 3]
        cells = now[lo + 1 : hi + 2]
        np.minimum(last[lo : hi + 1], last[lo + 1 : hi + 2], out=cells)
        if penalty:
            np.add(cells, penalty, out=cells)
        np.minimum(cells, before[lo : hi + 1], out=cells)
        np.add(cells, cost, out=cells)
        if d == 0:
            held[1, 0] = INF
        for x, mine, theirs in corners.get(d, ()):
            out[mine, theirs] = now[x][mine, theirs]
    return out


def euclidean_across(first: Sequence, second: Sequence, settings: DistanceSettings) -> np.ndarray:
    """euclidean() of each of the first and each of the second series of numbers, none of them empty; points are added in order."""
    out = np.empty((len(first), len(second)))
    for p, q, a, b, r, c in tiles(first, second, 64, TILE_WIDTH):
        size = np.maximum(r[:, None], c[None])
        every, total = size.min(), np.zeros((len(p), len(q)))
        point = np.empty_like(total)
        for t in range(size.max()):
            x, y = a[np.minimum(t, r - 1), np.arange(len(p))], b[np.minimum(t, c - 1), np.arange(len(q))]
            np.subtract(x[:, None], y[None], out=point)
            if settings.squared:
                np.multiply(point, point, out=point)
            else:
                np.abs(point, out=point)
            if t >= every:
                point[t >= size] = 0
            total += point
        out[np.ix_(p, q)] = total
    return np.sqrt(out, out=out) if settings.squared else out


def warped(first: Sequence, second: Sequence, settings: DistanceSettings, tie: str = "up") -> tuple[np.ndarray, list[np.ndarray]]:
    """Distances and paths; tables are kept for as many pairs at once as TABLE_CELLS allows."""
    out, trails = np.full(len(first), INF), []
    cells = max((len(a) + 1) * (len(b) + 1) for a, b in zip(first, second, strict=True)) if len(first) else 1
    if cells > 4 * TABLE_CELLS and settings.psi4 == (0, 0, 0, 0) and not settings.window and settings.max_step is None and dimensions(first) == 1:
        for k, (a, b) in enumerate(zip(first, second, strict=True)):
            path = divided_path(np.asarray(a, float), np.asarray(b, float), settings)
            trails.append(path)
            out[k] = path_distance(a, b, path, settings)
        return out, trails
    per = max(1, TABLE_CELLS // cells)
    for at in range(0, len(first), per):
        sweep = Sweep(first[at : at + per], second[at : at + per], settings, keep=True)
        out[at : at + per] = sweep.distances()
        trails += sweep.paths(tie)
    return out, trails


def path_distance(a: Sequence, b: Sequence, path: np.ndarray, settings: DistanceSettings) -> float:
    """Cost of a given path, penalties included, as a distance."""
    if not len(path):
        return INF
    diff = np.asarray(a, float)[path[:, 0]] - np.asarray(b, float)[path[:, 1]]
    point = diff * diff if settings.squared else np.abs(diff)
    turns = int((np.diff(path, axis=0).sum(1) == 1).sum())
    total = float(point.sum()) + turns * settings.to_cost(settings.penalty)
    return float(np.sqrt(total)) if settings.squared else total


def divided_path(a: np.ndarray, b: np.ndarray, settings: DistanceSettings) -> np.ndarray:
    """A cheapest path in memory linear in the lengths: halves are joined where their costs add up least."""
    if len(a) * len(b) <= TABLE_CELLS or len(a) < 2:
        return Sweep([a], [b], settings, keep=True).paths()[0]
    mid = len(a) // 2
    penalty = settings.to_cost(settings.penalty)
    head, tail = last_row(a[:mid], b, settings), last_row(a[mid:][::-1], b[::-1], settings)[::-1]
    # the first half ends at column j; the second begins at j (a step up) or at j + 1 (a diagonal)
    stay, go = head + tail + penalty, head[:-1] + tail[1:]
    j = int(stay.argmin())
    if len(go) and go.min() <= stay[j]:
        j = int(go.argmin())
        cut = j + 1
    else:
        cut = j
    first, second = divided_path(a[:mid], b[: j + 1], settings), divided_path(a[mid:], b[cut:], settings)
    return np.concatenate([first, second + [mid, cut]])


def last_row(a: np.ndarray, b: np.ndarray, settings: DistanceSettings) -> np.ndarray:
    """Costs of aligning all of a with each prefix of b."""
    penalty, row = settings.to_cost(settings.penalty), np.full(len(b) + 1, INF)
    row[0] = 0
    for x in a:
        cost = (b - x) ** 2 if settings.squared else np.abs(b - x)
        before = np.minimum(row[:-1], row[1:] + penalty)
        now = np.empty(len(b) + 1)
        now[0] = held = INF
        for j, (least, c) in enumerate(zip(before.tolist(), cost.tolist(), strict=True)):
            held = c + (least if least < held + penalty else held + penalty)
            now[j + 1] = held
        row = now
    return row[1:]


def envelope_bound(a: np.ndarray, b: np.ndarray, settings: DistanceSettings) -> float:
    """How far a lies outside of the running minima and maxima of b: a lower bound of the distance."""
    w = settings.window or max(len(a), len(b))
    back, ahead = max(0, len(a) - len(b)) + w - 1, max(0, len(b) - len(a)) + w
    total = 0.0
    for i, x in enumerate(a):
        part = b[max(0, i - back) : min(len(b), i + ahead)]
        if len(part):
            off = max(x - part.max(), part.min() - x, 0.0)
            total += off * off if settings.squared else off
    return float(np.sqrt(total)) if settings.squared else total


def envelope_bounds(a: np.ndarray, others: Sequence, settings: DistanceSettings) -> np.ndarray:
    """envelope_bound() of a and each of the others: one vector operation for each point of a."""
    stack, lengths = stacked(others, 1)
    out = np.zeros(len(lengths))
    for m in np.unique(lengths).tolist():
        mine = np.flatnonzero(lengths == m)
        part = stack[:m].take(mine, axis=1)
        w = settings.window or max(len(a), m)
        back, ahead = max(0, len(a) - m) + w - 1, max(0, m - len(a)) + w
        for i, x in enumerate(a):
            near = part[max(0, i - back) : min(m, i + ahead)]
            if len(near):
                off = np.maximum(np.maximum(x - near.max(0), near.min(0) - x), 0.0)
                out[mine] += off * off if settings.squared else off
    return np.sqrt(out) if settings.squared else out


def euclidean(a: np.ndarray, b: np.ndarray, settings: DistanceSettings) -> float:
    """Point by point; the rest of the longer series is compared to the last point of the shorter."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    n = max(len(a), len(b))
    if not len(a) or not len(b):
        return 0.0 if n == 0 else INF
    i = np.arange(n)
    diff = a[np.minimum(i, len(a) - 1)] - b[np.minimum(i, len(b) - 1)]
    point = diff * diff if diff.ndim == 1 else (diff * diff).sum(1)
    return float(np.sqrt(point.sum())) if settings.squared else float(np.sqrt(point).sum())


def sampled_path(a: Sequence, b: Sequence, settings: DistanceSettings, average: float, seed: int) -> np.ndarray:
    """A path drawn at random from its end: cheaper predecessors are likelier, p ~ 1 / (average + most - gain)."""
    table = Sweep([a], [b], settings, keep=True).table[:, :, 0]
    r, i, j, out = np.random.default_rng(seed), len(a), len(b), []
    average = average or 1.0
    while i > 0 and j > 0:
        out.append((i - 1, j - 1))
        moves = [(i - 1, j - 1), (i - 1, j), (i, j - 1)]
        gain = np.array([table[i, j] - table[m] for m in moves])
        open_ = np.isfinite(gain)
        if not open_.any():
            break
        weight = np.where(open_, 1 / (average + gain[open_].max() - np.where(open_, gain, 0)), 0)
        i, j = moves[int(r.choice(3, p=weight / weight.sum()))]
    return np.array(out[::-1], np.int64).reshape(-1, 2)


def affinity_table(a: np.ndarray, b: np.ndarray, gamma: float, tau: float, delta: float, delta_factor: float, penalty: float = 0.0, window: int | None = None, only_triu: bool = False, steps: str = "typeI") -> np.ndarray:
    """Accumulated affinity: similar points add up along a path, others wear it down; -inf is out of reach.

    steps: typeI (diagonal, up, left), typeIII (diagonal, two rows, two columns) or diagonal.
    """
    a, b = np.asarray(a, float), np.asarray(b, float)
    return affinity_stack(a[:, None], b[:, None], gamma, tau, delta, delta_factor, penalty, window, only_triu, steps)[0]


def affinity_stack(a: np.ndarray, b: np.ndarray, gamma, tau, delta, delta_factor, penalty=0.0, window: int | None = None, only_triu: bool = False, steps: str = "typeI") -> np.ndarray:
    """affinity_table() of each pair of two stacks (time x pairs [x dimension]): pairs x rows x columns; parameters may differ by pair.

    The table is made by its diagonals, all pairs together.
    """
    n, m, pairs = len(a), len(b), a.shape[1]
    pad = 2 if steps == "typeIII" else 1
    # cell (row, column) is held at (row + column, row), so that the table is a view of the diagonals
    held = np.zeros((n + m + 2 * pad - 1, n + pad, pairs))
    other = b[::-1]
    over, under = max(0, n - m), max(0, m - n)
    for d in range(2 * pad, len(held)):
        lo, hi = max(pad, d - m - pad + 1), min(n + pad - 1, d - pad)
        first, last = lo, min(hi, d // 2) if only_triu else hi
        if window:
            first = max(first, (d - 2 * pad - under - window) // 2 + 1 + pad)
            last = min(last, (d - 2 * pad + over + window - 1) // 2 + pad)
        now = held[d]
        now[lo : max(lo, first)] = now[max(lo, last + 1) : hi + 1] = -INF
        if first > last:
            now[lo : hi + 1] = -INF
            continue
        at = m - 1 - d + first + pad
        diff = other[at : at + last - first + 1] - a[first - pad : last + 1 - pad]
        sim = np.exp(-gamma * (diff * diff if diff.ndim == 2 else (diff * diff).sum(2)))
        best = np.maximum(held[d - 2][first - 1 : last], 0.0)
        if steps == "typeI":
            np.maximum(best, np.maximum(held[d - 1][first - 1 : last], held[d - 1][first : last + 1]) - penalty, out=best)
        elif steps == "typeIII":
            np.maximum(best, np.maximum(held[d - 3][first - 1 : last], held[d - 3][first - 2 : last - 1]) - penalty, out=best)
        np.fmax(np.where(sim < tau, delta + delta_factor * best, sim + best), 0.0, out=now[first : last + 1])
    by_diagonal, by_row, by_pair = held.strides
    table = np.lib.stride_tricks.as_strided(held, (n + pad, m + pad, pairs), (by_diagonal + by_row, by_diagonal, by_pair), writeable=False)
    return np.ascontiguousarray(table.transpose(2, 0, 1))


def step_moves(steps: str) -> tuple[tuple[int, int], ...]:
    """Rows and columns that each allowed step goes back; the diagonal first."""
    return {"typeI": ((1, 1), (1, 0), (0, 1)), "typeIII": ((1, 1), (1, 2), (2, 1)), "diagonal": ((1, 1),)}[steps]


def traced(table: np.ndarray, row: int | None = None, col: int | None = None, largest: bool = False, penalty: float = 0.0, tie: str = "up", tolerance: float = 0.0) -> list[tuple[int, int]]:
    """The path through a table with borders, back from a cell (the corner if none is given), without the border.

    Predecessors: the least (or largest), the diagonal first among equals. Cells below 0 are
    closed: they mark what was skipped or taken.
    """
    i, j = len(table) - 1 if row is None else row, table.shape[1] - 1 if col is None else col
    out = []
    while i > 0 and j > 0:
        out.append((i - 1, j - 1))
        moves = [(0.0, i - 1, j - 1), (penalty, i - 1, j), (penalty, i, j - 1)]
        if tie == "left":
            moves[1:] = moves[:0:-1]
        sign = -1.0 if largest else 1.0
        costs = [sign * (table[p, q] + sign * x) if table[p, q] >= 0 else INF for x, p, q in moves]
        least = min(costs)
        if not np.isfinite(least):
            break
        k = next(n for n, c in enumerate(costs) if c <= least + tolerance * abs(least))
        _, i, j = moves[k]
    return out[::-1]


def table_of(a: Sequence, b: Sequence, settings: DistanceSettings, mark_skipped: bool = True) -> tuple[float, np.ndarray]:
    """(distance, table as distances, border first). Cells that the relaxed end skips are -1."""
    sweep = Sweep([a], [b], settings, keep=True)
    table = sweep.table[:, :, 0].copy()
    out = np.sqrt(table) if settings.squared else table
    i, j = sweep.end[:, 0]
    if mark_skipped:
        if i < len(a):
            out[i + 1 :, -1] = -1
        if j < len(b):
            out[-1, j + 1 :] = -1
    return float(sweep.distances()[0]), out


def penalised_afterwards(a: Sequence, b: Sequence, settings: DistanceSettings, penalty: float) -> tuple[float, np.ndarray, list[tuple[int, int]]]:
    """(distance, path, steps): the cheapest path's distance plus a penalty for each step that isn't diagonal."""
    (d,), (path,) = warped([a], [b], settings)
    steps = [tuple(s) for s in np.diff(path, axis=0).tolist()]
    return float(d) + penalty * sum(s != (1, 1) for s in steps), path, steps
