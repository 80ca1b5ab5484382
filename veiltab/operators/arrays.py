"""Edits over arrays: new values, their bins, the exact change of the distance and the choice of an edit.

Numpy over Arrow batches, inside Spark's tasks. A batch has the rows of a round as ``Edits`` deals and draws
them; potentials come as one array over all finest cells. Bins and numbers of columns that are NULL are -1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from veiltab.operators.domain import CATEGORICAL, CONTINUOUS, ORDINAL

MADE = ["x1", "x2", "y1", "y2"]


def numbers(col: pa.Array) -> np.ndarray:
    """Whole numbers, -1 for NULL."""
    return pc.fill_null(col, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def slots(col: pa.Array, width: int, none: float) -> np.ndarray:
    """Rows of an array column, ``none`` for NULL."""
    return pc.fill_null(col.flatten(), none).to_numpy(zero_copy_only=False).reshape(-1, width)


def padded(lists: list, none: float) -> np.ndarray:
    out = np.full((len(lists), max(map(len, lists), default=0) + 2), none)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


class Values:
    """New values of edited columns, and their finest bins."""

    def __init__(self, edits, quantiles: list[list[float]]):
        cols, depth = edits.domain.columns, edits.marginals.depth
        self.code, self.quantiles = edits.code, np.array(quantiles, float)
        self.last = self.quantiles.shape[1] - 1  # intervals between quantiles
        self.finest = np.array([c.finest(depth) for c in cols])
        self.bins = self.finest + np.array([c.has_nulls for c in cols])
        self.whole = np.array([c.role != CONTINUOUS for c in cols])
        self.top = np.array([float(c.size - 1) for c in cols])
        self.zeros = np.array([c.sparse and c.role == CONTINUOUS for c in cols])
        self.direct = [c.role == CATEGORICAL or (c.role == ORDINAL and c.edges is None) for c in cols]
        self.edges = [None if d else np.array(c.bin_edges(depth), float) for c, d in zip(cols, self.direct)]
        self.inner = padded([[] if d else e if c.role == CONTINUOUS else np.ceil(e) for c, e, d in zip(cols, self.edges, self.direct)], np.nan)

    def inside(self, col: np.ndarray, i: np.ndarray, u: np.ndarray) -> np.ndarray:
        """A value in finest bin ``i``, NaN for none."""
        real = (col >= 0) & (i >= 0)
        real &= i < self.finest[col]
        at = np.clip(i, 0, self.inner.shape[1] - 2)
        left, right = self.inner[col, at], self.inner[col, at + 1]
        stepped = np.minimum(left + np.floor(u * np.fmax(right - left, 1.0)), self.top[col])
        within = left + u * (right - left)
        half = np.where(u < 0.5, 0.0, left + (2.0 * u - 1.0) * (right - left))
        within = np.where(self.zeros[col] & (left <= 0) & (right > 0), half, within)
        out = np.where(np.isnan(left), i, np.where(self.whole[col], stepped, within))
        return np.where(real, out, np.nan)

    def between(self, col: np.ndarray, ua: np.ndarray, ub: np.ndarray) -> np.ndarray:
        """A value between two quantiles of the column."""
        j = np.floor(ua * self.last).astype(np.int64)
        low, high = self.quantiles[col, j], self.quantiles[col, j + 1]
        x = low + ub * (high - low)
        return np.where(col < 0, np.nan, np.where(self.whole[col], np.minimum(np.floor(x), self.top[col]), x))

    def bin(self, col: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Finest bin of a value, that of NULL for NaN."""
        out = np.full(len(col), -1)
        for c, edges in enumerate(self.edges):
            own = np.flatnonzero(col == c)
            v = x[own]
            none = np.isnan(v)
            if self.direct[c]:
                b = np.where(none, 0, v).astype(np.int64)
            else:
                b = np.clip(np.searchsorted(edges, v, "right") - 1, 0, self.finest[c] - 1)
            out[own] = np.where(none, self.finest[c], b)
        return out

    def of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """x1, x2, y1, y2 of a batch with op, c1, c2, i1, i2, ua, ub, ub2, pv and pb."""
        col = {n: batch.column(batch.schema.names.index(n)) for n in ("op", "c1", "c2", "i1", "i2", "ua", "ub", "ub2", "pv", "pb")}
        whole = (numbers(col[n]) for n in ("op", "c1", "c2", "i1", "i2"))
        drawn = (col[n].to_numpy(zero_copy_only=False) for n in ("ua", "ub", "ub2"))
        width = len(self.finest)
        return self.make(*whole, *drawn, slots(col["pv"], width, np.nan), slots(col["pb"], width, -1))

    def make(self, op, c1, c2, i1, i2, ua, ub, ub2, pv, pb) -> tuple[np.ndarray, ...]:
        """x1, x2, y1, y2 of edits; pv and pb are the partner's values and bins."""
        rows, code = np.arange(len(op)), self.code
        filled = (op == code["fill"]) & (op >= 0)
        i = np.where(filled, i1, np.floor(ua * self.bins[c1]).astype(np.int64))
        own = (op >= 0) & ((op == code["mutate"]) | filled)
        x1 = np.where(c1 < 0, np.nan, pv[rows, c1])
        x1 = np.where(own, self.inside(c1, i, ub), x1)
        spread = (op >= 0) & (op == code["continuous"])
        x1 = np.where(spread, self.between(c1, ua, ub), x1)
        x2 = np.where(filled, self.inside(c2, i2, ub2), np.where(c2 < 0, np.nan, pv[rows, c2]))
        y1 = np.where(own | spread, self.bin(c1, x1), np.where(c1 < 0, -1, pb[rows, c1]))
        y2 = np.where(filled, self.bin(c2, x2), np.where(c2 < 0, -1, pb[rows, c2]))
        return x1, x2, y1, y2

    @staticmethod
    def columns(made: tuple[np.ndarray, ...]) -> list[pa.Array]:
        x1, x2, y1, y2 = made
        return [
            *(pa.array(x, pa.float64(), mask=np.isnan(x)) for x in (x1, x2)),
            *(pa.array(y.astype(np.int32), mask=y < 0) for y in (y1, y2)),
        ]

    def run(self, keep: list[str]):
        """For mapInArrow: the columns ``keep`` and x1, x2, y1, y2."""

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [batch.column(batch.schema.names.index(n)) for n in keep]
                yield pa.RecordBatch.from_arrays([*own, *self.columns(self.of(batch))], [*keep, *MADE])

        return made


def places(edits) -> tuple[list[tuple], dict[int, int], int]:
    """Sets as (members, strides, first cell, module, parameters), the first cell by id, and the number of finest cells."""
    targets, m = edits.targets, edits.marginals
    sets, start, at = [], {}, 0
    for w in m.workloads:
        if w.set_id not in start:
            widths = [d.width0 for d in w.dims]
            strides = [math.prod(widths[i + 1 :]) for i in range(len(widths))]
            sets.append(([d.pos for d in w.dims], strides, at, None, None))
            start[w.set_id], at = at, at + math.prod(widths)
    for kind, ids, names, n, par in targets.rows:
        sets.append(([edits.domain.position(x) for x in names], [], at, targets.others[kind - 1], par))
        start[ids], at = at, at + n  # ids above those of sets
    return sets, start, at


def potentials_of(edits, potentials: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Potentials (key, p, levels) as arrays over all finest cells."""
    _, start, cells = places(edits)
    shift = edits.marginals.shift
    key, p, levels = (potentials.column(n).to_numpy() for n in ("key", "p", "levels"))
    first = np.zeros(max(start) + 1, np.int64)
    first[list(start)] = list(start.values())
    place = first[key >> shift] + (key & ((1 << shift) - 1))
    out, bits = np.zeros(cells), np.zeros(cells, np.int64)
    out[place], bits[place] = p, levels
    return out, bits


class Scores:
    """Exact change of the squared distance by single edits, from potentials of all finest cells."""

    def __init__(self, edits, p: np.ndarray, levels: np.ndarray):
        """``p`` and ``levels``: potentials of all finest cells, those of the sets in turn, then of other modules."""
        targets, m = edits.targets, edits.marginals
        cols, self.depth, self.swap, self.candidates = edits.domain.columns, m.depth, edits.code["swap"], edits.candidates
        self.unit, self.width, self.levels_all = 1.0 / float(edits.n_rows) / float(edits.n_rows), len(cols), (1 << m.depth) - 1
        finest = [c.finest(m.depth) for c in cols]
        self.merged = np.zeros((m.depth, len(cols), max(finest) + 2), np.int64)
        for v in range(m.depth):
            for c, col in enumerate(cols):
                stride, n = col.coarse(m.depth, v)
                self.merged[v, c, : finest[c]] = np.minimum(np.arange(finest[c]) // stride, n - 1)
                self.merged[v, c, finest[c]] = n
                self.merged[v, c, -1] = n - 1  # no bin, as the joins have it
        self.sets, _, _ = places(edits)  # (members, strides, first cell, module, parameters)
        self.p, self.levels = p, levels

    def moved(self, col: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Levels on which a column changes its bin, as bits."""
        real, out = col >= 0, np.zeros(len(col), np.int64)
        for v in range(self.depth):
            out |= (real & (self.merged[v, col, old] != self.merged[v, col, new])).astype(np.int64) << v
        return out

    @staticmethod
    def edited(v, b, c1, c2, x1, x2, y1, y2) -> tuple[np.ndarray, np.ndarray]:
        nv, nb = v.copy(), b.copy()
        for c, x, y in ((c1, x1, y1), (c2, x2, y2)):
            at = np.flatnonzero(c >= 0)
            nv[at, c[at]], nb[at, c[at]] = x[at], y[at]
        return nv, nb

    def cells_of(self, v, b, nv, nb) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per set its first cell, and the cells of the rows before and after."""
        for members, strides, start, module, par in self.sets:
            if module is None:
                yield start, *(self.cell(x[:, members], strides) for x in (b, nb))
            else:
                yield start, *(module.cells([x[:, pos] for pos in members], par) for x in (v, nv))

    def own(self, v, b, pb, op, c1, c2, x1, x2, y1, y2) -> np.ndarray:
        """Change by each row's own move."""
        rows, some = np.arange(len(op)), c1 >= 0
        nv, nb = self.edited(v, b, c1, c2, x1, x2, y1, y2)
        m1 = self.moved(c1, b[rows, c1], y1)
        m2 = self.moved(c2, b[rows, c2], y2)
        same = np.zeros((len(op), self.width), np.int64)
        swaps = np.flatnonzero((op >= 0) & (op == self.swap))
        if len(swaps):
            one, two, column = b[swaps], pb[swaps], np.arange(self.width)[None, :]
            for level in range(self.depth):
                equal = self.merged[level, column, one] == self.merged[level, column, two]
                same[swaps] |= equal.astype(np.int64) << level
        is_swap = np.zeros(len(op), bool)
        is_swap[swaps] = True
        total = np.zeros(len(op))
        by_first = [np.flatnonzero(some & (c1 == i)) for i in range(self.width)]
        by_second = [np.flatnonzero(c2 == i) for i in range(self.width)]
        for members, strides, start, module, par in self.sets:
            inside = np.zeros(self.width + 1, bool)
            inside[members] = True
            firsts = np.concatenate([by_first[i] for i in dict.fromkeys(members)])
            seconds = np.concatenate([by_second[i] for i in dict.fromkeys(members)])
            seconds = seconds[~inside[c1[seconds]]]
            r = np.concatenate([firsts, seconds])
            if not len(r):
                continue
            if module is None:
                levels = np.concatenate([m1[firsts] | np.where(inside[c2[firsts]], m2[firsts], 0), m2[seconds]])
                agree = np.where(is_swap[r], self.levels_all, 0)
                for pos in members:
                    agree &= np.where(c1[r] == pos, self.levels_all, same[r, pos])
                levels &= ~agree
                r, levels = r[levels > 0], levels[levels > 0]
                old, new = (self.cell(x[r][:, members], strides) for x in (b, nb))
            else:
                old, new = (module.cells([x[r, pos] for pos in members], par) for x in (v, nv))
                go = old != new
                if len(members) == 1:  # a swap doesn't change how many rows have a value
                    go &= ~is_swap[r]
                r, old, new = r[go], old[go], new[go]
                levels = np.ones(len(r), np.int64)
            gain = np.zeros(len(r))
            for cell, sign in ((old, 1.0), (new, -1.0)):
                real, at = cell >= 0, np.maximum(cell, 0) + start
                gain += np.where(real, sign * self.p[at] + np.bitwise_count(self.levels[at] & levels) * self.unit, 0.0)
            total[r] += gain
        return total

    @staticmethod
    def cell(bins: np.ndarray, strides: list[int]) -> np.ndarray:
        return np.where((bins >= 0).all(axis=1), bins @ np.array(strides, np.int64), -1)

    def change(self, v, b, pv, pb, op, c1, c2, x1, x2, y1, y2) -> np.ndarray:
        """Change by each unit: a row's move, or both of a swap."""
        out = self.own(v, b, pb, op, c1, c2, x1, x2, y1, y2)
        s = np.flatnonzero((op >= 0) & (op == self.swap))
        if len(s):
            c = c1[s]
            out[s] += self.own(pv[s], pb[s], b[s], op[s], c, c2[s], v[s, c], x2[s], b[s, c], y2[s])
        return out

    def chosen(self, pair: np.ndarray, side: np.ndarray, op: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the edits that rows choose, and their changes: the pair's best swap, or the best edit of each row on its own.

        Edits come by pair, side and candidate.
        """
        many = self.candidates
        if many == 1:
            return np.arange(len(op)), change
        op, score = op.reshape(-1, many), change.reshape(-1, many)
        pair, side = pair[::many], side[::many]
        swap = (op >= 0) & (op == self.swap)
        alone = np.where((op >= 0) & ~swap, score, np.inf)
        joint = np.where(swap, score, np.inf)
        rows = np.arange(len(op))
        best, both = alone.argmin(axis=1), joint.argmin(axis=1)
        gain = np.minimum(alone[rows, best], 0.0)
        first = np.flatnonzero(side == 0)
        of = np.searchsorted(first, rows, "right") - 1  # the pair of each row
        together = joint[rows, both] < np.bincount(of, gain, len(first))[of]
        mine = np.where(np.isfinite(alone[rows, best]), best, np.where(np.isfinite(joint[rows, both]), both, 0))
        cand = np.where(together, both, mine)
        taken = score[rows, cand]
        # a row left with a swap its partner did not choose keeps its values
        return rows * many + cand, np.where(swap[rows, cand] & ~together, 0.0, taken)

    def run(self, values: Values, keep: list[str]):
        """For mapInArrow over edits by pair, side and candidate: the columns ``keep``, x1, x2, y1, y2 and change of the chosen ones."""

        def score(batch: pa.RecordBatch) -> pa.RecordBatch:
            col = dict(zip(batch.schema.names, batch.columns))
            op, c1, c2, pair, side = (numbers(col[n]) for n in ("op", "c1", "c2", "pair_id", "side"))
            v, pv = (slots(col[n], self.width, np.nan) for n in ("v", "pv"))
            b, pb = (slots(col[n], self.width, -1).astype(np.int64) for n in ("b", "pb"))
            made = values.of(batch)
            take, change = self.chosen(pair, side, op, self.change(v, b, pv, pb, op, c1, c2, *made))
            own = pa.RecordBatch.from_arrays([*(col[n] for n in keep), *values.columns(made)], [*keep, *MADE]).take(pa.array(take))
            return pa.RecordBatch.from_arrays([*own.columns, pa.array(change)], [*keep, *MADE, "change"])

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            left = None  # edits of the last pair, which may go on in the next batch
            for batch in batches:
                if left is not None:
                    batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
                if not batch.num_rows:
                    continue
                pair = numbers(batch.column(batch.schema.names.index("pair_id")))
                end = int(np.flatnonzero(pair != pair[-1])[-1]) + 1 if (pair != pair[-1]).any() else 0
                left = batch.slice(end)
                if end:
                    yield score(batch.slice(0, end))
            if left is not None:
                yield score(left)

        return scored
