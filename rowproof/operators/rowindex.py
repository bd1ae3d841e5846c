"""The unused made rows of one table, searched for the best partner of a gold row by bounds of the rows' score.

Rows are grouped by their cells in the fields whose pairs of cells have known scores and by the kinds of their
other cells; in a group they are sorted by the number of one field.  A group's bound is then known without its
rows, and within it the nearest numbers on either side are the best, so a search visits the groups in order of
their bounds and a few rows of each, whatever their number.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np

#: Scores are rounded to nine digits: sums that are nearer than this, by field, may round to one score.
NEAR = 2e-9
#: Entries of groups' orders that are kept.
KEPT = 1_000_000
STEP = Decimal("1e-9")


def similarity(e: float, v: float) -> float:
    """Of two numbers, as cells are compared."""
    if e == v:
        return 1.0
    return max(0.0, 1 - abs(e - v) / abs(e)) if e != 0 else 0.0


def rounded(x: float) -> float:
    """As Spark rounds a double to nine digits."""
    return float(Decimal(repr(x)).quantize(STEP, ROUND_HALF_UP))


class Group:
    """Rows with the same cells and kinds, by number and in order of the rows."""

    __slots__ = ("at", "cells", "kinds", "left", "order", "queues", "values")

    def __init__(self, cells: tuple, kinds: tuple):
        self.cells, self.kinds, self.order, self.at = cells, kinds, [], 0
        self.left, self.queues, self.values = {}, {}, []

    def first(self) -> int:
        while self.order[self.at] not in self.left:
            self.at += 1
        return self.order[self.at]

    def take(self, m: int) -> None:
        value = self.left.pop(m)
        self.queues[value].pop()  # of equal rows the first one goes
        if not self.queues[value]:
            del self.queues[value]
            if value is not None:
                del self.values[bisect_left(self.values, value)]


class Unused:
    """few: scores of the pairs of cells of some fields; many: the other fields; by: the one of them that is sorted."""

    def __init__(self, few: dict[int, dict[tuple[str, str], float]], many: Sequence[int], by: int | None):
        self.few, self.many, self.by, self.n = few, many, by, len(few) + len(many)
        self.index, self.groups, self.scores, self.orders = {}, [], {}, {}
        self.odd, self.ready = False, False

    def add(self, m: int, cells: tuple, kinds: tuple, x: float) -> None:
        """A made row, in order of m: its cells of the few fields; of the many, 2 * kind + (1 if it is no number); the number."""
        group = self.index.get((cells, kinds))
        if group is None:
            group = self.index[cells, kinds] = Group(cells, kinds)
            self.groups.append(group)
        value = None if self.by is None or kinds[self.many.index(self.by)] & 1 else x
        self.odd |= value is not None and not math.isfinite(value)
        group.order.append(m)
        group.left[m] = value
        group.queues.setdefault(value, []).append(m)

    def _most(self, i: int, a: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a gold cell's kind in a field of many values: each group's bound, and whether it is to be sought by number."""
        bound, sought = np.ones(len(self.groups)), np.zeros(len(self.groups), bool)
        for g, group in enumerate(self.groups):
            b = group.kinds[self.many.index(i)]
            ka, kb = a // 2, b // 2
            if ka == 0 or kb == 0:
                bound[g] = float(ka == kb)
            elif ka == 1 or kb == 1:
                bound[g], sought[g] = float(not (a | b) & 1), i == self.by and not (a | b) & 1
        return bound, sought

    def _field(self, i: int, a: object) -> tuple[np.ndarray, np.ndarray]:
        """Each group's score or bound in a field."""
        if (i, a) not in self.scores:
            known = self.few.get(i)
            place = list(self.few).index(i) if known is not None else None
            self.scores[i, a] = self._most(i, a) if known is None else (np.array([known[a, g.cells[place]] for g in self.groups]), np.zeros(len(self.groups), bool))
        return self.scores[i, a]

    def _order(self, cells: tuple, kinds: tuple) -> tuple[list, list, list, list]:
        """Groups by falling bounds, with their bounds, what is known of them and whether a number is sought."""
        key = (cells, kinds)
        if key not in self.orders:
            fields = [self._field(i, a) for i, a in (*zip(self.few, cells), *zip(self.many, kinds))]
            most, sought = sum(f[0] for f in fields), np.any([f[1] for f in fields], axis=0)
            order = np.argsort(-most, kind="stable")
            if (len(self.orders) + 1) * len(self.groups) > KEPT:
                self.orders.clear()
            self.orders[key] = (order.tolist(), most[order].tolist(), (most - sought)[order].tolist(), sought[order].tolist())
        return self.orders[key]

    def _score(self, cells: tuple, kinds: tuple, g: int, near: float | None) -> float:
        """The score, added up in order of the fields as everywhere."""
        at = dict((*zip(self.few, cells), *zip(self.many, kinds)))
        total = 0.0
        for i in range(self.n):
            total += near if near is not None and i == self.by else float(self._field(i, at[i])[0][g])
        return rounded(total / self.n)

    def take(self, cells: tuple, kinds: tuple, x: float, least: float) -> tuple[float, int] | None:
        """The bound and number of the row of highest bound (ties: the smallest number), which is used from now on."""
        if not self.ready:
            self.ready = True
            for group in self.groups:
                group.values = sorted(v for v in group.queues if v is not None)
                for queue in group.queues.values():
                    queue.reverse()
        near_by = NEAR * self.n
        best = least * self.n - near_by
        found = []  # sum, group, similarity by number (or none), row
        for g, most, base, sought in zip(*self._order(cells, kinds)):
            if most < best - near_by:
                break
            group = self.groups[g]
            if not group.left:
                continue
            if not sought:
                found.append((base, g, None, group.first()))
                best = max(best, base)
                continue
            values = group.values
            i = bisect_left(values, x)
            for side in (range(i, len(values)), range(i - 1, -1, -1)):
                for j in side:
                    s = similarity(x, values[j])
                    if s == 0.0 or base + s < best - near_by:
                        break
                    found.append((base + s, g, s, group.queues[values[j]][-1]))
                    best = max(best, base + s)
            if base >= best - near_by:  # rows whose numbers are not alike at all: the first of them, or one before it
                m = group.first()
                s = similarity(x, group.left[m])
                found.append((base + s, g, s, m))
                best = max(best, base + s)
        picks = [(-self._score(cells, kinds, g, s), m, g) for total, g, s, m in found if total >= best - near_by]
        score, m, g = min(picks, default=(0.0, 0, 0))
        if not picks or -score < least:
            return None
        self.groups[g].take(m)
        return -score, m
