"""Edit distance within a band of diagonals."""

from __future__ import annotations

import numpy as np


def banded_distance(a: np.ndarray, b: np.ndarray, budget: int, least: int = 0) -> int | None:
    """Unit-cost edit distance of two integer sequences, or none if it exceeds ``budget``.

    Only diagonals within a band are looked at. The band starts narrow, somewhat beyond ``least`` (edits known
    to be needed), and widens until the distance fits into it or the budget is reached, so that near copies cost little.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > budget:
        return None
    same = len(a)
    head = int(np.argmin(np.append(a == b[:same], False)))  # equal ends cost nothing
    a, b = a[head:], b[head:]
    same = len(a)
    tail = int(np.argmin(np.append(a[::-1] == b[len(b) - same :][::-1], False)))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    n, m = len(a), len(b)
    if not n or not budget:
        return m if m <= budget else None
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    rest = b.tolist()
    budget = min(budget, m)
    band = min(budget, max(8, 2 * (m - n), least + least // 4))
    while True:
        found = _in_band(places, n, rest, band)
        if found is not None or band == budget:
            return found
        band = min(budget, 3 * band)


def _in_band(places: dict[int, int], n: int, b: list[int], band: int) -> int | None:
    """The distance if it is within the band: the cells of a column of the band are the bits of whole numbers.

    Bit t of column j is row j - band + t; ``more`` and ``less`` have the bits whose cell is one above or below
    the cell before it in the column, ``level`` those that equal their neighbour on the diagonal. A column
    follows from the one before by a few operations on all bits together. Cells just outside the band count as
    one more than their neighbours inside, which no path within the band needs.
    """
    m, width = len(b), 2 * band + 1
    mask, top, goal = (1 << width) - 1, 1 << (2 * band), n - m + band
    more, less, distance = mask >> (band + 1) << (band + 1), 0, m - n
    places = {x: p << band for x, p in places.items()}
    for j, x in enumerate(b):
        same = (places.get(x, 0) >> j) & mask
        more, less = more >> 1 | top, less >> 1
        level = ((((same & more) + more) ^ more) | same | less) & mask
        right_more = less | (mask & ~(level | more))
        right_less = level & more
        right_more = right_more << 1 | 1
        more = (right_less << 1 | ~(level | right_more)) & mask
        less = level & right_more & mask
        if j >= m - n and not level >> goal & 1:
            distance += 1
            if distance > band:
                return None
    return distance


def best_window(item: np.ndarray, text: np.ndarray, budget: int) -> tuple[int, int, int] | None:
    """Where ``item`` fits best into ``text``: edits, first and end position; none beyond the budget.

    The whole item must be used, text before and after the window is free; the caller gives a text
    no longer than the band of diagonals it has found, so the table is the band. Of equally good ends the
    first counts, of its starts the last.
    """
    m = len(text)
    at = np.arange(m + 1)
    row = np.zeros(m + 1, dtype=np.int64)
    start = at.copy()
    for i in range(1, len(item) + 1):
        # candidates: diagonal, up; then insertions by running minimum over (value - position, later start first)
        value, origin = row + 1, start.copy()
        diagonal = row[:-1] + (text != item[i - 1])
        take = diagonal <= value[1:]
        value[1:][take] = diagonal[take]
        origin[1:][take] = start[:-1][take]
        key = (value - at) * (m + 2) + (m - origin)
        best = np.minimum.accumulate(key)
        value = np.floor_divide(best, m + 2)
        origin = m - (best - value * (m + 2))
        row, start = value + at, origin
    end = int(row.argmin())
    return (int(row[end]), int(start[end]), end) if row[end] <= budget else None
