"""Lines of sight on a grid, for pandas functions inside tasks: all target cells at once."""

from __future__ import annotations

import numpy as np


def visible(blocked: np.ndarray, row: int, column: int) -> np.ndarray:
    """Cells of a boolean grid that a sensor sees along supercover lines between cell centres.

    The sensor's and the target's own cells never block.  Where a line passes
    exactly through a corner, either side cell blocks it.  All lines advance
    together, a cell border a step.
    """
    height, width = blocked.shape
    to_row, to_col = (x.ravel() for x in np.mgrid[:height, :width])
    rows, cols = np.abs(to_row - row), np.abs(to_col - column)
    up, right = np.where(to_row > row, 1, -1), np.where(to_col > column, 1, -1)
    r, c = np.full(len(rows), row), np.full(len(rows), column)
    done_r, done_c, seen = np.zeros_like(rows), np.zeros_like(cols), np.ones(len(rows), bool)

    def stands(at_row: np.ndarray, at_col: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Whether a cell other than the line's target blocks."""
        return blocked[at_row, at_col] & ((at_row != to_row[some]) | (at_col != to_col[some]))

    while len(some := np.flatnonzero(seen & ((done_r < rows) | (done_c < cols)))):
        # Which border comes next: (done + 1/2) / rows of the way for rows, likewise for columns.
        side = (1 + 2 * done_c[some]) * rows[some] - (1 + 2 * done_r[some]) * cols[some]
        corner = some[side == 0]
        seen[corner] &= ~(stands(r[corner] + up[corner], c[corner], corner) | stands(r[corner], c[corner] + right[corner], corner))
        over_row, over_col = some[side >= 0], some[side <= 0]
        r[over_row] += up[over_row]
        done_r[over_row] += 1
        c[over_col] += right[over_col]
        done_c[over_col] += 1
        seen[some] &= ~stands(r[some], c[some], some)
    return seen.reshape(height, width)
