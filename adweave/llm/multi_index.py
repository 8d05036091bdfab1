"""An inverted multi-index: codebooks of vector halves, their product grid, and its traversal, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Rounds of k-means of a codebook.
FIT_ROUNDS = 10


def unit(x: np.ndarray) -> np.ndarray:
    """The rows of x (finite, none zero) at length 1, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def squared(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ codes.T) + (codes * codes).sum(1), 0)


def codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Up to k distinct centroids of the rows of x."""
    codes = np.unique(x[rng.choice(len(x), min(k, len(x)), replace=False)], axis=0)
    for _ in range(FIT_ROUNDS):
        at = squared(x, codes).argmin(1)
        n = np.bincount(at, minlength=len(codes))
        total = np.zeros_like(codes)
        np.add.at(total, at, x)
        codes[n > 0] = total[n > 0] / n[n > 0, None]
    return codes


def borders(x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest code of each row, and the squared distance by which a row must move at least before another code is nearest (0 for its own)."""
    d = squared(x, codes)
    own = d.argmin(1)
    apart = np.sqrt(squared(codes, codes))
    np.fill_diagonal(apart, 1)
    move = ((d - d[np.arange(len(x)), own][:, None]) / (2 * np.maximum(apart[own], 1e-12))) ** 2
    move[np.arange(len(x)), own] = 0
    return own, move


@dataclass
class Grid:
    """The product of two codebooks; cell i * len(right) + j has the vectors whose halves are nearest to left[i] and right[j]. reach: how far the traversal goes."""

    left: np.ndarray
    right: np.ndarray
    reach: float = 0.0

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.left.shape[1]
        x = np.pad(x, ((0, 0), (0, max(0, half + self.right.shape[1] - x.shape[1]))))
        return x[:, :half], x[:, half:]

    def traverse(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The own cell of each row; and the visits as (row, cell), each row's cells from the nearest on, until `reach`.

        Multi-sequence traversal, of all rows side by side: the codes of either half are
        sorted by distance; each place i in the left order points to the next place of the
        right order that has not been visited with it, and the least sum comes next.
        """
        a, b = self.halves(x)
        (own_a, far_a), (own_b, far_b) = borders(a, self.left), borders(b, self.right)
        order_a, order_b = far_a.argsort(1, kind="stable"), far_b.argsort(1, kind="stable")
        far_a, far_b = np.take_along_axis(far_a, order_a, 1), np.take_along_axis(far_b, order_b, 1)
        far_b = np.pad(far_b, ((0, 0), (0, 1)), constant_values=np.inf)
        rows, next_b = np.arange(len(x)), np.zeros(far_a.shape, np.int64)
        seen_rows, seen_cells = [], []
        while len(rows):
            sums = far_a[rows] + np.take_along_axis(far_b[rows], next_b[rows], 1)
            i = sums.argmin(1)
            go = sums[np.arange(len(rows)), i] <= self.reach
            rows, i = rows[go], i[go]
            j = next_b[rows, i]
            seen_rows.append(rows)
            seen_cells.append(order_a[rows, i] * len(self.right) + order_b[rows, j])
            next_b[rows, i] += 1
        return own_a * len(self.right) + own_b, np.concatenate(seen_rows), np.concatenate(seen_cells)


def fit(sample: np.ndarray, k: int, least: float, recall: float, seed: int = 13) -> Grid:
    """Codebooks of k codes on the unit vectors of the sample, and the reach at which pairs with a cosine of `least`, the hardest to find, are found with the chance `recall`.

    The pairs that calibrate it: each vector of the sample and one turned away from it by
    that cosine, once in a random direction and once towards another vector of the sample.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    half = sample.shape[1] // 2
    grid = Grid(codebook(sample[:, :half], k, rng), codebook(sample[:, half:], k, rng))
    needs = [0.0]
    for way in (rng.normal(size=sample.shape), sample[rng.permutation(len(sample))]):
        way = way - (way * sample).sum(1, keepdims=True) * sample
        length = np.sqrt((way * way).sum(1))
        ok = length > 1e-6
        other = least * sample[ok] + np.sqrt(1 - least * least) * way[ok] / length[ok, None]
        need = np.zeros(int(ok.sum()))
        for codes, x, y in zip((grid.left, grid.right), grid.halves(sample[ok]), grid.halves(other)):
            need += borders(x, codes)[1][np.arange(len(x)), borders(y, codes)[0]]
        if len(need):
            needs.append(float(np.quantile(need, recall, method="higher")))
    grid.reach = max(needs)
    return grid
