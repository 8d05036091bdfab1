"""Words that differ by one edit, by two-dimensional range reporting with wavelet trees, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Ranges that one step of a report follows; bounds the memory.
STEP = 1 << 18


class WaveletTree:
    """A wavelet tree, as a matrix of bit levels, over a permutation of 0 .. n - 1: reports the values of a range of places in a range of values."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros_before, self.zeros = [], []
        v = values.astype(np.int64)
        for k in reversed(range(self.bits)):
            one = (v >> k) & 1 == 1
            before = np.zeros(len(v) + 1, np.int32)
            np.cumsum(~one, out=before[1:])
            self.zeros_before.append(before)
            self.zeros.append(int(before[-1]))
            v = np.concatenate([v[~one], v[one]])

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, value) of all values in [least, most) at the places [lo, hi), for many queries at once."""
        todo = [(0, np.arange(s, min(s + STEP, len(lo))), lo[s : s + STEP], hi[s : s + STEP], np.zeros(len(lo[s : s + STEP]), np.int64)) for s in range(0, len(lo), STEP)]
        while todo:
            level, q, a, b, value = todo.pop()
            while level < self.bits:
                before, width = self.zeros_before[level], 1 << (self.bits - 1 - level)
                a0, b0 = before[a], before[b]
                a1, b1 = a - a0 + self.zeros[level], b - b0 + self.zeros[level]
                left = (b0 > a0) & (value + width > least[q]) & (value < most[q])
                right = (b1 > a1) & (value + 2 * width > least[q]) & (value + width < most[q])
                q, a, b, value = np.concatenate([q[left], q[right]]), np.concatenate([a0[left], a1[right]]), np.concatenate([b0[left], b1[right]]), np.concatenate([value[left], value[right] + width])
                level += 1
                if len(q) > 2 * STEP and level < self.bits:  # go on with a part at a time
                    todo += [(level, q[s : s + STEP], a[s : s + STEP], b[s : s + STEP], value[s : s + STEP]) for s in range(STEP, len(q), STEP)]
                    q, a, b, value = q[:STEP], a[:STEP], b[:STEP], value[:STEP]
            yield q, value


def _order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lexicographic order of rows of bytes, and the length of the prefix that each row shares with the one before it in that order."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
    s = rows[order]
    common = np.zeros(len(s), np.int64)
    for k in range(0, len(s) - 1, STEP):
        differ = s[k : k + STEP + 1][1:] != s[k : k + STEP + 1][:-1]
        common[k + 1 : k + 1 + len(differ)] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return order, common


class Side:
    """Queries and index words in one order, to give for each query the interval of index words that share a prefix with it.

    queries and index: rows of bytes, queries padded with zeros to the width of the index words.
    """

    def __init__(self, queries: np.ndarray, index: np.ndarray):
        n = len(queries)
        order, self.common = _order(np.concatenate([queries, index]))
        self.at = np.empty(len(order), np.int64)
        self.at[order] = np.arange(len(order))
        self.at = self.at[:n]
        self.before = np.concatenate([[0], np.cumsum(order >= n)])
        self.index = order[order >= n] - n

    def intervals(self, length: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the queries `rows`: first and end of the places in `index` whose words share their first `length` bytes."""
        edges = np.append(np.flatnonzero(self.common < length) if length else 0, len(self.common))
        run = np.searchsorted(edges, self.at[rows], "right") - 1
        return self.before[edges[run]], self.before[edges[run + 1]]


def one_edit(queries: np.ndarray, index: np.ndarray, edits: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, index word) that differ by one code point at an edit position in `edits`.

    queries, index: rows of bytes, each words of one length. Equal lengths: byte i of the
    query is replaced. Index words longer by one: a byte is put in before byte i; of
    several such places, in a run of that byte, the first counts. For each position i the
    index words with the query's prefix before it are an interval of the forward order,
    those with its suffix behind it one of the reverse order; the wavelet tree over the
    reverse ranks in forward order reports the words in both. Each pair comes once for all
    positions. `edits` go away from the half that the words share, so intervals become smaller, and
    queries without another word in theirs are done.
    """
    longer = index.shape[1] - queries.shape[1]
    padded = np.pad(queries, ((0, 0), (0, longer)))
    forward = Side(padded, index)
    backward = Side(np.pad(queries[:, ::-1], ((0, 0), (0, longer))), np.ascontiguousarray(index[:, ::-1]))
    rank = np.empty(len(index), np.int64)
    rank[backward.index] = np.arange(len(index))
    tree = WaveletTree(rank[forward.index])
    rows, least = np.arange(len(queries)), np.ones(len(queries), np.int64)
    if not longer:  # a word that the index has is in its own intervals; of a chunked group it may be in another chunk
        lo, hi = forward.intervals(queries.shape[1], rows)
        least += hi > lo
    for i in edits:
        spans = [lambda q: forward.intervals(i, q), lambda q: backward.intervals(queries.shape[1] - i - (0 if longer else 1), q)]
        narrow = edits.step < 0  # the side whose intervals become smaller from position to position
        lo, hi = spans[narrow](rows)
        rows = rows[hi - lo >= least[rows]]
        if not len(rows):
            return
        (lo, hi), (a, b) = (span(rows) for span in spans)
        ok = (hi - lo >= least[rows]) & (b - a >= least[rows])
        q, lo, hi, a, b = rows[ok], lo[ok], hi[ok], a[ok], b[ok]
        for which, value in tree.report(lo, hi, a, b) if len(q) else ():
            word, found = q[which], backward.index[value]
            if longer:
                ok = np.ones(len(found), bool) if i == 0 else index[found, i] != index[found, i - 1]
            else:
                ok = index[found, i] != queries[word, i]
            yield word[ok], found[ok]
