"""Cover trees over integer vectors, and the dual-tree search of nearest centroids, in numpy."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

#: Points of a node that is not split any more.
LEAF = 4
#: Pairs whose vectors are compared in one step; bounds the memory.
STEP = 8192
#: Share of the coordinates' size by which distances in bounds may be wrong; far above the rounding of 64-bit floats.
SLACK = 1e-6


@dataclass
class Tree:
    """A cover tree. Node k stands at point at[k], spans points start[k]:end[k] of `points`, all within radius[k] of it, and has children first[k] .. first[k] + count[k] - 1, up[k] being its distance to its parent's point."""

    points: np.ndarray
    order: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    count: np.ndarray
    radius: np.ndarray
    up: np.ndarray
    total: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.total = np.zeros((len(self.points) + 1, self.points.shape[1]), np.int64)
        np.cumsum(self.points, axis=0, out=self.total[1:])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of a to those of b, up to rounding."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0))


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The cover tree of the rows of points (int64), level by level.

    A node's children stand at points that are over half of its scale apart, its own
    first, and share its points out: each goes to the first child within that half. The
    scale is the power of two at or above the node's radius.
    """
    far = distances(points, points)
    np.fill_diagonal(far, 0)
    members = [np.arange(len(points))]
    point, up, radius, begin, first, count = [0], [0.0], [float(far[0].max(initial=0))], [0], [], []
    k = 0
    order = np.arange(len(points))
    while k < len(members):
        rest, here, scale = members[k], point[k], radius[k]
        first.append(len(members))
        if len(rest) <= leaf or scale == 0:
            count.append(0)
        else:
            half, at, own = 2.0 ** (math.ceil(math.log2(scale)) - 1), begin[k], here
            while len(rest):
                near = far[own, rest] <= half
                got = rest[near]
                members.append(got)
                point.append(own)
                up.append(float(far[here, own]))
                radius.append(float(far[own, got].max()))
                begin.append(at)
                order[at : at + len(got)] = got
                at += len(got)
                rest = rest[~near]
                own = int(rest[0]) if len(rest) else own
            count.append(len(members) - first[k])
        k += 1
    place = np.empty(len(points), np.int64)
    place[order] = np.arange(len(points))
    start = np.array(begin, np.int64)
    sizes = np.array([len(m) for m in members], np.int64)
    return Tree(points[order], order, place[np.array(point)], start, start + sizes, np.array(first, np.int64), np.array(count, np.int64), np.array(radius), np.array(up))


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges first .. first + count - 1: the number of each range, and the numbers in it, one after the other."""
    which = np.repeat(np.arange(len(first)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]


def squares(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact squared distances of a[i] and b[j]."""
    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), STEP):
        d = a[i[s : s + STEP]] - b[j[s : s + STEP]]
        out[s : s + STEP] = np.einsum("ij,ij->i", d, d)
    return out


def centroid_tree(centroids: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree over the distinct centroids, and for each of its points the smallest number of such a centroid."""
    distinct, number = np.unique(centroids, axis=0, return_index=True)
    tree = build(distinct, leaf=1)
    return tree, number[tree.order]


def nearest(tree: Tree, centres: Tree, number: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, int]:
    """The nearest centroid (ties: smallest number) of every point of tree.

    Returns the nodes that are settled whole with their centroids' places, as (node,
    place) pairs of arrays; the points settled alone with their places; and the number of
    distances worked out.

    A pair of a vector node and a centroid node goes if the least distance between their
    points is over the largest distance from the vector node's points to the best centroid
    so far. Of what stays, centroid nodes of the larger radius are opened first, then the
    vector node. A vector node with one centroid left is settled; leaves are compared
    point by point, in integers.
    """
    slack = SLACK * (1 + float(np.abs(tree.points).max(initial=0)) + float(np.abs(centres.points).max(initial=0))) * math.sqrt(tree.points.shape[1])
    rq, rc, q_leaf, c_leaf = tree.radius, centres.radius, tree.count == 0, centres.count == 0
    most = np.full(len(rq), np.inf)
    q, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    d = np.full(1, np.nan)
    whole, alone, work = [], [], 0
    while len(q):
        new = np.flatnonzero(np.isnan(d))
        d[new] = np.sqrt(squares(tree.points, tree.at[q[new]], centres.points, centres.at[c[new]]))
        work += len(new)
        np.minimum.at(most, q[new], d[new] + rq[q[new]])
        stays = d - rq[q] - rc[c] <= most[q] + slack
        q, c, d = q[stays], c[stays], d[stays]
        left = np.bincount(q, minlength=len(rq))[q]
        opens = ~c_leaf[c] & ((rc[c] >= rq[q]) | q_leaf[q] | (left == 1))
        waits = (np.bincount(q, weights=opens, minlength=len(rq)) > 0)[q]
        done = ~waits & (left == 1)
        whole.append((q[done], centres.at[c[done]]))
        exact = ~waits & ~done & q_leaf[q]
        alone.append((q[exact], centres.at[c[exact]]))
        splits = ~waits & ~done & ~exact
        parts = [(q[waits & ~opens], c[waits & ~opens], d[waits & ~opens])]
        which, child = spread(centres.first[c[opens]], centres.count[c[opens]])
        cq, cd = q[opens][which], d[opens][which]
        near = cd - centres.up[child] - rq[cq] - rc[child] <= most[cq] + slack
        parts.append((cq[near], child[near], np.full(int(near.sum()), np.nan)))
        which, child = spread(tree.first[q[splits]], tree.count[q[splits]])
        most[child] = np.minimum(most[child], most[q[splits]][which])
        cc, cd = c[splits][which], d[splits][which]
        near = cd - tree.up[child] - rq[child] - rc[cc] <= most[child] + slack
        parts.append((child[near], cc[near], np.full(int(near.sum()), np.nan)))
        q, c, d = (np.concatenate(x) for x in zip(*parts))
    qs, places = (np.concatenate(x) for x in zip(*alone))
    which, point = spread(tree.start[qs], tree.end[qs] - tree.start[qs])
    place = places[which]
    far = squares(tree.points, point, centres.points, place)
    best = np.lexsort((number[place], far, point))
    lead = best[np.concatenate([[True], point[best][1:] != point[best][:-1]])] if len(best) else best
    return whole, point[lead], place[lead], work + len(point)
