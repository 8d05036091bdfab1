"""Finding an asset in a page's image: template matching by Fourier transforms, and feature matching with a homography; numpy helpers and Arrow UDFs."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .images import resized

# Scales and least correlation of template matching; features, ratio, matches, inliers and box of feature matching.
SCALES = (*np.linspace(0.10, 0.5, 30).tolist(), *np.linspace(0.5, 1.8, 21)[1:].tolist())
LEAST_SIDE, LEAST_CORRELATION = 30, 0.70
FEATURES, RATIO, GOOD_MATCHES, REPROJECTION = 2000, 0.72, 18, 5.0
INLIERS = max(8, int(GOOD_MATCHES * 0.75))
LEAST_BOX = (50, 30)
#: Longest side of a page at matching; longer ones are made smaller, the asset with them.
LONGEST = 4000

TEMPLATE = "x int, y int, width int, height int, confidence double, scale double"
FEATURE = "x int, y int, width int, height int, confidence double, good_matches int, inliers int"

#: Seeds of what is random, so that equal images give equal results.
_PAIRS = np.clip(np.random.Generator(np.random.PCG64(31)).normal(0, 31 / 5, (256, 4)), -13, 13)
_BORDER, _RADIUS, _LEVELS, _STEP, _TRIES = 20, 15, 8, 1.2, 1000
_DISC = np.add.outer(np.arange(-_RADIUS, _RADIUS + 1) ** 2, np.arange(-_RADIUS, _RADIUS + 1) ** 2) <= _RADIUS**2


def table(x: np.ndarray) -> np.ndarray:
    """Summed-area table."""
    return np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))


def windows(t: np.ndarray, h: int, w: int) -> np.ndarray:
    """Sum of every h x w window, from a summed-area table."""
    return t[h:, w:] - t[:-h, w:] - t[h:, :-w] + t[:-h, :-w]


def _fitting(n: int) -> int:
    """The least number from n on without a prime factor over 5, at which Fourier transforms are fast."""
    while True:
        k = n
        for f in (2, 3, 5):
            while k % f == 0:
                k //= f
        if k == 1:
            return n
        n += 1


class _Page:
    """What all templates of a page share: its centred pixels, their spectrum, and the tables of their sums."""

    def __init__(self, page: np.ndarray) -> None:
        self.x = page.astype(np.float64)
        self.x -= self.x.mean()
        self.shape = (_fitting(self.x.shape[0]), _fitting(self.x.shape[1]))
        self.spectrum = np.fft.rfft2(self.x, self.shape)
        self.single = self.spectrum.astype(np.complex64)
        self.tables = table(self.x), table(self.x * self.x)
        self.norm = float(np.sqrt(self.tables[1][-1, -1]))
        self.roots: dict[tuple[int, int], np.ndarray] = {}

    def root(self, h: int, w: int, keep: bool) -> np.ndarray:
        """Norm of every centred window in single precision, infinite where a window is flat."""
        got = self.roots.get((h, w))
        if got is None:
            spread = windows(self.tables[1], h, w) - windows(self.tables[0], h, w) ** 2 / (h * w)
            got = np.where(spread <= 1e-6 * h * w, np.inf, np.sqrt(np.maximum(spread, 0))).astype(np.float32)
            if keep:
                self.roots[h, w] = got
        return got

    def may_reach(self, least: float, template: tuple, h: int, w: int, keep: bool) -> bool:
        """Whether some window's correlation may be `least` (over 0) or more: a product in single precision, with a hundred times its rounding error to spare."""
        _, energy, single = template
        norm, root = float(np.sqrt(energy)), self.root(h, w, keep)
        across = np.fft.irfft2(self.single * single, self.shape)[: root.shape[0], : root.shape[1]]
        return bool((across + np.float32(1e-5 * self.norm * norm) >= np.float32(least * norm * (1 - 1e-5)) * root).any())


def _transformed(template: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, float, np.ndarray]:
    """Conjugate spectrum, energy, and the spectrum in single precision, of a centred template."""
    t = template - template.mean()
    spectrum = np.conj(np.fft.rfft2(t, shape))
    return spectrum, float((t * t).sum()), spectrum.astype(np.complex64)


def _correlated(spectrum: np.ndarray, shape: tuple[int, int], tables: tuple[np.ndarray, np.ndarray], template: tuple, h: int, w: int) -> np.ndarray:
    (plain, squares), (other, energy, _) = tables, template
    across = np.fft.irfft2(spectrum * other, shape)[: plain.shape[0] - h, : plain.shape[1] - w]
    spread = windows(squares, h, w) - windows(plain, h, w) ** 2 / (h * w)
    flat = (spread <= 1e-6 * h * w) | (energy <= 1e-6 * h * w)
    return np.where(flat, 0.0, across / np.sqrt(np.where(flat, 1.0, spread * max(energy, 1e-12))))


def correlations(page: np.ndarray, template: np.ndarray, spectrum: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Normalised cross-correlation of a template with every window of a page, whose spectrum (rfft2 at shape) is known; 0 where a window is flat."""
    return _correlated(spectrum, shape, (table(page), table(page * page)), _transformed(template, shape), *template.shape)


#: Points of spectra that a task keeps from row to row, at most, and how many: 400 MB. Larger ones are made anew.
_KEPT_POINTS, _KEPT = 1 << 16, 512


def _image(pixels: bytes, kind: str, height: int) -> np.ndarray:
    return np.frombuffer(pixels, kind).reshape(height, -1)


@functools.lru_cache(maxsize=1)
def _page(pixels: bytes, kind: str, height: int) -> _Page:
    return _Page(_image(pixels, kind, height))


@functools.lru_cache(maxsize=_KEPT)
def _template(pixels: bytes, kind: str, height: int, h: int, w: int, shape: tuple[int, int]) -> tuple:
    return _transformed(resized(_image(pixels, kind, height), h, w), shape)


def template_match(page: np.ndarray, asset: np.ndarray, scales=SCALES, least: float = LEAST_CORRELATION, least_side: int = LEAST_SIDE) -> tuple | None:
    """x, y, width, height, confidence and scale of the best correlation over all scales (the first of equal ones), None below `least`.

    Scales at which a side of the asset is under least_side or longer than the page are
    passed over. Memory is a few times the page's. What the last page and the last small
    templates share with the next row is kept.
    """
    p, own, best = _page(page.tobytes(), page.dtype.str, page.shape[0]), asset.tobytes(), None
    keep = p.shape[0] * p.shape[1] <= _KEPT_POINTS
    made = _template if keep else _template.__wrapped__
    for scale in scales:
        w, h = int(asset.shape[1] * scale), int(asset.shape[0] * scale)
        if min(w, h) < least_side or w > p.x.shape[1] or h > p.x.shape[0]:
            continue
        t, wanted = made(own, asset.dtype.str, asset.shape[0], h, w, p.shape), least if best is None else max(least, best[0])
        if wanted > 0 and not p.may_reach(wanted, t, h, w, keep):
            continue
        c = _correlated(p.spectrum, p.shape, p.tables, t, h, w)
        top, left = np.unravel_index(c.argmax(), c.shape)
        if c[top, left] >= least and (best is None or c[top, left] > best[0]):
            best = (float(c[top, left]), int(left), int(top), w, h, float(scale))
    return best and (*best[1:5], round(best[0], 4), round(best[5], 3))


def _runs(x: np.ndarray, n: int) -> np.ndarray:
    """Sums of n rows from each row on, by sums of 1, 2, 4, ... rows."""
    rows, size, done, out = len(x) - n + 1, 1, 0, None
    while True:
        if n & size:
            own = x[done : done + rows]
            out, done = own if out is None else out + own, done + size
        if done == n:
            return out
        x, size = x[:-size] + x[size:], size * 2


def _boxes(x: np.ndarray, n: int) -> np.ndarray:
    """Sum of the n x n pixels about each one, n odd; beyond the border the outermost ones are repeated."""
    (h, w), k = x.shape, n // 2
    wide = np.empty((h + 2 * k, w + 2 * k), x.dtype)
    wide[k : k + h, k : k + w] = x
    wide[k : k + h, :k], wide[k : k + h, k + w :] = x[:, :1], x[:, -1:]
    wide[:k], wide[k + h :] = wide[k], wide[k + h - 1]
    return _runs(_runs(wide, n).T, n).T


def _slopes(x: np.ndarray) -> np.ndarray:
    """Twice the gradient along the rows' axis."""
    out = np.empty_like(x)
    out[1:-1] = x[2:] - x[:-2]
    out[0], out[-1] = 2 * (x[1] - x[0]), 2 * (x[-1] - x[-2])
    return out


def corners(image: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) and responses (times 196 squared) of the strongest Harris corners away from the border, local maxima only."""
    n = _BORDER
    if min(image.shape) <= 2 * n + 2:
        return np.zeros((0, 2), int), np.zeros(0, np.float32)
    image = image.astype(np.float32, copy=False)
    gy, gx = _slopes(image), _slopes(image.T).T
    a, b, c = (_boxes(x, 7) for x in (gx * gx, gy * gy, gx * gy))
    r, both = a * b, a + b
    r -= c * c
    r -= np.float32(0.04) * both * both
    tall = np.maximum(np.maximum(r[n - 1 : -n - 1], r[n:-n]), r[n + 1 : r.shape[0] - n + 1])
    around = np.maximum(np.maximum(tall[:, n - 1 : -n - 1], tall[:, n:-n]), tall[:, n + 1 : r.shape[1] - n + 1])
    inner = r[n:-n, n:-n]
    peak = np.flatnonzero((inner == around) & (inner > 1e-3 * max(float(r.max()), 1e-9 * 196**2)))
    strength = inner.ravel()[peak]
    top = np.argsort(-strength, kind="stable")[:most]
    return np.stack(np.divmod(peak[top], inner.shape[1]), 1) + n, strength[top]


def _turns(image: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosine and sine of the direction from places to the centre of grey of the discs about them, from sums along the rows."""
    columns = np.arange(image.shape[1])
    along = np.zeros((image.shape[0], image.shape[1] + 1), complex)
    np.cumsum(image * (1 + 1j * columns), axis=1, out=along[:, 1:])
    side = np.arange(-_RADIUS, _RADIUS + 1)
    half, flat = _DISC.sum(1) // 2, along.ravel()
    start = (at[:, :1] * along.shape[1] + at[:, 1:]) + side * along.shape[1] - half
    run = flat.take(start + (2 * half + 1), mode="clip")  # none is outside; clip is only faster than its check
    run -= flat.take(start, mode="clip")
    mass, first = (run @ np.stack([np.ones(len(side)), side], 1).astype(complex)).T
    x, y = mass.imag - at[:, 1] * mass.real, first.real
    far = np.hypot(x, y)
    return np.where(far > 0, x / np.where(far > 0, far, 1), 1.0), np.where(far > 0, y / np.where(far > 0, far, 1), 0.0)


def _described(image: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Oriented binary descriptors of places, 256 bits each as 4 numbers."""
    cos, sin = (v.astype(np.float32)[:, None] for v in _turns(image, at))
    soft, width = _boxes(image, 5).ravel(), np.float32(image.shape[1])
    x, y = (np.concatenate([_PAIRS[:, k], _PAIRS[:, k + 2]]).astype(np.float32) for k in (0, 1))
    out, own = np.empty((len(at), 256), bool), at[:, :1] * image.shape[1] + at[:, 1:]
    for s in range(0, len(at), 64):  # 64 x 512 places at a time
        c, d = cos[s : s + 64], sin[s : s + 64]
        down, right = d * x, c * x
        down += c * y
        right -= d * y
        np.rint(down, out=down)
        down *= width
        down += np.rint(right, out=right)
        place = down.astype(np.intp)
        place += own[s : s + 64]
        value = soft.take(place, mode="clip")
        np.less(value[:, :256], value[:, 256:], out=out[s : s + 64])
    return np.packbits(out, axis=1).view(np.uint64)


def _shrunk(total: np.ndarray, height: int, width: int) -> np.ndarray:
    """What resized() makes, from the summed-area table that all sizes share."""
    rows, cols = np.linspace(0, len(total) - 1, height + 1), np.linspace(0, total.shape[1] - 1, width + 1)
    y, x = np.minimum(rows.astype(int), len(total) - 2), np.minimum(cols.astype(int), total.shape[1] - 2)
    fy, fx = (rows - y)[:, None], cols - x
    down = np.diff(total[y] * (1 - fy) + total[y + 1] * fy, axis=0)
    across = np.diff(down.take(x, 1) * (1 - fx) + down.take(x + 1, 1) * fx, axis=1)
    return across / (np.diff(rows)[:, None] * np.diff(cols))


def features(image: np.ndarray, most: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Points (x, y) of corners over a pyramid of scales, and their oriented binary descriptors of 256 bits (4 numbers each)."""
    total, levels = np.zeros((image.shape[0] + 1, image.shape[1] + 1)), []
    total[1:, 1:] = np.ascontiguousarray(image.cumsum(1, np.float64).T).cumsum(1).T
    for level in range(_LEVELS):
        f = _STEP**level
        h, w = int(image.shape[0] / f), int(image.shape[1] / f)
        if min(h, w) <= 2 * _BORDER + 2:
            break
        small = (_shrunk(total, h, w) if level else image).astype(np.float32)
        levels.append((small, *corners(small, most)))
    if not levels:
        return np.zeros((0, 2)), np.zeros((0, 4), np.uint64)
    best = np.argsort(-np.concatenate([strength for _, _, strength in levels]), kind="stable")[:most]
    points, bits, first = np.zeros((len(best), 2)), np.zeros((len(best), 4), np.uint64), 0
    for small, at, _ in levels:
        own = np.flatnonzero((best >= first) & (best < first + len(at)))  # only what is kept is described
        mine, first = at[best[own] - first], first + len(at)
        points[own] = (mine[:, ::-1] + 0.5) * [image.shape[1] / small.shape[1], image.shape[0] / small.shape[0]] - 0.5
        bits[own] = _described(small, mine)
    return points, bits


def _signs(bits: np.ndarray) -> np.ndarray:
    """Descriptors as rows of -1 and 1; a product of two is 256 less twice their distance, exact in single precision."""
    out = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1).astype(np.float32)
    out *= 2
    out -= 1
    return out


def _signed_features(pixels: bytes, kind: str, height: int) -> tuple[np.ndarray, np.ndarray]:
    points, bits = features(_image(pixels, kind, height))
    return points, _signs(bits)


_asset_features = functools.lru_cache(maxsize=64)(_signed_features)
_page_features = functools.lru_cache(maxsize=1)(_signed_features)


def _nearest(mine: np.ndarray, theirs: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    if len(mine) == 0 or len(theirs) < 2:
        return np.zeros(0, int), np.zeros(0, int)
    own, other, bits = [], [], mine.shape[1]
    for s in range(0, len(mine), 512):  # 512 x 2000 products at a time
        like = mine[s : s + 512] @ theirs.T
        rows, first = np.arange(len(like)), like.argmax(1)
        near = (bits - like[rows, first].astype(float)) / 2
        like[rows, first] = -np.inf
        ok = near < ratio * ((bits - like.max(1).astype(float)) / 2)
        own.append(s + np.flatnonzero(ok))
        other.append(first[ok])
    return np.concatenate(own), np.concatenate(other)


def good_matches(a: np.ndarray, b: np.ndarray, ratio: float = RATIO) -> tuple[np.ndarray, np.ndarray]:
    """Descriptors of a and their nearest ones in b, where the second nearest is clearly farther (ratio test)."""
    return _nearest(_signs(a), _signs(b), ratio)


def homographies(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """For each of a stack of point sets, the 3 x 3 projection that takes src to dst in the least-squares sense (direct linear transform on normalised points); NaN where there is none."""

    def normal(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        centre = p.mean(1, keepdims=True)
        f = np.sqrt(2) / np.maximum(np.sqrt(((p - centre) ** 2).sum(2)).mean(1), 1e-9)
        there, back = np.zeros((2, len(p), 3, 3))
        there[:, 0, 0] = there[:, 1, 1] = f
        there[:, :2, 2] = -f[:, None] * centre[:, 0]
        back[:, 0, 0] = back[:, 1, 1] = 1 / f
        back[:, :2, 2] = centre[:, 0]
        there[:, 2, 2] = back[:, 2, 2] = 1
        return (p - centre) * f[:, None, None], there, back

    (s, ts, _), (d, _, back) = normal(src), normal(dst)
    zero, one = np.zeros(s.shape[:2]), np.ones(s.shape[:2])
    (x, y), (u, v) = np.moveaxis(s, 2, 0), np.moveaxis(d, 2, 0)
    rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], 2), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], 2)], 1)
    if rows.shape[1] < 9:  # what is orthogonal to all rows
        own = np.linalg.qr(rows.swapaxes(1, 2), mode="complete")[0][:, :, -1]
    else:
        own = np.linalg.svd(rows, full_matrices=False)[2][:, -1]
    m = back @ own.reshape(-1, 3, 3) @ ts
    last = m[:, 2:, 2:]
    ok = (np.abs(last) > 1e-12) & np.isfinite(m).all((1, 2), keepdims=True)
    return np.where(ok, m / np.where(ok, last, 1), np.nan)


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """The projection of one point set; None if there is none."""
    m = homographies(src[None], dst[None])[0]
    return None if np.isnan(m).any() else m


def projected(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Points under a projection, or under each of a stack of them."""
    q = np.column_stack([p, np.ones(len(p))]) @ m.swapaxes(-1, -2)
    with np.errstate(divide="ignore", invalid="ignore"):
        return q[..., :2] / q[..., 2:]


#: Tries of a consensus before it may end, and together afterwards.
_FIRST_TRIES, _MORE_TRIES = 51, 64


@functools.lru_cache(maxsize=512)
def _fours(n: int, tries: int) -> np.ndarray:
    """Four of n numbers a try; the same ones for each set of n."""
    rng = np.random.Generator(np.random.PCG64(7))
    return np.stack([rng.choice(n, 4, replace=False) for _ in range(tries)])


def consensus(src: np.ndarray, dst: np.ndarray, within: float = REPROJECTION, tries: int = _TRIES) -> tuple[np.ndarray | None, np.ndarray]:
    """The projection that most pairs agree on within so many pixels (RANSAC), fitted to these, and which they are."""
    best, most, k = np.zeros(len(src), bool), 0, 0
    with np.errstate(invalid="ignore", over="ignore"):
        agree = lambda m: ((projected(m, src) - dst) ** 2).sum(-1) <= within**2
        while k < tries:
            end = min(tries, k + (_MORE_TRIES if k else _FIRST_TRIES))
            fours = _fours(len(src), end if k == 0 else tries)[k:end]
            own = agree(homographies(src[fours], dst[fours]))
            for i, n in enumerate(own.sum(1).tolist()):
                if n > most:
                    best, most = own[i], n
                k += 1
                if k >= _FIRST_TRIES and most > 0.5 * len(src):  # a further try finds more with a chance of under 4 %
                    tries = k
                    break
        if most < 4 or (m := homography(src[best], dst[best])) is None:
            return None, best
        return m, agree(m)


def feature_match(page: np.ndarray, asset: np.ndarray) -> tuple | None:
    """x, y, width, height, confidence, good_matches and inliers of the asset's outline in the page, None if too few features agree."""
    (pa, da), (pp, dp) = (f(x.tobytes(), x.dtype.str, x.shape[0]) for f, x in ((_asset_features, asset), (_page_features, page)))
    if min(len(pa), len(pp)) < 4:
        return None
    i, j = _nearest(da, dp, RATIO)
    if len(i) < GOOD_MATCHES:
        return None
    m, inside = consensus(pa[i], pp[j])
    if m is None or inside.sum() < INLIERS:
        return None
    h, w = asset.shape
    box = projected(m, np.array([[0, 0], [w, 0], [w, h], [0, h]], float))
    if not np.isfinite(box).all():
        return None
    left, top = (max(0, int(v)) for v in box.min(0))
    right, bottom = min(page.shape[1], int(box[:, 0].max())), min(page.shape[0], int(box[:, 1].max()))
    if right - left < LEAST_BOX[0] or bottom - top < LEAST_BOX[1]:
        return None
    return left, top, right - left, bottom - top, round(min(1.0, inside.sum() / len(i)), 4), len(i), int(inside.sum())


def grey(pixels: bytes | None, width: int | None) -> np.ndarray | None:
    """An image from row-major grey bytes; None for what is none."""
    if pixels is None or not width or width != width or len(pixels) < width or len(pixels) % int(width):
        return None
    return np.frombuffer(pixels, np.uint8).reshape(-1, int(width))


def _located(how, kind: str):
    @F.pandas_udf(kind)
    def run(page: pd.Series, page_width: pd.Series, asset: pd.Series, asset_width: pd.Series) -> pd.DataFrame:
        names, rows = [x.split()[0] for x in kind.split(", ")], []
        for p, pw, a, aw in zip(page, page_width, asset, asset_width):
            p, a = grey(p, pw), grey(a, aw)
            found, f = None, 1.0
            if p is not None and a is not None:
                f = min(1.0, LONGEST / max(p.shape))
                if f < 1:
                    p, a = (resized(x, max(1, int(x.shape[0] * f)), max(1, int(x.shape[1] * f))) for x in (p, a))
                found = how(p, a)
            rows.append((None,) * len(names) if found is None else (*(int(v / f) for v in found[:4]), *found[4:]))
        return pd.DataFrame(rows, columns=names).astype({x.split()[0]: "Int64" if x.endswith("int") else "Float64" for x in kind.split(", ")})

    return run


def template_place(page: Column | str, page_width: Column | str, asset: Column | str, asset_width: Column | str) -> Column:
    """Where an asset's image is in a page's, by template matching (struct TEMPLATE, fields null if it isn't found or an image is none)."""
    return _located(template_match, TEMPLATE)(page, page_width, asset, asset_width)


def feature_place(page: Column | str, page_width: Column | str, asset: Column | str, asset_width: Column | str) -> Column:
    """Where an asset's image is in a page's, by feature matching (struct FEATURE)."""
    return _located(feature_match, FEATURE)(page, page_width, asset, asset_width)
