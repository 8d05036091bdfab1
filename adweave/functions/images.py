"""Resizing and perceptual hashes of raw grey images, as Arrow UDFs over numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Pixels whose hashes are found together, but for larger images.
PIXELS = 1 << 18


def _summed(images: np.ndarray) -> np.ndarray:
    """Sums of the pixels above and to the left of each corner, of an image or a stack of them."""
    out = np.zeros((*images.shape[:-2], images.shape[-2] + 1, images.shape[-1] + 1))
    np.cumsum(images, axis=-2, dtype=float, out=out[..., 1:, 1:])
    np.cumsum(out[..., 1:, 1:], axis=-1, out=out[..., 1:, 1:])
    return out


def _means(total: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the pixels of each cell of a height x width grid, from _summed."""
    h, w = total.shape[-2] - 1, total.shape[-1] - 1
    rows = np.linspace(0, h, height + 1)
    cols = np.linspace(0, w, width + 1)
    y0, x0 = np.minimum(rows.astype(int), h - 1), np.minimum(cols.astype(int), w - 1)
    fy, fx = (rows - y0)[:, None], (cols - x0)[None, :]
    upper, lower = total.take(y0, -2), total.take(y0 + 1, -2)
    s = upper.take(x0, -1) * (1 - fy) * (1 - fx) + lower.take(x0, -1) * fy * (1 - fx) + upper.take(x0 + 1, -1) * (1 - fy) * fx + lower.take(x0 + 1, -1) * fy * fx
    area = np.diff(rows)[:, None] * np.diff(cols)[None, :]
    return (s[..., 1:, 1:] - s[..., :-1, 1:] - s[..., 1:, :-1] + s[..., :-1, :-1]) / area


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the pixels of each cell of a height x width grid."""
    return _means(_summed(image), height, width)


def _bits(mask: np.ndarray) -> np.ndarray:
    return np.packbits(mask.reshape(len(mask), 64), axis=1).view(">i8")[:, 0]


def stacked_hashes(images: np.ndarray) -> np.ndarray:
    """pHash, dHash, wHash and aHash of each of a stack of grey images of one size, 64 bits each as signed integers."""
    total, n = _summed(images), len(images)
    small = _means(total, 32, 32)
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:8, None] / 64)
    dct = (basis @ small @ basis.T).reshape(n, 64)
    p = dct > np.median(dct, axis=1, keepdims=True)
    nine = _means(total, 8, 9)
    d = nine[..., 1:] > nine[..., :-1]
    haar = _means(total, 8, 8).reshape(n, 64)
    w = haar > np.median(haar, axis=1, keepdims=True)
    a = haar > haar.mean(axis=1, keepdims=True)
    return np.stack([_bits(p), _bits(d), _bits(w), _bits(a)], axis=1).astype(np.int64)


def hashes(image: np.ndarray) -> tuple[int, int, int, int]:
    """The four hashes of one grey image."""
    return tuple(stacked_hashes(image[None])[0].tolist())


def image_hashes(pixels: Column | str, width: Column | str) -> Column:
    """phash, dhash, whash and average_hash of images given as row-major grey bytes and a width; nulls for what is no image."""

    @F.pandas_udf("phash long, dhash long, whash long, average_hash long")
    def run(pixels: pd.Series, width: pd.Series) -> pd.DataFrame:
        pixels, values, ok = list(pixels), np.zeros((len(pixels), 4), np.int64), np.zeros(len(pixels), bool)
        sizes: dict[tuple[int, int], list[int]] = {}
        for i, (p, w) in enumerate(zip(pixels, width)):
            if p is not None and w and len(p) >= w and len(p) % w == 0:
                sizes.setdefault((len(p), int(w)), []).append(i)
        for (size, w), found in sizes.items():
            step = max(1, PIXELS // size)
            for own in (found[i : i + step] for i in range(0, len(found), step)):
                values[own] = stacked_hashes(np.frombuffer(b"".join(pixels[i] for i in own), np.uint8).reshape(len(own), -1, w))
            ok[found] = True
        return pd.DataFrame({k: pd.arrays.IntegerArray(values[:, i].copy(), ~ok) for i, k in enumerate(("phash", "dhash", "whash", "average_hash"))})

    return run(pixels, width)
