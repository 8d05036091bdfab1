"""Image files: listing with pushed size and name filters, a PNG codec over numpy, validity, optimising, and a sink for files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.images import resized
from .files import data_uri_bytes

# Extensions and largest size of listed images; largest sides, contrast and sharpness by use.
EXTENSIONS = ("png", "jpg", "jpeg", "gif", "webp")
LARGEST = 10 * 1024 * 1024
USES = {"screenshot": (1920, 1080, 1.05, 1.02), "asset": (1024, 1024, 1.0, 1.0), "default": (1024, 1024, 1.1, 1.05)}

_MAGIC = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DECODED = "width int, height int, grey binary, error string"


def png(image: np.ndarray) -> bytes:
    """A grey (h x w) or RGB (h x w x 3) image of bytes as PNG, each row filtered against the one above."""
    rows = image.reshape(image.shape[0], -1)
    up = rows - np.concatenate([np.zeros_like(rows[:1]), rows[:-1]])
    raw = np.concatenate([np.full((len(rows), 1), 2, np.uint8), up], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return _MAGIC + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def unpng(data: bytes) -> np.ndarray:
    """RGB of a PNG of 8 bits a channel without interlacing, what is transparent on white; ValueError says what is wrong with others."""
    if data[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, body, head, palette, clear = 8, [], None, None, b""
    while at + 12 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk, crc = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or struct.unpack(">I", crc)[0] != zlib.crc32(kind + chunk):
            raise ValueError("damaged chunk")
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = chunk
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            break
    else:
        raise ValueError("cut off")
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6] or not head[0] or not head[1]:
        raise ValueError("a kind of PNG that isn't read")
    w, h, k = head[0], head[1], _CHANNELS[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
        lines = raw.reshape(h, 1 + w * k)
    except (zlib.error, ValueError) as e:
        raise ValueError("damaged data") from e
    out, above = np.zeros((h, w * k), np.uint8), np.zeros(w * k, np.int64)
    for y, line in enumerate(lines):
        x = line[1:].astype(np.int64)
        if line[0] == 1:
            x = x.reshape(w, k).cumsum(0).ravel()
        elif line[0] == 2:
            x = x + above
        elif line[0] in (3, 4):
            for i in range(w * k):
                a, b, c = (x[i - k], above[i], above[i - k]) if i >= k else (0, above[i], 0)
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                x[i] = (x[i] + ((a + b) // 2 if line[0] == 3 else near)) & 255
        elif line[0]:
            raise ValueError("unknown filter")
        above = x & 255
        out[y] = above
    px = out.reshape(h, w, k)
    if head[3] == 3:
        if palette is None or px.max() >= len(palette):
            raise ValueError("no colour in the palette")
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(alpha)]
        px = np.concatenate([palette, alpha[:, None]], axis=1)[px[..., 0]]
        k = 4
    if k in (2, 4):
        part = px[..., -1:].astype(float) / 255
        px = np.rint(px[..., :-1] * part + 255 * (1 - part)).astype(np.uint8)
    return np.repeat(px, 3, axis=2) if px.shape[2] == 1 else px


def grey_of(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb.astype(float) @ [0.299, 0.587, 0.114]).clip(0, 255).astype(np.uint8)


def optimised(rgb: np.ndarray, use: str = "default") -> np.ndarray:
    """The image for a use: made smaller to its largest sides, the aspect kept; contrast about the mean grey; sharpness against a smoothed image."""
    most_w, most_h, contrast, sharpness = USES[use]
    f = min(1.0, most_w / rgb.shape[1], most_h / rgb.shape[0])
    x = rgb.astype(float)
    if f < 1:
        h, w = max(1, round(rgb.shape[0] * f)), max(1, round(rgb.shape[1] * f))
        x = np.stack([resized(x[..., c], h, w) for c in range(3)], axis=2)
    if contrast != 1:
        mean = round(float(grey_of(x.clip(0, 255)).mean()))
        x = (mean + (x - mean) * contrast).clip(0, 255)
    if sharpness != 1 and min(x.shape[:2]) > 2:
        around = sum(x[1 + dy : x.shape[0] - 1 + dy, 1 + dx : x.shape[1] - 1 + dx] * (5 if dx == dy == 0 else 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)) / 13
        soft = x.copy()
        soft[1:-1, 1:-1] = around
        x = (soft + (x - soft) * sharpness).clip(0, 255)
    return np.rint(x).astype(np.uint8)


def decoded(content: Column | str) -> Column:
    """Size and grey bytes of an image file's content, or what is wrong with it; nulls for null."""

    @F.pandas_udf(DECODED)
    def run(content: pd.Series) -> pd.DataFrame:
        rows = []
        for x in content:
            try:
                image = None if x is None else grey_of(unpng(x))
                rows.append((None,) * 4 if image is None else (image.shape[1], image.shape[0], image.tobytes(), None))
            except ValueError as e:
                rows.append((None, None, None, str(e)))
        return pd.DataFrame(rows, columns=["width", "height", "grey", "error"]).astype({"width": "Int32", "height": "Int32"})

    return run(content)


def optimised_png(content: Column | str, use: str = "default") -> Column:
    """The content of an image file, optimised for a use; null for what is no image."""

    @F.pandas_udf("binary")
    def run(content: pd.Series) -> pd.Series:
        out = []
        for x in content:
            try:
                out.append(None if x is None else png(optimised(unpng(x), use)))
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(content)


def extension(path: Column) -> Column:
    """What stands after the last point of a file's name, lower case; the whole name if there is none."""
    return F.lower(F.element_at(F.split(F.element_at(F.split(path, "/"), -1), r"\."), -1))


def list_images(spark: SparkSession, folder: str, largest: int = LARGEST) -> tuple[DataFrame, DataFrame]:
    """The image files of a folder and its subfolders (path, length, content) by extension and size, and the other files (path, length, reason).

    The size filter reaches the source: larger files aren't read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    named = extension(F.col("path")).isin(*EXTENSIONS)
    kept = files.filter(F.col("length") <= largest).filter(named).select("path", "length", "content")
    reason = F.when(~named, "extension").otherwise("size")
    return kept, files.select("path", "length").filter(~named | (F.col("length") > largest)).withColumn("reason", reason)


def image_bytes(url: Column, fetched: Column) -> Column:
    """Bytes of an image: those a data: URI holds, or else those fetched for the URL."""
    return F.when(url.startswith("data:"), data_uri_bytes(url)).otherwise(fetched)


def write_files(rows: DataFrame, folder: str) -> int:
    """Write content (binary) of each row to folder/name; how many. A name that comes again, as in a second try of a task, is overwritten."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        files, at = FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        files.create_dir(at)
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist()):
                with files.open_output_stream(f"{at}/{name}") as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return rows.select("name", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
