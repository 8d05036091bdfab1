"""Media columns [operator 7]: WAV payloads, short-time spectra, peak-pair fingerprints.

A text's bytes become 8-bit mono samples of a WAV file in a binary column. The wave
module reads the stored bytes back; spectral peaks of short-time Fourier transforms
are paired into (time code, hash) arrays. Every document is worked on by itself, in
pieces of CHUNK frames, so equal texts give equal values and memory is bounded by
the longest text.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stored, text_chunks

PAD = 64
RATE = 8_000
FRAME, HOP = 256, 128
CHUNK = 2_048
#: Edges of the frequency bands; each frame offers its strongest bin of each band as a peak.
BANDS = (1, 12, 28, 60, 129)
#: An anchor pairs with so many following peaks, at most so many frames later.
FAN, SPAN = 3, 63

STORED = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, n_peaks long, times array<int>, hashes array<long>"

_WINDOW = np.hanning(FRAME + 1)[:FRAME].astype(np.float64)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as w:
        return w.readframes(w.getnframes())


def padded(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of PAD."""
    return data + bytes(-len(data) % PAD or (0 if data else PAD))


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Frame and bin of each spectral peak, in order of frame, and the number of frames."""
    x = samples.astype(np.float64) - 128.0
    short = FRAME - len(x) if len(x) < FRAME else -(len(x) - FRAME) % HOP
    x = np.concatenate([x, np.zeros(short)])  # silence, so that the last frame covers the end
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    n = len(frames)
    at = np.empty((n, len(BANDS) - 1), dtype=np.int64)
    power = np.empty((n, len(BANDS) - 1))
    for a in range(0, n, CHUNK):
        spec = np.fft.rfft(frames[a : a + CHUNK] * _WINDOW)
        mag = spec.real**2 + spec.imag**2
        rows = np.arange(len(mag))
        for b, (lo, hi) in enumerate(zip(BANDS, BANDS[1:])):
            i = mag[:, lo:hi].argmax(1) + lo
            at[a : a + CHUNK, b] = i
            power[a : a + CHUNK, b] = mag[rows, i]
    before = np.vstack([np.zeros((1, power.shape[1])), power[:-1]])
    after = np.vstack([power[1:], np.zeros((1, power.shape[1]))])
    t, b = np.nonzero((power > 0) & (power >= before) & (power > after))
    return t, at[t, b], n


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Time codes, pair hashes (bin 1, bin 2, frames between), frames and peaks."""
    t, f, n = peaks(samples)
    times, hashes = [], []
    for k in range(1, FAN + 1):
        dt = t[k:] - t[:-k]
        ok = dt <= SPAN
        times.append(t[:-k][ok])
        hashes.append(((f[:-k] << 20) | (f[k:] << 8) | dt)[ok])
    ts, hs = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((hs, ts))
    return ts[order].astype(np.int32), hs[order], n, len(t)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_chunks(batches, "text", 8 << 20):
        raw = [(x or "").encode() for x in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([to_wav(padded(x)) for x in raw], pa.binary())],
            names=["doc_id", "n_bytes", "media"],
        )


def _analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_chunks(batches, "media", 8 << 20):
        rows = []
        for media in b.column("media").to_pylist():
            payload = from_wav(media)
            times, hashes, n, peaks_n = fingerprint(np.frombuffer(payload, np.uint8))
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), n, peaks_n, times, hashes))
        cols = list(zip(*rows))
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("n_bytes"), *[pa.array(list(c), t) for c, t in zip(cols, types)]],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "n_peaks", "times", "hashes"],
        )


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media, a WAV file whose samples are the text's bytes.

    Null and empty texts are PAD zero samples; other texts end in zeros up to a multiple
    of PAD. One row per row of docs, whatever its id, repeated ids included.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_store, STORED)


def fingerprints(media: DataFrame) -> DataFrame:
    """Digests of stored media and their time-coded fingerprint arrays (times, hashes).

    Payloads of one frame or less have one frame; payloads with no varying sample have no
    peaks and empty arrays. times ascends; ties are in order of hash.
    """
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_analyse, READ)


def op7_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media digests of every document; feature names the fingerprint's size and digest."""
    media = stored(media_table(read_table(spark, sf_dir, "documents").select("doc_id", "text")), "media")
    text = F.concat_ws(",", F.transform(F.arrays_zip("times", "hashes"), lambda x: F.concat(x["times"].cast("string"), F.lit(":"), x["hashes"].cast("string"))))
    feature = F.concat_ws("/", F.lit("stft-pairs"), "n_frames", "n_peaks", F.size("times").cast("string"), F.md5(text))
    return fingerprints(media).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
