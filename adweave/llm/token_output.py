"""Token ids as a binary table of range-coded blocks [operator 3].

Documents are dealt out by ranges of doc_id and tokenised in that order. A row of the
table is a segment: some million ids in blocks that are coded and reset independently,
each with a CRC-32 of its ids, and an index of the documents in it. Reading decodes the
segments again. Only pieces between white space that a task has not met are tokenised.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import hashing, range_coder
from .common import read_table, small, stored, text_chunks

END = 0
#: Ids in a segment (a longer document is a segment of its own) and in a block; units kept, of some 30 bytes each.
SEGMENT, BLOCK, CACHE_UNITS = 8_000_000, 512, 2_000_000

SEGMENTS = "part int, seq int, n_ids long, block int, symbols binary, counts binary, sizes array<int>, crcs array<long>, data array<binary>, doc_ids array<long>, lengths array<long>"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"

#: White space other than ASCII's; texts with it are tokenised whole.
_ODD = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BLANK = b" \t\n\v\f\r"
#: Units encoded together; the tokenizer takes more time a byte for longer texts.
RUN = 256
_loaded: dict[str, object] = {}
_encoders: dict = {}


def load_tokenizer(path: str | None = None):
    """The tokenizer of a file (by default the public byte-level BPE), once a process, with the library's own settings: its control strings in a text get their ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    if path not in _loaded:
        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


class _Places:
    """A hash table from 64-bit hashes to numbers, looked up and filled many at a time; half of it is empty at least."""

    def __init__(self) -> None:
        self.n, self.bits = 0, 18
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for those that are not in the table."""
        h = np.maximum(h, np.uint64(1))  # 0 is an empty place
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[at]
        out = np.where(there == h, self.values[at], -1)
        i = np.flatnonzero((there != h) & (there != 0))
        while len(i):
            at[i] = (at[i] + 1) & (len(self.keys) - 1)
            there = self.keys[at[i]]
            same = there == h[i]
            out[i[same]] = self.values[at[i[same]]]
            i = i[~same & (there != 0)]
        return out

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """Put distinct hashes that the table lacks into it."""
        h = np.maximum(h, np.uint64(1))
        self.n += len(h)
        if 2 * self.n > len(self.keys):
            had = np.flatnonzero(self.keys)
            h, values = np.concatenate([self.keys[had], h]), np.concatenate([self.values[had], values])
            self.bits = int(4 * self.n).bit_length()
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        i = np.arange(len(h))
        while len(i):
            free = self.keys[at[i]] == 0
            self.keys[at[i[free]]] = h[i[free]]
            own = self.keys[at[i]] == h[i]  # of several for one place, one got it
            self.values[at[i[own]]] = values[i[own]]
            i = i[~own]
            at[i] = (at[i] + 1) & (len(self.keys) - 1)


class Encoder:
    """Ids of texts, with the ids of met units kept by hash for later texts of the process.

    Pre-tokenisation never joins what stands on both sides of a unit's beginning (see
    hashing.units), so the ids of a text are those of its units.
    """

    def __init__(self, path: str | None = None) -> None:
        self.tokenizer = load_tokenizer(path)
        vocab = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        self.sizes[list(vocab.values())] = [len(x) for x in vocab]  # byte-level pieces have a character for each byte
        self.clear()

    def clear(self) -> None:
        self.known = _Places()
        self.n, self.begin, self.flat = 0, np.zeros(1 << 18, np.int64), np.zeros(1 << 20, np.uint32)

    def _batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after another, and how many each has."""
        gc.disable()  # so many lists at once set it off again and again
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        gc.enable()
        return np.array(list(chain.from_iterable(ids)), np.uint32), np.array([len(x) for x in ids], np.int64)

    def _run(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units that begin with white space and end with other bytes, encoded RUN together.

        Nothing joins across such units' beginnings, whichever units meet, so the ids'
        lengths in bytes say where each unit's ids end.
        """
        flat, _ = self._batch([b"".join(new[i : i + RUN]).decode() for i in range(0, len(new), RUN)])
        done, ends = np.cumsum(self.sizes[flat]), np.cumsum([len(u) for u in new])
        upto = np.searchsorted(done, ends)
        if not (done[upto] == ends).all():
            raise ValueError("the tokenizer joins bytes across white space")
        return flat, np.diff(upto, prepend=-1)

    def _keep(self, hashes: np.ndarray, new: list[bytes]) -> None:
        alone = np.array([u[0] not in _BLANK or u[-1] in _BLANK for u in new])
        order = np.argsort(alone, kind="stable")
        split = len(new) - int(alone.sum())
        flat, counts = (np.concatenate(x) for x in zip(self._run([new[i] for i in order[:split]]), self._batch([new[i].decode() for i in order[split:]])))
        while self.n + len(new) >= len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros(len(self.begin), np.int64)])
        self.begin[self.n + 1 : self.n + 1 + len(new)] = self.begin[self.n] + np.cumsum(counts)
        end = int(self.begin[self.n + len(new)])
        while len(self.flat) < end:
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        self.flat[end - len(flat) : end] = flat
        place = np.empty(len(new), np.int32)
        place[order] = np.arange(self.n, self.n + len(new))
        self.known.add(hashes, place)
        self.n += len(new)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        odd = [not t.isascii() and bool(_ODD.search(t)) for t in texts]
        raws = [b"" if o else t.encode() for t, o in zip(texts, odd)]
        sizes = np.array([len(r) for r in raws], np.int64)
        begins = np.cumsum(sizes) - sizes
        out = [np.zeros(0, np.uint32)] * len(texts)
        data = b"".join(raws)
        if data:
            if self.n > CACHE_UNITS:
                self.clear()
            starts, h = hashing.units(np.frombuffer(data, np.uint8), begins)
            k = self.known.find(h)
            lost = np.flatnonzero(k < 0)
            if len(lost):
                new, first, which = np.unique(h[lost], return_index=True, return_inverse=True)
                ends = np.append(starts[1:], len(data))
                i = lost[first]
                self._keep(new, [data[a:b] for a, b in zip(starts[i].tolist(), ends[i].tolist())])
                k[lost] = self.known.find(new)[which]
            n = self.begin[k + 1] - self.begin[k]
            ends = np.cumsum(n)
            ids = self.flat[np.arange(int(ends[-1])) + np.repeat(self.begin[k] - ends + n, n)]
            cut = np.concatenate([[0], ends])[np.searchsorted(starts, begins[1:])]
            out = np.split(ids, cut)
        return [self._whole(t) if o else x for t, o, x in zip(texts, odd, out)]


def encoder(path: str | None = None) -> Encoder:
    """The process's encoder for a file; what it has met in earlier tasks it still knows."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _segment(part: int, seq: int, docs: list, ids: list[np.ndarray], block: int) -> pa.RecordBatch:
    flat = np.concatenate(ids)
    symbols, counts, blocks = range_coder.encode(flat, min(block, len(flat)))
    row = [part, seq, len(flat), min(block, len(flat)), symbols.astype("<u4").tobytes(), counts.astype("<u4").tobytes(), [b[0] for b in blocks], [b[1] for b in blocks], [b[2] for b in blocks], docs, [len(x) for x in ids]]
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=[f.split()[0] for f in SEGMENTS.split(", ")])


def _encode(path: str | None, segment: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        docs, ids, total = [], [], 0
        for b in text_chunks(batches, "text", 1 << 20):
            for doc, own in zip(b.column("doc_id").to_pylist(), own_encoder.encode([t or "" for t in b.column("text").to_pylist()])):
                while total and total + len(own) + 1 > segment:
                    # the first half only, so that what is left at the end is half a segment at least: few blocks in step take more time an id
                    upto = np.cumsum([len(x) for x in ids])
                    cut = int(np.searchsorted(upto, total / 2)) + 1
                    yield _segment(part, seq, docs[:cut], ids[:cut], block)
                    docs, ids, total, seq = docs[cut:], ids[cut:], total - int(upto[cut - 1]), seq + 1
                docs.append(doc)
                ids.append(np.append(own, np.uint32(END)).astype(np.uint32))
                total += len(own) + 1
        if docs:
            yield _segment(part, seq, docs, ids, block)

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str | None = None, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """Segments of the token ids of docs, in ascending order of doc_id, as stored and read again.

    Null texts are empty, an empty text is the end id alone. Null ids come first; rows with
    equal ids are separate documents in order of text. An empty table has no segments.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(rows.mapInArrow(_encode(tokenizer_path, segment, block), SEGMENTS), "tokens")


def segment_ids(row: dict) -> np.ndarray:
    """The ids of a segment."""
    blocks = list(zip(row["sizes"], row["crcs"], row["data"]))
    return range_coder.decode(np.frombuffer(row["symbols"], "<u4"), np.frombuffer(row["counts"], "<u4"), blocks, row["block"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1).to_pylist()[0]
            ids = segment_ids(row)
            n = np.array(row["lengths"], np.int64)
            ends = np.cumsum(n)
            crc = [zlib.crc32(ids[e - k : e].astype("<u4").tobytes()) for e, k in zip(ends, n)]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - n), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the decoded segments.

    Raises if a block's ids do not have the checksum written with it.
    """
    sizes = segments.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # as many rows as partitions wrote
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    start = F.col("before") + F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    starts = sizes.join(parts, "part").select("part", "seq", start.alias("start"))
    return segments.join(small(starts), ["part", "seq"]).mapInArrow(_read, DOCUMENTS)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_tokens(read_table(spark, sf_dir, "documents")))
