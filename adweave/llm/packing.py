"""Packing into optimal length buckets [operator 2].

A document's length is its number of token ids. One aggregation gives the global
histogram of lengths; dynamic programming over it (on the driver, over distinct lengths)
picks the bucket boundaries with the least padding; inside each bucket, documents form
batches under a token budget. A batch points at its documents' ids by doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import lean, read_table, stored, text_chunks
from .token_output import encoder

N_BUCKETS = 16
BATCH_TOKENS = 65_536
#: Batches form among so many rows of a bucket at a time, so no bucket is one task.
SHARD_ROWS = 4_096
#: Units that a task's tokenizer keeps.
CACHE_UNITS = 500_000


def _lengths(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in text_chunks(batches, "text", 1 << 20):
            n = [len(x) + 1 for x in own.encode([t or "" for t in b.column("text").to_pylist()])]
            if own.n > CACHE_UNITS:
                own.clear()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return run


def token_lengths(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id and n_tokens, the token ids of each text and one end id, as in operator 3's tables. Null counts as empty."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(_lengths(tokenizer_path)), T.StructType([rows.schema["doc_id"], T.StructField("n_tokens", T.LongType())]))


def choose_buckets(lengths: np.ndarray, counts: np.ndarray, k: int) -> list[int]:
    """Upper bounds of at most k buckets that minimise the sum of (bound - length) over all documents.

    lengths: ascending and distinct. Bounds are lengths, the last one the largest. The
    best beginning of a bucket doesn't decrease with its end, so each layer is solved by
    halving: O(k n log n), a level of the halving at a time.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    n = len(lengths)
    if n == 0:
        return []
    c, s = (np.concatenate([[0], np.cumsum(x)]) for x in (counts, counts * lengths))
    best = c[1:] * lengths - s[1:]  # of the lengths up to j, as one bucket
    back = [np.zeros(n, np.int64)]
    for layer in range(1, min(k, n)):
        new, arg = best.copy(), np.zeros(n, np.int64)  # fewer buckets are among the choices
        lo, hi, left, right = (np.array([x]) for x in (layer, n - 1, layer, n - 1))
        while len(lo):
            mid = (lo + hi) // 2
            end = np.minimum(right, mid)
            sizes = end - left + 1
            first = np.cumsum(sizes) - sizes
            i = np.arange(int(sizes.sum())) - np.repeat(first - left, sizes)  # the last bucket's first length
            j = np.repeat(mid, sizes)
            cost = best[i - 1] + (c[j + 1] - c[i]) * lengths[j] - (s[j + 1] - s[i])
            least = np.minimum.reduceat(cost, first)
            at = np.flatnonzero(cost == np.repeat(least, sizes))
            pick = i[at[np.searchsorted(at, first)]]
            better = least < new[mid]
            new[mid[better]], arg[mid[better]] = least[better], pick[better]
            parts = [(lo, mid - 1, left, pick), (mid + 1, hi, pick, right)]
            lo, hi, left, right = (np.concatenate([p[x] for p in parts]) for x in range(4))
            some = lo <= hi
            lo, hi, left, right = lo[some], hi[some], left[some], right[some]
        back.append(arg)
        best = new
    bounds, j = [], n - 1
    for arg in reversed(back):
        if arg[j] == 0 and arg is not back[0]:
            continue  # fewer buckets do
        bounds.append(int(lengths[j]))
        j = int(arg[j]) - 1
        if j < 0:
            break
    return bounds[::-1]


def pack(docs: DataFrame, length: Column | None = None, n_buckets: int = N_BUCKETS, batch_tokens: int = BATCH_TOKENS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per document: doc_id, n_tokens, bucket (from 0), bucket_len, batch_id, slot, padding.

    length: token count of a row, by default token_lengths, so null and empty texts
    have the one end token. bucket_len is the length of a bucket's longest document. A
    batch holds documents of one bucket, padded to bucket_len, within batch_tokens
    together, and one document at least: a bucket whose documents are longer than the
    budget has batches of one. batch_id is bucket-shard-number. Rows with equal or null
    ids are separate documents; an empty table gives no rows. Other columns are not read.
    """
    rows = token_lengths(docs) if length is None else docs.select("doc_id", length.cast("long").alias("n_tokens"))
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()), "lengths")  # the texts are read once
    hist = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").collect()
    lengths, counts = (np.array([r[i] for r in hist], dtype=np.int64) for i in range(2))
    bounds = choose_buckets(lengths, counts, n_buckets) or [1]
    at = np.searchsorted(bounds, lengths)
    per = [int(counts[at == i].sum()) for i in range(len(bounds))]
    bucket = F.lit(0)
    for b in bounds[:-1]:
        bucket = bucket + (F.col("n_tokens") > b).cast("int")
    pick = lambda values: F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("bucket") + 1)
    rows = rows.withColumn("bucket", bucket.cast("int")).withColumn("__h", F.xxhash64("__row"))
    rows = rows.withColumn("__shard", F.pmod(F.shiftright("__h", 20), pick([max(1, -(-n // shard_rows)) for n in per])))
    w = Window.partitionBy("bucket", "__shard").orderBy("__h", "__row")
    rank = F.row_number().over(w) - 1
    rows = rows.withColumn("__r", rank).withColumn("__cap", pick([max(1, batch_tokens // b) for b in bounds])).withColumn("bucket_len", pick(bounds))
    return rows.select(
        "doc_id",
        "n_tokens",
        "bucket",
        "bucket_len",
        F.concat_ws("-", "bucket", "__shard", F.floor(F.col("__r") / F.col("__cap")).cast("string")).alias("batch_id"),
        (F.col("__r") % F.col("__cap")).cast("long").alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )


def op2_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
