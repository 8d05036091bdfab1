"""Circulant MinHash near-dedup [operator 5].

Two random permutations of a universe of D places: the first places a shingle, the
second, shifted circularly by 0, 1, .. K-1, gives the K signature coordinates. Bands
of coordinates propose pairs; exact Jaccard similarity on full shingle sets decides.

Texts with equal sets collapse into one class first. Every class is tried with one
leader of its buckets, the leaders being those with most bucket mates, the centres of
large groups, so that a large group costs about its size. Classes that are then still in
one bucket but in different components go to an exact prefix filter on the rarest
shingles, which proposes every pair of them that can still be a link; what a component
already joins needs no test. Where these pairs are many, rounds with one leader of a
class's index buckets, in a random order, come first and halve the components about each
time, until few pairs are left, a round joins hardly any, or the pairs are one part and a
round hardly makes them fewer; the pairs left are then tested in parts of about PAIRS times
the index's rows (LEAST_PART at least), each after the components of the part before, so
that what is stored at a time does not grow with their number. A round reads only the rows
of buckets that the one before left open. Links become
links between components before components are computed. A link between classes that
share no band with any class of another component is not met (see BANDS); no other is
lost, and large groups are not paired in bulk.

Tables that the next step no longer needs are deleted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, lean, read_table, small, stored, text_chunks, tidy
from .components import components
from .hashing import PLACE, joined, mix, windows, words

SHINGLE = 5
#: A pair at the similarity of 0.75 shares no band with a chance of (1 - 0.75 ** ROWS) ** BANDS, 2e-5.
BANDS, ROWS = 40, 5
UNIVERSE_BITS = 20
#: Pairs of what is left in the prefix index are tested, so many times its rows at a time, once they are no more than that or when a round of leaders links less than GAIN of the classes.
PAIRS, GAIN = 2, 0.001
#: Fewer pairs than this (some 100 MB) are no part of their own.
LEAST_PART = 1 << 22
#: Pairs of one part are tested at once, too, when a round leaves more than this share of them; most of them can't be links then.
SAVED = 0.9
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75

SIGNED = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"
SETS = "doc_id long, shingles array<long>"
_tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def shingle_sets(raws: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text (UTF-8, A-Z as a-z)."""
    buf, at = joined([x.lower() for x in raws])
    starts, _, h = words(buf)
    first = np.searchsorted(starts, at)
    runs = windows(h, SHINGLE)
    out = []
    for a, b in zip(first, first[1:]):
        n = b - a
        if n >= SHINGLE:
            out.append(np.unique(runs[a : b - SHINGLE + 1]))
        elif n:
            short = (h[a:b] * PLACE[:n]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short + PLACE[-n:][:1]))
        else:
            out.append(h[:0])
    return out


def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    """The placing permutation, and a view whose row p holds the second one at p, p+1, .. p+k-1 (circularly)."""
    if (UNIVERSE_BITS, k) not in _tables:
        rng = np.random.Generator(np.random.PCG64(7))
        sigma = rng.permutation(1 << UNIVERSE_BITS).astype(np.uint32)
        pi = rng.permutation(1 << UNIVERSE_BITS).astype(np.uint32)
        _tables[UNIVERSE_BITS, k] = sigma, np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: k - 1]]), k)
    return _tables[UNIVERSE_BITS, k]


def signature(shingles: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """The k circulant MinHash coordinates of a non-empty set."""
    sigma, rows = _permutations(k)
    place = sigma[shingles >> np.uint64(64 - UNIVERSE_BITS)]
    best = rows[place[0]].copy()
    for i in range(0, len(place), 1024):
        np.minimum(best, rows[place[i : i + 1024]].min(0), out=best)
    return best


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    keys = (sig.reshape(bands, rows).astype(np.uint64) * PLACE[:rows]).sum(1, dtype=np.uint64)
    return mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * PLACE[rows]).view(np.int64)


def _raws(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_chunks(batches, "text", 1 << 20):
        n, s1, s2, keys = [], [], [], []
        for s in shingle_sets(_raws(b)):
            n.append(len(s))
            m = mix(s ^ PLACE[1])
            s1.append(int(m.sum(dtype=np.uint64).view(np.int64)))
            s2.append(int(np.bitwise_xor.reduce(mix(m + PLACE[2]), initial=np.uint64(0)).view(np.int64)))
            keys.append(band_keys(signature(s)) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "s1", "s2", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_chunks(batches, "text", 1 << 20):
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.view(np.int64) for x in shingle_sets(_raws(b))], pa.list_(pa.int64()))], names=["doc_id", "shingles"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def bucket_members(full: DataFrame, classes: DataFrame) -> DataFrame:
    """key, rep, n, left and order of each class in a bucket that others share, stored. order: the class's bucket mates."""
    reps = full.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    rows = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"))
    shared = stored(rows.groupBy("key").agg(F.count("*").alias("mates")).filter("mates > 1"), "shared")  # a plain table, so that hot keys can be split
    mates = F.sum("mates").over(Window.partitionBy("rep"))  # BANDS rows at most
    out = stored(rows.join(shared, "key").select("key", "rep", "n", F.col("n").alias("left"), mates.alias("order")), "members")
    forget(shared)
    return out


def set_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and shingles of the documents whose doc_id is in ids, stored."""
    return stored(_texts(docs).join(small(ids), "doc_id", "left_semi").mapInArrow(lean(_sets), SETS), "sets")


def verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (stored: a, b, ca, cb) whose full sets have the similarity asked for, stored in place of them."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    like = 100 * both >= PERCENT * (F.size("sa") + F.size("sb") - both)
    out = stored(pairs.join(left, "a").join(right, "b").filter(like).select("a", "b", "ca", "cb"), "links")
    forget(pairs)
    return out


def prefix_index(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """key, rep, n and left of the exact prefix filter for the classes reps (rep), stored.

    In one order of all shingles, here the rarest first, the first common shingle of a
    link leaves each set with the overlap that the similarity needs, or more: a shingle
    is in the index where so much of the set is left, itself included.
    """
    token = sets.select(F.col("doc_id").alias("rep"), F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("key")).join(small(reps), "rep", "left_semi")
    often = stored(token.groupBy("key").agg(F.count("*").alias("freq")).filter("freq > 1"), "frequent")
    doc = Window.partitionBy("rep")
    place = F.row_number().over(doc.orderBy("freq", "key")) - 1 + F.col("n") - F.count("*").over(doc)  # those of frequency 1 come first
    most = F.col("n") - F.ceil(F.col("n") * PERCENT / 100)
    out = stored(token.join(often, "key").withColumn("left", (F.col("n") - place).cast("long")).filter(F.col("n") - F.col("left") <= most).select("key", "rep", "n", "left"), "index")
    forget(often)
    return out


def _can(x: str, y: str):
    """Whether two members of a bucket, by size (n) and what is left of them, can be a link: overlap >= PERCENT / (100 + PERCENT) of both sizes."""
    need = PERCENT * (F.col(f"{x}.n") + F.col(f"{y}.n"))
    return ((100 + PERCENT) * F.col(f"{x}.left") >= need) & ((100 + PERCENT) * F.col(f"{y}.left") >= need)


def leader_pairs(where: DataFrame) -> DataFrame:
    """A pair (a, b) for classes a in buckets with several components (ca, cb): b is the leader of such a bucket from another component; stored.

    where: key, rep, n, left, order, comp. A bucket's leader is its class of the highest
    order, and the members of the leader's component look to the highest of the others.
    Of the leaders that a class can be linked with, it is paired with the highest.
    """
    top = where.groupBy("key", "comp").agg(F.max(F.struct("order", "rep", "n", "left")).alias("top"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("top")))
    two = top.withColumn("place", place).filter("place <= 2").groupBy("key").agg(*[F.max(F.when(F.col("place") == i, F.struct("top.*", "comp"))).alias(f"l{i}") for i in (1, 2)])
    two = stored(two.filter("l2 is not null"), "leaders")
    sight = where.join(two, "key").select(F.struct("rep", "n", "left", "comp").alias("x"), F.when(F.col("comp") == F.col("l1.comp"), F.col("l2")).otherwise(F.col("l1")).alias("y"))
    best = sight.filter(_can("x", "y")).groupBy(F.col("x.rep").alias("a"), F.col("x.comp").alias("ca")).agg(F.max("y").alias("y"))
    out = stored(best.select("a", F.col("y.rep").alias("b"), "ca", F.col("y.comp").alias("cb")), "pairs")
    forget(two)
    return out


def bucket_pairs(where: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """Every pair (a, b) of different components (ca, cb) in one bucket that can be a link, stored. Members of a bucket's largest component are paired with the others only.

    Of several parts, one has the pairs of a share of the buckets' members, by a hash.
    """
    sizes = where.groupBy("key", "comp").agg(F.count("*").alias("c"))
    main = stored(sizes.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps")).filter("comps > 1").select("key", "main"), "main")
    rows = where.join(main, "key").select("key", "main", F.struct("rep", "n", "left", "comp").alias("m"))
    x, y = rows.filter("m.comp <> main").select("key", F.col("m").alias("x")), rows.select("key", "main", F.col("m").alias("y"))
    if parts > 1:
        x = x.filter(F.pmod(F.xxhash64("key", "x.rep"), F.lit(parts)) == part)
    once = (F.col("y.comp") == F.col("main")) | (F.col("x.rep") < F.col("y.rep"))  # members of other components meet from both sides
    pairs = x.join(y, "key").filter((F.col("x.comp") != F.col("y.comp")) & once & _can("x", "y"))
    swap = F.col("x.rep") > F.col("y.rep")
    a, b = F.when(swap, F.col("y")).otherwise(F.col("x")), F.when(swap, F.col("x")).otherwise(F.col("y"))
    out = stored(pairs.select(a["rep"].alias("a"), b["rep"].alias("b"), a["comp"].alias("ca"), b["comp"].alias("cb")).distinct(), "pairs")
    forget(main)
    return out


def merged(label: DataFrame, found: DataFrame) -> DataFrame:
    """label (rep, comp) after the links found: components of components, stored."""
    top = components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    out = stored(label.join(small(top).toDF("comp", "top"), "comp", "left").select("rep", F.coalesce("top", "comp").alias("comp")), "components")
    forget(found, label, top)
    tidy()
    return out


def placed(rows: DataFrame, label: DataFrame) -> DataFrame:
    """rows (rep, ..) with comp."""
    return rows.join(small(label), "rep")


def opened(rows: DataFrame, label: DataFrame) -> DataFrame:
    """The rows (stored: key, rep, n, left) of buckets that hold several components of label, with comp; stored in place of them."""
    own = stored(placed(rows.drop("comp"), label), "placed")
    ends = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    out = stored(own.join(ends.filter("lo <> hi").select("key"), "key", "left_semi"), "open")
    forget(rows, own)
    return out


def open_pairs(where: DataFrame) -> int:
    """Pairs of different components in the buckets, a pair once in each bucket."""
    c, m = F.col("c"), F.sum("c")
    per = where.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(((m * m - F.sum(c * c)) / 2).alias("pairs"))
    return int(per.agg(F.sum("pairs")).first()[0] or 0)


def still_open(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (stored: a, b, ca, cb) of different components of label, with these, stored in place of them."""
    of = lambda x: label.select(F.col("rep").alias(x), F.col("comp").alias(f"c{x}"))
    out = stored(pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").filter("ca <> cb"), "pairs")
    forget(pairs)
    return out


def paired(sets: DataFrame, where: DataFrame, label: DataFrame, parts: int) -> DataFrame:
    """label (rep, comp) after the links among all pairs that the buckets where leave open, a part after another.

    Parts share the components that where has: they say from which side a pair is met, and
    a pair would be met from neither if its side changed in between.
    """
    for part in range(parts):
        pairs = bucket_pairs(where, part, parts)
        label = merged(label, verified(sets, still_open(pairs, label) if part else pairs))
    return label


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id of the row's component) and kept.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; a text's set is its distinct
    5-word shingles, or its whole word sequence if that is shorter. Texts without words,
    and nulls, have an empty set and are linked with nothing. kept marks the smallest id
    of each component. Rows with equal ids share a component. A null id is its own
    component, null, and kept. Only doc_id and text are read; an empty table gives none.
    """
    signed = stored(_texts(docs).mapInArrow(lean(_sign), SIGNED), "signed")
    full = signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = stored(full.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    members = bucket_members(full, classes)
    label = stored(members.select("rep").distinct().withColumn("comp", F.col("rep")), "components")
    sets = set_table(docs, label.select(F.col("rep").alias("doc_id")))
    label = merged(label, verified(sets, leader_pairs(members.withColumn("comp", F.col("rep")))))

    sizes = placed(members, label).groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mixed = stored(sizes.filter("lo <> hi").select("key"), "mixed")
    index = prefix_index(sets, members.join(mixed, "key", "left_semi").select("rep").distinct())
    forget(members, mixed)
    n, i, gain, before = index.count(), 0, 1.0, math.inf
    where = opened(index, label)
    while (left := open_pairs(where)) > 0:
        i += 1
        most = max(PAIRS * n, LEAST_PART)
        if left <= PAIRS * n or gain < GAIN or SAVED * before < left <= most:
            label = paired(sets, where, label, math.ceil(left / most))
            break
        found = verified(sets, leader_pairs(where.withColumn("order", F.xxhash64("rep", F.lit(i)))))
        gain, before = found.count() * 1.0 / max(label.count(), 1), left
        label = merged(label, found)
        where = opened(where, label)
    forget(sets, where)

    comp = label.filter("rep <> comp").union(label.filter("rep <> comp").select("comp", "comp")).distinct()
    touched = classes.join(small(comp), "rep", "left").filter("copies > 1 or comp is not null")
    touched = touched.select("s1", "s2", "n_shingles", F.coalesce("comp", "rep").alias("component_id"))
    out = signed.drop("bands").join(touched, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
