"""Spelling variant grouping by two-dimensional range reporting [operator 12].

Words and their counts come from one pass over the texts. Two words that are one edit
apart share the half of the shorter word that the edit is not in: by its first half if
the edit is behind it, or else by its second half. So words meet in groups by length and
half, dealt out over tasks; within a task, for each edit position of a word the prefix
interval in forward order meets the suffix interval in reverse order in a wavelet tree.
Groups of many words are dealt out in chunks, and a task takes a chunk of the words asked
about and a chunk of the index. Tasks return a row for each word, no pairs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, lean, read_table, small, stored
from .wavelet import one_edit

#: Words have so many code points and so many occurrences at least.
LENGTH, OCCURRENCES = 6, 5
#: An occurrence loses a code point if this divides the checksum of its document and word.
MUTATION = 199
#: A word's form has so many times its occurrences at least.
TIMES = 5
#: Words of a chunk of a large group, about, and words of a task, about.
CHUNK, TASK = 20_000, 50_000
#: Bytes of a text that are split into words in one step, and words that a task holds before it hands them on.
PIECE, HELD = 1 << 22, 200_000

COUNTED = "word string, n long"
NEAR = "word string, n_near long, best struct<n: long, word: string>"

_LETTERS = [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]
#: Latin-1 bytes: letters, A-Z as a-z, all else a space.
_TABLE = bytes(x + 32 if 0x41 <= x <= 0x5A else x if x in _LETTERS else 0x20 for x in range(256))


def _pieces(raw: bytes) -> Iterator[bytes]:
    """raw (letters and spaces) in pieces of about PIECE bytes that end between words."""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end]
        at = end


def count_words(doc_id: str, text: str, into: Counter) -> None:
    """Add the words of a text to `into`, as Latin-1 bytes, after the mutation."""
    raw = text.encode("latin-1", "replace").translate(_TABLE)
    begin = zlib.crc32(f"{doc_id}:".encode())
    own: Counter = Counter()
    for piece in _pieces(raw):
        own.update(piece.split())
    for w, n in own.items():
        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), begin)
        if not h % MUTATION:
            i = h % len(w)
            w = w[:i] + w[i + 1 :]
        if len(w) >= LENGTH:
            into[w] += n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array([*held.values()], pa.int64())], names=["word", "n"])
        held.clear()
        return got

    for b in batches:
        ids = b.column("doc_id")
        for k, text in enumerate(b.column("text")):
            if text.is_valid:
                count_words(str(ids[k].as_py()) if ids[k].is_valid else "", text.as_py(), held)
                if len(held) >= HELD:
                    yield out()
    if held:
        yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n of the words with enough code points and occurrences, stored."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(_counted), COUNTED)
    return stored(rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= OCCURRENCES), "vocabulary")


def groups(words: DataFrame) -> DataFrame:
    """A row for each word, group and role: short (the length of the group's shorter words), first (whether they share the first half), unit, task, asked, word, n.

    A group has the words of length `short` and `short` + 1 with the same first, or last,
    half. Words of the shorter length are asked about and are in the index; longer ones
    are in the index only. A group of k chunks has the tasks (asked chunk, index chunk).
    """
    n = F.length("word")
    side = F.explode(F.array(*[F.struct((n - less).alias("short"), F.lit(first).alias("first")) for less in (0, 1) for first in (True, False)]))
    rows = words.select("word", "n", n.alias("len"), side.alias("g")).select("word", "n", "len", "g.*").filter(F.col("short") >= LENGTH)
    half = F.floor(F.col("short") / 2).cast("int")
    rest = (F.col("short") - half).cast("int")
    rows = rows.withColumn("half", F.when(F.col("first"), F.substring("word", F.lit(1), half)).otherwise(F.substring("word", F.col("len") - rest + 1, rest)))
    key = ["short", "first", "half"]
    hot = stored(rows.groupBy(*key).agg(F.count("*").alias("c")).filter(F.col("c") > CHUNK).select(*key, F.ceil(F.col("c") / CHUNK).cast("int").alias("k")), "hot")
    rows = rows.join(small(hot), key, "left").withColumn("k", F.coalesce("k", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), "k").cast("int")
    asks = rows.filter(F.col("len") == F.col("short")).select("*", F.lit(True).alias("asked"), own.alias("a"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("b"))
    index = rows.select("*", F.lit(False).alias("asked"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("a"), own.alias("b"))
    rows = asks.union(index.select(asks.columns))
    unit = F.when(F.col("k") > 1, F.xxhash64(*key, "a", "b")).otherwise(F.lit(0))  # chunks must not meet those of other tasks
    return rows.select("short", "first", unit.alias("unit"), F.xxhash64(*key, "a", "b").alias("task"), "asked", "word", "n")


def _near(short: int, first: bool, rows: list[tuple[bool, bytes, int]]) -> dict[bytes, list]:
    """word: [near words, n of the best one, the best one] for the words of one length class and side; words of different halves don't meet."""
    out: dict[bytes, list] = {}
    edits = range(short // 2, short + 1) if first else range(short // 2 - 1, -1, -1)

    def table(want_asked: bool, length: int) -> tuple[np.ndarray, np.ndarray]:
        own = sorted({(w, n) for asked, w, n in rows if asked == want_asked and len(w) == length})
        return np.frombuffer(b"".join(w for w, _ in own), np.uint8).reshape(-1, length), np.array([n for _, n in own], np.int64)

    def add(words: np.ndarray, who: np.ndarray, others: np.ndarray, n: np.ndarray, other: np.ndarray) -> None:
        """For each of words[who] count the others and keep the best."""
        by = np.lexsort((other, -n[other], who))  # rows are in code-point order
        who, other = who[by], other[by]
        lead = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        for at, c in zip(lead.tolist(), np.diff(np.append(lead, len(who))).tolist()):
            w, v, m = words[who[at]].tobytes(), others[other[at]].tobytes(), int(n[other[at]])
            old = out.setdefault(w, [0, m, v])
            old[0] += c
            if (-m, v) < (-old[1], old[2]):
                old[1:] = m, v

    asked, n_asked = table(True, short)
    if not len(asked):
        return out
    for length in (short, short + 1):
        index, n = table(False, length)
        if not len(index):
            continue
        for q, v in one_edit(asked, index, edits if length > short or not first else edits[:-1]):
            if len(q):
                add(asked, q, index, n, v)
                if length > short:
                    add(index, v, asked, n_asked, q)
    return out


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are sorted by short, first and unit: one class after the other; groups of one chunk together, which don't meet."""
    key, rows = None, []

    def out() -> pa.RecordBatch:
        near = _near(*key[:2], rows)
        best = [{"n": n, "word": w.decode("latin-1")} for _, n, w in near.values()]
        return pa.RecordBatch.from_arrays(
            [pa.array([w.decode("latin-1") for w in near], pa.string()), pa.array([c for c, *_ in near.values()], pa.int64()), pa.array(best, pa.struct([("n", pa.int64()), ("word", pa.string())]))],
            names=["word", "n_near", "best"],
        )

    for b in batches:
        for short, first, unit, asked, word, n in zip(*(b.column(c).to_pylist() for c in ("short", "first", "unit", "asked", "word", "n"))):
            if (short, first, unit) != key:
                if rows:
                    yield out()
                key, rows = (short, first, unit), []
            rows.append((asked, word.encode("latin-1"), n))
    if rows:
        yield out()


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near and best (n, word: the near word of the largest n, ties by code points) of the words (word, n) with a near word."""
    rows = stored(groups(words), "groups")
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // TASK)
    found = rows.repartition(tasks, "task").sortWithinPartitions("short", "first", "unit").drop("task").mapInArrow(lean(_neighbours), NEAR)
    least = F.min(F.struct((-F.col("best.n")).alias("n"), F.col("best.word").alias("word"))).alias("best")
    out = stored(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least).select("word", "n_near", F.struct((-F.col("best.n")).alias("n"), "best.word").alias("best")), "near")
    forget(rows)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word and root (the last of the words that follow by forms) for rows word, form; each round doubles the steps.

    Counts grow by TIMES at each step, so there is no cycle, and few rounds.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = small(now).toDF("root", "next")
        new = stored(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not new.filter("moved").isEmpty()
        forget(now)
        now = new.drop("moved")
        now._adweave_path = new._adweave_path
        if not moved:
            return now


def spelling_groups(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of LENGTH code points and OCCURRENCES occurrences or more.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, some with a
    code point less (MUTATION). Near words differ by one inserted, deleted or replaced
    code point; a word's form is its near word with most occurrences (ties: the smallest
    in code-point order), if that has TIMES as many; root follows forms to the last.
    Null and empty texts have no words; a null doc_id counts as empty in the checksum.
    Rows with equal ids are counted each; texts and words of any length count whole. Only
    doc_id and text are read. An empty table gives no rows.
    """
    words = vocabulary(docs)
    near = near_words(words)
    form = F.when(F.col("best.n") >= TIMES * F.col("n"), F.col("best"))
    rows = stored(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form["word"].alias("form"), form["n"].alias("form_n")), "forms")
    forget(words, near)
    root = roots(rows.filter("form is not null"))
    return rows.join(small(root), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_wavelet_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(read_table(spark, sf_dir, "documents"))
