"""Benchmark decontamination by template canonicalisation [operator 6].

Texts become templates: numbers, names and units are typed placeholders, other words
are folded. Windows of template words of the benchmark items are hash-joined with
those of the documents. For each alignment of a document with an item, the item's slot
values must map to the document's consistently (the same value always to the same
value), so a question with new numbers and names is caught and a chance likeness of
forms is not. A second kind of window keeps names as words, for copies in another case.

Items of fewer than SHORT words also have windows of NARROW words, so that one changed
word leaves some; they count if they cover most of the item in one place of the document.
Items without a window of WIDTH words that says something have one of the item's length:
of its words as they are, and of its template if that is literal enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lean, read_table, small, text_chunks
from .hashing import PLACE, SPACE, joined, mix, windows, words

#: Template words in a window; windows with fewer literal words say nothing and are left out.
WIDTH, LEAST_LITERAL = 8, 4
#: Items of WIDTH words or more, but fewer than SHORT, also have windows of NARROW words (LEAST_NARROW of them literal); together they have to cover so much of the item's words.
SHORT, NARROW, LEAST_NARROW, MIN_COVER = 20, 3, 2, 0.75
#: A document holds an item if so much of the item's windows occur in it, slots agreeing.
MIN_SHARE = 0.3
#: So many of an alignment's slot values may map to two values (typing errors, broken words).
MOST_INCONSISTENT = 0.2
#: Benchmarks of so many windows at most are looked up in the tasks; larger ones are joined by shuffle.
LOOKUP_WINDOWS = 1_000_000

# Unit words (placeholders only after a number) and number words.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds lb lbs oz ounce ounces ton tons "
    "ml l liter liters litre litres gallon gallons cup cups second seconds sec s minute minutes min hour hours hr h day days week weeks month months year years "
    "dollar dollars usd euro euros eur cent cents percent degree degrees mph kmh watt watts kw volt volts hz khz mhz ghz byte bytes kb mb gb tb"
).split()
NUMBERS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()

# Kinds of windows: by names as placeholders or words, wide (0, 1), narrow (2, 3) and of a whole item (4, 5); of a whole item with all words as they are (6).
HITS = "id long, kind int, pos long, width int, key long, slots array<long>, n_windows long"

_B = np.arange(256)
_DIGIT = (_B >= 48) & (_B <= 57)
_UPPER = (_B >= 65) & (_B <= 90)
_LOWER = (_B >= 97) & (_B <= 122)
_IGNORE = ~(_DIGIT | _UPPER | _LOWER | (_B >= 128))
_STOP = np.isin(_B, [*b".!?:"])
NUM, NAME, UNIT = (mix(np.array([x], np.uint64))[0] for x in (101, 102, 103))


def _known(names: list[str]) -> np.ndarray:
    buf, _ = joined([x.encode() for x in names])
    return np.sort(words(buf, _IGNORE)[2])


def _among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h if len(table) else np.zeros(len(h), bool)


_UNIT_HASHES, _NUMBER_HASHES = _known(UNITS), _known(NUMBERS)


def template(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts' words: folded hash, placeholder type (0: literal, 1: number, 2: name, 3: unit); where each text's words begin; whether a word is a name by case."""
    buf, at = joined(raws)
    low = np.where(_UPPER[buf], buf + 32, buf).astype(np.uint8)
    wide = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)) + 1
    low[wide] += 32
    upper = _UPPER[buf]
    upper[wide - 1] = True
    starts, ends, h = words(low, _IGNORE)
    counted = np.concatenate([[0], np.cumsum(~_IGNORE[buf])])
    real = counted[ends] > counted[starts]  # the others are punctuation only
    stop = np.ones(len(starts), bool)
    if len(starts) > 1:
        last_bytes = _STOP[buf[ends[:-1] - 1]] | _STOP[buf[np.maximum(ends[:-1] - 2, 0)]]
        line = np.concatenate([[0], np.cumsum(buf == 10)])
        stop[1:] = last_bytes | (line[starts[1:]] > line[ends[:-1]])
    where = np.flatnonzero(~_IGNORE[buf])
    first = where[np.minimum(np.searchsorted(where, starts), max(len(where) - 1, 0))] if len(where) else starts
    second = np.minimum(first + 1, len(buf) - 1)
    number = _DIGIT[buf[first]] | _among(h, _NUMBER_HASHES)
    name = upper[first] & ~_UPPER[buf[second]] & ~stop & ~number
    starts, h, number, name = starts[real], h[real], number[real], name[real]
    kind = np.where(number, 1, np.where(name, 2, 0))
    after = np.zeros(len(h), bool)
    after[1:] = number[:-1]
    kind[after & (kind == 0) & _among(h, _UNIT_HASHES)] = 3
    return h, kind, np.searchsorted(starts, at), name


def _runs(t: np.ndarray, width: int) -> np.ndarray:
    """windows of any width; the places of a window are len(PLACE)."""
    most = len(PLACE)
    if width <= most:
        return windows(t, width)
    rest = _runs(t[most:], width - most)
    return mix(windows(t, most)[: len(rest)] + rest * PLACE[1])


def window_keys(h: np.ndarray, kind: np.ndarray, form: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key of each window, its number of literal words, and the types: names as words (form 0), placeholders (1), or all as words (2)."""
    kind = (np.where(kind == 2, 0, kind), kind, np.zeros_like(kind))[form]
    t = np.choose(kind, [h, NUM, NAME, UNIT])
    n = max(len(h) - width + 1, 0)
    literal = np.concatenate([[0], np.cumsum(kind == 0)])
    return mix(_runs(t, width) + np.uint64(1 + form + (0 if width == WIDTH else 16 * width))), literal[width : width + n] - literal[:n], kind


def _near(hit: np.ndarray, owner: np.ndarray, least: int) -> np.ndarray:
    """The narrow windows with least covered words of their text within the reach of a short item."""
    word = np.zeros(len(owner) + 1, np.int64)
    np.add.at(word, np.flatnonzero(hit), 1)
    np.add.at(word, np.flatnonzero(hit) + NARROW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(word[:-1]) > 0)])
    at = np.flatnonzero(hit)
    begin = np.maximum(at - SHORT - NARROW, np.searchsorted(owner, owner[at]))
    end = np.minimum(at + SHORT + 2 * NARROW, np.searchsorted(owner, owner[at], "right"))
    out = np.zeros_like(hit)
    out[at[covered[end] - covered[begin] >= least]] = True
    return out


def _scan(keys: np.ndarray | None, lengths: list[int] | None = None, narrow: bool = True):
    """Rows of the windows of documents whose key is among keys (all, if None), with whole windows of lengths and narrow ones; of items, if lengths is None."""
    items = lengths is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, "text", 1 << 20):
            raws = [x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()]
            h, kind, at, _ = template(raws)
            ids = b.column("id").to_numpy(zero_copy_only=False)
            sizes = np.diff(at)
            owner = np.repeat(np.arange(len(raws)), sizes)
            rows: dict[str, list] = {k: [] for k in ("id", "kind", "pos", "width", "key", "slots", "n")}
            total = np.zeros(len(raws), np.int64)
            found = []

            def look(code: int, form: int, width: int, least: int, only: np.ndarray | None = None) -> np.ndarray:
                key, literal, types = window_keys(h, kind, form, width)
                ok = owner[: len(key)] == owner[width - 1 :] if len(key) else np.zeros(0, bool)
                ok &= literal >= least
                every = ok
                if form == 1:  # windows without a name are the same in both kinds
                    named = np.concatenate([[0], np.cumsum(types == 2)])
                    ok = ok & (named[width : width + len(key)] > named[: len(key)])
                if only is not None:
                    ok = ok & only[owner[: len(key)]]
                if keys is not None:
                    ok = ok & _among(key, keys)
                found.append([code, ok, key, types, width])
                return every

            for form in (0, 1):
                every = look(form, form, WIDTH, LEAST_LITERAL)
                if form == 0:
                    total = np.bincount(owner[: len(every)][every], minlength=len(raws))
            wide = [x for _, ok, *_ in found for x in owner[: len(ok)][ok]] if items else []
            none = sizes > 0
            none[wide] = False
            short = (sizes >= WIDTH) & (sizes < SHORT)
            if narrow and (not items or short.any()):
                for form in (0, 1):
                    look(2 + form, form, NARROW, LEAST_NARROW, short if items else None)
                if keys is not None and len(found[2][1]):
                    near = _near(found[2][1] | found[3][1], owner, int(np.ceil(MIN_COVER * WIDTH)))
                    for x in found[2:4]:
                        x[1] = x[1] & near
            for width in np.unique(sizes[none]).tolist() if items else lengths:
                for form in (0, 1, 2):
                    look(4 + form, form, width, -(-width // 2), none & (sizes == width) if items else None)
            for code, ok, key, types, width in found:
                for i in np.flatnonzero(ok):
                    o = owner[i]
                    rows["id"].append(ids[o])
                    rows["kind"].append(code)
                    rows["pos"].append(int(i - at[o]))
                    rows["width"].append(width)
                    rows["key"].append(int(key[i].view(np.int64)))
                    rows["slots"].append(h[i : i + width][types[i : i + width] > 0].view(np.int64))
                    rows["n"].append(int(total[o]) if code < 2 else int(sizes[o]) if code < 4 else 1)
            if rows["id"]:
                types_ = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types_)], names=["id", "kind", "pos", "width", "key", "slots", "n_windows"])

    return run


def template_windows(texts: DataFrame, id_col: str, keys: np.ndarray | None = None, lengths: list[int] | None = None, narrow: bool = True) -> DataFrame:
    """Windows (id, kind, pos, width, key, slots, n_windows) of a frame with columns id_col and text; of items, if lengths of whole items is None."""
    rows = texts.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter(F.col("id").isNotNull())
    return rows.mapInArrow(lean(_scan(keys, lengths, narrow)), HITS)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_share: float = MIN_SHARE, lookup_windows: int = LOOKUP_WINDOWS) -> DataFrame:
    """doc_id, item_id, share and windows of every document that holds a benchmark item.

    share is the part of the item's windows found in the document in alignments whose
    slots agree; 1 for an item found as a whole by a window of its own length; for items
    found by narrow windows only, the part of their words that these cover. Items without
    a word, null and empty texts and null ids give no rows. Each pair comes once, however
    often the item is repeated.
    """
    items = cut(template_windows(benchmark, "item_id"))
    n = items.select("key").distinct().limit(lookup_windows + 1).count()
    keys = None
    if n <= lookup_windows:  # 8 bytes each, so at most 8 MB
        keys = np.sort(np.array([r[0] for r in items.select("key").distinct().collect()], np.int64).view(np.uint64))
    lengths = sorted(r[0] for r in items.filter("kind >= 4").select("width").distinct().collect())
    narrow = items.filter("kind IN (2, 3)").limit(1).count() > 0
    side = items.drop("width").toDF("item_id", "kind", "ipos", "key", "islots", "n_windows")
    seen = template_windows(docs, "doc_id", keys, lengths, narrow).drop("n_windows", "width").toDF("doc_id", "kind", "pos", "key", "dslots")
    hits = cut(seen.join(small(side), ["kind", "key"]).withColumn("shift", F.col("pos") - F.col("ipos")).drop("key"))
    pair = ["doc_id", "item_id", "kind", "shift"]
    slots = hits.select(*pair, F.explode(F.arrays_zip("islots", "dslots")).alias("s")).select(*pair, "s.*")
    value = slots.groupBy(*pair, "islots").agg(F.min("dslots").alias("lo"), F.max("dslots").alias("hi"))
    bad = value.groupBy(*pair).agg(F.avg((F.col("lo") != F.col("hi")).cast("double")).alias("odd")).filter(F.col("odd") > MOST_INCONSISTENT).select(*pair)
    good = hits.join(bad, pair, "left_anti")
    whole = good.withColumn("class", F.when(F.col("kind") < 2, 0).otherwise(1)).filter(~F.col("kind").isin(2, 3))
    found = whole.groupBy("doc_id", "item_id", "class").agg(F.countDistinct("ipos").alias("windows"), F.max("n_windows").alias("n"))
    found = found.filter(F.col("windows") >= F.col("n") * min_share).select("doc_id", "item_id", "class", (F.col("windows") / F.col("n")).alias("share"), "windows")
    parts = good.filter(F.col("kind").isin(2, 3)).withColumn("place", F.explode(F.array(*[F.col("shift") + k for k in (-1, 0, 1)])))  # a word more or less moves an alignment by one
    parts = parts.select("doc_id", "item_id", "place", "ipos", "n_windows", F.explode(F.sequence("ipos", F.col("ipos") + NARROW - 1)).alias("word"))
    parts = parts.groupBy("doc_id", "item_id", "place").agg(F.countDistinct("word").alias("covered"), F.countDistinct("ipos").alias("windows"), F.max("n_windows").alias("n"))
    parts = parts.filter(F.col("covered") >= F.col("n") * MIN_COVER).select("doc_id", "item_id", F.lit(2).alias("class"), (F.col("covered") / F.col("n")).alias("share"), "windows")
    best = found.unionByName(parts).groupBy("doc_id", "item_id").agg(F.min_by(F.struct("share", "windows"), F.struct("class", -F.col("share"), -F.col("windows"))).alias("b"))
    return best.select("doc_id", "item_id", "b.share", "b.windows")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
