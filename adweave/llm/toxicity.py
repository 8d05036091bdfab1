"""Toxicity scores by a bidirectional gated recurrent network [operator 1].

Words and their character n-grams are the inputs; attention pools the states of a
window into one logit. The network is trained in numpy on windows of a bounded sample
of labelled documents. Every overlapping window of every text is scored; a document's
score is a calibrated function of its highest window. Scoring runs in Arrow batches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import gru
from .common import held_out, read_table, text_chunks

#: The training sample: so many toxic and clean documents, of so many characters at most.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 700, 1_400, 20_000
#: Words in a window, and from one window to the next.
WINDOW, STRIDE = 24, 12
DIM, HIDDEN, GRAMS, VOCABULARY = 8, 8, 4_096, 20_000
EPOCHS, BATCH = 10, 256
#: Windows of toxic training documents, and of clean ones, at most, of a document.
PER_TOXIC, PER_CLEAN = 3, 4
#: Beginnings of words, in characters, that may be typical of toxic texts.
STEMS = range(3, 8)
CACHE_WORDS = 300_000
#: Logit of a text without words.
NO_WORDS = -12.0
THRESHOLD = 0.7

_WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character trigrams of each word between edge marks, as buckets, and where each word's begin."""
    marked = [f"\x02{w}\x03" for w in words]
    sizes = np.array([len(w) for w in marked], np.int64)
    code = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = code[:-2] * np.uint64(0x9E3779B1) + code[1:-1] * np.uint64(0x85EBCA77C2B2AE3D) + code[2:] * np.uint64(0xC2B2AE3D27D4EB4F)
    h = ((h ^ (h >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(40)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    inside = np.ones(max(begin[-1], 0), bool)
    inside[begin[1:] - 1] = inside[begin[1:] - 2] = False  # these would reach into the next word
    return (h % np.uint64(GRAMS)).astype(np.int64)[inside[: len(h)]], np.concatenate([[0], np.cumsum(sizes - 2)])


def window_starts(n: int) -> np.ndarray:
    """Starts of the overlapping windows over n words; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1 if n else 0, np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def windows_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many words, one after another: word positions [time, window], what is no padding, and each window's text."""
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    starts = [window_starts(int(n)) for n in sizes]
    owner = np.repeat(np.arange(len(sizes)), [len(s) for s in starts])
    first = np.concatenate([s + b for s, b in zip(starts, begin)]) if starts else np.zeros(0, np.int64)
    at = first[None, :] + np.arange(WINDOW)[:, None]
    real = at < (begin + sizes)[owner][None, :]
    return np.where(real, at, 0), real, owner


@dataclass
class Model:
    """Network parameters, its words (row of p["word"] by word; 0 is padding, 1 unknown), calibration."""

    p: gru.Params
    rows: dict[str, int]
    slope: float = 1.0
    size: float = 0.0
    shift: float = 0.0

    def project(self, words: list[str]) -> np.ndarray:
        """[word, 6 hidden]: input projections of both directions."""
        ids, begin = grams(words)
        chars = np.add.reduceat(self.p["char"][ids], begin[:-1]) if words else np.zeros((0, DIM), np.float32)
        chars = chars / (begin[1:] - begin[:-1])[:, None].astype(np.float32)
        e = np.concatenate([self.p["word"][[self.rows.get(w, 1) for w in words]], chars], axis=1)
        return np.concatenate([e @ self.p["W" + d] + self.p["c" + d] for d in "fb"], axis=1)

    def window_logits(self, table: np.ndarray, ids: np.ndarray, sizes: np.ndarray, most: int = 8_192) -> tuple[np.ndarray, np.ndarray]:
        """Logit of every window of texts given as rows ids of table, and each window's text."""
        at, real, owner = windows_of(sizes)
        out = np.empty(len(owner), np.float32)
        half = 3 * HIDDEN
        for i in range(0, len(owner), most):
            x = table[ids[at[:, i : i + most]]]
            out[i : i + most] = gru.logits(self.p, x[:, :, :half], x[:, :, half:], real[:, i : i + most])
        return out, owner

    def best(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Highest window logit and number of windows of each text."""
        words = list({w for d in docs for w in d})
        at = {w: i for i, w in enumerate(words)}
        return self.highest(self.project(words), np.array([at[w] for d in docs for w in d], np.int64), np.array([len(d) for d in docs], np.int64))

    def highest(self, table: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, owner = self.window_logits(table, ids, sizes)
        top = np.full(len(sizes), NO_WORDS, np.float64)
        n = np.bincount(owner, minlength=len(sizes))
        if len(out):
            np.maximum.at(top, owner, np.maximum(out, NO_WORDS))
        return top, n

    def score(self, top: np.ndarray, n: np.ndarray) -> np.ndarray:
        return gru.sigmoid(self.slope * top + self.size * np.log(np.maximum(n, 1)) + self.shift)


def fit(toxic: list[str], clean: list[str], prior: float) -> Model:
    """Train on texts of both labels; prior is the share of toxic documents, for the calibration.

    A toxic text says nothing of where it is toxic: its windows with the words most typical
    of toxic texts stand for it first, then the windows that the network itself ranks first.
    """
    tox, cle = ([tokens(t) for t in dict.fromkeys(x)] for x in (toxic, clean))
    if not tox or not cle:
        return Model(gru.init(2, GRAMS, DIM, HIDDEN), {}, 0.0, 0.0, -4.0 if not tox else 4.0)
    df = [Counter(w for d in part for w in set(d)) for part in (tox, cle)]
    known = [w for w, n in (df[0] + df[1]).most_common(VOCABULARY) if n > 1]
    rows = {w: i + 2 for i, w in enumerate(known)}
    # words and their beginnings by how typical of toxic texts they are
    stems = lambda d: {x for w in set(d) for x in (w, *(w[:k] + "-" for k in STEMS if k < len(w)))}
    df = [Counter(x for d in part for x in stems(d)) for part in (tox, cle)]
    odds = {w: np.log((n + 0.1) / len(tox)) - np.log((df[1][w] + 0.5) / len(cle)) for w, n in df[0].items() if n >= 3}
    typical = {w: max(odds.get(x, 0.0) for x in stems([w])) for d in tox for w in set(d)}
    names = ["", "\x01", *known]
    grams_, begin = grams(names)
    rng = np.random.Generator(np.random.PCG64(11))
    model = Model(gru.init(len(names), GRAMS, DIM, HIDDEN), rows)

    def cut(docs: list[list[str]], rank, most: int) -> np.ndarray:
        """The windows of each text that rank highest, as [time, window] word rows."""
        out = []
        for d in docs:
            starts = window_starts(len(d))
            if not len(starts):
                continue
            r = rank(d, starts)
            for i in np.argsort(-r, kind="stable")[:most]:
                if np.isfinite(r[i]):
                    w = d[starts[i] : starts[i] + WINDOW]
                    out.append([rows.get(x, 1) for x in w] + [0] * (WINDOW - len(w)))
        return np.array(out, np.int64).reshape(-1, WINDOW).T

    def telling(d: list[str], starts: np.ndarray) -> np.ndarray:
        r = np.array([max(typical[w] for w in d[s : s + WINDOW]) for s in starts])
        return np.where(r > max(np.log(8), r.max() - 1), r, -np.inf)

    def ranked(d: list[str], starts: np.ndarray) -> np.ndarray:
        table = model.project(words := list(set(d)))
        at = {w: i for i, w in enumerate(words)}
        out, _ = model.window_logits(table, np.array([at[w] for w in d]), np.array([len(d)]))
        return np.where(out > 0, out, -np.inf)

    def any_(d: list[str], starts: np.ndarray) -> np.ndarray:
        return rng.random(len(starts))

    negative = cut(cle, any_, PER_CLEAN)
    for stage, (rank, epochs) in enumerate(((telling, EPOCHS), (ranked, max(1, EPOCHS // 3)))):
        positive = cut(tox, rank, PER_TOXIC)
        if not positive.shape[1]:
            positive = cut(tox, any_, PER_TOXIC) if stage == 0 else positive
        if stage:
            hard = cut(cle, ranked, PER_CLEAN)
            negative = np.concatenate([negative, hard], axis=1)
        x = np.concatenate([positive, negative], axis=1)
        y = np.repeat([1.0, 0.0], [positive.shape[1], negative.shape[1]]).astype(np.float32)
        if not positive.shape[1]:
            continue
        weight = np.where(y > 0, 0.5 / positive.shape[1], 0.5 / negative.shape[1]) * len(y)
        adam = gru.Adam(model.p, 0.02 if stage == 0 else 0.005)
        for _ in range(max(epochs, 1 + 60 * BATCH * (stage == 0) // len(y))):  # small samples get as many steps
            order = rng.permutation(len(y))
            for i in range(0, len(y), BATCH):
                pick = order[i : i + BATCH]
                xb = np.where((rng.random(x[:, pick].shape) < 0.05) & (x[:, pick] > 1), 1, x[:, pick])  # so unknown words are met
                _, g = gru.gradients(model.p, xb, grams_, begin, y[pick], (weight[pick] / len(pick)).astype(np.float32))
                adam.step(model.p, g)
    top, n = model.best(tox + cle)
    y = np.repeat([1.0, 0.0], [len(tox), len(cle)])
    w = np.where(y > 0, prior / len(tox), (1 - prior) / len(cle))
    f = np.stack([top, np.log(np.maximum(n, 1)), np.ones(len(y))], axis=1)
    theta = np.zeros(3)
    for _ in range(30):  # Newton's method with a small ridge
        q = gru.sigmoid(f @ theta)
        hess = (f * (w * q * (1 - q))[:, None]).T @ f + np.diag([1e-4, 1e-3, 1e-5])
        theta += np.linalg.solve(hess, f.T @ (w * (y - q)) - np.diag([1e-4, 1e-3, 1e-5]) @ theta)
    model.slope, model.size, model.shift = max(theta[0], 1e-3), theta[1], theta[2]
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model learnt from labelled rows that are not held out.

    At most TRAIN_TOXIC toxic and TRAIN_CLEAN clean rows, the first by a hash of doc_id,
    are collected, without texts of over TRAIN_CHARS characters. A document with several
    labels is toxic if one of them says so; null labels don't count.
    """
    known = labels.filter(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {int(r["t"]): r["n"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("t")).agg(F.count("*").alias("n")).collect()}
    h = F.xxhash64("doc_id", F.lit(1))
    some = [known.filter(c).orderBy(h, "doc_id").limit(n) for c, n in ((F.col("toxic") > 0, TRAIN_TOXIC), (F.col("toxic") <= 0, TRAIN_CLEAN))]
    sample = docs.select("doc_id", "text").filter(F.length("text") <= TRAIN_CHARS).join(F.broadcast(some[0].unionByName(some[1])), "doc_id")
    rows = sorted((r["doc_id"], r["toxic"], r["text"]) for r in sample.collect())
    toxic, clean = [t for _, y, t in rows if y > 0], [t for _, y, t in rows if y <= 0]
    return fit(toxic, clean, total.get(1, 0) / max(1, sum(total.values())))


def _score(model: Model, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[str, int] = {}
        table = np.zeros((0, 6 * HIDDEN), np.float32)
        for b in text_chunks(batches, "text", 1 << 20):
            docs = [tokens(t) for t in b.column("text").to_pylist()]
            if len(at) > CACHE_WORDS:
                at, table = {}, table[:0]
            if new := list({w for d in docs for w in d} - at.keys()):
                at.update(zip(new, range(len(table), len(table) + len(new))))
                table = np.concatenate([table, model.project(new)])
            sizes = np.array([len(d) for d in docs], np.int64)
            ids = np.fromiter((at[w] for d in docs for w in d), np.int64, int(sizes.sum()))
            score = np.round(model.score(*model.highest(table, ids, sizes)), 6)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32), pa.int32())], names=[*carry, "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """docs (or the columns carry of it) with score (0 to 1, higher: toxic likelier) and predicted.

    Only text is read. Null texts and texts without a word score as having one window of
    the logit NO_WORDS, so very low. predicted is 1 from THRESHOLD on. Columns of docs
    named score or predicted are replaced; row count and ids stay as they are.
    """
    base = docs.drop("score", "predicted")
    carry = base.columns if carry is None else carry
    fields = [base.schema[c] for c in carry] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return base.mapInArrow(_score(model, carry), T.StructType(fields))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score_toxicity(docs.select("doc_id", held_out().alias("held_out"), "text"), model, ["doc_id", "held_out"])
