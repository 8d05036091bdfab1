"""Language ID by segmentation-marginalised unigrams [operator 4].

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces, by the forward
algorithm; a text's log-probability is the sum over its distinct words, each counted
1 + ln(occurrences) times, over the square root of these counts together. Expectation-maximisation fits the
probabilities to word counts of a bounded sample of labelled rows. Scoring runs in
Arrow batches: every word of every text counts, distinct words are scored once a task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, lean, read_table, text_chunks, tidy

#: The training sample: so many documents in all, shared evenly by the languages, of so many characters at most.
TRAIN_DOCS, TRAIN_CHARS = 1_600, 20_000
ROUNDS = 4
#: Weight of the pooled distribution in a language's counts, and probability of a character outside the vocabulary.
SMOOTHING, UNKNOWN = 2_000.0, 1e-9
#: Longer words count as consecutive runs of so many characters; the longest piece.
RUN, LONGEST = 64, 16
CACHE_WORDS = 400_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWER = np.cumprod(np.concatenate([[np.uint64(1)], np.full(RUN, _BASE)]), dtype=np.uint64)
_BACK = np.cumprod(np.concatenate([[np.uint64(1)], np.full(RUN, _INVERSE)]), dtype=np.uint64)


def vocabulary(path: str | None = None) -> np.ndarray:
    """Sorted hashes of the lower-case pieces of a sentencepiece vocabulary."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {p for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and (p := sp.id_to_piece(i)) == p.lower() and len(p) <= LONGEST and "▁" not in p[1:]}
    out = [_prefix([p])[0, -1] for p in pieces]
    return np.unique(np.array(out, np.uint64))


def _prefix(words: list[str]) -> np.ndarray:
    """Hash of each prefix of each word; all words have one length."""
    n = len(words[0])
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n).astype(np.uint64)
    code = (code + np.uint64(1)) * np.uint64(0xC4CEB9FE1A85EC53)
    code ^= code >> np.uint64(29)
    out = np.zeros((len(words), n + 1), np.uint64)
    np.cumsum(code * _POWER[:n], axis=1, dtype=np.uint64, out=out[:, 1:])
    return out


def runs(word: str) -> list[str]:
    word = "▁" + word
    return [word[i : i + RUN] for i in range(0, len(word), RUN)]


def piece_ids(words: list[str], vocab: np.ndarray) -> np.ndarray:
    """[word, end, width - 1]: the piece of that width that ends there, -1 if none, len(vocab) for an unknown character."""
    pre = _prefix(words)
    n = pre.shape[1] - 1
    out = np.full((len(words), n + 1, min(LONGEST, n)), -1, np.int32)
    for end in range(1, n + 1):
        for width in range(1, min(LONGEST, end) + 1):
            h = (pre[:, end] - pre[:, end - width]) * _BACK[end - width]
            at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
            out[:, end, width - 1] = np.where(vocab[at] == h, at, len(vocab) if width == 1 else -1)
    return out


def _epoch(end: int) -> int:
    return max(end - 1, 0) // LONGEST


def forward(ids: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each prefix, summed over its segmentations, scaled: [end, word, language]; scales: [epoch, word, language].

    Each LONGEST positions are an epoch, whose values are over the product of the scales up
    to it; an epoch's scale is the last value of the epoch before, so that long words of
    rare pieces don't underflow. p has a last row of zeros for -1.
    """
    n = ids.shape[1] - 1
    alpha = np.zeros((n + 1, len(ids), p.shape[1]))
    alpha[0] = 1
    scale = np.ones((_epoch(n) + 1, len(ids), p.shape[1]))
    for end in range(1, n + 1):
        e = _epoch(end)
        if e > _epoch(end - 1):
            scale[e] = np.maximum(alpha[end - 1], 1e-300)
        for width in range(1, min(ids.shape[2], end) + 1):
            piece = ids[:, end, width - 1]
            if (piece >= 0).any():
                before = alpha[end - width]
                alpha[end] += (before if _epoch(end - width) == e else before / scale[e]) * p[piece]
    return alpha, scale


def _by_length(words: list[str]) -> Iterator[np.ndarray]:
    sizes = np.array([len(w) for w in words])
    for n in np.unique(sizes):
        same = np.flatnonzero(sizes == n)
        for i in range(0, len(same), 20_000):
            yield same[i : i + 20_000]


@dataclass
class Model:
    """Sorted piece hashes and [piece, language] probabilities; the last rows are unknown and none."""

    vocab: np.ndarray
    p: np.ndarray
    langs: list[str]

    def log_p(self, words: list[str]) -> np.ndarray:
        """[word, language]: log of the probability summed over all segmentations."""
        parts = [(i, r) for i, w in enumerate(words) for r in runs(w)]
        texts = [r for _, r in parts]
        out = np.empty((len(parts), len(self.langs)))
        for same in _by_length(texts):
            alpha, scale = forward(piece_ids([texts[i] for i in same], self.vocab), self.p)
            out[same] = np.log(alpha[-1]) + np.log(scale).sum(0)
        total = np.zeros((len(words), len(self.langs)))
        np.add.at(total, [i for i, _ in parts], out)
        return total


def fit(counts: dict[str, dict[str, int]], vocab: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Fit piece probabilities of each language to its word counts by expectation-maximisation."""
    langs = sorted(counts)
    words = sorted({w for c in counts.values() for w in c})
    n = np.array([[counts[g].get(w, 0) for g in langs] for w in words], float).reshape(len(words), len(langs))
    parts = [(i, r) for i, w in enumerate(words) for r in runs(w)]
    texts, owner = [r for _, r in parts], np.array([i for i, _ in parts], int)
    groups = [(same, piece_ids([texts[i] for i in same], vocab)) for same in _by_length(texts)]
    v = len(vocab)
    p = np.zeros((v + 2, len(langs)))
    p[:v] = 1 / max(v, 1)
    p[v] = UNKNOWN
    for _ in range(rounds):
        c = np.zeros((v + 2, len(langs)))
        for same, ids in groups:
            alpha, scale = forward(ids, p)
            size = len(alpha) - 1
            beta = np.zeros_like(alpha)
            beta[size] = n[owner[same]] / np.maximum(alpha[size], 1e-300)
            for end in range(size, 0, -1):
                for width in range(1, min(ids.shape[2], end) + 1):
                    piece = ids[:, end, width - 1]
                    if (piece >= 0).any():
                        step = p[piece] * beta[end]
                        if _epoch(end - width) < _epoch(end):
                            step = step / scale[_epoch(end)]
                        beta[end - width] += step
                        gain = alpha[end - width] * step
                        for g in range(len(langs)):
                            c[:, g] += np.bincount(piece + (piece < 0) * (v + 2), gain[:, g], v + 2)[: v + 2]
        pool = c[:v].sum(1) + 0.01
        p[:v] = c[:v] + SMOOTHING * (pool / pool.sum())[:, None]
        p[:v] /= p[:v].sum(0)
    return Model(vocab, p, langs)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_chunks(batches, "text", 1 << 20):
        c = Counter((g, w) for g, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()) for w in t.lower().split())
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in c], pa.string()), pa.array([w for _, w in c], pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])


def train(docs: DataFrame, vocab_path: str | None = None, most_docs: int = TRAIN_DOCS) -> Model:
    """A model learnt from text and non-null lang of rows that are not held out.

    About most_docs rows, in equal parts by language and by a hash of doc_id, are read
    for word counts; texts over TRAIN_CHARS are not among them.
    """
    seen = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    seen = seen.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= TRAIN_CHARS))
    per = {r["lang"]: r["n"] for r in seen.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return Model(vocabulary(vocab_path), np.zeros((len(vocabulary(vocab_path)) + 2, 0)), [])
    share = max(1, most_docs // len(per))
    pick = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 20))
    limit = F.create_map(*[F.lit(x) for g, n in per.items() for x in (g, min(1 << 20, -(-(share << 20) // n)))])[F.col("lang")]
    words = seen.filter(pick < limit).select("lang", "text").mapInArrow(lean(_count), "lang string, word string, n long")
    counts: dict[str, dict[str, int]] = {g: {} for g in per}
    for r in words.groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():
        counts[r["lang"]][r["word"]] = r["n"]
    model = fit(counts, vocabulary(vocab_path))
    del counts
    tidy()
    return model


def has_letter(text: str) -> bool:
    """Whether a character is of a letter category (L); superscript digits and fractions aren't."""
    return any(map(str.isalpha, text))


def _identify(model: Model, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[str, int] = {}
        table = np.zeros((0, len(model.langs)))
        for b in text_chunks(batches, "text", 1 << 20):
            texts = [(t or "").lower() for t in b.column("text").to_pylist()]
            split = [t.split() for t in texts]
            if len(at) > CACHE_WORDS:
                at, table = {}, table[:0]
            new = list({w for ws in split for w in ws} - at.keys())
            if new and model.langs:
                at.update(zip(new, range(len(table), len(table) + len(new))))
                table = np.concatenate([table, model.log_p(new)])
            langs, scores = [], []
            for t, ws in zip(texts, split):
                if not model.langs or not has_letter(t):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                ids, n = np.unique(np.fromiter(map(at.__getitem__, ws), int, len(ws)), return_counts=True)
                weight = 1 + np.log(n)
                ll = weight @ table[ids] / weight.sum() ** 0.5
                e = np.exp(ll - ll.max())
                langs.append(model.langs[int(ll.argmax())])
                scores.append(float(e.max() / e.sum()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*carry, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """docs (or the columns carry of it) with lang_pred and score, the best language and its posterior.

    A word that occurs n times counts 1 + ln(n) times, as a repeated word says little more
    than a single one. The posterior's exponent is the log-likelihood over the square root
    of the words so counted, with equal priors. Null texts and texts without a letter are 'und' with score 0,
    as is everything under a model that has learnt no language. Only text is read. Columns
    of docs named lang_pred or score are replaced; row count and ids stay as they are.
    """
    base = docs.drop("lang_pred", "score")
    carry = base.columns if carry is None else carry
    fields = [base.schema[c] for c in carry] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return base.mapInArrow(lean(_identify(model, carry)), T.StructType(fields))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, train(docs), ["doc_id", "held_out"])
