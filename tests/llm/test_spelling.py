"""Spelling variant grouping against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from adweave.llm import spelling
from adweave.llm.wavelet import WaveletTree, one_edit


def words_by_hand(rows):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(words):
    out = {}
    for w, n in words.items():
        near = [v for v in words if is_near(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if near and words[best] >= 5 * n else None
        out[w] = (n, len(near), form, words[form] if form else None)
    root = {}
    for w in words:
        last = w
        while out[last][2]:
            last = out[last][2]
        root[w] = last
    return {w: (*x, root[w]) for w, x in out.items()}


def vocabulary(seed, n):
    """Words of few letters, with runs of one letter, and their variants, in chains."""
    rng = random.Random(seed)
    out = {}
    while len(out) < n:
        w = "".join(rng.choice("aabé") for _ in range(rng.randint(6, 9)))
        for c in (700, 90, 12, rng.randint(5, 9)):
            out.setdefault(w, c)
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + rng.choice("abéz") + w[k + 1 :], w[:k] + rng.choice("abé") + w[k:], w[:k] + w[k + 1 :]])
            if len(w) < 6:
                break
    return out


@pytest.mark.parametrize("chunk", [20_000, 25])
def test_near_words(spark, monkeypatch, chunk):
    """Groups of one chunk and of many give every near pair once."""
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    words = vocabulary(1, 500) | {"x" * 3000: 5, "x" * 3001: 7, "y" + "x" * 3000: 30, "x" * 1500 + "z" + "x" * 1499: 6}
    got = spelling.near_words(spark.createDataFrame([*words.items()], "word string, n long")).collect()
    want = by_hand(words)
    assert {r.word: r.n_near for r in got} == {w: x[1] for w, x in want.items() if x[1]}
    assert all((-r.best.n, r.best.word) == min((-words[v], v) for v in words if is_near(r.word, v)) for r in got)


def test_near_words_of_other_chunks(spark, monkeypatch):
    """The only word near another one may be in another chunk, alone with its prefix."""
    assert spelling._near(6, True, [(True, b"abcdef", 5), (False, b"abcdeg", 9)]) == {b"abcdef": [1, 9, b"abcdeg"]}
    assert spelling._near(6, False, [(True, b"abcdef", 5), (False, b"xbcdef", 9)]) == {b"abcdef": [1, 9, b"xbcdef"]}
    monkeypatch.setattr(spelling, "CHUNK", 3)
    rng = random.Random(3)
    words = {"abc" + "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 5))): rng.randint(5, 99) for _ in range(400)}
    got = spelling.near_words(spark.createDataFrame([*words.items()], "word string, n long")).collect()
    want = {w: sum(is_near(w, v) for v in words) for w in words}
    assert {r.word: r.n_near for r in got} == {w: n for w, n in want.items() if n}


def test_spelling_groups(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 50)
    monkeypatch.setattr(spelling, "HELD", 30)
    rng = random.Random(2)
    words = [w for w, c in vocabulary(3, 60).items() for _ in range(c // 3)]
    rng.shuffle(words)
    sep = [" ", "\n", "-", "1", "日", "\U0001f600", "ÿ".upper(), " Ÿ "]
    rows = [(i, rng.choice(sep).join(w.title() if rng.random() < 0.2 else w for w in words[i::80])) for i in range(80)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (100, None), (101, ""), (102, "   "), (103, "Großzügig ÀÉÎÕÜ× ÷÷÷÷÷÷ " * 400), (104, "größzügig Großzügi " * 9 + "a" * 70_000 + " " + "a" * 70_000)]
    rows += [(200 + i, "chained " * 8 + "chainedy " * (i % 2) + "chainedyq " * (i % 10 == 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("clash"), "n": F.lit("clash"), "root": F.lit("clash")})
    want = by_hand(words_by_hand(rows))
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_groups(df).collect()}
    assert got == want and len(want) > 30
    assert any(x[4] not in (w, x[2]) for w, x in want.items() if x[2])  # a chain of forms
    assert spelling.spelling_groups(df.limit(0)).count() == 0


def test_registered_query(spark):
    from adweave.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in QUERIES["op12_wavelet_spelling"](spark, "/root/testdata/sf0.001").collect()}
    assert got == by_hand(words_by_hand(rows))


def test_wavelet_tree(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr("adweave.llm.wavelet.STEP", 7)
    for n in (1, 2, 37, 256, 300):
        p = rng.permutation(n)
        lo, a = rng.integers(0, n, 50), rng.integers(0, n, 50)
        hi, b = lo + rng.integers(0, n + 1, 50).clip(max=n - lo), a + rng.integers(0, n + 1, 50).clip(max=n - a)
        got = sorted((int(q), int(v)) for qs, vs in WaveletTree(p).report(lo, hi, a, b) for q, v in zip(qs, vs))
        assert got == sorted((q, int(v)) for q in range(50) for v in p[lo[q] : hi[q]] if a[q] <= v < b[q])


def test_positions_by_halves():
    """Both halves of the positions together give each pair once, at equal and at different lengths."""
    rng = random.Random(5)
    short = sorted({"".join(rng.choice("ab") for _ in range(7)) for _ in range(60)})
    for length in (7, 8):
        index = sorted({"".join(rng.choice("ab") for _ in range(length)) for _ in range(90)}) if length == 8 else short
        rows = lambda ws: np.frombuffer("".join(ws).encode(), np.uint8).reshape(len(ws), -1)
        got = [(short[q], index[v]) for edits in (range(3, length), range(2, -1, -1)) for qs, vs in one_edit(rows(short), rows(index), edits) for q, v in zip(qs, vs)]
        assert sorted(got) == sorted((w, v) for w in short for v in index if is_near(w, v))
