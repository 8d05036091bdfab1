"""Word hashes of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
#: Odd multipliers, one for each place in a window of words.
PLACE = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.isin(np.arange(256), [*b".,"])
_ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 20)
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
        _inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE)]), dtype=np.uint64)


def joined(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each followed by a line end, and where each text begins."""
    at = np.zeros(len(raws) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in raws], out=at[1:])
    return np.frombuffer(b"\n".join(raws) + b"\n", np.uint8), at


def words(buf: np.ndarray, ignore: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word between ASCII white space in buf.

    ignore: a table of bytes that don't count in the hash.
    """
    blank = np.concatenate([[True], SPACE[buf], [True]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edge[::2], edge[1::2]
    _grow(len(buf) + 1)
    value = _BYTE[buf]
    if ignore is not None:  # bytes that count get places without gaps
        value[ignore[buf]] = 0
        place = np.cumsum(~ignore[buf]) - 1
        place = np.maximum(place, 0)
        total = np.concatenate([[np.uint64(0)], np.cumsum(value * _powers[place], dtype=np.uint64)])
        before = np.concatenate([[0], np.cumsum(~ignore[buf])])
        return starts, ends, mix((total[ends] - total[starts]) * _inverses[before[starts]])
    total = np.concatenate([[np.uint64(0)], np.cumsum(value * _powers[: len(buf)], dtype=np.uint64)])
    return starts, ends, mix((total[ends] - total[starts]) * _inverses[starts])


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width hashes; len(h) - width + 1 of them."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    out = h[:n] * PLACE[0]
    for k in range(1, width):
        out += h[k : k + n] * PLACE[k]
    return mix(out)


def units(buf: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the units of buf, which begin at white space after other bytes and at points and commas after ASCII letters and digits.

    begins: where texts begin in buf; a unit begins there, too. Every byte is in a unit.
    """
    blank = SPACE[buf]
    new = np.zeros(len(buf) + 1, bool)
    new[1:-1] = (blank[1:] & ~blank[:-1]) | (_STOP[buf[1:]] & _ALNUM[buf[:-1]])
    new[begins] = True
    starts = np.flatnonzero(new[:-1])
    _grow(len(buf) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[buf] * _powers[: len(buf)], dtype=np.uint64)])
    ends = np.append(starts[1:], len(buf))
    return starts, mix((total[ends] - total[starts]) * _inverses[starts] + (ends - starts).astype(np.uint64) * PLACE[3])
