"""Adaptive context-mixing range coder for token ids, many blocks in step.

Each block starts from the same state and is coded by itself; numpy works on one token
of every block at a time. A token is coded as up to three decisions: is it the best
guess (of order 2, or of order 1 where order 2 has none), is it order 1's other guess,
and else which id it is by the order-0 counts of the segment. The probability of the
first decision mixes what the order-2 and order-1 states promise, by weights that
descend the coding error; all these states are counters that adapt within the block.
Order 0 is no part of the mix: it is the segment's counts, written with it, as an
adaptive distribution over a whole vocabulary would not settle within a block.
Ids over 65,534 are coded by order 0 only. Arithmetic is in integers, so any machine
decodes what another one encoded.
"""

from __future__ import annotations

import zlib

import numpy as np

U = np.uint64
V = np.uint32
#: Entries of a block's order-1 and order-2 tables (powers of two), highest confidence (all its bits set), bits of the order-0 total.
TABLE, MOST, TOTAL = 256, 7, 20
_BITS = TABLE.bit_length() - 1
_ONE, _HALF = 1 << 16, 1 << 15
_NONE = 0xFFFF
#: A block's range is 2 ** 63 at most and 2 ** 47 at least between tokens; a token takes 40 bits of it at most. Output is in units of 16 bits.
_UNIT, _BOTTOM, _MASK = U(47), U(1 << 47), U((1 << 47) - 1)
_FULL = U(1 << 63)


def _off(where: np.ndarray, kind: type) -> np.ndarray:
    """No bits where a condition holds and all bits elsewhere; with random conditions np.where takes several times as long as sums with such masks."""
    out = where.astype(kind)
    out -= kind(1)
    return out


def _pick(a: np.ndarray, b: np.ndarray, off: np.ndarray) -> np.ndarray:
    """a where off has all bits, b where it has none."""
    out = a ^ b
    out &= off
    out ^= b
    return out


class _States:
    """The adaptive states of a number of blocks, shared by coding and decoding. Row 0 is of order 1, row 1 of order 2."""

    def __init__(self, lanes: int) -> None:
        lane = np.arange(lanes, dtype=np.int64)
        # entries of one slot are side by side, so that what many blocks look up at a time stays in the cache
        self.slots, self.lanes = np.stack([lane, lane + lanes * TABLE]), lanes
        self.table = np.full(2 * lanes * TABLE, _NONE, V)
        guess = np.array([1, 8, 16, 24, 32, 40, 48, 52], np.int32) * np.int32(_ONE // 64)
        self.counters = np.stack([lane * 24, lane * 24 + 16])
        self.q = np.tile(np.concatenate([guess // 16 + np.int32(64), guess, guess]), lanes)
        self.others, self.qb = lane * 8, np.tile(guess // 2, lanes)
        self.w = np.full(lanes, _HALF // 2, np.int32)
        self.prev = np.zeros(lanes, V)
        self.prev_hash = np.zeros(lanes, V)
        self.h = np.empty((2, lanes), V)

    def guess(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best guess, order 1's guess (_NONE: none) and the probability of the best one, in 65536ths."""
        h = self.h
        np.multiply(self.prev, V(2654435761), out=h[0])
        np.bitwise_xor(h[0], self.prev_hash, out=h[1])
        h[1] *= V(3266489917)
        self.at = (h >> V(32 - _BITS)) * np.int64(self.lanes) + self.slots
        self.e = self.table.take(self.at)
        self.c = self.e >> V(16)
        self.v = self.e & V(_NONE)
        p1, p2 = self.v
        best = p1 ^ ((p1 ^ p2) & _off(p2 == V(_NONE), V))
        self.same = p1 == best
        self.k = self.counters + self.c
        self.k[0] += self.same * 8
        self.s = self.q.take(self.k)
        self.diff = self.s[1] - self.s[0]
        p = self.w * self.diff
        p >>= 15
        p += self.s[0]
        np.maximum(p, 64, out=p)
        np.minimum(p, _ONE - 64, out=p)
        self.p = p
        return best, p1, p

    def other(self, p1: np.ndarray) -> np.ndarray:
        """Probability of order 1's guess p1 where the best guess is wrong; of no meaning in other blocks."""
        self.kb = self.others + self.c[0]
        self.sb = self.qb.take(self.kb)
        p = np.maximum(self.sb, 64)
        np.minimum(p, _ONE - 64, out=p)
        p -= 64
        p &= _off(self.same | (p1 == V(_NONE)), np.int32)
        p += 64
        return p

    def learn(self, token: np.ndarray, hit: np.ndarray, second: np.ndarray) -> None:
        goal = hit.astype(np.int32) << 16
        error = goal - self.p
        self.s += (goal - self.s) >> 4
        self.q[self.k] = self.s
        error >>= 2
        self.diff >>= 2
        error *= self.diff
        error >>= 15
        self.w += error
        np.maximum(self.w, 512, out=self.w)
        np.minimum(self.w, _HALF - 512, out=self.w)
        self.qb[self.kb] = self.sb + ((((second.astype(np.int32) << 16) - self.sb) >> 4) & _off(hit, np.int32))
        fresh = (token & V(_NONE)) | V(1 << 16)
        e, v = self.e, self.v
        less = (e >> V(1)) & V(MOST << 16)
        less |= v
        less ^= fresh
        less &= _off(self.c < 2, V)
        less ^= fresh
        more = np.minimum(e + V(1 << 16), v | V(MOST << 16))
        less ^= more
        less &= _off(v == token, V)
        less ^= more
        self.table[self.at] = less
        self.prev_hash = self.prev * V(2246822519) + V(374761393)
        self.prev = token


def order0(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in ascending order and their counts, scaled to a sum of 2 ** TOTAL, one at least. Raises for more distinct ids than that."""
    end = int(ids.max()) + 1
    if end <= 1 << 20:
        counts = sum(np.bincount(ids[i : i + (1 << 18)], minlength=end) for i in range(0, len(ids), 1 << 18))
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
    else:
        symbols, counts = np.unique(ids, return_counts=True)
    total = 1 << TOTAL
    if len(symbols) > total // 2:
        raise ValueError(f"{len(symbols)} distinct ids in a segment; at most {total // 2} can be coded")
    scaled = 1 + (counts * (total - len(symbols)) // counts.sum())
    scaled[np.argmax(scaled)] += total - scaled.sum()
    return symbols.astype(np.uint32), scaled.astype(np.uint32)


def encode(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, bytes]]]:
    """Order-0 symbols and counts of ids, and (number, CRC-32 of the ids, coded bytes) of each block of ids."""
    if not len(ids):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32), []
    symbols, counts = order0(ids)
    cum = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(U)
    freq = counts.astype(U)
    place = np.zeros(int(symbols[-1]) + 1, U)  # of an id: the counts before its own, and its own
    place[symbols] = cum[:-1] << U(32) | freq
    lanes = -(-len(ids) // block)
    x = np.zeros(lanes * block, np.uint32)
    x[: len(ids)] = ids
    x[len(ids) :] = symbols[0]
    x = np.ascontiguousarray(x.reshape(lanes, block).T)
    low, span = np.zeros(lanes, U), np.full(lanes, _FULL)
    width = 3 * block + 64
    # units with the carry that they pass on, as bit 16; the same unit of all blocks side by side
    out = np.zeros(width * lanes, V)
    n = np.arange(lanes)
    st = _States(lanes)
    for t in range(block):
        token = x[t]
        best, p1, p = st.guess()
        # all blocks go through all decisions, as picking some out takes more time than the sums
        bound = (span >> U(16)) * p.astype(U)
        span -= bound
        hit = token == best
        bound2 = (span >> U(16)) * st.other(p1).astype(U)
        span -= bound2
        second = token == p1
        own = place.take(token)
        span >>= U(TOTAL)
        miss, third = _off(hit, U), _off(second, U)
        low += ((bound2 + span * (own >> U(32)) & third) + bound) & miss
        own &= U(0xFFFFFFFF)
        span *= own
        span = _pick(_pick(span, bound2, third), bound, miss)
        full = span < _BOTTOM
        out[n] = low >> _UNIT  # of other blocks this is written again
        n += full * np.int64(lanes)
        low &= _off(full, U) | _MASK
        shift = full.astype(U) << U(4)
        low <<= shift
        span <<= shift
        i = np.flatnonzero(span < _BOTTOM)
        while len(i):
            lo, sp, to = low[i], span[i] << U(16), n[i]
            out[to] = lo >> _UNIT
            n[i] = to + lanes
            low[i], span[i] = (lo & _MASK) << U(16), sp
            i = i[sp < _BOTTOM]
        st.learn(token, hit, second)
    for _ in range(4):
        out[n] = low >> _UNIT
        n += lanes
        low = (low & _MASK) << U(16)
    n //= lanes
    out = out[: int(n.max()) * lanes].reshape(-1, lanes)
    for k in range(len(out) - 1, 0, -1):
        out[k - 1] += out[k] >> V(16)
    units = np.ascontiguousarray(out.astype("<u2").T)
    blocks = []
    for i in range(lanes):
        own = ids[i * block : (i + 1) * block]
        blocks.append((len(own), zlib.crc32(own.astype("<u4").tobytes()), units[i, : n[i]].tobytes()))
    return symbols, counts, blocks


def decode(symbols: np.ndarray, counts: np.ndarray, blocks: list[tuple[int, int, bytes]], block: int) -> np.ndarray:
    """The ids of the blocks, one after another. Raises ValueError if a block's checksum is wrong."""
    if not blocks:
        return np.zeros(0, np.uint32)
    cum = (np.cumsum(counts, dtype=np.int64) - counts).astype(U)
    freq = counts.astype(U)
    rank = np.repeat(np.arange(len(symbols), dtype=np.uint16 if len(symbols) <= 1 << 16 else V), counts)
    lanes = len(blocks)
    code_at = np.concatenate([[0], np.cumsum([len(b[2]) // 2 for b in blocks])])
    data = np.concatenate([*[np.frombuffer(b, "<u2") for _, _, b in blocks], np.zeros(3 * block + 8, np.uint16)]).astype(np.uint16)  # a token takes 3 units at most, in a damaged block too
    pos = code_at[:-1].copy()
    code = np.zeros(lanes, U)  # how far the coded number is over the block's low end
    for _ in range(4):
        code = (code << U(16)) | data[pos]
        pos += 1
    # a unit has the range's 16 highest bits of 63, so the first four hold 47 + 16 bits and one that comes again
    code >>= U(1)
    spare = (data[code_at[:-1] + 3] & 1).astype(U)
    span = np.full(lanes, _FULL)
    x = np.empty((block, lanes), np.uint32)
    st = _States(lanes)
    for t in range(block):
        best, p1, p = st.guess()
        bound = (span >> U(16)) * p.astype(U)
        hit = code < bound
        span -= bound
        rest = code - bound
        bound2 = (span >> U(16)) * st.other(p1).astype(U)
        second = rest < bound2  # never where hit, as rest is below 0 and so very large
        last = np.flatnonzero(~(hit | second))
        own = bound2[last]
        step = (span[last] - own) >> U(TOTAL)
        own = rest[last] - own
        r = rank.take(np.minimum(own // step, U((1 << TOTAL) - 1)).astype(np.int64))
        miss = _off(hit, U)
        token = _pick(p1, best, _off(hit, V))
        token[last] = symbols[r]
        span = _pick(bound2, bound, miss)
        span[last] = step * freq[r]
        code = _pick(rest, code, miss)
        code[last] = own - step * cum[r]
        full = span < _BOTTOM
        unit = data.take(pos).astype(U)
        rest = _off(full, U)
        shift = full.astype(U) << U(4)
        code <<= shift
        code |= ((spare << U(15)) | (unit >> U(1))) & ~rest
        spare = _pick(spare, unit & U(1), rest)
        pos += full
        span <<= shift
        i = np.flatnonzero(span < _BOTTOM)
        while len(i):
            to, sp = pos[i], span[i] << U(16)
            unit = data[to].astype(U)
            code[i] = (code[i] << U(16)) | (spare[i] << U(15)) | (unit >> U(1))
            spare[i] = unit & U(1)
            pos[i], span[i] = to + 1, sp
            i = i[sp < _BOTTOM]
        x[t] = token
        st.learn(token, hit, second)
    x = np.ascontiguousarray(x.T)
    out = []
    for i, (n, crc, _) in enumerate(blocks):
        own = x[i, :n]
        if zlib.crc32(own.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {i}: its ids don't match their checksum")
        out.append(own)
    return np.concatenate(out)
