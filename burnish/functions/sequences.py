"""Longest common subsequences of many texts at once: bit vectors in lockstep.

One text is spelled in bits, 64 a word; the others are walked sign by sign, all in the same step
(Hyyro 2004 for the step itself).
"""

from __future__ import annotations

import numpy as np

WORD = 64
#: Texts of more signs are compared one by one, with whole numbers as bit vectors.
LONGEST = 256
_ONES = np.uint64((1 << WORD) - 1)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per character of ``a``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & where.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def spelled(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs of the texts as rows of numbers from 1, padded with 0; the signs in order of their numbers; lengths."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    signs, flat = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    rows = np.zeros((len(texts), int(lengths.max(initial=0))), np.int32)
    rows[np.arange(rows.shape[1]) < lengths[:, None]] = flat + 1
    return rows, signs, lengths


def numbers_of(text: str, signs: np.ndarray) -> np.ndarray:
    """The signs of a text by their numbers in ``signs``; 0 for others."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.minimum(np.searchsorted(signs, codes), max(len(signs) - 1, 0))
    return np.where(signs[place] == codes, place + 1, 0) if len(signs) else np.zeros(len(codes), np.int64)


def common_with_one(one: np.ndarray, signs: int, rows: np.ndarray) -> np.ndarray:
    """Lengths of the common subsequences of the text ``one`` with each of ``rows``."""
    n, words = len(one), -(-len(one) // WORD)
    where = np.zeros((signs + 1, max(words, 1)), np.uint64)
    for i, c in enumerate(one.tolist()):
        if c:
            where[c, i // WORD] |= np.uint64(1 << (i % WORD))
    state = [np.full(len(rows), _ONES) for _ in range(words)]
    for column in rows.T:
        carry = np.zeros(len(rows), np.uint64)
        for w in range(words):
            hit = state[w] & where[column, w]
            total = state[w] + hit
            if words > 1:
                over = total < hit
                total = total + carry
                carry = (over | (total < carry)).astype(np.uint64)
            state[w] = total | (state[w] - hit)
    left = np.zeros(len(rows), np.int64)
    for w in range(words):
        used = _ONES if (w + 1) * WORD <= n else np.uint64((1 << (n - w * WORD)) - 1)
        left += np.bitwise_count(state[w] & used)
    return n - left


def common_in_pairs(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the common subsequences of ``a[i]`` and ``b[i]``."""
    out = np.zeros(len(a), np.int64)
    short = np.array([len(x) <= WORD and len(y) <= LONGEST for x, y in zip(a, b)], bool)
    for i in np.flatnonzero(~short).tolist():
        out[i] = common_subsequence(a[i], b[i])
    places = np.flatnonzero(short)
    if len(places):
        rows, signs, lengths = spelled([a[i] for i in places] + [b[i] for i in places])
        n, size = len(places), len(signs) + 1
        first, second = rows[:n], rows[n:]
        where = np.zeros(n * size, np.uint64)
        for i, column in enumerate(first.T[:WORD]):
            # Each step sets one bit for each text, so no two meet in a cell.
            where[np.arange(n) * size + column] |= np.uint64(1 << i)
        where.reshape(n, size)[:, 0] = 0
        state = np.full(n, _ONES)
        for column in second[:, : int(lengths[n:].max(initial=0))].T:
            hit = state & where[np.arange(n) * size + column]
            state = (state + hit) | (state - hit)
        used = np.where(lengths[:n] >= WORD, _ONES, (np.uint64(1) << np.minimum(lengths[:n], WORD - 1).astype(np.uint64)) - np.uint64(1))
        out[places] = lengths[:n] - np.bitwise_count(state & used)
    return out
