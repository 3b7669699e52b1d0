"""Suffix sorting of one shard by external induced sorting.

Sorted suffixes induce the order of the suffixes one place to the left: scanned in order, each puts
its left neighbour at the end of the queue of that neighbour's first symbol. Queues are lists of
position blocks that spill to disk, so a shard can be larger than memory; the text is a mapped file.
A scan handles a whole block of a queue at once in numpy. The leftmost-S suffixes that start the
induction are sorted by their substrings' names: induced once more, and by doubling where names repeat.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Positions that all queues of a sort hold in memory; what is beyond goes to disk.
HELD = 1 << 22
#: Neighbours that are compared at once.
COMPARED = 1 << 16


class Queues:
    """First-in, first-out queues of positions, one per symbol, in bounded memory."""

    def __init__(self, symbols: int):
        self.blocks: list[list[np.ndarray]] = [[] for _ in range(symbols)]
        self.spilled: list[list[tuple[int, int]]] = [[] for _ in range(symbols)]
        self.file, self.size, self.held = None, 0, HELD

    def push(self, symbol: int, positions: np.ndarray) -> None:
        self.blocks[symbol].append(positions)
        self.size += len(positions)
        if self.size > self.held:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for symbol, blocks in enumerate(self.blocks):
            if blocks:
                self.file.seek(0, 2)
                data = np.concatenate(blocks)
                self.spilled[symbol].append((self.file.tell(), len(data)))
                self.file.write(data.tobytes())
                blocks.clear()
        self.size = 0

    def drain(self, symbol: int) -> Iterator[np.ndarray]:
        """Blocks in order, those pushed while draining included."""
        while self.spilled[symbol] or self.blocks[symbol]:
            if self.spilled[symbol]:
                start, count = self.spilled[symbol].pop(0)
                self.file.seek(start)
                yield np.frombuffer(self.file.read(4 * count), np.int32)
            else:
                block = np.concatenate(self.blocks[symbol])
                self.blocks[symbol].clear()
                self.size -= len(block)
                yield block


def _deal(queues: Queues, symbols: np.ndarray, positions: np.ndarray) -> None:
    """Pushes positions to their symbols' queues, in order."""
    if len(positions):
        order = np.argsort(symbols, kind="stable")
        symbols, positions = symbols[order], positions[order]
        cuts = np.flatnonzero(np.diff(symbols)) + 1
        for symbol, block in zip(symbols[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts)):
            queues.push(symbol, block)


def _induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, symbols: int) -> Iterator[np.ndarray]:
    """Blocks of all suffixes from the last to the first in order; ``seeds`` are the sorted leftmost-S ones."""
    starting, larger = Queues(symbols), Queues(symbols)
    _deal(starting, text[seeds], seeds)
    found = Queues(symbols)  # the L suffixes in order, for the way back

    def left_of(block: np.ndarray, s_type: bool) -> np.ndarray:
        left = block[block > 0] - 1
        return left[smaller[left] == s_type]

    for symbol in range(symbols):
        for block in larger.drain(symbol):
            found.push(symbol, block)
            left = left_of(block, False)
            _deal(larger, text[left], left)
        for block in starting.drain(symbol):
            left = left_of(block, False)
            _deal(larger, text[left], left)
    lower = Queues(symbols)
    for symbol in reversed(range(symbols)):
        for block in lower.drain(symbol):
            yield block
            left = left_of(block, True)
            _deal(lower, text[left], left)
        blocks = list(found.drain(symbol))
        for block in reversed(blocks):
            back = block[::-1]
            yield back
            left = left_of(back, True)
            _deal(lower, text[left], left)
    yield np.array([len(text) - 1], np.int32)  # the end of the text comes before all


def _same_substrings(text: np.ndarray, a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the leftmost-S substrings at a and b are equal; ``ends`` has the next such place of each."""
    same = ends[a] - a == ends[b] - b
    active, k = np.flatnonzero(same), 0
    while len(active):
        equal = text[a[active] + k] == text[b[active] + k]
        same[active[~equal]] = False
        k += 1
        active = active[equal]
        active = active[a[active] + k <= ends[a[active]]]
    return same


def suffix_order(text: np.ndarray, symbols: int) -> Iterator[np.ndarray]:
    """Blocks of the positions of ``text``, in falling order of their suffixes. The last symbol must be 0 and the only 0."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = (text[1:] > text[:-1]).astype(np.int8) - (text[1:] < text[:-1]).astype(np.int8)
    step[-1] = 1
    decided = np.where(step != 0, np.arange(n, dtype=np.int32), np.int32(n))
    smaller = step[np.minimum.accumulate(decided[::-1])[::-1]] > 0
    seeds = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    if len(seeds) > 1:
        order = np.concatenate(list(_induce(text, smaller, seeds, symbols)))[::-1]
        is_seed = np.zeros(n, bool)
        is_seed[seeds] = True
        order = order[is_seed[order]]
        ends = np.zeros(n, np.int32)
        ends[seeds] = np.append(seeds[1:], n - 1)
        new = ~_same_substrings(text, order[:-1], order[1:], ends)
        names = np.zeros(n, np.int32)
        names[order] = np.concatenate([[1], np.cumsum(new) + 1])
        names, width = names[seeds].astype(np.int64), 1
        while names.max() < len(seeds):
            ahead = np.concatenate([names[width:], np.zeros(min(width, len(names)), np.int64)])
            names = np.unique(names * (len(seeds) + 1) + ahead, return_inverse=True)[1] + 1
            width *= 2
        seeds = seeds[np.argsort(names)]
    yield from _induce(text, smaller, seeds, symbols)


def repeated_starts(texts: list[bytes], length: int) -> np.ndarray:
    """Marks, over the concatenation of ``texts``, of the starts of ``length`` bytes that start elsewhere in it too.

    Neighbours in suffix order share the longest prefixes, so each is compared with the one before it.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    # Symbol 1 ends each text; bytes come after it.
    text = np.zeros(len(raw) + len(texts) + 1, np.uint16)
    shift = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(raw)) + shift
    text[place] = raw.astype(np.uint16) + 2
    text[np.cumsum(lengths + 1) - 1] = 1
    room = np.zeros(len(text), bool)
    remaining = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(raw))
    room[place] = remaining >= length
    marks, last, held, size = np.zeros(len(text), bool), np.empty(0, np.int32), [], 0

    def compare(chain: np.ndarray) -> np.ndarray:
        a, b = chain[:-1], chain[1:]
        for k in range(length):
            equal = text[a + k] == text[b + k]
            a, b = a[equal], b[equal]
            if not len(a):
                break
        marks[a] = marks[b] = True
        return chain[-1:]

    for block in suffix_order(text, 258):
        block = block[room[block]]
        held.append(block)
        size += len(block)
        if size >= COMPARED:
            last, held, size = compare(np.concatenate([last, *held])), [], 0
    compare(np.concatenate([last, *held]))
    return marks[place]
