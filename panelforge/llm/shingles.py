"""Word shingles of texts as sorted arrays of 64-bit hashes, computed batch by batch inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from panelforge.llm.common import held_by

BLOCK = 1 << 18  # bytes that are hashed at once
CHUNK = 1 << 17  # bytes of texts that are handled together
U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """(a random-looking value of each byte, A-Z as a-z; whether it is white space)."""
    values = mixed(np.arange(1, 257, dtype=np.uint64))
    values[65:91] = values[97:123]
    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    return values, blank


@held_by("shingles")
@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(BLOCK + 1, U(BASE)), np.full(BLOCK + 1, U(INVERSE))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _block_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word in a block that starts and ends at word limits."""
    values, blank = _bytes()
    up, down = _powers()
    space = np.concatenate(([True], blank[data], [True]))
    edge = space[1:] != space[:-1]
    at = np.flatnonzero(edge)
    start, end = at[0::2], at[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return start, mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word, words being runs without ASCII white space and A-Z counting as a-z.

    Long inputs are cut at white space into blocks, so memory follows the block; a word longer than a block is hashed
    in parts of a block that are summed up.
    """
    raw = np.frombuffer(data, np.uint8)
    if len(raw) <= BLOCK:
        return _block_words(raw)
    blank = _bytes()[1]
    starts, hashes, at = [], [], 0
    while at < len(raw):
        stop = min(at + BLOCK, len(raw))
        if stop < len(raw):
            gaps = np.flatnonzero(blank[raw[at:stop]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
        start, value = _block_words(raw[at:stop])
        if starts and len(start) and start[0] == 0 and not blank[raw[at - 1]]:  # the rest of a word over a block's end
            hashes[-1][-1:] = mixed(hashes[-1][-1:] + value[:1])
            start, value = start[1:], value[1:]
        if len(start):
            starts.append(start + at)
            hashes.append(value)
        at = stop
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.empty(0, np.int64), np.empty(0, np.uint64))


def _sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    start, value = words(b" ".join(texts))
    first = np.cumsum([0] + [len(x) + 1 for x in texts])
    cut = np.searchsorted(start, first)
    factors = mixed(np.arange(11, 11 + size, dtype=np.uint64)) | U(1)
    n = max(len(value) - size + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled += value[k : k + n] * factors[k]
    rolled = mixed(rolled)
    found = []
    for a, b in zip(cut[:-1], cut[1:]):
        if b - a >= size:
            found.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            found.append(mixed(np.array([(value[a:b] * factors[: b - a]).sum() + U(b - a)], np.uint64)))
        else:
            found.append(np.empty(0, np.uint64))
    return found


def shingle_sets(texts, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(place, sorted distinct shingle hashes) of each text, in order.

    A text of fewer than `size` words, but not none, has one shingle: all of its words. Null, empty and blank texts
    have none.
    """
    held, base, total = [], 0, 0
    for text in texts:
        held.append((text or "").encode("utf-8", "surrogatepass"))
        total += len(held[-1])
        if total >= CHUNK:
            yield from ((base + k, x) for k, x in enumerate(_sets(held, size)))
            base, total, held = base + len(held), 0, []
    if held:
        yield from ((base + k, x) for k, x in enumerate(_sets(held, size)))
