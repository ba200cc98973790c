"""Burrows-Wheeler transforms of shards of text and their merge.

A transform holds the rotations of a text sorted by their first `limit` symbols, as the symbol before each. Merging does
not look at the texts and sorts no suffix anew: the rank of a symbol in a transform leads from a rotation to the one that
starts a symbol later, so the transforms alone give every rotation's next 8 symbols; by these the shards' sorted orders
are interleaved. The interleave is then refined, round by round, by where the rotations 8, 16, 32, ... symbols later stand
in it. Blocks of one rotation are left alone, so that a round costs what is still tied. The round that parts two neighbours
bounds their common prefix; blocks that the last round leaves are the repeated intervals: rotations with `limit` symbols
in common.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Symbols that one merge can hold: three numbers of a rotation are packed in one word.
BITS = 21
MOST = 1 << BITS


def _refine(order: np.ndarray, keys: np.ndarray, known: int, limit: int, later: Callable[[int], Callable[[np.ndarray], np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rotations sorted by `limit` symbols, and for each the symbols it shares at least with the one before.

    order: rotations sorted by keys, which stand for the first `known` symbols; later(n)(rotations): those n symbols on.
    """
    n = len(order)
    mask, shift = np.uint64(MOST - 1), np.uint64(BITS)
    common = np.zeros(n, np.int16)
    tied = np.zeros(n + 1, bool)  # at i: the rotation at i has the same symbols as the one at i - 1
    tied[1:n] = keys[1:] == keys[:-1]
    block = np.empty(n, np.uint64)
    block[order] = np.maximum.accumulate(np.where(tied[:n], 0, np.arange(n)))
    while known < limit:
        step = min(known, limit - known)
        at = np.flatnonzero(tied[:n] | tied[1:])
        if not len(at):
            break
        ids = order[at]
        packed = (((block[ids] << shift) | block[later(step)(ids)]) << shift) | ids.astype(np.uint64)
        packed.sort()
        ids = (packed & mask).astype(np.int64)
        order[at] = ids
        same = np.zeros(len(at), bool)
        same[1:] = (packed[1:] >> shift) == (packed[:-1] >> shift)
        common[at[tied[at] & ~same]] = known
        tied[at] = same
        block[ids] = np.maximum.accumulate(np.where(same, 0, at))
        known += step
    common[tied[:n]] = limit
    return order, common


def _steps(forward: np.ndarray) -> Callable[[int], Callable[[np.ndarray], np.ndarray]]:
    """later() by the powers of a permutation, each power of two composed once."""
    powers = {1: forward}

    def power(n: int) -> np.ndarray:
        if n not in powers:
            half = power(n >> 1)
            powers[n] = half[half]
        return powers[n]

    def later(n: int) -> Callable[[np.ndarray], np.ndarray]:
        parts = [power(1 << b) for b in range(n.bit_length()) if n >> b & 1]

        def go(ids: np.ndarray) -> np.ndarray:
            for p in parts:
                ids = p[ids]
            return ids

        return go

    return later


def transform(text: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(transform, places): the symbol before each sorted rotation of a text of bytes, and where the rotation starts."""
    n = len(text)
    wide = text.astype(np.uint64)
    for size in (1, 2, 4):
        wide = (wide << np.uint64(8 * size)) | np.roll(wide, -(size % n))
    order = np.argsort(wide)
    order, _ = _refine(order, wide[order], 8, limit, lambda k: lambda ids: (ids + k) % n)
    return text[order - 1], order


def merge(transforms: list[np.ndarray], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the rotations of all shards in one order (numbered through the shards), and for each the number of
    symbols that it shares with the one before: `limit` stands for that many or more, other numbers are lower bounds."""
    forward, first, start = [], [], 0
    for t in transforms:
        by_rank = np.argsort(t, kind="stable")
        first.append(t[by_rank])
        forward.append(by_rank + start)
        start += len(t)
    later = _steps(np.concatenate(forward))
    wide = np.concatenate(first).astype(np.uint64)
    for size in (1, 2, 4):
        wide = (wide << np.uint64(8 * size)) | wide[later(size)(np.arange(start))]
    order = np.argsort(wide, kind="stable")  # runs that are sorted already are merged
    return _refine(order, wide[order], 8, limit, later)
