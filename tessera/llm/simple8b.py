"""Simple-8b word-aligned integer coding, vectorised over blocks.

A 64-bit word has a selector in its top four bits and packs `count` ids of `bits` bits below, the
first in the lowest bits. Ids are coded in blocks of BLOCK; a block starts at a word border and its
last word may be padded, so that blocks decode independently and all at once. An id that needs more
than 60 bits is an escape: a word with selector 0, then the id as a raw word.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4096
#: Ids and bits of selectors 0 to 15; selector 0 is the escape.
COUNTS = (1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
PAD = max(COUNTS)
_COUNTS = np.array(COUNTS)


def _blocks(n: int) -> int:
    return -(-n // BLOCK)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offset of each block's first word) of unsigned 64-bit ids."""
    ids = np.asarray(ids)
    n_blocks = _blocks(len(ids))
    if not n_blocks:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    kind = np.uint32 if ids.max() < 1 << 32 else np.uint64
    grid = np.zeros((n_blocks, BLOCK + PAD), kind)
    whole = len(ids) // BLOCK
    grid[:whole, :BLOCK] = ids[: whole * BLOCK].reshape(whole, BLOCK)
    sizes = np.full(n_blocks, BLOCK)
    if whole < n_blocks:
        sizes[whole] = len(ids) - whole * BLOCK
        grid[whole, : sizes[whole]] = ids[whole * BLOCK :]

    # Selectors with more ids have fewer bits: where one fits, so do all after it.
    selector = np.full((n_blocks, BLOCK + 1), 15, np.uint8)
    largest, reach = grid, 1  # the largest of the `reach` ids from each place on
    for s in range(15, -1, -1):
        count = COUNTS[s] if s else 1
        while s and 2 * reach <= count:
            wider = largest.copy()
            np.maximum(largest[:, :-reach], largest[:, reach:], out=wider[:, :-reach])
            largest, reach = wider, 2 * reach
        if s == 15:
            if kind is np.uint64:
                selector[:, :BLOCK][grid[:, :BLOCK] >= 1 << 60] = 0
            continue
        if not s:
            break
        far = count - reach
        fits = np.maximum(largest[:, :BLOCK], largest[:, far : BLOCK + far]) < kind(1 << BITS[s])
        if BITS[s] < 8 and not fits.any():
            break
        selector[:, :BLOCK] -= fits.view(np.uint8)

    # All blocks step from word to word together; what is over stays where it is.
    counts = _COUNTS[selector]
    counts[:, BLOCK] = 0
    counts[-1, sizes[-1] :] = 0
    counts, first = counts.ravel(), np.arange(n_blocks) * (BLOCK + 1)
    at, steps = np.zeros(n_blocks, np.int64), []
    while (at < sizes).any():
        for _ in range(16):
            steps.append(at)
            at = np.minimum(at + counts[first + at], BLOCK)
    place = np.array(steps).T
    order, step = np.nonzero(place < sizes[:, None])
    place = place[order, step]
    chosen = selector[order, place]

    lengths = np.where(chosen == 0, 2, 1)
    to = np.cumsum(lengths) - lengths
    words = np.zeros(int(lengths.sum()), np.uint64)
    flat, base = grid.ravel().astype(np.uint64), order * (BLOCK + PAD) + place
    for s in np.unique(chosen):
        own = np.flatnonzero(chosen == s)
        if s == 0:
            words[to[own] + 1] = flat[base[own]]
            continue
        packed = np.full(len(own), np.uint64(int(s) << 60))
        if BITS[s]:
            for j in range(COUNTS[s]):
                packed |= flat[base[own] + j] << np.uint64(j * BITS[s])
        words[to[own]] = packed
    firsts = np.searchsorted(order, np.arange(n_blocks))
    return words, to[firsts]


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n ids that encode() has put into words; 32-bit integers where they suffice."""
    n_blocks = _blocks(n)
    if not n_blocks:
        return np.empty(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.uint8)
    coded = np.arange(len(words))
    if len(escapes := np.flatnonzero(selector == 0)):
        raw = np.zeros(len(words), bool)
        for k in escapes:  # unless it is itself a raw word
            if not raw[k] and k + 1 < len(words):
                raw[k + 1] = True
        coded = np.flatnonzero(~raw)
    chosen = selector[coded]
    firsts = np.searchsorted(coded, offsets)
    block = np.repeat(np.arange(n_blocks), np.diff(np.append(firsts, len(coded))))
    count = _COUNTS[chosen]
    upto = np.cumsum(count) - count
    place = upto - upto[firsts][block]
    wide = bool(len(escapes)) or bool(((words[coded[chosen == 15]] & np.uint64((1 << 60) - 1)) >> np.uint64(32)).any())
    grid = np.zeros(n_blocks * (BLOCK + PAD), np.uint64 if wide else np.uint32)
    base = block * (BLOCK + PAD) + place
    for s in np.unique(chosen):
        own = np.flatnonzero(chosen == s)
        to = base[own]
        if s == 0:
            grid[to] = words[coded[own] + 1]
        elif BITS[s]:
            packed, mask = words[coded[own]], np.uint64((1 << BITS[s]) - 1)
            for j in range(COUNTS[s]):
                grid[to + j] = (packed >> np.uint64(j * BITS[s])) & mask
    return grid.reshape(n_blocks, -1)[:, :BLOCK].ravel()[:n]
