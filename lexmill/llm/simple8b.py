"""Simple-8b: 64-bit words of a 4-bit selector and 60 bits of equally wide ids.

The widest ids of a word set the selector, so a word holds 60 one-bit ids down
to two 30-bit ids. An id of 2**30 or more is an escape: selector 15, alone in
its word. Ids are coded in blocks of ``block`` ids; a block starts a new word,
and the words at which blocks start are kept, so blocks decode on their own
and all at once.
"""

from __future__ import annotations

import numpy as np

# Bits an id has under selectors 0 to 12.
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30)
ESCAPE = 15
_COUNTS = np.ones(16, np.int64)
_COUNTS[: len(WIDTHS)] = [60 // w for w in WIDTHS]
_POWERS = np.uint32(1) << np.arange(32, dtype=np.uint32)
_SMALL = np.searchsorted(_POWERS, np.arange(1 << 16, dtype=np.uint32), "right").astype(np.uint8)


def _bits(ids: np.ndarray) -> np.ndarray:
    if ids.max() < len(_SMALL):
        return _SMALL[ids]
    return np.searchsorted(_POWERS, ids, "right").astype(np.uint8)


def encode(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of uint32 ids."""
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    # one row a block, with zeros after its end: they fit any width
    blocks, longest = -(-n // block), int(_COUNTS.max())
    flat = np.zeros(blocks * block, np.uint32)
    flat[:n] = ids
    rows = np.zeros((blocks, block + longest), np.uint32)
    rows[:, :block] = flat.reshape(blocks, block)
    bits = _bits(rows.ravel()).reshape(rows.shape)
    widest = bits[:, :block].copy()
    selector = np.full((blocks, block), ESCAPE, np.uint8)
    k = 1
    for s in range(len(WIDTHS) - 1, -1, -1):
        # what fits as many ids also fits fewer, so the last selector that fits is the best
        while k < 60 // WIDTHS[s]:
            np.maximum(widest, bits[:, k : k + block], out=widest)
            k += 1
        fits = widest <= WIDTHS[s]
        if not fits.any():
            break
        selector[fits] = s
    # follow the words of all blocks side by side
    lens = np.full(blocks, block)
    lens[-1] = n - (blocks - 1) * block
    at, of, steps = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(of):
        steps.append(of * block + at)
        at = at + _COUNTS[selector[of, at]]
        more = at < lens[of]
        at, of = at[more], of[more]
    starts = np.sort(np.concatenate(steps))
    chosen = selector.ravel()[starts]
    padded, place = rows.ravel(), starts + starts // block * longest
    words = np.empty(len(starts), np.uint64)
    for s in np.unique(chosen):
        here = np.flatnonzero(chosen == s)
        p = place[here]
        word = padded[p].astype(np.uint64)
        if s != ESCAPE:
            for j in range(1, 60 // WIDTHS[s]):
                word |= padded[p + j].astype(np.uint64) << np.uint64(WIDTHS[s] * j)
        words[here] = word | (np.uint64(s) << np.uint64(60))
    return words, np.searchsorted(starts, np.arange(0, n, block))


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int) -> np.ndarray:
    """The n ids as uint32."""
    out = np.empty(n, np.uint32)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[selector]
    total = np.concatenate([[0], np.cumsum(counts)])[:-1]
    of = np.searchsorted(offsets, np.arange(len(words)), "right") - 1
    starts = total - total[offsets][of] + of * block
    ends = np.minimum((of + 1) * block, n)
    for s in np.unique(selector):
        here = selector == s
        w, p, e = words[here], starts[here], ends[here]
        if s == ESCAPE:
            out[p] = w & np.uint64(2**60 - 1)
            continue
        width = WIDTHS[s]
        mask = np.uint64(2**width - 1)
        for j in range(60 // width):
            inside = p + j < e
            out[p[inside] + j] = (w[inside] >> np.uint64(width * j)) & mask
    return out
