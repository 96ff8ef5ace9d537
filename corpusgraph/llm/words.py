"""Words of many texts at once, from their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from .common import BASE1, U64, Rolling, mix

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that end at ASCII white space (0x20, 0x09-0x0D).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[9:14] = NOT_SPACE[32] = False
_CODE = mix(np.arange(1, 257, dtype=U64))


def words_of(data: np.ndarray, off: np.ndarray, is_word: np.ndarray = NOT_SPACE, lower: bool = False
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte, 64-bit hash and text number of each word; a word
    never crosses from one text to the next."""
    inside = is_word[data]
    before, after = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    before[1:], after[:-1] = inside, inside
    before[off] = False
    after[off] = False
    first = np.flatnonzero(inside & ~before[:-1])
    last = np.flatnonzero(inside & ~after[1:]) + 1
    r = Rolling(_CODE[LOWER[data] if lower else data], BASE1)
    h = mix(r.of(first, last) + (last - first).astype(U64))
    return first, last, h, np.searchsorted(off, first, "right") - 1
