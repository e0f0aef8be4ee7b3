"""A read-only hash table from 64-bit keys to 32-bit floats, built and searched many keys at a time."""

from __future__ import annotations

import numpy as np

#: No key has this value.
EMPTY = np.uint64(0xFFFF_FFFF_FFFF_FFFF)
GOLD = np.uint64(0x9E37_79B9_7F4A_7C15)


def hashed(keys: np.ndarray, values: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """An open-addressing table: bits, keys, values."""
    bits = max(4, int(2 * len(keys)).bit_length())
    slots, held = np.full(1 << bits, EMPTY), np.zeros(1 << bits, np.float32)
    at, todo = _slot(keys, bits), np.arange(len(keys))
    while len(todo):
        free = slots[at[todo]] == EMPTY
        _, first = np.unique(at[todo[free]], return_index=True)
        placed = todo[free][first]
        slots[at[placed]], held[at[placed]] = keys[placed], values[placed]
        todo = np.setdiff1d(todo, placed, assume_unique=True)
        at[todo] = (at[todo] + 1) & ((1 << bits) - 1)
    return bits, slots, held


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * GOLD) >> np.uint64(64 - bits)).astype(np.int64)


def find(table: tuple[int, np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The keys' values, NaN where there is none."""
    bits, slots, held = table
    at = _slot(keys, bits)
    there = slots[at]
    out = np.where(there == keys, held[at], np.float32(np.nan))
    todo = np.flatnonzero((there != keys) & (there != EMPTY))
    at = at[todo]
    while len(todo):
        at = (at + 1) & ((1 << bits) - 1)
        there = slots[at]
        hit = there == keys[todo]
        out[todo[hit]] = held[at[hit]]
        on = ~hit & (there != EMPTY)
        todo, at = todo[on], at[on]
    return out
