"""Words and word shingles of many texts at once, as 64-bit hashes in flat numpy arrays."""

from __future__ import annotations

import numpy as np

from quotelake.llm.common import mixed, ragged

_SEED = np.random.Generator(np.random.PCG64(20240611))
BYTE_VALUES = _SEED.integers(1, 2**64 - 1, 256, dtype=np.uint64) | np.uint64(1)
PLACE_VALUES = _SEED.integers(1, 2**64 - 1, 8, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, A-Z lowered, and the number of words per text.

    Words are maximal runs without blanks and the controls 9 to 13; a text border ends a word.
    """
    counts = np.zeros(len(offsets) - 1, np.int64)
    at = np.flatnonzero(~SPACE[data])
    if not len(at):
        return np.zeros(0, np.uint64), counts
    owner = np.searchsorted(offsets, at, "right") - 1
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(at) > 1) | (np.diff(owner) > 0)
    starts = np.flatnonzero(fresh)
    lengths = np.diff(np.append(starts, len(at)))
    powers = np.ones(int(lengths.max()), np.uint64)
    powers[1:] = BASE
    powers = np.cumprod(powers)
    place = np.arange(len(at)) - np.repeat(starts, lengths)
    values = BYTE_VALUES[LOWER[data[at]]] * powers[place]
    hashes = mixed(np.add.reduceat(values, starts) + lengths.astype(np.uint64) * BASE)
    counts += np.bincount(owner[starts], minlength=len(counts))
    return hashes, counts


def shingle_sets(
    data: np.ndarray, offsets: np.ndarray, width: int = 5
) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, flat, and their number per text.

    A text with fewer words than ``width`` has its whole word sequence as its one shingle; a text
    without words has none.
    """
    hashes, counts = word_hashes(data, offsets)
    first = np.cumsum(counts) - counts
    shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    used = np.minimum(counts, width)
    at = ragged(first, shingles)
    out = np.zeros(len(at), np.uint64)
    span = np.repeat(used, shingles)
    for k in range(width):
        live = span > k
        out[live] += hashes[at[live] + k] * PLACE_VALUES[k]
    out = mixed(out + span.astype(np.uint64) * BASE)
    owner = np.repeat(np.arange(len(counts)), shingles)
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[keep], np.bincount(owner[keep], minlength=len(counts))
