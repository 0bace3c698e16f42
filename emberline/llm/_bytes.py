"""Hashing over the bytes of texts: word shingles and window minima."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

U = np.uint64
#: Odd multipliers; any would do, they only have to stay the same.
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], U)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser known from splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word shingles; a text of fewer words has one, of all its words."""
    out: list[np.ndarray] = []
    for text in texts:
        # lower() and split() of bytes know A-Z and the blanks \x20, \x09-\x0D alone
        found = text.lower().split()
        count = len(found)
        # a hash of the whole word's bytes, so that no structure in a word makes it meet another
        words = np.fromiter(map(xxh3_64_intdigest, found), U, count)
        if count >= width:
            n = count - width + 1
            acc = words[:n] * _PLACES[0]
            for j in range(1, width):
                acc += words[j : n + j] * _PLACES[j % len(_PLACES)]
            out.append(np.unique(mixed(acc)))
        elif count:
            out.append(mixed(np.array([(words * _PLACES[:count]).sum(dtype=U) + U(count)], U)))
        else:
            out.append(np.empty(0, U))
    return out


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings, k a multiple of 8."""
    n = len(data) - 7
    eight = np.empty(n, U)
    for r in range(8):
        m = (n - r + 7) // 8
        if m > 0:
            eight[r::8] = np.frombuffer(data[r : r + 8 * m].tobytes(), "<u8")
    n = len(data) - k + 1
    acc = eight[:n] * _PLACES[0]
    for j in range(1, k // 8):
        acc = mixed(acc) + eight[8 * j : n + 8 * j] * _PLACES[j % len(_PLACES)]
    return mixed(acc)


def minimizers(text: bytes, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, gram hash, first window, last window) of the sampled suffixes of a text.

    Of the grams inside each window of `window` bytes the one of least hash, the leftmost if tied, is sampled; equal
    windows so sample the same place. A suffix is sampled by a run of successive windows.
    """
    data = np.frombuffer(text, np.uint8)
    count = len(data) - window + 1
    if count < 1:
        return (np.empty(0, np.int64), np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64))
    hashes = _grams(data, k)
    low = U((1 << 24) - 1)
    picked: list[np.ndarray] = []
    span = window - k + 1
    step = (1 << 24) - span
    for base in range(0, count, step):  # positions take 24 bits of the key
        part = hashes[base : min(base + step + span - 1, len(hashes))]
        key = (part & ~low) | np.arange(len(part), dtype=U)
        wide, have = key, 1
        while have * 2 <= span:
            wide = np.minimum(wide[:-have], wide[have:])
            have *= 2
        if have < span:
            wide = np.minimum(wide[: len(wide) - (span - have)], wide[span - have :])
        picked.append((wide & low).astype(np.int64) + base)
    at = np.concatenate(picked)
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([starts[1:], [len(at)]]) - 1
    return at[starts], hashes[at[starts]], starts, last
