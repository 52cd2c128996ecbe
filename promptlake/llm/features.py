"""Hashed text features as numpy arrays, for use inside Spark tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def char_ngrams(text: str, bits: int, longest: int = 3) -> tuple[np.ndarray, np.ndarray] | None:
    """Slots and counts of the lower-cased text's character n-grams, words set off by one space; None without letters."""
    points = code_points(text.lower())
    letter = letters()[points]
    if not letter.any():
        return None
    points = np.where(letter, points, 32).astype(np.uint64)
    inside = np.concatenate(([True], letter[:-1]))
    points = np.concatenate(([np.uint64(32)], points[letter | inside], [np.uint64(32)]))
    hashes, found = points, []
    for n in range(1, longest + 1):
        if n > 1:
            hashes = hashes[:-1] * _STEP + points[n - 1 :] if len(points) >= n else hashes[:0]
        found.append(_slots(hashes * _STEP + np.uint64(n), bits))
    counts = np.bincount(np.concatenate(found), minlength=1 << bits)
    slots = np.flatnonzero(counts)
    return slots, counts[slots]


@lru_cache(1 << 17)
def _word_slots(word: str, bits: int) -> tuple[int, ...]:
    """Slots of a word, of its first three to five letters, of its last marks and of its case."""
    from xxhash import xxh3_64_intdigest as digest

    core = "".join(c for c in word if c.isalnum())
    low = core.lower()
    marks = "".join(c for c in word if not c.isalnum())
    keys = [f"w{low}"] + [f"p{low[:n]}" for n in (3, 4, 5) if len(low) > n]
    keys += [f"m{marks[-3:]}"] if len(marks) > 1 else []
    keys += ["s"] if len(core) > 1 and core.isupper() else []
    return tuple(digest(k) >> (64 - bits) for k in keys)


def word_features(text: str, bits: int) -> np.ndarray:
    """Slots of the features that the text's words have, each once, in ascending order."""
    found: set[int] = set()
    for word in set(text.split()):
        found.update(_word_slots(word, bits))
    return np.fromiter(sorted(found), np.int64, len(found))
