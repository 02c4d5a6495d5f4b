"""Hashed word shingles of whole texts, by array operations over many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SEGMENT = 1 << 18
"""Bytes hashed at once; a longer text is cut at white space."""
#: White space bytes (0x20 and 0x09 to 0x0D), the base of the word hash and the mixing constants (from the splitmix64 generator).
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
BASE = 0x9E3779B97F4A7C15
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """A random 64-bit number for each byte, A-Z as a-z, and whether the byte is part of a word."""
    numbers = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(BASE))
    numbers[65:91] = numbers[97:123]
    word = np.ones(256, bool)
    word[list(SPACES)] = False
    return numbers, word


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    inverse = pow(BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.full(n + 1, BASE, np.uint64)
        down = np.full(n + 1, inverse, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a byte array."""
    numbers, word = letters()
    inside = word[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    n = max(SEGMENT, 1 << (len(data)).bit_length())
    up, down = powers(n) if n <= 2 * SEGMENT else powers.__wrapped__(n)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(numbers[data] * up[: len(data)], out=total[1:])
    return starts, mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _long(data: bytes) -> np.ndarray:
    """Word hashes of a text beyond SEGMENT, cut at white space."""
    out = []
    at = 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        while end < len(data) and data[end] not in SPACES:
            step = data[end : end + 4096]
            spaces = [i for i in (step.find(bytes([s])) for s in SPACES) if i >= 0]
            end += min(spaces) if spaces else len(step)
        out.append(word_hashes(np.frombuffer(data, np.uint8, end - at, at))[1])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def of_words(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the shingles of one text's word hashes, in order; a shorter text is one shingle."""
    if not len(words):
        return words
    size = min(width, len(words))
    out = np.full(len(words) - size + 1, np.uint64(size), np.uint64)
    for i in range(size):
        out = out * np.uint64(BASE) + words[i : len(words) - size + 1 + i]
    return mix(out) >> np.uint64(1)


def sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, ascending, as 63-bit integers."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    small: list[int] = []
    parts: list[bytes] = []
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) > SEGMENT:
            out[i] = np.unique(of_words(_long(data), width))
        elif data:
            small.append(i)
            parts.append(data)
    at = 0
    while at < len(parts):
        end, held = at, 0
        while end < len(parts) and (end == at or held + len(parts[end]) < SEGMENT):
            held += len(parts[end]) + 1
            end += 1
        data = np.frombuffer(b" ".join(parts[at:end]), np.uint8)
        starts, words = word_hashes(data)
        bounds = np.cumsum([0] + [len(p) + 1 for p in parts[at:end]])
        cuts = np.searchsorted(starts, bounds)
        for k in range(at, end):
            own = of_words(words[cuts[k - at] : cuts[k - at + 1]], width)
            own.sort()
            out[small[k]] = own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
        at = end
    return out
