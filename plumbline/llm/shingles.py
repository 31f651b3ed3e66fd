"""Word shingles of texts as 64-bit hashes, computed for many texts at a time with numpy."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes of texts worked on at a time.
SHARD_BYTES = 2 << 20
#: A-Z to a-z, white space to spaces.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
MIX1, MIX2, BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers, the same everywhere."""
    return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * BASE)


BYTES = numbers(256, 1)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x, dtype=np.uint64)])) for x in (BASE, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all parts, and where each part's words begin (and the last ones end)."""
    data = np.frombuffer(b" ".join([*parts, b""]), dtype=np.uint8)
    word = np.concatenate([[False], data != 32, [False]])
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    up, down = powers(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTES[data] * up[: len(data)])])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, np.cumsum([0, *(len(p) + 1 for p in parts)]))


def shingle_sets(texts: list[str | None], size: int = 5):
    """For each text: its distinct shingles of ``size`` words, sorted; all words as one if they are fewer; none without words."""
    done = 0
    while done < len(texts):
        parts, held = [], 0
        while done < len(texts) and (not parts or held < SHARD_BYTES):
            parts.append((texts[done] or "").encode("utf-8", "replace").translate(LETTERS))
            held += len(parts[-1])
            done += 1
        words, at = word_hashes(parts)
        whole = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
        for k in range(size):
            whole = whole * BASE + words[k : k + len(whole)]
        whole = mixed(whole)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(whole[a : b - size + 1])
            elif b > a:
                one = np.full(1, b - a, dtype=np.uint64)
                for k in range(a, b):
                    one = mixed(one * MIX1 + words[k : k + 1])
                yield one
            else:
                yield np.empty(0, dtype=np.uint64)


def set_hash(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    d = hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
