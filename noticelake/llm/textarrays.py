"""Vectorised tokenising and hashing of text batches; helpers that run inside Spark tasks.

A block is a byte array holding several texts, each followed by one separator byte, so that
tokens never cross texts. Everything is linear in the bytes of the block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

BLOCK_BYTES = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_POSITIONS = mix64(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

#: Byte classes: 1 where a byte belongs to a token.
BLANKS = np.ones(256, dtype=bool)
BLANKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[128:] = True
for _first, _last in ("09", "az", "AZ"):
    ALNUM[ord(_first) : ord(_last) + 1] = True
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32


def blocks(texts: Sequence[str | None], lower: bool = True, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (index of the first text, bytes, start of each text with the end appended) for runs of whole texts."""
    first, parts, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = b"" if text is None else (text.lower() if lower else text).encode("utf-8", "replace")
        if parts and size + len(raw) > limit:
            yield first, *_joined(parts)
            first, parts, size = i, [], 0
        parts.append(raw)
        size += len(raw) + 1
    if parts:
        yield first, *_joined(parts)


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    return np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8), starts


def tokens(buf: np.ndarray, starts: np.ndarray, member: np.ndarray = ALNUM, prefix: int = 0) -> tuple[np.ndarray, ...]:
    """Hash every token of a block: (hash, doc offset with the end appended[, hash of the token's first bytes])."""
    inside = member[buf]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.searchsorted(begin, starts)
    if not len(begin):
        none = np.zeros(0, dtype=np.uint64)
        return (none, bounds, none) if prefix else (none, bounds)
    length = end - begin
    rel = np.arange(length.sum(), dtype=np.int64) - np.repeat(np.cumsum(length) - length, length)
    value = buf[inside].astype(np.uint64) + np.uint64(1)
    value *= _POSITIONS[rel & 4095]
    cuts = np.cumsum(length) - length
    whole = mix64(np.add.reduceat(value, cuts))
    if not prefix:
        return whole, bounds
    value[rel >= prefix] = 0
    return whole, bounds, mix64(np.add.reduceat(value, cuts) ^ np.uint64(0x5851F42D4C957F2D))


def combine(parts: Sequence[np.ndarray]) -> np.ndarray:
    """An order-dependent hash of aligned hash arrays."""
    total = np.zeros(len(parts[0]), dtype=np.uint64)
    for part in parts:
        total = mix64(total * np.uint64(0xD6E8FEB86659FD93) + part)
    return total


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; a shorter text with words has one shingle made of all of them."""
    n = len(words)
    if not n:
        return words
    if n < width:
        return combine([words[i : i + 1] for i in range(n)])
    return combine([words[i : n - width + 1 + i] for i in range(width)])
