"""SHA-256 over many lanes at once, with states that can be kept between its blocks.

A digest in hexadecimal text is 64 bytes, exactly one block of SHA-256. The state
after any number of digests is therefore eight 32-bit words without a remainder: it
can be written into a table, and hashing goes on from it in another task. Arrays are
(words, lanes) of unsigned 32-bit integers. The tests compare with hashlib.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from math import isqrt

import numpy as np

LANES = 8192


def _primes(n: int) -> list[int]:
    found: list[int] = []
    at = 2
    while len(found) < n:
        if all(at % p for p in found):
            found.append(at)
        at += 1
    return found


def _cube_root(n: int) -> int:
    low, high = 0, 1 << (n.bit_length() // 3 + 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**3 <= n else (low, middle - 1)
    return low


# The standard's constants: fractions of the square and cube roots of the first primes.
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
ROUND = [_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)]
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turn(x, by: int):
    return (x >> by) | (x << (32 - by))


def _schedule(block: np.ndarray) -> list[np.ndarray]:
    w = list(block)
    for i in range(16, 64):
        a, b = w[i - 15], w[i - 2]
        w.append(w[i - 16] + w[i - 7] + (_turn(a, 7) ^ _turn(a, 18) ^ (a >> 3)) + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> 10)))
    return w


def _rounds(state: np.ndarray, keyed: Sequence) -> np.ndarray:
    """One block; ``keyed`` are its scheduled words with the round constants added."""
    a, b, c, d, e, f, g, h = state
    for x in keyed:
        t = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + x
        s = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = t + s, a, b, c, d + t, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def start(lanes: int) -> np.ndarray:
    return np.repeat(START[:, None], lanes, 1)


def words_of(digests: np.ndarray) -> np.ndarray:
    """(lanes, 32) bytes as (8, lanes) words."""
    return np.ascontiguousarray(digests).view(">u4").astype(np.uint32).reshape(len(digests), 8).T


def bytes_of(words: np.ndarray) -> np.ndarray:
    """(8, lanes) words as (lanes, 32) bytes."""
    return np.ascontiguousarray(words.T).astype(">u4").view(np.uint8).reshape(words.shape[1], 32)


def hex_block(digests: np.ndarray) -> np.ndarray:
    """Digests as the block of their hexadecimal text: (16, lanes)."""
    raw = bytes_of(digests)
    text = np.empty((len(raw), 64), np.uint8)
    text[:, 0::2], text[:, 1::2] = _HEX[raw >> 4], _HEX[raw & 15]
    return text.view(">u4").astype(np.uint32).T


def absorb(state: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """States after one more digest in each lane."""
    out = np.empty_like(state)
    for at in range(0, state.shape[1], LANES):
        part = slice(at, at + LANES)
        words = _schedule(hex_block(digests[:, part]))
        out[:, part] = _rounds(state[:, part], [w + np.uint32(k) for w, k in zip(words, ROUND, strict=True)])
    return out


@lru_cache(maxsize=256)
def _end(blocks: int) -> tuple[np.uint32, ...]:
    """Scheduled and keyed words of the block that ends a message of so many digests."""
    bits = 512 * blocks
    last = [1 << 31, *[0] * 13, bits >> 32, bits & 0xFFFFFFFF]
    words = _schedule(np.array(last, np.uint32)[:, None])
    return tuple(np.uint32((int(w[0]) + k) & 0xFFFFFFFF) for w, k in zip(words, ROUND, strict=True))


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of messages of ``blocks`` digests each."""
    out = np.empty_like(state)
    for n in np.unique(blocks).tolist():
        lanes = np.flatnonzero(blocks == n)
        for at in range(0, len(lanes), LANES):
            part = lanes[at : at + LANES]
            out[:, part] = _rounds(state[:, part], _end(n))
    return out
