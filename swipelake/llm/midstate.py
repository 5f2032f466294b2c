"""SHA-256 of many messages at once, with states that can be kept, sent and resumed.

Messages are made of digests as hex text, 64 bytes each, so every digest is one whole block and the state
between two of them is eight words. States are arrays of shape ``(8, n)``, digests as hex text ``(16, n)``.
"""

from __future__ import annotations

from math import isqrt

import numpy as np

_MASK = 0xFFFFFFFF


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


# First 32 bits behind the point of the square roots of 8 primes and of the cube roots of 64.
_START = np.array([isqrt(p << 64) & _MASK for p in _primes(8)], dtype=np.uint32)
_ROUNDS = [np.uint32(_cube_root(p << 96) & _MASK) for p in _primes(64)]


def starts(n: int) -> np.ndarray:
    """``n`` states before any input."""
    return np.repeat(_START[:, None], n, axis=1)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def _step(states: np.ndarray, block: list[np.ndarray]) -> np.ndarray:
    """States after one more block, given as 16 words each."""
    words = list(block)
    a, b, c, d, e, f, g, h = states
    for at in range(64):
        if at >= 16:
            x, y = words[at - 15], words[at - 2]
            small = _turned(x, 7) ^ _turned(x, 18) ^ (x >> np.uint32(3))
            large = _turned(y, 17) ^ _turned(y, 19) ^ (y >> np.uint32(10))
            words.append(words[at - 16] + small + words[at - 7] + large)
        first = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + ((e & f) ^ (~e & g))
        first = first + (words[at] + _ROUNDS[at])
        second = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = first + second, a, b, c, d + first, e, f, g
    return states + np.stack(np.broadcast_arrays(a, b, c, d, e, f, g, h))


def absorbed(states: np.ndarray, digests: np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
    """States after one more digest each; only those ``where`` says so, if given."""
    if where is None:
        return _step(states, list(digests)) if states.shape[1] else states
    if not where.any():
        return states
    made = states.copy()
    made[:, where] = _step(states[:, where], list(digests[:, where]))
    return made


def finished(states: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Digests, as hex text, of messages of ``counts`` digests."""
    if not states.shape[1]:
        return np.zeros((16, 0), np.uint32)
    one = counts[:1] if (counts == counts[0]).all() else counts
    bits = one.astype(np.uint64) * np.uint64(512)
    zero = np.zeros(1, np.uint32)
    last = [np.full(1, 0x80000000, np.uint32), *[zero] * 13]
    last += [(bits >> np.uint64(32)).astype(np.uint32), bits.astype(np.uint32)]
    return from_hex(packed(_step(states, last)).hex().encode())


def packed(states: np.ndarray) -> bytes:
    """32 bytes for each state."""
    return np.ascontiguousarray(states.T).astype(">u4").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, ">u4").reshape(-1, 8).T.astype(np.uint32)


def from_hex(text: bytes) -> np.ndarray:
    """Digests from 64 bytes of hex text each."""
    return np.frombuffer(text, ">u4").reshape(-1, 16).T.astype(np.uint32)


def to_hex(digests: np.ndarray) -> bytes:
    return np.ascontiguousarray(digests.T).astype(">u4").tobytes()
