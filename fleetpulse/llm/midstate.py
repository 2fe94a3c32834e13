"""SHA-256 of many messages at once, with the state between two blocks in hand.

A state is eight 32-bit words; arrays hold one message per column, so a state
is an ``(8, n)`` array and a block ``(16, n)``.  A state after whole blocks can
be copied, stored as 32 bytes, and resumed elsewhere, which library hash objects
cannot.  A digest in lowercase hex is 64 characters: one block.
"""

from __future__ import annotations

import numpy as np

STATE_BYTES = 32


def _roots(power: int, n: int) -> list[int]:
    """First 32 bits of the fractional parts of the ``power``-th roots of the first ``n`` primes."""
    primes = [p for p in range(2, 400) if all(p % q for q in range(2, int(p ** 0.5) + 1))][:n]
    out = []
    for p in primes:
        scaled, root = p << (32 * power), round(p ** (1 / power) * 2 ** 32)
        while root ** power > scaled:
            root -= 1
        while (root + 1) ** power <= scaled:
            root += 1
        out.append(root & 0xFFFFFFFF)
    return out


START = np.array(_roots(2, 8), np.uint32)
_ROUND = np.array(_roots(3, 64), np.uint32)
_HEX = np.array([int.from_bytes(f"{b:02x}".encode(), "big") for b in range(256)], np.uint32)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states after one more block."""
    w = list(block)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[t - 7]
                 + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[t] + w[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def start(n: int) -> np.ndarray:
    return np.repeat(START[:, None], n, axis=1)


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (as words) of messages of ``blocks`` whole blocks that led to ``state``."""
    last = np.zeros((16, state.shape[1]), np.uint32)
    last[0] = 0x80000000
    last[15] = np.asarray(blocks, np.uint32) * np.uint32(512)
    return absorb(state, last)


def hex_block(digest: np.ndarray) -> np.ndarray:
    """The block that a digest's lowercase hex text makes."""
    out = np.empty((16, digest.shape[1]), np.uint32)
    out[0::2] = (_HEX[digest >> np.uint32(24)] << np.uint32(16)) | _HEX[(digest >> np.uint32(16)) & np.uint32(255)]
    out[1::2] = (_HEX[(digest >> np.uint32(8)) & np.uint32(255)] << np.uint32(16)) | _HEX[digest & np.uint32(255)]
    return out


def pack(words: np.ndarray) -> bytes:
    """``(8, n)`` words as n times 32 bytes."""
    return words.T.astype(">u4").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, ">u4").reshape(-1, 8).T).astype(np.uint32)
