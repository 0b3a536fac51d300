"""MD5 of many numbered keys at once, for tasks that draw by hashes; equal to the built-in ``md5``."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

FEW = 512  # below so many keys hashlib is quicker
AT_ONCE = 8192  # keys whose words stay in a core's cache
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
LEFT = [np.uint32(i) for i in range(32)]
TABLE = [np.uint32(int(abs(np.sin(i + 1)) * 2**32)) for i in range(64)]


def _md5(padded: np.ndarray) -> np.ndarray:
    """Digests of equally long padded messages, one a row."""
    words = np.ascontiguousarray(padded.view("<u4").T)
    state = [np.full(len(padded), v, np.uint32) for v in START]
    f, turned = np.empty_like(state[0]), np.empty_like(state[0])
    for block in range(0, len(words), 16):
        a, b, c, d = (v.copy() for v in state)
        for i in range(64):
            turn = i // 16
            if turn == 0:
                np.bitwise_xor(c, d, f), np.bitwise_and(f, b, f), np.bitwise_xor(f, d, f)
                at = i
            elif turn == 1:
                np.bitwise_xor(b, c, f), np.bitwise_and(f, d, f), np.bitwise_xor(f, c, f)
                at = (5 * i + 1) % 16
            elif turn == 2:
                np.bitwise_xor(b, c, f), np.bitwise_xor(f, d, f)
                at = (3 * i + 5) % 16
            else:
                np.invert(d, f), np.bitwise_or(f, b, f), np.bitwise_xor(f, c, f)
                at = 7 * i % 16
            a += f
            a += TABLE[i]
            a += words[block + at]
            shift = SHIFTS[turn][i % 4]
            np.left_shift(a, LEFT[shift], turned), np.right_shift(a, LEFT[32 - shift], a)
            a |= turned
            a += b
            a, b, c, d = d, a, b, c
        for old, new in zip(state, (a, b, c, d)):
            old += new
    return np.ascontiguousarray(np.stack(state, axis=1)).astype("<u4").view(np.uint8)


@lru_cache(maxsize=256)
def _decimals(low: int, high: int) -> np.ndarray:
    """Decimals of numbers of equal length, a row each."""
    return (np.arange(low, high)[:, None] // 10 ** np.arange(len(str(low)) - 1, -1, -1) % 10 + 48).astype(np.uint8)


def numbered_md5(prefixes: list[bytes], numbers: range, suffixes: list[bytes] | None = None) -> np.ndarray:
    """md5 of every prefix followed by every number in decimals and the suffix of the same place, as an array (prefix, number, 16 bytes)."""
    out = np.empty((len(prefixes), len(numbers), 16), np.uint8)
    suffixes = suffixes or [b""] * len(prefixes)
    if out.size // 16 < FEW:
        for i, (prefix, suffix) in enumerate(zip(prefixes, suffixes)):
            for j, number in enumerate(numbers):
                out[i, j] = np.frombuffer(hashlib.md5(b"%b%d%b" % (prefix, number, suffix)).digest(), np.uint8)
        return out
    alike: dict[tuple[int, int], list[int]] = {}
    for i, (prefix, suffix) in enumerate(zip(prefixes, suffixes)):
        alike.setdefault((len(prefix), len(suffix)), []).append(i)
    for (size, rest), rows in alike.items():
        heads = np.frombuffer(b"".join(prefixes[i] for i in rows), np.uint8).reshape(len(rows), 1, size)
        tails = np.frombuffer(b"".join(suffixes[i] for i in rows), np.uint8).reshape(len(rows), 1, rest)
        rows = np.array(rows)
        low = numbers.start
        while low < numbers.stop:
            digits = len(str(low))
            high = min(numbers.stop, 10**digits, low + AT_ONCE)
            end, length = size + digits, size + digits + rest
            step = max(1, AT_ONCE // (high - low))
            for first in range(0, len(rows), step):
                some, last = heads[first : first + step], tails[first : first + step]
                message = np.zeros((len(some), high - low, (length + 8) // 64 * 64 + 64), np.uint8)
                message[:, :, :size] = some
                message[:, :, size:end] = _decimals(low, high)
                message[:, :, end:length] = last
                message[:, :, length] = 128
                message[:, :, -8:] = np.frombuffer((8 * length).to_bytes(8, "little"), np.uint8)
                found = _md5(message.reshape(-1, message.shape[2])).reshape(len(some), high - low, 16)
                out[rows[first : first + step], low - numbers.start : high - numbers.start] = found
            low = high
    return out
