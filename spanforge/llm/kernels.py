"""Vectorised hashing of words, byte strings and their windows (NumPy, inside tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
#: An odd number whose bits look random.
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: A random 64-bit value for each byte.
BYTES = mix(np.arange(1, 257, dtype=U) * U(BASE))


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes outside ``space`` (256 booleans), none across rows, and the number of words of each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    word = ~space[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] |= word[edges]
    last[edges - 1] |= word[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    at = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(at)


#: Keeps the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U)
LONG = 64  # bytes of a span that are mixed eight at a time, for all spans at once


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal spans have equal hashes.

    Every eight bytes are mixed into what came before, so nothing cancels as it does in sums of powers (where a Thue-Morse word meets its complement).
    """
    n = ends - starts
    out = mix(n.astype(U) * U(BASE))
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    live = np.flatnonzero(n <= LONG)
    for j in range(0, LONG, 8):
        live = live[n[live] > j]
        if not len(live):
            break
        lane = lanes[starts[live] + j] & _FIRST[np.minimum(n[live] - j, 8)]
        out[live] = mix(out[live] ^ mix(lane + U((BASE * (j + 1)) % (1 << 64))))
    for i in np.flatnonzero(n > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def gram_hash(symbols: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k symbols (uint64); len(symbols) - k + 1 of them."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    done, out, at, have, size, factor = 0, None, 0, symbols, 1, BASE
    while True:  # k as a sum of powers of two
        if k & size:
            part = have[at : at + n]
            out = part.copy() if out is None else out * U(pow(BASE, size, 1 << 64)) + part
            at += size
            done += size
        if done == k:
            return mix(out + U(k))
        m = len(have) - size
        have = have[:m] * U(factor) + have[size : size + m]
        factor = pow(factor, 2, 1 << 64)
        size *= 2


def sliding(x: np.ndarray, w: int, least: bool = True) -> np.ndarray:
    """Minimum (or maximum) of each run of w values."""
    f = np.minimum if least else np.maximum
    size = 1
    while size * 2 <= w:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


#: ASCII white space of the words [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return data + (upper * np.uint8(32)).astype(np.uint8)
