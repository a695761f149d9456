"""Words of many texts at once: one pass of array operations over their joined bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes that end a word: space and \t \n \v \f \r.
SPACE = np.ones(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = False
# Bytes of words made of ASCII letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_FACTOR = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]  # hashes ignore the case of A-Z
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept, and extended on demand."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 20)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def blobs(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, b"" for null."""
    return [b or b"" for b in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


class Words:
    """Words of a few texts: byte range, text number and 64-bit hash of each, in order."""

    def __init__(self, texts: list[bytes], table: np.ndarray):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begins = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        flags = table[self.data].view(np.int8)
        edge = np.flatnonzero(np.diff(flags, prepend=np.int8(0)))
        # The last byte is no word byte, so starts and ends alternate.
        self.start, self.end = edge[::2], edge[1::2]
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * powers(_FACTOR, n)[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * powers(_INVERSE, n)[self.start])
        # Words of text i are first[i] .. first[i + 1] - 1.
        self.first = np.append(np.searchsorted(self.start, self.begins), len(self.start))
        self.counts = np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every run of `size` words; shorter texts give all their words as one.

    Texts without words give none. Runs never cross texts.
    """
    h, total = words.hash, len(words.hash)
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text = words.text_of()
    left = words.first[1:][text] - np.arange(total)  # words from here to the text's end
    whole = words.counts < size
    at = np.flatnonzero(np.where(whole[text], np.arange(total) == words.first[:-1][text], left >= size))
    length = np.minimum(words.counts[text[at]], size)
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        here = np.minimum(at + k, total - 1)
        out = np.where(k < length, mix(out * np.uint64(_FACTOR) + h[here]), out)
    return text[at], out


def chunks(sizes: list[int], most: int) -> Iterator[slice]:
    """Runs of neighbouring items of at most `most` in all; a larger item stands alone."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))
