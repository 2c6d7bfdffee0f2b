"""Vectorised text kernels over Arrow string buffers.

Words are the maximal runs of bytes outside ``\\x20\\x09-\\x0D``.  All of those
bytes are ASCII, so working on UTF-8 bytes gives the same words as working on
characters.  Hashes are polynomial with random byte values, taken from prefix
sums, so the cost is a few nanoseconds a byte whatever the word length.
"""

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers, congruent to 3 modulo 4: differences of powers keep few factors of two.
BASE_BYTE = 0x9E3779B97F4A7C17 | 3
BASE_WORD = 0xC2B2AE3D27D4EB4F | 3
#: Bytes of text handled at a time; a longer document is handled alone.
CHUNK_BYTES = 1 << 21


def mix64(x):
    """SplitMix64 finaliser, elementwise."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_table(lower: bool):
    """A random 64-bit value for each byte; with ``lower``, A-Z share those of a-z."""
    t = mix64((np.arange(256, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
    if lower:
        t[65:91] = t[97:123]
    return t


def space_table():
    t = np.zeros(256, bool)
    t[[32, 9, 10, 11, 12, 13]] = True
    return t


def inverse64(a: int) -> int:
    """Inverse of an odd number modulo 2**64."""
    return pow(a, -1, 1 << 64)


class Powers:
    """Powers of a multiplier and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv = base, inverse64(base)
        self.up = self.down = np.ones(0, U64)

    def upto(self, n: int):
        if len(self.up) < n:
            size = max(n, 1 << 16, 2 * len(self.up))

            def run(b):
                x = np.full(size, b, U64)
                x[0] = 1
                return np.cumprod(x)

            self.up, self.down = run(self.base), run(self.inv)
        return self.up[:n], self.down[:n]


class Hasher:
    """Word and n-gram hashes of batches of texts."""

    def __init__(self, lower: bool = False):
        self.table, self.space = byte_table(lower), space_table()
        self.bytes, self.words = Powers(BASE_BYTE), Powers(BASE_WORD)

    def split(self, buf, offsets):
        """(first byte, end byte, document) of each word; ``offsets`` bound the documents in ``buf``."""
        n = len(buf)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, z
        ink = ~self.space[buf]
        first, last = ink.copy(), ink.copy()
        first[1:] &= ~ink[:-1]
        last[:-1] &= ~ink[1:]
        cut = offsets[(offsets > 0) & (offsets < n)]
        first[cut] = ink[cut]
        last[cut - 1] = ink[cut - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return start, end, np.searchsorted(offsets, start, "right") - 1

    def hash_spans(self, buf, start, end):
        """Hash of each byte span."""
        if not len(start):
            return np.zeros(0, U64)
        up, down = self.bytes.upto(len(buf))
        c = np.zeros(len(buf) + 1, U64)
        np.cumsum(self.table[buf] * up, out=c[1:])
        return mix64((c[end] - c[start]) * down[start] + (end - start).astype(U64))

    def ngrams(self, words, n: int):
        """Hash of the ``n`` words from each position; the last n-1 positions have none."""
        m = len(words) - n + 1
        if m <= 0:
            return np.zeros(0, U64)
        up, down = self.words.upto(len(words))
        c = np.zeros(len(words) + 1, U64)
        np.cumsum(words * up, out=c[1:])
        return mix64((c[n:] - c[:-n]) * down[:m] + U64(n))


def buffer_of(texts: pa.Array):
    """(bytes, offsets) of an Arrow string or binary array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, bytes, offsets) of runs of rows of about ``limit`` bytes."""
    if not len(texts):
        return
    buf, offsets = buffer_of(texts)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def bounds(docs, n_docs: int):
    """First word of each document, and the end."""
    return np.searchsorted(docs, np.arange(n_docs + 1))


def shingle_set(hasher: Hasher, words, k: int):
    """Sorted distinct hashes of a document's k-word shingles; fewer words make one."""
    if not len(words):
        return np.zeros(0, U64)
    return np.unique(hasher.ngrams(words, min(k, len(words))))
