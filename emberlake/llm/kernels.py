"""NumPy kernels over Arrow string columns: words, word hashes, shingles.

A block is a run of whole documents of a bounded number of UTF-8 bytes (a longer
document is a block of its own), held as one byte buffer with offsets. White space
(0x20, 0x09-0x0D) never occurs inside a multi-byte sequence, so words are found on bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte, and the odd base of the polynomial word hash.
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) | U64(1)
BASE = U64(int(_rng.integers(1 << 61, 1 << 62)) * 2 + 1)
BASE_INV = U64(pow(int(BASE), -1, 1 << 64))
COEF = (_rng.integers(1, 1 << 62, 64, dtype=np.int64).astype(U64) << U64(1)) | U64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCK_BYTES = 1 << 20

BATCH_BYTES = 8 << 20


def small_batches(spark) -> None:
    """Texts are long: hand them to Python in Arrow batches of at most BATCH_BYTES (a session setting, lowered only)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    digits = (spark.conf.get(name) or "").rstrip("b")
    if not digits.isdigit() or not 0 < int(digits) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def lean(run: Callable) -> Callable:
    """A batch function that gives freed memory back to the system at its end: Python workers outlive their tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass

    return wrapped


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, BLOCK_BYTES + 1)
        p, q = np.full(size, BASE, U64), np.full(size, BASE_INV, U64)
        p[0] = q[0] = U64(1)
        kept = {"p": np.cumprod(p, dtype=U64), "q": np.cumprod(q, dtype=U64)}
        if size > 8 * BLOCK_BYTES:  # one giant document: do not hold its tables
            return kept["p"], kept["q"]
        _powers.update(kept)
    return _powers["p"], _powers["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def blocks(texts: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole documents; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    offs = np.frombuffer(off, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words, and each document's first word (with the end as last)."""
    n = len(buf)
    ink = ~SPACE[buf]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    before = np.zeros(n, bool)
    before[1:] = ink[:-1]
    starts = np.flatnonzero(ink & (~before | first[:n]))
    after = np.zeros(n, bool)
    after[:-1] = ink[1:]
    ends = np.flatnonzero(ink & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span."""
    n = len(buf)
    p, q = powers(n + 1)
    acc = np.zeros(n + 1, U64)
    np.cumsum(BYTE_VALUE[buf] * p[:n], out=acc[1:])
    h = (acc[ends] - acc[starts]) * q[starts]
    return mix(h + (ends - starts).astype(U64) * COEF[63])


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words (over document borders too: callers drop those)."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = words[:m] * COEF[0]
    for i in range(1, k):
        out += words[i : m + i] * COEF[i]
    return mix(out + U64(k * int(COEF[62]) % (1 << 64)))


def set_of(words: np.ndarray, grams: np.ndarray, a: int, b: int, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of the document of words a to b; one shingle of all its words if fewer than k."""
    if b - a >= k:
        return np.unique(grams[a : b - k + 1])
    if b == a:
        return np.zeros(0, U64)
    return gram_hashes(words[a:b], b - a)


def shingle_sets(texts: pa.Array, k: int, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for every row."""
    for i, j, buf, offs in blocks(texts):
        if lower:
            buf = LOWER[buf]
        starts, ends, first = word_spans(buf, offs)
        words = span_hashes(buf, starts, ends)
        grams = gram_hashes(words, k)
        for r in range(j - i):
            yield i + r, set_of(words, grams, int(first[r]), int(first[r + 1]), k)
