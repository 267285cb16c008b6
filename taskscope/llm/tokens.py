"""Words and their hashes as flat numpy arrays over a batch of texts."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_STEP = 0xD1342543DE82EF95
PIECE = 1 << 18

#: (prime, base) of the hashes, and of others that are independent of them. Modulo a power of two, some texts of two
#: letters would share their hashes for every base.
FIELDS = ((2147483647, 1103515245), (2147483629, 1664525 * 263))
OTHERS = ((2147483587, 1597334677), (2147483579, 747796405))

#: The white space that separates words: space and the control characters 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: What separates normalised words: every ASCII byte but letters and digits.
SEPARATOR = np.ones(256, bool)
SEPARATOR[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    SEPARATOR[_a:_b] = False

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (in place)."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(maxsize=16)
def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^i modulo the prime for i < n."""
    out = np.ones(1, U)
    while len(out) < n:
        out = np.concatenate([out, out * U(pow(base, len(out), prime)) % U(prime)])
    return out[:n]


def powers(field: tuple[int, int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a field's base and of its inverse."""
    prime, base = field
    size = 1 << max(12, (n - 1).bit_length())
    return _powers(base, prime, size)[:n], _powers(pow(base, -1, prime), prime, size)[:n]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column and the offsets of its rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, texts.offset * 8)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int):
    """Cut a batch where a text column exceeds ``limit`` bytes; a longer text stands alone."""
    i = batch.schema.get_field_index(column)
    sizes = np.diff(flat(batch.column(i))[1])
    start, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each row (one more at the end)."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    inside = ~separators[data]
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1] | cut[1:n]
        last[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fields: tuple = FIELDS) -> np.ndarray:
    """A hash of each stretch of bytes: its polynomials modulo two primes, from prefix sums over pieces of bounded size."""
    out = np.zeros(len(starts), U)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, at + PIECE, "right")))
        part = data[at:int(ends[j - 1])].astype(U) + U(1)
        a, b = starts[i:j] - at, ends[i:j] - at
        for field in fields:
            prime = U(field[0])
            p, q = powers(field, len(part) + 1)
            sums = np.zeros(len(part) + 1, U)
            terms = part * p[:-1]  # below 2^40, so the sums of a piece fit; those of a longer stretch may not
            np.cumsum(terms if len(part) <= 1 << 22 else terms % prime, out=sums[1:])
            out[i:j] = out[i:j] << U(32) | (sums[b] - sums[a]) % prime * q[a] % prime
        i = j
    return mix(out + (ends - starts).astype(U) * U(_STEP))


def windows(tokens: np.ndarray, rows: np.ndarray, size: int, fields: tuple = FIELDS) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hash of every ``size`` consecutive tokens of a row, and the first token of each window.

    The weighted prefix sums of all tokens give each window by one difference, as a rolling hash does by one step.
    """
    n = len(tokens)
    if n < size:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.arange(n - size + 1)
    # a window is whole if it ends in the row it starts in
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    at = at[row[size - 1:] == row[: n - size + 1]]
    out = np.zeros(len(at), U)
    for field in fields:
        prime = U(field[0])
        p, q = powers(field, n + 1)
        sums = np.zeros(n + 1, U)
        np.cumsum(tokens % prime * p[:-1] % prime, out=sums[1:])
        out = out << U(32) | (sums[at + size] - sums[at]) % prime * q[at] % prime
    return mix(out), at
