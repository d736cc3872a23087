"""Array kernels over the UTF-8 bytes of a batch of texts.

A batch is one byte array plus document offsets, so that splitting, hashing
and rolling windows run as a few whole-array operations. All hashes are
fixed functions of the bytes: equal on every machine, run and batch.
"""

from __future__ import annotations

import ctypes
from functools import wraps

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Word separators of the contracts: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators of terms: every ASCII character but letters and digits.
NOT_TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD6E8FEB86659FD93 | 1
_MASK = (1 << 64) - 1
_SEGMENT = 1 << 18
_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (grown on demand, kept per process)."""
    have = _powers.get((base, 0))
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[(base, 0)] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def trimmed(batches_of):
    """For functions given to mapInArrow: release freed memory now and then, and at the end of the task."""

    @wraps(batches_of)
    def run(*args):
        for i, batch in enumerate(batches_of(*args)):
            yield batch
            if i % 8 == 7:
                _release()
        _release()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Final avalanche of a 64-bit hash (the public murmur3 finaliser)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n+1 documents) of an Arrow string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, off, data = texts.buffers()
    offs = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8) if off is not None and len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def _segments(data: np.ndarray, offs: np.ndarray, space: np.ndarray) -> list[int]:
    """Cut points at separators or document ends, about every _SEGMENT bytes."""
    cuts, at, n = [0], 0, len(data)
    while at < n:
        end = min(n, at + _SEGMENT)
        while end < n:
            gap = np.flatnonzero(space[data[end : end + 4096]])
            stop = int(offs[np.searchsorted(offs, end)])
            end = min(stop, end + int(gap[0])) if len(gap) else min(stop, end + 4096)
            if len(gap) or end == stop:
                break
        cuts.append(end)
        at = end
    return cuts


def words(data: np.ndarray, offs: np.ndarray, lower: bool = False, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of every document: (hash, start byte, end byte, offsets of words by document).

    Works through bounded segments, whatever the length of a text.
    """
    hashes, starts, ends = [], [], []
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    cuts = _segments(data, offs, space)
    inv = inverse(_P)
    for lo, hi in zip(cuts, cuts[1:]):
        part = data[lo:hi]
        word = ~space[part]
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[lo + 1 : hi]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[lo + 1 : hi]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[LOWER[part] if lower else part] * powers(_P, len(part)), out=total[1:])
        h = (total[e] - total[s]) * powers(inv, len(part) + 1)[s]
        hashes.append(mix(h + (e - s).astype(np.uint64)))
        starts.append(s + lo)
        ends.append(e + lo)
    join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    start = join(starts, np.int64)
    return join(hashes, np.uint64), start, join(ends, np.int64), np.searchsorted(start, offs)


def rolling(h: np.ndarray, k: int, base: int = _Q) -> np.ndarray:
    """Hash of each k consecutive items: n-k+1 values (none if fewer items)."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    out = np.empty(n - k + 1, np.uint64)
    step = 1 << 17
    for lo in range(0, n - k + 1, step):
        hi = min(n - k + 1, lo + step)
        out[lo:hi] = spans(h[lo : hi + k - 1], np.arange(hi - lo), np.arange(k, hi - lo + k), base)
    return out


def spans(h: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _Q) -> np.ndarray:
    """Hash of items [start, end) for arrays of starts and ends."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(base, len(h)), out=total[1:])
    return mix((total[end] - total[start]) * powers(inverse(base), len(h) + 1)[start])


def within(n_items: int, doc_offs: np.ndarray, k: int) -> np.ndarray:
    """True where k consecutive items, counted from here, lie in one document."""
    ok = np.zeros(max(0, n_items - k + 1), bool)
    if len(ok):
        ends = np.repeat(doc_offs[1:], np.diff(doc_offs))
        ok[:] = np.arange(len(ok)) + k <= ends[: len(ok)]
    return ok


def batches(column: pa.Array, max_bytes: int = 1 << 20):
    """(lo, hi) row ranges whose texts hold about max_bytes; a longer text stands alone."""
    _, offs = flat(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


@trimmed
def term_counts(iterator, column: int, schema_names: tuple[str, str] = ("term", "df")):
    """For mapInArrow: (term hash, documents of this task that hold it), lower-cased terms."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([h[0] for h in held]) if held else np.zeros(0, np.uint64)
        n = np.concatenate([h[1] for h in held]) if held else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(n, first) if len(first) else n

    for batch in iterator:
        for lo, hi in batches(batch.column(column)):
            data, offs = flat(batch.column(column).slice(lo, hi - lo))
            h, _, _, at = words(data, offs, lower=True, space=NOT_TERM)
            every = np.concatenate([np.unique(h[a:b]) for a, b in zip(at, at[1:])]) if len(h) else h
            keys, n = np.unique(every, return_counts=True)
            held.append((keys, n))
            size += len(keys)
            if size > 2_000_000:
                held[:] = [merged()]
                size = len(held[0][0])
                if size > 1_500_000:  # many distinct terms: hand them on, they are summed after the shuffle
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], list(schema_names))
                    held, size = [], 0
    keys, n = merged()
    for lo in range(0, len(keys), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + 100_000].view(np.int64)), pa.array(n[lo : lo + 100_000])], list(schema_names))
