"""Word and shingle hashes of whole batches of texts, computed on arrays of bytes inside Arrow functions."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from clinspark.llm.common import SPACE_BYTES

# Texts are hashed in stretches of about so many bytes; a longer text is cut at white space.
STRETCH = 1 << 19
_RANDOM = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash like a-z
_BASE = int(_RANDOM.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 1
_STEP = _RANDOM.integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values: xor-shifts and odd multipliers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n - 1."""
    if not _powers or len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            made = []
            for factor in (_BASE, pow(_BASE, -1, 1 << 64)):
                steps = np.full(max(n, STRETCH + 1024), factor, np.uint64)
                steps[0] = 1
                made.append(np.cumprod(steps))
        _powers[:] = made
    return _powers


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in `data`, and for each text, which begins at its start, the number of words before it.

    A word ends at ASCII white space or at the end of a text. Its hash is a polynomial in its bytes modulo 2**64 with random
    values for the bytes: differences of one running sum, moved to the same power.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    inside = ~_IS_SPACE[data]
    begins = np.zeros(n + 1, bool)
    begins[starts] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | begins[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | begins[1:n]
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    up, down = _tables(n + 1)
    with np.errstate(over="ignore"):
        total = np.cumsum(_BYTE[data] * up[:n])
        before = np.where(a > 0, total[a - 1], np.uint64(0))
        hashes = mixed((total[b] - before) * down[a] + (b - a).astype(np.uint64))
    return hashes, np.searchsorted(a, starts)


def stretches(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Bytes of some texts of a string column, where each begins, and whether the last one goes on in the next stretch.

    Null texts count as empty. A text above STRETCH bytes comes alone, in pieces that end after white space.
    """
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    k = 0
    while k < len(column):
        end = max(int(np.searchsorted(offsets, offsets[k] + STRETCH, "right")) - 1, k + 1)
        low, high = int(offsets[k]), int(offsets[end])
        if high - low <= STRETCH or end > k + 1:
            yield data[low:high], (offsets[k:end] - low).astype(np.int64), False
        else:
            while low < high:
                stop = min(low + STRETCH, high)
                while stop < high and not _IS_SPACE[data[stop - 1]]:
                    spaces = np.flatnonzero(_IS_SPACE[data[low:stop]])
                    stop = low + int(spaces[-1]) + 1 if len(spaces) else min(stop + STRETCH, high)
                yield data[low:stop], np.zeros(1, np.int64), stop < high
                low = stop
        k = end


def words_of_texts(column: pa.Array) -> Iterator[np.ndarray]:
    """Word hashes of each text, in order."""
    held: list[np.ndarray] = []
    for data, starts, goes_on in stretches(column):
        hashes, at = word_hashes(data, starts)
        parts = np.split(hashes, at[1:])
        for n, part in enumerate(parts):
            held.append(part)
            if n < len(parts) - 1 or not goes_on:
                yield held[0] if len(held) == 1 else np.concatenate(held)
                held = []


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; of the whole sequence if it is shorter; none without words."""
    n = min(size, len(words))
    if n == 0:
        return np.zeros(0, np.uint64)
    runs = len(words) - n + 1
    with np.errstate(over="ignore"):
        total = np.full(runs, n, np.uint64)
        for k in range(n):
            total += words[k : k + runs] * _STEP[k]
    found = np.sort(mixed(total))
    return found[np.append(True, found[1:] != found[:-1])]
