"""Vectorised hashing of the words and byte n-grams of many texts at once."""

import functools

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The six ASCII white-space characters.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII that is no letter; bytes of longer characters count as letters.
NO_LETTER = np.ones(256, bool)
NO_LETTER[128:] = False
NO_LETTER[65:91] = NO_LETTER[97:123] = False


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return tuple(out)


def lowered(body: np.ndarray) -> np.ndarray:
    """The bytes with A to Z in lower case."""
    return _LOWER[body]


def word_spans(body: np.ndarray, at: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of every word of every text; words end at gaps and at the ends of texts."""
    inside = ~gap[body]
    before = np.zeros(len(body), bool)
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < len(body)]] = False
    after = np.zeros(len(body), bool)
    after[:-1] = inside[1:]
    ends = at[1:] - 1
    after[ends[ends >= 0]] = False
    start = np.flatnonzero(inside & ~before)
    stop = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(at, start, "right") - 1
    return row, start, stop


def span_hashes(body: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal spans hash alike wherever they stand."""
    size = 1 << max(10, int(len(body)).bit_length())
    power, inverse = _powers(size)
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * power[: len(body)], out=sums[1:])
    return mixed((sums[stop] - sums[start]) * inverse[start])


def gram_hashes(body: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each place on, good in its upper bits."""
    power, inverse = _powers(1 << max(10, int(len(body)).bit_length()))
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * power[: len(body)], out=sums[1:])
    n = len(body) - size + 1
    x = sums[size:] - sums[:-size]
    x *= inverse[:n]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x


def window_hashes(row: np.ndarray, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each window of ``size`` words that lies inside one text."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, row.dtype), np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mixed(out + words[k : k + n]) if k else words[:n].copy()
    whole = row[:n] == row[size - 1 :]
    return row[:n][whole], out[whole]


def gram_counts(body: np.ndarray, at: np.ndarray, sizes: tuple[int, ...], buckets: int) -> np.ndarray:
    """Counts of hashed byte n-grams: a row for each text, ``buckets`` columns for each n."""
    rows = len(at) - 1
    row = np.repeat(np.arange(rows), np.diff(at))
    out = np.zeros((rows, buckets * len(sizes)), np.float32)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    for k, n in enumerate(sizes):
        m = len(body) - n + 1
        if m <= 0:
            continue
        code = np.zeros(m, np.uint32)
        for i in range(n):
            code = code * np.uint32(257) + body[i : i + m]
        code = (code * np.uint32(2654435761)) >> shift
        whole = row[:m] == row[n - 1 :]
        cell = row[:m][whole] * buckets + code[whole]
        counted = np.bincount(cell, minlength=rows * buckets)
        out[:, k * buckets : (k + 1) * buckets] = counted.reshape(rows, buckets)
    return out
