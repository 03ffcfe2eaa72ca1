"""Vectorised hashing of words, shingles and character n-grams over Arrow string buffers.

Every function takes the UTF-8 bytes of a batch of texts and their offsets, so that a batch costs a few numpy
passes instead of one Python call per word. Hashes are 64-bit and depend only on the bytes, never on the batch.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

#: Bytes hashed at once: bounds the working memory (about 40 bytes for each byte of the block).
BLOCK = 1 << 20
#: The same for words, whose working memory each worker of a long job holds beside what it keeps.
WORD_BLOCK = 1 << 18

#: Of the C library, where it has it: gives freed memory back to the system.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The same table with A-Z hashed as a-z, which lower-cases ASCII at no cost.
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SHINGLE = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Of every byte: 0 white space, 1 letters, digits and all of non-ASCII, 2 other ASCII.
_KIND = np.ones(256, np.uint8)
_KIND[:128] = [0 if _SPACE[b] else 1 if chr(b).isalnum() else 2 for b in range(128)]

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        grown = np.full(max(n, WORD_BLOCK + 4096), base, dtype=np.uint64)
        grown[0] = 1
        have = _powers[name] = np.cumprod(grown, dtype=np.uint64)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads a 64-bit value over all its bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return held, at - at[0]


def release() -> None:
    """Gives unused memory back to the system: workers live on from task to task, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def slices(batches, rows: int = 256):
    """Record batches of at most ``rows`` rows: bounds the working memory of what is computed over a batch.

    What is no longer used is given back after each batch.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        release()


def _blocks(space: np.ndarray, offsets: np.ndarray):
    """Byte ranges of about WORD_BLOCK bytes that cut no word."""
    start, total, size = 0, int(offsets[-1]), min(BLOCK, WORD_BLOCK)
    while start < total:
        end = min(start + size, total)
        if end < total:
            bound = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            if bound > start:
                end = bound
            else:
                stop = int(offsets[np.searchsorted(offsets, end, "left")])
                gap = np.flatnonzero(space[start:end])
                if len(gap):
                    end = start + int(gap[-1]) + 1
                else:
                    ahead = np.flatnonzero(space[end:stop])
                    end = end + int(ahead[0]) + 1 if len(ahead) else stop
        yield start, end
        start = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, punctuation: bool = False):
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+``, and where each text's words start among them.

    With ``punctuation``, words are also cut between letters or digits and other ASCII signs.
    """
    space = _SPACE[data]
    kind = _KIND[data] if punctuation else None
    table = _LOWER if lower else _TABLE
    hashes, firsts = [], []
    for lo, hi in _blocks(space, offsets):
        word = ~space[lo:hi]
        edge = np.zeros(hi - lo, dtype=bool)
        edge[offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo] = True
        if punctuation:
            edge[1:] |= kind[lo + 1 : hi] != kind[lo : hi - 1]
        begins = word.copy()
        begins[1:] &= ~word[:-1] | edge[1:]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | edge[1:]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if len(s):
            n = hi - lo
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(table[data[lo:hi]] * _power("up", _BASE, n), out=sums[1:])
            hashes.append(mix64((sums[e] - sums[s]) * _power("down", _BASE_INVERSE, n)[s]))
            firsts.append(s + lo)
    first = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    out = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return out, np.searchsorted(first, offsets, "left")


def shingle_hashes(words: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words of one text; a shorter text gives its whole sequence as one run."""
    counts = np.diff(starts)
    long = counts >= width
    n = np.where(long, counts - width + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(int(at[-1]), dtype=np.uint64)
    total = len(words)
    if total >= width and long.any():
        combined = np.zeros(total - width + 1, dtype=np.uint64)
        for i in range(width):
            combined += words[i : total - width + 1 + i] * _SHINGLE[i]
        left = np.repeat(starts[1:], counts)[: total - width + 1] - np.arange(total - width + 1)
        fits = left >= width
        target = np.repeat(long, n)
        out[target] = mix64(combined[fits])
    for i in np.flatnonzero(~long & (counts > 0)):
        w = words[starts[i] : starts[i + 1]]
        value = np.append(w * _SHINGLE[: len(w)], _SHINGLE[8 + len(w) % 8]).sum(dtype=np.uint64)
        out[at[i]] = mix64(np.array([value], dtype=np.uint64))[0]
    return out, at


def ngram_hashes(data: np.ndarray, width: int, lower: bool = True) -> np.ndarray:
    """Hash of the ``width`` bytes that start at each byte; the last ``width - 1`` have none."""
    table = _LOWER if lower else _TABLE
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    coded = table[data]
    out = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        out += coded[i : i + n] * _SHINGLE[i]
    return mix64(out)


def ngrams(data: np.ndarray, offsets: np.ndarray, width: int):
    """Blocks of (row, hash) of all ``width``-byte windows that lie in one text, A-Z as a-z."""
    total = int(offsets[-1])
    for lo in range(0, total, BLOCK):
        hi = min(lo + BLOCK, total)
        hashes = ngram_hashes(data[lo : hi + width - 1], width)
        first, last = int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, hi, "left"))
        own = np.clip(offsets[first : last + 1], lo, hi)
        row = np.repeat(np.arange(first, last), np.diff(own))[: len(hashes)]
        fits = offsets[row + 1] - np.arange(lo, lo + len(hashes)) >= width
        yield row[fits], hashes[fits]
