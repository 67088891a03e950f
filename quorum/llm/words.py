"""Words and shingles of whole texts as 64-bit hashes, a column of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer text is taken alone.
CHUNK = 1 << 20

_U = np.uint64
_rng = np.random.default_rng(20240611)
#: What each byte is read as: 0 separates words, A-Z are lower-cased, and 0 itself, which separates nothing, is read as a blank.
WORD = np.arange(256, dtype=np.uint8)
WORD[[9, 10, 11, 12, 13, 32]] = 0
WORD[0] = 32
WORD[ord("A") : ord("Z") + 1] = WORD[ord("a") : ord("z") + 1]
_STEP = _U(0x9E3779B97F4A7C15)
#: The first so many bytes of eight; bytes of a word that are hashed with those of all others.
_FIRST = (_U(1) << _U(8) * np.arange(9, dtype=np.uint64)) - _U(1)
_FIRST[8] = ~_U(0)
TOGETHER = 256
_SHINGLE = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * _U(2) + _U(1)


def mixed(h: np.ndarray, c: int = 0xFF51AFD7ED558CCD) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _U(c)
    return h ^ (h >> _U(29))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def words_at(data: np.ndarray, off: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and hashes of the words of rows of text (runs of bytes that table doesn't make 0), and the words before each row.

    Words are hashed by eight bytes, and by their length: first the first eight of all, then the next of those that have more.
    """
    n = len(data)
    read = np.zeros(n + 16, np.uint8)
    np.take(table, data, out=read[:n])
    within = read[: n + 1] != 0
    first = within[:n].copy()
    first[1:] &= ~within[: n - 1]
    at = off[:-1]
    at = at[at < n]
    first[at] = within[at]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    last = within[:n] & ~within[1:]
    last[:-1] |= within[: n - 1] & first[1:]
    size = np.flatnonzero(last) + 1 - starts
    eights = np.ndarray((n + 9,), "<u8", read, 0, (1,))  # at each byte the eight from there on
    h = mixed(size.astype(np.uint64) * _STEP ^ (eights[starts] & _FIRST[np.minimum(size, 8)]))
    k, more = 8, np.flatnonzero(size > 8)
    while len(more) and k < TOGETHER:
        h[more] = mixed(h[more] + _STEP ^ (eights[starts[more] + k] & _FIRST[np.minimum(size[more] - k, 8)]))
        k += 8
        more = more[size[more] > k]
    for i in more.tolist():  # what is left of very long words, one by one
        rest = eights[starts[i] + k : starts[i] + size[i] : 8].copy()
        rest[-1] &= _FIRST[(size[i] - k - 1) % 8 + 1]
        h[i] = mixed(h[i : i + 1] + (mixed(rest) * np.cumprod(np.full(len(rest), _STEP))).sum(dtype=np.uint64))[0]
    return starts, mixed(h, 0xC4CEB9FE1A85EC53), np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without ASCII white space, A-Z lower-cased) of rows of text, and the words before each row."""
    return words_at(data, off)[1:]


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, words before each row of these) for runs of rows of about CHUNK bytes."""
    data, off = text_bytes(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, "right")) - 1)
        h, at = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
        yield i, j, h, at
        i = j


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each text its set of k-word shingles as sorted hashes; with fewer words one for all of them; without, none."""
    for _, _, h, at in chunks(texts):
        g = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for j in range(k if len(g) else 0):
            g += h[j : len(h) - k + 1 + j] * _SHINGLE[j]
        g = mixed(g, 0xC4CEB9FE1A85EC53)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(g[a : b - k + 1])
            elif b > a:
                yield mixed(np.array([(h[a:b] * _SHINGLE[k + 1 : k + 1 + b - a]).sum(dtype=np.uint64) + _U(b - a)], np.uint64), 0xC4CEB9FE1A85EC53)
            else:
                yield np.zeros(0, np.uint64)


def set_fingerprint(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set, whatever its order."""
    with np.errstate(over="ignore"):
        return int(mixed(np.array([mixed(s).sum(dtype=np.uint64) + _U(len(s)) * _STEP], np.uint64)).view(np.int64)[0])
