"""Word-shingle sets of texts as 64-bit hashes, and MinHash signatures of them, in numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
STEP = 0x9E3779B97F4A7C15
BLOCK = 1 << 15


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weights(n: int, salt: int) -> np.ndarray:
    """n odd 64-bit weights from a seeded rule."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(STEP) + np.uint64(salt)) | np.uint64(1)


def run_places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run in a row."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def _word_hashes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word; ``begins``: where texts begin."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    ink = ~space
    first = ink.copy()
    first[1:] &= space[:-1]
    first[begins] |= ink[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    kept = np.cumsum(ink)
    at = kept[starts] - 1  # place of each word's first byte among the bytes of words
    lengths = np.diff(at, append=kept[-1])
    letters = data[ink]
    letters = np.where((letters >= 65) & (letters <= 90), letters + np.uint8(32), letters)
    products = weights(int(lengths.max()), 0)[run_places(np.zeros(len(lengths), dtype=np.int64), lengths)]
    products *= letters.astype(np.uint64) + np.uint64(1)
    return mixed(np.add.reduceat(products, at) + lengths.astype(np.uint64) * np.uint64(STEP)), starts


def word_hashes(data: np.ndarray, offsets: np.ndarray, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (run of bytes that are not white space), A-Z as a-z, of the texts in a row, and each text's number of words.

    A word's hash is the mixed sum of its bytes, each times a weight of its place. Long texts go in pieces of about
    ``piece`` bytes, cut at white space, so memory goes with the number of words.
    """
    begins = np.unique(offsets[:-1][np.diff(offsets) > 0])
    hashes, starts, a = [], [], 0
    while a < len(data):
        b = min(len(data), a + piece)
        while b < len(data):
            rest = data[b : b + piece]
            gap = np.flatnonzero((rest == 0x20) | ((rest >= 0x09) & (rest <= 0x0D)))
            if len(gap):
                b += int(gap[0])
                break
            b += len(rest)
        h, s = _word_hashes(data[a:b], begins[np.searchsorted(begins, a) : np.searchsorted(begins, b)] - a)
        hashes.append(h)
        starts.append(s + a)
        a = b
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets) - 1, dtype=np.int64)
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), offsets))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts in a row, and each text's number of them.

    A text of five words or more has its windows of five; a shorter one has all its words as one; without words, none.
    """
    words, n_words = word_hashes(data, offsets)
    first = np.cumsum(n_words) - n_words
    n = np.where(n_words >= WORDS, n_words - WORDS + 1, (n_words > 0).astype(np.int64))
    size = np.minimum(n_words, WORDS)
    factor = weights(WORDS, 1)
    starts = run_places(first, n)
    long = np.repeat(size, n)
    total = long.astype(np.uint64) * np.uint64(STEP)
    padded = np.concatenate([words, np.zeros(WORDS, dtype=np.uint64)])
    for j in range(WORDS):
        total = total + np.where(long > j, padded[starts + j] * factor[j], np.uint64(0))
    hashes = mixed(total)
    out, sizes, a = [], np.zeros(len(n), dtype=np.int64), 0
    for i, k in enumerate(n):
        one = hashes[a : a + k]
        a += k
        if k > 1:
            one = np.sort(one)
            one = one[np.concatenate([[True], one[1:] != one[:-1]])]
        out.append(one)
        sizes[i] = len(one)
    return (np.concatenate(out) if out else hashes), sizes


def signatures(hashes: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """MinHash signatures, texts x k; texts without shingles get zeros. Texts go in runs of about BLOCK hashes, which stay in cache."""
    factor, shift = weights(k, 2), mixed(weights(k, 3))
    out = np.zeros((len(sizes), k), dtype=np.uint64)
    rows = np.flatnonzero(sizes)
    ends = np.cumsum(sizes)
    a = 0
    while a < len(rows):
        base = ends[rows[a]] - sizes[rows[a]]
        b = max(a + 1, int(np.searchsorted(ends[rows], base + BLOCK)))
        part = rows[a:b]
        h = hashes[base : ends[part[-1]]]
        starts = ends[part] - sizes[part] - base
        for j in range(k):
            out[part, j] = np.minimum.reduceat((h ^ shift[j]) * factor[j], starts)
        a = b
    return out


def set_prints(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 128-bit fingerprint of each set, texts x 2."""
    out = np.zeros((len(sizes), 2), dtype=np.uint64)
    rows = np.flatnonzero(sizes)
    if len(rows):
        starts = (np.cumsum(sizes) - sizes)[rows]
        for j, salt in enumerate((np.uint64(STEP), np.uint64(0xC2B2AE3D27D4EB4F))):
            out[rows, j] = np.add.reduceat(mixed(hashes * np.uint64(3) + salt), starts)
    return out


def text_runs(texts: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``most_bytes``: first and last row, bytes and offsets. No nulls."""
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most_bytes, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b
