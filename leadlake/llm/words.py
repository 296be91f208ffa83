"""Hashes of words and of word shingles, worked out for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from leadlake.llm.lm import mixed, word_hashes

BATCH_BYTES = 1 << 21


def batches_of(texts: Sequence[bytes], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``most`` bytes of text; a longer text is alone."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def document_words(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(words per text, word hashes of all texts in turn)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts, words = word_hashes(np.frombuffer(b" ".join([*texts, b""]), np.uint8))
    of = np.searchsorted(np.cumsum(sizes + 1), starts, "right")
    return np.bincount(of, minlength=len(texts)), words


def labelled_shingles(counts: np.ndarray, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles per text, labelled shingle hashes in text order, hash of each text's word sequence).

    A shingle is ``k`` words and the number of its earlier occurrences in the text, so all shingles of
    a text differ. A shorter text is one shingle.
    """
    n = len(counts)
    ends = np.cumsum(counts)
    first = ends - counts
    weights = mixed(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    size = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    doc = np.repeat(np.arange(n), size)
    padded = np.concatenate([words, np.zeros(k, dtype=np.uint64)])
    total = np.zeros(len(at), dtype=np.uint64)
    for j in range(k):
        inside = at + j < ends[doc]
        total += np.where(inside, padded[at + j] * weights[j], np.uint64(0))
    shingle = mixed(total)
    order = np.lexsort((shingle, doc))
    s, d = shingle[order], doc[order]
    fresh = np.concatenate([[True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])]) if len(s) else np.empty(0, bool)
    places = np.arange(len(s))
    again = places - np.maximum.accumulate(np.where(fresh, places, 0)) if len(s) else places
    occurrence = np.empty(len(s), dtype=np.uint64)
    occurrence[order] = again.astype(np.uint64)
    labelled = mixed(shingle + occurrence * np.uint64(0x9E3779B97F4A7C15))
    # Word hashes weighted by powers of an odd number, summed per text.
    powers = np.full(int(counts.max(initial=0)) + 1, np.uint64(0xD1342543DE82EF95))
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    place = np.arange(len(words)) - np.repeat(first, counts)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(words) * powers[place], dtype=np.uint64)])
    return size, labelled, mixed(sums[ends] - sums[first] + counts.astype(np.uint64))
