"""Word shingles as 64-bit numbers, for many texts at a time."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time (single longer texts are taken alone).
SLICE_BYTES = 1 << 20

_KEY = np.uint64(0xA0761D6478BD642F)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] = _LOWER[ord("a") : ord("z") + 1]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a number spread over all bits (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _STEP, np.uint64)]))


def _word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that lie one after the other, and the number
    of words before each text's start (and before the end)."""
    inside = _IN_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = starts[starts < len(data)]
    first[begin] = inside[begin]
    at = np.flatnonzero(first)
    counts = np.searchsorted(at, np.append(starts, len(data)))
    if not len(at):
        return np.empty(0, np.uint64), counts
    number = np.cumsum(first) - 1
    own = number[inside]
    sizes = np.bincount(own, minlength=len(at))
    offsets = np.cumsum(sizes) - sizes
    place = (np.arange(len(own)) - offsets[own]).astype(np.uint64)
    # A random number for every place and byte: sums over the bytes have no structure to exploit,
    # as the values of a polynomial modulo 2^64 do.
    values = mixed((place << np.uint64(8) | _LOWER[data[inside]]) * _STEP ^ _KEY)
    hashes = np.add.reduceat(values, offsets)
    return mixed(hashes ^ (sizes.astype(np.uint64) * _STEP)), counts


def _shingle_sets(data: np.ndarray, starts: np.ndarray, k: int, weights: np.ndarray | None) -> Iterator:
    words, counts = _word_hashes(data, starts)
    factors = _powers(k)[1:]
    with np.errstate(over="ignore"):
        if len(words) >= k:
            rolled = mixed(sum(words[i : len(words) - k + 1 + i] * factors[i] for i in range(k)))
            if weights is not None:
                own = weights[bucket_of(words, len(weights))].astype(np.uint32)
                summed = sum(own[i : len(words) - k + 1 + i] for i in range(k))
        for low, high in zip(counts[:-1], counts[1:], strict=True):
            n = high - low
            if n >= k:
                here = slice(low, high - k + 1)
                yield np.unique(rolled[here]) if weights is None else _distinct(rolled[here], summed[here])
                continue
            if n:
                whole = (words[low:high] * factors[:n]).sum(dtype=np.uint64) + np.uint64(n)
                members = mixed(np.array([whole], np.uint64) ^ _STEP)
            else:
                members = np.empty(0, np.uint64)
            yield members if weights is None else (members, np.zeros(len(members), np.uint32))


def _distinct(shingles: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(shingles)
    shingles = shingles[order]
    first = np.append(True, shingles[1:] != shingles[:-1])
    return shingles[first], weight[order[first]]


def bucket_of(words: np.ndarray, buckets: int) -> np.ndarray:
    """Words by their hashes, in so many buckets (a power of two)."""
    return (words & np.uint64(buckets - 1)).astype(np.int64)


def _sliced(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts' bytes, about SLICE_BYTES at a time, with the start of each text."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + SLICE_BYTES, "right")) - 1)
        high = min(high, len(texts))
        yield data[ends[low] : ends[high]], ends[low:high] - ends[low]
        low = high


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's distinct k-word shingles, sorted, as 64-bit hashes.

    A-Z count as a-z; words are runs of other than space and the controls 9 to
    13. With fewer than k words the whole sequence is the one shingle; a null
    text, or one without words, has none.
    """
    for data, starts in _sliced(texts):
        yield from _shingle_sets(data, starts, k, None)


def weighted_sets(texts: pa.Array, k: int, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As `shingle_sets`, each set with a number per shingle: what its words weigh
    together, by `weights` of their buckets."""
    for data, starts in _sliced(texts):
        yield from _shingle_sets(data, starts, k, weights)


def count_words(texts: pa.Array, counts: np.ndarray) -> None:
    """Adds the words of all texts to the counts of their buckets."""
    for data, starts in _sliced(texts):
        words, _ = _word_hashes(data, starts)
        np.add.at(counts, bucket_of(words, len(counts)), 1)
