"""Sets of hashed word shingles of whole texts, many texts at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from lexspark.llm.common import mix64

_rng = np.random.default_rng(20240607)
_letters = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_order = _rng.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_base = np.uint64(0x9E3779B97F4A7C15)
_blank = np.zeros(256, bool)
_blank[[0x20, *range(0x09, 0x0E)]] = True


def shingle_sets(texts: Iterable[str], k: int, block: int = 1 << 19) -> Iterator[np.ndarray]:
    """For each text its distinct k-word shingles as sorted 64-bit hashes.

    A-Z are lower-cased; words are runs without the blanks 0x20 and 0x09-0x0D. Fewer than k words make one shingle, no
    words none. Texts are joined up to `block` bytes, so memory follows the longest text.
    """
    waiting: list[bytes] = []
    size = 0
    for text in texts:
        data = text.encode("utf-8", "surrogatepass").lower()
        if waiting and size + len(data) > block:
            yield from _sets(waiting, k)
            waiting, size = [], 0
        waiting.append(data)
        size += len(data) + 1
    if waiting:
        yield from _sets(waiting, k)


def _sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    chars = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    inside = ~_blank[chars]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    lengths = ends - starts
    counts = np.diff(np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])), prepend=0)
    if len(starts):
        first = np.cumsum(lengths) - lengths
        place = np.arange(lengths.sum()) - np.repeat(first, lengths)
        powers = np.full(int(lengths.max()), _base)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        words = mix64(np.add.reduceat(_letters[chars[inside]] * powers[place], first) + lengths.astype(np.uint64))
        windows = max(0, len(words) - k + 1)
        runs = np.zeros(windows, np.uint64)
        for j in range(k):
            runs += words[j : j + windows] * _order[j]
        runs = mix64(runs)
    at = 0
    for n in counts.tolist():
        if n >= k:
            yield np.unique(runs[at : at + n - k + 1])
        elif n:
            yield mix64(np.array([(words[at : at + n] * _order[:n]).sum() + np.uint64(n)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
        at += n


def set_digest(hashes: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers that equal sets share."""
    if not len(hashes):
        return 0, 0
    a = mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = np.bitwise_xor.reduce(mix64(hashes * np.uint64(0xD1342543DE82EF95) + np.uint64(len(hashes))))
    return int(a.astype(np.int64)), int(b.astype(np.int64))
