"""Words and word n-grams of texts as 64-bit hashes, in numpy, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed at once, which bounds a task's memory; a longer text is a batch of its own.
BATCH = 1_500_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, BATCH + 1024)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def batches(texts: list[bytes], most: int = BATCH) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose texts have about ``most`` bytes."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > most:
            yield first, k
            first, held = k, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_bounds(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values of ``inside`` (a table by byte)."""
    held = np.empty(len(data) + 2, bool)
    held[0] = held[-1] = False
    held[1:-1] = inside[data]
    change = np.flatnonzero(held[1:] != held[:-1])
    return change[::2], change[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, wherever it stands."""
    up, down = _power(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: All bytes but white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


def docs_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased), and for each text the position of its first word, with one more at the end."""
    data = lower_ascii(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8))
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts, ends = word_bounds(data, NOT_SPACE)
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    return span_hashes(data, starts, ends), first


_PLACE = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The distinct hashes of the word n-grams of each text, sorted; a text of fewer words has one, of all its words."""
    hashes, first = docs_words(texts)
    out = []
    with np.errstate(over="ignore"):
        n = len(hashes) - words + 1
        grams = np.zeros(max(n, 0), np.uint64)
        for k in range(words):
            grams += hashes[k : k + max(n, 0)] * _PLACE[k]
        grams = mixed(grams)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= words:
                out.append(np.unique(grams[a : b - words + 1]))
            elif b > a:
                # the count makes it differ from any n-gram of full length
                out.append(mixed((hashes[a:b] * _PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a) * _PLACE[63]))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
