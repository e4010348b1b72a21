"""Sets of word shingles as sorted 64-bit hashes, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes that are hashed at once; a longer word is hashed by itself.
SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20_240_501).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z


def _powers(base: int) -> np.ndarray:
    out = np.ones(SEGMENT, np.uint64)
    done, step = 1, np.uint64(base)
    with np.errstate(over="ignore"):
        while done < SEGMENT:
            out[done : 2 * done] = out[:done] * step
            done, step = 2 * done, step * step
    return out


_POWERS: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _POWERS:
        _POWERS.extend((_powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))))
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _segment(b: np.ndarray) -> np.ndarray:
    up, down = _tables()
    edge = np.diff(np.concatenate(([True], _SPACE[b], [True])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word, a maximal run of characters other than ASCII white space, with A-Z folded."""
    b = np.frombuffer(text.encode(), np.uint8)
    if len(b) <= SEGMENT:
        return _segment(b)
    out, at, spaces = [], 0, np.flatnonzero(_SPACE[b])
    while at < len(b):
        k = int(np.searchsorted(spaces, at + SEGMENT - 1, "right"))
        if len(b) - at <= SEGMENT:
            to = len(b)
        elif k and spaces[k - 1] >= at:
            to = int(spaces[k - 1]) + 1
        else:  # within a word of more than a segment
            to = int(spaces[k]) if k < len(spaces) else len(b)
            own = hashlib.blake2b(b[at:to].tobytes().lower(), digest_size=8).digest()
            out.append(np.frombuffer(own, np.uint64))
            at = to
            continue
        out.append(_segment(b[at:to]))
        at = to
    return np.concatenate(out)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``width`` words; of a shorter text, the whole sequence as one; empty without words."""
    return _of_words(word_hashes(text) if text else np.empty(0, np.uint64), width)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each once; for short arrays less work than ``np.unique``."""
    x = np.sort(x)
    fresh = np.empty(len(x), bool)
    fresh[:1] = True
    np.not_equal(x[1:], x[:-1], out=fresh[1:])
    return x if fresh.all() else x[fresh]


def _of_words(words: np.ndarray, width: int) -> np.ndarray:
    if not len(words):
        return words
    k = min(width, len(words))
    n = len(words) - k + 1
    h = words[:n] + np.uint64(k)
    for i in range(1, k):
        h = mix(h) + words[i : i + n]
    return _distinct(mix(h))


def _joined(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sets of texts that are a segment long together, hashed as one."""
    out = [np.empty(0, np.uint64)] * len(texts)
    b = np.frombuffer(b" ".join(texts), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])  # of each text and the blank after it
    up, down = _tables()
    edge = np.diff(np.concatenate(([True], _SPACE[b], [True])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
    words = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    last = np.searchsorted(start, ends).tolist()  # words up to the end of each text
    n = max(0, len(words) - width + 1)
    h = words[:n] + np.uint64(width)
    for i in range(1, width):
        h = mix(h) + words[i : i + n]
    h, first = mix(h), 0
    for k, to in enumerate(last):
        if to - first >= width:
            out[k] = _distinct(h[first : to - width + 1])
        elif to > first:
            out[k] = _of_words(words[first:to], width)
        first = to
    return out


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """``shingle_set`` of each text, many of them at once."""
    out: list[np.ndarray] = []
    now: list[bytes] = []
    size = 0
    for text in texts:
        data = text.encode() if text else b""
        if now and size + len(data) + 1 > SEGMENT:
            out += _joined(now, width)
            now, size = [], 0
        if len(data) >= SEGMENT:
            out.append(shingle_set(text, width))
        else:
            now.append(data)
            size += len(data) + 1
    return out + (_joined(now, width) if now else [])
