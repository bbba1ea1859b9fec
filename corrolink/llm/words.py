"""Hashes of the words of many texts at once, by array operations over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that are looked at together; longer input is cut at a separator.
CHUNK = 1 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: The lowest bytes of a number, by how many of them there are.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Words of up to so many bytes are hashed eight bytes at a time, all words together; longer ones by themselves.
_SHORT = 64


def separators(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


#: The white space that parts words: [\x20\x09-\x0D].
SPACE = separators(b" \t\n\x0b\x0c\r")

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = ord("a")
_CLASS[128:] = ord("a")
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = ord("A")
_CLASS[list(b"0123456789")] = ord("0")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n hashes."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    m = len(h) - n + 1
    out = h[:m].copy()
    for i in range(1, n):
        out = out * _STEP + h[i : m + i]
    return mix(out)


def word_bounds(data: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes."""
    inside = ~sep[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(data) and inside[0]:
        edge = np.concatenate([[0], edge])
    if len(data) and inside[-1]:
        edge = np.concatenate([edge, [len(data)]])
    return edge[::2], edge[1::2]


def _key(place) -> np.ndarray:
    """What makes equal bytes at different places of a word count differently."""
    return mix((np.atleast_1d(np.asarray(place, dtype=np.uint64)) + np.uint64(1)) * _STEP)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray((len(data),), dtype="<u8", buffer=padded, strides=(1,))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span; none is empty. Every eight bytes go through the finaliser with a key of
    their place, and the sum with the length goes through it again, so no family of texts is known to meet."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lens, view = ends - starts, _eights(data)
    acc = mix((view[starts] & _MASK[np.minimum(lens, 8)]) + _key(0))
    for k in range(1, _SHORT // 8):
        more = np.flatnonzero(lens > 8 * k)
        if not len(more):
            break
        acc[more] += mix((view[starts[more] + 8 * k] & _MASK[np.minimum(lens[more] - 8 * k, 8)]) + _key(k))
    for i in np.flatnonzero(lens > _SHORT).tolist():
        at = np.arange(_SHORT, int(lens[i]), 8)
        acc[i] += np.add.reduce(mix((view[starts[i] + at] & _MASK[np.minimum(lens[i] - at, 8)]) + _key(at >> 3)))
    return mix(acc + lens.astype(np.uint64) * _STEP)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return hash_spans(data, starts, ends)


def hash_shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sep: np.ndarray) -> np.ndarray:
    """Of each word's shape: lower case, upper case and digits as classes, runs of one class drawn together."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    inside = ~sep[data]
    kinds = _CLASS[data[inside]]
    first = np.cumsum(ends - starts) - (ends - starts)
    new = np.ones(len(kinds), dtype=bool)
    new[1:] = kinds[1:] != kinds[:-1]
    new[first] = True
    lens = np.add.reduceat(new.astype(np.int64), first)
    at = np.cumsum(lens) - lens
    return mix(hash_spans(kinds[new], at, at + lens) + np.uint64(3))


def hash_prefixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """(words x sizes): hash of the first bytes (eight at most) of each word, with a mark of the size."""
    lens = np.minimum(ends - starts, 8)
    front = _eights(data)[starts] if len(starts) else np.zeros(0, dtype=np.uint64)
    return np.stack([mix((front & _MASK[np.minimum(lens, size)]) + _key(1 << 20 | size)) for size in sizes], axis=1)


def pieces(texts: list[str], sep: np.ndarray, lower: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, word starts, word ends, text number of each word) of stretches of the joined texts.

    Stretches end between words. A line feed, which must be a separator, stands between the texts.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    at = 0
    while at < len(data):
        to = min(len(data), at + CHUNK)
        while to < len(data) and not sep[data[to]]:
            gap = np.flatnonzero(sep[data[to : to + CHUNK]])
            to = to + int(gap[0]) if len(gap) else min(len(data), to + CHUNK)
        part = data[at:to]
        starts, stops = word_bounds(part, sep)
        yield part, starts, stops, np.searchsorted(ends, starts + at, side="right")
        at = to


def by_text(texts: list[str], sep: np.ndarray = SPACE, lower: bool = False, shapes: bool = False) -> list[tuple[np.ndarray, ...]]:
    """For each text the hashes of its words, and with shapes those of their shapes too."""
    found = [(hash_words(d, s, e), *([hash_shapes(d, s, e, sep)] if shapes else []), of) for d, s, e, of in pieces(texts, sep, lower)]
    if not found:
        return [tuple(np.zeros(0, dtype=np.uint64) for _ in range(1 + shapes)) for _ in texts]
    cols = [np.concatenate(c) for c in zip(*found, strict=True)]
    cuts = np.searchsorted(cols[-1], np.arange(len(texts) + 1))
    return [tuple(c[a:b] for c in cols[:-1]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
