"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

A word is a maximal run of bytes other than ASCII white space, with A-Z in lower case. Works on the bytes of Arrow
string columns, a bounded slab at a time; a single text longer than a slab is read in parts that end between words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLAB_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
#: For words without punctuation: every ASCII byte that is no letter or digit.
PUNCTUATION = np.array([byte < 128 and not chr(byte).isalnum() for byte in range(256)])
_powers: dict[str, np.ndarray] = {}


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection that spreads bits (the finaliser of splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        size = SLAB_BYTES + 1
        inverse = pow(int(BASE), -1, 1 << 64)
        for name, base in (("up", BASE), ("down", np.uint64(inverse))):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def _slab_words(data: np.ndarray, bounds: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, words of each text, starts, ends) for texts data[bounds[i]:bounds[i + 1]]."""
    count = len(bounds) - 1
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), np.zeros(count, dtype=np.int64), none, none
    up, down = _power_tables()
    solid = ~breaks[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[bounds] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:-1]
    finishes = solid.copy()
    finishes[:-1] &= ~solid[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    terms = np.zeros(len(data) + 1, dtype=np.uint64)
    np.multiply(_LOWER[data].astype(np.uint64) + np.uint64(1), up[: len(data)], out=terms[1:])
    np.cumsum(terms, out=terms)
    hashes = mix((terms[ends] - terms[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, bounds)), starts, ends


def _long_text_words(data: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + SLAB_BYTES)
        if end < len(data):
            spaces = np.flatnonzero(breaks[data[at:end]])
            if not len(spaces):  # one word longer than a slab: its hash is made from those of its parts
                stop = end
                while stop < len(data) and not breaks[data[stop]]:
                    ahead = np.flatnonzero(breaks[data[stop : stop + SLAB_BYTES]])
                    stop = stop + int(ahead[0]) if len(ahead) else min(len(data), stop + SLAB_BYTES)
                if stop - at <= SLAB_BYTES:  # it fills the slab, and is hashed as elsewhere
                    parts.append(_slab_words(data[at:stop], np.array([0, stop - at]), breaks)[0])
                    at = stop
                    continue
                value = np.zeros(1, dtype=np.uint64)
                for piece in range(at, stop, SLAB_BYTES):
                    block = data[piece : min(stop, piece + SLAB_BYTES)]
                    value = mix(value * STEP + _slab_words(block, np.array([0, len(block)]), breaks)[0])
                parts.append(value)
                at = stop
                continue
            end = at + int(spaces[-1]) + 1
        parts.append(_slab_words(data[at:end], np.array([0, end - at]), breaks)[0])
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def slabs(texts: pa.Array, breaks: np.ndarray = _SPACE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, word hashes, words of each text) for runs of consecutive texts; null texts have no words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    count = len(texts)
    if not count:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + count + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < count:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLAB_BYTES, side="right")) - 1)
        part = data[offsets[at] : offsets[end]]
        if len(part) > SLAB_BYTES:
            words = _long_text_words(part, breaks)
            yield at, end, words, np.array([len(words)])
        else:
            words, counts, _, _ = _slab_words(part, offsets[at : end + 1] - offsets[at], breaks)
            yield at, end, words, counts
        at = end


def windows(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index, word position) of every run of `width` words of a text; a shorter text is one run as a whole."""
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    position = np.arange(len(words)) - np.repeat(ends - counts, counts)
    room = np.repeat(counts, counts) - position
    value = np.full(len(words), width, dtype=np.uint64)
    for ahead in range(width):
        rolled = np.zeros(len(words), dtype=np.uint64)
        rolled[: len(words) - ahead] = words[ahead:]
        rolled[room <= ahead] = 0
        value = value * STEP + rolled
    keep = (room >= width) | (position == 0)
    short = room < width
    value[short] += room[short].astype(np.uint64) * BASE
    return mix(value[keep]), owner[keep], position[keep]


def distinct(hashes: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text in order without repeats, one text after the other, and how many each has."""
    counts = np.bincount(owner, minlength=texts)
    out, at = [], 0
    sizes = np.zeros(texts, dtype=np.int64)
    for text, count in enumerate(counts):
        if count:
            found = np.unique(hashes[at : at + count])
            at += count
            sizes[text] = len(found)
            out.append(found)
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), sizes


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, distinct shingle hashes text by text, how many each text has), a slab at a time."""
    for first, end, words, counts in slabs(texts):
        hashes, owner, _ = windows(words, counts, width)
        yield first, end, *distinct(hashes, owner, end - first)
