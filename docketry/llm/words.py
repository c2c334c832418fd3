"""Words of Arrow string columns as numpy arrays, for operators that read whole texts.

A word is a maximal run of bytes other than space and \\t..\\r, as in `[^\\x20\\x09-\\x0D]+`; in
UTF-8 those bytes never occur inside another character. Words are hashed to 64 bits, eight
bytes at a time. All work is on blocks of whole texts, so memory follows the block and not
the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20  # texts are handled in blocks of about this size; a longer text is one block

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# As in `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: lower-case letters, digits and all beyond ASCII make words.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S31, _S29, _S32 = (np.uint64(x) for x in (31, 29, 32))
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


@dataclass
class Block:
    """Whole texts side by side: `data` their bytes, `at` where each starts and the last ends."""

    rows: slice
    data: np.ndarray
    at: np.ndarray


@dataclass
class Words:
    """Words of a block: byte ranges, and `first[d]:first[d + 1]` the words of text `d`."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> _S31)) * _M2
    h ^= h >> _S29
    h *= _M3
    return h ^ (h >> _S32)


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a column in blocks; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, where, chars = texts.buffers()
    at = np.frombuffer(where, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(chars, np.uint8) if chars is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + size, "right")) - 1)
        high = min(high, n)
        yield Block(slice(low, high), data[at[low] : at[high]], at[low : high + 1] - at[low])
        low = high


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def find_words(data: np.ndarray, at: np.ndarray, space: np.ndarray = _SPACE) -> Words:
    """Words of the texts; `space` says of each byte value whether it separates words."""
    if not len(data):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64))
    ink = ~space[data]
    edge = np.unique(at[:-1][at[:-1] < at[1:]])
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    begins[edge] = ink[edge]
    stops = ink.copy()
    stops[:-1] &= ~ink[1:]
    last = np.unique(at[1:][at[:-1] < at[1:]]) - 1
    stops[last] = ink[last]
    starts = np.flatnonzero(begins)
    return Words(starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, at))


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the ranges one after another, and where each starts and the last ends."""
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(starts - at[:-1], size) + np.arange(at[-1])], at


def distinct_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct byte strings of the ranges, side by side with their offsets, and the number
    of the string that each range holds."""
    body, at = gather(data, starts, ends)
    strings = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(body)])
    coded = strings.dictionary_encode()
    held = coded.dictionary
    if not len(held):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64)
    _, where, chars = held.buffers()
    offsets = np.frombuffer(where, np.int64)[held.offset : held.offset + len(held) + 1]
    letters = np.frombuffer(chars, np.uint8) if chars is not None else np.zeros(0, np.uint8)
    return letters, offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, 0, (1,))
    left = ends - starts
    h = mix(left.astype(np.uint64) + _M1)
    live, pos, rest = np.arange(len(starts)), starts, left
    while len(live):
        took = eights[pos] & _KEEP[np.minimum(rest, 8)]
        step = mix((h[live] ^ took) * _M1 + took)
        h[live] = step
        more = rest > 8
        live, pos, rest = live[more], pos[more] + 8, rest[more] - 8
    return h


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    return hash_ranges(data, words.starts, words.ends)


_R = 0xD1342543DE82EF95


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the `n` words from each word on; the last n - 1 entries are left out."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total, width, out, done = h, 1, None, 0
    size = len(h) - n + 1
    left = n
    while left:
        if left & 1:  # append this power's block
            part = total[done : done + size]
            scale = np.uint64(pow(_R, width, 1 << 64))
            out = part.copy() if out is None else out * scale + part
            done += width
        left >>= 1
        if left:
            total = total[:-width] * np.uint64(pow(_R, width, 1 << 64)) + total[width:]
            width *= 2
    return mix(out)


def gram_places(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indices where `n` words of one text start, and how many each text has."""
    count = np.maximum(np.diff(words.first) - n + 1, 0)
    first = np.repeat(words.first[:-1] - (np.cumsum(count) - count), count)
    return np.arange(len(first)) + first, count
