"""Words of whole batches of texts as numpy arrays, for use inside Arrow tasks.

A batch of texts lies in memory as one run of UTF-8 bytes with offsets. Word limits
and word hashes are found for the whole run at once. Texts are taken in chunks of
bounded bytes, never cut; a single text over the bound is a chunk of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21
#: Sums modulo 2**64 are the same for certain patterns of a thousand bytes and their
#: complements, whatever the base; words beyond this many bytes get a digest instead.
LONG_WORD = 256
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Powers of the base, kept while a worker lives.
CACHE: list[tuple[np.ndarray, np.ndarray]] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def lower_table() -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def space_table() -> np.ndarray:
    """Which bytes end a word: space and 0x09 to 0x0D."""
    table = np.zeros(256, dtype=bool)
    table[[32, 9, 10, 11, 12, 13]] = True
    return table


def punctuation_table() -> np.ndarray:
    """Which bytes end a word: all of ASCII but digits and lower-case letters."""
    table = np.zeros(256, dtype=bool)
    table[:128] = True
    table[48:58] = False
    table[97:123] = False
    return table


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE, dtype=np.uint64), np.full(n, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the hash base and of its inverse modulo 2**64."""
    if not CACHE or len(CACHE[0][0]) <= n:
        CACHE[:] = [_powers(max(CHUNK_BYTES, 1 << max(n, 1).bit_length()) + 1)]
    return CACHE[0]


def prefix_sums(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """P such that (P[e] - P[s]) * inverse**s is the polynomial hash of data[s:e]."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=out[1:])
    return out


BYTE_VALUES = _byte_values()


@dataclass
class Chunk:
    """Some whole texts: ``data[offsets[i]:offsets[i + 1]]`` is that of row first + i."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of an Arrow string column; null counts as the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, raw_offsets, raw = texts.buffers()
    offsets = np.frombuffer(raw_offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield Chunk(at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


@dataclass
class Words:
    """Words of a chunk: byte limits, hashes, and where each text's words start."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray
    data: np.ndarray


def split_words(chunk: Chunk, separators: np.ndarray) -> Words:
    """Words of lower-cased (A-Z) texts, with a 64-bit hash of each.

    Equal words have equal hashes; different ones collide as 64-bit hashes do.
    """
    data = lower_table()[chunk.data]
    inside = ~separators[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[chunk.offsets] = True
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    finishes[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    sums = prefix_sums(data, BYTE_VALUES)
    _, down = powers(len(data))
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        hashes[i] = int.from_bytes(digest, "little")
    return Words(starts, ends, hashes, np.searchsorted(starts, chunk.offsets), data)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` consecutive values."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, _ = powers(size)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        out += hashes[j : j + n] * up[j]
    return mix(out)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def segment_of(offsets: np.ndarray) -> np.ndarray:
    """For each item of consecutive segments, the number of its segment."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
