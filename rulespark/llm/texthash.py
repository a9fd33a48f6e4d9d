"""Vectorised hashing of words and word windows over Arrow text columns.

A task sees its texts as one byte buffer with offsets.  Every function here
works on whole buffers with numpy, in slices of about a quarter of a megabyte, so a very
long text costs memory in proportion to itself only and a null text counts as
an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time (a longer text is handled alone).
SLICE_BYTES = 1 << 18

#: Space and the control characters from tab to carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def byte_table(members: bytes) -> np.ndarray:
    """A 256-entry boolean table that is true for ``members``."""
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(members, dtype=np.uint8)] = True
    return table


IS_SPACE = byte_table(SPACES)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(_BASE, -1, 1 << 64))
    ones = np.ones(size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        up, down = ones.copy(), ones.copy()
        up[1:] = np.uint64(_BASE)
        down[1:] = inverse
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    room = SLICE_BYTES * 2
    while room < size:
        room *= 2
    return _powers(room)


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


def constants(count: int, seed: int, odd: bool = True) -> np.ndarray:
    """``count`` reproducible 64-bit constants."""
    with np.errstate(over="ignore"):
        steps = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        out = mix(steps + np.uint64((seed * 0x2545F4914F6CDD1D) & _MASK))
    return out | np.uint64(1) if odd else out


@dataclass
class Texts:
    """Some texts: ``data`` is their UTF-8, text i is data[offsets[i]:offsets[i + 1]]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Spans:
    """Words or lines: start and end bytes, and the spans of text i are first[i] to first[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def slices(column: pa.Array, limit: int = SLICE_BYTES, most: int = 1 << 30) -> Iterator[Texts]:
    """The texts of a column, about ``limit`` bytes and at most ``most`` texts at a time."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, len(column), at + most)
        yield Texts(at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


def spans(texts: Texts, inside: np.ndarray) -> Spans:
    """Maximal runs of bytes where ``inside`` holds, within each text."""
    size = len(texts.data)
    if not size:
        empty = np.zeros(0, np.int64)
        return Spans(empty, empty, np.zeros(len(texts) + 1, np.int64))
    edge = np.zeros(size + 1, dtype=bool)
    edge[texts.offsets] = True
    before = np.empty(size, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:size]))
    after = np.empty(size, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Spans(start, end, np.searchsorted(start, texts.offsets))


def words(texts: Texts) -> Spans:
    """Runs of bytes other than space and tab to carriage return."""
    return spans(texts, ~IS_SPACE[texts.data])


def lines(texts: Texts) -> Spans:
    """The parts between newlines, empty ones left out."""
    return spans(texts, texts.data != 10)


def span_hashes(data: np.ndarray, found: Spans) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes give equal hashes anywhere."""
    if not len(found.start):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        raw = (total[found.end] - total[found.start]) * down[found.start]
        return mix(raw + (found.end - found.start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def windows(hashes: np.ndarray, found: Spans, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each run of ``width`` words within a text: (hash, text, first word).

    With ``short``, a text with fewer words (one at least) gives its whole
    sequence as one window.
    """
    counts = found.counts
    owner = found.owner
    size = len(hashes)
    factors = constants(width, 7)
    with np.errstate(over="ignore"):
        if size >= width:
            out = np.zeros(size - width + 1, dtype=np.uint64)
            for k in range(width):
                out += hashes[k : size - width + 1 + k] * factors[k]
            whole = owner[: size - width + 1] == owner[width - 1 :]
            place = np.flatnonzero(whole)
            out, text = mix(out[place]), owner[place]
        else:
            out, text, place = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if short and width > 1:
            few = np.flatnonzero((counts > 0) & (counts < width))
            if len(few):
                extra = np.zeros(len(few), dtype=np.uint64)
                for k in range(width - 1):
                    has = counts[few] > k
                    extra[has] += hashes[found.first[few[has]] + k] * factors[k]
                extra = mix(extra + counts[few].astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
                order = np.argsort(np.concatenate([text, few]), kind="stable")
                out = np.concatenate([out, extra])[order]
                place = np.concatenate([place, found.first[few]])[order]
                text = np.concatenate([text, few])[order]
    return out, text, place


def distinct(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash), sorted by text and then hash."""
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], text[new]


def lowered_windows(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word windows of each text, A-Z lower-cased: (hash, text)."""
    data = LOWER[texts.data]
    found = words(texts)
    out, text, _ = windows(span_hashes(data, found), found, width)
    return distinct(out, text)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


#: 0 white space, 1 letters, digits and bytes of non-ASCII characters, 2 the rest.
TOKEN_CLASS = np.full(256, 2, dtype=np.uint8)
TOKEN_CLASS[np.frombuffer(SPACES, np.uint8)] = 0
TOKEN_CLASS[128:] = 1
TOKEN_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1


def tokens(texts: Texts) -> tuple[Spans, np.ndarray]:
    """Runs of letters and digits, and runs of other signs; with the hash of each, A-Z lower-cased."""
    size = len(texts.data)
    kind = TOKEN_CLASS[texts.data]
    if not size:
        empty = np.zeros(0, np.int64)
        return Spans(empty, empty, np.zeros(len(texts) + 1, np.int64)), np.zeros(0, np.uint64)
    edge = np.zeros(size + 1, dtype=bool)
    edge[texts.offsets] = True
    turn = np.ones(size + 1, dtype=bool)
    turn[1:-1] = kind[1:] != kind[:-1]
    turn |= edge
    inside = kind > 0
    start = np.flatnonzero(inside & turn[:-1])
    end = np.flatnonzero(inside & turn[1:]) + 1
    found = Spans(start, end, np.searchsorted(start, texts.offsets))
    return found, span_hashes(LOWER[texts.data], found)


def token_ngrams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The hashed one- and two-token n-grams of each text, with repeats: (hash, text), grouped by text.

    A two-gram of one token twice also counts under a hash of its own, so that
    stuttering texts share a feature.
    """
    found, one = tokens(texts)
    owner = found.owner
    two, text, place = windows(one, found, 2, short=False)
    same = one[place] == one[place + 1] if len(place) else np.zeros(0, bool)
    hashes = np.concatenate([one, two, np.full(int(same.sum()), 0x6A09E667F3BCC909, np.uint64)])
    text = np.concatenate([owner, text, text[same]])
    order = np.argsort(text, kind="stable")
    return hashes[order], text[order]


def sums_by_text(values: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """Sum of the values of each text."""
    return np.bincount(text, weights=values, minlength=size)[:size]


#: Letters and characters beyond ASCII; and the same with digits.
IS_LETTER = byte_table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
IS_LETTER_OR_DIGIT = byte_table(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))


def terms(texts: Texts, members: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The maximal runs of the bytes ``members``, A-Z lower-cased: a binary array, and how many each text has."""
    inside = members[texts.data]
    found = spans(texts, inside)
    offsets = np.zeros(len(found.start) + 1, dtype=np.int64)
    np.cumsum(found.end - found.start, out=offsets[1:])
    data = LOWER[texts.data[inside]]
    return pa.Array.from_buffers(pa.large_binary(), len(found.start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), found.counts
