"""Words of whole Arrow batches at once: their places, documents and 64-bit hashes, without a Python object a word.

A word's hash is the sum of a random number for each of its bytes times a power of an odd number that rises with the
byte's place; sums run over all bytes of a batch and are shifted back to the start of each word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from steadymark.llm.common import mixed

#: Bytes that are hashed at a time; small enough that the arrays stay in the cache.
CHUNK = 1 << 15
_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))
_BASE = mixed(np.array([0x5EED], np.uint64))[0] | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def byte_set(values: bytes) -> np.ndarray:
    marks = np.zeros(256, bool)
    marks[list(values)] = True
    return marks


#: Bytes between words.
BLANKS = byte_set(b" \t\n\x0b\x0c\r")


class Powers:
    """Powers of the base and of its inverse, kept for as many bytes as were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, size: int) -> None:
        if len(self.up) >= size:
            return
        size = 1 << (size - 1).bit_length()
        with np.errstate(over="ignore"):
            inverse = _BASE
            for _ in range(6):  # each step doubles the bits that are right
                inverse = inverse * (np.uint64(2) - _BASE * inverse)
            for name, base in (("up", _BASE), ("down", inverse)):
                values = np.full(size, base)
                values[0] = 1
                setattr(self, name, np.multiply.accumulate(values))


_POWERS = Powers()


@dataclass
class Words:
    """``data``: lower-cased bytes; words are ``starts`` to ``ends``; ``first[d]`` to ``first[d + 1]`` are those of document d."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def of(self, place: int) -> bytes:
        return self.data[self.starts[place] : self.ends[place]].tobytes()

    def hashes(self) -> np.ndarray:
        found = np.empty(len(self.starts), np.uint64)
        held = np.empty(CHUNK, np.uint64)
        at = 0
        while at < len(self.starts):
            low = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, low + CHUNK, "right")))
            size = int(self.ends[to - 1] - low)
            if size > len(held):
                held = np.empty(size, np.uint64)
            _POWERS.upto(size)
            sums = np.take(self._values, self.data[low : low + size], out=held[:size], mode="clip")
            sums *= _POWERS.up[:size]
            places = self.starts[at:to] - low
            found[at:to] = np.add.reduceat(sums, places) * _POWERS.down[places]
            at = to
        return mixed(found)

    _values: np.ndarray = None


def words_of(texts: pa.Array, blanks: np.ndarray = BLANKS, lower: bool = True) -> Words:
    """The words of a string column, parted by ``blanks``; a null text has none. A-Z are lower-cased."""
    texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[places[0] : places[-1]] if data is not None else np.empty(0, np.uint8)
    places -= places[0]
    if lower:
        data = _LOWER[data]
    blank = blanks[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[places] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= blank[:-1]
    after[:-1] |= blank[1:]
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    values = np.where(blanks, np.uint64(0), _BYTE_VALUES)
    return Words(data, starts, ends, np.searchsorted(starts, places), values)
