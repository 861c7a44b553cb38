"""Words of a batch of texts as numpy arrays: places and 64-bit hashes, no Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * U(0xD1342543DE82EF95))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Powers:
    """Powers of an odd number modulo 2**64, kept as far as they were needed."""

    def __init__(self, base: int):
        self.base = base
        self.known = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            self.known = np.full(n, self.base, np.uint64)
            self.known[0] = 1
            np.multiply.accumulate(self.known, out=self.known)
        return self.known[:n]


class Rolling:
    """Hashes of byte ranges: differences of a running polynomial."""

    def __init__(self):
        self.up, self.down = Powers(BASE), Powers(INVERSE)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.empty(len(data) + 1, np.uint64)
        out[0] = 0
        terms = BYTE_CODES[data]
        terms *= self.up.upto(len(data))
        np.cumsum(terms, out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = prefix[ends] - prefix[starts]
        out *= self.down.upto(len(prefix))[starts]
        return mixed(out)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and len + 1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if column.offset:
        column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], np.int32)[
        column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]] if body and len(column) else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def word_places(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes; a run ends where its text ends."""
    edges = offsets[:-1][offsets[:-1] < len(member)]
    before = np.empty(len(member), bool)
    before[1:] = member[:-1]
    before[edges] = False
    starts = np.flatnonzero(member & ~before)
    after = np.empty(len(member), bool)
    after[:-1] = member[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(member & ~after) + 1
    return starts, ends


class Words:
    """Lower-cased (A-Z) words of texts: `starts`, `ends` in bytes, `hashes`, `first` word per text."""

    def __init__(self, column: pa.Array, is_word: np.ndarray, rolling: Rolling):
        data, self.offsets = buffers(column)
        self.data = LOWER[data]
        if len(data):
            self.starts, self.ends = word_places(is_word[self.data], self.offsets)
            self.hashes = rolling.ranges(rolling.prefix(self.data), self.starts, self.ends)
        else:
            self.starts = self.ends = np.empty(0, np.int64)
            self.hashes = np.empty(0, np.uint64)
        self.first = np.searchsorted(self.starts, self.offsets)


def letters_and_digits() -> np.ndarray:
    """Word bytes of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+."""
    is_word = np.zeros(256, bool)
    is_word[0x30:0x3A] = is_word[0x61:0x7B] = is_word[0x80:] = True
    return is_word


def not_space() -> np.ndarray:
    """Word bytes of [^\\x20\\x09-\\x0D]+."""
    is_word = np.ones(256, bool)
    is_word[0x20] = is_word[9:14] = False
    return is_word
