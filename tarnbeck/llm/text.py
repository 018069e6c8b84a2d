"""Vectorised views of batches of text: bytes, words, lines and their rolling hashes.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; those six are ASCII, so UTF-8 sequences
never split. Hashes are 64-bit polynomials modulo 2**64 taken from prefix sums, then mixed, so any
span of a buffer costs O(1) whatever its length. Nulls read as empty texts.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows that Spark hands to Python at once. Its own default of 10,000 is too much for rows that hold texts.
ROWS = 1024
#: Bytes of text handled at once, so that a piece's arrays stay in a core's cache; a longer text forms a piece of its own.
PIECE = 1 << 17

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers["up"]) < n:
        size = max(n, 2 * PIECE)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def bounded_batches(df: DataFrame) -> DataFrame:
    """The frame; sees to it that its session hands at most ROWS rows to Python at once, and that workers find this package where the driver did."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ROWS:
        conf.set(key, ROWS)
    env, top = df.sparkSession.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if top not in paths:
        env["PYTHONPATH"] = os.pathsep.join([top, *paths])
    return df


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def give_back() -> None:
    """Returns freed memory to the system. Workers outlive their tasks, and glibc keeps what the largest arrays once took."""
    if _trim:
        _trim(0)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, at, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8), offsets


@dataclass
class Piece:
    """Rows lo to hi of a batch; the bytes of row i are buf[off[i]:off[i + 1]]."""

    lo: int
    hi: int
    buf: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return self.hi - self.lo


def pieces(column: pa.Array, most: int = PIECE) -> Iterator[Piece]:
    """Consecutive rows of at most `most` bytes together, or one longer row."""
    buf, off = strings(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        hi = min(hi, n, lo + 65536)
        yield Piece(lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of `inside` that no row border crosses: starts, ends, and the first run of each row."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    before = np.empty(len(inside), bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(len(inside), bool)
    after[-1], after[:-1] = False, inside[1:]
    full = off[1:] > off[:-1]
    before[off[:-1][full]] = False
    after[off[1:][full] - 1] = False
    start = np.flatnonzero(inside & ~before)
    return start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(start, off)


class Hasher:
    """Hashes of any spans of one buffer."""

    def __init__(self, buf: np.ndarray):
        up, self.down = powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words of a piece. first[i] is the index of row i's first word; first has one entry more than rows."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(piece: Piece, lower: bool) -> Words:
    start, end, first = spans(~SPACE[piece.buf], piece.off)
    return Words(start, end, first, Hasher(LOWER[piece.buf] if lower else piece.buf)(start, end))


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n words inside a row, and the index of each window's first word."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out *= np.uint64(_BASE)
        out += hashes[k : k + size]
    ok = np.ones(size + n, bool)
    for k in range(1, n):  # windows that begin within n - 1 words of a row's end
        at = first[1:] - k
        ok[at[(at >= 0) & (at < size)]] = False
    at = np.flatnonzero(ok[:size])
    return mix(out[at] + np.uint64(n)), at


def concat_ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices start[0], start[0] + 1, ... of all ranges, one after the other."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    full = size > 0
    begin, size = start[full], size[full]
    at = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1], out=at[1:])
    out[at[0]] = begin[0]
    out[at[1:]] = begin[1:] - (begin[:-1] + size[:-1] - 1)
    return np.cumsum(out)


def keep_rows(docs: DataFrame, keep: Callable[[pa.Array], Iterator[tuple[int, int, np.ndarray]]]) -> DataFrame:
    """The rows, with all their columns, that `keep` accepts by their texts: it gets a batch's texts and yields (first row, last row, accepted)."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, ok in keep(batch.column(at)):
                yield batch.slice(lo, hi - lo).filter(pa.array(ok))

    return bounded_batches(docs).mapInArrow(run, docs.schema)
