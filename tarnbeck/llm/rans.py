"""Static range asymmetric numeral coding of token ids in independent interleaved blocks.

One frequency table, counted over all ids, serves every block. A block holds whole documents; its ids
are dealt to interleaved lanes, each with its own 64-bit coder state, so numpy codes a row of lanes
at once. A block carries the lanes' states at checkpoints, from any of which decoding can start, and
a checksum; blocks need nothing from one another.

A block's payload, little-endian: u32 lanes, u32 checkpoints; then for each checkpoint u32 row, u32
word, and the lanes' u64 states; then u32 words of the coded stream. Decoding starts at a checkpoint's
row of lanes with its states and reads the stream from its word.
"""

from __future__ import annotations

import zlib

import numpy as np

LOW = np.uint64(1 << 31)
LANES = 1024
#: Rows of lanes between checkpoints.
STRIDE = 256


class Table:
    """Frequencies scaled to 2**bits; every counted symbol keeps at least one."""

    def __init__(self, freq: np.ndarray, bits: int):
        self.freq, self.bits = freq.astype(np.uint64), bits
        self.start = np.zeros(len(freq), np.uint64)
        np.cumsum(self.freq[:-1], out=self.start[1:])
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.limit = (LOW >> np.uint64(bits) << np.uint64(32)) * self.freq

    @classmethod
    def of_counts(cls, counts: np.ndarray, bits: int = 20) -> Table:
        used = np.flatnonzero(counts)
        while len(used) > 1 << (bits - 1):
            bits += 1
        freq = np.zeros(max(len(counts), 1), np.int64)
        if len(used):
            total, share = int(counts.sum()), (1 << bits) - len(used)
            exact = [int(c) * share for c in counts[used]]  # Python integers: no overflow at any count
            freq[used] = 1 + np.array([x // total for x in exact], np.int64)
            rest = (1 << bits) - int(freq.sum())
            order = sorted(range(len(used)), key=lambda k: (-(exact[k] % total), k))[:rest]
            freq[used[order]] += 1
        else:
            freq[0] = 1 << bits
        return cls(freq, bits)


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, stride: int = STRIDE) -> bytes:
    """The payload of one block."""
    rows = -(-len(ids) // lanes)
    bits, state = np.uint64(table.bits), np.full(lanes, LOW, np.uint64)
    words, checks, count = [], [], 0
    for r in range(rows - 1, -1, -1):
        x = ids[r * lanes : (r + 1) * lanes]
        s, f = state[: len(x)], table.freq[x]
        over = s >= table.limit[x]
        if over.any():
            out = (s[over] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            words.append(out)
            count += len(out)
            s[over] >>= np.uint64(32)
        q = s // f
        s[:] = (q << bits) + (s - q * f) + table.start[x]
        if r % stride == 0:
            checks.append((r, count, state.copy()))
    head = [np.array([lanes, len(checks)], "<u4").tobytes()]
    for r, done, states in reversed(checks):
        head += [np.array([r, count - done], "<u4").tobytes(), states.astype("<u8").tobytes()]
    return b"".join([*head, *(w.astype("<u4").tobytes() for w in reversed(words))])


def decode(payload: bytes, n: int, table: Table, checkpoint: int = 0, most: int | None = None) -> np.ndarray:
    """The ids of a block of n, or those from a checkpoint on, up to `most` checkpoints' worth."""
    lanes, checks = np.frombuffer(payload, "<u4", 2).tolist()
    size = 8 + 8 * lanes
    words = np.frombuffer(payload, "<u4", offset=8 + checks * size).astype(np.uint64)
    if not checks:
        return np.zeros(0, np.uint32)
    at = 8 + checkpoint * size
    row, word = np.frombuffer(payload, "<u4", 2, at).tolist()
    state = np.frombuffer(payload, "<u8", lanes, at + 8).astype(np.uint64)
    rows, stop = -(-n // lanes), checkpoint + (most or checks)
    if stop < checks:
        rows = int(np.frombuffer(payload, "<u4", 1, 8 + stop * size)[0])
    out = np.empty(min(n, rows * lanes) - row * lanes, np.uint32)
    bits, mask, done = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), 0
    for r in range(row, rows):
        k = min(lanes, n - r * lanes)
        s = state[:k]
        slot = s & mask
        x = table.symbol[slot]
        out[done : done + k] = x
        done += k
        s[:] = table.freq[x] * (s >> bits) + slot - table.start[x]
        low = s < LOW
        c = int(np.count_nonzero(low))
        if c:
            s[low] = (s[low] << np.uint64(32)) | words[word : word + c]
            word += c
    return out


def checksum(ids: np.ndarray) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())
