"""Quality rules by repetition coverage: the share of a text's characters inside repeated n-grams and lines.

Texts are read as bytes; rolling hashes of several n-gram lengths and of lines are compared within
each text, in numpy. Map-only: no shuffle, and memory is bounded by one piece or one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarnbeck.llm.text import SPACE, Hasher, Piece, bounded_batches, grams, mix, pieces, spans, words

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class RepetitionLimits:
    """Most that may be repeated, as a share of the characters in words. grams: by n-gram length."""

    grams: dict[int, float] = field(default_factory=lambda: {5: 0.15, 7: 0.13, 10: 0.10})
    line_chars: float = 0.20
    lines: float = 0.30
    min_words: int = 50
    repeat_percent: int = 50


def per_row(at: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many of the ascending positions `at` fall in each row."""
    return np.diff(np.searchsorted(at, off))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def later(keys: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Indices, ascending, of marked keys that have occurred before."""
    at = np.flatnonzero(marked)
    order = np.argsort(keys[at], kind="stable")
    s = keys[at][order]
    return np.sort(at[order[1:][s[1:] == s[:-1]]])


def covered(begin: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of `size` words lie in a window of n words that begins at one of `begin`."""
    edge = np.zeros(size + 1, np.int32)
    edge[begin] += 1
    edge[begin + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def measure(piece: Piece, limits: RepetitionLimits) -> dict[str, np.ndarray]:
    """Columns for the rows of a piece."""
    w, rows = words(piece, lower=False), len(piece)
    row, buf, off = w.row(), piece.buf, piece.off
    salt = mix(np.arange(1, rows + 1, dtype=np.uint64))
    solid = (buf & 0xC0) != 0x80  # the first byte of each character
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(solid & ~SPACE[buf], out=points[1:])
    length = points[w.end] - points[w.start]
    sums = lambda x: np.bincount(row, x, rows).astype(np.int64) if len(row) else np.zeros(rows, np.int64)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out = {"n_words": np.diff(w.first), "word_chars": points[off[1:]] - points[off[:-1]], "n_symbols": per_row(np.flatnonzero(symbol[buf]), off)}

    l_start, l_end, l_first = spans(buf != 10, off)
    l_words = np.searchsorted(w.start, l_end) - np.searchsorted(w.start, l_start)
    full = l_words > 0
    l_start, l_end = l_start[full], l_end[full]
    l_row = np.searchsorted(off, l_start, side="right") - 1
    keys = Hasher(buf)(l_start, l_end) ^ salt[l_row] if len(l_row) else np.zeros(0, np.uint64)
    again = later(keys, repeated(keys))
    out["n_lines"] = np.bincount(l_row, minlength=rows)
    out["n_dup_lines"] = np.bincount(l_row[again], minlength=rows)
    dup_line_chars = np.bincount(l_row[again], points[l_end[again]] - points[l_start[again]], rows)

    keys, at = grams(w.hash, w.first, 3)
    found = repeated(keys ^ salt[row[at]]) if len(at) else np.zeros(0, bool)
    out["n_repeat_words"] = sums(covered(at[found], 3, len(row)))
    out["base_failed"] = (out["n_words"] < limits.min_words) | (100 * out["n_repeat_words"] > limits.repeat_percent * out["n_words"])

    chars = np.maximum(out["word_chars"], 1)
    out["dup_line_char_share"] = dup_line_chars / chars
    good = (out["dup_line_char_share"] <= limits.line_chars) & (out["n_dup_lines"] <= limits.lines * np.maximum(out["n_lines"], 1))
    for n, most in limits.grams.items():
        keys, at = grams(w.hash, w.first, n)
        if len(at):
            keys = keys ^ salt[row[at]]
            again = later(keys, repeated(keys))
            share = np.bincount(row, length * covered(at[again], n, len(row)), rows) / chars
        else:
            share = np.zeros(rows)
        out[f"dup_{n}gram_share"] = share
        good &= share <= most
    out["kept"] = good & ~out["base_failed"]
    return out


def apply_rules(docs: DataFrame, limits: RepetitionLimits | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, then the measured shares.

    Words are runs of characters outside space and U+0009-U+000D. A line is a part between line feeds
    that has a word; it is duplicate if an earlier line of the text equals it. n_repeat_words counts
    words in three-word windows found at least twice in the text. A null or empty text has no words:
    base_failed, not kept. Null doc_ids and repeated rows stay as they are; no documents give no rows.
    """
    limits = limits or RepetitionLimits()
    shares = ["dup_line_char_share", *(f"dup_{n}gram_share" for n in limits.grams)]
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in longs) + ", base_failed boolean, kept boolean, " + ", ".join(f"{c} double" for c in shares)
    columns = [*longs, "base_failed", "kept", *shares]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                out = measure(piece, limits)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.lo, len(piece)), *(pa.array(out[c]) for c in columns)], names=["doc_id", *columns])

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, schema)
