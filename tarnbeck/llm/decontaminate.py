"""Benchmark decontamination: n-gram seeds join documents to test items, Smith-Waterman alignment scores the passages.

Words are runs of letters and digits, lower-cased. A seed is an n-gram of a test item. Any passage with
a seed of an item is aligned with it, however many items share the seed and however many documents
repeat the passage; the alignment alone decides. Each document is read once: its n-grams are
looked up in the sorted seeds, hits of one item no further apart than its length form a passage, and the
passage is aligned with the item. Only confirmed passages leave a task. Items are broadcast in groups
of a stated size, so a larger benchmark costs more passes, not more memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tarnbeck.llm.text import Hasher, bounded_batches, grams, keep_rows, pieces, spans

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

#: Words of test items in one broadcast.
GROUP_WORDS = 1 << 20
#: Cells of one batch of alignments.
CELLS = 1 << 22


@dataclass(frozen=True)
class Leak:
    """seed: words in a seed. weight: least number of matching seeds of a passage to align.
    score: least alignment score as a share of the item's own. part: words in a row whose score is enough of itself,
    however small a part of the item they are. match, mismatch, gap: the alignment's costs."""

    seed: int = 3
    weight: float = 1.0
    score: float = 0.45
    part: int = 32
    match: int = 2
    mismatch: int = -1
    gap: int = -1


def word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, word hashes, first word of each row) of a text column, lower-cased by Unicode."""
    for piece in pieces(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))):
        start, end, first = spans(_WORD[piece.buf], piece.off)
        yield piece.lo, piece.hi, Hasher(piece.buf)(start, end), first


@dataclass
class Items:
    """Test items and the index of their seeds: ascending seed hashes with item and place. An item shorter than a seed is its own seed, of whatever length it has."""

    ids: list
    words: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, ids: list, texts: list[str | None], spec: Leak) -> Items:
        words: list[np.ndarray] = []
        for _, _, h, first in word_hashes(pa.array(texts, pa.large_string())):
            words += [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        found: dict[int, list] = {}
        for k, w in enumerate(words):
            n = min(spec.seed, len(w))
            if n:
                keys, at = grams(w, np.array([0, len(w)]), n)
                found.setdefault(n, []).append((keys, np.full(len(at), k), at))
        seeds = {}
        for n, parts in found.items():
            keys, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((at, item, keys))
            seeds[n] = keys[order], item[order], at[order]
        return cls(ids, words, seeds)


def hits(items: Items, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, item, place in the piece, place in the item) of all seeds found."""
    out = []
    for n, (keys, item, at) in items.seeds.items():
        g, place = grams(hashes, first, n)
        lo = np.searchsorted(keys, g)
        ok = np.flatnonzero((lo < len(keys)) & (keys[np.minimum(lo, len(keys) - 1)] == g))
        if not len(ok):
            continue
        lo, count = lo[ok], np.searchsorted(keys, g[ok], side="right") - lo[ok]
        for k in range(int(count.max())):  # seeds shared by items or repeated in one
            some = count > k
            at_k = lo[some] + k
            p = place[ok[some]]
            out.append((np.searchsorted(first, p, side="right") - 1, item[at_k], p, at[at_k]))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def passages(items: Items, hashes: np.ndarray, first: np.ndarray, spec: Leak) -> tuple[np.ndarray, ...]:
    """(row, item, begin, end) of parts of the texts that may hold an item: hits of one item no further apart than its length, widened to the item's length on either side."""
    row, item, place, at = hits(items, hashes, first)
    if not len(row):
        return row, item, place, at
    size = np.array([len(w) for w in items.words])
    order = np.lexsort((place, item, row))
    row, item, place, at = row[order], item[order], place[order], at[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (place[1:] - place[:-1] > size[item[1:]])
    start = np.flatnonzero(new)
    total = np.diff(np.append(start, len(row)))
    last = np.append(start[1:], len(row)) - 1
    row, item = row[start], item[start]
    lo, hi = place[start] - at[start] - 8, place[last] + size[item] - at[last] + 8
    lo = np.minimum(np.maximum(lo, first[row]), place[start])
    hi = np.maximum(np.minimum(hi, first[row + 1]), np.minimum(place[last] + spec.seed, first[row + 1]))
    ok = total >= spec.weight
    return row[ok], item[ok], lo[ok], hi[ok]


def align(a: list[np.ndarray], b: list[np.ndarray], spec: Leak) -> np.ndarray:
    """Smith-Waterman scores of a[k] with b[k], computed for many pairs at once along the rows of the item."""
    out = np.zeros(len(a), np.int64)
    order = np.argsort([len(x) for x in a], kind="stable")
    lo = 0
    while lo < len(order):
        hi, wide = lo + 1, len(a[order[lo]])
        while hi < len(order) and len(a[order[hi]]) * (hi + 1 - lo) <= CELLS // 8:
            hi += 1
        part = order[lo:hi]
        wide, tall = max(len(a[k]) for k in part), max(len(b[k]) for k in part)
        x, y = np.zeros((len(part), wide), np.uint64), np.ones((len(part), tall), np.uint64)  # fillers that never match
        for r, k in enumerate(part):
            x[r, : len(a[k])], y[r, : len(b[k])] = a[k], b[k]
        score, best = np.zeros((len(part), wide + 1), np.int32), np.zeros(len(part), np.int32)
        ramp = np.arange(wide + 1, dtype=np.int32) * spec.gap
        for j in range(tall):
            step = np.where(x == y[:, j : j + 1], np.int32(spec.match), np.int32(spec.mismatch))
            new = np.maximum(score + np.int32(spec.gap), 0)
            np.maximum(new[:, 1:], score[:, :-1] + step, out=new[:, 1:])
            # gaps along the text: the best of all cells to the left, each with its gap costs
            score = np.maximum.accumulate(new - ramp, axis=1) + ramp
            np.maximum(best, score.max(axis=1), out=best)
        out[part] = best
        lo = hi
    return out


def item_groups(benchmark: DataFrame, id_column: str, spec: Leak) -> Iterator[Items]:
    """The test items in groups of about GROUP_WORDS words, in the order of their ids."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(id_column, "text").orderBy(id_column, "text").toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1] or "") // 5
        if size >= GROUP_WORDS:
            yield Items.of(ids, texts, spec)
            ids, texts, size = [], [], 0
    if ids:
        yield Items.of(ids, texts, spec)


def confirmed(items: Items, hashes: np.ndarray, first: np.ndarray, spec: Leak) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, share of the item's own score) of the passages that reach the least score or hold a long part, the best of each row and item."""
    row, item, begin, end = passages(items, hashes, first, spec)
    if not len(row):
        return row, item, np.zeros(0)
    size = np.array([len(items.words[k]) for k in item])
    score = align([hashes[a:b] for a, b in zip(begin, end, strict=True)], [items.words[k] for k in item], spec)
    share = score / (spec.match * size)
    ok = np.flatnonzero((share >= spec.score) | (score >= spec.match * spec.part))
    ok = ok[np.lexsort((-share[ok], item[ok], row[ok]))]
    new = np.ones(len(ok), bool)
    new[1:] = (row[ok][1:] != row[ok][:-1]) | (item[ok][1:] != item[ok][:-1])
    ok = ok[new]
    return row[ok], item[ok], share[ok]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "item_id", spec: Leak | None = None) -> DataFrame:
    """doc_id, item_id, score (alignment with the item as a share of the item's own score) and n_words (the item's) of every document and item whose score reaches the least, or is that of a long part of the item.

    A document that holds an item several times has its best score once. Null and empty texts hold
    nothing, items without words are never found, repeated rows and null doc_ids each have their own
    result rows, and an empty table on either side gives none.
    """
    spec = spec or Leak()
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, `{id_column}` {item_kind}, score double, n_words long"
    out = None
    for items in item_groups(benchmark, id_column, spec):
        sent = docs.sparkSession.sparkContext.broadcast(items)  # about GROUP_WORDS words

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = sent.value
            item_type = pa.array(known.ids).type
            for batch in batches:
                for lo, _, hashes, first in word_hashes(batch.column(1)):
                    row, item, share = confirmed(known, hashes, first, spec)
                    if len(row):
                        ids = pa.array([known.ids[k] for k in item], item_type)
                        size = pa.array([len(known.words[k]) for k in item], pa.int64())
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + row)), ids, pa.array(share), size], names=["doc_id", id_column, "score", "n_words"])

        part = bounded_batches(docs).select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "item_id", spec: Leak | None = None) -> DataFrame:
    """The documents, with all their columns of whatever names, that hold no test item, nor a long part of one.

    Null and empty texts hold nothing and stay; texts are read whole, of any length; repeated rows stay or go
    together, and rows with a null doc_id are judged like any other. An empty benchmark leaves all.
    """
    spec = spec or Leak()
    for items in item_groups(benchmark, id_column, spec):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def keep(texts: pa.Array, sent=sent) -> Iterator[tuple[int, int, np.ndarray]]:
            for lo, hi, hashes, first in word_hashes(texts):
                ok = np.ones(hi - lo, bool)
                ok[confirmed(sent.value, hashes, first, spec)[0]] = False
                yield lo, hi, ok

        docs = keep_rows(docs, keep)
    return docs
