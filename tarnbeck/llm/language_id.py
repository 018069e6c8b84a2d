"""Language identification by string kernel: blended-spectrum presence kernels, Nyström landmarks, one-versus-rest kernel ridge regression.

A text's spectrum is the set of its n-grams of letters, n from 1 to 4, over lower-cased words with a
mark at either end, hashed into BUCKETS places. The kernel of two texts is the size of the spectra's
intersection over the geometric mean of their sizes. Landmarks are labelled texts from a bounded
sample; a batch of texts is scored by two matrix products, with the landmarks and with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbeck.llm.text import bounded_batches, mix, pieces
from tarnbeck.llm.training import labelled_sample

BUCKETS = 1 << 13
LENGTHS = (1, 2, 3, 4)
#: Texts to a batch of matrix products.
ROWS = 256

#: Bytes of letters: a-z and all parts of characters beyond ASCII.
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def spectra(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row, presence matrix of 0 and 1) for successive rows of a text column.

    Whole texts count, whatever their length. Bytes that are no letters become one mark.
    """
    lowered = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    for piece in pieces(lowered, 1 << 20):
        for lo in range(0, len(piece), ROWS):
            hi = min(lo + ROWS, len(piece))
            off = piece.off[lo : hi + 1] - piece.off[lo]
            buf = piece.buf[piece.off[lo] : piece.off[hi]]
            out = np.zeros((hi - lo) * BUCKETS, np.float32)
            if len(buf):
                letter = _LETTER[buf]
                value = np.where(letter, buf, 0).astype(np.uint32)
                row = np.repeat(np.arange(hi - lo, dtype=np.int64), np.diff(off)) * BUCKETS
                last = np.repeat(off[1:], np.diff(off))
                code = np.zeros(len(buf), np.uint32)
                for n in range(1, max(LENGTHS) + 1):
                    size = len(buf) - n + 1
                    if size <= 0:
                        break
                    code = code[:size] * np.uint32(257) + value[n - 1 :]
                    # a window starts in a letter or right before one, and stays in its row
                    ok = np.flatnonzero(letter[:size] if n == 1 else (letter[:size] | letter[1 : size + 1]) & (last[:size] >= np.arange(n, size + n)))
                    h = mix(code[ok].astype(np.uint64) + np.uint64(n << 40))
                    out[row[ok] + (h & np.uint64(BUCKETS - 1)).astype(np.int64)] = 1
            yield piece.lo + lo, piece.lo + hi, out.reshape(hi - lo, BUCKETS)


@dataclass
class KernelModel:
    """langs in order; landmarks (BUCKETS, m), scaled to the kernel; weights (m, langs)."""

    langs: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, present: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.maximum(present.sum(axis=1, keepdims=True), 1))
        return (present @ self.landmarks) / norm @ self.weights


def fit(present: np.ndarray, langs: list[str], landmarks: int, ridge: float) -> KernelModel:
    """Nyström kernel ridge regression. Landmarks are dealt out evenly over the languages, in the order given."""
    names = sorted(set(langs))
    places = {x: [k for k, y in enumerate(langs) if y == x] for x in names}
    picked: list[int] = []
    for depth in range(max(map(len, places.values()))):
        picked += [places[x][depth] for x in names if depth < len(places[x])]
    picked = picked[:landmarks]
    norm = np.sqrt(np.maximum(present.sum(axis=1, keepdims=True), 1))
    unit = present / norm
    marks = unit[picked].T.astype(np.float32)
    k = (unit @ marks).astype(np.float64)
    values, vectors = np.linalg.eigh(k[picked])
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    phi = k @ root
    target = np.array([[1.0 if y == x else -1.0 for x in names] for y in langs])
    weight = np.sqrt(np.array([1 / len(places[y]) for y in langs]))[:, None]  # languages count alike
    a = phi * weight
    beta = np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ (target * weight))
    return KernelModel(names, marks, (root @ beta).astype(np.float32))


def train(docs: DataFrame, per_lang: int = 400, landmarks: int = 128, ridge: float = 1e-3) -> KernelModel | None:
    """Learns from text and lang of the rows given: at most about per_lang of each language. Null languages and texts are left out."""
    known = docs.filter("lang is not null and text is not null")
    sample = labelled_sample(known, known.select("doc_id", "lang"), "lang", per_lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, present in spectra(batch.column(1)):
                bits = np.packbits(present.astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([b.tobytes() for b in bits], pa.binary())], names=["lang", "bits"])

    found = bounded_batches(sample).select(F.col("label").cast("string").alias("lang"), "text").mapInArrow(run, "lang string, bits binary").collect()  # about per_lang rows of a kilobyte for each language
    if not found:
        return None
    found.sort(key=lambda r: (r["lang"], bytes(r["bits"])))
    order = np.random.default_rng(0).permutation(len(found))
    present = np.array([np.unpackbits(np.frombuffer(found[k]["bits"], np.uint8)) for k in order], np.float32)
    return fit(present, [found[k]["lang"] for k in order], landmarks, ridge)


def predict(docs: DataFrame, model: KernelModel | None) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) for each document.

    A null text, or one without a letter, is `und` with score 0; so is every text if nothing was learned.
    Ties go to the first language by name. Repeated rows and null doc_ids are scored alike.
    """
    sharp = 6.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lettered = pc.fill_null(pc.match_substring_regex(batch.column(1), r"\p{L}"), False)
            for lo, hi, present in spectra(batch.column(1)):
                has = lettered.slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                names, score = np.full(hi - lo, "und", object), np.zeros(hi - lo)
                if model is not None:
                    s = model.scores(present).astype(np.float64)
                    best = s.argmax(axis=1)
                    e = np.exp(sharp * (s - s.max(axis=1, keepdims=True)))
                    names[has] = np.array(model.langs, object)[best[has]]
                    score[has] = (1 / e.sum(axis=1))[has]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
