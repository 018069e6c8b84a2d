"""Quality by Bradley-Terry ranking: scores learned from preference pairs, then a threshold by score quantile.

A document of label 1 is preferred to one of label 0. The scores are linear in features of the whole
text; the chance that one document beats another is the logistic of the difference of their scores,
so the weights are fitted by logistic loss on differences of features of a bounded sample. The threshold
is a quantile of the scores of all documents, taken from a histogram of them: of 512 quantiles, the one
below which rejecting documents agrees best with the sample's labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbeck.llm.quality_rules import later, per_row, repeated
from tarnbeck.llm.text import Hasher, Piece, bounded_batches, grams, keep_rows, mix, pieces, spans, words
from tarnbeck.llm.training import labelled_sample

#: Levels of the quantiles among which the threshold lies.
LEVELS = np.linspace(0, 1, 513)

FEATURES = [
    "log_words", "few_words", "word_chars", "long_words", "distinct_words", "symbols", "bars", "marks", "stops", "digits", "upper", "upper_words",
    "short_lines", "line_words", "dup_lines", "dup_trigrams", "dup_pentagrams", "punctuated_words", "braces", "wide",
]


def _classes(*groups: bytes) -> list[np.ndarray]:
    out = []
    for g in groups:
        t = np.zeros(256, bool)
        t[list(g)] = True
        out.append(t)
    return out


_SYMBOL, _BAR, _MARK, _STOP, _DIGIT, _UPPER, _BRACE, _ALNUM = _classes(
    b"#*$%&<>@^~=+_\\", b"|", b"!?", b".,;:", b"0123456789", bytes(range(65, 91)), b"{}[]()", bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
)


def features(piece: Piece) -> np.ndarray:
    """A row of FEATURES for each text; a text without words has zeros and few_words 1."""
    w, rows, buf, off = words(piece, lower=True), len(piece), piece.buf, piece.off
    row, n = w.row(), np.diff(w.first).astype(float)
    salt = mix(np.arange(1, rows + 1, dtype=np.uint64))
    per = lambda at, weights=None: np.bincount(at, weights, rows)[:rows] if len(at) else np.zeros(rows)
    size = (w.end - w.start).astype(float)
    chars, some = np.maximum(per(row, size), 1), np.maximum(n, 1)
    count = lambda table: per_row(np.flatnonzero(table[buf]), off)

    keys = w.hash ^ salt[row] if len(row) else w.hash
    again = later(keys, repeated(keys))
    ends_odd = per(row[~_ALNUM[buf[w.end - 1]]]) if len(row) else np.zeros(rows)
    ups = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_UPPER[buf], out=ups[1:])
    shout = per(row[(ups[w.end] - ups[w.start] >= 2)]) if len(row) else np.zeros(rows)

    l_start, l_end, _ = spans(buf != 10, off)
    l_words = np.searchsorted(w.start, l_end) - np.searchsorted(w.start, l_start)
    full = l_words > 0
    l_start, l_end, l_words = l_start[full], l_end[full], l_words[full]
    l_row = np.searchsorted(off, l_start, side="right") - 1
    lines = np.maximum(per(l_row), 1)
    l_keys = Hasher(buf)(l_start, l_end) ^ salt[l_row] if len(l_row) else np.zeros(0, np.uint64)
    l_again = later(l_keys, repeated(l_keys))

    def dup(k: int) -> np.ndarray:
        g, at = grams(w.hash, w.first, k)
        if not len(at):
            return np.zeros(rows)
        g = g ^ salt[row[at]]
        return per(row[at[later(g, repeated(g))]]) / some

    wide = per_row(np.flatnonzero(buf >= 0x80), off)
    cols = [
        np.log1p(n), n < 20, per(row, size) / some, per(row[size > 20]) / some, 1 - per(row[again]) / some, count(_SYMBOL) / some, count(_BAR) / some, count(_MARK) / some, count(_STOP) / some,
        count(_DIGIT) / chars, count(_UPPER) / chars, shout / some, per(l_row[l_words < 4]) / lines, np.log1p(n / lines), per(l_row[l_again]) / lines, dup(3), dup(5), ends_odd / some, count(_BRACE) / some, wide / chars,
    ]
    out = np.stack([np.asarray(c, float) for c in cols], axis=1)
    out[n == 0] = 0
    out[n == 0, 1] = 1
    return out


@dataclass
class RankModel:
    """score(x) = weight . ((x - mean) / scale); at `threshold` the logistic score is `at`."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float
    at: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.threshold) + np.log(self.at / (1 - self.at))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, at: float, pairs: int = 40_000, ridge: float = 1e-3) -> RankModel:
    """Bradley-Terry weights by Newton's method on `pairs` random preference pairs, then the threshold.

    The threshold lies between two quantiles of these rows' scores and gives the fewest labels of either value
    on its wrong side, each side's errors counted as a share of its label.
    """
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    good, bad, rng = np.flatnonzero(y == 1), np.flatnonzero(y == 0), np.random.default_rng(0)
    if not len(good) or not len(bad):
        flat = 1.0 if len(good) else 0.0
        return RankModel(mean, scale, np.zeros(x.shape[1]), 0.0, min(max(flat, 1e-6), 1 - 1e-6), 1.0)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # the chance that the model gives to the wrong order
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), d.T @ p / pairs - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    model = RankModel(mean, scale, w, 0.0, at, 1.0)
    return place(model, z @ w, y, np.quantile(z @ w, LEVELS))


def place(model: RankModel, s: np.ndarray, y: np.ndarray, quantiles: np.ndarray) -> RankModel:
    """The model with its threshold between two of these quantiles, where the fewest of the sample's scores s are on the wrong side of their labels y."""
    cuts = (quantiles[1:] + quantiles[:-1]) / 2
    wrong = np.array([(s[y == 0] >= c).mean() + 2 * (s[y == 1] < c).mean() for c in cuts])  # losing a good document counts double
    best = float(cuts[wrong <= wrong.min() + 1e-12].mean())
    return replace(model, threshold=best, slope=2.0 / (np.median(np.abs(s - best)) + 1e-6))


def corpus_quantiles(docs: DataFrame, model: RankModel, s: np.ndarray) -> np.ndarray:
    """LEVELS of the scores of all documents, each rounded to the next of the sample's scores s: a count per such score and task is all that is shuffled."""
    edges = np.unique(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(edges) + 1, np.int64)
        for batch in batches:
            for piece in pieces(batch.column(0)):
                total += np.bincount(np.searchsorted(edges, model.raw(features(piece))), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["edge", "n"])

    found = bounded_batches(docs).select("text").mapInArrow(run, "edge long, n long").groupBy("edge").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(len(edges) + 1, np.int64)
    n[found["edge"].to_numpy()] = found["n"].to_numpy()
    below = np.cumsum(n)
    return edges[np.minimum(np.searchsorted(below, LEVELS * below[-1]), len(edges) - 1)]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", at: float = 0.3, per_label: int = 4000) -> RankModel | None:
    """Learns the weights from about per_label labelled documents of each value, and takes the threshold from the scores of all documents.

    None if there are no labelled documents. Null and empty texts are texts without words; null ids and
    labels teach nothing; repeated rows count as often as they are there. The texts stay on the executors.
    """
    sample = labelled_sample(docs, labels, label, per_label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(2)):
                x = features(piece)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(piece.lo, len(piece)) for c in (0, 1)), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = bounded_batches(sample).select("doc_id", F.col("label").cast("int").alias("label"), "text").mapInArrow(run, f"doc_id {kind}, label int, x array<double>").collect()
    found.sort(key=lambda r: (str(r["doc_id"]), r["label"], r["x"]))
    if not found:
        return None
    x, y = np.array([r["x"] for r in found]), np.array([r["label"] for r in found])
    model = fit(x, y, at)
    if not model.weight.any():
        return model
    s = model.raw(x)
    return place(model, s, y, corpus_quantiles(docs, model, s))


def score(docs: DataFrame, model: RankModel | None) -> DataFrame:
    """doc_id and score (0 to 1, higher for better) of each document, by its whole text, of any length; 1 if nothing was learned.

    Null and empty texts are scored as texts without words. Null doc_ids and repeated rows each have their
    row, equal texts equal scores; other columns play no part; no documents give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                s = model.scores(features(piece)) if model is not None else np.ones(len(piece))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.lo, len(piece)), pa.array(s)], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def filter_quality(docs: DataFrame, model: RankModel | None, least: float = 0.3) -> DataFrame:
    """The documents, with all their columns of whatever names, that score at least `least`; all if nothing was learned.

    Null and empty texts are judged as texts without words. Repeated rows stay or go together; no documents give none.
    """

    def keep(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
        for piece in pieces(texts):
            yield piece.lo, piece.hi, model.scores(features(piece)) >= least if model is not None else np.ones(len(piece), bool)

    return keep_rows(docs, keep)
