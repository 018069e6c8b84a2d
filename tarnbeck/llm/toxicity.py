"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models of words, one of toxic and one of ordinary documents, each interpolated in three orders: how
often a word follows the one before it, how many distinct words it follows in the class (its continuation count),
and, shared by both, how many distinct words it follows in all documents of the corpus, labelled or not. A
document's evidence is the difference of the two log-likelihoods, normalised by length; a logistic curve fitted to
held-out folds makes it a score.

All expressions of the sample are counted. The discount of an expression is not one constant but what the shared
backoff counts explain of it: of its n documents in a class of c documents, those that its share of all documents
would give by chance, `slack` standard errors above the mean. The documents of a class are no even draw: one
language or one group of near copies may have a larger share of them than of the corpus, which moves all its words
at once, in proportion to their means; so the error has a part `spread` times the mean beside that of chance. At
least that of one document, the discount grows with how common the expression is, so a word that is rare, or about
as frequent as anywhere, falls back on the shared counts, and the evidence comes from what is over-represented in a
class. (With one constant discount, chance differences of the common words drown the few toxic ones; the README
gives the figures.)

An expression in no more documents of a class than the least discount is wholly discounted, whatever the shared
counts are. So these know the other words of the labelled sample, and all that are left are one and the same
unknown word: they are exact numbers over all documents, whose shuffle holds pairs of known words only. What is
broadcast is bounded by the sample: its words and pairs while counting, the telling ones while scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbeck.llm.store import Store
from tarnbeck.llm.text import LOWER, Hasher, Piece, bounded_batches, keep_rows, mix, pieces, spans
from tarnbeck.llm.training import labelled_sample

#: Standard errors above the mean up to which the shared counts explain a word and a pair of words; there are many more pairs, so more of them stand out by chance.
SLACK = (3.0, 5.0)
#: Standard deviation, as a part of the mean, of what the make-up of a class does to the counts of its words.
SPREAD = 1 / 6
#: Words added to a text's length where its evidence is normalised, so that a text without a telling word is the less suspect, the longer it is.
ADDED = 1
#: What a task holds of counts before it hands them on.
HELD = 1 << 21
#: Kinds of rows of the shared counts.
_WORD_DOCS, _PAIR_DOCS, _FOLLOWS, _ROWS = range(4)

#: Bytes of words here: letters, digits, and all parts of characters beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def bigram(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0xD6E8FEB86659FD93) + word)


def befores(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The word before each word; a row's first word follows a mark."""
    out = np.zeros(len(word), np.uint64)
    out[1:] = word[:-1]
    out[first[:-1][first[1:] > first[:-1]]] = 1
    return out


def hashed_words(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and the first word of each row."""
    start, end, first = spans(_WORD[piece.buf], piece.off)
    return Hasher(LOWER[piece.buf])(start, end), first


def expressions(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, bigram hashes, first word of each row). A bigram ends at its word."""
    word, first = hashed_words(piece)
    return word, bigram(befores(word, first), word), first


def place(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where each asked hash lies in the ascending keys, or len(keys)."""
    if not len(keys):
        return np.zeros(len(asked), np.int64)
    at = np.searchsorted(keys, asked)
    at[at == len(keys)] = 0
    return np.where(keys[at] == asked, at, len(keys))


@dataclass
class Counts:
    """An ascending table of hashes and what they count to."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray | None = None) -> Counts:
        keys, at = np.unique(keys, return_inverse=True)
        return cls(keys, np.bincount(at, values, len(keys)).astype(np.float64))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        return np.append(self.values, 0.0)[place(self.keys, keys)]


def in_rows(keys: np.ndarray, first: np.ndarray) -> Counts:
    """In how many rows each key occurs."""
    row = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    _, at = np.unique(mix(keys + row * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return Counts.of(keys[at])


@dataclass
class Shared:
    """Counts over all documents, of the words and pairs of the sample."""

    words: np.ndarray  # ascending
    follows: np.ndarray  # distinct words before each word, and before the unknown one at the end
    word_docs: Counts
    pair_docs: Counts
    docs: float

    def frequency(self, words: np.ndarray) -> np.ndarray:
        """The lowest order: continuation counts over their sum. The unknown word has half a count at least."""
        n = np.append(self.follows[:-1], max(self.follows[-1], 0.5))
        return n[place(self.words, words)] / n.sum()


class ClassModel:
    """Interpolated Kneser-Ney of one class: bigram counts, the class's continuation counts, and the shared ones."""

    def __init__(self, words: np.ndarray, first: np.ndarray, shared: Shared, slack: tuple[float, float] = SLACK, spread: float = 0.0):
        before, n = befores(words, first), len(first) - 1
        pairs = bigram(before, words)
        self.shared = shared
        self.pairs, self.context = Counts.of(pairs), Counts.of(before)
        _, at = np.unique(pairs, return_index=True)
        self.ends = words[at]  # in the order of self.pairs
        self.follows = Counts.of(self.ends)
        self.total = max(self.follows.values.sum(), 1.0)

        def kept(counts: Counts, found: Counts, everywhere: Counts, slack: float) -> Counts:
            """Counts less their discounts."""
            mean = everywhere(counts.keys) * n / max(shared.docs, 1.0)
            explained = mean + slack * np.sqrt(mean + 1 + (spread * mean) ** 2)
            return Counts(counts.keys, counts.values * np.maximum(1 - explained / found(counts.keys), 0))

        self.own_words = kept(self.follows, in_rows(words, first), shared.word_docs, slack[0])
        self.own_pairs = kept(self.pairs, in_rows(pairs, first), shared.pair_docs, slack[1])
        self.free = 1 - self.own_words.values.sum() / self.total  # what falls back on the shared counts
        self.own_after = Counts.of(before[at], self.own_pairs.values)  # by context; pairs are in the order of self.pairs

    def word(self, words: np.ndarray) -> np.ndarray:
        return self.own_words(words) / self.total + self.free * self.shared.frequency(words)

    def probability(self, words: np.ndarray, before: np.ndarray) -> np.ndarray:
        seen = np.maximum(self.context(before), 1)
        return self.own_pairs(bigram(before, words)) / seen + (1 - self.own_after(before) / seen) * self.word(words)

    def telling(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, contexts and pairs with a mass of the class's own, and the words that end such pairs; all others have the shared frequency times `free`."""
        own = self.own_pairs.values > 0
        words = self.own_words.keys[self.own_words.values > 0]
        return np.union1d(words, self.ends[own]), self.own_after.keys[self.own_after.values > 0], self.own_pairs.keys[own]


def known_expressions(classes: list[tuple[np.ndarray, np.ndarray]], slack: tuple[float, float] = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """Words and pairs of words, ascending, in more documents of a class than the least discount: those whose shared counts can matter."""
    words, pairs = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for word, first in classes:
        n = in_rows(word, first)
        words = np.union1d(words, n.keys[n.values > slack[0]])
        n = in_rows(bigram(befores(word, first), word), first)
        pairs = np.union1d(pairs, n.keys[n.values > slack[1]])
    return words, pairs


def unlike(texts: list[np.ndarray]) -> list[np.ndarray]:
    """One text of those with the same least hashed bigram, as copies of one document are no separate evidence."""
    seen, out = set(), []
    for t in texts:
        least = int(mix(bigram(t[:-1], t[1:]) ^ np.uint64(99)).min()) if len(t) > 1 else len(out)
        if least not in seen:
            seen.add(least)
            out.append(t)
    return out


class ToxicityModel:
    """What scoring needs of both class models: their telling words and contexts. Any other word gives the same constant evidence."""

    def __init__(self, toxic: ClassModel, ordinary: ClassModel):
        self.toxic, self.ordinary = toxic, ordinary
        self.words, self.contexts, self.pairs = (np.union1d(a, b) for a, b in zip(toxic.telling(), ordinary.telling(), strict=True))
        self.constant = float(np.log(toxic.free / ordinary.free))
        self.slope, self.middle = 1.0, 0.0

    def compact(self) -> ToxicityModel:
        """The same model with as much of the class models as scoring reads."""
        out = copy(self)
        out.toxic, out.ordinary = self._part(self.toxic), self._part(self.ordinary)
        return out

    def _part(self, model: ClassModel) -> ClassModel:
        part, unknown = copy(model), np.uint64(0)  # no word hashes to it but by chance; its frequency cancels
        part.shared = _Frequencies(self.words, np.append(model.shared.frequency(self.words), model.shared.frequency(np.array([unknown]))))
        for name, keys in (("own_words", self.words), ("own_pairs", self.pairs), ("context", self.contexts), ("own_after", self.contexts)):
            setattr(part, name, Counts(keys, getattr(model, name)(keys)))
        del part.pairs, part.follows, part.ends
        return part

    def evidence(self, word: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Toxic minus ordinary log-likelihood over the number of words, and ADDED more, of each row; 0 without words."""
        before = befores(word, first)
        at = np.flatnonzero((place(self.words, word) < len(self.words)) | (place(self.contexts, before) < len(self.contexts)))
        gain = np.log(self.toxic.probability(word[at], before[at])) - np.log(self.ordinary.probability(word[at], before[at])) - self.constant
        row, n = np.searchsorted(first, at, side="right") - 1, np.diff(first)
        return (np.bincount(row, gain, len(n)) + self.constant * n) / (n + ADDED)

    def scores(self, word: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.evidence(word, first) - self.middle), -30, 30)))


@dataclass
class _Frequencies:
    """Shared frequencies of some words, and of the unknown one at the end."""

    words: np.ndarray
    values: np.ndarray

    def frequency(self, words: np.ndarray) -> np.ndarray:
        return self.values[place(self.words, words)]


def shared_counts(docs: DataFrame, store: Store, words: np.ndarray, pairs: np.ndarray) -> Shared:
    """Counts over all documents for the words and pairs of a sample, both ascending hashes; other words are one unknown word.

    Tasks count documents by word and by pair in arrays as long as the sample's vocabulary, and find
    distinct pairs of words, known or not, in tables of at most HELD entries. A pair is shuffled once a task; what
    reaches the driver is a row per word and pair of the sample.
    """
    sent = docs.sparkSession.sparkContext.broadcast((words, pairs))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = sent.value
        unknown = len(words)
        wide = np.int64(unknown + 2)  # known words, the unknown one, and the mark before a row
        word_docs, pair_docs = np.zeros(unknown + 1, np.int64), np.zeros(len(pairs) + 1, np.int64)
        rows, held, tables = 0, [], []

        def out(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n)], names=["kind", "key", "n"])

        def merge(least: int) -> None:
            if held and sum(map(len, held)) > least:
                tables.append(np.unique(np.concatenate(held)))
                held.clear()
            while len(tables) > 1 and len(tables[-2]) < 4 * len(tables[-1]):
                tables.append(np.union1d(tables.pop(), tables.pop()))

        for batch in batches:
            for piece in pieces(batch.column(0)):
                word, first = hashed_words(piece)
                rows += len(piece)
                row = np.repeat(np.arange(len(piece), dtype=np.int64), np.diff(first))
                at = place(words, word)
                seen = np.unique(row * wide + at) % wide
                np.add.at(word_docs, seen, 1)
                before = np.full(len(at), unknown, np.int64)
                before[1:] = at[:-1]
                before[first[:-1][first[1:] > first[:-1]]] = unknown + 1
                held.append(np.unique(before * wide + at))
                known = np.flatnonzero(at < unknown)
                pair = place(pairs, bigram(befores(word, first)[known], word[known]))
                some = pair < len(pairs)
                seen = np.unique(row[known][some] * np.int64(len(pairs) + 1) + pair[some]) % np.int64(len(pairs) + 1)
                np.add.at(pair_docs, seen, 1)
                merge(1 << 20)
                if sum(map(len, tables)) > HELD:
                    for t in tables:
                        yield out(_FOLLOWS, t, np.zeros(len(t), np.int64))
                    tables.clear()
        merge(0)
        for t in tables:
            yield out(_FOLLOWS, t, np.zeros(len(t), np.int64))
        for kind, n in ((_WORD_DOCS, word_docs[:-1]), (_PAIR_DOCS, pair_docs[:-1])):
            used = np.flatnonzero(n)
            yield out(kind, used, n[used])
        yield out(_ROWS, np.zeros(1, np.int64), np.array([rows]))

    counts = bounded_batches(docs).select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    wide = len(words) + 2
    key = F.when(F.col("kind") == _FOLLOWS, F.col("key") % wide).otherwise(F.col("key"))
    n = F.when(F.col("kind") == _FOLLOWS, F.lit(1)).otherwise(F.col("n"))
    found = store.put(counts.groupBy("kind", key.alias("key")).agg(F.sum(n).alias("n")), "shared").toArrow()  # a row per word and pair of the sample
    kind, key, n = (found[c].to_numpy() for c in ("kind", "key", "n"))

    def dense(which: int, size: int) -> np.ndarray:
        table = np.zeros(size)
        table[key[kind == which]] = n[kind == which]
        return table

    return Shared(words, dense(_FOLLOWS, len(words) + 1), Counts(words, dense(_WORD_DOCS, len(words))), Counts(pairs, dense(_PAIR_DOCS, len(pairs))), float(dense(_ROWS, 1)[0]))


def flat(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All words, and the first word of each text."""
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=first[1:])
    return np.concatenate([*texts, np.zeros(0, np.uint64)]), first


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = 4000, words: int = 1 << 21, at: float = 0.7) -> ToxicityModel | None:
    """Learns class counts from about per_label documents of each class, and shared counts from all documents.

    A sampled document gives its whole text; of a class with more than about `words` words, those documents
    stay whose hashed doc_id falls below a threshold, which bounds the driver's memory. Texts reach the
    driver as hashes of words. Null and empty texts, ids and labels teach nothing; repeated rows and copies
    count once in a class. None if either class has no documents.
    """
    store = Store(docs.sparkSession, "toxicity")
    sample = labelled_sample(docs, labels, label, per_label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(2)):
                word, first = hashed_words(piece)
                rows = [word[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(piece.lo, len(piece)) for c in (0, 1)), pa.array(rows, pa.binary()), pa.array(np.diff(first))], names=["doc_id", "label", "words", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed = store.put(bounded_batches(sample).select("doc_id", F.col("label").cast("int").alias("label"), "text").mapInArrow(run, f"doc_id {kind}, label int, words binary, n long"), "sample")
    classes = []
    for value in (1, 0):
        rows = hashed.filter(F.col("label") == value)
        mean = rows.agg(F.avg("n")).first()[0]
        if mean is None:
            return None
        part = min(1.0, words / max(mean * per_label, 1))
        found = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < int(part * (1 << 20))).select("doc_id", "words").toArrow().to_pylist()  # about `words` words
        found.sort(key=lambda r: (str(r["doc_id"]), r["words"]))
        classes.append(unlike([np.frombuffer(r["words"], np.uint64) for r in found if r["words"]]))
    if not all(classes):
        return None
    parts = [flat(texts) for texts in classes]
    shared = shared_counts(docs, store, *known_expressions(parts))
    store.free_but()

    # evidence on documents that the class counts have not seen, in two folds
    seen: list[tuple[float, int]] = []
    for fold in (0, 1):
        part = ToxicityModel(*(ClassModel(*flat(c[fold::2] or c), shared, spread=SPREAD) for c in classes))
        for value, texts in zip((1, 0), classes, strict=True):
            rest = texts[1 - fold :: 2]
            if rest:
                seen += [(float(x), value) for x in part.evidence(*flat(rest))]
    full = ToxicityModel(*(ClassModel(*p, shared, spread=SPREAD) for p in parts))
    if seen:
        full.slope, full.middle = calibrate(np.array([s[0] for s in seen]), np.array([s[1] for s in seen]), at)
    return full


def calibrate(x: np.ndarray, y: np.ndarray, at: float) -> tuple[float, float]:
    """(slope, middle) of a logistic curve that reaches `at` where the two classes part best, each counted alike."""
    pos, neg = np.sort(x[y == 1]), np.sort(x[y == 0])
    if not len(pos) or not len(neg):
        return 1.0, 0.0
    cuts = np.unique(x)
    cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    miss = np.searchsorted(pos, cuts) / len(pos)
    false = 1 - np.searchsorted(neg, cuts) / len(neg)
    loss = miss + 2 * false
    best = cuts[np.abs(loss - loss.min()) < 1e-9]
    cut = float((best[0] + best[-1]) / 2)
    spread = max(float(np.median(pos) - np.median(neg)), 1e-6)
    slope = 8.0 / spread
    return slope, cut - np.log(at / (1 - at)) / slope


def _scores(piece: Piece, model: ToxicityModel | None) -> np.ndarray:
    return np.zeros(len(piece)) if model is None else model.scores(*hashed_words(piece))


def score(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """doc_id and score (0 to 1, higher for toxic) of each document, by its whole text, of any length.

    Null and empty texts have no evidence for either class and score low; 0 if nothing was learned.
    Null doc_ids and repeated rows each have their row, equal texts equal scores; other columns play no
    part, whatever their names; no documents give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model and model.compact())  # bounded by the sample's vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.lo, len(piece)), pa.array(_scores(piece, sent.value))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def filter_toxic(docs: DataFrame, model: ToxicityModel | None, least: float = 0.7) -> DataFrame:
    """The documents, with all their columns of whatever names, that score below `least`.

    Null and empty texts score as `score` says and stay; without a model every document stays. Repeated
    rows stay or go together; no documents give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model and model.compact())

    def keep(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
        for piece in pieces(texts):
            yield piece.lo, piece.hi, _scores(piece, sent.value) < least

    return keep_rows(docs, keep)
