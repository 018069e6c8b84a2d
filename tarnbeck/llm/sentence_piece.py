"""SentencePiece encoding by suffix-array matching, and decoding.

The pieces of a BPE model never cross white space but for its own runs, so a text is a sequence of
units: a word with the marks before it. The distinct units of a batch are concatenated and indexed by
a suffix array; every piece is binary-searched for the range of suffixes that it begins, which gives
all its occurrences; the occurrences are the edges of a graph over text positions, sorted by position
and relaxed from left to right.

BPE's result is the one path in which every two neighbouring pieces are stable: encoding their
concatenation gives back the two. An edge is therefore relaxed from a position if its piece is stable
after the piece by which the position was reached, and the last stable edge found is kept. Stability
is decided once for each pair of pieces and remembered.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarnbeck.llm.id_table import IdTable
from tarnbeck.llm.text import Hasher, Piece, bounded_batches, concat_ranges, give_back, mix, pieces, spans

MARK = "▁"
#: Units that a worker remembers, and characters of new units that are indexed at once.
REMEMBER, INDEX = 1_000_000, 1 << 18

#: Characters of a long unit that are relaxed by themselves, and more of them that the next part begins with.
WINDOW, OVERLAP = 2048, 256

#: Bytes of text encoded at once.
BATCH = 1 << 20

_coders: dict[str, Coder] = {}


def read_model(path: str) -> tuple[list[tuple[str, float, int]], bool]:
    """(piece, score, type) of each id, and whether a mark is put before a text."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(SentencePieceProcessor(model_file=path).serialized_model_proto())
    spec = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not model.trainer_spec.byte_fallback:
        raise ValueError("a BPE model with byte fallback and identity normalisation is needed")
    return [(p.piece, p.score, p.type) for p in model.pieces], spec.add_dummy_prefix


class Coder:
    """Encodes and decodes with one model."""

    def __init__(self, path: str):
        rows, self.dummy = read_model(path)
        self.pieces = [p for p, _, _ in rows]
        self.rank = {p: -s for p, s, kind in rows if kind == 1}
        self.id = {p: k for k, (p, _, kind) in enumerate(rows) if kind == 1}
        self.unknown = next(k for k, (_, _, kind) in enumerate(rows) if kind == 2)
        self.byte = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(rows) if kind == 6}
        self.control = {k for k, (_, _, kind) in enumerate(rows) if kind in (2, 3)}
        # pieces that encode to themselves; no other ever comes out
        self.usable = sorted((p for p in self.id if len(self._merge(p)) == 1), key=len)
        self.length = np.array([len(p) for p in self.usable])
        self.table = np.zeros((len(self.usable), int(self.length.max())), np.uint32)  # a row of characters for each
        for k, p in enumerate(self.usable):
            self.table[k, : len(p)] = [ord(c) for c in p]
        self.usable_id = np.array([self.id[p] for p in self.usable], np.int64)
        self.pair_keys, self.pair_stable = np.zeros(0, np.int64), np.zeros(0, bool)
        self.units = IdTable(REMEMBER)

    def _merge(self, text: str) -> list[str]:
        """BPE of a short text by its merges: the best-ranked neighbours first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank.get(a + b, np.inf), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))), default=(np.inf, 0))
            if best[0] == np.inf:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def stable(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether pieces stay as they are side by side; -1 stands for the start or a character without a piece."""
        free = (before < 0) | (after < 0)
        keys = np.where(free, -1, before * len(self.pieces) + after)
        at = np.searchsorted(self.pair_keys, keys)
        new = ~free & ((at == len(self.pair_keys)) | (self.pair_keys[np.minimum(at, max(len(self.pair_keys) - 1, 0))] != keys if len(self.pair_keys) else True))
        if new.any():
            if len(self.pair_keys) > 4_000_000:
                self.pair_keys, self.pair_stable = np.zeros(0, np.int64), np.zeros(0, bool)
                return self.stable(before, after)
            learned = np.unique(keys[new])
            texts = ((self.pieces[k // len(self.pieces)], self.pieces[k % len(self.pieces)]) for k in learned.tolist())
            right = np.array([self._stable(a, b) for a, b in texts], bool)
            where = np.searchsorted(self.pair_keys, learned)
            self.pair_keys, self.pair_stable = np.insert(self.pair_keys, where, learned), np.insert(self.pair_stable, where, right)
            at = np.searchsorted(self.pair_keys, keys)
        if not len(self.pair_keys):
            return free
        return free | self.pair_stable[np.minimum(at, len(self.pair_keys) - 1)]

    def _stable(self, a: str, b: str) -> bool:
        return self._merge(a + b) == [a, b]

    def matches(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, id) of all occurrences of pieces in a text of code points, by binary search in its suffix array."""
        order = suffix_array(codes, self.table.shape[1])
        n, wide = len(codes), self.table.shape[1]
        padded = np.concatenate([codes, np.zeros(wide, codes.dtype)])
        possible = np.flatnonzero(np.isin(self.table, np.append(np.unique(codes), 0)).all(axis=1))  # of characters that occur
        table, length, ids = self.table[possible], self.length[possible], self.usable_id[possible]
        lo, hi = np.zeros(len(possible), np.int64), np.full(len(possible), n, np.int64)
        for depth in range(wide):  # narrow each piece's range of suffixes by one more character
            live = np.flatnonzero((length > depth) & (lo < hi))
            if not len(live):
                break
            want, a, b = table[live, depth], lo[live], hi[live]
            for side in ("left", "right"):
                x, y = a.copy(), b.copy()
                while (open_ := x < y).any():
                    mid = (x + y) >> 1
                    seen = padded[order[np.minimum(mid, n - 1)] + depth]
                    below = (seen < want) if side == "left" else (seen <= want)
                    x, y = np.where(open_ & below, mid + 1, x), np.where(open_ & ~below, mid, y)
                if side == "left":
                    lo[live] = x
                else:
                    hi[live] = x
        count = np.maximum(hi - lo, 0)
        at = order[concat_ranges(lo, count)]
        return at, at + np.repeat(length, count), np.repeat(ids, count)

    def _paths(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The path of each unit, all together, in order: unit, begin in the unit, piece (or -1), and the character there."""
        joined = "\0".join(units) + "\0"  # no piece holds the separator
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(u) for u in units])
        first = np.zeros(len(units), np.int64)
        np.cumsum(size[:-1] + 1, out=first[1:])
        begin, end, piece = self.matches(codes)
        covered = np.zeros(len(codes), bool)
        covered[begin[end == begin + 1]] = True
        lone = np.flatnonzero(~covered)  # characters without a piece are edges of their own, separators are none
        lone = lone[~np.isin(lone, first + size)]
        begin, end, piece = np.concatenate([begin, lone]), np.concatenate([end, lone + 1]), np.concatenate([piece, np.full(len(lone), -1)])
        unit = np.searchsorted(first, begin, side="right") - 1
        step = begin - first[unit]
        order = np.argsort(step, kind="stable")
        begin, end, piece, step = begin[order], end[order], piece[order], step[order]
        # relax: at each position of all units at once
        came, last, reached = np.full(len(codes) + 1, -1, np.int64), np.full(len(codes) + 1, -1, np.int64), np.zeros(len(codes) + 1, bool)
        reached[first] = True
        bounds = np.flatnonzero(np.append(True, step[1:] != step[:-1])) if len(step) else np.zeros(0, np.int64)
        bounds = np.append(bounds, len(step))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            on = np.flatnonzero(reached[begin[a:b]]) + a
            on = on[self.stable(last[begin[on]], piece[on])]
            came[end[on]], last[end[on]], reached[end[on]] = begin[on], piece[on], True
        # walk back from the units' ends, all at once
        at, owner, walked = first + size, np.arange(len(units)), []
        live = at > first
        while live.any():
            at, owner = at[live], owner[live]
            walked.append((owner, came[at], last[at]))
            at = came[at]
            live = at > first[owner]
        if not walked:
            return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint32))
        owner, begin, piece = (np.concatenate(x) for x in zip(*walked))
        order = np.lexsort((begin, owner))
        owner, begin, piece = owner[order], begin[order], piece[order]
        return owner, begin - first[owner], piece, codes[begin]

    def _long(self, unit: str) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and their characters of a long unit, from overlapping windows of it.

        A path in which all neighbours are stable is the only one. So where two windows' paths meet at a
        position, with stable pieces on either side, the one may go on as the other. A unit in which
        they meet nowhere is encoded in one go.
        """
        starts = list(range(0, max(len(unit) - OVERLAP, 1), WINDOW))
        windows = [unit[a : a + WINDOW + OVERLAP] for a in starts]
        paths, step = [], max(1, INDEX // (WINDOW + OVERLAP))
        for lo in range(0, len(windows), step):
            owner, begin, piece, code = self._paths(windows[lo : lo + step])
            cuts = np.searchsorted(owner, np.arange(len(windows[lo : lo + step]) + 1))
            paths += [(begin[a:b] + starts[lo + k], piece[a:b], code[a:b]) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
        out, from_ = [], 0
        for k, (begin, piece, code) in enumerate(paths):
            if k + 1 < len(paths):
                begin2, piece2, _ = paths[k + 1]
                _, x, y = np.intersect1d(begin, begin2, assume_unique=True, return_indices=True)
                ok = (x > 0) & (begin[x] > from_)
                x, y = x[ok], y[ok]
                ok = np.flatnonzero(self.stable(piece[x - 1], piece2[y]))
                if not len(ok):
                    _, _, piece, code = self._paths([unit])
                    return piece, code
                to = begin[x[ok[0]]]
            else:
                to = len(unit)
            keep = (begin >= from_) & (begin < to)
            out.append((piece[keep], code[keep]))
            from_ = to
        return tuple(np.concatenate(x) for x in zip(*out))

    def _learn(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encodes units together: their ids, one unit after the other, and how many each has."""
        short = [k for k, u in enumerate(units) if len(u) <= WINDOW + OVERLAP]
        owner, _, piece, code = self._paths([units[k] for k in short]) if short else (np.zeros(0, np.int64), None, np.zeros(0, np.int64), np.zeros(0, np.uint32))
        owner = np.array(short, np.int64)[owner]
        for k, u in enumerate(units):
            if len(u) > WINDOW + OVERLAP:
                piece2, code2 = self._long(u)
                owner, piece, code = np.append(owner, np.full(len(piece2), k)), np.append(piece, piece2), np.append(code, code2)
        order = np.argsort(owner, kind="stable")
        owner, piece, code = owner[order], piece[order], code[order]
        odd = np.flatnonzero(piece < 0)
        if len(odd):  # characters without a piece become the pieces of their bytes
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in code[odd].tolist()]
            times = np.ones(len(piece), np.int64)
            times[odd] = [len(r) for r in raw]
            where = np.repeat(piece < 0, times)
            piece, owner = np.repeat(piece, times), np.repeat(owner, times)
            piece[where] = [self.byte[b] for r in raw for b in r]
        return piece, np.bincount(owner, minlength=len(units))

    def encode(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, one text after the other, and how many each has.

        A unit is a word with the marks before it, of which the text's first has one more; marks at the
        end of a text are a unit of their own. Units are looked up by hash.
        """
        piece = spaced(piece)
        buf, off = piece.buf, piece.off
        start, end, first = spans(buf != 32, off)
        hashes, rows = Hasher(buf)(start, end), np.arange(len(piece))
        row = np.repeat(rows, np.diff(first))
        marks = start - np.append(0, end[:-1]) if len(start) else start
        opens = first[:-1][first[1:] > first[:-1]]
        marks[opens] = start[opens] - off[row[opens]] + self.dummy
        last = off[:-1].copy()  # the end of a text's last word, or its beginning
        full = first[1:] > first[:-1]
        last[full] = end[first[1:][full] - 1]
        tail = np.flatnonzero(off[1:] > last)
        more = off[1:][tail] - last[tail] + (self.dummy & ~full[tail])
        # words and tails in the order of the texts
        at = np.concatenate([end, off[1:][tail]])
        order = np.argsort(at, kind="stable")
        begin = np.concatenate([start, off[1:][tail]])[order]
        at = at[order]
        marks = np.concatenate([marks, more])[order]
        hashes = np.maximum(mix(np.concatenate([hashes, np.zeros(len(tail), np.uint64)])[order] + marks.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), 1)
        self.units.room()
        code = self.units.find(hashes)
        new = np.flatnonzero(code < 0)
        if len(new):
            distinct, where, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            raw, base = buf.tobytes(), self.units.used
            some = new[where]
            texts = [MARK * k + raw[a:b].decode("utf-8", "replace") for k, a, b in zip(marks[some].tolist(), begin[some].tolist(), at[some].tolist(), strict=True)]
            ends = np.cumsum([len(t) + 1 for t in texts])
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + INDEX, side="right")))
                self.units.add(distinct[lo:hi], *self._learn(texts[lo:hi]))
                lo = hi
            code[new] = base + back
        return self.units.ids(code, np.append(np.searchsorted(at, off[:-1], side="right"), len(at)))

    def decode_table(self) -> list[bytes]:
        known = {k: bytes([b]) for b, k in self.byte.items()}
        return [known.get(k, b"" if k in self.control else p.replace(MARK, " ").encode()) for k, p in enumerate(self.pieces)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the mark put before it is taken off, and bytes that are no UTF-8 become U+FFFD."""
        if not hasattr(self, "_decoded"):
            self._decoded = self.decode_table()
        raw = b"".join(map(self._decoded.__getitem__, ids.tolist()))
        if self.dummy and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def spaced(piece: Piece) -> Piece:
    """The piece with spaces in place of the marks that its texts hold themselves."""
    raw = piece.buf.tobytes()
    if MARK.encode() not in raw:
        return piece
    bounds = piece.off.tolist()
    texts = [raw[a:b].replace(MARK.encode(), b" ") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return Piece(piece.lo, piece.hi, np.frombuffer(b"".join(texts), np.uint8), off)


def suffix_array(codes: np.ndarray, least: int = 16) -> np.ndarray:
    """Suffixes in order, as far as `least` characters, those of the longest piece, tell them apart.

    The first ranks pack as many characters as fit into 63 bits; prefix doubling does the rest.
    """
    n = len(codes)
    alphabet, letter = np.unique(codes, return_inverse=True)
    bits = int(len(alphabet)).bit_length()
    width = max(1, 63 // bits)
    letters = np.concatenate([letter.astype(np.int64) + 1, np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        key |= letters[k : k + n]
    while True:
        order = np.argsort(key)
        if width >= least:
            return order
        s = key[order]
        step = np.ones(n, np.int64)
        step[1:] = s[1:] != s[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        after = np.zeros(n, np.int64)
        after[: max(n - width, 0)] = rank[width:]
        key = rank * (n + 1) + after
        width *= 2


def coder(path: str) -> Coder:
    return _coders.get(path) or _coders.setdefault(path, Coder(path))


def encode_documents(docs: DataFrame, model: str, keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id and `keep` columns, then ids (array of int, if asked for), n_tokens, ids_crc32 (of little-endian unsigned 32-bit integers) and round_trip (whether decoding gives the text back).

    Null and empty texts have no ids and decode to the empty text. A text that holds the white-space
    mark itself decodes with spaces in its place, so round_trip is false there. Texts of any length are
    encoded whole. Repeated rows and null doc_ids are encoded alike; columns that are not kept play no
    part; no documents give no rows.
    """
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = coder(model)
        for batch in batches:
            names, text = batch.schema.names[:-1], batch.column(batch.num_columns - 1)
            for piece in pieces(text, BATCH):
                raw, bounds = piece.buf.tobytes(), piece.off.tolist()
                texts = [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                ids, size = coded.encode(piece)
                ends = np.cumsum(size)
                parts = [ids[a:b] for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]
                crc = [zlib.crc32(p.astype("<u4").tobytes()) for p in parts]
                back = [coded.decode(p) == t.decode() for p, t in zip(parts, texts, strict=True)]
                cols = [batch.column(k).slice(piece.lo, len(piece)) for k in range(len(names))]
                if with_ids:
                    offsets = np.zeros(len(size) + 1, np.int32)
                    offsets[1:] = ends
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32())))
                cols += [pa.array(size), pa.array(crc, pa.int64()), pa.array(back)]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *(["ids"] if with_ids else []), "n_tokens", "ids_crc32", "round_trip"])
            give_back()

    columns = ["doc_id", *(c for c in keep if c not in ("doc_id", "text"))]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    schema += (", ids array<int>" if with_ids else "") + ", n_tokens long, ids_crc32 long, round_trip boolean"
    return bounded_batches(docs).select(*columns, "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of documents given as doc_id and ids.

    Null and empty ids give an empty text; an id that the model does not have raises. Null doc_ids and
    repeated rows each have their row; other columns play no part; no documents give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = coder(model)
        for batch in batches:
            texts = [coded.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return bounded_batches(encoded).select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
