"""Token ids as files: tokenise, count, lay out in document order, and code in range-ANS blocks.

The file format is a folder of two tables: `table`, one row with the shared frequency table and the place of
each range's first id in the whole output; and `blocks`, a row per block with its range of doc_ids, its number
of ids, its documents (ids, lengths), the place of its first id in the range, a checksum and the coded payload
(rans.py). Ranges and their blocks are in ascending order of doc_id, and each block can be decoded alone.
Parquet carries the rows so that Spark's committer handles lost and repeated tasks.

Ids are counted while texts are tokenised. Ranges hold about as many documents each, by Spark's own sample
of the keys; their number grows with the ids, without a limit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.llm.id_table import IdTable
from tarnbeck.llm.rans import Table, checksum, decode, encode
from tarnbeck.llm.store import Store
from tarnbeck.llm.text import LOWER, SPACE, Hasher, Piece, bounded_batches, pieces, spans

#: Ids after which a block ends; it holds whole documents.
BLOCK = 1 << 18
#: Distinct parts of words whose ids a worker remembers.
REMEMBER = 1_000_000
#: Ids to a range of doc_ids, which one task sorts and codes.
RANGE_IDS = 1 << 25

_words: dict[str, WordIds] = {}


def _kinds() -> np.ndarray:
    """Of ASCII bytes: 0 space, 1 letter, 2 digit, 3 other; the first byte of U+00C0 to U+00FF and what follows it count as letters."""
    out = np.full(256, 3, np.uint8)
    out[SPACE] = 0
    out[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    out[48:58] = 2
    return out


_KIND = _kinds()


class WordIds:
    """Ids of whole texts by way of their parts, each of which the tokenizer sees once.

    The tokenizer never joins across ASCII space, nor across the borders of letters, digits and other
    characters. So a word is split at those borders and A-Z lower-cased, if it consists of ASCII and of
    letters from U+00C0 to U+00FF and has neither an apostrophe, which may begin a contraction, nor <,
    which may begin a special token; any other word is a part as it stands. A run of letters goes
    straight to the tokenizer's model. Parts are looked up by
    64-bit hash.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.table = IdTable(REMEMBER)
        # what the tokenizer makes of a letter before its model sees it
        shown = self.tokenizer.pre_tokenizer.pre_tokenize_str
        letters = [*map(chr, range(97, 123)), *(c for c in map(chr, range(0xDF, 0x100)) if c.isalpha())]
        self.letters = str.maketrans({c: "".join(x for x, _ in shown(c)) for c in letters})
        probe = ["tokenizer", "thndedle", "éclair", "straße", "ÉCLAIR", "ÿ", "Ñandú", "a"]
        self.direct = [self._letters(w) for w in probe] == [e.ids for e in self.tokenizer.encode_batch_fast(probe, add_special_tokens=False)]

    def _letters(self, word: str) -> list[int]:
        """Ids of a run of letters from the model itself, without what the tokenizer does to whole texts."""
        return [t.id for t in self.tokenizer.model.tokenize(word.lower().translate(self.letters))]

    def _learn(self, hashes: np.ndarray, parts: list[bytes], letters: np.ndarray) -> None:
        texts = [w.decode("utf-8", "replace") for w in parts]
        got: list[list[int]] = [[]] * len(parts)
        runs = letters & self.direct
        for k in np.flatnonzero(runs).tolist():
            got[k] = self._letters(texts[k])
        others = np.flatnonzero(~runs).tolist()
        for lo in range(0, len(others), 8192):
            some = others[lo : lo + 8192]
            for k, e in zip(some, self.tokenizer.encode_batch_fast([texts[k] for k in some], add_special_tokens=False), strict=True):
                got[k] = e.ids
        self.table.add(hashes, np.fromiter((i for x in got for i in x), np.uint32), np.array([len(x) for x in got]))

    def __call__(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, one text after the other, and how many each has."""
        buf, off = piece.buf, piece.off
        start, end, _ = spans(~SPACE[buf], off)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(piece), np.int64)
        after = np.zeros(len(buf), bool)  # follows the byte that begins U+00C0 to U+00FF, and is neither a multiplication nor a division sign
        after[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] < 0xC0) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
        odd = ((buf >= 0x80) & (buf != 0xC3) & ~after) | (buf == 39) | (buf == 60)
        sums = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(odd, out=sums[1:])
        whole = sums[end] > sums[start]
        kind, shown = _KIND[buf], LOWER[buf]
        if whole.any():
            edge = np.zeros(len(buf) + 1, np.int8)
            edge[start[whole]] += 1
            edge[end[whole]] -= 1
            inside = np.cumsum(edge[:-1], dtype=np.int32) > 0
            kind[inside] = 4
            shown[inside] = buf[inside]
        change = np.ones(len(buf), bool)
        change[1:] = kind[1:] != kind[:-1]
        change[start] = True
        p_start = np.flatnonzero(change & (kind != 0))
        last = np.ones(len(buf), bool)
        last[:-1] = change[1:]
        last[end - 1] = True
        p_end = np.flatnonzero(last & (kind != 0)) + 1
        hashes = np.maximum(Hasher(shown)(p_start, p_end), 1)
        self.table.room()
        code = self.table.find(hashes)
        new = np.flatnonzero(code < 0)
        if len(new):
            distinct, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            raw, at, base = shown.tobytes(), new[first], self.table.used
            self._learn(distinct, [raw[a:b] for a, b in zip(p_start[at].tolist(), p_end[at].tolist(), strict=True)], kind[p_start[at]] == 1)
            code[new] = base + back
        return self.table.ids(code, np.searchsorted(p_start, off))


def tokenise(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, text_crc32 and the ids, with end_id last, as compressed little-endian unsigned 32-bit integers; and at the end of each task a row that has just `counts`, how often each id occurred in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = _words.get(tokenizer) or _words.setdefault(tokenizer, WordIds(tokenizer))
        squeeze, total = zstandard.ZstdCompressor(level=1), np.zeros(end_id + 1, np.int64)

        def rows(doc, size, sums, packed, counts) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([doc, pa.array(size, pa.int64()), pa.array(sums, pa.int64()), pa.array(packed, pa.binary()), pa.array(counts, pa.binary())], names=names)

        doc_type = None
        for batch in batches:
            doc_type = batch.column(0).type
            for piece in pieces(batch.column(1)):
                raw, bounds = memoryview(piece.buf), piece.off.tolist()
                sums = [zlib.crc32(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                ids, size = words(piece)
                found = np.bincount(ids, minlength=len(total))
                found[: len(total)] += total
                total = found
                total[end_id] += len(piece)
                ends, packed = np.cumsum(size), []
                for lo, hi in zip((ends - size).tolist(), ends.tolist(), strict=True):
                    one = np.empty(hi - lo + 1, "<u4")
                    one[:-1], one[-1] = ids[lo:hi], end_id
                    wide = one.max() > 65535
                    packed.append((b"4" if wide else b"2") + squeeze.compress((one if wide else one.astype("<u2")).tobytes()))
                yield rows(batch.column(0).slice(piece.lo, len(piece)), size + 1, sums, packed, [None] * len(piece))
        if doc_type is not None:
            yield rows(pa.nulls(1, doc_type), [None], [None], [None], [squeeze.compress(total.astype("<i8").tobytes())])

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "text_crc32", "ids", "counts"]
    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, text_crc32 long, ids binary, counts binary")


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed[1:]), "<u4" if packed[:1] == b"4" else "<u2").astype(np.uint32)


def count_ids(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents: the sum of what tasks counted, added up on the executors; a row per id reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                part = np.frombuffer(zstandard.decompress(packed.as_py()), "<i8")
                sums = np.zeros(max(len(total), len(part)), np.int64)
                sums[: len(total)] += total
                sums[: len(part)] += part
                total = sums
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    counted = bounded_batches(tokens).filter("counts is not null").select("counts").mapInArrow(run, "id long, n long")
    found = counted.groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # as many rows as the vocabulary has ids
    out = np.zeros(max(found["id"].to_pylist(), default=0) + 1, np.int64)
    out[found["id"].to_numpy()] = found["n"].to_numpy()
    return out


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, block: int = BLOCK, bits: int = 20, range_ids: int = RANGE_IDS) -> str:
    """Writes the ids of all documents in ascending doc_id order and returns the folder.

    doc_id may be an integer or a text. Null texts count as empty and hold just end_id. Null doc_ids come
    first; rows of one doc_id are ordered by text checksum, and may lie in several ranges; equal rows are
    one as good as the other. Texts of any length are one document. Other columns play no part. No
    documents give an empty output.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    store = Store(spark, "token-files")
    tokens = store.put(tokenise(docs, tokenizer, end_id).withColumn("place", F.monotonically_increasing_id()), "tokens", "uncompressed")
    counts = count_ids(tokens)
    table = Table.of_counts(counts, bits)
    # as many ranges as keep one of them to about range_ids ids, and some more for a small output, so that all cores have work
    ranges = max(1, -(-int(counts.sum()) // range_ids), min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts[end_id] if len(counts) > end_id else 0) // 1000))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc(), F.col("place").asc()]
    laid = tokens.filter("ids is not null").select("doc_id", "text_crc32", "place", "ids").repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    blocks = store.put(_blocks(laid.withColumn("part", F.spark_partition_id()), table, block, kind), "blocks", "uncompressed")

    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).toArrow()  # a row per range
    size = np.zeros(max(sizes["part"].to_pylist(), default=0) + 1, np.int64)
    size[sizes["part"].to_numpy()] = sizes["n"].to_numpy()
    starts = (np.cumsum(size) - size).astype("<i8")
    store.put(spark.createDataFrame([(table.bits, table.freq.astype("<u4").tobytes(), starts.tobytes())], "bits int, freq binary, ranges binary").coalesce(1), "table")
    store.free(tokens)
    return store.path


def _blocks(laid: DataFrame, table: Table, most: int, kind: str) -> DataFrame:
    bits, freq = table.bits, table.freq.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Table(freq, bits)
        part, number, at, size, docs, held = None, 0, 0, 0, [], []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            row = [[part], [number], [at], [len(ids)], [docs.copy()], [[len(x) for x in held]], [checksum(ids)], [encode(ids, coder)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, shape, strict=True)], names=names)

        for batch in batches:
            for doc, packed, p in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if held and (p != part or size >= most):
                    yield flush()
                    number, at, size = number + 1, at + size, 0
                    docs.clear()
                    held.clear()
                if p != part:
                    part, number, at = p, 0, 0
                docs.append(doc)
                held.append(unpack(packed.as_py()))
                size += len(held[-1])
        if held:
            yield flush()

    doc_type = pa.string() if kind == "string" else pa.int64()
    shape = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(doc_type), pa.list_(pa.int64()), pa.int64(), pa.binary()]
    names = ["part", "number", "start", "n_ids", "docs", "lengths", "ids_crc32", "payload"]
    schema = f"part int, number long, start long, n_ids long, docs array<{'string' if kind == 'string' else 'bigint'}>, lengths array<long>, ids_crc32 long, payload binary"
    return bounded_batches(laid).select("doc_id", "ids", "part").mapInArrow(run, schema)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Decodes the blocks in parallel: doc_id, start (in the whole output), n_tokens, ids_crc32 of each document. A block whose checksum differs raises; an empty output has no rows."""
    row = spark.read.parquet(f"{path}/*-table").first()
    blocks = spark.read.parquet(f"{path}/*-blocks")
    bits, freq = row["bits"], np.frombuffer(row["freq"], "<u4").astype(np.int64)
    starts = np.frombuffer(row["ranges"], "<i8")  # a number for some tens of millions of ids
    kind = blocks.schema["docs"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Table(freq, bits)
        for batch in batches:
            for k in range(batch.num_rows):
                n, at, docs, lengths, crc, payload, part = (batch.column(c)[k].as_py() for c in range(7))
                ids = decode(payload, n, coder)
                if checksum(ids) != crc:
                    raise ValueError("a block of token ids is damaged")
                ends = np.cumsum(lengths)
                begin = ends - lengths
                sums = [checksum(ids[a:b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.string() if kind == "string" else pa.int64()), pa.array(starts[part] + at + begin), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # a block holds up to a million bytes; the reader hands a batch of rows to Python at once
    return bounded_batches(blocks).select("n_ids", "start", "docs", "lengths", "ids_crc32", "payload", "part").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
