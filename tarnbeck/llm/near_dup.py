"""Near-duplicate documents by MinHash: many universal hash minima with banding, signature verification, exact confirmation, and components by alternating large-star and small-star.

How the work stays bounded when one group holds a large share of all documents:

* texts with equal shingle sets form one class first, by partial aggregation;
* a bucket of classes never yields its pairs: every member is compared with one pivot, so candidates
  are linear in bucket size; signatures drop most of them before any set is read;
* a bucket whose members are then in different components gets other pivots, turn by turn, as long as
  that settles many; most of a large group of near copies becomes one component so;
* what this leaves in different components of one bucket is joined exactly: similar sets must
  share one of their rarest shingles, near the front of both, so only classes that do are compared, and
  only across components. Texts that have a long common part and else differ share no rare shingle, so
  a thousand of them make no candidates;
* a key with many rows, be it a bucket, a pivot, a shingle, the hub of a star or a class of copies, is split:
  there are a few thousand such keys at most, so what goes with them is broadcast, or dealt out under a salt.

No table of links, components or signatures reaches the driver; it sees a few numbers per round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tarnbeck.llm.splits import join_split, sizes, with_side
from tarnbeck.llm.store import Store
from tarnbeck.llm.text import Piece, bounded_batches, grams, mix, pieces, words

#: Rows of a shingle on either side that one task pairs.
BLOCK = 4096
#: Columns of the parities of a set: whether an even or odd number of its shingles falls in each of 256 places.
PARITIES = ("b0", "b1", "b2", "b3")
#: Places that shingles are counted in to tell the rare ones; the counts are broadcast.
PLACES = 1 << 18
#: Share of unsettled rows that a turn of stars may leave for another turn to be worth it.
SETTLED = 0.75
#: Shingles hashed at once.
CHUNK = 1024


@dataclass(frozen=True)
class MinHash:
    """percent: least similarity. bands * rows minima are taken."""

    size: int = 5
    percent: int = 80
    miss: float = 1e-5

    @property
    def layout(self) -> tuple[int, int]:
        """(bands, rows): the longest rows for which a pair at the least similarity escapes all bands with probability `miss` at most, in 256 minima."""
        s = self.percent / 100
        for rows in range(16, 1, -1):
            bands = math.ceil(math.log(self.miss) / math.log1p(-(s**rows)))
            if bands * rows <= 256:
                return bands, rows
        return 128, 2

    @property
    def minima(self) -> int:
        return math.prod(self.layout)

    @property
    def agree(self) -> int:
        """Fewest equal signature bytes of a pair that may be similar: five standard deviations below the mean at the least similarity."""
        s, k = self.percent / 100, self.minima
        return math.floor(k * s - 5 * math.sqrt(k * s * (1 - s)))


@lru_cache
def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_24)
    return rng.integers(0, 1 << 64, n, np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, n, np.uint64)


def shingle_sets(piece: Piece, size: int) -> list[np.ndarray]:
    """Each row's distinct shingles as ascending 64-bit hashes; fewer words than `size` form one shingle."""
    w = words(piece, lower=True)
    keys, at = grams(w.hash, w.first, size)
    first = np.searchsorted(at, w.first)
    out = []
    for k in range(len(piece)):
        lo, hi = first[k], first[k + 1]
        if hi > lo:
            out.append(np.unique(keys[lo:hi]))
        else:
            few = w.hash[w.first[k] : w.first[k + 1]]
            out.append(mix(np.array([sum((int(h) * (2 * i + 3)) & 0xFFFFFFFFFFFFFFFF for i, h in enumerate(few)) & 0xFFFFFFFFFFFFFFFF], np.uint64)) if len(few) else few)
    return out


def minima(shingles: np.ndarray, n: int) -> np.ndarray:
    """The least values of n multiply-shift hashes."""
    a, b = multipliers(n)
    best = np.full(n, np.iinfo(np.uint64).max)
    for lo in range(0, len(shingles), CHUNK):
        h = np.multiply.outer(a, shingles[lo : lo + CHUNK])
        h += b[:, None]
        np.minimum(best, h.min(axis=1), out=best)
    return best


def _u64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def set_names(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of hashes, which with its size name a set."""
    h1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
    return h1, np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64)


def sketch(docs: DataFrame, spec: MinHash) -> DataFrame:
    """doc_id, n_shingles, h1 and h2 (which name the set), sig (the low bytes of the minima), bands (hashes of the minima of each band)."""
    (bands, rows), n = spec.layout, spec.minima
    weight = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                sets = shingle_sets(piece, spec.size)
                size = np.array([len(s) for s in sets], np.int64)
                h1, h2 = set_names(sets)
                least = np.array([minima(s, n) for s in sets], np.uint64).reshape(len(sets), bands, rows) >> np.uint64(32)
                sig = [x.tobytes() for x in least.astype(np.uint8)]
                band = mix((least * weight).sum(axis=2, dtype=np.uint64))
                band = mix(band + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), _u64(band.ravel()))
                cols = [batch.column(0).slice(piece.lo, len(piece)), pa.array(size), _u64(h1), _u64(h2), pa.array(sig, pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "h1", "h2", "sig", "bands"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sig binary, bands array<long>")


def full_sets(docs: DataFrame, spec: MinHash) -> DataFrame:
    """node (the set's first name) and shingles (the set, ascending) of every text that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(0)):
                sets = [s for s in shingle_sets(piece, spec.size) if len(s)]
                yield pa.RecordBatch.from_arrays([_u64(set_names(sets)[0]), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    return bounded_batches(docs).select("text").mapInArrow(run, "node long, shingles binary")


def similar(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def confirm(pairs: DataFrame, classes: DataFrame | None, sets: DataFrame, spec: MinHash, store: Store) -> DataFrame:
    """Of distinct pairs (u, v) those that are similar: by their signatures in `classes` first, if these are given, then on the full sets."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, sig_u, sig_v = batch.columns
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(batch.num_rows, spec.minima) for c in (sig_u, sig_v))
            keep = pa.array(np.count_nonzero(x == y, axis=1) >= spec.agree)
            yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], names=["u", "v"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, set_u, set_v = batch.columns
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                a, b = np.frombuffer(set_u[k].as_buffer(), np.uint64), np.frombuffer(set_v[k].as_buffer(), np.uint64)
                if 100 * min(len(a), len(b)) >= spec.percent * max(len(a), len(b)):
                    keep[k] = similar(np.int64(len(np.intersect1d(a, b, assume_unique=True))), len(a), len(b), spec.percent)
            yield pa.RecordBatch.from_arrays([u.filter(pa.array(keep)), v.filter(pa.array(keep))], names=["u", "v"])

    rows, close = pairs.count(), pairs
    if classes is not None:
        signed = with_side(with_side(pairs, "u", classes, "sig", rows), "v", classes, "sig", rows)
        close = store.put(bounded_batches(signed).select("u", "v", "sig_u", "sig_v").mapInArrow(agree, "u long, v long").distinct(), "close")
        rows = close.count()
    both = with_side(with_side(close, "u", sets, "shingles", rows), "v", sets, "shingles", rows)
    return store.put(bounded_batches(both).select("u", "v", "shingles_u", "shingles_v").mapInArrow(verify, "u long, v long"), "links")


def place_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall in each of PLACES places by their low bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PLACES, np.int64)
        for batch in batches:
            for s in batch.column(0):
                np.add.at(total, (np.frombuffer(s.as_buffer(), np.uint64) & np.uint64(PLACES - 1)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["place", "n"])

    found = bounded_batches(sets).select("shingles").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(PLACES, np.int64)
    out[found["place"].to_numpy()] = found["n"].to_numpy()
    return out


def prefixes(sets: DataFrame, spec: MinHash) -> DataFrame:
    """node, comp, n (size of the set), b0 to b3 (its parities), token, at: the rarest shingles of each set, of which similar sets must share one, and their place from the rarest on.

    Rare is what falls in a place with a low count. Any one order of all shingles gives the same links;
    this one keeps the groups small.
    """
    sent = sets.sparkSession.sparkContext.broadcast(place_counts(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for batch in batches:
            token, at, size, parity = [], [], [], np.zeros((batch.num_rows, 256), np.uint8)
            for row, s in enumerate(batch.column(2)):
                x = np.frombuffer(s.as_buffer(), np.uint64)
                parity[row] = np.bincount((x >> np.uint64(40) & np.uint64(255)).astype(np.int64), minlength=256) & 1
                order = np.lexsort((x, counts[(x & np.uint64(PLACES - 1)).astype(np.int64)]))
                n = len(x) + spec.percent * len(x) // -100 + 1  # a pair has at least percent of either set in common
                token.append(x[order[:n]])
                at.append(np.arange(n))
                size.append(n)
            rows = np.repeat(np.arange(batch.num_rows), size)
            n = np.array([len(s.as_buffer()) // 8 for s in batch.column(2)], np.int64)
            flat = [np.concatenate([*x, np.zeros(0, t)]) for x, t in ((token, np.uint64), (at, np.int64))]
            bits = np.ascontiguousarray(np.packbits(parity, axis=1)).view(np.int64).reshape(batch.num_rows, 4)[rows]
            cols = [*(batch.column(c).take(pa.array(rows)) for c in (0, 1)), pa.array(n[rows]), *(pa.array(np.ascontiguousarray(b)) for b in bits.T), _u64(flat[0]), pa.array(flat[1])]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "comp", "n", *PARITIES, "token", "at"])

    shape = "node long, comp long, n long, " + ", ".join(f"{b} long" for b in PARITIES) + ", token long, at long"
    return bounded_batches(sets).select("node", "comp", "shingles").mapInArrow(run, shape)


def rare_pairs(sets: DataFrame, spec: MinHash, store: Store) -> DataFrame:
    """(u, v) of different components, of all that may be similar: a superset of the similar pairs of node, comp, shingles.

    Of two similar sets of sizes x <= y, the rarest shingle that both have leaves each at least
    percent / (100 + percent) * (x + y) shingles from there on. So the smaller set must have it near its
    front: such rows are leaders, and a shingle without one makes no pair. The rows of a shingle are
    dealt out in blocks, leaders by rows, so a task pairs BLOCK with BLOCK at most. Two sets differ in at
    least as many shingles as their parities, so these leave out most pairs that are not similar.
    """
    t = F.lit(spec.percent)
    rest = F.col("n") - F.col("at")
    leads = rest * (100 + t) >= 2 * t * F.col("n")
    found = store.put(prefixes(sets, spec).withColumn("leads", leads), "prefixes")
    groups = found.groupBy("token").agg(F.count("*").alias("rows"), F.sum(F.col("leads").cast("long")).alias("leaders"), F.min("comp").alias("a"), F.max("comp").alias("b"))
    groups = groups.filter("rows > 1 and leaders > 0 and a != b").select("token", "rows", F.ceil(F.col("leaders") / BLOCK).cast("int").alias("i_blocks"), F.ceil(F.col("rows") / BLOCK).cast("int").alias("j_blocks"))
    groups = store.put(groups, "groups")
    split = store.put(join_split(found, groups, "token", "rows", *sizes(groups, "rows")), "shared-prefixes")

    def block(blocks: str):
        return F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")

    def every(blocks: str):
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    side = lambda c: [F.col(x).alias(f"{x}_{c}") for x in ("node", "comp", "n", "at", *PARITIES)]
    x = split.filter("leads").withColumn("i", block("i_blocks")).withColumn("j", every("j_blocks")).select("token", "i", "j", *side("x"))
    y = split.withColumn("j", block("j_blocks")).withColumn("i", every("i_blocks")).select("token", "i", "j", *side("y"))
    least = t * (F.col("n_x") + F.col("n_y"))
    fits = (F.col("comp_x") != F.col("comp_y")) & (F.col("n_x") <= F.col("n_y")) & (100 * F.col("n_x") >= t * F.col("n_y"))
    fits &= ((F.col("n_x") - F.col("at_x")) * (100 + t) >= least) & ((F.col("n_y") - F.col("at_y")) * (100 + t) >= least)
    differ = sum((F.bit_count(F.col(f"{b}_x").bitwiseXOR(F.col(f"{b}_y"))) for b in PARITIES[1:]), F.bit_count(F.col("b0_x").bitwiseXOR(F.col("b0_y"))))
    fits &= (F.col("n_x") + F.col("n_y") - differ) * (100 + t) >= 2 * least
    pairs = x.join(y, ["token", "i", "j"]).filter(fits).select(F.least("node_x", "node_y").alias("u"), F.greatest("node_x", "node_y").alias("v")).distinct()
    pairs = store.put(pairs, "rare-pairs")
    store.free(found, groups, split)
    return pairs


def components(edges: DataFrame, store: Store) -> DataFrame:
    """node, comp (its component's smallest node) for the nodes of undirected edges (u, v).

    Alternates large-star and small-star, each a minimum per node joined back to its edges, so that a
    node of any degree is aggregated before the shuffle and its edges are split; stops when a round
    changes nothing. Each round's tables go as soon as the next one has its own.
    """

    def ordered(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()

    def state(df: DataFrame) -> tuple:
        """A checksum that no number of edges makes overflow."""
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(1), "u"))).first())

    edges = store.put(ordered(edges), "edges")
    before = state(edges)
    while before[0]:
        last = edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_split(both, least, "u", "n", 2 * before[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store.put(ordered(large), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        near = join_split(large, least, "u", "n", before[0])
        edges = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = store.put(ordered(edges), "small-star")
        store.free(last, large)
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def near_duplicates(docs: DataFrame, spec: MinHash | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs of characters outside space and U+0009-U+000D, A-Z in lower case; a text's set is its
    distinct shingles. A text of fewer words than a shingle has one, the whole sequence; a null text or
    one without words has none and links with nothing: component_id is its doc_id. component_id is the
    smallest doc_id reachable over similar pairs, and kept tells whether that is the document itself.
    Where rows of one doc_id have several texts, each keeps its own n_shingles, and the links of all of
    them are links of that doc_id. A null doc_id links with nothing, has a null component_id and is kept.
    doc_id must be of an integer type. Other columns play no part. No documents give no rows.
    """
    spec = spec or MinHash()
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError(f"doc_id must be an integer, not {docs.schema['doc_id'].dataType.simpleString()}")
    store = Store(docs.sparkSession, "near-dup")
    feat = store.put(sketch(docs, spec), "sketches")
    key = ["n_shingles", "h1", "h2"]
    named = feat.filter("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy(*key).agg(F.min("doc_id").alias("label"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = store.put(classes.withColumn("node", F.col("h1")), "classes")

    # doc_ids with several texts link these
    ids = named.groupBy("doc_id").agg(F.min("h1").alias("u"), F.max("h1").alias("last"), F.count("*").alias("texts")).filter("u != last")
    ids = store.put(ids, "repeated-ids")
    same_id = join_split(named.select("doc_id", F.col("h1").alias("v")), ids, "doc_id", "texts", *sizes(ids, "texts")).select("u", "v").filter("u != v").distinct()
    same_id = store.put(same_id, "same-id")

    banded = classes.select("node", F.explode("bands").alias("bucket"))
    buckets = store.put(banded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = store.put(join_split(banded, buckets, "bucket", "n", *sizes(buckets, "n")), "members")
    stars = store.put(members.filter("node != pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct(), "stars")

    involved = members.select("node").distinct().join(classes.select("node", "label"), "node").select("label").distinct()
    # merged at every size: what is involved grows with the documents, so no plan may rest on its being small
    texts = docs.select(F.col("doc_id").cast("long").alias("label"), "text").join(involved.hint("merge"), "label", "left_semi")
    sets = store.put(full_sets(texts.dropDuplicates(["label", "text"]), spec), "sets", "uncompressed")  # on the join's own partitioning

    links = confirm(stars, classes, sets, spec, store).unionByName(same_id)
    known = store.put(components(links, store), "known")

    # buckets of three or more whose members are not yet in one component: stars of other members, while they settle many
    last, turn = None, 0
    while True:
        turn += 1
        labelled = members.filter("n > 2").drop("n", "pivot").join(known, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        chosen = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("by"), F.col("node").alias("pivot"), F.col("comp").alias("pivot_comp")))
        unsettled = labelled.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("n"), chosen.alias("star")).filter("a != b")
        unsettled = store.put(unsettled.select("bucket", "n", "star.pivot", "star.pivot_comp"), "unsettled")
        rows, largest = sizes(unsettled, "n")
        if not rows:
            break
        open_rows = join_split(labelled, unsettled, "bucket", "n", rows, largest)
        if last is not None and rows > SETTLED * last:  # the rest by an exact join
            rest = store.put(open_rows.select("node", "comp").distinct(), "rest")
            links = links.unionByName(confirm(rare_pairs(rest.join(sets, "node"), spec, store), None, sets, spec, store))  # few of which signatures would tell apart
            known = store.put(components(links, store), "known")
            break
        last = rows
        pairs = open_rows.filter("comp != pivot_comp").select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v")).distinct()
        links = links.unionByName(confirm(store.put(pairs, "stars"), classes, sets, spec, store))
        known = store.put(components(links, store), "known")

    # a component's smallest doc_id, then that of each class, then of each document
    placed = store.put(known.join(classes.select("node", "label"), "node"), "placed")
    roots = store.put(placed.groupBy("comp").agg(F.min("label").alias("root"), F.count("*").alias("n")), "roots")
    rooted = join_split(placed, roots, "comp", "n", *sizes(roots, "n")).select("node", "root").distinct()
    rooted = store.put(classes.select(*key, "node", "label", "copies").join(rooted, "node", "left").select(*key, "copies", F.coalesce("root", "label").alias("root")), "rooted")
    store.free_but(feat, rooted)
    name = F.struct(*key)
    known_docs = join_split(named.select("doc_id", name.alias("name")), rooted.select(name.alias("name"), "copies", "root"), "name", "copies", *sizes(rooted, "copies"))
    known_docs = known_docs.select("doc_id", F.col("name.n_shingles").alias("n_shingles"), F.col("root").alias("component_id"))
    alone = feat.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = known_docs.unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, spec: MinHash | None = None) -> DataFrame:
    """The documents, with all their columns of whatever names, without those of which a near-duplicate with a smaller doc_id stays.

    Rows of one doc_id stay or go together; rows with a null doc_id, and texts without words that stand
    alone under their doc_id, stay. No documents give none.
    """
    name = "gone"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    gone = near_duplicates(docs, spec).filter(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
