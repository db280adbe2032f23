"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are made per text in Python batches (one XXH64 per word shingle). Distinct
fingerprints are then dealt to buckets: of ``blocks`` runs of bits, two fingerprints within
``max_bits`` differ in at most ``max_bits`` runs, so they agree on some ``blocks - max_bits`` runs
together, and every choice of so many runs is a bucket key. A bucket over ``bucket_rows`` is cut
into parts and every pair of parts becomes a bucket of its own.

Inside a bucket the fingerprints are sorted by Gray rank, and a tree is built over the order: a
node stands for a run of neighbours and keeps the bits they all share (mask and pattern). Two
nodes are compared on the bits that both share; these differences only add up on the way down, so
a pair of nodes beyond ``max_bits`` is dropped with everything below it. A bucket gives at most one
link per fingerprint (a spanning forest), never all pairs of a group.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from .rows import components, content_key, fresh, keep, numbered, pick

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FANOUT = 8
SEED = 42
FLUSH = 400_000


def shingle_hashes(text: bytes, width: int) -> Iterator[list[int]]:
    """Hashes of the space-joined word shingles of a lower-cased text, in bounded lists."""
    words = text.split()
    if not words:
        return
    if len(words) <= width:
        yield [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    for at in range(0, len(words) - width + 1, FLUSH):
        a = starts[at : min(at + FLUSH, len(words) - width + 1)]
        b = ends[at + width - 1 : at + width - 1 + len(a)]
        yield [digest(line[i:j], SEED) for i, j in zip(a.tolist(), b.tolist())]


def fingerprints_of(texts: list[bytes], width: int) -> np.ndarray:
    """One 64-bit fingerprint per text; a bit is set if more than half the hashes have it."""
    ones, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    values: list[int] = []
    owners: list[tuple[int, int]] = []

    def flush() -> None:
        if values:
            bits = np.unpackbits(np.array(values, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at = [s for _, s in owners]
            np.add.at(ones, [i for i, _ in owners], np.add.reduceat(bits, at, axis=0, dtype=np.int64))
            values.clear(), owners.clear()

    for i, text in enumerate(texts):
        for hashes in shingle_hashes(text.lower(), width):
            owners.append((i, len(values)))
            values += hashes
            total[i] += len(hashes)
            if len(values) >= FLUSH:
                flush()
    flush()
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(row, doc_id, key, fp): the fingerprint of every row as a signed 64-bit number, and a key of id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            fp = fingerprints_of(texts, width).view(np.int64) if texts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("key"), pa.array(fp)], names=["row", "doc_id", "key", "fp"]
            )

    rows = numbered(pick(docs, doc_id=id_col, text=text_col))
    kind = dict(rows.dtypes)["doc_id"]
    rows = rows.select("row", "doc_id", content_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    return rows.mapInArrow(run, f"row long, doc_id {kind}, key string, fp long")


def gray_rank(fp: Column) -> Column:
    """Place of a fingerprint in Gray order: each bit is the parity of the bits from it upwards."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def bucket_masks(blocks: int, max_bits: int) -> list[int]:
    """The masks of all choices of blocks - max_bits runs of bits, as signed numbers."""
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    runs = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    masks = [sum(c) for c in combinations(runs, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


class Forest:
    """A Gray-ordered tree per group over sorted fingerprints, and the links it finds."""

    def __init__(self, fps: np.ndarray, group_starts: np.ndarray, max_bits: int):
        self.fps, self.max_bits = fps, max_bits
        self.label = np.arange(len(fps))
        sizes = np.diff(np.append(group_starts, len(fps)))
        self.first = [np.arange(len(fps) + 1)]  # per level: first child of each node, and the end
        self.mask = [np.full(len(fps), np.uint64(2**64 - 1))]
        self.pattern = [fps]
        while sizes.max(initial=0) > 1:
            n = -(-sizes // FANOUT)
            base = np.cumsum(sizes) - sizes
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            first = np.repeat(base, n) + within * FANOUT
            below_mask, below = self.mask[-1], self.pattern[-1]
            both = np.bitwise_and.reduceat(below_mask, first)
            differ = np.bitwise_or.reduceat(below, first) ^ np.bitwise_and.reduceat(below, first)
            self.mask.append(both & ~differ)
            self.pattern.append(np.bitwise_and.reduceat(below, first) & self.mask[-1])
            self.first.append(np.append(first, len(below)))
            sizes = n

    def link(self) -> np.ndarray:
        """For each row, the first row of its part of the group."""
        top = len(self.mask) - 1
        roots = np.arange(len(self.mask[top]))
        work = [(top, roots, roots)]
        while work:
            level, a, b = work.pop()
            far = np.bitwise_count((self.pattern[level][a] ^ self.pattern[level][b]) & self.mask[level][a] & self.mask[level][b])
            a, b = a[far <= self.max_bits], b[far <= self.max_bits]
            if level == 0:
                self._join(a, b)
                continue
            first = self.first[level]
            for at in range(0, len(a), 20_000):
                work.append((level - 1, *self._children(first, a[at : at + 20_000], b[at : at + 20_000], level == 1)))
        return self.label

    @staticmethod
    def _children(first, a, b, leaf):
        na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
        n = na * nb
        pair = np.repeat(np.arange(len(a)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j = first[a][pair] + k // nb[pair], first[b][pair] + k % nb[pair]
        good = (i < j) if leaf else (i <= j)
        return i[good], j[good]

    def _join(self, a, b):
        label = self.label
        while True:
            x, y = label[a], label[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label != label[label]).any():
                label[:] = label[label]


def _forest_links(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket, then Gray rank; whole buckets are linked together in bounded lots."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0

        def linked(key, part, fp) -> Iterator[pa.RecordBatch]:
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
            size = np.diff(np.append(new, len(fp)))
            live = np.repeat(size > 1, size)
            fp, size = fp[live], size[size > 1]
            if len(fp):
                label = Forest(fp.view(np.uint64), np.cumsum(size) - size, max_bits).link()
                out = np.flatnonzero(label != np.arange(len(fp)))
                yield pa.RecordBatch.from_arrays([pa.array(fp[out]), pa.array(fp[label[out]])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part", "fp")))
            rows += batch.num_rows
            if rows >= 200_000:
                key, part, fp = (np.concatenate(x) for x in zip(*held))
                last = int(np.flatnonzero((key != key[-1]) | (part != part[-1]))[-1]) + 1 if ((key != key[-1]) | (part != part[-1])).any() else 0
                if last:
                    yield from linked(key[:last], part[:last], fp[:last])
                held = [(key[last:], part[last:], fp[last:])]
                rows = len(fp) - last
        if held:
            yield from linked(*(np.concatenate(x) for x in zip(*held)))

    return run


def links(fps: DataFrame, max_bits: int = 4, blocks: int = 6, bucket_rows: int = 32_768) -> DataFrame:
    """Links (a, b) that connect all fingerprints of ``fps`` (distinct ``fp``) within ``max_bits``."""
    masks = bucket_masks(blocks, max_bits)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(masks)])).alias("c")).select(
        "fp", F.xxhash64("c.i", F.col("fp").bitwiseAND(F.col("c.m"))).alias("key")
    )
    hot = keyed.groupBy("key").count().where(F.col("count") > bucket_rows).select(
        "key", F.ceil(F.col("count") * 2 / bucket_rows).cast("int").alias("cuts")
    )
    own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    # A row of a cut bucket goes to every pair of parts that holds its own.
    parts = F.when(F.col("cuts").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.coalesce(F.col("cuts"), F.lit(1)) - 1), lambda j: F.least(j, own) * F.col("cuts") + F.greatest(j, own))
    )
    dealt = keyed.join(hot, "key", "left").select("key", F.explode(parts).alias("part"), "fp", gray_rank(F.col("fp")).alias("rank"))
    sorted_ = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "rank")
    return sorted_.select("key", "part", "fp").mapInArrow(_forest_links(max_bits), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bits: int = 4,
    blocks: int = 6, bucket_rows: int = 32_768,
) -> DataFrame:
    """One row per row of ``docs``: its id, fingerprint (16 hex digits) and component_id.

    Fingerprints link at ``max_bits`` or fewer differing bits; component_id is the smallest id
    reachable over links. A NULL or empty text has fingerprint zero and links like any other; a
    NULL id keeps its row and counts for no minimum (a component of NULL ids has a NULL
    component_id). Repeated rows give repeated results; an empty table gives none.

    Equal fingerprints are merged before any search, so exact copies cost one row, and the table
    of (row, id, fingerprint) is kept in the shared folder: texts are read once.
    """
    prints = keep(fingerprints(docs, id_col, text_col, width))
    rooted = _rooted(prints, max_bits, blocks, bucket_rows)
    least = rooted.groupBy("root").agg(F.min(F.col("first.doc_id")).alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _rooted(prints: DataFrame, max_bits: int, blocks: int, bucket_rows: int) -> DataFrame:
    """(fp, root, first): distinct fingerprints with their component and their first document (NULL ids last)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")
    groups = keep(prints.groupBy("fp").agg(first))
    roots = components(links(groups.select("fp"), max_bits, blocks, bucket_rows))
    return groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )


def without_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bits: int = 4,
    blocks: int = 6, bucket_rows: int = 32_768,
) -> DataFrame:
    """``docs`` with one document per component: that of the smallest id (of NULL ids and repeated rows, one)."""
    prints = keep(fingerprints(docs, id_col, text_col, width))
    rooted = _rooted(prints, max_bits, blocks, bucket_rows)
    (key,) = fresh(docs, "_key")
    stay = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias(key))
    keyed = docs.withColumn(key, content_key(F.col(id_col), F.col(text_col)))
    return keyed.join(stay, key, "left_semi").dropDuplicates([key]).select(docs.columns)
