"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how usual that is.

A text is tokenised whole by both. Offsets where both have a token end right before a token that
begins with a space are anchors; they cut the document into short windows of token ids. How a window
aligns depends on its ids alone, so it is worked out once and remembered by the two id tuples.

Documents are gathered into chunks of a bounded number of windows; a chunk is written as one row of
packed window numbers. Corpus-wide counts of linked pairs come from one aggregate over the distinct
pairs of the chunks. The counts a chunk needs are joined to it by pair, so a pair that all
documents hold is one row per chunk there.
"""

from __future__ import annotations

import hashlib
import sys
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from .pack import Encoder
from .rows import keep, pick, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1 << 20  # windows of a chunk; only a single longer document exceeds it
MEMORY = 500_000  # windows that a worker remembers
LONGEST = 256  # ids of a window that is remembered


class Aligner:
    """Tokenises by a byte-level vocabulary (A, with the space added here) and a piece model (B, which adds it)."""

    def __init__(self, a_path: str, a_pattern: str, b_path: str):
        import sentencepiece

        self.a = Encoder(a_path, a_pattern)
        self.a.tok.encode_special_tokens = True  # their strings inside texts are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [self._entry(i) for i in range(self.a.tok.get_vocab_size())]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = ([len(x) for x in t] for t in (self.a_bytes, self.b_bytes))
        self.a_len, self.b_len = (np.array(x, np.int64) for x in (self.a_size, self.b_size))
        self.a_mark, self.b_mark = (np.array([x[:1] == b" " for x in t]) for t in (self.a_bytes, self.b_bytes))
        # An id as it is written: a token of A, the last one of a group, a token of B, the last one of a group.
        self.words = [f"{i}{end}" for sizes, ends in ((self.a_size, ",|"), (self.b_size, ",;")) for end in ends for i in range(len(sizes))]
        self.memory: dict[tuple[bytes, bytes], tuple[str, bytes]] = {}

    def _entry(self, i: int) -> bytes:
        try:
            return self.a.fast.decode_single_token_bytes(i)
        except KeyError:  # a special token, which no text gives
            return self.a.tok.id_to_token(i).encode()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _encode(self, text: str) -> np.ndarray:
        if text.isascii() and "<|" not in text or not self.a.odd.search(text):
            return self.a.fast.encode_to_numpy(text, disallowed_special=())
        return self.a.encode(text)

    def tokens(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and of B per text; None for NULL and empty ones and where the tokens do not give back the text."""
        for text, b in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1)):
            if not text:
                yield None
                continue
            a = self._encode(" " + text)
            want = (" " + text).encode()
            # The tokens of A are cut out of these bytes, so it is enough that none is missing.
            whole = int(self.a_len[a].sum()) == len(want) and b"".join(map(self.b_bytes.__getitem__, b)) == want
            yield (a, np.array(b, "<u4")) if whole else None

    def windows(self, a: np.ndarray, b: np.ndarray) -> list[tuple[bytes, bytes]]:
        """The ids of both sides between anchors, as bytes."""
        begins = []
        for ids, sizes, mark in ((a, self.a_len, self.a_mark), (b, self.b_len, self.b_mark)):
            size = sizes[ids]
            at = np.flatnonzero(mark[ids][1:]) + 1
            begins.append((at, (np.cumsum(size) - size)[at]))
        (at_a, byte_a), (at_b, byte_b) = begins
        i, j = _shared(byte_a, byte_b)
        cut_a, cut_b = ([0, *(4 * at).tolist(), 4 * n] for at, n in ((at_a[i], len(a)), (at_b[j], len(b))))
        all_a, all_b = a.tobytes(), b.tobytes()
        return [(all_a[p:q], all_b[r:s]) for p, q, r, s in zip(cut_a, cut_a[1:], cut_b, cut_b[1:])]

    def aligned(self, windows: list[tuple[bytes, bytes]]) -> list[tuple[str, bytes]]:
        """The groups of each window as text, and its links, a << 32 | b each."""
        memory = self.memory
        new = [w for w in windows if w not in memory]
        if len(memory) + len(new) > MEMORY:
            memory.clear()
            new = windows
        found = dict(zip(new, self._align(new))) if new else {}
        memory.update((w, x) for w, x in found.items() if len(w[0]) + len(w[1]) <= 4 * LONGEST)
        return [found[w] if w in found else memory[w] for w in windows]

    def _align(self, windows: list[tuple[bytes, bytes]]) -> list[tuple[str, bytes]]:
        """Both sides of all windows end to end: a window ends where both do, so one pass aligns them all."""
        a, b = (np.frombuffer(b"".join([w[side] for w in windows]), "<u4").astype(np.int64) for side in (0, 1))
        ends_a, ends_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        i, j = _shared(ends_a, ends_b)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[i], last_b[j] = 1, 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        n_a, n_b = len(self.a_size), len(self.b_size)
        written_as = np.concatenate([a + n_a * last_a, 2 * n_a + b + n_b * last_b])[order].tolist()
        parts = list(map(self.words.__getitem__, written_as))
        links = (a[i] << 32 | b[j]).astype("<i8").tobytes()
        tokens_a = np.cumsum([len(w[0]) // 4 for w in windows])
        tokens = (tokens_a + np.cumsum([len(w[1]) // 4 for w in windows])).tolist()
        groups = (8 * np.searchsorted(i, tokens_a)).tolist()
        texts = ["".join(parts[p:q])[:-1] for p, q in zip([0, *tokens], tokens)]
        return [(t, links[p:q]) for t, p, q in zip(texts, [0, *groups], groups)]


def _shared(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the numbers that two ascending rows share stand in them."""
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    same = np.flatnonzero(y[at] == x) if len(y) else np.zeros(0, np.int64)
    return same, at[same]


def _packed(values, kind: str) -> bytes:
    return zlib.compress(np.asarray(values, kind).tobytes(), 1)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


class _Chunk:
    """Documents on their way into a row."""

    def __init__(self):
        self.ids, self.n_a, self.n_b, self.groups, self.n_windows = [], [], [], [], []
        self.number: dict[tuple[bytes, bytes], int] = {}
        self.texts: list[str] = []
        self.links: list[bytes] = []
        self.n_links: list[int] = []
        self.windows: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, found, aligner: Aligner, groups: str) -> None:
        self.ids.append(doc_id)
        numbers = []
        if found is not None:
            number, new = self.number, []
            for w in aligner.windows(*found):
                n = number.get(w)
                if n is None:
                    n = number[w] = len(number)
                    new.append(w)
                numbers.append(n)
            for text, links in aligner.aligned(new):
                self.texts.append(text)
                self.links.append(links)
                self.n_links.append(len(links) // 8)
        text = ";".join(map(self.texts.__getitem__, numbers))
        self.groups.append(text if groups == "text" or not text else hashlib.sha256(text.encode()).hexdigest())
        self.n_a.append(0 if found is None else len(found[0]))
        self.n_b.append(0 if found is None else len(found[1]))
        self.n_windows.append(len(numbers))
        self.windows.append(np.array(numbers, "<u4"))
        self.size += len(numbers) + 8

    def row(self, kind: pa.DataType) -> pa.RecordBatch:
        windows = np.concatenate(self.windows)
        n_groups = _stretches(np.array([self.n_links], np.int64)[:, windows], np.array(self.n_windows))[0].tolist()
        lists = [pa.array([self.ids], pa.list_(kind))] + [pa.array([x], pa.list_(pa.int64())) for x in (self.n_a, self.n_b, n_groups, self.n_windows)]
        data = [_packed(windows, "<u4"), zlib.compress(b"".join(self.links), 1), _packed(self.n_links, "<u4")]
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().hex]), *lists, pa.array([self.groups], pa.list_(pa.string())), *[pa.array([x], pa.binary()) for x in data]],
            names=_NAMES,
        )


_NAMES = ["chunk", "ids", "n_a", "n_b", "n_groups", "n_windows", "groups", "windows", "links", "n_links"]
_ALIGNERS: dict[tuple[str, str, str], Aligner] = {}


def chunks(docs: DataFrame, a_path: str, a_pattern: str, b_path: str, groups: str) -> DataFrame:
    """Rows of many documents each: their groups, numbered windows, and the links of every distinct window."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (a_path, a_pattern, b_path)
        aligner = _ALIGNERS.get(key) or _ALIGNERS.setdefault(key, Aligner(*key))
        chunk, of = _Chunk(), pa.null()
        for batch in batches:
            of = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                for doc_id, found in zip(some.column("doc_id").to_pylist(), aligner.tokens(some.column("text").to_pylist())):
                    chunk.add(doc_id, found, aligner, groups)
                    if chunk.size >= CHUNK:
                        yield chunk.row(of)
                        chunk = _Chunk()
        if chunk.ids:
            yield chunk.row(of)

    schema = f"chunk string, ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_windows array<long>, groups array<string>, windows binary, links binary, n_links binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, pair, n): the distinct linked pairs of every chunk and how many links hold them."""
    for batch in batches:
        for row in batch.to_pylist():
            links, n_links = _unpacked(row["links"], "<i8"), _unpacked(row["n_links"], "<u4")
            times = np.bincount(_unpacked(row["windows"], "<u4"), minlength=len(n_links))
            pairs, where = np.unique(links, return_inverse=True)
            n = np.bincount(where, weights=np.repeat(times, n_links), minlength=len(pairs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["chunk"]] * len(pairs), pa.string()), pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], names=["chunk", "pair", "n"]
            )


def pair_counts(uses: DataFrame) -> DataFrame:
    """(pair, a, b, n, best): links of every id pair over all chunks; ``best`` where no pair of the same b has more."""
    total = uses.groupBy("pair").agg(F.sum("n").alias("n"))
    a, b = F.shiftright("pair", 32), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    # A b meets at most the vocabulary of A in one window.
    most = F.max("n").over(Window.partitionBy("b"))
    return total.select("pair", a.alias("a"), b.alias("b"), "n").withColumn("best", F.col("n") == most)


def _stretches(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Row-wise sums of consecutive stretches, empty ones too."""
    sums = np.concatenate([np.zeros((len(values), 1), np.int64), np.cumsum(values, 1)], 1)
    ends = np.cumsum(sizes)
    return sums[:, ends] - sums[:, ends - sizes]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the sums of the counts, and of the best marks, over its links."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in ("n_windows", "windows", "links", "n_links")}
            links, n_links = _unpacked(row["links"], "<i8"), _unpacked(row["n_links"], "<u4").astype(np.int64)
            uses = batch.column("uses")[i].values
            per_link = np.zeros((2, len(links)), np.int64)
            if len(links):
                pairs, n, best = (uses.field(k).to_numpy(zero_copy_only=False) for k in ("pair", "n", "best"))
                order = np.argsort(pairs)
                where = order[np.searchsorted(pairs, links, sorter=order)]
                per_link = np.stack([n[where], best[where].astype(np.int64)])
            per_window = _stretches(per_link, n_links)[:, _unpacked(row["windows"], "<u4")]
            count, best_of = _stretches(per_window, np.array(row["n_windows"], np.int64))
            parts = {name: batch.column(name)[i].values for name in ("ids", "n_a", "n_b", "n_groups", "groups")}
            yield pa.RecordBatch.from_arrays(
                [parts["ids"], parts["n_a"], parts["n_b"], parts["n_groups"], parts["n_groups"], pa.array(best_of), pa.array(count), parts["groups"]],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"],
            )


def align(
    docs: DataFrame, a_path: str, a_pattern: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", groups: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs`` (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), and the pair counts.

    ``a_path`` and ``a_pattern`` are a byte-level vocabulary of the tokenizers library and the pattern of
    its pre-tokens, ``b_path`` is a sentencepiece model, both on every machine. A group is a stretch
    between offsets where both end a token; its last tokens are linked, so links and groups are equal in
    number. ``groups="text"`` gives ``a1,a2|b1;a3|b2,b3``, ``groups="sha256"`` its digest. A NULL or empty
    text, and one whose tokens do not give back its bytes, has no tokens: zeros and an empty string. A
    NULL id keeps its row, repeated rows count and come back repeatedly, an empty table gives no rows;
    other columns are ignored. A text of any length is tokenised whole.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = dict(rows.dtypes)["doc_id"]
    made = written(chunks(rows, a_path, a_pattern, b_path, groups), f"align-{uuid.uuid4().hex}")
    uses = made.select("chunk", "windows", "links", "n_links").mapInArrow(_uses, "chunk string, pair long, n long")
    counts = keep(pair_counts(uses))
    needed = uses.select("chunk", "pair").join(counts.select("pair", "n", "best"), "pair").groupBy("chunk").agg(
        F.collect_list(F.struct("pair", "n", "best")).alias("uses")
    )
    out = made.join(needed, "chunk", "left").mapInArrow(
        _sums, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    )
    return out, counts.select("a", "b", "n", "best")
