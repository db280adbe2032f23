"""Token counts with overlap resynchronisation for huge documents.

A text longer than ``chunk`` is encoded in overlapping chunks. The tokenizer cuts a text into
pre-tokens from left to right, and where it goes on depends only on where it stands; so once the
scan of a chunk and the scan of the chunk before both stand at one place, they agree from there on.
The splice is such a place: a pre-token starts there in both chunks, the earlier chunk sees far
enough past it for its own pre-tokens before it to be whole, and no character there can join with
the one before it. Where the overlap holds none (one endless run of letters), it is widened, in the
end to the whole rest of the text.

Texts of one chunk are counted by their blank-separated pieces, whose counts the tokenizer gives
and a bounded memory of pieces repeats.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from .rows import pick

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARGIN = 16  # characters that the longest look-ahead and any special string of the vocabularies stay below
MEMORY = 300_000


class Counter:
    """Counts tokens as the tokenizer in ``path`` gives them, without added tokens."""

    def __init__(self, path: str, chunk: int, overlap: int):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.chunk, self.overlap = chunk, overlap
        self.special = [str(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.memory: dict[str, int] = {}

    def encode(self, text: str):
        return self.tok.encode(text, add_special_tokens=False)

    def count(self, text: str) -> int:
        if len(text) <= self.chunk:
            return self._pieces([text])[0]
        return sum(b - a for a, b in self.spans(text, self._starts))

    def counts(self, texts: list[str]) -> list[int]:
        small = [t for t in texts if len(t) <= self.chunk]
        got = iter(self._pieces(small))
        return [next(got) if len(t) <= self.chunk else self.count(t) for t in texts]

    def _pieces(self, texts: list[str]) -> list[int]:
        """Pre-tokens never hold a blank or line end here, so pieces between them count alone."""
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        memory = self.memory
        new = list({p for pieces in cut for p in pieces if p not in memory})
        if len(memory) + len(new) > MEMORY:
            memory.clear()
            new = list({p for pieces in cut for p in pieces})
        for at in range(0, len(new), 200):
            some = new[at : at + 200]
            # One text of many pieces costs half as much as many texts; a token belongs to the piece it starts in.
            encoding = self.encode(" ".join(some))
            edges = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
            starts = np.array([a for a, _ in encoding.offsets], np.int64)
            memory.update(zip(some, np.bincount(np.searchsorted(edges, starts, "right"), minlength=len(some)).tolist()))
        get = memory.__getitem__
        return [sum(map(get, pieces)) for pieces in cut]

    def _starts(self, text: str) -> tuple[list[int], list[int]]:
        """(starts of pre-tokens, tokens before each) with the end of the text last."""
        encoding = self.encode(text)
        at, before, last = [], [], None
        for i, (word, (start, _)) in enumerate(zip(encoding.word_ids, encoding.offsets)):
            if word != last or word is None:
                at.append(start)
                before.append(i)
                last = word
        return [*at, len(text)], [*before, len(encoding)]

    def spans(self, text: str, starts) -> Iterator[tuple[int, int]]:
        """Token ranges (within each chunk's own encoding) that make up the text without gap or overlap."""
        left, at, before = 0, *starts(text[: self.chunk])
        origin, low = 0, 0  # place of the chunk in the text; tokens of it that are already counted
        end = min(self.chunk, len(text))
        while end < len(text):
            overlap = self.overlap
            while True:
                begin = max(left, end - overlap)
                stop = min(len(text), begin + self.chunk + overlap)
                nxt_at, nxt_before = starts(text[begin:stop])
                nxt = {begin + p: b for p, b in zip(nxt_at[:-1], nxt_before[:-1])}
                # The latest place where both scans stand, with the chunk before seeing past it.
                common = [
                    (origin + p, b) for p, b in zip(at[:-1], before[:-1])
                    if begin < origin + p <= end - MARGIN and origin + p in nxt and self._free(text, origin + p)
                ]
                if common:
                    place, done = common[-1]
                    yield low, done
                    left, origin, low, end = place, begin, nxt[place], stop
                    at, before = nxt_at, nxt_before
                    break
                if begin == left and stop == len(text):
                    # No common place: the whole rest at once, from the last sure place.
                    at, before = starts(text[left:])
                    yield 0, before[-1]
                    return
                overlap *= 2
        yield low, before[-1]

    def _free(self, text: str, p: int) -> bool:
        """No special string crosses p, and the characters beside p stay apart and single when normalised."""
        if not text[p].isascii() or len(text[p - 1].lower()) > 1:
            return False
        near = text[max(0, p - MARGIN) : p + MARGIN]
        return not any(s in near for s in self.special)


_COUNTERS: dict[tuple, Counter] = {}


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 32_768, overlap: int = 1024,
    limit: int = 2048,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``path``: a vocabulary file of the tokenizers library on every machine. Special strings inside
    a text are handled as the library does by default. A NULL text is empty: 0 bytes, 0 tokens. A
    NULL id keeps its row, repeated rows give repeated results, an empty table none; other columns
    are ignored. No shuffle; a task holds one batch and a bounded memory of pieces.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.setdefault((path, chunk, overlap), None) or Counter(path, chunk, overlap)
        _COUNTERS[path, chunk, overlap] = counter
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = counter.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return rows.select("doc_id", size, "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
