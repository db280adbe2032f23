"""Vector best-fit packing of token sequences.

Documents are encoded in Python batches and cut into pieces of at most ``tokens`` tokens. Pieces
are dealt by place into shards of bounded size, and each shard is packed on its own: a bin has
three capacities (tokens, documents, attention cost, the sum of squared lengths), and a piece,
largest first, goes to the open bin that fits it under all three and has the largest weighted
dot product of the piece with the residual capacities for ``rule="dot"``, or the smallest weighted
norm of what would remain for ``rule="norm"``. Bins that a shard leaves poorly filled are opened
again and packed once more in the shards of a second round.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from .rows import keep, numbered, pick

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Characters below this one have had their classes (letter, digit, white space) in all versions of
# Unicode that the libraries may carry.
SETTLED = 0x530


class Encoder:
    """Token ids of whole texts as the tokenizers library gives them for the vocabulary in ``path``.

    The same vocabulary is also loaded into tiktoken, which takes half the time. It encodes the
    texts in which both libraries cut alike beyond doubt: without special strings, and of settled
    characters only. All other texts go to tokenizers itself.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        special = {str(t.content) for t in self.tok.get_added_tokens_decoder().values()}
        # Byte-level vocabularies write a byte as a character: printable ones as they are, the rest from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in t): i for t, i in self.tok.get_vocab().items() if t not in special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.odd = re.compile("|".join([f"[^\\x00-{chr(SETTLED - 1)}]", *map(re.escape, special)]))

    def encode(self, text: str) -> np.ndarray:
        if self.odd.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def pieces(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", tokens: int = 2048,
    end_id: int = 0, ids: bool = True,
) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32[, ids]): encoded texts with ``end_id`` added, in pieces of at most ``tokens``.

    Of a longer document only the first piece may be shorter. ``ids`` are little-endian unsigned
    32-bit numbers. ``path`` is a byte-level vocabulary file of the tokenizers library on every
    machine, ``pattern`` the regular expression of its pre-tokens.
    """
    rows = numbered(pick(docs, doc_id=id_col, text=text_col))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get((path, pattern)) or _ENCODERS.setdefault((path, pattern), Encoder(path, pattern))
        for batch in batches:
            # Ids are several times as long as the texts at worst, so they go out in parts.
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                owner, piece, start, length, crc, data = [], [], [], [], [], []
                for i, text in enumerate(some.column("text").to_pylist()):
                    doc = np.append(encoder.encode(text or ""), np.uint32(end_id)).astype("<u4")
                    n = len(doc)
                    edges = [0, *range(n % tokens or tokens, n + 1, tokens)]
                    for j, (a, b) in enumerate(zip(edges, edges[1:])):
                        part = doc[a:b].tobytes()
                        owner.append(i), piece.append(j), start.append(a), length.append(b - a), crc.append(zlib.crc32(part))
                        if ids:
                            data.append(part)
                which = pa.array(owner, pa.int64())
                columns = [some.column("row").take(which), some.column("doc_id").take(which), pa.array(piece, pa.int32())]
                columns += [pa.array(c, pa.int64()) for c in (start, length, crc)] + [pa.array(data, pa.binary())] * ids
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    names = [c.split()[0] for c in schema.split(", ")]
    return rows.select("row", "doc_id", "text").mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, counts: np.ndarray, costs: np.ndarray, capacity: tuple[float, float, float],
             weights: tuple[float, float, float], rule: str) -> np.ndarray:
    """The bin of each item; items that fill a bin alone get one without a search."""
    size = np.stack([lengths, counts, costs]) / np.array(capacity)[:, None]
    w = np.array(weights)[:, None]
    bins = np.full(len(lengths), -1)
    residual = np.empty((3, 64))
    n_bins, n_open = 0, 0
    number = np.empty(64, np.int64)  # of the open bins
    for i in np.argsort(-(w * size).sum(0), kind="stable"):
        item = size[:, i : i + 1]
        left = residual[:, :n_open] - item
        fits = (left >= -1e-12).all(0) if n_open else np.zeros(0, bool)
        if fits.any():
            if rule == "dot":
                # Largest product first; of equal ones the tighter bin.
                score = -(w * item * residual[:, :n_open]).sum(0)
            else:
                score = (w * left**2).sum(0)
            score[~fits] = np.inf
            at = int(score.argmin())
        else:
            if n_open == residual.shape[1]:
                residual, number = np.hstack([residual, np.empty_like(residual)]), np.concatenate([number, number])
            residual[:, n_open], number[n_open] = 1.0, n_bins
            at, n_open, n_bins = n_open, n_open + 1, n_bins + 1
        bins[i] = number[at]
        residual[:, at] -= size[:, i]
        if residual[0, at] < 0.5 / capacity[0] or residual[1, at] < 0.5 / capacity[1] or residual[2, at] <= 0:
            n_open -= 1  # full: closed, the last open bin takes its place
            residual[:, at], number[at] = residual[:, n_open], number[n_open]
    return bins


def pack(
    items: DataFrame, tokens: int = 2048, documents: int = 2048, attention: float = 2048.0**2,
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25), rule: str = "norm", shard: int = 20_000, refill: float = 0.98,
) -> DataFrame:
    """Add sequence_id and offset to ``items`` (row, piece, length, ...): their places in sequences.

    Every sequence holds at most ``tokens`` tokens, ``documents`` pieces and ``attention`` cost (sum
    of squared lengths); offsets follow one another from 0 in the order the pieces were placed. An
    item over a capacity raises an error. Shards have about ``shard`` items; sequences less full
    than ``refill`` are packed again with those of other shards. An empty table gives no rows.
    """
    kind = items.schema
    items = keep(items)
    capacity = (float(tokens), float(documents), float(attention))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind) + ", seq string"

    def fit(prefix: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            length = pdf["length"].to_numpy(np.float64)
            if len(length) and (length.max() > tokens or length.max() ** 2 > attention):
                raise ValueError("an item is over a capacity")
            pdf = pdf.sort_values(["length", "row", "piece"], ascending=[False, True, True], kind="stable")
            length = pdf["length"].to_numpy(np.float64)
            got = best_fit(length, np.ones(len(length)), length**2, capacity, weights, rule)
            shard_no = pdf["shard"].iloc[0]
            return pdf.drop(columns="shard").assign(seq=[f"{prefix}{shard_no}.{b}" for b in got])

        return run

    def shards(df: DataFrame, n: int) -> DataFrame:
        return df.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(n)))

    names = items.columns
    n = max(1, -(-items.count() // shard))
    # Items that fill a sequence need no search.
    alone = F.col("length") >= tokens
    full = items.where(alone).withColumn("seq", F.concat(F.lit("f"), F.col("row"), F.lit("."), F.col("piece")))
    first = keep(shards(items.where(~alone), n).groupBy("shard").applyInPandas(fit("a"), out))
    fill = first.groupBy("seq").agg(F.sum("length").alias("used"))
    poor = fill.where(F.col("used") < refill * tokens)
    again = keep(first.join(poor.select("seq"), "seq", "left_semi").select(names))
    n_again = max(1, -(-again.count() // shard))
    second = shards(again, n_again).groupBy("shard").applyInPandas(fit("b"), out)
    packed = first.join(poor.select("seq"), "seq", "left_anti").select(*names, "seq").unionByName(second).unionByName(full)
    place = Window.partitionBy("seq").orderBy(F.desc("length"), "row", "piece")
    return packed.withColumn("offset", F.sum("length").over(place) - F.col("length")).withColumn(
        "sequence_id", F.xxhash64("seq")
    ).drop("seq")
